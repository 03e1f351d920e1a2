"""Shared CTEs of the DuckDB counterparts. They work on the dense date x symbol grid with LAG, while the Spark side
works on the sparse panel with RANGE frames, so an agreement checks the calendar-shift rule as well."""

from __future__ import annotations

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, text: str, *needs: str):
    CTES[name] = (needs, text)


def sql(body: str, *needs: str) -> str:
    """`body` preceded by the CTEs it needs, each once, in dependency order."""
    seen: list[str] = []

    def visit(n: str):
        if n in seen:
            return
        for d in CTES[n][0]:
            visit(d)
        seen.append(n)

    for n in needs:
        visit(n)
    if not seen:
        return body
    own = body.lstrip()
    head = ",\n".join(f"{n} AS (\n{CTES[n][1]}\n)" for n in seen)
    if own[:5].upper() == "WITH ":
        return f"WITH {head},\n{own[5:]}"
    return f"WITH {head}\n{own}"


def _trades(date: str, dow: str) -> str:
    return f"""SELECT {date} AS date, p_brand AS symbol, l_suppkey, l_extendedprice / l_quantity AS px,
  {{'d': {dow}, 'o': l_orderkey, 'l': l_linenumber, 'p': l_partkey}} AS ord,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS c, l_quantity AS q
FROM lineitem JOIN part ON l_partkey = p_partkey"""


BARS = """SELECT date, symbol, arg_min(px, ord) AS open, max(px) AS high, min(px) AS low, arg_max(px, ord) AS close,
  CAST(sum(c) AS DOUBLE) / 100.0 / sum(q) AS adj_close, sum(q) AS volume, CAST(sum(c) AS BIGINT) AS cents
FROM {} GROUP BY date, symbol"""

cte("trades", _trades("CAST(date_trunc('week', l_shipdate) AS DATE)", "(dayofweek(l_shipdate) + 6) % 7"))
cte("bars", BARS.format("trades"), "trades")
cte("cal", "SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS t FROM (SELECT DISTINCT date FROM bars)",
    "bars")
cte("panel", "SELECT b.*, c.t FROM bars b JOIN cal c USING (date)", "bars", "cal")
cte("grid", """SELECT c.date, c.t, s.symbol, b.open, b.high, b.low, b.close, b.adj_close, b.volume, b.cents,
  b.adj_close AS x FROM cal c CROSS JOIN (SELECT DISTINCT symbol FROM bars) s
  LEFT JOIN bars b ON b.date = c.date AND b.symbol = s.symbol""", "bars", "cal")
cte("trades_d", _trades("CAST(l_shipdate AS DATE)", "0"))
cte("bars_d", BARS.format("trades_d"), "trades_d")
cte("cal_d", "SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS t FROM (SELECT DISTINCT date FROM bars_d)",
    "bars_d")
cte("grid_d", """SELECT c.date, c.t, s.symbol, b.open, b.high, b.low, b.close, b.adj_close, b.volume, b.adj_close AS x
  FROM cal_d c CROSS JOIN (SELECT DISTINCT symbol FROM bars_d) s
  LEFT JOIN bars_d b ON b.date = c.date AND b.symbol = s.symbol""", "bars_d", "cal_d")
cte("rets", """SELECT *, x / lag(x) OVER (PARTITION BY symbol ORDER BY t) - 1 AS ret,
  lead(x) OVER (PARTITION BY symbol ORDER BY t) / x - 1 AS fwd FROM grid""", "grid")
cte("sectors", """SELECT DISTINCT p_brand AS symbol, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) % 5 AS sector,
  'F' || CAST(CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) % 5 AS VARCHAR) AS fund FROM part""")
cte("fund_bars", """SELECT date, f AS symbol, CAST(sum(cents) AS DOUBLE) / 100.0 / sum(volume) AS adj_close,
  sum(volume) AS volume FROM (SELECT b.date, s.fund AS f, b.cents, b.volume FROM bars b JOIN sectors s USING (symbol)
  UNION ALL SELECT date, 'MKT', cents, volume FROM bars) GROUP BY date, f""", "bars", "sectors")
cte("sgrid", """SELECT date, t, symbol, x, volume FROM (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, printf('S%012d', l_suppkey) AS symbol,
   CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 / sum(l_quantity) AS x,
   sum(l_quantity) AS volume FROM lineitem GROUP BY ALL)
  RIGHT JOIN (SELECT m AS date, (year(m) - 1995) * 12 + month(m) - 1 AS t, printf('S%012d', s) AS symbol FROM
   (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS m FROM lineitem),
   (SELECT DISTINCT l_suppkey AS s FROM lineitem)) USING (date, symbol)""")
cte("srets", """SELECT *, -(x / lag(x) OVER w - 1) AS score, lead(x) OVER w / x - 1 AS fwd FROM sgrid
  WINDOW w AS (PARTITION BY symbol ORDER BY t)""", "sgrid")
cte("sscores", "SELECT date, symbol, score, fwd FROM srets WHERE score IS NOT NULL AND fwd IS NOT NULL", "srets")
cte("score_cols", """SELECT date, symbol, t, x, lead(x) OVER w / x - 1 AS fwd, -(x / lag(x, 5) OVER w - 1) AS rev5,
  lag(x, 4) OVER w / lag(x, 52) OVER w - 1 AS mom, -(x / lag(x, 4) OVER w - 1) AS str,
  -(x / lag(x, 1) OVER w - 1) AS wstr FROM grid WINDOW w AS (PARTITION BY symbol ORDER BY t)""", "grid")
cte("scores", """SELECT model, date, symbol, t, score, fwd FROM (
  SELECT 'rev5' AS model, date, symbol, t, rev5 AS score, fwd FROM score_cols WHERE x IS NOT NULL
  UNION ALL SELECT 'mom', date, symbol, t, mom, fwd FROM score_cols WHERE x IS NOT NULL
  UNION ALL SELECT 'str', date, symbol, t, str, fwd FROM score_cols WHERE x IS NOT NULL
  UNION ALL SELECT 'wstr', date, symbol, t, wstr, fwd FROM score_cols WHERE x IS NOT NULL)
  WHERE score IS NOT NULL""", "score_cols")
