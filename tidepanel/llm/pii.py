"""Personal data by weak supervision, in DataFrame expressions.

Four strict patterns give the base spans, which always stay. Looser patterns give further candidates. On each candidate
labelers vote +1, 0 or -1: the strict pattern (regex), known endings, ranges and prefixes (gazetteer), cue words before it
(context) and its separators (form). Expectation-maximisation estimates each labeler's reliability per kind from the
counts of vote patterns; the posteriors are soft labels for the final classifier, a naive Bayes over the span's own
features (neighbouring characters, length, share of digits, separators). A candidate it believes in is added unless it
overlaps a base span or an earlier addition.

Only counts by (kind, votes, features) reach the driver: their number is fixed by the design, not by the corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import without

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, written so that a failing run of characters is not tried again from each of its places.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must show for the pattern to be tried at all.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){12}", "phone": r"\+[0-9]"}
LOOSE = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._-]{0,63}+ ?[\[({](?i:at)[\])}] ?[A-Za-z0-9-]{1,63}+(?: ?[\[({](?i:dot)[\])}] ?[A-Za-z0-9-]{1,63}+|\.[A-Za-z0-9-]{1,63}+)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9-])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9-])",
    "phone": r"(?<![0-9+().-])\(?[2-9][0-9]{2}\)?[ .-][2-9][0-9]{2}[ .-][0-9]{4}(?![0-9-])",
}
LOOSE_HINT = {"email": r"[\[({](?i:at)[\])}]", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", "card": r"3[47][0-9]{2}", "phone": r"[0-9]{3}[ .-][0-9]{4}"}
#: Gazetteers and cue words.
KNOWN = {"email": r"(?i)(?:\.|dot[\])}] ?)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$", "ip": r"^(?!0|127\.|22[4-9]|2[3-5])",
         "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))", "phone": r"^(?:\+(?:1|33|34|44|49)|\(?[2-9])"}
CUES = {"email": r"(?i)(?:e-?mail|contact|write|reach|correo|courriel)", "ip": r"(?i)(?:\bip\b|host|server|address|login|from)",
        "card": r"(?i)(?:card|visa|master|credit|pay|karte|carte|tarjeta)", "phone": r"(?i)(?:phone|tel|call|mobile|fax|ring)"}
AGAINST = r"(?i)(?:version|order|invoice|isbn|serial|build|token|hash|sku|id)[ #:.=\"]*$"
_SPAN = "array<struct<s:bigint,e:bigint,m:string,before:string,after:string>>"
_BLOCK = 64                                       # matches that one inner fold lists
_CONTEXT = 24                                     # characters before a match that are looked at


def _find(text: Column, pattern: str, hint: str) -> Column:
    """Matches of `pattern` with their places in code points, leftmost and without overlap, what stands before each (its
    gap and the match before that, at most 24 characters) and the character after it.

    Lists are grown in blocks, and neighbours come from the gaps, so the work follows the length of the text."""
    def walk(x):
        gaps, found = x["gaps"], x["found"]
        n = F.size(found)
        ends = lambda a, b: F.substring(F.concat(a, b), 1, 1)
        after = F.zip_with(F.slice(gaps, F.lit(2), n), F.slice(F.concat(found, F.array(F.lit(""))), F.lit(2), n), ends)
        before = F.zip_with(F.slice(gaps, F.lit(1), n), F.slice(F.concat(F.array(F.lit("")), found), F.lit(1), n), lambda g, m: F.struct(
            F.length(g).alias("g"), F.substring(F.concat(m, g), -_CONTEXT, _CONTEXT).alias("before")))
        return F.zip_with(before, F.zip_with(found, after, lambda m, c: F.struct(m.alias("m"), c.alias("after"))), lambda a, b: F.struct(
            a["g"].alias("g"), a["before"].alias("before"), b["m"].alias("m"), b["after"].alias("after")))

    def one(a, p):
        s = (a["at"] + p["g"]).cast("bigint")
        e = (s + F.length(p["m"])).cast("bigint")
        return F.struct(e.alias("at"), F.concat(a["out"], F.array(F.struct(
            s.alias("s"), e.alias("e"), p["m"].alias("m"), p["before"].alias("before"), p["after"].alias("after")))).alias("out"))

    def place(pairs):
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(pairs) / _BLOCK).cast("int")), lambda i: F.slice(pairs, i * _BLOCK + 1, F.lit(_BLOCK)))
        start = lambda at: F.struct(at.cast("bigint").alias("at"), F.array().cast(_SPAN).alias("out"))
        whole = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))

        def block(a, ps):
            return _bind(F.aggregate(ps, start(a["at"]), one), lambda done: F.struct(
                done["at"].alias("at"), F.concat(a["out"], F.array(done["out"])).alias("out")))

        return F.aggregate(blocks, whole, block, lambda a: F.flatten(a["out"]))

    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return F.when(text.rlike(hint), _bind(_bind(parts, walk), place)).otherwise(F.array().cast(_SPAN))


def _bind(value: Column, use) -> Column:
    """`use(value)` with the value computed once."""
    return F.element_at(F.transform(F.array(value), lambda x: use(x)), 1)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))
    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, F.substring(d, i, 1).cast("int")).otherwise(
        (F.substring(d, i, 1).cast("int") * 2) % 10 + F.floor(F.substring(d, i, 1).cast("int") / 5).cast("int")))
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.coalesce(F.length(F.regexp_replace(p, "^0+", "")) <= 3, F.lit(False)) & (
            F.coalesce(F.when(F.length(F.regexp_replace(p, "^0+", "")) <= 3, F.concat(F.lit("0"), F.regexp_replace(p, "^0+", "")).cast("int")), F.lit(999)) <= 255))
    n = F.length(_digits(m))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(m)).otherwise(F.lit(False))
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def _valid_in(kind: str):
    return lambda x: _valid(kind, x["m"])


def _class(c: Column) -> Column:
    """0 edge or blank, 1 punctuation, 2 letter or digit."""
    return F.when(c.rlike(r"^\s?$"), 0).when(c.rlike(r"^[\p{L}\p{N}]$"), 2).otherwise(1)


def _candidates(kind: str, spans: Column, base: bool) -> Column:
    """Spans with votes and features."""
    k = KINDS.index(kind)
    one = lambda yes, no: F.when(yes, F.lit(1)).when(no, F.lit(-1)).otherwise(F.lit(0))

    def judge(x):
        before = x["before"]
        m, n = x["m"], F.length(x["m"])
        share = F.floor(F.length(_digits(m)) * 3 / n).cast("int")
        seps = F.length(F.regexp_replace(m, "[A-Za-z0-9]", ""))
        votes = (F.lit(1 if base else 0), one(m.rlike(KNOWN[kind]), F.lit(kind != "email") & ~m.rlike(KNOWN[kind])),
                 one(before.rlike(CUES[kind]), before.rlike(AGAINST)), one(seps.between(0, 6), seps > 10))
        feats = (_class(F.substring(before, -1, 1)), _class(x["after"]), F.least(F.lit(4), F.floor(n / 8).cast("int")), share, F.least(F.lit(3), seps.cast("int")))
        key = F.concat_ws(",", *[v.cast("string") for v in votes])
        return F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e"), F.lit(base).alias("base"), key.alias("votes"),
                        F.concat_ws(",", *[f.cast("string") for f in feats]).alias("feats"))

    return F.transform(spans, judge)


def expectation_maximisation(counts: dict[tuple[int, ...], int], rounds: int = 30) -> dict[tuple[int, ...], float]:
    """Posterior of 'personal' for each vote pattern of one kind. Labelers err independently; an abstention is no evidence.

    Starts from reliable labelers; half a vote of smoothing keeps every rate inside (0, 1)."""
    if not counts:
        return {}
    n = len(next(iter(counts)))
    prior, right, wrong = 0.5, [0.8] * n, [0.2] * n          # chance of a +1 vote on true and on false spans
    post: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for v in counts:
            a, b = math.log(prior), math.log(1 - prior)
            for i, x in enumerate(v):
                if x:
                    a += math.log(right[i] if x > 0 else 1 - right[i])
                    b += math.log(wrong[i] if x > 0 else 1 - wrong[i])
            post[v] = 1 / (1 + math.exp(min(700, b - a)))
        total = sum(counts.values())
        prior = (sum(c * post[v] for v, c in counts.items()) + 0.5) / (total + 1)
        for i in range(n):
            for rate, of, start in ((right, lambda v: post[v], 0.8), (wrong, lambda v: 1 - post[v], 0.2)):
                up = sum(c * of(v) for v, c in counts.items() if v[i] > 0)
                cast = sum(c * of(v) for v, c in counts.items() if v[i])
                rate[i] = (up + 4 * start) / (cast + 4)
    return post


def train_classifier(table: list[tuple[int, str, str, int]]) -> tuple[dict[int, float], dict[str, float]]:
    """(log prior odds by kind, log odds by 'kind|feature|value') of a naive Bayes fitted to soft labels; `table` has
    (kind, votes, features, count)."""
    odds, weights = {}, {}
    for k in range(len(KINDS)):
        rows = [(tuple(map(int, v.split(","))), f.split(","), c) for kk, v, f, c in table if kk == k]
        patterns: dict[tuple[int, ...], int] = {}
        for v, _, c in rows:
            patterns[v] = patterns.get(v, 0) + c
        post = expectation_maximisation(patterns)
        yes = 1 + sum(c * post[v] for v, _, c in rows)
        no = 1 + sum(c * (1 - post[v]) for v, _, c in rows)
        odds[k] = math.log(yes / no)
        seen: dict[str, list[float]] = {}
        for v, f, c in rows:
            for i, x in enumerate(f):
                s = seen.setdefault(f"{k}|{i}|{x}", [0.5, 0.5])
                s[0] += c * post[v]
                s[1] += c * (1 - post[v])
        weights |= {key: math.log(a / (yes + 1)) - math.log(b / (no + 1)) for key, (a, b) in seen.items()}
    return odds, weights


def find_personal_data(docs: DataFrame, text: str = "text", least: float = 0.9, carry: list[str] | None = None) -> DataFrame:
    """Per row: the columns in `carry` (all when None), `base` and `spans`: arrays of (kind number, start, end) in code
    points, end exclusive, by kind as in `KINDS`, then start; `spans` holds the base ones and the accepted additions.

    A null text is empty. Repeated rows are judged alike; columns of the output's names are replaced; an empty table
    gives an empty result."""
    docs = without(docs, "base", "spans")
    names = docs.columns if carry is None else carry
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    t = F.col("_t")
    for k in KINDS:
        rows = rows.withColumn(f"_b_{k}", F.filter(_find(t, STRICT[k], HINT[k]), _valid_in(k)))
        rows = rows.withColumn(f"_l_{k}", _find(t, LOOSE[k], LOOSE_HINT[k]))
    cand = F.concat(*[_candidates(k, F.col(f"_{which}_{k}"), which == "b") for which in "bl" for k in KINDS])
    rows = materialise(rows.select("_row", cand.alias("_c")), "pii-candidates")
    seen = rows.select(F.explode("_c").alias("c")).groupBy("c.k", "c.votes", "c.feats").agg(F.count(F.lit(1)).alias("n")).collect()
    odds, weights = train_classifier([tuple(r) for r in seen])
    tables = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv]) if m else F.expr("cast(map() as map<string,double>)")
    by_kind, by_value = tables({str(k): v for k, v in odds.items()}), tables(weights)
    belief = lambda c: F.element_at(by_kind, c["k"].cast("string")) + F.aggregate(
        F.transform(F.split(c["feats"], ","), lambda f, i: F.concat_ws("|", c["k"].cast("string"), i.cast("string"), f)), F.lit(0.0),
        lambda a, key: a + F.coalesce(F.element_at(by_value, key), F.lit(0.0)))
    plain = lambda c: F.struct(c["k"].alias("k"), c["s"].alias("s"), c["e"].alias("e"))
    base = F.transform(F.filter("_c", lambda c: c["base"]), plain)
    extra = F.transform(F.filter("_c", lambda c: ~c["base"] & (belief(c) >= math.log(least / (1 - least)))), plain)
    rows = rows.select("_row", F.array_sort(base).alias("base"), extra.alias("_x"))
    clear = lambda x, taken: ~F.exists(taken, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
    added = F.aggregate("_x", F.col("base"), lambda a, x: F.when(clear(x, a), F.concat(a, F.array(x))).otherwise(a))
    return rows.select("_row.*", "base", F.array_sort(added).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))))


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["k"] == KINDS.index(kind))).cast("long")
