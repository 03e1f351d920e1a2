"""URL filtering by rules and, where no rule fits, by the ratio of two character language models.

Rules name a host (with its subdomains) and the start of a path; the longest fitting one decides. The URLs that rules
accept and reject train one variable-order Markov model each: a character's probability after up to three others, mixed
with that after shorter contexts by the number of followers a context has (Witten-Bell). A URL's score is the difference
of its log probabilities per character; the threshold lies as many standard deviations from the accepted URLs' mean as
from the rejected ones'. Everything is DataFrame expressions: counts of distinct 4-grams, joins of small tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import lower_ascii, small_side, without

ORDER = 3
_PAD = "\u0002" * ORDER
_END = "\u0003"
#: (host, path, verdict) of the registered query.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path: from there up to `?`, `#` or the
    end. Both empty for null and where there is no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits; of rules of one length the first given."""
    text = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(reversed(rules), key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def _grams(url: Column) -> Column:
    """All runs of ORDER + 1 characters, from shifted copies of the list of characters: the work follows the length."""
    s = F.concat(F.lit(_PAD), lower_ascii(F.coalesce(url, F.lit(""))), F.lit(_END))
    chars = F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0))
    out = F.slice(chars, F.lit(1), F.size(chars) - ORDER)
    for k in range(1, ORDER + 1):
        out = F.zip_with(out, F.slice(chars, F.lit(k + 1), F.size(chars) - ORDER), lambda a, b: F.concat(a, b))
    return out


def log_ratios(grams: DataFrame, broadcast_rows: int = 500_000) -> DataFrame:
    """(gram, ratio) from (gram, allow, block), the counts of each (ORDER + 1)-gram in accepted and rejected URLs: the log
    of the two models' probabilities of its last character after the others."""
    out = grams.select("gram")
    p = {v: F.lit(1.0 / 256) for v in ("allow", "block")}
    for k in range(ORDER + 1):
        pair, ctx = F.substring("gram", ORDER + 1 - k, k + 1), F.substring("gram", ORDER + 1 - k, k) if k else F.lit("")
        pairs = grams.groupBy(pair.alias(f"pair{k}")).agg(F.sum("allow").alias(f"allow{k}"), F.sum("block").alias(f"block{k}"), F.first(ctx).alias(f"ctx{k}"))
        pairs = materialise(pairs, "url-pairs")
        ctxs = pairs.groupBy(f"ctx{k}").agg(*[a for v in ("allow", "block") for a in (
            F.sum(f"{v}{k}").alias(f"{v}_n{k}"), F.sum((F.col(f"{v}{k}") > 0).cast("long")).alias(f"{v}_t{k}"))])
        out = (out.withColumn(f"pair{k}", pair).join(small_side(pairs, broadcast_rows), f"pair{k}")
               .join(small_side(materialise(ctxs, "url-contexts"), broadcast_rows), f"ctx{k}"))
        for v in p:
            n, t = F.col(f"{v}_n{k}"), F.col(f"{v}_t{k}")
            p[v] = F.when(n == 0, p[v]).otherwise((F.col(f"{v}{k}") + t * p[v]) / (n + t))
        out = out.select("gram", *[p[v].alias(f"p_{v}") for v in p])
        p = {v: F.col(f"p_{v}") for v in p}
    return out.select("gram", (F.ln("p_allow") - F.ln("p_block")).alias("ratio"))


def judge_urls(pages: DataFrame, rules=RULES, url: str = "url", broadcast_rows: int = 500_000, carry: list[str] | None = None) -> DataFrame:
    """Per row: the columns in `carry` (all when None), `host`, `path`, `rule` (null where none fits), `verdict` (allow or
    block) and `url_score` (log ratio per character).

    A null URL is scored as an empty one. Where rules accept none, or reject none, of the URLs, the score is compared
    with 0; equal to the threshold means allow. Repeated rows are judged alike; columns of the output's names are
    replaced; an empty table gives an empty result. Tables of grams are broadcast up to `broadcast_rows` rows, counted first.
    """
    pages = without(pages, "host", "path", "rule", "verdict", "url_score")
    names = pages.columns if carry is None else carry
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(url).alias("_url"), host.alias("host"), path.alias("path"))
    rule, said = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = materialise(rows.select("*", rule.alias("rule"), said.alias("_said"), F.monotonically_increasing_id().alias("_rid")), "url-rows")
    hits = rows.select("_rid", "_said", F.explode(_grams(F.col("_url"))).alias("gram"))
    counts = materialise(hits.groupBy("gram").agg(*[F.sum((F.col("_said") == v).cast("long")).alias(v) for v in ("allow", "block")])
                         .na.fill(0, ["allow", "block"]), "url-grams")
    ratios = small_side(materialise(log_ratios(counts, broadcast_rows), "url-ratios"), broadcast_rows)
    scores = hits.join(ratios, "gram").groupBy("_rid").agg((F.sum("ratio") / F.count(F.lit(1))).alias("url_score"))
    rows = materialise(rows.drop("_url").join(scores, "_rid", "left"), "url-scores")
    mean = {v: F.avg(F.when(F.col("_said") == v, F.col("url_score"))) for v in ("allow", "block")}
    dev = {v: F.stddev_pop(F.when(F.col("_said") == v, F.col("url_score"))) for v in ("allow", "block")}
    both = dev["allow"] + dev["block"]
    level = rows.agg(F.when(both > 0, (mean["allow"] * dev["block"] + mean["block"] * dev["allow"]) / both)
                     .otherwise((mean["allow"] + mean["block"]) / 2)).first()[0] or 0.0
    method = F.when(F.coalesce("url_score", F.lit(0.0)) >= level, F.lit("allow")).otherwise(F.lit("block"))
    return rows.select("_row.*", "host", "path", "rule", F.coalesce("_said", method).alias("verdict"), "url_score")
