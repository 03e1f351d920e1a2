"""Registered queries of the corpus operators, with their DuckDB counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chats import chats_sql, format_turn_rows, loss_texts, read_back
from .collocations import collocations, collocations_sql
from .common import sql_lower, sql_words, table
from .decontaminate import contaminated, find_benchmark_words
from .exact import exact_groups
from .language import identify
from .licences import licences_sql, scan_licences
from .maxent import fit_and_score
from .mixing import plan_mix
from .pii import KINDS, count_kind, find_personal_data, listed
from .sharding import kd_shards
from .simhash import near_duplicates
from .urls import judge_urls
from .whitening import by_component, whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return wrap


_BENCH_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@query("op1_decontaminate", f"""
WITH d AS (SELECT doc_id, {sql_words(sql_lower('text'), _BENCH_WORD)} AS w FROM documents),
 b AS (SELECT item_id, {sql_words(sql_lower('text'), _BENCH_WORD)} AS w FROM benchmark),
 pat AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
         FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
 grams AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
           FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM pat) WHERE len(w) >= k)),
 hit AS (SELECT doc_id, i, grams.k, item_id FROM grams JOIN pat ON grams.k = pat.k AND grams.g = pat.g),
 n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
 it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)""")
def op1(spark, sf_dir):
    found = find_benchmark_words(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), contaminated().alias("contaminated"))


@query("op2_mix_sources", f"""
WITH d AS (SELECT doc_id, source, len({sql_words('text')}) AS size,
            (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u
           FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
 w AS (SELECT *, CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS DOUBLE) AS w FROM s),
 r AS (SELECT *, sum(source_size) OVER () - 3.0 * coalesce(sum(source_size) OVER k, 0) AS free, sum(w) OVER () - coalesce(sum(w) OVER k, 0) AS wfree
       FROM w WINDOW k AS (ORDER BY source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 t AS (SELECT source, source_size, least(3.0 * source_size, max(free / wfree) OVER () * w) AS target FROM r),
 e AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS e FROM t),
 p AS (SELECT source, source_size, target, floor(e) AS whole, e - floor(e) AS p, target - floor(e) * source_size AS rest FROM e),
 q AS (SELECT d.*, source_size, target, whole, rest, CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p) * (size / (size + 200.0))) END AS q
       FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
 c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, size ROWS UNBOUNDED PRECEDING) AS upto FROM q WHERE q IS NOT NULL),
 n AS (SELECT doc_id, size, source_size, target, CAST(whole + CASE WHEN upto - size / 2.0 <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM c
       UNION ALL SELECT doc_id, size, source_size, target, CAST(whole AS BIGINT) FROM q WHERE q IS NULL)
SELECT doc_id, size, source_size, target, copies * size AS taken FROM n""")
def op2(spark, sf_dir):
    plan = plan_mix(table(spark, sf_dir, "documents", "doc_id", "source", "text"), carry=["doc_id"])
    return plan.select("doc_id", "size", "source_size", "target", "taken")


@query("op6_exact_dedup", r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d""")
def op6(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents", "doc_id", "text"), carry=["doc_id"])


@query("op10_kd_shards")
def op10(spark, sf_dir):
    return kd_shards(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), shards=8, carry=["doc_id"])


@query("op3_language_id")
def op3(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), keep_text=False).select("doc_id", "held_out", "lang_pred", "score")


@query("op5_simhash_dedup")
def op5(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), carry=["doc_id"]).select("doc_id", "fingerprint", "component_id")


@query("op8_maxent_lm")
def op8(spark, sf_dir):
    return fit_and_score(table(spark, sf_dir, "documents", "doc_id", "text"), carry=["doc_id"]).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _ratio_sql() -> str:
    """The two models as common table expressions over (gram, allow, block)."""
    out, p = [], {v: "(1.0 / 256)" for v in ("allow", "block")}
    source = "g"
    for k in range(4):
        pair, ctx = f"substr(gram, {4 - k}, {k + 1})", f"substr(gram, {4 - k}, {k})" if k else "''"
        out.append(f"pr{k} AS (SELECT {pair} AS pair, {ctx} AS ctx, sum(allow) AS allow, sum(block) AS block FROM g GROUP BY 1, 2)")
        out.append(f"cx{k} AS (SELECT ctx, sum(allow) AS na, sum(block) AS nb, count(*) FILTER (allow > 0) AS ta, count(*) FILTER (block > 0) AS tb FROM pr{k} GROUP BY 1)")
        f = {"allow": f"CASE WHEN na = 0 THEN {p['allow']} ELSE (pr{k}.allow + ta * {p['allow']}) / (na + ta) END",
             "block": f"CASE WHEN nb = 0 THEN {p['block']} ELSE (pr{k}.block + tb * {p['block']}) / (nb + tb) END"}
        out.append(f"p{k} AS (SELECT gram, CAST({f['allow']} AS DOUBLE) AS p_allow, CAST({f['block']} AS DOUBLE) AS p_block FROM {source} "
                   f"JOIN pr{k} ON pair = {pair} JOIN cx{k} USING (ctx))")
        source, p = f"p{k}", {"allow": "p_allow", "block": "p_block"}
    return ",\n ".join(out)


@query("op4_url_filter", f"""
WITH u AS (SELECT page_id, url, row_number() OVER () AS rid, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
 h AS (SELECT page_id, rid, url, {sql_lower("regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1)")} AS host,
        regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
 r AS (SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
        WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM h),
 v AS (SELECT *, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS said,
        repeat(chr(2), 3) || {sql_lower("coalesce(url, '')")} || chr(3) AS s FROM r),
 x AS (SELECT rid, said, substr(s, CAST(i AS BIGINT), 4) AS gram FROM (SELECT rid, said, s, unnest(range(1, length(s) - 2)) AS i FROM v)),
 g AS (SELECT gram, count(*) FILTER (said = 'allow') AS allow, count(*) FILTER (said = 'block') AS block FROM x GROUP BY 1),
 {_ratio_sql()},
 sc AS (SELECT rid, avg(ln(p_allow) - ln(p_block)) AS score FROM x JOIN p3 USING (gram) GROUP BY 1),
 m AS (SELECT avg(score) FILTER (said = 'allow') AS ma, avg(score) FILTER (said = 'block') AS mb, stddev_pop(score) FILTER (said = 'allow') AS da,
        stddev_pop(score) FILTER (said = 'block') AS db FROM v JOIN sc USING (rid)),
 t AS (SELECT coalesce(CASE WHEN da + db > 0 THEN (ma * db + mb * da) / (da + db) ELSE (ma + mb) / 2 END, 0) AS level FROM m)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN score >= level THEN 'allow' ELSE 'block' END) AS verdict FROM v JOIN sc USING (rid), t""")
def op4(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages", "page_id", "url"), carry=["page_id"]).select("page_id", "host", "path", "rule", "verdict")


@query("op7_pii_spans")
def op7(spark, sf_dir):
    found = find_personal_data(table(spark, sf_dir, "documents", "doc_id", "text"), carry=["doc_id"])
    return found.select("doc_id", *[count_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS], F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"))


@query("op9_licence_scan", licences_sql())
def op9(spark, sf_dir):
    found = scan_licences(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", *[F.concat_ws(",", c).alias(c) for c in ("sentence_ids", "licences", "unresolved")])


@query("op11_whiten_embeddings")
def op11(spark, sf_dir):
    return by_component(whiten(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), carry=["vec_id"])).select(
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


@query("op12_format_chats", chats_sql())
def op12(spark, sf_dir):
    said = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                 F.lit("</s>[INST] ok [/INST]").alias("text"))
    chats = format_turn_rows(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").unionByName(said))
    turns, loss = read_back(F.col("formatted")), F.concat_ws("", loss_texts(F.col("formatted"), F.col("loss")))
    chats = chats.select("conv_id", turns.alias("turns"), loss.alias("under"), F.length("formatted").cast("long").alias("formatted_chars"))
    lines = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
                        F.length("under").cast("long").alias("loss_chars"), F.sha2(F.col("under"), 256).alias("loss_sha256"), "formatted_chars")


@query("op13_phrase_collocations", collocations_sql())
def op13(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents", "lang", "text"))
