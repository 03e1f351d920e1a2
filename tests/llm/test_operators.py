"""The operators against plain versions of the same rules on small tables."""

import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash

from tidepanel.llm import maxent, simhash
from tidepanel.llm.decontaminate import Patterns, find_benchmark_words
from tidepanel.llm.exact import exact_groups
from tidepanel.llm.language import identify
from tidepanel.llm.licences import HINTS, RULES, SENTENCES, scan_licences
from tidepanel.llm.mixing import plan_mix, source_targets
from tidepanel.llm.pii import expectation_maximisation, find_personal_data, listed
from tidepanel.llm.sharding import kd_shards
from tidepanel.llm.urls import fitting_rule, host_and_path, judge_urls
SF = "/root/testdata/sf0.01"

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, texts, **more):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").repartition(3)


# 1 ------------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_benchmark_words(spark, block_bytes):
    rnd = random.Random(3)
    word = lambda: rnd.choice(["a", "bb", "Cé", "d1", "long-er", "x'y"])
    text = lambda n: "".join(word() + rnd.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([1, 2, 3, 5, 9, 14, 30])] + [(7, None), (8, "!?"), (0, text(4))]
    texts = [text(rnd.randint(0, 60)) for _ in range(40)] + [None, "", items[6][1] + text(20), text(9) + items[5][1]]
    find = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: find.findall((t or "").translate(FOLD))
    got = {r["doc_id"]: r for r in find_benchmark_words(docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string"), window=5,
                                                        block_bytes=block_bytes).collect()}
    for i, t in enumerate(texts):
        w, hit, names = words(t), set(), set()
        for name, it in items:
            v = words(it)
            k = min(5, len(v))
            for a in range(len(v) - k + 1 if v else 0):
                for b in range(len(w) - k + 1):
                    if w[b:b + k] == v[a:a + k]:
                        hit |= set(range(b, b + k))
                        names.add(str(name))
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == (len(w), len(hit), sorted(names))
        assert {x for r in got[i]["hits"] for x in range(r["start"], r["end"])} == hit


def test_long_texts_cross_lanes():
    rnd = random.Random(1)
    body = [f"w{rnd.randint(0, 5000)}" for _ in range(60_000)]
    item = " ".join(f"q{i}" for i in range(20))
    for at in (0, 700, 30_011, 59_999):
        text = " ".join(body[:at] + [item] + body[at:]).encode()
        out = Patterns([("7", item.encode())], 13).scan([b"x", text])
        assert out["hits"] == [[], [{"start": at, "end": at + 20}]] and out["items"][1] == ["7"]


# 2 ------------------------------------------------------------------------------------------------------------------

def test_targets_reshare_the_excess(spark):
    sizes = {"a": 100, "b": 10, "c": 400, "d": 0, None: 90}
    got = {r["source"]: r["target"] for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    w, t, free = dict(zip(["a", "b", "c", "d", None], [1, 2, 3, 1, 2])), {}, 600.0
    while True:
        open_ = [s for s in sizes if s not in t]
        over = [s for s in open_ if free * w[s] / sum(w[o] for o in open_) > 3 * sizes[s]]
        if not over:
            break
        t |= {s: 3.0 * sizes[s] for s in over}
        free = 600.0 - sum(t.values())
    t |= {s: free * w[s] / sum(w[o] for o in open_) for s in open_}
    assert got == pytest.approx(t)


def test_mix_has_its_size(spark):
    rnd = random.Random(5)
    texts = ["w " * rnd.randint(0, 50) for _ in range(3000)]
    plan = plan_mix(docs_of(spark, texts), slice_rows=100).toPandas()
    for _, g in plan.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 50
        assert (g["copies"] <= 3).all() and (g["taken"] == g["copies"] * g["size"]).all()
        assert (g["copies"] >= math.floor(g["target"].iloc[0] / g["source_size"].iloc[0])).all()


# 3 ------------------------------------------------------------------------------------------------------------------

def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = identify(docs).toPandas()
    held = got[got["held_out"] & got["lang"].notna()]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.97 and got["score"].between(0, 1).all()


def test_without_a_letter_or_a_model(spark):
    rows = identify(docs_of(spark, [None, "", "12 ?", "abc", "²½"]).drop("lang").selectExpr("*", "cast(null as string) lang")).collect()
    assert {r["lang_pred"] for r in rows} == {"und"}
    rows = identify(docs_of(spark, ["one two"] * 9 + ["x² ½", "²½ ①", "_ 7"])).collect()
    assert [r["lang_pred"] for r in sorted(rows, key=lambda r: r["doc_id"])[9:]] == ["en", "und", "und"]


# 4 ------------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("url, want", [
    ("https://Blog.Example.NET/en/1?x=/de/", ("blog.example.net", "/en/1", "example.net/en/", "allow")),
    ("http://a.net/x#y", ("a.net", "/x", "net/", "block")), ("http://a.net", ("a.net", "", None, None)),
    ("http://example.com/de/q", ("example.com", "/de/q", "example.com/de/", "block")), ("http://xexample.com/de/", ("xexample.com", "/de/", None, None)),
    ("http://m.example.org/fr/2", ("m.example.org", "/fr/2", "org/fr/", "allow")), ("a://b://c/d", ("b:", "//c/d", None, None)),
    ("http://h?q=/x", ("h", "", None, None)), ("no scheme/x", ("", "", None, None)), (None, ("", "", None, None)), ("", ("", "", None, None))])
def test_host_path_rule(spark, url, want):
    df = spark.createDataFrame([(url,)], "url string")
    h, p = host_and_path(df["url"])
    df = df.select(h.alias("h"), p.alias("p"))
    assert tuple(df.select("h", "p", *fitting_rule(df["h"], df["p"])).first()) == want


def test_models_follow_the_rules(spark):
    rnd = random.Random(2)
    part = lambda s: "".join(rnd.choice(s) for _ in range(8))
    rows = [(i, f"http://h{i}.org/fr/{part('abcdef')}" if i % 2 else f"http://h{i}.net/x/{part('uvwxyz')}") for i in range(200)]
    rows += [(1000 + i, f"http://h{i}.com/{part('abcdef') if i % 2 else part('uvwxyz')}") for i in range(60)]
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string")).where("page_id >= 1000").collect()
    assert sum((r["verdict"] == "allow") == bool(r["page_id"] % 2) for r in got) >= 55


# 5 ------------------------------------------------------------------------------------------------------------------

def _plain_print(t):
    w = re.findall("[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
    s = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    rnd = random.Random(4)
    texts = [None, "", " ", "One", "a b c", "É é\x0b\x1cx y  z"] + [" ".join(rnd.choice("abcdé") for _ in range(n)) for n in range(4, 40)]
    assert [simhash.fingerprint(t and t.encode()) for t in texts] == [_plain_print(t) for t in texts]


@pytest.mark.parametrize("most_in_cell", [2, 512])
def test_links_connect_what_is_near(spark, most_in_cell):
    rnd = random.Random(9)
    fps = {rnd.getrandbits(64) for _ in range(60)} | {0, 2 ** 64 - 1}
    for x in list(fps)[:12]:
        for _ in range(25):
            for b in rnd.sample(range(64), rnd.randint(0, 5)):
                x ^= 1 << b
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "_fp long")
    edges = simhash.links(df, 4, most_in_cell)
    pairs = edges.collect()
    # blocks of a crowded cell give edges of a spanning tree from its root; the others are links themselves
    assert most_in_cell == 2 or all(bin((a ^ b) & (2 ** 64 - 1)).count("1") <= 4 for a, b in pairs)
    root = {int(x): int(x) for x in fps.view(np.int64)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(fps.tolist(), 2):
        if bin(a ^ b).count("1") <= 4:
            i, j = sorted((find(int(np.uint64(a).astype(np.int64))), find(int(np.uint64(b).astype(np.int64)))))
            root[j] = i
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert {x: find(x) for x in root} == {x: got.get(x, x) for x in root}


def test_long_chain_is_one_component(spark):
    e = spark.range(400).selectExpr("id a", "id + 1 b")
    assert {r["root"] for r in simhash.components(e).collect()} == {0}


# 6 ------------------------------------------------------------------------------------------------------------------

def test_exact_groups(spark):
    rnd = random.Random(8)
    long = "".join(rnd.choice("ab é") for _ in range(5000))
    texts = [long, long + "x", long[:-1] + "y", long, long[:300], long[:300], " a", "a", "a ", "  a", None, "", "é" * 40, "é" * 40] + ["same"] * 30
    texts += ["z" * n for n in (31, 32, 33, 32, 287, 288, 289, 288)]
    got = {r["doc_id"]: r for r in exact_groups(docs_of(spark, texts), broadcast_rows=0).collect()}
    key = lambda t: re.sub("[\x20\x09-\x0D]+", " ", t or "")
    for i, t in enumerate(texts):
        same = [j for j, u in enumerate(texts) if key(u) == key(t)]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (same[0], len(same), i == same[0])


# 7 ------------------------------------------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0


def _plain_spans(t):
    out = []
    for k, p in BASE.items():
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 16 <= len(d) <= 19 and _luhn(d), "phone": 8 <= len(d) <= 15}[k]:
                out.append(f"{k}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans(spark):
    rnd = random.Random(6)
    bits = ["a@b.c", "@", ".", "x_y", "é", " ", "-", "+", "1", "255.", "256.", "0010.", "4111 1111 1111 1111", "+1 (212) 555-0100", "𝒳", "a@b.c_d@e.f", "\n", "00", "%"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14))) for _ in range(400)] + [None, "a" * 50_000, "1" * 50_000, "a@b" + ".c" * 20_000, "+1" + " " * 50_000, "a@b.c " * 20_000, "1.2.3.4 é" * 129]
    got = {r[0]: r[1] for r in find_personal_data(docs_of(spark, texts)).select("doc_id", listed("base")).collect()}
    assert {i: _plain_spans(t) for i, t in enumerate(texts)} == got


def test_method_adds_loose_spans_only_where_clear(spark):
    texts = [f"call me at phone +1 (212) 555-01{i:02d} today" for i in range(40)] + [f"phone: (212) 555-01{i:02d} today" for i in range(10)] + ["nothing 123 here"] * 10
    rows = find_personal_data(docs_of(spark, texts)).selectExpr("doc_id", "size(base) b", "size(spans) s").collect()
    assert all(r["s"] == 1 for r in rows if r["doc_id"] < 50) and all(r["s"] == 0 for r in rows if r["doc_id"] >= 50)


def test_reliabilities_are_found():
    counts = {(1, 1, 0): 80, (1, 1, 1): 20, (0, -1, 0): 90, (0, -1, -1): 10, (1, -1, 0): 3}
    post = expectation_maximisation(counts)
    assert post[(1, 1, 1)] > 0.9 and post[(0, -1, -1)] < 0.1


# 8 ------------------------------------------------------------------------------------------------------------------

def test_scores(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300").select("doc_id", "text")
    got = maxent.fit_and_score(docs, maxent.Shape(dictionary=2000)).toPandas()
    tokens = lambda t: re.findall("[^\x20\x09-\x0D]+", (t or "").translate(FOLD)) + [""]
    text = {r[0]: r[1] for r in docs.collect()}
    c = Counter(w for i, t in text.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    for r in got.itertuples():
        w = tokens(text[r.doc_id])
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(c[x] > 0 for x in w), n, zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
    held = got[got["held_out"]]
    assert held["score"].sum() > held["base_score"].sum() and (got["score"] < 0).all()


def test_probabilities_sum_to_one(spark):
    docs = docs_of(spark, ["a b a c", "b a a d e", "a c c b"] * 5)
    model, vocabulary = maxent.fit(docs, maxent.Shape(classes=3, width=2, class_bits=6, word_bits=6, dictionary=4))
    words = [r["w"] for r in vocabulary.collect() if r["w"]] + ["unseen"]
    # two tokens after the same first one: the text's probability over that of its beginning, summed over the second
    out = maxent.score(docs_of(spark, [f"a {w}" for w in words]), model, vocabulary).collect()
    reader = maxent.Reader(model)
    total = 0.0
    for r in out:
        _, size, first, rank, cls, f, g = reader.read([r["text"].encode()])
        lc, _, inner, lw, _ = maxent._probabilities(model, slice(0, 3), rank, cls, f, g)
        lp = lc.astype(float)
        lp[inner] += lw
        rest = {"c": None}
        if cls[1] == 2:
            n = next((x["c"] for x in vocabulary.collect() if x["w"] == r["text"].split()[1]), 0)
            lp[1] += math.log((n + 0.5) / model.rest_den)
        total += math.exp(lp[1])
    end = reader.read([b"a"])
    lc, _, inner, lw, _ = maxent._probabilities(model, slice(0, 2), *end[3:])
    lp = lc.astype(float)
    lp[inner] += lw
    if end[4][1] == 2:
        lp[1] += math.log((15 + 0.5) / model.rest_den)
    assert total + math.exp(lp[1]) == pytest.approx(1, abs=1e-4)


# 9 ------------------------------------------------------------------------------------------------------------------

def test_known_sentences_are_reachable(spark):
    every = [(s, i) for i, ss in SENTENCES.items() for s in ss]
    assert all(any(h in s for h in HINTS) for s, _ in every) and len({s for s, _ in every}) == len(every)
    assert all(i in SENTENCES for _, run in RULES for i in run.split())
    got = {r["doc_id"]: r["sentence_ids"] for r in scan_licences(docs_of(spark, [f"Intro. {s.upper()}.\nEnd" for s, _ in every])).collect()}
    assert got == {i: [e] for i, (_, e) in enumerate(every)}


def test_rules_in_order(spark):
    mit = "\n".join(s[0] + "." for i, s in SENTENCES.items() if i in ("mit-grant", "mit-notice", "mit-warranty", "mit-liability"))
    bsd = ("Redistribution and use in source and binary forms, with or without\tmodification, are permitted provided that the following conditions are met:\n"
           + SENTENCES["bsd-source"][0] + ".\n" + SENTENCES["bsd-binary"][0] + ".\nNeither the name of the Foo Inc. nor the names of its contributors may be used to "
           "endorse or promote products derived from this software without specific prior written permission.")
    texts = [mit, bsd, mit + "\n" + bsd, SENTENCES["mit-notice"][0], "Released under the MIT License. All rights reserved.", None, "This licence is fine."]
    got = {r["doc_id"]: (r["licences"], r["unresolved"]) for r in scan_licences(docs_of(spark, texts)).collect()}
    assert got == {0: (["MIT"], []), 1: (["BSD-3-Clause"], []), 2: (["BSD-3-Clause", "MIT"], []), 3: ([], ["mit-notice"]), 4: (["MIT"], ["arr"]), 5: ([], []), 6: ([], [])}


# 10 -----------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("few", [50_000, 5])
def test_shards_are_even(spark, few):
    rnd = random.Random(11)
    texts = ["same text of a hot group"] * 400 + ["x" * rnd.randint(0, 60) for _ in range(700)] + [None, ""]
    got = kd_shards(docs_of(spark, texts), shards=7, few=few).toPandas()
    by = got.groupby("shard")["size"].sum()
    assert len(by) == 7 and by.max() - by.min() <= 4 * 62
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert all(r.size == len((texts[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in got.itertuples())
    by_text = got[got["text"].notna()].groupby("text")["shard"].nunique()
    assert (by_text > 1).sum() <= 6                                  # only the groups that lie at a cut


def test_target_bytes(spark):
    got = kd_shards(docs_of(spark, ["y" * 99] * 40), target_bytes=1000).toPandas()
    assert got["shard"].nunique() == 4 and set(got.groupby("shard")["size"].sum()) == {1000}
