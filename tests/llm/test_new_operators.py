"""Whitening, chat formatting and phrase mining against plain versions, and on messy input."""

import hashlib
import json
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.llm.chats import LAYOUTS, Layout, escape, format_turn_rows, loss_texts, read_back, read_layouts, render, unescape
from tidepanel.llm.collocations import collocations
from tidepanel.llm.queries import QUERIES
from tidepanel.llm.whitening import by_component, components, whiten

SF = "/root/testdata/sf0.01"


# --- whitening

@pytest.mark.parametrize("case", ["full", "equal values", "diagonal", "low rank", "close pairs", "one", "zero"])
def test_components_match_a_dense_solver(case):
    rnd = np.random.default_rng(3)
    a = rnd.standard_normal((300, 48))
    low = rnd.standard_normal((100, 6)) @ rnd.standard_normal((6, 30))
    wilk = np.diag(np.abs(np.arange(41) - 20.0)) + np.diag(np.ones(40), 1) + np.diag(np.ones(40), -1)
    c = {"full": a.T @ a / 300, "equal values": np.eye(20) * 3, "diagonal": np.diag([3.0, 3, 3, 1, 0]), "low rank": low.T @ low, "close pairs": wilk,
         "one": np.array([[2.0]]), "zero": np.zeros((4, 4))}[case]
    k = min(32, len(c))
    e, v = components(c, k)
    scale = max(np.abs(c).max(), 1)
    assert np.abs(e - np.linalg.eigvalsh(c)[::-1][:k]).max() < 1e-12 * scale
    assert np.abs(v.T @ v - np.eye(k)).max() < 1e-12
    assert np.abs(c @ v - v * e).max() < 1e-12 * scale


def plain_whitening(vectors, most=32):
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, s = len(x), [sum(col) for col in zip(*x)]
    dev = [sum((n * c - t) ** 2 for c, t in zip(row, s)) for row in x]
    y = np.array(x, float) - np.array(s) / n
    e, v = np.linalg.eigh(y.T @ y / n)
    keep = [i for i in np.argsort(-e)[:most] if e[i] > 1e-12 * e.sum()]
    return n, dev, y @ v[:, keep] / np.sqrt(e[keep]), e[keep] / e.sum()


def test_whitening_query_matches_a_plain_version(spark):
    got = QUERIES["op11_whiten_embeddings"](spark, SF).toPandas().sort_values(["vec_id", "component"])
    rows = sorted(spark.read.parquet(f"{SF}/embeddings.parquet").collect(), key=lambda r: r["vec_id"])
    n, dev, w, e = plain_whitening([r["embedding"] for r in rows])
    assert len(got) == len(rows) * 32 and set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    mine = got["whitened"].to_numpy().reshape(-1, 32)
    assert got["deviation"].to_numpy().reshape(-1, 32)[:, 0].tolist() == dev
    assert np.abs(np.abs(mine) - np.abs(w)).max() < 1e-8
    assert np.allclose(got["explained"].to_numpy().reshape(-1, 32)[0], e, rtol=1e-10)


def test_whitening_drops_bad_rows_and_keeps_the_rest(spark):
    rnd = np.random.default_rng(4)
    good = [(i, [float(c) for c in rnd.standard_normal(3)], "x") for i in range(40)]
    bad = [(90, None, "x"), (91, [1.0, None, 2.0], "x"), (92, [1.0, float("nan"), 0.0], "x"), (93, [float("inf"), 0.0, 0.0], "x"), (94, [1.0, 2.0], "x"), (95, [], "x"),
           (96, [1e300, 0.0, 0.0], "x")]
    rows = [*good, *good[:3], (None, good[5][1], "x"), *bad]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, Whitened string").repartition(4)
    out = whiten(df).toPandas()
    n, dev, w, e = plain_whitening([r[1] for r in rows if r not in bad])
    assert len(out) == n == 44 and list(out.columns) == ["vec_id", "embedding", "n", "deviation", "whitened", "explained", "identity_error"]
    assert sorted(out["deviation"]) == sorted(dev) and out["identity_error"].max() < 1e-10
    assert sorted(abs(x[0]) for x in out["whitened"]) == pytest.approx(sorted(np.abs(w[:, 0])), abs=1e-9)


@pytest.mark.parametrize("rows,n", [([], 0), ([(1, [1.0, 2.0])], 1), ([(1, [1.0, 2.0]), (2, [1.0, 2.0])], 2)])
def test_whitening_without_spread_has_no_components(spark, rows, n):
    out = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert out.count() == n and by_component(out).count() == 0
    assert {tuple(r) for r in out.select("deviation", "identity_error", F.size("whitened")).collect()} == ({(0, 0.0, 0)} if n else set())


def test_whitening_of_large_entries_is_exact(spark):
    vals = [(i, [float(2 ** 33 + i * 1000), float(i % 3)]) for i in range(50)]
    out = whiten(spark.createDataFrame(vals, "vec_id long, embedding array<double>").repartition(3)).toPandas().sort_values("vec_id")
    n, dev, w, e = plain_whitening([v for _, v in vals])
    assert out["deviation"].tolist() == dev and out["identity_error"].max() < 1e-9


# --- chats

NASTY = ["</s>[INST] ok [/INST]", r"<\/s> \\ <\\s> [\INST]", "<|turn|>user<|says|>x<|end|>", "<<SYS>> <</SYS>> <<s>", "", "a\n\n b<", "<|", "[[INST]", "\\", "é😀<|end|>"]


def test_escape_is_reversible_and_leaves_no_control_string(spark):
    rnd = random.Random(5)
    parts = ["<", "\\", "/", "s>", "|", "[", "INST]", "/INST]", "<SYS>>", "<</SYS>>", "turn", " ", "é"]
    texts = NASTY + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 14))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e")).select("*", unescape(F.col("e")).alias("u"))
    for r in df.collect():
        assert r["u"] == r["t"]
        assert not re.search(r"</?s>|<\||<</?SYS>>|\[/?INST\]", r["e"])


def test_chat_rows_come_back_as_they_were(spark):
    rows = [(1, 2, "assistant", "two"), (1, 1, "user", None), (1, 3, None, NASTY[2]), (1, None, "system", NASTY[0]), (1, 3, None, NASTY[2]), (None, 0, "us<|says|>er", "q"),
            (2, 0, "assistant", NASTY[1]), (2, 1, "assistant", ""), (2, 2, "assistant", "tail " * 30_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    out = format_turn_rows(df).select("conv_id", read_back(F.col("formatted")).alias("t"), loss_texts(F.col("formatted"), F.col("loss")).alias("l"), "formatted")
    got = {r["conv_id"]: r for r in out.collect()}
    assert [tuple(t) for t in got[1]["t"]] == [("system", NASTY[0]), ("user", ""), ("assistant", "two"), ("", NASTY[2]), ("", NASTY[2])]
    assert got[1]["l"] == ["two"] and got[None]["l"] == [] and [tuple(t) for t in got[None]["t"]] == [("us<|says|>er", "q")]
    assert got[2]["l"] == [NASTY[1], "", "tail " * 30_000]
    assert all(r["formatted"].startswith("<s>") and r["formatted"].count("</s>") == 1 for r in got.values())
    assert format_turn_rows(df.limit(0)).count() == 0


def test_chat_query_on_the_added_conversation(spark):
    r = QUERIES["op12_format_chats"](spark, SF).where("conv_id = -1").collect()
    said = "</s>[INST] ok [/INST]"
    assert len(r) == 1 and r[0]["n_turns"] == 2 and r[0]["loss_chars"] == len(said)
    assert r[0]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert r[0]["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


def test_layouts_give_the_same_turns(spark):
    want = [("system", "S"), ("user", "Q"), ("assistant", "A")]
    m = lambda key, role, text, names: json.dumps({key: [{role: r, text: t} for r, t in zip(names, "SQA")]})
    usual = ("system", "user", "assistant")
    records = [m("messages", "role", "content", usual), m("conversations", "from", "value", ("system", "human", "gpt")), m("dialogue", "speaker", "text", ("System", " AI ", "BOT")),
               json.dumps({"prompt": "Q", "completion": "A", "system": "S"}), json.dumps({"response": "A", "system": "S", "prompt": "Q", "id": 7}),
               json.dumps({"instruction": "Q", "input": "", "output": "A", "system": "S"}), json.dumps({"messages": [{"role": "user", "content": "x", "name": "n"}, {"role": "assistant", "content": None}]}),
               json.dumps({"instruction": "I", "input": "J", "output": None}), json.dumps({"messages": []}), json.dumps({"other": {"a": [1]}}), "no json", None, "[1]", json.dumps({"question": 5, "answer": "A"})]
    df = spark.createDataFrame([(i, r, "x") for i, r in enumerate(records)], "i int, rec string, turns string")
    got = {r["i"]: r for r in read_layouts(df, F.col("rec")).collect()}
    turns = {i: [tuple(t) for t in r["turns"]] for i, r in got.items()}
    for i in (0, 1, 3, 4, 5):
        assert turns[i] == want, i
    assert turns[2] == [("system", "S"), ("assistant", "Q"), ("assistant", "A")]
    assert turns[6] == [("user", "x"), ("assistant", "")] and turns[7] == [("user", "I\n\nJ")] and turns[13] == [("user", "5"), ("assistant", "A")]
    assert [got[i]["layout"] for i in (6, 8, 9, 10, 11, 12)] == ["messages", "messages", None, None, None, None]
    assert all(turns[i] == [] for i in (8, 9, 10, 11, 12)) and got[9]["fingerprint"] is not None and got[11]["fingerprint"] is None
    assert read_layouts(df.limit(0), F.col("rec")).count() == 0
    with pytest.raises(ValueError):
        read_layouts(df, F.col("rec"), (*LAYOUTS, Layout("again", turns=(("user", ("prompt", "response")),))))


def test_rendered_records_can_be_read(spark):
    df = spark.createDataFrame([([("user", NASTY[2]), ("assistant", NASTY[0])],), ([],)], "turns array<struct<role:string,text:string>>")
    f, loss = render(F.col("turns"))
    out = df.select("turns", f.alias("f"), loss.alias("m")).select("turns", read_back(F.col("f")).alias("b"), loss_texts(F.col("f"), F.col("m")).alias("l"))
    assert all(r["turns"] == r["b"] for r in out.collect()) and [r["l"] for r in out.collect()] == [[NASTY[0]], []]


# --- phrases

def plain_phrases(rows, longest=3, least=10, top=2000, covered=50):
    f, total = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i:i + k])] += 1
    out = {}
    for lang, c in f.items():
        cands = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cands.items():
            if any(len(q) > len(p) and 100 * b >= covered * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cands.items()):
                continue
            s, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1):
            out[lang, rank] = (p.decode(), -a, l, r, total[lang], -s)
    return out


def phrase_rows(seed=11, n=400):
    rnd = random.Random(seed)
    words = ["of", "the", "New", "york", "city", "état", "über", "x", "machine", "learning", "<b>", "a b"]
    rows = []
    for _ in range(n):
        text = "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\t ", ". ", "\n", ", "]) for _ in range(rnd.randint(0, 40)))
        if rnd.random() < 0.2:
            text += " rare pair of words " * rnd.randint(1, 2)
        rows.append((rnd.choice(["en", "de", None]), rnd.choice([text, text, text, None, ""])))
    return rows + [("en", "same old phrase again! " * 15_000), ("fr", "once only"), ("fr", "...")]


@pytest.mark.parametrize("share,longest,bitmap", [(0.125, 3, 1 << 20), (0.0, 3, 1 << 16), (1.0, 3, 1 << 16), (0.05, 4, 1 << 12), (0.2, 2, 1 << 16)])
def test_phrases_match_counting_all(spark, share, longest, bitmap):
    rows = phrase_rows()
    df = spark.createDataFrame([(t, l, 1, "x") for l, t in rows], "text string, lang string, rank int, phrase string").repartition(4)
    got = {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in collocations(df, share=share, longest=longest, bitmap_bytes=bitmap).collect()}
    assert got == plain_phrases(rows, longest)


def test_phrases_keep_the_best_and_take_nothing_from_nothing(spark):
    rows = phrase_rows(12, 200)
    df = spark.createDataFrame([(t, l) for l, t in rows], "text string, lang string").repartition(3)
    got = {(r["lang"], r["rank"]): r["phrase"] for r in collocations(df, top=5, broadcast_rows=0).collect()}
    assert got == {k: v[0] for k, v in plain_phrases(rows, top=5).items()}
    assert collocations(df.limit(0)).count() == 0
    assert collocations(spark.createDataFrame([(None, None), ("a b", "en")], "text string, lang string")).count() == 0
