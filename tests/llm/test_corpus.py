import hashlib
import json
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kmeridian.llm import bpe_codec, chat, embedding_join, mixing, ngram_join, quality, token_counts, toxicity
from kmeridian.llm.components import components

ODD = [(1, None, "en", "a", 0), (2, "", None, None, 0), (3, "  \n ", "en", "a", 3), (None, "x y", "en", "a", 3), (4, "word " * 30000, "de", "b", 1), (4, "word " * 30000, "de", "b", 1), (5, "é <|endoftext|> a@b.co 1.2.3.4", "fr", "b", 9)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_token_counts_equal_library(odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((d, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for d, x, *_ in ODD)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(odd).collect()) == want
    assert token_counts.token_counts(none).count() == 0


def test_codec_equals_library(odd, none):
    import public_tokenizers
    import tiktoken

    ranks = bpe_codec.read_ranks(public_tokenizers.path(bpe_codec.RANKS))
    lib = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [x or "" for _, x, *_ in ODD] + ["a  b\n\n c's", "日本語" * 50, "=-" * 500, " lead", "tail ", "\x1c \x85"]
    codec = bpe_codec.Codec(ranks, public_tokenizers.PATTERN)
    for x in texts:
        ids = codec.encode(x)
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode_ordinary(x) and codec.decode(ids) == x.encode()
    assert bpe_codec.decode(bpe_codec.encode(odd)).where("decoded <> cast(coalesce(text, '') as binary)").count() == 0
    assert bpe_codec.digests(none).count() == 0


def test_mixing(spark, odd, none):
    assert mixing.targets({"a": 10, "b": 100, "c": 100}) == {"a": 30.0, "b": 120.0, "c": 60.0}
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "en", "abc"[i % 3] if i % 10 else None, 0) for i in range(600)], DOCS)
    rows = mixing.mixed(docs).collect()
    assert {(r["doc_id"], r["taken"]) for r in rows} == {(r["doc_id"], r["taken"]) for r in mixing.mixed(docs.repartition(7)).collect()}
    by = defaultdict(lambda: [0, 0.0])
    for r in rows:
        assert r["taken"] <= 3 * r["size"] and r["taken"] % r["size"] == 0
        source = "abc"[r["doc_id"] % 3] if r["doc_id"] % 10 else None
        by[source][0] += r["taken"]
        by[source][1] = r["target"]
    assert all(abs(t - want) <= 14 for t, want in by.values())
    clashing = docs.withColumns({c: F.lit(c) for c in ("key", "h", "id", "rounds", "target", "a.b")})
    mix = mixing.repeated(clashing)
    assert mix.columns == clashing.columns and mix.where("key <> 'key' or h <> 'h' or rounds <> 'rounds'").count() == 0
    assert Counter(r["doc_id"] for r in mix.collect()) == Counter({r["doc_id"]: r["taken"] // r["size"] for r in rows})
    assert mixing.mixed(odd).count() == len(ODD) and mixing.mixed(none).count() == 0 and mixing.repeated(none).count() == 0


def test_mixing_of_rows_without_ids_and_of_equal_rows(spark):
    rows = [(None, f"w{i} " * 3, "en", "a", 0) for i in range(90)] + [(7, "same text here", "en", "b", 0)] * 90 + [(i, "x y z", "en", "c", 0) for i in range(90)]
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.mixed(docs).collect()
    taken = defaultdict(int)
    for r in out:
        taken[r["target"]] += r["taken"]
    want = mixing.targets({"sa": 270, "sb": 270, "sc": 270})
    assert len(out) == 270 and all(abs(t - target) <= 6 for target, t in taken.items()) and set(taken) == set(want.values())
    by_source = Counter(r["source"] for r in mixing.repeated(docs).collect())
    assert all(abs(3 * by_source[s] - want["s" + s]) <= 6 for s in "abc")


def test_targets_by_rounds():
    """Against filling all sources that are over their limit at once, round after round."""
    rng = np.random.default_rng(2)
    for _ in range(200):
        sizes = {f"s{i}": int(rng.integers(0, 10 ** int(rng.integers(1, 6)))) for i in range(int(rng.integers(1, 12)))}
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
        left, open_, want = sum(sizes.values()), set(sizes), {}
        while open_:
            total = sum(weight[s] for s in open_)
            full = {s for s in open_ if weight[s] * left > 3 * sizes[s] * total}
            for s in full or open_:
                want[s] = float(3 * sizes[s]) if full else weight[s] * left / total
            left -= sum(3 * sizes[s] for s in full)
            open_ = open_ - full if full else set()
        assert mixing.targets(sizes) == want


def test_chat_round_trip(spark):
    for record in ({"prompt": "a<|turn|>", "response": "\\b</s>[INST]"}, {"instruction": "i", "input": "", "output": "<"}, {"system": "s", "messages": [{"role": "user", "content": "<\\|x"}]}, {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}):
        turns = chat.canonical(record)
        text, mask = chat.render(turns)
        assert chat.parse(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in mask] == [t for r, t in turns if r == "assistant"]
    for record in ({"unknown": 1}, {"messages": "x"}, {"messages": [None]}, {"messages": ["x"]}, {"messages": [{"role": 1, "content": "x"}]}, {"prompt": ["x"], "response": "y"}, {"prompt": "x", "response": "y", "extra": 1}, []):
        with pytest.raises(ValueError):
            chat.canonical(record)
    long = "[INST]\\" * 40000
    records = [(1, json.dumps({"messages": [{"role": "human", "content": long}, {"role": "gpt", "content": "g"}]})), (2, '{"a": 1}'), (3, "no json"), (4, None), (5, '{"messages": []}'), (6, '{"conversations": [{"from": "gpt", "value": null}]}'), (None, '"x"')]
    done = chat.formatted(spark.createDataFrame(records, "`a.b` long, record string"), keep=("a.b",))
    by = {r["a.b"]: r for r in done.collect()}
    assert [by[i]["problem"] is None for i in (1, 2, 3, 4, 5, 6, None)] == [True, False, False, True, True, True, False]
    assert chat.parse(by[1]["formatted"]) == [("human", long), ("gpt", "g")] and by[1]["mask"] == [] and by[4]["formatted"] == by[5]["formatted"] == ""
    assert chat.parse(by[6]["formatted"]) == [("assistant", "")] and by[2]["formatted"] is None and by[2]["mask"] is None
    back = {r["a.b"]: r["n_turns"] for r in chat.read_back(done, keep=("a.b",)).collect()}
    assert back == {1: 2, 2: None, 3: None, 4: 0, 5: 0, 6: 1, None: None}
    assert chat.formatted(spark.createDataFrame([], "record string")).count() == 0
    rows = spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (None, None, None, "t")], "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat.read_back(chat.formatted(chat.records_of(rows), keep=("conv_id",))).collect()}
    assert out[1]["n_turns"] == 3 and out[1]["loss_chars"] == 2
    assert out[1]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\nx\nassistant\nx\n").hexdigest()
    assert chat.fingerprint({"b": 1, "a": 2}) == chat.fingerprint(json.loads('{"a": "x", "b": null}'))


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (200, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)}


def brute_components(rows):
    sets = []
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())))
    up = {d: d for d, _ in sets}
    changed = True
    while changed:
        changed = False
        for d, s in sets:
            for e, r in sets:
                if s and r and 100 * len(s & r) >= 80 * len(s | r) and up[d] != up[e]:
                    up[d] = up[e] = min(up[d], up[e])
                    changed = True
    return {d: (len(s), up[d]) for d, s in sets}


@pytest.mark.parametrize("tile", [2000, 3])
def test_ngram_join(spark, none, tile, monkeypatch):
    monkeypatch.setattr(ngram_join, "STAR", tile)
    monkeypatch.setattr(ngram_join.classes, "__defaults__", (5, 80, tile))
    rng = np.random.default_rng(8)
    rows, common = [], " ".join(f"lic{i}" for i in range(40))
    for g in range(12):
        base = [f"g{g}w{x}" for x in rng.integers(0, 400, 150)]
        for v in range(int(rng.integers(1, 9))):
            w = list(base)
            for at in rng.integers(0, 150, int(rng.integers(0, 6))):
                w[at] = f"z{rng.integers(1000)}"
            rows.append((len(rows), " ".join(w) + (" " + common if g % 2 else "")))
    rows += [(900, None), (901, ""), (902, "one two"), (903, "ONE  two"), (904, rows[0][1])]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.components_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)
    if tile == 2000:
        assert ngram_join.components_of(none).count() == 0
        kept = ngram_join.one_of_each(spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows + rows[:3]], DOCS)).select("doc_id").collect()
        assert sorted(r[0] for r in kept) == sorted(d for d, (n, c) in got.items() if d == c)


@pytest.mark.parametrize("tile", [4000, 7])
def test_embedding_join(spark, tile):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((120, 64)).astype("f4")
    x[60:90] = x[:30] + 0.25 * rng.standard_normal((30, 64)).astype("f4")
    x[90:100] = x[5]
    rows = [(i, v.tolist(), int(i % 3 == 0)) for i, v in enumerate(x)]
    rows += [(200, None, 0), (201, [0.0] * 64, 0), (202, [float("nan")] * 64, 0), (203, x[1].tolist(), None), (204, [1.0, None], 1), (205, [1.0] * 3, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_join.linked(df, tile=tile).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & ((np.arange(120)[:, None] % 3 == 0) == (np.arange(120)[None] % 3 == 0))
    np.fill_diagonal(near, False)
    root = np.arange(120)
    for _ in range(120):
        root = np.array([min(root[i], *root[near[i]]) if near[i].any() else root[i] for i in range(120)])
    assert {i: got[i] for i in range(120)} == {i: (int(near[i].sum()), int(root[i])) for i in range(120)}
    assert all(got[i] == (0, i) for i in range(200, 206)) and near.any()


def test_classifiers_on_held_out_rows(spark, none):
    rng = np.random.default_rng(10)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(500):
        w, bad = list(rng.choice(words, 60)), int(i % 5 == 0)
        if bad:
            w[int(rng.integers(60))] = "vile"
            w[int(rng.integers(60))] = "nasty!"
        rows.append((i, " ".join(x + ("%%%" if bad else "") for x in w), "en", "s", 0))
        labels.append((i, bad, 1 - bad))
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    t = toxicity.score(docs, toxicity.fit(docs, marks, 4, 2)).toPandas()
    q = quality.score(docs, quality.fit(docs, marks, 5, 0)).toPandas()
    assert ((t.score >= 0.3) == (t.doc_id % 5 == 0)).mean() > 0.98
    assert ((q.score >= 0.3) == (q.doc_id % 5 != 0)).mean() > 0.98
    assert isinstance(t, pd.DataFrame) and toxicity.fit(none, marks, 4, 2)[0].size == 0 and quality.fit(none, marks, 5, 0) is None
    assert quality.score(spark.createDataFrame(ODD, DOCS), None).count() == len(ODD)
    assert toxicity.score(spark.createDataFrame(ODD, DOCS), toxicity.fit(docs, marks, 4, 2)).where("score is null").count() == 0
