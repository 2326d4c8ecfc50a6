"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from kmeridian.llm import bpe_codec, embedding_join, ngram_join, quality, token_counts, toxicity

LONG = " ".join(f"w{i % 977}" for i in range(60000))
ROWS = [(1, None), (2, ""), (3, " \n\t"), (None, "x y"), (4, LONG), (4, LONG), (5, "é <|endoftext|> ok")]


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("score", "_y", "_x", "_order", "_counted", "_b", "ids", "key", "sig", "a.b")})


def labelled(spark):
    rows = [(i, "good plain words here " * 5 + f"n{i}" if i % 2 else "vile! ### " * 9 + f"n{i}") for i in range(40)]
    rows += [(100, LONG), (100, LONG + " x"), (101, None), (None, "good")]  # an id on two texts, a null text, no id
    marks = [(i, i % 2, 1 - i % 2) for i in range(40)] + [(100, 1, 0), (101, 1, 0), (3, 0, 1), (None, 1, 1), (7, None, None)]  # 3: conflicting
    return docs(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_classifiers(spark):
    train, marks = labelled(spark)
    models = [(toxicity, toxicity.fit(train, marks, 4, 2)), (quality, quality.fit(train, marks, 5, 0))]
    again = [toxicity.fit(train.repartition(7), marks, 4, 2), quality.fit(train.repartition(7), marks, 5, 0)]
    assert (again[0][0] == models[0][1][0]).all() and np.allclose(again[0][1], models[0][1][1]) and np.allclose(again[1]["w"], models[1][1]["w"])
    for module, model in models:
        out = module.score(docs(spark), model)
        assert out.columns == docs(spark).columns  # the score replaces a column of its name, others stay
        got = out.collect()
        assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 and r["_y"] == "_y" and r["a.b"] == "a.b" for r in got)
        by = Counter((r["doc_id"], r["score"]) for r in got)
        assert max(by.values()) == 2 and len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1
        assert module.score(docs(spark).limit(0), model).count() == 0
    assert quality.fit(train, marks.where("quality = 1"), 5, 0) is None and len(toxicity.fit(train, marks.limit(0), 4, 2)[0]) == 0


def test_tokens(spark):
    out = bpe_codec.encode(docs(spark), into="tokens")
    assert out.columns == [*docs(spark).columns, "tokens"] and out.where("ids <> 'ids'").count() == 0
    assert {r["doc_id"]: len(r["tokens"]) for r in out.collect()}[1] == 0
    counted = token_counts.token_counts(docs(spark)).collect()
    assert len(counted) == len(ROWS) and {r["doc_id"]: r["n_tokens"] for r in counted}[2] == 0 and token_counts.token_counts(docs(spark).limit(0)).count() == 0


def test_ngram_threshold_and_long_texts(spark):
    words = [f"t{i}" for i in range(1000)]
    nine = " ".join(words[:13])  # nine shingles
    # eight of the ten in the union: at the threshold; then just below it
    at = (" ".join(words[:12]) + " z1", " ".join(words[:12]) + " z2")
    below = (" ".join(words[100:111]) + " z3", " ".join(words[100:111]) + " z4")
    far = LONG.replace("w5 ", "q5 ")
    rows = [(10, at[0]), (11, at[1]), (20, below[0]), (21, below[1]), (30, LONG), (31, LONG + " tail"), (32, far), (40, nine.upper()), (40, nine)]
    got = Counter((r["doc_id"], r["component_id"]) for r in ngram_join.components_of(docs(spark, rows)).collect())
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, t in rows if (w := t.lower().split())}
    link = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    assert link(10, 11) and not link(20, 21) and link(30, 31)
    comp = {d: c for d, c in got}
    assert comp[11] == 10 and comp[21] == 21 and comp[31] == 30 and (comp[32] == 30) == link(30, 32) and got[40, comp[40]] == 2
    out = ngram_join.one_of_each(docs(spark, rows))
    assert out.columns == docs(spark).columns and out.where("key <> 'key' or sig <> 'sig'").count() == 0
    assert ngram_join.components_of(docs(spark).limit(0)).count() == 0


def test_vectors_at_the_threshold(spark):
    x, y = np.zeros(64), np.zeros(64)
    x[0], y[0], y[1] = 1.0, 0.93, (1 - 0.93**2) ** 0.5
    below = np.zeros(64)
    below[0], below[1] = 0.9299, (1 - 0.9299**2) ** 0.5
    unit = lambda v: v / np.linalg.norm(v)
    vectors = [(1, x * 5, "a"), (2, y, "a"), (3, below, "a"), (4, x, "b"), (5, x * 1e-300, "a"), (6, x * 1e300, "a"), (None, x, "a")]
    cosine = lambda a, b: float((unit(a / np.abs(a).max()) * unit(b / np.abs(b).max())).sum())
    df = spark.createDataFrame([(i, v.tolist(), label) for i, v, label in vectors], "vec_id long, embedding array<double>, label string").withColumns({"key": F.lit("k"), "raw": F.lit(1)})
    got = {r["vec_id"]: r for r in embedding_join.linked(df).collect()}
    want = {v[0]: sum(a != b and vectors[b][2] == v[2] and cosine(v[1], vectors[b][1]) >= 0.93 for b in range(len(vectors))) for a, v in enumerate(vectors)}
    assert {i: r["n_links"] for i, r in got.items()} == want
    assert got[4]["component_id"] == 4 and got[5]["component_id"] == 1 and got[3]["kept"] == (got[3]["component_id"] == 3)
    assert embedding_join.linked(df.limit(0)).count() == 0
