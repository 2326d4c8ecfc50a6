"""The pipeline's stages and their chain against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_corpus import brute_components
from test_rules_pii import brute_counts, brute_spans

import corpus_pipeline
from kmeridian.llm import mixing, quality_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, key string, row int"
KEY = "0123456789abcdef0123456789abcdef01234567"


def corpus():
    rng = np.random.default_rng(21)
    word = lambda: "".join(rng.choice(list("abcdefghij"), int(rng.integers(3, 8))))
    rows = [(i, " ".join(word() for _ in range(int(rng.integers(55, 90)))), "en", "abc"[i % 3]) for i in range(260)]
    for i in range(0, 60, 5):  # near and exact copies
        rows.append((300 + i, rows[i][1] + " " + word(), "en", "a"))
        rows.append((400 + i, rows[i][1], "en", "b"))
    rows += [(500 + i, " ".join(word() + "###" for _ in range(70)), "en", "c") for i in range(30)]  # labelled bad
    rows += [(600 + i, " ".join(word() for _ in range(60)) + f' x@y{i}.zz 1.2.3.4 +49 30 1234567 token = "{KEY}" ', "en", None) for i in range(12)]
    rows += [(700, None, "en", "a"), (701, "", "en", "a"), (702, "short text", "de", "b"), (703, "w " * 40000, "de", "b"), (None, " ".join(word() for _ in range(70)), None, "c"), (5, " ".join(word() for _ in range(70)), "fr", "a")]
    labels = [(i, 1, 0) for i in range(260) if i != 5] + [(500 + i, 0, 0) for i in range(30)]
    return [(*r, len(r[1] or ""), "x", "k", 7) for r in rows], labels


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pipeline"))
    rows, labels = corpus()
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def plain_rules(rows):
    """With evidence for one language, symbols are cut at the laxest of the grid that parts all; nothing else parts."""
    out = []
    for r in rows:
        n_words, chars, symbols, dup, repeats, lines = brute_counts(r[1])
        if n_words >= 50 and 2 * repeats <= n_words and not (r[2] == "en" and symbols / max(1, n_words) > 1.0):
            out.append(r)
    return out


def plain_duplicates(rows):
    texts = [(i, r[1]) for i, r in enumerate(rows)]
    of = {i: c for i, (_, c) in brute_components(texts).items()}
    kept = {}
    for i, r in enumerate(rows):
        at = (r[0] is None, r[0] if r[0] is not None else 0)
        if of[i] not in kept or at < kept[of[i]][0]:
            kept[of[i]] = (at, r)
    return [r for _, r in kept.values()]


def plain_masking(rows):
    """Base spans by the contract's patterns, and keys that follow the word token."""
    out = []
    for r in rows:
        text = r[1]
        spans = [(int(a), int(b), k.upper()) for k, a, b in (s.split(":") for s in brute_spans(text))] + [(m.start(1), m.end(1), "SECRET") for m in re.finditer(rf'token = "({KEY})"', text or "")]
        for a, b, k in sorted(spans, reverse=True):
            text = text[:a] + f"<{k}>" + text[b:]
        out.append((r[0], text, *r[2:]))
    return out


def plain_mix(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = defaultdict(list)
    for i, r in enumerate(rows):
        text = hashlib.md5(r[1].encode()).hexdigest() if r[1] is not None else ""
        name = "" if r[0] is None else str(r[0])
        by["t" if r[3] is None else "s" + r[3]].append((hashlib.md5(f"mix-1:{name}:{text}".encode()).hexdigest(), name, i, size(r[1])))
    totals = {s: sum(q[3] for q in x) for s, x in by.items()}
    target, queue = mixing.targets(totals), []
    for s, x in by.items():
        served = 0
        for h, name, i, n in sorted(x):
            served += n
            queue += [((e * totals[s] + served) / target[s], s, h, name, e, i, n) for e in range(3)]
    out, run = [], 0
    for *_, i, n in sorted(queue):
        run += n
        if run <= sum(totals.values()):
            out.append(rows[i])
    return out


def plain_ids(rows):
    import public_tokenizers
    import tiktoken

    from kmeridian.llm import bpe_codec

    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_codec.read_ranks(public_tokenizers.path(bpe_codec.RANKS)), special_tokens={})
    return [(r[0], r[3], len(ids := library.encode_ordinary(r[1] or "")), tuple(ids)) for r in rows]


PLAIN = {"quality_rules": plain_rules, "near_duplicates": plain_duplicates, "pii": plain_masking, "mixing": plain_mix, "bpe_encoding": plain_ids}


def test_every_stage_and_the_chain(spark, tables):
    folder, rows = tables
    assert [n for n, _ in corpus_pipeline.STAGES] == list(PLAIN)
    for name, stage in corpus_pipeline.STAGES:
        df = spark.createDataFrame(rows, DOCS).repartition(4)
        got = stage(spark, df, folder)
        want = PLAIN[name](rows)
        if name != "bpe_encoding":
            assert got.columns == df.columns
        assert Counter(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in got.collect()) == Counter(want), name
        rows = want
    final = [(r["doc_id"], r["source"], r["n_tokens"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, folder).collect()]
    assert Counter(final) == Counter(rows) and len(final) > 200


def test_stages_on_odd_and_empty_tables(spark, tables):
    folder, rows = tables
    odd = [r for r in rows if r[0] is None or r[0] >= 600 or r[0] == 5] * 2 + [(None, None, None, None, None, None, None, None)] * 2
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, spark.createDataFrame(odd, DOCS), folder)
        n = got.count()
        assert stage(spark, spark.createDataFrame([], DOCS), folder).count() == 0
        if name == "near_duplicates":
            distinct = {(r[0], r[1]) for r in odd}
            assert n == len(distinct)
        elif name in ("pii", "bpe_encoding"):
            assert n == len(odd)


def test_rules_see_every_label(spark, tables):
    folder, rows = tables
    cutoffs = quality_rules.fit(quality_rules.measured(spark.createDataFrame(rows, DOCS)), spark.read.parquet(f"{folder}/labels.parquet"))
    assert cutoffs["symbols"] == [("en", 1.0)] and not cutoffs["dup_lines"] and not cutoffs["repeats"] and {s for s, _ in cutoffs["word_chars"]} <= {"en"}
