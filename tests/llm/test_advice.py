import numpy as np
import pytest

from kmeridian.llm import embedding_join, ngram_join
from kmeridian.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_one_row_of_each_component_with_repeated_and_null_ids(spark):
    text = lambda tag: " ".join(f"{tag}{i}" for i in range(60))
    near = lambda tag, end: text(tag) + " " + end
    rows = [(1, text("a")), (5, near("a", "x")), (5, text("b"))]  # 5 stands on a copy of 1 and on a clean text
    rows += [(None, text("c")), (None, near("c", "x")), (None, near("c", "x"))]  # near copies without an id
    rows += [(7, text("d")), (None, near("d", "x"))]  # a copy without an id
    rows += [(8, text("e")), (8, near("e", "x"))]  # near copies under one id
    rows += [(9, ""), (9, None), (10, ""), (None, None), (3, text("f")), (3, text("f"))]
    got = [tuple(r) for r in ngram_join.one_of_each(spark.createDataFrame([(*r, "en", "s", 0) for r in rows], DOCS)).select("doc_id", "text").collect()]
    kept = {(d, t) for d, t in got}
    assert len(got) == len(kept) and kept >= {(1, text("a")), (5, text("b")), (7, text("d")), (9, ""), (9, None), (10, ""), (None, None), (3, text("f"))}
    left = [t[0] for d, t in kept if t]
    assert sorted(left) == list("abcdef") and (8, "e") in {(d, t[0]) for d, t in kept if t}


def test_cells_hold_every_pair_of_the_budget():
    for cosine in (0.93, 0.99, 0.999):
        for blocks in (1, 4, 48):
            met = np.sqrt(embedding_join._budget(cosine, blocks))  # a pair so far apart counts as met in its block
            assert embedding_join._width(cosine, blocks) > met
            at = np.linspace(-1, 1, 2001)
            cells = lambda y: np.floor(y / embedding_join._width(cosine, blocks))
            assert (cells(at + met) - cells(at) <= 1).all()


def test_a_link_across_two_cells_is_found(spark):
    """Vectors that the first block counts as met by a sliver and whose link the second block would find."""
    dim, r = 64, embedding_join.rotation(64)
    lo = embedding_join.blocks_of(dim)[0][0]
    old = float(np.sqrt(0.14 / 4)) + 1e-5  # cells as wide as before: the gap is wider, the budget wider still
    gap = (old + float(np.sqrt(0.14 / 4 + 1e-5))) / 2
    assert gap < np.sqrt(0.14 / 4 + 1e-5) and old < gap
    a, b = np.zeros(dim), np.zeros(dim)
    a[lo], b[lo] = -1e-7, gap - 1e-7  # cells -1 and 1 of the old width
    a[20], b[20] = np.sqrt(1 - a[lo] ** 2), np.sqrt(1 - b[lo] ** 2)
    a, b = a @ r.T, b @ r.T
    assert a @ b >= 0.93
    out = embedding_join.linked(spark.createDataFrame([(1, a.tolist(), 0), (2, b.tolist(), 0)], "vec_id long, embedding array<double>, label int")).collect()
    assert {(x["vec_id"], x["n_links"], x["component_id"]) for x in out} == {(1, 1, 1), (2, 1, 1)}


def test_unsettled_components_raise(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long").repartition(7)
    with pytest.raises(RuntimeError):
        components(links, most_rounds=1)
    assert {r["root"] for r in components(links).collect()} == {0}
