import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmeridian.functions import encode as E
from kmeridian.functions.model import Model, fit_gamma, gammainc, quantiles, valid_distance
from kmeridian.operators import intervals as X
from kmeridian.operators import kmers as K
from kmeridian.operators import view as V
from kmeridian.plans import mapping as M
from kmeridian.plans import sketching as S
from kmeridian.sources import readers as R
from kmeridian.sources import sketch_file


def test_encoding_known_values():
    assert E.encode_all("ACGT", 4)[1].tolist() == [0x1B]
    assert E.encode_all("T" * 10, 10)[1].tolist() == [0xFFFFF]
    assert E.encode_all("ACNGT", 2)[0].tolist() == [0, 3]
    bp = E.encode_all("ACGTTGCATTAGGACCATGACGTTTAC", 27)[1]
    assert (E.reverse_complements(E.reverse_complements(bp, 27), 27) == bp).all()


def test_columns_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 54, 200)
    df = spark.createDataFrame([(int(v),) for v in x], "bp long")
    got = df.select("bp", E.reverse_complement(F.col("bp"), 27).alias("rc"), E.mix(F.col("bp")).alias("z"), E.hamming(F.col("bp"), F.lit(0)).alias("d")).collect()
    for r in got:
        assert r["rc"] == int(E.reverse_complements(np.array([r["bp"]]), 27)[0])
        assert r["z"] == E.signed(int(E.mixed(np.array([r["bp"]]))[0]))
        assert r["d"] == sum(1 for i in range(27) if r["bp"] >> 2 * i & 3)


def test_maximal_intervals_by_definition():
    rng = np.random.default_rng(2)
    for i in range(400):
        n = int(rng.integers(1, 25))
        c = np.concatenate(([0], np.cumsum(rng.integers(-4, 5, n)))).astype(float)
        left = int(rng.integers(1, n + 1)) if i % 2 else 1
        right = int(rng.integers(left, n + 1)) if i % 2 else n
        tau = int(rng.integers(0, 5))
        assert X.maximal(c, tau, left, right) == X.maximal_by_loop(c, tau, left, right)


@pytest.mark.parametrize(
    ("thresholds", "distance", "order"),
    [([0.10, 0.05, 0.20, 0.03, 0.40, 0.35, 0.50, 0.45], 0.25, [3, 1, 0, 2, 6, 7, 4, 5]), ([0.05, 0.075, 0.1, 0.125, 0.15, 0.225, 0.2, 0.25], 0.088094, [0, 1, 7, 5, 6, 4, 3, 2]), ([0.30, 0.05, 0.20, 0.10, 0.25, 0.15, 0.35, 0.45], math.nan, [1, 3, 5, 2, 4, 0, 6, 7])],
)
def test_threshold_order(thresholds, distance, order):
    assert X.ranks(thresholds, distance) == order


def test_coordinates_and_bins():
    assert X.coordinates(1, 2, 2, 10, 5, False) == (1, 5)
    assert X.coordinates(2, 4, 2, 10, 5, True) == (5, 14)
    assert X.distance_bin([0.1, 0.2], 1, 0.3, 0.15) == (0.1, 0.2)
    assert X.distance_bin([0.1, 0.2], None, 0.3, 0.15) == (0.1, 0.2)


def test_merge_grows_with_chisq():
    c = np.array([0, 5, 3, 4, 2, 3, 1, 2, 0], float)
    s = np.linspace(8, 0, 9)
    assert len(X.merged([(1, 4), (3, 6), (5, 8)], c, s, 0)) == 3
    assert X.merged([(1, 4), (3, 6), (5, 8)], c, s, 1e9) == [(1, 8)]


def test_model():
    m = Model(rho=0.5)
    assert m.choose[:3].tolist() == [1, 27, 351] and m.elude[:3].tolist() == [0, 11, 231]
    for d in (0.05, 0.1, 0.2):
        v = np.array([(m.choose[i] - m.elude[i]) * d**i * (1 - d) ** (27 - i) for i in range(5)]) * 5e5
        assert abs(m.mle(v[None], np.array([1e6 - v.sum()]))[0] - d) < 1e-5
    assert np.isnan(valid_distance([1, -0.1, math.nan])).all() and valid_distance([0.5, 0])[0] == 0.5
    assert abs(gammainc(2, 2) - (1 - 3 * math.exp(-2))) < 1e-12
    g = fit_gamma(np.random.default_rng(3).gamma(2, 0.05, 5500))
    assert abs(g.shape / 2 - 1) < 0.15 and fit_gamma([]).shape == 1
    assert quantiles([0, 1, 2, 3, 4, 5]).tolist() == [1, 2, 3]


def test_strand_labels(spark):
    inf, nan = math.inf, math.nan
    cases = [(0, nan, "."), (0, -inf, "+"), (1, -inf, "."), (1, inf, "+"), (0, inf, "."), (1, 0.1, "+"), (0, 0.1, "-"), (0, -0.1, "+"), (1, -0.1, "-")]
    df = spark.createDataFrame([c[:2] for c in cases], "r int, d double")
    assert [r[0] for r in df.select(M.strand_label(F.col("r"), F.col("d"))).collect()] == [c[2] for c in cases]
    pairs = spark.createDataFrame([(nan, nan), (0.2, nan), (nan, 0.2), (0.2, 0.3)], "a double, b double")
    got = [r[0] for r in pairs.select(M.strand_diff(F.col("a"), F.col("b"))).collect()]
    assert math.isnan(got[0]) and got[1] == -inf and got[2] == inf and abs(got[3] + 0.1) < 1e-12


def test_minimizers_by_definition(spark):
    rng = np.random.default_rng(4)
    seqs = ["".join(rng.choice(list("ACGT"), 120)), "".join(rng.choice(list("ACGTN"), 200, p=[0.24, 0.24, 0.25, 0.25, 0.02])), "ACG", ""]
    df = spark.createDataFrame(list(enumerate(seqs)), "query_id int, seq string")
    got = {(r["query_id"], r["end"], r["pos"]) for r in K.minimizers(df, 19, 25).collect()}
    for q, s in enumerate(seqs):
        pos, bp = E.encode_all(s, 19)
        z = dict(zip(pos.tolist(), E.mixed(bp).tolist(), strict=True))
        for end in range(24, len(s)):
            window = [p for p in range(end - 24, end - 17)]
            if all(p in z for p in window):
                assert (q, end, min(window, key=lambda p: z[p])) in got


def test_planted_divergence_and_both_joins(spark):
    rng = np.random.default_rng(5)
    ref = rng.choice(list("ACGT"), 6000)
    near, far = ref[:3000].copy(), ref[3000:].copy()
    for part, d in ((near, 0.02), (far, 0.25)):
        at = rng.random(len(part)) < d
        part[at] = rng.choice(list("ACGT"), at.sum())
    refs = spark.createDataFrame([("r", "".join(ref))], "query_id string, seq string")
    query = spark.createDataFrame([("q", "".join(near) + "".join(far)), ("short", "ACGT")], "query_id string, seq string")
    sk = S.build(refs, "ref", S.SketchParams(w=27, h=11), created_ts=0, distinct="exact")
    p = M.MapParams(thresholds=(0.04,), min_length=500, bin_shift=3)
    out = [r.asDict() for r in M.map_queries(query, sk, p).collect()]
    hit = [r for r in out if r["IS_RC"] == 0 and r["MASK"] == 1]
    assert len(hit) == 1 and hit[0]["INTERVAL_START"] < 200 and 2500 < hit[0]["INTERVAL_END"] < 5000 and hit[0]["DIST"] < 0.08
    assert hit[0]["D_INTERVAL"] == "(1e-05, 0.04)" and hit[0]["STRAND"] == "+"
    a, b = (M.least_distances(query, *sk, kernel_rows=n) for n in (0, 10**6))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert [r["code"] for r in M.diagnostics(query, sk[0], p).collect()] == ["short_query"]


def test_sketch_files(spark, tmp_path):
    ref = "".join(np.random.default_rng(6).choice(list("ACGT"), 2000))
    sk = S.build(spark.createDataFrame([("r", ref)], "query_id string, seq string"), "one", S.SketchParams(h=3, w=30, k=19), created_ts=5)
    S.save(S.merge(sk), str(tmp_path / "s"))
    back = S.load(spark, str(tmp_path / "s"), ["one"])
    assert back[1].count() == sk[1].count() == sk[0].first()["nkmers"]
    sketch_file.write(sk, str(tmp_path / "x.skc"))
    again = sketch_file.read(spark, str(tmp_path / "x.skc"))
    assert again[0].first()["ppos"] == sk[0].first()["ppos"]
    assert {tuple(r) for r in again[1].collect()} == {tuple(r) for r in sk[1].collect()}


def test_readers(spark, tmp_path):
    assert list(R.parse_sequences(b">a x y\nAC\nGT\n>b\n\n@c\nACG\n+\nIII")) == [("a", "x y", "ACGT"), ("b", "", ""), ("c", "", "ACG")]
    with pytest.raises(ValueError):
        list(R.parse_sequences(b"@c\nACG\n+\nI"))
    (tmp_path / "a.fa").write_bytes(b">a\nACGT\n")
    assert R.sequences(spark, str(tmp_path / "a.fa")).first()["len"] == 4
    assert R.is_url("https://example.org/x.fa") and not R.is_url("http://127.0.0.1/x") and not R.is_url("x.fa")
    lines = spark.createDataFrame([("##gff",), ('c1\ts\t.\t9\t5\t.\t.\t0\tgene_id "g"; ID=z;Name=n',), ("bad",)], "value string")
    r = R.gff_rows(lines).collect()
    assert len(r) == 1 and (r[0]["start"], r[0]["stop"], r[0]["ftype"], r[0]["locus_tag"], r[0]["strand"], r[0]["ann_name"]) == (5, 9, "misc", "z", "+", "n")
    tree = R.tree(spark, "((a:1,b:2):0.5,c:3);")
    d = {r["name"]: r["distance"] for r in V.tree_path_distances(tree, "a").where("is_leaf").collect()}
    assert d == {"a": 0.0, "b": 3.0, "c": 4.5}


def test_numbers_as_text(spark):
    cases = [(0.1, "0.1"), (1e-5, "1e-05"), (0.0987284, "0.098728"), (12.5, "12.5"), (math.nan, "nan"), (-math.inf, "-inf"), (0.0, "0"), (1.0, "1"), (123456.0, "1.2346e+05")]
    df = spark.createDataFrame([(c[0],) for c in cases], "x double")
    assert [r[0] for r in df.select(M.five_digits(F.col("x"))).collect()] == [c[1] for c in cases]
