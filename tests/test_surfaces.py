import gzip
import math
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmeridian import cli
from kmeridian.functions import encode as E
from kmeridian.functions import model as D
from kmeridian.functions.text import significant
from kmeridian.operators import kmers as K
from kmeridian.operators import ranks
from kmeridian.operators import view as V
from kmeridian.plans import mapping as M
from kmeridian.plans import sketching as S
from kmeridian.sources import readers as R
from kmeridian.sources import sketch_file


def test_commands_end_to_end(spark, tmp_path, capsys):
    rng = np.random.default_rng(3)
    ref = "".join(rng.choice(list("ACGT"), 3000))
    (tmp_path / "a.fa").write_text(f">a one\n{ref[:1500]}\n{ref[1500:]}\n")
    (tmp_path / "b.fa.gz").write_bytes(gzip.compress(f">b\n{ref[500:2500]}\n>tiny\nACGT\n".encode()))
    run = lambda *a: cli.main([str(x) for x in a], spark)
    assert run("--seed", 4, "sketch", "-i", tmp_path / "a.fa", "-o", tmp_path / "one.skc", "-w", 29) == 0
    assert run("sketch", "-i", tmp_path / "b.fa.gz", "-o", tmp_path / "two.skc") == 0
    assert run("merge", "-i", tmp_path / "one.skc", tmp_path / "two.skc", "-o", tmp_path / "both.skc") == 0
    capsys.readouterr()
    assert run("info", "-i", tmp_path / "both.skc") == 0
    shown = capsys.readouterr().out
    assert "Number of sketches: 2" in shown and "one.skc" in shown and "two.skc" in shown and "w:           33" in shown
    assert run("map", "-q", tmp_path / "b.fa.gz", "-i", tmp_path / "both.skc", "-d", 0.1, "-l", 300, "-b", 3, "-o", tmp_path / "out") == 0
    assert "tiny (one.skc): short_query" in capsys.readouterr().err
    rows = R.results(spark, str(tmp_path / "out")).collect()
    assert {r["REF_ID"] for r in rows} == {"one.skc", "two.skc"} and {r["QUERY_ID"] for r in rows} == {"b"} and rows[0].asDict().keys() == set(M.COLUMNS)
    assert all(r["DIST_CONTIG"] < 0.01 for r in rows if r["IS_RC"] == 0)
    assert run("map", "-q", tmp_path / "b.fa.gz", "-i", tmp_path / "two.skc", "-d", 0.1, "-l", 300, "-b", 3, "--sample-size", 0) == 0
    text = capsys.readouterr().out.splitlines()
    assert text[0].split("\t") == list(M.COLUMNS) and len(text) >= 3
    for bad in (("-d", 0.1, 0.2), ("-d", 0.1, "--hdist-th", 8), ("-d", 0.1, "-b", 9), ("-d", -0.1)):
        assert run("map", "-q", tmp_path / "b.fa.gz", "-i", tmp_path / "two.skc", "-l", 300, *bad) == 1
    for bad in (("-k", 18), ("-k", 27, "-w", 20), ("-h", 2, "-w", 30), ("-m", 2, "-r", 2)):
        assert run("sketch", "-i", tmp_path / "a.fa", "-o", tmp_path / "no.skc", *bad) == 1
    with pytest.raises(SystemExit):
        run("sketch", "-i", tmp_path / "a.fa")


def test_fasta_in_splits(spark, tmp_path):
    rng = np.random.default_rng(4)
    records = [(f"s{i}", "".join(rng.choice(list("ACGTN"), int(rng.integers(0, 3000))))) for i in range(60)]
    text = "".join(f">{n} some words\r\n" + "".join(s[j : j + 70] + "\n" for j in range(0, len(s), 70)) for n, s in records)
    (tmp_path / "x.fa").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        df = R.fasta(spark, str(tmp_path / "x.fa"))
        assert df.rdd.getNumPartitions() > 5
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r["query_id"], r["seq"]) for r in sorted(rows, key=lambda r: r["block"])] == records and {r["comment"] for r in rows} == {"some words"}
    (tmp_path / "empty.fa").write_text("")
    assert R.fasta(spark, str(tmp_path / "empty.fa")).count() == 0 and R.read_sequences(spark, str(tmp_path / "empty.fa")).count() == 0
    (tmp_path / "q.fq").write_text("@a\nACGT\n+\nIIII\n")
    assert R.read_sequences(spark, str(tmp_path / "q.fq")).first()["seq"] == "ACGT"


def test_hand_written_sketch_file():
    """The smallest file by its layout, field by field."""
    ppos, npos = [26, 25, 20, 18, 15, 14, 13, 10, 7, 5, 0], [i for i in range(27) if i not in {26, 25, 20, 18, 15, 14, 13, 10, 7, 5, 0}]
    blob = struct.pack("<Q", 8) + b"tiny.skc" + struct.pack("<Q", 1234567890) + bytes([27, 33, 11]) + struct.pack("<II?I", 2, 1, True, 4) + bytes(ppos) + bytes(npos)
    blob += struct.pack("<dQ", 0.8, 3) + struct.pack("<III", 100, 200, 300) + struct.pack("<I", 4) + struct.pack("<QQQQ", 1, 2, 3, 3)
    (meta, rix, enc), (again, _, _) = sketch_file.unpack(struct.pack("<I", 2) + blob + blob)
    assert meta == again == dict(rid="tiny.skc", created_ts=1234567890, k=27, w=33, h=11, m=2, r=1, frac=True, nrows=4, ppos=ppos, npos=npos, rho=0.8, nkmers=3)
    assert rix.tolist() == [0, 1, 2] and sketch_file._to_planes(enc, 16).tolist() == [100, 200, 300]
    assert list(sketch_file.heads(struct.pack("<I", 2) + blob + blob)) == [meta, meta] and sketch_file.pack(meta, rix, enc) == blob


def test_windows_over_breaks(spark):
    """The circular buffer by a literal loop."""
    rng = np.random.default_rng(5)
    k, w = 19, 24
    seqs = ["".join(rng.choice(list("ACGTN"), int(n), p=[0.24, 0.24, 0.24, 0.24, 0.04])) for n in rng.integers(24, 200, 12)] + ["A" * 30, "ACGT" * 6 + "N" + "ACGT" * 5]
    got = Counter((r["query_id"], r["end"], r["bp"]) for r in K.minimizers(spark.createDataFrame(list(enumerate(seqs)), "query_id int, seq string"), k, w, compat=True).collect())
    want = Counter()
    for q, s in enumerate(seqs):
        buffer, at, run = [(0, 0)] * (w - k + 1), 0, 0
        for i, c in enumerate(s):
            run = 0 if c == "N" else run + 1
            if run < k:
                continue
            x = sum("ACGT".index(b) << 2 * (k - 1 - j) for j, b in enumerate(s[i - k + 1 : i + 1]))
            buffer[at] = (int(E.mixed(np.array([x], np.uint64))[0]), x)
            at = (at + 1) % len(buffer)
            if run >= w or i + 1 == len(s):
                want[q, i, min(buffer)[1]] += 1
    assert got == want


def test_ranks_over_many_partitions(spark):
    rng = np.random.default_rng(6)
    rows = [(g, int(i), None if i % 50 == 0 else math.nan if i % 50 == 1 else float(rng.integers(0, 40)) / 40) for g in ("a", "b", None) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i int, p double").repartition(7)
    got = {(r["g"], r["i"]): r["q"] for r in ranks.q_values(df, ["g"]).collect()}
    for g in ("a", "b", None):
        own = sorted((p, i) for x, i, p in rows if x == g and p is not None and p == p)
        best = 1.0
        for rank in range(len(own), 0, -1):
            best = min(best, own[rank - 1][0] * len(own) / rank)
            assert abs(got[g, own[rank - 1][1]] - best) < 1e-12
    assert len(got) == 900 and sum(q != q for q in got.values()) == 36
    total = ranks.running_total(df.where("p is not null and not isnan(p)"), ["g"], ["p", "i"], "p", "t").collect()
    for g in ("a", "b", None):
        own = sorted((r["p"], r["i"], r["t"]) for r in total if r["g"] == g)
        assert np.allclose([t for *_, t in own], np.cumsum([p for p, *_ in own]))
    assert ranks.q_values(df.limit(0), ["g"]).count() == 0


def test_digits_as_c_prints_them(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.standard_normal(2000) * 10.0 ** rng.integers(-9, 9, 2000), np.round(rng.random(3000) * 9999, 2), np.round(rng.random(2000), 6), [8727.65, 0.5, 99999.5, 9.99995, 0.000123455, 1e15, 2.5, 123455, 1234.5, 1e300]])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    for r in df.select("x", significant(F.col("x"), 5).alias("a"), significant(F.col("x"), 4).alias("b")).collect():
        assert (r["a"], r["b"]) == (f"{r['x']:.5g}", f"{r['x']:.4g}"), r["x"]


def test_gamma_fits_recover_parameters():
    rng = np.random.default_rng(8)
    truth = [(2, 0.05, 5500, 0.15), (5, 0.02, 6500, 0.15), (1.5, 0.08, 5500, 0.18)]
    fits = D.fit_gammas([rng.gamma(a, s, n) for a, s, n, _ in truth] + [np.zeros(0)])
    for g, (a, s, _, e) in zip(fits, truth, strict=False):
        assert abs(g.shape / a - 1) < e and abs(g.scale / s - 1) < e
    assert (fits[-1].shape, fits[-1].scale) == (1, 1)
    x = rng.gamma(2, 0.05, 300)
    assert abs(D.fit_gamma(x).shape - D.fit_gamma(rng.permutation(x)).shape) < 1e-9


def test_filters_are_cached(spark):
    df = spark.createDataFrame([("r", 0, "q", 1, 9, 100, 1.0, 0.2, 0.01, 0.5, "+")], "REF_ID string, y int, QUERY_ID string, INTERVAL_START long, INTERVAL_END long, SEQ_LEN long, IS_RC double, distance double, PERCENTILE double, FOLD double, STRAND string")
    f = V.Filters(df, enum=True, most=2)
    a = f("q", 0.5)
    assert f("q", 0.5) is a and a.is_cached and a.count() == 1
    f("q", 0.1), f("q", 0.3)
    assert not a.is_cached and f("q", 0.1).count() == 0
    assert V.Filters(df, enum=False)("q", "PERCENTILE", -1.0, ">1").count() == 0


def test_deep_trees(spark):
    deep = "a:1"
    for i in range(400):
        deep = f"({deep},x{i}:1):1"
    t = R.tree(spark, deep + ";")
    d = {r["name"]: r["distance"] for r in V.tree_path_distances(t, "a").where("is_leaf").collect()}
    assert len(d) == 401 and d["x0"] == 2 and d["x399"] == 401
    assert V.tree_path_distances(t, "none").count() == 0
    layout = {r["node_id"]: r for r in V.tree_layout(t, cladogram=True).collect()}
    assert layout[0]["x"] == 0 and layout[0]["leaves"] == 401 and max(r["x"] for r in layout.values()) == 400


def test_sketch_tables_merge_and_prune(spark, tmp_path):
    ref = "".join(np.random.default_rng(9).choice(list("ACGT"), 900))
    one = S.build(spark.createDataFrame([("r", ref)], "query_id string, seq string"), "one", S.SketchParams(), created_ts=5)
    two = S.build(spark.createDataFrame([("r", ref[::-1])], "query_id string, seq string"), "two", S.SketchParams(), created_ts=6)
    S.save(S.merge(one, two), str(tmp_path / "s"))
    assert {r["rid"] for r in S.load(spark, str(tmp_path / "s"))[0].collect()} == {"one", "two"}
    plan = S.load(spark, str(tmp_path / "s"), ["two"])[1]._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "two" in plan
    assert S.load(spark, str(tmp_path / "s"), ["two"])[1].exceptAll(two[1]).count() == 0
