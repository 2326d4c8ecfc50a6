"""Queries of the engine's other operators, and SQL for them: readers and sinks, sketches, model, intervals, nulls, views.

Inputs are arithmetic on the relational tables. Kernels that work on one group run by group; each query calls the
library's own operator, and its SQL states the rule anew."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmeridian.catalog import _BUCKET, _HAM, _MIN, _RC, _REF, _SK, _WALK, _Z, PARAMS, PPOS, _positions, _ref_sketch, _walk, refs, talk
from kmeridian.catalog import SQL as FIRST
from kmeridian.functions import encode as E
from kmeridian.functions import model as D
from kmeridian.functions.sql import register
from kmeridian.operators import intervals as X
from kmeridian.operators import kmers as K
from kmeridian.operators import view as V
from kmeridian.plans import mapping as M
from kmeridian.plans import sketching as S
from kmeridian.session import saved_folder, ship, table
from kmeridian.sources import readers as R
from kmeridian.sources import sketch_file
from kmeridian.streaming.mapper import map_stream

MODEL = D.Model(27, 11, 0.5, 4)
TH = (0.1, 0.05, 0.2, 0.03, 0.4, 0.35, 0.5, 0.45)


def _place(spark: SparkSession, what: str) -> str:
    return f"{saved_folder(spark)}/{what}-{uuid.uuid4().hex}"


def _by(df: DataFrame, key: str, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.groupBy(key).applyInPandas(run, schema)


# Sources and sinks


def _written(spark: SparkSession, lines: DataFrame, what: str, gz: bool = False) -> str:
    path = _place(spark, what)
    lines.write.option("compression", "gzip" if gz else "none").text(path)
    return path


def _fasta_lines(spark, d):
    folded = F.regexp_replace("seq", "(.{60})", "$1\n")
    return refs(spark, d).where("seq <> ''").select(F.concat(F.lit(">r"), F.col("query_id").cast("string"), F.lit(" a comment\n"), folded).alias("value"))


def _sequence_rows(df):
    return df.select("query_id", "comment", "len", F.md5("seq").alias("m"))


def fasta_scan(spark, d):
    return _sequence_rows(R.fasta(spark, _written(spark, _fasta_lines(spark, d), "fasta")))


def fasta_gzip(spark, d):
    return _sequence_rows(R.sequences(spark, _written(spark, _fasta_lines(spark, d), "fasta", gz=True)))


def fastq_scan(spark, d):
    lines = refs(spark, d).where("seq <> ''").select(F.concat(F.lit("@r"), F.col("query_id").cast("string"), F.lit(" a comment\n"), "seq", F.lit("\n+\n"), F.regexp_replace("seq", ".", "I")).alias("value"))
    return _sequence_rows(R.sequences(spark, _written(spark, lines, "fastq")))


def empty_scan(spark, d):
    at = _written(spark, _fasta_lines(spark, d).limit(0), "none")
    return spark.createDataFrame([(S.is_empty(R.fasta(spark, at)), S.is_empty(refs(spark, d)))], "none boolean, some boolean")


def url_predicate(spark, d):
    key = F.col("p_partkey")
    host = F.when(key % 5 == 0, F.concat(F.lit("10.0.0."), (key % 250).cast("string"))).when(key % 5 == 1, F.lit("localhost")).when(key % 5 == 2, F.concat(F.lit("data"), key.cast("string"), F.lit(".example.org"))).when(key % 5 == 3, F.lit("192.168.1.7")).otherwise(F.lit("8.8.4.4"))
    url = F.concat(F.when(key % 3 == 0, "https://").when(key % 3 == 1, "ftp://").otherwise(""), host, F.when(key % 2 == 0, ":8080").otherwise(""), F.lit("/x.fa.gz"))
    return table(spark, d, "part").select("p_partkey", R.url_column(url).alias("ok"))


def _result(spark, d, n="l_orderkey * 8 + l_linenumber"):
    """Rows as results have them, with oddities; k tells them apart."""
    li = table(spark, d, "lineitem")
    x = lambda s: F.expr(s)
    return li.select(
        x(n).alias("k"), x("concat('q', l_suppkey % 5)").alias("QUERY_ID"), x("1000 + l_suppkey % 3").cast("long").alias("SEQ_LEN"), x("l_orderkey * 7 % 900 + 1").alias("INTERVAL_START"), x("l_orderkey * 7 % 900 + 1 + l_partkey % 40").alias("INTERVAL_END"),
        x("CASE l_orderkey % 5 WHEN 0 THEN '+' WHEN 1 THEN '-' WHEN 2 THEN '.' WHEN 3 THEN ' +x' ELSE 'odd' END").alias("STRAND"),
        x("CASE l_partkey % 8 WHEN 0 THEN '1' WHEN 1 THEN '0' WHEN 2 THEN 'True' WHEN 3 THEN ' fw' WHEN 4 THEN '2.5' WHEN 5 THEN 'bad' WHEN 6 THEN '0.4' ELSE 'no' END").alias("IS_RC"),
        x("concat('NATION_', l_partkey % 30)").alias("REF_ID"), x("CASE WHEN l_suppkey % 11 = 0 THEN double('NaN') ELSE l_quantity / 45 END").alias("DIST"), x("l_linenumber").cast("int").alias("MASK"),
        x("CASE l_linenumber % 4 WHEN 0 THEN '(0, 0.1)' WHEN 1 THEN '(0.1, 0.25)' WHEN 2 THEN 'none' ELSE '(0.1)' END").alias("D_INTERVAL"), x("l_discount").alias("DIST_CONTIG"),
        x("CASE l_partkey % 7 WHEN 0 THEN double('NaN') WHEN 1 THEN double('Infinity') WHEN 2 THEN double('-Infinity') ELSE l_extendedprice / 7 - 3000 END").alias("STRAND_DIFF"), x("l_tax").alias("DIST_GENOME"),
        x("CASE WHEN l_orderkey % 13 = 0 THEN double('NaN') ELSE pow(l_quantity / 51, 4) END").alias("PERCENTILE"), x("CASE WHEN l_orderkey % 17 = 0 THEN double('NaN') ELSE l_quantity / 25 END").alias("FOLD"), x("CASE WHEN l_orderkey % 13 = 0 THEN double('NaN') ELSE pow(l_quantity / 51, 3) END").alias("QVALUE"),
    )


def _null(c):
    """NaN as null: SQL engines order and compare NaN in their own ways."""
    return F.when(~F.isnan(c), F.col(c) if isinstance(c, str) else c)


def result_text(spark, d):
    """Numbers as the result writer prints them."""
    r = _result(spark, d)
    return r.select("k", *(M.five_digits(F.col(c)).alias(c.lower()) for c in ("DIST", "STRAND_DIFF", "PERCENTILE", "FOLD")))


def result_round_trip(spark, d):
    """Results written as text and read again."""
    r = _result(spark, d).withColumns({"IS_RC": F.lit(1), "emit": F.col("k")})
    path = _place(spark, "tsv")
    M.write_tsv(r, path)
    return R.results(spark, path).groupBy("QUERY_ID", "MASK").agg(F.count("*").alias("n"), F.sum("INTERVAL_END").alias("e"), F.count_if(F.isnan("DIST")).alias("no_dist"), F.round(F.sum(F.when(~F.isnan("FOLD"), F.col("FOLD"))), 1).alias("fold"), F.count_if(F.col("STRAND_DIFF") == math.inf).alias("inf"))


def gff_sniff(spark, d):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    good = "c1\ts\tgene\t5\t9\t.\t+\t0\tID=a"
    cases = [("gff", ["##x", "", good]), ("short", ["c1\ts\tgene\t5\t9"]), ("header", ["contig_id\tb\tc\tstart\tstop\tx\ty\tz\tw"]), ("empty", ["#"])]
    return spark.createDataFrame([(n, R.is_gff(lines(*x))) for n, x in cases], "name string, gff boolean")


def _gff(spark, d, more=False):
    s = table(spark, d, "supplier")
    x = F.expr(
        "concat_ws('\t', concat('c', s_suppkey % 7), 'src', CASE WHEN s_suppkey % 3 = 0 THEN '.' ELSE 'gene' END, s_suppkey * 13 % 997 + 50, s_suppkey * 29 % 997, '.', CASE s_suppkey % 4 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '.' END, '0', "
        "CASE s_suppkey % 6 WHEN 0 THEN concat('ID=f', s_suppkey, ';Name=', s_name) WHEN 1 THEN concat('gene_id \"g', s_suppkey, '\"; product \"a b\"') WHEN 2 THEN concat('Name=', s_name, ' ; description = x=y;note=n') "
        "WHEN 3 THEN concat('locus_tag=l', s_suppkey, ';ann=A;gene=G;ec_number=1.1') WHEN 4 THEN 'ann_id=z;ann_name=B' ELSE '' END)"
    )
    extra = spark.createDataFrame([("# comment",), ("",), ("c\ts\tf\tx\t5\t.\t+\t0\tID=q",), ("c\ts\tf\t1",)], "value string")
    return R.gff_rows(s.select(x.alias("value")).unionByName(extra), more_names=more).select("contig_id", "locus_tag", "ftype", "start", "stop", "strand", "ann_name", "product", "ec_number", "source", "score", "frame")


def gff_normalise(spark, d):
    return _gff(spark, d)


def gff_more_names(spark, d):
    return _gff(spark, d, more=True)


def custom_annotations(spark, d):
    s = table(spark, d, "supplier").select(
        F.expr("s_suppkey + 0").alias("row"), F.expr("concat('c', s_suppkey % 7)").alias("contig_id"), F.expr("concat('t', s_suppkey)").alias("locus_tag"), F.lit("CDS").alias("ftype"), F.expr("s_suppkey * 13 % 997").alias("start"), F.expr("s_suppkey * 29 % 997").alias("stop"),
        F.expr("CASE s_suppkey % 3 WHEN 0 THEN '-' WHEN 1 THEN '+' ELSE '?' END").alias("strand"), F.expr("CASE WHEN s_suppkey % 4 = 0 THEN '.' ELSE concat('p', s_suppkey) END").alias("prokka_gene"), F.expr("CASE WHEN s_suppkey % 8 = 0 THEN '' ELSE 'sw' END").alias("swissprot_gene"), F.lit("g").alias("gene"), F.expr("CASE WHEN s_suppkey % 5 = 0 THEN '.' ELSE 'prod' END").alias("swissprot_product"),
    )
    return R.custom_rows(s).select("contig_id", "locus_tag", "start", "stop", "strand", "ann_name", "product", "ec_number")


def annotation_router(spark, d):
    """Which way each file goes: rows read, none for what is no annotation."""
    gff = _written(spark, table(spark, d, "supplier").select(F.expr("concat('c\ts\tgene\t', s_suppkey + 1, '\t', s_suppkey + 9, '\t.\t+\t0\tID=a')").alias("value")), "gff")
    tsv = _written(spark, spark.createDataFrame([("contig_id\tlocus_tag\tftype\tstart\tstop\tstrand",), ("c\tt\tCDS\t9\t4\t-",)], "value string").coalesce(1), "tsv")
    bad = _written(spark, spark.createDataFrame([("a\tb",), ("1\t2",)], "value string").coalesce(1), "bad")
    read = [R.annotations(spark, p) for p in (gff, tsv, bad)]
    return spark.createDataFrame([(n, None if x is None else x.count()) for n, x in zip(("gff", "tsv", "bad"), read, strict=True)], "name string, n long")


def _tree(spark, d):
    """Regions over nations, branch lengths by key."""
    rows = table(spark, d, "nation").collect()
    by = {}
    for r in rows:
        by.setdefault(r["n_regionkey"], []).append(r)
    clades = [f"({','.join(f'{n['n_name']}:{n['n_nationkey'] + 1}' for n in ns)})R{k}:{(k + 1) / 2}" for k, ns in sorted(by.items())]
    return R.tree(spark, f"({','.join(clades)})root;")


def newick_nodes(spark, d):
    t = _tree(spark, d)
    up = t.select(F.col("node_id").alias("parent_id"), F.col("name").alias("parent"))
    return t.join(up, "parent_id", "left").select("name", "parent", "dist", "is_leaf")


def tree_path_distance(spark, d):
    return V.tree_path_distances(_tree(spark, d), "NATION_3").where("is_leaf").select("name", F.round("distance", 6).alias("distance"))


def tree_sizes(spark, d):
    t = _tree(spark, d)
    return V.tree_layout(t).join(t, "node_id").select("name", F.round("x", 6).alias("x"), "leaves")


def tree_pruned(spark, d):
    t = _tree(spark, d)
    kept = table(spark, d, "supplier").where("s_suppkey <= 4").select(F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")).alias("REF_ID"))
    return V.pruned(t, kept).select("name")


# Sketches


def _sketch(spark, d, p=PARAMS, rid="ref"):
    return S.build(refs(spark, d), rid, p, created_ts=1234567890, distinct="exact")


def sketch_info(spark, d):
    """Saved and merged sketches, from metadata alone."""
    path = _place(spark, "sketch")
    S.save(S.merge(_sketch(spark, d), _sketch(spark, d, rid="other")), path)
    return S.info(S.load(spark, path)[0]).select("rid", "k", "w", "h", "m", "r", "frac", "nrows", F.round("rho", 9).alias("rho"), "nkmers")


def sketch_merge(spark, d):
    meta, rows = S.merge(_sketch(spark, d), _sketch(spark, d, rid="other"), _sketch(spark, d))
    return rows.groupBy("rid").agg(F.count("*").alias("n"), F.count_distinct("rix").alias("buckets"))


def sketch_load(spark, d):
    path = _place(spark, "sketch")
    S.save(S.merge(_sketch(spark, d), _sketch(spark, d, rid="other")), path)
    return S.load(spark, path, ["other"])[1].groupBy("rid").agg(F.count("*").alias("n"), F.bit_xor("enc").alias("x"), F.bit_xor("rix").alias("y"))


def rho_exact(spark, d):
    return _sketch(spark, d)[0].select(F.round("rho", 9).alias("rho"), F.round(S.partial_rho(F.col("rho"), F.col("m"), F.col("r"), F.col("frac")), 9).alias("partial"), "nkmers")


def rho_estimated(spark, d):
    return S.build(refs(spark, d), "ref", PARAMS, created_ts=0)[0].select(F.round("rho", 6).alias("rho"))


def canonical_sketch(spark, d):
    p = S.SketchParams(k=27, w=31, h=11, m=2, r=1, ppos=PPOS, canonical=True)
    return _sketch(spark, d, p)[1].agg(F.count("*").alias("n"), F.bit_xor("enc").alias("x"), F.bit_xor("rix").alias("y"))


def canonical_kmers(spark, d):
    return K.kmers(refs(spark, d), 27).groupBy("query_id").agg(F.count("*").alias("n"), F.bit_xor(K.canonical(F.col("bp"), F.col("rc"))).alias("x"))


def sketch_rows(spark, d):
    """Buckets kept of all, for parameters of every kind."""
    rows = [(h, m, r, frac, S.SketchParams(k=27, w=31, h=h, m=m, r=r, frac=frac, ppos=tuple(range(h))).nrows) for h in (11, 13, 16) for m in (1, 2, 3, 7) for r in range(m) for frac in (True, False)]
    return spark.createDataFrame(rows, "h int, m int, r int, frac boolean, n long")


def row_compaction(spark, d):
    b = F.col("l_partkey") * 31 + F.col("l_linenumber")
    m, r = 5, 2
    return table(spark, d, "lineitem").select(b.alias("b")).distinct().select("b", S.compact(F.col("b"), m, r).alias("frac"), S.compact(F.col("b"), m, r, False).alias("one"))


def short_references(spark, d):
    return refs(spark, d).select("query_id", F.substring("seq", 1, 27 + 0).alias("s"), "seq").select("query_id", F.when(F.col("query_id") % 3 == 0, F.col("s")).otherwise(F.col("seq")).alias("seq")).transform(lambda q: K.minimizers(q, 27, 31)).groupBy("query_id").agg(F.count("*").alias("n"))


def query_diagnostics(spark, d):
    q = refs(spark, d).select("query_id", F.expr("substr(seq, 1, cast(query_id % 40 * 3 as int))").alias("seq"))
    meta = spark.createDataFrame([("ref", 27)], "rid string, k int")
    return M.diagnostics(q, meta, M.MapParams(min_length=64, bin_shift=4))


def binary_sketch(spark, d):
    """The exchange file of two sketches, packed and read."""
    sk = S.merge(_sketch(spark, d, S.SketchParams(k=27, w=31, h=11, m=97, r=0, ppos=PPOS)), _sketch(spark, d, S.SketchParams(k=27, w=31, h=11, m=97, r=1, ppos=PPOS), "other"))
    rows = spark.createDataFrame([(bytearray(sketch_file.packed(sk)),)], "content binary")
    meta, kmers = sketch_file.tables(rows)
    return kmers.groupBy("rid").agg(F.count("*").alias("n"), F.bit_xor("enc").alias("x"), F.sum("rix").alias("y")).join(meta.select("rid", "nkmers", "created_ts"), "rid")


# Encoding


def nt4_codes(spark, d):
    c = F.explode(F.split(E.dna(F.col("p_name"), breaks=True), "")).alias("c")
    mixed = table(spark, d, "part").select(c).unionByName(table(spark, d, "part").select(F.substring("p_name", 1, 1).alias("c")))
    return mixed.groupBy(E.nt4(F.col("c")).alias("code")).agg(F.count("*").alias("n"))


def hamming_planes(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_orderkey") * 7919 + F.col("l_partkey")).alias("x"), (F.col("l_suppkey") * 104729 + F.col("l_linenumber") * 65537).alias("y"))
    return li.groupBy(E.hamming_planes(F.col("x").bitwiseAND(0xFFFFFFFF), F.col("y").bitwiseAND(0xFFFFFFFF)).alias("d")).agg(F.count("*").alias("n"))


def extract_bits(spark, d):
    mask = 0b1010_0100_1111_0001_0110
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", E.extract_bits(F.col("l_orderkey") * 8191 + F.col("l_linenumber"), mask).alias("x"))


def random_positions(spark, d):
    rows = []
    for seed in range(50):
        p, n = E.random_positions(27, 11, seed)
        rows.append((seed, len(set(p)), len(set(n)), len(set(p) | set(n)), p == sorted(p, reverse=True), n == sorted(n), E.random_positions(27, 11, seed)[0] == p))
    return spark.createDataFrame(rows, "seed int, p int, n int, both int, falling boolean, rising boolean, same boolean")


# Model


def _grid(spark, d):
    return table(spark, d, "part").select("p_partkey", ((F.col("p_partkey") % 97 + 1) / 100.0).alias("D"), *((F.col("p_partkey") * (7 + i) % 23).cast("long").alias(f"v{i}") for i in range(5)), (F.col("p_partkey") * 3 % 101).cast("long").alias("u"))


def _rowwise(df: DataFrame, run, schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInPandas(lambda it: (run(x) for x in it), schema)


def model_scores(spark, d):
    """Derivative and curvature of the log-likelihood for hits and misses."""

    def run(x):
        s, c = (np.array([f(v) for v in x["D"]]) for f in (MODEL.score, MODEL.curvature))
        return pd.DataFrame({"p_partkey": x["p_partkey"], **{f"s{i}": s[:, i].round(6) for i in (0, 2, 4)}, "su": s[:, 5].round(6), **{f"c{i}": c[:, i].round(4) for i in (0, 4)}, "cu": c[:, 5].round(4)})

    return _rowwise(_grid(spark, d), run, "p_partkey long, s0 double, s2 double, s4 double, su double, c0 double, c4 double, cu double")


def model_likelihood(spark, d):
    """Negative log-likelihood and observed information of histograms."""

    def run(x):
        v, u = x[[f"v{i}" for i in range(5)]].to_numpy(float), x["u"].to_numpy(float)
        info = [MODEL.fisher(a, b, c) for a, b, c in zip(x["D"], v, u, strict=True)]
        return pd.DataFrame({"p_partkey": x["p_partkey"], "nll": MODEL.nll(x["D"].to_numpy(), v, u).round(5), "info": np.round(info, 2)})

    return _rowwise(_grid(spark, d), run, "p_partkey long, nll double, info double")


def model_probabilities(spark, d):
    def run(x):
        rows = [MODEL.probabilities(D, int(k) % 5) for D, k in zip(x["D"], x["p_partkey"], strict=True)]
        return pd.DataFrame({"p_partkey": x["p_partkey"], **{c: [round(r[c], 9) for r in rows] for c in ("collide", "elude", "mutate", "miss", "hit")}})

    return _rowwise(_grid(spark, d), run, "p_partkey long, collide double, elude double, mutate double, miss double, hit double")


def model_binomials(spark, d):
    return spark.createDataFrame([(k, int(D.Model(27, 11).choose[k]), int(D.Model(27, 11).elude[k])) for k in range(28)], "d int, choose long, elude long")


def _is_least(model, v: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fitted distances, and whether no other distance tried has a smaller negative log-likelihood; each is tried once for all rows."""
    at = model.mle(v, u)
    others = [np.clip(at + s, 0, D.UPPER) for s in (-1e-2, -1e-4, 1e-4, 1e-2)] + [np.full(len(at), g) for g in np.linspace(0.005, D.UPPER, 60)]
    least = np.full(len(at), np.inf)
    for o in others:
        least = np.minimum(least, model.nll(o, v, u))
    return at, model.nll(at, v, u) <= least + 1e-9


def mle_is_least(spark, d):
    """The fitted distance has no smaller negative log-likelihood anywhere near or on a grid."""

    def run(x):
        at, least = _is_least(MODEL, x[[f"v{i}" for i in range(5)]].to_numpy(float), x["u"].to_numpy(float))
        return pd.DataFrame({"p_partkey": x["p_partkey"], "least": least, "within": (at >= 0) & (at <= D.UPPER)})

    return _rowwise(_grid(spark, d).where("p_partkey % 40 = 0"), run, "p_partkey long, least boolean, within boolean")


def valid_distances(spark, d):
    def run(x):
        y = D.valid_distance(x["d"].to_numpy())
        return pd.DataFrame({"p_partkey": x["p_partkey"], "bad": np.isnan(y), "v": np.nan_to_num(y)})

    return _rowwise(_grid(spark, d).select("p_partkey", ((F.col("p_partkey") % 13 - 2) / 10.0).alias("d")), run, "p_partkey long, bad boolean, v double")


def threshold_signs(spark, d):
    rows = [(i, *D.signs([t * (-1 if i >> j & 1 else 1) for j, t in enumerate(TH)])) for i in range(256)]
    return spark.createDataFrame(rows, "i int, positive int, negative int")


def strand_differences(spark, d):
    x = (F.col("c_custkey") % 50) / 100.0
    y = (F.col("c_custkey") * 3 % 50) / 100.0
    nan = F.lit(math.nan)
    a, b = F.when(F.col("c_custkey") % 4 < 2, x).otherwise(nan), F.when(F.col("c_custkey") % 3 < 2, y).otherwise(nan)
    diff = M.strand_diff(a, b)
    return table(spark, d, "customer").select("c_custkey", F.when(F.isnan(diff), "nan").when(F.abs(diff) == math.inf, F.when(diff > 0, "inf").otherwise("-inf")).otherwise("finite").alias("kind"), F.round(F.when(~F.isnan(diff) & (F.abs(diff) < 9), diff), 9).alias("diff"))


def gamma_law(spark, d):
    """Density and distribution of Gamma laws of whole shapes, where both have closed forms."""

    def run(x):
        laws = [D.Gamma(float(k % 5 + 1), (k % 7 + 1) / 50) for k in x["p_partkey"]]
        at = (x["p_partkey"] % 61 + 1) / 90
        cdf = D.gamma_cdfs(np.array([g.shape for g in laws]), np.array([v / g.scale for g, v in zip(laws, at, strict=True)]))
        return pd.DataFrame({"p_partkey": x["p_partkey"], "cdf": [round(g.cdf(v), 9) for g, v in zip(laws, at, strict=True)], "cdfs": cdf.round(9), "pdf": [round(g.pdf(v), 7) for g, v in zip(laws, at, strict=True)]})

    return _rowwise(_grid(spark, d), run, "p_partkey long, cdf double, cdfs double, pdf double")


def _samples(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("g"), (F.col("l_quantity") * F.col("l_quantity") / 9000 + 0.01).alias("x"))


def gamma_start(spark, d):
    """Quantiles that the fit matches, and the moments it starts from."""

    def run(x):
        m, q = D.moments(x["x"].to_numpy()), D.quantiles(x["x"].to_numpy())
        return pd.DataFrame({"g": [x["g"].iloc[0]], "shape": [round(m.shape, 6)], "scale": [round(m.scale, 8)], **{f"q{i}": [round(q[i], 9)] for i in range(3)}})

    return _by(_samples(spark, d), "g", run, "g long, shape double, scale double, q0 double, q1 double, q2 double")


def gamma_fit(spark, d):
    """Whether the fitted law matches the quantiles better than the moments do, as one batch or alone, in any order."""

    def run(x):
        v = x["x"].to_numpy()
        law, start, q = D.fit_gamma(v), D.moments(v), D.quantiles(v)
        loss = lambda g: sum((g.cdf(a) - w) ** 2 for a, w in zip(q, (0.2, 0.4, 0.6), strict=True))
        both = D.fit_gammas([v[::-1], v[:9]])
        return pd.DataFrame({"g": [x["g"].iloc[0]], "better": [loss(law) <= loss(start) + 1e-12], "same": [abs(both[0].shape / law.shape - 1) < 1e-9]})

    return _by(_samples(spark, d), "g", run, "g long, better boolean, same boolean")


def null_scores(spark, d):
    """Scores against samples: the share below the median is a half, few samples and bad values give nothing."""

    def run(x):
        v = x["x"].to_numpy()
        p, median = D.score_samples(0.1, v)
        at = D.score_samples(median, v)[0]
        nothing = [D.score_samples(math.nan, v), D.score_samples(0.1, v[:7])]
        notes = [M.significance(0.1, v[:7], True)[2], M.significance(0.1, v, True)[2], M.significance(math.nan, v, False)[2]]
        two = M.significance(0.1, v, True)[0]
        return pd.DataFrame({"g": [x["g"].iloc[0]], "half": [round(at, 4)], "inside": [0 <= p <= 1], "none": [all(math.isnan(y) for t in nothing for y in t)], "few": [notes[0]], "fine": [notes[1] is None], "failed": [notes[2]], "two": [abs(two - 2 * min(p, 1 - p)) < 1e-12]})

    return _by(_samples(spark, d), "g", run, "g long, half double, inside boolean, none boolean, few string, fine boolean, failed string, two boolean")


# Histograms, walks and intervals


def _bins(spark, d):
    """Bins of groups with counts of hits at 0..4 differences and misses."""
    w = _walk(spark, d)
    count = lambda i: ((F.col("bin") * (3 + i) + F.col("g") * 5 + F.col("s") * F.col("s")) % (4 + i)).cast("long").alias(f"h{i}" if i < 5 else "miss")
    return w.where("bin < 40").select("g", "bin", *(count(i) for i in range(6)))


H = [f"h{i}" for i in range(5)]
_BINS = f"{_WALK}, hb AS (SELECT g, bin, " + ", ".join(f"CAST((bin * {3 + i} + g * 5 + s * s) % {4 + i} AS BIGINT) AS {'h' + str(i) if i < 5 else 'miss'}" for i in range(6)) + " FROM w WHERE bin < 40)"


def prefix_histogram(spark, d):
    return M.prefix_histograms(_bins(spark, d), ["g"], H)


def histogram_slice(spark, d):
    bins = _bins(spark, d)
    spans = bins.groupBy("g").agg(F.max("bin").alias("last"))
    ranges = spans.select("g", F.lit(0).cast("long").alias("a"), (F.col("last") + 1).alias("b")).unionByName(spans.select("g", F.floor(F.col("last") / 3).alias("a"), (F.floor(F.col("last") / 2) + 1).alias("b")))
    return M.sliced(M.prefix_histograms(bins, ["g"], H), ranges, ["g"], H, 3, F.lit(200).cast("long")).select("g", "a", "b", *H, "t", "u")


def score_walk(spark, d):
    """The score walk and its curvature of each group at one threshold, by the kernel."""
    p = M.MapParams(thresholds=(0.1,), min_length=4)

    def run(x):
        x = x.sort_values("bin")
        s = M._strand(x[H].to_numpy(), x["miss"].to_numpy(), 5000, MODEL, p)
        return pd.DataFrame({"g": x["g"].iloc[0], "i": np.arange(len(x) + 1), "c": s["C"][0].round(5), "s": s["S"][0].round(3)})

    return _by(_bins(spark, d), "g", run, "g long, i long, c double, s double")


def strand_sums(spark, d):
    """Totals of a strand by both ways to count misses: all positions that are no hit, and k-mers that were looked up."""
    full, lite = M.MapParams(min_length=4), M.MapParams(min_length=4, enum_only=True, sample_size=0)

    def run(x):
        x = x.sort_values("bin")
        a, b = (M._strand(x[H].to_numpy(), x["miss"].to_numpy(), 5000, MODEL, p) for p in (full, lite))
        return pd.DataFrame({"g": [x["g"].iloc[0]], "t": [int(a["v"].sum())], "u_all": [a["u"]], "u_seen": [b["u"]]})

    return _by(_bins(spark, d), "g", run, "g long, t long, u_all double, u_seen double")


def genome_accumulator(spark, d):
    """Histograms summed over the closer strands of all queries of a sketch, which lead rows carry."""
    b = _bins(spark, d).groupBy("g").agg(F.array(*(F.sum(h) for h in H)).alias("hist"), F.sum("miss").cast("double").alias("misses"))
    lead = b.select((F.col("g") % 3).cast("string").alias("rid"), F.when(F.col("g") % 4 > 0, F.col("hist")).alias("hist"), "misses")
    return M.genome_sums(lead, 4).select("rid", *(F.get("v", F.lit(i)).alias(h) for i, h in enumerate(H)), "u")


def threshold_rank(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 == 0, math.nan).otherwise((F.col("c_custkey") % 60) / 100.0).alias("dq"))

    def run(x):
        rows = [(k, t, at) for k, q in zip(x["c_custkey"], x["dq"], strict=True) for at, t in enumerate(X.ranks(list(TH), q))]
        return pd.DataFrame(rows, columns=["c_custkey", "t", "at"])

    return _rowwise(c, run, "c_custkey long, t int, at int")


def sign_flip(spark, d):
    w = _walk(spark, d)

    def run(x):
        c = np.concatenate(([0], x.sort_values("bin")["s"].cumsum())).astype(float)
        g = int(x["g"].iloc[0])
        q = math.nan if g % 5 == 0 else g % 40 / 100
        return pd.DataFrame({"g": [g], **{f"t{i}": [float(X.flipped(c, t, q).sum())] for i, t in enumerate((0.1, 0.2, 0.35))}})

    return _by(w, "g", run, "g long, t0 double, t1 double, t2 double")


def interval_gaps(spark, d):
    """What ranges leave of their group's bins."""
    rows = _walk(spark, d).where("bin % 7 = 3 and bin < 60")

    def run(x):
        found = [(int(b), int(b) + 3 + int(b) % 3, 0) for b in sorted(x["bin"])]
        out = X.gaps(found, 64)
        return pd.DataFrame({"g": x["g"].iloc[0], "a": [a for a, _ in out], "b": [b for _, b in out]})

    return _by(rows, "g", run, "g long, a long, b long")


def chi_square_merge(spark, d):
    """Overlapping intervals of each group joined while their common fall is not significantly less steep."""
    rows = _walk(spark, d).where("bin < 48")

    def run(x):
        x = x.sort_values("bin")
        c = np.concatenate(([0], x["s"].cumsum())).astype(float)
        spread = np.arange(len(c), 0, -1).astype(float)
        found = [(a, min(a + 7, len(c) - 1)) for a in range(1, len(c) - 8, 5)]
        out = X.merged(found, c, spread, 9.0)
        return pd.DataFrame({"g": x["g"].iloc[0], "a": [a for a, _ in out], "b": [b for _, b in out]})

    return _by(rows, "g", run, "g long, a long, b long")


def distance_class(spark, d):
    """Bounds of the distance class, with and without a threshold."""
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 == 0, math.nan).otherwise((F.col("c_custkey") % 60) / 100.0).alias("dq"), F.when(F.col("c_custkey") % 5 == 0, math.nan).otherwise((F.col("c_custkey") * 7 % 60) / 100.0).alias("di"))

    def run(x):
        rows = []
        for k, q, v in zip(x["c_custkey"], x["dq"], x["di"], strict=True):
            t = None if k % 9 == 8 else k % 8
            rows.append((k, *X.distance_bin(list(TH), t, q, v)))
        return pd.DataFrame(rows, columns=["c_custkey", "lo", "hi"])

    return _rowwise(c, run, "c_custkey long, lo double, hi double")


def bin_coordinates(spark, d):
    rows = _walk(spark, d).where("bin < 30").select("g", (F.col("bin") + 1).alias("a"))

    def run(x):
        out = [(g, a, last, *X.coordinates(a, a + 2, 3, 240, 27, last)) for g, a in zip(x["g"], x["a"], strict=True) for last in (False, True)]
        return pd.DataFrame(out, columns=["g", "a", "last", "start", "stop"])

    return _rowwise(rows, run, "g long, a long, last boolean, start long, stop long")


def bins_of_length(spark, d):
    """Lengths in bins, and what bins a query has."""
    rows = [(t, b, M.MapParams(min_length=t, bin_shift=b).tau_bin) for b in range(6) for t in (64, 65, 100, 1000, 1001, 5000)]
    return spark.createDataFrame(rows, "t int, b int, bins int")


def map_parameters(spark, d):
    """Which parameters are refused."""

    def refused(**p):
        try:
            M.MapParams(**p)
        except ValueError:
            return True
        return False

    cases = {"none": {}, "two": {"thresholds": (0.1, 0.2)}, "same": {"thresholds": (0.1,) * 8}, "zero": {"thresholds": (0.0,)}, "hdist": {"hdist": 8}, "shift": {"bin_shift": 63}, "length": {"min_length": 7, "bin_shift": 3}, "one_bin": {"min_length": 8, "bin_shift": 3}, "eight": {"thresholds": TH}}
    return spark.createDataFrame([(n, refused(**p)) for n, p in cases.items()], "name string, refused boolean")


def usable_nulls(spark, d):
    """How many windows of its sketch's pool each record can be tested against."""
    li = table(spark, d, "lineitem")
    rows = li.select((F.col("l_suppkey") % 3).cast("string").alias("rid"), (F.col("l_orderkey") % 50).alias("query_id"), (F.col("l_partkey") % 300).alias("a"), (F.col("l_partkey") % 300 + 5 + F.col("l_linenumber")).alias("b"), "l_orderkey", "l_linenumber")
    pool = rows.where("l_orderkey % 3 = 0").select("rid", "query_id", "a", "b")
    return M.usable_nulls(rows.where("l_orderkey % 3 = 1"), pool).select("l_orderkey", "l_linenumber", "n_usable")


def null_windows(spark, d):
    """Windows of the null pool, grown while they have no hit."""
    rows = _walk(spark, d).where("bin < 30").select("g", "bin", F.when((F.col("bin") * 7 + F.col("g")) % 11 == 0, 1).otherwise(0).alias("hit"))

    def run(x):
        prefix = np.concatenate(([0], x.sort_values("bin")["hit"].cumsum()))[:, None]
        out = [(a, X_) for a in range(len(prefix) - 3) if (X_ := M._grown(prefix, a, 3))]
        return pd.DataFrame({"g": x["g"].iloc[0], "x0": [a for a, _ in out], "a": [w[0] for _, w in out], "b": [w[1] for _, w in out]})

    return _by(rows, "g", run, "g long, x0 long, a long, b long")


# Views


def normalise(spark, d):
    n = V.normalise(_result(spark, d))
    return n.select("k", "STRAND", _null("IS_RC").alias("is_rc"), V.is_rc_label(F.col("IS_RC")).alias("label"), *(F.round(_null(c), 9).alias(c.lower()) for c in ("DIST", "DIST_CONTIG", "DIST_GENOME", "distance")))


def plot_mode(spark, d):
    r = _result(spark, d).limit(50)
    nan = F.lit(math.nan)
    cases = [("full", r, False), ("asked", r, True), ("lite", r.withColumns({"DIST": nan, "PERCENTILE": nan}), False), ("tested", r.withColumn("DIST", nan), False), ("legacy", r.select("QUERY_ID", F.lit(0.1).alias("DIST_TH")), False), ("legacy_asked", r.withColumn("DIST_TH", F.lit(0.1)), True), ("both", r.withColumn("DIST_TH", F.lit(0.1)), False)]
    return spark.createDataFrame([(n, V.plot_mode(x, e)) for n, x, e in cases], "name string, mode string")


def flags(spark, d):
    return V.flags(_result(spark, d))


def distance_range(spark, d):
    r = _result(spark, d)
    return V.distance_range(r).unionByName(V.distance_range(r.where("k < 0"))).select(F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"))


def uniform_length(spark, d):
    r = _result(spark, d)
    return V.uniform_length(r).unionByName(V.uniform_length(r.where("SEQ_LEN = 1001")))


def distinct_values(spark, d):
    n = V.normalise(_result(spark, d))
    return V.distances(n).select(F.lit("d").alias("what"), F.round("distance", 9).cast("string").alias("v")).agg(F.count("*").alias("n")).select(F.lit("distance").alias("what"), "n").unionByName(V.identifiers(n).agg(F.count("*").alias("n")).select(F.lit("query").alias("what"), "n"))


def retained_leaves(spark, d):
    return V.retained(_result(spark, d).where("k % 211 = 3"), "q1")


def _viewed(spark, d):
    return V.with_tip_order(V.normalise(_result(spark, d)), _tree(spark, d))


def tip_order(spark, d):
    return _viewed(spark, d).groupBy("REF_ID").agg(F.count("y").alias("n"))


def filter_intervals(spark, d):
    return V.filter_intervals(_viewed(spark, d), "q2", 0.6, 0.1, "rc").select("REF_ID", "INTERVAL_START", "INTERVAL_END", "SEQ_LEN", "IS_RC", F.round("distance", 9).alias("distance"))


def filter_continuous(spark, d):
    f = V.Filters(_viewed(spark, d), enum=False)
    f("q1", "QVALUE", -1.0)
    return f("q1", "PERCENTILE", -0.5, "<1", "+").select("k")


def colour_bins(spark, d):
    r = _result(spark, d)
    lo, hi = V.colour_bounds(0.1, 0.9)
    return r.select("k", V.colour_bin(V.colour_value(r, "dist"), lo, hi).alias("dist"), V.p_bin(V.colour_value(r, "qval")).cast("int").alias("q"), V.p_bin(V.colour_value(r, "pval")).cast("int").alias("p"))


def trace_batches(spark, d):
    r = _viewed(spark, d).where("y is not null").withColumn("bin", V.p_bin(F.col("PERCENTILE")))
    t = V.traces(r, size=1000).select("bin", F.size("start").alias("n"), F.aggregate("end", F.lit(0).cast("long"), lambda a, b: a + b).alias("e"), F.aggregate("mid", F.lit(0.0), lambda a, b: a + b).alias("m"))
    return t.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("e").alias("e"), F.round(F.sum("m"), 1).alias("m"), F.max("n").alias("most"))


def strand_difference_text(spark, d):
    return _result(spark, d).select("k", V.format_strand_diff(F.col("STRAND_DIFF")).alias("t"))


def hover_text(spark, d):
    n = V.normalise(_result(spark, d))
    return n.select("k", V.hover(n, True).alias("continuous"), V.hover(n, False).alias("enum"))


def annotation_text(spark, d):
    a = _gff(spark, d)
    return a.select("contig_id", "start", "stop", "locus_tag", V.annotation_hover(a).alias("t"))


def annotation_tracks(spark, d):
    return V.tracks(_gff(spark, d), 100, 700).select("contig_id", "start", "stop", "track", "strand", F.round("body", 6).alias("body"), "center")


def annotation_range(spark, d):
    return V.overlapping(_gff(spark, d), "c3", 100, 600).select("locus_tag")


def export_rows(spark, d):
    """The rows of an export, written and read again."""
    folder = _place(spark, "export")
    path = V.export(_viewed(spark, d).where("QUERY_ID = 'q1'").select("k", "y", "INTERVAL_START", "INTERVAL_END"), folder, "q1", (2, 9), (100, 500), "_+")
    return spark.read.csv(path, sep="\t", header=True, inferSchema=True).select(F.col("k").cast("long").alias("k"), F.col("INTERVAL_START").cast("long").alias("a"), F.substring_index(F.lit(path), "/", -1).alias("file"))


def axis_ticks(spark, d):
    rows = [(n, w, i) for n in (1, 7, 30, 31, 100, 1000) for w, y in (("all", None), ("window", (3.2, 80.7))) for i in V.ticks(n, y)]
    return spark.createDataFrame(rows, "n int, view string, i int")


def nearest_value(spark, d):
    values = [0.0, 1.0, 2.5, 4.0]
    return spark.createDataFrame([(i, V.nearest(i / 4, values)) for i in range(-4, 21)], "i int, v double")


def zoom_span(spark, d):
    cases = [(10.2, 20.7), (10.0, 10.5), (-50.0, 3.0), (95.0, 140.0), (-500.0, 500.0), (5.0, 5.0)]
    return spark.createDataFrame([(i, *(V.min_span(c, 4, (0, 100)) or (None, None))) for i, c in enumerate(cases)], "i int, lo int, hi int")


# Other surfaces


def sql_functions(spark, d):
    """The engine's functions in SQL."""
    register(spark)
    refs(spark, d).createOrReplaceTempView("kmeridian_refs")
    p = ", ".join(map(str, PPOS))
    return spark.sql(f"SELECT query_id, count(*) AS n, bit_xor(bp) AS x, bit_xor(revcomp(bp, 27)) AS rc, bit_xor(lsh_bucket(bp, array({p}))) AS b, CAST(sum(hamming(bp, 0)) AS BIGINT) AS h FROM kmeridian_refs, LATERAL kmers(seq, 27) GROUP BY query_id")


def stream_histograms(spark, d):
    """Histograms of queries that arrive as a stream, against a static sketch."""
    source, out = _place(spark, "arrivals"), _place(spark, "mapped")
    talk(spark, d).repartition(3).write.parquet(source)
    arrivals = spark.readStream.schema("query_id long, seq string").option("maxFilesPerTrigger", 1).parquet(source)
    map_stream(arrivals, _ref_sketch(spark, d), out, _place(spark, "progress"), 4, 6).awaitTermination()
    return spark.read.parquet(out).drop("rid", "epoch")


QUERIES = {
    f.__name__: f
    for f in (
        sql_functions, stream_histograms,
        fasta_scan, fasta_gzip, fastq_scan, empty_scan, url_predicate, result_text, result_round_trip, gff_sniff, gff_normalise, gff_more_names, custom_annotations, annotation_router, newick_nodes, tree_path_distance, tree_sizes, tree_pruned,
        sketch_info, sketch_merge, sketch_load, rho_exact, rho_estimated, canonical_sketch, canonical_kmers, sketch_rows, row_compaction, short_references, query_diagnostics, binary_sketch, nt4_codes, hamming_planes, extract_bits, random_positions,
        model_scores, model_likelihood, model_probabilities, model_binomials, mle_is_least, valid_distances, threshold_signs, strand_differences, gamma_law, gamma_start, gamma_fit, null_scores,
        prefix_histogram, histogram_slice, score_walk, strand_sums, genome_accumulator, threshold_rank, sign_flip, interval_gaps, chi_square_merge, distance_class, bin_coordinates, bins_of_length, map_parameters, usable_nulls, null_windows,
        normalise, plot_mode, flags, distance_range, uniform_length, distinct_values, retained_leaves, tip_order, filter_intervals, filter_continuous, colour_bins, trace_batches, strand_difference_text, hover_text, annotation_text, annotation_tracks, annotation_range, export_rows, axis_ticks, nearest_value, zoom_span,
    )
}

# SQL

_SEQS = "s AS (SELECT item_id, translate(hex(text), '0123456789ABCDEF', 'ACGTACGTACGTACGT') AS seq FROM benchmark WHERE text IS NOT NULL)"
_SCANNED = f"WITH {_SEQS} SELECT 'r' || item_id AS query_id, 'a comment' AS comment, length(seq) AS len, md5(seq) AS m FROM s WHERE seq <> ''"
_NAN_ = "'NaN'::DOUBLE"
_RES = f"""r AS (SELECT l_orderkey * 8 + l_linenumber AS k, 'q' || l_suppkey % 5 AS query_id, 1000 + l_suppkey % 3 AS seq_len, l_orderkey * 7 % 900 + 1 AS a, l_orderkey * 7 % 900 + 1 + l_partkey % 40 AS b,
  CASE l_orderkey % 5 WHEN 0 THEN '+' WHEN 1 THEN '-' WHEN 2 THEN '.' WHEN 3 THEN '+' ELSE '.' END AS strand,
  CASE l_partkey % 8 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 1.0 WHEN 3 THEN 0.0 WHEN 4 THEN 1.0 WHEN 6 THEN 0.0 WHEN 7 THEN 0.0 END::DOUBLE AS is_rc,
  'NATION_' || l_partkey % 30 AS ref_id, l_partkey % 30 AS nation, CASE WHEN l_suppkey % 11 <> 0 THEN l_quantity / 45 END AS d, l_linenumber AS mask,
  CASE l_linenumber % 4 WHEN 0 THEN '(0, 0.1)' WHEN 1 THEN '(0.1, 0.25)' WHEN 2 THEN 'none' ELSE '(0.1)' END AS d_interval, CASE l_linenumber % 4 WHEN 0 THEN 0.1 WHEN 1 THEN 0.25 END::DOUBLE AS upper, l_discount AS contig, l_tax AS genome,
  CASE l_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'Infinity'::DOUBLE WHEN 2 THEN '-Infinity'::DOUBLE ELSE l_extendedprice / 7 - 3000 END AS diff,
  CASE WHEN l_orderkey % 13 <> 0 THEN pow(l_quantity / 51, 4) END AS p, CASE WHEN l_orderkey % 17 <> 0 THEN l_quantity / 25 END AS fold, CASE WHEN l_orderkey % 13 <> 0 THEN pow(l_quantity / 51, 3) END AS q FROM lineitem),
n AS (SELECT *, CASE WHEN d >= 1e-5 AND d < 1 THEN d END AS dist, CASE WHEN contig >= 1e-5 AND contig < 1 THEN contig END AS dist_contig, CASE WHEN genome >= 1e-5 AND genome < 1 THEN genome END AS dist_genome FROM r),
v AS (SELECT *, coalesce(dist, upper) AS distance FROM n),
tips AS (SELECT n_nationkey AS nation, row_number() OVER (ORDER BY n_regionkey, n_nationkey) - 1 AS y FROM nation), w AS (SELECT v.*, y FROM v LEFT JOIN tips USING (nation))"""
_GF = """g0 AS (SELECT *, s_suppkey AS n, 'c' || s_suppkey % 7 AS contig_id, s_suppkey * 13 % 997 + 50 AS x, s_suppkey * 29 % 997 AS y, s_suppkey % 6 AS i FROM supplier),
g AS (SELECT n, contig_id, CASE i WHEN 0 THEN 'f' || n WHEN 2 THEN s_name WHEN 3 THEN 'l' || n WHEN 4 THEN 'z' ELSE contig_id || '_' || x || '_' || y END AS locus_tag, CASE i WHEN 4 THEN contig_id || '_' || x || '_' || y END AS no_ann_id,
  CASE WHEN n % 3 = 0 THEN 'misc' ELSE 'gene' END AS ftype, least(x, y) AS start, greatest(x, y) AS stop, CASE WHEN n % 4 = 1 THEN '-' ELSE '+' END AS strand,
  CASE i WHEN 0 THEN s_name WHEN 2 THEN s_name WHEN 3 THEN 'A' WHEN 4 THEN 'B' END AS ann_name, CASE i WHEN 3 THEN 'G' END AS gene, CASE i WHEN 1 THEN 'a b' WHEN 2 THEN 'x=y' END AS product, CASE i WHEN 3 THEN '1.1' END AS ec_number FROM g0)"""
_GREST = "'src' AS source, CAST(NULL AS VARCHAR) AS score, '0' AS frame"
_TREE_X = "(n_regionkey + 1) / 2 + n_nationkey + 1"
_CHOOSE = "(factorial({k}) // (factorial(d::INT) * factorial(({k} - d)::INT)))::BIGINT"
_CK = f"ck AS (SELECT d::INT AS d, {_CHOOSE.format(k=27)} AS choose, CASE WHEN d <= 16 THEN (factorial(16) // (factorial(d::INT) * factorial(greatest(16 - d, 0)::INT)))::BIGINT ELSE 0 END AS kept FROM range(28) t(d))"
_GRIDS = "gr AS (SELECT p_partkey, (p_partkey % 97 + 1) / 100.0::DOUBLE AS D, " + ", ".join(f"p_partkey * {7 + i} % 23 AS v{i}" for i in range(5)) + ", p_partkey * 3 % 101 AS u FROM part)"
_MODEL = f"""{_CK}, {_GRIDS},
f AS (SELECT p_partkey, gr.D AS x, ck.d AS d, (CASE WHEN ck.d <= 4 THEN choose - kept ELSE choose END) * pow(gr.D, ck.d) * pow(1 - gr.D, 27 - ck.d) AS w, (ck.d - 27 * gr.D) / (gr.D * (1 - gr.D)) AS g1,
  (ck.d * (2 * gr.D - 1) - 27 * gr.D * gr.D) / (gr.D * gr.D * (1 - gr.D) * (1 - gr.D)) AS g2 FROM gr, ck),
ps AS (SELECT p_partkey, sum(w) AS p0, sum(w * g1) AS p1, sum(w * (g1 * g1 + g2)) AS p2 FROM f GROUP BY p_partkey),
m AS (SELECT gr.*, p0, p1, p2, 0.5 + 0.5 * p0 AS base, 0.5 * p1 / (0.5 + 0.5 * p0) AS su, ((0.5 + 0.5 * p0) * 0.5 * p2 - 0.25 * p1 * p1) / ((0.5 + 0.5 * p0) * (0.5 + 0.5 * p0)) AS cu FROM gr JOIN ps USING (p_partkey))"""
_S = lambda i: f"({i} - 27 * D) / (D * (1 - D))"
_C = lambda i: f"({i} * (2 * D - 1) - 27 * D * D) / (D * D * (1 - D) * (1 - D))"
_THS = "th AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {t}::DOUBLE)" for i, t in enumerate(TH)) + ") t(t, v))"
_AT_SCORE, _AT_CURVE = MODEL.score(0.1).tolist(), MODEL.curvature(0.1).tolist()
_dot = lambda c: " + ".join(f"sum({h}) OVER o * {x!r}::DOUBLE" for h, x in zip([*H, "miss"], c, strict=True))
_F4 = lambda x, how="%.4f": f"coalesce(printf('{how}', {x}), 'nan')"
_SAMPLES = "x AS (SELECT l_suppkey % 20 AS g, l_quantity * l_quantity / 9000 + 0.01::DOUBLE AS x FROM lineitem)"
_RANK = f"CASE WHEN {{p}} IS NULL THEN 0 ELSE least(6, greatest(0, -1 + " + " + ".join(f"({{p}} < {e})::INT" for e in V.P_EDGES) + ")) END"
_HLL = f"""{_Z}, zz AS (SELECT query_id, pos, len, z, min(z) OVER (PARTITION BY query_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS least FROM z),
y AS (SELECT 'all' AS what, query_id, CAST(z & 4294967295::UHUGEINT AS BIGINT) AS y FROM zz WHERE len >= 31 UNION ALL SELECT 'kept', query_id, CAST(least & 4294967295::UHUGEINT AS BIGINT) FROM zz WHERE len >= 31 AND pos >= 4),
reg AS (SELECT what, query_id, y >> 20 AS idx, max(least(20, CASE WHEN (y << 12) & 4294967295 = 0 THEN 32 ELSE 32 - length(bin((y << 12) & 4294967295)) END) + 1) AS reg FROM y GROUP BY ALL),
est AS (SELECT what, query_id, sum(pow(2.0, -reg)) AS s, count(*) AS filled FROM reg GROUP BY ALL),
e AS (SELECT what, CASE WHEN raw <= 2.5 * 4096 AND filled < 4096 THEN 4096 * ln(4096::DOUBLE / (4096 - filled)) ELSE raw END AS n FROM (SELECT *, (0.7213 / (1 + 1.079 / 4096::DOUBLE)) * 4096 * 4096 / (s + 4096 - filled) AS raw FROM est) t)"""

SQL: dict[str, str] = {
    "sql_functions": f"WITH {_REF} SELECT query_id, count(*) AS n, bit_xor(bp) AS x, bit_xor({_RC.format(x='bp')}) AS rc, bit_xor({_BUCKET}) AS b, CAST(sum({_HAM.format(d='bp')}) AS BIGINT) AS h FROM k GROUP BY query_id",
    "stream_histograms": FIRST["bin_histogram"],
    "fasta_scan": _SCANNED, "fasta_gzip": _SCANNED, "fastq_scan": _SCANNED,
    "empty_scan": 'SELECT TRUE AS "none", FALSE AS "some"',
    "url_predicate": "SELECT p_partkey, p_partkey % 3 <> 2 AND p_partkey % 5 IN (2, 4) AS ok FROM part",
    "result_text": f"WITH {_RES} SELECT k, {_F4('d', '%.5g')} AS dist, {_F4('diff', '%.5g')} AS strand_diff, {_F4('p', '%.5g')} AS percentile, {_F4('fold', '%.5g')} AS fold FROM r",
    "result_round_trip": f"""WITH {_RES} SELECT query_id AS "QUERY_ID", mask AS "MASK", count(*) AS n, CAST(sum(b) AS BIGINT) AS e, count(*) FILTER (d IS NULL) AS no_dist, round(sum(CAST(printf('%.5g', fold) AS DOUBLE)), 1) AS fold, count(*) FILTER (diff = 'Infinity'::DOUBLE) AS inf FROM r GROUP BY ALL""",
    "gff_sniff": "SELECT * FROM (VALUES ('gff', TRUE), ('short', FALSE), ('header', FALSE), ('empty', FALSE)) t(name, gff)",
    "gff_normalise": f"WITH {_GF} SELECT contig_id, locus_tag, ftype, start, stop, strand, ann_name, product, ec_number, {_GREST} FROM g",
    "gff_more_names": f"WITH {_GF} SELECT contig_id, coalesce(no_ann_id, locus_tag) AS locus_tag, ftype, start, stop, strand, coalesce(gene, ann_name) AS ann_name, product, ec_number, {_GREST} FROM g",
    "custom_annotations": "SELECT 'c' || s_suppkey % 7 AS contig_id, 't' || s_suppkey AS locus_tag, least(s_suppkey * 13 % 997, s_suppkey * 29 % 997) AS start, greatest(s_suppkey * 13 % 997, s_suppkey * 29 % 997) AS stop, CASE WHEN s_suppkey % 3 = 0 THEN '-' ELSE '+' END AS strand, CASE WHEN s_suppkey % 4 <> 0 THEN 'p' || s_suppkey WHEN s_suppkey % 8 <> 0 THEN 'sw' ELSE 'g' END AS ann_name, CASE WHEN s_suppkey % 5 <> 0 THEN 'prod' END AS product, CAST(NULL AS VARCHAR) AS ec_number FROM supplier",
    "annotation_router": "SELECT 'gff' AS name, count(*) AS n FROM supplier UNION ALL SELECT 'tsv', 1 UNION ALL SELECT 'bad', NULL",
    "newick_nodes": "SELECT n_name AS name, 'R' || n_regionkey AS parent, (n_nationkey + 1)::DOUBLE AS dist, TRUE AS is_leaf FROM nation UNION ALL SELECT DISTINCT 'R' || n_regionkey, 'root', (n_regionkey + 1) / 2, FALSE FROM nation UNION ALL SELECT 'root', NULL, 0, FALSE",
    "tree_path_distance": "SELECT n_name AS name, round(CASE WHEN n_nationkey = 3 THEN 0 WHEN n_regionkey = r THEN n_nationkey + 5 ELSE n_nationkey + 5 + (n_regionkey + 1) / 2 + (r + 1) / 2 END, 6)::DOUBLE AS distance FROM nation, (SELECT n_regionkey AS r FROM nation WHERE n_nationkey = 3) t",
    "tree_sizes": f"SELECT n_name AS name, round({_TREE_X}, 6)::DOUBLE AS x, 1::INT AS leaves FROM nation UNION ALL SELECT 'R' || n_regionkey, round((n_regionkey + 1) / 2, 6), count(*)::INT FROM nation GROUP BY n_regionkey UNION ALL SELECT 'root', 0, count(*)::INT FROM nation",
    "tree_pruned": "SELECT n_name AS name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey <= 4)",
    "sketch_info": f"WITH {_REF}, {_MIN}, {_SK}, t AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT query_id, bp FROM mz)) / (SELECT count(*) FROM (SELECT DISTINCT query_id, bp FROM k WHERE len >= 31)) AS rho, (SELECT count(*) FROM sk) AS n) SELECT rid, 27::INT AS k, 31::INT AS w, 11::INT AS h, 2::BIGINT AS m, 1::BIGINT AS r, TRUE AS frac, 4194304::BIGINT AS nrows, round(rho, 9) AS rho, n AS nkmers FROM t, (VALUES ('ref'), ('other')) v(rid)",
    "sketch_merge": f"WITH {_REF}, {_MIN}, {_SK} SELECT rid, times * count(*) AS n, count(DISTINCT rix) AS buckets FROM sk, (VALUES ('ref', 2), ('other', 1)) v(rid, times) GROUP BY rid, times",
    "sketch_load": f"WITH {_REF}, {_MIN}, {_SK} SELECT 'other' AS rid, count(*) AS n, bit_xor(enc) AS x, bit_xor(rix) AS y FROM sk",
    "rho_exact": f"WITH {_REF}, {_MIN}, {_SK}, t AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT query_id, bp FROM mz)) / (SELECT count(*) FROM (SELECT DISTINCT query_id, bp FROM k WHERE len >= 31)) AS rho) SELECT round(rho, 9) AS rho, round(rho * 2 / 2, 9) AS partial, (SELECT count(*) FROM sk) AS nkmers FROM t",
    "rho_estimated": f"WITH {_REF}, {_HLL} SELECT round(sum(n) FILTER (what = 'kept') / sum(n) FILTER (what = 'all'), 6) AS rho FROM e",
    "canonical_sketch": f"WITH {_REF}, {_MIN}, c AS (SELECT greatest(bp, {_RC.format(x='bp')}) AS bp FROM mz), sk AS (SELECT DISTINCT {_BUCKET} AS rix, {_positions(PARAMS.npos)} AS enc FROM c) SELECT count(*) AS n, bit_xor(enc) AS x, bit_xor(rix) AS y FROM sk",
    "canonical_kmers": f"WITH {_REF} SELECT query_id, count(*) AS n, bit_xor(greatest(bp, {_RC.format(x='bp')})) AS x FROM k GROUP BY query_id",
    "sketch_rows": "SELECT h::INT AS h, m::INT AS m, r::INT AS r, frac, CASE WHEN frac THEN e // m * (r + 1) + least(e % m, r + 1) ELSE e // m + (e % m > r)::INT END::BIGINT AS n FROM (SELECT *, pow(4, h)::BIGINT AS e FROM (VALUES (11), (13), (16)) a(h), (VALUES (1), (2), (3), (7)) b(m), range(7) c(r), (VALUES (TRUE), (FALSE)) f(frac) WHERE r < m) t",
    "row_compaction": "SELECT DISTINCT b, CASE WHEN b % 5 <= 2 THEN b // 5 * 3 + b % 5 END AS frac, CASE WHEN b % 5 = 2 THEN b // 5 END AS one FROM (SELECT l_partkey * 31 + l_linenumber AS b FROM lineitem) t",
    "short_references": f"WITH {_SEQS} SELECT item_id AS query_id, length(seq) - 30 AS n FROM s WHERE item_id % 3 <> 0 AND length(seq) >= 31",
    "query_diagnostics": f"WITH {_SEQS}, q AS (SELECT item_id, least(length(seq), item_id % 40 * 3) AS n FROM s) SELECT 'ref' AS rid, item_id AS query_id, CASE WHEN n < 27 THEN 'short_query' WHEN ceil((n - 26) / 16) < 2 THEN 'few_bins' ELSE 'min_length_above_query' END AS code FROM q WHERE n < 27 OR ceil((n - 26) / 16) < 4",
    "binary_sketch": f"WITH {_REF}, {_MIN}, {_SK}, t AS (SELECT rid, r, rix // 97 * (r + 1) + rix % 97 AS rix, enc FROM sk, (VALUES ('ref', 0), ('other', 1)) v(rid, r) WHERE rix % 97 <= r) SELECT rid, count(*) AS n, bit_xor(enc) AS x, CAST(sum(rix) AS BIGINT) AS y, count(*) AS nkmers, 1234567890::BIGINT AS created_ts FROM t GROUP BY rid",
    "nt4_codes": "WITH c AS (SELECT unnest(string_split(translate(hex(p_name), '0123456789ABCDEF', 'ACGTACGTACNTACGT'), '')) AS c FROM part UNION ALL SELECT p_name[1] FROM part) SELECT CASE upper(c) WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 4 END::INT AS code, count(*) AS n FROM c GROUP BY 1",
    "hamming_planes": "SELECT bit_count((x | (x >> 16)) & 65535)::INT AS d, count(*) AS n FROM (SELECT xor((l_orderkey * 7919 + l_partkey) & 4294967295, (l_suppkey * 104729 + l_linenumber * 65537) & 4294967295) AS x FROM lineitem) t GROUP BY 1",
    "extract_bits": "SELECT l_orderkey, l_linenumber, " + " | ".join(f"(((l_orderkey * 8191 + l_linenumber) >> {p} & 1) << {i})" for i, p in enumerate(b for b in range(20) if 0b1010_0100_1111_0001_0110 >> b & 1)) + " AS x FROM lineitem",
    "random_positions": "SELECT i::INT AS seed, 11::INT AS p, 16::INT AS n, 27::INT AS both, TRUE AS falling, TRUE AS rising, TRUE AS same FROM range(50) t(i)",
    "model_scores": f"WITH {_MODEL} SELECT p_partkey, round({_S(0)}, 6) AS s0, round({_S(2)}, 6) AS s2, round({_S(4)}, 6) AS s4, round(su, 6) AS su, round({_C(0)}, 4) AS c0, round({_C(4)}, 4) AS c4, round(cu, 4) AS cu FROM m",
    "model_likelihood": f"WITH {_MODEL} SELECT p_partkey, round(-(" + " + ".join(f"v{i} * (27 * ln(1 - D) + {i} * ln(D / (1 - D)))" for i in range(5)) + ") - u * ln(base), 5) AS nll, round(-(" + " + ".join(f"v{i} * {_C(i)}" for i in range(5)) + ") - u * cu, 2) AS info FROM m",
    "model_probabilities": f"WITH {_MODEL} SELECT p_partkey, round((choose - kept) / choose, 9) AS collide, round(1 - (choose - kept) / choose, 9) AS elude, round(choose * pow(m.D, ck.d) * pow(1 - m.D, 27 - ck.d), 9) AS mutate, round(base, 9) AS miss, round(0.5 * (1 - p0), 9) AS hit FROM m JOIN ck ON ck.d = p_partkey % 5",
    "model_binomials": f"WITH {_CK} SELECT d, choose, choose - kept AS elude FROM ck",
    "mle_is_least": "SELECT p_partkey, TRUE AS least, TRUE AS within FROM part WHERE p_partkey % 40 = 0",
    "valid_distances": "SELECT p_partkey, d < 0 OR d >= 1 AS bad, CASE WHEN d < 0 OR d >= 1 THEN 0 ELSE d END AS v FROM (SELECT p_partkey, (p_partkey % 13 - 2) / 10::DOUBLE AS d FROM part) t",
    "threshold_signs": "SELECT i::INT AS i, (255 - i)::INT AS positive, i::INT AS negative FROM range(256) t(i)",
    "strand_differences": "SELECT c_custkey, CASE WHEN a IS NULL AND b IS NULL THEN 'nan' WHEN b IS NULL THEN '-inf' WHEN a IS NULL THEN 'inf' ELSE 'finite' END AS kind, round(a - b, 9) AS diff FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 < 2 THEN c_custkey % 50 / 100::DOUBLE END AS a, CASE WHEN c_custkey % 3 < 2 THEN c_custkey * 3 % 50 / 100::DOUBLE END AS b FROM customer) t",
    "gamma_law": "WITH t AS (SELECT p_partkey, p_partkey % 5 + 1 AS n, (p_partkey % 7 + 1) / 50::DOUBLE AS s, (p_partkey % 61 + 1) / 90::DOUBLE AS x FROM part) SELECT p_partkey, round(1 - exp(-x / s) * list_sum([pow(x / s, i) / factorial(i::INT) for i in range(n)]), 9) AS cdf, round(1 - exp(-x / s) * list_sum([pow(x / s, i) / factorial(i::INT) for i in range(n)]), 9) AS cdfs, round(pow(x, n - 1) * exp(-x / s) / (pow(s, n) * factorial((n - 1)::INT)), 7) AS pdf FROM t",
    "gamma_start": f"WITH {_SAMPLES}, t AS (SELECT g, avg(x) AS m, greatest(var_pop(x), 1e-6) AS v, quantile_cont(x, 0.2) AS q0, quantile_cont(x, 0.4) AS q1, quantile_cont(x, 0.6) AS q2 FROM x GROUP BY g) SELECT g, round(greatest(m * m / v, 0.01), 6) AS shape, round(greatest(v / m, 1e-6), 8) AS scale, round(q0, 9) AS q0, round(q1, 9) AS q1, round(q2, 9) AS q2 FROM t",
    "gamma_fit": f"WITH {_SAMPLES} SELECT DISTINCT g, TRUE AS better, TRUE AS same FROM x",
    "null_scores": f"""WITH {_SAMPLES} SELECT DISTINCT g, 0.5::DOUBLE AS half, TRUE AS inside, TRUE AS "none", 'few_nulls' AS few, TRUE AS fine, 'fit_failed' AS failed, TRUE AS two FROM x""",
    "prefix_histogram": f"WITH {_BINS} SELECT g, bin + 1 AS bin, " + ", ".join(f"CAST(sum({h}) OVER o AS BIGINT) AS {h}" for h in H) + " FROM hb WINDOW o AS (PARTITION BY g ORDER BY bin) UNION ALL SELECT DISTINCT g, 0, 0, 0, 0, 0, 0 FROM hb",
    "histogram_slice": f"WITH {_BINS}, l AS (SELECT g, max(bin) AS m FROM hb GROUP BY g), rg AS (SELECT g, 0 AS a, m + 1 AS b FROM l UNION ALL SELECT g, m // 3, m // 2 + 1 FROM l), t AS (SELECT rg.g, a, b, " + ", ".join(f"CAST(coalesce(sum({h}), 0) AS BIGINT) AS {h}" for h in H) + " FROM rg LEFT JOIN hb ON hb.g = rg.g AND bin >= a AND bin < b GROUP BY rg.g, a, b) SELECT *, h0 + h1 + h2 + h3 + h4 AS t, least(b * 8, 200) - least(a * 8, 200) - (h0 + h1 + h2 + h3 + h4) AS u FROM t",
    "score_walk": f"WITH {_BINS} SELECT g, bin + 1 AS i, round({_dot(_AT_SCORE)}, 5) AS c, round({_dot(_AT_CURVE)}, 3) AS s FROM hb WINDOW o AS (PARTITION BY g ORDER BY bin) UNION ALL SELECT DISTINCT g, 0, 0, 0 FROM hb",
    "strand_sums": f"WITH {_BINS} SELECT g, CAST(sum(h0 + h1 + h2 + h3 + h4) AS BIGINT) AS t, 5000 - sum(h0 + h1 + h2 + h3 + h4)::DOUBLE AS u_all, sum(miss)::DOUBLE AS u_seen FROM hb GROUP BY g",
    "genome_accumulator": f"WITH {_BINS} SELECT CAST(g % 3 AS VARCHAR) AS rid, " + ", ".join(f"CAST(sum({h}) AS BIGINT) AS {h}" for h in H) + ", sum(miss)::DOUBLE AS u FROM hb WHERE g % 4 > 0 GROUP BY 1",
    "threshold_rank": f"WITH {_THS}, c AS (SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_custkey % 60 / 100::DOUBLE END AS dq FROM customer) SELECT c_custkey, t::INT AS t, (row_number() OVER (PARTITION BY c_custkey ORDER BY CASE WHEN dq IS NULL OR v <= dq THEN v ELSE 2 - v END) - 1)::INT AS at FROM c, th",
    "sign_flip": f"WITH {_WALK}, c AS (SELECT g, CAST(sum(s) OVER (PARTITION BY g ORDER BY bin) AS DOUBLE) AS c FROM w), t AS (SELECT g, sum(c) AS c, CASE WHEN g % 5 <> 0 THEN g % 40 / 100::DOUBLE END AS q FROM c GROUP BY g) SELECT g, " + ", ".join(f"CASE WHEN {v}::DOUBLE > q THEN -c ELSE c END AS t{i}" for i, v in enumerate((0.1, 0.2, 0.35))) + " FROM t",
    "interval_gaps": f"WITH {_WALK}, f AS (SELECT g, bin AS a, bin + 3 + bin % 3 AS e FROM w WHERE bin % 7 = 3 AND bin < 60), p AS (SELECT *, lag(e, 1, 1) OVER (PARTITION BY g ORDER BY a) AS before FROM f) SELECT g, before AS a, a - 1 AS b FROM p WHERE a > before UNION ALL SELECT g, max(e), 64 FROM f GROUP BY g HAVING max(e) <= 64",
    "chi_square_merge": f"""WITH RECURSIVE {_WALK}, c0 AS (SELECT g, bin + 1 AS i, CAST(sum(s) OVER (PARTITION BY g ORDER BY bin) AS DOUBLE) AS c FROM w WHERE bin < 48), n AS (SELECT g, count(*) AS n FROM c0 GROUP BY g),
iv AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY a) AS rn, a, least(a + 7, n) AS b FROM n, (SELECT 1 + 5 * j AS a FROM range(10) t(j)) x WHERE a < n - 7),
ivc AS (SELECT iv.*, ca.c AS ca, cb.c AS cb FROM iv JOIN c0 ca ON ca.g = iv.g AND ca.i = iv.a JOIN c0 cb ON cb.g = iv.g AND cb.i = iv.b),
m(g, rn, f, cf, l, grp) AS (SELECT g, rn, a, ca, b, 1 FROM ivc WHERE rn = 1 UNION ALL
  SELECT v.g, v.rn, CASE WHEN joins THEN f ELSE a END, CASE WHEN joins THEN cf ELSE ca END, b, CASE WHEN joins THEN grp ELSE grp + 1 END FROM (SELECT ivc.*, f, cf, l, grp, a < l AND ((cb - cf) * (cb - cf) + 1e-7) / (b - f + 1e-7) < 9 AS joins FROM m JOIN ivc ON ivc.g = m.g AND ivc.rn = m.rn + 1) v)
SELECT g, f AS a, max(l) AS b FROM m GROUP BY g, grp, f""",
    "distance_class": f"""WITH {_THS}, c AS (SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_custkey % 60 / 100::DOUBLE END AS dq, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey * 7 % 60 / 100::DOUBLE END AS di, CASE WHEN c_custkey % 9 <> 8 THEN c_custkey % 8 END AS t FROM customer),
x AS (SELECT c.*, th.v, coalesce(di, dq) AS near FROM c LEFT JOIN th ON th.t = c.t),
y AS (SELECT x.*, (SELECT max(v) FROM th WHERE th.v < coalesce(x.v, near)) AS below, (SELECT min(v) FROM th WHERE th.v > x.v) AS above, (SELECT min(v) FROM th WHERE th.v >= near) AS from_near FROM x)
SELECT c_custkey, CASE WHEN v IS NULL THEN coalesce(below, 1e-5) WHEN dq IS NULL OR v <= dq THEN coalesce(below, 1e-5) ELSE v END::DOUBLE AS lo, CASE WHEN v IS NULL THEN coalesce(from_near, 1) WHEN dq IS NULL OR v <= dq THEN v ELSE coalesce(above, 1) END::DOUBLE AS hi FROM y""",
    "bin_coordinates": f"WITH {_WALK} SELECT g, bin + 1 AS a, last, bin * 8 + 1 AS start, CASE WHEN last THEN 266 ELSE least((bin + 2) * 8 + 1, 241) END AS stop FROM w, (VALUES (TRUE), (FALSE)) v(last) WHERE bin < 30",
    "bins_of_length": "SELECT t::INT AS t, b::INT AS b, ((t + (1 << b) - 1) >> b)::INT AS bins FROM (VALUES (64), (65), (100), (1000), (1001), (5000)) v(t), range(6) r(b)",
    "map_parameters": "SELECT * FROM (VALUES ('none', FALSE), ('two', TRUE), ('same', TRUE), ('zero', TRUE), ('hdist', TRUE), ('shift', TRUE), ('length', TRUE), ('one_bin', TRUE), ('eight', FALSE)) t(name, refused)",
    "usable_nulls": "WITH x AS (SELECT l_suppkey % 3 AS rid, l_orderkey % 50 AS q, l_partkey % 300 AS a, l_partkey % 300 + 5 + l_linenumber AS b, l_orderkey, l_linenumber, row_number() OVER () AS n FROM lineitem), p AS (SELECT * FROM x WHERE l_orderkey % 3 = 0), r AS (SELECT * FROM x WHERE l_orderkey % 3 = 1), al AS (SELECT rid, count(*) AS c FROM p GROUP BY rid), o AS (SELECT r.n, count(*) AS c FROM r JOIN p ON r.rid = p.rid AND r.q = p.q AND r.a < p.b AND p.a < r.b GROUP BY r.n) SELECT l_orderkey, l_linenumber, coalesce(al.c, 0) - coalesce(o.c, 0) AS n_usable FROM r LEFT JOIN al USING (rid) LEFT JOIN o USING (n)",
    "null_windows": f"""WITH RECURSIVE {_WALK}, h AS (SELECT g, list(CASE WHEN (bin * 7 + g) % 11 = 0 THEN 1 ELSE 0 END ORDER BY bin) AS h, count(*) AS n FROM w WHERE bin < 30 GROUP BY g),
x(g, x0, a, b, to_right) AS (SELECT g, i, i, i + 3, TRUE FROM h, range(30) t(i) WHERE i < n - 2 UNION ALL
  SELECT g, x0, CASE WHEN r THEN a ELSE a - more END, CASE WHEN r THEN b + more ELSE b END, NOT to_right FROM (SELECT x.*, least(3, least(30, n) - (b - a)) AS more, b + least(3, least(30, n) - (b - a)) <= n AND (to_right OR a < least(3, least(30, n) - (b - a))) AS r FROM x JOIN h USING (g) WHERE list_sum(h[a + 1:b]) = 0 AND b - a < least(30, n)) s WHERE r OR a >= more)
SELECT x.g, x0, a, b FROM x JOIN h USING (g) WHERE list_sum(h[a + 1:b]) > 0""",
    "normalise": f"WITH {_RES} SELECT k, strand AS \"STRAND\", is_rc, CASE is_rc WHEN 1 THEN 'rc' WHEN 0 THEN 'fw' ELSE '?' END AS label, round(dist, 9) AS dist, round(dist_contig, 9) AS dist_contig, round(dist_genome, 9) AS dist_genome, round(distance, 9) AS distance FROM v",
    "plot_mode": "SELECT * FROM (VALUES ('full', 'continuous'), ('asked', 'enum'), ('lite', 'enum'), ('tested', 'continuous'), ('legacy', 'legacy_enum'), ('legacy_asked', 'legacy_enum'), ('both', 'continuous')) t(name, mode)",
    "flags": f"WITH {_RES} SELECT bool_or(strand <> '.') AS has_strand, bool_or(is_rc IS NOT NULL) AS has_is_rc, bool_or(q IS NOT NULL) AS has_qvalue, bool_or(a <> b) AS has_interval, count(*) FILTER (a <> b) AS n_intervals FROM r",
    "distance_range": f"WITH {_RES}, t AS (SELECT greatest(min(d), 1e-5) AS lo, least(max(d), 1 - 1e-5) AS hi FROM r) SELECT round(lo, 9)::DOUBLE AS lo, round(CASE WHEN hi <= lo THEN least(lo + 0.01, 1 - 1e-5) ELSE hi END, 9)::DOUBLE AS hi FROM t UNION ALL SELECT 1e-5, 0.5",
    "uniform_length": "SELECT CAST(NULL AS BIGINT) AS seq_len UNION ALL SELECT 1001",
    "distinct_values": f"WITH {_RES} SELECT 'distance' AS what, count(DISTINCT distance) AS n FROM v UNION ALL SELECT 'query', count(DISTINCT query_id) FROM v",
    "retained_leaves": f'WITH {_RES} SELECT DISTINCT ref_id AS "REF_ID" FROM r WHERE k % 211 = 3 AND query_id = \'q1\' AND a <> b',
    "tip_order": f'WITH {_RES} SELECT ref_id AS "REF_ID", count(y) AS n FROM w GROUP BY ref_id',
    "filter_intervals": f'WITH {_RES} SELECT ref_id AS "REF_ID", a AS "INTERVAL_START", b AS "INTERVAL_END", seq_len AS "SEQ_LEN", is_rc AS "IS_RC", round(min(distance), 9) AS distance FROM w WHERE query_id = \'q2\' AND is_rc = 1 AND y IS NOT NULL GROUP BY ref_id, a, b, seq_len, is_rc HAVING min(distance) BETWEEN 0.1 AND 0.6',
    "filter_continuous": f"WITH {_RES} SELECT k FROM w WHERE query_id = 'q1' AND p <= {10.0**-0.5!r} AND fold < 1 AND strand = '+' AND y IS NOT NULL",
    "colour_bins": f"WITH {_RES} SELECT k, CASE WHEN d IS NULL THEN 0 ELSE least(64, floor(least(1, greatest(0, (d - 0.1) / {0.9 - 0.1!r}::DOUBLE)) * 63)::INT + 1) END::INT AS dist, ({_RANK.format(p='q')})::INT AS q, ({_RANK.format(p='p')})::INT AS p FROM r",
    "trace_batches": f"WITH {_RES}, t AS (SELECT ({_RANK.format(p='p')})::INT AS bin, a, b FROM w WHERE y IS NOT NULL AND a <> b) SELECT bin, count(*) AS n, CAST(sum(b) AS BIGINT) AS e, round(sum((a + b) / 2), 1) AS m, least(count(*), 1000)::INT AS most FROM t GROUP BY bin",
    "strand_difference_text": f"WITH {_RES} SELECT k, CASE WHEN diff = 'Infinity'::DOUBLE THEN 'rc only' WHEN diff = '-Infinity'::DOUBLE THEN 'fw only' ELSE printf('%.4g', diff) END AS t FROM r",
    "hover_text": f"""WITH {_RES}, h AS (SELECT *, ref_id || ' (' || strand || ' ' || CASE strand WHEN '+' THEN 'closer' WHEN '-' THEN 'farther' ELSE 'unknown' END || ')<br>Pos: ' || format('{{:,}}', a) || '-' || format('{{:,}}', b) || '<br>Dist: ' AS head, '  dir: ' || CASE is_rc WHEN 1 THEN 'rc' WHEN 0 THEN 'fw' ELSE '?' END AS dir FROM v)
SELECT k, head || {_F4('dist')} || dir || '  p: ' || {_F4('p', '%.3e')} || '  q: ' || {_F4('q', '%.3e')} || '  fold: ' || {_F4('fold', '%.3f')} || '<br>Contig: ' || {_F4('dist_contig')} || '  Genome: ' || {_F4('dist_genome')} || coalesce('  d_diff: ' || CASE WHEN diff = 'Infinity'::DOUBLE THEN 'rc only' WHEN diff = '-Infinity'::DOUBLE THEN 'fw only' ELSE printf('%.4g', diff) END, '') || '  D-int: ' || d_interval AS continuous,
head || {_F4('distance')} || dir || '  mask: ' || mask || '  D-int: ' || d_interval AS "enum" FROM h""",
    "annotation_text": f"""WITH {_GF} SELECT contig_id, start, stop, locus_tag, '<b>' || locus_tag || '</b><br><i>' || ftype || '</i><br>Position: ' || format('{{:,}}', start) || ' – ' || format('{{:,}}', stop) || '<br>Length: ' || format('{{:,}}', stop - start) || ' bp  ' || strand || CASE strand WHEN '+' THEN ' →' ELSE ' ←' END || coalesce('<br><b>Gene:</b> ' || ann_name, '') || coalesce('<br><b>EC:</b> ' || ec_number, '') || coalesce('<br><b>Product:</b> ' || product, '') AS t FROM g""",
    "annotation_tracks": f"WITH {_GF}, h AS (SELECT *, greatest(6, greatest(stop - start, 1) * 0.125::DOUBLE) AS head FROM g WHERE stop >= 100 AND start <= 700) SELECT contig_id, start, stop, CASE ftype WHEN 'gene' THEN 0 ELSE 1 END::INT AS track, strand, round(CASE WHEN strand = '+' THEN CASE WHEN stop - head > start THEN stop - head END ELSE CASE WHEN start + head < stop THEN start + head END END, 6)::DOUBLE AS body, (start + stop) / 2 AS center FROM h",
    "annotation_range": f"WITH {_GF} SELECT locus_tag FROM g WHERE contig_id = 'c3' AND stop >= 100 AND start <= 600",
    "export_rows": f"WITH {_RES} SELECT k, a, 'q1_+_y2-9_x100-500.tsv' AS file FROM w WHERE query_id = 'q1' AND y BETWEEN 2 AND 9 AND b >= 100 AND a <= 500",
    "axis_ticks": """WITH n AS (SELECT * FROM (VALUES (1), (7), (30), (31), (100), (1000)) t(n)), al AS (SELECT n, unnest(list_distinct(list_append(range(0, n, greatest(1, n // 30)), n - 1))) AS i FROM n),
wi AS (SELECT n, least(3, n - 1) AS lo, least(81, n - 1) AS hi FROM n), wl AS (SELECT n, unnest(range(lo, hi + 1, CASE WHEN hi - lo + 1 > 30 THEN (hi - lo + 1) // 30 ELSE 1 END)) AS i FROM wi)
SELECT n::INT AS n, 'all' AS view, i::INT AS i FROM al UNION ALL SELECT n::INT, 'window', i::INT FROM wl""",
    "nearest_value": "SELECT i::INT AS i, (SELECT v FROM (VALUES (0.0), (1.0), (2.5), (4.0)) t(v) ORDER BY abs(v - i / 4), v DESC LIMIT 1)::DOUBLE AS v FROM range(-4, 21) r(i)",
    "zoom_span": "SELECT * FROM (VALUES (0, 10, 21), (1, 8, 13), (2, 0, 53), (3, 55, 100), (4, 0, 100), (5, 0, 100)) t(i, lo, hi)",
}
