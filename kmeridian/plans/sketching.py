"""Sketches: LSH-bucketed tables of a reference's minimizers. One sketch is one rid; a set of sketches is two tables."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kmeridian.functions import encode as E
from kmeridian.operators.kmers import apart_by_id, hll_estimate, hll_of_sums, hll_registers, hll_sums, kmers, minimizers, windows
from kmeridian.operators.ranks import running_total
from kmeridian.session import saved, ship, shuffle_width

META = "rid string, created_ts long, k int, w int, h int, m long, r long, frac boolean, nrows long, ppos array<int>, npos array<int>, rho double, nkmers long"


@dataclass(frozen=True)
class SketchParams:
    """k 19..31, w >= k, h 3..16 with k - h <= 16. As in the original interface w defaults to k + 6, and h to k - 16
    whenever w is not given."""

    k: int = 27
    w: int | None = None
    h: int | None = None
    m: int = 2
    r: int = 1
    frac: bool = True
    seed: int = 0
    ppos: tuple[int, ...] = field(default=())
    canonical: bool = False  # keep the larger of a k-mer and its reverse complement; mapping must be told the same
    compat: bool = False  # minimizers of windows that reach over breaks

    def __post_init__(self):
        put = lambda n, v: object.__setattr__(self, n, v)
        if self.w is None:
            put("h", self.k - 16)
            put("w", self.k + 6)
        elif self.h is None:
            put("h", 11)
        if not self.ppos:
            put("ppos", tuple(E.random_positions(self.k, self.h, self.seed)[0]))
        if not (19 <= self.k <= 31 and self.w >= self.k and 3 <= self.h <= 16 and self.k - self.h <= 16 and self.m >= 1 and 0 <= self.r < self.m and len(set(self.ppos)) == self.h):
            raise ValueError(f"sketch parameters out of range: {self}")

    @property
    def npos(self) -> tuple[int, ...]:
        return tuple(sorted(set(range(self.k)) - set(self.ppos)))

    @property
    def nrows(self) -> int:
        """Buckets kept of all 4^h."""
        every = 4**self.h
        whole, over = divmod(every, self.m)
        return whole * (self.r + 1) + min(over, self.r + 1) if self.frac else whole + (over > self.r)


def in_partition(bucket: Column, m: int, r: int, frac: bool = True) -> Column:
    return bucket % m <= r if frac else bucket % m == r


def compact(bucket: Column, m: int, r: int, frac: bool = True) -> Column:
    """The row of a kept bucket; null outside the partition."""
    row = F.floor(bucket / m) * (r + 1) + bucket % m if frac else F.floor(bucket / m)
    return F.when(in_partition(bucket, m, r, frac), row.cast("long"))


def keyed(df: DataFrame, p: SketchParams, bp: str = "bp") -> DataFrame:
    """df with rix and enc of its k-mers, without those outside the partition."""
    bucket = E.lsh_bucket(F.col(bp), p.ppos)
    return df.withColumns({"rix": compact(bucket, p.m, p.r, p.frac), "enc": E.rest(F.col(bp), p.npos)}).where("rix is not null")


#: Minimizers that a kernel holds before it deals them out, and shares of buckets, by a hash, that they go to.
HELD, SHARES = 2_000_000, 1024


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys as compressed differences, their bytes by place."""
    return pa.compress(np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T), "zstd", asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _by_share(seqs: DataFrame, p: SketchParams, bases, of, schema: str) -> DataFrame:
    """of(sorted distinct keys, rix and enc in one number) of the minimizers of seqs, share by share. Kernels deal out sorted keys
    by bucket, packed, not a row for each minimizer."""
    ship(seqs.sparkSession)
    low = np.uint64(2 * len(p.npos))

    def dealt(held: list[np.ndarray]) -> pa.RecordBatch:
        bp = _distinct(np.concatenate(held))
        bucket = E.gather(bp, p.ppos)
        over, m, r = bucket % np.uint64(p.m), np.uint64(p.m), np.uint64(p.r)
        inside = over <= r if p.frac else over == r
        row = bucket // m * (r + np.uint64(1)) + over if p.frac else bucket // m
        keys = np.sort(row[inside] << low | E.gather(bp[inside], p.npos))
        share = (E.mixed(keys >> low) % np.uint64(SHARES)).astype(np.int16)
        keys, sizes = keys[np.argsort(share, kind="stable")], np.bincount(share, minlength=SHARES)
        at = np.flatnonzero(sizes)
        ends = np.cumsum(sizes)
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sizes[at]), pa.array([_packed(keys[ends[i] - sizes[i] : ends[i]]) for i in at], pa.binary())], ["share", "size", "keys"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for b in batches:
            for s in b.column("seq").to_pylist():
                codes = bases(s)
                if len(codes) >= p.w:
                    pos, bp = E.encode_all(codes, p.k, np.asarray)
                    found = bp[windows(pos, bp, p.k, p.w, len(codes))[1]]
                    if len(found):
                        held.append(found[np.concatenate(([True], found[1:] != found[:-1]))])
                        total += len(held[-1])
                if total >= HELD:
                    yield dealt(held)
                    held, total = [], 0
        if held:
            yield dealt(held)

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, total = [], None, 0
        for b in batches:
            for share, size, keys in zip(*(b.column(c).to_pylist() for c in ("share", "size", "keys")), strict=True):
                if share != last and held:
                    yield of(_distinct(np.concatenate(held)))
                    held, total = [], 0
                held.append(_unpacked(keys, size))
                last, total = share, total + size
                if len(held) > 1 and total >= HELD:
                    held = [_distinct(np.concatenate(held))]
                    total = 0
        if held:
            yield of(_distinct(np.concatenate(held)))

    laid = seqs.select("seq").mapInArrow(deal, "share int, size long, keys binary").repartition(shuffle_width(seqs.sparkSession), "share").sortWithinPartitions("share")
    return laid.mapInArrow(shares, schema)


def distinct_sums(seqs: DataFrame, p: SketchParams, bases=E.letters) -> DataFrame:
    """One row of the distinct (rix, enc) of all minimizers of seqs: n, buckets (distinct rix), x and y (enc and rix, each
    combined by exclusive or)."""
    low = np.uint64(2 * len(p.npos))

    def sums(keys: np.ndarray) -> pa.RecordBatch:
        rix, enc = keys >> low, keys & ((np.uint64(1) << low) - np.uint64(1))
        found = (len(keys), 1 + np.count_nonzero(rix[1:] != rix[:-1]), np.bitwise_xor.reduce(enc), np.bitwise_xor.reduce(rix))
        return pa.RecordBatch.from_arrays([pa.array([int(v)], pa.int64()) for v in found], ["n", "buckets", "x", "y"])

    found = _by_share(seqs, p, bases, sums, "n long, buckets long, x long, y long")
    return found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("buckets"), F.lit(0)).alias("buckets"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))


def distinct_rows(seqs: DataFrame, rid: str, p: SketchParams, bases=E.letters) -> DataFrame:
    """rid, rix and enc, the distinct ones of all minimizers of seqs."""
    low = np.uint64(2 * len(p.npos))

    def rows(keys: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array((keys >> low).view(np.int64)), pa.array((keys & ((np.uint64(1) << low) - np.uint64(1))).view(np.int64))], ["rix", "enc"])

    return _by_share(seqs, p, bases, rows, "rix long, enc long").select(F.lit(rid).alias("rid"), "rix", "enc")


def build(seqs: DataFrame, rid: str, p: SketchParams, created_ts: int | None = None, distinct: str = "hll") -> tuple[DataFrame, DataFrame]:
    """(meta, k-mers) of one reference (query_id, seq). rho: distinct minimizers over distinct k-mers, summed over
    sequences; distinct: hll (registers), or exact."""
    ship(seqs.sparkSession)
    long_enough = seqs.where(F.length("seq") >= p.w)
    if distinct == "exact" or p.canonical or p.compat:
        return _finished(rid, p, created_ts, *_by_rows(long_enough, rid, p, distinct))
    one, several = apart_by_id(long_enough.select("query_id", "seq"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for x in b.column("seq").to_pylist():
                pos, bp = E.encode_all(x, p.k)
                found.append((*hll_sums(bp), *hll_sums(bp[windows(pos, bp, p.k, p.w, len(x))[1]])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], ["s", "full", "s2", "full2"])

    each = one.select("seq").mapInArrow(sums, "s double, full long, s2 double, full2 long")
    estimate = lambda s, n: hll_of_sums(each.select(F.col(s).alias("s"), F.col(n).alias("full")).where("full > 0")).select("estimate")
    each = saved(each)
    every, kept = (estimate(*c).agg(F.sum("estimate")).first()[0] or 0.0 for c in (("s", "full"), ("s2", "full2")))
    if several is not None:
        more = _by_rows(several, rid, p, distinct)
        every, kept = every + more[0], kept + more[1]
    return _finished(rid, p, created_ts, every, kept, saved(distinct_rows(long_enough, rid, p)))


def _by_rows(long_enough: DataFrame, rid: str, p: SketchParams, distinct: str) -> tuple[float, float, DataFrame]:
    """(distinct k-mers, distinct minimizers, both summed over ids, k-mers of the sketch), with a row for each k-mer."""
    chosen = minimizers(long_enough, p.k, p.w, compat=p.compat).select("query_id", "bp").distinct()
    chosen = saved(chosen)

    def counted(df: DataFrame) -> DataFrame:
        if distinct == "exact":
            return df.groupBy("query_id").agg(F.count_distinct("bp").cast("double").alias("estimate"))
        return hll_estimate(hll_registers(df.withColumn("z", E.mix_kernel()(F.col("bp"))), by=("query_id",)), ("query_id",))

    every = counted(kmers(long_enough, p.k).select("query_id", "bp")).agg(F.sum("estimate")).first()[0] or 0.0
    kept = counted(chosen).agg(F.sum("estimate")).first()[0] or 0.0
    larger = F.greatest("bp", E.reverse_complement(F.col("bp"), p.k)) if p.canonical else F.col("bp")
    return every, kept, saved(keyed(chosen.withColumn("bp", larger), p).select(F.lit(rid).alias("rid"), "rix", "enc").distinct())


def _finished(rid: str, p: SketchParams, created_ts: int | None, every: float, kept: float, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    rho = kept / every if every else 0.0
    meta = (rid, int(time.time()) if created_ts is None else created_ts, p.k, p.w, p.h, p.m, p.r, p.frac, p.nrows, list(p.ppos), list(p.npos), rho, rows.count())
    return rows.sparkSession.createDataFrame([meta], META), rows


def partial_rho(rho: Column, m: Column, r: Column, frac: Column) -> Column:
    return rho * F.when(frac, (r + 1) / m).otherwise(1 / m)


def merge(*sketches: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """All sketches in one pair of tables; rows are kept as they are, duplicates included."""
    meta, rows = sketches[0]
    for m, r in sketches[1:]:
        meta, rows = meta.unionByName(m), rows.unionByName(r)
    return meta, rows


def save(sketch: tuple[DataFrame, DataFrame], path: str) -> None:
    sketch[0].write.mode("append").parquet(f"{path}/meta")
    sketch[1].sortWithinPartitions("rix", "enc").write.mode("append").partitionBy("rid").parquet(f"{path}/kmers")


def load(spark: SparkSession, path: str, rids: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The tables at path; rids prunes partitions. Reading meta alone touches no k-mer."""
    meta, rows = spark.read.parquet(f"{path}/meta"), spark.read.parquet(f"{path}/kmers").select("rid", "rix", "enc")
    return (meta.where(F.col("rid").isin(rids)), rows.where(F.col("rid").isin(rids))) if rids is not None else (meta, rows)


def is_empty(sequences: DataFrame) -> bool:
    return sequences.isEmpty()


def info(meta: DataFrame) -> DataFrame:
    return meta.select("rid", F.from_unixtime("created_ts").alias("created"), "k", "w", "h", "m", "r", "frac", "nrows", "rho", "nkmers")


def bucket_offsets(rows: DataFrame) -> DataFrame:
    """rid, rix, size and inclusive end of each bucket in bucket order."""
    return running_total(rows.groupBy("rid", "rix").agg(F.count("*").alias("size")), ["rid"], ["rix"], "size", "end")


def csr(rows: DataFrame, most: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Sorted (rix, enc) by rid for the broadcast kernel: sketches from small to large while they have at most `most` k-mers
    together, by their counts. The others are left out."""
    small, total = [], 0
    for r in rows.groupBy("rid").count().orderBy("count", "rid").collect():  # a row a sketch
        total += r["count"]
        if total > most:
            break
        small.append(r["rid"])
    out = {}
    for rid in small:
        t = rows.where(F.col("rid") == rid).select("rix", "enc").toArrow()
        rix, enc = (t.column(c).to_numpy() for c in ("rix", "enc"))
        order = np.lexsort((enc, rix))
        out[rid] = (rix[order], enc[order])
    return out
