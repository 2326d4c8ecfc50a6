"""Mapping queries to sketches: LSH join, histograms, distances, intervals, significance.

Sketches that are small together, by their counts, are broadcast; a kernel then searches and bins each query sequence where it
is, without a shuffle. Larger ones are joined: query k-mers are encoded once, distinct pairs of bucket and rest are joined to
all such sketches at once. Sums, ranks and tests stay in DataFrames.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kmeridian.functions import encode as E
from kmeridian.functions.text import significant
from kmeridian.functions.model import Gamma, Model, fit_gammas, medians, score_samples, valid_distance
from kmeridian.operators import intervals as X
from kmeridian.operators.kmers import kmers
from kmeridian.operators.ranks import q_values
from kmeridian.plans import totals as T
from kmeridian.plans.sketching import compact, csr, partial_rho
from kmeridian.session import saved, ship, shuffle_width

#: k-mers of sketches that are broadcast together, at most: 16 bytes each.
KERNEL_ROWS = 8_000_000
#: k-mers of sequences that the kernel takes at once, about, and pairs that it compares at once.
CHUNK, PAIRS = 500_000, 2_000_000
#: Shares of null windows whose first ones are found apart.
POOL_SHARES = 64
COLUMNS = ("QUERY_ID", "SEQ_LEN", "INTERVAL_START", "INTERVAL_END", "STRAND", "IS_RC", "REF_ID", "DIST", "MASK", "D_INTERVAL", "DIST_CONTIG", "STRAND_DIFF", "DIST_GENOME", "PERCENTILE", "FOLD", "QVALUE")


@dataclass(frozen=True)
class MapParams:
    thresholds: tuple[float, ...] = (0.1,)
    min_length: int = 1000
    hdist: int = 4
    chisq: float = 33.00051
    bin_shift: int = 0
    enum_only: bool = False
    sample_size: int = 200
    seed: int = 0
    by_position: bool = False

    def __post_init__(self):
        size = 1 << self.bin_shift
        if len(self.thresholds) not in (1, 8) or len(set(self.thresholds)) != len(self.thresholds) or min(self.thresholds) <= 0:
            raise ValueError("one or eight distinct positive thresholds are needed")
        if not 0 <= self.hdist <= 7 or not 0 <= self.bin_shift < 63 or self.min_length < size or -(-self.min_length // size) < 2 or self.sample_size < 0:
            raise ValueError(f"mapping parameters out of range: {self}")

    @property
    def tau_bin(self) -> int:
        return -(-self.min_length // (1 << self.bin_shift))

    @property
    def coordinates_only(self) -> bool:
        return self.enum_only and not self.sample_size


def strands(queries: DataFrame, k: int, canonical: bool = False) -> DataFrame:
    """query_id, pos, is_rc, bp of both strands' k-mers; canonical: the larger of the two, as strand 0."""
    if canonical:
        return kmers(queries, k).select("query_id", "pos", F.lit(0).alias("is_rc"), F.greatest("bp", "rc").alias("bp"))
    both = F.explode(F.array(F.struct(F.lit(0).alias("is_rc"), F.col("bp")), F.struct(F.lit(1).alias("is_rc"), F.col("rc").alias("bp")))).alias("s")
    return kmers(queries, k).select("query_id", "pos", both).select("query_id", "pos", "s.is_rc", "s.bp")


def _split(meta: DataFrame, rows: DataFrame, kernel_rows: int) -> tuple[list[dict], list[dict]]:
    """(sketches to be broadcast, with their sorted k-mers; the others), each as its row of meta."""
    tables = csr(rows, kernel_rows) if kernel_rows else {}
    every = [r.asDict() for r in meta.collect()]  # a row a sketch
    return [s | {"rix": tables[s["rid"]][0], "enc": tables[s["rid"]][1]} for s in every if s["rid"] in tables], [s for s in every if s["rid"] not in tables]


def _search(s: dict, bp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which k-mers lie in the sketch's partition, their least distances, 99 for an empty bucket)."""
    distinct, at = np.unique(bp, return_inverse=True)
    bucket = E.gather(distinct, s["ppos"]).astype(np.int64)
    over = bucket % s["m"]
    inside = np.flatnonzero(over <= s["r"] if s["frac"] else over == s["r"])
    row = bucket[inside] // s["m"] * (s["r"] + 1) + over[inside] if s["frac"] else bucket[inside] // s["m"]
    best = np.full(len(distinct), -1, np.int32)
    best[inside] = _least(s["rix"], s["enc"].view(np.uint64), row, E.gather(distinct[inside], s["npos"]))
    hd = best[at]
    kept = np.flatnonzero(hd >= 0)
    return kept, hd[kept]


def _least(rix: np.ndarray, enc: np.ndarray, row: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The least distance of each k-mer to its bucket, 99 if that is empty. What a bucket holds exactly is found by search; other
    pairs are compared in blocks."""
    lo, hi = np.searchsorted(rix, row, "left"), np.searchsorted(rix, row, "right")
    best = np.full(len(row), 99, np.int32)
    low, high = lo.copy(), hi.copy()
    while (open_ := low < high).any():  # enc is sorted within a bucket
        mid = (low + high) // 2
        less = open_ & (enc[np.minimum(mid, len(enc) - 1)] < own)
        low, high = np.where(less, mid + 1, low), np.where(open_ & ~less, mid, high)
    best[(low < hi) & (enc[np.minimum(low, max(len(enc) - 1, 0))] == own) if len(enc) else np.zeros(len(row), bool)] = 0
    left = np.flatnonzero((lo < hi) & (best > 0))
    ends = np.cumsum(hi[left] - lo[left])
    cut = 0
    while cut < len(left):
        to = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + PAIRS, "right")))
        part = left[cut:to]
        n = hi[part] - lo[part]
        first = np.cumsum(n) - n
        d = enc[np.arange(n.sum()) + np.repeat(lo[part] - first, n)] ^ np.repeat(own[part], n)
        best[part] = np.minimum.reduceat(np.bitwise_count((d | (d >> np.uint64(1))) & np.uint64(E.EVEN)), first)
        cut = to
    return best


def _chunks(b: pa.RecordBatch, ks: set[int], canonical: bool) -> Iterator[tuple[list[int], dict[int, tuple[np.ndarray, ...]]]]:
    """(rows, by k: row, strand, position and bp of all their k-mers): sequences in order, about CHUNK k-mers at once."""
    rows, held, total = [], {k: [] for k in ks}, 0
    seqs = b.column("seq").to_pylist()
    for i, seq in enumerate(seqs):
        rows.append(i)
        for k in ks:
            pos, bp = E.encode_all(seq, k)
            rc = E.reverse_complements(bp, k)
            n = len(pos)
            for strand, x in enumerate([np.maximum(bp, rc)] if canonical else [bp, rc]):
                held[k].append((np.full(n, i, np.int64), np.full(n, strand, np.int32), pos, x))
            total += 2 * n
        if total >= CHUNK or i == len(seqs) - 1:
            yield rows, {k: tuple(np.concatenate(c) for c in zip(*parts, strict=True)) for k, parts in held.items()}
            rows, held, total = [], {k: [] for k in ks}, 0


def _found(sketches: list[dict], b: pa.RecordBatch, canonical: bool) -> Iterator[tuple[list[int], dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of the batch, sketch, row, strand, position and least distance of all k-mers in its partition), in order."""
    for rows, by_k in _chunks(b, {s["k"] for s in sketches}, canonical):
        for s in sketches:
            owner, strand, pos, bp = by_k[s["k"]]
            inside, hd = _search(s, bp)
            yield rows, s, owner[inside], strand[inside], pos[inside], hd


def _joined(queries: DataFrame, sketches: list[dict], rows: DataFrame, canonical: bool) -> list[DataFrame]:
    """Least distances by joins, a table for each way to hash."""
    alike: dict[tuple, list[str]] = {}
    for s in sketches:
        alike.setdefault((s["k"], tuple(s["ppos"]), tuple(s["npos"]), s["m"], s["r"], s["frac"]), []).append(s["rid"])
    out = []
    for (k, ppos, npos, m, r, frac), rids in alike.items():
        keyed = strands(queries, k, canonical).withColumns({"rix": compact(E.lsh_bucket(F.col("bp"), ppos), m, r, frac), "enc": E.rest(F.col("bp"), npos)})
        keyed = saved(keyed.where("rix is not null").drop("bp"))  # else the kernel ran for each side of the join
        own = rows.where(F.col("rid").isin(rids)).select("rid", F.col("rix").alias("_rix"), F.col("enc").alias("_enc"))
        pairs = keyed.select("rix", "enc").distinct().join(own, F.col("rix") == F.col("_rix"))
        least = pairs.groupBy("rid", "rix", "enc").agg(F.min(E.hamming(F.col("enc"), F.col("_enc"))).cast("int").alias("hd"))
        each = keyed.withColumn("rid", F.explode(F.array(*map(F.lit, rids))))
        out.append(each.join(least, ["rid", "rix", "enc"], "left").select("rid", "query_id", "is_rc", "pos", "hd"))
    return out


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def least_distances(queries: DataFrame, meta: DataFrame, rows: DataFrame, kernel_rows: int = KERNEL_ROWS, canonical: bool = False) -> DataFrame:
    """rid, query_id, is_rc, pos, hd: the least Hamming distance in a k-mer's bucket, null for an empty bucket. k-mers
    outside a sketch's partition give no row. Sketches of at most kernel_rows k-mers together are searched by the kernel."""
    small, large = _split(meta, rows, kernel_rows)
    parts = _joined(queries, large, rows, canonical)
    if small or not large:
        shared = queries.sparkSession.sparkContext.broadcast(small)  # its size was checked
        ship(queries.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for _, s, owner, strand, pos, hd in _found(shared.value, b, canonical):
                    names = ["rid", "query_id", "is_rc", "pos", "hd"]
                    yield pa.RecordBatch.from_arrays([pa.array([s["rid"]] * len(pos), pa.string()), b.column("query_id").take(pa.array(owner)), pa.array(strand), pa.array(pos.astype(np.int64)), pa.array(hd, mask=hd == 99)], names)

        parts.append(queries.select("query_id", "seq").mapInArrow(run, f"rid string, query_id {dict(queries.dtypes)['query_id']}, is_rc int, pos long, hd int"))
    return _union(parts)


def _binned(owner: np.ndarray, strand: np.ndarray, pos: np.ndarray, hd: np.ndarray, hdist: int, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, strand, bin, counts by distance with misses last) of all bins that have k-mers, in order."""
    bins = pos >> shift
    span = int(bins.max(initial=0)) + 1
    key, at = np.unique((owner * 2 + strand) * span + bins, return_inverse=True)
    counts = np.bincount(at * (hdist + 2) + np.minimum(hd, hdist + 1), minlength=len(key) * (hdist + 2)).reshape(-1, hdist + 2)
    return key // span // 2, key // span % 2, key % span, counts


def query_histograms(queries: DataFrame, meta: DataFrame, rows: DataFrame, hdist: int = 4, bin_shift: int = 0, kernel_rows: int = KERNEL_ROWS, canonical: bool = False) -> DataFrame:
    """histograms of least_distances; the kernel counts a sequence's bins itself."""
    small, large = _split(meta, rows, kernel_rows)
    names = [*(f"h{d}" for d in range(hdist + 1)), "miss"]
    parts = [histograms(d, hdist, bin_shift) for d in _joined(queries, large, rows, canonical)]
    if small or not large:
        shared = queries.sparkSession.sparkContext.broadcast(small)  # its size was checked
        ship(queries.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for _, s, *found in _found(shared.value, b, canonical):
                    owner, strand, bins, counts = _binned(*found, hdist, bin_shift)
                    yield pa.RecordBatch.from_arrays([pa.array([s["rid"]] * len(bins), pa.string()), b.column("query_id").take(pa.array(owner)), pa.array(strand.astype(np.int32)), pa.array(bins), *map(pa.array, np.ascontiguousarray(counts.T))], ["rid", "query_id", "is_rc", "bin", *names])

        counted = queries.select("query_id", "seq").mapInArrow(run, f"rid string, query_id {dict(queries.dtypes)['query_id']}, is_rc int, bin long, " + ", ".join(f"{n} long" for n in names))
        parts.append(counted.groupBy("rid", "query_id", "is_rc", "bin").agg(*(F.sum(n).alias(n) for n in names)))  # repeated ids count together
    return _union(parts)


def histograms(distances: DataFrame, hdist: int = 4, bin_shift: int = 0) -> DataFrame:
    """rid, query_id, is_rc, bin, h0..h<hdist>, miss."""
    hits = [F.count_if(F.col("hd") == d).alias(f"h{d}") for d in range(hdist + 1)]
    return distances.withColumn("bin", F.shiftright("pos", bin_shift)).groupBy("rid", "query_id", "is_rc", "bin").agg(*hits, F.count_if(F.col("hd").isNull() | (F.col("hd") > hdist)).alias("miss"))


def dense(bins: DataFrame, spans: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """bins with a row for every bin 0..nbins-1 of spans (keys, nbins), zeros where nothing was counted."""
    every = spans.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nbins") - 1)))
    return every.join(bins, [*keys, "bin"], "left").na.fill(0, values)


def scanned(bins: DataFrame, keys: list[str], value: str) -> DataFrame:
    """bins with c (inclusive sum), h (maximum of c before) and l (minimum of c from here on)."""
    up, down = Window.partitionBy(*keys).orderBy("bin"), Window.partitionBy(*keys).orderBy(F.col("bin").desc())
    out = bins.withColumn("c", F.sum(value).over(up.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("h", F.max("c").over(up.rowsBetween(Window.unboundedPreceding, -1)))
    return out.withColumn("l", F.min("c").over(down.rowsBetween(Window.unboundedPreceding, 0)))  # from the end: one step a row


def prefix_histograms(bins: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, bin (0 to nbins) and the sums of values over all bins before it; bins must be dense."""
    up = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = bins.select(*keys, (F.col("bin") + 1).alias("bin"), *(F.sum(v).over(up).alias(v) for v in values))
    return sums.unionByName(bins.select(*keys, F.lit(0).cast("long").alias("bin"), *(F.lit(0).cast("long").alias(v) for v in values)).distinct())


def sliced(prefix: DataFrame, ranges: DataFrame, keys: list[str], values: list[str], shift: Column | int, nmers: Column) -> DataFrame:
    """ranges (keys, a, b: bins from a to before b) with their histograms, t (all hits) and u: every position of the range
    that is no hit, breaks and k-mers outside the partition included."""
    left = prefix.select(*keys, F.col("bin").alias("a"), *(F.col(v).alias(f"_{v}") for v in values))
    right = prefix.select(*keys, F.col("bin").alias("b"), *values)
    both = ranges.join(left, [*keys, "a"]).join(right, [*keys, "b"]).withColumns({v: F.col(v) - F.col(f"_{v}") for v in values}).drop(*(f"_{v}" for v in values))
    size = F.lit(1).cast("long") if isinstance(shift, int) and not shift else F.pow(F.lit(2), shift if isinstance(shift, Column) else F.lit(shift)).cast("long")
    t = sum((F.col(v) for v in values), F.lit(0))
    return both.withColumn("t", t).withColumn("u", F.least(F.col("b") * size, nmers) - F.least(F.col("a") * size, nmers) - F.col("t"))


def usable_nulls(records: DataFrame, pool: DataFrame) -> DataFrame:
    """records (rid, query_id, a, b) with n_usable: how many windows of their sketch's pool (rid, query_id, a, b) do not overlap
    them on their own query. Own windows alone are compared; all others are counted by sketch."""
    all_ = pool.groupBy("rid").agg(F.count("*").alias("_all"))
    at = records.withColumn("_at", F.monotonically_increasing_id())
    own = pool.select("rid", F.col("query_id").alias("_q"), F.col("a").alias("_a"), F.col("b").alias("_b"))
    same = (at["rid"] == own["rid"]) & at["query_id"].eqNullSafe(own["_q"]) & overlaps(F.col("a"), F.col("b"), F.col("_a"), F.col("_b"))
    met = at.join(own, same, "left").groupBy(*(at[c] for c in records.columns), "_at").agg(F.count("_a").alias("_met"))
    return met.join(all_, "rid", "left").select(*records.columns, (F.coalesce("_all", F.lit(0)) - F.col("_met")).alias("n_usable"))


def strand_diff(fw: Column, rc: Column) -> Column:
    inf = float("inf")
    return F.when(F.isnan(fw) & F.isnan(rc), float("nan")).when(F.isnan(rc), -inf).when(F.isnan(fw), inf).otherwise(fw - rc)


def strand_label(is_rc: Column, diff: Column) -> Column:
    inf = float("inf")
    return F.when(F.isnan(diff), ".").when(diff == -inf, F.when(is_rc == 0, "+").otherwise(".")).when(diff == inf, F.when(is_rc == 1, "+").otherwise(".")).when((is_rc == 1) == (diff > 0), "+").otherwise("-")


def overlaps(a1: Column, b1: Column, a2: Column, b2: Column) -> Column:
    return (a1 < b2) & (a2 < b1)


def _record(kind: str) -> str:
    return f"rid string, query_id {kind}, seq_len long, is_rc int, first long, after long, start long, end long, th int, d double, d_contig double, d_diff double, low double, high double, emit int, closer boolean, hist array<long>, misses double, pool array<struct<a:long,b:long,d:double>>"


def _counted(hist: np.ndarray, miss: np.ndarray, nmers: int, p: MapParams) -> dict:
    """One strand's sums. Slices count every position that is no hit as a miss; sums of explicit misses serve the
    coordinates-only mode."""
    prefix = np.concatenate((np.zeros((1, hist.shape[1]), np.int64), np.cumsum(hist, axis=0)))
    missed = np.concatenate(([0], np.cumsum(miss)))
    v = prefix[-1]
    return {"prefix": prefix, "missed": missed, "v": v, "u": float(missed[-1]) if p.coordinates_only else float(nmers - v.sum())}


def _walked(s: dict, m: Model, p: MapParams) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(scores, curvatures) of one strand's walk by threshold."""
    counts, laws = np.column_stack((s["prefix"], s["missed"])).astype(float), _laws(m, p.thresholds)
    return [counts @ x for x, _ in laws], [counts @ y for _, y in laws]


@functools.lru_cache(64)
def _laws(m: Model, thresholds: tuple[float, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(m.score(t), m.curvature(t)) for t in thresholds]


def _strand(hist: np.ndarray, miss: np.ndarray, nmers: int, m: Model, p: MapParams) -> dict:
    """One strand's walk data."""
    s = _counted(hist, miss, nmers, p)
    c, spread = _walked(s, m, p)
    return s | {"d": float(m.mle(s["v"][None], np.array([s["u"]]))[0]), "C": c, "S": spread}


def _grown(prefix: np.ndarray, a: int, win: int) -> tuple[int, int] | None:
    """A window of bins from a on, widened while it has no hit: right and left in turn, the other side where one is at its
    end, to ten windows or the whole query at most. None if there is still no hit."""
    n = len(prefix) - 1
    b, right, most = a + win, True, min(10 * win, n)
    while (empty := (prefix[b] - prefix[a]).sum() == 0) and b - a < most:
        more = min(win, most - (b - a))
        if b + more <= n and (right or a < more):
            b += more
        elif a >= more:
            a -= more
        else:
            break
        right = not right
    return None if empty else (a, b)


def _windows(s: dict, nbins: int, tau: int, p: MapParams, rid: str, query) -> list[tuple[int, int]]:
    """Null windows drawn with replacement. The draw depends on seed, sketch and query alone."""
    win = tau + 1
    n = min(p.sample_size, nbins // win)
    if n < 1:
        return []
    seed = int.from_bytes(hashlib.sha256(f"{p.seed}|{rid}|{query}".encode()).digest()[:8], "little")
    drawn = np.random.default_rng(seed).integers(0, nbins - win + 1, n)
    hits = s["prefix"].sum(1)
    some = hits[drawn + win] > hits[drawn]
    return [w for a, full in zip(drawn.tolist(), some.tolist(), strict=True) if (w := (a, a + win) if full else _grown(hits[:, None], a, win))]


def _sliced(s: dict, ranges: list[tuple[int, int]], nmers: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Histograms and misses of ranges of bins."""
    a, b = np.array(ranges, np.int64).reshape(-1, 2).T
    v = s["prefix"][b] - s["prefix"][a]
    return v, (np.minimum(b << shift, nmers) - np.minimum(a << shift, nmers) - v.sum(1)).astype(float)


def _records(rid: str, m: Model, each: list[tuple], p: MapParams) -> list[tuple]:
    """The records of queries (id, length, their strands' sums) and a sketch. All distances are fitted together."""
    fitted = iter(m.mle(np.array([s["v"] for *_, both in each for s in both]), np.array([s["u"] for *_, both in each for s in both])).tolist())
    at, ranges = [], []  # what is found, query by query; histograms and misses of the ranges
    for query, seq_len, both in each:
        d = next(fitted), next(fitted)
        closer = 1 if d[0] - d[1] > 0 else 0
        nmers = seq_len - m.k + 1
        nbins = len(both[0]["prefix"]) - 1
        tau = min(p.tau_bin, nbins) - 1
        windows = _windows(both[closer], nbins, tau, p, rid, query) if p.sample_size else []
        ranges.append(_sliced(both[closer], windows, nmers, p.bin_shift))
        by_strand = []
        for s, x in zip(both, d, strict=True):
            scores, spreads = _walked(s, m, p)
            walks = [X.flipped(c, t, x) for c, t in zip(scores, p.thresholds, strict=True)]
            if p.enum_only:
                found = [(a, b + 1, t) for t in range(len(p.thresholds)) for a, b in X.merged(X.maximal(walks[t], tau), walks[t], spreads[t], p.chisq)]
            else:
                found = X.ordered(walks, spreads, X.ranks(list(p.thresholds), x), tau, p.chisq, p.by_position)
            by_strand.append(found)
            ranges.append(_sliced(s, [] if p.coordinates_only else [(a - 1, b - 1) for a, b, _ in found], nmers, p.bin_shift))
        at.append((d, closer, nmers, nbins, windows, by_strand))
    v, u = np.concatenate([x for x, _ in ranges]), np.concatenate([x for _, x in ranges])
    distances = valid_distance(m.mle(v, u)) if len(v) else np.zeros(0)
    usable = np.zeros(len(v), bool)
    sound = np.flatnonzero(~np.isnan(distances))
    usable[sound] = np.isfinite(m.informations(distances[sound], v[sound], u[sound]))
    distances, usable, ends = distances.tolist(), usable.tolist(), np.cumsum([0, *(len(x) for _, x in ranges)]).tolist()
    out, bare = [], p.coordinates_only
    for i, ((query, seq_len, both), (d, closer, nmers, nbins, windows, by_strand)) in enumerate(zip(each, at, strict=True)):
        of = [distances[ends[3 * i + j] : ends[3 * i + j + 1]] for j in range(3)]
        pool = [{"a": a, "b": b, "d": x} for (a, b), x, good in zip(windows, of[0], usable[ends[3 * i] : ends[3 * i + 1]], strict=True) if good]
        diff = d[0] - d[1]
        for strand, found in enumerate(by_strand):
            for emit, ((a, b, t), x) in enumerate(zip(found, [math.nan] * len(found) if bare else of[1 + strand], strict=True)):
                start, end = X.coordinates(a, b, p.bin_shift, nmers, m.k, b == nbins + 1)
                low, high = X.distance_bin(list(p.thresholds), t, d[strand], x)
                lead = strand == closer and emit == 0
                out.append((rid, query, seq_len, strand, a, b, start, end, t, x, math.nan if bare else d[strand], math.nan if bare else diff, low, high, emit, strand == closer, both[closer]["v"].tolist() if lead else None, both[closer]["u"] if lead else math.nan, pool if lead else []))
    return out


def _as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _of_sequences(rows: list[int], s: dict, ids: list, sizes: list[int], found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], p: MapParams) -> list[tuple]:
    """The records of sequences (rows, one after the other) and a sketch: found has, by strand, row, position and least distance
    of their k-mers."""
    nbins = np.array([-(-max(0, sizes[i] - s["k"] + 1) // (1 << p.bin_shift)) for i in rows], np.int64)
    ends, width = np.cumsum(2 * nbins), p.hdist + 2
    counts = np.zeros(2 * int(nbins.sum()) * width, np.int64)
    for strand, (owner, pos, hd) in enumerate(found):
        at = (ends - (2 - strand) * nbins)[owner - rows[0]] + (pos >> p.bin_shift)
        counts += np.bincount(at * width + np.minimum(hd, width - 1), minlength=len(counts))
    counts = counts.reshape(-1, width)
    m, each = Model(s["k"], s["h"], s["rho"], p.hdist), []
    for i, n, end in zip(rows, nbins.tolist(), ends.tolist(), strict=True):
        if n >= 2:
            both = [_counted(x[:, :-1], x[:, -1], sizes[i] - s["k"] + 1, p) for x in (counts[end - 2 * n : end - n], counts[end - n : end])]
            each.append((ids[i], sizes[i], both))
    return _records(s["rid"], m, each, p) if each else []


def _kernel_records(queries: DataFrame, small: list[dict], p: MapParams, kind: str, canonical: bool) -> DataFrame:
    """Records of sketches that are broadcast, sequence by sequence."""
    schema = _record(kind)
    shape = to_arrow_schema(StructType.fromDDL(schema))
    shared = queries.sparkSession.sparkContext.broadcast(small)  # its size was checked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sizes = b.column("query_id").to_pylist(), [len(x or "") for x in b.column("seq").to_pylist()]
            for rows, s, owner, strand, pos, hd in _found(shared.value, b, canonical):
                if out := _of_sequences(rows, s, ids, sizes, [(owner[x], pos[x], hd[x]) for x in (strand == 0, strand == 1)], p):
                    yield _as_batch(out, shape)

    return queries.select("query_id", "seq").mapInArrow(run, schema)


def _joined_records(queries: DataFrame, large: list[dict], rows: DataFrame, p: MapParams, kind: str, canonical: bool) -> DataFrame:
    """Records of sketches that are joined, by bucket; distances go back to their sequences."""
    schema = _record(kind)
    shape = to_arrow_schema(StructType.fromDDL(schema))

    def consume(at: list[int], s: dict, ids: list, sizes: list[int], found: list[tuple]) -> Iterator[pa.RecordBatch]:
        if out := _of_sequences(at, s, ids, sizes, found, p):
            yield _as_batch(out, shape)

    alike: dict[tuple, list[dict]] = {}
    for s in large:
        alike.setdefault(T.hashing(s), []).append(s)
    return _union([T.by_sequence(queries, group, rows, canonical, consume, schema) for group in alike.values()])


def genome_sums(records: DataFrame, hdist: int) -> DataFrame:
    """rid, v, u: histograms and misses of the closer strands of all queries, which lead rows carry (hist, misses)."""
    return records.where("hist is not null").groupBy("rid").agg(F.array(*(F.sum(F.get("hist", F.lit(d))) for d in range(hdist + 1))).alias("v"), F.sum("misses").alias("u"))


def diagnostics(queries: DataFrame, meta: DataFrame, p: MapParams) -> DataFrame:
    """rid, query_id, code: queries that are skipped or shorter than the minimum interval."""
    each = queries.select("query_id", F.length("seq").alias("n")).join(F.broadcast(meta.select("rid", "k")))  # a row per sketch
    bins = F.ceil((F.col("n") - F.col("k") + 1) / (1 << p.bin_shift))
    code = F.when(F.col("n") < F.col("k"), "short_query").when(bins < 2, "few_bins").when(bins < p.tau_bin, "min_length_above_query")
    return each.select("rid", "query_id", code.alias("code")).where("code is not null")


def map_queries(queries: DataFrame, sketch: tuple[DataFrame, DataFrame], p: MapParams = MapParams(), kernel_rows: int = KERNEL_ROWS, canonical: bool = False) -> DataFrame:
    """The 16 result columns, and emit (order within query and strand)."""
    return map_and_notes(queries, sketch, p, kernel_rows, canonical)[0]


def map_and_notes(queries: DataFrame, sketch: tuple[DataFrame, DataFrame], p: MapParams = MapParams(), kernel_rows: int = KERNEL_ROWS, canonical: bool = False) -> tuple[DataFrame, DataFrame]:
    """(the result of map_queries; diagnostics, and for each query, sketch and code how many records were not tested)."""
    spark = queries.sparkSession
    ship(spark)
    meta, rows = sketch
    kind = dict(queries.dtypes)["query_id"]
    adjusted = meta.withColumn("rho", partial_rho(F.col("rho"), F.col("m"), F.col("r"), F.col("frac")))
    small, large = _split(adjusted, rows, kernel_rows)
    model = adjusted.select("rid", "k", "h", "rho")
    parts = [_joined_records(queries, large, rows, p, kind, canonical)] if large else []
    if small or not large:
        parts.append(_kernel_records(queries, small, p, kind, canonical))
    records = saved(_union(parts))

    sums = genome_sums(records, p.hdist)
    genome = sums.join(model, "rid")

    @F.pandas_udf("double")
    def fitted(v: pd.Series, u: pd.Series, k: pd.Series, h: pd.Series, rho: pd.Series) -> pd.Series:
        return pd.Series([float(Model(*x[2:], p.hdist).mle([x[0]], [x[1]])[0]) for x in zip(v, u, k, h, rho, strict=True)])

    genome = genome.select("rid", fitted("v", "u", "k", "h", "rho").alias("d_genome"))
    tested = saved(_tested(records, p)) if p.sample_size else records.withColumns({"p": F.lit(math.nan), "fold": F.lit(math.nan), "note": F.lit(None).cast("string")})
    scored = q_values(tested, ["rid", "is_rc"]).join(genome, "rid", "left")
    bare = p.coordinates_only
    nan = F.lit(math.nan)
    notes = tested.where("note is not null").groupBy("rid", "query_id", F.col("note").alias("code")).agg(F.count("*").alias("n"))
    notes = diagnostics(queries, meta, p).withColumn("n", F.lit(1).cast("long")).unionByName(notes)
    result = scored.select(
        F.col("query_id").alias("QUERY_ID"), F.col("seq_len").alias("SEQ_LEN"), F.col("start").alias("INTERVAL_START"), F.col("end").alias("INTERVAL_END"),
        strand_label(F.col("is_rc"), F.col("d_diff")).alias("STRAND"), F.col("is_rc").alias("IS_RC"), F.col("rid").alias("REF_ID"), F.col("d").alias("DIST"),
        F.coalesce(F.pow(F.lit(2), F.col("th")).cast("int"), F.lit(0)).alias("MASK"), F.concat(F.lit("("), five_digits(F.col("low")), F.lit(", "), five_digits(F.col("high")), F.lit(")")).alias("D_INTERVAL"),
        F.col("d_contig").alias("DIST_CONTIG"), F.col("d_diff").alias("STRAND_DIFF"), (nan if bare else F.col("d_genome")).alias("DIST_GENOME"), F.col("p").alias("PERCENTILE"), F.col("fold").alias("FOLD"), F.col("q").alias("QVALUE"), "emit",
    )
    return result, notes


def _tested(records: DataFrame, p: MapParams) -> DataFrame:
    """records with p, fold and note (why there is none). A record's nulls: sample_size windows drawn for it alone from those of
    its sketch's pool that do not overlap it on its own query. A pool is a uniform sample of at most 20 times sample_size of its
    windows, by a hash of seed and window, so that it can be broadcast; a record's draw depends on seed and record."""
    pool = records.select("rid", "query_id", F.explode("pool").alias("w")).select("rid", F.struct(F.xxhash64(F.lit(p.seed), "query_id", "w.a", "w.b").alias("o"), F.col("query_id").cast("string").alias("q"), "w.a", "w.b", "w.d").alias("w"))
    most, first = 20 * p.sample_size, pool.withColumn("_s", F.pmod(F.col("w.o"), F.lit(POOL_SHARES)))
    for by in (("rid", "_s"), ("rid",)):  # of each share first, so that no task has all windows
        first = first.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("w"))).where(F.col("_r") <= most)
    pools: dict[str, list] = {}
    for r in first.select("rid", "w").collect():  # at most 20 * sample_size rows a sketch
        pools.setdefault(r["rid"], []).append(r["w"])
    for ws in pools.values():
        ws.sort(key=lambda w: (w["o"], w["q"] is not None, w["q"] or "", w["a"], w["b"], w["d"]))
    frozen = {rid: (np.array([w["q"] for w in ws], object), *(np.array([w[c] for w in ws]) for c in ("a", "b", "d"))) for rid, ws in pools.items()}
    own: dict[str, dict[str | None, list[int]]] = {}  # by sketch and query, which windows are its own
    for rid, (qs, *_) in frozen.items():
        for i, q in enumerate(qs):
            own.setdefault(rid, {}).setdefault(q, []).append(i)
    shared, n, seed = records.sparkSession.sparkContext.broadcast((frozen, own)), p.sample_size, p.seed

    @F.pandas_udf("struct<p:double,fold:double,note:string>")
    def score(rows: pd.DataFrame) -> pd.DataFrame:
        drawn = []
        frozen, own = shared.value
        for r in rows.itertuples(index=False):
            _, a, b, nulls = frozen.get(r.rid, (np.zeros(0),) * 4)
            if (at := own.get(r.rid, {}).get(r.q)) is not None:
                at = np.array(at)
                nulls = np.delete(nulls, at[(a[at] < r.after - 1) & (r.first - 1 < b[at])])
            if len(nulls) > n:
                draw = hashlib.sha256(f"{seed}|{r.rid}|{r.q}|{r.is_rc}|{r.first}|{r.after}|{r.th}".encode()).digest()
                nulls = np.random.default_rng(int.from_bytes(draw[:8], "little")).choice(nulls, n, replace=False)
            drawn.append(nulls)
        laws = fit_gammas([x if len(x) >= 8 else x[:0] for x in drawn])
        out = [significance(r.d, x, math.isfinite(r.d_diff) and r.closer, law, y) for r, x, law, y in zip(rows.itertuples(index=False), drawn, laws, medians(laws), strict=True)]
        return pd.DataFrame(out, columns=["p", "fold", "note"])

    spread = records.drop("pool").repartition(shuffle_width(records.sparkSession), "rid", "query_id", "is_rc", "first", "after", "th")  # files hold unequal numbers of them
    scored = spread.withColumn("_s", score(F.struct("rid", F.col("query_id").cast("string").alias("q"), "is_rc", "first", "after", "th", "d", "d_diff", "closer")))
    return scored.select(*(c for c in records.columns if c != "pool"), F.coalesce("_s.p", F.lit(math.nan)).alias("p"), F.coalesce("_s.fold", F.lit(math.nan)).alias("fold"), "_s.note")  # NaN comes back from pandas as null


def significance(d: float, nulls: np.ndarray, two_sided: bool, law: Gamma | None = None, middle: float | None = None) -> tuple[float, float, str | None]:
    """(p, fold, None), or NaNs and why: fewer than eight nulls, or no usable fit."""
    if len(nulls) < 8:
        return math.nan, math.nan, "few_nulls"
    below, median = score_samples(d, nulls, law, middle)
    if not (math.isfinite(below) and math.isfinite(median)):
        return math.nan, math.nan, "fit_failed"
    return (2 * min(below, 1 - below) if two_sided else below), d / median, None


def five_digits(x: Column) -> Column:
    """Five significant digits, trailing zeros dropped; nan, inf and -inf by name."""
    return significant(x, 5)


def as_text(result: DataFrame, sketch_order: list[str] | None = None) -> DataFrame:
    """The 16 columns, doubles with five digits, in order of sketch, query, strand and emission."""
    order = F.array_position(F.array(*map(F.lit, sketch_order)), F.col("REF_ID")) if sketch_order else F.col("REF_ID")
    text = [five_digits(F.col(n)).alias(n) if t == "double" else F.col(n) for n, t in result.dtypes if n in COLUMNS]
    return result.orderBy(order, "QUERY_ID", "IS_RC", "emit").select(*text)


def write_tsv(result: DataFrame, path: str, sketch_order: list[str] | None = None) -> None:
    """as_text as tab-separated text with a header."""
    as_text(result, sketch_order).write.mode("overwrite").csv(path, sep="\t", header=True, quote="")


def params(p: MapParams) -> dict:
    return asdict(p)
