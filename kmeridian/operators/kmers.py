"""k-mers, minimizers and distinct counts of sequences, as Arrow kernels: the sequence itself never travels with its k-mers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmeridian.functions.encode import EVEN, encode_all, hamming, letters, mixed, reverse_complements
from kmeridian.session import saved, ship


def _typed(df: DataFrame, keep: tuple[str, ...]) -> str:
    return "".join(f"`{n}` {t}, " for n, t in df.dtypes if n in keep)


def _emit(b: pa.RecordBatch, keep: tuple[str, ...], owners: list[int], arrays: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    at = pa.array(np.array(owners, np.int64))
    return pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in keep), *map(pa.array, arrays)], [*keep, *names])


def kmers(seqs: DataFrame, k: int, keep: tuple[str, ...] = ("query_id",), seq: str = "seq", bases=letters) -> DataFrame:
    """keep, pos, bp and rc (the reverse complement's bp) of every k-mer without a break; others are absent."""
    ship(seqs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, s in enumerate(b.column(seq).to_pylist()):
                pos, bp = encode_all(s, k, bases)
                if len(pos):
                    yield _emit(b, keep, [i] * len(pos), [pos, bp.view(np.int64), reverse_complements(bp, k).view(np.int64)], ["pos", "bp", "rc"])

    return seqs.select(*keep, seq).mapInArrow(run, f"{_typed(seqs, keep)}pos long, bp long, rc long")


def apart_by_id(seqs: DataFrame, key: str = "query_id") -> tuple[DataFrame, DataFrame | None]:
    """(sequences whose id stands on one row, those whose id stands on several; None if there are none of these). Null is an id."""
    often = saved(seqs.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).where("_n > 1").select("_key"))
    if often.isEmpty():
        return seqs, None
    same = F.col(key).eqNullSafe(F.col("_key"))
    return seqs.join(often, same, "left_anti"), seqs.join(often, same, "left_semi")


def _by_sequence(seqs: DataFrame, k: int, of, names: list[str], bases) -> DataFrame:
    """query_id and a row of numbers, of(pos, bp), for each sequence that has one: nothing else leaves the kernel."""
    ship(seqs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, row) for i, s in enumerate(b.column("seq").to_pylist()) if (row := of(*encode_all(s, k, bases))) is not None]
            if found:
                yield _emit(b, ("query_id",), [i for i, _ in found], list(np.array([row for _, row in found], np.int64).T), names)

    return seqs.select("query_id", "seq").mapInArrow(run, _typed(seqs, ("query_id",)) + ", ".join(f"{n} long" for n in names))


def kmer_counts(seqs: DataFrame, k: int, bases=letters) -> DataFrame:
    """query_id, n and n_distinct of the k-mers of each id. Sequences are counted where they are; k-mers of ids that stand on
    several rows alone are dealt out."""

    def of(pos: np.ndarray, bp: np.ndarray) -> tuple[int, int] | None:
        x = np.sort(bp)
        return (len(x), 1 + int(np.count_nonzero(x[1:] != x[:-1]))) if len(x) else None

    one, several = apart_by_id(seqs)
    out = _by_sequence(one, k, of, ["n", "n_distinct"], bases)
    if several is None:
        return out
    return out.unionByName(kmers(several, k, bases=bases).groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct("bp").alias("n_distinct")))


def neighbour_distances(seqs: DataFrame, k: int, bases=letters) -> DataFrame:
    """query_id and total: the Hamming distances of all pairs of k-mers of an id at neighbouring positions, summed. Only ids that
    stand on several rows, whose k-mers meet across rows, are joined."""

    def of(pos: np.ndarray, bp: np.ndarray) -> tuple[int] | None:
        near = np.diff(pos) == 1
        d = (bp[1:] ^ bp[:-1])[near]
        return (int(np.bitwise_count((d | (d >> np.uint64(1))) & np.uint64(EVEN)).sum(dtype=np.int64)),) if len(d) else None

    one, several = apart_by_id(seqs)
    out = _by_sequence(one, k, of, ["total"], bases)
    if several is None:
        return out
    x = kmers(several, k, bases=bases)
    after = x.select(F.col("query_id").alias("_id"), (F.col("pos") - 1).alias("_pos"), F.col("bp").alias("y"))
    met = x.join(after, F.col("query_id").eqNullSafe(F.col("_id")) & (F.col("pos") == F.col("_pos")))
    return out.unionByName(met.groupBy("query_id").agg(F.sum(hamming(F.col("bp"), F.col("y"))).cast("long").alias("total")))


def canonical(bp: Column, rc: Column) -> Column:
    """The larger of a k-mer and its reverse complement (k < 32, so both are non-negative)."""
    return F.greatest(bp, rc)


def _first_least(z: np.ndarray, span: int) -> np.ndarray:
    """For each window of span values, where its least stands, the first of equal ones."""
    n = len(z) - span + 1
    least, at = z[:n].copy(), np.arange(n)
    for j in range(1, span):
        less = z[j : j + n] < least
        np.copyto(least, z[j : j + n], where=less)
        at[less] = np.flatnonzero(less) + j
    return at


def windows(pos: np.ndarray, bp: np.ndarray, k: int, w: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(end position, index of the minimizer) for each window of w bases without a break; a run shorter than w that ends
    the sequence gives the minimizer of what it has."""
    if not len(pos):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    z, span = mixed(bp), w - k + 1
    ends, best = [], []
    cuts = np.flatnonzero(np.diff(pos) != 1) + 1
    for run in np.split(np.arange(len(pos)), cuts):
        if len(run) >= span:
            ends.append(pos[run[span - 1 :]] + k - 1)
            best.append(run[0] + _first_least(z[run[0] : run[-1] + 1], span))
        elif pos[run[-1]] + k == length:
            ends.append(pos[run[-1:]] + k - 1)
            best.append(run[[z[run].argmin()]])
    return (np.concatenate(ends), np.concatenate(best)) if ends else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _circular(pos: np.ndarray, bp: np.ndarray, k: int, w: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(end, pos, bp) as a circular buffer gives them that breaks do not empty and that begins with zeros: a window ends where
    the last w bases have no break, or the sequence ends; its candidates are the last w - k + 1 k-mers there were, wherever.
    A zero stands for a k-mer of A alone, at position -1."""
    n, span = len(pos), w - k + 1
    if not n:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    all_bp, all_pos = np.concatenate((np.zeros(span, np.uint64), bp)), np.concatenate((np.full(span, -1), pos))
    z = np.concatenate((np.zeros(span, np.uint64), mixed(bp)))
    run = np.arange(n) - np.maximum.accumulate(np.where(np.diff(pos, prepend=-9) != 1, np.arange(n), 0)) + k  # bases since the last break
    at = np.flatnonzero((run >= w) | (pos + k == length))
    best = at + 1 + np.lib.stride_tricks.sliding_window_view(z, span)[at + 1].argmin(axis=1)
    return pos[at] + k - 1, all_pos[best], all_bp[best]


def minimizers(seqs: DataFrame, k: int, w: int, keep: tuple[str, ...] = ("query_id",), seq: str = "seq", compat: bool = False) -> DataFrame:
    """keep, end (of the window), pos and bp: the k-mer of least mixed value (unsigned) in every window of w bases.
    Sequences shorter than w give none. compat: windows as `_circular` has them, which differ around breaks."""
    ship(seqs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, s in enumerate(b.column(seq).to_pylist()):
                if s and len(s) >= w:
                    pos, bp = encode_all(s, k)
                    if compat:
                        end, pos, bp = _circular(pos, bp, k, w, len(s))
                    else:
                        end, best = windows(pos, bp, k, w, len(s))
                        pos, bp = pos[best], bp[best]
                    if len(end):
                        yield _emit(b, keep, [i] * len(end), [end, pos, bp.view(np.int64)], ["end", "pos", "bp"])

    return seqs.select(*keep, seq).mapInArrow(run, f"{_typed(seqs, keep)}end long, pos long, bp long")


HLL_BITS = 12


def hll_registers(z: DataFrame, value: str = "z", by: tuple[str, ...] = ()) -> DataFrame:
    """HyperLogLog registers (by, idx, reg) of the low 32 bits of value: mergeable by taking the larger."""
    x = F.col(value).bitwiseAND(F.lit(0xFFFFFFFF))
    idx = F.shiftright(x, 32 - HLL_BITS)
    rest = F.shiftleft(x, HLL_BITS).bitwiseAND(F.lit(0xFFFFFFFF))
    clz = F.when(rest == 0, 32).otherwise(32 - F.length(F.bin(rest)))
    return z.select(*by, idx.alias("idx"), (F.least(F.lit(32 - HLL_BITS), clz) + 1).alias("reg")).groupBy(*by, "idx").agg(F.max("reg").cast("long").alias("reg"))


def hll_estimate(registers: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, estimate: harmonic mean with linear counting for small and a correction for very large counts."""
    return hll_of_sums(registers.groupBy(*by).agg(F.sum(F.pow(F.lit(2.0), -F.col("reg"))).alias("s"), F.count("*").alias("full")), by)


def hll_sums(bp: np.ndarray) -> tuple[float, int]:
    """(s, full) of the registers of the mixed values of bp, as hll_estimate sums them; powers of two, so in any order."""
    x = (mixed(bp) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    rest = (x << HLL_BITS) & 0xFFFFFFFF
    reg = np.zeros(1 << HLL_BITS, np.int64)
    np.maximum.at(reg, x >> (32 - HLL_BITS), np.minimum(32 - HLL_BITS, 32 - np.frexp(rest.astype(float))[1]).astype(np.int64) + 1)
    full = reg[reg > 0]
    return float(np.sum(2.0**-full)), len(full)


def hll_of_sums(sums: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, estimate, from the sum s of 2^-reg of the registers and their number, full."""
    m = 1 << HLL_BITS
    alpha = 0.7213 / (1 + 1.079 / m)
    raw = F.lit(alpha * m * m) / (F.col("s") + (m - F.col("full")))
    empty = m - F.col("full")
    small = F.when((raw <= 2.5 * m) & (empty > 0), m * F.log(F.lit(float(m)) / empty))
    large = F.when(raw > 2.0**32 / 30, -(2.0**32) * F.log(1 - raw / 2.0**32))
    return sums.select(*by, F.coalesce(small, large, raw).alias("estimate"))


def merge_registers(*tables: DataFrame) -> DataFrame:
    first = tables[0]
    keys = [c for c in first.columns if c != "reg"]
    for t in tables[1:]:
        first = first.unionByName(t)
    return first.groupBy(*keys).agg(F.max("reg").alias("reg"))
