"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors are turned by a fixed random rotation and split into blocks of `BLOCK` coordinates. Two vectors of cosine
c are sqrt(2 - 2c) apart, so in at least one of m blocks their squared distance is within (2 - 2c) / m. Each block is
range-joined under that budget: rows go to cells of budget width along the block's first coordinate, to their own and,
as probes, to the next; within a cell a second coordinate bounds the rows compared; pairs within the block budget are
candidates and are verified exactly, by cosine in double precision on the original vectors. A pair found in several
blocks counts in the first block whose budget it meets.

Equal vectors of a label are one class with a count. A row sent to a cell holds its vector once, in the precision that the
table has it in; a task turns it again. Cells with more than TILE rows are cut into tiles, which share the pairs out; no
cell, label or class is ever one task. What a tile returns is linear in its rows: counts of links and a spanning forest, so
that no pairs of a dense group are ever written.

Defined results: a vector that is null, empty, zero, or holds null or non-finite components, and a row whose label is
null, has no links and is its own component; vectors of different lengths are not linked; repeated vec_ids are separate
rows that share a component if their vectors do; cosine >= threshold links, ties included; an empty table gives none. Labels
may be of any type that casts to a string, and link by that; columns other than the three are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmeridian.llm.components import components, named_roots
from kmeridian.llm.streams import groups
from kmeridian.session import saved, ship, shuffle_width

COSINE = 0.93
BLOCK = 16
TILE = 8000
SLACK = 1e-5  # rotated coordinates are kept in single precision


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks_of(dim: int) -> list[tuple[int, int]]:
    m = max(1, round(dim / BLOCK))
    cuts = np.linspace(0, dim, m + 1).round().astype(int)
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def _vectors(kind: str):
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """vec_id, key (a hash of label and vector; null where it links with nothing), label as a hash, the vector."""
        for b in batches:
            keys, groups_, raws = [], [], []
            for label, vector in zip(b.column("label").to_pylist(), b.column("embedding").to_pylist(), strict=True):
                x = np.array(vector, kind) if label is not None and vector and None not in vector else np.zeros(0, kind)
                good = len(x) and np.isfinite(x).all() and x.any()
                raws.append((x + x.dtype.type(0)).tobytes() if good else None)
                groups_.append(xxhash.xxh3_64_intdigest(label) - (1 << 63) if good else None)
                keys.append(xxhash.xxh3_64_intdigest(label.encode() + b"\0" + raws[-1]) - (1 << 63) if good else None)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(keys, pa.int64()), pa.array(groups_, pa.int64()), pa.array(raws, pa.binary())], ["vec_id", "key", "label", "raw"])

    return vectors


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares of very large or small components leave the range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _budget(cosine: float, blocks: int) -> float:
    """The squared distance within which a block's pairs are looked for and count as met."""
    return (2 - 2 * cosine) / blocks + SLACK


def _width(cosine: float, blocks: int) -> float:
    """Of a cell: no coordinate of a pair within the budget is further apart, rounding included."""
    return float(np.sqrt(_budget(cosine, blocks))) + SLACK


def _turned(unit: np.ndarray) -> np.ndarray:
    return (unit @ rotation(unit.shape[1])).astype("<f4")


def _cells(cosine: float, kind: str):
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector's row for its home cell (probe 0) and the one below (probe 1), in every block."""
        for b in batches:
            raws = b.column("raw").to_pylist()
            by_dim: dict[int, list[int]] = {}
            for i, r in enumerate(raws):
                by_dim.setdefault(len(r) // np.dtype(kind).itemsize, []).append(i)
            for dim, at in by_dim.items():
                y = _turned(_unit(np.array([np.frombuffer(raws[i], kind) for i in at])))
                parts = blocks_of(dim)
                width, n = _width(cosine, len(parts)), len(at)
                rest = [b.column(c).take(pa.array(at)) for c in ("key", "label", "times", "raw")]
                for k, (lo, _) in enumerate(parts):
                    cell = np.floor(y[:, lo].astype(float) / width).astype(np.int32)
                    for probe in (0, 1):
                        yield pa.RecordBatch.from_arrays([*rest, pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, k, np.int32)), pa.array(cell - probe), pa.array(np.full(n, probe, np.int32))], ["key", "label", "times", "raw", "dim", "block", "cell", "probe"])

    return cells


def _local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _pairs(turned: np.ndarray, probe: np.ndarray, own: np.ndarray, i: int, j: int, parts: list[tuple[int, int]], block: int, budget: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of a tile: both home, or home and probe, between the tile's sides, within the block's budget, and
    beyond the budgets of earlier blocks."""
    lo, hi = parts[block]
    second = turned[:, min(lo + 1, hi - 1)]
    order = np.argsort(second, kind="stable")
    value, reach = second[order], np.sqrt(budget)
    part = np.ascontiguousarray(turned[order, lo:hi])
    norm = (part * part).sum(axis=1)
    probe, own = probe[order], own[order]
    for at in range(0, len(order), 512):
        rows = slice(at, min(at + 512, len(order)))
        end = int(np.searchsorted(value, value[rows.stop - 1] + reach, side="right"))
        near = norm[rows, None] + norm[None, at:end] - 2 * part[rows] @ part[at:end].T <= budget + 1e-4
        near &= np.arange(at, end)[None, :] > np.arange(rows.start, rows.stop)[:, None]
        a, b = np.nonzero(near)
        a, b = a + at, b + at
        keep = (probe[a] + probe[b] <= 1) & ((own[a] == i) & (own[b] == j) | (own[a] == j) & (own[b] == i))
        a, b = a[keep], b[keep]
        for s in range(0, len(a), 200_000):
            x, y = order[a[s : s + 200_000]], order[b[s : s + 200_000]]
            gap = (turned[x].astype(float) - turned[y]) ** 2
            spent = np.add.reduceat(gap, [p for p, _ in parts], axis=1) <= budget
            first = spent[:, block] & ~spent[:, :block].any(axis=1)
            yield x[first], y[first]


def _match(cosine: float, kind: str):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, dim, block, _, i, j), t in groups(batches, ["label", "dim", "block", "cell", "i", "j"]):
            if t.num_rows < 2:
                continue
            key, times, probe, own = (t.column(c).to_numpy() for c in ("key", "times", "probe", "own"))
            unit = _unit(np.frombuffer(b"".join(t.column("raw").to_pylist()), kind).reshape(-1, dim))
            turned = _turned(unit)
            parts = blocks_of(dim)
            found = [(x[ok], y[ok]) for x, y in _pairs(turned, probe, own, i, j, parts, block, _budget(cosine, len(parts))) if (ok := (unit[x] * unit[y]).sum(axis=1) >= cosine).any()]
            if found:
                a, b = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
                links = np.bincount(a, times[b], len(key)) + np.bincount(b, times[a], len(key))
                root = _local_components(len(key), a, b)
                at = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(links[at].astype(np.int64)), pa.array(key[root[at]])], ["key", "links", "root"])

    return match


def linked(vectors: DataFrame, cosine: float = COSINE, tile: int = TILE) -> DataFrame:
    """One row per row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    ship(spark)
    width = shuffle_width(spark)
    single = vectors.schema["embedding"].dataType.elementType.typeName() == "float"
    kind = "<f4" if single else "<f8"
    narrow = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast(f"array<{'float' if single else 'double'}>"))
    rows = saved(narrow.mapInArrow(_vectors(kind), "vec_id long, key long, label long, raw binary"))
    known = saved(rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("times"), F.first("label").alias("label"), F.first("raw").alias("raw")))
    cells = known.select("key", "label", "times", "raw").mapInArrow(_cells(cosine, kind), "key long, label long, times long, raw binary, dim int, block int, cell int, probe int")
    at = ["label", "dim", "block", "cell"]
    cuts = cells.groupBy(*at).agg(F.ceil(F.count("*") / tile).cast("int").alias("cuts"), F.min("probe").alias("homes")).where("homes = 0").drop("homes")
    members = cells.join(cuts, at).withColumn("own", F.pmod(F.xxhash64("key"), F.col("cuts")).cast("int"))
    tiles = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    order = [*at, "i", "j"]
    laid = tiles.select(*order, "key", "times", "raw", "probe", "own").repartition(width, *order).sortWithinPartitions(*order)
    found = saved(laid.mapInArrow(_match(cosine, kind), "key long, links long, root long"))
    counted = found.groupBy("key").agg(F.sum("links").alias("links"))
    roots = components(found.select("key", "root")).withColumnRenamed("node", "key")
    of_root = named_roots(roots.join(known.select("key", "least"), "key"), "least")
    named = known.select("key", "least", "times").join(counted, "key", "left").join(of_root, "key", "left")
    named = named.select("key", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "least").alias("component_id"))
    out = rows.select("vec_id", "key").join(named, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
