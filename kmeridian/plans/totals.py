"""Totals of least distances to sketches that are too large to broadcast: k-mers of queries and sketches are dealt out by bucket,
packed, and compared there, each different k-mer once.

k-mers whose bucket no sketch has are counted where they are, by a table of bits of the buckets; it has 2^MAP_BITS bits at most,
and buckets share bits where there are more. A bucket is one task's."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmeridian.functions import encode as E
from kmeridian.plans import sketching as S
from kmeridian.session import saved, ship, shuffle_width

#: k-mers of sketches that are broadcast together, at most: beyond that each bucket's k-mers are compared where all are.
KERNEL_ROWS = 1_000_000
MAP_BITS = 25
#: Pairs of a bucket from which they are compared as a block, those from which halves of its keys are, and pairs of a block.
BLOCK_FROM, HALVES_FROM, BLOCK = 1_500, 100_000, 1 << 16
#: Halves of the references' keys that are tried at once.
HALVES = 1_024
_DEALT = "share int, rid int, is_rc int, size long, keys binary, counts binary, places binary, n long, pos long"
_SHAPE = pa.schema([("share", pa.int32()), ("rid", pa.int32()), ("is_rc", pa.int32()), ("size", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("places", pa.binary()), ("n", pa.int64()), ("pos", pa.int64())])


class Keys:
    """(bucket, rest) of k-mers and of their reverse complements as one number, by tables of 16 bits."""

    def __init__(self, k: int, ppos: tuple[int, ...], npos: tuple[int, ...], m: int, r: int, frac: bool):
        self.low, self.m, self.r, self.frac = np.uint64(2 * len(npos)), np.uint64(m), np.uint64(r), frac
        every = np.arange(1 << 16, dtype=np.uint64)
        of = lambda x: E.gather(x, ppos) << self.low | E.gather(x, npos)
        words = [every[: 1 << min(16, 2 * k - at)] << np.uint64(at) for at in range(0, 2 * k, 16)]
        turned = of(E.reverse_complements(np.zeros(1, np.uint64), k))
        self.tables = [of(x) for x in words], [of(E.reverse_complements(x, k)) ^ (turned if i else np.uint64(0)) for i, x in enumerate(words)]

    def __call__(self, bp: np.ndarray, strand: int = 0) -> tuple[np.ndarray, np.ndarray | None]:
        """(keys of the k-mers in the partition, which these are; None: all)."""
        out = np.zeros(len(bp), np.uint64)
        for i, t in enumerate(self.tables[strand]):
            out ^= t[(bp >> np.uint64(16 * i)) & np.uint64(0xFFFF)]
        if self.frac and self.r + np.uint64(1) == self.m:
            return out, None
        bucket = out >> self.low
        over = bucket % self.m
        at = np.flatnonzero(over <= self.r if self.frac else over == self.r)
        row = bucket[at] // self.m * (self.r + np.uint64(1)) + over[at] if self.frac else bucket[at] // self.m
        return row << self.low | (out[at] & ((np.uint64(1) << self.low) - np.uint64(1))), at


def _zipped(x: np.ndarray) -> bytes:
    """Non-negative numbers, their bytes by place."""
    return pa.compress(np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T), "zstd", asbytes=True)


def _unzipped(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel().astype(np.int64)


def _by_share(keys: np.ndarray, low: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order that puts sorted keys by share, the shares there are, their ends in that order)."""
    share = (E.mixed(keys >> low) % np.uint64(S.SHARES)).astype(np.int16)
    sizes = np.bincount(share, minlength=S.SHARES)
    at = np.flatnonzero(sizes)
    return np.argsort(share, kind="stable"), at, np.cumsum(sizes)[at]


def _packed(keys: np.ndarray, low: np.uint64, rid: int | None, strand: int | None, counts: np.ndarray | None = None, places: np.ndarray | None = None) -> pa.RecordBatch:
    order, shares, ends = _by_share(keys, low)
    cut = lambda x, pack: [None] * len(shares) if x is None else [pack(v) for v in np.split(x[order], ends[:-1])] if len(shares) else []
    same = lambda v: [v] * len(shares)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((shares, same(rid), same(strand), np.diff(ends, prepend=0), cut(keys, S._packed), cut(counts, _zipped), cut(places, _zipped), same(None), same(None)), _SHAPE, strict=True)], schema=_SHAPE)


def _bits(rows: DataFrame, size: int) -> np.ndarray:
    """Which buckets there are, modulo size."""
    at = F.col("rix") % size
    words = rows.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((rix % {size}) & 63 as int))")).alias("b"))
    out = np.zeros(max(1, size >> 6), np.int64)
    t = words.toArrow()  # 2^(MAP_BITS - 6) rows at most
    out[t.column("w").to_numpy()] = t.column("b").to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _planes(enc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Low and high bits of 16 bases of two bits."""

    def even(x: np.ndarray) -> np.ndarray:
        x = x & np.uint32(0x55555555)
        for n, mask in ((1, 0x33333333), (2, 0x0F0F0F0F), (4, 0x00FF00FF), (8, 0x0000FFFF)):
            x = (x | x >> np.uint32(n)) & np.uint32(mask)
        return x.astype(np.uint16)

    x = enc.astype(np.uint32)
    return even(x), even(x >> np.uint32(1))


def _order(keys: np.ndarray, low: np.uint64) -> np.ndarray:
    """What sorts keys, by two sorts of numbers that carry their places: faster than argsort."""
    place, n = np.arange(len(keys), dtype=np.uint64), np.uint64(max(1, len(keys)).bit_length())
    mask = (np.uint64(1) << n) - np.uint64(1)
    by_rest = np.sort((keys & ((np.uint64(1) << low) - np.uint64(1))) << n | place) & mask
    return by_rest[np.sort(keys[by_rest] >> low << n | place) & mask]


def _half_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of halves of keys: 8 bases, the low bits in one byte, the high ones in the other."""
    x = (a & 0xFF).astype(np.uint8)[:, None] ^ (b & 0xFF).astype(np.uint8)
    x |= (a >> 8).astype(np.uint8)[:, None] ^ (b >> 8).astype(np.uint8)
    return np.bitwise_count(x)


def _least_by_halves(ref: tuple[np.ndarray, np.ndarray], own: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least distance of each key of own to ref, all of one bucket, as planes: the least sum, over the different first halves
    of ref, of the distance to it and of the least one of second halves beside it, which is found once for equal second halves
    of own. Which half is first is chosen by the work."""
    halves = [[np.unique(x, return_inverse=True) for x in ((h >> 8 << 8) | l >> 8, (h & 0xFF) << 8 | l & 0xFF)] for l, h in (ref, own)]
    if len(ref[0]) * len(halves[1][0][0]) + len(own[0]) * len(halves[0][1][0]) < len(ref[0]) * len(halves[1][1][0]) + len(own[0]) * len(halves[0][0][0]):
        halves = [x[::-1] for x in halves]
    ((first, f_at), (second, s_at)), ((mine, m_at), (others, o_at)) = halves
    size = np.bincount(f_at)
    rank = np.argsort(-size, kind="stable")  # first halves with many seconds come first
    first, size, group = first[rank], size[rank], np.argsort(rank)[f_at]
    seconds, ends = s_at[np.argsort(group, kind="stable")], np.cumsum(size)
    order = np.argsort(o_at, kind="stable")
    m_at, o_at = m_at[order], o_at[order]
    best = np.full(len(order), 99, np.uint8)
    for a in range(0, len(first), HALVES):
        n, starts = size[a : a + HALVES], (ends - size)[a : a + HALVES]
        far = _half_distances(mine, first[a : a + HALVES])
        for o in range(0, len(others), 2 * HALVES):
            near = _half_distances(second, others[o : o + 2 * HALVES])
            beside = near[seconds[starts]]
            for i in range(1, int(n[0])):
                more = int(np.searchsorted(-n, -i, "left"))  # those with more than i seconds
                np.minimum(beside[:more], near[seconds[starts[:more] + i]], out=beside[:more])
            beside = np.ascontiguousarray(beside.T)
            lo, hi = np.searchsorted(o_at, [o, o + 2 * HALVES]).tolist()
            rows = max(1, 4 * BLOCK // len(n))
            for c in range(lo, hi, rows):
                at = slice(c, min(hi, c + rows))
                x = np.take(beside, o_at[at] - o, axis=0)
                x += np.take(far, m_at[at], axis=0)
                np.minimum(best[at], x.min(axis=1), out=best[at])
    out = np.empty_like(best)
    out[order] = best
    return out


def least(ref: np.ndarray, own: np.ndarray, low: np.uint64) -> np.ndarray:
    """The least distance of each key of own to the keys of its bucket in ref, 99 if there are none; both are sorted and distinct."""
    best = np.full(len(own), 99, np.uint8)
    if not len(ref) or not len(own):
        return best
    at = np.searchsorted(ref, own)
    exact = ref[np.minimum(at, len(ref) - 1)] == own
    best[exact] = 0
    left = np.flatnonzero(~exact)
    starts = np.flatnonzero(np.diff(ref >> low, prepend=(ref[0] >> low) + np.uint64(1)))
    buckets, ends = ref[starts] >> low, np.append(starts[1:], len(ref))
    mine = own[left] >> low
    i = np.minimum(np.searchsorted(buckets, mine), len(buckets) - 1)
    there = buckets[i] == mine
    left, i = left[there], i[there]
    if not len(left):
        return best
    (rl, rh), (ql, qh) = _planes(ref & np.uint64(0xFFFFFFFF) if low >= 32 else ref & ((np.uint64(1) << low) - np.uint64(1))), _planes(own[left] & ((np.uint64(1) << low) - np.uint64(1)))
    firsts = np.flatnonzero(np.diff(i, prepend=-1))
    lasts = np.append(firsts[1:], len(i))
    lo, hi = starts[i], ends[i]
    found = np.full(len(left), 99, np.uint8)
    dense = (lasts - firsts) * (ends[i[firsts]] - starts[i[firsts]]) >= BLOCK_FROM
    for a, b in zip(firsts[dense].tolist(), lasts[dense].tolist(), strict=True):
        u, v = int(lo[a]), int(hi[a])
        if (b - a) * (v - u) >= HALVES_FROM:
            found[a:b] = _least_by_halves((rl[u:v], rh[u:v]), (ql[a:b], qh[a:b]))
            continue
        rows = max(1, BLOCK // (v - u))
        for c in range(a, b, rows):
            d = min(b, c + rows)
            x = ql[c:d, None] ^ rl[u:v]
            x |= qh[c:d, None] ^ rh[u:v]
            n = np.bitwise_count(x.view(np.uint8)).view(np.uint16)  # bytes are counted faster
            found[c:d] = (n + (n << np.uint16(8))).min(axis=1) >> np.uint16(8)
    few = np.flatnonzero(~np.repeat(dense, lasts - firsts))
    n = hi[few] - lo[few]
    total = np.cumsum(n)
    cut = 0
    while cut < len(few):
        to = max(cut + 1, int(np.searchsorted(total, (total[cut - 1] if cut else 0) + 16 * BLOCK, "right")))
        part, size = few[cut:to], n[cut:to]
        first = np.cumsum(size) - size
        r = np.arange(size.sum()) + np.repeat(lo[part] - first, size)
        x = (rl[r] ^ np.repeat(ql[part], size)) | (rh[r] ^ np.repeat(qh[part], size))
        found[part] = np.minimum.reduceat(np.bitwise_count(x), first)
        cut = to
    best[left] = found
    return best


def hashing(s: dict) -> tuple:
    """What sketches that hash alike share."""
    return s["k"], tuple(s["ppos"]), tuple(s["npos"]), s["m"], s["r"], s["frac"]


def _numbered(rows: DataFrame, rids: list[str]) -> DataFrame:
    return rows.where(F.col("rid").isin(rids)).select((F.array_position(F.array(*map(F.lit, rids)), F.col("rid")) - 1).cast("int").alias("rid"), "rix", "enc")


def _laid_refs(low: np.uint64):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = {}, 0

        def out() -> Iterator[pa.RecordBatch]:
            for rid, keys in held.items():
                yield _packed(S._distinct(np.concatenate(keys)), low, rid, None)

        for b in batches:
            rid = b.column("rid").to_numpy()
            keys = b.column("rix").to_numpy().view(np.uint64) << low | b.column("enc").to_numpy().view(np.uint64)
            for x in np.unique(rid).tolist():
                held.setdefault(x, []).append(keys[rid == x])
            total += len(keys)
            if total >= S.HELD:
                yield from out()
                held, total = {}, 0
        yield from out()

    return run


def by_sequence(queries: DataFrame, sketches: list[dict], rows: DataFrame, canonical: bool, consume, schema: str) -> DataFrame:
    """consume(rows, sketch, ids, sizes, found) for chunks of sequences and each of the sketches, which hash alike: found has, by
    strand, row, position and least distance (99: an empty bucket) of all k-mers in the partition. Distances go back to the chunk
    that asked, a byte for each different key of both strands; a chunk's k-mers are made again there."""
    spark = queries.sparkSession
    ship(spark)
    rids, how, k, low = [x["rid"] for x in sketches], hashing(sketches[0]), sketches[0]["k"], np.uint64(2 * len(sketches[0]["npos"]))
    own, size, kind = _numbered(rows, [x["rid"] for x in sketches]), 1 << min(MAP_BITS, 2 * sketches[0]["h"]), dict(queries.dtypes)["query_id"]
    shared = spark.sparkContext.broadcast(_bits(own, size))

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, seqs, total, at, of = [], [], 0, TaskContext.get().partitionId() << 32, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([ids], pa.list_(of)), pa.array([seqs], pa.list_(pa.string()))], ["chunk", "ids", "seqs"])

        for b in batches:
            of = b.column("query_id").type
            for query, seq in zip(b.column("query_id").to_pylist(), b.column("seq").to_pylist(), strict=True):
                ids.append(query)
                seqs.append(seq)
                total += len(seq or "")
                if total >= S.HELD:
                    yield row()
                    ids, seqs, total, at = [], [], 0, at + 1
        if ids:
            yield row()

    def made(seqs: list[str | None]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        parts = [E.encode_all(x, k) for x in seqs]
        pos, bp = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pos, [np.maximum(bp, E.reverse_complements(bp, k))] if canonical else [bp, bp], np.repeat(np.arange(len(seqs)), [len(x) for x, _ in parts])

    def asked(key_of: Keys, strands: list[np.ndarray]) -> tuple:
        """(by strand which k-mers are in the partition, None: all; the keys of these; which of them have a bucket)."""
        keys, at = zip(*(key_of(bp, strand) for strand, bp in enumerate(strands)), strict=True)
        keys = np.concatenate(keys)
        return at, keys, shared.value[(keys >> low).astype(np.int64) & (size - 1)]

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_of = Keys(*how)
        for b in batches:
            for chunk, seqs in zip(b.column("chunk").to_pylist(), b.column("seqs").to_pylist(), strict=True):
                _, keys, there = asked(key_of, made(seqs)[1])
                keys = S._distinct(keys[there])
                if len(keys):
                    out = _packed(keys, low, None, None)
                    yield pa.RecordBatch.from_arrays([*out.columns[:-2], pa.array([chunk] * len(out)), out.columns[-1]], schema=_SHAPE)  # n: the chunk

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def share(at: int, refs: dict[int, list[np.ndarray]], asks: list[tuple]) -> Iterator[pa.RecordBatch]:
            if not asks:
                return
            keys, back = np.unique(np.concatenate([x[1] for x in asks]), return_inverse=True)
            ends = np.cumsum([len(x[1]) for x in asks])[:-1]
            for rid in range(len(rids)):
                if rid in refs:
                    hd = np.split(least(S._distinct(np.concatenate(refs[rid])), keys, low)[back], ends)
                    cols = ([x[0] for x in asks], [at] * len(asks), [rid] * len(asks), [pa.compress(x, "zstd", asbytes=True) for x in hd])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["chunk", "share", "rid", "hd"])

        last, refs, asks = None, {}, []
        for b in batches:
            for r in b.to_pylist():
                if r["share"] != last:
                    yield from share(last, refs, asks)
                    last, refs, asks = r["share"], {}, []
                keys = S._unpacked(r["keys"], r["size"])
                if r["rid"] is not None:
                    refs.setdefault(r["rid"], []).append(keys)
                else:
                    asks.append((r["n"], keys))
        yield from share(last, refs, asks)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_of = Keys(*how)

        def done(chunk: dict, pieces: dict[tuple, bytes]) -> Iterator[pa.RecordBatch]:
            pos, strands, owner = made(chunk["seqs"])
            at, keys, there = asked(key_of, strands)
            at = [slice(None) if x is None else x for x in at]
            place = [(owner[x], pos[x]) for x in at]
            cuts = np.cumsum([len(x) for x, _ in place])[:-1]
            mine = keys[there]
            order = _order(mine, low)
            mine = mine[order]
            first = np.diff(mine, prepend=~mine[:1]) != 0
            mine, of = mine[first], np.cumsum(first) - 1
            by_share, shares, ends = _by_share(mine, low)
            for rid, s in enumerate(sketches):
                each = np.full(len(mine), 99, np.uint8)
                for x, a, b in zip(shares.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    if (piece := pieces.get((x, rid))) is not None:
                        each[by_share[a:b]] = np.frombuffer(pa.decompress(piece, b - a, "zstd", asbytes=True), np.uint8)
                met = np.empty(len(of), np.uint8)
                met[order] = each[of]
                hd = np.full(len(keys), 99, np.uint8)
                hd[there] = met
                yield from consume(list(range(len(chunk["ids"]))), s, chunk["ids"], [len(x or "") for x in chunk["seqs"]], [(*x, y) for x, y in zip(place, np.split(hd, cuts), strict=True)])

        chunk, pieces = None, {}
        for b in batches:
            for r in b.to_pylist():
                if r["seqs"] is not None:
                    if chunk:
                        yield from done(chunk, pieces)
                    chunk, pieces = r, {}
                else:
                    pieces[r["share"], r["rid"]] = r["hd"]
        if chunk:
            yield from done(chunk, pieces)

    chunks = saved(queries.select("query_id", "seq").mapInArrow(chunked, f"chunk long, ids array<{kind}>, seqs array<string>"))
    every = own.mapInArrow(_laid_refs(low), _DEALT).unionByName(chunks.select("chunk", "seqs").mapInArrow(laid, _DEALT))
    pieces = every.repartition(shuffle_width(spark), "share").sortWithinPartitions("share").mapInArrow(met, "chunk long, share int, rid int, hd binary")
    home = chunks.unionByName(pieces, allowMissingColumns=True).repartition(shuffle_width(spark), "chunk")
    return home.sortWithinPartitions("chunk", F.col("share").asc_nulls_first()).mapInArrow(back, schema)


def dealt_totals(queries: DataFrame, sketches: list[dict], rows: DataFrame, canonical: bool, positions: bool) -> DataFrame:
    """rid, is_rc, hd, n, pos of sketches (rows of meta) that hash alike."""
    spark = queries.sparkSession
    ship(spark)
    s = sketches[0]
    rids = [x["rid"] for x in sketches]
    how, k, low = hashing(s), s["k"], np.uint64(2 * len(s["npos"]))
    own = _numbered(rows, rids)
    size = 1 << min(MAP_BITS, 2 * s["h"])
    shared = spark.sparkContext.broadcast(_bits(own, size))

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_of, there = Keys(*how), shared.value

        def dealt(bp: np.ndarray, pos: np.ndarray, strand: int) -> Iterator[pa.RecordBatch]:
            keys, at = key_of(bp, strand if not canonical else 0)
            if at is not None:
                pos = pos[at]
            met = there[(keys >> low).astype(np.int64) & (size - 1)]
            none = len(met) - int(np.count_nonzero(met))
            if none:  # counted here
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((-1, None, strand, 0, None, None, None, none, int(pos[~met].sum()) if positions else 0), _SHAPE, strict=True)], schema=_SHAPE)
            if none == len(met):
                return
            keys = keys[met]
            if positions:
                order = np.argsort(keys)
                keys, pos = keys[order], pos[met][order]
            else:
                keys = np.sort(keys)
            first = np.flatnonzero(np.diff(keys, prepend=keys[0] + np.uint64(1)))
            yield _packed(keys[first], low, None, strand, np.diff(first, append=len(keys)), np.add.reduceat(pos, first) if positions else None)

        def out(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            pos, bp = (np.concatenate(x) for x in zip(*held, strict=True))
            if canonical:
                yield from dealt(np.maximum(bp, E.reverse_complements(bp, k)), pos, 0)
            else:
                yield from dealt(bp, pos, 0)
                yield from dealt(bp, pos, 1)

        held, total = [], 0
        for b in batches:
            for seq in b.column("seq").to_pylist():
                pos, bp = E.encode_all(seq, k)
                if len(pos):
                    held.append((pos, bp))
                    total += len(pos)
                if total >= S.HELD:
                    yield from out(held)
                    held, total = [], 0
        if held:
            yield from out(held)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rid", "is_rc", "hd", "n", "pos"]
        total: dict[tuple, list[int]] = {}

        def count(rid: int, strand: int, hd: int | None, n: int, pos: int) -> None:
            t = total.setdefault((rid, strand, hd), [0, 0])
            t[0], t[1] = t[0] + n, t[1] + pos

        def share(refs: dict[int, list[np.ndarray]], asked: list[tuple]) -> None:
            if not asked:
                return
            keys, at = np.unique(np.concatenate([x[1] for x in asked]), return_inverse=True)
            ends = np.cumsum([len(x[1]) for x in asked])
            for rid in range(len(rids)):
                hd = least(S._distinct(np.concatenate(refs[rid])) if rid in refs else np.zeros(0, np.uint64), keys, low)[at]
                for (strand, own_keys, n, pos), end in zip(asked, ends.tolist(), strict=True):
                    mine = hd[end - len(own_keys) : end]
                    ns, ps = np.bincount(mine, n), np.bincount(mine, pos) if pos is not None else None  # sums below 2^53
                    for d in np.flatnonzero(ns).tolist():
                        count(rid, strand, None if d == 99 else d, int(ns[d]), int(ps[d]) if ps is not None else 0)

        last, refs, asked = None, {}, []
        for b in batches:
            for r in b.to_pylist():
                if r["share"] != last:
                    share(refs, asked)
                    last, refs, asked = r["share"], {}, []
                if r["keys"] is None:
                    for rid in range(len(rids)):
                        count(rid, r["is_rc"], None, r["n"], r["pos"])
                elif r["rid"] is not None:
                    refs.setdefault(r["rid"], []).append(S._unpacked(r["keys"], r["size"]))
                else:
                    asked.append((r["is_rc"], S._unpacked(r["keys"], r["size"]), _unzipped(r["counts"], r["size"]), _unzipped(r["places"], r["size"]) if r["places"] is not None else None))
        share(refs, asked)
        found = [(rids[rid], strand, hd, n, pos) for (rid, strand, hd), (n, pos) in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [[]] * 5, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names)

    every = own.mapInArrow(_laid_refs(low), _DEALT).unionByName(queries.select("seq").mapInArrow(laid, _DEALT))
    dealt = every.repartition(shuffle_width(spark), "share").sortWithinPartitions("share")
    return dealt.mapInArrow(met, "rid string, is_rc int, hd int, n long, pos long").groupBy("rid", "is_rc", "hd").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))


def least_totals(queries: DataFrame, meta: DataFrame, rows: DataFrame, kernel_rows: int = KERNEL_ROWS, canonical: bool = False, positions: bool = True) -> DataFrame:
    """rid, is_rc, hd, n, pos: how many k-mers of all queries have each least distance (null: an empty bucket), and the sum of
    their positions (0 without `positions`). The same as least_distances gives row by row."""
    from kmeridian.plans import mapping as M

    small, large = M._split(meta, rows, kernel_rows)
    alike: dict[tuple, list[dict]] = {}
    for s in large:
        alike.setdefault(hashing(s), []).append(s)
    parts = [dealt_totals(queries, group, rows, canonical, positions) for group in alike.values()]
    if small or not large:
        shared = queries.sparkSession.sparkContext.broadcast(small)  # its size was checked
        ship(queries.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for _, s, _, strand, pos, hd in M._found(shared.value, b, canonical):
                    key = strand * 100 + hd
                    n, at = np.bincount(key), np.bincount(key, pos)  # sums below 2^53
                    there = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array([s["rid"]] * len(there), pa.string()), pa.array((there // 100).astype(np.int32)), pa.array((there % 100).astype(np.int32), mask=there % 100 == 99), pa.array(n[there]), pa.array(at[there].astype(np.int64))], ["rid", "is_rc", "hd", "n", "pos"])

        parts.append(queries.select("query_id", "seq").mapInArrow(run, "rid string, is_rc int, hd int, n long, pos long").groupBy("rid", "is_rc", "hd").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")))
    return M._union(parts)
