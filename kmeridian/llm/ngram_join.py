"""N-gram Jaccard join by prefix trees.

A document's set is its distinct word shingles, as 64-bit hashes; equal sets form a class and are joined as one. For a
pair to reach the threshold its rarest common shingle must lie in the first `n - ceil(t n) + 1` shingles of both, in
any one global order. The order is by document frequency, then hash, so:

1. One pass over the texts sends each shingle (48 bits and the number of its document within the batch, packed) to a
   bucket by its value; of a class, a bucket gets the signature alone. Buckets return the shingles that two or more classes share; nothing else can count in an overlap.
2. Each class gathers its shared shingles and its size. Most classes are done here: their prefix is full of shingles they have alone.
3. Each class that shares a prefix shingle is compared with one other, the least signature it shares one with. Large groups
   of near copies mostly join here, in linear work; a hub's classes are dealt out in shares that each get the hub's set.
4. What is left are prefix shingles whose classes do not hang together yet. Classes linked by a chain of them form a block.
   A block is joined as it is, cut into tiles by number and bytes, while that sends a class no more often than it has such
   shingles; a larger one is not closed over: each of its shingles gets the classes that have it in their prefix, in tiles
   too, and finds those pairs whose rarest common shingle it is (a subtree that holds a rarer common one is left, its pairs
   belong there). So work follows the shingles that classes share, not the square of what chains of them connect.

A prefix tree holds a tile's sets, in the global order, as a compressed trie; each set walks it once, sharing the overlaps
of common parts, and leaves a subtree as soon as overlap so far plus what remains on either side cannot reach what the sizes
below it need. Sets that a chain of links already joins are passed over, as only components are asked for; all other pairs
are decided, so no link between components is lost.

Hashes: 64-bit set signatures are expected to clash once in about 6e9 distinct texts; a clash of 48-bit shingles
can miscount a pair's overlap by one with probability near n^2 / 2^48.

Defined results: null, empty and white-space texts have the empty set and are linked with nothing; texts with fewer
words than a shingle have one shingle; texts of any length are used whole; rows that repeat a doc_id or a text are one
class; a row with a null doc_id takes the least non-null doc_id of its component, null if there is none; similarities at the
threshold exactly link; an empty table gives no rows; other columns keep their values whatever their names (`one_of_each`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmeridian.llm.bpe import Memo, sole, trim
from kmeridian.llm.components import components, named_roots
from kmeridian.llm.streams import groups
from kmeridian.session import saved, ship, shuffle_width

WORDS, PERCENT = 5, 80
TILE = 1000  # classes that are joined in one tree, and its bytes of sets, but for a single larger set
TILE_BYTES = 24_000_000
STAR = 500  # classes compared with a hub in one task
_DOCS, _TOKENS = 60_000, 1_500_000  # what is sorted together at most (one set can be larger); documents have 16-bit numbers
_PART = 400_000  # tokens of a bucket that are looked at together, about
_hashed = Memo(xxhash.xxh3_64_intdigest, most=100_000)


def shingles(text: str | None, k: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of k-word shingles, A-Z lower-cased."""
    found = text.encode().lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashed.__getitem__, found), np.uint64, len(found))
    with np.errstate(over="ignore"):
        n = max(1, len(h) - k + 1)
        s = np.full(n, np.uint64(min(len(h), k)))
        for i in range(min(k, len(h))):
            s = (s ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            s ^= s >> np.uint64(32)
        s *= np.uint64(0xD6E8FEB86659FD93)
        s ^= s >> np.uint64(29)
    s.sort()
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


def _pack(tokens: np.ndarray, owner: np.ndarray) -> bytes:
    """Sorted 48-bit tokens as differences, and owners, both by byte planes, then zstd."""
    gaps = np.diff(tokens, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    planes = np.concatenate([gaps, owner.astype("<u2").view(np.uint8).reshape(-1, 2)], axis=1)
    return pa.Codec("zstd", compression_level=1).compress(np.ascontiguousarray(planes.T), asbytes=True)


def _unpack(blob: bytes, count: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.Codec("zstd").decompress(blob, decompressed_size=8 * count, asbytes=True), np.uint8).reshape(8, count).T
    gaps = np.zeros((count, 8), np.uint8)
    gaps[:, :6] = planes[:, :6]
    return np.cumsum(gaps.view("<u8").ravel()), np.ascontiguousarray(planes[:, 6:]).view("<u2").ravel()


_SENT = "bucket int, doc_id long, sig long, n int, count int, blob binary, classes int, sigs binary"


def _pack_sorted(values: np.ndarray) -> bytes:
    gaps = np.diff(values.astype("<u8"), prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)
    return pa.Codec("zstd", compression_level=1).compress(np.ascontiguousarray(gaps.T), asbytes=True)


def _unpack_sorted(blob: bytes, count: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(blob, decompressed_size=8 * count, asbytes=True), np.uint8).reshape(8, count)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel())


def _send(buckets: int, k: int):
    shape = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("sig", pa.int64()), ("n", pa.int32()), ("count", pa.int32()), ("blob", pa.binary()), ("classes", pa.int32()), ("sigs", pa.binary())])
    edges = (np.arange(buckets + 1, dtype=object) * (1 << 48) // buckets).astype(np.uint64)

    def dealt(held: dict[int, np.ndarray]) -> pa.RecordBatch:
        sigs = np.array(sorted(held), np.uint64)
        sets = [held[s] for s in sigs.tolist()]
        tokens = np.concatenate(sets) >> np.uint64(16)
        owner = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        cuts, rows = np.searchsorted(tokens, edges).tolist(), []
        for q, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if i < j:
                own, local = np.unique(owner[i:j], return_inverse=True)
                rows.append((q, None, None, None, j - i, _pack(tokens[i:j], local), len(own), _pack_sorted(sigs[own])))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), shape.types, strict=True)], schema=shape)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}  # sets by signature
        total = 0
        for b in batches:
            sole("shingles", _hashed.clear)
            m, sig, sizes = b.num_rows, [], []
            for text in b.column("text"):
                s = shingles(text.as_py(), k)
                sig.append(xxhash.xxh3_64_intdigest(s.tobytes()))
                sizes.append(len(s))
                if len(s) and sig[-1] not in held:
                    held[sig[-1]] = s
                    total += len(s)
                    if total >= _TOKENS or len(held) >= _DOCS:
                        yield dealt(held)
                        held, total = {}, 0
            # the documents' own rows go along, dealt over the buckets: by id and place, as copies share a signature
            ids = b.column("doc_id").cast(pa.int64())
            spread = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            home = (spread + np.arange(m, dtype=np.uint64)) % np.uint64(buckets)
            nulls = [pa.nulls(m, t) for t in shape.types[4:]]
            yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), ids, pa.array(np.array(sig, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), *nulls], schema=shape)
        if held:
            yield dealt(held)
        held.clear()
        trim()

    return send


_SHARED = pa.schema([("doc_id", pa.int64()), ("sig", pa.int64()), ("n", pa.int32()), ("token", pa.int64()), ("df", pa.int32())])


def _share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket: its documents' rows, and a row for each token and class where two or more classes have the token."""
    sole("buckets")
    for _, t in groups(batches, ["bucket"]):
        docs = t.filter(pc.is_null(t.column("count"))).select(["doc_id", "sig", "n"]).combine_chunks()
        if docs.num_rows:
            nulls = [pa.nulls(docs.num_rows, pa.int64()), pa.nulls(docs.num_rows, pa.int32())]
            yield pa.RecordBatch.from_arrays([*(docs.column(c).combine_chunks() for c in range(3)), *nulls], schema=_SHARED)
        tokens, owners, sigs, known = [], [], [], 0
        for count, blob, m, s in zip(*(t.column(c).to_pylist() for c in ("count", "blob", "classes", "sigs")), strict=True):
            if blob is not None:
                token, owner = _unpack(blob, count)
                tokens.append(token)
                owners.append(owner.astype(np.int32) + np.int32(known))
                sigs.append(_unpack_sorted(s, m).view(np.int64))
                known += m
        if not tokens:
            continue
        sig_of, low, high = np.concatenate(sigs), min(int(x[0]) for x in tokens), max(int(x[-1]) for x in tokens) + 1
        parts = -(-sum(map(len, tokens)) // _PART)
        edges = np.array([low + (high - low) * i // parts for i in range(parts + 1)], np.uint64)
        cuts = [np.searchsorted(x, edges) for x in tokens]
        for p in range(parts):
            out = _repeated(np.concatenate([x[c[p] : c[p + 1]] for x, c in zip(tokens, cuts, strict=True)]), np.concatenate([x[c[p] : c[p + 1]] for x, c in zip(owners, cuts, strict=True)]), sig_of)
            if out.num_rows:
                yield out


def _repeated(token: np.ndarray, owner: np.ndarray, sig_of: np.ndarray) -> pa.RecordBatch:
    """A row for each token and class where two or more classes have the token."""
    order = np.argsort(token, kind="stable")  # a token that stands alone needs no order of classes
    token = token[order]
    same = token[1:] == token[:-1]
    again = np.concatenate(([False], same)) | np.concatenate((same, [False])) if len(token) else np.zeros(0, bool)
    token, sig = token[again], sig_of[owner[order[again]]]
    order = np.lexsort((sig, token))
    token, sig = token[order], sig[order]
    new = np.concatenate(([True], (token[1:] != token[:-1]) | (sig[1:] != sig[:-1]))) if len(token) else np.zeros(0, bool)
    token, sig = token[new], sig[new]
    _, inverse, df = np.unique(token, return_inverse=True, return_counts=True)
    df = df[inverse]
    keep = df > 1
    m = int(keep.sum())
    return pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.array(sig[keep]), pa.nulls(m, pa.int32()), pa.array(token[keep].astype(np.int64)), pa.array(df[keep].astype(np.int32))], schema=_SHARED)


def _least_common(n: int, percent: int) -> int:
    """The least overlap that any partner of a set of n needs: ceil(percent n / 100)."""
    return -(-percent * n // 100)


def _gather(percent: int):
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0  # tokens of rows
        for (sig,), t in groups(batches, ["sig"]):
            if t.num_rows == 1:
                continue  # nothing is shared
            n = pc.max(t.column("n")).as_py()  # of the class's own row, which has no shingle
            t = t.filter(pc.is_valid(t.column("token")))
            take = n - _least_common(n, percent) + 1 - (n - t.num_rows)  # of the prefix, after the shingles it has alone
            if take > 0:
                token, df = (t.column(c).to_numpy() for c in ("token", "df"))
                order = np.lexsort((token, df))
                rows.append((sig, n, token[order[:take]].tolist(), token[order].tobytes(), df[order].astype("<i4").tobytes()))
                held += len(token)
            if len(rows) >= 500 or held > 200_000:
                yield _alive(rows)
                rows, held = [], 0
        if rows:
            yield _alive(rows)

    return gather


def _alive(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["sig", "n", "prefix", "tokens", "dfs"])


class Trie:
    """Sets in global order, common beginnings stored once. A node: its part, children, leaves from lo to hi, the least
    and most set size below, and the most tokens that follow its part in any set below."""

    def __init__(self, lists: list[np.ndarray], sizes: np.ndarray):
        self.order = sorted(range(len(lists)), key=lambda i: lists[i].tolist())
        self.sizes = sizes[self.order]
        ordered = [lists[i] for i in self.order]
        #: part, children, lo, hi, ends (leaves whose set ends with the part), least size, rest
        self.nodes: list[list] = []
        work = [(0, len(ordered), 0, -1)]
        while work:
            lo, hi, depth, parent = work.pop()
            first, last = ordered[lo], ordered[hi - 1]
            m = min(len(first), len(last)) - depth  # sorted: what first and last share, all share
            differ = np.flatnonzero(first[depth : depth + m] != last[depth : depth + m])
            end = depth + (int(differ[0]) if len(differ) else m)
            node = len(self.nodes)
            ends = lo
            while ends < hi and len(ordered[ends]) == end:
                ends += 1
            self.nodes.append([first[depth:end], [], lo, hi, ends, int(self.sizes[lo:hi].min()), max(len(x) for x in ordered[lo:hi]) - end])
            if parent >= 0:
                self.nodes[parent][1].append(node)
            at = ends
            while at < hi:
                token, to = ordered[at][end], at + 1
                while to < hi and ordered[to][end] == token:
                    to += 1
                work.append((at, to, end, node))
                at = to

    def links(self, mine: np.ndarray, own: np.ndarray, n: int, open_to: np.ndarray, percent: int, first: int = -1) -> list[int]:
        """Leaves that reach the threshold with a set: mine marks its tokens, own lists them; open_to: prefix sums of the
        leaves to look at; first: leaves with a common token before this one are not looked at."""
        found, total = [], 100 + percent
        work = [(0, 0)]
        while work:
            at, overlap = work.pop()
            part, children, lo, hi, ends, least, rest = self.nodes[at]
            if open_to[hi] == open_to[lo]:
                continue
            if len(part):
                common = part[mine[part]]
                if len(common) and not overlap and common[0] < first:
                    continue
                overlap += len(common)
                left = len(own) - int(np.searchsorted(own, part[-1], side="right"))
            else:
                left = len(own)
            if total * (overlap + min(left, rest)) < percent * (n + least):
                continue
            found += [i for i in range(lo, ends) if open_to[i + 1] > open_to[i] and total * overlap >= percent * (n + int(self.sizes[i]))]
            work += [(c, overlap) for c in children]
        return found


def join_tile(sigs: list[int], sizes: np.ndarray, tokens: list[np.ndarray], dfs: list[np.ndarray], side: np.ndarray | None, percent: int, roots: list[int] | None = None, first: int | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets (between sides, if side is given) that roots does not join yet; with first,
    of those whose first common token it is."""
    every, df = np.concatenate(tokens), np.concatenate(dfs)
    distinct, at, inverse, times = np.unique(every, return_index=True, return_inverse=True, return_counts=True)
    rank = np.empty(len(distinct), np.int64)
    rank[np.lexsort((distinct, df[at]))] = np.arange(len(distinct))
    start = -1 if first is None else int(rank[np.searchsorted(distinct, first)])
    shared = times[inverse] > 1
    cuts = np.cumsum([len(t) for t in tokens])[:-1]
    lists = [np.sort(r[s]) for r, s in zip(np.split(rank[inverse], cuts), np.split(shared, cuts), strict=True)]
    trie = Trie(lists, sizes)
    place = np.empty(len(lists), np.int64)
    place[trie.order] = np.arange(len(lists))
    root = np.arange(len(lists)) if roots is None else np.unique(np.array(roots)[trie.order], return_inverse=True)[1]  # of leaves, by component
    done = np.zeros(len(lists), bool)
    leaf_side = side[trie.order] if side is not None else None
    mine = np.zeros(len(distinct), bool)
    out = []
    for q in sorted(range(len(lists)), key=lambda i: -len(lists[i])):
        leaf = place[q]
        done[leaf] = True
        look = (root != root[leaf]) & ~done
        if leaf_side is not None:
            look &= leaf_side != leaf_side[leaf]
        if not look.any():
            continue
        mine[lists[q]] = True
        for other in trie.links(mine, lists[q], int(sizes[q]), np.concatenate(([0], np.cumsum(look))), percent, start):
            if root[other] != root[leaf]:
                root[root == root[other]] = root[leaf]
                out.append((sigs[q], sigs[trie.order[other]]))
        mine[lists[q]] = False
    return out


def _links(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _join(percent: int):
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole("tiles")
        for (whole, key, i, j), t in groups(batches, ["whole", "key", "i", "j"]):
            if t.num_rows < 2:
                continue
            tokens = [np.frombuffer(x, np.int64) for x in t.column("tokens").to_pylist()]
            dfs = [np.frombuffer(x, "<i4") for x in t.column("dfs").to_pylist()]
            side = t.column("own").to_numpy() if i != j else None
            out = join_tile(t.column("sig").to_pylist(), t.column("n").to_numpy(), tokens, dfs, side, percent, t.column("root").to_pylist(), None if whole else key)
            if out:
                yield _links(out)

    return join


def _star(percent: int):
    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by hub, share and centre first: links of a share's classes with its hub."""
        sole("stars")
        at, centre, size = None, np.zeros(0, np.int64), 0
        for b in batches:
            out = []
            for hub, share, sig, n, tokens in zip(*(b.column(c).to_pylist() for c in ("hub", "share", "sig", "n", "tokens")), strict=True):
                mine = np.frombuffer(tokens, np.int64)
                if sig == hub:
                    at, centre, size = (hub, share), np.sort(mine), n
                elif at == (hub, share):
                    overlap = int((centre[np.minimum(np.searchsorted(centre, mine), len(centre) - 1)] == mine).sum())
                    if (100 + percent) * overlap >= percent * (n + size):
                        out.append((sig, hub))
            if out:
                yield _links(out)

    return star


def _stars(alive: DataFrame, postings: DataFrame, percent: int) -> DataFrame:
    """Links of classes with their least neighbour."""
    width = shuffle_width(alive.sparkSession)
    of_token = postings.groupBy("token").agg(F.min("sig").alias("hub"), F.count("*").alias("c")).where("c > 1").drop("c")
    hubs = postings.join(of_token, "token").groupBy("sig").agg(F.min("hub").alias("hub")).where("hub < sig")
    shares = hubs.groupBy("hub").agg(F.ceil(F.count("*") / STAR).cast("int").alias("shares"))
    sets = alive.select("sig", "n", "tokens")
    around = sets.join(hubs.join(shares, "hub"), "sig").withColumn("share", F.pmod(F.xxhash64("sig"), F.col("shares")).cast("int")).select("hub", "share", "sig", "n", "tokens")
    centres = sets.join(shares, F.col("sig") == F.col("hub")).select("hub", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "sig", "n", "tokens")
    dealt = around.unionByName(centres).repartition(width, "hub", "share").sortWithinPartitions("hub", "share", "sig")  # hub < sig
    return dealt.mapInArrow(_star(percent), "a long, b long")


def _tiles(alive: DataFrame, postings: DataFrame, joined: DataFrame, tile: int) -> DataFrame:
    """What is left to join, laid out for _join: whole blocks, and the single shingles of larger ones."""
    rooted = saved(postings.join(joined.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "token", F.coalesce("root", "sig").alias("root")))
    open_ = rooted.groupBy("token").agg(F.min("sig").alias("hub"), F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("token", "hub")
    left = saved(rooted.join(open_, "token"))
    blocks = components(left.where("sig <> hub").select("sig", "hub")).select(F.col("node").alias("sig"), F.col("root").alias("block"))
    own = left.groupBy("sig").agg(F.min("root").alias("root"), F.count("*").alias("tokens_open"))
    members = alive.drop("prefix").join(blocks, "sig").join(own, "sig").withColumn("size", (F.octet_length("tokens") + F.octet_length("dfs")).cast("long"))
    cut = F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum("size") / TILE_BYTES)).cast("int").alias("cuts")
    plans = members.groupBy("block").agg(cut, (F.sum("tokens_open") / F.count("*")).alias("each"))  # rows sent a class: cuts, or one for each open token
    members = members.join(plans, "block")
    whole = members.where("cuts <= each").select(F.lit(1).alias("whole"), F.col("block").alias("key"), "cuts", "sig", "n", "root", "tokens", "dfs")
    single = members.where("cuts > each").select("sig", "n", "size", "tokens", "dfs").join(left.select("sig", "token", "root"), "sig")
    single = single.join(single.groupBy("token").agg(cut), "token").select(F.lit(0).alias("whole"), F.col("token").alias("key"), "cuts", "sig", "n", "root", "tokens", "dfs")
    dealt = whole.unionByName(single).withColumn("own", F.pmod(F.xxhash64("sig"), F.col("cuts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    laid = dealt.select("whole", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "sig", "n", "root", "tokens", "dfs", "own")
    order = ["whole", "key", "i", "j"]
    return laid.repartition(shuffle_width(alive.sparkSession), *order).sortWithinPartitions(*order)


def classes(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(doc_id, sig, n of every document; node, root of every linked class)."""
    spark = docs.sparkSession
    ship(spark)
    width = shuffle_width(spark)
    buckets = width  # each costs a signature for every class that has a shingle there
    sent = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_send(buckets, k), _SENT)
    shared = saved(sent.repartition(width, "bucket").sortWithinPartitions("bucket").mapInArrow(_share, "doc_id long, sig long, n int, token long, df int"))
    own = shared.where("token is null").select("doc_id", "sig", "n")
    sizes = own.where("n > 0").groupBy("sig").agg(F.first("n").alias("n"), F.lit(None).cast("long").alias("token"), F.lit(None).cast("int").alias("df"))
    gathered = shared.where("token is not null").select("sig", "n", "token", "df").unionByName(sizes).repartition(width, "sig").sortWithinPartitions("sig")
    alive = saved(gathered.mapInArrow(_gather(percent), "sig long, n int, prefix array<long>, tokens binary, dfs binary"))
    postings = alive.select("sig", F.explode("prefix").alias("token"))
    stars = saved(_stars(alive, postings, percent))  # saved: a task with two kernels would hold two workers
    rest = saved(_tiles(alive, postings, components(stars), tile).mapInArrow(_join(percent), "a long, b long"))
    return own, components(stars.unionByName(rest))


def components_of(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    own, linked = classes(docs, k, percent)
    least = own.where("n > 0").groupBy(F.col("sig").alias("key")).agg(F.min("doc_id").alias("least"))
    of_root = named_roots(least.join(linked.withColumnRenamed("node", "key"), "key"), "least")
    named = least.join(of_root, "key", "left").select(F.col("key").alias("_sig"), F.coalesce("component", "least").alias("component"))
    joined = own.join(named, (F.col("sig") == F.col("_sig")) & (F.col("n") > 0), "left")
    return joined.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component: of its rows the one of least doc_id, those without an id last, and of rows of one id the
    least by a hash of id and text. Rows are told apart by that hash, so a repeated doc_id takes no other text with it; of
    rows that repeat doc_id and text, one stays. Texts without words are each their own component."""
    keyed = docs.select(F.xxhash64(F.col("doc_id").cast("long"), "text").alias("key"), F.struct("*").alias("row"))
    own, linked = classes(keyed.select(F.col("key").alias("doc_id"), "row.text"))
    own = own.select(F.col("doc_id").alias("key"), "sig", "n").distinct()
    ids = keyed.select("key", F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").cast("long").alias("id"), F.col("key").alias("key")).alias("rank"))
    least = own.where("n > 0").join(ids, "key").groupBy("sig").agg(F.min("rank").alias("rank"))
    of_each = least.join(linked.withColumnRenamed("node", "sig"), "sig", "left").groupBy(F.coalesce("root", "sig").alias("root")).agg(F.min("rank").alias("rank"))
    stay = of_each.select(F.col("rank.key").alias("key")).unionByName(own.where("n = 0").select("key"))
    return keyed.join(stay, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
