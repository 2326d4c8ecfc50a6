"""The catalogue's queries over whole documents against plain Python on a small table that holds nothing but documents."""

from collections import Counter, defaultdict
from functools import reduce
from operator import xor

import numpy as np
import pytest

from kmeridian import catalog as C
from kmeridian.functions import encode as E

K, W, MASK = 27, 31, (1 << 64) - 1
signed = lambda x: x - (1 << 64) if x >> 63 else x


def seq(text):
    return "".join("ACGTACGTACGTACGT"[int(c, 16)] for c in text.encode().hex())


def kmers(s):
    return [sum("ACGT".index(c) << 2 * (K - 1 - i) for i, c in enumerate(s[at : at + K])) for at in range(len(s) - K + 1)]


def picked(x, positions):
    return sum((x >> 2 * p & 3) << 2 * i for i, p in enumerate(sorted(positions)))


def turned(x):
    return sum((3 - (x >> 2 * i & 3)) << 2 * (K - 1 - i) for i in range(K))


def mixed(x):
    for m in (E.MIX_1, E.MIX_2):
        x = (x ^ x >> 33) * m & MASK
    return x ^ x >> 33


def planes(x):
    return sum((x >> 2 * i & 1) << i | (x >> 2 * i + 1 & 1) << 32 + i for i in range(K))


def apart(x, y):
    return sum(1 for i in range(K) if (x ^ y) >> 2 * i & 3)


def least_of_windows(ks):
    n = W - K + 1
    return [min(ks[i : i + n], key=mixed) for i in range(len(ks) - n + 1)]


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    rng = np.random.default_rng(12)
    words = [f"wort{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words, 25 + 5 * i))) for i in range(8)]
    rows += [(9, rows[4][1].replace("wort7", "word7")), (10, ""), (11, None), (12, "kurz"), (13, "dreizehn byte"), (None, "ohne Nummer " * 6), (15, rows[6][1] + "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 400)))]  # 15: half of it near 6
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder, {d: kmers(seq(t)) for d, t in rows if t is not None and len(seq(t)) >= K}


def rows_of(spark, name, folder):
    return Counter(tuple(r) for r in C.QUERIES[name](spark, folder).collect())


def test_sequence_queries_read_every_document(spark, texts):
    folder, ks = texts
    value = {
        "kmer_encode": lambda x: x, "revcomp": turned, "bp_to_planes": planes, "mixer": mixed,
        "lsh_bucket": lambda x: picked(x, C.PPOS), "drop_positions": lambda x: picked(x, C.PARAMS.npos),
    }
    for name, f in value.items():
        assert rows_of(spark, f"{name}_documents", folder) == Counter((d, len(v), signed(reduce(xor, map(f, v)))) for d, v in ks.items()), name
    assert rows_of(spark, "kmer_extract_documents", folder) == Counter((d, len(v), len(set(v))) for d, v in ks.items())
    pairs = {d: sum(apart(a, b) for a, b in zip(v, v[1:], strict=False)) for d, v in ks.items() if len(v) > 1}
    assert rows_of(spark, "hamming_pairs_documents", folder) == Counter(pairs.items())


def test_sketch_queries_read_every_document(spark, texts):
    folder, ks = texts
    least = {d: w for d, v in ks.items() if (w := least_of_windows(v))}
    assert rows_of(spark, "minimizers_documents", folder) == Counter((d, len(w), len(set(w)), reduce(xor, w)) for d, w in least.items())
    keys = {(picked(x, C.PPOS), picked(x, C.PARAMS.npos)) for w in least.values() for x in w}
    odd = {(b // 2, e) for b, e in keys if b % 2}
    for name, kept in (("sketch_distinct", keys), ("partition_filter", odd)):
        assert rows_of(spark, f"{name}_documents", folder) == Counter([(len(kept), len({b for b, _ in kept}), reduce(xor, (e for _, e in kept)), reduce(xor, (b for b, _ in kept)))])
    sizes, want, end = Counter(b for b, _ in keys), [], 0
    for b in sorted(sizes):
        end += sizes[b]
        want.append((b, sizes[b], end))
    assert rows_of(spark, "bucket_offsets_documents", folder) == Counter(want)
    registers = defaultdict(int)
    for x in {x for v in ks.values() for x in v}:
        y = mixed(x) & 0xFFFFFFFF
        left = y << 12 & 0xFFFFFFFF
        registers[y >> 20] = max(registers[y >> 20], min(20, 32 - left.bit_length()) + 1)
    assert rows_of(spark, "hll_registers_documents", folder) == Counter(registers.items())
    exact = len({x for v in ks.values() for x in v})
    assert abs(C.QUERIES["hll_estimate"](spark, folder).first()[0] / exact - 1) < 0.1


def test_mapping_queries_take_even_documents_against_the_rest(spark, texts):
    folder, ks = texts
    buckets = defaultdict(set)
    for d, v in ks.items():
        if d is not None and d % 2 == 0:
            for x in least_of_windows(v):
                buckets[picked(x, C.PPOS)].add(x)
    hits = []
    for d, v in ks.items():
        if d is None or d % 2:
            for pos, bp in enumerate(v):
                for is_rc, x in enumerate((bp, turned(bp))):
                    near = buckets.get(picked(x, C.PPOS))
                    hits.append((d, pos, is_rc, min(apart(x, y) for y in near) if near else None))
    assert {h for *_, h in hits} > {None, 0, 1}
    n, at = Counter((r, h) for _, _, r, h in hits), Counter()
    for _, pos, r, h in hits:
        at[r, h] += pos
    assert rows_of(spark, "lsh_min_hamming_documents", folder) == Counter((*k, n[k], at[k]) for k in n)

    def histogram(key):
        out = defaultdict(lambda: [0] * 6)
        for h in hits:
            out[key(*h)][h[3] if h[3] is not None and h[3] <= 4 else 5] += 1
        return Counter((*k, *v) for k, v in out.items())

    assert rows_of(spark, "bin_histogram_documents", folder) == histogram(lambda d, pos, r, _: (d, r, pos >> 6))
    assert rows_of(spark, "strand_totals_documents", folder) == histogram(lambda d, _, r, __: (d, r))
    assert rows_of(spark, "sketch_totals_documents", folder) == histogram(lambda _, __, r, ___: (r,))


def test_mapping_to_rows_takes_even_documents_against_the_rest(spark, texts):
    folder, ks = texts
    far = {r["QUERY_ID"]: r["d"] for r in C.QUERIES["mle_distance"](spark, folder).where("IS_RC = 0").collect()}
    long_enough = {d for d, v in ks.items() if (d is None or d % 2) and len(v) > 8}
    assert set(far) == long_enough and all(far[9] < far[d] for d in long_enough - {9})  # 9 is a near copy of 4
    for name in ("full_map", "full_map_eight", "full_map_enum"):
        rows = C.QUERIES[name](spark, folder).collect()
        assert 15 in {r["QUERY_ID"] for r in rows} <= long_enough, name
        assert all(r["SEQ_LEN"] == len(ks[r["QUERY_ID"]]) + K - 1 for r in rows)
