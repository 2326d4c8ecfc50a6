"""k-mer encodings as Column expressions over LONG, and their numpy twins for Arrow kernels.

A base is two bits (A 0, C 1, G 2, T 3, upper or lower case; anything else breaks the k-mer). `bp` holds a k-mer first
base first, two bits a base, in the low 2k bits; base position p counts from the right.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

BREAK = 4
CODES = np.full(256, BREAK, np.uint8)
for _i, _c in enumerate("ACGT"):
    CODES[ord(_c)] = CODES[ord(_c.lower())] = _i

EVEN = 0x5555555555555555
#: Multipliers and shift of the 64-bit mixer that orders minimizers.
MIX_SHIFT, MIX_1, MIX_2 = 33, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53


def signed(x: int) -> int:
    """A 64-bit pattern as the LONG that holds it."""
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def dna(text: Column, breaks: bool = False) -> Column:
    """A nucleotide sequence derived from any text: two bases a byte; with breaks, hex digit A becomes N."""
    return F.translate(F.hex(F.encode(text, "UTF-8")), "0123456789ABCDEF", "ACGTACGTACNTACGT" if breaks else "ACGTACGTACGTACGT")


def nt4(base: Column) -> Column:
    at = F.instr(F.lit("ACGT"), F.upper(base)) - 1
    return F.when((F.length(base) == 1) & (at >= 0), at).otherwise(BREAK)


def encode(kmer: Column, k: int) -> Column:
    """bp of a k-mer given as text; null if it has a break."""
    digits = F.translate(F.upper(kmer), "ACGT", "0123")
    return F.when(kmer.rlike(f"^[ACGTacgt]{{{k}}}$"), F.conv(digits, 4, 10).cast("long"))


def _shr(x: Column, n: int) -> Column:
    return F.shiftrightunsigned(x, n) if n else x


def reverse_complement(bp: Column, k: int) -> Column:
    x = F.bitwise_not(bp)
    for mask, n in ((0x3333333333333333, 2), (0x0F0F0F0F0F0F0F0F, 4), (0x00FF00FF00FF00FF, 8), (0x0000FFFF0000FFFF, 16)):
        m = F.lit(signed(mask))
        x = _shr(x, n).bitwiseAND(m).bitwiseOR(F.shiftleft(x.bitwiseAND(m), n))
    x = _shr(x, 32).bitwiseOR(F.shiftleft(x, 32))
    return _shr(x, 64 - 2 * k)


def even_bits(x: Column) -> Column:
    """The bits at even positions, next to each other."""
    x = x.bitwiseAND(F.lit(EVEN))
    for n, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        x = x.bitwiseOR(_shr(x, n)).bitwiseAND(F.lit(signed(mask)))
    return x


def planes(bp: Column) -> Column:
    """High bits of all bases in the upper 32 bits, low bits in the lower 32."""
    return F.shiftleft(even_bits(_shr(bp, 1)), 32).bitwiseOR(even_bits(bp))


def _gather(x: Column, positions: Sequence[int]) -> Column:
    """The base pairs of bits at positions, lowest position lowest."""
    parts = [F.shiftleft(_shr(x, 2 * p).bitwiseAND(F.lit(3)), 2 * i) for i, p in enumerate(sorted(positions))]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def extract_bits(x: Column, mask: int) -> Column:
    """The bits of x where mask has ones, lowest lowest."""
    ones = [i for i in range(64) if mask >> i & 1]
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(_shr(x, p).bitwiseAND(F.lit(1)), i) for i, p in enumerate(ones)], F.lit(0).cast("long"))


def lsh_bucket(bp: Column, ppos: Sequence[int]) -> Column:
    return _gather(bp, ppos)


def rest(bp: Column, npos: Sequence[int]) -> Column:
    """The bases outside the hashed positions, two bits each: only equality and Hamming distance use them."""
    return _gather(bp, npos)


def plane_rest(bp: Column, npos: Sequence[int]) -> Column:
    """The same bases as two 16-bit planes in 32 bits, the layout of sketch files."""
    order = sorted(npos)
    low = reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(_shr(bp, 2 * p).bitwiseAND(F.lit(1)), i) for i, p in enumerate(order)])
    high = reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(_shr(bp, 2 * p + 1).bitwiseAND(F.lit(1)), 16 + i) for i, p in enumerate(order)])
    return low.bitwiseOR(high)


def hamming(x: Column, y: Column) -> Column:
    """Differing bases of two pair-interleaved values."""
    d = x.bitwiseXOR(y)
    return F.bit_count(d.bitwiseOR(_shr(d, 1)).bitwiseAND(F.lit(EVEN)))


def hamming_planes(x: Column, y: Column, width: int = 16) -> Column:
    """Differing bases of two values in two planes of width bits."""
    d = x.bitwiseXOR(y)
    return F.bit_count(d.bitwiseOR(_shr(d, width)).bitwiseAND(F.lit((1 << width) - 1)))


def let(value: Column, body) -> Column:
    """body(value), with value computed once and not repeated in the expression tree."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _add(x: Column, y: Column) -> Column:
    """x + y modulo 2^64 in halves: plain sums overflow."""
    m = F.lit(0xFFFFFFFF)
    return let(F.struct(x.alias("x"), y.alias("y")), lambda q: let(F.struct((q["x"].bitwiseAND(m) + q["y"].bitwiseAND(m)).alias("low"), (_shr(q["x"], 32) + _shr(q["y"], 32)).alias("high")), lambda h: F.shiftleft(h["high"] + _shr(h["low"], 32), 32).bitwiseOR(h["low"].bitwiseAND(m))))


def _times(x: Column, constant: int) -> Column:
    """x * constant modulo 2^64 from products of a 32-bit and a 16-bit limb, each below 2^48."""

    def of(q: Column) -> Column:
        low, high = q.bitwiseAND(F.lit(0xFFFFFFFF)), _shr(q, 32)
        part = lambda limb, at, by: F.shiftleft(limb * F.lit(constant >> at & 0xFFFF), at + by) if at + by else limb * F.lit(constant & 0xFFFF)
        return _add(_add(part(low, 0, 0), part(low, 16, 0)), _add(_add(part(low, 32, 0), part(low, 48, 0)), _add(part(high, 0, 32), part(high, 16, 32))))

    return let(x, of)


def mix(x: Column) -> Column:
    """The 64-bit mixer as a Column."""
    shifted = lambda v: let(v, lambda q: q.bitwiseXOR(_shr(q, MIX_SHIFT)))
    return shifted(_times(shifted(_times(shifted(x), MIX_1)), MIX_2))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        for m in (MIX_1, MIX_2):
            x = (x ^ (x >> np.uint64(MIX_SHIFT))) * np.uint64(m)
    return x ^ (x >> np.uint64(MIX_SHIFT))


def letters(seq: str | None) -> np.ndarray:
    """The codes of a sequence's bases."""
    return CODES[np.frombuffer((seq or "").encode("utf-8"), np.uint8)]


def text_bases(text: str | None) -> np.ndarray:
    """The codes of dna(text), from the text itself."""
    raw = np.frombuffer((text or "").encode("utf-8"), np.uint8)
    return np.column_stack((raw >> 4 & 3, raw & 3)).ravel()


def encode_all(seq: str | None, k: int, bases=letters) -> tuple[np.ndarray, np.ndarray]:
    """(positions of k-mers without breaks, their bp)."""
    codes = bases(seq)
    n = len(codes) - k + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    bp, done, part, width = np.zeros(n, np.uint64), 0, (codes & 3).astype(np.uint64), 1
    while done < k:  # words of 1, 2, 4 ... bases, put together by the bits of k
        if k & width:
            bp, done = (bp << np.uint64(2 * width)) | part[done : done + n], done + width
        if done < k:
            part, width = (part[:-width] << np.uint64(2 * width)) | part[width:], 2 * width
    if not (codes == BREAK).any():
        return np.arange(n), bp
    broken = np.concatenate(([0], np.cumsum(codes == BREAK)))
    at = np.flatnonzero(broken[k:] == broken[:-k])
    return at, bp[at]


def reverse_complements(bp: np.ndarray, k: int) -> np.ndarray:
    x = ~bp.astype(np.uint64)
    for mask, n in ((0x3333333333333333, 2), (0x0F0F0F0F0F0F0F0F, 4), (0x00FF00FF00FF00FF, 8), (0x0000FFFF0000FFFF, 16), (0x00000000FFFFFFFF, 32)):
        m, s = np.uint64(mask), np.uint64(n)
        x = ((x >> s) & m) | ((x & m) << s)
    return x >> np.uint64(64 - 2 * k)


def gather(bp: np.ndarray, positions: Sequence[int]) -> np.ndarray:
    """The base pairs of bits at positions, lowest position lowest: the numpy twin of lsh_bucket and rest."""
    out = np.zeros(len(bp), np.uint64)
    for i, p in enumerate(sorted(positions)):
        out |= ((bp >> np.uint64(2 * p)) & np.uint64(3)) << np.uint64(2 * i)
    return out


def random_positions(k: int, h: int, seed: int = 0) -> tuple[list[int], list[int]]:
    """(h hashed positions, descending; the others, ascending)."""
    ppos = sorted(np.random.default_rng(seed).permutation(k)[:h].tolist(), reverse=True)
    return ppos, sorted(set(range(k)) - set(ppos))


def mix_kernel():
    """The mixer as an Arrow function, for tables of millions of k-mers."""
    import pandas as pd

    def run(x: pd.Series) -> pd.Series:
        return pd.Series(mixed(x.to_numpy().view(np.uint64)).view(np.int64))

    run.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "long")
