"""Byte-pair merging shared by the tokenizer operators."""

from __future__ import annotations

import ctypes
import gc
import heapq
from collections.abc import Callable
from itertools import repeat
from operator import add

import pyarrow as pa
import regex

#: Unicode White_Space, spelled out because the regex module's \s also takes U+001C to U+001F.
_SPACE = r"\t-\r\x20\x85\xa0  -     　"


def splitter(pattern: str) -> regex.Pattern:
    """Compiles a pre-token pattern with White_Space semantics for \\s and \\S."""
    return regex.compile(pattern.replace(r"[^\s", rf"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]"))


NO_RANK = 1 << 60


def merge(piece: bytes, ranks: dict, of_pairs: bool) -> list[bytes]:
    """Joins adjacent parts of piece, lowest rank first and leftmost among equals, until none can be joined.

    ranks: by pairs of parts if of_pairs, else by the joined bytes. Short pieces keep the ranks of their pairs in a
    list; longer ones a heap over a linked list: n log n steps."""
    n = len(piece)
    parts = [piece[i : i + 1] for i in range(n)]
    return _merge_short(parts, ranks.get, of_pairs) if n <= 32 else _merge_long(parts, ranks.get, of_pairs)


def _merge_short(parts: list[bytes], get: Callable, of_pairs: bool) -> list[bytes]:
    pairs = zip(parts, parts[1:], strict=False) if of_pairs else map(add, parts, parts[1:])
    ranks = list(map(get, pairs, repeat(NO_RANK)))
    while ranks and (least := min(ranks)) < NO_RANK:
        i = ranks.index(least)
        here = parts[i] = parts[i] + parts.pop(i + 1)
        del ranks[i]
        if i < len(ranks):
            ranks[i] = get((here, parts[i + 1]) if of_pairs else here + parts[i + 1], NO_RANK)
        if i:
            ranks[i - 1] = get((parts[i - 1], here) if of_pairs else parts[i - 1] + here, NO_RANK)
    return parts


def _merge_long(start: list[bytes], get: Callable, of_pairs: bool) -> list[bytes]:
    parts: list[bytes | None] = list(start)
    n = len(parts)
    rank = (lambda a, b: get((a, b))) if of_pairs else (lambda a, b: get(a + b))
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank(parts[i], parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i] if parts[i] == left else n
        if j >= n or parts[j] != right:
            continue
        parts[i], parts[j] = left + right, None
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (r := rank(parts[a], parts[b])) is not None:
                heapq.heappush(heap, (r, a, parts[a], parts[b]))
    return [p for p in parts if p is not None]


class Memo(dict):
    """A dict that computes missing values and forgets everything when it holds `most` short keys."""

    def __init__(self, make: Callable, most: int = 400_000, longest: int = 48, always: dict | None = None):
        super().__init__(always or {})
        self.make, self.most, self.longest, self.always = make, most + len(self), longest, always or {}

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
                self.update(self.always)
            self[key] = value
        return value


_in_use: dict = {"by": "", "drop": dict}


def trim() -> None:
    """Gives memory that nothing uses back to the system; Arrow takes its own from there, so that it can be given back."""
    pa.set_memory_pool(pa.system_memory_pool())
    gc.collect()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give(0)


def sole(user: str, drop: Callable = dict) -> None:
    """Frees what another operator memoised in this Python worker, which Spark uses again for later stages; drop frees
    what user will hold. Called at the beginning of a batch; memos of one operator stay from batch to batch."""
    if _in_use["by"] != user:
        _in_use["drop"]()
        _in_use.update(by=user, drop=drop)
        trim()


class Chunks:
    """Values of whole texts from values of their chunks between single spaces.

    No pre-token holds a space but as its first character or within a run of white space. So where a space has other
    characters on both sides, pre-tokens of the chunk before it and of the chunk after it, space included, are those of
    the text. Chunks recur, so theirs are memoised; a text with any other space in it is split as a whole."""

    def __init__(self, split: Callable[[str], list[str]], of_pieces: Callable[[list[str]], object], total: Callable, most: int = 400_000):
        self.split, self.of_pieces, self.total = split, of_pieces, total
        self.first, self.spaced = Memo(lambda c: self._value(c, ""), most=min(most, 50_000)), Memo(lambda c: self._value(c, " "), most=most)

    def _value(self, chunk: str, space: str):
        return None if not chunk or chunk[0].isspace() or chunk[-1].isspace() else self.of_pieces(self.split(space + chunk))

    def __call__(self, text: str):
        head, *rest = text.split(" ")
        try:
            return self.total([self.first[head], *map(self.spaced.__getitem__, rest)])
        except TypeError:  # a None: a space beside white space
            return self.of_pieces(self.split(text))
