"""Token counts by a whole-token shortcut.

Most pre-tokens of running text are vocabulary entries. Offline, on the driver, every vocabulary string is put
through the merges once; those that come out as a single token are proven to count as one wherever they stand as a
whole pre-token. Workers look pre-tokens up among the proven strings and merge only the rest. Sums of recurring chunks
between single spaces are memoised.

Defined results: a null or empty text has no bytes and no tokens. Special strings inside a text count as one token
each, as the tokenizers library takes them by default. A text of any length is counted whole: merging takes n log n
steps. Repeated rows and null ids are counted row by row; columns other than id and text are ignored.
"""

from __future__ import annotations

import json
from functools import lru_cache

import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmeridian.llm.bpe import Chunks, Memo, merge, splitter
from kmeridian.session import ship

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512


@lru_cache(maxsize=1)
def _byte_of() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files of the byte-level kind: printable Latin-1 bytes stand
    for themselves, the others for U+0100 onwards in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def prove(path: str) -> dict:
    """Reads a tokenizer file and returns {merges, whole, special}: the vocabulary strings proven to be one token."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    raw = lambda s: bytes(map(_byte_of().__getitem__, s))
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    merges = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
    special = {t["content"] for t in spec["added_tokens"]}
    whole = []
    for token in spec["model"]["vocab"]:
        if token not in special and len(merge(b := raw(token), merges, True)) == 1:
            try:
                whole.append(b.decode())
            except UnicodeDecodeError:
                continue  # part of a character: never a whole pre-token
    return {"merges": merges, "whole": whole, "special": sorted(special, key=len, reverse=True)}


_counters: dict[str, object] = {}


class Counter:
    def __init__(self, proven: dict, pattern: str):
        merges = proven["merges"]
        self.special = regex.compile("|".join(map(regex.escape, proven["special"]))) if proven["special"] else None
        self.known = Memo(lambda p: len(merge(p.encode(), merges, True)), always=dict.fromkeys(proven["whole"], 1))
        self.plain = Chunks(splitter(pattern).findall, lambda pieces: sum(map(self.known.__getitem__, pieces)), sum)

    def __call__(self, text: str) -> int:
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self, parts))
        return self.plain(text)


def count_tokens(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """docs with n_bytes, n_tokens; path: the tokenizer file on the driver. Other columns stay as they are."""
    spark = docs.sparkSession
    ship(spark)
    proven = spark.sparkContext.broadcast(prove(path or public_tokenizers.path(VOCABULARY)))  # one vocabulary: bounded
    pattern = public_tokenizers.PATTERN

    @F.pandas_udf("struct<n_bytes:long,n_tokens:long>")
    def counts(texts: pd.Series) -> pd.DataFrame:
        if proven.value is not _counters.get("of"):
            _counters.update(of=proven.value, counter=Counter(proven.value, pattern))
        count = _counters["counter"]
        rows = [(len(t.encode()), count(t)) if t else (0, 0) for t in texts]
        return pd.DataFrame(rows, columns=["n_bytes", "n_tokens"])

    return docs.withColumn("_counted", counts(F.col(text)))


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: id, n_bytes, n_tokens and whether the count exceeds limit."""
    counted = count_tokens(docs.select(F.col(id_col), F.col(text)), path, text)
    return counted.select(F.col(id_col), "_counted.n_bytes", "_counted.n_tokens", (F.col("_counted.n_tokens") > limit).alias("over_limit"))
