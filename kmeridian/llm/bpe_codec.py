"""Byte-level BPE encoding and decoding by backtracking over longest matches.

Bytes are mapped to Latin-1 characters so that an Aho-Corasick automaton over the vocabulary runs on them. For each
pre-token the automaton gives the longest vocabulary entry at every byte. Encoding walks from the left taking longest
entries; an entry is kept only if merging it together with its left neighbour yields exactly these two tokens, else a
shorter prefix is tried, else the walk steps back. Whether two tokens may stand side by side depends on them alone and
is memoised, so the walk takes linear time and gives exactly the tokens that the merges would give.

As in the tiktoken library a pre-token that is itself a vocabulary entry is that one token. Decoding joins the bytes
of the ids. Defined results: null counts as empty text, empty text has no ids (its hash is that of no bytes); texts of
any length are encoded whole; repeated rows and null ids are handled row by row.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmeridian.llm.bpe import Chunks, Memo, merge, sole, splitter
from kmeridian.session import ship

RANKS = "byte_bpe_multi_50k.tiktoken"
MEMO = 400_000  # entries of each memo; fewer take less memory and more time


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = MEMO):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token in ranks:
            self.automaton.add_word(token.decode("latin-1"), len(token))
        self.automaton.make_automaton()
        self.beside = Memo(self._beside, most=most, longest=2)
        self.shorter = Memo(self._shorter, most=100_000, longest=1 << 20)
        self.encoded = Memo(self._encode_str, most=most)
        join = b"".join
        self.encode = Chunks(splitter(pattern).findall, lambda pieces: join(map(self.encoded.__getitem__, pieces)), join, most)

    def _merged(self, piece: bytes) -> list[bytes]:
        return merge(piece, self.ranks, False)

    def _beside(self, pair: tuple[bytes, bytes]) -> bool:
        return self._merged(pair[0] + pair[1]) == list(pair)

    def _shorter(self, token: bytes) -> bytes | None:
        """The longest vocabulary entry that is a proper prefix of token."""
        return next((token[:n] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ranks), None)

    def encode_piece(self, piece: bytes) -> list[bytes]:
        if piece in self.ranks:
            return [piece]
        n = len(piece)
        longest = [1] * n
        for end, size in self.automaton.iter(piece.decode("latin-1")):
            if size > longest[end - size + 1]:
                longest[end - size + 1] = size
        beside, shorter = self.beside, self.shorter
        out: list[bytes] = []
        open_at = bytearray(b"\x01") * (n + 1)
        at, token = 0, piece[: longest[0]]
        while at < n:
            last = out[-1] if out else None
            while token is not None and not (open_at[at + len(token)] and (last is None or beside[last, token])):
                token = shorter[token]
            if token is not None:
                out.append(token)
                at += len(token)
                token = piece[at : at + longest[at]] if at < n else None
            elif out:
                open_at[at] = 0
                token = out.pop()
                at -= len(token)
            else:
                return self._merged(piece)  # a vocabulary without single bytes can leave no way through
        return out

    def _encode_str(self, piece: str) -> bytes:
        """Ids as unsigned 32-bit integers of the machine's byte order, little-endian wherever Spark runs."""
        return array("I", map(self.ranks.__getitem__, self.encode_piece(piece.encode()))).tobytes()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))


_codecs: dict[str, object] = {}


def _codec(ranks: dict[bytes, int], pattern: str, most: int = MEMO) -> Codec:
    sole("codec", _codecs.clear)
    if _codecs.get("of") is not ranks or _codecs["most"] != most:
        _codecs.clear()  # before another is built
        _codecs.update(of=ranks, most=most, codec=Codec(ranks, pattern, most))
    return _codecs["codec"]


def _shared(docs: DataFrame, path: str | None):
    ship(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast(read_ranks(path or public_tokenizers.path(RANKS)))  # one vocabulary: bounded


def encode(docs: DataFrame, path: str | None = None, text: str = "text", into: str = "ids", memo: int = MEMO) -> DataFrame:
    """docs with the token ids of their texts in a column of arrays."""
    ranks, pattern = _shared(docs, path), public_tokenizers.PATTERN

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        codec = _codec(ranks.value, pattern, memo)
        found, ends = bytearray(), array("i", [0])
        for t in texts:  # one text at a time as a Python string
            found += codec.encode(t.as_py() or "")
            ends.append(len(found) // 4)
        return pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int32)), pa.array(np.frombuffer(found, "<i4")))

    return docs.withColumn(into, ids(F.col(text)))


def decode(docs: DataFrame, path: str | None = None, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """docs with the bytes that arrays of token ids stand for; a null array gives no bytes."""
    ranks, pattern = _shared(docs, path), public_tokenizers.PATTERN

    @F.pandas_udf("binary")
    def bytes_of(column: pd.Series) -> pd.Series:
        codec = _codec(ranks.value, pattern)
        return pd.Series([codec.decode(array("I", [] if x is None else x).tobytes()) for x in column], dtype=object)

    return docs.withColumn(into, bytes_of(F.col(ids)))


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes each text, decodes the ids and returns id, n_tokens and the hashes of both."""
    ranks, pattern = _shared(docs, path), public_tokenizers.PATTERN

    @F.pandas_udf("struct<n_tokens:long,ids_sha256:string,decoded_sha256:string>")
    def both(texts: pd.Series) -> pd.DataFrame:
        codec, rows = _codec(ranks.value, pattern), []
        for t in texts:
            ids = codec.encode(t) if t else b""
            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col), both(F.col(text)).alias("_b")).select(id_col, "_b.*")
