"""The binary sketch exchange format: a count, then one blob per sketch (see README for the layout)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from kmeridian.plans.sketching import META
from kmeridian.session import ship


def _to_planes(enc: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(len(enc), np.uint32)
    for i in range(width):
        out |= ((enc >> (2 * i)) & 1).astype(np.uint32) << np.uint32(i)
        out |= ((enc >> (2 * i + 1)) & 1).astype(np.uint32) << np.uint32(16 + i)
    return out


def _from_planes(enc: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(len(enc), np.int64)
    wide = enc.astype(np.int64)
    for i in range(width):
        out |= ((wide >> i) & 1) << (2 * i)
        out |= ((wide >> (16 + i)) & 1) << (2 * i + 1)
    return out


def pack(meta: dict, rix: np.ndarray, enc: np.ndarray) -> bytes:
    """One blob; rix sorted, enc sorted within a row."""
    name = meta["rid"].encode()
    ends = np.cumsum(np.bincount(rix, minlength=meta["nrows"])).astype("<u8")
    head = struct.pack("<Q", len(name)) + name + struct.pack("<QBBBII?I", meta["created_ts"], meta["k"], meta["w"], meta["h"], meta["m"], meta["r"], meta["frac"], meta["nrows"])
    head += bytes(meta["ppos"]) + bytes(meta["npos"]) + struct.pack("<dQ", meta["rho"], len(enc))
    return head + _to_planes(enc, meta["k"] - meta["h"]).astype("<u4").tobytes() + struct.pack("<I", meta["nrows"]) + ends.tobytes()


def _head(data: bytes, at: int) -> tuple[dict, int, int]:
    """(metadata of the blob at a place, where its k-mers begin, how many there are)."""
    (size,) = struct.unpack_from("<Q", data, at)
    name, at = data[at + 8 : at + 8 + size].decode(), at + 8 + size
    ts, k, w, h, m, r, frac, nrows = struct.unpack_from("<QBBBII?I", data, at)
    at += struct.calcsize("<QBBBII?I")
    ppos, npos = list(data[at : at + h]), list(data[at + h : at + k])
    rho, n = struct.unpack_from("<dQ", data, at + k)
    return dict(rid=name, created_ts=ts, k=k, w=w, h=h, m=m, r=r, frac=frac, nrows=nrows, ppos=ppos, npos=npos, rho=rho, nkmers=n), at + k + 16, n


def unpack(data: bytes) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    (count,), at = struct.unpack_from("<I", data), 4
    for _ in range(count):
        meta, at, n = _head(data, at)
        enc = np.frombuffer(data, "<u4", n, at)
        ends = np.frombuffer(data, "<u8", meta["nrows"], at + 4 * n + 4)
        at += 4 * n + 4 + 8 * meta["nrows"]
        yield meta, np.repeat(np.arange(meta["nrows"]), np.diff(ends.astype(np.int64), prepend=0)), _from_planes(enc, meta["k"] - meta["h"])


def heads(data: bytes) -> Iterator[dict]:
    """The metadata of each blob; its k-mers are passed over."""
    (count,), at = struct.unpack_from("<I", data), 4
    for _ in range(count):
        meta, at, n = _head(data, at)
        yield meta
        at += 4 * n + 4 + 8 * meta["nrows"]


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Sketch tables of a binary file; files are read by Spark, one task each."""
    return tables(spark.read.format("binaryFile").load(path).select("content"))


def tables(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sketch tables of binary files (content)."""
    ship(files.sparkSession)

    def run(batches):
        import pandas as pd

        for b in batches:
            for content in b["content"]:
                for meta, rix, enc in unpack(bytes(content)):
                    yield pd.DataFrame({"rid": meta["rid"], "rix": rix, "enc": enc})

    def head(batches):
        import pandas as pd

        for b in batches:
            rows = [meta for content in b["content"] for meta in heads(bytes(content))]
            yield pd.DataFrame(rows)

    return files.mapInPandas(head, META), files.mapInPandas(run, "rid string, rix long, enc long")


def packed(sketch: tuple[DataFrame, DataFrame]) -> bytes:
    """The file of all sketches, built on the driver, one sketch at a time: an export for tools outside Spark."""
    metas = [r.asDict() for r in sketch[0].collect()]
    out = [struct.pack("<I", len(metas))]
    for meta in metas:
        t = sketch[1].where(sketch[1].rid == meta["rid"]).select("rix", "enc").toArrow()
        rix, enc = (t.column(c).to_numpy() for c in ("rix", "enc"))
        order = np.lexsort((enc, rix))
        out.append(pack(meta, rix[order], enc[order]))
    return b"".join(out)


def write(sketch: tuple[DataFrame, DataFrame], path: str) -> None:
    with open(path, "wb") as f:
        f.write(packed(sketch))
