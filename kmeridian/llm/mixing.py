"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order (by md5 of seed, doc_id and text), repeated for EPOCHS rounds.
The virtual finish time of a document is the cumulative size of its source up to and including it, over the
source's target. All queued documents are range-sorted by finish time and taken while their running total stays
within the budget, so each source is served in proportion to its target.

Both cumulative sums are distributed: rows are range-partitioned by their order, each sorted partition sums its own
rows, and the driver adds up one total per partition (and source). What is taken of a source in one round is a prefix
of its shuffled order, so the whole decision is one last (shuffle key, doc_id) per source and round, with the number of
equal rows taken there: at most EPOCHS rows per source come back, and are applied to documents without shuffling any text.

Defined results: null text has size 0; a null source is a source of its own, sorted last; a null doc_id sorts as
empty text. Rows that repeat a doc_id stand apart by their texts; rows that repeat both are equal to the mix, and where a
round ends among them as many are taken as it has room for, numbered over 64 shares so that no task holds them all. Very
long texts count whole; documents of size 0 take 0 words; an empty table has no targets; other columns keep their values
whatever their names. Sources are collected to the driver: a row each, so sources are a category (languages, crawls, sites),
up to some hundred thousand, not a key of their own for every document.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmeridian.llm.text import WORD
from kmeridian.session import saved, ship, shuffle_width

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = "mix-1"


def source_key(source: Column) -> Column:
    """Null last, others by code point; one letter in front keeps null apart from every text."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("t"))


def shuffle_key(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5(text), F.lit(""))))


def targets(sizes: dict[str, int], weights: Sequence[int] = WEIGHTS, most: int = EPOCHS) -> dict[str, float]:
    """Shares of the total by weight; what exceeds `most` times a source's size is shared again among the others. Sources
    are filled in order of size over weight: each that is full raises the share of those after it."""
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes))}
    left, total, out = sum(sizes.values()), sum(weight.values()), {}
    order = sorted(sizes, key=lambda s: Fraction(sizes[s], weight[s]))
    for i, s in enumerate(order):
        if weight[s] * left <= most * sizes[s] * total:
            return out | {r: weight[r] * left / total for r in order[i:]}
        out[s] = float(most * sizes[s])
        left, total = left - most * sizes[s], total - weight[s]
    return out


def _running(df: DataFrame, order: list[str], value: str, group: str) -> DataFrame:
    """df, range-partitioned and sorted by order, with pid and the running sum of value by group within the partition."""
    ship(df.sparkSession)
    laid = df.repartitionByRange(shuffle_width(df.sparkSession), *order).sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: dict[object, int] = {}
        for b in batches:
            keys, values = b.column(group).to_numpy(zero_copy_only=False), b.column(value).to_numpy(zero_copy_only=False)
            carried: list[tuple[int, int, int]] = []
            run = np.cumsum(values, dtype=np.int64)
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else []
            for i, j in zip(starts, [*starts[1:], len(keys)], strict=True):
                passed = int(run[i - 1]) if i else 0
                carried.append((i, j, carry.get(keys[i], 0) - passed))
                carry = {keys[i]: int(run[j - 1]) + carried[-1][2]}
            for i, j, shift in carried:
                run[i:j] += shift
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(run, pa.int64())], [*b.schema.names, "run"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in laid.schema.fields)
    return saved(laid.mapInArrow(add, f"{fields}, run long"))


def _offsets(running: DataFrame, group: str) -> DataFrame:
    """What comes before each partition, by group. A row per partition and group with rows there."""
    last: dict[object, int] = {}
    out = []
    for r in sorted(running.groupBy("pid", group).agg(F.max("run").alias("r")).collect(), key=lambda r: r["pid"]):
        out.append((r["pid"], r[group], last.get(r[group], 0)))
        last[r[group]] = out[-1][2] + r["r"]
    kind = dict(running.dtypes)[group]
    return running.sparkSession.createDataFrame(out, f"pid int, `{group}` {kind}, before long")


def _keys(doc_id: Column, source: Column, text: Column, seed: str) -> list[Column]:
    return [source_key(source).alias("key"), shuffle_key(doc_id, text, seed).alias("h"), F.coalesce(doc_id.cast("string"), F.lit("")).alias("id")]


def queued(docs: DataFrame, seed: str = SEED, weights: Sequence[int] = WEIGHTS) -> tuple[DataFrame, DataFrame, bool]:
    """(rows without text: doc_id, key, h, id, size; key, source_size, target, and of each round the last row taken: h, id
    and how many rows equal to it; whether a round ends among equal rows)."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    rows = saved(docs.select("doc_id", *_keys(F.col("doc_id"), F.col("source"), F.col("text"), seed), size))
    sizes = {r["key"]: r["s"] for r in rows.groupBy("key").agg(F.sum("size").alias("s")).collect()}
    target = targets(sizes, weights)
    of_source = spark.createDataFrame([(k, s, target[k]) for k, s in sizes.items()], "key string, source_size long, target double")
    budget = sum(sizes.values())

    by_source = _running(rows.drop("doc_id"), ["key", "h", "id"], "size", "key")
    queue = by_source.join(_offsets(by_source, "key"), ["pid", "key"]).join(of_source, "key").where("target > 0")
    queue = queue.select("key", "h", "id", "size", "target", "source_size", F.explode(F.sequence(F.lit(0), F.lit(EPOCHS - 1))).alias("epoch"), (F.col("before") + F.col("run")).alias("served"))
    queue = queue.select("key", "h", "id", "size", "epoch", ((F.col("epoch") * F.col("source_size") + F.col("served")).cast("double") / F.col("target")).alias("finish"), F.lit(0).alias("all"))
    order = _running(queue, ["finish", "key", "h", "id"], "size", "all")
    served = order.join(_offsets(order, "all"), ["pid", "all"]).withColumn("in", F.col("before") + F.col("run") <= budget)
    last = served.where("in").groupBy("key", "epoch").agg(F.max(F.struct("h", "id")).alias("last"))
    last = spark.createDataFrame(last.select("key", "epoch", F.col("last.h").alias("h"), F.col("last.id").alias("id")).collect(), "key string, epoch int, h string, id string")
    equal = served.join(last, ["key", "epoch", "h", "id"]).groupBy("key", "epoch", "h", "id").agg(F.count_if("in").alias("n"), F.count("*").alias("m")).collect()  # EPOCHS rows a source
    ends = {(r["key"], r["epoch"]): (r["h"], r["id"], r["n"]) for r in equal}
    flat = [(k, sizes[k], target[k], *(x for e in range(EPOCHS) for x in ends.get((k, e), (None, None, None)))) for k in sizes]
    fields = ", ".join(f"h{e} string, id{e} string, n{e} long" for e in range(EPOCHS))
    return rows, spark.createDataFrame(flat, f"key string, source_size long, target double, {fields}"), any(r["n"] < r["m"] for r in equal)


def _numbered(rows: DataFrame) -> DataFrame:
    """rows (key, h, id and others) with the number of each among those equal to it, from 0 on, by way of 64 shares."""
    spread = rows.withColumn("at", F.monotonically_increasing_id()).withColumn("share", F.pmod(F.xxhash64("at"), F.lit(64)))
    equal = ["key", "h", "id"]
    before = Window.partitionBy(*equal).orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    shares = spread.groupBy(*equal, "share").agg(F.count("*").alias("c")).withColumn("b", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c")
    own = F.row_number().over(Window.partitionBy(*equal, "share").orderBy("at")) - 1
    return spread.withColumn("own", own).join(shares, [*equal, "share"]).withColumn("number", F.col("b") + F.col("own")).drop("at", "share", "own", "b")


def _dealt(rows: DataFrame, ends: DataFrame, split: bool) -> DataFrame:
    """rows (key, h, id and others) with their source's columns of ends and `rounds`, how many rounds take them."""
    at_end = lambda e: (F.col("h") == F.col(f"h{e}")) & (F.col("id") == F.col(f"id{e}"))
    before = lambda e: (F.col("h") < F.col(f"h{e}")) | ((F.col("h") == F.col(f"h{e}")) & (F.col("id") < F.col(f"id{e}")))
    total = lambda more: sum(F.when(before(e), 1).when(at_end(e) & more(e), 1).otherwise(0) for e in range(EPOCHS)).cast("int")
    laid = rows.join(ends, "key")  # a row a source: broadcast where Spark finds it small
    if not split:
        return laid.withColumn("rounds", total(lambda e: F.lit(True)))
    last = F.lit(False)
    for e in range(EPOCHS):
        last = last | F.coalesce(at_end(e), F.lit(False))
    plain = laid.where(~last).withColumn("rounds", total(lambda e: F.lit(True)))
    return plain.unionByName(_numbered(laid.where(last)).withColumn("rounds", total(lambda e: F.col("number") < F.col(f"n{e}"))).drop("number"))


def mixed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken words."""
    return _dealt(*queued(docs, seed)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("rounds")).cast("long").alias("taken"))


def repeated(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself: docs, each as often as rounds take it."""
    _, ends, split = queued(docs, seed)
    keyed = docs.select(F.struct("*").alias("row")).select("row", *_keys(F.col("row.doc_id"), F.col("row.source"), F.col("row.text"), seed))
    return _dealt(keyed, ends, split).select("row", F.explode(F.array_repeat(F.lit(0), F.col("rounds")))).select("row.*")
