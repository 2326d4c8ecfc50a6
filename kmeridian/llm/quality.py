"""Quality: Bradley-Terry pairwise ranking.

A document's strength is linear in features of its style: for each of the measures in MEASURES, which of 14 bins it falls
in; their 13 edges are exact quantiles of all labelled rows, from 2 % to 98 % in equal steps. Preference pairs are (label 1, label 0) documents; the logistic loss of the
difference of their features is minimised. A quantile of all their strengths, at the share of label 0, is the
threshold: it is mapped to score 0.3, the contract's cutoff.

The fit reads every labelled row outside the fold, and each stands in at least one pair; label-0 rows have about `pairs_each`
or more. Bins, pairs and sums are made by the executors; a matrix of 224 rows a task comes to the driver for each of a few
Newton steps. Scoring reads every text whole.

Defined results: a null or empty text has all measures 0; null doc_ids are kept and scored; null labels are not used;
conflicting labels of an id count as 1, and an id that stands on several texts is trained on one of them, the least by
its measures; if the labelled rows lack either label (an empty table does), every document scores 0.5. Repeated rows are
scored alike; texts of any length are read whole. Other columns stay as they are, but for one with the name of the score,
which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmeridian.llm.text import held_out, words
from kmeridian.operators.ranks import running_total
from kmeridian.session import saved, ship

RIDGE, UNIT = 1e-4, float(1 << 24)
CUTOFF = 0.3
MEASURES = ("log_words", "word_chars", "upper", "symbols", "marks", "digits", "distinct", "echo", "line_words", "dup_lines", "bars", "capitals", "stops", "long_words", "pair_echo", "edge_marks")
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_SYMBOL, _MARK = b"#*$%&<>@~^=_{}[]\\/", b"!?.,;:"
_STOP = {w.encode() for w in "the of and to in that is was for it with as on be at by an or are this et de la le les des en un une que dans est pour qui sur el los y del las por con para der die und in den von zu das mit sich auf ist im dem nicht ein eine".split()}


def measures(text: str | None) -> list[float]:
    found = words(text)
    if not found:
        return [0.0] * len(MEASURES)
    raw = text.encode()
    n, size = len(found), len(raw)
    count = lambda chars: size - len(raw.translate(None, chars))
    lower = text.lower()
    wide_upper = 0 if lower == text else sum(map(str.isupper, filter(lambda c: c > "\x7f", text))) if not text.isascii() else 0
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = list(zip(found, found[1:], strict=False))
    letters = max(1, sum(map(len, found)))
    return [
        np.log1p(n), letters / n, (count(_UPPER) + wide_upper) / letters, count(_SYMBOL) / n, count(_MARK) / n, count(_DIGIT) / n,
        len(set(found)) / n, sum(map(eq, found, found[1:])) / n, n / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)),
        count(b"|") / n, sum(w[:1].isupper() for w in found) / n, sum(w in _STOP for w in found) / n, sum(len(w) > 14 for w in found) / n,
        1 - len(set(pairs)) / max(1, len(pairs)), sum(w[-1] in _MARK or w[-1] in _SYMBOL for w in found) / n,
    ]


def _measured(docs: DataFrame, *keep: str) -> DataFrame:
    ship(docs.sparkSession)

    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([measures(t) for t in texts], dtype=object)

    return docs.select(*keep, of(F.col("text")).alias("_x"))


def _labelled(docs: DataFrame, ids: DataFrame, folds: int, fold: int) -> DataFrame:
    """ids with the measures of their texts, which are taken where the texts are: only numbers meet the labels."""
    return _measured(docs.where(~held_out(F.col("doc_id"), folds, fold)), "doc_id").join(ids, "doc_id")


def _coded(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """One column per measure and bin."""
    n, k = x.shape
    out = np.zeros((n, k * (edges.shape[1] + 1)))
    for j in range(k):
        out[np.arange(n), j * (edges.shape[1] + 1) + np.searchsorted(edges[j], x[:, j], side="right")] = 1
    return out


def _codes(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The bin of each measure, a byte each."""
    return np.column_stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]).astype(np.uint8)


def _quantiles(counts: DataFrame, n: int, q: np.ndarray) -> dict[int, np.ndarray]:
    """By j, the quantiles q of its n values: counts has j, v and count. As numpy has them, linear between neighbours."""
    at = np.asarray(q) * (n - 1)
    low = np.floor(at).astype(int)
    high = np.minimum(low + 1, n - 1)
    wanted = F.array(*(F.lit(int(r)).cast("long") for r in sorted({*low.tolist(), *high.tolist()})))
    total = running_total(counts, ["j"], ["v"], "count", "_end")
    held = total.select("j", "v", F.filter(wanted, lambda r: (r < F.col("_end")) & (r >= F.col("_end") - F.col("count"))).alias("r")).where(F.size("r") > 0)
    value: dict[int, dict[int, float]] = {}
    for row in held.collect():  # a row for each rank at most
        value.setdefault(row["j"], {}).update(dict.fromkeys(row["r"], row["v"]))
    out = {}
    for j, by_rank in value.items():
        x, y = (np.array([by_rank[r] for r in ranks.tolist()]) for ranks in (low, high))
        t = at - low
        out[j] = np.where(t >= 0.5, y - (y - x) * (1 - t), x + (y - x) * t)
    return out


def _pairs(rows: DataFrame, sizes: dict[int, int], pairs_each: int) -> DataFrame:
    """good and bad: codes of preference pairs. Every row of the more frequent label, in order of a hash, meets one of the other
    label in each round; rounds begin at places apart, and are so many that label 0 has pairs_each pairs a row on average."""
    ranked = running_total(rows.withColumns({"_o": F.xxhash64("doc_id"), "_one": F.lit(1)}), ["_y"], ["_o", "doc_id"], "_one", "_at")
    large = int(sizes[1] >= sizes[0])
    few = sizes[1 - large]
    rounds = max(1, -(-pairs_each * sizes[0] // sizes[large]))
    step = max(1, few // rounds)
    names = ("bad", "good")
    many = ranked.where(F.col("_y") == large).select(F.col("_c").alias(names[large]), F.col("_at").cast("long").alias("_at"), F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("_r"))
    other = ranked.where(F.col("_y") == 1 - large).select(F.col("_c").alias(names[1 - large]), F.col("_at").cast("long").alias("_s"))
    return many.withColumn("_s", (F.col("_at") - 1 + F.col("_r") * step) % few + 1).join(other, "_s").select("good", "bad")


def _derivatives(pairs: DataFrame, w: np.ndarray, bins: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Sums over all pairs of the logistic loss, its gradient and its curvature. Terms are whole multiples of 1 / UNIT, so that
    sums do not depend on the order of rows."""
    shape = (len(w) // bins, bins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, at = w.reshape(shape), np.arange(shape[0])
        loss, g, h = 0.0, np.zeros(len(w)), np.zeros((len(w), len(w)))
        for b in batches:
            if b.num_rows:
                good, bad = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, shape[0]) for c in ("good", "bad"))
                margin = np.clip(table[at, good].sum(axis=1) - table[at, bad].sum(axis=1), -35, 35)
                off = 1 / (1 + np.exp(margin))
                delta, i = np.zeros((len(margin), len(w))), np.arange(len(margin))[:, None]
                delta[i, at * bins + good] += 1
                delta[i, at * bins + bad] -= 1
                loss += np.rint(np.log1p(np.exp(-margin)) * UNIT).sum()
                g -= np.rint(off * UNIT) @ delta
                h += delta.T @ (delta * np.rint(off * (1 - off) * UNIT)[:, None])
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([g.tobytes()]), pa.array([h.tobytes()])], ["loss", "g", "h"])

    loss, g, h = 0.0, np.zeros(len(w)), np.zeros((len(w), len(w)))
    for r in pairs.mapInArrow(run, "loss double, g binary, h binary").toLocalIterator():  # a row a task
        loss, g, h = loss + r["loss"], g + np.frombuffer(r["g"]), h + np.frombuffer(r["h"]).reshape(h.shape)
    return loss / UNIT, g / UNIT, h / UNIT


def fit(docs: DataFrame, labels: DataFrame, folds: int, fold: int, label: str = "quality", pairs_each: int = 8, steps: int = 25) -> dict | None:
    """Edges of bins, weights and threshold, from all labelled rows outside the fold; None if they have one class only."""
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"), folds, fold)).groupBy("doc_id").agg(F.max(label).cast("int").alias("_y"))
    each = saved(_labelled(docs, ids, folds, fold).groupBy("doc_id").agg(F.min("_y").alias("_y"), F.min("_x").alias("_x")).where("_y in (0, 1)"))  # a row an id
    sizes = {r["_y"]: r["count"] for r in each.groupBy("_y").count().collect()}
    if len(sizes) < 2:
        return None
    n = sum(sizes.values())
    cuts = _quantiles(each.select(F.posexplode("_x").alias("j", "v")).groupBy("j", "v").count(), n, np.linspace(0.02, 0.98, 13))
    edges = np.array([cuts[j] for j in range(len(MEASURES))])
    bins = edges.shape[1] + 1

    @F.pandas_udf("binary")
    def code(x: pd.Series) -> pd.Series:
        return pd.Series([row.tobytes() for row in _codes(np.stack(x.to_list()), edges)] if len(x) else [], dtype=object)

    rows = saved(each.select("doc_id", "_y", code("_x").alias("_c")))
    pairs = saved(_pairs(rows, sizes, pairs_each))
    total = pairs.count()
    w, change = np.zeros(edges.shape[0] * bins), np.zeros(edges.shape[0] * bins)
    last = np.inf
    for _ in range(steps):  # Newton's steps on the mean logistic loss with a small ridge, halved where the loss grew
        loss, g, h = _derivatives(pairs, w, bins)
        loss = loss / total + RIDGE / 2 * float(w @ w)
        if loss > last + 1e-9:
            change = change / 2
            w = w + change
        else:
            last = loss
            change = np.linalg.solve(h / total + RIDGE * np.eye(len(w)), g / total + RIDGE * w)
            w = w - change
        if np.abs(change).max() < 1e-4:
            break

    @F.pandas_udf("double")
    def strength(c: pd.Series) -> pd.Series:
        at = np.frombuffer(b"".join(c), np.uint8).reshape(-1, len(edges))
        return pd.Series(w.reshape(-1, bins)[np.arange(len(edges)), at].sum(axis=1))

    strengths = rows.select(F.lit(0).alias("j"), strength("_c").alias("v")).groupBy("j", "v").count()
    return {"edges": edges, "w": w, "cut": float(_quantiles(strengths, n, np.array([sizes[0] / n]))[0][0])}


def score(docs: DataFrame, model: dict | None, into: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 for each whole text, CUTOFF at the model's quantile."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def strength(texts: pd.Series) -> pd.Series:
        m = shared.value
        if m is None or not len(texts):
            return pd.Series([0.5] * len(texts), dtype=float)
        s = _coded(np.array([measures(t) for t in texts]), m["edges"]) @ m["w"] - m["cut"] + np.log(CUTOFF / (1 - CUTOFF))
        return pd.Series(1 / (1 + np.exp(-np.clip(s, -35, 35))))

    return docs.withColumn(into, strength(F.col("text")))
