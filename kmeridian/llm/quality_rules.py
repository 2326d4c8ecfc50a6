"""Quality rules with risk-controlled thresholds.

Each rule rejects a document whose ratio (see RULES) lies above a cutoff. Cutoffs are selected per stratum (lang) on
labelled holdouts: the distinct texts with quality 1. For every stratum and rule the cutoffs are tested in a fixed sequence
from lax to strict; a test rejects "the rule drops RULE_RISK or more of this stratum's good documents that pass the base
rule" by the exact binomial tail, and a sequence ends at its first cutoff that fails, so that no correction is due within
it. Sequences share delta: each begins with delta / sequences, and one that is certified to its end hands its share to the
others (Holm's step-down). The base rule is a sequence of one test, against BASE_RISK. So with probability 1 - delta at
least, no stratum loses RULE_RISK of its good documents to a rule, or, where the base rule is certified, more than
RISK = BASE_RISK + 4 * RULE_RISK in all; good documents are taken as independent draws once copies are counted once.

Among its certified cutoffs a rule takes the one with the most gain (share of labelled bad documents rejected, minus
GOOD_WEIGHS times the share of good ones; the laxer among equals); a rule that gains nothing stays off, and so does one
without certified cutoffs: with delta = 0.05 and four strata a stratum needs about 300 good texts before any can be certified.
Counts are over all labelled rows; the grid of cutoffs is fixed.

Defined results: a null or empty text has all counts 0 and fails the base rule (fewer than MIN_WORDS words); a null
lang is a stratum of its own; null doc_ids and labels take no part in the fit; a text with conflicting labels is good;
repeated rows are judged alike and counted once; texts of any length are read whole; without labelled rows, or on an empty
table, no cutoff is certified and the base rule alone decides. Columns that other rows bring along keep their values,
whatever their names (`rejecting`).
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmeridian.llm.bpe import sole
from kmeridian.llm.text import ASCII_SPACE, words
from kmeridian.session import saved, ship

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
BASE_RISK, RULE_RISK, DELTA = 0.10, 0.02, 0.05
GOOD_WEIGHS = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Rule: numerator, denominator, cutoffs from strict to lax.
RULES = {
    "symbols": ("n_symbols", "n_words", (0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0)),
    "dup_lines": ("n_dup_lines", "n_lines", (0.05, 0.1, 0.2, 0.3, 0.5)),
    "repeats": ("n_repeat_words", "n_words", (0.1, 0.2, 0.3, 0.4)),
    "word_chars": ("word_chars", "n_words", (7.0, 8.0, 9.0, 10.0, 12.0, 15.0)),
}
RISK = BASE_RISK + RULE_RISK * len(RULES)
#: By rule: (stratum, cutoff) of those that apply.
Cutoffs = dict[str, list[tuple[str | None, float]]]


def repeat_words(found: list[bytes], most: int = 100_000) -> int:
    """Words inside 3-word windows that occur twice or more; texts of over `most` windows are counted in flat arrays."""
    n = len(found) - 2
    if n < 2:
        return 0
    if n > most:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in found), np.int64, len(found))
        pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
        window = pair[:-1] * len(number) + ids[2:]
        inverse, counts = np.unique(window, return_inverse=True, return_counts=True)[1:]
        again = counts[inverse] > 1
        inside = np.zeros(len(found), bool)
        for k in range(3):
            inside[k : k + n] |= again
        return int(inside.sum())
    windows = list(zip(found, found[1:], found[2:], strict=False))
    times = Counter(windows)
    if len(times) == n:
        return 0
    total, covered = 0, 0  # covered: words before this index are counted or passed
    for i, w in enumerate(windows):
        if times[w] > 1:
            total += i + 3 - max(i, covered)
            covered = i + 3
    return total


def counts(text: str | None) -> tuple[int, ...]:
    found = words(text)
    if not found:
        return (0,) * len(COUNTS)
    lines = [x for x in text.split("\n") if x.strip(ASCII_SPACE)]
    return (len(found), len(text) - sum(map(text.count, ASCII_SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(found), len(lines))


def _counted(spark, text: Column) -> Column:
    ship(spark)

    @F.pandas_udf("struct<" + ",".join(f"{c}:long" for c in COUNTS) + ">")
    def of(texts: pd.Series) -> pd.DataFrame:
        sole("rules")
        return pd.DataFrame([counts(t) for t in texts], columns=list(COUNTS))

    return of.asNondeterministic()(text)  # else filters would count again


def base_failed(c: str = "_c") -> Column:
    return (F.col(f"{c}.n_words") < MIN_WORDS) | (100 * F.col(f"{c}.n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{c}.n_words"))


def measured(docs: DataFrame, id_col: str = "doc_id", stratum: str = "lang", text: str = "text") -> DataFrame:
    """The narrow table that fit and judged work on, by one pass over the texts: doc_id, lang, a hash of the text, counts
    as struct `_c`, and base_failed."""
    t = F.col(f"`{text}`")
    kept = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{stratum}`").alias("lang"), F.xxhash64(t).alias("_text"), _counted(docs.sparkSession, t).alias("_c"))
    return kept.withColumn("base_failed", base_failed())


def _ratio(rule: str, c: str = "_c") -> Column:
    top, below, _ = RULES[rule]
    return F.col(f"{c}.{top}") / F.greatest(F.col(f"{c}.{below}"), F.lit(1))


def binomial_below(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p), from exact terms."""
    if k >= n:
        return 1.0
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    return min(1.0, math.fsum(math.exp(log(i)) for i in range(k + 1)))


def certified(sequences: dict[object, list[float]], delta: float = DELTA) -> dict[object, int]:
    """How many tests of each sequence of p-values, taken in order until one fails, are passed. Sequences share delta
    evenly; one passed to its end leaves its share to the rest."""
    passed = dict.fromkeys(sequences, 0)
    while True:
        ended = {s for s in sequences if passed[s] == len(sequences[s])}
        level = delta / max(1, len(sequences) - len(ended))
        before = dict(passed)
        for s, ps in sequences.items():
            while passed[s] < len(ps) and ps[passed[s]] <= level:
                passed[s] += 1
        if passed == before:
            return passed


def fit(counted: DataFrame, labels: DataFrame, base_risk: float = BASE_RISK, rule_risk: float = RULE_RISK, delta: float = DELTA) -> Cutoffs:
    """Cutoffs by rule, of a measured table. Labelled rows are joined by id and counted once for each distinct text of a
    stratum; a row of counts per stratum comes back to the driver."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("_good"))
    held = counted.join(marked, "doc_id").groupBy("lang", "_text").agg(F.max("_good").alias("good"), F.any_value("_c").alias("_c"), F.any_value("base_failed").alias("base_failed"))
    good, bad = F.col("good") == 1, F.col("good") != 1
    cells = [(rule, cut) for rule, (_, _, cuts) in RULES.items() for cut in cuts]
    over = [~F.col("base_failed") & (_ratio(rule) > cut) for rule, cut in cells]
    found = held.groupBy("lang").agg(
        F.count_if(good).alias("n_good"), F.count_if(bad).alias("n_bad"), F.count_if(good & F.col("base_failed")).alias("k_base"),
        *(F.count_if(good & x).alias(f"k{i}") for i, x in enumerate(over)), *(F.count_if(bad & x).alias(f"b{i}") for i, x in enumerate(over)),
    ).collect()
    sequences: dict[tuple, list[float]] = {}
    for row in found:
        sequences[row["lang"], "base"] = [binomial_below(row["k_base"], row["n_good"], base_risk)]
        for rule, (_, _, cuts) in RULES.items():
            sequences[row["lang"], rule] = [binomial_below(row[f"k{cells.index((rule, cut))}"], row["n_good"], rule_risk) for cut in reversed(cuts)]
    passed = certified(sequences, delta)
    chosen: Cutoffs = {rule: [] for rule in RULES}
    for row in sorted(found, key=lambda r: str(r["lang"])):
        for rule, (_, _, cuts) in RULES.items():
            allowed = cuts[len(cuts) - passed[row["lang"], rule] :][::-1]  # from lax to strict: max() takes the laxest among equals
            gain = lambda cut, r=row, rule=rule: r[f"b{cells.index((rule, cut))}"] / max(1, r["n_bad"]) - GOOD_WEIGHS * r[f"k{cells.index((rule, cut))}"] / max(1, r["n_good"])
            if allowed and gain(best := max(allowed, key=gain)) > 0:
                chosen[rule].append((row["lang"], best))
    return chosen


def kept(cutoffs: Cutoffs, stratum: Column, c: str = "_c") -> Column:
    """The verdict on a counted row."""
    verdict = ~base_failed(c)
    for rule, by in cutoffs.items():
        for s, cut in by:
            verdict &= ~(stratum.eqNullSafe(F.lit(s)) & (_ratio(rule, c) > cut))
    return verdict


def judged(counted: DataFrame, cutoffs: Cutoffs) -> DataFrame:
    return counted.withColumn("kept", kept(cutoffs, F.col("lang")))


def rejecting(docs: DataFrame, labels: DataFrame, stratum: str = "lang", text: str = "text") -> DataFrame:
    """The rows of docs that the base rule and the certified cutoffs keep, as they are."""
    cutoffs = fit(saved(measured(docs, stratum=stratum, text=text)), labels)
    whole = docs.select(F.struct("*").alias("row"), _counted(docs.sparkSession, F.col(f"`{text}`")).alias("_c"))
    return whole.where(kept(cutoffs, F.col(f"row.`{stratum}`"))).select("row.*")
