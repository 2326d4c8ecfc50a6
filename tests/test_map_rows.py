"""Whole rows of map against a plain implementation that shares nothing with the engine but the hash positions."""

import functools
import math

import numpy as np
import pytest
from numpy.polynomial import Polynomial

from kmeridian.plans import mapping as M
from kmeridian.plans import sketching as S

K, H, W = 19, 5, 22
PPOS = (17, 12, 9, 4, 1)
MASK64 = (1 << 64) - 1


def code(s):
    return sum("ACGT".index(c) << 2 * (len(s) - 1 - i) for i, c in enumerate(s))


def mixed(x):
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ x >> 33) * m & MASK64
    return x ^ x >> 33


def turned(s):
    return s[::-1].translate(str.maketrans("ACGTN", "TGCAN"))


class Plain:
    """One sketch, mapped with explicit loops."""

    def __init__(self, reference, m=1, r=0):
        self.m, self.r = m, r
        ks = [reference[i : i + K] for i in range(len(reference) - K + 1)]
        span = W - K + 1
        least = [min(ks[i : i + span], key=lambda s: mixed(code(s))) for i in range(len(ks) - span + 1)]
        self.rho = len(set(least)) / len(set(ks)) * (r + 1) / m
        self.buckets = {}
        for s in set(least):
            if self.bucket(s) % m <= r:
                self.buckets.setdefault(self.bucket(s), set()).add(s)

    @staticmethod
    def bucket(s):
        return sum("ACGT".index(s[K - 1 - p]) << 2 * i for i, p in enumerate(sorted(PPOS)))

    @functools.cache
    def distance(self, s):
        """None outside the partition, 99 for an empty bucket."""
        if "N" in s or self.bucket(s) % self.m > self.r:
            return None
        near = self.buckets.get(self.bucket(s), ())
        return min((sum(a != b for a, b in zip(s, x, strict=True)) for x in near), default=99)

    @functools.cache
    def miss(self):
        weight = [math.comb(K, d) - (math.comb(K - H, d) if d <= 4 else 0) for d in range(K + 1)]
        x = Polynomial([0, 1])
        return sum((w * x**d * (1 - x) ** (K - d) for d, w in enumerate(weight)), Polynomial([0]))

    def likelihood(self, v, u, d):
        p = self.miss()(d)
        return sum(n * (K * np.log(1 - d) + i * np.log(d / (1 - d))) for i, n in enumerate(v)) + u * np.log(self.rho * p + 1 - self.rho)

    def mle(self, v, u):
        grid = np.linspace(1e-6, 0.99, 4000)
        i = int(np.argmax(self.likelihood(v, u, grid)))
        lo, hi = grid[max(0, i - 1)], grid[min(len(grid) - 1, i + 1)]
        for _ in range(80):
            a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
            lo, hi = (a, hi) if self.likelihood(v, u, a) < self.likelihood(v, u, b) else (lo, b)
        return (lo + hi) / 2

    def parts(self, t):
        """(score, curvature) of a hit at each distance, a miss last."""
        p, p1, p2 = (q(t) for q in (self.miss(), self.miss().deriv(), self.miss().deriv(2)))
        base = 1 - self.rho + self.rho * p
        score = [-K / (1 - t) + d / (t * (1 - t)) for d in range(5)] + [self.rho * p1 / base]
        curve = [-K / (1 - t) ** 2 + d * (2 * t - 1) / (t * (1 - t)) ** 2 for d in range(5)] + [self.rho * p2 / base - (self.rho * p1 / base) ** 2]
        return score, curve


def falls(c, tau, lo, hi):
    n = len(c) - 1
    if hi >= lo + tau and c[hi] < c[lo]:
        return [(lo, hi)]
    out, used = [], set()
    for a in range(lo, hi + 1):
        top = max(c[1:a], default=-math.inf)
        if c[a] > top:
            b = max((i for i in range(1, n + 1) if min(c[i:]) < c[a]), default=0)
            b = max(lo, min(hi, b))
            if b >= a + tau and top <= c[b] < c[a] and b not in used:
                used.add(b)
                out.append((a, b))
    return out


def joined(found, c, s, chisq):
    out = []
    for a, b in found:
        if out and a < out[-1][1] and ((c[b] - c[out[-1][0]]) ** 2 + 1e-7) / (s[out[-1][0]] - s[b] + 1e-7) < chisq:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def plain_map(plain, queries, p):
    rows, genome = [], [[0] * 5, 0.0]
    size = 1 << p.bin_shift
    for query, seq in queries:
        nmers = len(seq) - K + 1
        nbins = -(-nmers // size)
        if nmers < 1 or nbins < 2:
            continue
        tau = min(-(-p.min_length // size), nbins) - 1
        strands = []
        for rc in (False, True):
            hist = [[0] * 6 for _ in range(nbins)]
            for j in range(nmers):
                s = seq[j : j + K]
                hd = plain.distance(turned(s) if rc else s)
                if hd is not None:
                    hist[j // size][min(hd, 5)] += 1
            v = [sum(h[i] for h in hist) for i in range(5)]
            bare = p.enum_only and not p.sample_size
            u = sum(h[5] for h in hist) if bare else nmers - sum(v)
            strands.append((hist, v, u, plain.mle(v, u)))
        diff = strands[0][3] - strands[1][3]
        closer = int(diff > 0)
        for rc, (hist, v, u, dq) in enumerate(strands):
            walks, spreads = [], []
            for t in p.thresholds:
                score, curve = plain.parts(t)
                c, s = [0.0], [0.0]
                for h in hist:
                    c.append(c[-1] + sum(a * b for a, b in zip(h, score, strict=True)))
                    s.append(s[-1] + sum(a * b for a, b in zip(h, curve, strict=True)))
                walks.append([-x for x in c] if t > dq else c)
                spreads.append(s)
            found = []
            if p.enum_only:
                for t in range(len(p.thresholds)):
                    found += [(a, b + 1, t) for a, b in joined(falls(walks[t], tau, 1, nbins), walks[t], spreads[t], p.chisq)]
            else:
                for t in sorted(range(len(p.thresholds)), key=lambda i: p.thresholds[i] if p.thresholds[i] <= dq else 2 - p.thresholds[i]):
                    at, new = 1, []
                    for a, b, _ in [*found, (nbins + 1, nbins + 1, None)]:
                        if a >= at + tau + 1:
                            new += falls(walks[t], tau, at, a - 1)
                        at = max(at, b)
                    found += [(a, b + 1, t) for a, b in joined(new, walks[t], spreads[t], p.chisq)]
                found = found or [(1, nbins + 1, None)]
            for emit, (a, b, t) in enumerate(found):
                own = [sum(h[i] for h in hist[a - 1 : b - 1]) for i in range(5)]
                d = math.nan if bare else plain.mle(own, min((b - 1) * size, nmers) - min((a - 1) * size, nmers) - sum(own))
                th = sorted(p.thresholds)
                if t is None:
                    lo, hi = max((x for x in th if x < d), default=1e-5), min((x for x in th if x >= d), default=1)
                elif p.thresholds[t] <= dq:
                    lo, hi = max((x for x in th if x < p.thresholds[t]), default=1e-5), p.thresholds[t]
                else:
                    lo, hi = p.thresholds[t], min((x for x in th if x > p.thresholds[t]), default=1)
                end = len(seq) if b == nbins + 1 else min((b - 1) * size + 1, nmers + 1)
                sign = "." if bare else "+" if bool(rc) == (diff > 0) else "-"
                rows.append((query, rc, emit, len(seq), (a - 1) * size + 1, end, sign, 0 if t is None else 1 << t, f"({lo:.5g}, {hi:.5g})", d, math.nan if bare else dq, math.nan if bare else diff))
        if not bare:
            genome[0] = [x + y for x, y in zip(genome[0], strands[closer][1], strict=True)]
            genome[1] += strands[closer][2]
    return rows, plain.mle(*genome) if not bare else math.nan


def cases():
    rng = np.random.default_rng(11)
    ref = rng.choice(list("ACGT"), 700)
    mutated = lambda part, d: "".join(c if x >= d else rng.choice(list("ACGT")) for c, x in zip(part, rng.random(len(part)), strict=True))
    near = mutated(ref[:300], 0.01) + mutated(ref[300:500], 0.3) + mutated(ref[500:], 0.03)
    queries = [("near", near), ("rc", turned(mutated(ref[100:420], 0.05))), ("noise", "".join(rng.choice(list("ACGT"), 260))), ("breaks", near[:150] + "NN" + near[152:330]), ("short", "ACGTAC"), ("one_bin", "".join(ref[: K + 2]))]
    return "".join(ref), queries


@pytest.mark.parametrize(
    ("params", "m", "r"),
    [
        (M.MapParams(thresholds=(0.05,), min_length=40, bin_shift=2, sample_size=0), 1, 0),
        (M.MapParams(thresholds=(0.02, 0.3, 0.05, 0.08, 0.12, 0.16, 0.2, 0.25), min_length=48, bin_shift=3, sample_size=0, chisq=3.0), 1, 0),
        (M.MapParams(thresholds=(0.1,), min_length=30, bin_shift=0, enum_only=True, sample_size=0), 3, 1),
        (M.MapParams(thresholds=(0.02, 0.3, 0.05, 0.08, 0.12, 0.16, 0.2, 0.25), min_length=48, bin_shift=3, enum_only=True, sample_size=0), 1, 0),
    ],
)
def test_rows_equal_a_plain_implementation(spark, params, m, r):
    ref, queries = cases()
    sketch = S.build(spark.createDataFrame([("r", ref)], "query_id string, seq string"), "ref", S.SketchParams(k=K, w=W, h=H, m=m, r=r, ppos=PPOS), created_ts=0, distinct="exact")
    df = spark.createDataFrame(queries, "query_id string, seq string")
    want, genome = plain_map(Plain(ref, m, r), queries, params)
    assert want
    for kernel_rows in (M.KERNEL_ROWS, 0):  # both ways to search
        out = M.map_queries(df, sketch, params, kernel_rows).collect()
        got = {(x["QUERY_ID"], x["IS_RC"], x["emit"]): x for x in out}
        assert set(got) == {w[:3] for w in want}
        for w in want:
            x = got[w[:3]]
            assert (x["SEQ_LEN"], x["INTERVAL_START"], x["INTERVAL_END"], x["STRAND"], x["MASK"], x["D_INTERVAL"]) == w[3:9], w
            for c, v in zip(("DIST", "DIST_CONTIG"), w[9:11], strict=True):  # without hits the likelihood is flat far out
                assert (math.isnan(x[c]) and math.isnan(v)) or abs(x[c] - v) < 2e-4 or min(x[c], v) > 0.8, (c, w)
            assert (math.isnan(x["STRAND_DIFF"]) and math.isnan(w[11])) or abs(x["STRAND_DIFF"] - w[11]) < (2e-4 if abs(w[11]) < 0.6 else 0.2)
            assert (math.isnan(x["DIST_GENOME"]) and math.isnan(genome)) or abs(x["DIST_GENOME"] - genome) < 2e-4
            assert math.isnan(x["PERCENTILE"]) and math.isnan(x["QVALUE"]) and x["REF_ID"] == "ref"


def test_nulls_are_drawn_for_each_record_and_rerun_alike(spark):
    ref, queries = cases()
    sketch = S.build(spark.createDataFrame([("r", ref)], "query_id string, seq string"), "ref", S.SketchParams(k=K, w=W, h=H, m=1, r=0, ppos=PPOS), created_ts=0, distinct="exact")
    p = M.MapParams(thresholds=(0.05,), min_length=40, bin_shift=2, sample_size=12)
    a, notes = M.map_and_notes(spark.createDataFrame(queries, "query_id string, seq string"), sketch, p)
    b = M.map_queries(spark.createDataFrame(queries[::-1], "query_id string, seq string").repartition(5), sketch, p, kernel_rows=0)
    rows = sorted(map(tuple, a.select(*M.COLUMNS, "emit").collect()), key=str)
    again = sorted(map(tuple, b.select(*M.COLUMNS, "emit").collect()), key=str)
    assert len(rows) == len(again)
    for x, y in zip(rows, again, strict=True):
        assert all(u == v or (u != u and v != v) or abs(u - v) < 1e-9 for u, v in zip(x, y, strict=True))
    tested = [r for r in a.collect() if not math.isnan(r["PERCENTILE"])]
    assert tested and all(0 <= r["PERCENTILE"] <= 1 and r["QVALUE"] >= min(1, r["PERCENTILE"]) - 1e-12 and r["FOLD"] > 0 for r in tested)
    codes = {r["code"] for r in notes.collect()}
    assert {"short_query", "few_bins"} <= codes <= {"short_query", "few_bins", "min_length_above_query", "few_nulls", "fit_failed"}
    few, notes = M.map_and_notes(spark.createDataFrame(queries[:1], "query_id string, seq string"), sketch, M.MapParams(thresholds=(0.05,), min_length=400, bin_shift=2, sample_size=5))
    assert all(math.isnan(r["PERCENTILE"]) for r in few.collect()) and "few_nulls" in {r["code"] for r in notes.collect()}


def test_canonical_mapping_uses_one_strand(spark):
    ref, queries = cases()
    p = S.SketchParams(k=K, w=K, h=H, m=1, r=0, ppos=PPOS, canonical=True)
    sketch = S.build(spark.createDataFrame([("r", ref)], "query_id string, seq string"), "ref", p, created_ts=0, distinct="exact")
    whole = spark.createDataFrame([("fw", ref), ("rc", turned(ref))], "query_id string, seq string")
    for kernel_rows in (M.KERNEL_ROWS, 0):
        hits = M.least_distances(whole, *sketch, kernel_rows, canonical=True).collect()
        assert {r["is_rc"] for r in hits} == {0} and all(r["hd"] == 0 for r in hits) and len(hits) == 2 * (len(ref) - K + 1)
