"""Operators on result tables: normalising, filtering, binning, trees, annotations, export."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmeridian.functions.text import significant
from kmeridian.operators.ranks import running_total

LOW, HIGH = 1e-5, 1 - 1e-5
#: Bounds of p-value classes, from the least to the most significant.
P_EDGES = (1.0, 0.1, 0.05, 0.01, 1e-3, 1e-4, 1e-5, 0.0)
#: What a strand's sign means in texts.
SIDES = {"+": "closer", "-": "farther", ".": "unknown"}


def _nan() -> Column:
    return F.lit(math.nan)


def _number(x: Column) -> Column:
    """x as a double, NaN where it is none."""
    return F.coalesce(x.cast("string").try_cast("double"), _nan())


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf)


def clamp_distance(x: Column) -> Column:
    d = _number(x)
    return F.when(F.isnan(d) | (d < LOW) | (d >= 1), math.nan).otherwise(d)


def format_strand_diff(x: Column) -> Column:
    """Four significant digits, which strand alone has matches, or null."""
    return F.when(F.isnan(x), None).when(x == -math.inf, "fw only").when(x == math.inf, "rc only").otherwise(significant(x, 4))


def parse_is_rc(x: Column) -> Column:
    """0 (forward) or 1 (reverse), NaN for what is neither a word for them nor a number; numbers count by their whole part."""
    t = F.lower(F.trim(x.cast("string")))
    n = t.try_cast("double")
    whole = F.when(_finite(n), F.when(F.abs(n) >= 1, 1.0).otherwise(0.0))
    return F.coalesce(F.when(t.isin("1", "true", "rc", "yes"), 1.0).when(t.isin("0", "false", "fw", "no"), 0.0), F.when(~t.isin("nan"), whole), _nan())


def is_rc_label(x: Column) -> Column:
    """Of a parsed IS_RC: fw, rc or ?."""
    return F.when(x.isNull() | F.isnan(x), "?").when(F.abs(x) >= 1, "rc").otherwise("fw")


def interval_upper(x: Column) -> Column:
    """The second of the numbers of "(a, b)", NaN for other texts."""
    second = F.trim(F.get(F.split(F.regexp_replace(x, r"^\(+|\)+$", ""), ","), F.lit(1)))
    return F.when(x.startswith("("), F.coalesce(second.try_cast("double"), _nan())).otherwise(_nan())


def normalise(df: DataFrame) -> DataFrame:
    """df with missing result columns as NaN, a STRAND of one sign (others as "."), IS_RC as a number, distances within bounds,
    and `distance`, which plots show: DIST_TH, where a table has it, else DIST, else the upper bound of D_INTERVAL."""
    have = set(df.columns)
    new = {c: _nan() for c in ("STRAND_DIFF", "QVALUE", "DIST_CONTIG", "DIST_GENOME", "FOLD") if c not in have}
    if "STRAND" in have:
        sign = F.substring(F.trim(F.coalesce(F.col("STRAND").cast("string"), F.lit("."))), 1, 1)
        new["STRAND"] = F.when(sign.isin(*SIDES), sign).otherwise(".")
    if "IS_RC" in have:
        new["IS_RC"] = parse_is_rc(F.col("IS_RC"))
    new |= {c: clamp_distance(F.col(c)) for c in ("DIST", "DIST_CONTIG", "DIST_GENOME") if c in have}
    df = df.withColumns(new)
    if "DIST_TH" in have:
        return df.withColumn("distance", _number(F.col("DIST_TH")))
    distance = F.col("DIST") if "DIST" in have else _nan()
    if "D_INTERVAL" in have:
        distance = F.when(F.isnan(distance), interval_upper(F.col("D_INTERVAL"))).otherwise(distance)
    return df.withColumn("distance", distance)


def is_enum_lite(df: DataFrame) -> bool:
    """Whether a table of DIST and MASK has neither a finite distance nor a finite p-value."""
    if not {"DIST", "MASK"} <= set(df.columns):
        return False
    columns = [c for c in ("DIST", "PERCENTILE") if c in df.columns]
    return not any(df.agg(*(F.coalesce(F.bool_or(_finite(F.col(c).try_cast("double"))), F.lit(False)) for c in columns)).first())


def plot_mode(df: DataFrame, enum_only: bool = False) -> str:
    if enum_only:
        return "legacy_enum" if "DIST_TH" in df.columns else "enum"
    if "DIST_TH" in df.columns and "PERCENTILE" not in df.columns:
        return "legacy_enum"
    if {"DIST", "MASK"} <= set(df.columns):
        return "enum" if is_enum_lite(df) else "continuous"
    raise ValueError("a result table has DIST_TH, or DIST and MASK")


def flags(df: DataFrame) -> DataFrame:
    """One row: informative strand, parsed IS_RC, finite QVALUE, any real interval, and how many."""
    sign, real = F.substring(F.trim(F.col("STRAND").cast("string")), 1, 1), F.col("INTERVAL_START") != F.col("INTERVAL_END")
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return df.agg(any_(sign.isin("+", "-")).alias("has_strand"), any_(~F.isnan(parse_is_rc(F.col("IS_RC")))).alias("has_is_rc"), any_(_finite(F.col("QVALUE"))).alias("has_qvalue"), any_(real).alias("has_interval"), F.count_if(real).alias("n_intervals"))


def retained(df: DataFrame, query: str | None = None) -> DataFrame:
    """REF_IDs that have a real interval (of a query)."""
    rows = df.where(F.col("INTERVAL_START") != F.col("INTERVAL_END"))
    return (rows if query is None else rows.where(F.col("QUERY_ID") == query)).select("REF_ID").distinct()


def distance_range(df: DataFrame) -> DataFrame:
    """lo, hi of the finite DIST, within bounds and apart."""
    r = df.where(_finite(F.col("DIST"))).agg(F.min("DIST").alias("lo"), F.max("DIST").alias("hi"))
    lo, hi = F.greatest(F.coalesce("lo", F.lit(LOW)), F.lit(LOW)), F.least(F.coalesce("hi", F.lit(0.5)), F.lit(HIGH))
    return r.select(lo.alias("lo"), F.when(hi <= lo, F.least(lo + 0.01, F.lit(HIGH))).otherwise(hi).alias("hi"))


def distances(df: DataFrame) -> DataFrame:
    return df.where(~F.isnan("distance")).select("distance").distinct()


def identifiers(df: DataFrame) -> DataFrame:
    return df.select("QUERY_ID").distinct()


def uniform_length(df: DataFrame) -> DataFrame:
    return df.agg(F.when(F.count_distinct("SEQ_LEN") == 1, F.max("SEQ_LEN")).alias("seq_len"))


def with_tip_order(df: DataFrame, tree: DataFrame) -> DataFrame:
    tips = tree.where("is_leaf").select(F.col("name").alias("REF_ID"), F.col("tip_order").alias("y"))
    return df.join(tips, "REF_ID", "left")


def filter_intervals(df: DataFrame, query: str, hi: float, lo: float | None = None, direction: str | None = None) -> DataFrame:
    """Least distance of each interval of a query (one direction: fw or rc) within bounds; rows without a tip are dropped."""
    out = df.where((F.col("QUERY_ID") == query) & F.col("y").isNotNull())
    if direction in ("fw", "rc") and "IS_RC" in df.columns:
        out = out.where(F.col("IS_RC") == (1.0 if direction == "rc" else 0.0))
    by = [c for c in ("IS_RC", "STRAND") if c in df.columns][:1]
    keys = ["REF_ID", "y", "QUERY_ID", "INTERVAL_START", "INTERVAL_END", "SEQ_LEN", *by]
    for c in by:
        out = out.where(F.col(c).isNotNull() & (~F.isnan(c) if dict(df.dtypes)[c] == "double" else F.lit(True)))
    out = out.groupBy(*keys).agg(F.min("distance").alias("distance")).where((F.col("distance") <= hi) & ~F.isnan("distance"))
    return (out if lo is None else out.where(F.col("distance") >= lo)).orderBy("y")


def filter_continuous(df: DataFrame, query: str, metric: str = "PERCENTILE", most: float | None = None, fold: str | None = None, strand: str | None = None) -> DataFrame:
    """Rows of a query by significance (at most 10 ** most, if most < 0), fold ("<1" or ">1"), and strand; what is not finite
    fails a test."""
    out = df.where((F.col("QUERY_ID") == query) & F.col("y").isNotNull())
    if most is not None and most < 0 and metric in df.columns:
        out = out.where(_finite(_number(F.col(metric))) & (_number(F.col(metric)) <= 10.0**most))
    if fold in ("<1", ">1") and "FOLD" in df.columns:
        f = _number(F.col("FOLD"))
        out = out.where(_finite(f) & (f < 1 if fold == "<1" else f > 1))
    if strand and strand != "both" and "STRAND" in df.columns:
        out = out.where(F.col("STRAND") == strand)
    return out.orderBy("y")


class Filters:
    """Filtered tables by their arguments: each is kept in Spark's cache when first asked for, the oldest beyond `most` let go."""

    def __init__(self, df: DataFrame, enum: bool, most: int = 32):
        self.df, self.run, self.most, self.held = df, filter_intervals if enum else filter_continuous, most, {}

    def __call__(self, *args, **named) -> DataFrame:
        key = (args, tuple(sorted(named.items())))
        if key not in self.held:
            if len(self.held) >= self.most:
                self.held.pop(next(iter(self.held))).unpersist()
            self.held[key] = self.run(self.df, *args, **named).cache()
        return self.held[key]


def distance_bin_index(x: Column, edges: list[float]) -> Column:
    """Index of the bin of x among rising edges, clipped to the bins there are."""
    below = sum((F.when(x > e, 1).otherwise(0) for e in edges), F.lit(0))
    return F.least(F.greatest(below - 1, F.lit(0)), F.lit(len(edges) - 2))


def p_bin(p: Column) -> Column:
    """The class of p among P_EDGES, 0 for what is above 0.1 or NaN; a bound belongs to the class above it."""
    below = sum((F.when(p < e, 1).otherwise(0) for e in P_EDGES), F.lit(0))
    return F.when(F.isnan(p), 0).otherwise(F.least(F.greatest(below - 1, F.lit(0)), F.lit(len(P_EDGES) - 2)))


def colour_bin(x: Column, lo: float, hi: float, n: int = 65) -> Column:
    """Bin 1..n-1 of x between bounds; 0 for NaN."""
    share = F.least(F.greatest((x - lo) / (hi - lo if hi > lo else 1.0), F.lit(0.0)), F.lit(1.0))
    return F.when(F.isnan(x), 0).otherwise(F.least(F.floor(share * (n - 2)) + 1, F.lit(n - 1))).cast("int")


def colour_bounds(lo: float, hi: float) -> tuple[float, float]:
    lo, hi = max(lo, LOW), min(hi, HIGH)
    return (lo, hi) if hi > lo else (lo, min(lo + 0.01, HIGH))


def colour_value(df: DataFrame, by: str) -> Column:
    """What colours a table: pval, qval (p-values where a table has none) or dist."""
    if by == "dist":
        return F.col("DIST")
    return F.col("QVALUE" if by == "qval" and "QVALUE" in df.columns else "PERCENTILE")


def traces(df: DataFrame, bin_col: str = "bin", size: int = 10_000) -> DataFrame:
    """Rows of at most `size` real intervals of a bin, as arrays of start, middle, end and y."""
    one = F.struct("y", F.col("INTERVAL_START").alias("start"), ((F.col("INTERVAL_START") + F.col("INTERVAL_END")) / 2).alias("mid"), F.col("INTERVAL_END").alias("end"))
    real = df.where("INTERVAL_START <> INTERVAL_END").select(bin_col, one.alias("one"), F.lit(1).alias("i"))
    part = F.floor((F.col("i") - 1) / size)
    rows = running_total(real.drop("i").withColumn("c", F.lit(1)), [bin_col], ["one"], "c", "i").groupBy(bin_col, part.alias("part")).agg(F.sort_array(F.collect_list("one")).alias("rows"))
    return rows.select(bin_col, "part", *(F.col(f"rows.{c}").alias(c) for c in ("start", "mid", "end", "y")))


def _shown(x: Column, how: str) -> Column:
    return F.when(_finite(x), F.format_string(how, x)).otherwise("nan")


def _scientific(x: Column, digits: int) -> Column:
    return _shown(x, f"%.{digits}e")


def hover(df: DataFrame, continuous: bool, tree_distance: str | None = None) -> Column:
    """The text shown for an interval of an enumerated or a continuous table; parts whose column is absent are left out."""
    have = lambda c: c in df.columns
    some = lambda c, value: F.when(c, value).otherwise("")
    parts: list[Column] = [F.col("REF_ID")]
    if have("STRAND"):
        side = F.when(F.col("STRAND") == "+", SIDES["+"]).when(F.col("STRAND") == "-", SIDES["-"]).when(F.col("STRAND") == ".", SIDES["."])
        parts.append(some(side.isNotNull(), F.concat(F.lit(" ("), "STRAND", F.lit(" "), side, F.lit(")"))))
    parts += [F.lit("<br>Pos: "), F.format_number("INTERVAL_START", 0), F.lit("-"), F.format_number("INTERVAL_END", 0), F.lit("<br>Dist: "), _shown(F.col("DIST" if continuous else "distance"), "%.4f")]
    if have("IS_RC"):
        parts += [F.lit("  dir: "), is_rc_label(F.col("IS_RC"))]
    if continuous:
        parts += [F.lit("  p: "), _scientific(F.col("PERCENTILE"), 3)]
        parts += [F.lit("  q: "), _scientific(F.col("QVALUE"), 3)] if have("QVALUE") else []
        parts += [F.lit("  fold: "), _shown(F.col("FOLD"), "%.3f")] if have("FOLD") else []
        other = lambda c: _shown(F.col(c if have(c) else "DIST"), "%.4f")
        parts += [F.lit("<br>Contig: "), other("DIST_CONTIG"), F.lit("  Genome: "), other("DIST_GENOME")]
        if have("STRAND_DIFF"):
            parts.append(F.coalesce(F.concat(F.lit("  d_diff: "), format_strand_diff(F.col("STRAND_DIFF"))), F.lit("")))
    elif have("MASK"):
        parts += [F.lit("  mask: "), F.col("MASK").cast("int").cast("string")]
    if have("D_INTERVAL"):
        parts += [F.lit("  D-int: "), F.col("D_INTERVAL")]
    if tree_distance:
        parts.append(F.coalesce(F.concat(F.lit("<br>Tree dist: "), F.format_string("%.4f", tree_distance)), F.lit("")))
    return F.concat(*parts)


def _nodes(tree: DataFrame) -> tuple[dict, dict]:
    """(rows by node, children by node) of a tree: trees are texts read on the driver, and go back there."""
    rows = {r["node_id"]: r for r in tree.orderBy("node_id").collect()}
    children: dict[int, list[int]] = {n: [] for n in rows}
    for n, r in rows.items():
        if r["parent_id"] is not None:
            children[r["parent_id"]].append(n)
    return rows, children


def _down(children: dict, root: int) -> list[int]:
    """Nodes from the root, parents first."""
    out = [root]
    for n in out:
        out += children[n]
    return out


def tree_path_distances(tree: DataFrame, leaf: str) -> DataFrame:
    """node_id, name, is_leaf and distance of every node from one leaf; no rows if the tree lacks it."""
    rows, children = _nodes(tree)
    start = next((n for n, r in rows.items() if r["is_leaf"] and r["name"] == leaf), None)
    found, work = ({start: 0.0}, [start]) if start is not None else ({}, [])
    while work:
        n = work.pop()
        near = [(c, rows[c]["dist"]) for c in children[n]] + ([(rows[n]["parent_id"], rows[n]["dist"])] if rows[n]["parent_id"] is not None else [])
        for other, step in near:
            if other not in found:
                found[other] = found[n] + step
                work.append(other)
    return tree.sparkSession.createDataFrame([(n, rows[n]["name"], rows[n]["is_leaf"], d) for n, d in found.items()], "node_id long, name string, is_leaf boolean, distance double")


def tree_layout(tree: DataFrame, cladogram: bool = False) -> DataFrame:
    """node_id, x, y, leaves below and depth-first order of every node: y is a leaf's place among tips, the mean of its
    children for others; x is the distance from the root, or, in a cladogram, how many levels are above the lowest tip."""
    rows, children = _nodes(tree)
    root = next((n for n, r in rows.items() if r["parent_id"] is None), None)
    order = _down(children, root) if root is not None else []
    x, y, size, height = {}, {}, {}, {}
    for n in reversed(order):
        below = children[n]
        y[n] = sum(y[c] for c in below) / len(below) if below else float(rows[n]["tip_order"])
        size[n] = sum(size[c] for c in below) or 1
        height[n] = max((height[c] + 1 for c in below), default=0)
    for n in order:
        x[n] = float(height[root] - height[n]) if cladogram else 0.0 if n == root else x[rows[n]["parent_id"]] + rows[n]["dist"]
    return tree.sparkSession.createDataFrame([(n, x[n], y[n], size[n]) for n in order], "node_id long, x double, y double, leaves int")


def pruned(tree: DataFrame, kept: DataFrame) -> DataFrame:
    """The leaves of a tree that kept (REF_ID) has, numbered anew in order; all of them if it has none."""
    leaves = tree.where("is_leaf")
    if not kept.isEmpty():
        leaves = leaves.join(kept.select(F.col("REF_ID").alias("name")).distinct(), "name", "left_semi")
    return running_total(leaves.withColumn("_one", F.lit(1)), [], ["tip_order"], "_one", "_at").withColumn("tip_order", (F.col("_at") - 1).cast("int")).select(*tree.columns)


def overlapping(annotations: DataFrame, query: str, lo: int | None = None, hi: int | None = None) -> DataFrame:
    out = annotations.where(F.col("contig_id") == query)
    return out if lo is None else out.where((F.col("stop") >= lo) & (F.col("start") <= hi))


def annotate(intervals: DataFrame, annotations: DataFrame) -> DataFrame:
    """Every pair of an interval and a feature of its query that overlap, ends included."""
    on = (F.col("QUERY_ID") == F.col("contig_id")) & (F.col("stop") >= F.col("INTERVAL_START")) & (F.col("start") <= F.col("INTERVAL_END"))
    return intervals.join(annotations, on)


def overlap_counts(intervals: DataFrame, annotations: DataFrame, value: str) -> DataFrame:
    """intervals that overlap a feature, with n (how many) and first (the least value of these), as from annotate, but without its
    pairs: different places of intervals meet different places of features, which carry how many lie there and their least value."""
    spans = annotations.groupBy("contig_id", "start", "stop").agg(F.count("*").alias("_n"), F.min(value).alias("_first"))
    at = ["QUERY_ID", "INTERVAL_START", "INTERVAL_END"]
    met = annotate(intervals.select(*at).distinct(), spans).groupBy(*at).agg(F.sum("_n").alias("n"), F.min("_first").alias("first"))
    return intervals.join(met, at)


def tracks(annotations: DataFrame, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Features of a range with a track per type, types in order; arrows: where the body ends (body), null for one too short
    to have a body."""
    types = annotations.where("ftype is not null").select("ftype").distinct()
    numbered = types.withColumn("track", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ftype")) - 1)  # a row a type
    shown = annotations if lo is None else annotations.where((F.col("stop") >= lo) & (F.col("start") <= hi))
    head = F.greatest(F.lit(ARROW_LEAST), F.greatest(F.col("stop") - F.col("start"), F.lit(1)) * ARROW_HEAD)
    body = F.when(F.col("strand") == "+", F.when(F.col("stop") - head > F.col("start"), F.col("stop") - head)).otherwise(F.when(F.col("start") + head < F.col("stop"), F.col("start") + head))
    return shown.join(numbered, "ftype").withColumns({"body": body, "center": (F.col("start") + F.col("stop")) / 2})


#: Arrow heads: least length, and share of a feature.
ARROW_LEAST, ARROW_HEAD = 6.0, 0.125


def annotation_hover(df: DataFrame) -> Column:
    """The text shown for a feature; names are the first that is not null of their candidates."""
    first = lambda *names: F.coalesce(*([F.col(f"`{n}`").cast("string") for n in names if n in df.columns] or [F.lit(None).cast("string")]))
    line = lambda head, value: F.coalesce(F.concat(F.lit(head), F.nullif(value, F.lit(""))), F.lit(""))
    product = first("product", "prokka_product", "swissprot_product", "description")
    product = F.when(F.length(product) > 120, F.concat(F.substring(product, 1, 117), F.lit("…"))).otherwise(product)
    pfam = F.filter(F.transform(F.split(first("swissprot_Pfam", "Pfam", "pfam"), ","), lambda x: F.trim(x)), lambda x: x != "")
    more = F.when(F.size(pfam) > 3, F.concat(F.lit(" (+"), (F.size(pfam) - 3).cast("string"), F.lit(")"))).otherwise("")
    extras = F.concat_ws(" | ", F.concat(F.lit("COG: "), first("swissprot_eggNOG", "eggNOG", "cog")), F.concat(F.lit("KO: "), first("swissprot_KO", "KO", "kegg_ko")), F.when(F.size(pfam) > 0, F.concat(F.lit("Pfam: "), F.array_join(F.slice(pfam, 1, 3), ", "), more)))
    strand = F.concat("strand", F.when(F.col("strand") == "+", " →").otherwise(" ←"))
    return F.concat(
        F.lit("<b>"), "locus_tag", F.lit("</b><br><i>"), "ftype", F.lit("</i><br>Position: "), F.format_number("start", 0), F.lit(" – "), F.format_number("stop", 0),
        F.lit("<br>Length: "), F.format_number(F.col("stop") - F.col("start"), 0), F.lit(" bp  "), strand,
        line("<br><b>Gene:</b> ", first("ann_name", "prokka_gene", "swissprot_gene", "gene")), line("<br><b>EC:</b> ", first("ec_number", "prokka_EC_number", "swissprot_EC_number")),
        line("<br><b>Product:</b> ", product), line("<br>", extras),
    )


def ticks(n: int, y: tuple[float, float] | None = None, most: int = 30) -> list[int]:
    """Which of n tips get a label: every so many of all, the last too, or of those in a window, about `most`."""
    if y is None:
        return [*(at := range(0, n, max(1, n // most))), *([n - 1] if n and at[-1] != n - 1 else [])]
    lo, hi = (max(0, min(round(v), n - 1)) for v in sorted(y))
    seen = range(lo, hi + 1)
    return list(seen[:: len(seen) // most] if len(seen) > most else seen)


def nearest(value: float, values: list[float]) -> float:
    """The value of a list next to one; of two as near the larger."""
    return min(sorted(values, reverse=True), key=lambda v: abs(v - value))


def min_span(view: tuple[float, float] | None, least: float, bounds: tuple[float, float] | None = None) -> tuple[int, int] | None:
    """A zoom range, widened to `least` about its middle and kept within bounds, as whole numbers outward; the bounds (or
    None) for a range of no size."""
    if view is None:
        return None
    first, last = sorted(view)
    if not (math.isfinite(last - first) and last > first):
        return (int(bounds[0]), int(bounds[1])) if bounds else None
    lo, hi = first, last
    if hi - lo < least:
        lo, hi = (lo + hi - least) / 2, (lo + hi + least) / 2
    if bounds and hi - lo > bounds[1] - bounds[0]:
        lo, hi = bounds
    elif bounds:
        if lo < bounds[0]:
            lo, hi = bounds[0], min(bounds[1], bounds[0] + hi - first)
        if hi > bounds[1]:
            lo, hi = max(bounds[0], bounds[1] - (last - first)), bounds[1]
        if hi - lo < least:
            mid = (lo + hi) / 2
            lo, hi = max(bounds[0], mid - least / 2), min(bounds[1], mid + least / 2)
    return math.floor(max(-1e10, min(1e10, lo))), math.ceil(max(-1e10, min(1e10, hi)))


def visible(df: DataFrame, y: tuple[float, float], x: tuple[float, float]) -> DataFrame:
    """Rows in a window of tips and positions, rounded outward, in export order."""
    return df.where(F.col("y").between(math.floor(min(y)), math.ceil(max(y))) & (F.col("INTERVAL_END") >= math.floor(min(x))) & (F.col("INTERVAL_START") <= math.ceil(max(x)))).orderBy("y", "INTERVAL_START")


def export(df: DataFrame, folder: str, query: str, y: tuple[int, int], x: tuple[int, int], tag: str = "") -> str:
    path = f"{folder}/{query}{tag}_y{y[0]}-{y[1]}_x{x[0]}-{x[1]}.tsv"
    visible(df, y, x).drop("y").write.mode("overwrite").csv(path, sep="\t", header=True)
    return path
