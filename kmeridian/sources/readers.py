"""Readers: sequences, annotations, result tables, trees; and their text sinks."""

from __future__ import annotations

import gzip
import ipaddress
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmeridian.session import ship


_HIDDEN = re.compile(r"[^!-~]+")


def parse_sequences(data: bytes) -> Iterator[tuple[str, str, str]]:
    """(name, comment, sequence) of FASTA and FASTQ records, gzipped or plain. A FASTQ record whose quality is shorter
    than its sequence ends the file with an error."""
    text = (gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data).decode("latin-1")
    lines, at = text.split("\n"), 0
    while at < len(lines):
        if lines[at][:1] not in (">", "@"):
            at += 1
            continue
        name, _, comment = lines[at][1:].strip("\r").replace("\t", " ").partition(" ")
        at, seq = at + 1, []
        while at < len(lines) and lines[at][:1] not in (">", "@", "+"):
            seq.append(_HIDDEN.sub("", lines[at]))
            at += 1
        sequence = "".join(seq)
        if at < len(lines) and lines[at][:1] == "+":
            at, size = at + 1, 0
            while at < len(lines) and size < len(sequence):
                size += len(lines[at].strip("\r"))
                at += 1
            if size != len(sequence):
                raise ValueError(f"quality of {name} is not as long as its sequence")
        yield name, comment, sequence


def sequences(spark: SparkSession, path: str) -> DataFrame:
    """file, seq_ix, query_id, comment, seq, len of the FASTA or FASTQ files at path, one task per file. For FASTA of any size
    see fasta, which splits files."""
    ship(spark)

    def run(batches):
        import pandas as pd

        for b in batches:
            for path_, content in zip(b["path"], b["content"], strict=True):
                rows = [(path_, i, *r, len(r[2])) for i, r in enumerate(parse_sequences(bytes(content)))]
                yield pd.DataFrame(rows, columns=["file", "seq_ix", "query_id", "comment", "seq", "len"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, seq_ix int, query_id string, comment string, seq string, len long")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """file, block, query_id, comment, seq, len of FASTA files, plain or gzipped by their names. Plain files are split at
    record marks, so that a file is read by many tasks and no row holds more than one record; block is where in the file a
    record's split begins, and rows of a block stand in order."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", r"^\s*>", "").alias("r"))
    head, rest = F.regexp_extract("r", r"^([^\n]*)", 1), F.regexp_extract("r", r"(?s)^[^\n]*\n(.*)$", 1)
    out = rows.where(F.trim("r") != "").select("file", "block", F.regexp_extract(head, r"^(\S*)", 1).alias("query_id"), F.trim(F.regexp_extract(head, r"^\S*\s(.*?)\r?$", 1)).alias("comment"), F.regexp_replace(rest, "[^!-~]", "").alias("seq"))
    return out.withColumn("len", F.length("seq").cast("long"))


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """query_id, seq and more of the files at path: FASTA in splits, FASTQ file by file, by how the first line begins."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    return sequences(spark, path) if first and first[0]["value"].lstrip().startswith("@") else fasta(spark, path)


_URL = re.compile(r"^(?:https?|ftp)://([^/:\s]+)(?::\d{2,5})?(?:/\S*)?$", re.I)


def is_url(source: str) -> bool:
    """An http, https or ftp address of a public host."""
    m = _URL.match(source)
    if not m or m[1].lower() == "localhost":
        return False
    try:
        return not ipaddress.ip_address(m[1]).is_private
    except ValueError:
        return "." in m[1]


def url_column(source):
    """Whether a text column holds an address as is_url has it, by the shapes of private hosts."""
    host = F.lower(F.regexp_extract(source, r"(?i)^(?:https?|ftp)://([^/:\s]+)(?::\d{2,5})?(?:/\S*)?$", 1))
    private = host.rlike(r"^(?:127|10|0)\.|^192\.168\.|^169\.254\.|^172\.(?:1[6-9]|2\d|3[01])\.|^localhost$")
    return (host != "") & ~private & host.contains(".")


def fetch(source: str, folder: str) -> str:
    """Downloads an address into a shared folder and returns its path; other sources are returned as they are."""
    if not is_url(source):
        return source
    import hashlib
    import urllib.request

    path = f"{folder}/{hashlib.sha256(source.encode()).hexdigest()[:16]}"
    urllib.request.urlretrieve(source, path)  # noqa: S310
    return path


RESULT = "QUERY_ID string, SEQ_LEN long, INTERVAL_START long, INTERVAL_END long, STRAND string, IS_RC int, REF_ID string, DIST double, MASK int, D_INTERVAL string, DIST_CONTIG double, STRAND_DIFF double, DIST_GENOME double, PERCENTILE double, FOLD double, QVALUE double"


def results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, nanValue="nan", positiveInf="inf", negativeInf="-inf", schema=RESULT)


ATTRIBUTES = "map<string,string>"


def attributes(text):
    """The attributes of a GFF3 (k=v) or GTF (k "v") line as a map; of repeated keys the last stays."""

    def pair(x):
        at = F.instr(x, "=")
        value = F.trim(F.substr(x, at + 1, F.length(x)))
        quoted = F.regexp_replace(F.trim(F.regexp_extract(x, r"^\S+ (.*)$", 1)), '^"+|"+$', "")
        return F.when(at > 0, F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), value.alias("v"))).otherwise(F.struct(F.regexp_extract(x, r"^(\S+)", 1).alias("k"), quoted.alias("v")))

    parts = F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: x.rlike("[= ]"))
    return F.aggregate(F.transform(parts, pair), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])))


ANNOTATION = ("contig_id", "locus_tag", "ftype", "start", "stop", "strand", "ann_name", "product", "ec_number", "source", "score", "frame")


def gff_rows(lines: DataFrame, line: str = "value", more_names: bool = False) -> DataFrame:
    """Annotations of GFF3 or GTF lines: comments, blank lines, lines of less than eight fields and lines without integer
    positions are left out. more_names: gene names lead, and notes describe products."""
    whole = F.trim(F.regexp_replace(line, r"^\s+|\s+$", ""))
    t = lines.select(whole.alias("l")).where(~F.col("l").rlike(r"^(#|$)")).select(F.split("l", "\t").alias("f")).where(F.size("f") >= 8)
    at = lambda i: F.get("f", F.lit(i))
    known = lambda i: F.nullif(at(i), F.lit("."))
    t = t.withColumns({"a": attributes(F.coalesce(at(8), F.lit(""))), "s": F.trim(at(3)).try_cast("long"), "e": F.trim(at(4)).try_cast("long")}).where("s is not null and e is not null")
    key = lambda *names: F.coalesce(*(F.nullif(F.col("a")[n], F.lit("")) for n in names))
    synth = F.concat_ws("_", at(0), F.col("s").cast("string"), F.col("e").cast("string"))
    return t.select(
        at(0).alias("contig_id"), F.coalesce(key("ID", "locus_tag", "Name", "gene" if more_names else "ann_id"), synth).alias("locus_tag"), F.coalesce(known(2), F.lit("misc")).alias("ftype"),
        F.least("s", "e").alias("start"), F.greatest("s", "e").alias("stop"), F.when(at(6).isin("+", "-"), at(6)).otherwise("+").alias("strand"),
        key(*(("gene",) if more_names else ()), "ann", "ann_name", "Name").alias("ann_name"), key("product", "description", *(("note",) if more_names else ())).alias("product"), key("ec_number").alias("ec_number"),
        at(1).alias("source"), known(5).alias("score"), known(7).alias("frame"),
    )


def is_gff(lines: DataFrame, line: str = "value") -> bool:
    """Whether the first line that is no comment has nine fields and integers in the fourth and fifth."""
    first = lines.where(~F.col(line).rlike(r"^\s*(#|$)")).limit(1).collect()
    f = first[0][line].split("\t") if first else []
    return len(f) >= 9 and all(x.strip().isdigit() for x in f[3:5])


REQUIRED = ("contig_id", "locus_tag", "ftype", "start", "stop", "strand")


def custom_rows(table: DataFrame) -> DataFrame:
    """Annotations of a tab-separated table with the REQUIRED columns; "." and empty fields are null, a numeric first column
    of another name is dropped, and names that the table lacks are the first of their candidates that is not blank. Reversed
    features are swapped whole."""
    clean = table.select(*(F.when(F.trim(F.col(f"`{c}`").cast("string")).isin(".", ""), None).otherwise(F.col(f"`{c}`")).alias(c) for c in table.columns))
    first = clean.columns[0] if clean.columns else ""
    if first not in REQUIRED and clean.agg(F.bool_and(F.col(f"`{first}`").isNull() | F.col(f"`{first}`").try_cast("double").isNotNull())).first()[0] is not False:
        clean = clean.drop(F.col(f"`{first}`"))
    missing = [c for c in REQUIRED if c not in clean.columns]
    if missing:
        raise ValueError(f"annotation columns missing: {missing}")
    pick = lambda *names: F.coalesce(*([F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in clean.columns] or [F.lit(None).cast("string")]))
    a, b = F.col("start").cast("long"), F.col("stop").cast("long")
    new = {"start": F.least(a, b), "stop": F.greatest(a, b), "strand": F.when(F.col("strand").isin("+", "-"), F.col("strand")).otherwise("+")}
    for name, candidates in (("ann_name", ("prokka_gene", "swissprot_gene", "gene")), ("ec_number", ("prokka_EC_number", "swissprot_EC_number")), ("product", ("prokka_product", "swissprot_product"))):
        if name not in clean.columns:
            new[name] = pick(*candidates)
    return clean.withColumns(new)


def annotations(spark: SparkSession, path: str, more_names: bool = False) -> DataFrame | None:
    """The annotations at path, whatever their format; None if it can't be read as one."""
    try:
        lines = spark.read.text(path)
        if is_gff(lines):
            return gff_rows(lines, more_names=more_names)
        return custom_rows(spark.read.csv(path, sep="\t", header=True, comment="#"))
    except ValueError:
        return None


def parse_newick(text: str) -> list[tuple[int, int | None, str, float]]:
    """(node, parent, name, branch length) of a tree, parents before children."""
    rows: list[list] = [[0, None, "", 0.0]]
    at, here = [0], 0
    for token in re.findall(r"'(?:[^']|'')*'|[(),;]|[^(),;]+", text.strip()):
        if token == "(":
            rows.append([len(rows), at[-1] if here is None else here, "", 0.0])
            at.append(here)
            here = len(rows) - 1
        elif token == ",":
            rows.append([len(rows), at[-1], "", 0.0])
            here = len(rows) - 1
        elif token == ")":
            here = at.pop()
        elif token != ";":
            name, _, length = token.rpartition(":") if ":" in token else (token, "", "")
            rows[here][2] = name.strip().strip("'")
            rows[here][3] = float(length or 0.0)
    return [tuple(r) for r in rows]


def tree(spark: SparkSession, text: str) -> DataFrame:
    """tree_nodes: node_id, parent_id, name, dist, is_leaf, tip_order (smaller subtrees first)."""
    rows = parse_newick(text)
    children: dict[int, list[int]] = {}
    for node, parent, _, _ in rows:
        if parent is not None:
            children.setdefault(parent, []).append(node)
    size = {n: 1 for n, *_ in rows}
    for node, parent, _, _ in reversed(rows):
        if parent is not None:
            size[parent] += size[node]
    tips, work = {}, [0]
    while work:
        n = work.pop()
        if n not in children:
            tips[n] = len(tips)
        work += sorted(children.get(n, []), key=lambda c: (-size[c], -c))
    return spark.createDataFrame([(n, p, name, d, n not in children, tips.get(n)) for n, p, name, d in rows], "node_id long, parent_id long, name string, dist double, is_leaf boolean, tip_order int")
