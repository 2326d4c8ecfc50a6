"""Commands: sketch, map, merge and info. Sketches are folders of Parquet tables; results are tab-separated text.

    python -m kmeridian.cli sketch -i reference.fa -o ref.skc
    python -m kmeridian.cli map -q queries.fa -i ref.skc -d 0.1 -l 9900 -o out"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kmeridian.plans import mapping as M
from kmeridian.plans import sketching as S
from kmeridian.session import scratch
from kmeridian.sources import readers as R


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kmeridian", description=__doc__.split("\n")[0])
    top.add_argument("--seed", type=int, default=0, help="seed of hash positions and null windows [0]")
    commands = top.add_subparsers(dest="command", required=True)

    sketch = commands.add_parser("sketch", add_help=False, help="sketch a reference")
    sketch.add_argument("--help", action="help")
    sketch.add_argument("-i", "--input-path", required=True, help="FASTA or FASTQ, plain or gzipped, a path or an address")
    sketch.add_argument("-o", "--output-path", required=True)
    sketch.add_argument("-k", "--mer-len", type=int, default=27)
    sketch.add_argument("-w", "--win-len", type=int, help="window of minimizers [k + 6]")
    sketch.add_argument("-h", "--num-positions", type=int, help="hashed positions [k - 16, also whenever -w is not given]")
    sketch.add_argument("-m", "--modulo-lsh", type=int, default=2)
    sketch.add_argument("-r", "--residue-lsh", type=int, default=1)
    sketch.add_argument("--frac", action=argparse.BooleanOptionalAction, default=True, help="keep buckets of residue r and below, not of r alone")

    map_ = commands.add_parser("map", help="map queries to sketches")
    map_.add_argument("-q", "--query-path", required=True)
    map_.add_argument("-i", "--sketch-path", required=True)
    map_.add_argument("-o", "--output-path", help="a folder [standard output]")
    map_.add_argument("--hdist-th", type=int, default=4)
    map_.add_argument("--chisq", type=float, default=33.00051)
    map_.add_argument("-d", "--dist-th", type=float, nargs="+", required=True, help="one or eight thresholds")
    map_.add_argument("-l", "--min-length", type=int, required=True)
    map_.add_argument("-b", "--bin-shift", type=int, default=0)
    map_.add_argument("--enum-only", action=argparse.BooleanOptionalAction, default=False)
    map_.add_argument("--sample-size", type=int, default=200)

    merge = commands.add_parser("merge", help="put sketches into one")
    merge.add_argument("-i", "--sketch-paths", nargs="+", required=True)
    merge.add_argument("-o", "--output-path", required=True)

    info = commands.add_parser("info", help="show what a sketch holds")
    info.add_argument("-i", "--sketch-path", required=True)
    return top


def _sequences(spark: SparkSession, source: str):
    return R.read_sequences(spark, R.fetch(source, scratch(spark))).select("query_id", "seq")


def run_sketch(spark: SparkSession, a: argparse.Namespace) -> None:
    p = S.SketchParams(k=a.mer_len, w=a.win_len, h=a.num_positions, m=a.modulo_lsh, r=a.residue_lsh, frac=a.frac, seed=a.seed)
    S.save(S.build(_sequences(spark, a.input_path), a.output_path.rstrip("/").rpartition("/")[2], p), a.output_path)


def run_map(spark: SparkSession, a: argparse.Namespace) -> None:
    p = M.MapParams(thresholds=tuple(a.dist_th), min_length=a.min_length, hdist=a.hdist_th, chisq=a.chisq, bin_shift=a.bin_shift, enum_only=a.enum_only, sample_size=a.sample_size, seed=a.seed)
    sketch = S.load(spark, a.sketch_path)
    result, notes = M.map_and_notes(_sequences(spark, a.query_path), sketch, p)
    order = [r["rid"] for r in sketch[0].select("rid").collect()]
    if a.output_path:
        M.write_tsv(result, a.output_path, order)
    else:
        rows = M.as_text(result, order)
        print("\t".join(rows.columns))
        for r in rows.toLocalIterator():
            print("\t".join("" if v is None else str(v) for v in r))
    for r in notes.orderBy("rid", "query_id").toLocalIterator():
        print(f"{r['query_id']} ({r['rid']}): {r['code']}, {r['n']}", file=sys.stderr)


def run_merge(spark: SparkSession, a: argparse.Namespace) -> None:
    for path in a.sketch_paths:
        S.save(S.load(spark, path), a.output_path)


def run_info(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = S.info(S.load(spark, a.sketch_path)[0]).collect()
    print(f"File:             {a.sketch_path}\nNumber of sketches: {len(rows)}")
    for i, r in enumerate(rows):
        print(f"\n[Sketch {i + 1}/{len(rows)}]")
        for name, value in r.asDict().items():
            print(f"  {name + ':':<12} {value}")


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("kmeridian").getOrCreate()
    try:
        {"sketch": run_sketch, "map": run_map, "merge": run_merge, "info": run_info}[a.command](spark, a)
    except ValueError as problem:
        print(f"Invalid configuration: {problem}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
