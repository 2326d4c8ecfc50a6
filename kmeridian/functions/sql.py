"""The engine's functions for SQL: register(spark) makes kmers (a table function), revcomp, lsh_bucket, hamming, mle_distance
and gamma_score known to a session."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kmeridian.functions import encode as E
from kmeridian.functions.model import Model, score_samples
from kmeridian.session import ship


class Kmers:
    """Positions and bp of a sequence's k-mers without breaks."""

    def eval(self, seq: str, k: int) -> Iterator[tuple[int, int]]:
        pos, bp = E.encode_all(seq, k)
        yield from zip(pos.tolist(), bp.view(np.int64).tolist(), strict=True)


def _by_value(x: pd.Series, other: pd.Series, of) -> pd.Series:
    """of(values, other) for runs of rows that share the other argument."""
    out = np.zeros(len(x), np.int64)
    keys = other.map(lambda v: tuple(v) if hasattr(v, "__len__") else v)
    for key, rows in x.groupby(keys):
        out[x.index.get_indexer(rows.index)] = of(rows.to_numpy().view(np.uint64), key).view(np.int64)
    return pd.Series(out)


def register(spark: SparkSession) -> None:
    ship(spark)

    @F.pandas_udf("long")
    def revcomp(bp: pd.Series, k: pd.Series) -> pd.Series:
        return _by_value(bp, k, lambda x, n: E.reverse_complements(x, int(n)))

    @F.pandas_udf("long")
    def lsh_bucket(bp: pd.Series, ppos: pd.Series) -> pd.Series:
        return _by_value(bp, ppos, lambda x, p: E.gather(x, [int(i) for i in p]))

    @F.pandas_udf("double")
    def mle_distance(v: pd.Series, u: pd.Series, k: pd.Series, h: pd.Series, rho: pd.Series) -> pd.Series:
        return pd.Series([float(Model(int(a), int(b), float(r), len(x) - 1).mle([x], [y])[0]) for x, y, a, b, r in zip(v, u, k, h, rho, strict=True)])

    @F.pandas_udf("struct<p:double,median:double>")
    def gamma_score(x: pd.Series, samples: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([score_samples(a, np.asarray(b, float)) for a, b in zip(x, samples, strict=True)], columns=["p", "median"])

    for f in (revcomp, lsh_bucket, mle_distance, gamma_score):
        spark.udf.register(f.__name__, f)
    spark.udtf.register("kmers", F.udtf(Kmers, returnType="pos long, bp long"))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION hamming(x BIGINT, y BIGINT) RETURNS INT RETURN bit_count(((x ^ y) | shiftrightunsigned(x ^ y, 1)) & {E.EVEN})")
