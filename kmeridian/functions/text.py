"""Numbers as text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def significant(x: Column, digits: int) -> Column:
    """So many significant digits as C prints them, trailing zeros dropped; nan, inf and -inf by name, 0 for both zeros. Each
    different number of a batch is printed once."""

    @F.arrow_udf("string")
    def shown(v: pa.Array) -> pa.Array:
        coded = v.dictionary_encode()
        return pa.array([f"{n + 0.0:.{digits}g}" for n in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)

    return shown(x.cast("double"))
