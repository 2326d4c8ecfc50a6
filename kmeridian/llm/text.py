"""Small text helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words are runs of characters other than ASCII white space; `bytes.split()` cuts UTF-8 at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = " \t\n\x0b\x0c\r"


def words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True where crc32(doc_id as text) mod folds is fold; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold
