"""Column helpers that several of these operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_or_empty(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def lower_ascii(column: Column) -> Column:
    """A-Z in lower case, every other character as it is; null becomes empty.

    ``lower`` does the same on text that is ASCII throughout and is far faster than ``translate``.
    """
    text = text_or_empty(column)
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def held_out(id_column: Column) -> Column:
    """Whether crc32 of the id as text is divisible by five; such rows are never learnt from."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def documents_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under fixed names, so that further columns cannot clash."""
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
