"""Balanced shards by global prefix sums of bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankwell.llm.common import documents_of, text_or_empty
from rankwell.sources.scratch import materialize

SHARDS = 40
ROW_BYTES = 16  # what a row takes besides its text
ROWS_PER_RANGE = 1_000_000  # short rows without texts; a range is one task's work


def prefix_sums(rows: DataFrame, *order: str, size_col: str = "size", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``rows`` with ``before`` and ``place``: sum of sizes and number of rows before each, in the order of ``order``.

    ``order`` should tell rows apart: rows equal in all its columns cannot be split over ranges, and their places among
    themselves are open. Ranges are dealt once and written; each range sums up its own rows, and the ranges' totals, one
    row for each of them, give what lies before a range. Nothing else meets in one place.
    """
    ranges = max(1, -(-rows.count() // rows_per_range))
    dealt = rows.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id())
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = dealt.select("*", F.sum(size_col).over(inside).alias("through"), F.count(F.lit(1)).over(inside).alias("rank"))
    dealt = materialize(dealt, "prefix-sums")
    totals = dealt.groupBy("part").agg(F.max("through").alias("bytes"), F.max("rank").alias("rows")).orderBy("part").collect()
    starts, before, place = [], 0, 0
    for total in totals:
        starts.append((total["part"], before, place))
        before, place = before + total["bytes"], place + total["rows"]
    offsets = rows.sparkSession.createDataFrame(starts, "part int, bytes_before long, rows_before long")
    return dealt.join(F.broadcast(offsets), "part").select(
        *rows.columns,
        (F.col("bytes_before") + F.col("through") - F.col(size_col)).alias("before"),
        (F.col("rows_before") + F.col("rank") - 1).alias("place"),
    )


def shard_documents(
    docs: DataFrame,
    *,
    shards: int = SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_bytes: int = ROW_BYTES,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot), one row for every row of ``docs``.

    Documents lie in one global order: by the text's md5, so that equal texts are neighbours, then by id. The order is
    cut at ``shards`` equal targets of bytes; a document goes to the shard that holds its middle byte, so a shard is off
    its target by less than the largest document. Shards are contiguous in that order, and a group of equal texts lies
    in one shard unless a cut falls into it. ``size`` is the text's UTF-8 bytes (null: none) plus ``row_bytes``;
    ``slot`` counts a shard's rows from 0 in the order.

    Null ids come first among equal texts. Rows that repeat an id and a text are rows like any other; they take
    neighbouring places. With fewer documents than shards, or very long ones, some shards are empty. No rows give none.
    """
    text = text_or_empty(F.col("text"))
    rows = documents_of(docs, id_col, text_col).select(
        "doc_id",
        (F.octet_length(text).cast("long") + row_bytes).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("digest"),
    )
    rows = materialize(rows, "shard-sizes")  # the texts are read once; what follows handles short rows
    # rows that repeat an id and a text are told apart, so that ranges can split them too
    rows = rows.withColumn("turn", F.xxhash64(F.monotonically_increasing_id()))
    rows = prefix_sums(rows, "digest", "doc_id", "turn", rows_per_range=rows_per_range)
    total = rows.agg(F.sum("size")).first()[0]
    # twice the middle byte's place, so that it is a whole number
    middle = (2 * F.col("before") + F.col("size")).cast("decimal(38,0)")
    cut = F.floor(middle * shards / F.lit(2 * (total or 1)).cast("decimal(20,0)"))
    placed = rows.withColumn("shard", F.least(cut, F.lit(shards - 1)).cast("int"))
    first = placed.groupBy("shard").agg(F.min("place").alias("first_place"))  # as many rows as shards
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first_place")).alias("slot")
    )


def query(docs: DataFrame) -> DataFrame:
    return shard_documents(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


CRC_TABLE = """
SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)),
                        lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM (SELECT unnest(range(256)) AS i))
"""


def crc32_sql(text: str) -> str:
    """SQL for the crc32 of a text's UTF-8 bytes, with ``t`` the column of CRC_TABLE."""
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    step = "lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), {step}), 4294967295)"


SQL = f"""
WITH crc AS ({CRC_TABLE}),
sized AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, {crc32_sql("coalesce(text, '')")} AS text_crc32,
         md5(coalesce(text, '')) AS digest
  FROM documents, crc),
ordered AS (
  SELECT *, sum(size) OVER (ORDER BY digest, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size AS before,
         row_number() OVER (ORDER BY digest, doc_id NULLS FIRST) - 1 AS place, sum(size) OVER () AS total
  FROM sized),
placed AS (
  SELECT *, least((2 * before + size) * {SHARDS} // (2 * total), {SHARDS - 1})::INT AS shard FROM ordered)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
       (place - min(place) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard
FROM placed
"""
