"""Exact duplicates by skew-safe combining."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwell.llm.common import documents_of, lower_ascii
from rankwell.operators.skew import LEAST_HOT, LOOKUP_SHARE, lookup_join
from rankwell.sources.scratch import materialize


def sha256(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def exact_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 32,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest), one row for every row of ``docs``.

    Texts are equal when identical after lower-casing A-Z only; null is the empty text. Of equal texts the largest id
    stays. Groups form in three steps, each comparing digest and whole content: inside a task (the partial sums of the
    first grouping), per salt of the id, so that a group holding a third of all rows is spread over ``salts`` keys, and
    over the at most ``salts`` winners of a group. Rows then look up their group by digest, with groups of over a
    thousandth of all rows spread over several keys; only contents that share a digest with another content, which ``variants`` counts, are looked up by content as well.

    Rows with a null id count in their group; they stay only where no row of the group has an id. Rows that repeat an
    id and a text are all reported, all kept or all dropped (``keep_one`` leaves a single one). No rows give no rows.
    """
    rows = documents_of(docs, id_col, text_col).select("doc_id", lower_ascii(F.col("text")).alias("content"))
    rows = rows.select("doc_id", "content", digest(F.col("content")).alias("digest"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    local = salted.groupBy("digest", "salt", "content").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    groups = local.groupBy("digest", "content").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    by_digest = materialize(
        groups.groupBy("digest").agg(
            F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count("*").alias("variants")
        ),
        "exact-groups",
    )
    total = by_digest.agg(F.sum("group_size")).first()[0] or 0
    per = max(LEAST_HOT, -(-total // LOOKUP_SHARE))
    hot = by_digest.filter(F.col("group_size") > per).select("digest", F.ceil(F.col("group_size") / per).cast("int").alias("parts"))
    spread = rows.select("doc_id", "digest", F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("spread"))
    plain = lookup_join(spread, by_digest.filter("variants = 1").drop("variants"), "digest", "spread", hot=hot).drop("spread")
    clashing = by_digest.filter("variants > 1").select("digest")
    if not clashing.isEmpty():
        again = groups.join(clashing, "digest", "left_semi")
        plain = plain.unionByName(rows.join(again, ["digest", "content"]).drop("content"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return plain.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every group of equal texts, all columns as they were."""
    found = exact_duplicates(docs, id_col=id_col, text_col=text_col).filter("kept").distinct()
    found = found.select(F.col("doc_id").alias("__keep_id"), F.col("digest").alias("__keep_digest"))
    marked = docs.withColumn("__content_digest", sha256(lower_ascii(docs[text_col])))
    same = marked[id_col].eqNullSafe(found["__keep_id"]) & (marked["__content_digest"] == found["__keep_digest"])
    kept = marked.join(found, same, "left_semi")
    return kept.dropDuplicates([id_col, "__content_digest"]).drop("__content_digest")


def query(docs: DataFrame) -> DataFrame:
    return exact_duplicates(docs).withColumnRenamed("digest", "text_sha256")


SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(content) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS content
      FROM documents)
WINDOW same AS (PARTITION BY content)
"""
