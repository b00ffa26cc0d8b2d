"""Index tables in a folder: parquet, overwritten or appended to in batches.

Every write first claims the next range of ordinals (``claims``), makes a batch of its own, a folder ``batches/<name>``
that nothing else touches, and at the end one row in ``published``, which makes it exist for readers. Writers that run
at the same time therefore get ranges of their own. An overwrite publishes a higher generation, and only the highest one
is read; a merge publishes one batch in place of several. A write that dies half-way changes nothing, readers never see
a mixture, and an index that was read before stays as it was until ``drop_retired`` is called. Statistics are sums per
batch, added up on reading, so an append never reads what is stored.

Postings are bucketed by document, which lets scores be summed without a shuffle. Large batches also lie in directories
by range of terms, with as many rows in each; the first terms of the ranges are published with the batch, and a search
opens only the ranges its words fall into. Inside a file postings are sorted by term, so that row-group statistics skip
what lies between the words. The bucketed table is put into the catalog of the session at write time, which takes the
right to create tables there; where a catalog does not know it, the files are read as they are, with a shuffle.
"""

from __future__ import annotations

import time
import uuid
from bisect import bisect_right
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from rankwell.operators.numbering import dense_positions
from rankwell.operators.postings import term_stats, token_rows, with_average_length
from rankwell.operators.ranking import docs_per_block
from rankwell.plans.build import Index, analyze_field, build_index, to_documents
from rankwell.schema import FIELDS
from rankwell.sources import claims

BYTES_PER_BUCKET = 32 << 20  # of text; a task sorts the postings of a bucket, which take some ten times as much memory
MOST_BUCKETS = 4096
BYTES_PER_FILE = 16 << 20  # of text, in one range of one bucket
MOST_RANGES = 256
SAMPLE_DOCS = 20_000  # whose terms place the ranges; any places are right, these make them even
INTERVALS = 64  # of words that go into a scan as bounds for row groups

_PUBLISHED = (
    "generation long, number long, batch string, replaces array<string>, published double, buckets int, "
    "fields array<struct<field: string, max_doc: long, sum_ttf: long, ranges: array<string>>>"
)
_DOCS = "ord long, doc_id string, topic string, question string, ord_block long"
_POSTINGS = "field string, term string, ord long, tf long, positions array<int>, dl long, term_range int"
_DOC_STATS = "field string, ord long, num_tokens long, dl long"
_TERM_STATS = "field string, term string, df long, ttf long"


def _rows(spark: SparkSession, path: str) -> list:
    """All published rows in order of their numbers; one row per write, and a merge makes one of many."""
    try:
        return spark.read.schema(_PUBLISHED).json(f"{path}/published").orderBy("number").collect()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return []
        raise


def _published(spark: SparkSession, path: str) -> list:
    """The batches of the newest generation, in order. A merge counts if all that it replaces is there."""
    rows = _rows(spark, path)
    newest = max((row["generation"] for row in rows), default=0)
    seen: dict = {}
    for row in rows:
        if row["generation"] == newest and all(batch in seen for batch in row["replaces"]):
            for batch in row["replaces"]:
                del seen[batch]
            seen[row["batch"]] = row
    return list(seen.values())


def _claim(spark: SparkSession, path: str, generation: int | None, count: int) -> dict:
    """The next ``count`` ordinals of a generation, or, without one, a new generation and its first ordinals."""

    def following(number: int, records: list[dict]) -> dict:
        first = max((r["next_ord"] for r in records), default=0)
        return {
            "generation": number + 1 if generation is None else generation,
            "number": number,
            "first_ord": first,
            "next_ord": first + count,
        }

    return claims.claim(spark, f"{path}/claims", following, lambda record: record["generation"] == generation)


def _table_name(batch: str, field: str) -> str:
    return f"rankwell_{field}_{batch}"


def term_range(term: Column, firsts: list[str]) -> Column:
    """Number of the last of the sorted ``firsts`` that is not above the term, from 1; 0 if all are. A binary search."""
    if not firsts:
        return F.lit(0)
    bounds = F.array(*(F.lit(first) for first in firsts))
    steps = [1 << i for i in reversed(range(len(firsts).bit_length()))]

    def narrowed(low: Column, step: Column) -> Column:
        first = F.get(bounds, low + step - 1)
        return F.when(first <= term, low + step).otherwise(low)

    return F.aggregate(F.array(*(F.lit(step) for step in steps)), F.lit(0), narrowed)


def _first_terms(docs: DataFrame, count: int, field: str, synonyms, ranges: int) -> list[str]:
    """First terms of ``ranges`` ranges (but the lowest) that hold about as many postings each.

    A term that fills a range has it to itself. Worked out from about ``SAMPLE_DOCS`` documents, chosen by hash.
    """
    if ranges <= 1:
        return []
    share = max(1, count // SAMPLE_DOCS)
    sample = docs.filter(F.pmod(F.xxhash64("ord"), F.lit(share)) == 0)
    held = token_rows(analyze_field(sample, field, synonyms), "ord").select("ord", "term").distinct()
    sizes = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    order = Window.orderBy("term")  # the words of the sample, a bounded table
    through = sizes.select("term", "df", F.sum("df").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("through"))
    total = F.max("through").over(Window.partitionBy())
    step = F.floor((F.col("through") - F.col("df")) * ranges / total)
    marked = through.select("term", "df", step.alias("step"), (F.col("df") * ranges >= total).alias("fills"))
    opens = marked.select("term", "fills", (F.col("step") != F.lag("step", 1, 0).over(order)).alias("opens"))
    firsts = set()
    for row in opens.filter("opens OR fills").collect():
        firsts.add(row["term"])
        if row["fills"]:
            firsts.add(row["term"] + "\u0000")  # the least term above it
    return sorted(firsts)


def write_index(
    questions: DataFrame,
    path: str,
    mode: str = "overwrite",
    synonyms: DataFrame | None = None,
    fields: tuple[str, ...] = FIELDS,
    buckets: int | None = None,
    ranges: int | None = None,
) -> None:
    """Index ``(id, topic, body, ord)`` into ``path``.

    ``overwrite`` drops earlier documents for those who read later; ``append`` adds to them (and creates the index if
    there is none) and takes the same ``fields``. Ordinals, which must not repeat, are made dense in the order of
    ``ord``, after those that writes before have claimed; a write that dies leaves a gap in them. A repeated document id
    is stored twice. No questions make an index without documents. Writers may run at the same time; an append that
    began before an overwrite counts as done before it. ``buckets`` of the first batch and ``ranges`` of terms follow
    the text bytes unless given; later batches keep the number of buckets, so that their sums stay in their buckets
    together, unless they need four times as many.
    """
    if mode not in ("overwrite", "append"):
        raise ValueError("mode must be 'overwrite' or 'append'")
    spark = questions.sparkSession
    stored = _published(spark, path) if mode == "append" else []
    if stored and {row["field"] for row in stored[0]["fields"]} != set(fields):
        raise ValueError(f"the index holds the fields {sorted(row['field'] for row in stored[0]['fields'])}")
    size = sum((F.coalesce(F.octet_length(column), F.lit(0)).cast("long") for column in ("topic", "body")), F.lit(0))
    by_ord = questions.select("ord", size.alias("bytes")).groupBy("ord").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    count, distinct, bytes_, lowest, highest = by_ord.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count("ord"), F.coalesce(F.sum("bytes"), F.lit(0)), F.min("ord"), F.max("ord")
    ).first()
    if distinct != count:
        raise ValueError(f"{count - distinct} ordinals are repeated or null")
    generation = None if mode == "overwrite" else (stored[0]["generation"] if stored else 0)
    claimed = _claim(spark, path, generation, count)
    first_ord = claimed["first_ord"]
    if count and highest - lowest + 1 == count:
        questions = questions.withColumn("ord", F.col("ord") - lowest + first_ord)
    else:
        numbered = dense_positions(questions)
        questions = questions.join(numbered, "ord").withColumn("ord", F.col("position") + first_ord).drop("position")
    wanted = buckets or min(MOST_BUCKETS, max(1, -(-bytes_ // BYTES_PER_BUCKET), min(spark.sparkContext.defaultParallelism, 1 + bytes_ // (1 << 20))))
    if stored and not buckets and wanted <= 4 * stored[0]["buckets"]:
        wanted = stored[0]["buckets"]
    ranges = ranges or min(MOST_RANGES, -(-bytes_ // (wanted * BYTES_PER_FILE)))

    batch = uuid.uuid4().hex
    index = build_index(questions, synonyms, fields, wanted)
    firsts = {field: _first_terms(to_documents(questions), count, field, synonyms, ranges) for field in fields}
    totals = _write_batch(spark, f"{path}/batches/{batch}", batch, index.docs, index.postings, wanted, firsts)
    _publish(spark, path, claimed, batch, [], wanted, totals)


def _publish(spark: SparkSession, path: str, claimed: dict, batch: str, replaces: list[str], buckets: int, totals: list) -> None:
    """Make a batch exist for readers: one record under the writer's own number."""
    fields = [dict(zip(("field", "max_doc", "sum_ttf", "ranges"), total, strict=True)) for total in totals]
    record = {"generation": claimed["generation"], "number": claimed["number"], "batch": batch, "replaces": replaces}
    claims.make(spark, f"{path}/published", f"{claimed['number']:020d}", record | {"published": time.time(), "buckets": buckets, "fields": fields})


def _write_batch(
    spark: SparkSession, folder: str, batch: str, docs: DataFrame, postings: dict[str, DataFrame], buckets: int, firsts: dict[str, list[str]]
) -> list:
    """Tables of one batch, whose postings are spread by ``ord`` already; what is published of each field."""
    block = F.floor(F.col("ord") / docs_per_block()).cast("long")
    docs.withColumn("ord_block", block).write.partitionBy("ord_block").parquet(f"{folder}/docs")
    stored_docs = _table(spark, folder, "docs", _DOCS)
    totals = []
    for field, rows in postings.items():
        (
            rows.withColumn("term_range", term_range(F.col("term"), firsts[field]).cast("int"))
            .write.partitionBy("term_range")
            .bucketBy(buckets, "ord")
            .sortBy("term")
            .option("path", f"{folder}/postings_{field}")
            .saveAsTable(_table_name(batch, field))
        )
        written = _postings(spark, folder, batch, field)
        term_stats(written).write.parquet(f"{folder}/term_stats_{field}")
        _doc_stats(stored_docs, written, field).write.parquet(f"{folder}/doc_stats_{field}")
        sums = _table(spark, folder, f"doc_stats_{field}", _DOC_STATS).agg(F.count("*"), F.coalesce(F.sum("num_tokens"), F.lit(0)))
        totals.append((field, *sums.first(), firsts[field]))
    return totals


def merge_index(spark: SparkSession, path: str, buckets: int | None = None) -> None:
    """Publish one batch in place of all that are there; documents, ordinals and statistics stay as they are.

    Batches that others append meanwhile stay beside it, and of merges that run at the same time one counts. Readers of
    the batches it replaces keep them until ``drop_retired``.
    """
    batches = _published(spark, path)
    if len(batches) < 2:
        return
    claimed = _claim(spark, path, batches[0]["generation"], 0)
    wanted = buckets or max(row["buckets"] for row in batches)
    batch = uuid.uuid4().hex
    index = _index(spark, path, batches)
    # ranges of the batch with the most; where it has none, the others are small
    names = [f["field"] for f in batches[0]["fields"]]
    firsts = {name: max((f["ranges"] for row in batches for f in row["fields"] if f["field"] == name), key=len) for name in names}
    postings = {name: index.postings[name].drop("term_range").repartition(wanted, "ord") for name in names}
    totals = _write_batch(spark, f"{path}/batches/{batch}", batch, index.docs.drop("ord_block"), postings, wanted, firsts)
    _publish(spark, path, claimed, batch, [row["batch"] for row in batches], wanted, totals)


def drop_retired(spark: SparkSession, path: str, older_than: float = 7 * 24 * 3600.0) -> list[str]:
    """Delete batches that no reader finds any more and that were replaced, or left by a dead write, ``older_than``
    seconds ago or more; the names of those deleted. An index read before that then no longer works."""
    rows, visible = _rows(spark, path), {row["batch"] for row in _published(spark, path)}
    newest = max((row["generation"] for row in rows), default=0)
    renewed = min((row["published"] for row in rows if row["generation"] == newest), default=0.0)
    replaced = {batch: row["published"] for row in rows for batch in row["replaces"]}
    published = {row["batch"]: row for row in rows}
    dropped = []
    for batch, changed in claims.names(spark, f"{path}/batches"):
        row = published.get(batch)
        since = changed if row is None else max(row["published"], replaced.get(batch, renewed))
        if batch in visible or time.time() - since < older_than:
            continue
        for field in row["fields"] if row is not None else ():
            spark.sql(f"DROP TABLE IF EXISTS {_table_name(batch, field['field'])}")
        claims.delete(spark, f"{path}/batches/{batch}")
        dropped.append(batch)
    return dropped


def _table(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{folder}/{name}")


def _postings(spark: SparkSession, folder: str, batch: str, field: str) -> DataFrame:
    """The bucketed table where this session's catalog knows it, else its files."""
    name = _table_name(batch, field)
    if spark.catalog.tableExists(name):
        return spark.table(name)
    return _table(spark, folder, f"postings_{field}", _POSTINGS)


def _doc_stats(docs: DataFrame, postings: DataFrame, field: str) -> DataFrame:
    """Document lengths from stored postings, which costs less than analysing the text again; the grouping follows the
    buckets."""
    lengths = postings.groupBy("ord").agg(F.sum("tf").alias("num_tokens"), F.first("dl").alias("dl"))
    return docs.select("ord").join(lengths, "ord", "left").select(
        F.lit(field).alias("field"),
        "ord",
        F.coalesce("num_tokens", F.lit(0)).cast("long").alias("num_tokens"),
        F.coalesce("dl", F.lit(0)).cast("long").alias("dl"),
    )


def read_index(spark: SparkSession, path: str) -> Index:
    """Index tables of ``path``, put together from its published batches; reading changes nothing."""
    batches = _published(spark, path)
    if not batches:
        raise FileNotFoundError(f"no index has been written to {path}")
    return _index(spark, path, batches)


def _index(spark: SparkSession, path: str, batches: list) -> Index:
    fields = sorted(row["field"] for row in batches[0]["fields"])

    def together(name: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(*(f"{path}/batches/{row['batch']}/{name}" for row in batches))

    docs = reduce(DataFrame.unionByName, [_table(spark, f"{path}/batches/{row['batch']}", "docs", _DOCS) for row in batches])
    parts = {field: [_postings(spark, f"{path}/batches/{row['batch']}", row["batch"], field) for row in batches] for field in fields}
    firsts = {name: [f["ranges"] for row in batches for f in row["fields"] if f["field"] == name] for name in fields}

    def lookup(field: str, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
        return _looked_up(field, parts[field], firsts[field], stats[field], terms)

    stats = {field: together(f"term_stats_{field}", _TERM_STATS) for field in fields}
    totals = [(f["field"], f["max_doc"], f["sum_ttf"]) for row in batches for f in row["fields"]]
    return Index(
        docs=docs,
        postings={field: reduce(DataFrame.unionByName, parts[field]) for field in fields},
        doc_stats={field: together(f"doc_stats_{field}", _DOC_STATS) for field in fields},
        term_stats={field: _summed(stats[field]) for field in fields},
        collection_stats=with_average_length(
            spark.createDataFrame(totals, "field string, max_doc long, sum_ttf long")
            .groupBy("field")
            .agg(F.sum("max_doc").alias("max_doc"), F.sum("sum_ttf").alias("sum_ttf"))
        ),
        lookup=lookup,
    )


def _summed(stats: DataFrame) -> DataFrame:
    return stats.groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("ttf").alias("ttf"))


def _looked_up(field: str, parts: list[DataFrame], firsts: list[list[str]], stats: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, term statistics) cut to the ranges and row groups that can hold a word of ``terms``.

    Few words come to the driver as they are, more of them as the first and the last word in each range; both then are
    intervals, and say which directories and which row groups to read. More than ``INTERVALS`` are joined to neighbours.
    """
    words = terms.select("term").distinct()
    finest = max(firsts, key=len)
    few = [row["term"] for row in words.limit(INTERVALS + 1).collect()]
    if len(few) <= INTERVALS:
        spans = sorted((word, word) for word in few)
    else:
        ends = words.groupBy(term_range(F.col("term"), finest).alias("range")).agg(F.min("term").alias("low"), F.max("term").alias("high"))
        spans = sorted((row["low"], row["high"]) for row in ends.collect())
    wanted = [{n for low, high in spans for n in range(bisect_right(own, low), bisect_right(own, high) + 1)} for own in firsts]
    per = -(-len(spans) // INTERVALS) or 1
    joined = [(spans[i][0], spans[min(i + per, len(spans)) - 1][1]) for i in range(0, len(spans), per)]
    tests = [(F.col("term") == low) if low == high else F.col("term").between(low, high) for low, high in joined] or [F.lit(False)]
    while len(tests) > 1:  # a balanced tree stays shallow
        tests = [a | b for a, b in zip(tests[::2], tests[1::2], strict=False)] + tests[len(tests) & ~1 :]
    cut = [part.filter(F.col("term_range").isin(sorted(numbers))) for part, numbers in zip(parts, wanted, strict=True)]
    postings = reduce(DataFrame.unionByName, cut).filter(tests[0]).drop("term_range")  # as it is, the union keeps the buckets
    return postings, _summed(stats.filter(tests[0]))
