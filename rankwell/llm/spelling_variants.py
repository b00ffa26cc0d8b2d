"""Spelling variants by a dictionary of pairs of trie nodes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.llm.common import documents_of, lower_ascii
from rankwell.llm.sharding import CRC_TABLE, crc32_sql
from rankwell.sources.scratch import materialize

LEAST_LETTERS, LEAST_COUNT = 6, 5
FORM_TIMES = 5  # a form is at least so many times as frequent
SLIP = 199  # one of so many runs loses a letter
WORDS_PER_RANGE = 100_000
_LETTERS = "a-zÀ-ÿ"
_NODES_PER_PART = 1 << 40


def count_words(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_letters: int = LEAST_LETTERS,
    least_count: int = LEAST_COUNT,
    slip: int = SLIP,
) -> DataFrame:
    """(word, n) for words of at least ``least_letters`` code points that occur ``least_count`` times in all texts.

    Words are the runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case. Where ``slip`` divides the crc32 of
    "<id>:<run>", the run loses the code point at that number modulo its length. Null texts have no runs; a null id
    reads as the empty text; repeated rows count each time.
    """
    runs = documents_of(docs, id_col, text_col).select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(f"[{_LETTERS}]+"), F.lit(0))).alias("run"),
    )
    # a slip only shortens, so shorter runs never become words
    runs = runs.withColumn("letters", F.length("run")).filter(F.col("letters") >= least_letters)
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.col("letters")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.col("letters")))
    words = runs.select(F.when(F.col("h") % slip == 0, shorter).otherwise(F.col("run")).alias("word"))
    words = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.filter((F.length("word") >= least_letters) & (F.col("n") >= least_count))


def _shared(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    most = min(len(a), len(b))
    return next((i for i in range(most) if a[i] != b[i]), most)


def _number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nodes of sorted words, numbered as they appear; what the first word shares with a part before is told by ``common``."""
    part = TaskContext.get().partitionId()
    fresh = part * _NODES_PER_PART
    first, before, nodes = None, "", [0]
    for batch in batches:
        all_nodes, common = [], []
        for word in batch["word"]:
            first = word if first is None else first
            kept = _shared(before, word)
            new = len(word) - kept
            nodes = [*nodes[: kept + 1], *range(fresh + 1, fresh + new + 1)]
            before, fresh = word, fresh + new
            all_nodes.append(nodes)
            common.append(_shared(first, word))
        yield pd.DataFrame({"part": part, "word": batch["word"], "nodes": all_nodes, "common": common})


def trie_nodes(words: DataFrame, *, words_per_range: int = WORDS_PER_RANGE) -> DataFrame:
    """(word, nodes): the number of the trie node of every prefix of each of the distinct words, from the empty one on.

    Equal prefixes, and only those, have equal numbers; the numbers of whole words ascend in code-point order. Words are
    sorted by ranges, and each range numbers the nodes it meets first, as a trie is built from sorted words. A prefix
    that the range before knows already keeps its number: one row per range, its first and last word with the last
    one's nodes, is followed from range to range.
    """
    spark = words.sparkSession
    ranges = max(1, -(-words.count() // words_per_range))
    dealt = words.select("word").repartitionByRange(ranges, "word").sortWithinPartitions("word")
    dealt = materialize(dealt.mapInPandas(_number, "part long, word string, nodes array<long>, common int"), "trie-nodes")
    ends = dealt.groupBy("part").agg(
        F.min("word").alias("first"), F.max("word").alias("last"), F.max_by("nodes", "word").alias("nodes"), F.max_by("common", "word").alias("common")
    )
    starts, last, last_nodes = [], "", [0]
    for end in ends.orderBy("part").collect():
        known = last_nodes[: _shared(last, end["first"]) + 1]
        starts.append((end["part"], known))
        as_known = min(end["common"] + 1, len(known))
        last, last_nodes = end["last"], [*known[:as_known], *end["nodes"][as_known:]]
    starts = spark.createDataFrame(starts, "part long, known array<long>")
    as_known = F.least(F.col("common") + 1, F.size("known"))
    nodes = F.transform("nodes", lambda node, i: F.when(i < as_known, F.get("known", i)).otherwise(node))
    return dealt.join(F.broadcast(starts), "part").select("word", nodes.alias("nodes"))


def numbered_words(words: DataFrame, *, words_per_range: int = WORDS_PER_RANGE) -> DataFrame:
    """``words`` (word, n; words distinct) with ``id``, ``before``, ``behind`` and ``letters``, written.

    ``before`` holds the forward trie's node of what stands before every position, ``behind`` the reversed trie's node of
    what stands from there on; ``id`` is the forward node of the whole word.
    """
    forward = trie_nodes(words, words_per_range=words_per_range).withColumnRenamed("nodes", "before")
    backward = trie_nodes(words.select(F.reverse("word").alias("word")), words_per_range=words_per_range)
    backward = backward.select(F.reverse("word").alias("word"), F.reverse("nodes").alias("behind"))
    both = words.select("word", "n").join(forward, "word").join(backward, "word")
    letters = F.regexp_extract_all("word", F.lit("(?s)."), F.lit(0))
    return materialize(both.select("*", F.element_at("before", -1).alias("id"), letters.alias("letters")), "numbered-words")


def pair_dictionary(numbered: DataFrame) -> DataFrame:
    """(prefix, suffix, skips, leads, id, n): rows for every numbered word and every position in it.

    ``prefix`` is the node of what stands before the position, ``suffix`` that of what stands behind it: with the code
    point there skipped (``skips``), or nothing skipped, as if one were to be inserted. ``leads`` marks skipped code
    points that differ from the one before, so that a word which can be had by skipping any of several equal neighbours
    is had once.
    """
    skipped = F.transform(
        "letters",
        lambda letter, i: F.struct(
            F.get("before", i).alias("prefix"),
            F.get("behind", i + 1).alias("suffix"),
            F.lit(True).alias("skips"),
            ((i == 0) | (letter != F.get("letters", i - 1))).alias("leads"),
        ),
    )
    whole = F.transform(
        "before",
        lambda node, i: F.struct(
            node.alias("prefix"), F.get("behind", i).alias("suffix"), F.lit(False).alias("skips"), F.lit(False).alias("leads")
        ),
    )
    return numbered.select(F.explode(F.concat(skipped, whole)).alias("pair"), "id", "n").select("pair.*", "id", "n")


def near_words(pairs: DataFrame) -> DataFrame:
    """(id, n_near, best): number of words that differ in one inserted, deleted or replaced code point, and the best of them.

    ``best`` is (n, back), the largest n and of several the word first in code-point order, as ``back`` = -id. Words that
    meet on a pair of nodes with a position skipped differ in that code point alone; a whole word that meets them there
    is had by deleting it. A pair of nodes gathers at most one word for each code point of the alphabet and the whole
    word, and is summed up in its best two: no pairs of words are formed.
    """
    told = F.struct("n", (-F.col("id")).alias("back"), "leads")
    groups = pairs.groupBy("prefix", "suffix").agg(
        F.sort_array(F.collect_list(F.when(F.col("skips"), told)), asc=False).alias("skipping"),
        F.max(F.when(~F.col("skips"), F.struct("n", (-F.col("id")).alias("back")))).alias("whole"),
    )
    size = F.size("skipping")
    groups = groups.filter((size >= 2) | ((size == 1) & F.col("whole").isNotNull()))
    nothing = F.lit(None).cast("struct<n:bigint,back:bigint>")
    bare = lambda m: F.struct(m["n"].alias("n"), m["back"].alias("back"))

    def of_member(member, i):
        other = F.get("skipping", F.when(i == 0, F.lit(1)).otherwise(F.lit(0)))
        replaced = F.when(size > 1, bare(other)).otherwise(nothing)
        deleted = F.when(member["leads"] & F.col("whole").isNotNull(), F.col("whole")).otherwise(nothing)
        near = size - 1 + F.when(deleted.isNotNull(), 1).otherwise(0)
        return F.struct((-member["back"]).alias("id"), near.alias("near"), F.array_max(F.array(replaced, deleted)).alias("best"))

    leading = F.filter("skipping", lambda m: m["leads"])
    of_whole = F.struct(
        (-F.col("whole")["back"]).alias("id"), F.size(leading).alias("near"), F.array_max(F.transform(leading, bare)).alias("best")
    )
    told = F.concat(F.transform("skipping", of_member), F.array(F.when(F.col("whole").isNotNull(), of_whole)))
    found = groups.select(F.explode(told).alias("f")).select("f.*").filter("near > 0")
    return found.groupBy("id").agg(F.sum("near").cast("long").alias("n_near"), F.max("best").alias("best"))


def _roots(words: DataFrame) -> list[DataFrame]:
    """(id, root), round by round: words (id, word, form_id) without a form, then those whose form the round before had."""
    level = words.filter("form_id IS NULL").select("id", F.col("word").alias("root"))
    pointers = words.filter("form_id IS NOT NULL").select(F.col("id").alias("from"), "form_id")
    rounds = []
    while True:
        level = pointers.join(level, pointers["form_id"] == level["id"]).select(F.col("from").alias("id"), "root")
        level = materialize(level, "variant-roots")
        if level.isEmpty():
            return rounds
        rounds.append(level)


def group_variants(words: DataFrame, *, times: int = FORM_TIMES, words_per_range: int = WORDS_PER_RANGE) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row for each of the distinct words of ``words`` (word, n).

    A word's form is its most frequent near word (of several the first in code-point order), if that is ``times`` (more
    than 1) as frequent; else null. ``root`` is where following forms ends, the word itself without one. Words without a
    form are roots, words whose form has a root get it in the next round; frequencies grow ``times`` with each form, so
    rounds are few. Words that share a form are near it, which bounds what meets on one. No words give no rows.
    """
    words = materialize(words.select("word", F.col("n").cast("long").alias("n")), "variant-words")
    numbered = numbered_words(words, words_per_range=words_per_range)
    near = near_words(pair_dictionary(numbered))
    best = F.when(F.col("best")["n"] >= times * F.col("n"), -F.col("best")["back"])
    found = numbered.select("id", "word", "n").join(near, "id", "left")
    found = materialize(found.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), best.alias("form_id")), "variant-near")
    none = F.lit(None)
    result = found.filter("form_id IS NULL").select(
        "word", none.cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", none.cast("long").alias("form_n")
    )
    linked = found.filter("form_id IS NOT NULL")
    names = found.select(F.col("id").alias("form_id"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    for roots in _roots(found):
        result = result.unionByName(linked.join(roots, "id").join(names, "form_id").drop("id", "form_id"))
    return result


def query(docs: DataFrame) -> DataFrame:
    return group_variants(count_words(docs)).select("word", "form", "root", "n", "n_near", "form_n")


SQL = f"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[{_LETTERS}]+')) AS run
  FROM documents),
hashed AS (
  SELECT run, count(*) AS times, {crc32_sql("concat(doc_id, ':', run)")} AS h
  FROM runs, crc WHERE length(run) >= {LEAST_LETTERS} GROUP BY doc_id, run, t),
words AS (
  SELECT CASE WHEN h % {SLIP} = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word,
         sum(times)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= {LEAST_LETTERS} AND sum(times) >= {LEAST_COUNT}),
places AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
skips AS (SELECT word, n, concat(substr(word, 1, i), '_', substr(word, i + 2)) AS with_gap,
                 concat(substr(word, 1, i), substr(word, i + 2)) AS without FROM places),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM skips a JOIN skips b ON a.with_gap = b.with_gap AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM skips a JOIN words b ON a.without = b.word
  UNION SELECT b.word, a.word, a.n FROM skips a JOIN words b ON a.without = b.word),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n
  FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN other_n >= {FORM_TIMES} * w.n THEN other END AS form,
         CASE WHEN other_n >= {FORM_TIMES} * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
followed AS (
  SELECT word, word AS root FROM forms WHERE form IS NULL
  UNION ALL SELECT f.word, g.root FROM forms f JOIN followed g ON f.form = g.word)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM forms JOIN followed USING (word)
"""
