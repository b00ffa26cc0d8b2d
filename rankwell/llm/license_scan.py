"""License scans by diagonal voting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankwell.llm.common import documents_of, lower_ascii

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Base phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Opening sentences of public license texts, found with small changes as well.
NOTICES = (
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
        "the license you may obtain a copy of the license at",
        "apache-notice",
    ),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction",
        "mit-notice",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation",
        "gpl-notice",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
        "bsd-notice",
    ),
    ("this work is licensed under a creative commons attribution", "cc-notice"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl-notice"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit-release"),
)

MAX_TEMPLATE_WORDS = 100_000  # all templates together: what is broadcast
_BLOCK = 60  # template positions that share one 64-bit set of votes
_MARK = "\x00"  # stands before the words of every document; no word holds it


def _gram_table(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """(template, tpos, t1, t2): every two neighbouring words of every template, and one row for the mark."""
    if sum(len(text.split()) for text, _ in templates) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates of more than {MAX_TEMPLATE_WORDS} words: scan with parts of them")
    rows = [(-1, 0, _MARK, None)]
    for number, (text, _) in enumerate(templates):
        words = text.split()
        if len(words) < 2:
            raise ValueError(f"a template needs two words at least: {text!r}")
        rows += [(number, place, *pair) for place, pair in enumerate(zip(words, words[1:], strict=False))]
    return spark.createDataFrame(rows, "template int, tpos int, t1 string, t2 string")


def _votes(docs: DataFrame, templates: list[tuple[str, str]], id_col: str, text_col: str) -> DataFrame:
    """Votes per document, template and diagonal; template -1 gives one row for every document.

    Each document's words become rows of two neighbouring words, their hash is joined with the hashes of the templates'
    pairs (a table of bounded size), and the words themselves are compared. A diagonal is the document position minus
    the template position. ``votes`` is a set of template positions, 60 to a row.
    """
    rows = documents_of(docs, id_col, text_col).select("doc_id", lower_ascii(F.col("text")).alias("content"))
    words = F.regexp_extract_all("content", F.lit(f"({WORD})"), F.lit(1))
    marked = F.concat(F.array(F.lit(_MARK)), words)
    rows = rows.select("doc_id", F.xxhash64("content").alias("content_hash"), marked.alias("w1"))
    rows = rows.withColumn("w2", F.slice("w1", F.lit(2), F.size("w1"))).withColumn("n_words", F.size("w1").cast("long") - 1)
    grams = rows.select("doc_id", "content_hash", "n_words", F.posexplode(F.arrays_zip("w1", "w2")).alias("pos", "gram"))
    first, second = F.col("gram.w1"), F.col("gram.w2")
    key = F.when(F.col("pos") == 0, F.lit(0)).otherwise(F.xxhash64(first, second))
    grams = grams.select("doc_id", "content_hash", "n_words", "pos", first.alias("w1"), second.alias("w2"), key.alias("gram"))
    table = _gram_table(docs.sparkSession, templates)
    table = table.withColumn("gram", F.when(F.col("template") < 0, F.lit(0)).otherwise(F.xxhash64("t1", "t2")))
    same = (F.col("w1") == F.col("t1")) & ((F.col("template") < 0) | (F.col("w2") == F.col("t2")))
    hits = grams.join(F.broadcast(table), "gram").filter(same)
    diagonal = F.col("pos") - 1 - F.col("tpos")
    bit = F.expr(f"shiftleft(1L, tpos % {_BLOCK})")
    keys = ["doc_id", "content_hash", "n_words", "template"]
    return hits.groupBy(*keys, diagonal.alias("diagonal"), F.expr(f"tpos div {_BLOCK}").alias("block")).agg(
        F.bit_or(bit).alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("n")
    )


def _spans(votes: DataFrame, templates: list[tuple[str, str]], n_exact: int, slack: int, least: float) -> DataFrame:
    """Verified spans: (doc_id, content_hash, template, start, end, coverage), words from 0, end exclusive.

    The first ``n_exact`` templates need every pair on one diagonal. The others may shift by insertions and deletions:
    diagonals at most ``slack`` apart are merged, and a span is verified where the pairs found on them, each template
    position once, make ``least`` of the template.
    """
    doc = ["doc_id", "content_hash", "template"]
    grams = F.create_map(*(F.lit(x) for i, (text, _) in enumerate(templates) for x in (i, len(text.split()) - 1)))
    sized = votes.filter("template >= 0").withColumn("grams", grams[F.col("template")])
    order = Window.partitionBy(*doc).orderBy("diagonal", "block")
    step = F.col("diagonal") - F.lag("diagonal").over(order)
    apart = F.when(F.col("template") < n_exact, step != 0).otherwise(step > slack)
    island = sized.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(order))
    blocks = island.groupBy(*doc, "grams", "island", "block").agg(
        F.bit_or("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    found = blocks.groupBy(*doc, "grams", "island").agg(
        F.sum(F.bit_count("votes")).alias("voted"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    coverage = F.col("voted") / F.col("grams")
    needed = F.when(F.col("template") < n_exact, 1.0).otherwise(least)
    return found.filter(coverage >= needed).select(
        *doc, (F.col("first") - 1).cast("long").alias("start"), (F.col("last") + 1).cast("long").alias("end"), coverage.alias("coverage")
    )


def scan_licenses(
    docs: DataFrame,
    *,
    base: Sequence[tuple[str, str]] = BASE,
    notices: Sequence[tuple[str, str]] = NOTICES,
    slack: int = 3,
    least: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_words, spans), one row for every row of ``docs``.

    ``spans``: array of (base, label, start, end, coverage) in order of start, end and label. Base phrases are found
    where their words stand consecutively, each place by itself; ``notices`` where ``least`` of their neighbouring word
    pairs stand on diagonals at most ``slack`` apart. Words are runs of digits, letters and non-ASCII characters after
    lower-casing A-Z. Null and empty texts have no words and no spans. Rows with the same id and text are counted
    together and reported each.
    """
    templates = [*base, *notices]
    votes = _votes(docs, templates, id_col, text_col)
    labels = F.create_map(*(F.lit(x) for i, (_, label) in enumerate(templates) for x in (i, label)))
    doc = ["doc_id", "content_hash"]
    is_doc = F.col("template") < 0
    spans = _spans(votes, templates, len(base), slack, least)
    span = F.struct(
        "start", "end", labels[F.col("template")].alias("label"), (F.col("template") < len(base)).alias("base"), "coverage"
    )
    spans = spans.select(*doc, span.alias("span"), F.lit(None).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n"))
    every = votes.filter(is_doc).select(*doc, F.lit(None).cast(spans.schema["span"].dataType).alias("span"), "n_words", "n")
    together = every.unionByName(spans).groupBy(*doc).agg(
        F.max("n_words").alias("n_words"), F.max("n").alias("copies"), F.sort_array(F.collect_list("span")).alias("spans")
    )
    copied = together.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return copied.select("doc_id", "n_words", "spans")


def query(docs: DataFrame) -> DataFrame:
    scanned = scan_licenses(docs)
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start"])

    def joined(spans):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)).alias("score"),
    )


def _sql(base=BASE, notices=NOTICES, slack: int = 3, least: float = 0.8) -> str:
    templates = [*base, *notices]
    pairs = ", ".join(
        f"({number}, {place}, '{a} {b}')"
        for number, (text, _) in enumerate(templates)
        for place, (a, b) in enumerate(zip(text.split(), text.split()[1:], strict=False))
    )
    labels = ", ".join(f"({i}, '{label}', {len(text.split()) - 1}, {str(i < len(base)).lower()})" for i, (text, label) in enumerate(templates))
    return f"""
WITH pairs(template, tpos, pair) AS (VALUES {pairs}),
templates(template, label, grams, base) AS (VALUES {labels}),
words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '{WORD}') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(len(w) - 1)) AS pos FROM words),
hits AS (SELECT doc_id, template, pos - tpos AS diagonal, tpos, pos FROM
           (SELECT doc_id, pos, w[pos + 1] || ' ' || w[pos + 2] AS pair FROM places) JOIN pairs USING (pair)),
diagonals AS (SELECT doc_id, template, diagonal, CASE WHEN diagonal - lag(diagonal) OVER d > CASE WHEN base THEN 0 ELSE {slack} END
                OR lag(diagonal) OVER d IS NULL THEN 1 ELSE 0 END AS opens
              FROM (SELECT DISTINCT doc_id, template, diagonal FROM hits) JOIN templates USING (template)
              WINDOW d AS (PARTITION BY doc_id, template ORDER BY diagonal)),
islands AS (SELECT doc_id, template, diagonal, sum(opens) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS island FROM diagonals),
spans AS (SELECT doc_id, template, min(pos) AS start, count(DISTINCT tpos) / any_value(grams) AS coverage, any_value(base) AS base,
            any_value(label) AS label
          FROM hits JOIN islands USING (doc_id, template, diagonal) JOIN templates USING (template) GROUP BY doc_id, template, island
          HAVING count(DISTINCT tpos) / any_value(grams) >= CASE WHEN any_value(base) THEN 1.0 ELSE {least} END)
SELECT d.doc_id, len(w)::BIGINT AS n_words, count(s.start) FILTER (s.base) AS n_base, min(s.start) FILTER (s.base) AS first_word,
  max(s.start) FILTER (s.base) AS last_word, coalesce(string_agg(DISTINCT s.label, ',' ORDER BY s.label) FILTER (s.base), '') AS base_labels,
  coalesce(string_agg(DISTINCT s.label, ',' ORDER BY s.label), '') AS labels, coalesce(max(s.coverage), 0.0) AS score
FROM words d LEFT JOIN spans s USING (doc_id) GROUP BY d.doc_id, d.w
"""


SQL = _sql()
