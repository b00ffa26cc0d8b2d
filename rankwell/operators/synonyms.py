"""Synonym expansion of token arrays, for one-word and many-word rules.

Matching is case-blind, greedy and longest-first from the left; matches never overlap. The outputs of a match start at
its first position and run on from there, past its end if they are longer.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankwell.operators.phrases import expanded, phrase_arrays
from rankwell.operators.sizing import fits_broadcast
from rankwell.operators.skew import lookup_join, sub_key
from rankwell.sources.scratch import materialize

# Joins the words of a rule into one key; no token can hold it.
_GLUE = "\u0001"
CHUNK = 1000  # outputs of a group in a row


@dataclass(frozen=True)
class SynonymRules:
    """Rules for lookup, as a star: an input phrase has groups, a group has outputs. Rows are linear in the words.

    ``heads(term, lengths)``: the lengths of the rules that start with a word. ``rules(phrase, groups)``: the groups of
    an input phrase. ``groups(group, outputs)``: the outputs of a group, at most about ``CHUNK`` in a row.
    ``longest``: words in the longest input. ``small``: the tables may be sent to all tasks.
    """

    heads: DataFrame
    rules: DataFrame
    groups: DataFrame
    longest: int
    small: bool
    once: dict[str, Broadcast] = field(default_factory=dict, repr=False, compare=False)

    @classmethod
    def of(cls, synonyms: DataFrame | SynonymRules) -> SynonymRules:
        """Rules from ``(input, output)`` rows: the outputs of an input are a group of its own."""
        if isinstance(synonyms, SynonymRules):
            return synonyms
        synonyms = materialize(synonyms.select("input", "output"), "synonyms")
        group = F.array_join("input", _GLUE)
        return cls._star(synonyms.select("input", group.alias("group")).distinct(), synonyms.select(group.alias("group"), "output").distinct())

    @classmethod
    def of_synsets(cls, synsets: DataFrame) -> SynonymRules:
        """Rules from ``(file, run, words)`` rows: every word of a synset of several gives all of them, itself included."""
        members = synsets.select(F.concat_ws(_GLUE, "file", F.col("run").cast("string")).alias("group"), "words").distinct()
        several = members.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("group")
        members = materialize(lookup_join(members, several, "group", "words"), "synset-members")
        return cls._star(members.select(F.col("words").alias("input"), "group"), members.select("group", F.col("words").alias("output")))

    @classmethod
    def _star(cls, inputs: DataFrame, outputs: DataFrame) -> SynonymRules:
        rules = inputs.groupBy(F.array_join("input", _GLUE).alias("phrase")).agg(F.sort_array(F.collect_set("group")).alias("groups"))
        heads = inputs.groupBy(F.element_at("input", 1).alias("term")).agg(F.sort_array(F.collect_set(F.size("input"))).alias("lengths"))
        sizes = outputs.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
        chunked = lookup_join(outputs, sizes, "group", "output").withColumn("chunk", sub_key(F.col("output"), F.col("chunks")))
        groups = chunked.groupBy("group", "chunk").agg(F.sort_array(F.collect_set("output")).alias("outputs")).drop("chunk")
        longest = inputs.agg(F.coalesce(F.max(F.size("input")), F.lit(1))).first()[0]
        small = fits_broadcast(inputs, "input", "group") and fits_broadcast(outputs, "output", "group")
        return cls(materialize(heads, "heads"), materialize(rules, "rules"), materialize(groups, "synonym-groups"), longest, small)

    def shared(self) -> Broadcast:
        """The rules as arrays for all tasks, made at the first use; only where they are ``small``."""
        if "arrays" not in self.once:
            arrays = phrase_arrays(self.rules, self.groups, _GLUE)
            self.once["arrays"] = self.rules.sparkSession.sparkContext.broadcast(arrays)
        return self.once["arrays"]


def _candidates(rows: DataFrame, words: str, synonyms: SynonymRules, key: list[str]) -> DataFrame:
    """``(key, start, len, outputs)``: the longest rule that matches at each start position."""
    window = F.transform(
        F.col(words),
        lambda term, pos: F.struct(
            pos.cast("int").alias("start"),
            term.alias("term"),
            F.slice(F.col(words), pos + 1, F.lit(synonyms.longest)).alias("next"),
        ),
    )
    if synonyms.longest == 1:
        window = F.transform(
            F.col(words), lambda term, pos: F.struct(pos.cast("int").alias("start"), term.alias("term"), F.array(term).alias("next"))
        )
    starts = materialize(rows.select(*key, F.inline_outer(window)).filter(F.col("term").isNotNull()), "phrase-starts")
    spans = lookup_join(starts.withColumn("spread", F.xxhash64(*key, "start")), synonyms.heads, "term", "spread")
    phrase = F.array_join(F.expr("slice(next, 1, len)"), _GLUE).alias("phrase")
    spans = spans.select(*key, "start", "spread", "next", F.explode("lengths").alias("len")).filter(F.col("len") <= F.size("next"))
    spans = materialize(spans.select(*key, "start", "spread", "len", phrase), "phrase-spans")
    matched = lookup_join(spans, synonyms.rules, "phrase", "spread").select(*key, "start", "spread", "len", "groups")
    if synonyms.longest > 1:
        best = F.max_by(F.struct("spread", "len", "groups"), "len").alias("best")
        matched = matched.groupBy(*key, "start").agg(best).select(*key, "start", "best.*")
    grouped = lookup_join(matched.withColumn("group", F.explode("groups")).drop("groups"), synonyms.groups, "group", "spread")
    outputs = F.array_distinct(F.flatten(F.collect_list("outputs")))
    return grouped.groupBy(*key, "start", "len").agg(outputs.alias("outputs"))


def _non_overlapping(candidates: DataFrame, key: list[str]) -> DataFrame:
    """Greedy choice from the left.

    Only matches of several words can shut others out. They are cut into islands of touching spans, and the running
    choice is made inside each island.
    """
    order = Window.partitionBy(*key).orderBy("start")
    reach = F.max(F.col("start") + F.col("len")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = candidates.withColumn("opens", F.coalesce((F.col("start") >= reach).cast("int"), F.lit(1))).withColumn(
        "island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    spans = F.array_sort(F.collect_list(F.struct("start", "len", "outputs")))
    kept = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("free"), F.filter("spans", lambda _: F.lit(False)).alias("kept")),
        lambda state, span: F.when(
            span["start"] >= state["free"],
            F.struct(
                (span["start"] + span["len"]).alias("free"), F.concat(state["kept"], F.array(span)).alias("kept")
            ),
        ).otherwise(state),
        lambda state: state["kept"],
    )
    return islands.groupBy(*key, "island").agg(spans.alias("spans")).select(*key, F.inline_outer(kept))


def expand_synonyms(rows: DataFrame, words: str, synonyms: SynonymRules | DataFrame, key: list[str]) -> DataFrame:
    """Add ``tokens ARRAY<STRUCT<pos, term>>``: the ``words`` array (lower-cased) with synonyms put in.

    ``key`` must identify a row. Small rules are sent to all tasks, which expand whole rows where they are: nothing is
    shuffled. Otherwise words are looked up in the rules where they stand; only the matches are grouped back to their
    row, where the result is put together by array functions.
    """
    synonyms = SynonymRules.of(synonyms)
    if synonyms.small:
        return rows.withColumn("tokens", expanded(F.col(words), synonyms.shared()))
    rows = rows.repartition(*key)
    candidates = _candidates(rows, words, synonyms, key)
    chosen = candidates if synonyms.longest == 1 else _non_overlapping(candidates, key)
    matches = chosen.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", "len", "outputs"))).alias("matches"))
    covered = F.flatten(
        F.transform("matches", lambda m: F.sequence(m["start"], m["start"] + m["len"] - 1))
    )
    every = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.expr("array()").cast("array<int>"))
    free = F.when(F.col("matches").isNull(), every).otherwise(F.array_except(every, covered))
    literal = F.transform(free, lambda pos: F.struct(pos.alias("pos"), F.get(F.col(words), pos).alias("term")))
    replaced = F.flatten(
        F.transform(
            "matches",
            lambda m: F.flatten(
                F.transform(
                    m["outputs"],
                    lambda out: F.transform(
                        out, lambda term, i: F.struct((m["start"] + i).cast("int").alias("pos"), term.alias("term"))
                    ),
                )
            ),
        )
    )
    tokens = F.when(F.col("matches").isNull(), literal).otherwise(F.concat(literal, replaced))
    return rows.join(matches, key, "left").withColumn("tokens", F.array_sort(tokens)).drop("matches")
