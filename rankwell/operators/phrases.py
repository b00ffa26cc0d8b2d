"""Small synonym rules as arrays that tasks hold, and the expansion of word arrays by them, a batch of rows at a time.

Nothing is exploded, joined or grouped: a row's words go in, its positioned tokens come out. What workers run is kept in
closures over numpy and pyarrow, so they need not import this package.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENS = "array<struct<pos: int, term: string>>"
WORDS_AT_ONCE = 1 << 19  # words that a task looks up together; a row is never cut
TOKENS_AT_ONCE = 1 << 21  # tokens that it puts together, likewise
KEPT_OUTPUTS = 1 << 21  # words of merged outputs that a task keeps for its next batches


def phrase_arrays(rules: DataFrame, groups: DataFrame, glue: str) -> dict:
    """The star of ``SynonymRules``, which must be small, as arrays: a trie over the words of the inputs, the groups of
    every input, the outputs of every group and the words of every output. Linear in the rows of the star.

    Words and outputs are numbered in their order, so numbers compare like the words.
    """
    rules = rules.select("phrase", F.explode("groups").alias("group")).toArrow()
    outputs = groups.select("group", F.explode("outputs").alias("output")).filter(F.size("output") > 0)
    outputs = outputs.select("group", F.array_join("output", glue).alias("output")).toArrow()

    def numbered(texts: pa.ChunkedArray | pa.Array) -> tuple[pa.Array, np.ndarray]:
        distinct = pc.unique(texts)
        distinct = distinct.take(pc.sort_indices(distinct))
        numbers = pc.index_in(texts, value_set=distinct)
        numbers = numbers.combine_chunks() if isinstance(numbers, pa.ChunkedArray) else numbers
        return distinct, numbers.to_numpy(zero_copy_only=False).astype("int64")

    def cut(phrases: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        parts = pc.split_pattern(phrases, glue)
        return parts.offsets.to_numpy().astype("int64"), *numbered(parts.values)

    group_names, rule_group = numbered(rules["group"])
    phrases, rule_phrase = numbered(rules["phrase"])
    starts, words, word = cut(phrases)
    sizes, node, free, edges, children = np.diff(starts), np.zeros(len(phrases), "int64"), 1, [], []
    for depth in range(int(sizes.max(initial=0))):
        deep = np.flatnonzero(sizes > depth)
        found, which = np.unique(node[deep] * len(words) + word[starts[deep] + depth], return_inverse=True)
        edges.append(found)
        children.append(free + np.arange(len(found)))
        node[deep] = children[-1][which]
        free += len(found)
    edges = np.concatenate([*edges, np.empty(0, "int64")])
    order = np.argsort(edges)
    rule_of_node = np.full(free, -1, "int64")
    rule_of_node[node] = np.arange(len(phrases))

    def rows_of(keys: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        by_key = np.lexsort((values, keys))
        return np.searchsorted(keys[by_key], np.arange(n + 1)), values[by_key]

    texts, output = numbered(outputs["output"])
    group = pc.index_in(outputs["group"], value_set=group_names).combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False).astype("int64")
    output_starts, output_words, output_word = cut(texts)
    return {
        "words": words,
        "edges": edges[order],
        "children": np.concatenate([*children, np.empty(0, "int64")])[order],
        "rule_of_node": rule_of_node,
        "groups": rows_of(rule_phrase, rule_group, len(phrases)),
        "outputs": rows_of(group[group >= 0], output[group >= 0], len(group_names)),
        "output_starts": output_starts,
        "output_words": output_words,
        "output_word": output_word,
        "longest": int(sizes.max(initial=1)),
        "spills": bool((np.diff(output_starts) > 1).any()),
    }


def expanded(words: Column, shared) -> Column:
    """``tokens`` of a column of word arrays: ``shared`` is the broadcast of ``phrase_arrays``."""
    return F.arrow_udf(_expansion(lambda: shared.value), TOKENS)(words)


def _expansion(held: Callable[[], dict]) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    words_at_once, tokens_at_once, kept_outputs = WORDS_AT_ONCE, TOKENS_AT_ONCE, KEPT_OUTPUTS

    def pieces(starts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
        """Runs of whole rows with at most ``most`` elements, or a row of more."""
        at = 0
        while at < len(starts) - 1:
            to = max(int(np.searchsorted(starts, starts[at] + most, "right")) - 1, at + 1)
            yield at, to
            at = to

    def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The numbers of all elements of slices, one slice after the other."""
        ends = np.cumsum(sizes)
        return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)

    def longest_matches(table: dict, ids: np.ndarray, row_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(start, length, rule)`` of the longest rule at each word where one starts."""
        rule, length = np.full(len(ids), -1), np.zeros(len(ids), "int64")
        at, node = np.arange(len(ids)), np.zeros(len(ids), "int64")
        for depth in range(table["longest"] if len(table["edges"]) else 0):
            inside = at + depth < row_end[at]
            at, node = at[inside], node[inside]
            known = ids[at + depth] >= 0
            at, node = at[known], node[known]
            wanted = node * len(table["words"]) + ids[at + depth]
            place = np.minimum(np.searchsorted(table["edges"], wanted), len(table["edges"]) - 1)
            hit = table["edges"][place] == wanted
            at, node = at[hit], table["children"][place[hit]]
            ends = table["rule_of_node"][node]
            rule[at[ends >= 0]] = ends[ends >= 0]
            length[at[ends >= 0]] = depth + 1
        start = np.flatnonzero(rule >= 0)
        return start, length[start], rule[start]

    def from_the_left(start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Which matches are chosen: running choice inside islands of touching matches, all others as they are."""
        end = start + length
        opens = np.r_[True, start[1:] >= np.maximum.accumulate(end)[:-1]] if len(start) else np.empty(0, bool)
        chosen = np.ones(len(start), bool)
        shut = np.flatnonzero(~opens)
        free, island = -1, -1
        firsts = np.flatnonzero(opens)
        for i, first in zip(shut, firsts[np.searchsorted(firsts, shut) - 1]):
            if first != island:
                island, free = first, end[first]
            if start[i] >= free:
                free = end[i]
            else:
                chosen[i] = False
        return chosen

    def outputs_of(table: dict, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(place, word)`` of all distinct outputs of some groups, in order."""
        first, all_outputs = table["outputs"]
        outputs = [all_outputs[first[g] : first[g + 1]] for g in groups]
        outputs = outputs[0] if len(outputs) == 1 else np.unique(np.concatenate(outputs))
        starts = table["output_starts"][outputs]
        sizes = table["output_starts"][outputs + 1] - starts
        word = table["output_word"][spread(starts, sizes)]
        if not table["spills"]:
            return np.zeros(len(word), "int64"), word
        place = spread(np.zeros(len(sizes), "int64"), sizes)
        order = np.lexsort((word, place))
        return place[order], word[order]

    def merged(table: dict, rules: np.ndarray, kept: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(starts, places, words)`` of the outputs of some rules; lists of several groups are merged once a worker."""
        first, groups = table["groups"]
        found = []
        for rule in rules.tolist():
            of = groups[first[rule] : first[rule + 1]]
            key = of.tobytes()
            if key not in kept["outputs"]:
                outputs = outputs_of(table, of)
                if kept["size"] + len(outputs[0]) > kept_outputs:
                    kept["outputs"], kept["size"] = {}, 0
                kept["outputs"][key] = outputs
                kept["size"] += len(outputs[0])
            found.append(kept["outputs"][key])
        none = np.empty(0, "int64")
        starts = np.cumsum([0, *(len(place) for place, _ in found)])
        return starts, np.concatenate([none, *(f[0] for f in found)]), np.concatenate([none, *(f[1] for f in found)])

    def tokens_of(rows: int, row: np.ndarray, pos: np.ndarray, term: pa.Array) -> pa.Array:
        ends = np.cumsum(np.bincount(row, minlength=rows))
        tokens = pa.StructArray.from_arrays([pa.array(pos, pa.int32()), term], ["pos", "term"])
        return pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), tokens)

    def in_order(row: np.ndarray, pos: np.ndarray, term: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        coded = term.dictionary_encode()
        rank = np.empty(len(coded.dictionary), "int64")
        rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
        order = np.lexsort((rank[coded.indices.to_numpy(zero_copy_only=False)] if len(rank) else rank, pos, row))
        return row[order], pos[order], term.take(pa.array(order))

    def expand_rows(table: dict, values: pa.Array, starts: np.ndarray, kept: dict) -> Iterator[pa.Array]:
        """Rows whose words are ``values[starts[i]:starts[i + 1]]``."""
        n, rows = len(values), len(starts) - 1
        sizes = np.diff(starts)
        row = np.repeat(np.arange(rows), sizes)
        ids = pc.index_in(values, value_set=table["words"]).fill_null(-1).to_numpy(zero_copy_only=False).astype("int64")
        start, length, rule = longest_matches(table, ids, starts[1:][row])
        if table["longest"] > 1:
            chosen = from_the_left(start, length)
            start, length, rule = start[chosen], length[chosen], rule[chosen]
        rules, which = np.unique(rule, return_inverse=True)
        output_starts, places, output_words = merged(table, rules, kept)
        # what stands at each word: itself, the outputs of the match that starts there, or nothing inside a match
        count = np.ones(n, "int64")
        count[spread(start, length)] = 0
        first = np.full(n, -1)
        first[start] = output_starts[which]
        count[start] = np.diff(output_starts)[which]
        pool = pa.concat_arrays([values, table["output_words"]])
        token_starts = np.r_[0, np.cumsum(count)][starts]
        for at, to in pieces(token_starts, tokens_at_once):
            inside = slice(starts[at], starts[to])
            source = np.repeat(np.arange(starts[at], starts[to]), count[inside])
            output = spread(first[inside], count[inside])
            literal = first[source] < 0
            term = pool.take(pa.array(np.where(literal, source, n + output_words[np.where(literal, 0, output)] if len(output_words) else source)))
            pos = source - starts[row[source]]
            if table["spills"]:
                pos = pos + np.where(literal, 0, places[np.where(literal, 0, output)] if len(places) else 0)
                yield tokens_of(to - at, *in_order(row[source] - at, pos, term))
            else:
                yield tokens_of(to - at, row[source] - at, pos, term)

    def expand(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table, kept = held(), {"outputs": {}, "size": 0}
        for batch in batches:
            starts = batch.offsets.to_numpy().astype("int64")
            values = batch.values.cast(pa.string())
            for at, to in pieces(starts, words_at_once):
                yield from expand_rows(table, values.slice(starts[at], starts[to] - starts[at]), starts[at : to + 1] - starts[at], kept)

    # what pyspark reads the kind of the function from
    expand.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return expand
