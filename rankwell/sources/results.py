"""Result and XML sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.functions.scoring import resolve_similarity


def result_lines(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_ord, line)``: ``id,doc,doc,...`` per query in rank order; a query without a hit gives its id alone.

    ``queries`` holds the valid queries only.
    """
    ranked = hits.groupBy("query_ord").agg(
        F.array_sort(F.collect_list(F.struct("rank", "doc_id")))["doc_id"].alias("doc_ids")
    )
    return queries.join(ranked, queries["ord"] == ranked["query_ord"], "left").select(
        queries["ord"].alias("query_ord"), F.concat_ws(",", "id", "doc_ids").alias("line")
    )


def results_name(sim: int, test_id: int | str, synonyms: bool) -> str:
    """S or F for synonyms on or off, the similarity, the test id."""
    return f"{'S' if synonyms else 'F'}{resolve_similarity(sim)}_{test_id}.txt"


def write_results(
    hits: DataFrame, queries: DataFrame, directory: str, sim: int, test_id: int | str, synonyms: bool = False
) -> str:
    """Append the result lines, in query order, to the folder named after the run; returns its path."""
    path = f"{directory}/{results_name(sim, test_id, synonyms)}"
    result_lines(hits, queries).orderBy("query_ord").select("line").write.mode("append").text(path)
    return path


def write_xml(questions: DataFrame, path: str) -> None:
    """Append questions as ``<add><doc><field name=...>`` XML, escaped; one root element per part file."""
    fields = F.array(
        *(
            F.struct(F.lit(name).alias("_name"), F.coalesce(name, F.lit("")).alias("_VALUE"))
            for name in ("id", "topic", "body")
        )
    )
    questions.orderBy("ord").select(fields.alias("field")).write.mode("append").format("xml").option(
        "rootTag", "add"
    ).option("rowTag", "doc").save(path)
