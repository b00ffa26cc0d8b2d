"""Ranked retrieval of questions on Spark."""

from rankwell.functions.scoring import length_norm
from rankwell.functions.text import (
    escape_query,
    is_header,
    parse_header,
    query_chunks,
    remove_stopwords,
    render_doc_xml,
    render_question,
    tokenize,
)
from rankwell.operators.analysis import analyze, query_terms
from rankwell.operators.boolean import analyzed_chunks, assign_occur, boolean_match, valid_queries, valid_query
from rankwell.operators.matching import match, score_clauses, score_terms, with_stats
from rankwell.operators.postings import build_postings, collection_stats, doc_lengths, term_stats, term_vectors, token_rows
from rankwell.operators.ranking import fetch_fields, report, top_hits, top_k, total_hits
from rankwell.operators.sampling import append_corpora, sample_queries
from rankwell.operators.synonyms import SynonymRules, expand_synonyms
from rankwell.plans.build import Index, build_index, index_count, to_documents
from rankwell.plans.search import adhoc_query, score, search, search_text
from rankwell.sources.index_store import drop_retired, merge_index, read_index, write_index
from rankwell.sources.questions import (
    drop_short_lines,
    parse_questions,
    question_count,
    read_questions,
    rejected_lines,
)
from rankwell.sources.results import result_lines, results_name, write_results, write_xml
from rankwell.sources.wordnet import read_synonym_rules, read_synonyms, read_synsets

__all__ = [name for name in dir() if not name.startswith("_")]
