"""SQL that gives the same rows as each registered query, written for DuckDB over the same parquet tables.

Common table expressions are put together from the fragments below; nothing here is shared with the engine but the
fixed stop words.
"""

from __future__ import annotations

import re

from rankwell.functions.text import STOP_WORDS

_A = r"[\p{L}\p{M}]"
_N = r"\p{Nd}"
_W = rf"(?:{_A}(?:[.'':·’]{_A})*|{_N}(?:[.,;''’]{_N})*)"
TOKEN = rf"_*{_W}(?:{_W}|_)*"
_STOP = ", ".join(f"'{word}'" for word in STOP_WORDS)
_CHUNK = r"[ \t\r\n\x{3000}]+"


def words(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{TOKEN}')"


# --- fragments: name -> (SQL, names it needs) ---------------------------------------------------------------------

FRAGMENTS: dict[str, tuple[str, tuple[str, ...]]] = {
    "corpus": (
        "SELECT doc_id AS ord, doc_id::VARCHAR AS id, concat_ws(' ', lang, source) AS topic, text AS body FROM documents",
        (),
    ),
    "turns": (
        "SELECT conv_id * 1000 + turn AS ord, concat_ws('-', conv_id, turn) AS id, role AS topic, text AS body "
        "FROM conversations",
        (),
    ),
    "batch": ("SELECT item_id AS ord, item_id::VARCHAR AS id, 'benchmark' AS topic, text AS body FROM benchmark", ()),
    "lines": (
        "SELECT doc_id, generate_subscripts(l, 1) AS n, unnest(l) AS line FROM (SELECT doc_id, string_split_regex("
        "'[' || doc_id || '] ' || concat_ws(' ', lang, source) || chr(10) || text, '\\r\\n|\\r|\\n') AS l FROM documents)",
        (),
    ),
    "bench_words": (
        f"SELECT item_id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS term FROM "
        f"(SELECT item_id, {words('text')} AS w FROM benchmark)",
        (),
    ),
    "doc_words": (
        f"SELECT ord, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS term FROM (SELECT ord, {words('body')} AS w FROM corpus)",
        ("corpus",),
    ),
    "topic_words": (
        f"SELECT ord, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS term FROM (SELECT ord, {words('topic')} AS w FROM corpus)",
        ("corpus",),
    ),
    "rules": (
        "SELECT DISTINCT a.term AS input, b.term AS output FROM "
        "(SELECT term, min(item_id) * 100 + least(length(term), 99) AS synset FROM bench_words GROUP BY term) a JOIN "
        "(SELECT term, min(item_id) * 100 + least(length(term), 99) AS synset FROM bench_words GROUP BY term) b "
        "USING (synset) WHERE synset IN (SELECT synset FROM (SELECT min(item_id) * 100 + least(length(term), 99) AS synset "
        "FROM bench_words GROUP BY term) GROUP BY synset HAVING count(*) > 1)",
        ("bench_words",),
    ),
    "tokens": (f"SELECT ord, pos, term FROM doc_words WHERE term NOT IN ({_STOP})", ("doc_words",)),
    "syn_words": (
        "SELECT ord, pos, coalesce(output, term) AS term FROM doc_words LEFT JOIN rules ON input = term",
        ("doc_words", "rules"),
    ),
    "syn_tokens": (f"SELECT ord, pos, term FROM syn_words WHERE term NOT IN ({_STOP})", ("syn_words",)),
    "topic_tokens": (f"SELECT ord, pos, term FROM topic_words WHERE term NOT IN ({_STOP})", ("topic_words",)),
    "chunks": (
        "SELECT ord AS query_ord, (generate_subscripts(c, 1) - 1)::INTEGER AS chunk, unnest(c) AS text FROM (SELECT ord, "
        f"list_filter(string_split_regex(body, '{_CHUNK}'), lambda x: x <> '') AS c FROM queries)",
        ("queries",),
    ),
    "chunk_words": (
        f"SELECT query_ord, chunk, (generate_subscripts(w, 1) - 1)::INTEGER AS pos, unnest(w) AS term FROM "
        f"(SELECT query_ord, chunk, {words('text')} AS w FROM chunks WHERE text NOT IN ('AND', 'OR', 'NOT'))",
        ("chunks",),
    ),
    "query_tokens": (f"SELECT * FROM chunk_words WHERE term NOT IN ({_STOP})", ("chunk_words",)),
    "syn_query_tokens": (
        f"SELECT * FROM (SELECT query_ord, chunk, pos, coalesce(output, term) AS term FROM chunk_words "
        f"LEFT JOIN rules ON input = term) WHERE term NOT IN ({_STOP})",
        ("chunk_words", "rules"),
    ),
    "numbered": (
        "SELECT *, number - is_clause AS before FROM (SELECT *, sum(is_clause) OVER (PARTITION BY query_ord ORDER BY chunk) "
        "AS number FROM (SELECT c.*, (t.query_ord IS NOT NULL)::INTEGER AS is_clause, "
        "coalesce(lag(text) OVER w = 'NOT', false) AS negated, "
        "coalesce(lag(text) OVER w = 'AND' OR (lag(text) OVER w = 'NOT' AND lag(text, 2) OVER w = 'AND'), false) AS anded "
        "FROM chunks c LEFT JOIN (SELECT DISTINCT query_ord, chunk FROM query_tokens) t USING (query_ord, chunk) "
        "WINDOW w AS (PARTITION BY query_ord ORDER BY chunk)))",
        ("chunks", "query_tokens"),
    ),
    "clauses": (
        "SELECT query_ord, chunk, CASE WHEN negated THEN 'must_not' WHEN anded OR EXISTS (SELECT 1 FROM numbered m "
        "WHERE m.query_ord = n.query_ord AND m.before = n.number AND m.anded AND m.text NOT IN ('AND', 'OR', 'NOT')) "
        "THEN 'must' ELSE 'should' END AS occur FROM numbered n WHERE is_clause = 1",
        ("numbered",),
    ),
}

_S = r"[ \t\r\n\x{3000}]"
_VALID = (
    "trim(body, ' ' || chr(9) || chr(10) || chr(13) || chr(12288)) <> '' AND NOT regexp_matches(body, "
    rf"'^{_S}*(AND|OR)({_S}|$)|(^|{_S})(AND|OR|NOT){_S}*$|(^|{_S})(AND|OR|NOT){_S}+(AND|OR)({_S}|$)|(^|{_S})NOT{_S}+NOT({_S}|$)')"
)


def _mentioned(sql: str, given: dict[str, str]) -> list[str]:
    """Fragments that follow FROM or JOIN in ``sql``."""
    sources = set(re.findall(r"(?:FROM|JOIN)\s+(\w+)", sql))
    return [name for name in (*FRAGMENTS, *given) if name in sources]


def with_ctes(body: str, *needs: str, **given: str) -> str:
    """``body`` behind the fragments it needs, in dependency order; ``given`` replaces or adds fragments."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in done:
            return
        sql, needed = (given[name], ()) if name in given else FRAGMENTS[name]
        if name in given:
            needed = tuple(need for need in _mentioned(sql, given) if need != name)
        for need in needed:
            add(need)
        done[name] = sql

    for need in needs:
        add(need)
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in done.items()) + "\n" + body


# --- index and scores ---------------------------------------------------------------------------------------------


def _index(tokens: str, documents: str = "corpus") -> dict[str, str]:
    """Fragments of an inverted index over a token table."""
    return {
        "post": f"SELECT term, ord, count(*) AS tf FROM {tokens} GROUP BY term, ord",
        "lens": f"SELECT d.ord AS ord, count(t.ord) AS num_tokens, count(DISTINCT t.pos) AS dl FROM {documents} d "
        f"LEFT JOIN {tokens} t ON t.ord = d.ord GROUP BY d.ord",
        "tstats": "SELECT term, count(*) AS df, sum(tf)::BIGINT AS ttf FROM post GROUP BY term",
        "coll": "SELECT count(*) AS max_doc, sum(num_tokens)::BIGINT AS sum_ttf, sum(num_tokens) / count(*) AS avgdl FROM lens",
    }


_NORM = "floor(1 / sqrt(dl) / pow(2, floor(log2(1 / sqrt(dl)))) * 4) / 4 * pow(2, floor(log2(1 / sqrt(dl))))"
# Ten significant digits: power of ten, then the digits as a whole number, rounded up to the next power where they fill.
_DIGITS = "floor(score / pow(10, floor(log10(score)) - 9) + 0.5)"
_SCORE_KEY = (
    f"CASE WHEN score < 1e-300 THEN 0 ELSE (floor(log10(score)) + CASE WHEN {_DIGITS} >= 1e10 THEN 401 ELSE 400 END) * 1e11 "
    f"+ CASE WHEN {_DIGITS} >= 1e10 THEN 1e9 ELSE {_DIGITS} END END"
)
_P = "((ttf + 1.0::DOUBLE) / (sum_ttf + 1.0::DOUBLE))"
_IDF = "(1 + ln(max_doc / (df + 1.0::DOUBLE)))"


def formula(sim: int, k1: float = 1.2, b: float = 0.75, mu: float = 2000.0, lam: float = 0.7) -> str:
    lam = 0.1 if sim == 3 else lam
    length = "(1 / (norm * norm))"
    jm = f"ln(1 + ((1 - {lam}::DOUBLE) * tf / {length}) / ({lam}::DOUBLE * {_P}))"
    return {
        0: f"sqrt(tf) * {_IDF} * {_IDF} * norm * query_norm",
        1: f"ln(1 + (max_doc - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * ({k1}::DOUBLE + 1) * tf / (tf + {k1}::DOUBLE * "
        f"(1 - {b}::DOUBLE + {b}::DOUBLE * {length} / avgdl))",
        2: f"greatest(0, ln(1 + tf / ({mu}::DOUBLE * {_P})) + ln({mu}::DOUBLE / ({length} + {mu}::DOUBLE)))",
        3: jm,
        4: jm,
    }[sim]


def _search(
    sim: int,
    k: int = 3,
    tokens: str = "tokens",
    query_tokens: str = "query_tokens",
    queries: str = "SELECT * FROM batch",
    norm: str = _NORM,
    documents: str = "corpus",
    operators: bool = False,
    final: str | None = None,
    more: dict[str, str] | None = None,
    **params: float,
) -> str:
    """Ranked search in SQL, by the definition: score every clause, fold positions, chunks, queries."""
    occur = "SELECT * FROM clauses" if operators else f"SELECT DISTINCT query_ord, chunk, 'should' AS occur FROM {query_tokens}"
    coord = "matched::DOUBLE / chunks" if sim == 0 else "1"
    inner = "count(*)::DOUBLE / max(width)" if sim == 0 else "1"
    given = {
        "queries": queries,
        **_index(tokens, documents),
        "occurs": occur,
        "terms": f"SELECT q.*, o.occur, coalesce(df, 0) AS df, coalesce(ttf, 0) AS ttf FROM {query_tokens} q JOIN occurs o "
        "USING (query_ord, chunk) LEFT JOIN tstats s ON s.term = q.term",
        "shapes": f"SELECT query_ord, count(DISTINCT chunk) FILTER (occur <> 'must_not') AS chunks, "
        f"count(DISTINCT chunk) FILTER (occur = 'must') AS musts, "
        f"1 / sqrt(sum({_IDF} * {_IDF}) FILTER (occur <> 'must_not')) AS query_norm FROM terms CROSS JOIN coll GROUP BY query_ord",
        "widths": "SELECT query_ord, chunk, count(DISTINCT pos) AS width FROM terms GROUP BY query_ord, chunk",
        "scored": f"SELECT query_ord, chunk, occur, pos, ord, {formula(sim, **params)} AS s FROM (SELECT t.*, p.ord, p.tf, "
        f"coll.*, query_norm, {norm} AS norm FROM terms t JOIN post p ON p.term = t.term JOIN lens l ON l.ord = p.ord "
        "JOIN shapes h ON h.query_ord = t.query_ord CROSS JOIN coll)",
        "by_pos": "SELECT query_ord, chunk, occur, pos, ord, sum(s) AS s FROM scored GROUP BY ALL",
        "by_chunk": f"SELECT query_ord, chunk, occur, ord, sum(s) * {inner} AS s FROM by_pos JOIN widths USING (query_ord, chunk) "
        "GROUP BY query_ord, chunk, occur, ord",
        "by_query": "SELECT query_ord, ord, sum(s) FILTER (occur <> 'must_not') AS s, count(*) FILTER (occur <> 'must_not') AS matched, "
        "count(*) FILTER (occur = 'must') AS n_must, count(*) FILTER (occur = 'must_not') AS n_not FROM by_chunk GROUP BY query_ord, ord",
        "scores": f"SELECT query_ord, ord, s * {coord} AS score FROM by_query JOIN shapes USING (query_ord) "
        "WHERE n_not = 0 AND n_must = musts AND matched > 0",
        "ranked": f"SELECT *, row_number() OVER (PARTITION BY query_ord ORDER BY {_SCORE_KEY} DESC, ord)::INTEGER AS rank, "
        "count(*) OVER (PARTITION BY query_ord) AS total_hits FROM scores",
        "hits": f"SELECT r.*, d.id AS doc_id, d.topic, d.body, q.id AS query_id, round(r.score, 6) AS rounded FROM ranked r "
        f"JOIN {documents} d ON d.ord = r.ord JOIN queries q ON q.ord = r.query_ord WHERE rank <= {k}",
        **(more or {}),
    }
    body = final or "SELECT query_id, rank, doc_id, rounded AS score, total_hits FROM hits"
    return with_ctes(body, *_mentioned(body, given), **given)


def _joined(tokens: str, documents: str, key: str) -> str:
    return (
        f"SELECT d.{key}, coalesce(t.tokens, '') AS tokens FROM {documents} d LEFT JOIN (SELECT ord, "
        f"string_agg(pos || ':' || term, ' ' ORDER BY pos, term) AS tokens FROM {tokens} GROUP BY ord) t ON t.ord = d.{key}"
    )


def _field_stats(name: str, select: str, order: str = "") -> str:
    """The same index fragment for both fields, with the field as a column."""
    parts = []
    for field, tokens in (("question", "tokens"), ("topic", "topic_tokens")):
        given = _index(tokens)
        parts.append(f"SELECT '{field}' AS field, {select} FROM ({with_ctes(f'SELECT * FROM {name}', name, **given)})")
    return " UNION ALL ".join(parts)


_TRIM = r"regexp_replace({}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"
_LINE_OK = "length(line) > 2"
_XML = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_RENDER = "'ID: ' || id || chr(10) || 'Topic: ' || topic || chr(10) || 'Body: ' || body || chr(10)"
_OPERATOR_BODY = "replace(replace(replace(text, ', ', ' AND '), '. ', ' NOT '), '.' || chr(10), ' OR OR ')"
_OPERATOR_BATCH = f"SELECT item_id AS ord, item_id::VARCHAR AS id, 'benchmark' AS topic, {_OPERATOR_BODY} AS body FROM benchmark"
_TWO_SIDED = (
    "SELECT item_id AS ord, item_id::VARCHAR AS id, 'benchmark' AS topic, concat_ws(' ', text, 'AND', "
    "string_split(text, ' ')[1], 'NOT', string_split(text, ' ')[2]) AS body FROM benchmark"
)
_DRAWS = "SELECT range AS draw, ('0x' || substr(md5('10:' || range), 1, 8))::BIGINT AS h FROM range(100)"
_UNION = (
    "SELECT ord, id, topic, body FROM corpus UNION ALL SELECT ord + (SELECT max(ord) + 1 FROM corpus) AS ord, id, topic, body FROM turns"
)
_UNION_WORDS = (
    f"SELECT ord, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS term FROM (SELECT ord, {words('body')} AS w FROM both_corpora)"
)
_UNION_TOKENS = f"SELECT * FROM both_words WHERE term NOT IN ({_STOP})"
_BOTH = {"both_corpora": _UNION, "both_words": _UNION_WORDS, "both_tokens": _UNION_TOKENS}
_CLAUSE_QUERY = {"queries": f"SELECT * FROM ({_OPERATOR_BATCH}) WHERE {_VALID}"}


def _phrase_rules() -> str:
    return with_ctes("SELECT DISTINCT input, output FROM phrase_rules", "bench_words", "phrase_rules", **_PHRASE_RULES)


def _union_field(field: str, column: str) -> str:
    tokens = f"SELECT ord, unnest({words(column)}) AS term FROM both_corpora "
    given = {**_BOTH, "field_words": tokens}
    return with_ctes(
        f"SELECT '{field}' AS field, term, count(DISTINCT ord) AS df, count(*) AS ttf FROM field_words "
        f"WHERE term NOT IN ({_STOP}) GROUP BY term",
        "field_words",
        **given,
    )


def _search_text() -> str:
    longest = "SELECT 0 AS ord, '0100' AS id, 'topic' AS topic, max_by(text, (length(text), item_id)) AS body FROM benchmark"
    return _search(4, queries=longest)


def questions_sql(lines: str) -> str:
    """Questions of numbered lines (file, line_no, value), by running counts of headers."""
    return f"""
WITH kept AS (SELECT *, strpos(value, '[') AS opening, strpos(value, ']') AS closing FROM {lines} WHERE length(value) > 2),
parsed AS (SELECT file, line_no, opening > 0 AND closing > 0 AS header, {_TRIM.format("value")} AS text,
    CASE WHEN opening > 0 AND closing > 0 THEN substr(value, opening + 1, closing - opening - 1) END AS id,
    CASE WHEN opening > 0 AND closing > 0 THEN {_TRIM.format("substr(value, closing + 1)")} END AS topic
  FROM kept WHERE NOT (opening > 0 AND closing > 0 AND closing < opening)),
counted AS (SELECT *, count(*) FILTER (id <> '') OVER run AS opened, last_value(CASE WHEN header THEN id <> '' END IGNORE NULLS) OVER run AS within
  FROM parsed WINDOW run AS (PARTITION BY file ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
owned AS (SELECT *, opened + CASE WHEN within THEN 0 ELSE 1 END AS number FROM counted),
questions AS (SELECT file, number, max(id) FILTER (id <> '') AS id, max(topic) FILTER (id <> '') AS topic,
    coalesce(string_agg(text, '' ORDER BY line_no) FILTER (NOT header), '') AS body
  FROM owned GROUP BY file, number HAVING count(*) FILTER (id <> '') > 0)
SELECT id, topic, body, row_number() OVER (ORDER BY file, number) - 1 AS ord FROM questions"""


# Documents as bracket text with everything a reader can stumble over, one numbered line a row.
_QUIRK_LINES = """
SELECT doc_id // 50 AS file, row_number() OVER (ORDER BY doc_id, n) AS line_no, value FROM (
  SELECT doc_id, generate_subscripts(l, 1) AS n, unnest(l) AS value FROM (SELECT doc_id, string_split_regex(
    CASE WHEN doc_id = 0 THEN 'leading text' || chr(10) ELSE '' END
    || CASE WHEN doc_id % 7 = 1 THEN '[]ghost' || chr(10) || ' ghost body ' || chr(10) ELSE '' END
    || '[' || doc_id || ']' || chr(1) || ' ' || lang || CASE WHEN doc_id % 5 = 2 THEN chr(9) || source || chr(2) ELSE '' END || chr(10)
    || CASE WHEN doc_id % 11 = 3 THEN '] wrong [ way ' || doc_id || chr(10) ELSE '' END
    || CASE WHEN doc_id % 13 = 4 THEN 'see [' || source || '] inside' || chr(10) ELSE '' END
    || text || CASE WHEN doc_id % 17 = 5 THEN chr(10) || 'ab' || chr(10) || '[] last ghost' || chr(10) || 'lost or carried on' ELSE '' END,
    '\r\n|\r|\n') AS l FROM documents))"""

# Synonym rules of two to four words that follow one another, each written apart and as one word.
_FOLLOWING = ", ".join(f"lead(term, {i}) OVER w AS w{i}" for i in range(4))
_PHRASE_RULES = {
    "phrase_words": f"SELECT item_id, pos, {_FOLLOWING} FROM bench_words WINDOW w AS (PARTITION BY item_id ORDER BY pos)",
    "phrase_pairs": " UNION ".join(
        f"SELECT {n} AS n, concat_ws(' ', {of}) AS apart, concat({of}) AS whole FROM phrase_words WHERE pos % {every} = 0 AND w{n - 1} IS NOT NULL"
        for n, every in ((2, 2), (3, 5), (4, 7))
        for of in [", ".join(f"w{i}" for i in range(n))]
    ),
    "phrase_rules": " UNION ".join(
        f"SELECT {i} AS input, {'n' if i == 'apart' else 1} AS len, {o} AS output FROM phrase_pairs"
        for i in ("apart", "whole")
        for o in ("apart", "whole")
    ),
}


def _phrases(prefix: str, words_table: str) -> dict[str, str]:
    """Fragments that expand a table (ord, pos, term): the longest rule at each place, the greedy choice from the left as
    a walk from each chosen match to the next, and what it gives."""
    spans = " UNION ALL ".join(
        f"SELECT ord, pos AS start, {n} AS len, concat_ws(' ', {', '.join(f'w{i}' for i in range(n))}) AS input FROM {prefix}_windows "
        f"WHERE w{n - 1} IS NOT NULL"
        for n in range(1, 5)
    )
    following = " ".join(f"WHEN lead(start, {i}) OVER w >= start + len THEN lead(start, {i}) OVER w" for i in range(1, 5))
    return {
        f"{prefix}_windows": f"SELECT ord, pos, {_FOLLOWING} FROM {words_table} WINDOW w AS (PARTITION BY ord ORDER BY pos)",
        f"{prefix}_spans": spans,
        f"{prefix}_candidates": f"SELECT ord, start, max(len) AS len, arg_max(input, len) AS input FROM {prefix}_spans "
        "JOIN (SELECT DISTINCT input, len FROM phrase_rules) USING (input, len) GROUP BY ord, start",
        f"{prefix}_steps": f"SELECT *, CASE {following} END AS following, row_number() OVER w AS nth FROM {prefix}_candidates "
        "WINDOW w AS (PARTITION BY ord ORDER BY start)",
        f"{prefix}_chosen": f"SELECT ord, start, len, input, following FROM {prefix}_steps WHERE nth = 1 UNION ALL "
        f"SELECT s.ord, s.start, s.len, s.input, s.following FROM {prefix}_chosen c JOIN {prefix}_steps s ON s.ord = c.ord AND s.start = c.following",
        f"{prefix}_outputs": f"SELECT DISTINCT ord, start, string_split(output, ' ') AS w FROM {prefix}_chosen c JOIN phrase_rules r ON r.input = c.input AND r.len = c.len",
        f"{prefix}_expanded": f"SELECT ord, start + generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS term FROM {prefix}_outputs UNION ALL "
        f"SELECT d.ord, d.pos, d.term FROM {words_table} d WHERE NOT EXISTS (SELECT 1 FROM {prefix}_chosen c WHERE c.ord = d.ord "
        "AND d.pos >= c.start AND d.pos < c.start + c.len)",
    }


_PHRASE_FRAGMENTS = _PHRASE_RULES | _phrases("doc", "doc_words") | {
    "phrase_tokens": f"SELECT ord, pos, term FROM doc_expanded WHERE term NOT IN ({_STOP})",
}
_PHRASE_SEARCH = _PHRASE_FRAGMENTS | _phrases("ask", "ask_words") | {
    "ask_words": "SELECT query_ord * 100000 + chunk AS ord, pos, term FROM chunk_words",
    "phrase_query_tokens": "SELECT ord // 100000 AS query_ord, (ord % 100000)::INTEGER AS chunk, pos, term FROM ask_expanded "
    f"WHERE term NOT IN ({_STOP})",
}


def oracle_sql() -> dict[str, str]:
    matched = _search(
        1,
        final="SELECT query_ord, chunk, pos, t.term, count(*) AS documents, sum(tf)::BIGINT AS tf, sum(dl)::BIGINT AS dl "
        "FROM terms t JOIN post p ON p.term = t.term JOIN lens l ON l.ord = p.ord GROUP BY query_ord, chunk, pos, t.term",
    )
    synonym_search = {"tokens": "syn_tokens", "query_tokens": "syn_query_tokens"}
    return {
        "read_questions": with_ctes(
            "SELECT doc_id::VARCHAR AS id, concat_ws(' ', lang, source) AS topic, coalesce(b.body, '') AS body, doc_id AS ord "
            f"FROM documents LEFT JOIN (SELECT doc_id, string_agg({_TRIM.format('line')}, '' ORDER BY n) AS body FROM lines "
            f"WHERE n > 1 AND {_LINE_OK} GROUP BY doc_id) b USING (doc_id)",
            "lines",
        ),
        "drop_short_lines": with_ctes(
            f"SELECT length(line)::INTEGER AS length, count(*) AS lines FROM lines WHERE {_LINE_OK} GROUP BY 1", "lines"
        ),
        "header_predicate": with_ctes(
            "SELECT contains(line, '[') AND contains(line, ']') AS header, count(*) AS lines FROM lines GROUP BY 1", "lines"
        ),
        "parse_header": "SELECT doc_id::VARCHAR AS id, concat_ws(' ', lang, source) AS topic FROM documents",
        "trim_lines": with_ctes(
            f"SELECT {_TRIM.format('line')} AS line, count(*) AS lines FROM lines WHERE n > 1 AND {_LINE_OK} GROUP BY 1", "lines"
        ),
        "question_count": "SELECT count(*) AS questions FROM documents",
        "read_synonyms": with_ctes("SELECT input, output FROM rules", "rules"),
        "read_phrase_synonyms": _phrase_rules(),
        "to_documents": with_ctes("SELECT ord, id AS doc_id, topic, body AS question FROM corpus", "corpus"),
        "render_question": with_ctes(f"SELECT id, {_RENDER} AS text FROM corpus", "corpus"),
        "render_doc_xml": with_ctes(
            "SELECT id, '<doc>' || chr(10) || "
            + " || ".join(
                f"""'<field name="{name}">' || {_XML.format(name)} || '</field>' || chr(10)""" for name in ("id", "topic", "body")
            )
            + " || '</doc>' || chr(10) AS xml FROM corpus",
            "corpus",
        ),
        "escape_query": with_ctes(
            r"""SELECT id, regexp_replace(body, '([\\+\-!():^\[\]"{}~*?|&/])', '\\\1', 'g') AS escaped FROM corpus""", "corpus"
        ),
        "report": _search(
            4,
            final=f"SELECT q.ord AS query_ord, 0 AS rank, 'Found ' || coalesce(h.total_hits, 0) || ' document(s) that matched query ''' "
            f"|| {_RENDER.replace('id ', 'q.id ').replace('topic ', 'q.topic ').replace('body ', 'q.body ')} || ''':' AS line "
            "FROM queries q LEFT JOIN (SELECT * FROM hits WHERE rank = 1) h ON h.query_ord = q.ord "
            "UNION ALL SELECT query_ord, rank, '(' || rank || ') [' || doc_id || '] ' || body AS line FROM hits ",
        ),
        "tokenize": f"SELECT doc_id, array_to_string(regexp_extract_all(text, '{TOKEN}'), ' ') AS tokens FROM documents",
        "lower_case": "SELECT doc_id, lower(text) AS text FROM documents",
        "remove_stopwords": with_ctes(
            "SELECT item_id, coalesce(tokens, '') AS tokens FROM benchmark LEFT JOIN (SELECT item_id, "
            "string_agg(pos || ':' || term, ' ' ORDER BY pos) AS tokens FROM bench_words "
            f"WHERE term NOT IN ({_STOP}) GROUP BY item_id) USING (item_id)",
            "bench_words",
        ),
        "standard_chain": with_ctes(_joined("tokens", "documents", "doc_id"), "tokens"),
        "nostop_chain": with_ctes(_joined("doc_words", "documents", "doc_id"), "doc_words"),
        "expand_synonyms": with_ctes(_joined("syn_words", "documents", "doc_id"), "syn_words"),
        "expand_phrase_synonyms": with_ctes(
            _joined("phrase_tokens", "documents", "doc_id"), "doc_words", "bench_words", "phrase_tokens", **_PHRASE_FRAGMENTS
        ).replace("WITH ", "WITH RECURSIVE ", 1),
        "read_quirky_questions": questions_sql(f"({_QUIRK_LINES})"),
        "rejected_lines": f"SELECT value FROM ({_QUIRK_LINES}) WHERE length(value) > 2 AND strpos(value, '[') > 0 AND strpos(value, ']') > 0 "
        "AND strpos(value, ']') < strpos(value, '[')",
        "synonym_chain": with_ctes(_joined("syn_tokens", "documents", "doc_id"), "syn_tokens"),
        "query_terms": with_ctes("SELECT * FROM query_tokens", "query_tokens", queries="SELECT * FROM batch"),
        "query_terms_with_synonyms": with_ctes("SELECT * FROM syn_query_tokens", "syn_query_tokens", queries="SELECT * FROM batch"),
        "query_term_frequency": with_ctes(
            "SELECT query_ord, term, count(*) AS qtf FROM query_tokens GROUP BY query_ord, term",
            "query_tokens",
            queries="SELECT * FROM batch",
        ),
        "valid_queries": f"SELECT id, body FROM ({_OPERATOR_BATCH}) WHERE {_VALID}",
        "long_queries_rejected": with_ctes(
            "SELECT id FROM corpus WHERE ord NOT IN (SELECT query_ord FROM query_tokens GROUP BY query_ord "
            f"HAVING count(DISTINCT chunk) > 1024) AND {_VALID}",
            "query_tokens",
            "corpus",
            queries="SELECT * FROM corpus",
        ),
        "postings": _field_stats("post", "term, ord, tf"),
        "positions": with_ctes(
            "SELECT term, ord, string_agg(pos, ',' ORDER BY pos) AS positions FROM tokens GROUP BY term, ord", "tokens"
        ),
        "term_vectors": with_ctes(
            "SELECT ord, string_agg(term || '=' || tf, ' ' ORDER BY term) AS terms FROM post GROUP BY ord", "post", **_index("tokens")
        ),
        "doc_lengths": _field_stats("lens", "ord, num_tokens, dl"),
        "synonym_doc_lengths": with_ctes(
            "SELECT 'question' AS field, ord, num_tokens, dl FROM lens", "lens", **_index("syn_tokens")
        ),
        "length_norm": with_ctes(
            f"SELECT ord, CASE WHEN dl > 0 THEN {_NORM} END AS norm, CASE WHEN dl > 0 THEN round(1 / sqrt(dl), 9) END AS exact_norm FROM lens",
            "lens",
            **_index("tokens"),
        ),
        "term_stats": _field_stats("tstats", "term, df, ttf"),
        "collection_stats": _field_stats("coll", "max_doc, sum_ttf, round(avgdl, 9) AS avgdl"),
        "index_count": "SELECT count(*) AS documents FROM documents",
        "write_index_overwrite": _field_stats("coll", "max_doc, sum_ttf, round(avgdl, 9) AS avgdl"),
        "write_index_append": f"SELECT * FROM ({_union_field('question', 'body')}) UNION ALL SELECT * FROM ({_union_field('topic', 'topic')})",
        "append_corpora": with_ctes("SELECT id, topic, body, ord FROM both_corpora", "both_corpora", **_BOTH),
        "read_index": with_ctes(
            "SELECT term, ord, count(*) AS tf, string_agg(pos, ',' ORDER BY pos) AS positions FROM tokens GROUP BY term, ord", "tokens"
        ),
        "match": matched,
        "with_stats": _search(
            1, final="SELECT query_ord, chunk, pos, term, df, ttf, max_doc, sum_ttf FROM terms CROSS JOIN coll"
        ),
        "score_accumulation": _search(1, final="SELECT query_ord, ord, round(score, 6) AS score FROM scores "),
        "total_hits": _search(1, final="SELECT query_ord, count(*) AS total_hits FROM scores GROUP BY query_ord"),
        "similarity_dispatch": with_ctes(
            "SELECT ord, "
            + ", ".join(f"round(sum({formula(sim)}), 5) AS sim{sim}" for sim in range(5))
            + f" FROM (SELECT p.*, df, ttf, coll.*, {_NORM} AS norm, 1 AS query_norm FROM post p JOIN tstats s ON s.term = p.term "
            "JOIN lens l ON l.ord = p.ord CROSS JOIN coll) GROUP BY ord",
            *_index("tokens"),
            **_index("tokens"),
        ),
        "search_vsm": _search(0),
        "search_bm25": _search(1),
        "search_lm_dirichlet": _search(2),
        "search_lm_jm_short": _search(3),
        "search_lm_jm_long": _search(4),
        "search_bm25_parameters": _search(1, k1=2.0, b=0.3),
        "search_exact_norms": _search(4, norm="1 / sqrt(dl)"),
        "search_top_ten": _search(4, k=10),
        "top_k": with_ctes(
            "SELECT query_ord, ord, rank, score FROM (SELECT topic AS query_ord, ord, row_number() OVER (PARTITION BY topic "
            "ORDER BY dl DESC, ord)::INTEGER AS rank, dl::DOUBLE AS score FROM lens JOIN corpus USING (ord)) WHERE rank <= 5",
            "lens",
            "corpus",
            **_index("tokens"),
        ),
        "fetch_fields": _search(4, final="SELECT query_id, rank, doc_id, topic, body AS question FROM hits "),
        "search_topic_field": _search(
            1,
            tokens="topic_tokens",
            queries="SELECT min(ord) AS ord, min(ord)::VARCHAR AS id, 'topic' AS topic, topic AS body FROM corpus GROUP BY corpus.topic",
        ),
        "search_with_synonyms": _search(4, **synonym_search),
        "search_vsm_with_synonyms": _search(0, **synonym_search),
        "search_with_phrase_synonyms": _search(
            1, tokens="phrase_tokens", query_tokens="phrase_query_tokens", more=_PHRASE_SEARCH
        ).replace("WITH ", "WITH RECURSIVE ", 1),
        "search_merged_index": _search(1, tokens="both_tokens", documents="both_corpora", more=_BOTH),
        "top_k_beyond_a_thousand": with_ctes(
            "SELECT ord, row_number() OVER (ORDER BY dl DESC, ord)::INTEGER AS rank FROM lens QUALIFY rank <= 1500", "lens", **_index("tokens")
        ),
        "search_stored_index": _search(4),
        "search_appended_index": _search(1, tokens="both_tokens", documents="both_corpora", more=_BOTH),
        "search_text": _search_text(),
        "assign_occur": with_ctes("SELECT query_ord, chunk, occur FROM clauses", "clauses", **_CLAUSE_QUERY),
        "boolean_match": _search(
            1, operators=True, queries=f"SELECT * FROM ({_TWO_SIDED}) WHERE {_VALID}", final="SELECT query_ord, ord FROM scores "
        ),
        "search_with_operators": _search(0, operators=True, queries=f"SELECT * FROM ({_TWO_SIDED}) WHERE {_VALID}"),
        "sample_queries": with_ctes(
            "SELECT id, topic, body, draw AS ord FROM drawn JOIN (SELECT *, row_number() OVER (ORDER BY ord) - 1 AS position FROM turns) "
            "ON position = h % (SELECT count(*) FROM turns)",
            "drawn",
            "turns",
            drawn=_DRAWS,
        ),
        "search_sampled_queries": _search(
            4,
            queries=f"SELECT draw AS ord, id, topic, body FROM ({_DRAWS}) JOIN (SELECT *, row_number() OVER (ORDER BY ord) - 1 AS position "
            "FROM batch) ON position = h % (SELECT count(*) FROM batch)",
            final="SELECT query_id, rank, doc_id, rounded AS score, total_hits, query_ord FROM hits ",
        ),
        "write_results": _search(
            4,
            final="SELECT concat_ws(',', q.id, string_agg(doc_id, ',' ORDER BY rank)) AS line FROM queries q "
            "LEFT JOIN hits h ON h.query_ord = q.ord GROUP BY q.ord, q.id",
        ),
        "write_xml": with_ctes("SELECT id, topic, body FROM corpus", "corpus"),
    }
