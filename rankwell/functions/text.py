"""Text column functions: tokens, stop words, trimming, escaping, rendering.

Everything here is a built-in Spark expression; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 33 English stop words of the standard analysis chain.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they "
    "this to was will with"
).split()

# Character classes of the word-break rules.
_LETTER = r"\p{L}\p{M}"
_DIGIT = r"\p{Nd}"
_WORD = rf"{_LETTER}{_DIGIT}"
_LETTER_JOINER = r"[.':·’]"
_DIGIT_JOINER = r"[.,;'’]"

# A token is a run of letters, digits and underscores holding at least one letter or digit; a joiner continues the
# run only between two letters or between two digits. Every repeat is possessive, so java.util.regex loops instead of
# recursing (a megabyte-long run cannot overflow the stack), and the leading look-behind stops a long underscore rule
# from being rescanned at each of its positions.
TOKEN_PATTERN = (
    rf"(?<!_)_*+[{_WORD}][{_WORD}_]*+"
    rf"(?:(?:(?<=[{_LETTER}]){_LETTER_JOINER}(?=[{_LETTER}])|(?<={_DIGIT}){_DIGIT_JOINER}(?={_DIGIT}))"
    rf"[{_WORD}][{_WORD}_]*+)*+"
)

# The characters that separate query chunks, and those that are query syntax.
CHUNK_SEPARATOR = "[ \\t\\r\\n\\u3000]+"
SYNTAX_CHARACTERS = r"""\ + - ! ( ) : ^ [ ] " { } ~ * ? | & /""".split()

_CONTROL_EDGES = r"^[\x00-\x20]+|[\x00-\x20]+$"


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def lower(column: Column | str) -> Column:
    """Lower-case one character at a time.

    Spark's ``lower`` applies two context rules that per-character lower-casing does not (final sigma, dotted capital
    I); both letters are replaced first, so the rules never fire.
    """
    return F.lower(F.replace(F.replace(_col(column), F.lit("İ"), F.lit("i")), F.lit("Σ"), F.lit("σ")))


def tokenize(column: Column | str) -> Column:
    """Word-break tokens, case kept: ``ARRAY<STRING>``."""
    return F.regexp_extract_all(_col(column), F.lit(TOKEN_PATTERN), F.lit(0))


def positioned(tokens: Column | str) -> Column:
    """``ARRAY<STRING>`` -> ``ARRAY<STRUCT<pos, term>>``."""
    return F.transform(_col(tokens), lambda term, pos: F.struct(pos.cast("int").alias("pos"), term.alias("term")))


def remove_stopwords(tokens: Column | str, stop: list[str] = STOP_WORDS) -> Column:
    """Drop stop words from positioned tokens; the others keep their positions, so gaps stay visible."""
    return F.filter(_col(tokens), lambda token: ~token["term"].isin(list(stop)))


def trim_control(column: Column | str) -> Column:
    """Strip every character up to U+0020 from both ends (Spark's ``trim`` strips blanks only)."""
    return F.regexp_replace(_col(column), _CONTROL_EDGES, "")


def query_chunks(column: Column | str) -> Column:
    """Whitespace-separated pieces of a query, in order, without empty ones."""
    return F.array_remove(F.split(_col(column), CHUNK_SEPARATOR), "")


def escape_query(column: Column | str) -> Column:
    """Put a backslash before every query-syntax character."""
    members = "".join("\\" + character for character in SYNTAX_CHARACTERS)
    return F.regexp_replace(_col(column), f"([{members}])", r"\\$1")


def is_header(column: Column | str) -> Column:
    """A line is a header when it holds both brackets, wherever they stand."""
    return (F.instr(_col(column), "[") > 0) & (F.instr(_col(column), "]") > 0)


def parse_header(column: Column | str) -> Column:
    """Header line -> ``STRUCT<id, topic, reject>``.

    A closing bracket before the opening one gives no id; such a line comes back whole in ``reject``.
    """
    line = _col(column)
    left, right = F.instr(line, "["), F.instr(line, "]")
    good = (left > 0) & (left < right)
    return F.struct(
        F.when(good, F.substring(line, left + 1, right - left - 1)).alias("id"),
        F.when(good, trim_control(F.substring(line, right + 1, F.length(line)))).alias("topic"),
        F.when(~good & is_header(line), line).alias("reject"),
    )


def long_enough(column: Column | str, min_len: int = 3) -> Column:
    """At least ``min_len`` UTF-16 units (a character beyond the basic plane counts twice)."""
    line = _col(column)
    wide = F.length(line) - F.length(F.regexp_replace(line, r"[\x{10000}-\x{10FFFF}]", ""))
    return F.when(F.length(line) >= min_len, F.lit(True)).otherwise(F.length(line) + wide >= min_len)


def render_question(id_: Column | str, topic: Column | str, body: Column | str) -> Column:
    """Three labelled lines."""
    return F.concat(
        F.lit("ID: "), _col(id_), F.lit("\nTopic: "), _col(topic), F.lit("\nBody: "), _col(body), F.lit("\n")
    )


def escape_xml(column: Column | str) -> Column:
    """Escape the characters that XML text cannot hold."""
    text = F.replace(_col(column), F.lit("&"), F.lit("&amp;"))
    text = F.replace(text, F.lit("<"), F.lit("&lt;"))
    return F.replace(text, F.lit(">"), F.lit("&gt;"))


def render_doc_xml(id_: Column | str, topic: Column | str, body: Column | str) -> Column:
    """One ``<doc>`` element with id, topic and body fields, one per line."""
    parts = [F.lit("<doc>\n")]
    for name, column in (("id", id_), ("topic", topic), ("body", body)):
        parts += [F.lit(f'<field name="{name}">'), escape_xml(column), F.lit("</field>\n")]
    return F.concat(*parts, F.lit("</doc>\n"))
