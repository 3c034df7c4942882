"""SQL text expressions: comments, redaction, obfuscation, fingerprints.

All expressions are native Catalyst columns.  Patterns are written for the Java
regex engine so that they match what an RE2 engine would:

* ``(?d)`` makes ``.`` exclude only the line feed,
* case is folded by explicit classes (k and s also have one non-ASCII form each), which is
  exact where Java's Unicode flag is not, and several times faster than a flag,
* a lookahead on the first character rejects most positions before the alternatives,
* white space is spelled ``[\\t\\n\\f\\r ]`` and ASCII word boundaries as lookbehind,
* the open-ended list repetition is possessive and non-capturing: a repeated
  capturing group recurses once per tuple in Java and overflows the stack on a
  long VALUES list.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.functions.binding import let

# --- fixed values: markers and limits -------------------------------------
MISSING_TEXT = "MISSING"
REDACTED = "REDACTED"
TRUNCATED = "TRUNCATED"
QUERY_BYTES = 5000
COMMENT_BYTES = 1000
FINGERPRINT_CHARS = 10

# The comment by which a collector marks its own statements.  A deployment passes
# the tag its collector writes.
COLLECTOR_TAG = "/* app:fleet-collector */"

# --- fixed values: patterns -----------------------------------------------
_S = r"[\t\n\f\r ]*"
IP_ADDRESS = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"
COMMENT = r"(?:/\*)+?[\w\W]+?(?:\*/)+"

_QUOTED = r"'[^']+'"
_NUMBER = r"\d+\.?\d*"
_BIND = r"\$\d+"
_PARAM = rf"(?:{_S}{_QUOTED}|{_NUMBER}|{_BIND})"
_VALUE = rf"(?:{_QUOTED}|{_NUMBER}|{_BIND})"


def _any_case(word: str) -> str:
    """Pattern of a lower-case word in any case, with the simple Unicode folds."""
    folds = {"k": "\u212a", "s": "\u017f"}
    return "".join(f"[{c}{c.upper()}{folds.get(c, '')}]" if c.isalpha() else c for c in word)


_OPERATORS = "|".join(
    ["=", ">", "<", _any_case("i") + "?" + _any_case("like")]
    + [_any_case(w) for w in ("limit", "select", "offset", "then")]
)
OPERATOR_PARAM = rf"(?=[=><iIlLsSoOtT\u017f])((?:{_OPERATORS}){_S}){_PARAM}"

_SAME_LINE = r"[\t\f\r ]*"
_NEXT_LINE = rf"{_SAME_LINE}\n{_S}"
# A tuple that ends in a quote, or else the shortest one.  If no quote closes a tuple any more on a
# line, none will later on that line; so a line is a run of the first kind, then one of the second.
_QUOTED_TUPLE = r"\(.+?'\)"
_PLAIN_TUPLE = r"\(.+?\)"
_LINE_OF_TUPLES = (
    rf"(?:{_QUOTED_TUPLE}(?:,{_SAME_LINE}{_QUOTED_TUPLE})*+(?:,{_SAME_LINE}{_PLAIN_TUPLE})*+"
    rf"|{_PLAIN_TUPLE}(?:,{_SAME_LINE}{_PLAIN_TUPLE})*+)"
)
_WORD_START = r"(?<![0-9A-Za-z_])"
LIST_PARAM = (
    rf"(?d)(?=[iIvV]){_WORD_START}((?:{_any_case('in')}|{_any_case('values')}){_S})"
    rf"{_LINE_OF_TUPLES}(?:,{_NEXT_LINE}{_LINE_OF_TUPLES})*+"
)
BETWEEN_PARAM = (
    rf"(?=[bB]){_WORD_START}({_any_case('between')}(?:{_S}{_any_case('symmetric')})?{_S}){_VALUE}"
    rf"({_S}{_any_case('and')}{_S}){_VALUE}"
)

EXPLAIN_LINE = rf"{_any_case('cond')}:|{_any_case('filter')}:"
EXPLAIN_PARAM = rf"((?:=|>|<|~~|{_any_case('any')} \(){_S}){_PARAM}"

_SPACE_RUN = r"\p{IsWhite_Space}+"
_ASCII_SPACE_RUN = r"[\t-\r ]+"
_SPACE_EDGES = r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$"


def trim_space(text: Column) -> Column:
    """Strip Unicode white space from both ends."""
    return F.regexp_replace(text, _SPACE_EDGES, "")


def clean_query(text: Column) -> Column:
    """Collapse every run of Unicode white space to one space and trim.

    Text without multi-byte characters takes the much cheaper ASCII class.
    """
    ascii_only = F.octet_length(text) == F.char_length(text)
    collapsed = F.when(ascii_only, F.regexp_replace(text, _ASCII_SPACE_RUN, " ")).otherwise(
        F.regexp_replace(text, _SPACE_RUN, " ")
    )
    return F.trim(collapsed)


def redact_ip(text: Column) -> Column:
    return F.regexp_replace(text, IP_ADDRESS, REDACTED)


def truncate_bytes(text: Column, limit: int) -> Column:
    """Cut text longer than ``limit`` bytes and append the truncation marker.

    The cut moves back to a character boundary, so a split multi-byte character
    is dropped whole.
    """
    raw = text.cast("binary")

    def continues(position: int) -> Column:
        byte = F.substring(raw, position, 1)
        return (byte >= F.lit(b"\x80")) & (byte < F.lit(b"\xc0"))

    keep = (
        F.when(~continues(limit + 1), limit)
        .when(~continues(limit), limit - 1)
        .when(~continues(limit - 1), limit - 2)
        .otherwise(limit - 3)
    )
    head = F.substr(raw, F.lit(1), keep).cast("string")
    return F.when(F.octet_length(text) > limit, F.concat(head, F.lit(TRUNCATED))).otherwise(text)


def truncate_query(text: Column, max_bytes: int | None = QUERY_BYTES) -> Column:
    return text if max_bytes is None else truncate_bytes(text, max_bytes)


def _comments(text: Column) -> Column:
    # The substring test is far cheaper than the regex and most texts fail it.
    return F.when(
        F.contains(text, F.lit("/*")), F.regexp_extract_all(text, F.lit(COMMENT), F.lit(0))
    ).otherwise(F.array().cast("array<string>"))


def _remove_first(text: Column, part: Column) -> Column:
    at = F.position(part, text)
    return F.when(at == 0, text).otherwise(
        F.concat(
            F.substr(text, F.lit(1), at - 1),
            F.substr(text, at + F.char_length(part)),
        )
    )


def all_comments(text: Column) -> Column:
    """All ``/*...*/`` comments joined without separator."""
    return F.array_join(_comments(text), "")


def query_comment(text: Column, max_bytes: int | None = COMMENT_BYTES) -> Column:
    """All comments, capped in bytes; ``None`` leaves them whole."""
    return all_comments(text) if max_bytes is None else truncate_bytes(all_comments(text), max_bytes)


def strip_comments(text: Column) -> Column:
    """Text without its comments, trimmed only if there was one."""
    stripped = let(
        F.regexp_extract_all(text, F.lit(COMMENT), F.lit(0)),
        lambda comments: F.when(
            F.size(comments) > 0, trim_space(F.aggregate(comments, text, _remove_first))
        ).otherwise(text),
    )
    return F.when(F.contains(text, F.lit("/*")), stripped).otherwise(text)


def is_collector_comment(comment: Column, tag: str = COLLECTOR_TAG) -> Column:
    return F.contains(comment, F.lit(tag))


def obfuscate_query(text: Column) -> Column:
    """Replace literals and bind parameters by ``?`` (operators, lists, BETWEEN)."""
    text = F.regexp_replace(text, OPERATOR_PARAM, "$1?")
    text = F.regexp_replace(text, LIST_PARAM, "$1(?)")
    return F.regexp_replace(text, BETWEEN_PARAM, "$1?$2?")


def obfuscate_explain(plan: Column) -> Column:
    """Replace literals on the condition and filter lines of a plan text."""
    lines = F.transform(
        F.split(plan, "\n"),
        lambda line: F.when(
            F.rlike(line, F.lit(EXPLAIN_LINE)), F.regexp_replace(line, EXPLAIN_PARAM, "$1?")
        ).otherwise(line),
    )
    return F.array_join(lines, "\n")


def fingerprint(obfuscated: Column) -> Column:
    """First ten hexadecimal digits of the md5 of obfuscated, cleaned text."""
    return F.substring(F.md5(obfuscated.cast("binary")), 1, FINGERPRINT_CHARS)
