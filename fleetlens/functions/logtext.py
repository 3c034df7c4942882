"""Log line expressions: syslog lines, duration messages, key=value messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.functions.binding import let
from fleetlens.functions.text import trim_space

# --- fixed values: patterns -----------------------------------------------
_SYSLOG = (
    r"\d+ <\d+>\d+ (.*) host app (\w+(?:\.|-)\w+) -"
    r"[\t\n\f\r ]?\[?(\w+)?\]?"
    r"[\t\n\f\r ]?\[?(\d+)?(?:-\d+)?\]? (.*)"
)
# Anchored form: the whole line is replaced by its five fields.
SYSLOG_LINE = rf"(?d)^.*?{_SYSLOG}"
_S = r"[\t\n\f\r ]"
SLOW_QUERY = (
    rf"(?d)sql_error_code = (\d+){_S}*(.*){_S}*LOG:{_S}+duration:{_S}+(\d+\.\d+) ms"
    rf"{_S}+execute <\w+>: (.*)"
)
# Captured groups hold no line feed, so the whole match can be rewritten to its fields.
SLOW_QUERY_WHOLE = SLOW_QUERY.replace("(?d)", r"(?d)^[\s\S]*?", 1) + r"[\s\S]*$"
SLOW_QUERY_HINT = "duration:"
RFC3339 = (
    r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:\d{2})$"
)
SAMPLE_PREFIX = "sample#"


def syslog_line(line: Column) -> Column:
    """Struct of the five syslog fields, NULL when the line does not match.

    A line never holds a line feed, so it is a safe separator and the whole
    line costs a single regex evaluation.
    """
    joined = F.regexp_replace(line, SYSLOG_LINE, "$1\n$2\n$3\n$4\n$5")
    return let(
        F.split(joined, "\n"),
        lambda fields: F.when(
            F.size(fields) == 5,
            F.struct(
                fields[0].alias("timestamp"),
                fields[1].alias("process"),
                fields[2].alias("color"),
                fields[3].alias("segment"),
                fields[4].alias("message"),
            ),
        ),
    )


def log_timestamp(text: Column, fallback_epoch: Column) -> Column:
    """RFC 3339 text to Unix seconds; anything else takes the fallback."""
    parsed = F.when(F.rlike(text, F.lit(RFC3339)), F.try_to_timestamp(F.replace(text, F.lit(","), F.lit("."))))
    return F.coalesce(F.floor(F.unix_micros(parsed) / F.lit(1000000)).cast("bigint"), fallback_epoch)


def slow_query_line(message: Column) -> Column:
    """Code, metadata, duration and statement of a duration message, else NULL."""
    fields = let(
        trim_space(message),
        lambda text: F.when(
            F.rlike(text, F.lit(SLOW_QUERY)),
            F.split(F.regexp_replace(text, SLOW_QUERY_WHOLE, "$1\n$2\n$3\n$4"), "\n"),
        ),
    )
    parsed = let(
        fields,
        lambda f: F.when(
            f.isNotNull(),
            F.struct(
                f[0].alias("sql_error_code"),
                trim_space(f[1]).alias("metadata"),
                f[2].try_cast("double").alias("duration_ms"),
                f[3].alias("raw"),
            ),
        ),
    )
    # Most messages fail the substring test, which is far cheaper than the regex.
    return F.when(F.contains(message, F.lit(SLOW_QUERY_HINT)), parsed)


def key_values(message: Column, timestamp_epoch: Column) -> Column:
    """Map of the ``key=value`` tokens of a message, plus ``timestamp``.

    Tokens that do not split into exactly two parts are dropped, the sample
    prefix is removed from keys, and the last of duplicate keys wins.
    """
    tokens = F.filter(
        F.transform(
            F.filter(F.split(message, r"\p{IsWhite_Space}+"), lambda t: F.octet_length(t) >= 2),
            lambda t: F.split(t, "="),
        ),
        lambda kv: F.size(kv) == 2,
    )
    pairs = F.transform(
        tokens,
        lambda kv: F.struct(
            F.replace(kv[0], F.lit(SAMPLE_PREFIX), F.lit("")).alias("key"), kv[1].alias("value")
        ),
    )
    stamped = F.transform(
        F.concat(
            F.array(
                F.struct(
                    F.lit("timestamp").alias("key"), timestamp_epoch.cast("string").alias("value")
                )
            ),
            pairs,
        ),
        lambda kv, i: F.struct(kv["key"].alias("key"), i.alias("at"), kv["value"].alias("value")),
    )
    last_wins = let(
        F.sort_array(stamped),
        lambda kvs: F.filter(
            kvs,
            lambda kv, i: (i + 1 == F.size(kvs)) | (F.get(kvs, i + 1)["key"] != kv["key"]),
        ),
    )
    return F.map_from_entries(
        F.transform(
            last_wins, lambda kv: F.struct(kv["key"].alias("key"), kv["value"].alias("value"))
        )
    )


def conninfo_value(conninfo: Column, key: str) -> Column:
    """Value of the last ``key=...`` word of a connection string, '' when absent."""
    words = F.filter(
        F.transform(F.split(conninfo, " "), lambda w: F.split(w, "=")),
        lambda kv: (F.size(kv) > 1) & (kv[0] == key),
    )
    return F.coalesce(F.try_element_at(words, F.lit(-1))[1], F.lit(""))
