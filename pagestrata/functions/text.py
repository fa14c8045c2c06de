"""Scalar text, digest and rounding functions (all stay in the JVM)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters a trim removes: ASCII and Unicode spaces, line separators and the byte order mark.
SPACES = (
    "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def record(**fields: Column) -> Column:
    """A struct with explicit field names; unlike aliases they also survive next to a generator."""
    return F.named_struct(*[part for name, value in fields.items() for part in (F.lit(name), value)])


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are worked out exactly once per row.

    The optimizer copies a projected expression into every filter above it; the output of a
    generator is never copied, so expensive expressions that are filtered on pass through one.
    """
    out = df.withColumn("_pinned", F.explode_outer(F.array(record(**columns))))
    return out.withColumns({name: F.col(f"_pinned.{name}") for name in columns}).drop("_pinned")


def trim_spaces(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def clean_text(text: Column) -> Column:
    """Unix line ends, single spaces, no spaces around line ends, at most one blank line, trimmed.

    Every pattern matches only what changes, so clean text passes through without being rebuilt.
    """
    text = F.coalesce(text, F.lit(""))
    unix = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    steps = [(r"[\t\f\x0B][\t\f\x0B ]*| [\t\f\x0B ]+", " "), (r" \n ?|\n ", "\n"), (r"\n{3,}", "\n\n")]
    return trim_spaces(reduce(lambda t, step: F.regexp_replace(t, step[0], step[1]), steps, unix))


def collapse_text(text: Column) -> Column:
    """Every run of whitespace becomes one space (text as a rendered page shows it)."""
    return trim_spaces(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACES}]+", " "))


def sha256(value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(value, 256))


def stable_id(prefix: str, *values: Column) -> Column:
    """``<prefix>_`` and 16 hex digits of the digest of the values as a compact JSON array."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.to_json(F.array(*values)), 256), 1, 16))


def json_digest(value: Column) -> Column:
    """Digest of a struct as JSON with its null fields kept."""
    return sha256(F.to_json(value, {"ignoreNullFields": "false"}))


def sections_digest(sections: Column) -> Column:
    """Content identity of a page: every section as heading and text, one per line."""
    lines = F.transform(sections, lambda s: F.concat(s["heading"], F.lit("\n"), s["text"]))
    return sha256(F.array_join(lines, "\n"))


def round1(value: Column) -> Column:
    """One decimal, halves up."""
    return F.floor(value * 10 + 0.5) / F.lit(10.0)


def clamp_score(value: Column) -> Column:
    """A score in 0..100 with one decimal; missing and non-finite values count as 0."""
    number = value.cast("double")
    broken = number.isNull() | F.isnan(number) | (F.abs(number) == F.lit(float("inf")))
    return F.when(broken, 0.0).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), round1(F.when(broken, 0.0).otherwise(number))))
    )


def ordered_distinct(values: Column) -> Column:
    """First-seen order, without nulls and empty strings."""
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))


def strip_markup(source: Column) -> Column:
    """Component source as plain text: comments, tags and expressions become spaces."""
    steps = [
        (r"(?s)\{/\*.*?\*/\}", " "), (r"<[^>]+>", " "), (r"\{[^{}]*\}", " "),
        (r"(?i)&nbsp;", " "), (r"(?i)&amp;", "&"), (r"(?i)&lt;", "<"), (r"(?i)&gt;", ">"),
        (r"(?i)&quot;", '"'), (r"(?i)&#39;", "'"),
    ]
    return clean_text(reduce(lambda t, step: F.regexp_replace(t, step[0], step[1]), steps, source))


def escape_markdown(text: Column) -> Column:
    """A table cell: bars escaped, line ends become spaces, null becomes empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def script_safe_json(json: Column) -> Column:
    """JSON that can stand inside a script element."""
    for character, escaped in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e")):
        json = F.replace(json, F.lit(character), F.lit(escaped))
    return json


def counts_text(counts: Column) -> Column:
    """``source: count`` pairs of a map in key order, or ``none``."""
    entries = F.transform(
        F.array_sort(F.map_entries(counts)),
        lambda e: F.concat(e["key"], F.lit(": "), e["value"].cast("string")),
    )
    return F.when(F.size(counts) > 0, F.array_join(entries, ", ")).otherwise("none")


def archive_time(stamp: Column) -> Column:
    """A 14-digit archive stamp as a timestamp; anything else is null."""
    valid = F.when(stamp.rlike(r"\A[0-9]{14}\z"), stamp)
    return F.try_to_timestamp(valid, F.lit("yyyyMMddHHmmss"))


def iso_time(moment: Column) -> Column:
    """A timestamp as ISO-8601 text in UTC with milliseconds."""
    return F.date_format(F.to_utc_timestamp(moment, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
