"""Text helpers: label keys, XML/IRI-safe names, N-Quads literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def label_key(labels) -> Column:
    """Canonical label-set text: distinct labels, sorted, joined by ':'.

    Null counts as no label. A ':' inside a label is written '\\:', so label
    sets never share a text.
    """
    known = F.coalesce(_c(labels), F.array().cast("array<string>"))
    return joined(F.sort_array(F.array_distinct(known)), ":")


def joined(parts: Column, sep: str) -> Column:
    """Parts joined by ``sep``; parts that hold it, or a backslash, have both
    escaped by a backslash. Only those rows pay for the escaping."""
    plain = F.array_join(parts, sep)
    seps = F.length(plain) - F.length(F.replace(plain, F.lit(sep), F.lit("")))
    odd = (seps > F.greatest(F.size(parts) - 1, F.lit(0))) | plain.contains("\\")
    escaped = F.array_join(F.transform(parts, lambda x: F.replace(
        F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit(sep), F.lit("\\" + sep))), sep)
    return F.when(odd, escaped).otherwise(plain)


def split_key(key) -> Column:
    """The labels of a :func:`label_key` text."""
    parts = F.regexp_extract_all(_c(key), F.lit(r"((?:[^\\:]|\\.)+)"), F.lit(1))
    return F.transform(parts, lambda x: F.regexp_replace(x, r"\\(.)", "$1"))


def safe_name(name) -> Column:
    """Name usable as an XML name: letters of any script, digits, ``_.-``."""
    return F.regexp_replace(_c(name), r"[^\p{L}\p{Nd}_.\-]", "_")


def iri_segment(name) -> Column:
    """Percent-encoded IRI path segment; distinct names stay distinct."""
    return F.replace(F.url_encode(_c(name)), F.lit("+"), F.lit("%20"))


def nquad_literal(value) -> Column:
    """Quoted N-Quads literal with backslash, quote, CR and LF escaped."""
    v = _c(value)
    for search, repl in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        v = F.replace(v, F.lit(search), F.lit(repl))  # literal replace, no regex
    return F.concat(F.lit('"'), v, F.lit('"'))
