"""Value-type tests used by property type inference.

Every test is a native Spark expression, so a single aggregation pass over
(property, value) rows decides all types at once. The same tests are
written as DuckDB SQL in the oracle, so they are kept to trim/regex/cast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values (must equal the reference's rules) ------------------------
# Accepted boolean spellings (compared after trim + lower-case).
BOOLEAN_WORDS = ["true", "false", "yes", "no", "1", "0"]
# Property that is always typed String.
IP_PROPERTY = "locationIP"
EMPTY_TYPE = "Unknown (empty)"
MISSING_TYPE = "Unknown"
# PG-Schema type names.
PG_TYPES = {"string": "STRING", "int": "INT", "int32": "INT32", "integer": "INTEGER",
            "date": "DATE", "double": "DOUBLE", "boolean": "BOOLEAN"}
# XSD type names.
XSD_TYPES = {"string": "xs:string", "int": "xs:integer", "integer": "xs:integer",
             "int32": "xs:integer", "double": "xs:decimal", "boolean": "xs:boolean",
             "date": "xs:date"}
# -----------------------------------------------------------------------------

# Grammar of a JVM double literal: sign, NaN / Infinity, decimal with optional
# exponent, or hexadecimal with binary exponent; optional f/F/d/D suffix.
DOUBLE_REGEX = (
    r"^[+-]?(NaN|Infinity|(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
    r"|0[xX]([0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)[pP][+-]?[0-9]+)[fFdD]?)$"
)
INTEGER_REGEX = r"^[+-]?[0-9]+$"
IP_REGEX = r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$"
LENIENT_DATE_REGEX = r"^-?[0-9]"
STRICT_DATE_REGEXES = [
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$",
    r"^[0-9]{2}-[0-9]{2}-[0-9]{4}$",
    r"^[0-9]{4}/[0-9]{2}/[0-9]{2}$",
    r"^[0-9]{4}$",
    r"^[0-9]{4}/[0-9]{2}$",
    r"^[0-9]{2}/[0-9]{4}$",
]


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def _trimmed(v) -> Column:
    """Without spaces and control characters at both ends; only texts that have some are trimmed."""
    c = _c(v)
    padded = (c < "!") | (F.substring(c, -1, 1) < "!")
    return F.when(padded, F.btrim(c, F.lit("".join(map(chr, range(0x21)))))).otherwise(c)


# Texts are compared by their bytes, so these look at one character and are far
# cheaper than a pattern: most values fail a test on it.
def _starts_between(t: Column, low: str, high: str) -> Column:
    return (t >= low) & (t < chr(ord(high) + 1))


def _is_digit(char: Column) -> Column:
    return char.between("0", "9")


def is_integer(v) -> Column:
    """32-bit integer after trim (sign allowed, no decimals or exponent)."""
    return _is_integer(_trimmed(v))


def _is_integer(t: Column) -> Column:
    # The cast of a text that is no number costs an exception, so the pattern comes first.
    as_long = F.when(_starts_between(t, "+", "9") & t.rlike(INTEGER_REGEX), t.try_cast("bigint"))
    return F.coalesce(as_long.between(-2147483648, 2147483647), F.lit(False))


def is_double(v) -> Column:
    """JVM double literal after trim."""
    return _is_double(_trimmed(v))


def _is_double(t: Column) -> Column:
    may = _starts_between(t, "+", "9") | _starts_between(t, "I", "N")
    return F.coalesce(may & t.rlike(DOUBLE_REGEX), F.lit(False))


def is_date(v, mode: str = "lenient") -> Column:
    """Date test.

    ``lenient`` mirrors a lenient prefix parse: any text
    whose trimmed form starts with an (optionally negative) number passes.
    ``strict`` accepts only values of the form of a whole date (STRICT_DATE_REGEXES).
    """
    return _is_date(_trimmed(v), mode)


def _is_date(t: Column, mode: str) -> Column:
    if mode == "lenient":
        cond = _starts_between(t, "0", "9") | (t.startswith("-") & _is_digit(F.substring(t, 2, 1)))
    elif mode == "strict":
        cond = _starts_between(t, "0", "9") & t.rlike("|".join(STRICT_DATE_REGEXES))
    else:
        raise ValueError(f"unknown date mode {mode!r}")
    return F.coalesce(cond, F.lit(False))


def is_boolean(v) -> Column:
    return _is_boolean(_trimmed(v))


def _is_boolean(t: Column) -> Column:
    return F.coalesce((F.octet_length(t) <= 32) & F.lower(t).isin(BOOLEAN_WORDS), F.lit(False))


# One to three digits with value <= 255 (leading zeros allowed, as an integer parse does).
OCTET = r"([0-9]{1,2}|[01][0-9]{2}|2[0-4][0-9]|25[0-5])"
IP_OCTETS_REGEX = rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"


def is_ip(v) -> Column:
    """Dotted quad, each part 0..255, on the untrimmed text (a part with
    surrounding spaces does not parse). One anchored regex, so the test stays
    in generated code."""
    return _is_ip(_c(v))


def _is_ip(c: Column) -> Column:
    may = _starts_between(c, "0", "9") & (F.octet_length(c) <= 18)     # of a final line end, too
    return F.coalesce(may & c.rlike(IP_OCTETS_REGEX), F.lit(False))


TESTS = ("all_ip", "all_int", "all_double", "all_date", "all_bool")


def tested(rows: DataFrame, value: str, date_mode: str, keys: list[str], *aggs: Column) -> DataFrame:
    """Rows grouped by ``keys``: ``aggs``, whether all values that are not null pass
    each test (TESTS, null without any value) and ``n_values``, how many there are.

    A value is trimmed once and its tests are the bits of one number, so the
    generated code of a row stays small enough to be compiled.
    """
    v, t = F.col(value), F.col("_t")
    bits = F.lit(0)
    for i, test in enumerate((_is_ip(v), _is_integer(t), _is_double(t), _is_date(t, date_mode), _is_boolean(t))):
        bits = bits.bitwiseOR(F.when(test, F.lit(1 << i)).otherwise(F.lit(0)))
    seen = rows.withColumn("_t", _trimmed(value)).select(*keys, *[c for c in rows.columns if c not in (*keys, value)],
                                                         F.when(v.isNotNull(), bits).alias("_bits"))
    out = seen.groupBy(*keys).agg(*aggs, F.bit_and("_bits").alias("_all"), F.count("_bits").alias("n_values"))
    flags = [(F.col("_all").bitwiseAND(F.lit(1 << i)) != 0).alias(name) for i, name in enumerate(TESTS)]
    return out.select(*[c for c in out.columns if c not in ("_all", "n_values")], *flags, "n_values")


def pg_type(type_name) -> Column:
    """Inferred type name -> PG-Schema type (unknown -> STRING)."""
    t = F.lower(F.trim(_c(type_name)))
    out = F.lit("STRING")
    for k, val in reversed(list(PG_TYPES.items())):
        out = F.when(t == k, F.lit(val)).otherwise(out)
    return out


def xsd_type(type_name) -> Column:
    """Inferred type name -> XSD type (unknown -> xs:string)."""
    t = F.lower(F.trim(_c(type_name)))
    out = F.lit("xs:string")
    for k, val in reversed(list(XSD_TYPES.items())):
        out = F.when(t == k, F.lit(val)).otherwise(out)
    return out
