"""Value tests and type rules (INF1-6) on the typing frame of FIXTURES.md."""

import pytest
from pyspark.sql import functions as F

from graphsift.functions import typing as ty
from graphsift.operators.infer import infer_property_types

# value -> (integer, double, lenient date, boolean, ip)
CASES = {
    "1": (True, True, True, True, False),
    "+5": (True, True, False, False, False),
    "007": (True, True, True, False, False),
    "2147483648": (False, True, True, False, False),
    "-0": (True, True, True, False, False),
    "1e5": (False, True, True, False, False),
    "1d": (False, True, True, False, False),
    "NaN": (False, True, False, False, False),
    "nan": (False, False, False, False, False),
    "inf": (False, False, False, False, False),
    "Infinity": (False, True, False, False, False),
    "0x1p3": (False, True, True, False, False),
    "3abc": (False, False, True, False, False),
    "-3abc": (False, False, True, False, False),
    "+3abc": (False, False, False, False, False),
    ".5x": (False, False, False, False, False),
    "12.5": (False, True, True, False, False),
    "true": (False, False, False, True, False),
    "YES": (False, False, False, True, False),
    "1.2.3.4": (False, False, True, False, True),
    "1.2.3.400": (False, False, True, False, False),
    " 7 ": (True, True, True, False, False),
    "": (False, False, False, False, False),
}


def test_value_tests(spark):
    df = spark.createDataFrame([(k,) for k in CASES], "v string")
    got = {r["v"]: (r["i"], r["d"], r["t"], r["b"], r["ip"]) for r in df.select(
        "v", ty.is_integer("v").alias("i"), ty.is_double("v").alias("d"),
        ty.is_date("v").alias("t"), ty.is_boolean("v").alias("b"), ty.is_ip("v").alias("ip")).collect()}
    assert got == CASES


def test_strict_dates(spark):
    df = spark.createDataFrame([("2020-01-31",), ("31/01/2020",), ("2020",), ("1-URGENT",), ("3abc",)], "v string")
    got = [r[0] for r in df.select(ty.is_date("v", "strict")).collect()]
    assert got == [True, True, True, False, False]


def _types(spark, rows):
    df = spark.createDataFrame(rows, "node_id bigint, labels array<string>, props map<string,string>")
    return {r["property"]: r["type"] for r in infer_property_types(df).collect()}


def test_type_rules(spark):
    rows = [
        (1, ["A"], {"i": "1", "d": "1.5", "dt": "2020-01-01", "b": "yes", "s": "x", "ip": "10.0.0.1",
                    "locationIP": "5", "mix": "1", "e": None}),
        (2, ["A"], {"i": "-2", "d": "3", "dt": "1-URGENT", "b": "NO", "s": "y", "ip": "1.2.3.4",
                    "locationIP": "6", "mix": "abc", "e": None}),
    ]
    t = _types(spark, rows)
    assert t["i"] == "Integer"
    assert t["d"] == "Double"
    assert t["dt"] == "Date"  # lenient: any leading number
    assert t["b"] == "Boolean"
    assert t["s"] == "String"
    assert t["ip"] == "String"
    assert t["locationIP"] == "String"
    assert t["mix"] == "String"
    assert t["e"] == ty.EMPTY_TYPE


def test_pg_and_xsd_type(spark):
    df = spark.createDataFrame([(x,) for x in ["Integer", "Double", "Date", "Boolean", "String",
                                               "Unknown (empty)", "int32"]], "t string")
    got = [(r[0], r[1]) for r in df.select(ty.pg_type("t"), ty.xsd_type("t")).collect()]
    assert got == [("INTEGER", "xs:integer"), ("DOUBLE", "xs:decimal"), ("DATE", "xs:date"),
                   ("BOOLEAN", "xs:boolean"), ("STRING", "xs:string"), ("STRING", "xs:string"),
                   ("INT32", "xs:integer")]
