"""Scalar functions on literal rows."""

import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sparkloom.functions import text as tx

ODD = [
    "x²=٣.٤+0xFF; \"unterminated", "é=1\u001cz", "𝒳1 + 😀", "٣x", "/* open", "", '"' + "\\x" * 20_000 + "y" * 20_000 + '"', "/* " + "x*" * 20_000 + " */ y", '"a b"', "int f(){/*c*/return 0;}",
]


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def test_tiles_are_the_whole_text(spark):
    for r in column(spark, ODD).select("v", tx.tiles(F.col("v")).alias("t"), tx.kinds_by_char(F.col("v")).alias("k")).collect():
        assert "".join(r.t) == r.v
        assert len(r.k) == len(r.v)


def test_fingerprint_is_blind_to_comments_and_space_only(spark):
    a, b, c, d = (r[0] for r in column(spark, ["int f ( ) { return 1; }", "int f(){/* x */return 1;} // y", 'f("a b")', 'f("ab")']).select(tx.fingerprint(F.col("v"))).collect())
    assert a == b and c != d and a != c


def test_kinds(spark):
    rows = column(spark, ["if", "iff", "0x1F", "3.5", '"s"', "'c'", "// c", "/* c */", ";", " ", "é", '"']).select(tx.kind(F.col("v"))).collect()
    assert [r[0] for r in rows] == [2, 1, 3, 3, 4, 4, 5, 5, 6, 0, 1, 6]


@pytest.mark.parametrize("value,want", [
    ("Owner/Repo", "github.com/owner/repo"), ("https://github.com/owner/repo.git", "github.com/owner/repo"), ("git@github.com:Owner/Repo.git", "github.com/owner/repo"),
    (" https://x.org/A/B/?q=1#f ", "x.org/a/b/"), (None, ""), ("https://github.com/owner", "github.com/github.com/owner"),
])
def test_repo_identity(spark, value, want):
    assert column(spark, [value]).select(tx.repo_identity(F.col("v"))).first()[0] == want


def test_binary(spark):
    assert [r[0] for r in column(spark, ["0", "TRUE", "false", None, "1"]).select(tx.binary(F.col("v"))).collect()] == [0, 1, 0, None, 1]
    with pytest.raises(Exception, match="not a binary label"):
        column(spark, ["1.0"]).select(tx.binary(F.col("v"))).collect()


def test_names_sort_as_strings(spark):
    assert column(spark, ["CWE-20 CWE-119 CWE-20"]).select(tx.weakness_ids(F.col("v"))).first()[0] == ["CWE-119", "CWE-20"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=40), min_size=1, max_size=8))
def test_bytes(spark, values):
    for r in column(spark, values).select("v", tx.byte_ids(F.col("v")).alias("b")).collect():
        assert bytes(x - tx.FIRST_ID for x in r.b) == r.v.encode()


def test_lines(spark):
    df = spark.createDataFrame([("a\nb\nc", 4)], "v string, at int")
    assert df.select(tx.line_of(F.col("v"), F.col("at"))).first()[0] == 3
    assert not re.search(r"\s$", tx.LEXEME)
