"""Scalar functions on source text and identifiers, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# White space of the lexer, its pattern, and the keywords that have a kind of their own.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"
LEXEME = (
    r"//[^\n]*|/\*[\x{0}-\x{10ffff}]*?\*/"
    r'|"(?:\\[^\n]|[^"\\])*+"'
    r"|'(?:\\[^\n]|[^'\\])*+'"
    r"|[\p{L}\p{Nl}\p{No}_][" + WORD + r"]*|(?:0[xX][0-9a-fA-F]+|\p{Nd}+(?:\.\p{Nd}+)?)|[^" + WORD + SPACE + "]"
)
TILE = LEXEME + "|[" + SPACE + "]+"
KEYWORDS = (
    "if else for while do switch case return break continue sizeof struct class typedef unsigned signed int long short char void bool const volatile static auto"
    " delete new free nullptr null using namespace template true false"
).split()
KINDS = {"identifier": 1, "keyword": 2, "number": 3, "string": 4, "comment": 5, "punctuation": 6}

#: ids below are reserved for special tokens; a byte token is its value above them
FIRST_ID = 16


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(c, "^[" + SPACE + "]+", ""), "[" + SPACE + "]+$", "")


def lexemes(code: Column) -> Column:
    return F.regexp_extract_all(code, F.lit(LEXEME), F.lit(0))


def tiles(code: Column) -> Column:
    """Lexemes and white space; together they are the whole text."""
    return F.regexp_extract_all(code, F.lit(TILE), F.lit(0))


def is_comment(token: Column) -> Column:
    return token.startswith("//") | token.startswith("/*")


def fingerprint(code: Column) -> Column:
    """SHA-256 of the lexemes but comments, each framed by its length: blind to white space and comments only."""
    framed = F.transform(F.filter(lexemes(code), lambda t: ~is_comment(t)), lambda t: F.concat(F.length(t).cast("string"), F.lit(":"), t))
    return F.sha2(F.array_join(framed, ""), 256)


def kind(token: Column) -> Column:
    """The kind of a tile; white space is 0."""
    first = F.substring(token, 1, 1)
    return (
        F.when(token.rlike("^[" + SPACE + "]"), 0)
        .when(is_comment(token), KINDS["comment"])
        .when(first.isin('"', "'") & (F.length(token) > 1), KINDS["string"])
        .when(token.isin(KEYWORDS), KINDS["keyword"])
        .when(token.rlike(r"^[\p{L}\p{Nl}\p{No}_]"), KINDS["identifier"])
        .when(token.rlike(r"^\p{Nd}"), KINDS["number"])
        .otherwise(KINDS["punctuation"])
    )


def kinds_by_char(code: Column) -> Column:
    """The kind of each character, by repeating each tile's kind over its length."""
    return F.flatten(F.transform(tiles(code), lambda t: F.array_repeat(kind(t), F.length(t))))


def byte_ids(text: Column) -> Column:
    # as Latin-1 every byte is one character, whose number is the byte
    bytes_ = F.split(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), "")
    return F.when(text == "", F.array().cast("array<int>")).otherwise(F.transform(bytes_, lambda c: F.ascii(c) + FIRST_ID))


def repo_identity(value: Column) -> Column:
    """One spelling for a repository: host/owner/name in lower case; null counts as empty."""
    v = F.regexp_replace(strip(F.coalesce(value, F.lit(""))), "/+$", "")
    v = F.regexp_replace(F.regexp_replace(v, r"\.git$", ""), r"^git@github\.com:", "github.com/")
    v = F.when(v.contains("://"), F.regexp_replace(F.regexp_replace(v, r"^[^:]*://", ""), r"[?#][\s\S]*$", "")).otherwise(v)
    return F.lower(F.when(v.rlike(r"^[^/:]+/[^/:]+$"), F.concat(F.lit("github.com/"), v)).otherwise(v))


def found(text: Column, pattern: str) -> Column:
    """Distinct matches in the order of strings."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))


def weakness_ids(text: Column) -> Column:
    return found(text, r"CWE-\d+")


def incident_ids(text: Column) -> Column:
    return found(text, r"CVE-\d{4}-\d+")


def binary(value: Column) -> Column:
    """0 or 1 of 0/false, 1/true in any case; null stays null; anything else is an error."""
    low = F.lower(value.cast("string"))
    bad = F.raise_error(F.concat(F.lit("not a binary label: "), low)).cast("int")
    return F.when(low.isNull(), F.lit(None).cast("int")).when(low.isin("0", "false"), 0).when(low.isin("1", "true"), 1).otherwise(bad)


def unit_hash(seed: int, key: Column) -> Column:
    """A number in [0, 1) of the first 64 bits of SHA-256 of ``seed:key``."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 16)
    return F.conv(digits, 16, 10).cast("decimal(20,0)").cast("double") / float(1 << 64)


def partition_of(unit: Column) -> Column:
    return F.when(unit < 0.8, "train").when(unit < 0.9, "validation").when(unit < 0.95, "calibration").otherwise("test")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(80.0)), F.lit(-80.0))))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def bce(logit: Column, target: Column, positive_weight: float = 1.0) -> Column:
    """Binary cross-entropy of a logit, stable for large values."""
    return positive_weight * target * softplus(-logit) + (1 - target) * softplus(logit)


def line_of(code: Column, start: Column) -> Column:
    """1-based line of a character offset."""
    head = F.substring(code, F.lit(1), start)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1
