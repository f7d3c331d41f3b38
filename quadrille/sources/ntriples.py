"""N-Triples and N-Quads: read line by line, so large files are split; written one statement a line."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.terms import RDF, STRING, head_of, kind_of, lexical_of

_IRI = r"<([^<>\"{}|^`\\\x00-\x20]*+(?:\\u[0-9A-Fa-f]{4}[^<>\"{}|^`\\\x00-\x20]*+|\\U[0-9A-Fa-f]{8}[^<>\"{}|^`\\\x00-\x20]*+)*+)>"
_BLANK = r"_:([^\s<\"]*[^\s<\".])"
_LITERAL = r"\"([^\"\\\n\r]*+(?:\\.[^\"\\\n\r]*+)*+)\"(?:\^\^<([^<>\s]*)>|@([A-Za-z]+(?:-[A-Za-z0-9]+)*))?"
_LINE = rf"^\s*(?:{_IRI}|{_BLANK})\s*{_IRI}\s*(?:{_IRI}|{_BLANK}|{_LITERAL})\s*(?:{_IRI}|{_BLANK})?\s*\.\s*(?:#.*)?$"


def _unescaped(c: Column) -> Column:
    """Escapes resolved; texts without a backslash, nearly all, are left alone."""
    parts = F.regexp_extract_all(c, F.lit(r"(?s)\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+"), F.lit(0))
    code = lambda x, a, n: F.chr(F.conv(F.substring(x, a, n), 16, 10).cast("bigint"))
    wide = lambda x, a, n: F.decode(F.unhex(F.lpad(F.substring(x, a, n), 8, "0")), "UTF-32")

    def one(x: Column) -> Column:
        second = F.substring(x, 2, 1)
        plain = F.when(second == "n", "\n").when(second == "t", "\t").when(second == "r", "\r").when(second == "b", "\b").when(second == "f", "\f").otherwise(second)
        return F.when(F.substring(x, 1, 1) != "\\", x).when((second == "u") & (F.length(x) > 2), wide(x, 3, 4)).when((second == "U") & (F.length(x) > 2), wide(x, 3, 8)).otherwise(plain)

    return F.when(F.contains(c, F.lit("\\")), F.array_join(F.transform(parts, one), "")).otherwise(c)


def instant(text: Column) -> Column:
    """The time that a dateTime's lexical form stands for, in UTC; NULL for none."""
    zoned = F.when(text.rlike(r"(Z|[+-]\d\d:\d\d)$"), text).otherwise(F.concat(text, F.lit("Z")))
    return zoned.try_cast("timestamp").cast("timestamp_ntz")


def parse(spark: SparkSession, text: str, scope: str = "text") -> DataFrame:
    """Quads of statements in a string."""
    rows = spark.createDataFrame([(x,) for x in text.splitlines()], "line string").where(r"NOT line RLIKE '^\\s*(#.*)?$'")
    return _quads(rows.withColumn("file", F.lit(scope)), scope)


def read(spark: SparkSession, path: str, scope: str | None = None) -> DataFrame:
    """Quads (s, p, o, g) of term keys. Blank labels are scoped by file, or by `scope`. A line that is no statement is an error."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file")).where(r"NOT line RLIKE '^\\s*(#.*)?$'")
    return _quads(lines, scope)


def _quads(lines: DataFrame, scope: str | None) -> DataFrame:
    # the groups of a statement, each on a line of its own: one match a line. Lines hold no line feed, so one without is no statement; explode
    # keeps the optimizer from matching again for each use
    groups = F.split(F.regexp_replace("line", _LINE, "".join(f"${i}\n" for i in range(1, 11))), "\n")
    lines = lines.select("line", "file", F.explode(F.array(groups)).alias("groups"))
    x = lambda i: F.col("groups")[i - 1]
    mark = F.lit(hashlib.md5(scope.encode()).hexdigest()[:8]) if scope is not None else F.substring(F.md5("file"), 1, 8)
    blank = lambda c: F.concat(F.lit("B"), mark, F.lit("."), c)
    iri = lambda c: F.concat(F.lit("I"), _unescaped(c))
    text = _unescaped(x(6))
    value = F.when(x(8) != "", F.concat(F.lit("@"), F.lower(x(8)), F.lit("|"), text)).otherwise(F.concat(F.lit("L"), F.when(x(7) != "", x(7)).otherwise(F.lit(STRING)), F.lit("|"), text))
    ok = F.size("groups") > 10
    checked = F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no statement: "), F.col("line"))).cast("boolean"))
    o = F.when(x(4) != "", iri(x(4))).when(x(5) != "", blank(x(5))).otherwise(value)
    return lines.where(checked).select(F.when(x(2) != "", blank(x(2))).otherwise(iri(x(1))).alias("s"), iri(x(3)).alias("p"), o.alias("o"), F.when(x(9) != "", iri(x(9))).when(x(10) != "", blank(x(10))).alias("g"))


def term_text(k: Column) -> Column:
    """A term as N-Triples writes it."""
    body = lexical_of(k)
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(a), F.lit(b))
    tail = F.when(kind_of(k) == "@", F.concat(F.lit("@"), head_of(k))).when(head_of(k) == STRING, F.lit("")).otherwise(F.concat(F.lit("^^<"), head_of(k), F.lit(">")))
    return F.when(kind_of(k) == "I", F.concat(F.lit("<"), F.substring(k, F.lit(2), F.length(k)), F.lit(">"))).when(kind_of(k) == "B", F.concat(F.lit("_:"), F.regexp_replace(lexical_of(k), r"[^A-Za-z0-9_.]", "_"))).otherwise(F.concat(F.lit('"'), body, F.lit('"'), tail))


def statements(quads: DataFrame) -> DataFrame:
    """One column, value: a statement a row."""
    cells = [term_text(F.col(c)) for c in "spo"] + [term_text(F.col("g"))]
    return quads.select(F.concat(F.concat_ws(" ", *cells), F.lit(" .")).alias("value"))


def write(quads: DataFrame, path: str) -> None:
    statements(quads).write.text(path)
