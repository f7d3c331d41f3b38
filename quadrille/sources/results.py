"""SPARQL results as JSON and XML, and JSON read back; INSERT DATA and DELETE DATA."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.plans.parser import QueryError
from quadrille.sources.turtle import TurtleParser
from quadrille.terms import RDF, STRING, TERM, key


def _json_term(t: Column) -> Column:
    kind = F.when(t["kind"] == 1, "uri").when(t["kind"] == 2, "bnode").otherwise("literal")
    typed = (t["kind"] == 3) & (t["datatype"] != STRING)
    return F.struct(kind.alias("type"), t["value"].alias("value"), F.when(typed, t["datatype"]).alias("datatype"), F.when(t["kind"] == 4, t["lang"]).alias("xml:lang"))


def json_bindings(solutions: DataFrame) -> DataFrame:
    """One column, value: the JSON object of a solution; unbound variables are left out. solutions: TERM structs."""
    return solutions.select(F.to_json(F.struct(*(F.when(F.col(f"`{c}`").isNotNull(), _json_term(F.col(f"`{c}`"))).alias(c) for c in solutions.columns))).alias("value"))


def to_json(solutions: DataFrame) -> str:
    """A whole results document; for results that fit the driver."""
    rows = ",".join(r.value for r in json_bindings(solutions).toLocalIterator())
    return f'{{"head":{{"vars":{json.dumps(solutions.columns)}}},"results":{{"bindings":[{rows}]}}}}'


def from_json(spark: SparkSession, text: str) -> DataFrame:
    doc = json.loads(text)
    names = doc["head"]["vars"]

    def term(b):
        if b is None:
            return None
        if b["type"] == "uri":
            return (1, b["value"], "", "")
        if b["type"] == "bnode":
            return (2, b["value"], "", "")
        if "xml:lang" in b:
            return (4, b["value"], RDF + "langString", b["xml:lang"])
        return (3, b["value"], b.get("datatype", STRING), "")

    return spark.createDataFrame([tuple(term(r.get(n)) for n in names) for r in doc["results"]["bindings"]], ", ".join(f"`{n}` {TERM}" for n in names))


def _xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def xml_results(solutions: DataFrame) -> DataFrame:
    """One column, value: the <result> element of a solution."""
    cells = []
    for c in solutions.columns:
        t = F.col(f"`{c}`")
        v = _xml(t["value"])
        tag = F.when(t["kind"] == 4, F.concat(F.lit(' xml:lang="'), _xml(t["lang"]), F.lit('"'))).when((t["kind"] == 3) & (t["datatype"] != STRING), F.concat(F.lit(' datatype="'), _xml(t["datatype"]), F.lit('"'))).otherwise(F.lit(""))
        body = F.when(t["kind"] == 1, F.concat(F.lit("<uri>"), v, F.lit("</uri>"))).when(t["kind"] == 2, F.concat(F.lit("<bnode>"), v, F.lit("</bnode>"))).otherwise(F.concat(F.lit("<literal"), tag, F.lit(">"), v, F.lit("</literal>")))
        cells.append(F.when(t.isNotNull(), F.concat(F.lit(f'<binding name="{c}">'), body, F.lit("</binding>"))).otherwise(F.lit("")))
    return solutions.select(F.concat(F.lit("<result>"), *cells, F.lit("</result>")).alias("value"))


def to_xml(solutions: DataFrame) -> str:
    head = "".join(f'<variable name="{c}"/>' for c in solutions.columns)
    rows = "".join(r.value for r in xml_results(solutions).toLocalIterator())
    return f'<?xml version="1.0"?><sparql xmlns="http://www.w3.org/2005/sparql-results#"><head>{head}</head><results>{rows}</results></sparql>'


def parse_update(text: str) -> tuple[list[tuple], list[tuple]]:
    """Quads to insert and quads to delete, of INSERT DATA and DELETE DATA with or without GRAPH."""
    p = TurtleParser(text, "u")
    inserted: list[tuple] = []
    deleted: list[tuple] = []
    while p.kind != "end":
        word = p.text.upper() if p.kind == "word" else ""
        if word in ("PREFIX", "BASE"):
            p.next()
            if word == "PREFIX":
                name = p.next()[:-1]
                p.prefixes[name] = p.iri().value
            else:
                p.base = p.iri().value
            continue
        if word not in ("INSERT", "DELETE"):
            raise QueryError(f"no update: {p.text!r}")
        p.next()
        if p.next().upper() != "DATA":
            raise QueryError("only INSERT DATA and DELETE DATA are known")
        p.quads = []
        p.need("{")
        while not p.op("}"):
            if p.kind == "word" and p.text.upper() == "GRAPH":
                p.next()
                p.block(p.subject())
            else:
                p.properties(p.subject())
            p.op(".")
        (inserted if word == "INSERT" else deleted).extend(p.quads)
        p.op(";")
    return inserted, deleted


def changes(spark: SparkSession, text: str) -> DataFrame:
    """An update as changes (s, p, o, g, w): additions first, then deletions, so what is in both goes."""
    add, drop = parse_update(text)
    rows = {q: 1 for q in add} | {q: -1 for q in drop}
    return spark.createDataFrame([(*(key(t) if t is not None else None for t in q), w) for q, w in rows.items()], "s string, p string, o string, g string, w bigint")


def apply_update(quads: DataFrame, text: str) -> DataFrame:
    """The quads after an update: additions first, then deletions, as a set."""
    spark = quads.sparkSession
    add, drop = parse_update(text)
    table = lambda rows: spark.createDataFrame([tuple(key(t) if t is not None else None for t in q) for q in rows], "s string, p string, o string, g string")
    out = quads.select("s", "p", "o", "g")
    if add:
        out = out.union(table(add))
    out = out.distinct()
    if drop:
        d = table(drop).toDF("s_", "p_", "o_", "g_")
        out = out.join(F.broadcast(d), (F.col("s") == F.col("s_")) & (F.col("p") == F.col("p_")) & (F.col("o") == F.col("o_")) & F.col("g").eqNullSafe(F.col("g_")), "left_anti")
    return out
