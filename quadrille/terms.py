"""RDF terms, and the one string key that stands for a term inside plans.

Keys: I<iri>, B<label>, L<datatype>|<lexical form>, @<language>|<lexical form>. Equal keys are equal terms, so joins compare plain
strings; an unbound variable is NULL.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
STRING, BOOLEAN, INTEGER, DOUBLE, DECIMAL, DATETIME, DATE = (XSD + x for x in ("string", "boolean", "integer", "double", "decimal", "dateTime", "date"))
NUMERIC = tuple(XSD + x for x in ("integer", "int", "long", "short", "byte", "float", "double", "decimal", "nonNegativeInteger", "positiveInteger", "unsignedInt", "unsignedLong"))
INTEGERS = tuple(x for x in NUMERIC if x not in (DOUBLE, DECIMAL, XSD + "float"))
TERM = "struct<kind:tinyint,value:string,datatype:string,lang:string>"
KIND = {"I": 1, "B": 2, "L": 3, "@": 4}


@dataclass(frozen=True)
class Iri:
    value: str


@dataclass(frozen=True)
class Blank:
    label: str


@dataclass(frozen=True)
class Literal:
    value: str
    datatype: str = STRING
    lang: str = ""


Term = Iri | Blank | Literal


def literal(value) -> Literal:
    """A literal of a Python value."""
    match value:
        case bool():
            return Literal(str(value).lower(), BOOLEAN)
        case int():
            return Literal(str(value), INTEGER)
        case float():
            return Literal(repr(value), DOUBLE)
        case dt.datetime():
            return Literal(value.isoformat(), DATETIME)
        case dt.date():
            return Literal(value.isoformat(), DATE)
    return Literal(str(value))


def key(term: Term) -> str:
    match term:
        case Iri(v):
            return "I" + v
        case Blank(v):
            return "B" + v
        case Literal(v, _, lang) if lang:
            return f"@{lang.lower()}|{v}"
        case Literal(v, t, _):
            return f"L{t}|{v}"
    raise TypeError(f"not a term: {term!r}")


def term_of(k: str) -> Term:
    kind, rest = k[0], k[1:]
    if kind == "I":
        return Iri(rest)
    if kind == "B":
        return Blank(rest)
    head, _, value = rest.partition("|")
    return Literal(value, RDF + "langString", head) if kind == "@" else Literal(value, head)


def kind_of(k: Column) -> Column:
    return F.substring(k, 1, 1)


def head_of(k: Column) -> Column:
    """Datatype or language of a literal's key."""
    return F.substring(k, F.lit(2), F.instr(k, "|") - 2)


def lexical_of(k: Column) -> Column:
    """Lexical form of a literal, IRI or label of the others."""
    at = F.when(kind_of(k).isin("L", "@"), F.instr(k, "|") + 1).otherwise(F.lit(2))
    return F.substring(k, at, F.length(k))


def struct_of(k: Column) -> Column:
    """The TERM struct of a key; NULL stays NULL."""
    kind = kind_of(k)
    number = F.when(kind == "I", 1).when(kind == "B", 2).when(kind == "L", 3).otherwise(4).cast("tinyint")
    datatype = F.when(kind == "L", head_of(k)).when(kind == "@", F.lit(RDF + "langString")).otherwise(F.lit(""))
    return F.when(k.isNotNull(), F.struct(number.alias("kind"), lexical_of(k).alias("value"), datatype.alias("datatype"), F.when(kind == "@", head_of(k)).otherwise(F.lit("")).alias("lang")))


def key_of_struct(t: Column) -> Column:
    return F.when(t["kind"] == 1, F.concat(F.lit("I"), t["value"])).when(t["kind"] == 2, F.concat(F.lit("B"), t["value"])).when(t["kind"] == 3, F.concat(F.lit("L"), t["datatype"], F.lit("|"), t["value"])).when(t["kind"] == 4, F.concat(F.lit("@"), F.lower(t["lang"]), F.lit("|"), t["value"]))
