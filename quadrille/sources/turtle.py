"""Turtle and TriG: documents can't be split, so each file is parsed as a whole by one task; files are read in parallel."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.terms import BOOLEAN, DECIMAL, DOUBLE, INTEGER, RDF, STRING, Blank, Iri, Literal, Term, key, kind_of, lexical_of
from quadrille.plans.parser import unescape
from quadrille.sources.ntriples import term_text

_TOKEN = re.compile(
    r"""(?P<skip>(?:\s+|\#[^\n]*)+)
    |(?P<iri><(?:[^<>"{}|^`\\\x00-\x20]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>)
    |(?P<string>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<directive>@(?:prefix|base)\b)
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<blank>_:[\w](?:[\w.·-]*[\w·-])?)
    |(?P<number>[+-]?(?:(?:\d+\.\d*|\.?\d+)[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<name>(?:[^\W\d_](?:[\w.·-]*[\w·-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?\#@%-])(?:(?:[\w:.·-]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?\#@%-])*(?:[\w:·-]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?\#@%-]))?)?)
    |(?P<word>[A-Za-z]+)
    |(?P<op>\^\^|[{}()\[\].,;])""",
    re.X | re.S,
)


class TurtleError(ValueError):
    """The text is no Turtle or TriG."""


def _resolve(base: str, iri: str) -> str:
    if not base or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", iri):
        return iri
    if not iri:
        return base.split("#")[0]
    if iri.startswith("#"):
        return base.split("#")[0] + iri
    head = re.match(r"([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)", base)
    if iri.startswith("//"):
        return (head[1] or "") + iri
    root = (head[1] or "") + (head[2] or "")
    if iri.startswith("?"):
        return root + head[3] + iri
    path = iri if iri.startswith("/") else head[3].rsplit("/", 1)[0] + "/" + iri
    body, mark, rest = re.match(r"([^?#]*)([?#]?)(.*)", path, re.S).groups()
    out: list[str] = []
    parts = body.split("/")
    for i, p in enumerate(parts):
        if p in (".", ".."):
            if p == ".." and len(out) > 1:
                out.pop()
            if i == len(parts) - 1:
                out.append("")
        else:
            out.append(p)
    return root + "/".join(out) + mark + rest


class TurtleParser:
    """Quads (s, p, o, g) of a document, g None in Turtle and in TriG's default graph."""

    def __init__(self, text: str, scope: str = "", base: str = "", trig: bool = True):
        self.scope, self.base, self.trig = scope, base, trig
        self.prefixes: dict[str, str] = {}
        self.quads: list[tuple] = []
        self.graph: Term | None = None
        self.count = 0
        self.read = self._tokens(text)
        self.kind, self.text = next(self.read)

    @staticmethod
    def _tokens(text: str) -> Iterator[tuple[str, str]]:
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise TurtleError(f"can't read {text[at : at + 30]!r}")
            at = m.end()
            if m.lastgroup != "skip":
                yield m.lastgroup, m[0]
        yield "end", ""

    def next(self) -> str:
        out = self.text
        if self.kind != "end":
            self.kind, self.text = next(self.read)
        return out

    def op(self, sign: str) -> bool:
        if self.kind == "op" and self.text == sign:
            self.next()
            return True
        return False

    def need(self, sign: str) -> None:
        if not self.op(sign):
            raise TurtleError(f"{sign!r} is missing before {self.text!r}")

    def blank(self, label: str | None = None) -> Blank:
        self.count += label is None
        return Blank(f"{self.scope}.{label}" if label is not None else f"{self.scope}.-{self.count}")

    def iri(self) -> Iri:
        if self.kind == "iri":
            return Iri(_resolve(self.base, unescape(self.next()[1:-1])))
        if self.kind == "name":
            prefix, _, local = self.next().partition(":")
            if prefix not in self.prefixes:
                raise TurtleError(f"the prefix {prefix!r} isn't declared")
            return Iri(self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local))
        raise TurtleError(f"an IRI is missing before {self.text!r}")

    def parse(self) -> list[tuple]:
        while self.kind != "end":
            if self.kind == "directive" or self.kind == "word" and self.text.upper() in ("PREFIX", "BASE"):
                word = self.next()
                if word.lower().endswith("prefix"):
                    if self.kind != "name" or not self.text.endswith(":"):
                        raise TurtleError(f"no prefix: {self.text!r}")
                    name = self.next()[:-1]
                    self.prefixes[name] = self.iri().value
                else:
                    self.base = self.iri().value
                if word.startswith("@"):
                    self.need(".")
            elif self.trig and self.kind == "word" and self.text.upper() == "GRAPH":
                self.next()
                self.block(self.subject())
            elif self.trig and self.kind == "op" and self.text == "{":
                self.block(None)
            else:
                bracketed = self.kind == "op" and self.text == "["
                s = self.subject()
                if self.trig and self.kind == "op" and self.text == "{":
                    self.block(s)
                    continue
                if not (bracketed and self.kind == "op" and self.text == "."):
                    self.properties(s)
                self.need(".")
        return self.quads

    def block(self, g: Term | None) -> None:
        self.need("{")
        self.graph = g
        while not self.op("}"):
            bracketed = self.kind == "op" and self.text == "["
            s = self.subject()
            if not (bracketed and self.kind == "op" and self.text in ".}"):
                self.properties(s)
            if not self.op(".") and not (self.kind == "op" and self.text == "}"):
                raise TurtleError(f"'.' is missing before {self.text!r}")
        self.graph = None

    def subject(self) -> Term:
        if self.kind in ("string", "number") or self.kind == "word":
            raise TurtleError(f"no subject: {self.text!r}")
        return self.node()

    def properties(self, s: Term) -> None:
        while True:
            if self.kind == "word" and self.text == "a":
                self.next()
                p = Iri(RDF + "type")
            else:
                p = self.iri()
            while True:
                self.quads.append((s, p, self.node(), self.graph))
                if not self.op(","):
                    break
            if not self.op(";"):
                return
            while self.op(";"):
                pass
            if self.kind == "op" and self.text in ".]}":
                return

    def node(self) -> Term:
        if self.op("["):
            b = self.blank()
            if not self.op("]"):
                self.properties(b)
                self.need("]")
            return b
        if self.op("("):
            items = []
            while not self.op(")"):
                items.append(self.node())
            head: Term = Iri(RDF + "nil")
            for x in reversed(items):
                b = self.blank()
                self.quads += [(b, Iri(RDF + "first"), x, self.graph), (b, Iri(RDF + "rest"), head, self.graph)]
                head = b
            return head
        match self.kind:
            case "iri" | "name":
                return self.iri()
            case "blank":
                return self.blank(self.next()[2:])
            case "number":
                n = self.next()
                return Literal(n, DOUBLE if "e" in n.lower() else DECIMAL if "." in n else INTEGER)
            case "word" if self.text in ("true", "false"):
                return Literal(self.next(), BOOLEAN)
            case "string":
                raw = self.next()
                n = 3 if raw[:3] in ('"""', "'''") and len(raw) >= 6 else 1
                value = unescape(raw[n:-n])
                if self.kind == "lang":
                    return Literal(value, RDF + "langString", self.next()[1:])
                if self.op("^^"):
                    return Literal(value, self.iri().value)
                return Literal(value)
        raise TurtleError(f"no term: {self.text!r}")


def parse(text: str, scope: str = "", base: str = "", trig: bool = True) -> list[tuple]:
    """Quads of terms."""
    return TurtleParser(text, scope, base, trig).parse()


def read(spark: SparkSession, path: str, base: str = "") -> DataFrame:
    """Quads (s, p, o, g) of term keys, of one file or all files of a folder. Blank nodes are scoped by file."""

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                scope = hashlib.md5(name.encode()).hexdigest()[:8]
                quads = parse(raw.decode("utf-8"), scope, base, not name.endswith(".ttl"))
                for at in range(0, len(quads), 50_000):
                    part = quads[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([key(q[i]) if q[i] is not None else None for q in part], pa.string()) for i in range(4)], list("spog"))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(files, "s string, p string, o string, g string")


def documents(quads: DataFrame, prefixes: dict[str, str] | None = None, pretty: bool = True, indent: str = "    ") -> DataFrame:
    """Turtle, one row (value) a subject and graph, the graph's in TriG's braces; predicates and objects in order. Prefixes come
    first in each file that write() writes. pretty: a line a predicate, indented; else all in one line, a blank between tokens."""
    short = lambda k: term_text(k)

    def named(k):
        out = short(k)
        for name, iri in (prefixes or {}).items():
            local = F.substring(k, F.lit(2 + len(iri)), F.length(k))
            out = F.when((kind_of(k) == "I") & F.startswith(k, F.lit("I" + iri)) & local.rlike(r"^[A-Za-z_][A-Za-z0-9_-]*$"), F.concat(F.lit(name + ":"), local)).otherwise(out)
        return out

    cells = quads.select("s", "g", named(F.col("s")).alias("st"), F.when(F.col("p") == "I" + RDF + "type", F.lit("a")).otherwise(named(F.col("p"))).alias("pt"), named(F.col("o")).alias("ot"), named(F.col("g")).alias("gt"))
    lists = cells.groupBy("s", "g", "st", "gt", "pt").agg(F.array_join(F.array_sort(F.collect_set("ot")), ", " if pretty else " , ").alias("ot"))
    rows = lists.groupBy("s", "g", "st", "gt").agg(F.array_join(F.array_sort(F.collect_list(F.concat("pt", F.lit(" "), "ot"))), f" ;\n{indent}" if pretty else " ; ").alias("po"))
    body = F.concat("st", F.lit(" "), "po", F.lit(" ."))
    return rows.select(F.when(F.col("g").isNull(), body).otherwise(F.concat("gt", F.lit(" { "), body, F.lit(" }"))).alias("value"))


def write(quads: DataFrame, path: str, prefixes: dict[str, str] | None = None, pretty: bool = True, indent: str = "    ") -> None:
    """A folder of Turtle (or TriG) files, each complete in itself."""
    head = "".join(f"@prefix {n}: <{i}> .\n" for n, i in (prefixes or {}).items())

    def with_head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for b in batches:
            values = b.column("value").to_pylist()
            if first and values:
                values[0], first = head + values[0], False
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.string())], ["value"])

    documents(quads, prefixes, pretty, indent).mapInArrow(with_head, "value string").write.text(path)
