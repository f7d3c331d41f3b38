"""The public surface: graphs that answer SPARQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.debug import tabulate
from quadrille.operators.frames import Frame
from quadrille.plans.algebra import Select
from quadrille.plans.parser import parse
from quadrille.plans.planner import Planner
from quadrille.sources.quads import QuadSource
from quadrille.sources.tables import TPCH, Mapping, TableSource
from quadrille.terms import Term, lexical_of, struct_of, term_of


class Graph:
    """A source and the queries on it. Plans are lazy, but for repeated paths, which run as they are planned."""

    def __init__(self, source, compiler: Callable[[str], Select] = parse):
        """compiler: what makes a query of a text; parse() or another one that gives its algebra."""
        self.source, self.compiler = source, compiler
        self.spark: SparkSession = source.spark

    @classmethod
    def of_quads(cls, quads: DataFrame) -> Graph:
        """From columns s, p, o, g of term keys."""
        return cls(QuadSource(quads))

    @classmethod
    def of_terms(cls, spark: SparkSession, rows) -> Graph:
        return cls(QuadSource.of_terms(spark, rows))

    @classmethod
    def of_tables(cls, spark: SparkSession, folder: str, mappings: list[Mapping] | None = None) -> Graph:
        return cls(TableSource.parquet(spark, folder, mappings or TPCH))

    def frame(self, query: str | Select) -> Frame:
        q = self.compiler(query) if isinstance(query, str) else query
        return Planner(self.source).select(q)

    def query(self, query: str | Select) -> DataFrame:
        """One column of TERM structs a variable; unbound is NULL."""
        f = self.frame(query)
        return f.table(self.spark).select(*(struct_of(b.key()).alias(n) for n, b in f.vars.items()))

    def keys(self, query: str | Select) -> DataFrame:
        """One column of term keys a variable."""
        f = self.frame(query)
        return f.table(self.spark).select(*(b.key().alias(n) for n, b in f.vars.items()))

    def values(self, query: str | Select) -> DataFrame:
        """Plain values: table columns with their own types (a row's IRI as the row's key), computed ones as numbers or strings, all
        others as lexical forms."""
        f = self.frame(query)
        return f.table(self.spark).select(*((b.col if b.map else lexical_of(b.col)).alias(n) for n, b in f.vars.items()))

    def ask(self, query: str | Select) -> bool:
        return bool(self.frame(query).table(self.spark).head(1))

    def follow(self, query: str | Select, callback: Callable[[int, dict[str, Term]], None]) -> None:
        """Calls back with each solution, as a change (+1, its bound variables): what a live query would say of this graph's quads.
        Solutions stream through the driver, a partition at a time."""
        for row in self.keys(query).toLocalIterator():
            callback(1, {n: term_of(k) for n, k in row.asDict().items() if k is not None})

    def tabulate(self, query: str | Select, order: tuple[str, ...] = (), most: int = 1000) -> str:
        """The first solutions as a table of text."""
        return tabulate(self.keys(query), order, most)

    def scan(self, s: Term | None = None, p: Term | None = None, o: Term | None = None, g: Term | None = None) -> DataFrame:
        """Quads with these terms, of a graph of quads."""
        return self.source.filter(s, p, o, g)
