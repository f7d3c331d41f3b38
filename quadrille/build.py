"""Small graphs in Python, for tests and examples."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quadrille.graph import Graph
from quadrille.terms import RDF, Blank, Iri, Literal, Term, literal


class Builder:
    """b.add(s, p, o, ...): objects may be terms, Python values (literals), or what blank() and list() return."""

    def __init__(self, base: str = "http://example.org/"):
        self.base, self.rows, self.graph, self.n = base, [], None, 0

    def iri(self, name: str) -> Iri:
        return Iri(name if ":" in name else self.base + name)

    def add(self, s, p, *objects) -> Builder:
        s, p = (x if isinstance(x, Term) else self.iri(x) for x in (s, p))
        for o in objects:
            self.rows.append((s, p, o if isinstance(o, Term) else literal(o), self.graph))
        return self

    def a(self, s, kind) -> Builder:
        return self.add(s, RDF + "type", kind if isinstance(kind, Term) else self.iri(kind))

    def blank(self, *pairs) -> Blank:
        """A blank node with these (predicate, object) pairs."""
        self.n += 1
        b = Blank(f"b{self.n}")
        for p, o in pairs:
            self.add(b, p, o)
        return b

    def list(self, *items) -> Term:
        head: Term = Iri(RDF + "nil")
        for x in reversed(items):
            head = self.blank((RDF + "first", x), (RDF + "rest", head))
        return head

    def named(self, graph) -> Builder:
        """What is added from here on is in this graph; None is the default one."""
        self.graph = None if graph is None else graph if isinstance(graph, Term) else self.iri(graph)
        return self

    def build(self, spark: SparkSession) -> Graph:
        return Graph.of_terms(spark, self.rows)


__all__ = ["Builder", "Literal"]
