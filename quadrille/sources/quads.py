"""Graphs held as quads: one row (s, p, o, g) of term keys, g NULL for the default graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.operators.frames import Bound, Frame, fresh
from quadrille.plans.algebra import Not, Step, Triple, Var
from quadrille.storage import parts_for, written
from quadrille.terms import Iri, Term, key, key_of_struct, literal, struct_of

SCHEMA = "s string, p string, o string, g string"


def write_store(quads: DataFrame, path: str) -> None:
    """Quads as a store: Parquet in order of predicate, subject and object, so that scans for one predicate or subject skip the files
    and row groups of all others by their statistics."""
    rows = written(quads.select("s", "p", "o", "g"), "quads")  # read three times
    # in parts by their bytes; equal quads are in one part then, which makes them distinct: before the shuffle that would hold all of a split's rows
    rows.repartitionByRange(parts_for(rows), "p", "s", "o").distinct().sortWithinPartitions("p", "s", "o").write.parquet(path)


def read_store(spark: SparkSession, path: str) -> QuadSource:
    """The source of a store; its rows are distinct already, so no pattern shuffles it."""
    return QuadSource(spark.read.schema(SCHEMA).parquet(path), distinct=False)


class QuadSource:
    """Quads as a set. weight: a column of multiplicities, for changes; then rows aren't made distinct."""

    def __init__(self, quads: DataFrame, weight: str | None = None, distinct: bool = True):
        self.spark: SparkSession = quads.sparkSession
        self.weight = weight
        self.quads = quads if weight or not distinct else quads.select("s", "p", "o", "g").distinct()

    @classmethod
    def of_terms(cls, spark: SparkSession, rows) -> QuadSource:
        """From tuples (s, p, o) or (s, p, o, g) of terms; a Python value as o is a literal."""
        term = lambda x: x if isinstance(x, Term) else literal(x)
        return cls(spark.createDataFrame([(key(r[0]), key(r[1]), key(term(r[2])), key(r[3]) if len(r) > 3 and r[3] is not None else None) for r in rows], SCHEMA))

    @classmethod
    def of_structs(cls, quads: DataFrame) -> QuadSource:
        """From columns s, p, o, g of TERM structs."""
        return cls(quads.select(*(key_of_struct(F.col(c)).alias(c) for c in "spog")))

    def structs(self) -> DataFrame:
        return self.quads.select(*(struct_of(F.col(c)).alias(c) for c in "spog"))

    def filter(self, s: Term | None = None, p: Term | None = None, o: Term | None = None, g: Term | None = None) -> DataFrame:
        """Quads with these terms; None is any."""
        out = self.quads
        for c, t in zip("spog", (s, p, o, g)):
            if t is not None:
                out = out.where(F.col(c) == key(t))
        return out

    def nodes(self) -> DataFrame:
        return self.quads.select(F.col("s").alias("a")).union(self.quads.select("o")).distinct()

    def star(self, s, triples: list[Triple]) -> list[Frame]:
        return [self.scan(t) for t in triples]

    def scan(self, t: Triple) -> Frame:
        df, bound, names = self.quads, 0, {}
        ends = [("s", t.s), ("o", t.o)]
        if isinstance(t.p, Not):
            df = df.where(~F.col("p").isin(*(key(x) for x in t.p.terms)))
        else:
            ends.insert(1, ("p", t.p.term))
        if t.g is not None:
            ends.append(("g", t.g))
            df = df.where("g IS NOT NULL")
        cols = []
        for c, x in ends:
            if not isinstance(x, Var):
                df = df.where(F.col(c) == key(x))
                bound += 1
            elif x.name in names:
                df = df.where(F.col(c) == F.col(names[x.name][0]))
            else:
                names[x.name] = (c, fresh(x.name))
        cols = [F.col(c).alias(a) for c, a in names.values()]
        w = fresh("w") if self.weight else None
        if w:
            cols.append(F.col(self.weight).cast("bigint").alias(w))
        return Frame(df.select(*cols), {n: Bound(a) for n, (_, a) in names.items()}, w, bound)
