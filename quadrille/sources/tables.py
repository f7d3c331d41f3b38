"""Tables seen as a graph: a row is the subject <urn:TABLE:KEY>, a column the predicate <urn:TABLE#COLUMN>, a foreign key the
subject of the row that it names; <urn:TABLE> is the class of the table's rows.

Nothing is turned into quads. A star of patterns on one subject is one scan of those columns of the table alone; values stay as they
are (see frames), so filters on them are pushed into the scan, and joins along foreign keys compare the keys themselves.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.operators.frames import Bound, Frame, TermMap, apart, fresh, union
from quadrille.plans.algebra import Not, Step, Triple, Var
from quadrille.terms import BOOLEAN, DATE, DATETIME, DECIMAL, DOUBLE, INTEGER, RDF, STRING, XSD, Iri, key

TYPE = Iri(RDF + "type")
_DATATYPES = {T.StringType: STRING, T.BooleanType: BOOLEAN, T.DoubleType: DOUBLE, T.FloatType: XSD + "float", T.TimestampType: DATETIME, T.TimestampNTZType: DATETIME, T.DateType: DATE, T.DecimalType: DECIMAL}


@dataclass
class Mapping:
    """How a table is a graph. key: the column that names rows, or None: then a row is named by a hash of all its columns."""

    name: str
    key: str | None
    foreign: dict[str, str] = field(default_factory=dict)  # column -> table


class TableSource:
    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], mappings: list[Mapping]):
        self.spark, self.tables = spark, tables
        self.mappings = {m.name: m for m in mappings}

    @classmethod
    def parquet(cls, spark: SparkSession, folder: str, mappings: list[Mapping]) -> TableSource:
        return cls(spark, {m.name: spark.read.parquet(f"{folder}/{m.name}.parquet") for m in mappings}, mappings)

    def subject_map(self, m: Mapping) -> TermMap:
        return TermMap("iri", f"urn:{m.name}:")

    def subject(self, m: Mapping):
        df = self.tables[m.name]
        if m.key:
            return F.col(m.key)
        # rows without a key are named by what they hold
        return F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)

    def object_map(self, m: Mapping, column: str) -> TermMap | None:
        if column in m.foreign:
            return self.subject_map(self.mappings[m.foreign[column]])
        kind = self.tables[m.name].schema[column].dataType
        if isinstance(kind, T.IntegralType):
            return TermMap("lit", INTEGER)
        d = _DATATYPES.get(type(kind))
        return TermMap("lit", d) if d else None

    def columns(self, m: Mapping) -> list[str]:
        return [c for c in self.tables[m.name].columns if self.object_map(m, c)]

    def find(self, predicate) -> tuple[Mapping, str] | None:
        if isinstance(predicate, Iri) and predicate.value.startswith("urn:") and "#" in predicate.value:
            table, _, column = predicate.value[4:].partition("#")
            if table in self.mappings and column in self.columns(self.mappings[table]):
                return self.mappings[table], column
        return None

    def nodes(self) -> DataFrame:
        out = None
        for m in self.mappings.values():
            df = self.tables[m.name]
            own = F.array(self.subject_map(m).key(self.subject(m)), F.lit(f"Iurn:{m.name}"), *(self.object_map(m, c).key(F.col(c)) for c in self.columns(m)))
            rows = df.select(F.explode(own).alias("a")).where("a IS NOT NULL")
            out = rows if out is None else out.unionAll(rows)
        return out.distinct()

    def star(self, s, triples: list[Triple]) -> list[Frame]:
        """Patterns on one subject: those on one table are one scan."""
        by_table: dict[str, list] = {}
        rest: list[Triple] = []
        for t in triples:
            at = self.find(t.p.term) if t.g is None else None
            if at:
                by_table.setdefault(at[0].name, []).append((at[1], t))
            else:
                rest.append(t)
        if len(by_table) == 1:
            # the class of a table's rows adds nothing but a check
            name = next(iter(by_table))
            own = [t for t in rest if t.p.term == TYPE and t.o == Iri(f"urn:{name}")]
            rest = [t for t in rest if t not in own]
        return [self._rows(self.mappings[n], s, cols) for n, cols in by_table.items()] + [self.scan(t) for t in rest]

    def _rows(self, m: Mapping, s, wanted: list[tuple[str, Triple]]) -> Frame:
        df = self.tables[m.name]
        names: dict[str, tuple] = {}
        bound = 0
        tests = []

        def end(x, column, map_: TermMap, kind: str) -> None:
            nonlocal bound
            tests.append(column.isNotNull())
            if not isinstance(x, Var):
                c = map_.raw(x, kind)
                tests.append(column == c if c is not None else F.lit(False))
                bound += 1
            elif x.name in names:
                other, m2, _ = names[x.name]
                tests.append(column == other if m2 == map_ else map_.key(column) == m2.key(other))
            else:
                names[x.name] = (column, map_, fresh(x.name))

        subject = self.subject(m)
        if not isinstance(s, Var) or m.key:
            end(s, subject, self.subject_map(m), df.schema[m.key].dataType.simpleString() if m.key else "string")
        else:
            names[s.name] = (subject, self.subject_map(m), fresh(s.name))
        for column, t in wanted:
            end(t.o, F.col(column), self.object_map(m, column), df.schema[column].dataType.simpleString())
        for test in tests:
            df = df.where(test)
        many = frozenset(n for n in names if not (m.key and isinstance(s, Var) and n == s.name))
        return Frame(df.select(*(c.alias(a) for c, _, a in names.values())), {n: Bound(a, map_) for n, (_, map_, a) in names.items()}, bound=bound, many=many)

    def scan(self, t: Triple) -> Frame:
        """One pattern: over all tables and columns where the predicate is a variable or a negated set."""
        if t.g is not None:
            return self._none(t)
        p = t.p.term if isinstance(t.p, Step) else None
        at = self.find(p)
        if at:
            return self._rows(at[0], t.s, [(at[1], t)])
        refused = set(t.p.terms) if isinstance(t.p, Not) else set()
        frames = []
        for m in self.mappings.values():
            cells = [(c, TYPE if c is None else Iri(f"urn:{m.name}#{c}")) for c in [None, *self.columns(m)]]
            cells = [(c, q) for c, q in cells if q not in refused and (not isinstance(p, Iri) or p == q)]
            f = self._wide(m, cells, t) if cells else None
            if f is not None:
                frames.append(f)
        return union(frames, self.spark) if frames else self._none(t)

    def _wide(self, m: Mapping, cells: list[tuple[str | None, Iri]], t: Triple) -> Frame | None:
        """One pattern over several columns of a table: one scan, each row's cells one below another. None if nothing can match."""
        df = self.tables[m.name]
        subject, own = self.subject(m), self.subject_map(m)
        if not isinstance(t.s, Var):
            raw = own.raw(t.s, df.schema[m.key].dataType.simpleString() if m.key else "string")
            if raw is None:
                return None
            df = df.where(subject == raw)
        held = []  # predicate, key of the object, and whether this row has it
        for c, q in cells:
            if c is None:
                k, there = F.lit(f"Iurn:{m.name}"), None if isinstance(t.o, Var) else F.lit(key(t.o) == f"Iurn:{m.name}")
            else:
                k, there = self.object_map(m, c).key(F.col(c)), F.col(c).isNotNull()
                if not isinstance(t.o, Var):
                    raw = self.object_map(m, c).raw(t.o, df.schema[c].dataType.simpleString())
                    if raw is None:
                        continue
                    there = F.col(c) == raw
            held.append((q, k, there))
        if not held:
            return None
        tests = [x for _, _, x in held if x is not None]
        if len(tests) == len(held):
            df = df.where(reduce(lambda a, b: a | b, tests))
        cell = F.explode(F.array(*(F.struct(F.lit(key(q)).alias("p"), (k if x is None else F.when(x, k)).alias("o")) for q, k, x in held)))
        at = fresh("cell")
        rows = df.select(subject.alias(at + "s"), cell.alias(at)).where(F.col(at)["o"].isNotNull())
        names: dict[str, tuple] = {}
        ends = [(t.s, F.col(at + "s"), own), *([(t.p.term, F.col(at)["p"], None)] if isinstance(t.p, Step) else []), (t.o, F.col(at)["o"], None)]
        full = lambda c, how: how.key(c) if how else c
        for x, c, how in ends:
            if not isinstance(x, Var):
                continue
            if x.name in names:
                rows = rows.where(full(c, how) == full(*names[x.name][:2]))
            else:
                names[x.name] = (c, how, fresh(x.name))
        out = Frame(rows.select(*(c.alias(a) for c, _, a in names.values())), {n: Bound(a, how) for n, (_, how, a) in names.items()})
        out.remake = (out.df, lambda other: self._narrowed(m, cells, t, out, other))
        return out

    def _narrowed(self, m: Mapping, cells: list[tuple[str | None, Iri]], t: Triple, whole: Frame, other: Frame) -> Frame | None:
        """The cells whose objects can be what `other` binds."""
        b = other.vars.get(t.o.name) if isinstance(t.o, Var) else None
        if b is None or not b.certain or b.map is None:
            return whole
        keep = [(c, q) for c, q in cells if not (b.map.kind != "iri" or not f"urn:{m.name}".startswith(b.map.head) if c is None else apart(Bound("", self.object_map(m, c)), b))]
        return whole if len(keep) == len(cells) else self._wide(m, keep, t) if keep else None

    def _none(self, t: Triple) -> Frame:
        vars_ = {x.name: Bound(fresh(x.name)) for x in (t.s, t.o, t.g, *([t.p.term] if isinstance(t.p, Step) else [])) if isinstance(x, Var)}
        return Frame(self.spark.createDataFrame([], ", ".join(f"`{b.column}` string" for b in vars_.values()) or "x int"), vars_)


#: The tables of the test data.
TPCH = [
    Mapping("region", "r_regionkey"),
    Mapping("nation", "n_nationkey", {"n_regionkey": "region"}),
    Mapping("customer", "c_custkey", {"c_nationkey": "nation"}),
    Mapping("supplier", "s_suppkey", {"s_nationkey": "nation"}),
    Mapping("part", "p_partkey"),
    Mapping("orders", "o_orderkey", {"o_custkey": "customer"}),
    Mapping("lineitem", None, {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}),
    Mapping("events", "event_id"),
]
