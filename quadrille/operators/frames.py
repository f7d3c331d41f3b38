"""Solution sets as DataFrames, and the joins between them.

A frame has one column a variable. A variable that comes from a table column keeps that column as it is, with a term map that says
which terms its values stand for; joins and filters then work on the raw values, and filters reach the scan. Other variables hold
term keys (quadrille.terms). NULL is unbound; `certain` variables never are.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.storage import estimated_bytes
from quadrille.terms import BOOLEAN, DATETIME, DOUBLE, INTEGER, Iri, Literal, Term, key

_number = itertools.count()

#: Joins that multiply rows are dealt out where the product of both sides' bytes is beyond this, to so many parts a core.
SPREAD_PRODUCT, SPREAD_PARTS = 1 << 30, 4
#: Of them, those whose smaller side is estimated at most at this broadcast it.
SPREAD_BROADCAST = 2 << 20


@dataclass(frozen=True)
class TermMap:
    """Terms made of raw values: IRIs with a prefix, or literals of a datatype."""

    kind: str  # "iri" or "lit"
    head: str

    def key(self, raw: Column) -> Column:
        text = F.date_format(raw, "yyyy-MM-dd'T'HH:mm:ss") if self.kind == "lit" and self.head == DATETIME else raw.cast("string")
        return F.concat(F.lit("I" + self.head if self.kind == "iri" else f"L{self.head}|"), text)

    def raw(self, term: Term, kind: str) -> Column | None:
        """The raw value (of SQL type `kind`) of a constant, or None if no value stands for it."""
        if self.kind == "iri" and isinstance(term, Iri) and term.value.startswith(self.head):
            return F.lit(term.value[len(self.head) :]).try_cast(kind)
        if self.kind == "lit" and isinstance(term, Literal) and term.datatype == self.head and not term.lang:
            return F.lit(term.value).try_cast(kind)
        return None


def fresh(name: str) -> str:
    return f"{name}__{next(_number)}"


@dataclass(frozen=True)
class Bound:
    column: str
    map: TermMap | None = None
    certain: bool = True

    @property
    def col(self) -> Column:
        return F.col(self.column)

    def key(self) -> Column:
        return self.map.key(self.col) if self.map else self.col


@dataclass
class Frame:
    """Solutions; df is None for the one empty solution. weight: the column of multiplicities, if they are carried."""

    df: DataFrame | None
    vars: dict[str, Bound]
    weight: str | None = None
    #: How selective it is taken to be: constants and filters on it.
    bound: int = 0
    #: Variables of which many rows may have one value: a join on these alone multiplies rows.
    many: frozenset[str] = frozenset()
    #: The frames that df is the union of, beside that df: what is made of it has another.
    parts: tuple[DataFrame, list[Frame]] | None = None
    #: How a scan of many cells is made again for what it is joined with, beside its df.
    remake: tuple[DataFrame, Callable[[Frame], Frame | None]] | None = None

    def table(self, spark: SparkSession) -> DataFrame:
        return self.df if self.df is not None else spark.range(1).select()

    def renamed(self) -> Frame:
        """The same with column names of its own."""
        if self.df is None:
            return self
        new = {n: replace(b, column=fresh(n)) for n, b in self.vars.items()}
        w = fresh("w") if self.weight else None
        cols = [self.vars[n].col.alias(b.column) for n, b in new.items()] + ([F.col(self.weight).alias(w)] if w else [])
        return Frame(self.df.select(*cols), new, w, self.bound, self.many)

    def keyed(self, names) -> Frame:
        """With these variables as term keys."""
        todo = [n for n in names if n in self.vars and self.vars[n].map]
        if not todo:
            return self
        cols = [(b.key() if n in todo else b.col).alias(b.column) for n, b in self.vars.items()] + ([F.col(self.weight)] if self.weight else [])
        return replace(self, df=self.df.select(*cols), vars={n: replace(b, map=None) if n in todo else b for n, b in self.vars.items()})

    def where(self, condition: Column) -> Frame:
        return replace(self, df=self.df.where(condition), bound=self.bound + 1)

    def only(self, names) -> Frame:
        keep = {n: b for n, b in self.vars.items() if n in names}
        return replace(self, df=self.df.select(*(b.col for b in keep.values()), *([F.col(self.weight)] if self.weight else [])), vars=keep) if self.df is not None else self


def equal(a: Bound, b: Bound) -> Column:
    """Both are bound to one term."""
    if a.map == b.map:
        return a.col == b.col
    if a.map and b.map and a.map.kind != b.map.kind:
        return F.lit(False)
    return a.key() == b.key()


def apart(a: Bound, b: Bound) -> bool:
    """No term is a value of both, by their maps alone."""
    if not (a.map and b.map):
        return False
    x, y = (f"I{m.head}" if m.kind == "iri" else f"L{m.head}|" for m in (a.map, b.map))
    return not (x.startswith(y) or y.startswith(x))


def narrowed(f: Frame, other: Frame) -> Frame | None:
    """f without those parts of a union, or cells of a scan, whose terms can't be those of `other`, by their maps: none of their solutions would be
    joined with any of its. None if nothing is left."""
    if any(b.certain and n in other.vars and other.vars[n].certain and apart(b, other.vars[n]) for n, b in f.vars.items()):
        return None
    if f.remake is not None and f.remake[0] is f.df:
        return f.remake[1](other)
    if f.parts is None or f.parts[0] is not f.df:
        return f
    frames = [narrowed(x, other) for x in f.parts[1]]
    if all(a is b for a, b in zip(frames, f.parts[1])):
        return f
    keep = [x for x in frames if x is not None]
    # variables are keys as they were, so values look the same
    return replace(union(keep, f.df.sparkSession), bound=f.bound).keyed([n for n, b in f.vars.items() if b.map is None]) if keep else None


def compatible(left: Frame, right: Frame, shared: list[str]) -> Column | None:
    """The shared variables agree where both are bound; equalities of certain ones come first, as keys of an equi-join."""
    out = None
    for n in sorted(shared, key=lambda n: not (left.vars[n].certain and right.vars[n].certain)):
        a, b = left.vars[n], right.vars[n]
        test = equal(a, b)
        if not a.certain:
            test = a.col.isNull() | test
        if not b.certain:
            test = b.col.isNull() | test
        out = test if out is None else out & test
    return out


def merged(left: Frame, right: Frame, outer: bool = False) -> tuple[list[Column], dict[str, Bound]]:
    """Columns and variables of left and right side by side, shared variables once."""
    cols, names = [], {}
    for n, a in left.vars.items():
        b = right.vars.get(n)
        if b is None or a.certain:
            cols.append(a.col)
            names[n] = a
            continue
        c = fresh(n)
        if a.map == b.map:
            cols.append(F.coalesce(a.col, b.col).alias(c))
            names[n] = Bound(c, a.map, b.certain and not outer)
        else:
            cols.append(F.coalesce(a.key(), b.key()).alias(c))
            names[n] = Bound(c, None, b.certain and not outer)
    for n, b in right.vars.items():
        if n not in left.vars:
            cols.append(b.col)
            names[n] = replace(b, certain=b.certain and not outer)
    return cols, names


def join(left: Frame, right: Frame) -> Frame:
    """All compatible pairs, merged."""
    if left.df is None:
        return right
    if right.df is None:
        return left
    a, b = narrowed(left, right), narrowed(right, left)
    left, right = a or replace(left, df=left.df.where(F.lit(False))), b or replace(right, df=right.df.where(F.lit(False)))
    right = right.renamed()
    shared = [n for n in left.vars if n in right.vars]
    condition = compatible(left, right, shared)
    if shared and set(shared) <= left.many & right.many and all(left.vars[n].map == right.vars[n].map for n in shared):
        df = _multiplied(left, right, condition, shared)
    else:
        df = left.df.crossJoin(right.df) if condition is None else left.df.join(right.df, condition)
    cols, names = merged(left, right)
    weight = None
    if left.weight or right.weight:
        weight = fresh("w")
        cols.append((F.col(left.weight) * F.col(right.weight) if left.weight and right.weight else F.col(left.weight or right.weight)).alias(weight))
    return Frame(df.select(*cols), names, weight, left.bound + right.bound, left.many | right.many)


def _multiplied(left: Frame, right: Frame, condition: Column, shared: list[str]) -> DataFrame:
    """A join of frames that both may have many rows a key. It may give far more rows than it reads, and keys may be few, so its work is dealt
    out by rows of the larger side: neither the splits of files nor the number of keys bounds the tasks."""
    sizes = [estimated_bytes(f.df) for f in (left, right)]
    if sizes[0] * sizes[1] < SPREAD_PRODUCT:
        return left.df.join(right.df, condition)
    parts = SPREAD_PARTS * left.df.sparkSession.sparkContext.defaultParallelism
    large, small = (left, right) if sizes[0] >= sizes[1] else (right, left)
    if min(sizes) <= SPREAD_BROADCAST:
        return large.df.repartition(parts).join(F.broadcast(small.df), condition)
    # a copy of each row of the smaller side for each part of the larger one; sorted, so both sides spill
    a, b = fresh("_part"), fresh("_part")
    dealt = large.df.withColumn(a, F.pmod(F.xxhash64(*large.df.columns), F.lit(parts)).cast("int")).repartition(parts, *(large.vars[n].col for n in shared), a)
    copies = small.df.withColumn(b, F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(parts, *(small.vars[n].col for n in shared), b)
    return dealt.join(copies.hint("merge"), condition & (F.col(a) == F.col(b)))


def left_join(left: Frame, right: Frame, condition_of, spark: SparkSession) -> Frame:
    """Left solutions with their compatible right ones that meet a condition, or alone. condition_of: variables -> Column or None."""
    right = right.renamed()
    base = Frame(left.table(spark), left.vars, left.weight, left.bound)
    condition = compatible(base, right, [n for n in base.vars if n in right.vars])
    cols, names = merged(base, right, outer=True)
    extra = condition_of({**right.vars, **{n: b for n, b in base.vars.items() if b.certain or n not in right.vars}})
    both = extra if condition is None else condition if extra is None else condition & extra
    df = base.df.join(right.table(spark), both if both is not None else F.lit(True), "left")
    return Frame(df.select(*cols, *([F.col(base.weight)] if base.weight else [])), names, base.weight, base.bound)


def semi_join(left: Frame, right: Frame, negated: bool, condition_of, spark: SparkSession) -> Frame:
    """Left solutions that have (or lack) a compatible right one that meets a condition."""
    right = right.renamed()
    base = Frame(left.table(spark), left.vars, left.weight, left.bound)
    shared = [n for n in base.vars if n in right.vars]
    condition = compatible(base, right, shared)
    extra = condition_of({**base.vars, **right.vars})
    both = extra if condition is None else condition if extra is None else condition & extra
    table = right.table(spark)
    if both is None:  # all or nothing: one row tells
        table, both = table.limit(1), F.lit(True)
    return replace(base, df=base.df.join(table, both, "left_anti" if negated else "left_semi"), bound=base.bound + 1)


def minus(left: Frame, right: Frame, spark: SparkSession) -> Frame:
    """Left solutions without a compatible right one that shares a bound variable."""
    right = right.renamed()
    shared = [n for n in left.vars if n in right.vars]
    if not shared:
        return left
    overlap = None
    for n in shared:
        test = left.vars[n].col.isNotNull() & right.vars[n].col.isNotNull()
        overlap = test if overlap is None else overlap | test
    condition = compatible(left, right, shared)
    if not any(left.vars[n].certain and right.vars[n].certain for n in shared):
        condition = condition & overlap
    return replace(left, df=left.df.join(right.table(spark), condition, "left_anti"))


def union(frames: list[Frame], spark: SparkSession) -> Frame:
    """All solutions of all frames; what a frame doesn't bind is unbound."""
    names = list(dict.fromkeys(n for f in frames for n in f.vars))
    weighted = any(f.weight for f in frames)
    out: dict[str, Bound] = {}
    for n in names:
        maps = {f.vars[n].map for f in frames if n in f.vars}
        types = {f.df.schema[f.vars[n].column].dataType for f in frames if n in f.vars and f.df is not None}
        one = maps.pop() if len(maps) == 1 and len(types) == 1 else None
        out[n] = Bound(fresh(n), one, all(n in f.vars and f.vars[n].certain for f in frames))
    w = fresh("w") if weighted else None
    parts = []
    for f in frames:
        cols = []
        for n, b in out.items():
            if n not in f.vars:
                cols.append(F.lit(None).cast("string" if b.map is None else next(g.df.schema[g.vars[n].column].dataType for g in frames if n in g.vars)).alias(b.column))
            else:
                cols.append((f.vars[n].col if b.map else f.vars[n].key()).alias(b.column))
        if w:
            cols.append((F.col(f.weight) if f.weight else F.lit(1)).cast("bigint").alias(w))
        parts.append(f.table(spark).select(*cols))
    df = parts[0]
    for p in parts[1:]:
        df = df.unionAll(p)
    return Frame(df, out, w, parts=(df, frames))
