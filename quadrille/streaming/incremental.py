"""Queries that are kept up to date while quads are added and removed.

Changes are rows (s, p, o, g, w) with w = 1 for an addition and -1 for a removal. The store is a set: adding what is there and
removing what isn't there changes nothing. Results are a bag: rows with counts. For queries that are linear in each pattern (joins,
filters, unions, paths without repetition) a batch of changes costs one plan a pattern, in which that pattern is read from the
changes alone; the new store stands for the patterns before it and the old one for those after it. A query with one FILTER [NOT] EXISTS
beside such patterns keeps counts of what the filter's group has for each binding of the variables that it shares: solutions come and
go where a count leaves 0 or falls to it. Any other query is worked out again over the new store, and its counts are compared with
those before.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.operators.frames import Frame
from quadrille.plans.algebra import Alternative, Bind, Exists, Filter, Group, Inverse, Not, Select, Sequence, Step, Triple, Union, Values, mentioned, visible
from quadrille.plans.parser import parse
from quadrille.plans.planner import Planner
from quadrille.sources.quads import SCHEMA, QuadSource
from quadrille.storage import drop_folder, filesystem, fresh_path

QUAD = ["s", "p", "o", "g"]
WEIGHTED = SCHEMA + ", w bigint"


def consolidated(changes: DataFrame) -> DataFrame:
    """Changes of one quad added up; what cancels out is gone."""
    return changes.groupBy(*QUAD).agg(F.sum("w").alias("w")).where("w <> 0")


def effective(changes: DataFrame, store: DataFrame | None) -> DataFrame:
    """The changes that a set makes: +1 for quads that were not there, -1 for those that were. store: rows with w, whose sum is 1 for
    what is there. Only its rows that the changes touch are shuffled."""
    if store is None:
        return consolidated(changes).where("w > 0").select(*QUAD, F.lit(1).cast("bigint").alias("w"))
    touch = changes.select(*(F.col(c).alias(c + "_") for c in QUAD)).distinct()
    same = (F.col("s") == F.col("s_")) & (F.col("p") == F.col("p_")) & (F.col("o") == F.col("o_")) & F.col("g").eqNullSafe(F.col("g_"))
    had = store.join(touch, same, "left_semi")
    both = changes.select(*QUAD, "w", F.lit(0).cast("bigint").alias("had")).union(had.select(*QUAD, F.lit(0).cast("bigint"), "w"))
    now = both.groupBy(*QUAD).agg(F.sum("w").alias("w"), F.sum("had").alias("had"))
    return now.where("(w > 0 AND had = 0) OR (w < 0 AND had > 0)").select(*QUAD, F.when(F.col("w") > 0, 1).otherwise(-1).cast("bigint").alias("w"))


def _plain_path(p) -> bool:
    match p:
        case Step() | Not():
            return True
        case Inverse(x):
            return _plain_path(x)
        case Sequence(ps) | Alternative(ps):
            return all(map(_plain_path, ps))
    return False


def _linear_part(part) -> bool:
    match part:
        case Triple(_, p, _, _):
            return _plain_path(p)
        case Filter(e):
            return not isinstance(e, Exists)
        case Bind() | Values():
            return True
        case Group(parts):
            return all(map(_linear_part, parts))
        case Union(groups):
            return all(map(_linear_part, groups))
    return False


def _plain_query(q: Select) -> bool:
    return not (q.distinct or q.ask or q.group_by or q.having or q.order_by or q.limit is not None or q.offset) and all(o.expression is None for o in q.outputs or [])


def is_linear(q: Select) -> bool:
    return _plain_query(q) and _linear_part(q.body)


@dataclass(frozen=True)
class Guard:
    """A query that is linear but for one [NOT] EXISTS: its other patterns, the filter's group, and the variables that both bind."""

    outer: Group
    inner: Group
    shared: tuple[str, ...]
    negated: bool


def guarded(q: Select) -> Guard | None:
    tests = [p.expression if isinstance(p, Filter) else p for p in q.body.parts if isinstance(p, Exists) or isinstance(p, Filter) and isinstance(p.expression, Exists)]
    rest = tuple(p for p in q.body.parts if not (isinstance(p, Exists) or isinstance(p, Filter) and isinstance(p.expression, Exists)))
    if len(tests) != 1 or not _plain_query(q) or not all(map(_linear_part, (*rest, *tests[0].group.parts))):
        return None
    sure = lambda parts: {v for p in parts if isinstance(p, Triple) for v in visible(p)}
    inner = tests[0].group
    own = set(visible(inner))
    shared = own & set(visible(q.body))
    outside = {v for p in inner.parts if isinstance(p, Filter) for v in mentioned(p.expression)} - own
    if outside or not shared <= sure(rest) & sure(inner.parts):  # a filter looks outside, or something may be unbound
        return None
    return Guard(Group(rest), inner, tuple(sorted(shared)), tests[0].negated)


def branches(g: Group) -> list[Group]:
    """Groups without unions whose solutions together are those of the group."""
    out: list[tuple] = [()]
    for part in g.parts:
        match part:
            case Union(groups):
                options = [x for y in groups for x in branches(y)]
            case Group():
                options = branches(part)
            case Triple(s, p, o, gr):
                options = [Triple(s, x, o, gr) for x in _path_branches(p)]
            case _:
                options = [part]
        out = [(*a, b) for a in out for b in options]
    return [Group(a) for a in out]


def _path_branches(p) -> list:
    match p:
        case Alternative(ps):
            return [y for x in ps for y in _path_branches(x)]
        case Inverse(x):
            return [Inverse(y) for y in _path_branches(x)]
        case Sequence(ps):
            out: list[tuple] = [()]
            for x in ps:
                out = [(*a, b) for a in out for b in _path_branches(x)]
            return [Sequence(a) for a in out]
    return [p]


class _Turn:
    """A source whose scans before number `at` see the new store, that one the changes, later ones the old store."""

    def __init__(self, old: QuadSource, changes: QuadSource, new: QuadSource, at: int):
        self.spark, self.old, self.changes, self.new, self.at, self.n = old.spark, old, changes, new, at, 0

    def scan(self, t: Triple) -> Frame:
        self.n += 1
        k = self.n - 1
        return (self.new if k < self.at else self.changes if k == self.at else self.old).scan(t)

    def star(self, s, triples: list[Triple]) -> list[Frame]:
        return [self.scan(t) for t in triples]


@dataclass(frozen=True)
class State:
    """What a live query has taken in: the last epoch, and tables (path, rows) that are read together. store: quads with w; counts:
    result rows with n; keys: bindings that an EXISTS has solutions for, with n; waiting: changes not yet applied."""

    epoch: int = -1
    store: tuple[tuple[str, int], ...] = ()
    counts: tuple[tuple[str, int], ...] = ()
    keys: tuple[tuple[str, int], ...] = ()
    waiting: tuple[tuple[str, int], ...] = ()

    def to_json(self) -> str:
        return json.dumps(self.__dict__)

    @classmethod
    def of_json(cls, text: str) -> State:
        return cls(**{k: tuple(map(tuple, v)) if isinstance(v, list) else v for k, v in json.loads(text).items()})


class LiveQuery:
    """A query over a store that changes. deferred: changes wait, cancelling each other out, until results are asked for.

    The store is a log: a table of quads, then tables of changes, all with weights that add up, so a batch writes no more than its own
    changes and those of the result. When the later tables of a log hold more rows than its first they are made one. The state moves on
    only when all of a batch is written; a batch that fails may come again. folder: where the state is kept; a query that is
    given the same folder goes on from there.
    """

    def __init__(self, spark: SparkSession, query: str, deferred: bool = False, checked: bool = False, folder: str | None = None):
        self.spark, self.query, self.deferred, self.checked = spark, parse(query), deferred, checked
        self.names = self.query.variables
        self.linear, self.guard = is_linear(self.query), guarded(self.query)
        #: The column that says how often a result is there: n, or _n and so on where a variable has that name.
        self.n = "n"
        while self.n in (x.lower() for x in self.names):
            self.n = "_" + self.n
        self.kind = ", ".join([*(f"`{n}` string" for n in self.names), f"{self.n} bigint"])
        self.folder: str | None = None
        self.state = State()
        if folder is not None:
            self.keep(folder)
        if not self.linear and self.guard is None and not self.state.counts and self.state.epoch < 0:
            # some queries have solutions over no data at all
            empty = spark.createDataFrame([], SCHEMA)
            self.state = replace(self.state, counts=self._log(self._counted(self._keys(Planner(QuadSource(empty)).select(self.query)).withColumn(self.n, F.lit(1).cast("bigint"))), "live-results"))

    def keep(self, folder: str) -> None:
        """Keeps the state in this folder from now on, and takes over what is there."""
        sc = self.spark.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(folder)
        fs = at.getFileSystem(sc._jsc.hadoopConfiguration())  # a path without a scheme means the same to Spark and to us
        self.folder = at.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString().rstrip("/")
        system, path = filesystem(self.folder)
        if system.get_file_info(f"{path}/state.json").type.name == "File":
            with system.open_input_file(f"{path}/state.json") as f:
                self.state = State.of_json(f.read().decode())

    def _settle(self, state: State) -> None:
        """The one place where the state moves on."""
        if self.folder is not None:
            system, path = filesystem(self.folder)
            system.create_dir(path, recursive=True)
            with system.open_output_stream(f"{path}/state.writing") as f:
                f.write(state.to_json().encode())
            system.move(f"{path}/state.writing", f"{path}/state.json")
        old, self.state = self.state, state
        for at, _ in set(old.store) - set(state.store):
            drop_folder(at)

    def _log(self, df: DataFrame, what: str) -> tuple[tuple[str, int], ...]:
        """df as a table of a log; nothing for no rows."""
        path = f"{self.folder}/{what}-{uuid.uuid4().hex}" if self.folder else fresh_path(self.spark, what)
        df.write.parquet(path)
        rows = self.spark.read.schema(df.schema).parquet(path).count()
        return ((path, rows),) if rows else ()

    def _read(self, log, schema: str) -> DataFrame | None:
        return self.spark.read.schema(schema).parquet(*(path for path, _ in log)) if log else None

    @staticmethod
    def _long(log) -> bool:
        return len(log) > 1 and (len(log) > 32 or sum(n for _, n in log[1:]) > log[0][1])

    @property
    def epoch(self) -> int:
        return self.state.epoch

    @property
    def store(self) -> DataFrame:
        """The quads as they are now."""
        rows = self._read(self.state.store, WEIGHTED)
        if rows is None:
            return self.spark.createDataFrame([], SCHEMA)
        return (consolidated(rows) if len(self.state.store) > 1 else rows).select(*QUAD)

    @property
    def counts(self) -> DataFrame:
        rows = self._read(self.state.counts, self.kind)
        if rows is None:
            return self.spark.createDataFrame([], self.kind)
        return self._counted(rows) if len(self.state.counts) > 1 else rows

    def _keys(self, f: Frame) -> DataFrame:
        cols = [f.vars[n].key().alias(n) if n in f.vars else F.lit(None).cast("string").alias(n) for n in self.names]
        return f.table(self.spark).select(*cols, *([F.col(f.weight).alias(self.n)] if f.weight else []))

    def _counted(self, rows: DataFrame) -> DataFrame:
        if not self.names:
            return rows.agg(F.coalesce(F.sum(self.n), F.lit(0)).cast("bigint").alias(self.n)).where(F.col(self.n) != 0)
        return rows.groupBy(*self.names).agg(F.sum(self.n).cast("bigint").alias(self.n)).where(F.col(self.n) != 0)

    def push(self, changes: DataFrame, epoch: int | None = None) -> DataFrame | None:
        """Takes a batch; returns the changes of the result (a column a variable, of term keys, and n), or None if they wait. A batch
        whose epoch was seen already is left out, so that a stream may repeat it."""
        if epoch is not None and epoch <= self.state.epoch:
            return None
        at = self.state.epoch if epoch is None else epoch
        rows = self._log(changes.select(*QUAD, F.col("w").cast("bigint").alias("w")), "batch")
        if self.deferred:
            self._settle(replace(self.state, epoch=at, waiting=self.state.waiting + rows))
            return None
        return self._apply(rows, at)

    def _apply(self, batch, epoch: int) -> DataFrame:
        empty = self.spark.createDataFrame([], self.kind)
        if not batch:
            self._settle(replace(self.state, epoch=epoch, waiting=()))
            return empty
        old = self._read(self.state.store, WEIGHTED)
        # opposite changes of a quad cancel out within a batch
        changed = self._log(effective(self._read(batch, WEIGHTED), old), "changes")
        if not changed:
            self._settle(replace(self.state, epoch=epoch, waiting=()))
            return empty
        changes, log = self._read(changed, WEIGHTED), self.state.store + changed
        if self._long(log):
            # sorted by predicate and subject: a scan for either skips what it doesn't need
            log = self._log(consolidated(self._read(log, WEIGHTED)).repartitionByRange("p", "s").sortWithinPartitions("p", "s"), "store")
        new = self._read(log, WEIGHTED)
        keys = self.state.keys
        if self.linear:
            delta = self._delta(self.query.body, self.names, (), old, changes, new)
        elif self.guard is not None:
            delta, keys = self._guarded(old, changes, new)
        else:
            store = self.spark.createDataFrame([], SCHEMA) if new is None else (consolidated(new) if len(log) > 1 else new).select(*QUAD)
            now = self._keys(Planner(QuadSource(store, distinct=False)).select(self.query)).withColumn(self.n, F.lit(1).cast("bigint"))
            delta = now.union(self.counts.select(*(F.col(f"`{n}`") for n in self.names), -F.col(self.n)))
        change = self._log(self._counted(delta), "result-changes")
        counts = self.state.counts + change
        if self._long(counts):
            counts = self._log(self._counted(self._read(counts, self.kind)), "live-results")
        if self.checked and counts and self._counted(self._read(counts, self.kind)).where(F.col(self.n) < 0).head(1):
            raise AssertionError("a result is there fewer than 0 times")
        self._settle(State(epoch, log, counts, keys))
        return self._read(change, self.kind) if change else empty

    def _part(self, source, group: Group, names, shared) -> DataFrame:
        """Solutions of a group: columns of names, of shared variables (_k0, ...), and how often."""
        f = Planner(source).group(group)
        cols = [f.vars[n].key().alias(n) if n in f.vars else F.lit(None).cast("string").alias(n) for n in names]
        cols += [f.vars[n].key().alias(f"_k{i}") for i, n in enumerate(shared)]
        return f.table(self.spark).select(*cols, (F.col(f.weight) if f.weight else F.lit(1)).cast("bigint").alias(self.n))

    def _delta(self, group: Group, names, shared, old: DataFrame | None, changes: DataFrame, new: DataFrame | None) -> DataFrame:
        """What changes in the solutions of a linear group: a plan a pattern, in which that one sees the changes alone."""
        none = self.spark.createDataFrame([], WEIGHTED)
        a, d, b = QuadSource(none if old is None else old, "w"), QuadSource(changes, "w"), QuadSource(none if new is None else new, "w")
        parts = []
        for g in branches(group):
            first = _Turn(a, d, b, -1)
            Planner(first).group(g)
            for i in range(first.n):
                if i + 1 == first.n or old is not None:  # else a later pattern would see the empty store
                    parts.append(self._part(_Turn(a, d, b, i), g, names, shared))
        if not parts:
            kind = ", ".join([*(f"`{n}` string" for n in (*names, *(f"_k{i}" for i in range(len(shared))))), f"{self.n} bigint"])
            return self.spark.createDataFrame([], kind)
        return reduce(DataFrame.union, parts)

    def _guarded(self, old: DataFrame | None, changes: DataFrame, new: DataFrame | None):
        """The change of the result, and the new keys: A changed, by the filter as it is now; and A as it was, where the filter changed."""
        g, n = self.guard, self.n
        by = [f"_k{i}" for i in range(len(g.shared))]
        kind = ", ".join([*(f"{k} string" for k in by), "one int", f"{n} bigint"])
        added = lambda df: df.groupBy(*by, "one").agg(F.sum(n).cast("bigint").alias(n)).where(F.col(n) != 0)
        moved = self._log(added(self._delta(g.inner, (), g.shared, old, changes, new).withColumn("one", F.lit(1)).select(*by, "one", n)), "keys")
        before = self.state.keys
        keys = before + moved
        if self._long(keys):
            keys = self._log(added(self._read(keys, kind)), "keys")
        none = self.spark.createDataFrame([], kind)
        at = lambda log: self._read(log, kind) if log else none
        on = [*by, "one"]
        # which of these bindings have solutions
        there = lambda log, some: added(at(log).join(some.select(*on).distinct(), on, "left_semi")).where(F.col(n) > 0).select(*on)
        how = "left_anti" if g.negated else "left_semi"
        fresh_ = self._delta(g.outer, self.names, g.shared, old, changes, new).withColumn("one", F.lit(1))
        fresh_ = self._read(rows, ", ".join([*(f"`{x}` string" for x in (*self.names, *by)), f"{n} bigint", "one int"])) if (rows := self._log(fresh_, "outer")) else None
        delta = self.spark.createDataFrame([], self.kind)
        if fresh_ is not None:
            delta = fresh_.join(there(keys, fresh_), on, how).select(*(F.col(f"`{x}`") for x in self.names), n)
        if moved and old is not None:
            touched = self._read(moved, kind)
            was, now = there(before, touched), there(keys, touched)
            turned = now.join(was, on, "left_anti").withColumn("t", F.lit(1)).union(was.join(now, on, "left_anti").withColumn("t", F.lit(-1)))
            whole = self._part(QuadSource(old, "w"), g.outer, self.names, g.shared).withColumn("one", F.lit(1))
            sign = -1 if g.negated else 1
            delta = delta.union(whole.join(turned, on).select(*(F.col(f"`{x}`") for x in self.names), (F.col(n) * F.col("t") * sign).alias(n)))
        return delta, keys

    def results(self) -> DataFrame:
        """The results as they are now: a column a variable, of term keys, and n (or self.n), how often."""
        if self.state.waiting:
            self._apply(self.state.waiting, self.state.epoch)
        return self.counts

    def subscribe(self, stream: DataFrame, checkpoint: str | None = None):
        """Follows a stream of changes, batch by batch; stop() of what is returned ends it. With a checkpoint, the query's own state is
        kept beside it, so that a new query that follows the same stream goes on with the results that were there."""
        if checkpoint and self.folder is None:
            self.keep(checkpoint.rstrip("/") + "-live")
        out = stream.writeStream.foreachBatch(lambda df, epoch: self.push(df, epoch))
        return (out.option("checkpointLocation", checkpoint) if checkpoint else out).start()
