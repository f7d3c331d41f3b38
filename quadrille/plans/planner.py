"""Algebra as DataFrame plans."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.functions.expressions import aggregate, compile_expression, map_of, ordering, raw, term_key, truth
from quadrille.operators.frames import Bound, Frame, TermMap, fresh, join, left_join, minus, semi_join, union
from quadrille.operators.paths import closure
from quadrille.plans.algebra import Aggregate, Alternative, Bind, Call, Const, Exists, Filter, Group, Inverse, Minus, Not, Op, Optional_, Output, Repeat, Select, Sequence, Step, SubSelect, Triple, Union, Values, Var, aggregates, mentioned, visible
from quadrille.plans.parser import QueryError
from quadrille.storage import written
from quadrille.terms import BOOLEAN, DOUBLE, INTEGER, STRING, Literal, key


class Planner:
    """Plans over one source. A source has spark, scan(triple) and star(subject, [(predicate, object)])."""

    def __init__(self, source):
        self.source, self.spark, self.paths = source, source.spark, 0

    # whole queries
    def select(self, q: Select) -> Frame:
        f = self.group(q.body)
        if q.ask:
            return f
        found = [a for o in q.outputs or [] if o.expression is not None for a in aggregates(o.expression)] + [a for h in q.having for a in aggregates(h)] + [a for e, _ in q.order_by for a in aggregates(e)]
        outputs, having, order = q.outputs, q.having, q.order_by
        if found or q.group_by:
            f, swap = self.grouped(f, q, found)
            outputs = [Output(o.var, swap(o.expression) if o.expression is not None else None) for o in outputs or []]
            having = [swap(h) for h in having]
            order = [(swap(e), up) for e, up in order]
        for h in having:
            f = f.where(F.coalesce(truth(compile_expression(h, f.vars)), F.lit(False)))
        for o in outputs or []:
            if o.expression is not None:
                f = self.bind(f, o.expression, o.var)
        names = [o.var.name for o in outputs] if outputs is not None else [n for n in f.vars if not n.startswith("_")]
        df = f.table(self.spark)
        by = [(c, up) for e, up in order for c in ordering(compile_expression(e, f.vars))]
        within = {v for e, _ in order for v in mentioned(e)} <= set(names)
        if q.distinct and order and not within:
            # of equal solutions the first in order counts; the columns that say so go along to the sort
            first = Window.partitionBy(*(f.vars[n].col for n in names if n in f.vars) or [F.lit(0)]).orderBy(*(c.asc() if up else c.desc() for c, up in by))
            ranks = [fresh("_by") for _ in by]
            df = df.withColumns({r: c for r, (c, _) in zip(ranks, by)} | {"_first": F.row_number().over(first)}).where("_first = 1")
            df = df.orderBy(*(F.col(r).asc() if up else F.col(r).desc() for r, (_, up) in zip(ranks, by)))
        elif order and not q.distinct:
            df = df.orderBy(*(c.asc() if up else c.desc() for c, up in by))
        cols, kept = [], {}
        for n in names:
            b = f.vars.get(n) or Bound(fresh(n), None, False)
            cols.append(b.col if n in f.vars else F.lit(None).cast("string").alias(b.column))
            kept[n] = b
        df = df.select(*cols, *([F.col(f.weight)] if f.weight else []))
        if q.distinct and (within or not order):
            df = df.distinct()
            if order:  # what distinct() shuffles is sorted after it
                now = {n: replace(b, column=kept[n].column) for n, b in f.vars.items() if n in kept}
                df = df.orderBy(*(c.asc() if up else c.desc() for e, up in order for c in ordering(compile_expression(e, now))))
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return Frame(df, kept, f.weight)

    def grouped(self, f: Frame, q: Select, found: list[Aggregate]):
        table = f.table(self.spark)
        by, out = [], {}
        swaps: dict = {}
        for n, (e, name) in enumerate(q.group_by):
            v = compile_expression(e, f.vars)
            label = name.name if name else e.name if isinstance(e, Var) else f"_g{n}"
            c = fresh(label)
            m = map_of(v)
            by.append((raw(v) if m else term_key(v)).alias(c))
            out[label] = Bound(c, m, e.name in f.vars and f.vars[e.name].certain if isinstance(e, Var) else False)
            swaps[e] = Var(label)
        columns = []
        for n, a in enumerate(dict.fromkeys(found)):
            col, v, kind = aggregate(a, f.vars)
            label, c = f"_a{n}", fresh(f"_a{n}")
            m = map_of(v) if v is not None and a.name in ("MIN", "MAX", "SAMPLE") else {"int": TermMap("lit", INTEGER), "num": TermMap("lit", DOUBLE), "str": TermMap("lit", STRING)}.get(kind)
            columns.append(col.alias(c))
            out[label] = Bound(c, m, False)
            swaps[a] = Var(label)
        df = table.groupBy(*by).agg(*columns) if columns else table.select(*by).distinct()

        def swap(e):
            if e in swaps:
                return swaps[e]
            match e:
                case Op(n, args):
                    return Op(n, tuple(map(swap, args)))
                case Call(n, args):
                    return Call(n, tuple(map(swap, args)))
            return e

        return Frame(df, out), swap

    # groups
    def group(self, g: Group, without: tuple = ()) -> Frame:
        """Solutions of a group; filters in `without` are left to the caller."""
        f = Frame(None, {})
        filters: list = []
        triples: list[Triple] = []

        def settle() -> None:
            nonlocal f, triples
            if triples:
                f = join(f, self.basic(triples))
                triples = []

        for part in g.parts:
            match part:
                case Triple():
                    triples.append(part)
                    continue
                case Filter() | Exists():
                    if part not in without:
                        filters.append(part)
                    continue
            settle()
            match part:
                case Group():
                    f = join(f, self.group(part))
                case Union(groups):
                    f = join(f, union([self.group(x) for x in groups], self.spark))
                case Optional_(inner):
                    late = tuple(p for p in inner.parts if isinstance(p, Filter))
                    right = self.group(inner, late)
                    f = left_join(f, right, lambda env, late=late: self.all(late, env), self.spark)
                case Minus(inner):
                    f = minus(f, self.group(inner), self.spark) if f.df is not None else f
                case Bind(e, v):
                    f = self.bind(f, e, v)
                case Values(names, rows):
                    f = join(f, self.values(names, rows))
                case SubSelect(q):
                    f = join(f, Planner(self.source).select(q))
        settle()
        for p in filters:
            f = self.filtered(f, p)
        return f

    def filtered(self, f: Frame, part) -> Frame:
        if isinstance(part, Filter) and isinstance(part.expression, Exists):
            part = part.expression
        if isinstance(part, Filter):
            base = f if f.df is not None else replace(f, df=f.table(self.spark))
            parts = _conjuncts(part.expression)
            for e in parts:
                if isinstance(e, Exists):
                    base = self.filtered(base, e)
                elif (inner := _exists(e)) is not None:
                    # solutions that have one, with true in its place, and those that don't, with false
                    yes, no = Exists(inner.group, False), Exists(inner.group, True)
                    halves = [self.filtered(self.filtered(base, x), Filter(_put(e, inner, Const(Literal(v, BOOLEAN))))) for x, v in ((yes, str(not inner.negated).lower()), (no, str(inner.negated).lower()))]
                    base = union(halves, self.spark)
                else:
                    # AND gives NULL or false for what isn't true: either way the row goes, and scans see plain predicates
                    base = base.where(truth(compile_expression(e, base.vars)))
            return base
        inner = part.group
        own = set()
        for p in inner.parts:
            if not isinstance(p, (Filter, Exists)):
                own |= set(visible(p))
        late = tuple(p for p in inner.parts if isinstance(p, Filter) and not isinstance(p.expression, Exists) and (mentioned(p.expression) & set(f.vars)) - own)
        right = self.group(inner, late)
        return semi_join(f, right, part.negated, lambda env: self.all(late, env), self.spark)

    def all(self, filters, env) -> Column | None:
        out = None
        for p in filters:
            c = F.coalesce(truth(compile_expression(p.expression, env)), F.lit(False))
            out = c if out is None else out & c
        return out

    def bind(self, f: Frame, e, v: Var) -> Frame:
        if v.name in f.vars:
            raise QueryError(f"?{v.name} is bound already")
        value = compile_expression(e, f.vars)
        m = map_of(value)
        c = fresh(v.name)
        col = raw(value) if m else term_key(value)
        certain = isinstance(e, Var) and e.name in f.vars and f.vars[e.name].certain
        df = f.table(self.spark).withColumn(c, col)
        return replace(f, df=df, vars={**f.vars, v.name: Bound(c, m, certain)})

    def values(self, names: tuple, rows: tuple) -> Frame:
        out = {v.name: Bound(fresh(v.name), None, all(r[i] is not None for r in rows)) for i, v in enumerate(names)}
        schema = ", ".join(f"`{b.column}` string" for b in out.values())
        return Frame(self.spark.createDataFrame([tuple(key(t) if t is not None else None for t in r) for r in rows], schema), out, bound=2)

    # basic graph patterns
    def basic(self, triples: list[Triple]) -> Frame:
        """Repeated paths come last: what the other patterns bind is where their search begins."""
        late: list[Triple] = []
        frames = self.frames(triples, late)
        out = self.joined(frames) if frames else Frame(None, {})
        for t in sorted(late, key=lambda t: isinstance(t.s, Var) + isinstance(t.o, Var)):
            out = join(out, self.repeated(t, out))
        return out

    def joined(self, frames: list[Frame]) -> Frame:
        """Joins the most selective frame with those that share variables with it, and so on; products come last."""
        left = sorted(range(len(frames)), key=lambda i: (-frames[i].bound, i))
        out = frames[left.pop(0)]
        while left:
            shares = [i for i in left if set(frames[i].vars) & set(out.vars)] or left
            best = min(shares, key=lambda i: (-frames[i].bound, -len(set(frames[i].vars) & set(out.vars)), i))
            left.remove(best)
            out = join(out, frames[best])
        return out

    def frames(self, triples: list[Triple], late: list[Triple]) -> list[Frame]:
        plain: list[Triple] = []
        out: list[Frame] = []
        todo = list(triples)
        while todo:
            t = todo.pop(0)
            match t.p:
                case Step():
                    plain.append(t)
                case Inverse(p):
                    todo.insert(0, Triple(t.o, p, t.s, t.g))
                case Sequence(ps):
                    at, steps = t.s, []
                    for p in ps[:-1]:
                        self.paths += 1
                        to = Var(f"_p{self.paths}")
                        steps.append(Triple(at, p, to, t.g))
                        at = to
                    todo = [*steps, Triple(at, ps[-1], t.o, t.g), *todo]
                case Alternative(ps):
                    out.append(union([self.basic([Triple(t.s, p, t.o, t.g)]) for p in ps], self.spark))
                case Repeat():
                    late.append(t)
                case Not():
                    out.append(self.source.scan(t))
                case _:
                    raise QueryError(f"no path: {t.p!r}")
        stars: dict = {}
        for t in plain:
            stars.setdefault((t.s, t.g), []).append(t)
        for (s, g), ts in stars.items():
            out += self.source.star(s, ts)
        return out

    def repeated(self, t: Triple, before: Frame) -> Frame:
        """path*, path+ and path? as distinct pairs; * and ? also pair each node of the graph, or of the bound end, with itself.

        An end is bound if it is a constant, or a variable that `before` binds: then the search goes from there alone.
        """
        p = t.p
        a, b = Var("_from"), Var("_to")
        inner = Planner(self.source).basic([Triple(a, p.path, b, t.g)]).keyed(["_from", "_to"])
        edges = inner.df.select(inner.vars["_from"].col.alias("a"), inner.vars["_to"].col.alias("b"))
        known = lambda x: not isinstance(x, Var) or before.df is not None and x.name in before.vars and before.vars[x.name].certain
        flip = (known(t.o) and not known(t.s)) or (not isinstance(t.o, Var) and isinstance(t.s, Var))
        if flip:
            edges = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
        s, o = (t.o, t.s) if flip else (t.s, t.o)
        start = None
        if not isinstance(s, Var):
            start = self.spark.createDataFrame([(key(s),)], "a string")
        elif known(s):
            start = written(before.df.select(before.vars[s.name].key().alias("a")).distinct(), "path-starts")
        if p.once:
            pairs = (edges if start is None else edges.join(start.toDF("_seed"), F.col("a") == F.col("_seed"), "left_semi")).distinct()
        else:
            pairs = closure(edges, start, None if isinstance(o, Var) or isinstance(s, Var) else key(o))
        if p.zero:
            if start is not None:
                own = start.select("a", F.col("a").alias("b"))
            else:
                own = self.source.nodes().select("a", F.col("a").alias("b"))
            pairs = pairs.union(own).distinct()
        if not isinstance(o, Var):
            pairs = pairs.where(F.col("b") == key(o))
        if isinstance(s, Var) and s == o:
            pairs = pairs.where("a = b")
        cols, names = [], {}
        for end, c in ((s, "a"), (o, "b")):
            if isinstance(end, Var) and end.name not in names:
                names[end.name] = Bound(fresh(end.name))
                cols.append(F.col(c).alias(names[end.name].column))
        return Frame(pairs.select(*cols), names, bound=0 if isinstance(s, Var) else 1)


def _exists(e) -> Exists | None:
    """An EXISTS somewhere in an expression."""
    match e:
        case Exists():
            return e
        case Op(_, args) | Call(_, args):
            return next((x for a in args if (x := _exists(a)) is not None), None)
    return None


def _put(e, what, other):
    """e with `other` for `what`."""
    if e == what:
        return other
    match e:
        case Op(n, args):
            return Op(n, tuple(_put(a, what, other) for a in args))
        case Call(n, args):
            return Call(n, tuple(_put(a, what, other) for a in args))
    return e


def _conjuncts(e) -> list:
    return [x for a in e.args for x in _conjuncts(a)] if isinstance(e, Op) and e.name == "&&" else [e]

