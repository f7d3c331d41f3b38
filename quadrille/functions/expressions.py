"""SPARQL expressions as Spark columns. An error is NULL: a filter drops the row, BIND leaves the variable unbound."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quadrille.operators.frames import Bound, TermMap
from quadrille.plans.algebra import Aggregate, Call, Const, Exists, Op, Var
from quadrille.plans.parser import QueryError
from quadrille.terms import BOOLEAN, DATE, DATETIME, DOUBLE, INTEGER, INTEGERS, NUMERIC, STRING, XSD, Iri, Literal, head_of, key, kind_of, lexical_of


@dataclass(frozen=True)
class Value:
    """kind: int, num, str, bool, time, iri (its text), term (a key)."""

    kind: str
    col: Column
    const: object = None
    bound: Bound | None = None


def _time(text: Column) -> Column:
    zoned = F.when(text.rlike(r"(Z|[+-]\d\d:\d\d)$"), text).otherwise(F.concat(text, F.lit("Z")))
    return zoned.try_cast("timestamp")


def of_bound(b: Bound) -> Value:
    if b.map is None:
        return Value("term", b.col, bound=b)
    if b.map.kind == "iri":
        return Value("iri", F.concat(F.lit(b.map.head), b.col.cast("string")), bound=b)
    kind = {STRING: "str", BOOLEAN: "bool", DATETIME: "time", DATE: "time"}.get(b.map.head) or ("int" if b.map.head in INTEGERS else "num" if b.map.head in NUMERIC else None)
    return Value("term", b.key(), bound=b) if kind is None else Value(kind, b.col, bound=b)


def of_term(t) -> Value:
    match t:
        case Iri(v):
            return Value("iri", F.lit(v), t)
        case Literal(v, d, lang) if not lang:
            if d == STRING:
                return Value("str", F.lit(v), t)
            if d == BOOLEAN:
                return Value("bool", F.lit(v in ("true", "1")), t)
            try:
                if d in INTEGERS:
                    return Value("int", F.lit(int(v)), t)
                if d in NUMERIC:
                    return Value("num", F.lit(float(v)), t)
                if d in (DATETIME, DATE):
                    at = dt.datetime.fromisoformat(v)
                    at = at.astimezone(dt.timezone.utc).replace(tzinfo=None) if at.tzinfo else at
                    return Value("time", F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz"), t)
            except ValueError:
                pass
    return Value("term", F.lit(key(t)), t)


def number(v: Value) -> Column:
    if v.kind in ("int", "num"):
        return v.col
    if v.kind == "term":
        return F.when((kind_of(v.col) == "L") & head_of(v.col).isin(*NUMERIC), lexical_of(v.col).try_cast("double"))
    return F.lit(None).cast("double")


def time(v: Value) -> Column:
    if v.kind == "time":
        return v.col
    if v.kind == "term":
        return F.when((kind_of(v.col) == "L") & head_of(v.col).isin(DATETIME, DATE), _time(lexical_of(v.col)).cast("timestamp_ntz"))
    return F.lit(None).cast("timestamp_ntz")


def plain(v: Value) -> Column:
    """The text of a plain string."""
    if v.kind == "str":
        return v.col
    if v.kind == "term":
        return F.when((kind_of(v.col) == "L") & (head_of(v.col) == STRING), lexical_of(v.col))
    return F.lit(None).cast("string")


def text(v: Value) -> Column:
    """STR(): lexical form or IRI."""
    if v.kind == "term":
        return F.when(kind_of(v.col) != "B", lexical_of(v.col))
    if v.kind == "time":
        return F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss")
    return v.col.cast("string")


def truth(v: Value) -> Column:
    """The effective boolean value."""
    match v.kind:
        case "bool":
            return v.col
        case "int" | "num":
            return (v.col != 0) & ~F.isnan(v.col.cast("double"))
        case "str":
            return F.length(v.col) > 0
        case "term":
            n = number(v)
            return F.when((kind_of(v.col) == "L") & (head_of(v.col) == BOOLEAN), lexical_of(v.col).isin("true", "1")).when(n.isNotNull(), (n != 0) & ~F.isnan(n)).when((kind_of(v.col) == "L") & (head_of(v.col) == STRING), F.length(lexical_of(v.col)) > 0)
    return F.lit(None).cast("boolean")


def term_key(v: Value) -> Column:
    if v.kind == "term":
        return v.col
    if v.bound is not None:
        return v.bound.key()
    if v.const is not None:
        return F.lit(key(v.const))
    return map_of(v).key(v.col)


def map_of(v: Value) -> TermMap | None:
    """How a computed value stands for terms."""
    if v.bound is not None and v.bound.map is not None:
        return v.bound.map
    return {"int": TermMap("lit", INTEGER), "num": TermMap("lit", DOUBLE), "str": TermMap("lit", STRING), "bool": TermMap("lit", BOOLEAN), "time": TermMap("lit", DATETIME), "iri": TermMap("iri", "")}.get(v.kind)


def raw(v: Value) -> Column:
    """The column that goes with map_of()."""
    return v.bound.col if v.bound is not None and v.bound.map is not None else v.col


_COMPARE = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}


def compare(sign: str, a: Value, b: Value) -> Column:
    """By number, instant, truth value or text if both have one; else = and != by term, where two literals of other types are an error."""
    do = _COMPARE[sign]
    classes = {"int": "n", "num": "n", "str": "s", "bool": "b", "time": "t", "iri": "i"}
    x, y = classes.get(a.kind), classes.get(b.kind)
    nothing = F.lit(None).cast("boolean")
    if x and y:
        if x == y != "i":
            return do(a.col, b.col)
        if x != y:
            same = F.lit(sign == "!=") if "i" in (x, y) else nothing
            return F.when(a.col.isNotNull() & b.col.isNotNull(), same) if sign in ("=", "!=") else nothing
        for v, w in ((a, b), (b, a)):
            if sign in ("=", "!=") and v.bound is not None and w.const is not None:
                # an IRI of a table is compared by its raw value
                c = v.bound.map.raw(w.const, "string")
                return F.when(v.bound.col.isNotNull(), F.lit(sign == "!=")) if c is None else do(v.bound.col.cast("string"), c)
        return do(a.col, b.col) if sign in ("=", "!=") else nothing
    known = x or y
    out = None
    for c, read in (("n", number), ("t", time), ("s", plain), ("b", _boolean)):
        if known in (None, c):
            l, r = read(a), read(b)
            both = l.isNotNull() & r.isNotNull()
            out = F.when(both, do(l, r)) if out is None else out.when(both, do(l, r))
    if sign not in ("=", "!="):
        return out if out is not None else nothing
    ka, kb = term_key(a), term_key(b)
    same = F.lit(sign == "=")
    unknown = kind_of(ka).isin("L", "@") & kind_of(kb).isin("L", "@") & ~((kind_of(ka) == "@") & (kind_of(kb) == "@"))
    rest = F.when(ka == kb, same).when(unknown, nothing).when(ka.isNotNull() & kb.isNotNull(), ~same)
    return rest if out is None else out.otherwise(rest)


def _boolean(v: Value) -> Column:
    if v.kind == "bool":
        return v.col
    if v.kind == "term":
        return F.when((kind_of(v.col) == "L") & (head_of(v.col) == BOOLEAN), lexical_of(v.col).isin("true", "1"))
    return F.lit(None).cast("boolean")


def arithmetic(sign: str, a: Value, b: Value) -> Value:
    whole = a.kind == b.kind == "int" and sign != "/"
    l, r = number(a), number(b)
    if whole:
        l, r = l.cast("bigint"), r.cast("bigint")
        return Value("int", {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[sign](l, r))
    l, r = l.cast("double"), r.cast("double")
    if sign == "/":
        if b.const is not None and b.kind in ("int", "num") and float(b.const.value) != 0:
            return Value("num", l / r)
        inf = F.lit(float("inf"))
        zero = F.when(F.lit(a.kind == b.kind == "int") | (l == 0), F.lit(None)).when(l > 0, inf).otherwise(-inf)  # 0 / 0 and whole numbers: an error
        return Value("num", F.when(r == 0, zero).otherwise(F.try_divide(l, r)))
    return Value("num", {"+": l + r, "-": l - r, "*": l * r}[sign])


def language(v: Value) -> Column:
    if v.kind == "term":
        return F.when(kind_of(v.col) == "@", head_of(v.col)).when(kind_of(v.col) == "L", F.lit(""))
    return F.when(v.col.isNotNull(), F.lit("")) if v.kind != "iri" else F.lit(None).cast("string")


def compile_expression(e, env: dict[str, Bound]) -> Value:
    """The value of an expression over variables; Aggregates must have been replaced by variables before."""
    see = lambda x: compile_expression(x, env)
    match e:
        case Var(name):
            return of_bound(env[name]) if name in env else Value("term", F.lit(None).cast("string"))
        case Const(t):
            return of_term(t)
        case Op("&&", (a, b)):
            return Value("bool", truth(see(a)) & truth(see(b)))
        case Op("||", (a, b)):
            return Value("bool", truth(see(a)) | truth(see(b)))
        case Op("!", (a,)):
            return Value("bool", ~truth(see(a)))
        case Op("neg", (a,)):
            v = see(a)
            return Value("int", F.try_subtract(F.lit(0).cast("bigint"), v.col.cast("bigint"))) if v.kind == "int" else Value("num", -number(v).cast("double"))
        case Op("IN", (a, *rest)):
            v, out = see(a), F.lit(False)
            for x in rest:
                out = out | compare("=", v, see(x))
            return Value("bool", out)
        case Op(sign, (a, b)) if sign in _COMPARE:
            return Value("bool", compare(sign, see(a), see(b)))
        case Op(sign, (a, b)):
            return arithmetic(sign, see(a), see(b))
        case Aggregate():
            raise QueryError(f"{e.name} isn't possible here")
        case Exists():
            raise QueryError("EXISTS is possible only as a filter of its own")
        case Call(name, args):
            return call(name, args, env)
    raise QueryError(f"no expression: {e!r}")


def call(name: str, args: tuple, env: dict[str, Bound]) -> Value:
    see = lambda i: compile_expression(args[i], env)
    n = len(args)
    both = lambda f: Value("bool", f(text(see(0)), text(see(1))))
    as_text = lambda f: Value("str", f(text(see(0))))
    part = lambda f: Value("int", f(time(see(0))).cast("bigint"))
    match name, n:
        case "BOUND", 1:
            return Value("bool", see(0).col.isNotNull())
        case "STR", 1:
            return Value("str", text(see(0)))
        case "LANG", 1:
            return Value("str", language(see(0)))
        case "LANGMATCHES", 2:
            tag, range_ = text(see(0)), text(see(1))
            return Value("bool", F.when(range_ == "*", tag != "").otherwise((F.lower(tag) == F.lower(range_)) | F.startswith(F.lower(tag), F.concat(F.lower(range_), F.lit("-")))))
        case "DATATYPE", 1:
            v = see(0)
            m = map_of(v)
            if v.kind == "term":
                return Value("iri", F.when(kind_of(v.col) == "L", head_of(v.col)))
            return Value("iri", F.when(v.col.isNotNull(), F.lit(m.head if m and m.kind == "lit" else None)))
        case "STRLEN", 1:
            return Value("int", F.length(text(see(0))).cast("bigint"))
        case "UCASE", 1:
            return as_text(F.upper)
        case "LCASE", 1:
            return as_text(F.lower)
        case "CONCAT", _:
            return Value("str", F.concat(*(text(see(i)) for i in range(n))) if n else F.lit(""))
        case "CONTAINS", 2:
            return both(F.contains)
        case "STRSTARTS", 2:
            return both(F.startswith)
        case "STRENDS", 2:
            return both(F.endswith)
        case "STRBEFORE" | "STRAFTER", 2:
            a, b = text(see(0)), text(see(1))
            at = F.instr(a, b)
            found = F.substring(a, F.lit(1), at - 1) if name == "STRBEFORE" else F.substring(a, at + F.length(b), F.length(a))
            return Value("str", F.when(at > 0, found).when(a.isNotNull() & b.isNotNull(), F.lit("")))
        case "SUBSTR", 2 | 3:
            # places count from 1; what lies before the first one is cut off with its part of the length
            a = text(see(0))
            start = _rounded(number(see(1)).cast("double"))
            end = start + _rounded(number(see(2)).cast("double")) if n == 3 else F.length(a) + F.lit(1.0)
            first, last = F.greatest(start, F.lit(1.0)), F.least(end, F.length(a) + F.lit(1.0))
            known = a.isNotNull() & ~F.isnan(start) & ~F.isnan(end) & start.isNotNull() & end.isNotNull()
            return Value("str", F.when(known & (last > first), F.substring(a, first.try_cast("int"), (last - first).try_cast("int"))).when(known, F.lit("")))
        case "REPLACE", 3 | 4:
            pattern, ok = _pattern(see(1), see(3) if n == 4 else None)
            new, groups = see(2), _groups(see(1))
            if new.const is not None and groups is not None:
                ok = ok & F.lit(all(int(d) <= groups for d in re.findall(r"(?<!\\)\$(\d)", new.const.value)) and not re.search(r"(?<!\\)\$(?!\d)|(?<!\\)\\$", new.const.value))
            else:  # a replacement that isn't known must be plain
                ok = ok & ~text(new).rlike(r"[$\\]")
            return Value("str", F.when(ok, F.regexp_replace(text(see(0)), pattern, text(new))))
        case "REGEX", 2 | 3:
            pattern, ok = _pattern(see(1), see(2) if n == 3 else None)
            found = F.regexp_like(text(see(0)), pattern)
            return Value("bool", F.when(ok, found))
        case "ABS" | "CEIL" | "FLOOR" | "ROUND", 1:
            v = see(0)
            if v.kind == "int":
                return Value("int", F.when(v.col >= 0, v.col.cast("bigint")).otherwise(F.try_subtract(F.lit(0).cast("bigint"), v.col.cast("bigint"))) if name == "ABS" else v.col)
            x = number(v).cast("double")
            return Value("num", {"ABS": F.abs, "CEIL": lambda c: -_floor(-c), "FLOOR": _floor, "ROUND": _rounded}[name](x))
        case "YEAR" | "MONTH" | "DAY" | "HOURS" | "MINUTES", 1:
            return part({"YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth, "HOURS": F.hour, "MINUTES": F.minute}[name])
        case "SECONDS", 1:
            return Value("num", F.second(time(see(0))).cast("double"))
        case "STRDT", 2:
            return Value("term", F.concat(F.lit("L"), text(see(1)), F.lit("|"), plain(see(0))))
        case "STRLANG", 2:
            return Value("term", F.concat(F.lit("@"), F.lower(plain(see(1))), F.lit("|"), plain(see(0))))
        case "ENCODE_FOR_URI", 1:
            return as_text(lambda c: F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")))
        case "MD5" | "SHA1" | "SHA256" | "SHA384" | "SHA512", 1:
            return as_text({"MD5": F.md5, "SHA1": F.sha1}.get(name) or (lambda c: F.sha2(c, int(name[3:]))))
        case "RAND", 0:
            return Value("num", F.rand())
        case "NOW", 0:
            return Value("time", F.current_timestamp().cast("timestamp_ntz"))
        case "UUID", 0:
            return Value("iri", F.concat(F.lit("urn:uuid:"), F.uuid()))
        case "STRUUID", 0:
            return Value("str", F.uuid())
        case "ISIRI" | "ISURI" | "ISLITERAL" | "ISBLANK" | "ISNUMERIC", 1:
            v = see(0)
            if name == "ISNUMERIC":
                return Value("bool", F.when(v.col.isNotNull(), number(v).isNotNull()))
            want = {"ISBLANK": ("B",), "ISLITERAL": ("L", "@")}.get(name, ("I",))
            if v.kind == "term":
                return Value("bool", kind_of(v.col).isin(*want))
            return Value("bool", F.when(v.col.isNotNull(), F.lit(("I" if v.kind == "iri" else "L") in want)))
        case "SAMETERM", 2:
            return Value("bool", term_key(see(0)) == term_key(see(1)))
        case "IRI" | "URI", 1:
            return Value("iri", text(see(0)))
        case "IF", 3:
            c, a, b = truth(see(0)), see(1), see(2)
            if a.kind == b.kind:
                return Value(a.kind, F.when(c, a.col).when(~c, b.col))
            return Value("term", F.when(c, term_key(a)).when(~c, term_key(b)))
        case "COALESCE", _:
            values = [see(i) for i in range(n)]
            if len({v.kind for v in values}) == 1:
                return Value(values[0].kind, F.coalesce(*(v.col for v in values)))
            return Value("term", F.coalesce(*(term_key(v) for v in values)))
    if n == 1 and name.startswith(XSD):
        v = see(0)
        if name in INTEGERS:
            return Value("int", v.col.try_cast("bigint") if v.kind in ("int", "num") else v.col.cast("bigint") if v.kind == "bool" else text(v).try_cast("bigint"))
        if name in NUMERIC:
            return Value("num", v.col.cast("double") if v.kind in ("int", "num", "bool") else text(v).try_cast("double"))
        if name == STRING:
            return Value("str", text(v))
        if name == BOOLEAN:
            if v.kind in ("int", "num"):
                return Value("bool", truth(v))
            t = F.trim(text(v))
            return Value("bool", F.when(t.isin("true", "1"), F.lit(True)).when(t.isin("false", "0"), F.lit(False)))
        if name in (DATETIME, DATE):
            return Value("time", v.col if v.kind == "time" else _time(text(v)).cast("timestamp_ntz"))
    raise QueryError(f"no function {name} of {n} arguments")


def _floor(x: Column) -> Column:
    """Of a double, as a double: beyond 2^53 every one is whole."""
    return F.when(F.abs(x) < F.lit(2.0**53), F.floor(x).cast("double")).otherwise(x)


def _rounded(x: Column) -> Column:
    return _floor(x + F.lit(0.5))


def _java(pattern: str):
    """The compiled pattern, or None if it isn't one."""
    try:
        return SparkSession.active()._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, IllegalArgumentException):
        return None


def _flagged(pattern: str, flags: str) -> str:
    return f"(?{flags}){pattern}" if flags else pattern


def _groups(pattern: Value) -> int | None:
    """Groups of a constant pattern."""
    if pattern.const is None:
        return None
    compiled = _java(pattern.const.value)
    return compiled.matcher("").groupCount() if compiled is not None else 0


def _pattern(pattern: Value, flags: Value | None) -> tuple[Column, Column | bool]:
    """A regular expression and whether it is one: a constant is looked at once, others row by row."""
    if pattern.const is not None and (flags is None or flags.const is not None):
        whole = _flagged(pattern.const.value, flags.const.value if flags is not None else "")
        return (F.lit(whole), F.lit(True)) if _java(whole) is not None else (F.lit("x"), F.lit(None).cast("boolean"))
    whole = text(pattern)
    if flags is not None:
        whole = F.when(text(flags) == "", whole).otherwise(F.concat(F.lit("(?"), text(flags), F.lit(")"), whole))
    return whole, F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), whole).isNotNull()


def aggregate(a: Aggregate, env: dict[str, Bound]) -> tuple[Column, Value | None, str]:
    """The aggregate column, and the kind of value that it is."""
    if a.arg is None:
        if a.distinct:  # solutions, not rows
            seen = [b.key() for n, b in env.items() if not n.startswith("_")]
            return F.count_distinct(F.struct(*seen) if seen else F.lit(1)), None, "int"
        return F.count(F.lit(1)), None, "int"
    v = compile_expression(a.arg, env)
    match a.name:
        case "COUNT":
            if v.bound is not None and v.bound.certain and not a.distinct:
                return F.count(F.lit(1)), v, "int"  # it is there in every row, and need not be made to be counted
            k = raw(v)
            return (F.count_distinct(k) if a.distinct else F.count(k)), v, "int"
        case "SUM" | "AVG":
            x = number(v)
            whole = v.kind == "int" and a.name == "SUM"
            f = {("SUM", False): F.sum, ("SUM", True): F.sum_distinct, ("AVG", False): F.avg}.get((a.name, a.distinct))
            if f is None:
                d = x.cast("double")
                return F.when(F.count(d) > 0, F.sum_distinct(d) / F.count_distinct(d)).otherwise(F.lit(0.0)), v, "num"
            if whole:  # summed as decimals, so that a sum beyond 64 bits is an error, not the end of the query
                out = f(x.cast("decimal(20,0)"))
                return F.when(F.count(x) > 0, out.try_cast("bigint")).otherwise(F.lit(0).cast("bigint")), v, "int"
            out = f(x.cast("double"))
            return F.coalesce(out, F.lit(0.0)), v, "num"
        case "MIN" | "MAX" | "SAMPLE":
            f = F.max if a.name == "MAX" else F.min
            if v.kind != "term":
                return f(raw(v)), v, v.kind
            return f(F.when(v.col.isNotNull(), F.struct(*ordering(v), v.col.alias("k"))))["k"], v, "term"
        case "GROUP_CONCAT":
            c = F.collect_set(text(v)) if a.distinct else F.collect_list(text(v))
            return F.array_join(F.array_sort(c), a.separator), v, "str"
    raise QueryError(f"no aggregate {a.name}")


def ordering(v: Value) -> list[Column]:
    """Columns that sort values as ORDER BY does: unbound, blank nodes, IRIs, literals."""
    if v.kind != "term":
        return [v.col]
    kind = kind_of(v.col)
    return [F.when(v.col.isNull(), 0).when(kind == "B", 1).when(kind == "I", 2).otherwise(3), number(v), time(v), lexical_of(v.col)]
