"""What a query says, before any plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from quadrille.terms import Term


@dataclass(frozen=True)
class Var:
    name: str


# paths
@dataclass(frozen=True)
class Step:
    term: Term | Var


@dataclass(frozen=True)
class Not:
    """Any predicate but these."""

    terms: tuple[Term, ...]


@dataclass(frozen=True)
class Inverse:
    path: object


@dataclass(frozen=True)
class Alternative:
    paths: tuple


@dataclass(frozen=True)
class Sequence:
    paths: tuple


@dataclass(frozen=True)
class Repeat:
    """path* (zero), path+, or path? (once)."""

    path: object
    zero: bool
    once: bool = False


# graph patterns
@dataclass(frozen=True)
class Triple:
    s: Term | Var
    p: object
    o: Term | Var
    g: Term | Var | None = None


@dataclass(frozen=True)
class Filter:
    expression: object


@dataclass(frozen=True)
class Exists:
    group: "Group"
    negated: bool


@dataclass(frozen=True)
class Optional_:
    group: "Group"


@dataclass(frozen=True)
class Minus:
    group: "Group"


@dataclass(frozen=True)
class Union:
    groups: tuple


@dataclass(frozen=True)
class Bind:
    expression: object
    var: Var


@dataclass(frozen=True)
class Values:
    vars: tuple
    rows: tuple


@dataclass(frozen=True)
class SubSelect:
    query: "Select"


@dataclass(frozen=True)
class Group:
    parts: tuple = ()


# expressions
@dataclass(frozen=True)
class Const:
    term: Term


@dataclass(frozen=True)
class Op:
    name: str
    args: tuple


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Aggregate:
    name: str
    arg: object | None
    distinct: bool = False
    separator: str = " "


@dataclass(frozen=True)
class Output:
    var: Var
    expression: object | None = None


@dataclass
class Select:
    outputs: list[Output] | None  # None: *
    body: Group
    distinct: bool = False
    group_by: list = field(default_factory=list)
    having: list = field(default_factory=list)
    order_by: list = field(default_factory=list)  # (expression, ascending)
    limit: int | None = None
    offset: int = 0
    ask: bool = False

    @property
    def variables(self) -> list[str]:
        return [o.var.name for o in self.outputs] if self.outputs is not None else [v for v in visible(self.body) if not v.startswith("_")]


def visible(part) -> list[str]:
    """Variables that a pattern can bind, in order of first sight."""
    found: dict[str, None] = {}

    def see(x) -> None:
        match x:
            case Var(name):
                found[name] = None
            case Triple(s, p, o, g):
                for y in (s, p, o, g):
                    see(y)
            case Step(t) | Inverse(t) | Repeat(t, _, _):
                see(t)
            case Alternative(ps) | Sequence(ps):
                for y in ps:
                    see(y)
            case Group(ps) | Union(ps):
                for y in ps:
                    see(y)
            case Optional_(g):
                see(g)
            case Bind(_, v):
                see(v)
            case Values(vs, _):
                for y in vs:
                    see(y)
            case SubSelect(q):
                for n in q.variables:
                    found[n] = None

    see(part)
    return list(found)


def mentioned(e) -> set[str]:
    """Variables of an expression."""
    match e:
        case Var(name):
            return {name}
        case Op(_, args) | Call(_, args):
            return set().union(*(mentioned(a) for a in args)) if args else set()
        case Aggregate(_, arg, _, _):
            return mentioned(arg) if arg is not None else set()
        case Exists(group, _):
            return set(visible(group))
    return set()


def aggregates(e) -> list[Aggregate]:
    match e:
        case Aggregate():
            return [e]
        case Op(_, args) | Call(_, args):
            return [a for x in args for a in aggregates(x)]
    return []
