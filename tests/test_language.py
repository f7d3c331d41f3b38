"""The parser, and queries on small graphs, with rows written from the SPARQL 1.1 semantics."""

import pytest

from quadrille.build import Builder
from quadrille.plans.algebra import Alternative, Not, Repeat, Sequence, Step, Triple, Union, Var
from quadrille.plans.parser import QueryError, parse
from quadrille.terms import RDF, XSD, Blank, Iri, Literal, key, literal, term_of

EX = "http://example.org/"
P = f"PREFIX : <{EX}> PREFIX rdf: <{RDF}> PREFIX xsd: <{XSD}> "


@pytest.mark.parametrize(
    "text",
    [
        "SELECT plain WHERE { ?x a plain . }",
        "SELECT * { ?x () plain }",
        "SELECT * WHERE { ?s a ?test ",
        "SELECT * WHERE { ?s <p>/(<q> ?o2.}",
        "SELECT * WHERE { ?s a ?type , }",
        "SELECT * WHERE { ?s a/?p1*/?p2 ?o. }",
        "PREFIX ex: <http://e/> SELECT * WHERE { ?s ex:prop/other ?o }",
        "PREFIX ex: <http://e/> SELECT * { ?s dc:title ?o }",
        "SELECT (COUNT(DISTINCT ?s AS ?c) { ?s ?p ?o }",
        "SELECT * { ?s ?p ?o } LIMIT",
        "CONSTRUCT { ?s ?p ?o } WHERE { ?s ?p ?o }",
        "SELECT * { ?s ?p ?o FILTER NOT { ?s ?p ?o } }",
        "",
    ],
)
def test_no_query(text):
    with pytest.raises((QueryError, ValueError)):
        parse(text)


def test_patterns():
    q = parse("select*{?s?p?o2;?p2?o.}")
    assert q.body.parts == (Triple(Var("s"), Step(Var("p")), Var("o2")), Triple(Var("s"), Step(Var("p2")), Var("o")))
    q = parse("SELECT * { ?s <c>/(<a>|!<b>)* ?o }")
    assert q.body.parts[0].p == Sequence((Step(Iri("c")), Repeat(Alternative((Step(Iri("a")), Not((Iri("b"),)))), True)))
    q = parse("SELECT ?s {{?s<p><v>}UNION{?s<p2><v2>}UNION{?s<p3><v3>}}")
    assert isinstance(q.body.parts[0], Union) and len(q.body.parts[0].groups) == 3
    q = parse("SELECT * { ?s ?p [ a <t> ; <c> ?d1, ?d2, ?d3 ], [ a <u> ; ] }")
    assert len(q.body.parts) == 7 and q.variables == ["d1", "d2", "d3", "s", "p"]
    assert parse("prefix select: <http://e/> select*{?s select:prop ?o ; <prop> select:test}").body.parts[1].o == Iri("http://e/test")
    assert parse("SELECT * { ?s <p> 'it''s' }" .replace("''", "\\'")).body.parts[0].o == Literal("it's")
    assert parse("SELECT * { ?s <p> -1.5, 2e3, true, 'x'@en, '4'^^<http://d> }").body.parts[3].o == Literal("x", RDF + "langString", "en")


def test_terms_round_trip():
    for t in (Iri("http://a"), Blank("x"), literal("a|b"), literal(1), literal(1.5), literal(True), Literal("x", RDF + "langString", "en")):
        assert term_of(key(t)) == t
    assert len({key(t) for t in (Iri("1"), Blank("1"), literal("1"), literal(1))}) == 4


def answers(graph, text):
    cols = graph.keys(P + text)
    short = lambda k: None if k is None else k[1:].replace(EX, "").split("|", 1)[-1] if k[0] != "B" else "_"
    return sorted((tuple(short(v) for v in r) for r in cols.collect()), key=repr)


@pytest.fixture(scope="module")
def small(spark):
    return Builder().add("s", "path1", Iri(EX + "o"), Iri(EX + "i")).add("s", "path2", Iri(EX + "o")).add("i", "path1", Iri(EX + "o")).build(spark)


def test_paths(small):
    assert answers(small, "SELECT * { ?s (:path1|:path2) ?o }") == [("i", "o"), ("s", "i"), ("s", "o"), ("s", "o")]
    assert answers(small, "SELECT * { ?s (:path1|:path2) ?s }") == []
    assert answers(small, "SELECT * { ?s ?s ?s }") == []
    assert answers(small, "SELECT * { ?s (:path1/!:path2) ?o }") == [("s", "o")]
    assert len(answers(small, "SELECT * { ?s !:path3 ?o }")) == 4
    assert answers(small, "SELECT * { ?s (:path1|:path2)* ?o }") == [("i", "i"), ("i", "o"), ("o", "o"), ("s", "i"), ("s", "o"), ("s", "s")]
    assert answers(small, "SELECT * { ?s (:path1|:path2)+ ?o }") == [("i", "o"), ("s", "i"), ("s", "o")]
    assert answers(small, "SELECT * { ?s :path1? :o }") == [("i",), ("o",), ("s",)]


def test_closure_on_cycles(spark):
    b = Builder()
    for x, y in ("ab", "ac", "ba", "bc", "ca", "cb"):
        b.add(x, "p", Iri(EX + y))
    g = b.build(spark)
    every = sorted((x, y) for x in "abc" for y in "abc")
    for sign in "*+":
        assert answers(g, f"SELECT * {{ ?a :p{sign} ?b }}") == every
        assert answers(g, f"SELECT * {{ ?a :p{sign} :b }}") == [("a",), ("b",), ("c",)]
        assert answers(g, f"SELECT * {{ :a :p{sign} ?b }}") == [("a",), ("b",), ("c",)]
        assert answers(g, f"SELECT * {{ ?a :p{sign} ?a }}") == [("a",), ("b",), ("c",)]
        assert g.ask(P + f"ASK {{ :a :p{sign} :b }}") and not g.ask(P + f"ASK {{ :a :p{sign} :z }}")
    assert g.ask(P + "ASK { :z :p* :z }") and not g.ask(P + "ASK { :z :p+ :z }")


def test_lists(spark):
    b = Builder()
    b.add("x", "notes", b.list(Iri(EX + "n1"), Iri(EX + "n2"), Iri(EX + "n3"))).add("x", "decoy", b.list(Iri(EX + "w")))
    g = b.build(spark)
    assert answers(g, "SELECT ?n { :x :notes/rdf:rest*/rdf:first ?n }") == [("n1",), ("n2",), ("n3",)]
    assert answers(g, "SELECT ?n ?d { { :x :notes/rdf:rest*/rdf:first ?n } UNION { :x :decoy/rdf:rest*/rdf:first ?d } }") == [("n1", None), ("n2", None), ("n3", None), (None, "w")]
    assert answers(g, "SELECT ?p { ?x ?p ( :w ) }") == [("decoy",)]


@pytest.fixture(scope="module")
def counts(spark):
    b = Builder()
    for i in range(10):
        b.a(f"s{i}", "Example").add(f"s{i}", "count", i)
    return b.build(spark)


@pytest.mark.parametrize(
    "test, want",
    [("?c > 3", range(4, 10)), ("?c <= 3", range(4)), ("?c > 2) FILTER(?c < 5", (3, 4)), ("?c > 2 && ?c < 5", (3, 4)), ("?c < 3 || ?c > 5", (0, 1, 2, 6, 7, 8, 9)), ("?c IN (1, 4)", (1, 4)), ("!(?c NOT IN (1, 4))", (1, 4)), ("?c = 4.0", (4,)), ("?c / 0 > 1", range(1, 10)), ("?c != ?s", range(10)), ("-?c > -2", (0, 1)), ("?c + 1 = 2 * ?c", (1,)), ("?c", range(1, 10)), ("?c = 'x'", ()), ("?zz > 1 || ?c = 2", (2,))],
)
def test_filters(counts, test, want):
    assert answers(counts, f"SELECT ?s {{ ?s a :Example ; :count ?c . FILTER({test}) }}") == [(f"s{i}",) for i in want]


def test_typed_filters(spark):
    g = Builder().add("u", "dob", Literal("2000-01-01T01:00:00Z", XSD + "dateTime")).add("v", "dob", Literal("2020-01-01T01:00:00+01:00", XSD + "dateTime")).add("u", "name", Literal("Name", RDF + "langString", "en"), Literal("Naam", RDF + "langString", "nl-BE")).add("a", "ok", False).add("b", "ok", True).build(spark)
    assert answers(g, 'SELECT ?s { ?s :dob ?d FILTER(?d > "2010-01-01T00:00:00Z"^^xsd:dateTime) }') == [("v",)]
    assert answers(g, 'SELECT ?s { ?s :dob ?d FILTER(?d = "2020-01-01T00:00:00Z"^^xsd:dateTime) }') == [("v",)]
    assert answers(g, 'SELECT ?n { ?s :name ?n FILTER LANGMATCHES(LANG(?n), "en") }') == [("Name",)]
    assert answers(g, 'SELECT ?n { ?s :name ?n FILTER LANGMATCHES(LANG(?n), "NL") }') == [("Naam",)]
    assert answers(g, 'SELECT ?n { ?s :name ?n FILTER LANGMATCHES(LANG(?n), "*") }') == [("Naam",), ("Name",)]
    assert answers(g, "SELECT ?s { ?s :ok true }") == answers(g, "SELECT ?s { ?s :ok ?c FILTER(?c = true) }") == answers(g, "SELECT ?s { ?s :ok ?c FILTER(?c) }") == [("b",)]
    assert answers(g, 'SELECT ?p { ?s ?p "Name"@en }') == [("name",)]


def test_exists(spark):
    g = Builder().add("a", "p", 1).add("a", "q", 1, 2).add("b", "p", 3.0).add("b", "q", 4.0, 5.0).build(spark)
    head = "SELECT ?x ?n { ?x :p ?n FILTER "
    assert answers(g, head + "NOT EXISTS { ?x :q ?m . FILTER(?n = ?m) } }") == [("b", "3.0")]
    assert answers(g, head + "EXISTS { ?x :q ?m . FILTER(?n = ?m) } }") == [("a", "1")]
    assert answers(g, head + "NOT EXISTS { ?u ?v ?n . ?x :q ?m . FILTER(?n = ?m) } }") == [("b", "3.0")]
    assert answers(g, head + "NOT EXISTS { { ?x :q ?m } UNION { ?y :q ?m } FILTER(?n = ?m) } }") == [("b", "3.0")]
    assert answers(g, head + "EXISTS { ?s :q 5.0 } }") == []
    assert answers(g, head + "EXISTS { ?s :q ?any } }") == [("a", "1"), ("b", "3.0")]
    assert answers(g, "SELECT ?x { ?x :p ?c1 ; :q ?c2 FILTER(?c1 < ?c2 - 1.5) }") == [("b",)]


def test_nested_exists(spark):
    b = Builder().a("alice", "Person").a("bob", "Person").add("alice", "name", Iri(EX + "n")).add("n", "first", "Alice").add("n", "last", "L")
    g = b.build(spark)
    head = "SELECT ?p { ?p a :Person "
    assert answers(g, head + "FILTER NOT EXISTS { ?p :name ?n } }") == [("bob",)]
    assert answers(g, head + "FILTER NOT EXISTS { ?a ?b ?c } }") == []
    assert answers(g, head + "FILTER NOT EXISTS { ?p :name ?n FILTER NOT EXISTS { ?n :first ?v } } }") == [("alice",), ("bob",)]
    assert answers(g, head + "FILTER EXISTS { ?a :name ?n FILTER EXISTS { ?n :first ?v } } }") == [("alice",), ("bob",)]
    assert answers(g, head + "{ FILTER NOT EXISTS { ?p :name ?n } } UNION { ?p :name ?n FILTER EXISTS { ?n :first ?f } FILTER EXISTS { ?n :last ?l } } }") == [("alice",)]


def test_optional_union_minus(spark):
    g = Builder().add("a", "p", 1).add("b", "p", 2).add("a", "q", 5).add("b", "r", 6).build(spark)
    assert answers(g, "SELECT ?x ?y ?z { ?x :p ?n OPTIONAL { ?x :q ?y } OPTIONAL { ?x :r ?z FILTER(?z > ?n) } }") == [("a", "5", None), ("b", None, "6")]
    # a variable that may be unbound joins with anything
    assert answers(g, "SELECT ?x ?y ?w { ?x :p ?n OPTIONAL { ?x :q ?y } { ?w :q ?y } }") == [("a", "5", "a"), ("b", "5", "a")]
    assert answers(g, "SELECT ?x { ?x :p ?n MINUS { ?x :q ?y } }") == [("b",)]
    assert answers(g, "SELECT ?x { ?x :p ?n MINUS { ?u :q ?y } }") == [("a",), ("b",)]
    assert answers(g, "SELECT ?x ?v { VALUES (?x ?v) { (:a UNDEF) (UNDEF 2) } ?x :p ?v }") == [("a", "1"), ("b", "2")]


def test_solution_modifiers(counts):
    assert answers(counts, "SELECT ?h (COUNT(*) AS ?n) (SUM(?c) AS ?t) { ?s :count ?c BIND(?c >= 5 AS ?h) } GROUP BY ?h HAVING(SUM(?c) > 20)") == [("true", "5", "35.0")]
    assert answers(counts, "SELECT (AVG(?c) + MIN(?c) / 2 AS ?x) (GROUP_CONCAT(?c; SEPARATOR='-') AS ?g) { ?s :count ?c FILTER(?c > 6) }") == [("11.5", "7-8-9")]
    assert answers(counts, "SELECT (COUNT(?x) AS ?n) { ?s :none ?x }") == [("0",)]
    assert [r[0].rsplit("|")[-1] for r in counts.keys(P + "SELECT ?c { ?s :count ?c } ORDER BY DESC(?c) LIMIT 3 OFFSET 1").collect()] == ["8", "7", "6"]
    assert len(answers(counts, "SELECT DISTINCT ?t { ?s a ?t }")) == 1
    assert answers(counts, "SELECT ?s { { SELECT (MAX(?c) AS ?m) { ?x :count ?c } } ?s :count ?m }") == [("s9",)]


def test_named_graphs(spark):
    b = Builder().add("a", "p", 1)
    b.named("g1").add("a", "p", 1).named("g2").add("b", "p", 2)
    g = b.build(spark)
    assert len(answers(g, "SELECT * { ?s :p ?o }")) == 3
    assert answers(g, "SELECT ?g ?s { GRAPH ?g { ?s :p ?o } }") == [("g1", "a"), ("g2", "b")]
    assert answers(g, "SELECT ?s { GRAPH :g2 { ?s :p ?o } }") == [("b",)]
    assert g.scan(s=Iri(EX + "a")).count() == 2
