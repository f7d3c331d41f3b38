"""Serializations, updates, streams and the endpoint."""

import json
import random
import threading
import urllib.error
import urllib.parse
import urllib.request
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from quadrille.endpoint import Endpoint, serve
from quadrille.graph import Graph
from quadrille.plans.parser import QueryError
from quadrille.sources import n3, ntriples, results, turtle
from quadrille.sources.quads import SCHEMA
from quadrille.streaming.incremental import LiveQuery, branches, is_linear
from quadrille.streaming.versioned import SnapshotStore, VersionedStream, diff
from quadrille.plans.parser import parse
from quadrille.terms import RDF, XSD, Blank, Iri, Literal, key, literal

E = lambda x: Iri("http://e/" + x)
HARD = ['quote " and \\ back', "line\nfeed\ttab\r", "ünï 日本 😀", "", "a|b", "<&>", "\\u0041"]


def quads(spark, rows):
    return spark.createDataFrame([tuple(key(t) if t is not None else None for t in (*r, *[None] * (4 - len(r)))) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(E(f"s{i}"), E("p"), literal(x)) for i, x in enumerate(HARD)]
    rows += [(E("s"), E("p"), literal(5)), (E("s"), E("p"), literal(2.5)), (E("s"), E("p"), Literal("hi", RDF + "langString", "en-gb")), (E("s"), Iri(RDF + "type"), E("T")), (E("s"), E("p"), literal(1), E("g")), (E("s"), E("q"), Literal("x", "http://t/d"), E("g"))]
    return quads(spark, rows)


def test_ntriples_round_trip(spark, mixed, tmp_path):
    ntriples.write(mixed, str(tmp_path / "out"))
    assert sorted(map(tuple, ntriples.read(spark, str(tmp_path / "out")).collect()), key=repr) == sorted(map(tuple, mixed.collect()), key=repr)


def test_ntriples_reads(spark, tmp_path):
    p = tmp_path / "a.nt"
    p.write_text('# a comment\n<http://a> <http://p> "x\\u00e9\\n"@EN . # more\n\n_:b1 <http://p> _:b2 .\n<http://a> <http://p> "1"^^<http://t> <http://g> .\n')
    got = [tuple(r) for r in ntriples.read(spark, str(p), scope="f").orderBy("o").collect()]
    assert ("Ihttp://a", "Ihttp://p", "@en|xé\n", None) in got and ("Ihttp://a", "Ihttp://p", "Lhttp://t|1", "Ihttp://g") in got
    assert any(s[0] == "B" and o[0] == "B" and s != o for s, _, o, _ in got)
    p.write_text("<http://a> <http://p> .\n")
    with pytest.raises(Exception, match="no statement"):
        ntriples.read(spark, str(p)).collect()


def test_turtle_parser():
    text = """@prefix : <http://e/> . @base <http://base/dir/doc> .
    PREFIX x: <http://x/>
    :a a :T ; :p 1, 2.5, 1e3, true, "s"@en, '''multi "quoted"
    line''' ; .
    <rel> :p <../up>, <#frag>, "t"^^x:d .
    [ :q :r ] :s ( :a [ :b _:n ] ) .
    _:n :p x:a.b, :c\\,d ."""
    got = turtle.parse(text, "f", trig=False)
    objects = [q[2] for q in got if q[0] == E("a")]
    assert objects == [E("T"), literal(1), Literal("2.5", XSD + "decimal"), Literal("1e3", XSD + "double"), literal(True), Literal("s", RDF + "langString", "en"), literal('multi "quoted"\n    line')]
    assert [q[2] for q in got if q[0] == Iri("http://base/dir/rel")] == [Iri("http://base/up"), Iri("http://base/dir/doc#frag"), Literal("t", "http://x/d")]
    assert sum(q[1] == Iri(RDF + "first") for q in got) == 2 and {q[2] for q in got if q[0] == Blank("f.n")} == {Iri("http://x/a.b"), Iri("http://e/c,d")}
    for bad in ("<a> <b> .", "<a> <b> <c>", ":a :b :c .", '"x" <p> <o> .', "<a> <b> <c> ; <d> ."):
        with pytest.raises(turtle.TurtleError):
            turtle.parse(bad, trig=False)


def test_trig_parser():
    got = turtle.parse("@prefix : <http://e/> . :a :p 1 . :g { :b :p 2 . :c :p 3 } GRAPH :h { :d :p 4 } { :e :p 5 }")
    assert [(q[0].value[-1], q[3].value[-1] if q[3] else None) for q in got] == [("a", None), ("b", "g"), ("c", "g"), ("d", "h"), ("e", None)]


def test_turtle_round_trip(spark, mixed, tmp_path):
    turtle.write(mixed, str(tmp_path / "out"), {"e": "http://e/"})
    body = "".join(p.read_text() for p in (tmp_path / "out").glob("*.txt"))
    assert "@prefix e: <http://e/>" in body and "e:s a e:T" in body
    assert sorted(map(tuple, turtle.read(spark, str(tmp_path / "out")).collect()), key=repr) == sorted(map(tuple, mixed.collect()), key=repr)


def test_results(spark, mixed):
    answer = Graph.of_quads(mixed).query("SELECT ?s ?o ?none { ?s <http://e/p> ?o }")
    doc = json.loads(results.to_json(answer))
    assert doc["head"]["vars"] == ["s", "o", "none"] and len(doc["results"]["bindings"]) == answer.count()
    assert {b["o"]["value"] for b in doc["results"]["bindings"]} >= set(HARD)
    back = results.from_json(spark, results.to_json(answer))
    assert sorted(map(repr, back.collect())) == sorted(map(repr, answer.collect()))
    tree = ET.fromstring(results.to_xml(answer))
    texts = {e.text or "" for e in tree.iter("{http://www.w3.org/2005/sparql-results#}literal")}
    assert '<&>' in texts and 'quote " and \\ back' in texts


def test_updates(spark, mixed):
    text = "PREFIX e: <http://e/> INSERT DATA { e:n e:p 1 . GRAPH e:g { e:n e:p 2 } } ; DELETE DATA { e:s e:p 5 . e:n e:p 1 }"
    after = {tuple(r) for r in results.apply_update(mixed, text).collect()}
    before = {tuple(r) for r in mixed.collect()}
    assert after - before == {("Ihttp://e/n", "Ihttp://e/p", key(literal(2)), "Ihttp://e/g")} and before - after == {("Ihttp://e/s", "Ihttp://e/p", key(literal(5)), None)}
    with pytest.raises(QueryError):
        results.parse_update("LOAD <http://x>")


def test_endpoint(spark, mixed):
    server = serve(Endpoint(mixed))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/sparql"
    ask = lambda q: json.load(urllib.request.urlopen(url + "?" + urllib.parse.urlencode({"query": q})))
    try:
        query = "SELECT ?o { <http://e/s> <http://e/z> ?o }"
        assert ask(query)["results"]["bindings"] == []
        urllib.request.urlopen(url, urllib.parse.urlencode({"update": "INSERT DATA { <http://e/s> <http://e/z> 7 }"}).encode())
        assert [b["o"]["value"] for b in ask(query)["results"]["bindings"]] == ["7"]
        with pytest.raises(urllib.error.HTTPError):
            ask("SELECT nonsense")
    finally:
        server.shutdown()


def test_formatters(spark, mixed):
    rows = [r.value for r in turtle.documents(mixed, {"e": "http://e/"}, pretty=False).collect()]
    assert all("\n" not in r for r in rows) and any(" ; " in r for r in rows)
    again = [q for r in rows for q in turtle.parse("@prefix e: <http://e/> . " + r)]
    assert len(again) == mixed.distinct().count()
    assert any(";\n\t\t" in r.value for r in turtle.documents(mixed, indent="\t\t").collect())


def test_n3(spark):
    rows = quads(spark, [(E("a"), E("says"), E("g")), (E("b"), E("p"), literal(1), E("g")), (E("h"), E("q"), literal(2), E("g")), (E("c"), E("r"), E("d"), E("h"))])
    assert [r.value for r in n3.documents(rows).collect()] == ["<http://e/a> <http://e/says> { <http://e/b> <http://e/p> " + '"1"^^<http://www.w3.org/2001/XMLSchema#integer> . { <http://e/c> <http://e/r> <http://e/d> . } <http://e/q> "2"^^<http://www.w3.org/2001/XMLSchema#integer> . } .']
    with pytest.raises(ValueError):
        n3.documents(quads(spark, [(E("a"), E("p"), E("g")), (E("g"), E("p"), E("x"), E("g"))]))


def test_statements_in_a_string(spark):
    got = ntriples.parse(spark, '<http://e/a> <http://e/p> "x\\ny"@EN .\n# nothing\n\n_:b <http://e/p> <http://e/c> <http://e/g> .')
    assert {(r.s[0], r.o, r.g) for r in got.collect()} == {("I", "@en|x\ny", None), ("B", "Ihttp://e/c", "Ihttp://e/g")}


def test_follow_and_tabulate(spark):
    graph = Graph.of_quads(quads(spark, [(E("a"), E("p"), literal(1)), (E("b"), E("p"), literal("two"))]))
    seen = []
    graph.follow("SELECT ?s ?o ?none { ?s <http://e/p> ?o }", lambda w, row: seen.append((w, row["s"], row["o"], len(row))))
    assert sorted(seen, key=repr) == [(1, E("a"), literal(1), 2), (1, E("b"), literal("two"), 2)]
    lines = graph.tabulate("SELECT ?s ?o ?none { ?s <http://e/p> ?o } ORDER BY ?s", order=("o",)).split("\n")
    assert [x.strip() for x in lines[0].split(" | ")] == ["#", "o", "s", "none"] and lines[2].startswith('2 | "two"') and len({len(x) for x in lines}) == 1


# live queries
def changes(spark, rows):
    return spark.createDataFrame([(key(E(s)), key(E(p)), key(o if not isinstance(o, str) else E(o)), None, w) for s, p, o, w in rows], SCHEMA + ", w bigint")


QUERIES = {
    "join": "SELECT ?a ?c { ?a <http://e/p> ?b . ?b <http://e/q> ?c }",
    "self": "SELECT ?a ?c { ?a <http://e/p> ?b . ?b <http://e/p> ?c FILTER(?a != ?c) }",
    "union": "SELECT * { { ?a <http://e/p> ?b } UNION { ?b (<http://e/q>|<http://e/p>) ?a } ?b ?any ?x }",
    "closure": "SELECT * { ?a <http://e/p>+ ?b }",
    "absent": "SELECT ?a { ?a <http://e/p> ?b FILTER NOT EXISTS { ?b <http://e/q> ?c } }",
    "present": "SELECT ?a ?b { ?a <http://e/p> ?b FILTER EXISTS { ?b <http://e/q> ?c . ?c <http://e/p> ?d } }",
    "anything": "SELECT ?a { ?a <http://e/p> ?b FILTER EXISTS { ?x <http://e/q> ?y } }",
    "correlated": "SELECT ?a { ?a <http://e/p> ?b FILTER NOT EXISTS { ?a <http://e/q> ?c FILTER(?c = ?b) } }",
    "optional": "SELECT ?a ?c { ?a <http://e/p> ?b OPTIONAL { ?b <http://e/q> ?c } }",
}


@pytest.mark.parametrize("name", QUERIES)
def test_live_equals_batch(spark, name):
    """Random additions and removals: after each batch the kept results are those of a fresh query."""
    r = random.Random(name)
    assert is_linear(parse(QUERIES[name])) == (name in ("join", "self", "union"))
    live = LiveQuery(spark, QUERIES[name], checked=True)
    assert (live.guard is not None) == (name in ("absent", "present", "anything"))
    store = set()
    for _ in range(3):
        batch = []
        for _ in range(12):
            q = (r.choice("abcd"), r.choice("pq"), r.choice("abcd"))
            w = -1 if store and r.random() < 0.4 else 1
            if w < 0:
                q = r.choice(sorted(store))
            if q in [b[:3] for b in batch]:
                continue
            batch.append((*q, w))
            (store.add if w > 0 else store.discard)(q)
        delta = live.push(changes(spark, batch))
        assert delta.where("n = 0").count() == 0
        graph = Graph.of_quads(changes(spark, [(*q, 1) for q in sorted(store)]).select("s", "p", "o", "g")) if store else None
        want = {}
        for row in graph.keys(QUERIES[name]).select(*live.names).collect() if graph else []:
            want[tuple(row)] = want.get(tuple(row), 0) + 1
        assert {tuple(x)[:-1]: x.n for x in live.results().collect()} == want


def test_branches_have_no_unions():
    q = parse(QUERIES["union"])
    assert len(branches(q.body)) == 3


def test_deferred_and_repeated_batches(spark):
    live = LiveQuery(spark, QUERIES["join"], deferred=True)
    assert live.push(changes(spark, [("a", "p", "b", 1), ("b", "q", "c", 1), ("x", "p", "b", 1)]), 0) is None
    assert live.push(changes(spark, [("x", "p", "b", -1)]), 1) is None
    assert live.push(changes(spark, [("a", "p", "b", -1)]), 1) is None  # an epoch seen before is left out
    assert [tuple(r) for r in live.results().collect()] == [("Ihttp://e/a", "Ihttp://e/c", 1)]


def test_a_failed_batch_comes_again(spark, monkeypatch):
    """What fails while it is written leaves the state as it was; the batch's second attempt counts."""
    live = LiveQuery(spark, QUERIES["join"])
    live.push(changes(spark, [("b", "q", "c", 1)]), 6)
    log, calls = LiveQuery._log, []

    def broken(self, df, what):
        calls.append(what)
        if what == "result-changes":
            raise OSError("disk full")
        return log(self, df, what)

    monkeypatch.setattr(LiveQuery, "_log", broken)
    with pytest.raises(OSError):
        live.push(changes(spark, [("a", "p", "b", 1)]), 7)
    monkeypatch.setattr(LiveQuery, "_log", log)
    assert live.epoch == 6 and "result-changes" in calls
    assert [tuple(r) for r in live.push(changes(spark, [("a", "p", "b", 1)]), 7).collect()] == [("Ihttp://e/a", "Ihttp://e/c", 1)]
    assert live.results().count() == 1 and live.epoch == 7


def test_state_outlives_the_query(spark, tmp_path):
    """A new query over the same checkpoint goes on with the store and the results that were there."""
    folder, at = str(tmp_path / "in"), str(tmp_path / "at")
    changes(spark, [("a", "p", "b", 1), ("b", "q", "c", 1)]).coalesce(1).write.parquet(folder)
    stream = lambda: spark.readStream.schema(SCHEMA + ", w bigint").parquet(folder)
    first = LiveQuery(spark, QUERIES["join"])
    q = first.subscribe(stream(), at)
    q.processAllAvailable()
    q.stop()
    changes(spark, [("x", "p", "b", 1)]).coalesce(1).write.mode("append").parquet(folder)
    second = LiveQuery(spark, QUERIES["join"])
    q = second.subscribe(stream(), at)
    try:
        q.processAllAvailable()
        assert sorted(r.a for r in second.results().collect()) == ["Ihttp://e/a", "Ihttp://e/x"]
    finally:
        q.stop()


def test_logs_are_merged(spark):
    """Many small batches: the store stays a few tables, and old ones are deleted."""
    live = LiveQuery(spark, QUERIES["join"])
    for k in range(4):
        live.push(changes(spark, [(f"a{k}", "p", "b", 1), (f"b{k}", "q", "c", 1), ("b", "q", f"c{k}", 1)]))
    assert live.store.count() == 12 and len(live.state.store) < 4
    assert sum(r.n for r in live.results().collect()) == 16


def test_counts_beside_a_variable_of_that_name(spark):
    live = LiveQuery(spark, "SELECT ?n { ?n <http://e/p> ?b }")
    live.push(changes(spark, [("a", "p", "b", 1), ("a", "p", "c", 1)]))
    assert [tuple(r) for r in live.results().collect()] == [("Ihttp://e/a", 2)] and live.n == "_n"


def test_follows_a_stream(spark, tmp_path):
    live = LiveQuery(spark, QUERIES["join"])
    folder = str(tmp_path / "in")
    changes(spark, [("a", "p", "b", 1), ("b", "q", "c", 1)]).coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(SCHEMA + ", w bigint").parquet(folder)
    q = live.subscribe(stream, str(tmp_path / "at"))
    try:
        q.processAllAvailable()
        assert live.results().count() == 1
        changes(spark, [("a", "p", "b", -1)]).coalesce(1).write.mode("append").parquet(folder)
        q.processAllAvailable()
        assert live.results().count() == 0
    finally:
        q.stop()


# versions
def versions(spark, rows):
    return spark.createDataFrame([(key(E(b)), ts, key(E(b)), key(E("v")), key(literal(v))) for b, ts, v in rows], "base string, ts string, s string, p string, o string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_versioned_stream(spark):
    s = VersionedStream(spark)
    s.append(versions(spark, [("a", "2024-01-01", 1), ("a", "2024-01-03", 2), ("b", "2024-01-02", 3)]))
    s.append(versions(spark, [("a", "2024-01-03", 9)]))  # the same time, later: it counts
    value = lambda df: sorted(r.o.split("|")[1] for r in df.collect())
    assert value(s.as_of("2024-01-01")) == ["1"] and value(s.as_of("2024-01-02 12:00:00")) == ["1", "3"] and value(s.as_of()) == ["3", "9"]
    assert value(s.version(key(E("a")), "2024-01-03", inclusive=False)) == ["1"] and value(s.version(key(E("a")), "2024-01-03")) == ["9"]
    assert {r.id for r in s.members.collect()} == {"Ihttp://e/a_v0", "Ihttp://e/a_v1", "Ihttp://e/a_v2", "Ihttp://e/b_v0"}


def test_stream_as_rdf(spark):
    s = VersionedStream(spark)
    s.append(versions(spark, [("a", "2024-01-01", 1), ("a", "2024-01-03", 2), ("b", "2024-01-02", 3)]))
    rdf = s.to_quads("http://e/stream", "http://e/at", "http://e/of")
    assert rdf.where("p = 'Ihttps://w3id.org/tree#member'").count() == 3
    back = VersionedStream.of_quads(spark, rdf, "http://e/stream")
    assert sorted(map(tuple, back.as_of("2024-01-02").select("s", "p", "o").collect())) == sorted(map(tuple, s.as_of("2024-01-02").select("s", "p", "o").collect()))
    with pytest.raises(ValueError):
        VersionedStream.of_quads(spark, rdf, "http://e/other")


def test_clusters_and_transforms_of_ones_own(spark):
    """Snapshots by the first letter of subjects; content marked instead of put into graphs."""

    class Marked:
        def encode(self, content):
            return content.select("s", "p", "o", F.concat(F.lit("Ihttp://mark/"), "id").alias("g"))

        def decode(self, quads, ids):
            return quads.join(ids.select(F.concat(F.lit("Ihttp://mark/"), "id").alias("_g")), F.col("g") == F.col("_g"), "left_semi")

    store = SnapshotStore(spark, "2024-01-01 00:00:00", lambda: F.substring("s", 1, 11))
    store.stream.transform = Marked()
    a = quads(spark, [(E("a1"), E("v"), literal(1)), (E("a2"), E("v"), literal(1)), (E("b1"), E("v"), literal(1))]).select("s", "p", "o")
    b = quads(spark, [(E("a1"), E("v"), literal(1)), (E("a2"), E("v"), literal(2)), (E("b1"), E("v"), literal(1))]).select("s", "p", "o")
    store.add(a)
    store.add(b)
    assert store.stream.members.count() == 3  # the cluster of a1 and a2 has two versions, that of b1 one
    assert sorted(map(tuple, store.snapshot(1).collect())) == sorted(map(tuple, b.collect()))


def test_snapshots(spark):
    states = [[("a", 1), ("b", 1)], [("a", 1), ("b", 2), ("c", 3)], [("b", 2)]]
    store = SnapshotStore(spark, "2024-01-01 00:00:00")
    tables = [quads(spark, [(E(s), E("v"), literal(v)) for s, v in state]).select("s", "p", "o") for state in states]
    for t in tables:
        store.add(t)
    for k, t in enumerate(tables):
        assert sorted(map(tuple, store.snapshot(k).collect())) == sorted(map(tuple, t.collect()))
    assert store.stream.members.count() == 2 + 2 + 2  # only what changed is stored
    came, went = list(store.diffs())[2]
    assert came.count() == 0 and went.count() == 2
    with pytest.raises(ValueError):
        store.add(quads(spark, [(Blank("x"), E("v"), literal(1))]))
    a, b = diff(tables[0], tables[1])
    assert (a.count(), b.count()) == (2, 1)
