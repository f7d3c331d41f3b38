"""The engine's operators as named queries on the test tables, with the same results in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.build import Builder
from quadrille.endpoint import Endpoint
from quadrille.graph import Graph
from quadrille.sources import n3, ntriples, results, turtle
from quadrille.sources.quads import read_store, write_store
from quadrille.sources.tables import TPCH, TableSource
from quadrille.storage import fresh_path
from quadrille.streaming.incremental import LiveQuery
from quadrille.streaming.versioned import SnapshotStore, VersionedStream, as_of_rows, diff
from quadrille.terms import Iri

PREFIXES = "".join(f"PREFIX {n}: <urn:{t}#> " for n, t in (("r", "region"), ("n", "nation"), ("c", "customer"), ("s", "supplier"), ("p", "part"), ("o", "orders"), ("l", "lineitem"), ("e", "events"))) + "PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> PREFIX rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> "

#: name: (SPARQL, SQL)
SPARQL: dict[str, tuple[str, str]] = {
    "bgp_star_join": (
        'SELECT ?o ?n ?t { ?o o:o_custkey ?c . ?c c:c_mktsegment "BUILDING" ; c:c_name ?n . ?o o:o_totalprice ?t FILTER(?t > 150000) }',
        "SELECT o_orderkey AS o, c_name AS n, o_totalprice AS t FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 150000",
    ),
    "bgp_chain_join": (
        "SELECT ?r (COUNT(?l) AS ?n) (ROUND(SUM(?x) * 100) / 100 AS ?total) { ?l l:l_orderkey ?o ; l:l_extendedprice ?x . ?o o:o_custkey ?c . ?c c:c_nationkey ?na . ?na n:n_regionkey ?re . ?re r:r_name ?r } GROUP BY ?r",
        "SELECT r_name AS r, count(*) AS n, floor(sum(l_extendedprice) * 100 + 0.5) / 100 AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    ),
    "scan_exact_predicate": ("SELECT ?n ?name { ?n n:n_name ?name }", "SELECT n_nationkey AS n, n_name AS name FROM nation"),
    "scan_variable_predicate": (
        "SELECT ?s ?p ?o { ?s a <urn:nation> . ?s ?p ?o }",
        "SELECT 'urn:nation:' || n_nationkey AS s, 'urn:nation#' || k AS p, v AS o FROM (SELECT n_nationkey, 'n_nationkey' AS k, n_nationkey::VARCHAR AS v FROM nation UNION ALL SELECT n_nationkey, 'n_name', n_name FROM nation UNION ALL SELECT n_nationkey, 'n_regionkey', 'urn:region:' || n_regionkey FROM nation) UNION ALL SELECT 'urn:nation:' || n_nationkey, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'urn:nation' FROM nation",
    ),
    "scan_constant_subject": ("SELECT ?n ?b { <urn:customer:7> c:c_name ?n ; c:c_acctbal ?b }", "SELECT c_name AS n, c_acctbal AS b FROM customer WHERE c_custkey = 7"),
    "scan_constant_object": ("SELECT ?c ?n { ?c c:c_nationkey <urn:nation:5> ; c:c_name ?n }", "SELECT c_custkey AS c, c_name AS n FROM customer WHERE c_nationkey = 5"),
    "scan_repeated_variable": ("SELECT ?l ?x { ?na n:n_nationkey ?x . ?na n:n_name ?l . ?re r:r_regionkey ?x }", "SELECT n_name AS l, n_nationkey AS x FROM nation JOIN region ON n_nationkey = r_regionkey"),
    "scan_negated_set": ("SELECT ?r ?v { ?r a <urn:region> . ?r !(r:r_name|rdf:type) ?v }", "SELECT 'urn:region:' || r_regionkey AS r, r_regionkey::VARCHAR AS v FROM region"),
    "path_alternative": (
        "SELECT ?x { ?x (c:c_nationkey|s:s_nationkey) <urn:nation:7> }",
        "SELECT 'urn:customer:' || c_custkey AS x FROM customer WHERE c_nationkey = 7 UNION ALL SELECT 'urn:supplier:' || s_suppkey FROM supplier WHERE s_nationkey = 7",
    ),
    "path_sequence": (
        "SELECT ?name (COUNT(?o) AS ?n) { ?o o:o_custkey/c:c_nationkey/n:n_regionkey/r:r_name ?name } GROUP BY ?name",
        "SELECT r_name AS name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    ),
    "path_alternative_sequences": (
        "SELECT ?x ?n { ?x (c:c_nationkey/n:n_name|s:s_nationkey/n:n_name) ?n }",
        "SELECT 'urn:customer:' || c_custkey AS x, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'urn:supplier:' || s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    ),
    "path_negated_inverse": ("SELECT ?x { <urn:region:3> ^n:n_regionkey/!(n:n_name|n:n_nationkey|rdf:type|^c:c_nationkey|^s:s_nationkey) ?x }", "SELECT 'urn:region:' || 3 AS x FROM nation WHERE n_regionkey = 3"),
    "path_counted": (
        "SELECT ?c ?r { ?c c:c_acctbal ?b . ?c (c:c_nationkey|n:n_regionkey){1,2} ?r FILTER(?b > 9900) }",
        "SELECT 'urn:customer:' || c_custkey AS c, 'urn:nation:' || c_nationkey AS r FROM customer WHERE c_acctbal > 9900 UNION ALL SELECT 'urn:customer:' || c_custkey, 'urn:region:' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9900",
    ),
    "path_zero_or_one": (
        "SELECT ?c ?x { ?c c:c_acctbal ?b . ?c c:c_nationkey? ?x FILTER(?b < -900) }",
        "SELECT c_custkey AS c, 'urn:customer:' || c_custkey AS x FROM customer WHERE c_acctbal < -900 UNION ALL SELECT c_custkey, 'urn:nation:' || c_nationkey FROM customer WHERE c_acctbal < -900",
    ),
    "path_zero_or_more_bound": (
        'SELECT ?c ?x { ?c c:c_mktsegment "BUILDING" . ?c (c:c_nationkey|n:n_regionkey)* ?x }',
        "WITH b AS (SELECT c_custkey AS c, c_nationkey AS n, n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING') SELECT c, 'urn:customer:' || c AS x FROM b UNION ALL SELECT c, 'urn:nation:' || n FROM b UNION ALL SELECT c, 'urn:region:' || r FROM b",
    ),
    "path_inverse": ("SELECT ?c ?s { ?c c:c_nationkey/^s:s_nationkey ?s }", "SELECT c_custkey AS c, s_suppkey AS s FROM customer JOIN supplier ON c_nationkey = s_nationkey"),
    "path_one_or_more": (
        "SELECT ?a ?b { ?a (n:n_regionkey/^n:n_regionkey)+ ?b }",
        "WITH RECURSIVE e AS (SELECT x.n_nationkey AS a, y.n_nationkey AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey), p AS (SELECT a, b FROM e UNION SELECT p.a, e.b FROM p JOIN e ON p.b = e.a) SELECT 'urn:nation:' || a AS a, 'urn:nation:' || b AS b FROM p",
    ),
    "path_zero_or_more_from": (
        "SELECT ?b { <urn:nation:3> (n:n_regionkey|^n:n_regionkey)* ?b }",
        "WITH RECURSIVE e AS (SELECT 'urn:nation:' || n_nationkey AS a, 'urn:region:' || n_regionkey AS b FROM nation), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), p AS (SELECT 'urn:nation:3' AS b UNION SELECT u.b FROM p JOIN u ON p.b = u.a) SELECT b FROM p",
    ),
    "path_zero_or_more_to": (
        "SELECT ?a { ?a (c:c_nationkey|n:n_regionkey)* <urn:region:1> }",
        "SELECT 'urn:region:1' AS a UNION SELECT 'urn:nation:' || n_nationkey FROM nation WHERE n_regionkey = 1 UNION SELECT 'urn:customer:' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1",
    ),
    "path_one_or_more_between": ("SELECT ?n { <urn:customer:10> (c:c_nationkey|n:n_regionkey)+ ?r . ?r r:r_name ?n }", "SELECT r_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey = 10"),
    "join_unbound_variables": (
        "SELECT ?na ?c ?s { { ?c c:c_nationkey ?na ; c:c_mktsegment \"MACHINERY\" } UNION { ?s s:s_nationkey ?na } { ?na n:n_regionkey <urn:region:2> } UNION { ?s s:s_acctbal ?b ; s:s_nationkey ?na FILTER(?b > 9000) } }",
        """WITH a AS (SELECT c_nationkey AS na, c_custkey AS c, NULL::BIGINT AS s FROM customer WHERE c_mktsegment = 'MACHINERY' UNION ALL SELECT s_nationkey, NULL, s_suppkey FROM supplier),
        b AS (SELECT n_nationkey AS na, NULL::BIGINT AS s FROM nation WHERE n_regionkey = 2 UNION ALL SELECT s_nationkey, s_suppkey FROM supplier WHERE s_acctbal > 9000)
        SELECT a.na, a.c, coalesce(a.s, b.s) AS s FROM a JOIN b ON a.na = b.na AND (a.s IS NULL OR b.s IS NULL OR a.s = b.s)""",
    ),
    "join_product": ("SELECT ?a ?b { ?x r:r_name ?a . ?y n:n_name ?b }", "SELECT r_name AS a, n_name AS b FROM region, nation"),
    "union_bag": (
        "SELECT ?n ?b { { ?x c:c_name ?n ; c:c_acctbal ?b } UNION { ?x s:s_name ?n ; s:s_acctbal ?b } FILTER(?b < 0) }",
        "SELECT * FROM (SELECT c_name AS n, c_acctbal AS b FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier) WHERE b < 0",
    ),
    "filter_arithmetic": (
        'SELECT ?o ?t { ?o o:o_totalprice ?t ; o:o_orderstatus ?s FILTER(?t * 0.9 - 100 > 200000 && (?s = "O" || ?s = "P")) }',
        "SELECT o_orderkey AS o, o_totalprice AS t FROM orders WHERE o_totalprice * 0.9::DOUBLE - 100 > 200000 AND o_orderstatus IN ('O', 'P')",
    ),
    "filter_datetime": (
        'SELECT ?o { ?o o:o_orderdate ?d FILTER(?d >= "1997-01-01T00:00:00"^^xsd:dateTime && ?d < "1997-07-01T00:00:00"^^xsd:dateTime) }',
        "SELECT o_orderkey AS o FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-07-01'",
    ),
    "filter_in": ('SELECT ?c { ?c c:c_mktsegment ?m FILTER(?m IN ("BUILDING", "AUTOMOBILE")) }', "SELECT c_custkey AS c FROM customer WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE')"),
    "filter_strings": (
        'SELECT ?p (STRLEN(?n) AS ?len) (UCASE(SUBSTR(?n, 1, 4)) AS ?head) { ?p p:p_name ?n FILTER(REGEX(?n, "a.*e", "i") && !STRSTARTS(?n, "b")) }',
        "SELECT p_partkey AS p, length(p_name)::BIGINT AS len, upper(substr(p_name, 1, 4)) AS head FROM part WHERE regexp_matches(p_name, 'a.*e', 'i') AND NOT starts_with(p_name, 'b')",
    ),
    "filter_unary_minus": ("SELECT ?c { ?c c:c_acctbal ?b FILTER(-?b > 500 && -(-?b) < 0) }", "SELECT c_custkey AS c FROM customer WHERE -c_acctbal > 500"),
    "filter_errors": (
        'SELECT ?p ?i ?s (SUBSTR(?n, 0, 4) AS ?head) (ENCODE_FOR_URI(?n) AS ?code) (MD5(?n) AS ?sum) { ?p p:p_name ?n ; p:p_retailprice ?x BIND(xsd:integer(?x * 1e30) AS ?i) BIND(SUBSTR(?n, 1e30) AS ?s) FILTER(!REGEX(?n, "z") || REGEX(?n, "(")) FILTER(REGEX(?n, "^.") || REGEX(?n, CONCAT("(", ?n))) }',
        "SELECT p_partkey AS p, NULL::BIGINT AS i, '' AS s, substr(p_name, 1, 3) AS head, replace(p_name, ' ', '%20') AS code, md5(p_name) AS sum FROM part WHERE p_name NOT LIKE '%z%'",
    ),
    "filter_exists_or": (
        "SELECT ?c { ?c c:c_acctbal ?b FILTER(?b > 9900 || EXISTS { ?o o:o_custkey ?c ; o:o_totalprice ?t FILTER(?t > 300000) }) }",
        "SELECT c_custkey AS c FROM customer WHERE c_acctbal > 9900 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    ),
    "filter_exists": ("SELECT ?c { ?c c:c_acctbal ?b FILTER EXISTS { ?o o:o_custkey ?c ; o:o_totalprice ?t FILTER(?t > 300000) } }", "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)"),
    "filter_not_exists": ("SELECT ?c ?n { ?c c:c_name ?n FILTER NOT EXISTS { ?o o:o_custkey ?c ; o:o_totalprice ?t FILTER(?t > 250000) } }", "SELECT c_custkey AS c, c_name AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)"),
    "filter_exists_broad": ("SELECT ?r { ?x r:r_name ?r FILTER EXISTS { ?o o:o_totalprice ?t FILTER(?t > 1e5) } }", "SELECT r_name AS r FROM region WHERE EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 1e5)"),
    "filter_not_exists_broad": ("SELECT ?r { ?x r:r_name ?r FILTER NOT EXISTS { ?o o:o_totalprice ?t FILTER(?t > 1e9) } }", "SELECT r_name AS r FROM region WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 1e9)"),
    "filter_not_exists_correlated": (
        "SELECT ?s ?b { ?s s:s_nationkey ?n ; s:s_acctbal ?b FILTER NOT EXISTS { ?s2 s:s_nationkey ?n ; s:s_acctbal ?b2 FILTER(?b2 > ?b) } }",
        "SELECT s_suppkey AS s, s_acctbal AS b FROM supplier x WHERE NOT EXISTS (SELECT 1 FROM supplier y WHERE y.s_nationkey = x.s_nationkey AND y.s_acctbal > x.s_acctbal)",
    ),
    "filter_exists_nested": (
        'SELECT ?n { ?n n:n_name ?m FILTER EXISTS { ?c c:c_nationkey ?n ; c:c_mktsegment "BUILDING" FILTER NOT EXISTS { ?o o:o_custkey ?c ; o:o_totalprice ?t FILTER(?t > 250000) } } }',
        "SELECT n_nationkey AS n FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_mktsegment = 'BUILDING' AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000))",
    ),
    "optional_filtered": (
        "SELECT ?c ?o ?t { ?c c:c_acctbal ?b FILTER(?b > 9000) OPTIONAL { ?o o:o_custkey ?c ; o:o_totalprice ?t FILTER(?t > ?b * 20) } }",
        "SELECT c_custkey AS c, o_orderkey AS o, o_totalprice AS t FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 20 WHERE c_acctbal > 9000",
    ),
    "minus": ("SELECT ?s { ?s s:s_nationkey ?n MINUS { ?c c:c_nationkey ?n ; c:c_acctbal ?b FILTER(?b > 9900) } }", "SELECT s_suppkey AS s FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)"),
    "values": ('SELECT ?c ?n { VALUES (?n) { (<urn:nation:1>) (<urn:nation:4>) } ?c c:c_nationkey ?n ; c:c_mktsegment "HOUSEHOLD" }', "SELECT c_custkey AS c, 'urn:nation:' || c_nationkey AS n FROM customer WHERE c_nationkey IN (1, 4) AND c_mktsegment = 'HOUSEHOLD'"),
    "bind": ('SELECT ?c ?x ?y { ?c c:c_acctbal ?b ; c:c_name ?n BIND(?b / 2 + 1 AS ?x) BIND(CONCAT(?n, "/", STR(?c)) AS ?y) }', "SELECT c_custkey AS c, c_acctbal / 2 + 1 AS x, c_name || '/urn:customer:' || c_custkey AS y FROM customer"),
    "projected_conditional": ('SELECT ?c (IF(?b < 0, "debt", IF(?b > 5000, "rich", "other")) AS ?k) { ?c c:c_acctbal ?b }', "SELECT c_custkey AS c, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal > 5000 THEN 'rich' ELSE 'other' END AS k FROM customer"),
    "aggregate_all": (
        "SELECT ?s (COUNT(*) AS ?n) (COUNT(DISTINCT ?c) AS ?cs) (MIN(?t) AS ?lo) (MAX(?t) AS ?hi) (ROUND(AVG(?t) * 100) / 100 AS ?mid) (MIN(?d) AS ?first) { ?o o:o_orderstatus ?s ; o:o_totalprice ?t ; o:o_custkey ?c ; o:o_orderdate ?d } GROUP BY ?s",
        "SELECT o_orderstatus AS s, count(*) AS n, count(DISTINCT o_custkey) AS cs, min(o_totalprice) AS lo, max(o_totalprice) AS hi, floor(avg(o_totalprice) * 100 + 0.5) / 100 AS mid, min(o_orderdate) AS first FROM orders GROUP BY o_orderstatus",
    ),
    "aggregate_having": ("SELECT ?c (COUNT(?o) AS ?n) { ?o o:o_custkey ?c } GROUP BY ?c HAVING (COUNT(?o) > 15)", "SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15"),
    "aggregate_concat": ('SELECT ?r (GROUP_CONCAT(?n; SEPARATOR=",") AS ?all) (SAMPLE(?n) AS ?one) { ?x n:n_regionkey ?y ; n:n_name ?n . ?y r:r_name ?r } GROUP BY ?r', "SELECT r_name AS r, string_agg(n_name, ',' ORDER BY n_name) AS \"all\", min(n_name) AS one FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"),
    "aggregate_by_expression": ("SELECT ?y (COUNT(?o) AS ?n) { ?o o:o_orderdate ?d } GROUP BY (YEAR(?d) AS ?y)", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1"),
    "aggregate_whole": ("SELECT (SUM(?q) AS ?total) (COUNT(DISTINCT ?f) AS ?kinds) { ?l l:l_quantity ?q ; l:l_returnflag ?f }", "SELECT sum(l_quantity) AS total, count(DISTINCT l_returnflag) AS kinds FROM lineitem"),
    "order_by_limit": ("SELECT ?o ?t { ?o o:o_totalprice ?t } ORDER BY DESC(?t) ?o LIMIT 20 OFFSET 5", "SELECT o_orderkey AS o, o_totalprice AS t FROM orders ORDER BY t DESC, o LIMIT 20 OFFSET 5"),
    "order_distinct_limit": ("SELECT DISTINCT ?t { ?p p:p_type ?t } ORDER BY DESC(?t) LIMIT 5", "SELECT DISTINCT p_type AS t FROM part ORDER BY t DESC LIMIT 5"),
    "order_distinct_by_other": (
        "SELECT DISTINCT ?m { ?c c:c_mktsegment ?m ; c:c_acctbal ?b } ORDER BY DESC(?b) LIMIT 3",
        "SELECT c_mktsegment AS m FROM customer GROUP BY 1 ORDER BY max(c_acctbal) DESC LIMIT 3",
    ),
    "aggregate_count_distinct_all": (
        "SELECT (COUNT(DISTINCT *) AS ?n) (COUNT(*) AS ?every) { { ?c c:c_nationkey ?na } UNION { ?c c:c_nationkey ?na ; c:c_acctbal ?b } }",
        "SELECT count(DISTINCT (c, na, b)) AS n, count(*) AS every FROM (SELECT c_custkey AS c, c_nationkey AS na, NULL AS b FROM customer UNION ALL SELECT c_custkey, c_nationkey, c_acctbal FROM customer)",
    ),
    "aggregate_no_pattern": ("SELECT (COUNT(*) AS ?n) (1 + 2 AS ?three) { }", "SELECT 1::BIGINT AS n, 3::BIGINT AS three"),
    "distinct": ("SELECT DISTINCT ?m ?n { ?c c:c_mktsegment ?m ; c:c_nationkey ?n }", "SELECT DISTINCT c_mktsegment AS m, c_nationkey AS n FROM customer"),
    "sub_select": (
        "SELECT ?n ?best { { SELECT ?na (MAX(?b) AS ?best) { ?s s:s_nationkey ?na ; s:s_acctbal ?b } GROUP BY ?na } ?na n:n_name ?n }",
        "SELECT n_name AS n, best FROM (SELECT s_nationkey, max(s_acctbal) AS best FROM supplier GROUP BY 1) JOIN nation ON s_nationkey = n_nationkey",
    ),
}


def _table_quads(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Quads of term keys of one table."""
    source = TableSource.parquet(spark, sf_dir, TPCH)
    m = source.mappings[table]
    df = source.tables[table]
    s = source.subject_map(m).key(source.subject(m))
    cells = F.array(*(F.struct(F.lit(f"Iurn:{table}#{c}").alias("p"), source.object_map(m, c).key(F.col(c)).alias("o")) for c in source.columns(m)))
    return df.select(s.alias("s"), F.explode(cells).alias("c")).select("s", "c.p", "c.o", F.lit(None).cast("string").alias("g")).where("o IS NOT NULL")


def _plain(graph: Graph, query: str) -> DataFrame:
    return graph.values(PREFIXES + query)


def quads_lookup(spark, sf_dir):
    """Patterns on a graph that is held as quads."""
    quads = _table_quads(spark, sf_dir, "nation").union(_table_quads(spark, sf_dir, "region"))
    return _plain(Graph.of_quads(quads), "SELECT ?n ?r { ?x n:n_name ?n ; n:n_regionkey/r:r_name ?r }")


def quads_store(spark, sf_dir):
    """Patterns on a store on disk, whose scans read what they need."""
    path = fresh_path(spark, "store")
    write_store(_table_quads(spark, sf_dir, "customer").union(_table_quads(spark, sf_dir, "nation")), path)
    return _plain(Graph(read_store(spark, path)), "SELECT ?name ?n { ?x c:c_nationkey ?na ; c:c_name ?name . ?na n:n_name ?n }")


def scan_wildcard(spark, sf_dir):
    """All quads with one predicate, any subject and object."""
    return Graph.of_quads(_table_quads(spark, sf_dir, "nation")).scan(p=Iri("urn:nation#n_name")).select("s", "o")


def scan_same_variable(spark, sf_dir):
    """One variable as subject and object of a pattern: customers that are joined to themselves."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    link = customers.select(F.concat(F.lit("Iurn:customer:"), "c_custkey").alias("s"), F.lit("Iurn:like").alias("p"), F.concat(F.lit("Iurn:customer:"), (F.col("c_custkey") - F.col("c_custkey") % 5).cast("string")).alias("o"), F.lit(None).cast("string").alias("g"))
    return _plain(Graph.of_quads(link), "SELECT ?x ?p { ?x ?p ?x }")


def _tagged(spark, sf_dir) -> Graph:
    """Names of nations as English, British or French strings."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    tag = F.element_at(F.array(F.lit("en"), F.lit("en-gb"), F.lit("fr")), F.col("n_nationkey") % 3 + 1)
    return Graph.of_quads(nations.select(F.concat(F.lit("Iurn:nation:"), "n_nationkey").alias("s"), F.lit("Iurn:name").alias("p"), F.concat(F.lit("@"), tag, F.lit("|"), "n_name").alias("o"), F.lit(None).cast("string").alias("g")))


def filter_lang(spark, sf_dir):
    return _plain(_tagged(spark, sf_dir), 'SELECT ?x ?n { ?x <urn:name> ?n FILTER(LANG(?n) = "en") }')


def filter_langmatches(spark, sf_dir):
    return _plain(_tagged(spark, sf_dir), 'SELECT ?x (STR(?n) AS ?name) { ?x <urn:name> ?n FILTER(LANGMATCHES(LANG(?n), "EN")) }')


def built_graph(spark, sf_dir):
    """A graph that is written down in Python, with a list and a blank node."""
    b = Builder("urn:e:")
    b.a("x", "T").add("x", "items", b.list(1, 2, 3)).add("x", "at", b.blank(("lat", 1.5), ("lon", 2.5)))
    return _plain(b.build(spark), "SELECT ?i ?lat { ?x a <urn:e:T> ; <urn:e:items>/rdf:rest*/rdf:first ?i ; <urn:e:at>/<urn:e:lat> ?lat }")


def ntriples_escapes(spark, sf_dir):
    """Texts with quotes, backslashes, line ends and tabs, written and read."""
    path = fresh_path(spark, "escapes")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    odd = F.concat("p_name", F.lit('"\\ \n\t\ré '), "p_type")
    ntriples.write(parts.select(F.concat(F.lit("Iurn:part:"), "p_partkey").alias("s"), F.lit("Iurn:odd").alias("p"), F.concat(F.lit(_NAME), odd).alias("o"), F.lit(None).cast("string").alias("g")), path)
    return _plain(Graph.of_quads(ntriples.read(spark, path)), "SELECT ?x ?o { ?x <urn:odd> ?o }")


def trig_round_trip(spark, sf_dir):
    """Suppliers in a graph for each nation, written and read as TriG."""
    path = fresh_path(spark, "trig")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    quads = rows.select(F.concat(F.lit("Iurn:supplier:"), "s_suppkey").alias("s"), F.lit("Iurn:name").alias("p"), F.concat(F.lit(_NAME), "s_name").alias("o"), F.concat(F.lit("Iurn:nation:"), "s_nationkey").alias("g"))
    turtle.write(quads, path, pretty=False)
    return _plain(Graph.of_quads(turtle.read(spark, path)), "SELECT ?x ?n ?g { GRAPH ?g { ?x <urn:name> ?n } }")


def results_document(spark, sf_dir):
    """A whole JSON document, read back."""
    text = results.to_json(Graph.of_tables(spark, sf_dir).query(PREFIXES + "SELECT ?x ?n { ?x r:r_name ?n }"))
    return results.from_json(spark, text).select(F.col("x.value").alias("x"), F.col("n.value").alias("n"))


def n3_documents(spark, sf_dir):
    """What each region says: a list of statements about its nations, written as N3."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    list_ = F.concat(F.lit("Iurn:list:"), "n_regionkey")
    said = nations.select(F.concat(F.lit("Iurn:nation:"), "n_nationkey").alias("s"), F.lit("Iurn:name").alias("p"), F.concat(F.lit(_NAME), "n_name").alias("o"), list_.alias("g"))
    says = nations.select(F.concat(F.lit("Iurn:region:"), "n_regionkey").alias("s"), F.lit("Iurn:says").alias("p"), list_.alias("o"), F.lit(None).cast("string").alias("g")).distinct()
    return n3.documents(said.union(says))


def tabulated(spark, sf_dir):
    """The lines of a table of text."""
    text = Graph.of_tables(spark, sf_dir).tabulate(PREFIXES + "SELECT ?n ?x { ?x r:r_name ?n } ORDER BY ?n", order=("x",))
    return spark.createDataFrame([(line,) for line in text.split("\n")], "line string")


def followed(spark, sf_dir):
    """Solutions as the changes that a callback gets."""
    rows: list[tuple] = []
    Graph.of_tables(spark, sf_dir).follow(PREFIXES + "SELECT ?x ?n { ?x n:n_name ?n }", lambda w, b: rows.append((w, b["x"].value, b["n"].value)))
    return spark.createDataFrame(rows, "w int, x string, n string")


def endpoint_query(spark, sf_dir):
    """A remembered query of the endpoint, asked again after an update."""
    point = Endpoint(_table_quads(spark, sf_dir, "region"))
    text = PREFIXES + "SELECT ?x ?n { ?x r:r_name ?n }"
    point.query(text)
    point.update('INSERT DATA { <urn:region:9> <urn:region#r_name> "NOWHERE" } ; DELETE DATA { <urn:region:0> <urn:region#r_name> "AFRICA" }')
    return results.from_json(spark, point.query(text)).select(F.col("x.value").alias("x"), F.col("n.value").alias("n"))


def ntriples_round_trip(spark, sf_dir):
    path = fresh_path(spark, "ntriples")
    ntriples.write(_table_quads(spark, sf_dir, "customer"), path)
    return _plain(Graph.of_quads(ntriples.read(spark, path)), "SELECT ?n ?b { ?x c:c_name ?n ; c:c_acctbal ?b FILTER(?b > 5000) }")


def turtle_round_trip(spark, sf_dir):
    path = fresh_path(spark, "turtle")
    turtle.write(_table_quads(spark, sf_dir, "supplier"), path, {"s": "urn:supplier#"})
    return _plain(Graph.of_quads(turtle.read(spark, path)), "SELECT ?n ?b { ?x s:s_name ?n ; s:s_acctbal ?b FILTER(?b > 0) }")


def results_json(spark, sf_dir):
    return results.json_bindings(Graph.of_tables(spark, sf_dir).query(PREFIXES + "SELECT ?x ?n { ?x n:n_name ?n }"))


def results_xml(spark, sf_dir):
    return results.xml_results(Graph.of_tables(spark, sf_dir).query(PREFIXES + "SELECT ?x ?n { ?x n:n_name ?n }"))


def update_data(spark, sf_dir):
    quads = _table_quads(spark, sf_dir, "region")
    quads = results.apply_update(quads, 'INSERT DATA { <urn:region:9> <urn:region#r_name> "NOWHERE" } ; DELETE DATA { <urn:region:0> <urn:region#r_name> "AFRICA" }')
    return _plain(Graph.of_quads(quads), "SELECT ?x ?n { ?x r:r_name ?n }")


def as_of(spark, sf_dir):
    """The newest event of each user up to a time."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return as_of_rows(events, "user_id", "ts", "event_id", "2024-01-15 00:00:00").select("user_id", "event_id", "event_type")


def versioned_as_of(spark, sf_dir):
    """The same from a versioned stream, whose members are users and whose versions are events."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id", "ts").agg(F.max_by("event_type", "event_id").alias("event_type"))
    stream = VersionedStream(spark)
    stream.append(events.select(F.concat(F.lit("Iurn:user:"), F.col("user_id").cast("string")).alias("base"), "ts", F.concat(F.lit("Iurn:user:"), F.col("user_id").cast("string")).alias("s"), F.lit("Iurn:did").alias("p"), F.concat(F.lit("Lhttp://www.w3.org/2001/XMLSchema#string|"), "event_type").alias("o")))
    return _plain(Graph.of_quads(stream.as_of("2024-01-15 00:00:00")), "SELECT ?u ?t { ?u <urn:did> ?t }")


def _event_stream(spark, sf_dir) -> VersionedStream:
    """Users as objects, events as their versions; of events at one time the last one is appended last."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    user = F.concat(F.lit("Iurn:user:"), F.col("user_id").cast("string"))
    rank = F.row_number().over(Window.partitionBy("user_id", "ts").orderBy("event_id"))
    rows = events.withColumn("rank", rank).select("rank", user.alias("base"), "ts", user.alias("s"), F.lit("Iurn:did").alias("p"), F.concat(F.lit(_NAME), "event_type").alias("o"))
    stream = VersionedStream(spark)
    for k in range(1, (rows.agg(F.max("rank")).first()[0] or 0) + 1):
        stream.append(rows.where(F.col("rank") == k).drop("rank"))
    return stream


def versioned_ties(spark, sf_dir):
    """As of a time, where an object has several versions of one time: the last that arrived counts."""
    return _plain(Graph.of_quads(_event_stream(spark, sf_dir).as_of("2024-01-15 00:00:00")), "SELECT ?u ?t { ?u <urn:did> ?t }")


def versioned_one(spark, sf_dir):
    """One object as it was at a time."""
    rows = _event_stream(spark, sf_dir).version("Iurn:user:7", "2024-01-20 00:00:00")
    return rows.select(F.substring_index("s", ":", -1).cast("bigint").alias("u"), F.substring_index("o", "|", -1).alias("t"))


def versioned_as_rdf(spark, sf_dir):
    """A versioned stream written as RDF, read back and asked as of a time."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id", "ts").agg(F.max_by("event_type", "event_id").alias("event_type"))
    user = F.concat(F.lit("Iurn:user:"), F.col("user_id").cast("string"))
    stream = VersionedStream(spark)
    stream.append(events.select(user.alias("base"), "ts", user.alias("s"), F.lit("Iurn:did").alias("p"), F.concat(F.lit(_NAME), "event_type").alias("o")))
    path = fresh_path(spark, "stream")
    ntriples.write(stream.to_quads("urn:stream"), path)
    back = VersionedStream.of_quads(spark, ntriples.read(spark, path), "urn:stream")
    return _plain(Graph.of_quads(back.as_of("2024-01-15 00:00:00")), "SELECT ?u ?t { ?u <urn:did> ?t }")


def snapshot_diff(spark, sf_dir):
    """What came and what went between two states of the orders."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus")
    came, went = diff(orders.where("o_orderkey % 3 <> 0"), orders.where("o_orderkey % 5 <> 0"))
    return came.withColumn("w", F.lit(1)).union(went.withColumn("w", F.lit(-1)))


def snapshot_store(spark, sf_dir):
    """Insertions and deletions of the second of two stored snapshots of the nations."""
    quads = _table_quads(spark, sf_dir, "nation")
    store = SnapshotStore(spark, "2024-01-01 00:00:00")
    store.add(quads.where("s NOT LIKE '%:1_'"))
    store.add(quads.where("s NOT LIKE '%:2_'"))
    came, went = list(store.diffs())[1]
    plain = lambda df, w: df.where("p = 'Iurn:nation#n_name'").select(F.substring_index("s", ":", -1).cast("int").alias("n"), F.lit(w).alias("w"))
    return plain(came, 1).union(plain(went, -1))


def _live(spark, sf_dir, query: str, deferred: bool, checked: bool = False) -> DataFrame:
    """Customers arrive in two batches, of which the second also takes some away."""
    q = LiveQuery(spark, PREFIXES + query, deferred=deferred, checked=checked)
    quads = _table_quads(spark, sf_dir, "customer")
    number = F.substring_index("s", ":", -1).cast("bigint") % 10
    q.push(_table_quads(spark, sf_dir, "nation").withColumn("w", F.lit(1)))
    q.push(quads.where(number < 6).withColumn("w", F.lit(1)))
    q.push(quads.where(number >= 4).withColumn("w", F.when(number < 6, -1).otherwise(1)))
    return q.results()


_LIVE = "SELECT ?name { ?c c:c_nationkey ?x ; c:c_mktsegment ?m . ?x n:n_name ?name }"
_LIVE_SQL = "SELECT 'Lhttp://www.w3.org/2001/XMLSchema#string|' || n_name AS n, count(*) AS times FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 10 NOT IN (4, 5) GROUP BY 1"


def live_join(spark, sf_dir):
    return _live_counts(_live(spark, sf_dir, _LIVE, False))


def live_join_deferred(spark, sf_dir):
    return _live_counts(_live(spark, sf_dir, _LIVE, True))


def live_checked(spark, sf_dir):
    """The same, with a check after each batch that no result is there fewer than 0 times."""
    return _live_counts(_live(spark, sf_dir, _LIVE, False, True))


def live_closure(spark, sf_dir):
    """A repeated path over quads that come and go."""
    q = LiveQuery(spark, PREFIXES + "SELECT ?a ?b { ?a (c:c_nationkey|n:n_regionkey)+ ?b }")
    nations = _table_quads(spark, sf_dir, "nation").where("p = 'Iurn:nation#n_regionkey'").withColumn("w", F.lit(1))
    q.push(nations)
    q.push(_table_quads(spark, sf_dir, "customer").where("p = 'Iurn:customer#c_nationkey' AND s LIKE '%7'").withColumn("w", F.lit(1)))
    q.push(nations.where("s LIKE '%:1_'").withColumn("w", F.lit(-1)))
    return q.results().select(F.substring("a", 2, 100).alias("a"), F.substring("b", 2, 100).alias("b"), F.col("n").alias("times"))


def _live_counts(counts: DataFrame) -> DataFrame:
    return counts.select(F.col("name").alias("n"), F.col("n").alias("times"))


def live_not_exists(spark, sf_dir):
    """A query that isn't linear: worked out again, batch by batch."""
    counts = _live(spark, sf_dir, "SELECT ?name { ?x n:n_name ?name FILTER NOT EXISTS { ?c c:c_nationkey ?x ; c:c_acctbal ?b FILTER(?b > 9500) } }", False)
    return _live_counts(counts)


_NAME = "Lhttp://www.w3.org/2001/XMLSchema#string|"
OTHER: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "quads_lookup": (quads_lookup, "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "ntriples_round_trip": (ntriples_round_trip, "SELECT c_name AS n, c_acctbal::VARCHAR AS b FROM customer WHERE c_acctbal > 5000"),
    "turtle_round_trip": (turtle_round_trip, "SELECT s_name AS n, s_acctbal::VARCHAR AS b FROM supplier WHERE s_acctbal > 0"),
    "results_json": (results_json, """SELECT '{"x":{"type":"uri","value":"urn:nation:' || n_nationkey || '"},"n":{"type":"literal","value":"' || n_name || '"}}' AS value FROM nation"""),
    "results_xml": (results_xml, """SELECT '<result><binding name="x"><uri>urn:nation:' || n_nationkey || '</uri></binding><binding name="n"><literal>' || n_name || '</literal></binding></result>' AS value FROM nation"""),
    "update_data": (update_data, "SELECT 'urn:region:' || r_regionkey AS x, r_name AS n FROM region WHERE NOT (r_regionkey = 0 AND r_name = 'AFRICA') UNION ALL SELECT 'urn:region:9', 'NOWHERE'"),
    "as_of": (as_of, "SELECT user_id, event_id, event_type FROM events WHERE ts <= TIMESTAMP '2024-01-15' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"),
    "versioned_as_of": (versioned_as_of, "SELECT 'urn:user:' || user_id AS u, event_type AS t FROM events WHERE ts <= TIMESTAMP '2024-01-15' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"),
    "quads_store": (quads_store, "SELECT c_name AS name, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "scan_wildcard": (scan_wildcard, f"SELECT 'Iurn:nation:' || n_nationkey AS s, '{_NAME}' || n_name AS o FROM nation"),
    "scan_same_variable": (scan_same_variable, "SELECT 'urn:customer:' || c_custkey AS x, 'urn:like' AS p FROM customer WHERE c_custkey % 5 = 0"),
    "filter_lang": (filter_lang, "SELECT 'urn:nation:' || n_nationkey AS x, n_name AS n FROM nation WHERE n_nationkey % 3 = 0"),
    "filter_langmatches": (filter_langmatches, "SELECT 'urn:nation:' || n_nationkey AS x, n_name AS name FROM nation WHERE n_nationkey % 3 < 2"),
    "built_graph": (built_graph, "SELECT i::VARCHAR AS i, '1.5' AS lat FROM range(1, 4) t(i)"),
    "ntriples_escapes": (ntriples_escapes, "SELECT 'urn:part:' || p_partkey AS x, p_name || '\"\\ ' || chr(10) || chr(9) || chr(13) || 'é ' || p_type AS o FROM part"),
    "trig_round_trip": (trig_round_trip, "SELECT 'urn:supplier:' || s_suppkey AS x, s_name AS n, 'urn:nation:' || s_nationkey AS g FROM supplier"),
    "n3_documents": (
        n3_documents,
        """SELECT '<urn:region:' || n_regionkey || '> <urn:says> { ' || string_agg('<urn:nation:' || n_nationkey || '> <urn:name> "' || n_name || '" .', ' ' ORDER BY '<urn:nation:' || n_nationkey || '> <urn:name> "' || n_name || '" .') || ' } .' AS value FROM nation GROUP BY n_regionkey""",
    ),
    "tabulated": (
        tabulated,
        """SELECT '# | x' || repeat(' ', 13) || ' | ' || rpad('n', (max(length(r_name)) + 2)::INT, ' ') AS line FROM region
        UNION ALL SELECT row_number() OVER (ORDER BY r_name) || ' | <urn:region:' || r_regionkey || '> | ' || rpad('"' || r_name || '"', ((SELECT max(length(r_name)) FROM region) + 2)::INT, ' ') FROM region""",
    ),
    "followed": (followed, "SELECT 1 AS w, 'urn:nation:' || n_nationkey AS x, n_name AS n FROM nation"),
    "results_document": (results_document, "SELECT 'urn:region:' || r_regionkey AS x, r_name AS n FROM region"),
    "endpoint_query": (endpoint_query, "SELECT 'urn:region:' || r_regionkey AS x, r_name AS n FROM region WHERE NOT (r_regionkey = 0 AND r_name = 'AFRICA') UNION ALL SELECT 'urn:region:9', 'NOWHERE'"),
    "versioned_ties": (versioned_ties, "SELECT 'urn:user:' || user_id AS u, event_type AS t FROM events WHERE ts <= TIMESTAMP '2024-01-15' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"),
    "versioned_one": (versioned_one, "SELECT user_id AS u, event_type AS t FROM events WHERE user_id = 7 AND ts <= TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id DESC LIMIT 1"),
    "versioned_as_rdf": (versioned_as_rdf, "SELECT 'urn:user:' || user_id AS u, event_type AS t FROM events WHERE ts <= TIMESTAMP '2024-01-15' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"),
    "live_checked": (live_checked, _LIVE_SQL),
    "live_closure": (
        live_closure,
        "WITH n AS (SELECT 'urn:nation:' || n_nationkey AS a, 'urn:region:' || n_regionkey AS b FROM nation WHERE n_nationkey NOT BETWEEN 10 AND 19), c AS (SELECT 'urn:customer:' || c_custkey AS a, 'urn:nation:' || c_nationkey AS b FROM customer WHERE c_custkey % 10 = 7) SELECT a, b, 1::BIGINT AS times FROM n UNION ALL SELECT a, b, 1 FROM c UNION ALL SELECT c.a, n.b, 1 FROM c JOIN n ON c.b = n.a",
    ),
    "snapshot_diff": (snapshot_diff, "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 5 <> 0 THEN 1 ELSE -1 END AS w FROM orders WHERE (o_orderkey % 3 <> 0) <> (o_orderkey % 5 <> 0)"),
    "snapshot_store": (snapshot_store, "SELECT n_nationkey AS n, CASE WHEN n_nationkey BETWEEN 10 AND 19 THEN 1 ELSE -1 END AS w FROM nation WHERE n_nationkey >= 10"),
    "live_join": (live_join, _LIVE_SQL),
    "live_join_deferred": (live_join_deferred, _LIVE_SQL),
    "live_not_exists": (live_not_exists, f"SELECT '{_NAME}' || n_name AS n, 1::BIGINT AS times FROM nation WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9500 AND c_custkey % 10 NOT IN (4, 5))"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def of(text: str):
        return lambda spark, sf_dir: Graph.of_tables(spark, sf_dir).values(PREFIXES + text)

    return {n: of(q) for n, (q, _) in SPARQL.items()} | {n: f for n, (f, _) in OTHER.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql) in (SPARQL | OTHER).items()}
