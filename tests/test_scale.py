"""Plans and steps that must hold on larger tables."""

import pytest
from pyspark.sql import functions as F

from quadrille import storage
from quadrille.graph import Graph
from quadrille.operators import frames
from quadrille.queries import PREFIXES, SPARQL
from quadrille.sources import ntriples
from quadrille.sources.quads import write_store
from quadrille.streaming.versioned import diff

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("most", [1 << 40, 0], ids=["broadcast", "sorted"])
def test_joins_that_multiply_rows_are_dealt_out(spark, monkeypatch, most):
    ask = lambda: Graph.of_tables(spark, FOLDER).values(PREFIXES + SPARQL["path_inverse"][0])
    want = sorted(map(tuple, ask().collect()))
    monkeypatch.setattr(frames, "SPREAD_PRODUCT", 0)
    monkeypatch.setattr(frames, "SPREAD_BROADCAST", most)
    df = ask()
    per_task = df.rdd.glom().map(len).collect()
    assert sorted(map(tuple, df.collect())) == want
    assert max(per_task) < len(want) / 4


def test_parts_follow_the_bytes_of_rows(spark, monkeypatch):
    df = spark.range(1000).select("id", F.repeat(F.lit("x"), 1000).alias("text"))
    monkeypatch.setattr(storage, "PART_BYTES", 10_000)
    assert 100 <= storage.parts_for(df) <= 110
    assert storage.parts_for(df.where("id < 0")) == spark.sparkContext.defaultParallelism


def test_a_diff_is_dealt_out_by_its_size(spark, monkeypatch):
    """Nulls are equal, repeats count once, and parts grow with the rows."""
    df = spark.range(3000).select(F.when(F.col("id") > 0, F.col("id")).alias("id"), F.lit("x").alias("v"))
    before, after = df.where("id IS NULL OR id % 3 <> 0"), df.where("id IS NULL OR id % 5 <> 0").withColumn("v", F.when(F.col("id") == 1, "y").otherwise("x"))
    monkeypatch.setattr(storage, "PART_BYTES", 10_000)
    came, went = diff(before.union(before), after)
    assert {tuple(r) for r in came.collect()} == {(1, "y")} | {(i, "x") for i in range(1, 3000) if i % 3 == 0 and i % 5}
    assert {tuple(r) for r in went.collect()} == {(1, "x")} | {(i, "x") for i in range(1, 3000) if i % 5 == 0 and i % 3}
    assert came.count() + went.count() == len(set(came.collect())) + len(set(went.collect()))
    assert len(came.inputFiles()) >= 10


def test_a_line_is_matched_once(spark, tmp_path):
    """However many of its terms are used, and also where they are filtered."""
    (tmp_path / "a.nt").write_text('<urn:a> <urn:p> "x\x01\\ty"@en-GB <urn:g> .\n# no statement\n_:b <urn:p> _:c . # yes\n<urn:a> <urn:q> "5"^^<urn:d> .\n')
    df = ntriples.read(spark, str(tmp_path / "a.nt"), "here").where("p = 'Iurn:p' AND s LIKE '%a' AND o LIKE '@%'")
    assert [tuple(r) for r in df.collect()] == [("Iurn:a", "Iurn:p", "@en-gb|x\x01\ty", "Iurn:g")]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace") == 1 and "regexp_extract(" not in plan


def test_scans_are_narrowed_to_what_they_are_joined_with(spark):
    """Rows of other tables are other subjects, and their cells other objects: neither is read."""
    df = Graph.of_tables(spark, FOLDER).values(PREFIXES + SPARQL["path_negated_inverse"][0])
    assert {f.rsplit("/", 1)[1] for f in df.inputFiles()} == {"nation.parquet"}
    # both directions and a class as object stay
    df = Graph.of_tables(spark, FOLDER).values(PREFIXES + "SELECT ?x { ?n n:n_name 'KENYA' . ?x !(n:n_name|^n:n_nationkey|^n:n_regionkey|^rdf:type) ?n }")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "c_nationkey" in plan and "s_nationkey" in plan and "l_orderkey" not in plan
    df = Graph.of_tables(spark, FOLDER).values(PREFIXES + "SELECT ?x { VALUES ?t { <urn:region> } ?x ?p ?t }")
    assert df.count() == 5


def test_a_store_is_written_in_parts_by_its_bytes(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(storage, "PART_BYTES", 10_000)
    rows = spark.range(1000).select(F.concat(F.lit("Is"), F.col("id") % 500).alias("s"), F.lit("Ip").alias("p"), F.lit("Io").alias("o"), F.when(F.col("id") % 500 > 9, "Ig").alias("g"))
    write_store(rows, str(tmp_path / "store"))
    got = spark.read.parquet(str(tmp_path / "store"))
    assert got.count() == 500 and got.distinct().count() == 500
    assert len(got.inputFiles()) > 4
