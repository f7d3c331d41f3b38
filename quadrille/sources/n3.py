"""N3 documents, written only: Turtle whose subjects and objects may be lists of statements in braces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.sources.ntriples import term_text
from quadrille.storage import written

#: How deep lists may lie in lists.
DEPTH = 16


def documents(quads: DataFrame) -> DataFrame:
    """One row (value) a subject outside all lists. quads: s, p, o, g of term keys; a subject or object that is the name of a graph
    stands for the list of that graph's statements. A graph that nothing names isn't written; one that holds itself is an error."""
    rows = quads.select("s", "p", "o", "g", term_text(F.col("s")).alias("st"), term_text(F.col("p")).alias("pt"), term_text(F.col("o")).alias("ot"))
    lists = written(rows.where("g IS NOT NULL"), "n3-lists")
    rows = rows.where("g IS NULL")
    names = written(lists.select(F.col("g").alias("name")).distinct(), "n3-names")
    done = names.limit(0).withColumn("body", F.lit(""))
    for _ in range(DEPTH):  # from the innermost lists outwards
        todo = names.join(done.select("name"), "name", "left_anti")
        if not todo.head(1):
            break
        own = lists.join(todo.withColumnRenamed("name", "g"), "g")
        deeper = lambda c: own.join(todo.withColumnRenamed("name", c), c, "left_semi").select("g")
        ready = _filled(own.join(deeper("s").union(deeper("o")).distinct(), "g", "left_anti"), done)
        bodies = _joined(ready, ["g"]).groupBy(F.col("g").alias("name")).agg(F.concat(F.lit("{ "), F.array_join(F.array_sort(F.collect_list("value")), " "), F.lit(" }")).alias("body"))
        done = written(done.union(bodies), "n3-done")
    if names.join(done.select("name"), "name", "left_anti").head(1):
        raise ValueError(f"a list of statements holds itself, or lies deeper than {DEPTH}")
    return _joined(_filled(rows, done), []).select("value")


def _filled(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Texts of subjects and objects that are lists replaced by these."""
    a, b = done.toDF("a_name", "a_body"), done.toDF("b_name", "b_body")
    both = rows.join(a, F.col("s") == F.col("a_name"), "left").join(b, F.col("o") == F.col("b_name"), "left")
    return both.select("s", "p", "o", "g", F.coalesce("a_body", "st").alias("st"), "pt", F.coalesce("b_body", "ot").alias("ot"))


def _joined(rows: DataFrame, by: list[str]) -> DataFrame:
    """One value a subject."""
    objects = rows.groupBy(*by, "st", "pt").agg(F.array_join(F.array_sort(F.collect_set("ot")), ", ").alias("ot"))
    parts = objects.groupBy(*by, "st").agg(F.array_join(F.array_sort(F.collect_list(F.concat("pt", F.lit(" "), "ot"))), " ; ").alias("po"))
    return parts.select(*by, F.concat("st", F.lit(" "), "po", F.lit(" .")).alias("value"))


def write(quads: DataFrame, path: str) -> None:
    documents(quads).write.text(path)
