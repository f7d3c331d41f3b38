import ast
import pathlib

import corpus_pipeline
from quadrille.llm import near_dedup, packing, quality, suffix_dedup

from .tables import documents, empty, hard, prose

FOLDER = "/root/testdata/sf0.01"
ROOT = pathlib.Path(corpus_pipeline.__file__).parent


def test_stages_in_order(spark):
    """run() is its stages, one after the other; each takes effect and keeps the columns."""
    assert [f for _, f in corpus_pipeline.STAGES] == [quality.accept, near_dedup.keep_one, suffix_dedup.stage, packing.stage]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for _, f in corpus_pipeline.STAGES[:-1]:
        docs = f(spark, docs, FOLDER).cache()
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3]
    assert near_dedup.near_groups(docs).count() <= 3  # near copies are gone
    packed = packing.stage(spark, docs, FOLDER)
    run = corpus_pipeline.run(spark, FOLDER)
    key = lambda df: sorted((r.shard, r.bin, r.doc_ids, r.pieces, r.tokens) for r in df.collect())
    assert key(run) == key(packed)
    assert {d for r in run.select("doc_ids").collect() for d in r.doc_ids} <= {r.doc_id for r in docs.collect()}


def test_run_on_hard_cases(spark, tmp_path):
    """Nulls, empty and very long texts, copies, clashing names, and a table without rows."""
    hard(spark).write.parquet(str(tmp_path / "hard/documents.parquet"))
    empty(spark).write.parquet(str(tmp_path / "empty/documents.parquet"))
    for f in ("hard", "empty"):  # no labels: nothing but null texts is rejected
        spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / f / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
    ids = {d for r in corpus_pipeline.run(spark, str(tmp_path / "hard")).collect() for d in r.doc_ids}
    assert {None, 1, 7, 8, 10, 11, 12, 13, 14, 15, 16} <= ids and not ids & {2, 3, 4, 5}  # 2 and 3 are copies, 4 is null, 5 empty


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "quadrille").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "llm" not in p.read_text(), p
    tree = ast.parse((ROOT / "corpus_pipeline.py").read_text())
    assert not any(isinstance(n, ast.Try) for n in ast.walk(tree))


def test_entry_has_every_operator():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    for n in range(1, 11):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names and "op8_url_filter" in __spark_entry__.oracle_sql()


def test_clean_texts_pass(spark):
    """Distinct prose loses nothing in the deduplicating stages."""
    docs = documents(spark, [(d, prose(d, 150)) for d in range(40)])
    one = near_dedup.keep_one(spark, docs, "")
    two = suffix_dedup.stage(spark, one, "")
    assert sorted(map(tuple, two.collect())) == sorted(map(tuple, docs.collect()))
