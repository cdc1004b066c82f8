import importlib.util
import os

from autoprep.llm.queries import ORACLES, QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
spec = importlib.util.spec_from_file_location("corpus_pipeline", f"{ROOT}/corpus_pipeline.py")
pipeline = importlib.util.module_from_spec(spec)
spec.loader.exec_module(pipeline)


def test_stages_act_and_keep_columns(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = docs.columns
    counts = [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        before, docs = docs, pipeline.saved(stage(spark, docs, data))
        assert docs.columns == names, name
        counts.append(docs.count())
        assert docs.join(before, "doc_id", "left_anti").count() == 0
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    last = pipeline.STAGES[-1][1](spark, docs, data)
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in docs.collect()}


def test_stages_take_an_empty_table_and_nulls(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    odd = spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0)], docs.schema)
    for rows in (docs.limit(0), odd):
        for _, stage in pipeline.STAGES:
            assert stage(spark, rows, data).count() <= 3


def test_texts_under_one_id_have_their_own_fate(spark, data):
    """Two texts of one id, equal rows, near copies, very long texts and extra columns with clashing names."""
    stages = dict(pipeline.STAGES)
    words = lambda k, n: " ".join(f"w{k}x{i % 5000}" for i in range(n))
    leak = spark.read.parquet(f"{data}/benchmark.parquet").where("length(text) > 100").first().text
    rows = [(5, words(1, 300)), (5, words(2, 300)), (5, words(2, 300)), (3, words(1, 300).upper()), (7, words(3, 400_000)), (9, leak), (9, words(4, 200)), (None, words(6, 50))]
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1]), 1, "z") for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, component int, version string")
    left = stages["SimHash near-dedup"](spark, docs, data)
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in left.collect()) == sorted({rows[i] for i in (1, 3, 4, 5, 6)})
    left = stages["benchmark decontamination"](spark, docs, data)
    assert left.columns == docs.columns and sorted(r.text for r in left.collect()) == sorted(r[1] for r in rows if r[1] != leak)
    for name in ("quality classifier", "substring dedup"):
        left = stages[name](spark, docs, data)
        assert left.columns == docs.columns and left.count() > 0


def test_operators_and_the_pipeline_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES) and 4 <= len(pipeline.STAGES) <= 5
