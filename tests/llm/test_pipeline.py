import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from test_ngram_join import brute as near_duplicates  # noqa: E402

from roadpulse.llm import byte_bpe, language_id, toxicity  # noqa: E402
from roadpulse.llm.common import words  # noqa: E402
from roadpulse.llm.decontamination import WINDOW  # noqa: E402
from roadpulse.llm.queries import language_model, toxicity_model  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What every stage kept, and the result."""
    sf, folder = "/root/testdata/sf0.01", tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert made.columns == docs.columns
        made.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        kept.append(docs.collect())
    return sf, kept


def rows(table):
    return sorted((r["doc_id"], r["text"]) for r in table)


def test_language(spark, stages):
    sf, kept = stages
    model = language_model(spark, sf)
    held = type("Held", (), {"value": model})()
    made = language_id.identifier(held)([r["text"] for r in kept[0]])[0]
    assert rows(kept[1]) == rows(r for r, lang in zip(kept[0], made) if lang != language_id.UNDETERMINED)


def test_toxicity(spark, stages):
    sf, kept = stages
    made = toxicity.scorer(toxicity_model(spark, sf))([r["text"] for r in kept[1]])[0]
    assert rows(kept[2]) == rows(r for r, s in zip(kept[1], made) if s < toxicity.THRESHOLD)
    assert len(kept[2]) < len(kept[1])


def test_near_duplicates(stages):
    _, kept = stages
    classes = near_duplicates([(r["doc_id"], r["text"]) for r in kept[2]])
    assert sorted(r["doc_id"] for r in kept[3]) == sorted({c[1] for c in classes})
    assert len(kept[3]) < len(kept[2])


def test_decontamination(spark, stages):
    sf, kept = stages
    items = [words(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert all(len(w) >= WINDOW for w in items)
    bad = {tuple(w[i : i + WINDOW]) for w in items for i in range(len(w) - WINDOW + 1)}

    def clean(text):
        own = words(text)
        return not any(tuple(own[i : i + WINDOW]) in bad for i in range(len(own) - WINDOW + 1))

    assert rows(kept[4]) == rows(r for r in kept[3] if clean(r["text"]))
    assert len(kept[4]) < len(kept[3])


def test_tokens(stages):
    _, kept = stages
    vocabulary = byte_bpe.vocabulary()
    assert rows(kept[5]) == rows(kept[4])
    assert all(vocabulary.decode(bytes(r["ids"])).decode() == r["text"] and r["n_tokens"] == len(r["ids"]) // 4 for r in kept[5])


def test_run(spark, stages):
    sf, kept = stages
    assert rows(corpus_pipeline.run(spark, sf).collect()) == rows(kept[5])


def test_extra_columns_nulls_and_empty_tables(spark, stages):
    sf, _ = stages
    rows = [(1, None, None, None, None, "x"), (None, "", "en", "s", 0, None), (3, "The red car stood in the town.", "en", "s", 30, "y"), (3, "The red car stood in the town.", "en", "s", 30, "y")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() <= 4
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert corpus_pipeline.drop_near_duplicates(spark, docs, sf).columns == docs.columns


def test_the_last_stage_keeps_further_columns(spark, sf):
    docs = spark.createDataFrame([("text one", 1, "kept", 5), (None, 2, "too", 6)], "text string, doc_id long, extra string, n_tokens int")
    made = corpus_pipeline.tokenize(spark, docs, sf)
    rows = {r["doc_id"]: r for r in made.collect()}
    assert made.columns[:4] == docs.columns and rows[1]["extra"] == "kept" and rows[2]["n_tokens"] == 6
    assert rows[1]["n_tokens_"] == len(rows[1]["ids"]) // 4 > 0 and rows[2]["n_tokens_"] == 0


def test_freed_memory_is_returned_before_and_after_a_task(monkeypatch):
    """An idle worker must not hold what its last task has freed, so that is returned at the end too."""
    from roadpulse.llm import common

    seen = []
    monkeypatch.setattr(common, "give_back", lambda: seen.append("returned"))

    def work(batches):
        for batch in batches:
            seen.append(batch)
            yield batch

    assert list(common.lean(work)(iter([1, 2]))) == [1, 2]
    assert seen == ["returned", 1, 2, "returned"]


def test_a_worker_keeps_only_what_its_operator_uses():
    from roadpulse.llm import common

    def work(batches):
        yield from batches

    byte_bpe.vocabulary()
    language_id.pieces()
    list(common.lean(work, language_id.__name__)(iter([])))
    assert byte_bpe.vocabulary.cache_info().currsize == 0 and language_id.pieces.cache_info().currsize == 1
    list(common.lean(work)(iter([])))
    assert language_id.pieces.cache_info().currsize == 0


def test_stages_bound_the_batches(spark):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    docs = spark.range(5000, numPartitions=1).selectExpr("id AS doc_id", "repeat('words of a text ', 3) AS text")
    try:
        for given, most in (("10000", corpus_pipeline.BATCH_ROWS), ("0", corpus_pipeline.BATCH_ROWS), ("300", 300)):
            spark.conf.set(setting, given)
            dict(corpus_pipeline.STAGES)["tokenization"](spark, docs, "")
            sizes = docs.mapInPandas(lambda parts: (p[["doc_id"]].head(1).assign(doc_id=len(p)) for p in parts), "doc_id long").collect()
            assert max(r["doc_id"] for r in sizes) == most and sum(r["doc_id"] for r in sizes) == 5000
    finally:
        spark.conf.set(setting, before)
