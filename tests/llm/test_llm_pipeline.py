"""The pipeline, stage by stage, against plain versions of the stages."""

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline


@pytest.fixture(scope="module")
def tables(spark, corpus_rows, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in corpus_rows]
    documents = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long"
    )
    documents.write.parquet(f"{folder}/documents.parquet")
    items = [(0, " ".join(corpus_rows[3][1].split()[10:35])), (1, "is in no document at all " * 4)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, int(i % 4 > 0), int(i % 9 == 0)) for i in range(0, len(rows), 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, items


def test_pipeline_equals_plain_stages(spark, tables):
    folder, rows, items = tables
    expected = {r[0]: r for r in rows}
    verdicts = brute.quality([(i, t, s) for i, t, _, s, _ in rows])
    expected = {i: r for i, r in expected.items() if not verdicts[i][1] and not verdicts[i][2]}
    texts = brute.without_lines([(i, r[1], r[3]) for i, r in expected.items()])
    groups = brute.components(list(texts.items()), 5, 80)
    texts = {i: t for i, t in texts.items() if groups[i][1] == i}
    texts = {i: t for i, t in texts.items() if not any(brute.holds(t, item) for _, item in items)}
    result = corpus_pipeline.run(spark, folder)
    found = result.collect()
    assert {r["doc_id"]: r["text"] for r in found} == texts
    assert len(found) == len(texts) and 5 < len(texts) < len(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    tokens = sum(r["n_tokens"] for r in found)
    mixed = sum(r["rate"] * r["n_tokens"] for r in found)
    assert mixed == pytest.approx(tokens, rel=0.05)


def test_stages_keep_the_columns(spark, tables):
    folder, _, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        assert stage(spark, docs.limit(0), folder).count() == 0, name


def test_domains(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r["domain"] for r in corpus_pipeline.domains(labels).collect()}
    assert found == {1: "good", 2: "plain", 3: "toxic", 4: None}
    assert corpus_pipeline.domains(labels.limit(0)).select(F.count("*")).first()[0] == 0
