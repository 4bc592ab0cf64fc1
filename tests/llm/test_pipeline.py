"""The pipeline's stages one after another, and the registered SQL."""

import pytest

import corpus_pipeline
from flowspark.llm.base import written
from flowspark.llm.queries import ORACLES, QUERIES
from tools.compare import connect, plain, rows_of

FOLDER = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, FOLDER), f"test-{name}")
        sizes.append(docs.count())
        if name != "bpe":
            assert docs.columns == columns
            assert docs.select("doc_id").exceptAll(before.select("doc_id")).isEmpty()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "bpe"]
    assert sizes[0] > sizes[1] == sizes[2] >= sizes[3] > sizes[4] == sizes[5]
    assert docs.where("n_tokens != size(ids)").isEmpty()


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_stages_bear_odd_rows(spark, documents_of, odd_rows, rows):
    """Nulls, empty and long texts, repeats, clashing columns and an empty table pass through every stage."""
    docs = documents_of(odd_rows if rows == "odd" else []).drop("kept")
    docs = docs.selectExpr("doc_id", "text", "'en' AS lang", "uid AS source", "n AS n_chars", "key", "label", "id", "rank")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, FOLDER), f"odd-{name}")
        if name != "bpe":
            assert docs.columns == before.columns
    if rows == "none":
        assert docs.isEmpty()
    else:
        # 54 repeats the line of 53; the rows with one id stay together; nothing else is taken for a copy.
        assert {r.doc_id for r in docs.collect()} >= {None, 50, 51, 52, 53, 55, 56, 57, 58}


def test_near_duplicates_from_80_percent(spark):
    words = [f"w{k}" for k in range(104)]
    other = words[:52] + ["new"] * 2 + words[54:]  # 94 of 106 shingles are shared
    third = [w if k not in (20, 80) else "else" for k, w in enumerate(words)]  # 90 of 110: 0.82
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(third)), (3, " ".join(other)), (4, "something else")], "doc_id long, text string")
    kept = corpus_pipeline.keep_one_of_near_duplicates(spark, docs, FOLDER)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    result = QUERIES[name](spark, FOLDER)
    cursor = connect(FOLDER).execute(ORACLES[name])
    expected = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert rows_of(result.columns, [tuple(map(plain, r)) for r in result.collect()]) == expected
