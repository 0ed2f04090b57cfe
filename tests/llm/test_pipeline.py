"""The pipeline's stages, each on its own input, and the registered queries."""

import corpus_pipeline as pipeline
from compare import connect, differences

from aftershock.llm.queries import ORACLES, QUERIES
from test_duplicates import expected_lines, groups  # noqa: I001


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_stages_keep_the_columns(spark, sf):
    docs = documents(spark, sf)
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert out.schema == docs.schema, name


def test_quality_stage_drops_bad_documents_and_keeps_good_ones(spark):
    sf = "/root/testdata/sf0.01"
    docs = documents(spark, sf)
    kept = {r["doc_id"] for r in pipeline.good_documents(spark, docs, sf).select("doc_id").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    right = sum((r["doc_id"] in kept) == (r["quality"] == 1) for r in labels)
    assert right / len(labels) > 0.97


def test_line_stage(spark, sf):
    docs = documents(spark, sf)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = pipeline.new_lines(spark, docs, sf).collect()
    expected = [(i, t) for i, t, n in expected_lines(rows) if n == 0 or t.strip(" ")]
    assert sorted((r["doc_id"], r["text"]) for r in out) == sorted(expected)
    before = dict(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in out if r["text"] != before[r["doc_id"]])


def test_near_duplicate_stage(spark, sf):
    docs = documents(spark, sf)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = pipeline.one_of_each_group(spark, docs, sf)
    expected = {i for i, n, least in groups(rows, 5) if i == least}
    assert sorted(r["doc_id"] for r in out.select("doc_id").collect()) == sorted(expected)


def test_pipeline_runs(spark, sf):
    rows = pipeline.run(spark, sf).collect()
    assert rows and all(r["length"] > 0 for r in rows)


def test_queries_match_their_sql(spark, sf):
    con = connect(sf)
    for name, sql in ORACLES.items():
        found, _ = differences(spark, con, QUERIES[name], sql, sf)
        assert not found, name


def test_one_row_of_each_group_stays(spark):
    """Repeated rows, repeated ids and rows without ids."""
    words = [f"w{i}" for i in range(100)]
    text, near, other, lone = " ".join(words), " ".join(words[1:]), "some other text of seven words", "one two three four five"
    rows = [
        (None, near), (None, text), (7, near), (7, text), (5, text), (5, text), (7, "its own text without any copy"),
        (None, other), (None, other), (None, lone), (9, ""), (None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = pipeline.one_of_each_group(spark, docs, "")
    kept = [(5, text), (7, "its own text without any copy"), (None, other), (None, lone), (9, ""), (None, None)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(kept, key=str)
