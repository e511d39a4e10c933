"""Operators and stages carry columns named like the ones they use inside."""

import pytest

import plain_text as plain
from warpwise.llm import decontamination, near_copies, personal_data, quality_trees, simhash, stages, url_filter

INNER = ["__id", "__stay", "__tie", "__matches", "__blocked", "__html", "__rule", "__action", "__node", "__score", "__lines", "__gone"]
INNER += ["__of", "__mark", "__left", "__removed", "__text", "__digest", "node", "bands", "best", "key", "u", "v", "component"]


def with_inner(frame):
    return frame.selectExpr("*", *[f"'{i}' as `{n}`" for i, n in enumerate(INNER)])


def check(out):
    rows = out.select(*INNER).collect()
    assert rows and all([r[n] for n in INNER] == [str(i) for i in range(len(INNER))] for r in rows)


@pytest.fixture(scope="module")
def docs(spark):
    return with_inner(plain.table(spark, extra=False))


def test_near_duplicates(docs):
    check(simhash.one_of_each(docs))
    check(near_copies.one_of_each(docs))


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, plain.FILLER)], "item_id long, text string")
    out = decontamination.clean(docs, items)
    check(out)
    assert out.columns == docs.columns and not {14, 15} & {r["doc_id"] for r in out.collect()}


def test_url_filter(spark):
    pages = with_inner(spark.createDataFrame([(1, "http://a.net/es/x", None), (2, "http://b.org/", "<link rel=canonical href=http://a.net/es/x>")], "page_id long, url string, html string"))
    rules = spark.createDataFrame([("net", "/es/", "block")], "host string, path string, action string")
    out = url_filter.judged(pages, rules)
    check(out)
    assert {r["page_id"]: r["verdict"] for r in out.collect()} == {1: "block", 2: "block"}


def test_scores_and_spans(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    check(quality_trees.scored_texts(docs, quality_trees.fitted(docs, labels)))
    check(personal_data.find(docs))


def test_stages(spark, docs, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, plain.FILLER)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in stages.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        check(out)
        assert out.columns == docs.columns
