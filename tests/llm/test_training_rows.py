"""Training takes one row of each labelled id, however many documents have it."""

import plain_text as plain
from warpwise.llm import quality_trees


def test_a_frequent_id_is_one_training_row(spark, monkeypatch):
    seen = []
    train = quality_trees.train
    monkeypatch.setattr(quality_trees, "train", lambda x, y: seen.append(len(y)) or train(x, y))
    rows = [(i, f"some words of text {i} " * 4) for i in range(40)] + [(7, f"copy {k} with other words") for k in range(300)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    used = labels.where(~quality_trees.held_out("doc_id")).count()
    assert labels.where("doc_id = 7").where(~quality_trees.held_out("doc_id")).count() == 1
    quality_trees.trained(plain.table(spark, rows), labels)
    assert seen == [used]
