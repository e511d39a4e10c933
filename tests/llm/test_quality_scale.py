"""The threshold of op1 has to mean the same at any size of the corpus."""

import random

import plain_text as plain
import pytest
from warpwise.llm import quality_rules


def corpus(n):
    """Every fourth document is junk; half of the clean ones are trusted."""
    rng = random.Random(n)
    rows = []
    for i in range(n):
        kind = "junk" if i % 4 == 0 else "clean"
        rows.append((i, " ".join(f"{kind}{int(3000 * rng.random() ** 3)}" for _ in range(60))))
    return rows, [i for i, _ in rows if i % 4 in (1, 2) and i % 3]


@pytest.mark.parametrize("n", [120, 1200])
def test_unseen_clean_documents_are_kept_at_any_size(spark, n):
    rows, trusted = corpus(n)
    asked = spark.createDataFrame([(i,) for i in trusted], "doc_id long")
    found = quality_rules.judged_by_trusted(plain.table(spark, rows), asked).collect()
    unseen = [r for r in found if r["doc_id"] % 4 and r["doc_id"] not in set(trusted)]
    junk = [r for r in found if r["doc_id"] % 4 == 0]
    assert sum(r["kept"] for r in unseen) >= 0.85 * len(unseen)
    assert sum(r["kept"] for r in junk) <= 0.05 * len(junk)


def test_own_ngrams_do_not_count(spark):
    rows = [(i, f"own{i} " * 12) for i in range(20)]
    asked = spark.createDataFrame([(i,) for i in range(10)], "doc_id long")
    assert {r["score"] for r in quality_rules.judged_by_trusted(plain.table(spark, rows), asked).collect()} == {0.0}
    nobody = spark.createDataFrame([], "doc_id long")
    found = quality_rules.judged_by_trusted(plain.table(spark), nobody).collect()
    assert {r["score"] for r in found} == {0.0} and all(r["kept"] == (not r["base_failed"]) for r in found)
    assert quality_rules.judged_by_trusted(plain.table(spark, []), nobody).count() == 0
