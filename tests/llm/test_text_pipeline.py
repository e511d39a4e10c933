"""The pipeline against the same stages as plain loops, and the registered queries."""

import os
import zlib

import numpy as np
import pytest

import plain_text as plain
from test_text_documents import deduplicated

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def plain_pipeline(documents, labels, items):
    """Rows (doc_id, text) after the first four stages."""
    from warpwise.llm import quality_trees

    quality = {}
    for d, q in labels:
        quality[d] = max(q, quality.get(d, 0))
    known = sorted(d for d in quality if zlib.crc32(str(d).encode()) % 5)
    values = {d: np.array(quality_trees.statistics(t), np.float32).astype(float) for d, t in documents}
    x = np.stack([values[d] for d in known])
    y = np.array([quality[d] for d in known], float)
    order = np.lexsort([*x.T, y, np.array(known)])
    forest = quality_trees.train(x[order], y[order])
    scores = dict(zip(values, forest.scores(np.stack(list(values.values())))))
    rows = [(d, t) for d, t in documents if scores[d] >= quality_trees.THRESHOLD]
    rows = [(d, t) for d, t, _, gone in deduplicated(rows) if gone == 0 or plain.words(t)]
    runs = {d: plain.word_runs(t, 5) for d, t in rows}
    ids = sorted(runs)
    near = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if plain.similar(runs[a], runs[b])]
    first = plain.components(ids, near)
    rows = [(d, t) for d, t in rows if first[d] == d]
    passages = [s for s in (plain.shingles(t) for _, t in items) if s]
    return [(d, t) for d, t in rows if not any(5 * len(s & plain.shingles(t)) >= 4 * len(s) for s in passages)]


@needs_tables
def test_pipeline_equals_plain_loops(spark):
    import sentencepiece

    import corpus_pipeline
    from warpwise.llm.queries import tokenizer_path

    def rows(name, *columns):
        return [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/{name}.parquet").select(*columns).collect()]

    expected = plain_pipeline(rows("documents", "doc_id", "text"), rows("labels", "doc_id", "quality"), rows("benchmark", "item_id", "text"))
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF_DIR).collect()}
    assert 0 < len(expected) < 200 and set(found) == {d for d, _ in expected}
    for d, t in expected:
        assert found[d]["ids"] == library.encode(t) and found[d]["decoded"] == t and found[d]["n_tokens"] == len(found[d]["ids"])


def stage_folder(spark, tmp_path, labels, items):
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("rows", [plain.ROWS, []])
def test_stages_take_any_rows(spark, tmp_path, rows):
    import corpus_pipeline

    folder = stage_folder(spark, tmp_path, [], [(1, plain.FILLER)])
    docs = plain.table(spark, rows)
    names = docs.columns
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == names
            path = str(tmp_path / f"stage{number}")
            out.write.parquet(path)
            docs = spark.read.schema(out.schema).parquet(path)
    left = {r["doc_id"] for r in out.collect()}
    if rows:
        # without labels every text passes; items, repeated passages and copies go
        assert {1, 7, 13} <= left and not {14, 15} & left and len([r for r in out.collect() if r["doc_id"] == 9]) <= 2
    else:
        assert not left


@needs_tables
@pytest.mark.parametrize("name", ["op6_url_filter", "op7_line_dedup"])
def test_query_equals_its_sql(spark, name):
    import __spark_entry__ as entry
    from compare import connect, difference

    assert difference(entry.queries()[name](spark, SF_DIR), connect(SF_DIR), entry.oracle_sql()[name]) is None


@needs_tables
def test_contract_columns(spark):
    import __spark_entry__ as entry

    first = {
        "op1_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
        "op2_sentencepiece": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op5_token_orc": ["doc_id", "start", "n_tokens", "ids_crc32"],
        "op8_simhash": ["doc_id", "fingerprint", "component_id"],
        "op9_quality_trees": ["doc_id", "held_out", "score", "predicted"],
        "op10_personal_data": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    }
    for name, columns in first.items():
        frame = entry.queries()[name](spark, SF_DIR)
        assert set(columns) <= set(frame.columns), name
        kinds = dict(frame.dtypes)
        assert all(kinds[c] == "bigint" for c in columns if c.startswith("n_") or c in ("doc_id", "start", "ids_crc32", "component_id"))
        assert frame.count() == 200


@needs_tables
def test_registered_digests(spark):
    """What the queries of the encoders and of fingerprints return, from the libraries and plain loops."""
    import hashlib

    import sentencepiece
    from tokenizers import Tokenizer

    import __spark_entry__ as entry
    from warpwise.llm.queries import tokenizer_path

    texts = {r[0]: r[1] or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()}

    def rows(name):
        found = {r["doc_id"]: r for r in entry.queries()[name](spark, SF_DIR).collect()}
        assert set(found) == set(texts)
        return found

    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    pieces = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    counts = rows("op3_token_counts")
    for d, r in rows("op2_sentencepiece").items():
        ids = pieces.encode(texts[d])
        assert [r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]] == [len(ids), digest(",".join(map(str, ids))), digest(pieces.decode(ids))]
        assert counts[d]["n_tokens"] == len(ids)

    letters = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    start, stored = 0, rows("op5_token_orc")
    for d in sorted(texts):
        ids = letters.encode(texts[d], add_special_tokens=False).ids + [2]
        r = stored[d]
        assert [r["start"], r["n_tokens"], r["ids_crc32"]] == [start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())]
        start += len(ids)

    prints = {d: plain.fingerprint(t) for d, t in texts.items()}
    ids = sorted(prints)
    near = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 3]
    first = plain.components(ids, near)
    assert {d: (r["fingerprint"], r["component_id"]) for d, r in rows("op8_simhash").items()} == {d: (f"{prints[d]:016x}", first[d]) for d in ids}
