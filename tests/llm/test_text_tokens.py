"""Encoding operators against the libraries."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.orc
import pytest
from pyspark.sql import functions as F

import plain_text as plain
from warpwise.llm import sentencepiece_bpe, token_counts, token_orc, words
from warpwise.llm.queries import tokenizer_path
from warpwise.runtime import new_path

PIECES = tokenizer_path("piece_bpe_32k.model")
LETTERS = tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def model():
    return sentencepiece_bpe.PieceModel(sentencepiece_bpe.read_model(PIECES))


def random_texts(n, alphabet, size, seed=7):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(size))) for _ in range(n)]


def cut(flat, lengths):
    ends = np.cumsum(lengths)
    return [flat[e - n : e].tolist() for e, n in zip(ends, lengths)]


def test_pieces_equal_the_library(model, library):
    texts = [t or "" for _, t in plain.ROWS] + ["aaaa" * 50, "abab" * 40, " " * 70 + "x", "日本語" * 50, "\x00z", "a\n\n b"]
    texts += random_texts(1500, "aeb tn\nh  is▁oé日", 150)
    flat, lengths = words.WordIds(model.merge)([sentencepiece_bpe.spaced(t) for t in texts])
    assert cut(flat, lengths) == library.encode(texts)
    decoded = model.decode(flat.astype(np.int64), lengths).to_pylist()
    assert decoded == [library.decode(ids) for ids in library.encode(texts)]


def check_ids(model, library, texts):
    flat, lengths = words.WordIds(model.merge)([sentencepiece_bpe.spaced(t) for t in texts])
    wrong = [t for t, own, ids in zip(texts, cut(flat, lengths), library.encode(texts)) if own != ids]
    assert not wrong, (len(wrong), wrong[:3])


@pytest.fixture(scope="module")
def repeated(library):
    """Characters of which several in a row are a piece."""
    pieces = [library.id_to_piece(i) for i in range(library.get_piece_size())]
    return sorted({p[0].replace("▁", " ") for p in pieces if len(p) > 1 and len(set(p)) == 1})


def test_runs_of_one_character_equal_the_library(model, library, repeated):
    assert " " in repeated and len(repeated) > 50
    check_ids(model, library, [t for c in repeated for n in range(301) for t in (c * n, f"x{c * n}y", f"x {c * n}")])


def test_texts_made_of_runs_equal_the_library(model, library, repeated):
    rng = random.Random(11)
    alphabet = [*repeated, *"aex \n"]
    runs = ["".join(rng.choice(alphabet) * rng.choice([1, 1, 2, 3, 4, 8, 16, 17, 31, 40]) for _ in range(rng.randint(1, 12))) for _ in range(17_000)]
    mixed = ["".join(rng.choice(pair) for _ in range(rng.randint(1, 80))) for pair in ["ab", "-=", "#*", "./", "  -", "aab", "=="] for _ in range(500)]
    check_ids(model, library, runs + mixed)


@pytest.mark.parametrize("ids", [[1, 306, 2], [3, 200, 201, 5], [0, 0, 306], [231, 187], [259, 259, 306], [], [2]])
def test_any_ids_decode_as_in_the_library(model, library, ids):
    assert model.decode(np.array(ids, np.int64), np.array([len(ids)])).to_pylist() == [library.decode(ids)]


def test_encode_and_decode_frames(spark, library):
    coded = sentencepiece_bpe.encode(plain.table(spark), PIECES, decoded="decoded")
    assert coded.columns.count("ids") == 1 and "tie" in coded.columns
    rows = coded.collect()
    assert len(rows) == len(plain.ROWS)
    for row in rows:
        expected = library.encode(row["text"] or "")
        assert row["ids"] == expected and row["decoded"] == library.decode(expected)
    again = sentencepiece_bpe.decode(coded.select("text", "ids"), PIECES).collect()
    assert all(r["decoded"] == library.decode(r["ids"]) for r in again)
    assert sentencepiece_bpe.encode(plain.table(spark, []), PIECES).count() == 0


def test_words_equal_the_tokenizer_library():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(LETTERS)
    texts = [t or "" for _, t in plain.ROWS] + ["É é ́x", "It's we'LL\ty\u0085z\x1cq ΑΣ Σ", "<|STARTOFTEXT|> A<|startoftext|>B", "wor,d. .,"]
    texts += random_texts(1500, "aE'sl \n\t ́日é1<|!.,", 60)
    with open(LETTERS, encoding="utf-8") as file:
        encoder = words.WordIds(token_orc.StretchEncoder(file.read(), 2))
    for chunk in (texts[:700], texts[700:]):
        flat, lengths = encoder(token_orc.stretches(pa.array(chunk)))
        assert cut(flat, lengths) == [whole.encode(t, add_special_tokens=False).ids + [2] for t in chunk]


def test_orc_files_round_trip(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(LETTERS)
    docs = plain.table(spark)
    path = new_path(spark, "orc-test")
    token_orc.write(docs, path, LETTERS, end_id=2)
    stored = token_orc.read(spark, path)
    rows = token_orc.checksums(stored).orderBy("start").collect()
    assert len(rows) == len(plain.ROWS)
    known = [r["doc_id"] for r in rows if r["doc_id"] is not None]
    assert known == sorted(known)
    starts = np.cumsum([0] + [r["n_tokens"] for r in rows])
    assert [r["start"] for r in rows] == starts[:-1].tolist()

    def digest(text):
        return zlib.crc32(np.array(whole.encode(text or "", add_special_tokens=False).ids + [2], "<u4").tobytes())

    assert sorted((r["doc_id"] or -1, r["ids_crc32"]) for r in rows) == sorted((d or -1, digest(t)) for d, t in plain.ROWS)
    assert {r["doc_id"] for r in token_orc.lookup(spark, path, [7, 8]).collect()} == {7, 8}
    plan = token_orc.lookup(spark, path, [7])._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,7)" in plan or "In(doc_id" in plan


def test_orc_of_an_empty_table(spark):
    path = new_path(spark, "orc-test")
    token_orc.write(plain.table(spark, []), path, LETTERS, end_id=2)
    assert token_orc.checksums(token_orc.read(spark, path)).count() == 0


@pytest.mark.parametrize("file_bytes", [1, 300, token_counts.FILE_BYTES])
def test_token_files(spark, library, file_bytes):
    docs = plain.table(spark).repartition(3)
    path = new_path(spark, "tokens")
    rows = token_counts.token_counts(docs, path, PIECES, file_bytes=file_bytes).collect()
    expected = sorted((d or -1, len(library.encode(t or ""))) for d, t in plain.ROWS)
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in rows) == expected
    sizes = [r["length"] for r in spark.read.format("binaryFile").option("pathGlobFilter", token_counts.TOKEN_FILES).load(path).collect()]
    longest = max(2 * n + 2 for _, n in expected)
    assert sum(sizes) == sum(2 * n + 2 for _, n in expected) and max(sizes) <= max(file_bytes, longest)


def test_ids_stay_with_their_tokens(spark, library):
    """Ids come from the task that wrote the tokens: input that no second read gives alike, ids with separators in them, no setting changed."""
    texts = ["a b c " * n for n in range(300)]
    docs = spark.createDataFrame([(f"id \u0002\0\n\"{n}\"", t) for n, t in enumerate(texts)], "doc_id string, text string")
    setting = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    rows = token_counts.token_counts(docs.orderBy(F.rand()), new_path(spark, "tokens"), PIECES, file_bytes=2000).collect()
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == setting
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {f"id \u0002\0\n\"{n}\"": len(library.encode(t)) for n, t in enumerate(texts)}
    assert len({(r["task"], r["run"]) for r in rows}) > 20


@pytest.mark.parametrize("block", [1, 2, 3, 5, 64])
def test_blocks_are_stitched(spark, tmp_path, block):
    rng = random.Random(block)
    expected = []
    for number in range(4):
        ids = [rng.choice([2, 5, 6, 7]) for _ in range(rng.randrange(40))] if number else []
        (tmp_path / f"part-{number}").write_bytes(np.array(ids, "<u2").tobytes())
        start = 0
        for ordinal, at in enumerate([i for i, x in enumerate(ids) if x == 2]):
            expected.append((f"part-{number}", ordinal, start, at - start, True))
            start = at + 1
        if start < len(ids):
            expected.append((f"part-{number}", ids.count(2), start, len(ids) - start, False))
    found = token_counts.documents_in(spark, str(tmp_path), block_tokens=block).collect()
    assert sorted(map(tuple, found)) == sorted(expected)


def test_token_files_of_an_empty_table(spark, tmp_path):
    stored = str(tmp_path / "docs")
    plain.table(spark, []).write.parquet(stored)
    assert token_counts.token_counts(spark.read.parquet(stored), new_path(spark, "tokens"), PIECES).count() == 0


def test_digest_columns_do_not_depend_on_the_partitioning(spark):
    docs = plain.table(spark)
    one, many = (
        sentencepiece_bpe.encode(docs.repartition(n), PIECES, keep=["doc_id"]).agg(F.sum(F.xxhash64("doc_id", "ids").cast("decimal(30)"))).first()
        for n in (1, 7)
    )
    assert one == many
