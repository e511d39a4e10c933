"""Encoding by content-defined chunks against the library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

import plain_text as plain
from warpwise.llm import chunk_bpe
from warpwise.llm.queries import op11_chunk_bpe, tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def check(library, encoder, texts):
    flat, lengths = encoder(pa.array(texts, pa.string()))
    ends = np.cumsum(lengths)
    wanted = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    wrong = [t for t, e, n, ids in zip(texts, ends, lengths, wanted) if flat[e - n : e].tolist() != ids]
    assert not wrong, (len(wrong), wrong[:3])
    decoded = chunk_bpe.TokenTexts(chunk_bpe.read_definition(PATH))(flat, lengths).to_pylist()
    assert decoded == [library.decode(ids, skip_special_tokens=False) for ids in wanted]


def strange(rng, n, size):
    pieces = [*"abcDE  \n\t'.!9é日ΣςJHTWYI", "̌", "̇", "̧", " ", "<|endoftext|>", "the ", "<|start", "oftext|>", "x,y.z", "don't "]
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(size))) for _ in range(n)]


def test_strange_texts(library):
    rng = random.Random(3)
    encoder = chunk_bpe.ChunkEncoder(chunk_bpe.read_definition(PATH))
    texts = strange(rng, 4000, 40) + strange(rng, 300, 3000) + ["x" * 9000, "日本" * 4000, " " * 5000, "ab" * 3000 + " " + "cd" * 3000, "", None]
    check(library, encoder, texts + [t for _, t in plain.ROWS])


def test_shared_passages_are_encoded_once_wherever_they_stand(library):
    rng = random.Random(4)
    passage = "".join(strange(rng, 1, 60_000))
    texts = [strange(rng, 1, 200)[0] + passage + strange(rng, 1, 200)[0] for _ in range(40)]
    encoder = chunk_bpe.ChunkEncoder(chunk_bpe.read_definition(PATH))
    check(library, encoder, texts)
    size = sum(len(t.encode()) for t in texts)
    assert encoder.encoded < 0.15 * size and encoder.encoded + encoder.reused == size


def test_store_starts_afresh(library, monkeypatch):
    monkeypatch.setattr(chunk_bpe, "STORE_BYTES", 1000)
    encoder = chunk_bpe.ChunkEncoder(chunk_bpe.read_definition(PATH))
    for seed in (1, 2, 1, 2):
        check(library, encoder, strange(random.Random(seed), 20, 2000))


def test_cuts_depend_on_the_bytes_before_them_only():
    rng = np.random.default_rng(1)
    body = rng.integers(97, 123, 50_000, dtype=np.uint8)

    def ends(data):
        return chunk_bpe.cuts(data, np.array([0]), np.array([len(data)]))[0]

    plain_cuts = {len(body) - e for e in ends(body)}
    shifted = {len(body) + 7 - e for e in ends(np.concatenate([np.full(7, 65, np.uint8), body]))}
    assert len(plain_cuts) > 20 and len(plain_cuts - shifted) <= 2


def test_frames(spark, library):
    docs = plain.table(spark).selectExpr("*", "'x' as decoded", "'y' as __text")
    rows = chunk_bpe.encode(docs, PATH, decoded="decoded").collect()
    assert len(rows) == len(plain.ROWS) and all(r["__text"] == "y" for r in rows)
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)
    back = chunk_bpe.decode(chunk_bpe.encode(docs, PATH).drop("decoded"), PATH).collect()
    assert sorted(r["decoded"] for r in back) == sorted(r["decoded"] for r in rows)
    assert chunk_bpe.encode(docs.limit(0), PATH, decoded="decoded").collect() == []


def test_decoding_any_ids(spark, library):
    lists = [None, [], [0, 1, 49407], [99999, 320, -1], [49406, 320]]
    rows = chunk_bpe.decode(spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "n int, ids array<int>"), PATH).collect()
    assert [r["decoded"] for r in sorted(rows)] == [library.decode([i for i in x or [] if 0 <= i < 49408], skip_special_tokens=False) for x in lists]


def test_registered_query(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r[0]: r[1] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    rows = op11_chunk_bpe(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        assert [r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]] == [len(ids), *digests]
