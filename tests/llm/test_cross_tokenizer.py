"""Alignment of two tokenizers against plain loops over their libraries."""

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest

import plain_text as plain
from warpwise.llm import cross_tokenizer as ct
from warpwise.llm.queries import op13_cross_tokenizer, tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
OUT = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain_groups(libraries, text):
    """Groups and links of one text, token by token."""
    a, b = libraries
    if not text:
        return [], []
    byte = ct._byte_of_char()
    found = a.encode(" " + text, add_special_tokens=False)
    left = [(i, bytes(byte[c] for c in token)) for i, token in zip(found.ids, found.tokens)]
    right = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
    whole = (" " + text).encode()
    if b"".join(t for _, t in left) != whole or b"".join(t for _, t in right) != whole:
        return [], []
    groups, links = [], []
    i = j = at_a = at_b = 0
    ga, gb = [], []
    while i < len(left):
        if at_a == at_b:
            ga, gb = [left[i][0]], [right[j][0]]
            groups.append((ga, gb))
            at_a, at_b = at_a + len(left[i][1]), at_b + len(right[j][1])
        elif at_a < at_b:
            ga.append(left[i][0])
            at_a += len(left[i][1])
        else:
            gb.append(right[j][0])
            at_b += len(right[j][1])
        links.append((left[i][0], right[j][0]))
        # the token that ends here first is done, or both
        i, j = i + (at_a <= at_b), j + (at_b <= at_a)
    return groups, links


def digest(groups):
    named = [",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups]
    return hashlib.sha256(";".join(named).encode()).hexdigest() if named else ""


def plain_counts(libraries, texts):
    made = [plain_groups(libraries, t) for t in texts]
    count = Counter(pair for _, links in made for pair in set(links))
    best = Counter()
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return [
        (sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(k), sum(count[p] == best[p[0]] for p in k), sum(count[p] for p in k), digest(g))
        for g, k in made
    ]


def strange_texts(n, seed=5):
    rng = random.Random(seed)
    pieces = ["the ", "House", " ", "  ", "\n", "\t", " ", "　", "\u0085", "\x1c", "é", "日本", "🙂", "1984", "...", "'s", "▁", "<|endoftext|>", "<s>", "<0x0A>", "\x00", "x" * 40, "-" * 20, "\r\n"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(30))) for _ in range(n)]


def test_alignment_of_strange_texts(libraries):
    aligner = ct.Aligner(open(A, encoding="utf-8").read(), open(B, "rb").read())
    texts = strange_texts(1500) + [t for _, t in plain.ROWS] + [" ", "x", "wo rd " * 2000]
    found = aligner(pa.array(texts, pa.string()))
    wanted = [plain_groups(libraries, t) for t in texts]
    assert found["n_groups"].tolist() == [len(g) for g, _ in wanted] and found["n_links"].tolist() == [len(k) for _, k in wanted]
    assert aligner.digests(found) == [digest(g) for g, _ in wanted]
    assert sum(len(g) == 0 for g, _ in wanted) > 100  # U+2581 becomes a space, so such texts have no tokens


@pytest.mark.parametrize("hot", [1, 40, ct.HOT])
def test_counts_equal_plain_loops(spark, libraries, hot):
    texts = [t for _, t in plain.ROWS] + strange_texts(60, 8) * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = sorted(ct.counted(docs, A, B, keep=["doc_id"], hot=hot).collect())
    assert [tuple(r)[1:] for r in rows] == plain_counts(libraries, texts)


def test_columns_and_empty_tables(spark):
    docs = plain.table(spark).selectExpr("*", "'x' as doc", "'y' as row", "'z' as PAIR", "'w' as n_a", "'v' as same_links", "'u' as __text")
    out = ct.counted(docs, A, B)
    assert out.columns == [c for c in docs.columns if c != "n_a"] + OUT
    rows = out.collect()
    assert len(rows) == len(plain.ROWS) and {(r["doc"], r["row"], r["PAIR"], r["same_links"], r["__text"]) for r in rows} == {("x", "y", "z", "v", "u")}
    assert all(r["n_a"] == 0 and r["groups_sha256"] == "" for r in rows if not r["text"])
    assert ct.counted(docs.limit(0), A, B).collect() == []


def test_groups_hold_the_tokens(spark, libraries):
    for r in ct.groups(plain.table(spark), A, B, keep=["text"]).collect():
        groups, _ = plain_groups(libraries, r["text"])
        assert r["a_sizes"] == [len(a) for a, _ in groups] and r["b_sizes"] == [len(b) for _, b in groups]
        assert r["a_ids"] == [i for a, _ in groups for i in a] and r["b_ids"] == [i for _, b in groups for i in b]


def test_registered_query(spark, libraries):
    folder = "/root/testdata/sf0.001"
    rows = {r["doc_id"]: r for r in op13_cross_tokenizer(spark, folder).collect()}
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    wanted = plain_counts(libraries, [t for _, t in docs])
    assert len(rows) == len(docs)
    assert all(tuple(rows[d][c] for c in OUT) == w for (d, _), w in zip(docs, wanted))
