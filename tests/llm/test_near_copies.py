"""Near copies against brute force over all pairs of shingle sets."""

import random
import re

import pytest

import plain_text as plain
from warpwise.llm import near_copies, stages


def shingles(text):
    w = plain.words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def changed(n, seed):
    """Texts of which many are similar by 0.8 or more, but few by three bits of a fingerprint."""
    rng = random.Random(seed)
    base = [[f"{a}{b}{k}" for a in "abcdef" for b in range(40)] for k in range(8)]
    rows = []
    for k in range(n):
        words = list(base[k % 8][: 60 + 60 * (k % 4)])
        for _ in range(k % 7):
            words[rng.randrange(len(words))] = f"new{rng.randrange(1000)}"
        rows.append((1000 - k, " ".join(words)))
    return rows


@pytest.mark.parametrize("block_shingles", [near_copies.BLOCK_SHINGLES, 300])
def test_one_of_each_group(spark, block_shingles):
    rows = list(plain.ROWS) + changed(120, 3)
    sets = [shingles(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if similar(sets[a], sets[b])]
    part = plain.components(range(len(rows)), links)
    first = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            first[part[k]] = min(d, first.get(part[k], d))
    found = near_copies.one_of_each(plain.table(spark, rows), block_shingles=block_shingles)
    assert found.columns == plain.table(spark, rows).columns
    left = [r["doc_id"] for r in found.collect()]
    assert sorted((d is not None, d or 0) for d in left) == sorted((p in first, first.get(p, 0)) for p in set(part.values()))
    assert near_copies.one_of_each(plain.table(spark, [])).count() == 0


def test_the_stage_leaves_no_similar_pair(spark):
    """Pairs further apart than three bits went through before."""
    rows = changed(60, 5)
    left = {r["doc_id"] for r in stages.near_duplicates(spark, plain.table(spark, rows), "").collect()}
    kept = [(d, shingles(t)) for d, t in rows if d in left]
    far = [(plain.fingerprint(a) ^ plain.fingerprint(b)).bit_count() for i, (_, a) in enumerate(rows) for _, b in rows[:i] if similar(shingles(a), shingles(b))]
    assert max(far) > 3
    assert not [(a, b) for i, (a, x) in enumerate(kept) for b, y in kept[:i] if similar(x, y)]


def linked_by_bits_alone():
    """Two long texts of which operator 8 links fingerprints, while their five-word shingles are not similar by 0.8."""
    rng = random.Random(11)
    for _ in range(400):
        words = [f"w{rng.randrange(100_000)}" for _ in range(30)]
        repeated = words * 40
        other = list(repeated)
        for at in rng.sample(range(len(other)), 20):
            other[at] = f"x{rng.randrange(100_000)}"
        a, b = " ".join(repeated), " ".join(other)
        if (plain.fingerprint(a) ^ plain.fingerprint(b)).bit_count() <= 3 and not similar(shingles(a), shingles(b)):
            return a, b
    raise AssertionError("no such pair")


def test_the_stage_drops_what_operator_8_links(spark):
    """The stage looked for similar shingle sets alone before; both kinds of links together make the groups."""
    a, b = linked_by_bits_alone()
    chain = b.rsplit(" ", 1)[0] + " last"
    assert similar(shingles(b), shingles(chain))
    rows = [(1, a), (2, b), (3, chain), (4, plain.FILLER), (5, "other text " + plain.PASSAGE), (None, b)]
    left = {r["doc_id"] for r in stages.near_duplicates(spark, plain.table(spark, rows), "").collect()}
    assert left == {1, 4, 5}
