"""Operators on single documents and on the corpus, against plain loops."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import plain_text as plain
from warpwise.llm import decontamination, line_dedup, personal_data, quality_rules, quality_trees, simhash, url_filter
from warpwise.llm.components import connected_components


def by_row(rows):
    """Sortable copies of rows with nulls."""
    return sorted(tuple((v is not None, v) for v in r) for r in rows)


# --- quality rules -----------------------------------------------------------------------------


def test_base_counts(spark):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    extra = [(100 + i, " ".join(random.Random(i).choice("abc") for _ in range(40 + i))) for i in range(12)]
    rows = plain.ROWS + extra
    trusted = spark.createDataFrame([(1,), (14,), (None,)], "doc_id long")
    found = quality_rules.judged_by_trusted(plain.table(spark, rows), trusted).collect()
    assert by_row((r["doc_id"], *(r[n] for n in names)) for r in found) == by_row((d, *plain.base_counts(t)) for d, t in rows)


def plain_scores(rows, trusted):
    """(score, kept) of each row: counts of hashed words and pairs in the other folds, and the cut of the trusted scores."""
    import struct
    from collections import Counter

    import xxhash

    def number(data, seed=42):
        return xxhash.xxh64_intdigest(data, seed)

    def long(value, seed=42):
        return number(struct.pack("<Q", value % 2**64), seed)

    def grams(text):
        h = [number(w.encode()) for w in plain.words(text)]
        every = h + [long(b, long(a)) for a, b in zip(h, h[1:])]
        return [(x - 2**64 if x >= 2**63 else x) % quality_rules.BUCKETS for x in every]

    def fold(d):
        x = long(d)
        return (x - 2**64 if x >= 2**63 else x) % quality_rules.FOLDS

    scores = []
    for d, t in rows:
        raw, target = Counter(), Counter()
        for e, u in rows:
            if fold(e) != fold(d):
                raw.update(grams(u))
                target.update(grams(u) if e in trusted else [])
        whole_r, whole_t = raw.total(), target.total()
        logs = [np.log((target[g] + 1) / (raw[g] * whole_t / whole_r + 1)) if whole_t else 0.0 for g in grams(t)]
        scores.append(round(float(np.mean(logs)), 9) if logs else None)
    steps = sorted(np.floor(s * quality_rules.GRID) for s, (d, _) in zip(scores, rows) if d in trusted and s is not None)
    least = steps[int(quality_rules.CUT * len(steps))] / quality_rules.GRID if steps else -np.inf
    return [(s or 0.0, not plain.base_counts(t)[5] and (s or 0.0) >= least) for s, (_, t) in zip(scores, rows)]


@pytest.mark.parametrize("share", [0.0, 0.4])
def test_scores_and_cut_equal_plain_loops(spark, share):
    rng = random.Random(9)
    rows = [(i, " ".join(f"{'junk' if i % 3 == 0 else 'word'}{rng.randrange(40)}" for _ in range(rng.randrange(60)))) for i in range(70)]
    trusted = {i for i in range(70) if i % 3 and rng.random() < share}
    asked = spark.createDataFrame([(i,) for i in sorted(trusted)], "doc_id long")
    found = {r["doc_id"]: (r["score"], r["kept"]) for r in quality_rules.judged_by_trusted(plain.table(spark, rows), asked).collect()}
    for (d, _), (score, kept) in zip(rows, plain_scores(rows, trusted)):
        assert found[d][0] == pytest.approx(score, abs=1e-8) and found[d][1] == kept


def test_quality_rules_without_trust_or_rows(spark):
    nobody = spark.createDataFrame([], "doc_id long")
    assert {r["score"] for r in quality_rules.judged_by_trusted(plain.table(spark), nobody).collect()} == {0.0}
    assert quality_rules.judged_by_trusted(plain.table(spark, []), nobody).count() == 0


def test_trusted_ids_joined_by_shuffle(spark, monkeypatch):
    trusted = spark.createDataFrame([(1,), (14,)], "doc_id long")
    docs = plain.table(spark)
    wide = quality_rules.judged_by_trusted(docs, trusted).collect()
    monkeypatch.setattr(quality_rules, "BROADCAST_IDS", 0)
    assert by_row(quality_rules.judged_by_trusted(docs, trusted).collect()) == by_row(wide)


# --- decontamination ---------------------------------------------------------------------------


def expected_matches(rows, items):
    out = []
    for d, t in rows:
        have = plain.shingles(t)
        for i, x in items:
            s = plain.shingles(x)
            if s and 5 * len(s & have) >= 4 * len(s):
                out.append((d, i, len(s), len(s & have)))
    return out


@pytest.mark.parametrize("block_bytes", [16 << 20, 4000])
def test_containment(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block_bytes)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 45)))) for i in range(25)]
    items += [(100, None), (101, ""), (102, items[0][1]), (None, items[1][1].upper()), (103, plain.FILLER), (104, "hello, WORLD")]
    rows = list(plain.ROWS) + [(200, "Hello -- world")]
    for k in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 400))]
        item = (items[rng.randrange(25)][1] or "").split()
        for _ in range(rng.randrange(8)):  # leave the passage whole or damage it
            if item:
                item[rng.randrange(len(item))] = "other"
        at = rng.randrange(len(words))
        rows.append((300 + k, " ".join(words[:at] + item + words[at:]).title() + "."))
    asked = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.contaminated(plain.table(spark, rows), asked)
    got = [(r["doc_id"], r["item_id"], r["n_shingles"], r["n_shared"]) for r in found.collect()]
    assert by_row(got) == by_row(expected_matches(rows, items))
    held = {r[0] for r in got}
    kept = decontamination.clean(plain.table(spark, rows), asked)
    assert kept.columns == plain.table(spark, rows).columns
    assert by_row((r["doc_id"],) for r in kept.collect()) == by_row((d,) for d, _ in rows if d not in held)


def test_hashes_do_not_depend_on_the_pieces(monkeypatch):
    texts = [("word " * 30 + "x" * 90 + " end ") * 5, "", "a", "tail é " * 40, "y" * 200]
    whole = decontamination.shingle_hashes(texts)
    for size in (1, 7, 64):
        monkeypatch.setattr(decontamination, "PIECE_BYTES", size)
        assert all(np.array_equal(a, b) for a, b in zip(whole, decontamination.shingle_hashes(texts)))
    assert decontamination.shingle_hashes([])[0].size == 0


def test_containment_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(plain.table(spark), none).count() == 0
    assert decontamination.clean(plain.table(spark), none).count() == len(plain.ROWS)
    assert decontamination.contaminated(plain.table(spark, []), none).count() == 0


def test_sketches_lose_no_match():
    """Any way to damage a fifth of an item's shingles leaves one of its sketch."""
    for n in range(1, 200):
        missing = n - -(-4 * n // 5)
        assert decontamination.sketch_size(decontamination.size_class(n)) > missing


# --- line deduplication ------------------------------------------------------------------------


def chunked(text):
    import hashlib

    def md5(x):
        return hashlib.md5(x.encode()).hexdigest()

    lines = text.split("\n")
    digests = [md5(x) for x in lines]
    long = [len(plain.words(x)) >= 50 for x in lines]
    start = 0
    for i in range(len(lines)):
        rolling = md5((digests[i - 1] if i else "") + digests[i])
        last = i == len(lines) - 1
        if last or long[i] or long[i + 1] or int(rolling[-1], 16) % 2 == 0:
            yield start, i + 1, lines[start : i + 1], long[start]
            start = i + 1


def line_ranges(text):
    """Ranges (start, end) of lines whose repetitions go: chunks, and the shortest runs of 50 words from and to each line."""
    out = {(start, start + len(lines)) for start, _, lines, long in chunked(text) if (len(lines) > 1 or long) and any(map(plain.words, lines))}
    count = [len(plain.words(line)) for line in text.split("\n")]
    for i in range(len(count)):
        if count[i]:
            ends = [j for j in range(i, len(count)) if sum(count[i : j + 1]) >= 50]
            starts = [j for j in range(i, -1, -1) if sum(count[j : i + 1]) >= 50]
            out |= {(i, ends[0] + 1)} if ends else set()
            out |= {(starts[0], i + 1)} if starts else set()
    return out


def deduplicated(rows):
    import hashlib

    def place_of(d, t):
        return d is not None, d or 0, hashlib.md5(t.encode()).hexdigest()

    places = {}
    for d, t in rows:
        if t is not None:
            lines = t.split("\n")
            for start, end in line_ranges(t):
                places.setdefault("\n".join(lines[start:end]), set()).add((*place_of(d, t), start))
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, None, 0, 0))
            continue
        lines = t.split("\n")
        gone = set()
        for start, end in line_ranges(t):
            if min(places["\n".join(lines[start:end])]) != (*place_of(d, t), start):
                gone |= set(range(start, end))
        out.append((d, "\n".join(line for i, line in enumerate(lines) if i not in gone), len(lines), len(gone)))
    return out


def test_line_chunks(spark):
    rng = random.Random(11)
    vocabulary = [f"line number {i}" for i in range(12)] + ["", " ", plain.PASSAGE, plain.PASSAGE + " more"]
    rows = list(plain.ROWS) + [(50 + k, "\n".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 14)))) for k in range(60)]
    found = line_dedup.deduplicated(plain.table(spark, rows), hot=10)
    assert "removed" in found.columns and "tie" in found.columns
    got = by_row((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in found.collect())
    assert got == by_row(deduplicated(rows))
    assert line_dedup.deduplicated(plain.table(spark, [])).count() == 0


def test_a_long_passage_goes_from_all_but_one_document(spark):
    found = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(plain.table(spark)).collect()}
    assert plain.PASSAGE in found[7] and found[8] == "another intro\nanother outro"


def test_passages_of_short_lines_go_whatever_surrounds_them(spark):
    rng = random.Random(12)

    def lines(n, size):
        return [" ".join(f"w{rng.randrange(10**6)}" for _ in range(size)) for _ in range(n)]

    passages = [lines(n, size) for n, size in [(2, 25), (3, 17), (5, 11), (30, 3), (60, 1), (4, 40)]] + [lines(2, 25) + lines(1, 3), lines(1, 60)]
    passages.append([x for line in lines(6, 10) for x in (line, "")][:-1])  # blank lines between
    rows, inside = [], {}
    for k in range(60):
        passage = passages[k % len(passages)]
        rows.append((k, "\n".join(lines(rng.randrange(4), 7) + passage + lines(rng.randrange(4), 9))))
        inside[k] = {x for x in passage if x}
    found = {r["doc_id"]: set(r["text"].split("\n")) for r in line_dedup.deduplicated(plain.table(spark, rows)).collect()}
    for k, text in rows:
        own = set(text.split("\n"))
        assert found[k] - {""} == (own if k < len(passages) else own - inside[k]) - {""}


def test_ranges_of_one_name_with_different_texts_stay(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "name_of", lambda digests: F.length(digests).cast("long"))
    rows = [(1, "a b\nc d"), (2, "e f\ng h"), (3, "a b\nc d"), (4, plain.PASSAGE), (5, plain.PASSAGE)]
    found = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(plain.table(spark, rows)).collect()}
    assert found == dict(rows) | {5: ""}  # one line, so a name of its own


def test_line_dedup_carries_any_columns(spark):
    names = ["__id", "__digest", "__removed", "__tie", "__of", "__mark", "__left", "n_lines", "start", "digest"]
    docs = plain.table(spark, extra=False).selectExpr("*", *[f"'{i}' as {n}" for i, n in enumerate(names)])
    out = line_dedup.deduplicated(docs)
    assert out.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_removed"]
    assert {tuple(r[n] for n in names if n != "n_lines") for r in out.collect()} == {tuple(str(i) for i, n in enumerate(names) if n != "n_lines")}


# --- near-duplicates ---------------------------------------------------------------------------


@pytest.mark.parametrize("hot_key", [simhash.HOT_KEY, 4])
def test_simhash_components(spark, hot_key):
    rng = random.Random(2)
    base = [f"{a}{b}" for a in "abcdefgh" for b in range(60)]
    rows = list(plain.ROWS)
    for k in range(60):  # near copies of a few long texts
        words = base[40 * (k % 3) :][:300]
        for _ in range(k // 6):
            words[rng.randrange(len(words))] = "changed"
        rows.append((1000 - k, " ".join(words)))
    found = simhash.near_duplicates(plain.table(spark, rows), hot_key=hot_key).collect()
    prints = [(d, plain.fingerprint(t)) for d, t in rows]
    kinds = sorted({p for _, p in prints})
    near = [(a, b) for i, a in enumerate(kinds) for b in kinds[i + 1 :] if (a ^ b).bit_count() <= 3]
    assert near
    part = plain.components(kinds, near)
    least = {}
    for d, p in prints:
        if d is not None:
            least[part[p]] = min(d, least.get(part[p], d))
    signed = [(d, p - (1 << 64) if p >> 63 else p, least.get(part[p])) for d, p in prints]
    assert by_row(found) == by_row(signed)

    kept = simhash.one_of_each(plain.table(spark, rows), hot_key=hot_key)
    assert kept.columns == plain.table(spark, rows).columns
    left = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(part[plain.fingerprint(t)] for _, t in left) == sorted(set(part.values()))
    assert all(d == least.get(part[plain.fingerprint(t)]) for d, t in left)


def test_golay_keys_meet_within_three_bits():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 3000).astype(np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, rng.integers(0, 4), replace=False):
            y[i] ^= np.uint64(1 << int(b))
    keys = []
    for prints in (x, y):
        rows, found = simhash.join_keys(prints)
        keys.append({(r, k) for r, k in zip(rows.tolist(), found.tolist())})
    assert {r for r, _ in keys[0] & keys[1]} == set(range(len(x)))


def test_forest_and_shifts_agree():
    rng = np.random.default_rng(4)
    centre = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    prints = np.unique(centre[rng.integers(0, 5, 200)] ^ (np.uint64(1) << rng.integers(0, 60, 200).astype(np.uint64)))
    found, roots = simhash._forest(prints)
    forest = [(int(a), int(b)) for f, r in zip(found, roots) for a, b in zip(f, r)]
    near = [(int(a), int(b)) for i, a in enumerate(prints) for b in prints[i + 1 :] if int(a ^ b).bit_count() <= 3]
    nodes = list(map(int, prints))
    assert plain.components(nodes, forest) == plain.components(nodes, near)


def test_simhash_of_an_empty_table(spark):
    assert simhash.near_duplicates(plain.table(spark, [])).count() == 0
    assert simhash.one_of_each(plain.table(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, k) for k in range(1, 40)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    frame = spark.createDataFrame(edges + [(5, 5), (None, 3)], "u long, v long")
    found = {r["node"]: r["component"] for r in connected_components(frame).collect()}
    real = [(a, b) for a, b in edges if a != b]
    assert found == plain.components({n for e in real for n in e}, real)
    assert connected_components(frame.where("u < 0")).count() == 0


# --- quality classifier ------------------------------------------------------------------------


def labelled(n=900):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(("river", "stone", "quiet", "walk", "Market", "seven", "paper.", "light,")) for _ in range(rng.randrange(20, 80))]
        bad = i % 4 == 0
        rows.append((i, " ".join(w + rng.choice(("%%%", "$$$")) for w in words) if bad else " ".join(words)))
        labels.append((i, 0 if bad else 1, 0))
    return rows, labels


def test_classifier_on_held_out_documents(spark):
    rows, labels = labelled()
    asked = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    featured, forest = quality_trees.trained(plain.table(spark, rows + plain.ROWS), asked)
    scored = quality_trees.scored(featured, forest).withColumn("held_out", quality_trees.held_out("doc_id"))
    found = scored.collect()
    assert len(found) == len(rows) + len(plain.ROWS) and all(0 <= r["score"] <= 1 for r in found)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    truth = {d: q for d, q, _ in labels}
    held = [r for r in found if r["held_out"] and r["doc_id"] >= 20]
    right = sum((r["score"] >= quality_trees.THRESHOLD) == truth[r["doc_id"]] for r in held)
    assert right >= 0.97 * len(held)


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    forest = quality_trees.train(x, (x[:, 0] * x[:, 1] > 0).astype(float))

    def walk(row):
        total = forest.base
        for feature, cut, leaf in zip(forest.feature, forest.cut, forest.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))

    scores = forest.scores(x)
    assert scores == pytest.approx([walk(r) for r in x])
    assert ((scores > 0.5) == (x[:, 0] * x[:, 1] > 0)).mean() > 0.95


def test_classifier_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    featured, forest = quality_trees.trained(plain.table(spark), none)
    assert {r["score"] for r in quality_trees.scored(featured, forest).collect()} == {0.5}
    featured, forest = quality_trees.trained(plain.table(spark, []), none)
    assert quality_trees.scored(featured, forest).count() == 0


# --- personal data -----------------------------------------------------------------------------


def random_personal(n=4000):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab@@..+-%1234590 ()-") for _ in range(rng.randrange(80))) for _ in range(n)]
    return texts + ["".join(rng.choice("0123 -.") for _ in range(rng.randrange(60))) for _ in range(n)]


def test_spans_equal_the_patterns():
    for text in [t or "" for _, t in plain.ROWS] + random_personal():
        found = personal_data.spans(text)
        assert {k: found[k] for k in personal_data.BASE_KINDS} == plain.personal(text), text


def test_added_spans():
    text = "IBAN: DE89 3704 0044 0532 0130 00 and account no. 12345678, see https://a.b.de/x?y=1). ftp://x account abc"
    found = {k: [text[a:b] for a, b in v] for k, v in personal_data.spans(text).items()}
    assert found["account"] == ["DE89 3704 0044 0532 0130 00", "12345678"] and found["address"] == ["https://a.b.de/x?y=1"]


SECRET = (
    r"""(?<![A-Za-z0-9\u00c0-\uffff])(token|secret|key|apikey|credentials?|bearer|password|passwd|pwd|passphrase)"""
    r"""["']?[ \t]{0,3}(?::=|=>|[:=])[ \t]{0,3}["'`]?([A-Za-z0-9+/_.~-]+={0,2})"""
)


def plain_secrets(text):
    """Every cue in turn, by one pattern and counts of letters and digits."""
    import re

    forms = {f for c in personal_data.SECRET_CUES + personal_data.PASSWORD_CUES for f in (c, c.upper(), c.capitalize())}
    out, done = [], 0
    for at in range(len(text)):
        m = re.compile(SECRET, re.IGNORECASE).match(text, at)
        if not m or at < done or m[1] not in forms or (at and text[at - 1].isalnum()):
            continue
        least = (8, 1) if m[1].lower().startswith(("pass", "pwd")) else (16, 2)
        if len(m[2]) >= least[0] and len(re.findall("[0-9]", m[2])) >= least[1] and re.search("[A-Za-z]", m[2]):
            out.append(m.span(2))
            done = m.end()
    return out


def test_secrets_equal_a_plain_search():
    rng = random.Random(8)
    pieces = [*personal_data.SECRET_CUES, *personal_data.PASSWORD_CUES, "TOKEN", "Password", "api_", "monkey", "=", ": ", " := ", " = ", "=>", '"', "'", " ", "\n"]
    pieces += ["0123456789abcdef0123", "hunter22", "correcthorsebattery", "A1b2", "+/==", "é", "x" * 20, "9" * 20]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(2, 14))) for _ in range(6000)]
    found = [personal_data.spans(t)["secret"] for t in texts]
    assert found == [plain_secrets(t) for t in texts] and sum(map(len, found)) > 150
    text = 'a token = "0123456789abcdef0123456789abcdef01234567" b, password: hunter22, key=value, my secret: do not tell anyone'
    assert [text[a:b] for a, b in personal_data.spans(text)["secret"]] == ["0123456789abcdef0123456789abcdef01234567", "hunter22"]


def test_registered_personal_data(spark):
    import hashlib
    import re

    from warpwise.llm.queries import op10_personal_data

    folder = "/root/testdata/sf0.01"
    texts = {r[0]: r[1] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    rows = op10_personal_data(spark, folder).collect()
    assert len(rows) == len(texts)
    planted = 0
    for r in rows:
        base = plain.personal(texts[r["doc_id"]])
        named = ",".join(f"{k}:{a}:{b}" for k in personal_data.BASE_KINDS for a, b in base[k])
        assert r["base_sha256"] == hashlib.sha256(named.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in personal_data.BASE_KINDS] == [len(base[k]) for k in personal_data.BASE_KINDS]
        cued = re.search('token = "[0-9a-f]{40}"', texts[r["doc_id"]]) is not None
        planted += cued
        assert ("secret:" in r["spans"]) == cued
    assert planted > 5


def test_personal_data_frames(spark):
    found = personal_data.find(plain.table(spark))
    rows = found.collect()
    assert len(rows) == len(plain.ROWS) and found.columns.count("spans") == 1
    for row in rows:
        spans = [(s["kind"], s["start"], s["end"]) for s in row["spans"]]
        assert spans == [(k, *s) for k, v in personal_data.spans(row["text"] or "").items() for s in v]
    out = {r["doc_id"]: r["redacted"] for r in personal_data.redacted(found).collect()}
    assert out[16] == "ip <ip> and 1.2.3.256, card <card>, iban <account>, see <address>."
    assert out[14] == plain.FILLER
    assert personal_data.find(plain.table(spark, [])).count() == 0


# --- URL filters -------------------------------------------------------------------------------

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")]
PAGES = [
    (1, "http://a.example.com/en/1?x#y", None),
    (2, "https://WWW.Example.com/en/1", ""),
    (3, "http://site.org/start", '<link rel="canonical" href="http://other.org/page?utm=1">'),
    (4, "http://other.org/page", '<META http-equiv=refresh content="0; url=//b.net/es/z#frag">'),
    (5, "http://b.net/es/z", "<p>text"),
    (6, "http://free.com/x", '<link href="http://b.net/es/z" rel=canonical>'),
    (7, "http://alone.org/", '<link rel="stylesheet" href="http://b.net/es/z">'),
    (8, None, '<link rel="canonical" href="http://b.net/es/z">'),
    (9, "no scheme", None),
    (10, "http://site.org/dir/a", '<link rel=canonical href="b">'),
    (11, "http://site.org/dir/b", '<link rel=canonical href="/start">'),
    (11, "http://site.org/dir/b", '<link rel=canonical href="/start">'),
    (12, "http://notexample.com?q", None),
]
VERDICTS = {
    1: ("a.example.com", "/en/1", "example.com/en/", "block"),
    2: ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
    3: ("site.org", "/start", None, "block"),
    4: ("other.org", "/page", None, "block"),
    5: ("b.net", "/es/z", "net/es/", "block"),
    6: ("free.com", "/x", "com/", "allow"),
    7: ("alone.org", "/", None, "allow"),
    8: ("", "", None, "allow"),
    9: ("", "", None, "allow"),
    10: ("site.org", "/dir/a", None, "block"),
    11: ("site.org", "/dir/b", None, "block"),
    12: ("notexample.com", "", None, "allow"),
}


def test_url_verdicts(spark):
    rows = [(*p, "x", "y") for p in PAGES]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, action string, component string")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    found = url_filter.judged(pages, rules)
    assert "action" in found.columns
    got = by_row((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in found.collect())
    assert got == by_row((p[0], *VERDICTS[p[0]]) for p in PAGES)
    assert url_filter.judged(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judged(pages, rules.limit(0)).collect()} == {"allow"}


def test_url_filter_equals_its_sql(spark, tmp_path):
    import duckdb

    from warpwise.llm import queries

    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    found = queries.op6_url_filter(spark, str(tmp_path)).collect()
    assert by_row(found) == by_row(con.execute(queries.OP6_SQL).fetchall())


def test_words_are_split_at_ascii_blanks(spark):
    rows = [(i, t) for i, (_, t) in enumerate(plain.ROWS)]
    found = plain.table(spark, rows).select("doc_id", quality_rules.words(F.col("text")).alias("w")).collect()
    assert {r["doc_id"]: r["w"] for r in found} == {d: plain.words(t) for d, t in rows}
    assert not re.search(r"\s", "".join(w for r in found for w in r["w"] if w.isascii()))
