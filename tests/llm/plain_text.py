"""Plain loops that state what the text operators must return."""

import re
from collections import Counter

SPACE_SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[0-9a-z\x80-\U0010ffff]+")

FILLER = "the cat sat on a mat and saw seven small grey mice run over it again today"
PASSAGE = " ".join(f"word{i}" for i in range(60))

ROWS = [
    (1, "Alpha beta gamma delta.\nAlpha beta gamma delta.\nOnce more with feeling and some # symbols <here>"),
    (2, None),
    (3, ""),
    (4, " \n\t \n"),
    (5, "header one\nheader two\n" + FILLER),
    (6, "header one\nheader two\n" + FILLER + " differently"),
    (7, f"intro\n{PASSAGE}\noutro"),
    (8, f"another intro\n{PASSAGE}\nanother outro"),
    (9, "same text in two rows\nwith two lines"),
    (9, "same text in two rows\nwith two lines"),
    (9, "same id, other text"),
    (None, "no id here, mail me at a.b@c-d.example.org or +1 (555) 123-4567"),
    (None, None),
    (10, "spam " * 300),
    (11, "x" * 5000),
    (12, "日本語の文章です。ÄÖÜ ß é 🙂▁ tab\there\x0b\x0c end\r\n" * 3),
    (13, " ".join(f"{a}{b}" for a in "abcdefghij" for b in range(300))),
    (14, FILLER),
    (15, FILLER + "."),
    (16, "ip 10.0.0.255 and 1.2.3.256, card 4111 1111 1111 1111, iban DE89370400440532013000, see https://x.example.com/a?b."),
    (17, "a<|endoftext|>b <s> <0x0A> </s>  two  spaces   three"),
]


def table(spark, rows=ROWS, extra=True):
    """The rows as a documents table with further columns, some named like the operators' own."""
    names = ["ids", "tie", "id", "removed", "spans", "score", "matches", "fp", "root", "n_lines", "statistics", "offset"] if extra else []
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{n}` string" for n in names)
    made = [(d, t, "en", "s", len(t) if t is not None else None, *["x"] * len(names)) for d, t in rows]
    return spark.createDataFrame(made, schema)


def words(text):
    return SPACE_SPLIT.findall(text or "")


def base_counts(text):
    w = words(text)
    runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [line for line in (text or "").split("\n") if words(line)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def fingerprint(text):
    import xxhash

    w = words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def word_runs(text, n):
    """The set of runs of n words, A-Z lower-cased; fewer words are one run."""
    w = words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def similar(a, b):
    """A Jaccard similarity of 0.8 or more; empty sets are alike."""
    return 5 * len(a & b) >= 4 * len(a | b)


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text):
    w = ALNUM.findall((text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        n = int(c) * (2 if i % 2 else 1)
        total += n // 10 + n % 10
    return total % 10 == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def personal(text):
    def good(kind, found):
        digits = re.sub("[^0-9]", "", found)
        if kind == "ip":
            return all(int(x) <= 255 for x in found.split("."))
        if kind == "card":
            return 16 <= len(digits) <= 19 and luhn(digits)
        return kind == "email" or 8 <= len(digits) <= 15

    return {k: [m.span() for m in re.finditer(p, text or "") if good(k, m.group())] for k, p in PATTERNS.items()}
