"""Quality rules: a hashed n-gram likelihood ratio between trusted and raw text, and base rules.

Words and pairs of words are hashed into BUCKETS counters. Two multinomials are counted, one over the
trusted documents (the target) and one over all documents (the raw corpus), both with a smoothing of
SMOOTHING counts a bucket. A document's score is the sum of log(target / raw) over its n-grams divided by
their number; documents that pass the base rules are kept from the threshold on, without any drawing of
lots.

The scale is the same at any size of the corpus: documents are dealt to FOLDS folds by a hash of
the id and scored with the counts of the other folds, so no document meets its own n-grams (near copies of it in other folds
do vouch for it). A weight is log((t + 1) / (r T / R + 1)) for t of T target and r of R raw counts: an n-gram unseen elsewhere
weighs nothing. The threshold is the score that CUT of the trusted documents with n-grams lie below, on a grid of
0.0001; without trusted words there is none.

Everything is DataFrame functions: per-document counts come from array functions inside the row, the
corpus counts from one aggregation over buckets (combined before its shuffle), the scores from a join
with the table of weights, which always has BUCKETS rows, and a sum per document that is combined before
its shuffle too.

Defined cases: a null or empty text has no words and fails; a document without n-grams has score zero;
rows that agree in id and text get the same result; rows without id are scored, but never trusted; without
trusted words every weight is zero; columns of the input other than the id and the text are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import materialise
from .columns import column

BUCKETS = 1 << 16
SMOOTHING = 1.0
FOLDS = 5  # no document is scored with the counts of its own fold
CUT = 0.05  # share of trusted documents below the threshold
GRID = 10_000  # steps of a score of one
LEAST_WORDS = 10
REPEATED_PERCENT = 20
WINDOW = 5
BROADCAST_IDS = 2_000_000  # more trusted ids than these are joined by a shuffle
SPACES = r"[\x20\x09-\x0D]"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, although it may be used inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES + "+"), lambda w: w != "")


def _window_hashes(hashes: Column) -> Column:
    """A hash of each run of WINDOW words, from the hashes of the words."""
    starts = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
    return F.when(
        F.size(hashes) >= WINDOW, F.transform(starts, lambda i: F.xxhash64(*[hashes[i + k] for k in range(WINDOW)]))
    ).otherwise(F.array().cast("array<bigint>"))


def _covered_by_repeats(windows: Column) -> Column:
    """Words inside windows that occur twice or more: positions sorted by hash, neighbours compared, spans merged."""
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s):
        last = F.size(s) - 1
        found = F.filter(
            s,
            lambda x, k: ((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["h"] == x["h"]))
            | ((k < last) & (s[F.least(k + 1, last)]["h"] == x["h"])),
        )
        return F.sort_array(F.transform(found, lambda x: x["i"]))

    none = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(
        let(ordered, repeated),
        none,
        lambda state, at: F.struct((state["n"] + F.least(F.lit(WINDOW), at - state["last"])).alias("n"), at.alias("last")),
        lambda state: state["n"],
    )


def repeated_words(found: Column) -> Column:
    """How many words of an array lie in a run of WINDOW words that the array holds twice or more."""
    hashes = F.transform(found, lambda w: F.xxhash64(w))
    windows = let(hashes, _window_hashes)
    none = F.lit(0).cast("bigint")
    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), none).otherwise(_covered_by_repeats(w)))


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    whole = F.coalesce(column(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def counts(w):
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        )

    lines_of = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))
    counted = docs.withColumn("__counts", let(words(column(text)), counts))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    return (
        counted.withColumn("n_words", F.col("__counts.n_words"))
        .withColumn("word_chars", F.col("__counts.word_chars"))
        .withColumn("n_symbols", F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("bigint"))
        .withColumn("n_dup_lines", lines_of)
        .withColumn("n_repeat_words", F.col("__counts.n_repeat_words"))
        .withColumn("base_failed", failed)
        .drop("__counts")
    )


def ngram_buckets(text: Column) -> Column:
    """Buckets of all words and of all pairs of neighbouring words."""

    def bucket(h):
        return F.pmod(h, F.lit(BUCKETS)).cast("int")

    def both(h):
        rest = F.size(h) - 1
        pairs = F.zip_with(F.slice(h, F.lit(1), F.greatest(rest, F.lit(0))), F.slice(h, F.lit(2), F.greatest(rest, F.lit(0))), lambda a, b: bucket(F.xxhash64(a, b)))
        return F.concat(F.transform(h, bucket), pairs)

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), both)


def fold_of(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(FOLDS)).cast("int")


def fold_weights(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(code, weight) for all folds and buckets, code = fold * BUCKETS + bucket, from the counts of the other folds.

    ``docs`` has id and text; ``ids`` the distinct trusted ids and a column ``trusted``.
    """
    rows = docs.join(ids, "id", "left").withColumn("fold", fold_of(F.col("id")))
    grams = rows.select("trusted", "fold", F.explode(ngram_buckets(F.col("text"))).alias("bucket"))
    counts = materialise(
        grams.groupBy((F.col("fold") * BUCKETS + F.col("bucket")).alias("code")).agg(F.count("*").alias("raw"), F.count("trusted").alias("target")),
        "fold-counts",
    )
    every = docs.sparkSession.range(FOLDS * BUCKETS).select(F.col("id").cast("int").alias("code"))
    known = every.join(counts, "code", "left").na.fill(0, ["raw", "target"])
    known = known.withColumn("fold", F.floor(F.col("code") / BUCKETS)).withColumn("bucket", F.col("code") % BUCKETS)
    by_fold = known.groupBy("fold").agg(F.sum("raw").alias("fold_raw"), F.sum("target").alias("fold_target"))
    by_bucket = known.groupBy("bucket").agg(F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"))
    totals = by_fold.agg(F.sum("fold_raw").alias("sum_raw"), F.sum("fold_target").alias("sum_target"))
    joined = known.join(by_bucket, "bucket").join(F.broadcast(by_fold), "fold").crossJoin(F.broadcast(totals))
    r, t = F.col("all_raw") - F.col("raw"), F.col("all_target") - F.col("target")
    whole_r, whole_t = F.col("sum_raw") - F.col("fold_raw"), F.col("sum_target") - F.col("fold_target")
    weight = F.log((t + SMOOTHING) / (r * whole_t / whole_r + SMOOTHING))
    return joined.select("code", F.when(whole_t > 0, weight).otherwise(0.0).alias("weight"))


def lower_cut(scores: DataFrame) -> float:
    """The score, down to the grid, that at most CUT of the rows lie below; minus infinity for no rows."""
    steps = scores.groupBy(F.floor(F.col("score") * GRID).alias("step")).count().orderBy("step").collect()  # bounded by the range of scores
    skip = int(CUT * sum(r["count"] for r in steps))
    for row in steps:
        if skip < row["count"]:
            return row["step"] / GRID
        skip -= row["count"]
    return float("-inf")


def judged_by_trusted(docs: DataFrame, trusted: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: its id as doc_id, the base counts, base_failed, score and kept.

    ``trusted`` has the ids of the target; the threshold comes from their scores.
    """
    ids = trusted.select(column(doc_id).alias("id")).where("id is not null").distinct().withColumn("trusted", F.lit(1))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    named = docs.select(column(doc_id).alias("id"), column(text).alias("text"))
    weighted = materialise(fold_weights(named, ids), "fold-weights")
    # the hash of the text is a column before the text is exploded, else it would be taken for every n-gram
    rows = named.select("id", F.xxhash64("text").alias("tie"), fold_of(F.col("id")).alias("fold"), "text")
    grams = rows.select("id", "tie", "fold", F.explode(ngram_buckets(F.col("text"))).alias("bucket"))
    codes = grams.select("id", "tie", (F.col("fold") * BUCKETS + F.col("bucket")).alias("code"))
    summed = codes.join(F.broadcast(weighted), "code").groupBy("id", "tie").agg(F.avg("weight").alias("score"))
    scores = materialise(summed.withColumn("score", F.round("score", 9)), "ratio-scores")  # sums come in any order
    least = lower_cut(scores.join(ids, "id"))
    based = base_counts(named.withColumnRenamed("id", "doc_id")).withColumn("tie", F.xxhash64("text")).drop("text")
    same = based["doc_id"].eqNullSafe(scores["id"]) & (based["tie"] == scores["tie"])
    score = F.coalesce("score", F.lit(0.0))
    return based.join(scores, same, "left").select(
        *[based[c] for c in based.columns if c != "tie"],
        score.alias("score"),
        (~F.col("base_failed") & (score >= least)).alias("kept"),
    )
