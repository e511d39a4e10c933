"""Line deduplication by content-defined chunks and runs of lines.

Two families of line ranges are sought in every text. Both depend on the lines inside a passage (chunks also on the one before it), so
inserting lines elsewhere does not move them:

* chunks: there is a cut after a line if the rolling hash over the digests of that line and the one before it is even;
  lines of LONG_LINE words or more are chunks of their own. Chunks of two lines or more, or of one long line, count if they hold a word;
* runs: from every line with words, the fewest lines onwards, and the fewest backwards, that hold LONG_LINE words or more. Whatever
  surrounds it, the runs inside a repeated passage of LONG_LINE words or more cover it from its first line to its last.

A range is named by the digest of its lines' digests. A line goes where it lies in a range that an earlier place holds: of all places,
in any document, the first by (document id, digest of the text, line) counts as the original. So every distinct line stays
at its first place, and overlapping ranges never take both copies of one.

The places of all ranges, without text, are written once. A digest's places are counted with its first one; digests with so many
places that there are fewer than HOT of them at any size are joined by broadcast, the others by a shuffle in which no
digest has more than a share of 1 / HOT of the rows. Only the ranges of repeated digests are cut out of their texts
and compared byte by byte, as smallest and largest text of a digest, inside tasks first; digests with different texts are left in
place. Everything is DataFrame functions.

Defined cases: a null text stays null and has no lines; an empty text is one empty line; a text whose
lines are all repetitions becomes empty; rows that agree in id and text are one place and share its fate; rows
without id come first; further columns are carried, whatever their names, except those named like the outputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import materialise
from .columns import column, free, without
from .quality_rules import let

LONG_LINE = 50  # words of a line that is a chunk of its own, and of a run
LEAST_LINES = 2  # lines of a chunk of shorter lines
NEAR = 8  # lines that a run is sought in first; with a word each, LONG_LINE lines always hold it
HOT = 100_000  # digests that are broadcast, at most
WORD = r"[^\x20\x09-\x0D]+"
EVEN = ("0", "2", "4", "6", "8", "a", "c", "e")
RANGES = "array<struct<start:int,size:int>>"


def _chunks(parts: Column) -> Column:
    """The ranges (start, size) of content-defined chunks."""
    digests, words = parts["digests"], parts["words"]
    count = F.size(digests)

    def long(i):
        return words[i] >= LONG_LINE

    def ends_after(i):  # i lines lie before the cut
        before = F.when(i >= 2, digests[F.greatest(i - 2, F.lit(0))]).otherwise(F.lit(""))
        rolling = F.md5(F.concat(before, digests[i - 1]).cast("binary"))
        return (i == count) | long(i - 1) | long(F.least(i, count - 1)) | F.substring(rolling, 32, 1).isin(*EVEN)

    cuts = F.filter(F.sequence(F.lit(1), count), ends_after)

    def ranges(c):
        def one(end, k):
            start = F.when(k == 0, 0).otherwise(c[F.greatest(k - 1, F.lit(0))])
            return F.struct(start.alias("start"), (end - start).alias("size"))

        return F.transform(c, one)

    def worth(r):
        return long(r["start"]) | ((r["size"] >= LEAST_LINES) & F.exists(F.slice(words, r["start"] + 1, r["size"]), lambda w: w > 0))

    return F.filter(let(cuts, ranges), worth)


def _runs(parts: Column) -> Column:
    """The ranges (start, size) of the shortest runs with LONG_LINE words from each line with words, onwards and backwards."""
    words = parts["words"]
    filled = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: words[i] > 0)

    def of(places):
        count = F.size(places)

        def reach(near, far):
            """How many places from the first one hold the words; 0 if all do not."""

            def fold(some):
                def add(a, i):
                    return F.when(a["w"] >= LONG_LINE, a).otherwise(F.struct((a["n"] + 1).alias("n"), (a["w"] + words[i]).alias("w")))

                return F.aggregate(some, F.struct(F.lit(0).alias("n"), F.lit(0).alias("w")), add)

            def found(a):
                return F.when(a["w"] >= LONG_LINE, a["n"]).otherwise(0)

            return let(fold(near), lambda a: F.when(a["w"] >= LONG_LINE, a["n"]).otherwise(let(fold(far), found)))

        def onwards(k):  # k counts from 1
            n = reach(F.slice(places, k, F.lit(NEAR)), F.slice(places, k, F.lit(LONG_LINE)))
            return let(n, lambda n: F.when(n > 0, _range(places[k - 1], places[k + n - 2])))

        def backwards(k):
            def last(size):
                return F.reverse(F.slice(places, F.greatest(k - size + 1, F.lit(1)), F.least(F.lit(size), k)))

            n = reach(last(NEAR), last(LONG_LINE))
            return let(n, lambda n: F.when(n > 0, _range(places[k - n], places[k - 1])))

        every = F.sequence(F.lit(1), count)
        both = F.concat(F.transform(every, onwards), F.transform(every, backwards))
        return F.when(count > 0, F.filter(both, lambda r: r.isNotNull())).otherwise(F.array().cast(RANGES))

    return let(filled, of)


def _range(first: Column, last: Column) -> Column:
    return F.struct(first.alias("start"), (last - first + 1).alias("size"))


def name_of(digests: Column) -> Column:
    """The number that names a range by its lines' digests, joined."""
    return F.xxhash64(digests)


def _digested(parts: Column) -> Column:
    """Every range once, with its digest."""

    def digest(r):
        joined = F.array_join(F.slice(parts["digests"], r["start"] + 1, r["size"]), "")
        return F.struct(r["start"].alias("start"), r["size"].alias("size"), name_of(joined).alias("digest"))

    return F.transform(F.array_distinct(F.concat(_chunks(parts), _runs(parts))), digest)


def _tie(text: Column) -> Column:
    """The first 60 bits of a text's digest as a number, in the order of the digests."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def places(docs: DataFrame) -> DataFrame:
    """(id, tie, start, size, digest) of all ranges in docs (id, text)."""
    lines = F.split("text", "\n")
    parts = F.struct(
        F.transform(lines, lambda line: F.md5(line.cast("binary"))).alias("digests"),
        F.transform(lines, lambda line: F.regexp_count(line, F.lit(WORD))).alias("words"),
    )
    rows = docs.where("text is not null").select("id", _tie(F.col("text")).alias("tie"), F.explode(let(parts, _digested)).alias("c"))
    return rows.select("id", "tie", "c.*")


def _of_repeated(found: DataFrame, hot: int) -> DataFrame:
    """The places whose digest has several, with ``original``: whether it is the first one.

    Rows that agree in id and text are one place.
    """
    place = F.struct("id", "tie", "start")
    counted = found.groupBy("digest").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    repeated = materialise(counted, "line-digests")
    limit = found.count() // hot
    parts = [found.join(F.broadcast(repeated.where(F.col("n") > limit)), "digest"), found.join(repeated.where(F.col("n") <= limit), "digest")]
    several = parts[0].unionByName(parts[1])
    return several.withColumn("original", place.eqNullSafe(F.col("first"))).drop("first", "n")


def repeated_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", hot: int = HOT) -> DataFrame:
    """(id, tie, removed): per document with repetitions the ranges (start, size) of lines to remove."""
    chosen = docs.select(column(doc_id).alias("id"), column(text).alias("text"))
    several = materialise(_of_repeated(materialise(places(chosen), "line-places"), hot), "repeated-places")
    held = several.groupBy(F.col("id").alias("of"), F.col("tie").alias("mark")).agg(F.collect_set(F.struct("start", "size", "digest")).alias("ranges"))
    # the texts of repeated ranges, byte by byte
    texts = chosen.withColumn("tie", _tie(F.col("text"))).join(held, F.col("id").eqNullSafe(F.col("of")) & (F.col("tie") == F.col("mark")))
    lines = F.split("text", "\n")
    cut = F.explode(
        let(lines, lambda x: F.transform("ranges", lambda r: F.struct(r["digest"].alias("digest"), F.array_join(F.slice(x, r["start"] + 1, r["size"]), "\n").alias("range"))))
    )
    compared = texts.select(cut.alias("r")).groupBy("r.digest").agg(F.min("r.range").alias("low"), F.max("r.range").alias("high"))
    differing = materialise(compared.where("low <> high").select("digest"), "differing-digests")
    again = several.where("not original")
    if not differing.isEmpty():  # two texts of one digest, as good as never
        again = again.join(differing, "digest", "left_anti")
    return again.groupBy("id", "tie").agg(F.collect_set(F.struct("start", "size")).alias("removed"))


def deduplicated(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lines_as: str = "n_lines", removed_as: str = "n_removed", hot: int = HOT
) -> DataFrame:
    """``docs`` with repeated lines cut out of ``text``, and the counts of its lines and of those removed."""
    tie, of, mark, gone, left = (free(docs, n) for n in ("__tie", "__of", "__mark", "__removed", "__left"))
    ranges = repeated_lines(docs, text, doc_id, hot).select(F.col("id").alias(of), F.col("tie").alias(mark), F.col("removed").alias(gone))
    joined = docs.withColumn(tie, _tie(column(text))).join(ranges, column(doc_id).eqNullSafe(F.col(of)) & (F.col(tie) == F.col(mark)), "left")
    lines = F.split(column(text), "\n")
    removed = F.flatten(F.transform(gone, lambda r: F.sequence(r["start"], r["start"] + r["size"] - 1)))
    # the places of the lines that stay, in order
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed)
    marked = joined.withColumn(left, F.when(F.col(gone).isNotNull(), stay))
    kept = let(F.struct(lines.alias("l"), F.col(left).alias("k")), lambda x: F.array_join(F.transform(x["k"], lambda i: x["l"][i]), "\n"))
    count = F.when(column(text).isNull(), 0).otherwise(F.size(lines)).cast("bigint")
    carried = without(docs, [lines_as, removed_as])
    return marked.select(
        *[F.when(F.col(left).isNull(), column(text)).otherwise(kept).alias(c) if c == text else column(c) for c in carried],
        count.alias(lines_as),
        F.when(F.col(left).isNull(), 0).otherwise(count - F.size(left)).cast("bigint").alias(removed_as),
    )
