import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from warpwise.operators import normalize, windows as win
from warpwise.sources import store, wide_csv
from warpwise.sources.long_table import number_points, points_from_long, segments_from_long
from warpwise.sources.segments import cut_segments, points_of_segments, with_values

import naive

HEADER = "subject,event,channel,from,to,v1,v2,v3,\n"
LINES = {
    "plain": "a,b,c,1,2,1.5,2.5,3.5,\n",
    "padded": "a,x y,c  d,1,3,1,2,3,0,0,0,\n",
    "empty_cells": "a,b,c,1,4,7,8,9,,,\n",
    "all_zero": "a,b,c,1,5,0,0,0,\n",
    "float_zero": "a,b,c,1,6,1,2,0.0,\n",
}


def write(tmp_path, text, name="w.csv"):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def collect(frame):
    return sorted((r["series_id"], list(r["values"])) for r in frame.collect())


def test_wide_csv(spark, tmp_path):
    lines = [LINES[k] for k in ("plain", "padded", "empty_cells", "float_zero")]
    got = collect(wide_csv.read_wide_csv(spark, write(tmp_path, HEADER + "".join(lines))))
    assert got == sorted(
        [
            ("(a)_(b)_(c)_(1)_(2)", [1.5, 2.5]),
            ("(a)_(x-y)_(c-d)_(1)_(3)", [1.0, 2.0]),
            ("(a)_(b)_(c)_(1)_(4)", [7.0, 8.0]),
            ("(a)_(b)_(c)_(1)_(6)", [1.0, 2.0]),
        ]
    )
    path = write(tmp_path, HEADER + "".join(LINES.values()), "all.csv")
    exact = dict(collect(wide_csv.read_wide_csv(spark, path, trim="exact")))
    assert exact["(a)_(x-y)_(c-d)_(1)_(3)"] == [1.0, 2.0, 3.0]
    assert exact["(a)_(b)_(c)_(1)_(5)"] == []


@pytest.mark.parametrize(
    "line,values",
    [
        (LINES["plain"], [1.5, 2.5]),
        (LINES["padded"], [1.0, 2.0]),
        (LINES["empty_cells"], [7.0, 8.0]),
        (LINES["float_zero"], [1.0, 2.0]),
    ],
)
def test_wide_csv_line(spark, tmp_path, line, values):
    path = write(tmp_path, HEADER + line)
    assert [v for _, v in collect(wide_csv.read_wide_csv(spark, path))] == [values]


def test_wide_csv_rejects(spark, tmp_path):
    # in reference mode the all-zero line loses its last label cell
    bad = "a,b,c,1,2,1.5,oops,3.5,\n\n" + LINES["all_zero"]
    path = write(tmp_path, HEADER + LINES["plain"] + bad)
    with pytest.raises(PySparkException):
        wide_csv.read_wide_csv(spark, path).collect()
    good, rejected = wide_csv.read_wide_csv_lenient(spark, path)
    assert len(collect(good)) == 1
    assert sorted(r["reason"] for r in rejected.collect()) == ["feature cells missing", "label cells missing", "not a number"]


def test_trim_and_clean(spark):
    cells = spark.createDataFrame([(["1", "2", "0", ""],), (["0", "0"],), ([",", "5"],)], "c array<string>")
    assert [r[0] for r in cells.select(wide_csv.trim_padding(F.col("c"))).collect()] == [["1"], ["0"], [","]]
    assert [r[0] for r in cells.select(wide_csv.trim_padding(F.col("c"), "exact")).collect()] == [["1", "2"], [], [",", "5"]]
    cleaned = spark.createDataFrame([([" a ", "", " ", "b"],)], "c array<string>").select(wide_csv.clean_cells(F.col("c")))
    assert cleaned.first()[0] == ["a", None, None, "b"]


def test_keyed_csv_last_row_wins(spark, tmp_path):
    path = write(tmp_path, "f1,f2,v,\na,1,9,5,6,7,\na,1,9,8,9,7,\nb,2,9,1,2,\n")
    got = collect(wide_csv.read_keyed_csv(spark, path, [0, 1, 2]))
    # the header has three cells, so its own row keeps two of them and no values
    assert got == [("(a)_(1)", ["8", "9"]), ("(b)_(2)", ["1"]), ("(f1)_(f2)", [])]


def test_extract_rows(spark, tmp_path):
    path = write(tmp_path, "a,b\n" + "".join(f"{i},{i * i}\n" for i in range(30)))
    part = wide_csv.extract_rows(spark, path, 5, str(tmp_path / "out"))
    assert sorted(tuple(r) for r in part.collect()) == [(str(i), str(i * i)) for i in range(5)]


def test_extract_rows_of_many_splits(spark, tmp_path):
    """Several files of several splits each; the prefix ends inside one of them."""
    folder = tmp_path / "many"
    folder.mkdir()
    for f in range(5):
        (folder / f"f{f}.csv").write_text("a,b\n" + "".join(f"{f * 1000 + i},{'x' * 30}\n" for i in range(1000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        for n in (0, 1, 999, 1000, 1001, 2345, 5000, 9999):
            part = wide_csv.extract_rows(spark, str(folder), n)
            assert sorted(int(r["a"]) for r in part.collect()) == list(range(min(n, 5000)))
        written = wide_csv.extract_rows(spark, str(folder), 2345, str(tmp_path / "out"))
        assert written.count() == 2345 and written.columns == ["a", "b"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def long_table(spark):
    data = [("x", i // 3, i, float(i)) for i in range(40)] + [("y", 0, 5, 2.0), ("y", 0, 1, 1.0), ("z", 9, 9, 3.0)]
    return spark.createDataFrame(data, "id string, ts int, n int, v double").orderBy(F.rand(3))


@pytest.mark.parametrize("gather", [1000, 2, 1])
def test_long_table_any_size(spark, gather):
    """A series numbered over many ranges gives the same segments as one gathered whole."""
    table = long_table(spark)
    segments = segments_from_long(table, "id", ["ts", "n"], "v", 4, stride=8, gather_points=gather)
    points = sorted((r["series_id"], r["pos"], r["value"]) for r in points_of_segments(segments).collect())
    assert points == sorted([("x", i, float(i)) for i in range(40)] + [("y", 0, 1.0), ("y", 1, 2.0), ("z", 0, 3.0)])
    rows = {(r["series_id"], r["seg_start"]): (r["own"], r["values"]) for r in segments.collect()}
    assert rows[("x", 8)] == (8, [float(i) for i in range(8, 20)])
    assert rows[("x", 32)] == (8, [float(i) for i in range(32, 40)])
    assert rows[("y", 0)] == (2, [1.0, 2.0])


def test_number_points_over_ranges(spark):
    rows = long_table(spark).select(F.col("id").alias("series_id"), F.col("ts").alias("o0"), F.col("n").alias("o1"), F.col("v").alias("value"))
    got = number_points(rows, ["o0", "o1"], partitions=7).collect()
    assert sorted((r["series_id"], r["pos"]) for r in got if r["series_id"] == "x") == [("x", i) for i in range(40)]
    assert all(r["pos"] == r["value"] for r in got if r["series_id"] == "x")


def test_missing_value_raises(spark):
    table = spark.createDataFrame([("a", 1, None)], "id string, n int, v double")
    with pytest.raises(PySparkException):
        points_from_long(table, "id", ["n"], "v").collect()


def three(spark):
    data = [("id1", [1.0, 2.0, 3.0, 4.0, 5.0]), ("id2", [5.0, 4.0, 3.0, 2.0, 1.0]), ("id3", [6.0, 7.0, 8.0, 9.0, 0.0, 3.0])]
    return spark.createDataFrame(data, "series_id string, values array<double>")


def test_bounds_and_scaling(spark):
    series = three(spark)
    assert tuple(normalize.global_bounds(series).first()) == (0.0, 9.0)
    own = dict(collect(normalize.normalise(series)))
    assert own["id1"] == [x / 9 for x in (1, 2, 3, 4, 5)]
    given = dict(collect(normalize.normalise(series, 1.0, 5.0)))
    assert given["id1"] == [0.0, 0.25, 0.5, 0.75, 1.0]
    flat = spark.createDataFrame([("a", [2.0, 2.0])], "series_id string, values array<double>")
    with pytest.raises(PySparkException):
        normalize.normalise(flat).collect()


@pytest.mark.parametrize("stride", [2, 1024])
@pytest.mark.parametrize("last", [False, True])
def test_windows(spark, stride, last):
    series = {r["series_id"]: list(r["values"]) for r in three(spark).collect()}
    segments = cut_segments(three(spark), 6, stride)
    want = sorted((n, s, a, a + n) for n, s, a, _ in naive.windows(series, 2, 6, last))
    got = sorted(tuple(r) for r in win.windows(segments, 2, 6, last).select("length", "series_id", "start", "end").collect())
    assert got == want
    sizes = {r["length"]: r["windows"] for r in win.group_sizes(segments, 2, 6, last).collect()}
    assert sizes == {n: sum(w[0] == n for w in want) for n in {w[0] for w in want}}
    members = win.grouped_windows(segments, 2, 6, last).select("length", F.explode("members").alias("m"))
    assert sorted(tuple(r) for r in members.select("length", "m.series_id", "m.start", "m.end").collect()) == want
    valued = with_values(win.windows(segments, 2, 6, last), segments).collect()
    assert all(list(r["values"]) == series[r["series_id"]][r["start"] : r["end"]] for r in valued)
    assert len(valued) == len(want)
    assert win.max_length(segments).first()[0] == 6


def test_published_window_counts(spark):
    """19 series of 352 points: 19 * (352 - L) windows of length L, 1,173,744 in total."""
    series = spark.range(19).select(
        F.col("id").cast("string").alias("series_id"), F.transform(F.sequence(F.lit(1), F.lit(352)), lambda x: x.cast("double")).alias("values")
    )
    sizes = {r["length"]: r["windows"] for r in win.group_sizes(cut_segments(series, 352), 1, 352).collect()}
    assert sizes == {n: 19 * (352 - n) for n in range(1, 352)}
    assert sum(sizes.values()) == 1_173_744


def test_fixed_windows(spark):
    data = [float(x) for x in (1, 3, 4, 5, 6, 7, 8, 4, 5, 67, 5)]
    series = spark.createDataFrame([("s", data)], "series_id string, values array<double>")
    got = [list(r["values"]) for r in win.fixed_windows(cut_segments(series, 3), 3).orderBy("start").collect()]
    assert got == [data[i : i + 3] for i in range(9)]


@pytest.mark.parametrize("stride", [2, 1024])
def test_cut(spark, stride):
    specs = spark.createDataFrame([("a", "id2", 2, 4), ("b", "id3", 1, 99), ("c", "id1", 3, 3)], "query_id string, series_id string, start long, end long")
    segments = cut_segments(three(spark), 4, stride)
    got = {r["query_id"]: list(r["q"]) for r in win.cut(segments, specs).collect()}
    assert got == {"a": [3.0, 2.0], "b": [7.0, 8.0, 9.0, 0.0, 3.0], "c": []}
    with pytest.raises(PySparkException):
        win.cut(segments, specs.withColumn("series_id", F.lit("nope"))).collect()


def test_length_check(spark):
    rows = spark.createDataFrame([(3, "a", 0, 3), (3, "a", 1, 5)], "length int, series_id string, start long, end long")
    with pytest.raises(PySparkException):
        win.check_lengths(rows).collect()
    with pytest.raises(ValueError):
        win.windows(cut_segments(three(spark), 3), 0, 3)


def test_store(spark, tmp_path):
    segments = cut_segments(three(spark), 4)
    windows = win.windows(segments, 2, 4)
    path = str(tmp_path / "data")
    store.save_dataset(path, segments, windows)
    with pytest.raises(Exception):
        store.save_dataset(path, segments)
    loaded = store.load_dataset(spark, path)
    assert set(loaded) == {"series", "windows"}
    some = loaded["windows"].where("length between 3 and 4")
    assert "PartitionFilters: [isnotnull(length" in some._jdf.queryExecution().toString()
    assert some.count() == windows.where("length >= 3").count()
    with pytest.raises(store.DuplicateIdError) as error:
        store.replace_series(three(spark), three(spark).where("series_id > 'id1'"))
    assert sorted(r[0] for r in error.value.ids.collect()) == ["id2", "id3"]
    assert store.repeated_ids(three(spark).union(three(spark).limit(1))).count() == 1
    status = store.series_status(segments, windows.where("series_id < 'id3'"), windows.where("series_id = 'id1'"))
    assert dict(status.collect()) == {"id1": "clustered", "id2": "grouped", "id3": "loaded"}
    assert collect(store.from_map(store.to_map(three(spark)))) == collect(three(spark))


def test_ranges_grow_with_cores_and_points_alone(spark, monkeypatch):
    """A small limit for gathering made one range for each so many points, and the driver hears of each pair of ranges."""
    from warpwise.sources import long_table

    asked = []

    def noted(rows, order, partitions=None):
        asked.append(partitions)
        return number_points(rows, order, partitions)

    monkeypatch.setattr(long_table, "number_points", noted)
    table = spark.range(400).selectExpr("'a' id", "id ts", "cast(id as double) v")
    points = sorted(tuple(r) for r in points_of_segments(segments_from_long(table, "id", ["ts"], "v", 4, stride=8, gather_points=1)).collect())
    assert points == [("a", i, float(i)) for i in range(400)]
    assert 1 < asked[0] <= 4 * spark.sparkContext.defaultParallelism
    assert long_table.ranges_for(216_000_000, 5_000, 12) == 216
