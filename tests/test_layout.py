"""No window is lost: layout of segments, values that are not finite, ties, headers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from warpwise.operators import exact, search, windows as win
from warpwise.operators.cluster import leader_clusters, two_pass_clusters
from warpwise.operators.normalize import normalise
from warpwise.runtime import materialise
from warpwise.sources.long_table import segments_from_long
from warpwise.sources.segments import cut_segments, layout, points_of_segments, segments_of_points, with_values
from warpwise.sources.store import from_map, to_map
from warpwise.sources.wide_csv import extract_rows, read_wide_csv


def frame(spark, series):
    return spark.createDataFrame(list(series.items()), "series_id string, values array<double>")


def wave(n, seed=1):
    rng = random.Random(seed)
    return [round(math.sin(i / 7) + rng.random(), 3) for i in range(n)]


def by_points(spark, series, most, stride=1024):
    rows = [(s, i, v) for s, values in series.items() for i, v in enumerate(values)]
    return segments_of_points(spark.createDataFrame(rows, "series_id string, pos long, value double"), most, stride)


@pytest.mark.parametrize("make", [lambda spark, s, most: cut_segments(frame(spark, s), most), by_points])
def test_windows_longer_than_the_tail_raise(spark, make):
    parts = make(spark, {"a": wave(3000)}, 8)
    assert win.windows(parts, 8, 8).count() == 2992 and win.windows(parts, 8, 8, True).count() == 2993
    for job in (
        lambda: win.windows(parts, 16, 16).count(),
        lambda: win.group_sizes(parts, 9, 9).count(),
        lambda: leader_clusters(parts, 16, 16, 0.5).count(),
        lambda: exact.best_match(spark.createDataFrame([("q", [0.5] * 12)], "query_id string, q array<double>"), parts).collect(),
    ):
        with pytest.raises(Exception, match="fit segments cut for 8"):
            job()
    wide = make(spark, {"a": wave(3000)}, 16)
    assert win.windows(wide, 16, 16).count() == 2984
    assert win.group_sizes(wide, 16, 16).first()["windows"] == 2984


@pytest.mark.parametrize("size", [1, 10, 1032, 1033, 1024, 1025])
def test_whole_series_take_any_length(spark, size):
    """A series whose values all lie in its segments gives its long windows, whatever the tail."""
    for parts in (cut_segments(frame(spark, {"a": wave(size)}), 8), by_points(spark, {"a": wave(size)}, 8)):
        whole = {r["seg_start"]: r["whole"] for r in parts.collect()}
        assert whole[0] == (size <= 1032) and all(whole[s] for s in whole if s)
        if size <= 1024:
            assert win.windows(parts, size, size, True).count() == 1


def test_query_over_a_segment_edge(spark):
    values = wave(3000)
    parts = cut_segments(frame(spark, {"a": values}), 20)
    specs = search.query_specs(spark, [("q1", "a", 1015, 1035), ("q2", "a", 2040, 2060), ("q3", "a", 2980, 3000)])
    found = exact.best_match(win.cut(parts, specs), parts).orderBy("query_id").collect()
    assert [(r["start"], r["distance"]) for r in found] == [(1015, 0.0), (2040, 0.0), (2980, 0.0)]


def test_layout_travels(spark):
    parts = cut_segments(frame(spark, {"a": wave(60), "b": wave(3)}), 5, stride=16)
    for kept in (parts, materialise(parts, "kept"), normalise(parts), materialise(normalise(parts), "kept")):
        assert layout(kept) == (16, 5)
    rows = win.windows(parts, 5, 5)
    assert {r["series_id"]: 0 for r in with_values(rows, parts).collect() if len(r["values"]) != 5} == {}
    with pytest.raises(ValueError, match="not segments"):
        win.windows(spark.createDataFrame([("a", 0, 1, [1.0])], "series_id string, seg_start long, own int, values array<double>"), 1, 1)
    beyond = spark.createDataFrame([("a", 14, 30)], "series_id string, start long, length int")
    with pytest.raises(Exception, match="no such window"):
        with_values(beyond, parts).collect()


@pytest.mark.parametrize("metric", ["eu", "ma", "mi", "dtw", "two"])
@pytest.mark.parametrize("bad", [float("nan"), float("inf"), -float("inf")])
def test_values_that_are_not_finite_lose_no_window(spark, metric, bad):
    series = {f"s{i}": wave(30, i) for i in range(8)}
    clean = cut_segments(frame(spark, series), 5)
    spoilt = {k: list(v) for k, v in series.items()}
    spoilt["s3"][11] = bad
    parts = cut_segments(frame(spark, spoilt), 5)

    def cluster(segments):
        if metric == "two":
            return two_pass_clusters(segments, 4, 5, 0.6, 3).collect()
        return leader_clusters(segments, 4, 5, 0.6, 3, metric).collect()

    rows = cluster(parts)
    assert len(rows) == win.windows(parts, 4, 5).count() == len(cluster(clean))
    hit = [r for r in rows if r["series_id"] == "s3" and r["start"] <= 11 < r["end"]]
    assert len(hit) == 9 and all(r["is_rep"] and r["rep_dist"] == 0 for r in hit)
    own = {(r["length"], r["cluster_id"]) for r in hit}
    assert len(own) == 9 and not [r for r in rows if (r["length"], r["cluster_id"]) in own and r not in hit]
    # the other windows are grouped as if the spoilt ones were not there
    names = {(r["length"], r["cluster_id"]) for r in rows if r["is_rep"]}
    assert {(r["length"], r["cluster_id"]) for r in rows} <= names | {(5, c) for _, c in names}


def test_exact_search_passes_over_values_that_are_not_finite(spark):
    values = wave(50)
    values[10] = float("nan")
    parts = cut_segments(frame(spark, {"a": values, "b": [float("nan")] * 6}), 5)
    asked = spark.createDataFrame([("q", values[20:25])], "query_id string, q array<double>")
    assert exact.best_match(asked, parts).first()["start"] == 20
    assert exact.best_per_series(asked, parts).count() == 1
    with pytest.raises(Exception, match="not finite"):
        exact.best_match(spark.createDataFrame([("q", values[8:13])], "query_id string, q array<double>"), parts).collect()


@pytest.mark.parametrize("gather", [10, 50_000])
def test_ties_take_one_order(spark, gather):
    """Equal order keys go by value on both paths; one series holds a third of all points."""
    rng = random.Random(5)
    rows = [("big", i // 4, float(rng.randrange(9))) for i in range(60)]
    rows += [(f"s{i % 20}", rng.randrange(3), float(rng.randrange(9))) for i in range(120)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "id string, ts long, v double").repartition(5)
    points = points_of_segments(segments_from_long(table, "id", ["ts"], "v", 4, stride=8, gather_points=gather)).collect()
    got = sorted((r["series_id"], r["pos"], r["value"]) for r in points)
    expected = []
    for name in sorted({r[0] for r in rows}):
        expected += [(name, i, v) for i, (_, v) in enumerate(sorted((t, v) for n, t, v in rows if n == name))]
    assert got == sorted(expected)


def test_header_is_the_first_line_of_each_file(spark, tmp_path):
    head = "a,b,v,"
    (tmp_path / "1.csv").write_text(f"{head}\nx,y,1,2,3,\n{head.replace('v', '5')}\n" + "".join(f"n{i},y,{i + 1},7,\n" for i in range(500)))
    (tmp_path / "2.csv").write_text("other,header,v,\nx,z,4,5,\n")
    (tmp_path / "3.csv").write_text("1,2,3,4,\n1,2,3,4,\n")
    rows = read_wide_csv(spark, str(tmp_path), [0, 1], trim="exact").collect()
    got = {r["series_id"]: list(r["values"]) for r in rows}
    assert len(rows) == 504 and got["(x)_(y)"] == [1, 2, 3] and got["(x)_(z)"] == [4, 5]
    assert got["(1)_(2)"] == [3, 4] and got["(a)_(b)"] == [5]


def test_extract_goes_by_file_name(spark, tmp_path):
    for name, rows in (("b.csv", range(10, 300)), ("a.csv", range(10))):
        (tmp_path / name).write_text("k\n" + "".join(f"{i}\n" for i in rows))
    assert [int(r["k"]) for r in extract_rows(spark, str(tmp_path), 25).collect()] == list(range(25))


def test_maps_hold_several_series(spark):
    series = frame(spark, {f"s{i}": [float(i)] * (i % 4) for i in range(60)})
    maps = to_map(series, 20)
    assert 1 < maps.count() <= 3
    assert from_map(maps).exceptAll(series).count() == 0 and from_map(maps).count() == 60
    with pytest.raises(Exception, match="uplicate"):
        to_map(series.unionByName(series)).collect()


def test_hits_name_their_cluster(spark):
    parts = cut_segments(frame(spark, {f"s{i}": wave(30, i) for i in range(6)}), 6)
    from warpwise.plans.explore import similarity_search

    clusters = materialise(leader_clusters(parts, 5, 6, 0.8, 1), "clusters", ["length"])
    asked = materialise(win.cut(parts, search.query_specs(spark, [("q", "s1", 3, 9)])), "queries")
    hits = similarity_search(asked, clusters, parts, 5, 6, 3, exclude_overlap=True, percentage=0.5)
    members = clusters.select("length", "cluster_id", "series_id", "start")
    assert hits.count() and hits.join(members, ["length", "cluster_id", "series_id", "start"]).count() == hits.count()
    assert hits.where(F.col("cluster_id").isNull()).count() == 0


def test_stored_runs_are_small(spark, tmp_path):
    """Windows saved as runs come back whole, and their rows do not grow with the windows."""
    from warpwise.operators import windows as win
    from warpwise.sources import store
    from warpwise.sources.segments import cut_segments

    series = spark.createDataFrame([(f"s{i}", [float(j) for j in range(900 + i)]) for i in range(6)], "series_id string, values array<double>")
    segments = cut_segments(series, 40, stride=256)
    runs, rows = win.window_runs(segments, 5, 40), win.windows(segments, 5, 40)
    store.save_dataset(str(tmp_path / "runs"), windows=runs)
    store.save_dataset(str(tmp_path / "rows"), windows=rows)
    loaded = store.load_dataset(spark, str(tmp_path / "runs"))["windows"]
    names = ["length", "series_id", "start", "end"]
    assert sorted(map(tuple, loaded.select(*names).collect())) == sorted(map(tuple, rows.select(*names).collect()))
    assert runs.count() <= segments.count() * 36 < rows.count() / 100

    def size(path):
        return sum(f.stat().st_size for f in path.rglob("*.parquet"))

    assert size(tmp_path / "runs") < size(tmp_path / "rows") / 2
