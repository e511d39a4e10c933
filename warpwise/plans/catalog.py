"""The registered queries: every operator over the whole given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.distance import euclid, manhattan, minkowski, similarity_radius
from ..functions.warping import dtw, warping_path
from ..operators import cluster, exact, index, normalize, reports, search, windows as win
from ..runtime import materialise, new_path
from ..sources import store, wide_csv
from ..sources.long_table import segments_from_long
from ..sources.segments import cut_segments, points_of_segments, with_values
from .explore import group_and_cluster

# Parameters of the registered queries.
SEED = 42
SHORTEST, LONGEST = 8, 10
ST = 0.3
K_BEST = 5
OVERLAP = 0.5
TAIL = 64  # longest window any registered query cuts from events
QUERIES = [("q1", "1", 5, 15), ("q2", "3", 10, 19), ("q3", "7", 20, 28)]
EXACT_LENGTH = 20
LONG_WINDOW = 40
LONG_GATHER = 5_000  # series of more points are numbered in ranges

_made: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _once(spark: SparkSession, sf_dir: str, what: str, make):
    """A stored artefact is made once per session and data set and then reused."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir, what)
    if key not in _made:
        # the session is kept too, so that its id stays its own
        _made[key] = (spark, make())
    return _made[key][1]


def raw_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make():
        events = table(spark, sf_dir, "events")
        return materialise(segments_from_long(events, "user_id", ["ts", "event_id"], "value", TAIL), "series")

    return _once(spark, sf_dir, "raw", make)


def scaled_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(
        spark, sf_dir, "scaled", lambda: materialise(normalize.normalise(raw_segments(spark, sf_dir)), "scaled")
    )


def stored_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(
        spark,
        sf_dir,
        "clusters",
        lambda: materialise(leader_clusters(spark, sf_dir), "clusters", partition_by=["length"]),
    )


def stored_index(spark: SparkSession, sf_dir: str) -> index.Index:
    def make():
        path = new_path(spark, "index")
        index.write_index(path, stored_clusters(spark, sf_dir), raw_segments(spark, sf_dir))
        return index.open_index(spark, path)

    return _once(spark, sf_dir, "index", make)


def cut_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(
        spark,
        sf_dir,
        "queries",
        lambda: materialise(win.cut(raw_segments(spark, sf_dir), search.query_specs(spark, QUERIES)), "queries"),
    )


def _rounded(column, name):
    return F.round(column, 6).alias(name)


def _cluster_rows(frame: DataFrame) -> DataFrame:
    return frame.select("length", "cluster_id", "series_id", "start", "end", "is_rep", _rounded("rep_dist", "rep_dist"))


# --- sources and preparation -------------------------------------------------------------------


def series_from_events(spark, sf_dir):
    return points_of_segments(raw_segments(spark, sf_dir))


def _wide_file(spark, sf_dir) -> str:
    """The events series as a wide CSV file: five label cells, the values, zero padding."""

    def make():
        events = table(spark, sf_dir, "events")
        cells = F.array_sort(F.collect_list(F.struct("ts", "event_id", "value")))
        series = events.groupBy("user_id").agg(F.transform(cells, lambda c: c["value"].cast("string")).alias("v"))
        line = F.concat_ws(
            ",", F.col("user_id").cast("string"), F.lit("back 0,ch  A,0"), F.size("v").cast("string"), "v", F.lit("0,0,")
        )
        path = new_path(spark, "wide")
        header = "subject,event,channel,from,to,values,"
        series.select(line.alias(header)).write.csv(path, header=True, sep="\u0001", quote="")
        return path

    return _once(spark, sf_dir, "wide", make)


def _exploded(series: DataFrame) -> DataFrame:
    return series.select("series_id", F.posexplode("values").alias("pos", "value"))


def csv_source(spark, sf_dir):
    return _exploded(wide_csv.read_wide_csv(spark, _wide_file(spark, sf_dir)))


def csv_source_exact_trim(spark, sf_dir):
    return _exploded(wide_csv.read_wide_csv(spark, _wide_file(spark, sf_dir), trim="exact"))


def keyed_source(spark, sf_dir):
    return _exploded(wide_csv.read_keyed_csv(spark, _wide_file(spark, sf_dir), [0, 1, 2]))


def row_extract(spark, sf_dir):
    """A row-limited extract of the supplier table written as CSV; the limit is the operator."""

    def make():
        path = new_path(spark, "suppliers")
        table(spark, sf_dir, "supplier").orderBy("s_suppkey").select("s_suppkey", "s_name").write.csv(path, header=True)
        return path

    source = _once(spark, sf_dir, "suppliers", make)
    part = wide_csv.extract_rows(spark, source, 50, new_path(spark, "extract"))
    return part.select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name")


def duplicate_ids(spark, sf_dir):
    """Ids of the events series that the per-customer order series would bring again."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("series_id"))
    return store.duplicate_ids(orders, raw_segments(spark, sf_dir).where("seg_start = 0"))


def repeated_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("series_id"))
    return store.repeated_ids(rows)


def series_status(spark, sf_dir):
    """Status when the lengths 60..64 are grouped and nothing is clustered."""
    series = raw_segments(spark, sf_dir)
    return store.series_status(series, win.lengths_of(series, 60, 64, False))


def save_reload(spark, sf_dir):
    path = new_path(spark, "dataset")
    series = scaled_segments(spark, sf_dir)
    store.save_dataset(path, series, win.window_runs(series, 20, 22))
    loaded = store.load_dataset(spark, path)["windows"]
    return search.in_length_range(loaded, 21, 22).select("length", "series_id", "start", "end")


def dict_views(spark, sf_dir):
    whole = wide_csv.read_wide_csv(spark, _wide_file(spark, sf_dir))
    return _exploded(store.from_map(store.to_map(whole)))


def cleaned_cells(spark, sf_dir):
    """Cells of the documents' source and language written as a blank-padded line."""
    docs = table(spark, sf_dir, "documents")
    line = F.concat(F.lit(" "), "source", F.lit(" , ,,"), "lang", F.lit(" "))
    cells = wide_csv.clean_cells(F.split(line, ",", -1))
    return docs.select("doc_id", F.posexplode(cells).alias("pos", "cell"))


# --- series longer than one segment ---------------------------------------------------------------


def _long_segments(spark, sf_dir):
    """All order lines as three series, by return flag: many segments each, numbered in ranges."""

    def make():
        lines = table(spark, sf_dir, "lineitem")
        order = ["l_shipdate", "l_orderkey", "l_linenumber"]
        return materialise(
            segments_from_long(lines, "l_returnflag", order, "l_quantity", LONG_WINDOW, gather_points=LONG_GATHER), "long-series"
        )

    return _once(spark, sf_dir, "long", make)


def long_series_windows(spark, sf_dir):
    """Sum and first value of every window of 40 points of the long series."""
    rows = win.fixed_windows(_long_segments(spark, sf_dir), LONG_WINDOW, include_last=False)
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return rows.select("series_id", "start", F.col("values")[0].alias("first"), total.alias("total"))


def long_series_best_match(spark, sf_dir):
    series = normalize.normalise(_long_segments(spark, sf_dir))
    found = exact.best_match(_foreign_queries(spark, sf_dir), series)
    return found.select("query_id", "series_id", "start", _rounded("distance", "distance"))


# --- bounds and scaling ------------------------------------------------------------------------


def global_minmax(spark, sf_dir):
    return normalize.global_bounds(raw_segments(spark, sf_dir))


def normalized_series(spark, sf_dir):
    scaled = points_of_segments(normalize.normalise(raw_segments(spark, sf_dir)))
    return scaled.select("series_id", "pos", _rounded("value", "norm"))


def normalized_given_bounds(spark, sf_dir):
    scaled = points_of_segments(normalize.normalise(raw_segments(spark, sf_dir), -100.0, 900.0))
    return scaled.select("series_id", "pos", _rounded("value", "norm"))


def max_length(spark, sf_dir):
    return win.max_length(raw_segments(spark, sf_dir))


# --- windows -----------------------------------------------------------------------------------


def windows_all_lengths(spark, sf_dir):
    """Every window of every length up to the longest series."""
    series = raw_segments(spark, sf_dir)
    longest = win.max_length(series).first()["max_length"]
    return win.windows(_tails(spark, sf_dir, longest), 1, longest)


def _tails(spark, sf_dir, longest):
    """Segments whose tails hold windows up to ``longest`` points."""
    if longest <= TAIL:
        return raw_segments(spark, sf_dir)
    return _once(
        spark,
        sf_dir,
        f"tail{longest}",
        lambda: materialise(
            segments_from_long(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", longest), "series"
        ),
    )


def group_sizes(spark, sf_dir):
    longest = win.max_length(raw_segments(spark, sf_dir)).first()["max_length"]
    return win.group_sizes(_tails(spark, sf_dir, longest), 1, longest)


def grouped_windows(spark, sf_dir):
    grouped = win.grouped_windows(raw_segments(spark, sf_dir), 30, 32)
    return grouped.select("length", F.explode("members").alias("m")).select("length", "m.series_id", "m.start", "m.end")


def length_validation(spark, sf_dir):
    rows = win.check_lengths(win.windows(raw_segments(spark, sf_dir), 40, 44))
    return rows.groupBy("length").agg(F.count(F.lit(1)).alias("checked"))


def window_slices(spark, sf_dir):
    """Values of the windows of 20 points, fetched by coordinates."""
    rows = win.windows(raw_segments(spark, sf_dir), 20, 20)
    valued = with_values(rows, raw_segments(spark, sf_dir))
    return valued.select("series_id", "start", F.posexplode("values").alias("pos", "value"))


def fixed_windows(spark, sf_dir):
    rows = win.fixed_windows(raw_segments(spark, sf_dir), 5)
    return rows.select("series_id", "start", F.posexplode("values").alias("pos", "value"))


def query_cut(spark, sf_dir):
    """Points 24..44 of every series, as queries."""
    series = raw_segments(spark, sf_dir)
    specs = series.where("seg_start = 0").select(
        F.concat(F.lit("q"), "series_id").alias("query_id"),
        "series_id",
        F.lit(24).cast("long").alias("start"),
        F.lit(44).cast("long").alias("end"),
    )
    return win.cut(series, specs).select("query_id", "source_series_id", F.posexplode("q").alias("pos", "value"))


# --- distances ---------------------------------------------------------------------------------


def _vectors(spark, sf_dir) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def _against_first(spark, sf_dir, distance, name):
    """Every vector against the vector with the smallest id."""
    vectors = _vectors(spark, sf_dir)
    first = vectors.agg(F.min_by("v", "vec_id").alias("q")).select("q").scalar()
    return vectors.withColumn("q", first).select("vec_id", _rounded(distance(F.col("v"), F.col("q")), name))


def pair_euclid(spark, sf_dir):
    return _against_first(spark, sf_dir, euclid, "dist")


def pair_manhattan(spark, sf_dir):
    return _against_first(spark, sf_dir, manhattan, "dist")


def pair_minkowski(spark, sf_dir):
    return _against_first(spark, sf_dir, lambda a, b: minkowski(a, b, 3.0), "dist")


def similarity_radii(spark, sf_dir):
    longest = win.max_length(raw_segments(spark, sf_dir)).first()["max_length"]
    sizes = win.group_sizes(_tails(spark, sf_dir, longest), 1, longest)
    return sizes.select("length", _rounded(similarity_radius(F.col("length"), ST), "radius"))


def _dtw_rows(spark, sf_dir):
    """Windows of 12 points of every series against one cut of 10 points."""
    series = raw_segments(spark, sf_dir)
    query = win.cut(series, search.query_specs(spark, QUERIES[:1])).select("q").scalar()
    return win.fixed_windows(series, 12, include_last=False).withColumn("q", query)


def dtw_scores(spark, sf_dir):
    return _dtw_rows(spark, sf_dir).select("series_id", "start", _rounded(dtw(F.col("values"), F.col("q")), "dist"))


def dtw_scores_squared(spark, sf_dir):
    score = dtw(F.col("values"), F.col("q"), "sq")
    return _dtw_rows(spark, sf_dir).select("series_id", "start", _rounded(score, "dist"))


# --- clusters ----------------------------------------------------------------------------------


def leader_clusters(spark, sf_dir):
    return cluster.leader_clusters(scaled_segments(spark, sf_dir), SHORTEST, LONGEST, ST, SEED)


def leader_clusters_rows(spark, sf_dir):
    return _cluster_rows(stored_clusters(spark, sf_dir))


def manhattan_clusters(spark, sf_dir):
    return _cluster_rows(cluster.leader_clusters(scaled_segments(spark, sf_dir), 6, 7, 1.0, SEED, "ma"))


def minkowski_clusters(spark, sf_dir):
    return _cluster_rows(cluster.leader_clusters(scaled_segments(spark, sf_dir), 6, 7, ST, SEED, "mi", 3.0))


def embedding_clusters(spark, sf_dir):
    """Ready-made windows: every embedding is one series of one full-length window."""
    series = cut_segments(_vectors(spark, sf_dir).select(F.col("vec_id").cast("string").alias("series_id"), F.col("v").alias("values")), 64)
    found = cluster.leader_clusters(materialise(series, "vectors"), 64, 64, 0.3, SEED, include_last=True)
    return _cluster_rows(found)


def two_pass_clusters(spark, sf_dir):
    return _cluster_rows(cluster.two_pass_clusters(scaled_segments(spark, sf_dir), SHORTEST, LONGEST, 0.2, SEED))


def dtw_clusters(spark, sf_dir):
    return _cluster_rows(cluster.leader_clusters(scaled_segments(spark, sf_dir), 3, 4, 0.3, SEED, "dtw"))


def dtw_clusters_five_lengths(spark, sf_dir):
    return _cluster_rows(cluster.leader_clusters(scaled_segments(spark, sf_dir), 3, 7, 0.3, SEED, "dtw"))


def cluster_counts(spark, sf_dir):
    return cluster.cluster_counts(stored_clusters(spark, sf_dir))


def group_cluster_job(spark, sf_dir):
    """Group and cluster in one call; windows and clusters per length."""
    grouped, clustered = group_and_cluster(raw_segments(spark, sf_dir), 5, 6, ST, SEED)
    sizes = grouped.groupBy("length").agg(F.count(F.lit(1)).alias("windows"))
    reps = clustered.groupBy("length").agg(
        F.count(F.lit(1)).alias("members"), F.sum(F.col("is_rep").cast("long")).alias("clusters")
    )
    return sizes.join(reps, "length")


# --- search ------------------------------------------------------------------------------------


def _nearest(spark, sf_dir, **options):
    return search.nearest_representatives(
        cut_queries(spark, sf_dir), stored_clusters(spark, sf_dir), raw_segments(spark, sf_dir), SHORTEST, LONGEST, **options
    )


def _dist_rows(frame: DataFrame) -> DataFrame:
    return frame.withColumn("dist", F.round("dist", 6))


def nearest_rep(spark, sf_dir):
    return _dist_rows(_nearest(spark, sf_dir))


def nearest_rep_other_series(spark, sf_dir):
    return _dist_rows(_nearest(spark, sf_dir, drop_same_id_reps=True))


def _search_parts(spark, sf_dir):
    near = materialise(_nearest(spark, sf_dir), "nearest")
    return cut_queries(spark, sf_dir), stored_clusters(spark, sf_dir), near, raw_segments(spark, sf_dir)


def scored_members(spark, sf_dir):
    """Every member of the chosen clusters with its distance."""
    return _dist_rows(search.scored_members(*_search_parts(spark, sf_dir)))


def ranked_members(spark, sf_dir):
    return _dist_rows(search.top_k(search.nearest_members(*_search_parts(spark, sf_dir), 100), 100))


def no_overlap_topk(spark, sf_dir):
    ranks = search.ranks_needed(20, OVERLAP, LONGEST)
    scored = search.nearest_members(*_search_parts(spark, sf_dir), ranks)
    return _dist_rows(search.top_k_without_overlap(scored, 20, OVERLAP, LONGEST))


def index_nearest_rep(spark, sf_dir):
    return _dist_rows(index.nearest_clusters(cut_queries(spark, sf_dir), stored_index(spark, sf_dir), SHORTEST, LONGEST))


def index_ranked_members(spark, sf_dir):
    """The 100 nearest members of the chosen clusters, in two stages whatever the size."""
    queries, stored = cut_queries(spark, sf_dir), stored_index(spark, sf_dir)
    near = index.nearest_clusters(queries, stored, SHORTEST, LONGEST, staged_rows=0)
    return _dist_rows(search.top_k(index.nearest_members(queries, stored, near, 100, staged_rows=0), 100))


def index_clusters(spark, sf_dir):
    """What the index keeps about each cluster."""
    reps = stored_index(spark, sf_dir).reps
    return reps.select("length", "cluster_id", "n_members", _rounded("least", "least"), _rounded("most", "most"), _rounded("mean", "mean"))


def search_results(spark, sf_dir):
    return index.indexed_search(
        cut_queries(spark, sf_dir),
        stored_index(spark, sf_dir),
        SHORTEST,
        LONGEST,
        K_BEST,
        exclude_overlap=True,
        percentage=OVERLAP,
    )


def similarity_search_rows(spark, sf_dir):
    return _dist_rows(search_results(spark, sf_dir))


def length_filter(spark, sf_dir):
    rows = search.in_length_range(stored_clusters(spark, sf_dir), 9, 10)
    return rows.select("length", "series_id", "start", "end")


def excluded_own_series(spark, sf_dir):
    """Members of the chosen clusters that are left when each query's own series is excluded."""
    queries, clusters, near, _ = _search_parts(spark, sf_dir)
    chosen = near.select("query_id", "length", "cluster_id").join(queries.select("query_id", "source_series_id"), "query_id")
    kept = search.exclude_same_id(clusters.join(chosen, ["length", "cluster_id"]))
    return kept.select("query_id", "length", "cluster_id", "series_id", "start", "end")


def overlap_fractions(spark, sf_dir):
    """Overlap of every cluster's representative with the members of its own series."""
    clusters = stored_clusters(spark, sf_dir)
    reps = clusters.where("is_rep").select(
        "length", "cluster_id", "series_id", F.col("start").alias("kept_start"), F.col("end").alias("kept_end")
    )
    pairs = clusters.join(reps, ["length", "cluster_id", "series_id"])
    fraction = search.overlap_fraction(F.col("kept_start"), F.col("kept_end"), F.col("start"), F.col("end"))
    return pairs.select("cluster_id", "series_id", "start", "end", _rounded(fraction, "overlap"))


# --- exact search ------------------------------------------------------------------------------


def _foreign_queries(spark, sf_dir):
    """Queries cut from scaled supplier series, so that no window matches them exactly."""

    def make():
        lines = table(spark, sf_dir, "lineitem")
        order = ["l_shipdate", "l_orderkey", "l_linenumber"]
        series = materialise(segments_from_long(lines, "l_suppkey", order, "l_quantity", EXACT_LENGTH), "suppliers")
        specs = search.query_specs(spark, [("s1", "1", 10, 30), ("s2", "5", 40, 60)])
        return materialise(win.cut(normalize.normalise(series), specs), "queries")

    return _once(spark, sf_dir, "foreign", make)


def best_match(spark, sf_dir):
    found = exact.best_match(_foreign_queries(spark, sf_dir), scaled_segments(spark, sf_dir))
    return found.select(
        "query_id", "series_id", "start", _rounded("distance", "distance"), F.posexplode("value").alias("pos", "value")
    ).withColumn("value", F.round("value", 6))


def best_match_path(spark, sf_dir):
    """Cells of the warping path of the best matches, in order."""
    found = exact.best_match(_foreign_queries(spark, sf_dir), scaled_segments(spark, sf_dir))
    return found.select("query_id", F.posexplode("path").alias("step", "cell")).select(
        "query_id", "step", F.col("cell.i").alias("i"), F.col("cell.j").alias("j")
    )


def best_per_series(spark, sf_dir):
    found = exact.best_per_series(_foreign_queries(spark, sf_dir), scaled_segments(spark, sf_dir))
    return _dist_rows(found)


def query_sample(spark, sf_dir):
    return exact.sample_queries(raw_segments(spark, sf_dir), 5, SEED)


def sampled_best_match(spark, sf_dir):
    """Exact search for the sampled queries, each in all series."""
    series = scaled_segments(spark, sf_dir)
    queries = materialise(win.cut(series, exact.sample_queries(series, 5, SEED)), "queries")
    return exact.best_match(queries, series).select("query_id", "series_id", "start", _rounded("distance", "distance"))


# --- reports -----------------------------------------------------------------------------------


def cluster_profile(spark, sf_dir):
    return reports.cluster_profile(stored_clusters(spark, sf_dir), raw_segments(spark, sf_dir), 2, 3, SEED)


def result_profile(spark, sf_dir):
    results = search_results(spark, sf_dir)
    return reports.result_profile(cut_queries(spark, sf_dir), results, raw_segments(spark, sf_dir))


def windows_like_user_7(spark, sf_dir):
    """The five windows of 20 points most like points 5..25 of user 7, over all users."""
    series = scaled_segments(spark, sf_dir)
    query = win.cut(series, search.query_specs(spark, [("q", "7", 5, 25)]))
    scored = search.nearest_windows(query, series, 20, 5)
    return search.top_k(scored, 5).select("rank", "series_id", "start", _rounded("dist", "dist"))


QUERIES_BY_NAME = {
    "series_from_events": series_from_events,
    "csv_source": csv_source,
    "csv_source_exact_trim": csv_source_exact_trim,
    "keyed_source": keyed_source,
    "row_extract": row_extract,
    "cleaned_cells": cleaned_cells,
    "long_series_windows": long_series_windows,
    "long_series_best_match": long_series_best_match,
    "duplicate_ids": duplicate_ids,
    "repeated_ids": repeated_ids,
    "series_status": series_status,
    "save_reload": save_reload,
    "dict_views": dict_views,
    "global_minmax": global_minmax,
    "normalized_series": normalized_series,
    "normalized_given_bounds": normalized_given_bounds,
    "max_length": max_length,
    "windows_all_lengths": windows_all_lengths,
    "group_sizes": group_sizes,
    "grouped_windows": grouped_windows,
    "length_validation": length_validation,
    "window_slices": window_slices,
    "fixed_windows": fixed_windows,
    "query_cut": query_cut,
    "pair_euclid": pair_euclid,
    "pair_manhattan": pair_manhattan,
    "pair_minkowski": pair_minkowski,
    "similarity_radii": similarity_radii,
    "dtw_scores": dtw_scores,
    "dtw_scores_squared": dtw_scores_squared,
    "leader_clusters": leader_clusters_rows,
    "manhattan_clusters": manhattan_clusters,
    "minkowski_clusters": minkowski_clusters,
    "embedding_clusters": embedding_clusters,
    "two_pass_clusters": two_pass_clusters,
    "dtw_clusters": dtw_clusters,
    "dtw_clusters_five_lengths": dtw_clusters_five_lengths,
    "cluster_counts": cluster_counts,
    "group_cluster_job": group_cluster_job,
    "nearest_rep": nearest_rep,
    "nearest_rep_other_series": nearest_rep_other_series,
    "scored_members": scored_members,
    "ranked_members": ranked_members,
    "index_nearest_rep": index_nearest_rep,
    "index_ranked_members": index_ranked_members,
    "index_clusters": index_clusters,
    "no_overlap_topk": no_overlap_topk,
    "similarity_search": similarity_search_rows,
    "length_filter": length_filter,
    "excluded_own_series": excluded_own_series,
    "overlap_fractions": overlap_fractions,
    "best_match": best_match,
    "best_match_path": best_match_path,
    "best_per_series": best_per_series,
    "query_sample": query_sample,
    "sampled_best_match": sampled_best_match,
    "cluster_profile": cluster_profile,
    "result_profile": result_profile,
    "windows_like_user_7": windows_like_user_7,
}
