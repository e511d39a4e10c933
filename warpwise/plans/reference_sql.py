"""The same results as plain SQL over the given tables, for an independent check.

Clusters are stated as "the earliest window left becomes a representative and removes its
neighbours", one recursion step per representative; warping walks the anti-diagonals.
"""

from __future__ import annotations

from .catalog import EXACT_LENGTH, K_BEST, LONG_WINDOW, LONGEST, OVERLAP, QUERIES, SEED, SHORTEST, ST

SERIES = """
pts AS (
  SELECT CAST(user_id AS VARCHAR) AS series_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value FROM events),
bounds AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
s AS (
  SELECT series_id, list(value ORDER BY pos) AS raw, list((value - lo) / (hi - lo) ORDER BY pos) AS norm,
         count(*) AS n FROM pts, bounds GROUP BY series_id)"""


def windows(name: str, low, high, last: int = 0) -> str:
    return f"""
{name} AS (
  SELECT length, series_id, start, start + length AS "end",
         raw[start + 1 : start + length] AS raw, norm[start + 1 : start + length] AS norm
  FROM (SELECT *, unnest(range(0, greatest(0, n - length + {last}))) AS start
        FROM (SELECT *, CAST(unnest(range({low}, {high} + 1)) AS INTEGER) AS length FROM s)))"""


def items(name: str, source: str, values: str = "norm") -> str:
    return f"""
{name} AS (
  SELECT length, series_id, start, "end", {values} AS v,
         row_number() OVER (PARTITION BY length ORDER BY md5(concat_ws('|', '{SEED}', series_id, start, "end"))) AS rk
  FROM {source})"""


# Distances of two lists v and w.
EUCLID = "list_distance({v}, {w})"
MANHATTAN = "list_sum(list_transform({v}, lambda x, i: abs(x - {w}[i])))"
CUBIC = "pow(list_sum(list_transform({v}, lambda x, i: pow(abs(x - {w}[i]), 3))), 1.0 / 3)"

# DTW as a fold over v of a fold over w; every step is a list, so the folds keep one type.
WARP = (
    "list_reduce(list_prepend(list_prepend(0.0, list_transform({w}, lambda x: CAST('inf' AS DOUBLE))), "
    "list_transform({v}, lambda x: [x])), lambda acc, x: "
    "list_reduce(list_prepend([CAST('inf' AS DOUBLE)], list_transform(range(1, len({w}) + 1), lambda j: [CAST(j AS DOUBLE)])), "
    "lambda cur, j: list_append(cur, abs(x[1] - {w}[CAST(j[1] AS BIGINT)]) + "
    "least(cur[len(cur)], acc[CAST(j[1] AS BIGINT)], acc[CAST(j[1] AS BIGINT) + 1]))))[len({w}) + 1]"
)


def leaders(name: str, source: str, radius: str, dist: str = EUCLID) -> str:
    """Ranks of the representatives of each length in ``source (length, rk, v)``."""
    return f"""
{name}_left AS (
  SELECT 0 AS step, length, rk, v FROM {source}
  UNION ALL
  SELECT step + 1, length, rk, v FROM (
    SELECT *, first_value(v) OVER (PARTITION BY length ORDER BY rk) AS lead FROM {name}_left)
  WHERE {dist.format(v='v', w='lead')} > {radius}),
{name} AS (
  SELECT r.length, r.rk, i.v, i.series_id, i.start
  FROM (SELECT length, step, min(rk) AS rk FROM {name}_left GROUP BY length, step) r
  JOIN {source} i ON i.length = r.length AND i.rk = r.rk)"""


def one_pass(low, high, st, dist: str = EUCLID, prefix: str = "") -> str:
    """CTEs ending in ``clusters`` for leader clustering of the window lengths low..high."""
    radius = f"sqrt(length) * {st} / 2"
    return ",".join(
        [
            windows("w", low, high),
            items("it", "w"),
            leaders("rep", "it", radius, dist),
            f"""
numbered AS (SELECT *, row_number() OVER (PARTITION BY length ORDER BY rk) - 1 AS no FROM rep),
pairs AS (
  SELECT i.length, i.rk, r.rk AS rep_rk, r.no, {dist.format(v='i.v', w='r.v')} AS dist
  FROM it i JOIN numbered r ON i.length = r.length AND r.rk <= i.rk),
best AS (
  SELECT * FROM pairs WHERE dist <= {radius}
  QUALIFY row_number() OVER (PARTITION BY length, rk ORDER BY dist, rep_rk) = 1),
clusters AS (
  SELECT i.length, concat(i.length, '_', b.no) AS cluster_id, i.series_id, i.start, i."end",
         b.rep_rk = i.rk AS is_rep, b.dist AS rep_dist
  FROM it i JOIN best b ON i.length = b.length AND i.rk = b.rk)""",
        ]
    )


def two_pass(low, high, st) -> str:
    radius = f"sqrt(length) * {st} / 2"
    return ",".join(
        [
            windows("w", low, high),
            items("it", "w"),
            leaders("rep1", "it", f"{radius} * 2"),
            f"""
no1 AS (SELECT *, row_number() OVER (PARTITION BY length ORDER BY rk) - 1 AS no FROM rep1),
best1 AS (
  SELECT i.length, i.rk, r.rk AS rep_rk, r.no, list_distance(i.v, r.v) AS dist
  FROM it i JOIN no1 r ON i.length = r.length AND r.rk <= i.rk
  QUALIFY row_number() OVER (PARTITION BY i.length, i.rk ORDER BY dist, r.rk) = 1),
waiting AS (
  SELECT i.* FROM it i JOIN best1 b ON i.length = b.length AND i.rk = b.rk WHERE b.dist > sqrt(i.length) * {st} / 2),
any1 AS (
  SELECT i.length, i.rk, min(list_distance(i.v, r.v)) AS dist
  FROM waiting i JOIN no1 r ON i.length = r.length GROUP BY i.length, i.rk),
open2 AS (
  SELECT i.* FROM waiting i JOIN any1 a ON i.length = a.length AND i.rk = a.rk
  WHERE a.dist > sqrt(i.length) * {st} / 2)""",
            leaders("rep2", "open2", radius),
            f"""
every AS (
  SELECT length, rk, v, 1 AS pass FROM rep1 UNION ALL SELECT length, rk, v, 2 AS pass FROM rep2),
numbered AS (SELECT *, row_number() OVER (PARTITION BY length ORDER BY pass, rk) - 1 AS no FROM every),
best2 AS (
  SELECT i.length, i.rk, r.rk AS rep_rk, r.no, list_distance(i.v, r.v) AS dist
  FROM waiting i JOIN numbered r ON i.length = r.length AND (r.pass = 1 OR r.rk <= i.rk)
  QUALIFY row_number() OVER (PARTITION BY i.length, i.rk ORDER BY dist, r.no) = 1),
best AS (
  SELECT length, rk, rep_rk, no, dist FROM best1 WHERE dist <= {radius}
  UNION ALL SELECT length, rk, rep_rk, no, dist FROM best2),
clusters AS (
  SELECT i.length, concat(i.length, '_', b.no) AS cluster_id, i.series_id, i.start, i."end",
         b.rep_rk = i.rk AS is_rep, b.dist AS rep_dist
  FROM it i JOIN best b ON i.length = b.length AND i.rk = b.rk)""",
        ]
    )


def cross_length(low: int, high: int, st) -> str:
    """Leader clustering by DTW of the lengths low..high; representatives of shorter ones serve the longer."""
    radius = f"sqrt(length) * {st} / 2"
    dist = WARP.format(v="i.v", w="r.v")
    # warping matches the ends, so pairs whose ends differ by more are not near
    ends = f"abs(i.v[1] - r.v[1]) + abs(i.v[len(i.v)] - r.v[len(r.v)]) <= sqrt(i.length) * {st} / 2 * 1.000001"
    steps = [windows("w", low, high), items("it", "w")]
    for n in range(low, high + 1):
        shorter = " UNION ALL ".join(f"SELECT v FROM rep{m}" for m in range(low, n))
        if shorter:
            steps.append(f"\nnear{n} AS (SELECT i.rk, min({dist}) AS dist FROM it i JOIN ({shorter}) r ON i.length = {n} AND {ends} GROUP BY i.rk)")
            steps.append(f"\nopen{n} AS (SELECT i.* FROM it i LEFT JOIN near{n} USING (rk) WHERE i.length = {n} AND (near{n}.dist IS NULL OR near{n}.dist > {radius}))")
        else:
            steps.append(f"\nopen{n} AS (SELECT * FROM it WHERE length = {n})")
        steps.append(leaders(f"rep{n}", f"open{n}", radius, WARP))
    every = " UNION ALL ".join(f"SELECT length, rk, v FROM rep{n}" for n in range(low, high + 1))
    steps.append(
        f"""
numbered AS (SELECT *, row_number() OVER (PARTITION BY length ORDER BY rk) - 1 AS no FROM ({every})),
pairs AS (
  SELECT i.length, i.rk, r.length AS rep_length, r.rk AS rep_rk, r.no, {dist} AS dist
  FROM it i JOIN numbered r ON (r.length < i.length OR (r.length = i.length AND r.rk <= i.rk)) AND {ends}),
best AS (
  SELECT * FROM pairs WHERE dist <= {radius}
  QUALIFY row_number() OVER (PARTITION BY length, rk ORDER BY dist, rep_length, rep_rk) = 1),
clusters AS (
  SELECT i.length, concat(b.rep_length, '_', b.no) AS cluster_id, i.series_id, i.start, i."end",
         b.rep_length = i.length AND b.rep_rk = i.rk AS is_rep, b.dist AS rep_dist
  FROM it i JOIN best b ON i.length = b.length AND i.rk = b.rk)"""
    )
    return ",".join(steps)


def warped(name: str, source: str, cost: str = "abs") -> str:
    """``name (id, dist)`` for ``source (id, a, b)``; ``name_walk`` holds every diagonal."""
    term = "abs(a[i + 1] - b[d + 2 - i])" if cost == "abs" else "pow(a[i + 1] - b[d + 2 - i], 2)"
    zero = "abs(a[1] - b[1])" if cost == "abs" else "pow(a[1] - b[1], 2)"
    out = "cur[len(a)]" if cost == "abs" else "sqrt(cur[len(a)])"
    inf = "CAST('inf' AS DOUBLE)"
    return f"""
{name}_walk AS (
  SELECT id, a, b, CAST(0 AS BIGINT) AS d,
         list_transform(a, lambda x, i: {inf}) AS prev,
         list_transform(a, lambda x, i: CASE WHEN i = 1 THEN CAST({zero} AS DOUBLE) ELSE {inf} END) AS cur
  FROM {source}
  UNION ALL
  SELECT id, a, b, d + 1, cur,
         list_transform(range(0, len(a)), lambda i:
           CASE WHEN d + 1 - i < 0 OR d + 1 - i >= len(b) THEN {inf}
                ELSE {term} + least(CASE WHEN i = 0 THEN {inf} ELSE cur[i] END, cur[i + 1],
                                    CASE WHEN i = 0 THEN {inf} ELSE prev[i] END) END)
  FROM {name}_walk WHERE d < len(a) + len(b) - 2),
{name} AS (SELECT id, {out} AS dist FROM {name}_walk WHERE d = len(a) + len(b) - 2)"""


def query_cuts(values: str = "raw") -> str:
    rows = ", ".join(f"('{q}', '{s}', {a}, {b})" for q, s, a, b in QUERIES)
    return f"""
spec(query_id, source_series_id, a, b) AS (VALUES {rows}),
queries AS (
  SELECT query_id, source_series_id, {values}[a + 1 : b] AS q FROM spec JOIN s ON series_id = source_series_id)"""


def nearest(extra: str = "") -> str:
    return ",".join(
        [
            query_cuts(),
            f"""
rp AS (
  SELECT row_number() OVER (ORDER BY query_id, c.length, cluster_id) AS id, query_id, c.length, cluster_id,
         CAST(split_part(cluster_id, '_', 2) AS BIGINT) AS no, w.raw AS a, q AS b
  FROM queries, clusters c JOIN w ON w.length = c.length AND w.series_id = c.series_id AND w.start = c.start
  WHERE c.is_rep {extra})""",
            warped("rpd", "rp"),
            """
nearest AS (
  SELECT query_id, length, cluster_id, dist FROM rp JOIN rpd USING (id)
  QUALIFY row_number() OVER (PARTITION BY query_id, length ORDER BY dist, no) = 1)""",
        ]
    )


def scored() -> str:
    return ",".join(
        [
            nearest(),
            """
mb AS (
  SELECT row_number() OVER (ORDER BY query_id, c.length, c.series_id, c.start) AS id, query_id, c.length, c.cluster_id, c.series_id,
         c.start, c."end", w.raw AS a, q AS b
  FROM nearest n JOIN queries USING (query_id) JOIN clusters c ON c.length = n.length AND c.cluster_id = n.cluster_id
  JOIN w ON w.length = c.length AND w.series_id = c.series_id AND w.start = c.start
  WHERE c.series_id <> source_series_id)""",
            warped("mbd", "mb"),
            """
scored AS (
  SELECT query_id, length, cluster_id, series_id, start, "end", dist,
         row_number() OVER (PARTITION BY query_id, length ORDER BY dist, series_id, start) AS place
  FROM mb JOIN mbd USING (id))""",
        ]
    )


def greedy(k: int) -> str:
    """Keep the best, drop what it overlaps too much, repeat."""
    return f"""
pick_left AS (
  SELECT 1 AS step, * FROM scored
  UNION ALL
  SELECT step + 1, query_id, length, cluster_id, series_id, start, "end", dist, place FROM (
    SELECT *, first_value(series_id) OVER f AS bid, first_value(start) OVER f AS bs,
           first_value("end") OVER f AS be, min(place) OVER (PARTITION BY query_id, length) AS bp
    FROM pick_left WINDOW f AS (PARTITION BY query_id, length ORDER BY place))
  WHERE step < {k} AND place > bp
    AND NOT (series_id = bid AND (least(be, "end") - greatest(bs, start)) / CAST(be - bs AS DOUBLE) > {OVERLAP})),
picked AS (
  SELECT query_id, length, cluster_id, series_id, start, "end", dist, CAST(step AS INTEGER) AS rank FROM pick_left
  QUALIFY row_number() OVER (PARTITION BY query_id, length, step ORDER BY place) = 1)"""


def sql(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",".join(ctes) + "\n" + select


CLUSTER_ROWS = 'SELECT length, cluster_id, series_id, start, "end", is_rep, round(rep_dist, 6) AS rep_dist FROM clusters'
BASE = one_pass(SHORTEST, LONGEST, ST)

WIDE = """
wide AS (
  SELECT concat('(', series_id, ')_(back-0)_(ch-A)_(0)_(', n, ')') AS series_id, n,
         list_transform(raw, lambda x: x) AS cells FROM s)"""

SUPPLIERS = f"""
sp AS (
  SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_quantity) - 1 AS pos,
         (l_quantity - lo) / (hi - lo) AS value
  FROM lineitem, (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)),
fq AS (
  SELECT 's1' AS query_id, list(value ORDER BY pos) AS q FROM sp WHERE l_suppkey = 1 AND pos >= 10 AND pos < 30
  UNION ALL
  SELECT 's2' AS query_id, list(value ORDER BY pos) AS q FROM sp WHERE l_suppkey = 5 AND pos >= 40 AND pos < 60)"""

SAMPLE = f"""
drawn AS (
  SELECT *, row_number() OVER (ORDER BY digest, series_id) - 1 AS i
  FROM (SELECT series_id, n, norm, md5(concat_ws('|', '{SEED}', series_id)) AS digest FROM s)
  QUALIFY i < 5),
sample AS (
  SELECT concat('q', i) AS query_id, series_id, norm, (i + 1) * 2 AS start,
         (i + 1) * 2 + 5 + CAST(concat('0x', substr(digest, 1, 15)) AS BIGINT) % (n // 2 - (i + 1) * 2 - 5) AS "end"
  FROM drawn)"""


LONG_POINTS = """SELECT l_returnflag AS series_id, l_quantity AS value,
  row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_quantity) - 1 AS pos FROM lineitem"""


def exact(queries: str, cost: str = "sq") -> str:
    """``hits (query_id, length, series_id, start, v, dist)``: all windows of each query's length."""
    return ",".join(
        [
            f"""
xw AS (
  SELECT row_number() OVER (ORDER BY query_id, series_id, start) AS id, * FROM (
    SELECT query_id, length, series_id, start, norm[start + 1 : start + length] AS b, q AS a
    FROM (SELECT *, unnest(range(0, n - length + 1)) AS start
          FROM (SELECT query_id, q, CAST(len(q) AS INTEGER) AS length, s.* FROM {queries}, s))))""",
            warped("xd", "xw", cost),
            "\nhits AS (SELECT query_id, length, series_id, start, b AS v, a AS q, dist FROM xw JOIN xd USING (id))",
        ]
    )


TOP = "top AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, series_id, start) = 1)"

TRACE = """
grid AS (
  SELECT query_id, id, d, cur, len(a) AS m, len(b) AS n FROM xd_walk JOIN xw USING (id, a, b)
  SEMI JOIN top ON top.query_id = xw.query_id AND top.series_id = xw.series_id AND top.start = xw.start),
cell AS (
  SELECT query_id, m, n, CAST(i AS BIGINT) AS i, d - i AS j, cur[i + 1] AS v
  FROM (SELECT *, unnest(range(0, m)) AS i FROM grid) WHERE d - i >= 0 AND d - i < n),
back AS (
  SELECT query_id, m - 1 AS i, n - 1 AS j, 0 AS step FROM (SELECT DISTINCT query_id, m, n FROM grid)
  UNION ALL
  SELECT query_id, i, j, step FROM (
    SELECT b.query_id, c.i, c.j, b.step + 1 AS step,
           row_number() OVER (PARTITION BY b.query_id ORDER BY c.v,
             CASE WHEN c.i < b.i AND c.j < b.j THEN 0 WHEN c.i < b.i THEN 1 ELSE 2 END) AS best
    FROM back b JOIN cell c ON c.query_id = b.query_id AND c.i BETWEEN b.i - 1 AND b.i AND c.j BETWEEN b.j - 1 AND b.j
     AND (c.i, c.j) <> (b.i, b.j))
  WHERE best = 1)"""

VECTORS = """
first_v AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings ORDER BY vec_id LIMIT 1),
vec AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, q FROM embeddings, first_v)"""

EMBEDDED = ",".join(
    [
        """
w AS (
  SELECT CAST(64 AS INTEGER) AS length, CAST(vec_id AS VARCHAR) AS series_id, CAST(0 AS BIGINT) AS start,
         CAST(64 AS BIGINT) AS "end", CAST(embedding AS DOUBLE[]) AS norm FROM embeddings)""",
        one_pass(64, 64, 0.3).split(",\nit AS", 1)[1].join(["\nit AS", ""]),
    ]
)


def statements() -> dict[str, str]:
    unnest_cells = "SELECT series_id, CAST(pos AS INTEGER) AS pos, value FROM (SELECT series_id, unnest(range(0, len(v))) AS pos, unnest(v) AS value FROM ({}))"
    q1 = QUERIES[0]
    dtw_source = f"""
dw AS (
  SELECT row_number() OVER (ORDER BY w.series_id, w.start) AS id, w.series_id, w.start, w.raw AS a, q.raw[{q1[2]} + 1 : {q1[3]}] AS b
  FROM w, s q WHERE q.series_id = '{q1[1]}')"""
    search_rows = "SELECT query_id, length, rank, cluster_id, series_id, start, \"end\", round(dist, 6) AS dist FROM picked"
    fixed = 'SELECT series_id, start, CAST(pos AS INTEGER) AS pos, value FROM (SELECT series_id, start, unnest(range(0, length)) AS pos, unnest(raw) AS value FROM w)'
    return {
        "series_from_events": sql(SERIES, select="SELECT series_id, pos, value FROM pts"),
        "csv_source": sql(SERIES, WIDE, select=unnest_cells.format("SELECT series_id, cells[1 : n - 1] AS v FROM wide")),
        "csv_source_exact_trim": sql(SERIES, WIDE, select=unnest_cells.format("SELECT series_id, cells AS v FROM wide")),
        "keyed_source": sql(
            SERIES,
            # values start after the header's six cells, so the first of them is skipped too
            select="""SELECT series_id, CAST(pos AS INTEGER) AS pos, value FROM (
              SELECT concat('(', series_id, ')_(back-0)') AS series_id, unnest(range(0, n - 2)) AS pos,
                     CAST(unnest(raw[2 : n - 1]) AS VARCHAR) AS value FROM s)""",
        ),
        "row_extract": "SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 50",
        "cleaned_cells": """SELECT doc_id, CAST(pos AS INTEGER) AS pos, cell FROM (
            SELECT doc_id, unnest([0, 1, 2, 3]) AS pos,
                   unnest([trim(source), NULL, NULL, trim(lang)]) AS cell FROM documents)""",
        "long_series_windows": f"""SELECT series_id, pos AS start, value AS first, total FROM (
            SELECT *, sum(value) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {LONG_WINDOW - 1} FOLLOWING) AS total
            FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM ({LONG_POINTS}))) WHERE pos + {LONG_WINDOW} < n""",
        "long_series_best_match": sql(
            SUPPLIERS,
            f"""
s AS (
  SELECT series_id, list((value - lo) / (hi - lo) ORDER BY pos) AS norm, count(*) AS n
  FROM ({LONG_POINTS}), (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem) GROUP BY series_id)""",
            exact("fq"), TOP, select="SELECT query_id, series_id, start, round(dist, 6) AS distance FROM top",
        ),
        "duplicate_ids": """SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS series_id FROM orders
            WHERE o_custkey IN (SELECT user_id FROM events)""",
        "repeated_ids": """SELECT CAST(o_custkey AS VARCHAR) AS series_id, count(*) AS "rows" FROM orders
            GROUP BY o_custkey HAVING count(*) > 1""",
        "series_status": sql(
            SERIES, select="SELECT series_id, CASE WHEN n > 60 THEN 'grouped' ELSE 'loaded' END AS status FROM s"
        ),
        "save_reload": sql(SERIES, windows("w", 21, 22), select='SELECT length, series_id, start, "end" FROM w'),
        "dict_views": sql(SERIES, WIDE, select=unnest_cells.format("SELECT series_id, cells[1 : n - 1] AS v FROM wide")),
        "global_minmax": "SELECT min(value) AS lo, max(value) AS hi FROM events",
        "normalized_series": sql(
            SERIES, select="SELECT series_id, pos, round((value - lo) / (hi - lo), 6) AS norm FROM pts, bounds"
        ),
        "normalized_given_bounds": sql(SERIES, select="SELECT series_id, pos, round((value + 100) / 1000, 6) AS norm FROM pts"),
        "max_length": sql(SERIES, select="SELECT max(n) AS max_length FROM s"),
        "windows_all_lengths": sql(
            SERIES,
            select="""SELECT CAST(length AS INTEGER) AS length, series_id, start, start + length AS "end" FROM (
              SELECT *, unnest(range(0, n - length)) AS start FROM (SELECT *, unnest(range(1, n)) AS length FROM s))""",
        ),
        "group_sizes": sql(
            SERIES,
            select="""SELECT CAST(length AS INTEGER) AS length, CAST(sum(n - length) AS BIGINT) AS windows
              FROM (SELECT *, unnest(range(1, n)) AS length FROM s) GROUP BY length""",
        ),
        "grouped_windows": sql(SERIES, windows("w", 30, 32), select='SELECT length, series_id, start, "end" FROM w'),
        "length_validation": sql(SERIES, windows("w", 40, 44), select="SELECT length, count(*) AS checked FROM w GROUP BY length"),
        "window_slices": sql(SERIES, windows("w", 20, 20), select=fixed),
        "fixed_windows": sql(SERIES, windows("w", 5, 5, 1), select=fixed),
        "query_cut": sql(
            SERIES,
            select="""SELECT concat('q', series_id) AS query_id, series_id AS source_series_id,
              CAST(pos - 24 AS INTEGER) AS pos, value FROM pts WHERE pos >= 24 AND pos < 44""",
        ),
        "pair_euclid": sql(VECTORS, select=f"SELECT vec_id, round({EUCLID.format(v='v', w='q')}, 6) AS dist FROM vec"),
        "pair_manhattan": sql(VECTORS, select=f"SELECT vec_id, round({MANHATTAN.format(v='v', w='q')}, 6) AS dist FROM vec"),
        "pair_minkowski": sql(VECTORS, select=f"SELECT vec_id, round({CUBIC.format(v='v', w='q')}, 6) AS dist FROM vec"),
        "similarity_radii": sql(
            SERIES,
            select=f"""SELECT DISTINCT CAST(length AS INTEGER) AS length, round(sqrt(length) * {ST} / 2, 6) AS radius
              FROM (SELECT unnest(range(1, n)) AS length FROM s)""",
        ),
        "dtw_scores": sql(
            SERIES, windows("w", 12, 12), dtw_source, warped("dd", "dw"),
            select="SELECT series_id, start, round(dist, 6) AS dist FROM dw JOIN dd USING (id)",
        ),
        "dtw_scores_squared": sql(
            SERIES, windows("w", 12, 12), dtw_source, warped("dd", "dw", "sq"),
            select="SELECT series_id, start, round(dist, 6) AS dist FROM dw JOIN dd USING (id)",
        ),
        "leader_clusters": sql(SERIES, BASE, select=CLUSTER_ROWS),
        "manhattan_clusters": sql(SERIES, one_pass(6, 7, 1.0, MANHATTAN), select=CLUSTER_ROWS),
        "minkowski_clusters": sql(SERIES, one_pass(6, 7, ST, CUBIC), select=CLUSTER_ROWS),
        "embedding_clusters": sql(EMBEDDED, select=CLUSTER_ROWS),
        "two_pass_clusters": sql(SERIES, two_pass(SHORTEST, LONGEST, 0.2), select=CLUSTER_ROWS),
        "dtw_clusters": sql(SERIES, cross_length(3, 4, ST), select=CLUSTER_ROWS),
        "dtw_clusters_five_lengths": sql(SERIES, cross_length(3, 7, ST), select=CLUSTER_ROWS),
        "cluster_counts": sql(
            SERIES, BASE, select="SELECT length, count(*) AS clusters FROM clusters WHERE is_rep GROUP BY ROLLUP (length)"
        ),
        "group_cluster_job": sql(
            SERIES, one_pass(5, 6, ST),
            select="""SELECT length, count(*) AS windows, count(*) AS members,
              CAST(sum(CASE WHEN is_rep THEN 1 ELSE 0 END) AS BIGINT) AS clusters FROM clusters GROUP BY length""",
        ),
        "nearest_rep": sql(
            SERIES, BASE, nearest(), select="SELECT query_id, length, cluster_id, round(dist, 6) AS dist FROM nearest"
        ),
        "nearest_rep_other_series": sql(
            SERIES, BASE, nearest("AND c.series_id <> source_series_id"),
            select="SELECT query_id, length, cluster_id, round(dist, 6) AS dist FROM nearest",
        ),
        "scored_members": sql(
            SERIES, BASE, scored(),
            select='SELECT query_id, length, cluster_id, series_id, start, "end", round(dist, 6) AS dist FROM scored',
        ),
        "ranked_members": sql(
            SERIES, BASE, scored(),
            select='SELECT query_id, length, cluster_id, series_id, start, "end", round(dist, 6) AS dist, CAST(place AS INTEGER) AS rank FROM scored WHERE place <= 100',
        ),
        "index_nearest_rep": sql(
            SERIES, BASE, nearest(), select="SELECT query_id, length, cluster_id, round(dist, 6) AS dist FROM nearest"
        ),
        "index_ranked_members": sql(
            SERIES, BASE, scored(),
            select='SELECT query_id, length, cluster_id, series_id, start, "end", round(dist, 6) AS dist, CAST(place AS INTEGER) AS rank FROM scored WHERE place <= 100',
        ),
        "index_clusters": sql(
            SERIES, BASE,
            select="""SELECT c.length, c.cluster_id, count(*) AS n_members, round(min(list_min(w.raw)), 6) AS least, round(max(list_max(w.raw)), 6) AS most,
              round(sum(list_sum(w.raw)) / sum(c.length), 6) AS mean FROM clusters c JOIN w USING (length, series_id, start) GROUP BY ALL""",
        ),
        "no_overlap_topk": sql(SERIES, BASE, scored(), greedy(20), select=search_rows),
        "similarity_search": sql(SERIES, BASE, scored(), greedy(K_BEST), select=search_rows),
        "length_filter": sql(SERIES, windows("w", 9, 10), select='SELECT length, series_id, start, "end" FROM w'),
        "excluded_own_series": sql(
            SERIES, BASE, nearest(),
            select="""SELECT query_id, n.length, n.cluster_id, c.series_id, c.start, c."end" FROM nearest n JOIN queries USING (query_id)
              JOIN clusters c ON c.length = n.length AND c.cluster_id = n.cluster_id WHERE c.series_id <> source_series_id""",
        ),
        "overlap_fractions": sql(
            SERIES, BASE,
            select="""SELECT c.cluster_id, c.series_id, c.start, c."end",
              round((least(r."end", c."end") - greatest(r.start, c.start)) / CAST(r."end" - r.start AS DOUBLE), 6) AS overlap
              FROM clusters c JOIN clusters r ON r.is_rep AND r.length = c.length AND r.cluster_id = c.cluster_id AND r.series_id = c.series_id""",
        ),
        "best_match": sql(
            SERIES, SUPPLIERS, exact("fq"), TOP,
            select="""SELECT query_id, series_id, start, distance, CAST(pos AS INTEGER) AS pos, round(value, 6) AS value FROM (
              SELECT query_id, series_id, start, round(dist, 6) AS distance, unnest(range(0, length)) AS pos, unnest(v) AS value FROM top)""",
        ),
        "best_match_path": sql(
            SERIES, SUPPLIERS, exact("fq"), TOP, TRACE,
            select="""SELECT query_id, CAST(max(step) OVER (PARTITION BY query_id) - step AS INTEGER) AS step,
              CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j FROM back""",
        ),
        "best_per_series": sql(
            SERIES, SUPPLIERS, exact("fq"),
            select="""SELECT query_id, series_id, start, length, round(dist, 6) AS dist FROM hits
              QUALIFY row_number() OVER (PARTITION BY query_id, series_id ORDER BY dist, start) = 1""",
        ),
        "query_sample": sql(SERIES, SAMPLE, select='SELECT query_id, series_id, start, "end" FROM sample'),
        "sampled_best_match": sql(
            SERIES, SAMPLE, '\nsq AS (SELECT query_id, norm[start + 1 : "end"] AS q FROM sample)', exact("sq"), TOP,
            select="SELECT query_id, series_id, start, round(dist, 6) AS distance FROM top",
        ),
        "cluster_profile": sql(
            SERIES, BASE,
            f"""
shown AS (
  SELECT *, row_number() OVER (PARTITION BY length, cluster_id ORDER BY is_rep DESC,
    md5(concat_ws('|', '{SEED}', series_id, start, "end"))) AS member
  FROM clusters WHERE length IN (SELECT DISTINCT length FROM clusters ORDER BY length LIMIT 2)
  QUALIFY member <= 3)""",
            select="""SELECT length, cluster_id, CAST(member AS INTEGER) AS member, label, CAST(pos AS INTEGER) AS pos, value FROM (
              SELECT c.length, cluster_id, member, concat('id ', cluster_id, c.series_id, '_', c.start, '_', c."end") AS label,
                     unnest(range(0, c.length)) AS pos, unnest(w.raw) AS value
              FROM shown c JOIN w ON w.length = c.length AND w.series_id = c.series_id AND w.start = c.start)""",
        ),
        "result_profile": sql(
            SERIES, BASE, scored(), greedy(K_BEST),
            select="""SELECT query_id, CAST(length AS INTEGER) AS length, rank, label, CAST(pos AS INTEGER) AS pos, value FROM (
              SELECT query_id, p.length, rank, concat('Rank', rank, ' id ', p.cluster_id, p.series_id, '_', p.start, '_', p."end") AS label,
                     unnest(range(0, p.length)) AS pos, unnest(w.raw) AS value
              FROM picked p JOIN w ON w.length = p.length AND w.series_id = p.series_id AND w.start = p.start
              UNION ALL
              SELECT query_id, 0, 0, 'QUERY', unnest(range(0, len(q))), unnest(q) FROM queries)""",
        ),
        "windows_like_user_7": sql(
            SERIES, windows("w", EXACT_LENGTH, EXACT_LENGTH),
            """
lw AS (
  SELECT row_number() OVER (ORDER BY w.series_id, w.start) AS id, w.series_id, w.start, w.norm AS a, q.norm[6 : 25] AS b
  FROM w, s q WHERE q.series_id = '7')""",
            warped("ld", "lw"),
            select="""SELECT CAST(row_number() OVER (ORDER BY dist, series_id, start) AS INTEGER) AS rank, series_id, start,
              round(dist, 6) AS dist FROM lw JOIN ld USING (id) QUALIFY rank <= 5""",
        ),
    }
