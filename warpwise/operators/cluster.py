"""Leader clustering of windows, one pass and two passes, in a fixed seeded order.

Processed in that order, a window joins its nearest earlier representative if that lies
within the radius and becomes a representative itself otherwise. The representatives are
found over growing prefixes of the order: a prefix is compared with the representatives so
far, spread over all tasks, and only the few windows left uncovered compete with each other.
One last pass assigns every window. The result is that of the sequential loop.

A window with a value that is not finite is within no radius of any window: it becomes a representative
of its own, at distance 0, and is kept apart from the distances of all others.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ..functions import kernels as K
from ..functions.distance import metric_name
from ..runtime import materialise, new_path, write_parquet
from ..sources.segments import layout
from .scoring import BLOCK_CELLS, BROADCAST_CELLS, Block, Routing, cells, score
from .windows import lengths_of

FIRST_PREFIX = 16_384  # windows of one length in the first prefix
GROWTH = 8  # the second prefix is this many times the first one
MOST_GROWTH = 64  # a later prefix grows by what its predecessor left uncovered, up to this
GROUP_ITEMS = 16_384  # uncovered windows of one length that one task settles by itself ...
GROUP_CELLS = 16_000_000  # ... and the points these may have together
FLAT_VALUES = 4  # values a point, at most, in rows of one window each
COMPARED_AGAIN = 0.25  # share of windows that the last stretch may compare once more to spare hashing all

_WINDOW = [
    ("series_id", pa.string()),
    ("length", pa.int32()),
    ("start", pa.int64()),
    ("key", pa.binary()),
]
_IDS = [name for name, _ in _WINDOW]
_COVERED = pa.schema(_WINDOW)
_OPEN = pa.schema(_WINDOW + [("values", pa.list_(pa.float64()))])
_ASSIGNED = pa.schema(
    _WINDOW
    + [
        ("dist", pa.float64()),
        ("grp", pa.int32()),
        ("rep_length", pa.int32()),
        ("rep_key", pa.binary()),
        ("rep_no", pa.int64()),
    ]
)
_WAITS = pa.schema([("key", pa.binary()), ("early_key", pa.binary())])
_ROUTED = pa.schema(
    [
        ("_block", pa.int32()),
        ("series_id", pa.string()),
        ("seg_start", pa.int64()),
        ("length", pa.int32()),
        ("items", pa.list_(pa.struct([("start", pa.int64()), ("key", pa.binary())]))),
        ("values", pa.list_(pa.float64())),
    ]
)


def priority(seed: int, series_id: Column, start: Column, end: Column) -> Column:
    """The place of a window in the processing order: a hash of seed and coordinates (hex)."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), series_id, start, end))


def _hex_bound(share: float) -> str:
    """The hash below which the given share of all hashes lies."""
    return f"{int(share * (1 << 52)) << 12:016x}"


def _finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def with_bad_points(segments: DataFrame) -> DataFrame:
    """Segments with ``bad``, the places of values that are not finite, which are set to zero."""
    marked = F.transform("values", lambda v, i: F.when(~_finite(v), i))
    bad = F.when(F.forall("values", _finite), F.array().cast("array<int>")).otherwise(F.filter(marked, lambda i: i.isNotNull()))
    zeroed = F.when(F.size("bad") == 0, F.col("values")).otherwise(
        F.transform("values", lambda v: F.when(_finite(v), v).otherwise(0.0))
    )
    return segments.withColumn("bad", bad).withColumn("values", zeroed)


def _places(good: bool) -> Column:
    """Places in a segment where the windows of ``length`` begin that hold no bad point, or one."""
    every = F.sequence(F.lit(0), F.col("count") - 1)

    def spoilt(at: Column) -> Column:
        return F.exists("bad", lambda b: (b >= at) & (b < at + F.col("length")))

    if good:
        return F.when(F.size("bad") == 0, every).otherwise(F.filter(every, lambda at: ~spoilt(at)))
    return F.filter(every, spoilt)


def work_rows(
    segments: DataFrame, shortest: int, longest: int, seed: int, include_last: bool, low: float = 0.0, high: float = 1.0
) -> DataFrame:
    """One row per segment and length: its windows as ``items (start, key)``, and their values.

    ``key`` is the 16-byte hash that orders the windows. Only windows whose place in the order lies
    between the shares ``low`` and ``high`` are listed, and only rows that list some.
    """

    def start(at: Column) -> Column:
        return F.col("seg_start") + at

    def digest(at: Column) -> Column:
        return priority(seed, F.col("series_id"), start(at), start(at) + F.col("length"))

    def inside(x: Column) -> Column:
        above = x["key"] >= _hex_bound(low) if low > 0 else F.lit(True)
        return above & (x["key"] < _hex_bound(high)) if high < 1 else above

    if low > 0 or high < 1:
        items = F.transform(_places(True), lambda at: F.struct(start(at).alias("start"), digest(at).alias("key")))
        items = F.transform(F.filter(items, inside), lambda x: F.struct(x["start"], F.unhex(x["key"]).alias("key")))
    else:
        items = F.transform(_places(True), lambda at: F.struct(start(at).alias("start"), F.unhex(digest(at)).alias("key")))
    return _listed(segments, shortest, longest, include_last, items)


def unkeyed_rows(segments: DataFrame, shortest: int, longest: int, seed: int, include_last: bool) -> DataFrame:
    """The rows of ``work_rows`` with zeros for keys: no window is hashed."""
    key = F.lit(bytearray(16)).alias("key")
    items = F.transform(_places(True), lambda at: F.struct((F.col("seg_start") + at).alias("start"), key))
    return _listed(segments, shortest, longest, include_last, items)


def _listed(segments: DataFrame, shortest: int, longest: int, include_last: bool, items: Column) -> DataFrame:
    """One row per segment and length that has ``items``, with the values of its windows."""
    # exploding a list of one drops the rows without windows; a filter would compute the items twice
    listed = F.explode(F.filter(F.array(items), lambda x: F.size(x) > 0))
    return (
        lengths_of(segments, shortest, longest, include_last, "values", "bad")
        .select("series_id", "seg_start", "length", "count", "values", listed.alias("items"))
        .select(
            "series_id",
            "seg_start",
            "length",
            "items",
            F.slice("values", F.lit(1), F.col("count") + F.col("length") - 1).alias("values"),
        )
    )


def lone_windows(segments: DataFrame, shortest: int, longest: int, seed: int, include_last: bool) -> DataFrame:
    """Windows with a value that is not finite, as representatives without values."""
    start = F.col("seg_start") + F.col("at")
    digest = priority(seed, F.col("series_id"), start, start + F.col("length"))
    return (
        lengths_of(segments.where(F.size("bad") > 0), shortest, longest, include_last, "bad")
        .withColumn("at", F.explode(_places(False)))
        .select(
            "series_id",
            "length",
            start.alias("start"),
            F.unhex(digest).alias("key"),
            F.lit(None).cast("array<double>").alias("values"),
            F.lit(1).alias("grp"),
            F.lit(0).cast("long").alias("no"),
        )
    )


def first_windows(
    segments: DataFrame, shortest: int, longest: int, seed: int, include_last: bool, high: float, low: float = 0.0
) -> DataFrame:
    """The windows, with values, whose place lies between the shares ``low`` and ``high`` of the order."""
    start = F.col("seg_start") + F.col("at")
    digest = priority(seed, F.col("series_id"), start, start + F.col("length"))
    flat = (
        lengths_of(segments, shortest, longest, include_last, "values", "bad")
        .withColumn("at", F.explode(_places(True)))
        .withColumn("digest", digest)
    )
    if high < 1:
        flat = flat.where(F.col("digest") < _hex_bound(high))
    if low > 0:
        flat = flat.where(F.col("digest") >= _hex_bound(low))
    return flat.select(
        "series_id",
        "length",
        start.alias("start"),
        F.unhex("digest").alias("key"),
        F.slice("values", F.col("at") + 1, F.col("length")).alias("values"),
    )


def _flat(rows: DataFrame) -> DataFrame:
    """Work rows -> one row per window with its values."""
    offset = (F.col("item.start") - F.col("seg_start")).cast("int") + 1
    return rows.select("*", F.explode("items").alias("item")).select(
        "series_id", "length", "item.start", "item.key", F.slice("values", offset, F.col("length")).alias("values")
    )


def _single(rows: DataFrame) -> DataFrame:
    """One row per window -> work rows of one window each."""
    return rows.select(
        "series_id",
        F.col("start").alias("seg_start"),
        "length",
        F.array(F.struct("start", "key")).alias("items"),
        "values",
    )


class _Rule:
    """Metric, threshold and radius factor of a clustering."""

    def __init__(self, st: float, metric: str, p: float, factor: float = 1.0):
        if st < 0:
            raise ValueError("the similarity threshold must not be negative")
        self.st, self.short, self.p, self.factor = float(st), metric, float(p), factor
        self.metric = metric_name(metric)
        self.cross_length = self.metric == "dtw"

    def radius(self, length: int) -> float:
        return math.sqrt(length) * self.st / 2 * self.factor

    def times(self, factor: float) -> "_Rule":
        return _Rule(self.st, self.short, self.p, factor)


def _sorted_by(values: np.ndarray, rule: _Rule) -> np.ndarray:
    """The number that windows and patterns are sorted by: the first point for warping, else the mean."""
    return values[:, 0] if rule.cross_length else values.mean(axis=1)


class _Patterns:
    """Representatives of one length, sorted by mean or first point."""

    def __init__(self, table: pa.Table, length: int, rule: _Rule):
        values = K.offsets_and_values(table["values"])[1].reshape(-1, length)
        means = _sorted_by(values, rule)
        rank = np.argsort(means, kind="stable")
        self.length, self.values, self.means = length, values[rank], means[rank]
        self.grp, self.no = table["grp"].to_numpy()[rank], table["no"].to_numpy()[rank]
        self.key = table["key"].combine_chunks().take(pa.array(rank))
        self.hi, self.lo = K.key_words(self.key)
        self.seeds = bool((self.grp == 0).any())

    @staticmethod
    def by_length(table: pa.Table, rule: _Rule) -> dict[int, "_Patterns"]:
        lengths = table["length"].to_numpy()
        return {
            int(n): _Patterns(table.filter(pa.array(lengths == n)), int(n), rule) for n in np.unique(lengths)
        }


class _Tile:
    """Windows of one length in a batch: rows of ``items``, values, and patterns in reach."""

    def __init__(self, index, hi, lo, values, length, radius, slices):
        self.index, self.hi, self.lo = index, hi, lo
        self.values, self.length, self.radius, self.slices = values, length, radius, slices


class _Batch:
    """The windows of an Arrow batch of work rows."""

    def __init__(self, batch: pa.RecordBatch):
        lists = batch.column("items")
        items = lists.flatten()
        self.row = K.owner_rows(lists)
        self.series, self.start, self.key = batch.column("series_id"), items.field("start"), items.field("key")
        self.hi, self.lo = K.key_words(self.key)
        offsets, self.flat = K.offsets_and_values(batch.column("values"))
        first = batch.column("seg_start").to_numpy()[self.row]
        self.at = offsets[self.row] + self.start.to_numpy(zero_copy_only=False) - first
        self.length = batch.column("length").to_numpy()[self.row]

    def identify(self, index: np.ndarray, length: int) -> list:
        """The identifying columns of the windows at ``index``."""
        at = pa.array(index)
        return [
            self.series.take(pa.array(self.row[index])),
            np.full(len(index), length, np.int32),
            self.start.take(at),
            self.key.take(at),
        ]


def _tiles(batch: _Batch, rule, patterns, low=0.0, high=1.0):
    """Cut a batch of work rows into tiles; ``low`` and ``high`` bound the place in the order."""
    at, flat, hi, lo, length = batch.at, batch.flat, batch.hi, batch.lo, batch.length
    sums = np.concatenate([[0.0], np.cumsum(flat)])
    inside = np.ones(len(at), dtype=bool)
    if low > 0:
        inside &= hi >= int(_hex_bound(low), 16)
    if high < 1:
        inside &= hi < int(_hex_bound(high), 16)
    for n in np.unique(length[inside]):
        n = int(n)
        chosen = np.nonzero(inside & (length == n))[0]
        order = flat[at[chosen]] if rule.cross_length else sums[at[chosen] + n] - sums[at[chosen]]
        chosen = chosen[np.argsort(order, kind="stable")]
        radius = rule.radius(n)
        near = [p for m, p in patterns.items() if m == n or (rule.cross_length and m < n)]
        size = K.tile_rows(n, K.WARP_ITEM_TILE if rule.cross_length else K.ITEM_TILE)
        width = K.WARP_PATTERN_TILE if rule.cross_length else K.PATTERN_TILE
        for first in range(0, len(chosen), size):
            tile = chosen[first : first + size]
            values = flat[at[tile][:, None] + np.arange(n)]
            means = _sorted_by(values, rule)
            # warping always matches the first points
            reach = radius * (1 + K.SLACK) if rule.cross_length else K.mean_reach(radius, n, rule.metric, rule.p)
            reach += 1e-12 * (1 + np.abs(means).max())
            slices = []
            for p in near:
                a = np.searchsorted(p.means, means.min() - reach, "left")
                b = np.searchsorted(p.means, means.max() + reach, "right")
                slices += [(p, slice(s, min(s + width, b))) for s in range(a, b, width)]
            yield _Tile(tile, hi[tile], lo[tile], values, n, radius, slices)


def _table(schema: pa.Schema, parts: list[list]) -> pa.Table:
    tables = [
        pa.Table.from_arrays(
            [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(part, schema)], schema=schema
        )
        for part in parts
    ]
    return pa.concat_tables(tables) if tables else schema.empty_table()


def _earlier(pattern: _Patterns, part: slice, tile: _Tile, strict: bool) -> np.ndarray | None:
    """Which patterns existed when each window came up (a representative sees itself too)."""
    if pattern.length < tile.length:
        return None
    p_hi = pattern.hi[part]
    before = p_hi[None, :] < tile.hi[:, None]
    # the second word of the order key decides where the first is shared, as by a window and itself
    shared = np.nonzero(np.isin(tile.hi, p_hi))[0]
    if len(shared):
        p_lo, lo = pattern.lo[part][None, :], tile.lo[shared][:, None]
        before[shared] |= (p_hi[None, :] == tile.hi[shared][:, None]) & ((p_lo < lo) if strict else (p_lo <= lo))
    if pattern.seeds:
        before |= (pattern.grp[part] == 0)[None, :]
    return before


def _prepare_open(rule: _Rule, low: float, high: float):
    """Kernel: windows of a stretch of the order that no pattern covers, with their values."""

    def prepare(table: pa.Table):
        patterns = _Patterns.by_length(table, rule)

        def run(batch: pa.RecordBatch) -> pa.Table:
            parts, batch = [], _Batch(batch)
            for tile in _tiles(batch, rule, patterns, low, high):
                left = np.arange(len(tile.values))
                for pattern, part in tile.slices:
                    hit = K.covered(tile.values[left], pattern.values[part], tile.radius, rule.metric, rule.p)
                    left = left[~hit]
                    if not len(left):
                        break
                if len(left):
                    ends = np.arange(0, (len(left) + 1) * tile.length, tile.length, dtype=np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(tile.values[left].ravel()))
                    parts.append(batch.identify(tile.index[left], tile.length) + [lists])
            return _table(_OPEN, parts)

        return run

    return prepare


def _prepare_covered(rule: _Rule, low: float, high: float):
    """Kernel: windows of a stretch of the order that some pattern covers."""

    def prepare(table: pa.Table):
        patterns = _Patterns.by_length(table, rule)

        def run(batch: pa.RecordBatch) -> pa.Table:
            parts, batch = [], _Batch(batch)
            for tile in _tiles(batch, rule, patterns, low, high):
                hit = np.zeros(len(tile.values), bool)
                for pattern, part in tile.slices:
                    left = np.flatnonzero(~hit)
                    hit[left] = K.covered(tile.values[left], pattern.values[part], tile.radius, rule.metric, rule.p)
                    if hit.all():
                        break
                if hit.any():
                    parts.append(batch.identify(tile.index[hit], tile.length))
            return _table(_COVERED, parts)

        return run

    return prepare


def _pattern_features(rule: _Rule):
    """Two features of patterns as columns: of warping the ends, else the means of both halves."""

    def features(patterns: DataFrame) -> tuple[Column, Column]:
        v = F.col("values")
        if rule.cross_length:
            return v[0], F.element_at(v, -1)
        half = F.floor(F.size(v) / 2).cast("int")

        def mean(part: Column, size: Column) -> Column:
            return F.when(size > 0, F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / size).otherwise(0.0)

        return mean(F.slice(v, F.lit(1), half), half), mean(F.slice(v, half + 1, F.size(v) - half), F.size(v) - half)

    return features


def _window_features(rule: _Rule, values: np.ndarray) -> np.ndarray:
    """The same of windows, one row of ``values`` each: two rows."""
    if rule.cross_length:
        return np.stack([values[:, 0], values[:, -1]])
    half = values.shape[1] // 2
    first = values[:, :half].mean(axis=1) if half else np.zeros(len(values))
    return np.stack([first, values[:, half:].mean(axis=1)])


def _reaches(rule: _Rule, features: np.ndarray, length: int, block: Block) -> np.ndarray:
    """Which windows may lie within the radius of a pattern of the block.

    Means of stretches of a and b points that differ by x and y cost at least (a x^p + b y^p)^(1/p); warping pays for both ends,
    which are one point where both sequences are.
    """
    apart = [np.maximum(np.maximum(low - f, f - high), 0.0) for f, low, high in zip(features, block.low, block.high)]
    if rule.cross_length:
        bound = apart[0] + apart[1] if length > 1 else np.maximum(*apart)
    else:
        power = {"euclid": 2.0, "manhattan": 1.0, "minkowski": rule.p}[rule.metric]
        bound = (length // 2 * apart[0] ** power + (length - length // 2) * apart[1] ** power) ** (1.0 / power)
    return bound <= rule.radius(length) * (1 + 1e-9) + 1e-9 * (1 + np.abs(features).max())


def _routing(rule: _Rule) -> Routing:
    """Sends the windows of work rows to the blocks of patterns that their features reach.

    A row that goes to a block lists only the windows that reach it, and the values these need.
    """

    def route(rows: DataFrame, blocks: list[Block]) -> DataFrame:
        by_length: dict[int | None, list[Block]] = {}
        for block in blocks:
            by_length.setdefault(block.length, []).append(block)
        fields = from_arrow_schema(_ROUTED)

        def run(batches):
            for whole in batches:
                batch = _Batch(whole)
                items = whole.column("items").flatten()
                offsets = K.offsets_and_values(whole.column("values"))[0]
                seg_start = whole.column("seg_start").to_numpy()
                for n in np.unique(batch.length).tolist():
                    chosen = np.flatnonzero(batch.length == n)
                    size = K.tile_rows(n)
                    tiles = [chosen[i : i + size] for i in range(0, len(chosen), size)]
                    features = np.hstack([_window_features(rule, batch.flat[batch.at[t][:, None] + np.arange(n)]) for t in tiles])
                    for block in by_length.get(None if rule.cross_length else n, ()):
                        index = chosen[_reaches(rule, features, n, block)]
                        if not len(index):
                            continue
                        row = batch.row[index]
                        cut = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                        at = batch.at[index]
                        first, last = np.minimum.reduceat(at, cut), np.maximum.reduceat(at, cut)
                        lengths = last - first + n
                        ends = np.cumsum(lengths)
                        places = np.repeat(first - (ends - lengths), lengths) + np.arange(int(ends[-1]))
                        owner = row[cut]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(cut), block.number, np.int32)),
                                whole.column("series_id").take(pa.array(owner)),
                                pa.array(seg_start[owner] + first - offsets[owner]),
                                pa.array(np.full(len(cut), n, np.int32)),
                                pa.ListArray.from_arrays(
                                    pa.array(np.append(cut, len(index)).astype(np.int32)), items.take(pa.array(index))
                                ),
                                pa.ListArray.from_arrays(
                                    pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(batch.flat[places])
                                ),
                            ],
                            names=_ROUTED.names,
                        )

        return rows.select(*_ROUTED.names[1:]).mapInArrow(run, fields)

    return Routing(_pattern_features(rule), not rule.cross_length, route)


def _uncovered(source, known: DataFrame, rule: _Rule, low: float, high: float, limits: dict) -> DataFrame:
    """Windows of a stretch of the order that no pattern covers, with their values."""
    digest = F.lower(F.hex("key"))
    if cells(known) <= limits["broadcast_cells"]:
        if high >= 1.0 and low <= COMPARED_AGAIN and isinstance(source, _Windows):
            # the windows before the stretch are covered, so all may be compared, and only the uncovered ones are hashed
            found = score(source.unkeyed(), known, _prepare_open(rule, 0.0, 1.0), _OPEN, **limits)
            return source.keyed(found).where(digest >= _hex_bound(low))
        return score(source.rows(low, high), known, _prepare_open(rule, low, high), _OPEN, **limits)
    rows = source.rows(low, high)
    covered = score(rows, known, _prepare_covered(rule, low, high), _COVERED, routing=_routing(rule), **limits)
    stretch = _flat(rows)
    if low > 0:
        stretch = stretch.where(digest >= _hex_bound(low))
    if high < 1:
        stretch = stretch.where(digest < _hex_bound(high))
    ids = ["series_id", "length", "start"]
    return stretch.join(covered.select(*ids), ids, "left_anti").select(*_OPEN.names)


def _prepare_assign(rule: _Rule):
    """Kernel: the nearest pattern within the radius among those that existed."""

    def prepare(table: pa.Table):
        patterns = _Patterns.by_length(table, rule)

        def run(batch: pa.RecordBatch) -> pa.Table:
            parts, batch = [], _Batch(batch)
            for tile in _tiles(batch, rule, patterns):
                found, radius = [], np.full(len(tile.values), tile.radius) if rule.cross_length else tile.radius
                for s, (pattern, part) in enumerate(tile.slices):
                    allowed = _earlier(pattern, part, tile, strict=False)
                    keys = [pattern.grp[part], pattern.hi[part], pattern.lo[part]]
                    i, j, d = K.nearest(tile.values, pattern.values[part], radius, allowed, keys, rule.metric, rule.p)
                    if rule.cross_length:
                        radius[i] = d  # none farther than the nearest so far is looked for
                    same, number = np.full(len(i), pattern.length, np.int32), pattern.no[part][j]
                    found.append((i, d, keys[0][j], same, keys[1][j], keys[2][j], number, np.full(len(i), s), j + part.start))
                if not found:
                    continue
                i, d, grp, m, hi, lo, no, where, j = (np.concatenate(c) for c in zip(*found))
                rank = np.lexsort((lo, hi, m, grp, d, i))
                first = rank[np.unique(i[rank], return_index=True)[1]]
                i, where, j = i[first], where[first], j[first]
                keys = pa.concat_arrays([p.key.take(pa.array(j[where == s])) for s, (p, _) in enumerate(tile.slices)])
                # keys stand slice by slice; put them back in the order of the windows
                keys = keys.take(pa.array(np.argsort(np.argsort(where, kind="stable"), kind="stable")))
                parts.append(
                    batch.identify(tile.index[i], tile.length) + [d[first], grp[first], m[first], keys, no[first]]
                )
            return _table(_ASSIGNED, parts)

        return run

    return prepare


def _prepare_earliest(rule: _Rule):
    """Kernel: the earliest of the earlier windows within the radius, for windows that have one."""

    def prepare(table: pa.Table):
        patterns = _Patterns.by_length(table, rule)
        order = {n: np.lexsort((p.lo, p.hi)) for n, p in patterns.items()}
        place = {n: np.argsort(o) for n, o in order.items()}

        def run(batch: pa.RecordBatch) -> pa.Table:
            parts, batch = [], _Batch(batch)
            for tile in _tiles(batch, rule, patterns):
                n = tile.length
                if n not in patterns:
                    continue
                none = len(order[n])
                best = np.full(len(tile.values), none)
                for pattern, part in tile.slices:
                    if pattern.length != n:
                        continue
                    other, places = pattern.values[part], place[n][part]
                    rough, error, limit = K.rough_matrix(tile.values, other, tile.radius, rule.metric, rule.p)
                    able = (rough <= limit + error) & (places < best[:, None]) & _earlier(pattern, part, tile, strict=True)
                    # the first of the able ones is nearly always within the radius; where it is not, the next is tried
                    left, waiting = np.arange(len(best)), np.where(able, places, none)
                    while len(left):
                        j = waiting[left].argmin(axis=1)
                        some = waiting[left, j] < none
                        left, j = left[some], j[some]
                        hit = K.pair_distance(tile.values[left], other[j], rule.metric, rule.p) <= tile.radius
                        best[left[hit]] = places[j[hit]]
                        left, j = left[~hit], j[~hit]
                        waiting[left, j] = none
                found = np.flatnonzero(best < none)
                if len(found):
                    earliest = pa.array(order[n][best[found]])
                    parts.append([batch.key.take(pa.array(tile.index[found])), patterns[n].key.take(earliest)])
            return _table(_WAITS, parts)

        return run

    return prepare


def _settle_in_groups(open_: DataFrame, rule: _Rule) -> DataFrame:
    """Representatives among uncovered windows when each length's fit one task."""

    def settle(table: pa.Table) -> pa.Table:
        hi, lo = K.key_words(table["key"].combine_chunks())
        rank = np.lexsort((lo, hi))
        n = int(table["length"][0].as_py())
        values = K.offsets_and_values(table["values"])[1].reshape(-1, n)[rank]
        chosen = K.leaders(values, rule.radius(n), rule.metric, rule.p)
        return table.take(pa.array(rank[chosen])).select(_OPEN.names).cast(_OPEN)

    return open_.groupBy("length").applyInArrow(settle, from_arrow_schema(_OPEN))


def _settle_in_rounds(open_: DataFrame, rule: _Rule, limits: dict) -> DataFrame:
    """The same for any number of windows, by rounds.

    Each undecided window waits for the earliest undecided one within its radius. A window that waits for none is a
    representative; the others are compared with the new representatives, and those near one are covered. Of the
    rest, only windows whose earliest neighbour was covered look for the next one. A round writes at most one row
    a window, however many neighbours it has.
    """

    def against(rows: DataFrame, patterns: DataFrame, prepare, result: pa.Schema) -> DataFrame:
        patterns = patterns.withColumn("grp", F.lit(1)).withColumn("no", F.lit(0).cast("long"))
        return score(_single(rows), patterns, prepare, result, routing=_routing(rule), **limits)

    asking = undecided = open_
    waits = chosen = None
    while True:
        found = against(asking, undecided, _prepare_earliest(rule), _WAITS).groupBy("key").agg(F.min("early_key").alias("early_key"))
        waits = materialise(found if waits is None else waits.unionByName(found), "round-waits")
        fresh = materialise(undecided.join(waits, "key", "left_anti").select(*_OPEN.names), "round-reps")
        chosen = fresh if chosen is None else chosen.unionByName(fresh)
        rest = undecided.join(waits, "key", "left_semi")
        covered = materialise(against(rest, fresh, _prepare_covered(rule, 0.0, 1.0), _COVERED).select("key").distinct(), "round-covered")
        undecided = materialise(rest.join(covered, "key", "left_anti").select(*_OPEN.names), "round-open")
        if undecided.isEmpty():
            return chosen
        early = undecided.select(F.col("key").alias("early_key"))
        waits = waits.join(undecided, "key", "left_semi").join(early, "early_key", "left_semi").select("key", "early_key")
        waits = materialise(waits, "round-kept")
        asking = undecided.join(waits, "key", "left_anti")


def _find_representatives(source, rule: _Rule, seeds: DataFrame | None, sizes: dict) -> DataFrame | None:
    """Written table of new representatives among the windows of ``source``."""
    limits = {k: sizes[k] for k in ("broadcast_cells", "block_cells")}
    found: DataFrame | None = None
    low, high = 0.0, min(1.0, sizes["first_prefix"] / max(1, source.most))
    while True:
        known = found if seeds is None else seeds if found is None else seeds.unionByName(found)
        if known is None:
            # nothing to compare with yet: the stretch competes as a whole
            open_ = source.first(high)
            largest = source.most * high
        else:
            open_ = materialise(_uncovered(source, known, rule, low, high, limits), "open")
            largest = open_.groupBy("length").count().agg(F.max("count")).first()[0] or 0
        if largest:
            if largest <= sizes["group_items"]:
                fresh = _settle_in_groups(open_, rule)
            else:
                fresh = _settle_in_rounds(open_ if known is not None else materialise(open_, "open"), rule, limits)
            fresh = materialise(fresh.withColumn("grp", F.lit(1)).withColumn("no", F.lit(0).cast("long")), "reps")
            found = fresh if found is None else found.unionByName(fresh)
        if high >= 1.0:
            return found
        growth = GROWTH
        if known is not None:
            growth = min(MOST_GROWTH, max(2, sizes["group_items"] // max(1, largest)))
        low, high = high, min(1.0, high * growth)


def _number(reps: DataFrame) -> DataFrame:
    """Fill ``no``: the creation number within the length.

    The order key is a hash, so each first byte holds an equal share; these slices are
    counted, then numbered inside, and no length is ever sorted in one task.
    """
    reps = reps.drop("no").withColumn("_slice", F.substring("key", 1, 1))
    by_length = W.partitionBy("length").orderBy("grp", "_slice").rowsBetween(W.unboundedPreceding, -1)
    before = (
        reps.groupBy("length", "grp", "_slice")
        .count()
        .select("length", "grp", "_slice", F.coalesce(F.sum("count").over(by_length), F.lit(0)).alias("_before"))
    )
    inside = F.row_number().over(W.partitionBy("length", "grp", "_slice").orderBy("key")) - 1
    return (
        reps.withColumn("_inside", inside)
        .join(before, ["length", "grp", "_slice"])
        .withColumn("no", F.col("_before") + F.col("_inside"))
        .drop("_slice", "_before", "_inside")
    )


def _nearest_of_blocks(found: DataFrame) -> DataFrame:
    best = F.min(F.struct(*[n for n in _ASSIGNED.names if n not in _IDS])).alias("b")
    return found.groupBy(*_IDS).agg(best).select(*_IDS, "b.*")


def _assign(rows: DataFrame, reps: DataFrame, rule: _Rule, limits: dict) -> DataFrame:
    """Nearest representative of every window that has one within the radius."""
    return score(rows, reps, _prepare_assign(rule), _ASSIGNED, combine=_nearest_of_blocks, routing=_routing(rule), **limits)


def _clusters(assigned: DataFrame) -> DataFrame:
    return assigned.select(
        "length",
        F.concat_ws("_", "rep_length", "rep_no").alias("cluster_id"),
        "series_id",
        "start",
        (F.col("start") + F.col("length")).alias("end"),
        (F.col("key") == F.col("rep_key")).alias("is_rep"),
        F.col("dist").alias("rep_dist"),
    )


def _with_lone(reps: DataFrame | None, lone: DataFrame | None) -> DataFrame | None:
    if lone is None:
        return reps
    return lone if reps is None else reps.unionByName(lone)


def _comparable(reps: DataFrame) -> DataFrame:
    return reps.where(F.col("values").isNotNull())


def _on_its_own(reps: DataFrame) -> DataFrame:
    """Lone windows of numbered representatives, assigned to themselves."""
    return reps.where(F.col("values").isNull()).select(
        *_IDS, F.lit(0.0).alias("dist"), "grp", F.col("length").alias("rep_length"), F.col("key").alias("rep_key"), F.col("no").alias("rep_no")
    )


def _no_clusters(segments: DataFrame) -> DataFrame:
    """The result when no series has a window of the lengths asked for."""
    return _clusters(segments.sparkSession.createDataFrame([], from_arrow_schema(_ASSIGNED)))


class _Windows:
    """All windows of a range of lengths, spread for the work ahead.

    ``most`` is the largest number of windows of one length.
    """

    def __init__(self, segments, shortest, longest, seed, include_last, most=None):
        self.args = (shortest, longest, seed, include_last)
        if most is None:
            segments = with_bad_points(segments)
            sums = F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max(F.size("bad")), F.lit(0))
            most, bad = lengths_of(segments, shortest, shortest, include_last, "bad").agg(*sums).first()
            self.some_bad = bad > 0
            # little data may sit in fewer partitions than there are cores
            cores = segments.sparkSession.sparkContext.defaultParallelism
            segments = segments if most > cores * 1_000_000 else segments.repartition(cores)
        self.segments, self.most = segments, most

    def only(self, length: int) -> "_Windows":
        return _Windows(self.segments, length, length, *self.args[2:], most=self.most)

    def rows(self, low: float = 0.0, high: float = 1.0) -> DataFrame:
        # a small share comes window by window: faster to hash, and with few values a point
        if high < 1 and (high - low) * self.args[1] <= FLAT_VALUES:
            return _single(first_windows(self.segments, *self.args, high, low))
        return work_rows(self.segments, *self.args, low, high)

    def unkeyed(self) -> DataFrame:
        """All windows, with zeros for keys."""
        return unkeyed_rows(self.segments, *self.args)

    def keyed(self, windows: DataFrame) -> DataFrame:
        """The keys of windows that have zeros for them."""
        digest = priority(self.args[2], F.col("series_id"), F.col("start"), F.col("start") + F.col("length"))
        return windows.withColumn("key", F.unhex(digest))

    def lone(self) -> DataFrame | None:
        """Windows that no distance reaches, written; None when all values are finite."""
        return materialise(lone_windows(self.segments, *self.args), "lone") if self.some_bad else None

    def first(self, high: float) -> DataFrame:
        return first_windows(self.segments, *self.args, high)


class _Listed:
    """Windows given as written work rows."""

    def __init__(self, rows: DataFrame):
        self.listed = rows
        sizes = rows.groupBy("length").agg(F.sum(F.size("items")).alias("n"))
        self.most = sizes.agg(F.max("n")).first()[0] or 0

    def rows(self, low: float = 0.0, high: float = 1.0) -> DataFrame:
        return self.listed


def _sizes(sizes: dict, longest: int) -> dict:
    fit = max(1, GROUP_CELLS // max(1, longest))
    base = {
        "first_prefix": min(FIRST_PREFIX, fit),
        "group_items": min(GROUP_ITEMS, fit),
        "broadcast_cells": BROADCAST_CELLS,
        "block_cells": BLOCK_CELLS,
    }
    return base | sizes


def leader_clusters(
    segments: DataFrame,
    shortest: int,
    longest: int,
    st: float,
    seed: int = 0,
    metric: str = "eu",
    p: float = 2.0,
    include_last: bool = False,
    **sizes: int,
) -> DataFrame:
    """Cluster all windows of the given lengths; every window is in one row of the result
    ``(length, cluster_id, series_id, start, end, is_rep, rep_dist)``.

    With ``metric='dtw'`` representatives are shared across lengths, shorter ones first.
    """
    rule, sizes = _Rule(st, metric, p), _sizes(sizes, longest)
    limits = {k: sizes[k] for k in ("broadcast_cells", "block_cells")}
    source = _Windows(segments, shortest, longest, seed, include_last)
    if rule.cross_length:
        # one growing table: plans do not grow with the lengths
        reps, path = None, new_path(segments.sparkSession, "warping-reps")
        for n in range(shortest, longest + 1):
            fresh = _find_representatives(source.only(n), rule, reps, sizes)
            if fresh is not None:
                write_parquet(fresh, path, mode="append")
                reps = segments.sparkSession.read.schema(fresh.schema).parquet(path)
    else:
        reps = _find_representatives(source, rule, None, sizes)
    lone = source.lone()
    reps = _with_lone(reps, lone)
    if reps is None:
        return _no_clusters(segments)
    reps = materialise(_number(reps), "reps")
    assigned = _assign(source.rows(), _comparable(reps), rule, limits)
    return _clusters(assigned if lone is None else assigned.unionByName(_on_its_own(reps)))


def two_pass_clusters(
    segments: DataFrame,
    shortest: int,
    longest: int,
    st: float,
    seed: int = 0,
    metric: str = "eu",
    p: float = 2.0,
    include_last: bool = False,
    **sizes: int,
) -> DataFrame:
    """Two-pass variant: in the first pass only a window beyond twice the radius becomes a
    representative, and one between the radius and its double waits for the second pass."""
    rule, sizes = _Rule(st, metric, p), _sizes(sizes, longest)
    if rule.cross_length:
        raise ValueError("two-pass clustering takes the metrics eu, ma and mi")
    limits = {k: sizes[k] for k in ("broadcast_cells", "block_cells")}
    source = _Windows(segments, shortest, longest, seed, include_last)
    lone = source.lone()
    first = _with_lone(_find_representatives(source, rule.times(2.0), None, sizes), lone)
    if first is None:
        return _no_clusters(segments)
    first = materialise(_number(first), "reps")
    placed = _assign(source.rows(), _comparable(first), rule.times(2.0), limits)
    placed = materialise(placed if lone is None else placed.unionByName(_on_its_own(first)), "pass-one")

    def radius(length: Column) -> Column:
        return F.sqrt(length.cast("double")) * F.lit(float(st)) / 2

    near = F.col("dist") <= radius(F.col("length"))
    waiting = placed.where(~near)
    if waiting.isEmpty():
        return _clusters(placed)
    segment = F.col("start") - F.col("start") % layout(segments)[0]
    grouped = (
        waiting.withColumn("seg_start", segment)
        .groupBy("series_id", "seg_start", "length")
        .agg(F.collect_list(F.struct("start", "key")).alias("items"))
        .join(source.segments.select("series_id", "seg_start", "values"), ["series_id", "seg_start"])
    )
    rows = materialise(grouped, "waiting")
    seeds = first.withColumn("grp", F.lit(0))
    second = _find_representatives(_Listed(rows), rule, _comparable(seeds), sizes)
    every = seeds if second is None else seeds.unionByName(second)
    every = materialise(_number(every), "reps")
    settled = _assign(rows, _comparable(every), rule, limits)
    return _clusters(placed.where(near).unionByName(settled))


def cluster_counts(clusters: DataFrame) -> DataFrame:
    """Clusters per length, and in total in the row whose length is null."""
    return (
        clusters.where("is_rep")
        .rollup("length")
        .agg(F.count(F.lit(1)).alias("clusters"))
    )
