"""Plain loops that state what the operators must return."""

import hashlib
import math


def dtw(a, b, cost="abs"):
    inf = float("inf")
    row = [0.0] + [inf] * len(b)
    for x in a:
        new = [inf]
        for j, y in enumerate(b):
            c = abs(x - y) if cost == "abs" else (x - y) * (x - y)
            new.append(c + min(row[j], row[j + 1], new[j]))
        row = new
    return row[-1] if cost == "abs" else math.sqrt(row[-1])


def distance(a, b, metric, p=2.0):
    if metric == "dtw":
        return dtw(a, b)
    if metric == "eu":
        total = 0.0
        for x, y in zip(a, b):
            total += (x - y) * (x - y)
        return math.sqrt(total)
    if metric == "ma":
        total = 0.0
        for x, y in zip(a, b):
            total += abs(x - y)
        return total
    total = 0.0
    for x, y in zip(a, b):
        total += abs(x - y) ** p
    return total ** (1.0 / p)


def windows(series, shortest, longest, include_last=False):
    for name, values in series.items():
        for start in range(len(values)):
            for length in range(shortest, longest + 1):
                if start + length < len(values) + (1 if include_last else 0):
                    yield length, name, start, values[start : start + length]


def ordered(series, shortest, longest, seed, include_last=False):
    """Windows by length in processing order: (digest, name, start, values)."""
    groups = {}
    for length, name, start, values in windows(series, shortest, longest, include_last):
        text = f"{seed}|{name}|{start}|{start + length}"
        digest = hashlib.md5(text.encode()).hexdigest()
        groups.setdefault(length, []).append((digest, name, start, values))
    return {n: sorted(groups[n]) for n in sorted(groups)}


def leader(series, shortest, longest, st, seed, metric="eu", p=2.0, include_last=False):
    """Rows (length, cluster_id, series_id, start, is_rep, dist)."""
    rows, shared = [], []
    for length, items in ordered(series, shortest, longest, seed, include_last).items():
        radius = math.sqrt(length) * st / 2
        reps = shared if metric == "dtw" else []
        count = 0
        for _, name, start, values in items:
            best = None
            for cid, other in reps:
                d = distance(values, other, metric, p)
                if best is None or d < best[0]:
                    best = (d, cid)
            if best is not None and best[0] <= radius:
                rows.append((length, best[1], name, start, False, best[0]))
            else:
                cid = f"{length}_{count}"
                count += 1
                reps.append((cid, values))
                rows.append((length, cid, name, start, True, 0.0))
    return sorted(rows)


def two_pass(series, shortest, longest, st, seed, metric="eu", p=2.0):
    rows = []
    for length, items in ordered(series, shortest, longest, seed).items():
        radius = math.sqrt(length) * st / 2
        reps, waiting = [], []

        def place(item, limit):
            _, name, start, values = item
            best = None
            for cid, other in reps:
                d = distance(values, other, metric, p)
                if best is None or d < best[0]:
                    best = (d, cid)
            if best is not None and best[0] <= radius:
                rows.append((length, best[1], name, start, False, best[0]))
            elif best is not None and best[0] <= limit:
                waiting.append(item)
            else:
                cid = f"{length}_{len(reps)}"
                reps.append((cid, values))
                rows.append((length, cid, name, start, True, 0.0))

        for item in items:
            place(item, radius * 2)
        for item in list(waiting):
            place(item, radius)
    return sorted(rows)
