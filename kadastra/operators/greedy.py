"""Steps whose result depends on the order of the rows: grouped pandas functions, one page or style a group.

A group is a page (or the segments of one style on a page), which is bounded by what a sheet can show.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.geometry import clip, ring_area


def dedup_boxes(df: DataFrame, keys: list[str], ratio: float = 0.98, near: float = 10.0) -> DataFrame:
    """Largest first: a box is dropped when a kept one has an area ratio over ``ratio`` and sides within ``near``;
    the kept one takes over a fill it lacks.  ``df``: keys, id, x0 y0 x1 y1, fill (long, may be null)."""
    schema = ", ".join(f"{k} {t}" for k, t in df.dtypes if k in keys) + ", id long, fill long"

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.assign(area=(g.x1 - g.x0) * (g.y1 - g.y0)).sort_values(["area", "id"], ascending=[False, True])
        kept: list[list] = []
        for r in g.itertuples():
            for k in kept:
                s = k[0]
                big = max(s.area, r.area)
                if (big == 0 or min(s.area, r.area) / big > ratio) and all(abs(getattr(s, c) - getattr(r, c)) < near for c in ("x0", "y0", "x1", "y1")):
                    if pd.isna(k[1]) and not pd.isna(r.fill):
                        k[1] = r.fill
                    break
            else:
                kept.append([r, r.fill])
        out = pd.DataFrame({"id": [k[0].id for k in kept], "fill": pd.array([None if pd.isna(k[1]) else int(k[1]) for k in kept], "Int64")})
        for k in keys[::-1]:
            out.insert(0, k, g[k].iloc[0])
        return out

    return df.groupBy(*keys).applyInPandas(run, schema)


def skip_overlaps(df: DataFrame, keys: list[str], share: float = 0.2) -> DataFrame:
    """In order of id: a box is dropped when more than ``share`` of it lies on an earlier kept one."""
    schema = ", ".join(f"{k} {t}" for k, t in df.dtypes if k in keys) + ", id long"

    def run(g: pd.DataFrame) -> pd.DataFrame:
        kept: list = []
        for r in g.sort_values("id").itertuples():
            own = (r.x1 - r.x0) * (r.y1 - r.y0)
            over = any(
                max(0, min(r.x1, k.x1) - max(r.x0, k.x0)) * max(0, min(r.y1, k.y1) - max(r.y0, k.y0)) > share * own for k in kept
            )
            if not over:
                kept.append(r)
        return g[g["id"].isin([k.id for k in kept])][[*keys, "id"]]

    return df.groupBy(*keys).applyInPandas(run, schema)


def cluster(df: DataFrame, keys: list[str], radius: float = 80.0) -> DataFrame:
    """Greedy clusters of two or more shapes (id, cx, cy, area): the largest free shape takes all free ones within
    ``radius``; clusters are numbered by size."""
    schema = ", ".join(f"{k} {t}" for k, t in df.dtypes if k in keys) + ", id long, cluster int"

    def run(g: pd.DataFrame) -> pd.DataFrame:
        left = list(g.sort_values(["area", "id"], ascending=[False, True]).itertuples())
        groups = []
        while left:
            head = left[0]
            own = [r for r in left if math.dist((r.cx, r.cy), (head.cx, head.cy)) <= radius]
            left = [r for r in left if r not in own]
            if len(own) > 1:
                groups.append([r.id for r in own])
        groups.sort(key=lambda x: (-len(x), min(x)))
        rows = [(i, n) for n, ids in enumerate(groups) for i in ids]
        out = pd.DataFrame({"id": pd.Series([i for i, _ in rows], dtype="int64"), "cluster": pd.Series([n for _, n in rows], dtype="int32")})
        for k in keys[::-1]:
            out.insert(0, k, g[k].iloc[0])
        return out

    return df.groupBy(*keys).applyInPandas(run, schema)


def chain(df: DataFrame, keys: list[str], gap: float = 8.0, least: int = 5) -> DataFrame:
    """Segments (id, x0 y0 x1 y1) of a style group joined end to end, nearest end within ``gap`` first; groups of fewer
    than ``least`` segments give nothing.  One row a chain: its segments, points and whether it closes.  Ends are found
    by grid cell, so a group takes time in proportion to its segments."""
    schema = ", ".join(f"{k} {t}" for k, t in df.dtypes if k in keys) + ", chain int, n_segments int, closed boolean, points array<array<double>>"

    def run(g: pd.DataFrame) -> pd.DataFrame:
        segs = [(r.id, (r.x0, r.y0), (r.x1, r.y1)) for r in g.sort_values("id").itertuples()] if len(g) >= least else []
        cells: dict[tuple, set] = {}

        def cell(p):
            return int(p[0] // gap), int(p[1] // gap)

        for i, (_, a, b) in enumerate(segs):
            for e, p in ((0, a), (1, b)):
                cells.setdefault(cell(p), set()).add((i, e))
        used = [False] * len(segs)

        def take(i: int) -> None:
            used[i] = True
            for e, p in ((0, segs[i][1]), (1, segs[i][2])):
                cells[cell(p)].discard((i, e))

        def next_to(p):
            x, y = cell(p)
            near = [
                (math.dist(p, segs[i][1 + e]), segs[i][0], e, i)
                for dx in (-1, 0, 1) for dy in (-1, 0, 1) for i, e in cells.get((x + dx, y + dy), ())
            ]
            near = [n for n in near if n[0] < gap]
            return min(near) if near else None

        rows = []
        for i in range(len(segs)):
            if used[i]:
                continue
            take(i)
            pts, n = [segs[i][1], segs[i][2]], 1
            for front in (False, True):
                while hit := next_to(pts[0] if front else pts[-1]):
                    _, _, e, j = hit
                    take(j)
                    n += 1
                    a, b = (segs[j][1], segs[j][2]) if e == 0 else (segs[j][2], segs[j][1])
                    new = [b] if math.dist(a, pts[0] if front else pts[-1]) == 0 else [a, b]
                    pts = [*new[::-1], *pts] if front else [*pts, *new]
            rows.append((len(rows), n, len(pts) > 3 and math.dist(pts[0], pts[-1]) < gap, [list(map(float, p)) for p in pts]))
        out = pd.DataFrame(rows, columns=["chain", "n_segments", "closed", "points"])
        for k in keys[::-1]:
            out.insert(0, k, g[k].iloc[0])
        return out

    return df.groupBy(*keys).applyInPandas(run, schema)


def faces(df: DataFrame, keys: list[str], grid: float = 2.0, least: float = 1.0) -> DataFrame:
    """Faces of the planar graph of segments whose ends are snapped to a grid: half-edges are walked, next is the
    clockwise neighbour; the outer face goes, and so does a face over three times the second largest."""
    schema = ", ".join(f"{k} {t}" for k, t in df.dtypes if k in keys) + ", face int, area double, points array<array<double>>"

    def run(g: pd.DataFrame) -> pd.DataFrame:
        def snap(x, y):
            return round(x / grid) * grid, round(y / grid) * grid

        around: dict[tuple, set] = {}
        for r in g.itertuples():
            a, b = snap(r.x0, r.y0), snap(r.x1, r.y1)
            if a != b:
                around.setdefault(a, set()).add(b)
                around.setdefault(b, set()).add(a)
        order = {v: sorted(n, key=lambda p, v=v: (math.atan2(p[1] - v[1], p[0] - v[0]), p)) for v, n in around.items()}
        place = {v: {p: i for i, p in enumerate(n)} for v, n in order.items()}
        seen, found = set(), []
        for u in sorted(order):
            for v in order[u]:
                if (u, v) in seen:
                    continue
                ring, a, b = [], u, v
                while (a, b) not in seen:
                    seen.add((a, b))
                    ring.append(a)
                    n = order[b]
                    a, b = b, n[(place[b][a] - 1) % len(n)]
                size = ring_area(ring)
                if len(ring) > 2 and size > least:  # the outer side turns the other way
                    found.append((size, ring))
        found.sort(key=lambda f: (-f[0], f[1]))
        if len(found) > 1 and found[0][0] > 3 * found[1][0]:
            found = found[1:]
        out = pd.DataFrame(
            [(i, float(s), [list(map(float, p)) for p in r]) for i, (s, r) in enumerate(found)], columns=["face", "area", "points"]
        )
        for k in keys[::-1]:
            out.insert(0, k, g[k].iloc[0])
        return out

    return df.groupBy(*keys).applyInPandas(run, schema)


def gaps(df: DataFrame, keys: list[str], least: float = 1e-4) -> DataFrame:
    """Parts of the plot no zone covers, as boxes of the grid its zones' sides span; small parts go.
    ``df``: keys, role ('plot' or 'zone'), x0 y0 x1 y1."""
    schema = ", ".join(f"{k} {t}" for k, t in df.dtypes if k in keys) + ", x0 double, y0 double, x1 double, y1 double"

    def run(g: pd.DataFrame) -> pd.DataFrame:
        plots, zones = g[g.role == "plot"], g[g.role == "zone"]
        rows = []
        for p in plots.itertuples():
            xs = sorted({p.x0, p.x1} | {x for x in [*zones.x0, *zones.x1] if p.x0 < x < p.x1})
            ys = sorted({p.y0, p.y1} | {y for y in [*zones.y0, *zones.y1] if p.y0 < y < p.y1})
            for y0, y1 in zip(ys, ys[1:], strict=False):
                band = zones[(zones.y0 <= y0) & (zones.y1 >= y1)]
                start = None
                for x0, x1 in [*zip(xs, xs[1:], strict=False), (xs[-1], None)]:
                    free = x1 is not None and not ((band.x0 <= x0) & (band.x1 >= x1)).any()
                    if free and start is None:
                        start = x0
                    elif not free and start is not None:
                        if (x0 - start) * (y1 - y0) > least * (p.x1 - p.x0) * (p.y1 - p.y0):
                            rows.append((float(start), float(y0), float(x0), float(y1)))
                        start = None
        out = pd.DataFrame(rows, columns=["x0", "y0", "x1", "y1"], dtype=float)
        for k in keys[::-1]:
            out.insert(0, k, g[k].iloc[0])
        return out

    return df.groupBy(*keys).applyInPandas(run, schema)


def layout(df: DataFrame, keys: list[str], spacing: float = 6.0) -> DataFrame:
    """Rows of equal buildings along the longest edge of an envelope, clipped to it; parts under three tenths of a
    building go.  ``df``: keys, points (convex ring), target (area), width."""
    schema = ", ".join(f"{k} {t}" for k, t in df.dtypes if k in keys) + ", building int, area double, points array<array<double>>"

    def run(g: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in g.itertuples():
            ring = [tuple(map(float, p)) for p in r.points]
            edges = sorted(zip(ring, ring[1:] + ring[:1], strict=True), key=lambda e: (-math.dist(*e), e))
            (ax, ay), (bx, by) = edges[0]
            t = math.atan2(by - ay, bx - ax)
            cx, cy = (sum(p[i] for p in ring) / len(ring) for i in (0, 1))

            def turn(p, angle, cx=cx, cy=cy):
                x, y = p[0] - cx, p[1] - cy
                return cx + x * math.cos(angle) - y * math.sin(angle), cy + x * math.sin(angle) + y * math.cos(angle)

            flat = [turn(p, -t) for p in ring]
            n = min(4, max(1, round(r.target / (r.width * 35))))
            long = min(50.0, max(15.0, r.target / (n * r.width)))
            total = n * long + (n - 1) * spacing
            x = (min(p[0] for p in flat) + max(p[0] for p in flat) - total) / 2
            y = (min(p[1] for p in flat) + max(p[1] for p in flat)) / 2
            for _ in range(n):
                box = [(x, y - r.width / 2), (x + long, y - r.width / 2), (x + long, y + r.width / 2), (x, y + r.width / 2)]
                part = clip(box, flat)
                size = abs(ring_area(part)) if len(part) > 2 else 0.0
                if size >= 0.3 * long * r.width:
                    rows.append((len(rows), size, [list(turn(p, t)) for p in part]))
                x += long + spacing
        out = pd.DataFrame(rows, columns=["building", "area", "points"])
        for k in keys[::-1]:
            out.insert(0, k, g[k].iloc[0])
        return out

    return df.groupBy(*keys).applyInPandas(run, schema)
