"""Pairs of polygons over flat buffers: how they relate, the area they share and the polygons of what they share.

Edges of one polygon of a pair are cut wherever they meet the other's, and each part is inside the other, outside it, or runs along
its boundary in the same or the opposite direction. With shells anticlockwise and holes clockwise all else follows from these
classes: parts inside and one copy of those that run the same way are the boundary of what is shared. All pairs of a batch are
worked on at once; the work is taken in portions of MOST pairs of edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

INSIDE, OUTSIDE, SAME, OPPOSITE = range(4)
#: Pairs of edges that are worked on at once.
MOST = 1 << 18


class Shapes:
    """Edges (x, y, x, y) of many polygons one after the other, shells anticlockwise and holes clockwise; edges without length
    are left out. begin has the first edge of each polygon, and the number of all."""

    def __init__(self, rows: np.ndarray, ends: np.ndarray, points: np.ndarray):
        """What geometry_udf.flat() gives: rings up to each row, points up to each ring, points."""
        start = np.ones(len(points), bool)
        start[ends[:-1][ends[:-1] < len(points)]] = False
        last = np.flatnonzero(start)  # every point but the first of a ring ends an edge
        ring = np.searchsorted(ends, last, "right") - 1
        e = np.concatenate([points[last - 1], points[last]], 1)
        nth = ring - rows[np.searchsorted(rows, ring, "right") - 1]
        middle = points[ends[:-1]][ring] if len(ring) else np.zeros((0, 2))  # areas of far shapes lose no digits
        x, y, u, v = (e - np.concatenate([middle, middle], 1)).T
        area = np.bincount(ring, x * v - u * y, minlength=len(ends) - 1)
        turned = (area[ring] < 0) == (nth == 0)
        e[turned] = e[turned][:, [2, 3, 0, 1]]
        long = (e[:, :2] != e[:, 2:]).any(1)
        self.edges = e[long]
        self.begin = np.append(0, np.cumsum(long))[np.searchsorted(ring, rows)]
        self.box = np.full((len(rows) - 1, 4), np.nan)
        some = np.flatnonzero(np.diff(self.begin) > 0)
        at = self.begin[some]
        for k, (column, end) in enumerate(((0, np.minimum), (1, np.minimum), (0, np.maximum), (1, np.maximum))):
            if len(some):
                self.box[some, k] = end.reduceat(end(self.edges[:, column], self.edges[:, column + 2]), at)


def ragged(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) for each i and each j of start[i], ..., start[i] + count[i] - 1."""
    i = np.repeat(np.arange(len(count)), count)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(count) - count - start, count)


def portions(count: np.ndarray) -> Iterator[slice]:
    """Slices of rows with about MOST counts together, at least a row each."""
    total, lo = np.cumsum(count), 0
    while lo < len(count):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + MOST, "right")))
        yield slice(lo, hi)
        lo = hi


def along(e: np.ndarray, f: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Whether each edge of f lies on the line of that of e, within the distance near."""
    r = e[:, 2:] - e[:, :2]
    off = lambda p: np.abs(r[:, 0] * (p[:, 1] - e[:, 1]) - r[:, 1] * (p[:, 0] - e[:, 0]))
    n = near * np.hypot(r[:, 0], r[:, 1])
    return (off(f[:, :2]) <= n) & (off(f[:, 2:]) <= n)


class Parts:
    """Parts of edges: the pair, the part (x, y, x, y) and its class."""

    def __init__(self, pair: np.ndarray, e: np.ndarray, kind: np.ndarray):
        self.pair, self.e, self.kind = pair, e, kind

    def any(self, n: int, *kinds: int) -> np.ndarray:
        return np.bincount(self.pair[np.isin(self.kind, kinds)], minlength=n) > 0


class Overlay:
    """The pairs (a[i], b[i]) of polygons of two sets, cut by each other.

    Coordinates are taken from the corner of the boxes' overlap, so that areas of far polygons lose no digits. Points closer than
    1e-12 of a pair's largest coordinate are one."""

    def __init__(self, first: Shapes, second: Shapes, a: np.ndarray, b: np.ndarray):
        self.n = len(a)
        p, q = first.box[a], second.box[b]
        low, high = np.maximum(p[:, :2], q[:, :2]), np.minimum(p[:, 2:], q[:, 2:])
        self.corner = np.where(np.isfinite(low), low, 0)
        self.near = 1e-12 * np.maximum(np.nanmax(np.abs(np.concatenate([p, q, np.zeros((self.n, 1))], 1)), axis=1), 1e-300)
        sides = []
        for shapes, rows in ((first, a), (second, b)):
            pair, at = ragged(shapes.begin[rows], shapes.begin[rows + 1] - shapes.begin[rows])
            e = shapes.edges[at]
            d = self.near[pair]
            meets = [(np.minimum(e[:, k], e[:, k + 2]) <= high[pair, k] + d) & (np.maximum(e[:, k], e[:, k + 2]) >= low[pair, k] - d) for k in (0, 1)]
            beyond = np.bincount(pair[~(meets[0] & meets[1])], minlength=self.n) > 0  # such edges are outside the other
            row = np.flatnonzero(meets[1])
            sides.append((pair[row], e[row] - np.tile(self.corner[pair[row]], 2), meets[0][row], beyond))
        self.meet = np.zeros(self.n, bool)
        self.a, self.b = self._side(*sides), self._side(*sides[::-1])
        self.a_beyond, self.b_beyond = sides[0][3], sides[1][3]

    def _side(self, own, other) -> Parts:
        """The own edges in the overlap's box, cut and told apart by the other's edges at the box's height."""
        pair, e, inside, _ = own
        pair, e = pair[inside], e[inside]
        whose, f, _, _ = other
        first = np.searchsorted(whose, np.arange(self.n + 1))
        i, t = [np.arange(len(e)), np.arange(len(e))], [np.zeros(len(e)), np.ones(len(e))]
        count = first[pair + 1] - first[pair]
        r = e[:, 2:] - e[:, :2]
        long = np.hypot(r[:, 0], r[:, 1])
        for rows in portions(count):
            k, j = ragged(first[pair[rows]], count[rows])
            k += rows.start
            d = self.near[pair[k]][:, None]
            lo, hi = (g(e[k, :2], e[k, 2:]) for g in (np.minimum, np.maximum))
            close = ((lo - d <= np.maximum(f[j, :2], f[j, 2:])) & (np.minimum(f[j, :2], f[j, 2:]) <= hi + d)).all(1)
            k, j = k[close], j[close]
            d, n = self.near[pair[k]], long[k]
            s, q = f[j, 2:] - f[j, :2], f[j, :2] - e[k, :2]
            cross = lambda u, v: u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]
            line = along(e[k], f[j], d)
            rs, m = cross(r[k], s), np.hypot(s[:, 0], s[:, 1])
            with np.errstate(divide="ignore", invalid="ignore"):
                x, y = cross(q, s) / rs, cross(q, r[k]) / rs
                hit = ~line & (rs != 0) & (x * n >= -d) & ((x - 1) * n <= d) & (y * m >= -d) & ((y - 1) * m <= d)
            ends = [(q * r[k]).sum(1) / n**2, ((q + s) * r[k]).sum(1) / n**2]
            line &= (np.maximum(*ends) * n >= -d) & ((np.minimum(*ends) - 1) * n <= d)
            self.meet[pair[k[hit | line]]] = True
            for where, at in ((hit, x), (line, ends[0]), (line, ends[1])):
                i.append(k[where])
                t.append(np.clip(at[where], 0, 1))
        i, t = np.concatenate(i), np.concatenate(t)
        order = np.lexsort((t, i))
        i, t = i[order], t[order]
        part = np.flatnonzero((i[1:] == i[:-1]) & ((t[1:] - t[:-1]) * long[i[1:]] > self.near[pair[i[1:]]]))
        i, t0, t1 = i[part], t[part][:, None], t[part + 1][:, None]
        cut = np.concatenate([e[i, :2] + t0 * r[i], e[i, :2] + t1 * r[i]], 1)
        pair = pair[i]
        x, y = (cut[:, :2] + cut[:, 2:]).T / 2
        count = first[pair + 1] - first[pair]
        kind = np.full(len(pair), OUTSIDE)
        for rows in portions(count):
            k, j = ragged(first[pair[rows]], count[rows])
            k += rows.start
            g = f[j]
            px, py, d = x[k], y[k], self.near[pair[k]]
            with np.errstate(divide="ignore", invalid="ignore"):
                right = ((g[:, 1] <= py) != (g[:, 3] <= py)) & (px < g[:, 0] + (py - g[:, 1]) / (g[:, 3] - g[:, 1]) * (g[:, 2] - g[:, 0]))
            inner = np.bincount(k[right] - rows.start, minlength=rows.stop - rows.start) % 2 == 1
            kind[rows][inner[: len(kind[rows])]] = INSIDE
            box = (np.minimum(g[:, 0], g[:, 2]) - d <= px) & (px <= np.maximum(g[:, 0], g[:, 2]) + d) & (np.minimum(g[:, 1], g[:, 3]) - d <= py) & (py <= np.maximum(g[:, 1], g[:, 3]) + d)
            k, g = k[box], g[box]
            on = along(g, cut[k], 2 * self.near[pair[k]])
            k, g = k[on], g[on]
            way = ((cut[k, 2:] - cut[k, :2]) * (g[:, 2:] - g[:, :2])).sum(1) > 0
            kind[k] = np.where(way, SAME, OPPOSITE)
        return Parts(pair, cut, kind)

    def intersects(self) -> np.ndarray:
        """Whether they share a point; touching counts."""
        return self.meet | self.overlap()

    def overlap(self) -> np.ndarray:
        """Whether they share more than boundary points."""
        return self.a.any(self.n, INSIDE, SAME) | self.b.any(self.n, INSIDE)

    def touches(self) -> np.ndarray:
        return self.meet & ~self.overlap()

    def contains(self) -> np.ndarray:
        """Whether nothing of b is outside a: no part of b's boundary is, nor runs against a's, and none of a's is within b."""
        return self.overlap() & ~self.b_beyond & ~self.b.any(self.n, OUTSIDE, OPPOSITE) & ~self.a.any(self.n, INSIDE)

    def shared(self) -> tuple[np.ndarray, np.ndarray]:
        """(pair, edge) of the boundary of what they share, anticlockwise round it."""
        own, other = np.isin(self.a.kind, (INSIDE, SAME)), self.b.kind == INSIDE
        return np.concatenate([self.a.pair[own], self.b.pair[other]]), np.concatenate([self.a.e[own], self.b.e[other]])

    def area(self) -> np.ndarray:
        pair, e = self.shared()
        return np.maximum(np.bincount(pair, (e[:, 0] * e[:, 3] - e[:, 2] * e[:, 1]) / 2, minlength=self.n), 0.0).astype(float)

    def common_boundary(self) -> np.ndarray:
        """Length along which their boundaries run together."""
        on = np.isin(self.a.kind, (SAME, OPPOSITE))
        e = self.a.e[on]
        return np.bincount(self.a.pair[on], np.hypot(e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]), minlength=self.n).astype(float)

    def polygons(self) -> list[list[list[np.ndarray]]]:
        """What each pair shares, as polygons (a shell and its holes each)."""
        pair, e = self.shared()
        order = np.argsort(pair, kind="stable")
        cuts = np.searchsorted(pair[order], np.arange(self.n + 1))
        return [assembled(e[order[lo:hi]], 4 * near, corner) for lo, hi, near, corner in zip(cuts[:-1], cuts[1:], self.near, self.corner, strict=True)]


def assembled(e: np.ndarray, near: float, corner: np.ndarray) -> list[list[np.ndarray]]:
    """Polygons whose boundary the directed edges are, their insides on the left.

    Where several edges leave a point the walk takes the one next clockwise from where it came, which keeps parts
    apart that meet in a point. Clockwise rings are holes of the smallest shell around them."""
    if not len(e):
        return []
    ends = np.concatenate([e[:, :2], e[:, 2:]])
    name = names_of(ends, near)
    tail, head = name[: len(e)], name[len(e) :]
    at = np.zeros((name.max() + 1, 2))
    at[name[::-1]] = ends[::-1]
    live = tail != head
    tail, head = tail[live], head[live]
    angle = np.arctan2(*(at[head] - at[tail]).T[::-1])
    leaving: dict[int, list[int]] = {}
    for k, p in enumerate(tail.tolist()):
        leaving.setdefault(p, []).append(k)
    used, rings = np.zeros(len(tail), bool), []
    for first in range(len(tail)):
        if used[first]:
            continue
        k, walk = first, []
        while not used[k]:
            used[k] = True
            walk.append(int(tail[k]))
            back = angle[k] + np.pi
            ways = [j for j in leaving.get(int(head[k]), ()) if not used[j] or j == first]
            if not ways:
                break
            k = min(ways, key=lambda j: (back - angle[j]) % (2 * np.pi) or 2 * np.pi)  # noqa: B023
        ring = straightened(at[walk], near)
        if len(ring) > 2:
            rings.append(np.concatenate([ring, ring[:1]]))
    twice = [float((r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum()) for r in rings]
    shells = sorted((k for k in range(len(rings)) if twice[k] > 0), key=lambda k: twice[k])
    out = {k: [rings[k] + corner] for k in shells}
    for k in range(len(rings)):
        if twice[k] < 0:
            owner = next((s for s in shells if holds(rings[s], rings[k])), None)
            if owner is not None:
                out[owner].append(rings[k] + corner)
    return [out[k] for k in sorted(shells)]


def names_of(points: np.ndarray, near: float) -> np.ndarray:
    """A number for each point, the same for points closer than near in x and y (in runs of their order)."""
    name = np.zeros(len(points), np.int64)
    groups = np.zeros(len(points), np.int64)
    for axis in (0, 1):
        order = np.lexsort((points[:, axis], groups))
        v, g = points[order, axis], groups[order]
        name[order] = np.cumsum(np.append(0, (g[1:] != g[:-1]) | (v[1:] - v[:-1] > near)))
        groups = name.copy()
    return name


def straightened(ring: np.ndarray, near: float) -> np.ndarray:
    """An open ring without points in the middle of a straight line."""
    if len(ring) < 3:
        return ring
    before, after = ring - np.roll(ring, 1, 0), np.roll(ring, -1, 0) - ring
    bend = np.abs(before[:, 0] * after[:, 1] - before[:, 1] * after[:, 0])
    keep = (bend > near * np.hypot(before[:, 0], before[:, 1])) | ((before * after).sum(1) < 0)
    return ring[keep]


def holds(shell: np.ndarray, hole: np.ndarray) -> bool:
    """Whether the hole's first edge lies in the shell, by the even-odd rule."""
    x, y = (hole[0] + hole[1]) / 2
    a, b = shell[:-1], shell[1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        right = ((a[:, 1] <= y) != (b[:, 1] <= y)) & (x < a[:, 0] + (y - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0]))
    return bool(right.sum() % 2)


def inside(shapes: Shapes, at: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether each point lies in its polygon at[i], by the even-odd rule; lower and left edges count."""
    count, out = shapes.begin[at + 1] - shapes.begin[at], np.zeros(len(at), bool)
    for rows in portions(count):
        k, j = ragged(shapes.begin[at[rows]], count[rows])
        px, py, e = x[rows][k], y[rows][k], shapes.edges[j]
        with np.errstate(divide="ignore", invalid="ignore"):
            right = ((e[:, 1] <= py) != (e[:, 3] <= py)) & (px < (e[:, 2] - e[:, 0]) * (py - e[:, 1]) / (e[:, 3] - e[:, 1]) + e[:, 0])
        out[rows] = np.bincount(k[right], minlength=rows.stop - rows.start)[: len(out[rows])] % 2 == 1
    return out


def covered(e: np.ndarray, least: int = 1) -> float:
    """Area covered by at least so many of the polygons whose directed edges are given.

    Between neighbouring heights of vertices and crossings all covered lengths are linear, so the middle of each slab gives its area: edges that
    go down open a polygon there and those that go up close it. All slabs are taken at once, in portions."""
    e = e[e[:, 1] != e[:, 3]]
    if not len(e):
        return 0.0
    low, high = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    heights = np.unique(np.concatenate([low, high, crossings(e)]))
    first, last = np.searchsorted(heights, low), np.searchsorted(heights, high)
    slab_count = np.bincount(first, minlength=len(heights)) - np.bincount(last, minlength=len(heights))
    total = 0.0
    for slabs in portions(np.cumsum(slab_count)[:-1]):
        on = np.flatnonzero((first < slabs.stop) & (last > slabs.start))
        k, s = ragged(np.maximum(first[on], slabs.start), np.minimum(last[on], slabs.stop) - np.maximum(first[on], slabs.start))
        g, mid = e[on[k]], (heights[s] + heights[s + 1]) / 2
        x = g[:, 0] + (mid - g[:, 1]) / (g[:, 3] - g[:, 1]) * (g[:, 2] - g[:, 0])
        order = np.lexsort((x, s))
        x, s, step = x[order], s[order], np.where(g[order, 3] < g[order, 1], 1, -1)
        # Each slab counts from 0: where a cut's height is rounded, a slab as thin as that has an edge too many or too few.
        new, sums = np.append(True, s[1:] != s[:-1]), np.cumsum(step)
        depth = (sums - (sums - step)[new][np.cumsum(new) - 1])[:-1]
        total += float((np.diff(x) * (heights[s + 1] - heights[s])[1:])[(depth >= least) & (s[1:] == s[:-1])].sum())
    return total


def crossings(e: np.ndarray) -> np.ndarray:
    """Heights at which edges cross, each pair of edges whose boxes meet tried; edges come in the order of their lower ends."""
    low, high = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    order = np.argsort(low, kind="stable")
    e, low, high = e[order], low[order], high[order]
    count = np.searchsorted(low, high, "right") - np.arange(len(e)) - 1  # those that begin before this one ends
    out = [np.zeros(0)]
    left, right = np.minimum(e[:, 0], e[:, 2]), np.maximum(e[:, 0], e[:, 2])
    for rows in portions(count):
        i, j = ragged(np.arange(rows.start, rows.stop) + 1, count[rows])
        i += rows.start
        near = (left[i] <= right[j]) & (left[j] <= right[i])
        p, q = e[i[near]], e[j[near]]
        r, s, d = p[:, 2:] - p[:, :2], q[:, 2:] - q[:, :2], q[:, :2] - p[:, :2]
        cross = lambda u, v: u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = cross(d, s) / cross(r, s), cross(d, r) / cross(r, s)
        hit = (t > 0) & (t < 1) & (u > 0) & (u < 1)
        out.append((p[:, 1] + t * r[:, 1])[hit])
    return np.concatenate(out)


def nesting_reasons(polygons: list[list[np.ndarray]]) -> list[str | None]:
    """What is wrong with the places of each polygon's rings, None if nothing: all rings of a batch at once, a ring as a shape of its own.

    Each hole is held against the shell, and holes whose boxes meet against each other. Rings may touch in points."""
    rings = [r for g in polygons for r in g]
    owner = np.repeat(np.arange(len(polygons)), [len(g) for g in polygons])
    shell = np.searchsorted(owner, np.arange(len(polygons)))
    s = Shapes(np.arange(len(rings) + 1), np.append(0, np.cumsum([len(r) for r in rings])).astype(np.int64), np.concatenate(rings) if rings else np.zeros((0, 2)))
    holes = np.setdiff1d(np.arange(len(rings)), shell)
    out: list[str | None] = [None] * len(polygons)
    after = np.searchsorted(owner, owner[holes], "right") - holes - 1
    i, j = ragged(holes + 1, after)
    i = holes[i]
    near = (s.box[i, :2] <= s.box[j, 2:]).all(1) & (s.box[j, :2] <= s.box[i, 2:]).all(1)
    i, j = i[near], j[near]
    for a, b, apart, within in ((i, j, None, "Holes are nested"), (shell[owner[holes]], holes, "Hole lies outside shell", None)):
        o, back = Overlay(s, s, a, b), Overlay(s, s, b, a)
        along, over, in_, out_ = o.common_boundary() > 0, o.overlap(), o.contains(), back.contains()
        for k in range(len(a)):
            if along[k] or (over[k] and not in_[k] and not out_[k]):
                reason = "Self-intersection"
            elif apart:  # a shell and its hole
                reason = None if in_[k] else apart
            else:
                reason = within if over[k] else None
            if reason and out[owner[b[k]]] != "Self-intersection":
                out[owner[b[k]]] = reason
    return out
