"""Single outlines in NumPy: simple loops of a crossing ring, hull, least rectangle, opening of a grid."""

from __future__ import annotations

import numpy as np

from . import planar


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]


def loop_area(loop: np.ndarray) -> float:
    return abs(float(_cross(loop, np.roll(loop, -1, axis=0)).sum())) / 2


def _cuts(a: np.ndarray, d: np.ndarray) -> list[list[tuple[float, tuple[float, float]]]]:
    """For each segment a + t d the places, as (t, point), where another one meets it between its ends."""
    cuts: list[list] = [[] for _ in a]
    b = a + d
    for i in range(len(a) - 1):
        s, dj = a[i + 1 :] - a[i], d[i + 1 :]
        den, along = _cross(d[i], dj), _cross(s, d[i])
        safe = np.where(den == 0, 1.0, den)
        t, u = _cross(s, dj) / safe, along / safe
        for k in np.flatnonzero((den != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)):
            j = i + 1 + int(k)
            if t[k] in (0.0, 1.0):
                at = a[i] if t[k] == 0 else b[i]
            elif u[k] in (0.0, 1.0):
                at = a[j] if u[k] == 0 else b[j]
            else:
                at = a[i] + t[k] * d[i]
            point = (float(at[0]), float(at[1]))
            cuts[i].append((float(t[k]), point))
            cuts[j].append((float(u[k]), point))
        for k in np.flatnonzero((den == 0) & (along == 0)):  # on one line: the ends of each that lie on the other
            j = i + 1 + int(k)
            for one, two in ((i, j), (j, i)):
                for end in (a[two], b[two]):
                    where = float((end - a[one]) @ d[one] / (d[one] @ d[one]))
                    if 0 < where < 1:
                        cuts[one].append((where, (float(end[0]), float(end[1]))))
    return cuts


def simple_loops(ring: np.ndarray) -> list[np.ndarray]:
    """Loops without a repeated corner that a closed ring falls into where it crosses or touches itself; open, of some area.

    The ring is walked once, a new corner at each meeting; whenever a corner comes again, what lies between is a loop and goes.
    """
    a, d = ring[:-1], np.diff(ring, axis=0)
    real = (d != 0).any(axis=1)
    a, d = a[real], d[real]
    if len(a) < 3:
        return []
    path: list[tuple[float, float]] = []
    place: dict[tuple[float, float], int] = {}
    loops: list[np.ndarray] = []

    def step(p: tuple[float, float]) -> None:
        if p in place:
            at = place[p]
            loops.append(np.array(path[at:]))
            for q in path[at + 1 :]:
                del place[q]
            del path[at + 1 :]
        else:
            place[p] = len(path)
            path.append(p)

    for start, met in zip(a, _cuts(a, d), strict=True):
        for p in [(float(start[0]), float(start[1])), *[p for _, p in sorted(met)]]:
            if not path or path[-1] != p:
                step(p)
    loops.append(np.array(path))
    return [x for x in loops if len(x) >= 3 and loop_area(x) > 0]


def largest_loop(ring: np.ndarray) -> np.ndarray | None:
    """The loop of the greatest area (of equal ones the first), closed; None without one. A simple ring is its own."""
    loops = simple_loops(ring)
    if not loops:
        return None
    best = max(loops, key=loop_area)
    return np.vstack([best, best[:1]])


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull in order; fewer than three if all points lie on one line."""
    p = np.unique(points, axis=0)

    def half(rows: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in rows:
            while len(out) > 1 and _cross(out[-1] - out[-2], q - out[-2]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1])) if len(p) > 2 else p


def aspect_ratio(points: np.ndarray) -> float | None:
    """Long by short side of the least rectangle around the points, in any direction; None if they lie on one line.

    That rectangle has a side along an edge of the hull. Of rectangles of equal area (to a billionth) the squarest counts.
    """
    h = hull(points)
    if len(h) < 3:
        return None
    e = np.roll(h, -1, axis=0) - h
    e = e / np.sqrt((e * e).sum(axis=1))[:, None]
    along, across = h @ e.T, h @ np.stack([-e[:, 1], e[:, 0]])
    w, v = np.ptp(along, axis=0), np.ptp(across, axis=0)
    area, ratio = w * v, np.maximum(w, v) / np.minimum(w, v)
    return float(ratio[area <= area.min() * (1 + 1e-9)].min())


def opened(x0: int, x1: int, y0: int, y1: int, flat: np.ndarray, depth: float, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid points of columns x0..x1 and rows y0..y1 inside an outline that a disc of radius ``depth`` within it can cover.

    Centres of such discs are grid points, taken from as many columns around the piece as the disc is wide.
    """
    reach = int(depth // step)
    xs, ys = np.arange(x0 - reach * step, x1 + reach * step + 1, step, dtype=float), np.arange(y0, y1 + 1, step, dtype=float)
    gx, gy = np.meshgrid(xs, ys)
    n = len(flat) // 4
    dist, inside, edge = planar.tests(gx.ravel(), gy.ravel(), flat, np.zeros(gx.size, np.int64), np.full(gx.size, n))
    inner = (inside & ~edge).reshape(gx.shape)
    core = inner & (dist.reshape(gx.shape) >= depth)
    sums = np.zeros((len(ys), len(xs) + 1), np.int64)
    np.cumsum(core, axis=1, out=sums[:, 1:])
    columns = np.arange(len(xs))
    out = np.zeros_like(core)
    for k in range(-reach, reach + 1):
        wide = int(np.sqrt(max(depth * depth - (k * step) ** 2, 0.0)) // step)
        lo, hi = np.maximum(columns - wide, 0), np.minimum(columns + wide + 1, len(xs))
        near = sums[:, hi] > sums[:, lo]
        if k >= 0:
            out[k:] |= near[: len(ys) - k]
        else:
            out[:k] |= near[-k:]
    keep = out & inner
    keep[:, (xs < x0) | (xs > x1)] = False
    return gx[keep], gy[keep]


class _Places:
    """Points that rounding has moved apart by no more than ``gap`` are one: the first of them."""

    def __init__(self, gap: float, origin: np.ndarray):
        self.gap, self.origin = gap or 1e-300, origin
        self.known: dict[tuple[int, int], tuple[float, float]] = {}

    def __call__(self, p: tuple[float, float]) -> tuple[float, float]:
        i, j = (int((p[k] - self.origin[k]) // self.gap) for k in (0, 1))
        for di in (0, -1, 1):
            for dj in (0, -1, 1):
                if (q := self.known.get((i + di, j + dj))) is not None and abs(q[0] - p[0]) <= self.gap and abs(q[1] - p[1]) <= self.gap:
                    return q
        self.known[i, j] = p
        return p


def _windings(edges: list[tuple[tuple[float, float], tuple[float, float], int]]) -> list[tuple[int, int]]:
    """Winding numbers left and right of each edge (u, v, net number of times that it is walked from u to v).

    A ray from the middle of an edge counts what it crosses; the edge itself counts for its left side only.
    """
    a, b = np.array([e[0] for e in edges]), np.array([e[1] for e in edges])
    net = np.array([e[2] for e in edges])
    out = []
    for i in range(len(edges)):
        axis = 1 if a[i, 1] != b[i, 1] else 0  # a ray to the right, or upwards for a level edge
        p, q = (a, b) if axis else (a[:, ::-1], b[:, ::-1])
        m = (p[i] + q[i]) / 2
        up = (p[:, 1] <= m[1]) & (q[:, 1] > m[1])
        down = (q[:, 1] <= m[1]) & (p[:, 1] > m[1])
        cross = up | down
        cross[i] = False
        k = np.flatnonzero(cross)
        at = p[k, 0] + (m[1] - p[k, 1]) / (q[k, 1] - p[k, 1]) * (q[k, 0] - p[k, 0])
        k = k[at > m[0]]
        turn = 1 if axis else -1  # swapped axes turn the other way round
        others = int((net[k] * np.where(up[k], 1, -1)).sum()) * turn
        rising = q[i, 1] > p[i, 1]
        own = int(net[i]) * (1 if rising else -1) * turn
        # the point on the ray's near side sees the edge; that side is left of a rising edge, unless the axes are swapped
        near_is_left = rising == bool(axis)
        out.append((others + own, others) if near_is_left else (others, others + own))
    return out


def valid_parts(ring: np.ndarray, rule: str = "evenodd") -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """What a closed ring that may cross or touch itself encloses, as (shell, holes), all closed, by descending area.

    The ring's edges are cut where they meet. An edge of this arrangement is kept if one side of it is filled and the other is
    not: filled is where the winding number is odd, or with the rule 'nonzero' where it is not 0. Kept edges are walked with the
    filled side on the left, always turning left as far as possible, so parts that meet in a point come apart.
    """
    a, d = ring[:-1], np.diff(ring, axis=0)
    real = (d != 0).any(axis=1)
    a, d = a[real], d[real]
    if len(a) < 3:
        return []
    count: dict[tuple, int] = {}
    walked: set[tuple] = set()
    one = _Places(1e-10 * float(np.abs(ring - ring[0]).max()), ring[0])
    corners = [one(tuple(map(float, p))) for p in a]
    for i, met in enumerate(_cuts(a, d)):
        stops = [corners[i], *[one(p) for _, p in sorted(met)], corners[(i + 1) % len(a)]]
        for u, v in zip(stops, stops[1:], strict=False):
            if u != v:
                key, way = ((u, v), 1) if u < v else ((v, u), -1)
                count[key] = count.get(key, 0) + way
                walked.add(key)
    every = [(u, v, count[u, v]) for u, v in sorted(walked)]
    filled = (lambda w: w % 2 == 1) if rule == "evenodd" else (lambda w: w != 0)
    ahead: dict[tuple, list[tuple]] = {}
    for (u, v, _), (left, right) in zip(every, _windings(every), strict=True):
        if filled(left) != filled(right):
            s, e = (u, v) if filled(left) else (v, u)
            ahead.setdefault(s, []).append(e)
    loops = []
    while ahead:
        start = min(ahead)
        path = [start]
        here, back = ahead[start][0], start
        _take(ahead, start, here)
        while here != start or _goes_on(ahead, path, here, back):
            path.append(here)
            into = np.arctan2(back[1] - here[1], back[0] - here[0])
            # clockwise from where it came: the first edge met keeps the same face on the left
            best = min(ahead[here], key=lambda q: ((into - np.arctan2(q[1] - here[1], q[0] - here[0])) % (2 * np.pi)) or 2 * np.pi)  # noqa: B023
            _take(ahead, here, best)
            back, here = here, best
        loops += _split(path)
    area = lambda p: float(_cross(p, np.roll(p, -1, axis=0)).sum()) / 2
    sized = [(area(p), p) for p in loops]
    shells = sorted([(s, p) for s, p in sized if s > 0], key=lambda x: x[0])
    holes: dict[int, list[np.ndarray]] = {}
    lost = dict.fromkeys(range(len(shells)), 0.0)
    for s, p in sized:
        if s < 0:
            m = (p[0] + p[1]) / 2
            i = next((i for i, (size, q) in enumerate(shells) if size > -s and _inside(m, q)), None)
            if i is not None:
                holes.setdefault(i, []).append(np.vstack([p, p[:1]]))
                lost[i] -= s
    order = sorted(range(len(shells)), key=lambda i: (lost[i] - shells[i][0], shells[i][1].tolist()))
    return [(np.vstack([shells[i][1], shells[i][1][:1]]), holes.get(i, [])) for i in order]


def _take(ahead: dict, u: tuple, v: tuple) -> None:
    ahead[u].remove(v)
    if not ahead[u]:
        del ahead[u]


def _goes_on(ahead: dict, path: list, here: tuple, back: tuple) -> bool:
    """At the start again: whether the same face's boundary goes on through another edge before it comes to its first one."""
    if here not in ahead:
        return False
    into = np.arctan2(back[1] - here[1], back[0] - here[0])
    turn = lambda q: ((into - np.arctan2(q[1] - here[1], q[0] - here[0])) % (2 * np.pi)) or 2 * np.pi
    return min(map(turn, ahead[here])) < turn(path[1])


def _split(path: list[tuple]) -> list[np.ndarray]:
    """Loops without a repeated corner."""
    out, held, place = [], [], {}
    for p in path:
        if p in place:
            at = place[p]
            out.append(held[at:])
            for q in held[at + 1 :]:
                del place[q]
            del held[at + 1 :]
        else:
            place[p] = len(held)
            held.append(p)
    return [np.array(x) for x in [*out, held] if len(x) > 2]


def _inside(p: np.ndarray, loop: np.ndarray) -> bool:
    a, b = loop, np.roll(loop, -1, axis=0)
    cross = (a[:, 1] <= p[1]) != (b[:, 1] <= p[1])
    a, b = a[cross], b[cross]
    return bool(((a[:, 0] + (p[1] - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0])) > p[0]).sum() % 2)


def part_area(shell: np.ndarray, holes: list[np.ndarray]) -> float:
    return loop_area(shell[:-1]) - sum(loop_area(h[:-1]) for h in holes)
