"""Exact areas of the bands beside two outlines, without a raster.

All points within a distance of an outline are the union of one capsule an edge: two circles and the sides between them. At a
height each capsule is one interval, so a scan line sees sorted interval ends, and every end is a line or an arc in the height.
The heights at which ends appear, vanish, change their curve or cross cut the plane into slabs (what a band hides inside itself does not count); within a
slab the order of the ends that matter stands, and the area between two of them is the difference of two integrals that have closed forms.
"""

from __future__ import annotations

import numpy as np

#: Slabs worked on at a time.
SLABS = 256


class Curves:
    """x = p + q y + s sqrt(r^2 - (y - c)^2) between two heights; lines have s = 0."""

    def __init__(self, p, q, s, r, c, low, high):
        self.p, self.q, self.s, self.r, self.c, self.low, self.high = (np.asarray(v, float) for v in (p, q, s, r, c, low, high))

    @classmethod
    def lines(cls, a: np.ndarray, b: np.ndarray) -> Curves:
        flat = a[:, 1] == b[:, 1]  # level ones have no height and are never met
        q = np.where(flat, 0.0, (b[:, 0] - a[:, 0]) / np.where(flat, 1.0, b[:, 1] - a[:, 1]))
        zero = np.zeros(len(a))
        return cls(a[:, 0] - q * a[:, 1], q, zero, zero, zero, np.minimum(a[:, 1], b[:, 1]), np.maximum(a[:, 1], b[:, 1]))

    @classmethod
    def arcs(cls, centre: np.ndarray, r: float, side: int) -> Curves:
        one = np.ones(len(centre))
        return cls(centre[:, 0], 0 * one, side * one, r * one, centre[:, 1], centre[:, 1] - r, centre[:, 1] + r)

    @classmethod
    def together(cls, *parts: Curves) -> Curves:
        return cls(*(np.concatenate([getattr(x, f) for x in parts]) for f in ("p", "q", "s", "r", "c", "low", "high")))

    def __len__(self) -> int:
        return len(self.p)

    def at(self, y: np.ndarray) -> np.ndarray:
        """Places at heights (rows), NaN where a curve is not."""
        y = y[:, None]
        x = self.p + self.q * y + self.s * np.sqrt(np.maximum(self.r**2 - (y - self.c) ** 2, 0))
        return np.where((self.low < y) & (y < self.high), x, np.nan)

    def between(self, low: np.ndarray, high: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Integral of x from low to high (rows) of the curves with the given numbers."""
        p, q, s, r, c = (getattr(self, f)[which] for f in ("p", "q", "s", "r", "c"))
        low, high = low[:, None], high[:, None]

        def arc(u: np.ndarray) -> np.ndarray:
            u = np.clip(u, -r, r)
            return (u * np.sqrt(np.maximum(r * r - u * u, 0)) + r * r * np.arcsin(u / np.where(r > 0, r, 1.0))) / 2

        return p * (high - low) + q * (high * high - low * low) / 2 + s * (arc(high - c) - arc(low - c))


def edges(ring: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the edges of a closed ring that have a length."""
    a, b = ring[:-1], ring[1:]
    real = (a != b).any(axis=1)
    return a[real], b[real]


def _sides(a: np.ndarray, b: np.ndarray, r: float) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    d = b - a
    n = np.stack([-d[:, 1], d[:, 0]], 1) / np.sqrt((d * d).sum(1))[:, None] * r
    return (a + n, b + n), (a - n, b - n)


def _far(p: np.ndarray, a: np.ndarray, b: np.ndarray, r: float) -> np.ndarray:
    """Which points lie no nearer than r to all the edges; most are dropped by a few of them."""
    left = np.arange(len(p))
    d = b - a
    for part in (slice(None, None, 8), slice(None)) if len(a) > 32 else (slice(None),):
        e, f, g = a[part], d[part], (d[part] ** 2).sum(1)
        near = np.zeros(len(left), bool)
        for lo in range(0, len(left), 4096):
            v = p[left[lo : lo + 4096], None] - e[None]
            u = np.clip((v * f).sum(2) / g, 0, 1)
            gap = ((v - u[..., None] * f) ** 2).sum(2).min(1)
            near[lo : lo + 4096] = gap < (r * (1 - 1e-9)) ** 2
        left = left[~near]
    return left


def _heights(lines: list[tuple[np.ndarray, np.ndarray, int]], circles: list[tuple[np.ndarray, float, int]], bands: list[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
    """Heights where ends of the bands' unions turn, appear or meet. Lines and circles come with the number of their band, or -1
    for the outlines themselves. What lies inside its own band is no end of the union and is dropped."""
    a, b = np.concatenate([x[0] for x in lines]), np.concatenate([x[1] for x in lines])
    of = np.repeat([x[2] for x in lines], [len(x[0]) for x in lines])
    d = b - a
    centre = np.concatenate([np.zeros((0, 2)), *[c for c, _, _ in circles]])
    r = np.repeat([x for _, x, _ in circles], [len(c) for c, _, _ in circles]) if circles else np.zeros(0)
    round_of = np.repeat([k for _, _, k in circles], [len(c) for c, _, _ in circles]) if circles else np.zeros(0, int)
    points = [a, b, centre + np.stack([0 * r, r], 1), centre - np.stack([0 * r, r], 1)]
    owners = [np.stack([k, k], 1) for k in (of, of, round_of, round_of)]

    def add(xy: np.ndarray, hit: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> None:
        i, j = np.nonzero(hit)
        points.append(xy[i, j])
        owners.append(np.stack([rows[i], columns[j]], 1))

    with np.errstate(divide="ignore", invalid="ignore"):
        for lo in range(0, len(a), 256):
            i = slice(lo, lo + 256)
            den = d[i, None, 0] * d[None, :, 1] - d[i, None, 1] * d[None, :, 0]
            s = a[None] - a[i, None]
            t = (s[..., 0] * d[None, :, 1] - s[..., 1] * d[None, :, 0]) / den
            u = (s[..., 0] * d[i, None, 1] - s[..., 1] * d[i, None, 0]) / den
            add(a[i, None] + t[..., None] * d[i, None], (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1), of[i], of)
            f = a[i, None] - centre[None]
            aa, bb, cc = (d[i] ** 2).sum(1)[:, None], 2 * (f * d[i, None]).sum(2), (f * f).sum(2) - r[None] ** 2
            root = np.sqrt(bb * bb - 4 * aa * cc)
            for t in ((-bb - root) / (2 * aa), (-bb + root) / (2 * aa)):
                add(a[i, None] + t[..., None] * d[i, None], (t >= 0) & (t <= 1), of[i], round_of)
        for lo in range(0, len(centre), 256):
            i = slice(lo, lo + 256)
            v = centre[None] - centre[i, None]
            d2 = (v * v).sum(2)
            k = (d2 + r[i, None] ** 2 - r[None] ** 2) / (2 * d2)
            h = np.sqrt(r[i, None] ** 2 / d2 - k * k)
            for sign in (-1, 1):
                at = centre[i, None] + k[..., None] * v + sign * h[..., None] * np.stack([-v[..., 1], v[..., 0]], 2)
                add(at, np.isfinite(h), round_of[i], round_of)
    p, own = np.concatenate(points), np.concatenate(owners)
    for k, (ea, eb, width) in enumerate(bands):
        mine = np.flatnonzero((own == k).any(1))
        keep = np.ones(len(p), bool)
        keep[mine] = False
        keep[mine[_far(p[mine], ea, eb, width)]] = True
        p, own = p[keep], own[keep]
    return p[:, 1]


def areas(cell: np.ndarray, nucleus: np.ndarray, inner: float, outer: float, rim: float) -> tuple[float, float, float, float, float]:
    """Areas within the cell: nucleus deeper than ``inner``; the nucleus up to there and ``outer`` around it; the rest beyond the
    rim; the rim of that width without the nucleus; and the whole cell. Rings are closed; insides are even-odd."""
    (ca, cb), (na, nb) = edges(cell), edges(nucleus)
    walls = Curves.lines(np.concatenate([ca, na]), np.concatenate([cb, nb]))
    wall_kind = np.repeat([0, 1], [len(ca), len(na)])
    bands = [(ca, cb, rim), (na, nb, inner), (na, nb, outer)]
    left, right, band_kind, lines, circles = [], [], [], [(ca, cb, -1), (na, nb, -1)], []
    for k, (a, b, r) in enumerate(bands):
        if r <= 0 or not len(a):
            continue
        one, two = _sides(a, b, r)
        lines += [(*one, k), (*two, k)]
        circles.append((a, r, k))
        sides = [Curves.lines(*one), Curves.lines(*two)]
        left.append([Curves.arcs(a, r, -1), Curves.arcs(b, r, -1), *sides])
        right.append([Curves.arcs(a, r, 1), Curves.arcs(b, r, 1), *sides])
        band_kind += [k] * len(a)
    y = _heights(lines, circles, bands)
    y = y[(y >= cell[:, 1].min()) & (y <= cell[:, 1].max())]
    y = np.unique(y)
    keep = np.r_[True, np.diff(y) > 1e-12 * max(1.0, float(np.abs(y).max()))] if len(y) else np.zeros(0, bool)
    y = y[keep]
    total = np.zeros(5)
    ways = [[Curves.together(*(x[k] for x in part)) for k in range(4)] for part in (left, right)] if left else []
    band_kind = np.array(band_kind, int)
    for lo in range(0, len(y) - 1, SLABS):
        low, high = y[lo : lo + SLABS + 1][:-1], y[lo : lo + SLABS + 1][1:]
        mid = (low + high) / 2
        rows = np.arange(len(mid))[:, None]
        every = walls.at(mid)
        xs, ints = [every], [walls.between(low, high, np.broadcast_to(np.arange(len(walls)), every.shape))]
        kinds = [np.broadcast_to(wall_kind, every.shape)]
        steps = [np.ones(every.shape, int)]
        for end, part in enumerate(ways):
            x = np.stack([w.at(mid) for w in part])
            filled = np.where(np.isnan(x), np.inf if end == 0 else -np.inf, x)
            best = filled.argmin(0) if end == 0 else filled.argmax(0)
            chosen = np.take_along_axis(x, best[None], 0)[0]
            number = np.broadcast_to(np.arange(len(part[0])), chosen.shape)
            value = np.stack([w.between(low, high, number) for w in part])
            xs.append(chosen)
            ints.append(np.take_along_axis(value, best[None], 0)[0])
            kinds.append(np.broadcast_to(2 + band_kind, chosen.shape))
            steps.append(np.full(chosen.shape, 1 if end == 0 else -1))
        x, i, kind, step = (np.concatenate(v, axis=1) for v in (xs, ints, kinds, steps))
        order = x.argsort(axis=1)  # NaN last
        x, i, kind, step = x[rows, order], i[rows, order], kind[rows, order], step[rows, order]
        here = ~np.isnan(x)
        count = lambda k: np.where(here & (kind == k), step, 0).cumsum(axis=1)  # noqa: E731, B023
        in_cell, in_nucleus = count(0) % 2 == 1, count(1) % 2 == 1
        near_rim, near_inner, near_outer = (count(2 + k) > 0 for k in range(3))
        wide = np.where(here[:, 1:], i[:, 1:] - i[:, :-1], 0.0)
        areas_of = (
            in_cell & in_nucleus & ~near_inner, in_cell & ((in_nucleus & near_inner) | (~in_nucleus & near_outer)), in_cell & ~in_nucleus & ~near_outer & ~near_rim,
            in_cell & ~in_nucleus & near_rim, in_cell,
        )
        total += [float(wide[m[:, :-1]].sum()) for m in areas_of]
    return tuple(total)
