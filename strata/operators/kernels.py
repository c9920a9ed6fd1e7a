"""Numpy kernels of one slice or volume. Where an order decides, it is z, y, x."""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from operator import mul

import numpy as np

FOUR = [(-1, 0), (0, -1), (0, 1), (1, 0)]
EIGHT = FOUR + [(-1, -1), (-1, 1), (1, -1), (1, 1)]


def steps_of(dims: int, full: bool) -> list[tuple[int, ...]]:
    """Offsets to the face neighbours, or to all."""
    out = []
    for o in np.ndindex(*(3,) * dims):
        d = tuple(int(v) - 1 for v in o)
        if any(d) and (full or sum(map(abs, d)) == 1):
            out.append(d)
    return out


def moved(a: np.ndarray, step: tuple[int, ...], fill: float = 0) -> np.ndarray:
    """The value at each voxel's neighbour ``step`` away, ``fill`` outside."""
    out = np.full_like(a, fill)
    src = tuple(slice(max(0, s), a.shape[i] + min(0, s)) for i, s in enumerate(step))
    dst = tuple(slice(max(0, -s), a.shape[i] - max(0, s)) for i, s in enumerate(step))
    out[dst] = a[src]
    return out


def components(a: np.ndarray, full: bool = False, mask: np.ndarray | None = None) -> np.ndarray:
    """Components of equal values, numbered from 0 in order of their first voxel; -1 outside the mask."""
    inside = np.ones(a.shape, dtype=bool) if mask is None else mask
    index = np.arange(a.size).reshape(a.shape)
    pairs = []
    for step in steps_of(a.ndim, full):
        if step > (0,) * a.ndim:
            same = (moved(a, step) == a) & inside & moved(inside, step, False) & (moved(index, step, -1) >= 0)
            pairs.append(np.stack([index[same], moved(index, step, -1)[same]], axis=1))
    edges = np.concatenate(pairs) if pairs else np.zeros((0, 2), dtype=np.int64)
    root = np.arange(a.size)
    while len(edges):
        lo = np.minimum(root[edges[:, 0]], root[edges[:, 1]])
        new = root.copy()
        np.minimum.at(new, root[edges[:, 0]], lo)
        np.minimum.at(new, root[edges[:, 1]], lo)
        while (new[new] != new).any():
            new = new[new]
        root = new[root]
        edges = edges[root[edges[:, 0]] != root[edges[:, 1]]]
    root = root.reshape(a.shape)
    out = np.full(a.shape, -1, dtype=np.int64)
    out[inside] = np.unique(root[inside], return_inverse=True)[1]
    return out


def reach(mask: np.ndarray, seeds: np.ndarray, full: bool = False) -> np.ndarray:
    """What of the mask is connected to a seed in it."""
    comp = components(mask.astype(np.int8), full, mask)
    hit = np.unique(comp[seeds & mask])
    return mask & np.isin(comp, hit[hit >= 0])


def border(shape: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(shape, dtype=bool)
    for i in range(len(shape)):
        s: list = [slice(None)] * len(shape)
        for end in (0, -1):
            s[i] = end
            out[tuple(s)] = True
    return out


def exterior(free: np.ndarray, full: bool = False) -> np.ndarray:
    """What of the free voxels is connected to the border."""
    return reach(free, border(free.shape), full)


def box_sum(a: np.ndarray, r: int, mode: str = "edge") -> np.ndarray:
    wide = np.pad(a.astype(float), r, mode=mode) if mode != "constant" else np.pad(a.astype(float), r)
    for axis in range(a.ndim):
        c = np.cumsum(wide, axis=axis)
        c = np.concatenate([np.zeros_like(np.take(c, [0], axis)), c], axis=axis)
        n = wide.shape[axis] - 2 * r
        wide = np.take(c, range(2 * r + 1, 2 * r + 1 + n), axis) - np.take(c, range(n), axis)
    return wide


def box_mean(a: np.ndarray, r: int) -> np.ndarray:
    return box_sum(a, r) / (2 * r + 1) ** a.ndim


def valleys(hist: np.ndarray, least: int, ratio: float) -> list[int]:
    """Bins of the lowest counts between modes: a valley opens where the count falls below ``ratio`` of the highest so
    far, and is cut when a count of at least ``least`` rises above its bottom over ``ratio``."""
    cuts: list[int] = []
    top, bottom = int(hist[0]), None
    for b, n in enumerate(hist[1:].tolist(), 1):
        if bottom is None:
            top = max(top, n)
            bottom = (n, b) if n < top * ratio else None
            continue
        bottom = min(bottom, (n, b))
        if n > bottom[0] / ratio and n >= least:
            cuts.append(bottom[1])
            top, bottom = n, None
    return cuts


def gauss_taps(sigma: float, n: int, as_coded: bool = False) -> np.ndarray:
    """Normalised odd kernel; as coded, the middle tap is exp(-1 / (16 sigma^2))."""
    i = np.arange(n) - n // 2
    k = np.exp(-(i**2) / (2 * sigma**2))
    if as_coded:
        k[n // 2] = np.exp(-1 / (16 * sigma**2))
    return k / k.sum()


def correlate(a: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """2-D correlation; where the kernel leaves the slice the result is 0."""
    ry, rx = kernel.shape[0] // 2, kernel.shape[1] // 2
    out = np.zeros_like(a, dtype=float)
    if a.shape[0] < kernel.shape[0] or a.shape[1] < kernel.shape[1]:
        return out
    win = np.lib.stride_tricks.sliding_window_view(a.astype(float), kernel.shape)
    out[ry : a.shape[0] - ry, rx : a.shape[1] - rx] = np.einsum("ijkl,kl->ij", win, kernel)
    return out


def blur(a: np.ndarray, sigma: float) -> np.ndarray:
    if sigma <= 0.66:
        return a.astype(float)
    n = int(3 * sigma) | 1
    k = gauss_taps(sigma, n)
    return correlate(correlate(a, k[None, :]), k[:, None])


def windows3(a: np.ndarray) -> np.ndarray:
    """(h - 2, w - 2, 9): sorted values of the 3x3 windows, NaN last."""
    return np.sort(np.lib.stride_tricks.sliding_window_view(a.astype(float), (3, 3)).reshape(a.shape[0] - 2, a.shape[1] - 2, 9), axis=2)


def median3(a: np.ndarray) -> np.ndarray:
    """Median of the window's values (NaN is none); the border keeps its own."""
    out = a.astype(float).copy()
    if min(a.shape) >= 3:
        s = windows3(a)
        n = (~np.isnan(s)).sum(axis=2, keepdims=True)
        low, high = (np.take_along_axis(s, k, axis=2)[:, :, 0] for k in (np.maximum(n - 1, 0) // 2, np.minimum(n // 2, 8)))
        out[1:-1, 1:-1] = (low + high) / 2
    return out


def interquartile3(a: np.ndarray) -> np.ndarray:
    """Eighth less second of the window's values (NaN if it has fewer than eight); the border is 0."""
    out = np.zeros(a.shape)
    if min(a.shape) >= 3:
        s = windows3(a)
        out[1:-1, 1:-1] = s[:, :, 7] - s[:, :, 1]
    return out


def sigma_filter(a: np.ndarray, before: np.ndarray, sigma: float, nx: int, ny: int) -> np.ndarray:
    """Mean of the window's values nearer than sigma to its centre (NaN is none); the border keeps what it had before."""
    out, (ry, rx) = before.astype(float).copy(), (ny // 2, nx // 2)
    if a.shape[0] < ny or a.shape[1] < nx:
        return out
    win = np.lib.stride_tricks.sliding_window_view(a, (2 * ry + 1, 2 * rx + 1))
    centre = a[ry : a.shape[0] - ry, rx : a.shape[1] - rx, None, None]
    near = np.abs(win - centre) < sigma
    mean = np.where(near, win, 0).sum(axis=(2, 3)) / np.maximum(near.sum(axis=(2, 3)), 1)
    out[ry : a.shape[0] - ry, rx : a.shape[1] - rx] = np.where(np.isnan(centre[:, :, 0, 0]), np.nan, mean)
    return out


def moment(a: np.ndarray, n: int, p: int, sigma: float | None = None) -> np.ndarray:
    """Mean of |v - window mean|^p over the window's values (NaN is none); with sigma only of differences below it."""
    r, out = n // 2, np.zeros(a.shape)
    if min(a.shape) < n:
        return out
    win = np.lib.stride_tricks.sliding_window_view(a, (n, n))
    there = ~np.isnan(win)
    mean = np.where(there, win, 0).sum(axis=(2, 3), keepdims=True) / np.maximum(there.sum(axis=(2, 3), keepdims=True), 1)
    d = np.where(there, np.abs(win - mean), 0)
    use = there if sigma is None else there & (d < sigma)
    out[r : a.shape[0] - r, r : a.shape[1] - r] = (d**p * use).sum(axis=(2, 3)) / np.maximum(use.sum(axis=(2, 3)), 1)
    return out


def erode(a: np.ndarray, n: int, full: bool = False, only_zero: bool = False) -> np.ndarray:
    """n passes: a pixel with a neighbour of another value (or only: of value 0) becomes 0."""
    for _ in range(n):
        gone = np.zeros(a.shape, dtype=bool)
        for s in steps_of(a.ndim, full):
            other = moved(a, s, np.nan) if a.dtype.kind == "f" else moved(a, s, -1)
            known = ~np.isnan(other) if a.dtype.kind == "f" else other >= 0
            gone |= known & ((other == 0) if only_zero else (other != a))
        a = np.where(gone, 0, a)
    return a


def dilate(a: np.ndarray, n: int, full: bool = False) -> np.ndarray:
    """n passes: a zero takes a neighbour's value; of several the last in the order up, down, left, right, diagonals."""
    order = [(-1, 0), (1, 0), (0, -1), (0, 1)] + [s for s in EIGHT if full and s not in FOUR]
    for _ in range(n):
        new = a.copy()
        for s in order:
            other = moved(a, s, 0)
            new = np.where((a == 0) & (other != 0), other, new)
        a = new
    return a


def close(a: np.ndarray, n: int, full: bool = False) -> np.ndarray:
    return erode(dilate(a, n, full), n, full, only_zero=True)


def open_(a: np.ndarray, n: int, full: bool = False) -> np.ndarray:
    return dilate(erode(a, n, full), n, full)


def ball(radius: tuple[float, ...]) -> list[tuple[int, ...]]:
    r = [int(np.floor(v)) for v in radius]
    return [d for d in ((tuple(int(v) - k for v, k in zip(o, r, strict=True))) for o in np.ndindex(*(2 * k + 1 for k in r))) if sum((v / max(k, 1e-9)) ** 2 for v, k in zip(d, radius, strict=True)) <= 1 + 1e-9]


def morph(a: np.ndarray, op: str, radius: tuple[float, ...]) -> np.ndarray:
    """Binary (at least 0.001 is on) erosion, dilation, opening or closing with a ball, 255 or 0."""
    on = a >= 0.001

    def grow(m: np.ndarray, value: bool) -> np.ndarray:
        out = m.copy()
        for s in ball(radius):
            out = out | moved(m, s, False) if value else out & moved(m, s, True)
        return out

    for step in {"erode": [False], "dilate": [True], "open": [False, True], "close": [True, False]}[op]:
        on = grow(on, step)
    return np.where(on, 255.0, 0.0)


def diffuse(src: np.ndarray, a: np.ndarray, dt: float, n: int, k: float, restraint: float) -> np.ndarray:
    """Perona-Malik diffusion with a pull towards the source."""
    a = a.astype(np.float32)
    for _ in range(n):
        flow = np.zeros_like(a)
        for axis in range(a.ndim):
            d = np.diff(a, axis=axis)
            f = d / (1 + (d / np.float32(k)) ** 2)
            pad = [(0, 0)] * a.ndim
            pad[axis] = (1, 1)
            flow += np.diff(np.pad(f, pad), axis=axis)
        a = a + np.float32(dt) * (flow + np.float32(restraint) * (src.astype(np.float32) - a))
    return a.astype(float)


def mode_filter(tis: np.ndarray, n: int) -> np.ndarray:
    """The most frequent label of the window, if it is more frequent than the centre's and fills half of it; of equal
    ones the lowest. The border stays."""
    r, out = n // 2, tis.copy()
    if min(tis.shape) < n:
        return out
    labels = np.unique(tis)
    inner = tuple(slice(r, s - r) for s in tis.shape)
    counts = np.stack([box_sum(tis == t, r)[inner].round().astype(int) for t in labels])
    best = counts.argmax(axis=0)
    most = counts.max(axis=0)
    own = np.take_along_axis(counts, np.searchsorted(labels, tis[inner])[None], axis=0)[0]
    out[inner] = np.where((most > own) & (2 * most >= n * n), labels[best], tis[inner])
    return out


def squared_distance(on: np.ndarray, spacing: tuple[float, ...] | None = None) -> np.ndarray:
    """Exact squared Euclidean distance to the nearest voxel that is on (inf if there is none), axis by axis."""
    out = np.where(on, 0.0, np.inf)
    for axis in range(on.ndim):
        s = 1.0 if spacing is None else spacing[axis]
        lines = np.moveaxis(out, axis, -1)
        i = np.arange(lines.shape[-1]) * s
        best = np.full(lines.shape, np.inf)
        for j in range(lines.shape[-1]):
            best = np.minimum(best, lines[..., j : j + 1] + (i - j * s) ** 2)
        out = np.moveaxis(best, -1, axis)
    return out


def signed_distance(on: np.ndarray, spacing: tuple[float, ...] | None = None) -> np.ndarray:
    """Positive inside: half a step at the edge."""
    far = float(sum(on.shape))
    inside, outside = np.sqrt(squared_distance(~on, spacing)), np.sqrt(squared_distance(on, spacing))
    return np.where(on, np.minimum(inside, far) - 0.5, 0.5 - np.minimum(outside, far))


def smooth_labels(tis: np.ndarray, sigma: float, locked: list[int] | None = None) -> np.ndarray:
    """The label whose smoothed signed distance is largest, of equal ones the lowest; locked labels stay."""
    locked = locked or []
    labels = [t for t in np.unique(tis).tolist() if t not in locked]
    if not labels:
        return tis
    k = gauss_taps(sigma, int(6 * sigma) | 1)
    fields = []
    for t in labels:
        f = signed_distance(tis == t)
        for axis in range(tis.ndim):
            wide = np.pad(f, [(len(k) // 2,) * 2 if i == axis else (0, 0) for i in range(tis.ndim)], mode="edge")
            f = np.apply_along_axis(np.convolve, axis, wide, k, "valid")
        fields.append(f)
    out = np.array(labels)[np.argmax(np.stack(fields), axis=0)]
    return np.where(np.isin(tis, locked), tis, out)


def vote(tis: np.ndarray, foreground: int, background: int, birth: int, majority: int, rounds: int) -> np.ndarray:
    """Foreground voxels take the most frequent other label around them, once it leads by ``majority`` (or, alone, has
    ``birth`` votes); again until nothing changes."""
    out = tis.copy()
    for _ in range(rounds):
        labels = [t for t in np.unique(out).tolist() if t not in (foreground, background)]
        if not labels:
            break
        counts = np.stack([sum(moved((out == t).astype(int), s, 0) for s in steps_of(out.ndim, True)) for t in labels])
        order = np.sort(counts, axis=0)
        first, second = order[-1], order[-2] if len(labels) > 1 else np.zeros_like(order[-1])
        win = np.where(second > 0, first >= second + majority, first >= birth) & (first > 0) & (out == foreground)
        if not win.any():
            break
        out = np.where(win, np.array(labels)[counts.argmax(axis=0)], out)
    return out


def unwrap(a: np.ndarray, ratio: float, span: float, shift: float = 0) -> np.ndarray:
    """Jumps of more than ratio * span are taken back: down the first column, then along every row."""
    out = a.astype(float) + shift
    for axis, line in ((0, out[:, :1]), (1, out)):
        d = np.diff(line, axis=axis)
        jump = np.where(d > ratio * span, -span, np.where(d < -ratio * span, span, 0.0))
        add = np.concatenate([np.zeros_like(np.take(line, [0], axis)), np.cumsum(jump, axis=axis)], axis=axis)
        out = out + add if axis == 1 else out + add[:, :1]
    return out


def median_set(a: np.ndarray, b: np.ndarray, full: bool = False) -> np.ndarray:
    """The set half way between two: what both share grows through what either has, one step at a time, as does what
    neither has; a pixel is in if it is reached from inside first."""
    inside, outside, either = a & b, ~(a | b), a ^ b
    while either.any():
        grown = [np.logical_or.reduce([moved(m, s, False) for s in steps_of(a.ndim, full)]) & either for m in (inside, outside)]
        if not (grown[0] | grown[1]).any():
            break
        inside = inside | (grown[0] & ~grown[1]) | (grown[0] & grown[1])
        outside = outside | (grown[1] & ~grown[0])
        either = either & ~(grown[0] | grown[1])
    return inside


def between(a: np.ndarray, b: np.ndarray, n: int) -> list[np.ndarray]:
    """n slices between two masks, by blending signed distances."""
    da, db = signed_distance(a), signed_distance(b)
    return [(da * (n + 1 - j) + db * j) / (n + 1) >= 0 for j in range(1, n + 1)]


def connected_between(a: np.ndarray, b: np.ndarray, n: int) -> list[np.ndarray]:
    """As ``between``, each component moved on the way to its mutual nearest; others blend in place."""
    ca, cb = components(a.astype(int), True, a), components(b.astype(int), True, b)
    pa = [np.argwhere(ca == i) for i in range(ca.max() + 1)]
    pb = [np.argwhere(cb == i) for i in range(cb.max() + 1)]
    if not pa or not pb:
        return between(a, b, n)
    d = np.array([[((p.mean(0) - q.mean(0)) ** 2).sum() for q in pb] for p in pa])
    out = [np.zeros(a.shape, dtype=bool) for _ in range(n)]
    for i in range(len(pa)):
        j = int(d[i].argmin())
        if int(d[:, j].argmin()) != i:
            continue
        move = pb[j].mean(0) - pa[i].mean(0)
        centre = np.array(a.shape) // 2
        size = int(max(np.ptp(pa[i], axis=0).max(), np.ptp(pb[j], axis=0).max())) + 3
        shapes = []
        for p in (pa[i], pb[j]):
            m = np.zeros((2 * size + 1, 2 * size + 1), dtype=bool)
            q = np.round(p - p.mean(0)).astype(int) + size
            m[q[:, 0], q[:, 1]] = True
            shapes.append(m)
        for k, m in enumerate(between(*shapes, n), 1):
            at = np.round(np.argwhere(m) - size + pa[i].mean(0) + move * k / (n + 1)).astype(int)
            ok = ((at >= 0) & (at < a.shape)).all(axis=1)
            out[k - 1][at[ok, 0], at[ok, 1]] = True
        del centre
    return out


def hysteresis(a: np.ndarray, low: float, high: float, full: bool = False, low2: float | None = None, high2: float | None = None, seeds: np.ndarray | None = None) -> np.ndarray:
    """What is connected to a core of values at or above ``high`` through values from ``low``. Two-sided: the core is
    [high, low2] within the band [low, high2]."""
    if high2 is None:
        core, band = a >= high, a >= low
    else:
        core, band = (a >= high) & (a <= low2), (a >= low) & (a <= high2)
    return reach(band, core if seeds is None else (core | seeds) & band, full)


def flood_nearest(labels: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Masked pixels take the value that arrives first from outside the mask, by steps of 4 neighbours in scan order."""
    out, queue = labels.copy(), deque()
    done = ~mask
    for y, x in np.argwhere(~mask):
        if any(0 <= y + dy < mask.shape[0] and 0 <= x + dx < mask.shape[1] and mask[y + dy, x + dx] for dy, dx in FOUR):
            queue.append((y, x))
    while queue:
        y, x = queue.popleft()
        for dy, dx in FOUR:
            v, u = y + dy, x + dx
            if 0 <= v < mask.shape[0] and 0 <= u < mask.shape[1] and not done[v, u]:
                done[v, u], out[v, u] = True, out[y, x]
                queue.append((v, u))
    return out


def fill_holes(on: np.ndarray, least: int) -> np.ndarray:
    """Holes (4-connected, away from the border) of fewer than ``least`` pixels are filled."""
    holes = ~on & ~exterior(~on)
    comp = components(holes.astype(int), False, holes)
    small = np.flatnonzero(np.bincount(comp[holes], minlength=1) < least) if holes.any() else []
    return on | (holes & np.isin(comp, small))


def remove_islands(on: np.ndarray, least: int) -> np.ndarray:
    comp = components(on.astype(int), True, on)
    small = np.flatnonzero(np.bincount(comp[on], minlength=1) < least) if on.any() else []
    return on & ~np.isin(comp, small)


def fill_gaps(on: np.ndarray, n: int, full: bool = False) -> np.ndarray:
    """Gap pixels that a closing fills between two different components."""
    closed = close(on.astype(int), -(-n // 2), full) > 0
    comp = components(on.astype(int), full, on) + 1
    left, right = np.where(on, comp, 0), np.where(on, comp, 0)
    for _ in range(-(-(n + 1) // 2)):
        for arr, pick in ((left, np.minimum), (right, np.maximum)):
            cand = arr.copy()
            for s in steps_of(2, full):
                o = moved(arr, s, 0)
                cand = np.where(~on & (o > 0), np.where(cand > 0, pick(cand, o), o), cand)
            arr[:] = cand
    return on | (closed & ~on & (left > 0) & (left != right))


def add_skin(on: np.ndarray, n: int) -> np.ndarray:
    """n layers just inside what is on, next to what is off."""
    skin = np.zeros(on.shape, dtype=bool)
    for _ in range(n):
        rest = on & ~skin
        out = np.zeros(on.shape, dtype=bool)
        for s in steps_of(on.ndim, False):
            out |= rest & ~moved(on & ~skin, s, True)
        skin |= out
    return skin


def skin_outside(free: np.ndarray, n: int) -> np.ndarray:
    """n layers of the free voxels connected to the border, next to what isn't free."""
    out, skin = exterior(free), np.zeros(free.shape, dtype=bool)
    for _ in range(n):
        rest = out & ~skin
        for_ = np.zeros(free.shape, dtype=bool)
        for s in steps_of(free.ndim, False):
            for_ |= rest & ~moved(rest, s, True)
        skin |= for_
    return skin


def fill_skin(tis: np.ndarray, thickness: float, background: int, skin: int) -> np.ndarray:
    """Background voxels with something else than background and skin within the radius."""
    radius = 1.5 if thickness == 1 and tis.ndim == 2 else 1.75 if thickness == 1 else 1.2 * thickness
    body = (tis != background) & (tis != skin)
    near = np.zeros(tis.shape, dtype=bool)
    for s in ball((radius,) * tis.ndim):
        near |= moved(body, s, False)
    return (tis == background) & near


def neighbours(shape: tuple[int, ...], at: tuple[int, ...], full: bool) -> Iterator[tuple[int, ...]]:
    for s in steps_of(len(shape), full):
        p = tuple(a + b for a, b in zip(at, s, strict=True))
        if all(0 <= v < n for v, n in zip(p, shape, strict=True)):
            yield p


def watershed(a: np.ndarray, full: bool = False) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Basins by immersion of 256 grey levels, and merges (basin, into, level); every pixel is in a basin."""
    grey = np.clip(np.floor(a + 0.5), 0, 255).astype(int)
    out = np.full(a.shape, -1)
    merges, parent, depth = [], [], []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    order = np.lexsort((np.arange(a.size), grey.ravel()))
    for k in order.tolist():
        at = np.unravel_index(k, a.shape)
        level = int(grey[at])
        near = sorted({int(out[p]) for p in neighbours(a.shape, at, full) if out[p] >= 0})
        if not near:
            out[at] = len(parent)
            parent.append(len(parent))
            depth.append(level)
            continue
        own = min(near, key=lambda b: (depth[root(b)], b))
        out[at] = own
        for b in near:
            x, y = root(own), root(b)
            if x != y:
                keep, gone = sorted((x, y), key=lambda i: (depth[i], i))
                parent[gone] = keep
                merges.append((gone, keep, level))
    return out, merges


def merged_basins(basins: np.ndarray, merges: list[tuple[int, int, int]], depth: dict[int, int], height: int) -> np.ndarray:
    """Basins after the merges whose level is less than ``height`` above the shallower one's bottom."""
    parent = {b: b for b in np.unique(basins).tolist()}

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for gone, keep, level in merges:
        if level - depth[gone] < height:
            parent[root(gone)] = root(keep)
    return np.vectorize(root)(basins)


def forest(seeds: dict[tuple[int, ...], int], shape: tuple[int, ...], cost, full: bool = False, start: float = 0.0) -> tuple[np.ndarray, np.ndarray, dict]:
    """Optimal paths from seeds: cost(path cost, from, to) never falls. Gives path costs, labels and parents; of equal
    costs the one reached first."""
    value, label, parent = np.full(shape, np.inf), np.zeros(shape, dtype=np.int64), {}
    heap, count = [], 0
    for p, lab in seeds.items():
        value[p], label[p] = start, lab
        heapq.heappush(heap, (start, count, p))
        count += 1
    done = np.zeros(shape, dtype=bool)
    while heap:
        v, _, p = heapq.heappop(heap)
        if done[p]:
            continue
        done[p] = True
        for q in neighbours(shape, p, full):
            if not done[q] and (c := cost(v, p, q)) < value[q]:
                value[q], label[q], parent[q] = c, label[p], p
                heapq.heappush(heap, (c, count, q))
                count += 1
    return value, label, parent


def path_to(parent: dict, at: tuple[int, ...]) -> list[tuple[int, ...]]:
    out = [at]
    while out[-1] in parent:
        out.append(parent[out[-1]])
    return out[::-1]


def region_growing(gradient: np.ndarray, markers: np.ndarray, full: bool = False) -> np.ndarray:
    seeds = {tuple(p): int(markers[tuple(p)]) for p in np.argwhere(markers > 0)}
    return forest(seeds, gradient.shape, lambda v, p, q: max(v, abs(gradient[p] - gradient[q])), full)[1]


def livewire(edge: np.ndarray, direction: np.ndarray, start: tuple[int, int], end: tuple[int, int]) -> list[tuple[int, int]]:
    """Cheapest path; a change of direction (degrees) costs 0.14 / 270 a degree."""

    def cost(v: float, p: tuple[int, int], q: tuple[int, int]) -> float:
        turn = abs(direction[p] - direction[q])
        return v + edge[q] + min(turn, 180 - turn) * 0.14 / 270

    return path_to(forest({start: 1}, edge.shape, cost, True)[2], end)


def fuzzy(a: np.ndarray, seed: tuple[int, int], mean: float, deviation: float, contrast: float) -> np.ndarray:
    """Fuzzy connectedness times 255: the best chain's weakest affinity."""

    def affinity(p: tuple, q: tuple) -> float:
        h1 = np.exp(-(((a[p] + a[q]) / 2 - mean) ** 2) / (2 * deviation**2))
        h2 = np.exp(-((a[p] - a[q]) ** 2) / (2 * contrast**2))
        return (h1 * h1 + h2 * h2) / (h1 + h2) if h1 + h2 else 0.0

    value, _, _ = forest({seed: 1}, a.shape, lambda v, p, q: max(v, 1 - affinity(p, q)))
    return (1 - np.minimum(value, 1)) * 255


def fast_march(speed: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Arrival times by first-order eikonal updates."""
    time, done = np.where(seeds, 0.0, np.inf), np.zeros(speed.shape, dtype=bool)
    heap = [(0.0, tuple(p)) for p in np.argwhere(seeds).tolist()]
    heapq.heapify(heap)
    while heap:
        t, p = heapq.heappop(heap)
        if done[p]:
            continue
        done[p] = True
        for q in neighbours(speed.shape, p, False):
            if done[q] or speed[q] <= 0:
                continue
            best = []
            for axis in range(speed.ndim):
                near = [time[tuple(v + (d if i == axis else 0) for i, v in enumerate(q))] for d in (-1, 1) if 0 <= q[axis] + d < speed.shape[axis]]
                best.append(min(near, default=np.inf))
            best = sorted(b for b in best if b < np.inf)
            step = 1 / speed[q]
            new = best[0] + step
            for k in range(2, len(best) + 1):
                b = np.array(best[:k])
                disc = b.sum() ** 2 - k * ((b**2).sum() - step**2)
                if disc >= 0 and (s := (b.sum() + np.sqrt(disc)) / k) >= b[-1]:
                    new = s
            if new < time[q]:
                time[q] = new
                heapq.heappush(heap, (new, q))
    return time


def bfs_distance(on: np.ndarray, full: bool = False) -> np.ndarray:
    """Steps to the edge of what is on: positive inside, negative outside; -(h + w) if nothing is on."""
    if not on.any():
        return np.full(on.shape, -float(sum(on.shape)))
    edge = np.zeros(on.shape, dtype=bool)
    for s in steps_of(on.ndim, full):
        edge |= on & ~moved(on, s, True)
    seeds = edge if edge.any() else on
    value, _, _ = forest({tuple(p): 1 for p in np.argwhere(seeds).tolist()}, on.shape, lambda v, p, q: v + 1, full)
    return np.where(on, value, -value)


def level_set(a: np.ndarray, start: np.ndarray, rounds: int, balloon: float, smooth: float, scale: float, every: int = 10, dt: float = 0.2) -> np.ndarray:
    """Geodesic contour: curvature and a balloon force, slowed at edges; the distance is set anew every few rounds."""
    phi = signed_distance(start)
    gy, gx = np.gradient(a.astype(float))
    speed = 1 / (1 + (gx**2 + gy**2) / scale**2)
    for i in range(rounds):
        if every > 0 and i and i % every == 0:
            phi = signed_distance(phi >= 0)
        py, px = np.gradient(phi)
        size = np.sqrt(px**2 + py**2) + 1e-9
        curve = np.gradient(px / size, axis=1) + np.gradient(py / size, axis=0)
        phi = phi + dt * speed * size * (balloon + smooth * curve)
    return phi >= 0


def dijkstra(a: np.ndarray, start: tuple[int, ...], end: tuple[int, ...], spacing: tuple[float, ...], wi: float = 1.0, wl: float = 1.0, wa: float = 0.0) -> list[tuple[int, ...]]:
    """Cheapest path over 26 neighbours: intensity steps and differences from both ends, length, and turns."""
    best, parent, heap, count = {(start, None): 0.0}, {}, [(0.0, 0, start, None)], 1
    while heap:
        v, _, p, step = heapq.heappop(heap)
        if p == end:
            out, key = [p], (p, step)
            while key in parent:
                key = parent[key]
                out.append(key[0])
            return out[::-1]
        if v > best.get((p, step), np.inf):
            continue
        for q in neighbours(a.shape, p, True):
            way = tuple(x - y for x, y in zip(q, p, strict=True))
            c = v + edge_weight(a, p, q, start, end, spacing, wi, wl) + (wa * turn_cost(step, way, spacing) if step else 0.0)
            key = (q, way if wa else None)
            if c < best.get(key, np.inf):
                best[key], parent[key] = c, (p, step)
                heapq.heappush(heap, (c, count, q, key[1]))
                count += 1
    return []


def turn_cost(one: tuple, two: tuple, spacing: tuple[float, ...] | None = None) -> float:
    """1 - cosine of the angle between two directions."""
    s = np.ones(len(one)) if spacing is None else np.array(spacing)
    u, v = np.array(one) * s, np.array(two) * s
    return float(1 - (u @ v) / (np.linalg.norm(u) * np.linalg.norm(v)))


def edge_weight(a: np.ndarray, p: tuple, q: tuple, start: tuple, end: tuple, spacing: tuple[float, ...], wi: float, wl: float) -> float:
    length = float(np.linalg.norm((np.array(q) - np.array(p)) * np.array(spacing)))
    return wi * (abs(a[q] - a[p]) + abs(a[q] - a[start]) + abs(a[q] - a[end])) + wl * length


def grow_cut(a: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Labels of the seeds reached at the least sum of intensity steps."""
    start = {tuple(p): int(seeds[tuple(p)]) for p in np.argwhere(seeds > 0).tolist()}
    return forest(start, a.shape, lambda v, p, q: v + abs(a[p] - a[q]), True)[1]


def min_cut(a: np.ndarray, inside: np.ndarray, outside: np.ndarray, sigma: float, full: bool = False) -> np.ndarray:
    """Segmentation by a minimal cut between two seed sets (shortest augmenting paths); for small regions."""
    n = a.size
    s, t = n, n + 1
    graph: list[dict[int, float]] = [{} for _ in range(n + 2)]
    index = np.arange(n).reshape(a.shape)
    for p in np.ndindex(*a.shape):
        for q in neighbours(a.shape, p, full):
            graph[index[p]][int(index[q])] = float(np.exp(-((a[p] - a[q]) ** 2) / (2 * sigma**2)))
        for mask, u, v in ((inside, s, int(index[p])), (outside, int(index[p]), t)):
            if mask[p]:
                graph[u][v] = 1e9
                graph[v].setdefault(u, 0.0)
    while True:
        parent, queue = {s: s}, deque([s])
        while queue and t not in parent:
            u = queue.popleft()
            for v, c in graph[u].items():
                if c > 1e-9 and v not in parent:
                    parent[v] = u
                    queue.append(v)
        if t not in parent:
            break
        path, v = [], t
        while v != s:
            path.append((parent[v], v))
            v = parent[v]
        flow = min(graph[u][v] for u, v in path)
        for u, v in path:
            graph[u][v] -= flow
            graph[v][u] = graph[v].get(u, 0.0) + flow
    out = np.zeros(n, dtype=bool)
    out[[v for v in parent if v < n]] = True
    return out.reshape(a.shape)


def simple_point(cube: np.ndarray) -> bool:
    """Whether taking the middle out of a 3x3(x3) block keeps what is on and what is off connected as they are."""
    return _simple(cube.shape, np.ascontiguousarray(cube, dtype=bool).tobytes())


@lru_cache(1 << 16)
def _simple(shape: tuple[int, ...], cells: bytes) -> bool:
    cube = np.frombuffer(cells, dtype=bool).reshape(shape)
    mid = (1,) * cube.ndim
    on = cube.copy()
    on[mid] = False
    fore = components(on.astype(int), True, on)
    off = ~cube
    off[mid] = False
    face = [tuple(1 + v for v in s) for s in steps_of(cube.ndim, False)]
    if cube.ndim == 3:
        near = np.zeros(cube.shape, dtype=bool)
        for p in np.ndindex(*cube.shape):
            near[p] = sum(abs(v - 1) for v in p) <= 2
        off &= near
    back = components(off.astype(int), False, off)
    touching = {int(back[p]) for p in face if off[p]}
    return fore.max() == 0 and len(touching) == 1


def thin(on: np.ndarray) -> np.ndarray:
    """Skeleton: simple border points that aren't ends are taken off, side by side, until none is left. A point's code
    has a bit for each neighbour that is on."""
    a = np.pad(on, 1)
    steps = steps_of(a.ndim, True)
    code = sum(moved(a, s, False).astype(np.int64) << i for i, s in enumerate(steps)).ravel().tolist()
    strides = [v // a.itemsize for v in a.strides]
    near = [(sum(map(mul, s, strides)), 1 << steps.index(tuple(-v for v in s))) for s in steps]
    gone: dict[int, bool] = {}

    def simple(c: int) -> bool:
        block = np.ones((3,) * a.ndim, dtype=bool)
        for i, s in enumerate(steps):
            block[tuple(1 + v for v in s)] = c >> i & 1
        return bool(block.sum() > 2 and simple_point(block))

    changed = True
    while changed:
        changed = False
        for s in steps_of(on.ndim, False):
            for p in np.flatnonzero(a & ~moved(a, s, False)).tolist():
                c = code[p]
                if c not in gone:
                    gone[c] = simple(c)
                if gone[c]:
                    a.flat[p] = False
                    changed = True
                    for step, bit in near:
                        code[p + step] &= ~bit
    return a[(slice(1, -1),) * on.ndim]


def carve(on: np.ndarray, allowed: np.ndarray, inside: bool = True) -> np.ndarray:
    """Fix topology within ``allowed``: from outside in, points go (or come) as long as nothing splits or joins."""
    a = np.pad(on if inside else ~on, 1)
    ok = np.pad(allowed, 1)
    depth = squared_distance(~a)
    heap = [(float(depth[tuple(p)]), tuple(p)) for p in np.argwhere(a & ok).tolist()]
    heapq.heapify(heap)
    while heap:
        _, p = heapq.heappop(heap)
        block = a[tuple(slice(v - 1, v + 2) for v in p)]
        if a[p] and block.sum() > 1 and simple_point(block):
            a[p] = False
    out = a[(slice(1, -1),) * on.ndim]
    return out if inside else ~out


def skeleton_edges(on: np.ndarray) -> np.ndarray:
    """Pairs of flat indices of neighbouring voxels; a diagonal is left out if shorter steps join its ends already.
    What could join them lies in the box that the two span."""
    index = np.arange(on.size).reshape(on.shape)
    out = []
    for s in sorted((s for s in steps_of(on.ndim, True) if s > (0,) * on.ndim), key=lambda s: sum(map(abs, s))):
        pair = on & moved(on, s, False)
        axes = [i for i, v in enumerate(s) if v]
        for some in range(1, 2 ** len(axes) - 1):
            pair &= ~moved(on, tuple(v if i in axes and some >> axes.index(i) & 1 else 0 for i, v in enumerate(s)), False)
        out.append(np.stack([index[pair], moved(index, s, -1)[pair]], axis=1))
    return np.concatenate(out)


def non_maximum(a: np.ndarray) -> np.ndarray:
    """Values below both neighbours along every axis' line through them become 0."""
    keep = np.zeros(a.shape, dtype=bool)
    for axis in range(a.ndim):
        s = tuple(int(i == axis) for i in range(a.ndim))
        keep |= (a >= moved(a, s, -np.inf)) & (a >= moved(a, tuple(-v for v in s), -np.inf))
    return np.where(keep, a, 0.0)


def canny_lines(a: np.ndarray, sigma: float, low: float, high: float) -> np.ndarray:
    """Edges: blurred gradient, thinned across its direction, kept by hysteresis."""
    b = blur(a, sigma)
    gx, gy = sobel(b)
    size = np.hypot(gx, gy)
    angle = np.degrees(np.arctan2(gy, gx)) % 180
    sector = ((angle + 22.5) // 45).astype(int) % 4
    keep = np.zeros(a.shape, dtype=bool)
    for k, s in enumerate([(0, 1), (1, 1), (1, 0), (1, -1)]):
        keep |= (sector == k) & (size >= moved(size, s, 0)) & (size >= moved(size, tuple(-v for v in s), 0))
    return np.where(hysteresis(np.where(keep, size, 0.0), low, high, True), 255.0, 0.0)


def sobel(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = np.outer([1, 2, 1], [-1, 0, 1])
    return correlate(a, k), correlate(a, k.T)
