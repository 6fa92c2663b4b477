"""Regions of an image that may be characters, and filters over them. A region is (x, y, width, height)."""

from __future__ import annotations

import numpy as np

from .pixels import edges, gradients

INK = 128
Box = tuple[int, int, int, int]


def labels(ink: np.ndarray) -> tuple[np.ndarray, int]:
    """Number of the 8-connected component of each set pixel, from 1; runs of rows are joined by union-find."""
    h, w = ink.shape
    out = np.zeros(ink.shape, dtype=np.int64)
    parent = [0]

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    before: list[tuple[int, int, int]] = []
    for y in range(h):
        step = np.diff(np.concatenate([[0], ink[y].astype(np.int8), [0]]))
        runs = []
        k = 0
        for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1)):
            name = 0
            while k < len(before) and before[k][1] < a:
                k += 1
            j = k
            while j < len(before) and before[j][0] <= b:
                other = find(before[j][2])
                if not name:
                    name = other
                elif other != name:
                    parent[max(name, other)] = min(name, other)
                    name = min(name, other)
                j += 1
            if not name:
                name = len(parent)
                parent.append(name)
            out[y, a:b] = name
            runs.append((a, b, name))
        before = runs
    roots = np.array([find(a) for a in range(len(parent))])
    used = np.unique(roots[out[out > 0]]) if (out > 0).any() else np.zeros(0, dtype=np.int64)
    number = np.zeros(len(parent), dtype=np.int64)
    number[used] = np.arange(1, len(used) + 1)
    return np.where(out > 0, number[roots[out]], 0), len(used)


def _boxes(found: np.ndarray, n: int) -> np.ndarray:
    """x, y, width, height of each component, a row for each."""
    y, x = np.nonzero(found)
    own = found[y, x] - 1
    low, high = np.full((n, 2), 1 << 30), np.full((n, 2), -1)
    np.minimum.at(low, own, np.stack([x, y], axis=1))
    np.maximum.at(high, own, np.stack([x, y], axis=1))
    return np.concatenate([low, high - low + 1], axis=1)


def whole_image(img: np.ndarray) -> list[Box]:
    return [(0, 0, img.shape[1], img.shape[0])]


def components(img: np.ndarray, least: int = 2, tallest: float = 0.9) -> list[Box]:
    """Connected ink, from the top, then from the left."""
    found, n = labels(img < INK)
    kept = [tuple(map(int, b)) for b in _boxes(found, n) if min(b[2], b[3]) >= least and b[3] <= tallest * img.shape[0]] if n else []
    return sorted(kept, key=lambda b: (b[1], b[0]))


def iou(a: Box, b: Box) -> float:
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / (a[2] * a[3] + b[2] * b[3] - w * h)


def nms(regions: list[Box], most: float = 0.5) -> list[Box]:
    """Largest first; one that overlaps a kept one by more than ``most`` goes."""
    kept: list[Box] = []
    for r in sorted(regions, key=lambda b: -b[2] * b[3]):
        if all(iou(k, r) <= most for k in kept):
            kept.append(r)
    return kept


def merged(first: list[Box], second: list[Box], most: float = 0.5) -> list[Box]:
    return nms(first + second, most)


def filtered(regions: list[Box], aspect: tuple[float, float] = (0.1, 10.0), height: tuple[int, int] = (4, 1000), least_area: int = 8) -> list[Box]:
    return [b for b in regions if aspect[0] <= b[2] / b[3] <= aspect[1] and height[0] <= b[3] <= height[1] and b[2] * b[3] >= least_area]


def stroke_regions(img: np.ndarray, widest: int = 30, both: bool = False) -> list[Box]:
    """Regions of even stroke width: rays from edges to the opposite edge, all at once, then components with little variation of width."""
    out: list[Box] = []
    for sign in (1, -1) if both else (1,):
        gx, gy = gradients(img)
        edge = edges(img)
        y, x = np.nonzero(edge)
        size = np.maximum(np.hypot(gx[y, x], gy[y, x]), 1e-9)
        dx, dy = -sign * gx[y, x] / size, -sign * gy[y, x] / size  # into the dark, or into the light
        width = np.full(img.shape, np.inf)
        live = np.arange(len(y))
        for step in range(1, widest + 1):
            px, py = np.round(x[live] + dx[live] * step).astype(int), np.round(y[live] + dy[live] * step).astype(int)
            inside = (px >= 0) & (py >= 0) & (px < img.shape[1]) & (py < img.shape[0])
            live, px, py = live[inside], px[inside], py[inside]
            hit = edge[py, px] & (step > 1)
            for k, hx, hy in zip(live[hit], px[hit], py[hit]):
                s = max(np.hypot(gx[hy, hx], gy[hy, hx]), 1e-9)
                if (gx[hy, hx] * -dx[k] + gy[hy, hx] * -dy[k]) * -sign / s >= np.cos(np.radians(30)):
                    t = np.arange(step + 1)
                    ry, rx = np.round(y[k] + dy[k] * t).astype(int), np.round(x[k] + dx[k] * t).astype(int)
                    width[ry, rx] = np.minimum(width[ry, rx], step)
            live = live[~hit]
        found, n = labels(np.isfinite(width))
        if not n:
            continue
        for j, b in enumerate(_boxes(found, n), 1):
            w = width[found == j]
            if len(w) >= 10 and w.std() / w.mean() <= 0.7 and 0.1 <= b[2] / b[3] <= 10 and b[3] >= 4:
                out.append(tuple(map(int, b)))
    return sorted(nms(out, 0.7), key=lambda b: (b[1], b[0]))


def stable_regions(img: np.ndarray, step: int = 8, least: int = 16) -> list[Box]:
    """The steadiest box of each dark and each light blob over rising thresholds: that whose area changes least from one to the next but one."""
    out: list[Box] = []
    for x in (img, 255 - img):
        levels = []
        for t in range(step, 256, step):
            found, n = labels(x <= t)
            if n:
                levels.append((found, _boxes(found, n), np.bincount(found.ravel(), minlength=n + 1)))
        best: dict[int, tuple[float, Box]] = {}
        seed_of: list[np.ndarray] = []
        for found, boxes, area in levels:  # a component's seed is that of the first pixel it ever had
            flat = found.ravel()
            first = np.full(len(area), flat.size, dtype=np.int64)
            np.minimum.at(first, flat, np.arange(flat.size))
            seed_of.append(first)
        for k in range(1, len(levels) - 1):
            found, boxes, area = levels[k]
            for j in range(1, len(area)):
                at = seed_of[k][j]
                small, large = levels[k - 1], levels[k + 1]
                inner = small[0].ravel()[at]
                change = (large[2][large[0].ravel()[at]] - (small[2][inner] if inner else 0)) / area[j]
                b = tuple(map(int, boxes[j - 1]))
                if area[j] >= least and b[2] * b[3] <= 0.5 * img.size and (at not in best or change < best[at][0]):
                    best[at] = (change, b)
        out += [b for change, b in best.values() if change <= 0.5]
    return sorted(nms(out, 0.7), key=lambda b: (b[1], b[0]))


def dense(regions: list[Box], least: int = 2, y_reach: float = 0.5, x_reach: float = 3.0, ratio: float = 0.5) -> list[Box]:
    """Regions with at least so many neighbours of like height on the same line."""
    if not regions:
        return []
    x, y, w, h = np.array(regions, dtype=np.float64).T
    middle, size = y + h * 0.5, np.maximum(h, 1)
    kept = []
    for k in range(len(regions)):
        gap = np.maximum(np.maximum(x - (x[k] + w[k]), x[k] - (x + w)), 0)
        near = (np.abs(middle - middle[k]) <= y_reach * size[k]) & (size / size[k] >= ratio) & (size / size[k] <= 1 / ratio) & (gap <= x_reach * size[k])
        if near.sum() - 1 >= least:
            kept.append(regions[k])
    return kept


def lines(regions: list[Box]) -> list[list[Box]]:
    """Regions as lines from the top, each from the left: a region joins the first line that it overlaps by half the lower height."""
    found: list[list[Box]] = []
    spans: list[list[int]] = []
    for r in sorted(regions, key=lambda b: (b[1], b[0])):
        low, high = r[1], r[1] + r[3]
        for line, span in zip(found, spans):
            if max(0, min(high, span[1]) - max(low, span[0])) >= 0.5 * min(max(1, r[3]), max(1, span[1] - span[0])):
                line.append(r)
                span[0], span[1] = min(span[0], low), max(span[1], high)
                break
        else:
            found.append([r])
            spans.append([low, high])
    order = sorted(range(len(found)), key=lambda k: spans[k][0])
    return [sorted(found[k], key=lambda b: b[0]) for k in order]


def median_height(line: list[Box]) -> int:
    return sorted(b[3] for b in line)[len(line) // 2] if line else 0


def text_lines(regions: list[Box]) -> list[Box]:
    """Regions of lines that look like text: even heights, no wide gaps. A region alone in its line stays."""
    kept: list[Box] = []
    for line in lines(regions):
        if len(line) > 1:
            heights, widths = np.array([b[3] for b in line]), sorted(b[2] for b in line)
            gaps = sorted(max(0, b[0] - a[0] - a[2]) for a, b in zip(line, line[1:]))
            if heights.std() > 0.5 * heights.mean() or gaps[len(gaps) // 2] > 3 * widths[len(widths) // 2]:
                continue
        kept += line
    return kept


def city_distance(ink: np.ndarray) -> np.ndarray:
    """Steps from each set pixel to the nearest other one or to the edge, without diagonals: two sweeps a direction."""
    far = sum(ink.shape)
    d = np.where(np.pad(ink, 1), far, 0).astype(np.int64)
    for axis in (0, 1):
        for flip in (False, True):
            v = np.flip(d, axis) if flip else d
            ramp = np.arange(v.shape[axis]).reshape((-1, 1) if axis == 0 else (1, -1))
            v[...] = np.minimum(v, np.minimum.accumulate(v - ramp, axis=axis) + ramp)
    return d[1:-1, 1:-1]


def even_stroke(img: np.ndarray, box: Box, most: float = 0.8) -> bool:
    """Whether the ink of a region is about equally thick; true for fewer than ten pixels."""
    x, y, w, h = box
    ink = img[y : y + h, x : x + w] < INK
    d = city_distance(ink)[ink]
    return len(d) < 10 or float(d.std() / d.mean()) <= most
