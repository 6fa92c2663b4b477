"""Features of a glyph, prototypes and recognition by nearest neighbours."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

from .layout import INK, labels

SIZE = 55
NEIGHBOURS, EPSILON = 5, 1e-3

#: Bundled glyphs: seven rows of five pixels each, a bit for each pixel, the leftmost the highest.
GLYPHS = {
    "0": "0e11131519110e", "1": "040c040404040e", "2": "0e11010204081f", "3": "1f02040201110e", "4": "02060a121f0202", "5": "1f101e0101110e", "6": "0608101e11110e",
    "7": "1f010204080808", "8": "0e11110e11110e", "9": "0e11110f01020c", "A": "0e11111f111111", "B": "1e11111e11111e", "C": "0e11101010110e", "D": "1c12111111121c",
    "E": "1f10101e10101f", "F": "1f10101e101010", "G": "0e11101711110f", "H": "1111111f111111", "I": "0e04040404040e", "J": "0702020202120c", "K": "11121418141211",
    "L": "1010101010101f", "M": "111b1515111111", "N": "11111915131111", "O": "0e11111111110e", "P": "1e11111e101010", "Q": "0e11111115120d", "R": "1e11111e141211",
    "S": "0f10100e01011e", "T": "1f040404040404", "U": "1111111111110e", "V": "11111111110a04", "W": "1111111515150a", "X": "11110a040a1111", "Y": "1111110a040404",
    "Z": "1f01020408101f",
}


def bitmap(glyph: str, scale: int = 1) -> np.ndarray:
    """Ink of a bundled glyph, cut to what is set."""
    rows = bytes.fromhex(GLYPHS[glyph])
    ink = np.array([[r >> b & 1 for b in range(4, -1, -1)] for r in rows], dtype=bool)
    ink = ink[np.ix_(ink.any(axis=1).nonzero()[0], range(5))]
    ink = ink[:, ink.any(axis=0).nonzero()[0]]
    return np.kron(ink, np.ones((scale, scale), dtype=bool))


def rendered(text: str, scale: int = 4) -> np.ndarray:
    """Black on white: bundled glyphs in a row, a blank as a wide gap; other characters are left out."""
    parts = []
    for c in text.upper():
        if c == " ":
            parts.append(np.zeros((7 * scale, 4 * scale), dtype=bool))
        elif c in GLYPHS:
            ink = bitmap(c, scale)
            parts += [np.pad(ink, ((7 * scale - len(ink), 0), (0, 0))), np.zeros((7 * scale, scale), dtype=bool)]
    ink = np.concatenate(parts, axis=1) if parts else np.zeros((7 * scale, scale), dtype=bool)
    return np.where(np.pad(ink, 2 * scale), 0, 255).astype(np.uint8)


def _bins(counts: np.ndarray, most: int, n: int = 8) -> np.ndarray:
    """Share of ink in n equal pieces of a projection."""
    cut = [len(counts) * k // n for k in range(n + 1)]
    return np.array([counts[a : max(b, a + 1)].mean() / most for a, b in zip(np.minimum(cut[:-1], len(counts) - 1), cut[1:])])


def hu_moments(ink: np.ndarray) -> np.ndarray:
    """Seven moments that turning, moving and scaling don't change, as signed logarithms."""
    y, x = np.nonzero(ink)
    n = len(x)
    if not n:
        return np.zeros(7)
    dx, dy = x - x.mean(), y - y.mean()
    eta = lambda p, q: (dx**p * dy**q).sum() / n ** (1 + (p + q) / 2)
    a, b, c = eta(2, 0), eta(0, 2), eta(1, 1)
    d, e, f, g = eta(3, 0), eta(2, 1), eta(1, 2), eta(0, 3)
    s, t, u, v = d + f, e + g, d - 3 * f, 3 * e - g
    moments = np.array([
        a + b, (a - b) ** 2 + 4 * c**2, u**2 + v**2, s**2 + t**2, u * s * (s**2 - 3 * t**2) + v * t * (3 * s**2 - t**2),
        (a - b) * (s**2 - t**2) + 4 * c * s * t, v * s * (s**2 - 3 * t**2) - u * t * (3 * s**2 - t**2),
    ])
    size = np.maximum(np.abs(moments), 1e-10)
    return -np.sign(moments) * np.log10(size) / 10


def holes(ink: np.ndarray) -> int:
    """Pieces of paper that ink encloses."""
    _, n = labels_of_paper(np.pad(~ink, 1, constant_values=True))
    return n - 1


def labels_of_paper(paper: np.ndarray) -> tuple[np.ndarray, int]:
    """4-connected components: each pixel is drawn three wide with its links, which 8-connected labelling then cannot cross diagonally."""
    h, w = paper.shape
    wide = np.zeros((2 * h - 1, 2 * w - 1), dtype=bool)
    wide[::2, ::2] = paper
    wide[1::2, ::2] = paper[1:] & paper[:-1]
    wide[::2, 1::2] = paper[:, 1:] & paper[:, :-1]
    spread = np.kron(wide, np.array([[1, 0], [0, 0]], dtype=bool))  # links of two pixels never touch at corners
    spread[1::2, ::2][:-1] = (wide[1:] & wide[:-1])[: spread[1::2, ::2][:-1].shape[0]]
    spread[::2, 1::2][:, :-1] = wide[:, 1:] & wide[:, :-1]
    return labels(spread)


def gradient_histogram(ink: np.ndarray) -> np.ndarray:
    """Directions of the outline in three bands of rows, four bins each."""
    x = np.pad(ink.astype(np.float64), 1)
    gx, gy = x[1:-1, 2:] - x[1:-1, :-2], x[2:, 1:-1] - x[:-2, 1:-1]
    size = np.hypot(gx, gy)
    kind = np.minimum((np.mod(np.arctan2(gy, gx), np.pi) / np.pi * 4).astype(int), 3)
    band = np.minimum(np.arange(ink.shape[0]) * 3 // max(1, ink.shape[0]), 2)
    out = np.zeros(12)
    np.add.at(out, (band[:, None] * 4 + kind).ravel(), size.ravel())
    out = out.reshape(3, 4)
    return (out / np.maximum(out.sum(axis=1, keepdims=True), 1e-9)).ravel()


def skeleton(ink: np.ndarray) -> np.ndarray:
    """Ink thinned to lines of one pixel, by peeling two opposite sides in turn (Zhang and Suen)."""
    x = np.pad(ink, 1).astype(np.uint8)
    while True:
        changed = False
        for side in (0, 1):
            n = [x[:-2, 1:-1], x[:-2, 2:], x[1:-1, 2:], x[2:, 2:], x[2:, 1:-1], x[2:, :-2], x[1:-1, :-2], x[:-2, :-2]]
            count = sum(a.astype(int) for a in n)
            turns = sum(((a == 0) & (b == 1)).astype(int) for a, b in zip(n, n[1:] + n[:1]))
            a, b = (n[0] * n[2] * n[4], n[2] * n[4] * n[6]) if side == 0 else (n[0] * n[2] * n[6], n[0] * n[4] * n[6])
            peel = (x[1:-1, 1:-1] == 1) & (count >= 2) & (count <= 6) & (turns == 1) & (a == 0) & (b == 0)
            if peel.any():
                x[1:-1, 1:-1][peel] = 0
                changed = True
        if not changed:
            return x[1:-1, 1:-1].astype(bool)


def _skeleton_numbers(ink: np.ndarray) -> np.ndarray:
    """Ends, forks and length of the skeleton, and its longest straight run, each as a share."""
    s = skeleton(ink)
    p = np.pad(s, 1).astype(int)
    around = sum(np.roll(np.roll(p, a, 0), b, 1) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b)[1:-1, 1:-1]
    n = max(1, int(s.sum()))
    longest = 0
    for line in (*s, *s.T):
        step = np.diff(np.concatenate([[0], line.astype(np.int8), [0]]))
        starts = np.flatnonzero(step == 1)
        if len(starts):
            longest = max(longest, int((np.flatnonzero(step == -1) - starts).max()))
    return np.array([(s & (around == 1)).sum() / n, (s & (around >= 3)).sum() / n, n / max(1, int(ink.sum())), longest / n])


def features(ink: np.ndarray) -> np.ndarray:
    """55 numbers of a glyph's ink (booleans): shape, fill, 3 x 3 zones, 8 + 8 projections, 2 symmetries, 2 crossings, holes, 7 moments, 12 directions, 4 of the skeleton."""
    h, w = ink.shape
    if not h or not w:
        return np.zeros(SIZE)
    ys, xs = [h * k // 3 for k in range(4)], [w * k // 3 for k in range(4)]
    zones = [ink[a:b, c:d].mean() if b > a and d > c else 0.0 for a, b in zip(ys, ys[1:]) for c, d in zip(xs, xs[1:])]
    same = lambda other: 1 - np.abs(ink.astype(float) - other).mean()
    crossings = [np.diff(ink.astype(np.int8), axis=axis).astype(bool).sum(axis=axis).mean() if n > 1 else 0.0 for axis, n in ((1, w), (0, h))]
    return np.concatenate([
        [w / h, ink.mean()], zones, _bins(ink.sum(axis=1), w), _bins(ink.sum(axis=0), h), [same(ink[:, ::-1]), same(ink[::-1])], crossings, [holes(ink)],
        hu_moments(ink), gradient_histogram(ink), _skeleton_numbers(ink),
    ])


def to_height(img: np.ndarray, height: int) -> np.ndarray:
    """A grey image scaled to a height, by triangle weights."""
    h, w = img.shape
    width = max(1, round(w * height / h))

    def weights(n: int, m: int) -> np.ndarray:
        scale = n / m
        reach = max(1.0, scale)
        d = np.abs((np.arange(m)[:, None] + 0.5) * scale - (np.arange(n)[None, :] + 0.5)) / reach
        k = np.maximum(1 - d, 0)
        return k / k.sum(axis=1, keepdims=True)

    return np.clip(np.round(weights(h, height) @ img.astype(np.float64) @ weights(w, width).T), 0, 255).astype(np.uint8)


class Prototypes:
    """Labelled feature vectors."""

    def __init__(self, names: list[str], vectors: np.ndarray):
        self.names, self.vectors = np.array(names), np.asarray(vectors, dtype=np.float64).reshape(len(names), -1)

    def saved(self) -> str:
        return json.dumps([{"label": n, "features": v.tolist()} for n, v in zip(self.names.tolist(), self.vectors)], indent=1)

    @classmethod
    def loaded(cls, text: str, size: int = SIZE) -> Prototypes:
        rows = json.loads(text)
        if any(len(r["features"]) != size for r in rows):
            raise ValueError(f"a prototype hasn't {size} features")
        return cls([r["label"] for r in rows], np.array([r["features"] for r in rows]))

    def nearest(self, x: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """(labels, distances) of the k nearest prototypes of each row, ties by place."""
        d = np.sqrt(np.maximum(((x[:, None, :] - self.vectors[None]) ** 2).sum(axis=2), 0))
        order = np.argsort(d, axis=1, kind="stable")[:, :k]
        return self.names[order], np.take_along_axis(d, order, 1)


def vote(names, distances, scale: float = 1.0) -> tuple[str, float, list[tuple[str, float]]]:
    """(label, confidence, alternatives by distance): weights 1 / (d + EPSILON) are summed by label, ties by label."""
    total: dict[str, float] = {}
    least: dict[str, float] = {}
    for n, d in zip(names, distances):
        total[n] = total.get(n, 0.0) + 1 / (d + EPSILON)
        least[n] = min(d, least.get(n, d))
    if not total:
        return "", 0.0, []
    return min(total, key=lambda n: (-total[n], n)), float(np.exp(-min(distances) / scale)), sorted(least.items(), key=lambda x: (x[1], x[0]))


@lru_cache(maxsize=1)
def bundled() -> Prototypes:
    """Prototypes of the bundled glyphs at two sizes."""
    names = [g for g in GLYPHS for _ in (3, 4)]
    return Prototypes(names, np.array([features(bitmap(g, s)) for g in GLYPHS for s in (3, 4)]))


def ink_of(img: np.ndarray, box, height: int | None = None) -> np.ndarray:
    """Ink of a region, scaled to a height if one is given."""
    x, y, w, h = box
    piece = img[y : y + h, x : x + w]
    return (piece if height in (None, h) else to_height(piece, height)) < INK


def medoids(vectors: np.ndarray, k: int, rounds: int = 50) -> np.ndarray:
    """Places of k vectors of the least summed distance to all, by swaps that gain most; starts with the most central."""
    n = len(vectors)
    if n <= k:
        return np.arange(n)
    d = np.sqrt(np.maximum(((vectors[:, None] - vectors[None]) ** 2).sum(axis=2), 0))
    chosen = [int(d.sum(axis=1).argmin())]
    while len(chosen) < k:
        near = d[:, chosen].min(axis=1)
        gain = np.maximum(near[None, :] - d, 0).sum(axis=1)
        gain[chosen] = -1
        chosen.append(int(gain.argmax()))
    for _ in range(rounds):
        cost = d[:, chosen].min(axis=1).sum()
        best = (cost, None)
        for i in range(k):
            rest = chosen[:i] + chosen[i + 1 :]
            near = d[:, rest].min(axis=1) if rest else np.full(n, np.inf)
            new = np.minimum(near[None, :], d).sum(axis=1)
            j = int(new.argmin())
            if new[j] < best[0] - 1e-9:
                best = (new[j], (i, j))
        if best[1] is None:
            break
        chosen[best[1][0]] = best[1][1]
    return np.sort(np.array(chosen))
