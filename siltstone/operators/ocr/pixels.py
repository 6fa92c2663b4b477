"""Pixel kernels over one grey image (uint8, rows by columns), vectorised in numpy."""

from __future__ import annotations

import numpy as np

WHITE = 255


def luma(rgb: np.ndarray) -> np.ndarray:
    """Grey values of an RGB image."""
    weights = np.array([2126, 7152, 722])
    return ((rgb.astype(np.int64) @ weights) // 10_000).astype(np.uint8)


def integral(img: np.ndarray) -> np.ndarray:
    """Sums over all rectangles from the upper left corner, with a row and a column of zeros before them."""
    out = np.zeros((img.shape[0] + 1, img.shape[1] + 1))
    out[1:, 1:] = img.astype(np.float64).cumsum(0).cumsum(1)
    return out


def window_sums(table: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(sum, number of pixels) of the square window around each pixel, cut off at the edges, out of an integral image."""
    h, w = table.shape[0] - 1, table.shape[1] - 1
    y0, y1 = np.clip(np.arange(h) - radius, 0, h), np.clip(np.arange(h) + radius + 1, 0, h)
    x0, x1 = np.clip(np.arange(w) - radius, 0, w), np.clip(np.arange(w) + radius + 1, 0, w)
    total = table[np.ix_(y1, x1)] - table[np.ix_(y0, x1)] - table[np.ix_(y1, x0)] + table[np.ix_(y0, x0)]
    return total, np.outer(y1 - y0, x1 - x0)


def sauvola(img: np.ndarray, radius: int = 12, k: float = 0.2, r: float = 128.0) -> np.ndarray:
    x = img.astype(np.float64)
    s, n = window_sums(integral(x), radius)
    q, _ = window_sums(integral(x * x), radius)
    mean = s / n
    deviation = np.sqrt(np.maximum(q / n - mean * mean, 0))
    return np.where(x > mean * (1 + k * (deviation / r - 1)), WHITE, 0).astype(np.uint8)


def adaptive_mean(img: np.ndarray, radius: int = 12, offset: int = 10) -> np.ndarray:
    s, n = window_sums(integral(img), radius)
    return np.where(img > s // n - offset, WHITE, 0).astype(np.uint8)


def otsu_level(img: np.ndarray) -> int:
    """The grey value that best parts dark from light."""
    count = np.bincount(img.ravel(), minlength=256).astype(np.float64)
    below, mass = np.cumsum(count), np.cumsum(count * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        gap = mass / below - (mass[-1] - mass) / above
        spread = np.nan_to_num(below * above * gap * gap)
    return int(np.argmax(spread))


def otsu(img: np.ndarray) -> np.ndarray:
    return np.where(img > otsu_level(img), WHITE, 0).astype(np.uint8)


def _windows(img: np.ndarray, radius: int) -> np.ndarray:
    padded = np.pad(img, radius, mode="edge")
    return np.lib.stride_tricks.sliding_window_view(padded, (2 * radius + 1, 2 * radius + 1))


def erode(img: np.ndarray, radius: int = 1) -> np.ndarray:
    return _windows(img, radius).min(axis=(2, 3))


def dilate(img: np.ndarray, radius: int = 1) -> np.ndarray:
    return _windows(img, radius).max(axis=(2, 3))


def median(img: np.ndarray, radius: int = 1) -> np.ndarray:
    return np.median(_windows(img, radius), axis=(2, 3)).astype(np.uint8)


def top_hat(img: np.ndarray, radius: int = 12) -> np.ndarray:
    """What stands out of its surroundings, dark on white."""
    opened = dilate(erode(img, radius), radius)
    return (WHITE - (img.astype(int) - np.minimum(img, opened))).astype(np.uint8)


def box_blur(img: np.ndarray, radius: int = 1) -> np.ndarray:
    s, n = window_sums(integral(img), radius)
    return (s // n).astype(np.uint8)


def unsharp(img: np.ndarray, amount: float = 1.0, radius: int = 1) -> np.ndarray:
    x = img.astype(np.float64)
    return np.clip(x + amount * (x - box_blur(img, radius)), 0, WHITE).astype(np.uint8)


def clahe(img: np.ndarray, tiles: int = 8, clip: float = 2.0) -> np.ndarray:
    """Equalised contrast by tiles: histograms clipped at ``clip`` times their mean, tables blended bilinearly."""
    h, w = img.shape
    ys, xs = np.linspace(0, h, tiles + 1).astype(int), np.linspace(0, w, tiles + 1).astype(int)
    table = np.zeros((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            tile = img[ys[i] : ys[i + 1], xs[j] : xs[j + 1]]
            if not tile.size:
                table[i, j] = np.arange(256)
                continue
            count = np.bincount(tile.ravel(), minlength=256).astype(np.float64)
            limit = max(1.0, clip * tile.size / 256)
            over = np.maximum(count - limit, 0).sum()
            table[i, j] = np.cumsum(np.minimum(count, limit) + over / 256) * WHITE / tile.size
    at = lambda n, cuts: np.clip(np.interp(np.arange(n), (cuts[:-1] + cuts[1:] - 1) / 2, np.arange(tiles)), 0, tiles - 1)
    y, x = at(h, ys)[:, None], at(w, xs)[None, :]
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1, fy, fx = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1), y - y0, x - x0
    top = table[y0, x0, img] * (1 - fx) + table[y0, x1, img] * fx
    low = table[y1, x0, img] * (1 - fx) + table[y1, x1, img] * fx
    return np.clip(np.round(top * (1 - fy) + low * fy), 0, WHITE).astype(np.uint8)


def bilateral(img: np.ndarray, radius: int = 2, space: float = 2.0, tone: float = 30.0) -> np.ndarray:
    x = _windows(img, radius).astype(np.float64)
    d = np.arange(-radius, radius + 1)
    near = np.exp(-(d[:, None] ** 2 + d[None, :] ** 2) / (2 * space * space))
    weight = near * np.exp(-((x - img[:, :, None, None]) ** 2) / (2 * tone * tone))
    return np.round((weight * x).sum(axis=(2, 3)) / weight.sum(axis=(2, 3))).astype(np.uint8)


def gradients(img: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sobel derivatives to the right and down."""
    p = np.pad(img.astype(np.float64), 1, mode="edge")
    smooth = lambda a, b, c: a + 2 * b + c
    right = smooth(p[:-2, 2:], p[1:-1, 2:], p[2:, 2:]) - smooth(p[:-2, :-2], p[1:-1, :-2], p[2:, :-2])
    down = smooth(p[2:, :-2], p[2:, 1:-1], p[2:, 2:]) - smooth(p[:-2, :-2], p[:-2, 1:-1], p[:-2, 2:])
    return right, down


def edges(img: np.ndarray, low: float = 100.0) -> np.ndarray:
    """Pixels of a strong gradient that is not less than that of its neighbours along it."""
    gx, gy = gradients(img)
    size = np.hypot(gx, gy)
    p = np.pad(size, 1)
    dy, dx = np.round(gy / np.maximum(size, 1e-9)).astype(int), np.round(gx / np.maximum(size, 1e-9)).astype(int)
    y, x = np.indices(img.shape)
    return (size >= low) & (size >= p[y + 1 + dy, x + 1 + dx]) & (size >= p[y + 1 - dy, x + 1 - dx])


def skew(img: np.ndarray, most: float = 15.0, step: float = 0.5) -> float:
    """Degrees by which lines of text slope, 0 if none are found: median of the strongest Hough lines within ``most`` degrees of level."""
    y, x = np.nonzero(edges(img))
    if len(y) < 16:
        return 0.0
    angles = np.arange(-most, most + step / 2, step)
    best = []
    for a in np.radians(angles):
        place = np.round(y * np.cos(a) - x * np.sin(a)).astype(int)
        votes = np.sort(np.bincount(place - place.min()))[-10:]
        best.append(votes)
    votes = np.array([np.pad(b, (10 - len(b), 0)) for b in best])
    least = max(votes.max() * 0.8, 8)
    found = np.repeat(angles, (votes >= least).sum(axis=1))
    return float(np.median(found)) if len(found) else 0.0


def rotate(img: np.ndarray, degrees: float, fill: int = WHITE) -> np.ndarray:
    """Turned about its middle, bilinear; what comes from outside is ``fill``."""
    h, w = img.shape
    a = np.radians(degrees)
    y, x = np.indices(img.shape)
    cy, cx = (h - 1) / 2, (w - 1) / 2
    sx, sy = np.cos(a) * (x - cx) - np.sin(a) * (y - cy) + cx, np.sin(a) * (x - cx) + np.cos(a) * (y - cy) + cy
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    fx, fy = sx - x0, sy - y0
    p = np.pad(img.astype(np.float64), 1, constant_values=fill)
    at = lambda yy, xx: p[np.clip(yy + 1, 0, h + 1), np.clip(xx + 1, 0, w + 1)]
    value = at(y0, x0) * (1 - fx) * (1 - fy) + at(y0, x0 + 1) * fx * (1 - fy) + at(y0 + 1, x0) * (1 - fx) * fy + at(y0 + 1, x0 + 1) * fx * fy
    return np.clip(np.round(value), 0, WHITE).astype(np.uint8)


def preprocess(img: np.ndarray, contrast: bool = False, denoise: bool = False, sharpen: bool = False, hat: bool = False, median_radius: int = 1, binarise: str = "otsu", deskew: bool = True) -> np.ndarray:
    """Grey or RGB to black on white, by the steps that are switched on."""
    x = luma(img) if img.ndim == 3 else img
    x = clahe(x) if contrast else x
    x = bilateral(x) if denoise else x
    x = unsharp(x) if sharpen else x
    x = top_hat(x) if hat else x
    x = median(x, median_radius) if median_radius else x
    x = {"otsu": otsu, "sauvola": sauvola, "adaptive": adaptive_mean, "none": lambda y: y}[binarise](x)
    slope = skew(x) if deskew else 0.0
    return rotate(x, slope) if abs(slope) > 0.5 else x


def colour_means(rgb: np.ndarray, k: int = 4, rounds: int = 20, sample: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """(centres, share of the pixels of each): k-means from evenly spaced pixels of the order by luma, over a regular sample."""
    flat = rgb.reshape(-1, 3).astype(np.float64)
    used = flat[:: max(1, len(flat) // sample)]
    order = np.argsort(used @ np.array([0.2126, 0.7152, 0.0722]), kind="stable")
    centres = used[order[np.linspace(0, len(used) - 1, min(k, len(used))).astype(int)]]
    for _ in range(rounds):
        own = ((used[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([used[own == j].mean(axis=0) if (own == j).any() else c for j, c in enumerate(centres)])
        if np.abs(new - centres).max() < 0.5:
            break
        centres = new
    own = ((used[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    return centres, np.bincount(own, minlength=len(centres)) / len(used)


def text_colour(centres: np.ndarray, share: np.ndarray) -> np.ndarray:
    """The darkest centre with 0.5 to 30 % of the pixels; else the darkest of all."""
    dark = centres @ np.array([0.2126, 0.7152, 0.0722])
    fit = (share >= 0.005) & (share <= 0.3)
    return centres[np.where(fit, dark, np.inf).argmin() if fit.any() else dark.argmin()]


def colour_mask(rgb: np.ndarray, colour: np.ndarray, reach: float = 1600.0) -> np.ndarray:
    """Black where a pixel is within ``reach`` (a squared distance) of a colour."""
    return np.where(((rgb.astype(np.float64) - colour) ** 2).sum(axis=2) < reach, 0, WHITE).astype(np.uint8)


def segment_text(rgb: np.ndarray, k: int = 4) -> np.ndarray:
    return colour_mask(rgb, text_colour(*colour_means(rgb, k)))
