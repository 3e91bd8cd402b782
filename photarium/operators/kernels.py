"""Image operations as NumPy kernels, applied to rows (img_id, w, h, channels, pixels) in Arrow batches.

pixels: rows from the top, channels interleaved, 8 bits each. Kernels take and return height x width x channels arrays of floats 0..255.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from photarium.functions.colour import GRAY, Blend

IMAGE = "img_id long, w int, h int, channels int, pixels binary"


def gray(x: np.ndarray) -> np.ndarray:
    return x[:, :, 0] if x.shape[2] < 3 else np.floor(x[:, :, :3] @ np.array(GRAY) + 0.5)


def grayscale(x: np.ndarray, intensity: float = 1.0) -> np.ndarray:
    out = x.copy()
    out[:, :, :3] = x[:, :, :3] * (1 - intensity) + gray(x)[:, :, None] * intensity
    return out


def pixelate(x: np.ndarray, block: int = 8) -> np.ndarray:
    out = x.copy()
    for r in range(0, x.shape[0], block):
        for c in range(0, x.shape[1], block):
            out[r : r + block, c : c + block] = x[r : r + block, c : c + block].mean(axis=(0, 1))
    return out


def box_blur(x: np.ndarray, radius: int = 1) -> np.ndarray:
    n = 2 * radius + 1
    for axis in (0, 1):
        padded = np.pad(x, [(radius + (axis == k), radius) if k == axis else (0, 0) for k in range(3)], mode="edge")
        total = np.cumsum(padded, axis=axis)
        size = x.shape[axis]
        x = (np.take(total, range(n, n + size), axis) - np.take(total, range(size), axis)) / n
    return x


def gaussian_blur(x: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    radius = max(1, int(3 * sigma + 0.5))
    k = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma * sigma))
    k /= k.sum()
    for axis in (0, 1):
        padded = np.pad(x, [(radius, radius) if i == axis else (0, 0) for i in range(3)], mode="edge")
        x = sum(k[j] * np.take(padded, range(j, j + x.shape[axis]), axis) for j in range(len(k)))
    return x


def sharpen(x: np.ndarray, amount: float = 1.0) -> np.ndarray:
    return x + amount * (x - gaussian_blur(x))


def edges(x: np.ndarray) -> np.ndarray:
    """Magnitude of the Sobel gradient of gray, in one channel."""
    g = np.pad(gray(x), 1, mode="edge")
    dx = (g[:-2, 2:] + 2 * g[1:-1, 2:] + g[2:, 2:]) - (g[:-2, :-2] + 2 * g[1:-1, :-2] + g[2:, :-2])
    dy = (g[2:, :-2] + 2 * g[2:, 1:-1] + g[2:, 2:]) - (g[:-2, :-2] + 2 * g[:-2, 1:-1] + g[:-2, 2:])
    return np.hypot(dx, dy)[:, :, None]


def auto_contrast(x: np.ndarray) -> np.ndarray:
    """Stretches gray's range to 0..255; pixels of an alpha under 30 don't count."""
    g = gray(x)
    seen = x[:, :, 3] >= 30 if x.shape[2] == 4 else np.ones(g.shape, bool)
    if not seen.any() or g[seen].max() == g[seen].min():
        return x
    low, high = g[seen].min(), g[seen].max()
    out = x.copy()
    out[:, :, :3] = (x[:, :, :3] - low) * 255 / (high - low)
    return out


def adjust(x: np.ndarray, brightness: float = 0.0, contrast: float = 1.0, gamma: float = 1.0, saturation: float = 1.0, invert: bool = False) -> np.ndarray:
    c = x[:, :, :3] / 255
    c = 1 - c if invert else c
    c = np.clip((c + brightness - 0.5) * contrast + 0.5, 0, 1) ** gamma
    light = (c @ np.array(GRAY))[:, :, None] if c.shape[2] == 3 else c
    out = x.copy()
    out[:, :, :3] = (light + (c - light) * saturation) * 255
    return out


def mirror(x: np.ndarray) -> np.ndarray:
    return x[:, ::-1]


def flip(x: np.ndarray) -> np.ndarray:
    return x[::-1]


def rotate90(x: np.ndarray, turns: int = 1) -> np.ndarray:
    return np.rot90(x, -turns)


def symmetry(x: np.ndarray) -> np.ndarray:
    """The left half, mirrored onto the right one."""
    w = x.shape[1]
    out = x.copy()
    out[:, w - w // 2 :] = x[:, : w // 2][:, ::-1]
    return out


def set_alpha(x: np.ndarray, alpha: int = 255) -> np.ndarray:
    return np.dstack([x[:, :, :3], np.full(x.shape[:2], float(alpha))])


def resize_to(x: np.ndarray, w: int = 32, h: int = 32) -> np.ndarray:
    from photarium.sources.images import resize

    return np.dstack([resize(x[:, :, k], w, h) for k in range(x.shape[2])]).astype(float)


def to_polar(x: np.ndarray) -> np.ndarray:
    h, w = x.shape[:2]
    r, t = np.meshgrid(np.linspace(0, min(h, w) / 2, h, endpoint=False), np.linspace(0, 2 * np.pi, w, endpoint=False), indexing="ij")
    return x[np.clip((h / 2 + r * np.sin(t)).astype(int), 0, h - 1), np.clip((w / 2 + r * np.cos(t)).astype(int), 0, w - 1)]


def tone_map(x: np.ndarray) -> np.ndarray:
    """Global operator l / (1 + l) on light, scaled to the full range."""
    c = x / 255
    out = c / (1 + c)
    return out * 255 / max(out.max(), 1e-9)


def colorize(x: np.ndarray, dark: tuple[int, int, int] = (0, 0, 0), bright: tuple[int, int, int] = (255, 255, 255)) -> np.ndarray:
    g = gray(x)[:, :, None] / 255
    return np.array(dark) * (1 - g) + np.array(bright) * g


def noise(x: np.ndarray, sigma: float = 10.0, seed: int = 0) -> np.ndarray:
    return x + np.random.default_rng(seed).normal(0, sigma, x.shape)


def fill_holes(x: np.ndarray) -> np.ndarray:
    """Fully transparent pixels take the mean colour of the others."""
    if x.shape[2] < 4 or not (x[:, :, 3] > 0).any():
        return x
    out = x.copy()
    hole = x[:, :, 3] == 0
    out[hole, :3] = x[~hole][:, :3].mean(axis=0)
    out[hole, 3] = 255
    return out


def _spread(area: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The area, carried along every row as far as `near` goes without a gap."""
    run = np.cumsum(np.diff(near, axis=1, prepend=False) & near, axis=1) + np.arange(len(near))[:, None] * (near.shape[1] + 1)
    return near & np.isin(run, np.unique(run[area & near]))


def flood_fill(x: np.ndarray, row: int = 0, column: int = 0, colour: tuple[int, ...] = (255, 0, 0), tolerance: float = 0.0) -> np.ndarray:
    """Fills the connected area whose gray is within the tolerance of the start's; whole runs of rows and columns at a time."""
    g, out = gray(x), x.copy()
    near = np.abs(g - g[row, column]) <= tolerance
    area = np.zeros(g.shape, bool)
    area[row, column] = True
    while True:
        grown = _spread(_spread(area, near).T, near.T).T
        if (grown == area).all():
            break
        area = grown
    n = min(len(colour), x.shape[2])
    out[area, :n] = colour[:n]
    return out


def rotate(x: np.ndarray, degrees: float = 30.0, back: tuple[int, ...] = (0, 0, 0, 0)) -> np.ndarray:
    """About the centre, clockwise, in a frame of the same size; nearest pixels, `back` where there are none."""
    h, w = x.shape[:2]
    r, c = np.indices((h, w)) - np.array([(h - 1) / 2, (w - 1) / 2])[:, None, None]
    t = np.radians(degrees)
    row, column = (np.floor(v + 0.5).astype(int) for v in (r * np.cos(t) - c * np.sin(t) + (h - 1) / 2, r * np.sin(t) + c * np.cos(t) + (w - 1) / 2))
    inside = (row >= 0) & (row < h) & (column >= 0) & (column < w)
    return np.where(inside[:, :, None], x[np.clip(row, 0, h - 1), np.clip(column, 0, w - 1)], np.array(back[: x.shape[2]], float))


def rotate_blur(x: np.ndarray, degrees: float = 10.0, steps: int = 9) -> np.ndarray:
    """Mean of copies turned by up to that angle to either side; where a copy has no pixel the original stands in."""
    total = np.zeros(x.shape)
    for angle in np.linspace(-degrees, degrees, steps):
        turned = rotate(x, angle, (-1,) * x.shape[2])
        total += np.where(turned < 0, x, turned)
    return total / steps


def zoom_blur(x: np.ndarray, amount: float = 0.2, steps: int = 9) -> np.ndarray:
    """Mean of copies enlarged about the centre by up to that share."""
    h, w = x.shape[:2]
    r, c = np.arange(h) - (h - 1) / 2, np.arange(w) - (w - 1) / 2
    total = np.zeros(x.shape)
    for scale in np.linspace(1, 1 + amount, steps):
        row, column = (np.floor(v / scale + n / 2).astype(int) for v, n in ((r, h), (c, w)))
        total += x[np.clip(row, 0, h - 1)][:, np.clip(column, 0, w - 1)]
    return total / steps


def from_polar(x: np.ndarray) -> np.ndarray:
    """The inverse of to_polar: rows are radii, columns are angles; the corners repeat the last radius."""
    h, w = x.shape[:2]
    r, c = np.indices((h, w)) - np.array([h / 2, w / 2])[:, None, None]
    radius, turn = np.hypot(r, c) / (min(h, w) / 2) * h, np.mod(np.arctan2(r, c), 2 * np.pi) / (2 * np.pi) * w
    return x[np.clip(radius.astype(int), 0, h - 1), np.clip(turn.astype(int), 0, w - 1)]


def dissolve(x: np.ndarray, reach: int = 3, seed: int = 0) -> np.ndarray:
    """Every pixel comes from a random place at most `reach` rows and columns away."""
    h, w = x.shape[:2]
    move = np.random.default_rng(seed).integers(-reach, reach + 1, (2, h, w))
    row, column = np.indices((h, w)) + move
    return x[np.clip(row, 0, h - 1), np.clip(column, 0, w - 1)]


def alter_alpha(x: np.ndarray, level: int = 0, replace: bool = False) -> np.ndarray:
    """Adds to the alpha of pixels that have one, or replaces it."""
    out = x.copy()
    seen = x[:, :, 3] > 0
    out[seen, 3] = level if replace else np.clip(x[seen, 3] + level, 0, 255)
    return out


def polygon_mask(w: int, h: int, points: tuple[tuple[float, float], ...]) -> np.ndarray:
    """Pixels whose centres are inside a polygon of (x, y) corners, by the even-odd rule."""
    y, x = np.indices((h, w)) + 0.5
    inside = np.zeros((h, w), bool)
    for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1]):
        if y1 != y2:
            inside ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return inside


def ellipse_mask(w: int, h: int, box: tuple[float, float, float, float]) -> np.ndarray:
    """Pixels whose centres are inside the ellipse within left, top, right, bottom."""
    left, top, right, bottom = box
    y, x = np.indices((h, w)) + 0.5
    return ((2 * x - left - right) / (right - left)) ** 2 + ((2 * y - top - bottom) / (bottom - top)) ** 2 <= 1


def line_mask(w: int, h: int, points: tuple[tuple[float, float], ...], thickness: float = 1.0) -> np.ndarray:
    """Pixels whose centres are within half the thickness of an open line through the points."""
    y, x = np.indices((h, w)) + 0.5
    near = np.full((h, w), np.inf)
    for (x1, y1), (x2, y2) in zip(points, points[1:]):
        dx, dy = x2 - x1, y2 - y1
        t = np.clip(((x - x1) * dx + (y - y1) * dy) / max(dx * dx + dy * dy, 1e-12), 0, 1)
        near = np.minimum(near, np.hypot(x - x1 - t * dx, y - y1 - t * dy))
    return near <= thickness / 2


def curve_points(points: tuple[tuple[float, float], ...], steps: int = 16) -> tuple[tuple[float, float], ...]:
    """Points along cubic Bezier curves given by 1 + 3 n points."""
    p = np.array(points, float)
    out = [tuple(p[0])]
    for k in range(0, len(p) - 3, 3):
        t = np.linspace(0, 1, steps + 1)[1:, None]
        a, b, c, d = p[k : k + 4]
        out += map(tuple, (1 - t) ** 3 * a + 3 * (1 - t) ** 2 * t * b + 3 * (1 - t) * t * t * c + t**3 * d)
    return tuple((float(x), float(y)) for x, y in out)


def selection(w: int, h: int, shape: str, points, inverted: bool = False, feather: int = 0) -> np.ndarray:
    """Opacity 0..1 of a selected area: a polygon or curve by its points, an ellipse by its box, a line by its points."""
    if shape == "ellipse":
        mask = ellipse_mask(w, h, points)
    elif shape == "line":
        mask = line_mask(w, h, points)
    else:
        mask = polygon_mask(w, h, curve_points(points) if shape == "curve" else tuple(points))
    mask = (~mask if inverted else mask).astype(float)
    return box_blur(mask[:, :, None], feather)[:, :, 0] if feather else mask


def fill_selection(x: np.ndarray, shape: str = "polygon", points=((0, 0), (4, 0), (0, 4)), colour: tuple[int, ...] | None = (255, 0, 0), opacity: float = 1.0, inverted: bool = False, feather: int = 0) -> np.ndarray:
    """Fills the selected area with a colour, or erases its alpha without one."""
    share = (selection(x.shape[1], x.shape[0], shape, points, inverted, feather) * opacity)[:, :, None]
    out = x.copy()
    if colour is None:
        out[:, :, 3:] = x[:, :, 3:] * (1 - share)
    else:
        n = min(len(colour), x.shape[2])
        out[:, :, :n] = x[:, :, :n] * (1 - share) + np.array(colour[:n], float) * share
    return out


# of an image and others of its size


def mask_as_alpha(x: np.ndarray, mask: np.ndarray, channel: int = 0, invert: bool = False, replace: bool = False) -> np.ndarray:
    """A channel of the mask as alpha; an alpha that is there already stays where it is lower, unless it is replaced."""
    alpha = mask[:, :, channel]
    alpha = 255 - alpha if invert else alpha
    if not replace and x.shape[2] == 4:
        alpha = np.minimum(alpha, x[:, :, 3])
    return np.dstack([x[:, :, :3], alpha])


def merge_with_mask(x: np.ndarray, new: np.ndarray, mask: np.ndarray, channel: int = 0, invert: bool = False, shift: int = 0) -> np.ndarray:
    """The new image where the mask's channel is bright, the old one where it is dark; shift darkens the mask."""
    share = np.clip((255 - mask[:, :, channel] if invert else mask[:, :, channel]) - shift, 0, 255)[:, :, None] / 255
    return new * share + x * (1 - share)


MASKED: dict[str, Callable] = {f.__name__: f for f in (mask_as_alpha, merge_with_mask)}
#: Kernels by name: image in, image out.
KERNELS: dict[str, Callable] = {
    f.__name__: f
    for f in (
        grayscale, pixelate, box_blur, gaussian_blur, sharpen, edges, auto_contrast, adjust, mirror, flip, rotate90, symmetry, set_alpha, resize_to, to_polar,
        tone_map, colorize, noise, fill_holes, flood_fill, rotate, rotate_blur, zoom_blur, from_polar, dissolve, alter_alpha, fill_selection,
    )
}


def apply_kernel(images: DataFrame, name: str, **options) -> DataFrame:
    """Images after a kernel; results are rounded and clipped to bytes."""
    kernel = KERNELS[name]
    return images.select("img_id", "w", "h", "channels", "pixels").mapInPandas(lambda it: _applied(it, [("channels", "pixels")], kernel, options), IMAGE)


def _applied(batches: Iterator[pd.DataFrame], inputs: list[tuple[str, str]], kernel: Callable, options: dict) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for k, (key, w, h) in enumerate(zip(batch["img_id"], batch["w"], batch["h"])):
            out = kernel(*[np.frombuffer(batch[raw].iloc[k], np.uint8).reshape(h, w, batch[n].iloc[k]).astype(float) for n, raw in inputs], **options)
            rows.append((key, out.shape[1], out.shape[0], out.shape[2], np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8).tobytes()))
        yield pd.DataFrame(rows, columns=["img_id", "w", "h", "channels", "pixels"])


def apply_masked(images: DataFrame, others: list[DataFrame], name: str, **options) -> DataFrame:
    """Images after a kernel that also takes other images of the same id and size; images without them are left out."""
    kernel, both, inputs = MASKED[name], images.select("img_id", "w", "h", "channels", "pixels"), [("channels", "pixels")]
    for k, other in enumerate(others):
        both = both.join(other.selectExpr("img_id", "w", "h", f"channels AS n{k}", f"pixels AS p{k}"), ["img_id", "w", "h"])
        inputs.append((f"n{k}", f"p{k}"))
    return both.mapInPandas(lambda it: _applied(it, inputs, kernel, options), IMAGE)


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(np.shape(a)), where=b != 0)


_arrays = Blend(np.where, np.minimum, np.maximum, np.sqrt, np.abs, _share)


def blend_images(top: DataFrame, bottom: DataFrame, mode: int) -> DataFrame:
    """Pairs of images of one id and size, blended by the modes of functions.colour.blend."""
    both = top.alias("t").join(bottom.alias("b"), ["img_id", "w", "h", "channels"]).selectExpr("img_id", "w", "h", "channels", "t.pixels AS pixels", "b.pixels AS under")

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[["img_id", "w", "h", "channels"]].copy()
            o, u = ([np.frombuffer(x, np.uint8) / 255 for x in batch[c]] for c in ("pixels", "under"))
            out["pixels"] = [np.floor(_arrays(mode, a, b) * 255 + 0.5).astype(np.uint8).tobytes() for a, b in zip(o, u)]
            yield out

    return both.mapInPandas(of, IMAGE)


def auto_crop(images: DataFrame, tolerance: float = 8.0) -> DataFrame:
    """(img_id, left, top, right, bottom): the box outside of which gray stays within the tolerance of the corner's; ends exclusive."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, w, h, n, raw in zip(batch["img_id"], batch["w"], batch["h"], batch["channels"], batch["pixels"]):
                g = gray(np.frombuffer(raw, np.uint8).reshape(h, w, n).astype(float))
                odd = np.abs(g - g[0, 0]) > tolerance
                r, c = np.flatnonzero(odd.any(axis=1)), np.flatnonzero(odd.any(axis=0))
                rows.append((key, c[0], r[0], c[-1] + 1, r[-1] + 1) if len(r) else (key, 0, 0, w, h))
            yield pd.DataFrame(rows, columns=["img_id", "left", "top", "right", "bottom"])

    return images.select("img_id", "w", "h", "channels", "pixels").mapInPandas(of, "img_id long, left int, top int, right int, bottom int")


def similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """(img_id, similarity): percent by mean absolute difference after both are scaled down; -1 where sizes differ."""
    both = a.alias("a").join(b.alias("b"), "img_id").selectExpr("img_id", "a.w AS w", "a.h AS h", "a.channels AS channels", "a.pixels AS p", "b.w AS w2", "b.h AS h2", "b.channels AS c2", "b.pixels AS q")

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from photarium.sources.images import resize

        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                if (r.w, r.h) != (r.w2, r.h2):
                    rows.append((r.img_id, -1.0))
                    continue
                x, y = (resize(gray(np.frombuffer(v, np.uint8).reshape(r.h, r.w, n).astype(float)), 32, 32).astype(float) for v, n in ((r.p, r.channels), (r.q, r.c2)))
                rows.append((r.img_id, 100 - float(np.abs(x - y).mean()) * 100 / 255))
            yield pd.DataFrame(rows, columns=["img_id", "similarity"])

    return both.mapInPandas(of, "img_id long, similarity double")
