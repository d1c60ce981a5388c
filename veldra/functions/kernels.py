"""Element-wise kernels over grey line images (numpy arrays, 0 ink to 255 paper). Random ones take a generator keyed
by (seed, epoch, index), so a row's result depends on its key alone and not on its task."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.images import shrink

Kernel = Callable[[np.ndarray, np.random.Generator], np.ndarray]


def generator(seed: int, epoch: int, index: int) -> np.random.Generator:
    return np.random.default_rng([seed, epoch, index])


def _u8(a: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(a), 0, 255).astype(np.uint8)


def resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    if height < 1 or width < 1:
        raise ValueError("a size must be at least 1")
    return _u8(shrink(a.astype(np.float64), height, width))


def fit_line(a: np.ndarray, height: int = 48, pad_x: int = 8, pad_y: int = 4) -> np.ndarray:
    """A crop at a fixed height, its proportions kept, with white margins."""
    inner = height - 2 * pad_y
    if inner < 1 or pad_x < 0 or pad_y < 0:
        raise ValueError("the margins leave no room")
    width = max(1, round(a.shape[1] * inner / a.shape[0]))
    out = np.full((height, width + 2 * pad_x), 255, np.uint8)
    out[pad_y : pad_y + inner, pad_x : pad_x + width] = resize(a, inner, width)
    return out


def ink_rows(a: np.ndarray, dark: int = 128) -> tuple[int, int] | None:
    rows = np.flatnonzero((a < dark).any(axis=1))
    return (int(rows[0]), int(rows[-1]) + 1) if len(rows) else None


def horizontal_scale(low: float = 0.85, high: float = 1.15) -> Kernel:
    return lambda a, r: resize(a, a.shape[0], max(1, round(a.shape[1] * r.uniform(low, high))))


def margin_jitter(most: int = 4) -> Kernel:
    def run(a: np.ndarray, r: np.random.Generator) -> np.ndarray:
        top, bottom, left, right = (int(x) for x in r.integers(-most, most + 1, 4))
        p = np.pad(a, ((max(top, 0), max(bottom, 0)), (max(left, 0), max(right, 0))), constant_values=255)
        h, w = p.shape
        cut = p[max(-top, 0) : h - max(-bottom, 0), max(-left, 0) : w - max(-right, 0)]
        return cut if cut.size else a

    return run


def edge_line(most: int = 2) -> Kernel:
    def run(a: np.ndarray, r: np.random.Generator) -> np.ndarray:
        out, n = a.copy(), int(r.integers(1, most + 1))
        where = slice(0, n) if r.random() < 0.5 else slice(-n, None)
        out[where] = np.minimum(out[where], int(r.integers(0, 120)))
        return out

    return run


def contrast_remap(ink: tuple[int, int] = (0, 90), paper: tuple[int, int] = (170, 255)) -> Kernel:
    def run(a: np.ndarray, r: np.random.Generator) -> np.ndarray:
        lo, hi = r.uniform(*ink), r.uniform(*paper)
        return _u8(lo + a / 255.0 * (hi - lo))

    return run


def illumination(strength: float = 0.25) -> Kernel:
    def run(a: np.ndarray, r: np.random.Generator) -> np.ndarray:
        coarse = r.uniform(1 - strength, 1.0, (2, 3))
        y, x = np.linspace(0, 1, a.shape[0])[:, None], np.linspace(0, 2, a.shape[1])[None, :]
        i = np.minimum(x.astype(int), 1)
        f = x - i
        rows = coarse[:, :, None]
        top, bottom = (rows[k, i[0], 0] * (1 - f[0]) + rows[k, i[0] + 1, 0] * f[0] for k in (0, 1))
        return _u8(a * (top * (1 - y) + bottom * y))

    return run


def blur(low: float = 0.3, high: float = 1.2) -> Kernel:
    return lambda a, r: gaussian(a, r.uniform(low, high))


def gaussian(a: np.ndarray, sigma: float) -> np.ndarray:
    n = max(1, int(3 * sigma + 0.5))
    k = np.exp(-0.5 * (np.arange(-n, n + 1) / sigma) ** 2)
    k /= k.sum()
    out = np.pad(a.astype(np.float64), n, mode="edge")
    out = np.apply_along_axis(np.convolve, 0, out, k, "valid")
    return _u8(np.apply_along_axis(np.convolve, 1, out, k, "valid"))


def noise(sigma: float = 8.0) -> Kernel:
    return lambda a, r: _u8(a + r.normal(0, sigma, a.shape))


def paper_texture(sigma: float = 10.0) -> Kernel:
    return lambda a, r: _u8(a + (gaussian(_u8(128 + r.normal(0, 3 * sigma, a.shape)), 1.5).astype(float) - 128))


def downsample(low: float = 0.5, high: float = 0.9) -> Kernel:
    def run(a: np.ndarray, r: np.random.Generator) -> np.ndarray:
        f = r.uniform(low, high)
        small = resize(a, max(1, round(a.shape[0] * f)), max(1, round(a.shape[1] * f)))
        ys, xs = (np.minimum(np.arange(n) * m // n, m - 1) for n, m in zip(a.shape, small.shape))
        return small[ys][:, xs]

    return run


def small_affine(shear: float = 0.15, degrees: float = 2.0) -> Kernel:
    """Shear and rotation on a canvas grown to hold the result, nearest pixels."""

    def run(a: np.ndarray, r: np.random.Generator) -> np.ndarray:
        k, w = r.uniform(-shear, shear), np.deg2rad(r.uniform(-degrees, degrees))
        m = np.array([[np.cos(w), -np.sin(w)], [np.sin(w), np.cos(w)]]) @ np.array([[1, k], [0, 1]])
        h, n = a.shape
        at = np.array([[0, n, 0, n], [0, 0, h, h]]) - np.array([[n / 2], [h / 2]])
        ext = np.abs(m @ at).max(axis=1) * 2
        width, height = (max(1, int(np.ceil(x))) for x in ext)
        ys, xs = np.mgrid[0:height, 0:width]
        back = np.linalg.inv(m) @ np.stack([xs.ravel() - width / 2, ys.ravel() - height / 2])
        x, y = np.rint(back[0] + n / 2 - 0.5).astype(int), np.rint(back[1] + h / 2 - 0.5).astype(int)
        inside = (x >= 0) & (x < n) & (y >= 0) & (y < h)
        out = np.full(height * width, 255, np.uint8)
        out[inside] = a[y[inside], x[inside]]
        return out.reshape(height, width)

    return run


def color_tint(strength: float = 0.15) -> Kernel:
    """A gain for each of three channels, back to grey by luminance."""
    return lambda a, r: _u8(a * float(r.uniform(1 - strength, 1 + strength, 3) @ [0.299, 0.587, 0.114]))


def glyph_scale(low: float = 0.6, high: float = 0.9, text: str = "", least_px: float = 6.0) -> Kernel:
    """Ink made smaller on the same canvas, but not below ``least_px`` pixels a character."""

    def run(a: np.ndarray, r: np.random.Generator) -> np.ndarray:
        rows, dark = ink_rows(a), (a < 128).any(axis=0)
        if rows is None:
            return a
        cols = np.flatnonzero(dark)
        x0, x1 = int(cols[0]), int(cols[-1]) + 1
        f = r.uniform(low, high)
        if text:
            f = max(f, min(1.0, least_px * len(text) / (x1 - x0)))
        small = resize(a[rows[0] : rows[1], x0:x1], max(1, round((rows[1] - rows[0]) * f)), max(1, round((x1 - x0) * f)))
        out = np.full_like(a, 255)
        top = rows[0] + ((rows[1] - rows[0]) - small.shape[0]) // 2
        out[top : top + small.shape[0], x0 : x0 + small.shape[1]] = small
        return out

    return run


def augmentation(text: str = "") -> Kernel:
    """All steps in their fixed order with moderate probabilities."""
    return compose(
        [
            (0.5, horizontal_scale()), (0.5, small_affine()), (0.4, margin_jitter()), (0.15, edge_line()), (0.3, glyph_scale(text=text)), (0.5, contrast_remap()), (0.4, illumination()), (0.3, paper_texture()), (0.3, color_tint()), (0.3, downsample()), (0.3, blur()), (0.3, noise()),
        ]
    )


def augment_lines(lines: DataFrame, seed: int, epoch: int) -> DataFrame:
    """``(index, height, width, pixels)`` of rows ``(index, text, height, width, pixels)``, each augmented by a generator
    keyed by (seed, epoch, index) and fitted to the line height again. Arrow batches, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, text, h, w, px in zip(*(b.column(k).to_pylist() for k in range(5))):
                a = np.frombuffer(px, np.uint8).reshape(h, w)
                a = fit_line(augmentation(text or "")(a, generator(seed, epoch, i)))
                out.append((i, a.shape[0], a.shape[1], a.tobytes()))
            cols = list(zip(*out)) or [(), (), (), ()]
            types = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["index", "height", "width", "pixels"])

    return lines.select("index", "text", "height", "width", "pixels").mapInArrow(run, "index BIGINT, height INT, width INT, pixels BINARY")


def compose(steps: Iterable[tuple[float, Kernel]]) -> Kernel:
    """Steps in a fixed order, each taken with its probability. Every step draws its own stream, so leaving one out
    doesn't change what the others do."""
    steps = list(steps)

    def run(a: np.ndarray, r: np.random.Generator) -> np.ndarray:
        for (p, step), own in zip(steps, r.spawn(len(steps))):
            if own.random() < p:
                a = step(a, own)
        return a

    return run


def line_statistics(a: np.ndarray, text: str, dark: int = 128) -> dict:
    return {"height": a.shape[0], "width": a.shape[1], "ink": float((a < dark).mean()), "px_per_char": a.shape[1] / max(len(text), 1)}
