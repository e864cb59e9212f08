"""Feature extractors and corruptions of image rows: image_id, height, width, channels, data (array<int>, row by row, 0 to 255).

An image is a row, so extraction is an Arrow map without a shuffle; per image a task holds its pixels as floats and some
filtered copies. Colour channels are in the order red, green, blue. Rows whose data is null, or doesn't hold
height x width x channels numbers, have no features (null).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddlens.functions.maps import label_components

LUMA = (0.299, 0.587, 0.114)


def gray(image: np.ndarray) -> np.ndarray:
    """Luma, rounded, of (height, width, channels); one channel stays as it is."""
    return image[..., 0] if image.shape[2] == 1 else np.rint(image[..., :3] @ np.array(LUMA))


@lru_cache(maxsize=64)
def _shares(size: int, to: int) -> np.ndarray:
    """(to, size): the part of each new cell that each old one covers; between cells where the image grows."""
    out = np.zeros((to, size))
    if to > size:
        at = np.clip((np.arange(to) + 0.5) * size / to - 0.5, 0, size - 1)
        low = np.minimum(at.astype(int), max(0, size - 2))
        out[np.arange(to), low] = 1 - (at - low)
        out[np.arange(to), np.minimum(low + 1, size - 1)] += at - low
        return out
    edges = np.arange(to + 1) * size / to
    for k in range(to):
        first, last = int(edges[k]), min(size, math.ceil(edges[k + 1]))
        for i in range(first, last):
            out[k, i] = min(i + 1, edges[k + 1]) - max(i, edges[k])
    return out / out.sum(1, keepdims=True)


def resize(plane: np.ndarray, height: int, width: int) -> np.ndarray:
    """By area means (linear where it grows)."""
    return _shares(plane.shape[0], height) @ plane @ _shares(plane.shape[1], width).T


def convolve(plane: np.ndarray, kernel: np.ndarray, mode: str = "reflect") -> np.ndarray:
    """Correlation with a small kernel, borders by numpy's pad mode."""
    r, c = kernel.shape[0] // 2, kernel.shape[1] // 2
    wide = np.pad(plane, ((r, r), (c, c)), mode=mode if min(plane.shape) > max(r, c) else "edge")
    view = np.lib.stride_tricks.sliding_window_view(wide, kernel.shape)
    return np.einsum("yxab,ab->yx", view, kernel)


SOBEL = np.array([[-1.0, 0, 1], [-2, 0, 2], [-1, 0, 1]])
LAPLACE = np.array([[0.0, 1, 0], [1, -4, 1], [0, 1, 0]])


def gradients(plane: np.ndarray, mode: str = "reflect") -> tuple[np.ndarray, np.ndarray]:
    return convolve(plane, SOBEL, mode), convolve(plane, SOBEL.T, mode)


def edges(plane: np.ndarray, low: float, high: float) -> np.ndarray:
    """Canny: Sobel gradients, local maxima across the edge, then what hangs together with a strong one."""
    gx, gy = gradients(plane, "edge")
    size, (h, w) = np.abs(gx) + np.abs(gy), plane.shape
    wide = np.zeros((h + 2, w + 2), size.dtype)
    wide[1:-1, 1:-1] = size

    def side(dy: int, dx: int) -> np.ndarray:
        return wide[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]

    flat, steep = np.abs(gy) <= math.tan(math.pi / 8) * np.abs(gx), np.abs(gy) >= math.tan(3 * math.pi / 8) * np.abs(gx)
    falls = (gx * gy) > 0
    before = np.select([flat, steep, falls], [side(0, -1), side(-1, 0), side(-1, -1)], side(-1, 1))
    after = np.select([flat, steep, falls], [side(0, 1), side(1, 0), side(1, 1)], side(1, -1))
    weak = (size > low) & (size > before) & (size >= after)
    label, strong = label_components(weak), weak & (size > high)
    kept = np.zeros(label.max(initial=0) + 1, bool)
    kept[label[strong]] = True
    return weak & kept[label]


def spread(x: np.ndarray) -> list[float]:
    """Mean, deviation and 90th percentile."""
    return [float(x.mean()), float(x.std()), float(np.percentile(x, 90))]


def edge_stats(image: np.ndarray, low: float = 50, high: float = 150) -> list[float]:
    """Mean, deviation and share of edge pixels; mean, deviation and 90th percentile of the gradient."""
    plane = gray(image)
    found = edges(plane, low, high).astype(float)
    return [float(found.mean()), float(found.std()), float(found.mean()), *spread(np.hypot(*gradients(plane)) / 255)]


def structural(image: np.ndarray, max_size: int = 512) -> list[float]:
    """15 figures: edge density at two scales, gradients, variance of 16 x 16 blocks, lines in four directions, symmetry, focus."""
    plane = gray(image)
    longest = max(plane.shape)
    if longest > max_size:
        plane = np.rint(resize(plane, *(max(1, round(n * max_size / longest)) for n in plane.shape)))
    fine = edges(plane, 100, 200)
    h, w = plane.shape
    blocks = [plane[y : y + 16, x : x + 16].var() / 255**2 for y in range(0, max(1, h - 15), 16) for x in range(0, max(1, w - 15), 16)]
    lines = [float(_opened(fine, steps).mean()) for steps in ((0, 1), (1, 0), (1, 1), (1, -1))]
    halves = [(plane[:, : w // 2], plane[:, w - w // 2 :][:, ::-1]), (plane[: h // 2], plane[h - h // 2 :][::-1])]
    symmetry = [1 - float(np.abs(a - b).mean()) / 255 if min(h, w) >= 2 else 0.5 for a, b in halves]
    focus = float(convolve(plane, LAPLACE).var()) / 255**2
    return [float(edges(plane, 50, 100).mean()), float(fine.mean()), *spread(np.hypot(*gradients(plane)) / 255), *spread(np.array(blocks)), *lines, *symmetry, focus]


def _opened(mask: np.ndarray, step: tuple[int, int], size: int = 20) -> np.ndarray:
    """Pixels in runs of at least ``size`` along a direction."""
    (h, w), (dy, dx) = mask.shape, step
    run = mask.astype(int)
    wide = np.zeros((h + 2 * size, w + 2 * size), int)
    wide[size : size + h, size : size + w] = run
    ends = np.min([wide[size - k * dy : size - k * dy + h, size - k * dx : size - k * dx + w] for k in range(size)], 0)
    wide[:] = 0
    wide[size : size + h, size : size + w] = ends
    return np.max([wide[size + k * dy : size + k * dy + h, size + k * dx : size + k * dx + w] for k in range(size)], 0) > 0


def to_hsv(image: np.ndarray) -> np.ndarray:
    """Hue 0 to 180, saturation and value 0 to 255."""
    top, low = image.max(-1), image.min(-1)
    span = np.where(top > low, top - low, 1)
    r, g, b = np.moveaxis(image, -1, 0)
    hue = np.select([top == low, top == r, top == g], [0 * top, (g - b) / span, 2 + (b - r) / span], 4 + (r - g) / span) * 30
    return np.stack([np.rint(hue % 180) % 180, np.rint(255 * (top - low) / np.where(top > 0, top, 1)), top], -1)


def to_lab(image: np.ndarray) -> np.ndarray:
    """CIE L*a*b* under D65, in 8-bit scale: L times 2.55, a and b from 128."""
    x = image / 255
    x = np.where(x > 0.04045, ((x + 0.055) / 1.055) ** 2.4, x / 12.92)
    # sRGB to XYZ, and its white.
    xyz = x @ np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]]).T / np.array([0.950456, 1.0, 1.088754])
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    light = np.where(xyz[..., 1] > 0.008856, 116 * f[..., 1] - 16, 903.3 * xyz[..., 1])
    return np.rint(np.clip(np.stack([light * 2.55, 500 * (f[..., 0] - f[..., 1]) + 128, 200 * (f[..., 1] - f[..., 2]) + 128], -1), 0, 255))


SPACES: dict[str, Callable] = {"rgb": lambda x: x, "bgr": lambda x: x[..., ::-1], "hsv": to_hsv, "lab": to_lab}


def color_hist(image: np.ndarray, colorspace: str = "hsv", bins: tuple[int, int, int] = (16, 16, 16)) -> list[float]:
    """A histogram of each channel over 0 to 256 (hue: 180), as parts of all counts."""
    x = SPACES[colorspace](image)
    tops = (180 if colorspace == "hsv" else 256, 256, 256)
    counts = [np.bincount(np.minimum(x[..., c].ravel() * n // top, n - 1).astype(int), minlength=n) for c, (n, top) in enumerate(zip(bins, tops, strict=True))]
    return (np.concatenate(counts) / max(1, 3 * x[..., 0].size)).tolist()


def patch_stats(image: np.ndarray, grid: tuple[int, int] = (4, 4), stats: tuple[str, ...] = ("mean", "std", "skew", "kurt"), size: tuple[int, int] | None = (128, 128)) -> list[float]:
    """Mean, deviation, skewness and excess kurtosis of each cell of a grid."""
    plane = gray(image) if size is None else np.rint(resize(gray(image), *size))
    ys, xs = (np.linspace(0, n, k + 1).astype(int) for n, k in zip(plane.shape, grid, strict=True))
    out = []
    for y0, y1 in zip(ys, ys[1:], strict=False):
        for x0, x1 in zip(xs, xs[1:], strict=False):
            cell = plane[y0:y1, x0:x1] / 255
            if not cell.size:
                out += [0.0] * len(stats)
                continue
            z = (cell - cell.mean()) / max(cell.std(), 1e-12)
            facts = {"mean": cell.mean(), "std": cell.std(), "skew": (z**3).mean(), "kurt": (z**4).mean() - 3}
            out += [float(facts[s]) for s in stats]
    return out


def fft_lowfreq(image: np.ndarray, size: tuple[int, int] = (64, 64), radii: tuple[int, ...] = (4, 8, 16)) -> list[float]:
    """Parts of the spectrum's magnitude within squares about the zero frequency."""
    power = np.abs(np.fft.fftshift(np.fft.fft2(np.rint(resize(gray(image), *size)))))
    cy, cx = size[0] // 2, size[1] // 2
    return [float(power[max(0, cy - r) : cy + r, max(0, cx - r) : cx + r].sum() / (power.sum() + 1e-12)) for r in radii]


def lbp(image: np.ndarray, points: int = 8, radius: float = 1.0) -> list[float]:
    """Histogram of uniform local binary patterns: ones of patterns with at most two changes, else points + 1."""
    plane = gray(image).astype(float)
    h, w = plane.shape
    reach = math.ceil(radius) + 1
    wide = np.pad(plane, reach)
    y, x = np.mgrid[0:h, 0:w]
    signs = []
    for k in range(points):
        dy, dx = round(-radius * math.sin(2 * math.pi * k / points), 5), round(radius * math.cos(2 * math.pi * k / points), 5)
        fy, fx = math.floor(dy), math.floor(dx)
        ty, tx = dy - fy, dx - fx

        def at(a, b, fy=fy, fx=fx):
            return wide[y + reach + fy + a, x + reach + fx + b]

        value = (1 - ty) * ((1 - tx) * at(0, 0) + tx * at(0, 1)) + ty * ((1 - tx) * at(1, 0) + tx * at(1, 1))
        signs.append(value - plane >= -1e-9)
    bits = np.array(signs)
    changes = (bits != np.roll(bits, 1, 0)).sum(0)
    code = np.where(changes <= 2, bits.sum(0), points + 1)
    return (np.bincount(code.ravel(), minlength=points + 2) / max(1, code.size)).tolist()


def hog(image: np.ndarray, size: tuple[int, int] = (128, 128), orientations: int = 9, cell: int = 8, block: int = 2) -> list[float]:
    """Histograms of gradient directions by cell, each block of cells normalised, cut at 0.2 and normalised again."""
    plane = np.sqrt(np.rint(resize(gray(image), *size)))
    gy, gx = np.zeros_like(plane), np.zeros_like(plane)
    gy[1:-1], gx[:, 1:-1] = plane[2:] - plane[:-2], plane[:, 2:] - plane[:, :-2]
    strength, angle = np.hypot(gx, gy), np.degrees(np.arctan2(gy, gx)) % 180
    rows, columns = size[0] // cell, size[1] // cell
    bins = np.minimum((angle * orientations / 180).astype(int), orientations - 1)
    where = (np.arange(size[0])[:, None] // cell * columns + np.arange(size[1]) // cell) * orientations + bins
    inside = (np.arange(size[0])[:, None] < rows * cell) & (np.arange(size[1]) < columns * cell)
    cells = np.bincount(where[inside], strength[inside], rows * columns * orientations).reshape(rows, columns, orientations) / cell**2
    blocks = np.lib.stride_tricks.sliding_window_view(cells, (block, block), (0, 1))
    flat = np.moveaxis(blocks, 2, -1).reshape(blocks.shape[0], blocks.shape[1], -1)
    for top in (0.2, None):
        flat = flat / np.sqrt((flat**2).sum(-1, keepdims=True) + 1e-10)
        flat = flat if top is None else np.minimum(flat, top)
    return flat.ravel().tolist()


@lru_cache(maxsize=64)
def gabor_kernel(frequency: float, theta: float) -> np.ndarray:
    """A complex Gabor kernel of one octave's bandwidth, three deviations wide."""
    sigma = math.sqrt(math.log(2) / 2) / math.pi * 3 / frequency
    reach = [math.ceil(max(1.0, abs(3 * sigma * math.cos(theta)), abs(3 * sigma * math.sin(theta))))] * 2
    y, x = np.mgrid[-reach[0] : reach[0] + 1, -reach[1] : reach[1] + 1]
    u = x * math.cos(theta) + y * math.sin(theta)
    return np.exp(-(x**2 + y**2) / (2 * sigma**2) + 2j * math.pi * frequency * u) / (2 * math.pi * sigma**2)


@lru_cache(maxsize=64)
def _gabor_spectrum(frequency: float, theta: float, shape: tuple[int, int]) -> tuple[np.ndarray, int]:
    """A kernel's transform at the size of the padded image, and its reach."""
    kernel = gabor_kernel(frequency, theta)
    return np.fft.fft2(kernel, shape), kernel.shape[0] // 2


def gabor_bank(image: np.ndarray, size: tuple[int, int] = (128, 128), frequencies: tuple[float, ...] = (0.1, 0.2, 0.3), thetas: tuple[float, ...] = (0.0, math.pi / 4, math.pi / 2, 3 * math.pi / 4)) -> list[float]:
    """Mean and deviation of the response to each kernel."""
    plane, out = np.rint(resize(gray(image), *size)) / 255, []
    kernels = [(f, t) for f in frequencies for t in thetas]
    pad = max(gabor_kernel(*k).shape[0] // 2 for k in kernels)
    wide = np.pad(plane, pad, mode="symmetric")
    spectrum = np.fft.fft2(wide)  # what wraps round at the margin isn't read
    for kernel in kernels:
        factor, r = _gabor_spectrum(*kernel, wide.shape)
        whole = np.fft.ifft(spectrum * factor, axis=0)[pad + r : pad + r + size[0]]
        response = np.abs(np.fft.ifft(whole, axis=1)[:, pad + r : pad + r + size[1]])
        out += [float(response.mean()), float(response.std())]
    return out


def multi(image: np.ndarray, parts: tuple[str, ...] = ("color_hist", "edge_stats")) -> list[float]:
    """Several extractors' features one after another."""
    return [v for name in parts for v in EXTRACTORS[name](image)]


EXTRACTORS: dict[str, Callable] = {f.__name__: f for f in (structural, color_hist, edge_stats, hog, lbp, fft_lowfreq, gabor_bank, patch_stats, multi)}


def pixels_of(height, width, channels, data) -> np.ndarray | None:
    if data is None or not height or not width or len(data) != height * width * (channels or 1):
        return None
    return np.asarray(data, float).reshape(height, width, channels or 1)


IMAGE = ["image_id", "height", "width", "channels", "data"]


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray | None]]]:
    for batch in batches:
        for k in range(0, batch.num_rows, 64):  # some images at a time
            part = batch.slice(k, 64)
            sizes = zip(*(part.column(c).to_pylist() for c in IMAGE[1:4]), strict=True)
            data = part.column("data")
            yield part, [pixels_of(*size, data[i].values.to_numpy(zero_copy_only=False) if data[i].is_valid else None) for i, size in enumerate(sizes)]


def _extracted(batches, name: str, how: dict):
    for part, images in rows_of(batches):
        found = [None if x is None else EXTRACTORS[name](x, **how) for x in images]
        yield pa.RecordBatch.from_arrays([part.column("image_id"), pa.array(found, pa.list_(pa.float64()))], ["id", "features"])


def extract(images: DataFrame, name: str, **how) -> DataFrame:
    """(id, features array<double>) of each image row; other columns are ignored."""
    if name not in EXTRACTORS:
        raise KeyError(name)
    kind = images.schema["image_id"].dataType.simpleString()
    return images.select(*IMAGE).mapInArrow(partial(_extracted, name=name, how=how), f"id {kind}, features array<double>")


def images_of(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Image rows of one channel from a long table (image_id, y, x, v); pixels that are missing are 0."""
    at = (F.col("y") * width + F.col("x")).cast("int")
    inside = pixels.where((F.col("y") < height) & (F.col("x") < width)).withColumn("at", at).where("at >= 0")
    by = inside.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce(F.col("v").cast("int"), F.lit(0)).alias("v")))).alias("cells"))

    def with_gap(cell: Column, i: Column) -> Column:
        """A pixel after the zeros between it and the one before: a lookup of every place would go through all pixels each time."""
        before = F.coalesce(F.get("cells", i - 1)["at"], F.lit(-1))
        twice = F.raise_error(F.lit("a pixel of an image is given twice")).cast("array<int>")
        return F.when(cell["at"] == before, twice).otherwise(F.concat(F.array_repeat(F.lit(0), cell["at"] - before - 1), F.array(cell["v"])))

    rest = F.array_repeat(F.lit(0), F.lit(height * width - 1) - F.element_at("cells", -1)["at"])
    data = F.concat(F.flatten(F.transform("cells", with_gap)), rest)
    return by.select("image_id", F.lit(height).alias("height"), F.lit(width).alias("width"), F.lit(1).alias("channels"), data.alias("data"))


# Deviation of the blur by severity.
BLUR = (0.5, 1.0, 1.5, 2.0, 3.0)


def blurred(plane: np.ndarray, sigma: float) -> np.ndarray:
    reach = max(1, round(sigma * 3))
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    k = (k / k.sum())[None]
    return convolve(convolve(plane, k), k.T)


def lighting(image: np.ndarray, severity: int, rng: np.random.Generator) -> np.ndarray:
    """Another lamp: light that falls off along a drawn direction, an exposure in stops, and in colour a warm or cold cast.

    From one side of the image to the other the light changes by up to 8 % a severity, the exposure by up to 0.1 stop,
    and red and blue are moved apart by up to 3 %.
    """
    h, w, c = image.shape
    angle = rng.uniform(0, 2 * math.pi)
    across = np.linspace(-0.5, 0.5, h)[:, None] * math.sin(angle) + np.linspace(-0.5, 0.5, w)[None] * math.cos(angle)
    light = (1 + 0.08 * severity * rng.random() * across) * 2 ** rng.normal(0, 0.05 * severity)
    warmth = 1 + 0.03 * severity * rng.uniform(-1, 1)
    cast = np.array([warmth, 1.0, 1 / warmth]) if c == 3 else np.ones(c)
    return image * light[..., None] * cast


def blur(image: np.ndarray, severity: int, rng: np.random.Generator) -> np.ndarray:
    return np.stack([np.rint(blurred(image[..., c], BLUR[severity - 1])) for c in range(image.shape[2])], -1)


def glare(image: np.ndarray, severity: int, rng: np.random.Generator) -> np.ndarray:
    """Reflections as on curved metal: stretched bell-shaped spots, laid over the image as light on a screen.

    There are one to three spots, each with a spread of 3 to 8 % of the image's diagonal, up to four times longer than
    wide in a drawn direction; the brightest point takes away 15 % of the remaining darkness a severity.
    """
    (h, w), dark = image.shape[:2], 1.0
    y, x = np.mgrid[0:h, 0:w]
    for _ in range(int(rng.integers(1, 4))):
        angle, long = rng.uniform(0, math.pi), rng.uniform(1, 4)
        wide = max(0.5, math.hypot(h, w) * rng.uniform(0.03, 0.08))
        v, u = y - rng.uniform(0, h - 1), x - rng.uniform(0, w - 1)
        along, over = u * math.cos(angle) + v * math.sin(angle), v * math.cos(angle) - u * math.sin(angle)
        dark = dark * (1 - 0.15 * severity * np.exp(-0.5 * ((along / (wide * long)) ** 2 + (over / wide) ** 2)))
    return 255 - (255 - image) * dark[..., None]


# Quality by severity, and the two quantisation tables of the JPEG standard's annex K, row by row.
QUALITY = (90, 70, 50, 30, 15)
LUMA_STEPS = """16 11 10 16 24 40 51 61 12 12 14 19 26 58 60 55 14 13 16 24 40 57 69 56 14 17 22 29 51 87 80 62
18 22 37 56 68 109 103 77 24 35 55 64 81 104 113 92 49 64 78 87 103 121 120 101 72 92 95 98 112 100 103 99"""
CHROMA_STEPS = """17 18 24 47 99 99 99 99 18 21 26 66 99 99 99 99 24 26 56 99 99 99 99 99 47 66 99 99 99 99 99 99
99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99"""
COSINES = np.array([[math.sqrt((1 if k == 0 else 2) / 8) * math.cos((2 * n + 1) * k * math.pi / 16) for n in range(8)] for k in range(8)])


def steps(table: str, quality: int) -> np.ndarray:
    """A quantisation table at a quality of 1 to 100, as the usual encoders scale it."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(table.split(), int).reshape(8, 8) * scale + 50) // 100, 1, 255)


def through_blocks(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A plane (sides in whole blocks) after the cosine transform of its 8 x 8 blocks, rounding to ``table`` and back. Entropy coding would lose nothing."""
    h, w = plane.shape
    blocks = (plane - 128).reshape(h // 8, 8, w // 8, 8).transpose(0, 2, 1, 3)
    kept = np.floor(COSINES @ blocks @ COSINES.T / table + 0.5) * table
    return np.clip(np.floor((COSINES.T @ kept @ COSINES).transpose(0, 2, 1, 3).reshape(h, w) + 128.5), 0, 255)


def jpeg_at(image: np.ndarray, quality: int) -> np.ndarray:
    """One channel, or three as luma and two halved chroma planes; the last rows and columns are repeated to whole blocks."""
    h, w, c = image.shape
    side = 8 if c == 1 else 16
    wide = np.pad(image, ((0, -h % side), (0, -w % side), (0, 0)), mode="edge")
    if c == 1:
        return through_blocks(wide[..., 0], steps(LUMA_STEPS, quality))[:h, :w, None]
    red, green, blue = wide[..., 0], wide[..., 1], wide[..., 2]
    luma = wide[..., :3] @ np.array(LUMA)
    chroma = [(blue - luma) / (2 - 2 * LUMA[2]) + 128, (red - luma) / (2 - 2 * LUMA[0]) + 128]
    luma = through_blocks(np.floor(luma + 0.5), steps(LUMA_STEPS, quality))
    table, (high, across) = steps(CHROMA_STEPS, quality), luma.shape
    halved = [p.reshape(high // 2, 2, across // 2, 2).mean((1, 3)) for p in chroma]
    halved = [np.pad(p, ((0, -p.shape[0] % 8), (0, -p.shape[1] % 8)), mode="edge") for p in halved]
    cb, cr = (through_blocks(np.floor(p + 0.5), table)[: high // 2, : across // 2].repeat(2, 0).repeat(2, 1) - 128 for p in halved)
    red, blue = luma + (2 - 2 * LUMA[0]) * cr, luma + (2 - 2 * LUMA[2]) * cb
    green = (luma - LUMA[0] * red - LUMA[2] * blue) / LUMA[1]
    return np.rint(np.stack([red, green, blue], -1))[:h, :w]


def jpeg(image: np.ndarray, severity: int, rng: np.random.Generator) -> np.ndarray:
    return jpeg_at(image, QUALITY[severity - 1])


def geo_jitter(image: np.ndarray, severity: int, rng: np.random.Generator) -> np.ndarray:
    """A small rotation, scaling and shift, with linear interpolation and mirrored borders."""
    s, (h, w) = severity / 5, image.shape[:2]
    angle, scale = math.radians(rng.uniform(-5, 5) * s), 1 + rng.uniform(-0.05, 0.05) * s
    dy, dx = rng.uniform(-0.05, 0.05, 2) * s * (h, w)
    y, x = np.mgrid[0:h, 0:w].astype(float)
    v, u = (y - (h - 1) / 2 - dy) / scale, (x - (w - 1) / 2 - dx) / scale
    y, x = math.cos(angle) * v - math.sin(angle) * u + (h - 1) / 2, math.sin(angle) * v + math.cos(angle) * u + (w - 1) / 2

    def mirrored(at: np.ndarray, n: int) -> np.ndarray:
        at = np.abs(at) % max(1, 2 * n - 2)
        return np.where(at >= n, 2 * n - 2 - at, at)

    y, x = mirrored(y, h), mirrored(x, w)
    fy, fx = np.minimum(y.astype(int), max(0, h - 2)), np.minimum(x.astype(int), max(0, w - 2))
    ty, tx, below, right = (y - fy)[..., None], (x - fx)[..., None], np.minimum(fy + 1, h - 1), np.minimum(fx + 1, w - 1)
    return (1 - ty) * ((1 - tx) * image[fy, fx] + tx * image[fy, right]) + ty * ((1 - tx) * image[below, fx] + tx * image[below, right])


CORRUPTIONS: dict[str, Callable] = {f.__name__: f for f in (lighting, blur, glare, jpeg, geo_jitter)}


def _corrupted(batches, corruption: str, severity: int, seed: int):
    for part, images in rows_of(batches):
        out = []
        for key, image in zip(part.column("image_id").to_pylist(), images, strict=True):
            rng = np.random.default_rng([seed & 0xFFFFFFFF, *str(key).encode()])
            out.append(None if image is None else np.clip(CORRUPTIONS[corruption](image, severity, rng), 0, 255).astype(int).ravel().tolist())
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in IMAGE[:4]), pa.array(out, pa.list_(pa.int32()))], IMAGE)


def corrupt(images: DataFrame, corruption: str, severity: int = 1, seed: int = 0) -> DataFrame:
    """Image rows with a corruption of severity 1 to 5; what is drawn depends on seed and image_id alone."""
    if corruption not in CORRUPTIONS or not 1 <= severity <= 5:
        raise ValueError("unknown corruption, or severity not in 1 to 5")
    rows = images.select("image_id", *(F.col(c).cast("int").alias(c) for c in IMAGE[1:4]), F.col("data").cast("array<int>").alias("data"))
    return rows.mapInArrow(partial(_corrupted, corruption=corruption, severity=severity, seed=seed), rows.schema)
