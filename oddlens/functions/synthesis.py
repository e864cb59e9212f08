"""Made defects on image rows: seeded masks of gradient noise and shapes, blended by Poisson's equation.

Each image row gives one row: the changed image, its mask (array<int> of 0 and 1) and the label (1 where the mask has a
pixel). What is drawn depends on seed and image_id alone. Outside the mask nothing changes.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddlens.functions.images import IMAGE, rows_of
from oddlens.functions.maps import label_components


def gradient_noise(h: int, w: int, cells: float, rng: np.random.Generator) -> np.ndarray:
    """Noise of one octave: random directions at the corners of ``cells`` x ``cells`` squares, their dot products with the way to a pixel blended smoothly."""
    y, x = (np.arange(n) * cells / max(h, w) for n in (h, w))
    angle = rng.uniform(0, 2 * math.pi, (int(y[-1]) + 2, int(x[-1]) + 2))
    top, left = y.astype(int), x.astype(int)
    v, u = (y - top)[:, None], (x - left)[None]
    smooth = lambda t: t**3 * (t * (6 * t - 15) + 10)

    def corner(a: int, b: int) -> np.ndarray:
        direction = angle[np.ix_(top + a, left + b)]
        return np.sin(direction) * (v - a) + np.cos(direction) * (u - b)

    rows = [corner(a, 0) + smooth(u) * (corner(a, 1) - corner(a, 0)) for a in (0, 1)]
    return rows[0] + smooth(v) * (rows[1] - rows[0])


def fractal_noise(h: int, w: int, cells: float, octaves: int, rng: np.random.Generator) -> np.ndarray:
    """Octaves of double frequency and half height, scaled to 0..1."""
    total = sum(gradient_noise(h, w, cells * 2**k, rng) / 2**k for k in range(octaves))
    return (total - total.min()) / max(total.max() - total.min(), 1e-12)


def blob(h: int, w: int, part: float, rng: np.random.Generator) -> np.ndarray:
    """The component of the highest noise that holds the highest pixel: about ``part`` of the image at most."""
    noise = fractal_noise(h, w, 3, 3, rng)
    labels = label_components(noise >= np.quantile(noise, 1 - part))
    return labels == labels.ravel()[noise.argmax()]


def strokes(h: int, w: int, many: int, width: float, bend: float, rng: np.random.Generator) -> np.ndarray:
    """Lines that turn a little at each step."""
    y, x, out = *np.mgrid[0:h, 0:w], np.zeros((h, w), bool)
    for _ in range(many):
        at, angle = rng.uniform(0.2, 0.8, 2) * (h, w), rng.uniform(0, 2 * math.pi)
        for _ in range(max(3, int(0.5 * max(h, w)))):
            out |= (y - at[0]) ** 2 + (x - at[1]) ** 2 <= width**2
            at, angle = at + (math.sin(angle), math.cos(angle)), angle + rng.normal(0, bend)
    return out


def spots(h: int, w: int, many: int, size: float, rng: np.random.Generator) -> np.ndarray:
    y, x, out = *np.mgrid[0:h, 0:w], np.zeros((h, w), bool)
    for _ in range(many):
        cy, cx, r = rng.uniform(0, h), rng.uniform(0, w), max(0.8, size * min(h, w) * rng.uniform(0.5, 1))
        out |= (y - cy) ** 2 + (x - cx) ** 2 <= r * r
    return out


def poisson_blend(target: np.ndarray, source: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The plane that is ``target`` outside the mask and, inside, has the gradients of ``source`` as nearly as ``target`` at the rim allows.

    The equation is solved on the mask's box, one pixel wider, by sine transforms: gradients are the source's where both
    pixels are in the mask and the target's elsewhere, values on the box's rim are the target's.
    """
    if not mask.any():
        return target.copy()
    rows, columns = (np.flatnonzero(mask.any(k)) for k in (1, 0))
    wide = [np.pad(p, 1, mode="edge") for p in (target, source)]
    inside = np.pad(mask, 1)
    box = slice(rows[0], rows[-1] + 3), slice(columns[0], columns[-1] + 3)
    (t, s), m = (p[box] for p in wide), inside[box]
    down = np.where(m[1:] & m[:-1], np.diff(s, axis=0), np.diff(t, axis=0))
    right = np.where(m[:, 1:] & m[:, :-1], np.diff(s, axis=1), np.diff(t, axis=1))
    pull = np.diff(down, axis=0)[:, 1:-1] + np.diff(right, axis=1)[1:-1]
    pull[0] -= t[0, 1:-1]
    pull[-1] -= t[-1, 1:-1]
    pull[:, 0] -= t[1:-1, 0]
    pull[:, -1] -= t[1:-1, -1]
    (h, w) = pull.shape
    a, b = (np.sin(math.pi * np.outer(np.arange(1, n + 1), np.arange(1, n + 1)) / (n + 1)) for n in (h, w))
    scale = 2 * (np.cos(math.pi * np.arange(1, h + 1) / (h + 1))[:, None] + np.cos(math.pi * np.arange(1, w + 1) / (w + 1))[None] - 2)
    solved = a @ ((a @ pull @ b) / scale) @ b * 4 / ((h + 1) * (w + 1))
    out = target.copy()
    cut = slice(rows[0], rows[-1] + 1), slice(columns[0], columns[-1] + 1)
    out[cut] = np.where(mask[cut], solved, target[cut])
    return out


Draw = Callable[[int, int, np.random.Generator], np.ndarray]
#: Name -> mask, and how the source is made of the image: (contrast of its texture, brightness it is moved by, blended by Poisson's equation or as it is).
PRESETS: dict[str, tuple[Draw, float, float, bool]] = {
    "scratch": (lambda h, w, rng: strokes(h, w, 1, 0.9, 0.05, rng), 0.3, 90, False),
    "crack": (lambda h, w, rng: strokes(h, w, 2, 0.7, 0.5, rng), 0.3, -110, False),
    "stain": (lambda h, w, rng: blob(h, w, 0.2, rng), 1.0, -40, True),
    "texture": (lambda h, w, rng: blob(h, w, 0.25, rng), 3.0, 0, True),
    "pit": (lambda h, w, rng: spots(h, w, 3, 0.08, rng), 0.5, -70, False),
    "spatter": (lambda h, w, rng: spots(h, w, 9, 0.05, rng), 0.5, 60, False),
}


def made(image: np.ndarray, preset: str, rng: np.random.Generator, strength: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(image, mask): the source is the image with noise of its own spread and moved by the preset's brightness."""
    draw, contrast, lift, solved = PRESETS[preset]
    h, w, _ = image.shape
    mask = draw(h, w, rng)
    noise = (fractal_noise(h, w, 6, 4, rng) - 0.5) * 2 * contrast * max(float(image.std()), 8.0)
    out = image.copy()
    for c in range(image.shape[2]):
        source = image[..., c] + strength * (noise + lift)
        out[..., c] = poisson_blend(image[..., c], source, mask) if solved else np.where(mask, source, image[..., c])
    return np.where(mask[..., None], np.clip(np.rint(out), 0, 255), image), mask


def _made(batches, preset: str, seed: int, strength: float):
    for part, images in rows_of(batches):
        data, masks = [], []
        for key, image in zip(part.column("image_id").to_pylist(), images, strict=True):
            found = None if image is None else made(image, preset, np.random.default_rng([seed & 0xFFFFFFFF, *str(key).encode()]), strength)
            data.append(found and found[0].astype(int).ravel().tolist())
            masks.append(found and found[1].astype(int).ravel().tolist())
        labels = [None if m is None else int(any(m)) for m in masks]
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in IMAGE[:4]), pa.array(data, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.int32())), pa.array(labels, pa.int32())], [*IMAGE, "mask", "label"])


def synthesise(images: DataFrame, preset: str, seed: int = 0, strength: float = 1.0) -> DataFrame:
    """Image rows with a made defect, ``mask`` and ``label``; null where the data doesn't fit the size."""
    if preset not in PRESETS:
        raise KeyError(preset)
    rows = images.select("image_id", *(F.col(c).cast("int").alias(c) for c in IMAGE[1:4]), F.col("data").cast("array<int>").alias("data"))
    kind = f"image_id {rows.schema['image_id'].dataType.simpleString()}, height int, width int, channels int, data array<int>, mask array<int>, label int"
    return rows.mapInArrow(partial(_made, preset=preset, seed=seed, strength=strength), kind)
