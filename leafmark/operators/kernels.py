"""Image kernels over pixel arrays (height x width or height x width x 3, 8 bits, BGR) and their use on image columns.

Each kernel is a plain NumPy function; `apply` runs one over Spark's image struct (origin, height, width, nChannels, mode, data) in Arrow
batches. What a page's pixels say (components, thresholds, lines, trimming) is measured on relations, in raster.py; cascades and recognition
models need libraries that are not part of this engine; see ocr.py for the interface.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


def gray(image: np.ndarray) -> np.ndarray:
    """Luma of a BGR image."""
    if image.ndim == 2:
        return image
    b, g, r = (image[..., k].astype(np.float64) for k in range(3))
    return np.clip(np.rint(0.114 * b + 0.587 * g + 0.299 * r), 0, 255).astype(np.uint8)


def three_channels(image: np.ndarray) -> np.ndarray:
    return np.repeat(image[..., None], 3, axis=2) if image.ndim == 2 else image[..., :3]


def turned(image: np.ndarray, clockwise: int) -> np.ndarray:
    """Turned by a multiple of 90 degrees."""
    if clockwise % 90:
        raise ValueError("only multiples of 90 degrees")
    return np.ascontiguousarray(np.rot90(image, -(clockwise // 90) % 4))


def shrunk(image: np.ndarray, most: int) -> tuple[np.ndarray, float]:
    """Bilinear, so that no side is longer than most; the scale."""
    h, w = image.shape[:2]
    scale = min(1.0, most / max(h, w, 1))
    if scale == 1.0:
        return image, 1.0
    return resized(image, max(1, round(h * scale)), max(1, round(w * scale))), scale


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    h, w = image.shape[:2]
    y, x = (np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1) for n, m in ((height, h), (width, w)))
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    if image.ndim == 3:
        fy, fx = fy[..., None], fx[..., None]
    p = image.astype(np.float64)
    top = p[y0][:, x0] * (1 - fx) + p[y0][:, x1] * fx
    low = p[y1][:, x0] * (1 - fx) + p[y1][:, x1] * fx
    return np.rint(top * (1 - fy) + low * fy).astype(np.uint8)


def content_box(image: np.ndarray, white: int = 245, margin: int = 0) -> tuple[int, int, int, int]:
    """x, y, w, h of what is darker than white, with a margin; the whole image if nothing is."""
    dark = gray(image) < white
    rows, cols = np.flatnonzero(dark.any(axis=1)), np.flatnonzero(dark.any(axis=0))
    h, w = dark.shape
    if not len(rows):
        return 0, 0, w, h
    x1, y1 = max(0, cols[0] - margin), max(0, rows[0] - margin)
    x2, y2 = min(w, cols[-1] + 1 + margin), min(h, rows[-1] + 1 + margin)
    return int(x1), int(y1), int(x2 - x1), int(y2 - y1)


def cropped(image: np.ndarray, box: tuple[int, int, int, int]) -> np.ndarray:
    x, y, w, h = box
    return image[max(0, y) : y + h, max(0, x) : x + w].copy()


def white_padded(image: np.ndarray, ratio: float = 0.04, least: int = 24) -> np.ndarray:
    pad = max(least, round(ratio * min(image.shape[:2])))
    return np.pad(image, ((pad, pad), (pad, pad), *([(0, 0)] * (image.ndim - 2))), constant_values=255)


def otsu(image: np.ndarray) -> tuple[int, np.ndarray]:
    """The threshold of the largest variance between the classes, and the image in black and white."""
    g = gray(image)
    n = np.bincount(g.ravel(), minlength=256).astype(float)
    weight, total = np.cumsum(n), np.cumsum(n * np.arange(256))
    other = weight[-1] - weight
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.nan_to_num((total * weight[-1] / weight[-1] - weight * total[-1] / weight[-1]) ** 2 / (weight * other), posinf=0.0)
    at = int(between.argmax())
    return at, np.where(g > at, 255, 0).astype(np.uint8)


def lower_band(image: np.ndarray, start: float = 0.50, end: float = 0.98) -> np.ndarray:
    h = image.shape[0]
    return image[round(h * start) : max(round(h * start) + 1, round(h * end))].copy()


def _taps(n: int, m: int, a: float = -0.75) -> tuple[np.ndarray, np.ndarray]:
    """For each of n places over m pixels the four pixels around it and their cubic weights."""
    at = (np.arange(n) + 0.5) * m / n - 0.5
    low = np.floor(at).astype(int)
    f = at - low
    d = np.stack([1 + f, f, 1 - f, 2 - f])
    near, far = ((a + 2) * d - (a + 3)) * d * d + 1, ((a * d - 5 * a) * d + 8 * a) * d - 4 * a
    return np.clip(low + np.arange(-1, 3)[:, None], 0, m - 1), np.where(d <= 1, near, far)


def enlarged(image: np.ndarray, scale: float = 3.0) -> np.ndarray:
    """Bicubic, by a factor; pixels beyond the rim are those of the rim."""
    out = image.astype(np.float64)
    for axis in (0, 1):
        n = out.shape[axis]
        at, weight = _taps(round(n * scale), n)
        shape = [-1 if a == axis else 1 for a in range(out.ndim)]
        out = sum(np.take(out, at[k], axis=axis) * weight[k].reshape(shape) for k in range(4))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def rotated(image: np.ndarray, degrees: float) -> np.ndarray:
    """Turned counter-clockwise about its middle into bounds that hold it all, white around it."""
    h, w = image.shape[:2]
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    bw, bh = int(h * abs(s) + w * abs(c)), int(h * abs(c) + w * abs(s))
    y, x = np.mgrid[:bh, :bw]
    dx, dy = x - bw / 2, y - bh / 2
    sx, sy = c * dx - s * dy + w / 2, s * dx + c * dy + h / 2
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    fx, fy = sx - x0, sy - y0
    wide = np.pad(image.astype(np.float64), ((1, 1), (1, 1), *([(0, 0)] * (image.ndim - 2))), constant_values=255)
    px = lambda i, j: wide[np.clip(j + 1, 0, h + 1), np.clip(i + 1, 0, w + 1)]
    if image.ndim == 3:
        fx, fy = fx[..., None], fy[..., None]
    out = (px(x0, y0) * (1 - fx) + px(x0 + 1, y0) * fx) * (1 - fy) + (px(x0, y0 + 1) * (1 - fx) + px(x0 + 1, y0 + 1) * fx) * fy
    return np.rint(out).astype(np.uint8)


def png(image: np.ndarray, level: int = 3) -> bytes:
    """The image as a PNG file, compressed by a level from 0 to 9."""
    if not 0 <= level <= 9:
        raise ValueError("levels are 0 to 9")
    h, w = image.shape[:2]
    rows = image if image.ndim == 2 else image[..., ::-1]
    raw = b"".join(b"\0" + np.ascontiguousarray(r).tobytes() for r in rows)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if image.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, level)) + chunk(b"IEND", b"")


def pixels(row: dict) -> np.ndarray:
    """The array of an image struct."""
    image = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["nChannels"])
    return image[..., 0] if row["nChannels"] == 1 else image


def apply(images: DataFrame, kernel: Callable[[np.ndarray], object], name: str, kind: str = "array<int>") -> DataFrame:
    """origin and the kernel's result, of a Spark type, for a DataFrame of Spark's image format; one image at a time is taken out of its batch."""
    shape = StructType.fromDDL(f"{name} {kind}")[0].dataType

    def run(batches):
        for batch in batches:
            origins, out = [], []
            for image in batch.column(batch.schema.get_field_index("image")):
                r = image.as_py()
                origins.append(r and r["origin"])
                out.append(None if r is None or not r["data"] else kernel(pixels(r)))
            yield pa.RecordBatch.from_arrays([pa.array(origins, pa.string()), pa.array(out, to_arrow_type(shape))], names=["origin", name])

    return images.select("image").mapInArrow(run, f"origin string, {name} {kind}")
