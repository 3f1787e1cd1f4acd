"""Pixel kernels: numpy over Arrow batches of images (data, height, width, nChannels in BGR order)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import clamped, exposure_score


def image_array(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8, height * width * channels).reshape(height, width, channels)


def gray(image: np.ndarray) -> np.ndarray:
    """Luma of BGR in 14-bit fixed point, rounded."""
    if image.shape[2] == 1:
        return image[:, :, 0]
    b, g, r = (image[:, :, i].astype(np.int64) for i in range(3))
    return ((b * 1868 + g * 9617 + r * 4899 + 8192) >> 14).astype(np.uint8)


def laplacian_variance(plane: np.ndarray) -> float:
    """Population variance of the four-neighbour Laplacian; borders reflect without repeating the edge."""
    reflect = lambda n: np.abs(np.arange(-1, n + 1)) if n == 1 else (n - 1) - np.abs((n - 1) - np.abs(np.arange(-1, n + 1)))
    rows, columns = reflect(plane.shape[0]) % max(1, plane.shape[0]), reflect(plane.shape[1]) % max(1, plane.shape[1])
    wide = plane.astype(np.float64)[np.ix_(rows, columns)]
    return float((wide[:-2, 1:-1] + wide[2:, 1:-1] + wide[1:-1, :-2] + wide[1:-1, 2:] - 4 * wide[1:-1, 1:-1]).var())


#: Bins of the three histograms: hue, saturation, value.
HSV_BINS = (180, 256, 256)


def hsv_histograms(image: np.ndarray) -> np.ndarray:
    """Counts of hue (180 bins of two degrees), saturation (256) and value (256), one after the other. Gray has hue and saturation 0."""
    if image.shape[2] == 1:
        none = [np.bincount([0], [image.size], minlength=n) for n in HSV_BINS[:2]]
        return np.concatenate([*none, np.bincount(image.ravel(), minlength=256)]).astype(np.float64)
    b, g, r = (image[:, :, i].astype(np.float64).ravel() for i in range(3))
    v, low = np.maximum(np.maximum(b, g), r), np.minimum(np.minimum(b, g), r)
    span = v - low
    safe = np.where(span == 0, 1, span)
    hue = np.where(v == r, (g - b) / safe, np.where(v == g, 2 + (b - r) / safe, 4 + (r - g) / safe)) * 30
    hue = np.where(span == 0, 0, np.round(hue) % 180).astype(np.int64)
    saturation = np.round(np.where(v == 0, 0, 255 * span / np.where(v == 0, 1, v))).astype(np.int64)
    return np.concatenate([np.bincount(hue, minlength=180), np.bincount(saturation, minlength=256), np.bincount(v.astype(np.int64), minlength=256)]).astype(np.float64)


def target_size(height: Column, width: Column, most: int = 1024) -> Column:
    """(height, width) after capping the longer side; shares are cut off, not rounded."""
    longer = F.greatest(height, width)
    scaled = lambda side: F.when(longer > most, F.floor(side * F.lit(float(most)) / longer).cast("int")).otherwise(side)
    return F.struct(scaled(height).alias("height"), scaled(width).alias("width"))


#: Places of the kernel's taps from the one at or before a point.
TAPS = np.arange(-3, 5)


def taps(old: int, new: int) -> tuple[np.ndarray, np.ndarray]:
    """The eight places that each new place is made of, and their shares in 1/2048, which sum to about that. Beyond a border its last place is repeated."""
    at = (np.arange(new) + 0.5) * (old / new) - 0.5
    start = np.floor(at)
    x = (at - start)[:, None] - TAPS
    w = np.sinc(x) * np.sinc(x / 4)
    return np.clip(start.astype(np.int64)[:, None] + TAPS, 0, old - 1), np.rint(w / w.sum(axis=1, keepdims=True) * 2048).astype(np.int64)


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Lanczos resampling with four lobes, columns first and then rows, in fixed point of 11 bits each: eight gathers a direction, so memory follows
    the picture's size. Rounded once, at the end, and cut to 0 to 255."""

    def along(values: np.ndarray, axis: int, new: int) -> np.ndarray:
        places, shares = taps(values.shape[axis], new)
        shape = tuple(new if i == axis else 1 for i in range(3))
        out = np.zeros(tuple(new if i == axis else n for i, n in enumerate(values.shape)), np.int64)
        for place, share in zip(places.T, shares.T, strict=True):
            out += values.take(place, axis=axis) * share.reshape(shape)
        return out

    out = along(along(image, 1, width), 0, height)
    return np.clip((out + (1 << 21)) >> 22, 0, 255).astype(np.uint8)


#: The columns that measures() fills.
MEASURES = "variance double, clipped double, crushed double, middle double, mean double, deviation double, histogram array<double>"


def measures(image: np.ndarray, most: int = 1024) -> tuple:
    """The raw measures of one image, capped to `most` on the longer side."""
    height, width = image.shape[:2]
    longer = max(height, width)
    if longer > most:
        image = resized(image, max(1, int(height * most / longer)), max(1, int(width * most / longer)))
    plane = gray(image)
    bins = np.bincount(plane.ravel(), minlength=256) / plane.size
    return laplacian_variance(plane), bins[250:].sum(), bins[:5].sum(), bins[50:200].sum(), plane.mean(), plane.std(), hsv_histograms(image)


#: The most rows and bytes of pixels whose measures are together in a task; a histogram is a good 5 KB.
SLICE_ROWS, SLICE_BYTES = 256, 4 << 20


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Row slices of a batch of at most SLICE_ROWS rows and SLICE_BYTES of data, one row at least."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column("data")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(total):
        fit = int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE_BYTES, side="right"))
        end = max(at + 1, min(fit, at + SLICE_ROWS))
        yield batch.slice(at, end - at)
        at = end


def measure_pixels(images: DataFrame, key: str = "origin", most: int = 1024) -> DataFrame:
    """Rows (key, raw measures, histogram, error) of each image, capped to `most` on the longer side. A broken image
    has nulls and the error's text, and doesn't end the scan. Results leave the task by slices of a batch, so memory doesn't follow
    the rows of a batch."""
    types = [pa.float64()] * 6 + [pa.list_(pa.float64()), pa.string()]
    names = [key, *(c.split()[0] for c in MEASURES.split(", ")), "error"]

    def measured(data: bytes, height: int, width: int, channels: int) -> tuple:
        try:
            return (*measures(image_array(data, height, width, channels), most), None)
        except Exception as e:  # noqa: BLE001  one photo must not end the scan
            return (None,) * 7 + (f"{type(e).__name__}: {e}",)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                cells = zip(*(part.column(c) for c in ("data", "height", "width", "nChannels")), strict=True)
                columns = zip(*(measured(*(x.as_py() for x in row)) for row in cells), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(key), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    schema = f"{key} {images.schema[key].dataType.simpleString()}, {MEASURES}, error string"
    return images.select(key, "data", "height", "width", "nChannels").mapInArrow(run, schema)


def scores(found: DataFrame) -> DataFrame:
    """Adds sharpness and exposure, 0 to 100, to raw measures."""
    return found.withColumns({"sharpness": clamped(F.col("variance") / 10), "exposure": exposure_score(F.col("clipped"), F.col("crushed"), F.col("middle"))})


def pixel_scores(images: DataFrame, key: str = "origin", most: int = 1024) -> DataFrame:
    """Adds sharpness and exposure, 0 to 100, to measure_pixels."""
    return scores(measure_pixels(images, key, most))
