"""Media columns: bytes stored as baseline JPEG images, and the dimensions and thumbnail hashes of such columns.

store() adds a column of images that hold each text; describe() reads any column of baseline JPEGs back. Both are maps over
Arrow batches, cut into slices of bounded size; there is no shuffle, and a lost task is simply run again.

A null text is stored like an empty one; texts of any length are stored whole, long ones as several images. Equal texts have equal
media, rows that repeat are stored each. Null or unreadable media have null features. An empty table gives an empty result. Columns of
the caller with the names of features are replaced by describe(), others pass through; store() takes id and text only."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from . import jpeg
from .kernels import slices, text_bytes

_FEATURES = "n_images long, width long, height long, n_samples long, samples_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, thumb_hash string"


def padded(data: np.ndarray) -> np.ndarray:
    """The bytes, with bytes 255 up to a positive multiple of the unit."""
    return np.pad(data, (0, max(jpeg.UNIT, -(-len(data) // jpeg.UNIT) * jpeg.UNIT) - len(data)), constant_values=255)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes as JPEG images."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                data, at = text_bytes(part.column("text"))
                media = jpeg.encode([padded(data[at[i] : at[i + 1]]) for i in range(len(at) - 1)])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(at), pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, media binary")


def thumb_hash(thumb: np.ndarray) -> str:
    """A 64-bit average hash of a thumbnail, in hexadecimal: which cells of an 8x8 grid are brighter than the mean cell."""
    grid = thumb.astype(np.int64)
    for axis in (0, 1):
        n = grid.shape[axis]
        if n < 8:
            grid = np.repeat(grid, 8, axis)
            n *= 8
        edges = np.arange(8) * n // 8
        grid = np.add.reduceat(grid, edges, axis) * 840 // np.diff(np.append(edges, n)).reshape((-1, 1) if axis == 0 else (1, -1))
    return np.packbits(grid > grid.mean()).tobytes().hex()


def features(media: bytes, images: list[tuple[jpeg.Frame, np.ndarray]]) -> tuple:
    samples = b"".join(t.tobytes() for _, t in images)
    f = images[0][0]
    return len(images), f.width, f.height, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(media), hashlib.sha256(media).hexdigest(), "|".join(thumb_hash(t) for _, t in images)


def describe(df: DataFrame, media_col: str = "media") -> DataFrame:
    """The columns of df but media, with features of each row's images: number, dimensions of the first, the thumbnails' samples (how many, digest, checksum of the last 32), the stored form's length and digest, and a hash of each thumbnail."""
    names = [f.split()[0] for f in _FEATURES.split(", ")]
    others = [c for c in df.columns if c != media_col and c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for part in slices(batch, media_col, 1 << 21):
                media = part.column(media_col).to_pylist()
                known = [i for i, m in enumerate(media) if m is not None]
                rows: list[tuple] = [(None,) * len(kinds)] * len(media)
                try:
                    for i, images in zip(known, jpeg.decode([media[i] for i in known]), strict=True):
                        rows[i] = features(media[i], images)
                except (ValueError, KeyError, IndexError):
                    # One of them is broken: each on its own.
                    for i in known:
                        try:
                            rows[i] = features(media[i], jpeg.decode([media[i]])[0])
                        except (ValueError, KeyError, IndexError):
                            pass
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in others], *columns], [*others, *names])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in others)
    return df.select(*others, media_col).mapInArrow(run, f"{fields}, {_FEATURES}" if others else _FEATURES)
