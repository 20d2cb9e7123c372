"""Images through palettes of their own: the nearest entry of each pixel, or errors passed on in lines that turn at their ends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Levels of a channel that share a cell of the inverse table: four cells a channel, 256 in all.
CELL = 64


class InverseTable:
    """For each cell of colours the entries that can be nearest to one of it: none whose least distance to the cell exceeds another's greatest."""

    def __init__(self, palette: np.ndarray):
        self.palette = palette.astype(np.int64)
        low = np.stack(np.meshgrid(*[np.arange(0, 256, CELL)] * 4, indexing="ij"), axis=-1).reshape(-1, 1, 4)
        high = low + CELL - 1
        near = (np.maximum(np.maximum(low - self.palette, self.palette - high), 0) ** 2).sum(axis=2)
        far = (np.maximum(np.abs(self.palette - low), np.abs(self.palette - high)) ** 2).sum(axis=2)
        self.able = [np.flatnonzero(row) for row in near <= far.min(axis=1, keepdims=True)]

    def nearest(self, colours: np.ndarray) -> np.ndarray:
        """Places of the nearest entries, the first of equally near ones."""
        colours = colours.astype(np.int64)
        cell = (colours // CELL) @ np.array([64, 16, 4, 1])
        out = np.empty(len(colours), np.int64)
        for c in np.unique(cell):
            at, able = np.flatnonzero(cell == c), self.able[c]
            out[at] = able[((colours[at, None] - self.palette[able]) ** 2).sum(axis=2).argmin(axis=1)]
        return out


def plain(image: np.ndarray, palette: np.ndarray) -> np.ndarray:
    """Each pixel's nearest entry. Colours are looked up once each."""
    colours, place = np.unique(np.ascontiguousarray(image).view(np.uint32).reshape(-1), return_inverse=True)
    return InverseTable(palette).nearest(colours.view(np.uint8).reshape(-1, 4))[place].reshape(image.shape[:2])


def serpentine(images: np.ndarray, palettes: np.ndarray) -> np.ndarray:
    """Entries of images of one size (image, row, column, channel), each by its palette (image, entry, channel), with Floyd-Steinberg errors.

    Even lines go to the right, odd ones to the left, and what is passed on is turned with them. A pixel of all images is
    done at once.
    """
    many, height, width, _ = images.shape
    work = np.zeros((many, height + 1, width + 2, 4), np.float32)
    work[:, :height, 1 : width + 1] = images
    out, every = np.empty((many, height, width), np.int64), np.arange(many)
    for y in range(height):
        ahead = 1 if y % 2 == 0 else -1
        for x in range(1, width + 1) if ahead == 1 else range(width, 0, -1):
            old = np.clip(work[:, y, x], 0, 255)
            best = ((old[:, None] - palettes) ** 2).sum(axis=2).argmin(axis=1)
            error = old - palettes[every, best]
            out[:, y, x - 1] = best
            for dx, dy, share in ((ahead, 0, 7), (-ahead, 1, 3), (0, 1, 5), (ahead, 1, 1)):
                work[:, y + dy, x + dx] += error * np.float32(share / 16)
    return out


def indexed(df: DataFrame, image: str, width: str, palette: str, errors: bool = False, to: str = "indices") -> DataFrame:
    """df with the image's pixels as entries of its palette, and a column of their places, a byte each.

    palette: an array of at most 256 entries, each an array of r, g, b, a from 0 to 255. Null images, images that don't fit
    their width, and images without a palette stay and have no places. The writer of PNG files writes what comes out by
    palette.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pixels, places, alike = batch.column(image).to_pylist(), [None] * batch.num_rows, {}
            tables = [None if p is None or not 0 < len(p) <= 256 else np.array(p, np.float32) for p in batch.column(palette).to_pylist()]
            for k, (raw, w) in enumerate(zip(pixels, batch.column(width).to_pylist(), strict=True)):
                if raw and w and tables[k] is not None and len(raw) % (4 * w) == 0:
                    alike.setdefault((len(raw), w, len(tables[k])), []).append(k)
            for (size, w, _), group in alike.items():
                stacked = np.frombuffer(b"".join([pixels[k] for k in group]), np.uint8).reshape(len(group), size // (4 * w), w, 4)
                found = serpentine(stacked, np.stack([tables[k] for k in group])) if errors else [plain(stacked[i], tables[k]) for i, k in enumerate(group)]
                for k, index in zip(group, found, strict=True):
                    places[k], pixels[k] = index.astype(np.uint8).tobytes(), tables[k].astype(np.uint8)[index].tobytes()
            at = batch.schema.get_field_index(image)
            yield pa.RecordBatch.from_arrays([*batch.set_column(at, batch.schema.field(at), pa.array(pixels, pa.binary())).columns, pa.array(places, pa.binary())], [*batch.schema.names, to])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(to, T.BinaryType())]))
