"""Media columns: texts as GIF pictures, and GIF files as timed frames with colour histograms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusframe.llm import gif
from locusframe.llm.common import pieces

#: Samples of a picture row, and rows of a frame.
WIDTH, ROWS = 192, 256
_BINS = 16
_RESULT = "samples binary, frames array<struct<at_ms: bigint, delay_ms: bigint, disposal: int, width: int, height: int, histogram: array<bigint>>>, feature string"
_FRAME = pa.struct([("at_ms", pa.int64()), ("delay_ms", pa.int64()), ("disposal", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("histogram", pa.list_(pa.int64()))])


def _greys(values: np.ndarray) -> np.ndarray:
    return np.repeat(values.astype(np.uint8)[:, None], 3, axis=1)


def _bits(colours: int) -> int:
    return max(1, int(colours - 1).bit_length())


def text_to_gif(data: bytes) -> bytes:
    """data, filled with spaces to a positive multiple of WIDTH, as greys of its bytes; a frame each ROWS rows, shown for 100 ms.

    The palette holds the bytes that occur. A pixel that shows what is there already is transparent, and after a frame
    either it or what was there before it stays, whichever the next frame shares more pixels with. A frame of few bytes
    has a palette of its own.
    """
    rows = max(1, -(-len(data) // WIDTH))
    flat = np.full(rows * WIDTH, 32, np.uint8)
    flat[: len(data)] = np.frombuffer(data, np.uint8)
    used = np.flatnonzero(np.bincount(flat, minlength=256))
    index = np.zeros(256, np.uint8)
    index[used] = np.arange(len(used))
    index = index[flat].reshape(rows, WIDTH)
    pixels = flat.reshape(rows, WIDTH).astype(np.int16)
    parts = [(pixels[a : a + ROWS], index[a : a + ROWS]) for a in range(0, rows, ROWS)]
    frames, clear = [], len(used) if len(used) < 256 else None
    shown = np.full((min(rows, ROWS), WIDTH), -1, np.int16)
    for k, (part, at) in enumerate(parts):
        there = part == shown[: len(part)] if clear is not None else np.zeros(part.shape, bool)
        f = {"pixels": at, "disposal": 1}
        if there.any():
            f |= {"pixels": np.where(there, np.uint8(clear), at), "transparent": clear}
            own, small = np.unique(part[~there], return_inverse=True)
            if _bits(len(own) + 1) < _bits(len(used) + 1) and len(own) * 3 * 8 < (~there).sum():
                fill = np.full(part.shape, len(own), np.uint8)
                fill[~there] = small
                f |= {"pixels": fill, "transparent": len(own), "palette": _greys(np.append(own, 0))}
        after = shown.copy()
        after[: len(part)] = part
        if k + 1 < len(parts):
            following = parts[k + 1][0]
            if (following == shown[: len(following)]).sum() > (following == after[: len(following)]).sum():
                f["disposal"], after = 3, shown
        shown = after
        frames.append(f)
    return gif.write(frames, WIDTH, min(rows, ROWS), _greys(np.append(used, 0) if clear is not None else used))


def histogram(pixels: np.ndarray) -> np.ndarray:
    """Counts of each of _BINS shades of red, green and blue, of pixels that aren't transparent."""
    seen = pixels.reshape(-1, 4) if pixels[..., 3].all() else pixels[pixels[..., 3] > 0]
    return np.concatenate([np.bincount(seen[:, c], minlength=256).reshape(_BINS, -1).sum(axis=1) for c in range(3)])


def gif_columns(media: bytes) -> tuple[bytes, list[dict], str]:
    """Red samples of each frame's area, the frames, and a feature: size, frames, time and the histogram of all frames' areas."""
    width, height, frames = gif.read(media)
    out, samples, at, total = [], [], 0, np.zeros(3 * _BINS, np.int64)
    for f in frames:
        area = f.canvas[f.top : f.top + f.height, f.left : f.left + f.width]
        h = histogram(area)
        out.append({"at_ms": at, "delay_ms": f.delay_ms, "disposal": f.disposal, "width": f.width, "height": f.height, "histogram": h.tolist()})
        samples.append(area[..., 0].tobytes())
        at += f.delay_ms
        total += h
    return b"".join(samples), out, f"{width}x{height};{len(frames)};{at}ms;" + ",".join(map(str, total))


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8, unpadded) and media, a GIF file, for each row.

    Null texts count as empty, which is one row of spaces. Null ids and repeated rows are rows like any other; other
    columns of df are not carried, so none can clash. An empty df gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 200):
            texts = [x or b"" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, texts), pa.int64()), pa.array([text_to_gif(x) for x in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    picked = df.select(F.col(id_col).alias("doc_id"), F.encode(F.col(text_col), "UTF-8").alias("text"))
    return picked.mapInArrow(run, picked.select("doc_id").schema.add("n_bytes", "long").add("media", "binary"))


def decode(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """The id, samples (binary), frames (at_ms, delay_ms, disposal, width, height, colour histogram) and feature of each GIF file.

    Null media give null columns; files that are no whole GIF raise. Null ids, repeated rows and ties are rows like any
    other; further columns of df come first, except those named like a result, which the results replace.
    """
    names = ["samples", "frames", "feature"]
    kept = [c for c in df.columns if c not in (*names, "__media")]
    picked = df.select(*kept, F.col(media_col).alias("__media"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 200):
            rows = [gif_columns(x) if x is not None else (None, None, None) for x in b.column(len(kept)).to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
            made = [pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.list_(_FRAME), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *made], [*kept, *names])

    schema = T.StructType([*df.select(*kept).schema.fields, *T.StructType.fromDDL(_RESULT).fields])
    return picked.mapInArrow(run, schema)
