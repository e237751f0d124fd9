"""Sum-of-squares online packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.tokens import encoder, vocabulary_path

#: A document's pieces, packed: see pack().
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])


class Levels:
    """Open windows by fill level. counts[h]: how many windows are filled to h tokens (0 < h < capacity)."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.counts = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[list]] = {}

    def level_for(self, size: int) -> int:
        """The level (0: a new window) whose use leaves the least sum of squared counts; the fullest of equal ones."""
        b, n = self.capacity, self.counts
        levels = np.flatnonzero(n[: b - size + 1])
        after = levels + size
        # Taking one window from level h to h+size changes the sum by 2(n[h+size] - n[h]) + 2, or 1 - 2n[h] when full.
        change = np.where(after == b, 1 - 2 * n[levels], 2 * (n[after] - n[levels]) + 2)
        fresh = 2 * n[size] + 1 if size < b else 0
        if not len(levels) or fresh < (least := change.min()):
            return 0
        return int(levels[np.flatnonzero(change == least)[-1]])

    def place(self, piece: tuple) -> list | None:
        """Puts piece (document, start, id bytes, document's tokens) into a window; returns the window if that fills it."""
        size = len(piece[2]) // 4
        h = self.level_for(size)
        if h:
            window = self.open[h].pop()
            self.counts[h] -= 1
        else:
            window = [self.next_id, 0, []]
            self.next_id += 1
        window[1] += size
        window[2].append(piece)
        if window[1] == self.capacity:
            return window
        self.open.setdefault(window[1], []).append(window)
        self.counts[window[1]] += 1
        return None

    def close(self) -> Iterator[list]:
        """At the end of input: the emptiest windows' documents are cut into the gaps of the fullest; one window stays short at most."""
        left = sorted((w for ws in self.open.values() for w in ws), key=lambda w: (-w[1], w[0]))
        self.open, self.counts[:] = {}, 0
        while left:
            window = left.pop(0)
            while window[1] < self.capacity and left:
                donor = left[-1]
                doc, start, ids, total = donor[2].pop()
                take = min(self.capacity - window[1], len(ids) // 4)
                window[2].append((doc, start, ids[: 4 * take], total))
                window[1] += take
                donor[1] -= take
                if 4 * take < len(ids):
                    donor[2].append((doc, start + take, ids[4 * take :], total))
                if not donor[1]:
                    left.pop()
            yield window


def pack_stream(documents: Iterator[tuple[int | None, bytes]], capacity: int, first_id: int) -> Iterator[list]:
    """documents: (id, id bytes with the end id). Yields windows [sequence id, tokens, pieces]."""
    levels = Levels(capacity, first_id)
    step = 4 * capacity
    for doc, ids in documents:
        total = len(ids) // 4
        for at in range(0, len(ids), step):
            piece = (doc, at // 4, ids[at : at + step], total)
            if (full := levels.place(piece)) is not None:
                yield full
    yield from levels.close()


def pack(df: DataFrame, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", tokenizer_file: str | None = None, rank_file: str | None = None) -> DataFrame:
    """Packs every document into sequences of at most capacity tokens; one row per piece (SCHEMA).

    A document is its ids and then end_id. Documents longer than a sequence fill whole sequences; what remains is
    placed whole by the sum-of-squares rule. Each input partition is packed by itself, without a shuffle, and cuts
    its last open sequences together, so that it leaves one short sequence at most. Memory: the open sequences.
    Null and empty texts are one end id; null ids are kept; repeated rows are packed as often as they come; an empty
    df gives no rows; other columns are not carried.
    """
    files = (tokenizer_file or vocabulary_path("byte_bpe_50k.json"), rank_file or vocabulary_path("byte_bpe_50k.tiktoken"))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_packer(files, capacity, end_id), SCHEMA)


def _packer(files: tuple[str, str], capacity: int, end_id: int) -> Callable:
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*files).encode

        def documents() -> Iterator[tuple[int | None, bytes]]:
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    yield doc, encode(text.as_py() or "") + end

        rows: list[tuple] = []
        for sequence, _, pieces in pack_stream(documents(), capacity, TaskContext.get().partitionId() << 36):
            offset = 0
            for doc, start, ids, total in pieces:
                n = len(ids) // 4
                rows.append((doc, start, n, zlib.crc32(ids), total, sequence, offset))
                offset += n
            if len(rows) > 20_000:
                yield _batch(rows)
                rows = []
        yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_ARROW)
