"""Line dedup: winnowed line hashes as fingerprints, joined by position, extended both ways, and later repeated runs deleted."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import materialise, pieces, row_keys

_BLANK = " \t\r"
_WORD = re.compile(r"[^ \t\r]+")
_KEY = "none boolean, doc long, sub long"
_MARKS = f"name long, {_KEY}, at int, size int, around array<long>"
_ARROW = pa.schema([("name", pa.int64()), ("none", pa.bool_()), ("doc", pa.int64()), ("sub", pa.int64()), ("at", pa.int32()), ("size", pa.int32()), ("around", pa.list_(pa.int64()))])


def lines_of(text: str) -> tuple[list[str], list[int]]:
    """All lines of a text, and the indices of those that aren't blank."""
    lines = text.split("\n")
    return lines, [i for i, x in enumerate(lines) if x.strip(_BLANK)]


def passages(stripped: list[str], most_lines: int, long_words: int) -> list[tuple[int, int]]:
    """(start, size) of each run of at most most_lines lines that has long_words words or more, and no shorter run in it that has."""
    bound = [x.count(" ") + x.count("\t") + x.count("\r") + 1 for x in stripped]  # words at most
    words: dict[int, int] = {}

    def reaches(i: int, size: int) -> bool:
        if sum(bound[i : i + size]) < long_words:
            return False
        for k in range(i, i + size):
            if k not in words:
                words[k] = len(_WORD.findall(stripped[k]))
        return sum(words[k] for k in range(i, i + size)) >= long_words

    out = []
    for size in range(1, most_lines + 1):
        out += [(i, size) for i in range(len(stripped) - size + 1) if reaches(i, size) and (size == 1 or not (reaches(i, size - 1) or reaches(i + 1, size - 1)))]
    return out


def winnowed(hashes: list[int], window: int) -> list[tuple[int, int, int]]:
    """(position, first window, last window) of each position that holds the least hash, the first of equal ones, of the windows that start there.

    Every run of `window` lines has one such position, so two equal runs hold the same fingerprint at the same place.
    """
    out: list[list[int]] = []
    for start in range(len(hashes) - window + 1):
        at = min(range(start, start + window), key=hashes.__getitem__)
        if out and out[-1][0] == at:
            out[-1][2] = start
        else:
            out.append([at, start, start])
    return [(a, b, c) for a, b, c in out]


def fingerprints(text: str, run: int, long_words: int, most_lines: int) -> list[tuple[int, int, int, list[int]]]:
    """(fingerprint, line, size, line hashes) of the places of a text that are compared; lines are those that aren't blank.

    A winnowed position has size 0 and the hashes of all lines in the windows that it stands for, led by the number of
    those before it. A shortest run of at most most_lines lines, fewer than `run`, with long_words words or more has its
    first line, its size and two hashes a line.
    """
    lines, at = lines_of(text)
    stripped = [lines[i].strip(_BLANK) for i in at]
    whole = [xxhash.xxh3_128_intdigest(x.encode("utf-8", "surrogatepass")) for x in stripped]
    hashes = [(x & _MASK) - (1 << 63) for x in whole]
    out = [(hashes[p], p, 0, [p - first, *hashes[first : last + run]]) for p, first, last in winnowed(hashes, run)]
    for i, size in passages(stripped, min(most_lines, run - 1), long_words):
        out.append((min(hashes[i : i + size]), i, size, [h for x in whole[i : i + size] for h in ((x & _MASK) - (1 << 63), (x >> 64) - (1 << 63))]))
    return out


_MASK = (1 << 64) - 1


def _sampler(run: int, long_words: int, most_lines: int) -> Callable:
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            rows = []
            for none, doc, sub, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                rows += [(name, none, doc, sub, at, size, around) for name, at, size, around in fingerprints(text, run, long_words, most_lines)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    return sample


def _remover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        out = []
        for text, ranges in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
            lines, at = lines_of(text)
            gone = np.zeros(len(at) + 1, bool)
            for r in ranges or []:
                gone[r["start"] : r["start"] + r["size"]] = True
            removed = {at[i] for i in np.flatnonzero(gone[:-1])}
            out.append((len(at), len(removed), int((gone[1:] < gone[:-1]).sum()), "\n".join(x for i, x in enumerate(lines) if i not in removed) if removed else text))
        made = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
        yield pa.RecordBatch.from_arrays([*b.columns[:-2], *made], [*b.schema.names[:-2], "n_lines", "n_removed", "n_runs", "kept"])


def line_dedup(df: DataFrame, run: int = 3, long_words: int = 50, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, most_lines: int | None = None) -> DataFrame:
    """Deletes lines in runs that occur earlier: the columns in keep (default: the id), n_lines, n_removed, n_runs and kept, one row per row of df.

    A line is compared without spaces, tabs and carriage returns at its ends; blank lines are neither compared nor
    deleted nor counted. A run repeats if its `run` lines in a row, or fewer lines in a row that together have long_words
    words or more (the shortest such runs; of at most most_lines lines, if given), also occur earlier: at a smaller id,
    or above in the same text. Repeats are judged on the input; overlapping ones are deleted as one run, extended as far
    as it goes both ways.

    Winnowing: of every `run` lines in a row the least line hash is their fingerprint; only its position is kept, with
    the lines around it, and about half of all lines are one. Positions of fingerprints that occur once are dropped.
    The others are joined by fingerprint and extended both ways: a run of `run` lines around one that an earlier
    position also has is repeated, and runs that overlap add up to the longest ones. Places are compared with the first
    of their kind, so a frequent line makes as many rows as it has places.

    Null texts count as empty; null ids come last; rows with the same id are ordered by a hash of their text, and rows
    that repeat id and text count as one. Columns in keep may have any names but those of the results, which win.
    An empty df gives an empty result.
    """
    keep = [c for c in keep or [id_col] if c not in ("n_lines", "n_removed", "n_runs", "kept")]
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys, _ = row_keys(df, id_col, text)
    key = [k.split()[0] for k in _KEY.split(", ")]
    found = materialise(df.select(*keys, text.alias("text")).mapInArrow(_sampler(run, long_words, run - 1 if most_lines is None else most_lines), _MARKS), "lines")
    names = found.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    shared = found.join(names, "name")
    # The runs that a position stands for: from the first to the last window around it that has it as fingerprint.
    window = F.sequence(F.lit(0), F.size("around") - 1 - run)
    runs = shared.where("size = 0").select(*key, "at", "around", F.explode(window).alias("k"))
    runs = runs.select(*key, (F.col("at") - F.get("around", F.lit(0)) + F.col("k")).cast("int").alias("start"), F.lit(run).alias("size"), F.slice("around", F.col("k") + 2, run).alias("lines"))
    runs = runs.unionAll(shared.where("size > 0").select(*key, F.col("at").alias("start"), "size", F.col("around").alias("lines")))
    place = F.struct(*key, "start")
    first = runs.groupBy("lines", "size").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("lines").alias("r_lines"), F.col("size").alias("r_size"), "first")
    later = runs.join(first, (F.col("lines") == F.col("r_lines")) & (F.col("size") == F.col("r_size"))).where(place > F.col("first"))
    ranges = later.groupBy(*[F.col(k).alias(f"__{k}") for k in key]).agg(F.collect_set(F.struct("start", "size")).alias("__found"))
    rows = df.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)], text.alias("__text"), *keys)
    same = [F.col(k) == F.col(f"__{k}") for k in key]
    rows = rows.join(ranges, same, "left").select(*[f"__k{i}" for i in range(len(keep))], "__text", "__found")
    schema = rows.drop("__text", "__found").schema
    for c in ("n_lines", "n_removed", "n_runs"):
        schema = schema.add(c, "long")
    return rows.mapInArrow(_remover, schema.add("kept", "string")).withColumnsRenamed({f"__k{i}": c for i, c in enumerate(keep)})
