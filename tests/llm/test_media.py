import hashlib
import zlib

import numpy as np
import pytest

from locusframe.llm import gif, media, queries

GREY = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)


@pytest.mark.parametrize("n", [1, 2, 253, 254, 255, 508, 509, 4000, 30_000])
@pytest.mark.parametrize("letters", [1, 2, 256])
def test_code_streams(n, letters):
    b = np.random.default_rng(n).integers(0, letters, n).astype(np.uint8).tobytes()
    assert gif.lzw_decode(gif.lzw_encode(b), 8, n).tobytes() == b
    small = bytes(x & 3 for x in b)
    assert gif.lzw_decode(gif.lzw_encode(small, 2), 2, n).tobytes() == small


def test_broken_streams_raise():
    with pytest.raises(ValueError):
        gif.lzw_decode(b"\x00", 8, 5)
    with pytest.raises(ValueError):
        gif.read(b"PNG...")


def test_disposal_transparency_and_times():
    full = np.full((4, 4), 10)
    frames = [
        {"pixels": full, "delay_ms": 50},
        {"pixels": np.array([[1, 2], [3, 4]]), "left": 1, "top": 1, "transparent": 2, "disposal": 3, "delay_ms": 70},
        {"pixels": np.array([[7]]), "disposal": 2, "delay_ms": 20},
        {"pixels": np.array([[9]]), "left": 3, "top": 3},
    ]
    w, h, got = gif.read(gif.write(frames, 4, 4, GREY))
    red = [f.canvas[..., 0].tolist() for f in got]
    assert (w, h) == (4, 4) and [f.delay_ms for f in got] == [50, 70, 20, 100]
    assert red[1] == [[10] * 4, [10, 1, 10, 10], [10, 3, 4, 10], [10] * 4]
    assert red[2] == [[7, 10, 10, 10], [10] * 4, [10] * 4, [10] * 4]
    assert got[3].canvas[0, 0].tolist() == [0, 0, 0, 0] and red[3][3][3] == 9


def test_code_stream_by_hand():
    # 2-bit samples 1 1 1 1 2: clear 4, then 1, 6 (1 1), 1, 2, end 5 in 3 bits, but the last two in 4 as the table has 9 entries.
    codes = [(4, 3), (1, 3), (6, 3), (1, 3), (2, 4), (5, 4)]
    acc = at = 0
    for c, w in codes:
        acc |= c << at
        at += w
    want = acc.to_bytes(-(-at // 8), "little")
    assert gif.lzw_encode(bytes([1, 1, 1, 1, 2]), 2) == want
    assert gif.lzw_decode(want, 2, 5).tolist() == [1, 1, 1, 1, 2]


def test_own_palettes_and_pixels_left_from_earlier_frames():
    page = bytes(np.random.default_rng(1).integers(97, 123, 192 * 256).astype(np.uint8))
    other = bytes(np.random.default_rng(2).integers(65, 91, 192 * 256).astype(np.uint8))
    changed = bytearray(page)
    changed[1000:9000] = b"0123" * 2000
    data = page + other + bytes(changed) + page[:5000]
    media_bytes = media.text_to_gif(data)
    _, _, frames = gif.read(media_bytes)
    assert [f.disposal for f in frames] == [1, 3, 3, 1]  # the third is like the first and the fourth too, so the second and third go again
    samples, _, _ = media.gif_columns(media_bytes)
    assert samples == data.ljust(len(samples), b" ") and len(media_bytes) < 0.75 * len(data)
    apart = sum(len(media.text_to_gif(x)) for x in (page, other))
    assert len(media_bytes) < apart + 10_000  # the third frame stores what differs


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 49_152, 49_153, 200_000])
def test_round_trip(n):
    b = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8).tobytes()
    samples, frames, _ = media.gif_columns(media.text_to_gif(b))
    assert samples == b.ljust(max(192, -(-n // 192) * 192)) and sum(sum(f["histogram"]) for f in frames) == 3 * len(samples)


def test_query(spark, tmp_path):
    rows = [(1, "né"), (2, None), (3, ""), (None, "x" * 1000), (1, "né")]
    spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, feature string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op4_media_columns(spark, str(tmp_path)).collect()
    assert len(got) == 5
    for g in got:
        b = (dict(rows)[g.doc_id] or "").encode()
        p = b.ljust(max(192, -(-len(b) // 192) * 192))
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert media.decode(media.store(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
    assert media.decode(spark.createDataFrame([(1, None)], "doc_id long, media binary")).first().samples is None
