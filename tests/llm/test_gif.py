import hashlib
import random
import zlib

import numpy as np
import pytest

from quillgraph.llm.gif import histogram, Frame, gif_frames, lzw_decode, lzw_encode, media_columns, padded, read_gif, read_payload, shown, store_payload, write_gif


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 5000, 40_000])
def test_payload_round_trip(n):
    rng = random.Random(n)
    for raw in (rng.randbytes(n), b"a" * n, (b"hello world " * n)[:n]):
        payload = padded(raw)
        assert len(payload) % 64 == 0 and len(payload) > 0
        assert read_payload(store_payload(payload)) == payload


def test_several_frames():
    payload = padded(random.Random(1).randbytes(64 * 8192 * 2 + 100))
    media = store_payload(payload)
    width, height, frames = read_gif(media)
    assert (width, height, len(frames), frames[1].delay_ms) == (64, 8192, 3, 100)
    assert read_payload(media) == payload


def slow_decode(stream, low):
    """A bit-by-bit decoder."""
    bits = "".join(f"{b:08b}"[::-1] for b in stream)
    clear, at, width, table, before, out = 1 << low, 0, low + 1, [], None, b""
    while True:
        code, at = int(bits[at : at + width][::-1], 2), at + width
        if code == clear:
            table, width, before = [bytes([i]) for i in range(clear)] + [b"", b""], low + 1, None
            continue
        if code == clear + 1:
            return out
        entry = table[code] if code < len(table) else before + before[:1]
        if before is not None and len(table) < 4096:
            table.append(before + entry[:1])
        if len(table) == 1 << width and width < 12:
            width += 1
        out, before = out + entry, entry


def test_lzw_against_a_slow_decoder():
    rng = random.Random(2)
    for data in (rng.randbytes(20_000), bytes(rng.choices(b"abc", k=30_000)), b"", b"z"):
        stream = lzw_encode(data)
        assert slow_decode(stream, 8) == data
        assert lzw_decode(stream, 8, len(data)) == data


def test_small_colour_depth():
    # clear, 1, 6 (a repeat), end with 3-bit codes of 2 colour bits
    codes, bits = [(4, 3), (1, 3), (6, 3), (5, 3)], ""
    for value, width in codes:
        bits += f"{value:0{width}b}"[::-1]
    bits = bits.ljust(16, "0")
    stream = bytes(int(bits[i : i + 8][::-1], 2) for i in (0, 8))
    assert lzw_decode(stream, 2, 3) == slow_decode(stream, 2) == bytes([1, 1, 1])


def test_disposal_and_transparency():
    palette = np.zeros((256, 3), np.uint8)
    palette[1], palette[2] = (255, 0, 0), (0, 0, 255)
    full = Frame(0, 0, 2, 2, 100, 1, None, palette, np.array([[1, 1], [1, 1]], np.uint8))
    dot = lambda d: Frame(1, 0, 1, 2, 50, d, 0, palette, np.array([[2], [0]], np.uint8))
    for disposal, after in ((1, (0, 0, 255, 255)), (2, (0, 0, 0, 0)), (3, (255, 0, 0, 255))):
        last = Frame(0, 0, 1, 1, 20, 1, None, palette, np.array([[1]], np.uint8))
        width, height, frames = read_gif(write_gif([full, dot(disposal), last], 2, 2))
        canvases = list(shown(width, height, frames))
        assert tuple(canvases[1][0, 1]) == (0, 0, 255, 255) and tuple(canvases[1][1, 1]) == (255, 0, 0, 255)
        assert tuple(canvases[2][0, 1]) == after


def test_frames_operator(spark):
    palette = np.zeros((256, 3), np.uint8)
    palette[1] = (255, 0, 0)
    frame = Frame(0, 0, 2, 1, 70, 1, None, palette, np.array([[1, 0]], np.uint8))
    df = spark.createDataFrame([(1, write_gif([frame, frame], 2, 1)), (2, None), (3, b"junk")], "doc_id long, media binary")
    got = sorted(gif_frames(df, "doc_id", "media").collect(), key=lambda r: (r["doc_id"], r["frame_no"] or 0))
    assert [(r["doc_id"], r["frame_no"], r["start_ms"]) for r in got] == [(1, 0, 0), (1, 1, 70), (3, None, None)]
    assert got[0]["hist_red"][15] == 1 and got[0]["hist_red"][0] == 1 and got[2]["error"]


def test_media_columns(clashing, rows, no_docs):
    got = {}
    for r in media_columns(clashing).collect():
        got.setdefault(r["doc_id"], r)
    for doc, text, *_ in rows:
        payload, r = padded((text or "").encode()), got[doc]
        assert (r["n_bytes"], r["payload_bytes"]) == (len((text or "").encode()), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_sha256"] == hashlib.sha256(store_payload(payload)).hexdigest()
        bins = list(map(int, r["feature"].split(",")))  # red, green and blue of grey pixels
        assert bins[:16] == bins[16:32] == bins[32:] == histogram(np.frombuffer(payload, np.uint8))
    assert media_columns(no_docs).count() == 0
