"""GIF media columns: LZW streams, palettes, disposal, transparency, timed frames.

``gif_frames`` turns a column of GIF files into one row per timed frame with
colour histograms. ``store_payload`` and ``read_payload`` keep any bytes as
8-bit grey GIF frames and get them back.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = 64
#: rows of a stored frame; a longer payload takes several frames
FRAME_ROWS = 8192
CLEAR, END, FIRST, FULL = 256, 257, 258, 4096


@dataclass
class Frame:
    """One image of a GIF as stored: its place, timing, palette and index pixels."""

    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    transparent: int | None
    palette: np.ndarray
    pixels: np.ndarray


# --- LZW -------------------------------------------------------------------


def _widths(count: int, low: int) -> np.ndarray:
    """Bits of the first ``count`` codes after a clear, for ``low`` colour bits.

    When code i is read the table has grown by i - 1 entries; the width is what
    the next free entry needs, 12 bits at most.
    """
    free = np.arange(count) + (1 << low) + 1
    free[:1] += 1
    return np.clip(np.ceil(np.log2(free + 1)).astype(np.int64), low + 1, 12)


_WIDTHS = {low: _widths(FULL + 64, low) for low in range(2, 9)}
_STARTS = {low: np.concatenate(([0], np.cumsum(w))) for low, w in _WIDTHS.items()}


def lzw_encode(data: bytes) -> bytes:
    """A GIF code stream of 8-bit pixels."""
    parts: list[list[int]] = []
    codes: list[int] = []
    table: dict[int, int] = {}
    free, code = FIRST, data[0] if data else -1
    for byte in memoryview(data)[1:]:
        key = code << 8 | byte
        longer = table.get(key)
        if longer is not None:
            code = longer
            continue
        codes.append(code)
        code = byte
        if free < FULL:
            table[key] = free
            free += 1
        else:
            parts.append(codes)
            codes, table, free = [], {}, FIRST
    if code >= 0:
        codes.append(code)
    parts.append(codes)
    values, widths = [np.array([CLEAR])], [np.array([9])]
    for i, part in enumerate(parts):
        closing = CLEAR if i + 1 < len(parts) else END
        values.append(np.array([*part, closing]))
        widths.append(_WIDTHS[8][: len(part) + 1])
    value, width = np.concatenate(values), np.concatenate(widths)
    bits = (value[:, None] >> np.arange(12)) & 1
    return np.packbits(bits[np.arange(12) < width[:, None]].astype(np.uint8), bitorder="little").tobytes()


def lzw_decode(stream: bytes, low: int, most: int) -> bytes:
    """The pixels of a GIF code stream with ``low`` colour bits, ``most`` at most."""
    clear, end = 1 << low, (1 << low) + 1
    raw = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.uint32)
    window = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    widths, starts = _WIDTHS[low], _STARTS[low]
    fresh = [bytes([i]) for i in range(clear)] + [b"", b""]
    total, base, got, out = len(stream) * 8, 0, 0, []
    table, previous, index = list(fresh), b"", 0
    ended = False
    while not ended and base < total and got < most:
        # widths are known up to the next clear, so a run of codes is cut at once
        at = min(index, FULL)
        ahead = base + starts[at : FULL + 32] - starts[at]
        wide = widths[at : FULL + 32]
        ahead, wide = ahead[: len(wide)], wide[: len(ahead)]
        whole = ahead + wide <= total
        ahead, wide = ahead[whole], wide[whole]
        if not len(ahead):
            break
        codes = (window[ahead >> 3] >> (ahead & 7).astype(np.uint32)) & ((1 << wide) - 1).astype(np.uint32)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        run = codes[: stops[0]].tolist() if len(stops) else codes.tolist()
        for code in run:
            size = len(table)
            if code < size:
                entry = table[code]
            elif previous and code == size:
                entry = previous + previous[:1]
            else:
                raise ValueError("a code ahead of its table")
            if previous and size < FULL:
                table.append(previous + entry[:1])
            out.append(entry)
            got += len(entry)
            previous = entry
        index += len(run)
        if len(stops):
            k = stops[0]
            base = int(ahead[k] + wide[k])
            ended = codes[k] == end
            table, previous, index = list(fresh), b"", 0
        else:
            base = int(ahead[-1] + wide[-1])
    return b"".join(out)[:most]


# --- files -----------------------------------------------------------------


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(c)]) + c for c in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def write_gif(frames: list[Frame], width: int, height: int, low: int = 8) -> bytes:
    """A GIF file of 8-bit frames; the first palette is the global one."""
    palette = frames[0].palette
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF0 | low - 1, 0, 0), palette.astype(np.uint8).tobytes()]
    for f in frames:
        see = f.transparent is not None
        out += [
            b"\x21\xf9\x04",
            struct.pack("<BHB", f.disposal << 2 | see, f.delay_ms // 10, f.transparent or 0),
            b"\0",
            b"\x2c",
            struct.pack("<HHHHB", f.left, f.top, f.width, f.height, 0 if f.palette is palette else 0x80 | low - 1),
        ]
        if f.palette is not palette:
            out.append(f.palette.astype(np.uint8).tobytes())
        out += [b"\x08", _blocks(lzw_encode(f.pixels.tobytes()))]
    return b"".join([*out, b"\x3b"])


def _unblock(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def read_gif(data: bytes) -> tuple[int, int, list[Frame]]:
    """Width, height and stored frames of a GIF file; interlaced rows are put in order."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF file")
    width, height, packed, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, shared = 13, None
    if packed & 0x80:
        n = 2 << (packed & 7)
        shared = np.frombuffer(data, np.uint8, n * 3, at).reshape(n, 3)
        at += n * 3
    frames, delay, disposal, transparent = [], 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            kind = data[at + 1]
            body, at = _unblock(data, at + 2)
            if kind == 0xF9:
                flags, ticks, see = struct.unpack_from("<BHB", body)
                delay, disposal, transparent = ticks * 10, flags >> 2 & 7, see if flags & 1 else None
            continue
        if data[at] != 0x2C:
            raise ValueError("an unknown block")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        palette = shared
        if flags & 0x80:
            n = 2 << (flags & 7)
            palette = np.frombuffer(data, np.uint8, n * 3, at).reshape(n, 3)
            at += n * 3
        if palette is None:
            raise ValueError("a frame without palette")
        low = data[at]
        stream, at = _unblock(data, at + 1)
        pixels = np.frombuffer(lzw_decode(stream, low, w * h).ljust(w * h, b"\0"), np.uint8).reshape(h, w)
        if flags & 0x40:
            order = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
            ordered = np.empty_like(pixels)
            ordered[order] = pixels
            pixels = ordered
        frames.append(Frame(left, top, w, h, delay, disposal, transparent, palette, pixels))
        delay, disposal, transparent = 0, 0, None
    return width, height, frames


def shown(width: int, height: int, frames: list[Frame]) -> Iterator[np.ndarray]:
    """The RGBA canvas of each frame.

    Transparent pixels leave what is below. After a frame, disposal 2 clears
    its rectangle and disposal 3 brings back what was there before it.
    """
    canvas = np.zeros((height, width, 4), np.uint8)
    for f in frames:
        kept = canvas.copy() if f.disposal == 3 else None
        area = canvas[f.top : f.top + f.height, f.left : f.left + f.width]
        pixels = f.pixels[: area.shape[0], : area.shape[1]]
        colours = f.palette[np.minimum(pixels, len(f.palette) - 1)]
        drawn = np.ones(pixels.shape, bool) if f.transparent is None else pixels != f.transparent
        area[drawn, :3], area[drawn, 3] = colours[drawn], 255
        yield canvas.copy()
        if f.disposal == 2:
            area[:] = 0
        elif kept is not None:
            canvas = kept


def histogram(values: np.ndarray, bins: int = 16) -> list[int]:
    """Counts of 8-bit values in equal bins."""
    return np.bincount(values.reshape(-1) // (256 // bins), minlength=bins).tolist()


def colours(pixels: np.ndarray, bins: int = 16) -> list[int]:
    """Red, green and blue histograms, one after another, of the opaque ones of RGBA pixels (n, 4)."""
    opaque = pixels[pixels[:, 3] > 0, :3] // (256 // bins)
    return np.bincount((opaque + np.array([0, bins, 2 * bins], np.uint8)).reshape(-1), minlength=3 * bins).tolist()


# --- operators -------------------------------------------------------------

_GREY = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)


def store_payload(payload: bytes) -> bytes:
    """Bytes (a positive multiple of 64) as grey GIF frames of 64 pixels a row, 100 ms each."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    cuts = [rows[i : i + FRAME_ROWS] for i in range(0, len(rows), FRAME_ROWS)]
    frames = [Frame(0, 0, ROW, len(c), 100, 1, None, _GREY, c) for c in cuts]
    return write_gif(frames, ROW, len(cuts[0]))


def rendered(media: bytes) -> Iterator[tuple[Frame, np.ndarray]]:
    """Each frame of a GIF file and its RGBA rectangle of the canvas as shown."""
    width, height, frames = read_gif(media)
    for f, canvas in zip(frames, shown(width, height, frames), strict=True):
        yield f, canvas[f.top : f.top + f.height, f.left : f.left + f.width]


def read_payload(media: bytes) -> bytes:
    """The bytes that ``store_payload`` kept, taken from the rendered frames: the grey of each pixel."""
    return b"".join(area[..., 0].tobytes() for _, area in rendered(media))


def padded(raw: bytes) -> bytes:
    """Zero bytes appended up to a positive multiple of 64."""
    return raw + b"\0" * (max(ROW, -(-len(raw) // ROW) * ROW) - len(raw))


def gif_frames(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per timed frame of a binary GIF column.

    Columns: id, frame_no, start_ms, delay_ms, width, height, rgba (the canvas
    as shown), hist_red, hist_green, hist_blue (16 bins over the opaque
    pixels), error. A null file gives no rows; a file that can't be read gives
    one row with only ``error`` set, so no input vanishes unseen.
    """
    kind = df.schema[id_col].dataType.simpleString()
    schema = (
        f"`{id_col}` {kind}, frame_no int, start_ms long, delay_ms long, width int, height int, rgba binary, "
        "hist_red array<long>, hist_green array<long>, hist_blue array<long>, error string"
    )

    def frames_of(media: bytes) -> Iterator[tuple]:
        try:
            width, height, frames = read_gif(media)
            start = 0
            for n, (f, canvas) in enumerate(zip(frames, shown(width, height, frames), strict=True)):
                bins = colours(canvas.reshape(-1, 4))
                yield (n, start, f.delay_ms, width, height, canvas.tobytes(), bins[:16], bins[16:32], bins[32:], None)
                start += f.delay_ms
        except (ValueError, IndexError, struct.error) as error:
            yield (None, None, None, None, None, None, None, None, None, str(error))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), *[pa.list_(pa.int64())] * 3, pa.string()]
        names = [id_col, *"frame_no start_ms delay_ms width height rgba hist_red hist_green hist_blue error".split()]
        for batch in batches:
            for i, media in enumerate(batch.column(1)):
                if not media.is_valid:
                    continue
                rows = list(frames_of(media.as_py()))
                if not rows:
                    continue
                ids = pa.array([batch.column(0)[i].as_py()] * len(rows), batch.column(0).type)
                columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([ids, *columns], names=names)

    return df.select(F.col(id_col), F.col(media_col)).mapInArrow(run, schema)


def with_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, media``: every whole text stored as GIF. A null text counts as empty; ids are passed through."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):  # what is yielded at once is bounded by rows
                part = batch.slice(i, 1000)
                media = [store_payload(padded((value.as_py() or "").encode())) for value in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], names=[id_col, "media"])

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, media binary")


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every whole text as GIF, reads it back and describes both.

    One row per input row: id, n_bytes, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, feature (16 bins each of red, green
    and blue over the opaque pixels of all rendered frames), frames. Frames are
    rendered through palette, disposal and transparency; the payload is read
    from what they show. A null text counts as empty, which is stored
    as one row of zeros. Ids are passed through, null or repeated; equal texts
    give equal values. An empty table gives no rows.
    """
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, *"n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature frames".split()]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]

    def described(text: str) -> tuple:
        raw = text.encode()
        media = store_payload(padded(raw))
        areas = [area.reshape(-1, 4) for _, area in rendered(media)]
        pixels = areas[0] if len(areas) == 1 else np.concatenate(areas)
        back = pixels[:, 0].tobytes()
        bins = ",".join(map(str, colours(pixels)))
        return (
            len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ROW:]),
            len(media), hashlib.sha256(media).hexdigest(), bins, len(areas),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [described(value.as_py() or "") for value in batch.column(1)]
            columns = zip(*rows, strict=True) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]], names=names
            )

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(
        run,
        f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string, frames int",
    )
