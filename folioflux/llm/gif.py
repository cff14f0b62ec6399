"""GIF streams as media columns: an encoder, a whole decoder, and frame features.

The decoder follows the GIF89a format: global and local palettes, interlacing, LZW
code streams with growing code widths and deferred clears, transparency, the disposal
methods, and delays.  Frames are composed on the logical screen and come back as RGB
arrays with their time and a colour histogram.
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

from folioflux.llm.rows import text_blocks

WIDTH = 192
#: Rows of samples in one frame of a stored payload.
FRAME_ROWS = 64
#: Time of one frame in hundredths of a second.
DELAY = 4
_MAX_CODES = 4096


# --- LZW ---------------------------------------------------------------------------
def lzw_codes(samples: bytes, bits: int = 8) -> list[int]:
    """Greedy LZW codes of samples; the table is cleared when it is full."""
    clear = 1 << bits
    letters = {chr(k): k for k in range(clear)}
    table, out, fresh = dict(letters), [clear], clear + 2
    emit, held = out.append, ""
    for letter in samples.decode("latin-1"):
        longer = held + letter
        if longer in table:
            held = longer
            continue
        emit(table[held])
        table[longer] = fresh
        fresh += 1
        held = letter
        if fresh == _MAX_CODES:
            emit(clear)
            table, fresh = dict(letters), clear + 2
    if held:
        emit(table[held])
    emit(clear + 1)
    return out


def _widths(bits: int, count: int) -> np.ndarray:
    """Width of each code after a clear: the table gets its k-th entry with code k + 1."""
    entries = np.minimum((1 << bits) + 2 + np.maximum(np.arange(count) - 1, 0), _MAX_CODES - 1)
    return np.maximum(bits + 1, np.floor(np.log2(np.maximum(entries, 1))).astype(np.int64) + 1)


def _write_widths(codes: np.ndarray, bits: int) -> np.ndarray:
    clear = 1 << bits
    is_clear = codes == clear
    last = np.maximum.accumulate(np.where(is_clear, np.arange(len(codes)), -1))
    since = np.arange(len(codes)) - last - 1  # 0 for the first code after a clear
    table = _widths(bits, int(max(since.max(), 0)) + 2)
    out = table[np.maximum(since, 0)]
    # a clear itself is written as wide as the code after the one before it
    out[is_clear] = np.where(np.flatnonzero(is_clear) > 0, table[np.maximum(np.append([0], since[:-1] + 1)[is_clear], 0)], bits + 1)
    return out


def pack_codes(codes: list[int], bits: int = 8) -> bytes:
    """Codes as a little-endian bit stream of growing widths."""
    values = np.asarray(codes, np.uint64)
    width = _write_widths(values.astype(np.int64), bits)
    at = np.cumsum(width) - width
    total = int(at[-1] + width[-1])
    shifted = values << (at & 7).astype(np.uint64)
    out = np.zeros(total // 8 + 4, np.uint8)
    for k in range(3):  # a code lies in at most three bytes
        np.bitwise_or.at(out, (at >> 3) + k, ((shifted >> np.uint64(8 * k)) & np.uint64(255)).astype(np.uint8))
    return out[: -(-total // 8)].tobytes()


_layouts: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _layout(bits: int) -> tuple[np.ndarray, np.ndarray]:
    if bits not in _layouts:
        width = _widths(bits, 8192)
        _layouts[bits] = (np.cumsum(width) - width, width)
    return _layouts[bits]


def lzw_decode(stream: bytes, bits: int) -> bytes:
    """Samples of a code stream.

    The widths after a clear depend on the count of codes only, so all codes up to the
    next clear are cut out at once; then each code appends its string.  A stream that
    ends without an end code gives what it holds; an impossible code is an error.
    """
    clear, end = 1 << bits, (1 << bits) + 1
    at, width = _layout(bits)
    raw = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.uint32)
    letters = [bytes([k]) for k in range(clear)] + [b"", b""]
    total, start, out = len(stream) * 8, 0, []
    table, prev = list(letters), b""
    while start + bits + 1 <= total:
        fits = int(np.searchsorted(at + width, total - start, side="right"))
        far = start + at[:fits]
        byte = far >> 3
        codes = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (far & 7).astype(np.uint32)) & ((1 << width[:fits]) - 1).astype(np.uint32)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else fits
        table, prev, append = list(letters), b"", out.append
        grow = table.append
        for n, code in enumerate(codes[:stop].tolist()):
            if code < len(table):
                text = table[code]
            elif code == len(table) and prev:
                text = prev + prev[:1]
            else:
                raise ValueError(f"code {code} is beyond the table")
            append(text)
            if n and len(table) < _MAX_CODES:
                grow(prev + text[:1])
            prev = text
        if not len(stops):
            if fits < 8192:
                break
            start += int(at[8191] + width[8191])
            return b"".join(out) + _decode_full(stream, start, table, prev, bits)
        start += int(at[stop] + width[stop])
        if codes[stop] == end:
            break
    return b"".join(out)


def _decode_full(stream: bytes, start: int, table: list[bytes], prev: bytes, bits: int) -> bytes:
    """Codes of a stream that never clears its full table: all are 12 bits wide."""
    clear, out, value, total = 1 << bits, [], int.from_bytes(stream[start >> 3 :], "little") >> (start & 7), len(stream) * 8
    while start + 12 <= total:
        code, value, start = value & 4095, value >> 12, start + 12
        if code == clear:
            return b"".join(out) + lzw_decode(value.to_bytes((total - start) // 8 + 1, "little"), bits)
        if code == clear + 1:
            break
        out.append(table[code])
    return b"".join(out)


# --- container ---------------------------------------------------------------------
def _blocks(body: bytes) -> bytes:
    return b"".join(bytes([len(body[k : k + 255])]) + body[k : k + 255] for k in range(0, len(body), 255)) + b"\0"


GREY = bytes(v for k in range(256) for v in (k, k, k))


def encode_gif(samples: bytes, width: int = WIDTH, frame_rows: int = FRAME_ROWS, palette: bytes = GREY, delay: int = DELAY) -> bytes:
    """Samples, row by row, as frames of ``frame_rows`` rows on one screen."""
    rows = len(samples) // width
    if not rows or rows * width != len(samples):
        raise ValueError("samples must fill whole rows")
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, frame_rows), 0xF7, 0, 0), palette]
    for top in range(0, rows, frame_rows):
        tall = min(frame_rows, rows - top)
        part = samples[top * width : (top + tall) * width]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 0, delay, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, tall, 0) + b"\x08" + _blocks(pack_codes(lzw_codes(part))))
    return b"".join(out) + b"\x3b"


@dataclass
class Frame:
    """A frame as stored (``samples`` within its box) and as shown (``rgb``)."""

    at: int
    delay: int
    left: int
    top: int
    width: int
    height: int
    disposal: int
    transparent: int | None
    samples: bytes
    rgb: np.ndarray | None


def _sub_blocks(body: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while body[at]:
        parts.append(body[at + 1 : at + 1 + body[at]])
        at += 1 + body[at]
    return b"".join(parts), at + 1


def _weave(tall: int) -> np.ndarray:
    return np.concatenate([np.arange(a, tall, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode_gif(body: bytes, compose: bool = True) -> list[Frame]:
    """All frames of a GIF; with ``compose``, as shown on the screen.

    Missing samples of a short stream are 0; a broken header or stream is an error.
    """
    if body[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, back, _ = struct.unpack_from("<HHBBB", body, 6)
    at = 13
    common = np.zeros((256, 3), np.uint8)
    if flags & 0x80:
        n = 2 << (flags & 7)
        common[:n] = np.frombuffer(body, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    screen = np.zeros((height, width, 3), np.uint8) if compose else None
    frames: list[Frame] = []
    clock, delay, disposal, hidden = 0, 0, 0, None
    while at < len(body) and body[at] != 0x3B:
        kind = body[at]
        if kind == 0x21:
            label = body[at + 1]
            extra, at = _sub_blocks(body, at + 2)
            if label == 0xF9 and len(extra) >= 4:
                disposal, delay = extra[0] >> 2 & 7, extra[1] | extra[2] << 8
                hidden = extra[3] if extra[0] & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError(f"unknown block {kind}")
        left, top, wide, tall, marks = struct.unpack_from("<HHHHB", body, at + 1)
        at += 10
        palette = common
        if marks & 0x80:
            n = 2 << (marks & 7)
            palette = np.zeros((256, 3), np.uint8)
            palette[:n] = np.frombuffer(body, np.uint8, 3 * n, at).reshape(n, 3)
            at += 3 * n
        bits = body[at]
        coded, at = _sub_blocks(body, at + 1)
        samples = lzw_decode(coded, bits)[: wide * tall].ljust(wide * tall, b"\0")
        if marks & 0x40:
            woven = np.empty((tall, wide), np.uint8)
            woven[_weave(tall)] = np.frombuffer(samples, np.uint8).reshape(tall, wide)
            samples = woven.tobytes()
        shown = None
        if screen is not None:
            before = screen.copy() if disposal == 3 else None
            box = np.frombuffer(samples, np.uint8).reshape(tall, wide)[: max(0, height - top), : max(0, width - left)]
            area = screen[top : top + box.shape[0], left : left + box.shape[1]]
            paint = box != hidden if hidden is not None else np.ones(box.shape, bool)
            area[paint] = palette[box[paint]]
            shown = screen.copy()
            if disposal == 2:
                area[:] = common[back] if flags & 0x80 and hidden is None else 0
            elif before is not None:
                screen = before
        frames.append(Frame(clock, delay, left, top, wide, tall, disposal, hidden, samples, shown))
        clock += delay
        delay, disposal, hidden = 0, 0, None
    return frames


def histogram(rgb: np.ndarray, levels: int = 4) -> np.ndarray:
    """Counts of colours, ``levels`` a channel."""
    cell = rgb.reshape(-1, 3).astype(np.int64) * levels >> 8
    return np.bincount((cell[:, 0] * levels + cell[:, 1]) * levels + cell[:, 2], minlength=levels**3)


# --- columns -----------------------------------------------------------------------
FRAME_SCHEMA = "doc_id bigint, frame int, at_cs bigint, delay_cs int, width int, height int, rgb binary, histogram array<bigint>, error string"


def decode_frames(media: DataFrame, id_col: str = "doc_id", body_col: str = "gif") -> DataFrame:
    """One row per composed frame of each GIF; a broken or null one gives a row with ``error``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in FRAME_SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.string()]
        for batch in batches:
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    got = [(key, n, f.at, f.delay, f.rgb.shape[1], f.rgb.shape[0], f.rgb.tobytes(), histogram(f.rgb).tolist(), None) for n, f in enumerate(decode_gif(body or b""))]
                except (ValueError, IndexError, struct.error) as bad:
                    got = [(key, None, None, None, None, None, None, None, str(bad) or "cut short")]
                for n in range(0, len(got), 16):
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*got[n : n + 16], strict=True), kinds, strict=True)], names=names)

    return media.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(body_col).alias("gif")).mapInArrow(work, FRAME_SCHEMA)


def payload_of(text: bytes, unit: int = WIDTH) -> bytes:
    size = max(unit, -(-len(text) // unit) * unit)
    return text.ljust(size, b" ")


MEDIA_SCHEMA = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, frames int, duration_cs bigint"


def store_texts(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Every text as a grey GIF, read back, with features of what was read.

    A null text is an empty one: a payload of blanks.  Repeated rows give equal values.
    ``feature`` holds frame count, duration and the colour histogram summed over frames.
    """
    schema = MEDIA_SCHEMA + (", gif binary" if keep_media else "")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        kinds = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2 + [pa.string()] * 2 + [pa.int32(), pa.int64()] + [pa.binary()] * keep_media
        for block in text_blocks(batches):
            rows = []
            for k, key in enumerate(block.ids.to_pylist()):
                text = block.raw(k)
                media = encode_gif(payload_of(text))
                frames = decode_gif(media)
                back = b"".join(f.samples for f in frames)
                colours = sum(histogram(f.rgb[: f.height]) for f in frames)
                spent = sum(f.delay for f in frames)
                feature = f"{len(frames)}|{spent}|" + ",".join(f"{c}:{n}" for c, n in enumerate(colours.tolist()) if n)
                row = (key, len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(frames), spent)
                rows.append(row + (media,) * keep_media)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, schema)


def op10_media(docs: DataFrame) -> DataFrame:
    return store_texts(docs)
