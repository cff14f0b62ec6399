import random
import struct

import numpy as np
import pytest

from folioflux.llm.gif import GREY, decode_frames, decode_gif, encode_gif, lzw_codes, lzw_decode, op10_media, pack_codes, payload_of


@pytest.mark.parametrize("size", [0, 1, 2, 300, 5000, 70_000])
def test_lzw_round_trip(size):
    rng = random.Random(size)
    for alphabet in (b"a", b"ab ", bytes(range(256))):
        data = bytes(rng.choice(alphabet) for _ in range(size))
        assert lzw_decode(pack_codes(lzw_codes(data)), 8) == data


def test_gif_round_trip_over_frames():
    data = bytes(random.Random(1).choices(b"the quick brown fox", k=192 * 200))
    frames = decode_gif(encode_gif(data))
    assert b"".join(f.samples for f in frames) == data
    assert [f.at for f in frames] == [0, 4, 8, 12]
    assert (frames[0].rgb[:, :, 0].tobytes(), frames[0].rgb.shape) == (data[: 192 * 64], (64, 192, 3))


def _gif(frames, width=2, height=1, back=3):
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    out = b"GIF89a" + struct.pack("<HHBBB", width, height, 0xF1, back, 0) + palette
    for disposal, hidden, left, samples in frames:
        out += b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (hidden is not None), 7, hidden or 0) + b"\0"
        body = pack_codes(lzw_codes(bytes(samples), 2), 2)
        out += b"\x2c" + struct.pack("<HHHHB", left, 0, len(samples), 1, 0) + b"\x02" + bytes([len(body)]) + body + b"\0"
    return out + b";"


def test_disposal_and_transparency():
    red, green, blue = (255, 0, 0), (0, 255, 0), (0, 0, 255)
    shown = [[tuple(p) for p in f.rgb[0].tolist()] for f in decode_gif(_gif([(1, None, 0, [1, 2]), (3, None, 0, [3]), (1, 1, 0, [1, 3]), (2, None, 1, [2]), (0, None, 0, [1])]))]
    assert shown[0] == [red, green]
    assert shown[1] == [blue, green]
    assert shown[2] == [red, blue]  # the third frame is put back first; its own 1 is not painted
    assert shown[3] == [red, green]
    assert shown[4] == [red, blue]  # the box of the fourth frame fell back to the background


def test_local_palette_interlace_and_bad_input():
    rows = 10
    data = bytes(range(rows))
    order = [*range(0, 10, 8), *range(4, 10, 8), *range(2, 10, 4), *range(1, 10, 2)]
    body = pack_codes(lzw_codes(bytes(data[k] for k in order)))
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, rows, 0, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, rows, 0xC7) + GREY + b"\x08" + bytes([len(body)]) + body + b"\0;"
    (frame,) = decode_gif(gif)
    assert frame.samples == data and frame.rgb[:, 0, 0].tolist() == list(range(rows))
    with pytest.raises(ValueError):
        decode_gif(b"PNG")


def test_media_columns(spark):
    docs = spark.createDataFrame([(1, "héllo"), (2, None), (3, "x" * 30_000), (1, "héllo"), (None, "")], "doc_id long, text string")
    rows = op10_media(docs).collect()
    assert len(rows) == 5
    one = [r for r in rows if r.doc_id == 1]
    assert one[0] == one[1] and one[0].n_bytes == 6 and one[0].payload_bytes == 192
    import hashlib

    assert one[0].payload_sha256 == hashlib.sha256(payload_of("héllo".encode())).hexdigest()
    assert op10_media(docs.limit(0)).count() == 0


def test_frames_table(spark):
    gif = encode_gif(bytes(192 * 70))
    media = spark.createDataFrame([(1, bytearray(gif)), (2, None), (3, bytearray(b"GIF89a"))], "doc_id long, gif binary")
    rows = decode_frames(media).collect()
    assert [(r.doc_id, r.frame) for r in rows if r.error is None] == [(1, 0), (1, 1)]
    assert sum(rows[0].histogram) == 192 * 64 and len(rows) == 4


def test_full_table_without_clear():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 20_000, dtype=np.uint8).tobytes()
    # An encoder that never clears: codes stay 12 bits wide once the table is full.
    table, out, held = {bytes([k]): k for k in range(256)}, [256], b""
    for k in range(len(data)):
        c = data[k : k + 1]
        if held + c in table:
            held += c
            continue
        out.append(table[held])
        if len(table) + 2 < 4096:
            table[held + c] = len(table) + 2
        held = c
    out += [table[held], 257]
    assert lzw_decode(pack_codes(out), 8) == data
