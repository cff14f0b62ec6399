"""Walking a table's texts in bounded blocks of Arrow memory.

Every Python operator of this package reads its input through :func:`text_blocks`,
so that the memory of a task depends on ``BLOCK_BYTES`` and on the longest single
text, never on the number of rows of a partition.
"""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

_libc = ctypes.CDLL(None)

#: Text bytes handled at once.  One longer text makes a block of its own.
BLOCK_BYTES = 2 << 20


@dataclass
class TextBlock:
    """Texts of consecutive rows as one byte array; null texts have no bytes."""

    ids: pa.Array
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    is_null: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def raw(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()


def _one_block(ids: pa.Array, text: pa.Array) -> TextBlock:
    null = np.asarray(pc.is_null(text)) if text.null_count else np.zeros(len(text), bool)
    text = pc.fill_null(text, "").cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    body = text.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    return TextBlock(ids, data, offsets[:-1], offsets[1:], null)


def text_blocks(batches: Iterator[pa.RecordBatch], id_col: str = "doc_id", text_col: str = "text", limit: int = BLOCK_BYTES) -> Iterator[TextBlock]:
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, text = batch.column(id_col), batch.column(text_col)
        sizes = np.asarray(pc.fill_null(pc.binary_length(text), 0)).astype(np.int64)
        block_of = (np.cumsum(sizes) - sizes) // limit
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(block_of)) + 1, [len(sizes)]])
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            yield _one_block(ids.slice(lo, hi - lo), text.slice(lo, hi - lo))
        _give_back()


def _give_back() -> None:
    """Workers live on between tasks: what a batch has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(_libc, "malloc_trim", None):
        trim(0)


def unused(columns: list[str], name: str) -> str:
    """``name``, longer by underscores where a column has it already."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def append_score(docs: DataFrame, scorer: Broadcast, name: str, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` (its columns ``keep``, all by default) with ``scorer.value.scores(block)``.

    ``name`` must not be a column that is kept.
    """
    keep = docs.columns if keep is None else keep
    if name in keep:
        raise ValueError(f"{name} is a column already")
    text = unused(docs.columns, "__text")
    kept = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias(text))
    schema = StructType([*kept.schema.fields[:-1], StructField(name, DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = scorer.value
        for batch in batches:
            found = [np.zeros(0)]
            for block in text_blocks(iter([batch]), text, text):
                found.append(model.scores(block))
            columns = [batch.column(k) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(found), pa.float64())], names=[*keep, name])

    return kept.mapInArrow(work, schema)


def crc_of_ids(ids: pa.Array) -> np.ndarray:
    """crc32 of each id written as text; a null id counts as an empty text."""
    return np.fromiter((zlib.crc32(str(v).encode()) if v is not None else 0 for v in ids.to_pylist()), np.int64, len(ids))


def lower_table() -> np.ndarray:
    """Byte map that lower-cases A-Z only."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = lower_table()

#: Bytes of words that anything but white space makes up.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of words of digits, letters and everything beyond ASCII.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[0x30:0x3A] = WORD_BYTE[0x61:0x7B] = WORD_BYTE[0x41:0x5B] = WORD_BYTE[0x80:] = True


@dataclass
class Words:
    """Words of a block: byte spans, the row of each, and where each row's words begin."""

    lo: np.ndarray
    hi: np.ndarray
    row: np.ndarray
    first: np.ndarray

    def of(self, k: int) -> slice:
        return slice(self.first[k], self.first[k + 1])


def find_words(block: TextBlock, inside: np.ndarray) -> Words:
    """Maximal runs of bytes for which ``inside`` holds; a word never crosses rows."""
    data = block.data
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(len(block) + 1, np.int64))
    member = inside[data]
    opens, closes = member.copy(), member.copy()
    opens[1:] &= ~member[:-1]
    closes[:-1] &= ~member[1:]
    full = block.ends > block.starts
    at, upto = block.starts[full], block.ends[full] - 1
    opens[at] = member[at]
    closes[upto] = member[upto]
    lo, hi = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    row = np.searchsorted(block.ends, lo, side="right")
    first = np.searchsorted(row, np.arange(len(block) + 1))
    return Words(lo, hi, row, first)


_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_LONG = 512


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * _C1
    h = h ^ (h >> np.uint64(33))
    h = h * _C2
    return h ^ (h >> np.uint64(33))


def hash_spans(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, eight bytes a step over all spans at once."""
    if not len(lo):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    size = hi - lo
    h = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    live, at = np.flatnonzero(size <= _LONG), 0
    while len(live):
        part = eight[lo[live] + at] & _MASKS[np.minimum(size[live] - at, 8)]
        h[live] = mix(h[live] ^ part) + np.uint64(0x9E3779B97F4A7C15)
        at += 8
        live = live[size[live] > at]
    for k in np.flatnonzero(size > _LONG):
        import hashlib

        h[k] = np.frombuffer(hashlib.blake2b(data[lo[k] : hi[k]].tobytes(), digest_size=8).digest(), np.uint64)[0]
    return h


def chain(parts: list[np.ndarray]) -> np.ndarray:
    """Hash of sequences: ``parts[j]`` holds the j-th hash of every sequence."""
    h = np.full(len(parts[0]), len(parts), np.uint64)
    for part in parts:
        h = mix(h * np.uint64(0x9DDFEA08EB382D69) ^ part)
    return h


def block_of(texts: list[str]) -> TextBlock:
    """Texts at hand as one block."""
    return next(text_blocks(iter([pa.RecordBatch.from_pydict({"doc_id": range(len(texts)), "text": pa.array(texts, pa.large_string())})]), limit=1 << 62))


def families(texts: list[str], words: int = 3, draws: int = 6) -> list[int]:
    """A number per text that near copies share: texts with an equal least hash of their
    shingles, in any of some draws, are linked."""
    block = block_of(texts)
    found = find_words(block, NON_SPACE)
    h = hash_spans(block.data, found.lo, found.hi)
    n = len(h) - words + 1
    root = list(range(len(texts)))
    if n < 1:
        return root

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    shingles = chain([h[k : k + n] for k in range(words)])
    for draw in range(draws):
        drawn, first = mix(shingles ^ np.uint64(0x9E3779B97F4A7C15 * draw & (1 << 64) - 1)), {}
        for k in range(len(texts)):
            own = drawn[found.first[k] : max(found.first[k], found.first[k + 1] - words + 1)]
            if len(own):
                a, b = top(k), top(first.setdefault(int(own.min()), k))
                root[max(a, b)] = min(a, b)
    return [top(k) for k in range(len(texts))]
