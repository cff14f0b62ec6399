"""Power-of-two packing of documents into token sequences.

Each document, with its end token, is cut into pieces whose lengths are the binary
digits of its token count (whole sequences of ``max_len`` first).  A piece is a
sequence of its own, so no sequence crosses documents and none is padded; sequences of
equal length form a bucket, from which batches of one shape are drawn.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflux.llm.rows import LOWER, TextBlock, hash_spans, text_blocks

MAX_LEN = 4096
END_ID = 2
#: Distinct units of one generation of a worker's store; it holds two, about 40 MB.
KEPT_UNITS = 400_000
#: Units that the tokenizer is asked for in one call.
ASKED = 512
#: Text bytes tokenised at once: each unit takes some hundred bytes meanwhile.
PACK_BYTES = 1 << 20


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_lengths(tokens: int, max_len: int = MAX_LEN) -> list[int]:
    """Whole sequences, then the remainder's binary digits, largest first."""
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    whole, rest = divmod(tokens, max_len)
    return [max_len] * whole + [1 << k for k in reversed(range(max_len.bit_length())) if rest >> k & 1]


def cut_pieces(tokens: np.ndarray, max_len: int = MAX_LEN) -> tuple[np.ndarray, ...]:
    """Document, number, start and length of each piece of documents of so many tokens."""
    digits = np.array([1 << k for k in reversed(range(max_len.bit_length() - 1))], np.int64)
    whole, rest = np.divmod(np.asarray(tokens, np.int64), max_len)
    times = np.concatenate([whole[:, None], (rest[:, None] & digits) > 0], axis=1)
    length = np.repeat(np.tile(np.append(max_len, digits), len(whole)), times.ravel())
    pieces = times.sum(axis=1)
    owner = np.repeat(np.arange(len(whole)), pieces)
    before = np.cumsum(length) - length
    heads = np.cumsum(pieces) - pieces
    return owner, np.arange(len(length)) - heads[owner], before - before[heads[owner]], length


_LETTER, _DIGIT, _MARK, _SPACE, _OTHER = range(5)


def _byte_classes() -> np.ndarray:
    kinds = np.full(256, _MARK, np.uint8)
    kinds[0x61:0x7B] = kinds[0x41:0x5B] = _LETTER
    kinds[0x30:0x3A] = _DIGIT
    kinds[[0x20, 0x09, 0x0A, 0x0D]] = _SPACE
    # Other bytes (control bytes, the apostrophe, all beyond ASCII) never part a unit.
    kinds[[*range(0x09), 0x0B, 0x0C, *range(0x0E, 0x20), 0x27, 0x7F, *range(0x80, 0x100)]] = _OTHER
    return kinds


_KINDS = _byte_classes()
#: A unit of ASCII and Latin-1 letters alone, which the tokenizer takes as one word.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


@dataclass
class _Store:
    """Hashes of known units, sorted, and where each unit's ids are."""

    keys: np.ndarray
    first: np.ndarray
    size: np.ndarray
    ids: np.ndarray

    @classmethod
    def empty(cls) -> _Store:
        return cls(np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint16))

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each of some sorted keys stands, and whether it does."""
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return at, self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)

    def add(self, keys: np.ndarray, size: np.ndarray, ids: np.ndarray) -> _Store:
        """The store with more units; ``ids`` holds theirs one after the other."""
        all_keys = np.concatenate([self.keys, keys])
        order = np.argsort(all_keys, kind="stable")
        first = np.concatenate([self.first, (len(self.ids) + np.cumsum(size) - size).astype(np.int32)])
        return _Store(all_keys[order], first[order], np.concatenate([self.size, size.astype(np.int32)])[order], np.concatenate([self.ids, ids]))

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of the units at some places."""
        size = self.size[at].astype(np.int64)
        return size, self.ids[_spread(self.first[at], size)]


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``first[k]``, ``first[k] + 1``, ... of each stretch, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)


class WordTokenizer:
    """Ids of the tokenizer, asked once for each distinct unit of text.

    The tokenizer drops white space and merges within letters, single digits and runs
    of marks only.  A unit is therefore a stretch between white space, cut further
    where an ASCII letter meets an ASCII mark and around ASCII digits.
    Apostrophes and bytes beyond ASCII are never cut at, except that Latin-1 letters
    count as letters.  A special string that a text holds literally is one unit and gives
    its one id, as the tokenizer does by default.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        # Strings that stand for one id wherever a text holds them.
        self.special = {t.content.encode(): key for key, t in self.tok.get_added_tokens_decoder().items()}
        self.literal = re.compile(b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        vocabulary = self.tok.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(self.tok.get_vocab_size(with_added_tokens=True), bool)
        self.ends_word[[key for token, key in vocabulary.items() if token.endswith("</w>")]] = True
        self.young, self.old = _Store.empty(), _Store.empty()

    def _units(self, block: TextBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = LOWER[block.data]
        if not len(data):
            return data, np.zeros(0, np.int64), np.zeros(0, np.int64)
        kinds = _KINDS[data]
        lead = data[:-1] == 0xC3
        second = data[1:]
        latin = lead & (second != 0x97) & (second != 0xB7)
        kinds[:-1][latin] = _LETTER
        kinds[1:][latin] = _LETTER
        # A letter before a byte that is neither ASCII nor Latin-1 may be changed by it.
        a, b = kinds[:-1], kinds[1:]
        part = (a == _DIGIT) | (b == _DIGIT) | (a == _SPACE) | (b == _SPACE) | ((a == _LETTER) & (b == _MARK)) | ((a == _MARK) & (b == _LETTER))
        cut = np.concatenate([[True], part])
        cut[block.starts[block.ends > block.starts]] = True
        for a, b in self._literals(block):
            cut[a + 1 : b] = False
            cut[a] = True
            cut[b : b + 1] = True
        lo = np.flatnonzero(cut)
        hi = np.append(lo[1:], len(data))
        keep = kinds[lo] != _SPACE
        return data, lo[keep], hi[keep]

    def _literals(self, block: TextBlock) -> Iterator[tuple[int, int]]:
        """Byte ranges of the special strings that stand within one text."""
        found = [m.span() for m in self.literal.finditer(block.data.tobytes())] if self.literal else []
        if found:
            a, b = np.array(found).T
            yield from (f for f, one in zip(found, np.searchsorted(block.ends, a, side="right") == np.searchsorted(block.ends, b - 1, side="right"), strict=True) if one)

    def _ask(self, units: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """An order of units that the store lacks, and in it their sizes and ids.

        Units go together into one call, with something between that parts their ids: a
        space between words of letters, whose last id says that it ends a word, and a
        special string between all others.
        """
        words: list[int] = []
        others: list[int] = []
        whole = _LETTERS.fullmatch if self.ends_word.any() else lambda unit: None
        for k, unit in enumerate(units):
            (words if whole(unit) else others).append(k)
        sizes, flat = [], []
        for group in batched(words, ASKED):
            ids = self._ids(b" ".join([units[k] for k in group]))
            sizes.append(np.diff(np.flatnonzero(self.ends_word[ids]), prepend=-1))
            flat.append(ids)
        mark = next(iter(self.special), None)
        plain = [k for k in others if units[k] not in self.special]
        for group in batched(plain, ASKED if mark else 1):
            ids = self._ids((mark or b"").join([units[k] for k in group]))
            parts = np.flatnonzero(ids == self.special[mark]) if mark else np.zeros(0, np.int64)
            sizes.append(np.diff(parts, prepend=-1, append=len(ids)) - 1)
            flat.append(np.delete(ids, parts))
        literal = [k for k in others if units[k] in self.special]
        sizes.append(np.ones(len(literal), np.int64))
        flat.append(np.array([self.special[units[k]] for k in literal], np.uint16))
        return words + plain + literal, np.concatenate(sizes), np.concatenate(flat)

    def _ids(self, text: bytes) -> np.ndarray:
        (found,) = self.tok.encode_batch_fast([text.decode("utf-8", "replace")], add_special_tokens=False)
        return np.array(found.ids, np.uint16)

    def _known(self, keys: np.ndarray, units: Callable[[np.ndarray], list[bytes]]) -> np.ndarray:
        """Place in the young store of each of some sorted keys, which it then all holds.

        A unit not met for a whole generation is forgotten, a frequent one never.
        """
        if len(self.young.keys) > KEPT_UNITS:
            self.young, self.old = _Store.empty(), self.young
        at, there = self.young.look(keys)
        if there.all():
            return at
        lost = np.flatnonzero(~there)
        before, held = self.old.look(keys[lost])
        if held.any():
            self.young = self.young.add(keys[lost[held]], *self.old.of(before[held]))
        if not held.all():
            new = lost[~held]
            order, size, ids = self._ask(units(new))
            self.young = self.young.add(keys[new[order]], size, ids)
        return self.young.look(keys)[0]

    def encode(self, block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids begin."""
        data, lo, hi = self._units(block)
        if not len(lo):
            return np.zeros(0, np.uint16), np.zeros(len(block) + 1, np.int64)
        codes, keys = pd.factorize(hash_spans(data, lo, hi))
        order = np.argsort(keys)

        def units(new: np.ndarray) -> list[bytes]:
            example = np.empty(len(keys), np.int64)
            example[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            raw, spots = data.tobytes(), example[order[new]]
            return [raw[a:b] for a, b in zip(lo[spots].tolist(), hi[spots].tolist(), strict=True)]

        at = np.empty(len(keys), np.int64)
        at[order] = self._known(keys[order], units)
        size, ids = self.young.of(at[codes])
        ends = np.concatenate([[0], np.cumsum(size)])
        return ids, ends[np.searchsorted(lo, np.append(block.starts, len(data)))]


_kept: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _kept:
        _kept[path] = WordTokenizer(path)
    return _kept[path]


PIECE_SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part int"


def cut_documents(docs: DataFrame, max_len: int = MAX_LEN, with_ids: bool = False, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """One row per piece: its place in the document and, on demand, its ids.

    A null or empty text is the end token alone, one piece of length 1.  Repeated rows
    and null doc_ids are cut like any others.  An empty table gives no pieces.
    """
    schema = PIECE_SCHEMA + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(vocabulary_path(vocabulary))
        names = [f.split()[0] for f in schema.split(", ")]
        for block in text_blocks(batches, limit=PACK_BYTES):
            ids, first = tokenizer.encode(block)
            ids = np.insert(ids.astype("<u4"), first[1:], END_ID)
            first = first + np.arange(len(first))
            owner, part, start, length = cut_pieces(np.diff(first), max_len)
            at = first[owner] + start
            body = memoryview(ids).cast("B")
            crc = [zlib.crc32(body[a:b]) for a, b in zip((4 * at).tolist(), (4 * (at + length)).tolist(), strict=True)]
            columns = [block.ids.take(pa.array(owner)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.diff(first)[owner]), pa.array(part.astype(np.int32))]
            if with_ids:  # the pieces follow one another as the ids do
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


def pack(docs: DataFrame, max_len: int = MAX_LEN, with_ids: bool = False, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """Pieces with their ``sequence_id`` and ``bucket`` (log2 of the length).

    A sequence is one piece, so its ids sit at offset 0 and padding is nil.
    """
    pieces = cut_documents(docs, max_len, with_ids, vocabulary)
    return pieces.select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"), F.log2("length").cast("int").alias("bucket"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Store sequences by bucket, one folder per length; needs ``with_ids``."""
    packed.write.partitionBy("bucket").parquet(path)


def op9_pieces(docs: DataFrame) -> DataFrame:
    return pack(docs).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")
