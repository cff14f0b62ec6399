"""Benchmark decontamination over a distributed positional inverted index.

The index is split by documents: each segment holds, for the terms of interest, the
sorted positions at which each occurs in its texts.  It is written once.  A window of
test words is found by intersecting the posting lists of its terms, each shifted by the
term's offset in the window, beginning with the rarest term of the segment.  Exact
phrases need every list to hold the shifted position; proximity matches let each word
stand a bounded number of places away from its own.

Test windows reach the tasks in blocks of bounded size.  One block is with the driver and
the workers at a time: more blocks mean more searches of the same index, not more memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from folioflux.llm.rows import LOWER, WORD_BYTE, TextBlock, find_words, hash_spans, text_blocks, unused
from folioflux.llm.shared_store import stored

WINDOW = 10
#: Distinct windows searched at once: 16 MB of term hashes at most, a fixed bound.
WINDOWS_PER_BLOCK = 200_000
#: Places that a word of a proximity match may stand away: one word put in, left out or
#: swapped with the next still matches.
SLACK = 1
#: Free positions between documents, so that no match crosses one and slack stays inside.
GAP = 64


# --- test items --------------------------------------------------------------------
ITEM_SCHEMA = "item_id string, w binary, words int"


def item_windows(items: DataFrame, size: int = WINDOW, id_col: str = "item_id") -> DataFrame:
    """Distinct (item_id, window of term hashes): ``size`` words, or all of a shorter item.

    A null or wordless item has none.  Items with equal windows each keep a row.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "item_id"):
            words = find_words(block, WORD_BYTE)
            hashes = hash_spans(LOWER[block.data], words.lo, words.hi)
            for k, key in enumerate(block.ids.to_pylist()):
                own = hashes[words.of(k)]
                wide = min(size, len(own))
                found = sorted({own[at : at + wide].tobytes() for at in range(len(own) - wide + 1)} if wide else ())
                for n in range(0, len(found), 10_000):
                    part = found[n : n + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(part), pa.string()), pa.array(part, pa.binary()), pa.array([wide] * len(part), pa.int32())], names=["item_id", "w", "words"])

    slim = items.select(F.col(id_col).cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(work, ITEM_SCHEMA).filter("item_id is not null").distinct()


@dataclass
class WindowBlock:
    """Windows as rows of term hashes (0 beyond a window's own words) and their items."""

    terms: np.ndarray
    words: np.ndarray
    owners: list[list[str]]

    def vocabulary(self) -> np.ndarray:
        return np.unique(self.terms[np.arange(self.terms.shape[1]) < self.words[:, None]])


def window_blocks(windows: DataFrame, per_block: int = WINDOWS_PER_BLOCK) -> Iterator[WindowBlock]:
    """All windows in blocks of about ``per_block``; the driver holds one block at a time."""
    windows = windows.checkpoint()
    parts = -(-windows.count() // per_block)
    for part in range(parts):
        owners: dict[bytes, list[str]] = {}
        for r in windows.filter(F.pmod(F.xxhash64("w"), F.lit(parts)) == part).toLocalIterator():
            owners.setdefault(bytes(r.w), []).append(r.item_id)
        if not owners:
            continue
        keys = sorted(owners)
        words = np.array([len(k) // 8 for k in keys])
        terms = np.zeros((len(keys), int(words.max())), np.uint64)
        for k, key in enumerate(keys):
            terms[k, : words[k]] = np.frombuffer(key, np.uint64)
        yield WindowBlock(terms, words, [sorted(owners[k]) for k in keys])


def _one_after_another(windows: DataFrame, per_block: int) -> Iterator[tuple[WindowBlock, bool, bool]]:
    """Each block, whether it is the first, and whether it is the last."""
    blocks = window_blocks(windows, per_block)
    held, first = next(blocks, None), True
    while held is not None:
        following = next(blocks, None)
        yield held, first, following is None
        held, first = following, False


# --- index -------------------------------------------------------------------------
SEGMENT_SCHEMA = "segment bigint, doc_ids array<bigint>, n_words array<bigint>, base array<bigint>, terms binary, list_start binary, postings binary"


def build_index(docs: DataFrame, vocabulary: np.ndarray | None = None) -> DataFrame:
    """Segments of the positional index over whole texts.

    ``vocabulary`` keeps the posting lists of these term hashes only (a term that no
    test item has cannot take part in a match); None keeps all.  A null text has no
    words; repeated rows are separate documents of the segment.
    """
    wanted = None if vocabulary is None else docs.sparkSession.sparkContext.broadcast(np.sort(vocabulary))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SEGMENT_SCHEMA.split(", ")]
        task = TaskContext.get()
        for n, block in enumerate(text_blocks(batches)):
            key = ((task.partitionId() if task else 0) << 32) + n
            row = (key, *_segment(block, None if wanted is None else wanted.value))
            yield pa.RecordBatch.from_arrays([pa.array([v]) if isinstance(v, (bytes, int)) else pa.array([v], pa.list_(pa.int64())) for v in row], names=names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, SEGMENT_SCHEMA)


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    at = np.searchsorted(among, values)
    at[at == len(among)] = 0
    return among[at] == values if len(among) else np.zeros(len(values), bool)


def _segment(block: TextBlock, wanted: np.ndarray | None) -> tuple:
    words = find_words(block, WORD_BYTE)
    hashes = hash_spans(LOWER[block.data], words.lo, words.hi)
    counts = np.diff(words.first)
    base = np.cumsum(counts + GAP) - counts  # a gap before each document
    position = np.arange(len(hashes)) + GAP * (words.row + 1)
    if wanted is not None:
        keep = _member(hashes, wanted)
        hashes, position = hashes[keep], position[keep]
    order = np.argsort(hashes, kind="stable")
    terms, start = np.unique(hashes[order], return_index=True)
    return (block.ids.to_pylist(), counts.tolist(), base.tolist(), terms.tobytes(), np.append(start, len(order)).astype(np.int32).tobytes(), position[order].astype(np.int32).tobytes())


@dataclass
class Segment:
    terms: np.ndarray
    start: np.ndarray
    postings: np.ndarray
    span: int

    @classmethod
    def of(cls, terms: bytes, start: bytes, postings: bytes) -> Segment:
        lists = np.frombuffer(postings, np.int32).astype(np.int64)
        return cls(np.frombuffer(terms, np.uint64), np.frombuffer(start, np.int32).astype(np.int64), lists, int(lists.max()) + 1 if len(lists) else 1)

    def find(self, block: WindowBlock, slack: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Window, begin, place of an own word, and whether it is exact, of each match.

        A match at ``begin`` has each of the window's terms within ``slack`` positions of
        its own place, an exact one in this place.
        """
        none = np.zeros(0, np.int64)
        if not len(self.terms):
            return none, none, none, none.astype(bool)
        list_of = np.searchsorted(self.terms, block.terms)
        list_of[list_of == len(self.terms)] = 0
        used = np.arange(block.terms.shape[1]) < block.words[:, None]
        present = self.terms[list_of] == block.terms
        size = np.where(used, np.where(present, np.diff(self.start)[list_of], 0), np.iinfo(np.int64).max)
        live = np.flatnonzero((size > 0).all(axis=1))
        if not len(live):
            return none, none, none, none.astype(bool)
        rarest_first = np.argsort(size[live], axis=1, kind="stable")
        anchor = rarest_first[:, 0]
        lists = list_of[live]
        own = lists[np.arange(len(live)), anchor]
        many = self.start[own + 1] - self.start[own]
        window = np.repeat(np.arange(len(live)), many)
        flat = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - self.start[own], many)
        place = self.postings[flat]
        # Lists laid end to end are sorted by (list, position): one probe tests any of them.
        stride = self.span + 2 * GAP + len(block.terms[0])
        laid = np.repeat(np.arange(len(self.terms)), np.diff(self.start)) * stride + self.postings

        def held(window: np.ndarray, begin: np.ndarray, offset: np.ndarray, slack: int) -> np.ndarray:
            sought = lists[window, offset] * stride + begin + offset
            at = np.searchsorted(laid, sought - slack)
            hit = at < len(laid)
            hit[hit] = laid[at[hit]] <= sought[hit] + slack
            return hit | (offset >= block.words[live[window]])

        begin = place - anchor[window]
        if slack:
            aside = np.arange(-slack, slack + 1)
            window, place, begin = (np.repeat(x, len(aside)) for x in (window, place, begin))
            begin = begin + np.tile(aside, len(begin) // len(aside))
        for rank in range(1, block.terms.shape[1]):
            if not len(window):
                break
            keep = held(window, begin, rarest_first[window, rank], slack)
            window, begin, place = window[keep], begin[keep], place[keep]
        if not slack:
            return live[window], begin, place, np.ones(len(window), bool)
        once = np.unique(window * (stride + 2 * GAP) + begin + GAP, return_index=True)[1]
        window, begin, place = window[once], begin[once], place[once]
        exact = np.ones(len(window), bool)
        for offset in range(block.terms.shape[1]):
            exact &= held(window, begin, np.full(len(window), offset), 0)
        return live[window], begin, place, exact


@dataclass
class _Found:
    """What is found in the texts of a segment, by row: ranges of words, and items."""

    ranges: dict[int, list[np.ndarray]]
    items: dict[int, set[str]]

    @classmethod
    def none(cls) -> _Found:
        return cls({}, {})

    def add(self, windows: WindowBlock, window: np.ndarray, begin: np.ndarray, row: np.ndarray, bases: np.ndarray, words: np.ndarray) -> None:
        for k in np.unique(row).tolist():
            own = row == k
            lo = begin[own] - bases[k]
            spans = np.stack([lo, lo + windows.words[window[own]]])
            self.ranges.setdefault(k, []).append(np.clip(spans, 0, words[k]))
            self.items.setdefault(k, set()).update(x for w in np.unique(window[own]) for x in windows.owners[w])

    def covered(self, k: int) -> np.ndarray:
        return _union(*np.concatenate(self.ranges[k], axis=1)) if k in self.ranges else np.zeros((0, 2), np.int64)


def _search_segment(segment: Segment, bases: np.ndarray, words: np.ndarray, windows: WindowBlock, slack: int) -> tuple[_Found, _Found]:
    """Exact matches, and all matches within ``slack``."""
    window, begin, place, exact = segment.find(windows, slack)
    row = np.searchsorted(bases, place, side="right") - 1
    found, near = _Found.none(), _Found.none()
    found.add(windows, window[exact], begin[exact], row[exact], bases, words)
    if slack:
        near.add(windows, window, begin, row, bases, words)
    return found, near


HIT_SCHEMA = "doc_id bigint, n_words bigint, n_hit bigint, items array<string>, near_items array<string>, covered array<bigint>, near array<bigint>"
_PLACE = "segment bigint, row int, "


def search(index: DataFrame, block: Broadcast | None, slack: int = 0, hits_only: bool = False) -> DataFrame:
    """One row per document (or those with a match only): what a block of windows finds.

    ``covered`` holds first and last-plus-one word of each range that exact matches
    cover, in order, ``n_hit`` their words and ``items`` the items found.  ``near`` and
    ``near_items`` are those of all matches within ``slack``, empty without it.
    """
    if not 0 <= slack < GAP // 2:
        raise ValueError(f"slack must be below {GAP // 2}")
    segment_names = [f.split()[0] for f in SEGMENT_SCHEMA.split(", ")]
    schema = _PLACE + HIT_SCHEMA

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        texts, longs = pa.list_(pa.string()), pa.list_(pa.int64())
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), texts, texts, longs, longs]
        for batch in batches:
            for n in range(batch.num_rows):
                key, doc_ids, n_words, base, terms, start, postings = (batch.column(c)[n].as_py() for c in segment_names)
                found = near = _Found.none()
                if block is not None:
                    found, near = _search_segment(Segment.of(terms, start, postings), np.array(base), np.array(n_words), block.value, slack)
                out = []
                for k in sorted(found.ranges.keys() | near.ranges.keys()) if hits_only else range(len(doc_ids)):
                    covered = found.covered(k)
                    out.append((key, k, doc_ids[k], n_words[k], int(np.diff(covered).sum()), sorted(found.items.get(k, ())), sorted(near.items.get(k, ())), covered.ravel().tolist(), near.covered(k).ravel().tolist()))
                for at in range(0, len(out), 5000):
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out[at : at + 5000], strict=True), kinds, strict=True)], names=names)

    return index.mapInArrow(work, schema)


def _merged(parts: DataFrame) -> DataFrame:
    """What several blocks of windows find in a document, as one row."""
    names = ["n_hit", "covered", "near"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = {c: [] for c in names}
            for c in ("covered", "near"):
                for flat in batch.column(c).to_pylist():
                    spans = np.array(flat, np.int64).reshape(-1, 2)
                    spans = _union(spans[:, 0], spans[:, 1]) if len(spans) else spans
                    kept[c].append(spans.ravel().tolist())
                    if c == "covered":
                        kept["n_hit"].append(int(np.diff(spans).sum()))
            columns = [pa.array(kept[c], batch.schema.field(c).type) if c in kept else batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    sets = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "near_items")]
    ranges = [F.flatten(F.collect_list(c)).alias(c) for c in ("covered", "near")]
    together = parts.groupBy("segment", "row").agg(F.sum("n_hit").alias("n_hit"), *sets, *ranges)
    return together.mapInArrow(work, together.schema)


def _union(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Disjoint ranges, in order, that cover what the given ranges cover."""
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    heads = np.flatnonzero(np.concatenate([[True], lo[1:] > reach[:-1]]))
    return np.stack([lo[heads], reach[np.append(heads[1:], len(lo)) - 1]], axis=1)


# --- whole operator ----------------------------------------------------------------
def find_items(docs: DataFrame, items: DataFrame, size: int = WINDOW, slack: int = 0, per_block: int = WINDOWS_PER_BLOCK) -> DataFrame:
    """Search the documents' index for every window of every item; see :func:`search`.

    One row per input row.  Documents without words, and all documents when there are
    no items, have no hits.  Null item_ids are left out; items with equal ids count as
    one; null texts have no words.
    """
    context = docs.sparkSession.sparkContext
    index: DataFrame | None = None
    parts: DataFrame | None = None
    for block, first, last in _one_after_another(item_windows(items, size), per_block):
        if index is None:  # one block's terms are all that can matter if there is no other
            index = stored(build_index(docs, block.vocabulary() if last else None), "postings")
        sent = context.broadcast(block)
        if first and last:
            return search(index, sent, slack).drop("segment", "row")
        part = stored(search(index, sent, slack, hits_only=True), "matches")
        sent.destroy()
        parts = part if parts is None else parts.unionByName(part)
    if index is None:
        return search(build_index(docs, np.zeros(0, np.uint64)), None).drop("segment", "row")
    everyone = search(index, None).select("segment", "row", "doc_id", "n_words")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    found = everyone.join(_merged(parts), ["segment", "row"], "left")
    empty = {"n_hit": F.lit(0), "items": none("string"), "near_items": none("string"), "covered": none("bigint"), "near": none("bigint")}
    return found.select("doc_id", "n_words", *[F.coalesce(F.col(c), e).alias(c) for c, e in empty.items()])


def op7_contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per row of ``docs``, as the contract has it, and two columns more.

    ``n_near`` counts the items that a proximity match finds and no exact one;
    ``n_near_words`` the words that exact and proximity matches cover.  Null and wordless texts have
    no words and no hits; repeated rows are rows of their own.
    """
    found = find_items(docs, items, slack=SLACK)
    spans = lambda c: F.aggregate(F.col(c), F.lit(0).cast("bigint"), lambda s, x: x - s)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size(F.array_except("near_items", "items")).cast("bigint").alias("n_near"),
        spans("near").alias("n_near_words"),
    )


def cut_passages(docs: DataFrame, items: DataFrame, size: int = WINDOW, per_block: int = WINDOWS_PER_BLOCK) -> DataFrame:
    """``docs`` with each covered stretch of words taken out of its text.

    A stretch goes from its first word's first byte to its last word's last byte, so
    what stands around it stays.  Texts without a hit come back byte for byte, null
    ones null; all other columns and repeated rows stay as they are.

    The index of a block of texts is searched where the texts are, so that each hit
    meets its text without a join.
    """
    context, columns = docs.sparkSession.sparkContext, docs.columns
    text, cuts = unused(columns, "__text"), unused(columns, "__cuts")
    rows = docs.select(*[F.col(f"`{c}`") for c in columns], F.col("text").cast("string").alias(text), F.array().cast("array<bigint>").alias(cuts))
    for block, _, last in _one_after_another(item_windows(items, size), per_block):
        sent = context.broadcast(block)
        rows = rows.mapInArrow(_marker(sent, text, cuts), rows.schema)
        if not last:
            rows = stored(rows, "cuts")
            sent.destroy()
    schema = StructType([StructField("text", StringType()) if f.name == "text" else f for f in docs.schema.fields])
    return rows.mapInArrow(_cutter(columns, text, cuts), schema)


def _marker(sent: Broadcast, text: str, cuts: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the byte ranges that a block of windows covers to column ``cuts``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value.vocabulary()
        for batch in batches:
            spans = batch.column(cuts).to_pylist()
            at = 0
            for block in text_blocks(iter([batch]), text, text):
                words = find_words(block, WORD_BYTE)
                _, n_words, base, terms, start, postings = _segment(block, vocabulary)
                found, _ = _search_segment(Segment.of(terms, start, postings), np.array(base), np.array(n_words), sent.value, 0)
                for k in found.ranges:
                    lo, hi = found.covered(k).T + words.first[k]
                    spans[at + k] = [*spans[at + k], *(np.stack([words.lo[lo], words.hi[hi - 1]], axis=1) - block.starts[k]).ravel().tolist()]
                at += len(block)
            column = pa.array(spans, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([column if c == cuts else batch.column(n) for n, c in enumerate(batch.schema.names)], names=batch.schema.names)

    return work


def _cutter(columns: list[str], text: str, cuts: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Takes the byte ranges in ``cuts`` out of each text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text)
            spans = batch.column(cuts)
            some = np.flatnonzero(np.asarray(pc.list_value_length(spans)))
            if len(some):
                kept = texts.to_pylist()
                for k in some.tolist():
                    raw, flat = kept[k].encode(), np.array(spans[k].as_py(), np.int64).reshape(-1, 2)
                    union = _union(flat[:, 0], flat[:, 1])
                    ends = zip([0, *union[:, 1].tolist()], [*union[:, 0].tolist(), len(raw)], strict=True)
                    kept[k] = b"".join(raw[a:b] for a, b in ends).decode("utf-8", "replace")
                texts = pa.array(kept, texts.type)
            yield pa.RecordBatch.from_arrays([texts.cast(pa.string()) if c == "text" else batch.column(n) for n, c in enumerate(columns)], names=columns)

    return work
