"""N-gram Jaccard join by T-occurrence search.

Each text is the set of its word shingles.  Equal sets are one class from the start,
kept once.  Texts that can link must meet: with hashes as the order of
shingles, two sets that overlap enough share at least T shingles among the first
``n - overlap + T`` of each, T a quarter of the set.  Shingles that only one set has there
are dropped, sets with fewer than T left can't link, and of the rest all but T - 1 of
the rarest lead on; by the same argument a linked pair shares one of these.

Texts that share such a shingle are linked by a star to the least of them, and the
components of these stars are families: pairs to be found lie within one.  A family is
searched in one task by an inverted list per shingle: for each set the short lists are
heap-merged and the L longest binary-probed (DivideSkip); sets that occur T times are
compared exactly.

Families beyond ``CELL_SETS`` sets or ``CELL_SHINGLES`` are cut into cells, and each pair of cells is one task: no
pair is lost, and no task gets an unbounded group.  Every set asks and every candidate is
compared, so links are counted in full; a task returns a count for each set and as many
links as join its classes.

Where classes are asked for without counts (``keep_one_each``), a pair that is in one
class already isn't compared: cells are searched first, each with the family's least set;
what then is not in the family's largest class asks all cells once more.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from folioflux.llm.components import components
from folioflux.llm.messages import MESSAGE, messages, packed, unpacked
from folioflux.llm.rows import LOWER, NON_SPACE, TextBlock, chain, find_words, hash_spans, mix, text_blocks, unused

#: T as a part of the set's size.
SHARED_PART = 0.25
#: Bounds of a cell: sets, and shingles of all of them (3 MB of hashes).
CELL_SETS, CELL_SHINGLES = 700, 400_000
#: Ids of sets to be searched that may be sent to every task: 0.8 MB, some MB while the
#: driver builds them; of more, a bitmap of so many bits is sent (4 MB, whatever their number).
SENT_IDS, ID_BITS = 100_000, 1 << 25
#: Shingles that a shard of the two routing steps stands for.
SHARD_SHINGLES = 600_000
#: Weight of probing against merging in DivideSkip's choice of L.
MU = 0.02
#: Families of more sets are first linked along their order, to leave less to search.
CHAIN_FROM = 64


# --- sets --------------------------------------------------------------------------
def shingle_sets(block: TextBlock, words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of ``words`` words.

    A text of fewer words has one shingle, all of them; one without words has none.
    """
    found = find_words(block, NON_SPACE)
    h = hash_spans(LOWER[block.data], found.lo, found.hi)
    n = max(0, len(h) - words + 1)
    whole = chain([h[k : k + n] for k in range(words)])
    out = []
    for k in range(len(block)):
        a, b = found.first[k], found.first[k + 1]
        if b - a >= words:
            out.append(np.unique(whole[a : b - words + 1]))
        else:
            out.append(chain([h[j : j + 1] for j in range(a, b)]) if b > a else np.zeros(0, np.uint64))
    return out


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of ``n`` shares at least with any set it links with."""
    return -(-n * percent // 100)


def shared(n: int, percent: int) -> int:
    """T between sets of at least ``n`` shingles."""
    return min(max(1, int(SHARED_PART * n)), max(1, least_overlap(n, percent)))


def least_shared(n: int, percent: int) -> int:
    """T towards the smallest set that a set of ``n`` can link with."""
    return shared(least_overlap(n, percent), percent)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= percent * (len(both) - same)


# --- DivideSkip --------------------------------------------------------------------
def t_occurrence(lists: list[list[int]], t: int) -> list[int]:
    """Numbers that occur in at least ``t`` of the sorted lists."""
    lists = sorted((x for x in lists if x), key=len)
    if len(lists) < t:
        return []
    longest = len(lists[-1])
    n_long = min(t - 1, int(t / (MU * math.log2(longest + 1) + 1)))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    need, out = t - n_long, []

    def offer(number: int, seen: int) -> None:
        if seen < need:
            return
        left = len(long)
        for probe in long:
            if seen + left < t or seen >= t:
                break
            at = _bisect(probe, number)
            seen += at < len(probe) and probe[at] == number
            left -= 1
        if seen >= t:
            out.append(number)

    last, seen = None, 0
    for number in heapq.merge(*short):
        if number == last:
            seen += 1
            continue
        if last is not None:
            offer(last, seen)
        last, seen = number, 1
    if last is not None:
        offer(last, seen)
    return out


def _bisect(values: list[int], wanted: int) -> int:
    lo, hi = 0, len(values)
    while lo < hi:
        mid = (lo + hi) // 2
        if values[mid] < wanted:
            lo = mid + 1
        else:
            hi = mid
    return lo


def t_occurrence_of_arrays(lists: list[np.ndarray], t: int) -> np.ndarray:
    """``t_occurrence`` over arrays: sorting the short ones, run by run, merges them."""
    lists = sorted((x for x in lists if len(x)), key=len)
    if len(lists) < t:
        return np.zeros(0, np.int64)
    n_long = min(t - 1, int(t / (MU * math.log2(len(lists[-1]) + 1) + 1)))
    merged = np.concatenate(lists[: len(lists) - n_long])
    merged.sort(kind="stable")
    heads = np.append(np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]])), len(merged))
    number, seen = merged[heads[:-1]], np.diff(heads)
    for left, probe in zip(range(n_long, 0, -1), lists[len(lists) - n_long :], strict=True):
        live = seen + left >= t
        number, seen = number[live], seen[live]
        at = np.minimum(np.searchsorted(probe, number), len(probe) - 1)
        seen += probe[at] == number
    return number[seen >= t]


class _Classes:
    def __init__(self, start: list[int]):
        first: dict[int, int] = {}
        self.up = [first.setdefault(c, k) for k, c in enumerate(start)]

    def top(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def join(self, a: int, b: int) -> None:
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)


class _Block:
    """Sets searched together: inverted lists of their keys, and their shingles as numbers."""

    def __init__(self, keys: list[np.ndarray], sets: list[np.ndarray], percent: int, listed: np.ndarray | None = None):
        self.percent, self.count = percent, len(sets)
        self.key, self.key_first = _numbered(keys)
        owner = np.repeat(np.arange(self.count), np.diff(self.key_first)).astype(np.uint16 if self.count < 1 << 16 else np.uint32)
        held = np.ones(len(self.key), bool) if listed is None else listed[owner]
        order = np.argsort(self.key[held], kind="stable")
        self.lists = owner[held][order]
        self.at = np.searchsorted(self.key[held][order], np.arange(self.key.max(initial=-1) + 2))
        self.shingle, self.first = _numbered(sets)
        self.sizes = np.diff(self.first)
        self.own = np.zeros(self.shingle.max(initial=-1) + 1, bool)

    def candidates(self, a: int) -> np.ndarray:
        """Listed sets that share T keys with set ``a``."""
        own = self.key[self.key_first[a] : self.key_first[a + 1]].tolist()
        return t_occurrence_of_arrays([self.lists[self.at[k] : self.at[k + 1]] for k in own], least_shared(int(self.sizes[a]), self.percent)).astype(np.int64)

    def linked(self, a: int, near: np.ndarray) -> np.ndarray:
        """Those of ``near`` that set ``a`` links with."""
        if not len(near):
            return near
        mine, sizes = self.shingle[self.first[a] : self.first[a + 1]], self.sizes[near]
        self.own[mine] = True
        ends = np.cumsum(sizes)
        spots = np.arange(ends[-1]) + np.repeat(self.first[near] - (ends - sizes), sizes)
        same = np.add.reduceat(self.own[self.shingle[spots]], ends - sizes, dtype=np.int64)
        self.own[mine] = False
        return near[100 * same >= self.percent * (self.sizes[a] + sizes - same)]


def search_block(ids: list[int], classes: list[int], keys: list[np.ndarray], sets: list[np.ndarray], percent: int, asks: list[bool] | None = None) -> list[tuple[int, int]]:
    """Links that join the block's classes: enough to join all that are linked.

    ``keys`` are the shingles of each set that count for T.  With ``asks``, links of the
    sets it marks are sought only.  Sets of one class aren't compared.
    """
    n = len(ids)
    own, links = _Classes(classes), []

    def link(a: int, b: int) -> None:
        if own.top(a) != own.top(b):
            own.join(a, b)
            links.append((ids[a], ids[b]))

    order = sorted(range(n), key=lambda k: (len(sets[k]), ids[k]))
    if n > CHAIN_FROM:
        least = min(range(n), key=lambda k: ids[k])
        for a, b in zip(order[:-1], order[1:], strict=True):
            for c in (a, least, order[n // 2]):
                if own.top(b) != own.top(c) and linked(sets[b], sets[c], percent):
                    link(b, c)
    tops = np.array([own.top(k) for k in range(n)])
    different, sizes = np.unique(tops, return_counts=True)
    if len(different) == 1:
        return links
    # Of two sets of different classes, one is outside the block's largest class.
    largest = different[np.argmax(sizes)] if n > CHAIN_FROM and asks is None else -1
    block = _Block(keys, sets, percent)
    for a in order:
        if tops[a] == largest or (asks is not None and not asks[a]):
            continue
        near = block.candidates(a)
        mine = own.top(a)
        for b in block.linked(a, np.array([b for b in near.tolist() if own.top(b) != mine], np.int64)).tolist():
            link(a, b)
    return links


def _numbered(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The values of all arrays as numbers from 0, and where each array begins."""
    first = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int64)
    return np.unique(np.concatenate(arrays), return_inverse=True)[1].reshape(-1), first


def join_block(ids: list[int], keys: list[np.ndarray], sets: list[np.ndarray], percent: int, asks: list[bool] | None = None) -> tuple[list[int], list[tuple[int, int]]]:
    """The number of links of each set, and links enough to join all that are linked.

    With ``asks``, links between a set it marks and one it doesn't are sought only.
    """
    n = len(ids)
    block = _Block(keys, sets, percent, None if asks is None else ~np.array(asks))
    counts, classes, links = np.zeros(n, np.int64), np.arange(n), []
    for a in range(n):
        if asks is not None and not asks[a]:
            continue
        near = block.candidates(a)
        near = block.linked(a, near[near < a] if asks is None else near)
        counts[near] += 1
        counts[a] += len(near)
        for top, b in zip(*np.unique(classes[near], return_index=True), strict=True):
            if top != classes[a]:
                links.append((ids[a], ids[near[b]]))
                classes[classes == top] = classes[a]
    return counts.tolist(), links


# --- routing -----------------------------------------------------------------------
SET_SCHEMA = "doc_id bigint, n bigint, f1 bigint, f2 bigint, shingles binary"


def _fingerprint(own: np.ndarray) -> tuple[int, int]:
    a, b = mix(own), mix(own ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return tuple(np.array([a.sum(dtype=np.uint64), b.sum(dtype=np.uint64)], np.uint64).view(np.int64).tolist())


def _sets(docs: DataFrame, words: int, whole: bool = False) -> DataFrame:
    """Size and fingerprint of each text's set, and on demand the set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            sets = shingle_sets(block, words)
            marks = [_fingerprint(own) for own in sets]
            columns = [[len(own) for own in sets], [a for a, _ in marks], [b for _, b in marks]]
            bodies = pa.array([own.tobytes() if whole else None for own in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([block.ids, *(pa.array(c, pa.int64()) for c in columns), bodies], names=["doc_id", "n", "f1", "f2", "shingles"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, SET_SCHEMA)


def _own_sets(block: TextBlock, words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The block's different sets, and a mark (f1, half of f2 with n) of 16 bytes for each.

    The 96 bits of hashes and the size stand for a set on its way through the routing.
    """
    seen: dict[tuple[int, int, int], np.ndarray] = {}
    for own in shingle_sets(block, words):
        if len(own):
            seen.setdefault((*_fingerprint(own), len(own)), own)
    marks = np.array(list(seen), np.int64).reshape(-1, 3)
    return list(seen.values()), np.stack([marks[:, 0], marks[:, 1] << 32 | marks[:, 2]], axis=1)


def _by_shingle(docs: DataFrame, words: int, percent: int, shards: int) -> DataFrame:
    """The first shingles of each block's different sets, by shingle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text"):
            sets, marks = _own_sets(block, words)
            if not sets:
                continue
            early = [own[: min(len(own), len(own) - least_overlap(len(own), percent) + shared(len(own), percent))] for own in sets]
            key, owner = np.concatenate(early), np.repeat(np.arange(len(early)), [len(e) for e in early])

            def pack(at: np.ndarray, key: np.ndarray = key, owner: np.ndarray = owner, marks: np.ndarray = marks) -> bytes:
                here, local = np.unique(owner[at], return_inverse=True)
                return packed(key=key[at], owner=local.astype(np.uint16 if len(here) < 1 << 16 else np.uint32), marks=marks[here])

            yield from messages((key >> np.uint64(7)) % np.uint64(shards), "key", shards, pack)

    return docs.where("doc_id is not null").select(F.col("text").cast("string").alias("text")).mapInArrow(work, MESSAGE)


def _gathered(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[dict[str, np.ndarray]]]:
    """Keys of all messages, their owners as numbers, and the owners' marks."""
    parts = [unpacked(b.as_py()) for b in group.column("body")]
    sizes = np.array([len(m["marks"]) for m in parts])
    marks, number = np.unique(np.concatenate([m["marks"] for m in parts]), axis=0, return_inverse=True)
    number, base = number.reshape(-1), np.cumsum(sizes) - sizes
    owner = np.concatenate([number[b + m["owner"].astype(np.int64)] for m, b in zip(parts, base, strict=True)])
    return np.concatenate([m["key"] for m in parts]), owner, marks, parts


def _common(by_shingle: DataFrame, shards: int) -> DataFrame:
    """Shingles that two or more sets have, sent back by set."""

    def merge(group: pa.Table) -> pa.Table:
        key, owner, marks, _ = _gathered(group)
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])
        key, owner = key[fresh], owner[fresh]  # copies of a set in other blocks count once
        heads = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key))
        df = np.repeat(np.diff(heads), np.diff(heads))
        keep = df > 1
        # Any order of shingles that all sets share will do, so thousandths of log2 are enough.
        key, owner, df = key[keep], owner[keep], (1000 * np.log2(df[keep])).astype(np.uint16)

        def pack(at: np.ndarray) -> bytes:
            here, local = np.unique(owner[at], return_inverse=True)
            return packed(key=key[at], owner=local.astype(np.uint16 if len(here) < 1 << 16 else np.uint32), df=df[at], marks=marks[here])

        out = list(messages(mix(marks[owner, 0].view(np.uint64)) % np.uint64(shards), "set", shards, pack)) if len(key) else []
        return pa.Table.from_batches(out, pa.schema([("shard", pa.int64()), ("kind", pa.string()), ("body", pa.binary())]))

    return by_shingle.groupBy("shard").applyInArrow(merge, MESSAGE)


ROUTE_SCHEMA = "f1 bigint, mark bigint, keys binary, routes array<bigint>"


def _routes(common: DataFrame, percent: int) -> DataFrame:
    """Sets with T common shingles or more: these, and the rarest of them as routes."""

    def merge(group: pa.Table) -> pa.Table:
        key, owner, marks, parts = _gathered(group)
        df = np.concatenate([m["df"] for m in parts])
        order = np.lexsort((key, df, owner))
        key, owner = key[order], owner[order]
        heads = np.append(np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])), len(owner))
        rows = []
        for a, b in zip(heads[:-1], heads[1:], strict=True):
            f1, mark = marks[owner[a]].tolist()
            t = least_shared(mark & 0xFFFFFFFF, percent)
            if b - a >= t:
                rows.append((f1, mark, key[a:b].tobytes(), key[a : b - t + 1].view(np.int64).tolist()))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
        return pa.table({f.split()[0]: pa.array(list(c), t) for f, c, t in zip(ROUTE_SCHEMA.split(", "), columns, kinds, strict=True)})

    return common.groupBy("shard").applyInArrow(merge, ROUTE_SCHEMA)


# --- families ----------------------------------------------------------------------
def _families(routes: DataFrame) -> DataFrame:
    """(rep, family, cells) of every set that shares a route with another."""
    routed = routes.select("rep", F.explode("routes").alias("route"))
    least = routed.groupBy("route").agg(F.min("rep").alias("low"))
    edges = routed.join(least, "route").where("rep <> low").select(F.col("low").alias("u"), F.col("rep").alias("v"))
    family = components(edges).select(F.col("node").alias("rep"), F.col("component").alias("family"))
    cells = F.greatest(F.ceil(F.count(F.lit(1)) / CELL_SETS), F.ceil(F.sum("n") / CELL_SHINGLES)).cast("bigint")
    # Only families of several cells are looked up; where they are few, no family is moved.
    cut = family.join(routes.select("rep", "n"), "rep").groupBy("family").agg(cells.alias("cells")).where("cells > 1").checkpoint()
    few = cut.count() <= SENT_IDS
    return family.join(F.broadcast(cut) if few else cut, "family", "left").withColumn("cells", F.coalesce("cells", F.lit(1).cast("bigint")))


def _among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` whose doc_id is one of ``ids``, and a few others: no text is moved, and
    what the driver sends doesn't grow with the ids."""
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(ID_BITS)) + 1
    bits = ids.select(spot.alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("__bits"))
    at = F.bitmap_bit_position(spot).cast("int")
    octet = F.conv(F.hex(F.substring(F.col("__bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = rows.withColumn("__bucket", F.bitmap_bucket_number(spot)).join(F.broadcast(bits), "__bucket")
    return marked.where(octet.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0).select(*rows.columns)


def _search(blocks: DataFrame, percent: int) -> DataFrame:
    """Search each (family, cell, other); ``asks`` marks the sets that ask, null: all do."""

    def work(group: pa.Table) -> pa.Table:
        rows = sorted(group.select(["rep", "class", "asks", "keys", "shingles"]).to_pylist(), key=lambda r: (r["rep"], not r["asks"]))
        rows = [r for n, r in enumerate(rows) if not n or rows[n - 1]["rep"] != r["rep"]]
        keys, sets = ([np.frombuffer(r[c], np.uint64) for r in rows] for c in ("keys", "shingles"))
        asks = None if rows[0]["asks"] is None else [r["asks"] for r in rows]
        links = search_block([r["rep"] for r in rows], [r["class"] for r in rows], keys, sets, percent, asks)
        return pa.table({"u": pa.array([a for a, _ in links], pa.int64()), "v": pa.array([b for _, b in links], pa.int64())})

    return blocks.groupBy("family", "cell", "other").applyInArrow(work, "u bigint, v bigint")


def _first_search(sets: DataFrame, percent: int) -> DataFrame:
    cell = F.pmod(F.xxhash64("rep"), F.col("cells"))
    # The family's least set goes to all cells, all others to one.
    cells = F.when(F.col("rep") == F.col("family"), F.sequence(F.lit(0).cast("bigint"), F.col("cells") - 1)).otherwise(F.array(cell))
    placed = sets.select("rep", "family", "keys", "shingles", F.col("rep").alias("class"), F.lit(None).cast("boolean").alias("asks"), F.explode(cells).alias("cell"), F.lit(-1).cast("bigint").alias("other"))
    return _search(placed, percent)


def _second_search(sets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of families in several cells, the sets outside the largest class ask all cells."""
    slim = sets.where("cells > 1").select("rep", "family").join(classes, "rep", "left").withColumn("class", F.coalesce("class", "rep"))
    sizes = slim.groupBy("family", "class").agg(F.count(F.lit(1)).alias("n"))
    top = sizes.groupBy("family").agg(F.max(F.struct("n", "class")).alias("top"), F.sum("n").alias("members"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    half = F.lit(CELL_SETS / 2)
    plan = top.select("family", F.col("top.class").alias("largest"), F.ceil(F.col("members") / half).cast("bigint").alias("all"), F.ceil((F.col("members") - F.col("top.n")) / half).cast("bigint").alias("few"))
    member = slim.join(plan, "family")
    every = lambda n: F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)
    askers = member.where("class <> largest").select("family", "rep", "class", F.lit(True).alias("asks"), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("few")).alias("cell"), F.explode(every("all")).alias("other"))
    asked = member.select("family", "rep", "class", F.lit(False).alias("asks"), F.explode(every("few")).alias("cell"), F.pmod(F.xxhash64("rep"), F.col("all")).alias("other"))
    return _search(askers.unionByName(asked).join(sets.select("rep", "keys", "shingles"), "rep"), percent)


def _join(sets: DataFrame, percent: int) -> DataFrame:
    """Rows (u, v, null) join what is linked, (u, null, n) add to the links of u.

    Each two cells of a family meet in one task, and each cell meets itself.
    """

    def work(group: pa.Table) -> pa.Table:
        rows = sorted(group.select(["rep", "asks", "keys", "shingles"]).to_pylist(), key=lambda r: r["rep"])
        keys, shingles = ([np.frombuffer(r[c], np.uint64) for r in rows] for c in ("keys", "shingles"))
        asks = None if rows[0]["asks"] is None else [r["asks"] for r in rows]
        counts, links = join_block([r["rep"] for r in rows], keys, shingles, percent, asks)
        counted = [(r["rep"], n) for r, n in zip(rows, counts, strict=True) if n]
        u, v, n = [a for a, _ in links] + [a for a, _ in counted], [b for _, b in links] + [None] * len(counted), [None] * len(links) + [n for _, n in counted]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "n": pa.array(n, pa.int64())})

    own = F.pmod(F.xxhash64("rep"), F.col("cells"))
    meets = sets.withColumn("own", own).withColumn("met", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cells") - 1)))
    asks = F.when(F.col("own") != F.col("met"), F.col("own") < F.col("met"))
    placed = meets.select("family", F.least("own", "met").alias("cell"), F.greatest("own", "met").alias("other"), "rep", asks.alias("asks"), "keys", "shingles")
    return placed.groupBy("family", "cell", "other").applyInArrow(work, "u bigint, v bigint, n bigint")


FINGERPRINT = ["f1", "f2", "n"]


def _classes(docs: DataFrame, words: int, percent: int, count_links: bool) -> DataFrame:
    """(f1, f2, n, least, rows, class, component, copies, n_links) of every different set.

    ``least`` is the least doc_id of a set and ``rows`` the number of rows that have
    both; ``component`` is the least doc_id of its ``class``.  A set is known by its
    fingerprint: sets that share a least doc_id are still two, and all of them but one
    stand under numbers below every doc_id while links are sought.
    """
    counted = _sets(docs, words).where("n > 0 and doc_id is not null").groupBy(*FINGERPRINT, "doc_id").agg(F.count(F.lit(1)).alias("rows"))
    found = counted.groupBy(*FINGERPRINT).agg(F.min(F.struct("doc_id", "rows")).alias("low"), F.sum("rows").alias("copies")).select(*FINGERPRINT, F.col("low.doc_id").alias("least"), "low.rows", "copies").checkpoint()
    mark = F.struct(*FINGERPRINT)
    shared_ids = found.groupBy("least").agg(F.count(F.lit(1)).alias("sets"), F.min(mark).alias("lead")).where("sets > 1").select("least", "lead").checkpoint()
    repeated = not shared_ids.isEmpty()
    reps = found.withColumn("rep", F.col("least"))
    if repeated:
        below = F.lit(found.agg(F.min("least")).first()[0]).cast("bigint") - 1 - F.monotonically_increasing_id()
        reps = found.join(shared_ids, "least", "left").withColumn("rep", F.when(F.col("lead").isNull() | (F.col("lead") == mark), F.col("least")).otherwise(below)).drop("lead").checkpoint()
    total = reps.agg(F.sum("n")).first()[0] or 0
    shards = max(8, -(-int(total * (1 - percent / 100 + SHARED_PART)) // SHARD_SHINGLES))
    routed = _routes(_common(_by_shingle(docs, words, percent, shards), shards), percent)
    marked = reps.select(*FINGERPRINT, "rep", "least", F.shiftleft("f2", 32).bitwiseOR(F.col("n")).alias("mark"))
    routes = routed.join(marked, ["f1", "mark"]).drop("mark").checkpoint()
    family = _families(routes).checkpoint()
    # The few sets left come from their texts again, which costs less than moving all.
    of_rep = routes.select(*FINGERPRINT, "rep", "least", "keys").join(family, "rep")
    wanted = of_rep.select(F.col("least").alias("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    texts = texts.join(F.broadcast(wanted), "doc_id", "left_semi") if family.count() <= SENT_IDS else _among(texts, wanted)
    whole = _sets(texts, words, whole=True).select(*FINGERPRINT, "shingles")
    sets = whole.join(of_rep, FINGERPRINT).dropDuplicates(["rep"]).select("rep", "keys", "shingles", "family", "cells").checkpoint()
    if count_links:
        joined = _join(sets, percent).checkpoint()
        links = joined.where("v is not null").select("u", "v")
        reps = reps.join(joined.where("n is not null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n_links")), "rep", "left").na.fill(0, ["n_links"])
    else:
        links = _first_search(sets, percent).checkpoint()
        if not sets.where("cells > 1").isEmpty():
            classes = components(links).select(F.col("node").alias("rep"), F.col("component").alias("class"))
            links = links.unionByName(_second_search(sets, classes, percent))
    final = components(links).select(F.col("node").alias("rep"), F.col("component"))
    out = reps.join(final, "rep", "left").withColumn("class", F.coalesce("component", "rep")).withColumn("component", F.col("class"))
    if repeated:
        out = out.drop("component").join(out.groupBy("class").agg(F.min("least").alias("component")), "class")
    return out.drop("rep")


def jaccard_classes(docs: DataFrame, words: int = 3, percent: int = 90, count_links: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, copies, n_links) of every row of ``docs``.

    ``n_links`` is the number of other sets that the row's set links with, each once
    however many copies it has; without ``count_links`` there is no such column.

    ``component_id`` is the smallest doc_id that links reach, itself included; two texts
    link when 100 * intersection >= ``percent`` * union.  Texts without words link with
    nothing.  Rows without a doc_id stay; they belong to the class of equal sets and
    have no class where none of these has a doc_id.  Repeated rows are equal sets; rows
    of one doc_id with different texts are different sets.  An empty table gives an
    empty one.
    """
    counted = ["n_links"] if count_links else []
    of_set = _classes(docs, words, percent, count_links).select(*FINGERPRINT, "component", "copies", *counted)
    members = _sets(docs, words).drop("shingles")
    n_links = [F.when(F.col("n") > 0, F.col(c)).otherwise(0).alias(c) for c in counted]
    return members.join(of_set, FINGERPRINT, "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("copies", F.lit(1)).alias("copies"), *n_links)


def _marked(docs: DataFrame, words: int, names: list[str]) -> DataFrame:
    """``docs`` with its fingerprints, as columns of some ``names``."""
    text = unused(docs.columns, "__text")
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("text").cast("string").alias(text))
    schema = StructType([*docs.schema.fields, *(StructField(n, LongType()) for n in names)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [np.zeros((0, 3), np.int64)]
            for block in text_blocks(iter([batch]), text, text):
                marks.append(np.array([(*_fingerprint(own), len(own)) for own in shingle_sets(block, words)], np.int64).reshape(-1, 3))
            columns = [pa.array(c) for c in np.ascontiguousarray(np.concatenate(marks).T)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=schema.names)

    return kept.mapInArrow(work, schema)


def keep_one_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Of each class one row stays, with its own columns: one of the smallest doc_id.

    Rows whose texts have no words stay, all of them.  A row without a doc_id stays
    unless its set equals that of a row with one.  A doc_id's rows of unlinked texts
    stay, each.
    """
    of_set = _classes(docs, words, percent, count_links=False).checkpoint()
    f1, f2, n = names = [unused(docs.columns, f"__{c}") for c in FINGERPRINT]
    kept_id, kept_rows = unused(docs.columns, "__kept"), unused(docs.columns, "__rows")
    lead = F.min(F.struct("least", *FINGERPRINT, "rows")).alias("lead")
    keepers = of_set.groupBy("class").agg(lead).select(F.col("lead.least").alias(kept_id), *[F.col(f"lead.{c}").alias(m) for c, m in zip(FINGERPRINT, names, strict=True)], F.col("lead.rows").alias(kept_rows)).checkpoint()
    own = [F.col(f"`{c}`") for c in docs.columns]
    marked = _marked(docs.where("doc_id is not null"), words, names).alias("d")
    found = marked.join(keepers.alias("k"), (F.col("doc_id").cast("bigint") == F.col(kept_id)) & (F.col(f"d.{f1}") == F.col(f"k.{f1}")) & (F.col(f"d.{f2}") == F.col(f"k.{f2}")) & (F.col(f"d.{n}") == F.col(f"k.{n}")), "left")
    found = found.where((F.col(f"d.{n}") == 0) | F.col(kept_id).isNotNull())
    mine = [F.col(f"d.`{c}`") for c in docs.columns]
    if keepers.where(F.col(kept_rows) > 1).isEmpty():
        out = found.select(*mine)
    else:
        once = found.where(F.col(kept_rows) > 1).select(*mine, F.col(f"d.{f1}"), F.col(f"d.{f2}"), F.col(f"d.{n}")).dropDuplicates(["doc_id", *names]).select(*own)
        out = found.where(F.coalesce(F.col(kept_rows), F.lit(1)) == 1).select(*mine).unionByName(once)
    known = of_set.select(*[F.col(c).alias(m) for c, m in zip(FINGERPRINT, names, strict=True)])
    nameless = _marked(docs.where("doc_id is null"), words, names).join(known, names, "left_anti").select(*own)
    return out.unionByName(nameless)


def op1_classes(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: see :func:`jaccard_classes`."""
    return jaccard_classes(docs, 3, 90)
