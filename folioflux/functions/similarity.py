"""Similarities that have no built-in: Arrow-batched functions, used after blocking."""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matched characters over all; the order of the arguments matters."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


class RatioTo:
    """Whether texts reach a ratio with ``b``, as ``SequenceMatcher(None, a, b)`` finds it.

    Its blocks are sought in the same way, but the regions that can hold most come first
    and none is searched once the answer is known; characters that it leaves out of its
    index aren't visited.
    """

    def __init__(self, b: str):
        self.b, self.places = b, SequenceMatcher(None, "", b).b2j

    def reaches(self, a: str, least: float) -> bool:
        total, matched, potential = len(a) + len(self.b), 0, min(len(a), len(self.b))
        if not total:
            return least <= 1.0
        held = [(i, js) for i, c in enumerate(a) if (js := self.places.get(c))]
        starts = [i for i, _ in held]
        regions = [(-potential, 0, len(a), 0, len(self.b))]
        while 2.0 * matched / total < least:
            if not regions or 2.0 * (matched + potential) / total < least:
                return False
            less, alo, ahi, blo, bhi = heapq.heappop(regions)
            potential += less
            i, j, size = self._longest(a, held[bisect_left(starts, alo) : bisect_left(starts, ahi)], alo, ahi, blo, bhi)
            matched += size
            for part in ((alo, i, blo, j), (i + size, ahi, j + size, bhi)) if size else ():
                if (room := min(part[1] - part[0], part[3] - part[2])) > 0:
                    heapq.heappush(regions, (-room, *part))
                    potential += room
        return True

    def _longest(self, a: str, held: list[tuple[int, list[int]]], alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        b, at, to, size, before, last = self.b, alo, blo, 0, {}, -2
        for i, js in held:
            if i != last + 1:
                before = {}
            last, now = i, {}
            for n in range(bisect_left(js, blo), len(js)):
                j = js[n]
                if j >= bhi:
                    break
                k = now[j] = before.get(j - 1, 0) + 1
                if k > size:
                    at, to, size = i - k + 1, j - k + 1, k
            before = now
        while at > alo and to > blo and a[at - 1] == b[to - 1]:
            at, to, size = at - 1, to - 1, size + 1
        while at + size < ahi and to + size < bhi and a[at + size] == b[to + size]:
            size += 1
        return at, to, size


def near_places(a: Column, until: Column, b: Column, since: Column, least: float) -> Column:
    """Places i << 32 | j in the arrays ``a`` and ``b`` of different texts whose
    ``sequence_ratio`` is ``least`` or more, where ``since[j] < until[i]``.

    Matched characters are at most those that two texts share, as often as both have
    them: where these are too few, no ratio is sought.
    """

    def search(left: list[str], until: list, right: list[str], since: list) -> list[int]:
        found, counts = [], [Counter(x) for x in left]
        for j, y in enumerate(right):
            own, letters = None, Counter(y)
            for i, x in enumerate(left):
                total = len(x) + len(y)
                if not since[j] < until[i] or 2.0 * min(len(x), len(y)) / total < least or x == y:
                    continue
                held = counts[i]
                if 2.0 * sum(min(n, held.get(c, 0)) for c, n in letters.items()) / total < least:
                    continue
                own = own or RatioTo(y)
                if own.reaches(x, least):
                    found.append(i << 32 | j)
        return found

    @F.pandas_udf(ArrayType(LongType()))
    def places(a: pd.Series, until: pd.Series, b: pd.Series, since: pd.Series) -> pd.Series:
        return pd.Series([search(*row) for row in zip(a, until, b, since, strict=True)], dtype="object")

    return places(a, until, b, since)


def ratio_bound(a: Column, b: Column) -> Column:
    """What the ratio can't exceed, by lengths alone: a cheap test before the ratio."""
    la, lb = F.char_length(a), F.char_length(b)
    return F.when(la + lb == 0, 1.0).otherwise(2.0 * F.least(la, lb) / (la + lb))


def indel_ratio(a: str, b: str) -> float:
    """100 * (1 - insertions and deletions / total length), by the longest common
    subsequence in bit-parallel form."""
    total = len(a) + len(b)
    if not total:
        return 100.0
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    state, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = state & masks.get(c, 0)
        state = ((state + hit) | (state - hit)) & full
    common = len(a) - state.bit_count()
    return 200.0 * common / total


def token_set(a: str, b: str) -> float:
    """Similarity of two texts as word sets, 0 to 100."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not left or not right):
        return 100.0
    head = " ".join(both)
    with_left, with_right = " ".join(both + left), " ".join(both + right)
    best = indel_ratio(with_left, with_right)
    if both:
        best = max(best, indel_ratio(head, with_left), indel_ratio(head, with_right))
    return best


@F.pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else token_set(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def best_form_score(a: pd.Series, b: pd.Series) -> pd.Series:
    """Best token-set similarity, 0 to 1, over two lists of names."""
    out = []
    for xs, ys in zip(a, b, strict=True):
        if xs is None or ys is None or not len(xs) or not len(ys):
            out.append(0.0)
        else:
            out.append(max(token_set(x, y) for x in xs for y in ys) / 100.0)
    return pd.Series(out, dtype="float64")


#: What HTML takes for a character reference.
REFERENCE = "&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\\t\\n\\f <&#;]{1,32};?)"


@F.pandas_udf(ArrayType(StringType()))
def _resolved(references: pd.Series) -> pd.Series:
    return references.map(lambda found: None if found is None else [html.unescape(r) for r in found])


def unescape_html(text: Column) -> Column:
    """Character references resolved; these alone go to Python, and no text does."""
    found = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))
    resolved = F.array_append(_resolved(found), F.lit(""))
    return F.array_join(F.zip_with(F.split(text, REFERENCE, -1), resolved, lambda piece, r: F.concat(piece, r)), "")


@F.pandas_udf(StringType())
def nfkd_slug(text: pd.Series) -> pd.Series:
    """Kebab case of the ASCII letters that a compatibility decomposition leaves."""

    def slug(t: str | None) -> str | None:
        if t is None:
            return None
        plain = unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower()
        return re.sub(r"[^a-z0-9]+", "-", plain).strip("-")

    return text.map(slug)


@F.pandas_udf(IntegerType())
def loose_find(text: pd.Series, quote: pd.Series) -> pd.Series:
    """Where a quote begins, white space counting alike; -1 where it doesn't occur."""

    def find(t: str | None, q: str | None) -> int:
        parts = (q or "").split()
        if t is None or not parts:
            return -1
        at = re.search(r"\s+".join(map(re.escape, parts)), t)
        return at.start() if at else -1

    return pd.Series([find(t, q) for t, q in zip(text, quote, strict=True)], dtype="int32")
