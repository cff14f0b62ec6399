"""Duplicates: keyed, greedy in order, and by similarity after blocking.

Greedy deduplication keeps a row unless an *earlier survivor* matches it, so it isn't a
search for connected components.  The relation between rows is static, which lets one
table of keys be built first and decided in rounds: a row without an undecided or surviving
earlier match survives; a row whose least earlier match is a survivor is dropped into it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher
from functools import reduce
from itertools import batched

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflux.functions.similarity import best_form_score, near_places, ratio_bound, sequence_ratio, token_set
from folioflux.functions.text import casefold, normal_doi, title_key

#: Open memberships that one task decides in order.
SETTLE = 200_000
#: Titles of an author and band of lengths, and their characters, that are compared with as
#: many others at once.
CELL_TITLES, CELL_CHARS = 128, 1 << 15
#: Artefacts that one pass over the articles searches, and that one search takes together.
ASKED, TOGETHER = 4096, 64


def keyed_dedup(df: DataFrame, key: Column, seq: str, collect: str | None = None) -> DataFrame:
    """First row of each key by ``seq``; ``collect`` (an array) is joined over the key.

    Null keys are distinct rows.
    """
    base = df.withColumn("__key", key)
    order = Window.partitionBy("__key").orderBy(seq)
    first = base.where("__key is not null").withColumn("__rn", F.row_number().over(order)).where("__rn = 1").drop("__rn")
    if collect:
        merged = base.where("__key is not null").groupBy("__key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(collect).alias("v")))), lambda x: x["v"])).alias(collect))
        first = first.drop(collect).join(merged, "__key")
    alone = base.where("__key is null")
    return first.unionByName(alone).drop("__key")


def record_key(doi: Column, title: Column) -> Column:
    """A DOI where there is one, else the collapsed title."""
    return F.coalesce(F.concat(F.lit("doi:"), normal_doi(doi)), F.concat(F.lit("title:"), F.nullif(title_key(title), F.lit(""))))


def key_members(df: DataFrame, seq: str, keys: list[Column]) -> DataFrame:
    """(seq, key) for each key of a row that isn't null."""
    named = F.array(*[F.concat(F.lit(f"{n}:"), k.cast("string")) for n, k in enumerate(keys)])
    return df.select(F.col(seq).alias("seq"), F.explode(named).alias("key")).where("key is not null")


def greedy(rows: DataFrame, owns: DataFrame, listens: DataFrame, settle: int = SETTLE) -> DataFrame:
    """(seq, kept) for each row of ``rows`` (seq), by the sequential rule.

    ``owns`` and ``listens`` are (key, seq): a row falls to the earliest survivor before
    it that owns a key it listens to, and survives where there is none.  A key costs a
    row for each membership, never the pairs of its rows.  A round decides at least the
    first open row of each chain; once at most ``settle`` memberships are open, one task
    decides the rest in order.  There is no last round, so chains of any length end.
    """
    owns, listens = (x.where("key is not null and seq is not null").distinct().checkpoint() for x in (owns, listens))
    asking = listens.select("seq").distinct()
    free = rows.select("seq").join(asking, "seq", "left_anti")
    parts = [free.select("seq", F.col("seq").alias("kept"))]
    owners = owns.join(free, "seq", "left_semi").groupBy("key").agg(F.min("seq").alias("owner")).checkpoint()
    owns = owns.join(asking, "seq", "left_semi").checkpoint()
    while not listens.isEmpty():
        if listens.count() + owns.count() <= settle:
            parts.append(_in_order(owns, listens.join(owners, "key", "left")))
            break
        least = owns.groupBy("key").agg(F.min("seq").alias("least"))
        known = listens.join(least, "key", "left").join(owners, "key", "left")
        earlier = lambda c: F.min(F.when(F.col(c) < F.col("seq"), F.col(c)))
        state = known.groupBy("seq").agg(earlier("least").alias("waiting"), earlier("owner").alias("survivor"))
        # A row is decided once no open row could own it before its first survivor does.
        done = state.where("waiting is null or survivor < waiting").select("seq", F.coalesce("survivor", "seq").alias("kept")).checkpoint()
        parts.append(done)
        if len(parts) > 16:
            parts = [reduce(DataFrame.unionByName, parts).checkpoint()]
        fresh = owns.join(done.where("seq = kept"), "seq", "left_semi").select("key", F.col("seq").alias("owner"))
        owners = owners.unionByName(fresh).groupBy("key").agg(F.min("owner").alias("owner")).checkpoint()
        owns, listens = (x.join(done, "seq", "left_anti").checkpoint() for x in (owns, listens))
    return reduce(DataFrame.unionByName, parts)


def _in_order(owns: DataFrame, listens: DataFrame) -> DataFrame:
    """The rule as a loop over (key, seq) and (key, seq, owner or null), in one task."""
    kind = listens.schema["seq"].dataType.simpleString()

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        known = frame[frame["known"]]
        owners = dict(zip(known["key"], known["owner"], strict=True))
        own = frame[frame["owning"]].groupby("seq")["key"].agg(list).to_dict()
        kept = []
        for seq, keys in frame[~frame["owning"]].groupby("seq")["key"]:
            owner = min((owners[k] for k in keys if k in owners and owners[k] < seq), default=seq)
            kept.append((seq, owner))
            if owner == seq:
                for k in own.get(seq, ()):
                    owners[k] = min(seq, owners.get(k, seq))
        return pd.DataFrame(kept, columns=["seq", "kept"])

    # No nulls: pandas would hold large integers beside them as floats.
    asked = listens.select("key", "seq", F.coalesce("owner", "seq").alias("owner"), F.col("owner").isNotNull().alias("known"), F.lit(False).alias("owning"))
    both = asked.unionByName(owns.select("key", "seq", F.col("seq").alias("owner"), F.lit(False).alias("known"), F.lit(True).alias("owning")))
    return both.groupBy().applyInPandas(work, f"seq {kind}, kept {kind}")


def greedy_exact_dedup(df: DataFrame, seq: str, keys: list[Column], settle: int = SETTLE) -> DataFrame:
    """``df`` with ``kept_seq``: the row itself, or the earliest survivor that shares a key.

    Null keys match nothing.
    """
    member = key_members(df, seq, keys).checkpoint()
    kept = greedy(df.select(F.col(seq).alias("seq")).distinct(), member, member, settle)
    return df.join(kept.select(F.col("seq").alias(seq), F.col("kept").alias("kept_seq")), seq)


def greedy_from_pairs(rows: DataFrame, pairs: DataFrame, settle: int = SETTLE) -> DataFrame:
    """(seq, kept): the sequential rule over a static pair table (lo, hi), lo < hi."""
    owns = pairs.select(F.col("lo").alias("key"), F.col("lo").alias("seq"))
    return greedy(rows, owns, pairs.select(F.col("lo").alias("key"), F.col("hi").alias("seq")), settle)


def greedy_fuzzy_dedup(df: DataFrame, seq: str, title: Column, doi: Column, authors: Column, least: float = 0.92, settle: int = SETTLE) -> DataFrame:
    """(seq, kept): rows match by equal DOIs, or by similar titles and an author in common.

    A DOI is a key, and so is a title of an author; a row listens to the similar titles
    of its authors as well.  Titles are compared once for each author, however many rows
    bear them, and only within lengths that allow the ratio, which takes the later title
    first.
    """
    names = F.array_distinct(F.transform(F.coalesce(authors, F.array().cast("array<string>")), casefold))
    slim = df.select(F.col(seq).alias("seq"), title_key(title).alias("t"), normal_doi(doi).alias("d"), names.alias("a")).checkpoint()
    key = lambda t: F.concat(F.lit("t:"), F.md5(F.concat_ws("\0", "a", t)))
    titled = slim.select("seq", "t", F.explode("a").alias("a")).where("a is not null and t is not null").checkpoint()
    own = titled.select(key("t").alias("key"), "seq").unionByName(slim.where("d is not null").select(F.concat(F.lit("doi:"), "d").alias("key"), "seq"))
    near = titled.join(_near_titles(titled.groupBy("a", "t").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")), least), ["a", "t"]).select(key("t2").alias("key"), "seq")
    return greedy(slim.select("seq").distinct(), own, own.unionByName(near), settle)


def _near_titles(titles: DataFrame, least: float) -> DataFrame:
    """(a, t, t2): other titles of an author whose ratio with ``t`` is ``least`` or more.

    ``lo`` and ``hi`` are the first and last row of a title and author: only titles with
    a row before the last one of ``t`` can be listened to, so others aren't compared.
    Lengths of such titles differ by a factor of (2 - least) / least at most: they lie in
    the same band of lengths, or in the next one.

    The titles of an author and band are dealt into cells of some ``CELL_TITLES`` or
    ``CELL_CHARS``, and two cells meet as one row: what travels are cells and matches, never all pairs, and
    the cells of one author are spread over all tasks.
    """
    width = math.log((2 - least) / least) + 1e-9
    banded = titles.where("t <> '' and lo is not null").withColumn("band", F.floor(F.log(F.char_length("t").cast("double")) / width)).checkpoint()
    cut = F.greatest(F.ceil(F.count(F.lit(1)) / CELL_TITLES), F.ceil(F.sum(F.char_length("t")) / CELL_CHARS))
    crowded = banded.groupBy("a", "band").agg(cut.alias("cells")).where("cells > 1")
    dealt = banded.join(crowded, ["a", "band"], "left").withColumn("cell", F.pmod(F.xxhash64("t"), F.coalesce("cells", F.lit(1))))
    cells = dealt.groupBy("a", "band", "cell").agg(F.collect_list(F.struct("t", "lo", "hi")).alias("own"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).checkpoint()
    right = cells.select("a", "band", F.col("cell").alias("cell2"), F.col("own").alias("own2"), F.col("lo").alias("lo2"))
    left = cells.select("a", "cell", "own", "hi", F.col("band").alias("of"), F.explode(F.array(*[F.col("band") + n for n in (-1, 0, 1)])).alias("band"))
    alone = (F.col("of") == F.col("band")) & (F.col("cell") == F.col("cell2")) & (F.size("own") == 1)
    tasks = int(titles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = left.join(right, ["a", "band"]).where(~alone & (F.col("lo2") < F.col("hi"))).repartition(tasks, "a", "band", "of", "cell", "cell2")
    places = near_places(F.col("own.t"), F.col("own.hi"), F.col("own2.t"), F.col("own2.lo"), least)
    found = met.select("a", "own", "own2", F.explode(places).alias("at"))
    return found.select("a", F.col("own")[F.shiftright("at", 32).cast("int")]["t"].alias("t"), F.col("own2")[F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")]["t"].alias("t2"))


def best_match(left: DataFrame, right: DataFrame, block: str, least: float, left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id, score): for each left row the other right row of its block whose
    ``forms`` are most alike, the least id on ties.

    A score depends on the forms' different words alone, so each two different lists of
    forms are scored once for a block, however many rows bear them; of the rows of a
    list, the two least ids are enough.
    """
    canon = F.array_sort(F.array_distinct(F.transform("forms", lambda f: F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(f, " "), lambda w: w != ""))), " "))))
    left = left.select(F.col(left_id).alias("__l"), F.col(block).alias("__b"), canon.alias("__f"))
    right = right.select(F.col(right_id).alias("__r"), F.col(block).alias("__b"), canon.alias("__f"))
    firsts = right.groupBy("__b", "__f").agg(F.min("__r").alias("__first")).checkpoint()
    seconds = right.join(firsts, ["__b", "__f"]).where(F.col("__r") > F.col("__first")).groupBy("__b", "__f").agg(F.min("__r").alias("__second"))
    asked = left.select("__b", "__f").distinct()
    pairs = asked.join(firsts.select("__b", F.col("__f").alias("__g"), F.col("__first").alias("__r")), "__b").where((F.col("__f") != F.col("__g")) & _may_reach(F.col("__f"), F.col("__g"), least))
    score = best_form_score(F.col("__f"), F.col("__g"))
    scored = pairs.select("__b", "__f", "__r", score.alias("score")).where(F.col("score") >= least)
    order = Window.partitionBy("__b", "__f").orderBy(F.desc("score"), "__r")
    others = scored.withColumn("__rn", F.row_number().over(order)).where("__rn = 1").select("__b", "__f", F.struct((-F.col("score")).alias("s"), F.col("__r").alias("r")).alias("__other"))
    whole = left.join(firsts, ["__b", "__f"], "left").join(seconds, ["__b", "__f"], "left").join(others, ["__b", "__f"], "left")
    twin = F.when(F.exists("__f", lambda f: f != "") & (F.lit(1.0) >= least), F.when(F.col("__first") != F.col("__l"), F.col("__first")).otherwise(F.col("__second")))
    own = F.when(twin.isNotNull(), F.struct(F.lit(-1.0).alias("s"), twin.alias("r")))
    found = whole.select("__l", F.least(own, "__other").alias("__top")).where("__top is not null")
    return found.select(F.col("__l").alias(left_id), F.col("__top.r").alias(right_id), (-F.col("__top.s")).alias("score"))


def _may_reach(f: Column, g: Column, least: float) -> Column:
    """Forms with a word in common, or of lengths that allow a score of ``least``."""
    words = lambda x: F.split(F.array_join(x, " "), " ")
    return F.arrays_overlap(words(f), words(g)) | F.exists(f, lambda x: F.exists(g, lambda y: ratio_bound(x, y) >= least))


def title_score(artifact: Column, candidate: Column) -> Column:
    """Ratio of titles, lifted where one contains the other."""
    ratio = sequence_ratio(artifact, candidate)
    held = F.contains(candidate, artifact) | F.contains(artifact, candidate)
    return F.when((artifact == "") | (candidate == ""), 0.0).when(held, F.greatest(ratio, F.lit(0.95))).otherwise(ratio)


class _Titles:
    """Artefact titles whose common subsequences with a text are found together.

    Each has its bits in one integer, with a bit between that stops the carry.
    """

    def __init__(self, titles: list[str]):
        self.lengths = np.array([len(t) for t in titles])
        self.starts = np.cumsum(self.lengths + 1) - (self.lengths + 1)
        places: dict[str, list[int]] = {}
        for start, title in zip(self.starts.tolist(), titles, strict=True):
            for k, c in enumerate(title):
                places.setdefault(c, []).append(start + k)
        self.size = int((self.lengths + 1).sum())
        self.masks = {c: self._bits(at) for c, at in places.items()}
        self.full = 0
        for mask in self.masks.values():
            self.full |= mask

    def _bits(self, at: list[int]) -> int:
        bits = np.zeros(self.size, np.uint8)
        bits[at] = 1
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    def common(self, text: str) -> np.ndarray:
        """Length of the longest common subsequence of each title and the text."""
        state = self.full
        for c in text:
            hit = state & self.masks.get(c, 0)
            state = ((state + hit) | (state - hit)) & self.full
        left = np.unpackbits(np.frombuffer(state.to_bytes(self.size // 8 + 1, "little"), np.uint8), bitorder="little")[: self.size]
        return self.lengths - np.add.reduceat(left, self.starts, dtype=np.int64)


def _groups(asked: Sequence[tuple[object, str]]) -> list[list[tuple[object, str]]]:
    return [list(g) for g in batched(sorted(asked, key=lambda x: len(x[1])), TOGETHER)]


def _within(own: _Titles, text: str, least: float) -> np.ndarray:
    """Which titles can have a ratio of ``least`` with the text."""
    total = own.lengths + len(text)
    near = 2.0 * np.minimum(own.lengths, len(text)) / total >= least
    return 2.0 * own.common(text) / total >= least if near.any() else near


def best_articles(artifacts: DataFrame, articles: DataFrame, least: float = 0.74) -> DataFrame:
    """(artifact, doc_id, score): for each artefact the best of all articles by ``title_score``.

    Rows: (artifact, a) and (doc_id, c); the first article wins a tie.  The matched
    characters of a ratio are a common subsequence, so the longest one bounds the ratio:
    only pairs whose bound is under ``least`` are left out.
    """
    different = articles.where("c <> ''").groupBy("c").agg(F.min("doc_id").alias("doc_id"))
    kinds = [artifacts.schema["artifact"].dataType.simpleString(), articles.schema["doc_id"].dataType.simpleString()]
    schema = f"artifact {kinds[0]}, doc_id {kinds[1]}, score double"

    def search(asked: list[tuple[object, str]]) -> DataFrame:
        groups = _groups(asked)

        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            titles = [_Titles([t for _, t in g]) for g in groups]
            best: dict[object, tuple[float, object]] = {}
            for frame in frames:
                for c, doc_id in zip(frame["c"], frame["doc_id"].tolist(), strict=True):
                    for group, own in zip(groups, titles, strict=True):
                        for (key, a), close in zip(group, _within(own, c, least).tolist(), strict=True):
                            held = a in c or c in a
                            if not (close or held):
                                continue
                            score = SequenceMatcher(None, a, c).ratio()
                            score = max(score, 0.95) if held else score
                            known = best.get(key)
                            if score >= least and (known is None or (-score, doc_id) < (-known[0], known[1])):
                                best[key] = (score, doc_id)
            yield pd.DataFrame([(k, d, s) for k, (s, d) in best.items()], columns=["artifact", "doc_id", "score"])

        return different.mapInPandas(work, schema)

    found = None
    rows = ((r.artifact, r.a) for r in artifacts.where("a <> ''").select("artifact", "a").toLocalIterator())
    for asked in batched(rows, ASKED):
        part = search(list(asked))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return artifacts.sparkSession.createDataFrame([], schema)
    top = F.max_by(F.struct("doc_id", "score"), F.struct("score", (-F.col("doc_id")).alias("d")))
    return found.groupBy("artifact").agg(top.alias("top")).select("artifact", "top.doc_id", "top.score")


def prior_edition(rows: DataFrame, history: DataFrame, month: str, key: str) -> DataFrame:
    """First row with an equal key among other months, best score first, then title."""
    others = history.where(F.col("target_month") != month).select(F.col(key).alias("__k"), F.col("title").alias("prior_title"), F.col("target_month").alias("prior_month"), F.col("score").alias("prior_score"))
    order = Window.partitionBy("__k").orderBy(F.desc_nulls_last("prior_score"), "prior_title", "prior_month")
    first = others.where("__k is not null").withColumn("__rn", F.row_number().over(order)).where("__rn = 1").drop("__rn")
    return rows.join(first, rows[key] == first["__k"], "left").drop("__k")


def title_pairs(current: DataFrame, previous: DataFrame, least: float) -> DataFrame:
    """(a, c, ratio) of all titles ``a`` and ``c`` whose ratio is ``least`` or more."""
    schema, different = "a string, c string, ratio double", previous.where("c <> ''").select("c").distinct()

    def search(asked: Sequence[str]) -> DataFrame:
        groups = _groups([(a, a) for a in asked])

        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            titles = [_Titles([t for _, t in g]) for g in groups]
            for frame in frames:
                close = [(a, c) for c in frame["c"] for group, own in zip(groups, titles, strict=True) for k in np.flatnonzero(_within(own, c, least)).tolist() for a in [group[k][1]]]
                found = [(a, c, ratio) for a, c in close if (ratio := SequenceMatcher(None, a, c).ratio()) >= least]
                yield pd.DataFrame(found, columns=["a", "c", "ratio"])

        return different.mapInPandas(work, schema)

    out = None
    for asked in batched((r.a for r in current.where("a <> ''").select("a").distinct().toLocalIterator()), ASKED):
        part = search(asked)
        out = part if out is None else out.unionByName(part)
    return current.sparkSession.createDataFrame([], schema) if out is None else out


def prior_editions(rows: DataFrame, history: DataFrame, month: str, seq: str = "seq", high: float = 0.94, medium: float = 0.88) -> DataFrame:
    """``rows`` with their first match among other months, best score first, then title.

    Rows match by equal DOIs (confidence high), or by a title ratio of ``high`` or
    ``medium``.  ``history``: title, target_month, score and, where there is one, doi.
    """
    doi = normal_doi(F.col("doi")) if "doi" in history.columns else F.lit(None).cast("string")
    others = history.where((F.col("target_month") != month) & (F.col("target_month") != "")).select(title_key(F.col("title")).alias("c"), doi.alias("d"), F.col("title").alias("prior_title"), F.col("target_month").alias("prior_month"), F.col("score").alias("prior_score"))
    own = rows.select(F.col(seq).alias("__seq"), title_key(F.col("title")).alias("a"), normal_doi(F.col("doi")).alias("d")).checkpoint()
    prior = ["__seq", "prior_title", "prior_month", "prior_score", "prior_confidence"]
    by_doi = own.drop("a").join(others.where("d is not null"), "d").withColumn("prior_confidence", F.lit("high"))
    grade = F.when(F.col("ratio") >= high, "high").otherwise("medium")
    by_title = own.drop("d").join(title_pairs(own, others, medium), "a").join(others, "c").withColumn("prior_confidence", grade)
    order = Window.partitionBy("__seq").orderBy(F.desc_nulls_last("prior_score"), "prior_title", "prior_month", "prior_confidence")
    first = by_doi.select(*prior).unionByName(by_title.select(*prior)).withColumn("__rn", F.row_number().over(order)).where("__rn = 1").drop("__rn")
    return rows.join(first, rows[seq] == first["__seq"], "left").drop("__seq")


# --- entity resolution -------------------------------------------------------------
#: Answers by names that a type keeps at once.
ANSWERS = 100_000
RESOLVE_SCHEMA = "id string, type string, outcome string, target string, score double"


def resolve_entities(new: DataFrame, merge_at: float = 0.92, review_at: float = 0.78) -> DataFrame:
    """Incremental resolution within each type, in order of ``seq``.

    Rows: id, type, seq, name, aliases, known (an existing node) and, where there are
    any, the name's ``vector``.  A new row is compared with all nodes before it, whose
    names grow by the rows merged into them: at ``merge_at`` it merges, from
    ``review_at`` it is created and marked, else created.  A score is the best
    similarity of names or, if higher, the cosine of vectors.  Equal ids match at once.
    The order makes this sequential within a type: its rows pass one task in that order,
    which holds the nodes and never the rows.
    """
    if has_vectors := "vector" in new.columns:
        new = new.withColumn("__width", F.max(F.greatest(F.size("vector"), F.lit(0))).over(Window.partitionBy("type")))
    placed = new.repartition(F.col("type")).sortWithinPartitions("type", F.desc_nulls_last("known"), F.asc_nulls_last("seq"))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, types = None, None
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                if types is None or row.type != last:
                    last, types = row.type, _Resolver(int(row[-1] or 0) if has_vectors else 0, merge_at, review_at)
                rows.append((row.id, row.type, *types.resolve(row, row.vector if has_vectors else None)))
            yield pd.DataFrame(rows, columns=["id", "type", "outcome", "target", "score"])

    return placed.mapInPandas(work, RESOLVE_SCHEMA)


class _Resolver:
    """The nodes of one type.

    What counts for a name is the first node of each different form, however many nodes
    bear it.  Forms are scored from the highest bound down until none can reach the best
    score, so no match is lost; an answer holds until a form or its first node is new.
    """

    def __init__(self, width: int, merge_at: float, review_at: float):
        self.merge_at, self.review_at, self.width = merge_at, review_at, width
        self.ids: list[str] = []
        self.forms_of: list[tuple[int, ...]] = []
        self.at: dict[str, int] = {}
        self.number: dict[str, int] = {}
        self.names: list[str] = []
        # Of each form: its first node, the letters of its different words, and their number.
        self.first, self.letters, self.lengths = np.zeros(64, np.int64), np.zeros((64, len(LETTERS)), np.int32), np.zeros(64, np.int64)
        self.by_word: dict[str, list[int]] = {}
        self.answers: dict[tuple[str, ...], tuple[int, float]] = {}
        self.units = np.zeros((64, width))

    def add(self, node: int, forms: Sequence[str]) -> None:
        mine = []
        for form in forms:
            g = self.number.setdefault(form, len(self.names))
            if g == len(self.names):
                self.names.append(form)
                if g == len(self.first):
                    self.first, self.letters, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.letters, self.lengths))
                self.first[g] = node
                self.letters[g], self.lengths[g] = _letters(form)
                for word in set(form.split()):
                    self.by_word.setdefault(word, []).append(g)
                self.answers.clear()
            elif node < self.first[g]:
                self.first[g] = node
                self.answers.clear()
            if g not in self.forms_of[node]:
                mine.append(g)
        if mine:
            self.forms_of[node] += tuple(mine)

    def by_forms(self, forms: tuple[str, ...]) -> tuple[int, float]:
        """The first node of the top score by names, and the score; -1 for a score of 0."""
        if (known := self.answers.get(forms)) is not None:
            return known
        n = len(self.names)
        bound = np.zeros(n)
        for form in forms:
            own, length = _letters(form)
            # Names without a common word can't share more letters than both have.
            np.maximum(bound, 200.0 * np.minimum(self.letters[:n], own).sum(axis=1) / (self.lengths[:n] + length), out=bound)
        bound[sorted({g for f in forms for w in f.split() for g in self.by_word.get(w, ())})] = 100.0
        bound /= 100.0
        best, top = -1, 0.0
        for g in np.lexsort((self.first[:n], -bound)).tolist():
            # Equal bounds are in order of nodes, so none after a full score can win.
            if bound[g] < top or bound[g] == 0.0 or top >= 1.0:
                break
            score, node = _best_score(forms, [self.names[g]]) / 100.0, int(self.first[g])
            if score > top or (score == top > 0.0 and node < best):
                best, top = node, score
        if len(self.answers) >= ANSWERS:
            self.answers.clear()
        self.answers[forms] = best, top
        return best, top

    def search(self, forms: tuple[str, ...], unit: np.ndarray) -> tuple[int, float]:
        best, top = self.by_forms(forms)
        if unit.any() and self.ids:
            near = np.clip(self.units[: len(self.ids)] @ unit, 0.0, 1.0)
            node, score = int(near.argmax()), float(near.max())
            if score > top or (score == top > 0.0 and node < best):
                best, top = node, score
        return best, top

    def resolve(self, row: tuple, vector: np.ndarray | None) -> tuple[str, str, float]:
        """(outcome, target, score) of the next row."""
        forms = tuple(dict.fromkeys(f for f in (_name_key(x) for x in [row.name, *(row.aliases if row.aliases is not None else [])]) if f))
        unit, best, top = _unit(vector, self.width), -1, 0.0
        if not row.known:
            best, top = (self.at[row.id], 1.0) if row.id in self.at else self.search(forms, unit)
        if not row.known and best >= 0 and top >= self.merge_at:
            self.add(best, forms)
            return "merge", self.ids[best], top
        node = len(self.ids)
        if self.width:
            if node == len(self.units):
                self.units = np.concatenate([self.units, np.zeros_like(self.units)])
            self.units[node] = unit
        self.ids.append(row.id)
        self.forms_of.append(())
        self.at.setdefault(row.id, node)
        self.add(node, forms)
        outcome = "known" if row.known else ("review" if top >= self.review_at else "create")
        return outcome, self.ids[best] if outcome == "review" else row.id, top


def _best_score(forms: list[str], others: list[str]) -> float:
    best = 0.0
    for f in forms:
        for g in others:
            best = max(best, token_set(f, g))
            if best >= 100.0:
                return best
    return best


LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


def _letters(form: str) -> tuple[list[int], int]:
    """How often each letter occurs in a name's different words, and their length."""
    words = " ".join(set(form.split()))
    seen = Counter(words)
    return [seen[c] for c in LETTERS], len(words)


def _unit(vector: np.ndarray | None, size: int) -> np.ndarray:
    """A vector of length 1; zeros where there is none or it has no direction."""
    v = np.zeros(size) if vector is None or len(vector) != size else np.asarray(vector, np.float64)
    norm = np.linalg.norm(v)
    return v / norm if norm and np.isfinite(norm) else np.zeros(size)


def _name_key(name: str | None) -> str:
    low = "".join(c if c.isascii() and c.isalnum() else " " for c in (name or "").lower())
    return " ".join(low.split())
