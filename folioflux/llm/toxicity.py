"""Toxicity by a weighted finite-state pattern grammar over clauses.

A word's tags come from tries: insults and threats by stem (with learned weights),
targets, negations and reports by whole word.  Five transducers work on the tags of a
clause.  Three remember that a negation, a report or a target has just been read and
mark the tags in its reach.  The threat transducer lets a threat count where a target is
open, or takes it on the condition that a target follows within reach: such a path dies
without one.  The insult transducer weighs insults by their marks.  They are composed
into one machine, whose states thus say what is open; a clause's weight is that of its
best path, a text's score the calibrated weight of its clauses, so an isolated word
counts by its clause only.

Stems are learned: a stem is a short word prefix that labelled toxic texts hold and
clean ones do not.  They come from a bounded sample of labelled texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflux.llm.labels import fetch_sample, known_labels, remainder
from folioflux.llm.rows import TextBlock, append_score, families
from folioflux.llm.transducers import Transducer, compose

FOLDS, HELD = 5, 0
#: Bound of the labelled sample that reaches the driver.
SAMPLE_BYTES, SAMPLE_ROWS = 20 << 20, 3000
THRESHOLD = 0.5
STEM_MIN, STEM_MAX = 3, 12
MAX_STEMS = 400

# Function words of the grammar, in English, German, French and Spanish.
TARGETS = "you your yours u ur he she they him her them his their du dich dir ihr euch dein deine euer tu te toi vous ton ta votre usted ustedes tú ti te vosotros".split()
NEGATIONS = "not no never isn't aren't wasn't don't doesn't nicht kein keine nie niemals ne pas jamais nunca jamás".split()
REPORTS = "said says say told called calls wrote quoted reported alleged allegedly sagte sagt nannte schrieb dit disait appelé écrit dijo dice llamó escribió".split()
#: Threats with a target need a verb of harm, whatever labels say.
THREATS = "kill hurt destroy punish beat shoot stab umbringen töten verletzen tuer frapper blesser matar golpear herir".split()
SEED_INSULTS = "idiot moron stupid worthless pathetic disgusting".split()

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;\n]")
_END = re.compile(r"[.!?;\n]")
_STOP = frozenset(".!?;\n")
NEGATED, REPORTED, TARGETED = 0.3, 0.4, 1.25
#: Words for which an opened negation, report or target stays open.
REACH = {"negation": 3, "report": 8, "target": 6}
#: Words whose tags a worker remembers.
KEPT_WORDS = 50_000
#: Weights of stems in the machine's alphabet are so many parts of 1.
LEVELS = 16

# A tag is (kind, level, marks); marks say what is open where it stands.
IN_NEGATION, IN_REPORT, AT_TARGET = 1, 2, 4
PLAIN = ("other", "negation", "report", "target")


def alphabet(marks: Sequence[int] = (0,)) -> list[tuple[str, int, int]]:
    """All tags with any of some marks."""
    weighed = [(kind, level) for kind in ("insult", "threat") for level in range(1, LEVELS + 1)]
    return [(kind, level, m) for kind, level in [*((k, 0) for k in PLAIN), *weighed] for m in marks]


def opener(kind: str, mark: int, marks: Sequence[int]) -> Transducer:
    """Adds ``mark`` to the tags that follow a tag of ``kind`` within its reach."""
    out = Transducer()
    for _ in range(REACH[kind]):
        out.state()
    for left in range(REACH[kind] + 1):
        for tag in alphabet(marks):
            if tag[0] == kind:
                out.add(left, tag, tag, 0.0, REACH[kind])
            else:
                out.add(left, tag, (*tag[:2], tag[2] | mark) if left else tag, 0.0, max(0, left - 1))
    return out


def factor(marks: int) -> float:
    return (NEGATED if marks & IN_NEGATION else 1.0) * (REPORTED if marks & IN_REPORT else 1.0)


def threats_machine(marks: Sequence[int]) -> Transducer:
    """Threats weigh where a target is open or follows; other tags pass.

    State k > 0 owes a target within k words, so the machine ends in state 0 only.
    """
    reach = REACH["target"]
    out = Transducer()
    for _ in range(reach):
        out.state(final=False)
    for owed in range(reach + 1):
        later = owed - 1 if owed else 0
        dead = owed == 1
        for tag in alphabet(marks):
            kind, level, m = tag
            if kind == "target":
                out.add(owed, tag, tag, 0.0, 0)
            elif dead:
                continue
            elif kind != "threat":
                out.add(owed, tag, tag, 0.0, later)
            else:
                weight = level / LEVELS * factor(m)
                if m & AT_TARGET:
                    out.add(owed, tag, ("other", 0, m), weight, later)
                else:
                    out.add(owed, tag, ("other", 0, m), 0.0, later)
                    out.add(owed, tag, ("other", 0, m), weight, later or reach)
    return out


def insults_machine(marks: Sequence[int]) -> Transducer:
    out = Transducer()
    for tag in alphabet(marks):
        kind, level, m = tag
        weight = level / LEVELS * factor(m) * (TARGETED if m & AT_TARGET else 1.0) if kind == "insult" else 0.0
        out.add(0, tag, ("other", 0, 0), weight, 0)
    return out


def parts() -> list[Transducer]:
    """The five transducers in the order of their composition."""
    return [
        opener("negation", IN_NEGATION, (0,)),
        opener("report", IN_REPORT, range(2)),
        opener("target", AT_TARGET, range(4)),
        threats_machine(range(8)),
        insults_machine(range(8)),
    ]


def machine() -> Transducer:
    return reduce(compose, parts())


@dataclass
class StemAutomaton:
    """A trie over stems; reading a word gives the weight of its longest stem."""

    arcs: list[dict[str, int]] = field(default_factory=lambda: [{}])
    weight: list[float] = field(default_factory=lambda: [0.0])
    pattern_: re.Pattern | None = None

    def add(self, stem: str, weight: float) -> None:
        at = 0
        for letter in stem:
            step = self.arcs[at].get(letter)
            if step is None:
                step = len(self.arcs)
                self.arcs[at][letter] = step
                self.arcs.append({})
                self.weight.append(0.0)
            at = step
        self.weight[at] = weight

    def read(self, word: str) -> float:
        at, best = 0, 0.0
        for letter in word:
            nxt = self.arcs[at].get(letter)
            if nxt is None:
                break
            at = nxt
            if self.weight[at]:
                best = self.weight[at]
        return best

    def pattern(self) -> re.Pattern | None:
        """Words that some stem begins, as one regular expression."""
        stems: list[str] = []

        def walk(at: int, so_far: str) -> None:
            if self.weight[at]:
                stems.append(so_far)
                return
            for letter, nxt in sorted(self.arcs[at].items()):
                walk(nxt, so_far + letter)

        walk(0, "")
        return re.compile(r"(?<![^\W\d_])(?:" + "|".join(map(re.escape, stems)) + ")") if stems else None


@dataclass
class Grammar:
    insults: StemAutomaton
    threats: StemAutomaton
    scale: float = 1.0
    bias: float = -3.0
    machine: Transducer = field(default_factory=machine)
    tagged: dict[str, list[tuple[str, int, int]]] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"tagged": {}}

    def tags(self, word: str) -> list[tuple[str, int, int]]:
        """Every reading of a word; one that is nothing else is an ``other``."""
        found = [(kind, 0, 0) for kind, own in (("target", _TARGETS), ("negation", _NEGATIONS), ("report", _REPORTS)) if word in own]
        for kind, stems in (("insult", self.insults), ("threat", self.threats)):
            if weight := stems.read(word):
                found.append((kind, min(LEVELS, max(1, round(weight * LEVELS))), 0))
        return found or [("other", 0, 0)]

    def clause_weights(self, text: str) -> list[float]:
        """Weight of each clause that an insult or threat matches.

        Only clauses around a stem are read in full; no other clause can match.
        """
        out: list[float] = []
        low, done = text.lower(), 0
        patterns = [p for p in (self.insults.pattern_, self.threats.pattern_) if p]
        spots = sorted({m.start() for p in patterns for m in p.finditer(low)})
        for spot in spots:
            if spot < done:
                continue
            start = max(max(low.rfind(c, done, spot) for c in _STOP) + 1, done)
            end = _END.search(low, spot)
            stop = end.start() if end else len(low)
            weight = self._clause(_WORD.findall(low, start, stop))
            if weight:
                out.append(weight)
            done = stop
        return out

    def _clause(self, words: list[str]) -> float:
        """Weight of the best path over all readings of a clause's words."""
        front, arcs = {0: 0.0}, self.machine.arcs
        for word in words:
            tags = self.tagged.get(word)
            if tags is None:
                if len(self.tagged) >= KEPT_WORDS:
                    self.tagged.clear()
                tags = self.tagged[word] = self.tags(word)
            reached: dict[int, float] = {}
            for at, total in front.items():
                for tag in tags:
                    for _, weight, onward in arcs[at].get(tag, ()):
                        if total + weight > reached.get(onward, -1.0):
                            reached[onward] = total + weight
            front = reached
        return max((total for at, total in front.items() if at in self.machine.final), default=0.0)

    def raw(self, text: str) -> float:
        return sum(self.clause_weights(text))

    def score(self, text: str) -> float:
        z = self.bias + self.scale * math.log1p(self.raw(text))
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z))))

    def scores(self, block: TextBlock) -> np.ndarray:
        return np.array([self.score(block.raw(k).decode("utf-8", "replace")) for k in range(len(block))])


_TARGETS, _NEGATIONS, _REPORTS = frozenset(TARGETS), frozenset(NEGATIONS), frozenset(REPORTS)


def learn_stems(texts: list[str], toxic: list[int]) -> dict[str, float]:
    """Weighted stems: prefixes whose presence marks toxic texts by log odds.

    Of nested prefixes the shortest stays, drawn out as long as nearly all its texts
    agree on the next letter: unseen endings match, other words with its start don't.
    Near copies count once.  A stem must favour toxic texts by odds of e**2.5 and more clearly than the best of
    all stems would by chance (Chernoff's bound times the number of stems, under 1 %).
    """
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
    alike: dict[tuple[int, int], list[str]] = {}
    for text, label, family in zip(texts, toxic, families(texts) if texts else [], strict=True):
        alike.setdefault((label, family), []).append(text)
    size = Counter(label for label, _ in alike)
    rate = size[1] / max(1, len(alike))
    if not 0 < rate < 1:
        return {}
    tried = 0.0
    for wanted in (1, 0):  # clean texts are asked for the stems of toxic ones only
        for (label, _), group in sorted(alike.items()):
            if label != wanted:
                continue
            words = set(_WORD.findall("\n".join(group).lower()))
            stems = {w[:k] for w in words for k in range(STEM_MIN, min(len(w), STEM_MAX) + 1)} | {w for w in words if len(w) <= STEM_MAX}
            seen[label].update(stems if label else stems & seen[1].keys())
        if wanted:
            tried = math.log(100 * max(1, len(seen[1])))
            seen[1] = Counter({s: n for s, n in seen[1].items() if -n * math.log(rate) > tried})
    odds = {}
    for stem, n in seen[1].items():
        clean = seen[0][stem]
        if stem in _STOP or clean * 3 > n:
            continue
        ratio = math.log((n + 0.1) / (size[1] + 1)) - math.log((clean + 0.1) / (size[0] + 1))
        part = n / (n + clean)
        surprise = n * math.log(part / rate) + (clean * math.log((1 - part) / (1 - rate)) if clean else 0.0)
        if ratio > 2.5 and surprise > tried:
            odds[stem] = ratio
    longer: dict[str, list[str]] = {}
    for stem in odds:
        longer.setdefault(stem[:-1], []).append(stem)
    kept: dict[str, float] = {}
    for stem in sorted(odds, key=lambda s: (len(s), s)):
        if not any(stem[:k] in kept for k in range(STEM_MIN, len(stem))):
            kept[stem] = odds[stem]
    for stem in list(kept):
        long = stem
        while nxt := next((w for w in longer.get(long, ()) if seen[1][w] >= 0.9 * seen[1][stem]), None):
            long = nxt
        if long != stem:
            kept[long] = odds.get(long, kept.pop(stem))
            kept.pop(stem, None)
    top = sorted(kept, key=lambda s: (-seen[1][s], s))[:MAX_STEMS]
    return {s: kept[s] for s in top}


def fit(texts: list[str], toxic: list[int]) -> Grammar:
    """Stems, then a two-parameter logistic calibration by Newton steps."""
    insults, threats = StemAutomaton(), StemAutomaton()
    stems = learn_stems(texts, toxic)
    strongest = max(stems.values(), default=1.0)
    for word in SEED_INSULTS:
        if not any(word.startswith(s) for s in stems):
            insults.add(word, 1.0)
    for stem, odds in stems.items():
        insults.add(stem, max(0.2, odds / strongest))
    for word in THREATS:
        threats.add(word, 1.0)
    grammar = _ready(Grammar(insults, threats))
    if len(set(toxic)) < 2:
        return grammar
    x = np.log1p(np.array([grammar.raw(t) for t in texts]))
    y = np.array(toxic, float)
    w = np.array([grammar.bias, grammar.scale])
    design = np.stack([np.ones_like(x), x], axis=1)
    ridge = np.diag([1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + ridge @ w
        hess = (design * (p * (1 - p))[:, None]).T @ design + ridge
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    grammar.bias, grammar.scale = float(w[0]), float(max(w[1], 0.1))
    return grammar


def _ready(grammar: Grammar) -> Grammar:
    grammar.insults.pattern_ = grammar.insults.pattern()
    grammar.threats.pattern_ = grammar.threats.pattern()
    return grammar


def fit_grammar(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held: int = HELD) -> Grammar:
    """Learn from labelled rows outside the held-out fold; without any, the seed words."""
    known = known_labels(labels, "toxic").where("label in (0, 1)")
    return fit(*fetch_sample(docs, known, SAMPLE_BYTES, SAMPLE_ROWS, remainder(folds) != held))


def score_texts(docs: DataFrame, grammar: Grammar, name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the score of each whole text; a null text scores as an empty one."""
    return append_score(docs, docs.sparkSession.sparkContext.broadcast(grammar), name, keep)


def op4_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row; null and empty texts score as texts without matches."""
    scored = score_texts(docs, fit_grammar(docs, labels), keep=["doc_id"])
    return scored.select("doc_id", (remainder(FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the grammar doesn't reject, with their own columns."""
    return score_texts(docs, fit_grammar(docs, labels), "__toxic").where(F.col("__toxic") < THRESHOLD).drop("__toxic")
