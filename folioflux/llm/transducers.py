"""Weighted finite-state transducers over the (max, +) semiring.

An arc reads one symbol, writes one, adds its weight and moves on; a state may have
several arcs for a symbol.  Composition feeds what one machine writes to the next.  The
weight of a sequence is that of its best path which ends in a final state.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterator, Sequence
from dataclasses import dataclass, field

Arc = tuple[Hashable, float, int]


@dataclass
class Transducer:
    """States are numbers, 0 the first; ``arcs[state][symbol]`` lists (written, weight, next)."""

    arcs: list[dict[Hashable, list[Arc]]] = field(default_factory=lambda: [{}])
    final: set[int] = field(default_factory=lambda: {0})

    def state(self, final: bool = True) -> int:
        self.arcs.append({})
        if final:
            self.final.add(len(self.arcs) - 1)
        return len(self.arcs) - 1

    def add(self, state: int, read: Hashable, written: Hashable, weight: float, onward: int) -> None:
        self.arcs[state].setdefault(read, []).append((written, weight, onward))

    def written(self) -> set[Hashable]:
        return {w for own in self.arcs for arcs in own.values() for w, _, _ in arcs}

    def paths(self, symbols: Sequence[Hashable]) -> Iterator[tuple[list[Hashable], float]]:
        """Every complete path: what it writes and its weight."""
        open_paths: list[tuple[list[Hashable], float, int]] = [([], 0.0, 0)]
        for symbol in symbols:
            open_paths = [([*out, w], total + weight, onward) for out, total, at in open_paths for w, weight, onward in self.arcs[at].get(symbol, ())]
        for out, total, at in open_paths:
            if at in self.final:
                yield out, total

    def best(self, symbols: Sequence[Hashable]) -> float:
        """Weight of the best complete path (Viterbi); 0 where there is none."""
        front = {0: 0.0}
        for symbol in symbols:
            reached: dict[int, float] = {}
            for at, total in front.items():
                for _, weight, onward in self.arcs[at].get(symbol, ()):
                    if total + weight > reached.get(onward, -1.0):
                        reached[onward] = total + weight
            front = reached
        return max((total for at, total in front.items() if at in self.final), default=0.0)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The machine that reads as ``first`` does and writes as ``second`` does.

    Only pairs of states that can be reached are built.
    """
    out = Transducer()
    number = {(0, 0): 0}
    out.final = {0} if 0 in first.final and 0 in second.final else set()
    waiting = [(0, 0)]
    while waiting:
        a, b = waiting.pop()
        for read, arcs in first.arcs[a].items():
            for between, weight, a_next in arcs:
                for written, more, b_next in second.arcs[b].get(between, ()):
                    key = (a_next, b_next)
                    if key not in number:
                        number[key] = out.state(a_next in first.final and b_next in second.final)
                        waiting.append(key)
                    out.add(number[a, b], read, written, weight + more, number[key])
    return out
