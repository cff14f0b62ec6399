import itertools
import random

import pytest

from folioflux.llm import toxicity
from folioflux.llm.toxicity import LEVELS, NEGATED, REACH, REPORTED, TARGETED
from folioflux.llm.transducers import Transducer, compose

TAGS = [("other", 0, 0), ("target", 0, 0), ("negation", 0, 0), ("report", 0, 0), ("insult", LEVELS, 0), ("insult", 5, 0), ("threat", LEVELS, 0)]


def _through(parts, symbols):
    """Best weight over every path of one machine after the other, without composition."""
    if not parts:
        return 0.0
    return max((weight + _through(parts[1:], out) for out, weight in parts[0].paths(symbols)), default=float("-inf"))


def _by_positions(tags):
    """The grammar's definition: every choice of threats that count, by where tags stand."""
    at = {k: [n for n, t in enumerate(tags) if t[0] == k] for k in ("target", "negation", "report")}
    near = lambda kind, n: any(0 < n - m <= REACH[kind] for m in at[kind])
    total = 0.0
    for n, (kind, level, _) in enumerate(tags):
        weight = level / LEVELS * (NEGATED if near("negation", n) else 1) * (REPORTED if near("report", n) else 1)
        if kind == "insult":
            total += weight * (TARGETED if near("target", n) else 1)
        if kind == "threat" and (near("target", n) or any(0 < m - n <= REACH["target"] for m in at["target"])):
            total += weight
    return total


def test_composition_equals_the_parts_and_the_definition():
    rng, parts, whole = random.Random(7), toxicity.parts(), toxicity.machine()
    cases = [list(c) for c in itertools.product(TAGS, repeat=3)] + [[rng.choice(TAGS) for _ in range(rng.randrange(4, 9))] for _ in range(300)]
    for tags in cases:
        assert whole.best(tags) == pytest.approx(_by_positions(tags))
        assert whole.best(tags) == pytest.approx(max(0.0, _through(parts, tags)))
    for _ in range(300):
        tags = [rng.choice(TAGS[:1] * 8 + TAGS) for _ in range(rng.randrange(9, 60))]
        assert whole.best(tags) == pytest.approx(_by_positions(tags))


def test_composition_of_random_machines():
    rng = random.Random(8)

    def machine(states, reads, writes):
        out = Transducer()
        for _ in range(states - 1):
            out.state(rng.random() < 0.6)
        for _ in range(states * 6):
            out.add(rng.randrange(states), rng.choice(reads), rng.choice(writes), rng.randrange(5), rng.randrange(states))
        return out

    for _ in range(60):
        a, b = machine(4, "xy", "pq"), machine(3, "pq", "uv")
        both = compose(a, b)
        for n in range(5):
            word = [rng.choice("xy") for _ in range(n)]
            assert both.best(word) == max([w + v for out, w in a.paths(word) for _, v in b.paths(out)], default=0.0)


def test_a_word_of_several_readings_takes_the_best():
    g = toxicity.fit([], [])
    assert g.raw("kill hurt you") == pytest.approx(2.0)
    assert g.raw("kill the process and then much later in the day I greet you") == 0.0
    assert g.raw("You are an IDIOT. You are no idiot!") == pytest.approx(TARGETED * (1 + NEGATED))
    assert g.raw("") == g.raw("a b c") == 0.0
