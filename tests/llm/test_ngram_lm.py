import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from folioflux.llm import ngram_lm
from folioflux.llm.ngram_lm import FOLDS, HELD, op2_scores, score, train

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def toks(text):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())) + [b"</s>"]


def brute(docs):
    held = {k: zlib.crc32(("" if k is None else str(k)).encode()) % FOLDS == HELD for k, _ in docs}
    c, pairs = Counter(), Counter()
    for k, t in docs:
        if not held[k]:
            w = toks(t)
            c.update(w)
            pairs.update(zip([b"<s>"] + w[:-1], w, strict=True))
    n, v = sum(c.values()), len(c)
    total, kinds, cont = Counter(), defaultdict(Counter), Counter()
    for (a, b), k in pairs.items():
        total[a] += k
        kinds[a][min(k, 3)] += 1
        cont[b] += 1
    d, e = by_formula(pairs), by_formula(cont)
    ct = sum(cont.values())
    free = sum(e[min(x, 3)] for x in cont.values()) / ct
    out = []
    for k, t in docs:
        w = toks(t)
        base = sum(math.log10((c[x] + 1) / (n + 1 * (v + 1))) for x in w)
        s = 0.0
        for a, b in zip([b"<s>"] + w[:-1], w, strict=True):
            p1 = max(cont[b] - e[min(cont[b], 3)], 0) / ct + free / (v + 1)
            g = sum(d[j] * kinds[a][j] for j in (1, 2, 3)) / total[a] if total[a] else 1.0
            s += math.log10((max(pairs[a, b] - d[min(pairs[a, b], 3)], 0) / total[a] if total[a] else 0) + g * p1)
        out.append((k, held[k], len(w), sum(c[x] > 0 for x in w), n, base, s))
    return out


def by_formula(counts):
    """Chen and Goodman's D1, D2, D3+, with the limits that the model sets."""
    n = Counter(counts.values())
    y = n[1] / (n[1] + 2 * n[2]) if n[1] or n[2] else 0.5
    out = [0.0]
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.5
        out.append(min(max(d, 0.05), k - 0.05))
    return out


def _same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(g[:5]) == tuple(w[:5])
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-6)


def test_small_corpus_against_brute_force(spark):
    texts = [None, "", "a", "the cat sat on the mat", "the cat ate the rat", "THE dog\tsat\non the log", "été à la été", "a b a b a b a b c", "the cat sat on the mat", "unknown words here", "x" * 3000 + " y"]
    docs = [(k, t) for k, t in enumerate(texts * 2)] + [(None, "the cat")]
    _same(op2_scores(spark.createDataFrame(docs, "doc_id long, text string")).collect(), brute(docs))


def test_few_maps_are_kept_and_a_lost_shard_is_an_error(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60).cache()
    model = train(df, shard_bytes=1000)
    whole = {r.doc_id: r.score for r in score(df, model).collect()}
    monkeypatch.setattr(ngram_lm, "OPEN_SHARDS", 3)
    (block,) = ngram_lm.text_blocks(iter([df.toArrow().to_batches()[0]]), limit=1 << 40)
    assert model.score_block(block)["score"] == pytest.approx([whole[k] for k in block.ids.to_pylist()])
    assert len(model._held) == 3
    model._held.clear()
    os.remove(f"{model.folder.removeprefix('file://')}/pairs-{np.flatnonzero(model.stored['pairs'])[0]}")
    with pytest.raises(FileNotFoundError):
        model.score_block(block)


def test_table_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    _same(op2_scores(df).collect(), brute([tuple(r) for r in df.collect()]))


def test_empty_training(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert op2_scores(none).count() == 0
    (row,) = op2_scores(spark.createDataFrame([(9, "a b")], "doc_id long, text string")).collect()
    assert row.n_tokens == 3 and row.score < 0
