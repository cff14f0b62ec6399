import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from folioflux.llm.packing import WordTokenizer, cut_pieces, op9_pieces, pack, piece_lengths, vocabulary_path
from folioflux.llm.rows import text_blocks

ODD = ["", "a", "don't stop", "It's 3rd-rate", "naïve café, déjà-vu", "x̃y a,̃b", "1⃣2", "≮=", "日本語 text。", "ß×÷ÿ", "a b　c", "\x00\x1f\x7f a", "'s 't 're'll", "é,é.", "<|startoftext|>hi<|endoftext|>", "İΣẞ", "½²³ ⅷ", "é,è.à!", "İSTANBUL 12'3", "👍🏽 ok‍", "a\x0bb\x0cc\x85d", "Å Å", "KK"]


def _expected(texts):
    tok = Tokenizer.from_file(vocabulary_path())
    return [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def _got(texts):
    tokenizer = WordTokenizer(vocabulary_path())
    out = []
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    for block in text_blocks(iter([batch]), limit=1 << 16):
        ids, first = tokenizer.encode(block)
        out += [ids[first[k] : first[k + 1]].tolist() for k in range(len(block))]
    return out


def test_ids_are_those_of_the_tokenizer():
    rng = random.Random(5)
    alphabet = list("abcXYZ019 \n\t.,;'-<=!éßÄñ×̸́ 　日½👍‍⃣İΣ'stremdl")
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(4000)]
    marks = ["<|startoftext|>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", "a", "é", "̸", " ", "'s", "7", "<", ">"]
    texts += ["".join(rng.choice(marks) for _ in range(rng.randrange(9))) for _ in range(3000)]
    texts += ["".join(rng.choice("erchtéinä") for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    texts += pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    assert _got(texts) == _expected(texts)


def test_forgotten_units_are_asked_again(monkeypatch):
    monkeypatch.setattr("folioflux.llm.packing.KEPT_UNITS", 50)
    rng = random.Random(6)
    texts = ["".join(rng.choice("abc é1.") for _ in range(200)) for _ in range(400)]
    tokenizer = WordTokenizer(vocabulary_path())
    for n in range(0, len(texts), 20):
        part = texts[n : n + 20]
        (block,) = text_blocks(iter([pa.RecordBatch.from_pydict({"doc_id": list(range(20)), "text": part})]))
        ids, first = tokenizer.encode(block)
        assert [ids[first[k] : first[k + 1]].tolist() for k in range(20)] == _expected(part)


def test_cut_pieces_equals_piece_lengths():
    tokens = [1, 4096, 8205, 4095, 1, 12288, 7]
    for max_len in (1, 2, 64, 4096):
        owner, part, start, length = cut_pieces(np.array(tokens), max_len)
        for k, n in enumerate(tokens):
            own = piece_lengths(n, max_len)
            assert length[owner == k].tolist() == own
            assert part[owner == k].tolist() == list(range(len(own)))
            assert start[owner == k].tolist() == np.cumsum([0] + own)[:-1].tolist()


def test_piece_lengths():
    assert piece_lengths(1) == [1]
    assert piece_lengths(4096) == [4096]
    assert piece_lengths(4096 * 2 + 13) == [4096, 4096, 8, 4, 1]
    assert all(sum(piece_lengths(n)) == n for n in range(1, 9000, 37))


def test_pieces_rebuild_each_document(spark):
    texts = [None, "", "hello world", "word " * 9000, "hello world"]
    docs = spark.createDataFrame([(k if k != 4 else None, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, length int").select("doc_id", "text")
    rows = pack(docs, with_ids=True).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert all(len(r.ids) == r.length and r.length & (r.length - 1) == 0 and r.offset == 0 for r in rows)
    for key, text in zip([0, 1, 2, 3, None], texts, strict=True):
        own = sorted((r for r in rows if r.doc_id == key), key=lambda r: r.start)
        ids = [x for r in own for x in r.ids]
        assert ids == _expected([text or ""])[0] + [2]
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.doc_tokens == len(ids) for r in own)


def test_empty_table(spark):
    assert op9_pieces(spark.createDataFrame([], "doc_id long, text string")).count() == 0
