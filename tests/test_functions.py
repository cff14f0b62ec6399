"""Scalar functions against values worked out by hand or by plain Python."""

import difflib

import pytest
from pyspark.sql import functions as F

from folioflux.functions import dates as D
from folioflux.functions import similarity as S
from folioflux.functions import text as T
from folioflux.functions import vectors as V


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if not isinstance(v, list) else 'array<double>'}" for k, v in values.items()))
    return df.select(column.alias("x")).first().x


def test_short_terms_match_words_only(spark):
    wheat = F.lit("wheat fields")
    assert not one(spark, T.has_term(wheat, "heat"), a="")
    assert one(spark, T.has_term(F.lit("the heat is on"), "heat"), a="")
    assert one(spark, T.has_term(wheat, "field"), a="")
    assert one(spark, T.raw_hits(wheat, ["heat", "eld", "zz"]), a="") == 2
    assert not one(spark, T.has_any(F.lit("écheat"), ["heat", "cold"]), a="")


@pytest.mark.parametrize(("text", "want"), [("https://doi.org/10.1/X ", "10.1/x"), ("DOI:10.2/y", "10.2/y"), ("", None), (None, None)])
def test_doi(spark, text, want):
    assert one(spark, T.normal_doi(F.col("a")), a=text) == want


def test_find_doi(spark):
    assert one(spark, T.find_doi(F.col("a")), a="see 10.1234/AbC.5). and") == "10.1234/abc.5"
    assert one(spark, T.resolve_doi(F.lit(None).cast("string"), F.lit(""), F.col("a")), a="x 10.12345/z") == "10.12345/z"


@pytest.mark.parametrize(
    ("text", "want"),
    [("2026-04-30T23:59:00Z", "2026-04-30"), ("Tue, 3 Mar 2026 10:00:00 +0200", "2026-03-03"), ("2026-02-30", None), ("garbage", None), (None, None)],
)
def test_parse_date(spark, text, want):
    got = one(spark, D.parse_date(F.col("a")), a=text)
    assert (str(got) if got else None) == want


def test_month_window(spark):
    assert str(one(spark, D.window_start(F.lit("2026-04")), a="")) == "2026-02-15"
    assert str(one(spark, D.window_end(F.lit("2026-02")), a="")) == "2026-02-28"
    assert one(spark, D.in_month(F.lit(None).cast("date"), F.lit("2026-04")), a="") is False
    assert str(one(spark, D.date_of_parts(F.lit(2026), F.lit(None).cast("int"), F.lit(None).cast("int")), a="")) == "2026-01-01"
    assert one(spark, D.date_of_filename(F.col("a")), a="note-2026-02-31.md") is None
    assert str(one(spark, D.date_of_filename(F.col("a")), a="20260315_x.txt")) == "2026-03-15"


def test_sequence_ratio_is_ordered(spark):
    for a, b in (("tide", "diet"), ("diet", "tide"), ("", ""), ("abc", "abd")):
        assert one(spark, S.sequence_ratio(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(difflib.SequenceMatcher(None, a, b).ratio())
    assert one(spark, S.sequence_ratio(F.col("a"), F.col("b")), a=None, b="x") is None


def test_token_set():
    assert S.token_set("gpt 4", "4 gpt") == 100.0
    assert S.token_set("gpt 4", "gpt 4 turbo") == 100.0
    assert S.token_set("", "x") == 0.0
    assert S.token_set("red fish", "blue fish") == pytest.approx(S.indel_ratio("fish red", "fish blue"))
    assert S.indel_ratio("kitten", "sitting") == pytest.approx(200 * 4 / 13)


def test_cosine(spark):
    got = one(spark, V.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0, 1.0])
    assert got == pytest.approx(0.5**0.5)
    assert one(spark, V.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 1.0]) == 0
    assert one(spark, V.cosine(F.col("a"), F.col("b")), a=[1.0], b=[1.0, 1.0]) == 0
    assert one(spark, V.cosine(F.col("a"), F.col("b"), clamp=True), a=[-1.0, 0.0], b=[1.0, 0.0]) == 0


def test_small_text_helpers(spark):
    assert one(spark, T.strength_bar(F.lit(0.25)), a="") == "##--------"
    assert one(spark, T.truncated(F.col("a"), 5), a="abcdefgh") == "abcd…"
    assert one(spark, T.clean_claim(F.col("a")), a="See figure one for more") is None
    assert one(spark, T.clean_claim(F.col("a")), a=" a   good long claim ") == "a good long claim"
    assert one(spark, T.json_body(F.col("a")), a='noise {"a": 1} tail') == '{"a": 1}'
    assert one(spark, T.json_body(F.col("a")), a="{broken") is None
    assert one(spark, S.nfkd_slug(F.col("a")), a="Crème Brûlée №5") == "creme-brulee-no5"
    assert one(spark, S.unescape_html(F.col("a")), a="a &amp; b") == "a & b"
    assert one(spark, S.loose_find(F.col("a"), F.col("b")), a="x  the   cat", b="the cat") == 3


def test_ratio_reached_equals_the_ratio():
    """Long texts too, of which SequenceMatcher leaves out frequent characters."""
    import random
    from difflib import SequenceMatcher

    from folioflux.functions.similarity import RatioTo

    r = random.Random(4)
    answers = set()
    for n in range(300):
        b = [r.choice("abcdefgh ,.XYZé"[: r.randrange(1, 15)]) for _ in range(r.choice([0, 1, 5, 30, 190, 260, 500]))]
        a = list(b)
        for _ in range(r.randrange(0, 1 + len(b) // 8)):
            a[r.randrange(len(a))] = r.choice(["", "x", "ab", "é"])
        a, b = "".join(a), "".join(b)
        ratio, own = SequenceMatcher(None, a, b).ratio(), RatioTo(b)
        for least in (0.3, 0.88, 0.92, ratio, ratio + 1e-9, 1.0):
            assert own.reaches(a, least) == (ratio >= least), (a, b, least)
        answers.add(ratio >= 0.92)
    assert answers == {True, False}


def test_later_titles_alone_are_compared(spark):
    from folioflux.operators import dedup

    rows = [("x", "ocean heat rises", 1, 1), ("x", "ocean heat rises.", 2, 2), ("x", "ocean heat, rises", 1, 5)]
    got = dedup._near_titles(spark.createDataFrame(rows, "a string, t string, lo long, hi long"), 0.92)
    assert {(r.t, r.t2) for r in got.collect()} == {(rows[1][1], rows[0][1]), (rows[1][1], rows[2][1]), (rows[2][1], rows[0][1]), (rows[2][1], rows[1][1])}
