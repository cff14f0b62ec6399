"""Text functions as column expressions; everything here stays in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TermList = Sequence[str]


def casefold(text: Column) -> Column:
    """Lower case with sharp s as ss: the folding that matters for Western texts."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def collapse(text: Column) -> Column:
    """Runs of any white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, "(?U)[\\s\\x1c-\\x1f]+", " "))


def title_key(title: Column) -> Column:
    return collapse(casefold(title))


def alnum_key(text: Column) -> Column:
    """ASCII letters and digits in lower case, all else as single blanks."""
    return F.trim(F.regexp_replace(casefold(text), "[^a-z0-9]+", " "))


def compact_query(text: Column, limit: int = 240) -> Column:
    return F.left(collapse(text), F.lit(limit))


def normal_doi(doi: Column) -> Column:
    """Trimmed, in lower case, without a resolver or scheme prefix; empty becomes null."""
    bare = F.regexp_replace(F.lower(F.trim(doi)), "^(https://doi\\.org/)?(http://doi\\.org/)?(doi:)?", "")
    return F.nullif(bare, F.lit(""))


def find_doi(text: Column) -> Column:
    """The first DOI-like token of a text, in lower case; null where there is none."""
    found = F.regexp_extract(text, "(?i)\\b10\\.\\d{4,9}/[-._;()/:A-Z0-9]+\\b", 0)
    return F.nullif(F.lower(F.regexp_replace(found, "[.,);]+$", "")), F.lit(""))


def resolve_doi(doi: Column, url: Column, title: Column) -> Column:
    """A record's own DOI, else one found in its URL, or in the title if it has no URL."""
    return F.coalesce(normal_doi(doi), find_doi(F.coalesce(F.nullif(url, F.lit("")), title)))


def identity_title(title: Column, phrases: TermList) -> Column:
    """A title without bracketed artefact notes and artefact phrases, as a key."""
    text = F.regexp_replace(casefold(title), "\\([^)]*(?:code|data|simulation|supplement)[^)]*\\)", " ")
    for phrase in phrases:
        text = F.replace(text, F.lit(phrase), F.lit(" "))
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def joined(*parts: Column) -> Column:
    """Parts that are neither null nor empty, with blanks between."""
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def has_term(text: Column, term: str) -> Column:
    """Short alphabetic terms match as words, all others anywhere."""
    if not term:
        return F.lit(False)
    if term.isalpha() and len(term) <= 4:
        return text.rlike(rf"(?U)\b{term}\b")
    return F.contains(text, F.lit(term))


def has_any(text: Column, terms: TermList) -> Column:
    """One alternation per list rather than one test per term keeps plans small."""
    words = [t for t in terms if t and t.isalpha() and len(t) <= 4]
    others = [t for t in terms if t and not (t.isalpha() and len(t) <= 4)]
    found = F.lit(False)
    if words:
        found = found | text.rlike(r"(?U)\b(?:" + "|".join(words) + r")\b")
    if others:
        found = found | F.exists(F.array(*[F.lit(t) for t in others]), lambda t: F.contains(text, t))
    return found


def raw_hits(text: Column, terms: TermList) -> Column:
    """How many of the terms occur anywhere in the text."""
    return F.size(F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(text, t)))


def matching_terms(text: Column, terms: TermList) -> Column:
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(text, F.lower(t)))


def sentences(text: Column) -> Column:
    return F.split(F.trim(text), "(?<=[.!?])\\s+")


def first_sentence_with(text: Column, terms: TermList, limit: int = 320) -> Column:
    """The first sentence that has one of the terms, cut; null where none has."""
    return F.left(F.try_element_at(F.filter(sentences(text), lambda s: has_any(casefold(s), terms)), F.lit(1)), F.lit(limit))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def strip_tags(text: Column) -> Column:
    """Markup of abstracts: tag pairs of paragraphs and jats wrappers go, blanks collapse."""
    return collapse(F.regexp_replace(text, "</?(?:jats:)?(?:p|title)>", " "))


def strip_page(html: Column) -> Column:
    """A page's visible text on one line, entities left as they are."""
    bare = F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</\\1>", " ")
    return collapse(F.regexp_replace(bare, "(?s)<[^>]+>", " "))


def first_url(text: Column, suffix: str = "") -> Column:
    return F.nullif(F.regexp_extract(text, rf"(?i)https?://[^\s\"'<>)]+{suffix}", 0), F.lit(""))


def is_http(url: Column) -> Column:
    return F.coalesce(url.rlike("^(?i)https?://[^/\\s]+"), F.lit(False))


def ascii_slug(text: Column) -> Column:
    """Kebab case of Latin-1 text; letters beyond it become dashes (see nfkd_slug)."""
    plain = F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def node_id(kind: Column, name: Column) -> Column:
    return F.concat_ws(":", F.lower(kind), ascii_slug(name))


def short_hash(text: Column, size: int = 12) -> Column:
    return F.left(F.sha1(text), F.lit(size))


def chunk_id(slug: Column, lo: Column, hi: Column) -> Column:
    return F.concat(slug, F.lit(":"), short_hash(F.concat_ws("-", lo.cast("string"), hi.cast("string"))))


def json_body(text: Column) -> Column:
    """The outermost braces of a noisy answer, if they hold valid JSON; else null."""
    body = F.regexp_extract(text, "(?s)\\{.*\\}", 0)
    return F.when(F.try_parse_json(body).isNotNull() & (body != ""), body)


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def strength_bar(x: Column, width: int = 10) -> Column:
    full = F.bround(clamp01(x) * width, 0).cast("int")
    return F.concat(F.repeat(F.lit("#"), full), F.repeat(F.lit("-"), F.lit(width) - full))


def truncated(text: Column, limit: int) -> Column:
    return F.when(F.char_length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.left(text, F.lit(limit - 1))), F.lit("…")))


def table_cell(text: Column) -> Column:
    return collapse(F.replace(text, F.lit("|"), F.lit("\\|")))


def citation(slug: Column, lo: Column, hi: Column, quote: Column) -> Column:
    span = F.when(lo.isNotNull(), F.concat(F.lit("["), lo.cast("string"), F.lit("-"), hi.cast("string"), F.lit("]")))
    return F.concat_ws(" — ", slug, span, F.when(F.char_length(quote) > 0, F.left(quote, F.lit(160))))


def clean_claim(text: Column) -> Column:
    """Claims on one line; null for fragments and for pointers to other places."""
    line = collapse(F.coalesce(text, F.lit("")))
    pointer = F.lower(line).rlike("^(see |table |figure |fig\\.|section )")
    return F.when((F.char_length(line) >= 12) & ~pointer, line)


def vague_because(text: Column, superlatives: TermList, comparators: TermList, hedges: TermList) -> Column:
    """Why a claim can't be tested: a superlative without comparison, or a hedge without
    a number.  List order decides which word is named; null for a claim that can."""
    low = F.lower(text)
    bare = F.try_element_at(F.filter(F.array(*[F.lit(t) for t in superlatives]), lambda t: F.contains(low, t)), F.lit(1))
    hedge = F.coalesce(*[F.when(low.rlike(rf"\b{h}\b"), F.lit(h)) for h in hedges])
    return F.when(~raw_any(low, comparators) & bare.isNotNull(), F.concat(F.lit("superlative: "), bare)).when(~low.rlike("[0-9]") & hedge.isNotNull(), F.concat(F.lit("hedge: "), hedge))


def raw_any(text: Column, terms: TermList) -> Column:
    return F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(text, t))


def noise_name(name: Column) -> Column:
    """Names that are no entities: too short, too long, or bibliographic."""
    words = F.size(F.split(F.trim(name), "\\s+"))
    return (F.char_length(F.trim(name)) < 2) | (F.char_length(name) > 80) | (words > 11) | name.rlike("(?i)\\b(et al|doi|isbn|arxiv|vol\\.|pp\\.)\\b|^\\W*\\d+\\W*$")
