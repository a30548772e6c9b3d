"""Column functions on text. All of them are built-in expressions, so they stay within code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern import constants as K


def _lit(x: Column | str | int | float) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


#: Unicode's white space, and U+001C to U+001F.
_WHITE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    """Without white space at both ends, by Unicode's notion of it and the separators U+001C to U+001F."""
    return F.trim(text, F.lit(_WHITE))


def blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


# ---- tokens ----


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), 0)


def bigrams(text: Column, pattern: str = K.CJK) -> Column:
    """Adjacent pairs of the text's CJK characters, joined over what stands between them."""
    chars = F.regexp_extract_all(text, F.lit(pattern), 0)
    return F.when(F.size(chars) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.slice(chars, 1, F.greatest(F.size(chars) - 1, F.lit(1))), lambda c, i: F.concat(c, F.element_at(chars, (i + 2).cast("int")))))


def tokens(text: Column) -> Column:
    """Tokens of the search dialect: CJK bigrams, then lower-case ASCII words."""
    text = F.coalesce(text, F.lit(""))
    return F.concat(bigrams(text), words(text))


def features(text: Column) -> Column:
    """Tokens of the pipeline dialect: c:character, b:bigram, w:word."""
    text = F.coalesce(text, F.lit(""))
    single = F.transform(F.regexp_extract_all(text, F.lit(K.WIDE_CJK), 0), lambda c: F.concat(F.lit("c:"), c))
    double = F.transform(bigrams(text, K.WIDE_CJK), lambda c: F.concat(F.lit("b:"), c))
    ascii_words = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), 0), lambda w: F.concat(F.lit("w:"), F.lower(w)))
    return F.concat(single, double, ascii_words)


def slot(feature: Column, size: int = K.EMBEDDING_SIZE) -> Column:
    """The place of a feature in a hashed vector."""
    return (F.crc32(feature.cast("binary")) % F.lit(size)).cast("int")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length, 1e-9 in place of 0."""
    length = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(length == 0, F.lit(1e-9)).otherwise(length)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


# ---- counting ----


def cjk_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(K.WIDE_CJK))


def solid_count(text: Column) -> Column:
    """Characters that are not white space."""
    return F.length(F.regexp_replace(text, "(?U)\\s+", ""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Za-z0-9]+"))


def token_estimate(text: Column) -> Column:
    return cjk_count(text) + F.floor(word_count(text) / 4)


# ---- normal forms ----

FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
HALF = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))


#: What match_form leaves out.
UNMATCHED = _WHITE + "-\u2010\u2011\u2012\u2013\u2014"


def match_form(text: Column) -> Column:
    """For containment: full-width signs as half-width, no white space, no hyphens."""
    return F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), FULL, HALF), "(?U)[\\s\\x1c-\\x1f\\-\\u2010\\u2011\\u2012\\u2013\\u2014]", "")


def loose_match_form(text: Column) -> Column:
    """As match_form, and without punctuation."""
    return F.regexp_replace(match_form(text), "[\\p{P}\\p{S}]", "")


def tidy(text: Column) -> Column:
    """Runs of white space as one space, none between CJK characters, none at the ends."""
    spaced = F.regexp_replace(text, "(?U)\\s{2,}", " ")
    return strip(F.regexp_replace(spaced, "(?U)(?<=[\\u4e00-\\u9fff])\\s+(?=[\\u4e00-\\u9fff])", ""))


def line_form(text: Column) -> Column:
    """For comparing lines of different pages: no white space at all."""
    return F.regexp_replace(text, "(?U)\\s+", "")


def without_markdown(text: Column) -> Column:
    linked = F.regexp_replace(text, "\\[([^\\]]*)\\]\\([^)]*\\)", "$1")
    plain = F.regexp_replace(linked, "[*_`~]+|[\\[\\]]", "")
    return strip(F.regexp_replace(plain, "(?U)\\s+", " "))


def html_escape(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def html_text(html: Column) -> Column:
    """What is left of a page without scripts, styles, comments and tags; white space collapsed."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), "(?is)<(script|style)\\b.*?</\\1>|<!--.*?-->", " ")
    return strip(F.regexp_replace(F.regexp_replace(bare, "(?s)<[^>]*>", " "), "\\s+", " "))


# ---- cutting ----


def clip(text: Column, most: int) -> Column:
    """At most so many characters, then an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def short(text: Column, most: int) -> Column:
    """White space collapsed; at most so many characters, the ellipsis included."""
    flat = strip(F.regexp_replace(text, "(?U)\\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def slices(text: Column, size: int = K.STREAM_CHARS) -> Column:
    """The text in slices of size characters; the empty text has none."""
    count = F.ceil(F.length(text) / size).cast("int")
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substr(text, (i - 1) * size + 1, F.lit(size))))


def first_sentence(text: Column, most: int = 90) -> Column:
    """Up to the first mark of the first kind (in this order) that stands within most characters; else cut off."""
    found = [F.when((F.instr(text, m) > 1) & (F.instr(text, m) <= most + 1), F.substr(text, F.lit(1), F.instr(text, m))) for m in ("。", "！", "？", ".", ";", "；")]
    return F.coalesce(*found, clip(text, most))


def earliest_sentence(text: Column, most: int = 90) -> Column:
    """Up to the earliest mark of any kind within most characters; else cut off."""
    head = F.regexp_extract(text, f"(?s)^(.{{1,{most}}}?[。！？.;；])", 1)
    return F.when(head != "", head).otherwise(clip(text, most))


def sentence_at(text: Column, position: Column, most: int = 120) -> Column:
    """The sentence around a 0-based position; if longer than most, a window about the position."""
    before, after = F.substr(text, F.lit(1), position), F.substr(text, position + 1)
    # What follows the last mark is counted from the end; a pattern that ends in $ would start anew at every character.
    since = F.length(F.substring_index(F.translate(before, "！？；\n", "。。。。"), "。", -1))
    head, tail = F.right(before, since), F.regexp_extract(after, "^([^。！？；\\n]*[。！？；\\n]?)", 1)
    sentence = strip(F.concat(head, tail))
    start = F.greatest(position - 40, F.lit(0))
    window = strip(F.substr(text, start + 1, position + most - start))
    return F.substring(F.when(F.length(sentence) > most, window).otherwise(sentence), 1, K.MAX_TEXT)


def target_language(text: Column, requested: Column | str = "") -> Column:
    """'en' for a text largely in CJK within its first 400 characters, else 'zh'; a language asked for comes first."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, 400)
    share = F.regexp_count(head, F.lit(K.CJK)) >= F.greatest(F.lit(4.0), F.length(head) * 0.3)
    asked = _lit(requested)
    return F.when(asked.isin("zh", "en"), asked).when(share, "en").otherwise("zh")


# ---- names ----


def strip_filler(text: Column) -> Column:
    return F.regexp_replace(text, f"^({K.FILLERS})", "")


def first_clause(text: Column) -> Column:
    return strip(F.regexp_extract(text, f"^([^{K.NAME_END}]*)", 1))


def clean_name(name: Column) -> Column:
    """A concept's name, or the empty string where it is none: 2 to 16 characters, no narrative start, not one CJK character alone."""
    quotes = "[" + K.NAME_QUOTES + "]+"
    bare = F.regexp_replace(strip(F.coalesce(name, F.lit(""))), f"^{quotes}|{quotes}$", "")
    cjk = F.regexp_count(bare, F.lit(K.CJK))
    usable = F.length(bare).between(2, K.MAX_NAME) & ~bare.rlike(f"^({K.NARRATIVE_STARTS})") & (cjk != 1) & ((cjk > 0) | (F.length(bare) >= 3))
    return F.when(usable, bare).otherwise("")


# ---- citations, JSON, quizzes ----


def cited(text: Column, available: Column) -> Column:
    """Ordinals cited as [n], in order of first use, 1 to available."""
    found = F.transform(F.regexp_extract_all(text, F.lit("\\[([0-9]{1,9})\\]"), 1), lambda n: n.cast("int"))
    return F.array_distinct(F.filter(found, lambda n: (n >= 1) & (n <= available)))


def json_text(text: Column, opening: str = "{", closing: str = "}") -> Column:
    """What a noisy text holds of JSON: a fenced block's inside, else all from the first opening to the last closing sign; null if neither."""
    fenced = F.regexp_extract(text, "(?is)```(?:json)?\\s*(.*?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(text)
    braced = F.regexp_extract(body, f"(?s)(\\{opening}.*\\{closing})", 1)
    return F.when(braced != "", braced)


def cloze(text: Column, name: Column, gap: str = "____") -> Column:
    """text with the first occurrence of name left out."""
    at = F.locate(name, text) if isinstance(name, str) else F.instr(text, name)
    return F.when(at > 0, F.concat(F.substr(text, F.lit(1), at - 1), F.lit(gap), F.substr(text, at + F.length(name)))).otherwise(text)


def seed_of(*parts: Column) -> Column:
    """An integer from the first 12 hexadecimal digits of SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts).cast("binary"), 256), 1, 12), 16, 10).cast("long")


def plan_minutes(chars: Column) -> Column:
    return F.least(F.greatest(F.lit(25) + F.floor(chars / 80), F.lit(20)), F.lit(90)).cast("int")


def pdf_page(printed: Column, offset: Column) -> Column:
    return F.greatest(F.lit(1), F.round(printed).cast("int") - offset)


def ocr_wait_minutes(pages: Column) -> Column:
    """How long to wait for pages to be read: half a minute each and for thirty more, 45 minutes at least."""
    return F.greatest(F.lit(45.0), (pages + 30) * 0.5)


def content_kind(asset: Column, rows: Column) -> Column:
    """image or table by what a section's content holds; null for plain text."""
    return F.when(F.coalesce(asset, F.lit("")) != "", "image").when(F.coalesce(F.size(rows), F.lit(0)) > 0, "table")


def grid_position(place: Column, columns: int = 3, width: int = 220, height: int = 120) -> Column:
    """Where the node of a 0-based place stands in a grid."""
    return F.struct((place % columns * width).alias("x"), (F.floor(place / columns) * height).alias("y"))


# ---- predicates ----


def is_noise_title(title: Column) -> Column:
    return strip(title).rlike(K.NOISE_TITLE)


def looks_like_formula(text: Column) -> Column:
    bare = strip(text)
    return (F.length(bare) <= K.FORMULA_CHARS) & ~bare.rlike(K.CJK) & bare.rlike(K.FORMULA)


def ends_sentence(line: Column) -> Column:
    return line.rlike(K.SENTENCE_END) | line.rlike("(?U)" + K.STOP_END)


def is_noise_line(line: Column) -> Column:
    """A short page number, a dot leader, or a URL by itself."""
    return ((F.length(line) <= 8) & line.rlike("(?U)" + K.PAGE_NUMBER)) | line.rlike(K.DOT_LEADER) | line.rlike(K.URL_ALONE)
