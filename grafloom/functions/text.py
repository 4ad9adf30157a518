"""Text functions as Column expressions; all run inside the JVM unless they say otherwise."""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from grafloom.functions.words import FULLTEXT_STOP, GRAPH_STOP, KEY_STOP, LEXICAL_STOP, NOTEBOOK_STOP

#: Code points of a token: digits, ASCII letters, and the range from U+00C0 to U+1EF9.
TOKEN = "[0-9A-Za-zÀ-ỹĐđ]+"

#: Patterns that classify lines of structured law texts, tested in this order (fixed values).
CHAPTER = r"(?iu)^Chương\s+([IVXLCDM]+|\d+)(?:[\.\s:-]+(.+))?$"
SECTION = r"(?iu)^Mục\s+([IVXLCDM]+|\d+)(?:[\.\s:-]+(.+))?$"
ARTICLE = r"(?iu)^Điều\s+(\d+[a-zA-Z]?)\s*[\.:]\s*(.+)$"
CLAUSE = r"^(\d{1,3})\.\s+(.+)$"
POINT = r"(?iu)^([a-zđ](?:\d+)?)\)\s+(.+)$"


def normalize_space(c: Column) -> Column:
    """Every run of white space, no-break spaces included, as one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


@functools.cache
def _accents() -> tuple[str, str]:
    """Characters that decompose into one other and marks, and what they leave."""
    source, target = [], []
    for code in range(0xC0, 0x10000):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue
        full = unicodedata.normalize("NFD", chr(code))
        bare = "".join(x for x in full if unicodedata.category(x) != "Mn")
        if len(bare) == 1 and bare != chr(code):
            source.append(chr(code))
            target.append(bare)
    return "".join(source) + "Đđ", "".join(target) + "Dd"


def strip_accents(c: Column) -> Column:
    source, target = _accents()
    return F.regexp_replace(F.translate(c, source, target), r"\p{Mn}", "")


def slugify(c: Column, fallback: str = "item") -> Column:
    doubled = F.replace(F.replace(c, F.lit("Đ"), F.lit("DD")), F.lit("đ"), F.lit("dd"))
    slug = F.trim(F.regexp_replace(F.lower(strip_accents(doubled)), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit(fallback))


def is_separator(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"(?U)^[_=\-\s.]{3,}$")


def uppercase_ratio(c: Column) -> Column:
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    return F.when(letters > 0, F.regexp_count(c, F.lit(r"\p{Lu}")) / letters).otherwise(F.lit(0.0))


def is_structural(c: Column) -> Column:
    out = c.rlike(CHAPTER)
    for p in (SECTION, ARTICLE, CLAUSE, POINT):
        out = out | c.rlike(p)
    return out


def is_heading_title(c: Column) -> Column:
    fits = (F.length(c) > 0) & (F.length(c) <= 220) & ~is_structural(c)
    return fits & ((uppercase_ratio(c) >= 0.55) | F.substring(c, 1, 1).rlike(r"^\p{Lu}"))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def token_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(TOKEN)).cast("long")


def _without(terms: Column, stop: tuple[str, ...], least: int = 2) -> Column:
    return F.filter(terms, lambda t: (F.length(t) >= least) & ~t.isin(*stop))


def key_terms(c: Column) -> Column:
    """Distinct accent-free lower-case tokens of two or more characters that are no stop words, in order."""
    return F.array_distinct(_without(tokens(F.lower(strip_accents(c))), KEY_STOP))


def lexical_terms(c: Column, limit: int = 18) -> Column:
    """Distinct lower-case tokens with their accents; single characters only if digits."""
    keep = F.filter(tokens(F.lower(c)), lambda t: ((F.length(t) >= 2) | t.rlike("^[0-9]$")) & ~t.isin(*LEXICAL_STOP) & ~strip_accents(t).isin(*LEXICAL_STOP))
    return F.slice(F.array_distinct(keep), 1, limit)


def fulltext_terms(c: Column) -> Column:
    """The first 18 tokens of two or more characters that are no stop words, else the first 12 of any."""
    raw = F.filter(tokens(F.lower(c)), lambda t: F.length(t) >= 2)
    kept = F.filter(raw, lambda t: ~strip_accents(t).isin(*FULLTEXT_STOP))
    return F.when(F.size(kept) > 0, F.slice(kept, 1, 18)).otherwise(F.slice(raw, 1, 12))


def notebook_terms(c: Column) -> Column:
    """As ``fulltext_terms`` with the notebook's stop words; else the first 12 tokens of any length."""
    raw = tokens(F.lower(c))
    kept = F.filter(raw, lambda t: (F.length(t) >= 2) & ~strip_accents(t).isin(*NOTEBOOK_STOP))
    return F.when(F.size(kept) > 0, F.slice(kept, 1, 18)).otherwise(F.slice(raw, 1, 12))


def folded(word: Column) -> Column:
    """A lower-case word without its accents."""
    return F.when(word.rlike("[^\\x00-\\x7F]"), strip_accents(word)).otherwise(word)


def graph_terms(c: Column) -> Column:
    """Words that are no stop words, each accented one followed by its plain twin, 16 at most; else the first 8."""
    raw = F.regexp_extract_all(c, F.lit(r"(?U)\w+"), F.lit(0))
    kept = F.filter(raw, lambda t: (F.length(t) >= 2) & ~F.lower(strip_accents(t)).isin(*GRAPH_STOP))
    twins = F.flatten(F.transform(kept, lambda t: F.when(F.lower(strip_accents(t)) != F.lower(t), F.array(t, strip_accents(t))).otherwise(F.array(t))))
    out = F.slice(F.array_distinct(twins), 1, 16)
    return F.when(F.size(out) > 0, out).when(F.size(raw) > 0, F.slice(raw, 1, 8)).otherwise(F.array(c))


def clean_text(c: Column) -> Column:
    """Unix line ends, plain blanks, no runs of blanks, two line ends at most in a row."""
    c = F.replace(F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), F.lit(" "), F.lit(" "))
    c = F.regexp_replace(F.regexp_replace(c, "[ \t]+", " "), "\n{3,}", "\n\n")
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def public_query(c: Column) -> Column:
    """Compatibility-normalised, case-folded, single blanks, without punctuation at the end (an Arrow UDF folds)."""

    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())

    return F.regexp_replace(normalize_space(fold(c)), r"(?U)[\s?!.,;:]+$", "")


def repair(c: Column) -> Column:
    """Undoes UTF-8 that was read as Latin-1, up to two times; other texts stay."""

    def once(x: Column) -> Column:
        fits = ~x.rlike("[^\u0000-ÿ]") & x.rlike("[\u0080-ÿ]")
        fixed = F.try_validate_utf8(F.encode(F.when(fits, x), "ISO-8859-1").cast("string"))
        return F.coalesce(fixed, x)

    return once(once(c))


def strip_fence(c: Column) -> Column:
    """A payload without its code fence."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def head_and_tail(words: Column, budget: int) -> Column:
    """At most ``budget`` words: a quarter (64 at least) from the front, the rest from the end."""
    head = max(64, budget // 4)
    return F.when(F.size(words) <= budget, words).otherwise(F.concat(F.slice(words, 1, head), F.slice(words, -(budget - head), budget - head)))


def detect_code(stem: Column, head: Column) -> Column:
    """The number of a law in its file name, else in its first lines, else the name."""
    name = F.replace(stem, F.lit("_"), F.lit("-"))
    # The forms of a law's number.
    full = r"(?iu)(\d+)-(\d{4})-([A-ZĐ0-9]+(?:-[A-ZĐ0-9]+)*)"
    merged = r"(?iu)^(\d+)[-_](VBHN-[A-ZĐ]+)"
    spaced = r"(?iu)(\d+)\s*/\s*(\d{4})\s*/\s*([A-ZĐ0-9]+(?:-[A-ZĐ0-9]+)*)"

    def three(c: Column, p: str) -> Column:
        return F.when(c.rlike(p), F.concat_ws("/", F.regexp_extract(c, p, 1), F.regexp_extract(c, p, 2), F.upper(F.regexp_extract(c, p, 3))))

    two = F.when(stem.rlike(merged), F.concat_ws("/", F.regexp_extract(stem, merged, 1), F.upper(F.regexp_extract(stem, merged, 2))))
    return F.coalesce(three(name, full), two, three(head, spaced), stem)


def cascade(c: Column, rules: tuple[tuple[tuple[str, ...], str], ...], otherwise: str) -> Column:
    """The value of the first rule of which a keyword is in ``c``."""
    out = None
    for words, value in rules:
        hit = functools.reduce(lambda a, b: a | b, (F.contains(c, F.lit(w)) for w in words))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(otherwise)


def smart_title(lines: Column, fallback: Column) -> Column:
    """Up to three of the first twelve lines, before a preamble, chapter or article; shouting is set in title case."""
    # Fixed value: how preambles begin.
    stops = r"(?iu)^(Căn cứ|Theo đề nghị|Quốc hội ban hành|Chính phủ ban hành)"
    first = F.slice(lines, 1, 12)
    stop = F.array_position(F.transform(first, lambda x: ~is_separator(x) & (x.rlike(stops) | x.rlike(CHAPTER) | x.rlike(ARTICLE))), True)
    before = F.when(stop > 0, F.slice(first, F.lit(1), (stop - 1).cast("int"))).otherwise(first)
    joined = normalize_space(F.array_join(F.slice(F.filter(before, lambda x: ~is_separator(x)), 1, 3), " "))
    title = F.coalesce(F.nullif(joined, F.lit("")), F.replace(fallback, F.lit("-"), F.lit(" ")))
    return F.when(uppercase_ratio(title) > 0.85, F.initcap(title)).otherwise(title)
