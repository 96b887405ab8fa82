"""Text scalar functions as Column expressions; none of them leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def normalise(text: Column) -> Column:
    """White space runs become one space per line; lines are trimmed and empty ones dropped."""
    tidy = F.transform(lines(text), lambda s: F.trim(F.regexp_replace(s, r"[ \t\r\f\x0B]+", " ")))
    return F.array_join(F.filter(tidy, lambda s: s != ""), "\n")


def clean_lines(text: Column, drop: int = 0) -> Column:
    """Collapse spaces, tabs and no-break spaces only; optionally drop leading lines."""
    tidy = F.transform(lines(text), lambda s: F.trim(F.regexp_replace(s, "[ \t ]+", " ")))
    kept = F.filter(tidy, lambda s: s != "")
    return let(kept, lambda k: F.array_join(F.slice(k, drop + 1, F.size(k)), "\n")) if drop else F.array_join(kept, "\n")


def flat_lower(text: Column) -> Column:
    """Lines joined by a space, lower-cased, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\n\f\x0B]+", " "))


def words(text: Column) -> Column:
    """Words of a text as ``flat_lower`` leaves it; none for an empty text."""
    return let(flat_lower(text), lambda flat: F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " ")))


def shingles(tokens: Column, n: int = 5, short: str = "none") -> Column:
    """Distinct runs of ``n`` words. Fewer words give none, or with ``short='whole'`` the whole text."""
    none = F.array().cast("array<string>")

    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))
        few = none if short == "none" else F.when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(none)
        return F.when(F.size(w) >= n, F.array_distinct(runs)).otherwise(few)

    return let(tokens, of)


def tokens(text: Column) -> Column:
    """Maximal runs without white space, case kept."""
    return F.filter(F.split(text, r"[ \t\r\n\f\x0B]+"), lambda s: s != "")


def is_identifier(token: Column, min_length: int = 2, min_digits: float = 0.2) -> Column:
    """Long enough, with a letter, and with digits for at least the given share of its length."""
    digits = F.length(F.regexp_replace(token, "[^0-9]", ""))
    letters = F.length(F.regexp_replace(token, r"[^\p{L}]", ""))
    return (F.length(token) >= min_length) & (letters > 0) & (digits >= min_digits * F.length(token))


def bare_word(token: Column) -> Column:
    """The token without leading and trailing characters that aren't letters."""
    return F.regexp_replace(token, r"^[^\p{L}]+|[^\p{L}]+$", "")


def title_case(word: Column) -> Column:
    """First character in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substr(word, F.lit(2)))


def xml_escape(text: Column) -> Column:
    """The five predefined entities; the ampersand goes first."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def xml_unescape(text: Column) -> Column:
    for raw, entity in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(entity), F.lit(raw))
    return text


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]*>", "")


def row_id(shard: Column, row: Column) -> Column:
    """``shard#000123``"""
    return F.format_string("%s#%06d", shard, row)


def split_row_id(value: Column) -> tuple[Column, Column]:
    """Shard and row of a composite id; the row is null where it isn't a number."""
    return F.regexp_extract(value, "^(.*)#([0-9]+)$", 1), F.nullif(F.regexp_extract(value, "^(.*)#([0-9]+)$", 2), F.lit("")).cast("bigint")


def shard_index(shard: Column) -> Column:
    return F.nullif(F.regexp_extract(shard, "([0-9]+)$", 1), F.lit("")).cast("int")


PRETOKEN = (
    r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
)


def pretokens(text: Column) -> Column:
    """Pieces that byte-level BPE merges inside of: contractions, words with one character before
    them, single digits, punctuation with line ends, white space."""
    return F.regexp_extract_all(text, F.lit(PRETOKEN), F.lit(0))


# --- English inflection ------------------------------------------------------------------------

_CVC = "^[^aeiou]*[aeiou][^aeiouwxy]$"


def monosyllabic(word: Column) -> Column:
    """Exactly one run of vowels."""
    return F.size(F.regexp_extract_all(word, F.lit("[aeiou]+"), F.lit(0))) == 1


def doubled(word: Column) -> Column:
    """A monosyllable that ends consonant, vowel, consonant (not w, x, y) doubles its last letter."""
    return F.when(word.rlike(_CVC), F.concat(word, F.substr(word, F.length(word), F.lit(1)))).otherwise(word)


def _but_last(word: Column, n: int = 1) -> Column:
    return F.substr(word, F.lit(1), F.length(word) - n)


def plural(word: Column) -> Column:
    return (
        F.when(word.rlike("(s|x|z|ch|sh)$"), F.concat(word, F.lit("es")))
        .when(word.rlike("[^aeiou]y$"), F.concat(_but_last(word), F.lit("ies")))
        .otherwise(F.concat(word, F.lit("s")))
    )


def past(word: Column) -> Column:
    return (
        F.when(word.rlike("e$"), F.concat(word, F.lit("d")))
        .when(word.rlike("[^aeiou]y$"), F.concat(_but_last(word), F.lit("ied")))
        .otherwise(F.concat(doubled(word), F.lit("ed")))
    )


def gerund(word: Column) -> Column:
    return (
        F.when(word.rlike("(ee|oe|ye)$"), F.concat(word, F.lit("ing")))
        .when(word.rlike("e$"), F.concat(_but_last(word), F.lit("ing")))
        .otherwise(F.concat(doubled(word), F.lit("ing")))
    )


def comparative(word: Column, suffix: str = "er") -> Column:
    """``suffix`` is ``er`` or ``est``."""
    return (
        F.when(word.rlike("e$"), F.concat(_but_last(word), F.lit(suffix)))
        .when(word.rlike("[^aeiou]y$"), F.concat(_but_last(word), F.lit("i" + suffix)))
        .otherwise(F.concat(doubled(word), F.lit(suffix)))
    )


def adverb(word: Column) -> Column:
    return (
        F.when(word.rlike("y$"), F.concat(_but_last(word), F.lit("ily")))
        .when(word.rlike("ic$"), F.concat(word, F.lit("ally")))
        .when(word.rlike("[^aeiou]le$"), F.concat(_but_last(word), F.lit("y")))
        .otherwise(F.concat(word, F.lit("ly")))
    )
