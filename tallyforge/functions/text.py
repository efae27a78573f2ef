"""Text: answer normalisation, token overlap, names and digests."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters and words that do not count in an answer, and the white space between words.
PUNCTUATION = string.punctuation
ARTICLES = ("a", "an", "the")
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def normalized_words(text: str) -> str:
    """SQL for the lower-cased words without ASCII punctuation and articles."""
    # One pass turns white space into blanks and drops punctuation; a blank is the cheapest split.
    skipped = ", ".join(f"'{word}'" for word in ("", *ARTICLES))
    blanks = " " * len(WHITESPACE)
    bare = f"translate(lower({text}), {_literal(WHITESPACE + PUNCTUATION)}, '{blanks}')"
    return f"filter(split({bare}, ' '), _w -> _w NOT IN ({skipped}))"


def normalized_text(text: str) -> str:
    return f"array_join({normalized_words(text)}, ' ')"


def _repeats(words: str) -> str:
    """SQL for the second and later copies of each word, numbered, so that they form a set.

    Sorting puts equal words side by side and one linear regular expression cuts
    out the runs, so a whole long answer costs n log n inside its row, with no
    shuffle per word.
    """
    joined = f"concat(' ', array_join(sort_array({words}), ' '))"
    runs = rf"regexp_extract_all({joined}, r' (\S++)((?: \1(?= |$))++)', 2)"
    return f"flatten(transform({runs}, _run -> transform(split(ltrim(_run), ' '), (_c, _i) -> concat(_c, ' ', _i))))"


def words_f1(left: str, right: str) -> str:
    """SQL for the token F1 of two word arrays: two empty sides agree fully, one empty side scores zero.

    The overlap of the two bags is that of their distinct words plus that of the repeats.
    """
    overlap = f"size(array_intersect({left}, {right})) + size(array_intersect({_repeats(left)}, {_repeats(right)}))"
    return f"coalesce(try_divide(2.0D * ({overlap}), size({left}) + size({right})), 1.0D)"


def safe_name(name: Column) -> Column:
    cleaned = F.regexp_replace(name, r"[^A-Za-z0-9_.-]+", "_")
    return F.lower(F.regexp_replace(cleaned, "^_+|_+$", ""))


def digest_prefix(text: Column, length: int) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def compact_text_hash(text: Column) -> Column:
    """Hash under which two texts count as copies: case and white space ignored."""
    return F.md5(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")))


def char_error_rate(reference: Column, answer: Column) -> Column:
    """Edits from reference to answer per character of the reference; an empty reference counts as one character."""
    return F.levenshtein(reference, answer) / F.greatest(F.length(reference), F.lit(1))


def word_error_rate(reference: Column, answer: Column) -> Column:
    """Edits in words per word of the reference; words are runs between blanks, an empty reference counts as one word.

    Each distinct word of the two is written as one character, so that the
    built-in edit distance counts words.
    """

    def words(text: Column) -> Column:
        return F.filter(F.split(text, r"\s+"), lambda w: w != "")

    known = F.array_distinct(F.concat(words(reference), words(answer)))

    def written(text: Column) -> Column:
        def sign(word: Column) -> Column:
            number = F.hex(F.array_position(known, word) + 0x10000)
            return F.decode(F.unhex(F.lpad(number, 8, "0")), "UTF-32")

        return F.array_join(F.transform(words(text), sign), "")

    return F.levenshtein(written(reference), written(answer)) / F.greatest(F.size(words(reference)), F.lit(1))
