"""Name and ingredient normalization with built-in expressions.

Accents are folded character by character: the compatibility decomposition (NFKD) of a character,
without its combining marks.  Each rule below keeps only ``a-z``, ``0-9`` and a few signs after folding,
so a character matters only if its fold contains ASCII or is empty.  That set is small enough for
``translate``, which keeps the rules inside the JVM.  ``fold_accents`` folds every character there is, in the JVM as well.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline import fixed_values as fixed


def _fold(text: str) -> str:
    return "".join(ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.combining(ch))


# Hangul syllables decompose by arithmetic: 19 leads, 21 vowels, 28 tails of which the first is none
_SYLLABLES = range(0xAC00, 0xD7A4)
_LEADS, _VOWELS, _TAILS = range(0x1100, 0x1113), range(0x1161, 0x1176), range(0x11A7, 0x11C3)


@lru_cache(maxsize=2)
def _folds(ascii_only: bool) -> tuple[str, str, dict[str, str]]:
    """Characters that fold to one other character or to nothing, and those that fold to several.

    With ``ascii_only`` just those whose fold contains ASCII or is empty. Hangul syllables are left out.
    """
    single, target, dropped, several = [], [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        if unicodedata.combining(char):
            dropped.append(char)
            continue
        if code in _SYLLABLES or not unicodedata.decomposition(char):
            continue
        folded = _fold(char)
        if folded == "":
            dropped.append(char)
        elif ascii_only and re.search(r"[\x00-\x7f]", folded) is None:
            continue
        elif len(folded) == 1:
            single.append(char)
            target.append(folded)
        else:
            several[char] = folded
    return "".join(single + dropped), "".join(target), several


def _folded(text: Column, ascii_only: bool) -> Column:
    source, target, several = _folds(ascii_only)
    # one literal each for keys and values; the map is built when the plan is optimized
    between = "\x00"
    expansions = F.map_from_arrays(
        F.split(F.lit(between.join(several)), between), F.split(F.lit(between.join(several.values())), between)
    )

    def one(char: Column) -> Column:
        return F.coalesce(F.try_element_at(expansions, char), char)

    # looking for one of them by lookup, which a pattern with hundreds of alternatives would not be
    rare = F.char_length(F.translate(text, "".join(several), "")) < F.char_length(text)
    if not ascii_only:
        lists = [F.split(F.lit("\x00".join(map(chr, codes))), "\x00") for codes in (_LEADS, _VOWELS, _TAILS)]

        def syllable(char: Column) -> Column:
            place = F.ascii(char) - _SYLLABLES.start
            tail = F.pmod(place, F.lit(28))
            parts = [F.get(lists[0], F.floor(place / 588).cast("int")),
                     F.get(lists[1], F.floor(F.pmod(place, F.lit(588)) / 28).cast("int")),
                     F.when(tail > 0, F.get(lists[2], tail)).otherwise("")]
            return F.when(F.ascii(char).between(_SYLLABLES.start, _SYLLABLES.stop - 1), F.concat(*parts)).otherwise(one(char))

        rare = rare | text.rlike("[\uac00-\ud7a3]")
    expanded = F.array_join(
        F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), one if ascii_only else syllable), ""
    )
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(
        F.translate(F.when(rare, expanded).otherwise(text), source, target)
    )


def fold_accents(text: Column | str) -> Column:
    """Fold accents and compatibility forms of arbitrary text."""
    return _folded(F.col(text) if isinstance(text, str) else text, ascii_only=False)


def fold_to_ascii(text: Column) -> Column:
    """Fold every character whose fold contains ASCII or is empty; all others stay as they are."""
    return _folded(text, ascii_only=True)


def _words(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, fixed.WORD_SEPARATORS, " "))


def normalize_shade(raw: Column) -> Column:
    """One spelling for a shade name: no accents, remarks in parentheses or shade codes."""
    text = F.regexp_replace(F.lower(fold_to_ascii(raw)), fixed.PARENTHESES, " ")
    text = F.trim(F.regexp_replace(text, fixed.SHADE_SEPARATORS, " "))
    text = F.trim(F.regexp_replace(text, fixed.SHADE_HASH_CODE, ""))
    for pattern in (fixed.SHADE_LEADING_NO, fixed.SHADE_TRAILING_CODE, fixed.SHADE_LEADING_CODE):
        text = F.regexp_replace(text, pattern, "")
    text = F.trim(F.regexp_replace(text, " +", " "))
    return F.coalesce(F.nullif(text, F.lit("")), _words(F.lower(raw)))


def normalize_brand(raw: Column) -> Column:
    """The first brand of a comma-separated list as lower-case words."""
    return _words(F.lower(fold_to_ascii(F.substring_index(raw, ",", 1))))


def product_key(brand: Column, name: Column) -> Column:
    """Key shared by entries of one product with other spelling or casing."""
    return F.concat(normalize_brand(brand), F.lit("|"), _words(F.lower(fold_to_ascii(name))))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _normal_lines(text: Column) -> Column:
    """The lines of a text as an array, each normalized on its own."""
    def without(sign: str, pattern: str) -> Callable[[Column], Column]:
        # most texts do not have the sign, and finding that out is cheap
        return lambda text: F.when(
            F.contains(text, F.lit(sign)), F.regexp_replace(text, pattern, " ")
        ).otherwise(text)

    text = _let(F.lower(_let(text, fold_to_ascii)), without("%", fixed.PERCENTAGE))
    text = _let(text, without("(", fixed.LINE_PARENTHESES))
    text = F.regexp_replace(F.regexp_replace(text, fixed.INGREDIENT_SEPARATORS, " "), "  +", " ")
    lines = F.transform(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(" -")))
    lines = F.transform(lines, lambda line: F.when(
        F.startswith(line, F.lit("ci")), F.regexp_replace(line, fixed.COLOUR_INDEX, "ci $1")
    ).otherwise(line))
    aliases = F.create_map(*[F.lit(x) for pair in fixed.INGREDIENT_ALIASES.items() for x in pair])
    return F.transform(lines, lambda line: F.coalesce(F.try_element_at(aliases, line), line))


def normalize_ingredient(raw: Column) -> Column:
    """One spelling for a single ingredient."""
    return F.get(_normal_lines(F.translate(raw, "\r\n", "  ")), F.lit(0))


def split_ingredients(text: Column) -> Column:
    """Array of normalized ingredients of a label text, each once, in order of first mention.

    Signs that separate ingredients become line ends, then every rule runs once over the whole text, line by
    line.  (The stops, stars and daggers printed after a name are no letters, and go with the other signs.)  All of it
    stays within the row: a refresh of the ingredient table needs no shuffle, and an ingredient that almost
    every product has costs nothing extra.
    """
    body = F.regexp_replace(text, fixed.INGREDIENT_LABEL, "")
    names = _normal_lines(F.regexp_replace(body, fixed.INGREDIENT_SIGNS, "\n"))
    return F.array_distinct(F.filter(names, lambda name: F.length(name) > 1))


def strip(text: Column) -> Column:
    """Text without white space of any kind at both ends."""
    return F.btrim(text, F.lit(fixed.SPACES))


def extract_shade(product_name: Column) -> Column:
    """Shade written at the end of a product name, or null."""
    name = strip(product_name)
    tail = F.nullif(F.regexp_extract(name, fixed.SHADE_TAIL, 1), F.lit(""))
    number = F.nullif(F.regexp_extract(name, fixed.SHADE_NUMBER, 1), F.lit(""))
    return strip(F.coalesce(tail, number))


def best_category(tags: Column) -> Column:
    """The last makeup tag of a tag list, without its language prefix."""
    matching = F.filter(F.split(tags, ","), lambda tag: tag.rlike(fixed.MAKEUP))
    last = F.coalesce(F.try_element_at(matching, F.lit(-1)), F.lit(fixed.DEFAULT_CATEGORY))
    return F.substring_index(last, ":", -1)


def is_makeup(tags: Column, name: Column) -> Column:
    return (tags.rlike(fixed.MAKEUP) | name.rlike(fixed.MAKEUP)) & ~(
        tags.rlike(fixed.NOT_MAKEUP) | name.rlike(fixed.NOT_MAKEUP)
    )
