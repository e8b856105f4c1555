"""Text folding, trimming and list helpers as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from terralex import fixed_values as fv


def _is_stripped_mark(ch: str) -> bool:
    return 0x300 <= ord(ch) <= 0x36F


def _fold_alphabet() -> tuple[str, str]:
    """Derive `translate` arguments from canonical decomposition.

    The first string lists letters to map followed by characters to delete; the second holds the images
    of the former. Characters that never end up as ASCII are left alone: the later pass blanks them.
    """
    mapped, images, deleted = ["đ", "Đ"], ["d", "D"], list(fv.QUOTE_CHARACTERS)
    for code in range(0x80, 0x10000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        ch = chr(code)
        if _is_stripped_mark(ch):
            deleted.append(ch)
            continue
        base = "".join(c for c in unicodedata.normalize("NFD", ch) if not _is_stripped_mark(c))
        if base == ch:
            continue
        if not base or base in fv.QUOTE_CHARACTERS:
            deleted.append(ch)
        elif len(base) == 1 and base.isascii():
            mapped.append(ch)
            images.append(base)
    return "".join(mapped + deleted), "".join(images)


_FOLD_FROM, _FOLD_TO = _fold_alphabet()


def fold(text: Column) -> Column:
    """Lower-case ASCII words separated by single spaces; accents and quotes removed."""
    plain = F.lower(F.translate(F.coalesce(text, F.lit("")), _FOLD_FROM, _FOLD_TO))
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(fv.JS_SPACE))


def trim_to_null(text: Column) -> Column:
    return F.nullif(trimmed(text), F.lit(""))


def clean_list(items: Column) -> Column:
    """Trim, drop blanks, de-duplicate keeping first occurrences."""
    kept = F.filter(F.transform(items, trimmed), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(F.array_distinct(kept), F.array().cast("array<string>"))


def split_list(text: Column, separator: str = ",") -> Column:
    """Split, trim and drop blanks (duplicates stay)."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), separator, -1), trimmed)
    return F.filter(parts, lambda x: x != "")


def append_aliases(existing: Column, extra: Column, primary: Column) -> Column:
    """Existing aliases, then unseen extras in order; the primary name is never an extra."""
    fresh = F.filter(extra, lambda x: x.isNotNull() & (x != "") & F.coalesce(x != primary, F.lit(True)))
    return F.array_distinct(F.concat(existing, fresh))


def repair_legacy_letters(text: Column) -> Column:
    return F.translate(text, fv.LEGACY_LETTERS, fv.LEGACY_REPLACEMENTS)


def has_legacy_letters(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(f"[{fv.LEGACY_LETTERS}]")


def utf16_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[\x{10000}-\x{10FFFF}]", "__"))


def natural_sort_key(identifier: Column) -> Column:
    """(text before the trailing digits, that number, id): numeric-aware and total."""
    digits = F.regexp_extract(identifier, r"([0-9]+)\z", 1)
    prefix = F.regexp_replace(identifier, r"[0-9]+\z", "")
    return F.struct(
        prefix.alias("prefix"), F.length(F.ltrim(digits, F.lit("0"))).alias("length"), F.ltrim(digits, F.lit("0")).alias("number"),
        identifier.alias("id"),
    )


def display_name(en: Column, vi: Column) -> Column:
    return F.coalesce(en, vi, F.lit(""))


def same_name(left: Column, right: Column) -> Column:
    return F.lower(left) == F.lower(right)
