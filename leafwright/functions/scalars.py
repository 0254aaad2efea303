"""Small scalar rules as columns."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value worked out once for all its uses, inside functions of array elements as well."""
    return F.element_at(F.transform(F.array(value), of), 1)


def auto_scale(pitch: Column) -> Column:
    """Enlargement that brings the line pitch to 48 pixels: between 1 and 2; unknown is 1."""
    return F.coalesce(F.least(F.greatest(48.0 / (0.8 * F.nullif(pitch.cast("double"), F.lit(0.0))), F.lit(1.0)), F.lit(2.0)), F.lit(1.0))


def page_dpi(pixels: Column, mm: Column) -> Column:
    """Pixels over millimetres as dots an inch, half to even, 72 at least."""
    return F.greatest(F.lit(72), F.bround(pixels / (mm / 25.4), 0).cast("int"))


def quarter_turns(degrees: Column) -> Column:
    return F.pmod(F.bround(degrees / 90.0, 0).cast("int"), F.lit(4))


def safe_name(text: Column) -> Column:
    """Without what file systems refuse."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r'[<>:"/\\|?*\x00-\x1F]', "_"))


def name_part(text: Column, n: int = 16) -> Column:
    return F.coalesce(F.nullif(F.substring(safe_name(text), 1, n), F.lit("")), F.lit("不明"))


def trailing_number(text: Column) -> Column:
    """The grouped number at the end of a re-read line."""
    return F.nullif(F.regexp_extract(text, r"([0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)\)?\s*$", 1), F.lit(""))


def utf16_hex(text: Column) -> Column:
    return F.upper(F.hex(F.encode(text, "UTF-16BE")))


def found_in(text: Column, term: Column) -> Column:
    """Case-insensitive substring search, not of whole words."""
    return F.contains(F.lower(text), F.lower(term))


def not_found(text: Column, terms: Column) -> Column:
    """Places (from 0) of the terms that are nowhere in the text. Terms are without spaces and line ends, so a term is in the text
    if it is in one of its words: most are words themselves, and others are looked for in the different words only."""

    @F.pandas_udf("array<int>")
    def missing(texts: pd.Series, terms: pd.Series) -> pd.Series:
        out = []
        for text, some in zip(texts, terms):
            words = set(text.replace("\n", " ").split(" "))
            hay = " ".join(words)
            out.append([i for i, x in enumerate(some) if x not in words and x not in hay])
        return pd.Series(out, dtype=object)

    return missing(text, terms)


def augmented(head: Column, old: Column, digits: Column) -> Column:
    """A re-read amount line: what stood before the amount, then the digits as yen; the old line where nothing was re-read."""
    return F.when(digits.isNotNull(), F.concat(F.rtrim(head), F.lit(" ¥"), digits)).otherwise(old)


# Parts of a message, and the action that any of them calls for, in the order offered.
ACTIONS = [
    (("空き容量",), "resume"),
    (("HDR",), "allow_hdr"),
    (("見つかりません", "ファイルがありません", "内容が変わって"), "goto_input"),
    (("OCR", "Tesseract"), "resume"),
    (("要確認",), "goto_review"),
    (("開かれている",), "export"),
]


def next_actions(message: Column) -> Column:
    """The actions a message calls for, in fixed order; resume when there is none."""
    text = F.coalesce(message, F.lit(""))
    found = F.array_compact(F.array(*[F.when(text.rlike("|".join(parts)), F.lit(action)) for parts, action in ACTIONS]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("resume")))
