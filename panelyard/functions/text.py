"""Text expressions and the header rewriting rules used for wide sheets."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelyard.functions.numeric import ColumnOrName, as_column


def contains_text(x: ColumnOrName, fragment: str) -> Column:
    return as_column(x).contains(fragment)


def strip_prefix(x: ColumnOrName, prefix: str) -> Column:
    return F.regexp_replace(as_column(x), "^" + re.escape(prefix), "")


def strip_punctuation(x: ColumnOrName) -> Column:
    return F.regexp_replace(as_column(x), r"\p{Punct}+", "")


def letters_only(x: ColumnOrName) -> Column:
    return F.regexp_replace(as_column(x), "[^A-Za-z]", "")


def split_part(x: ColumnOrName, separator: str, index: int) -> Column:
    return F.try_element_at(F.split(as_column(x), re.escape(separator)), F.lit(index + 1))


def clean_header(name: str) -> str:
    """Drop punctuation and symbols, then digits, and keep the rest."""
    return "".join(c for c in name if c.isalpha() or c.isspace())


def coded_headers(names: Sequence[str], codes: Sequence[object], each: int, plain: int = 2) -> list[str]:
    """Cleaned names with a code glued on: ``plain`` leading columns get an empty code, then every code
    covers ``each`` columns (a sheet that repeats one measure block per year)."""
    spread = [""] * plain + [str(code) for code in codes for _ in range(each)]
    if len(spread) != len(names):
        raise ValueError(f"{len(names)} columns but codes for {len(spread)}")
    return [f"{clean_header(name).strip()}_{code}" for name, code in zip(names, spread)]


def category_headers(names: Sequence[str], categories: Sequence[str], each: int, plain: int = 1) -> list[str]:
    """Letters of each header prefixed by the category cell that spans it."""
    letters = [re.sub("[^A-Za-z]", "", name) for name in names]
    spread = [category for category in categories for _ in range(each)]
    if len(spread) != len(names) - plain:
        raise ValueError(f"{len(names) - plain} columns to prefix but categories for {len(spread)}")
    return letters[:plain] + [f"{c}_{n}" for c, n in zip(spread, letters[plain:])]


def header_part(name: str, separator: str = "-", part: int = 1) -> str:
    """One piece of a compound header, e.g. the end year of ``1950-1955``."""
    pieces = name.split(separator)
    return pieces[part] if part < len(pieces) else name
