"""Vectorised helpers for what built-in functions cannot say; used only on the rows that need them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date, datetime
from decimal import Decimal, InvalidOperation

import pandas as pd
import regex
from dateutil import parser
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Seconds that one search may take for each DEADLINE_CHARS of the text, begun ones included, before it counts as no match.
DEADLINE = 0.25
DEADLINE_CHARS = 200_000


def search_with_deadline(c: Column, pattern: str, deadline: float = DEADLINE) -> Column:
    """Whether the pattern is found in the whole text, ignoring case; a search past the deadline counts as not found."""

    @F.pandas_udf("boolean")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compiled = regex.compile(pattern, regex.IGNORECASE)

        def one(text: str | None) -> bool:
            try:
                return bool(text is not None and compiled.search(text, timeout=deadline * max(1, -(-len(text) // DEADLINE_CHARS))))
            except TimeoutError:
                return False

        for batch in batches:
            yield batch.map(one)

    return found(c)


def _matcher(pattern: str, deadline: float) -> Callable[[str | None], bool]:
    compiled = regex.compile(pattern)

    def one(text: str | None) -> bool:
        try:
            return bool(text is not None and compiled.fullmatch(text, timeout=deadline))
        except TimeoutError:
            return False

    return one


def matches_with_deadline(c: Column, pattern: str, deadline: float = DEADLINE) -> Column:
    """Whether the whole text matches the pattern; past the deadline it does not."""

    @F.pandas_udf("boolean")
    def matched(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = _matcher(pattern, deadline)
        for batch in batches:
            yield batch.map(one)

    return matched(c)


def _number(t: str | None) -> str | None:
    try:
        return None if t is None else str(Decimal(t.strip()))
    except (InvalidOperation, ValueError):
        return None


#: Two days that share neither year nor month nor day: a date that takes a part from them is not complete.
_FILLS = (datetime(2001, 2, 3), datetime(2004, 7, 9))


def _date(t: str | None) -> str | None:
    if t is None:
        return None
    try:
        return date.fromisoformat(t).isoformat()
    except ValueError:
        pass
    try:
        found = {parser.parse(t, dayfirst=True, default=d).date().isoformat() for d in _FILLS}
    except (ValueError, OverflowError):
        return None
    return found.pop() if len(found) == 1 else None


@F.pandas_udf(StringType())
def exotic_number(texts: pd.Series) -> pd.Series:
    """The canonical form of exponents, digits of other scripts and grouped digits; null for what is no number."""
    return texts.map(_number)


@F.pandas_udf(StringType())
def lenient_date(texts: pd.Series) -> pd.Series:
    """ISO text of a complete date in any ISO form, else in any common form with the day before the month."""
    return texts.map(_date)


@F.pandas_udf(ArrayType(StringType()))
def exotic_numbers(rows: pd.Series) -> pd.Series:
    """exotic_number() of each item of an array; a null array stays null."""
    return rows.map(lambda row: None if row is None else [_number(t) for t in row])


@F.pandas_udf(ArrayType(StringType()))
def lenient_dates(rows: pd.Series) -> pd.Series:
    """lenient_date() of each item of an array; a null array stays null."""
    return rows.map(lambda row: None if row is None else [_date(t) for t in row])


def all_match_with_deadline(c: Column, pattern: str, deadline: float = DEADLINE) -> Column:
    """matches_with_deadline() of each item of an array."""

    @F.pandas_udf("array<boolean>")
    def matched(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = _matcher(pattern, deadline)
        for batch in batches:
            yield batch.map(lambda row: None if row is None else [one(t) for t in row])

    return matched(c)
