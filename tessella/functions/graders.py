"""Row-level graders: does an answer agree with its reference.

Each is a pair of column expressions to a boolean; ``GRADERS`` is the registry
that a corpus' grading mode names, and takes further ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip, tail_words

# The patterns that define what counts as a number or a place.
NUMBER = r"-?\d+\.?\d*(?:[eE][+-]?\d+)?"
PLAIN_NUMBER = r"-?\d+(?:\.\d+)?"
PERCENT_NUMBER = r"-?\d+\.?\d*%?"
PLACE = r"(?id)(?:is\s+(?:now\s+)?(?:in|at|located\s+at))\s+(.+?)(?:\.|$)"
FACILITY = r"(?i)(?:Station|Room|Cabinet|Ward|Shelf|Rack|Bay|Dock|Depot|Zone|Area)\s+\w+"
HEAD = 100


def _last(found: Column) -> Column:
    return F.try_element_at(found, F.lit(-1))


def last_number(text: Column, pattern: str = NUMBER) -> Column:
    return _last(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))).try_cast("double")


def place(text: Column) -> Column:
    """The last place named, else the last facility, else the head of the text; trimmed, lower case."""
    named = _last(F.regexp_extract_all(text, F.lit(PLACE), F.lit(1)))
    facility = _last(F.regexp_extract_all(text, F.lit(f"({FACILITY})"), F.lit(1)))
    return F.coalesce(F.lower(strip(named)), F.lower(strip(facility)), F.left(F.lower(strip(text)), F.lit(HEAD)))


def auto_number(answer: Column, reference: Column) -> Column:
    a, r = last_number(answer), last_number(reference)
    return F.coalesce(F.abs(r - a) < 0.01 * F.greatest(F.abs(r), F.lit(1.0)), F.lit(False))


def any_number(answer: Column, reference: Column, tolerance: float = 1e-3) -> Column:
    """Some number of the answer is near the last number of the reference."""
    wanted = last_number(reference, PLAIN_NUMBER)
    numbers = F.regexp_extract_all(answer, F.lit(f"({PLAIN_NUMBER})"), F.lit(1))
    near = F.exists(numbers, lambda x: F.abs(x.try_cast("double") - wanted) <= F.greatest(F.lit(tolerance), F.lit(tolerance) * F.abs(wanted)))
    return F.coalesce(near, F.lit(False))


def auto_location(answer: Column, reference: Column) -> Column:
    a, r = place(answer), place(reference)
    return F.coalesce(F.contains(a, r) | F.contains(r, a), F.lit(False))


def tail_location(answer: Column, reference: Column) -> Column:
    """The last five words of the reference stand in the answer."""
    needle = F.lower(F.array_join(tail_words(reference, 5), " "))
    return F.coalesce((needle != "") & F.contains(F.lower(answer), needle), F.lit(False))


def non_empty(answer: Column, reference: Column | None = None) -> Column:
    return F.coalesce(strip(answer) != "", F.lit(False))


def financial(answer: Column, gold: Column) -> Column:
    """Numbers agree within 1 %; where one has none, the texts agree but for case."""
    number = lambda x: F.rtrim(_last(F.regexp_extract_all(F.replace(x, F.lit(","), F.lit("")), F.lit(f"({PERCENT_NUMBER})"), F.lit(1))), F.lit("%")).try_cast("double")
    a, g = number(answer), number(gold)
    close = F.when(g == 0, F.abs(a) < 0.01).otherwise(F.abs(a - g) < 0.01 * F.greatest(F.abs(g), F.lit(1e-8)))
    same = F.lower(strip(answer)) == F.lower(strip(gold))
    return F.coalesce(F.when(a.isNotNull() & g.isNotNull(), close).otherwise(same), F.lit(False))


def choice_match(text: Column, letter: Column, index: Column, gold: Column) -> Column:
    """The gold names the choice by its text, its letter or its number."""
    g = F.lower(strip(gold))
    number = F.when(g.rlike("^[0-9]+$"), g.try_cast("int"))
    return F.coalesce(F.lower(strip(text)) == g, F.lit(False)) | F.coalesce(F.lower(letter) == g, F.lit(False)) | F.coalesce(number == index, F.lit(False))


def same_label(answer: Column, gold: Column) -> Column:
    return F.coalesce(F.lower(strip(answer)) == F.lower(strip(gold)), F.lit(False))


def verdict(reply: Column) -> Column:
    """A judge's reply: its JSON field, else whether it starts with yes or no, else null."""
    named = F.lower(F.regexp_extract(reply, r'(?i)"correct"\s*:\s*(true|false)', 1))
    start = F.upper(strip(reply))
    return F.when(named == "true", True).when(named == "false", False).when(start.startswith("YES"), True).when(start.startswith("NO"), False)


def verdict_by_words(reply: Column) -> Column:
    """The calibration's reading: the literal field, else yes or no among the first three words."""
    low = F.lower(reply)
    first = F.slice(F.filter(F.split(low, r"(?U)\s+"), lambda w: w != ""), 1, 3)
    return (
        F.when(F.contains(low, F.lit('"correct": true')) | F.contains(low, F.lit('"correct":true')), True)
        .when(F.contains(low, F.lit('"correct": false')) | F.contains(low, F.lit('"correct":false')), False)
        .when(F.array_contains(first, "yes"), True)
        .when(F.array_contains(first, "no"), False)
    )


GRADERS: dict[str, Callable[[Column, Column], Column]] = {
    "auto_number": auto_number,
    "auto_location": auto_location,
    "numeric": any_number,
    "location": tail_location,
    "length_style": non_empty,
    "financial": financial,
    "label": same_label,
}


def grade(mode: str, answer: Column, reference: Column) -> Column:
    if mode not in GRADERS:
        raise ValueError(f"no grader is named {mode!r}; there are {', '.join(sorted(GRADERS))}")
    return GRADERS[mode](answer, reference)
