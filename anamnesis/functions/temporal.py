"""Cues of time: historical, current and updating language, scopes, weekdays and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from anamnesis.functions.text import relation, some

# Cue words.
HISTORICAL = r"\b(earlier|previously|before|formerly|used to|in the past|prior|old|older|earliest|originally|initially|did)\b"
CURRENT = r"\b(now|currently|right now|today|presently|these days|latest|current|does|do|is|are)\b"
UPDATE = r"\b(now|currently|right now|these days|changed|switched|instead|no longer|not anymore|anymore|from now|updated|moved to|but now)\b"
PAST_PHRASE = r"\b(used to|previously|earlier|formerly|before|in the past)\b"
PAST_VERB = r"\b(liked|loved|preferred|lived|worked|had|used to)\b"
PAST_FIRST = ["liked", "loved", "preferred", "lived", "worked", "had"]
CURRENT_FIRST = ["likes", "loves", "prefers", "lives", "works", "has", "is", "are"]
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
REPLACING = ["like", "live in", "work at"]


def cue(text: Column, pattern: str) -> Column:
    return F.lower(some(text)).rlike(pattern)


def relation_scope(rel: Column, quote: Column) -> Column:
    """historical, current or unknown, from the relation first, then from the quote."""
    r, first = relation(rel), F.substring_index(relation(rel), " ", 1)
    now = cue(quote, CURRENT) | cue(quote, UPDATE)
    return (
        F.when(r.rlike(PAST_PHRASE) | first.isin(PAST_FIRST) | (cue(quote, PAST_VERB) & ~now), "historical")
        .when(first.isin(CURRENT_FIRST), "current")
        .when(cue(quote, PAST_PHRASE), "historical")
        .when(cue(quote, UPDATE), "current")
        .otherwise("unknown")
    )


def text_scope(text: Column) -> Column:
    past, now = cue(text, HISTORICAL) | cue(text, PAST_VERB), cue(text, CURRENT) | cue(text, UPDATE)
    return F.when(past & now, "mixed").when(past, "historical").when(now, "current").otherwise("unknown")


def query_scope(text: Column) -> Column:
    """A question without a historical cue asks for the present."""
    return F.when(cue(text, HISTORICAL), "historical").otherwise("current")


def supersedes(old_scope: Column, new_scope: Column, quote: Column, key: Column) -> Column:
    """Whether a new fact closes an older one under the same key."""
    return cue(quote, UPDATE) | (key.isin(REPLACING) & (new_scope == "current")) | ((old_scope == "historical") & (new_scope == "current"))


def weekday(text: Column) -> Column:
    """0 for Monday ... of the first weekday named, else null."""
    name = F.regexp_extract(F.lower(some(text)), r"\b(" + "|".join(WEEKDAYS) + r")\b", 1)
    return F.when(name != "", F.array_position(F.array(*map(F.lit, WEEKDAYS)), name).cast("int") - 1)


def date_of(text: Column, stamp: Column) -> Column:
    """The first YYYY-M-D (or with slashes) of the text, if it is a date; else that at the start of the stamp."""

    def read(x: Column, pattern: str) -> Column:
        part = lambda i: F.lpad(F.regexp_extract(some(x), pattern, i), 2 if i > 1 else 4, "0")
        return F.when(F.regexp_extract(some(x), pattern, 1) != "", F.try_to_date(F.concat_ws("-", part(1), part(2), part(3)), "yyyy-MM-dd"))

    return F.coalesce(read(text, r"\b(\d{4})[-/](\d{1,2})[-/](\d{1,2})\b"), read(stamp, r"^\s*(\d{4})[-/](\d{1,2})[-/](\d{1,2})"))


def adjacent(direction: Column, target_day: Column, reference_day: Column, target_date: Column, reference_date: Column) -> Column:
    """Whether the target lies a day before or after the reference; weekdays, where both are known, beat dates."""
    step = F.when(direction == "before", 1).otherwise(-1)
    days = F.pmod(reference_day - target_day, F.lit(7)) == F.pmod(step, F.lit(7))
    dates = F.datediff(reference_date, target_date) == step
    return F.when(target_day.isNotNull() & reference_day.isNotNull(), days).when(target_date.isNotNull() & reference_date.isNotNull(), dates).otherwise(F.lit(False))
