"""Numbers in words, units, and how answers are written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from anamnesis.functions.text import dedup_key

# Fixed values.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
NUMBER_WORDS = {w: float(i) for i, w in enumerate(ONES)} | {w: 20.0 + 10 * i for i, w in enumerate(TENS)} | {"hundred": 100.0, "thousand": 1000.0, "dozen": 12.0, "couple": 2.0, "a": 1.0, "an": 1.0}
SECONDS = {"second": 1.0, "minute": 60.0, "hour": 3600.0, "day": 86400.0, "week": 604800.0, "month": 2629800.0, "year": 31557600.0}


def as_map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def places(value: Column, n: int) -> Column:
    """The value at n decimals, as SQL's round of a double: scores that differ by the order of their sums are equal."""
    scale = float(10**n)
    return F.floor(value * scale + 0.5) / scale


def parse_number(text: Column) -> Column:
    """The value of digits or number words; null for other words, and for zero unless it is written."""
    bare = F.regexp_replace(dedup_key(text), ",", "")
    bare = F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b(seconds?|minutes?|hours?|days?|weeks?|months?|years?)\b", ""), r"\s+", " "))
    half = bare.rlike(r"\band\s+(a\s+)?half\b")
    rest = F.trim(F.regexp_replace(bare, r"\band\s+(a\s+)?half\b", ""))
    tokens = F.regexp_extract_all(rest, F.lit("[a-z]+"), F.lit(0))
    numbers = as_map(NUMBER_WORDS)
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("now"), F.lit(True).alias("ok"))

    def step(s: Column, t: Column) -> Column:
        n = F.try_element_at(numbers, t)
        at_least = F.greatest(F.lit(1.0), s["now"])
        total = F.when(n == 1000, s["total"] + at_least * 1000).otherwise(s["total"])
        now = F.when(n == 100, at_least * 100).when(n == 1000, F.lit(0.0)).otherwise(s["now"] + F.coalesce(n, F.lit(0.0)))
        return F.struct(total.alias("total"), now.alias("now"), (s["ok"] & n.isNotNull()).alias("ok"))

    done = F.aggregate(tokens, start, step)
    value = done["total"] + done["now"] + F.when(half, 0.5).otherwise(0.0)
    words = F.when(done["ok"] & ((value != 0) | (rest == "zero")), value)
    return F.when(bare.rlike(r"^[-+]?\d+(\.\d+)?$"), bare.try_cast("double")).when((F.size(tokens) == 0) & half, 0.5).otherwise(words)


def format_number(value: Column) -> Column:
    """Whole numbers without a point, others with up to four digits after it."""
    fixed = F.regexp_replace(F.format_string("%.4f", value), r"\.?0+$", "")
    return F.when(F.abs(value - F.round(value)) < 1e-9, F.round(value).cast("long").cast("string")).otherwise(fixed)


def convert(value: Column, unit: Column, target: Column) -> Column:
    """value in the target unit; money as it is; null for an unknown unit."""
    table = as_map(SECONDS)
    bare = lambda u: F.regexp_replace(F.lower(F.coalesce(u, F.lit(""))), "s+$", "")
    own, wanted = bare(unit), bare(F.coalesce(F.nullif(target, F.lit("")), unit))
    return F.when(target == "money", value).otherwise(value * F.try_element_at(table, own) / F.try_element_at(table, wanted))


def answer(value: Column, operation: Column, unit: Column) -> Column:
    """How the value of a plan is written; the value of a temporal join is text already."""
    bare = F.regexp_replace(F.coalesce(unit, F.lit("")), "s+$", "")
    plural = F.concat(bare, F.when(F.abs(value - 1) >= 1e-9, "s").otherwise(""))
    return F.when(operation.isin("count", "count_distinct"), F.round(value).cast("long").cast("string")).when(unit == "money", F.concat(F.lit("$"), format_number(value))).otherwise(F.trim(F.concat_ws(" ", format_number(value), plural)))
