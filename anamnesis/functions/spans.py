"""Spans of a text: clauses, quantities and durations, places; and the texts of an answer. Null text counts as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from anamnesis.functions.text import some

# Separators of clauses, and the patterns of quantities, durations, places and times.
SEPARATORS = [".", ";", ",", " and ", " but "]
ONES = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand".split()
NUMBER_WORDS = rf"(?:zero|{'|'.join(ONES)}|dozen|couple)(?:[- ](?:{'|'.join(ONES)}))*"
NUMERIC = r"(?:[$£€]\s*)?\d+(?:[,.]\d+)*(?:\s*(?:%|percent))?"
RATIO = r"\d+(?:\.\d+)?\s*:\s*\d+(?:\.\d+)?"
TECHNICAL = r"(?:kb|mb|gb|tb|kbps|mbps|gbps)"
QUALIFIER = r"(?:about|almost|approximately|around|at least|less than|more than|nearly|over)"
UNIT = r"(?:seconds?|minutes?|hours?|days?|weeks?|months?|years?|decades?)"
DURATION = rf"(?i)\b(?:{QUALIFIER}\s+)?(?:{NUMERIC}|{NUMBER_WORDS}|an?)\s+(?:business\s+)?{UNIT}(?:\s+(?:each way|one way|round trip))?\b"
QUANTITY = rf"(?i)(?<![\w])(?:{RATIO}|{NUMERIC}(?:\s*{TECHNICAL})?|{NUMBER_WORDS})(?![\w])"
PLACE = r"(?i)\b(?:airport|arena|ballroom|building|cafe|center|centre|city|clinic|club|college|company|country|gym|hall|hospital|hotel|island|museum|office|park|restaurant|school|stadium|state|store|studio|theater|theatre|university|venue)\b"
GOING = r"(?i)\b(?:arrived|attend|attended|based|born|dined|flew|go|going|gone|graduate|graduated|live|lived|located|meet|met|moved|return|returned|shop|shopped|stay|stayed|studied|travel|traveled|travelled|trip|visit|visited|visiting|went|work|worked)\b"
TIMES = r"\b(january|february|march|april|may|june|july|august|september|october|november|december|monday|tuesday|wednesday|thursday|friday|saturday|sunday|today|yesterday|tomorrow|day|eve|morning|afternoon|evening|night|\d{1,2}[:/]\d{1,2}|\d{4})\b"
ANSWER_KEYS = ["answer", "text", "value", "reference"]


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def local_clause(text: Column, start: Column, end: Column) -> Column:
    """The clause around text[start:end] (from 0): back to behind the first character of the nearest separator before, on to the nearest one after."""
    left, right = F.substring(some(text), F.lit(1), start), F.substring(some(text), end + 1, F.length(some(text)))

    def last(mark: str) -> Column:
        at = F.instr(F.reverse(left), mark[::-1])
        return F.when(at > 0, F.length(left) - at - len(mark) + 1).otherwise(-1)

    first = lambda mark: F.nullif(F.instr(right, mark), F.lit(0)) - 1
    begin = F.greatest(*map(last, SEPARATORS)) + 1
    stop = F.coalesce(F.least(*map(first, SEPARATORS)), F.length(right))
    return stripped(F.concat(F.substring(left, begin + 1, F.length(left)), F.substring(some(text), start + 1, end - start), F.substring(right, F.lit(1), stop)))


def matches(text: Column, pattern: str) -> Column:
    """Array of (value, start, end) of all matches, from 0; places come from the lengths of what stands between them."""
    gaps, found = F.split(some(text), pattern, -1), F.regexp_extract_all(some(text), F.lit(pattern), F.lit(0))
    begin = F.expr("named_struct('at', 0, 'out', cast(array() as array<struct<value:string,start:int,end:int>>))")

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["g"])
        end = start + F.length(x["m"])
        one = F.struct(x["m"].alias("value"), start.cast("int").alias("start"), end.cast("int").alias("end"))
        return F.struct(end.cast("int").alias("at"), F.concat(s["out"], F.array(one)).alias("out"))

    pairs = F.filter(F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("g"), m.alias("m"))), lambda x: x["m"].isNotNull())
    return F.aggregate(pairs, begin, step)["out"]


def scalar_spans(text: Column, slot: Column) -> Column:
    """Array of (value, clause) of the durations or quantities of a text, as the slot asks for; empty for other slots."""
    own = lambda found: F.transform(found, lambda m: F.struct(stripped(m["value"]).alias("value"), local_clause(text, m["start"], m["end"]).alias("clause")))
    none = F.expr("cast(array() as array<struct<value:string,clause:string>>)")
    return F.when(slot == "exact duration", own(matches(text, DURATION))).when(slot == "exact quantity or amount", own(matches(text, QUANTITY))).otherwise(none)


def clause_for_tokens(text: Column, tokens: Column) -> Column:
    """The clause from the first to the last of the tokens' first places (as starts of words); the whole text if there is none. tokens: letters and digits only."""
    pattern = lambda t: F.concat(F.lit(r"(?i)\b"), t, F.lit(r"\w*\b"))
    at = F.transform(tokens, lambda t: F.struct(F.regexp_instr(some(text), pattern(t)).alias("at"), F.length(F.regexp_substr(some(text), pattern(t))).alias("n")))
    found = F.filter(at, lambda x: x["at"] > 0)
    start, end = F.array_min(F.transform(found, lambda x: x["at"] - 1)), F.array_max(F.transform(found, lambda x: x["at"] - 1 + x["n"]))
    return F.when(F.size(found) > 0, local_clause(text, start, end)).otherwise(some(text))


def temporal_value(value: Column) -> Column:
    return F.lower(stripped(some(value))).rlike(TIMES)


def proper_name(value: Column) -> Column:
    words = F.regexp_extract_all(some(value), F.lit(r"[A-Za-z][A-Za-z'.-]*"), F.lit(0))
    capital = F.size(F.filter(words, lambda w: F.substring(w, 1, 1).rlike("[A-Z]")))
    return (F.size(words) > 0) & (F.forall(words, lambda w: w == F.upper(w)) | (capital >= F.least(F.lit(2), F.size(words))))


def acronym(value: Column) -> Column:
    bare = F.regexp_replace(some(value), "[^A-Za-z0-9]", "")
    return F.length(bare).between(3, 12) & (bare == F.upper(bare)) & bare.rlike("[A-Z]")


def place_score(value: Column, quote: Column) -> Column:
    """How much a value looks like a place: times speak against it, place words, proper names, acronyms, and a quote that goes there for it."""
    bare = stripped(some(value))
    there = F.concat(F.lit(r"(?i)(.{0,80})\b(?:at|in|from|to|on|near|inside|outside)\s+(?:a\s+|an\s+|the\s+)?\Q"), F.replace(bare, F.lit(r"\E"), F.lit("")), F.lit(r"\E\b"))
    named = F.when(bare != "", F.regexp_like(some(quote), there) & (some(value).rlike(PLACE) | F.call_function("regexp_extract", some(quote), there, F.lit(1)).rlike(GOING))).otherwise(F.lit(False))
    part = lambda c, n: F.when(c, F.lit(n)).otherwise(F.lit(0.0))
    return part(temporal_value(value), -4.0) + part(some(value).rlike(PLACE), 2.0) + part(proper_name(value), 0.75) + part(acronym(value), 1.5) + part(named, 3.0)


def answer_variants(json: Column, depth: int = 3) -> Column:
    """The texts of an answer given as JSON: strings and numbers as they are, lists flattened (to `depth`), objects by their known keys, else as JSON. Null: none."""
    none = F.array().cast("array<string>")

    def of(v: Column, left: int) -> Column:
        kind = F.schema_of_variant(v)
        plain = F.array(F.when(kind == "BOOLEAN", F.initcap(F.variant_get(v, "$", "string"))).otherwise(F.to_json(v)))
        text = F.array(F.try_variant_get(v, "$", "string"))
        out = F.when(v.isNull() | (kind == "VOID"), none).when(kind == "STRING", text)
        if left:
            items = F.flatten(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: of(x, left - 1)))
            known = F.flatten(F.array(*(F.coalesce(of(F.try_variant_get(v, f"$.{k}", "variant"), left - 1), none) for k in ANSWER_KEYS)))
            out = out.when(kind.startswith("ARRAY"), F.coalesce(items, none)).when(kind.startswith("OBJECT"), F.when(F.size(known) > 0, known).otherwise(F.array(F.to_json(v))))
        return out.otherwise(plain)

    return of(F.try_parse_json(json), depth)
