"""Reading a question: the kind of answer, anchors that evidence must hold, the plan of a computation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from anamnesis.functions import text as T
from anamnesis.functions.numbers import parse_number

# Word lists.
ANCHOR_STOP = "and at before combined daily did do every for from have in last lately on or since this to when where with".split()
MODIFIERS = "current different favorite favourite first former last latest new old preferred previous recent three total".split()
IGNORED_NAMES = "How I My The What When Where Which Who".split()
ALIASES = {"bachelor": ["graduate", "undergrad", "undergraduate"], "occupation": ["job", "profession", "role"]}
EVENT_NOISE = "appointment day doctor event had night time".split()
EVENT_CORE = "appointment doctor meeting flight interview visit".split()
TARGET_NOISE = "amount different item many money much total".split()
#: Fixed: first pattern that fits names the kind of answer.
SLOTS = [
    (r"^where\b", "place or organization"),
    (r"^(when|what (?:date|time))\b", "exact date or time"),
    (r"^who\b", "person or group"),
    (r"^how long\b|^how much (?:[a-z]+\s+){0,3}time\b", "exact duration"),
    (r"^how (many|much)\b|\bratio\b", "exact quantity or amount"),
    (r"\b(brand|manufacturer|maker)\b", "brand or maker"),
    (r"\b(occupation|profession|job title|work role)\b|\b(previous|former|current|new)\s+(job|position|role)\b", "occupation or role"),
    (r"\b(name|called|title)\b", "exact name or title"),
]


def asked(question: Column) -> Column:
    return T.dedup_key(question)


def answer_slot(question: Column) -> Column:
    out, q = F.lit("specific fact requested"), asked(question)
    for pattern, name in reversed(SLOTS):
        out = F.when(q.rlike(pattern), name).otherwise(out)
    return out


def anchor_tokens(text: Column) -> Column:
    return F.filter(T.content_tokens(text), lambda t: ~t.isin(ANCHOR_STOP))


def anchor_groups(question: Column) -> Column:
    """Array of (label, text, tokens) of the phrases that evidence must support; one per set of tokens, first label wins."""
    q = F.trim(F.regexp_replace(T.some(question), r"\s+", " "))
    every = lambda pattern, group: F.regexp_extract_all(q, F.lit(pattern), F.lit(group))
    wrap = lambda label, values: F.transform(values, lambda v: F.struct(F.lit(label).alias("label"), v.alias("text")))
    attributes = every(r"(?i)\b(?:brand|manufacturer|maker|name|breed|type|kind|model|color|colour)\s+of\s+(?:my\s+)?([a-z][a-z'-]*)", 1)
    owned = F.transform(every(r"(?i)\b(?:my|our|his|her|their)\s+((?:[a-z0-9][a-z0-9'-]*)(?:\s+[a-z0-9][a-z0-9'-]*){0,3})", 1), first_owned)
    doing = F.transform(every(r"(?i)\b(?:baking|collecting|playing|practicing|reading|using|visiting|watching)\s+(.+?)(?=\b(?:and|at|before|combined|daily|every|for|from|in|last|on|or|since|this|to|when|where|with)\b|[?.,!]|$)", 1), lambda v: F.array_join(F.slice(F.filter(F.split(v, " "), lambda w: w != ""), 1, 3), " "))
    bed = F.when(q.rlike(r"(?i)\bgo\s+to\s+bed\b"), F.array(F.lit("bed"))).otherwise(F.array().cast("array<string>"))
    proper = F.filter(every(r"\b[A-Z][A-Za-z0-9.-]*(?:\s+[A-Z][A-Za-z0-9.-]*){0,3}\b", 0), lambda v: ~F.substring_index(F.trim(v), " ", 1).isin(IGNORED_NAMES))
    found = F.concat(wrap("requested entity", attributes), wrap("possessed entity", F.filter(owned, lambda v: v.isNotNull())), wrap("activity object", doing), wrap("target event", bed), wrap("named entity", proper))
    clean = r"""^[ ?.,"']+|[ ?.,"']+$"""
    full = F.transform(found, lambda g: F.struct(g["label"].alias("label"), F.regexp_replace(F.regexp_replace(g["text"], r"\s+", " "), clean, "").alias("text"), anchor_tokens(g["text"]).alias("tokens")))
    some = F.filter(full, lambda g: F.size(g["tokens"]) > 0)
    return F.filter(some, lambda g, i: ~F.exists(F.slice(some, F.lit(1), i), lambda e: e["tokens"] == g["tokens"]))


def first_owned(phrase: Column) -> Column:
    """The first word of the phrase that is no modifier or number, without 's; null if there is none."""
    ws = F.split(phrase, r"\s+")
    at = F.filter(F.sequence(F.lit(1), F.size(ws)), lambda i: ~(F.lower(F.element_at(ws, i)).isin(MODIFIERS) | F.element_at(ws, i).rlike(r"(?i)^\d+(-[a-z]+)?$")))
    word = F.regexp_replace(F.try_element_at(ws, F.try_element_at(at, F.lit(1))), r"(?i)['’]s$", "")
    return F.when(~F.lower(word).isin(MODIFIERS), word)


def supported(group: Column, text: Column) -> Column:
    """Whether the text has all tokens of a group (or a word for them), or the capital letters of its words."""
    own = T.content_tokens(text)

    def has(t: Column) -> Column:
        out = F.array_contains(own, t)
        for name, others in ALIASES.items():
            out = out | ((t == name) & F.arrays_overlap(own, F.array(*map(F.lit, others))))
        return out

    letters = F.regexp_extract_all(group["text"], F.lit("[A-Za-z]+"), F.lit(0))
    acronym = F.upper(F.array_join(F.transform(letters, lambda w: F.substring(w, 1, 1)), ""))
    return F.forall(group["tokens"], has) | ((F.size(letters) >= 2) & F.regexp_like(T.some(text), F.concat(F.lit(r"\b"), acronym, F.lit(r"\b"))))


def coverage(groups: Column, text: Column) -> Column:
    """Struct: supported and missing texts, complete."""
    yes = F.transform(F.filter(groups, lambda g: supported(g, text)), lambda g: g["text"])
    names = F.transform(groups, lambda g: g["text"])
    return F.struct(yes.alias("supported"), F.filter(names, lambda n: ~F.array_contains(yes, n)).alias("missing"), (F.size(yes) == F.size(groups)).alias("complete"))


def plan(question: Column, kind: Column) -> Column:
    """Struct: operation, requires_session_diversity, target_unit, target_tokens, expected_fact_count, minimum_sessions."""
    q = asked(question)
    multi = F.coalesce(kind == "multi-session", F.lit(False))
    joined = q.rlike(r"\b(day|night) before\b|\bday after\b") & q.rlike(r"^(what time|when)")
    counting = multi & q.rlike(r"^how (many|much)\b")
    measured = F.regexp_extract(q, r"^how (?:many|much)\s+(.+?)\s+(?:did|do|does|have|has|was|were|am|are)\b", 1)
    measured = F.when(measured != "", measured).otherwise(q)
    unit = F.regexp_extract(measured, r"\b(seconds?|minutes?|hours?|days?|weeks?|months?|years?)\b", 1)
    money = (unit == "") & (measured.rlike(r"\b(money|cost|costs|expense|expenses|price)\b") | (q.startswith("how much") & q.rlike(r"\b(spent|spend|cost)\b")))
    distinct = q.rlike(r"\b(different|distinct|unique)\b")
    operation = F.when(joined, "temporal_join").when(counting & ((unit != "") | money), "sum").when(counting & distinct, "count_distinct").when(counting, "count").otherwise("none")
    target = F.when(joined, "time").when(counting & money, "money").when(counting & (unit != ""), F.regexp_replace(unit, "s+$", "")).when(counting, "items")
    aim = F.regexp_extract(q, r"^how (?:many|much)\s+(.+?)\s+(?:did|do|does|have|has|was|were|am|are|in total)\b", 1)
    tokens = F.filter(anchor_tokens(F.when(aim != "", aim).otherwise(q)), lambda t: ~t.isin(TARGET_NOISE))
    count = F.regexp_extract(q, r"\b(one|two|three|four|five|six|seven|eight|nine|ten|\d+)\s+(?:destination|event|location|place|session|trip)s?\b", 1)
    return F.struct(operation.alias("operation"), (operation != "none").alias("requires_session_diversity"), target.alias("target_unit"), tokens.alias("target_tokens"), F.when(count != "", parse_number(count)).alias("expected_fact_count"), F.when(operation != "none", F.when(multi, 2).otherwise(1)).alias("minimum_sessions"))


def reference_tokens(question: Column) -> Column:
    """Content tokens of what stands after before/after, without general event words but with core ones."""
    rest = F.regexp_extract(T.some(question), r"(?is)\b(?:before|after)\b(.+)$", 1)
    tokens = T.content_tokens(rest)
    core = F.filter(tokens, lambda t: t.isin(EVENT_CORE))
    return F.array_sort(F.array_union(F.filter(tokens, lambda t: ~t.isin(EVENT_NOISE)), core))


def relevance_tokens(question: Column, unit: Column) -> Column:
    noise = F.array(*map(F.lit, ["many", "much", "total", "time", "combined"]))
    return F.array_except(F.array_except(T.content_tokens(question), noise), F.array(F.coalesce(unit, F.lit(""))))


def grounded(quote: Column, entity: Column) -> Column:
    """Whether the quote names the entity, or the entity is the speaker and the quote speaks of itself."""
    e = T.dedup_key(entity)
    return ((e != "") & T.dedup_key(quote).contains(e)) | (e.isin("i", "me", "my", "mine", "myself", "user", "speaker") & T.dedup_key(quote).rlike(r"\b(i|me|my|mine|myself)\b"))
