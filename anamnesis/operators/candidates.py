"""Answer candidates from extracted facts: selection, scores, canonical forms, the decision to answer or to abstain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from anamnesis.functions import text as T
from anamnesis.operators import fusion

# Cue words, and the weights of a candidate's parts.
OLD = r"\b(old|previous|previously|former|formerly|earlier|before|used to)\b"
NEW = r"\b(new|current|currently|now|latest|recently changed|changed to)\b"
NOISE = "what when where which who how did does was were before earlier previous previously current currently now mine your have changed".split()
QUERY_RELATIONS = {
    "like": r"\b(like|likes|liked|love|loves|loved|prefer|prefers|preferred|favorite|favourite)\b",
    "live in": r"\b(live|lives|lived|stay|stays|stayed|reside|resides|moved)\b",
    "work at": r"\b(work|works|worked|employed|job)\b",
    "has": r"\b(has|have|had|own|owns|owned)\b",
}
QUALIFIER = r"(?i)^(?:about|almost|approximately|around|at least|less than|more than|nearly|over)\s+"
WEIGHTS = {"relation": 2.5, "head": 1.5, "tail": 0.5, "source": 0.6, "local": 2.0, "quoted": 0.75}


def query_relation_keys(question: Column, relations: Column) -> Column:
    """Keys of the relations extracted from a question, and of those its words name; sorted."""
    low = F.lower(T.some(question))
    cued = F.array(*(F.when(low.rlike(p), F.lit(k)) for k, p in QUERY_RELATIONS.items()))
    own = F.transform(F.coalesce(relations, F.array().cast("array<string>")), T.relation_key)
    return F.array_sort(F.array_union(own, F.filter(cued, lambda k: k.isNotNull())))


def plain_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(T.some(text)), F.lit("[a-z0-9]+"), F.lit(0)))


def temporal_facts(triples: DataFrame, questions: DataFrame, most: int = 4) -> DataFrame:
    """(question, seq, head, relation, tail, overlap, rank): facts whose relation has the cue of the question's time and shares a word with it.

    triples: question, seq, head, relation, tail; questions: question, text, scope."""
    q = questions.select("question", "scope", F.filter(plain_tokens(F.col("text")), lambda t: (F.length(t) > 2) & ~t.isin(NOISE)).alias("q"))
    rows = triples.join(q, "question").withColumn("overlap", F.size(F.array_intersect("q", plain_tokens(F.col("relation")))))
    cue = F.when(F.col("scope") == "historical", F.lower("relation").rlike(OLD)).otherwise(F.lower("relation").rlike(NEW))
    rows = rows.where(cue & ((F.size("q") == 0) | (F.col("overlap") > 0)))
    rank = F.row_number().over(W.partitionBy("question").orderBy(F.desc("overlap"), "seq"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).select("question", "seq", "head", "relation", "tail", "overlap", "rank")


def slot_candidates(triples: DataFrame, questions: DataFrame, most: int = 8) -> DataFrame:
    """(question, value, component, strength, seq, rank): ends of facts as answers. A fact's tail stands for itself; its head
    too if the question asks for a person, or is closer to the tail. The best per value and quote, then per value.

    triples: question, seq, head, relation, tail, quote, role; questions: question, text, slot."""
    q = questions.select("question", "slot", T.content_tokens(F.col("text")).alias("q"))
    share = lambda c: F.size(F.array_intersect("q", T.content_tokens(F.col(c))))
    rows = triples.join(q, "question").withColumns({"o_rel": share("relation"), "o_head": share("head"), "o_tail": share("tail"), "o_src": share("quote")}).where("o_src > 0 OR o_rel > 0 OR o_head > 0 OR o_tail > 0")
    person = F.col("slot") == "person or group"
    part = lambda c, base, name, head: F.struct(F.col(c).alias("value"), F.lit(base).cast("double").alias("base") if not isinstance(base, Column) else base.cast("double").alias("base"), F.lit(name).alias("component"), head.cast("int").alias("o_own"))
    tail = part("tail", 2.5, "tail", F.col("o_head"))
    heads = F.when(~T.dedup_key(F.col("head")).isin(T.GENERIC_VALUES) & (person | (F.col("o_tail") > F.col("o_head"))), F.array(part("head", F.when(person, 2.75).otherwise(1.5), "head", F.lit(0)))).otherwise(F.array().cast("array<struct<value:string,base:double,component:string,o_own:int>>"))
    each = rows.select("*", F.explode(F.concat(F.array(tail), heads)).alias("c")).select("*", "c.*").where(~T.dedup_key(F.col("value")).isin(T.GENERIC_VALUES))
    local = F.size(F.array_intersect("q", T.content_tokens(F.concat_ws(" ", "head", "relation", "tail"))))
    quoted = T.holds_value(F.col("quote"), F.col("value"))
    w = WEIGHTS
    strength = F.col("base") + w["relation"] * F.col("o_rel") + w["head"] * F.col("o_own") + w["tail"] * F.col("o_tail") + w["source"] * F.least(F.col("o_src"), F.lit(4)) + w["local"] * local + T.role_score(F.col("role"), F.lit(None).cast("string")) + F.when(quoted, w["quoted"]).otherwise(0.0)
    scored = each.withColumns({"strength": strength, "key": T.dedup_key(F.col("value"))}).where("strength > 0")
    best = F.row_number().over(W.partitionBy("question", "key").orderBy(F.desc("strength"), F.desc("o_src"), "seq"))
    one = scored.withColumn("__n", best).where("__n = 1")
    rank = F.row_number().over(W.partitionBy("question").orderBy(F.desc("strength"), F.desc("o_src"), "seq"))
    return one.withColumn("rank", rank).where(F.col("rank") <= most).select("question", "value", "component", "strength", "seq", "rank")


def reranked(candidates: DataFrame, semantic: str, lexical: str, role: Column, most: int) -> DataFrame:
    """candidates with score: three quarters semantic (a model's raw score), a quarter lexical scaled within the question, a tenth for or against the role."""
    bonus = F.when(T.dedup_key(role) == "user", 0.1).when(T.dedup_key(role) == "assistant", -0.1).otherwise(0.0)
    score = F.round(0.75 * fusion.sigmoid(F.col(semantic)) + 0.25 * fusion.min_max(lexical, F.lit(0.5)) + bonus, 4)
    rows = candidates.withColumn("score", score)
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("question").orderBy(F.desc("score"), "seq"))).where(F.col("rank") <= most)


def canonical_answer(generated: Column, slot: Column, value: Column, quote: Column, role: Column) -> Column:
    """The grounded form of a generated quantity or duration: the best candidate's value if the answer holds it as whole words;
    a duration that only lacks the value's qualifier gets it back if the user said so."""
    answer = F.trim(T.some(generated))
    whole = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(T.dedup_key(c), r"(?:(?<!\d)\.|\.(?!\d)|[^\w.:$%])+", " ")), F.lit(" "))
    held = whole(answer).contains(whole(value))
    bare = F.regexp_replace(value, QUALIFIER, "")
    strip = lambda c: F.regexp_replace(T.dedup_key(c), r"""^[ .,:;"']+|[ .,:;"']+$""", "")
    said = ((T.dedup_key(role) == "user") | T.dedup_key(role).endswith(" user")) & T.holds_value(quote, value)
    restored = (slot == "exact duration") & said & (bare != value) & (strip(answer) == strip(bare))
    fits = slot.isin("exact duration", "exact quantity or amount") & (T.some(value) != "")
    return F.when(fits & (held | restored), value).otherwise(answer)


def decision(operation: Column, status: Column, operation_answer: Column, anchors: Column, n_candidates: Column) -> Column:
    """answer, abstain or generate: a planned computation answers or abstains; required anchors without a candidate abstain."""
    planned = operation != "none"
    return F.when(planned & (status == "complete") & operation_answer.isNotNull(), "answer").when(planned | ((anchors > 0) & (n_candidates == 0)), "abstain").otherwise("generate")


def place_values(value: Column) -> Column:
    """A place as it stands, without a bracket at its end, and what follows its last preposition if that is a proper name."""
    clean = F.regexp_replace(T.some(value), r"""^[ .,:;"']+|[ .,:;"']+$""", "")
    bare = F.trim(F.regexp_replace(clean, r"\s*\([^)]*\)\s*$", ""))
    last = F.regexp_replace(F.regexp_extract(bare, r"(?i)^.*\b(?:at|in|from|to|on|near|inside|outside)\s+(?:(?:a|an|the)\s+)?(.+)$", 1), r"""^[ .,:;"']+|[ .,:;"']+$""", "")
    found = F.filter(F.array(clean, bare, F.when(last.rlike(r"^[A-Z]"), last)), lambda v: v.isNotNull() & (v != ""))
    return F.filter(found, lambda v, i: ~F.exists(F.slice(found, F.lit(1), i), lambda e: T.dedup_key(e) == T.dedup_key(v)))


def occupations(text: Column) -> Column:
    """Array of values of `worked as a ...` and `current role as ...`, up to sixteen words, each once."""
    one = F.trim(F.regexp_replace(T.some(text), r"\s+", " "))
    end = r"(?=,\s*(?:and|but)\b|\s+(?:and|but)\s+(?:i|we|my|our|he|she|they|the|it)\b|[.;!?]|$)"
    patterns = [r"(?i)\b(?:previous|former|earlier|old|current|new|present)\s+(?:occupation|job|position|role)\s+(?:was\s+)?as\s+(?:an?\s+)?(.+?)" + end, r"(?i)\b(?:worked|working|employed|served|serving)\s+as\s+(?:an?\s+)?(.+?)" + end]
    found = F.concat(*(F.regexp_extract_all(one, F.lit(p), F.lit(1)) for p in patterns))
    return F.array_distinct(F.filter(F.transform(found, lambda v: F.trim(v)), lambda v: (v != "") & (F.size(F.split(v, " ")) <= 16)))
