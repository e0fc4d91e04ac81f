"""A temporal property graph as tables: supersession, status, incident edges, bounded search with paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from anamnesis.functions import temporal, text as T


def edge_ids(facts: DataFrame, session: str, seq: str) -> DataFrame:
    """facts with edge_id, numbered in order of arrival within the session."""
    n = F.row_number().over(W.partitionBy(session).orderBy(seq))
    return facts.withColumn("edge_id", F.format_string("%s:edge-%06d", F.col(session).cast("string"), n))


def nodes(facts: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """A row per entity: its edges, largest confidence, first and last arrival, last quote. facts: head, tail, seq, confidence, quote."""
    own = scope or []
    ends = facts.select(*own, "seq", "confidence", "quote", F.explode(F.array("head", "tail")).alias("entity"))
    return ends.groupBy(*own, "entity").agg(F.count("*").alias("mentions"), F.max("confidence").alias("confidence"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.max_by("quote", "seq").alias("last_quote"))


def superseded(facts: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """facts with status, valid_to, superseded_by: an edge is closed by the first later edge of its head and relation key
    with another tail that supersedes it. facts: seq, head, key, tail, scope_time, quote, stamp, edge_id.

    A later edge closes an earlier one by itself (it updates, or is current under a replacing key), or because it is
    current and the earlier is historical. Per such set, the nearest later closing edge decides, or, if that has the same
    tail, the start of the next run of another tail; both are running values of one sorted group, so no group is joined
    with itself."""
    c, own = F.col, scope or []
    group = W.partitionBy(*own, "head", "key")
    before = group.orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    later = group.orderBy(F.desc("seq")).rowsBetween(W.unboundedPreceding, -1)  # from the end: the last one met is the nearest
    always = F.coalesce(temporal.cue(c("quote"), temporal.UPDATE) | (c("key").isin(temporal.REPLACING) & (c("scope_time") == "current")), F.lit(False))
    rows = facts.withColumns({"__a": always, "__h": always | F.coalesce(c("scope_time") == "current", F.lit(False))})
    for flag in ("__a", "__h"):
        prior = F.last(F.when(c(flag), c("tail")), ignorenulls=True).over(before)
        rows = rows.withColumn(f"{flag}_turn", c(flag) & ~prior.eqNullSafe(c("tail")))
        turn = F.last(F.when(c(f"{flag}_turn"), F.struct("edge_id", "stamp")), ignorenulls=True).over(later)
        rows = rows.withColumn(f"{flag}_next", turn)
        near = F.last(F.when(c(flag), F.struct("edge_id", "stamp", "tail", c(f"{flag}_next").alias("next"))), ignorenulls=True).over(later)
        rows = rows.withColumn(f"{flag}_near", near)
        n = c(f"{flag}_near")
        rows = rows.withColumn(f"{flag}_by", F.when(n["tail"] != c("tail"), F.struct(n["edge_id"].alias("edge_id"), n["stamp"].alias("stamp"))).otherwise(n["next"]))
    by = F.when(c("scope_time") == "historical", c("__h_by")).otherwise(c("__a_by"))
    out = rows.withColumn("__by", by).withColumns({"status": F.when(c("__by").isNull(), "active").otherwise("superseded"), "valid_to": c("__by.stamp"), "superseded_by": c("__by.edge_id")})
    return out.select(*facts.columns, "status", "valid_to", "superseded_by")


def supersedes_lists(closed: DataFrame) -> DataFrame:
    """(edge_id, supersedes): the edges that each edge closed, in order."""
    return closed.where("superseded_by IS NOT NULL").groupBy(F.col("superseded_by").alias("edge_id")).agg(F.array_sort(F.collect_list("edge_id")).alias("supersedes"))


def memory_status(memories: DataFrame, closed: DataFrame) -> DataFrame:
    """memories (doc, seq, edge_id, source_turn_ids, relation_keys) with status and superseded_relation_keys: the keys of edges
    closed after the memory was made that share a turn with it and are among its keys (or it has none)."""
    gone = closed.where("status = 'superseded'").select("edge_id", "key", F.col("closed_seq"), F.explode("source_turn_ids").alias("turn"))
    own = memories.select("doc", "seq", "relation_keys", F.explode("source_turn_ids").alias("turn"))
    hit = own.join(gone, "turn").where((F.col("seq") < F.col("closed_seq")) & ((F.coalesce(F.size("relation_keys"), F.lit(0)) <= 0) | F.array_contains("relation_keys", F.col("key"))))
    keys = hit.groupBy("doc").agg(F.array_sort(F.collect_set("key")).alias("superseded_relation_keys"))
    status = closed.select("edge_id", "status")
    return memories.join(status, "edge_id", "left").join(keys, "doc", "left")


def incident(edges: DataFrame) -> DataFrame:
    """(node, next, edge_id, direction, edge_seq, ...): each edge from both of its ends, a self-loop once."""
    others = [c for c in edges.columns if c not in ("head", "tail")]
    out = edges.select(F.col("head").alias("node"), F.col("tail").alias("next"), F.lit("out").alias("direction"), *others)
    back = edges.where("head <> tail").select(F.col("tail").alias("node"), F.col("head").alias("next"), F.lit("in").alias("direction"), *others)
    return out.unionByName(back)


def edge_passes(scope: Column, least: float, excluded: Column | None = None) -> Column:
    """Edges that may be walked: active ones (all for a historical question), confident enough, not from excluded turns."""
    ok = ((scope == "historical") | (F.col("status") != "superseded")) & (F.col("confidence") >= least)
    return ok if excluded is None else ok & ~F.coalesce(F.arrays_overlap("source_turn_ids", excluded), F.lit(False))


def bounded_search(starts: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """(question, start, edge_id, depth, direction, path_edges, path_nodes, ...) of every step within `depth` of the starts.

    One join per step. A node is left again only from the step that first reached it at the smallest depth (ties:
    direction out before in, then edge order), and never along a path that already holds it. starts: question, node;
    edges: head, tail, edge_id, edge_seq, relation, key, confidence."""
    links = incident(edges)
    state = starts.select("question", F.col("node").alias("start"), "node", F.array("node").alias("path_nodes"), F.array().cast("array<string>").alias("path_edges"), F.lit("").alias("__order")).distinct()
    seen = state.select("question", "start", "node")
    found = None
    for d in range(1, depth + 1):
        step = state.join(links, "node").withColumn("depth", F.lit(d))
        order = F.concat("__order", F.lit("/"), F.when(F.col("direction") == "out", "0").otherwise("1"), F.lpad(F.col("edge_seq").cast("string"), 19, "0"))
        step = step.withColumns({"__order": order, "path_edges": F.concat("path_edges", F.array(F.col("edge_id").cast("string")))})
        rows = step.select("question", "start", F.col("node").alias("from_node"), F.col("next").alias("to_node"), "depth", "edge_id", "edge_seq", "direction", "relation", "key", "confidence", "path_edges", F.concat("path_nodes", F.array("next")).alias("path_nodes"), "__order")
        found = rows if found is None else found.unionByName(rows)
        if d < depth:
            fresh = step.where(~F.array_contains("path_nodes", F.col("next")))
            first = F.row_number().over(W.partitionBy("question", "start", "next").orderBy("__order"))
            fresh = fresh.withColumn("__n", first).where("__n = 1").select("question", "start", F.col("next").alias("node"), F.concat("path_nodes", F.array("next")).alias("path_nodes"), "path_edges", "__order")
            state = fresh.join(seen, ["question", "start", "node"], "left_anti")
            seen = seen.unionByName(state.select("question", "start", "node"))
    return found


def evidence(found: DataFrame, keys: Column, most: int = 12) -> DataFrame:
    """The best step per edge of each question: relation match, then least depth, then score, then order; with rank, `most` per question.

    Without relation keys every edge matches. If keys are given and some edge matches, only matching edges and those on the
    way to them stay. found: the steps, with `question_keys` where keys names it."""
    match = (F.size(keys) == 0) | F.array_contains(keys, F.col("key"))
    rows = found.withColumns({"match": match, "score": F.col("confidence") / F.greatest(F.lit(1), "depth") + match.cast("double")})
    w = W.partitionBy("question")
    on_way = rows.where(match).select("question", F.explode("path_edges").alias("edge_id")).distinct().withColumn("__way", F.lit(True))
    best = rows.withColumn("__n", F.row_number().over(W.partitionBy("question", "edge_id").orderBy(F.desc("match"), "depth", F.desc("score"), "start", "__order"))).where("__n = 1")
    best = best.withColumn("__some", F.max("match").over(w)).join(on_way, ["question", "edge_id"], "left")
    kept = best.where((F.size(keys) == 0) | ~F.col("__some") | F.col("match") | F.coalesce("__way", F.lit(False)))
    order = F.row_number().over(w.orderBy(F.desc("match"), "depth", F.desc("score"), "edge_seq"))
    return kept.withColumn("rank", order).where(F.col("rank") <= most).drop("__n", "__some", "__way", "__order")


def path_string(path: Column) -> Column:
    """A -[r]-> B <-[s]- C of an array of (from, relation, direction, to)."""
    step = lambda s: F.concat(F.when(s["direction"] == "out", F.concat(F.lit(" -["), s["relation"], F.lit("]-> "))).otherwise(F.concat(F.lit(" <-["), s["relation"], F.lit("]- "))), s["to"])
    return F.concat(F.element_at(path, 1)["from"], F.array_join(F.transform(path, step), ""))


def link_entities(questions: DataFrame, aliases: DataFrame) -> DataFrame:
    """(question, entity_id, alias_key) of the aliases that stand in the question as whole words.

    Every run of up to as many words as the longest alias has is looked up: an equi-join, not a comparison of all with all. Only runs
    that are an alias are kept to be told apart.
    questions: question, text; aliases: alias_key, entity_id."""
    longest = aliases.agg(F.max(F.size(F.split("alias_key", " ")))).first()[0] or 0
    words = F.filter(F.split(T.alias_key(F.col("text")), " "), lambda w: w != "")
    runs = questions.select("question", words.alias("w")).select("question", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w")))).alias("at"), F.lit(longest).alias("n"))
    runs = runs.where(F.size("w") > 0).select("question", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.col("n"), F.size("w") - F.col("at") + 1)), lambda k: F.array_join(F.slice("w", F.col("at"), k), " "))).alias("alias_key"))
    named = runs.join(aliases.select("alias_key"), "alias_key", "left_semi").select("question", "alias_key").distinct()
    return named.join(aliases, "alias_key").select("question", "entity_id", "alias_key")


def provenance(turn: Column, session: Column, role: Column, speaker: Column, stamp: Column, text: Column, kind: str, quote: Column | None = None, confidence: float = 0.8) -> Column:
    """Where a fact comes from; without a quote of its own it is the turn's text, without a turn there are no turn ids and the time is now."""
    own = T.some(text) if quote is None else F.coalesce(quote, T.some(text))
    ids = F.when(turn.isNotNull(), F.array(turn)).otherwise(F.array().cast("array<long>"))
    return F.struct(session.alias("session_id"), ids.alias("source_turn_ids"), role.alias("role"), speaker.alias("speaker"), F.coalesce(stamp.cast("string"), F.current_timestamp().cast("string")).alias("timestamp"), F.lit(kind).alias("source_type"), own.alias("source_quote"), F.lit(confidence).alias("confidence"))


def edge_labels(edges: DataFrame) -> DataFrame:
    """(head, tail, label): the relations of active edges between two nodes, in order. edges: head, tail, relation, status, edge_seq."""
    active = edges.where("status = 'active'").groupBy("head", "tail").agg(F.array_sort(F.collect_list(F.struct("edge_seq", "relation"))).alias("all"))
    return active.select("head", "tail", F.array_join(F.transform("all", lambda e: e["relation"]), ", ").alias("label"))


def triple_lines(lines: DataFrame) -> DataFrame:
    """lines with head, relation, tail of `a | b | c` lines: three fields, list marks and labels stripped, none empty. lines: line, ..."""
    part = F.transform(F.split("line", r"\|"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"(?i)^(?:[-*]\s*|\d+[.)]\s*)?(?:(?:entity|head|subject|relation(?:ship)?|tail|object)\s*\d*\s*:\s*)?", "")))
    rows = lines.withColumn("part", part).where((F.size("part") == 3) & F.forall("part", lambda x: x != ""))
    return rows.select(*lines.columns, *(F.get("part", F.lit(i)).alias(n) for i, n in enumerate(("head", "relation", "tail")))).drop("part")


def candidate_turns(memories: DataFrame, turns: DataFrame, most: int) -> DataFrame:
    """(question, n, turn columns, quote): the turns from which facts are extracted, best memories first; one per turn and quote, `most` per question.

    memories: question, rank, source_turn_ids, source_quote; turns: turn_id, text, ... A memory whose turn is not there is left out."""
    named = memories.select("question", "rank", F.get("source_turn_ids", F.lit(0)).alias("turn_id"), "source_quote").join(turns, "turn_id")
    named = named.withColumn("quote", F.coalesce(F.nullif("source_quote", F.lit("")), "text")).drop("source_quote")
    first = F.row_number().over(W.partitionBy("question", "turn_id", "quote").orderBy("rank"))
    once = named.withColumn("first", first).where("first = 1").drop("first")
    return once.withColumn("n", F.row_number().over(W.partitionBy("question").orderBy("rank", "turn_id"))).where(F.col("n") <= most).drop("rank")


def traversed(questions: DataFrame, aliases: DataFrame, edges: DataFrame, depth: int = 2, most: int = 12) -> DataFrame:
    """(question, rank, line): the edges around the entities that a question names, as lines of evidence. questions: question, text; edges as in bounded_search."""
    starts = link_entities(questions, aliases).select("question", F.col("entity_id").alias("node")).distinct()
    best = evidence(bounded_search(starts, edges, depth), F.array().cast("array<string>"), most)
    out = F.col("direction") == "out"
    step = F.concat("from_node", F.when(out, F.lit(" -[")).otherwise(F.lit(" <-[")), "relation", F.when(out, F.lit("]-> ")).otherwise(F.lit("]- ")), "to_node")
    return best.select("question", "rank", step.alias("line"))
