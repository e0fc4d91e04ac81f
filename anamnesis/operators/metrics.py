"""Answer and ranking metrics, judge accuracy, run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anamnesis.functions import text as T

KS = (1, 5, 10)


def local_metrics(rows: DataFrame, key: str, prediction: str, references: str) -> DataFrame:
    """key, exact_match, contains_reference, token_f1: the best over the references (an array); blank ones don't count."""
    p, r = F.col(prediction), F.col("reference")
    each = rows.select(key, prediction, F.explode_outer(references).alias("reference")).withColumns({"np": T.answer_text(p), "nr": T.answer_text(r)})
    real = F.col("nr") != ""
    best = lambda c: F.coalesce(F.max(F.when(real, c)), F.lit(0.0))
    return each.groupBy(key).agg(best((F.col("np") == F.col("nr")).cast("double")).alias("exact_match"), best(F.col("np").contains(F.col("nr")).cast("double")).alias("contains_reference"), best(T.token_f1(p, r)).alias("token_f1"))


def ranked_sessions(ranking: DataFrame, question: str, pos: str, session: str) -> DataFrame:
    """(question, session, session_rank): sessions by first occurrence, gapless."""
    from pyspark.sql import Window as W

    first = ranking.where(F.col(session).isNotNull()).groupBy(question, session).agg(F.min(pos).alias("first"))
    return first.withColumn("session_rank", F.row_number().over(W.partitionBy(question).orderBy("first", session))).drop("first")


def discount(rank: Column) -> Column:
    """Ranks 1 and 2 count in full."""
    return F.when(rank <= 1, 1.0).otherwise(1 / F.log2(rank.cast("double")))


def session_metrics(ranked: DataFrame, gold: DataFrame, questions: DataFrame, question: str = "question_id", session: str = "session", ks: tuple[int, ...] = KS) -> DataFrame:
    """A row per question and k: recall_any, recall_all (strict), ndcg, eligible, exclusion_reason.

    Questions that ask for abstention or have no gold session are not eligible and have null metrics."""
    g = gold.select(question, session).where(F.col(session).isNotNull()).distinct()
    sizes = g.groupBy(question).agg(F.count("*").alias("n_gold"))
    hits = ranked.join(g, [question, session]).groupBy(question).agg(F.collect_list("session_rank").alias("hits"))  # at most the gold sessions of one question
    rows = questions.select(question).distinct().join(sizes, question, "left").join(hits, question, "left").select("*", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    top = F.filter(F.coalesce("hits", F.array().cast("array<int>")), lambda r: r <= F.col("k"))
    dcg = F.aggregate(top, F.lit(0.0), lambda s, r: s + discount(r))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("k"), F.col("n_gold").cast("int"))), F.lit(0.0), lambda s, r: s + discount(r))
    reason = F.when(F.col(question).cast("string").contains("_abs"), "abstention_question").when(F.col("n_gold").isNull(), "no_answer_session_labels")
    fit = reason.isNull()
    return rows.select(question, "k", fit.alias("eligible"), reason.alias("exclusion_reason"), F.when(fit, (F.size(top) > 0).cast("double")).alias("recall_any"), F.when(fit, (F.size(top) == F.col("n_gold")).cast("double")).alias("recall_all"), F.when(fit, dcg / ideal).alias("ndcg"))


def macro_average(metrics: DataFrame, kind: str) -> DataFrame:
    """Means over eligible questions, for all and per type (null type: all), with the count of excluded ones."""
    return metrics.groupingSets([["k"], ["k", kind]], "k", kind).agg(F.sum(F.col("eligible").cast("long")).alias("n_eligible"), F.sum((~F.col("eligible")).cast("long")).alias("n_excluded"), F.avg("recall_any").alias("recall_any"), F.avg("recall_all").alias("recall_all"), F.avg("ndcg").alias("ndcg"))


def answer_session_recall(gold: Column, found: Column) -> Column:
    """Struct of matched, missing, coverage, any_hit, all_hit; without gold sessions coverage is 1, all_hit true, any_hit false."""
    g, f = F.array_distinct(gold), F.array_distinct(found)
    matched = F.array_intersect(g, f)
    coverage = F.when(F.size(g) == 0, 1.0).otherwise(F.size(matched) / F.size(g))
    return F.struct(F.array_sort(matched).alias("matched"), F.array_sort(F.array_except(g, f)).alias("missing"), coverage.alias("coverage"), (F.size(matched) > 0).alias("any_hit"), (coverage == 1.0).alias("all_hit"))


def judge_accuracy(judged: DataFrame, kind: str, label: str, abstains: Column) -> DataFrame:
    """One row: micro accuracy, the mean of the types' accuracies, accuracy on abstention questions, the count."""
    per = judged.groupBy(kind).agg(F.avg(F.col(label).cast("double")).alias("a"), F.sum(F.col(label).cast("long")).alias("right"), F.count("*").alias("n"), F.sum(F.when(abstains, F.col(label).cast("long"))).alias("abs_right"), F.sum(abstains.cast("long")).alias("abs_n"))
    return per.agg((F.sum("right") / F.sum("n")).alias("overall"), F.avg("a").alias("task_averaged"), (F.sum("abs_right") / F.nullif(F.sum("abs_n"), F.lit(0))).alias("abstention"), F.sum("n").alias("n"))


def judge_summary(results: DataFrame) -> DataFrame:
    """One row: processed, failures, total_judge_seconds, avg_judge_seconds. results: elapsed_seconds, failed; seconds that are not there count as none."""
    seconds = F.coalesce(F.sum(F.coalesce("elapsed_seconds", F.lit(0.0))), F.lit(0.0))
    average = F.when(F.count("*") > 0, seconds / F.count("*")).otherwise(0.0)
    return results.agg(F.count("*").alias("processed"), F.count_if(F.coalesce("failed", F.lit(False))).alias("failures"), seconds.alias("total_judge_seconds"), average.alias("avg_judge_seconds"))
