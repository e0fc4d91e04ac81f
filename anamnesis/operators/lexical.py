"""BM25 over postings: corpus statistics, scores, normalised candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from anamnesis.functions import text as T
from anamnesis.functions.numbers import places

K1, B = 1.5, 0.75
#: Decimals at which normalised scores are compared: below them is the order of sums.
DECIMALS = 9


def tokenised(docs: DataFrame, key: str, text: str, scope: str | None = None) -> DataFrame:
    """(scope), key, tokens, doc_len."""
    own = [scope] if scope else []
    return docs.select(*own, F.col(key).alias("doc"), T.retrieval_tokens(F.col(text)).alias("tokens")).withColumn("doc_len", F.size("tokens"))


def corpus_stats(tokens: DataFrame, scope: str | None = None) -> DataFrame:
    """n_docs and total_len per scope (all documents count, also those without tokens)."""
    own = [scope] if scope else []
    return tokens.groupBy(*own).agg(F.count("*").alias("n_docs"), F.sum("doc_len").alias("total_len"))


def document_frequencies(tokens: DataFrame, scope: str | None = None) -> DataFrame:
    """In how many documents each token is. Distinct within a row, so only counts are shuffled."""
    own = [scope] if scope else []
    return tokens.select(*own, F.explode(F.array_distinct("tokens")).alias("token")).groupBy(*own, "token").agg(F.count("*").alias("df"))


def bm25(docs: DataFrame, questions: DataFrame, doc_key: str, doc_text: str, question_key: str, question_text: str, scope: str | None = None) -> DataFrame:
    """(question, doc, score) of every document that shares a token with the question.

    Only postings of tokens that some question has leave their document's row: the explode is cut by the join on the
    question vocabulary before anything is shuffled by document. A token of its own in each document carries the statistics of
    the corpus; counts, frequencies and statistics all read every column of one aggregate, so texts are read and tokenised once."""
    own = [scope] if scope else []
    every = F.lit("\x00")
    tokens = tokenised(docs, doc_key, doc_text, scope)
    asked = questions.select(*own, F.col(question_key).alias("question"), F.explode(F.array_distinct(T.retrieval_tokens(F.col(question_text)))).alias("token"))
    vocabulary = asked.select("token").unionAll(asked.sparkSession.range(1).select(every.alias("token"))).distinct()
    postings = tokens.select(*own, "doc", "doc_len", F.explode(F.concat("tokens", F.array(every))).alias("token")).join(vocabulary, "token", "left_semi")
    tf = postings.groupBy(*own, "doc", "doc_len", "token").agg(F.count("*").alias("tf"))
    read = F.col("doc").isNull() | (F.col("doc_len") + F.col("tf") > 0)  # always true: no column is pruned away before the exchange
    df = tf.groupBy(*own, "token").agg(F.count_if(read).alias("df"))
    here = read & (F.col("token") == every)
    stats = tf.groupBy(*own).agg(F.sum(F.when(here, F.col("tf"))).alias("n_docs"), F.sum(F.when(here, F.col("doc_len") * F.col("tf"))).alias("total_len"))
    met = tf.join(df, [*own, "token"]).join(asked, [*own, "token"])
    met = met.join(stats, own) if own else met.crossJoin(F.broadcast(stats))  # stats of the whole corpus are one row
    n, d = F.col("n_docs").cast("double"), F.col("df").cast("double")
    idf = F.log(1.0 + (n - d + 0.5) / (d + 0.5))
    average = F.greatest(F.lit(1.0), F.col("total_len") / F.greatest(F.lit(1), F.col("n_docs")))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / average))
    return met.groupBy(*own, "question", "doc").agg(F.sum(part).alias("score"))


def lexical_candidates(scores: DataFrame, k: int) -> DataFrame:
    """Scores over the question's largest one, the k best of each question; ties, at DECIMALS, by document."""
    w = W.partitionBy("question")
    rank = F.row_number().over(w.orderBy(places(F.col("lexical_score"), DECIMALS).desc(), "doc"))
    top = scores.where("score > 0").withColumn("lexical_score", F.col("score") / F.max("score").over(w))
    return top.withColumn("rank", rank).where(F.col("rank") <= k)
