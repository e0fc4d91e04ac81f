"""Operator 10: URL filtering by fixed rules and by mined association rules.

Mining: each labelled URL is a transaction of tokens (host suffixes, path steps) and its label; tokens that are always together count as one; Spark's
FP-growth finds the token combinations that are frequent together with the label. A combination becomes a rule if its
support is high enough, most of its rows are bad by more than chance gives among all combinations tried, and no part of it is as confident. Matching: rules are held as an inverted index
token -> (rule, tokens needed); a URL's tokens are looked up and a rule fires if all its tokens were met.

Fixed rules come first: a rule (host, path) fits its host, all subdomains, and paths that start with its path; the
longest that fits decides.

Defined results: a null URL or one without :// has an empty host and path, no rule and no tokens, and is allowed;
repeated rows are judged alike; without labels nothing is mined and all else is allowed; an empty table gives no row;
further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anamnesis.llm.common import materialize
from anamnesis.llm.decontaminate import LOWER, UPPER

#: Rules up to which the inverted index is broadcast; `mine` finds no more than support allows, some thousands.
MOST = 100_000
LABEL = "\x00block"


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null or without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: each suffix of the host, each step of the path without its number."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    steps = F.transform(F.filter(F.split(path, r"[/.]"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, r"[0-9]+", "0")))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(suffixes, steps)))


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. rules: (verdict, host, path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for how, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(how)).otherwise(verdict)
    return rule, verdict


def mine(urls: DataFrame, support: float = 0.002, confidence: float = 0.5, lift: float = 1.5, least: int = 10, chance: float = 0.05) -> DataFrame:
    """(tokens, confidence, support, lift) of the rules that block. urls: (url, bad boolean), bad null for unlabelled rows.

    Counts cover every labelled row. A rule needs `least` rows besides its share of them: with fewer rows than that, every
    set of tokens of a single URL would be frequent. Its share of bad rows must be above `confidence` and above the share of
    all rows, so far that chance gives any such rule, among all frequent sets of tokens, with a probability of at most `chance`
    (Chernoff's bound of the binomial tail, Bonferroni's correction)."""
    from pyspark.ml.fpm import FPGrowth

    host, path = parts(F.col("url"))
    rows = urls.where(F.col("bad").isNotNull()).select(tokens(host, path).alias("items"), "bad").where(F.size("items") > 0)
    rows = materialize(rows.select(F.monotonically_increasing_id().alias("no"), "items", "bad"), "baskets")
    schema = "tokens array<string>, confidence double, support double, lift double"
    n = rows.count()
    if n < least:
        return urls.sparkSession.createDataFrame([], schema)
    kinds = materialize(token_classes(rows, n, max(support, least / n)), "classes")
    items = rows.select("no", "bad", F.explode("items").alias("token")).join(kinds.select(F.explode("members").alias("token"), "name"), "token")
    baskets = items.groupBy("no", "bad").agg(F.collect_set("name").alias("items"))  # some tokens of one URL
    baskets = materialize(baskets.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(LABEL)))).otherwise(F.col("items")).alias("items")), "reduced")
    share_bad = rows.where("bad").count() / n
    reduced = baskets.count()
    if not reduced:
        return urls.sparkSession.createDataFrame([], schema)
    # Shares are of all labelled rows, also those without a token that is frequent.
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(support, least / n) * n / reduced), minConfidence=confidence).fit(baskets)
    found = model.associationRules.where(F.element_at("consequent", 1) == LABEL).select(F.array_sort("antecedent").alias("names"), "confidence", (F.col("support") * reduced / n).alias("support"))
    found = materialize(found.withColumn("lift", F.col("confidence") / share_bad).where(F.col("lift") >= lift), "rules")
    tried = model.freqItemsets.where(~F.array_contains("items", LABEL)).count()
    usual = min(max(confidence, share_bad), 1 - 1e-12)
    share, rest = F.col("confidence"), 1 - F.col("confidence")
    excess = share * F.log(share / usual) + F.when(rest > 0, rest * F.log(rest / (1 - usual))).otherwise(0.0)
    found = found.where(share > usual).where(F.col("support") / share * n * excess >= math.log(max(tried, 1) / chance))
    found = materialize(shortest(found), "shortest")
    named = found.select("*", F.explode("names").alias("name")).join(kinds, "name").groupBy("names", "confidence", "support", "lift").agg(F.array_sort(F.flatten(F.collect_list("members"))).alias("tokens"))
    return named.select("tokens", "confidence", "support", "lift")


def token_classes(rows: DataFrame, n: int, support: float) -> DataFrame:
    """(name, members): frequent tokens, those that are in the same rows together under the name of the smallest. Tokens of all rows say nothing.

    So only closed sets are mined: without this, each step that a host's URLs have in common would double the number of frequent sets."""
    each = rows.select("no", F.explode("items").alias("token"))
    marks = [F.sum(F.xxhash64("no", F.lit(i)).cast("decimal(20,0)")).alias(f"h{i}") for i in (1, 2)]
    held = each.groupBy("token").agg(F.count("*").alias("n"), *marks).where((F.col("n") >= support * n) & (F.col("n") < n))
    return held.groupBy("n", "h1", "h2").agg(F.array_sort(F.collect_list("token")).alias("members")).select(F.col("members")[0].alias("name"), "members")


def shortest(found: DataFrame) -> DataFrame:
    """Without the rules that hold all names of another one that is as confident: those say nothing new.

    A rule is looked for under its rarest name only, so rules with a common name in common don't all meet."""
    each = found.select("names", "confidence", F.explode("names").alias("t"))
    often = each.groupBy("t").agg(F.count("*").alias("often"))
    part = each.join(often, "t").groupBy("names", "confidence").agg(F.min_by("t", F.struct("often", "t")).alias("t"))
    part = part.select(F.col("names").alias("part"), F.col("confidence").alias("c"), "t")
    within = (F.size("part") < F.size("names")) & (F.col("c") >= F.col("confidence")) & (F.size(F.array_except("part", "names")) == 0)
    return found.join(part.join(each, "t").where(within).select("names").distinct(), "names", "left_anti")


def judge(pages: DataFrame, rules: DataFrame, fixed: list[tuple[str, str, str]], key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, mined (the tokens of the most confident mined rule that fires, or null)."""
    host, path = parts(F.col(url))
    rows = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    numbered = materialize(rules.select(F.xxhash64("tokens").alias("no"), "tokens", "confidence"), "numbered")
    index = numbered.select("no", "tokens", "confidence", F.size("tokens").alias("need"), F.explode("tokens").alias("token"))
    if numbered.count() <= MOST:
        index = F.broadcast(index)
    # Equal sets of tokens are looked up once: pages of one site are many, their token sets few.
    sets = rows.select(tokens(F.col("host"), F.col("path")).alias("set")).distinct()
    met = sets.select("set", F.explode("set").alias("token")).join(index, "token").groupBy("set", "no").agg(F.count("*").alias("n"), F.first("need").alias("need"), F.first("confidence").alias("confidence"), F.first("tokens").alias("tokens"))
    fired = met.where("n = need").groupBy("set").agg(F.max_by("tokens", F.struct("confidence", "no")).alias("mined"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), fixed)
    judged = rows.withColumn("set", tokens(F.col("host"), F.col("path"))).join(fired, "set", "left")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("mined").isNotNull(), F.lit("block")).otherwise("allow")).alias("verdict"), "mined")
