"""URL filter: rules first, then gradient-boosted trees on lexical features.

Features come from the URL string alone, in built-in column functions: lengths,
path depth, digit ratio, character entropy, parameter count, host labels,
hyphens, and how often other labelled URLs of the same host suffix are blocked
(a labelled URL's own label is left out of its suffix statistics).  The trees are Spark ML's, trained on at most about ``train_rows`` distinct labelled
URLs, each weighted by its rows (chosen by a hash of the URL, a documented
bound); every URL is judged.

Edge cases: a null URL or one without ``://`` has empty host and path, fits no
rule and gets the method's verdict; with no labelled URL, or labels of one
class only, there is nothing to learn and the verdict is that class (allow
without any); repeated URLs get equal verdicts; very long URLs are judged whole; extra
columns of any name are carried through, but for the names of result columns,
which the results replace; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stage

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
FEATURES = ["f_length", "f_host", "f_path", "f_depth", "f_digits", "f_host_digits", "f_entropy", "f_params",
            "f_labels", "f_hyphens", "f_escapes", "f_tld", "f_domain"]


def host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def longest_rule(h: Column, p: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, nulls if none fits.

    A rule like ``example.net/en/`` fits its host and all subdomains when the
    path starts with the part from its first slash on.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, decision in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = text.partition("/")
        fits = ((h == name) | h.endswith("." + name)) & p.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def _count(c: Column, pattern: str) -> Column:
    return (F.length(c) - F.length(F.regexp_replace(c, pattern, ""))).cast("double")


def _entropy(c: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    n = F.length(c).cast("double")
    count = lambda x: (F.length(c) - F.length(F.replace(c, x, F.lit("")))) / n
    shares = F.transform(F.array_distinct(F.array_remove(F.split(c, ""), "")), count)
    return F.when(n > 0, F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p))).otherwise(0.0)


def lexical(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` plus host, path, suffix columns and the lexical features."""
    u, h, p = F.coalesce(F.col(url), F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(u, r"(?s)^[^?#]*\?([^#]*)", 1)
    labels = F.split(h, r"\.")
    return (df.withColumn("host", host(F.col(url))).withColumn("path", path(F.col(url)))
              .withColumn("_tld", F.element_at(labels, -1))
              .withColumn("_domain", F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2)))
              .withColumn("f_length", F.length(u).cast("double"))
              .withColumn("f_host", F.length(h).cast("double"))
              .withColumn("f_path", F.length(p).cast("double"))
              .withColumn("f_depth", F.size(F.array_remove(F.split(p, "/"), "")).cast("double"))
              .withColumn("f_digits", _count(u, "[0-9]") / F.greatest(F.length(u), F.lit(1)))
              .withColumn("f_host_digits", _count(h, "[0-9]"))
              .withColumn("f_entropy", _entropy(u))
              .withColumn("f_params", F.size(F.array_remove(F.split(query, "&"), "")).cast("double"))
              .withColumn("f_labels", F.size(labels).cast("double"))
              .withColumn("f_hyphens", _count(h, "-"))
              .withColumn("f_escapes", _count(u, "%")))


RESULTS = ["host", "path", "rule", "verdict", "block_score"]
#: labelled rows that the prior counts as in a suffix's rate
PRIOR_ROWS = 10


def suffix_rates(sample: DataFrame, prior: float) -> tuple[DataFrame, list[DataFrame]]:
    """``sample`` (lexical, label, weight) with f_tld and f_domain, each without the
    row's own label; and the rates of all labels, to join to other URLs."""
    tables = []
    for suffix, feature in (("_tld", "f_tld"), ("_domain", "f_domain")):
        sums = sample.groupBy(suffix).agg(F.sum(F.col("label") * F.col("weight")).alias("_bad"), F.sum("weight").alias("_all"))
        rate = lambda bad, all_: (bad + PRIOR_ROWS * prior) / (all_ + PRIOR_ROWS)
        tables.append(sums.select(suffix, rate(F.col("_bad"), F.col("_all")).alias(feature)))
        others = rate(F.col("_bad") - F.col("label") * F.col("weight"), F.col("_all") - F.col("weight"))
        sample = sample.join(F.broadcast(sums), suffix).withColumn(feature, others).drop("_bad", "_all")
    return sample, tables


def judge_urls(df: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]], url: str = "url",
               train_rows: int = 50_000, trees: int = 20, depth: int = 4) -> DataFrame:
    """``df`` with host, path, rule, verdict and block_score.

    ``labelled`` has columns url and label (1 = block, 0 = allow).
    """
    known = labelled.select(F.col("url"), F.col("label").cast("double").alias("label")).filter(
        F.col("url").isNotNull() & F.col("label").isNotNull())
    n, blocked = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    # the rows' own columns wait in a struct, so their names meet no helper's
    every = lexical(df.select(F.struct(*df.columns).alias("_row"), F.col(url).alias("url")))
    rule, decided = longest_rule(F.col("host"), F.col("path"), rules)
    kept = [F.col("_row")[c].alias(c) for c in df.columns if c not in RESULTS]
    chance = F.pmod(F.xxhash64("url"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    distinct = known.select(F.xxhash64("url")).distinct().count()
    chosen = stage(known.filter(chance < F.lit(train_rows / max(distinct, 1)))
                        .groupBy("url", "label").agg(F.count(F.lit(1)).cast("double").alias("weight")))
    low, high = chosen.agg(F.min("label"), F.max("label")).first()
    if blocked in (0, n) or low == high:  # also without any chosen
        only = F.lit("block" if n and 2 * blocked > n else "allow")
        return (every.withColumn("rule", rule).withColumn("block_score", (only == "block").cast("double"))
                     .withColumn("verdict", F.coalesce(decided, only)).select(*kept, *RESULTS))
    prior = float(blocked) / n
    sample, tables = suffix_rates(lexical(chosen), prior)
    for table in tables:  # at most ``train_rows`` suffixes each
        every = every.join(F.broadcast(table), table.columns[0], "left")
    collect = VectorAssembler(inputCols=FEATURES, outputCol="_features")
    trainer = GBTClassifier(featuresCol="_features", labelCol="label", weightCol="weight", predictionCol="_class",
                            maxIter=trees, maxDepth=depth, seed=7)
    trainer = trainer.setRawPredictionCol("_raw").setProbabilityCol("_probability")
    model = trainer.fit(collect.transform(sample))
    scored = model.transform(collect.transform(every.fillna(prior, ["f_tld", "f_domain"])))
    method = F.when(F.col("_class") == 1.0, F.lit("block")).otherwise(F.lit("allow"))
    return (scored.withColumn("rule", rule).withColumn("verdict", F.coalesce(decided, method))
                  .withColumn("block_score", vector_to_array("_probability")[1]).select(*kept, *RESULTS))
