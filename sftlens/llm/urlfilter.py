"""URL filters: domain and path rules first, gradient-boosted trees on lexical features for the rest.

DataFrame expressions and Spark ML only; nothing runs in Python on the executors.

A rule is ``host/path-prefix`` with a verdict; it fits its host and all subdomains if the url's
path starts with the rule's, and the longest fitting rule wins.  Other urls get the verdict of
boosted trees over length, depth, digit ratio, entropy, parameter counts, host shape and
suffix statistics (smoothed share of blocked urls, and count, under the host's last two and
last three labels, counted over all labelled urls).  The trees are trained from labelled urls:
a bounded sample of ``TRAIN_ROWS`` of them.  ``weak_labels`` labels urls by words that
public blocklists are sorted by; a caller with a labelled table passes that instead.

Edge cases: a null url, or one without ``://``, has empty host and path; empty path fits no rule
(rule paths start with ``/``); without labelled urls of both classes undecided urls are allowed;
repeated rows get equal results; an empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
# Words of hosts that public blocklists sort under adult, gambling, advertising,
# pharmacy, spam and malware.
BLOCK_WORDS = ("ad", "ads", "adult", "banner", "bet", "bets", "bingo", "bonus", "casino", "cheap", "click", "escort",
               "farm", "jackpot", "loan", "loans", "lottery", "malware", "pharma", "phish", "pills", "poker", "porn",
               "replica", "sex", "slots", "spam", "torrent", "track", "tracker", "viagra", "warez", "win", "xxx")
TRAIN_ROWS = 20_000
TREES, DEPTH = 12, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("url_len", "host_len", "path_len", "depth", "digit_ratio", "entropy", "n_params", "n_labels", "n_hyphens",
            "longest_label", "has_fragment", "is_https", "rate2", "count2", "rate3", "count3")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return (F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER),
            F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null if none fits."""
    rule = verdict = None
    for say, text in sorted(rules, key=lambda r: -len(r[1])):
        domain, _, rest = text.partition("/")
        fits = F.concat(F.lit("."), host).endswith("." + domain) & path.startswith("/" + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, say) if verdict is None else verdict.when(fits, say)
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def weak_labels(host: Column) -> Column:
    """1.0 if a word of the host is a blocklist word, else 0.0."""
    return F.arrays_overlap(F.split(host, r"[^a-z]+"), F.array(*map(F.lit, BLOCK_WORDS))).cast("double")


def lexical(df: DataFrame) -> DataFrame:
    """``df`` (url, host, path) with the lexical features and the host's suffixes."""
    u = F.coalesce(F.col("url"), F.lit(""))
    n = F.length(u)
    count = lambda c, s: F.length(c) - F.length(F.translate(c, s, ""))
    chars = F.array_distinct(F.split(u, ""))
    entropy = F.aggregate(F.transform(chars, lambda c: n - F.length(F.replace(u, c, F.lit("")))), F.lit(0.0),
                          lambda a, k: a - F.when(k > 0, k / n * F.log2(k / n)).otherwise(0.0))
    labels = F.split("host", r"\.")
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    return (df.withColumn("url_len", n.cast("double")).withColumn("host_len", F.length("host").cast("double"))
            .withColumn("path_len", F.length("path").cast("double")).withColumn("depth", count(F.col("path"), "/").cast("double"))
            .withColumn("digit_ratio", F.when(n > 0, count(u, "0123456789") / n).otherwise(0.0))
            .withColumn("entropy", F.when(n > 0, entropy).otherwise(0.0))
            .withColumn("n_params", F.when(F.length(query) > 0, count(query, "&") + 1).otherwise(0).cast("double"))
            .withColumn("n_labels", F.size(labels).cast("double")).withColumn("n_hyphens", count(F.col("host"), "-").cast("double"))
            .withColumn("longest_label", F.array_max(F.transform(labels, F.length)).cast("double"))
            .withColumn("has_fragment", u.contains("#").cast("double")).withColumn("is_https", u.startswith("https://").cast("double"))
            .withColumn("suffix2", F.substring_index("host", ".", -2)).withColumn("suffix3", F.substring_index("host", ".", -3)))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labelled: DataFrame | None = None,
          id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row; score is the trees' probability
    of block (null where a rule decides).  ``labelled``: (url, label 0/1)."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumn("host", host).withColumn("path", path)
    if labelled is None:
        known = rows.where(F.col("host") != "").select("url", "host", "path", weak_labels(F.col("host")).alias("label"))
    else:
        known = labelled.select("url", F.col("label").cast("double").alias("label")).where("url is not null and label is not null") \
            .withColumn("host", host).withColumn("path", path)
    total = known.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("rate")).first()
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = rows.withColumn("rule", rule).withColumn("ruled", verdict)
    if not total.n or total.rate in (0.0, 1.0):
        return ruled.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"),
                            F.lit(None).cast("double").alias("score"))
    # one row per host first: a hot host is one row before any suffix meets in a task
    hosts = Scratch(pages.sparkSession, "url").write(
        known.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("k")), "hosts")
    lexed = lexical(ruled)

    def suffix_stats(df: DataFrame) -> DataFrame:
        for w in (2, 3):
            s = hosts.groupBy(F.substring_index("host", ".", -w).alias(f"suffix{w}")).agg(F.sum("n").alias("n"), F.sum("k").alias("k")) \
                .select(f"suffix{w}", ((F.col("k") + 5 * total.rate) / (F.col("n") + 5)).alias(f"rate{w}"), F.log1p("n").alias(f"count{w}"))
            df = df.join(s, f"suffix{w}", "left").fillna({f"rate{w}": total.rate, f"count{w}": 0.0})
        return df

    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    share = int(min(1.0, TRAIN_ROWS / total.n) * (1 << 30))
    train = lexical(known).where(F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < share)
    model = GBTClassifier(labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=7).fit(
        assemble.transform(suffix_stats(train)).select("features", "label"))
    undecided = model.transform(assemble.transform(suffix_stats(lexed.where("ruled is null"))))
    score = vector_to_array("probability")[1]
    return (lexed.where("ruled is not null").select("id", "host", "path", "rule", F.col("ruled").alias("verdict"), F.lit(None).cast("double").alias("score"))
            .union(undecided.select("id", "host", "path", "rule", F.when(score >= 0.5, "block").otherwise("allow").alias("verdict"), score.alias("score")))
            .withColumnRenamed("id", id_col))
