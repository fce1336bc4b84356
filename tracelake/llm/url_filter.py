"""URL filter: rules for hosts and paths, and gradient-boosted trees on lexical features for the rest.

The trees learn from labelled URLs: those that a rule decides, or any (url, label) of the caller's. Suffix statistics (how
often a host's last labels were blocked) come from all labelled rows; only suffixes with a fair share of
them are kept, so their number is bounded by that share.

A null URL, or one without ://, has an empty host and path; no rule fits it and its features are those of the empty
text. Without labelled rows of both kinds the score is the share of blocked ones (0 without any). Repeated rows get equal
results. Of equally long rules that fit the last by host and path wins; a score of exactly
0.5 blocks. Very long URLs are one row. An empty table gives no rows. Other columns pass through or stay out, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import LOWER, UPPER


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str


#: The rules of the registered query.
RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)


@dataclass(frozen=True)
class Trees:
    """train_rows bounds the labelled URLs that the trees learn from, chosen by hash; a suffix needs ``suffix_share`` of all
    labelled rows, so there are at most 3 / suffix_share of them."""

    rounds: int = 12
    depth: int = 4
    bins: int = 32
    train_rows: int = 20_000
    suffix_share: float = 0.002


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r.host, r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def suffixes(host: Column) -> Column:
    """The last one, two and three labels of a host."""
    return F.array_distinct(F.array(*[F.substring_index(host, ".", -k) for k in (1, 2, 3)]))


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    text = F.coalesce(url, F.lit(""))
    size = F.greatest(F.length(text), F.lit(1))
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    signs = F.split(text, "")
    # bits per character, from the counts of the distinct ones
    share = F.transform(F.array_distinct(signs), lambda c: F.size(F.filter(signs, lambda x: x == c)) / F.size(signs))
    entropy = F.aggregate(share, F.lit(0.0), lambda s, p: s - p * F.log2(p))
    digits = F.length(F.regexp_replace(text, r"[^0-9]", ""))
    first = F.regexp_extract(path, r"^/([^/]*)", 1)
    out = {
        "url_length": F.length(text),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "path_depth": _count(path, "/"),
        "host_depth": _count(host, "."),
        "digit_ratio": digits / size,
        "path_digits": F.length(F.regexp_replace(path, r"[^0-9]", "")),
        "entropy": F.when(F.length(text) > 0, entropy).otherwise(0.0),
        "parameters": F.when(query == "", 0).otherwise(_count(query, "&") + 1),
        "query_length": F.length(query),
        "hyphens": _count(text, "-"),
        "secure": F.when(text.startswith("https"), 1).otherwise(0),
        "fragment": F.when(F.contains(text, F.lit("#")), 1).otherwise(0),
        "extension": F.when(path.rlike(r"\.[A-Za-z0-9]{1,5}$"), 1).otherwise(0),
        "first_length": F.length(first),
        # two letters of the first folder as numbers: trees split on them
        "first_letter": F.ascii(first),
        "second_letter": F.ascii(F.substring(first, 2, 1)),
    }
    return {k: v.cast("double") for k, v in out.items()}


def suffix_rates(labelled: DataFrame, share: float) -> dict[str, float]:
    """Smoothed share of blocked rows per host suffix, from all labelled rows, for suffixes with ``share`` of them or more."""
    each = labelled.select("blocked", F.explode(suffixes(F.col("host"))).alias("suffix"))
    counts = each.groupBy("suffix").agg(F.count("*").alias("n"), F.sum("blocked").alias("k"))
    total = labelled.agg(F.count("*").alias("n"), F.sum("blocked").alias("k")).first()
    base = (total.k or 0) / max(1, total.n)
    # bounded: a row has three suffixes, so at most 3 / share of them reach the threshold
    rows = counts.where(F.col("n") >= F.lit(max(1.0, share * total.n))).collect()
    return {r.suffix: (r.k + 5 * base) / (r.n + 5) for r in rows} | {"": base}


def _with_features(rows: DataFrame, rates: dict[str, float]) -> DataFrame:
    known = F.create_map(*[x for k, v in rates.items() for x in (F.lit(k), F.lit(float(v)))])
    host, path = F.col("host"), F.col("path")
    cols = features(F.col("url"), host, path)
    for k in (1, 2, 3):
        cols[f"suffix_{k}"] = F.coalesce(F.try_element_at(known, F.substring_index(host, ".", -k)), F.lit(float(rates[""])))
    packed = rows.withColumn("__x", F.struct(*[v.alias(k) for k, v in cols.items()]))
    flat = packed.select("*", *[F.col(f"__x.{k}").alias(f"__x_{k}") for k in cols]).drop("__x")
    return VectorAssembler(inputCols=[f"__x_{k}" for k in cols], outputCol="__features").transform(flat).drop(*[f"__x_{k}" for k in cols])


@dataclass(frozen=True)
class Model:
    rates: dict[str, float]
    trees: GBTClassificationModel | None


def train(labelled: DataFrame, how: Trees = Trees()) -> Model:
    """From rows (url, host, path, blocked 0/1)."""
    rates = suffix_rates(labelled, how.suffix_share)
    kinds = {r.blocked: r["count"] for r in labelled.groupBy("blocked").count().collect()}
    if len(kinds) < 2:
        return Model(rates, None)
    fraction = how.train_rows / sum(kinds.values())
    keep = F.pmod(F.xxhash64(F.lit("train"), "url", "__row"), F.lit(1_000_000)) < int(min(1.0, fraction) * 1_000_000)
    rows = _with_features(labelled.withColumn("__row", F.col("row") if "row" in labelled.columns else F.lit(0)).where(keep), rates)
    gbt = GBTClassifier(featuresCol="__features", labelCol="blocked", maxIter=how.rounds, maxDepth=how.depth, maxBins=how.bins, stepSize=0.3, seed=11, cacheNodeIds=False)
    return Model(rates, gbt.fit(rows.select("__features", F.col("blocked").cast("double").alias("blocked"))))


def score(rows: DataFrame, model: Model) -> DataFrame:
    """All columns of rows (with url, host, path) and score: the chance that the URL is one to block."""
    if model.trees is None:
        return rows.withColumn("score", F.lit(float(model.rates[""])))
    ready = _with_features(rows, model.rates)
    trees = model.trees.setRawPredictionCol("__raw").setProbabilityCol("__chance").setPredictionCol("__class")
    return trees.transform(ready).withColumn("score", F.element_at(vector_to_array("__chance"), 2)).drop("__features", "__raw", "__chance", "__class")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, how: Trees = Trees()) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, score): the verdict is the rule's, else that of the trees."""
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("fits", rule_of(F.col("host"), F.col("path"), rules))
    labelled = rows.where("fits is not null").select("url", "host", "path", F.col("page_id").alias("row"), F.when(F.col("fits.verdict") == "block", 1).otherwise(0).alias("blocked"))
    scored = score(rows, train(labelled, how))
    verdict = F.coalesce("fits.verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "url", "host", "path", F.col("fits.rule").alias("rule"), verdict.alias("verdict"), "score")
