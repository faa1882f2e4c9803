"""URL verdicts: host and path rules first, boosted trees over lexical features for the rest.

The URLs that a rule decides are the labelled ones; a bounded sample of them
(``TRAIN_ROWS``, the least by hash) trains gradient-boosted trees, whose nodes
are then written out as SQL conditions, so scoring is one pass of built-in
expressions over the rows as they lie.  Suffix statistics are smoothed allow
rates of the host's last label and last two labels over *all* labelled URLs, in
``BUCKETS`` hash buckets each: a table of fixed size.

Defined results: a null URL or one without '://' has empty host and path, no
rule fits it, and the trees judge its (empty) features; of fitting rules the
longest wins; if the labelled URLs are of one kind or absent, the rest get that
kind or 'allow'; repeated rows are judged each; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Verdict, host, path of each rule.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Labelled URLs that trees are fitted on, at most.
TRAIN_ROWS = 20_000
TREES, DEPTH, SEED = 12, 4, 7
#: Hash buckets of suffix statistics, and the weight of the overall rate in each.
BUCKETS, SMOOTH = 512, 5.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path."""
    u = F.coalesce(F.col(url), F.lit(""))
    return pages.withColumn("host", F.translate(F.regexp_extract(u, _PARTS, 1), _UPPER, _LOWER)).withColumn("path", F.regexp_extract(u, _PARTS, 2))


def rule_columns(rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest fitting rule, null if none fits."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))

    def first(value) -> Column:
        fits = [F.when(((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p), F.lit(value(v, h, p))) for v, h, p in ordered]
        return F.coalesce(*fits, F.lit(None).cast("string"))

    return first(lambda v, h, p: h + p), first(lambda v, h, p: v)


def _share(col: Column, pattern: str, of: Column) -> Column:
    return F.regexp_count(col, F.lit(pattern)) / F.greatest(F.length(of), F.lit(1))


def _entropy(col: str) -> Column:
    chars = F.array_distinct(F.filter(F.split(F.col(col), ""), lambda c: c != ""))
    n = F.length(col)
    p = lambda c: (n - F.length(F.replace(F.col(col), c, F.lit("")))) / n
    return F.aggregate(chars, F.lit(0.0), lambda acc, c: acc - p(c) * F.log2(p(c)))


def _suffixes() -> dict[str, Column]:
    return {"tld": F.substring_index("host", ".", -1), "site": F.substring_index("host", ".", -2)}


def _bucket(col: Column) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(BUCKETS)).cast("int")


def lexical_features(url: str = "url") -> dict[str, Column]:
    """Feature name to expression over a URL with its host and path."""
    u = F.coalesce(F.col(url), F.lit(""))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    return {
        "url_length": F.length(u),
        "host_length": F.length("host"),
        "path_length": F.length("path"),
        "depth": F.regexp_count("path", F.lit("/[^/]")),
        "host_labels": F.regexp_count("host", F.lit(r"\.")),
        "digit_ratio": _share(u, "[0-9]", u),
        "host_digit_ratio": _share(F.col("host"), "[0-9]", F.col("host")),
        "hyphens": F.regexp_count(u, F.lit("-")),
        "parameters": F.when(query == "", 0).otherwise(F.regexp_count(query, F.lit("&")) + 1),
        "fragment": u.contains("#").cast("int"),
        "secure": u.startswith("https:").cast("int"),
        "ends_in_slash": F.col("path").endswith("/").cast("int"),
        "extension": F.col("path").rlike(r"\.[A-Za-z0-9]{1,5}$").cast("int"),
        "host_entropy": _entropy("host"),
        "path_entropy": _entropy("path"),
    }


def suffix_rates(labelled: DataFrame) -> dict[str, list[float]]:
    """Smoothed allow rate by hash bucket of each suffix, over all labelled URLs."""
    rate = labelled.agg(F.avg("label")).first()[0]
    base = 0.5 if rate is None else rate
    out = {}
    for name, col in _suffixes().items():
        table = [base] * BUCKETS
        for r in labelled.groupBy(_bucket(col).alias("b")).agg(F.sum("label").alias("y"), F.count(F.lit(1)).alias("n")).collect():  # BUCKETS rows at most
            table[r.b] = (r.y + SMOOTH * base) / (r.n + SMOOTH)
        out[name] = table
    return out


def _condition(node, names: list[str]) -> Column:
    """A tree's node as nested conditions."""
    if node.numDescendants() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(F.col(names[split.featureIndex()]) <= float(split.threshold()), _condition(node.leftChild(), names)).otherwise(_condition(node.rightChild(), names))


def margin(train: DataFrame, names: list[str]) -> Column:
    """Boosted trees fitted on ``train`` (label and features), as a Column whose sign is the verdict."""
    sample = VectorAssembler(inputCols=names, outputCol="features").transform(train).select("label", "features")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, maxBins=64).fit(sample)
    total = F.lit(0.0)
    for tree, weight in zip(model._java_obj.trees(), model.treeWeights):
        total = total + _condition(tree.rootNode(), names) * float(weight)
    return total


def url_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, score (null where a rule decides)."""
    rows = with_parts(pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url")))
    rule, verdict = rule_columns(rules)
    rows = rows.withColumn("rule", rule).withColumn("decided", verdict)
    labelled = rows.filter(F.col("rule").isNotNull()).withColumn("label", (F.col("decided") == "allow").cast("double"))
    rates = suffix_rates(labelled)
    features = {k: v.cast("double") for k, v in lexical_features().items()}
    features |= {f"{k}_rate": F.get(F.array(*[F.lit(float(x)) for x in rates[k]]), _bucket(col)) for k, col in _suffixes().items()}
    sample = labelled.orderBy(F.xxhash64("url", F.lit(SEED)), "url").limit(train_rows).select("label", *[v.alias(k) for k, v in features.items()])
    kinds = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(kinds) == 2:
        scored = rows.select("*", *[v.alias(k) for k, v in features.items()]).withColumn("score", 1 / (1 + F.exp(-2 * margin(sample, list(features)))))
    else:
        scored = rows.withColumn("score", F.lit(float(next(iter(kinds), 1.0))))
    judged = F.when(F.col("score") >= 0.5, "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("decided", judged).alias("verdict"), F.when(F.col("rule").isNull(), F.col("score")).alias("score"))
