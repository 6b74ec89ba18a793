"""URL filter: host and path rules, and gradient-boosted trees on lexical features where no rule fits.

Everything is DataFrame and SQL: features are expressions, the trees are trained by the DataFrame-based ML library of
Spark on a bounded sample of labelled URLs, and are then written out as CASE expressions, so that scoring is part of
whole-stage code. The labelled URLs are those that a rule decides (or those of a table of labels, if one is given).

Statistics of suffixes are over all labelled URLs. What a URL is trained on leaves its own fold out of them, so that its
label is not among its features.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Labelled URLs of each class that the trees are trained on, at most.
ROWS_PER_CLASS = 10_000
#: Most suffixes whose statistics are broadcast; more are joined by a shuffle.
SMALL = 100_000
#: Folds of the labelled URLs, and how many labels the mean rate counts as in a suffix's rate.
FOLDS, PRIOR = 5, 8
TREES, DEPTH, BINS, STEP = 12, 4, 32, 0.3


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lowered; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(of_host: Column, of_path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, of equally long ones the least; null if none does."""
    found = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((of_host == r.host) | of_host.endswith("." + r.host)) & of_path.startswith(r.path)
        value = F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _entropy(text: Column) -> Column:
    """Bits a character, from the counts of the characters of the text."""
    n = F.length(text).cast("double")
    part = F.transform(F.array_distinct(F.split(text, "")), lambda c: F.length(text) - F.length(F.replace(text, c, F.lit(""))))
    sums = F.aggregate(F.filter(part, lambda f: f > 0), F.lit(0.0), lambda s, f: s + f * F.log2(f.cast("double")))
    return F.when(n > 0, F.log2(n) - sums / n).otherwise(0.0)


def features(url: Column, of_host: Column, of_path: Column) -> dict[str, Column]:
    text, query = F.coalesce(url, F.lit("")), F.coalesce(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.lit(""))
    n = F.greatest(F.length(text), F.lit(1))
    digits = lambda x: F.length(x) - F.length(F.translate(x, "0123456789", ""))
    return {
        "length": F.length(text),
        "host_length": F.length(of_host),
        "path_length": F.length(of_path),
        "depth": _count(of_path, "/"),
        "labels": _count(of_host, "."),
        "hyphens": _count(of_host, "-"),
        "host_digits": digits(of_host),
        "digit_ratio": digits(text) / n,
        "entropy": _entropy(text),
        "host_entropy": _entropy(of_host),
        "parameters": F.when(F.length(query) > 0, _count(query, "&") + 1).otherwise(0),
        "assigned": _count(query, "="),
        "fragment": F.coalesce(F.contains(url, F.lit("#")), F.lit(False)).cast("int"),
        "secure": F.coalesce(F.startswith(url, F.lit("https:")), F.lit(False)).cast("int"),
    }


def suffix(of_host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(of_host, ".", -2)


def fold(url: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(11), url), F.lit(FOLDS)).cast("int")


def _statistics(n: Column, blocked: Column, share: float) -> dict[str, Column]:
    """Of a suffix with so many labelled URLs, of which so many are blocked; ``share``: that of all labels."""
    return {"suffix_count": F.log1p(n), "suffix_rate": (blocked + PRIOR * share) / (n + PRIOR)}


def _as_sql(node: object, names: list[str]) -> str:
    if node.getClass().getSimpleName() == "LeafNode":
        return repr(float(node.prediction())) + "D"
    split = node.split()
    return f"CASE WHEN `{names[split.featureIndex()]}` <= {float(split.threshold())!r}D THEN {_as_sql(node.leftChild(), names)} ELSE {_as_sql(node.rightChild(), names)} END"


def _described(pages: DataFrame, url_col: str, rules: tuple[Rule, ...]) -> DataFrame:
    """The caller's columns in one struct, so that none can clash, and what is read from the URL."""
    url = F.col(url_col)
    df = pages.select(F.struct(*pages.columns).alias("_row"), url.alias("_url"), host(url).alias("_host"), path(url).alias("_path"))
    return df.withColumn("_rule", fitting_rule(F.col("_host"), F.col("_path"), rules))


def judge(pages: DataFrame, url_col: str = "url", rules: tuple[Rule, ...] = RULES, labels: DataFrame | None = None) -> DataFrame:
    """``pages`` with host, path, rule and verdict (allow or block), and ``block_margin`` (the trees' sum, above 0: block).

    ``labels``: optional labelled URLs (url, block 0/1); default: the URLs that a rule decides. Without labelled URLs of
    both kinds the verdict where no rule fits is the only kind there is, or allow. A null URL has an empty host and
    path and is judged as an empty one. Repeated rows keep a row each; columns of the names returned are replaced; an
    empty table gives an empty table.
    """
    kept = pages.drop("host", "path", "rule", "verdict", "block_margin")
    described = _described(kept, url_col, rules)
    if labels is None:
        known = described.where("_rule is not null").select("_url", "_host", "_path", (F.col("_rule.verdict") == "block").cast("int").alias("_block"))
    else:
        known = labels.where("block in (0, 1)").select(F.col("url").alias("_url"), host(F.col("url")).alias("_host"), path(F.col("url")).alias("_path"), F.col("block").cast("int").alias("_block"))
    known = known.where("_url is not null").distinct()
    sample = [known.where(F.col("_block") == k).orderBy(F.xxhash64("_url"), "_url").limit(ROWS_PER_CLASS) for k in (0, 1)]
    train = sample[0].unionByName(sample[1])
    for name, value in features(F.col("_url"), F.col("_host"), F.col("_path")).items():
        train = train.withColumn(name, value.cast("double"))
        described = described.withColumn(f"_x_{name}", value.cast("double"))
    train = cut_lineage(train.withColumn("_suffix", suffix(F.col("_host"))).withColumn("_fold", fold(F.col("_url"))))
    sizes = {r["_block"]: r["n"] for r in known.groupBy("_block").agg(F.count("*").alias("n")).collect()}
    trees: list[str] = []
    if len(sizes) == 2:
        # over all labelled URLs, not the sample alone: of all folds, and of each
        share = sizes[1] / (sizes[0] + sizes[1])
        own = [F.col("_fold") == i for i in range(FOLDS)]
        counted = cut_lineage(
            known.withColumn("_suffix", suffix(F.col("_host"))).withColumn("_fold", fold(F.col("_url"))).groupBy("_suffix").agg(
                F.count("*").alias("_n"), F.sum("_block").alias("_b"),
                F.array(*(F.sum(x.cast("long")) for x in own)).alias("_ns"), F.array(*(F.sum(F.when(x, F.col("_block")).otherwise(0)) for x in own)).alias("_bs"),
            )
        )
        few = counted.count() <= SMALL
        out_of_fold = _statistics(F.col("_n") - F.col("_ns")[F.col("_fold")], F.col("_b") - F.col("_bs")[F.col("_fold")], share)
        train = train.join(F.broadcast(counted) if few else counted, "_suffix").withColumns(out_of_fold)
        rates = counted.select("_suffix", *(x.alias(c) for c, x in _statistics(F.col("_n"), F.col("_b"), share).items()))
        rates = F.broadcast(rates) if few else rates
        names = [*features(F.col("_url"), F.col("_host"), F.col("_path")), "suffix_count", "suffix_rate"]
        vectors = VectorAssembler(inputCols=names, outputCol="features").transform(train)
        model = GBTClassifier(labelCol="_block", featuresCol="features", maxIter=TREES, maxDepth=DEPTH, maxBins=BINS, stepSize=STEP, seed=5).fit(vectors)
        trees = [f"{w!r}D * ({_as_sql(t._call_java('rootNode'), [f'_x_{x}' for x in names])})" for w, t in zip(map(float, model.treeWeights), model.trees)]
        described = (
            described.withColumn("_suffix", suffix(F.col("_host"))).join(rates, "_suffix", "left")
            .withColumn("_x_suffix_count", F.coalesce("suffix_count", F.lit(0.0))).withColumn("_x_suffix_rate", F.coalesce("suffix_rate", F.lit(share)))
        )
    constant = 1.0 if set(sizes) == {1} else -1.0
    margin = F.expr(" + ".join(trees)) if trees else F.lit(constant)
    return described.select(
        *(F.col("_row")[c].alias(c) for c in kept.columns), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.when(margin > 0, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), margin.alias("block_margin"),
    )
