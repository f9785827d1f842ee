"""Verdicts on URLs: allow and block rules, and gradient-boosted trees for the rest.

URLs that a rule judges are the labelled examples. Trees are boosted on lexical features of
a bounded sample of them - lengths, depth, digits, entropy, parameters, and how often URLs
of the same suffix are blocked, counted over all labelled rows - and judge every URL that no
rule fits. All of it is DataFrame expressions and Spark's own trees.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.texts import only, stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``allow`` or ``block`` a host with all its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...], part: str) -> Column:
    """The ``name`` or ``verdict`` of the longest rule that fits; null if none does."""
    chosen = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        chosen = F.when(fits, F.lit(getattr(rule, part))).otherwise(chosen)
    return chosen


def _entropy(text: Column) -> Column:
    """Bits a sign, over the signs of the text."""
    size = F.greatest(F.length(text), F.lit(1)).cast("double")
    signs = F.array_distinct(F.split(text, ""))

    def add(total, sign):
        share = (F.length(text) - F.length(F.replace(text, sign))) / size
        return total - F.when((sign != "") & (share > 0), share * F.log2(share)).otherwise(0.0)

    return F.aggregate(signs, F.lit(0.0), add)


def _times(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    text = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    size = F.greatest(F.length(text), F.lit(1)).cast("double")
    return {
        "url_length": F.length(text).cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": _times(path, "/+[^/]"),
        "labels": _times(host, "[^.]+"),
        "hyphens": _times(host, "-"),
        "digit_ratio": _times(text, "[0-9]") / size,
        "host_digits": _times(host, "[0-9]"),
        "path_digits": _times(path, "[0-9]"),
        "parameters": F.when(query == "", 0.0).otherwise(_times(query, "[^&]+")),
        "fragment": F.when(F.contains(text, F.lit("#")), 1.0).otherwise(0.0),
        "secure": F.when(F.lower(text).startswith("https:"), 1.0).otherwise(0.0),
        "entropy": _entropy(text),
        "host_entropy": _entropy(host),
    }


def suffixes(host: Column, path: Column) -> dict[str, Column]:
    """Parts of a URL whose share of blocked URLs is a feature."""
    return {
        "top": F.substring_index(host, ".", -1),
        "domain": F.substring_index(host, ".", -2),
        "first": F.concat_ws("/", F.substring_index(host, ".", -1), F.regexp_extract(path, r"^/+([^/]*)", 1)),
        "ending": F.regexp_extract(path, r"(\.[A-Za-z0-9]{1,8}|/)?$", 1),
    }


def judge_urls(
    df: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    id_column: str = "page_id",
    url_column: str = "url",
    sample_rows: int = 20_000,
    trees: int = 20,
    depth: int = 4,
    seed: int = 7,
) -> DataFrame:
    """A verdict for every URL.

    Returns per row ``id``, ``host``, ``path``, ``rule`` (null if none fits), ``verdict`` and
    ``score`` (the trees' probability of block; null where a rule decides). ``rules`` is a
    short list. If the labelled rows have one verdict only, it is everybody's; without any,
    URLs are allowed. How often a suffix is blocked is counted over all labelled rows. The trees
    alone are trained on a sample: about ``sample_rows`` distinct URLs, chosen by a hash of the URL,
    half of them of each verdict or all that a verdict has. An example weighs as many rows as it
    stands for. A null URL, or one without ``://``, has an empty host and path and is judged by the
    trees. Every row gives one row.
    """
    rows = only(df, {"id": id_column, "url": url_column}).withColumn("url", F.col("url").cast("string"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    host, path = F.col("host"), F.col("path")
    rows = rows.select(
        "*",
        fitting_rule(host, path, rules, "name").alias("rule"),
        fitting_rule(host, path, rules, "verdict").alias("by_rule"),
    )
    labelled = rows.where("by_rule IS NOT NULL").withColumn("label", F.when(F.col("by_rule") == "block", 1.0).otherwise(0.0))
    urls = stored(labelled.groupBy("url", "host", "path", "label").agg(F.count("*").alias("n")), "labelled")
    of_label = {r["label"]: (r["urls"], r["n"]) for r in urls.groupBy("label").agg(F.count("*").alias("urls"), F.sum("n").alias("n")).collect()}
    if len(of_label) < 2:
        only_verdict = "block" if 1.0 in of_label else "allow"
        verdict, score = F.coalesce("by_rule", F.lit(only_verdict)), F.lit(None).cast("double")
        return rows.select("id", "host", "path", "rule", verdict.alias("verdict"), score.alias("score"))

    rate = of_label[1.0][1] / (of_label[0.0][1] + of_label[1.0][1])
    statistics = {}
    for name, part in suffixes(host, path).items():
        blocked = (F.sum(F.col("label") * F.col("n")) + 10 * rate) / (F.sum("n") + 10)
        statistics[name] = stored(urls.groupBy(part.alias(name)).agg(blocked.alias(f"{name}_blocked")), "suffixes")
    shares = {x: min(1.0, max(sample_rows / 2, sample_rows - of_label[1 - x][0]) / of_label[x][0]) for x in of_label}
    share = F.when(F.col("label") == 1.0, shares[1.0]).otherwise(shares[0.0])
    chosen = F.pmod(F.xxhash64("url", F.lit(seed)), F.lit(1 << 40)) < share * float(1 << 40)
    sample = urls.where(chosen).select("url", "host", "path", "label", (F.col("n") / share).alias("weight"))

    def with_features(urls: DataFrame, training: bool = False) -> DataFrame:
        urls = urls.withColumns(suffixes(host, path))
        for name, known in statistics.items():
            # as large as the input may be: broadcast only where Spark measured it small
            urls = urls.join(known, name, "left").drop(name)
            blocked = F.col(f"{name}_blocked")
            if training:
                # half of the examples are taken to have a suffix never seen, as other URLs will
                blocked = F.when(F.pmod(F.xxhash64("url", F.lit(name)), F.lit(2)) == 0, blocked)
            urls = urls.withColumn(f"{name}_blocked", F.coalesce(blocked, F.lit(rate)))
        return urls.withColumns(lexical_features(F.col("url"), host, path))

    names = [*(f"{name}_blocked" for name in statistics), *lexical_features(F.col("url"), host, path)]
    vectors = VectorAssembler(inputCols=names, outputCol="features")
    examples = stored(vectors.transform(with_features(sample, training=True)).select("features", "label", "weight"), "examples")
    boosting = GBTClassifier(weightCol="weight", maxIter=trees, maxDepth=depth, maxBins=32, seed=seed, stepSize=0.3, subsamplingRate=0.8)
    model = boosting.fit(examples)
    undecided = rows.where("by_rule IS NULL")
    judged = model.transform(vectors.transform(with_features(undecided)))
    score = vector_to_array("probability")[1]
    judged = judged.select("id", "host", "path", "rule", F.when(score > 0.5, "block").otherwise("allow").alias("verdict"), score.alias("score"))
    ruled = rows.where("by_rule IS NOT NULL")
    ruled = ruled.select("id", "host", "path", "rule", F.col("by_rule").alias("verdict"), F.lit(None).cast("double").alias("score"))
    return ruled.unionByName(judged)
