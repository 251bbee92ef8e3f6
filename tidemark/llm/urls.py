"""URLs judged by rules, and where no rule fits by boosted trees trained on those that one fits.

All of it is DataFrame expressions and MLlib's gradient-boosted trees.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.staging import stage

ALLOW, BLOCK = "allow", "block"
#: Labelled rows that the trees are fitted on, about. All labelled rows count for the statistics.
TRAINING_ROWS = 20_000
TRAINING_PARTITIONS = 4
TREES, DEPTH = 20, 4
#: Labelled rows take their statistics from other folds than their own.
FOLDS = 5
#: Rows that a suffix or directory is thought to have beside its own, with the share of all.
PRIOR_ROWS = 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def _after(url: Column) -> Column:
    """What follows the first `://`; empty if there is none or the url is null."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://((?s:.*))$", 1), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _fits(rule: Rule) -> Column:
    host = (F.col("host") == rule.host) | F.endswith(F.col("host"), F.lit("." + rule.host))
    return host & F.startswith(F.col("path"), F.lit(rule.path))


def judged_by_rules(urls: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Adds `rule` and `label`, of the longest rule that fits; of equally long ones a blocking one."""
    order = sorted(rules, key=lambda r: (-len(r.text), r.verdict != BLOCK, r.text))
    first = lambda value: F.coalesce(
        *(F.when(_fits(r), F.lit(value(r))) for r in order), F.lit(None).cast("string")
    )
    return urls.withColumns({"rule": first(lambda r: r.text), "label": first(lambda r: r.verdict)})


def _entropy(text: Column) -> Column:
    """Bits a character."""
    n = F.length(text)
    kinds = F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)))
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    total = F.aggregate(kinds, F.lit(0.0), lambda bits, c: bits - share(c) * F.log2(share(c)))
    return F.when(n > 0, total).otherwise(0.0)


#: Parts of a URL for which the share of blocked ones among the labelled is a feature.
PARTS = ("last_label", "last_labels", "directory")


def lexical_features(urls: DataFrame) -> tuple[DataFrame, list[str]]:
    """Adds what the URL's text shows, and the parts that statistics are made of."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    rest = F.regexp_extract(_after(url), r"^[^?#]*((?s:.*))$", 1)
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    share = lambda text, pattern: F.when(F.length(text) > 0, count(text, pattern) / F.length(text)).otherwise(0.0)
    features = {
        "url_length": F.length(url).cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": count(path, "/+[^/]"),
        "labels": count(host, r"[^.]+"),
        "digits": share(url, "[0-9]"),
        "path_digits": share(path, "[0-9]"),
        "host_digits": share(host, "[0-9]"),
        "hyphens": count(url, "[-_]"),
        "upper": share(path, "[A-Z]"),
        "escapes": count(url, "%[0-9A-Fa-f]{2}"),
        "parameters": count(rest, r"[?&;][^=&;#]+"),
        "query_length": F.length(rest).cast("double"),
        "entropy": _entropy(url),
        "host_entropy": _entropy(host),
    }
    parts = {
        "last_label": F.regexp_extract(host, r"([^.]*)$", 1),
        "last_labels": F.regexp_extract(host, r"((?:[^.]*\.)?[^.]*)$", 1),
        "directory": F.regexp_extract(path, r"^/([^/]*)/", 1),
    }
    return urls.withColumns(features | parts), list(features)


def _fold() -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), "url", "page_id"), F.lit(FOLDS)).cast("int")


def with_statistics(urls: DataFrame, labelled: DataFrame) -> tuple[DataFrame, list[str]]:
    """Adds, for each part, how many of the labelled URLs have it and the share of blocked ones among them.

    A labelled URL is not counted for itself: it gets the numbers of the folds that it is
    not in, so that trees see statistics as good as those of a URL without a label.
    """
    blocked = F.when(F.col("label") == BLOCK, 1.0).otherwise(0.0)
    overall = labelled.agg(F.coalesce(F.avg(blocked), F.lit(0.0))).first()[0]
    own = lambda column: F.when(F.col("label").isNotNull(), F.get(column, _fold())).otherwise(0.0)
    columns = []
    for part in PARTS:
        rate, rows = f"{part}_rate", f"{part}_rows"
        in_fold = [_fold() == k for k in range(FOLDS)]
        sums = lambda value: F.array(*(F.sum(F.when(f, value).otherwise(0.0)) for f in in_fold))  # noqa: E731, B023
        counts = labelled.groupBy(part).agg(sums(blocked).alias("blocked_in"), sums(F.lit(1.0)).alias("n_in"))
        urls = urls.join(counts, part, "left")
        total = lambda column: F.aggregate(column, F.lit(0.0), lambda a, b: a + b)
        known = {"blocked": total("blocked_in") - own("blocked_in"), "n": total("n_in") - own("n_in")}
        smooth = (known["blocked"] + PRIOR_ROWS * overall) / (known["n"] + PRIOR_ROWS)
        urls = urls.withColumns({rate: F.coalesce(smooth, F.lit(overall)), rows: F.coalesce(F.log1p(known["n"]), F.lit(0.0))})
        urls = urls.drop("blocked_in", "n_in")
        columns += [rate, rows]
    return urls, columns


def fit_trees(labelled: DataFrame, columns: Sequence[str], training_rows: int) -> GBTClassificationModel | None:
    """Trees for the probability of `block`; None unless both labels occur."""
    counts = labelled.agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels")).first()
    if counts["labels"] < 2:
        return None
    # Taken by hash, so that reruns take the same rows.
    modulus = 1 << 30
    kept = F.pmod(F.xxhash64("url", "page_id"), F.lit(modulus)) < int(min(1.0, training_rows / counts["n"]) * modulus)
    vector = VectorAssembler(inputCols=list(columns), outputCol="features")
    rows = labelled.where(kept).withColumn("y", F.when(F.col("label") == BLOCK, 1.0).otherwise(0.0))
    rows = rows.select("y", *columns).repartition(TRAINING_PARTITIONS)
    trees = GBTClassifier(labelCol="y", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, maxMemoryInMB=64)
    return trees.fit(vector.transform(stage(rows, "labelled")))


def filter_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    training_rows: int = TRAINING_ROWS,
) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, score) for every row of `pages`.

    `verdict` is that of the longest rule that fits; else `block` where the trees give a
    probability, `score`, above one half. Without labelled rows all else is allowed, with
    one kind of label all else gets that one; `score` is then null. Null urls and those
    without `://` have an empty host and path and are judged by the trees. Null ids and
    repeated rows are kept; other columns are not read; an empty table gives no rows.
    """
    url = F.col(url_col).cast("string")
    plain = pages.select(
        F.col(id_col).alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path")
    )
    featured, columns = lexical_features(judged_by_rules(plain, rules))
    featured = stage(featured, "urls")
    labelled = featured.where(F.col("label").isNotNull())
    full, more = with_statistics(featured, labelled)
    columns += more
    known = full.where(F.col("label").isNotNull())
    model = fit_trees(known, columns, training_rows)
    if model is None:
        only = labelled.agg(F.max("label")).first()[0] or ALLOW
        verdict, score = F.lit(only), F.lit(None).cast("double")
        judged = featured.withColumns({"guess": verdict, "score": score})
    else:
        from pyspark.ml.functions import vector_to_array

        scored = model.transform(VectorAssembler(inputCols=columns, outputCol="features").transform(full))
        score = vector_to_array("probability")[1]
        judged = scored.withColumn("score", score).withColumn(
            "guess", F.when(F.col("score") > 0.5, BLOCK).otherwise(ALLOW)
        )
    return judged.select(
        "page_id", "url", "host", "path", "rule", F.coalesce("label", "guess").alias("verdict"), "score"
    )
