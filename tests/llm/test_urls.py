"""URL parts and rules against a plain version; trees by held-out accuracy."""

import math
import random

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tidemark.llm.queries import URL_RULES
from tidemark.llm.urls import (
    Rule, filter_urls, fit_trees, host_of, judged_by_rules, lexical_features, path_of, with_statistics,
)

COLUMNS = "page_id long, url string"


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best and best.host + best.path, best and best.verdict


def judged(spark, rows, rules=URL_RULES, **options):
    df = spark.createDataFrame(rows, COLUMNS).withColumns(
        {c: F.lit("x") for c in ("host", "path", "label", "rule", "digits", "features", "prediction")}
    )
    return filter_urls(df, rules, **options).collect()


def made_urls(rng, n):
    for i in range(n):
        tld, lang = rng.choice(["org", "com", "net"]), rng.choice(["en", "fr", "de", "es"])
        host = rng.choice(["", "www.", "m."]) + rng.choice(["ab", "cd", "x-y"]) + rng.choice([".example.", "."]) + tld
        tail = rng.choice(["", "/", ".html", "?page=2&ref=x", "#top"])
        yield i, f"{rng.choice(['http', 'https'])}://{host}/{lang}/{rng.randrange(40000)}{tail}"


EDGES = [
    (1, None), (2, ""), (3, "no scheme.org/"), (4, "HTTP://EXAMPLE.ORG/es/1"), (5, "http://org/"), (6, "x://a.org"),
    (7, "x://a.org?q=/"), (8, "x://notexample.org/es/"), (9, "x://example.org/ES/"), (10, "a://b.com://c.org/de/"),
    (11, "x://www.example.org/en/1?y"), (None, "x://b.com/fr/\n?a=b&c=d;e"), (None, "x://b.com/fr"), (12, "x://#org/"),
    (12, "x://#org/"), (13, "x://É.org/É%C3%A9"), (14, "://com/de/"), (15, "x://" + "a" * 50_000 + ".com/de/"),
]


def test_parts_and_rules(spark):
    rows = EDGES + list(made_urls(random.Random(1), 200))
    got = judged(spark, rows)
    key = lambda r: repr(r)
    assert sorted(((r["page_id"], r["url"], r["host"], r["path"], r["rule"]) for r in got), key=key) == sorted(
        ((page, url, *plain(url)[:3]) for page, url in rows), key=key
    )
    assert all(r["verdict"] == plain(r["url"])[3] for r in got if r["rule"])
    assert {r["verdict"] for r in got} == {"allow", "block"}


def test_trees_learn_from_labelled_urls(spark):
    """Rules label some hosts; the trees have to carry the pattern, digits in the path, to others."""
    rng = random.Random(3)
    rows, truth = [], {}
    for i in range(900):
        bad = rng.random() < 0.5
        path = f"/{rng.randrange(10**9)}?id={rng.randrange(99)}" if bad else "/about/our/team"
        host = f"h{rng.randrange(40)}.{'seen' if i % 3 else 'new'}"
        rows.append((i, f"https://{host}{path}"))
        truth[i] = "block" if bad else "allow"
    rules = [Rule("seen", "/about", "allow"), *(Rule("seen", f"/{d}", "block") for d in "0123456789")]
    unseen = [r for r in judged(spark, rows, rules) if r["rule"] is None]
    assert len(unseen) == 300
    assert sum(r["verdict"] == truth[r["page_id"]] for r in unseen) > 270


def test_held_out_accuracy_on_given_urls(spark):
    """A third of the URLs that a rule labels are hidden from statistics and trees."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    plain_urls = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    featured, columns = lexical_features(judged_by_rules(plain_urls, URL_RULES))
    featured = featured.where("label IS NOT NULL").withColumn("truth", F.col("label"))
    hidden = F.pmod(F.xxhash64("url"), F.lit(3)) == 0
    featured = featured.withColumn("label", F.when(~hidden, F.col("label"))).cache()
    full, more = with_statistics(featured, featured.where("label IS NOT NULL"))
    columns = columns + more
    model = fit_trees(full.where("label IS NOT NULL"), columns, 20_000)
    scored = model.transform(VectorAssembler(inputCols=columns, outputCol="features").transform(full.where("label IS NULL")))
    right = scored.agg(F.avg(((F.col("prediction") == 1) == (F.col("truth") == "block")).cast("int")), F.count("*")).first()
    assert right[1] > 300 and right[0] > 0.95


def test_statistics_leave_out_a_rows_own_fold(spark):
    """One of its kind: a labelled row learns nothing from itself, an unlabelled one learns from it."""
    rows = [(i, f"https://a.com/x/{i}", "allow") for i in range(50)]
    rows += [(100, "https://b.odd/y/1", "block"), (101, "https://b.odd/y/2", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, label string")
    df = df.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    featured, _ = lexical_features(df)
    full, _ = with_statistics(featured, featured.where("label IS NOT NULL"))
    got = {r["page_id"]: r for r in full.collect()}
    overall = 1 / 51
    assert got[100]["directory_rate"] == pytest.approx(overall) and got[100]["directory_rows"] == 0
    assert got[101]["directory_rate"] == pytest.approx((1 + 20 * overall) / 21)
    assert all(0 < got[i]["directory_rows"] < math.log1p(50) for i in range(50))


@pytest.mark.parametrize("rules, verdict", [([], "allow"), ([Rule("org", "/", "block")], "block")])
def test_one_label_or_none(spark, rules, verdict):
    got = judged(spark, [(1, "x://a.org/b"), (2, "x://a.net/b"), (3, None)], rules)
    assert {r["verdict"] for r in got} == {verdict} and all(r["score"] is None for r in got)


def test_empty(spark):
    assert judged(spark, []) == []


def test_reruns_agree(spark):
    rows = list(made_urls(random.Random(4), 400))
    one, other = (sorted(map(tuple, judged(spark, rows, training_rows=100))) for _ in range(2))
    assert [r[:6] for r in one] == [r[:6] for r in other]
