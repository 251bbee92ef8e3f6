"""The registered corpus queries on the given tables: against their SQL, or a plain version."""

import hashlib
import zlib

import duckdb
import pytest

from tests.llm import (
    test_decontaminate, test_pages, test_quality, test_repeats, test_resample, test_secrets, test_simhash, test_urls,
)
from tests.test_oracle import SF, TABLES, TYPES, rows_of
from tidemark.llm.queries import LLM_ORACLE, LLM_QUERIES

MORE_TYPES = TYPES | {"boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", list(LLM_ORACLE))
def test_query(spark, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = LLM_QUERIES[name](spark, SF)
    result = duck.execute(LLM_ORACLE[name])
    columns = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    assert {f.name: MORE_TYPES[f.dataType.simpleString()] for f in df.schema.fields} == types
    got, expected = rows_of(df.columns, df.collect()), rows_of(columns, result.fetchall())
    assert sorted(got) == sorted(expected)
    assert got


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def rows(spark, name, *columns):
    df = LLM_QUERIES[name](spark, SF)
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=repr)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1(spark, docs):
    expected = test_simhash.plain_groups(docs)
    assert rows(spark, "op1_simhash") == expected
    assert len({c for _, _, c in expected}) < len(docs)


def test_op2(spark, docs):
    got = LLM_QUERIES["op2_language_id"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(d for d, _ in docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in got if r["held_out"]]
    assert sum(langs[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.95 * len(held) > 0


def test_op3(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = rows(spark, "op3_html_extraction", "page_id", "url", "text", "n_chars")
    texts = {page: test_pages.article(r["html"]) for page, r in pages.items()}
    assert got == sorted(((p, pages[p]["url"], t, len(t)) for p, t in texts.items()), key=repr)


def test_op4(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()
    got = LLM_QUERIES["op4_url_filters"](spark, SF).collect()
    expected = {r["page_id"]: test_urls.plain(r["url"]) for r in pages}
    assert len(got) == len(pages)
    for r in got:
        host, path, rule, verdict = expected[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")


def test_op6(spark, docs):
    expected = test_repeats.plain(docs)
    assert rows(spark, "op6_suffix_dedup", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == expected
    assert any(r[2] for r in expected)


def test_op7(spark, docs):
    expected = sorted(((d, *test_quality.plain(t)) for d, t in docs), key=repr)
    assert rows(spark, "op7_quality_rules", "doc_id", *test_quality.BASE) == expected


def test_op8(spark, docs):
    expected = []
    for doc, text in docs:
        found = test_secrets.plain(text)
        written = ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in found)
        expected.append((doc, *(sum(s[2] == k for s in found) for k in ("assign", "access", "hex")), digest(written)))
    columns = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    assert rows(spark, "op8_secret_scans", *columns) == sorted(expected, key=repr)


def test_op9(spark, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    expected = [
        (doc, words, hit, len(ids), digest(",".join(ids)), bad)
        for doc, words, hit, ids, bad in test_decontaminate.plain(docs, items)
    ]
    assert rows(spark, "op9_decontamination") == sorted(expected, key=repr)
    assert any(r[-1] for r in expected)


def test_op11(spark, docs):
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    expected = test_resample.plain(docs, items)
    assert rows(spark, "op11_importance_resampling") == expected
    assert any(r[-1] for r in expected)
