"""The pipeline against a brute-force version of each stage, and the registered SQL on a fixture."""

import hashlib
import re
import zlib

import duckdb
import pytest

import corpus_pipeline
from lagweave.llm import bpe, quality, registry, token_shards
from lagweave.llm.shared import shared_dir

from .test_operators import brute_components, shingles, texts, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark):
    path = f"{shared_dir(spark)}/fixture".removeprefix("file:")
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts(2))]
    spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, f"http://h{i}.org/en/{i}", (t or "") * 5) for i, t in enumerate(texts(2))], "page_id long, url string, html string").write.mode("overwrite").parquet(f"{path}/pages.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{path}/labels.parquet")
    return path


def test_registered_queries(spark, folder):
    """Each query as registered: a row per document or page, and what the contract derives from ids."""
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {name: query(spark, folder).collect() for name, query in registry.QUERIES.items()}
    for name in ("op1_quality_rules", "op2_bpe", "op5_exact_dedup", "op6_substring_dedup", "op7_ngram_join", "op8_language_id", "op10_source_mixing"):
        assert sorted(r.doc_id for r in got[name]) == sorted(rows), name
    for name in ("op3_warc", "op9_url_filters"):
        assert sorted(r.page_id for r in got[name]) == sorted(rows), name
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got["op8_language_id"])
    assert all(r.lang_pred in ("en", "und") and 0 <= r.score <= 1 for r in got["op8_language_id"])
    assert {r.doc_id for r in got["op8_language_id"] if r.lang_pred == "und"} == {i for i, t in rows.items() if not any(c.isalpha() for c in t or "")}
    groups, _ = brute_components({i: shingles(t, 3) for i, t in rows.items()}, 90, 100)
    assert {r.doc_id: r.component_id for r in got["op7_ngram_join"]} == groups
    assert all(r.n_words == len(words(rows[r.doc_id])) for r in got["op1_quality_rules"] + got["op6_substring_dedup"])
    assert all(r.host == f"h{r.page_id}.org" and r.path == f"/en/{r.page_id}" and r.rule is None and r.verdict == "allow" for r in got["op9_url_filters"])
    shards = got["op4_token_shards"]
    order = token_shards.Permutation(len(shards))
    assert sorted(r.slot for r in shards) == list(range(len(shards))) and all(order.slots([r.sequence])[0] == r.slot for r in shards)


def test_sql_agrees(spark, folder):
    c = duckdb.connect()
    for name in ("documents", "pages"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    for name, sql in registry.SQL.items():
        got = registry.QUERIES[name](spark, folder)
        cols = sorted(got.columns)
        clean = lambda rows: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)
        key = lambda rows: sorted(map(repr, rows))
        mine = [tuple(round(r[c_], 6) if isinstance(r[c_], float) else r[c_] for c_ in cols) for r in got.collect()]
        theirs = [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in c.execute(f"SELECT {', '.join(cols)} FROM ({sql}) AS q").fetchall()]
        assert key(mine) == key(theirs), name


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    good = {r.doc_id for r in quality.repetition_rules(docs).where("kept").collect()}
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", rows[i].text or "") for i in good}
    unique = {i for i in good if i == min(j for j in good if norm[j] == norm[i])}
    groups, _ = brute_components({i: shingles(rows[i].text, 5) for i in unique}, 80, 100)
    near = {i for i in unique if groups[i] == i}
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, folder).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        seen.append(docs)
        if name != "bpe":
            assert sorted(docs.columns) == sorted(rows[0].asDict())
    ids = [{r.doc_id for r in d.collect()} for d in seen]
    assert ids[0] == good and ids[1] == unique and ids[2] == near and ids[3] <= near
    size = sum(len(words(rows[i].text)) for i in near)
    assert sum(len(words(r.text)) for r in seen[3].collect()) >= 1.5 * size - 1
    v = bpe.vocabulary(bpe.default_vocabulary())
    assert v.size == 50257 and seen[4].count() == seen[3].count()
    want = {i: hashlib.sha256((rows[i].text or "").encode()).hexdigest() for i in near}
    assert all(r.decoded_sha256 == want[r.doc_id] for r in seen[4].collect())


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0
