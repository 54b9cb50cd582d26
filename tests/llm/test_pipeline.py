"""The pipeline's stages against brute-force versions, each on its own input, and the queries that have SQL."""

import collections
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ridelattice.llm import neardup, quality, repeats, secrets
from ridelattice.llm.queries import ORACLES, QUERIES
from tests.llm.oracle import duck
from tests.llm.test_operators import brute_simhash
from tests.oracle_check import compare

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF).cache()
        out.append((docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}, made))
        docs = made
    return out


def good(text: str) -> bool:
    w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    if len(w) < 10:
        return False
    n = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for k in range(5)}
    stop = sum(x.lower() in quality.STOP_WORDS for x in w) / len(w)
    return (
        len(covered) <= 0.2 * len(w) and len(re.findall(r"[#*$%&|<>]", text)) <= 0.1 * len(w) and 2 <= sum(map(len, w)) / len(w) <= 15
        and (len(w) < 100 or stop >= 0.02) and 1 - len(set(lines)) / len(lines) <= 0.5)


def test_quality_rules(stages):
    _, docs, out = stages[0]
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {i: t for i, t in docs.items() if good(t)}


def test_near_dedup(stages):
    _, docs, out = stages[1]
    fp, group = {i: brute_simhash(t) for i, t in docs.items()}, {}
    for i in sorted(docs):
        reached = {i}
        while more := {b for a in reached for b in docs if (fp[a] ^ fp[b]).bit_count() <= 4} - reached:
            reached |= more
        group[i] = min(reached)
    assert {r["doc_id"] for r in out.collect()} == set(group.values())


def test_substring_dedup(stages):
    _, docs, out = stages[2]
    seen = set()
    for i, text in sorted({r["doc_id"]: r["text"] for r in out.collect()}.items()):
        assert len(text) <= len(docs[i])
        long = [u for u in repeats.units(text) if len(u.split()) >= repeats.MIN_WORDS]
        for u in long:
            key = " ".join(u.lower().split())
            assert key not in seen
            seen.add(key)
    assert all(" ".join(u.lower().split()) in seen for t in docs.values() for u in repeats.units(t) if len(u.split()) >= repeats.MIN_WORDS)


def test_secret_scans(stages):
    _, docs, out = stages[3]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        spans = secrets._merged((s, e) for _, s, e in secrets.base_spans(text))
        for s, e in reversed(spans):
            text = text[:s] + "[secret]" + text[e:]
        assert got[i] == (text, len(text))


def test_packing(stages):
    columns, docs, out = stages[4]
    rows = out.collect()
    assert {r["doc_id"] for r in rows} == docs.keys()
    for i in docs:
        own = [r for r in rows if r["doc_id"] == i]
        assert sum(r["length"] for r in own) == own[0]["doc_tokens"]


def test_stages_keep_the_columns(stages):
    assert all(c == stages[0][0] for c, _, _ in stages)


def test_run_equals_the_stages(spark, stages):
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    rows = lambda df: sorted(map(tuple, df.select(*key).collect()))
    assert rows(corpus_pipeline.run(spark, SF)) == rows(stages[-1][2])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), duck(SF), ORACLES[name]) is None


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


def test_fingerprints_separate_edits_from_neighbours(spark):
    r = QUERIES["op2_document_fingerprints"](spark, SF).agg(F.avg((F.col("near_edited") > F.col("near_next")).cast("int")), F.count("*")).first()
    assert r[0] > 0.95 and r[1] == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_near_dedup_broadcasts_no_signatures(spark, monkeypatch):
    plans, made = [], neardup.near_links

    def seen(*a):
        links = made(*a)
        links.collect()
        plans.append(links._jdf.queryExecution().executedPlan().toString())
        return links

    monkeypatch.setattr(neardup, "near_links", seen)
    docs = spark.createDataFrame([(i, f"a text of some words that is number {i % 7}", 40) for i in range(20)], "doc_id bigint, text string, n_chars bigint")
    assert 0 < corpus_pipeline.near_dedup(spark, docs, "").count() <= 7
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]
