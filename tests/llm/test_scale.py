"""Ids beyond doubles, long texts and hot units."""

import time

import pytest
from pyspark.sql import functions as F

from ridelattice.llm import bpe, counts, html, neardup, packing, repeats, secrets
from tests.llm.rows import messages, prose

BIG = (1 << 60) + 1


def edited(m):
    edits = m.where("id IS NOT NULL").select("id", F.lit(1).alias("seq"), F.lit(0).alias("start"), F.lit(1).alias("n_removed"), F.col("id").cast("string").alias("inserted"))
    return counts.edited_token_counts(m, edits)


@pytest.mark.parametrize("f", [bpe.message_tokens, packing.pack_messages, secrets.message_secrets, neardup.near_groups, edited, repeats.without_repeats])
def test_ids_beyond_doubles_stay_beside_nulls(spark, f):
    rows = [(BIG, prose(1)), (BIG - 1, prose(2)), (None, prose(3)), (7, "")]
    assert {r["id"] for r in f(messages(spark, rows).coalesce(1)).collect()} == {BIG, BIG - 1, None, 7}


def test_an_edit_goes_to_its_own_id(spark):
    got = {r["id"]: r["content"] for r in edited(messages(spark, [(BIG, "xa"), (BIG - 1, "xb"), (None, "xc")]).coalesce(1)).collect()}
    assert got == {BIG: f"{BIG}a", BIG - 1: f"{BIG - 1}b", None: "xc"}


def test_page_ids_stay(spark):
    pages = spark.createDataFrame([(BIG, "u", "<p>One.</p>"), (None, None, None)], "page_id bigint, url string, html string").coalesce(1)
    assert {r["page_id"] for r in html.page_texts(pages, html.train([])).collect()} == {BIG, None}


def test_assignments_by_the_thousand_take_linear_time():
    text = "".join(f"password=Hunter{i}x client_id=u00{i}\n" for i in range(40_000))
    t = time.time()
    strong = secrets.base_spans(text)
    weak = secrets.weak_parts(text, strong)
    assert len(strong) == 40_000 and len(weak) >= 40_000 and time.time() - t < 10


def test_deep_pages_take_linear_time():
    t = time.time()
    assert [x for _, x in html.Dom("<div>" * 20_000 + "a" + "</div>" * 20_000 + "</nav>" * 2000).segments] == ["a"]
    assert time.time() - t < 5


@pytest.mark.parametrize(("page", "texts"), [
    ("<p>a</p><button>b<p>z</p>", ["a", "b", "z"]), ("<div><select><option>x</div><p>z</p></select>", ["z"]), ("<p>a</p><canvas>no</canvas><p>z</p>", ["a", "z"]),
    ("<p>if <math>x</math> holds</p>", ["if x holds"]), ("<p>a</p><script>if (a < b) '</p>'</script><p>z</p>", ["a", "z"]), ("<div><object><div>x</div></div><p>z</p></object>", ["z"])])
def test_hidden_elements_end(page, texts):
    assert [t for _, t in html.Dom(page).segments] == texts


def test_a_unit_in_most_messages_is_joined_in_salts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 10)
    line = prose(1, 30)
    rows = [(i, f"{prose(i + 10, 30)}\n{line}\n{prose(i + 500, 30)}") for i in range(60)]
    got = {r["id"]: r for r in repeats.without_repeats(messages(spark, rows)).collect()}
    assert line in got[0]["content"] and all(line not in got[i]["content"] and len(got[i]["removed"]) == 1 for i in range(1, 60))


def test_unspaced_passages_go(spark):
    passage = "车站北门开放时间为早上六点到晚上十点请提前到达" * 8 + "\n"
    got = {r["id"]: r["content"] for r in repeats.without_repeats(messages(spark, [(1, passage + "甲"), (2, "乙\n" + passage + "丙")])).collect()}
    assert got == {1: passage + "甲", 2: "乙\n丙"}


def test_packing_deals_the_same_pieces_in_any_order(spark):
    import pyarrow as pa

    rows = [(i % 5, i % 7, prose(i % 3, 2000)) for i in range(40)]

    def deal(order):
        b = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*order, strict=True)], names=["id", "key", "content"])
        return sorted(tuple(r.values()) for out in packing._pieces(packing.vocabulary(packing.WORD_VOCABULARY), 9)(iter([b])) for r in out.to_pylist())

    same = [(k, k, t) for k, (_, _, t) in enumerate(rows)]
    assert deal(same) == deal(same[::-1])
    again = [(1, 1, prose(1))] * 5
    assert deal(again) == deal(again) and len({r[5] for r in deal(again)}) > 1


def test_words_in_use_survive_a_full_cache(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 50)
    e = packing.ChunkEncoder(packing.vocabulary(packing.WORD_VOCABULARY))
    for i in range(30):
        texts = [prose(i), "naïve “quoted” ü€😀 <|endoftext|> don't"]
        want = [x.ids for x in e.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        assert [x.tolist() for x in e.encode(texts)] == want
    assert len(e.parts) + len(e.parts.old) < 1200


def test_signatures_are_shuffled_however_few(spark):
    """Their size is taken for that of the fingerprints they come from, so nothing may be broadcast on its account."""
    rows = spark.createDataFrame([(i * 77,) for i in range(50)], "fingerprint bigint")
    links = neardup.near_links(rows)
    found_ = {tuple(r) for r in links.collect()}
    assert found_ == {(a * 77, b * 77) for a in range(50) for b in range(a + 1, 50) if (a * 77 ^ b * 77).bit_count() <= neardup.RADIUS}
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
