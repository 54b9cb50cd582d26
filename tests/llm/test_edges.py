"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for every operator on messages."""

import pytest
from pyspark.sql import functions as F

from ridelattice.llm import bpe, counts, fingerprints, neardup, packing, quality, repeats, secrets
from tests.llm.rows import CLASHES, EDGES, found, messages


def counted(m):
    edits = m.select("id", F.lit(1).alias("seq"), F.lit(0).alias("start"), F.lit(1).alias("n_removed"), F.lit("A ").alias("inserted")).distinct()
    return counts.edited_token_counts(m, edits)


PER_ROW = {
    "quality": quality.message_quality, "fingerprints": fingerprints.message_fingerprints, "groups": neardup.near_groups, "repeats": repeats.without_repeats,
    "secrets": secrets.message_secrets, "bpe": bpe.message_tokens, "counts": counted}
WHOLE = {"good": quality.good_messages, "one_of_each": neardup.one_of_each, "drop_repeats": repeats.drop_repeats, "hide_secrets": secrets.hide_secrets}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_per_message_whatever_the_columns(spark, name):
    plain = found(PER_ROW[name](messages(spark)))
    assert len(plain) == len(EDGES)
    assert found(PER_ROW[name](messages(spark, clash=True))) == plain
    assert sum(r[0] == "None" for r in plain) == 2


@pytest.mark.parametrize("name", [*PER_ROW, *WHOLE, "pack"])
def test_an_empty_table_gives_no_rows(spark, name):
    f = (PER_ROW | WHOLE | {"pack": packing.pack_messages})[name]
    assert f(messages(spark, [])).collect() == []


@pytest.mark.parametrize("name", WHOLE)
def test_filters_keep_all_columns(spark, name):
    m = messages(spark, clash=True)
    out = WHOLE[name](m)
    assert out.columns == m.columns and dict(out.dtypes) == dict(m.dtypes)
    rows = out.collect()
    assert rows and all(r[c] == v for r in rows for c, v in CLASHES.items())


def test_equal_rows_get_equal_results(spark):
    for name, f in PER_ROW.items():
        if name == "counts":
            continue  # one of two equal ids takes the edits
        rows = [tuple(map(str, r)) for r in f(messages(spark)).where("id = 5").collect()]
        assert len(rows) == 2 and rows[0] == rows[1], name


def test_one_of_each_keeps_the_smallest_id(spark):
    kept = [r["id"] for r in neardup.one_of_each(messages(spark)).collect()]
    assert kept.count(1) == 1 and 5 not in kept
    assert kept.count(2) == 1 and 3 not in kept and 4 not in kept  # texts without words are alike
    assert kept.count(None) == 2  # rows without an id stay
    tie = messages(spark, [(4, "a b c d e f"), (4, "a b c d e f"), (9, "a b c d e f")])
    assert [r["id"] for r in neardup.one_of_each(tie).collect()] == [4]


def test_packing_holds_every_id_once(spark):
    rows = packing.pack_messages(messages(spark, clash=True)).collect()
    ids = [r for r in rows if r["start"] == 0]
    assert len(ids) == len(EDGES)
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] and 0 < r["length"] and r["offset"] + r["length"] <= packing.SEQUENCE
    empty = [r for r in rows if r["id"] in (2, 3, 4)]
    assert len(empty) == 3 and all(r["ids"] == b"\x02\0\0\0" and r["message_tokens"] == 1 for r in empty)
