"""Resampling, byte passages and thread repair against brute force, and their small worked cases."""

import collections
import functools
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from ridelattice.llm import repair, resample, suffixes
from tests.llm.rows import EDGES, found, messages, prose

BIG = (1 << 60) + 1


# resampling

def scored(rows, targets, order=1, buckets=100, seed=7):
    """Id, features, weight and score of every row, written out."""
    def feats(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, order + 1) for i in range(len(w) - k + 1)], len(w)

    raw = collections.Counter(x for _, t in rows for x in feats(t)[0])
    goal = collections.Counter(x for t in targets for x in feats(t)[0])
    s, t = sum(raw.values()), sum(goal.values())
    gain = [math.floor(1000 * math.log((goal[b] + 1) * (s + buckets) / ((raw[b] + 1) * (t + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        f, n = feats(text)
        weight = math.floor(sum(gain[x] for x in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    return out


@pytest.mark.parametrize("order", [1, 3])
def test_resampling_against_brute_force(spark, order):
    rows = [(i, prose(i % 40, 5 + i % 60)) for i in range(200)] + EDGES
    targets = [prose(500), None, "Zebra ZEBRA über-cool", ""]
    want = scored(rows, targets, order)
    enough = sorted((r for r in want if r[2] >= 20), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    drawn = [r[4] for r in enough[: 10 * len(enough) // 100]]
    goal = spark.createDataFrame([(t,) for t in targets], "content string")
    got = resample.resampled_messages(messages(spark, rows), goal, order=order, buckets=100, seed=7).collect()
    assert sorted(map(str, [(r["id"], r["n_features"], r["weight"], r["score"]) for r in got])) == sorted(map(str, [(r[0], r[1], r[3], r[4]) for r in want]))
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1)) and [r["score"] for r in ranked] == drawn


def test_ranks_of_many_equal_keys_have_no_holes(spark):
    rows = spark.range(5000).select(F.lit(None).cast("long").alias("id"), F.lit(3).alias("score"))
    ranks = sorted(r["rank"] for r in resample.numbered(rows, F.desc("score"), F.asc_nulls_first("id")).collect())
    assert ranks == list(range(1, 5001))


# byte passages

def without(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[p : p + length] for b in data for p in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out)


def shared_texts():
    rng = random.Random(5)
    base, common = [prose(i, 60) for i in range(5)], "ü€😀 " + prose(99, 12)
    texts = [t for _, t in EDGES if t is None or len(t) < 3000] + ["x" * 900, "x" * 500, "ab " * 200, *base]
    for i in range(60):
        b, kind = rng.choice(base), i % 4
        if kind == 0:
            texts.append(f"{prose(200 + i, 20)} {common} {prose(300 + i, 10)}")
        elif kind == 1:
            at = rng.randint(0, len(b) // 2)
            texts.append(prose(400 + i, 5) + b[at : at + rng.randint(150, 300)] + prose(500 + i, 5))
        elif kind == 2:
            at = rng.randint(0, len(b) - 1)
            texts.append(b[:at] + "#" + b[at + 1 :])
        else:
            texts.append(b)
    return texts


@pytest.mark.parametrize(("length", "group"), [(200, 1024), (64, 1024), (64, 8)])
def test_repeated_bytes_against_brute_force(spark, monkeypatch, length, group):
    monkeypatch.setattr(suffixes, "GROUP", group)
    texts = shared_texts()
    m = messages(spark, [(i % 9 if i % 11 else None, t) for i, t in enumerate(texts)])
    rows = suffixes.without_repeated_bytes(m, length).collect()
    got = sorted((r["n_bytes"], sum(x["length"] for x in r["removed"]), len(r["removed"]), bytes(r["kept"])) for r in rows)
    assert got == without(texts, length)


def test_long_texts_are_cut_and_their_windows_are_not(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 700)
    texts = [prose(1, 400), prose(2, 50) + prose(1, 400)[500:1900], "y" * 5000]
    got = suffixes.without_repeated_bytes(messages(spark, list(enumerate(texts))), 64).collect()
    assert sorted(sum(x["length"] for x in r["removed"]) for r in got) == sorted(x[1] for x in without(texts, 64))


def test_the_cover_meets_every_pair():
    differences = {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER}
    assert differences == set(range(suffixes.PERIOD))
    block = suffixes.np.frombuffer(bytes(random.Random(1).choice(b"ab") for _ in range(400)), suffixes.np.uint8)
    rank = suffixes.cover_ranks(suffixes._words(block), 40, len(block))
    at = [i for i in range(361) if i % suffixes.PERIOD in suffixes.COVER]
    strings = sorted({bytes(block[i : i + 40]) for i in at})
    assert all((rank[i] < rank[j]) == (bytes(block[i : i + 40]) < bytes(block[j : j + 40])) for i in at for j in at) and len(set(rank[at])) == len(strings)


# thread repair

def repaired(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    faults, seen = [], set()
    for _, role, text in rows:
        shown = [c for c in text if c not in " \t\n\v\f\r"]
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}

    @functools.cache
    def best(i, state, inserted):
        role, to = turns[state]
        ways = [(0, "", ())] if i == len(rows) and state in (0, 3) else []
        if inserted < 3:
            c, a, o = best(i, to, inserted + 1)
            ways.append((c + 3, "I" + a, ((role, ""), *o)))
        if i < len(rows):
            _, own, text = rows[i]
            c, a, o = best(i + 1, state, 0)
            ways.append((c + 4, "D" + a, o))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                c, a, o = best(i + 1, to, 0)
                ways.append((c + 3 + more, "R" + a, ((role, text), *o)))
                if own[:1] == role[0] or (own[:1] == "s" and state == 0):
                    c, a, o = best(i + 1, 1 if own[:1] == "s" else to, 0)
                    ways.append((c + more, "K" + a, ((own, text), *o)))
        return min(ways, default=(10**9, "", ()))

    known = {t for t, _, _ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    return (max(known) - min(known) + 1 - len(known) if known else 0, *map(faults.count, ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), *best(0, 0, 0))


def threads(seed, n, longest):
    rng, out = random.Random(seed), {}
    for b in range(n):
        turns = [None] * (rng.random() < 0.2) + sorted(rng.sample(range(2 * longest), rng.randint(1, longest)))
        out[b] = [(t, rng.choice(["user", "assistant"] * 3 + ["system", "tool", ""]), rng.choice(["Hi.", "ok", " ", "", "What?", "yes!", f"x{t}.", f"y{t}"])) for t in turns]
    return out


@pytest.mark.parametrize(("block", "longest"), [(1024, 12), (3, 25)])
def test_repair_against_brute_force(spark, monkeypatch, block, longest):
    monkeypatch.setattr(repair, "BLOCK", block)
    given = threads(block, 60, longest)
    df = spark.createDataFrame([(b, *r) for b, rows in given.items() for r in rows], "booking_id bigint, turn int, sender_role string, content string")
    got = {r["booking_id"]: (*r[1:8], tuple(map(tuple, r["repaired"]))) for r in repair.repaired_threads(df).collect()}
    assert got == {b: repaired(rows) for b, rows in given.items()}


def test_repair_of_odd_rows(spark):
    rows = [(None, 1, "user", "Hi."), (None, 2, "assistant", "Yes."), (1, None, None, None), (BIG, 4, "user", "Hi."), (BIG, 4, "user", "Hi."), (BIG, 9, "assistant", "Yes!")]
    df = spark.createDataFrame([(*r, "s", 1, "z") for r in rows], "booking_id bigint, turn int, sender_role string, content string, code string, row int, role string")
    got = {r["booking_id"]: r for r in repair.repaired_threads(df).collect()}
    assert set(got) == {None, 1, BIG}
    assert got[None]["audit"] == "KK" and got[None]["cost"] == 0
    assert (got[1]["blank"], got[1]["audit"], got[1]["repaired"], got[1]["gaps"]) == (1, "D", [], 0)
    assert (got[BIG]["gaps"], got[BIG]["duplicate"], got[BIG]["illegal"], got[BIG]["audit"], got[BIG]["cost"]) == (4, 1, 1, "KDK", 4)
    assert repair.repaired_threads(df.limit(0)).collect() == []


# common

NEW = {"bytes": suffixes.without_repeated_bytes, "drawn": lambda m: resample.resampled_messages(m, m)}


@pytest.mark.parametrize("name", NEW)
def test_edges(spark, name):
    f = NEW[name]
    plain = f(messages(spark))
    assert plain.count() == len(EDGES) and f(messages(spark, [])).collect() == []
    stable = [c for c in plain.columns if c != "rank"]
    assert found(f(messages(spark, clash=True)).select(stable)) == found(plain.select(stable))
    assert {r["id"] for r in f(messages(spark, [(BIG, prose(1)), (None, "a"), (BIG - 1, "b")])).collect()} == {BIG, None, BIG - 1}
