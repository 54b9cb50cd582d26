"""Byte strings that start at two places of the messages: suffix buckets sorted one at a time, ties told apart by difference-cover ranks.

A window is ``length`` bytes inside one text. Windows are dealt to buckets by the least hash of their grams, so equal windows
meet in one bucket and neighbours mostly share theirs: a bucket gets pieces, runs of windows with their text. Pieces whose bucket
holds nothing else are dropped before any text is sent; pieces found twice need no sorting.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridelattice.llm.text import packed, text_of
from ridelattice.session import cut_lineage

LENGTH = 200
#: A perfect difference set; every residue of PERIOD is the difference of two of its members.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Bytes whose hash is compared to choose a window's bucket.
GRAM = 32
#: Windows of a piece, at most.
RUN = 512
#: Pieces that are sorted together; a bucket with more is salted, and its parts are compared by digests afterwards.
GROUP = 1024
#: Buckets that are salted, at most, the fullest first: bounds the table of salts that is broadcast.
SALTED = 1 << 20
#: Bytes of text that a task looks at together.
BLOCK = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


@lru_cache(maxsize=2)
def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    return tuple(np.cumprod(np.concatenate([np.ones(1, _U), np.full(n, x, _U)])) for x in (_U(_BASE), _U(pow(_BASE, -1, 1 << 64))))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


class Hashes:
    """64-bit polynomial hashes of any substrings of a block of bytes."""

    def __init__(self, block: np.ndarray, seed: int = 1) -> None:
        self.up, self.down = _powers(1 << max(16, (len(block) + 1).bit_length()))
        self.sums = np.zeros(len(block) + 1, _U)
        np.cumsum(_table(seed)[block] * self.up[: len(block)], out=self.sums[1:])

    def of(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return _mixed((self.sums[at + size] - self.sums[at]) * self.down[at])

    def grams(self, size: int) -> np.ndarray:
        n = max(0, len(self.sums) - size)
        return _mixed((self.sums[size:] - self.sums[:n]) * self.down[:n])


def _sliding(best: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """``best`` of every ``width`` neighbours, by doubling."""
    span = 1
    while 2 * span <= width:
        x = best(x[:-span], x[span:])
        span *= 2
    return best(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every unit of the counts the index of its count and its place there."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


def pieces(chunks: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with the same bucket: chunk, first window, number of windows, bucket, name, and whether a window may recur inside.

    Chunks have ``length`` bytes or more. The name hashes the whole text of the run, the bucket the least gram, so the two
    together are the run's identity.
    """
    sizes = np.array([len(c) for c in chunks])
    block, first = np.frombuffer(b"".join(chunks), np.uint8), np.cumsum(sizes) - sizes
    hashes, reach = Hashes(block), length - GRAM
    gram = hashes.grams(GRAM)
    low = _sliding(np.minimum, gram, reach + 1)
    whole = np.ones(len(low), bool)
    for e in first[1:]:
        whole[e - length + 1 : e] = False
    turn = np.ones(len(low), bool)
    turn[1:] = (low[1:] != low[:-1]) | (whole[1:] != whole[:-1])
    begin = np.flatnonzero(turn)
    n = np.diff(np.append(begin, len(low)))
    begin, n = begin[whole[begin]], n[whole[begin]]
    of, k = _spread(-(-n // RUN))
    at = begin[of] + k * RUN
    n = np.minimum(n[of] - k * RUN, RUN)
    bucket = low[at]
    # grams that are the least of some window; a run with two of its own may repeat a window
    edge = np.zeros(reach, _U)
    least = np.flatnonzero(_sliding(np.maximum, np.concatenate([edge, np.where(whole, low, _U(0)), edge]), reach + 1) == gram)
    a, b = np.searchsorted(least, at), np.searchsorted(least, at + n + reach)
    of, k = _spread(b - a)
    again = np.bincount(of[gram[least[a[of] + k]] == bucket[of]], minlength=len(at)) > 1
    name = hashes.of(at, n + (length - 1)) + n.astype(_U) * _U(0x94D049BB133111EB)
    chunk = np.searchsorted(first, at, "right") - 1
    return chunk, at - first[chunk], n, bucket.view(np.int64), name.view(np.int64), again


def _blocks(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Chunks of the texts that have a window, in blocks: row, offset, bytes. Long texts are cut, their windows are not."""
    rows, at, chunks, size = [], [], [], 0
    for k, t in enumerate(texts):
        for c in range(0, len(t) - length + 1, BLOCK):
            rows.append(k)
            at.append(c)
            chunks.append(t[c : c + BLOCK + length - 1])
            size += len(chunks[-1])
            if size >= BLOCK:
                yield rows, at, chunks
                rows, at, chunks, size = [], [], [], 0
    if rows:
        yield rows, at, chunks


def _encoded(texts: list[str]) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in texts]


def _cutter(length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, offset, chunks in _blocks(_encoded(b["content"].to_pylist()), length):
                chunk, at, n, bucket, name, again = pieces(chunks, length)
                order = np.lexsort((name, bucket))
                new = np.ones(len(order), bool)
                new[1:] = (bucket[order][1:] != bucket[order][:-1]) | (name[order][1:] != name[order][:-1])
                size = np.diff(np.append(np.flatnonzero(new), len(order)))
                # a piece met again in the block is known to recur; only its first place stands for it outside
                known = np.zeros(len(order), bool)
                known[order[~new]] = True
                seen = np.zeros(len(order), np.int32)
                seen[order[new]] = np.minimum(size, 2)
                row = pa.array(np.array(rows, np.int32)[chunk])
                pos = (at + np.array(offset)[chunk]).astype(np.int32)
                # known pieces take part in no bucket: they travel under values of their own
                alone = _mixed(np.asarray(b["hash"].take(row)).view(_U) + pos.astype(_U) * _U(_BASE)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.where(known, alone, bucket)), pa.array(name), pa.array(seen), pa.array(again), pa.array(n.astype(np.int32)), b["id"].take(row), b["hash"].take(row), pa.array(pos)],
                    names=["bucket", "name", "seen", "again", "windows", "id", "hash", "pos"])

    return cut


def _slicer(length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked = b["asked"]
            of, flat = pc.list_parent_indices(asked), pc.list_flatten(asked)
            texts = _encoded(b["content"].to_pylist())
            text = [texts[k][p : p + w + length - 1] for k, p, w in zip(of.to_pylist(), flat.field("pos").to_pylist(), flat.field("windows").to_pylist(), strict=True)]
            fields = [flat.field(c) for c in ("bucket", "salt", "salts", "name", "partner", "pos", "windows")]
            yield pa.RecordBatch.from_arrays([*fields, b["id"].take(of), b["hash"].take(of), pa.array(text, pa.binary())], names=["bucket", "salt", "salts", "name", "partner", "pos", "windows", "id", "hash", "text"])

    return cut


@lru_cache(maxsize=1)
def _deltas() -> np.ndarray:
    """For two residues the smallest step that takes both into the cover."""
    inside = np.zeros(PERIOD, bool)
    inside[list(COVER)] = True
    both = np.array([[[inside[(a + d) % PERIOD] and inside[(b + d) % PERIOD] for d in range(PERIOD)] for b in range(PERIOD)] for a in range(PERIOD)])
    return both.argmax(axis=2)


def _words(block: np.ndarray) -> np.ndarray:
    """The eight bytes at every place as a big-endian number."""
    n = max(0, len(block) - 7)
    out = np.zeros(n, _U)
    for j in range(8):
        out = (out << _U(8)) | block[j : j + n].astype(_U)
    return out


def _runs_equal(order: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """Number of the run of equal keys that every place of ``order`` is in."""
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return np.cumsum(new)


def cover_ranks(word: np.ndarray, size: int, n: int) -> np.ndarray:
    """Rank of the ``size`` bytes that start at each place of the cover, -1 elsewhere; equal bytes have equal ranks."""
    at = np.arange(n - size + 1)
    at = at[np.isin(at % PERIOD, COVER)]
    keys = [word[at + min(j, size - 8)] for j in range(0, size, 8)]
    order = np.lexsort(keys[::-1])
    rank = np.full(n, -1, np.int64)
    rank[at[order]] = _runs_equal(order, keys)
    return rank


def window_classes(block: np.ndarray, group: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Class of every window ``at`` of a block: equal within a group exactly if the bytes are.

    A bucket's windows are sorted by their first and last 32 bytes. What is tied then is compared by one rank each: the
    difference cover names a step below PERIOD at which both windows meet a ranked place, and the rank's bytes reach from
    the sorted head to the sorted tail.
    """
    word = _words(block)
    keys = [group, *[word[at + j] for j in (0, 8, 16, 24)], *[word[at + length - j] for j in (32, 24, 16, 8)]]
    order = np.lexsort(keys[::-1])
    tie = np.empty(len(at), np.int64)
    tie[order] = _runs_equal(order, keys)
    label, made = np.full(len(at), -1, np.int64), 0
    live = np.arange(len(at))
    rank, delta = cover_ranks(word, length - PERIOD + 1, len(block)), _deltas()
    while len(live):
        live = live[np.argsort(tie[live], kind="stable")]
        first = np.flatnonzero(np.append(True, tie[live][1:] != tie[live][:-1]))
        size = np.diff(np.append(first, len(live)))
        of = np.repeat(np.arange(len(first)), size)
        pivot = at[live[(first + size // 2)[of]]]
        step = delta[at[live] % PERIOD, pivot % PERIOD]
        side = np.sign(rank[at[live] + step] - rank[pivot + step])
        same = side == 0
        label[live[same]] = made + of[same]
        made += len(first)
        side_of = (2 * of + (side > 0))[~same]
        live = live[~same]
        tie[live] = side_of
    return label


def _whole_groups(batches: Iterator[pa.RecordBatch], first: str, second: str, sized: str) -> Iterator[pa.Table]:
    """Sorted rows in tables of about BLOCK bytes of the column ``sized`` that hold all rows of their groups."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        for lo in range(0, b.num_rows, GROUP):
            held.append(b.slice(lo, GROUP))
            size += held[-1][sized].nbytes
            if size < BLOCK:
                continue
            # all but the last group, which may go on
            t = pa.Table.from_batches(held)
            x, y = t[first].to_numpy(), t[second].to_numpy()
            other = np.flatnonzero((x != x[-1]) | (y != y[-1]))
            if len(other):
                cut = int(other[-1]) + 1
                yield t.slice(0, cut).combine_chunks()
                held = t.slice(cut).to_batches()
                size = sum(x[sized].nbytes for x in held)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _sorter(length: int):
    def one(t: pa.Table) -> pa.RecordBatch:
        texts = t["text"].to_pylist()
        sizes, n = np.array([len(x) for x in texts]), t["windows"].to_numpy()
        block, first = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes
        bucket, salt, salts = (t[c].to_numpy() for c in ("bucket", "salt", "salts"))
        group = np.cumsum(np.append(False, (bucket[1:] != bucket[:-1]) | (salt[1:] != salt[:-1])))
        of, k = _spread(n)
        at = first[of] + k
        label = window_classes(block, group[of], at, length)
        many = np.bincount(label)[label] > 1
        asks = ~t["partner"].to_numpy(zero_copy_only=False)[of]
        start = t["pos"].to_numpy()[of] + k
        # runs of repeated windows as spans
        hit = many & asks
        edge = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (hit[1:] != hit[:-1])))
        stop = np.append(edge[1:], len(of)) - 1
        edge, stop = edge[hit[edge]], stop[hit[edge]]
        # a part of a salted bucket shows one window of every class to the other parts, a row per range of digests
        show = np.flatnonzero(salts[of] > 1)
        show = show[np.unique(label[show], return_index=True)[1]]
        high, low = (Hashes(block, seed).of(at[show], length) for seed in (1, 2))
        part = (high % salts[of[show]].astype(_U)).astype(np.int32)
        order = np.lexsort((part, group[of[show]]))
        show, high, low, part = show[order], high[order], low[order], part[order]
        new = np.flatnonzero(np.append(np.ones(min(1, len(show)), bool), (group[of[show]][1:] != group[of[show]][:-1]) | (part[1:] != part[:-1])))
        ids, hashes = t["id"].combine_chunks(), t["hash"].combine_chunks()
        own = pa.array(of[show])
        entries = pa.StructArray.from_arrays(
            [pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), ids.take(own), hashes.take(own), pa.array(start[show].astype(np.int32)), pa.array(~many[show] & asks[show])], names=["high", "low", "id", "hash", "start", "lone"])
        shown = pa.ListArray.from_arrays(pa.array(np.append(new, len(show)).astype(np.int32)), entries)
        row = pa.array(of[edge])
        spans = [ids.take(row), hashes.take(row), pa.array(start[edge].astype(np.int32)), pa.array((start[stop] + length).astype(np.int32))]
        columns = [pa.concat_arrays([c, pa.nulls(len(new), c.type)]) for c in spans]
        columns += [pa.array(np.concatenate([bucket[of[edge]], bucket[of[show[new]]]])), pa.array(np.concatenate([-1 - start[edge].astype(np.int32) % 4093, part[new]]))]
        columns.append(pa.concat_arrays([pa.nulls(len(edge), shown.type), shown]))
        return pa.RecordBatch.from_arrays(columns, names=["id", "hash", "start", "end", "bucket", "part", "shown"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches, "bucket", "salt", "text"):
            if t.num_rows:
                yield one(t)

    return sort


def _meeting(length: int):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The spans found, and lone windows whose digest another part of their bucket has shown."""
        for t in _whole_groups(batches, "bucket", "part", "shown"):
            if not t.num_rows:
                continue
            known = t.filter(pc.is_null(t["shown"])).select(["id", "hash", "start", "end"]).combine_chunks()
            yield from known.to_batches()
            x = pc.list_flatten(t["shown"].combine_chunks())
            if not len(x):
                continue
            high, low = x.field("high").to_numpy(), x.field("low").to_numpy()
            order = np.lexsort((low, high))
            run = _runs_equal(order, [high, low])
            met = order[np.bincount(run)[run] > 1]
            met = pa.array(met[x.field("lone").to_numpy(zero_copy_only=False)[met]])
            start = x.field("start").take(met)
            yield pa.RecordBatch.from_arrays([x.field("id").take(met), x.field("hash").take(met), start, pc.add(start, length).cast(pa.int32())], names=["id", "hash", "start", "end"])

    return meet


def repeated_spans(messages: DataFrame, length: int = LENGTH) -> DataFrame:
    """``id``, ``hash`` (XXH64 of the text), ``start`` and ``end`` of byte spans covered by windows that start at two places; spans may overlap.

    Pieces are told apart by 120 bits or more of hashes, windows of one bucket by their bytes. A task that meets a piece twice
    says so once, so a passage in a third of all texts is a row per task; a bucket of many different pieces is salted, and what
    its parts found is compared by 128-bit digests, one per part and class. Texts are read from one shuffle for both uses.
    """
    return _spans(_rows(messages), messages, length)


def _rows(messages: DataFrame) -> DataFrame:
    return packed(messages, "id", "content").select("id", text_of(F.col("content")).alias("content")).withColumn("hash", F.xxhash64("content"))


def _spans(rows: DataFrame, messages: DataFrame, length: int) -> DataFrame:
    kind = dict(messages.dtypes)["id"]
    found = rows.mapInArrow(_cutter(length), f"bucket bigint, name bigint, seen int, again boolean, windows int, id {kind}, hash bigint, pos int")
    full = found.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).orderBy(F.desc("n")).limit(SALTED)
    full = cut_lineage(full.select("bucket", F.ceil(F.col("n") / GROUP).cast("int").alias("salts")))
    dealt = found.join(F.broadcast(full), "bucket", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    dealt = dealt.withColumn("salt", F.pmod(F.hash("name"), F.col("salts"))).repartition("bucket", "salt")
    piece, group = Window.partitionBy("bucket", "salt", "name"), Window.partitionBy("bucket", "salt")
    n = lambda c: c.cast("int")
    dealt = dealt.withColumn("total", F.sum("seen").over(piece)).withColumn("first", (F.row_number().over(piece.orderBy("hash", "pos")) == 1) & (F.col("seen") > 0))
    dealt = dealt.withColumns({"pieces": F.sum(n(F.col("first"))).over(group), "open": F.sum(n(F.col("first") & (F.col("total") == 1))).over(group), "self": F.max(n(F.col("again"))).over(group)})
    twice = (F.col("seen") == 0) | (F.col("total") > 1)
    asks = F.col("first") & ((F.col("salts") > 1) | ((F.col("open") > 0) & ((F.col("pieces") > 1) | (F.col("self") > 0))))
    hot = cut_lineage(dealt.where(twice | asks).select("bucket", "salt", "salts", "name", "windows", "id", "hash", "pos", twice.alias("twice"), asks.alias("asks")))
    sure = hot.where("twice").select("id", "hash", F.col("pos").alias("start"), (F.col("pos") + F.col("windows") + (length - 1)).alias("end"))
    asked = hot.where("asks").groupBy("id", "hash").agg(F.collect_list(F.struct("bucket", "salt", "salts", "name", F.col("twice").alias("partner"), "pos", "windows")).alias("asked"))
    sliced = _with_texts(rows, asked).mapInArrow(
        _slicer(length), f"bucket bigint, salt int, salts int, name bigint, partner boolean, pos int, windows int, id {kind}, hash bigint, text binary")
    spans = f"id {kind}, hash bigint, start int, end int"
    shown = f"array<struct<high: bigint, low: bigint, id: {kind}, hash: bigint, start: int, lone: boolean>>"
    sorted_ = sliced.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt").mapInArrow(_sorter(length), f"{spans}, bucket bigint, part int, shown {shown}")
    return sure.union(sorted_.repartition("bucket", "part").sortWithinPartitions("bucket", "part").mapInArrow(_meeting(length), spans))


def _with_texts(rows: DataFrame, more: DataFrame, how: str = "inner") -> DataFrame:
    """Rows joined with what is known of their id and text; null ids are equal."""
    more = more.withColumnsRenamed({"id": "_id", "hash": "_hash"})
    return rows.join(more, rows["id"].eqNullSafe(more["_id"]) & (rows["hash"] == more["_hash"]), how).drop("_id", "_hash")


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kept, gone, size = [], [], []
        for text, spans in zip(_encoded(b["content"].to_pylist()), b["spans"].to_pylist(), strict=True):
            runs: list[list[int]] = []
            for s, e in sorted((x["start"], x["end"]) for x in spans or ()):
                if runs and s <= runs[-1][1]:
                    runs[-1][1] = max(e, runs[-1][1])
                else:
                    runs.append([s, e])
            ends = [0, *[x for r in runs for x in r], len(text)]
            kept.append(b"".join(text[ends[i] : ends[i + 1]] for i in range(0, len(ends), 2)))
            gone.append([{"start": s, "length": e - s} for s, e in runs])
            size.append(len(text))
        removed = pa.array(gone, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))
        yield pa.RecordBatch.from_arrays([b["id"], pa.array(size, pa.int64()), removed, pa.array(kept, pa.binary())], names=["id", "n_bytes", "removed", "kept"])


def without_repeated_bytes(messages: DataFrame, length: int = LENGTH) -> DataFrame:
    """Booking messages without the bytes of any ``length``-byte string that starts at another place too, in the same or another message.

    ``messages``: rows with ``id`` and ``content``; further columns are ignored, whatever their names. Contents are taken as UTF-8
    bytes; matches lie inside one content each, overlap freely, and are judged on the input: all their places lose them. ``length``
    is 64 or more. One row per input row: ``id``, ``n_bytes``, ``removed`` (``start`` and ``length`` of every maximal removed run,
    in bytes) and ``kept`` (binary: a removed run may begin inside a character).

    A null content is empty; one shorter than ``length`` stays whole. Equal contents, under one id or several, are two places of
    everything in them; a null id stays null. An empty table gives no rows.
    """
    if length < 64:
        raise ValueError("length must be 64 or more")
    rows = _rows(messages)
    spans = _spans(rows, messages, length).groupBy("id", "hash").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    out = T.StructType([rows.schema["id"], *T._parse_datatype_string("n_bytes bigint, removed array<struct<start: int, length: int>>, kept binary").fields])
    return _with_texts(rows, spans, "left").select("id", "content", "spans").mapInArrow(_remove, out)
