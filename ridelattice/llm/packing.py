"""Packing message token ids into sequences: first-fit decreasing with a tournament tree, inside random groups."""

from __future__ import annotations

import os
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelattice.llm.text import packed, text_of

SEQUENCE = 4096
#: Id that closes every message.
END = 2
#: UTF-8 bytes of text whose pieces share a group; it bounds a group's memory and sets how many groups there are.
GROUP_BYTES = 16 << 20
#: Pre-tokens whose ids a worker keeps in each of two generations.
CACHE = 400_000
SEED = 11

WORD_VOCABULARY = "word_bpe_49k.json"


def vocabulary(name: str) -> str:
    """Path of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


# Printable ASCII and the Latin-1 letters, on which lower-casing and normal form are plain, beside ASCII white
# space, and the vocabulary's own pre-token pattern, written for lower-case texts of these characters.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ \t-\r]*")
PRE_TOKEN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9 \t-\r]+")


class Learned(dict):
    """What has been learned, in two generations: when the young one is full the old one is dropped, so what is in use stays."""

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most, self.old = most, {}

    def missing(self, keys: set) -> list:
        """Keys that must be learned; those only the old generation knows are taken over."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        keys = keys.difference(self)
        kept = keys.intersection(self.old)
        self.update((k, self.old[k]) for k in kept)
        return list(keys.difference(kept))


class ChunkEncoder:
    """Ids of texts as the tokenizer gives them, one lookup per pre-token.

    The tokenizer's pre-tokens never cross ASCII white space, so ids of a text are those of its runs of other characters in order. A
    text of plain characters is cut into pre-tokens as a whole; new pre-tokens are encoded together and told apart by the word ends
    of the vocabulary. In other texts the plain runs go that way, and the rest to the tokenizer as they are.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.last = np.zeros(1 << 16, bool)
        self.last[[i for word, i in self.tokenizer.get_vocab().items() if word.endswith("</w>")]] = True
        self.parts, self.odd = Learned(CACHE), Learned(CACHE // 8)

    def _learn(self, new: list[str]) -> None:
        lines = [" ".join(new[i : i + 2000]) for i in range(0, len(new), 2000)]
        ids = np.concatenate([np.array(e.ids, "<u2") for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)] or [np.empty(0, "<u2")])
        ends = (2 * np.flatnonzero(self.last[ids]) + 2).tolist()
        if len(ends) != len(new):
            raise ValueError("word ends do not tell the pre-tokens apart")
        flat = ids.tobytes()
        self.parts.update(zip(new, map(flat.__getitem__, map(slice, [0, *ends], ends)), strict=False))

    def _is_plain(self, text: str) -> bool:
        return PLAIN.fullmatch(text) is not None and not ("<|" in text and any(x in text for x in self.special))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """One array of 16-bit ids per text."""
        # stretches of one text: plain ones as lists of pre-tokens, others as they are
        cut: list[list[list[str] | str]] = []
        for t in texts:
            if self._is_plain(t):
                cut.append([PRE_TOKEN.findall(t.lower())])
                continue
            runs, stretches = [r.decode("utf-8", "replace") for r in t.encode("utf-8", "replace").split()], []
            for plain, group in groupby(runs, self._is_plain):
                stretches += [PRE_TOKEN.findall(" ".join(group).lower())] if plain else list(group)
            cut.append(stretches)
        self._learn(self.parts.missing(set().union(*[x for c in cut for x in c if type(x) is list])))
        new = self.odd.missing({x for c in cut for x in c if type(x) is str})
        self.odd.update(zip(new, (np.array(e.ids, "<u2").tobytes() for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)), strict=True))
        part, odd = self.parts.__getitem__, self.odd.__getitem__
        return [np.frombuffer(b"".join(b"".join(map(part, x)) if type(x) is list else odd(x) for x in c), "<u2") for c in cut]


@lru_cache(maxsize=1)
def encoder_for(path: str) -> ChunkEncoder:
    """The worker's encoder, which keeps what it learned from one task to the next."""
    return ChunkEncoder(path)


def _slices(texts: list[str], chars: int) -> Iterator[tuple[int, int]]:
    """Index ranges of texts of about ``chars`` characters together."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _pieces(path: str, groups: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, met = encoder_for(path), Counter()
        for b in batches:
            texts, keys = b["content"].to_pylist(), b["key"].to_pylist()
            for lo, hi in _slices(texts, 1 << 20):
                row, start, length, n_all, ids, part = [], [], [], [], [], []
                for k, got in zip(range(lo, hi), encoder.encode(texts[lo:hi]), strict=True):
                    tokens = np.append(got, np.uint16(END))
                    n = len(tokens)
                    # drawn from the row itself, so that a task run again in another order deals the same pieces
                    draw = random.Random(SEED + 31 * keys[k] + met[keys[k]])
                    met[keys[k]] += 1
                    for s in range(0, n, SEQUENCE):
                        row.append(k)
                        start.append(s)
                        length.append(min(SEQUENCE, n - s))
                        n_all.append(n)
                        ids.append(tokens[s : s + SEQUENCE].tobytes())
                        part.append(draw.randrange(groups))
                longs = [pa.array(x, pa.int64()) for x in (start, length, n_all)]
                yield pa.RecordBatch.from_arrays([b["id"].take(pa.array(row, pa.int32())), *longs, pa.array(ids, pa.binary()), pa.array(part, pa.int64())], names=["id", "start", "length", "message_tokens", "ids", "part"])

    return cut


def first_fit(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """Bin and offset of every size, placed in the given order into the first bin with room.

    A tournament tree holds the room of every bin at its leaves and the largest below at every other node, so the first
    bin that fits is found from the root in log steps. Bins are as many as sizes at most, and unused ones stay whole.
    """
    leaves = 1 << max(0, len(sizes) - 1).bit_length()
    room = [capacity] * (2 * leaves)
    placed = []
    for size in sizes:
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        placed.append((node - leaves, capacity - room[node]))
        room[node] -= size
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return placed


def _fill(part: pa.Table) -> pa.Table:
    size = part["length"].to_numpy()
    order = np.argsort(-size, kind="stable")
    part = part.take(pa.array(order))
    placed = np.array(first_fit(size[order].tolist(), SEQUENCE), np.int64).reshape(-1, 2)
    ids = [np.frombuffer(x, "<u2").astype("<u4").tobytes() for x in part["ids"].to_pylist()]
    sequence = part["part"].to_numpy() * (1 << 32) + placed[:, 0]
    columns = [part["id"], part["start"], part["length"], pa.array(ids, pa.binary()), part["message_tokens"], pa.array(sequence), pa.array(placed[:, 1])]
    return pa.Table.from_arrays(columns, names=["id", "start", "length", "ids", "message_tokens", "sequence_id", "offset"])


def pack_messages(messages: DataFrame, path: str | None = None, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Packs the token ids of all booking messages into sequences of at most 4096.

    ``messages``: rows with ``id`` and ``content``; further columns are ignored, whatever their names. ``path`` is a
    tokenizer file (by default the word vocabulary) of fewer than 65,536 ids. A message is its ids and then id 2, cut at
    every 4096th. One row per piece: ``id``, ``start`` (the message's ids before it), ``length``, ``ids`` (binary,
    little-endian unsigned 32-bit), ``message_tokens``, ``sequence_id``, ``offset`` in its sequence. Sequences have no
    gaps; readers pad them to 4096.

    Pieces are dealt at random (by a hash of id, content, start, and how often a task met the row) into groups of about ``group_bytes`` of text, and each group is packed alone by first-fit
    decreasing: groups are independent tasks of bounded size however long or alike the messages are, and only the last
    sequences of a group have much padding. A null or empty content is the closing id alone; null ids stay null; repeated
    rows are packed each for itself; equal lengths keep no particular order; an empty table gives no rows.
    """
    rows = packed(messages, "id", "content").select("id", text_of(F.col("content")).alias("content"))
    size = rows.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    groups = max(1, -(-size // group_bytes))
    kind = dict(messages.dtypes)["id"]
    keyed = rows.withColumn("key", F.xxhash64("id", "content"))
    pieces = keyed.mapInArrow(_pieces(path or vocabulary(WORD_VOCABULARY), groups), f"id {kind}, start bigint, length bigint, message_tokens bigint, ids binary, part bigint")
    return pieces.groupBy("part").applyInArrow(
        _fill, f"id {kind}, start bigint, length bigint, ids binary, message_tokens bigint, sequence_id bigint, offset bigint")
