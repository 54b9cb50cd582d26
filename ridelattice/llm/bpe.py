"""Byte-level BPE of message texts: greedy longest matches are proposed, adjacent pairs verified, and only failing words merged."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelattice.llm.packing import _slices, vocabulary
from ridelattice.llm.text import packed, text_of

BYTE_VOCABULARY = "byte_bpe_50k.json"
#: Pieces and words whose ids a worker keeps; beyond it starts again. Longer words are merged exactly at once.
CACHE, LONG = 900_000, 64
# Fixed value: the vocabulary's pre-token pattern.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_RUN = re.compile(r"\s ")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary, as letter to byte.

    Printable bytes stand for themselves; the others take the letters from 256 on, in order.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Token bytes, merges and the tables for vectorised look-ups, from a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        letters = byte_letters()
        ids = told["model"]["vocab"]
        raw = lambda token: bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        n = max([*ids.values(), *self.special.values()]) + 1
        self.bytes = [b""] * n
        for token, i in ids.items():
            self.bytes[i] = raw(token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.byte_id = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.byte_id[b] = ids[c]
        # a merged token's age is its merge's place; single bytes are older than all
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        self.age = np.full(n, -1, np.int64)
        self.left, self.right = np.arange(n), np.arange(n)
        for place, pair in enumerate(told["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, z = ids[a], ids[b], ids[a + b]
            self.merged[x, y] = (place, z)
            if self.age[z] < 0:
                self.age[z], self.left[z], self.right[z] = place, x, y
        pairs = sorted((x << 32 | y, place) for (x, y), (place, _) in self.merged.items())
        self.pair_keys, self.pair_age = (np.array(c, np.int64) for c in zip(*pairs, strict=True))
        self._trie([(i, self.bytes[i]) for i in ids.values()])

    def _trie(self, tokens: list[tuple[int, bytes]]) -> None:
        step: dict[int, int] = {}
        token = [-1]
        for i, word in tokens:
            node = 0
            for b in word:
                node = step.setdefault(node << 8 | b, len(token))
                if node == len(token):
                    token.append(-1)
            token[node] = i
        keys = sorted(step)
        self.step_keys, self.step_to = np.array(keys, np.int64), np.array([step[k] for k in keys], np.int64)
        self.node_token = np.array(token, np.int64)

    def pair_place(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place of the merge of each pair; a huge one where the pair never merges."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_age[at], 1 << 40)

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word number and token of the greedy longest matches of all words, in order."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words) + b"\0", np.uint8).astype(np.int64)
        pos = np.cumsum(size) - size
        end = pos + size
        word, out_w, out_t = np.flatnonzero(size), [], []
        pos = pos[word]
        while len(word):
            node, at, best, best_at = np.zeros(len(word), np.int64), pos.copy(), np.full(len(word), -1), pos.copy()
            live = np.arange(len(word))
            while len(live):
                key = node[live] << 8 | flat[at[live]]
                k = np.minimum(np.searchsorted(self.step_keys, key), len(self.step_keys) - 1)
                on = self.step_keys[k] == key
                live = live[on]
                node[live] = self.step_to[k[on]]
                at[live] += 1
                whole = live[self.node_token[node[live]] >= 0]
                best[whole], best_at[whole] = self.node_token[node[whole]], at[whole]
                live = live[at[live] < end[word[live]]]
            out_w.append(word)
            out_t.append(best)
            on = best_at < end[word]
            word, pos = word[on], best_at[on]
        if not out_w:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        w, t = np.concatenate(out_w), np.concatenate(out_t)
        order = np.argsort(w, kind="stable")
        return w[order], t[order]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging ever leaves tokens ``a`` and ``b`` side by side, for each pair.

        The merges that made both are undone, latest first. The parts that then face each other across the border must
        not be a pair whose merge comes before the one just undone, for then it would have been made across the border.
        A border pair on a tie in place goes to the left, where merging begins.
        """
        a, b, good = a.copy(), b.copy(), np.ones(len(a), bool)
        # merges at the border are made only if strictly before ``until``; ``late`` is where both parts are whole
        live, until = np.arange(len(a)), np.full(len(a), 1 << 39)
        while len(live):
            x, y = a[live], b[live]
            bad = self.pair_place(x, y) < until[live]
            good[live[bad]] = False
            live, x, y = live[~bad], x[~bad], y[~bad]
            go_left = self.age[x] > self.age[y]
            # undone on the left: equal places were made left of the border first; on the right: after it
            until[live] = np.where(go_left, self.age[x], self.age[y] + 1)
            a[live] = np.where(go_left, self.right[x], x)
            b[live] = np.where(go_left, y, self.left[y])
            live = live[np.maximum(self.age[x], self.age[y]) >= 0]
        return good

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the earliest merge first, leftmost on a tie."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*self.merged[p], i, p) for i, p in ((i, (ids[i], ids[i + 1])) for i in range(n - 1)) if p in self.merged]
        heap = [(place, i, z, p) for place, z, i, p in heap]
        heapq.heapify(heap)
        while heap:
            _, i, z, pair = heapq.heappop(heap)
            j = after[i]
            if ids[i] != pair[0] or j >= n or ids[j] != pair[1]:
                continue
            ids[i], ids[j], after[i] = z, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (p := (ids[k], ids[after[k]])) in self.merged:
                    place, made = self.merged[p]
                    heapq.heappush(heap, (place, k, made, p))
        return [i for i in ids if i >= 0]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 16-bit ids of every pre-token."""
        short = [w if len(w) <= LONG else b"" for w in words]
        w, t = self.propose(short)
        beside = np.flatnonzero(w[1:] == w[:-1])
        failed = set(w[beside[~self.compatible(t[beside], t[beside + 1])]].tolist()) | {i for i, x in enumerate(words) if len(x) > LONG}
        flat, cuts = t.astype("<u2").tobytes(), (2 * np.searchsorted(w, np.arange(len(words) + 1))).tolist()
        return [np.array(self.merge(words[i]), "<u2").tobytes() if i in failed else flat[cuts[i] : cuts[i + 1]] for i in range(len(words))]


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Ids of texts, with the pieces between single spaces and their pre-tokens kept."""

    def __init__(self, path: str) -> None:
        import regex

        self.vocabulary, self.pre_tokens = load(path), regex.compile(PRE_TOKEN).findall
        self.special = re.compile("(" + "|".join(map(re.escape, self.vocabulary.special)) + ")")
        self.first: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _learn(self, pieces: list[str]) -> list[bytes]:
        cut = [self.pre_tokens(p) for p in pieces]
        new = list(set().union(*cut).difference(self.words))
        self.words.update(zip(new, self.vocabulary.encode_words([w.encode("utf-8", "replace") for w in new]), strict=True))
        of = self.words.__getitem__
        return [b"".join(map(of, c)) for c in cut]

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Texts without special tokens. A space after a character that is none always begins a pre-token, so texts are
        cut there; where no space follows other white space, these are the pieces of a split."""
        heads, tails = [], []
        for t in texts:
            if _RUN.search(t):
                p = re.split(r"(?<=\S)(?= )", t)
                p = [p[0], *[x[1:] for x in p[1:]]]
            else:
                p = t.split(" ")
            heads.append(p[0])
            tails.append(p[1:])
        for known, seen, space in ((self.first, set(heads), ""), (self.spaced, set().union(*tails), " ")):
            new = list(seen.difference(known))
            known.update(zip(new, self._learn([space + x for x in new]), strict=True))
        first, spaced = self.first.__getitem__, self.spaced.__getitem__
        return [first(h) + b"".join(map(spaced, t)) for h, t in zip(heads, tails, strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """One array of 16-bit ids per text."""
        if len(self.spaced) + len(self.words) + len(self.first) > CACHE:
            self.first, self.spaced, self.words = {}, {}, {}
        cut = [self.special.split(t) for t in texts]
        plain = iter(self._plain([p for c in cut for p in c[::2]]))
        special = {s: np.array([i], "<u2").tobytes() for s, i in self.vocabulary.special.items()}
        return [np.frombuffer(b"".join(special[p] if k % 2 else next(plain) for k, p in enumerate(c)), "<u2") for c in cut]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.vocabulary.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def encoder_for(path: str) -> Encoder:
    """The worker's encoder, which keeps what it learned from one task to the next."""
    return Encoder(path)


def _coder(path: str):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path)
        for b in batches:
            texts = b["content"].to_pylist()
            for lo, hi in _slices(texts, 1 << 20):
                got = encoder.encode(texts[lo:hi])
                n, ids = pa.array([len(x) for x in got], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in got], pa.binary())
                yield pa.RecordBatch.from_arrays([b["id"].slice(lo, hi - lo), n, ids, pa.array(list(map(encoder.decode, got)), pa.string())], names=["id", "n_tokens", "ids", "decoded"])

    return code


def message_tokens(messages: DataFrame, path: str | None = None) -> DataFrame:
    """Token ids of every booking message, and the text that they decode to.

    ``messages``: rows with ``id`` and ``content``; further columns are ignored, whatever their names. ``path`` is a
    byte-level tokenizer file of at most 65,536 ids (by default the 50k vocabulary). One row per input row: ``id``,
    ``n_tokens``, ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded``. Special tokens in a text become their
    ids, nothing is added.

    Distinct pre-tokens of a few texts are encoded at once: greedy longest matches propose tokens, array look-ups test
    every adjacent pair for whether merging can leave it, and only words with a failing pair are merged step by step. A
    null or empty content has no ids; a null id stays null; repeated rows come out as often; no rows give no rows.
    """
    rows = packed(messages, "id", "content").select("id", text_of(F.col("content")).alias("content"))
    kind = dict(messages.dtypes)["id"]
    return rows.mapInArrow(_coder(path or vocabulary(BYTE_VOCABULARY)), f"id {kind}, n_tokens bigint, ids binary, decoded string")
