"""Token counts of messages that are edited: a segment tree per message, and re-encoding only around the edits."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelattice.llm.packing import vocabulary
from ridelattice.llm.text import packed, text_of

RANKS = "byte_bpe_50k.tiktoken"
#: Characters of a leaf, about; a leaf that grows to eight times as many is cut up again.
LEAF = 256
#: White space to every reader of Unicode.
_SPACE = " \t\n\v\f\r"
_BORDER = re.compile(r"(?<=\S)(?=[ \t-\r])|(?<=[^\W\d_])(?=[^\w\s])")


def _is_border(left: str, right: str) -> bool:
    """Whether a pre-token always begins between two characters: before white space, and between a letter and a mark."""
    return not left.isspace() and right in _SPACE or left.isalpha() and not (right.isalnum() or right.isspace() or right == "_")


@lru_cache(maxsize=2)
def encoding(path: str):
    """The byte-level encoding of a rank file. Strings of special tokens are ordinary text."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("messages", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class TokenTree:
    """Leaves of whole pre-tokens, with their characters and tokens summed over a binary tree.

    A leaf ends before white space that follows something else, or between a letter and a punctuation mark. There a pre-token
    always begins, whatever stands around it, so counts of leaves add up to the count of the text, and an edit can only change the leaves that it
    touches and those whose border it takes away.
    """

    def __init__(self, text: str, encode) -> None:
        self.encode, self.recoded = encode, 0
        self._build(_leaves(text))

    def _build(self, leaves: list[str]) -> None:
        self.width = 1 << max(0, len(leaves) - 1).bit_length()
        self.text = leaves + [""] * (self.width - len(leaves))
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, x in enumerate(self.text):
            self.chars[self.width + i] = len(x)
            self.tokens[self.width + i] = len(self.encode(x)) if x else 0
        for i in range(self.width - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def _find(self, at: int) -> tuple[int, int]:
        """Leaf that holds character ``at`` (the last with text for the end), and the characters before it."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if at - before >= self.chars[node] and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        return node - self.width, before

    def _beside(self, leaf: int, step: int) -> int:
        """Nearest leaf with text in a direction, or -1."""
        leaf += step
        while 0 <= leaf < self.width:
            if self.text[leaf]:
                return leaf
            leaf += step
        return -1

    def _set(self, leaf: int, text: str) -> None:
        self.text[leaf] = text
        node = self.width + leaf
        self.chars[node], self.tokens[node] = len(text), len(self.encode(text)) if text else 0
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def edit(self, start: int, n_removed: int, inserted: str) -> None:
        """Replaces ``n_removed`` characters from ``start`` on; both are cut to what the text has."""
        start = min(max(0, start), self.n_chars)
        stop = min(start + max(0, n_removed), self.n_chars)
        low, before = self._find(start)
        high, after = (low, before) if stop == start else self._find(stop - 1)
        new = self.text[low][: start - before] + inserted + self.text[high][stop - after :]
        touched = list(range(low, high + 1))
        # boundary context: a neighbour joins in where the border between it and the new text is none any more
        while (k := self._beside(touched[0], -1)) >= 0 and not (new and _is_border(self.text[k][-1], new[0])):
            touched = list(range(k, touched[-1] + 1))
            new = self.text[k] + new
        while (k := self._beside(touched[-1], 1)) >= 0 and not (new and _is_border(new[-1], self.text[k][0])):
            touched = list(range(touched[0], k + 1))
            new += self.text[k]
        self.recoded += len(new)
        pieces = [new] if len(new) < 8 * LEAF else _leaves(new)
        if len(pieces) > len(touched):
            self._graft(touched[0], touched[-1], pieces)
            return
        for k, leaf in enumerate(touched):
            new = pieces[k] if k < len(pieces) else ""
            if self.text[leaf] or new:
                self._set(leaf, new)

    def _graft(self, low: int, high: int, pieces: list[str]) -> None:
        """A text that has outgrown its leaves gets a new tree; counts of untouched leaves are kept, not encoded again."""
        counted = dict(zip(self.text, self.tokens[self.width :], strict=True))
        whole, self.encode = self.encode, lambda x: range(counted[x]) if x in counted else whole(x)
        self._build([x for x in self.text[:low] + pieces + self.text[high + 1 :] if x] or [""])
        self.encode = whole

    def content(self) -> str:
        return "".join(self.text)


def _leaves(text: str) -> list[str]:
    """The text in leaves of about :data:`LEAF` characters; one without borders stays whole."""
    out, at = [], 0
    while len(text) - at > LEAF and (m := _BORDER.search(text, at + LEAF)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        done: list[tuple] = []
        tree, now, first, edits = None, None, None, 0

        def close() -> None:
            if tree is not None:
                done.append((now, *first, edits, tree.n_chars, tree.n_tokens, tree.recoded, tree.content()))

        for b in batches:
            size = 0
            for key, kind, start, removed, body in zip(*(b[c].to_pylist() for c in ("id", "kind", "start", "n_removed", "body")), strict=True):
                same = tree is not None and key is not None and key == now
                if kind == 1:
                    if same:
                        tree.edit(int(start), int(removed), body)
                        edits += 1
                    continue
                if same:  # another text under an id that edits are already kept for
                    x = TokenTree(body, encode)
                    done.append((key, x.n_chars, x.n_tokens, 0, x.n_chars, x.n_tokens, 0, body))
                else:
                    close()
                    tree, now, edits = TokenTree(body, encode), key, 0
                    first = (tree.n_chars, tree.n_tokens)
                size += len(body)
                if size > 1 << 20:
                    yield _batch(done, b["id"].type)
                    done, size = [], 0
            yield _batch(done, b["id"].type)
            done = []
        close()
        if done:
            yield _batch(done, b["id"].type)

    return count


_COLUMNS = ("id", "n_chars", "n_tokens", "n_edits", "edited_chars", "edited_tokens", "recoded_chars", "content")


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = (kind, *[pa.int64()] * 6, pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=list(_COLUMNS))


def edited_token_counts(messages: DataFrame, edits: DataFrame, path: str | None = None) -> DataFrame:
    """Token counts of booking messages before and after their edits.

    ``messages``: ``id`` and ``content``; ``edits``: ``id``, ``seq``, ``start``, ``n_removed``, ``inserted``; further columns are ignored,
    whatever their names. Edits of a message apply one after the other by ``seq`` (ties by start, removal, insertion), each to the text that
    the one before left: ``n_removed`` characters from ``start`` give way to ``inserted``; positions beyond the text are cut to
    it. ``path`` is a rank file (by default the 50k byte-level vocabulary). One row per message: ``id``, ``n_chars``, ``n_tokens``,
    ``n_edits``, ``edited_chars``, ``edited_tokens``, ``recoded_chars`` (characters encoded again for edits) and ``content``, the edited text.

    A null content or insertion is empty, null numbers are 0. Edits of a null or unknown id apply to nothing; a message
    with a null id is counted as it stands. Of rows that share an id, the smallest text takes the edits and the others are
    counted as they stand. Empty tables give no rows. Messages and edits are brought together and sorted by id, so
    a task holds one message at a time, and a message's edits, in sequence by nature, stream past it.
    """
    kind = dict(messages.dtypes)["id"]
    zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    texts = packed(messages, "id", "content").select(
        "id", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n_removed"), text_of(F.col("content")).alias("body"))
    changes = packed(edits, "id", "seq", "start", "n_removed", "inserted").where(F.col("id").isNotNull()).select(
        F.col("id").cast(kind).alias("id"), F.lit(1).alias("kind"), zero("seq").alias("seq"), zero("start").alias("start"), zero("n_removed").alias("n_removed"), text_of(F.col("inserted")).alias("body"))
    # null ids are spread by their text: they need not meet
    spread = F.when(F.col("id").isNull(), F.xxhash64("body"))
    rows = texts.union(changes).repartition("id", spread).sortWithinPartitions("id", "kind", "seq", "start", "n_removed", "body")
    return rows.select("id", "kind", "start", "n_removed", "body").mapInArrow(
        _counter(path or vocabulary(RANKS)), f"id {kind}, n_chars bigint, n_tokens bigint, n_edits bigint, edited_chars bigint, edited_tokens bigint, recoded_chars bigint, content string")
