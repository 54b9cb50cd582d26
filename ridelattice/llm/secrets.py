"""Secrets in messages: plain patterns, and credentials in several parts linked by an interval join."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelattice.llm.text import carried, packed, restored, text_of
from ridelattice.session import cut_lineage

# The base patterns and the least length of a match; kinds in their listed order.
ASSIGN = re.compile(r'''(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)''', re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")

#: Parts that mean little alone. A secret mixes upper case, lower case and digits, is a UUID, or has a piece of 16 letters
#: and digits with both of them (base32, lower-case keys); an identifier is named as one or is a capital code; an endpoint
#: is a host with a scheme.
#: It may begin after an equals sign, as in KEY=value; in a URL its plus, slash and equals signs are percent-encoded.
SECRET = re.compile(r"(?<![A-Za-z0-9+/_%-])(?:[A-Za-z0-9+/_-]|%(?:2[BbFf]|3[Dd])){16,}={0,2}(?![A-Za-z0-9+/_=-])")
IDENTIFIER = re.compile(
    r'''(?<![A-Za-z0-9])(?:(?i:access[_-]?key(?:[_-]?id)?|client[_-]?id|account(?:[_-]?id)?|user(?:name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}|[A-Z]{2}(?=[A-Z0-9]*[0-9])[A-Z0-9]{10,30}(?![A-Za-z0-9]))''', re.A)
#: A name that says that a key follows; it stands for an identifier even where the key is part of the match.
KEY_NAME = re.compile(r"""(?<![A-Za-z0-9])access[_-]?key["']?\x20*[:=]""", re.I | re.A)
ENDPOINT = re.compile(r"(?:[a-z][a-z0-9+.-]{1,15}://)[A-Za-z0-9._~-]+(?::[0-9]{1,5})?[A-Za-z0-9/._~%-]*", re.A)
#: Code points within which the parts of one credential stand.
SCOPE = 200

_HEX_MAP = bytes(ord("h") if c in b"0123456789abcdef" else ord(" ") for c in range(256))
_WORD_MAP = bytes(ord("h") if chr(c).isascii() and (chr(c).isalnum() or c in b"+/_=-%") else ord(" ") for c in range(256))
_DIGIT = re.compile("[0-9]")
_UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I | re.A)
_PIECE = re.compile(r"(?<![A-Za-z0-9])(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{16,}")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end of the plain matches; ends are exclusive."""
    found, low = [], text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"h" * 24 in text.encode("utf-8", "replace").translate(_HEX_MAP):
        found += [("hex", *m.span()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return found


def _keylike(s: str) -> bool:
    return any(c.islower() for c in s) and any(c.isupper() for c in s) and any(c.isdigit() for c in s) or bool(_UUID.fullmatch(s) or _PIECE.search(s))


def weak_parts(text: str, strong: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Kind, start and end of what is a credential's part only beside its complement, and of partners that are not reported
    again: ``secret+`` and ``identifier+``, from the plain matches ``strong`` and from names. No secret of either sort, no parts.
    """
    starts = sorted((s, e) for _, s, e in strong)
    reach = list(accumulate((e for _, e in starts), max))

    def before(at: int) -> int:
        """Where the plain matches end at most that begin at ``at`` or before it."""
        i = bisect_right(starts, at, key=lambda s: s[0])
        return reach[i - 1] if i else -1

    found = [("secret+", s, e) for k, s, e in strong if k in ("assign", "hex")]
    if b"h" * 16 in text.encode("utf-8", "replace").translate(_WORD_MAP) and _DIGIT.search(text):
        found += [("secret", *m.span()) for m in SECRET.finditer(text) if _keylike(m[0]) and before(m.start()) < m.end()]
    if not found:
        return []
    names = [m.span() for m in IDENTIFIER.finditer(text) if any(c.isdigit() for c in m[0]) or not m[0].isalnum()]
    known = [("identifier+" if before(e - 1) > s else "identifier", s, e) for s, e in names]
    known += [("identifier+", s, e) for k, s, e in strong if k == "access"] + [("identifier+", *m.span()) for m in KEY_NAME.finditer(text)]
    return found + known + [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)] if known else []


SPANS = "array<struct<kind: string, start: int, end: int>>"


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    as_rows = lambda spans: [dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans]
    for b in batches:
        base, weak = [], []
        for text in b["content"].to_pylist():
            strong = base_spans(text)
            base.append(as_rows(strong))
            weak.append(as_rows(weak_parts(text, strong)))
        yield pa.RecordBatch.from_arrays([b["id"], b["hash"], pa.array(base, _SPAN), pa.array(weak, _SPAN)], names=["id", "hash", "base", "weak"])


KEY = ["id", "hash"]


def linked_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``id``, ``hash`` and ``linked``, the weak parts that a complement stands beside.

    ``parts``: ``id`` and ``hash`` of a text, ``kind``, ``start``, ``end``. A secret and an identifier link if they do not overlap and
    at most ``scope`` code points lie between them; an endpoint is taken if it stands that near to such a secret. Kinds with a
    ``+`` link like those without, and are not reported again. The intervals are joined on text buckets one scope wide, of
    which a part enters those it can reach, so the join is on an equal bucket of an equal text, and a text with any number of
    parts is spread over its buckets.
    """
    reach = F.sequence(F.floor((F.col("start") - scope) / scope).cast("int"), F.floor((F.col("end") + scope) / scope).cast("int"))
    own = F.sequence(F.floor(F.col("start") / scope).cast("int"), F.floor(F.col("end") / scope).cast("int"))
    secret = F.col("kind").startswith("secret")
    secrets = parts.where(secret).select(*KEY, F.col("kind").alias("as"), F.col("start").alias("s"), F.col("end").alias("e"), F.explode(reach).alias("bucket"))
    others = parts.where(~secret).select(*KEY, "kind", "start", "end", F.explode(own).alias("bucket"))
    near = (F.col("start") <= F.col("e") + scope) & (F.col("s") <= F.col("end") + scope)
    apart = (F.col("start") >= F.col("e")) | (F.col("s") >= F.col("end")) | (F.col("kind") == "endpoint")
    pairs = _same(others, secrets, "bucket").where(near & apart).select(*KEY, "kind", "start", "end", "as", "s", "e").distinct()
    proven = pairs.where("kind LIKE 'identifier%'").select(*KEY, "as", "s", "e").distinct()
    taken = _same(pairs, proven, "as", "s", "e").where("kind <> 'identifier+'").select(*KEY, "kind", "start", "end")
    taken = taken.union(proven.where(F.col("as") == "secret").select(*KEY, "as", "s", "e")).distinct()
    return taken.groupBy(*KEY).agg(F.collect_list(F.struct("kind", "start", "end")).alias("linked"))


def _same(a: DataFrame, b: DataFrame, *names: str, how: str = "inner") -> DataFrame:
    """Join on equal texts and ``names``; null ids are equal. Columns of ``a``, and those that only ``b`` has."""
    b = b.select(*[F.col(c).alias(f"_{c}") if c in (*KEY, *names) else F.col(c) for c in b.columns])
    on = a["id"].eqNullSafe(b["_id"])
    for c in ("hash", *names):
        on = on & (a[c] == b[f"_{c}"])
    return a.join(b, on, how).drop(*[f"_{c}" for c in (*KEY, *names)])


def _found(messages: DataFrame, scope: int) -> DataFrame:
    """``id``, ``hash``, ``base`` and ``spans`` of every row."""
    kind = dict(messages.dtypes)["id"]
    rows = packed(messages, "id", "content").select("id", text_of(F.col("content")).alias("content")).withColumn("hash", F.xxhash64("content"))
    found = cut_lineage(rows.mapInArrow(_scan, f"id {kind}, hash bigint, base {SPANS}, weak {SPANS}"))
    parts = found.select(*KEY, F.explode("weak").alias("w")).select(*KEY, "w.*")
    all_ = _same(found, linked_parts(parts, scope), how="left").withColumn("all", F.concat("base", F.coalesce("linked", F.array().cast(SPANS))))
    rank = lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))
    ordered = lambda c: F.transform(F.array_sort(F.transform(c, rank)), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return all_.select(*KEY, ordered(F.col("base")).alias("base"), ordered(F.col("all")).alias("spans"))


def message_secrets(messages: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The secrets of every booking message: ``id``, ``base`` and ``spans``, arrays of ``kind``, ``start``, ``end``.

    ``messages``: rows with ``id`` and ``content``; further columns are ignored, whatever their names. ``base`` holds the
    plain matches (assignments, access ids, long hex digits), ``spans`` these and the linked parts of credentials whose
    access identifier, secret and endpoint stand apart: see :func:`linked_parts`. Positions are code points, ends
    exclusive; spans are in order of start, then of kind as in ``KINDS``. Spans of different kinds may overlap. An assignment or
    a long hex number is a secret, an access id an identifier, that other parts link to.

    A null or empty content has none; a null id stays null; repeated rows have equal spans; an empty table gives no rows.
    """
    return _found(messages, scope).select("id", "base", "spans")


def _hider(mask: str):
    def hide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b["content"].to_pylist()
            for k, spans in enumerate(b["spans"].to_pylist()):
                for s, e in reversed(_merged((x["start"], x["end"]) for x in spans or ())):
                    texts[k] = texts[k][:s] + mask + texts[k][e:]
            yield pa.RecordBatch.from_arrays([b["rest"], b["id"], pa.array(texts, pa.string())], names=["rest", "id", "content"])

    return hide


def _merged(spans: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping spans as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def hide_secrets(messages: DataFrame, mask: str = "[secret]", scope: int = SCOPE) -> DataFrame:
    """The rows of ``messages`` with all their columns; every span of :func:`message_secrets` in ``content`` gives way to ``mask``."""
    spans = _found(messages, scope).where(F.size("spans") > 0).select(*KEY, "spans").dropDuplicates(KEY)
    rows = carried(messages).withColumn("hash", F.xxhash64("content"))
    joined = _same(rows, spans, how="left").select("rest", "id", "content", "spans")
    return restored(joined.mapInArrow(_hider(mask), joined.drop("spans").schema), messages)
