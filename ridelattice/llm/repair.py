"""Structure of message threads repaired at least cost: one optional system turn, then user and assistant by turns."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridelattice.llm.text import packed, text_of
from ridelattice.session import cut_lineage

#: Rows of a thread, and bytes of text, that are worked on together.
BLOCK, BLOCK_BYTES = 1024, 4 << 20
#: Costs of the edits. A truncated row that stays adds TRUNCATED to its edit.
RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

# States: 0 nothing yet, 1 after the system turn, 2 after a user's, 3 after an assistant's.
_NEXT = (2, 2, 3, 2)
_KEEPS = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("a", 2): 3, ("u", 3): 2}
_ROLE = {2: "user", 3: "assistant"}
_MOST = 1 << 40
#: Cost of the end from every state, and the turns that are inserted there.
_END = ((0, ()), (2 * INSERT, ("user", "assistant")), (INSERT, ("assistant",)), (0, ()))


def code(initial: Column, gone: Column, cut: Column) -> Column:
    """A letter for a row's role initial (s, u, a, or another) and fault: must go, truncated, or neither."""
    role = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    return F.when(gone, F.upper(role)).when(cut, F.translate(role, "suax", "1230")).otherwise(role)


def _read(c: str) -> tuple[str, bool, bool]:
    return ("suax"["1230".index(c)], False, True) if c.isdigit() else (c.lower(), c.isupper(), False)


def _arcs(codes: str, end: tuple[int, ...]) -> tuple[list[int], list[tuple[int, str, int]]]:
    """Least cost from the first node of every state, and the optimal arcs (node, initial, node) of all nodes.

    Node 4 i + state stands before row i; the last four nodes are where the rows end.
    """
    cost, arcs = list(end), []
    for i in range(len(codes) - 1, -1, -1):
        role, gone, cut = _read(codes[i])
        ways: list[list[tuple[int, str, int]]] = []
        for state in range(4):
            own = [(DELETE + cost[state], "D", 4 * i + 4 + state)]
            if not gone:
                if (to := _KEEPS.get((role, state))) is not None:
                    own.append((TRUNCATED * cut + cost[to], "K", 4 * i + 4 + to))
                to = _NEXT[state]
                own.append((RENAME + TRUNCATED * cut + cost[to], "R", 4 * i + 4 + to))
            ways.append(own)
        here = [min(c for c, _, _ in w) for w in ways]
        here[2], here[3] = min(here[2], INSERT + here[3]), min(here[3], INSERT + here[2])
        here[0], here[1] = min(here[0], INSERT + here[2]), min(here[1], INSERT + here[2])
        for state, own in enumerate(ways):
            own.append((INSERT + here[_NEXT[state]], "I", 4 * i + _NEXT[state]))
            arcs += [(4 * i + state, x, to) for c, x, to in own if c == here[state]]
        cost = here
    return cost, arcs


@lru_cache(maxsize=4096)
def block_costs(codes: str) -> tuple[int, ...]:
    """Least cost through a block from every state (row) to every state (column), row by row."""
    through = [_arcs(codes, tuple(0 if s == to else _MOST for s in range(4)))[0] for to in range(4)]
    return tuple(min(through[to][s], _MOST) for s in range(4) for to in range(4))


@lru_cache(maxsize=4096)
def block_paths(codes: str, end: tuple[int, ...]) -> tuple[tuple[int, int, str], ...]:
    """For every state at the start of a block: least cost to the thread's end, the state where the block ends, and the audit on the way.

    Nodes are ranked by audits of 1, 2, 4, ... edits: the rank of twice the length is the rank of a node with that of the node its
    pointer leads to, and pointers are doubled with it. Ranks of single edits choose a node's arc, as no two optimal arcs of a
    node have the same initial; whole paths are then read from the doubled pointers.
    """
    cost, arcs = _arcs(codes, end)
    n = 4 * len(codes) + 4
    node = np.array([a for a, _, _ in arcs], np.int64)
    mark = np.array([ord(x) for _, x, _ in arcs], np.int64)
    to = np.array([t for _, _, t in arcs], np.int64)
    order = np.lexsort((mark, node))
    first = order[np.flatnonzero(np.append(True, np.diff(node[order]) > 0))] if len(order) else order
    # the nodes where the rows end lead to themselves, with an empty audit that ranks before all others
    rank, jump = np.zeros(n, np.int64), np.arange(n)
    rank[node[first]], jump[node[first]] = mark[first], to[first]
    letter, jumps = rank.copy(), [jump]
    while (jump != jump[jump]).any():
        rank = np.unique(rank * (int(rank.max()) + 1) + rank[jump], return_inverse=True)[1]
        jump = jump[jump]
        jumps.append(jump)
    out = []
    for state in range(4):
        path = np.array([state])
        for step in reversed(jumps):
            path = np.column_stack([path, step[path]]).ravel()
        audit = letter[path]
        out.append((int(cost[state]), int(jump[state]) % 4, audit[audit > 0].astype(np.uint8).tobytes().decode()))
    return tuple(out)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows as blocks of one thread: its key, the block's place in its task, codes, roles and texts."""
    names = ["booking", "at", "codes", "roles", "contents"]
    held: list[tuple[str, str, str]] = []
    key, size, at, out, waiting = None, 0, 0, [], 0

    def flushed() -> tuple:
        return (key, at, "".join(c for c, _, _ in held), [r for _, r, _ in held], [t for _, _, t in held])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (kind, pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for b in batches:
        kind = b["booking"].type
        for booking, c, role, text in zip(*(b[x].to_pylist() for x in ("booking", "code", "role", "content")), strict=True):
            if held and (booking != key or len(held) >= BLOCK or size >= BLOCK_BYTES):
                out.append(flushed())
                waiting += size
                held, size, at = [], 0, at + 1
                if len(out) >= 4096 or waiting >= BLOCK_BYTES:
                    yield batch(out)
                    out, waiting = [], 0
            key = booking
            held.append((c, role, text))
            size += len(text)
    if held:
        out.append(flushed())
    if out:
        yield batch(out)


def _costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b["booking"], b["seq"], pa.array([block_costs(c) for c in b["codes"].to_pylist()], pa.list_(pa.int64()))], names=["booking", "seq", "through"])


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What every state at a block's start leads to."""
    for b in batches:
        got = [block_paths(c, tuple(e)) for c, e in zip(b["codes"].to_pylist(), b["end"].to_pylist(), strict=True)]
        parts = [pa.array([[p[k] for p in g] for g in got], pa.list_(t)) for k, t in enumerate((pa.int64(), pa.int32(), pa.string()))]
        yield pa.RecordBatch.from_arrays([*[b[c] for c in ("booking", "seq", "blocks", "codes", "roles", "contents")], *parts], names=["booking", "seq", "blocks", "codes", "roles", "contents", "costs", "exits", "audits"])


def repaired_rows(state: int, audit: str, roles: list[str], contents: list[str]) -> list[tuple[str, str]]:
    """Role and text of the rows that an audit makes of a block's."""
    out, i = [], 0
    for x in audit:
        if x == "I":
            state = _NEXT[state]
            out.append((_ROLE[state], ""))
            continue
        if x == "K":
            state = _KEEPS[roles[i][:1], state]
            out.append((roles[i], contents[i]))
        elif x == "R":
            state = _NEXT[state]
            out.append((_ROLE[state], contents[i]))
        i += 1
    return out


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    turns = pa.list_(pa.struct([("sender_role", pa.string()), ("content", pa.string())]))
    for b in batches:
        audits, made, cost = [], [], []
        for state, last, costs, exits, options, roles, contents in zip(*(b[c].to_pylist() for c in ("state", "last", "costs", "exits", "audits", "roles", "contents")), strict=True):
            rows = repaired_rows(state, options[state], roles, contents)
            tail = _END[exits[state]][1] if last else ()
            audits.append(options[state] + "I" * len(tail))
            made.append([{"sender_role": r, "content": t} for r, t in [*rows, *[(r, "") for r in tail]]])
            cost.append(costs[state])
        yield pa.RecordBatch.from_arrays([b["booking"], b["seq"], pa.array(cost, pa.int64()), pa.array(audits, pa.string()), pa.array(made, turns)], names=["booking", "seq", "cost", "audit", "repaired"])


def _same(a: DataFrame, b: DataFrame, *names: str, how: str = "inner") -> DataFrame:
    """Join on equal threads (nulls are one) and ``names``."""
    b = b.withColumnsRenamed({c: f"_{c}" for c in ("booking", *names)})
    on = a["booking"].eqNullSafe(b["_booking"])
    for c in names:
        on = on & a[c].eqNullSafe(b[f"_{c}"])
    return a.join(b, on, how).drop(*[f"_{c}" for c in ("booking", *names)])


def _after(through: Column, then: Column) -> Column:
    """Min-plus product of two 4 x 4 matrices, each 16 numbers."""
    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.least(*[
        F.get(through, (i - i % 4).cast("int") + k) + F.get(then, (4 * k + i % 4).cast("int")) for k in range(4)], F.lit(_MOST)))


def _reach(long: DataFrame, what: str, join: int, combine) -> DataFrame:
    """``what`` of every block combined over all blocks from it on (``join`` 1) or up to it (-1), in log rounds of doubling."""
    n = long.agg(F.max("blocks")).first()[0] or 0
    span = 1
    while span < n:
        far = long.select("booking", (F.col("seq") - join * span).alias("seq"), F.col(what).alias("far"))
        long = cut_lineage(_same(long, far, "seq", how="left").withColumn(what, F.when(F.col("far").isNull(), F.col(what)).otherwise(combine(F.col(what), F.col("far")))).drop("far"))
        span *= 2
    return long


def _ends(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``end``: least cost from every state behind a block to the end of its thread."""
    last = F.array(*[F.lit(c).cast("bigint") for c, _ in _END])
    long = blocks.where("blocks > 1").select("booking", "seq", "blocks", "codes")
    if long.isEmpty():
        return blocks.withColumn("end", last)
    costs = _same(long.select("booking", "seq", "blocks"), long.mapInArrow(_costs, T.StructType([long.schema["booking"], *T._parse_datatype_string("seq bigint, through array<bigint>").fields])), "seq")
    costs = _reach(cut_lineage(costs), "through", 1, _after)
    to_end = lambda s: F.least(*[F.get("through", F.lit(4 * s + k)) + F.lit(_END[k][0]) for k in range(4)])
    behind = costs.select("booking", (F.col("seq") - 1).alias("seq"), F.array(*[to_end(s) for s in range(4)]).alias("end"))
    return _same(blocks, behind, "seq", how="left").withColumn("end", F.coalesce("end", last))


def _starts(chosen: DataFrame) -> DataFrame:
    """``chosen`` with ``state``, in which the thread's path enters a block."""
    long = chosen.where("blocks > 1").select("booking", "seq", "blocks", "exits")
    if long.isEmpty():
        return chosen.withColumn("state", F.lit(0))
    # pointers from the state at a block's start, doubled towards the thread's start
    far = _reach(cut_lineage(long), "exits", -1, lambda own, before: F.transform(before, lambda s: F.get(own, s)))
    at = far.select("booking", (F.col("seq") + 1).alias("seq"), F.get("exits", F.lit(0)).alias("state"))
    return _same(chosen, at, "seq", how="left").withColumn("state", F.coalesce("state", F.lit(0)))


_VISIBLE = r"[^\x20\x09-\x0D]"


def repaired_threads(messages: DataFrame) -> DataFrame:
    """The cheapest repair of every booking's message thread into ``(system? (user assistant)+)?``.

    ``messages``: ``booking_id``, ``turn`` (place in the thread), ``sender_role``, ``content``, as :func:`threads.booking_threads`
    derives them from the project's records; further columns are ignored, whatever their names. A row's first fault counts:
    blank (no visible character), duplicate (role and text of an earlier row), truncated (the last visible character is no
    full stop, exclamation or question mark). Edits: keep (0), give the role user or assistant (3), delete (4, forced for blank and
    duplicate rows), insert an empty user or assistant row (3); a truncated row that stays adds 3. Roles count by their first letter.

    One row per booking: ``booking_id``, ``gaps`` (turns missing between the first and the last), ``blank``, ``duplicate``, ``truncated``,
    ``illegal`` (neighbours other than system-user, user-assistant, assistant-user), ``cost``, ``audit`` (initials of the edits in order;
    of the cheapest the least in ASCII) and ``repaired``, an array of ``sender_role`` and ``content``.

    Rows are taken by turn, nulls first, then role and hash of the text; rows equal in all are duplicates of the first. A null role or
    content is one space, a null ``booking_id`` a booking of its own. No turns at all: no gaps. An empty table gives no rows.

    A thread is cut into blocks of 1,024 rows. Blocks give 4 x 4 min-plus matrices, whose products over the rest of the thread come
    from doubling joins; with the cost of its end known, a block's paths are ranked alone, and the block exits are chained by doubled
    pointers. A thread's result is one row, as its text is.
    """
    role, text = F.coalesce(F.col("sender_role").cast("string"), F.lit(" ")), F.coalesce(F.col("content").cast("string"), F.lit(" "))
    rows = packed(messages, "booking_id", "turn", "sender_role", "content").select(
        F.col("booking_id").alias("booking"), "turn", role.alias("role"), text.alias("content"), F.monotonically_increasing_id().alias("row"))
    rows = cut_lineage(rows.withColumns({"hash": F.xxhash64("content"), "digest": F.md5(text_of(F.col("content")))}))
    place = F.struct("turn", "row")
    firsts = rows.groupBy("booking", "role", "digest").agg(F.min(place).alias("first"))
    tail = F.regexp_extract("content", rf"({_VISIBLE})[\x20\x09-\x0D]*\z", 1)
    blank = tail == ""
    marked = _same(rows, firsts, "role", "digest").withColumn("fault", F.when(blank, "blank").when(~place.eqNullSafe(F.col("first")), "duplicate").when(~tail.isin(".", "!", "?"), "truncated"))
    order = [F.col("booking"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("hash"), F.col("row")]
    fault = F.coalesce("fault", F.lit(""))
    marked = marked.withColumn("code", code(F.substring("role", 1, 1), fault.isin("blank", "duplicate"), fault == "truncated"))
    dealt = cut_lineage(marked.select("booking", "turn", "role", "hash", "row", "content", "fault", "code").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    n = lambda kind: F.count(F.when(F.col("fault") == kind, 1)).alias(kind)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("bigint").alias("gaps")
    counts = dealt.groupBy("booking").agg(gaps, n("blank"), n("duplicate"), n("truncated"))
    booking = dealt.schema["booking"]
    made = dealt.mapInArrow(_blocks, T.StructType([booking, *T._parse_datatype_string("at bigint, codes string, roles array<string>, contents array<string>").fields])).withColumn("part", F.spark_partition_id())
    by = Window.partitionBy("booking")
    blocks = cut_lineage(made.withColumns({"seq": F.row_number().over(by.orderBy("part", "at")).cast("bigint"), "blocks": F.count("*").over(by)}))
    schema = T.StructType([booking, *T._parse_datatype_string("seq bigint, blocks bigint, codes string, roles array<string>, contents array<string>, costs array<bigint>, exits array<int>, audits array<string>").fields])
    chosen = _ends(blocks).mapInArrow(_chosen, schema)
    placed = _starts(cut_lineage(chosen)).withColumn("last", F.col("seq") == F.col("blocks"))
    turns = "array<struct<sender_role: string, content: string>>"
    written = placed.mapInArrow(_written, T.StructType([booking, *T._parse_datatype_string(f"seq bigint, cost bigint, audit string, repaired {turns}").fields]))
    whole = written.groupBy("booking").agg(F.array_sort(F.collect_list(F.struct("seq", "cost", "audit", "repaired"))).alias("b")).select(
        "booking", F.get("b", F.lit(0))["cost"].alias("cost"), F.array_join(F.col("b.audit"), "").alias("audit"), F.flatten(F.col("b.repaired")).alias("repaired"))
    out = _same(_same(counts, _illegal(blocks)), whole)
    return out.select(F.col("booking").alias("booking_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired")


def _illegal(blocks: DataFrame) -> DataFrame:
    """``booking`` and ``illegal``: neighbours that no thread may have, inside blocks and between them."""
    plain = F.translate(F.lower("codes"), "1230", "suax")
    pair = lambda s: F.length(s) - 1 - F.length(F.regexp_replace(s, "(?<=s)u|(?<=u)a|(?<=a)u", "__")) + F.length(s)
    after = F.coalesce(F.lead("first").over(Window.partitionBy("booking").orderBy("seq")), F.lit(""))
    ends = blocks.select("booking", "seq", plain.alias("plain")).withColumn("first", F.substring("plain", 1, 1))
    return ends.withColumn("plain", F.concat("plain", after)).groupBy("booking").agg(F.sum(pair(F.col("plain"))).cast("bigint").alias("illegal"))
