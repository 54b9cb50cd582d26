"""Thin queries: the given tables mapped to the operators' records, and results mapped back to the asked columns.

``documents`` rows stand for booking messages: ``doc_id`` is the message ``id``, ``source`` its ``sender_id``, ``text`` its ``content``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridelattice.llm import bpe, chat, counts, fingerprints, html, neardup, packing, quality, repair, repeats, resample, secrets, suffixes
from ridelattice.llm.text import hex64, read
from ridelattice.session import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a query builder under ``name``; ``oracle`` is SQL for the same rows."""

    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as booking messages."""
    return as_messages(read(spark, sf_dir, "documents"))


def as_messages(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("id"), F.col("source").alias("sender_id"), F.col("text").alias("content"))


def sha(text: Column) -> Column:
    """Lower-case hex SHA-256 of a text in UTF-8."""
    return F.sha2(text.cast("binary"), 256)


_STOP = ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS)))


@query("op1_quality_rules", f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
pos AS (SELECT doc_id, w, unnest(range(0, len(w) - 4)) AS p FROM w WHERE len(w) >= 5),
win AS (SELECT doc_id, p, array_to_string(w[p + 1:p + 5], ' ') AS s FROM pos),
again AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q
  FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, CAST(sum(least(5, p - coalesce(q, p - 5))) AS BIGINT) AS n FROM again GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(array_to_string(w.w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  CAST(len(list_filter(w.w, lambda x: lower(x) IN ({_STOP}))) AS BIGINT) AS n_stop FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_words < 10
  OR (word_chars / n_words < 2.0 OR word_chars / n_words > 15.0)
  OR n_symbols / n_words > 0.1
  OR (n_words >= 100 AND n_stop / n_words < 0.02)
  OR (coalesce(n_dup_lines / nullif(n_lines, 0), 0) > 0.5)
  OR n_repeat_words / n_words > 0.2) AS kept FROM b""")
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality.message_quality(messages(spark, sf_dir))
    return q.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op2_document_fingerprints")
def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = fingerprints.spliced_messages(messages(spark, sf_dir)).withColumn("rid", F.monotonically_increasing_id()).select(
        "rid", "id", "next_id", F.length("content").cast("long").alias("n_chars"), sha(F.col("edited")).alias("edited_sha256"),
        F.posexplode(F.array("content", "edited")).alias("kind", "content"))
    keys = ["rid", "id", "next_id", "n_chars", "edited_sha256"]
    fp = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("fingerprint")))
    rows = cut_lineage(fingerprints.fingerprint_rows(both, [*keys, "kind"], "content").groupBy(*keys).agg(fp(0).alias("fp"), fp(1).alias("edited_fp")))
    after = rows.groupBy("id").agg(F.min("fp").alias("next_fp")).withColumnRenamed("id", "next_id")
    classes = rows.groupBy("fp").agg(F.min("id").alias("first_id"))
    pairs = fingerprints.within_radius(classes.select(F.col("fp").alias("fingerprint")))
    ends = pairs.select(F.explode(F.array(F.struct(F.col("fingerprint_a").alias("fp"), F.col("fingerprint_b").alias("other")), F.struct(F.col("fingerprint_b").alias("fp"), F.col("fingerprint_a").alias("other")))).alias("e")).select("e.*")
    near = ends.join(classes.withColumnRenamed("fp", "other"), "other").groupBy("fp").agg(F.count("*").alias("n_near"), F.min("first_id").alias("near_id"))
    # written, so that the join of rows reads plain shuffles on both sides, of which Spark splits a large group's
    classes = cut_lineage(classes.join(near, "fp", "left").select("fp", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.least("first_id", "near_id").alias("near_id")))
    return rows.join(after, "next_id", "left").join(classes, "fp").select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", hex64(F.col("fp")).alias("fingerprint"), hex64(F.col("edited_fp")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), fingerprints.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        "n_near", "near_id")


@query("op4_simhash_near_dedup")
def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(messages(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), hex64(F.col("fingerprint")).alias("fingerprint"), "component_id", "n_links")


@query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(messages(spark, sf_dir))


def packed_documents(rows: DataFrame) -> DataFrame:
    return packing.pack_messages(rows).select(
        F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), F.col("message_tokens").alias("doc_tokens"), "sequence_id", "offset")


@query("op8_substring_dedup")
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.without_repeats(messages(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), F.col("content").alias("text"), F.length("content").cast("long").alias("n_chars"), F.size("removed").cast("long").alias("n_removed"), "removed")


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op9_secret_scans")
def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return secrets.message_secrets(messages(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), n("assign"), n("access"), n("hex"), sha(_joined("base")).alias("base_sha256"), _joined("spans").alias("spans"))


@query("op6_bpe_encoding")
def op6_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.message_tokens(messages(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), sha(F.col("decoded")).alias("decoded_sha256"))


@query("op7_html_extraction")
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.page_texts(read(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op3_chat_formatting", """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, regexp_replace(text, '([<\\[\\\\])', '\\1\\\\', 'g') AS esc, regexp_replace(role, '([<\\[\\\\])', '\\1\\\\', 'g') AS erole FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(esc) + length(erole) + 13) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id""")
def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = given.union(added).withColumn("id", place).select(
        F.col("conv_id").alias("booking_id"), "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("reply_to"), F.col("role").alias("sender_role"), F.col("text").alias("content"), F.lit(None).cast("double").alias("rating"))
    out = chat.format_threads(rows, branches=None).select("booking_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("loss_text"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["content"], F.lit("\n"))), "")
    return out.select(
        F.col("booking_id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), sha(told).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        sha(F.col("loss_text")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def document_edits(rows: DataFrame) -> DataFrame:
    """Three edits of every message: its opening is repeated in the middle, its sender named after a fifth, its first characters cut off."""
    n = F.length("content")
    edit = lambda seq, start, removed, inserted: F.struct(
        F.lit(seq).alias("seq"), start.alias("start"), F.lit(removed).alias("n_removed"), inserted.alias("inserted"))
    edits = F.array(
        edit(1, F.floor(n / 2), 24, F.substring("content", 1, 40)), edit(2, F.floor(n / 5), 0, F.concat(F.lit(" from "), F.col("sender_id"))), edit(3, F.lit(0).cast("long"), 5, F.lit("")))
    return rows.select("id", F.explode(edits).alias("e")).select("id", "e.*")


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir)
    return counts.edited_token_counts(rows, document_edits(rows)).select(
        F.col("id").alias("doc_id"), "n_chars", "n_tokens", "n_edits", "edited_chars", "edited_tokens", "recoded_chars", sha(F.col("content")).alias("edited_sha256"))


def _crc(text: str) -> str:
    """SQL: CRC-32 of a text's bytes, with the table ``k.t`` of :data:`_CRC_TABLE`."""
    byte = f"('0x' || hex(encode({text}))[2 * i - 1:2 * i])::BIGINT"
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen({text}) + 1), lambda i: {byte})),
    lambda c, b: xor(c >> 8, k.t[(xor(c, b) & 255) + 1])), 4294967295)"""


_CRC_TABLE = """k AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i))"""


@query("op11_importance_resampling", f"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS w FROM d), bw AS (SELECT unnest(w) AS w FROM b),
h AS (SELECT w, {_crc("w")} % 10000 AS bucket FROM (SELECT w FROM dw UNION SELECT w FROM bw), k),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN h USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM bw JOIN h USING (w) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * ((SELECT count(*) FROM dw) + 10000) / (CAST(s.n + 1 AS DOUBLE) * ((SELECT count(*) FROM bw) + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
m AS (SELECT doc_id, count(*) AS n, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM dw JOIN h USING (w) JOIN g USING (bucket) GROUP BY doc_id),
x AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, CAST(('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT AS DOUBLE) AS h FROM d LEFT JOIN m USING (doc_id)),
y AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM x),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM y WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM r) // 100 THEN rank END AS rank FROM y LEFT JOIN r USING (doc_id)""")
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = read(spark, sf_dir, "benchmark").select(F.col("text").alias("content"))
    return resample.resampled_messages(messages(spark, sf_dir), targets).select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


@query("op12_suffix_array_dedup", """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
x AS (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199, 1000)) AS x FROM d WHERE len(h) >= 400),
y AS (SELECT doc_id, x, h[2 * x + 1:2 * x + 2398] AS h FROM x),
z AS (SELECT doc_id, x, h, unnest(range(0, least(1000, len(h) // 2 - 199))) AS z FROM y),
w AS (SELECT doc_id, x + z AS p, md5(h[2 * z + 1:2 * z + 400]) AS m FROM z),
c AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
q AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM w SEMI JOIN c USING (m)),
i AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM q),
s AS (SELECT doc_id, run, min(p) AS a, max(p) + 200 AS b FROM i GROUP BY doc_id, run),
k AS (SELECT doc_id, sum(b - a) AS n, count(*) AS runs, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM s GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(runs, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(a) + 1), lambda j:
    h[CASE WHEN j = 0 THEN 1 ELSE 2 * b[j] + 1 END:CASE WHEN j = len(a) THEN len(h) ELSE 2 * a[j + 1] END]), '') END)) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""")
def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["length"])
    return suffixes.without_repeated_bytes(messages(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "n_bytes", size.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def damaged_messages(conversations: DataFrame) -> DataFrame:
    """The conversations as booking messages, every 20th of each kind dropped, emptied, left without full stops, repeated, or given to the user."""
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return rows.select(F.col("conv_id").alias("booking_id"), "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("sender_role"), text.alias("content"))


def _best(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


def _own(state: int) -> str:
    """SQL: the best of deleting, keeping and renaming row ``r`` in a state; ``s`` holds cost, audit and text behind it."""
    to, name = (3, "assistant") if state == 2 else (2, "user")
    way = lambda may, cost, x, to, role: f"{{'c': CASE WHEN {may} THEN {cost} + s[{to + 1}].c ELSE 1000000000 END, 'a': '{x}' || s[{to + 1}].a, 'o': {role} || s[{to + 1}].o}}"
    ways = [way("true", "4", "D", state, "''"), way("NOT r.gone", "3 + r.cut", "R", to, f"chr(10) || '{name}:' || r.text")]
    own = "chr(10) || r.role || ':' || r.text"
    ways.append(way(f"NOT r.gone AND r.i = '{'a' if state == 2 else 'u'}'", "r.cut", "K", to, own))
    if state == 0:
        ways.append(way("NOT r.gone AND r.i = 's'", "r.cut", "K", 1, own))
    return _best(*ways)


def _put(x: str, role: str) -> str:
    return f"{{'c': 3 + {x}.c, 'a': 'I' || {x}.a, 'o': chr(10) || '{role}:' || {x}.o}}"


_AFTER = [_best("b[3]", _put("b[4]", "assistant")), _best("b[4]", _put("b[3]", "user"))]
_FIRST = lambda n: _best(f"b[{n}]", _put("b[3]", "user"), _put(_put("b[4]", "assistant"), "user"))


@query("op13_conversation_repair", f"""
WITH {_CRC_TABLE},
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS w FROM conversations),
n AS (SELECT c.*, {_crc("w")} % 20 AS kind FROM c, k),
m AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM n WHERE kind <> 0),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, copy) AS pos, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
  regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS tail, role[1:1] AS i FROM m),
g AS (SELECT *, CASE WHEN tail = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN tail NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, lag(i) OVER (PARTITION BY conv_id ORDER BY pos) || i AS pair FROM f),
r AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
  list_reduce(list({{'i': i, 'gone': fault IN ('b', 'd'), 'cut': CASE WHEN fault = 't' THEN 3 ELSE 0 END, 'role': role, 'text': text}} ORDER BY pos DESC),
    lambda s, r: list_transform([[{_own(0)}, {_own(1)}, {_own(2)}, {_own(3)}]], lambda b: [{_FIRST(1)}, {_FIRST(2)}, {_AFTER[0]}, {_AFTER[1]}])[1],
    [{{'c': 0, 'a': '', 'o': ''}}, {{'c': 6, 'a': 'II', 'o': chr(10) || 'user:' || chr(10) || 'assistant:'}}, {{'c': 3, 'a': 'I', 'o': chr(10) || 'assistant:'}}, {{'c': 0, 'a': '', 'o': ''}}])[1] AS best FROM g GROUP BY conv_id)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.o[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN r USING (conv_id)""")
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    told = F.array_join(F.transform("repaired", lambda t: F.concat(t["sender_role"], F.lit(":"), t["content"])), "\n")
    out = repair.repaired_threads(damaged_messages(given)).withColumn("repaired_sha256", sha(told))
    every = given.select("conv_id").distinct()
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return every.join(out, every["conv_id"].eqNullSafe(out["booking_id"]), "left").select(
        "conv_id", *map(none, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", sha(F.lit(""))).alias("repaired_sha256"))
