"""Queries of the text pipeline, on documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.functions import scalars, wordpiece
from loomlake.operators import text as ops
from loomlake.plans import ranges
from loomlake.registry import query
from loomlake.session import checkpointed, scratch
from loomlake.sources import folders
from loomlake.sources.tables import LOG_SQL, event_log, table

WS = r"[ \t\n\f\r]+"
CONTENT = rf"trim(regexp_replace(text, '{WS}', ' ', 'g'), ' ')"
FRAMED = lambda *parts: "substr(sha256(" + " || ".join(x if x.startswith("'") else f"lpad(CAST(octet_length(encode({x})) AS VARCHAR), 10, '0') || {x}" for x in parts) + "), 1, 32)"


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as one text, turns apart by a blank line."""
    c = table(spark, sf_dir, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return c.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", F.array_join(F.transform("turns", lambda t: t["text"]), "\n\n").alias("text"))


THREADS_SQL = "threads AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"
SEGMENTS_SQL = """sp AS (SELECT conv_id, unnest(string_split(text, chr(10) || chr(10))) AS segment, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS pos FROM threads),
so AS (SELECT *, CAST(coalesce(sum(octet_length(encode(segment)) + 2) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_start FROM sp),
segs AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS idx, byte_start, byte_start + octet_length(encode(segment)) AS byte_end, segment FROM so WHERE trim(segment) <> '')"""


@query(f"SELECT {FRAMED(chr(39) + 'evidence' + chr(39), 'source', 'text')} AS evidence_id, min(doc_id) AS first_doc, count(*) - 1 AS duplicates FROM documents GROUP BY 1")
def evidence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the same source and content are one; its id is derived, never minted."""
    d = table(spark, sf_dir, "documents")
    return d.groupBy(scalars.derived_id("evidence", F.col("source"), F.col("text")).alias("evidence_id")).agg(F.min("doc_id").alias("first_doc"), (F.count("*") - 1).alias("duplicates"))


@query(r"""SELECT doc_id, CASE WHEN starts_with(h, '%PDF-') THEN 'pdf' WHEN starts_with(h, 'WEBVTT') THEN 'captions' WHEN lower(substr(ltrim(h), 1, 9)) = '<!doctype' THEN 'html' WHEN regexp_matches(h, '^\s*[\[{]') THEN 'json'
WHEN regexp_matches(h, '(?m)^#{1,6}[^#]') THEN 'markdown' WHEN regexp_matches(h, '(?m)^[^|\n]+(\|[^|\n]+){2,}$') THEN 'table' WHEN regexp_matches(h, '[\x00-\x08\x0E-\x1A]') THEN 'opaque' ELSE 'text' END AS media
FROM (SELECT doc_id, substr(text, 1, 4096) AS h FROM documents UNION ALL SELECT -1 - page_id, substr(html, 1, 4096) FROM pages)""")
def sniff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of each item by its first 4,096 characters, which is what sniffing reads."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 4096).alias("h"))
    p = table(spark, sf_dir, "pages").select((-1 - F.col("page_id")).alias("doc_id"), F.substring("html", 1, 4096).alias("h"))
    return d.unionByName(p).select("doc_id", scalars.media_of(F.col("h")).alias("media"))


@query("SELECT doc_id, sha256(replace(regexp_replace(chr(65279) || replace(text, chr(10), chr(13) || chr(10)), '^' || chr(65279), ''), chr(13), '')) AS normal_sha256, octet_length(encode(text)) AS n_bytes FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalising takes back a byte-order mark and carriage returns."""
    raw = F.concat(F.lit("﻿"), F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n")))
    d = table(spark, sf_dir, "documents").select("doc_id", scalars.normalized(raw).alias("normal"))
    return d.select("doc_id", F.sha2("normal", 256).alias("normal_sha256"), F.octet_length("normal").cast("long").alias("n_bytes"))


@query(f"SELECT doc_id, sha256({CONTENT}) AS content_hash, octet_length(encode({CONTENT})) AS content_bytes FROM documents")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", scalars.content(F.col("text")).alias("content"))
    return d.select("doc_id", F.sha2("content", 256).alias("content_hash"), F.octet_length("content").cast("long").alias("content_bytes"))


@query("SELECT doc_id, CAST(ceil(octet_length(encode(text)) / 4) AS BIGINT) AS tokens, CAST(least(greatest(ceil(length(text) / 3), 1), 512) AS BIGINT) AS embed_tokens, length(text) > 1533 AS truncated FROM documents")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    d = table(spark, sf_dir, "documents").select("doc_id", scalars.token_estimate(text).alias("tokens"), scalars.embed_token_estimate(text).alias("embed_tokens"))
    return d.withColumn("truncated", F.col("embed_tokens") >= 512)


@query("""WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS segment, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
o AS (SELECT *, CAST(coalesce(sum(octet_length(encode(segment)) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_start FROM s)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS idx, byte_start, byte_start + octet_length(encode(segment)) AS byte_end FROM o WHERE trim(segment) <> ''""")
def segments_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.segments(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), "\\n").select("doc_id", "idx", "byte_start", "byte_end")


@query(f"WITH {THREADS_SQL}, {SEGMENTS_SQL} SELECT conv_id, idx, byte_start, byte_end FROM segs")
def segments_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.segments(threads(spark, sf_dir), "conv_id", F.col("text"), "\\n\\n").select("conv_id", "idx", "byte_start", "byte_end")


def _chunk_sql(close_before: str) -> str:
    return f"""WITH RECURSIVE {THREADS_SQL}, {SEGMENTS_SQL}, ix AS (SELECT conv_id, idx, byte_start, byte_end FROM segs),
w(conv_id, idx, a, b, win) AS (SELECT conv_id, idx, byte_start, byte_end, 0 FROM ix WHERE idx = 0
UNION ALL SELECT n.conv_id, n.idx, CASE WHEN {close_before} THEN n.byte_start ELSE w.a END, n.byte_end, w.win + CASE WHEN {close_before} THEN 1 ELSE 0 END FROM w JOIN ix n ON n.conv_id = w.conv_id AND n.idx = w.idx + 1),
f AS (SELECT conv_id, win, min(a) AS a, max(b) AS b, min(idx) AS i, max(idx) AS j FROM w GROUP BY conv_id, win),
p AS (SELECT conv_id, i, j, b, unnest(range(a, greatest(b, a + 1), 1600)) AS byte_start FROM f)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY byte_start) - 1 AS ordinal, byte_start, least(byte_start + 1600, b) AS byte_end, i AS first_idx, j AS last_idx FROM p"""


@query(_chunk_sql("(w.b - w.a >= 1200)"))
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = ops.segment_arrays(threads(spark, sf_dir), "conv_id", F.col("text"), "\\n\\n")
    return ops.chunk_windows(items, "conv_id", "any")


@query(_chunk_sql("true"))
def chunk_windows_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages: every segment is its own window, cut where it is too long."""
    items = ops.segment_arrays(threads(spark, sf_dir), "conv_id", F.col("text"), "\\n\\n")
    return ops.chunk_windows(items, "conv_id", "each")


@query(_chunk_sql("(n.idx % 3 = 0 OR w.b - w.a >= 1200)"))
def chunk_windows_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with headings (here every third segment): a heading opens a window."""
    items = ops.segment_arrays(threads(spark, sf_dir), "conv_id", F.col("text"), "\\n\\n")
    items = items.withColumn("segs", F.transform("segs", lambda s: s.withField("depth", F.when(s["idx"] % 3 == 0, 1).otherwise(0))))
    return ops.chunk_windows(items, "conv_id", "heading")


@query(_chunk_sql("(w.b - w.a >= 1200)").replace("\nSELECT conv_id, row_number()", "\nSELECT p.conv_id, sha256(substr(hex(encode(t.text)), 2 * byte_start + 1, 2 * (least(byte_start + 1600, b) - byte_start))) AS content_hash, row_number()").replace("PARTITION BY conv_id ORDER BY byte_start) - 1 AS ordinal, byte_start, least(byte_start + 1600, b) AS byte_end, i AS first_idx, j AS last_idx FROM p", "PARTITION BY p.conv_id ORDER BY byte_start) - 1 AS ordinal FROM p JOIN threads t ON p.conv_id = t.conv_id"))
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of each chunk's bytes (as hex digits), of which its id is derived."""
    items = ops.segment_arrays(threads(spark, sf_dir), "conv_id", F.col("text"), "\\n\\n", "text")
    joined = ops.chunk_windows(items, "conv_id", keep=("text",))
    cut = F.substr(F.encode("text", "UTF-8"), (F.col("byte_start") + 1).cast("int"), (F.col("byte_end") - F.col("byte_start")).cast("int"))
    return joined.select("conv_id", F.sha2(F.hex(cut), 256).alias("content_hash"), "ordinal")


@query(f"WITH h AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), k AS (SELECT sha256(line) AS content_hash, doc_id FROM h WHERE trim(line) <> '') SELECT content_hash, count(*) AS chunks, count(DISTINCT doc_id) AS items FROM k GROUP BY content_hash HAVING count(*) > 1")
def chunk_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).where(F.btrim("line") != "")
    counted = lines.groupBy(F.sha2("line", 256).alias("content_hash"), "doc_id").agg(F.count("*").alias("n"))
    return counted.groupBy("content_hash").agg(F.sum("n").alias("chunks"), F.count("*").alias("items")).where("chunks > 1")


@query(f"""WITH {LOG_SQL}, c AS (SELECT entity, seq, ts_ms AS start_ms, ts_ms + amount // 1000 AS end_ms FROM log),
m AS (SELECT *, coalesce(max(end_ms) OVER (PARTITION BY entity ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM c)
SELECT entity, seq, greatest(start_ms, done) AS start_ms, end_ms FROM m WHERE end_ms > done""")
def captions_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = event_log(spark, sf_dir).select("entity", "seq", F.col("ts_ms").alias("start_ms"), (F.col("ts_ms") + F.floor(F.col("amount") / 1000)).alias("end_ms"))
    return ops.clamp_cues(cues, "entity", "seq", "start_ms", "end_ms")


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as caption files: a header and a note, then a cue for each turn; some begin before the one before has ended, some end before they begin."""
    start = F.col("turn") * 4000 - F.when(F.col("turn") % 3 == 2, 1500).otherwise(0)
    stop = start + F.when(F.col("turn") % 7 == 6, -500).otherwise(F.col("turn") % 4 * 900 + 1800)
    stamp = lambda ms, point: F.format_string(f"%02d:%02d:%02d{point}%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)
    lines = F.array_join(F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x != ""), "\n")
    cue = F.concat((F.col("turn") + 1).cast("string"), F.lit("\n"), stamp(start, "."), F.lit(" --> "), stamp(stop, ","), F.lit(" align:start\n"), lines)
    own = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", cue.alias("cue")).alias("c"))
    cues = F.transform(F.array_sort(F.collect_list("c")), lambda c: c["cue"])
    return own.groupBy("conv_id").agg(cues.alias("cues")).select("conv_id", F.array_join(F.concat(F.array(F.lit("WEBVTT"), F.lit("NOTE made of turns")), "cues"), "\n\n").alias("text"))


@query("""WITH c AS (SELECT conv_id, turn, turn * 4000 - CASE WHEN turn % 3 = 2 THEN 1500 ELSE 0 END AS start_ms, array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> ''), ' ') AS cue FROM conversations),
e AS (SELECT *, start_ms + turn % 4 * 900 + 1800 AS end_ms FROM c WHERE turn % 7 <> 6),
m AS (SELECT *, coalesce(max(end_ms) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM e)
SELECT conv_id, greatest(start_ms, done) AS start_ms, end_ms, cue FROM m WHERE end_ms > done""")
def caption_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caption files parsed into cues, clamped, and without what overlaps."""
    cues = ops.cues_of(captions(spark, sf_dir), "conv_id", F.col("text"))
    return ops.clamp_cues(cues, "conv_id", "idx", "start_ms", "end_ms").select("conv_id", "start_ms", "end_ms", "cue")


@query("""WITH s AS (SELECT conv_id, turn, CAST(coalesce(sum(length(text) + (turn * 389) % 1400) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms, length(text) AS n FROM conversations),
e AS (SELECT *, start_ms + n AS end_ms FROM s), l AS (SELECT *, lag(end_ms) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM e) SELECT conv_id, turn, start_ms, end_ms, prev IS NULL OR greatest(start_ms - prev, 0) >= 700 AS starts_turn FROM l""")
def turn_marking(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.char_length("text").alias("n"))
    s = ranges.running(c, ("conv_id",), "turn", {"start_ms": F.col("n") + (F.col("turn") * 389) % 1400}).withColumn("end_ms", F.col("start_ms") + F.col("n"))
    return ops.turn_marks(s, "conv_id", "turn", "start_ms", "end_ms").select("conv_id", "turn", "start_ms", "end_ms", "starts_turn")


@query("""SELECT conv_id, turn, CAST(coalesce(sum(octet_length(encode(text)) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_start, octet_length(encode(text)) AS n_bytes FROM conversations""")
def byte_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.octet_length("text").cast("long").alias("n_bytes"))
    return ranges.running(c, ("conv_id",), "turn", {"byte_start": F.col("n_bytes") + 1}).select("conv_id", "turn", "byte_start", "n_bytes")


@query("""WITH s AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'failed' ELSE 'ready' END AS status, doc_id % 5 AS done FROM labels), e AS (SELECT *, status = 'failed' OR done + 1 >= 3 AS eligible FROM s)
SELECT doc_id, status, done, 1 + 1 AS next_pass FROM e WHERE eligible ORDER BY doc_id LIMIT 500""")
def reprocess_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that can be processed again from a stage: failed ones, and those that have come as far; at most 500 at a time."""
    s = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 0, "failed").otherwise("ready").alias("status"), (F.col("doc_id") % 5).alias("done"))
    return s.where((F.col("status") == "failed") | (F.col("done") + 1 >= 3)).orderBy("doc_id").limit(500).withColumn("next_pass", F.lit(2))


@query(r"SELECT conv_id, turn, length(regexp_extract(substr(regexp_replace(h, '\s', '', 'g'), 1, 8), '^(#{1,6})[^#]', 1)) AS depth FROM (SELECT conv_id, turn, repeat('#', turn::INT) || ' ' || text AS h FROM conversations)")
def heading_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.repeat(F.lit("#"), F.col("turn").cast("int")), F.lit(" "), "text").alias("h"))
    return c.select("conv_id", "turn", scalars.heading_depth(F.col("h")).cast("long").alias("depth"))


@query("SELECT doc_id, CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || '…' ELSE text END AS excerpt FROM documents")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", scalars.excerpt(F.col("text")).alias("excerpt"))


@query("""WITH w AS (SELECT doc_id, least(greatest(CAST(ceil(length(text) / 3) AS BIGINT), 1), 512) AS n, lang FROM documents) SELECT lang, count(*) AS items, CAST(sum(n) AS BIGINT) AS tokens FROM w GROUP BY lang""")
def embed_input_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("lang", scalars.embed_token_estimate(F.col("text")).alias("n"))
    return d.groupBy("lang").agg(F.count("*").alias("items"), F.sum("n").alias("tokens"))


#: A toy vocabulary: special pieces, letters, and common endings.
TOY = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", *"abcdefghijklmnopqrstuvwxyz", *(f"##{c}" for c in "abcdefghijklmnopqrstuvwxyz"), "th", "##ion", "##ing", ".", ","]


_PIECES = r"list_filter(string_split_regex(regexp_replace(regexp_replace(strip_accents(lower(coalesce(text, ''))), '[\x00-\x08\x0E-\x1F\x7F]', '', 'g'), '([\pP!-/:-@\[-`{-~\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}])', ' \1 ', 'g'), '\s+'), lambda x: x <> '')"


#: Greedy longest matches of a vocabulary vo (piece, id) in every conversation, by recursion.
_MATCHED = rf"""ct AS (SELECT conv_id, turn, {_PIECES} AS words FROM conversations),
cw AS (SELECT DISTINCT unnest(words) AS word FROM ct),
m(word, pos, ids) AS (SELECT word, CAST(0 AS BIGINT), []::BIGINT[] FROM cw WHERE length(word) <= 100
  UNION ALL SELECT m.word, CAST(m.pos + coalesce(b.len, 1000) AS BIGINT), CASE WHEN b.len IS NULL THEN [1] ELSE list_append(m.ids, b.id) END
  FROM m LEFT JOIN LATERAL (SELECT length(vo.piece) - CASE WHEN m.pos > 0 THEN 2 ELSE 0 END AS len, vo.id FROM vo WHERE starts_with(CASE WHEN m.pos > 0 THEN '##' ELSE '' END || substr(m.word, m.pos + 1), vo.piece) AND (m.pos = 0 OR length(vo.piece) > 2) ORDER BY length(vo.piece) DESC LIMIT 1) b ON true WHERE m.pos < length(m.word)),
wp AS (SELECT word, ids FROM m WHERE pos >= length(word) UNION ALL SELECT word, [1] FROM cw WHERE length(word) > 100),
tk AS (SELECT conv_id, turn, unnest(words[1:510]) AS word, generate_subscripts(words[1:510], 1) AS k FROM ct),
en AS (SELECT conv_id, turn, flatten(list(ids ORDER BY k))[1:510] AS ids FROM tk JOIN wp USING (word) GROUP BY conv_id, turn)
SELECT ct.conv_id, ct.turn, CAST(2 + coalesce(len(ids), 0) AS INTEGER) AS n, md5(array_to_string(list_concat([2], coalesce(ids, []), [3]), ' ')) AS ids_md5 FROM ct LEFT JOIN en ON ct.conv_id = en.conv_id AND ct.turn = en.turn"""
_TOY_SQL = ", ".join(f"({k}, '{p}')" for k, p in enumerate(TOY))


@query(f"WITH RECURSIVE vo AS (SELECT piece, id FROM (VALUES {_TOY_SQL}) s(id, piece)), {_MATCHED}")
def wordpiece_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    encode = wordpiece.wordpiece(wordpiece.vocabulary(TOY))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", encode("text").alias("ids"))
    return c.select("conv_id", "turn", F.size("ids").alias("n"), F.md5(F.array_join("ids", " ")).alias("ids_md5"))


@query(f"""WITH RECURSIVE dw AS (SELECT unnest({_PIECES}) AS word FROM documents), dn AS (SELECT word, count(*) AS n FROM dw GROUP BY word),
dc AS (SELECT DISTINCT unnest(string_split(word, '')) AS c FROM dn),
vl AS (SELECT 0 AS kind, CAST(k AS BIGINT) AS rank, piece FROM (VALUES (0, '[PAD]'), (1, '[UNK]'), (2, '[CLS]'), (3, '[SEP]')) s(k, piece)
  UNION ALL SELECT 1, 0, c FROM dc UNION ALL SELECT 1, 0, '##' || c FROM dc UNION ALL SELECT 2, -n, word FROM (SELECT * FROM dn WHERE length(word) > 1 ORDER BY n DESC, word LIMIT 4096)),
vo AS (SELECT piece, min(i) AS id FROM (SELECT piece, row_number() OVER (ORDER BY kind, rank, piece) - 1 AS i FROM vl) GROUP BY piece),
{_MATCHED}""")
def wordpiece_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in word pieces of a list of thousands, which is written as a text, read as a table and joined."""
    path = scratch(spark, "vocabulary")
    wordpiece.listed_pieces(table(spark, sf_dir, "documents"), F.col("text")).coalesce(1).write.text(path)
    vocab = checkpointed(wordpiece.vocabulary_table(spark.read.text(f"{path}/*.txt", wholetext=True)))
    folders.remove(spark, path)
    ids = wordpiece.encoded(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], F.col("text"), vocab)
    return ids.select("conv_id", "turn", F.size("ids").alias("n"), F.md5(F.array_join("ids", " ")).alias("ids_md5"))


@query("""WITH r AS (SELECT conv_id, turn + 1 AS idx, turn || ',' || role || ',"' || replace(text, '"', '""') || '"' AS record FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, text FROM conversations WHERE role IS NOT NULL AND text IS NOT NULL)
UNION ALL SELECT DISTINCT conv_id, 0, 'turn,role,text' FROM conversations WHERE role IS NOT NULL AND text IS NOT NULL)
SELECT conv_id, idx, CAST(1 + coalesce(sum(1 + length(record) - length(replace(record, chr(10), ''))) OVER (PARTITION BY conv_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line, record FROM r""")
def csv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as CSV files, whose quoted texts hold line ends, and their records with the lines that they start at."""
    c = table(spark, sf_dir, "conversations").where("role IS NOT NULL AND text IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("rows"))
    record = lambda r, k: F.concat(k.cast("string"), F.lit(","), r["role"], F.lit(',"'), F.replace(r["text"], F.lit('"'), F.lit('""')), F.lit('"'))
    files = c.select("conv_id", F.array_join(F.concat(F.array(F.lit("turn,role,text")), F.transform("rows", record)), "\n").alias("text"))
    return ops.csv_records(files, "conv_id", F.col("text"))
