"""Line dedup by a log-template tree.

Lines are parsed at fixed depth, by their number of words and their LEADING first words, with words that hold
digits as variable fields. That is a leaf. The words after the leading ones are cut into stretches (single words in
a line with SEGMENTS or fewer of them), and in a template up to a quarter of the stretches, rounded down, are variable
fields besides: every line belongs to one template for each choice of them. Short lines have no choice and
must be equal. Templates that recur in at least MIN_DOCS documents are dropped, with all lines that belong to any.

What recurs only because whole documents are copies of each other is not boilerplate: texts that are exactly
equal count as one document, and a document counts only if more than a ninth of its characters lie in lines that do
not recur. (Two documents that share eight ninths of their words have a similarity of 0.8: copies from there on are
left to near-duplicate removal.) A template dropped is dropped in every document.

A line travels as 64-bit hashes of its stretches, never as text. Most lines go after one count, that of their leaf, and of
the others those that no half of the line has in common with other documents go next; only what is left meets its
templates. Each count is one partial aggregation and loses nothing: a template cannot recur more often than its
leaf or its halves. Exact copies are one text from there on. Counting is by (template, text) first, so a line that
is in a third of all documents is no hot key; the joins can be split where a key is hot. The lines that go are
counted and, if few, sent to the documents; if not, texts are shuffled once to meet them.

Edge cases: null texts are empty and unchanged, as are texts without recurring lines; blank lines are never
dropped and never counted; repeated rows are treated alike; documents may end up empty, and stay; null ids are
ids; a line repeated inside one document counts once and is dropped wherever it stands; very long lines are one
line; an empty table gives an empty result; other columns are kept, whatever their names; n_chars is brought up to date.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LEADING = 2
SEGMENTS = 8
#: Documents in which a template must recur to be dropped.
MIN_DOCS = 3
#: A document whose recurring lines hold more than this share of its characters is a copy of others.
COPY_SHARE = (8, 9)
#: Positions of dropped lines that are broadcast at most, some 20 bytes each.
MAX_BROADCAST = 2_000_000
VARIABLE = rf"[^{common.SPACE}]*[0-9][^{common.SPACE}]*"
BLANKS = " \t\n\x0b\x0c\r"


def patterns(m: int) -> list[int]:
    """For a line of m stretches, the stretches that each template keeps, as bits."""
    return [sum(1 << k for k in kept) for kept in combinations(range(m), m - m // 4)]


def halves() -> list[int]:
    """Two of four quarters of SEGMENTS stretches: any template of such a line keeps one of these whole."""
    quarter = [3 << 2 * k for k in range(4)]
    return [a | b for a, b in combinations(quarter, 2)]


def body(text: Column) -> Column:
    """What tells texts apart."""
    return F.xxhash64(common.whole(text))


def parsed_lines(docs: DataFrame) -> DataFrame:
    """body, total (characters of the text), pos, chars, leaf and g (hashes of the stretches) of every line that is not blank."""
    # The hash is taken before the text is split, else it would be taken again for every line.
    rows = docs.select(common.whole("text").alias("text"), body(F.col("text")).alias("body"), F.char_length(common.whole("text")).alias("total"))
    rows = rows.select("body", "total", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    # Blank lines go here, by the line itself: a filter on its words would split every line twice.
    rows = rows.where(F.btrim("line", F.lit(BLANKS)) != "")
    masked = F.btrim(F.regexp_replace("line", VARIABLE, "<*>"), F.lit(BLANKS))
    rows = rows.select("body", "total", "pos", F.char_length("line").alias("chars"), F.split(masked, f"[{common.SPACE}]+", -1).alias("t"))
    n = F.size("t")
    leaf = F.xxhash64(n, *(F.get("t", k) for k in range(LEADING)))
    rest = F.greatest(n - LEADING, F.lit(0))
    m = F.least(rest, F.lit(SEGMENTS))
    at = lambda k: F.floor(k * rest / m).cast("int")
    g = [F.when(m > k, F.xxhash64(F.slice("t", LEADING + 1 + at(F.lit(k)), at(F.lit(k + 1)) - at(F.lit(k))))) for k in range(SEGMENTS)]
    return rows.select("body", "total", "pos", "chars", leaf.alias("leaf"), F.array_compact(F.array(*g)).alias("g"))


def keys(kept: Column) -> Column:
    """Hashes of a line's leaf with the stretches that each of these bit sets keeps."""
    return F.transform(kept, lambda p: F.xxhash64("leaf", p, F.filter("g", lambda x, i: F.getbit(p, i) == 1)))


def shared_by(lines: DataFrame, key: str) -> DataFrame:
    """Keys that may be in MIN_DOCS texts: in as many lines, and in more than one text. One partial aggregation."""
    found = lines.groupBy(key).agg(F.count("*").alias("n"), F.min("body").alias("least"), F.max("body").alias("most"))
    # Written out, so that the join deals both of its sides itself and can split a key that is in a third of all lines.
    return common.checkpointed(found.where((F.col("n") >= MIN_DOCS) & (F.col("least") != F.col("most"))).select(key))


def candidates(docs: DataFrame, kept: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Lines that may belong to a recurring template, each once for all exact copies of its text."""
    lines = kept(parsed_lines(docs), "lines")
    lines = lines.join(shared_by(lines, "leaf"), "leaf", "left_semi")
    lines = kept(lines.groupBy("body", "pos").agg(*(F.first(c).alias(c) for c in ("total", "chars", "leaf", "g"))), "shared")
    long = F.size("g") == SEGMENTS
    halved = lines.where(long).select("*", F.explode(keys(F.array(*map(F.lit, halves())))).alias("half"))
    halved = halved.join(shared_by(halved, "half"), "half", "left_semi").drop("half").dropDuplicates(["body", "pos"])
    return lines.where(~long).unionByName(halved)


def recurring(rows: DataFrame) -> DataFrame:
    """Templates that are in at least MIN_DOCS texts."""
    found = rows.select("template", "body").distinct().groupBy("template").count()
    return common.checkpointed(found.where(F.col("count") >= MIN_DOCS).select("template"))


def dropped_lines(docs: DataFrame) -> DataFrame:
    """gone_body, dropped: positions of the lines that go, one row per text that has any; written out."""
    with common.workspace(docs.sparkSession, "lines") as kept:
        return common.checkpointed(_dropped_lines(docs, kept))


def _dropped_lines(docs: DataFrame, kept: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    stays = F.lit(None).cast("array<int>")
    for m in range(SEGMENTS + 1):
        stays = F.when(F.size("g") == m, F.array(*map(F.lit, patterns(m)))).otherwise(stays)
    rows = candidates(docs, kept).select("body", "pos", "chars", "total", F.explode(keys(stays)).alias("template"))
    rows = kept(rows, "templates")
    shared = common.checkpointed(rows.join(recurring(rows), "template", "left_semi"))
    per_text = shared.select("body", "pos", "chars", "total").distinct().groupBy("body").agg(F.sum("chars").alias("again"), F.first("total").alias("total"))
    carriers = common.checkpointed(per_text.where(F.col("again") * COPY_SHARE[1] <= F.col("total") * COPY_SHARE[0]).select("body"))
    boilerplate = recurring(shared.join(carriers, "body", "left_semi"))
    gone = shared.join(boilerplate, "template", "left_semi")
    return gone.groupBy(F.col("body").alias("gone_body")).agg(F.array_sort(F.collect_set("pos")).alias("dropped"))


def drop_lines(docs: DataFrame, extra: bool = False) -> DataFrame:
    """docs without the lines of recurring templates; extra adds line_count and line_dropped."""
    gone = dropped_lines(docs)
    positions = gone.agg(F.coalesce(F.sum(F.size("dropped")), F.lit(0))).first()[0]
    gone = F.broadcast(gone) if positions <= MAX_BROADCAST else gone
    # The row stands aside as one struct, so that no column of it can clash.
    rows = docs.select(F.struct("*").alias("row"), docs["text"].alias("text"), body(docs["text"]).alias("body"))
    joined = rows.join(gone, F.col("body") == F.col("gone_body"), "left")
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains("dropped", i)), "\n")
    changed = F.col("dropped").isNotNull()
    joined = joined.select("row", "text", "dropped", F.when(changed, left).otherwise(F.col("text")).alias("left"))
    own = {"text": F.col("left"), "n_chars": F.when(changed, F.char_length("left").cast("long")).otherwise(F.col("row")["n_chars"]) if "n_chars" in docs.columns else None}
    columns = [(own.get(c) if c in own else F.col("row")[c]).alias(c) for c in docs.columns]
    if extra:
        columns += [F.size(F.split(common.whole("text"), "\n", -1)).cast("long").alias("line_count"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("line_dropped")]
    return joined.select(*columns)


def line_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_chars and the digest of the text that is left."""
    done = drop_lines(docs.select("doc_id", "text"), extra=True)
    text = common.whole("text")
    return done.select("doc_id", F.col("line_count").alias("n_lines"), F.col("line_dropped").alias("n_dropped"), F.char_length(text).cast("long").alias("kept_chars"), F.sha2(text, 256).alias("kept_sha256"))


def oracle_ctes(documents: str = "documents") -> str:
    """DuckDB: the tables ln (lines) and gone (row, pos of the lines dropped) over documents; every line with all of its templates."""
    rows = ", ".join(f"({m}, {p}, [{', '.join(str(k) for k in range(m) if p >> k & 1)}]::INTEGER[])" for m in range(SEGMENTS + 1) for p in patterns(m))
    return rf"""
ld AS (SELECT row_number() OVER () AS row, * FROM {documents}),
l0 AS (SELECT row, doc_id, coalesce(text, '') AS body, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM ld),
l1 AS (SELECT *, length(line) AS chars, string_split_regex(trim(regexp_replace(line, '{VARIABLE}', '<*>', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[{common.SPACE}]+') AS t FROM l0),
l2 AS (SELECT row, body, pos, chars, t, CAST(greatest(len(t) - {LEADING}, 0) AS BIGINT) AS rest, CAST(least(greatest(len(t) - {LEADING}, 0), {SEGMENTS}) AS BIGINT) AS m FROM l1 WHERE t[1] <> ''),
l3 AS (SELECT row, body, pos, chars, m, concat_ws(' ', CAST(len(t) AS VARCHAR), t[1], t[2]) AS leaf, list_transform(range(0, m), lambda k: array_to_string(t[{LEADING} + 1 + k * rest // m : {LEADING} + (k + 1) * rest // m], ' ')) AS g FROM l2),
pt AS (SELECT * FROM (VALUES {rows}) p(m, p, kept)),
lt0 AS (SELECT row, body, pos, chars, concat_ws('|', leaf, p, array_to_string(list_transform(kept, lambda k: g[k + 1]), '|')) AS template FROM l3 JOIN pt ON l3.m = pt.m),
lr AS (SELECT template FROM lt0 GROUP BY template HAVING count(DISTINCT body) >= {MIN_DOCS}),
lx AS (SELECT * FROM lt0 WHERE template IN (SELECT template FROM lr)),
lc AS (SELECT body FROM (SELECT DISTINCT body, pos, chars FROM lx) GROUP BY body HAVING sum(chars) * {COPY_SHARE[1]} <= length(body) * {COPY_SHARE[0]}),
lb AS (SELECT template FROM lx WHERE body IN (SELECT body FROM lc) GROUP BY template HAVING count(DISTINCT body) >= {MIN_DOCS}),
gone AS (SELECT DISTINCT row, pos FROM lx WHERE template IN (SELECT template FROM lb)),
lt AS (SELECT l0.row, count(*) AS n_lines, count(gone.pos) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY l0.pos) FILTER (gone.pos IS NULL), '') AS kept FROM l0 LEFT JOIN gone ON l0.row = gone.row AND l0.pos = gone.pos GROUP BY l0.row)"""


def oracle() -> str:
    return f"""
WITH {oracle_ctes()}
SELECT doc_id, n_lines, n_dropped, CAST(length(kept) AS BIGINT) AS kept_chars, sha256(kept) AS kept_sha256 FROM ld JOIN lt USING (row)"""
