"""Secret scans.

Three fixed kinds of secret are found by pattern. Beside them, every long run of key characters is a candidate:
a window slides over it, the Shannon entropy inside is kept up by incremental counts (one character enters, one
leaves), and the run is a span of kind "entropy" if its densest window reaches the threshold of the run's
character class and no allow-list pattern fits it. Spans of the three fixed kinds are never removed.

All of it is column expressions: matches and the gaps between them give positions by running sums, and the
window is a fold over the characters of a candidate. Each text is scanned once per kind, and once more for the gaps
of the kinds that it holds; folds run only where something was found. There is no shuffle.

Positions count code points, the end exclusive. Edge cases: a null or empty text has no spans; the digest is
then that of the empty string; repeated rows give repeated results; an empty table gives an empty result; other
columns are ignored. Running sums are kept in blocks, so a text with very many matches costs little more than
in proportion; a very long candidate is cut into overlapping pieces, tried in turn, so that it costs in proportion, and little where
its first pieces are dense already.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.functions.scalars import bound

from . import common

#: The fixed kinds in their order: pattern, group whose length counts (0: the match), least length.
KINDS = {
    "assign": (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
}
#: Runs that are candidates for the entropy window.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Character classes, narrowest first: pattern of the whole candidate, entropy in bits that its densest window must reach.
CLASSES = {"hex": (r"^[0-9a-fA-F]+$", 3.0), "alnum": (r"^[A-Za-z0-9]+$", 3.6), "base64": (r"^[A-Za-z0-9+/_=-]+$", 3.8)}
#: A candidate must have a digit and a letter; runs of words alone are prose.
NEEDS = (r"[0-9]", r"[A-Za-z]")
#: Candidates that are no secrets: universally unique ids, documented examples, fillers, counting runs.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|sample|placeholder|changeme|dummy",
    r"(?i)x{6}|0{8}|12345678|abcdefgh",
)
WINDOW = 20
#: Entropy is added up in millionths of a bit, as integers, so that its order of summing doesn't matter.
UNIT = 1_000_000
#: count * log2(count) by count.
WEIGHTS = [0] + [round(UNIT * n * math.log2(n)) for n in range(1, WINDOW + 1)]
BLOCK = 256
#: Windows that one fold looks at, and the character that stands for a count of zero.
PIECE, DIGIT = 1024, 48
SPANS = "array<struct<start:int,stop:int>>"


def most_surprise(bits: float) -> int:
    """The largest sum of weights inside a window that still has so many bits a character."""
    return round(UNIT * WINDOW * (math.log2(WINDOW) - bits))


def positions(gaps: Column, matches: Column) -> Column:
    """Spans of matches, by the lengths of the texts before, between and after them; blockwise running sums."""
    empty = F.array().cast(SPANS)
    lengths = lambda gaps: F.transform(matches, lambda m, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), F.length(m).alias("own")))

    def inside(block: Column) -> Column:
        step = lambda acc, x: F.struct((acc["at"] + x["gap"] + x["own"]).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["own"]).alias("stop")))).alias("out"))
        return F.aggregate(block, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)

    firsts = F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / BLOCK).cast("int"))
    blocks = bound(bound(gaps, lengths), lambda x: F.transform(firsts, lambda b: inside(F.slice(x, b * BLOCK + 1, F.lit(BLOCK)))))
    shifted = lambda acc, x: F.transform(x["out"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["stop"] + acc["at"]).alias("stop")))
    total = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), empty.alias("out")), lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], shifted(acc, x)).alias("out")), lambda acc: acc["out"])
    return F.when(F.size(matches) > 0, total).otherwise(empty)


def moves(codes: Column) -> Column:
    """For every character of a piece, what enters the window, what leaves it (-1: nothing), and whether it is full."""
    return F.transform(codes, lambda c, i: F.struct(c.alias("enters"), F.when(i >= WINDOW, F.get(codes, i - WINDOW)).otherwise(-1).alias("leaves"), (i >= WINDOW - 1).alias("full")))


def least_weight(letters: Column) -> Column:
    """The least sum of weights in any window over an array of characters, kept up by incremental counts.

    The counts are a text with one digit (from DIGIT on) for each character of the alphabet, of which a move overlays two.
    """
    weight = lambda n: F.get(F.array(*map(F.lit, WEIGHTS)), n)
    count = lambda counts, c: F.ascii(F.substr(counts, c + 1, F.lit(1))) - DIGIT
    put = lambda counts, c, n: F.overlay(counts, F.char(n + DIGIT), c + 1, F.lit(1))
    state = F.struct(F.lit(chr(DIGIT) * len(ALPHABET)).alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(UNIT * 1000).cast("long").alias("least"))

    def step(acc: Column, m: Column) -> Column:
        left = F.when(m["leaves"] < 0, F.struct(acc["counts"].alias("counts"), acc["sum"].alias("sum"))).otherwise(
            bound(count(acc["counts"], m["leaves"]), lambda n: F.struct(put(acc["counts"], m["leaves"], n - 1).alias("counts"), (acc["sum"] - weight(n) + weight(n - 1)).alias("sum")))
        )
        come = lambda x, n: F.struct(put(x["counts"], m["enters"], n + 1).alias("counts"), (x["sum"] - weight(n) + weight(n + 1)).alias("sum"))
        moved = bound(left, lambda x: bound(count(x["counts"], m["enters"]), lambda n: come(x, n)))
        return bound(moved, lambda x: F.struct(x["counts"].alias("counts"), x["sum"].cast("long").alias("sum"), F.when(m["full"], F.least(acc["least"], x["sum"].cast("long"))).otherwise(acc["least"]).alias("least")))

    codes = F.transform(letters, lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    return F.aggregate(bound(codes, moves), state, step, lambda acc: acc["least"])


def dense(candidate: Column, limit: Column, needs: Column) -> Column:
    """Whether any window's sum of weights is within limit.

    The candidate is cut into pieces that overlap by a window less one, tried in turn until one is dense; a piece with fewer
    different characters than a dense window needs has none.
    """

    def tried(letters: Column) -> Column:
        firsts = F.sequence(F.lit(0), F.greatest(F.size(letters) - WINDOW, F.lit(0)), F.lit(PIECE))
        piece = lambda at: F.slice(letters, at + 1, F.lit(PIECE + WINDOW - 1))
        return F.exists(firsts, lambda at: bound(piece(at), lambda p: F.when(F.size(F.array_distinct(p)) >= needs, least_weight(p) <= limit).otherwise(F.lit(False))))

    return bound(F.split(candidate, ""), tried)


def is_secret(candidate: Column) -> Column:
    """Whether a candidate's densest window reaches its class's threshold and no allow-list pattern fits."""
    bits = [b for _, b in CLASSES.values()]
    limit, needs = F.lit(most_surprise(bits[-1])), F.lit(math.ceil(2 ** bits[-1]))
    for pattern, b in list(CLASSES.values())[-2::-1]:
        limit = F.when(candidate.rlike(pattern), F.lit(most_surprise(b))).otherwise(limit)
        needs = F.when(candidate.rlike(pattern), F.lit(math.ceil(2**b))).otherwise(needs)
    fits = F.lit(True)
    for pattern in NEEDS:
        fits = fits & candidate.rlike(pattern)
    for pattern in ALLOWED:
        fits = fits & ~candidate.rlike(pattern)
    return F.when(fits, bound(F.struct(limit.alias("limit"), needs.alias("needs")), lambda x: dense(candidate, x["limit"], x["needs"]))).otherwise(F.lit(False))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id with one array of spans for each kind: assign, access, hex, entropy."""
    text = common.whole("text")
    found = docs.select("doc_id", text.alias("text"))
    patterns = {k: v[0] for k, v in KINDS.items()} | {"entropy": CANDIDATE}
    found = found.withColumns({f"{k}_texts": F.regexp_extract_all("text", F.lit(p), F.lit(0)) for k, p in patterns.items()})
    gaps = {k: F.when(F.size(f"{k}_texts") > 0, F.split("text", p, -1)).otherwise(F.array().cast("array<string>")) for k, p in patterns.items()}
    found = found.select("doc_id", *(f"{k}_texts" for k in patterns), *(g.alias(f"{k}_gaps") for k, g in gaps.items()))
    found = found.withColumns({f"{k}_all": positions(F.col(f"{k}_gaps"), F.col(f"{k}_texts")) for k in patterns})

    def kept(kind: str, test) -> Column:
        texts = F.col(f"{kind}_texts")
        return F.filter(F.col(f"{kind}_all"), lambda _, i: test(F.get(texts, i)))

    tests = {k: (lambda m, p=p, g=g, least=least: F.length(F.regexp_extract(m, f"^{p}$" if g else "(?s)^.*$", g)) >= least) for k, (p, g, least) in KINDS.items()}
    found = found.select("doc_id", *(kept(k, t).alias(k) for k, t in tests.items()), kept("entropy", is_secret).alias("dense"))
    base = F.concat(*(F.col(k) for k in KINDS))
    new = F.filter("dense", lambda s: ~F.exists(base, lambda b: (b["start"] <= s["start"]) & (s["stop"] <= b["stop"])))
    return found.select("doc_id", *KINDS, new.alias("entropy"))


def listed(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans of these kinds, by start, then kind as listed; comma-joined."""

    def tagged(k: str, n: int) -> Column:
        return F.transform(k, lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("kind"), s["stop"].alias("stop")))

    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(F.array_sort(F.concat(*(tagged(k, n) for n, k in enumerate(kinds)))), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """The contract's columns of find_secrets."""
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in (*KINDS, "entropy")]
    return find_secrets(docs).select("doc_id", *counts, F.sha2(listed(tuple(KINDS)), 256).alias("base_sha256"), listed((*KINDS, "entropy")).alias("spans"))


def oracle() -> str:
    """The same in DuckDB's SQL; windows are listed one by one there."""
    patterns = {k: v[0].replace("'", "''") for k, v in KINDS.items()} | {"entropy": CANDIDATE}
    patterns = {k: p.replace("(?<![0-9a-f])", "").replace("(?<![A-Za-z0-9+/_=-])", "") for k, p in patterns.items()}
    keys = [*KINDS, "entropy"]
    own = lambda k: f"length(regexp_extract(m, '^{patterns[k]}$', 1)) >= {KINDS[k][2]}" if KINDS[k][1] else f"length(m) >= {KINDS[k][2]}"
    limit = "CASE " + " ".join(f"WHEN regexp_matches(m, '{p}') THEN {most_surprise(b)}" for p, b in CLASSES.values()) + " END"
    fits = " AND ".join([*(f"regexp_matches(m, '{p}')" for p in NEEDS), *(f"NOT regexp_matches(m, '{p}')" for p in ALLOWED)])
    parts = " UNION ALL ".join(
        f"SELECT doc_id, row, {n} AS kind, '{k}' AS name, unnest(regexp_extract_all(text, '{patterns[k]}')) AS m, unnest(regexp_split_to_array(text, '{patterns[k]}')[:-2]) AS gap, generate_subscripts(regexp_extract_all(text, '{patterns[k]}'), 1) AS i FROM d WHERE len(regexp_extract_all(text, '{patterns[k]}')) > 0"
        for n, k in enumerate(keys)
    )
    tests = " ".join(f"WHEN '{k}' THEN {own(k)}" for k in KINDS)
    weights = "[" + ", ".join(map(str, WEIGHTS)) + "]"
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS text FROM documents),
parts AS ({parts}),
placed AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY row, kind ORDER BY i) AS stop FROM parts),
dense AS (SELECT row, m, i, min(w) AS least FROM (
    SELECT row, m, i, j, sum({weights}[n + 1]) AS w FROM (
      SELECT row, m, i, j, c, count(*) AS n FROM (
        SELECT row, m, i, j, substr(m, CAST(j + x AS BIGINT), 1) AS c FROM (SELECT row, m, i, unnest(range(1, CAST(length(m) - {WINDOW - 2} AS BIGINT))) AS j FROM placed WHERE kind = 3 AND {fits}), range(0, {WINDOW}) AS y(x))
      GROUP BY ALL) GROUP BY ALL) GROUP BY ALL),
base AS (SELECT row, kind, name, CAST(stop - length(m) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM placed WHERE CASE name {tests} ELSE false END),
more AS (SELECT a.row, 3 AS kind, 'entropy' AS name, CAST(a.stop - length(a.m) AS BIGINT) AS start, CAST(a.stop AS BIGINT) AS stop
  FROM placed a JOIN dense s ON a.row = s.row AND a.i = s.i AND a.kind = 3 WHERE s.least <= (SELECT {limit} FROM (SELECT a.m AS m))),
new AS (SELECT * FROM more WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.row = more.row AND b.start <= more.start AND more.stop <= b.stop)),
allspans AS (SELECT * FROM base UNION ALL SELECT * FROM new),
g AS (SELECT row, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS k, count(*) FILTER (kind = 2) AS h, count(*) FILTER (kind = 3) AS e,
    coalesce(string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < 3), '') AS base, string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans
  FROM allspans GROUP BY row)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, coalesce(e, 0) AS n_entropy, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.row = g.row"""
