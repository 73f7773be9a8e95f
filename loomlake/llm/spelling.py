"""Spelling variants: words one edit apart, found by Aho-Corasick automata of their halves.

Words are counted over all texts. Two words one inserted, deleted or replaced code point apart have one half of either in
common: cut a word in two, and the other word begins with the first half or ends with the second. So every word's two halves
are the patterns of automata, dealt into shards by a hash of the half; a word goes to the shards of the halves that
its neighbours can have (two by which it may begin, two by which it may end), and is scanned there. A match
counts if the half stands at its place (at the start, or at the end) and the lengths differ by one at most; what is left between
is looked up by halves of its own and verified letter by letter. A pair that both of its halves find is counted at the first.

A half that very many words share is no shard of its own: beyond MAX_SEGMENT words its words are dealt out anew, by that
half with a half of what is left of each word, and so on; a word that is one edit away shares one of these too. Nothing is dropped.
A shard returns one row per word, not pairs: its number of neighbours there and the best of them.

A word's form is its most frequent neighbour if that is RATIO times as frequent; roots follow forms to their end by doubling, in as
many rounds as the logarithm of the longest chain, which each step's ratio bounds.

Edge cases: a null text has no words; a null id is `null` in the hash; very long texts and words are read whole; repeated rows count
again; ties go to the smaller word by code points; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Letters of a word besides A-Z.
LETTERS = r"a-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
#: Runs whose hash this divides lose a letter.
ERRORS = 31
#: Halves of one shard, and words that may share a half before it is cut further; these must be more than there are letters,
#: since words that differ in one place alone have nothing left to cut.
SHARD, MAX_SEGMENT = 4096, 1024
#: Hashes of halves that are broadcast at most, eight bytes each.
MAX_BROADCAST = 1_000_000
LINKS = "word string, near long, best_n long, best string"


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: runs of letters, some of them less a letter as their hash says, of MIN_LENGTH or more and seen MIN_COUNT times; written out."""
    rows = docs.select(F.coalesce(docs["doc_id"].cast("long").cast("string"), F.lit("null")).alias("id"), common.ascii_lower(common.whole(docs["text"])).alias("text"))
    # Shorter runs are no matches, and longer ones are matched whole.
    runs = rows.select("id", F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{MIN_LENGTH},}}"), F.lit(0))).alias("run"))
    runs = runs.select("run", F.char_length("run").alias("length"), F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.col("length")).cast("int")
    less = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(F.col("h") % ERRORS != 0, F.col("run")).when(F.col("length") > MIN_LENGTH, less)
    # What is too short is null, and its count zero.
    counted = runs.select(word.alias("word")).groupBy("word").agg(F.count("word").alias("n"))
    return common.checkpointed(counted.where(F.col("n") >= MIN_COUNT))


def halves(rows: DataFrame) -> DataFrame:
    """rows (word, n, path, head, tail, holds), each dealt on to the halves of what lies between head and tail.

    head and tail are the numbers of code points that are already agreed upon at both ends, path the sides taken so far. A word's own
    halves are held (as patterns); those by which words one shorter or longer would be cut are for looking up alone.
    """
    m = F.char_length("word") - F.col("head") - F.col("tail")
    first, second, odd = F.floor(m / 2).cast("int"), F.ceil(m / 2).cast("int"), m % 2

    def half(side: str, head: Column, tail: Column, own: bool) -> Column:
        return F.struct(F.concat("path", F.lit(side)).alias("path"), head.alias("head"), tail.alias("tail"), (F.col("holds") if own else F.lit(False)).alias("holds"))

    sides = F.array(
        half("P", F.col("head") + first, F.col("tail"), True),
        half("P", F.col("head") + F.when(odd == 1, first + 1).otherwise(first - 1), F.col("tail"), False),
        half("S", F.col("head"), F.col("tail") + second, True),
        half("S", F.col("head"), F.col("tail") + F.when(odd == 1, second - 1).otherwise(second + 1), False),
    )
    fits = lambda x: (x["head"] >= F.col("head")) & (x["head"] + x["tail"] <= F.char_length("word"))
    rows = rows.select("word", "n", F.explode(F.filter(sides, fits)).alias("x")).select("word", "n", "x.*")
    key = F.xxhash64("path", F.substr("word", F.lit(1), F.col("head")), F.substr("word", F.char_length("word") - F.col("tail") + 1))
    return rows.select("*", key.alias("key"))


def dealt(words: DataFrame) -> DataFrame:
    """Every word with the halves under which it is held and looked up, none held by more than MAX_SEGMENT words."""
    done, pending = None, words.select("word", "n", F.lit("").alias("path"), F.lit(0).alias("head"), F.lit(0).alias("tail"), F.lit(True).alias("holds"))
    while True:
        rows = common.checkpointed(halves(pending))
        hot = rows.where("holds").groupBy("key").agg(F.count("*").alias("held")).where(F.col("held") > MAX_SEGMENT).select("key")
        hot = common.sized(hot, MAX_BROADCAST)
        cool = rows.join(hot, "key", "left_anti")
        done = cool if done is None else done.unionByName(cool)
        if hot.isEmpty():
            return done
        pending = rows.join(hot, "key", "left_semi").drop("key")


def one_edit(a: str, b: str) -> bool:
    """Whether two texts, whose lengths differ by one at most, are exactly one edit apart."""
    for k, (x, y) in enumerate(zip(a, b, strict=False)):
        if x != y:
            return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]
    return len(a) != len(b)


def parts(word: str, path: str) -> Iterable[tuple[str, int, int, int]]:
    """Along a path, for each side taken: the side, head and tail before it, and the head that the first side would give."""
    head = tail = 0
    for side in path:
        m = len(word) - head - tail
        yield side, head, tail, head + m // 2
        head, tail = (head + m // 2, tail) if side == "P" else (head, tail + m - m // 2)


def is_first(u: str, w: str, path: str) -> bool:
    """Whether no earlier path finds the pair: wherever the second half was taken, the first doesn't fit."""
    return not any(side == "S" and u.startswith(w[:on]) and len(u) >= on + tail for side, _, tail, on in parts(w, path))


def automaton(held: Iterable[tuple[str, str, int, int]]) -> ahocorasick.Automaton:
    """Of the longer end of every half: whether it stands at the start, both ends, path, and the words by length and halves of what is between."""
    entries: dict = {}
    for w, path, head, tail in held:
        ends = (path, w[:head], w[len(w) - tail :])
        middle = w[head : len(w) - tail]
        m, index = len(middle), entries.setdefault(ends, {})
        index.setdefault((0, m, middle[: m // 2]), []).append((middle, w))
        index.setdefault((1, m, middle[m // 2 :]), []).append((middle, w))
    patterns: dict = {}
    for (path, a, b), index in entries.items():
        patterns.setdefault(max(a, b, key=len), []).append((len(a) >= len(b), a, b, path, index))
    built = ahocorasick.Automaton()
    for pattern, own in patterns.items():
        built.add_word(pattern, own)
    built.make_automaton()
    return built


def neighbours(u: str, built: ahocorasick.Automaton) -> set[str]:
    """Words of an automaton that are one edit from u and found by no earlier path."""
    found = set()
    for end, own in built.iter(u):
        for at_start, a, b, path, index in own:
            m = len(u) - len(a) - len(b)
            if m < 0 or not (end == len(a) - 1 and u.endswith(b) if at_start else end == len(u) - 1 and u.startswith(a)):
                continue
            middle = u[len(a) : len(u) - len(b)]
            for k in (m - 1, m, m + 1):
                second = k - k // 2
                near = [*index.get((0, k, middle[: k // 2]), ()), *(index.get((1, k, middle[m - second :]), ()) if second <= m else ())]
                found.update(w for other, w in near if one_edit(middle, other) and is_first(u, w, path))
    return found


def shard_links(table: pa.Table) -> pa.Table:
    """All words of a shard scanned by its automaton: LINKS of those that have neighbours here."""
    columns = [table.column(c).to_pylist() for c in ("word", "n", "path", "head", "tail", "holds")]
    n = dict(zip(columns[0], columns[1], strict=True))
    built = automaton((w, path, head, tail) for w, _, path, head, tail, holds in zip(*columns, strict=True) if holds)
    rows = []
    if len(built):
        for u in n:
            if found := neighbours(u, built):
                most = max(map(n.__getitem__, found))
                rows.append((u, len(found), most, min(w for w in found if n[w] == most)))
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)], ["word", "near", "best_n", "best"])


def links(words: DataFrame) -> DataFrame:
    """LINKS: for every word with neighbours their number, and the count and name of the most frequent."""
    shards = max(1, -(-2 * words.count() // SHARD))
    rows = dealt(words).select(F.pmod("key", F.lit(shards)).alias("shard"), "word", "n", "path", "head", "tail", "holds")
    found = rows.groupBy("shard").applyInArrow(shard_links, LINKS)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    found = found.groupBy("word").agg(F.sum("near").alias("near"), best.alias("b"))
    return found.select("word", "near", (-F.col("b.less")).alias("best_n"), "b.best")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where forms (word, form) lead in the end."""
    chain = common.checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        up = chain.select(F.col("word").alias("up"), F.col("root").alias("on"))
        chain = common.checkpointed(chain.join(up, F.col("root") == F.col("up"), "left").select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")))
        moved = not chain.where("moved").isEmpty()
        chain = chain.drop("moved")
        if not moved:
            return chain


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The contract's columns: one row per word."""
    words = word_counts(docs)
    found = words.join(links(words), "word", "left")
    takes = F.col("best_n") >= RATIO * F.col("n")
    found = common.checkpointed(found.select("word", F.when(takes, F.col("best")).alias("form"), "n", F.coalesce("near", F.lit(0).cast("long")).alias("n_near"), F.when(takes, F.col("best_n")).alias("form_n")))
    ends = roots(found.where(F.col("form").isNotNull()).select("word", "form"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle() -> str:
    """The same in DuckDB's SQL: neighbours share the word with one letter left out or open, at the same place."""
    crc = "list_reduce(range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)"
    return rf"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: {crc}) AS t),
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), 'null') AS d, unnest(regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
b AS (SELECT run, hex(encode(d || ':' || run)) AS x FROM r WHERE length(run) >= {MIN_LENGTH}),
h AS (SELECT run, xor(list_reduce(range(length(x) // 2), lambda c, k: xor(c >> 8, t[xor(c & 255, CAST('0x' || x[2 * k + 1 : 2 * k + 2] AS BIGINT)) + 1]), 4294967295), 4294967295) AS h FROM b, t),
m AS (SELECT CASE WHEN h % {ERRORS} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h),
v AS (SELECT word, count(*) AS n FROM m WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING count(*) >= {MIN_COUNT}),
k AS (SELECT word, n, unnest(range(length(word))) AS i FROM v),
o AS (SELECT word, n, i, substr(word, 1, i) AS a, substr(word, i + 2) AS z FROM k),
p AS (SELECT x.word, y.word AS other, y.n AS other_n FROM o x JOIN o y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.word <> y.word
  UNION SELECT o.word, v.word, v.n FROM o JOIN v ON o.a || o.z = v.word
  UNION SELECT v.word, o.word, o.n FROM o JOIN v ON o.a || o.z = v.word),
s AS (SELECT word, count(*) AS n_near, max(other_n) AS most, min(other) FILTER (other_n = top) AS best FROM (SELECT *, max(other_n) OVER (PARTITION BY word) AS top FROM p) GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {RATIO} * v.n THEN best END AS form, CASE WHEN most >= {RATIO} * v.n THEN most END AS form_n FROM v LEFT JOIN s USING (word)),
c AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT c.word, f.word, f.form FROM c JOIN f ON c.next = f.word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN c ON f.word = c.word AND c.next IS NULL"""
