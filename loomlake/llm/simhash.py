"""SimHash near-duplicates with pivot distance tables.

Texts become 64-bit fingerprints; equal ones are one class. Of each class the Hamming distances to PIVOTS
reference fingerprints are tabled. Two fingerprints within r bits of each other differ by at most r in every
coordinate of that table, so what differs by more in any is discarded before a pair is built, and the pairs that
survive are verified bit by bit. In 64 bits a table is no join key (distances to any reference crowd around 32), so
fingerprints meet under keys that lose none: the 64 bits are cut into stretches, and two fingerprints that
differ in at most RADIUS bits agree in all stretches but RADIUS. The number of stretches follows the number of
classes, so that by chance a key has about one member at any size.

A key with at most SMALL members is one array, sifted by the table. Larger ones, which near copies in great number
make, are dealt into shards; every pair of shards is one bounded group in which a walk over the pivot
table gives a spanning forest, never all pairs. Components then come from the links by alternating large and small
stars, each round written to the checkpoint folder; nothing is collected.

near_duplicates() links texts by similarity of their word shingles. Fingerprints, their keys and pivot tables bring
texts together as above; so do, for similar texts that differ in more than RADIUS bits, bands of a MinHash sketch, where the
sizes of the shingle sets and the sketch, with a wide margin, discard. The sets of every pair that either way proposes are
compared in full, by the same rule whatever the size of a key: fingerprints count repeats, the sets do not.

Edge cases: a null text is empty; a text without words has fingerprint zero and is linked like any other; fewer
words than a shingle are one shingle; repeated rows are one class; null ids belong to their class, whose id is the
smallest that is not null; very long texts are taken whole; an empty table gives an empty result; other columns
are ignored here and kept by drop_near_duplicates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SEED = 42
RADIUS = 3
#: Reference fingerprints; their distances are packed eight to a long.
PIVOTS_N = 16
#: Largest key that is joined with itself, and members of a shard of a larger one.
SMALL, SHARD = 32, 1024
#: The sketch of near_duplicates: values, values per band, and the similarity (of the shingle sets) that links.
#: With independent values a pair of that similarity has no band of four in common once in 12 million.
SKETCH, BAND, SIMILARITY = 126, 4, 0.8
#: The sketch only discards: pairs whose estimate is lower by more than seven of its deviations (0.0356) there.
MARGIN = 0.25


def reference(k: int) -> int:
    """The k-th reference fingerprint."""
    return int.from_bytes(hashlib.sha256(b"pivot %d" % k).digest()[:8], "little")


PIVOTS = [reference(k) for k in range(PIVOTS_N)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Hashes of all runs of so many words, repeats included; of the whole sequence if it is shorter."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.empty(0, np.uint64)
    runs = zip(*(w[k:] for k in range(words)), strict=False) if len(w) >= words else [w]
    n = max(1, len(w) - words + 1)
    return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, runs), repeat(SEED)), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits that more than half of the hashes have; zero without hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = ones * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, body (hash of the text), fp (as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(shingle_hashes(t, words)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["doc_id", "body", "fp"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(common.whole(docs["text"])).alias("body"), docs["text"])
    return rows.mapInArrow(run, "doc_id long, body long, fp long")


def pivot_table(fp: Column) -> Column:
    """The distances to the reference fingerprints, eight bits each, eight to a long."""
    longs = []
    for at in range(0, len(PIVOTS), 8):
        packed = F.lit(0).cast("long")
        for k, p in enumerate(PIVOTS[at : at + 8]):
            packed = packed.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(signed(p)))).cast("long"), 8 * k))
        longs.append(packed.alias(f"t{at // 8}"))
    return F.struct(*longs)


def within(a: Column, b: Column, radius: int) -> Column:
    """Whether no coordinate of two pivot tables differs by more than radius."""
    ok = F.lit(True)
    for k in range(len(PIVOTS)):
        coordinate = lambda t, k=k: F.shiftright(t[f"t{k // 8}"], 8 * (k % 8)).bitwiseAND(F.lit(255))
        ok = ok & (F.abs(coordinate(a) - coordinate(b)) <= radius)
    return ok


def stretches(classes: int) -> int:
    """How many stretches to cut so that the bits of RADIUS fewer tell so many classes apart; seven of 64 bits are the most that is worth it."""
    return next((m for m in (5, 6) if 64 * (m - RADIUS) // m >= classes.bit_length()), 7)


def key_masks(n: int) -> list[int]:
    """Masks of all but RADIUS of n stretches of 64 bits."""
    ends = [64 * k // n for k in range(n + 1)]
    stretch = [(1 << ends[k + 1]) - (1 << ends[k]) for k in range(n)]
    return [signed(sum(stretch[k] for k in kept)) for kept in combinations(range(n), n - RADIUS)]


def forest(values: np.ndarray, tables: np.ndarray, radius: int, alike) -> list[tuple[int, int]]:
    """Links (parent, child) of a spanning forest: from node to node, the table first, then alike(v, others)."""
    left = np.arange(len(values))
    links, queue = [], []
    while len(left) or queue:
        if not queue:
            queue, left = [left[0]], left[1:]
        v = queue.pop()
        if not len(left):
            continue
        survivors = np.flatnonzero(np.abs(tables[left] - tables[v]).max(axis=1) <= radius)
        survivors = survivors[alike(v, left[survivors])]
        links += [(v, w) for w in left[survivors]]
        queue += list(left[survivors])
        left = np.delete(left, survivors)
    return links


def _tables(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[:, None] ^ np.array(PIVOTS, np.uint64)[None, :]).astype(np.int16)


def sharded(members: DataFrame, key: list[str], sizes: DataFrame, node: str) -> DataFrame:
    """members of large keys, dealt so that every two members of a key meet in one bounded group (key..., low, high)."""
    shards = F.ceil(F.col("n") / SHARD).cast("int")
    large = members.join(sizes.where(F.col("n") > SMALL), key).withColumn("shard", F.pmod(F.xxhash64(F.lit(1), node), shards).cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), shards - 1)))
    return large.withColumns({"low": F.least("shard", "other"), "high": F.greatest("shard", "other")}).drop("n", "shard", "other")


def hamming_links(classes: DataFrame) -> DataFrame:
    """a, b: links between fingerprints (column fp, distinct) that differ in at most RADIUS bits; enough of them to connect what all would."""
    masks = key_masks(stretches(classes.count()))
    keyed = F.array(*(F.struct(F.lit(k).cast("byte").alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(masks)))
    members = classes.select("fp", F.inline(keyed))
    sizes = members.groupBy("part", "bits").agg(F.count("*").alias("n")).where("n > 1")
    members = common.checkpointed(members.join(sizes, ["part", "bits"]).select("part", "bits", "fp", "n"))
    few = members.where(F.col("n") <= SMALL).groupBy("part", "bits").agg(F.collect_list(F.struct("fp", pivot_table(F.col("fp")).alias("table"))).alias("own"))
    later = lambda i: F.slice("own", i + 2, F.size("own"))
    sifted = lambda x, i: F.transform(F.filter(later(i), lambda y: within(x["table"], y["table"], RADIUS)), lambda y: F.struct(x["fp"].alias("a"), y["fp"].alias("b")))
    pairs = few.select(F.inline(F.flatten(F.transform("own", sifted))))
    links = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        fps = np.unique(group["fp"].to_numpy().astype(np.uint64))
        alike = lambda v, others: np.bitwise_count(fps[others] ^ fps[v]) <= RADIUS
        pairs = np.array(forest(fps, _tables(fps), RADIUS, alike), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": fps[pairs[:, 0]].astype(np.int64), "b": fps[pairs[:, 1]].astype(np.int64)})

    many = sharded(members.where(F.col("n") > SMALL).drop("n"), ["part", "bits"], sizes, "fp")
    walked = many.groupBy("part", "bits", "low", "high").applyInPandas(walk, "a long, b long")
    return links.unionByName(walked)


def stars(links: DataFrame) -> DataFrame:
    """node, root for every node of the links a, b: the smallest node that it is connected with."""
    edges = common.checkpointed(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = None
    while True:
        signature = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if signature == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        seen = signature
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("of")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        edges = both.join(least, F.col("a") == F.col("of")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = edges.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("m"))
        joined = edges.join(least, F.col("a") == F.col("of"))
        edges = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = common.checkpointed(edges)


def simhash_components(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, body, fp, component_id: the smallest doc_id reachable over links of at most RADIUS bits."""
    rows = common.checkpointed(fingerprints(docs, words))
    classes = common.checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    return _labelled(rows, classes, "fp", stars(hamming_links(classes)))


def _labelled(rows: DataFrame, classes: DataFrame, node: str, roots: DataFrame) -> DataFrame:
    """rows with the smallest id of their component; classes: node, least_id."""
    rooted = classes.join(roots, F.col(node) == F.col("node"), "left").select(node, "least_id", F.coalesce("root", node).alias("root"))
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(named, "root").select(F.col(node).alias("node"), "root", "component_id")
    return rows.join(named, F.col(node) == F.col("node")).drop("node")


def simhash_report(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return simhash_components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def multipliers() -> np.ndarray:
    """Odd 64-bit factors, one per value of a sketch."""
    return np.array([int.from_bytes(hashlib.sha256(b"sketch %d" % k).digest()[:8], "little") | 1 for k in range(SKETCH)], np.uint64)


def sketches(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, body, fp (of all shingles), size (distinct shingles), sketch (least values of the shingle hashes under SKETCH multiplications)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = multipliers()
        for batch in batches:
            fps, sizes, least = [], [], []
            for text in batch.column(2).to_pylist():
                hashes = shingle_hashes(text, words)
                fps.append(fingerprint(hashes))
                hashes = np.unique(hashes)
                sizes.append(len(hashes))
                least.append([int((hashes * f >> np.uint64(33)).min()) for f in factors] if len(hashes) else [0] * SKETCH)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), pa.array(least, pa.list_(pa.int32()))], ["doc_id", "body", "fp", "size", "sketch"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(common.whole(docs["text"])).alias("body"), docs["text"])
    return rows.mapInArrow(run, "doc_id long, body long, fp long, size int, sketch array<int>")


def similar(shared, size, other):
    """Whether sets of so many members, shared in common, have similarity SIMILARITY; in whole numbers, for columns and arrays alike."""
    return shared * 100 >= (size + other - shared) * round(100 * SIMILARITY)


def shingle_sets(docs: DataFrame, bodies: DataFrame, words: int) -> DataFrame:
    """of, shingles: the distinct shingle hashes, sorted, of the texts that bodies (column of) lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, words)).astype(np.int64) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sets, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["of", "shingles"])

    texts = docs.select(F.xxhash64(common.whole(docs["text"])).alias("body"), docs["text"])
    texts = texts.join(bodies, F.col("body") == F.col("of"), "left_semi").groupBy("body").agg(F.first("text").alias("text"))
    return common.checkpointed(texts.mapInArrow(run, "of long, shingles array<long>"))


def fingerprint_pairs(classes: DataFrame) -> DataFrame:
    """a, b: texts (body) that SimHash and its pivot tables bring together: each with the first of its fingerprint, and the first ones of fingerprints within RADIUS bits."""
    firsts = common.checkpointed(classes.groupBy("fp").agg(F.min("body").alias("a"), F.count("*").alias("n")))
    own = classes.join(firsts.where("n > 1"), "fp").where("body <> a").select("a", F.col("body").alias("b"))
    links = hamming_links(firsts.select("fp")).select(F.col("a").alias("fp"), F.col("b").alias("fp_"))
    across = links.join(firsts.select("fp", "a"), "fp").join(firsts.select(F.col("fp").alias("fp_"), F.col("a").alias("b")), "fp_").select("a", "b")
    return own.unionByName(across)


def similar_links(docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """a, b: links between texts of docs (column body of classes, distinct) of similarity SIMILARITY; enough of them to connect what all would."""
    enough = round((SIMILARITY - MARGIN) * SKETCH)
    bands = F.array(*(F.xxhash64(F.lit(k), F.slice("sketch", BAND * k + 1, BAND)) for k in range(SKETCH // BAND)))
    members = classes.select("body", F.explode(bands).alias("band"))
    sizes = members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = common.checkpointed(members.join(sizes, "band"))
    values = classes.select(F.col("body").alias("of"), "size", "sketch")

    few = members.where(F.col("n") <= SMALL).drop("n")
    other = few.select(F.col("band").alias("band_"), F.col("body").alias("b"))
    pairs = few.join(other, (F.col("band") == F.col("band_")) & (F.col("body") < F.col("b"))).select(F.col("body").alias("a"), "b").distinct()
    pairs = pairs.join(values, F.col("a") == F.col("of")).drop("of")
    pairs = pairs.join(values.select("of", *(F.col(c).alias(f"{c}_") for c in ("size", "sketch"))), F.col("b") == F.col("of"))
    # At best the smaller set lies in the other.
    near = similar(F.least("size", "size_"), F.col("size"), F.col("size_"))
    equal = F.aggregate(F.zip_with("sketch", "sketch_", lambda x, y: (x == y).cast("int")), F.lit(0), lambda acc, x: acc + x)
    pairs = pairs.where(near).where(equal >= enough).select("a", "b").unionByName(fingerprint_pairs(classes))
    pairs = common.checkpointed(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    large = members.where(F.col("n") > SMALL).drop("n")
    named = [pairs.select(F.col("a").alias("of")), pairs.select(F.col("b").alias("of")), large.select(F.col("body").alias("of"))]
    sets = shingle_sets(docs, named[0].unionByName(named[1]).unionByName(named[2]).distinct(), words)
    checked = pairs.join(sets, F.col("a") == F.col("of")).drop("of")
    checked = checked.join(sets.select("of", F.col("shingles").alias("shingles_")), F.col("b") == F.col("of"))
    shared = F.size(F.array_intersect("shingles", "shingles_"))
    links = checked.where(similar(shared, F.size("shingles"), F.size("shingles_"))).select("a", "b")

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("body")
        bodies, size = group["body"].to_numpy(), group["size"].to_numpy().astype(np.int64)
        sketch = np.array(group["sketch"].tolist(), np.int32).reshape(-1, SKETCH)
        shingles = group["shingles"].tolist()

        def alike(v: int, others: np.ndarray) -> np.ndarray:
            found = similar(np.minimum(size[others], size[v]), size[others], size[v])
            found[found] = (sketch[others[found]] == sketch[v]).sum(axis=1) >= enough
            for at in np.flatnonzero(found):
                a, b = shingles[v], shingles[others[at]]
                found[at] = similar(np.intersect1d(a, b, assume_unique=True).size, len(a), len(b))
            return found

        found = np.array(forest(bodies, np.zeros((len(bodies), 1)), 0, alike), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": bodies[found[:, 0]], "b": bodies[found[:, 1]]})

    many = sharded(large, ["band"], sizes, "body")
    many = many.join(values.join(sets, "of"), F.col("body") == F.col("of")).drop("of")
    walked = many.groupBy("band", "low", "high").applyInPandas(walk, "a long, b long")
    return links.unionByName(walked)


def near_duplicates(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, body, root, component_id of every document; texts of similarity SIMILARITY share a component."""
    rows = common.checkpointed(sketches(docs, words))
    classes = common.checkpointed(rows.groupBy("body").agg(F.min("doc_id").alias("least_id"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("sketch").alias("sketch")))
    roots = stars(similar_links(docs, classes, words))
    return _labelled(rows.select("doc_id", "body"), classes.select("body", "least_id"), "body", roots)


def drop_near_duplicates(docs: DataFrame, words: int = 5) -> DataFrame:
    """docs with one document of each component: the smallest doc_id, of equal rows any one."""
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("kept_id"), F.col("body").alias("kept_body"))
    kept = near_duplicates(docs, words).groupBy("root").agg(F.min(first).alias("first")).select("first.kept_id", "first.kept_body")
    # The row stands aside as one struct, so that no column of it can clash.
    rows = docs.select(F.struct("*").alias("row"), docs["doc_id"].cast("long").alias("id"), F.xxhash64(common.whole(docs["text"])).alias("body"))
    joined = rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("body") == F.col("kept_body")))
    # Rows that repeat id and text: one stays.
    turn = Window.partitionBy("kept_id", "kept_body").orderBy("kept_body")
    return joined.withColumn("turn", F.row_number().over(turn)).where("turn = 1").select("row.*")
