import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomlake.llm import simhash


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_fingerprint(text, k=3):
    w = words(text)
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, ids, radius=3):
    label = list(range(len(fps)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius and root(i) != root(j):
                label[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for k, d in enumerate(ids):
        if d is not None:
            least[root(k)] = min(least.get(root(k), d), d)
    return [least.get(root(k)) for k in range(len(fps))]


def test_fingerprints_and_components(spark):
    rng = random.Random(2)
    vocab = ["Alpha", "BETA", "é", "Éa", "gamma", "delta", "x"]
    texts = [" ".join(rng.choices(vocab, k=rng.randrange(0, 9))) for _ in range(120)] + ["", None, " \t\n\x0b\x0c\r", "a\x0bB\x1fc", "one", "two words"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in simhash.simhash_report(docs).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [got[k].fingerprint for k in range(len(texts))] == [format(f, "016x") for f in fps]
    assert [got[k].component_id for k in range(len(texts))] == brute_components(fps, list(range(len(texts))))


@pytest.mark.parametrize("small,shard,cut", [(32, 1024, 5), (2, 4, 5), (32, 1024, 7)])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, small, shard, cut):
    """Random fingerprints with chains and dense balls, with buckets small and sharded."""
    monkeypatch.setattr(simhash, "stretches", lambda n: cut)
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "SHARD", shard)
    rng = random.Random(5)
    fps = []
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(25):
            fps.append(at)
            for _ in range(rng.randrange(1, 5)):
                at ^= 1 << rng.randrange(64)
    center = rng.getrandbits(64)
    fps += [center ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(120)]
    fps = sorted(set(fps))
    classes = spark.createDataFrame([(simhash.signed(f), k) for k, f in enumerate(fps)], "fp long, least_id long")
    roots = {r.node: r.root for r in simhash.stars(simhash.hamming_links(classes)).collect()}
    ours = [roots.get(simhash.signed(f), simhash.signed(f)) for f in fps]
    theirs = brute_components(fps, list(range(len(fps))))
    assert len(set(zip(ours, theirs, strict=True))) == len(set(ours)) == len(set(theirs))


def test_pivot_tables_never_discard_a_link_and_discard_nearly_all_else(spark):
    rng = random.Random(7)
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for _ in range(3):
            b ^= 1 << rng.randrange(64)
        t = simhash._tables(np.array([a, b], np.uint64))
        assert np.abs(t[0] - t[1]).max() <= 3
    row = spark.createDataFrame([(simhash.signed(a),)], "fp long").select(simhash.pivot_table(F.col("fp"))).first()[0]
    assert [(row[k // 8] >> 8 * (k % 8)) & 255 for k in range(len(simhash.PIVOTS))] == t[0].tolist()
    # Pairs that share the bits of a key, as all that meet do.
    draw = np.random.default_rng(1).integers(0, 1 << 64, (2, 100_000), np.uint64)
    mask = np.uint64(simhash.key_masks(5)[0] % 2**64)
    x, y = draw[0], draw[1] & ~mask | draw[0] & mask
    kept = np.abs(simhash._tables(x) - simhash._tables(y)).max(axis=1) <= simhash.RADIUS
    assert kept.mean() < 0.002


def test_keys_lose_no_pair():
    """Whatever three bits differ, two fingerprints agree under some key, at every number of stretches."""
    rng = random.Random(9)
    assert [simhash.stretches(n) for n in (1, 10**6, 10**8, 10**9, 10**12)] == [5, 5, 6, 6, 7]
    for n in (5, 6, 7):
        masks = [m % 2**64 for m in simhash.key_masks(n)]
        for _ in range(3000):
            flips = sum(1 << b for b in rng.sample(range(64), 3))
            assert any(flips & m == 0 for m in masks)


def test_stars(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(80)]
    got = {r.node: r.root for r in simhash.stars(spark.createDataFrame(links, "a long, b long")).collect()}
    import itertools

    group = {n: n for n in itertools.chain(*links)}
    for _ in range(200):
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    assert got == {n: g for n, g in group.items() if any(n in p and p[0] != p[1] for p in links)}


def near(words, rng, changes):
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("small", [32, 3])
def test_near_duplicates(spark, monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = random.Random(11)
    base = [[f"v{rng.randrange(2000)}" for _ in range(400)] for _ in range(12)]
    texts = [near(b, rng, c) for b in base for c in (0, 0, 1, 3, 5)] + [" ".join(f"v{rng.randrange(2000)}" for _ in range(300)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert all(got[k] == k // 5 * 5 for k in range(60)) and all(got[k] == k for k in range(60, 90))
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect()) == [*range(0, 60, 5), *range(60, 90)]


@pytest.mark.parametrize("small", [32, 1])
def test_near_duplicates_are_exact(spark, monkeypatch, small):
    """Pairs at exactly 0.8 (80 of 100 shingles) share a component, pairs just below (79 of 101) do not."""
    monkeypatch.setattr(simhash, "SMALL", small)
    texts = []
    for k in range(120):
        same = 84 if k < 60 else 83
        head = [f"h{k}.{j}" for j in range(same)]
        texts += [" ".join(head + [f"{side}{k}.{j}" for j in range(94 - same)]) for side in "ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert [k for k in range(60) if got[2 * k + 1] != 2 * k] == []
    assert [k for k in range(60, 120) if got[2 * k + 1] != 2 * k + 1] == []


@pytest.mark.parametrize("small", [32, 1])
def test_near_duplicates_ignore_repeats(spark, monkeypatch, small):
    """Equal shingle sets but for a few, one side repeating a passage many times: far apart in fingerprints, linked all the same."""
    monkeypatch.setattr(simhash, "SMALL", small)
    texts = []
    for k in range(30):
        head = [f"h{k}.{j}" for j in range(100)]
        texts += [" ".join(head), " ".join(head + [f"h{k}.{j}" for j in range(10)] * 60)]
    apart = [int(np.bitwise_count(np.uint64(a % 2**64 ^ b % 2**64))) for a, b in (([simhash.fingerprint(simhash.shingle_hashes(t, 5)) for t in texts[2 * k : 2 * k + 2]]) for k in range(30))]
    assert max(apart) > 22
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert [k for k in range(30) if got[2 * k + 1] != 2 * k] == []


def test_near_duplicates_by_fingerprints(spark, monkeypatch):
    """SimHash and its pivot tables propose pairs by themselves: with a sketch that is one single band, similar texts within RADIUS bits are still linked; near fingerprints of unlike sets are not."""
    monkeypatch.setattr(simhash, "BAND", simhash.SKETCH)
    rng = random.Random(5)
    texts = []
    for k in range(20):
        base = [f"w{k}.{j}" for j in range(1500)]
        texts += [" ".join(base), near(base, rng, 1)]
    for k in range(5):
        passage = [f"p{k}.{j}" for j in range(100)] * 80
        texts += [" ".join(passage + [f"{side}{k}.{j}" for j in range(90)]) for side in "ab"]
    fps = [np.uint64(simhash.fingerprint(simhash.shingle_hashes(t, 5)) % 2**64) for t in texts]
    close = [k for k in range(25) if np.bitwise_count(fps[2 * k] ^ fps[2 * k + 1]) <= simhash.RADIUS]
    alike = [k for k in close if k < 20]
    assert len(alike) >= 10 and len(close) > len(alike)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    used = []
    within = simhash.within
    monkeypatch.setattr(simhash, "within", lambda *a: used.append(a) or within(*a))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert used
    assert [k for k in alike if got[2 * k + 1] != 2 * k] == []
    assert [k for k in range(20, 25) if got[2 * k + 1] != 2 * k + 1] == []


def test_odd_rows(spark, odd, none):
    report = simhash.simhash_report(odd)
    assert report.count() == odd.count()
    assert {r.component_id for r in report.where("doc_id IN (5, 6)").collect()} == {5}
    assert simhash.simhash_report(none).count() == 0
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert ids == [(False, 1), (False, 4), (False, 5), (False, 7), (False, 8), (True, 0)]
    assert simhash.drop_near_duplicates(none).count() == 0


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "another text of its own")], "doc_id long, text string").withColumns({c: F.lit(c) for c in ("dup_doc_id", "kept_id", "kept_body", "body", "id", "row", "turn", "root", "node", "of", "fp", "sketch")})
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert simhash.simhash_report(docs).count() == 3
