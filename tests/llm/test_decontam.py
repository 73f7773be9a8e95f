import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from loomlake.llm import decontam

ITEM = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix purple potions"
WORDS = ITEM.split()


def tables(spark, texts, items=((1, ITEM),)):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(items), "item_id long, text string")


def test_substitutions_are_tolerated(spark):
    changed = WORDS[:4] + ["cat"] + WORDS[5:9] + ["CAT"] + WORDS[10:]
    docs, bench = tables(spark, [f"Before. {ITEM.upper()}! After", "x " + ", ".join(changed), "clean text about the quick brown fox and other things, quite long enough to have seeds", " ".join(WORDS[2:15]), " ".join(WORDS[:7]), None, ""])
    found = {r.doc_id: r.agreeing for r in decontam.overlaps(docs, bench).collect()}
    assert found == {0: 13, 1: 11, 3: 13}
    assert {r.doc_id for r in decontam.decontaminate(docs, bench).collect()} == {2, 4, 5, 6}


def test_masks_cover_every_substitution():
    """For every length of an item and every allowed way to substitute words in a window, some mask fits untouched."""
    for n in range(1, 16):
        win = min(n, decontam.WINDOW)
        allowed = win - decontam.needed(win)
        for k in range(allowed + 1):
            for changed in combinations(range(win), k):
                assert any(not {s + p for p in m} & set(changed) for m in decontam.masks_of(n) for s in range(win - m[-1])), (n, changed)


def brute(text, item):
    """Whether any alignment without seeds agrees enough."""
    t, w = text.split(), item.split()
    n = min(13, len(w))
    best = 0
    for shift in range(-len(w), len(t)):
        same = [0 <= i + shift < len(t) and t[i + shift] == x for i, x in enumerate(w)]
        best = max(best, *(sum(same[k : k + n]) for k in range(len(w) - n + 1)))
    return bool(w) and best >= -(-n * 8 // 10)


@pytest.mark.parametrize("broadcast", [decontam.MAX_BROADCAST, 0])
def test_brute_force(spark, monkeypatch, broadcast):
    """Random texts, items of every length from one word on, substitutions, and passages cut off at either end of a text."""
    monkeypatch.setattr(decontam, "MAX_BROADCAST", broadcast)
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rng.choices(vocab, k=k % 40 + 1))) for k in range(1, 60)]
    texts = []
    for k in range(200):
        words = rng.choices(vocab, k=rng.randrange(0, 60))
        if k % 3:
            part = rng.choice(items)[1].split()
            part = [w if rng.random() > 0.1 else "other" for w in part][rng.randrange(3) :]
            at = rng.choice([0, len(words) // 2, len(words)])
            words[at:at] = part[: len(part) - rng.randrange(3)] if rng.random() < 0.5 else part
        texts.append(" ".join(words))
    docs, bench = tables(spark, texts, items)
    found = {(r.doc_id, r.item_id) for r in decontam.overlaps(docs, bench).collect()}
    assert found == {(d, i) for d, text in enumerate(texts) for i, item in items if brute(text, item)}


def test_every_two_substitutions_and_short_items_are_found(spark):
    item = WORDS[:13]
    texts = [" ".join("zzz" if i in pair else w for i, w in enumerate(item)) for pair in combinations(range(13), 2)]
    docs, bench = tables(spark, texts, [(1, " ".join(item))])
    assert decontam.overlaps(docs, bench).count() == 78
    docs, bench = tables(spark, ["so it is that " + " ".join(WORDS[:n]) + " as it were" for n in range(1, 13)], [(n, " ".join(WORDS[:n])) for n in range(1, 13)])
    assert {(r.doc_id + 1, r.item_id) for r in decontam.overlaps(docs, bench).collect()} >= {(n, n) for n in range(1, 13)}


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, ITEM, "a"), (2, "clean", "b")], "doc_id long, text string, leak_id string").withColumns({c: F.lit(c) for c in ("leak_body", "leak_doc_id", "id", "body", "row", "h", "at", "seed", "item_key")})
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [2]


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, ITEM), (None, ITEM), (2, None), (3, "short")], "item_id long, text string")
    assert decontam.decontaminate(odd, bench).columns == odd.columns
    assert decontam.decontaminate(odd, bench).count() == odd.count()
    assert decontam.decontaminate(none, bench).count() == 0
    assert decontam.decontaminate(odd, bench.limit(0)).count() == odd.count()
    dirty = spark.createDataFrame([(None, ITEM), (5, ITEM), (5, ITEM)], "doc_id long, text string")
    assert decontam.decontaminate(dirty, bench).count() == 0
    assert decontam.overlaps(dirty, bench).count() == 4  # two texts, two items of equal wording
