import random

from loomlake.llm import mixing


def plan(spark, rows):
    return mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return capped | share
        capped |= {s: 3 * sizes[s] for s in over}


def test_targets_and_mix(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice(["b", "a", "c", "tiny", None, "é", "empty"]), " ".join(["w"] * rng.randrange(0, 60))) for k in range(800)]
    rows = [(d, s, t if s != "empty" else "") for d, s, t in rows if s != "tiny" or d % 20 == 0]
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    targets, source = brute_targets(sizes), {d: s for d, s, _ in rows}
    taken = {}
    for r in plan(spark, rows):
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - targets[s]) < 1e-6 * max(1, targets[s])
        assert r.copies <= 3
        taken[s] = taken.get(s, 0) + r.size * r.copies
    for s, t in targets.items():
        assert abs(taken[s] - t) <= max(0.1 * t, 120), s


def test_runs_agree_and_mix_repeats_rows(spark):
    rows = [(k, "ab"[k % 2], "x " * (k % 7)) for k in range(200)]
    first = sorted((r.doc_id, r.copies) for r in plan(spark, rows))
    assert first == sorted((r.doc_id, r.copies) for r in plan(spark, rows[::-1]))
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    assert mixed.columns == ["doc_id", "source", "text", "mix_copy"]
    got = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {d: n for d, n in first if n}


def test_odd_rows(spark, odd, none):
    assert mixing.mix_plan(odd).count() == odd.count() and mixing.mix_plan(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert mixing.mix(odd).columns == [*odd.columns, "mix_copy"]


def test_clashing_names_and_a_mixture_mixed_again(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(k, "ab"[k % 2], "x y z") for k in range(20)], "doc_id long, source string, text string").withColumns({c: F.lit(c) for c in ("mix_source", "of", "own", "row", "id", "whole", "fraction", "draw", "copies", "size", "u")})
    once = mixing.mix(docs)
    assert once.columns == [*docs.columns, "mix_copy"]
    again = mixing.mix(once)
    assert again.columns == once.columns and again.count() > 0
