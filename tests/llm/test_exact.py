import hashlib
import random

import pytest

from loomlake.llm import exact


def brute(rows, keep="largest"):
    """Per row: id, id that stays, size of the group, digest; and the rows that stay, by id and text."""
    by = {}
    for d, t in rows:
        by.setdefault(t or "", []).append(d)
    pick = max if keep == "largest" else min
    stays = {t: pick([d for d in ids if d is not None], default=None) for t, ids in by.items()}
    return sorted(((d, stays[t or ""], len(by[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows), key=str), stays


@pytest.mark.parametrize("bits,parts", [(1, 13), (4, 40), (2, 1)])
def test_runs_merge_to_what_brute_force_gives(spark, monkeypatch, bits, parts):
    monkeypatch.setattr(exact, "FAN_BITS", bits)
    rng = random.Random(bits)
    rows = [(k, rng.choice(["hot"] * 20 + ["Hot", "hot ", "", None, "é", "é"] + [str(x) for x in range(60)])) for k in range(400)]
    rows += [rows[7], rows[7], (None, "hot"), (None, "only null"), (None, "only null"), (-5, "x" * 300_000), (9, "x" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    for keep in ("largest", "smallest"):
        expected, stays = brute(rows, keep)
        got = exact.copy_report(docs, keep).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == expected
        kept = [(r.keep_id, r.text_sha256) for r in got if r.kept]
        assert sorted(kept, key=str) == sorted(((d, hashlib.sha256(t.encode()).hexdigest()) for t, d in stays.items()), key=str)
        assert all(r.doc_id == r.keep_id for r in got if r.kept)
        left = [(r.doc_id, r.text or "") for r in exact.drop_copies(docs, keep).collect()]
        assert sorted(left, key=str) == sorted(((d, t) for t, d in stays.items()), key=str)


def test_rounds_follow_the_number_of_runs(spark, monkeypatch):
    """Sixteen runs meet in a round: as many rounds as it takes until one is left, and one where there is but one."""
    rounds = []
    kept = exact.merged_runs
    monkeypatch.setattr(exact, "merged_runs", lambda runs: rounds.append(1) or kept(runs))
    runs = spark.createDataFrame([(0, 1, bytearray(32), 4, (5, 0), 1)], "run long, digest long, sha binary, size int, best struct<ident:long,row:long>, n long")
    for count, want in ((1, 1), (16, 1), (17, 2), (256, 2), (257, 3), (800_000, 5)):
        rounds.clear()
        exact.tree_merge(runs, count)
        assert len(rounds) == want


def test_odd_rows(spark, odd, none):
    got = exact.copy_report(odd)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    rows = got.collect()
    empty = [r for r in rows if r.text_sha256 == hashlib.sha256(b"").hexdigest()]
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in empty} == {(1, 2, 3, False), (2, 2, 3, True), (None, 2, 3, False)}
    same = [r for r in rows if r.doc_id in (5, 6)]
    assert [(r.keep_id, r.group_size) for r in same] == [(6, 3)] * 3 and [r.doc_id for r in same if r.kept] == [6]
    left = exact.drop_copies(odd)
    assert left.columns == odd.columns and left.count() == len({r.text_sha256 for r in rows})
    assert exact.copy_report(none).count() == exact.drop_copies(none).count() == 0


def test_equal_digests_are_verified(spark, monkeypatch):
    """Where all 64-bit digests are equal, the SHA-256 still tells texts apart."""
    monkeypatch.setattr(exact.F, "xxhash64", lambda *_: exact.F.lit(7).cast("long"))
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id) for r in exact.copy_report(docs).collect()) == [(1, 3), (2, 2), (3, 3)]
