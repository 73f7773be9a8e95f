"""Windows over recordings: nothing twice, nothing lost, and a run that goes on where another was cut off."""

import random

import pytest

from loomlake.operators import speech

SCHEMA = "item long, length_ms long, recording array<struct<start_ms:long,end_ms:long,text:string>>"


def recording(seed, n=40, longest=200):
    rng, at, out = random.Random(seed), 0, []
    for k in range(n):
        text = chr(97 + k % 26) * rng.randrange(1, longest)
        at += rng.choice([0, 200, 900])
        out.append({"start_ms": at, "end_ms": at + len(text) * speech.CHAR_MS, "text": text})
        at = out[-1]["end_ms"]
    return out


def heard(spark, items, transcriber=speech.dry_run, progress=None, window=speech.WINDOW_MS):
    df = spark.createDataFrame([(k, r[-1]["end_ms"] if r else 0, r) for k, r in items.items()], SCHEMA)
    out = {}
    for r in sorted(speech.transcribed(df, transcriber, progress, window).collect(), key=lambda r: (r.item, r.segment_index)):
        out.setdefault(r.item, []).append(r)
    return out


def test_short_utterances_come_back_once(spark):
    """However windows fall, utterances shorter than a window are heard whole, once, in order."""
    items = {k: recording(k) for k in range(5)} | {9: []}
    got = heard(spark, items)
    assert set(got) == set(range(5))
    for k, rows in got.items():
        assert [(r.start_ms, r.end_ms, r.text) for r in rows] == [(u["start_ms"], u["end_ms"], u["text"]) for u in items[k]]
        assert [r.segment_index for r in rows] == list(range(len(rows)))
        assert [r.starts_turn for r in rows] == [i == 0 or u["start_ms"] - items[k][i - 1]["end_ms"] >= 700 for i, u in enumerate(items[k])]
        assert len({r.batch_index for r in rows}) > 3


def test_long_utterances_are_cut_and_not_repeated(spark):
    items = {1: recording(3, 12, 2000)}
    rows = heard(spark, items)[1]
    assert all(a.end_ms <= b.start_ms for a, b in zip(rows, rows[1:], strict=False))
    assert len(rows) > 12


@pytest.mark.parametrize("stored", [1, 7, 40])
def test_a_cut_off_run_goes_on(spark, stored):
    items = {1: recording(5), 2: recording(6)}
    whole = heard(spark, items)
    progress = spark.createDataFrame([(1, r.segment_index, r.end_ms) for r in whole[1][:stored]], "item long, segment_index long, end_ms long")
    rest = heard(spark, items, progress=progress)
    key = lambda r: (r.segment_index, r.start_ms, r.end_ms, r.text)
    assert list(map(key, rest.get(1, []))) == list(map(key, whole[1][stored:]))
    assert list(map(key, rest[2])) == list(map(key, whole[2]))


def test_the_guard_and_other_transcribers(spark):
    """One that hears half a window twice, and one that never goes on."""

    def twice(utterances, a, b):
        return [(t, t + 1000, str(t)) for t in range(a // 1000 * 1000, b, 1000)], max(1000, (b - a) // 2)

    rows = heard(spark, {1: [{"start_ms": 0, "end_ms": 20_000, "text": "x"}]}, twice, window=8000)[1]
    assert [r.text for r in rows] == [str(t) for t in range(0, 20_000, 1000)]
    with pytest.raises(Exception, match="NoProgress"):
        heard(spark, {1: recording(1)}, lambda *_: ([], 0))
