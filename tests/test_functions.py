"""Scalar functions, cron, captions, word pieces, streams and file sources on small fixtures."""

from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from loomlake.functions import scalars, wordpiece
from loomlake.operators import queue, text
from loomlake.sources import files
from loomlake.streaming import stream


def ms(*a, tz="UTC"):
    return int(datetime(*a, tzinfo=ZoneInfo(tz)).timestamp() * 1000)


def local(fired, tz):
    return [datetime.fromtimestamp(x / 1000, ZoneInfo(tz)).strftime("%m-%d %H:%M") for x in fired]


def test_cron_over_clock_changes():
    after = ms(2024, 3, 30, 12, tz="Europe/Berlin")
    assert local(queue.firings("30 2 * * *", "Europe/Berlin", after, 2), "Europe/Berlin") == ["03-31 03:30", "04-01 02:30"]
    after = ms(2024, 10, 26, 12, tz="Europe/Berlin")
    fired = list(queue.firings("30 2 * * *", "Europe/Berlin", after, 2))
    assert local(fired, "Europe/Berlin") == ["10-27 02:30", "10-28 02:30"]
    assert datetime.fromtimestamp(fired[0] / 1000, timezone.utc).hour == 0


def test_cron_searches_each_firing_anew():
    leap = [datetime.fromtimestamp(x / 1000, timezone.utc).year for x in queue.firings("0 12 29 2 *", "UTC", ms(2024, 6, 1), 8)]
    assert leap == list(range(2028, 2060, 4))
    assert [datetime.fromtimestamp(x / 1000, timezone.utc).year for x in queue.firings("0 12 29 2 *", "UTC", ms(2094, 6, 1), 2)] == [2096, 2104]
    assert list(queue.firings("0 0 30 2 *", "UTC", ms(2024, 1, 1), 8)) == []
    # Skipped minutes shift by the gap and meet others; none fires twice, and repeated minutes fire once.
    assert local(queue.firings("*/30 2-3 * * *", "Europe/Berlin", ms(2024, 3, 31, 1, tz="Europe/Berlin"), 4), "Europe/Berlin") == ["03-31 03:00", "03-31 03:30", "04-01 02:00", "04-01 02:30"]
    assert local(queue.firings("*/30 2 * * *", "Europe/Berlin", ms(2024, 10, 27, 0, tz="UTC"), 3), "Europe/Berlin") == ["10-27 02:30", "10-28 02:00", "10-28 02:30"]
    assert local(queue.firings("10 2 * * *", "Australia/Lord_Howe", ms(2024, 10, 5, 5, tz="Australia/Lord_Howe"), 2), "Australia/Lord_Howe") == ["10-06 02:40", "10-07 02:10"]


def test_cron_fields():
    assert queue.parse_cron("*/20 9-17/4 1,15 * 7")[:3] == (frozenset({0, 20, 40}), frozenset({9, 13, 17}), frozenset({1, 15}))
    assert queue.parse_cron("0 0 * * 7")[4] == frozenset({0})
    assert local(queue.firings("0 12 1 * 1", "UTC", ms(2024, 6, 28), 3), "UTC") == ["07-01 12:00", "07-08 12:00", "07-15 12:00"]
    for bad in ("* * *", "60 * * * *", "5-1 * * * *"):
        with pytest.raises(ValueError):
            queue.parse_cron(bad)


def test_wordpiece():
    vocab = wordpiece.vocabulary(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "cafe", "##s", "un", "##do", ".", "cafe"])
    assert wordpiece.encode("Cafés. undo xyz", vocab) == [2, 4, 5, 8, 6, 7, 1, 3]
    assert wordpiece.encode(None, vocab) == [2, 3]
    with pytest.raises(ValueError):
        wordpiece.vocabulary(["a"])


def test_scalars(spark):
    one = lambda c, **v: spark.range(1).select(*(F.lit(x).alias(k) for k, x in v.items())).select(c).first()[0]
    assert one(scalars.caption_ms(F.col("t")), t="01:02:03.5") == 3723500
    assert one(scalars.caption_ms(F.col("t")), t="02:03,1234") == 123123
    assert one(scalars.caption_ms(F.col("t")), t="nothing") is None
    assert one(scalars.heading_depth(F.col("t")), t="  ## x") == 2
    assert one(scalars.heading_depth(F.col("t")), t="####### x") == 0
    assert one(scalars.content(F.col("t")), t=" a\t\n b\x0bc ") == "a b\x0bc"
    assert one(scalars.bytes_range(F.col("t"), F.lit(1), F.lit(3)), t="abcd") == "bc"


def test_turns_and_backoff(spark):
    segs = spark.createDataFrame([(1, 0, 0, 100), (1, 1, 799, 900), (1, 2, 1600, 1700), (1, 3, 1650, 1800)], "k long, i long, a long, b long")
    marks = [r.starts_turn for r in text.turn_marks(segs, "k", "i", "a", "b").orderBy("i").collect()]
    assert marks == [True, False, True, False]
    waits = spark.range(1, 13).select(queue.backoff_window(F.col("id")).alias("w")).collect()
    assert [r.w for r in waits][:3] == [2000, 4000, 8000] and waits[-1].w == 900000


def test_files(spark, tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/a.md").write_text("# Title\n\ntext")
    (tmp_path / "in/.hidden").write_text("x")
    (tmp_path / "in/deep/b.vtt").write_text("WEBVTT\n")
    planned = {r.path.rsplit("/", 1)[1]: r.skipped for r in files.plan_intake(spark, str(tmp_path / "in")).collect()}
    assert planned["a.md"] is False and planned["b.vtt"] is False and planned.get(".hidden", True)
    media = {r.title: r.media for r in files.opened(spark, str(tmp_path / "in")).collect()}
    assert media["a"] == "markdown" and media["b"] == "captions"
    (tmp_path / "p").mkdir()
    (tmp_path / "p/greet@2.md").write_text("---\nmodel: m\n---\nhello\n")
    row = files.prompts(spark, str(tmp_path / "p")).first()
    assert (row.name, row.version, row.front, row.body) == ("greet", 2, "model: m", "hello\n")
    (tmp_path / "m.json").write_text('{"models": [{"name": "a", "size": 1},\n {"name": "b", "size": 2}]}')
    assert files.manifest(spark, str(tmp_path / "m.json"), "models array<struct<name:string,size:long>>", "models").count() == 2
    (tmp_path / "c.jsonl").write_text('{"id": 1}\n{"id": 2}\n')
    assert files.json_lines(spark, str(tmp_path / "c.jsonl"), "id long").count() == 2


def test_short_records_fail(spark):
    bad = spark.createDataFrame([(1, "00" * 9)], "k long, records string")
    with pytest.raises(Exception, match="short record"):
        files.decoded_segments(bad, "k", ("a",)).collect()


def test_resume_status(spark):
    frames = spark.createDataFrame([(1, k) for k in range(1, 301)], "s long, seq long")
    cursors = spark.createDataFrame([(1, 300), (1, 44), (1, 43), (1, 301)], "s long, cursor long")
    got = {r.cursor: (r.status, r.behind) for r in stream.resume_status(stream.resume_window(frames, "s", "seq"), "s", "seq", cursors).collect()}
    assert got == {300: ("resumed", 0), 44: ("resumed", 256), 43: ("resume_window_exceeded", None), 301: ("invalid_input", None)}


def test_named_queries(spark, data):
    from loomlake import registry, surface

    assert all(q in registry.QUERIES for q in surface.NAMED.values()) and len(surface.NAMED) == 11
    assert surface.ask(spark, data, "cost.rollup").count() > 0
    with pytest.raises(surface.UnknownQuery):
        surface.ask(spark, data, "nothing")


def test_locators_and_shapes(spark):
    """Each medium is cut by its shape, and every chunk says where it comes from."""
    from loomlake.plans import stages

    texts = {
        1: "first line\nsecond\n\n\n\nthird block\n\n  \n\nlast",
        2: '{"a": 1}\n\n{"b": 2}\n\n{"c": 3}',
        3: "# One\n\ntext a\n\n## Two\n\ntext b\n\ntext c",
    }
    items = spark.createDataFrame(list(texts.items()), "item long, text string")
    rows = stages.DEFAULT.run(items, ["normalize", "chunk"]).orderBy("item", "ordinal").collect()
    got = [(r.item, r.ordinal, r.locator_kind, r.locator_first, r.locator_last) for r in rows]
    assert got == [(1, 0, "line", 0, 9), (2, 0, "message", 0, 0), (2, 1, "message", 1, 1), (2, 2, "message", 2, 2), (3, 0, "line", 0, 2), (3, 1, "line", 4, 8)]
    assert bytes.fromhex(rows[4].content).decode() == "# One\n\ntext a"


def plain_windows(segs, target, most):
    """Greedy windows over (start, end, depth), one after another."""
    out, opened = [], None
    for k, (a, b) in enumerate(segs):
        if opened and opened[1] - opened[0] >= target:
            out.append(opened)
            opened = None
        opened = (opened[0] if opened else a, b, opened[2] if opened else k, k)
        if opened[1] - opened[0] >= most:
            out.append(opened)
            opened = None
    return out + ([opened] if opened else [])


def plain_batches(sizes, padded, count):
    out, n, m = [], 0, 0
    for x in sizes:
        if n and ((n + 1) * max(m, x) > padded or n >= count):
            out.append((n, n * m))
            n, m = 0, 0
        n, m = n + 1, max(m, x)
    return out + ([(n, n * m)] if n else [])


def test_windows_and_batches_at_the_edges_of_blocks(spark):
    import random

    rng = random.Random(6)
    lengths = [0, 1, 2, 127, 128, 129, 255, 256, 257, 1000]
    items = {n: ["x" * rng.randrange(1, 60) for _ in range(n)] for n in lengths}
    df = spark.createDataFrame([(n, "\n".join(t) if t else None, [len(x) for x in t]) for n, t in items.items()] + [(-1, None, None)], "k long, t string, sizes array<long>")
    windows, batches = {n: [] for n in items}, {n: [] for n in items}
    for r in text.chunk_windows(text.segment_arrays(df, "k", F.col("t"), "\\n"), "k", "any", 70, 100).orderBy("k", "ordinal").collect():
        windows[r.k].append((r.byte_start, r.byte_end, r.first_idx, r.last_idx))
    for r in text.batch_plan(df, "k", F.col("sizes"), 120, 5).orderBy("k", "batch").collect():
        batches[r.k].append((r["items"], r.padded))
    for n, parts in items.items():
        segs, at = [], 0
        for x in parts:
            segs.append((at, at + len(x)))
            at += len(x) + 1
        cut = [(c, min(c + 100, b), i, j) for a, b, i, j in plain_windows(segs, 70, 100) for c in range(a, b, 100)]
        assert windows[n] == cut, n
        assert batches[n] == plain_batches(map(len, parts), 120, 5), n


def test_windows_of_an_item_of_a_hundred_thousand_lines(spark):
    """In proportion to the lines; folds that carried their output took half a minute for 40,000 already."""
    import time

    df = spark.createDataFrame([(1, "\n".join(f"segment number {k} of it" for k in range(100_000)))], "k long, t string")
    began = time.monotonic()
    got = text.chunk_windows(text.segment_arrays(df, "k", F.col("t"), "\\n"), "k", "any", 20, 30).agg(F.count("*").alias("n"), F.max("last_idx").alias("last")).first()
    assert (got.n, got["last"]) == (100_000, 99_999) and time.monotonic() - began < 60
