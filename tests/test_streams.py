"""Streams: folds of events that come out of order and twice, batches cut off and run again, followed streams."""

import pytest
from pyspark.sql import functions as F
from test_folds import LIVES, SCHEMA, T, lives, replay, replay_lives, rows

from loomlake.streaming import stream

COLUMNS = ("entity", "last", "first", "total", "spent")


def written(spark, path, events, files):
    """A folder of so many files, in order of a hash; some events in two files."""
    df = spark.createDataFrame(events, SCHEMA)
    df = df.unionByName(df.where("seq % 9 = 0"))
    df.withColumn("h", F.xxhash64("seq", F.rand(3))).repartition(files, "h").drop("h").write.parquet(path)
    return df.schema


def read(df):
    return {tuple(r) for r in df.select(*COLUMNS).collect()}


@pytest.mark.parametrize("seed,files", [(1, 9), (2, 5)])
def test_lives_in_any_order(spark, tmp_path, seed, files):
    events, path = lives(seed, 120), str(tmp_path / "log")
    schema = written(spark, path, events, files)
    got = stream.folded_stream(spark, path, schema, lambda b: b, LIVES, str(tmp_path / "out"), files_per_trigger=2, buckets=5)
    assert read(got) == replay_lives(events)
    # More files later, from where it stood.
    more = [(121 + k, kind, entity, amount) for k, (_, kind, entity, amount) in enumerate(lives(seed + 50, 60))]
    spark.createDataFrame(more, SCHEMA).repartition(3, F.xxhash64("seq")).write.mode("append").parquet(path)
    got = stream.folded_stream(spark, path, schema, lambda b: b, LIVES, str(tmp_path / "out"), files_per_trigger=2, buckets=5)
    assert read(got) == replay_lives(events + more)


@pytest.mark.parametrize("at", ["before the mark", "before the state"])
def test_a_batch_that_is_cut_off_is_run_again(spark, tmp_path, monkeypatch, at):
    events, path = lives(7, 100), str(tmp_path / "log")
    schema = written(spark, path, events, 6)
    run = lambda: stream.folded_stream(spark, path, schema, lambda b: b, LIVES, str(tmp_path / "out"), files_per_trigger=2, buckets=3)
    calls, fold_absorb, contiguous = [], stream.fold.absorb, stream.contiguous_to

    def cut(*args):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("the machine is gone")
        return fold_absorb(*args) if at == "before the state" else contiguous(*args)

    with monkeypatch.context() as m:
        if at == "before the state":
            m.setattr(stream.fold, "absorb", cut)
        else:
            kept = spark.createDataFrame

            def late(rows, schema=None, **more):
                if schema == stream.MARK:
                    calls.append(1)
                    if len(calls) == 2:
                        raise RuntimeError("the machine is gone")
                return kept(rows, schema, **more)

            m.setattr(spark, "createDataFrame", late)
        with pytest.raises(Exception, match="the machine is gone"):
            run()
    assert read(run()) == replay_lives(events)


def test_a_log_with_gaps(spark, tmp_path):
    """What comes after a gap waits beside the state and counts in its order when the table is read."""
    events, path = [e for e in lives(3, 80) if e[0] not in (1, 40, 41)], str(tmp_path / "log")
    schema = written(spark, path, events, 4)
    got = stream.folded_stream(spark, path, schema, lambda b: b, LIVES, str(tmp_path / "out"), files_per_trigger=1, buckets=3)
    assert read(got) == replay_lives(events)
    assert stream._mark(spark, str(tmp_path / "out"))[1] == 0


def test_contiguous_to(spark):
    df = lambda *s: spark.createDataFrame([(x,) for x in s], "seq long")
    assert [stream.contiguous_to(df(*s), low) for s, low in (((1, 2, 3, 5), 0), ((2, 3), 0), ((), 4), ((5, 6, 6, 9), 4), ((1, 2), 2), ((3,), 2))] == [3, 0, 4, 6, 2, 3]


def test_order_free_tables_and_no_files(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.createDataFrame(rows(5), SCHEMA).repartition(4, F.xxhash64("seq")).write.parquet(path)
    got = stream.folded_stream(spark, path, SCHEMA, lambda b: b, T, files_per_trigger=1, buckets=3)
    assert {tuple(r) for r in got.select("entity", "last", "first", "total").collect()} == replay(rows(5))
    (tmp_path / "none").mkdir()
    assert stream.folded_stream(spark, str(tmp_path / "none"), SCHEMA, lambda b: b, LIVES).count() == 0


def test_a_stream_that_never_ends_raises(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.createDataFrame(rows(5, 20), SCHEMA).write.parquet(path)
    with pytest.raises(stream.NeverEnded, match="seq = 99"):
        stream.follow(spark, path, SCHEMA, lambda b: b, "seq = 99", patience_s=3)
    assert stream.follow(spark, path, SCHEMA, lambda b: b, "seq = 12").count() == 12


def test_events_of_any_length(spark):
    """A line of two million characters is decoded whole."""
    data = "x" * 2_000_000
    text = spark.createDataFrame([(f"id: 1\nevent: big\ndata: {data}\n\n",)], "text string")
    row = stream.sse_events(text, "text").first()
    assert (row.id, row.event, len(row.data)) == ("1", "big", len(data))
