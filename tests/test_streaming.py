import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeloom.operators import aggregates, windows
from lakeloom.streaming import averages, rates, replay, votes


def stream(spark, tmp_path, batches, schema):
    """A stream of one file for each batch."""
    source = tmp_path / "in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        for f in source.glob("part-*.parquet"):
            if not f.name.startswith("part-b"):
                f.rename(source / f"part-b{k:03d}.parquet")
    import os
    import time

    for k in range(len(batches)):
        os.utime(source / f"part-b{k:03d}.parquet", (time.time() - 1000 + k, time.time() - 1000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))


def drain(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def test_windowed_rates_equal_the_batch_form(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"2024-01-01 00:00:{s:02d}.{rng.randrange(1000):03d}", rng.randrange(2)) for s in range(0, 40) for _ in range(3)]
    cast = lambda df: df.withColumn("ts", F.to_timestamp("ts"))
    batches = [rows[:60], rows[60:], [("2024-01-01 01:00:00", 0)]]
    got = drain(rates.windowed_rates(cast(stream(spark, tmp_path, batches, "ts string, node int")), "ts", 2, ["node"]), "tps", "append", tmp_path)
    want = aggregates.rate_by_window(cast(spark.createDataFrame(rows, "ts string, node int")), "ts", 2, ["node"]).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    inside, late = rates.split_by_deadline(cast(spark.createDataFrame(rows, "ts string, node int")), "ts", "2024-01-01 00:00:20")
    assert (inside.count(), late.count()) == (60, 60)
    spread = aggregates.with_idle_windows(aggregates.rate_by_window(cast(spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-01 00:00:09",)], "ts string")), "ts", 2), 2)
    assert sorted(r.events for r in spread.collect()) == [0, 0, 0, 1, 1]


def test_ewma_stream_equals_the_batch_fold(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(3), i, float(i * 400 + (i > 30) * 90_000), rng.uniform(0, 9)) for i in range(60)]
    schema = "k int, seq int, t double, v double"
    got = drain(averages.ewma_stream(stream(spark, tmp_path, [rows[:25], rows[25:40], rows[40:]], schema), ["k"], "t", "v", 0.3, 60_000), "ewma", "update", tmp_path)
    last = {}
    for r in got:
        last[r.k] = max(last.get(r.k, (0.0, 0.0)), (r.updated_ms, round(r.ewma, 9)))
    want = windows.ewma(spark.createDataFrame(rows, schema), ["k"], ["t", "v"], "t", "v", 0.3, 60_000).collect()
    assert {k: v[1] for k, v in last.items()} == {r.k: round(r.ewma, 9) for r in want}


def one_by_one(samples, c):
    """Published means by the rules, a sample at a time: (mean, samples, time of publication, frozen) or None."""
    told, window, first, last, count, frozen = None, None, None, None, 0, False
    for t, v in samples:
        if frozen:
            break
        t = t if last is None else max(t, last)
        if last is None or t - last > c.ttl_ms:
            told, window, first, count = None, [t, []], t, 0
        if t - window[0] > c.ttl_ms:
            window = [t, []]
        last = t
        window[1].append(v)
        if t - window[0] >= c.interval_ms and len(window[1]) >= c.min_samples:
            value = sum(window[1]) / len(window[1])
            told = (value if told is None or t - told[1] > c.ttl_ms else told[0] + c.alpha * (value - told[0]), t)
            count += len(window[1])
            window = [t, []]
        frozen = 0 < c.freeze_after_ms <= t - first and told is not None and t - told[1] <= c.ttl_ms
    if told is None or not (frozen or last - told[1] <= c.ttl_ms):
        return None
    return round(told[0], 9), count, told[1], frozen


def read(s, c):
    return (round(s.mean, 9), s.samples, s.at, s.frozen) if s.usable(s.latest, c) else None


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_published_means_follow_the_rules_in_any_batches(data):
    c = averages.MeanConfig(
        alpha=data.draw(st.sampled_from([0.25, 1.0])), ttl_ms=data.draw(st.sampled_from([300, 900])), interval_ms=data.draw(st.sampled_from([0, 100, 300])),
        min_samples=data.draw(st.integers(1, 4)), freeze_after_ms=data.draw(st.sampled_from([0, 500, 1200])),
    )
    steps = data.draw(st.lists(st.sampled_from([0, 20, 90, 100, 200, 299, 301, 950]), max_size=40))
    samples, t = [], 0.0
    for k, step in enumerate(steps):
        t += step
        samples.append((t, float(k % 7)))
    s, at = averages.PublishedMean(), 0
    while at < len(samples):
        n = data.draw(st.integers(1, 12))
        part = samples[at : at + n]
        s.observe([t for t, _ in part], [v for _, v in part], c)
        at += n
    assert (read(s, c) if samples else None) == (one_by_one(samples, c) if samples else None)


def test_a_mean_is_an_ewma_of_whole_windows():
    c = averages.MeanConfig(alpha=0.5, interval_ms=1000, min_samples=3, ttl_ms=5000)
    s = averages.PublishedMean().observe([0, 400, 800, 1000], [1, 2, 3, 6], c)
    assert read(s, c) == (3.0, 4, 1000, False)
    s.observe([1500, 2500], [9, 9], c)  # long enough, but two samples
    assert s.mean == 3.0
    s.observe([2400], [3], c)  # late: counts at the time of the last one
    assert (s.mean, s.at, s.samples) == (5.0, 2500, 7)
    assert not s.usable(7501, c) and averages.MeanConfig() == averages.MeanConfig(min_samples=100, ttl_ms=10_000)
    with pytest.raises(ValueError):
        averages.MeanConfig(ttl_ms=1, interval_ms=2)


def test_mean_stream(spark, tmp_path):
    rows = [(k % 2, 1e6 + 200.0 * k, 2.0 + k) for k in range(24)]
    c = averages.MeanConfig(alpha=0.5, ttl_ms=10_000, interval_ms=1000, min_samples=2)
    schema = "k int, t double, v double"
    got = drain(averages.mean_stream(stream(spark, tmp_path, [rows[:7], rows[7:18], rows[18:]], schema), ["k"], "t", "v", c), "means", "update", tmp_path)
    for key in (0, 1):
        want = one_by_one([(t, v) for k, t, v in rows if k == key], c)
        assert max((r.samples, round(r.mean, 9), r.published_ms) for r in got if r.k == key) == (want[1], want[0], want[2])


def test_silent_keys_lose_their_state(spark, tmp_path):
    c = averages.MeanConfig(ttl_ms=2_000, interval_ms=100, min_samples=1)
    batches = [[(1, 100.0, 4.0), (1, 500.0, 4.0)], [(2, 60_000.0, 1.0)], [(2, 120_000.0, 1.0)], [(2, 180_000.0, 1.0)]]
    df = averages.mean_stream(stream(spark, tmp_path, batches, "k int, t double, v double"), ["k"], "t", "v", c, "1 second")
    q = df.writeStream.format("memory").queryName("silent").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress][-1] == 1


def test_estimates_fall_back_to_their_kind_and_are_bounded(spark):
    rows = [(1, "read", 2.0, 1, 10.0), (2, "read", 5.0, 3, 20.0), (2, "write", 9.0, 1, 30.0)]
    known = spark.createDataFrame(rows, "page int, kind string, ewma double, samples long, first_ms double")
    wanted = spark.createDataFrame([(1, "read"), (7, "read"), (1, "write"), (1, "upgrade")], "page int, kind string")
    got = {(r.page, r.kind): r.estimate for r in averages.with_fallback(wanted, known, ["page", "kind"], "kind").collect()}
    assert got == {(1, "read"): 2.0, (7, "read"): 4.25, (1, "write"): 9.0, (1, "upgrade"): None}
    assert sorted(r.first_ms for r in averages.within_capacity(known, 2).collect()) == [20.0, 30.0]


def test_votes(spark, tmp_path):
    at = lambda s: f"2024-01-01 00:00:{s:02d}"
    rows = [(1, 0, 2, True, at(0)), (2, 0, 2, True, at(0)), (3, 0, 3, True, at(1)), (1, 1, 2, True, at(1)), (1, 1, 2, True, at(2)), (2, 1, 2, False, at(2)), (3, 1, 3, True, at(2))]
    later = [(9, 0, 1, True, "2024-01-01 01:00:00")]
    schema = "txn int, node int, participants int, vote boolean, ts string"
    got = drain(votes.decisions(stream(spark, tmp_path, [rows[:3], rows[3:], later, [(8, 0, 1, True, "2024-01-01 02:00:00")]], schema)), "votes", "append", tmp_path)
    told = {r.txn: (r.decision, r.voters) for r in got}
    assert told[1] == ("commit", 2) and told[2][0] == "abort" and told[3] == ("timeout", 2) and told[9] == ("commit", 1)
    assert len(got) == len(told)
    done = {r.txn: r.decision for r in votes.decided(spark.createDataFrame(rows, schema)).collect()}
    assert done == {1: "commit", 2: "abort", 3: "timeout"}


def test_later_votes_do_not_put_off_the_timeout(spark, tmp_path):
    vote = lambda txn, node, at: (txn, node, 5, True, f"2024-01-01 00:00:{at:02d}")
    batches = [[vote(1, 0, 1)], [vote(1, 1, 9), vote(2, 0, 40)], [vote(2, 1, 41)], [vote(3, 0, 42)]]
    df = votes.decisions(stream(spark, tmp_path, batches, "txn int, node int, participants int, vote boolean, ts string"), lateness="25 seconds", timeout_ms=10_000)
    # the watermark is at 15 s after the second batch: past 1 + 10, not past 9 + 10
    assert [(r.txn, r.decision, r.voters) for r in drain(df, "put_off", "append", tmp_path)] == [(1, "timeout", 2)]


def test_replay_is_idempotent_and_ordered_by_log_number(spark, tmp_path):
    rng = random.Random(4)
    log = [(rng.randrange(6), lsn, rng.choice(["insert", "update", "update", "delete"]), rng.random()) for lsn in range(80)]
    mixed = rng.sample(log, len(log)) + rng.sample(log, 20)
    schema = "k int, lsn int, op string, image double"
    table = replay.ReplayedTable(spark, str(tmp_path / "table"), ["k"])
    assert table.rows(schema).count() == 0
    table.run(stream(spark, tmp_path, [mixed[:40], mixed[40:60], mixed[60:]], schema), str(tmp_path / "cp")).awaitTermination()
    want = sorted(map(tuple, windows.replayed(spark.createDataFrame(log, schema), ["k"], "lsn", "op").collect()))
    assert sorted(map(tuple, table.rows().collect())) == want
    table.apply(spark.createDataFrame(mixed[60:], schema), 2)
    assert sorted(map(tuple, table.rows().collect())) == want
    table.apply(spark.createDataFrame([(99, 1000, "insert", 0.5)], schema), 3)
    assert {p.name for p in (tmp_path / "table" / "v3").iterdir() if p.name.startswith("_b")} == {f"_b-{b}" for b in {table._held and max(k for k, v in table._held().items() if v[-1] == 3)}}
    assert sorted(map(tuple, table.rows().collect())) == sorted([*want, (99, 1000, "insert", 0.5)])
