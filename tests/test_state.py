"""Streams with state: entries that expire, starts that keep a gap, books that grow; the same as the batch forms, also after a restart."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioforge.operators import stores
from folioforge.streaming import flows, state

EVENTS = "user_id long, event_id long, ms long"


@pytest.fixture
def stream(spark, tmp_path):
    """Feeds batches of rows to a query made by ``plan``, which is started anew for each from the same checkpoint, and gives what came out."""
    state.use_state_store(spark)

    def feed(batches, kind, plan, name):
        for rows in batches:
            spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}-in")
            read = spark.readStream.schema(kind).parquet(f"{tmp_path}/{name}-in")
            q = plan(read).writeStream.format("parquet").option("path", f"{tmp_path}/{name}-out").option("checkpointLocation", f"{tmp_path}/{name}-check").trigger(availableNow=True).start()
            assert q.awaitTermination(120)
        return spark.read.parquet(f"{tmp_path}/{name}-out")

    yield feed
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def events(spark, n=400):
    own = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("user_id"), F.col("event_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "event_type")
    return own.orderBy("ms", "event_id").limit(n)


def test_expired_is_what_is_not_live(spark, stream):
    rows = flows.with_expiry(events(spark), F.col("event_type") == "purchase", "ms", 86_400_000, 3_600_000).select("user_id", "event_id", "ms", "expires").collect()
    last = max(r.ms for r in rows)
    batches = [rows[:150], rows[150:300], rows[300:], [(-1, -1, last, last + 10**12)], [(-1, -2, last, last + 10**12)]]
    kind = f"{EVENTS}, expires long"
    plan = lambda read: state.expired_stream(read.withColumn("at", F.timestamp_millis("ms")), ["user_id"], "event_id", "expires", "at")
    out = stream(batches, kind, plan, "expired")
    live = {r.event_id for r in stores.live(spark.createDataFrame(rows, kind), F.lit(last)).collect()}
    gone = [int(r.event_id) for r in out.collect()]
    assert len(gone) == len(set(gone)) and live and set(gone) == {r.event_id for r in rows if r.event_id not in live}
    assert all(r.expires < last for r in out.collect())


def test_a_new_entry_lives_on(spark, stream):
    kind = "k string, entry string, expires long, ms long"
    batches = [[("a", "x", 5000, 1000), ("a", "y", 5000, 1000)], [("a", "x", 90_000, 4000)], [("b", "z", 10**9, 10_000)], [("b", "w", 10**9, 10_000)], [("b", "late", 3000, 20_000)]]
    plan = lambda read: state.expired_stream(read.withColumn("at", F.timestamp_millis("ms")), ["k"], "entry", "expires", "at")
    out = stream(batches, kind, plan, "renewed")
    assert sorted((r.k, r.entry) for r in out.collect()) == [("a", "y"), ("b", "late")]


def test_starts_keep_the_gap(spark, stream):
    rows = [tuple(r) for r in events(spark).select("user_id", "event_id", "ms").collect()]
    out = stream([rows[:100], rows[100:101], rows[101:]], EVENTS, lambda read: state.gate_stream(read, ["user_id"], "event_id", "ms", 3_600_000), "gate")
    want = flows.gate_schedule(spark.createDataFrame(rows, EVENTS), ["user_id"], "ms", 3_600_000, ["event_id"])
    assert {r.event_id: r.start for r in out.collect()} == {r.event_id: r.start for r in want.collect()}
    assert out.filter("start > ms").count() > 20


def test_one_gate_for_all(spark, stream):
    out = stream([[(1, 1, 0), (1, 2, 0)], [(1, 3, 100), (1, 4, 60_000)]], EVENTS, lambda read: state.gate_stream(read, ["user_id"], "event_id", "ms", 5000), "one")
    assert dict(out.select("event_id", "start").toPandas().sort_values("event_id").itertuples(index=False)) == {1: 0, 2: 5000, 3: 10_000, 4: 60_000}
    assert isinstance(out.toPandas(), pd.DataFrame)


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


@pytest.mark.parametrize("grows_only", [False, True])
def test_only_touched_folders_are_written(spark, tmp_path, grows_only):
    kind = "book_id string, chapter_id string, at long, char_count long, paragraph_count long, v string"
    row = lambda b, c, at, n, v: (b, c, at, n, n, v)
    first = [row("a", "1", 1, 5, "x"), row("a", "2", 1, 5, "x"), row("b", "1", 1, 5, "x"), row("b", "1", 2, 6, "y"), row("007", "1", 1, 1, "z")]
    second = [row("b", "1", 3, 4, "shorter"), row("b", "2", 3, 9, "new"), row("b", "2", 3, 9, "new")]
    table, source = tmp_path / "table", tmp_path / "in"

    def run(rows):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(source))
        flows.maintain(spark.readStream.schema(kind).parquet(str(source)), str(table), ["book_id", "chapter_id"], "at", str(tmp_path / "check"), grows_only=grows_only).awaitTermination()
        schema = spark.createDataFrame([], kind).schema
        return sorted((r.book_id, r.chapter_id, r.v) for r in flows.table(spark, str(table), schema).collect())

    assert run(first) == [("007", "1", "z"), ("a", "1", "x"), ("a", "2", "x"), ("b", "1", "y")]
    before = files(table)
    want = [("007", "1", "z"), ("a", "1", "x"), ("a", "2", "x"), ("b", "1", "y" if grows_only else "shorter"), ("b", "2", "new")]
    assert run(second) == want
    after = files(table)
    assert {k for k in before if before[k] == after.get(k)} == {k for k in before if not k.startswith("book_id=b/")}
    # The same batch again, as after a failure.
    flows.merge_batch(spark.createDataFrame(second, kind), str(table), ["book_id", "chapter_id"], "at", grows_only=grows_only)
    assert sorted((r.book_id, r.chapter_id, r.v) for r in flows.table(spark, str(table), spark.createDataFrame([], kind).schema).collect()) == want
    assert flows.table(spark, str(tmp_path / "none"), spark.createDataFrame([], kind).schema) is None
