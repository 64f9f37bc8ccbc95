import time

from folioscope.streaming import queue

SCHEMA = "collection long, slug long, kind string, at timestamp, published boolean"
DAY = 24 * 60 * 60 * 1000


def test_steps():
    sent = ("add", 0, None, None)
    assert queue.step(queue.NOTHING, "add", 5, False) == (None, None, "add", 5)
    assert queue.step((None, None, "add", 5), "remove", 6, False) == queue.NOTHING
    assert queue.step((None, None, "add", 5), "sent", 7, False) == ("add", 7, None, None)
    assert queue.step(sent, "remove", 5, False) == ("add", 0, "remove", 5)
    assert queue.step(("add", 0, "remove", 5), "add", 6, False) == sent
    assert queue.step(sent, "page", 5, True) == queue.NOTHING and queue.step(sent, "page", 5, False) == sent
    assert queue.step(("add", 0, "remove", 5), "page", 6, True) == (None, None, "remove", 5)
    assert queue.step(sent, "page", 7 * DAY, False) == sent and queue.step(sent, "page", 7 * DAY + 1, False) == queue.NOTHING
    assert queue.step((None, None, "add", 0), "page", 90 * DAY, True) == (None, None, "add", 0)


def test_sent_edit_ends_without_a_message(spark, tmp_path):
    """A member that was sent ends by its timer in an empty batch, one that a page agrees with at once, a pending one stays."""
    source, seen = str(tmp_path / "messages"), []
    now = "current_timestamp()"
    rows = [(1, 1, "add", 0), (1, 1, "sent", 1), (1, 2, "add", 0), (1, 2, "sent", 1), (1, 2, "page", 2), (1, 3, "remove", 0)]
    values = " UNION ALL ".join(f"SELECT {c}L collection, {s}L slug, '{k}' kind, {now} + INTERVAL {n} MILLISECONDS at, {str(k == 'page' or s == 3).lower()} published" for c, s, k, n in rows)
    spark.sql(values).coalesce(1).write.parquet(source)

    def keep(batch, _):
        seen.extend((r.slug, r.state, r.action) for r in batch.collect())

    stream = queue.entries(spark.readStream.schema(SCHEMA).parquet(source), overlay_ms=20_000)
    run = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="2 seconds").start()
    try:
        end = time.time() + 150
        while (1, "none", None) not in seen and time.time() < end and run.exception() is None:
            time.sleep(0.5)
        run.processAllAvailable() if run.exception() is None else None
    finally:
        run.stop()
    assert run.exception() is None
    assert [s for s in seen if s[0] == 1] == [(1, "sent", "add"), (1, "none", None)]
    assert [s for s in seen if s[0] == 3] == [(3, "pending", "remove")] and (2, "sent", "add") not in seen
    left = spark.read.format("statestore").option("stateVarName", "entry").load(str(tmp_path / "c"))
    assert [r.key.slug for r in left.collect()] == [3]
