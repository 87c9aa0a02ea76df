"""The keyed ledger over restarts, repeats and late entries, and expiry."""

from datetime import datetime, timedelta

import pytest

from beliefline.streaming import ledger

DAY = datetime(2024, 5, 1)


def run(spark, tmp_path, files, **options):
    """A restart of the query for each file, from its checkpoint; the rows of every batch."""
    out = []
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, ledger.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = ledger.keyed_ledger(ledger.read_events(spark, str(tmp_path / "in")), **options).writeStream.outputMode("update")
        query = query.foreachBatch(lambda df, n, i=i: out.extend((i, *r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(180)
        query.stop()
    return out


@pytest.fixture
def stateful(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ledger.STATE_STORE)
    yield spark
    spark.conf.set(name, before)


def event(i, day, user, value=1.0, kind="a"):
    return (i, None if day is None else DAY + timedelta(days=day), user, kind, value, None)


def test_restarts_repeats_and_late_entries(stateful, tmp_path):
    files = [
        [event(1, 0, 7, 1.0), event(2, 1, 7, 2.0), event(2, 1, 7, 2.0), event(3, 0, 8, 3.0), event(None, 0, 7), event(4, None, 7), event(5, 0, None)],
        [event(2, 1, 7, 2.0), event(6, 0.5, 7, 6.0)],  # a repeat from before the restart, an older entry in time
        [event(7, -5, 7, 7.0), event(8, 3, 8, None)],  # too late; another key goes on
    ]
    rows = {(i, key): (event_id, value, entries, repeats, late, state) for i, key, event_id, _, value, entries, repeats, late, state in run(stateful, tmp_path, files)}
    assert rows[0, "7|a"] == (2, 2.0, 2, 1, 0, "new") and rows[0, "8|a"] == (3, 3.0, 1, 0, 0, "new")
    assert rows[1, "7|a"] == (2, 2.0, 3, 2, 0, "replayed")
    assert rows[2, "7|a"] == (2, 2.0, 3, 2, 1, "replayed") and rows[2, "8|a"] == (8, None, 2, 0, 0, "changed")
    assert len(rows) == 5


def test_keys_expire(stateful, tmp_path):
    options = {"expire": timedelta(days=2), "watermark": "1 day"}
    files = [[event(1, 0, 7)], [event(2, 10, 8)], [event(3, 11, 8)], [event(9, 11, 7)]]
    rows = run(stateful, tmp_path, files, **options)
    gone = [r for r in rows if r[1] == "7|a" and r[-1] == "expired"]
    assert len(gone) == 1 and gone[0][2] == 1
    again = [r for r in rows if r[1] == "7|a" and r[0] == 3]
    assert [(r[2], r[5], r[-1]) for r in again] == [(9, 1, "new")], "an expired key begins anew"
