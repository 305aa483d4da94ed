"""The store's commits, and streaming reads of its files."""

import datetime as dt

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_vectors import events, states

from annalist.operators import journal, writes
from annalist.sources.schema import JOURNAL
from annalist.sources.store import CommitLost, Store
from annalist.streaming import live


def test_commits(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.version() == 0 and store.read("journal").count() == 0
    store.commit(appends={"journal": events(spark, [("t|A", 1, 1), ("u|B", 1, 2)])})
    base = store.version()
    store.commit(appends={"journal": events(spark, [("t|A", 2, 3)])}, rewrites={"state": states(spark, [("t|A", 1, "a")])})
    assert store.version() == 2 and store.read("journal").count() == 3 and store.read("state").count() == 1
    assert store.read("journal", 1).count() == 2
    with pytest.raises(CommitLost):
        store.commit(appends={"journal": events(spark, [("t|A", 3, 3)])}, base=base)
    assert store.read("journal").count() == 3

    def fails(_):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        store.commit(rewrites={"state": states(spark, [])}, handler=fails)
    assert store.read("state").count() == 1
    store.commit(rewrites={"state": states(spark, [("t|A", 2, "b")])}, handler=lambda s: {"counts": s.read("state").groupBy("slice").count()})
    assert store.version() == 3 and store.read("counts").count() == 1
    new = writes.new_events(spark.createDataFrame([("t|A", 3)], "persistence_id string, seq_nr long"), store.read("journal"), dt.datetime(2024, 1, 2))
    store.commit(appends={"journal": new})
    assert journal.highest_seq_nr(store.read("journal"), "t|A").first()[0] == 3
    store.register()
    assert spark.sql("select count(*) from journal where entity_type = :t", {"t": "t"}).first()[0] == 3


def test_ranges_prune_folders(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "3000")
    store = Store(spark, f"file://{tmp_path}/pruned")
    store.commit(appends={"journal": events(spark, [(f"t|{i}", 1, i) for i in range(200)])})
    rows = journal.events_by_slices_scan(store.journal(0, 255), "t", 0, 255, dt.datetime(2024, 1, 1))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(data_partition" in plan and "entity_type" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "GreaterThanOrEqual(db_timestamp" in plan and "TakeOrderedAndProject" in plan
    light = journal.events_by_slices_scan(store.journal(0, 255), "t", 0, 255, backtracking=True)
    assert "event_payload" not in light._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1].split("\n")[0]
    assert rows.count() == events(spark, [(f"t|{i}", 1, i) for i in range(200)]).where("slice < 256").count()
    assert store.journal(0, 255, strict=True).count() == rows.count()
    with pytest.raises(ValueError):
        store.journal(200, 300, strict=True)


def run(spark, stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    return q


def test_live_events_are_given_once(spark, tmp_path):
    path = f"{tmp_path}/j"
    events(spark, [("t|A", 1, 1), ("t|A", 2, 2), ("u|B", 1, 1)]).coalesce(1).write.parquet(path)
    rows = live.stream(spark, path, JOURNAL, 1)
    q = run(spark, live.events_by_slices(rows, "t", 0, 1023), "once")
    events(spark, [("t|A", 2, 2), ("t|A", 3, 1.5)]).coalesce(1).write.mode("append").parquet(path)
    q.processAllAvailable()
    q.stop()
    assert sorted(r.seq_nr for r in spark.table("once").collect()) == [1, 2, 3]
    late = run(spark, live.late_marked(rows.withColumn("one", F.lit(0)), "one"), "late")
    late.stop()
    assert {(r.persistence_id, r.seq_nr): r.source for r in spark.table("late").where("source = 'BT'").collect()}
    one = run(spark, live.events_by_persistence_id(rows, "t|A", 3), "one_id")
    one.stop()
    assert [r.seq_nr for r in spark.table("one_id").collect()] == [3]


def test_old_events_of_a_later_batch(spark, tmp_path):
    path = f"{tmp_path}/old"
    events(spark, [("t|A", 3, 90_000), ("t|B", 1, 90_001)]).coalesce(1).write.parquet(path)
    rows = live.stream(spark, path, JOURNAL, 1).withColumns({"big": F.when(F.col("seq_nr") > 1, F.lit(2**60 + 1)), "source": F.when(F.col("seq_nr") == 7, "BT").otherwise("")})
    q = run(spark, live.events_by_slices(rows, "t", 0, 1023), "old")
    for part in ([("t|A", 1, 1), ("t|A", 2, 2), ("t|A", 3, 90_000)], [("t|A", 7, 1), ("t|A", 5, 1), ("t|A", 5, 1)], [("t|A", 7, 1), ("t|A", 4, 3), ("t|B", 1, 90_001)]):
        events(spark, part).coalesce(1).write.mode("append").parquet(path)
        q.processAllAvailable()
    q.stop()
    got = spark.table("old").collect()
    assert sorted((r.persistence_id, r.seq_nr) for r in got) == [("t|A", 1), ("t|A", 2), ("t|A", 3), ("t|A", 4), ("t|A", 5), ("t|A", 7), ("t|A", 7), ("t|B", 1)]
    assert {r.seq_nr: r.big for r in got if r.persistence_id == "t|A"} == {1: None, **{n: 2**60 + 1 for n in (2, 3, 4, 5, 7)}}
    want = {(r.persistence_id, r.seq_nr): r.db_timestamp for r in spark.read.parquet(path).collect()}
    assert all(want[r.persistence_id, r.seq_nr] == r.db_timestamp for r in got)


@given(st.lists(st.integers(1, 30)))
def test_ranges_of_numbers(numbers):
    lows, highs, seen = [], [], set()
    for n, new in zip(numbers, live._new_numbers(lows, highs, numbers), strict=True):
        assert new == (n not in seen)
        seen.add(n)
    assert [n for a, b in zip(lows, highs, strict=True) for n in range(a, b + 1)] == sorted(seen)
    assert all(b + 1 < a for b, a in zip(highs, lows[1:]))


def test_follow_gives_what_commits_append(spark, tmp_path):
    store, got = Store(spark, f"file://{tmp_path}/followed"), []
    give = lambda rows, n: got.extend((r.persistence_id, r.seq_nr) for r in rows.collect())
    store.commit(appends={"journal": events(spark, [("t|A", 1, 1)])})
    base = store.version()
    store.commit(appends={"journal": events(spark, [("t|A", 2, 2)])})
    with pytest.raises(CommitLost):
        store.commit(appends={"journal": events(spark, [("t|lost", 1, 1)])}, base=base)
    store.follow("journal", give, f"{tmp_path}/fcp", availableNow=True).awaitTermination()
    assert sorted(got) == [("t|A", 1), ("t|A", 2)]
    store.commit(rewrites={"journal": store.read("journal").where("seq_nr = 2")}, appends={"state": states(spark, [("t|A", 1, "a")])})
    store.commit(appends={"journal": events(spark, [("t|A", 3, 3)])})
    store.follow("journal", give, f"{tmp_path}/fcp", availableNow=True).awaitTermination()
    assert sorted(got) == [("t|A", 1), ("t|A", 2), ("t|A", 3)]


def test_change_leaves_other_folders(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/changed")
    store.commit(appends={"journal": events(spark, [(f"{t}|{i}", 1, i) for i in range(60) for t in ("t", "a b%", "7")])})
    before = {(r.persistence_id, r.entity_type) for r in store.read("journal").collect()}
    files = lambda: {f for f in store.read("journal").inputFiles()}
    was, one = files(), store.read("journal").where("persistence_id = 't|5'").first()
    store.change_slices("journal", "t", one.slice, one.slice, lambda rows: rows.where("persistence_id <> 't|5'"))
    assert {(r.persistence_id, r.entity_type) for r in store.read("journal").collect()} == before - {("t|5", "t")}
    where = f"/entity_type=t/data_partition={one.slice // 256}/"
    assert {f for f in was if where not in f} <= files() and not {f for f in was if where in f} & files()
    store.change_slices("journal", "a b%", 0, 1023, lambda rows: rows.limit(0))
    assert {r.entity_type for r in store.read("journal").collect()} == {"t", "7"}
    store.change_slices("journal", "nobody", 0, 1023, lambda rows: rows.limit(0))
    assert store.version() == 4


def test_sequence(spark, tmp_path):
    path = f"{tmp_path}/s"
    for part in ([("t|A", 1, 1), ("t|A", 3, 3)], [("t|B", 1, 1), ("t|A", 3, 3)], [("t|A", 2, 2), ("t|A", 5, 5)]):
        events(spark, part).coalesce(1).write.mode("append").parquet(path)
    q = run(spark, live.in_sequence(live.stream(spark, path, JOURNAL, 1)), "sequence")
    q.stop()
    assert [r.seq_nr for r in spark.table("sequence").where("persistence_id = 't|A'").collect()] == [1, 2, 3]


def test_pushed_and_changes(spark, tmp_path):
    path = f"{tmp_path}/p"
    source = F.when(F.col("seq_nr") == 2, "BT").when(F.col("seq_nr") == 4, "HB").otherwise("PS")
    for part in ([("t|A", 1, 1)], [("t|A", 2, 2)], [("t|A", 3, 500)], [("t|A", 4, 450)], [("t|A", 5, 500)]):
        events(spark, part).withColumn("source", source).coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    q = run(spark, live.pushed_in_time(live.stream(spark, path, schema, 1), 120), "pushed")
    q.stop()
    assert {2, 5} <= {r.seq_nr for r in spark.table("pushed").collect()} and 4 not in {r.seq_nr for r in spark.table("pushed").collect()}
    states(spark, [("t|A", 1, "a")]).coalesce(1).write.parquet(f"{tmp_path}/st")
    seen = []
    q = live.handled(live.changes_by_slices(live.state_stream(spark, f"{tmp_path}/st"), "t", 0, 1023), lambda df, n: seen.extend(df.collect()), f"{tmp_path}/cp", "1 second")
    q.processAllAvailable()
    q.stop()
    assert [(r.persistence_id, r.change_type) for r in seen] == [("t|A", "updated")]
