"""Fixed input and output of single operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from annalist.functions import buckets, offsets, rates, slices
from annalist.operators import cleanup, journal, merge, migrate, snapshots, state, writes
from annalist.sources.fixtures import zoneless
from annalist.sources.schema import JOURNAL, PROGRESS, SNAPSHOT, STATE
from annalist.streaming import live

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def events(spark, rows):
    """rows of (persistence_id, seq_nr, seconds, deleted?)."""
    made = [(r[0], r[1], float(r[2]), bool(r[3]) if len(r) > 3 else False) for r in rows]
    df = spark.createDataFrame(made, "persistence_id string, seq_nr long, s double, deleted boolean")
    df = df.withColumns({"slice": slices.slice_for("persistence_id"), "entity_type": slices.entity_type_of("persistence_id"), "db_timestamp": F.timestamp_micros((F.lit(1704067200_000_000) + F.round(F.col("s") * 1_000_000)).cast("long")), "event_payload": F.concat("persistence_id", F.lit("-"), F.col("seq_nr").cast("string")).cast("binary"), "event_ser_id": F.lit(1), "event_ser_manifest": F.lit(""), "writer": F.lit("")})
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in JOURNAL.fields))


def snaps(spark, rows):
    df = spark.createDataFrame(rows, "persistence_id string, seq_nr long")
    df = df.withColumns({"slice": slices.slice_for("persistence_id"), "entity_type": slices.entity_type_of("persistence_id"), "write_timestamp": F.lit(1704067200000), "ser_id": F.lit(1), "ser_manifest": F.lit(""), "snapshot": F.concat(F.lit("snap-"), "persistence_id", F.col("seq_nr").cast("string")).cast("binary")})
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SNAPSHOT.fields))


def test_slices(spark):
    def java(s):
        h = 0
        raw = s.encode("utf-16-be")
        for i in range(0, len(raw), 2):
            h = (h * 31 + int.from_bytes(raw[i : i + 2], "big")) & 0xFFFFFFFF
        h = h - (1 << 32) if h >> 31 else h
        return abs(h) % 1024 if h >= 0 else (-h) % 1024

    ids = ["deal|2186922658", "", "a", "TestEntity-1", "ünï|𝒳𝒴", *(f"click|{i}" for i in range(200))]
    got = {r.p: r.s for r in spark.createDataFrame([(i,) for i in ids], "p string").select("p", slices.slice_for("p").alias("s")).collect()}
    assert got["deal|2186922658"] == 973
    assert got == {i: java(i) for i in ids}
    assert slices.slice_ranges(4) == [(0, 255), (256, 511), (512, 767), (768, 1023)]
    for bad in (3, 0, 2048):
        with pytest.raises(ValueError):
            slices.slice_ranges(bad)
    slices.checked_range(0, 255, 4, strict=True)
    for low, high in ((200, 300), (5, 4), (0, 1024)):
        with pytest.raises(ValueError):
            slices.checked_range(low, high, 4, strict=True)


def test_heartbeat_hashes_to_its_slice(spark):
    for low in (0, 256, 1000):
        for kind in ("type", "Zähler", "журнал", "計器𝒳"):
            pid = live.heartbeat(kind, low, 1)
            assert pid.startswith(kind + "|") and spark.range(1).select(slices.slice_for(F.lit(pid))).first()[0] == low


def test_buckets(spark):
    b = buckets.Buckets({100: 101, 110: 202, 120: 303, 130: 304, 140: 305, 150: 306})
    assert [b.find(100, n) for n in (202, 203, 505, 810, 1420)] == [120, 130, 130, 150, 160] and b.find(100, 1421) is None and b.find(90, 100) == 110
    df = spark.createDataFrame(list(b.counts.items()), "bucket long, count long")
    for n in (202, 203, 505, 810, 1420, 1421):
        assert buckets.time_for_limit(df, dt.datetime(1970, 1, 1, 0, 1, 40), n).first()["end"] == b.find(100, n)
    assert list(b.clear_until(129).counts) == [120, 130, 140, 150] and list(b.clear_until(10**6).counts) == [150]
    assert b.next_start() == 140 and buckets.Buckets().next_start() is None
    assert len(buckets.Buckets().add([(10 * i, 1) for i in range(12_000)]).counts) == buckets.LIMIT
    rows = events(spark, [("a|1", i, i * 5) for i in range(20)])
    got = buckets.count_buckets(rows, T0, at(1000)).collect()
    assert [r["count"] for r in got] == [2] * 10
    ended = buckets.with_empty_end(buckets.count_buckets(rows, T0, at(10_000), 5), T0, at(10_000), 5).collect()
    assert (ended[-1]["bucket"], ended[-1]["count"]) == (1704067200 + 60, 0) and len(ended) == 6
    assert len(buckets.with_empty_end(buckets.count_buckets(rows, T0, at(95)), T0, at(95)).collect()) == 10


def test_moving_average(spark):
    def run(values, a):
        return spark.range(1).select(rates.ewma(F.array(*map(F.lit, values)), a)).first()[0]

    a = 2 / 11
    for n, want in enumerate([1000.0, 820.0, 672.73, 552.23, 453.64]):
        assert run([1000.0] + [10.0] * n, a) == pytest.approx(want, abs=0.01)


def test_delay():
    assert [rates.next_delay(n, 100, 3.0) for n in (0, 10, 11, 50, 89, 90, 100)] == [3.0, 3.0, 1.5, 1.5, 1.5, 0.0, 0.0]


def test_snapshot_substitution(spark):
    rows = events(spark, [("t|A", i, i) for i in (1, 2, 3, 4)] + [("t|B", i, 10 + i) for i in (1, 2)] + [("t|C", i, 20 + i) for i in (1, 2)])
    got = snapshots.starting_from_snapshots(rows, snaps(spark, [("t|A", 2), ("t|C", 1)])).collect()
    assert {(r.persistence_id, r.seq_nr, r.source) for r in got} == {("t|A", 2, "SN"), ("t|A", 3, ""), ("t|A", 4, ""), ("t|B", 1, ""), ("t|B", 2, ""), ("t|C", 1, "SN"), ("t|C", 2, "")}
    gap = snapshots.starting_from_snapshots(rows.where("not (persistence_id = 't|A' and seq_nr = 2)"), snaps(spark, [("t|A", 2)])).where("persistence_id = 't|A'").collect()
    assert {(r.seq_nr, r.source) for r in gap} == {(3, ""), (4, "")}
    one = snapshots.by_persistence_id(rows, snaps(spark, [("t|A", 2)]), "t|A", 1, 10).collect()
    assert [(r.seq_nr, r.source) for r in one] == [(2, "SN"), (3, ""), (4, "")]
    past = snapshots.by_persistence_id(rows, snaps(spark, [("t|A", 2)]), "t|A", 3, 4).collect()
    assert [(r.seq_nr, r.source) for r in past] == [(3, ""), (4, "")]


def test_snapshot_save_and_criteria(spark):
    rows = events(spark, [("t|A", 1, 1), ("t|A", 2, 2)])
    got = {r.persistence_id: r for r in snapshots.saved(snaps(spark, [("t|A", 9)]), rows, snaps(spark, [("t|A", 2), ("t|Z", 1)])).collect()}
    assert got["t|A"].seq_nr == 2 and got["t|Z"].tags == []
    assert snapshots.load_snapshot(snaps(spark, [("t|A", 2)]), "t|A", max_seq_nr=0).count() == 0
    assert snapshots.load_snapshot(snaps(spark, [("t|A", 2)]), "t|A", max_seq_nr=1).count() == 0
    assert snapshots.without(snaps(spark, [("t|A", 2)]), "t|A", seq_nr=1).count() == 1


def test_deduplication(spark):
    given = "A1 A2 B1 A3 A1 A2 B1 A3 B2 B2".split()
    d = merge.BoundedDeduplicator(100)
    assert [x for x in given if d.accepts(x[0], int(x[1]))] == "A1 A2 B1 A3 B2".split()
    d = merge.BoundedDeduplicator(3)
    assert [d.accepts("A", i) for i in (1, 2, 3, 4, 1)] == [True] * 5 and d.accepts("A", 1, "BT")
    df = spark.createDataFrame([(i, x[0], int(x[1]), "BT" if i == 4 else "") for i, x in enumerate(given)], "n long, persistence_id string, seq_nr long, source string")
    assert [given[r.n] for r in merge.deduplicated(df, "n").orderBy("n").collect()] == "A1 A2 B1 A3 A1 B2".split()


def test_too_far_ahead(spark):
    rows = [(1, "PS", 0), (2, "", 1), (3, "BT", 10), (4, "PS", 100), (5, "PS", 131), (6, "HB", 60), (7, "PS", 131), (8, "", 500)]
    df = spark.createDataFrame([(n, s, at(t), 0) for n, s, t in rows], "n long, source string, db_timestamp timestamp, slice_range int")
    for span in (1, 2, 3, 100):
        assert [r.n for r in merge.without_too_far_ahead(df, 120, "n", span=span).orderBy("n").collect()] == [2, 3, 4, 7, 8]


def test_same_time_resume(spark):
    rows = [("t|A", i, 1) for i in range(1, 7)] + [("t|B", 3, 1), ("t|B", 4, 1), ("t|C", 3, 1)] + [("t|D", i, 1.001) for i in (1, 2, 3)]
    df, got, offset = events(spark, rows), [], None
    while page := offsets.unseen(df, offset).orderBy(*journal.ORDER).limit(4).collect():
        for r in page:
            offset = offsets.TimestampOffset.of(offset).advanced(offsets.EPOCH + dt.timedelta(microseconds=int(r.db_timestamp.timestamp() * 1_000_000)), r.persistence_id, r.seq_nr)
            got.append(f"{r.persistence_id[-1]}{r.seq_nr}")
    assert [x for x in got if x[0] == "A"] == [f"A{i}" for i in range(1, 7)] and got[-3:] == ["D1", "D2", "D3"]
    assert len(got) == len(set(got)) == len(rows)
    many = offsets.TimestampOffset(at(1), {"t|A": 4, **{f"x|{i}": 1 for i in range(offsets.LITERAL_SEEN + 1)}})
    assert offsets.unseen(df, many).count() == 2 + 3 + 3


def test_reads(spark):
    df = events(spark, [("t|A", 1, 1), ("t|A", 2, 2), ("t|A", 3, 3, True), ("u|B", 1, 5)])
    assert journal.load_envelope(df, "t|A", 2)["event"] == bytearray(b"t|A-2")
    with pytest.raises(KeyError):
        journal.load_envelope(df, "t|A", 3)
    assert [r.seq_nr for r in journal.load_last_event(df, "t|A").collect()] == [2]
    assert [r.seq_nr for r in journal.load_last_event(df, "t|A", include_deleted=True).collect()] == [3]
    assert journal.highest_seq_nr(df, "t|A").first()[0] == 3 and journal.highest_seq_nr(df, "t|X").first()[0] == 0
    got = lambda *args: ([r.seq_nr for r in journal.replay(df, *args)[0].collect()], journal.replay(df, *args)[1].first()[0])
    top = 2**63 - 1
    assert got("t|A", -1, 10, 10) == ([], 3) and got("t|A", -1, 2, 10) == ([2], 2) and got("t|X", -1, top, top) == ([], 0)
    assert got("t|A", 0, top, top) == ([1, 2], 3) and got("t|A", 4, top, top) == ([], 0) and got("t|A", 2, 2, top) == ([2], 3)
    assert journal.replay(df, "t|A", 1, 0, 10)[0].count() == 0
    assert [r.seq_nr for r in journal.replay(df, "t|A", 1, 2**63 - 1, 1)[0].collect()] == [1] and journal.replay(df, "t|A", 1, 5, 0)[1].first()[0] == 3
    now, cache = [0.0], None
    cache = journal.LatestTimestampCache(df, 1.0, lambda: now[0])
    first = cache.get("u", 0, 1023)
    cache.journal = df.limit(0)
    assert cache.get("u", 0, 1023) == first
    now[0] = 2.0
    assert cache.get("u", 0, 1023) is None
    filtered = df.withColumn("event_ser_id", F.lit(-1))
    assert all(r.filtered and r.event is None for r in journal.envelopes(filtered).collect())


def test_recency_order(spark):
    df = events(spark, [("t|A", 1, -3600), ("t|A", 2, -10), ("t|B", 1, -60)])
    assert [r.persistence_id for r in journal.persistence_ids_by_slices(df, "t", 0, 1023).collect()] == ["t|A", "t|B"]


def test_event_writes(spark):
    old = events(spark, [("t|A", 1, 100)])
    new = spark.createDataFrame([("t|A", 2, 1), ("t|A", 3, 1), ("t|A", 4, 2), ("t|B", 1, 1), ("t|B", 2, 2)], "persistence_id string, seq_nr long, write_nr int")
    got = {(r.persistence_id, r.seq_nr): r.us for r in writes.new_events(new, old, at(50)).withColumn("us", F.unix_micros("db_timestamp")).collect()}
    base = 1704067200 * 1_000_000
    assert got["t|A", 2] == got["t|A", 3] == base + 100_000_001 and got["t|A", 4] == base + 100_000_002
    assert got["t|B", 1] == base + 50_000_000 and got["t|B", 2] == base + 50_000_001
    with pytest.raises(writes.Conflict):
        writes.new_events(spark.createDataFrame([("t|A", 1)], "persistence_id string, seq_nr long"), old)
    more = writes.new_events(new, old, at(50), additional={"length": F.length("persistence_id")})
    assert more.columns[-1] == "length" and more.where("length <> 3").count() == 0


def states(spark, rows):
    df = spark.createDataFrame(rows, "persistence_id string, revision long, payload string")
    df = df.withColumns({"slice": slices.slice_for("persistence_id"), "entity_type": slices.entity_type_of("persistence_id"), "db_timestamp": F.lit("2024-01-01 00:00:00+00:00").cast("timestamp"), "state_ser_id": F.lit(1), "state_payload": F.col("payload").cast("binary"), "tags": F.array(F.lit("old"))})
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in STATE.fields))


def test_state_writes(spark):
    old = states(spark, [("t|A", 1, "a"), ("t|B", 3, "b")])
    new = lambda *rows: spark.createDataFrame(rows, "persistence_id string, revision long, state_payload binary")
    got = {r.persistence_id: r for r in writes.next_states(old, new(("t|A", 2, b"x"), ("t|C", 1, b"c")), now=T0).withColumn("us", F.unix_micros("db_timestamp")).collect()}
    assert (got["t|A"].revision, got["t|B"].revision, got["t|C"].revision) == (2, 3, 1) and got["t|A"].us == 1704067200_000_001
    for bad in (("t|A", 1, b""), ("t|A", 3, b""), ("t|Z", 2, b"")):
        with pytest.raises(writes.Conflict):
            writes.next_states(old, new(bad))
    gone = spark.createDataFrame([("t|A", 2), ("t|B", 0), ("t|N", 1)], "persistence_id string, revision long")
    left = writes.deleted_states(old, gone)
    assert {(r.persistence_id, r.revision, r.state_ser_id) for r in left.collect()} == {("t|A", 2, 0), ("t|N", 1, 0)}
    assert left.where("persistence_id = 't|A'").first().tags == ["old"]
    assert tuple(state.get_state(left, "t|A").first()) == (None, 2) and tuple(state.get_state(left, "t|Q").first()) == (None, 0)
    kept = writes.next_states(old.withColumn("title", F.lit("keep")), new(("t|A", 2, b"x")), additional={"title": lambda c: c})
    assert kept.where("persistence_id = 't|A'").first().title == "keep"
    told = writes.change_events(left, events(spark, [("t|A", 4, 1)]), F.lit("changed"))
    assert {(r.persistence_id, r.seq_nr) for r in told.collect()} == {("t|A", 5), ("t|N", 1)}


def test_change_events_take_the_last_event_by_aggregate(spark):
    old = events(spark, [("t|A", 1, 0), ("t|A", 2, 90), ("t|A", 3, 50), ("t|B", 1, 1)])
    changed = spark.createDataFrame([("t|A", 9), ("t|B", 2), ("t|N", 1), ("t|H", 0)], "persistence_id string, revision long")
    told = writes.change_events(changed, old, F.lit("changed"), at(10))
    micro = dt.timedelta(microseconds=1)
    assert {(r.persistence_id, r.seq_nr, r.t) for r in told.withColumn("t", zoneless("db_timestamp")).collect()} == {("t|A", 4, at(50) + micro), ("t|B", 2, at(10)), ("t|N", 1, at(10))}
    with pytest.raises(writes.Conflict):
        writes.change_events(changed.union(changed), old, F.lit("changed"))
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1, "the journal is joined once, by id, not row by row"


def test_cleanup(spark):
    old = events(spark, [("t|A", i, i) for i in range(1, 48)] + [("t|B", 1, 1)])
    to = lambda n: spark.createDataFrame([("t|A", n)], "persistence_id string, to_seq_nr long")
    got = cleanup.without_events_to(old, to(cleanup.ALL)).where("persistence_id = 't|A'").collect()
    assert [(r.seq_nr, r.deleted) for r in got] == [(47, True)]
    assert journal.highest_seq_nr(cleanup.without_events_to(old, to(50)), "t|A").first()[0] == 50
    assert cleanup.without_events_to(old, to(cleanup.ALL), reset=True).where("persistence_id = 't|A'").count() == 0
    assert cleanup.without_events_to(old, to(40)).where("persistence_id = 't|A' and not deleted").count() == 7
    kept = cleanup.without_events_before_snapshots(old, snaps(spark, [("t|A", 45)])).where("persistence_id = 't|A'").collect()
    assert sorted((r.seq_nr, r.deleted) for r in kept) == [(45, True), (46, False), (47, False)]
    j, s = cleanup.without_everything(old, snaps(spark, [("t|A", 45)]), spark.createDataFrame([("t|A",)], "persistence_id string"), reset=True)
    assert j.count() == 1 and s.count() == 0
    assert len(cleanup.deletion_batches(1, 47, 10)) == 5 and cleanup.deletion_batches(3, 7, 10) == [(1, 7)]


def test_migration_is_idempotent(spark):
    source, target = events(spark, [("t|A", i, i) for i in range(1, 6)]), events(spark, [("t|A", 2, 2)])
    progress = spark.createDataFrame([], PROGRESS)
    first = migrate.events_to_migrate(source, target, progress)
    assert sorted(r.seq_nr for r in first.collect()) == [1, 3, 4, 5]
    after = migrate.progressed(progress, source, snaps(spark, [("t|A", 4)]))
    assert tuple(after.first()) == ("t|A", 5, 4, None)
    assert migrate.events_to_migrate(source, target, after).count() == 0
    assert migrate.snapshots_to_migrate(snaps(spark, [("t|A", 4), ("t|A", 3), ("t|B", 1)]), after).count() == 1
    assert migrate.states_to_migrate(states(spark, [("t|A", 1, "a")]), after).count() == 1
