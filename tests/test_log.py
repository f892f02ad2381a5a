import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import compaction, reads, requests, segments, views
from tidelog.schema import RECORD
from tidelog.sources import raw
from tidelog.store import Store
from tidelog.streaming.index import append_once, read_segments, streaming_live, streaming_replay


def random_log(n, seed=1, keys=12):
    r = random.Random(seed)
    return [(i, f"k{r.randrange(keys)}", None if (op := r.choice(["put", "put", "batch", "delete"])) == "delete" else r.randbytes(r.randrange(30)), r.randrange(50), op) for i in range(n)]


def sequential(rows):
    """The three folds, one operation at a time; and bytes counted dead by place."""
    online, replay, dead, size = {}, {}, {}, {}
    for seq, key, value, ts, op in rows:
        size[seq] = 20 + len(key) + len(value or b"")
        if op != "batch" and key in online:
            dead[online[key][0]] = size[online[key][0]]
        if op == "delete":
            online.pop(key, None)
            replay.pop(key, None)
        else:
            online[key] = (seq, value)
            if key not in replay or ts >= replay[key][1]:
                replay[key] = (seq, ts, value)
    return online, replay, dead


@pytest.mark.parametrize("seed", [1, 2])
def test_views_against_a_sequential_fold(spark, seed):
    rows = random_log(400, seed)
    log = spark.createDataFrame(rows, RECORD)
    online, replay, dead = sequential(rows)
    assert {r.key: (r.seq, bytes(r.value)) for r in views.live_online(log).collect()} == online
    assert {r.key: (r.seq, r.ts, bytes(r.value)) for r in views.live_replay(log).collect()} == replay
    assert {r.key: (r.seq, bytes(r.value)) for r in views.live_as_of(log, 150).collect()} == sequential(rows[:151])[0]
    counted = segments.dead_rows(views.sized(log)).where("counted").select("seq", "record_size").collect()
    assert {r.seq: r.record_size for r in counted} == dead


def test_rotation_is_greedy_and_compaction_keeps_the_live_rows(spark):
    rows = random_log(300, 3)
    log = spark.createDataFrame(rows, RECORD)
    seg = segments.rotate(log, 200).cache()
    at, file, want = 0, 1, {}
    for seq, key, value, _, _ in rows:
        n = 20 + len(key) + len(value or b"")
        if at + n > 200:
            at, file = 0, file + 1
        want[seq] = (f"{file:010d}", at)
        at += n
    assert {r.seq: (r.file_id, r.offset) for r in seg.collect()} == want
    huge = segments.rotate(spark.createDataFrame([(0, "k", bytes(500), 1, "put"), (1, "k", b"x", 1, "put")], RECORD), 100)
    assert [(r.file_id, r.offset) for r in huge.orderBy("seq").collect()] == [("0000000002", 0), ("0000000003", 0)]
    active = f"{file:010d}"
    once = compaction.compact(seg, active, file + 1)
    live = {r.key: r.seq for r in views.live_online(log).collect()}
    assert {r.key: r.seq for r in views.live_online(once).collect()} == live
    places = [(r.file_id, r.offset) for r in once.collect()]
    assert len(set(places)) == len(places)
    twice = compaction.compact(once, active, file + 2)
    assert {r.key: r.seq for r in views.live_online(twice).collect()} == live
    assert once.where(F.col("file_id") != active).where("op = 'delete'").count() == 0
    # a key merged and then deleted later stays deleted
    gone = spark.createDataFrame([(1000, next(iter(live)), None, 0, "delete")], RECORD)
    assert next(iter(live)) not in {r.key for r in views.live_online(once.select(log.columns).unionByName(gone)).collect()}


def test_ranges(spark):
    live = spark.createDataFrame([(k, b"v") for k in ["a", "b", "c", "\U0001f680", "�"]], "key string, value binary")
    assert [r.key for r in reads.range_scan(live, "a", "b").collect()] == ["a", "b"]
    assert [r.key for r in reads.range_scan(live, "x", "\U0010ffff").collect()] == ["�", "\U0001f680"]
    assert [r.key for r in reads.range_scan(live, "x", "￿", utf16=True).collect()] == ["\U0001f680", "�"]
    with pytest.raises(ValueError, match="behind"):
        reads.range_scan(live, "c", "a")


def test_requests_against_one_by_one(spark):
    r = random.Random(8)
    rows, state, gets, ranges = [], {}, {}, set()
    for seq in range(400):
        op, key = r.choice(["put", "get", "delete", "range", "put"]), f"key{r.randrange(20):02d}"
        end = f"key{r.randrange(20):02d}" if r.random() < 0.8 else "l"
        value = r.randbytes(3) if op == "put" else None
        rows.append((seq, op, key, end if op == "range" else None, value))
        if op == "put":
            state[key] = value
        elif op == "delete":
            state.pop(key, None)
        elif op == "get":
            gets[seq] = state.get(key)
        elif key <= end:
            ranges |= {(seq, k, v) for k, v in state.items() if key <= k <= end}
    df = spark.createDataFrame(rows, "seq long, op string, key string, end_key string, value binary")
    got = requests.answer_gets(df).collect()
    assert {x.seq: x.value and bytes(x.value) for x in got} == gets and all((x.status == "ok") == (x.value is not None) for x in got)
    for width in (2, 4, 5):
        assert {(x.seq, x.key, bytes(x.value)) for x in requests.answer_ranges(df, width).collect()} == ranges
    status = {x.seq: x.status for x in requests.answer_status(df.unionByName(df.limit(1).selectExpr("999L as seq", "'noop' as op", "key", "end_key", "value"))).collect()}
    assert status[999] == "error" and len(status) == 401


def test_raw_files_round_trip_and_damage(spark, tmp_path):
    rows = random_log(200, 5)
    seg = segments.rotate(spark.createDataFrame(rows, RECORD), 400)
    path = str(tmp_path / "raw")
    raw.write_log(seg, path)
    back = raw.read_log(spark, path, strict="true").orderBy("file_id", "offset").collect()
    assert [(r.key, bytes(r.value), r.tombstone) for r in back] == [(k, v or b"", op == "delete") for _, k, v, _, op in rows]
    want = sequential(rows)[1]
    index, found = raw.recover(spark, path)
    assert found and {r.key: r.ts for r in index.collect()} == {k: ts for k, (_, ts, _) in want.items()}
    keydir = views.keydir(seg)
    raw.write_hints(keydir, path)
    hints = {(r.key, r.ts, r.offset, r.value_size, r.file_id) for r in raw.read_hints(spark, path).collect()}
    assert hints == {(r.key, r.ts, r.offset, r.value_size, r.file_id) for r in keydir.collect()}
    # damage in the middle of a file that isn't the last: its rest is lost, the others stay
    names = sorted(p.name for p in (tmp_path / "raw").glob("*.data"))
    victim = tmp_path / "raw" / names[2]
    data = bytearray(victim.read_bytes())
    second = next(r.offset for r in back if r.file_id == names[2][:-5] and r.offset)
    data[second + 25] ^= 0xFF
    victim.write_bytes(data)
    (tmp_path / "raw" / names[-1]).open("ab").write(b"torn..!")
    after = raw.read_log(spark, path).collect()
    lost = [r for r in back if r.file_id == names[2][:-5] and r.offset >= second]
    assert len(after) == len(back) - len(lost)
    ends = raw.read_log(spark, path, all="true").where("corrupt_reason is not null").collect()
    assert sorted(r.corrupt_reason for r in ends) == ["checksum", "truncated"]
    with pytest.raises(Exception, match="checksum|truncated"):
        raw.read_log(spark, path, strict="true").collect()


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.put("a", b"1")
    s.put("a", b"2")
    s.put("empty", b"")
    s.delete("never there")
    s.batch_put(["b", "c", "b"], [b"x", b"y", b"z"])
    assert (s.get("a"), s.get("b"), s.get("empty"), s.get("nope")) == (b"2", b"z", b"", None)
    with pytest.raises(ValueError, match="differ"):
        s.batch_put(["a"], [])
    with pytest.raises(ValueError, match="needed"):
        s.put(None, b"")
    before = s.snapshot()
    again = Store(spark, str(tmp_path / "s"))
    s.delete("b")
    assert [r.key for r in s.range("a", "c").collect()] == ["a", "c"] and s.size() == 3
    assert {r.key for r in before.collect()} == {"a", "b", "c", "empty"}
    reopened = Store(spark, str(tmp_path / "s"))
    assert reopened.get("a") == b"2" and not reopened.exists("b")
    freed = reopened.compact()
    assert freed["gross"] > freed["net"] > 0
    # readers opened before keep their files until a vacuum
    assert {r.key for r in before.collect()} == {"a", "b", "c", "empty"} and again.get("b") == b"z"
    assert reopened.vacuum() == 0 and reopened.vacuum(grace_sec=-1) >= 1
    assert {r.key: bytes(r.value) for r in Store(spark, str(tmp_path / "s")).live().collect()} == {"a": b"2", "c": b"y", "empty": b""}
    reopened.put("b", b"again")
    assert reopened.compact()["net"] == 0 and reopened.get("b") == b"again"
    with pytest.raises(RuntimeError, match="another writer"):
        s.put("late", b"w")
        s.flush()


def test_acknowledged_writes_survive_a_lost_writer(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.put("a", b"1")
    s.batch_put(["b", "a"], [b"2", b"3"])
    s.delete("b")
    del s  # without flush or close
    t = Store(spark, str(tmp_path / "s"))
    assert (t.get("a"), t.get("b")) == (b"3", None) and t.log().count() == 4
    assert not list((tmp_path / "s/pending").glob("*.json"))
    t.put("c", b"")
    u = Store(spark, str(tmp_path / "s"))
    assert {r.key for r in u.live().collect()} == {"a", "c"}
    assert u.should_compact() is False or u.maybe_compact()["gross"] > 0


def test_recovered_store_and_positional_reads(spark, tmp_path):
    rows = random_log(120, 9)
    seg = segments.rotate(spark.createDataFrame(rows, RECORD), 300)
    path = str(tmp_path / "raw")
    raw.write_log(seg, path)
    (tmp_path / "raw" / ".0000000001-leftover.data").write_bytes((tmp_path / "raw" / "0000000001.data").read_bytes())
    assert raw.read_log(spark, path).count() == 120  # a leftover is no data
    want = {k: (ts, v) for k, (_, ts, v) in sequential(rows)[1].items()}
    store = Store.recovered(spark, str(tmp_path / "store"), path)
    assert {r.key: (r.ts, bytes(r.value)) for r in store.live().collect()} == want
    store.put("new", b"n")
    assert store.get("new") == b"n" and store.size() == len(want) + 1
    (tmp_path / "no-files").mkdir()
    assert Store.recovered(spark, str(tmp_path / "none"), str(tmp_path / "no-files")).size() == 0
    places = seg.select("file_id", "offset", "record_size", "seq")
    got = raw.read_at(places, path).collect()
    assert all(len(r.bytes) == r.record_size for r in got) and len(got) == 120
    missing = spark.createDataFrame([("0000009999", 0, 5)], "file_id string, offset long, record_size long")
    assert raw.read_at(missing, path).first().bytes is None
    with pytest.raises(Exception, match="bytes at"):
        raw.read_at(spark.createDataFrame([("0000000001", 100_000, 5)], missing.schema), path).collect()


def test_damaged_sizes_ask_for_no_more_than_the_file_has(tmp_path):
    import io
    import struct

    data = struct.pack(">Iqii", 0, 1, 5, (1 << 31) - 100) + b"key"
    assert [x[6] for x in raw.walk_records(io.BytesIO(data), len(data))] == ["truncated"]


def test_sums_and_values_carried_over_blocks(spark):
    from tidelog.operators.ordered import carried, running_sum

    r = random.Random(2)
    rows = [(i, r.choice(["a", "b", None]), r.choice([None, f"v{i}"]), r.randrange(9)) for i in range(300)]
    df = spark.createDataFrame(rows, "seq long, key string, v string, n long")
    sums, last, want = {}, {}, {}
    for seq, k, v, n in rows:
        sums[k] = sums.get(k, 0) + n
        want[seq] = (sums[k], last.get(k))
        last[k] = v if v is not None else last.get(k)
    for block in (7, 1000):
        got = carried(running_sum(df, ["key"], "seq", "n", "s", block), ["key"], "seq", "v", "before", block).collect()
        assert {x.seq: (x.s, x.before) for x in got} == want
        behind = {x.seq: x.after for x in carried(df, ["key"], "seq", "v", "after", block, ahead=True).collect()}
        assert behind == {seq: next((v for s, k2, v, _ in rows[seq + 1 :] if k2 == k and v is not None), None) for seq, k, _, _ in rows}


def test_streaming_index_and_sink(spark, tmp_path):
    rows = random_log(120, 7)
    for i in range(3):
        spark.createDataFrame(rows[i * 40 : (i + 1) * 40], RECORD).coalesce(1).write.parquet(str(tmp_path / f"in/part{i}"))
    source = read_segments(spark, str(tmp_path / "in/*"), max_files=1)
    q = streaming_live(source).writeStream.format("memory").queryName("live_index").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.key: (r.seq, bytes(r.value)) for r in spark.table("live_index").where("op <> 'delete'").collect()}
    assert got == sequential(rows)[0]
    store = Store(spark, str(tmp_path / "store"))
    sink = append_once(store)
    batch = spark.createDataFrame(rows[:10], RECORD)
    sink(batch, 0)
    sink(batch, 0)
    assert store.log().count() == 10
    # a sink that compacts: batches of one key die as they come
    busy = Store(spark, str(tmp_path / "busy"))
    compacting = append_once(busy, "other", compact=True)
    for n in range(3):
        compacting(spark.createDataFrame([(i, "k", bytes([n, i]), n, "put") for i in range(4)], RECORD), n)
    compacting(spark.createDataFrame(rows[:1], RECORD), 1)  # an old number again
    assert busy.log().count() == 1 and busy.get("k") == bytes([2, 3]) and busy.manifest["commits"] == {"other": 2}


def test_streaming_replay_in_any_order(spark, tmp_path):
    """Late deletions strike what they were written behind; puts that were beaten by struck ones come back."""
    rows = [(5, "k", b"best", 100, "put"), (20, "k", b"low", 50, "put"), (10, "k", None, 0, "delete"), (1, "x", b"v", 1, "put"), (2, "x", None, 1, "delete"), (3, "y", b"a", 9, "put"), (4, "y", b"b", 9, "put"), *random_log(80, 4)]
    rows = [(i if k < 7 else i + 100, *r) for k, (i, *r) in enumerate(rows)]
    shuffled = random.Random(3).sample(rows, len(rows))
    shuffled.sort(key=lambda r: r[1] == "k" and r[0] == 10)  # the deletion comes last
    for i in range(3):
        part = shuffled[i * len(rows) // 3 : (i + 1) * len(rows) // 3]
        spark.createDataFrame(part, RECORD).coalesce(1).write.parquet(str(tmp_path / f"in/part{i}"))
    seen: dict = {}
    sink = lambda batch, n: seen.update({r.key: (r.seq, r.ts, r.value and bytes(r.value)) for r in batch.collect()})
    q = streaming_replay(read_segments(spark, str(tmp_path / "in/*"), max_files=1)).writeStream.foreachBatch(sink).outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {k: v for k, v in seen.items() if v[0] is not None} == sequential(sorted(rows))[1]
    assert seen["k"][0] == 20 and seen["x"][0] is None


def test_deletions_in_files_behind_the_active_one_outlive_compaction(spark):
    ops = [("f", "put", 1), ("gone", "put", 2), ("back", "put", 2), ("dead", "delete", 2), ("gone", "delete", 3), ("dead", "delete", 3), ("back", "delete", 3), ("back", "put", 4), ("f", "delete", 4)]
    log = spark.createDataFrame([(i, k, None if op == "delete" else b"v%d" % i, i, op) for i, (k, op, _) in enumerate(ops)], RECORD)
    files = spark.createDataFrame([(i, f"{n:010d}") for i, (_, _, n) in enumerate(ops)], "seq long, file_id string")
    seg = segments.with_offsets(views.sized(log.join(files, "seq")))
    active = f"{2:010d}"
    once = compaction.compact(seg, active, 9)
    assert {r.key for r in views.live_online(once).collect()} == {"back"}
    twice = compaction.compact(once, active, 10).collect()
    # only the deletion that stands before a record of the active file stays
    assert sorted((r.seq, r.op) for r in twice if r.file_id != active) == [(4, "delete"), (7, "put")]
    assert {r.seq for r in twice if r.file_id == active} == {1, 2, 3}


def test_an_append_makes_its_rows_once(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()

    def note(batches):
        import tempfile

        for batch in batches:
            tempfile.mkstemp(dir=seen)
            yield batch

    rows = spark.createDataFrame(random_log(20, 5), RECORD).coalesce(1).mapInArrow(note, RECORD)
    s = Store(spark, str(tmp_path / "s"))
    assert s.append(rows) and len(list(seen.iterdir())) == 1
    assert s.append(rows.where("seq >= 5")) and s.manifest["next_seq"] == 40 and s.log().agg(F.max("seq")).first()[0] == 39
    assert not s.append(rows.where("false")) and len(s.manifest["segments"]) == len(list((tmp_path / "s").glob("segment-*"))) == 2


def test_small_files_share_a_task(spark, tmp_path):
    path = str(tmp_path / "raw")
    raw.write_log(segments.rotate(spark.createDataFrame(random_log(120, 8), RECORD), 60), path)
    back = raw.read_log(spark, path, strict="true")
    assert len(raw.names_in(path, ".data")) > 40 and back.rdd.getNumPartitions() == 1
    assert back.count() == 120 and back.select("file_id").distinct().count() == len(raw.names_in(path, ".data"))
    many = [(f"{i:010d}.data", 100_000) for i in range(100_000)]
    dealt = raw.bundles([*many, ("large.data", 1 << 40), ("last.data", 1)])
    assert [n for names in dealt for n in names] == [n for n, _ in many] + ["large.data", "last.data"]
    assert ["large.data"] in dealt and ["last.data"] in dealt and max(map(len, dealt)) * 100_000 <= raw.MOST
    assert len(raw.bundles(many)) <= raw.PARTITIONS + 1 and raw.bundles([]) == []


def test_a_replay_walks_the_files_once(spark, tmp_path):
    rows = random_log(120, 11)
    path = tmp_path / "raw"
    raw.write_log(segments.rotate(spark.createDataFrame(rows, RECORD), 300), str(path))
    sizes = {(r.key, r.value_size) for r in raw.read_log(spark, str(path), values="false").where("not tombstone").collect()}
    index, found = raw.recover(spark, str(path))
    for p in path.iterdir():  # what was walked is kept, so the index asks for no file again
        p.unlink()
    want = {k: (ts, len(v)) for k, (_, ts, v) in sequential(rows)[1].items()}
    assert found and {r.key: (r.ts, r.value_size) for r in index.collect()} == want
    assert sizes == {(key, len(value)) for _, key, value, _, op in rows if op != "delete"}


def test_streaming_replay_keeps_many_keys_in_a_state_row(spark, tmp_path):
    rows = [*random_log(150, 12, keys=40), (200, "none", None, 5, "put"), (201, "none", b"late", 4, "put")]
    shuffled = random.Random(5).sample(rows, len(rows))
    for i in range(3):
        spark.createDataFrame(shuffled[i * 60 : (i + 1) * 60], RECORD).coalesce(1).write.parquet(str(tmp_path / f"in/part{i}"))
    seen: dict = {}
    sink = lambda batch, n: seen.update({r.key: (r.seq, r.ts, r.value and bytes(r.value)) for r in batch.collect()})
    live = streaming_replay(read_segments(spark, str(tmp_path / "in/*"), max_files=1), buckets=3)
    q = live.writeStream.foreachBatch(sink).outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    want = sequential(rows[:-2])[1] | {"none": (200, 5, None)}  # a put without a value is a put
    assert {k: v for k, v in seen.items() if v[0] is not None} == want and len(seen) > 30
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) <= 3
