"""Streams, ingest, runs and the readers of flat files."""

import pytest
from pyspark.sql import functions as F

from rillstore.operators import kv, runs, streams
from rillstore.sources import flat_files
from rillstore.streaming.ingest import EventLog, ingest, lengths_by_window

RECORDS = [("object-1", 0, "info", '{"Message":"event-11"}'), ("object-2", 1, "info", '{"Message":"event-21"}'), ("object-1", 2, "info", '{"Message":"event-12"}'), ("object-2", 3, "info", '{"Message":"event-22"}'), ("object-10", 4, "info", '{"Message":"x"}')]
SCHEMA = "stream string, seq bigint, type string, data string"


def test_sample_streams(spark):
    log = streams.append(spark.createDataFrame(RECORDS, SCHEMA))
    own = streams.read(log, "object-1").orderBy("n").select(streams.payload(F.col("data"), "Message string")["Message"]).collect()
    assert [r[0] for r in own] == ["event-11", "event-12"]
    assert {r.stream: r.length for r in streams.lengths(log).collect()} == {"object-1": 2, "object-2": 2, "object-10": 1}
    names = spark.createDataFrame([("object-1",), ("object-11",)], "stream string")
    assert {r.stream: r.exists for r in streams.exists(log, names).collect()} == {"object-1": True, "object-11": False}
    assert [r.place for r in streams.everything(log).orderBy("seq").collect()] == list(range(5))


def test_ordinals_go_on_after_a_restart(spark, tmp_path):
    base = f"file://{tmp_path}"
    for step in range(3):
        rows = [(f"s{i % 3}", step * 100 + i, "t", "{}") for i in range(30 + step)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
        arrived = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        ingest(arrived, EventLog(spark, f"{base}/log"), f"{base}/checkpoint").awaitTermination()
    log = EventLog(spark, f"{base}/log").read()
    by_stream = {}
    for r in log.orderBy("stream", "n").collect():
        by_stream.setdefault(r.stream, []).append((r.n, r.seq))
    for own in by_stream.values():
        assert [n for n, _ in own] == list(range(len(own))) and [s for _, s in own] == sorted(s for _, s in own)
    assert sum(map(len, by_stream.values())) == 30 + 31 + 32


def test_a_batch_counts_once(spark, tmp_path):
    log = EventLog(spark, f"file://{tmp_path}/log")
    for _ in range(2):
        log.append(spark.createDataFrame(RECORDS, SCHEMA), "ingest-0")
    assert log.read().count() == 5


def test_lengths_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("rillstore.streaming.ingest.MERGE_ENDS", 2)
    log = EventLog(spark, f"file://{tmp_path}/log")
    for i in range(5):
        log.append(spark.createDataFrame([(f"s{i % 2}", i, "t", "{}"), ("every", 100 + i, "t", "{}")], SCHEMA), f"b-{i}")
    assert {r.stream: r.length for r in log.ends(log.manifest.state()[1]).collect()} == {"s0": 3, "s1": 2, "every": 5}
    assert sorted(r.n for r in log.read().where("stream = 'every'").collect()) == list(range(5))
    assert sum(a["kind"] == "ends" for a in log.manifest.state()[1].values()) < 4


def test_records_are_merged(spark, tmp_path):
    log = EventLog(spark, f"file://{tmp_path}/log")
    for i in range(4):
        log.append(spark.createDataFrame([("a", 10 * i + j, "t", "{}") for j in range(3)], SCHEMA), f"b-{i}")
    before = sorted(map(tuple, log.read().collect()))
    log.merge()
    assert sorted(map(tuple, log.read().collect())) == before and len(log._files(log.manifest.state()[1], "records")) == 1
    log.append(spark.createDataFrame([("a", 99, "t", "{}")], SCHEMA), "b-4")
    assert sorted(r.n for r in log.read().collect()) == list(range(13))


def test_windows_of_event_time(spark, tmp_path):
    rows = spark.sql("SELECT 'a' AS stream, timestamp'2024-01-01 01:00:00' + make_interval(0, 0, 0, cast(id AS int)) AS ts FROM range(3)")
    rows.write.parquet(f"file://{tmp_path}/in")
    out = lengths_by_window(spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in"))
    q = out.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.records for r in spark.sql("SELECT records FROM windows ORDER BY window.start").collect()] == [1, 1, 1]


def fold(sizes, capacity, over):
    run = held = 0
    out = []
    for s in sizes:
        if held > capacity or (not over and held >= capacity):
            run, held = run + 1, 0
        out.append(run)
        held += s
    return out


@pytest.mark.parametrize("over", [True, False])
def test_runs_of_varying_sizes(spark, over):
    sizes = [(s, n, (n * 37 + s) % 50 + 1) for s in range(3) for n in range(500)]
    got = runs.fold_runs(spark.createDataFrame(sizes, "shard int, seq int, size int"), 100, over).orderBy("shard", "seq").collect()
    assert [r.run for r in got] == [x for s in range(3) for x in fold([z for a, _, z in sizes if a == s], 100, over)]


def test_closed_forms():
    assert runs.entries_a_run(16) == 1025 and runs.entries_a_block(18) == 228
    assert fold([16] * 3000, 16384, True).count(0) == 1025 and fold([18] * 3000, 4096, False).count(0) == 228


def varint(n):
    out = b""
    while n >= 128:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def framed(b):
    return varint(len(b)) + b


def table_file(entries, block=4096):
    data = index = b""
    held, start = b"", 0
    for i, (k, v) in enumerate(entries):
        held += framed(k) + framed(v)
        if len(held) >= block or i == len(entries) - 1:
            index += framed(k) + framed(start.to_bytes(8, "little") + len(held).to_bytes(8, "little"))
            data, start, held = data + held, start + len(held), b""
    footer = framed(bytes(4096)) + framed(entries[0][0] if entries else b"") + framed(entries[-1][0] if entries else b"") + start.to_bytes(8, "little") + len(index).to_bytes(8, "little")
    return data + index + footer + len(footer).to_bytes(4, "little")


def test_flat_files(spark, tmp_path):
    entries = [(n.to_bytes(8, "big"), n.to_bytes(8, "little")) for n in range(1025)]
    raw = table_file(entries)
    assert len(raw) == 22_716  # 18,450 data, 130 index, 4,136 footer
    (tmp_path / "000001.olog").write_bytes(raw)
    (tmp_path / "000002.olog").write_bytes(table_file([(entries[3][0], b"new")]))
    (tmp_path / "000003.olog").write_bytes(table_file([]))
    got = flat_files.read_entries(spark, f"file://{tmp_path}")
    assert [(bytes(r.key), bytes(r.value)) for r in got.where("number = 1").orderBy("place").collect()] == entries
    last = kv.latest(got.withColumn("seq", F.col("number") * 1_000_000 + F.col("place"))).collect()
    assert len(last) == 1025 and {bytes(r.key): bytes(r.value) for r in last}[entries[3][0]] == b"new"
    log = b"".join(framed(framed(k) + framed(v)) for k, v in entries[:5])
    (tmp_path / "000004.ulog").write_bytes(log[:-3])  # cut off by a crash
    assert flat_files.read_entries(spark, f"file://{tmp_path}", "log").count() == 4


def test_flat_manifests(spark, tmp_path):
    ids = lambda *x: varint(len(x)) + b"".join(varint(k) + varint(n) for k, n in x)
    frames = [ids() + ids() + ids((3, 1)) + ids((2, 2)), ids((3, 1)) + ids() + ids((3, 300)) + ids()]
    (tmp_path / "000001.manifest").write_bytes(b"".join(map(framed, frames)))
    got = flat_files.read_manifests(spark, f"file://{tmp_path}")
    from rillstore.plans.manifest import replay
    left = replay(got.where("kind = 'table'").select("version", "file", "is_add")).collect()
    assert [r.file for r in left] == [300] and got.count() == 4
    (tmp_path / "000002.manifest").write_bytes(framed(ids() + ids() + ids((3, 7)) + ids()))
    assert [r.file for r in flat_files.read_manifests(spark, f"file://{tmp_path}").collect()] == [7]
    assert flat_files.read_manifests(spark, f"file://{tmp_path}", highest=False).count() == 5
