"""The store, its manifest, and what is left after crashes."""

import pytest
from pyspark.sql import functions as F

from rillstore.operators import kv
from rillstore.plans.manifest import Conflict, Manifest
from rillstore.plans.ordinals import numbered
from rillstore.plans import ordinals
from rillstore.plans.store import Store


def batch(spark, rows):
    return spark.createDataFrame(rows, "key binary, value binary")


def content(df):
    return {bytes(r.key): bytes(r.value) for r in df.collect()}


def test_set_get_range_scan(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.scan().count() == 0 and store.get(b"a").first().found is False
    store.set_all(batch(spark, [(b"a", b"value-a"), (b"b", b"value-b"), (b"c", b"")]))
    store.set_all(batch(spark, [(b"a", b"newer"), (b"\xff", b"last")]))
    hit, miss = store.get(b"a").first(), store.get(b"zz").first()
    assert (hit.found, bytes(hit.value)) == (True, b"newer") and (miss.found, miss.value) == (False, None)
    assert content(store.scan()) == {b"a": b"newer", b"b": b"value-b", b"c": b"", b"\xff": b"last"}
    assert set(content(store.range(F.lit(b"b"), F.lit(b"c")))) == {b"b", b"c"}
    assert store.range(F.lit(b"c"), F.lit(b"b")).count() == 0
    probes = spark.createDataFrame([(b"b",), (b"no",), (b"b",)], "key binary")
    assert {(bytes(r.key), r.found) for r in store.multi_get(probes).collect()} == {(b"b", True), (b"no", False)}


def test_reopen_keeps_everything(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    first = Store(spark, path)
    first.set_all(batch(spark, [(n.to_bytes(8, "big"), n.to_bytes(8, "big")) for n in range(3000)]))
    first.close()
    with pytest.raises(ValueError):
        first.get(b"a")
    again = Store(spark, path)
    again.set_all(batch(spark, [((5).to_bytes(8, "big"), b"new")]))
    got = content(Store(spark, path).scan())
    assert len(got) == 3000 and got[(5).to_bytes(8, "big")] == b"new"


def test_compaction_versions_and_vacuum(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    versions = [store.set_all(batch(spark, [(b"k", str(i).encode()), (str(i).encode(), b"x")])) for i in range(4)]
    before = content(store.scan())
    store.compact()
    assert content(store.scan()) == before and store.entries().count() == 5
    assert content(store.scan(versions[1]))[b"k"] == b"1"
    assert len(store.vacuum()) == 4
    assert content(store.scan()) == before


def test_a_tag_counts_once(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    for _ in range(3):
        store.set_all(batch(spark, [(b"a", b"1")]), tag="batch-1")
    assert store.entries().count() == 1
    store.set_all(batch(spark, [(b"a", b"2")]), tag="batch-2")
    store.compact()
    store.manifest.checkpoint()
    store.set_all(batch(spark, [(b"a", b"1")]), tag="batch-1")
    assert content(store.scan()) == {b"a": b"2"}


def test_unfinished_write_is_invisible(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.set_all(batch(spark, [(b"a", b"1")]))
    store._write(batch(spark, [(b"b", b"2")]).withColumn("seq", F.lit(9)).select("key", "seq", "value"), 1)  # the writer dies before its commit
    assert set(content(Store(spark, store.path).scan())) == {b"a"}
    assert len(store.vacuum()) == 1


def test_writers_conflict_and_retry(spark, tmp_path):
    log = Manifest(spark, f"file://{tmp_path}/log")
    log.write(0, [{"action": "add", "file": "a"}])
    with pytest.raises(Conflict):
        log.write(0, [{"action": "add", "file": "b"}])
    calls = []

    def make(known):
        calls.append(sorted(known))
        if len(calls) == 1:
            log.write(1, [{"action": "add", "file": "other"}])  # another writer comes first
        return [{"action": "add", "file": "mine"}]

    log.commit(make)
    assert calls == [["a"], ["a", "other"]] and set(log.state()[1]) == {"a", "other", "mine"}


def test_checkpoints_and_corruption(spark, tmp_path):
    log = Manifest(spark, f"file://{tmp_path}/log", checkpoint_every=5)
    for i in range(12):
        log.commit(lambda known, i=i: [{"action": "add", "file": f"f{i}"}] + ([{"action": "remove", "file": f"f{i - 1}"}] if i % 2 else []))
    assert set(log.state()[1]) == {f"f{i}" for i in range(12) if i % 2}
    assert any(a["action"] == "checkpoint" for v in log.versions() for a in log.read(v))
    assert set(log.state(1)[1]) == {"f1"}
    last = log.versions()[-1] + 1
    (tmp_path / "log" / f"{last:020d}.json").write_text('{"action": "ad')
    with pytest.raises(ValueError, match="corrupt"):
        log.state()


def test_sample_of_100_000_keys(spark, tmp_path):
    """All keys of a store that was closed are there when it is opened again."""
    store = Store(spark, f"file://{tmp_path}/s")
    key = kv.binary_key(F.col("id"))
    store.set_all(spark.range(100_000).select(key.alias("key"), key.alias("value")))
    store.close()
    again = Store(spark, store.path)
    expected = spark.range(100_000).select(key.alias("key"), key.alias("value"))
    assert kv.probe_misses(again.entries(), expected).first()[:] == (100_000, 0)


def test_point_reads_are_pushed_down(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.set_all(batch(spark, [(b"a", b"1"), (b"b", b"2")]))
    plan = store.get(b"a")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key" in plan
    plan = store.range(F.lit(b"a"), F.lit(b"b"))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key" in plan and "LessThanOrEqual(key" in plan


@pytest.mark.parametrize("kind", ["bigint", "string", "binary"])
def test_sliced_ordinals(spark, monkeypatch, kind):
    df = spark.range(5000).selectExpr("id % 3 AS g", f"cast({'unhex(lpad(hex(id * 7), 8, chr(48)))' if kind == 'binary' else 'id * 7'} AS {kind}) AS k")
    if kind == "string":  # a long common prefix, and a group that is null
        df = df.selectExpr("if(g = 2, null, g) AS g", "concat('user-00000000', lpad(k, 8, '0')) AS k")
    want = sorted(map(tuple, numbered(df, ["k"], ["g"]).collect()), key=repr)
    whole = sorted(map(tuple, numbered(df, ["k"]).collect()), key=repr)
    monkeypatch.setattr(ordinals, "ROWS_A_TASK", 300)
    assert sorted(map(tuple, numbered(df, ["k"], ["g"]).collect()), key=repr) == want
    assert sorted(map(tuple, numbered(df, ["k"]).collect()), key=repr) == whole


def test_prefix_ends():
    assert kv.next_prefix(b"a\xff") == b"b" and kv.next_prefix(b"\xff\xff") is None and kv.next_prefix(b"ab") == b"ac"


def test_two_writers_never_share_a_number(spark, tmp_path, monkeypatch):
    """Another writer commits between this one's write and its commit: the one that commits last is the latest."""
    one, two = Store(spark, f"file://{tmp_path}/s"), Store(spark, f"file://{tmp_path}/s")
    one.set_all(batch(spark, [(b"k", b"first")]))
    plain, calls = Manifest.commit, []

    def commit(self, make, tries=20):
        if not calls:
            calls.append(1)
            two.set_all(batch(spark, [(b"k", b"second")]))
        return plain(self, make, tries)

    monkeypatch.setattr(Manifest, "commit", commit)
    one.set_all(batch(spark, [(b"k", b"third"), (b"k2", b"x")]))
    found = [(r.seq, bytes(r.value)) for r in one.entries().where(F.col("key") == F.lit(b"k")).collect()]
    assert len({s for s, _ in found}) == 3 and content(one.scan())[b"k"] == b"third"
    one.compact()
    one.set_all(batch(spark, [(b"k", b"fourth")]))
    assert content(one.scan()) == {b"k": b"fourth", b"k2": b"x"}


def test_reads_open_only_runs_that_may_hold_the_keys(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    for low in (0, 100, 200):
        store.set_all(batch(spark, [((low + i).to_bytes(8, "big"), b"v") for i in range(50)]))
    files = lambda df: len({f.rsplit("/", 2)[1] for f in df.inputFiles()})
    at = lambda n: n.to_bytes(8, "big")
    assert files(store.entries()) == 3 and files(store.entries(low=at(120), high=at(120))) == 1
    assert store.get(at(120)).first().found and not store.get(at(170)).first().found
    assert store.range(at(140), at(209)).count() == 20 and store.range(at(60), at(90)).count() == 0


def test_no_half_written_commit(spark, tmp_path):
    log = Manifest(spark, f"file://{tmp_path}/log")
    log.write(0, [{"action": "add", "file": "a"}])
    with pytest.raises(Conflict):
        log.write(0, [{"action": "add", "file": "b"}])
    assert log.read(0) == [{"action": "add", "file": "a"}] and log.versions() == [0]
    assert [f.name for f in (tmp_path / "log").iterdir() if "draft" in f.name] == []
