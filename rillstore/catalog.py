"""The queries of the key-value store and the event streams, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import codec
from .operators import kv, runs, streams
from .plans import manifest
from .plans.ordinals import numbered
from .plans.shared import folder
from .plans.store import Store
from .sources.tables import arriving, event_values, log, table, user_values
from .streaming.ingest import EventLog, ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


LATEST = "SELECT user_id AS key, arg_max(value, event_id) AS value, max(event_id) AS seq, count(*) AS versions FROM events GROUP BY user_id"


@query(LATEST)
def kv_latest(spark, d):
    return kv.latest(user_values(spark, d))


@query("SELECT CAST(7 AS BIGINT) AS key, count(*) > 0 AS found, arg_max(value, event_id) AS value FROM events WHERE user_id = 7")
def kv_get_hit(spark, d):
    return kv.get(user_values(spark, d), 7).withColumn("key", F.col("key").cast("long"))


@query("SELECT CAST(-1 AS BIGINT) AS key, count(*) > 0 AS found, arg_max(value, event_id) AS value FROM events WHERE user_id = -1")
def kv_get_miss(spark, d):
    return kv.get(user_values(spark, d), -1).withColumn("key", F.col("key").cast("long"))


@query(f"SELECT p.key, l.key IS NOT NULL AS found, l.value FROM (SELECT DISTINCT n_nationkey * 11 AS key FROM nation) p LEFT JOIN ({LATEST}) l ON p.key = l.key")
def kv_multi_get(spark, d):
    return kv.multi_get(user_values(spark, d), table(spark, d, "nation").select((F.col("n_nationkey") * 11).alias("key")))


@query(f"SELECT key, value, row_number() OVER (ORDER BY key) AS rn FROM ({LATEST}) WHERE key BETWEEN 10 AND 60")
def kv_range(spark, d):
    return kv.ordered(kv.between(user_values(spark, d), F.lit(10), F.lit(60)), "value")


@query("SELECT lower(hex(k)) AS key_hex, value, row_number() OVER (ORDER BY k) AS rn FROM (SELECT unhex(lpad(hex(event_id), 16, '0')) AS k, value FROM events) WHERE k BETWEEN unhex(lpad(hex(100), 16, '0')) AND unhex(lpad(hex(700), 16, '0'))")
def kv_range_binary_key(spark, d):
    own = event_values(spark, d).withColumn("key", kv.binary_key(F.col("key")))
    found = kv.between(own, kv.binary_key(F.lit(100)), kv.binary_key(F.lit(700)))
    return kv.ordered(found, "value").select(F.lower(F.hex("key")).alias("key_hex"), "value", "rn")


@query("SELECT count(*) AS entries FROM events WHERE user_id BETWEEN 60 AND 10")
def kv_range_empty(spark, d):
    return kv.between(user_values(spark, d), F.lit(60), F.lit(10)).agg(F.count(F.lit(1)).alias("entries"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS key, o_totalprice AS value FROM orders WHERE starts_with(CAST(o_orderkey AS VARCHAR), '12')")
def kv_prefix(spark, d):
    own = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("value"))
    return kv.with_prefix(own, "12").select("key", "value")


@query(f"SELECT key, value, CAST(1 AS BIGINT) AS rn FROM ({LATEST}) WHERE key >= 3 ORDER BY key LIMIT 1")
def kv_seek(spark, d):
    return kv.seek(user_values(spark, d), F.lit(3)).select("key", "value", "rn")


@query(f"SELECT key, value, row_number() OVER (ORDER BY key) AS rn FROM ({LATEST}) WHERE key >= 3 ORDER BY key LIMIT 20")
def kv_seek_next_n(spark, d):
    return kv.seek(user_values(spark, d), F.lit(3), 20).select("key", "value", "rn")


@query("SELECT o_orderkey AS key, o_totalprice AS value, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders")
def kv_scan_ordered(spark, d):
    return kv.ordered(table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("value")), "value")


@query("SELECT user_id AS key, event_id AS seq, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS age FROM events")
def kv_all_versions(spark, d):
    return kv.all_versions(user_values(spark, d))


@query("SELECT user_id AS key, event_id AS seq, value, row_number() OVER (ORDER BY user_id, event_id DESC) AS rn FROM events")
def kv_merge_runs(spark, d):
    own = user_values(spark, d)
    return kv.merge_runs(*[own.where(F.pmod("seq", F.lit(4)) == r) for r in range(4)])


@query("SELECT key, arg_min(value, run) AS value, min(run) AS run FROM (SELECT user_id AS key, event_id // 1025 AS run, arg_max(value, event_id) AS value FROM events GROUP BY ALL) GROUP BY key")
def kv_oldest_run_wins(spark, d):
    return kv.oldest_run_wins(user_values(spark, d), F.expr("seq div 1025"))


@query("SELECT count(*) AS probes, count(*) FILTER (WHERE p.value IS DISTINCT FROM e.value) AS misses FROM (SELECT event_id * 2 AS key, value FROM events) p LEFT JOIN events e ON p.key = e.event_id")
def probe_misses(spark, d):
    own = event_values(spark, d)
    return kv.probe_misses(own, own.select((F.col("key") * 2).alias("key"), "value"))


@query("""
WITH RECURSIVE s AS (SELECT row_number() OVER (ORDER BY doc_id) AS i, doc_id, 8 + octet_length(encode(text)) AS size FROM documents),
f(i, held, run) AS (SELECT i, size, 0::BIGINT FROM s WHERE i = 1
  UNION ALL SELECT s.i, CASE WHEN f.held > 1048576 THEN s.size ELSE f.held + s.size END, CASE WHEN f.held > 1048576 THEN f.run + 1 ELSE f.run END FROM f JOIN s ON s.i = f.i + 1)
SELECT run, min(doc_id) AS first_key, max(doc_id) AS last_key, count(*) AS entries, CAST(sum(size) AS BIGINT) AS bytes FROM f JOIN s USING (i) GROUP BY run""")
def run_rotation(spark, d):
    """Texts of varying size through a buffer of 1 MB, as one shard."""
    sizes = table(spark, d, "documents").select(F.lit(0).alias("shard"), F.col("doc_id").alias("seq"), (F.octet_length("text") + 8).alias("size"))
    cut = runs.fold_runs(sizes, 1 << 20).withColumnRenamed("seq", "key")
    return runs.zone_maps(cut, F.col("size"))


@query("SELECT event_id AS key, (row_number() OVER (ORDER BY event_id) - 1) // 1025 AS run FROM events")
def run_rotation_fixed(spark, d):
    return runs.cut_evenly(event_values(spark, d).select("key"), ["key"], runs.entries_a_run(16), "run")


@query("SELECT event_id AS key, (row_number() OVER (ORDER BY event_id) - 1) // 228 AS block FROM events")
def block_cut_fixed(spark, d):
    return runs.cut_evenly(event_values(spark, d).select("key"), ["key"], runs.entries_a_block(18), "block")


@query("SELECT run, min(event_id) AS first_key, max(event_id) AS last_key, count(*) AS entries, count(*) * 16 AS bytes FROM (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 1025 AS run FROM events) GROUP BY run")
def run_zone_map(spark, d):
    return runs.zone_maps(run_rotation_fixed(spark, d), F.lit(16).cast("long"))


@query("SELECT block, max(event_id) AS last_key, count(*) AS entries FROM (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 228 AS block FROM events) GROUP BY block")
def sparse_index(spark, d):
    return runs.sparse_index(event_values(spark, d), runs.entries_a_block(18))


@query(f"SELECT key, value, seq, (row_number() OVER (ORDER BY key) - 1) // 100 AS run FROM ({LATEST})")
def compaction(spark, d):
    return runs.compact(user_values(spark, d), 100)


def _murmur_sql(n: str) -> str:
    """Murmur1 of eight big-endian bytes of a non-negative integer below 2^32, with UBIGINT arithmetic."""
    m, low = "3332679571::UBIGINT", "4294967295::UBIGINT"
    swap = lambda x: f"(((({x}) & 255) << 24) | (((({x}) >> 8) & 255) << 16) | (((({x}) >> 16) & 255) << 8) | ((({x}) >> 24) & 255))"
    return f"""
m0 AS (SELECT *, xor(4078620745::UBIGINT, (8::UBIGINT * {m}) & {low}) AS h, {swap(f'{n}::UBIGINT')} AS w FROM src),
m1 AS (SELECT * REPLACE ((h * {m}) & {low} AS h) FROM m0),
m2 AS (SELECT * REPLACE ((xor(h, h >> 16) + w) & {low} AS h) FROM m1),
m3 AS (SELECT * REPLACE ((h * {m}) & {low} AS h) FROM m2),
m4 AS (SELECT * REPLACE ((xor(h, h >> 16) * {m}) & {low} AS h) FROM m3),
m5 AS (SELECT * REPLACE ((xor(h, h >> 10) * {m}) & {low} AS h) FROM m4),
hashed AS (SELECT * REPLACE (xor(h, h >> 17) AS h) FROM m5)"""


@query(f"WITH src AS (SELECT event_id FROM events), {_murmur_sql('event_id')} SELECT event_id AS key, CAST(h AS BIGINT) AS hash FROM hashed")
def murmur1_8(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("key"), codec.murmur1(kv.binary_key(F.col("event_id"))).alias("hash"))


_PROBES = "unnest([((h + i * (((h >> 15) | (h << 17)) & 4294967295::UBIGINT)) & 4294967295::UBIGINT) % 4096 for i in [0::UBIGINT, 1::UBIGINT, 2::UBIGINT, 3::UBIGINT]])"


_BITS = f"""WITH src AS (SELECT event_id FROM events), {_murmur_sql('event_id')},
p AS (SELECT event_id, event_id // 1024 AS run, CAST({_PROBES} AS BIGINT) AS bit FROM hashed)"""


def _places(spark: SparkSession, d: str) -> DataFrame:
    """Every key with the run that holds it, 1,024 keys a run, and its four places in a filter whose modulus is 4,096."""
    own = table(spark, d, "events").select(F.col("event_id").alias("key"), F.expr("event_id div 1024").alias("run"))
    return own.withColumn("places", codec.bloom_places(codec.murmur1(kv.binary_key(F.col("key"))), 4096))


@query(f"{_BITS} SELECT DISTINCT run, bit FROM p")
def bloom_bits(spark, d):
    """The bits that the keys of each run set in its filter."""
    return _places(spark, d).select("run", F.explode("places").alias("bit")).distinct()


@query(f"{_BITS}, b AS (SELECT DISTINCT run, bit FROM p) SELECT event_id AS key, count(b.bit) = 4 AS maybe FROM p LEFT JOIN b ON p.bit = b.bit AND b.run = p.run - 1 GROUP BY event_id")
def bloom_test(spark, d):
    """Every key against the filter of the run before its own, which never holds it."""
    asked = _places(spark, d).select("key", (F.col("run") - 1).alias("run"), F.explode("places").alias("bit"))
    there = bloom_bits(spark, d).withColumn("there", F.lit(1))
    return asked.join(there, ["run", "bit"], "left").groupBy("key").agg((F.count("there") == 4).alias("maybe"))


_LENGTH = "CASE WHEN {x} < 128 THEN 1 WHEN {x} < 16384 THEN 2 WHEN {x} < 2097152 THEN 3 WHEN {x} < 268435456 THEN 4 WHEN {x} < 34359738368 THEN 5 WHEN {x} < 4398046511104 THEN 6 ELSE 7 END"


@query("SELECT event_id AS key, " + _LENGTH.format(x="(event_id * event_id * 37)") + " AS length FROM events")
def varint_len(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("key"), codec.varint_length(F.expr("event_id * event_id * 37")).alias("length"))


@query("SELECT event_id AS key, event_id * event_id * 37 AS value, " + _LENGTH.format(x="(event_id * event_id * 37)") + " AS cursor, TRUE AS ok FROM events")
def varint_roundtrip(spark, d):
    x = F.expr("event_id * event_id * 37")
    own = table(spark, d, "events").select("event_id", codec.varint_value(codec.varint(x)).alias("v"))
    return own.select(F.col("event_id").alias("key"), F.col("v.value").cast("long").alias("value"), F.col("v.cursor").alias("cursor"), F.col("v.ok").alias("ok"))


@query("SELECT doc_id, lower(CASE WHEN n < 128 THEN lpad(hex(n), 2, '0') ELSE lpad(hex(n % 128 + 128), 2, '0') || lpad(hex(n // 128), 2, '0') END || hex(encode(k))) AS framed FROM (SELECT doc_id, source || repeat('x', doc_id % 200) AS k, octet_length(encode(source || repeat('x', doc_id % 200))) AS n FROM documents)")
def bytes_framed(spark, d):
    key = F.encode(F.concat("source", F.expr("repeat('x', cast(doc_id % 200 as int))")), "UTF-8")
    return table(spark, d, "documents").select("doc_id", F.lower(F.hex(codec.framed(key))).alias("framed"))


_KEYED = "SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events"


@query(f"SELECT stream, n, lower(hex(encode(CAST(stream AS VARCHAR))) || lpad(hex(n), 8, '0')) AS key_hex FROM ({_KEYED})")
def record_key_be(spark, d):
    key = codec.record_key(F.col("stream").cast("string"), F.col("n"))
    return log(spark, d).select("stream", "n", F.lower(F.hex(key)).alias("key_hex"))


@query(f"SELECT stream, count(*) FILTER (WHERE rn <> n + 1) AS misplaced FROM (SELECT stream, n, row_number() OVER (PARTITION BY stream ORDER BY n % 256, n // 256) AS rn FROM ({_KEYED})) GROUP BY stream")
def record_key_le_order(spark, d):
    """How many records a little-endian ordinal would put in another place."""
    keyed = log(spark, d).select("stream", "n", codec.record_key(F.lit(""), F.col("n"), big_endian=False).alias("key"))
    return numbered(keyed, ["key"], ["stream"]).groupBy("stream").agg(F.count_if(F.col("rn") != F.col("n") + 1).alias("misplaced"))


@query("SELECT event_id, printf('%06d', event_id * 977) || CASE event_id % 3 WHEN 0 THEN '.manifest' WHEN 1 THEN '.ulog' ELSE '.olog' END AS name FROM events")
def file_id_format(spark, d):
    return table(spark, d, "events").select("event_id", codec.file_name((F.col("event_id") % 3 + 1).cast("int"), F.col("event_id") * 977).alias("name"))


_NAMES = "CASE event_id % 5 WHEN 0 THEN 'dir/' || event_id || '.ulog' WHEN 1 THEN event_id || '.olog' WHEN 2 THEN event_id || '.other' WHEN 3 THEN 'test.olog' ELSE '00' || event_id || '.manifest' END"


@query(f"""SELECT event_id, ok, CASE WHEN ok THEN CASE regexp_extract(name, '\\.([a-z]+)$', 1) WHEN 'manifest' THEN 1 WHEN 'ulog' THEN 2 ELSE 3 END END AS kind, CASE WHEN ok THEN CAST(regexp_extract(name, '([0-9]+)\\.', 1) AS BIGINT) END AS number
FROM (SELECT event_id, name, regexp_matches(name, '^(.*/)?[0-9]+\\.(manifest|ulog|olog)$') AS ok FROM (SELECT event_id, {_NAMES} AS name FROM events))""")
def file_id_parse(spark, d):
    own = table(spark, d, "events").select("event_id", codec.file_id(F.expr(_NAMES)).alias("id"))
    return own.select("event_id", F.col("id").isNotNull().alias("ok"), F.col("id.kind").alias("kind"), F.col("id.number").alias("number"))


_LOG = "SELECT user_id AS stream, event_id AS seq, event_type AS type, props AS data, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events"


@query(_LOG)
def stream_append_ordinals(spark, d):
    return log(spark, d)


@query(f"SELECT n, seq, type, data FROM ({_LOG}) WHERE stream = 3")
def stream_read(spark, d):
    return streams.read(log(spark, d), 3).select("n", "seq", "type", "data")


@query(f"SELECT n, seq, type, data FROM ({_LOG}) WHERE stream = 3 AND n >= 5")
def stream_read_from(spark, d):
    return streams.read(log(spark, d), 3, 5).select("n", "seq", "type", "data")


@query("SELECT conv_id AS stream, turn AS n, role FROM conversations WHERE conv_id = 5 AND turn BETWEEN 1 AND 3")
def stream_read_range(spark, d):
    own = table(spark, d, "conversations").select(F.col("conv_id").alias("stream"), F.col("turn").alias("n"), "role")
    return streams.read(own, 5, 1, 3)


@query("SELECT p.stream, EXISTS (SELECT 1 FROM events e WHERE e.user_id = p.stream) AS \"exists\" FROM (SELECT DISTINCT n_nationkey * 11 AS stream FROM nation) p")
def stream_exists(spark, d):
    return streams.exists(log(spark, d), table(spark, d, "nation").select((F.col("n_nationkey") * 11).alias("stream")))


@query("SELECT user_id AS stream, count(*) AS length FROM events WHERE user_id = 3 GROUP BY user_id")
def stream_length(spark, d):
    return streams.lengths(log(spark, d).where("stream = 3"))


@query("SELECT user_id AS stream, count(*) AS length FROM events GROUP BY user_id")
def stream_list(spark, d):
    return streams.lengths(log(spark, d))


@query(f"SELECT stream, seq, type, data, value, n, row_number() OVER (ORDER BY seq) - 1 AS place FROM ({_LOG})")
def stream_all(spark, d):
    return streams.everything(log(spark, d))


@query(_LOG)
def stream_resume_append(spark, d):
    """The first half of the records as history, the rest appended to it."""
    own = arriving(spark, d)
    half = own.agg(F.expr("percentile_approx(seq, 0.5)")).first()[0]
    history = streams.append(own.where(F.col("seq") <= half))
    return history.unionByName(streams.append(own.where(F.col("seq") > half), history))


@query(f"SELECT stream, count(*) AS records FROM (SELECT CAST(stream AS VARCHAR) AS stream FROM ({_LOG})) WHERE stream = '1' GROUP BY stream")
def stream_prefix_isolation(spark, d):
    own = log(spark, d).withColumn("stream", F.col("stream").cast("string"))
    return streams.read(own, "1").groupBy("stream").agg(F.count(F.lit(1)).alias("records"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def event_json(spark, d):
    return table(spark, d, "events").select("event_id", streams.payload(F.col("props"), "k int")["k"].alias("k"))


@query("SELECT event_id, user_id, event_type FROM events")
def event_serialize(spark, d):
    """Records written as JSON and read back by a schema."""
    text = table(spark, d, "events").select(streams.serialize(F.col("event_id"), F.col("user_id"), F.col("event_type")).alias("data"))
    return text.select(streams.payload(F.col("data"), "event_id long, user_id long, event_type string").alias("r")).select("r.*")


@query("SELECT user_id AS stream, count(*) AS records, max(event_id) AS last_seq, arg_max(event_type, event_id) AS last_type, count(*) FILTER (WHERE value > 0) AS positive FROM events GROUP BY user_id")
def stream_fold_state(spark, d):
    return streams.fold(arriving(spark, d), records=F.count(F.lit(1)), last_seq=F.max("seq"), last_type=F.max_by("type", "seq"), positive=F.count_if(F.col("value") > 0))


_EDITS = "SELECT event_id AS version, user_id AS file, event_type <> 'purchase' AND event_id % 3 <> 0 AS is_add FROM events"


def _edits(spark: SparkSession, d: str) -> DataFrame:
    is_add = (F.col("event_type") != "purchase") & (F.col("event_id") % 3 != 0)
    return table(spark, d, "events").select(F.col("event_id").alias("version"), F.col("user_id").alias("file"), is_add.alias("is_add"))


@query(f"SELECT file, max(version) AS version FROM ({_EDITS}) GROUP BY file HAVING arg_max(is_add, version)")
def manifest_replay(spark, d):
    return manifest.replay(_edits(spark, d))


@query(f"SELECT file, max(version) AS version FROM ({_EDITS}) WHERE version <= 500 GROUP BY file HAVING arg_max(is_add, version)")
def manifest_as_of(spark, d):
    return manifest.as_of(_edits(spark, d), 500)


@query(f"SELECT CAST(stream AS VARCHAR) AS stream, n, seq, type, data FROM ({_LOG})")
def ingest_stream_equals_batch(spark, d):
    """Events as a file stream, appended batch by batch into an event log, and the log read."""
    base = folder(spark)
    own = arriving(spark, d).select(F.col("stream").cast("string").alias("stream"), "seq", "type", "data")
    # Written one after the other, as the file source takes files by their time; each is a batch.
    edges = [float("-inf"), *own.agg(F.expr("percentile_approx(seq, array(0.25, 0.5, 0.75))")).first()[0], float("inf")]
    for low, high in zip(edges, edges[1:], strict=False):
        own.where((F.col("seq") > low) & (F.col("seq") <= high)).coalesce(1).write.mode("append").parquet(f"{base}/arrived")
    arrived = spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/arrived")
    log_ = EventLog(spark, f"{base}/log")
    ingest(arrived, log_, f"{base}/checkpoint").awaitTermination()
    return log_.read()


@query(LATEST.replace(", count(*) AS versions", "").replace("user_id AS key", "lower(lpad(hex(user_id), 16, '0')) AS key_hex"))
def store_write_compact_read(spark, d):
    """Events in order as three batches of a store with binary keys, compacted after the second, and the latest versions read."""
    store = Store(spark, folder(spark))
    own = user_values(spark, d).select(kv.binary_key(F.col("key")).alias("key"), "seq", F.col("value").cast("string").cast("binary").alias("value"))
    third = own.agg(F.expr("percentile_approx(seq, array(0.33, 0.67))")).first()[0]
    for n, part in enumerate((F.col("seq") <= third[0], (F.col("seq") > third[0]) & (F.col("seq") <= third[1]), F.col("seq") > third[1])):
        store.set_all(own.where(part))
        if n == 1:
            store.compact()
    return store.scan().select(F.lower(F.hex("key")).alias("key_hex"), F.col("value").cast("string").cast("double").alias("value"), "seq")


@query("SELECT 'f' || CAST(n_nationkey AS VARCHAR) AS file, n_nationkey AS version FROM nation WHERE n_nationkey % 2 = 1 OR n_nationkey = (SELECT max(n_nationkey) FROM nation)")
def manifest_commit_recover(spark, d):
    """A commit for each nation that adds a file and, from every odd one on, removes the one before; a new manifest reads them, over a checkpoint."""
    from .plans.manifest import Manifest

    path, numbers = folder(spark), sorted(r[0] for r in table(spark, d, "nation").select("n_nationkey").collect())  # 25 rows
    log_ = Manifest(spark, path, checkpoint_every=10)
    for n in numbers:
        log_.commit(lambda known, n=n: [{"action": "add", "file": f"f{n}", "of": n}] + ([{"action": "remove", "file": f"f{n - 1}"}] if n % 2 else []))
    _, files = Manifest(spark, path).state()
    return spark.createDataFrame([(f, a["of"]) for f, a in files.items()], "file string, version int")


_SWAP = "substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2)"


@query(f"SELECT event_id AS key, lower({_SWAP}) AS fixed_hex, v AS value FROM (SELECT event_id, v, lpad(hex(v), 8, '0') AS h FROM (SELECT event_id, (event_id * 2654435761) % 4294967296 AS v FROM events))")
def fixed_roundtrip(spark, d):
    """32-bit integers as little-endian bytes and back."""
    own = table(spark, d, "events").select(F.col("event_id").alias("key"), codec.fixed_le(F.expr("(event_id * 2654435761) % 4294967296"), 4).alias("b"))
    return own.select("key", F.lower(F.hex("b")).alias("fixed_hex"), codec.fixed_le_value(F.col("b"), 4).alias("value"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE source || repeat('x', doc_id % 200) END AS body FROM documents")
def frame_decode(spark, d):
    """Framed byte strings read back; of every seventh the last byte is missing, and nothing is read."""
    own = table(spark, d, "documents").select("doc_id", codec.framed(F.encode(F.concat("source", F.expr("repeat('x', cast(doc_id % 200 as int))")), "UTF-8")).alias("b"))
    cut = F.when(F.col("doc_id") % 7 == 0, F.substring(F.col("b"), F.lit(1), F.octet_length("b") - 1)).otherwise(F.col("b"))
    return own.select("doc_id", F.decode(codec.unframed(cut), "UTF-8").alias("body"))


@query("SELECT event_id AS key, '(' || event_id * 4096 || '+' || event_id % 5000 || ')' AS handle FROM events")
def block_handle(spark, d):
    """Position and length of a block as 16 bytes, read back as text."""
    raw = F.concat(codec.fixed_le(F.col("event_id") * 4096, 8), codec.fixed_le(F.col("event_id") % 5000, 8))
    part = lambda at: codec.fixed_le_value(F.substring("b", at, 8), 8).cast("long").cast("string")
    return table(spark, d, "events").select(F.col("event_id").alias("key"), raw.alias("b")).select("key", F.concat(F.lit("("), part(1), F.lit("+"), part(9), F.lit(")")).alias("handle"))


@query("SELECT o_orderkey AS key, o_totalprice AS value FROM orders WHERE o_orderkey >= 256 AND o_orderkey < 512")
def kv_prefix_binary(spark, d):
    """Keys of eight big-endian bytes by a prefix of seven, as a range."""
    own = table(spark, d, "orders").select(kv.binary_key(F.col("o_orderkey")).alias("key"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("value"))
    return kv.with_prefix(own, bytes(6) + b"\x01").select(F.col("seq").alias("key"), "value")
