"""Codec vectors and a plain Python model of the hash."""

import random

from pyspark.sql import functions as F

from rillstore.functions import codec

VARINTS = [("20", True, 1, 32), ("7F", True, 1, 127), ("FF", False, 1, None), ("FF01", True, 2, 255), ("00", True, 1, 0), ("FFFFFFFF0F", True, 5, 4294967295)]


def murmur(data, seed=codec.SEED):
    low, m = 0xFFFFFFFF, codec.FACTOR
    h = seed ^ (len(data) * m & low)
    whole = len(data) // 4 * 4
    for i in range(0, whole, 4):
        h = (h + int.from_bytes(data[i : i + 4], "little")) * m & low
        h ^= h >> 16
    if data[whole:]:
        h = (h + int.from_bytes(data[whole:], "little")) * m & low
        h ^= h >> 16
    for shift in (10, 17):
        h = h * m & low
        h ^= h >> shift
    return h


def test_varint_vectors(spark):
    rows = [(bytes.fromhex(h),) for h, *_ in VARINTS] + [(bytes.fromhex("FFFFFFFFFFFFFFFFFF01"),)]
    got = spark.createDataFrame(rows, "b binary").select(codec.varint_value(F.col("b")).alias("v")).collect()
    want = [(ok, cursor, v) for _, ok, cursor, v in VARINTS] + [(True, 10, 18446744073709551615)]
    assert [(r.v.ok, r.v.cursor, None if r.v.value is None else int(r.v.value)) for r in got] == want


def test_varint_32_stops_at_five_bytes(spark):
    got = spark.createDataFrame([(bytes.fromhex("FFFFFFFFFFFFFFFFFF01"),)], "b binary").select(codec.varint_value(F.col("b"), 5).alias("v")).first()
    assert got.v.ok is False and got.v.cursor == 5


def test_encoders(spark):
    df = spark.createDataFrame([(v,) for _, ok, _, v in VARINTS if ok], "x bigint")
    assert [r[0] for r in df.select(F.hex(codec.varint(F.col("x")))).collect()] == [h for h, ok, *_ in VARINTS if ok]
    assert df.select(F.hex(codec.fixed_le(F.lit(0), 4))).first()[0] == "00000000"
    one = spark.createDataFrame([(bytes(),), (b"\x20",), (b"x" * 300,)], "b binary")
    assert [r[0] for r in one.limit(2).select(F.hex(codec.framed(F.col("b")))).collect()] == ["00", "0120"]
    assert [bytes(r[0]) for r in one.select(codec.unframed(codec.framed(F.col("b")))).collect()] == [b"", b"\x20", b"x" * 300]
    assert one.select(codec.unframed(F.lit(b"\x05ab"))).first()[0] is None
    le = spark.createDataFrame([(bytes([1, 2, 0, 0, 0, 0, 0, 255]),)], "b binary")
    assert le.select(codec.fixed_le_value(F.col("b"), 4), codec.fixed_le_value(F.col("b"), 8)).first()[:] == (513, 0xFF00000000000201)


def test_varint_length_of_every_width(spark):
    values = [0] + [v for n in range(1, 10) for v in ((1 << 7 * n) - 1, 1 << 7 * n) if v < 1 << 63]
    df = spark.createDataFrame([(v,) for v in values], "x bigint")
    x = F.col("x")
    got = df.select("x", codec.varint_length(x).alias("length"), F.octet_length(codec.varint(x)).alias("bytes"), codec.varint_value(codec.varint(x)).alias("v")).collect()
    want = {v: max(1, -(-v.bit_length() // 7)) for v in values}
    assert {r.x: (r.length, r.bytes, r.v.ok, r.v.cursor, int(r.v.value)) for r in got} == {v: (n, n, True, n, v) for v, n in want.items()}


def test_murmur_of_all_lengths(spark):
    draw = random.Random(0)
    rows = [(bytes(draw.randrange(256) for _ in range(n)),) for n in range(25) for _ in range(4)]
    got = spark.createDataFrame(rows, "b binary").select(codec.murmur1(F.col("b"))).collect()
    assert [r[0] for r in got] == [murmur(b) for (b,) in rows]


def test_bloom_places(spark):
    got = spark.createDataFrame([(murmur(b"key"),)], "h bigint").select(codec.bloom_places(F.col("h"), 4096)).first()[0]
    h = murmur(b"key")
    d = (h >> 15 | h << 17) & 0xFFFFFFFF
    assert got == [((h + i * d) & 0xFFFFFFFF) % 4096 for i in range(4)]


def test_file_names(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (3, 12345678)], "kind int, number bigint")
    names = [r[0] for r in df.select(codec.file_name(F.col("kind"), F.col("number"))).collect()]
    assert names == ["000001.manifest", "000001.ulog", "000001.olog", "12345678.olog"]
    good = {"00.ulog": (2, 0), "25.olog": (3, 25), "32.manifest": (1, 32)}
    bad = ["00", ".ulog", "test", "dir/test", "test.something", "dir/00", "dir/test.something", "dir/00.other"]
    df = spark.createDataFrame([(n,) for n in [*good, *bad]], "name string")
    got = {r.name: r.id and tuple(r.id) for r in df.select("name", codec.file_id(F.col("name")).alias("id")).collect()}
    assert got == good | dict.fromkeys(bad)
