"""Byte codecs as Column expressions: varints, fixed integers, framed byte strings, Murmur1, bloom probes, file names.

Bytes are handled as hex text inside an expression and as binary outside. Integers are BIGINT; 32-bit products are split so
that they can't overflow under ANSI arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The hash's constants and the file kinds.
SEED, FACTOR = 0xF31AD049, 0xC6A4A793
EXTENSIONS = {"manifest": 1, "ulog": 2, "olog": 3}

LOW = 0xFFFFFFFF


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hex_at(h: Column, i: Column | int) -> Column:
    """Byte i of hex text as a BIGINT."""
    return F.conv(F.substring(h, F.lit(i) * 2 + 1 if isinstance(i, int) else i * 2 + 1, F.lit(2)), 16, 10).cast("long")


def varint_length(x: Column) -> Column:
    """Bytes of the varint of a non-negative BIGINT, nine at most."""
    out = F.lit(9)
    for n in reversed(range(1, 9)):
        out = F.when(x < F.lit(1 << 7 * n), n).otherwise(out)
    return out


def varint(x: Column) -> Column:
    """Seven bits a byte, the low ones first, the high bit set on all but the last."""
    def whole(v: Column) -> Column:
        def byte(n: Column) -> Callable[[Column], Column]:
            def one(i: Column) -> Column:
                bits = F.call_function("shiftright", v, (i * 7).cast("int")).bitwiseAND(F.lit(0x7F).cast("long"))
                return F.lpad(F.hex(bits + F.when(i < n - 1, 128).otherwise(0)), 2, "0")

            return one

        return let(varint_length(v), lambda n: F.array_join(F.transform(F.sequence(F.lit(0), n - 1), byte(n)), ""))

    return F.unhex(let(x, whole))


def varint_value(b: Column, most: int = 10) -> Column:
    """struct(ok, cursor, value): the varint at the start; not ok if it ends too early or has more than `most` bytes. The value is a DECIMAL(20,0).

    The first eight bytes give 56 bits, the others the rest, so that both sums stay within BIGINT.
    """
    zero = F.struct(F.lit(False).alias("ok"), F.lit(0).alias("cursor"), F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"))

    def of(h: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: i * 2 < F.length(h))

        def step(acc: Column, i: Column) -> Column:
            def add(c: Column) -> Column:
                bits = F.call_function("shiftleft", c % 128, (i % 8 * 7).cast("int"))
                low, high = F.when(i < 8, bits).otherwise(0), F.when(i < 8, 0).otherwise(bits)
                return F.struct((c < 128).alias("ok"), (acc["cursor"] + 1).alias("cursor"), (acc["low"] + low).alias("low"), (acc["high"] + high).alias("high"))

            return F.when(acc["ok"], acc).otherwise(let(_hex_at(h, i), add))

        def out(acc: Column) -> Column:
            value = acc["high"].cast("decimal(20,0)") * F.lit(1 << 56).cast("decimal(20,0)") + acc["low"]
            return F.struct(acc["ok"].alias("ok"), acc["cursor"].alias("cursor"), F.when(acc["ok"], value.cast("decimal(20,0)")).alias("value"))

        return F.aggregate(places, zero, step, out)

    return let(F.hex(b), of)


def fixed_le(x: Column, width: int) -> Column:
    """A non-negative integer as little-endian bytes."""
    h = F.lpad(F.hex(x), 2 * width, "0")
    return F.unhex(F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(width))]))


def fixed_le_value(b: Column, width: int) -> Column:
    """The first bytes as a little-endian integer; widths of eight bytes as DECIMAL(20,0)."""
    h = F.hex(b)
    turned = F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(width))])
    return F.conv(turned, 16, 10).cast("long" if width < 8 else "decimal(20,0)")


def framed(b: Column) -> Column:
    """Varint length, then the bytes."""
    return F.concat(varint(F.octet_length(b).cast("long")), b)


def unframed(b: Column) -> Column:
    """The bytes of the frame at the start; null if it is cut off."""
    return let(varint_value(b, 5), lambda v: F.when(
        v["ok"] & (F.octet_length(b) >= v["cursor"] + v["value"].cast("int")), F.substring(b, v["cursor"] + 1, v["value"].cast("int"))))


def _times(h: Column) -> Column:
    """h * FACTOR in 32 bits; h is used twice, so it should be a variable."""
    low = h.bitwiseAND(F.lit(0xFFFF).cast("long")) * FACTOR
    high = F.shiftleft((F.shiftright(h, 16) * FACTOR).bitwiseAND(F.lit(0xFFFF).cast("long")), 16)
    return (low + high).bitwiseAND(F.lit(LOW).cast("long"))


def _mixed(h: Column, shift: int) -> Column:
    """h * FACTOR, then the high bits folded down."""
    return let(h, lambda a: let(_times(a), lambda x: x.bitwiseXOR(F.shiftright(x, shift))))


def murmur1(b: Column, seed: int = SEED) -> Column:
    """The 32-bit Murmur1 hash of bytes as a BIGINT; null for null."""
    return let(F.hex(b), lambda h: _murmur1(h, seed))


def _murmur1(h: Column, seed: int) -> Column:
    n = (F.length(h) / 2).cast("long")
    word = lambda i: F.conv(F.concat(*[F.substring(h, i * 8 + k, F.lit(2)) for k in (7, 5, 3, 1)]), 16, 10).cast("long")
    words = F.filter(F.sequence(F.lit(0), F.greatest(F.floor(n / 4) - 1, F.lit(0)).cast("int")), lambda i: (i + 1) * 4 <= n)
    low = F.lit(LOW).cast("long")
    begun = F.lit(seed).cast("long").bitwiseXOR(_times(n))
    body = F.aggregate(words, begun, lambda acc, i: _mixed((acc + word(i)).bitwiseAND(low), 16))
    at = (F.floor(n / 4) * 4).cast("int")
    rest = (n % 4).cast("int")
    tail = lambda k: F.when(rest > k, F.shiftleft(_hex_at(h, at + k), 8 * k)).otherwise(F.lit(0).cast("long"))
    tailed = let(body, lambda x: F.when(rest > 0, _mixed((x + tail(0) + tail(1) + tail(2)).bitwiseAND(low), 16)).otherwise(x))
    return _mixed(_mixed(tailed, 10), 17)


def bloom_places(h: Column, size: int) -> Column:
    """The four bit places of a 32-bit hash in a filter; size is the modulus (the reference filter takes its length in bytes)."""
    low = F.lit(LOW).cast("long")
    turn = lambda x: F.shiftright(x, 15) + F.shiftleft(x.bitwiseAND(F.lit(0x7FFF).cast("long")), 17)
    place = lambda x, d, i: (x + d * i).bitwiseAND(low) % size
    return let(h, lambda x: let(turn(x).bitwiseAND(low), lambda d: F.array(*[place(x, d, i) for i in range(4)])))


def file_name(kind: Column, number: Column) -> Column:
    """Six digits at least, then the extension of the kind."""
    ext = F.element_at(F.create_map(*[F.lit(x) for k, e in EXTENSIONS.items() for x in (e, k)]), kind)
    return F.concat(F.format_string("%06d", number), F.lit("."), ext)


def file_id(name: Column) -> Column:
    """struct(kind, number) of a file name, null if its stem isn't a number or its extension isn't known."""
    pattern = r"^(?:.*/)?([0-9]+)\.(manifest|ulog|olog)$"
    kinds = F.create_map(*[F.lit(x) for k, e in EXTENSIONS.items() for x in (k, e)])
    own = F.struct(F.element_at(kinds, F.regexp_extract(name, pattern, 2)).alias("kind"), F.regexp_extract(name, pattern, 1).cast("long").alias("number"))
    return F.when(name.rlike(pattern), own)


def record_key(stream: Column, n: Column, big_endian: bool = True) -> Column:
    """Stream name and ordinal as bytes; only the big-endian form sorts by ordinal."""
    return F.concat(stream.cast("binary"), F.unhex(F.lpad(F.hex(n), 8, "0")) if big_endian else fixed_le(n, 4))
