"""Bloom filters as bitmaps; hashes are two slices of MD5, so any engine can check them."""

from __future__ import annotations

from math import floor, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a filter that a query may hold as a constant; larger ones are joined by bucket.
INLINE_BYTES = 1 << 20
#: Bits of one bitmap row.
BUCKET = 32768


def hashes(bits_per_key: int = 10) -> int:
    """Number of hashes, 1 to 30 (B1)."""
    return min(30, max(1, floor(bits_per_key * log(2))))


def sizing(n: Column, bits_per_key: int = 10) -> tuple[Column, int]:
    """Bits (at least 64, whole bytes) and number of hashes (B1)."""
    return (F.ceil(F.greatest(F.lit(64), n * bits_per_key) / 8) * 8).cast("long"), hashes(bits_per_key)


def positions(key: Column, m: Column | int, k: int) -> Column:
    """The k bits of a key among m, by double hashing in 32 bits."""
    digest = F.md5(key.cast("string").cast("binary"))
    h1, h2 = (F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9))
    m = F.lit(m) if isinstance(m, int) else m
    return F.array(*[((h1 + h2 * i).bitwiseAND(F.lit(0xFFFFFFFF)) % m).cast("long") for i in range(k)])


def build(keys: DataFrame, group: list[str], key: str, bits_per_key: int = 10) -> DataFrame:
    """A filter for each group, sized by its number of distinct keys (B2): (group.., m, bucket, bitmap),
    a row for every 32,768 bits that has any set.  Bits are combined map-side, so no task sees more
    than a bucket of a group."""
    own = keys.select(*group, F.col(key).alias("__tm_key")).where("__tm_key is not null").distinct()
    n = own.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    m = n.select(*group, sizing(F.col("n"), bits_per_key)[0].alias("m"))
    if group:
        sized = own.join(m, group)
    else:
        (row,) = m.collect()  # one number
        sized = own.withColumn("m", F.lit(row["m"]))
    bits = sized.select(*group, "m", F.explode(positions(F.col("__tm_key"), F.col("m"), hashes(bits_per_key))).alias("bit"))
    at = F.bitmap_bit_position(F.col("bit") + 1)
    bucket = F.floor(F.col("bit") / BUCKET).alias("bucket")
    return bits.groupBy(*group, "m", bucket).agg(F.bitmap_construct_agg(at).alias("bitmap"))


def set_bits(filters: DataFrame, group: list[str]) -> DataFrame:
    """Set bits of each group's filter."""
    return filters.groupBy(*group, "m").agg(F.sum(F.bitmap_count("bitmap")).alias("set_bits"))


def _is_set(bitmap: Column, at: Column) -> Column:
    """Whether bit `at` (from 0) of a bitmap is set."""
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (at % 8).cast("int"))) != 0, F.lit(False))


def probe(keys: DataFrame, key: str, filters: DataFrame, bits_per_key: int = 10) -> DataFrame:
    """(key, `maybe`): whether all bits of each distinct key are set in the one filter given (B2, P6); a
    filter without rows holds nothing.

    A filter of at most `INLINE_BYTES` becomes a constant of the query, and probing an expression
    without any shuffle but the distinct; larger ones are joined by bucket."""
    asked = keys.select(key).distinct()
    size = filters.agg(F.max("m").alias("m")).first()["m"]  # one number
    if size is None:
        return asked.withColumn("maybe", F.lit(False))
    k = hashes(bits_per_key)
    if size <= 8 * INLINE_BYTES:
        held = {r["bucket"]: bytes(r["bitmap"]) for r in filters.collect()}  # m / 8 bytes, rounded up to 4 kB
        whole = F.lit(b"".join(held.get(i, bytes(BUCKET // 8)) for i in range(-(-size // BUCKET))))
        return asked.select(key, F.forall(positions(F.col(key), size, k), lambda at: _is_set(whole, at)).alias("maybe"))
    bits = asked.select(key, F.explode(F.array_distinct(positions(F.col(key), size, k))).alias("bit"))
    bits = bits.withColumn("bucket", F.floor(F.col("bit") / BUCKET)).join(filters.select("bucket", "bitmap"), "bucket", "left")
    return bits.groupBy(key).agg(F.every(F.coalesce(_is_set(F.col("bitmap"), F.col("bit") % BUCKET), F.lit(False))).alias("maybe"))


def encode(filters: DataFrame, bits_per_key: int = 10) -> bytes:
    """A filter's number of hashes in one byte and its bits (B3), of a filter of `INLINE_BYTES` at most."""
    size = filters.agg(F.max("m").alias("m")).first()["m"] or 0
    if size > 8 * INLINE_BYTES:
        raise ValueError("the filter is too large for one value")
    held = {r["bucket"]: bytes(r["bitmap"]) for r in filters.collect()}
    whole = b"".join(held.get(i, bytes(BUCKET // 8)) for i in range(-(-size // BUCKET)))
    return bytes([hashes(bits_per_key)]) + whole[: size // 8]


def decode(data: bytes) -> tuple[int, bytes]:
    """(number of hashes, bits); no bytes: a filter that holds nothing."""
    return (data[0], data[1:]) if data else (0, b"")


def may_contain(data: Column, key: Column) -> Column:
    """Whether an encoded filter, a binary value, may hold a key (B2, B3); an empty one never does."""
    k = F.conv(F.hex(F.substring(data, 1, 1)), 16, 10).cast("int")
    bits, m = F.substring(data, F.lit(2), F.octet_length(data)), (F.octet_length(data) - 1) * 8
    every = F.slice(positions(key, F.when(m > 0, m), 30), F.lit(1), k)
    return (m > 0) & F.forall(every, lambda at: _is_set(bits, at))
