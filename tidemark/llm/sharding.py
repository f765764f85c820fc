"""Operator 10, sharding: proportional stratified interleaving, DataFrame functions only.

Rows of each source are shuffled by a seeded hash and ranked; the r-th of a source's n rows
gets the fractional rank (2r - 1) / 2n; all rows are put in the order of that fraction and cut
into shards whose row counts differ by one at most, so that every shard has every source in
proportion.

No window ever holds a whole source: the hash (of the row: doc_id, the text's checksum and size) is
uniform, so its leading bits split a source into buckets of about `bucket_rows` rows, ranked one
by one, and the bucket sizes add up to each bucket's offset.  Rows with one hash that are more than a
bucket, as copies of a row with its id are, form buckets of their own, cut by a number that every
row carries: any order of equal rows is as good as another.  The fractions are uniform as well, so
cuts between them bound the second ranking; within a cut fractions are compared digit by digit, in
whole numbers.

Defined results: a null text has no bytes and crc32 0; a null source is the source ''; a null
doc_id is a row like any other; repeated rows each get a place of their own; an empty table
gives no rows; other columns are ignored, whatever their names, but for those in `keep`."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import prepare, table


def interleave(
    docs: DataFrame, n_shards: int, *, seed: int = 20_240_101, bucket_rows: int = 50_000, keep: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, source, size, text_crc32, law, shard, slot, grown_shard and `keep`."""
    n = docs.count()
    bits = max(8, (n // bucket_rows).bit_length())
    cuts = 1 << bits
    size, crc = F.coalesce(F.octet_length("text"), F.lit(0)) + 8, F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0))
    base = docs.select(
        "doc_id",
        F.coalesce(F.col("source"), F.lit("")).alias("source"),
        size.cast("long").alias("size"),
        crc.cast("long").alias("text_crc32"),
        F.xxhash64(F.lit(seed), "doc_id", crc, size).alias("__tm_h"),
        F.monotonically_increasing_id().alias("__tm_u"),
        *keep,
    ).checkpoint()  # each row keeps its number
    base = base.withColumn("__tm_b", F.shiftrightunsigned("__tm_h", 64 - bits))
    heavy = base.groupBy("source", "__tm_h").count().where(F.col("count") > bucket_rows)  # n / bucket_rows at most
    heavy = heavy.select("source", "__tm_h", F.ceil(F.col("count") / bucket_rows).alias("__tm_parts")).checkpoint()
    base = base.join(heavy, ["source", "__tm_h"], "left") if heavy.limit(1).count() else base.withColumn("__tm_parts", F.lit(None).cast("long"))
    base = base.withColumn("__tm_own", F.when(F.col("__tm_parts").isNotNull(), F.struct("__tm_h", F.pmod("__tm_u", "__tm_parts").alias("part"))))

    bucket = ["source", "__tm_b", "__tm_own"]
    sizes = base.groupBy(*bucket).count()
    slabs = sizes.groupBy("source", F.shiftrightunsigned("__tm_b", bits // 2).alias("__tm_slab")).agg(F.sum("count").alias("c"))
    before = Window.partitionBy("source").orderBy("__tm_slab").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slabs = slabs.select("source", "__tm_slab", (F.sum("c").over(before) - F.col("c")).alias("__tm_base"), F.sum("c").over(Window.partitionBy("source")).alias("__tm_n"))
    inner = Window.partitionBy("source", "__tm_slab").orderBy("__tm_b", F.asc_nulls_first("__tm_own")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = sizes.withColumn("__tm_slab", F.shiftrightunsigned("__tm_b", bits // 2)).withColumn("__tm_off", F.sum("count").over(inner) - F.col("count"))
    offsets = offsets.join(slabs, ["source", "__tm_slab"]).select(*bucket, (F.col("__tm_base") + F.col("__tm_off")).alias("__tm_off"), "__tm_n")

    in_bucket = Window.partitionBy(*bucket).orderBy("__tm_h", "doc_id", "text_crc32", "size")
    far = offsets.select(F.col("source").alias("__tm_source"), F.col("__tm_b").alias("__tm_b2"), F.col("__tm_own").alias("__tm_own2"), "__tm_off", "__tm_n")
    same = (F.col("source") == F.col("__tm_source")) & (F.col("__tm_b") == F.col("__tm_b2")) & F.col("__tm_own").eqNullSafe(F.col("__tm_own2"))
    ranked = base.withColumn("__tm_r", F.row_number().over(in_bucket)).join(far, same).withColumn("__tm_r", F.col("__tm_off") + F.col("__tm_r"))
    # digits of (2r - 1) / 2n: which cut it is in, and the order within; 2n stays below 2^39
    ranked = ranked.withColumn("__tm_x", F.expr(f"(2 * __tm_r - 1) * {cuts}L"))
    for digit in ("__tm_cut", "__tm_d1", "__tm_d2", "__tm_d3"):
        ranked = ranked.withColumn(digit, F.expr("__tm_x div (2 * __tm_n)")).withColumn("__tm_x", F.expr("(__tm_x % (2 * __tm_n)) * 16777216L"))
    ranked = ranked.select("doc_id", "source", "size", "text_crc32", "__tm_r", "__tm_cut", "__tm_d1", "__tm_d2", "__tm_d3", *keep).checkpoint()

    up_to = Window.orderBy("__tm_cut").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row a cut, n / bucket_rows of them
    below = ranked.groupBy("__tm_cut").count().select("__tm_cut", (F.sum("count").over(up_to) - F.col("count")).alias("__tm_start"))
    in_cut = Window.partitionBy("__tm_cut").orderBy("__tm_d1", "__tm_d2", "__tm_d3", "source", "__tm_r")
    placed = ranked.withColumn("__tm_pos", F.row_number().over(in_cut)).join(below, "__tm_cut").withColumn("__tm_pos", F.col("__tm_start") + F.col("__tm_pos") - 1)
    shard = F.expr(f"(__tm_pos * {n_shards}L) div {max(n, 1)}L")
    return placed.withColumn("shard", shard.cast("int")).select(
        "doc_id",
        "source",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("__tm_pos") - F.expr(f"(shard * {n}L + {n_shards - 1}L) div {n_shards}L")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *keep,
    )


def query(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    placed = interleave(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), 24)
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "source")
