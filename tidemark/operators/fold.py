"""Ordered folds and running totals that a hot key cannot break."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that one slab of a running total should hold, and slabs at most.
SLAB_ROWS, MOST_SLABS = 1 << 22, 256


def ordered_fold(rows: DataFrame, by: str, order: list[str], start: Callable[[], list], step: Callable, name: str, kind: str) -> DataFrame:
    """Adds `name`: what `step(state, *values)` returns for each row of a key in order, where the
    values are all columns but `by` and the state begins as `start()`.

    For folds whose outcome changes later ones, so that no aggregate expresses them.  Rows are
    dealt by key and sorted (spilling to disk), then read once in Arrow batches with the state of
    one key carried along: linear in the rows, and memory does not grow with a key's history."""
    from pyspark.sql.pandas.types import to_arrow_type

    value = T._parse_datatype_string(kind)
    arrow, names = to_arrow_type(value), [*rows.columns, name]
    at, others = rows.columns.index(by), [i for i, c in enumerate(rows.columns) if c != by]

    def run(batches):
        import pyarrow as pa

        key, state = object(), None
        for b in batches:
            keys, values = b.column(at).to_pylist(), [b.column(i).to_pylist() for i in others]
            out = []
            for k, *v in zip(keys, *values, strict=True):
                if k != key:
                    key, state = k, start()
                out.append(step(state, *v))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, arrow)], names)

    schema = T.StructType([*rows.schema.fields, T.StructField(name, value)])
    return rows.repartition(by).sortWithinPartitions(by, *order).mapInArrow(run, schema)


def reset_groups(rows: DataFrame, by: str, order: list[str], size: str, limit: int, name: str) -> DataFrame:
    """Adds `name`, counted from 0 in each key: a group ends with the row that brings its sizes to
    `limit` or more, and the next begins with none (the sum starts again, so no running total
    tells it).

    Rows are dealt by key, sorted, and read once in Arrow batches; within a batch whole groups are
    found by searching its running sums, so the steps are as many as the groups."""
    at, sized, names = rows.columns.index(by), rows.columns.index(size), [*rows.columns, name]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        key, group, left = object(), 0, limit
        for b in batches:
            keys, sizes = b.column(at), pc.fill_null(b.column(sized), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            runs = pc.run_end_encode(keys)
            out, start = np.zeros(b.num_rows, np.int64), 0
            for k, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                if k != key:
                    key, group, left = k, 0, limit
                total = np.cumsum(sizes[start:end])
                i, used = 0, 0
                while i < len(total):
                    j = min(int(np.searchsorted(total, used + left)) + 1, len(total))
                    out[start + i : start + j] = group
                    left -= int(total[j - 1]) - used
                    used, i = int(total[j - 1]), j
                    if left <= 0:
                        group, left = group + 1, limit
                start = end
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names)

    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.LongType())])
    return rows.repartition(by).sortWithinPartitions(by, *order).mapInArrow(run, schema)


def slab_cuts(rows: DataFrame, at: Column, slab_rows: int = SLAB_ROWS) -> list:
    """Values of a numeric order column that cut the table into slabs of about `slab_rows` rows, at its
    quantiles, so that any distribution (stamps with a counter in the low bits too) gives even
    slabs.  None for a table of one slab."""
    n = rows.count()
    slabs = min(MOST_SLABS, -(-n // slab_rows))
    if slabs < 2:
        return []
    found = rows.agg(F.percentile_approx(at, [i / slabs for i in range(1, slabs)], 10 * slabs).alias("q")).first()["q"]
    return sorted(set(found or []))


def slab_of(at: Column, cuts: list) -> Column:
    """How many cuts lie at or below a value, by halving."""
    if not cuts:
        return F.lit(0)

    def pick(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(at < F.lit(cuts[mid]), pick(lo, mid)).otherwise(pick(mid + 1, hi))

    return pick(0, len(cuts))


_TOTALS = {"sum": F.sum, "max": F.max, "min": F.min}


def running(rows: DataFrame, by: list[str], order: list, value: Column, total: str, at: Column, name: str, *, newest_first: bool = False, own: bool = True, slab_rows: int = SLAB_ROWS, cuts: list | None = None) -> DataFrame:
    """Adds `name`: `total` (sum, max, min, or last: the last that is not null) of `value` over a key's
    rows up to each row in `order`; without the row itself unless `own`.

    Large tables go in two levels: totals of slabs (map-side combined) give what comes before each
    slab, and rows are sorted only within a slab, so a hot key spreads over as many tasks as it
    has slabs.  `at` is the numeric column that `order` begins with; `newest_first` if it falls.
    `cuts` of the same rows may be given, so that they are found once."""
    cuts = slab_cuts(rows, at, slab_rows) if cuts is None else cuts
    last = total == "last"
    over = (lambda c: F.last(c, ignorenulls=True)) if last else _TOTALS[total]
    tagged = rows.withColumn("__tm_slab", slab_of(at, cuts)).withColumn("__tm_x", value)
    within = Window.partitionBy(*by, "__tm_slab").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    if not cuts:
        return tagged.withColumn(name, over("__tm_x").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1))).drop("__tm_slab", "__tm_x")
    if last:  # the newest in the order of a slab, whatever its type
        whole = Window.partitionBy(*by, "__tm_slab").orderBy(*order)
        place = tagged.withColumn("__tm_n", F.row_number().over(whole)).where("__tm_x is not null")
        sums = place.groupBy(*by, "__tm_slab").agg(F.max_by("__tm_x", "__tm_n").alias("__tm_s"))
    else:
        sums = tagged.groupBy(*by, "__tm_slab").agg(over("__tm_x").alias("__tm_s"))
    cut = F.desc("__tm_slab") if newest_first else F.asc("__tm_slab")
    past = Window.partitionBy(*by).orderBy(cut).rowsBetween(Window.unboundedPreceding, -1)
    heads = tagged.select(*by, "__tm_slab").distinct()
    names = {c: f"__tm_by{i}" for i, c in enumerate([*by, "__tm_slab"])}
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    known = heads.join(sums.withColumnsRenamed(names), same, "left").select(*by, "__tm_slab", over("__tm_s").over(past).alias("__tm_s")).withColumnsRenamed(names)
    here = tagged.withColumn("__tm_x", over("__tm_x").over(within)).join(known, same)
    if total == "sum":
        both = F.coalesce(F.col("__tm_s") + F.col("__tm_x"), "__tm_s", "__tm_x")
    elif last:
        both = F.coalesce("__tm_x", "__tm_s")
    else:  # both skip nulls
        both = (F.greatest if total == "max" else F.least)("__tm_s", "__tm_x")
    return here.select(*rows.columns, both.alias(name))
