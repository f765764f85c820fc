"""Consistency checks over operation histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.fold import running


def register_violations(history: DataFrame) -> DataFrame:
    """(k, ts, is_read, value): reads of sequential histories that do not see the last write (Z8);
    before any write a register holds null."""
    write = F.when(~F.col("is_read"), F.col("value"))
    seen = running(history, ["k"], ["ts"], write, "last", F.col("ts"), "expected", own=False)
    return seen.where(F.col("is_read") & ~F.col("value").eqNullSafe(F.col("expected")))


def linearizable(history: DataFrame) -> DataFrame:
    """(k, client, is_read, value, call, ret) -> (k, ok): a full search for a linear order of each
    register by depth-first search with memory; exponential in the number of concurrent operations
    at worst, so keys must hold short histories.  An operation without times fits no order.

    Rows are dealt by key and sorted, and one history at a time is gathered from Arrow batches: a
    table of many short histories costs no call and no frame for each."""

    def run(batches):
        import pyarrow as pa

        kept, key, ops = [], object(), None
        for b in batches:
            keys, columns = b.column(0).to_pylist(), [b.column(i).to_pylist() for i in range(1, 5)]
            for k, *op in zip(keys, *columns, strict=True):
                if k != key:
                    if ops is not None:
                        kept.append((key, _has_order(ops)))
                    key, ops = k, []
                ops.append(op)
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.int64()), pa.array([ok for _, ok in kept], pa.bool_())], ["k", "ok"])
                kept = []
        if ops is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([_has_order(ops)], pa.bool_())], ["k", "ok"])

    rows = history.select(F.col("k").cast("long").alias("k"), "is_read", "value", "call", "ret")
    return rows.repartition("k").sortWithinPartitions("k", "call", "ret").mapInArrow(run, "k long, ok boolean")


def _has_order(ops: list) -> bool:
    """Whether operations [is_read, value, call, ret] by call have a linear order, from the value null."""
    if any(call is None or ret is None for _, _, call, ret in ops):
        return False
    n = len(ops)
    whole, bits = (1 << n) - 1, [(1 << i, *op) for i, op in enumerate(ops)]
    by_ret = sorted((ret, bit) for bit, _, _, _, ret in bits)
    seen, stack = set(), [(0, None)]
    while stack:
        state = stack.pop()
        if state in seen:
            continue
        seen.add(state)
        done, value = state
        for first_ret, bit in by_ret:  # the earliest end of those left
            if not done & bit:
                break
        nexts = []
        for bit, is_read, v, call, _ in bits:
            if call > first_ret:  # nor any later one
                break
            if not done & bit and (not is_read or v == value):
                if done | bit == whole:
                    return True
                nexts.append((done | bit, value if is_read else v))
        stack.extend(reversed(nexts))  # the earliest call first
    return n == 0
