"""Every registered query of the catalogue against its SQL, on the smallest tables."""

import os
from collections import Counter
from itertools import permutations

import compare
import pytest

from tidemark.plans import catalogue

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(DIR):
        pytest.skip("no test data")
    return compare.oracle(DIR)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_matches_sql(spark, con, name):
    assert compare.same(catalogue.QUERIES[name](spark, DIR), con, catalogue.SQL[name]) is None


def test_every_order_is_probed(spark):
    keys = {r[0] for r in catalogue.table(spark, DIR, "orders").select("o_orderkey").collect()}
    held = [tuple(r) for r in catalogue.files(spark, DIR).select("level", "lo", "hi").collect()]
    want = Counter((k, level) for k in keys for level, lo, hi in held if lo <= k <= hi)
    assert {(r.k, r.level): r.files for r in catalogue.QUERIES["level_probe"](spark, DIR).collect()} == want


def test_every_version_is_asked_for_and_ranked(spark):
    log = [(r.k, r.ts) for r in catalogue.log_of(spark, DIR).collect()]
    of = {}
    for k, ts in sorted(log):
        of.setdefault(k, []).append(ts)
    asked = {(r.k, r["at"]): r.ts for r in catalogue.QUERIES["asof_read"](spark, DIR).collect()}
    assert asked == {(k, ts - 1): of[k][i - 1] if i else None for k in of for i, ts in enumerate(of[k])}
    ranks = {(r.k, r.ts): r.rn for r in catalogue.QUERIES["version_rank"](spark, DIR).collect()}
    assert ranks == {(k, ts): len(of[k]) - i for k in of for i, ts in enumerate(of[k])}
    found = {r.target: r.k for r in catalogue.QUERIES["seek_lower_bound"](spark, DIR).collect()}
    wanted = [r.k for r in catalogue.requests(spark, DIR).collect()]
    assert found == {t: min((k for k in of if k >= t), default=None) for t in wanted}


def test_multi_key_outcomes_by_replay(spark):
    rows = [(r.req, r.txn, r.k, r.snap) for r in catalogue.txns(spark, DIR).collect()]
    last, want = {}, {}
    for req, t, k, snap in sorted(rows):
        keys = {k, k // 10 * 10 + t % 10}
        want[t] = all(last.get(x, -1) <= snap for x in keys)
        if want[t]:
            last.update(dict.fromkeys(keys, req))
    assert {r.txn: r.committed for r in catalogue.QUERIES["multi_key_outcomes"](spark, DIR).collect()} == want
    assert 0 < sum(want.values()) < len(want)


def test_linearizable_by_all_orders(spark):
    ops = {}
    for r in catalogue.table(spark, DIR, "events").collect():
        i = r.event_id
        ops.setdefault(i // 6, []).append((r.user_id % 2 == 0, str(r.user_id % 3), i * 10, i * 10 + 5 + r.user_id % 20))

    def fits(order):
        value = None
        for i, (read, v, call, _) in enumerate(order):
            if read and v != value or any(ret < call for *_, ret in order[i + 1 :]):
                return False
            value = value if read else v
        return True

    want = {k: any(fits(p) for p in permutations(x)) for k, x in ops.items()}
    assert {r.k: r.ok for r in catalogue.QUERIES["linearizable"](spark, DIR).collect()} == want and len(set(want.values())) == 2


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(catalogue.SQL) <= set(e.oracle_sql()) and set(e.oracle_sql()) <= set(e.queries())
