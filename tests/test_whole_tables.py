"""Queries without an SQL twin cover their whole tables, against brute force on small fixtures."""

import pytest

from clauselens.plans import registry


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    orders = [(k, (k * k * 7 + k // 3) % 1009, "FOP"[k * k % 3]) for k in range(1, 1200, 2)]
    parts = [(k, f"b{k % 7}", f"t{k % 5}", k % 11, f"n{k % 3}") for k in range(1, 801)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string").write.parquet(f"{at}/orders.parquet")
    spark.createDataFrame(parts, "p_partkey bigint, p_brand string, p_type string, p_size int, p_name string").write.parquet(f"{at}/part.parquet")
    return at, orders, parts


def test_rename_replay(spark, folder):
    at, orders, _ = folder
    rows = sorted((k, c % 30, (c * 7 + 1) % 30) for k, c, _ in orders)
    want = {}
    for n, (_, old, new) in enumerate(rows):
        if old not in want:
            for _, a, b in rows[n + 1 :]:
                new = b if a == new else new
            want[old] = new
    got = [(r.old, r.new) for r in registry.QUERIES["rename_replay"](spark, at).collect()]
    assert sorted(got) == sorted(want.items())


def test_deontic_statuses(spark, folder):
    at, orders, _ = folder
    a = {(c % 60, {"F": "forbid", "O": "oblige"}.get(s, "permit"), k % 12) for k, c, s in orders}
    stands = {}
    for p, d, act in sorted(a):  # a smaller passage beats
        stands[p, d, act] = not any(
            stands[q, e, act] for q, e, other in a if other == act and q < p and (p + q) % 3 == 0 and (d == "forbid") != (e == "forbid")
        )
    got = {(r.p, r.d, r.act): r.stands for r in registry.QUERIES["deontic_statuses"](spark, at).collect()}
    assert got == stands


def test_readback_trials(spark, folder):
    at, _, parts = folder
    got = registry.QUERIES["readback_trials"](spark, at).collect()
    brand = {k: b for k, b, *_ in parts}
    assert {r.id for r in got if r.answer and r.option == r.id} == set(brand)
    assert len(got) == 4 * len(brand) and all(brand[r.id] == brand[r.option] for r in got)
