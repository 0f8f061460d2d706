import random
from collections import Counter, defaultdict

import pytest

from millrace.operators import ordered, skew

SILVER = "country string, customer_id string, quantity int, product_id string, _file string"


def rows(n=900, seed=3):
    r = random.Random(seed)
    return [(r.choice(["UK"] * 8 + ["DE", " ", None]), r.choice([*["100010"] * 5, *map(str, range(30)), None, ""]), r.choice([1, 2, -1, None]), r.choice("abc"), "x") for _ in range(n)]


@pytest.mark.parametrize(("chunk", "block"), [(7, 50), (10_000, 1 << 20), (1, 1)])
def test_key_results_match_brute_force(spark, tmp_path, chunk, block):
    data = rows()
    path = str(tmp_path / "silver")
    spark.createDataFrame(data, SILVER).coalesce(1).write.parquet(path)
    stored = spark.read.parquet(path)
    order = [tuple(r) for r in stored.collect()]
    got = {(r.field_name, r.key_value): r for r in skew.key_results(stored, ["country", "customer_id"], chunk, block).collect()}
    want = defaultdict(list)
    for r in order:
        want["country", r[0]].append(r)
        want["customer_id", r[1]].append(r)
    assert set(got) == set(want)
    for key, own in want.items():
        g = got[key]
        sums = [x[2] for x in own if x[2] is not None]
        assert (g.n_rows, g.total_quantity) == (len(own), sum(sums) if sums else None)
        assert (g.first_state, g.last_state) == (own[0][3], own[-1][3])
        assert g.n_changes == sum(a[3] != b[3] for a, b in zip(own, own[1:]))


def test_numbers_are_complete_per_key(spark):
    df = spark.createDataFrame(rows(200), SILVER).repartition(5)
    placed = skew.number_rows(skew.located(df, ["country"]), ["country"], 16)
    by = defaultdict(list)
    for r in placed.collect():
        by[r.country].append(r._number)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and sum(map(len, by.values())) == 200


def test_heavy_keys_leave_out_blank_and_light(spark):
    data = [("UK", str(k), 1, "a", "") for k in range(98)] + [("DE", " ", 1, "a", ""), (None, None, 1, "a", "")]
    df = spark.createDataFrame(data + [("  ", "7", 1, "a", "")] * 9, SILVER)
    found = {tuple(r) for r in skew.heavy_keys(skew.key_results(df, ["country", "customer_id"])).collect()}
    assert found == {("country", "UK"), ("customer_id", "7")}


def test_empty_table(spark):
    empty = spark.createDataFrame([], SILVER)
    assert skew.heavy_keys(skew.key_results(empty, ["country", "customer_id"])).count() == 0


def test_prefix_sums_and_neighbours(spark):
    r = random.Random(1)
    data = [(r.choice(["a"] * 9 + ["b", None]), k, r.choice([1, 2, None])) for k in range(300)]
    df = spark.createDataFrame(data, "g string, o int, w int").repartition(7)
    out = {(x.g, x.o): x.cum for x in ordered.range_prefix_sums(df, ["g"], ["o"], {"cum": "w"}).collect()}
    run = Counter()
    for g, o, w in sorted(data, key=lambda x: x[1]):
        run[g] += w or 0
        assert out[g, o] == run[g]
    before = {(x.g, x.o): (x.position, x.prev_o) for x in ordered.with_previous(df, ["g"], ["o"], ["o"]).collect()}
    seen = defaultdict(list)
    for g, o, _ in sorted(data, key=lambda x: x[1]):
        assert before[g, o] == (len(seen[g]) + 1, seen[g][-1] if seen[g] else None)
        seen[g].append(o)


def test_kept_tables_are_released(spark):
    from millrace import session

    kept = session.kept(spark.range(5))
    assert kept.count() == 5
    folder = session.Folder(spark, session._kept_dir(spark))
    assert folder.names()
    session.release(spark)
    assert not folder.exists()
