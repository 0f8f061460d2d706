import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import together

ROW = "invoice_id string, product_id string, n_a long"


def brute(data):
    baskets = defaultdict(set)
    for b, i, _ in data:
        if b is not None:
            baskets[b].add((i or "").strip().upper())
    alone, pairs = Counter(), Counter()
    for items in baskets.values():
        items = sorted(x for x in items if x)
        alone.update(items)
        pairs.update(itertools.combinations(items, 2))
    return {p: (n, alone[p[0]], alone[p[1]], len(baskets)) for p, n in pairs.items()}


@pytest.mark.parametrize("block", [2048, 7])
def test_counts_match_brute_force(spark, block):
    r = random.Random(6)
    data = [(r.choice(["big", *map(str, range(60)), None]), r.choice([" a1", "A1 ", "b2", None, " ", *(f"p{k}" for k in range(30))]), 1) for _ in range(900)]
    pairs = together.pair_counts(spark.createDataFrame(data, ROW), "invoice_id", together.clean_item("product_id"), block_items=block)
    got = {(x.item_a, x.item_b): (x.n_together, x.n_a, x.n_b, x.n_baskets) for x in pairs.collect()}
    assert got == brute(data)
    assert all(abs(x.lift - x.n_together * x.n_baskets / (x.n_a * x.n_b)) < 1e-9 for x in pairs.collect())


def test_small_task_blocks(spark, monkeypatch):
    data = [(str(k % 9), f"p{k % 13}", 1) for k in range(500)]
    monkeypatch.setattr(together, "BLOCK_ENTRIES", 50)
    import pandas as pd

    baskets = defaultdict(set)
    for b, i, _ in data:
        baskets[b].add(int(i[1:]))
    frame = pd.DataFrame({"slots": [sorted(v) for v in baskets.values()]})
    out = pd.concat(together._one_block(iter([frame]))).groupby(["la", "lb"])["n"].sum().to_dict()
    assert {(f"P{a}", f"P{b}") if f"P{a}" < f"P{b}" else (f"P{b}", f"P{a}"): n for (a, b), n in out.items()} == {p: v[0] for p, v in brute(data).items()}


def test_support_loses_no_pair(spark):
    r = random.Random(8)
    data = [(str(r.randint(0, 80)), f"p{min(r.randint(0, 25), r.randint(0, 25))}", 1) for _ in range(800)]
    df = spark.createDataFrame(data, ROW)
    got = {(x.item_a, x.item_b): x.n_together for x in together.pair_counts(df, "invoice_id", together.clean_item("product_id"), 5, 20).collect()}
    assert got == {p: v[0] for p, v in brute(data).items() if v[0] >= 5 and v[0] * 20 >= v[3]}
    strong = {(x.item_a, x.item_b) for x in together.strong_pairs(together.pair_counts(df, "invoice_id", together.clean_item("product_id")), 3, 50, 1).collect()}
    assert strong == {p for p, (n, a, b, t) in brute(data).items() if n >= 3 and n * 50 >= t and n * t >= a * b}


def test_empty_and_single(spark):
    assert together.pair_counts(spark.createDataFrame([], ROW), "invoice_id", together.clean_item("product_id")).count() == 0
    lone = spark.createDataFrame([("1", "a", 1), ("1", " A ", 1), (None, "b", 1), ("2", None, 1)], ROW)
    assert together.pair_counts(lone, "invoice_id", together.clean_item("product_id")).count() == 0


def test_counts_are_combined_before_they_move(spark):
    r = random.Random(11)
    data = [(str(k), f"p{i}", 1) for k in range(40) for i in r.sample(range(30), 12)]
    often = [(f"{k}-{b}", i, n) for k in range(20) for b, i, n in data]
    rows = []
    for part in (data, often):
        members = together.memberships(spark.createDataFrame(part, ROW), "invoice_id", together.clean_item("product_id"))
        items = together.dictionary(members, 1, 8)
        vectors = members.join(items, "item").groupBy("basket", "block").agg(F.sort_array(F.collect_list("slot")).alias("slots"))
        rows.append((together.tile_counts(vectors).count(), vectors.agg(F.max("block")).first()[0]))
    assert rows[0][0] == rows[1][0] == len(brute(data)) and rows[0][1] > 2


def test_one_basket_of_very_many_items(spark):
    r = random.Random(12)
    big = [("big", f"p{k}", 1) for k in range(50_000)]
    data = big + [(str(b), f"p{r.randrange(1500)}", 1) for b in range(600) for _ in range(8)]
    got = {(x.item_a, x.item_b): x.n_together for x in together.pair_counts(spark.createDataFrame(data, ROW), "invoice_id", together.clean_item("product_id"), 2, block_items=256).collect()}
    small = Counter()
    baskets = defaultdict(set)
    for b, i, _ in data[len(big) :]:
        baskets[b].add(i.upper())
    for items in baskets.values():
        small.update(itertools.combinations(sorted(items), 2))
    assert got == {p: n + 1 for p, n in small.items()}
