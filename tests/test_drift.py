import itertools
import json
import random

import numpy as np

from millrace.operators import drift

ARRIVAL = "intake_id long, client_id string, received_at timestamp, selected_sheet string, observed_schema array<string>, observed_types array<string>"


def test_assignment_is_optimal():
    r = np.random.default_rng(1)
    for _ in range(60):
        n, m = map(int, r.integers(1, 6, 2))
        score = r.random((n, m)).round(2)
        best = max(sum(score[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n)) if n <= m else max(sum(score[p[j], j] for j in range(m)) for p in itertools.permutations(range(n), m))
        found = drift.assign(score)
        assert len({i for i, _ in found}) == len(found) == min(n, m) and abs(sum(score[i, j] for i, j in found) - best) < 1e-9


def setup(spark):
    import datetime as dt

    day = lambda k: dt.datetime(2024, 1, k)
    arrivals = [
        (1, "a", day(1), "Data", ["Invoice", "StockCode", "Qty"], ["int", "string", "int"]),
        (2, "a", day(2), "DATA ", ["StockCode ", "INVOICE", "Qty"], ["string", "int", "int"]),
        (3, "a", day(3), None, None, None),
        (4, "a", day(3), "Lines", ["Bill No", "Stk Cde", "Quantity", "Extra"], ["int", "string", "double", "string"]),
        (5, "a", day(3), "Lines", [], []),
        (6, "b", day(1), "Data", ["Invoice", None, "Qty"], ["int", "string", "int"]),
    ]
    records = [(1, 2, json.dumps({"Invoice": 400001, "StockCode": "12345A", "Qty": 3})), (4, 2, json.dumps({"Bill No": 400009, "Stk Cde": "54321B", "Quantity": 2.0, "Extra": "x"})), (4, 3, None), (4, 4, "no json")]
    aliases = [("invoice", "invoice"), ("billno", "invoice"), ("stockcode", "product"), ("qty", "quantity"), ("quantity", "quantity")]
    return (
        spark.createDataFrame(arrivals, ARRIVAL),
        spark.createDataFrame(records, "intake_id long, source_row_number int, payload string"),
        spark.createDataFrame(aliases, "alias_name string, field_name string"),
    )


def test_changes(spark):
    found = {(r.intake_id, r.change_kind, r.field_name) for r in drift.schema_changes(*setup(spark)).collect()}
    assert found == {
        (4, "renamed", "invoice"), (4, "renamed", "quantity"), (4, "retyped", "quantity"), (4, "added", "stkcde"), (4, "added", "extra"), (4, "removed", "product"),
        (4, "likely_renamed", "stkcde"), (4, "sheet", "selected_sheet"),
        *((5, "removed", f) for f in ("invoice", "stkcde", "quantity", "extra")),
    }


def test_unified(spark):
    _, records, aliases = setup(spark)
    got = {(r.intake_id, r.source_row_number): r for r in drift.unified_records(records, aliases).collect()}
    assert len(got) == 4
    assert (got[1, 2].invoice, got[1, 2].product, got[1, 2].quantity) == ("400001", "12345A", "3")
    assert (got[4, 2].invoice, got[4, 2].product, got[4, 2].quantity) == ("400009", None, "2")
    assert json.loads(got[4, 2].extras) == [{"field": "extra", "value": "x"}, {"field": "stkcde", "value": "54321B"}]
    assert got[4, 3].invoice is None and got[4, 4].invoice is None


def test_matched_renames_reach_the_table(spark):
    arrivals, records, aliases = setup(spark)
    changes = drift.schema_changes(arrivals, records, aliases)
    assert {tuple(r) for r in drift.learned_fields(changes, aliases).collect()} == {("stkcde", "product")}
    got = {(r.intake_id, r.source_row_number): r for r in drift.unified_records(records, aliases, changes).collect()}
    assert (got[4, 2].product, float(got[4, 2].quantity_value), got[4, 2].price_value) == ("54321B", 2.0, None)
    assert json.loads(got[4, 2].extras) == [{"field": "extra", "value": "x"}] and got[1, 2].product == "12345A"
    # known to the registry only afterwards: the match counts backwards too
    later = aliases.where("alias_name <> 'stockcode'").unionByName(spark.createDataFrame([("stkcde", "product")], "alias_name string, field_name string"))
    assert {tuple(r) for r in drift.learned_fields(drift.schema_changes(arrivals, records, later), later).collect()} == {("stockcode", "product")}


def test_order_of_headers_is_no_change(spark):
    arrivals, records, aliases = setup(spark)
    r = random.Random(1)
    names = ["Invoice", "StockCode", "Qty", "Remark"]
    rows = [(k, "z", None, "S", r.sample(names, 4), ["string"] * 4) for k in range(1, 8)]
    same = spark.createDataFrame(rows, ARRIVAL)
    assert drift.schema_changes(same, records, aliases).count() == 0
    assert drift.schema_changes(arrivals.limit(0), records, aliases).count() == 0
