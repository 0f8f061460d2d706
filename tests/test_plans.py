import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.plans import repair, simulate

SHEET = "source_row_number int, Invoice string, StockCode string, Quantity int, InvoiceDate timestamp_ntz, Price double, `Customer ID` string, Country string"


@pytest.fixture(scope="module")
def sheet(spark):
    rows = [(k, f"53{k}", "A", k, dt.datetime(2011, 1, 1 + k % 28), 1.5 * k, str(k) if k % 3 else None, "UK") for k in range(2, 42)]
    return spark.createDataFrame(rows, SHEET).cache()


def test_plan_order_and_lineage(spark):
    rows = [("f", 2, "1", "$1.00", "1/2/2011 9:05"), ("f", 3, "1", "$1.00", "1/2/2011 9:05"), ("f", 4, "1", "1.00", "13/2/2011 9:05")]
    df = spark.createDataFrame(rows, "source_file_id string, source_row_number int, Units string, Price string, InvoiceDate string")
    plan = [
        repair.Step("confirm_date_format", {"column": "InvoiceDate"}), repair.Step("confirm_numeric_format", {"columns": ["Price"]}),
        repair.Step("deduplicate_in_silver"), repair.Step("map_columns", {"mapping": {"Units": "Quantity"}}),
    ]
    out = repair.apply_plan(df, plan, {s.operation for s in plan}).orderBy("source_row_number").collect()
    # equal after parsing, but not as raw cells, so row 4 stays
    assert [(r.source_row_number, r.Quantity, float(r.Price), r.InvoiceDate) for r in out] == [(2, "1", 1.0, dt.datetime(2011, 2, 1, 9, 5)), (4, "1", 1.0, dt.datetime(2011, 2, 13, 9, 5))]
    with pytest.raises(PermissionError):
        repair.apply_plan(df, plan, {"map_columns"})
    with pytest.raises(ValueError, match="unknown"):
        repair.apply_plan(df, [repair.Step("drop_all")])
    with pytest.raises(ValueError, match="collide"):
        repair.map_columns(df, {"Units": "Price"})
    with pytest.raises(ValueError, match="no such"):
        repair.map_columns(df, {"Nope": "Price"})


def test_division_stops_on_zero(spark):
    df = spark.createDataFrame([(6.0, 4), (1.0, 0)], "sales double, quantity int")
    assert repair.divide_columns(df.where("quantity > 0"), "sales", "quantity", "price").first().price == 1.5
    with pytest.raises(Exception, match="division without a value"):
        repair.divide_columns(df, "sales", "quantity", "price").collect()


def test_seals():
    sealed = repair.seal({"b": 1, "a": [1, None]})
    assert repair.unseal(sealed) == {"b": 1, "a": [1, None]} and repair.seal({"a": [1, None], "b": 1}) == sealed
    with pytest.raises(ValueError, match="changed"):
        repair.unseal(sealed | {"b": 2})


@pytest.mark.parametrize("scenario", list(simulate.SCENARIOS))
def test_corruptions_repeat(sheet, scenario):
    seed = simulate.scenario_seed(42, 1, scenario)
    one, two = (simulate.corrupt(df, scenario, seed) for df in (sheet, sheet.repartition(5)))
    assert one.columns == two.columns and sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    assert simulate.corrupt(sheet.limit(0), scenario, seed).count() == 0


def test_corruptions_have_their_size(sheet):
    count = lambda name, where: simulate.corrupt(sheet, name, 7).where(where).count()
    assert count("currency_strings", F.col("Price").startswith("$")) == 10
    assert count("date_format_changes", F.col("InvoiceDate").contains("/")) == 10
    assert count("duplicate_rows", F.lit(True)) == 46
    known = sheet.where("`Customer ID` is not null").count()
    assert count("missing_customer_ids", F.col("Customer ID").isNotNull()) == known - -(-known // 2)
    assert count("incomplete_file", F.lit(True)) == 4
    assert len(simulate.corrupt(sheet, "missing_required_column", 7).columns) == len(sheet.columns) - 1
    assert len(simulate.corrupt(sheet, "unexpected_columns", 7).columns) == len(sheet.columns) + 2
    assert len(set(simulate.corrupt(sheet, "renamed_columns", 7).columns) - set(sheet.columns)) == 2
