import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from millrace.sources import jsonl, xlsx
from millrace.streaming import intake


def book(path, rows, sheets=("Transactions",)):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(xlsx.workbook_bytes({s: rows for s in sheets}))


ROWS = [["Invoice", "Quantity", "InvoiceDate", "Country"], [536365, 6, dt.datetime(2011, 1, 2, 9, 30), "NA"], ["C5363", -1.5, None, " <b> & "], [None, None, None, "=1+1"]]


def test_cells_round_trip(spark, tmp_path):
    book(tmp_path / "2011-01" / "uk.xlsx", ROWS, ("Transactions", "Lookup"))
    book(tmp_path / "2011-02" / "fr.xlsx", ROWS[:2])
    cells = xlsx.read_cells(spark, str(tmp_path))
    assert cells.count() == 9 * 2 - 2 + 3 + 1 and cells.select("file").distinct().count() == 2
    one = {(r.row_number, r.header): (r.cell_type, r.raw) for r in xlsx.read_cells(spark, str(tmp_path / "2011-01"), sheet="Lookup").collect()}
    assert one[2, "Invoice"] == ("n", "536365") and one[2, "InvoiceDate"] == ("d", "2011-01-02T09:30:00")
    assert one[2, "Country"] == ("s", None) and one[3, "Country"] == ("s", " <b> & ")
    raw = xlsx.read_cells(spark, str(tmp_path / "2011-02"), na_strings=False).where("header = 'Country'").first()
    assert raw.raw == "NA"
    wide = xlsx.widen(xlsx.read_cells(spark, str(tmp_path)), ["Invoice", "Country", "Absent"]).where("sheet = 'Lookup' and row_number = 3").first()
    assert (wide.Invoice, wide.Country, wide.Absent) == ("C5363", " <b> & ", None)
    assert xlsx.sheet_headers(str(tmp_path / "2011-02" / "fr.xlsx")) == {"Transactions": ROWS[0]}


def test_equal_content_has_equal_bytes():
    assert xlsx.workbook_bytes({"A": ROWS}) == xlsx.workbook_bytes({"A": ROWS}) != xlsx.workbook_bytes({"B": ROWS})


def test_package_findings(tmp_path):
    import io
    import zipfile

    assert xlsx.package_findings(xlsx.workbook_bytes({"A": ROWS})) == []
    assert xlsx.package_findings(b"no zip") == ["workbook_read_failed"]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in ("../evil.xml", "xl/vbaProject.bin", "xl/activeX/a.xml", "xl/externalLinks/b.xml"):
            z.writestr(name, "0" * 10)
        z.writestr("xl/big.xml", "0" * 3_000_000)
    assert set(xlsx.package_findings(out.getvalue())) == {"unsafe_archive_path", "suspicious_archive_compression", "macro_content_present", "embedded_active_content_present", "external_connections_present"}


def test_unsafe_workbooks_and_hashes(spark, tmp_path, monkeypatch):
    book(tmp_path / "good.xlsx", ROWS)
    book(tmp_path / "wide.xlsx", [["h"] * 1001])
    book(tmp_path / "many.xlsx", [["h"]], [f"s{k}" for k in range(51)])
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    found = {(r.file.rsplit("/", 1)[1], r.code, r.sheet) for r in xlsx.unsafe_workbooks(spark, str(tmp_path)).collect()}
    assert found == {("wide.xlsx", "worksheet_dimension_limit_exceeded", "Transactions"), ("many.xlsx", "sheet_count_limit_exceeded", None), ("bad.xlsx", "workbook_read_failed", None)}
    hashes = {r.path.rsplit("/", 1)[1]: r.file_hash for r in xlsx.file_hashes(spark, str(tmp_path)).collect()}
    assert hashes == {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in tmp_path.iterdir()}
    spark.dataSource.register(xlsx.XlsxDataSource)
    assert spark.read.format("xlsx").load(str(tmp_path / "good.xlsx")).count() == 8


def test_formula_findings(spark):
    cells = spark.createDataFrame([("f", "S", 2, 0, "=SUM(A1)"), ("f", "S", 3, 0, "=WEBSERVICE(\"http://x\")"), ("f", "S", 4, 0, None)], "file string, sheet string, row_number int, column_index int, formula string")
    assert {(r.code, r.n) for r in xlsx.formula_findings(cells).collect()} == {("formula_cells", 1), ("external_formula_cells", 1)}


def test_workbooks_per_group(spark, tmp_path):
    df = spark.createDataFrame([("United Kingdom", "2024-01", k, k * 1.5) for k in range(5)] + [("France", "2024-02", 9, 1.0)], "Country string, reporting_month string, n int, Price double")
    written = {r.path: r for r in xlsx.write_workbooks(df, str(tmp_path), ["Country", "reporting_month"], ["Country", "n", "Price"], ["n"]).collect()}
    path = str(tmp_path / "2024-01" / "united_kingdom_2024-01.xlsx")
    assert written[path].row_count == 5 and len(written) == 2
    assert written[path].file_hash == hashlib.sha256(open(path, "rb").read()).hexdigest()
    assert xlsx.read_cells(spark, str(tmp_path)).where("header = 'n'").count() == 6


def test_integers_beside_nulls_and_full_worksheets(spark, tmp_path):
    at = dt.datetime(2024, 1, 2, 3, 4)
    rows = [("UK", "2024-01", k, None if k % 3 == 0 else 2**53 + k, at) for k in range(10)] + [("uk ", "2024-01", None, 5, None), ("France", "2024-01", 1, None, None)]
    df = spark.createDataFrame(rows, "country string, month string, row int, n long, at timestamp").repartition(3)
    written = {r.path.rsplit("/", 1)[1]: r for r in xlsx.write_workbooks(df, str(tmp_path), ["country", "month"], ["row", "n", "at"], ["row"], most=4).collect()}
    assert {f: r.row_count for f, r in written.items()} == {"uk_2024-01.xlsx": 4, "uk_2024-01_2.xlsx": 4, "uk_2024-01_3.xlsx": 3, "france_2024-01.xlsx": 1}
    assert all(r.file_hash == hashlib.sha256(open(r.path, "rb").read()).hexdigest() for r in written.values())
    cells = sorted((r.file.rsplit("/", 1)[1], r.row_number, r.header, r.raw) for r in xlsx.read_cells(spark, str(tmp_path)).where("file like '%/uk%'").collect())
    names = ["uk_2024-01.xlsx", "uk_2024-01_2.xlsx", "uk_2024-01_3.xlsx"]
    want = [(names[k // 4], k % 4 + 2, h, v) for k in range(10) for h, v in (("at", at.isoformat()), ("n", str(2**53 + k)), ("row", str(k))) if h != "n" or k % 3]
    assert cells == sorted([*want, (names[2], 4, "n", "5")])  # an empty ordering number comes last


CANONICAL = {"invoice_id": "1", "product_id": "a", "product_description": None, "quantity": 2, "transaction_timestamp": "2024-01-01T00:00:00", "unit_price": "2.50", "customer_id": None, "country": "UK", "source_file_id": "f", "source_row_number": 2}


def test_json_lines(spark, tmp_path):
    lines = [CANONICAL, CANONICAL | {"extra": 1}, {k: v for k, v in CANONICAL.items() if k != "country"}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join([*map(json.dumps, lines), "oops"]))
    rows = jsonl.read_rows(spark, str(tmp_path / "in"))
    assert sorted((r.fault or "", r.quantity) for r in rows.collect() if r.fault != "not_an_object") == [("", 2), ("unexpected_fields", 2), ("unexpected_fields", 2)]
    assert rows.where("fault = 'not_an_object'").count() == 1
    with pytest.raises(Exception, match="faulty line"):
        jsonl.require_sound(rows).collect()
    odd = {"quantity": ["many", 1.5, True, None, "2"], "invoice_id": [None, "", 7], "unit_price": [2.5, "inf", "x"], "customer_id": [5], "source_row_number": [1, "2"], "transaction_timestamp": ["2024-02-30", "soon", None], "source_file_id": [None]}
    (tmp_path / "odd.jsonl").write_text("\n".join(json.dumps(CANONICAL | {f: v}) for f, values in odd.items() for v in values))
    faults = jsonl.read_rows(spark, str(tmp_path / "odd.jsonl")).groupBy("fault").count().collect()
    assert {r.fault: r["count"] for r in faults} == {f"invalid_{f}": len(values) for f, values in odd.items()}
    good = jsonl.require_sound(rows.where("fault is null"))
    jsonl.write_rows(good, str(tmp_path / "out"))
    jsonl.write_rows(good, str(tmp_path / "out"))
    again = jsonl.require_sound(jsonl.read_rows(spark, str(tmp_path / "out"))).collect()
    assert [r.asDict() for r in again] == [CANONICAL]


def test_snapshots_swap_or_stay(spark, tmp_path):
    store = jsonl.SnapshotStore(spark, str(tmp_path / "gold"))
    assert store.current() is None
    store.swap(lambda now: spark.range(3))
    store.swap(lambda now: now.where("id > 0"))
    with pytest.raises(Exception, match="broken"):
        store.swap(lambda now: now.select(F.raise_error(F.lit("broken"))))
    assert store.current().count() == 2 and [r["status"] for r in store.runs()] == ["SUCCESS", "SUCCESS", "FAILED"]


def test_replacing_keys_leaves_other_buckets(spark, tmp_path):
    store = jsonl.SnapshotStore(spark, str(tmp_path / "gold"))
    row = "file string, n int"
    store.swap(lambda now: spark.createDataFrame([(f"f{k % 50}", k) for k in range(200)] + [(None, -1)], row))
    store.replace(spark.createDataFrame([("f0", 1000)], row), "file")
    before = set(store._list()["parts"])
    store.replace(spark.createDataFrame([("f1", 1001), ("new", 1002), (None, 1003)], row), "file")
    after = set(store._list()["parts"])
    assert len(after - before) <= 3 < len(after & before)
    got = sorted((r.file or "", r.n) for r in store.current().collect())
    want = [(f"f{k % 50}", k) for k in range(200) if k % 50 > 1] + [("f0", 1000), ("f1", 1001), ("new", 1002), ("", 1003)]
    assert got == sorted(want)
    with pytest.raises(Exception, match="broken"):
        store.replace(spark.createDataFrame([("f2", 1)], row).withColumn("n", F.raise_error(F.lit("broken")).cast("int")), "file")
    assert sorted((r.file or "", r.n) for r in store.current().collect()) == got


def test_stream_replaces_inputs(spark, tmp_path):
    store, inbox = jsonl.SnapshotStore(spark, str(tmp_path / "gold")), str(tmp_path / "inbox")
    for batch in ([("f", 1), ("g", 2)], [("g", 3), ("g", 4)]):
        spark.createDataFrame(batch, "file string, n int").coalesce(1).write.mode("append").parquet(inbox)
        intake.follow(spark, "file string, n int", inbox, store, "file", str(tmp_path / "check")).awaitTermination(60)
    assert sorted(tuple(r) for r in store.current().collect()) == [("f", 1), ("g", 3), ("g", 4)]
