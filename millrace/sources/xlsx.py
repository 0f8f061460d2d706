"""Workbooks (.xlsx) as a Spark data source, read and written with the standard library.

``read_cells`` gives one row per cell.  Files are listed and read by Spark's binary source, from any
file system it knows, packed into tasks by their size; a task unpacks one sheet at a time.  The
same reader serves ``spark.read.format("xlsx")`` for paths that all machines mount, with a
workbook per partition.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import io
import itertools
import re
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from pathlib import Path
from typing import BinaryIO
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.functions.text import slug
from millrace.operators.ordered import range_prefix_sums

SCHEMA = "file string, sheet string, row_number int, column_index int, header string, cell_type string, raw string, formula string"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# fixed values: texts that a spreadsheet reader takes for empty
NA_STRINGS = frozenset(
    ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
)
# fixed values: limits of a workbook that is opened
MAX_FILE, MAX_UNPACKED, MAX_RATIO, MAX_SHEETS, MAX_ROWS, MAX_COLUMNS = 100 << 20, 500 << 20, 200, 50, 1_000_000, 1_000
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 27, 30, 36, 45, 46, 47, 50, 57}


def _column(ref: str) -> int:
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def _day(serial: float) -> str:
    at = dt.datetime(1899, 12, 30) + dt.timedelta(seconds=round(serial * 86400))
    return at.isoformat()


class Workbook:
    """A workbook's parts, opened once."""

    def __init__(self, data: bytes | str | Path):
        self.zip = zipfile.ZipFile(io.BytesIO(data) if isinstance(data, bytes) else data)
        names = set(self.zip.namelist())
        rels = ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))
        targets = {r.get("Id"): r.get("Target") for r in rels}
        book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        place = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
        self.sheets = {s.get("name"): place(targets[s.get(f"{_REL}id")]) for s in book.iter(f"{_MAIN}sheet")}
        self.strings = []
        if "xl/sharedStrings.xml" in names:
            for _, e in ElementTree.iterparse(self.zip.open("xl/sharedStrings.xml")):
                if e.tag == f"{_MAIN}si":
                    self.strings.append("".join(t.text or "" for t in e.iter(f"{_MAIN}t")))
                    e.clear()
        self.dates = self._date_styles() if "xl/styles.xml" in names else set()

    def _date_styles(self) -> set[int]:
        styles = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
        own = {int(f.get("numFmtId")) for f in styles.iter(f"{_MAIN}numFmt") if re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode") or ""), re.I)}
        formats = styles.find(f"{_MAIN}cellXfs")
        return {k for k, x in enumerate(formats if formats is not None else []) if int(x.get("numFmtId") or 0) in _DATE_FORMATS | own}

    def cells(self, sheet: str) -> Iterator[tuple[int, int, str, str | None, str | None]]:
        """(row, column, type, text, formula): types are s text, n number, d date, b logical, e error."""
        for _, e in ElementTree.iterparse(self.zip.open(self.sheets[sheet])):
            if e.tag != f"{_MAIN}row":
                continue
            row = int(e.get("r"))
            for c in e.iter(f"{_MAIN}c"):
                kind, value, formula = c.get("t") or "n", c.find(f"{_MAIN}v"), c.find(f"{_MAIN}f")
                text = value.text if value is not None else None
                if kind == "s":
                    text = self.strings[int(text)] if text else None
                elif kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                elif kind == "n" and text is not None and int(c.get("s") or 0) in self.dates:
                    kind, text = "d", _day(float(text))
                kind = {"inlineStr": "s", "str": "s"}.get(kind, kind)
                yield row, _column(c.get("r")), kind, text, formula.text if formula is not None else None
            e.clear()


def package_findings(data: bytes) -> list[str]:
    """What is unsafe about a workbook's package, from its central directory only."""
    found = ["file_size_limit_exceeded"] if len(data) > MAX_FILE else []
    try:
        entries = zipfile.ZipFile(io.BytesIO(data)).infolist()
    except zipfile.BadZipFile:
        return [*found, "workbook_read_failed"]
    names = [e.filename.lower() for e in entries]
    unpacked, packed = sum(e.file_size for e in entries), sum(e.compress_size for e in entries)
    parts = lambda *words: any(w in n for n in names for w in words)
    checks = {
        "unsafe_archive_path": any(n.startswith(("/", "\\")) or ".." in n.replace("\\", "/").split("/") for n in names),
        "suspicious_archive_compression": unpacked > MAX_UNPACKED or unpacked > MAX_RATIO * max(packed, 1),
        "macro_content_present": parts("vbaproject.bin", "macrosheets/"),
        "embedded_active_content_present": parts("activex/", "embeddings/"),
        "external_connections_present": parts("externallinks/", "connections.xml"),
    }
    return found + [code for code, hit in checks.items() if hit]


def workbook_findings(data: bytes) -> list[tuple[str, str | None]]:
    """(code, sheet) of what is unsafe about a workbook: its package, the number of its sheets and their extent."""
    found = [(code, None) for code in package_findings(data)]
    if found:
        return found  # not opened any further
    book = Workbook(data)
    if len(book.sheets) > MAX_SHEETS:
        return [("sheet_count_limit_exceeded", None)]
    for sheet in book.sheets:
        rows = columns = 0
        for row, column, *_ in book.cells(sheet):
            rows, columns = max(rows, row), max(columns, column + 1)
            if rows > MAX_ROWS or columns > MAX_COLUMNS:
                found.append(("worksheet_dimension_limit_exceeded", sheet))
                break
    return found


def rows_of(data: bytes, file: str, wanted: str | None, empty: bool) -> Iterator[tuple]:
    """Cells of a workbook under its header row, as in ``SCHEMA``."""
    book = Workbook(data)
    for sheet in [s for s in book.sheets if wanted in (None, s)]:
        headers: dict[int, str | None] = {}
        for row, column, kind, text, formula in book.cells(sheet):
            if row == 1:
                headers[column] = text
            elif not (text is None and formula is None):
                value = None if empty and kind == "s" and text in NA_STRINGS else text
                yield file, sheet, row, column, headers.get(column), kind, value, formula


class XlsxPartition(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class XlsxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        root = Path(self.options["path"].removeprefix("file://"))
        files = [root] if root.is_file() else sorted(root.rglob("*.xlsx"))
        return [XlsxPartition(str(p)) for p in files]

    def read(self, partition: XlsxPartition) -> Iterator[tuple]:
        wanted, empty = self.options.get("sheet"), str(self.options.get("nastrings", "true")).lower() == "true"
        yield from rows_of(Path(partition.path).read_bytes(), partition.path, wanted, empty)


class XlsxDataSource(DataSource):
    """Cells of workbooks under a path that all machines mount."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return XlsxReader({k.lower(): v for k, v in self.options.items()})


def files(spark: SparkSession, path: str, pattern: str = "*.xlsx") -> DataFrame:
    """``path``, ``length`` and ``content`` of files under a folder, through Hadoop's file system."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "length", "content")


def file_hashes(spark: SparkSession, path: str, pattern: str = "*.xlsx") -> DataFrame:
    """``path``, ``length`` and ``file_hash``, the SHA-256 of each file's bytes."""
    return files(spark, path, pattern).select("path", "length", F.sha2("content", 256).alias("file_hash"))


def read_cells(spark: SparkSession, path: str, sheet: str | None = None, na_strings: bool = True) -> DataFrame:
    """Cells of all workbooks under ``path``; ``na_strings`` turns the usual placeholders of empty cells into nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            for r in batch.itertuples():
                cells = rows_of(r.content, r.path, sheet, na_strings)
                while part := list(itertools.islice(cells, 20_000)):
                    yield pd.DataFrame(part, columns=names)

    return files(spark, path).select("path", "content").mapInPandas(run, SCHEMA)


def unsafe_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``code`` and ``sheet`` of the findings of ``workbook_findings`` over all workbooks under ``path``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(r.path, code, sheet) for r in batch.itertuples() for code, sheet in workbook_findings(r.content)], columns=["file", "code", "sheet"])

    return files(spark, path).select("path", "content").mapInPandas(run, "file string, code string, sheet string")


def widen(cells: DataFrame, headers: list[str]) -> DataFrame:
    """One row per sheet row with a text column per header; a header that is missing gives nulls."""
    return cells.groupBy("file", "sheet", "row_number").pivot("header", headers).agg(F.first("raw", ignorenulls=True))


def sheet_headers(path: str) -> dict[str, list[str | None]]:
    """Header row per sheet, without reading further rows."""
    book, out = Workbook(path), {}
    for sheet in book.sheets:
        out[sheet] = []
        for row, _, _, text, _ in book.cells(sheet):
            if row > 1:
                break
            out[sheet].append(text)
    return out


def formula_findings(cells: DataFrame, most: int = 20) -> DataFrame:
    """Per file: formulas that reach outside and other formulas, with counts and the first places."""
    from millrace.functions.text import external_formula

    code = F.when(external_formula(F.col("formula")), "external_formula_cells").otherwise("formula_cells")
    hit = cells.where(F.col("formula").isNotNull()).select("file", code.alias("code"), "sheet", "row_number", "column_index")
    key = ["file", "code"]
    counted = hit.groupBy(*key, "sheet", "row_number", "column_index").agg(F.count("*").alias("_n"))
    ranked = range_prefix_sums(counted, key, ["sheet", "row_number", "column_index"], {"_upto": "_n"})
    first = F.when(F.col("_upto") <= most, F.struct("sheet", "row_number", "column_index"))
    return ranked.groupBy(*key).agg(F.max("_upto").alias("n"), F.array_sort(F.collect_list(first)).alias("places"))


def _name(k: int) -> str:
    out = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out


def _parts(sheets: list[str]) -> dict[str, str]:
    """Parts of a workbook's package beside its sheets."""
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main, rel = _MAIN[1:-1], _REL[1:-1]
    package = "http://schemas.openxmlformats.org/package/2006"
    return {
        "[Content_Types].xml": f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>'
        + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(sheets) + 1)) + "</Types>",
        "_rels/.rels": f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + f'<Relationship Id="rId{len(sheets) + 1}" Type="{rel}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'{head}<styleSheet xmlns="{main}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>',
    }


def _cell(ref: str, v) -> str:  # noqa: ANN001
    if v is None or v != v:
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, int | float):
        return f'<c r="{ref}"><v>{v!r}</v></c>'
    if isinstance(v, dt.datetime):
        return f'<c r="{ref}" s="1"><v>{(v.replace(tzinfo=None) - dt.datetime(1899, 12, 30)).total_seconds() / 86400!r}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'


def _write_book(out: BinaryIO, sheets: dict[str, Iterable[Sequence]]) -> None:
    """Write a workbook to a seekable file; rows are taken one by one and only a few are held."""
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        entry = lambda name: zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
        for name, text in _parts(list(sheets)).items():
            z.writestr(entry(name), text, zipfile.ZIP_DEFLATED)
        for k, rows in enumerate(sheets.values(), 1):
            info = entry(f"xl/worksheets/sheet{k}.xml")
            info.compress_type = zipfile.ZIP_DEFLATED
            with z.open(info, "w") as part:
                part.write(f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="{_MAIN[1:-1]}"><sheetData>'.encode())
                numbered, names = enumerate(rows, 1), []
                while some := list(itertools.islice(numbered, 1000)):
                    names += [_name(c) for c in range(len(names), max(len(row) for _, row in some))]
                    part.write("".join(f'<row r="{r}">' + "".join([_cell(f"{n}{r}", v) for n, v in zip(names, row)]) + "</row>" for r, row in some).encode())
                part.write(b"</sheetData></worksheet>")


def workbook_bytes(sheets: dict[str, list[list]]) -> bytes:
    """A workbook with a table per sheet; numbers stay numbers, datetimes become dates, None is no cell.

    The bytes depend on the content only, so equal content has equal hashes.
    """
    out = io.BytesIO()
    _write_book(out, sheets)
    return out.getvalue()


def write_workbooks(df: DataFrame, folder: str, group: list[str], columns: list[str], order: list[str], sheet: str = "Transactions", most: int = MAX_ROWS - 1) -> DataFrame:
    """A workbook per slug of the first key and value of the last at ``folder/<last>/<slug>_<last>.xlsx``; returns path, rows and hash of each.

    A group of more than ``most`` rows, which a worksheet can hold beside its header, goes on in order in
    ``<slug>_<last>_2.xlsx`` and so on.  Rows come sorted and are written one by one, straight from Arrow:
    a task holds one batch of a group of any size, and integers stay integers beside nulls.
    """
    root = folder.removeprefix("file://")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("_slug", "_month", *columns))))
        for (slug_, month), own in itertools.groupby(rows, key=lambda row: row[:2]):
            for k in itertools.count(1):
                if (first := next(own, None)) is None:
                    break
                n = itertools.count()
                taken = (row[2:] for row, _ in zip(itertools.chain([first], itertools.islice(own, most - 1)), n))
                path = Path(root) / month / (f"{slug_}_{month}.xlsx" if k == 1 else f"{slug_}_{month}_{k}.xlsx")
                path.parent.mkdir(parents=True, exist_ok=True)
                held = path.with_suffix(".part")
                with held.open("w+b") as out:
                    _write_book(out, {sheet: itertools.chain([columns], taken)})
                    out.seek(0)
                    file_hash = hashlib.file_digest(out, "sha256").hexdigest()
                held.replace(path)
                yield pa.RecordBatch.from_pydict({"path": [str(path)], "row_count": [next(n)], "file_hash": [file_hash]})

    marked = df.select(slug(F.col(group[0])).alias("_slug"), F.col(group[-1]).cast("string").alias("_month"), *dict.fromkeys([*columns, *order]))
    dealt = marked.repartition("_slug", "_month").sortWithinPartitions("_slug", "_month", *(F.col(c).asc_nulls_last() for c in order))
    return dealt.mapInArrow(write, "path string, row_count long, file_hash string")
