"""Workbook ingestion (S1–S6): ``.xlsx`` files → string DataFrames.

A directory of workbooks is read with ``binaryFile``; each file is expanded to
long cells ``(path, sheet_no, sheet, row_no, col_no, value)`` inside
``mapInPandas`` (standard-library ``zipfile`` + ``ElementTree``; an ``.xlsx``
is a zip of XML parts).  Everything after that — best sheet, header row, the
pivot to a wide table — is DataFrame work: ``groupBy``, ``row_number``,
``lead`` and a ``groupBy(row).pivot(col)``.

A single workbook is parsed by one task (the format is one zip archive);
many workbooks spread over the cluster.  ``.xls`` (binary BIFF) is not read.
"""

from __future__ import annotations

import datetime
import io
import re
import zipfile
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tablewise.functions import names as N
from tablewise.session import sequential_id, shared_path

#: Workbooks that a task writes on average; their parts are read back apart.
FILES_PER_TASK = 16
CELL_SCHEMA = "path string, sheet_no int, sheet string, row_no int, col_no int, value string, is_text boolean"

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL_NS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_REF = re.compile(r"([A-Z]+)(\d+)")


def _col_index(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _shared_strings(z: zipfile.ZipFile) -> list[str]:
    try:
        root = ET.fromstring(z.read("xl/sharedStrings.xml"))
    except KeyError:
        return []
    out = []
    for si in root.findall("m:si", _NS):
        out.append("".join(t.text or "" for t in si.iter("{%s}t" % _NS["m"])))
    return out


def _sheet_parts(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    targets = {r.get("Id"): r.get("Target") for r in rels}
    out = []
    for s in wb.find("m:sheets", _NS):
        target = targets.get(s.get(_REL_NS), "")
        target = target.lstrip("/")
        if not target.startswith("xl/"):
            target = "xl/" + target
        out.append((s.get("name"), target))
    return out


# number formats of the file format that show a date or time (fixed values)
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles whose number format shows a date."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ET.fromstring(z.read("xl/styles.xml"))
    own = {}
    for f in root.iterfind("m:numFmts/m:numFmt", _NS):
        plain = re.sub(r'"[^"]*"|\\\\.|\[[^\]]*\]', "", f.get("formatCode", "")).lower()
        own[int(f.get("numFmtId"))] = bool(re.search(r"[ymdhs]", plain))
    formats = [int(x.get("numFmtId", 0)) for x in root.iterfind("m:cellXfs/m:xf", _NS)]
    return {i for i, n in enumerate(formats) if own.get(n, n in _DATE_FORMATS)}


def _day_zero(z: zipfile.ZipFile) -> datetime.datetime:
    """Day 0 of serial dates: 30 Dec 1899, or 1 Jan 1904 where the workbook says so."""
    flags = ET.fromstring(z.read("xl/workbook.xml")).find("m:workbookPr", _NS)
    late = flags is not None and flags.get("date1904") in ("1", "true")
    return datetime.datetime(1904, 1, 1) if late else datetime.datetime(1899, 12, 30)


def _cell_value(c, strings: list[str], dates: set[int], base: datetime.datetime) -> str | None:
    """Text of a cell: dates in ISO form, booleans as true/false, null for errors and empty cells."""
    kind = c.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter("{%s}t" % _NS["m"]))
    v = c.find("m:v", _NS)
    if v is None or v.text is None or kind == "e":
        return None
    if kind == "s":
        return strings[int(v.text)]
    if kind == "b":
        return "true" if v.text.strip() == "1" else "false"
    if kind in (None, "n") and int(c.get("s") or 0) in dates:
        moment = base + datetime.timedelta(seconds=round(float(v.text) * 86_400))
        return moment.date().isoformat() if moment.time() == datetime.time() else moment.isoformat(sep=" ")
    return v.text


def workbook_cells(path: str, content: bytes) -> Iterator[tuple]:
    """Every non-empty cell of every sheet of one ``.xlsx`` file."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        strings = _shared_strings(z)
        dates, base = _date_styles(z), _day_zero(z)
        for sheet_no, (name, part) in enumerate(_sheet_parts(z)):
            with z.open(part) as sheet:
                for _, row in ET.iterparse(sheet):
                    if row.tag != "{%s}row" % _NS["m"]:
                        continue
                    for c in row.findall("m:c", _NS):
                        m, value = _REF.match(c.get("r", "")), _cell_value(c, strings, dates, base)
                        if m and value is not None:
                            is_text = c.get("t") in ("s", "inlineStr", "str")
                            yield (path, sheet_no, name, int(m.group(2)) - 1, _col_index(m.group(1)), value, is_text)
                    row.clear()


def _cells_udf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cols = ["path", "sheet_no", "sheet", "row_no", "col_no", "value", "is_text"]
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            cells = workbook_cells(path, content)
            while rows := list(islice(cells, 10_000)):  # some thousand cells in memory at a time
                yield pd.DataFrame(rows, columns=cols)


def workbook_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of every ``.xlsx`` file under ``path``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def read_cells(spark: SparkSession, source: str | DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Long cells of every workbook (one task per file).

    ``source`` is a folder of ``.xlsx`` files, or rows with ``path`` and
    ``content`` (a table of workbooks).  ``max_bytes`` is the optional S6 size
    guard: a larger file refuses the import.
    """
    files = workbook_files(spark, source) if isinstance(source, str) else source.select("path", F.octet_length("content").alias("length"), "content")
    if max_bytes:
        large = files.where(F.col("length") > max_bytes).select("path", "length").orderBy("path").limit(20).collect()
        if large:
            raise ValueError(f"files above {max_bytes} bytes: " + ", ".join(f"{r['path']} ({r['length']})" for r in large))
    return files.select("path", "content").mapInPandas(_cells_udf, CELL_SCHEMA)


def stored_cells(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """:func:`read_cells`, written to the shared folder: each workbook is parsed once, however often its cells are read."""
    path = shared_path(spark, "cells")
    read_cells(spark, source).write.parquet(path)
    return spark.read.schema(CELL_SCHEMA).parquet(path)


def best_sheet(cells: DataFrame, scan_rows: int = 50) -> DataFrame:
    """Per file the sheet with most non-empty cells in its first rows; first sheet wins ties."""
    scored = cells.where(F.col("row_no") < scan_rows).groupBy("path", "sheet_no", "sheet").agg(F.count("value").alias("score"))
    w = Window.partitionBy("path").orderBy(F.desc("score"), F.asc("sheet_no"))
    return scored.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def header_rows(cells: DataFrame, max_scan: int = 25, method: str = "A") -> DataFrame:
    """Per (file, sheet) the header row among the first ``max_scan`` rows.

    A: 2·text cells + non-empty cells + min(next row's non-empty, 10).
    B: 3·distinct lower-cased values + 2·cells with a letter + min(next row's non-empty, distinct).
    The first maximum wins.
    """
    head = cells.where(F.col("row_no") < max_scan)
    rows = head.groupBy("path", "sheet_no", "row_no").agg(
        F.count("value").alias("non_empty"),
        F.count_if(F.col("is_text") & (F.trim("value") != "")).alias("text_cells"),
        F.count_distinct(F.lower(F.trim("value"))).alias("distinct_values"),
        F.count_if(F.col("value").rlike(r"\p{L}")).alias("letter_cells"),
    )
    w = Window.partitionBy("path", "sheet_no").orderBy("row_no")
    # next physical row (an absent row counts as empty)
    nxt = F.when(F.lead("row_no").over(w) == F.col("row_no") + 1, F.lead("non_empty").over(w)).otherwise(F.lit(0))
    rows = rows.withColumn("next_non_empty", nxt)
    if method == "A":
        score = F.col("text_cells") * 2 + F.col("non_empty") + F.least(F.col("next_non_empty"), F.lit(10))
    else:
        score = F.col("distinct_values") * 3 + F.col("letter_cells") * 2 + F.least(F.col("next_non_empty"), F.col("distinct_values"))
    best = Window.partitionBy("path", "sheet_no").orderBy(F.desc("score"), F.asc("row_no"))
    return rows.withColumn("score", score).withColumn("rn", F.row_number().over(best)).where("rn = 1").select(
        "path", "sheet_no", F.col("row_no").alias("header_row")
    )


def to_table(cells: DataFrame, header_row: int, path: str | None = None, sheet_no: int = 0) -> DataFrame:
    """Pivot one sheet's cells to a string table with the header row as names.

    Rows below the header become records; all-empty rows and columns vanish
    because only present cells exist (S5).  Header names are made unique (P1).
    """
    sheet = cells.where(F.col("sheet_no") == sheet_no)
    if path is not None:
        sheet = sheet.where(F.col("path") == path)
    headers = {r["col_no"]: r["value"] for r in sheet.where(F.col("row_no") == header_row).select("col_no", "value").collect()}
    body = sheet.where(F.col("row_no") > header_row)
    col_ids = sorted(set(headers) | {r["col_no"] for r in body.select("col_no").distinct().collect()})
    labels = [headers.get(i) or f"column_{i + 1}" for i in col_ids]
    names = N.unique_names(str(label).strip() or f"column_{i + 1}" for i, label in zip(col_ids, labels))
    wide = body.groupBy("row_no").pivot("col_no", col_ids).agg(F.first("value"))
    return wide.select("row_no", *[F.col(str(i)).alias(n) for i, n in zip(col_ids, names)]).orderBy("row_no")


def read_workbook(spark: SparkSession, path: str | DataFrame, sheet: str | None = None, header_row: int | None = None) -> DataFrame:
    """S1–S5 for one file: best (or given) sheet, detected (or given, 1-based) header, table."""
    cells = read_cells(spark, path)
    files = [r["path"] for r in cells.select("path").distinct().limit(2).collect()]
    if len(files) > 1:
        raise ValueError("more than one workbook; read them with read_workbooks")
    if sheet is None:
        chosen = best_sheet(cells).collect()[0]
        sheet_no = chosen["sheet_no"]
    else:
        names = {r["sheet"]: r["sheet_no"] for r in cells.select("sheet", "sheet_no").distinct().collect()}
        sheet_no = names.get(sheet, 0)
    if header_row is None:
        found = header_rows(cells.where(F.col("sheet_no") == sheet_no)).collect()
        header = found[0]["header_row"] if found else 0
    else:
        header = max(1, int(header_row)) - 1
    return to_table(cells, header, sheet_no=sheet_no).drop("row_no")


def write_xlsx(path: str | io.BytesIO, sheets: dict[str, list[list]]) -> None:
    """Minimal ``.xlsx`` writer (inline strings and numbers)."""
    def cell_ref(r: int, c: int) -> str:
        letters = ""
        c += 1
        while c:
            c, rem = divmod(c - 1, 26)
            letters = chr(65 + rem) + letters
        return f"{letters}{r + 1}"

    def esc(s: str) -> str:
        return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")

    with zipfile.ZipFile(path, "w") as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>')
        sheet_xml = "".join(
            f'<sheet name="{esc(n)}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(sheets)
        )
        z.writestr(
            "xl/workbook.xml",
            '<?xml version="1.0"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
            'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
            f"<sheets>{sheet_xml}</sheets></workbook>",
        )
        rels = "".join(
            f'<Relationship Id="rId{i + 1}" Type="worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets))
        )
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        for i, rows in enumerate(sheets.values()):
            body = []
            for r, row in enumerate(rows):
                cells = []
                for c, v in enumerate(row):
                    if v is None:
                        continue
                    if isinstance(v, (int, float)) and not isinstance(v, bool):
                        cells.append(f'<c r="{cell_ref(r, c)}"><v>{v}</v></c>')
                    else:
                        cells.append(f'<c r="{cell_ref(r, c)}" t="inlineStr"><is><t>{esc(str(v))}</t></is></c>')
                body.append(f'<row r="{r + 1}">{"".join(cells)}</row>')
            z.writestr(
                f"xl/worksheets/sheet{i + 1}.xml",
                '<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
                f'<sheetData>{"".join(body)}</sheetData></worksheet>',
            )


# ------------------------------------------------------------- many workbooks
@F.udf(ArrayType(StringType()))
def _unique_in_file(names):
    return N.unique_names(names)


def read_workbooks(spark: SparkSession, path: str | DataFrame, scan_rows: int = 50, max_scan: int = 25) -> DataFrame:
    """S1–S5 for a directory (or a table of workbooks): every file's best sheet, its detected header, one table.

    Per file the header row's cells name the columns; rows below it become
    records (``path``, ``row_no`` plus one string column per distinct header
    name).  A column without header is ``column_N``; repeated names of a file
    get ``_2``, ``_3`` and so on.  The header names are a small per-column set; everything else stays
    distributed (cells → joins → ``groupBy(path, row_no).pivot(name)``).
    """
    cells = stored_cells(spark, path)
    best = best_sheet(cells, scan_rows).select("path", "sheet_no")
    chosen = cells.join(best, ["path", "sheet_no"], "left_semi")
    header = header_rows(chosen, max_scan)
    located = chosen.join(header, ["path", "sheet_no"])
    # one row per column of each file
    heads = located.where(F.col("row_no") >= F.col("header_row")).groupBy("path", "sheet_no", "col_no").agg(
        F.max(F.when(F.col("row_no") == F.col("header_row"), F.trim("value"))).alias("name")
    )
    heads = heads.withColumn("name", F.when(F.coalesce(F.col("name"), F.lit("")) != "", F.col("name")).otherwise(F.concat(F.lit("column_"), (F.col("col_no") + 1).cast("string"))))
    own = heads.groupBy("path", "sheet_no").agg(F.sort_array(F.collect_list(F.struct("col_no", "name"))).alias("own"))  # as many as a sheet has columns
    named = own.select("path", "sheet_no", F.explode(F.arrays_zip(F.col("own.col_no").alias("col_no"), _unique_in_file("own.name").alias("name"))).alias("head"))
    names = named.select("path", "sheet_no", "head.col_no", "head.name")
    body = located.where(F.col("row_no") > F.col("header_row")).join(names, ["path", "sheet_no", "col_no"])
    header_names = [r["name"] for r in names.select("name").distinct().orderBy("name").collect()]
    wide = body.groupBy("path", "row_no").pivot("name", header_names).agg(F.first("value"))
    return wide


def to_workbooks(df: DataFrame, sheet: str = "Data", title: str | None = None, rows_per_file: int = 50_000) -> DataFrame:
    """``df`` as rows (path, rows, content), each a workbook with a header row and at most ``rows_per_file`` records.

    Rows are numbered in file order and dealt to their workbooks by number, so
    that all workbooks but the last are full.  The number of tasks grows with
    that of the workbooks; a task fills about :data:`FILES_PER_TASK` one after
    the other and holds no more than one.  An optional title row and a blank
    row go above the header, and a small notes sheet comes first, as hand-made
    workbooks often have.  Write the result as a table in any store that Spark
    writes to; :func:`read_cells` takes such a table.
    """
    cols = list(df.columns)

    def packed(rows: list, number: int) -> pd.DataFrame:
        head = ([[title], [None]] if title else []) + [cols]
        write_xlsx(content := io.BytesIO(), {"Notes": [["generated"]], sheet: head + rows})
        return pd.DataFrame({"path": [f"part-{number:08d}.xlsx"], "rows": [len(rows)], "content": [content.getvalue()]})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, current = [], None
        for pdf in batches:
            for number, own in pdf.groupby(pdf.iloc[:, -1], sort=False):  # sorted by workbook, so a number is one stretch
                if rows and number != current:
                    yield packed(rows, current)
                    rows = []
                current = number
                own = own.iloc[:, : len(cols)]
                rows.extend(own.astype(object).where(pd.notnull(own), None).values.tolist())
        if rows:
            yield packed(rows, current)

    numbered = sequential_id(df, [], "__row", 0).withColumn("__file", F.floor(F.col("__row") / rows_per_file))
    files = numbered.agg(F.max("__file")).first()[0]
    n = 1 if files is None else files // FILES_PER_TASK + 1
    dealt = numbered.repartition(n, "__file").sortWithinPartitions("__row").drop("__row")
    return dealt.mapInPandas(pack, "path string, rows long, content binary")


def write_workbooks(df: DataFrame, path: str, **options) -> DataFrame:
    """:func:`to_workbooks` written as a Parquet table at ``path`` and read back."""
    made = to_workbooks(df, **options)
    made.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(made.schema).parquet(path)
