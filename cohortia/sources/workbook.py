"""Workbooks (S2, S6): sheets of an .xlsx file as tables, several tables as one file.

Writing: each row becomes its XML line in column expressions, the lines are
written as text by all tasks, and one task streams them into the zip file in
constant memory. A sheet holds 1,048,576 rows by its format; rows beyond go on
in further sheets ("name (2)"), each with the header, and reading the first
name reads them all. A workbook is one file by its nature: use ``write_table``
for tables that other Spark jobs read.

Reading: Spark hands whole files (2 GB each at most) to the tasks, which stream
the wanted sheet's rows; a folder of workbooks is read file by file.

Nulls and NaN or infinite numbers become empty cells (an error cell for the
latter, read as null); an empty text stays an empty text. Control characters are
written as _xHHHH_ and read back. A missing sheet or column gives no rows or
nulls; an empty table gives a sheet with its header only.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Mapping
from uuid import uuid4
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, DateType, DoubleType, FloatType, NumericType, StructType,
                               TimestampNTZType, TimestampType)

from ..session import shared_folder

SHEET_ROWS = 1_048_576
BATCH = 10_000

# Fixed values of the file format.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
DAY_ZERO, DAY_ZERO_1904 = "1899-12-30", "1904-01-01"
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
# An underscore that would read as the start of a coded character.
CODED_START = "_(?=x[0-9A-Fa-f]{4}[_\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF])"
CONTROL = [chr(c) for c in range(32) if chr(c) not in "\t\n\r"]
STYLES = (f'{HEAD}<styleSheet xmlns="{MAIN}"><fonts count="1"><font/></fonts><fills count="2"><fill/>'
          '<fill><patternFill patternType="gray125"/></fill></fills><borders count="1"><border/></borders>'
          '<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf/>'
          '<xf numFmtId="14" applyNumberFormat="1"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>')


# ---------------------------------------------------------------- writing
def _text_cell(c: Column) -> Column:
    c = F.regexp_replace(c, CODED_START, "_x005F_")
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "&#10;"), ("\r", "&#13;"),
                         ("\ufffe", "_xFFFE_"), ("\uffff", "_xFFFF_")):
        c = F.replace(c, F.lit(plain), F.lit(coded))
    coded = c
    for ch in CONTROL:
        coded = F.replace(coded, F.lit(ch), F.lit(f"_x{ord(ch):04X}_"))
    c = F.when(c.rlike("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]"), coded).otherwise(c)
    return F.concat(F.lit('<c t="inlineStr"><is><t xml:space="preserve">'), c, F.lit("</t></is></c>"))


def _cell(df: DataFrame, name: str) -> Column:
    kind, c = df.schema[name].dataType, F.col(f"`{name.replace('`', '``')}`")
    if isinstance(kind, BooleanType):
        out = F.concat(F.lit('<c t="b"><v>'), c.cast("int"), F.lit("</v></c>"))
    elif isinstance(kind, (DoubleType, FloatType)):
        finite = ~F.isnan(c) & (F.abs(c) < float("inf"))
        out = F.when(finite, F.concat(F.lit("<c><v>"), c, F.lit("</v></c>"))).otherwise(
            F.when(c.isNotNull(), F.lit('<c t="e"><v>#NUM!</v></c>')))
    elif isinstance(kind, NumericType):
        out = F.concat(F.lit("<c><v>"), c, F.lit("</v></c>"))
    elif isinstance(kind, DateType):
        out = F.concat(F.lit('<c s="1"><v>'), F.datediff(c, F.lit(DAY_ZERO).cast("date")), F.lit("</v></c>"))
    elif isinstance(kind, (TimestampType, TimestampNTZType)):
        # wall-clock time as days, with twelve decimals (below a microsecond)
        wall = c.cast("timestamp_ntz")
        micros = F.timestamp_diff("MICROSECOND", F.lit(f"{DAY_ZERO} 00:00:00").cast("timestamp_ntz"), wall)
        days = (micros.cast("decimal(20,0)") / F.lit(86_400_000_000).cast("decimal(12,0)")).cast("decimal(24,12)")
        out = F.concat(F.lit('<c s="2"><v>'), days, F.lit("</v></c>"))
    else:
        out = _text_cell(c.cast("string"))
    return F.coalesce(out, F.lit("<c/>"))


def _coded(name: str) -> str:
    """Text of a header cell, as column values are written."""
    name = re.sub(CODED_START, "_x005F_", name)
    name = escape(name, {"\n": "&#10;", "\r": "&#13;"})
    return "".join(f"_x{ord(ch):04X}_" if ch in CONTROL or ch in "\ufffe\uffff" else ch for ch in name)


def _header(df: DataFrame) -> str:
    cells = "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{_coded(c)}</t></is></c>' for c in df.columns)
    return f"<row>{cells}</row>\n"


def _continued(name: str, part: int) -> str:
    if part == 1:
        return name
    tail = f" ({part})"
    return name[:31 - len(tail)] + tail


def _lines(store: fs.FileSystem, folder: str) -> Iterator[bytes]:
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    for f in sorted(found, key=lambda f: f.base_name):
        if f.is_file and f.base_name.startswith("part-"):
            with store.open_input_stream(f.path) as stream:
                yield from io.BufferedReader(stream, 1 << 20)


def _assemble(stage: str, path: str, sheets: list[tuple[str, str]], sheet_rows: int, attempt: int) -> list[str]:
    """Stream staged lines into a workbook beside ``path`` and move it there."""
    store, root = fs.FileSystem.from_uri(stage)
    shelf, target = fs.FileSystem.from_uri(path)
    shelf.create_dir(target.rpartition("/")[0])
    partial = f"{target}.{attempt}"
    names: list[str] = []
    with shelf.open_output_stream(partial) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for number, (name, header) in enumerate(sheets):
            lines = _lines(store, f"{root}/sheet={number}")
            line, part = next(lines, None), 0
            while line is not None or part == 0:
                part += 1
                names.append(_continued(name, part))
                with z.open(f"xl/worksheets/sheet{len(names)}.xml", "w", force_zip64=True) as out:
                    out.write(f'{HEAD}<worksheet xmlns="{MAIN}"><sheetData>'.encode())
                    out.write(header.encode())
                    room = sheet_rows - 1
                    while line is not None and room:
                        out.write(line)
                        line, room = next(lines, None), room - 1
                    out.write(b"</sheetData></worksheet>")
        count = range(1, len(names) + 1)
        z.writestr("[Content_Types].xml", f'{HEAD}<Types xmlns="{PACKAGE}/content-types">'
                   '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
                   '<Default Extension="xml" ContentType="application/xml"/>' + "".join(
                       f'<Override PartName="/xl/{part}.xml" ContentType="application/vnd.openxmlformats-officedocument.'
                       f'spreadsheetml.{kind}+xml"/>' for part, kind in [("workbook", "sheet.main"), ("styles", "styles")]
                       + [(f"worksheets/sheet{i}", "worksheet") for i in count]) + "</Types>")
        z.writestr("_rels/.rels", f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" '
                   f'Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{HEAD}<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets>' + "".join(
            f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(count, names))
            + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships">' + "".join(
            f'<Relationship Id="rId{i}" Type="{OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in count)
            + f'<Relationship Id="rId0" Type="{OFFICE}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", STYLES)
    shelf.move(partial, target)
    return names


def write_workbook(tables: Mapping[str, DataFrame], path: str, sheet_rows: int = SHEET_ROWS) -> list[str]:
    """Several tables as the sheets of one workbook; the names of all sheets
    written. An existing file is replaced. Rows keep the order of their table."""
    for name in tables:
        if not 0 < len(name) <= 31 or re.search(r"[\[\]:*?/\\]", name) or name.startswith("'") or name.endswith("'"):
            raise ValueError(f"not a sheet name: {name!r}")
    if not tables or len({n.lower() for n in tables}) < len(tables):
        raise ValueError("sheet names must differ in more than case, and there must be one")
    spark = next(iter(tables.values())).sparkSession
    stage = f"{shared_folder(spark)}/workbook-{uuid4().hex}"
    sheets = []
    for number, (name, df) in enumerate(tables.items()):
        line = F.concat(F.lit("<row>"), *[_cell(df, c) for c in df.columns], F.lit("</row>"))
        df.select(line.alias("value")).write.text(f"{stage}/sheet={number}")
        sheets.append((name, _header(df)))

    def build(batches):
        for _ in batches:
            names = _assemble(stage, path, sheets, sheet_rows, TaskContext.get().taskAttemptId())
            yield pd.DataFrame({"sheet": names})

    written = [r.sheet for r in spark.range(1).coalesce(1).mapInPandas(build, "sheet string").collect()]
    store, root = fs.FileSystem.from_uri(stage)
    store.delete_dir(root)
    return written


# ---------------------------------------------------------------- reading
def _decoded(text: str) -> str:
    if "_x" not in text:
        return text
    plain = re.sub("_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text)
    return plain.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _joined(node) -> str:
    """Text of a rich or plain string; phonetic hints are left out."""
    runs = [t.text or "" for child in node for t in ([child] if child.tag == f"{{{MAIN}}}t" else
            child.findall(f"{{{MAIN}}}t") if child.tag == f"{{{MAIN}}}r" else [])]
    return _decoded("".join(runs))


def _sheet_files(z: zipfile.ZipFile) -> tuple[list[tuple[str, str]], bool]:
    """(sheet name, member) in order, and whether days count from 1904."""
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    files = []
    for s in book.iter(f"{{{MAIN}}}sheet"):
        target = rels[s.get(f"{{{OFFICE}}}id")]
        files.append((s.get("name"), target[1:] if target.startswith("/") else f"xl/{target}"))
    pr = book.find(f"{{{MAIN}}}workbookPr")
    return files, pr is not None and pr.get("date1904") in ("1", "true")


def _wanted(files: list[tuple[str, str]], sheet: str | None) -> list[str]:
    """Members of a sheet (the first one, if not named) and its continuations."""
    name = sheet if sheet is not None else files[0][0] if files else ""
    by_name, out, part = dict(files), [], 1
    while _continued(name, part) in by_name:
        out.append(by_name[_continued(name, part)])
        part += 1
    return out


def _column(ref: str | None, after: int) -> int:
    letters = re.match("[A-Z]+", ref or "")
    if not letters:
        return after
    at = 0
    for ch in letters[0]:
        at = at * 26 + ord(ch) - 64
    return at - 1


def _rows(z: zipfile.ZipFile, member: str, shared: list[str]) -> Iterator[dict[int, str]]:
    with z.open(member) as stream:
        data = None
        for event, node in ElementTree.iterparse(stream, events=("start", "end")):
            if event == "start":
                data = node if node.tag == f"{{{MAIN}}}sheetData" else data
                continue
            if node.tag != f"{{{MAIN}}}row":
                continue
            row, at = {}, 0
            for c in node:
                at = _column(c.get("r"), at)
                kind, v = c.get("t"), c.findtext(f"{{{MAIN}}}v")
                if kind == "inlineStr":
                    inner = c.find(f"{{{MAIN}}}is")
                    v = _joined(inner) if inner is not None else ""
                elif v is not None:
                    v = shared[int(v)] if kind == "s" else _decoded(v) if kind == "str" else None if kind == "e" else v
                if v is not None:
                    row[at] = v
                at += 1
            yield row
            data.clear()


def _shared(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    return [_joined(si) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{{{MAIN}}}si")]


def _as_type(c: Column, kind, zero: Column) -> Column:
    number = c.try_cast("double")
    if isinstance(kind, BooleanType):
        return c.try_cast("boolean")
    if isinstance(kind, DateType):
        return F.coalesce(F.date_add(zero, F.floor(number).cast("int")), c.try_cast("date"))
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        micros = F.round(c.try_cast("decimal(24,12)") * F.lit(86_400_000_000).cast("decimal(12,0)"), 0).cast("bigint")
        wall = zero.cast("timestamp_ntz") + F.make_dt_interval(secs=micros.cast("decimal(24,0)") / 1_000_000)
        return F.coalesce(wall, c.try_cast("timestamp_ntz")).cast(kind)
    if isinstance(kind, NumericType):
        return F.coalesce(c.try_cast(kind), number.try_cast(kind)) if not isinstance(
            kind, (DoubleType, FloatType)) else c.try_cast(kind)
    return c


def workbook_columns(spark: SparkSession, path: str, sheet: str | None = None) -> list[str]:
    """The header of a sheet (the first one, if not named) of a workbook, or of
    the first workbook of a folder by path; at most 16,384 names."""
    def head(batches):
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    files, _ = _sheet_files(z)
                    for member in _wanted(files, sheet)[:1]:
                        first = next(_rows(z, member, _shared(z)), {})
                        yield pd.DataFrame({"path": [file], "names": [[first[i] for i in sorted(first)]]})

    found = (spark.read.format("binaryFile").load(path).select("path", "content")
             .mapInPandas(head, "path string, names array<string>").orderBy("path").first())
    return list(found.names) if found else []


def read_workbook(spark: SparkSession, path: str, schema: StructType | str,
                  sheet: str | None = None) -> DataFrame:
    """A sheet (the first one, if not named) with its continuations from
    a workbook or a folder of them. Columns are found by their header, in any
    order; values that are none of the schema's type are null."""
    wanted = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    names = wanted.names
    slots = [f"c{i}" for i in range(len(names))]

    def parse(batches):
        for content in (c for pdf in batches for c in pdf["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                files, from_1904 = _sheet_files(z)
                shared = _shared(z)
                for member in _wanted(files, sheet):
                    rows = _rows(z, member, shared)
                    place = {name: at for at, name in reversed(next(rows, {}).items())}
                    at = [place.get(n, -1) for n in names]
                    batch: list[list] = []
                    for row in rows:
                        batch.append([from_1904] + [row.get(i) for i in at])
                        if len(batch) == BATCH:
                            yield pd.DataFrame(batch, columns=["from_1904", *slots], dtype=object)
                            batch = []
                    if batch:
                        yield pd.DataFrame(batch, columns=["from_1904", *slots], dtype=object)

    raw = (spark.read.format("binaryFile").load(path).select("content")
           .mapInPandas(parse, "from_1904 boolean, " + ", ".join(f"{s} string" for s in slots)))
    zero = F.when(F.col("from_1904"), F.lit(DAY_ZERO_1904)).otherwise(F.lit(DAY_ZERO)).cast("date")
    return raw.select(*[_as_type(F.col(s), f.dataType, zero).alias(f.name) for s, f in zip(slots, wanted)])
