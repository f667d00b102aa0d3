"""Workbooks: round trips, continued sheets, files as other programs write them."""
import datetime as dt
import zipfile

import pytest
from pyspark.sql import Row

from cohortia.sources import readers, sinks
from cohortia.sources import workbook as wb

SCHEMA = "id long, x double, ok boolean, day date, at timestamp, note string, d decimal(12,4)"
TEXTS = ["plain", "", "a & b < c > d", "line\nnext\rlast\ttab", "  spaces  ", "_x0041_ stays", "nul\x00 bell\x07",
         "_x0041\x01", "é 漢字 😀", "\ufffe\uffff", "=SUM(A1)", "'quoted'", None, "x" * 100_000]


def table(spark):
    rows = [(i, [1.5, -2e-300, None, 1e300][i % 4], [True, False, None][i % 3],
             [dt.date(2020, 2, 29), dt.date(1899, 12, 31), None][i % 3],
             [dt.datetime(2021, 3, 4, 5, 6, 7, 891234), None][i % 2], t,
             None if i % 5 == 0 else __import__("decimal").Decimal(f"{i}.1250")) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + [(2**62 + 1, None, None, None, None, None, None)], SCHEMA)


def test_round_trip_of_all_types(spark, tmp_path):
    df, path = table(spark).coalesce(1), str(tmp_path / "book.xlsx")
    assert wb.write_workbook({"all kinds": df, "again": df.select("id")}, path) == ["all kinds", "again"]
    assert wb.read_workbook(spark, path, df.schema).collect() == df.collect()
    assert wb.read_workbook(spark, path, "id long", "again").collect() == df.select("id").collect()
    assert wb.workbook_columns(spark, path, "all kinds") == df.columns
    assert [f.name for f in tmp_path.iterdir()] == ["book.xlsx"]
    # order of the wanted columns is free; absent columns and sheets, wrong types
    got = wb.read_workbook(spark, path, "note string, none long, id string").first()
    assert got == Row(note="plain", none=None, id="0")
    assert wb.read_workbook(spark, path, "note long").where("note is not null").count() == 0
    assert wb.read_workbook(spark, path, "id long", "no such sheet").count() == 0
    # an existing file is replaced
    wb.write_workbook({"one": df.limit(1)}, path)
    assert wb.read_workbook(spark, path, "id long").count() == 1


def test_long_tables_go_on_in_further_sheets(spark, tmp_path):
    path, name = str(tmp_path / "long.xlsx"), "a name of thirty-one characters"
    df = spark.range(23, numPartitions=3).coalesce(1)
    assert wb.write_workbook({name: df, "empty": df.where("id < 0")}, path, sheet_rows=11) == [
        name, name[:27] + " (2)", name[:27] + " (3)", "empty"]
    assert [r.id for r in wb.read_workbook(spark, path, "id long", name).collect()] == list(range(23))
    assert wb.read_workbook(spark, path, "id long", "empty").count() == 0
    assert wb.workbook_columns(spark, path, "empty") == ["id"]
    # a sheet that is full exactly has no continuation
    assert wb.write_workbook({"s": df.limit(10)}, path, sheet_rows=11) == ["s"]


def test_numbers_without_value_and_odd_names(spark, tmp_path):
    path = str(tmp_path / "odd.xlsx")
    df = spark.sql("SELECT double('NaN') AS `a & b`, double('inf') AS `x.y`, 1 AS `_x0041_`, 'k' AS `q``t`")
    wb.write_workbook({"odd": df}, path)
    assert wb.workbook_columns(spark, path) == df.columns
    assert tuple(wb.read_workbook(spark, path, df.schema).first()) == (None, None, 1, "k")
    for bad in ("", "a/b", "x" * 32, "'q'"):
        with pytest.raises(ValueError):
            wb.write_workbook({bad: df}, path)
    with pytest.raises(ValueError):
        wb.write_workbook({"A": df, "a": df}, path)


def foreign(path, pr, date):
    """A file as spreadsheet programs write it: shared rich texts, cell
    references with gaps, absolute targets, formulas with stored values."""
    ns = f'xmlns="{wb.MAIN}"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{wb.OFFICE}">{pr}<sheets>'
                   '<sheet name="Data" sheetId="4" r:id="rId7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{wb.PACKAGE}/relationships">'
                   f'<Relationship Id="rId7" Type="{wb.OFFICE}/worksheet" Target="/xl/worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>day</t></si><si><r><t>va</t></r><r><t>lue</t></r>"
                   "<rPh><t>hint</t></rPh></si><si><t>note</t></si></sst>")
        z.writestr("xl/worksheets/s.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c>'
                   '<c r="C1" t="s"><v>1</v></c><c r="AB1" t="s"><v>2</v></c></row>'
                   f'<row r="3"><c r="A3"><v>{date}</v></c><c r="AB3" t="str"><f>A1</f><v>res</v></c></row>'
                   '<row r="4"><c r="C4"><f>1+1</f><v>2</v></c><c r="AB4" t="e"><v>#N/A</v></c></row>'
                   "</sheetData></worksheet>")


def test_files_of_other_programs_and_folders(spark, tmp_path):
    foreign(tmp_path / "a.xlsx", "", 43890)
    foreign(tmp_path / "b.xlsx", '<workbookPr date1904="1"/>', 43890 - 1462)
    want = [(dt.date(2020, 2, 29), None, "res"), (None, 2, None)]
    schema = "day date, value int, note string"
    assert [tuple(r) for r in wb.read_workbook(spark, str(tmp_path / "b.xlsx"), schema).collect()] == want
    assert wb.workbook_columns(spark, str(tmp_path)) == ["day", "value", "note"]
    assert wb.read_workbook(spark, str(tmp_path), schema).count() == 4


def test_weekly_table_and_report(spark, tmp_path):
    path = str(tmp_path / "deep" / "report.xlsx")
    df = spark.createDataFrame([("03.01.22", 10.5, "x"), ("10.01.22", None, "y")], "week string, sales double, k string")
    sinks.write_report({"weekly": df, "other": df}, path, fmt="xlsx")
    got = readers.read_weekly(spark, path, date_col="week", fmt="xlsx", sheet="weekly").orderBy("week").collect()
    assert [tuple(r) for r in got] == [(dt.date(2022, 1, 3), 10.5, None), (dt.date(2022, 1, 10), None, None)]
    typed = readers.read_weekly(spark, path, "week string, k string", "week", "xlsx").first()
    assert tuple(typed) == (dt.date(2022, 1, 3), "x")
