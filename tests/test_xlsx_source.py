"""Spreadsheets as a data source."""

from __future__ import annotations

import zipfile

import pytest

from tabloom.operators.summary import run_summary
from tabloom.sources import xlsx
from tabloom.sources.xlsx_source import load_xlsx, register

ROWS = [["id", "name", "name", "x y"], ["1", "a", "b", "2.5"], [], ["2", "", "NA", "TRUE"], ["", "NA", "", ""], ["3.0", "é <&>", "z", "1e3"]]


@pytest.fixture(scope="module")
def book(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("books") / "one.xlsx")
    xlsx.write_sheet(path, ROWS, "First")
    with zipfile.ZipFile(path) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    parts["xl/workbook.xml"] = parts["xl/workbook.xml"].replace(b"</sheets>", b'<sheet name="Second" sheetId="2" r:id="rId2"/></sheets>')
    parts["xl/_rels/workbook.xml.rels"] = parts["xl/_rels/workbook.xml.rels"].replace(b"</Relationships>", b'<Relationship Id="rId2" Type="x" Target="worksheets/sheet2.xml"/></Relationships>')
    parts["xl/worksheets/sheet2.xml"] = xlsx._sheet_xml([ROWS[0], ["9", "n", "m", "0"]]).encode()
    with zipfile.ZipFile(path, "w") as z:
        for n, data in parts.items():
            z.writestr(n, data)
    return path


def test_sheets_stream(book):
    assert xlsx.sheet_names(book) == ["First", "Second"]
    assert list(xlsx.stream_sheet(book, "First"))[:2] == ROWS[:2] and len(xlsx.read_sheet(book)) == 6
    stream = xlsx.stream_sheet(book)
    assert next(stream) == ROWS[0]  # no more than a row is made
    stream.close()


def test_reads_sheets_as_partitions(spark, book):
    df = load_xlsx(spark, book)
    assert df.dtypes == [("id", "string"), ("name", "string"), ("name.1", "string"), ("x.y", "string")]
    assert [tuple(r) for r in df.collect()] == [("1", "a", "b", "2.5"), ("2", None, None, "TRUE"), ("3.0", "é <&>", "z", "1e3")]
    every = load_xlsx(spark, f"file://{book}", "*")
    assert every.rdd.getNumPartitions() == 2 and sorted(r.id for r in every.collect()) == ["1", "2", "3.0", "9"]
    assert load_xlsx(spark, book, "Second").count() == 1
    register(spark)
    typed = spark.read.format("xlsx").schema("`x.y` double, id int, NAME string").load(book[: book.rindex("/")])
    assert [tuple(r) for r in typed.collect()] == [(2.5, 1, "a"), (None, 2, None), (1000.0, 3, "é <&>")]
    assert run_summary([{"COUNT": "name", "SUM": "id"}], typed.select("id", "name")).df.first()[:2] == (2, 6)


@pytest.mark.parametrize(("sheet", "schema", "why"), [("Third", None, "no sheet"), (None, "nope int", "no column"), (None, "id date", "become whole numbers")])
def test_what_cannot_be_read(spark, book, sheet, schema, why):
    with pytest.raises(Exception, match=why):
        load_xlsx(spark, book, sheet, schema).collect()
    with pytest.raises(Exception, match="no workbook"):
        load_xlsx(spark, "/nowhere/*.xlsx").collect()
