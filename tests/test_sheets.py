"""Workbooks: shared strings, dates, numbers, gaps, several sheets; and the metadata sheet from one."""

import zipfile

import pytest

from ethoflow.operators import ingest
from ethoflow.sources import sheets

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


@pytest.fixture
def book(tmp_path):
    path = str(tmp_path / "m.xlsx")
    head = ["Key (unique)", "Initials", "Date of fertilisation", "Video 1", "Test arenas"]
    strings = "".join(f"<si><t>{x}</t></si>" for x in head) + "<si><r><t>P</t></r><r><t>1</t></r><rPh><t>no</t></rPh></si><si><t>CB</t></si>"
    cells = lambda n, xs: f'<row r="{n}">' + "".join(xs) + "</row>"
    first = [
        cells(1, ['<c r="A1" t="inlineStr"><is><t>Plates</t></is></c>']),
        cells(2, [f'<c r="{c}2" t="s"><v>{i}</v></c>' for i, c in enumerate("ABCDE")]),
        cells(4, ['<c r="A4" t="s"><v>5</v></c>', '<c r="B4" t="s"><v>6</v></c>', '<c r="C4" s="1"><v>45325</v></c>', '<c r="D4" t="str"><f>A4</f><v>a.mp4</v></c>', '<c r="E4"><v>12</v></c>']),
        cells(5, ['<c r="A5"><v>7</v></c>', '<c r="C5" s="2"><v>45325.5</v></c>', '<c r="E5" s="3"><v>1.5</v></c>', '<c r="AA5" t="b"><v>1</v></c>']),
        cells(6, ['<c r="B6" t="e"><v>#N/A</v></c>']),
    ]
    styles = f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="164" formatCode="dd/mm/yy;@"/><numFmt numFmtId="165" formatCode="0.0&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} {REL}><sheets><sheet name="Plates" sheetId="1" r:id="rId1"/><sheet name="Other" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>{strings}</sst>")
        z.writestr("xl/styles.xml", styles)
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {MAIN}><sheetData>{''.join(first)}</sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {MAIN}><sheetData><row r="9"><c r="B9"><v>-3</v></c></row></sheetData></worksheet>')
    return path


def test_cells(spark, book):
    got = {r.line: r.cells for r in sheets.rows(spark, book).collect()}
    assert got[1] == ["Plates"] and got[2][2] == "Date of fertilisation" and 3 not in got
    assert got[4] == ["P1", "CB", "2024-02-03 00:00:00", "a.mp4", "12"]
    assert got[5] == ["7", None, "2024-02-03 12:00:00", None, "1.5", *[None] * 21, "True"]
    assert got[6] == [None, None]
    assert [tuple(r) for r in sheets.rows(spark, book, "Other").collect()] == [(9, [None, "-3"])]
    both = spark.read.format("xlsx").load(book)
    assert both.rdd.getNumPartitions() == 2 and {r.sheet for r in both.collect()} == {"Plates", "Other"}
    with pytest.raises(Exception):  # noqa: B017
        sheets.rows(spark, book, "None").collect()


def test_metadata_sheet_from_a_workbook_and_from_csv(spark, book, tmp_path):
    got = ingest.sheet_records(spark, book).orderBy("key").collect()
    assert [(r.key, r.initials, r.fert_date_raw, r.videos, r.test_arenas) for r in got] == [("7", "", "2024-02-03 12:00:00", [], "1.5"), ("P1", "CB", "2024-02-03 00:00:00", ["a.mp4"], "12")]
    (tmp_path / "m.csv").write_text("Plates,,,,\nKey (unique),Initials,Date of fertilisation,Video 1,Test arenas\nP1,CB,2024-02-03 00:00:00,a.mp4,12\n7,,2024-02-03 12:00:00,,1.5\n")
    assert ingest.sheet_records(spark, str(tmp_path / "m.csv")).orderBy("key").collect() == got


def test_written_workbooks_are_read_back(spark, tmp_path):
    rows = [(1, ["a<b>&c", None, " x "]), (3, ["", "é\n2"]), (40, [None] * 27 + ["AB"])]
    sheets.write_sheet(spark.createDataFrame(rows, "line long, cells array<string>").repartition(3), str(tmp_path / "w.xlsx"))
    assert sorted(tuple(r) for r in sheets.rows(spark, str(tmp_path / "w.xlsx")).collect()) == rows
