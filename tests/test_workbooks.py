"""Workbooks and array files, written here by hand and read by Spark."""

from __future__ import annotations

import math
import zipfile

import numpy as np
import pytest

from strikeplane.sources import workbooks

SPACE = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def book(path, rows, shared=()):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {SPACE}><sheetData>{"".join(f"<row>{r}</row>" for r in rows)}</sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {SPACE}><sheetData><row><c><v>9</v></c></row></sheetData></worksheet>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst {SPACE}>{"".join(f"<si>{s}</si>" for s in shared)}</sst>')


@pytest.mark.parametrize("place,at", [("A1", 0), ("Z9", 25), ("AB7", 27), ("XFD1", 16383)])
def test_column_index(place, at):
    assert workbooks.column_index(place) == at


def test_workbooks_with_unlike_headers(spark, tmp_path):
    book(
        tmp_path / "one.xlsx",
        ['<c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="inlineStr"><is><t>倾向方位角</t></is></c>', '<c r="A2"><v>1.5</v></c><c r="B2"><v>30</v></c><c r="D2"><v>120</v></c>', '<c r="B3" t="str"><v>bad</v></c><c r="D3"><v>7</v></c>', ""],
        ["<t>深度</t>", "<r><t>倾</t></r><r><t>角(°)</t></r><rPh><t>x</t></rPh>"],
    )
    book(tmp_path / "two.xlsx", ["".join(f'<c t="inlineStr"><is><t>{n}</t></is></c>' for n in ("Well", "dip", "dip direction", "depth")), '<c t="inlineStr"><is><t> w7 </t></is></c><c><v>10</v></c><c><v>20</v></c><c><v>3</v></c>'])
    (tmp_path / "notes.txt").write_text("no workbook")
    got = sorted(map(tuple, workbooks.read_workbooks(spark, str(tmp_path)).collect()), key=str)
    assert got == [("one", 0, 1.5, 30.0, 120.0), ("one", 1, None, None, 7.0), ("w7", 0, 3.0, 10.0, 20.0)]
    empty = tmp_path / "bad"
    empty.mkdir()
    book(empty / "three.xlsx", ['<c t="inlineStr"><is><t>depth</t></is></c>'])
    with pytest.raises(Exception, match="no column for dip, dip_dir"):
        workbooks.read_workbooks(spark, str(empty)).collect()


def test_array_wells(spark, tmp_path):
    wells = np.zeros((2, 3, 3))
    wells[0] = [[0, 0, 2], [0, -3, 3], [0, 0, 0]]
    wells[1] = [[1, 0, 1]] * 3
    np.savez(tmp_path / "site.npz", other=np.ones((1, 3)), wells=wells)
    np.savez(tmp_path / "flat.npz", rows=np.array([[0.0, 0.0, 5.0]]))
    got = {(r.well, r.row_id): r for r in workbooks.read_array_wells(spark, str(tmp_path)).collect()}
    assert set(got) == {("site_00", 0), ("site_00", 1), *(("site_01", i) for i in range(3)), ("flat_00", 0)}
    assert (got["site_00", 1].dip, got["site_00", 1].dip_dir) == pytest.approx((45, 180))
    assert got["site_01", 2].nx == pytest.approx(math.sqrt(0.5)) and got["site_01", 2].depth == 100
