"""The workbook source on small workbooks and on files that are none."""

import pytest
from workbook_files import write

from tallyspark.sources import workbooks as WB


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("books")
    data = {1: ["Report"], 3: ["Day", "Cost", "Click", "Okay", "Gone"], 4: [(1, 45292), 1234.5, 7.0, True, "#N/A"], 5: [(2, 45292.75), None, (3, 2), False, "=made"], 6: []}
    write(top / "a.xlsx", {"Cover": {1: ["only", "two"]}, "Data & more": data, "Data dictionary": {1: ["Cost", "", "what it costs"], 2: [" "], 3: ["Day", "when"]}})
    (top / "deeper").mkdir()
    write(top / "deeper" / "b.xlsx", {"Sheet1": {1: ["x"] + [None] * 27 + ["ab"]}, "Sheet2": {2: ["yy"]}}, date1904=True)
    (top / "sealed.xlsx").write_bytes(WB.OLD + b"..." + WB.SEALED)
    (top / "old.xlsx").write_bytes(WB.OLD + b"...")
    (top / "text.xlsx").write_bytes(b"a,b\n1,2\n")
    (top / "left alone.csv").write_bytes(b"a,b\n1,2\n")
    return f"file://{top}"


@pytest.fixture(scope="module")
def rows(spark, folder):
    WB.register(spark)
    return spark.read.format("workbooks").load(folder)


def test_cells(rows, folder):
    got = {(r["sheet"], r["row"]): r["cells"] for r in rows.where(f"file = '{folder}/a.xlsx'").collect()}
    assert got["Cover", 1] == ["only", "two"]
    assert got["Data & more", 3] == ["Day", "Cost", "Click", "Okay", "Gone"]
    assert got["Data & more", 4] == ["2024-01-01", "1234.5", "7", "TRUE", "#N/A"]
    assert got["Data & more", 5] == ["2024-01-01 18:00:00", "", "2", "FALSE", "made"]
    assert ("Data & more", 6) not in got
    wide = rows.where("file like '%b.xlsx' and sheet_no = 0").first()
    assert wide["cells"] == ["x"] + [""] * 27 + ["ab"]


def test_one_partition_a_sheet(spark, rows, folder):
    assert rows.rdd.getNumPartitions() == 3 + 2 + 3
    assert spark.read.format("workbooks").option("sheets", "Sheet2, Cover").load(folder).where("sheet is not null").select("sheet").distinct().count() == 2
    assert [r["cells"] for r in rows.where("sheet = 'Sheet2'").collect()] == [["yy"]]
    assert rows.where("sheet = 'no such sheet'").count() == 0


def test_no_workbooks(rows):
    assert {(r["file"].rsplit("/", 1)[-1], r["error"]) for r in rows.where("error is not null").collect()} == {("sealed.xlsx", "the workbook has a password"), ("old.xlsx", "an old workbook; save it as .xlsx"), ("text.xlsx", "damaged, or no workbook")}


def test_fullest_sheet_and_dictionary(rows):
    chosen = WB.fullest_sheet(rows)
    assert {(r["file"].rsplit("/", 1)[-1], r["sheet"], r["filled"], tuple(r["others"])) for r in chosen.collect()} == {("a.xlsx", "Data & more", 15, ("Cover", "Data dictionary")), ("b.xlsx", "Sheet1", 2, ("Sheet2",))}
    assert [r["text"] for r in WB.dictionary_texts(rows, chosen).collect()] == ["Cost | what it costs\nDay | when"]
    assert [r["text"] for r in WB.dictionary_texts(rows, chosen, most=9).collect()] == ["Cost | wh"]


def test_missing_folder(spark):
    WB.register(spark)
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("workbooks").load("file:///nowhere").collect()
