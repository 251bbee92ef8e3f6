"""Reading landed JSON histories and CSV sheets."""

import json
from datetime import date

import pytest

from helpers import column_of
from tidemark.sources.entities import entity_table
from tidemark.sources.history import parse_history, read_history
from tidemark.sources.sheet import read_sheet, resolve_header


def document(rows):
    return {"result": "success", "stats": [{"source": "x", "data": {"history": rows}}]}


def row(day, level, playlists, reach):
    return {
        "date": day,
        "monthly_listeners_current": level,
        "playlists_current": playlists,
        "playlist_reach_current": reach,
        "some_other_total": 3,
    }


def land(folder, entity, rows):
    path = folder / f"entity={entity}"
    path.mkdir(parents=True)
    (path / "page1.json").write_text(json.dumps(document(rows), indent=2))


def test_read_history(spark, tmp_path):
    land(tmp_path, "007", [row("2020-06-01", 10, 2, 100), row("2020-06-02", None, 2, 100.5)])
    land(tmp_path, "Two Words", [row("2020-05-31", 1, 1, 1), row("2021-01-01", 7.5, None, 9)])
    df = read_history(spark, str(tmp_path))
    assert df.columns == ["date", "entity", "level", "playlists", "reach"]
    assert {tuple(r) for r in df.collect()} == {
        (date(2020, 6, 1), "007", 10.0, 2.0, 100.0),
        (date(2020, 6, 2), "007", None, 2.0, 100.5),
        (date(2021, 1, 1), "Two Words", 7.5, None, 9.0),
    }
    assert read_history(spark, str(tmp_path), first_day="2020-01-01").count() == 4


def test_bad_date_in_history_is_an_error(spark, tmp_path):
    land(tmp_path, "A", [row("01.06.2020", 10, 2, 100)])
    with pytest.raises(Exception, match="not a date"):
        read_history(spark, str(tmp_path)).collect()


def test_parse_history(spark):
    text = json.dumps(document([row("2020-06-01", 10, 2, 100)]))
    got = parse_history(spark.createDataFrame([("A", text)], "entity string, doc string"), "doc").collect()
    assert [tuple(r) for r in got] == [(date(2020, 6, 1), "A", 10.0, 2.0, 100.0)]


SHEET = """Date,A,Smith J.,A,unknown
1/5/2026,"1,234",5,9,x
01/06/2026,,6,9,x
1/7/2026,"1,234,567",,9,x
"""


def test_read_sheet(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    path.write_text(SHEET)
    df = read_sheet(spark, str(path), ["A", "Smith J."])
    assert df.dtypes == [("date", "date"), ("entity", "string"), ("level", "bigint")]
    assert {tuple(r) for r in df.collect()} == {
        (date(2026, 1, 5), "A", 1234),
        (date(2026, 1, 7), "A", 1234567),
        (date(2026, 1, 5), "Smith J.", 5),
        (date(2026, 1, 6), "Smith J.", 6),
    }
    with pytest.raises(ValueError, match="no column"):
        read_sheet(spark, str(path), ["A", "B"])


def test_bad_cells(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    path.write_text("Date,A\n1/5/2026,12\n1/6/2026,n/a\n")
    with pytest.raises(Exception, match="not a whole number"):
        read_sheet(spark, str(path), ["A"]).collect()
    assert column_of(read_sheet(spark, str(path), ["A"], strict=False), "level") == [12]


def test_sheet_in_several_splits_has_one_header(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    lines = [f"1/{1 + n % 28}/{2000 + n // 28},{n}" for n in range(2000)]
    path.write_text("Date,A\n" + "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        df = read_sheet(spark, str(path), ["A"])
        assert df.rdd.getNumPartitions() > 3
        assert sorted(column_of(df, "level")) == list(range(2000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_header():
    assert resolve_header(["Date", "A", "B", "A"], ["A", "B"]) == {"A": 1, "B": 2}
    with pytest.raises(ValueError, match="C"):
        resolve_header(["Date", "A"], ["A", "C"])


def test_entity_table(spark):
    table = entity_table(spark)
    assert table.columns == ["entity"] and table.count() == 3


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize(
    "text",
    [
        '{"stats": [{"data": {"history": [{"date": "2020-06-01", "monthly_liste',
        '{"result": "error", "message": "limit reached"}',
        '{"stats": []}',
        '{"stats": [{}]}',
        '{"stats": [{"data": {}}]}',
        '{"stats": [{"data": {"history": [{"date": "2020-06-01", "monthly_listeners_current": "7,5"}]}}]}',
    ],
)
def test_documents_without_a_history_are_errors(spark, tmp_path, text, ansi):
    (tmp_path / "entity=A").mkdir()
    (tmp_path / "entity=A" / "data.json").write_text(text)
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(Exception, match="MALFORMED|FAILED_READ|document without history of A"):
            read_history(spark, str(tmp_path)).collect()
        with pytest.raises(Exception, match="MALFORMED|document without history of A"):
            parse_history(spark.createDataFrame([("A", text)], "entity string, doc string"), "doc").collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_history_without_days_is_no_error(spark, tmp_path):
    land(tmp_path, "A", [])
    assert read_history(spark, str(tmp_path)).collect() == []


def test_sheet_files_agree_on_their_columns(spark, tmp_path):
    (tmp_path / "1.csv").write_text("Date,A,B,x\n1/5/2026,1,2,7\n")
    (tmp_path / "2.csv").write_text("Date,A,B,y\n1/6/2026,3,4,7\n")
    got = {tuple(r)[1:] for r in read_sheet(spark, str(tmp_path), ["A", "B"]).collect()}
    assert got == {("A", 1), ("B", 2), ("A", 3), ("B", 4)}
    (tmp_path / "3.csv").write_text("Date,B,A,x\n1/7/2026,5,6,7\n")
    for strict in (True, False):
        with pytest.raises(Exception, match="different headers"):
            read_sheet(spark, str(tmp_path), ["A", "B"], strict=strict).collect()


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize(
    "other, message",
    [
        ("A,Date,B,x\n3,1/6/2026,4,7\n", "different headers"),
        ("A,B,x,Date\n3,4,7,1/6/2026\n", "different headers"),
        ("1/6/2026,3,4,7\n", "no header"),
        ("Date,A,B,x\n1/6/2026,3,4,7\nDate,B,A,x\n1/7/2026,3,4,7\n", "different headers"),
    ],
)
def test_every_file_is_read_by_its_header(spark, tmp_path, strict, other, message):
    (tmp_path / "1.csv").write_text("Date,A,B,x\n1/5/2026,1,2,7\n")
    (tmp_path / "2.csv").write_text(other)
    with pytest.raises(Exception, match=message):
        read_sheet(spark, str(tmp_path), ["A", "B"], strict=strict).collect()


@pytest.mark.parametrize("row", ["1/7/2026,1,234,5", "1/7/2026"])
def test_rows_of_another_length_are_errors(spark, tmp_path, row):
    path = tmp_path / "sheet.csv"
    path.write_text(f"Date,A,B\n1/5/2026,1,2\n{row}\n")
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ"):
        read_sheet(spark, str(path), ["A"]).collect()


def test_empty_sheet(spark, tmp_path):
    (tmp_path / "sheet.csv").write_text("")
    with pytest.raises(ValueError, match="empty"):
        read_sheet(spark, str(tmp_path / "sheet.csv"), ["A"])
