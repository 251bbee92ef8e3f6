"""The whole job on landed files, and its output tables."""

import json
import os
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.plans.run import run
from tidemark.plans.staging import staging_folder
from tidemark.settings import ANOMALY_RULES, ENTITIES
from tidemark.sinks.tables import append_history, presented, read_run_history, read_snapshot, write_snapshot

NAMES = list(ENTITIES)
FIRST = date(2025, 1, 1)


@pytest.fixture
def landed(tmp_path):
    """450 days of history up to 2026-03-26 and a sheet that runs to different days."""
    rng = random.Random(5)
    sheet = {}
    for k, name in enumerate(NAMES):
        rows, level, reach = [], 1e6 * (k + 1), 1e4
        for n in range(450):
            level *= 1 + rng.uniform(-0.01, 0.012)
            reach *= 1 + rng.uniform(-0.02, 0.022)
            day = FIRST + timedelta(days=n)
            rows.append(
                {"date": str(day), "monthly_listeners_current": level, "playlists_current": 5, "playlist_reach_current": reach}
            )
            if n > 400:
                sheet.setdefault(day, {})[name] = int(level) + 1
        for extra in range(k):
            sheet.setdefault(FIRST + timedelta(days=450 + extra), {})[name] = int(level) + 5
        folder = tmp_path / "history" / f"entity={name}"
        folder.mkdir(parents=True)
        (folder / "data.json").write_text(json.dumps({"stats": [{"data": {"history": rows}}]}))
    lines = ["Date,notes," + ",".join(NAMES)]
    for day, cells in sorted(sheet.items()):
        values = ",".join(f'"{cells[n]:,}"' if n in cells else "" for n in NAMES)
        lines.append(f"{day.month}/{day.day}/{day.year},x,{values}")
    (tmp_path / "sheet.csv").write_text("\n".join(lines) + "\n")
    return tmp_path


def test_run(spark, landed):
    paths = [str(landed / p) for p in ("history", "sheet.csv", "snapshot", "runs")]
    moments = [datetime(2026, 3, 28, 12, 0, 0), datetime(2026, 3, 28, 13, 0, 0)]
    for moment in moments:
        result = run(spark, *paths, as_of="2026-03-28", run_at=moment)
    assert {r.horizon for r in result.models.collect()} == {5, 4, 3}
    assert result.rejected.isEmpty()

    snapshot = read_snapshot(spark, paths[2]).collect()
    assert [r.entity for r in snapshot] == sorted(NAMES)
    assert {r.run_at for r in snapshot} == {moments[1]}
    last = {NAMES[k]: FIRST + timedelta(days=449 + k) for k in range(3)}
    assert {r.entity: r.latest_date for r in snapshot} == last
    assert {r.forecast_date for r in snapshot} == {date(2026, 3, 31)}
    assert all(0.8 < r.forecast / r.level < 1.25 for r in snapshot)

    runs = read_run_history(spark, paths[3]).collect()
    assert [(r.run_at, r.entity) for r in runs] == [(m, n) for m in reversed(moments) for n in sorted(NAMES)]

    text = presented(read_snapshot(spark, paths[2])).collect()
    for shown, row in zip(text, snapshot, strict=True):
        assert shown.run_at == "2026-03-28 08:00:00 CDT"
        assert shown.level == f"{row.level:,}" and shown.forecast_date == "2026-03-31"


def test_run_rejects_repeated_days(spark, landed):
    folder = landed / "history" / f"entity={NAMES[0]}"
    (folder / "again.json").write_text((folder / "data.json").read_text())
    with pytest.raises(Exception, match="duplicate row in one source"):
        run(spark, *[str(landed / p) for p in ("history", "sheet.csv", "snapshot", "runs")], as_of="2026-03-28")


def test_default_rules_name_tracked_entities():
    assert {name for name, _, _ in ANOMALY_RULES} <= set(NAMES)


def test_a_shorter_snapshot_leaves_no_old_rows(spark, tmp_path):
    rows = [(n, date(2026, 2, 1), 1.0, date(2026, 2, 28), 2.5) for n in "BA"]
    df = spark.createDataFrame(rows, "entity string, latest_date date, level double, forecast_date date, forecast double")
    path, runs = str(tmp_path / "s"), str(tmp_path / "r")
    write_snapshot(df, path, "2026-02-03 00:00:00")
    assert [r.entity for r in read_snapshot(spark, path).collect()] == ["A", "B"]
    write_snapshot(df.where("entity = 'A'"), path, "2026-02-04 00:00:00")
    assert [r.entity for r in read_snapshot(spark, path).collect()] == ["A"]
    for run_at in ("2026-02-03 00:00:00", "2026-02-04 00:00:00"):
        append_history(df, runs, run_at)
    expected = [(4, "A"), (4, "B"), (3, "A"), (3, "B")]
    assert [(r.run_at.day, r.entity) for r in read_run_history(spark, runs).collect()] == expected
    append_history(df, runs, "2026-02-04 00:00:00")  # a run that is tried again
    assert [(r.run_at.day, r.entity) for r in read_run_history(spark, runs).collect()] == expected
    append_history(df, runs, "2026-02-04 00:00:01")
    assert read_run_history(spark, runs).count() == 6
    assert presented(read_run_history(spark, runs)).first().forecast == "2.5"


SCORED = "entity string, latest_date date, level double, forecast_date date, forecast double"


def test_a_run_that_dies_leaves_the_snapshot(spark, tmp_path):
    row = ("A", date(2026, 2, 1), 1.0, date(2026, 2, 28), 2.5)
    path = str(tmp_path / "s")
    with pytest.raises(ValueError, match="no forecast"):
        read_snapshot(spark, path)
    good = spark.createDataFrame([row], SCORED)
    broken = good.withColumn("forecast", F.raise_error(F.lit("the run dies")).cast("double"))
    with pytest.raises(Exception, match="the run dies"):
        write_snapshot(broken, path, "2026-02-02 00:00:00")
    with pytest.raises(ValueError, match="no forecast"):
        read_snapshot(spark, path)
    write_snapshot(good, path, "2026-02-03 00:00:00")
    reader = read_snapshot(spark, path)
    with pytest.raises(Exception, match="the run dies"):
        write_snapshot(broken, path, "2026-02-04 00:00:00")
    assert [r.run_at.day for r in read_snapshot(spark, path).collect()] == [3]
    write_snapshot(good, path, "2026-02-05 00:00:00")
    # Whoever began to read the version before can go on.
    assert [r.run_at.day for r in reader.collect()] == [3]
    assert [r.run_at.day for r in read_snapshot(spark, path).collect()] == [5]
    assert len(list((tmp_path / "s").glob("version-*"))) == 2


def test_a_run_that_dies_before_the_switch(spark, tmp_path, monkeypatch):
    from tidemark.sinks import tables

    df = spark.createDataFrame([("A", date(2026, 2, 1), 1.0, date(2026, 2, 28), 2.5)], SCORED)
    path = str(tmp_path / "s")
    write_snapshot(df, path, "2026-02-03 00:00:00")

    def dies(*_):
        raise OSError("no more")

    with monkeypatch.context() as m:
        m.setattr(tables._Folder, "replace", dies)
        with pytest.raises(OSError):
            write_snapshot(df, path, "2026-02-04 00:00:00")
    assert [r.run_at.day for r in read_snapshot(spark, path).collect()] == [3]


def test_staging_uses_the_folder_the_session_names(spark, tmp_path):
    assert staging_folder(spark) == spark.conf.get("spark.checkpoint.dir")


class Session:
    """As much of a session as the choice of the folder asks for."""

    def __init__(self, **settings):
        self.conf = self
        self.settings = {k.replace("__", "."): v for k, v in settings.items()}

    def get(self, name, default=None):
        return self.settings.get(name, default)


def test_staging_without_a_named_folder():
    warehouse = {"spark__sql__warehouse__dir": "file:/w/"}
    for master in ("local", "local[*]", "local[8]", "local[4,2]"):
        assert staging_folder(Session(spark__master=master, **warehouse)) == "file:/w/staging"
    for master in ("local-cluster[3,2,1000]", "yarn", "k8s://x", "spark://x:7077", ""):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            staging_folder(Session(spark__master=master, **warehouse))
    assert staging_folder(Session(spark__master="yarn", spark__checkpoint__dir="hdfs:/s/")) == "hdfs:/s"


def test_staged_tables_can_be_removed(spark, monkeypatch):
    from tidemark.plans import staging

    monkeypatch.setattr(staging, "_written", {"another application": ["/nowhere"]})
    df = staging.stage(spark.range(3), "numbers")
    path = df.inputFiles()[0]
    assert df.count() == 3
    staging.drop_staged(spark)
    assert not os.path.exists(path.removeprefix("file://"))
    staging.drop_staged(spark)
    assert staging._written["another application"] == ["/nowhere"]


def test_scratch_tables_are_dropped(spark, monkeypatch):
    from tidemark.plans import staging

    monkeypatch.setattr(staging, "_written", {})
    there = lambda df: os.path.exists(df.inputFiles()[0].removeprefix("file://"))
    outside = staging.stage(spark.range(2), "outside")
    with staging.scratch(spark):
        first = staging.stage(outside, "first")
        result = staging.stage(first, "result")
    assert (there(outside), there(first), there(result)) == (True, False, True)
    with pytest.raises(ValueError), staging.scratch(spark):
        lost = staging.stage(outside, "lost")
        raise ValueError
    assert not there(lost) and result.count() == 2
    assert len(staging.written(spark)) == 2


def test_only_the_folders_of_tracked_entities_are_read(spark, landed):
    from tidemark.sources.history import read_history

    (landed / "history" / "entity=other").mkdir()
    (landed / "history" / "entity=other" / "data.json").write_text("not JSON")
    rows = read_history(spark, str(landed / "history"), entities=NAMES)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "entity" in plan.split("PartitionFilters: [")[1].split("]")[0] and "Bad Bunny" in plan
    assert rows.count() == 3 * 450
