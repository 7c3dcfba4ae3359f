"""Outputs of a run appear together or not at all."""

import os

import pytest

from provender.errors import DataError
from provender.plans import jobs
from provender.sources import writers

CSV = "Product Type,Product Name,Food Product Group,Food Product Category,Primary Food Product Category\n"


@pytest.fixture
def run(spark, tmp_path):
    (tmp_path / "raw").mkdir()

    def clean(name):
        (tmp_path / "raw" / "f.csv").write_text(CSV + f"{name},{name},Produce,Fruit,Fruit\n")
        options = jobs.CleaningOptions("f.csv", str(tmp_path / "raw"), str(tmp_path), rule_pack="starter", run_folder="run")
        return jobs.run_cleaning(spark, options)

    return clean


def types_in(spark, path):
    return [r["Product Type"] for r in spark.read.option("header", True).csv(path).collect()]


def test_a_run_that_fails_between_writes_leaves_the_old_set(spark, run, tmp_path, monkeypatch):
    paths = run("apple")
    (tmp_path / "run" / "other.txt").write_text("stays")
    before = sorted(os.listdir(tmp_path / "run"))

    def broken(*args, **options):
        raise DataError("stopped")

    with monkeypatch.context() as patch:
        patch.setattr(writers, "write_counts", broken)
        with pytest.raises(DataError, match="stopped"):
            run("pear")
    assert sorted(os.listdir(tmp_path / "run")) == before
    assert types_in(spark, paths["normalized"]) == types_in(spark, paths["scoring"]) == ["apple"]
    assert run("pear") == paths
    assert types_in(spark, paths["normalized"]) == types_in(spark, paths["scoring"]) == ["pear"]
    assert sorted(os.listdir(tmp_path / "run")) == before


def test_a_run_that_is_stopped_while_moving_is_finished_by_the_next(spark, tmp_path):
    folder = tmp_path / "out"
    ready = folder / f"{writers.READY}1"
    (ready / "b.csv").mkdir(parents=True)
    (ready / "b.csv" / "part").write_text("new b")
    for name in ("a.csv", "b.csv"):
        (folder / name).mkdir()
        (folder / name / "part").write_text("old" if name == "b.csv" else "new a")
    writers.finish_commits(spark, str(folder))
    assert sorted(os.listdir(folder)) == ["a.csv", "b.csv"]
    assert (folder / "b.csv" / "part").read_text() == "new b"
    writers.finish_commits(spark, str(folder))
    writers.finish_commits(spark, str(tmp_path / "nothing"))
