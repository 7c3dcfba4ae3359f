"""Files in, files out."""

import csv
import glob

import pytest

from provender import schema as S
from provender.errors import DataError
from provender.operators import dataset
from provender.plans import jobs
from provender.sources import readers, writers
from provender.streaming.normalize_stream import normalize_stream, read_purchase_stream

HEADER = [*S.ID_COLUMNS, *S.GROUP_COLUMNS]
ROWS = [
    ["u1", "farm", "BREAD HAM", "bread, ham", "Bread, Grains & Legumes", "Grain Products", "Rice"],
    ["u2", "farm", "APPLE", "apple, cut", "Produce", "Fruit", "Fruit"],
    ["u3", "NA", "CEREAL", "cereal, apple jacks", "Bread, Grains & Legumes", "Grain Products", ""],
    ["u4", "mill", "NAPKIN", "napkin", "Non-Food", "Non-Food", "Supplies"],
    ["u5", "mill", "SALAD", "salad, cap'n crunch, a, b", "Produce", "Vegetables", "Vegetables"],
    ["u6", "mill", 'SAID "HI", YES', "placeholder1", "placeholder2", "placeholder3", "p4"],
]


@pytest.fixture
def raw(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    with open(folder / "my file.csv", "w", newline="") as f:
        csv.writer(f).writerows([HEADER, *ROWS])
    return str(folder)


def _read(path):
    rows = []
    for part in sorted(glob.glob(f"{path}/part-*.csv")):
        with open(part, newline="") as f:
            rows += list(csv.DictReader(f))
    return rows


def test_cleaning_job(spark, raw, tmp_path):
    options = jobs.CleaningOptions(
        "my file.csv", raw, str(tmp_path / "clean"), rule_pack="starter", run_folder="run"
    )
    paths = jobs.run_cleaning(spark, options)
    assert paths["normalized"].endswith("/clean/run/clean_my_file.csv")
    table = _read(paths["normalized"])
    assert list(table[0]) == S.EXPORT_COLUMNS and len(table) == 6
    # sorted by group with missing last; ties by category and type
    assert [r[S.BASIC_TYPE] for r in table] == [
        "bread", "cereal", "", "apple", "salad", "placeholder1",
    ]
    by_type = {r[S.PRODUCT_TYPE]: r for r in table}
    assert by_type['SAID "HI", YES'][S.BASIC_TYPE] == "placeholder1"
    assert by_type['SAID "HI", YES']["Sub-Type 1"] == ""
    misc = _read(paths["misc"])
    assert {r[S.PRODUCT_TYPE]: r[S.MISC] for r in misc} == {
        "CEREAL": "['apple jacks']", "NAPKIN": "", "SALAD": "['b']",
    }
    scoring = _read(paths["scoring"])
    assert list(scoring[0])[:2] == ["Unique Id", "Producer/Processor"]
    assert {r["Unique Id"]: r[S.PRODUCT_NAME] for r in scoring}["u3"] == "cereal, corn, wheat, oat"
    assert {r["Unique Id"]: r["Producer/Processor"] for r in scoring}["u3"] == ""
    diff = _read(paths["diff"])
    assert [r["self"] for r in diff] == [
        "cereal, apple jacks", "salad, cap'n crunch, a, b", "",
    ]
    counts = spark.read.option("header", True).csv(paths["counts"])
    got = {(r["column"], r["value"]): r["Count"] for r in counts.collect()}
    assert got[("Flavor_Cut", "ham")] == "1" and got[("Food Product Group", "Produce")] == "2"
    assert got[("Sub-Types", "oat")] == "2"


def test_disabled_output_writes_nothing(spark, raw, tmp_path):
    options = jobs.CleaningOptions(
        "my file.csv",
        raw,
        str(tmp_path / "clean"),
        rule_pack="starter",
        run_folder="run",
        write_output=False,
    )
    jobs.run_cleaning(spark, options)
    assert not (tmp_path / "clean").exists()


def test_a_job_without_a_rule_pack_is_refused(spark, raw, tmp_path):
    with pytest.raises(DataError, match="rule pack"):
        jobs.run_cleaning(spark, jobs.CleaningOptions("my file.csv", raw, str(tmp_path)))


def test_missing_input(spark, tmp_path):
    with pytest.raises(DataError):
        readers.read_purchases(spark, str(tmp_path), "nothing.csv")
    with pytest.raises(DataError):
        readers.format_of("table.xlsx")


def test_output_names():
    path = writers.output_path
    assert path("out", None, "a b.xlsx") == "out/clean_a_b.csv"
    assert path("out/", "x.CSV") == "out/x.CSV"
    assert path("out", "x") == "out/x.csv"
    with pytest.raises(DataError):
        path("out")


def test_options_parser():
    options = jobs.create_parser().parse_args(
        ["--input_file", "a.csv", "--raw_data", "r", "--clean_folder", "c", "--disable-output"]
        + ["--rule_pack", "starter"]
    )
    assert options.write_output is False and options.misc_file == "misc.csv"


def test_smoke_rows(spark):
    df = spark.range(5000).withColumnRenamed("id", S.ROW_ID).repartition(7)
    got = sorted(r[0] for r in readers.first_rows(df, readers.SMOKE_TEST_ROWS).collect())
    assert got == list(range(1000))


def test_row_order_over_files_and_spreading(spark, tmp_path):
    """The first file is the smallest, which Spark reads last; one file feeds all cores."""
    folder = tmp_path / "in.csv"
    folder.mkdir()
    for name, first, n in (("part-0.csv", 0, 3), ("part-1.csv", 3, 4000)):
        with open(folder / name, "w", newline="") as f:
            rows = [[f"t{i % 2000 if i >= 3 else i}", str(i)] for i in range(first, first + n)]
            csv.writer(f).writerows([[S.PRODUCT_TYPE, "n"], *rows])
    for line_breaks in (True, False):
        df = readers.read_table(spark, str(folder), numbered=True, line_breaks=line_breaks)
        assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        first = readers.first_rows(df, 1000).select("n").collect()
        assert sorted(int(r["n"]) for r in first) == list(range(1000))
        kept = {r[S.PRODUCT_TYPE]: int(r["n"]) for r in dataset.keep_first(df).collect()}
        assert kept["t0"] == 0 and kept["t2"] == 2 and kept["t3"] == 3 and kept["t1999"] == 1999


def test_group_fill_job(spark, raw, tmp_path):
    path = jobs.run_group_fill(spark, raw, "my file.csv", str(tmp_path / "out"))
    rows = {r["Unique Id"]: r for r in _read(path)}
    assert rows["u1"][S.FPG] == "Bread, Grains & Legumes" and rows["u6"][S.FPG] == ""
    assert "Commodity" in rows["u1"]


def test_training_and_classification_jobs(spark, tmp_path, rules):
    def line(text, group, category, basic, st1="", packaging=""):
        row = dict.fromkeys([S.PRODUCT_TYPE, *S.LABELS], "")
        row |= {S.PRODUCT_TYPE: text, S.FPG: group, S.FPC: category, S.PFPC: category}
        row |= {S.BASIC_TYPE: basic, "Sub-Type 1": st1, "Packaging": packaging}
        return row

    train = [
        line("RED APPLE BAG", "Produce", "Fruit", "apple", "gala", "ss"),
        line("RED APPLE BAG", "Meat", "Beef", "beef"),  # a later duplicate text
        line("GREEN APPLE", "Produce", "Fruit", "apple", "gala"),
        line("SWEET APPLE", "Produce", "Fruit", "apple", "gala"),
        line("BEEF PATTY", "Meat", "Beef", "beef", "NULL"),
        line("BEEF STEAK", "Meat", "Beef", "beef"),
        line("NO GROUP", "", "Beef", "beef"),
    ]
    for name, rows in (("a.csv", train), ("b.csv", [line("BEEF RIB", "Meat", "Beef", "beef")])):
        with open(tmp_path / name, "w", newline="") as f:
            writer = csv.DictWriter(f, train[0].keys())
            writer.writeheader()
            writer.writerows(rows)
    tables = jobs.prepare_training(spark, str(tmp_path), ["a.csv"], "b.csv")
    texts = {r[S.PRODUCT_TYPE]: r for r in tables.train.collect()}
    assert len(texts) == 5 and texts["RED APPLE BAG"][S.FPG] == "Produce"
    assert texts["BEEF PATTY"]["Sub-Type 1"] == "None"
    counts = {(r["column"], r["label"]): r["count"] for r in tables.counts.collect()}
    assert counts[("Sub-Types", "gala")] == 3 and counts[("Sub-Types", "None")] == 15
    model, decoder, metrics = jobs.train_classifier(tables, rules)
    assert metrics.first()["basic_type_accuracy"] == 1.0
    requests = spark.createDataFrame(
        [(7, "YELLOW APPLE"), (8, "BEEF ROAST")], "`center product ID` int, `PRODUCT type` string"
    )
    out = {
        r["Product Identifier"]: r
        for r in jobs.classify_table(requests, model, decoder, assertion=True).collect()
    }
    assert (out["7"][S.FPG], out["7"][S.BASIC_TYPE]) == ("Produce", "apple")
    assert out["7"]["Sub-Type 1"] == "gala" and out["8"][S.FPC] == "Beef"
    assert out["8"]["Sub-Type 1"] is None and out["8"]["Packaging"] is None
    folder = str(tmp_path / "model")
    jobs.save_model(spark, folder, model, decoder)
    loaded = jobs.load_model(spark.newSession(), folder)
    again = jobs.classify_table(requests, *loaded, assertion=True)
    assert {r["Product Identifier"]: r for r in again.collect()} == out
    requests.coalesce(1).write.option("header", True).csv(str(tmp_path / "requests.csv"))
    path = jobs.run_classification(
        spark, str(tmp_path), "requests.csv", folder, str(tmp_path), num_rows=1, assertion=True
    )
    assert [r[S.FPG] for r in _read(path)] == ["Produce"]
    path = writers.write_classified(
        jobs.classify_table(requests, model, decoder, num_rows=1), "in/req.csv", str(tmp_path)
    )
    assert path.endswith("req_classified.csv") and len(_read(path)) == 1


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "arriving"
    folder.mkdir()
    for i, row in enumerate(ROWS):
        with open(folder / f"{i}.csv", "w", newline="") as f:
            csv.writer(f).writerows([HEADER, row])
    stream = normalize_stream(read_purchase_stream(spark, str(folder)))
    query = (
        stream.writeStream.format("memory")
        .queryName("normalized_stream")
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    got = {r["Unique Id"]: r[S.NORMALIZED_NAME] for r in spark.table("normalized_stream").collect()}
    assert got["u3"] == "cereal, corn, wheat, oat" and got["u4"] == "" and len(got) == 6
