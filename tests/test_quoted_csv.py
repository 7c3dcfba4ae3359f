"""The split reader of quoted CSV against Spark's own, which reads a file in one task."""

import random

import pytest

from provender.errors import DataError
from provender.sources import quoted_csv as Q
from provender.sources import readers


@pytest.fixture
def small_blocks(spark):
    name, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(name, "600b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set(name, before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def quoted(text):
    return '"' + text.replace('"', '""') + '"'


def made_up(seed, rows, end="\n", stray=False):
    pick = random.Random(seed)
    plain = ["", "apple", " pear ", "a b", "NA", "ü", "x;y"] + (['5" pipe', 'say "x"'] if stray else [])
    inner = ["", "x,y", 'he said "no"', '"', '""', ",", " ", f"line{end}break", f"{end}{end}", f'"{end},"', "ü" * 30,
             f"long {end}" * 40]
    lines = ["id,Product Type,c`3"]
    for i in range(rows):
        row = [pick.choice(plain) if pick.random() < 0.6 else quoted(pick.choice(inner)) for _ in range(2)]
        lines.append(",".join([str(i), *row]))
        if pick.random() < 0.05:
            lines.append("")
    return end.join(lines) + (end if seed % 2 else "")


def spark_rows(spark, path):
    return spark.read.options(header=True, **Q.OPTIONS).csv(path)


def same(spark, path):
    want = spark_rows(spark, path)
    got = Q.read(spark, path, "n")
    assert got.columns == [*want.columns, "n"]
    rows = sorted(got.collect(), key=lambda r: r["n"])
    assert [r["n"] for r in rows] == list(range(len(rows)))
    assert [tuple(r)[:-1] for r in rows] == [tuple(r) for r in want.collect()]
    return got


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equal_to_spark(spark, tmp_path, small_blocks, seed, end):
    file = tmp_path / "t.csv"
    file.write_bytes(made_up(seed, 200, end, stray=seed > 3).encode())
    got = same(spark, str(file))
    assert got.rdd.getNumPartitions() > 4
    starts, across = Q.compose(Q.blocks_of(Q._lines(spark, str(file))))
    assert across and any(s.inside for s in starts.values())


def test_several_files_in_order_of_their_paths(spark, tmp_path, small_blocks):
    for seed, name in enumerate(["b.csv", "a.csv", "c.csv"]):
        (tmp_path / name).write_text(made_up(seed, 40 + seed))
    rows = sorted(Q.read(spark, str(tmp_path), "n").collect(), key=lambda r: r["n"])
    want = [tuple(r) for name in ("a.csv", "b.csv", "c.csv") for r in spark_rows(spark, str(tmp_path / name)).collect()]
    assert [tuple(r)[:-1] for r in rows] == want


def test_records_larger_than_blocks_and_files_without_rows(spark, tmp_path, small_blocks):
    for name, text in {
        "large.csv": "a,b\n1," + quoted("x\n" * 5000) + "\n2,y\n",
        "header.csv": "a,b\n",
        "long header.csv": quoted("a\n" * 900) + ",b\n1,2\n",
        "one line.csv": "a,b",
        "mixed.csv": "a,b\n1,2\r\n\r\n" + quoted("x\r\ny") + ",z\n",
        "mixed too.csv": "a,b\r\n1,2\r\n\r\n" + quoted("x\ny\r\n") + ",z\n",
        "short.csv": "a,b,c\n1\n1,2,3,4\n\n",
    }.items():
        (tmp_path / name).write_text(text)
        same(spark, str(tmp_path / name))
    (tmp_path / "empty.csv").write_text("")
    assert Q.read(spark, str(tmp_path / "empty.csv"), "n").collect() == []


@pytest.mark.parametrize("line, inside, after", [
    ("a,b", False, False), ("a,b", True, True), ('"a', False, True), ('a"', False, False), ('a"', True, False),
    ('"a""', False, True), ('"a"""', False, False), ('x,"y', False, True), ('x"y,"z', False, True),
    ('"a"b,"c', False, True), ('a","b', True, True), ('a",b', True, False), ('""', False, False), ('""', True, True),
])
def test_states_after_a_line(line, inside, after):
    assert Q.ends_inside(line, inside) is after


def test_composition():
    blocks = [
        Q.Block("b", 0, (True, False), (3, 2)),
        Q.Block("a", 9, (False, True), (4, 4)),
        Q.Block("a", 0, (True, True), (1, 0)),
        Q.Block("a", 5, (False, True), (2, 1)),
    ]
    starts, across = Q.compose(blocks)
    assert across
    assert starts == {
        ("a", 0): Q.Start(False, -1, 0, True),
        ("a", 5): Q.Start(True, -1, 0, False),
        ("a", 9): Q.Start(True, 0, 1, False),
        ("b", 0): Q.Start(False, -1, 5, True),
    }


def test_files_that_change_are_noticed(spark, tmp_path):
    file = tmp_path / "t.csv"
    file.write_text("a,b\n1,2\n")
    lines = Q._lines(spark, str(file))
    with pytest.raises(Exception, match="changed"):
        Q._cut(lines, spark.sparkContext.broadcast({}), True).collect()
    assert issubclass(DataError, Exception)


def test_tables_of_jobs_use_it(spark, tmp_path, small_blocks):
    file = tmp_path / "t.csv"
    file.write_text(made_up(1, 100))
    rows = readers.read_table(spark, str(file), numbered=True).collect()
    want = spark_rows(spark, str(file)).collect()
    assert [r["row_id"] for r in sorted(rows, key=lambda r: r["row_id"])] == list(range(len(want)))
    first = {r["id"]: r["row_id"] for r in rows}
    assert [first[r["id"]] for r in want] == list(range(len(want)))


def test_ordinals_of_parquet_files(spark, tmp_path):
    path = str(tmp_path / "p.parquet")
    spark.range(500).selectExpr("id", "cast(id AS string) AS t").repartition(7, "id").write.parquet(path)
    rows = readers.read_table(spark, path, numbered=True).collect()
    assert sorted(r["row_id"] for r in rows) == list(range(500))
    want = [r["id"] for r in spark.read.parquet(path).select("id", "_metadata.file_path", "_metadata.row_index").orderBy("file_path", "row_index").collect()]
    assert [int(r["id"]) for r in sorted(rows, key=lambda r: r["row_id"])] == want
