import math

import pytest
from pyspark.sql import functions as F

from provender import schema as S
from provender.functions.expressions import list_text, lookup
from provender.functions import ranking
from provender.functions.ranking import rank_within
from provender.operators import dataset, decode, metrics
from provender.plans import scores
from provender.sources.readers import dropped_counts, training_rows


def test_keep_first_follows_file_and_row(spark):
    rows = spark.createDataFrame(
        [(1, 0, "a", "late"), (0, 5, "a", "second"), (0, 2, "a", "first"), (1, 1, "b", "only")],
        "file_no int, row_id long, `Product Type` string, x string",
    )
    kept = {r[S.PRODUCT_TYPE]: r["x"] for r in dataset.keep_first(rows).collect()}
    assert kept == {"a": "first", "b": "only"}


def _training_frame(spark):
    values = [
        ("p1", "Produce", "Fruit", "Fruit", "apple", "gala", None),
        ("p2", "Produce", "Fruit", "Fruit", "apple", None, "red"),
        ("p3", "Meat", "Beef", "Beef", "beef", "gala", "red"),
        (None, None, "Beef", "Beef", "beef", "x", "x"),
        ("p4", "Meat", None, None, "beef", "x", "x"),
    ]
    names = [S.PRODUCT_TYPE, *S.CATEGORY_LABELS, S.BASIC_TYPE, "Sub-Type 1", "Sub-Type 2"]
    df = spark.createDataFrame(values, ", ".join(f"`{c}` string" for c in names))
    for c in S.LABELS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df


def test_training_preparation(spark):
    raw = _training_frame(spark)
    dropped = {r["column"]: r["dropped"] for r in dropped_counts(raw).collect()}
    assert dropped == {S.PRODUCT_TYPE: 1, S.FPG: 0, S.FPC: 1, S.PFPC: 0}
    rows = training_rows(raw).persist()
    assert rows.count() == 3
    counts = dataset.class_counts(rows)
    table = {(r["column"], r["label"]): r["count"] for r in counts.collect()}
    assert table[("Sub-Type 1", "gala")] == 2 and table[("Sub-Types", "None")] == 5
    assert table[("Sub-Types", "red")] == 2 and table[("Frozen", "None")] == 3
    index = dataset.label_index(counts)
    places = {(r["column"], r["label"]): r["index"] for r in index.collect()}
    assert places[("Sub-Types", "None")] == 0 and places[("Sub-Types", "red")] == 2
    assert ("Sub-Type 1", "gala") not in places
    masks = dataset.mask_vectors(dataset.inference_masks(rows), index)
    assert {r[0]: list(r[1]) for r in masks.collect()} == {"Produce": [1, 0], "Meat": [0, 1]}
    literal = dataset.encode_labels(rows, index).select(
        S.PRODUCT_TYPE, *[f"`{c}_index`" for c in S.LABELS]
    )
    joined = dataset.encode_labels(rows, index, max_literal_rows=2).select(*[
        S.PRODUCT_TYPE, *[f"`{c}_index`" for c in S.LABELS]
    ])
    assert sorted(map(tuple, literal.collect())) == sorted(map(tuple, joined.collect()))
    first = literal.filter(F.col(S.quoted(S.PRODUCT_TYPE)) == "p2").first()
    assert first["Sub-Type 1_index"] == 0 and first["Sub-Type 2_index"] == 2
    order = [r["column"] for r in dataset.decoders(index).orderBy("head_pos", "index").collect()]
    assert list(dict.fromkeys(order)) == S.HEADS


def test_multi_hot(spark):
    row = spark.range(1).select(dataset.multi_hot(F.array(F.lit(0), F.lit(3)), 5).alias("v"))
    assert row.first()["v"] == [1, 0, 0, 1, 0]
    rows = spark.createDataFrame([([4, 0, 4],), ([],), ([2, 1],)], "ones array<int>")
    got = [r["v"] for r in rows.select(dataset.multi_hot(F.col("ones"), 5).alias("v")).collect()]
    assert got == [[1, 0, 0, 0, 1], [0] * 5, [0, 1, 1, 0, 0]]


def test_label_sets_in_both_forms(spark):
    index = spark.createDataFrame(
        [("h", x, i) for i, x in enumerate("abcd")] + [("g", "a", 9)], "column string, label string, index int"
    )
    rows = spark.createDataFrame([(1, ["d", "a"]), (2, []), (3, ["a", "a", "zz"])], "id int, s array<string>")
    for limit in (10, 0):
        out = dataset.label_set_index(rows, F.col("s"), index, "h", max_literal_rows=limit)
        assert {r["id"]: r["ones"] for r in out.collect()} == {1: [0, 3], 2: [], 3: [0]}


def test_large_heads_are_joined_without_a_hot_key(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "None" if i % 5 else f"v{i}") for i in range(200)], "id int, h string")
    index = dataset.label_index(dataset.class_counts(rows, ["h"]))
    want = {r["id"]: r["h_index"] for r in dataset.encode_labels(rows, index, ["h"]).collect()}
    monkeypatch.setattr(dataset, "MAX_BROADCAST_ROWS", 0)
    joined = dataset.encode_labels(rows, index, ["h"], max_literal_rows=0)
    assert {r["id"]: r["h_index"] for r in joined.collect()} == want
    assert joined.columns == ["id", "h", "h_index"]


@pytest.mark.parametrize("size", [100_000, 150])
def test_rank_within_equals_row_number(spark, monkeypatch, size):
    monkeypatch.setattr(ranking, "ROWS_PER_PIECE", size)
    rows = spark.range(3000).select(
        (F.col("id") % 3).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v")
    )
    got = {(r["k"], r["v"]): r["rank"] for r in
           rank_within(rows.repartition(5), ["k"], ["v"]).collect()}
    for k in range(3):
        ordered = sorted(v for kk, v in got if kk == k)
        assert [got[(k, v)] for v in ordered] == list(range(1, len(ordered) + 1))


def test_lookup_finds_every_key(spark):
    table = {f"word {i} é": i for i in range(500)}
    rows = spark.createDataFrame([(w,) for w in [*table, "absent", ""]] + [(None,)], "w string")
    got = {r[0]: r[1] for r in rows.select("w", lookup(F.col("w"), table, "int")).collect()}
    assert got == {**table, "absent": None, "": None, None: None}


def test_list_text(spark):
    rows = [["a", "b"], [], ["cap'n"], ["'\""], ["back\\slash"], None]
    df = spark.createDataFrame([(r,) for r in rows], "x array<string>")
    got = [r[0] for r in df.select(list_text(F.col("x"))).collect()]
    assert got == [None if r is None else str(r) for r in rows]


# --- decoding ------------------------------------------------------------------------------------

DECODER = decode.Decoder(
    labels={
        S.FPG: ["Meals", "Meat", "Non-Food", "Produce"],
        S.FPC: ["Beef", "Fruit", "Meals", "Non-Food"],
        S.PFPC: ["Beef", "Fruit", "Meals", "Non-Food"],
        S.BASIC_TYPE: ["None", "apple", "beef"],
        S.SUB_TYPES: ["None", "cut", "gala", "red", "unseen"],
    },
    sub_type_counts={
        "Sub-Type 1": {"gala": 9, "cut": 1},
        "Sub-Type 2": {"red": 1, "gala": 1},
        "Sub-Type 3": {},
    },
    masks={"Produce": ["apple"], "Meat": ["beef"]},
    tags=("cut",),
)


def _hot(n, i):
    return [5.0 if j == i else 0.0 for j in range(n)]


def _decode(spark, fpg, fpc, pfpc, bt, st, **options):
    bt, st = list(map(float, bt)), list(map(float, st))
    row = (_hot(4, fpg), _hot(4, fpc), _hot(4, pfpc), bt, st)
    df = spark.createDataFrame([row], "a array<double>, b array<double>, c array<double>, "
                                      "d array<double>, e array<double>")
    heads = [*S.CATEGORY_LABELS, S.BASIC_TYPE, S.SUB_TYPES]
    score = {h: F.col(c) for h, c in zip(heads, "abcde")}
    return decode.decode(df, score, DECODER, **options).first()


def test_mask_keeps_only_types_of_the_group(spark):
    row = _decode(spark, 3, 1, 1, [1.0, 2.0, 3.0], [0.0] * 5, confidence=True)
    assert row[S.BASIC_TYPE] == "apple"
    total = sum(map(math.exp, (1, 2, 3)))
    assert row["Basic Type_score"] == pytest.approx(math.exp(2) / total)
    assert row["Sub-Type 1"] is None


@pytest.mark.parametrize(
    "categories, passes",
    [((1, 0, 0), True), ((1, 1, 1), False), ((0, 2, 0), True), ((1, 0, 1), False)],
)
def test_consistency(spark, categories, passes):
    row = _decode(spark, *categories, [0.0, 1.0, 2.0], [0, 0, 1.0, 0, 0], assertion=True)
    assert (row[S.FPG] is not None) == passes and (row["Sub-Type 1"] == "gala") == passes


def test_non_food(spark):
    row = _decode(spark, 2, 0, 0, [0.0, 1.0, 2.0], [0, 0, 1.0, 0, 0], combine=True)
    assert [row[c] for c in S.CATEGORY_LABELS] == ["Non-Food"] * 3
    assert row[S.BASIC_TYPE] is None and row["Sub-Type 1"] is None and row["Combined Name"] == ""


def test_sub_types(spark):
    # three positive: the two largest, tags last, by column then count
    row = _decode(spark, 3, 1, 1, [0, 1.0, 0], [9.0, 3.0, 2.0, 1.0, -1.0], combine=True)
    assert (row["Sub-Type 1"], row["Sub-Type 2"], row["Sub-Type 3"]) == ("gala", "cut", None)
    assert row["Combined Name"] == "apple, gala, cut"
    # the "no value" class counts as 0 and is never predicted, for no threshold
    row = _decode(spark, 3, 1, 1, [0, 1.0, 0], [9.0, -3.0, -2.0, -1.0, -4.0], threshold=0.1)
    assert (row["Sub-Type 1"], row["Sub-Type 2"]) == ("red", None)
    # labels without counts are left out
    row = _decode(spark, 3, 1, 1, [0, 1.0, 0], [0.0, -3.0, -2.0, 1.0, 4.0])
    assert (row["Sub-Type 1"], row["Sub-Type 2"]) == ("red", None)


def test_decoder_from_tables_is_bounded(spark, monkeypatch):
    from provender.errors import RuleError

    monkeypatch.setattr(decode, "MAX_DECODER_ROWS", 1)
    index = spark.createDataFrame([("Frozen", "a", 0), ("Frozen", "b", 1)],
                                  "column string, label string, index int")
    with pytest.raises(RuleError):
        decode.Decoder.from_tables(index, index, index)


def test_score_slices_fit_the_vectors(spark, sf_dir):
    rows = scores.vectors(spark, sf_dir).select(
        *[F.size(c).alias(h) for h, c in scores.score_columns().items()]
    )
    sizes = rows.distinct().collect()
    assert len(sizes) == 1
    assert sizes[0].asDict() == {h: len(v) for h, v in scores.decoder().labels.items()}


# --- metrics -------------------------------------------------------------------------------------


def test_head_metrics(spark):
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")]  # "c" is never predicted
    long = spark.createDataFrame([("h", *p) for p in pairs], "head string, label string, pred string")
    row = metrics.head_metrics(metrics.confusion(long)).first()
    assert row["accuracy"] == 0.5
    assert row["recall"] == pytest.approx((1 / 2 * 2 + 1 * 1 + 0) / 4)
    assert row["precision"] == pytest.approx((1 / 2 * 2 + 1 / 2 * 1) / 3)
    assert row["f1"] == pytest.approx((1 / 2 * 2 + 2 / 3 * 1 + 0) / 4)


def test_multilabel_metrics(spark):
    rows = [(["x", "y"], ["y", "x"]), (["x"], []), ([], []), (["y"], ["z"])]
    df = spark.createDataFrame(rows, "t array<string>, p array<string>")
    row = metrics.multilabel_metrics(df, "t", "p").first()
    assert row["accuracy"] == 0.5
    # x: tp 1 of 2, y: tp 1 of 2 (both predicted once); z has no support
    assert row["precision"] == pytest.approx(1.0) and row["recall"] == pytest.approx(0.5)
    assert row["f1"] == pytest.approx(2 / 3)


def test_mean_metrics(spark):
    df = spark.createDataFrame(
        [("Basic Type", 0.5, 0.4), ("Frozen", 1.0, 0.8)], "head string, accuracy double, f1 double"
    )
    row = metrics.mean_metrics(df).first()
    assert tuple(row) == (0.75, pytest.approx(0.6), 0.5)


def test_naive_bayes_as_joins(spark):
    """Against the formula, with a term no label has, an empty text and a tie."""
    import math
    from collections import Counter

    from provender.operators import bayes

    train = [("a", "Red red apple"), ("a", "apple"), ("b", "red beef"), ("b", None), (None, "x")]
    model = bayes.fit(spark.createDataFrame(train, "label string, text string"), "text", "label")
    counts = {"a": Counter("red red apple apple".split()), "b": Counter("red beef".split())}
    base = {"a": math.log(2 / 3), "b": math.log(1 / 3)}
    texts = [(1, "apple APPLE unseen"), (2, ""), (3, "beef, beef"), (4, None)]
    got = bayes.scores(spark.createDataFrame(texts, "id int, text string"), model, "id", "text")
    got = {(r["id"], r["label"]): r["score"] for r in got.collect()}
    for i, text in texts:
        for label, c in counts.items():
            size = sum(c.values()) + 3
            words = (text or "").lower().replace(",", "").split()
            want = base[label] + sum(math.log((c[w] + 1) / size) for w in words)
            assert got[i, label] == pytest.approx(want)
    best = bayes.predict(spark.createDataFrame(texts, "id int, text string"), model, "id", "text")
    assert {r["id"]: r["label"] for r in best.collect()} == {1: "a", 2: "a", 3: "b", 4: "a"}


def test_unlisted_label_is_an_error(spark):
    from provender.operators import classify

    rows = spark.createDataFrame([("some text", "x"), ("other text", "y")], "text string, h string")
    with pytest.raises(Exception, match="label not listed: y"):
        classify.TextClassifier.fit(rows, {"h": ["x"]}, text_column="text", num_features=16)


def test_sub_types_take_part_in_the_evaluation(spark):
    from provender import schema
    from provender.operators import classify

    columns = ["Product Type", *schema.SUB_TYPE_COLUMNS]
    rows = [("red apple", "gala", "None", "None")] * 5 + [("beef rib", "None", "None", "None")] * 5
    df = spark.createDataFrame(rows, columns)
    model = classify.TextClassifier.fit(df, {schema.SUB_TYPES: ["None", "gala"]}, num_features=64)
    row = classify.evaluate(df, model).first()
    assert row["head"] == schema.SUB_TYPES and row["accuracy"] == 1.0 and row["f1"] == 1.0
