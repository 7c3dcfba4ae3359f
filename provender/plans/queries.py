"""The registered queries. Each reads whole tables below a directory and returns a DataFrame."""

from __future__ import annotations

from functools import cache

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provender import schema as S
from provender.functions.expressions import broadcast_if_small, let
from provender.functions.shared import in_columns, let_go, new_path
from provender.operators import bayes, classify, clean, corrections, dataset, decode, joint, long_decode, metrics, report
from provender.operators import normalize as N
from provender.plans import purchases as P
from provender.plans import scores
from provender.rules.ruleset import RuleSet
from provender.sources import quoted_csv, readers, writers


@cache
def rules(tag_scoping: str = "cumulative") -> RuleSet:
    return RuleSet.starter(tag_scoping)


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return clean.clean_rows(P.loaded_purchases(spark, sf))


def normalized(spark: SparkSession, sf: str, tag_scoping: str = "cumulative") -> DataFrame:
    return N.normalize(cleaned(spark, sf), rules(tag_scoping))


def _cols(names) -> list:
    return [F.col(S.quoted(c)) for c in names]


def _text(name: str):
    return F.array_join(F.col(S.quoted(name)), "|").alias(name)


# --- sources and cleaning ------------------------------------------------------------------------


def q_quoted_csv_rows(spark, sf):
    """Documents written as CSV, with line breaks and quotes inside fields, and read back in blocks.

    Files and rows in them are in the order of the ids, so ordinals are those of the sorted table."""
    remark = F.concat(F.lit('"'), F.col("source"), F.lit('",\n"'), F.col("text"))
    docs = P.read(spark, sf, "documents").select("doc_id", remark.alias("remark"), "lang")
    path = new_path(spark, "documents.csv")
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.write.options(header=True, quote='"', escape='"').csv(path)
    return quoted_csv.read(spark, path, "ordinal")


def q_load_purchases(spark, sf):
    return P.loaded_purchases(spark, sf).select(
        "Unique Id", "Origin Detail", *_cols(S.GROUP_COLUMNS)
    )


def q_clean_rows(spark, sf):
    return cleaned(spark, sf).select(S.ROW_ID, *_cols([*S.ID_COLUMNS, *S.GROUP_COLUMNS]))


def q_build_name(spark, sf):
    """A table without a name column gets one from its normalized columns."""
    done = normalized(spark, sf).select("Unique Id", *_cols(S.NORMALIZED_COLUMNS))
    return clean.build_name(done).select("Unique Id", S.quoted(S.PRODUCT_NAME))


def q_fill_group(spark, sf):
    rows = P.loaded_purchases(spark, sf).drop(S.FPG)
    return clean.fill_group(rows).select("Unique Id", *_cols([S.FPC, S.FPG]))


def q_group_commodity(spark, sf):
    rows = P.raw_purchases(spark, sf)
    return clean.add_group_and_commodity(rows).select(
        "Unique Id", *_cols([S.FPC, S.FPG, "Commodity"])
    )


def q_smoke_rows(spark, sf):
    """The first 1000 rows, which is what a smoke test runs on."""
    rows = P.loaded_purchases(spark, sf)
    return readers.first_rows(rows, readers.SMOKE_TEST_ROWS).select(
        S.ROW_ID, "Unique Id", S.quoted(S.PRODUCT_NAME)
    )


# --- normalization -------------------------------------------------------------------------------


def _folded(spark, sf) -> DataFrame:
    """Cleaned rows that are normalized token by token."""
    rows = cleaned(spark, sf)
    return rows.filter(
        ~F.col(S.quoted(S.FPC)).eqNullSafe(F.lit(N.NON_FOOD))
        & ~F.col(S.quoted(S.PRODUCT_TYPE)).isin(list(rules().overrides))
    )


def q_token_clean(spark, sf):
    """One row per token, as the normalization resolves it."""
    tokens = _folded(spark, sf).select(
        "Unique Id", N.split_tokens(F.col(S.quoted(S.PRODUCT_NAME)), rules()).alias("tokens")
    )
    return tokens.select("Unique Id", F.posexplode("tokens").alias("pos", "token"))


def starter_corrections(spark: SparkSession) -> DataFrame:
    """The corrections of the starter pack as a table."""
    return spark.createDataFrame(list(rules().corrections.items()), "raw string, clean string")


def q_token_clean_joined(spark, sf):
    """The same as ``token_clean`` with the corrections as a table of any size, by joins."""
    rows = _folded(spark, sf).select("Unique Id", S.quoted(S.PRODUCT_NAME))
    table = corrections.closed(starter_corrections(spark))
    tokens = corrections.with_tokens(rows, "Unique Id", S.PRODUCT_NAME, table)
    return tokens.select("Unique Id", F.posexplode("tokens").alias("pos", "token"))


def q_normalize_joined(spark, sf):
    """The same as ``normalize_names`` with the corrections as a table of any size, by joins."""
    rows = cleaned(spark, sf)
    table = corrections.closed(starter_corrections(spark))
    tokens = corrections.with_tokens(rows, "Unique Id", S.PRODUCT_NAME, table, "_tokens")
    names = N.normalize(tokens, rules().with_rules(corrections={}), tokens="_tokens")
    return _normalized_columns(names)


def order_corrections(spark: SparkSession, sf: str) -> DataFrame:
    """A table of corrections as long as orders: each order's number (from 1) is corrected to its half, so
    that chains are as long as the numbers let them be."""
    key = F.col("o_orderkey")
    return P.read(spark, sf, "orders").where(key > 0).select(
        F.concat(F.lit("order "), key).alias("raw"),
        F.concat(F.lit("order "), F.floor(key / 2)).alias("clean"),
    )


def q_corrections_closed(spark, sf):
    """Chains of corrections followed to their ends, in a table that grows with orders."""
    return corrections.closed(order_corrections(spark, sf))


def q_token_clean_orders(spark, sf):
    """Tokens of line items' names, corrected by the table that grows with orders."""
    lines = P.read(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line"),
        F.concat(F.lit(" Order "), F.col("l_orderkey"), F.lit(",part "), F.col("l_partkey")).alias("name"),
    )
    table = corrections.closed(order_corrections(spark, sf))
    tokens = corrections.with_tokens(lines, "line", "name", table)
    return tokens.select("line", F.array_join("tokens", "|").alias("tokens"))


def q_type_map_first(spark, sf):
    first = F.get(F.split(S.quoted(S.PRODUCT_NAME), ",", -1), F.lit(0))
    state = let(
        N.resolve_token(first, rules()), lambda token: N.initial_state(token, rules())
    )
    rows = _folded(spark, sf).select("Unique Id", F.inline(F.array(state)))
    return rows.select(
        "Unique Id",
        F.col("bt").alias(S.BASIC_TYPE),
        F.array_join("st", "|").alias(S.SUB_TYPES),
        F.col("tags.c1").alias("Shape"),
        F.col("tags.c4").alias("Processing"),
        F.col("tags.c9").alias("Dietary Accommodation"),
    )


def _tag_gate(spark, sf, tag_scoping):
    """How often each token meets a column in the category of its row."""
    gate = spark.createDataFrame(
        [
            (category, tag, column)
            for category, tags in rules(tag_scoping).gates.items()
            for tag, column in tags.items()
        ],
        "category string, token string, column string",
    )
    category, primary = F.col(S.quoted(S.FPC)), F.col(S.quoted(S.PFPC))
    tokens = _folded(spark, sf).select(
        F.when(category == "Meals", primary).otherwise(category).alias("category"),
        F.explode(N.split_tokens(F.col(S.quoted(S.PRODUCT_NAME)), rules())).alias("token"),
    )
    counts = tokens.groupBy("category", "token").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(broadcast_if_small(gate), ["category", "token"], "left").select(
        "category", "token", "column", "n"
    )


def q_tag_gate_cumulative(spark, sf):
    return _tag_gate(spark, sf, "cumulative")


def q_tag_gate_isolated(spark, sf):
    return _tag_gate(spark, sf, "isolated")


def _normalized_columns(df):
    return df.select(
        "Unique Id",
        *_cols(S.EXPORT_COLUMNS),
        _text(S.SUB_TYPES),
        _text(S.MISC),
        F.col(S.quoted(S.NORMALIZED_NAME)),
    )


def q_normalize_names(spark, sf):
    return _normalized_columns(normalized(spark, sf))


def q_normalize_isolated(spark, sf):
    return _normalized_columns(normalized(spark, sf, "isolated"))


def q_normalize_distinct_first(spark, sf):
    return _normalized_columns(N.normalize(cleaned(spark, sf), rules(), distinct_first=True))


def q_normalize_override(spark, sf):
    rows = cleaned(spark, sf).filter(
        F.col(S.quoted(S.PRODUCT_TYPE)).isin(list(rules().overrides))
        & ~F.col(S.quoted(S.FPC)).eqNullSafe(F.lit(N.NON_FOOD))
    )
    return _normalized_columns(N.normalize(rows, rules()))


def q_normalize_nonfood(spark, sf):
    rows = cleaned(spark, sf).filter(F.col(S.quoted(S.FPC)) == N.NON_FOOD)
    return _normalized_columns(N.normalize(rows, rules()))


def q_subtype_collapse(spark, sf):
    """Collapsing applied to all tokens after the first, as if all were sub-types."""
    rows = _folded(spark, sf).select(
        "Unique Id",
        F.col(S.quoted(S.FPC)),
        N.split_tokens(F.col(S.quoted(S.PRODUCT_NAME)), rules()).alias("tokens"),
    )
    rows = rows.withColumn(
        "st", F.array_distinct(F.slice("tokens", F.lit(2), F.greatest(F.size("tokens"), F.lit(1))))
    )
    return rows.select(
        "Unique Id",
        F.array_join(
            N.collapse_subtypes(F.col("st"), F.col(S.quoted(S.FPC)), rules()), "|"
        ).alias(S.SUB_TYPES),
    )


def q_column_dedupe(spark, sf):
    """Repeats removed across the three categories and all tokens."""
    rows = _folded(spark, sf).select(
        "Unique Id",
        *_cols(S.CATEGORY_LABELS),
        N.split_tokens(F.col(S.quoted(S.PRODUCT_NAME)), rules()).alias("tokens"),
    )
    values = F.concat(F.array(*_cols(S.CATEGORY_LABELS)), F.col("tokens"))
    rows = rows.select("Unique Id", N.without_repeats(values).alias("v"))
    return rows.select("Unique Id", F.posexplode("v").alias("pos", "value"))


# --- reports -------------------------------------------------------------------------------------


def q_normalized_name(spark, sf):
    return normalized(spark, sf).select("Unique Id", S.quoted(S.NORMALIZED_NAME))


def _for_sorting(spark, sf, columns):
    """A sort reads its input twice, once to find its ranges, so the columns of the report are kept."""
    rows = normalized(spark, sf).select(S.ROW_ID, *_cols(dict.fromkeys(columns)))
    return rows.persist(StorageLevel.MEMORY_AND_DISK)


def q_name_diff(spark, sf):
    return report.name_differences(_for_sorting(spark, sf, [S.PRODUCT_TYPE, S.PRODUCT_NAME, S.NORMALIZED_NAME]))


def q_misc_overflow(spark, sf):
    return report.misc_overflow(_for_sorting(spark, sf, S.MISC_EXPORT_COLUMNS), as_text=True)


def q_scoring_export(spark, sf):
    return report.scoring_export(normalized(spark, sf))


def q_normalized_export(spark, sf):
    return report.normalized_export(_for_sorting(spark, sf, S.EXPORT_COLUMNS))


def q_written_export(spark, sf):
    """The normalized table written by the job's writer, with misc beside it, and read back."""
    columns = [S.ROW_ID, *dict.fromkeys([*S.EXPORT_COLUMNS, *S.MISC_EXPORT_COLUMNS])]
    folder = new_path(spark, "run")
    with (
        in_columns(normalized(spark, sf).select(*_cols(columns)), "rows") as rows,
        writers.together(spark, folder) as staging,
    ):
        path = writers.output_path(staging, None, "some purchases.csv")
        writers.write_table(report.normalized_export(rows), path)
        let_go(spark)
        writers.write_table(report.misc_overflow(rows), writers.output_path(staging, writers.MISC_FILE))
    let_go(spark)
    return readers.read_table(spark, f"{folder}/{path.rsplit('/', 1)[-1]}")


def q_written_counts(spark, sf):
    """Value counts written one folder a column, and read back."""
    folder = new_path(spark, "run")
    with writers.together(spark, folder) as staging:
        writers.write_counts(report.count_sheets(report.value_counts(normalized(spark, sf))), staging)
    options = {"header": True, **quoted_csv.OPTIONS}
    table = spark.read.options(**options).csv(f"{folder}/{writers.COUNTS_FILE}")
    return table.select("column", "value", F.col("Count").cast("long").alias("count"))


def q_value_counts(spark, sf):
    return report.value_counts(normalized(spark, sf))


def q_value_count_sheets(spark, sf):
    return report.count_sheets(report.value_counts(normalized(spark, sf)))


def q_subtype_counts(spark, sf):
    return report.subtype_counts(normalized(spark, sf))


# --- training tables -----------------------------------------------------------------------------


def training(spark, sf) -> DataFrame:
    return readers.training_rows(normalized(spark, sf).withColumn("file_no", F.lit(0)))


def kept_labels(spark, sf, *columns) -> DataFrame:
    """The labels of the training rows, with other columns that a query needs, kept for several readers."""
    return training(spark, sf).select(*_cols([*columns, *S.LABELS])).persist()


def q_training_rows(spark, sf):
    return training(spark, sf).select(*_cols([S.PRODUCT_TYPE, *S.LABELS]))


def q_dropped_counts(spark, sf):
    return readers.dropped_counts(P.loaded_purchases(spark, sf))


def q_train_union_dedupe(spark, sf):
    """Two files, the second with the names as text, and the first row kept per text."""
    first = cleaned(spark, sf).withColumn("file_no", F.lit(0))
    second = first.withColumns(
        {"file_no": F.lit(1), S.PRODUCT_TYPE: F.col(S.quoted(S.PRODUCT_NAME))}
    )
    labels = S.CATEGORY_LABELS
    rows = readers.training_rows(first, labels=labels).unionByName(
        readers.training_rows(second, labels=labels)
    )
    return dataset.keep_first(rows).select("file_no", S.ROW_ID, *_cols([S.PRODUCT_TYPE, *labels]))


def q_class_counts(spark, sf):
    return dataset.class_counts(training(spark, sf))


def q_label_encode(spark, sf):
    return dataset.label_index(dataset.class_counts(training(spark, sf)))


def q_decoders(spark, sf):
    return dataset.decoders(dataset.label_index(dataset.class_counts(training(spark, sf))))


def q_inference_masks(spark, sf):
    return dataset.inference_masks(training(spark, sf))


def q_mask_vectors(spark, sf):
    rows = kept_labels(spark, sf)
    index = dataset.label_index(dataset.class_counts(rows)).persist()
    vectors = dataset.mask_vectors(dataset.inference_masks(rows), index)
    return vectors.select(
        F.col(S.quoted(S.FPG)),
        F.array_join(F.transform("mask", lambda x: x.cast("int").cast("string")), "").alias("mask"),
    )


def _encoded(spark, sf):
    rows = kept_labels(spark, sf, S.ROW_ID)
    index = dataset.label_index(dataset.class_counts(rows))
    return dataset.encode_labels(rows, index)


def q_encode_rows(spark, sf):
    return _encoded(spark, sf).select(S.ROW_ID, *_cols([f"{c}_index" for c in S.LABELS]))


def q_multi_hot(spark, sf):
    """The sub-types of each row as indexes, without the "no value" label."""
    rows = kept_labels(spark, sf, S.ROW_ID)
    index = dataset.label_index(dataset.class_counts(rows)).persist()
    ones = dataset.label_set_index(rows, dataset.sub_type_target(), index, S.SUB_TYPES)
    return ones.select(S.ROW_ID, F.coalesce(F.array_join("ones", "|"), F.lit("")).alias("ones"))


def q_encode_rows_joined(spark, sf):
    """The encoding of rows by joins, as for vocabularies that are too large for a literal."""
    rows = kept_labels(spark, sf, S.ROW_ID)
    index = dataset.label_index(dataset.class_counts(rows))
    done = dataset.encode_labels(rows, index, max_literal_rows=0)
    return done.select(S.ROW_ID, *_cols([f"{c}_index" for c in S.LABELS]))


# --- decoding ------------------------------------------------------------------------------------


def q_softmax_argmax(spark, sf):
    rows = scores.vectors(spark, sf)
    column = scores.score_columns()[S.FPC]
    p = decode.softmax(column)
    rows = rows.select("vec_id", p.alias("p"))
    return rows.select(
        "vec_id",
        decode.label_at(decode.argmax(F.col("p")), scores.CATEGORIES).alias("label"),
        F.round(F.array_max("p"), 6).alias("score"),
    )


def _decoded(spark, sf, **options):
    return decode.decode(
        scores.vectors(spark, sf), scores.score_columns(), scores.decoder(), **options
    )


def q_masked_argmax(spark, sf):
    rows = _decoded(spark, sf, confidence=True)
    return rows.select(
        "vec_id",
        *_cols([S.FPG, S.BASIC_TYPE]),
        F.round(F.col(S.quoted(f"{S.BASIC_TYPE}_score")), 6).alias("score"),
    )


def _decoded_long(spark, sf, **options):
    tables = scores.label_tables(spark)
    rows = scores.long_scores(spark, sf)
    return long_decode.decode_long(rows, **tables, id_column="vec_id", **options)


def q_masked_argmax_long(spark, sf):
    """The same as ``masked_argmax`` from scores in long form, masks as bitmaps."""
    return _decoded_long(spark, sf, confidence=True).select(
        "vec_id", *_cols([S.FPG, S.BASIC_TYPE]), F.round(S.quoted(f"{S.BASIC_TYPE}_score"), 6).alias("score")
    )


def q_consistency_assert_long(spark, sf):
    return _decoded_long(spark, sf, assertion=True).select("vec_id", *_cols(S.CATEGORY_LABELS))


def q_order_subtypes_long(spark, sf):
    return _decoded_long(spark, sf).select("vec_id", *_cols(S.SUB_TYPE_COLUMNS))


def q_mask_bitmaps(spark, sf):
    """The masks of ``mask_vectors`` as bitmaps, written out bit by bit."""
    rows = kept_labels(spark, sf)
    index = dataset.label_index(dataset.class_counts(rows)).persist()
    bitmaps = long_decode.mask_bitmaps(dataset.inference_masks(rows), index)
    types = index.filter(F.col("column") == S.BASIC_TYPE).select("index")
    bits = bitmaps.join(types, F.floor(F.col("index") / long_decode.BITMAP) == F.col("bucket"))
    bit = long_decode.has_bit(F.col("bits"), F.col("index")).cast("int").cast("string")
    ordered = F.array_sort(F.collect_list(F.struct("index", bit.alias("bit"))))
    return bits.groupBy(F.col("group").alias(S.FPG)).agg(
        F.array_join(F.transform(ordered, lambda x: x["bit"]), "").alias("mask")
    )


def q_masked_argmax_trained(spark, sf):
    """Masked basic types with the labels and masks that the training tables give, by joins."""
    rows = kept_labels(spark, sf)
    index = dataset.label_index(dataset.class_counts(rows)).persist()
    sizes = {r["column"]: r["count"] for r in index.groupBy("column").count().collect()}
    groups = index.filter(F.col("column") == S.FPG).select(
        F.col("index").alias("_group"), F.col("label").alias("group")
    )
    types = F.sequence(F.lit(0), F.lit(sizes[S.BASIC_TYPE] - 1))
    scored = (
        scores.dealt_vectors(spark, sf)
        .withColumn("_group", F.pmod("vec_id", F.lit(sizes[S.FPG])).cast("int"))
        .join(broadcast_if_small(groups), "_group")
        .select("vec_id", "group", "e", F.explode(types).alias("index"))
        .withColumn("score", F.exp(F.get("e", F.col("index") % 64)) / (1 + F.col("index") % 7))
    )
    masks = dataset.inference_masks(rows)
    best = decode.best_valid_labels(scored.drop("e"), index, masks, "vec_id")
    return best.select("vec_id", "group", "label", F.round("score", 6).alias("score"))


def q_consistency_assert(spark, sf):
    return _decoded(spark, sf, assertion=True).select("vec_id", *_cols(S.CATEGORY_LABELS))


def q_nonfood_decode(spark, sf):
    return _decoded(spark, sf).select(
        "vec_id", *_cols([*S.CATEGORY_LABELS, S.BASIC_TYPE, "Frozen", "Packaging"])
    )


def q_top2_subtypes(spark, sf):
    chosen = decode.select_sub_types(scores.score_columns()[S.SUB_TYPES], scores.decoder())
    labels = F.transform(
        F.array_sort(chosen), lambda i: decode.label_at(i, scores.SUB_TYPE_LABELS)
    )
    return scores.vectors(spark, sf).select(
        "vec_id", F.array_join(labels, "|").alias(S.SUB_TYPES)
    )


def q_order_subtypes(spark, sf):
    return _decoded(spark, sf).select("vec_id", *_cols(S.SUB_TYPE_COLUMNS))


def q_combined_name(spark, sf):
    return _decoded(spark, sf, combine=True).select("vec_id", S.quoted("Combined Name"))


def q_inference_output(spark, sf):
    rows = scores.vectors(spark, sf).withColumns(
        {"center product id": F.col("vec_id"), "PRODUCT TYPE": F.concat(F.lit("P"), F.col("vec_id").cast("string"))}
    )
    rows = decode.canonical_names(rows)
    done = decode.decode(rows, scores.score_columns(), scores.decoder(), assertion=True)
    return decode.prediction_output(done)


# --- evaluation ----------------------------------------------------------------------------------


def _evaluated(spark, sf) -> DataFrame:
    """Normalized labels against what the raw row says: its categories and first token."""
    before = cleaned(spark, sf)
    tokens = N.split_tokens(F.col(S.quoted(S.PRODUCT_NAME)), rules())
    before = before.withColumns(
        {f"{c}_pred": F.col(S.quoted(c)) for c in S.CATEGORY_LABELS} | {"tokens": tokens}
    )
    before = before.withColumn(f"{S.BASIC_TYPE}_pred", F.get("tokens", F.lit(0)))
    return N.normalize(before, rules())


def _head_metrics(spark, sf):
    heads = [*S.CATEGORY_LABELS, S.BASIC_TYPE]
    rows = _evaluated(spark, sf)
    for h in heads:
        rows = rows.withColumns(
            {
                h: F.coalesce(F.col(S.quoted(h)), F.lit(S.NO_LABEL)),
                f"{h}_pred": F.coalesce(F.col(S.quoted(f"{h}_pred")), F.lit(S.NO_LABEL)),
            }
        )
    return metrics.head_metrics(metrics.confusion(metrics.long_predictions(rows, heads)))


def _rounded(df, keep=("head",)):
    return df.select(*keep, *[F.round(c, 6).alias(c) for c in df.columns if c not in keep])


def q_head_metrics(spark, sf):
    return _rounded(_head_metrics(spark, sf))


def q_mean_metrics(spark, sf):
    return _rounded(metrics.mean_metrics(_head_metrics(spark, sf)), ())


def q_multilabel_metrics(spark, sf):
    rows = _evaluated(spark, sf).select(
        F.array_compact(F.array(*_cols(S.SUB_TYPE_COLUMNS))).alias("truth"),
        F.coalesce(
            F.array_distinct(F.slice("tokens", F.lit(2), F.greatest(F.size("tokens"), F.lit(1)))),
            F.array().cast("array<string>"),
        ).alias("guess"),
    )
    return _rounded(metrics.multilabel_metrics(rows, "truth", "guess"))


# --- classifier ----------------------------------------------------------------------------------


def _evaluation_part(text: str):
    """Three texts in sixteen are for evaluation, equal texts together."""
    return F.substring(F.md5(F.col(S.quoted(text))), 1, 1).isin("0", "1", "2")


def q_text_classifier(spark, sf):
    """Language and source of documents from their whole text, learnt from the rest of them.

    Documents have to have a text and both labels, as training rows do."""
    docs = P.read(spark, sf, "documents").select("text", "lang", "source")
    docs = docs.filter(F.length("text") > 0).dropna().persist()
    index = dataset.label_index(dataset.class_counts(docs, ["lang", "source"]))
    labels = classify.labels_of(index)
    part = _evaluation_part("text")
    model = classify.TextClassifier.fit(
        docs.filter(~part), labels, text_column="text", num_features=1 << 14
    )
    return _rounded(classify.evaluate(docs.filter(part), model))


def q_text_features(spark, sf):
    """Every term of documents with the number of texts it stands in and its weight."""
    features = bayes.document_frequency(P.read(spark, sf, "documents"), "text")
    return features.select("term", "texts", F.round("idf", 6).alias("idf"))


def q_bayes_terms(spark, sf):
    """The counts behind naive Bayes: for each language and term of documents."""
    docs = P.read(spark, sf, "documents").filter("length(text) > 0 and lang is not null")
    return bayes.term_counts(docs, "text", "lang").select("label", "term", "n")


def q_bayes_language(spark, sf):
    """Predicted language of the documents held out, by naive Bayes as joins of counts."""
    docs = P.read(spark, sf, "documents").filter("length(text) > 0 and lang is not null")
    part = _evaluation_part("text")
    model = bayes.fit(docs.filter(~part), "text", "lang")
    return bayes.predict(docs.filter(part), model, "doc_id", "text").select(
        "doc_id", "label", F.round("score", 4).alias("score")
    )


def q_category_classifier(spark, sf):
    """Group, category and sub-types of purchases from the product type; best of two models.

    They are compared on texts that they have not learnt from."""
    rows = kept_labels(spark, sf, S.PRODUCT_TYPE)
    part = _evaluation_part(S.PRODUCT_TYPE)
    counts = dataset.class_counts(rows).persist()
    index = dataset.label_index(counts).persist()
    decoder = decode.Decoder.from_tables(
        index, counts, dataset.inference_masks(rows), rules().all_tags
    )
    labels = {h: decoder.labels[h] for h in (S.FPG, S.FPC, S.PFPC, S.SUB_TYPES)}
    candidates = [
        (
            f"hashed_{bits}",
            classify.TextClassifier.fit(rows.filter(~part), labels, num_features=1 << bits),
        )
        for bits in (10, 14)
    ]
    _, _, table = classify.choose(candidates, rows.filter(part), "mean_f1_score")
    return table.select("model", F.round("mean_accuracy", 6).alias("mean_accuracy"),
                        F.round("mean_f1_score", 6).alias("mean_f1_score"))


def q_joint_classifier(spark, sf):
    """All heads of purchases learnt together and apart, compared on texts that neither has seen."""
    rows = kept_labels(spark, sf, S.PRODUCT_TYPE)
    part = _evaluation_part(S.PRODUCT_TYPE)
    index = dataset.label_index(dataset.class_counts(rows))
    found = classify.labels_of(index)
    labels = {h: found[h] for h in (S.FPG, S.FPC, S.PFPC, S.BASIC_TYPE, S.SUB_TYPES)}
    train = rows.filter(~part)
    candidates = [
        ("apart", classify.TextClassifier.fit(train, labels, num_features=1 << 13)),
        ("joint", joint.JointClassifier.fit(train, labels)),
    ]
    _, _, table = classify.choose(candidates, rows.filter(part), "mean_f1_score")
    return table.select("model", F.round("mean_accuracy", 6).alias("mean_accuracy"),
                        F.round("mean_f1_score", 6).alias("mean_f1_score"))


QUERIES = {
    name[2:]: function for name, function in list(globals().items()) if name.startswith("q_")
}
