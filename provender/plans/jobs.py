"""The jobs a user runs: cleaning, group fill, training preparation, classification."""

from __future__ import annotations

import argparse
import logging
import sys
from dataclasses import dataclass
from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provender import schema as S
from provender.errors import DataError
from provender.functions.partitions import spread
from provender.functions.saved import read_json
from provender.operators import classify, clean, corrections, dataset, decode, joint, report
from provender.operators.normalize import normalize
from provender.rules.ruleset import MAX_TABLE_ROWS, RuleSet
from provender.sources import readers, writers

logger = logging.getLogger("provender")

STARTER_PACK = "starter"
#: Models of one head each, or one of all heads.
ESTIMATORS = (*classify.ESTIMATORS, "joint")
Classifier = classify.TextClassifier | joint.JointClassifier


@dataclass(frozen=True)
class CleaningOptions:
    input_file: str
    raw_data: str
    clean_folder: str
    clean_file: str | None = None
    misc_file: str = writers.MISC_FILE
    rule_pack: str | None = None
    tag_scoping: str = "cumulative"
    line_breaks: bool = True
    smoke_test: bool = False
    write_output: bool = True
    run_folder: str | None = None

    def run_path(self) -> str:
        """A folder of its own for every run."""
        name = self.run_folder or (
            f"{self.input_file}-clean-{datetime.now():%Y-%m-%d %H-%M}".replace(" ", "_")
        )
        return f"{self.clean_folder.rstrip('/')}/{name}"


def rules_of(
    spark: SparkSession, rule_pack: str | None, tag_scoping: str, *, with_corrections: bool = True
) -> RuleSet:
    """The rules of a job. The open word lists of the starter pack are a selection, so it has to
    be asked for by name: a job without a pack would give incomplete results unnoticed."""
    if not rule_pack:
        raise DataError(f"a rule pack is needed: a directory, or {STARTER_PACK!r} for the selection")
    if rule_pack == STARTER_PACK:
        return RuleSet.starter(tag_scoping)
    return RuleSet.from_directory(spark, rule_pack, tag_scoping, corrections=with_corrections)


def large_corrections(spark: SparkSession, rule_pack: str | None) -> DataFrame | None:
    """The corrections of a pack, closed, if they are too many to travel inside a plan."""
    path = f"{(rule_pack or '').rstrip('/')}/corrections.csv"
    if not rule_pack or rule_pack == STARTER_PACK or not readers.path_exists(spark, path):
        return None
    rows = spark.read.option("header", True).csv(path)
    if rows.limit(MAX_TABLE_ROWS + 1).count() <= MAX_TABLE_ROWS:
        return None
    return corrections.read(spark, rule_pack)


def clean_and_normalize(df: DataFrame, rules: RuleSet, table: DataFrame | None = None) -> DataFrame:
    """Cleaned and normalized rows; ``table`` has corrections that are not in the rules."""
    cleaned = clean.clean_rows(df)
    if table is None:
        return normalize(cleaned, rules)
    resolved = corrections.with_tokens(cleaned, S.ROW_ID, S.PRODUCT_NAME, table, "_tokens")
    return normalize(resolved, rules, tokens="_tokens")


def run_cleaning(spark: SparkSession, options: CleaningOptions) -> dict[str, str]:
    """Read, clean, normalize and write all reports. Returns the written paths.

    The normalized frame feeds five outputs, so it is persisted; memory first, then disk. The
    outputs appear together. With output disabled nothing is written at all.
    """
    table = large_corrections(spark, options.rule_pack)
    rules = rules_of(
        spark, options.rule_pack, options.tag_scoping, with_corrections=table is None
    )
    raw = readers.read_purchases(
        spark,
        options.raw_data,
        options.input_file,
        smoke_test=options.smoke_test,
        line_breaks=options.line_breaks,
    )
    normalized = clean_and_normalize(raw, rules, table).persist(StorageLevel.MEMORY_AND_DISK)
    folder = options.run_path()
    if options.write_output:
        with writers.together(spark, folder) as staging:
            written = _write_reports(normalized, staging, options)
    else:
        written = _write_reports(normalized, folder, options)
    normalized.unpersist()
    return {what: f"{folder}/{path.rsplit('/', 1)[-1]}" for what, path in written.items()}


def _write_reports(normalized: DataFrame, folder: str, options: CleaningOptions) -> dict[str, str]:
    path, write = writers.output_path, options.write_output
    return {
        "normalized": writers.write_table(
            report.normalized_export(normalized),
            path(folder, options.clean_file, options.input_file),
            write=write,
        ),
        "misc": writers.write_table(
            report.misc_overflow(normalized), path(folder, options.misc_file), write=write
        ),
        "scoring": writers.write_table(
            report.scoring_export(normalized), path(folder, writers.SCORING_FILE), write=write
        ),
        "diff": writers.write_table(
            report.name_differences(normalized), path(folder, writers.DIFF_FILE), write=write
        ),
        "counts": writers.write_counts(
            report.count_sheets(report.value_counts(normalized)), folder, write=write
        ),
    }


def run_group_fill(
    spark: SparkSession, raw_data: str, input_file: str, output_folder: str
) -> str:
    """Add the food product group (and an empty commodity column) to a file."""
    df = readers.read_table(spark, readers.file_paths(raw_data, input_file)[0])
    return writers.write_table(
        clean.add_group_and_commodity(df), writers.output_path(output_folder, input_file)
    )


@dataclass(frozen=True)
class TrainingTables:
    train: DataFrame
    evaluation: DataFrame
    counts: DataFrame
    index: DataFrame
    masks: DataFrame

    def decoder(self, rules: RuleSet) -> decode.Decoder:
        return decode.Decoder.from_tables(
            self.index, self.counts, self.masks, rules.all_tags, rules.hierarchy
        )


def prepare_training(
    spark: SparkSession,
    data_dir: str,
    train_files,
    eval_files,
    text_column: str = S.PRODUCT_TYPE,
    *,
    smoke_test: bool = False,
) -> TrainingTables:
    """Read, deduplicate (each set by itself) and index the labels of both sets together."""

    def load(names, what: str) -> DataFrame:
        paths = readers.file_paths(data_dir, names)
        rows = readers.read_training(spark, paths, text_column, smoke_test=smoke_test).persist()
        kept = dataset.keep_first(rows, text_column).persist()
        logger.info("%s: dropped %d duplicate rows", what, rows.count() - kept.count())
        rows.unpersist()
        return kept

    train, evaluation = load(train_files, "train"), load(eval_files, "evaluation")
    combined = train.unionByName(evaluation)
    counts = dataset.class_counts(combined).persist()
    index = dataset.label_index(counts).persist()
    return TrainingTables(
        train, evaluation, counts, index, dataset.inference_masks(combined).persist()
    )


def train_classifier(
    tables: TrainingTables,
    rules: RuleSet,
    text_column: str = S.PRODUCT_TYPE,
    metric: str = "basic_type_accuracy",
    estimators=("naive_bayes",),
) -> tuple[Classifier, decode.Decoder, DataFrame]:
    """Fit the candidates, keep the one with the best metric on the evaluation set."""

    def fitted(kind: str) -> Classifier:
        if kind == "joint":
            return joint.JointClassifier.fit(tables.train, labels, text_column=text_column)
        return classify.TextClassifier.fit(
            tables.train, labels, text_column=text_column, estimator=kind
        )

    decoder = tables.decoder(rules)
    labels = {h: v for h, v in decoder.labels.items() if v}
    candidates = [(kind, fitted(kind)) for kind in estimators]
    _, best, metrics = classify.choose(candidates, tables.evaluation, metric)
    return best, decoder, metrics


def classify_table(
    df: DataFrame,
    classifier: Classifier,
    decoder: decode.Decoder,
    *,
    input_column: str = S.PRODUCT_TYPE,
    num_rows: int | None = None,
    threshold: float = decode.DEFAULT_THRESHOLD,
    assertion: bool = False,
) -> DataFrame:
    """Predict every output column for a table whose columns may be named loosely.

    ``num_rows`` takes the first rows: by their place in the files, or by all columns in a table
    without ``row_id``.
    """
    df = decode.canonical_names(df)
    if num_rows:
        order = [S.ROW_ID] if S.ROW_ID in df.columns else df.columns
        df = spread(readers.first_rows(df, num_rows, order))
    if input_column != classifier.text_column:
        df = df.withColumn(classifier.text_column, F.col(S.quoted(input_column)))
    scored = classifier.score(df)
    decoded = decode.decode(
        scored, classifier.score_columns(), decoder, threshold=threshold, assertion=assertion
    )
    return decode.prediction_output(decoded)


def save_model(spark: SparkSession, path: str, classifier, decoder: decode.Decoder) -> None:
    """A classifier and its decoder below one directory."""
    classifier.save(f"{path}/classifier")
    decoder.save(spark, f"{path}/decoder")


def load_model(spark: SparkSession, path: str) -> tuple[Classifier, decode.Decoder]:
    """What :func:`save_model` wrote."""
    about = read_json(spark, f"{path}/classifier/about")
    kind = joint.JointClassifier if about.get("kind") == "joint" else classify.TextClassifier
    return (
        kind.load(spark, f"{path}/classifier"),
        decode.Decoder.load(spark, f"{path}/decoder"),
    )


def run_training(
    spark: SparkSession,
    data_dir: str,
    train_files,
    eval_files,
    model_folder: str,
    rules: RuleSet,
    *,
    metric: str = "basic_type_accuracy",
    estimators=("naive_bayes",),
    smoke_test: bool = False,
) -> DataFrame:
    """Prepare, fit, choose and save. Returns the metrics of all candidates."""
    tables = prepare_training(spark, data_dir, train_files, eval_files, smoke_test=smoke_test)
    best, decoder, metrics = train_classifier(
        tables, rules, metric=metric, estimators=tuple(estimators)
    )
    save_model(spark, model_folder, best, decoder)
    return metrics


def run_classification(
    spark: SparkSession,
    data_dir: str,
    input_file: str,
    model_folder: str,
    output_folder: str,
    *,
    num_rows: int | None = None,
    threshold: float = decode.DEFAULT_THRESHOLD,
    assertion: bool = False,
    line_breaks: bool = True,
) -> str:
    """Read a file, predict all columns, write ``<stem>_classified``. Returns the written path."""
    path = readers.file_paths(data_dir, input_file)[0]
    df = readers.read_table(spark, path, numbered=num_rows is not None, line_breaks=line_breaks)
    classifier, decoder = load_model(spark, model_folder)
    done = classify_table(
        df, classifier, decoder, num_rows=num_rows, threshold=threshold, assertion=assertion
    )
    return writers.write_classified(done, path, output_folder)


def create_parser() -> argparse.ArgumentParser:
    """The options of the cleaning job."""
    parser = argparse.ArgumentParser(prog="provender", description="Clean purchase files.")
    parser.add_argument("--input_file", required=True)
    parser.add_argument("--raw_data", required=True, help="folder of the input file")
    parser.add_argument("--clean_folder", required=True, help="folder of the run folders")
    parser.add_argument("--clean_file", default=None)
    parser.add_argument("--misc_file", default=writers.MISC_FILE)
    parser.add_argument(
        "--rule_pack", required=True, help=f"directory of rule tables, or {STARTER_PACK!r}"
    )
    parser.add_argument("--tag_scoping", default="cumulative")
    _add_line_breaks(parser)
    parser.add_argument("--smoke_test", action="store_true")
    parser.add_argument(
        "--disable-output", action="store_false", dest="write_output", default=True
    )
    return parser


def _add_line_breaks(parser: argparse.ArgumentParser) -> None:
    parser.add_argument(
        "--no_line_breaks",
        action="store_false",
        dest="line_breaks",
        help="no CSV field holds a line break, so large files may be split",
    )


def fill_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="provender fill", description="Add product groups.")
    for name in ("--input_file", "--raw_data", "--output_folder"):
        parser.add_argument(name, required=True)
    return parser


def train_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="provender train", description="Fit a classifier.")
    parser.add_argument("--data_dir", required=True)
    parser.add_argument("--train_files", required=True, nargs="+")
    parser.add_argument("--eval_files", required=True, nargs="+")
    parser.add_argument("--model_folder", required=True)
    parser.add_argument("--rule_pack", required=True)
    parser.add_argument("--metric", choices=classify.CHOICE_METRICS, default=classify.CHOICE_METRICS[0])
    parser.add_argument("--estimators", nargs="+", choices=ESTIMATORS, default=["naive_bayes"])
    parser.add_argument("--smoke_test", action="store_true")
    return parser


def classify_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="provender classify", description="Classify a file.")
    for name in ("--data_dir", "--input_file", "--model_folder", "--output_folder"):
        parser.add_argument(name, required=True)
    parser.add_argument("--num_rows", type=int, default=None)
    parser.add_argument("--threshold", type=float, default=decode.DEFAULT_THRESHOLD)
    parser.add_argument("--assertion", action="store_true")
    _add_line_breaks(parser)
    return parser


def main(argv=None):
    """``[clean] ...``, ``fill ...``, ``train ...`` or ``classify ...``."""
    argv = list(sys.argv[1:] if argv is None else argv)
    job = argv.pop(0) if argv and not argv[0].startswith("-") else "clean"
    parsers = {
        "clean": create_parser, "fill": fill_parser, "train": train_parser, "classify": classify_parser
    }
    if job not in parsers:
        raise DataError(f"unknown job {job!r}; one of {', '.join(parsers)}")
    options = vars(parsers[job]().parse_args(argv))
    spark = SparkSession.builder.appName("provender").getOrCreate()
    if job == "clean":
        return run_cleaning(spark, CleaningOptions(**options))
    if job == "fill":
        return run_group_fill(spark, **options)
    if job == "classify":
        return run_classification(spark, **options)
    rules = rules_of(spark, options.pop("rule_pack"), "cumulative")
    return run_training(spark, rules=rules, **options)
