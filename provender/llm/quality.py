"""A quality classifier: perplexity under a Kneser-Ney model of trusted text.

An interpolated modified Kneser-Ney trigram model over characters is trained on all documents that are
labelled as good, whole. Counts, continuation counts, discounts and back-off weights are joins and
aggregations of Spark; the finished probabilities are sorted by n-gram and cut into shards of a
bounded size. A document's n-grams are counted and joined with each shard, which gives its
perplexity; a model of more shards than tasks should hold is joined with the documents' n-grams as a
table instead. A document passes if that is not above its language's threshold, a quantile of the
perplexities of trusted documents in that language with some slack.

A trigram of code points has 63 bits, so n-grams are exact integers and no alphabet is assumed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provender.functions.expressions import broadcast_if_small
from provender.llm.common import cut, long_texts, text_of
from provender.operators.corrections import by_word

#: Entries of the model in one shard (12 bytes each), and the most shards that are broadcast.
SHARD, MAX_SHARDS = 4_000_000, 2
#: Quantile of trusted perplexities, and what they are multiplied by.
QUANTILE, SLACK = 0.99, 1.6
#: Thresholds by language are broadcast up to this number of languages.
BROADCAST_LANGUAGES = 100_000

BITS = 21
BEGIN, END = 0x110000, 0x110001
# Characters scored at once, which bounds memory for long texts.
AT_ONCE = 1_000_000
# Local alphabets up to this size use a dense table.
DENSE = 160

KINDS = {"p3": 0, "g3": 1, "p2": 2, "g2": 3, "p1": 4}


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Symbols of some texts in a row, and for each symbol the text's number or -1 for context.

    Each text is preceded by two begin symbols, which are not scored, and followed by an end. Texts
    are gathered to about ``AT_ONCE`` symbols; longer ones are cut, with two symbols of context.
    """
    symbols, owners, size = [], [], 0
    for number, text in enumerate(texts):
        whole = np.concatenate([[BEGIN, BEGIN], points_of(text), [END]]).astype(np.uint32)
        for at in range(2, len(whole), AT_ONCE):
            piece = whole[at - 2 : at + AT_ONCE]
            owner = np.full(len(piece), number, np.int32)
            owner[:2] = -1
            symbols.append(piece)
            owners.append(owner)
            size += len(piece)
            if size >= AT_ONCE:
                yield np.concatenate(symbols), np.concatenate(owners)
                symbols, owners, size = [], [], 0
    if symbols:
        yield np.concatenate(symbols), np.concatenate(owners)


def trigram_codes(symbols: np.ndarray) -> np.ndarray:
    """The code of the trigram that ends at each symbol from the third on."""
    wide = symbols.astype(np.int64)
    return (wide[:-2] << 2 * BITS) | (wide[1:-1] << BITS) | wide[2:]


def trigram_counts(texts: DataFrame) -> DataFrame:
    """``code, n`` over all texts (column ``text``)."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for symbols, owners in pieces(batch["text"].tolist()):
                codes, n = np.unique(trigram_codes(symbols)[owners[2:] >= 0], return_counts=True)
                yield pd.DataFrame({"code": codes, "n": n})

    return texts.mapInPandas(counted, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> list[float]:
    """The three discounts of modified Kneser-Ney smoothing from the counts of counts of ``n``."""
    n = counts.agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (n[f"n{i}"] or 0 for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    raw = [i - (i + 1) * y * b / a if a else y for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    # Small or odd samples can give discounts out of range, which would break the probabilities.
    return [min(max(d, 0.05), 0.95 * i) for i, d in zip((1, 2, 3), raw, strict=True)]


def _cut_off(counts: DataFrame) -> Column:
    d1, d2, d3 = _discounts(counts)
    return F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)


def _single(counts: DataFrame) -> tuple[DataFrame, float]:
    """Discounted probabilities of single characters (``code, p``) and their back-off weight."""
    cut_off = _cut_off(counts)
    sums = counts.agg(F.sum("n").alias("total"), F.sum(cut_off).alias("freed")).first()
    if not sums["total"]:
        return counts.select("code", F.lit(0.0).alias("p")), 1.0
    p = counts.select("code", ((F.col("n") - cut_off) / F.lit(float(sums["total"]))).alias("p"))
    return p, sums["freed"] / sums["total"]


def _level(counts: DataFrame, context: Column) -> tuple[DataFrame, DataFrame]:
    """Discounted probabilities (``code, context, p``) and back-off weights (``context, g``)."""
    cut_off = _cut_off(counts)
    counts = counts.withColumn("context", context)
    totals = counts.groupBy("context").agg(F.sum("n").alias("total"), F.sum(cut_off).alias("freed"))
    p = counts.join(totals, "context").select("code", "context", ((F.col("n") - cut_off) / F.col("total")).alias("p"))
    return p, totals.select("context", (F.col("freed") / F.col("total")).alias("g"))


def train(texts: DataFrame) -> tuple[DataFrame, float]:
    """The model as ``kind, code, value`` (natural logarithms) and the probability of an unseen
    character before back-off weights. ``texts`` has a column ``text``."""
    low = F.lit((1 << 2 * BITS) - 1).cast("long")
    one = F.lit((1 << BITS) - 1).cast("long")
    c3 = cut(trigram_counts(texts))
    c2 = cut(c3.groupBy(F.col("code").bitwiseAND(low).alias("code")).agg(F.count(F.lit(1)).alias("n")))
    c1 = cut(c2.groupBy(F.col("code").bitwiseAND(one).alias("code")).agg(F.count(F.lit(1)).alias("n")))
    p3, g3 = _level(c3, F.shiftright("code", BITS))
    p2, g2 = _level(c2, F.shiftright("code", BITS))
    p1, g1 = _single(c1)
    unseen = g1 / (c1.count() + 1)
    p1 = p1.select("code", (F.col("p") + unseen).alias("p"))
    lower = p1.select(F.col("code").alias("_c"), F.col("p").alias("_q"))
    p2 = (
        p2.join(g2, "context")
        .join(lower, F.col("code").bitwiseAND(one) == F.col("_c"))
        .select("code", (F.col("p") + F.col("g") * F.col("_q")).alias("p"))
    )
    lower = p2.select(F.col("code").alias("_c"), F.col("p").alias("_q"))
    p3 = (
        p3.join(g3, "context")
        .join(lower, F.col("code").bitwiseAND(low) == F.col("_c"))
        .select("code", (F.col("p") + F.col("g") * F.col("_q")).alias("p"))
    )
    parts = [
        (p3, "p3", "code", "p"), (g3, "g3", "context", "g"), (p2, "p2", "code", "p"),
        (g2, "g2", "context", "g"), (p1, "p1", "code", "p"),
    ]
    tables = [
        frame.select(F.lit(KINDS[kind]).alias("kind"), F.col(code).alias("code"), F.log(value).alias("value"))
        for frame, kind, code, value in parts
    ]
    model = tables[0]
    for other in tables[1:]:
        model = model.union(other)
    return cut(model), unseen


class Shard:
    """Sorted n-grams of a shard with their logarithms, for each kind.

    All n-grams that a trigram backs off to share its middle character, but for the last character
    alone. So shards are told apart by the middle character, and each has all single ones.
    """

    def __init__(self, rows: dict[str, tuple[np.ndarray, np.ndarray]], unseen: float, number: int, of: int):
        self.rows, self.unseen = rows, float(np.log(unseen))
        self.number, self.of = number, of

    def find(self, kind: str, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, values = self.rows[kind]
        if not len(keys):
            return np.zeros(len(codes), bool), np.zeros(len(codes))
        at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
        hit = keys[at] == codes
        return hit, np.where(hit, values[at], 0.0)

    def logs(self, codes: np.ndarray) -> np.ndarray:
        """Log probabilities of different trigrams."""
        low, one = (1 << 2 * BITS) - 1, (1 << BITS) - 1
        hit3, p3 = self.find("p3", codes)
        hit2, p2 = self.find("p2", codes & low)
        hit1, p1 = self.find("p1", codes & one)
        back2 = self.find("g2", (codes & low) >> BITS)[1] + np.where(hit1, p1, self.unseen)
        back3 = self.find("g3", codes >> BITS)[1] + np.where(hit2, p2, back2)
        logs = np.where(hit3, p3, back3)
        return logs if self.of == 1 else np.where((codes >> BITS & one) % self.of == self.number, logs, 0.0)

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability and number of symbols of each text."""
        sums, sizes = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for symbols, owners in pieces(texts):
            mine = owners[2:]
            at = np.flatnonzero(mine >= 0)
            logs = self._logs_of(symbols)[at]
            who = mine[at]
            sums += np.bincount(who, logs, minlength=len(texts))
            sizes += np.bincount(who, minlength=len(texts))
        return sums, sizes

    def _logs_of(self, symbols: np.ndarray) -> np.ndarray:
        """Each trigram counted once is looked up once."""
        seen = np.zeros(END + 1, bool)
        seen[symbols] = True
        alphabet = np.flatnonzero(seen)
        size = len(alphabet)
        if size > DENSE:
            codes, inverse = np.unique(trigram_codes(symbols), return_inverse=True)
            return self.logs(codes)[inverse]
        number = np.zeros(END + 1, np.int32)
        number[alphabet] = np.arange(size)
        local = number[symbols]
        dense = (local[:-2] * size + local[1:-1]) * size + local[2:]
        used = np.zeros(size**3, bool)
        used[dense] = True
        cells = np.flatnonzero(used)
        first, rest = np.divmod(cells, size * size)
        second, third = np.divmod(rest, size)
        codes = (alphabet[first] << 2 * BITS) | (alphabet[second] << BITS) | alphabet[third]
        values = np.zeros(size**3)
        values[cells] = self.logs(codes)
        return values[dense]


def shards(model: DataFrame, unseen: float) -> list[Shard]:
    """The model in shards of about ``SHARD`` entries, fetched one at a time."""
    one = F.lit((1 << BITS) - 1).cast("long")
    middle = (
        F.when(F.col("kind").isin(KINDS["p3"], KINDS["p2"]), F.shiftright("code", BITS))
        .otherwise(F.col("code"))
        .bitwiseAND(one)
    )
    of = max(1, -(-model.count() // SHARD))
    found = []
    for number in range(of):
        rows = model.where((F.col("kind") == KINDS["p1"]) | (middle % of == number)).toPandas()
        rows = rows.sort_values("code")
        kinds = {
            k: (part["code"].to_numpy(np.int64), part["value"].to_numpy(np.float32))
            for k, i in KINDS.items()
            for part in [rows[rows["kind"] == i]]
        }
        found.append(Shard(kinds, unseen, number, of))
    return found


def perplexity_column(df: DataFrame, model: list[Shard], text: Column) -> Column:
    """Perplexity of each text by character; null for an empty one."""
    long_texts(df.sparkSession)
    context = df.sparkSession.sparkContext
    shared = [context.broadcast(s) for s in model]

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = batch.tolist()
            sums, sizes = np.zeros(len(texts)), np.ones(len(texts))
            for shard in shared:
                part, sizes = shard.value.score(texts)
                sums += part
            # Sums of logarithms can differ in the last bits with the cut of batches.
            values = np.round(np.exp(np.minimum(-sums / np.maximum(sizes, 1), 700)), 6)
            yield pd.Series([v if t else None for v, t in zip(values, texts, strict=True)], dtype="float64")

    # Else a filter on the result would be pushed down and have each text scored twice.
    return scored.asNondeterministic()(text)


def joined_perplexity(df: DataFrame, model: DataFrame, unseen: float, text: Column) -> DataFrame:
    """``df`` with ``perplexity`` as :func:`perplexity_column` gives it, for models of any size: different
    trigrams of all texts are looked up by joins, once each, and joined with the texts' counts."""
    long_texts(df.sparkSession)
    rows = cut(df.withColumn("_text", text).withColumn("_row", F.monotonically_increasing_id()))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["_row"].to_numpy()
            for symbols, owners in pieces(batch["_text"].tolist()):
                own = owners[2:] >= 0
                found = pd.DataFrame({"_row": ids[owners[2:][own]], "token": trigram_codes(symbols)[own]})
                yield found.groupby(["_row", "token"], as_index=False).size()

    texts = rows.where(F.length("_text") > 0).select("_row", "_text")
    grams = cut(texts.mapInPandas(counted, "_row long, token long, size long"))
    low, one = (F.lit((1 << bits) - 1).cast("long") for bits in (2 * BITS, BITS))
    code = F.col("token")
    keys = {
        "p3": code, "g3": F.shiftright(code, BITS), "p2": code.bitwiseAND(low),
        "g2": F.shiftright(code, BITS).bitwiseAND(one), "p1": code.bitwiseAND(one),
    }
    logs = grams.select("token").distinct()
    for kind, key in keys.items():
        table = model.where(F.col("kind") == KINDS[kind]).select(F.col("code").alias("_key"), F.col("value").alias(kind))
        # Tables by single characters are small whatever the text, and their keys are the hot ones.
        table = F.broadcast(table) if kind in ("g2", "p1") else table
        logs = logs.join(table, key == F.col("_key"), "left").drop("_key")
    back2 = F.coalesce("g2", F.lit(0.0)) + F.coalesce("p1", F.lit(float(np.log(unseen))))
    back3 = F.coalesce("g3", F.lit(0.0)) + F.coalesce("p2", back2)
    logs = cut(logs.select(code.alias("raw"), F.coalesce("p3", back3).alias("clean")))
    sums = by_word(grams, logs).groupBy(F.col("_row").alias("_of")).agg(
        (F.sum(F.col("clean") * F.col("size")) / F.sum("size")).alias("_mean")
    )
    perplexity = F.when(F.isnotnull("_mean"), F.round(F.exp(F.least(-F.col("_mean"), F.lit(700.0))), 6))
    joined = rows.join(sums, F.col("_row") == F.col("_of"), "left")
    return joined.withColumn("perplexity", perplexity).drop("_row", "_of", "_text", "_mean")


def scorer(model: DataFrame, unseen: float) -> Callable[[DataFrame, Column], DataFrame]:
    """Adds ``perplexity`` of a text column to a table: by shards that are broadcast while they are
    ``MAX_SHARDS`` at most, by joins beyond that."""
    if model.count() > SHARD * MAX_SHARDS:
        return lambda df, text: joined_perplexity(df, model, unseen, text)
    fitted = shards(model, unseen)
    return lambda df, text: df.withColumn("perplexity", perplexity_column(df, fitted, text))


class Classifier:
    """What scores texts with a trained model and the table of thresholds (``_lang, threshold``)."""

    def __init__(self, scored: Callable, thresholds: DataFrame, overall: float | None, scores: DataFrame):
        self.scored, self.thresholds, self.overall, self.scores = scored, thresholds, overall, scores

    def with_threshold(self, df: DataFrame, lang_col: str) -> DataFrame:
        known = self.thresholds
        if known.count() <= BROADCAST_LANGUAGES:
            known = F.broadcast(known)
        joined = df.join(known, F.col(lang_col).eqNullSafe(F.col("_lang")), "left").drop("_lang")
        return joined.withColumn("threshold", F.coalesce("threshold", F.lit(self.overall).cast("double")))


def accepted() -> Column:
    """A text with a perplexity not above the threshold; without any threshold, any such text."""
    return F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``_trusted``: ids labelled as good quality and not labelled as toxic, once each."""
    good = F.coalesce(F.max("quality") == 1, F.lit(False)) & (F.coalesce(F.max("toxic"), F.lit(0)) == 0)
    return (
        labels.where(F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_trusted"))
        .agg(good.alias("_good"))
        .where("_good")
        .select("_trusted")
    )


def fit(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> Classifier:
    """Train on trusted documents and set thresholds by language.

    The model counts every trusted document whole. All documents are scored; a threshold is the
    ``QUANTILE`` of the perplexities of all trusted documents in its language, times ``SLACK``, which
    also allows for their being the ones trained on. A language without trusted documents has the
    threshold of all languages together; if nothing is trusted, there is none and every text that is
    not empty passes.
    """
    trusted = cut(trusted_ids(labels, id_col))
    known = broadcast_if_small(trusted)
    texts = df.where(F.length(text_of(text_col)) > 0).select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    model, unseen = train(texts.join(known, F.col(id_col) == F.col("_trusted"), "left_semi").select("text"))
    scored = scorer(model, unseen)
    read = df.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), text_of(text_col).alias("_t"))
    scores = cut(scored(read, F.col("_t")).select("_id", "_lang", "perplexity"))
    held = scores.where("perplexity is not null").join(known, F.col("_id") == F.col("_trusted"), "left_semi")
    value = F.percentile_approx("perplexity", F.lit(QUANTILE), F.lit(10_000))
    threshold = (value * SLACK).alias("threshold")
    thresholds = cut(held.groupBy("_lang").agg(threshold))
    overall = held.agg(threshold).first()["threshold"]
    return Classifier(scored, thresholds, overall, scores)


def classify(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """``id, lang, perplexity, threshold, accepted``, a row for each row of ``df``.

    Null and empty texts have no perplexity and are not accepted. Null languages are a language of
    their own; null ids and repeated rows stay. Empty tables give empty results. Columns that are
    not named are not looked at.
    """
    fitted = fit(df, labels, id_col, text_col, lang_col)
    return (
        fitted.with_threshold(fitted.scores.withColumnRenamed("_lang", "lang"), "lang")
        .withColumn("accepted", accepted())
        .select(F.col("_id").alias(id_col), "lang", "perplexity", "threshold", "accepted")
    )


def keep_accepted(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """The rows of ``df`` that ``classify`` accepts. Texts are scored again rather than exchanged."""
    fitted = fit(df, labels, id_col, text_col, lang_col)
    plain = df.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(df.columns)])
    at = {c: f"_{i}" for i, c in enumerate(df.columns)}
    scored = fitted.scored(plain, text_of(at[text_col]))
    kept = fitted.with_threshold(scored, at[lang_col]).where(accepted())
    return kept.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(df.columns)])
