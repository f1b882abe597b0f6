"""Queue classifiers, their scores, and reports that compare them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import SEED
from ..functions.text import stripped
from ..session import materialize
from .sampling import stratified_cap
from .scale import fits_broadcast, heavy_keys, salted_join

TOKEN_PATTERN = r"[\p{L}\p{N}]+"
EMPTY_TEXT = "ValueError: empty text"
VOCABULARY_ROWS = 500_000
LABELS_PER_ROW = 64


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, as an array."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN_PATTERN), F.lit(0))


# --- multinomial naive Bayes as group-bys ------------------------------------

@dataclass
class NaiveBayesTables:
    """Counts that make up the model, stored in the shared folder."""

    token_counts: DataFrame   # label, token, n
    class_stats: DataFrame    # label, docs, n_tokens


def train_queue_nb(train: DataFrame, text: str = "text", label: str = "label") -> NaiveBayesTables:
    """Count tokens per label and documents per label (Laplace smoothing at scoring)."""
    words = train.select(F.col(label).cast("string").alias("label"),
                         F.explode_outer(tokens(F.col(text))).alias("token")).where("token IS NOT NULL")
    counts = words.groupBy("label", "token").agg(F.count(F.lit(1)).alias("n"))
    stats = train.groupBy(F.col(label).cast("string").alias("label")).agg(
        F.count(F.lit(1)).alias("docs"),
        F.sum(F.size(tokens(F.col(text)))).cast("bigint").alias("n_tokens"))
    return NaiveBayesTables(materialize(counts, "nb-tokens"), materialize(stats, "nb-labels"))


def score_queue_nb(df: DataFrame, model: NaiveBayesTables, id_col: str = "ticket_id",
                   text: str = "text", variant: str = "tuned",
                   vocabulary_rows: int = VOCABULARY_ROWS) -> DataFrame:
    """(id, label, confidence, variant, error) for every row of ``df``.

    score(c) = ln P(c) + sum over tokens of ln(n_tc + 1) - tokens * ln(T_c + V).
    The classes are an axis and not rows: a token carries the weights of up to
    ``LABELS_PER_ROW`` classes as one array, and a text adds them up element by
    element, so a text is one row per block of classes.  A model counted to fit
    is broadcast; token rows meet a larger one in an equi-join with frequent
    tokens salted.  An unknown token and an absent count add ln 1 = 0.
    """
    rows = df.select(F.col(id_col).alias("__id"), stripped(F.col(text)).alias("__text"))
    vocabulary = model.token_counts.select(F.countDistinct("token")).scalar()
    docs = model.class_stats.agg(F.sum("docs")).scalar()
    classes = model.class_stats.agg(F.sort_array(F.collect_list(F.struct(
        "label", F.log(F.col("docs") / docs).alias("prior"),
        F.log(F.col("n_tokens") + vocabulary).alias("norm"))))).scalar()
    n_classes = max(1, model.class_stats.count())
    width = min(n_classes, LABELS_PER_ROW)
    blocks = -(-n_classes // width)

    weights = _weights_by_token(model, width)
    key = F.struct(F.col("__block"), F.col("token")).alias("__key")
    # No token is the empty string, so a text without tokens keeps a row that finds no weights.
    words = (rows.where(F.col("__text") != "")
             .select("__id", F.explode_outer(tokens(F.col("__text"))).alias("token"))
             .select("__id", F.coalesce("token", F.lit("")).alias("token"),
                     F.col("token").isNotNull().cast("bigint").alias("tf"))
             .withColumn("__block", F.explode(F.array(*[F.lit(i) for i in range(blocks)]))))
    if fits_broadcast(weights, vocabulary_rows // width):
        weighted = words.select("__id", "__block", "tf", key).join(
            F.broadcast(weights.select(key, "__w")), "__key", "left")
    else:
        counted = words.groupBy("__id", "__block", "token").agg(F.sum("tf").alias("tf"))
        keyed = counted.select("__id", "__block", "tf", key)
        frequency = keyed.groupBy("__key").agg(F.count(F.lit(1)).alias("df"))
        weighted = salted_join(keyed, weights.select(key, "__w"), "__key",
                               heavy_keys(frequency, "__key", "df"), F.col("__id"), how="left")
    sums = F.array(*[F.coalesce(F.sum(F.col("tf") * F.col("__w")[i]), F.lit(0.0)) for i in range(width)])
    added = weighted.groupBy("__id", "__block").agg(sums.alias("__s"), F.sum("tf").alias("__n"))

    def score(c: Column, i: Column) -> Column:
        total = c["prior"] + F.get("__s", i) - F.col("__n") * c["norm"]
        return F.struct((-F.round(total, 6)).alias("neg"), c["label"].alias("label"))

    own = F.slice(classes, F.col("__block") * width + 1, width)
    scored = added.withColumn("__own", own).select("__id", F.transform("__own", score).alias("r")).select(
        "__id", F.array_min("r").alias("top"), "r").select(
        "__id", "top", F.aggregate("r", F.lit(0.0), lambda acc, x: acc + F.exp(F.col("top")["neg"] - x["neg"]))
        .alias("mass"))
    best = F.col("top")
    merged = scored.groupBy("__id").agg(F.min("top").alias("top"), F.collect_list(F.struct("top", "mass")).alias("b"))
    mass = F.aggregate("b", F.lit(0.0), lambda acc, x: acc + x["mass"] * F.exp(best["neg"] - x["top"]["neg"]))
    out = merged.select("__id", best["label"].alias("label"), F.round(1 / mass, 4).alias("confidence"))
    return _with_errors(rows, out, id_col, variant)


def _weights_by_token(model: NaiveBayesTables, width: int) -> DataFrame:
    """(token, __block, __w): the weights of one block of classes, classes in the order of their labels."""
    places = model.class_stats.agg(F.sort_array(F.collect_list(F.struct("label"))).alias("l")).select(
        F.posexplode("l").alias("__c", "__l")).select("__c", F.col("__l.label").alias("__label"))
    placed = model.token_counts.join(places, F.col("label").eqNullSafe(F.col("__label"))).select(
        "token", F.floor(F.col("__c") / width).cast("int").alias("__block"), (F.col("__c") % width).alias("__i"),
        F.log(F.col("n") + 1.0).alias("w"))
    dense = F.array(*[F.coalesce(F.sum(F.when(F.col("__i") == i, F.col("w"))), F.lit(0.0)) for i in range(width)])
    return materialize(placed.groupBy("token", "__block").agg(dense.alias("__w")), "nb-weights")


def score_class_prior(df: DataFrame, model: NaiveBayesTables, id_col: str = "ticket_id",
                      text: str = "text", variant: str = "base") -> DataFrame:
    """The baseline without task knowledge: always the most frequent label."""
    rows = df.select(F.col(id_col).alias("__id"), stripped(F.col(text)).alias("__text"))
    total = model.class_stats.agg(F.sum("docs")).scalar()
    top = model.class_stats.orderBy(F.desc("docs"), "label").limit(1)
    out = rows.where(F.col("__text") != "").select(
        "__id", top.select("label").scalar().alias("label"),
        F.round(top.select("docs").scalar() / total, 4).alias("confidence"))
    return _with_errors(rows, out, id_col, variant)


def _with_errors(rows: DataFrame, scored: DataFrame, id_col: str, variant: str) -> DataFrame:
    return (rows.select("__id").join(scored, "__id", "left").select(
        F.col("__id").alias(id_col), "label", "confidence", F.lit(variant).alias("variant"),
        F.when(F.col("label").isNull(), F.lit(EMPTY_TEXT)).alias("error")))


# --- logistic regression on hashed tf-idf ------------------------------------

def train_queue_classifier(train: DataFrame, text: str = "text", label: str = "label",
                           num_features: int = 1 << 16, max_iter: int = 20) -> PipelineModel:
    """Fit label index, hashed tf-idf and logistic regression on the cluster."""
    return Pipeline(stages=[
        StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc"),
        RegexTokenizer(inputCol=text, outputCol="__tokens", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="__tokens", outputCol="__tf", numFeatures=num_features),
        IDF(inputCol="__tf", outputCol="__x"),
        LogisticRegression(featuresCol="__x", labelCol="__y", probabilityCol="__p",
                           predictionCol="__yhat", rawPredictionCol="__raw",
                           maxIter=max_iter, regParam=0.01),
    ]).fit(train.select(text, label))


def score_queues(df: DataFrame, model: PipelineModel, id_col: str = "ticket_id",
                 text: str = "text", variant: str = "finetuned") -> DataFrame:
    """(id, label, confidence, variant, error); an empty text gives an error row.

    Whole texts are scored, as the trainer reads whole texts.
    """
    labels = F.array(*[F.lit(x) for x in model.stages[0].labels])
    column = model.stages[1].getInputCol()
    rows = df.select(F.col(id_col), stripped(F.col(text)).alias(column))
    out = PipelineModel(model.stages[1:]).transform(rows)
    empty = F.col(column) == ""
    return out.select(
        id_col,
        F.when(~empty, labels[F.col("__yhat").cast("int")]).alias("label"),
        F.when(~empty, F.round(F.array_max(vector_to_array("__p")), 4)).alias("confidence"),
        F.lit(variant).alias("variant"), F.when(empty, F.lit(EMPTY_TEXT)).alias("error"))


# --- evaluation ----------------------------------------------------------------

def _label_counts(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key and label: true positives, support and predictions."""
    table = pred.groupBy(*keys, F.col("y_true").cast("string").alias("t"),
                         F.col("y_pred").cast("string").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("t").alias("label"), F.when(F.col("t") == F.col("p"), F.col("n"))
                 .otherwise(zero).alias("tp"), F.col("n").alias("support"), zero.alias("predicted")),
        F.struct(F.col("p").alias("label"), zero.alias("tp"), zero.alias("support"),
                 F.col("n").alias("predicted")))
    return (table.select(*keys, F.explode(sides).alias("s")).select(*keys, "s.*")
            .groupBy(*keys, "label").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")]))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _f1(tp: Column, support: Column, predicted: Column) -> Column:
    return _ratio(2 * tp, support + predicted)


def classification_report(pred: DataFrame, labels: DataFrame | Sequence[str],
                          keys: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 (3 places) and support of every given label.

    Labels without rows are listed with zeros; a zero denominator gives 0.
    ``pred`` has y_true and y_pred; ``keys`` (e.g. variant) get a report each.
    """
    keys = list(keys)
    counts = _label_counts(pred, keys)
    names = (labels.select(F.col(labels.columns[0]).cast("string").alias("label")).distinct()
             if isinstance(labels, DataFrame) else pred.sparkSession.range(1).select(
                 F.explode(F.array(*[F.lit(str(x)) for x in labels])).alias("label")))
    # The compared variants are few; the labels, however many, stay a table.
    owners = counts.select(F.struct(*(keys or [F.lit(0).alias("__one")])).alias("o")).distinct()
    grid = names.select("label", F.explode(owners.agg(F.collect_list("o")).scalar()).alias("o")) \
        .select("o.*", "label")
    full = grid.join(counts, [*keys, "label"], "left").na.fill(0, ["tp", "support", "predicted"])
    c = F.col
    return full.select(
        *keys, "label", F.round(_ratio(c("tp"), c("predicted")), 3).alias("precision"),
        F.round(_ratio(c("tp"), c("support")), 3).alias("recall"),
        F.round(_f1(c("tp"), c("support"), c("predicted")), 3).alias("f1"), "support")


def accuracy_macro_f1(pred: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy and macro-F1 (4 places) over the labels seen in truth or prediction."""
    counts = _label_counts(pred, keys)
    f1 = _f1(F.col("tp"), F.col("support"), F.col("predicted"))
    return counts.groupBy(*keys).agg(
        F.round(F.sum("tp") / F.sum("support"), 4).alias("accuracy"),
        F.round(F.avg(f1), 4).alias("f1_macro"), F.sum("support").alias("eval_rows"))


def stack_variants(pred: DataFrame, variants: dict[str, str], id_col: str = "ticket_id") -> DataFrame:
    """Turn one prediction column per variant into rows (id, y_true, y_pred, variant)."""
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"),
                                        F.col(c).cast("string").alias("y_pred"))
                               for v, c in variants.items()]))
    return (pred.select(id_col, F.col("y_true").cast("string").alias("y_true"), each.alias("v"))
            .select(id_col, "y_true", "v.variant", "v.y_pred"))


def headline_delta(scores: DataFrame, base: str = "base", tuned: str = "finetuned") -> DataFrame:
    """Rows (metric, base, finetuned, delta); a missing score counts as 0."""
    long = scores.unpivot(["variant"], ["accuracy", "f1_macro"], "metric", "value")
    wide = long.groupBy("metric").pivot("variant", [base, tuned]).agg(F.first("value"))
    filled = wide.select("metric", F.coalesce(base, F.lit(0.0)).alias("base"),
                         F.coalesce(tuned, F.lit(0.0)).alias("finetuned"))
    return filled.withColumn("delta", F.round(F.col("finetuned") - F.col("base"), 4))


def variant_samples(tickets: DataFrame, base: DataFrame, tuned: DataFrame, n: int = 5,
                    seed: int = SEED + 1, id_col: str = "ticket_id") -> DataFrame:
    """The same tickets under both variants: text[:140], truth and right/wrong marks.

    ``tickets`` has id, text and y_true; about ``n`` rows are taken in proportion
    to y_true (at least one each), in seeded order.
    """
    picked = stratified_cap(tickets, n, id_col, "y_true", seed)
    mark = lambda c: F.when(F.col(c) == F.col("y_true"), "right").otherwise("wrong")
    side = lambda d, name: d.select(id_col, F.col("y_pred").alias(name))
    return (picked.join(side(base, "base_pred"), id_col).join(side(tuned, "finetuned_pred"), id_col)
            .select(id_col, F.substring("text", 1, 140).alias("text"), "y_true", "base_pred",
                    mark("base_pred").alias("base_mark"), "finetuned_pred",
                    mark("finetuned_pred").alias("finetuned_mark")))


def per_class_table(report: DataFrame, variant: str) -> DataFrame:
    """Explode variant -> per_class (label -> stats) into rows, best F1 first."""
    return (report.where(F.col("variant") == variant)
            .select(F.explode("per_class").alias("label", "s"))
            .select("label", "s.precision", "s.recall", "s.f1", "s.support")
            .orderBy(F.desc("f1"), "label"))


def training_curves(log: DataFrame) -> DataFrame:
    """Split a training log (log_history: array of entries) into its two series."""
    e = log.select(F.explode("log_history").alias("e")).select("e.*")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    nul = F.lit(None).cast("double")
    train = e.where("loss IS NOT NULL AND eval_loss IS NULL").select(
        F.lit("train").alias("series"), zero("epoch").alias("epoch"), F.col("loss"),
        nul.alias("accuracy"), nul.alias("f1_macro"), nul.alias("eval_loss"))
    evals = e.where("eval_loss IS NOT NULL").select(
        F.lit("eval").alias("series"), zero("epoch").alias("epoch"), nul.alias("loss"),
        zero("eval_accuracy").alias("accuracy"), zero("eval_f1_macro").alias("f1_macro"),
        F.col("eval_loss"))
    return train.unionByName(evals)
