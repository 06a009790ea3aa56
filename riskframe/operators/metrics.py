"""Classifier evaluation (D12-D17, D26-D29, D33) as grouped aggregates.

The only pass over the large input is one partial aggregation into
(group, truth, prediction) counts or (group, score) counts; every metric is
then derived from those small tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .cumulative import running_totals
from .scalars import attach

# ECE bin edges: i * 0.1 for i = 0..9 computed in binary (0.30000000000000004 ...), last edge 1.0.
ECE_EDGES = [i * 0.1 for i in range(10)] + [1.0]


def _grid(spark, by_df: DataFrame | None, labels: list[str]) -> DataFrame:
    """Every (truth, predicted) label pair, per group when ``by_df`` (distinct groups) is given:
    each group row is expanded by the literal labels^2 pairs (an inline, not a join)."""
    if by_df is None:
        return spark.createDataFrame([(a, b) for a in labels for b in labels], "truth string, predicted string")
    pairs = F.array(*[F.struct(F.lit(a).alias("truth"), F.lit(b).alias("predicted")) for a in labels for b in labels])
    return by_df.select("*", F.inline(pairs))


def confusion_matrix(df: DataFrame, truth: str, pred: str, by: list[str] | None = None,
                     labels: list[str] | None = None) -> DataFrame:
    """(by..., truth, predicted, n) for the full label grid, zero cells kept.

    Rows whose truth or prediction is outside ``labels`` are ignored. The grid
    is groups x labels^2 (a literal grid; groups are model versions), never
    data x data.
    """
    by = list(by or [])
    labels = labels or K.LABELS_ORDER
    d = df.select(*by, F.col(truth).cast("string").alias("truth"), F.col(pred).cast("string").alias("predicted")) \
          .where(F.col("truth").isin(*labels) & F.col("predicted").isin(*labels))
    counts = d.groupBy(*by, "truth", "predicted").agg(F.count(F.lit(1)).alias("n"))
    groups = counts.select(*by).distinct() if by else None
    grid = _grid(df.sparkSession, groups, labels)
    return grid.join(counts, by + ["truth", "predicted"], "left") \
               .withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def per_class(cm: DataFrame, by: list[str] | None = None) -> DataFrame:
    """D13 per class: support, predicted count, tp, precision, recall, f1 (0 on zero division)."""
    by = list(by or [])
    sup = cm.groupBy(*by, F.col("truth").alias("label")).agg(F.sum("n").alias("support"))
    prd = cm.groupBy(*by, F.col("predicted").alias("label")).agg(F.sum("n").alias("n_predicted"))
    tp = cm.where(F.col("truth") == F.col("predicted")).select(*by, F.col("truth").alias("label"),
                                                               F.col("n").alias("tp"))
    j = sup.join(prd, by + ["label"]).join(tp, by + ["label"])
    tpd = F.col("tp").cast("double")
    return j.select(
        *by, "label", "support", "n_predicted", "tp",
        F.when(F.col("n_predicted") > 0, tpd / F.col("n_predicted")).otherwise(0.0).alias("precision"),
        F.when(F.col("support") > 0, tpd / F.col("support")).otherwise(0.0).alias("recall"),
        F.when(F.col("support") + F.col("n_predicted") > 0,
               2.0 * tpd / (F.col("support") + F.col("n_predicted"))).otherwise(0.0).alias("f1"),
    )


def summary(cm: DataFrame, by: list[str] | None = None) -> DataFrame:
    """D13/D14 one row per group.

    macro_f1 averages labels present in truth or prediction (library default),
    macro_f1_all averages all labels (report), balanced_accuracy averages
    recall over labels present in truth; critical/high recall from the report.
    """
    by = list(by or [])
    pc = per_class(cm, by)
    present = (F.col("support") + F.col("n_predicted")) > 0
    in_truth = F.col("support") > 0
    agg = pc.groupBy(*by).agg(
        F.sum("support").alias("n"),
        F.sum("tp").alias("n_correct"),
        (F.sum(F.when(present, F.col("f1")).otherwise(0.0)) /
         F.greatest(F.count_if(present), F.lit(1))).alias("macro_f1"),
        F.avg("f1").alias("macro_f1_all"),
        (F.sum(F.col("f1") * F.col("support")) / F.greatest(F.sum("support"), F.lit(1))).alias("weighted_f1"),
        (F.sum(F.when(in_truth, F.col("recall")).otherwise(0.0)) /
         F.greatest(F.count_if(in_truth), F.lit(1))).alias("balanced_accuracy"),
        F.max(F.when(F.col("label") == "CRITICAL", F.col("recall"))).alias("critical_recall"),
        F.max(F.when(F.col("label") == "HIGH", F.col("recall"))).alias("high_recall"),
    )
    return agg.withColumn("accuracy", F.col("n_correct") / F.greatest(F.col("n"), F.lit(1))) \
              .withColumn("error_rate", F.lit(1.0) - F.col("accuracy"))


def ece_bin(conf) -> F.Column:
    """Bin index 0..9 for [e_i, e_{i+1}); confidence outside [0, 1) -> null (1.0 is in no bin)."""
    c = F.col(conf) if isinstance(conf, str) else conf
    expr = F.when(c.isNull() | (c >= F.lit(ECE_EDGES[-1])) | (c < F.lit(ECE_EDGES[0])), F.lit(None))
    for i in range(9, -1, -1):
        expr = expr.when(c >= F.lit(ECE_EDGES[i]), F.lit(i))
    return expr.cast("int")


def ece(df: DataFrame, conf: str, correct: str, by: list[str] | None = None) -> DataFrame:
    """sum_b n_b / N * |acc_b - conf_b| with N counting every row."""
    by = list(by or [])
    d = df.select(*by, F.col(conf).cast("double").alias("__c"), F.col(correct).cast("double").alias("__a"),
                  ece_bin(F.col(conf)).alias("__bin"))
    bins = d.groupBy(*by, "__bin").agg(F.count(F.lit(1)).alias("__nb"), F.avg("__a").alias("__acc"),
                                       F.avg("__c").alias("__conf"))
    tot = bins.groupBy(*by).agg(F.sum("__nb").alias("__nt"))
    j = bins.join(tot, by) if by else attach(bins, tot)
    return j.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(F.col("__bin").isNotNull(),
                                F.col("__nb") / F.col("__nt") * F.abs(F.col("__acc") - F.col("__conf")))),
                   F.lit(0.0)).alias("ece"))


def auc(df: DataFrame, score: str, label: str, by: list[str] | None = None,
        undefined: float = 0.5) -> DataFrame:
    """Binary ROC AUC = sum over negatives of (positives scored higher + half the ties) / (P*N).

    One aggregation to (group, score) -> (pos, neg), then two-level running
    totals of positives from the top; ``undefined`` when a class is missing.
    """
    by = list(by or [])
    c = df.select(*by, F.col(score).cast("double").alias("__s"), F.col(label).cast("int").alias("__y")) \
          .where(F.col("__s").isNotNull() & F.col("__y").isNotNull()) \
          .groupBy(*by, "__s").agg(F.count_if(F.col("__y") == 1).alias("__pos"),
                                   F.count_if(F.col("__y") != 1).alias("__neg"))
    r = running_totals(c, "__s", ["__pos"], by, descending=True)
    # cum_pos is inclusive of this score; positives strictly above = cum - own
    r = r.withColumn("__term", F.col("__neg") * ((F.col("cum___pos") - F.col("__pos")) + F.col("__pos") / 2.0))
    agg = r.groupBy(*by).agg(F.sum("__term").alias("__u"), F.sum("__pos").alias("__npos"), F.sum("__neg").alias("__nneg"))
    return agg.select(*by, F.when((F.col("__npos") > 0) & (F.col("__nneg") > 0),
                                  F.col("__u") / (F.col("__npos") * F.col("__nneg"))).otherwise(F.lit(undefined))
                      .alias("roc_auc"))


def auc_ovr_macro(df: DataFrame, probs: str, truth_idx: str, n_classes: int = 4,
                  by: list[str] | None = None) -> DataFrame:
    """D15 multi-class: mean over classes of one-vs-rest AUC (classes without both sides -> fallback 0.0)."""
    by = list(by or [])
    long = df.select(*by, F.posexplode(probs).alias("__k", "__p"), F.col(truth_idx).alias("__t")) \
             .withColumn("__y", (F.col("__k") == F.col("__t")).cast("int"))
    per = auc(long, "__p", "__y", by + ["__k"], undefined=0.0)
    return per.groupBy(*by).agg((F.sum("roc_auc") / F.lit(n_classes)).alias("roc_auc_ovr_macro"))


def exploited_top_tier_recall(df: DataFrame, exploited: str, tier_col: str,
                              top_tiers=("CRITICAL_RISK", "HIGH_RISK")) -> DataFrame:
    """Share of exploited rows that land in the top tiers; 1.0 when none exploited."""
    e = F.col(exploited)
    return df.agg(F.count_if(e).alias("n_exploited"),
                  F.count_if(e & F.col(tier_col).isin(*top_tiers)).alias("n_exploited_top")) \
             .withColumn("exploited_top_recall",
                         F.when(F.col("n_exploited") > 0, F.col("n_exploited_top") / F.col("n_exploited"))
                         .otherwise(F.lit(1.0)))


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Balanced weight n / (k * n_c) as a row column (class counts joined back)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__nc"))
    tot = counts.agg(F.sum("__nc").alias("__n"), F.count(F.lit(1)).alias("__k"))
    w = attach(counts, tot).select(label, (F.col("__n") / (F.col("__k") * F.col("__nc"))).alias(out))
    return df.join(w, label, "left")


def majority_class(df: DataFrame, label: str) -> DataFrame:
    """Most frequent label; ties -> smallest label."""
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")) \
             .orderBy(F.col("n").desc(), F.col(label)).limit(1)


def live_accuracy(cm: DataFrame, by: list[str] | None = None, min_matches: int = 5) -> DataFrame:
    """Status 'success' with metrics when >= min_matches matched rows, else 'awaiting_late_labels'."""
    s = summary(cm, by)
    return s.withColumn("status", F.when(F.col("n") >= min_matches, "success").otherwise("awaiting_late_labels"))


def realised_accuracy(cm: DataFrame, by: list[str] | None = None, min_rows: int = 20) -> DataFrame:
    """Macro F1 and critical recall of predictions paired with their ground truth by key
    (the pairing is the keyed join that built ``cm``, never list position). Groups with fewer
    than ``min_rows`` evaluated pairs have no result row (the monitor reports nothing)."""
    s = summary(cm, by)
    return s.where(F.col("n") >= min_rows).select(*(by or []), F.col("n").alias("evaluated_samples"),
                                                  "macro_f1", F.coalesce("critical_recall", F.lit(0.0))
                                                  .alias("critical_recall"))


def union_all(dfs: list[DataFrame]) -> DataFrame:
    """Per-model metric rows stacked into one comparison table."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
