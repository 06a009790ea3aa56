"""Join operators.

Every function is ``DataFrame -> DataFrame``. Nothing is collected except a
single row count used to choose a broadcast, which is always checked against a
bound first; beyond the bound an exact shuffle-based plan is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K

# Largest distinct-pattern count shipped to every executor in a substring join.
MAX_BROADCAST_PATTERNS = 20_000
# Up to this many patterns a nested-loop scan is cheaper than gram blocking.
NLJ_MAX_PATTERNS = 64
# Grams used to block the substring join.
GRAM = 4


def flag_membership(df: DataFrame, ids: DataFrame, key: str = "cve_id", ids_key: str | None = None,
                    out: str = "in_kev") -> DataFrame:
    """Boolean column, true when ``key`` appears in ``ids`` (left join on distinct ids).

    The id side is de-duplicated first (partial aggregation), so a repeated id
    never multiplies rows; AQE turns the join into a broadcast when the
    distinct side is small at run time.
    """
    ids_key = ids_key or key
    d = ids.select(F.col(ids_key).alias("__k")).distinct().withColumn("__hit", F.lit(True))
    j = df.join(d, df[key] == d["__k"], "left")
    return j.withColumn(out, F.coalesce(F.col("__hit"), F.lit(False))).drop("__k", "__hit")


def lookup_with_default(df: DataFrame, table: DataFrame, key: str, value: str, default: float,
                        out: str | None = None) -> DataFrame:
    """Left join a (key, value) map, default when absent. ``table`` must be unique on key."""
    out = out or value
    t = table.select(F.col(key).alias("__k"), F.col(value).alias("__v"))
    j = df.join(t, df[key] == t["__k"], "left")
    return j.withColumn(out, F.coalesce(F.col("__v"), F.lit(default))).drop("__k", "__v")


def latest_value(history: DataFrame, key: str = "cve_id", order: str = "snapshot_date",
                 value: str = "score", out: str = "latest_score") -> DataFrame:
    """C4 (latest): value at the greatest ``order`` per key; one row per key.

    ``max_by`` is a partial aggregate: a hot key is combined map-side, so no
    task ever sees all of one key's rows.
    """
    return history.groupBy(key).agg(F.max_by(value, order).alias(out), F.max(order).alias(f"{out}_date"))


def asof_join(left: DataFrame, history: DataFrame, key: str, left_time: str, hist_time: str,
              value: str, out: str, bucket_days: int = 32, strict: bool = False) -> DataFrame:
    """C4 (as-of): for each left row, ``value`` of the latest history row with hist_time <= left_time.

    Skew-safe two-level plan (no window over a whole key):
      1. union left markers with history, bucket time into ``bucket_days`` spans;
      2. running last-non-null inside (key, bucket);
      3. per (key, bucket) last history value -> tiny table, carried forward
         across buckets with a window over bucket summaries only;
      4. rows with no history earlier in their bucket take the carried value.
    Times are instants (a date is its midnight), so two rows of one day keep their order.
    Ties: history at the same instant as the left row counts (<=), unless ``strict`` (<).
    """
    payload = F.struct(*[F.col(c) for c in left.columns])
    q = left.select(F.col(key).alias("__k"), F.col(left_time).cast("timestamp").alias("__t"),
                    F.lit(1).alias("__q"), F.lit(None).cast("double").alias("__v"), payload.alias("__row"))
    h = history.select(F.col(key).alias("__k"), F.col(hist_time).cast("timestamp").alias("__t"),
                       F.lit(0).alias("__q"), F.col(value).cast("double").alias("__v"),
                       F.lit(None).cast(q.schema["__row"].dataType).alias("__row"))
    u = q.unionByName(h).withColumn(
        "__b", F.floor(F.unix_date(F.to_date("__t")) / F.lit(bucket_days)).cast("long"))
    # at equal instants history sorts before the left row (<=) or after it (strict <)
    tie = F.col("__q").desc() if strict else F.col("__q").asc()
    w_in = (Window.partitionBy("__k", "__b").orderBy("__t", tie)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ran = u.withColumn("__run", F.last("__v", ignorenulls=True).over(w_in))
    hist_t = F.when(F.col("__q") == 0, F.col("__t"))
    summ = u.groupBy("__k", "__b").agg(F.max_by(F.when(F.col("__q") == 0, F.col("__v")), hist_t).alias("__last"))
    w_b = Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = summ.select("__k", "__b", F.last("__last", ignorenulls=True).over(w_b).alias("__carry"))
    return (ran.where(F.col("__q") == 1).join(carry, ["__k", "__b"], "left")
            .select("__row.*", F.coalesce("__run", "__carry").alias(out)))


def substring_join(texts: DataFrame, text_cols: list[str], patterns: DataFrame, pattern_col: str,
                   text_key: str, array_cols: tuple[str, ...] = (),
                   max_broadcast: int = MAX_BROADCAST_PATTERNS, nlj_max: int = NLJ_MAX_PATTERNS) -> DataFrame:
    """C1 core: distinct (text_key, pattern) where lower(pattern) occurs in any text column.

    Patterns are de-duplicated and counted (one number to the driver), then:
      * up to ``nlj_max`` patterns: broadcast nested loop, each text scanned once per pattern;
      * up to ``max_broadcast``: exact gram blocking with the pattern table broadcast -- every
        pattern of length >= GRAM is keyed by its first GRAM characters, each text emits its
        distinct GRAM-grams (one native lookahead regex, no lambda), the gram hash join is done
        map-side and candidates are verified with ``instr``;
      * beyond: the same gram join shuffled on the gram (AQE splits hot grams).
    Patterns shorter than GRAM (a bounded set) always take the nested-loop way.
    """
    pats = patterns.select(F.lower(F.col(pattern_col).cast("string")).alias("__p")).where(
        F.col("__p").isNotNull()).distinct()
    cols = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in text_cols]
    for a in array_cols:
        cols.append(F.lower(F.coalesce(F.array_join(F.col(a), "\u0000"), F.lit(""))))
    # Array items are joined with NUL so a pattern never spans two items.
    t = texts.select(F.col(text_key).alias("__key"), F.array(*cols).alias("__texts"))
    hit = F.exists("__texts", lambda x: F.instr(x, F.col("__p")) > 0)
    n = pats.count()
    if n <= nlj_max:
        return t.join(F.broadcast(pats), hit).select("__key", "__p").distinct()
    short = pats.where(F.length("__p") < GRAM)
    long_ = pats.where(F.length("__p") >= GRAM).withColumn("__g", F.substring("__p", 1, GRAM))
    joined = F.array_join("__texts", "\u0001")
    grams = t.select("__key", F.explode(F.array_distinct(F.regexp_extract_all(
        joined, F.lit(f"(?s)(?=([^\u0001]{{{GRAM}}}))"), 1))).alias("__g"))
    side = F.broadcast(long_) if n <= max_broadcast else long_
    # gram rows carry the key alone; texts come back for the candidates only
    # a scan's size says nothing of its grams: neither they nor the texts are ever shipped whole
    grams = grams.hint("shuffle_merge") if n > max_broadcast else grams
    found = grams.join(side, "__g").select(F.col("__key").alias("__found"), "__p").distinct()
    via_gram = found.join(t.hint("shuffle_merge"), F.col("__found").eqNullSafe(F.col("__key"))).where(hit).select("__key", "__p")
    via_short = t.join(F.broadcast(short), hit).select("__key", "__p")
    return via_gram.unionByName(via_short).distinct()


def match_assets(cves: DataFrame, assets: DataFrame, product_col: str = "product",
                 asset_key: str = "asset_id", cve_key: str = "cve_id",
                 text_cols=("product", "description"), cpe_col: str | None = "cpe_list",
                 max_broadcast: int = MAX_BROADCAST_PATTERNS, nlj_max: int = NLJ_MAX_PATTERNS) -> DataFrame:
    """Distinct (asset_id, cve_id) where the asset product occurs in a CPE, the CVE product
    or the description (lower-cased substring; version ignored).

    Matching runs on distinct products, then an equi-join maps products back to assets.
    """
    tcols = [c for c in text_cols if c in cves.columns]
    acols = (cpe_col,) if cpe_col and cpe_col in cves.columns else ()
    pairs = substring_join(cves, tcols, assets, product_col, cve_key, acols, max_broadcast, nlj_max)
    a = assets.select(F.col(asset_key), F.lower(F.col(product_col).cast("string")).alias("__p"))
    return (pairs.join(a, "__p").select(F.col(asset_key), F.col("__key").alias(cve_key)).distinct())


def exploitation_label(cves: DataFrame, catalog: DataFrame, window_days: int = 90,
                       mode: str = "window", key: str = "cve_id", published: str = "published_date",
                       added: str = "added_date") -> DataFrame:
    """Interval join of publication to catalog listing.

    Adds ``days_to_kev_listing`` (fractional days added - published, earliest
    listing) and ``kev_label``: mode "window" -> 1 iff listed and lag <=
    window_days (negative lag = already exploited -> 1; listed without a
    publication date -> 1); mode "any_listing" -> 1 iff listed.
    """
    first = catalog.groupBy(F.col(key).alias("__k")).agg(F.min(added).alias("__added"))
    j = cves.join(first, cves[key] == first["__k"], "left").drop("__k")
    lag = ((F.unix_micros(F.col("__added").cast("timestamp")) -
            F.unix_micros(F.col(published).cast("timestamp"))) / F.lit(86_400_000_000.0))
    listed = F.col("__added").isNotNull()
    if mode == "any_listing":
        lab = listed.cast("int")
    else:
        lab = F.when(~listed, 0).when(F.col(published).isNull(), 1) \
               .when(lag <= window_days, 1).otherwise(0)
    return j.withColumn("days_to_kev_listing", lag).withColumn("kev_label", lab.cast("int")) \
            .withColumnRenamed("__added", "kev_added_date")


def late_label_join(preds: DataFrame, truth: DataFrame, key: str = "cve_id",
                    pred_col: str = "prediction", truth_col: str = "base_severity",
                    truth_order: str | None = None, latest_only: bool = False,
                    pred_order: str = "predicted_at") -> DataFrame:
    """Predictions joined to late ground truth.

    Truth is upper-cased and restricted to the four labels; the last truth per
    id wins (by ``truth_order``, else the greatest label value as a
    deterministic tie-break). Every prediction row of an id counts unless
    ``latest_only``. Unmatched or invalid predictions are dropped.
    """
    labs = list(K.LABELS_ORDER)
    t = truth.select(F.col(key).alias("__k"), F.upper(F.col(truth_col)).alias("__t"),
                     *( [F.col(truth_order).alias("__o")] if truth_order else [] ))
    t = t.where(F.col("__t").isin(*labs))
    if truth_order:
        t = t.groupBy("__k").agg(F.max_by("__t", "__o").alias("truth"))
    else:
        t = t.groupBy("__k").agg(F.max("__t").alias("truth"))
    p = preds.withColumn("__pred", F.upper(F.col(pred_col))).where(F.col("__pred").isin(*labs))
    if latest_only:
        p = p.groupBy(key).agg(F.max_by(F.struct(*[c for c in p.columns if c != key]), pred_order).alias("__s")) \
             .select(key, "__s.*")
    j = p.join(t, p[key] == t["__k"], "inner").drop("__k")
    return j.withColumn("predicted", F.col("__pred")).drop("__pred")


def batch_risk_inputs(ids: DataFrame, predictions: DataFrame | None = None, scores: DataFrame | None = None,
                      exploited: DataFrame | None = None, assets: DataFrame | None = None,
                      exposure: DataFrame | None = None, key: str = "cve_id") -> DataFrame:
    """Keyed (never positional) chain of left joins with the batch defaults:
    class label MEDIUM (class 2 on the 0-4 scale), confidence 0.5, score 0.0,
    asset 0.5, exposure 0.5."""
    df = ids
    if predictions is not None:
        df = df.join(predictions.select(key, "predicted_label", "confidence"), key, "left")
    else:
        df = df.withColumn("predicted_label", F.lit(None).cast("string")).withColumn(
            "confidence", F.lit(None).cast("double"))
    df = df.withColumn("predicted_label", F.coalesce("predicted_label", F.lit("MEDIUM"))) \
           .withColumn("confidence", F.coalesce(F.col("confidence").cast("double"), F.lit(0.5)))
    if scores is not None:
        df = lookup_with_default(df, scores, key, "epss_score", 0.0)
    else:
        df = df.withColumn("epss_score", F.lit(0.0))
    if exploited is not None:
        df = flag_membership(df, exploited, key, out="in_kev")
    else:
        df = df.withColumn("in_kev", F.lit(False))
    for name, t in (("asset_criticality", assets), ("exposure_score", exposure)):
        df = lookup_with_default(df, t, key, name, 0.5) if t is not None else df.withColumn(name, F.lit(0.5))
    return df


def disagreement(log: DataFrame, key: str, version_col: str, pred_col: str,
                 champion: str, challenger: str, order: tuple[str, ...] = ("predicted_at",)) -> DataFrame:
    """Per id, champion vs challenger prediction (last row by ``order`` per (id, version)) side by side."""
    def side(v, name):
        return (log.where(F.col(version_col) == v).groupBy(key)
                .agg(F.max_by(F.col(pred_col), F.struct(*order)).alias(name)))
    a = side(champion, "champion_prediction")
    b = side(challenger, "challenger_prediction")
    return a.join(b, key, "inner").withColumn(
        "disagree", F.col("champion_prediction") != F.col("challenger_prediction"))


def apply_feedback(labels: DataFrame, feedback: DataFrame, key: str = "cve_id",
                   label_col: str = "severity_label") -> DataFrame:
    """Latest analyst correction per id overrides the label."""
    fb = feedback.groupBy(F.col(key).alias("__k")).agg(
        F.max_by(F.upper(F.col("corrected_severity")), "submitted_at").alias("__c"))
    j = labels.join(fb, labels[key] == fb["__k"], "left").drop("__k")
    return j.withColumn(label_col, F.coalesce(F.col("__c"), F.col(label_col))).drop("__c")


def remediation_list(asset_map: DataFrame, risk: DataFrame, k: int = 10, asset_key: str = "asset_id",
                     key: str = "cve_id", score: str = "risk_score", tie: str | None = None) -> DataFrame:
    """Asset -> CVE map joined with risk, ranked per asset, top k per asset
    (ties by ``tie``, else by the join key)."""
    j = asset_map.join(risk, key, "inner")
    w = Window.partitionBy(asset_key).orderBy(F.col(score).desc(), F.col(tie or key))
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
