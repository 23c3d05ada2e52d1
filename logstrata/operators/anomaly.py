"""Anomaly baselines and explainable scores over ordered log events.

All state of the scorer is tables: template counts, transition counts and window profiles in
long form. Ordered work (the previous event of a stream, positions within a service, trailing
windows) runs in blocks, as a service or a stream may hold any share of the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logstrata.functions.timestamps import let
from logstrata.operators.blocks import carry, exact_percentile
from logstrata.session import materialize

# Level groups, weights and thresholds of the scores.
ERROR_LEVELS = ["ERROR", "CRITICAL", "FATAL", "ALERT", "EMERG"]
WARN_LEVELS = ["WARN", "WARNING"]
NORMAL_LEVELS = ["INFO", "NOTICE", "DEBUG"]
BLOCK_MS = 3600 * 1000
#: Rows of one block among those without time.
BLOCK_LINES = 4096


@dataclass(frozen=True)
class AnomalyConfig:
    alpha: float = 0.5
    epsilon: float = 1e-6
    min_logs: int = 1000
    min_windows: int = 50
    size: int = 50
    step: int = 25
    template_weight: float = 0.40
    transition_weight: float = 0.35
    window_weight: float = 0.25
    fallback_transition_weight: float = 0.20
    fallback_window_weight: float = 0.40
    low: float = 0.40
    medium: float = 0.60
    high: float = 0.80


def _text(c: Column) -> Column:
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def first_text(df: DataFrame, *names: str) -> Column:
    """The first non-blank of the columns that exist."""
    there = [_text(F.col(n)) for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


STREAM_SCOPES = (
    ("trace", ("trace_id",)), ("request", ("request_id",)), ("session", ("session_id",)), ("block", ("block_id",)), ("instance", ("instance_id",)),
    ("entity", ("entity_id",)), ("host", ("host", "pod")), ("source", ("source_id",)),
)


def scoring_view(df: DataFrame, ts_ms: Column) -> DataFrame:
    """log_id, dataset, service, template, level, ts_ms, line_number, scope, stream of every event."""
    service = F.coalesce(first_text(df, "service", "component", "logger"), F.concat(F.coalesce(_text(F.col("dataset")), F.lit("unknown")), F.lit("-service")))
    template = F.coalesce(first_text(df, "template_id", "event_id", "template", "message", "raw_log"), F.lit("unknown-template"))
    scope, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, fields in STREAM_SCOPES:
        found = first_text(df, *fields)
        scope, value = F.coalesce(scope, F.when(found.isNotNull(), name)), F.coalesce(value, found)
    return df.select(
        "log_id", "dataset", service.alias("service"), template.alias("template"), F.coalesce(F.upper(_text(F.col("level"))), F.lit("UNKNOWN")).alias("level"),
        F.coalesce(ts_ms, F.lit(0)).alias("ts_ms"), F.coalesce("line_number", F.lit(0)).alias("line_number"), F.coalesce(scope, F.lit("service")).alias("scope"),
        F.concat_ws(":", F.coalesce(scope, F.lit("service")), F.coalesce(value, service)).alias("stream"),
    )


ORDER = ["ts_ms", "line_number", "log_id"]


def _block() -> Column:
    """Blocks in order of time; rows without time, which all come first, are cut by their lines."""
    timeless = F.when(F.col("ts_ms") == 0, F.least(F.floor(F.col("line_number") / BLOCK_LINES), F.lit((1 << 20) - 1))).otherwise(0)
    return F.floor(F.col("ts_ms") / BLOCK_MS) * (1 << 20) + timeless


def with_previous(view: DataFrame) -> DataFrame:
    """Adds prev, the template before in the same stream."""
    item = F.struct(*ORDER, "template")
    blocked = carry(view.withColumn("block", _block()), ["stream"], "block", {"last": F.max(item)}, {"before": ("last", "last")})
    inside = Window.partitionBy("stream", "block").orderBy(*ORDER)
    return blocked.withColumn("prev", F.coalesce(F.lag("template").over(inside), "before.template")).drop("block", "before")


def with_position(view: DataFrame) -> DataFrame:
    """Adds pos, the event's number in its service from 0, and n, the service's size."""
    blocked = carry(view.withColumn("block", _block()), ["service"], "block", {"n": F.count("*")}, {"n_before": ("sum", "n"), "n": ("total", "n")})
    inside = Window.partitionBy("service", "block").orderBy(*ORDER)
    return blocked.withColumn("pos", F.col("n_before") + F.row_number().over(inside) - 1).drop("block", "n_before")


def template_counts(view: DataFrame) -> DataFrame:
    return view.groupBy("service", "template").agg(F.count("*").alias("n"))


def transition_counts(view: DataFrame) -> DataFrame:
    """Ordered by stream, grouped by the service of the later event."""
    return with_previous(view).filter("prev IS NOT NULL").groupBy("service", "prev", F.col("template").alias("cur")).agg(F.count("*").alias("n"))


def surprise_p99(counts: DataFrame, group: list[str], vocabulary: DataFrame, config: AnomalyConfig) -> DataFrame:
    """The 99th percentile of -ln of the smoothed probabilities per service."""
    totals = counts.groupBy(*group).agg(F.sum("n").alias("total"))
    joined = counts.join(totals, group).join(vocabulary, "service")
    p = (F.col("n") + config.alpha) / (F.col("total") + config.alpha * F.col("v"))
    p99 = exact_percentile(joined.select("service", (-F.ln(p)).alias("surprise")), ["service"], "surprise", 0.99, "p99")
    return p99.withColumn("p99", F.round("p99", 6))


def vocabulary(counts: DataFrame) -> DataFrame:
    return counts.groupBy("service").agg(F.count("*").alias("v"), F.sum("n").alias("service_total"))


def window_vectors(view: DataFrame, config: AnomalyConfig) -> DataFrame:
    """Sliding training windows in long form: service, w, template, ratio and the window's own ratios."""
    placed = with_position(view)
    lo = F.greatest(F.lit(0), F.ceil((F.col("pos") - config.size + 1) / config.step))
    hi = F.floor(F.least(F.col("pos"), F.col("n") - config.size) / config.step)
    lo, hi = lo.cast("bigint"), hi.cast("bigint")
    rows = placed.filter(F.col("n") >= config.size).withColumn("w", F.explode(F.when(lo <= hi, F.sequence(lo, hi))))
    per = rows.groupBy("service", "w", "template").agg(F.count("*").alias("c"), F.count_if(F.col("level").isin(ERROR_LEVELS)).alias("e"), F.count_if(F.col("level").isin(WARN_LEVELS)).alias("wn"))
    whole = per.groupBy("service", "w").agg((F.sum("e") / config.size).alias("error_ratio"), (F.sum("wn") / config.size).alias("warn_ratio"), (F.count("*") / config.size).alias("unique_ratio"))
    return per.select("service", "w", "template", (F.col("c") / config.size).alias("ratio")).join(whole, ["service", "w"])


def window_profile(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per service and template: mean; per service: means, window_count, p99 of the distances)."""
    vectors = materialize(vectors, "vectors")
    windows = vectors.select("service", "w", "error_ratio", "warn_ratio", "unique_ratio").distinct()
    base = windows.groupBy("service").agg(F.count("*").alias("window_count"), *[F.avg(c).alias(f"{c}_mean") for c in ("error_ratio", "warn_ratio", "unique_ratio")])
    means = vectors.groupBy("service", "template").agg(F.sum("ratio").alias("s")).join(base.select("service", "window_count"), "service")
    means = means.select("service", "template", (F.col("s") / F.col("window_count")).alias("mean"))
    sums = means.groupBy("service").agg(F.sum("mean").alias("mean_sum"))
    near = vectors.join(means, ["service", "template"]).groupBy("service", "w").agg(F.sum(F.abs(F.col("ratio") - F.col("mean")) - F.col("mean")).alias("d"))
    far = near.join(windows, ["service", "w"]).join(base, "service").join(sums, "service")
    distance = F.col("d") + F.col("mean_sum") + sum(F.abs(F.col(c) - F.col(f"{c}_mean")) for c in ("error_ratio", "warn_ratio", "unique_ratio"))
    p99 = exact_percentile(far.select("service", distance.alias("distance")), ["service"], "distance", 0.99, "p99_distance")
    return means, base.join(p99, "service").join(sums, "service")


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _relative(p: Column, p_max: Column, config: AnomalyConfig) -> Column:
    return _clamp((p_max - p) / F.greatest(p_max, F.lit(config.epsilon)))


def score_templates(view: DataFrame, counts: DataFrame, config: AnomalyConfig) -> DataFrame:
    """Adds template_score, template_reason, v and service_total."""
    vocab = vocabulary(counts)
    top = counts.groupBy("service").agg(F.max("n").alias("n_max"))
    known = counts.select("service", "template", F.col("n").alias("template_n"))
    joined = view.join(known, ["service", "template"], "left").join(vocab.join(top, "service"), "service", "left")
    seen = F.coalesce("template_n", F.lit(0))
    v = F.coalesce("v", F.lit(0))
    total = F.coalesce("service_total", F.lit(0))
    p = (seen + config.alpha) / (total + config.alpha * (v + (seen == 0).cast("int")))
    p_max = F.coalesce((F.col("n_max") + config.alpha) / (total + config.alpha * v), p)
    score = _relative(p, p_max, config)
    reason = F.when(seen == 0, "new_template_for_service").when(score >= 0.8, "rare_template_for_service")
    return joined.withColumns({"template_score": score, "template_reason": reason, "v": v, "service_total": total}).drop("n_max")


def score_transitions(view: DataFrame, transitions: DataFrame, config: AnomalyConfig) -> DataFrame:
    """Adds transition_score and transition_reasons to events with prev, v and template_n."""
    totals = transitions.groupBy("service", "prev").agg(F.sum("n").alias("prev_total"), F.max("n").alias("next_max"))
    pairs = transitions.select("service", "prev", F.col("cur").alias("template"), F.col("n").alias("pair_n"))
    joined = view.join(totals, ["service", "prev"], "left").join(pairs, ["service", "prev", "template"], "left")
    seen = F.coalesce("pair_n", F.lit(0))
    v = F.col("v") + F.col("template_n").isNull().cast("int")
    p = (seen + config.alpha) / (F.col("prev_total") + config.alpha * v)
    p_max = (F.col("next_max") + config.alpha) / (F.col("prev_total") + config.alpha * F.col("v"))
    fallback = F.col("scope") == "service"
    score = F.when(F.col("prev").isNull(), 0.0).when(F.col("prev_total").isNull(), 1.0).otherwise(_relative(p, p_max, config))
    fall = F.when(fallback, "service_level_transition_fallback")
    # an apache line that no request, trace or session ties to the one before
    loose = F.coalesce(F.lower("dataset") == "apache", F.lit(False)) & ~F.col("scope").isin("trace", "request", "session")
    known = F.array_compact(F.array(F.when(seen == 0, "new_template_transition").when(score >= 0.8, "rare_template_transition"), F.coalesce(fall, F.when(loose, "low_confidence_sequence_fallback"))))
    unknown = F.array(F.lit("new_previous_template_for_transition"), F.lit("new_template_transition"))
    reasons = F.when(F.col("prev").isNull(), F.array_compact(F.array(fall))).when(F.col("prev_total").isNull(), unknown).otherwise(known)
    return joined.withColumns({"transition_score": score, "transition_reasons": reasons})


def trailing_windows(view: DataFrame, size: int, block_rows: int = 5000) -> DataFrame:
    """Adds templates (hashed and with their means, where `view` has these) and levels of the last `size` events of the service, the event included.

    Blocks of positions carry the end of the block before them along, so windows stay in one
    task without any service having to.
    """
    placed = with_position(view)
    own = F.floor(F.col("pos") / block_rows)
    halo = F.floor((F.col("pos") + size - 1) / block_rows)
    copies = placed.withColumn("own", own).withColumn("block", F.explode(F.when(own == halo, F.array(own)).otherwise(F.array(own, halo))))
    frame = Window.partitionBy("service", "block").orderBy("pos").rowsBetween(-(size - 1), 0)
    seen = copies.withColumns({"win_templates": F.collect_list(F.struct(F.xxhash64("template").alias("template"), "mean") if "mean" in view.columns else F.col("template")).over(frame), "win_levels": F.collect_list("level").over(frame)})
    return seen.filter(F.col("own") == F.col("block")).drop("own", "block")


def score_windows(view: DataFrame, means: DataFrame, profile: DataFrame, config: AnomalyConfig) -> DataFrame:
    """Adds window_score and window_reasons."""
    # every event brings its own template's mean along: no task holds the vocabulary of a service
    joined = trailing_windows(view.join(means, ["service", "template"], "left"), config.size).join(profile, "service", "left")
    n = F.lit(float(config.size))
    def gap_sum(ids: Column) -> Column:
        """Sum of |ratio - mean| - mean over the templates of a window; array_remove counts in one compiled loop."""
        ratio = lambda t: (F.size(ids) - F.size(F.array_remove(ids, t["template"]))) / n
        return F.aggregate(F.array_distinct("win_templates"), F.lit(0.0), lambda a, t: a + F.coalesce(F.abs(ratio(t) - t["mean"]) - t["mean"], F.lit(0.0)))

    share = lambda levels: F.size(F.filter("win_levels", lambda x: x.isin(levels))) / n
    # each of these once per row: later expressions name them several times
    joined = joined.withColumns({
        "w_gaps": let(F.col("win_templates.template"), gap_sum), "w_error": share(ERROR_LEVELS), "w_warn": share(WARN_LEVELS), "w_unique": F.size(F.array_distinct("win_templates.template")) / n,
    })
    error, warn = F.col("w_error"), F.col("w_warn")
    distance = F.col("w_gaps") + F.col("mean_sum") + F.abs(error - F.col("error_ratio_mean")) + F.abs(warn - F.col("warn_ratio_mean")) + F.abs(F.col("w_unique") - F.col("unique_ratio_mean"))
    score = _clamp(distance / F.greatest("p99_distance", F.lit(config.epsilon)))
    ready = F.coalesce(F.col("window_count") >= config.min_windows, F.lit(False))
    full = F.size("win_templates") == config.size
    reasons = F.array_compact(F.array(
        F.when(score >= 0.7, "window_template_distribution_shift"), F.when(error > F.greatest(F.col("error_ratio_mean") * 2, F.lit(0.1)), "window_error_ratio_spike"),
        F.when(warn > F.greatest(F.col("warn_ratio_mean") * 2, F.lit(0.1)), "window_warn_ratio_spike"),
    ))
    return joined.withColumns({
        "window_score": F.when(ready & full, score).otherwise(0.0),
        "window_reasons": F.when(~ready, F.array(F.lit("insufficient_window_history"))).when(~full, F.array(F.lit("window_not_full"))).otherwise(reasons),
    }).drop("win_templates", "win_levels", "mean", "w_gaps", "w_error", "w_warn", "w_unique")


@dataclass(frozen=True)
class Baseline:
    """What was learned, as tables in long form."""

    templates: DataFrame
    transitions: DataFrame
    means: DataFrame
    profile: DataFrame
    config: AnomalyConfig


def train(training: DataFrame, config: AnomalyConfig) -> Baseline:
    means, profile = window_profile(window_vectors(training, config))
    # counts are read by several joins of the scorer
    return Baseline(materialize(template_counts(training), "templates"), materialize(transition_counts(training), "transitions"), means, materialize(profile, "profile"), config)


def score(view: DataFrame, training: DataFrame | Baseline, config: AnomalyConfig | None = None) -> DataFrame:
    """Scores, level, decision and reasons of every event of `view` against a baseline or what is trained from events."""
    base = training if isinstance(training, Baseline) else train(training, config or AnomalyConfig())
    config = base.config
    scored = score_templates(with_previous(view), base.templates, config)
    scored = score_transitions(scored, base.transitions, config)
    scored = score_windows(scored, base.means, base.profile, config)
    fallback = F.col("scope") == "service"
    wt = F.when(fallback, config.fallback_transition_weight).otherwise(config.transition_weight)
    ww = F.when(fallback, config.fallback_window_weight).otherwise(config.window_weight)
    total = config.template_weight + wt + ww
    final = _clamp((config.template_weight * F.col("template_score") + wt * F.col("transition_score") + ww * F.col("window_score")) / total)
    warming = F.col("service_total") < config.min_logs
    severity = F.when(F.col("level").isin(ERROR_LEVELS), "error_severity_hint").when(F.col("level").isin(WARN_LEVELS), "warn_severity_hint")
    reasons = F.array_distinct(F.concat(
        F.array_compact(F.array("template_reason")), "transition_reasons", "window_reasons",
        F.array_compact(F.array(severity, F.when(warming, "insufficient_service_history"))),
    ))
    return scored.select(
        "log_id", "dataset", "service", "template", "scope",
        *[F.round(c, 6).alias(c) for c in ("template_score", "transition_score", "window_score")],
        F.when(~warming, F.round(final, 6)).alias("final_score"),
        F.when(warming, "unknown").when(final >= config.high, "high").when(final >= config.medium, "medium").when(final >= config.low, "low").otherwise("normal").alias("anomaly_level"),
        F.when(warming, "warming_up").when(final >= config.high, "anomalous").when(final >= config.low, "watch").otherwise("normal").alias("decision"),
        F.when(warming, "insufficient_history").otherwise("ready").alias("baseline_status"),
        reasons.alias("reasons"),
    )
