"""Telemetry alerts: severity, persistence, severity changes and policy comparison.

Samples are rows (entity_id, scenario, sequence_count, sample_ordinal,
source_event_time, subsystem, measurement_name, measurement_value). The order of
an entity's samples is (sequence_count, sample_ordinal).

A series is what one entity reports in one scenario: scenarios never mix.

Shuffle design. Samples move once, by series and segment, *before* they fan out
over policies; every later window key contains those columns, so no window moves
them again. A segment is the whole series for ordinary series. A series with more
than ``segment_rows`` samples is cut at quantiles of the sample order, each part a
task of its own, and what the state machine carries across a cut (two counters and
the last severity) is computed on one summary row per segment and joined back.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from perigee import fixed_values as fixed
from perigee.functions import labels, parsing
from perigee.operators.joins import at_most, hinted
from perigee.schemas import POLICY
from perigee.sources.tables import conform

SEGMENT_ROWS = 2_000_000
CUT_SAMPLES = 50
ENTITY = ["entity_id", "scenario"]
THRESHOLD_COLUMNS = [
    "policy", "measurement_name", "direction", "warning", "critical", "required_persistence",
]
SAMPLE_COLUMNS = [
    "entity_id", "scenario", "sequence_count", "sample_ordinal", "source_event_time",
    "subsystem", "measurement_name", "measurement_value",
]


def default_policies(spark: SparkSession) -> DataFrame:
    """The three standing policies, one row per policy and metric."""
    return policy_table(spark, [(*row, *fixed.POLICY_GUIDANCE[row[0]]) for row in fixed.POLICY_THRESHOLDS])


def policy_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Policy rows as a local relation (through Arrow: no Python workers, known size)."""
    columns = zip(*rows, strict=True)
    data = pa.table(dict(zip(POLICY.fieldNames(), map(list, columns), strict=True)))
    return conform(spark.createDataFrame(data), POLICY)


def with_status(samples: DataFrame, policies: DataFrame, policy: str = fixed.STATUS_POLICY) -> DataFrame:
    """Round each value to three decimals; label it under one policy from the
    unrounded value. Metrics the policy does not watch are ``info``."""
    watched = policies.where(F.col("policy") == policy).select(
        "measurement_name", "direction", "warning", "critical"
    )
    joined = samples.join(hinted(watched), ["measurement_name"], "left")
    status = labels.severity(
        F.col("measurement_value"), F.col("direction"), F.col("warning"), F.col("critical")
    )
    return joined.withColumns(
        {"status": status, "measurement_value": F.round("measurement_value", 3)}
    ).drop("direction", "warning", "critical")


def latest_per_subsystem(samples: DataFrame) -> DataFrame:
    """The last sample of every entity, scenario and subsystem. One row per map task
    and group survives to the shuffle."""
    keys = [c for c in (*ENTITY, "subsystem") if c in samples.columns]
    last = Window.partitionBy(*keys).orderBy(
        F.col("sequence_count").desc(), F.col("sample_ordinal").desc()
    )
    return samples.withColumn("_rank", F.row_number().over(last)).where(F.col("_rank") == 1).drop("_rank")


def cuts(samples: DataFrame, segment_rows: int) -> DataFrame:
    """Series above ``segment_rows`` samples with the places where they are cut.

    Counts are combined before the shuffle; at most rows / segment_rows series remain.
    About ``CUT_SAMPLES`` places a segment, chosen by hash, stand for the order of a
    series' samples; every ``CUT_SAMPLES``-th of them is a cut. Samples themselves are
    all kept: the choice only decides where a segment ends.
    """
    place = F.struct("sequence_count", "sample_ordinal")
    every = max(1, segment_rows // CUT_SAMPLES)
    chosen = F.pmod(F.xxhash64("sequence_count", "sample_ordinal"), F.lit(every)) == 0
    sizes = samples.groupBy(*ENTITY).agg(
        F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_set(F.when(chosen, place))).alias("_places")
    )
    step = max(1, segment_rows // every)
    kept = F.filter("_places", lambda _, k: k % step == step - 1)
    return sizes.where(F.col("_n") > segment_rows).select(*ENTITY, kept.alias("_cuts"))


# what a series carries from one slice of telemetry to the next, per policy and metric: the
# counters and the last qualified severity since its last info sample, and the place of its
# last sample; with no metric, how many events the series has had under the policy
STATE = T.StructType(
    [
        T.StructField("entity_id", T.LongType()),
        T.StructField("scenario", T.StringType()),
        T.StructField("policy", T.StringType()),
        T.StructField("measurement_name", T.StringType()),
        T.StructField("n_warning", T.LongType()),
        T.StructField("n_critical", T.LongType()),
        T.StructField("severity", T.StringType()),
        T.StructField("last_sequence_count", T.LongType()),
        T.StructField("last_sample_ordinal", T.LongType()),
        T.StructField("events", T.LongType()),
    ]
)


def threshold_events(
    samples: DataFrame,
    policies: DataFrame,
    segment_rows: int = SEGMENT_ROWS,
    state: DataFrame | None = None,
    ends: DataFrame | None = None,
) -> DataFrame:
    """Alert events of every entity under every policy; after ``state``, if that is given,
    as if the samples behind it came before.

    A sample counts when its severity was reached ``required_persistence`` times
    since the metric's last ``info`` sample (not necessarily in a row), and an event
    is emitted when that severity differs from the one emitted before it in the
    same stretch. Measures entity sizes first (one narrow aggregation) to decide
    whether any series has to be cut. ``ends`` are the ``segment_ends`` of the same input,
    where they are stored already.
    """
    graded, long_series = _graded(samples, policies, segment_rows, state is not None)
    emitted = _severity_changes(graded, long_series, state, ends)
    return _describe(_number(emitted, long_series, state))


def segment_ends(
    samples: DataFrame, policies: DataFrame, state: DataFrame | None = None, segment_rows: int = SEGMENT_ROWS
) -> DataFrame:
    """What every series has behind each of its segments, under each policy and metric;
    few rows beside the samples, which the events and the state of a slice both read."""
    graded, _ = _graded(samples, policies, segment_rows, True)
    columns = ["out_warning", "out_critical", "out_severity", "out_last"]
    return _summaries(graded, state).select(*SERIES, "segment", *columns)


def alert_state(
    samples: DataFrame,
    policies: DataFrame,
    events: DataFrame,
    state: DataFrame | None = None,
    segment_rows: int = SEGMENT_ROWS,
    ends: DataFrame | None = None,
) -> DataFrame:
    """STATE behind the samples, of which ``events`` were the events; one row per series,
    policy and metric, and one per series and policy that had events. Series without new
    samples keep theirs. ``ends`` are as for ``threshold_events``."""
    ends = segment_ends(samples, policies, state, segment_rows) if ends is None else ends
    by_series = Window.partitionBy(*SERIES).orderBy(F.col("segment").desc())
    last = ends.withColumn("_rank", F.row_number().over(by_series)).where("_rank = 1")
    metrics = last.select(
        *SERIES,
        F.col("out_warning").alias("n_warning"),
        F.col("out_critical").alias("n_critical"),
        F.col("out_severity").alias("severity"),
        F.col("out_last.sequence_count").alias("last_sequence_count"),
        F.col("out_last.sample_ordinal").alias("last_sample_ordinal"),
    )
    counts = events.groupBy(*ENTITY, "policy").agg(F.count(F.lit(1)).alias("events"))
    if state is not None:
        earlier = state.where("measurement_name is null").select(*ENTITY, "policy", "events")
        counts = counts.unionByName(earlier).groupBy(*ENTITY, "policy").agg(F.sum("events").alias("events"))
    return conform(metrics.unionByName(counts, allowMissingColumns=True), STATE)


def late_samples(samples: DataFrame, state: DataFrame) -> DataFrame:
    """Samples that are not behind the last one of their series and metric that ``state`` knows."""
    last = state.where("measurement_name is not null").groupBy(*ENTITY, "measurement_name").agg(
        F.max(F.struct("last_sequence_count", "last_sample_ordinal")).alias("_last")
    )
    place = F.struct("sequence_count", "sample_ordinal")
    return _watched_form(samples).join(last, [*ENTITY, "measurement_name"]).where(place <= F.col("_last")).drop("_last")


def _watched_form(samples: DataFrame) -> DataFrame:
    samples = _with_scenario(samples).select(*SAMPLE_COLUMNS)
    return samples.withColumn("scenario", F.coalesce("scenario", F.lit(fixed.DEFAULT_SCENARIO)))


def _graded(samples: DataFrame, policies: DataFrame, segment_rows: int, segments: bool) -> tuple[DataFrame, bool]:
    """Watched samples with their severity under each policy, placed by series (and by
    segment, if a series has to be cut or ``segments`` asks for it); whether one has to be."""
    samples = _watched_form(samples)
    thresholds = hinted(policies.select(*THRESHOLD_COLUMNS))
    watched = samples.join(hinted(policies.select("measurement_name")), ["measurement_name"], "left_semi")
    sizes = watched.groupBy(*ENTITY).agg(F.count(F.lit(1)).alias("_n"))
    long_series = not at_most(sizes.where(F.col("_n") > segment_rows), 0)
    cut = long_series or segments
    if long_series:
        hot = cuts(watched, segment_rows)
        here = F.struct("sequence_count", "sample_ordinal")
        segment = F.size(F.filter("_cuts", lambda place: place <= here))
        watched = watched.join(hot, ENTITY, "left")
        watched = watched.withColumn("segment", F.when(F.col("_cuts").isNull(), 0).otherwise(segment)).drop("_cuts")
    else:
        watched = watched.withColumn("segment", F.lit(0))
    place = [*ENTITY, "segment"] if cut else ENTITY
    graded = watched.repartition(*place).join(thresholds, ["measurement_name"])
    label = labels.severity(
        F.round("measurement_value", 3), F.col("direction"), F.col("warning"), F.col("critical")
    )
    graded = (
        graded.withColumn("severity", label)
        .withColumn("measurement_value", F.round("measurement_value", 3))
        .withColumn("threshold", labels.threshold_hit(F.col("severity"), F.col("warning"), F.col("critical")))
        .drop("direction", "warning", "critical")
    )
    return graded, long_series


def _with_scenario(samples: DataFrame) -> DataFrame:
    if "scenario" in samples.columns:
        return samples
    return samples.withColumn("scenario", F.lit(fixed.DEFAULT_SCENARIO))


def _order() -> list[Column]:
    return [F.col("sequence_count"), F.col("sample_ordinal")]


SERIES = [*ENTITY, "policy", "measurement_name"]


def _stretches(graded: DataFrame, cut: bool) -> DataFrame:
    """Number the stretches between info samples; those samples only delimit."""
    by_series = Window.partitionBy(*([*SERIES, "segment"] if cut else SERIES)).orderBy(*_order())
    so_far = by_series.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return graded.withColumn("stretch", F.count_if(F.col("severity") == "info").over(so_far))


def _severity_changes(graded: DataFrame, long_series: bool, state: DataFrame | None, ends: DataFrame | None) -> DataFrame:
    cut = long_series or state is not None
    series = [*SERIES, "segment"] if cut else SERIES
    stretches = _stretches(graded, cut)
    alerting = stretches.where(F.col("severity") != "info")
    # counted in the order that the change of severity below needs too: one sort for both
    in_stretch = Window.partitionBy(*series, "stretch").orderBy(*_order())
    so_far = in_stretch.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = lambda level: F.count_if(F.col("severity") == level).over(so_far)
    reached = F.when(F.col("severity") == "warning", seen("warning")).otherwise(seen("critical"))
    before = F.lit(None).cast("string")
    if cut:
        if long_series:
            carry = _carry(_summaries(graded, state) if ends is None else ends)
        else:
            carry = _carried(state)
        alerting = _attach(
            alerting,
            carry,
            ["policy", "measurement_name"],
            ["carry_warning", "carry_critical", "carry_severity"],
        )
        continuing = F.col("stretch") == 0
        carried = F.when(F.col("severity") == "warning", F.col("carry_warning")).otherwise(
            F.col("carry_critical")
        )
        reached = reached + F.when(continuing, F.coalesce(carried, F.lit(0))).otherwise(F.lit(0))
        before = F.when(continuing, F.col("carry_severity"))
    kept = alerting.withColumn("_reached", reached).where(
        F.col("_reached") >= F.col("required_persistence")
    )
    previous = F.lag("severity").over(in_stretch)
    return (
        kept.withColumn("_before", F.coalesce(previous, before))
        .where(~F.col("_before").eqNullSafe(F.col("severity")))
        .drop("_before", "_reached", "stretch", "carry_warning", "carry_critical", "carry_severity")
    )


def _summaries(graded: DataFrame, state: DataFrame | None) -> DataFrame:
    """Counters and last qualified severity of the stretch that is open at the end of each
    segment. One row per series and segment; what ``state`` carries in is segment -1."""
    at = F.struct("sequence_count", "sample_ordinal")
    is_warning, is_critical = F.col("severity") == "warning", F.col("severity") == "critical"
    # the open stretch has no info sample behind it; it begins with one or with the segment
    backwards = Window.partitionBy(*SERIES, "segment").orderBy(*[place.desc() for place in _order()])
    is_info = F.col("severity") == "info"
    behind = F.count_if(is_info).over(backwards.rowsBetween(Window.unboundedPreceding, -1))
    open_stretch = graded.withColumn("_behind", behind).where("_behind = 0").groupBy(*SERIES, "segment").agg(
        F.count_if(is_warning).alias("n_warning"),
        F.count_if(is_critical).alias("n_critical"),
        F.max(F.when(is_warning, at)).alias("at_warning"),
        F.max(F.when(is_critical, at)).alias("at_critical"),
        F.max("required_persistence").alias("required"),
        F.count_if(is_info).alias("stretch"),
        F.max(at).alias("last"),
    )
    summary = open_stretch.withColumn("before", F.lit(None).cast("string"))
    if state is not None:
        carried = state.where("measurement_name is not null").select(
            *SERIES,
            F.lit(-1).alias("segment"),
            "n_warning",
            "n_critical",
            F.lit(0).cast("bigint").alias("stretch"),
            F.struct(F.col("last_sequence_count").alias("sequence_count"), F.col("last_sample_ordinal").alias("sample_ordinal")).alias("last"),
            F.col("severity").alias("before"),
        )
        summary = summary.unionByName(carried, allowMissingColumns=True)
    by_segment = Window.partitionBy(*SERIES).orderBy("segment")
    # consecutive segments without info share one open stretch
    summary = summary.withColumn(
        "run",
        F.count_if(F.col("stretch") > 0).over(
            by_segment.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ),
    )
    in_run = Window.partitionBy(*SERIES, "run").orderBy("segment").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    summary = summary.withColumns(
        {
            "out_warning": F.sum("n_warning").over(in_run),
            "out_critical": F.sum("n_critical").over(in_run),
        }
    )
    last_warning = F.when(F.col("out_warning") >= F.col("required"), F.col("at_warning"))
    last_critical = F.when(F.col("out_critical") >= F.col("required"), F.col("at_critical"))
    latest = (
        F.when(last_warning.isNull() & last_critical.isNull(), F.lit(None).cast("string"))
        .when(last_critical.isNull() | (last_warning > last_critical), "warning")
        .otherwise("critical")
    )
    summary = summary.withColumn("segment_severity", F.coalesce("before", latest))
    summary = summary.withColumns(
        {
            "out_severity": F.last("segment_severity", ignorenulls=True).over(in_run),
            "out_last": F.max("last").over(by_segment),
        }
    )
    return summary


def _carry(summary: DataFrame) -> DataFrame:
    """What each segment inherits from the one before it."""
    by_segment = Window.partitionBy(*SERIES).orderBy("segment")
    return summary.select(
        *SERIES,
        "segment",
        F.lag("out_warning").over(by_segment).alias("carry_warning"),
        F.lag("out_critical").over(by_segment).alias("carry_critical"),
        F.lag("out_severity").over(by_segment).alias("carry_severity"),
    ).where(F.col("carry_warning").isNotNull())


def _carried(state: DataFrame) -> DataFrame:
    """What series of one segment inherit: the state in front of it."""
    return state.where("measurement_name is not null").select(
        *SERIES,
        F.lit(0).alias("segment"),
        F.col("n_warning").alias("carry_warning"),
        F.col("n_critical").alias("carry_critical"),
        F.col("severity").alias("carry_severity"),
    )


def _attach(rows: DataFrame, summary: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Left-join per-segment values onto rows that are placed by series and segment.

    The summary is folded to one map per series and segment, its size bounded by the
    policy table, so that the join keys equal the placement of the rows and only the
    summary moves.
    """
    entry = F.struct(F.struct(*by), F.struct(*values))
    folded = summary.groupBy(*ENTITY, "segment").agg(
        F.map_from_entries(F.collect_list(entry)).alias("_folded")
    )
    joined = rows.join(folded.hint("shuffle_hash"), [*ENTITY, "segment"], "left")
    found = joined.withColumn("_found", F.try_element_at("_folded", F.struct(*by)))
    return found.withColumns({v: F.col(f"_found.{v}") for v in values}).drop("_folded", "_found")


def _number(events: DataFrame, long_series: bool, state: DataFrame | None) -> DataFrame:
    """Number a series' events under a policy in emission order over all metrics. Events
    are counted by segment only where a series has several; else the state has the count."""
    if not long_series and state is None:
        numbering = Window.partitionBy(*ENTITY, "policy").orderBy(*_order())
        return events.withColumn("event_no", F.row_number().over(numbering))
    local = F.row_number().over(Window.partitionBy(*ENTITY, "policy", "segment").orderBy(*_order()))
    earlier = (
        Window.partitionBy(*ENTITY, "policy")
        .orderBy("segment")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    had = None if state is None else state.where("measurement_name is null")
    if long_series:
        counts = events.groupBy(*ENTITY, "policy", "segment").agg(F.count(F.lit(1)).alias("n"))
        if had is not None:
            counts = counts.unionByName(had.select(*ENTITY, "policy", F.lit(-1).alias("segment"), F.col("events").alias("n")))
        offsets = counts.select(*ENTITY, "policy", "segment", F.sum("n").over(earlier).alias("earlier"))
    else:
        offsets = had.select(*ENTITY, "policy", F.lit(0).alias("segment"), F.col("events").alias("earlier"))
    numbered = _attach(events, offsets, ["policy"], ["earlier"])
    return numbered.withColumn("event_no", (local + F.coalesce("earlier", F.lit(0))).cast("int")).drop("earlier")


def _describe(events: DataFrame) -> DataFrame:
    checks = F.create_map(*[F.lit(t) for pair in fixed.SUBSYSTEM_CHECKS.items() for t in pair])
    advice = F.coalesce(F.try_element_at(checks, F.col("subsystem")), F.lit(fixed.OTHER_SUBSYSTEM_CHECK))
    urgency = F.when(F.col("severity") == "critical", "Immediate").otherwise("Focused")
    return events.select(
        "entity_id",
        "event_no",
        F.format_string(
            fixed.EVENT_ID_FORMAT, F.col("entity_id"), F.col("scenario"), F.col("policy"), F.col("event_no")
        ).alias("event_id"),
        F.col("source_event_time").alias("event_time"),
        "subsystem",
        "severity",
        "scenario",
        "policy",
        F.col("measurement_name").alias("triggered_by"),
        "measurement_value",
        "threshold",
        F.format_string(
            fixed.EVENT_SUMMARY_FORMAT,
            F.initcap("severity"),
            F.col("subsystem"),
            F.col("measurement_name"),
            parsing.number_text(F.col("measurement_value")),
        ).alias("summary"),
        F.concat(urgency, F.lit(" check: "), advice).alias("recommended_operator_check"),
        F.lit(True).alias("is_simulated"),
    )


def policy_facts(events: DataFrame) -> DataFrame:
    """Counts, first times and most affected subsystem per entity and policy.

    Two steps: per subsystem (combined before the shuffle), then over the few
    subsystem rows; ties in the count go to the subsystem that emitted first.
    """
    def first_time(level: str) -> Column:
        return F.min(F.when(F.col("severity") == level, F.struct("event_no", "event_time")))

    per_subsystem = events.groupBy("entity_id", "scenario", "policy", "subsystem").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.min(F.struct("event_no", "event_time", "subsystem")).alias("first"),
        first_time("warning").alias("first_warning"),
        first_time("critical").alias("first_critical"),
    )
    return (
        per_subsystem.groupBy("entity_id", "scenario", "policy")
        .agg(
            F.sum("n").alias("event_count"),
            F.sum("critical").alias("critical_count"),
            F.min("first").alias("first"),
            F.min("first_warning").alias("first_warning"),
            F.min("first_critical").alias("first_critical"),
            F.max_by("subsystem", F.struct("n", -F.col("first.event_no"))).alias("top_affected_subsystem"),
        )
        .select(
            "entity_id",
            "scenario",
            "policy",
            "event_count",
            "critical_count",
            F.col("first_warning.event_time").alias("first_warning_time"),
            F.col("first_critical.event_time").alias("first_critical_time"),
            "top_affected_subsystem",
            F.col("first.subsystem").alias("first_subsystem"),
            F.col("first.event_time").alias("first_event_time"),
        )
    )


def policy_comparison(samples: DataFrame, events: DataFrame, policies: DataFrame) -> DataFrame:
    """One row per entity and policy, entities and policies without events included."""
    # one row a policy: where its rows differ in their guidance, the first in order counts
    one = F.min(F.struct("recommended_action", "notes")).alias("_one")
    guidance = policies.groupBy("policy").agg(one).select("policy", "_one.*")
    entities = _with_scenario(samples).select(
        "entity_id", F.coalesce("scenario", F.lit(fixed.DEFAULT_SCENARIO)).alias("scenario")
    )
    # every entity reports under every policy: the names ride along as a literal, read
    # from the policy table, whose size is that of a hand-written configuration
    names = [r["policy"] for r in guidance.select("policy").distinct().orderBy("policy").collect()]
    slots = entities.distinct().select(*ENTITY, F.explode(F.array(*map(F.lit, names))).alias("policy"))
    facts = slots.join(policy_facts(events), [*ENTITY, "policy"], "left")
    return facts.join(guidance, ["policy"]).withColumns(
        {
            "event_count": F.coalesce("event_count", F.lit(0)),
            "critical_count": F.coalesce("critical_count", F.lit(0)),
        }
    )


def runbook_summary(comparison: DataFrame) -> DataFrame:
    """Runbook text per entity and policy."""
    busy = F.format_string(
        fixed.RUNBOOK_FORMAT,
        F.col("scenario"),
        F.col("event_count"),
        F.col("policy"),
        F.col("first_subsystem"),
        parsing.iso_utc(F.col("first_event_time")),
        F.col("critical_count"),
        F.col("recommended_action"),
    )
    quiet = F.format_string(fixed.QUIET_RUNBOOK_FORMAT, F.col("scenario"), F.col("policy"))
    return comparison.select(
        "entity_id",
        "scenario",
        "policy",
        "event_count",
        F.when(F.col("event_count") == 0, quiet).otherwise(busy).alias("runbook_summary"),
    )
