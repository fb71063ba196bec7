"""Configuration history of many receivers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandsift import params as P
from bandsift.operators.ordered import number_chunk, with_last_known, with_previous

ACQUISITION_FIELDS, OTHER_FIELDS = P.ACQUISITION_FIELDS, P.OTHER_FIELDS


def violations() -> Column:
    """Names of the range rules a full configuration breaks."""
    c = F.col
    power_of_two = (c("fft_size") > 0) & (
        c("fft_size").bitwiseAND(c("fft_size") - F.lit(1)) == 0
    )
    gain = F.lower(F.trim("gain"))
    rules = {
        "start_before_end": c("start_hz") < c("end_hz"),
        "sample_rate_positive": c("sample_rate") > 0,
        "alpha_in_range": (c("noise_floor_alpha") > 0) & (c("noise_floor_alpha") <= 1),
        "fft_power_of_two": power_of_two,
        "exclusions_ordered": ~F.exists(
            F.coalesce("exclusions", F.expr("cast(array() as array<struct<lo:bigint,hi:bigint>>)")),
            lambda e: e["lo"] >= e["hi"],
        ),
        **{rule: c(field).between(low, high) for rule, (field, low, high) in P.CONFIG_RANGES.items()},
        "backend": c("backend").isin(*P.BACKENDS),
        "gain": (gain == "auto") | gain.try_cast("double").isNotNull(),
    }
    return F.array_compact(
        F.array(
            *[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items()]
        )
    )


def warnings() -> Column:
    """Combinations that work but leave something to be desired."""
    c = F.col
    return F.array_compact(
        F.array(
            F.when(c("end_hz") - c("start_hz") < c("sample_rate"), F.lit("span_in_one_window")),
            F.when(
                (c("step_hz") != 0) & (c("step_hz") > c("sample_rate")), F.lit("step_leaves_gaps")
            ),
        )
    )


def config_audit(versions: DataFrame, chunk_versions: int = 10_000) -> DataFrame:
    """Full configuration after each partial update, with broken rules, warnings and
    whether the version changed acquisition. Null fields of an update mean unchanged."""
    fields = [f for f in [*ACQUISITION_FIELDS, *OTHER_FIELDS] if f in versions.columns]
    chunk = number_chunk("version", chunk_versions)
    keys, order = ["receiver_id"], ["version"]
    full = with_last_known(versions, keys, order, {f: f"full_{f}" for f in fields}, chunk)
    full = full.drop(*fields).withColumnsRenamed({f"full_{f}": f for f in fields})
    watched = [f for f in ACQUISITION_FIELDS if f in fields]
    rows = with_previous(full, keys, order, ["version", *watched], chunk)
    changed = F.lit(False)
    for f in watched:
        changed = changed | ~F.col(f).eqNullSafe(F.col(f"prev_{f}"))
    return (
        rows.withColumn(
            "acquisition_changed", F.col("prev_version").isNotNull() & changed
        )
        .drop("prev_version", *[f"prev_{f}" for f in watched])
        .withColumn("violations", violations())
        .withColumn("warnings", warnings())
    )


def latest_config(audited: DataFrame) -> DataFrame:
    """Newest version of every receiver."""
    rest = [c for c in audited.columns if c != "receiver_id"]
    return (
        audited.groupBy("receiver_id")
        .agg(F.max_by(F.struct(*rest), "version").alias("_row"))
        .select("receiver_id", "_row.*")
    )


def latest_version(versions: DataFrame) -> DataFrame:
    return versions.agg(F.coalesce(F.max("version"), F.lit(0)).alias("version"))
