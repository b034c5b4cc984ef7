"""Grading of diagnoses against the ledger: tiers, partial credit, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.expressions import strip
from sluice.operators.ledger import keys_in_spans, window_keys
from sluice.schemas import ALIASES, CASCADE_KEY, EXPECTED_SURFACE

# --- fixed values: the rubric -----------------------------------------------------
EXACT, ALIAS, MISS = 1.0, 0.7, 0.0
CASCADE_BASE, CASCADE_SHARE = 0.5, 0.5


def _lookup(pairs: dict[str, str]):
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def grade(diagnoses: DataFrame, ledger: DataFrame, window_col: str) -> DataFrame:
    """One graded row per diagnosis, for any number of windows in one job.

    A window is joined by its id. A NULL failure key is a missing diagnosis. A claimed
    cascade is graded as a cascade even where the ledger holds none, so it earns at
    least the base score.
    """
    return grade_against(diagnoses, window_keys(ledger, window_col), window_col)


def grade_by_range(
    diagnoses: DataFrame,
    ledger: DataFrame,
    window_col: str,
    start: str,
    end: str,
    cell_s: int = 600,
) -> DataFrame:
    """Grades where a window is a span of time, ``start`` included and ``end`` not.

    ``window_col`` names each diagnosis; spans may overlap, nest or have any length. A
    span without incidents, an empty or reversed one and one with a NULL end is
    ``no-run``.
    """
    spans = diagnoses.select(window_col, start, end)
    truth = keys_in_spans(spans, ledger, window_col, start, end, cell_s)
    return grade_against(diagnoses, truth, window_col)


def grade_against(diagnoses: DataFrame, found: DataFrame, window_col: str) -> DataFrame:
    """Grades against what each window holds: keys, last key and number of incidents."""
    truth = found.select(F.col(window_col).alias("_w"), "keys", "last_key", "incidents")
    d = diagnoses.join(truth, F.col(window_col) == F.col("_w"), "left")

    claimed, last = F.col("failure_key"), F.col("last_key")
    no_run = claimed.isNull() | F.col("_w").isNull()
    cascade = F.array_contains("keys", CASCADE_KEY) | (claimed == CASCADE_KEY)
    alias = F.lit(False)
    for left, right in ALIASES:
        alias = alias | ((claimed == left) & (last == right))
    tier = (
        F.when(no_run, "no-run")
        .when(cascade, "cascade")
        .when(claimed == last, "exact")
        .when(alias, "alias")
        .otherwise("miss")
    )

    members = F.array_remove("keys", CASCADE_KEY)
    named = F.array_distinct(F.coalesce("sub_failures", F.array().cast("array<string>")))
    overlap = F.size(F.array_intersect(named, members))
    share = F.when(F.size(members) > 0, overlap / F.size(members)).otherwise(F.lit(0.0))
    cascade_score = F.round(F.lit(CASCADE_BASE) + F.lit(CASCADE_SHARE) * share, 4)

    expected = F.coalesce(_lookup(EXPECTED_SURFACE)[last], F.lit(""))
    cited = strip(F.coalesce("evidence_surface", F.lit("")))
    evidence = F.when((expected != "") & (cited == expected), 1.0).otherwise(0.0)

    single = F.col("tier").isin("exact", "alias", "miss")
    graded = d.withColumn("tier", tier).select(
        window_col,
        claimed.alias("diagnosed"),
        "tier",
        F.when(F.col("tier") == "cascade", CASCADE_KEY)
        .when(single, last)
        .otherwise(F.lit(""))
        .alias("matched"),
        F.when(F.col("tier") == "cascade", cascade_score)
        .when(F.col("tier") == "exact", EXACT)
        .when(F.col("tier") == "alias", ALIAS)
        .otherwise(MISS)
        .alias("diagnosis_score"),
        F.when(single, evidence).otherwise(0.0).alias("evidence_score"),
        F.when(F.col("tier") == "cascade", overlap).otherwise(0).alias("overlap"),
        F.when(F.col("tier") == "cascade", F.size(members)).otherwise(0).alias("members"),
        F.when(F.col("tier") == "no-run", 0)
        .otherwise(F.col("incidents"))
        .alias("oracle_incidents"),
    )
    correct = F.col("diagnosis_score") >= EXACT
    return graded.withColumn("label", F.when(correct, "correct").otherwise("incorrect"))


def scorecard(graded: DataFrame) -> DataFrame:
    """Count, mean scores and correct answers per tier."""
    return graded.groupBy("tier").agg(
        F.count("*").alias("diagnoses"),
        F.round(F.avg("diagnosis_score"), 6).alias("mean_score"),
        F.round(F.avg("evidence_score"), 6).alias("mean_evidence"),
        F.count_if(F.col("label") == "correct").alias("correct"),
    )
