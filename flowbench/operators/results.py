"""Result rows, their ranking and summaries. Results: ``schema_version, dataset, split, predictor, num_samples, metrics, run``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Run entry with the version of the software that made a result.
VERSION_KEY = "software_version"
#: Fixed columns of a leaderboard, in order.
LEADERBOARD = (
    "timestamp_utc", "dataset", "split", "predictor", "schema_version", "num_samples", "exact_match_rate", "edge_f1", "node_f1", "direction_accuracy",
    "node_count_error", "edge_count_error", "runtime_mean_s", VERSION_KEY, "git_sha", "platform", "python",
)
SCORES, ERRORS = LEADERBOARD[6:10], LEADERBOARD[10:12]
METRICS, RUN = LEADERBOARD[6:13], ("timestamp_utc", *LEADERBOARD[13:])
REQUIRED_METRICS = ("node_f1", "edge_f1", "exact_match_rate")


def result_rows(results: DataFrame) -> DataFrame:
    """Results in leaderboard columns; what is missing is null."""
    pick = {**{c: F.element_at("run", c) for c in RUN}, **{c: F.element_at("metrics", c) for c in METRICS}}
    return results.select(*[pick.get(c, F.col(c)).alias(c) for c in LEADERBOARD])


def leaderboard(results: DataFrame) -> DataFrame:
    """Rows with the best first: scores down, errors up, missing ones last, then by name."""
    rows = result_rows(results)
    return rows.orderBy(*[F.desc_nulls_last(c) for c in SCORES], *[F.asc_nulls_last(c) for c in ERRORS], "predictor", "dataset", "split")


def leaderboard_markdown(board: DataFrame) -> DataFrame:
    """``line``: each row of a leaderboard as a table row; line breaks become spaces, bars are escaped."""
    cell = lambda c: F.coalesce(F.replace(F.regexp_replace(F.col(c).cast("string"), r"\r?\n", " "), F.lit("|"), F.lit("\\|")), F.lit(""))
    return board.select(F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, LEADERBOARD)), F.lit(" |")).alias("line"))


def result_summary(results: DataFrame) -> DataFrame:
    """Names, metrics and provenance of any result; missing names are ``unknown``, missing metrics stay out."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c)
    keep = lambda c, names: F.map_filter(c, lambda k, v: k.isin(*names) & v.isNotNull())
    return results.select(
        *[known(c) for c in ("schema_version", "dataset", "split", "predictor", "num_samples")],
        keep("metrics", METRICS).alias("metrics"), keep("run", ("timestamp_utc", VERSION_KEY, "git_sha")).alias("run"),
    )


def validate_results(results: DataFrame) -> DataFrame:
    """``dataset, split, predictor, code`` of what is wrong with results."""
    missing = F.array_except(F.array(*map(F.lit, REQUIRED_METRICS)), F.coalesce(F.map_keys("metrics"), F.array().cast("array<string>")))
    codes = F.array_compact(F.array(
        F.when(F.col("schema_version").isNull() | (F.col("schema_version") != "1.1"), "schema_version"),
        F.when(F.size(missing) > 0, "missing_metric"), F.when(F.col("num_samples").isNull() | (F.col("num_samples") < 0), "num_samples"),
    ))
    return results.select("dataset", "split", "predictor", F.explode(codes).alias("code"))
