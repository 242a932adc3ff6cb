"""Repair logs and settings as columns: counts, statuses, lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def logged_count(log: Column, heading: str) -> Column:
    """The number after "heading: Tot"; 0 where the log is null or lacks it."""
    return F.coalesce(F.regexp_extract(log, rf"{heading}:\s*Tot\s+(\d+)", 1).try_cast("int"), F.lit(0))


def revlog_counts(log: Column, tests_passed: Column, tests_failed: Column) -> Column:
    """struct(pos, neg) of a log; where both are 0, the outcomes of the tests."""
    pos, neg = logged_count(log, "Positive Cases"), logged_count(log, "Diff Cases")
    none = (pos == 0) & (neg == 0)
    return F.struct(F.when(none, tests_passed).otherwise(pos).alias("pos"), F.when(none, tests_failed).otherwise(neg).alias("neg"))


def run_status(output: Column) -> Column:
    """Status of a search run by its output; the first rule that holds."""
    has = lambda s: F.contains(output, F.lit(s))
    return (
        F.when(has("Timeout"), "timeout")
        .when(has("ERROR") & (has("not found") | has("không tìm thấy")), "error")
        .when(has("Repair Found"), "repair_found")
        .when(has("Failed to make") | has("BUILDFAILED"), "build_failed")
        .otherwise("no_repair")
    )


def final_status(run: Column, has_file: Column, has_patch: Column, n_failed: Column) -> Column:
    """Status of a bug from its run's status, whether a repair file and a patch exist, and the tests that fail."""
    late = run == "timeout"
    with_patch = F.when(n_failed == 0, F.when(late, "timeout_repaired").otherwise("success")).otherwise(F.when(late, "timeout_plausible").otherwise("plausible_only"))
    repaired = late | (run == "repair_found")
    return F.when(late & ~has_file, "timeout").when(repaired & has_patch, with_patch).when(repaired, "repair_found_no_file").otherwise(run)


def settings_with(text: Column, values: dict[str, str]) -> Column:
    """Lines of text without those that start with a key of values, then a line for each key."""
    kept = F.split(text, "\n")
    for key in values:
        kept = _without(kept, key)
    return F.array_join(F.concat(kept, F.array(*(F.lit(f"{k} {v}") for k, v in values.items()))), "\n")


def _without(lines: Column, key: str) -> Column:
    return F.filter(lines, lambda line: ~F.startswith(line, F.lit(key)))


def without_lines(text: Column, marker: str) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~F.contains(line, F.lit(marker))), "\n")


def last_lines(text: Column, n: int = 5) -> Column:
    """The non-blank ones of the last n lines."""
    lines = F.split(text, "\n")
    return F.filter(F.slice(lines, F.greatest(F.size(lines) - n + 1, F.lit(1)), F.lit(n)), lambda line: F.trim(line) != "")
