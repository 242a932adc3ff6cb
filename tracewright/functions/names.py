"""Qualified function names, file names of bug ids, test lists, prompts and patches as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PASSED, FAILED = ("PASS", "PASSED"), ("FAIL", "FAILED")
SEPARATOR = "::"
#: Fixed value: how a first line starts that is no part of a reply's code.
NOTE = "// Bắt đầu"
#: What str.strip and str.isspace of Python call white space, as a Java character class.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def qualify(file: Column, name: Column) -> Column:
    return F.concat(file, F.lit(SEPARATOR), name)


def bare_name(qualified: Column) -> Column:
    """The part after the last separator; all of it without one."""
    return F.substring_index(qualified, SEPARATOR, -1)


def source_of(qualified: Column) -> Column:
    """The part before the last separator; empty without one."""
    size = F.length(qualified) - F.length(bare_name(qualified)) - len(SEPARATOR)
    return F.when(F.instr(qualified, SEPARATOR) > 0, F.left(qualified, size)).otherwise("")


def qualify_all(names: Column, file: Column) -> Column:
    return F.transform(names, lambda n: F.when(F.contains(n, F.lit(SEPARATOR)), n).otherwise(qualify(file, n)))


def qualify_tests(tests: Column, file: Column) -> Column:
    """Tests with qualified covered_methods; missing coverage becomes empty."""
    none = F.array().cast("array<string>")
    return F.transform(tests, lambda t: t.withField("covered_methods", qualify_all(F.coalesce(t["covered_methods"], none), file)))


def _versioned(bug_id: Column, which: int) -> Column:
    parts = F.split(bug_id, "-bug-")
    return F.coalesce(F.concat(parts[0], F.lit("-"), F.get(F.split(F.get(parts, F.lit(1)), "-"), F.lit(which)), F.lit(".c")), F.lit(""))


def buggy_file(bug_id: Column) -> Column:
    return _versioned(bug_id, 0)


def accepted_file(bug_id: Column) -> Column:
    return _versioned(bug_id, 1)


def source_path(folder: Column, bug_id: Column) -> Column:
    """folder/bug/file; the bug's folder where its id names no file."""
    file = buggy_file(bug_id)
    return F.when(file != "", F.concat_ws("/", folder, bug_id, file)).otherwise(F.concat_ws("/", folder, bug_id))


def ids_with(tests: Column, outcomes: tuple[str, ...]) -> Column:
    """Ids of tests with these outcomes (case counts), in input order."""
    return F.transform(F.filter(tests, lambda t: t["outcome"].isin(*outcomes)), lambda t: t["test_id"])


def failed_context(tests: Column, most: int = 500) -> Column:
    """What the first failing test expected and saw; empty without one."""
    first = F.get(F.filter(tests, lambda t: t["outcome"].isin(*FAILED)), F.lit(0))
    field = lambda name: F.coalesce(first[name], F.lit(""))
    actual = F.when(F.length(field("actual_output")) > most, F.concat(F.left(field("actual_output"), F.lit(most)), F.lit("\n...[truncated]"))).otherwise(field("actual_output"))
    body = F.concat(
        F.lit("Failing test: "), field("test_id"), F.lit("\nExpected output:\n"), strip(field("expected_output")), F.lit("\nActual output:\n"), strip(actual),
        F.lit("\nReason: "), field("fail_reason"),
    )
    return F.when(first.isNotNull(), body).otherwise("")


def repair_prompt(name: Column, bug_id: Column, context: Column, source: Column) -> Column:
    """The task, the failing test and the whole source, for what the function uses."""
    return F.concat(
        F.lit("Repair the C function "), name, F.lit(" of "), bug_id, F.lit(".\n"), context, F.lit("\nSource file:\n"), source, F.lit("\nReturn the repaired function "), name, F.lit(" only.")
    )


def unfenced(reply: Column, note: str | None = None) -> Column:
    """The code in a reply: after the first fence, up to the last one; a first line that starts with note is dropped."""
    text = strip(reply)
    opening = r"```(?:c|cpp)?\s*\n"
    at = F.regexp_instr(text, F.lit(opening))
    start = at + F.length(F.regexp_extract(text, opening, 0))  # 1-based
    last = F.length(text) - F.instr(F.reverse(text), "```") - 1  # 1-based start of the last fence
    inner = F.when(last > start, F.substr(text, start, last - start)).otherwise(F.substr(text, start))
    body = strip(F.when(at > 0, inner).otherwise(text))
    if note:
        body = strip(F.when(F.startswith(body, F.lit(note)), F.regexp_replace(body, r"^[^\n]*\n?", "")).otherwise(body))
    return body


def splice(source: Column, patch: Column, start: Column, end: Column) -> Column:
    """source with [start, end) replaced; offsets from 0."""
    return F.concat(F.left(source, start), patch, F.substr(source, end + 1))


def patch_file(engine: Column, status: Column, bug_id: Column) -> Column:
    """The name under which an engine's patch is written; null where none is."""
    fixed = status.isin("success", "timeout_repaired")
    return (
        F.when((engine == "llm") & fixed, F.concat(bug_id, F.lit("_patch.c")))
        .when((engine == "mutation") & fixed, F.concat(bug_id, F.lit("_mutation_patch.c")))
        .when((engine == "mutation") & (status == "timeout"), F.concat(bug_id, F.lit("_mutation_timeout.c")))
        .when((engine == "mutation") & (status == "failed"), F.concat(bug_id, F.lit("_mutation_best_effort.c")))
        .when((engine == "genprog") & status.isin("success", "plausible_only", "timeout_repaired", "timeout_plausible"), F.concat(bug_id, F.lit("_genprog_patch.c")))
    )
