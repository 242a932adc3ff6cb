"""Mutants of code text: rules of pattern and replacements, applied match by match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codetext
from ..functions.names import SPACE, strip

#: Fixed rules, in order: pattern, replacements.
RULES = [
    (r"(?<=\w)\s*<\s*(?=\w)", [" <= ", " > ", " >= ", " == ", " != "]),
    (r"(?<=\w)\s*>\s*(?=\w)", [" >= ", " < ", " <= ", " == ", " != "]),
    (r"(?<=\w)\s*<=\s*(?=\w)", [" < ", " == "]),
    (r"(?<=\w)\s*>=\s*(?=\w)", [" > ", " == "]),
    (r"(?<=\w)\s*==\s*(?=\w)", [" != ", " <= ", " >= "]),
    (r"(?<=\w)\s*!=\s*(?=\w)", [" == "]),
    (r"(?<=\w)\s*\+\s*(?=\w)", [" - "]),
    (r"(?<=\w)\s*-\s*(?=\w)", [" + "]),
    (r"(\+\s*1)\b", ["- 1", ""]),
    (r"(-\s*1)\b", ["+ 1", ""]),
]
#: What every match of a rule holds; texts without it are not searched for the rule.
SIGNS = ["<", ">", "<=", ">=", "==", "!=", "+", "-", "+", "-"]
#: What the rules mean by word characters and white space, in any script; their word ends follow a digit.
CLASSES = {r"\w": r"[\p{L}\p{N}_]", r"\s": SPACE, r"\b": r"(?![\p{L}\p{N}_])"}
DESCRIPTION = "Đổi '%s' → '%s'"


def mutants(functions: DataFrame, key: str = "id", code: str = "code") -> DataFrame:
    """(key, mutant_ordinal, code, description): for each rule, match and replacement one mutant; of equal texts the first. key differs by row.

    Everything happens within the row, so nothing is shuffled: rules give places and replacements, of which those that give a text
    seen before are taken out by their normal form, without making any text, and only then a row is made for each, with its text.
    """
    made = F.concat(*(_changes(F.col(code), sign, *rule) for sign, rule in zip(SIGNS, RULES, strict=True)))
    made = F.filter(made, lambda x: strip(x["hit"]) != strip(x["put"]))
    ordered = functions.select(key, code, made.alias("made")).select(
        key, code, F.array_sort(F.transform("made", lambda x, i: F.struct(_normal(F.col(code), x).alias("normal"), i.alias("nth"), x.alias("change")))).alias("marked")
    )
    firsts = F.filter("marked", lambda x, i: (i == 0) | (F.get(F.col("marked"), i - 1)["normal"] != x["normal"]))
    kept = F.array_sort(F.transform(firsts, lambda x: F.struct(x["nth"].alias("nth"), x["change"].alias("change"))))
    each = ordered.select(key, code, F.posexplode(kept).alias("at", "x"))
    change = F.col("x.change")
    said = F.format_string(DESCRIPTION, strip(change["hit"]), strip(change["put"]))
    return each.select(key, (F.col("at") + 1).alias("mutant_ordinal"), _applied(F.col(code), change).alias("code"), said.alias("description"))


def _normal(text: Column, change: Column) -> Column:
    """struct(at, gone, new): the same for two changes of text exactly if they give the same text.

    Equal ends of what goes and what comes are no change. What is left is unique, unless nothing goes or nothing comes: then it may stand
    further left as well, where the text before repeats it, and the leftmost place counts.
    """
    hit, put = change["hit"], change["put"]
    least = F.least(F.length(hit), F.length(put))

    def inner(p: Column, s: Column) -> Column:
        middle = lambda t: F.substr(t, p + 1, F.length(t) - p - s)
        return F.struct((change["start"] + p).alias("at"), middle(hit).alias("gone"), middle(put).alias("new"))

    def trimmed(p: Column) -> Column:
        return codetext.let(codetext.common_end(hit, put, least - p, F.right), lambda s: inner(p, s))

    def settled(cut: Column) -> Column:
        one = F.concat(cut["gone"], cut["new"])
        left = lambda n: F.struct((cut["at"] - n).alias("at"), _turned(cut["gone"], n).alias("gone"), _turned(cut["new"], n).alias("new"))
        nothing = F.struct(F.lit(-1).alias("at"), F.lit("").alias("gone"), F.lit("").alias("new"))
        return F.when(one == "", nothing).when((cut["gone"] != "") & (cut["new"] != ""), cut).otherwise(codetext.let(_repeats(text, cut["at"], one), left))

    return codetext.let(codetext.let(codetext.common_end(hit, put, least, F.left), trimmed), settled)


def _turned(text: Column, n: Column) -> Column:
    """text with its last n % length characters in front."""
    turn = F.when(F.length(text) > 0, F.pmod(n, F.length(text))).otherwise(0)
    return F.concat(F.right(text, turn), F.left(text, F.length(text) - turn))


def _repeats(text: Column, at: Column, piece: Column) -> Column:
    """How many characters of text before at go on as if piece stood there again and again; looks as far back as it has to."""

    def within(window: Column) -> Column:
        n = F.least(window, at)
        sides = F.struct(F.substr(text, at - n + 1, n).alias("own"), F.repeat(piece, (n / F.length(piece)).cast("int") + 1).alias("again"))
        return codetext.let(sides, lambda s: codetext.common_end(s["own"], s["again"], n, F.right))

    windows = F.array(F.lit(16), F.lit(1024), F.lit(65_536), F.lit(2**31 - 1))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("seen"))
    look = lambda acc, w: F.when(acc["n"] < acc["seen"], acc).otherwise(F.struct(within(w).alias("n"), F.least(w, at).alias("seen")))
    return F.aggregate(windows, start, lambda acc, w: F.when(acc["seen"] == at, acc).otherwise(look(acc, w)), lambda acc: acc["n"])


def _changes(text: Column, sign: str, pattern: str, replacements: list[str]) -> Column:
    """Array of struct(start, size, hit, put) of a rule, by match and replacement; start counts from 0."""
    for short, full in CLASSES.items():
        pattern = pattern.replace(f"{short}*", f"{full}*+").replace(short, full)  # no sign is white space
    others = "".join(f"\\{chr(c)}" if not chr(c).isalnum() else chr(c) for c in range(33, 127) if chr(c) != sign[0])
    pattern = rf"(?![{others}])(?:{pattern})"  # no match begins with these: most characters take one look
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # what stands between matches, by a pattern that goes on where the last match ended: split() would compile its pattern row by row
    between = F.regexp_extract_all(text, F.lit(rf"\G([\s\S]*?){pattern}"), F.lit(1))
    places = "array<struct<start:int,hit:string>>"

    def step(acc, pair):
        start = acc["end"] + pair["gap"]
        place = F.array(F.struct(start.alias("start"), pair["hit"].alias("hit"))).cast(places)
        return F.struct((start + F.length(pair["hit"])).alias("end"), F.concat(acc["places"], place).alias("places"))

    def placed(hits: Column) -> Column:
        pairs = F.zip_with(between, hits, lambda b, h: F.struct(F.length(b).alias("gap"), h.alias("hit")))
        return F.when(F.size(hits) > 0, F.aggregate(pairs, begun, step, lambda acc: acc["places"])).otherwise(none)

    none = F.array().cast(places)
    begun = F.struct(F.lit(0).alias("end"), none.alias("places"))
    hits = F.when(F.contains(text, F.lit(sign)), codetext.let(found, placed)).otherwise(none)
    puts = F.array(*(F.lit(r) for r in replacements))
    return F.flatten(F.transform(hits, lambda h: F.transform(puts, lambda r: F.struct(h["start"].alias("start"), F.length(h["hit"]).alias("size"), h["hit"].alias("hit"), r.alias("put")))))


def _applied(text: Column, change: Column) -> Column:
    return F.concat(F.left(text, change["start"]), change["put"], F.substr(text, change["start"] + change["size"] + 1))
