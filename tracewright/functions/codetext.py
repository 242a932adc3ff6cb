"""C source text as columns: normalised code, braces, functions, compared outputs. Built-in expressions, but for distances of long texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .distance import long_distance
from .names import SPACE

# Fixed patterns: literals with escapes, comments, white space. Possessive quantifiers keep long literals off the stack.
LITERAL = r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+(?:"|\\?\z)|' + r"'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+(?:'|\\?\z)"
NOISE = rf"({LITERAL})|//[^\n]*+|/\*[\s\S]*?(?:\*/|\z)|{SPACE}++"
TOKEN = rf"""({LITERAL}|//[^\n]*+\n?|/\*[\s\S]*?(?:\*/|\z)|[{{}}]|[^{{}}"'/]++|/)"""
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
TYPE_WORDS = "int|void|char|double|float|long|unsigned|short|struct|static|inline|const"


def normalised(code: Column) -> Column:
    """Without comments and white space; quoted literals stay as they are."""
    return F.regexp_replace(code, NOISE, "$1")


def matching_brace(text: Column) -> Column:
    """Length of the prefix of text that ends where its first brace closes; -1 if it never does. Quotes and comments don't count."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("read"), F.lit(-1).alias("end"))

    def step(acc, token):
        depth = acc["depth"] + F.when(token == "{", 1).when(token == "}", -1).otherwise(0)
        read = acc["read"] + F.length(token)
        closes = (acc["end"] < 0) & (token == "}") & (depth == 0)
        return F.struct(depth.alias("depth"), read.alias("read"), F.when(closes, read).otherwise(acc["end"]).alias("end"))

    return F.aggregate(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1)), start, step)["end"]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def function_span(source: Column, name: Column) -> Column:
    """struct(start, end, code) of the first definition of a function, offsets from 0; start and end -1, code null without one."""
    pattern = F.concat(F.lit(rf"\b(?:(?:{TYPE_WORDS})\s+)*\**\s*\Q"), name, F.lit(r"\E\s*\([^)]*\)\s*\{"))
    head = F.struct(F.regexp_instr(source, pattern).alias("at"), F.length(F.regexp_substr(source, pattern)).alias("size"))  # at counts from 1

    def closed(h: Column) -> Column:
        brace = h["at"] + h["size"] - 1
        return F.struct(h["at"].alias("at"), brace.alias("brace"), F.when(h["at"] > 0, matching_brace(F.substr(source, brace))).otherwise(-1).alias("length"))

    def told(h: Column) -> Column:
        found = (h["at"] > 0) & (h["length"] > 0)
        end = h["brace"] - 1 + h["length"]
        return F.struct(
            F.when(found, h["at"] - 1).otherwise(-1).alias("start"),
            F.when(found, end).otherwise(-1).alias("end"),
            F.when(found, F.substr(source, h["at"], end - h["at"] + 1)).alias("code"),
        )

    return let(let(head, closed), told)


def comparable(output: Column) -> Column:
    """Lines without trailing white space and without trailing blank lines; leading and inner blanks count."""
    lines = F.transform(F.split(output, LINE_END), lambda x: F.regexp_replace(x, rf"{SPACE}+\z", ""))
    return F.regexp_replace(F.array_join(lines, "\n"), r"\n+\z", "")


def same_output(actual: Column, expected: Column) -> Column:
    return comparable(actual) == comparable(expected)


#: Texts up to this long are compared by Spark's own levenshtein, longer ones in distance.py.
SHORT = 64


def text_distance(a: Column, b: Column) -> Column:
    """Exact edit distance in code points; of near texts it takes time with their length and the square of their distance."""
    short = F.greatest(F.length(a), F.length(b)) <= SHORT
    return F.when(short, F.levenshtein(a, b)).otherwise(long_distance(F.when(~short, a), F.when(~short, b)))


def common_end(x: Column, y: Column, most: Column, end: Callable[[Column, Column], Column]) -> Column:
    """Length, up to most, of the common end of x and y that end(text, length) gives (F.left, F.right): by halving steps."""
    top = F.floor(F.log2(F.greatest(most, F.lit(1)).cast("double"))).cast("int")
    steps = F.transform(F.sequence(F.lit(0), top), lambda k: F.pow(F.lit(2.0), top - k).cast("int"))
    fits = lambda n: (n <= most) & (end(x, n) == end(y, n))
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(fits(n + step), n + step).otherwise(n))


def edit_distance(a: Column, b: Column) -> Column:
    """Distance of two normalised texts in code points; -1 where either is null or empty once normalised."""
    x, y = normalised(a), normalised(b)
    return F.coalesce(F.when((F.length(x) > 0) & (F.length(y) > 0), text_distance(x, y)), F.lit(-1))
