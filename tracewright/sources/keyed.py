"""One JSON object keyed by bug id, read and written by many tasks.

Reading cuts the file into byte ranges, and these at commas. Whether a comma separates members depends on all before it: is a string open, how
deep is it. Each range tells what it does to both for either state of quotes at its start, the ranges' effects are composed over a table with
one row a range, and then every comma is judged within its range. The text is read again for each of these steps and not written in between:
members that lie within one range are parsed where they are read, and only what ranges hold of others is stored and put together.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import jsonbytes
from .bugs import _present
from .stages import Stages


def _pieces(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """part, file, start (of the byte range), text: the stretches between commas, in order, in the same parts and ranges each time they are read."""
    read = lambda: spark.read.text(paths, lineSep=",").select(
        F.spark_partition_id().alias("part"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("text")
    )
    planned = _present(spark, read, "part int, file string, start long, text string")._jdf
    # planned anew, files may be cut elsewhere: that depends on settings and on how many executors there are just then
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(planned.queryExecution().toRdd(), planned.schema(), False), spark)


def _ranges(pieces: DataFrame, together: bool) -> DataFrame:
    """A row for each range: object, file, start, what jsonbytes.States knows of it, and sound: the object's quotes and brackets close."""
    ranges = pieces.mapInArrow(jsonbytes.effects, jsonbytes.EFFECTS).withColumn("object", F.lit("") if together else F.col("file"))
    whole = W.partitionBy("object")
    ordered = whole.orderBy("file", "start")
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("flipped", F.pmod(F.coalesce(F.sum("quotes").over(before), F.lit(0)), F.lit(2)))
    ranges = ranges.withColumn("net", F.when(F.col("flipped") == 0, F.col("plain")).otherwise(F.col("quoted")))
    return ranges.select(
        "object", "file", "start", "part", "nth", "flipped", F.coalesce(F.sum("net").over(before), F.lit(0)).alias("level"),
        F.lead("start").over(W.partitionBy("object", "file").orderBy("start")).isNull().alias("final"), F.lag("start").over(ordered).isNull().alias("first"),
        F.lead("start").over(ordered).isNull().alias("last"), ((F.col("signs") > 0) & (F.coalesce(F.sum("signs").over(before), F.lit(0)) == 0)).alias("leads"),
        ((F.sum("net").over(whole) == 0) & (F.pmod(F.sum("quotes").over(whole), F.lit(2)) == 0)).alias("sound"),
    )


def _members(pieces: DataFrame, ranges: DataFrame) -> DataFrame:
    """jsonbytes.members() of the objects whose ranges are wanted; ranges: a few numbers of each are sent to all tasks."""
    states = pieces.sparkSession.sparkContext.broadcast(jsonbytes.States(ranges.select(*jsonbytes.States.COLUMNS).toArrow()))
    return pieces.mapInArrow(partial(_cut, states), jsonbytes.MEMBERS)


def _cut(states, batches):
    return jsonbytes.members(batches, states.value)


#: Bytes of JSON that a task sorts, about, where the session's shuffles would leave it more.
TASK = 1 << 27
HEAD, TAIL = r"^\s*\{", r"\}\s*\z"


def _braced() -> Column:
    """Of rows with first, last, text: text as one JSON object of one member, the braces of its own object taken off."""
    text = F.when(F.col("first"), F.regexp_replace("text", HEAD, "")).otherwise(F.col("text"))
    return F.concat(F.lit("{"), F.when(F.col("last"), F.regexp_replace(text, TAIL, "")).otherwise(text), F.lit("}"))


def _good() -> Column:
    """Of rows with first, last, text: the text is a JSON member, behind a brace if it is the first, before one if it is the last; or there is none in {}."""
    ends = (~F.col("first") | F.col("text").rlike(HEAD)) & (~F.col("last") | F.col("text").rlike(TAIL))
    none = F.col("first") & F.col("last") & _braced().rlike(r"^\{ *\}$")
    return none | ends & F.coalesce(F.size(F.from_json(_braced(), "map<string,string>")) == 1, F.lit(False))


def _joined(parts: DataFrame, ranges: DataFrame) -> DataFrame:
    """object, first, last, text of the members that no range holds whole; parts: what ranges hold of them."""
    placed = parts.select("part", "nth", "kind").join(ranges.select("object", "file", "start", "part", "nth"), ["part", "nth"])
    ordered = W.partitionBy("object").orderBy("file", "start", "kind")
    opened = F.sum((F.col("kind") == jsonbytes.OPENS).cast("int")).over(ordered.rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = placed.select("part", "nth", "kind", "object", opened.alias("member"), F.row_number().over(ordered).alias("place"))
    found = parts.join(F.broadcast(placed), ["part", "nth", "kind"]).groupBy("object", "member")  # at most two short rows a range; else the text is shuffled once more
    texts = F.array_sort(F.collect_list(F.struct("place", "text")))
    return found.agg(F.array_join(F.transform(texts, lambda p: p["text"]), "").alias("text"), F.bool_or("first").alias("first"), F.bool_or("last").alias("last"))


def entries(spark: SparkSession, paths: str | list[str], value: str, together: bool = False) -> DataFrame:
    """bug_id and value of each member of the JSON objects in paths; an object that is no sound JSON has no rows, nor has a missing file.

    Each file is one object, or all together are one, in order of their names, as write_object() leaves it. In a sound object quotes and brackets close,
    nothing but white space is around the braces, and each member is JSON. A member fits into one task; a file needn't.
    """
    pieces, stages = _pieces(spark, paths), Stages(spark)
    ranges = stages.write(_ranges(pieces, together), "ranges")
    kind = F.col("kind")
    inside = kind.isin(jsonbytes.CLOSES, jsonbytes.WITHIN, jsonbytes.OPENS)
    found = _members(pieces, ranges.withColumn("wanted", F.col("sound"))).where((kind != jsonbytes.WHOLE) | ~_good())
    found = stages.write(found.select("part", "nth", "kind", "first", "last", F.when(inside, F.col("text")).alias("text")), "parts")
    joined = _joined(found.where(inside), ranges)
    bad = found.where(~inside).join(ranges, ["part", "nth"]).select("object").union(joined.where(~_good()).select("object")).distinct()
    bad = stages.write(bad, "bad")  # a bad member of an object counts for all others
    wanted = ranges.join(bad.withColumn("bad", F.lit(True)), "object", "left").withColumn("wanted", F.col("sound") & F.col("bad").isNull())
    whole = _members(pieces, wanted).where(kind == jsonbytes.WHOLE).select("first", "last", "text")
    rows = whole.union(joined.join(bad, "object", "left_anti").select("first", "last", "text"))
    return rows.select(F.explode(F.from_json(_braced(), f"map<string,{value}>")).alias("bug_id", "value"))


def write_object(rows: DataFrame, folder: str, key: str = "bug_id") -> None:
    """rows(key, ...) as one JSON object from key to the other columns, cut over the text files of a folder: read in order of their names they are the object.

    Keys stand in order, each task writes a range of them, and no row holds more than one key's value. Keys are not null and differ; null fields are written.
    """
    fields = F.struct(*(c for c in rows.columns if c != key))
    keyed = rows.where(F.col(key).isNotNull()).select(F.lit(1).alias("part"), F.col(key).cast("string").alias("key"), fields.alias("fields"))
    as_json = F.to_json("fields", {"ignoreNullFields": "false"})
    least, size = keyed.agg(F.min("key"), F.coalesce(F.sum(F.octet_length(as_json)), F.lit(0))).head()
    ends = rows.sparkSession.createDataFrame([(0, ""), (2, "")], "part int, key string").withColumn("fields", F.lit(None).cast(keyed.schema["fields"].dataType))
    tasks = size // TASK
    more = [tasks] if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    ordered = keyed.unionByName(ends).repartitionByRange(*more, "part", "key").sortWithinPartitions("part", "key")
    name = F.substring(F.to_json(F.array("key")), 2, 2**30)
    comma = F.when(F.col("key") == F.lit(least), "").otherwise(",")
    member = F.concat(comma, F.left(name, F.length(name) - 1), F.lit(": "), as_json)
    value = F.when(F.col("part") == 0, "{").when(F.col("part") == 2, "}").otherwise(member)
    ordered.select(value.alias("value")).write.mode("overwrite").text(folder)
