"""Near-duplicate detection by min-max hashing.

Each permutation gives two signature values, the minimum and the maximum of a set's
images, so a signature of a given length costs half the hash evaluations; both agree
with probability equal to the Jaccard similarity. Bands of signature values propose
candidates; every link is confirmed on the full sets.

Documents with equal sets become one node first. In a bucket every node is compared
with the bucket's pivot, its most central node (the one whose buckets are the largest),
which joins a group of near copies by a star instead of all its pairs. What is left are
pairs of nodes of one pivot's buckets that the links found so far don't connect. They
are found by their differences from the pivot: the shingles that only one of node and
pivot has. A node of n shingles, d of them and the pivot's being differences, and one
of m and e, c of the differences in common, have d + e - 2c shingles that only one of
the two has, and are linked if that is at most (n + m) * slack, slack being (100 -
percent) / (100 + percent). So

- 2c >= d + e - (n + m) * slack for a link;
- one of the two is not linked to the pivot (they were connected otherwise), whence
  2c > e * (1 - slack) if e belongs to the other: most differences of a near copy of
  the pivot are shared with any straggler that it is linked to.

Either bound says how many differences a node shares with any partner at least, so the
partners meet in the rarest differences that remain when one fewer than that many of the
most frequent are taken off (required() below). Only these are spread out, one
row for each; differences that only one component has are dropped; pairs meet in what is
left, and those that pass the first bound are confirmed. No link between nodes that share a
bucket is lost, whatever the size of the group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, load, text_or_empty

PERMUTATIONS = 40  # 80 signature values
ROWS = 4  # values in a band: 20 bands; a pair of similarity 0.8 shares one with probability 0.99997
STAR_ROWS = 4096  # about as many nodes of a star meet one copy of its pivot's set
BIT_WORDS = 4  # 64-bit words of a bitmap that bounds the size of a union from below
CELLS = 1 << 17  # counters that put differences in order; more hashed differences share one, which costs order, no links
_word_ids: dict[bytes, int] = {}


def word_ids(words: list[bytes]) -> np.ndarray:
    if len(_word_ids) > 400_000:  # a worker's cache, not a limit on words
        _word_ids.clear()
    known, digest = _word_ids, xxhash.xxh3_64_intdigest
    out = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = known.get(w)
        if h is None:
            h = known[w] = digest(w)
        out[i] = h
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted 64-bit fingerprints of the distinct shingles; shorter texts are one shingle, texts without words none."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    ids = word_ids(words)
    span = min(width, len(ids))
    shingles = ids[: len(ids) - span + 1]
    for k in range(1, span):
        shingles = mixed(shingles * np.uint64(3) + ids[k : len(ids) - span + 1 + k])
    return np.unique(mixed(shingles + np.uint64(span)))


def permutations(number: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 2**64, number, np.uint64, endpoint=False) | np.uint64(1), rng.integers(0, 2**64, number, np.uint64, endpoint=False)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the set under each permutation: 2 x len(a) values."""
    low, high = np.full(len(a), 2**64 - 1, np.uint64), np.zeros(len(a), np.uint64)
    for at in range(0, len(shingles), 2048):
        images = shingles[at : at + 2048, None] * a + b
        low, high = np.minimum(low, images.min(0)), np.maximum(high, images.max(0))
    return np.concatenate([low, high])


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    bands = values[: len(values) // rows * rows].reshape(-1, rows)
    key = np.arange(len(bands), dtype=np.uint64) + np.uint64(1)
    for k in range(rows):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, k])
    return key.astype(np.int64)


def sketches(docs: DataFrame, width: int, permuted: int = PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """row, doc_id, n_shingles, set_key (digest of the whole set) and band keys of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = permutations(permuted)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                sizes, keys, bands = [], [], []
                for text in part.column(1):
                    shingles = shingle_set(text.as_py(), width)
                    sizes.append(len(shingles))
                    keys.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                    bands.append(band_keys(signature(shingles, a, b), rows) if len(shingles) else np.zeros(0, np.int64))
                ids = np.arange(row, row + part.num_rows)
                row += part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), part.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["row", "doc_id", "n_shingles", "set_key", "bands"],
                )

    return docs.mapInArrow(run, "row long, doc_id long, n_shingles long, set_key binary, bands array<long>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                sets = [shingle_set(x.as_py(), width).tobytes() for x in batch.slice(at, 2000).column(0)]
                keys = [xxhash.xxh3_128_digest(x) for x in sets]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], names=["set_key", "members"])

    return docs.select("text").mapInArrow(run, "set_key binary, members binary")


def _fetched(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left = sets.select(F.col("node").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("y"))
    return pairs.join(left, "a").join(right, "b")


def _fetched_salted(stars: DataFrame, sets: DataFrame) -> DataFrame:
    """_fetched for stars (a, b, salt, salts): STAR_ROWS nodes meet one copy of their pivot's set, so no task writes it for a whole large star."""
    left = sets.select(F.col("node").alias("a"), F.lit(0).cast("long").alias("salt"), F.col("members").alias("x"))
    large = stars.where("salts > 1").select("a", "salts").distinct()
    more = sets.join(large, sets.node == large.a).select("a", F.explode(F.sequence(F.lit(1).cast("long"), F.col("salts") - 1)).alias("salt"), F.col("members").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("y"))
    return stars.join(left.union(more), ["a", "salt"]).join(right, "b")


def bitmap(values: np.ndarray) -> np.ndarray:
    """BIT_WORDS words with the bit of each value set; a union has at least as many values as its bitmap has bits."""
    bits = np.zeros(64 * BIT_WORDS, np.uint8)
    bits[values % np.uint32(len(bits))] = 1
    return np.packbits(bits, bitorder="little").view("<i8")


def against_pivots(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """For pairs of pivot a and node b: sizes, whether linked; where the pivot has several nodes the differences, 32 bits of each, and their bitmap."""
    names = ["a", "b", "n_a", "n_b", "linked", "d", "differences", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivot_sizes, sizes, linked, counts, differences, bits = [], [], [], [], [], []
            for several, x, y in zip(*batch.columns[2:], strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                apart = np.setxor1d(x, y, assume_unique=True)
                pivot_sizes.append(len(x))
                sizes.append(len(y))
                counts.append(len(apart))
                linked.append((100 + percent) * len(apart) <= (100 - percent) * (len(x) + len(y)))
                if wanted := several.as_py():
                    apart = (apart >> np.uint64(32)).astype(np.uint32)
                differences.append(apart.tobytes() if wanted else None)
                bits.append(bitmap(apart) if wanted else None)
            numbers = [pa.array(x, pa.int64()) for x in (pivot_sizes, sizes)]
            rest = [pa.array(linked, pa.bool_()), pa.array(counts, pa.int64()), pa.array(differences, pa.binary()), pa.array(bits, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *numbers, *rest], names=names)

    schema = "a long, b long, n_a long, n_b long, linked boolean, d long, differences binary, bits array<long>"
    return _fetched_salted(stars, sets).select("a", "b", "several", "x", "y").mapInArrow(run, schema)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets satisfy 100 * |intersection| >= percent * |union|."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select([0, 1]).take(pa.array(np.flatnonzero(ok)))

    return _fetched(pairs, sets).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def cell_of(pivot: int, differences: np.ndarray) -> np.ndarray:
    return (mixed(differences.astype(np.uint64) + mixed(np.array([pivot], np.uint64))) % np.uint64(CELLS)).astype(np.int64)


def difference_counts(group: DataFrame) -> np.ndarray:
    """How often the differences of each cell occur in all of group: CELLS numbers, whatever the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(CELLS, np.int64)
        for batch in batches:
            cells = [cell_of(pivot, np.frombuffer(found, np.uint32)) for pivot, found in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            if cells:
                seen += np.bincount(np.concatenate(cells), minlength=CELLS)
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[used])], names=["cell", "n"])

    out = np.zeros(CELLS, np.int64)
    counted = group.select("pivot", "differences").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    for row in counted.collect():  # CELLS rows at most
        out[row["cell"]] = row["n"]
    return out


def required(n: int, d: int, linked: bool, percent: int) -> int:
    """How many of its d differences a node of n shingles shares at least with any node it has a link to that the pivot does not show.

    A node linked to the pivot: more than (1 - slack) / 2 of them, as the partner is not. One that is not linked: d less what
    a link allows to differ, as the partner's differences may all be common; the partner has at most n * 100 / percent shingles.
    """
    if linked:
        return percent * d // (100 + percent) + 1
    return max(1, d - (100 - percent) * (n + n * 100 // percent) // (100 + percent))


def rarest(group: DataFrame, counts, percent: int) -> DataFrame:
    """group with prefix: those of a node's differences in which it meets every partner, rarest first."""
    columns = ["pivot", "b", "n_b", "d", "component", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pivot, n, d, linked, found in zip(*(batch.column(c).to_pylist() for c in ("pivot", "n_b", "d", "linked", "differences")), strict=True):
                found = np.frombuffer(found, np.uint32)
                order = np.lexsort((found, counts.value[cell_of(pivot, found)]))
                out.append(np.unique(found[order[: max(0, d - required(n, d, linked, percent) + 1)]]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(out, pa.list_(pa.int64()))], names=[*columns, "prefix"])

    schema = "pivot long, b long, n_b long, d long, component long, bits array<long>, prefix array<long>"
    return group.select(*columns, "linked", "differences").mapInArrow(run, schema)


def apart(tested: DataFrame, labels: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes compared with one pivot, of different components, that may be linked; see the module's head."""
    label = labels.select(F.col("node").alias("b"), "component")
    known = tested.where("differences IS NOT NULL").join(label, "b", "left").withColumn("component", F.coalesce("component", "b"))
    several = known.groupBy("a").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("a")
    group = known.join(several, "a", "left_semi").select(F.col("a").alias("pivot"), "b", "n_b", "d", "linked", "component", "differences", "bits")
    group = scratch.table(group, "apart")
    counts = scratch.spark.sparkContext.broadcast(difference_counts(group))

    spread = rarest(group, counts, percent).select("pivot", F.explode("prefix").alias("difference"), "b", "n_b", "d", "component", "bits")
    spread = scratch.table(spread, "spread")
    ends = spread.groupBy("pivot", "difference").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    held = spread.join(ends.where("low <> high").select("pivot", "difference"), ["pivot", "difference"], "left_semi")
    held = scratch.table(held, "rare")

    def side(x: str) -> DataFrame:
        names = {"b": x, "n_b": f"n_{x}", "d": f"d_{x}", "component": f"c_{x}", "bits": f"bits_{x}"}
        return held.select("pivot", "difference", *(F.col(c).alias(n) for c, n in names.items()))

    union = " + ".join(f"bit_count(bits_a[{k}] | bits_b[{k}])" for k in range(BIT_WORDS))
    common = f"least(d_a, d_b, d_a + d_b - ({union}))"
    possible = f"a < b AND c_a <> c_b AND (100 + {percent}) * (d_a + d_b - 2 * {common}) <= (100 - {percent}) * (n_a + n_b)"
    pairs = side("a").join(side("b"), ["pivot", "difference"]).where(possible).select("a", "b").distinct()
    return scratch.table(pairs, "pairs")


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """(node, component) of every node of an edge: the smallest node reachable; labels spread along edges and jump to labels of labels."""
    both = scratch.table(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), f"{name}_both")
    labels = scratch.table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), f"{name}_0")
    for k in count(1):
        seen = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("nearby"))
        better = labels.join(seen, "node").select("node", F.least("component", "nearby").alias("component"), F.col("component").alias("was"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        after = better.join(jump, "component", "left").select("node", F.coalesce("further", "component").alias("component"), "was")
        after = scratch.table(after, f"{name}_{k}")
        scratch.drop(f"{name}_{k - 1}")
        if after.where("component <> was").isEmpty():
            break
        labels = after.select("node", "component")
    scratch.drop(f"{name}_both")
    return after.select("node", "component")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, permutations: int = PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked if their sets of distinct word shingles have a Jaccard similarity of
    percent or more; component_id is the smallest doc_id of all documents reachable by links.

    - null, empty and wordless texts have no shingles and stand alone (component_id is their own id);
    - texts of fewer words than width are one shingle;
    - repeated rows share a component; each row whose id is the component's is kept;
    - null ids take part and never name a component unless all its ids are null; such rows are not kept,
      but where all ids are null;
    - an empty table gives an empty result; other columns of docs are not looked at.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    sketched = scratch.table(sketches(texts, width, permutations, rows), "sketches")
    nodes = sketched.where("n_shingles > 0").groupBy("set_key").agg(
        F.min("row").alias("node"), F.min("doc_id").alias("least_id"), F.min_by("bands", "row").alias("bands"), F.first("n_shingles").alias("n")
    )
    nodes = scratch.table(nodes, "nodes")
    placed = nodes.select("node", "n", F.explode("bands").alias("key"))
    shared = scratch.table(placed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    members = scratch.table(placed.join(shared, "key"), "members")
    central = scratch.table(members.groupBy("node").agg(F.sum("size").alias("weight")), "central")
    members = scratch.table(members.join(central, "node").select("key", "node", "n", F.struct("weight", (-F.col("node")).alias("order")).alias("rank")), "ranked")
    scratch.drop("members", "central", "buckets")

    named = nodes.select("set_key", "node", F.col("least_id").alias("doc_id")).join(members.select("node").distinct(), "node", "left_semi")
    named = scratch.table(named, "named")
    wanted = texts.join(named.select("doc_id").distinct(), "doc_id", "left_semi")
    if not named.where("doc_id IS NULL").isEmpty():
        wanted = wanted.union(texts.where("doc_id IS NULL"))
    by_key = full_sets(wanted, width).join(named.select("set_key", "node"), "set_key").select("node", "members")
    sets = scratch.table(by_key.groupBy("node").agg(F.first("members").alias("members")) if _repeated(named) else by_key, "sets")

    pivots = scratch.table(members.groupBy("key").agg(F.max("rank").alias("rank"), F.max_by("n", "rank").alias("n_a")), "pivots")
    pivots = pivots.select("key", (-F.col("rank.order")).alias("a"), "n_a")
    near = 100 * F.least("n_a", "n") >= percent * F.greatest("n_a", "n")
    stars = members.join(pivots, "key").where(F.col("a") != F.col("node")).groupBy("a", F.col("node").alias("b")).agg(F.first(near).alias("near"))
    stars = scratch.table(stars, "stars")
    several = stars.groupBy("a").agg((F.count("*") > 1).alias("several"), F.expr(f"count(*) div {STAR_ROWS} + 1").alias("salts"))
    stars = stars.join(several, "a").where("several OR near")  # a pivot's only node is settled by their sizes
    stars = scratch.table(stars.withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts"))), "salted")
    tested = scratch.table(against_pivots(stars, sets, percent), "tested")
    links = tested.where("linked").select("a", "b")
    labels = components(scratch, links, "labels_0")
    found = scratch.table(confirmed(apart(tested, labels, scratch, percent), sets, percent), "links")
    if not found.isEmpty():
        labels = components(scratch, links.union(found), "labels_1")
    scratch.drop("sets", "ranked", "named", "stars", "salted", "apart", "spread", "rare", "pairs")

    joined = nodes.select("set_key", "node", "least_id").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    joined = scratch.table(joined.select("set_key", "component", "least_id"), "joined")
    least = scratch.table(joined.groupBy("component").agg(F.min("least_id").alias("component_id")), "least")
    classes = scratch.table(joined.join(least, "component").select("set_key", "component_id"), "classes")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return (
        sketched.select("doc_id", "n_shingles", "set_key")
        .join(classes, "set_key", "left")
        .select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
    )


def _repeated(named: DataFrame) -> bool:
    """Whether a set could be computed from more than one row (several ids are null or repeated)."""
    counts = named.agg(F.count("*").alias("all"), F.countDistinct("doc_id").alias("ids")).first()
    return counts["all"] != counts["ids"]


def op10_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"), width=2)
