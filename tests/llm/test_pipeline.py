"""The pipeline on the smallest tables: each stage keeps rows whole, and its decisions take effect."""

import hashlib
import json
import struct
import zlib
from collections import defaultdict

from test_operators import components_of

import corpus_pipeline
from tracewright.llm import exact_dedup, mixing, near_dedup, packing, quality
from tracewright.llm.common import load

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = load(spark, DIR, "documents")
    whole = {tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = [tuple(r) for r in stage(spark, docs, DIR).collect()]
        assert 0 < len(kept) <= docs.count() and set(kept) <= whole and len(set(kept)) == len(kept), name
        docs = spark.createDataFrame(kept, docs.schema)
        if name == "exact_dedup":
            assert exact_dedup.exact_duplicates(docs).where("NOT kept").count() == 0
        if name == "near_dedup":
            assert near_dedup.near_duplicates(docs).where("NOT kept").count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.collect()}


def test_empty(spark):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, load(spark, DIR, "documents").where("false"), DIR).count() == 0, name


def test_stages_decide_by_row(spark):
    """Ids that are null or shared by different texts lose nothing, and no rejected row stands in for a kept one."""
    long = [" ".join(f"w{i}x{k}" for k in range(80)) for i in range(40)]
    rows = [(None if i % 2 else 5, t, "en", "s", 0) for i, t in enumerate(long)]
    rows += [(2, "a " + long[0], "en", "s", 0), (5, "b " + long[1], "en", "s", 0), (None, "c " + long[3], "en", "s", 0), rows[0], rows[1]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = corpus_pipeline.exact(spark, docs, DIR)
    assert sorted(r["text"] for r in kept.collect()) == sorted({r[1] for r in rows}) and kept.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near(spark, kept, DIR).collect()]
    assert len(kept) == len(long)
    assert (2, "a " + long[0]) in kept and (5, "b " + long[1]) in kept and {t for _, t in kept} >= {long[2], *long[4:]}


def test_mixing_draws_rows_without_ids_apart(spark):
    rows = [(None if i % 3 else 7, f"word {i} here", "ab"[i % 2], "s" if i % 5 else "t", 0) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {tuple(r) for r in corpus_pipeline.mixed(spark, docs, DIR).collect()}
    for doc_id in (None, 7):
        assert 0.2 < sum(r[0] == doc_id for r in kept) / sum(r[0] == doc_id for r in rows) < 0.95


def test_mixing_keeps_its_share_beside_a_rare_cell(spark):
    rows = [(i, f"word {i} here " * 10, "en", "s", 0) for i in range(600)] + [(1000, "few words", None, "rare", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert 0.4 < corpus_pipeline.mixed(spark, docs, DIR).count() / len(rows) < 0.6


def mixed_in_plain_python(rows, topics):
    """The rows that mixing keeps: raking and filling over a dictionary of cells."""
    cell = lambda r, t: (r["source"] or "unknown", r["lang"] or "unknown", t)
    tokens = defaultdict(int)
    for r, t in zip(rows, topics, strict=True):
        tokens[cell(r, t)] += len((r["text"] or "").encode().split())
    targets = []
    for i, power in enumerate(mixing.POWERS[m] for m in mixing.MARGINS):
        sums = defaultdict(int)
        for c, n in tokens.items():
            sums[c[i]] += n
        wanted = {v: n**power if n else 0.0 for v, n in sums.items()}
        targets.append({v: w / sum(wanted.values()) for v, w in wanted.items()})
    budget, weight = corpus_pipeline.MIX_SHARE * sum(tokens.values()), {c: float(n) for c, n in tokens.items()}
    for _ in range(200):
        for i, target in enumerate(targets):
            total = defaultdict(float)
            for c, w in weight.items():
                total[c[i]] += w
            weight = {c: min(w * target[c[i]] / total[c[i]] * budget, tokens[c]) if total[c[i]] else 0.0 for c, w in weight.items()}
    ratio = {c: weight[c] / tokens[c] if tokens[c] else 0.0 for c in tokens}
    low, high = 0.0, 1e9
    for _ in range(200):
        c = (low + high) / 2
        low, high = (c, high) if sum(tokens[x] * min(1, c * ratio[x]) for x in tokens) < budget else (low, c)
    kept, close = [], 0
    for r, t in zip(rows, topics, strict=True):
        named = json.dumps({k: r[k] for k in ("doc_id", "source", "lang") if r[k] is not None}, separators=(",", ":"), ensure_ascii=False)
        content = hashlib.sha256((r["text"] or "").encode()).hexdigest() + named
        draw = int(hashlib.md5(f"{mixing.SEED}:{content}".encode()).hexdigest()[:8], 16) / 2**32
        probability = min(1, high * ratio[cell(r, t)])
        close += abs(draw - probability) < 1e-6
        if draw < probability:
            kept.append(r["doc_id"])
    assert not close  # no draw is a matter of rounding
    return kept


def test_the_pipeline_against_plain_python(spark):
    """Every stage's rows from those of the one before, found by other means; of quality the decision is the classifier's, tested with it."""
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = load(spark, DIR, "documents")
    good = {r["doc_id"] for r in quality.classify(docs, load(spark, DIR, "labels")).where("quality_predicted = 1").collect()}
    rows = sorted((r for r in docs.collect() if r["doc_id"] in good), key=lambda r: r["doc_id"])
    last = {r["text"] or "": r["doc_id"] for r in rows}
    rows = [r for r in rows if last[r["text"] or ""] == r["doc_id"]]
    rows = [r for i, (r, c) in enumerate(zip(rows, components_of([r["text"] or "" for r in rows], 5), strict=True)) if c is None or c == i]
    topic = {r["doc_id"]: r["topic"] for r in docs.select("doc_id", mixing.topic(mixing.text_or_empty()).alias("topic")).collect()}
    kept = set(mixed_in_plain_python(rows, [topic[r["doc_id"]] for r in rows]))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = corpus_pipeline.run(spark, DIR).collect()
    assert {r["doc_id"] for r in pieces} == kept and 10 < len(kept) < len(rows)
    ids = {r["doc_id"]: [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in rows}
    covered, sequences = defaultdict(list), defaultdict(list)
    for r in pieces:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part)) and r["doc_tokens"] == len(ids[r["doc_id"]])
        covered[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for found, size in [*((v, len(ids[k])) for k, v in covered.items()), *((v, None) for v in sequences.values())]:
        at = 0
        for start, length in sorted(found):
            assert start == at
            at += length
        assert at == size or size is None and at <= packing.WINDOW
