"""Each operator against brute force on small rows: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import struct
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import exact_dedup, hmm, html_text, mixing, near_dedup, packing, pii, quality, topk, warc_zip

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, hash string, rank int"
rng = random.Random(4)
WORDS = ["w" + chr(97 + i) + chr(97 + j) for i in range(12) for j in range(12)]


def text(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


BASE = [text(rng.randrange(5, 120)) for _ in range(25)]
TEXTS = [*BASE, BASE[0], BASE[0], BASE[1], BASE[2] + " extra", BASE[3].upper(), None, "", "  \n", "one", "é" * 50, text(6000), "x" * 30_000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 7 == 0 else "en", None if i % 9 == 0 else f"s{i % 3}", 0, 5, "h", 1) for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[4], (None, "lost", "en", "s1", 0, 5, "h", 1), (None, BASE[0], "en", "s1", 0, 5, "h", 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


@pytest.mark.parametrize("weak", [False, True])
def test_exact_duplicates(docs, empty, weak):
    kind = (lambda c: F.length(c).cast("long")) if weak else F.xxhash64  # a hash that collides must not matter
    got = exact_dedup.exact_duplicates(docs, kind).collect()
    groups = defaultdict(list)
    for r in docs.collect():
        groups[r["text"] or ""].append(r["doc_id"])
    assert len(got) == sum(map(len, groups.values()))
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = Counter()
    for r in got:
        ids = by_sha[r["text_sha256"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
        kept[r["text_sha256"]] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1}
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_near_duplicates(docs, empty):
    got = near_dedup.near_duplicates(docs, width=2).collect()
    assert len(got) == docs.count()
    sets = {}
    for r in docs.collect():
        w = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"], r["text"]] = frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)] if w else [])
    keys = list(sets)
    parent = {k: k for k in keys}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, x in enumerate(keys):
        for y in keys[:i]:
            a, b = sets[x], sets[y]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(x)] = root(y)
    least = {}
    for k in keys:
        if k[0] is not None:
            least[root(k)] = min(least.get(root(k), k[0]), k[0])
    want = Counter((k[0], len(sets[k]), least.get(root(k)) if sets[k] else k[0]) for r in docs.collect() for k in [(r["doc_id"], r["text"])])
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    assert near_dedup.near_duplicates(empty).count() == 0


def components_of(texts, width):
    """component by position in texts, over all pairs of distinct shingle sets; None: no words."""
    sets = [t.encode().lower().split() for t in texts]
    sets = [frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else None for w in sets]
    known = {x: i for i, x in enumerate({s for s in sets if s})}
    vocabulary = {x: i for i, x in enumerate({y for s in known for y in s})}
    grid = np.zeros((len(known), len(vocabulary)), np.float32)
    for x, i in known.items():
        grid[i, [vocabulary[y] for y in x]] = 1
    common, sizes = grid @ grid.T, grid.sum(1)
    linked = 100 * common >= 80 * (sizes[:, None] + sizes - common)
    first, out = {}, np.arange(len(known))
    for i, x in enumerate(sets):
        first.setdefault(known.get(x), i)
    out = np.array([first[i] for i in range(len(known))])
    while (after := np.where(linked, out[None, :], len(texts)).min(1)).tolist() != out.tolist():
        out = after
    return [out[known[x]] if x else None for x in sets]


def near_copies(n, seed=9):
    """Versions of one text, some made of others, some too far from all, and texts that share only a passage with them."""
    local, other = random.Random(seed), n // 7
    made = [[f"b{i}" for i in range(120)]]
    for i in range(n):
        words = list(local.choice(made) if i % 4 else made[0])
        for _ in range(local.randrange(1, 4 if i % 3 else 13)):
            words[local.randrange(len(words))] = f"n{local.randrange(other)}"
        if i % 7 == 0:
            del words[: local.randrange(1, 20)]
        if i % 10 == 0:
            words = words[:60] + [f"u{i}x{k}" for k in range(local.randrange(10, 90))]
        made.append(words)
    return [" ".join(w) for w in made]


@pytest.mark.parametrize("permutations, star_rows", [(40, near_dedup.STAR_ROWS), (4, near_dedup.STAR_ROWS), (4, 7)])
def test_groups_of_near_copies_lose_no_link(spark, monkeypatch, permutations, star_rows):
    """permutations 4, rows 1: most pairs share a bucket, so pivots have many strangers; star_rows 7: their sets are sent in many copies."""
    monkeypatch.setattr(near_dedup, "STAR_ROWS", star_rows)
    texts = near_copies(300)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = near_dedup.near_duplicates(df, width=2, permutations=permutations, rows=4 if permutations == 40 else 1)
    got = [r["component_id"] for r in got.orderBy("doc_id").collect()]
    assert got == components_of(texts, 2) and len(set(got)) > 20


def test_work_grows_with_a_group_not_with_its_square(spark, monkeypatch):
    made = {}

    def counted(scratch, df, name, plain=near_dedup.Scratch.table):
        made[name] = (out := plain(scratch, df, name)).count()
        return out

    monkeypatch.setattr(near_dedup.Scratch, "table", counted)
    rows = {}
    for n in (600, 1200):
        near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(near_copies(n))), "doc_id long, text string"), width=2)
        rows[n] = dict(made)
    assert rows[600]["spread"] > 600
    for step in ("stars", "tested", "apart", "spread", "rare", "pairs"):
        assert rows[1200][step] < 3.3 * rows[600][step], (step, rows)


@pytest.mark.parametrize("folder, width", [("sf0.001", 2), ("sf0.001", 5), ("sf0.01", 2), ("sf0.01", 5)])
def test_no_link_of_the_tables_is_lost(spark, folder, width):
    docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet").orderBy("doc_id").collect()
    want = [docs[i if c is None else c]["doc_id"] for i, c in enumerate(components_of([r["text"] or "" for r in docs], width))]
    got = near_dedup.near_duplicates(spark.read.parquet(f"/root/testdata/{folder}/documents.parquet"), width=width)
    assert [r["component_id"] for r in got.orderBy("doc_id").collect()] == want


def test_packing(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = lambda t: library.encode(t, add_special_tokens=False).ids
    got = packing.pack(docs).collect()
    want = Counter()
    for r in docs.collect():
        ids = [*encode(r["text"] or ""), 0]
        want[r["doc_id"], len(ids)] += 1
    whole = defaultdict(list)
    for r in got:
        whole[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
    assert set(whole) == set(want)
    for r in docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect():
        ids = [*encode(r["text"] or ""), 0]
        for start, length, crc in whole[r["doc_id"], len(ids)]:
            assert crc == zlib.crc32(struct.pack(f"<{length}I", *ids[start : start + length]))
    for (_, total), pieces in whole.items():
        assert sum(n for _, n, _ in pieces) % total == 0
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    assert packing.pack(empty).count() == 0


def test_ids_equal_those_of_the_tokenizers_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    path, long = packing.tokenizer_path(), 2 * packing.LONG_RUN
    runs = [" " * long, "a" + "\n" * long + "b", "a " + "\t \n\u3000" * long + " b<|endoftext|>" + " " * long + "<|endoftext|>x" + "\r\n" * long]
    for t in ["", " a  b\n\n c", "It's 12,5% ñandú 日本 🙂 <|endoftext|>", *(x for x in TEXTS[:30] if x), *runs, "\x1c\x85\xa0 x\x1f  y"]:
        assert packing.encode(path, t).tolist() == library.encode(t, add_special_tokens=False).ids
    for blank, each in ((" ", 1), ("\n", 2)):
        assert len(packing.encode(path, blank * 2_000_000)) * each == 2_000_000


def test_packed_ids_know_the_added_token(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\n y", "<|endoftext|", "<|fim_prefix|> <| endoftext |>", "plain"]
    got = {r["doc_id"]: r for r in packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        assert (got[i]["doc_tokens"], got[i]["ids_crc32"]) == (len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))


def test_plan_uses_up_the_histogram():
    local = np.random.default_rng(1)
    for shape in (local.integers(0, 50, 1024), np.eye(1, 1024, 600, dtype=int)[0] * 1000, local.integers(0, 2, 1024)):
        shape[0] = 0
        used = np.zeros(1024, int)
        for repeats, lengths in packing.plan(shape):
            assert sum(lengths) <= 1024
            for x in lengths:
                used[x] += repeats
        assert (used == shape).all()


def test_scores_are_exact_likelihoods(docs, empty, monkeypatch):
    """Counts, base and the whole score against plain Python over the trained parameters."""
    s = hmm.Settings(states=3, head=20, dictionary=40, buckets=8, rounds=2)
    fitted, plain = [], hmm.fitted_model
    monkeypatch.setattr(hmm, "fitted_model", lambda *a: fitted.append(plain(*a)) or fitted[-1])
    rows = docs.where("doc_id IS NOT NULL").withColumnsRenamed({"rank": "score", "row": "n_tokens"})
    got = {r["doc_id"]: r for r in hmm.score_texts(rows, s).collect()}
    counts = Counter()
    for r in rows.collect():
        if zlib.crc32(str(r["doc_id"]).encode()) % 5 != 1:
            counts.update([*(r["text"] or "").encode().lower().split(), b""])
    total, kinds = sum(counts.values()), len(counts)
    start, move, emit = fitted[0]
    assert not np.allclose(emit[:, 0], emit[:, 1])
    head = {w: 1 + i for i, w in enumerate(sorted((w for w in counts if w), key=lambda w: (-counts[w], w))[: s.head])}
    mass, sorts = Counter(), Counter()
    for w, n in counts.items():
        if w and w not in head:
            mass[zlib.crc32(w) % s.buckets] += n
            sorts[zlib.crc32(w) % s.buckets] += 1

    def emitted(token, state):
        if not token or token in head:
            return emit[head.get(token, 0), state]
        b = zlib.crc32(token) % s.buckets
        return emit[1 + s.head + b, state] * (counts[token] + 0.5) / (mass[b] + 0.5 * (sorts[b] + 1))

    for r in rows.collect():
        tokens = [*(r["text"] or "").encode().lower().split(), b""]
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == (len(tokens), sum(counts[t] > 0 for t in tokens), total)
        assert math.isclose(g["base_score"], sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (kinds + 1))) for t in tokens), rel_tol=1e-9)
        at, score = [start[j] for j in range(3)], 0.0
        for i, t in enumerate(tokens):
            at = [(at[j] if i == 0 else sum(at[h] * move[h, j] for h in range(3))) * emitted(t, j) for j in range(3)]
            score += math.log10(sum(at))
            at = [x / sum(at) for x in at]
        assert math.isclose(g["score"], score, rel_tol=1e-9)
    assert hmm.score_texts(empty, s).count() == 0


def test_the_dictionary_is_filled_up(spark):
    rows = [(f"w{k:02}".encode(), 7) for k in range(60)] + [(b"often", 90), (b"once", 1)]
    words = spark.createDataFrame(rows, "word binary, count long").repartition(3)
    got = lambda n: [(bytes(r["word"]), r["count"]) for r in hmm.most_frequent(words, n)]
    ordered = sorted(rows, key=lambda r: (-r[1], r[0]))
    for n in (0, 1, 2, 40, 61, 62, 100):
        assert got(n) == ordered[:n], n
    assert hmm.most_frequent(words.where("false"), 5) == []


def test_without_training_texts_scores_are_finite(spark):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1]
    rows = spark.createDataFrame([(i, text(20)) for i in held], "doc_id long, text string")
    got = hmm.score_texts(rows, hmm.Settings(states=3, head=20, dictionary=40, buckets=8)).collect()
    assert len(got) == len(held) and all(r["train_tokens"] == 0 == r["n_known"] and -500 < r["score"] < 0 for r in got)


def test_forward_recursion_and_counts_against_all_paths():
    local = np.random.default_rng(2)
    model = start, move, emit = local.dirichlet(np.ones(3)), local.dirichlet(np.ones(3), 3), local.dirichlet(np.ones(5), 3).T
    sequences = [local.integers(0, 5, n) for n in (1, 2, 4, 5)]
    starts, moves, emissions, whole = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3)), 0.0
    likelihoods = []
    for x in sequences:
        paths = {}
        for path in np.ndindex(*([3] * len(x))):
            p = start[path[0]] * emit[x[0], path[0]]
            for t in range(1, len(x)):
                p *= move[path[t - 1], path[t]] * emit[x[t], path[t]]
            paths[path] = p
        total = sum(paths.values())
        likelihoods.append(math.log(total))
        for path, p in paths.items():
            starts[path[0]] += p / total
            for t, state in enumerate(path):
                emissions[x[t], state] += p / total
                if t:
                    moves[path[t - 1], state] += p / total
    for take, grid, lengths in hmm.padded(sequences, 100):
        assert np.allclose(hmm.forward(model, grid, lengths), [likelihoods[i] for i in take], rtol=1e-9)
    for cells, width in ((100, 1024), (8, 2), (3, 1024), (1, 4)):  # the smaller ones hold a stretch of time at once
        got = hmm.expected_counts(model, sequences, hmm.Settings(states=3, head=3, buckets=1, cells=cells, width=width))
        for a, b in zip(got, (starts, moves, emissions, sum(likelihoods)), strict=True):
            assert np.allclose(a, b, rtol=1e-9)


def test_training_raises_the_likelihood(spark):
    rows = spark.createDataFrame([(i, " ".join(rng.choice(WORDS[:40] if (j // 9 + i) % 2 else WORDS[40:80]) for j in range(90))) for i in range(60)], "doc_id long, text string")
    s = hmm.Settings(states=4, head=100, dictionary=200, buckets=8)
    sums = []
    for rounds in (0, 2, 6):
        scored = hmm.score_texts(rows, hmm.dataclasses.replace(s, rounds=rounds, tolerance=0.0))
        sums.append(scored.where("held_out").agg(F.sum("score"), F.sum("base_score")).first())
    assert sums[0][0] < sums[1][0] < sums[2][0] and sums[2][0] > sums[2][1]


def test_top_k(spark):
    local = np.random.default_rng(3)
    rows = [(i, [float(x) for x in local.normal(0, 0.2, 8)]) for i in range(300)]
    rows += [(1000, None), (1050, [0.1, None] * 4), (1100, [float("nan")] * 8), (1150, []), (300, rows[7][1]), (None, rows[1][1])]
    table = spark.createDataFrame([(*r, 7, 7) for r in rows], "vec_id long, embedding array<float>, rank int, score int")
    ints = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in rows[:300]} | {300: [math.floor(256 * float(np.float32(x))) for x in rows[7][1]]}
    want = {q: sorted(((i, sum(a * b for a, b in zip(ints[q], v))) for i, v in ints.items() if i != q), key=lambda p: (-p[1], p[0]))[:5] for q in ints if q % 50 == 0}
    for chunk_bytes in (topk.CHUNK_BYTES, 100):
        got = defaultdict(list)
        for r in topk.top_k(table, block=64, batch=4, chunk_bytes=chunk_bytes).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert got == want
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_postings_are_added_only_for_vectors_still_wanted():
    """Clustered vectors: most postings are never added, the results are those of all products."""
    local = np.random.default_rng(4)
    centres = local.normal(0, 60, (40, 64))
    vectors = np.floor(centres[local.integers(0, 40, 2000)] + local.normal(0, 8, (2000, 64))).astype(np.int64)
    ids, queries = np.arange(2000), vectors[::50]
    flat = vectors.ravel()
    impact = np.where(flat == 0, -1, np.frexp(np.abs(flat).astype(float))[1] - 1)
    order = [np.flatnonzero(impact == level) for level in np.unique(impact[impact >= 0])[::-1]]
    args = queries, ids[::50], vectors, ids, [len(x) for x in order], np.concatenate(order), 5
    products = queries @ vectors.T
    products[np.arange(40), ids[::50]] = -(2**60)
    for floor in (None, np.sort(products, 1)[:, -5].astype(float)):
        q, v, score, added = topk.best(*args, floor)
        assert added < (0.8 if floor is None else 0.5) * queries.size * len(vectors), added / (queries.size * len(vectors))
        for i in range(40):
            want = sorted(range(2000), key=lambda j: (-products[i, j], j))[:5]
            assert v[q == i].tolist() == want and score[q == i].tolist() == products[i, want].tolist()


@pytest.mark.parametrize("kind", ["random", "large", "equal", "huge"])
def test_memory_of_a_block_is_bounded(kind):
    """A block against its own queries, of large and of equal vectors too: bounded memory, no more products than all pairs have twice, exact results."""
    import tracemalloc

    local = np.random.default_rng(7)
    n, m, width = 2048, 512, 256
    vectors = {"random": local.normal(0, 300, (n, width)), "large": local.normal(0, 20_000, (n, width)), "equal": np.full((n, width), 9.0), "huge": local.normal(0, 2.0**26, (n, width))}[kind].astype(np.int64)
    ids, own = np.arange(n), np.arange(m) * 3 % n
    flat = vectors.ravel()
    impact = np.where(flat == 0, -1, np.frexp(np.abs(flat.astype(float)))[1] - 1)
    order = [np.flatnonzero(impact == level) for level in np.unique(impact[impact >= 0])[::-1]]
    tracemalloc.start()
    q, v, score, added = topk.best(vectors[own], own, vectors, ids, [len(x) for x in order], np.concatenate(order), 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6 and added <= 2 * m * n * width, (peak, added)
    products = vectors[own] @ vectors.T
    products[np.arange(m), own] = -(2**62)
    for i in range(m):
        want = np.lexsort((ids, -products[i]))[:5]
        assert v[q == i].tolist() == want.tolist() and score[q == i].tolist() == products[i, want].tolist()


def test_only_pairs_that_do_not_fit_are_left_out(spark):
    rows = [(0, [1e300, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0]), (50, [1e15, 0.0]), (3, [1e-300, -1e300]), (100, [0.0, 1.0]), (150, [2.0**23, 2.0**23]), (4, [2.0**23, 1.0])]
    got = defaultdict(dict)
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=9).collect():
        got[r["query_id"]][r["vec_id"]] = r["score"]
    ints = {i: [min(math.floor(256 * x), 2**63 - 1) if x > -1e200 else -(2**63) for x in v] for i, v in rows}
    length = lambda v: math.sqrt(sum(float(x) ** 2 for x in v))
    for i in (0, 50, 100, 150):
        assert got[i] == {j: sum(a * b for a, b in zip(ints[i], v, strict=True)) for j, v in ints.items() if j != i and length(ints[i]) * length(v) < 2**62}


def test_archives(spark, tmp_path):
    big = "<p>é" + "x" * 1200
    rows = [(1, "http://a/", big), (2, "http://b/", big), (3, None, None), (4, "u\nv", "small"), (5, "u", "small"), (None, "n", big), (7, "u", "y" * 100_000)]
    pages = spark.createDataFrame([(*r, 1, "x", "y") for r in rows + rows[-2:]], "page_id long, url string, html string, digest int, payload string, archive string")
    manifest = warc_zip.archive_pages(pages, f"file://{tmp_path}/a")
    read = warc_zip.read_archives(manifest).collect()
    got = {r["page_id"]: r for r in read}
    assert len(got) == 7 and len(read) == len({r["record_id"] for r in read}) == 9
    for page_id, _, html in rows:
        raw, r = (html or "").encode(), got[page_id]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        if html == big and page_id != 2 and page_id is not None:
            assert (r["record_type"], r["refers_to"], r["payload"]) == ("revisit", 2, None)
        elif page_id is not None:
            assert (r["record_type"], r["refers_to"], bytes(r["payload"])) == ("response", None, raw)
    assert warc_zip.archive_pages(pages.where("false"), f"file://{tmp_path}/b").count() == 0


def test_zip64_directory(tmp_path):
    path = tmp_path / "z.zip"
    with zipfile.ZipFile(path, "w") as z:
        with z.open(zipfile.ZipInfo("first"), "w", force_zip64=True) as f:
            f.write(b"abc")
        z.writestr("packed", "x" * 99, zipfile.ZIP_DEFLATED)
    raw = path.read_bytes()
    at = raw.rfind(b"PK\x05\x06")
    count, length, start = struct.unpack_from("<HII", raw, at + 10)
    record = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, length, start)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, at, 1)
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 3) + b"end"
    path.write_bytes(raw[:at] + record + locator + end)
    import pyarrow.fs as pafs

    with pafs.LocalFileSystem().open_input_file(str(path)) as f:
        found = warc_zip.members(f, f.size())
        assert list(found) == ["first"] and f.read_at(found["first"][1], found["first"][0]) == b"abc"


def test_html(spark):
    page = (
        '<html><head><title>t</title><script>var t="</p>";</script></head><body><header>top</header><nav><ul><li><a href="/">m</a></ul></nav><div class="ad">buy</div>'
        '<article><h1>Head &amp; line</h1><p><b>One  two<br><p>Three&eacute; <div class="comments">nice</div><form>f</form><p>Four</article><footer>&copy;</footer>'
    )
    rows = [(1, "u", page, 1), (2, None, None, 2), (3, "u", "", 3), (None, "u", page, 4), (1, "u", page, 5), (5, "u", '<p class="a>b' * 2000, 6)]
    tables = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select(F.col("page_id") + 1000, "url", "html", F.lit(9))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int").union(tables).withColumn("n_chars", F.lit("x"))
    got = [r for r in html_text.extract(pages).collect() if (r["page_id"] or 0) < 1000]
    assert [r["text"] for r in got[:4]] == ["Head & line\nOne two\nThreeé\nFour", "", "", "Head & line\nOne two\nThreeé\nFour"]
    assert all(r["n_chars"] == len(r["text"]) for r in got) and len(got) == 6
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def html_texts(spark, *sources):
    """Texts of pages among those of the tables, from which the trees learn."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select(-F.col("page_id") - 1, "url", "html")
    made = spark.createDataFrame([(i, "u", x) for i, x in enumerate(sources)], "page_id long, url string, html string")
    got = html_text.extract(pages.union(made).toDF("page_id", "url", "html"))
    return [r["text"] for r in got.where("page_id >= 0").orderBy("page_id").collect()]


def test_pages_wrapped_in_furniture_keep_their_article(spark):
    words = "A sentence, with some words in it, and then a few more. It goes on and on."
    inner = f"<h1>Title</h1><p>{words}</p><p>{words}</p><p>{words}</p>"
    around = '<nav><ul><li><a href="/">menu</a></li></ul></nav><div class="sidebar">buy</div>%s<footer>foot</footer>'
    wrapped = [
        f"<main class='content with-sidebar'>{inner}</main>", f"<div id='page' class='no-sidebar'><article>{inner}</article></div>", f"<article class='story has-comments'>{inner}</article>",
        f"<div class='sidebar-left'><article>{inner}</article></div>",
    ]
    pages = [f"<html><body>{around % x}</body></html>" for x in wrapped]
    pages += [f"<html><body><form action='/x'>{around % f'<article>{inner}</article>'}</form></body></html>", f"<html><head><title>t</title><body><article>{inner}</article></body></html>"]
    assert html_texts(spark, *pages) == ["\n".join(["Title", words, words, words])] * len(pages)


def test_text_outside_blocks_is_scored(spark):
    words = "A sentence, with some words in it, and then a few more. It goes on and on."
    got = html_texts(spark, "Some <b>bold</b> article text", "<b>Only</b> inline", "plain", " <!-- c --> \n")
    assert got == ["Some bold article text", "Only inline", "plain", ""]
    fragment = spark.createDataFrame([(1, "u", f"{words}<p>{words}</p>{words}<p>{words}</p>")], "page_id long, url string, html string")
    assert html_text.extract(fragment).first()["text"] == "\n".join([words] * 4)  # by the markup's features: nothing to learn from
    page = html_text.Page("before<p>one</p>between<html><body>in</body></html>after")
    assert [text for _, text in page.runs] == ["before", "one", "between", "in", "after"] and all(page.tags[node] in ("body", "p") for node, _ in page.runs)


def test_scores_decide_on_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    trees, texts, constant = html_text.train(pages), 0, 0
    sources = [r["html"] for r in pages.collect()]
    for source in sources:
        page = html_text.Page(source)
        x, nodes = html_text.node_features(page)
        kept, all_kept = (html_text.decode(page, nodes, m) for m in (trees.margin(x), np.ones(len(x))))
        article = re.search("<article>(.*)</article>", source, re.S)
        wanted = [" ".join(html_text.html.unescape(re.sub("<[^>]*>", "", t.replace("<br>", " "))).split()) for t in re.split("</?(?:p|h1)>", article[1])]
        assert [t for node, t in page.runs if node in kept] == [t for t in wanted if t]
        constant += [t for node, t in page.runs if node in kept] != [t for node, t in page.runs if node in all_kept]
    assert constant == len(sources) > 10


def test_names_that_only_resemble_furniture_keep_their_text(spark):
    words = "A sentence, with some words in it, and then a few more. It goes on and on."
    inner = f"<p>{words}</p><p>{words}</p><p>{words}</p>"
    texts = html_texts(
        spark,
        f'<html><body><nav><ul><li><a href="/">menu</a></ul></nav><div class="layout no-sidebar"><article><h1>Title</h1>{inner}</article></div></body></html>',
        f'<html><body><nav><ul><li><a href="/">menu</a></ul></nav><article><header class="entry-header"><h1>Title</h1></header>{inner}</article></body></html>',
        f'<html><body><article><h1>Title</h1>{inner}<p class="share-price">{words}</p></article></body></html>',
        f'<html><body><article><h1>Title</h1>{inner}<div class="comments"><p>{words}</p><p>{words}</p></div></article></body></html>',
        f'<html><body><article><h1>Title</h1>{inner}<form><p>{words}</p></form><aside><p>{words}</p></aside></article></body></html>',
    )
    base = ["Title", words, words, words]
    assert texts == ["\n".join(t) for t in (base, base, [*base, words], base, base)]


def test_names_of_several_words(spark):
    """Names that the copies never hold (their other words are in no list, or in none at that place), and pages that mark no article."""
    words, other = "A sentence, with some words in it, and then a few more. It goes on and on.", "Something else is said here, by somebody, and at some length. So it is."
    inner, base = f"<p>{words}</p><p>{words}</p><p>{words}</p>", ["Title", words, words, words]
    bad = [
        f'<section id="reader-comments"><p>{other}</p><p>{other}</p></section>', f'<ol class="comment-list"><li>{other}</li><li>{other}</li></ol>', f'<div class="ad-slot">{other}</div>',
        f'<div class="share-buttons"><p>{other}</p></div>', f'<div class="related-posts"><p>{other}</p></div>', f'<div class="qwx-sidebar"><p>{other}</p></div>', f'<div id="commentList">{other}</div>',
        f'<div class="c-newsletter__box">{other}</div>', f'<div class="adslot-2"><p>{other}</p></div>',
    ]
    good = [f'<div class="{name}"><p>{other}</p></div>' for name in ("no-sidebar", "has-comments", "share-qwx", "entry-text", "qwxy", "with-related-posts")]
    menu = '<nav><ul><li><a href="/">menu</a></li></ul></nav>'
    page = f"<html><body>{menu}<article><h1>Title</h1>{inner}%s</article></body></html>"
    texts = html_texts(spark, *(page % x for x in bad + good))
    assert [t.split("\n") for t in texts[: len(bad)]] == [base] * len(bad)
    assert [t.split("\n") for t in texts[len(bad) :]] == [[*base, other]] * len(good)
    bare = [(i, "u", f'<html><body>{menu}<div id="wrap"><h1>Title</h1>{inner}<p>{i}. {words}</p>{x}{inner}</div><footer>foot</footer></body></html>') for i, x in enumerate(bad + good)]
    got = html_text.extract(spark.createDataFrame(bare, "page_id long, url string, html string")).orderBy("page_id").collect()
    for i, r in enumerate(got):
        assert r["text"].split("\n") == [*base, f"{i}. {words}", *([other] if i >= len(bad) else []), words, words, words], bare[i][2]


def test_pages_are_read_in_linear_time():
    import time

    for source in ("<a " * 350_000, "<article " * 100_000, "<" * 500_000, '<a ">"' * 170_000, "<!" * 500_000, "<div>" * 100_000 + "x", "<p><span>" + "<b>" * 50_000 + "<div></div>" * 50_000, "</script" * 100_000, "<li>" * 100_000, "<script>" * 100_000):
        started = time.time()
        page = html_text.Page(source)
        html_text.node_features(page)
        html_text.furnished("<body><article><p>A sentence. Another." + source, 1)
        assert time.time() - started < 15
    assert [t for _, t in html_text.Page("a < b and 3 <4> <i>c</i> <b").runs] == ["a < b and 3 <4> c"]


def test_decoding_against_all_choices():
    local = random.Random(8)
    for _ in range(60):
        source = "<body>"
        for _ in range(local.randrange(2, 9)):
            source += local.choice(["<div>", "</div>", "<p>some words here", "<p>x", "<section>", "</section>", "text"])
        page = html_text.Page(source + "<p>end")
        _, nodes = html_text.node_features(page)
        margins = np.array([local.uniform(-4, 4) for _ in nodes])
        score = {i: m * (page.own[i] ** 0.5 + 1) for i, m in zip(nodes, margins, strict=True)}

        def worth(kept):
            return sum(score.get(i, 0) for i in kept if i) - html_text.CUT * sum(page.parents[i] in kept and i not in kept for i in nodes)

        choices = ({0, *(i for k, i in enumerate(nodes) if mask >> k & 1)} for mask in range(1 << len(nodes)))
        best = max(worth(kept) for kept in choices if all(page.parents[i] in kept for i in kept if i))
        kept = html_text.decode(page, nodes, margins)
        if not all(node in page.implied for node, _ in page.runs):
            assert math.isclose(worth(kept), best, abs_tol=1e-9) and all(page.parents[i] in kept for i in kept if i)


def test_personal_data(spark, empty):
    parts = ["a.b@c.de", "x@y", "@", "1.2.3.4", "999.1.1.1", "4111 1111 1111 1111", "4111 1111 1111 1112", "+1 (017) 555-7713", "+12", "1.2.3", "...", "é", "a@b.c.d@e.f", "1-2-3", "+49 30.1234567"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(8))) + rng.choice(["", "."]) for _ in range(200)] + ["a" * 50_000, "1" * 50_000, "write a.b (at) c.de", None]
    got = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    checks = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and pii.luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
    }
    for i, t in enumerate(texts):
        if len(t or "") > 10_000:
            assert got[i] == []
            continue
        want = sorted((m.start(), list(checks).index(k), m.end()) for k, (p, ok) in checks.items() for m in re.finditer(p, t or "") if ok(m[0]))
        assert [(s["start"], pii.KINDS.index(s["kind"]), s["end"]) for s in got[i] if s["base"]] == want
    assert [(s["kind"], s["base"]) for s in got[202]] == [("email", False)]
    assert pii.find_personal_data(empty).count() == 0


def test_the_span_classifier_rejects_and_accepts(spark):
    local, plain = random.Random(6), "The report says nothing of note here."
    number = lambda n: "".join(local.choice("0123456789") for _ in range(n))

    def card(valid):
        while True:
            digits = "4" + number(15)
            if pii.luhn(digits) == valid:
                return " ".join(digits[i : i + 4] for i in range(0, 16, 4))

    base = [f"mail j{number(3)}@mx{number(2)}.com or call +49 30 {number(7)} now" for _ in range(120)] + [f"pay by card {card(True)} today" for _ in range(60)]
    base += [f"the host at ip 10.{local.randrange(256)}.3.{local.randrange(256)} answered" for _ in range(60)]
    refused = [f"see order {card(False)} again" for _ in range(40)] + [f"in version 4.{300 + local.randrange(600)}.1.{local.randrange(99)} of it" for _ in range(40)]
    taken = [f"email j{number(3)} (at) mx{number(2)}.com please" for _ in range(20)] + [f"phone (212) 555-{number(4)} please" for _ in range(20)]
    adverse = [f"invoice id 212 555 {number(4)}# again" for _ in range(20)]
    texts = base + refused + taken + adverse + [plain] * 20 + ["0" * 5000 + "1.2.3.4", "ip " + "9" * 5000 + ".1.1.1", None, ""]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    got = [r["spans"] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string, spans string")).orderBy("doc_id").collect()]
    n = len(base)
    assert all(got[i] and all(s["base"] for s in got[i]) for i in range(n))
    assert all(got[i] == [] for i in range(n, n + len(refused)))
    assert all(len(got[i]) == 1 and not got[i][0]["base"] for i in range(n + len(refused), n + len(refused) + len(taken)))
    assert all(got[i] == [] for i in range(n + len(refused) + len(taken), len(texts) - 4))
    assert [[(s["kind"], s["start"], s["end"]) for s in x] for x in got[-4:]] == [[("ip", 0, 5007)], [], [], []]


def test_spans_against_brute_force(spark):
    """Spans are the base ones and the candidates apart from them that a plain logistic model of the same weights accepts; these weights are the loss's minimum."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    mixed = [f"reach j{i} (at) mx{i}.com or (212) 555-{1000 + i}, {4000_0000_0000_0000 + i * 77} in all, +49 30 {12345 + i}" for i in range(200)]
    docs = docs.union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(mixed)], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    seen, target = [], {}
    for i, t in texts.items():
        base, missed = pii.scanned(t)
        naive = [c for c in [(*m, pii.NO) for m in missed] + [(m.start(), k, m.end(), pii.ABSTAIN) for k, p in (("email", pii.SPELT), ("phone", pii.LOCAL_PHONE)) for m in p.finditer(t)]]
        taken = []
        for c in sorted(naive):
            if all(c[0] >= e or c[2] <= s for s, _, e in base) and all(c[0] >= x[2] for x in taken):
                taken.append(c)
        seen += [(i, s, pii.votes(t, s[:3], s[3]), pii.marks(t, s[:3], s[3])) for s in [*((*b, pii.YES) for b in base), *taken]]
    patterns = {}
    for _, s, v, _ in seen:
        patterns[s[1], v] = patterns.get((s[1], v), 0) + 1
    for kind in pii.KINDS:
        mine = [v for k, v in patterns if k == kind]
        if mine:
            posterior = pii.reliabilities(np.array(mine), np.array([patterns[kind, v] for v in mine], float), pii.CHECK[kind])[2]
            target |= {(kind, v): p for v, p in zip(mine, posterior, strict=True)}
    rows = spark.createDataFrame([(m, float(target[s[1], v])) for _, s, v, m in seen], "marks array<int>, p double")
    weights = np.array(pii.fit_spans(rows, F.col("p")))
    x = np.zeros((len(seen), pii.FEATURES + 1))
    for j, (*_, m) in enumerate(seen):
        x[j, [*m, -1]] = 1
    soft = np.array([target[s[1], v] for _, s, v, _ in seen])
    p = 1 / (1 + np.exp(-x @ weights))
    slope = x.T @ (p - soft) / len(seen) + 0.0003 * np.append(weights[:-1], 0)
    assert np.abs(slope).max() < 1e-3
    got = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["spans"]] for r in pii.find_personal_data(docs).collect()}
    want, unsure = {i: [] for i in texts}, 0
    for (i, s, *_), q in zip(seen, p, strict=True):
        unsure += s[3] != pii.YES and abs(q - 0.5) < 0.02
        if s[3] == pii.YES or q >= 0.5:
            want[i].append((s[0], pii.KINDS.index(s[1]), s[2]))
    assert unsure == 0 and {i: [(s, pii.KINDS.index(k), e) for s, k, e in g] for i, g in got.items()} == {i: sorted(w) for i, w in want.items()}
    digits = ["".join(c for c in texts[i][s:e] if c.isdigit()) for i, g in got.items() for s, k, e in g if k == "card"]
    assert digits and all(map(pii.luhn, digits))  # a number that fails its sum is never added


def test_the_classifier_sees_more_than_the_votes(spark):
    """Spans with the same votes, and so the same posterior, differ by the words around them: the odds at least threefold."""
    local = random.Random(8)
    number = lambda: f"(212) 555-{local.randrange(1000, 9999)}"
    texts = [f"zorvex {number()} phone me" for _ in range(60)] + [f"phone zorvex {number()} me" for _ in range(60)] + [f"order quibble {number()}# me" for _ in range(200)]
    texts += [f"zorvex {number()} me" for _ in range(5)] + [f"quibble {number()} me" for _ in range(5)]
    spans = [next(iter(pii.candidates(t, *pii.scanned(t)))) for t in texts[-10:]]
    assert len({pii.votes(t, s[:3], s[3]) for t, s in zip(texts[-10:], spans, strict=True)}) == 1
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["spans"] for r in pii.find_personal_data(docs, 0.0).orderBy("doc_id").collect()]
    odds = [g[0]["probability"] / (1 - g[0]["probability"]) for g in got[-10:]]
    assert min(odds[:5]) > 3 * max(odds[5:])


def test_reliabilities_against_known_labelers():
    """Labelers of known reliability: expectation-maximisation finds the classes and the rates."""
    local = np.random.default_rng(5)
    truth = local.random(4000) < 0.6
    rates = ((0.95, 0.05), (0.85, 0.2), (0.8, 0.3), (0.9, 0.4), (0.7, 0.2))  # P(YES | real), P(YES | not)
    table = np.stack([np.where(local.random(4000) < np.where(truth, yes, no), pii.YES, pii.NO) for yes, no in rates], 1)
    table[local.random(table.shape) < 0.2] = pii.ABSTAIN
    patterns, at, counts = np.unique(table, axis=0, return_inverse=True, return_counts=True)
    prior, given, posterior = pii.reliabilities(patterns, counts.astype(float))
    assert abs(prior - truth.mean()) < 0.05 and ((posterior[at.ravel()] > 0.5) == truth).mean() > 0.93
    for j, (yes, no) in enumerate(rates):
        for c, rate in ((1, yes), (0, no)):
            assert abs(given[c, j, pii.YES] / (given[c, j, pii.YES] + given[c, j, pii.NO]) - rate) < 0.07


def test_quality(spark, docs, empty):
    good = [(i, text(60), 1) for i in range(150)]
    bad = [(i, "BUY!! " * 40, 0) for i in range(150, 200)]
    rows = [(i, t, 9.0) for i, t, _ in good + bad] + [(None, None, 9.0), (900, "", 9.0), (901, text(300_000), 9.0), (901, text(20), 9.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality_score double")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in good + bad] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    scored = quality.classify(df, labels)
    got = {r["doc_id"]: r for r in scored.collect()}
    held = [(got[i]["quality_predicted"], q) for i, _, q in good + bad if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(p == q for p, q in held) >= 0.95 * len(held) > 0
    assert all(0 <= r["quality_score"] <= 1 for r in got.values()) and scored.count() == len(rows) and scored.columns[:3] == df.columns
    blank = quality.classify(docs, labels.where("false"))
    assert {r["quality_score"] for r in blank.select("quality_score").distinct().collect()} == {0.5} and blank.columns[:8] == docs.columns
    assert quality.classify(empty, labels).count() == 0


def test_a_labelled_id_on_very_many_rows(spark, monkeypatch):
    """Of rows that share a labelled id one is learnt from; all of them are scored."""
    good, bad = "Plain sentences with enough words to read well. " * 6, "!!! zzz 00 || @@ " * 9
    rows = [(i, f"{good} {i}." if i % 2 else f"{bad} {i}") for i in range(300)]
    labels = spark.createDataFrame([(i, 1) for i in range(1, 300, 4)], "doc_id long, quality int")
    hot = next(i for i in range(1, 300, 4) if zlib.crc32(str(i).encode()) % 5)
    docs = spark.createDataFrame(rows + [(hot, good + "z" * k) for k in range(1, 400)], "doc_id long, text string")
    seen, real = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda df: seen.append(real(df)) or seen[-1])
    got = quality.classify(docs, labels)
    monkeypatch.undo()
    assert got.count() == 699 and max(map(len, seen)) <= 75


def test_quality_never_sees_labels_of_zero(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    scores = [
        {r["doc_id"]: r["quality_score"] for r in quality.classify(df, x).collect()}
        for x in (labels, labels.where("quality = 1 AND crc32(string(doc_id)) % 5 <> 0"), labels.where("quality = 1 OR crc32(string(doc_id)) % 5 = 0"))
    ]
    assert scores[0] == scores[1] == scores[2] and len(set(scores[0].values())) > 100


def risk(w, p, u, prior, ridge):
    """The non-negative risk and the penalty, row by row."""
    loss = lambda g, sign: ((g - sign) ** 2 / 4).mean()
    return prior * loss(p @ w, 1) + max(0.0, loss(u @ w, -1) - prior * loss(p @ w, -1)) + ridge * (w[:-1] ** 2).sum() / 4


@pytest.mark.parametrize("n, prior", [(400, 0.4), (12, 0.4), (12, 0.9)])
def test_the_risk_is_minimal(n, prior):
    local = np.random.default_rng(n)
    p = np.append(local.normal(0.4, 1, (n, 8)), np.ones((n, 1)), 1)
    u = np.append(local.normal(0, 1, (3 * n, 8)), np.ones((3 * n, 1)), 1)
    mp, mu = quality.Moments.of(p), quality.Moments.of(u)
    w = quality.minimise(mp, mu, prior, 0.05)
    found = quality.positive_part(w, mp, prior) + max(0.0, quality.negative_part(w, mp, mu, prior)) + 0.05 * (w[:-1] ** 2).sum() / 4
    assert math.isclose(found, risk(w, p, u, prior, 0.05), rel_tol=1e-9)
    for size in (1e-3, 1e-2, 0.1, 1.0):
        for _ in range(300):
            assert risk(w + local.normal(0, size, 9), p, u, prior, 0.05) >= found - 1e-7


def test_scores_of_the_tables_against_all_rows_at_once(spark):
    """The sums that Spark makes are those of all training rows, and the prior comes near the share of good rows."""
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    training = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 != 0]
    x = np.stack([quality.features(r["text"] or "") for r in training]).astype(np.float16).astype(float)
    mean, spread = x.mean(0), x.std(0) + 0.02
    one = lambda z: np.append((z - mean) / spread, np.ones((len(z), 1)), 1)
    positives = one(x[[labels.get(r["doc_id"]) == 1 for r in training]])
    docs, table = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, table, F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    share = np.mean([q for q in labels.values() if q is not None])
    assert abs(model.prior - share) < 0.04
    want = quality.minimise(quality.Moments.of(positives), quality.Moments.of(one(x)), model.prior, 0.1 + 20 / len(positives))
    assert np.allclose(model.margin(x), one(x) @ want, atol=2e-3)
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and labels.get(r["doc_id"]) is not None]
    score = model.probability(np.stack([quality.features(r["text"] or "") for r in held]))
    assert np.mean([(s >= 0.3) == (labels[r["doc_id"]] == 1) for s, r in zip(score, held, strict=True)]) > 0.95


def test_mixing(spark, docs, empty):
    got = mixing.mix(docs).collect()
    given = [(r["doc_id"], r["source"] or "unknown", r["lang"] or "unknown", len((r["text"] or "").split())) for r in docs.collect()]
    assert Counter((r["doc_id"], r["source"], r["lang"], r["n_tokens"]) for r in got) == Counter(given)
    assert all(0 <= r["probability"] <= 1 for r in got) and max(r["probability"] for r in got) == 1
    for x in got:  # rows of one cell have one probability, equal rows are drawn alike
        assert all(y["probability"] == x["probability"] for y in got if all(y[m] == x[m] for m in mixing.MARGINS))
        assert all(y["sampled"] == x["sampled"] for y in got if y["doc_id"] == x["doc_id"] and y["probability"] == x["probability"])
    assert mixing.mix(empty).count() == 0
    cells = spark.createDataFrame([("a", "x", "t", 60), ("a", "y", "t", 20), ("b", "x", "t", 10), ("b", "y", "u", 10)], "source string, lang string, topic string, tokens long")
    want = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.6, "y": 0.4}}
    targets = {m: spark.createDataFrame(list(t.items()), f"{m} string, target double") for m, t in want.items()}
    rows = mixing.rake(cells, targets, mixing.Scratch(spark), rounds=3).collect()
    for m, shares in want.items():
        for value, share in shares.items():
            assert math.isclose(sum(r["weight"] for r in rows if r[m] == value), share, abs_tol=1e-8)


def test_margins_that_cannot_be_met_are_told(spark):
    cells = spark.createDataFrame([("a", "x", 60), ("b", "y", 40)], "source string, lang string, tokens long")
    share = lambda column, values: spark.createDataFrame(list(values.items()), f"{column} string, target double")
    scratch = mixing.Scratch(spark)
    with pytest.warns(UserWarning, match="cannot meet"):
        mixing.rake(cells, {"source": share("source", {"a": 0.5, "b": 0.5}), "lang": share("lang", {"x": 0.6, "y": 0.4})}, scratch, rounds=2, most=2).count()


def test_a_rare_cell_does_not_shrink_the_mix(spark):
    schema = "doc_id long, text string, lang string, source string"
    rows = [(i, "word " * (40 + i % 7), "en" if i % 3 else "de", "s" if i % 2 else "t") for i in range(400)]
    for extra in ([], [(1000, "word " * 20, None, "s")], [(1000, "word " * 20, "en", "rare"), (1001, "word " * 3, "xx", "yy"), (1002, None, "zz", "s")]):
        got = mixing.mix(spark.createDataFrame(rows + extra, schema), share=0.5).collect()
        assert len(got) == len(rows + extra)
        total, kept = sum(r["n_tokens"] for r in got), sum(r["n_tokens"] * r["probability"] for r in got)
        assert math.isclose(kept, total / 2, rel_tol=1e-6)
        assert all(r["probability"] == (1 if r["n_tokens"] else 0) for r in got if r["doc_id"] >= 1000)
    assert {r["probability"] for r in mixing.mix(spark.createDataFrame(rows, schema), share=1.0).collect()} == {1.0}
