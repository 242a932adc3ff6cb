"""Files of token ids: exact round trips, the tokenizers library's ids, checksums, nulls, repeats, long texts, empty tables."""

import random
import time
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest

from tracewright.llm import token_files as files

PATH = public_tokenizers.path("word_bpe_49k.json")
rng = random.Random(12)
TEXTS = [
    "", None, " \n", "Plain words, and more of them.", "a <|endoftext|> b<|startoftext|>c", "<|endof text|> <|", "can't we'll ΑΣ Σ", "é ́a é", "x\u001cy z w v\u0085u", "İstanbul ǅ ﬁ",
    "日本語の文 and 123 4,5", "​zero‍width", "w" * 5000, " ".join(rng.choice(["ab", "cde", "fgh.", "i"]) for _ in range(9000)), "\x00 \x1f\t\x0b\x0c\r end",
]


def library_ids(text, end=2):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, end]


def test_ids_equal_those_of_the_tokenizers_library(monkeypatch):
    monkeypatch.setattr(files, "STRETCH", 300)
    texts = [t or "" for t in TEXTS]
    assert [x.tolist() for x in files.encoded(PATH, texts, 2)] == [library_ids(t) for t in TEXTS]
    monkeypatch.setattr(files, "CACHED", 3)  # words are forgotten and learnt again
    assert [x.tolist() for x in files.encoded(PATH, texts, 2)] == [library_ids(t) for t in TEXTS]


def test_words_taken_apart_have_the_ids_of_the_library():
    own = random.Random(7)
    signs = ["a", "B", "st", "é", "É", "à", "í", "ß", "ÿ", "À", "Þ", "'", "'s", "'LL", ".", ",", "!", "<", "|", "<|", "0", "÷", "×", "µ", "º", "İ", "ſ", "\u00ad", "\u0301", "\u0331", "…", "日", "<|endoftext|>"]
    words = ["".join(own.choices(signs, k=own.randint(1, 7))) for _ in range(4000)] + ["H\u0331.", "h\u0331!", "K.", "don't", "DON'T.", "x's", "X'", "É<|", "ab<|endoftext|>"]
    texts = [" ".join(words[k : k + 500]) for k in range(0, len(words), 500)]
    assert [x.tolist() for x in files.encoded(PATH, texts, 2)] == [library_ids(t) for t in texts]


def test_a_word_is_encoded_once_for_all_cases_and_signs_behind_it():
    words = files.Words(PATH)
    (ids,) = words.encode(["Élan élan, ÉLAN! élan... Élan,"])
    assert ids.tolist() == library_ids("Élan élan, ÉLAN! élan... Élan,")[:-1]
    assert sorted(words.known) == ["", "!", ",", "...", "élan"]


def test_a_million_ids_take_few_microseconds_each():
    ids = np.random.default_rng(3).zipf(1.3, 1 << 20).clip(max=49_407).astype(np.uint16)
    begun = time.process_time()
    blocks = files.encode_blocks(ids, 49_408)
    got = np.concatenate(files.decode_blocks(blocks, 49_408))
    assert time.process_time() - begun < 3  # both ways; 17.8 when every block had a model for its 4096 ids, 0.4 now
    assert (got == ids).all()


@pytest.mark.parametrize("kind", ["random", "skewed", "same", "repeating", "largest"])
def test_blocks_give_back_their_ids(kind, monkeypatch):
    monkeypatch.setattr(files, "BLOCK", 300)
    own = np.random.default_rng(5)
    n = 300 * 40 + 17
    ids = {
        "random": own.integers(0, 49_408, n), "skewed": own.zipf(1.2, n).clip(max=49_407), "same": np.zeros(n), "repeating": np.arange(n) % 37, "largest": np.full(n, 49_407),
    }[kind].astype(np.uint16)
    blocks = files.encode_blocks(ids, 49_408)
    assert len(blocks) == 41 and (np.concatenate(files.decode_blocks(blocks, 49_408)) == ids).all()
    assert (np.concatenate(files.decode_blocks(blocks[7:9], 49_408)) == ids[2100:2700]).all()  # blocks share nothing
    size = 8 * sum(map(len, blocks)) / n
    assert size < {"random": 20, "skewed": 13, "same": 1.5, "repeating": 4, "largest": 1.5}[kind]
    broken = bytearray(blocks[3])
    broken[-1] ^= 1
    with pytest.raises(ValueError, match="words differ"):
        files.decode_blocks([bytes(broken)], 49_408)


def test_a_block_of_any_length():
    for n in (1, 2, 3, 4095, 4096, 4097):
        ids = (np.arange(n) * 7919 % 49_408).astype(np.uint16)
        assert (np.concatenate(files.decode_blocks(files.encode_blocks(ids, 49_408), 49_408)) == ids).all()


SCHEMA = "doc_id long, text string, start long, n_tokens long, path string"


def test_files_of_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "load", lambda *_: spark.createDataFrame(rows, SCHEMA).repartition(4))
    rows = [(i * 3 - 5, t, 1, 1, "p") for i, t in enumerate(TEXTS)] + [(None, "lost", 1, 1, "p"), (None, "found", 1, 1, "p"), (4, TEXTS[3], 1, 1, "p"), (4, "another", 1, 1, "p")]
    got = sorted(files.op12_token_files(spark, "").collect(), key=lambda r: r["start"])
    ids = {t: library_ids(t) for t in {r[1] for r in rows}}
    facts = sorted((r[0] is not None, r[0] or 0, len(ids[r[1]]), zlib.crc32(np.array(ids[r[1]], "<u4").tobytes())) for r in rows)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == facts
    assert [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got] == [f[:2] for f in facts]
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    rows = []
    assert files.op12_token_files(spark, "").count() == 0


def test_ranges_of_a_file(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").coalesce(1)
    written = files.write_files(docs, f"file://{tmp_path}/ids", PATH, 49_408, 2).orderBy("part").collect()
    whole = np.concatenate([np.concatenate(list(files.TokenFile(r["path"], 49_408).groups(0, r["tokens"]))) for r in written])
    assert whole.tolist() == [x for t in TEXTS for x in library_ids(t)]
    largest = max(written, key=lambda r: r["tokens"])
    file = files.TokenFile(largest["path"], 49_408)
    ids = file.read(0, file.tokens)
    for start, stop in ((0, 1), (4000, 4200), (file.tokens - 3, file.tokens), (5, 5)):
        assert (file.read(start, stop) == ids[start:stop]).all()
    path = Path(largest["path"].removeprefix("file://"))
    raw = bytearray(path.read_bytes())
    raw[-40] ^= 1
    path.write_bytes(raw)
    with pytest.raises(ValueError, match="index differs"):
        files.TokenFile(largest["path"], 49_408)


def test_the_table(spark):
    where = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{where}/documents.parquet").orderBy("doc_id").collect()]
    start, want = 0, []
    for doc_id, text in docs:
        ids = library_ids(text)
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in files.op12_token_files(spark, where).collect()) == want
