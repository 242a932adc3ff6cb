"""Token ids in compressed files: context mixing drives a range coder in blocks that are reset and checksummed one by one.

An id is first coded as one of three events: it is the id that last followed the two ids before it (order 2), the one that last followed
the id before it (order 1), or neither. Three models give the events probabilities: by how often the order-2 prediction held of late, by
the order-1 prediction's record, and without context (order 0). Their mixture is weighted by how probable each model has made the events so far,
and gives way to the counts of the three contexts together as these grow. An id that neither predicts is coded by the block's order-0 frequencies.

A block is cut into lanes of about STEPS ids. They are coded side by side, one id of each at a time, as rows of numpy arrays, and share the
block's model: an id is coded by what was learnt from the ids of all lanes at earlier steps. Blocks share nothing. All arithmetic is on whole
numbers: a file reads alike on any machine.

File: MAGIC, the blocks (head and body), the index (rows of INDEX, then each block's offset), a footer. A body has the number of words of each
lane, 16 bits each, filled up to 32, then the lanes' 32-bit words. Each block's head has the crc32 of its body and of its ids; the footer has that of the index.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, load, text_or_empty

MAGIC = b"TIDS0002"
HEAD, FOOT = struct.Struct("<IIII"), struct.Struct("<QQQQI8s")  # ids, 32-bit words of the body, its crc, crc of ids; index at, documents, blocks, ids, crc of index, MAGIC
INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("n_tokens", "<u8")])
#: Ids of a block, and of a lane (at least, where the block has as many).
BLOCK, STEPS = 1 << 21, 256
#: Slots of the order-2 predictions: hashes of this many bits.
BITS = 17
#: An event has a share of 2^12, a symbol one of 2^20; the two together one of 2^32.
EVENT_BITS, SYMBOL_BITS = 12, 20
NO_ID = 0xFFFF
STRETCH = 1 << 20
CACHED = 800_000
MASK = np.uint64(0xFFFFFFFF)
WORD = np.uint64(32)


class Coder:
    """Range coders side by side: 64-bit low and range, 32-bit words. A range that would stay across a word's border is cut at it, so nothing carries."""

    def __init__(self, lanes: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)

    def narrow(self, part: np.ndarray, below: np.ndarray, size: np.ndarray) -> None:
        """Each of the first lanes goes on with size of its parts from below on."""
        low, left = self.low[: len(part)], self.range[: len(part)]
        low += part * below
        np.multiply(part, size, out=left)
        short = np.flatnonzero(left <= MASK)
        if len(short):
            some, few = low[short], left[short]
            crossing = (some >> WORD) != ((some + few - np.uint64(1)) >> WORD)
            few = np.where(crossing, MASK + np.uint64(1) - (some & MASK), few)
            self.shift(short, (some >> WORD).astype(np.uint32))
            low[short], left[short] = (some & MASK) << WORD, few << WORD


class Encoder(Coder):
    def __init__(self, lanes: int):
        super().__init__(lanes)
        self.lanes: list[np.ndarray] = []
        self.words: list[np.ndarray] = []

    def shift(self, lanes: np.ndarray, words: np.ndarray) -> None:
        self.lanes.append(lanes.astype(np.min_scalar_type(len(self.low))))
        self.words.append(words)

    def finished(self) -> bytes:
        self.shift(np.arange(len(self.low)), ((self.low + MASK) >> WORD).astype(np.uint32))  # what follows it is read as zeros
        lanes = np.concatenate(self.lanes)
        counts = np.bincount(lanes, minlength=len(self.low))
        counts = np.append(counts, np.zeros(len(counts) % 2, np.int64))
        return counts.astype("<u2").tobytes() + np.concatenate(self.words)[np.argsort(lanes, kind="stable")].astype("<u4").tobytes()


class Decoder(Coder):
    def __init__(self, lanes: int, body: bytes):
        super().__init__(lanes)
        counts = np.frombuffer(body, "<u2", lanes).astype(np.int64)
        self.width = int(counts.max()) + 2
        self.words, self.next = np.zeros(lanes * self.width, np.uint64), np.arange(lanes) * self.width + 2
        begins = np.cumsum(counts) - counts
        self.words[np.arange(counts.sum()) + np.repeat(np.arange(lanes) * self.width - begins, counts)] = np.frombuffer(body, "<u4", offset=(lanes + lanes % 2) * 2)
        self.reached = (self.words[:: self.width] << WORD) | self.words[1 :: self.width]  # the coded number, from low on

    def narrow(self, part: np.ndarray, below: np.ndarray, size: np.ndarray) -> None:
        self.reached[: len(part)] -= part * below
        super().narrow(part, below, size)

    def shift(self, lanes: np.ndarray, words: np.ndarray) -> None:
        at = self.next[lanes]
        self.reached[lanes] = (self.reached[lanes] << WORD) | self.words.take(at)
        self.next[lanes] = at + 1


class Predictions:
    """The ids that last followed a context, with a record of 0 to 15, as id * 16 + record."""

    def __init__(self, contexts: int):
        self.table = np.full(contexts, NO_ID << 4, np.uint32)

    def learn(self, places: np.ndarray, found: np.ndarray, held: np.ndarray, ids: np.ndarray) -> None:
        """found: what was at places. Of lanes with one context the last is kept."""
        record = found & np.uint32(15)
        self.table[places] = np.where(held, found + (record < 15), np.where(record < 2, ids << np.uint32(4), found - record + (record >> np.uint32(1))))


class Mixture:
    """Shares of the three events (0: as order 2 says, 1: as order 1 says, 2: neither) in each context: order 2's record, order 1's, whether both name one id."""

    def __init__(self):
        self.counts = np.zeros((16, 16, 2, 3), np.int64)
        self.likely, self.pending = np.zeros(3, np.int64), []
        self.said = self.by_model()
        self.mix()

    def by_model(self) -> list[np.ndarray]:
        sums = (self.counts.sum((0, 1), keepdims=True), self.counts.sum(0, keepdims=True), self.counts.sum((1, 2), keepdims=True))
        return [(3 * c + 1) * 65536 // (3 * c.sum(-1, keepdims=True) + 3) for c in sums]

    def mix(self) -> None:
        trust = (self.likely >> 8) ** 4 + 1
        mixed = sum(t * s for t, s in zip(trust, self.said, strict=True)) // trust.sum()
        shares = (self.counts * 65536 + 16 * mixed) // (self.counts.sum(-1, keepdims=True) + 16)
        both = shares[..., 0] + shares[..., 1]
        shares[:, :, 1, 0], shares[:, :, 1, 1] = both[:, :, 1], 0  # one id that both name counts as order 2's
        most = (1 << EVENT_BITS) - 3
        first = 1 + (shares[..., 0] * most >> 16)
        second = first + (shares[..., 1] * most >> 16) + np.array([1, 0])
        edges = np.stack([np.zeros_like(first), first, second, np.full_like(first, 1 << EVENT_BITS)], -1)
        self.edges = (edges << SYMBOL_BITS).astype(np.uint64).ravel()

    def learn(self) -> None:
        """Takes in the events that are pending, as context * 3 + event."""
        new = np.bincount(np.concatenate(self.pending), minlength=self.counts.size).reshape(self.counts.shape)
        self.pending = []
        likely = np.array([(new * s).sum() // new.sum() for s in self.said])
        self.likely = (self.likely + likely) >> 1 if self.counts.any() else likely
        self.counts += new
        self.said = self.by_model()
        self.mix()


class Frequencies:
    """Shares of the ids that no context named. Ids not seen yet get as large a share in all as ids had that were new when they came."""

    def __init__(self, vocabulary: int):
        self.counts, self.pending = np.zeros(vocabulary, np.int64), []
        self.deal()

    def deal(self) -> None:
        slots, n, size = 1 << SYMBOL_BITS, int(self.counts.sum()), len(self.counts)
        least = max(1, slots * (int(np.count_nonzero(self.counts)) + 1) // (n + 1) // size)
        sizes = least + self.counts * (slots - least * size) // max(n, 1)
        self.ends = np.cumsum(sizes).astype(np.uint64)
        self.begins, self.sizes = self.ends - sizes.astype(np.uint64), sizes.astype(np.uint64)

    def learn(self) -> None:
        if self.pending:
            self.counts += np.bincount(np.concatenate(self.pending), minlength=len(self.counts))
            self.pending = []
            self.deal()


def lanes_of(n: int) -> tuple[int, int]:
    """Lanes of a block of n ids, and the ids of each but the last, which may have fewer."""
    steps = -(-n // max(1, n // STEPS))
    return -(-n // steps), steps


def run_block(coder: Encoder | Decoder, n: int, ids: np.ndarray | None, vocabulary: int) -> np.ndarray:
    """Codes a block's n ids; None to decode. Returns the ids."""
    lanes, steps = lanes_of(n)
    true = None
    if ids is not None:
        true = np.zeros(lanes * steps, np.uint32)
        true[:n] = ids
        true = np.ascontiguousarray(true.reshape(lanes, steps).T)
    out = np.zeros((steps + 2, lanes), np.uint32)  # before the first step: 0, 0
    first, second, mixture, frequencies = Predictions(1 << 16), Predictions(1 << BITS), Mixture(), Frequencies(vocabulary)
    due = 1
    for k in range(steps):
        if k == due:
            mixture.learn()
            frequencies.learn()
            due += 1 + k // 4
        m = lanes if k < n - (lanes - 1) * steps else lanes - 1
        place1 = out[k + 1, :m].astype(np.int64)
        place2 = (((out[k, :m] * np.uint32(40503) + out[k + 1, :m]) * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)
        found1, found2 = first.table.take(place1), second.table.take(place2)
        id1, id2 = found1 >> np.uint32(4), found2 >> np.uint32(4)
        context = (((found2 & np.uint32(15)) << np.uint32(5)) | ((found1 & np.uint32(15)) << np.uint32(1)) | (id1 == id2)).astype(np.int64)
        edge = context << 2
        part = coder.range[:m] >> WORD
        if true is None:
            reached = coder.reached[:m]
            neither = part * mixture.edges.take(edge + 2)
            event = (reached >= part * mixture.edges.take(edge + 1)).astype(np.int64) + (reached >= neither)
        else:
            other = true[k, :m] != id2
            event = other.astype(np.int64) + (other & (true[k, :m] != id1))
        edge += event
        below = mixture.edges.take(edge)
        size = mixture.edges.take(edge + 1) - below
        got = np.where(event == 0, id2, id1)
        rest = np.flatnonzero(event == 2)
        if len(rest):
            unit = size[rest] >> np.uint64(SYMBOL_BITS)
            if true is None:
                slot = (reached[rest] - neither[rest]) // (part[rest] * unit)
                symbol = np.minimum(frequencies.ends.searchsorted(slot, "right"), vocabulary - 1)
            else:
                symbol = true[k].take(rest)
            below[rest] += unit * frequencies.begins.take(symbol)
            size[rest] = unit * frequencies.sizes.take(symbol)
            got[rest] = symbol
            frequencies.pending.append(got[rest])
        coder.narrow(part, below, size)
        out[k + 2, :m] = got
        mixture.pending.append(context * 3 + event)
        first.learn(place1, found1, got == id1, got)
        second.learn(place2, found2, event == 0, got)
    return out[2:].T.ravel()[:n].astype(np.uint16)


def encode_block(ids: np.ndarray, vocabulary: int) -> bytes:
    """Head and body."""
    coder = Encoder(lanes_of(len(ids))[0])
    run_block(coder, len(ids), ids, vocabulary)
    body = coder.finished()
    return HEAD.pack(len(ids), len(body) // 4, zlib.crc32(body), zlib.crc32(ids.astype("<u2").tobytes())) + body


def encode_blocks(ids: np.ndarray, vocabulary: int) -> list[bytes]:
    """Blocks of ids, at most BLOCK each."""
    return [encode_block(ids[k : k + BLOCK], vocabulary) for k in range(0, len(ids), BLOCK)]


def decode_blocks(raw: list[bytes], vocabulary: int) -> list[np.ndarray]:
    """Ids of each block; a block that differs from its checksums is an error."""
    out = []
    for r in raw:
        n, words, body_crc, ids_crc = HEAD.unpack_from(r)
        if len(r) != HEAD.size + 4 * words or zlib.crc32(r[HEAD.size :]) != body_crc:
            raise ValueError("a block's words differ from their checksum")
        ids = run_block(Decoder(lanes_of(n)[0], r[HEAD.size :]), n, None, vocabulary)
        if zlib.crc32(ids.astype("<u2").tobytes()) != ids_crc:
            raise ValueError("a block's ids differ from their checksum")
        out.append(ids)
    return out


def closing(at: int, index: list[tuple[int, bool, int]], offsets: list[int]) -> tuple[bytes, int]:
    """A file's index, which begins at at, and footer; and its number of ids."""
    table = np.array(index, INDEX)
    raw, tokens = table.tobytes() + np.array(offsets, "<u8").tobytes(), int(table["n_tokens"].sum())
    return raw + FOOT.pack(at, len(table), len(offsets), tokens, zlib.crc32(raw), MAGIC), tokens


#: Letters whose lower case is one of them, and which no normalisation changes, and what may follow a word.
#: Between the two the vocabulary's pattern always cuts.
LETTERS, AFTER = "A-Za-zÀ-ÖØ-öø-ÿ", "!-/:-@\\[-`{-~"


class Words:
    """Ids of texts by the tokenizers library. This vocabulary's tokens never hold white space, so each word is encoded once and kept, up to CACHED of them.

    A word of plain letters is kept in lower case and apart from the signs behind it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.mark = max(self.library.get_added_tokens_decoder().items())  # set between words to encode many at once
        # of lower-case letters the library's steps before its model only change the spelling: a character for each byte
        spelling = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        pairs = ((c.encode().decode("latin-1"), spelling.pre_tokenize_str(c)[0][0]) for c in map(chr, (*range(0xDF, 0xF7), *range(0xF8, 0x100))))
        self.spelt = [(a, b) for a, b in pairs if a != b]
        self.clear()

    def clear(self) -> None:
        self.known, self.parts, self.lengths = {}, [np.zeros(0, np.uint16)], []

    def learn(self, words: list[str]) -> None:
        code, mark = self.mark[0], self.mark[1].content
        plain = [w for w in words if "<|" not in w]
        for k in range(0, len(plain), 1000):
            some = plain[k : k + 1000]
            ids = np.array(self.library.encode(mark.join(some), add_special_tokens=False).ids, np.int64)
            ends = np.append(np.flatnonzero(ids == code), len(ids))
            self.keep(some, ids[ids != code], np.diff(ends, prepend=-1) - 1)
        for word in set(words).difference(plain):
            ids = np.array(self.library.encode(word, add_special_tokens=False).ids, np.int64)
            self.keep([word], ids, np.array([len(ids)]))

    def learn_letters(self, words: list[str]) -> None:
        """The same for words of lower-case LETTERS: each is one piece of the pattern."""
        tokenize, ids, lengths = self.library.model.tokenize, [], []
        text = " ".join(words).encode().decode("latin-1")
        for plain, spelt in self.spelt:
            text = text.replace(plain, spelt)
        for word in text.split(" "):
            tokens = tokenize(word)
            ids += [t.id for t in tokens]
            lengths.append(len(tokens))
        self.keep(words, np.array(ids, np.uint16), np.array(lengths, np.int64))

    def keep(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        if len(words) != len(lengths):
            raise ValueError("the vocabulary cuts words otherwise than this class expects")
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.parts.append(ids.astype(np.uint16))
        self.lengths.append(lengths)

    def numbers(self, words: pa.Array, learn: Callable[[list[str]], None]) -> np.ndarray:
        """The place of each word among the known."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        places = list(map(self.known.get, distinct))
        if None in places:
            learn([w for w, place in zip(distinct, places, strict=True) if place is None])
            places = list(map(self.known.get, distinct))
        return np.array(places, np.int64)[coded.indices.to_numpy()] if distinct else np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        words = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary
        if len(self.known) > CACHED:
            self.clear()
        if "" not in self.known:
            self.keep([""], np.zeros(0, np.int64), np.zeros(1, np.int64))
        lettered = pc.and_(pc.match_substring_regex(distinct, f"^[{LETTERS}]+[{AFTER}]*$"), pc.invert(pc.match_substring(distinct, "<|")))
        apart = distinct.filter(lettered)
        heads = pc.replace_substring_regex(apart, f"[{AFTER}]+$", "")
        tails = pc.replace_substring_regex(apart, f"^[{LETTERS}]+", "")
        of, at = np.full((len(distinct), 2), self.known[""]), lettered.to_numpy(zero_copy_only=False)
        of[at, 0], of[at, 1] = self.numbers(pc.utf8_lower(heads), self.learn_letters), self.numbers(tails, self.learn)
        of[~at, 0] = self.numbers(distinct.filter(pc.invert(lettered)), self.learn)
        self.parts, self.lengths = [np.concatenate(self.parts)], [np.concatenate(self.lengths)]
        ids, lengths = self.parts[0], self.lengths[0]
        begins = np.cumsum(lengths) - lengths
        # ids of each distinct word, then of all words
        of = of.ravel()
        ids, lengths = spans(ids, begins[of], lengths[of]), lengths[of].reshape(-1, 2).sum(1)
        used = coded.indices.to_numpy()
        size = lengths[used]
        flat = spans(ids, (np.cumsum(lengths) - lengths)[used], size)
        cuts = np.append(0, np.cumsum(size))[words.offsets.to_numpy()[1:-1]]
        return np.split(flat, cuts)


def spans(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values of spans, one after another."""
    ends = np.cumsum(sizes)
    return values[np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def stretches(text: str) -> Iterator[str]:
    """text in pieces of about STRETCH characters, cut where white space is."""
    at = 0
    while len(text) - at > STRETCH:
        cut = SPACE.search(text, at + STRETCH)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


SPACE = re.compile("[ \t-\r]")
_words: dict[str, Words] = {}


def encoded(path: str, texts: list[str], end: int) -> Iterator[np.ndarray]:
    """The ids of each text, end after each; texts are handled some STRETCH characters at a time."""
    if path not in _words:
        _words[path] = Words(path)
    pieces: list[str] = []
    owners: list[bool] = []  # whether a text ends with the piece
    held: list[np.ndarray] = []

    def flush() -> Iterator[np.ndarray]:
        for ids, last in zip(_words[path].encode(pieces), owners, strict=True):
            held.append(ids)
            if last:
                yield np.append(np.concatenate(held), np.uint16(end))
                held.clear()

    size = 0
    for text in texts:
        parts = list(stretches(text))
        for k, part in enumerate(parts):
            pieces.append(part)
            owners.append(k == len(parts) - 1)
            size += len(part)
            if size > 8 * STRETCH:
                yield from flush()
                pieces, owners, size = [], [], 0
    if pieces:
        yield from flush()


MANIFEST = "path string, part long, documents long, tokens long, bytes long"


def write_files(docs: DataFrame, where: str, path: str, vocabulary: int, end: int) -> DataFrame:
    """Writes the ids of docs(doc_id, text), in order of doc_id, one file a task, and returns the files' MANIFEST in the order of part.

    - null and empty texts are the end id alone; rows without an id come first, repeated rows and ids are all written, equal ids in the order of a hash of the text;
    - an empty table gives no files; other columns of docs are not looked at;
    - a file counts once its task is done: names are the tasks' own, and only those in the manifest are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((doc, ids) for b in batches for doc, ids in zip(b.column(0).to_pylist(), encoded(path, b.column(1).to_pylist(), end), strict=True))
        row = next(rows, None)
        if row is None:
            return
        fs, base = pafs.FileSystem.from_uri(where)
        fs.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.tids"
        index, offsets, waiting, size = [], [], [], 0
        with fs.open_output_stream(f"{base}/{name}", compression=None) as file:
            file.write(MAGIC)
            at = len(MAGIC)
            while row is not None or size:
                while row is not None and size < BLOCK:
                    index.append((row[0] or 0, row[0] is None, len(row[1])))
                    waiting.append(row[1])
                    size += len(row[1])
                    row = next(rows, None)
                ids = np.concatenate(waiting)
                take = len(ids) if row is None else len(ids) // BLOCK * BLOCK
                for k in range(0, take, BLOCK):
                    block = encode_block(ids[k : min(take, k + BLOCK)], vocabulary)
                    offsets.append(at)
                    file.write(block)
                    at += len(block)
                waiting, size = [ids[take:]], len(ids) - take
            tail, tokens = closing(at, index, offsets)
            file.write(tail)
        done = (f"{where}/{name}", TaskContext.get().partitionId(), len(index), tokens, at + len(tail))
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in done], names=[c.split()[0] for c in MANIFEST.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.xxhash64(text_or_empty()).alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return Scratch(docs.sparkSession).table(ordered.mapInArrow(run, MANIFEST), "manifest")


class TokenFile:
    """A file of ids: its documents, and any range of its ids by reading only the blocks that hold it."""

    def __init__(self, path: str, vocabulary: int):
        fs, name = pafs.FileSystem.from_uri(path)
        self.file, self.vocabulary = fs.open_input_file(name), vocabulary
        size = self.file.size()
        at, documents, blocks, self.tokens, crc, magic = FOOT.unpack(self.file.read_at(FOOT.size, size - FOOT.size))
        raw = self.file.read_at(size - FOOT.size - at, at) if magic == MAGIC and at <= size - FOOT.size else None
        if raw is None or zlib.crc32(raw) != crc:
            raise ValueError(f"{path}: no file of ids, or its index differs from its checksum")
        self.documents = np.frombuffer(raw, INDEX, documents)
        self.offsets = np.append(np.frombuffer(raw, "<u8", blocks, documents * INDEX.itemsize), np.uint64(at)).astype(np.int64)

    def groups(self, start: int, stop: int) -> Iterator[np.ndarray]:
        """Ids from start to stop, in order, a block at a time."""
        for k in range(start // BLOCK, -(-stop // BLOCK)):
            begin, end = self.offsets[k : k + 2].tolist()
            (ids,) = decode_blocks([self.file.read_at(end - begin, begin)], self.vocabulary)
            yield ids[max(0, start - k * BLOCK) : stop - k * BLOCK]

    def read(self, start: int, stop: int) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint16), *self.groups(start, stop)])


def read_files(manifest: DataFrame, vocabulary: int, each: Callable[[np.ndarray], dict], schema: str) -> DataFrame:
    """A row for each document of the files in manifest: doc_id, start (ids before it in all files, in the order of part), n_tokens, and what each makes of its ids (schema)."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (row for batch in batches for row in batch.to_pylist()):
            file = TokenFile(row["path"], vocabulary)
            groups, ids, out, start = file.groups(0, file.tokens), np.zeros(0, np.uint16), [], row["start"]
            for doc_id, null, n in file.documents.tolist():
                if len(ids) < n:
                    parts, size = [ids], len(ids)
                    while size < n:
                        parts.append(next(groups))
                        size += len(parts[-1])
                    ids = np.concatenate(parts)
                out.append({"doc_id": None if null else doc_id, "start": start, "n_tokens": n} | each(ids[:n]))
                ids, start = ids[n:], start + n
                if len(out) == 4096:
                    yield pa.RecordBatch.from_pylist(out)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out]) for c in ("doc_id", "start", "n_tokens", *names)], names=["doc_id", "start", "n_tokens", *names])

    before = F.coalesce(F.sum("tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    files = Scratch(manifest.sparkSession).table(manifest.select("path", before.alias("start")), "starts")  # a row for each file
    return files.repartition(max(1, files.count()), "path").mapInArrow(run, f"doc_id long, start long, n_tokens long, {schema}")


def op12_token_files(spark: SparkSession, sf_dir: str, vocabulary: int = 49_408, end: int = 2) -> DataFrame:
    import public_tokenizers

    manifest = write_files(load(spark, sf_dir, "documents"), Scratch(spark).path("tokens"), public_tokenizers.path("word_bpe_49k.json"), vocabulary, end)
    return read_files(manifest, vocabulary, lambda ids: {"ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())}, "ids_crc32 long")
