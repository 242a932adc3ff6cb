"""Quotes, brackets and commas of JSON text, told from its bytes within Arrow tasks: what sources/keyed.py needs of each byte range."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes looked through at once, but for longer pieces.
SLICE = 1 << 22
QUOTE, OPENING, CLOSING, SLASH = 1, 2, 3, 4
_SIGNS = np.zeros(256, np.uint8)
for _sign, _chars in ((QUOTE, b'"'), (OPENING, b"[{"), (CLOSING, b"]}"), (SLASH, b"\\")):
    _SIGNS[list(_chars)] = _sign

EFFECTS = "part int, nth int, file string, start long, signs long, quotes long, plain long, quoted long"
#: Rows of members(): a member; the end of one that began in an earlier range; a range without an end of a member; the beginning of one; no JSON.
WHOLE, CLOSES, WITHIN, OPENS, STRAY = range(5)
MEMBERS = "part int, nth int, kind int, first boolean, last boolean, text string"
_MEMBERS = pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("kind", pa.int32()), ("first", pa.bool_()), ("last", pa.bool_()), ("text", pa.string())])


class Stretch(NamedTuple):
    """Pieces of the nth range of a part that follow each other: their bytes, and where each begins and the last one ends."""

    part: int
    nth: int
    file: str
    start: int
    data: np.ndarray
    bounds: np.ndarray


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[Stretch]:
    """batches(part, file, start, text): pieces in order, those of one range together."""
    now, nth = None, -1
    for batch in batches:
        if not batch.num_rows:
            continue
        part, start = (batch.column(c).to_numpy() for c in ("part", "start"))
        names, text = batch.column("file"), batch.column("text")
        file = names.dictionary_encode().indices.to_numpy()
        turns = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1]) | (part[1:] != part[:-1])) + 1
        wide = np.int64 if pa.types.is_large_string(text.type) else np.int32
        bounds = np.frombuffer(text.buffers()[1], wide)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        for low, high in zip([0, *turns], [*turns, len(text)], strict=True):
            key = (int(part[low]), names[int(low)].as_py(), int(start[low]))
            if key != now:
                now, nth = key, nth + 1 if now and now[0] == key[0] else 0
            while low < high:
                end = min(high, max(low + 1, int(np.searchsorted(bounds, bounds[low] + SLICE, "right")) - 1))
                yield Stretch(key[0], nth, key[1], key[2], data[bounds[low] : bounds[end]], bounds[low : end + 1] - bounds[low])
                low = end


def signs(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where quotes and brackets without a backslash stand in data, and which; starts: of its pieces, where no backslash counts from before."""
    at = np.flatnonzero(_SIGNS[data])
    kind = _SIGNS[data[at]]
    slashes = kind == SLASH
    if slashes.any():
        fresh = np.zeros(len(data) + 1, bool)
        fresh[starts] = True
        behind = np.zeros(len(at), bool)
        behind[1:] = slashes[:-1] & (at[1:] == at[:-1] + 1) & ~fresh[at[1:]]
        index = np.arange(len(at))
        kept = ~slashes & ((index - np.maximum.accumulate(np.where(behind, 0, index))) % 2 == 0)  # behind an even number of backslashes
        at, kind = at[kept], kind[kept]
    return at, kind


def deeper(kind: np.ndarray) -> np.ndarray:
    return (kind == OPENING).astype(np.int64) - (kind == CLOSING)


def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each range: its signs and quotes, by how many brackets it goes deeper, if it begins outside (plain) or inside a string (quoted)."""
    rows: list[list] = []
    for x in stretches(batches):
        if not rows or rows[-1][:2] != [x.part, x.nth]:
            rows.append([x.part, x.nth, x.file, x.start, 0, 0, 0, 0])
        row = rows[-1]
        _, kind = signs(x.data, x.bounds[:-1])
        inside = (row[5] + np.cumsum(kind == QUOTE)) % 2 == 1
        down = deeper(kind)
        within = int(down[inside].sum())
        for k, n in ((4, len(kind)), (5, int((kind == QUOTE).sum())), (6, int(down.sum()) - within), (7, within)):
            row[k] += n
    types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), *[pa.int64()] * 4]
    names = [c.split()[0] for c in EFFECTS.split(", ")]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


class States:
    """What is known of each range before it is cut: flipped (it begins inside a string), level (its depth there), final (its last piece ends the file),
    first and last (of its object's ranges), leads (it holds its object's first sign), wanted (the object is to be read)."""

    COLUMNS = ("part", "nth", "flipped", "level", "final", "first", "last", "leads", "wanted")

    def __init__(self, table: pa.Table):
        of = {c: table.column(c).to_numpy() for c in self.COLUMNS}
        order = np.lexsort((of["nth"], of["part"]))
        self.of = {c: v[order] for c, v in of.items()}

    def __call__(self, part: int, nth: int) -> dict:
        k = int(np.searchsorted(self.of["part"], part)) + nth
        if k >= len(self.of["part"]) or (self.of["part"][k], self.of["nth"][k]) != (part, nth):
            raise LookupError(f"range {nth} of part {part} was not there when the ranges were told")
        return {c: v[k].item() for c, v in self.of.items()}


class _Range:
    """One range while its pieces come in. What follows the last cut is kept until it is known whether more comes."""

    def __init__(self, state: dict):
        self.state, self.flipped, self.depth = state, state["flipped"], state["level"]
        self.rest: list[bytes] = []  # pieces since the last cut, with the commas between them
        self.open, self.due = False, False  # there are such pieces; behind the last one is a cut, if anything is
        self.cuts = self.seen = self.strays = 0

    def rows(self, kind: int, texts: pa.Array, first: bool = False, last: bool = False) -> pa.RecordBatch:
        alike = lambda v, t: pa.array(np.full(len(texts), v), t)
        return pa.RecordBatch.from_arrays([*(alike(v, pa.int32()) for v in (self.state["part"], self.state["nth"], kind)), alike(first, pa.bool_()), alike(last, pa.bool_()), texts], schema=_MEMBERS)

    def one(self, kind: int, text: bytes, first: bool = False, last: bool = False) -> pa.RecordBatch:
        return self.rows(kind, _texts(np.frombuffer(text, np.uint8), np.array([0, len(text)])), first, last)

    def closed(self) -> pa.RecordBatch:
        """The pieces since the last cut, which another cut ends."""
        text, self.rest, self.open = b"".join(self.rest), [], False
        self.cuts += 1
        if self.cuts > 1:
            return self.one(WHOLE, text)
        return self.one(WHOLE if self.state["first"] else CLOSES, text, first=self.state["first"])

    def take(self, x: Stretch) -> Iterator[pa.RecordBatch]:
        at, kind = signs(x.data, x.bounds[:-1])
        inside = (self.flipped + np.cumsum(kind == QUOTE)) % 2 == 1  # behind each sign
        down = np.where(inside, 0, deeper(kind))
        depth = self.depth + np.cumsum(down)
        opens = np.where(kind == QUOTE, inside, (kind == OPENING) & ~inside)
        outside = opens & (depth - down <= 0)
        if self.state["leads"] and not self.seen:
            outside[:1] = False
        self.strays += int(outside.sum())
        self.seen += len(kind)
        signs_before = np.searchsorted(at, x.bounds[1:])
        depth, inside = np.concatenate([[self.depth], depth])[signs_before], np.concatenate([[self.flipped], inside])[signs_before]
        cut = (depth == 1) & (inside == 0)
        self.depth, self.flipped = int(depth[-1]), int(inside[-1])
        if self.open:
            if self.due:
                yield self.closed()
            else:
                self.rest.append(b",")
        self.open, self.due = True, bool(cut[-1])
        ends, comma = x.bounds[1:-1], ~cut[:-1]
        text = np.insert(x.data, ends[comma], ord(","))
        after = (ends + np.cumsum(comma))[cut[:-1]]  # where members end in text
        if not len(after):
            self.rest.append(text.tobytes())
            return
        self.rest.append(text[: after[0]].tobytes())
        yield self.closed()
        if len(after) > 1:
            self.cuts += len(after) - 1
            yield self.rows(WHOLE, _texts(text[after[0] : after[-1]], after - after[0]))
        self.rest, self.open = [text[after[-1] :].tobytes()], True

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.due and not self.state["final"]:
            yield self.closed()
        text, first, last = b"".join(self.rest), self.state["first"] and not self.cuts, self.state["last"]
        whole = last and (first or self.cuts)
        between = b"," if self.open and not self.state["final"] else b""  # no comma ends a file
        yield self.one(WHOLE if whole else OPENS if self.cuts else WITHIN, text + between, first, last)
        if self.strays:
            yield self.one(STRAY, b"")


def _texts(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def members(batches: Iterator[pa.RecordBatch], states: States) -> Iterator[pa.RecordBatch]:
    """The members of the JSON objects, and what ranges hold of members that no range holds whole; first, last: in the object, whose braces are left.

    Each range that is not its object's last one gives one row WITHIN, if no member ends there, else OPENS. What belongs to one member is put together
    in order of file, start and kind. STRAY: something begins behind the object's end. Ranges that are not wanted have no rows.
    """
    now = None
    for x in stretches(batches):
        if now is None or (now.state["part"], now.state["nth"]) != (x.part, x.nth):
            if now and now.state["wanted"]:
                yield from now.end()
            now = _Range(states(x.part, x.nth))
        if now.state["wanted"]:
            yield from now.take(x)
    if now and now.state["wanted"]:
        yield from now.end()
