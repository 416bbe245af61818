"""Bounded-space online packing of token sequences: a fixed number of open windows per partition, best fit, merged at the end."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import bound_batches, stored

WINDOW, OPEN, END = 1024, 32, np.array([0], dtype="<u4").tobytes()
#: Partitions whose leftovers are merged together; known pieces of text kept by a tokenizer.
MERGED, CACHED = 8, 1_000_000
#: New pieces that the tokenizer encodes as one text.
TOGETHER = 500
#: Sequence ids: 32 bits count within a partition or merge, the bits above name it, the topmost marks merges.
SHIFT, MERGE_BIT = 32, 1 << 62

#: Closed pieces handed on at a time; each holds the ids of a window at most.
HANDED = 2000

PIECES = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
PIECE_SCHEMA = pa.schema([(c, pa.binary() if c == "ids" else pa.int64()) for c in PIECES])
LEFT_SCHEMA = pa.schema([*PIECE_SCHEMA, ("part", pa.int64()), ("place", pa.int64())])
Piece = tuple[int | None, int, bytes, int]

# a space or line break next to other white space, where a cut could change the tokens
_IRREGULAR = re.compile(r"[ \n](?:(?<=\s[ \n])|(?=\s))")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_TAIL = ".,;:!?"
#: Marks before a piece, and the line breaks each stands for: the start of a text, a line break.
_MARKS = {" ": 0, "\n": 1}
#: How a byte-level vocabulary writes a space (a fixed value).
_SPACE = "\u0120"
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Texts to ids (little-endian, 4 bytes each), remembering the ids of pieces between spaces and line breaks.

    A byte-level tokenizer starts a new token at every space between two visible characters, makes a line break there a token
    of its own, and parts letters from the marks after them, so pieces cut there can be encoded alone. Only pieces not met
    before go through the tokenizer, in one batch.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # the tokenizer takes these out of a text before anything else, the longest of those that start at one place
        self.added = {t.content: k for k, t in self.tokenizer.get_added_tokens_decoder().items()}
        plain = not any(t.lstrip or t.rstrip or t.single_word for t in self.tokenizer.get_added_tokens_decoder().values())
        names = sorted(self.added, key=len, reverse=True)
        self.parts = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.apart = plain
        self.line = self._ids(["\n"])[0]
        self.break_id = int(np.frombuffer(self.line, dtype="<u4")[0])
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.opens[[k for t, k in vocabulary.items() if t.startswith(_SPACE)]] = True
        # pieces as they are; pieces after a space (known by what follows it), after a line break (with the break) and, marked
        # by a space, at the start of a text
        self.plain: dict[str, bytes] = {}
        self.cut: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _parted_ids(self, pieces: list[str], before: str) -> list[bytes]:
        """Ids of pieces after a space or line break: many at once in one text, parted where a token opens with it.

        The break is no part of the ids, the space is.
        """
        out, skip = [], len(self.line) if before == "\n" else 0
        for at in range(0, len(pieces), TOGETHER):
            part = pieces[at:at + TOGETHER]
            raw, = self._ids([before + before.join(part)])
            ids = np.frombuffer(raw, dtype="<u4")
            starts = np.flatnonzero(ids == self.break_id if skip else self.opens[ids])
            if len(starts) == len(part):
                ends = [*(4 * starts[1:]).tolist(), len(raw)]
                out += [raw[a:b] for a, b in zip((4 * starts + skip).tolist(), ends, strict=True)]
            else:
                out += self._ids([("" if skip else before) + p for p in part])
        return out

    def _learn(self, known: dict[str, bytes], pieces: set[str], before: str) -> None:
        new = pieces.difference(known)
        stems = {p: s for p in new if (s := p.rstrip(_TAIL)) != p and s.isalpha()}
        tails = {p[len(s):] for p, s in stems.items()}
        for kind, unknown, lead in ((known, new.difference(stems).union(stems.values()), before), (self.plain, tails, "\n")):
            wanted = list(unknown.difference(kind))
            # as a rule no piece is empty or holds white space
            simple = wanted if " ".join(wanted).split() == wanted else [p for p in wanted if p.split() == [p]]
            kind.update(zip(simple, self._parted_ids(simple, lead), strict=True))
            if len(simple) < len(wanted):
                rest = list(set(wanted).difference(simple))
                kind.update(zip(rest, self._ids([lead.strip("\n") + p for p in rest]), strict=True))
        known.update({p: known[s] + self.plain[p[len(s):]] for p, s in stems.items()})

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text; a special token written in a text becomes its own id, as the tokenizer has it."""
        split = [self.parts.split(t) if self.parts else [t] for t in texts]
        if all(len(s) == 1 for s in split):
            yield from self._encode(texts)
            return
        for t, s in zip(texts, split, strict=True):
            if len(s) == 1 or self.apart:
                ids = self._encode(s[::2])
                yield next(ids) + b"".join(np.array([self.added[a]], dtype="<u4").tobytes() + next(ids) for a in s[1::2])
            else:
                yield from self._ids([t])

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        cut = [_CUT.split(t) if _IRREGULAR.search(t) else t.replace("\n", " \n").split(" ") for t in texts]
        for c in cut:
            c[0] = " " + c[0]
        for known in (self.plain, self.cut):
            if len(known) > CACHED:
                known.clear()
        new = set().union(*cut).difference(self.cut)
        marked = [p for p in new if p[:1] in _MARKS]
        self._learn(self.plain, {p[1:] for p in marked}, "\n")
        self._learn(self.cut, new.difference(marked), " ")
        self.cut.update({p: _MARKS[p[0]] * self.line + self.plain[p[1:]] for p in marked})
        for c in cut:
            yield b"".join(map(self.cut.__getitem__, c))


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Packer:
    """Open windows and the rows of those already closed."""

    def __init__(self, first_id: int, window: int = WINDOW, limit: int = OPEN):
        self.window, self.limit, self.next_id = window, limit, first_id
        self.open: list[tuple[int, list[Piece]]] = []
        self.rows: list[tuple] = []

    def _close(self, pieces: Iterable[Piece]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, total, self.next_id, offset, ids))
            offset += n
        self.next_id += 1

    def _put(self, slot: int | None, piece: Piece) -> None:
        used, pieces = self.open.pop(slot) if slot is not None else (0, [])
        used += len(piece[2]) // 4
        pieces.append(piece)
        if used == self.window:
            self._close(pieces)
        else:
            self.open.append((used, pieces))

    def add(self, doc: int | None, start: int, ids: bytes, total: int) -> None:
        """Cut whole windows off, then best fit; where no window fits, fill the fullest up, emit it and open a new one."""
        whole = 4 * self.window
        at = 0
        while len(ids) - at >= whole:
            self._close([(doc, start + at // 4, ids[at:at + whole], total)])
            at += whole
        rest = (len(ids) - at) // 4
        if not rest:
            return
        fits = [(used, k) for k, (used, _) in enumerate(self.open) if used + rest <= self.window]
        if fits:
            self._put(max(fits)[1], (doc, start + at // 4, ids[at:], total))
        elif len(self.open) < self.limit:
            self._put(None, (doc, start + at // 4, ids[at:], total))
        else:
            used, k = max((used, k) for k, (used, _) in enumerate(self.open))
            to = at + 4 * (self.window - used)
            self._put(k, (doc, start + at // 4, ids[at:to], total))
            self._put(None, (doc, start + to // 4, ids[to:], total))

    def finish(self) -> None:
        """Run the pieces of all open windows together into full ones, and cut the last at powers of two, which need no padding."""
        pieces = [p for _, pieces in sorted(self.open, key=lambda o: -o[0]) for p in pieces]
        left = sum(used for used, _ in self.open)
        self.open = []
        sizes = [self.window] * (left // self.window) + [1 << b for b in reversed(range(self.window.bit_length())) if left % self.window >> b & 1]
        for size in sizes:
            taken, need = [], size
            while need:
                doc, start, ids, total = pieces[0]
                n = min(need, len(ids) // 4)
                taken.append((doc, start, ids[:4 * n], total))
                if 4 * n == len(ids):
                    pieces.pop(0)
                else:
                    pieces[0] = (doc, start + n, ids[4 * n:], total)
                need -= n
            self._close(taken)

    def taken(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _pack(tokenizer: str, window: int, limit: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer = Packer(part << SHIFT, window, limit)
        encoder = _encoder(tokenizer)
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc, ids in zip(docs, encoder.encode(texts), strict=True):
                packer.add(doc, 0, ids + END, len(ids) // 4 + 1)
                if len(packer.rows) >= HANDED:
                    yield _batch([(*r, None, None) for r in packer.taken()], LEFT_SCHEMA)
            yield _batch([(*r, None, None) for r in packer.taken()], LEFT_SCHEMA)
        left = [(doc, start, len(ids) // 4, total, None, None, ids, part, place)
                for place, (_, pieces) in enumerate(packer.open) for doc, start, ids, total in pieces]
        yield _batch(left, LEFT_SCHEMA)

    return pack


def _merge(window: int, limit: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("merge", "doc_id", "start", "ids", "doc_tokens")), strict=True)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, pieces in groupby(rows(batches), key=lambda r: r[0]):
            packer = Packer(MERGE_BIT | key << SHIFT, window, limit)
            for k, (_, doc, start, ids, total) in enumerate(pieces):
                packer.add(doc, start, ids, total)
                if k % HANDED == HANDED - 1:
                    yield _batch(packer.taken(), PIECE_SCHEMA)
            packer.finish()
            yield _batch(packer.taken(), PIECE_SCHEMA)

    return merge


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, open_windows: int = OPEN,
         id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Documents to pieces of sequences of at most ``window`` tokens (a power of two), with their ids and the CRC-32 of these.

    ``ids`` holds 4 bytes a token, little-endian; the ids of a sequence are those of its pieces in the order of ``offset``.
    Every document is its ids and an end id; a null text is the end id alone. Each partition streams its documents through a
    fixed number of open windows, so its memory is bounded; what is open at its end is merged with the leftovers of
    ``MERGED - 1`` other partitions by the same rule, and each merge cuts its last window at powers of two. Pieces keep a null
    id; repeated rows are packed each on its own; an empty table gives no pieces. Longer texts are cut at window ends.
    """
    bound_batches(docs.sparkSession)
    lines = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    whole = ", ".join(f"{c} {'binary' if c == 'ids' else 'long'}" for c in PIECES)
    first = stored(lines.mapInArrow(_pack(tokenizer, window, open_windows), f"{whole}, part long, place long"), "packed")
    left = first.filter("part is not null").withColumn("merge", F.floor(F.col("part") / MERGED))
    left = left.repartition("merge").sortWithinPartitions("merge", "part", "place", "doc_id", "start")
    merged = left.select("merge", "doc_id", "start", "ids", "doc_tokens").mapInArrow(_merge(window, open_windows), whole)
    return first.filter("part is null").select(*PIECES).union(merged).withColumn("ids_crc32", F.crc32("ids"))
