"""Packing of documents into sequences of CAPACITY tokens with minimum bin slack.

Method: a document's ids and an end id are cut at every CAPACITY ids; these pieces are full sequences. What remains of each
document joins a window of up to WINDOW pieces. A sequence takes the longest piece left; of the multiset of the other
lengths a bitset subset-sum program finds the sum closest to the room that is left, and walks back how many pieces of each
length make it. A length that no multiset of the others completes is set aside, and the next longest is tried; what is
left of a window waits for more pieces, or is cut to fill if it is more than half of the window. At the end of a task's rows
the rest is cut to fill, and the last sequence is cut at powers of two, where nothing is padded.

Scale: a map over the partitions of the input: no shuffle, no state between tasks. Memory: one window's pieces and one
slice of texts. sequence_id is the partition's number times 2^40 and a count, the same when a lost task runs again.

Defined cases: null text is empty: its only id is the end id. An id that is null stays null; rows that repeat an id are
packed apart, each with its own pieces. Texts are whole, however long. Other columns are not read. Ties between pieces of
one length go to the piece read first. An empty table gives an empty one.
"""

import zlib
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from taleweave.llm.arrow_text import rows_to_batch, small_batches, text_slices
from taleweave.llm.bpe import ENCODED_BYTES, task_encoder, vocabulary_path

CAPACITY = 2048
#: Pieces that are packed together.
WINDOW = 8192
END_ID = 1


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length to take so that their sum is closest to room from below; counts: pieces at hand of each length."""
    within, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length], room // length) if length else 0
        times = 1
        while left > 0:  # 1, 2, 4, ... pieces at once
            take = min(times, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & within
            left -= take
            times *= 2
        if reach >> room & 1:
            break
    total, taken = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:  # this sum needs these pieces
            taken[length] = taken.get(length, 0) + take
            total -= length * take
    return taken


class Packer:
    """Takes documents in turn and gives sequences: lists of (doc_id, start, ids, doc_tokens)."""

    def __init__(self, capacity: int = CAPACITY, window: int = WINDOW):
        self.capacity, self.window = capacity, window
        self.waiting: dict[int, deque] = defaultdict(deque)
        self.held = 0

    def add(self, doc_id, ids: np.ndarray):
        full = len(ids) - len(ids) % self.capacity
        for start in range(0, full, self.capacity):
            yield [(doc_id, start, ids[start : start + self.capacity], len(ids))]
        if full < len(ids):
            self.waiting[len(ids) - full].append((doc_id, full, ids[full:], len(ids)))
            self.held += 1
        if self.held >= self.window:
            yield from self._filled()
            if self.held * 2 > self.window:  # most of it fits no sequence
                yield from self._cut(last=False)

    def _take(self, length: int):
        self.held -= 1
        piece = self.waiting[length].popleft()
        if not self.waiting[length]:
            del self.waiting[length]
        return piece

    def _filled(self):
        """Sequences filled to the last place by whole pieces, until no choice of the pieces left fills one."""
        aside = {}
        while self.waiting:
            longest = max(self.waiting)
            room = self.capacity - longest
            taken = fill({n: len(q) - (n == longest) for n, q in self.waiting.items() if n <= room}, room)
            if sum(n * k for n, k in taken.items()) < room:  # fewer of the others won't do either, and a shorter piece that needed this one would have gone with it
                aside[longest] = self.waiting.pop(longest)
                continue
            yield [self._take(longest), *(self._take(n) for n, k in taken.items() for _ in range(k))]
        self.waiting.update(aside)

    def _cut(self, last: bool = True):
        """Sequences of all pieces that wait, cut wherever one is full; the last at powers of two."""
        pieces = [self._take(n) for n in sorted(self.waiting, reverse=True) for _ in range(len(self.waiting[n]))]
        total, sequence, used = sum(len(p[2]) for p in pieces), [], 0
        size = self.capacity
        for doc_id, start, ids, tokens in pieces:
            while len(ids):
                if not sequence and total < size:
                    if not last:
                        self.waiting[len(ids)].append((doc_id, start, ids, tokens))
                        self.held += 1
                        total -= len(ids)
                        break
                    size = 1 << (total.bit_length() - 1)
                part = ids[: size - used]
                sequence.append((doc_id, start, part, tokens))
                used, start, ids, total = used + len(part), start + len(part), ids[len(part) :], total - len(part)
                if used == size:
                    yield sequence
                    sequence, used = [], 0

    def finish(self):
        yield from self._filled()
        yield from self._cut()


COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
SCHEMA = pa.schema([(c.split()[0], pa.int64()) for c in COLUMNS.split(", ")])


def pack(docs: DataFrame, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document; with_ids: with the piece's ids as an array."""
    vocabulary = vocabulary or vocabulary_path()
    schema = SCHEMA.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else SCHEMA

    def run(batches):
        encoder, packer = task_encoder(vocabulary, None), Packer()
        number = TaskContext.get().partitionId() << 40
        rows = {f.name: [] for f in schema}

        def out(sequences):
            nonlocal number
            for sequence in sequences:
                offset = 0
                for doc_id, start, ids, tokens in sequence:
                    values = [doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), tokens, number, offset]
                    for column, value in zip(rows.values(), [*values, ids.astype(np.int32)]):
                        column.append(value)
                    offset += len(ids)
                number += 1

        def batch_of_rows():
            made = rows_to_batch(schema, rows)
            for column in rows.values():
                column.clear()
            return made

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for first, texts in text_slices(batch, limit=ENCODED_BYTES):
                for doc_id, tokens in zip(ids[first : first + len(texts)], encoder.encode(texts)):
                    out(packer.add(doc_id, np.append(tokens, END_ID).astype(np.uint32)))
                yield batch_of_rows()
        out(packer.finish())
        yield batch_of_rows()

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, COLUMNS + (", ids array<int>" if with_ids else ""))
