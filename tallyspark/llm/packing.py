"""Packing: vector bin packing of token sequences under several limits at once.

Each document's ids, with an end id, are cut into full sequences and a tail. Tails go into bins by the
dot-product heuristic: of all waiting tails that fit, the one whose size vector (tokens, segments,
loss-bearing tokens) has the largest dot product with what is left of the bin. What a bin still lacks
is cut from another tail, so bins fill up; the last bin of a task is parted into sequences whose
sizes are powers of two, which need no padding. A task packs its own partition in windows, so nothing
is shuffled and memory is bounded by the window; sequence ids hold the partition's number, so a task
that runs again gives the same rows.

Null and empty texts have only the end id. Repeated rows are packed as often as they occur. An empty
table gives an empty one. A text longer than a sequence spans several.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: Tokens, segments and loss-bearing tokens of a sequence.
LIMITS = (1024, 64, 1023)
#: Tails that wait for a place at once.
WINDOW = 2048
#: White space, as the pattern has it, that is encoded apart from the rest.
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1024,}")
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class ByteBPE:
    """Ids as the tokenizer file gives them: its vocabulary as merge ranks."""

    def __init__(self, path: str) -> None:
        import json

        import public_tokenizers
        import tiktoken

        from .bpe import byte_symbols

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        code = {ord(c): b for b, c in enumerate(byte_symbols())}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(code[ord(c)] for c in text): i for text, i in spec["model"]["vocab"].items() if text not in special}
        self.model = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = tuple(special)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids; special tokens in the text are read as such, as the file says."""
        out, at = [], 0
        for run in _LONG_SPACE.finditer(text):
            # the pattern would backtrack over all of the run; it is one word, without its last character if a word follows
            end = run.end() if run.end() == len(text) or text.startswith(self.special, run.end()) else run.end() - 1
            out.append(self._encode(text[at : run.start()]))
            out.append(np.array(self.model._encode_single_piece(text[run.start() : end]), "<u4").tobytes())
            at = end
        return b"".join([*out, self._encode(text[at:])])

    def _encode(self, text: str) -> bytes:
        return self.model.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()


@functools.cache
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


class Packer:
    """Packs (key, size, loss) items; emits (key, start, length, sequence, offset) pieces.

    Items whose loss is given stay whole; the others may be cut, and all their tokens bear loss but
    the first of each piece. One packer takes items of one kind.
    """

    def __init__(self, limits: tuple[int, int, int] = LIMITS, window: int = WINDOW, first_sequence: int = 0, cuts: bool = True) -> None:
        self.limits, self.window, self.sequence, self.cuts = limits, window, first_sequence, cuts
        #: Waiting tails by (tokens, loss): lists of (key, start).
        self.waiting: dict[tuple[int, int], list] = {}
        self.count = 0

    def add(self, key, size: int, loss: int | None = None) -> Iterator[tuple]:
        if (loss is None) != self.cuts:
            raise ValueError("loss is given if, and only if, items stay whole")
        most, start = min(self.limits[0], self.limits[2] + 1), 0
        if not self.cuts and (size > most or loss > self.limits[2]):
            raise ValueError("the item doesn't fit into a sequence")
        while self.cuts and size >= most:
            yield key, start, most, self.sequence, 0
            self.sequence += 1
            size, start = size - most, start + most
        if size:
            self._put(key, start, size, size - 1 if loss is None else loss)
        if self.count >= self.window:
            yield from self.pack(self.window // 8)

    def _put(self, key, start: int, size: int, loss: int) -> None:
        self.waiting.setdefault((size, loss), []).append((key, start))
        self.count += 1

    def _take(self, vector: tuple[int, int]) -> tuple:
        rows = self.waiting[vector]
        got = rows.pop()
        if not rows:
            del self.waiting[vector]
        self.count -= 1
        return got

    def _bin(self) -> list[tuple]:
        """One bin: pieces (key, start, length)."""
        limits = np.array(self.limits, float)
        left, pieces = np.array(self.limits, np.int64), []
        vectors = np.array([(t, 1, x) for t, x in self.waiting], np.int64)
        alive = np.ones(len(vectors), bool)
        while left[0] and left[1]:
            fits = np.flatnonzero(alive & (vectors <= left).all(axis=1)) if len(vectors) else []
            if not len(fits):
                break
            best = int(fits[np.argmax((vectors[fits] / limits) @ (left / limits))])
            vector = (int(vectors[best, 0]), int(vectors[best, 2]))
            key, start = self._take(vector)
            pieces.append((key, start, vector[0]))
            left -= vectors[best]
            alive[best] = vector in self.waiting
        room = int(min(left[0], left[2] + 1))
        longer = [v for v in self.waiting if v[0] > room] if self.cuts and left[1] and room > 0 else []
        if longer:
            size, loss = max(longer)
            key, start = self._take((size, loss))
            pieces.append((key, start, room))
            self._put(key, start + room, size - room, size - room - 1)
        return pieces

    def _emit(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for key, start, length in pieces:
            yield key, start, length, self.sequence, offset
            offset += length
        self.sequence += 1

    def pack(self, leave: int) -> Iterator[tuple]:
        while self.count > leave:
            yield from self._emit(self._bin())

    def finish(self) -> Iterator[tuple]:
        while self.count:
            pieces = self._bin()
            total = sum(x[2] for x in pieces)
            if total == self.limits[0] or not self.cuts:
                yield from self._emit(pieces)
                continue
            # a last, short bin: sequences of 2^k tokens, the largest first
            for power in (1 << b for b in reversed(range(total.bit_length())) if total >> b & 1):
                part = []
                while power:
                    key, start, length = pieces.pop(0)
                    part.append((key, start, min(length, power)))
                    if length > power:
                        pieces.insert(0, (key, start + power, length - power))
                    power -= part[-1][2]
                yield from self._emit(part)


def pack_documents(docs: DataFrame, path: str, end_id: int = 0, limits: tuple[int, int, int] = LIMITS) -> DataFrame:
    """The pieces of docs (doc_id, text, ...) with their ids (binary, little-endian unsigned 32-bit).

    Of a document all tokens bear loss but the first of each piece. The limit on tokens is a power of two.
    """
    spark = prepare(docs.sparkSession)
    width = 4

    def run(batches):
        from pyspark import TaskContext

        model = load(path)
        packer = Packer(limits, first_sequence=TaskContext.get().partitionId() << 40)
        held: dict[int, list] = {}  # row -> doc_id, ids, tokens yet to be placed
        end = np.array([end_id], "<u4").tobytes()

        def rows(pieces):
            out = []
            for key, start, length, sequence, offset in pieces:
                doc = held[key]
                out.append((doc[0], start, length, doc[1][start * width : (start + length) * width], len(doc[1]) // width, sequence, offset))
                doc[2] -= length
                if not doc[2]:
                    del held[key]
            return out

        def table(out):
            columns = list(zip(*out)) if out else [[]] * 7
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
            names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        n = 0
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = model.encode(text or "") + end
                held[n] = [doc_id, ids, len(ids) // width]
                out += rows(packer.add(n, len(ids) // width))
                n += 1
            yield table(out)
        yield table(rows(packer.finish()))

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def pieces_with_checksums(docs: DataFrame, path: str) -> DataFrame:
    return pack_documents(docs, path).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
