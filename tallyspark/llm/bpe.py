"""BPE encoding and decoding with batched NumPy merge rounds.

The symbols of many words lie in one flat array. In each round every word merges all occurrences of
its lowest-rank pair; ranks are found by binary search over the sorted pair keys. Very long words, whose
rounds would take the square of their length, are merged by a heap. Words (maximal runs
without white space) that a worker has met before come from a bounded cache, so texts cost one
dictionary look-up per word.

Letters and digits are those of the installed Unicode tables; the tokenizers library has older ones, so
texts with letters that are new to Unicode since then may be split elsewhere.

The tokenizer file must be of the kind NFC + lower case, split into letters, single digits and other
runs, byte-level symbols and a word-end suffix. Null and empty texts have no ids; decoding no ids
gives the empty text. Rows are independent: repeated rows repeat, an empty table stays empty.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import prepare, with_arrow_columns

#: Words that a worker remembers; beyond that the memory starts anew.
REMEMBERED = 400_000
#: Bytes of a word from which it is merged by itself.
LONG = 400
#: Characters that Python takes for white space and the tokenizers' patterns don't.
_NOT_SPACE = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in shown}
    return [names[b] if b in names else chr(256 + sum(x not in names for x in range(b))) for b in range(256)]


class WordBPE:
    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.names: list[str | None] = [None] * (max([*vocab.values(), *special.values()]) + 1)
        for text, i in [*vocab.items(), *special.items()]:
            self.names[i] = text
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + self.suffix] for s in symbols], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.pairs: dict[int, tuple[int, int]] = {}
        self.cache: dict[str, bytes] = {}

    def merge(self, symbols: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """Symbols of words laid end to end, and the words' sizes -> the ids of each word."""
        long = sizes > LONG
        if long.any():
            ends = np.cumsum(sizes)
            inside = np.repeat(~long, sizes)
            rest = iter(self.merge(symbols[inside], sizes[~long]))
            return [self.merge_long(symbols[e - n : e].tolist()) if far else next(rest) for e, n, far in zip(ends, sizes, long)]
        none = np.int64(len(self.made))
        word = np.repeat(np.arange(len(sizes)), sizes)
        done_words, done_symbols = [], []
        while len(symbols):
            n = len(symbols)
            rank = np.full(n, none)
            if n > 1:
                same = np.flatnonzero(word[1:] == word[:-1])
                pair = symbols[same] << 32 | symbols[same + 1]
                at = np.searchsorted(self.keys, pair)
                at[at == len(self.keys)] = 0
                hit = self.keys[at] == pair
                rank[same[hit]] = self.ranks[at[hit]]
            heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, heads)
            spans = np.diff(np.append(heads, n))
            lowest = np.repeat(least, spans)
            live = lowest < none
            if not live.all():  # words without a mergeable pair are done
                done_words.append(word[~live])
                done_symbols.append(symbols[~live])
                symbols, word, rank, lowest = symbols[live], word[live], rank[live], lowest[live]
            if not len(symbols):
                break
            left = rank == lowest
            # in runs of one pair such as a a a, every other occurrence merges, from the left
            at = np.flatnonzero(left)
            chained = np.append(False, at[1:] == at[:-1] + 1)
            if chained.any():
                opens = np.flatnonzero(~chained)
                place = np.arange(len(at)) - np.repeat(opens, np.diff(np.append(opens, len(at))))
                at = at[place % 2 == 0]
            symbols[at] = self.made[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        words = np.concatenate(done_words) if done_words else np.zeros(0, np.int64)
        ids = np.concatenate(done_symbols) if done_symbols else np.zeros(0, np.int64)
        order = np.argsort(words, kind="stable")
        edges = np.searchsorted(words[order], np.arange(len(sizes) + 1))
        flat = ids[order].astype("<u4")
        return [flat[a:b] for a, b in zip(edges[:-1], edges[1:])]

    def merge_long(self, symbols: list[int]) -> np.ndarray:
        """The ids of one long word, by a heap of its pairs: rounds over the whole word would take the square of its length."""
        if not self.pairs:
            self.pairs = {k: (r, m) for k, r, m in zip(self.keys.tolist(), self.ranks.tolist(), self.made[self.ranks].tolist())}
        n, pairs = len(symbols), self.pairs
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(found[0], i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (found := pairs.get(symbols[i] << 32 | symbols[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:  # one of them has merged since
                continue
            symbols[i], symbols[j] = pairs[a << 32 | b][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (found := pairs.get(symbols[x] << 32 | symbols[y])):
                    heapq.heappush(heap, (found[0], x, symbols[x], symbols[y]))
        return np.array([x for x in symbols if x >= 0], "<u4")

    def learn(self, runs: list[str]) -> dict[str, bytes]:
        """Ids, as little-endian 32-bit integers, of runs without white space that hold no special token."""
        pieces: dict[str, int] = {}
        parts = []
        for run in runs:
            if run.isascii():
                text = run.lower()
                if text.isalpha():
                    found = (text,)
                elif text[:-1].isalpha() and not text[-1].isalnum():
                    found = (text[:-1], text[-1])
                else:
                    found = self.pattern.findall(text)
            else:  # the library lowers characters one by one, without a form for word ends
                text = unicodedata.normalize("NFC", run).replace("Σ", "σ").lower()
                found = self.pattern.findall(text)
            parts.append([pieces.setdefault(p, len(pieces)) for p in found])
        if not pieces:
            return {run: b"" for run in runs}
        raw = [p.encode() for p in pieces]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        last = np.cumsum(sizes) - 1
        symbols[last] = self.final[data[last]]
        ids = [x.tobytes() for x in self.merge(symbols, sizes)]
        return {run: b"".join([ids[p] for p in got]) for run, got in zip(runs, parts)}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = []
        for text in texts:
            sections = self.splitter.split(text) if self.splitter and "<|" in text else [text]
            for k, section in enumerate(sections):
                if k % 2 == 0:
                    runs = section.split() if not _NOT_SPACE.search(section) else _runs(section)
                    sections[k] = runs
            split.append(sections)
        if len(self.cache) > REMEMBERED:
            self.cache.clear()
        cache = self.cache
        new = list(dict.fromkeys(r for sections in split for runs in sections[::2] for r in runs if r not in cache))
        if new:
            cache.update(self.learn(new))
        return [
            b"".join([
                self.special[x].to_bytes(4, "little") if k % 2 else b"".join(map(cache.__getitem__, x))
                for k, x in enumerate(sections)
            ])
            for sections in split
        ]

    def decode(self, ids: bytes) -> str:
        """The tokens of the ids, parted by blanks."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _runs(text: str) -> list[str]:
    return [x for part in re.split("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", text) if (x := part)]


@functools.cache
def load(path: str) -> WordBPE:
    return WordBPE(path)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """docs (text, ...) with ids binary (little-endian unsigned 32-bit) and decoded string."""
    prepare(docs.sparkSession)

    def compute(batch):
        model = load(path)
        texts = [t or "" for t in batch.column("text").to_pylist()]
        ids = model.encode(texts)
        return pa.array(ids, pa.binary()), pa.array(map(model.decode, ids), pa.string())

    return with_arrow_columns(docs, "ids binary, decoded string", compute)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """docs (text, ...) with n_tokens, ids_sha256 and decoded_sha256: what encode_decode gives, without moving it."""
    prepare(docs.sparkSession)

    def compute(batch):
        model = load(path)
        ids = model.encode([t or "" for t in batch.column("text").to_pylist()])
        return (
            pa.array([len(x) // 4 for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
            pa.array([hashlib.sha256(model.decode(x).encode()).hexdigest() for x in ids], pa.string()),
        )

    return with_arrow_columns(docs, "n_tokens long, ids_sha256 string, decoded_sha256 string", compute)
