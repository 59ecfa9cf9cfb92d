"""BPE encoding and decoding with forced boundaries.

A byte pair that lies inside no vocabulary token can never be merged across, so the place between its two bytes is a
certain token boundary. Every pre-token is cut at such places; the fragments are merged independently (and cached, as
they recur) and their ids are concatenated.

Edge cases: null and empty texts have no ids and decode to the empty text. The literal strings of special tokens in a
text become their ids, as in the tokenizers library. Very long pre-tokens take a heap, so time stays n log n. Repeated
rows give equal results; other columns pass through, and a column that has an output's name is replaced.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bounded_batches

#: Pre-tokens kept per worker, and the characters of the longest that is kept; the cache is emptied when full, which bounds memory
#: and changes no result.
CACHE, KEPT = 150_000, 64
#: Fragments of more bytes than this are merged one by one with a heap.
LONG = 512
_NONE = np.int32(2**31 - 1)


def _ranges(prop: str, top: int) -> str:
    """A character class body with the code points up to `top` that have a Unicode property."""
    hits = [m.span() for m in regex.finditer(prop + "+", "".join(map(chr, range(0xD800))))]
    hits += [(a + 0xE000, b + 0xE000) for a, b in (m.span() for m in regex.finditer(prop + "+", "".join(map(chr, range(0xE000, top)))))]
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b - 1))}" for a, b in hits)


def pretoken_pattern(top: int) -> re.Pattern:
    """The published pre-tokenising pattern of byte-level BPE, for texts whose code points lie below `top`.

    White space is Unicode's White_Space, as the tokenizer's own pattern engine has it; Python's also holds U+001C to U+001F.
    """
    letter, number = _ranges(r"\p{L}", top), _ranges(r"\p{N}", top)
    space = _ranges(r"\p{White_Space}", top)
    return re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """Vocabulary, merge ranks and the byte pairs that occur inside tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_alphabet()
        as_bytes = lambda token: bytes(back[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = {as_bytes(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.tokens: list[bytes] = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for t, i in ids.items():
            self.tokens[i] = t
        for t, i in self.special.items():
            self.tokens[i] = t.encode()
        self.byte_id = [ids[bytes([b])] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            left, right = map(as_bytes, m.split(" ") if isinstance(m, str) else m)
            self.merges[ids[left], ids[right]] = (rank, ids[left + right])
        self.made = np.array([new for _, new in self.merges.values()], dtype=np.int32)
        self._hash_merges()
        self.joined = np.zeros((256, 256), dtype=bool)
        for t in ids:
            if len(t) > 1:
                b = np.frombuffer(t, dtype=np.uint8)
                self.joined[b[:-1], b[1:]] = True
        self.plain, self.astral = pretoken_pattern(0x10000), pretoken_pattern(0x110000)
        self.is_astral = re.compile("[\U00010000-\U0010ffff]")
        self.bytes_id = np.array(self.byte_id, dtype=np.int32)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}

    def _hash_merges(self, bits: int = 18) -> None:
        """An open hash table of the merges, so that many pairs can be looked up at once."""
        self.shift, size = np.uint64(64 - bits), 1 << bits
        self.slot_key, self.slot_rank = np.full(size, -1, dtype=np.int64), np.full(size, _NONE, dtype=np.int32)
        for (a, b), (rank, _) in self.merges.items():
            key = a << 32 | b
            at = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - bits
            while self.slot_key[at] >= 0:
                at = (at + 1) % size
            self.slot_key[at], self.slot_rank[at] = key, rank

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        found = self.slot_key[at]
        out = np.where(found == key, self.slot_rank[at], _NONE)
        rest = np.flatnonzero((found != key) & (found >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & (len(self.slot_key) - 1)
            found = self.slot_key[at[rest]]
            hit = found == key[rest]
            out[rest[hit]] = self.slot_rank[at[rest[hit]]]
            rest = rest[(found >= 0) & ~hit]
        return out

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """Ids, packed as int32, of many non-empty words at once: each round applies every fragment's lowest-ranked merge."""
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        sizes = np.array(list(map(len, words)))
        word = np.repeat(np.arange(len(words)), sizes)
        cut = np.ones(len(data), dtype=bool)
        cut[1:] = ~self.joined[data[:-1], data[1:]] | (word[1:] != word[:-1])
        frag = np.cumsum(cut) - 1
        frag_size = np.bincount(frag)
        ids, place = self.bytes_id[data], np.arange(len(data))
        done_ids, done_place = [], []
        for f in np.flatnonzero(frag_size > LONG).tolist():
            own = np.flatnonzero(frag == f)
            got = self._merge_long(ids[own].tolist())
            done_ids.append(np.array(got, dtype=np.int32))
            done_place.append(own[: len(got)])
        live = frag_size[frag] <= LONG
        ids, place, frag = ids[live], place[live], frag[live]
        while len(ids):
            rank = np.full(len(ids), _NONE, dtype=np.int32)
            same = np.flatnonzero(frag[1:] == frag[:-1])
            rank[same] = self.ranks(ids[same], ids[same + 1])
            first = np.flatnonzero(np.r_[True, frag[1:] != frag[:-1]])
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(ids)]))
            live = best != _NONE
            done_ids.append(ids[~live])
            done_place.append(place[~live])
            at = np.flatnonzero(live & (rank == best))
            if len(at):  # of overlapping equal pairs, every other one from the left
                run = np.r_[True, at[1:] != at[:-1] + 1]
                at = at[(at - at[np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))]) % 2 == 0]
                ids[at] = self.made[rank[at]]
                live[at + 1] = False
            ids, place, frag = ids[live], place[live], frag[live]
        ids, place = np.concatenate(done_ids), np.concatenate(done_place)
        order = np.argsort(place, kind="stable")
        counts = np.bincount(word[place], minlength=len(words))
        packed, ends = ids[order].astype(np.int32).tobytes(), (np.cumsum(counts) * 4).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, merges = len(ids), self.merges
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(*m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heap = [(rank, i, new, a, b) for rank, new, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and (right := after[left]) >= 0 and (m := merges.get((ids[left], ids[right]))):
                    heapq.heappush(heap, (m[0], left, m[1], ids[left], ids[right]))
        return [x for x in ids if x >= 0]

    def pretokens(self, text: str) -> list[str]:
        return (self.astral if self.is_astral.search(text) else self.plain).findall(text)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        words: list[list[str]] = []
        for text in texts:
            own = []
            for part in self.split.split(text) if self.split and any(s in text for s in self.special) else [text]:
                own += [part] if part in self.special else self.pretokens(part)
            words.append(own)
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        cache.update((s, np.int32(i).tobytes()) for s, i in self.special.items())
        got = [list(map(cache.get, own)) for own in words]
        short = [k for k, g in enumerate(got) if None in g]
        missing = list({w for k in short for w, g in zip(words[k], got[k], strict=True) if g is None})
        fresh = dict(zip(missing, self.merge_all([w.encode() for w in missing]), strict=True)) if missing else {}
        for k in short:
            got[k] = [fresh[w] if g is None else g for w, g in zip(words[k], got[k], strict=True)]
        cache.update((w, ids) for w, ids in fresh.items() if len(w) <= KEPT)
        return [np.frombuffer(b"".join(g), dtype=np.int32) for g in got]

    def decode(self, ids) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _replacing(df: DataFrame, outs: list[tuple[str, T.DataType]]) -> tuple[list[int], T.StructType]:
    """The places of the columns that pass through, and the schema with the outputs behind them."""
    taken = {name.lower() for name, _ in outs}
    keep = [i for i, f in enumerate(df.schema.fields) if f.name.lower() not in taken]
    return keep, T.StructType([*(df.schema.fields[i] for i in keep), *(T.StructField(n, t) for n, t in outs)])


def encode(df: DataFrame, vocab_path: str, text: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """`df` with a column `out` (array<int>) of the token ids of column `text`.

    `decoded` names one more column (string), what the ids decode to: both in one pass over the texts.
    """
    bounded_batches(df.sparkSession)
    keep, schema = _replacing(df, [(out, T.ArrayType(T.IntegerType())), *([(decoded, T.StringType())] if decoded else [])])
    at, names = df.columns.index(text), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocab_path)
        for b in batches:
            ids = c.encode_batch([x or "" for x in b.column(at).to_pylist()])
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            packed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))
            texts = [pa.array([c.decode(x.tolist()) for x in ids], pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), packed, *texts], names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, vocab_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`df` with a column `out` (string): the ids' bytes joined and read as UTF-8, invalid bytes replaced; null ids give the empty text."""
    bounded_batches(df.sparkSession)
    keep, schema = _replacing(df, [(out, T.StringType())])
    at, names = df.columns.index(ids), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocab_path)
        for b in batches:
            texts = pa.array([c.decode(x or ()) for x in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), texts], names)

    return df.mapInArrow(run, schema)
