"""Exact substring deduplication by Rabin-Karp hashes of every fixed-length word window.

Every window gets two independent hashes: 56 bits of the first, and a hash range from the second. A map task first
settles repeats among its own documents (so a passage that a third of all documents share leaves each task once), then
sends one entry for each distinct window, packed by hash range. For each hash, documents above the smallest doc_id lose
that window. Overlapping and adjoining windows merge into maximal removal intervals when the texts are read again.

Two different windows are taken for one if both their 56 bits and their ranges agree: with 256 ranges (the least)
with probability 2**-64, with 60,000 (the most) 2**-71.9. Of 10**13 distinct windows some 10,000 pairs would so
agree, and words removed wrongly for it are at most 13 each; windows of one map task agree on 64 bits.

Memory: a map task holds at most FLUSH windows; a reduce task holds one hash range at a time, of which there are eight
for each shuffle partition, and the repeats that it has found, which it sends on every FLUSH / 2. Ranges and buckets of
documents are dealt to tasks evenly.

Edge cases: null texts have no words; texts shorter than the window lose nothing; rows of equal doc_id are one
document and never remove each other's words; rows with a null doc_id neither cause nor suffer removals, and are spread
over all buckets by their text. Extra columns pass through; those that have an output's name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, partitions
from .hashing import pieces, second_hashes, window_hashes, word_hashes, words_of

#: Windows that a map task holds before it sends them on.
FLUSH = 2_500_000
_FOUND = "_bucket long, _docs binary, _counts binary, _hashes binary"
_PACKED = "range int, settled boolean, docs binary, counts binary, hashes binary"


def _ranges_of(second: np.ndarray, ranges: int) -> np.ndarray:
    return ((second >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.uint16)


def _codes(hashes: np.ndarray, part: np.ndarray | int) -> np.ndarray:
    """What tells a window among those of one document: 56 bits of its hash and 8 of its range."""
    return (hashes & np.uint64((1 << 56) - 1)) | (np.asarray(part, np.uint64) & np.uint64(255)) << np.uint64(56)


def _split(hashes: np.ndarray, part: np.ndarray, docs: np.ndarray, settled: bool) -> list[tuple]:
    """Rows of _PACKED from entries that stand in document order."""
    if not len(hashes):
        return []
    order = np.argsort(part, kind="stable")
    part, hashes, docs = part[order], hashes[order], docs[order]
    new = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (docs[1:] != docs[:-1])])
    lengths, run_part, run_doc = np.diff(np.r_[new, len(part)]).astype(np.int32), part[new], docs[new]
    rows, runs = [], np.flatnonzero(np.r_[True, run_part[1:] != run_part[:-1]])
    for a, b in zip(runs, [*runs[1:], len(new)], strict=True):
        x, y = new[a], new[b] if b < len(new) else len(part)
        rows.append((int(run_part[a]), settled, run_doc[a:b].tobytes(), lengths[a:b].tobytes(), low_bytes(hashes[x:y])))
    return rows


def low_bytes(hashes: np.ndarray) -> bytes:
    """The low 56 bits of each hash."""
    return np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def from_bytes(packed: bytes) -> np.ndarray:
    raw = np.zeros((len(packed) // 7, 8), np.uint8)
    raw[:, :7] = np.frombuffer(packed, np.uint8).reshape(-1, 7)
    return raw.reshape(-1).view(np.uint64)


def repeated(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries have a smaller document with the same hash; which are the one entry to keep for their hash."""
    if not len(hashes):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.argsort(hashes)
    h, d = hashes[order], docs[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    size = np.diff(np.r_[first, len(h)])
    least = np.repeat(np.minimum.reduceat(d, first), size)
    later, keep = np.empty(len(h), bool), np.zeros(len(h), bool)
    later[order] = d > least
    same = np.flatnonzero(d == least)
    group = np.repeat(np.arange(len(first)), size)[same]
    keep[order[same[np.r_[True, group[1:] != group[:-1]]]]] = True
    return later, keep


def _windows(n: int, ranges: int):
    def flush(hashes, parts, docs):
        h, p, d = np.concatenate(hashes), np.concatenate(parts), np.concatenate(docs)
        later, keep = repeated(h, d)
        rows = _split(h[keep], p[keep], d[keep], False) + _split(h[later], p[later], d[later], True)
        for a in range(0, len(rows), 64):
            cols = list(zip(*rows[a : a + 64], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1]), *(pa.array(c, pa.binary()) for c in cols[2:])], ["range", "settled", "docs", "counts", "hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, parts, docs, held = [], [], [], 0
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            for x, y in pieces(texts):
                words, counts = word_hashes(texts[x:y])
                h, windows = window_hashes(words, counts, n)
                hashes.append(h)
                parts.append(_ranges_of(second_hashes(words, counts, n), ranges))
                docs.append(np.repeat(ids[x:y], windows))
                held += len(h)
            if held >= FLUSH:
                yield from flush(hashes, parts, docs)
                hashes, parts, docs, held = [], [], [], 0
        if held:
            yield from flush(hashes, parts, docs)

    return run


def buckets_for(n: int) -> int:
    """The first prime from n on."""
    return next(x for x in range(max(n, 2), 2 * n + 3) if all(x % y for y in range(2, int(x**0.5) + 1)))


def _settle(buckets: int):
    """Per hash range: each document's hashes that a smaller document has, packed by bucket of documents, from rows sorted by range."""

    def of_range(rows):
        docs = np.concatenate([np.repeat(np.frombuffer(r[2], np.int64), np.frombuffer(r[3], np.int32)) for r in rows])
        hashes = _codes(np.concatenate([from_bytes(r[4]) for r in rows]), rows[0][0])
        settled = np.repeat([r[1] for r in rows], [len(r[4]) // 7 for r in rows])
        open_h, open_d = hashes[~settled], docs[~settled]
        later, _ = repeated(open_h, open_d)
        return np.concatenate([open_h[later], hashes[settled]]), np.concatenate([open_d[later], docs[settled]])

    def out(found):
        h, d = (np.concatenate(x) for x in zip(*found, strict=True))
        bucket = np.mod(d, buckets).astype(np.int64)
        order = np.lexsort((d, bucket))
        h, d, bucket = h[order], d[order], bucket[order]
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(d) else []
        rows = []
        for x, y in zip(cuts, [*cuts[1:], len(d)], strict=False):
            docs, counts = np.unique(d[x:y], return_counts=True)
            rows.append((int(bucket[x]), docs.tobytes(), counts.astype(np.int32).tobytes(), h[x:y].tobytes()))
        for a in range(0, len(rows), 64):
            cols = list(zip(*rows[a : a + 64], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["_bucket", "_docs", "_counts", "_hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        found: list[tuple] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if rows and rows[0][0] != row[0]:
                    found.append(of_range(rows))
                    rows = []
                    if sum(len(h) for h, _ in found) > FLUSH // 2:
                        yield from out(found)
                        found = []
                rows.append(row)
        if rows:
            found.append(of_range(rows))
        if found:
            yield from out(found)

    return run


def repeated_windows(docs: DataFrame, n: int = 13, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, int, int]:
    """For each bucket of documents (key modulo the returned number) the codes of their windows that also start in a smaller document; and the number of ranges."""
    spark = docs.sparkSession
    bounded_batches(spark)
    ranges, buckets = min(max(256, 8 * partitions(spark)), 60_000), buckets_for(4 * partitions(spark))
    source = docs.where(docs[key].isNotNull() & docs[text].isNotNull()).select(docs[key].cast("long").alias("k"), docs[text].cast("binary").alias("t"))
    packed = source.mapInArrow(_windows(n, ranges), _PACKED)
    parts = partitions(spark)
    by_range = packed.repartitionById(parts, F.col("range") % parts).sortWithinPartitions("range")
    return by_range.mapInArrow(_settle(buckets), _FOUND), buckets, ranges


class _Found:
    """The repeated hashes of one bucket's documents."""

    def __init__(self):
        self.rows, self.docs = [], None

    def add(self, docs: bytes, counts: bytes, hashes: bytes):
        self.rows.append((np.repeat(np.frombuffer(docs, np.int64), np.frombuffer(counts, np.int32)), np.frombuffer(hashes, np.uint64)))

    def of(self, doc: int | None) -> np.ndarray:
        if doc is None or not self.rows:
            return np.empty(0, np.uint64)
        if self.docs is None:
            d, h = (np.concatenate(x) for x in zip(*self.rows, strict=True))
            order = np.argsort(d, kind="stable")
            self.docs, self.hashes = d[order], h[order]
        a, b = np.searchsorted(self.docs, [doc, doc + 1])
        return self.hashes[a:b]


#: What the operator adds to its input.
OUTPUTS = ("n_words", "n_removed", "kept_text", "removed_spans")


def _cover(n: int, ranges: int, keep: list[int], names: list[str], key: int, text: int):
    """Drop the covered words. Rows come by bucket, those with the bucket's repeated windows first; `row` holds the input's columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, found = None, _Found()
        for b in batches:
            where, docs, counts, hashes = (b.column(i).to_pylist() for i in range(4))
            own = b.column(4).flatten()
            keys, rows = own[key].to_pylist(), [i for i, x in enumerate(docs) if x is None]
            take = pa.array(rows, pa.int64())
            texts = dict(zip(rows, own[text].take(take).to_pylist(), strict=True))
            kept, n_words, n_removed, spans = [], [], [], []
            for i in range(b.num_rows):
                if where[i] != bucket:
                    bucket, found = where[i], _Found()
                if i not in texts:
                    found.add(docs[i], counts[i], hashes[i])
                    continue
                t = (texts[i] or "").encode()
                words, repeated = words_of(t), found.of(keys[i])
                removed, gaps = 0, []
                if len(repeated) and len(words) >= n:
                    hashed, count = word_hashes([t])
                    h, _ = window_hashes(hashed, count, n)
                    hit = np.flatnonzero(np.isin(_codes(h, _ranges_of(second_hashes(hashed, count, n), ranges)), repeated))
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, hit, 1)
                    np.add.at(edge, hit + n, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed = int(gone.sum())
                    turn = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                    gaps = [{"start": int(x), "end": int(y)} for x, y in turn.reshape(-1, 2)]
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                kept.append(b" ".join(words).decode())
                n_words.append(len(words) + removed)
                n_removed.append(removed)
                spans.append(gaps)
            made = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            yield pa.RecordBatch.from_arrays([*(own[i].take(take) for i in keep), *made], names)

    return run


def dedup_substrings(docs: DataFrame, n: int = 13, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with n_words, n_removed, kept_text (kept words joined by one space) and removed_spans (word offsets, end exclusive)."""
    found, buckets, ranges = repeated_windows(docs, n, key, text)
    spread = F.coalesce(docs[key].cast("long"), F.xxhash64(docs[text]))
    none = lambda c: F.lit(None).cast("binary").alias(c)
    whole = docs.select(F.pmod(spread, F.lit(buckets)).cast("long").alias("_bucket"), none("_docs"), none("_counts"), none("_hashes"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    both = whole.unionByName(found, allowMissingColumns=True)
    parts = partitions(docs.sparkSession)
    placed = both.repartitionById(parts, (F.col("_bucket") % parts).cast("int")).sortWithinPartitions("_bucket", F.col("_docs").isNull())
    keep = [i for i, c in enumerate(docs.columns) if c.lower() not in OUTPUTS]
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    made = [T.StructField(c, t) for c, t in zip(OUTPUTS, (T.LongType(), T.LongType(), T.StringType(), span), strict=True)]
    schema = T.StructType([*(docs.schema.fields[i] for i in keep), *made])
    return placed.mapInArrow(_cover(n, ranges, keep, schema.names, docs.columns.index(key), docs.columns.index(text)), schema)
