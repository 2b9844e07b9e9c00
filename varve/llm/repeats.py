"""Repeated substrings: bucket-pointer refinement over runs of suffixes.

A byte is removed if a string of ``length`` bytes over it also starts earlier.  The strings are the
suffixes of all texts, known by their first ``length`` bytes.

*Initial buckets.*  A suffix goes to the bucket of the least hash among its q-grams; equal strings
share it, and neighbouring suffixes mostly do, so a whole run of them is one member: about a
thirty-fifth as many members as bytes.

*Refinement.*  Members of a bucket are sorted by the identifier of the string that the run's
suffixes cover together (the hash at the run's later offsets).  Members of one such sub-bucket
repeat its first one, all at once.  Only the first of each sub-bucket, in buckets of more than
one, is open: these are refined again, suffix by suffix, on the identifier of their ``length``
bytes.  The same routine sorts and reads both levels.

Every task first refines what it holds itself and passes on one member a sub-bucket, so that a
string that a third of the texts share is a row a task, not a row a text; buckets are read as a
stream that remembers one row.

Results: matches never cross documents; null texts are empty; documents order by doc_id, nulls
first; rows with the same doc_id and text are one document, other rows with the same doc_id
order by a hash of their text.  Rows without doc_id are known by 62 bits of their text's hash, as
ids below -2**62, which real ids must not use; so they are no group of one key.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varve.llm.common import kept, slices, stored, unused

LENGTH, GRAM = 100, 32
# Members a task refines together before it passes them on.
_HELD = 1_000_000
_BASE = 0x9E3779B97F4A7C15
_MEMBER, _SPAN = 0, 1
_FIELDS = ["kind", "bucket", "sub", "doc", "at"]
_ROWS = "kind int, bucket bigint, sub bigint, doc bigint, at bigint"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Hashes:
    """Hash of any stretch of ``data`` in constant time: polynomial prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray):
        up, down = _powers(len(data) + 1)
        self.up = up
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        return _mix((self.sums[starts + lengths] - self.sums[starts]) * self.up[starts])

    def grams(self, size: int) -> np.ndarray:
        n = max(0, len(self.sums) - size)
        return _mix((self.sums[size:] - self.sums[:n]) * self.up[:n])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(21, (n - 1).bit_length())

    def make() -> tuple[np.ndarray, np.ndarray]:
        base, inverse = _BASE, pow(_BASE, -1, 1 << 64)
        both = []
        for b in (base, inverse):
            steps = np.full(size, b, dtype=np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        return both[0], both[1]

    return kept(("powers", size), make)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values, by doubling."""
    out, have = x, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out


def _text_key(raw: bytes) -> int:
    """Tells texts of one doc_id apart; 23 bits are what a place leaves free."""
    return zlib.crc32(raw) & 0x7FFFFF


def _doc(doc_id: str = "doc_id", text: str = "text") -> Column:
    """doc_id, or an id below all others from the text's hash."""
    hashed = F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 2)
    return F.coalesce(F.col(doc_id).cast("bigint"), F.lit(-(1 << 62) - 1) - hashed)


class _Slice:
    """Documents of a slice as one byte string, with where each begins."""

    def __init__(self, part: pa.RecordBatch, length: int):
        self.raw = [(t or "").encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()]
        self.data = np.frombuffer(b"".join(self.raw), dtype=np.uint8)
        self.sizes = np.array([len(r) for r in self.raw], dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.docs = part.column("doc").to_numpy()
        self.keys = np.array([_text_key(r) if len(r) >= length else 0 for r in self.raw], dtype=np.int64)


def _runs(s: _Slice, length: int, gram: int) -> tuple[np.ndarray, ...] | None:
    """(bucket, sub, doc row, start, count) of the runs of suffixes that share a bucket."""
    n = len(s.data)
    if not (s.sizes >= length).any():
        return None
    hashes = Hashes(s.data)
    width = length - gram + 1
    grams = hashes.grams(gram)
    least = _sliding_min(grams, width)[: n - length + 1]
    owner = np.repeat(np.arange(len(s.sizes)), s.sizes)[: len(least)]
    places = np.arange(len(least))
    valid = places + length <= s.ends[owner]
    new = np.ones(len(least), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new & valid)
    # A run ends before the next one begins, or with its document's last suffix.
    border = np.flatnonzero(new | ~valid)
    following = np.append(border, len(least))[np.searchsorted(border, first, side="right")]
    count = following - first
    # Where the least hash stands more than once, the text repeats itself within the run: its
    # suffixes are members one by one.
    reach = count + width - 1
    seen = np.repeat(first - np.cumsum(reach) + reach, reach)
    seen += np.arange(len(seen))
    ties = np.add.reduceat(grams[seen] == np.repeat(least[first], reach), np.cumsum(reach) - reach, dtype=np.int64)
    if (alone := ties > 1).any():
        pieces = np.where(alone, count, 1)
        step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first, count = np.repeat(first, pieces) + step, np.repeat(np.where(alone, 1, count), pieces)
    sub = hashes.of(first, count + length - 1) ^ _mix(count.astype(np.uint64))
    doc = owner[first]
    return least[first].view(np.int64), sub.view(np.int64), doc, first - s.starts[doc], count


def _pack(key: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Key, place (texts are shorter than 4 GB) and count of a run in one number."""
    return (key << 40) | (start << 8) | count


def _unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 40, (at >> 8) & ((1 << 32) - 1), at & 255


def _batch(kind: int, bucket, sub, doc, at) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(doc), kind, dtype=np.int32)), *(pa.array(np.asarray(c, dtype=np.int64)) for c in (bucket, sub, doc, at))],
        _FIELDS,
    )


def _spans(doc: np.ndarray, at: np.ndarray, length: int) -> pa.RecordBatch:
    """Removed bytes of repeating runs, touching ones of a document in one row (sub: its end)."""
    key, start, count = _unpack(at)
    order = np.lexsort((start, key, doc))
    doc, key, start, end = doc[order], key[order], start[order], (start + count + length - 1)[order]
    if len(doc):
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
        # The running greatest end, within each document: documents are set far apart for it.
        apart = np.cumsum(new) << 37
        far = new.copy()
        far[1:] |= start[1:] + apart[1:] > np.maximum.accumulate(end + apart)[:-1]
        group = np.cumsum(far) - 1
        top = np.zeros(group[-1] + 1, dtype=np.int64)
        np.maximum.at(top, group, end)
        doc, key, start, end = doc[far], key[far], start[far], top
    return _batch(_SPAN, _mix(doc.view(np.uint64) + key.view(np.uint64)).view(np.int64), end, doc, _pack(key, start, np.zeros_like(start)))


class _Held:
    """Members a task has met, refined among themselves before they are passed on."""

    def __init__(self, length: int):
        self.length, self.parts, self.size = length, [], 0

    def add(self, bucket, sub, doc, at) -> Iterator[pa.RecordBatch]:
        self.parts.append((bucket, sub, doc, at))
        self.size += len(doc)
        if self.size >= _HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        bucket, sub, doc, at = (np.concatenate(c) for c in zip(*self.parts))
        self.parts, self.size = [], 0
        order = np.lexsort((at, doc, sub, bucket))
        bucket, sub, doc, at = bucket[order], sub[order], doc[order], at[order]
        first = np.ones(len(doc), dtype=bool)
        first[1:] = (bucket[1:] != bucket[:-1]) | (sub[1:] != sub[:-1])
        # The same row of the same document told twice is not a repeat.
        again = np.zeros(len(doc), dtype=bool)
        again[1:] = ~first[1:] & (doc[1:] == doc[:-1]) & (at[1:] == at[:-1])
        if (~first & ~again).any():
            yield _spans(doc[~first & ~again], at[~first & ~again], self.length)
        yield _batch(_MEMBER, bucket[first], sub[first], doc[first], at[first])


def _refined(rows: DataFrame, length: int) -> DataFrame:
    """Sort buckets by sub-bucket and read them: spans of repeats; open members stay members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: np.ndarray | None = None  # bucket, sub, doc, at of the row before
        waiting: np.ndarray | None = None  # first row of the bucket, if no second sub-bucket was met
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            if (kind == _SPAN).any():
                yield batch.filter(pa.array(kind == _SPAN))
            cols = np.stack([batch.column(c).to_numpy()[kind == _MEMBER] for c in _FIELDS[1:]])
            if not cols.shape[1]:
                continue
            before = np.concatenate([cols[:, :1] if last is None else last[:, None], cols[:, :-1]], axis=1)
            new_bucket, new_sub = cols[0] != before[0], cols[1] != before[1]
            if last is None:
                new_bucket[0] = True
            last = cols[:, -1].copy()
            told = ~new_bucket & ~new_sub & (cols[2] == before[2]) & (cols[3] == before[3])
            repeat = ~new_bucket & ~new_sub & ~told
            if repeat.any():
                yield _spans(cols[2][repeat], cols[3][repeat], length)
            heads = cols[:, new_bucket | new_sub]
            opens = new_bucket[new_bucket | new_sub]
            if waiting is not None:
                heads = np.concatenate([waiting[:, None], heads], axis=1)
                opens = np.concatenate([[True], opens])
            if not heads.shape[1]:
                continue
            # A head that opens a bucket stays open only if another sub-bucket follows it.
            followed = np.append(~opens[1:], False)
            stay = ~opens | followed
            waiting = heads[:, -1].copy() if opens[-1] else None
            if stay.any():
                yield _batch(_MEMBER, *heads[:, stay])

    return rows.repartition("bucket").sortWithinPartitions("bucket", "sub", "doc", "at").mapInArrow(run, _ROWS)


def _members(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Runs of all texts, refined by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(length)
        for batch in batches:
            for part in slices(batch, "text"):
                s = _Slice(part, length)
                if found := _runs(s, length, gram):
                    bucket, sub, doc, start, count = found
                    yield from held.add(bucket, sub, s.docs[doc], _pack(s.keys[doc], start, count))
        yield from held.flush()

    return docs.select(_doc().alias("doc"), "text").mapInArrow(run, _ROWS)


def _suffixes(texts: DataFrame, length: int) -> DataFrame:
    """Suffixes of the open runs (``open``: their places) of ``texts``, refined by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(length)
        for batch in batches:
            for part in slices(batch, "text"):
                s = _Slice(part, length)
                hashes = Hashes(s.data)
                lists = part.column("open")
                at = lists.flatten().to_numpy()
                row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                key, start, count = _unpack(at)
                mine = key == s.keys[row]
                row, start, count = row[mine], start[mine], count[mine]
                each = np.repeat(np.arange(len(row)), count)
                place = start[each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
                row = row[each]
                names = hashes.of(s.starts[row] + place, length).view(np.int64)
                ones = np.ones_like(place)
                yield from held.add(names, names, s.docs[row], _pack(s.keys[row], place, ones))
        yield from held.flush()

    return texts.mapInArrow(run, _ROWS)


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc, key, start, end): bytes to remove, document by document; spans may overlap.

    ``doc`` is doc_id (see ``_doc`` for null), ``key`` tells texts of one doc_id apart.
    """
    first = stored(_refined(_members(docs, length, gram), length))
    open_runs = first.where(F.col("kind") == _MEMBER).groupBy("doc").agg(F.collect_list("at").alias("open"))
    again = docs.select(_doc().alias("doc"), "text").join(open_runs, "doc").select("doc", "text", "open")
    second = stored(_refined(_suffixes(again, length), length).where(F.col("kind") == _SPAN))
    return (
        first.where(F.col("kind") == _SPAN)
        .unionByName(second)
        .select("doc", F.shiftright("at", 40).alias("key"), F.shiftright("at", 8).bitwiseAND(F.lit((1 << 32) - 1)).alias("start"), F.col("sub").alias("end"))
    )


def remove(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with kept (binary: the bytes that remain), n_bytes, n_removed, n_spans."""
    doc, cut = unused(docs, "_doc"), unused(docs, "_cut")
    found = (
        spans(docs, length, gram)
        .groupBy(F.col("doc").alias(doc))
        .agg(F.collect_list(F.struct("key", "start", "end")).alias(cut))
    )
    rows = docs.withColumn(doc, _doc()).join(found, doc, "left").drop(doc)
    made = ["kept", "n_bytes", "n_removed", "n_spans"]
    given = [f for f in docs.schema.fields if f.name not in made]
    schema = T.StructType([*given, T.StructField("kept", T.BinaryType()), *(T.StructField(m, T.LongType()) for m in made[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, cuts in zip(batch.column("text").to_pylist(), batch.column(cut).to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                key = _text_key(raw) if len(raw) >= length else 0
                kept_parts, at, n_spans, reach = [], 0, 0, -1
                for c in sorted((c["start"], c["end"]) for c in cuts or () if c["key"] == key):
                    if c[0] > reach:
                        n_spans += 1
                        kept_parts.append(raw[at : c[0]])
                    reach = max(reach, c[1])
                    at = reach
                kept_parts.append(raw[at:])
                left = b"".join(kept_parts)
                out.append((left, len(raw), len(raw) - len(left), n_spans))
            columns = list(zip(*out)) or [()] * 4
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in given), *(pa.array(c, type=k) for c, k in zip(columns, kinds))],
                [*(f.name for f in given), *made],
            )

    return rows.mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return remove(docs.select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
