"""Benchmark decontamination by latent semantic retrieval.

1. Terms of benchmark passages are weighted by their inverse document frequency in the whole
   corpus; terms in more than ``common`` of the documents weigh nothing, except in items that
   would keep fewer than four terms without them.
2. A randomised SVD of the TF-IDF matrix of the benchmark's passages gives the latent space: a
   random sketch, sharpened by power iterations, each a pass of Spark tasks over the rows that
   add up partial products; orthonormalised on the driver.  It has at most half as many dimensions
   as there are items, so items that share terms move together.  Items the space holds less
   than half of are kept as they are, on an axis of their own beside it.
3. Documents are read in overlapping windows of words, and every window is projected into the space.
   An item is retrieved where the cosine of window and item is at least ``near`` and the window
   holds ``held`` of the item's length.
4. Candidates are verified on words: the longest common subsequence of item and window, and
   for partial matches the item's answer (its last sentence, or the column ``answer``), whose
   rare words must be there.  What the space retrieved needs less common order (``loosely``).
5. Rare words weigh most in the space, so a leak that changed them may not be near.  Beside the
   retrieval, every window that holds ``partly`` of the item's words, frequent ones included, is a
   candidate, too: none that has so much in common order is lost, whatever words were changed.

What is broadcast is the benchmark's: terms x items in blocks of ``block`` items.

Results: nulls and texts without words neither match nor are matched; a document appears once
for each item it leaks (the best window).  Repeated items match each under its own id.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.llm.common import WordCache, slices, stored, strings, tidy

_EDGE = re.compile(r"^\W+|\W+$")
# Arrow lowers code points below 0x250 as Python does but for one; words that hold others are looked up one by one.
_ODD = r"[^\x{0}-\x{24f}]|\x{130}"
_EDGES = "".join(c for c in map(chr, range(0x250)) if re.match(r"\W", c))
# Odd words a worker remembers: frequent ones stay.
CACHED = 200_000
SCHEMA = "doc_id bigint, item_id bigint, cosine double, lcs double, answer double"


@dataclass(frozen=True)
class Settings:
    """``same``: share of the item's words in common order that settles it;
    ``partly``: the share that needs ``answer`` of the answer's rare words as well;
    ``loosely``: the same for what the latent space retrieved."""

    rank: int = 128
    power: int = 2
    common: float = 0.01
    block: int = 256
    same: float = 0.8
    partly: float = 0.6
    loosely: float = 0.45
    answer: float = 0.6
    near: float = 0.7
    held: float = 0.4
    seed: int = 3


def words_of(text: str) -> list[str]:
    """Words in lower case, without punctuation at their ends; pure punctuation gives none."""
    return [w for w in (_EDGE.sub("", p) for p in text.lower().split()) if w]


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence."""
    places = _places(a)
    return _common_order(len(a), [places[w] for w in b if w in places])


def _places(a: list) -> dict:
    """Where each word of ``a`` stands, as bits."""
    places: dict = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    return places


def _common_order(size: int, met: list[int]) -> int:
    """Length of the longest common subsequence of ``size`` words with those that stand ``met`` there: one big integer
    holds a row of the table."""
    full = (1 << size) - 1
    row = full
    for hit in met:
        both = row & hit
        row = ((row + both) | (row - both)) & full
    return size - row.bit_count()


def hits(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Per document, where benchmark terms stand: doc_id, at and term (int32 arrays as binary).

    Texts are split once; counting and searching read these arrays, not texts.
    """
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {t: i for i, t in enumerate(sent.value)}
        known = pa.array(sent.value, type=pa.string())
        cache = WordCache(lambda ws: [index.get(_EDGE.sub("", w.lower()), -1) for w in ws], CACHED)
        for batch in batches:
            for part in slices(batch, "text"):
                # Arrow's white space is that of str.split().
                text = pc.fill_null(part.column("text"), "")
                cut = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(text))
                words = cut.flatten()
                plain = pc.utf8_trim(pc.utf8_lower(words), characters=_EDGES)
                found = pc.fill_null(pc.index_in(plain, value_set=known), -1).to_numpy().astype(np.int32)
                if pc.any(pc.match_substring_regex(text, _ODD)).as_py():
                    odd = np.flatnonzero(pc.match_substring_regex(words, _ODD).to_numpy(zero_copy_only=False))
                    coded = words.take(pa.array(odd)).dictionary_encode()
                    found[odd] = np.array(cache.of(strings(coded.dictionary)), dtype=np.int32)[coded.indices.to_numpy()]
                places = np.flatnonzero(found >= 0)
                starts = np.concatenate([[0], np.cumsum(pc.list_value_length(cut).to_numpy())])
                bounds = np.searchsorted(places, starts).tolist()
                at, term = [], []
                for first, a, b in zip(starts.tolist(), bounds[:-1], bounds[1:]):
                    at.append((places[a:b] - first).astype(np.int32).tobytes())
                    term.append(found[places[a:b]].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(at, type=pa.binary()), pa.array(term, type=pa.binary())], ["doc_id", "at", "term"]
                )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id bigint, at binary, term binary")


def document_frequency(found: DataFrame, width: int) -> tuple[np.ndarray, int]:
    """Documents that hold each term, and documents that hold any: one pass over ``hits``, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(width, dtype=np.int64), 0
        for batch in batches:
            for raw in batch.column("term").to_pylist():
                held = np.unique(np.frombuffer(raw, dtype=np.int32))
                counts[held] += 1
                total += len(held) > 0
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *at.tolist()], type=pa.int64()), pa.array([total, *counts[at].tolist()], type=pa.int64())], ["term", "n"]
        )

    summed = found.select("term").mapInArrow(tidy(run), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out, total = np.zeros(width), 0
    for term, n in zip(summed.column("term").to_pylist(), summed.column("n").to_pylist()):
        if term < 0:
            total = n
        else:
            out[term] = n
    return out, total


def randomised_svd(rows: DataFrame, width: int, s: Settings, count: int) -> np.ndarray:
    """Right singular vectors (width x rank) of the ``count`` sparse ``rows`` (at array<int>, weight array<double>)."""
    wanted = min(s.rank, max(1, count // 2), width)
    basis = np.linalg.qr(np.random.default_rng(s.seed).normal(size=(width, min(width, wanted + 16))))[0]

    def product(basis: np.ndarray) -> np.ndarray:
        sent = rows.sparkSession.sparkContext.broadcast(basis)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b, total = sent.value, None
            for batch in batches:
                for at, weight in zip(batch.column("at").to_pylist(), batch.column("weight").to_pylist()):
                    if at:
                        total = np.zeros_like(b) if total is None else total
                        w = np.array(weight)
                        total[at] += np.outer(w, w @ b[at])
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], type=pa.binary())], ["part"])

        # Few tasks: one partial product each, of the benchmark's size.
        parts = rows.select("at", "weight").coalesce(8).mapInArrow(tidy(run), "part binary").toLocalIterator()
        return sum((np.frombuffer(p["part"]).reshape(basis.shape) for p in parts), np.zeros_like(basis))

    for _ in range(s.power):
        basis = np.linalg.qr(product(basis))[0]
    small = basis.T @ product(basis)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[:wanted]
    order = order[values[order] > 1e-9]
    return basis @ vectors[:, order]


@dataclass
class Space:
    """Items as the search sees them.

    ``local``: own number of each benchmark term, -1 for those that weigh nothing here.
    ``coords`` (own terms x axes) are the weighted terms in the latent space, whose axes come first, and on the axes
    of the items it does not hold; ``target`` (axes x items) are the items there, ``axis`` an item's own axis or -1.
    ``every`` numbers likewise all terms of the items, ``held`` (these terms x items) says how many
    of an item's words each is, ``need`` how many words in common order a leak has at least.
    """

    local: np.ndarray
    coords: np.ndarray
    target: np.ndarray
    axis: np.ndarray
    length: np.ndarray
    items: list[tuple[int, list[int], list[int]]]
    every: np.ndarray
    held: np.ndarray
    need: np.ndarray

    @functools.cached_property
    def windows(self) -> tuple[int, int]:
        return _windows(self)

    # Made by each worker, not sent.
    @functools.cached_property
    def gain(self) -> np.ndarray:
        """What a term adds at most to a window's inner product with an item."""
        return np.maximum(self.coords @ self.target, 0)

    @functools.cached_property
    def counts(self) -> np.ndarray:
        """``held`` as numbers whose products are fast, and exact as long as items are shorter than 2**24 words."""
        return self.held.astype(np.float32)

    @functools.cached_property
    def places(self) -> list[dict[int, int]]:
        """Where each word stands in an item."""
        return [_places(words) for _, words, _ in self.items]


def benchmark_items(benchmark: DataFrame) -> list[tuple[int, list[str], list[str]]]:
    """(item_id, words, words of its answer) of every item with words, in order of item_id."""
    has_answer = "answer" in benchmark.columns
    rows = benchmark.select("item_id", "text", *(["answer"] if has_answer else [])).where("item_id IS NOT NULL").collect()
    items = []
    for r in rows:
        if words := words_of(r["text"] or ""):
            last = [x for x in re.split(r"[.!?\n]+", r["text"]) if words_of(x)]
            answer = words_of((r["answer"] if has_answer else None) or (last[-1] if last else r["text"])) or words
            items.append((r["item_id"], words, answer))
    return sorted(items, key=lambda i: (i[0], i[1]))


def _rare(words: list[int], idf: np.ndarray) -> list[int]:
    """The answer's telling half: its words of greatest weight."""
    ranked = sorted(set(words), key=lambda w: (-idf[w], w))
    return ranked[: max(1, (len(ranked) + 1) // 2)]


def _needed(size: int, s: Settings) -> int:
    """Words in common order that any leak of an item of ``size`` words has."""
    return math.ceil(min(s.partly, s.same) * size - 1e-9)


def _filter(items: list[tuple[int, list[int], list[int]]], width: int, s: Settings) -> tuple[np.ndarray, ...]:
    """``every``, ``held`` and ``need`` of a block of items."""
    used = np.unique([w for _, words, _ in items for w in words])
    every = np.full(width, -1, dtype=np.int32)
    every[used] = np.arange(len(used))
    # A window's sum counts each term once, so it is no more than the item's words.
    held = np.zeros((len(used), len(items)), dtype=np.min_scalar_type(max(len(words) for _, words, _ in items)))
    for k, (_, words, _) in enumerate(items):
        np.add.at(held[:, k], every[words], 1)
    return every, held, np.array([_needed(len(words), s) for _, words, _ in items])


def space_of(spark: SparkSession, items: list[tuple[int, list[int], list[int]]], df: np.ndarray, total: int, s: Settings) -> Space:
    """The latent space of a block of items (their words as numbers of benchmark terms)."""
    idf = np.log((total + 1) / (df + 1)) + 1e-3
    frequent = df > s.common * max(1, total)
    for _, words, _ in items:
        ids = np.unique(words)
        if (~frequent[ids]).sum() < 4:
            frequent[ids] = False
    used = np.unique([w for _, words, _ in items for w in words])
    used = used[~frequent[used]]
    local = np.full(len(df), -1, dtype=np.int32)
    local[used] = np.arange(len(used))
    weight = idf[used]
    full = np.zeros((len(used), len(items)))
    sparse = []
    for k, (_, words, _) in enumerate(items):
        ids, n = np.unique(local[words][local[words] >= 0], return_counts=True)
        full[ids, k] = n * weight[ids]
        sparse.append((ids.tolist(), full[ids, k].tolist()))
    latent = randomised_svd(spark.createDataFrame(sparse, "at array<int>, weight array<double>"), len(used), s, len(items))
    whole = np.maximum((full * full).sum(0), 1e-12) ** 0.5
    target = latent.T @ full
    lost = np.flatnonzero((target * target).sum(0) < 0.5 * whole * whole)
    axis = np.full(len(items), -1)
    axis[lost] = latent.shape[1] + np.arange(len(lost))
    target[:, lost] = 0
    target = np.vstack([target, np.zeros((len(lost), len(items)))])
    target[axis[lost], lost] = whole[lost]
    length = np.maximum((target * target).sum(0), 1e-12) ** 0.5
    coords = np.hstack([latent, full[:, lost] / whole[lost]]) * weight[:, None]
    named = [(i, words, _rare(answer, idf)) for i, words, answer in items]
    return Space(local, coords.astype(np.float32), target.astype(np.float32), axis, length, named, *_filter(items, len(df), s))


def _windows(space: Space) -> tuple[int, int]:
    """Words in a stretch, and stretches in a window: a window holds the longest item, half as long again."""
    longest = max(len(words) for _, words, _ in space.items)
    stretch = max(8, min(64, longest // 3))
    return stretch, -(-(longest + longest // 2) // stretch) + 1


# Terms met together by the search, numbers of stretches kept for one document, and cells (documents or stretches by
# terms) held together.
_TOGETHER, _SPAN, _CELLS = 50_000, 1 << 32, 1 << 20


def _sums(doc: np.ndarray, own: np.ndarray, weights: np.ndarray, once: bool) -> Iterator[tuple[int, np.ndarray]]:
    """For some documents at a time: the first of them, and the sums of the ``weights`` of their terms ``own`` (a term
    counts ``once`` or each time it stands there).  Numbers of documents ascend."""
    width = len(weights)
    step = max(1, _CELLS // max(1, width))
    for low in range(0, int(doc[-1]) + 1, step):
        a, b = np.searchsorted(doc, [low, low + step])
        cells = np.zeros((min(step, int(doc[-1]) + 1 - low), width), dtype=np.float32)
        at = (doc[a:b] - low) * width + own[a:b]
        if once:
            cells.ravel()[at] = 1
        else:
            np.add.at(cells.ravel(), at, 1)
        yield low, cells @ weights


def _cosine(window: np.ndarray, dot: np.ndarray, k: np.ndarray, space: Space) -> np.ndarray:
    """Cosine of windows in the latent space (rows) with one item each, ``k``, from their inner products."""
    norm = (window[:, : len(space.target) - (space.axis >= 0).sum()] ** 2).sum(1)
    own = np.where(space.axis[k] >= 0, window[np.arange(len(k)), space.axis[k]] ** 2, 0)
    return np.minimum(1.0, dot / (space.length[k] * np.maximum(norm + own, 1e-18) ** 0.5))


def _retrieved(doc: np.ndarray, at: np.ndarray, term: np.ndarray, space: Space, s: Settings) -> Iterator[tuple[int, int, int]]:
    """(document, stretch, item): the windows, by the stretch they begin with, that are near an item in the latent space.

    ``term`` stands ``at`` these words of ``doc``; documents and places ascend.
    """
    own = space.local[term]
    mine = own >= 0
    if not mine.any() or not len(space.target):
        return
    stretch, per_window = space.windows
    # No window has more in common with an item than the terms of its document that speak for it (but for rounding).
    least = (s.held * space.length**2).astype(np.float32)
    may = np.zeros(int(doc[-1]) + 1, dtype=bool)
    for low, most in _sums(doc[mine], own[mine], space.gain, once=False):
        may[low : low + len(most)] = (most >= 0.999 * least).any(axis=1)
    mine &= may[doc]
    if not mine.any():
        return
    key = doc[mine] * _SPAN + at[mine] // stretch
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    places = key[first]
    total = np.cumsum(np.add.reduceat(space.coords[own[mine]], first, axis=0), axis=0, dtype=np.float64)
    total = np.vstack([np.zeros((1, total.shape[1])), total])
    window = total[np.searchsorted(places, places + per_window)] - total[:-1]
    window = window.astype(np.float32)
    dot = window @ space.target
    w, k = np.nonzero(dot >= least)
    near = _cosine(window[w], dot[w, k], k, space) >= s.near
    yield from zip((places[w[near]] // _SPAN).tolist(), (places[w[near]] % _SPAN).tolist(), k[near].tolist())


def _wordy(doc: np.ndarray, at: np.ndarray, term: np.ndarray, space: Space) -> Iterator[tuple[int, int, int]]:
    """(document, stretch, item): the windows that hold as many of an item's words as a leak has at least."""
    own = space.every[term]
    mine = own >= 0
    if not mine.any():
        return
    doc, at, own = doc[mine], at[mine], own[mine]
    # No window holds more than its document.
    for low, whole in _sums(doc, own, space.counts, once=True):
        enough = whole >= space.need
        for d in np.flatnonzero(enough.any(axis=1)).tolist():
            a, b = np.searchsorted(doc, [low + d, low + d + 1])
            for stretch, k in _wordy_windows(at[a:b], own[a:b], np.flatnonzero(enough[d]), space):
                yield low + d, stretch, k


def _wordy_windows(at: np.ndarray, own: np.ndarray, items: np.ndarray, space: Space) -> Iterator[tuple[int, int]]:
    """(stretch, item) of one document, for some ``items``."""
    stretch, per_window = space.windows
    # A window begins at each stretch with a term and takes the stretches after it; a term counts once a window.
    place = at // stretch
    begins = np.append(True, place[1:] != place[:-1])
    places = place[begins]
    # Stretches without terms between them, as far as a window reaches; words of none of the items are left out.
    line = np.append(0, np.cumsum(np.minimum(places[1:] - places[:-1], per_window)))
    terms, term = np.unique(own, return_inverse=True)
    weights = space.counts[terms[:, None], items]
    row = line[np.cumsum(begins) - 1]
    step = max(1, _CELLS // len(terms))
    for low in range(0, len(places), step):
        mine = line[low : low + step] - line[low]
        a, b = np.searchsorted(row, [line[low], line[low] + mine[-1] + per_window])
        held = np.zeros((int(mine[-1]) + per_window, len(terms)), dtype=bool)
        held[row[a:b] - line[low], term[a:b]] = True
        window = held[mine]
        for k in range(1, per_window):
            window |= held[mine + k]
        for w, k in np.argwhere(window.astype(np.float32) @ weights >= space.need[items]).tolist():
            yield int(places[low + w]), int(items[k])


def _search(ats: list[np.ndarray], terms: list[np.ndarray], space: Space, s: Settings) -> Iterator[tuple]:
    """(document, item_id, cosine, lcs, answer) of documents: ``terms`` of each stand ``ats`` these words of it."""
    doc = np.repeat(np.arange(len(ats)), [len(a) for a in ats])
    at, term = np.concatenate(ats), np.concatenate(terms)
    near_ones = set(_retrieved(doc, at, term, space, s))
    stretch, per_window = space.windows
    best: dict[tuple[int, int], tuple] = {}
    last = None
    for d, place, k in sorted(near_ones.union(_wordy(doc, at, term, space))):
        item, words, rare = space.items[k]
        if (d, place) != last:
            last = d, place
            low = (place - 1) * stretch
            a, b = np.searchsorted(ats[d], [low, low + (per_window + 2) * stretch])
            near_at, here = ats[d][a:b], terms[d][a:b]
            near = here.tolist()
            present = set(near)
        partly = s.loosely if (d, place, k) in near_ones else s.partly
        needed = math.ceil(min(partly, s.same) * len(words) - 1e-9)
        where = space.places[k]
        met = [where.get(w, 0) for w in near]
        shared = [x for x in met if x]
        # No part of the stretch has more in common order than the whole.
        if len(shared) < needed or _common_order(len(words), shared) < needed:
            continue
        lcs = _tightest(len(words), near_at, met, needed)
        answer = sum(x in present for x in rare) / len(rare)
        if lcs >= s.same or (lcs >= partly and answer >= s.answer):
            ids = space.local[here]
            window = space.coords[ids[ids >= 0]].sum(axis=0, keepdims=True)
            cosine = float(_cosine(window, window[0] @ space.target[:, [k]], np.array([k]), space)[0]) if len(space.target) else 0.0
            if (d, k) not in best or (lcs, cosine) > (best[d, k][3], best[d, k][2]):
                best[d, k] = (d, item, cosine, lcs, answer)
    yield from best.values()


def _together(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Stretches of documents (begin, end) of some ``_TOGETHER`` terms; one longer is alone."""
    begin = held = 0
    for k, size in enumerate(sizes):
        if held and held + size > _TOGETHER:
            yield begin, k
            begin = k
            held = 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)


def _tightest(length: int, at: np.ndarray, met: list[int], needed: int) -> float:
    """Greatest share of an item of ``length`` words in common order with a stretch of words half as long again, those
    that share fewer than ``needed`` left out.  ``met``: where the word ``at`` each place stands in the item (0: nowhere)."""
    size, step = max(4, length + length // 2), max(1, length // 4)
    starts = np.arange(at[0], max(at[0] + 1, at[-1] + 1 - size + step), step)
    best = 0
    for a, b in zip(np.searchsorted(at, starts).tolist(), np.searchsorted(at, starts + size).tolist()):
        shared = [x for x in met[a:b] if x]
        if len(shared) >= needed and len(shared) > best:
            best = max(best, _common_order(length, shared))
    return best / length


def leaks(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer): every item a document leaks."""
    spark = docs.sparkSession
    items = benchmark_items(benchmark)
    terms = sorted({w for _, words, answer in items for w in (*words, *answer)})
    number = {t: i for i, t in enumerate(terms)}
    numbered = [(i, [number[w] for w in words], [number[w] for w in answer]) for i, words, answer in items]
    found = stored(hits(docs, terms))
    df, total = document_frequency(found, len(terms))
    blocks = [numbered[k : k + s.block] for k in range(0, len(numbered), s.block)]
    sent = spark.sparkContext.broadcast([space_of(spark, b, df, total, s) for b in blocks])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            ids, raw_at, raw_term = (batch.column(c).to_pylist() for c in ("doc_id", "at", "term"))
            for a, b in _together([len(x) // 4 for x in raw_at]):
                ats, terms = ([np.frombuffer(x, dtype=np.int32) for x in raw[a:b]] for raw in (raw_at, raw_term))
                for space in sent.value:
                    rows += [(ids[a + r[0]], *r[1:]) for r in _search(ats, terms, space, s)]
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            names = ["doc_id", "item_id", "cosine", "lcs", "answer"]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds)], names)

    return found.mapInArrow(tidy(run), SCHEMA)


def without_leaks(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The documents that leak nothing, their columns unchanged (a leak marks every row of its doc_id)."""
    leaked = stored(leaks(docs, benchmark, s).select("doc_id").distinct())
    found = docs.join(leaked, docs["doc_id"].eqNullSafe(leaked["doc_id"]), "left_anti")
    return found
