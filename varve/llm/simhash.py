"""SimHash near-duplicates: pivot distance tables over distinct fingerprints.

A document's fingerprint takes the majority, bit by bit, of the hashes of its word shingles.
Distances from every distinct fingerprint to a set of reference fingerprints (pivots) are
computed once; two fingerprints within ``k`` bits differ by at most ``k`` in each of these
coordinates, so pairs are discarded by their largest coordinate difference and only survivors
are compared.

Pairs are looked for inside buckets only.  The 64 bits are cut into six blocks; two
fingerprints within 3 bits agree on at least three whole blocks, so each of the twenty choices
of three blocks is a bucket key, and no link is missed.  A bucket is read in the order of its
first coordinate, so each fingerprint meets only those whose first coordinate differs by at
most ``k``.  Of a bucket's links only a shortest spanning forest leaves the task: less than one a
fingerprint and bucket, never all pairs.  Buckets of more than ``split`` fingerprints are cut again by the same rule over the
bits their key leaves open, so that no task holds one whole.

The pipeline's near-duplicates (``near_classes``) come from the same search: distinct texts whose
fingerprints are linked are candidates, and the similarity of their shingle sets decides.  Texts can be
alike with fingerprints farther apart, so an exact join on the rarest shingles follows for what is not
joined by then.

Results: nulls and texts without words have fingerprint zero and link like any other; equal
texts meet in one fingerprint; a component's id is its smallest doc_id (null only if all are).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.llm.common import slices, stored, strings, texts_of, tidy

BITS, PIVOTS = 64, 16
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_BLANKS = regex.compile(r"[\x20\x09-\x0D]+")
# Odd factors of the words of a shingle, and cells (by leading bits of a hash) that shingles are counted in.
_FACTORS = np.random.default_rng(17).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CELL_BITS = 20


def shingle_fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """Majority of the bits of the shingles' XXH64, as an unsigned number."""
    parts = _words(text)
    if not parts:
        return 0
    hashed = [
        xxhash.xxh64_intdigest(" ".join(parts[i : i + words]), seed) for i in range(max(1, len(parts) - words + 1))
    ]
    return int(_majority(np.array(hashed, dtype=np.uint64), [len(hashed)])[0])


def _words(text: str) -> list[str]:
    lowered = text.translate(_LOWER) if not text.isascii() else text.lower()
    # str.split() knows more blanks than the six ASCII ones.
    if lowered.isascii() and not any(c in lowered for c in "\x1c\x1d\x1e\x1f"):
        return lowered.split()
    return [w for w in _BLANKS.split(lowered) if w]


def _majority(hashes: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Per stretch of ``hashes``: bits set in over half of it."""
    out = np.zeros(len(sizes), dtype=np.uint64)
    start = 0
    for k, size in enumerate(sizes):
        ones = np.zeros(BITS, dtype=np.int64)
        for first in range(start, start + size, 1 << 16):
            some = hashes[first : min(first + (1 << 16), start + size)].astype(">u8")
            ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > size).view(">u8")[0] if size else 0
        start += size
    return out


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fingerprint (bigint, the 64 bits) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, sizes = [], []
                for text in texts_of(part):
                    w = _words(text)
                    if len(w) > words:
                        shingles = map(" ".join, zip(*(w[i:] for i in range(words))))
                        hashes += [digest(s, 42) for s in shingles]
                        sizes.append(len(w) - words + 1)
                    elif w:
                        hashes.append(digest(" ".join(w), 42))
                        sizes.append(1)
                    else:
                        sizes.append(0)
                made = _majority(np.array(hashes, dtype=np.uint64), sizes)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(made.view(np.int64))], ["doc_id", "fingerprint"]
                )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id bigint, fingerprint bigint")


def _masks(bits: list[int], blocks: int, keep: int) -> list[int]:
    """Masks over ``bits``: every choice of ``keep`` of ``blocks`` blocks, as signed numbers."""
    cut = [b.tolist() for b in np.array_split(np.array(bits), blocks)]
    made = [sum(1 << b for block in chosen for b in block) for chosen in itertools.combinations(cut, keep)]
    return [m - (1 << 64) if m >> 63 else m for m in made]


def pivots() -> np.ndarray:
    """Reference fingerprints: fixed pseudo-random ones."""
    return np.random.default_rng(11).integers(0, 1 << 63, PIVOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int16)


def _close(values: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The pairs (i, j) within ``k`` bits: first by the pivot table, then by the fingerprints."""
    near = np.abs(table[j] - table[i]).max(axis=1, initial=0) <= k
    i, j = i[near], j[near]
    bits = _popcount(values[i] ^ values[j])
    near = bits <= k
    return i[near], j[near], bits[near]


def _forest(i: np.ndarray, j: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Places of the pairs of a shortest spanning forest: any other pair is joined by closer ones."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    chosen = []
    for p in np.argsort(bits, kind="stable").tolist():
        a, b = root(int(i[p])), root(int(j[p]))
        if a != b:
            parent[a] = b
            chosen.append(p)
    return np.array(chosen, dtype=np.int64)


def _links(values: np.ndarray, bucket: np.ndarray, k: int, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within each bucket: a shortest spanning forest of its pairs within ``k`` bits.

    Rows are ordered by bucket and first pivot distance, and each meets the rows after it, one
    step further each round, until no row has another whose first distance is near enough.
    """
    table = np.stack([_popcount(values ^ p) for p in references], axis=1)
    order = np.lexsort((table[:, 0], bucket))
    values, bucket, table = values[order], bucket[order], table[order]
    found = [np.zeros(0, dtype=np.int64)] * 2 + [np.zeros(0, dtype=np.int16)]
    at, step = np.arange(len(values) - 1), 1
    while len(at):
        at = at[at + step < len(values)]
        at = at[(bucket[at + step] == bucket[at]) & (table[at + step, 0] - table[at, 0] <= k)]
        found = [np.concatenate(c) for c in zip(found, _close(values, table, at, at + step, k))]
        if len(found[0]) > 1_000_000:
            tree = _forest(*found)
            found = [c[tree] for c in found]
        step += 1
    tree = _forest(*found)
    return values[found[0][tree]], values[found[1][tree]]


def _bucketed_links(keyed: DataFrame, k: int) -> DataFrame:
    """(a, b) links inside buckets; ``keyed``: bucket columns ``choice``, ``key`` and ``fingerprint``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        references = pivots()
        held = np.zeros(0, dtype=np.uint64)
        held_key: tuple | None = None

        def solve(groups: list[np.ndarray]) -> pa.RecordBatch:
            bucket = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
            a, b = _links(np.concatenate(groups), bucket, k, references)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            choice, key = (batch.column(c).to_numpy() for c in ("choice", "key"))
            values = batch.column("fingerprint").to_numpy().view(np.uint64)
            if not len(values):
                continue
            new = np.flatnonzero((choice[1:] != choice[:-1]) | (key[1:] != key[:-1])) + 1
            starts, ends = [0, *new.tolist()], [*new.tolist(), len(values)]
            groups = []
            for s, e in zip(starts, ends):
                this = (choice[s], key[s])
                if this == held_key:
                    held = np.concatenate([held, values[s:e]])
                else:
                    if len(held) > 1:
                        groups.append(held)
                    held, held_key = values[s:e], this
            if groups:
                yield solve(groups)
        if len(held) > 1:
            yield solve([held])

    return (
        keyed.repartition("choice", "key")
        .sortWithinPartitions("choice", "key")
        .select("choice", "key", "fingerprint")
        .mapInArrow(tidy(run), "a bigint, b bigint")
    )


def _with_keys(values: DataFrame, masks: list[int]) -> DataFrame:
    keys = [F.struct(F.lit(i).alias("choice"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)]
    return values.select("fingerprint", F.inline(F.array(*keys)))


def links(values: DataFrame, k: int = 3, split: int = 4_096) -> DataFrame:
    """Links among distinct ``values`` (fingerprint) that connect whatever is within ``k`` bits."""
    masks = _masks(list(range(BITS)), 2 * k, k)
    keyed = _with_keys(values, masks)
    sizes = keyed.groupBy("choice", "key").agg(F.count("*").alias("size")).where("size > 1")
    shared = stored(keyed.join(sizes, ["choice", "key"]))
    found = _bucketed_links(shared.where(F.col("size") <= split), k)
    # Large buckets: the same rule again over the bits that the bucket's key leaves open.
    open_bits = [[b for b in range(BITS) if not (m >> b) & 1] for m in masks]
    inner = F.array(
        *[
            F.array(*[F.lit(x) for x in _masks(bits, 2 * k, k)])
            for bits in open_bits
        ]
    )
    large = (
        shared.where(F.col("size") > split)
        .select("fingerprint", "choice", "key", F.posexplode(F.element_at(inner, F.col("choice") + 1)).alias("part", "mask"))
        .select(
            "fingerprint",
            (F.col("choice") * 100 + F.col("part")).alias("choice"),
            F.col("key").bitwiseOR(F.col("fingerprint").bitwiseAND(F.col("mask"))).alias("key"),
        )
    )
    return found.unionByName(_bucketed_links(large, k)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node it reaches.

    Each round ties every node to the smallest of its neighbours and itself, and its larger
    neighbours likewise (large-star, then small-star); a chain halves a round.  Rounds are
    written to the shared folder and end when the edges no longer change.
    """
    spark = edges.sparkSession
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        )
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        small = stored(small)
        same = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if same == small.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first():
            break
        edges = small
    roots = small.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return small.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def classes(docs: DataFrame, words: int = 3, k: int = 3, split: int = 4_096) -> DataFrame:
    """doc_id, fingerprint (bigint), component_id of every document."""
    marked = stored(fingerprints(docs, words))
    values = stored(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    return _named(marked, values, links(values.select("fingerprint"), k, split))


def _named(marked: DataFrame, values: DataFrame, edges: DataFrame, by: str = "fingerprint") -> DataFrame:
    """Documents with the smallest doc_id that ``edges`` between values of ``by`` lead to."""
    tied = components(edges)
    rooted = values.join(tied.withColumnRenamed("node", by), by, "left").withColumn("root", F.coalesce("root", by))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_value = rooted.join(named, "root").select(by, "component_id")
    return marked.join(by_value, by)


def classes_hex(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id of every document."""
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def _shingled(texts: pa.Array, words: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of each text: a hash of all its words in order, and the sorted distinct hashes of its word shingles."""
    text = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    cut = pc.ascii_split_whitespace(text)
    coded = cut.flatten().dictionary_encode()
    digest = xxhash.xxh64_intdigest
    word = np.array([digest(w, 42) for w in strings(coded.dictionary)], dtype=np.uint64)[coded.indices.to_numpy()]
    ends = np.cumsum(pc.list_value_length(cut).to_numpy()).tolist()
    # A shingle's hash is a sum of its words' hashes by odd factors of their place, stirred.
    mixed = np.zeros(len(word), dtype=np.uint64)
    for j in range(min(words, len(word))):
        mixed[: len(word) - j] += word[j:] * _FACTORS[j]
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _FACTORS[words]
    mixed ^= mixed >> np.uint64(32)
    keys, sets, begin = np.zeros(len(ends), dtype=np.uint64), [], 0
    for k, (end, empty) in enumerate(zip(ends, pc.equal(text, "").to_pylist())):
        own = word[begin:begin] if empty else word[begin:end]
        keys[k] = digest(own.tobytes(), 42)
        if len(own) >= words:
            sets.append(np.unique(mixed[begin : end - words + 1]))
        else:
            sets.append(keys[k : k + 1].copy() if len(own) else own)
        begin = end
    return keys.view(np.int64), sets


def _first_seen(docs: DataFrame, words: int, make: Callable, schema: str) -> DataFrame:
    """``make(key, shingles)`` of each text with words (arrays of equal length), once a task for equal texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                made = []
                for key, shingles in zip(*_shingled(part.column("text"), words)):
                    if len(shingles) and key not in seen:
                        seen.add(key)
                        made.append(make(key, shingles))
                if made:
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*made)], names)

    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select("text").mapInArrow(tidy(run), schema)


def _text_keys(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, unit (hash of the words in order), fingerprint (majority over the set of shingles) and n (shingles) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                keys, sets = _shingled(part.column("text"), words)
                sizes = [len(x) for x in sets]
                made = _majority(np.concatenate(sets), sizes).view(np.int64)
                columns = [part.column("doc_id"), pa.array(keys), pa.array(made), pa.array(sizes, type=pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "unit", "fingerprint", "n"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id bigint, unit bigint, fingerprint bigint, n int")


def _shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """unit, shingles: sorted distinct hashes of the word shingles; a unit may come more than once."""
    return _first_seen(
        docs, words, lambda key, x: (pa.array([key]), pa.array([x.view(np.int64)], type=pa.list_(pa.int64()))), "unit bigint, shingles array<bigint>"
    )


def _cell_counts(docs: DataFrame, words: int) -> np.ndarray:
    """How many texts' shingles fall in each of the cells of hashes: about how frequent a shingle is at most.

    Of fixed size whatever the input; parts are added up in tasks, by block of cells.
    """
    size = (1 << _CELL_BITS) // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << _CELL_BITS, dtype=np.int32)
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                for key, shingles in zip(*_shingled(part.column("text"), words)):
                    if key not in seen:
                        seen.add(key)
                        np.add.at(cells, (shingles >> np.uint64(64 - _CELL_BITS)).astype(np.int64), 1)
        blocks = [cells[b * size : (b + 1) * size].tobytes() for b in range(64)]
        yield pa.RecordBatch.from_arrays([pa.array(range(64), type=pa.int32()), pa.array(blocks, type=pa.binary())], ["block", "n"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, n in zip(batch.column("block").to_pylist(), batch.column("n").to_pylist()):
                total[block] = total.get(block, 0) + np.frombuffer(n, dtype=np.int32).astype(np.int64)
        made = [np.minimum(x, 2**31 - 1).astype(np.int32).tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), type=pa.int32()), pa.array(made, type=pa.binary())], ["block", "n"])

    parts = docs.select("text").mapInArrow(tidy(run), "block int, n binary")
    out = np.zeros(1 << _CELL_BITS, dtype=np.int32)
    for row in parts.repartition("block").mapInArrow(tidy(added), "block int, n binary").collect():  # 64 rows
        out[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(row["n"], dtype=np.int32)
    return out


def _prefixes(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """token, unit, n, pos: of each text of ``n`` shingles the rarest, as many as any partner must share one of."""
    sent = docs.sparkSession.sparkContext.broadcast(_cell_counts(docs, words))

    def make(key: int, shingles: np.ndarray) -> tuple:
        counts = sent.value[(shingles >> np.uint64(64 - _CELL_BITS)).astype(np.int64)]
        n = len(shingles)
        first = np.lexsort((shingles, counts))[: n - math.ceil(similarity * n - 1e-9) + 1]
        # A cell with one text holds no shared shingle.
        pos = np.flatnonzero(counts[first] > 1)
        token = shingles[first[pos]].view(np.int64)
        return pa.array(token), pa.array(np.full(len(pos), key)), pa.array(np.full(len(pos), n, dtype=np.int32)), pa.array(pos.astype(np.int32))

    return _first_seen(docs, words, make, "token bigint, unit bigint, n int, pos int")


def _shared(prefixes: DataFrame) -> DataFrame:
    """The rows, each once, whose token stands in more than one unit.  Nothing is held but one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None
        met = False
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            token, unit = rows.column("token").to_numpy(), rows.column("unit").to_numpy()
            new = np.append(True, (token[1:] != token[:-1]) | (unit[1:] != unit[:-1]))
            at = np.flatnonzero(new)
            same = token[at[1:]] == token[at[:-1]]
            keep = np.append(met, same) | np.append(same, False)
            met = bool(keep[-1])
            last = rows.slice(int(at[-1]), 1)
            yield rows.take(pa.array(at[:-1][keep[:-1]]))
        if last is not None and met:
            yield last

    schema = "token bigint, unit bigint, n int, pos int"
    return prefixes.repartition("token").sortWithinPartitions("token", "unit").mapInArrow(tidy(run), schema)


def _linked(units: DataFrame, k: int = 3) -> DataFrame:
    """token, unit, n: units whose fingerprints ``k`` bits link, by the smallest fingerprint they reach (token)."""
    tied = components(links(units.select("fingerprint").distinct(), k)).withColumnRenamed("node", "fingerprint")
    tokens = units.where("n > 0").join(tied, "fingerprint", "left").select(F.coalesce("root", "fingerprint").alias("token"), "unit", "n")
    crowd = tokens.groupBy("token").count().where("count > 1").select("token")
    return tokens.join(crowd, "token", "left_semi")


# Rounds in which what fingerprints link is compared with one text of each group.
_HUBS = 4


def _alike(docs: DataFrame, units: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b) pairs of units of at least ``similarity`` that join all that such pairs join.

    Units of linked fingerprints are compared with one of their group first; those that are alike are
    joined, and the others compared with another one.  Then the exact search follows.  The shingles' one
    order is by rarity.  Sets so alike share one of their rarest, at places that
    leave room for the overlap they need, so every pair that can be alike is a candidate of some token.
    Where candidates are many, each token's units are first compared with one of them, another each
    round, and pairs of what is joined by then need no comparison; what is left is compared pair by pair.
    """
    linked = stored(_linked(units))
    shared = stored(_shared(_prefixes(docs, words, similarity)))
    least = similarity / (1 + similarity)

    def decided(pairs: DataFrame) -> DataFrame:
        # Sets are larger than texts: only those of the pairs are made and shuffled, and none is kept.
        pairs = stored(pairs)
        wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("unit")).distinct())
        ids = stored(units.join(wanted, "unit", "left_semi").select(F.col("least").alias("id")).distinct())
        texts = docs.join(ids, docs["doc_id"].eqNullSafe(ids["id"]), "left_semi")
        sets = _shingle_sets(texts, words).join(wanted, "unit", "left_semi").dropDuplicates(["unit"])
        return stored(
            pairs.join(sets.select(F.col("unit").alias("a"), F.col("shingles").alias("x")), "a")
            .join(sets.select(F.col("unit").alias("b"), F.col("shingles").alias("y")), "b")
            .withColumn("common", F.size(F.array_intersect("x", "y")))
            .select("a", "b", (F.col("common") >= similarity * (F.size("x") + F.size("y") - F.col("common"))).alias("alike"))
        )

    def candidates(one: DataFrame, other: DataFrame, ordered: bool) -> DataFrame:
        other = other.select("token", *[F.col(c).alias(f"{c}2") for c in ("unit", "n", "pos", "root")])
        room = F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2"))
        met = one.join(other, "token").where(
            (F.col("root") != F.col("root2"))
            & (room >= least * (F.col("n") + F.col("n2")) - 1e-6)
            & (F.least("n", "n2") >= similarity * F.greatest("n", "n2") - 1e-6)
            & (F.col("unit") < F.col("unit2") if ordered else F.lit(True))
        )
        return met.select(F.least("unit", "unit2").alias("a"), F.greatest("unit", "unit2").alias("b")).distinct()

    judged = edges = None
    left = linked
    for turn in range(_HUBS):
        hubs = left.groupBy("token").agg(F.min_by("unit", F.struct(F.xxhash64("unit", F.lit(turn)), "unit")).alias("hub"))
        met = left.join(hubs, "token").where("unit <> hub").select(F.least("unit", "hub").alias("a"), F.greatest("unit", "hub").alias("b"))
        now = decided(met)
        if now.isEmpty():
            break
        judged = now if judged is None else judged.unionByName(now)
        joined = now.where("alike").select(F.explode(F.array("a", "b")).alias("unit")).union(hubs.select("hub"))
        left = stored(left.join(joined.distinct(), "unit", "left_anti").select("token", "unit", "n"))
    rows = shared.withColumn("root", F.col("unit"))
    if judged is not None:
        tied = components(judged.where("alike").select("a", "b")).withColumnRenamed("node", "unit")
        rows = stored(shared.join(tied, "unit", "left").select("token", "unit", "n", "pos", F.coalesce("root", "unit").alias("root")))
    before = math.inf
    for turn in itertools.count():
        crowd = rows.groupBy("token", "root").count().groupBy("token")
        crowd = crowd.agg(F.sum("count").alias("m"), F.sum(F.col("count") * F.col("count")).alias("own"), F.count("*").alias("roots"))
        crowd = stored(crowd.where("roots > 1"))
        total, left = crowd.agg(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.sum((F.col("m") * F.col("m") - F.col("own")) / 2), F.lit(0.0))).first()
        rows = rows.join(crowd.select("token"), "token", "left_semi")
        last = left <= 8 * total or left > 0.75 * before
        if last:
            pairs = candidates(rows, rows, True)
        else:
            hub = F.min_by(F.struct("unit", "n", "pos", "root"), F.struct(F.xxhash64("unit", F.lit(turn)), "unit"))
            pairs = candidates(rows, rows.groupBy("token").agg(hub.alias("h")).select("token", "h.*"), False)
        if judged is not None:
            pairs = pairs.join(judged.select("a", "b"), ["a", "b"], "left_anti")
        now = decided(pairs)
        judged = now if judged is None else judged.unionByName(now)
        edges = judged.where("alike").select("a", "b")
        if last:
            return edges
        before = left
        tied = components(edges).withColumnRenamed("node", "unit").withColumnRenamed("root", "to")
        rows = stored(rows.drop("root").join(tied, "unit", "left").select("token", "unit", "n", "pos", F.coalesce("to", "unit").alias("root")))


def near_classes(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, unit, component_id: documents whose shingle sets are ``similarity`` alike (Jaccard).

    Units are the distinct texts, by their words; every two that are so alike are in one component.
    """
    marked = stored(_text_keys(docs, words))
    least = (F.min(c).alias(name) for c, name in (("doc_id", "least"), ("fingerprint", "fingerprint"), ("n", "n")))
    units = stored(marked.groupBy("unit").agg(*least))
    return _named(marked.select("doc_id", "unit"), units.select("unit", "least"), _alike(docs, units, words, similarity), "unit")


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group of near-duplicates, that of smallest doc_id (rows without one stay); of rows with the
    same doc_id all that share it stay."""
    # The ids that go are fewer than those that stay: few enough, and whole rows need no shuffle.
    gone = near_classes(docs, words, similarity).where("doc_id IS NOT NULL").groupBy("doc_id")
    gone = stored(gone.agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays")).where("NOT stays").select("doc_id"))
    return docs.join(gone, "doc_id", "left_anti")
