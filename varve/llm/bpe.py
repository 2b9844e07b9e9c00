"""Byte-level BPE by segment trees over adjacent pair ranks, encoding and decoding.

A word's tree has a leaf for each symbol, holding the rank of the pair that begins there and
its position; the root is therefore the leftmost pair of lowest rank.  A merge changes three
leaves, each repaired up to the root in logarithmic time, until the root says that no pair can
be merged.  Short words are merged in lockstep: their trees are the rows of one numpy array.

Results: null texts count as empty and give no ids; special tokens of the vocabulary that
stand in a text become their own ids.  All other columns of the input are kept.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varve.llm.common import WordCache, kept, parts_of, slices, texts_of, tidy

# How the vocabulary splits a text into words before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Words, and pieces of texts, whose ids a worker remembers: workers share an executor's memory with Spark.
CACHED = 150_000

_NEVER = np.int64(1) << 40
_LOCKSTEP = 64
_BESIDE_SPACE = -1


def byte_letters() -> dict[int, str]:
    """The printable letter by which byte-level vocabularies write each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Vocabulary:
    """Merges and tokens of a byte-level BPE file (the ``tokenizers`` JSON form)."""

    def __init__(self, source: str):
        data = json.loads(source)
        letters, ids = byte_letters(), data["model"]["vocab"]
        raw = {letter: byte for byte, letter in letters.items()}
        self.specials = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.width = max([*ids.values(), *self.specials.values()]) + 1
        self.tokens = [b""] * self.width
        for token, i in ids.items():
            self.tokens[i] = bytes(raw[c] for c in token)
        for token, i in self.specials.items():
            self.tokens[i] = token.encode()
        self.byte_ids = np.array([ids[letters[b]] for b in range(256)], dtype=np.int64)
        pairs = [(m.split(" ") if isinstance(m, str) else m) for m in data["model"]["merges"]]
        left = np.array([ids[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([ids[b] for _, b in pairs], dtype=np.int64)
        keys = left * self.width + right
        self._rank = np.argsort(keys, kind="stable")
        self._keys = keys[self._rank]
        self.merged = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        self.rank_of = dict(zip(keys.tolist(), range(len(pairs))))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, -1 where the pair does not merge (or an id is -1)."""
        keys = left * self.width + right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        known = (self._keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(known, self._rank[at], -1)


def merge_one(symbols: list[int], vocabulary: Vocabulary) -> list[int]:
    """One word of any length: its segment tree as a list."""
    n = len(symbols)
    width = 1 << max(1, (n - 1).bit_length())
    rank_of, scale, never = vocabulary.rank_of, vocabulary.width, int(_NEVER)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def leaf(i: int) -> int:
        j = after[i]
        rank = rank_of.get(symbols[i] * scale + symbols[j]) if j < n else None
        return never if rank is None else rank * width + i

    tree = [never] * (2 * width)
    for i in range(n):
        tree[width + i] = leaf(i)
    for k in range(width - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(i: int, value: int) -> None:
        k = width + i
        tree[k] = value
        while k > 1:
            k >>= 1
            best = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == best:
                break
            tree[k] = best

    while tree[1] < never:
        rank, i = divmod(tree[1], width)
        j = after[i]
        symbols[i], symbols[j] = int(vocabulary.merged[rank]), -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        put(j, never)
        put(i, leaf(i))
        if before[i] >= 0:
            put(before[i], leaf(before[i]))
    return [s for s in symbols if s >= 0]


def merge_many(symbols: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Words as rows (padded with -1 to a power of two), merged in place, one pair a round each."""
    count, width = symbols.shape
    shift = width.bit_length() - 1
    flat = symbols.ravel()
    tree = np.full((count, 2 * width), _NEVER, dtype=np.int64)
    ranks = vocabulary.ranks(symbols[:, :-1], symbols[:, 1:])
    tree[:, width:-1] = np.where(ranks >= 0, (ranks << shift) + np.arange(width - 1), _NEVER)
    h = width // 2
    while h:
        tree[:, h : 2 * h] = np.minimum(tree[:, 2 * h : 4 * h : 2], tree[:, 2 * h + 1 : 4 * h : 2])
        h //= 2
    nodes = tree.ravel()
    place = np.arange(width)
    after = np.broadcast_to(place + 1, (count, width)).copy().ravel()
    before = np.broadcast_to(place - 1, (count, width)).copy().ravel()
    rows = np.flatnonzero(tree[:, 1] < _NEVER)
    while len(rows):
        word, top = rows * width, nodes[rows * 2 * width + 1]
        i = top & (width - 1)
        j = after[word + i]
        flat[word + i] = vocabulary.merged[top >> shift]
        flat[word + j] = -1
        k = after[word + j]
        after[word + i] = k
        inside = k < width
        before[(word + k)[inside]] = i[inside]
        # The pairs that now begin at the merged symbol and at the one before it.
        follower = np.where(inside, flat[word + np.minimum(k, width - 1)], -1)
        rank_i = vocabulary.ranks(flat[word + i], follower)
        p = before[word + i]
        has_p = p >= 0
        p_safe = np.maximum(p, 0)
        rank_p = np.where(has_p, vocabulary.ranks(flat[word + p_safe], flat[word + i]), -1)
        where = np.concatenate([j, i, np.where(has_p, p_safe, j)])
        value = np.concatenate(
            [
                np.full(len(rows), _NEVER),
                np.where(rank_i >= 0, (rank_i << shift) + i, _NEVER),
                np.where(rank_p >= 0, (rank_p << shift) + p_safe, _NEVER),
            ]
        )
        base = np.tile(rows * 2 * width, 3)
        node = where + width
        nodes[base + node] = value
        while node[0] > 1:
            node >>= 1
            nodes[base + node] = np.minimum(nodes[base + 2 * node], nodes[base + 2 * node + 1])
        rows = rows[nodes[rows * 2 * width + 1] < _NEVER]
    return symbols


def encode_words(words: list[str], vocabulary: Vocabulary) -> list[bytes]:
    """Ids of each word as little-endian unsigned 32-bit integers."""
    raw = [w.encode() for w in words]
    out: list[bytes] = [b""] * len(raw)
    by_width: dict[int, list[int]] = {}
    for k, b in enumerate(raw):
        if len(b) > _LOCKSTEP:
            ids = merge_one(vocabulary.byte_ids[np.frombuffer(b, dtype=np.uint8)].tolist(), vocabulary)
            out[k] = np.array(ids, dtype="<u4").tobytes()
        elif b:
            by_width.setdefault(max(2, 1 << (len(b) - 1).bit_length()), []).append(k)
    for width, members in by_width.items():
        for first in range(0, len(members), 20_000):
            some = members[first : first + 20_000]
            joined = np.frombuffer(b"".join(raw[k].ljust(width, b"\0") for k in some), dtype=np.uint8)
            symbols = vocabulary.byte_ids[joined].reshape(-1, width)
            lengths = np.array([len(raw[k]) for k in some])
            symbols[np.arange(width) >= lengths[:, None]] = -1
            symbols = merge_many(symbols, vocabulary)
            alive = symbols >= 0
            ids = symbols[alive].astype("<u4").tobytes()
            ends = np.cumsum(alive.sum(axis=1)) * 4
            start = 0
            for k, end in zip(some, ends.tolist()):
                out[k] = ids[start:end]
                start = end
    return out


class Encoder:
    """Whole texts to ids, remembering pieces.

    A single blank between two other characters always begins a new word, so a text is cut
    there and each piece (with its blank) is split into words once.  A piece that is empty or
    has white space at an end stands beside a run of white space: its text is split whole.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.find = regex.compile(SPLIT).findall
        self.words = WordCache(lambda words: encode_words(words, vocabulary), CACHED)
        self.pieces = WordCache(self._encode_pieces, CACHED)
        self.names = sorted(vocabulary.specials, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.names)) + ")")

    def _join(self, found: list[list[str]]) -> list[bytes]:
        values = self.words.of([w for words in found for w in words])
        return [b"".join(part) for part in parts_of(values, map(len, found))]

    def _encode_pieces(self, pieces: list[str]) -> list[bytes | int]:
        plain = [bool(p) and not p[0].isspace() and not p[-1].isspace() for p in pieces]
        made = iter(self._join([self.find(" " + p) for p, ok in zip(pieces, plain) if ok]))
        return [next(made) if ok else _BESIDE_SPACE for ok in plain]

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Texts without special tokens."""
        cut = [t.split(" ") for t in texts]
        values = self.pieces.of([p for c in cut for p in c[1:]])
        heads = self._join([self.find(c[0]) for c in cut])
        out: list[bytes] = []
        whole: list[int] = []
        for k, rest in enumerate(parts_of(values, [len(c) - 1 for c in cut])):
            try:
                out.append(heads[k] + b"".join(rest))
            except TypeError:
                out.append(b"")
                whole.append(k)
                continue
            if rest and cut[k][0][-1:].isspace():
                whole.append(k)
        for k, made in zip(whole, self._join([self.find(texts[k]) for k in whole])):
            out[k] = made
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.names:
            return self._plain(texts)
        parts = [self.special.split(t) if any(n in t for n in self.names) else [t] for t in texts]
        specials = self.vocabulary.specials
        made = iter(self._plain([p for doc in parts for p in doc if p not in specials]))
        return [
            b"".join(specials[p].to_bytes(4, "little") if p in specials else next(made) for p in doc)
            for doc in parts
        ]


def _vocabulary_file(df: DataFrame, path: str):
    """The vocabulary, sent to executors as it is: a file of fixed size, whatever the corpus."""
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the column ``ids`` (binary: little-endian unsigned 32-bit integers)."""
    source = _vocabulary_file(docs, path)
    docs = docs.drop(ids)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(("bpe", source.value), lambda: Encoder(Vocabulary(source.value)))
        for batch in batches:
            for part in slices(batch, text):
                made = pa.array(encoder(texts_of(part, text)), type=pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, ids])

    return docs.mapInArrow(tidy(run), schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``encoded`` with the column ``text``: the bytes of its tokens as UTF-8, specials included."""
    source = _vocabulary_file(encoded, path)
    encoded = encoded.drop(text)
    schema = T.StructType([*encoded.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Decoding has workers of its own, which need no more of the vocabulary than this.
        token = kept(("bpe tokens", source.value), lambda: Vocabulary(source.value).tokens).__getitem__
        for batch in batches:
            for part in slices(batch, ids):
                made = [
                    b"".join(map(token, np.frombuffer(b or b"", dtype="<u4").tolist())).decode("utf-8", "replace")
                    for b in part.column(ids).to_pylist()
                ]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(made, type=pa.string())], [*part.schema.names, text]
                )

    return encoded.mapInArrow(tidy(run), schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: n_tokens, digest of the ids, digest of the text decoded from them."""
    encoded = encode(docs.select("doc_id", "text"), path).select("doc_id", "ids")
    return decode(encoded, path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
