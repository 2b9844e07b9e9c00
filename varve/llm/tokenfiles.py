"""Token ids as Parquet list columns, laid out so that tokens or metadata can be read alone.

Files hold consecutive doc_id ranges in ascending order (nulls first, equal ids by text).  Ids
are a list column, dictionary-encoded (a vocabulary fits a dictionary page), with delta
encoding as the fallback; row groups and pages are sized by parameters, and the page indexes
let a reader skip to the pages of a doc_id range.  ``n_tokens`` repeats the list length, so
metadata reads never touch the tokens.  Null texts count as empty: just the end id.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varve.llm.bpe import byte_letters
from varve.llm.common import WordCache, kept, slices, strings

# Pieces are looked up once in so many bytes of text.
_SLICE_BYTES = 4 << 20
FILE_SCHEMA = "doc_id bigint, n_tokens bigint, ids array<int>"


class _Encoder:
    """Texts to ids (little-endian int32, with the end id) by the tokenizers library.

    The vocabulary drops white space and splits words at it before anything else, and none of
    its normalisers looks across it, so pieces between blanks, tabs and line ends stand alone.
    Distinct pieces are normalised and split as the file says, and new words of many are
    encoded by the library in one call; each ends in a token with the word-end mark, which
    tells them apart again.  Pieces with a special token in them take the library's whole path.
    """

    def __init__(self, source: str, end_id: int):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(source)
        self.whole.no_truncation()
        self.whole.no_padding()
        data = json.loads(source)
        self.specials = [t["content"] for t in data["added_tokens"]]
        by_blanks = data | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.model = Tokenizer.from_str(json.dumps(by_blanks))
        vocab, suffix = data["model"]["vocab"], data["model"]["end_of_word_suffix"]
        self.closes = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.closes[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        split = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(split + "|\n").findall
        self.split_ascii = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|\n|[^\t-\r a-z0-9]+").findall
        # Words reach the model as letters for bytes; blanks and line ends only stand between them.
        self.letters = {byte: letter for byte, letter in byte_letters().items() if letter != chr(byte) and byte not in b" \n"}
        self.end = np.int32(end_id).tobytes()
        self.words = WordCache(self._encode_words)

    def _split(self, pieces: list[str]) -> list[str]:
        """Words of normalised ``pieces``, with a line end between one piece and the next."""
        joined = "\n".join(pieces)
        if joined.isascii():
            return self.split_ascii(joined.lower())
        joined = unicodedata.normalize("NFC", joined)
        # Only the lower case of sigma depends on what stands around it.
        lowered = "".join([c.lower() for c in joined]) if "\u03a3" in joined else joined.lower()
        return self.split(lowered)

    def _encode_words(self, words: list[str]) -> list[bytes]:
        words = [w if w != "\n" else "" for w in words]
        chunks = [" ".join(words[k : k + 2_000]) for k in range(0, len(words), 2_000)]
        chunks = [c if c.isascii() and c.isprintable() else c.encode().decode("latin-1").translate(self.letters) for c in chunks]
        encoded = self.model.encode_batch_fast(chunks, add_special_tokens=False)
        ids = np.array([i for e in encoded for i in e.ids], dtype="<i4")
        raw, ends = ids.tobytes(), ((np.flatnonzero(self.closes[ids]) + 1) * 4).tolist()
        made = (raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True))
        return [next(made) if w else b"" for w in words]

    def _group(self, pieces: list[str]) -> pa.ListArray:
        """Ids of pieces without special tokens: a word that repeats in them is looked up once."""
        words = pa.array(self._split([*pieces, ""]), type=pa.string()).dictionary_encode()
        known = _lists(self.words.of(strings(words.dictionary)))
        at = words.indices.to_numpy()
        ends = np.flatnonzero(at == words.dictionary.index("\n").as_py())
        bounds = np.cumsum(pc.list_value_length(known).to_numpy()[at])[ends]
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], bounds]), type=pa.int32()), known.take(words.indices).flatten())

    def _encode_pieces(self, pieces: pa.StringArray) -> tuple[pa.ListArray, np.ndarray]:
        """Ids of distinct pieces in an order of their own, and the place of each in it."""
        plain = pc.string_is_ascii(pieces).to_numpy(zero_copy_only=False)
        special = np.zeros(len(pieces), dtype=bool)
        for s in self.specials:
            special |= pc.match_substring(pieces, s).to_numpy(zero_copy_only=False)
        groups = [np.flatnonzero(plain & ~special), np.flatnonzero(~plain & ~special), np.flatnonzero(special)]
        made = [self._group(strings(pieces.take(pa.array(group)))) for group in groups[:2] if len(group)]
        if len(groups[2]):
            whole = [self.whole.encode(p, add_special_tokens=False).ids for p in strings(pieces.take(pa.array(groups[2])))]
            made.append(pa.array(whole, type=pa.list_(pa.int32())))
        place = np.empty(len(pieces), dtype=np.int64)
        place[np.concatenate(groups)] = np.arange(len(pieces))
        return pa.concat_arrays(made or [_lists([])]), place

    def __call__(self, texts: pa.Array) -> pa.ListArray:
        """Ids of every text, with the end id; a piece that repeats in these texts is encoded once."""
        texts = pc.fill_null(texts, "")
        for blank in "\n\t":
            texts = pc.replace_substring(texts, blank, " ")
        cut = pc.split_pattern(texts, " ")
        coded = cut.flatten().dictionary_encode()
        made, place = self._encode_pieces(coded.dictionary)
        # Piece 0 is the end id: one after the last piece of each text.
        known = pa.concat_arrays([_lists([self.end]), made])
        ends = np.cumsum(pc.list_value_length(cut).to_numpy())
        pieces = np.insert(place[coded.indices.to_numpy()] + 1, ends, 0)
        bounds = np.cumsum(pc.list_value_length(known).to_numpy()[pieces])[ends + np.arange(len(ends))]
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], bounds]), type=pa.int32()), known.take(pa.array(pieces)).flatten())


def _lists(values: list[bytes]) -> pa.ListArray:
    """Little-endian int32 values as lists."""
    bounds = np.cumsum([0, *map(len, values)]) // 4
    return pa.ListArray.from_arrays(pa.array(bounds, type=pa.int32()), pa.array(np.frombuffer(b"".join(values), dtype="<i4")))


def _encoder(source: str, end_id: int) -> _Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return kept(("tokenizers", source, end_id), lambda: _Encoder(source, end_id))


def write(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    end_id: int = 2,
    row_group_bytes: int = 64 << 20,
    page_bytes: int = 256 << 10,
    page_rows: int = 2_000,
) -> None:
    """Encode ``docs`` (doc_id, text) and write them to ``path`` in ascending doc_id order."""
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        source = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(source.value, end_id)
        for batch in batches:
            for part in slices(batch, "text", _SLICE_BYTES):
                ids = encode(part.column("text"))
                lengths = pc.list_value_length(ids).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lengths, ids], ["doc_id", "n_tokens", "ids"])

    (
        docs.select("doc_id", "text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(run, FILE_SCHEMA)
        .write.option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.dictionary.page.size", 2 << 20)
        .option("parquet.enable.dictionary", "true")
        .option("parquet.writer.version", "v2")
        .option("compression", "zstd")
        .parquet(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows; the column ``file`` orders them as the ids were written."""
    return spark.read.schema(FILE_SCHEMA).parquet(path).withColumn("file", F.col("_metadata.file_name"))


def positions(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, read from the files.

    The total of each file comes from the length column alone; there is one row per file in
    the running sum over files, and documents are numbered within their file.
    """
    by_file = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        read(spark, path)
        .groupBy("file")
        .agg(F.sum("n_tokens").alias("total"))
        .select("file", F.coalesce(F.sum("total").over(by_file), F.lit(0)).alias("base"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            values = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<i4")
            ends = ids.offsets.to_numpy()
            crcs = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("file"), pa.array(np.diff(ends).astype(np.int64)), pa.array(crcs, type=pa.int64())],
                ["doc_id", "file", "n_tokens", "ids_crc32"],
            )

    rows = read(spark, path).select("doc_id", "file", "ids").mapInArrow(
        run, "doc_id bigint, file string, n_tokens bigint, ids_crc32 bigint"
    )
    before = Window.partitionBy("file").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    within = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return within.join(totals, "file").select(
        "doc_id", (F.col("base") + F.col("inside")).cast("long").alias("start"), "n_tokens", "ids_crc32"
    )
