"""Token ids in Parquet files that can be read in part.

Every document becomes one row (doc_id, part, local_start, n_tokens, ids) with
`ids` a list of 32-bit integers.  Rows lie in ascending doc_id order within and
across parts.  The files use the second Parquet data-page format, in which
integers are dictionary encoded and fall back to delta encoding; row groups and
pages have set sizes, and every column chunk carries a page index, so a reader
can fetch single columns or doc_id ranges without touching other ids.

Encoding: a block of texts is cut at blanks and newlines, each distinct chunk of
the block goes through the tokenizer once, and the ids are put back in the
chunks' places, all in Arrow and numpy.  That holds for tokenizer files whose
tokens never cross a blank, which `Encoder` checks by their rules; with any other
file, whole texts go to the tokenizer as they are.

Defined results: a null text counts as empty and holds only the end id; equal
doc_ids keep one row each, ordered by text; null doc_ids come first; texts of any
length are encoded whole (a text longer than a block is a block of its own); an
empty table gives an empty file set; further columns of the input are ignored.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import blocks, prepare, scratch_dir, tidied

LAYOUT = {
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "true",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "compression": "zstd",
}
SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"
BLOCK_BYTES = 2 << 20
PART_BYTES = 256 << 20
MEMO_BYTES = 8 << 20
# The steps of the word-wise BPE files that are known to part texts at white space.
WORD_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: Latin letters, all of them composed and with a lower case of one character, and ASCII marks
#: without the apostrophe, which starts contractions: under WORD_SPLIT, letters are one piece and marks another.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
MARKS = r"!-&(-/:-@\[-`{-~"


class Coded:
    """Ids of many strings in one array: string i has `size[i]` of them from `start[i]` on."""

    def __init__(self, ids: np.ndarray, size: np.ndarray) -> None:
        self.ids, self.size, self.start = ids, size, np.cumsum(size) - size

    def take(self, at: np.ndarray) -> Coded:
        """Of the strings numbered in `at`, in that order."""
        n = self.size[at]
        return Coded(self.ids[np.repeat(self.start[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n)

    def joined(self, bounds: np.ndarray) -> Coded:
        """Of longer strings: string i is made of the strings bounds[i]:bounds[i + 1]."""
        return Coded(self.ids, np.diff(np.concatenate([[0], np.cumsum(self.size)])[bounds]))

    def __add__(self, other: Coded) -> Coded:
        return Coded(np.concatenate([self.ids, other.ids]), np.concatenate([self.size, other.size]))


def _none() -> Coded:
    return Coded(np.zeros(0, np.int32), np.zeros(0, np.int64))


class Encoder:
    """A tokenizer file, applied to blocks of texts."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        steps = [x["type"] for x in (rules.get("normalizer") or {}).get("normalizers", [])]
        cuts = [x.get("pattern", {}).get("Regex", x["type"]) for x in (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.word_wise = steps == WORD_NORMALIZERS and cuts == [WORD_SPLIT, "ByteLevel"] and rules["model"].get("end_of_word_suffix") == WORD_END
        # the same file, for texts that are cut into pieces already
        self.pieces = Tokenizer.from_file(path)
        self.pieces.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)  # ids that end a piece
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends[i] = token.endswith(WORD_END)
        self.forget()

    def forget(self) -> None:
        self.known, self.coded = pa.array([], pa.string()), _none()

    def distinct_pieces(self, pieces: pa.Array) -> Coded:
        """Of distinct pieces; those of earlier blocks are remembered up to MEMO_BYTES."""
        if self.known.nbytes + self.coded.ids.nbytes + 2 * self.coded.size.nbytes > MEMO_BYTES:
            self.forget()
        at = pc.index_in(pieces, value_set=self.known)
        fresh = pc.is_null(at).to_numpy(zero_copy_only=False)
        place = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        if fresh.any():
            new = pieces.filter(pa.array(fresh))
            listed = new.to_pylist()
            made = self.pieces.encode_batch_fast([" ".join(listed[i : i + 4096]) for i in range(0, len(listed), 4096)], add_special_tokens=False)
            ids = np.concatenate([np.array(c.ids, np.int32) for c in made])
            place[fresh] = len(self.known) + np.arange(len(new))
            self.coded += Coded(ids, np.diff(np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])))
            self.known = pa.concat_arrays([self.known, new])
        return self.coded.take(place)

    def distinct_chunks(self, chunks: pa.Array) -> Coded:
        plain = pc.match_substring_regex(chunks, f"^[{LETTERS}]*[{MARKS}]*$")
        parted = pc.replace_substring_regex(chunks.filter(plain), f"^([{LETTERS}]+)([{MARKS}]+)$", r"\1 \2")
        lists = pc.split_pattern(pc.utf8_lower(parted), " ")
        met = lists.flatten().dictionary_encode()
        # an empty chunk is one empty piece, which has no ids
        there = pc.not_equal(met.dictionary, "").to_numpy(zero_copy_only=False)
        coded = self.distinct_pieces(met.dictionary.filter(pa.array(there))) + Coded(np.zeros(0, np.int32), np.zeros(1, np.int64))
        place = np.where(there, np.cumsum(there) - 1, len(coded.size) - 1)
        simple = coded.take(place[met.indices.to_numpy()]).joined(np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]))
        others = self.whole(chunks.filter(pc.invert(plain)))
        plain = plain.to_numpy(zero_copy_only=False)
        return (simple + others).take(np.where(plain, np.cumsum(plain) - 1, len(simple.size) + np.cumsum(~plain) - 1))

    def whole(self, texts: pa.Array) -> Coded:
        coded = [np.array(c.ids, np.int32) for c in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        return Coded(np.concatenate(coded), np.array([len(x) for x in coded], np.int64)) if coded else _none()

    def block(self, texts: pa.Array) -> Coded:
        texts = pc.fill_null(texts, "")
        if not self.word_wise:
            return self.whole(texts)
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        met = lists.flatten().dictionary_encode()
        return self.distinct_chunks(met.dictionary).take(met.indices.to_numpy()).joined(np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The one of this worker process for a file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None, partitions: int | None = None) -> str:
    """Encode every text and write the files; returns their folder.

    Only the texts are dealt out once, by ranges of doc_id, into parts of about
    PART_BYTES or as many as the session's shuffles have; ids never are.
    """
    spark = docs.sparkSession
    prepare(spark)
    path = path or scratch_dir(spark)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((given.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / PART_BYTES))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, at = encoder(tokenizer_path), 0
        for batch in blocks(batches, BLOCK_BYTES):
            coded = code.block(batch.column("text"))
            ids, n_ids = np.insert(coded.ids, coded.start + coded.size, end_id), coded.size + 1
            ends = np.cumsum(n_ids)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
            made = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(at + ends - n_ids), pa.array(n_ids), lists], ["doc_id", "part", "local_start", "n_tokens", "ids"])
            yield from (made.slice(lo, 512) for lo in range(0, made.num_rows, 512))
            at += int(ends[-1])
        code.forget()  # idle workers hold nothing

    # rows of one doc_id, or without one, may lie in several parts; bounds are drawn from the texts' beginnings, which order them as the texts do
    dealt = given.repartitionByRange(n, F.col("doc_id"), F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    dealt.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(tidied(encode), SCHEMA).write.options(**LAYOUT).parquet(path)
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the files; selecting columns or doc_id ranges reads only their pages."""
    return spark.read.schema(SCHEMA).parquet(path)


def starts(files: DataFrame) -> DataFrame:
    """(part, part_start): ids in all parts before. One row for each file part, so the single-task sum is over few rows."""
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32."""

    def checksum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            at = ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            sizes = np.diff(at).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("local_start"), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])

    files = read_tokens(spark, path)
    rows = files.select("doc_id", "part", "local_start", "ids").mapInArrow(tidied(checksum), "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    # one row for each part file: as small as the list of files that the driver holds anyway
    return rows.join(F.broadcast(starts(files.select("part", "n_tokens"))), "part").select("doc_id", (F.col("part_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
