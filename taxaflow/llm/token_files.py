"""Token ids in binary files with Elias-Fano document boundaries.

A folder holds one file for each block of documents, in ascending order of
``doc_id`` over all files.  A block is: magic, partition, block number, number of
documents, of ids and of documents without an id, id width, smallest doc_id; the
boundaries and the doc_ids as Elias-Fano sequences; the ids, concatenated, as
little-endian integers of the smallest fitting width; and a final line feed.

Spark's own writer commits the files, so a repeated or failed task leaves nothing
behind, and they can lie in any store that Spark writes to.  Null text is empty:
just the end id.  Documents without a doc_id come first.  Rows with equal doc_id
follow each other in the order of their texts.  No documents give no file.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taxaflow.llm.common import claim, portions, remembers, utf8
from taxaflow.llm.elias_fano import EliasFano

MAGIC = b"TOKBLK01"
#: Big-endian, so that Spark can read the counts with ``hex`` and ``conv``.
HEAD = struct.Struct(">8sIIQQQBq")
#: Ids in a block, unless one document alone has more.
BLOCK_IDS = 1 << 21
#: Words whose ids a worker remembers.
REMEMBERED = 700_000
#: ASCII punctuation but for the apostrophe, which starts contractions.
CLOSING = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words of ASCII and Latin-1 letters alone.
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


class WordEncoder:
    """Ids of texts by a tokenizer that lower-cases, and never joins characters across white space or a letter and ASCII punctuation.

    Words are encoded once and remembered, without their case and with their closing
    punctuation apart; new ones of a batch go to the library together.  Those of plain
    letters go as one text, if the tokenizer marks the last token of a word.
    """

    def __init__(self, path: str, most: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.known: dict[bytes, bytes] = {}
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for token, i in self.tokenizer.get_vocab().items() if suffix and token.endswith(suffix)]] = True

    def _apart(self, words: list[bytes]) -> None:
        """Remembers the ids of words that the library gets one by one."""
        for word, coded in zip(words, self.tokenizer.encode_batch_fast([x.decode() for x in words], add_special_tokens=False)):
            self.known[word] = np.array(coded.ids, self.kind).tobytes()

    def _together(self, words: list[bytes]) -> None:
        """Remembers the ids of plain words: one text of them has one last token for each."""
        coded = self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0]
        ids = np.array(coded.ids, self.kind)
        ends = (np.flatnonzero(self.last[ids]) + 1) * ids.itemsize
        if len(ends) != len(words):
            return self._apart(words)
        data, ends = ids.tobytes(), ends.tolist()
        self.known.update(zip(words, [data[a:b] for a, b in zip([0, *ends], ends)]))

    def _learn(self, new: set[bytes]) -> None:
        apart, plain, other = {}, set(), set()
        for word in new:
            stem = word.rstrip(CLOSING)
            if stem.isalpha() or PLAIN.fullmatch(stem):
                plain.add(stem)
            elif not stem or len(stem) == len(word) or not unicodedata.normalize("NFC", stem.decode()[-1]).lower()[-1].isalpha():
                other.add(word)
                continue
            else:
                other.add(stem)
            if len(stem) < len(word):
                closing = word[len(stem) :]
                apart[word] = stem, closing
                other.add(closing)
        for own, learn in ((plain, self._together if self.last.any() else self._apart), (other, self._apart)):
            own = [word for word in own if word not in self.known]
            for i in range(0, len(own), 4096):
                learn(own[i : i + 4096])
        for word, (stem, closing) in apart.items():
            self.known[word] = self.known[stem] + self.known[closing]

    def encode(self, texts: list[bytes], end: int) -> list[bytes]:
        """Ids of each text and the end id, as little-endian integers."""
        split = [x.lower().split() for x in texts]
        own = set().union(*split)
        new = own.difference(self.known)
        if len(self.known) + len(new) > self.most:
            self.known = {word: self.known[word] for word in own - new}  # the present words are the likeliest to come back
        self._learn(new)
        last, known = np.array([end], self.kind).tobytes(), self.known.__getitem__
        return [b"".join([*map(known, words), last]) for words in split]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


remembers("token_files", encoder.cache_clear)


def _block(part: int, number: int, ids: list[bytes], doc_ids: list[int | None], kind: str) -> bytes:
    width = np.dtype(kind).itemsize
    ends = np.cumsum([len(x) // width for x in ids])
    known = [x for x in doc_ids if x is not None]
    base = known[0] if known else 0
    head = HEAD.pack(MAGIC, part, number, len(ids), int(ends[-1]), len(doc_ids) - len(known), width, base)
    return b"".join([head, EliasFano.of(ends).to_bytes(), EliasFano.of(np.array([x - base for x in known], np.uint64)).to_bytes(), *ids])


def write_ids(docs: DataFrame, folder: str, path: str, end: int, block_ids: int = BLOCK_IDS) -> None:
    """Encode ``docs`` (doc_id, text) by the tokenizer in file ``path`` and write the blocks to ``folder``."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("token_files")
        coder, part, number = encoder(path), TaskContext.get().partitionId(), 0
        width = np.dtype(coder.kind).itemsize
        ids, doc_ids, held = [], [], 0
        for batch in batches:
            texts = utf8(batch.column(1))
            every = chain.from_iterable(coder.encode(texts[rows], end) for rows in portions(texts))
            for doc_id, coded in zip(batch.column(0).to_pylist(), every):
                if held and held + len(coded) > block_ids * width:
                    yield pa.record_batch([pa.array([_block(part, number, ids, doc_ids, coder.kind)], pa.binary())], ["value"])
                    ids, doc_ids, held, number = [], [], 0, number + 1
                ids.append(coded)
                doc_ids.append(doc_id)
                held += len(coded)
        if ids:
            yield pa.record_batch([pa.array([_block(part, number, ids, doc_ids, coder.kind)], pa.binary())], ["value"])

    # the second column parts equal ids, should one of them have very many rows
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = own.withColumn("tie", F.xxhash64("text")).repartitionByRange(F.asc_nulls_first("doc_id"), "tie").sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie", "text")
    # a cast from binary keeps the bytes, and a text file holds them as they are
    rows = ordered.select("doc_id", "text").mapInArrow(blocks, "value binary")
    rows.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).text(folder)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """What the files say: doc_id, start (ids of all documents before), n_tokens and ids_crc32 for each document."""

    def number(start: int, size: int) -> F.Column:
        return F.conv(F.hex(F.substring("content", start, size)), 16, 10).cast("long")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                yield pa.RecordBatch.from_pydict(_documents(data.as_py()), schema=SCHEMA)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    # one row for each block: running totals of these few rows give every block its start
    before = Window.orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select(number(9, 4).alias("part"), number(13, 4).alias("block"), number(25, 8).alias("n_ids"))
    starts = starts.select("part", "block", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("block_start"))
    rows = files.select("content").mapInArrow(documents, "part long, block long, doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "block"]).select("doc_id", (F.col("block_start") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


SCHEMA = pa.schema([(x, pa.int64()) for x in ("part", "block", "doc_id", "start", "n_tokens", "ids_crc32")])


def _documents(data: bytes) -> dict[str, list]:
    magic, part, block, n_docs, n_ids, without, width, base = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token block")
    ends, at = EliasFano.from_bytes(data, HEAD.size)
    doc_ids, at = EliasFano.from_bytes(data, at)
    ids = np.frombuffer(data, f"<u{width}", n_ids, at).astype("<u4")
    stops = ends.values().astype(np.int64)
    begins = np.concatenate([[0], stops[:-1]]).astype(np.int64)
    return {
        "part": [part] * n_docs,
        "block": [block] * n_docs,
        "doc_id": [None] * without + (doc_ids.values().astype(np.int64) + base).tolist(),
        "start": begins,
        "n_tokens": stops - begins,
        "ids_crc32": [zlib.crc32(ids[a:b]) for a, b in zip(begins, stops)],
    }


def read_document(data: bytes, i: int) -> np.ndarray:
    """Ids of document ``i`` of a block, found by two selects."""
    *_, n_ids, _, width, _ = HEAD.unpack_from(data)
    ends, at = EliasFano.from_bytes(data, HEAD.size)
    _, at = EliasFano.from_bytes(data, at)
    start = ends.select(i - 1) if i else 0
    return np.frombuffer(data, f"<u{width}", n_ids, at)[start : ends.select(i)]
