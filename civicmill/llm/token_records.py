"""Token-ID / binary output: length-delimited records with masked checksums and a separate offset index.

A record file is a run of frames, one per document, in ascending ``doc_id`` order within and across files::

    length of the payload   u64, little-endian
    masked CRC-32 of those eight bytes   u32
    payload: doc_id i64 | has_id u8 | bytes per id u8 | the ids, little-endian
    masked CRC-32 of the payload   u32
    0x0A

A mask rotates a CRC right by 15 bits and adds ``0xa282ead8``, so that a checksum over data that holds checksums stays
sound. Ids take two bytes where the vocabulary allows it, else four. Spark's own writers lay the files down, so a task
that is lost or run twice leaves no partial file, and any file system that Spark can reach will do.

The index has a row per frame (file, position, length, ids before it in the file): a reader shuffles index rows and
seeks, without reading the files in order.

Edge cases: a null text is an empty document (the end id alone); a null ``doc_id`` sorts first; rows with equal
``doc_id`` each get a frame, ordered by text; an empty table gives no frames; other columns are not looked at.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civicmill.llm.common import saved, shared_dir, small_batches

#: Fixed values of the frame format.
MASK_DELTA = 0xA282EAD8
HEAD, ENTRY, TAIL = "<QI", "<qBB", "<I"

#: A word of unaccented or Latin-1 letters, then punctuation: for these, letters and punctuation are separate pieces.
#: No apostrophe, which opens contractions, and no "<" or "|", of which special tokens are made.
PLAIN_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!\"#$%&()*+,\-./:;=?@\[\]^_`{}~]*)")


def byte_letters() -> dict[int, int]:
    """How byte-level vocabularies write the bytes that Latin-1 doesn't print: as the characters from 256 on, in order."""
    printed = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in printed)}


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """A frame without its closing line feed, which the text writer adds."""
    length = struct.pack("<Q", len(payload))
    return length + struct.pack(TAIL, masked_crc(length)) + payload + struct.pack(TAIL, masked_crc(payload))


def frames(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(position, payload) of each frame; a damaged file raises ValueError."""
    at = 0
    while at < len(content):
        length, crc = struct.unpack_from(HEAD, content, at)
        if masked_crc(content[at : at + 8]) != crc:
            raise ValueError(f"checksum of the length at byte {at}")
        begin = at + struct.calcsize(HEAD)
        payload = content[begin : begin + length]
        if len(payload) != length or struct.unpack_from(TAIL, content, begin + length)[0] != masked_crc(payload):
            raise ValueError(f"checksum of the payload at byte {begin}")
        yield at, payload
        at = begin + length + struct.calcsize(TAIL) + 1


#: How a tokenizer file that drops white space and lower-cases describes its first two steps.
WORD_STEPS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)


class WordEncoder:
    """Encodes whole texts, word by word where the tokenizer drops white space and never merges across it.

    Every id comes from the tokenizer; a bounded memo saves encoding a word again. Words of plain letters skip the
    tokenizer's normaliser, which leaves them as they are but for case, and go to its merge model; all others pass
    through the whole tokenizer. Only spaces and line feeds part words here: rarer white space stays inside a word,
    where the tokenizer deals with it. A tokenizer whose file describes other first steps encodes whole texts.
    """

    def __init__(self, path: str, memo_words: int = 250_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.by_word = (spec["normalizer"], spec["pre_tokenizer"]) == WORD_STEPS and spec["model"]["type"] == "BPE"
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.pieces, self.byte_letters = self.tokenizer.model.tokenize, byte_letters()
        self.code = {2: "H", 4: "I"}[self.width]
        self.memo_words = memo_words
        self.words: dict[str, bytes] = {"": b""}
        self.cores: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def word(self, word: str) -> bytes:
        plain = PLAIN_WORD.fullmatch(word)
        if not plain:
            return self.whole(word)
        letters, marks = plain.groups()
        if len(letters) > 64:
            return self.whole(word)
        letters = letters.lower()
        ids = self.cores.get(letters)
        if ids is None:
            mapped = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.byte_letters)
            ids = self.cores[letters] = array(self.code, [t.id for t in self.pieces(mapped)]).tobytes()
        if not marks:
            return ids
        if marks not in self.marks:
            if len(self.marks) > 10_000:
                self.marks = {}
            self.marks[marks] = self.whole(marks)
        return ids + self.marks[marks]

    def batch(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return [self.whole(text) for text in texts]
        cut = [text.replace("\n", " ").split(" ") for text in texts]
        here: set[str] = set().union(*cut)
        for word in here:
            if word not in self.words:
                self.words[word] = self.word(word)
        out = [b"".join(map(self.words.__getitem__, words)) for words in cut]
        for word in here:
            if len(word) > 64:  # so the memo is bounded in bytes as well
                del self.words[word]
        if len(self.words) > self.memo_words:
            self.words = {word: self.words[word] for word in here if len(word) <= 64} | {"": b""}
        if len(self.cores) > self.memo_words:
            self.cores = {}
        return out


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One for each worker process, which serves many tasks."""
    return WordEncoder(path)


def chunks(texts: list[str], n_chars: int = 2_000_000) -> Iterator[slice]:
    """Slices of about ``n_chars`` characters."""
    begin = total = 0
    for i, text in enumerate(texts):
        total += len(text)
        if total >= n_chars:
            yield slice(begin, i + 1)
            begin, total = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def _framed(tokenizer_path: str, end_id: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = word_encoder(tokenizer_path)
        end = np.array([end_id], encoder.dtype).tobytes()
        for batch in batches:
            texts = ["" if t is None else t for t in batch["text"]]
            keys, known = batch["key"].tolist(), batch["known"].tolist()
            for part in chunks(texts):
                ids = encoder.batch(texts[part])
                yield pd.DataFrame({"record": [frame(struct.pack(ENTRY, k, has, encoder.width) + i + end) for k, has, i in zip(keys[part], known[part], ids, strict=True)]})

    return run


def write_records(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 2, text_mb_per_file: int = 48) -> None:
    """Encode ``docs`` (doc_id, text) and write record files below ``path``, ordered by ``doc_id`` across file names.

    One range exchange of the texts brings them into order; nothing is encoded before it, so Spark's sampling of the
    ranges reads ids and texts but tokenizes nothing.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n_bytes = docs.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-int(n_bytes) // (text_mb_per_file << 20)))
    # Rows that share an id, or have none, are parted by how their text begins; what the driver samples stays short.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    rows = rows.select(F.coalesce("doc_id", F.lit(0)).alias("key"), F.col("doc_id").isNotNull().alias("known"), "text")
    records = rows.mapInPandas(_framed(tokenizer_path, end_id), "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def _indexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            rows, before = [], 0
            for at, payload in frames(content):
                doc_id, known, width = struct.unpack_from(ENTRY, payload)
                ids = np.frombuffer(payload, f"<u{width}", offset=struct.calcsize(ENTRY))
                rows.append((path, at, len(payload), doc_id if known else None, before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                before += len(ids)
            out = pd.DataFrame(rows, columns=["path", "position", "length", "doc_id", "before", "n_tokens", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The offset index, read from the files themselves with every checksum verified."""
    schema = "path string, position long, length long, doc_id long, before long, n_tokens long, ids_crc32 long"
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(_indexed, schema)


def with_starts(index: DataFrame) -> DataFrame:
    """Adds ``start``: ids in all frames before. Only one row per file passes through the running sum over files.

    Files follow each other by the number in their name, which has five digits or more.
    """
    totals = index.groupBy("path").agg(F.sum("n_tokens").alias("total"))
    number = F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("long")
    before = F.coalesce(F.sum("total").over(Window.orderBy(number, "path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select("path", before.cast("long").alias("file_start"))
    return index.join(starts, "path").withColumn("start", F.col("file_start") + F.col("before"))


def token_records(docs: DataFrame, tokenizer_path: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write record files and their index; return the index with each document's first id position (``start``)."""
    spark = docs.sparkSession
    path = path or shared_dir(spark, "records")
    write_records(docs, tokenizer_path, f"{path}/files", end_id)
    read_index(spark, f"{path}/files").write.parquet(f"{path}/index")
    return with_starts(spark.read.parquet(f"{path}/index"))
