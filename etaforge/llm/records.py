"""Token ids in length-delimited binary record files with a separate offset index."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_dir, write_through
from .common import DROPS, partitions, ship, take_over

# A record is: length (uint64), masked crc of the length (uint32), payload, masked crc of the
# payload (uint32); all little-endian. A payload is the bytes an id takes (uint8: 2 for vocabularies
# of up to 65,536 ids, else 4) and the ids. An index entry is: doc_id (int64), 1 if doc_id is null
# (uint32), offset and length of the record (uint64 each).
HEAD, TAIL, ENTRY = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<qIQQ")
ENTRY_SIZE = ENTRY.size
MASK_DELTA = 0xA282EAD8
CACHE_WORDS = 700_000
SPACED = re.compile(r"\s | \s|\A | \Z")
INNER = re.compile(r" \S(?:.*\S)?\Z", re.DOTALL).match
CUT = re.compile(r"(?<=\S)(?= \S)")
_ENCODERS: dict = {}
DROPS[__name__] = _ENCODERS.clear


def masked(data: bytes) -> int:
    """Checksum rotated by 15 bits plus a constant, so that checksums of checksums stay apart."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + TAIL.pack(masked(length)) + payload + TAIL.pack(masked(payload))


def unframe(record: bytes) -> bytes:
    """Ids of one record; raises ValueError if a length or checksum does not hold."""
    n, crc = HEAD.unpack_from(record)
    if crc != masked(record[:8]) or len(record) != HEAD.size + n + TAIL.size:
        raise ValueError("broken record length")
    payload = record[HEAD.size : HEAD.size + n]
    if TAIL.unpack_from(record, HEAD.size + n)[0] != masked(payload):
        raise ValueError("broken record checksum")
    return payload


def pack_entry(key: int, none: int, offset: int, length: int) -> bytes:
    return ENTRY.pack(key, none, offset, length)


def unpack_entry(data: bytes) -> tuple[int, int, int, int]:
    return ENTRY.unpack(data)


class Encoder:
    """Byte-level BPE of whole texts as little-endian uint32 bytes: the plain encode() of the tokenizer,
    so the string of an added token such as <|endoftext|> becomes that token's id.

    No token of such a vocabulary spans the place before a single space between two other
    characters, so a text is the concatenation of its cut pieces' ids, and pieces are cached.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # A token's string has a sign per byte; an added token's string is its text.
        added = {i: t.content for i, t in self.tok.get_added_tokens_decoder().items()}
        words = {i: w for w, i in self.tok.get_vocab(with_added_tokens=True).items()}
        self.width = 2 if max(words, default=0) < 1 << 16 else 4
        self.sizes = np.zeros(max(words, default=0) + 1, np.int64)
        for i, w in words.items():
            self.sizes[i] = len(added[i].encode()) if i in added else len(w)

    @staticmethod
    def pieces(text: str) -> list[str]:
        if SPACED.search(text) or "\0" in text:
            return CUT.split(text)
        return text.replace(" ", "\0 ").split("\0")  # the plain case without a match per space

    def learn(self, new: list[str]) -> None:
        """Ids of new pieces. Those that begin with a space follow each other in a few long texts, as
        pieces of one text do, and the ids are dealt back by their bytes; a call each is far slower."""
        for group in (new[at : at + 5_000] for at in range(0, len(new), 5_000)):
            spaced = [p for p in group if INNER(p)]
            alone = list(set(group).difference(spaced))
            texts = [*alone, "".join(spaced)]
            found = [np.array(e.ids, np.int64) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
            for p, ids in zip(alone, found, strict=False):
                self.cache[p] = self.packed(ids)
            ids, packed = found[-1], self.packed(found[-1])
            ends = np.cumsum([len(p.encode("utf-8", "surrogatepass")) for p in spaced])
            at = np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1
            lo = 0
            for p, hi in zip(spaced, (at * self.width).tolist(), strict=True):
                self.cache[p] = packed[lo:hi]
                lo = hi

    def packed(self, ids) -> bytes:
        return np.asarray(ids).astype(f"<u{self.width}").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text, `width` bytes an id."""
        cut = [self.pieces(t) for t in texts]
        if len(self.cache) > CACHE_WORDS:  # the last two generations are kept, so frequent pieces stay
            self.older, self.cache = self.cache, {}
        unknown = set(chain.from_iterable(cut)).difference(self.cache)
        again = unknown.intersection(self.older)
        self.cache.update((p, self.older[p]) for p in again)
        self.learn(list(unknown - again))
        return [b"".join(map(self.cache.__getitem__, ps)) for ps in cut]


def ids_of(payload: bytes) -> np.ndarray:
    """Ids of a record's payload as little-endian unsigned 32-bit integers."""
    return np.frombuffer(payload, f"<u{payload[0]}", offset=1).astype("<u4")


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def qualified(spark, folder: str) -> str:
    """The folder with the scheme of the file system that Spark itself would use for it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString()
    return uri.replace("file:/", "file:///", 1) if re.match(r"file:/[^/]", uri) else uri


def write_records(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Encode texts, append end_id to each, and write record and index files in ascending doc_id order.

    Returns one row per file: part (its order), data and index path, records, ids, and the records
    and ids of all files before it. Each attempt of a task writes names of its own, and only the
    attempt that succeeds is in the returned table, so a lost executor leaves no half file behind
    in it. `folder` is a URI that all executors reach (default: a new one in the shared folder).
    Null texts count as empty (a record of the end id alone); null ids sort first; repeated rows
    get a record each; an empty table gives no files.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = qualified(spark, folder or scratch_dir(spark, "records"))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        take_over(__name__)
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        ctx, enc = TaskContext.get(), encoder(tokenizer)
        width, end = bytes([enc.width]), enc.packed([end_id])
        part = ctx.partitionId()
        name = f"part-{part:06d}-{ctx.taskAttemptId()}"
        n = ids = at = 0
        data = index = None
        for df in frames:
            for lo in range(0, len(df), 256):
                some = df.iloc[lo : lo + 256]
                if data is None:
                    data = fs.open_output_stream(f"{base}/{name}.rec")
                    index = fs.open_output_stream(f"{base}/{name}.idx")
                texts = ["" if t is None else t for t in some["text"]]
                for key, none, got in zip(some["id"], some["none"], enc.encode(texts), strict=True):
                    record = frame(width + got + end)
                    data.write(record)
                    index.write(pack_entry(key, none, at, len(record)))
                    n, ids, at = n + 1, ids + len(got) // enc.width + 1, at + len(record)
        if data is not None:
            data.close()
            index.close()
            yield pd.DataFrame({"part": [part], "data": [f"{base}/{name}.rec"], "idx": [f"{base}/{name}.idx"], "n": [n], "ids": [ids]})

    files = write_through(
        docs.select(
            F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("id"),
            F.when(F.col("doc_id").isNull(), 1).otherwise(0).alias("none"),
            "text",
        )
        .withColumn("tie", F.xxhash64("text"))  # rows without an id, or of one id, may be many
        .repartitionByRange(partitions(spark), F.col("none").desc(), "id", "tie")
        .sortWithinPartitions(F.col("none").desc(), "id", "tie")
        .drop("tie")
        .mapInPandas(write, "part int, data string, idx string, n long, ids long"),
        "record-files",
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.select(
        "*",
        F.lit(folder).alias("folder"),
        F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("ids_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
    )


def read_records(files: DataFrame) -> DataFrame:
    """One row per record of the files: doc_id, record (its number), start, n_tokens, ids_crc32.

    Every length and checksum is verified; a broken file raises. A task streams one file after
    another, holding one record at a time. Of no files, no rows.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for f in df.itertuples():
                fs, _ = pafs.FileSystem.from_uri(f.folder)
                start, out, number = f.ids_before, [], f.n_before
                with fs.open_input_stream(f.data) as data, fs.open_input_stream(f.idx) as index:
                    at = 0
                    for _ in range(f.n):
                        key, none, offset, length = unpack_entry(index.read(ENTRY_SIZE))
                        if offset != at:
                            raise ValueError(f"index of {f.data} does not fit")
                        got = ids_of(unframe(data.read(length)))
                        n = len(got)
                        out.append((None if none else key, number, start, n, zlib.crc32(got)))
                        start, at, number = start + n, at + length, number + 1
                        if len(out) >= 5_000:
                            yield _rows(out)
                            out = []
                if out:
                    yield _rows(out)

    spread = files.repartitionByRange(partitions(files.sparkSession), "part")
    return spread.mapInPandas(read, "doc_id long, record long, start long, n_tokens long, ids_crc32 long")


def read_at(files: DataFrame, records: DataFrame) -> DataFrame:
    """Ids of single records in any order, through the index: `records` has a long column `record`."""
    from pyspark.sql import types as T

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            out = []
            for f in df.itertuples():
                fs, _ = pafs.FileSystem.from_uri(f.folder)
                with fs.open_input_file(f.idx) as index, fs.open_input_file(f.data) as data:
                    _, _, offset, length = unpack_entry(index.read_at(ENTRY_SIZE, (f.record - f.n_before) * ENTRY_SIZE))
                    out.append((f.record, ids_of(unframe(data.read_at(length, offset))).tolist()))
            yield pd.DataFrame(out, columns=["record", "ids"])

    span = (F.col("record") >= F.col("n_before")) & (F.col("record") < F.col("n_before") + F.col("n"))
    schema = T.StructType([T.StructField("record", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType()))])
    return records.join(F.broadcast(files), span).mapInPandas(read, schema)  # one row per file


def _rows(out: list[tuple]) -> pd.DataFrame:
    df = pd.DataFrame(out, columns=["doc_id", "record", "start", "n_tokens", "ids_crc32"])
    return df.astype({"doc_id": "Int64"})
