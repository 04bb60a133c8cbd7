"""Token ids in files of independent zstandard frames with a trailing seek table.

File layout, little-endian:

- frames: each the zstandard compression of the ids of some consecutive documents, by itself readable;
- the frame of the index: zstandard compression of one record ``(doc_id int64, ids uint32, frame uint32)`` a document;
- the seek table, a zstandard skippable frame (magic 0x184D2A5E, uint32 size): one entry
  ``(compressed uint32, raw uint32, first document uint32, crc32 of the raw bytes uint32)`` a frame, the index last;
- footer, the last 25 bytes of that skippable frame: frames uint32, documents uint32, ids uint64,
  bytes an id uint8 (2 or 4), crc32 of the seek table uint32, magic uint32 0x4B544F4B.

A reader takes the footer, then the seek table, then the index, then only the frames that hold the documents asked
for; every frame is held against its checksum. Ids are kept in 2 bytes if the vocabulary allows it.

Files are numbered in ascending id of their documents: Spark deals the documents out by ranges of the id, each task
writes files one after the other, each of at most FILE_DOCS documents and about FILE_IDS ids, under names of their own
and renames them, so a repeated task leaves the same files. A task's memory grows with one file at most.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path

#: Fixed values of the layout.
SKIPPABLE, FOOTER_MAGIC = 0x184D2A5E, 0x4B544F4B
ENTRY, FOOTER = struct.Struct("<IIII"), struct.Struct("<IIQBII")
INDEX = np.dtype([("doc_id", "<i8"), ("ids", "<u4"), ("frame", "<u4")])
#: Raw bytes at which a frame ends (at a document's end).
FRAME_BYTES = 1 << 18
WORD_TABLE = 1_000_000
#: The white space at which the normaliser of the word-end tokenizer cuts.
_WHITE = re.compile("[^\t-\r \x85\xa0  -     　]+")
#: Signs that the tokenizer parts from a letter before them, unless the letter normalises to more than letters.
_SIGNS = frozenset(".,;:!?")
#: Ids and documents at which a file ends and the next begins.
FILE_IDS, FILE_DOCS = 1 << 27, 1 << 20
_ENCODERS: dict[str, WordEncoder] = {}


class _Plain(dict):
    """Whether a character is a letter that normalises to letters."""

    def __init__(self, normaliser):
        super().__init__()
        self.normaliser = normaliser

    def __missing__(self, c: str) -> bool:
        out = self[c] = c.isalpha() and (c.isascii() or self.normaliser is None or self.normaliser.normalize_str(c).isalpha())
        return out


class WordEncoder:
    """Texts as rows of words, for a tokenizer that drops white space and marks the last id of each run of letters.

    A word is encoded by the tokenizers library once and then kept, until WORD_TABLE words are kept. Words of letters
    only are encoded many at a time, parted by spaces, and told apart by their last ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.last = np.zeros(self.size, bool)
        self.last[[i for p, i in self.tokenizer.get_vocab().items() if p.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}
        self.plain = _Plain(self.tokenizer.normalizer)

    def _letters(self, text: str) -> bool:
        """Whether a text is of letters and stays so when normalised: a letter may become a letter and a mark."""
        return text.isalpha() and (text.isascii() or all(map(self.plain.__getitem__, text)))

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _keep(self, run: list[str], ids: np.ndarray, bounds: list[int]) -> None:
        data = ids.tobytes()
        for x, a, b in zip(run, bounds[:-1], bounds[1:], strict=True):
            self.words[x] = data[4 * a : 4 * b]

    def _learn(self, new: set[str]) -> None:
        words, plain, parts = self.words, self.plain, {}
        for w in new:
            # within Latin letters, lower case and a sign parted from the letter before it are what the tokenizer makes of them
            stem = w[:-1] if w[-1] in _SIGNS and len(w) > 1 and plain[w[-2]] and "<" not in w else w
            low = stem.lower() if max(stem) < "\u0130" and "<" not in stem else stem
            parts[w] = (low, w[len(stem) :])
        need = {x for pair in parts.values() for x in pair if x}.difference(words)
        letters = [x for x in need if self._letters(x)]
        for k in range(0, len(letters), 2000):
            run = letters[k : k + 2000]
            ids = self._ids(" ".join(run))
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(run):
                self._keep(run, ids, [0, *ends.tolist()])
        # others are told apart by where their ids begin; no id reaches over a space
        others = [x for x in need.difference(words) if "<" not in x]
        for k in range(0, len(others), 2000):
            run = others[k : k + 2000]
            found = self.tokenizer.encode(" ".join(run), add_special_tokens=False)
            begins = np.concatenate([[0], np.cumsum([len(x) + 1 for x in run])])
            at = np.searchsorted([o[0] for o in found.offsets], begins)
            self._keep(run, np.array(found.ids, "<u4"), at.tolist())
        for x in need.difference(words):
            words[x] = self._ids(x).tobytes()
        for w, (stem, sign) in parts.items():
            if w not in words:
                words[w] = words[stem] + words[sign] if sign else words[stem]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian uint32."""
        rows = [[] if not t else _WHITE.findall(t) if any(c in t for c in "\x1c\x1d\x1e\x1f") else t.split() for t in texts]
        if len(self.words) > WORD_TABLE:
            self.words.clear()
        if new := set().union(*rows).difference(self.words):
            self._learn(new)
        get = self.words.__getitem__
        return [b"".join(map(get, r)) for r in rows]


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class Writer:
    """Writes one file; ids come as little-endian uint32 bytes, a document at a time."""

    def __init__(self, out, id_bytes: int):
        self.out, self.kind, self.id_bytes = out, np.dtype(f"<u{id_bytes}"), id_bytes
        self.frames: list[bytes] = []
        self.pending, self.size, self.index = [], 0, array("q")
        self.first = self.n_ids = 0
        self.zstd = zstandard.ZstdCompressor(level=3)

    def add(self, doc_id: int, ids: bytes) -> None:
        raw = np.frombuffer(ids, "<u4").astype(self.kind).tobytes()
        self.index.extend((doc_id, len(ids) // 4, len(self.frames)))
        self.n_ids += len(ids) // 4
        self.pending.append(raw)
        self.size += len(raw)
        if self.size >= FRAME_BYTES:
            self._flush()

    @property
    def n_docs(self) -> int:
        return len(self.index) // 3

    @property
    def full(self) -> bool:
        return self.n_ids >= FILE_IDS or self.n_docs >= FILE_DOCS

    def _frame(self, raw: bytes, first: int) -> None:
        data = self.zstd.compress(raw)
        self.out.write(data)
        self.frames.append(ENTRY.pack(len(data), len(raw), first, zlib.crc32(raw)))

    def _flush(self) -> None:
        if self.pending:
            self._frame(b"".join(self.pending), self.first)
            self.pending, self.size, self.first = [], 0, self.n_docs

    def close(self) -> None:
        self._flush()
        index = np.empty(self.n_docs, INDEX)
        for k, name in enumerate(INDEX.names):
            index[name] = np.frombuffer(self.index, np.int64)[k::3]
        self._frame(index.tobytes(), 0)
        table = b"".join(self.frames)
        foot = FOOTER.pack(len(self.frames), self.n_docs, self.n_ids, self.id_bytes, zlib.crc32(table), FOOTER_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + len(foot)) + table + foot)


class Reader:
    """Reads documents of one file by their place, decompressing only the frames that hold them."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - FOOTER.size)
        n, self.n_docs, self.n_ids, self.id_bytes, check, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != FOOTER_MAGIC:
            raise ValueError("not a token file")
        file.seek(size - FOOTER.size - n * ENTRY.size)
        table = file.read(n * ENTRY.size)
        if zlib.crc32(table) != check:
            raise ValueError("the seek table doesn't match its checksum")
        self.entries = [ENTRY.unpack_from(table, i * ENTRY.size) for i in range(n)]
        self.at = np.concatenate([[0], np.cumsum([e[0] for e in self.entries], dtype=np.int64)])
        self.zstd = zstandard.ZstdDecompressor()
        self.index = np.frombuffer(self._raw(n - 1), INDEX)
        self.starts = np.concatenate([[0], np.cumsum(self.index["ids"], dtype=np.int64)])
        self.have: tuple[int, bytes] = (-1, b"")

    def _raw(self, k: int) -> bytes:
        size, raw_size, _, check = self.entries[k]
        self.file.seek(int(self.at[k]))
        raw = self.zstd.decompress(self.file.read(size), max_output_size=max(raw_size, 1))
        if zlib.crc32(raw) != check:
            raise ValueError(f"frame {k} doesn't match its checksum")
        return raw

    def ids(self, place: int) -> np.ndarray:
        """The ids of the document at a place, as uint32."""
        frame = int(self.index["frame"][place])
        if self.have[0] != frame:
            self.have = (frame, self._raw(frame))
        base = self.starts[self.entries[frame][2]]
        kind = np.dtype(f"<u{self.id_bytes}")
        part = self.have[1][int(self.starts[place] - base) * self.id_bytes : int(self.starts[place + 1] - base) * self.id_bytes]
        return np.frombuffer(part, kind).astype("<u4")


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Encode every text and write the ids under ``path``; returns (part int, file string, n_docs long, n_ids long), a row a file.

    Texts go whole through the tokenizer without special tokens (null: no ids), then ``end_id`` follows. Rows come in
    ascending id order; rows of one id stay next to each other in no set order; a null id is written as the least
    int64. The id is cast to long; other columns are not read.
    """
    spark = docs.sparkSession
    n = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out, files = None, None, 0

        def finish() -> pa.RecordBatch:
            out.close()
            stream.close()
            store.move(temp, name)
            return pa.RecordBatch.from_pylist([{"part": part, "file": name, "n_docs": out.n_docs, "n_ids": out.n_ids}], pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

        for b in batches:
            if b.num_rows and enc is None:
                enc = encoder(tokenizer)
                store, root = pafs.FileSystem.from_uri(path)
                store.create_dir(root, recursive=True)
                part = TaskContext.get().partitionId()
            for k in range(0, b.num_rows, 128):
                part_ids, texts = (b.column(c).slice(k, 128).to_pylist() for c in (0, 1))
                for i, ids in zip(part_ids, enc.encode_all(texts), strict=True):
                    if out is None:
                        name, temp = f"{root}/part-{part:06d}-{files:06d}.tok", f"{root}/.{uuid.uuid4().hex}"
                        stream = store.open_output_stream(temp)
                        out = Writer(stream, 2 if max(enc.size, (end_id or 0) + 1) <= 1 << 16 else 4)
                    out.add(i, ids + tail)
                    if out.full:
                        yield finish()
                        out, files = None, files + 1
        if out is not None:
            yield finish()

    rows = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(-(2**63))).alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.repartitionByRange(n, "id").sortWithinPartitions("id").mapInArrow(run, "part int, file string, n_docs long, n_ids long")


def read_token_files(spark: SparkSession, path: str, files: list[tuple[str, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document. ``files``: each file with the ids of all files before it; a task reads whole files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(path)
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_input_file(name) as f:
                    r = Reader(f)
                    crc = [zlib.crc32(r.ids(i).tobytes()) for i in range(r.n_docs)]
                    yield pa.RecordBatch.from_arrays([pa.array(r.index["doc_id"]), pa.array(r.starts[:-1] + base), pa.array(r.index["ids"].astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    table = spark.createDataFrame(files, "file string, base long")
    return table.repartition(max(1, len(files))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long") if files else spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenize_to_files(docs: DataFrame, tokenizer: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Write the documents' ids as token files and read them back; see write_token_files and read_token_files.

    The list of files, one a partition or FILE_IDS ids, is all that reaches the driver. An empty table gives no file and no row."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    made = sorted(write_token_files(docs, path, tokenizer, end_id, id_col, text_col).collect())
    files, base = [], 0
    for row in made:
        files.append((row.file, base))
        base += row.n_ids
    return read_token_files(spark, path, files)
