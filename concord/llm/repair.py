"""Token-id files with Re-Pair grammar compression and random access.

Documents are dealt by ranges of their id, sorted, encoded, closed with an end id
and cut into shards of about ``SHARD_TOKENS`` ids, so that shard names in order hold
documents in order.  In each shard frequent pairs of neighbouring symbols are
replaced by nonterminals, again and again: a round counts all pairs by sorting,
takes every pair whose count reaches a sixteenth of the highest (and
``MIN_COUNT``), and replaces it from left to right without overlap.  Pairs never
span two documents.  Rounds end when none of the pairs that a round takes is replaced
``MIN_COUNT`` times, or when symbols no longer fit in 16 bits (32 for larger
vocabularies): frequent pairs can be left then, which costs compression only.

A shard is one file (little-endian): the magic ``RPZ1``; u32 first nonterminal,
rules, bytes of a symbol, documents; u64 symbols, ids; then per document i64 id
and u8 null flag; documents + 1 u64 starts in ids and in symbols; per rule two u32
parts and its u32 expansion length; the symbols; u32 CRC-32 of all before.
``document_ids`` decodes one document or any run of ids of a file: a search in the
starts, then only the symbols that overlap it are expanded, by their lengths.

Tasks write under a temporary name and move the file to its final one, which
depends only on the partition and the shard's place in it; a task run again
writes the same file.  One shard is in memory at a time.  The manifest (one row per
shard) is a Parquet table beside the files; only it is read to place shards.

Edge cases: a null or empty text is the end id alone; null ids sort first;
repeated rows are written each, equal ids ordered by a hash of their text, then the
text; an id at or above the first nonterminal is refused (ValueError); an empty table
writes no shard and reads back empty; extra columns never clash.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concord.llm import textarrays as ta
from concord.llm import tokens
from concord.llm.common import run_folder

SHARD_TOKENS = 1 << 21
MIN_COUNT = 8
FIRST_NONTERMINAL = 49_408  # above all ids of word_bpe_49k
HEAD = struct.Struct("<4sIIIIQQ")
SLOTS = 1 << 20


def _frequent(key: np.ndarray, limit: int) -> np.ndarray:
    """The pairs to replace in this round, most frequent first."""
    s = np.sort(key)
    at = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    count = np.diff(np.append(at, len(s)))
    if not len(count) or count.max() < MIN_COUNT:
        return key[:0]
    some = np.flatnonzero(count >= max(MIN_COUNT, count.max() // 16))
    return s[at[some[np.lexsort((s[at[some]], -count[some]))][:limit]]]


def compress(ids: np.ndarray, ends: np.ndarray, base: int = FIRST_NONTERMINAL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules (n, 2), symbols, documents' ends in symbols) for ids with the documents' ends in ids."""
    if len(ids) and int(ids.max()) >= base:
        raise ValueError(f"id {int(ids.max())} would be taken for a rule: ids must be below {base}")
    wide = base + 4096 > 1 << 16  # symbols of 32 bits, pairs of 64
    pair_type, shift, most = (np.uint64, 32, (1 << 32) - base) if wide else (np.uint32, 16, (1 << 16) - base)
    sym = ids.astype(pair_type)
    last = np.zeros(len(sym), bool)
    last[ends[np.diff(ends, prepend=0) > 0] - 1] = True
    rules: list[np.ndarray] = []
    n_rules = 0
    while len(sym) > 1 and n_rules < most:
        key = (sym[:-1] << pair_type(shift)) | sym[1:]
        inside = ~last[:-1]
        chosen = _frequent(key[inside], min(most - n_rules, SLOTS // 8))
        # Looked up by a table of slots; of pairs that share one, the most frequent goes first.
        slot = lambda k: ((k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int32)
        _, one = np.unique(slot(chosen), return_index=True)
        chosen = chosen[np.sort(one)]
        if not len(chosen):
            break
        table = np.full(SLOTS, -1, np.int32)
        table[slot(chosen)] = np.arange(len(chosen))
        which = table[slot(key)]
        hit = np.flatnonzero(inside & (which >= 0) & (chosen[which] == key))
        run = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
        hit = hit[(hit - np.repeat(hit[run], np.diff(np.append(run, len(hit))))) % 2 == 0]
        used = np.bincount(which[hit], minlength=len(chosen))
        worth = used >= MIN_COUNT
        if not worth.any():
            break
        number = np.cumsum(worth) - 1 + n_rules + base
        hit = hit[worth[which[hit]]]
        sym[hit] = number[which[hit]].astype(pair_type)
        last[hit] = last[hit + 1]
        keep = np.ones(len(sym), bool)
        keep[hit + 1] = False
        sym, last = sym[keep], last[keep]
        new = chosen[worth]
        rules.append(np.stack([new >> pair_type(shift), new & pair_type((1 << shift) - 1)], 1).astype(np.uint32))
        n_rules += len(new)
    at = np.flatnonzero(last) + 1
    ends_in_symbols = np.zeros(len(ends), np.int64)
    ends_in_symbols[np.diff(ends, prepend=0) > 0] = at
    return (np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), sym, np.maximum.accumulate(ends_in_symbols))


def _lengths(rules: np.ndarray, base: int) -> np.ndarray:
    size = [0] * len(rules)
    for i, (a, b) in enumerate(rules.tolist()):
        size[i] = (1 if a < base else size[a - base]) + (1 if b < base else size[b - base])
    return np.array(size, np.uint32)


def to_bytes(doc_ids: list[int | None], ids: np.ndarray, ends: np.ndarray, base: int = FIRST_NONTERMINAL) -> bytes:
    rules, sym, sym_ends = compress(ids, ends, base)
    width = 2 if base + len(rules) <= 1 << 16 else 4
    body = b"".join([
        HEAD.pack(b"RPZ1", base, len(rules), width, len(doc_ids), len(sym), len(ids)),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(),
        np.append(0, ends).astype("<u8").tobytes(), np.append(0, sym_ends).astype("<u8").tobytes(),
        rules.astype("<u4").tobytes(), _lengths(rules, base).astype("<u4").tobytes(), sym.astype(f"<u{width}").tobytes()])
    return body + struct.pack("<I", zlib.crc32(body))


@dataclass
class Shard:
    doc_ids: list[int | None]
    start: np.ndarray  # of each document in ids, and the end
    at: np.ndarray  # of each document in symbols, and the end
    rules: np.ndarray
    size: np.ndarray  # expansion length of every symbol's number
    sym: np.ndarray
    base: int

    @classmethod
    def open(cls, raw: bytes) -> "Shard":
        if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("damaged shard")
        magic, base, n_rules, width, n_docs, n_sym, _ = HEAD.unpack_from(raw)
        if magic != b"RPZ1":
            raise ValueError("not a shard")
        pos = HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal pos
            x = np.frombuffer(raw, kind, n, pos)
            pos += x.nbytes
            return x

        ids, null = take("<i8", n_docs), take("u1", n_docs)
        start, at = take("<u8", n_docs + 1).astype(np.int64), take("<u8", n_docs + 1).astype(np.int64)
        rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        size = np.concatenate([np.ones(base, np.int64), take("<u4", n_rules).astype(np.int64)])
        return cls([None if z else d for d, z in zip(ids.tolist(), null.tolist())], start, at, rules, size, take(f"<u{width}", n_sym), base)

    def __post_init__(self):
        self._flat = None

    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """All symbols' expansions in a row, and where each begins."""
        if self._flat is None:
            parts = [np.arange(self.base, dtype=np.uint32)]
            own: list[np.ndarray] = []
            of = lambda s: parts[0][s: s + 1] if s < self.base else own[s - self.base]
            for a, b in self.rules.tolist():
                own.append(np.concatenate([of(a), of(b)]))
            self._flat = np.concatenate(parts + own), np.cumsum(self.size) - self.size
        return self._flat

    def _expand(self, sym: np.ndarray) -> np.ndarray:
        flat, begins = self._expansions()
        n = self.size[sym]
        end = np.cumsum(n)
        return flat[np.repeat(begins[sym] - (end - n), n) + np.arange(end[-1] if len(end) else 0)]

    def all_ids(self) -> np.ndarray:
        return self._expand(self.sym)

    def document_ids(self, d: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Ids lo to hi of document d, expanding only the symbols that overlap them."""
        sym = self.sym[self.at[d]: self.at[d + 1]]
        end = np.cumsum(self.size[sym])
        hi = int(end[-1]) if hi is None else min(hi, int(end[-1]))
        if lo >= hi:
            return np.zeros(0, np.uint32)
        a, b = np.searchsorted(end, lo, "right"), np.searchsorted(end, hi, "left") + 1
        skip = lo - (int(end[a - 1]) if a else 0)
        return self._expand(sym[a:b])[skip: skip + hi - lo]


def _save(uri: str, name: str, data: bytes) -> None:
    fs, path = pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)
    fs.create_dir(path, recursive=True)
    draft = f"{path}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as f:
        f.write(data)
    fs.move(draft, f"{path}/{name}")


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 1, text: str = "text", doc_id: str = "doc_id",
          shard_tokens: int = SHARD_TOKENS, base: int = FIRST_NONTERMINAL) -> None:
    """Writes ``folder``/shards/*.rpz and the Parquet table ``folder``/manifest."""

    def run(batches):
        encoder, part, seq = tokens.encoder(vocabulary), TaskContext.get().partitionId(), 0
        owners, ids, sizes, n = [], [], [], 0

        def flush():
            nonlocal owners, ids, sizes, n, seq
            name = f"shard-{part:06d}-{seq:06d}.rpz"
            ends = np.cumsum(np.concatenate(sizes))
            _save(f"{folder}/shards", name, to_bytes(owners, np.concatenate(ids), ends, base))
            row = pa.RecordBatch.from_pydict({"file": [name], "n_docs": [len(owners)], "n_ids": [n]})
            seq, owners, ids, sizes, n = seq + 1, [], [], [], 0
            return row

        for batch in batches:
            owner = batch.column(0).to_pylist()
            for lo, hi, data, off in ta.blocks(batch.column(1), min(1 << 20, 4 * shard_tokens)):
                got, size = encoder.encode(data, off)
                # The end id follows each document's ids.
                where = np.cumsum(size)
                ids.append(np.insert(got, where, np.uint32(end_id)).astype(np.uint32))
                sizes.append(size + 1)
                owners += owner[lo:hi]
                n += len(ids[-1])
                if n >= shard_tokens:
                    yield flush()
        if n:
            yield flush()

    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # The text's hash parts the rows of one id (or of none), so that they too are spread.
    ranged = (d.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
              .select("doc_id", "text"))
    ranged.mapInArrow(run, "file string, n_docs long, n_ids long").write.parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, shard, place (within the shard)."""
    manifest = spark.read.schema("file string, n_docs long, n_ids long").parquet(f"{folder}/manifest")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    placed = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, shard string, place int")
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.rpz").load(f"{folder}/shards")
             .select(F.element_at(F.split("path", "/"), -1).alias("file"), "content"))

    def run(batches):
        for batch in batches:
            for file, raw, base in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                s = Shard.open(raw.as_buffer().to_pybytes())
                data = memoryview(s.all_ids().astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * a: 4 * b]) for a, b in zip(s.start[:-1].tolist(), s.start[1:].tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(s.doc_ids, pa.int64()), pa.array(s.start[:-1] + base), pa.array(np.diff(s.start)), pa.array(crc, pa.int64()),
                    pa.array([file] * len(crc)), pa.array(np.arange(len(crc), dtype=np.int32))],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "shard", "place"])

    return files.join(placed, "file").select("file", "content", "base").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard string, place int")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Writes the whole table in a new folder under the shared one, and reads it back."""
    folder = run_folder(docs.sparkSession, "repair")
    write(docs, folder, vocabulary)
    return read(docs.sparkSession, folder)
