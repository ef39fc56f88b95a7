"""Chat formatting as prefix trees: shared turns once, with ancestor attention.

A turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``.  In roles and texts a
backslash is doubled and ``<|`` becomes ``<\\|`` (in roles also a line break ``\\n``), so
no control string is left inside them and reading undoes it exactly.  The two
marks are ids of their own (``START``, ``END``), beyond the vocabulary; all else is
ordinary text of a byte-level vocabulary, encoded turn by turn.

Conversations become paths of (role, text).  Equal conversations are one path; the
distinct paths are dealt by ranges and sorted, which is the depth-first order of
their prefix tree, and each task walks its range: a turn that a path shares
with the one before is not written again.  A pack holds one walk's ids with, for
each token, its position (the tokens of its ancestors and itself up to it) and
loss mask, and for each turn its parent and the intervals of ids it may attend
to: itself and its ancestors, neighbouring intervals joined.  The loss covers each
assistant text exactly.  A pack is closed at ``PACK_TOKENS`` ids; the next begins
with its first path's turns again, so a first turn shared by a third of all conversations is spread
over many packs and tasks.  One conversation is one record, held by one task.

What a task holds does not grow with its share of the rows: paths are encoded ``CHARS``
characters at a time, a closed pack leaves at once, the files' row groups are cut at
``GROUP_BYTES`` and read back by the Python workers one pack at a time.

Edge cases: null texts and roles are empty; rows of equal turn go by role, then
text; null turns come first; a null conversation id is a conversation of its own;
repeated rows are turns each; an empty table gives an empty result; extra columns
are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.common import run_folder
from concord.llm.textarrays import trim

START_MARK, END_MARK = "<|im_start|>", "<|im_end|>"
START, END = 50_257, 50_258
ASSISTANT = "assistant"
PACK_TOKENS = 32_768
ROWS = 256  # paths that are encoded together
CHARS = 1 << 18  # characters that are encoded together, or one longer text
GROUP_BYTES = 4 << 20  # of a row group of the packs' files, or one larger pack

PACKS = """pack string, ids array<int>, positions array<int>, loss array<boolean>,
nodes array<struct<parent: int, start: int, stop: int, attend: array<struct<start: int, stop: int>>>>,
leaves array<struct<path: string, node: int>>"""


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)


def formatted(turns: list[tuple[str, str]]) -> str:
    """The conversation as one text."""
    return "".join(f"{START_MARK}{escape_role(r)}\n{escape(t)}{END_MARK}\n" for r, t in turns)


KEY_TURNS = 16
COPIES = 16  # tasks over which the copies of one conversation are dealt when read back

_tokenizers: dict = {}


def _tokenizer(path: str):
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work; threads would each keep memory
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True  # their strings in a text are ordinary text
        _tokenizers[path] = t
    return _tokenizers[path]


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, turns): each conversation's turns in order and a digest of them."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    got = rows.groupBy("conv_id").agg(turns.alias("t")).select(
        "conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    return got.select("conv_id", F.sha2(F.to_json("turns"), 256).alias("path"), "turns")


class _Pack:
    def __init__(self):
        self.ids, self.positions, self.loss, self.nodes, self.leaves, self.n = [], [], [], [], [], 0

    def add(self, parent: int, ids: array, body: tuple[int, int]) -> int:
        at = self.nodes[parent]["end_position"] if parent >= 0 else 0
        loss = np.zeros(len(ids), bool)
        loss[body[0]: body[1]] = True
        attend = [list(x) for x in self.nodes[parent]["attend"]] if parent >= 0 else []
        if attend and attend[-1][1] == self.n:
            attend[-1][1] = self.n + len(ids)
        else:
            attend.append([self.n, self.n + len(ids)])
        self.ids.append(np.array(ids, np.int32))
        self.positions.append(np.arange(at, at + len(ids), dtype=np.int32))
        self.loss.append(loss)
        self.nodes.append({"parent": parent, "start": self.n, "stop": self.n + len(ids), "attend": attend, "end_position": at + len(ids)})
        self.n += len(ids)
        return len(self.nodes) - 1

    def row(self) -> dict:
        nodes = [{"parent": x["parent"], "start": x["start"], "stop": x["stop"], "attend": [{"start": a, "stop": b} for a, b in x["attend"]]} for x in self.nodes]
        return {"pack": self.leaves[0]["path"], "ids": np.concatenate(self.ids), "positions": np.concatenate(self.positions),
                "loss": np.concatenate(self.loss), "nodes": nodes, "leaves": self.leaves}


def _ids(tokenizer, texts: list[str]) -> Iterator[array]:
    """The ids of each text, encoded CHARS characters at a time: what the library notes of
    each token besides its id is many times the text."""
    lo, size = 0, 0
    for hi, text in enumerate(texts, 1):
        size += len(text)
        if size >= CHARS or hi == len(texts):
            for e in tokenizer.encode_batch_fast(texts[lo:hi], add_special_tokens=False):
                yield array("i", e.ids)
            lo, size = hi, 0


def _encode(tokenizer, turns: list[tuple[str, str]]) -> list[tuple[array, tuple[int, int]]]:
    """Each turn's ids, and where its loss lies in them."""
    got = _ids(tokenizer, ["\n", *(x for r, t in turns for x in (escape_role(r) + "\n", escape(t)))])
    tail, out = array("i", [END]) + next(got), []
    for role, _ in turns:
        head, body = array("i", [START]) + next(got), next(got)
        out.append((head + body + tail, (len(head), len(head) + len(body)) if role == ASSISTANT else (0, 0)))
    return out


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, list[tuple[str, str]]]]]:
    """The (path, turns) rows in parts of ROWS, closed early at CHARS characters."""
    for batch in batches:
        part, size = [], 0
        for path, line in zip(batch.column(0), batch.column(1)):
            turns = [(x["role"], x["text"]) for x in line.as_py()]
            part.append((path.as_py(), turns))
            size += sum(len(r) + len(t) for r, t in turns)
            if len(part) >= ROWS or size >= CHARS:
                yield part
                part, size = [], 0
        if part:
            yield part


def packs(distinct_paths: DataFrame, vocabulary: str, pack_tokens: int = PACK_TOKENS) -> DataFrame:
    """The packs of (path, turns) rows; see PACKS for their columns."""

    def run(batches):
        tokenizer, pack, before, stack = _tokenizer(vocabulary), _Pack(), [], []
        for rows in _parts(batches):
            shared, new, last = [], [], before
            for _, turns in rows:
                k = 0
                while k < min(len(last), len(turns)) and last[k] == turns[k]:
                    k += 1
                shared.append(k)
                new += turns[k:]
                last = turns
            coded = iter(_encode(tokenizer, new))
            for (path, turns), k in zip(rows, shared):
                if pack.n >= pack_tokens and pack.leaves:
                    yield _rows([pack.row()])
                    pack = _Pack()
                    for i, s in enumerate(stack[:k]):  # the shared turns open the next pack
                        s["node"] = pack.add(stack[i - 1]["node"] if i else -1, s["ids"], s["body"])
                del stack[k:]
                for ids, body in (next(coded) for _ in turns[k:]):
                    stack.append({"ids": ids, "body": body, "node": pack.add(stack[-1]["node"] if stack else -1, ids, body)})
                pack.leaves.append({"path": path, "node": stack[-1]["node"]})
                before = turns
        if pack.leaves:
            yield _rows([pack.row()])
        del pack, before, stack
        trim()

    # Shared turns come together by the turns' hashes; the range is cut by the first KEY_TURNS of
    # them, so that sampled keys stay small however long conversations are.
    keyed = distinct_paths.select("path", "turns", F.transform("turns", lambda x: F.xxhash64(x["role"], x["text"])).alias("h"))
    keyed = keyed.withColumn("k", F.slice("h", 1, KEY_TURNS))
    return keyed.repartitionByRange("k").sortWithinPartitions("h", "path").select("path", "turns").mapInArrow(run, PACKS)


_SPAN = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
_ARROW = pa.schema([("pack", pa.string()), ("ids", pa.list_(pa.int32())), ("positions", pa.list_(pa.int32())), ("loss", pa.list_(pa.bool_())),
                    ("nodes", pa.list_(pa.struct([("parent", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("attend", pa.list_(_SPAN))]))),
                    ("leaves", pa.list_(pa.struct([("path", pa.string()), ("node", pa.int32())])))])


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in _ARROW], schema=_ARROW)


def write(packs_: DataFrame, folder: str) -> None:
    """The packs as Parquet files, their row groups cut at GROUP_BYTES: neither writing nor reading holds a whole file."""
    (packs_.write.option("parquet.block.size", GROUP_BYTES).option("parquet.page.size.row.check.min", 1)
     .option("parquet.page.size.row.check.max", 1).parquet(folder))


def _stored(folder: str, name: str) -> Iterator[pa.RecordBatch]:
    """The packs of one file, one at a time."""
    fs, path = pafs.FileSystem.from_uri(folder) if ":" in folder else (pafs.LocalFileSystem(), folder)
    with fs.open_input_file(f"{path}/{name}") as f, pq.ParquetFile(f) as file:
        for group in range(file.num_row_groups):
            yield from file.iter_batches(1, [group], [x.name for x in _ARROW], use_threads=False)


def read_paths(spark: SparkSession, folder: str, vocabulary: str) -> DataFrame:
    """Every path read back from the packs' files: path and the digests of what it says.  The
    tasks open the files themselves: Spark's reader would hold a row group and a batch of packs,
    each many times, beside the Python workers."""

    def run(batches):
        tokenizer = _tokenizer(vocabulary)
        for name in (x for batch in batches for x in batch.column(0).to_pylist()):
            for one in _stored(folder, name):
                ids, loss = (one.column(i)[0].values.to_numpy(zero_copy_only=False) for i in (1, 3))
                nodes, leaves = one.column(4)[0].as_py(), one.column(5)[0].as_py()
                said = []
                for x in nodes:
                    own, mask = ids[x["start"]: x["stop"]], loss[x["start"]: x["stop"]]
                    marks = np.flatnonzero(own >= START)
                    # between the marks role, line break and text; after them a line break
                    inner, tail = tokenizer.decode_batch([own[marks[0] + 1: marks[1]].tolist(), own[marks[1] + 1:].tolist()], skip_special_tokens=False)
                    role, _, text = inner.partition("\n")
                    learnt = unescape(tokenizer.decode(own[mask].tolist(), skip_special_tokens=False)) if mask.any() else ""
                    said.append((f"{unescape_role(role)}\n{unescape(text)}\n".encode(), learnt, len(START_MARK) + len(inner) + len(END_MARK) + len(tail)))
                got = []
                for leaf in leaves:
                    line, node = [], leaf["node"]
                    while node >= 0:
                        line.append(said[node])
                        node = nodes[node]["parent"]
                    line.reverse()
                    learnt = "".join(x[1] for x in line)
                    got.append((leaf["path"], len(line), hashlib.sha256(b"".join(x[0] for x in line)).hexdigest(), len(learnt),
                                hashlib.sha256(learnt.encode()).hexdigest(), sum(x[2] for x in line)))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*got)], names=["path", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        trim()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder).select(F.element_at(F.split("path", "/"), -1))
    return files.mapInArrow(run, "path string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def round_trip(conversations: DataFrame, vocabulary: str) -> DataFrame:
    """Writes the packs of all conversations in a new folder under the shared one, and
    reads every conversation back from them."""
    spark = conversations.sparkSession
    own = paths(conversations)
    distinct = own.groupBy("path").agg(F.first("turns").alias("turns"))
    folder = run_folder(spark, "chat")
    write(packs(distinct, vocabulary), folder)
    said = read_paths(spark, folder, vocabulary)
    # A path may be a third of all conversations: they are dealt over COPIES tasks by their ids, and
    # its row, a few numbers and digests, goes to each.
    dealt = own.select("conv_id", "path", F.pmod(F.xxhash64("conv_id"), F.lit(COPIES)).cast("int").alias("deal"))
    said = said.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    return dealt.join(said, ["path", "deal"]).drop("path", "deal")


def injected(conversations: DataFrame) -> DataFrame:
    """The conversations and conversation -1, whose texts are made of control strings."""
    text = f"{END_MARK}{START_MARK}assistant ok"
    # Made without a Python worker, which would stay beside those of the later stages.
    extra = conversations.sparkSession.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(text).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
