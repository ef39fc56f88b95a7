"""Conversation structure repair by secondary-sorted streaming.

A conversation is sound if its role initials read ``(s?(ua)+)?``: nothing, or an
optional system turn and then user and assistant turns in pairs.  Broken ones are
repaired by the cheapest edits: Keep a row (0), Rerole it to user or assistant (3),
Delete it (4; the only choice for blank and repeated rows), Insert an empty user or
assistant row anywhere (3).  A truncated row that is not deleted adds 3.  Of equally
cheap repairs the one whose edits' initials (D, I, K, R) are least in ASCII is taken.

Rows are repartitioned by conversation and sorted by turn (nulls first, then role and
text), and one task reads a conversation as a stream (``mapInPandas``), carrying four
states - nothing yet, after s, after u, after a - over the borders of Arrow
batches: each one's cost and the rank of its edits among the four.  Costs are
kept relative to the least; a state dearer by more than 4 than "after a" can never win
(whatever follows it, "after a" does for 4 more at most), so there are finitely many
steps and each is worked out once.  A row leaves four bytes of backpointers; beyond
``POINTER_BYTES`` they go to the shared folder in blocks, as the rows themselves do
beyond ``HELD_BYTES``: a conversation of any length takes bounded memory, but for its
audit (a byte an edit), and its rows are read once more to apply the edits.

Which rows repeat an earlier one is found before the stream by a window over
(conversation, role, text) in the same partitioning, so texts are shuffled once.  A
conversation is one task's work: its digest is a sequential hash of its text.

Edge cases: null roles and texts are one space (blank, a role of no kind); null
turns come first and are left out of ``gaps``; rows of a null conversation id are a
conversation; equal turns are ordered by role, then text; empty tables give no rows;
extra columns are ignored.  Gaps above the greatest long read as the greatest long.
Spilled files of a task that fails stay under the shared folder's run folder.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.llm.common import WORD_BREAKS, run_folder

HELD_BYTES = 32 << 20
POINTER_BYTES = 4 << 20
REPORTS_AT_ONCE = 4096
MAX_LONG = (1 << 63) - 1

NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
OTHER, SYSTEM, USER, ASSISTANT = range(4)  # kinds of role, by initial
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)  # faults
#: Where an inserted or reroled row leads, and its role.
GROWS = {NOTHING: (AFTER_U, "user"), AFTER_S: (AFTER_U, "user"), AFTER_U: (AFTER_A, "assistant"), AFTER_A: (AFTER_U, "user")}
KEEPS = {(NOTHING, SYSTEM): AFTER_S, (NOTHING, USER): AFTER_U, (AFTER_S, USER): AFTER_U, (AFTER_U, ASSISTANT): AFTER_A, (AFTER_A, USER): AFTER_U}
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
EDITS = [i * "I" + e for i in range(3) for e in "DKR"]
TAILS = {NOTHING: "", AFTER_S: "II", AFTER_U: "I", AFTER_A: ""}
INSERT, DELETE, REROLE, CUT = 3, 4, 3, 3
SLACK = 4

START = ((0, 0), None, None, None)  # of each state: relative cost, rank of its edits


@functools.lru_cache(maxsize=None)
def _moves(kind: int) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, edits) of a row of this kind (role + 4 * fault)."""
    role, fault = kind % 4, kind // 4
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for q in range(4):
        at, cost = q, 0
        for inserts in range(3):
            if inserts:
                at, cost = GROWS[at][0], cost + INSERT
            found = [(at, cost + DELETE, "D")]
            if fault not in (BLANK, DUPLICATE):
                cut = cost + CUT * (fault == TRUNCATED)
                found.append((GROWS[at][0], cut + REROLE, "R"))
                if (at, role) in KEEPS:
                    found.append((KEEPS[at, role], cut, "K"))
            for to, c, edit in found:
                best[q, to] = min(best.get((q, to), (1 << 30, "")), (c, "I" * inserts + edit))
    return [(q, to, c, edits) for (q, to), (c, edits) in best.items()]


@functools.lru_cache(maxsize=None)
def _step(states: tuple, kind: int) -> tuple[tuple, int, bytes]:
    """The states after a row, what the least cost rose by, and per state a byte: where
    it came from (2 bits) and the edits.  Edits up to a row end with that row's own,
    so none is the beginning of another: ranks decide between different states."""
    best: list = [None] * 4
    for q, to, c, edits in _moves(kind):
        if states[q]:
            cost, rank = states[q]
            found = (cost + c, rank, edits, q)
            if best[to] is None or found < best[to]:
                best[to] = found
    if best[AFTER_A]:
        best = [x if x and x[0] <= best[AFTER_A][0] + SLACK else None for x in best]
    live = [x for x in best if x]
    least = min(x[0] for x in live)
    ranks = {x[1:]: i for i, x in enumerate(sorted(live, key=lambda x: x[1:3]))}
    new = tuple(x and (x[0] - least, ranks[x[1:]]) for x in best)
    return new, least, bytes(x[3] | EDITS.index(x[2]) << 2 if x else 0 for x in best)


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class _Rows:
    """A conversation's rows (turn, no_turn, role, text) in order: in memory, or beyond
    HELD_BYTES in a file."""

    def __init__(self, folder: str):
        self.folder, self.held, self.size, self.sink = folder, [], 0, None

    def add(self, rows: list[tuple], size: int) -> None:
        self.held.append(rows)
        self.size += size
        if self.size > HELD_BYTES:
            self._spill()

    def _spill(self) -> None:
        columns = zip(*[row for rows in self.held for row in rows])
        if self.sink is None:
            fs, path = _open(self.folder)
            fs.create_dir(path, recursive=True)
            self.fs, self.path = fs, f"{path}/rows-{uuid.uuid4().hex}"
            self.file = fs.open_output_stream(self.path)
            self.sink = pa.ipc.new_stream(self.file, ROW_SCHEMA)
        self.sink.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ROW_SCHEMA)], schema=ROW_SCHEMA))
        self.held, self.size = [], 0

    def again(self) -> Iterator[list[tuple]]:
        if self.sink is not None:
            self.sink.close()
            self.file.close()
            with self.fs.open_input_stream(self.path) as f, pa.ipc.open_stream(f) as batches:
                for batch in batches:
                    yield list(zip(*[c.to_pylist() for c in batch.columns]))
            self.fs.delete_file(self.path)
        yield from self.held


class _Pointers:
    """Four bytes a row, read back from the last to the first."""

    def __init__(self, folder: str):
        self.folder, self.held, self.blocks = folder, bytearray(), []

    def spill(self) -> None:
        fs, path = _open(self.folder)
        fs.create_dir(path, recursive=True)
        path = f"{path}/pointers-{uuid.uuid4().hex}"
        with fs.open_output_stream(path) as f:
            f.write(bytes(self.held))
        self.blocks.append((fs, path))
        self.held = bytearray()

    def back(self) -> Iterator[bytes]:
        yield bytes(self.held)
        for fs, path in reversed(self.blocks):
            with fs.open_input_stream(path) as f:
                yield f.read()
            fs.delete_file(path)


ROW_SCHEMA = pa.schema([("turn", pa.int64()), ("no_turn", pa.bool_()), ("role", pa.string()), ("text", pa.string())])


class _Conversation:
    def __init__(self, conv: int, no_conv: bool, folder: str):
        self.conv, self.no_conv = conv, no_conv
        self.rows, self.pointers = _Rows(folder), _Pointers(folder)
        self.states, self.cost = START, 0
        self.faults, self.illegal, self.last_role = [0] * 4, 0, None
        self.first_turn = self.last_turn = None
        self.turns = 0

    def add(self, kinds: list[int], rows: list[tuple], size: int) -> None:
        states, pointers, last = self.states, self.pointers.held, self.last_role
        for kind in kinds:
            states, more, back = _step(states, kind)
            self.cost += more
            pointers += back
            self.faults[kind >> 2] += 1
            role = kind & 3
            self.illegal += last is not None and (last, role) not in LEGAL
            last = role
        self.states, self.last_role = states, last
        if len(pointers) > POINTER_BYTES:
            self.pointers.spill()
        for turn, no_turn, _, _ in rows:
            if not no_turn and turn != self.last_turn:
                self.first_turn = turn if self.first_turn is None else self.first_turn
                self.turns, self.last_turn = self.turns + 1, turn
        self.rows.add(rows, size)

    def decide(self) -> None:
        """The cheapest edits: ``edits`` per row, ``tail`` after the last one."""
        least = min((s[0] + INSERT * len(TAILS[q]), s[1], q) for q, s in enumerate(self.states) if s)
        self.cost += least[0]
        q, self.tail = least[2], TAILS[least[2]]
        out = bytearray()
        for block in self.pointers.back():
            for i in range(len(block) - 4, -1, -4):
                p = block[i + q]
                out.append(p >> 2)
                q = p & 3
        out.reverse()
        self.edits = bytes(out)

    def report(self, digest: str) -> tuple:
        gaps = 0 if self.first_turn is None else min(MAX_LONG, self.last_turn - self.first_turn + 1 - self.turns)
        _, blank, duplicate, truncated = self.faults
        audit = "".join([EDITS[e] for e in self.edits]) + self.tail
        return self.conv, self.no_conv, gaps, blank, duplicate, truncated, self.illegal, self.cost, audit, digest

    def repaired(self) -> Iterator[list[tuple]]:
        """The repaired rows (role, text, edit, turn, no_turn), some at a time, in order."""
        at, n = NOTHING, 0
        for rows in self.rows.again():
            out = []
            for edits, (turn, no_turn, role, text) in zip(self.edits[n: n + len(rows)], rows):
                edits = EDITS[edits]
                for _ in edits[:-1]:
                    at, new = GROWS[at]
                    out.append((new, "", "I", 0, True))
                if edits[-1] == "K":
                    out.append((role, text, "K", turn, no_turn))
                    at = KEEPS[at, INITIALS.get(role[:1], OTHER)]
                elif edits[-1] == "R":
                    at, new = GROWS[at]
                    out.append((new, text, "R", turn, no_turn))
            n += len(rows)
            yield out
        out = []
        for _ in self.tail:
            at, new = GROWS[at]
            out.append((new, "", "I", 0, True))
        yield out


INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}


def _conversations(frames: Iterator[pd.DataFrame], folder: str) -> Iterator[_Conversation]:
    """Every conversation of a sorted stream, once all its rows have passed."""
    now = None
    for frame in frames:
        if not len(frame):
            continue
        conv, none = frame["conv"].to_numpy(), frame["no_conv"].to_numpy()
        cuts = np.flatnonzero((conv[1:] != conv[:-1]) | (none[1:] != none[:-1])) + 1
        conv, none = conv.tolist(), none.tolist()
        present, kinds, sizes = frame["present"].tolist(), frame["kind"].tolist(), frame["size"].tolist()
        rows = list(zip(*[frame[name].tolist() for name in ROW_SCHEMA.names]))
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(frame)]):
            if now is None or (now.conv, now.no_conv) != (conv[lo], none[lo]):
                if now is not None:
                    yield now
                now = _Conversation(conv[lo], none[lo], folder)
            if all(present[lo:hi]):
                now.add(kinds[lo:hi], rows[lo:hi], sum(sizes[lo:hi]))
            else:
                at = [i for i in range(lo, hi) if present[i]]
                now.add([kinds[i] for i in at], [rows[i] for i in at], sum(sizes[i] for i in at))
    if now is not None:
        yield now


REPORT = ("conv long, no_conv boolean, gaps long, blank long, duplicate long, truncated long, illegal long, "
          "cost long, audit string, repaired_sha256 string")
TURN = "conv long, no_conv boolean, position long, role string, text string, edit string, turn long, no_turn boolean"


def _reports(folder: str):
    names = [x.split()[0] for x in REPORT.split(", ")]

    def run(frames):
        out = []
        for c in _conversations(frames, folder):
            c.decide()
            digest, first = hashlib.sha256(), True
            for rows in c.repaired():
                if rows:
                    digest.update((("" if first else "\n") + "\n".join([f"{r[0]}:{r[1]}" for r in rows])).encode())
                    first = False
            out.append(c.report(digest.hexdigest()))
            if len(out) == REPORTS_AT_ONCE:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)

    return run


def _turns(folder: str):
    names = [x.split()[0] for x in TURN.split(", ")]

    def run(frames):
        for c in _conversations(frames, folder):
            c.decide()
            n = 0
            for rows in c.repaired():
                yield pd.DataFrame([(c.conv, c.no_conv, n + i, *r) for i, r in enumerate(rows)], columns=names)
                n += len(rows)

    return run


def _trimmed(text: Column, cut=F.btrim) -> Column:
    return cut(text, F.lit(WORD_BREAKS))


def _sorted(convs: DataFrame, present: str | None) -> DataFrame:
    """Rows dealt by conversation, in the order of their turns, each with its kind."""
    d = convs.select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("t"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        (F.coalesce(F.col(present), F.lit(False)) if present else F.lit(True)).alias("present"))
    d = d.repartition("c")
    same = Window.partitionBy("c", F.xxhash64("role", "text"), "role", "text", "present").orderBy(F.col("t").asc_nulls_first())
    d = d.withColumn("nth", F.row_number().over(same))
    first = F.left("role", F.lit(1))
    role = F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(OTHER)
    fault = (F.when(F.length(_trimmed(F.col("text"))) == 0, BLANK).when(F.col("nth") > 1, DUPLICATE)
             .when(~F.right(_trimmed(F.col("text"), F.rtrim), F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(FINE))
    return (d.sortWithinPartitions(F.col("c").asc_nulls_first(), F.col("t").asc_nulls_first(), "role", "text", "nth")
            .select(F.coalesce("c", F.lit(0)).alias("conv"), F.col("c").isNull().alias("no_conv"),
                    F.coalesce("t", F.lit(0)).alias("turn"), F.col("t").isNull().alias("no_turn"), "role", "text", "present",
                    (role + 4 * fault).alias("kind"), (F.octet_length("role") + F.octet_length("text") + 16).alias("size")))


def _conv_id() -> Column:
    return F.when(~F.col("no_conv"), F.col("conv")).alias("conv_id")


def repair_reports(convs: DataFrame, present: str | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps in its turns, blank, duplicate and truncated
    rows (each row's first fault), illegal neighbours, cost, audit (the edits'
    initials) and repaired_sha256 (of the repaired ``role:text`` lines).

    ``convs``: conv_id, turn, role, text.  ``present`` names a boolean column: rows
    where it is not true only say that their conversation exists."""
    folder = run_folder(convs.sparkSession, "conversation-repair")
    return (_sorted(convs, present).mapInPandas(_reports(folder), REPORT)
            .select(_conv_id(), *[x.split()[0] for x in REPORT.split(", ")[2:]]))


def repaired_turns(convs: DataFrame, present: str | None = None) -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), role, text, edit (K, R or I)
    and the row's own turn (null if inserted)."""
    folder = run_folder(convs.sparkSession, "conversation-repair")
    return (_sorted(convs, present).mapInPandas(_turns(folder), TURN)
            .select(_conv_id(), "position", "role", "text", "edit", F.when(~F.col("no_turn"), F.col("turn")).alias("turn")))


def damaged(convs: DataFrame) -> DataFrame:
    """The faults that the repair is tried on, by ``crc32(conv_id:turn) % 20``: rows are
    dropped (0: kept with ``present`` false), emptied (1), lose their ``[.!?]`` (2), come
    twice (3) or turn to the user (4).  Nulls are one space."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    d = convs.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
                     (F.crc32(key.cast("binary")) % 20).alias("damage"))
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return d.select("conv_id", "turn", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                    (F.col("damage") != 0).alias("present"),
                    F.explode(F.when(F.col("damage") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")
