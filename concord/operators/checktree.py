"""Where two tables differ: a checksum tree over prefixes of the key hash (CHK-4).

One checksum says that two tables differ; it does not say where, and a keyed
comparison of everything shuffles everything.  Here the rows of both sides fall
into ``2 ** BITS`` nodes by the first bits of their key's hash, and every node has
a checksum: the difference of both sides' row counts and of the sums of two
64-bit row hashes (in pieces that cannot overflow).  A scan and a map-side
aggregate give it; no more rows than nodes leave a task.  Nodes whose checksum is
zero hold the same rows (but for a collision of 128 bits in the sums).  The
children of the others are compared in the next scan, until a node holds about
``LEAF_ROWS`` rows, until another level no longer halves the rows left, or
until more than ``MAX_NODES`` nodes differ.

Only the rows of differing leaves are shuffled and compared row by row, with the
semantics of ``diff.keyed_diff``: the result is the same, the shuffle grows with
the differences, and the price is a scan a level.  The differing nodes (at most
``MAX_NODES`` numbers) go through the driver and are broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import diff
from .result import error_result

BITS = 10
MAX_LEVELS = 5
LEAF_ROWS = 64
MAX_NODES = 1 << 16
PIECES = ((0, 24), (24, 20), (44, 20))  # first bit and width of the summed pieces of a hash


@dataclass
class Leaves:
    """The differing nodes of the last level looked at."""

    level: int
    nodes: list[int]
    history: list[tuple[int, int, int]] = field(default_factory=list)  # nodes with rows, differing ones, their rows


def _node(key_hash: Column, level: int) -> Column:
    return F.shiftrightunsigned(key_hash, 64 - BITS * level)


def _prepared(source: DataFrame, target: DataFrame, key: str, cols: list[str], opts: dict) -> DataFrame:
    """Both sides stacked: the key's hash and the pieces of the row's hashes, the target's negated."""
    inner = {c: f"__v{i}" for i, c in enumerate(cols)}
    plan = diff._plan_columns(source, target, [key, *cols])
    both = diff._side(source, key, inner, plan, 0, opts).unionByName(diff._side(target, key, inner, plan, 1, opts))
    values = [x for c in (diff.KEY, *inner.values()) for x in (F.col(c).isNull(), F.col(c))]  # a hash skips NULLs
    sign = F.when(F.col("__src"), F.lit(1)).otherwise(F.lit(-1)).cast("bigint")
    both = both.select(F.xxhash64(diff.KEY).alias("h"), F.xxhash64(*values).alias("r0"), F.xxhash64(F.lit("second"), *values).alias("r1"), sign.alias("one"))
    pieces = [(F.shiftrightunsigned(r, at).bitwiseAND(F.lit((1 << width) - 1)) * F.col("one")).alias(f"{r}_{at}")
              for r in ("r0", "r1") for at, width in PIECES]
    return both.select("h", "one", *pieces)


def _chosen(rows: DataFrame, key_hash: Column, level: int, nodes: list[int]) -> DataFrame:
    """The rows of the given nodes (at most MAX_NODES: broadcast)."""
    wanted = rows.sparkSession.createDataFrame([(n,) for n in nodes], "__node bigint")
    return rows.join(F.broadcast(wanted), _node(key_hash, level) == F.col("__node"), "left_semi")


def differing_leaves(source: DataFrame, target: DataFrame, key: str = diff.KEY, columns: list[str] | None = None, **opts) -> Leaves:
    """Descends from the root; one small job (a scan of both sides) a level."""
    cols = diff._resolve(source, target, key, columns)
    ensure_checkpoint_dir(source.sparkSession)
    rows = _prepared(source, target, key, cols, opts)
    sums = [c for c in rows.columns if c != "h"]
    out = Leaves(0, [0])
    for level in range(1, MAX_LEVELS + 1):
        part = _chosen(rows, F.col("h"), level - 1, out.nodes) if level > 1 else rows
        each = part.groupBy(_node(F.col("h"), level).alias("node")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in sums])
        differs = F.greatest(*[F.abs(c) for c in sums]) > 0
        each = each.select("node", "n", differs.alias("differs")).checkpoint()  # a row a node: read twice
        total = each.agg(F.count(F.lit(1)).alias("nodes"), F.count_if("differs").alias("differing"),
                         F.coalesce(F.sum(F.when(F.col("differs"), F.col("n"))), F.lit(0)).alias("rows"),
                         F.coalesce(F.sum("n"), F.lit(0)).alias("all_rows")).first()
        out.history.append((total["nodes"], total["differing"], total["rows"]))
        if total["differing"] > MAX_NODES:
            break
        out.level, out.nodes = level, [r["node"] for r in each.where("differs").select("node").collect()]
        if total["rows"] <= LEAF_ROWS * total["differing"] or 2 * total["rows"] > total["all_rows"]:
            break
    return out


def tree_diff(source: DataFrame, target: DataFrame, key: str = diff.KEY, columns: list[str] | None = None, *, strict: bool = False,
              strip_dot_zero_strings: bool = False) -> DataFrame:
    """The rows of ``diff.keyed_diff``, from the rows of differing leaves only."""
    opts = dict(strict=strict, strip_dot_zero_strings=strip_dot_zero_strings)
    cols = diff._resolve(source, target, key, columns)
    leaves = differing_leaves(source, target, key, cols, **opts)
    plan = diff._plan_columns(source, target, [key])
    sides = []
    for which, df in enumerate((source, target)):
        dt, shared = plan[key][which], plan[key][2]
        value = F.col(f"`{key}`").cast(shared) if shared is not None else diff.canon(F.col(f"`{key}`"), dt, **opts)
        if not leaves.level:
            sides.append(df)
        elif not leaves.nodes:
            sides.append(df.where(F.lit(False)))
        else:
            sides.append(_chosen(df, F.xxhash64(value), leaves.level, leaves.nodes))
    return diff.keyed_diff(*sides, key, cols, **opts)


def localised(source: DataFrame, target: DataFrame, key: str = diff.KEY, columns: list[str] | None = None, **opts) -> DataFrame:
    """What the descent saw, one row a level: ``level, nodes, differing_nodes, rows_left``."""
    try:
        leaves = differing_leaves(source, target, key, columns, **opts)
    except diff.DiffError as e:
        return error_result(source.sparkSession, "", "", str(e))
    return source.sparkSession.createDataFrame([(i + 1, *h) for i, h in enumerate(leaves.history)],
                                               "level int, nodes bigint, differing_nodes bigint, rows_left bigint")
