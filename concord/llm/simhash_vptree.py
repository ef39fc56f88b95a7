"""SimHash near-duplicates: fingerprints joined exactly through vantage-point trees.

A text's words (ASCII capitals folded) give 3-word shingles, repeats included;
bit j of its 64-bit fingerprint is set if it is set in over half of the shingles'
XXH64 values (seed 42).  Two fingerprints link at ``MAX_BITS`` or fewer differing
bits, and a document's component is everything reachable over links.

Links are searched among the distinct fingerprints.  They are cut into ``VIEWS``
halves: of two that differ in at most 3 bits, one half differs in at most 1.  On
each half a vantage-point tree is built from a bounded sample (``SAMPLE``
fingerprints; only the tree, some thousand nodes, is broadcast): a node holds
a vantage point and a radius, a fingerprint lives on the near or far side by
its Hamming distance, and by the triangle inequality it must also be looked up
on the other side only if its distance lies within 1 of the radius.  Each
fingerprint is thus sent to its home shard and, as a query, to the shards whose
boundary it overlaps.  Halves keep these copies few: on 64 random bits a radius
of 3 would send over half of all points down both sides of each node, on 32
bits a radius of 1 sends about a quarter.  A shard goes on splitting in the
same way in numpy, compares at leaves in blocks on all 64 bits, and returns a
spanning forest of its links, never all pairs.  Whatever the sample missed only
makes shards uneven; the result is exact.

Fingerprints that share a half cannot be parted by any vantage point on it.  Of two
that link, one 16-bit part of the other half differs in at most 1 bit: a dense
shard is dealt on by these parts (a fingerprint lives in two buckets and asks in
those within 1 bit), and a dense leaf inside a shard is searched by the same parts.

The forest's components are found by star contraction (``components``), and a
grouped minimum per component gives ``component_id``.  Copies meet as one
distinct fingerprint before the search, so a large group of copies costs one
row there; the joins back are on narrow columns.

Edge cases: a null, empty or blank text has fingerprint zero, linked like any
other; fewer than three words: one shingle of them all.  A null id belongs to its
component and never names it (unless all its ids are null).  Repeated rows each
give a row.  An empty table gives an empty result; extra columns never clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.llm import textarrays as ta
from concord.llm.common import bounded_broadcast, shared_dir
from concord.llm.components import components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
VIEWS = 2
SAMPLE = 200_000  # fingerprints that shape the trees, or one in SAMPLED if that is more, up to MOST_SAMPLED
SAMPLED = 500
MOST_SAMPLED = 2_000_000
SHARD = 4000  # fingerprints that a shard should hold
LEAF = 256  # compared with each other without further splitting
MIN_SAMPLED = 16  # sampled fingerprints of a shard, at least
DENSE = 2048  # more than so many that nothing parts are sought by parts
PAIRS = 1 << 20  # compared at once there
BLOCK = 1 << 16  # shingles whose bits are counted at once


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    flat = b" ".join(text.lower().split())
    if not flat:
        return 0
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(flat)]
    k = min(shingle, len(starts))
    digest, ones, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(starts) - k + 1
    for lo in range(0, n, BLOCK):
        part = zip(starts[lo: min(lo + BLOCK, n)], ends[lo + k - 1:])
        h = np.array([digest(flat[s:e], SEED) for s, e in part], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


def _fingerprints(texts: pa.Array) -> list[pa.Array]:
    data, off = ta.buffers(texts)
    out = [fingerprint(data[off[i]: off[i + 1]].tobytes()) for i in range(len(off) - 1)]
    return [pa.array(np.array(out, np.uint64).view(np.int64))]


def with_fingerprints(docs: DataFrame, name: str, text: str = "text") -> DataFrame:
    """``docs`` with a long column ``name``: the 64 bits of each text's fingerprint."""
    return ta.append(docs, text, [T.StructField(name, T.LongType())], lambda: _fingerprints)


@dataclass
class Tree:
    """Node i splits by the distance to point[i]: up to cut[i] lies under near[i], the rest
    under far[i]. A child below 0 is the shard -1 - child."""

    point: list[int]
    cut: list[int]
    near: list[int]
    far: list[int]
    shards: int
    dense: list[int]  # shards that nothing parts


def _distances(x: np.ndarray, point: int) -> np.ndarray:
    return np.bitwise_count(x ^ x.dtype.type(point)).astype(np.int16)


def _best_split(x: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[int, int] | None:
    """(vantage point, cut) with the fewest expected comparisons; None if nothing parts x."""
    best, found = 0.98, None
    some = x if len(x) <= 4096 else rng.choice(x, 4096)
    for point in rng.choice(some, 6):
        at = np.bincount(_distances(some, point), minlength=some.dtype.itemsize * 8 + 1) / len(some)
        up_to = np.concatenate([np.zeros(radius + 1), np.cumsum(at), np.ones(radius + 1)])
        for cut in np.flatnonzero(at)[:-1]:
            home, near, far = up_to[cut + radius + 1], up_to[cut + 2 * radius + 1], 1 - up_to[cut + 1]
            if (cost := home * near + (1 - home) * far) < best:
                best, found = cost, (int(point), int(cut))
    return found


def build(sample: np.ndarray, radius: int, capacity: int, seed: int = SEED) -> Tree:
    rng, tree = np.random.default_rng(seed), Tree([], [], [], [], 0, [])

    def add(x: np.ndarray) -> int:
        split = _best_split(x, radius, rng) if len(x) > capacity else None
        if split is None:
            if len(x) > capacity:
                tree.dense.append(tree.shards)
            tree.shards += 1
            return -tree.shards
        node = len(tree.point)
        tree.point.append(split[0])
        tree.cut.append(split[1])
        tree.near.append(0)
        tree.far.append(0)
        near = _distances(x, split[0]) <= split[1]
        tree.near[node], tree.far[node] = add(x[near]), add(x[~near])
        return node

    add(sample)
    return tree


def route(tree: Tree, x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into x, shard, whether it is the home shard) of every visit."""
    out: list[tuple[np.ndarray, int, np.ndarray]] = []
    todo = [(0 if tree.point else -1, np.arange(len(x)), np.ones(len(x), bool))]
    while todo:
        node, at, home = todo.pop()
        if not len(at):
            continue
        if node < 0:
            out.append((at, -1 - node, home))
            continue
        d = _distances(x[at], tree.point[node]) - tree.cut[node]
        for child, goes, lives in ((tree.near[node], d - radius <= 0, d <= 0), (tree.far[node], d + radius > 0, d > 0)):
            todo.append((child, at[goes], home[goes] & lives[goes]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return (np.concatenate([a for a, _, _ in out]), np.repeat([s for _, s, _ in out], [len(a) for a, _, _ in out]),
            np.concatenate([h for _, _, h in out]))


def half(fp: np.ndarray, view: int) -> np.ndarray:
    width = 64 // VIEWS
    return ((fp >> np.uint64(width * view)) & np.uint64((1 << width) - 1)).astype(np.uint32)


def _roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if (up == x).all():
            return x
        x = up


def _merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while len(a):
        ra, rb = _roots(parent, a), _roots(parent, b)
        apart = ra != rb
        if not apart.any():
            return
        a, b = np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart]
        np.minimum.at(parent, a, b)


FLIPS = np.array([0, *(1 << b for b in range(16))], np.uint32)


def parts_of(fp: np.ndarray, view: int) -> list[np.ndarray]:
    """The 16-bit parts of the half that the view does not look at."""
    other = half(fp, 1 - view)
    return [other & np.uint32(0xFFFF), other >> np.uint32(16)]


def dense_buckets(fp: np.ndarray, home: np.ndarray, view: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into fp, bucket, whether it lives there): two buckets for each that is at home, and
    for each all those within 1 bit."""
    at, bucket, lives = [], [], []
    every, own = np.arange(len(fp)), np.flatnonzero(home)
    for p, part in enumerate(parts_of(fp, view)):
        at.append(own)
        bucket.append((p << 16) + part[own].astype(np.int64))
        at.append(np.repeat(every, len(FLIPS)))
        bucket.append((p << 16) + (part[:, None] ^ FLIPS).astype(np.int64).ravel())
        lives += [np.ones(len(own), bool), np.zeros(len(fp) * len(FLIPS), bool)]
    return np.concatenate(at), np.concatenate(bucket), np.concatenate(lives)


def _meet_dense(parent: np.ndarray, every: np.ndarray, h: np.ndarray, q: np.ndarray, view: int, bits: int) -> None:
    """Merges the links between h and q, which nothing parts, by the parts of their other half."""
    for part in parts_of(every, view):
        order = h[np.argsort(part[h], kind="stable")]
        keys = part[order]
        for flip in FLIPS:
            want = part[q] ^ flip
            lo, hi = np.searchsorted(keys, want), np.searchsorted(keys, want, "right")
            n = hi - lo
            before = np.append(0, np.cumsum(n))
            cuts = [0]
            while cuts[-1] < len(q):  # about so many pairs at once, whole queries
                cuts.append(max(cuts[-1] + 1, int(np.searchsorted(before, before[cuts[-1]] + PAIRS, "right")) - 1))
            for a, b in zip(cuts, cuts[1:]):
                m = n[a:b]
                which = np.repeat(np.arange(a, b), m)
                i = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo[a:b], m)
                near = np.bitwise_count(every[q[which]] ^ every[order[i]]) <= bits
                _merge(parent, q[which[near]], order[i[near]])


def shard_forest(home: np.ndarray, asks: np.ndarray, view: int, radius: int, bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its part) that span all links between the
    shard's fingerprints ``home`` and the querying fingerprints ``asks``."""
    every = np.unique(np.concatenate([home, asks]))
    parent, rng = np.arange(len(every)), np.random.default_rng(SEED)
    todo = [(np.searchsorted(every, home), np.searchsorted(every, asks))]
    key = half(every, view)
    while todo:
        h, q = todo.pop()
        if not len(h) or not len(q):
            continue
        split = _best_split(key[h], radius, rng) if len(h) > LEAF else None
        if split:
            dh, dq = _distances(key[h], split[0]) - split[1], _distances(key[q], split[0]) - split[1]
            todo += [(h[dh <= 0], q[dq - radius <= 0]), (h[dh > 0], q[dq + radius > 0])]
            continue
        if len(h) > DENSE:
            _meet_dense(parent, every, h, q, view, bits)
            continue
        for hb in range(0, len(h), 4096):
            hh = h[hb: hb + 4096]
            for lo in range(0, len(q), 256):
                qq = q[lo: lo + 256]
                i, j = np.nonzero(np.bitwise_count(every[qq][:, None] ^ every[hh][None, :]) <= bits)
                _merge(parent, qq[i], hh[j])
    root = _roots(parent, np.arange(len(every)))
    moved = root != np.arange(len(every))
    return every[moved], every[root[moved]]


def links(fps: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Edges a, b that span all links between the distinct longs of column ``fp``."""
    spark, radius = fps.sparkSession, bits // VIEWS
    total = fps.count()
    size = min(MOST_SAMPLED, max(SAMPLE, total // SAMPLED))
    sample = np.array([r[0] for r in fps.orderBy(F.xxhash64("fp")).limit(size).collect()], np.int64).view(np.uint64)
    capacity = max(MIN_SAMPLED, SHARD * len(sample) // max(total, 1))
    trees = spark.sparkContext.broadcast([build(half(sample, v), radius, capacity) for v in range(VIEWS)])

    def deal(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for v, tree in enumerate(trees.value):
                at, shard, home = route(tree, half(fp, v), radius)
                bucket, dense = np.full(len(at), -1), np.isin(shard, tree.dense)
                if dense.any():
                    some = np.flatnonzero(dense)
                    i, b, lives = dense_buckets(fp[at[some]], home[some], v)
                    at, shard = np.append(at[~dense], at[some[i]]), np.append(shard[~dense], shard[some[i]])
                    bucket, home = np.append(bucket[~dense], b), np.append(home[~dense], lives)
                yield pa.RecordBatch.from_arrays([pa.array(shard * VIEWS + v, pa.int32()), pa.array(bucket, pa.int32()), pa.array(fp[at].view(np.int64)), pa.array(home)],
                                                 names=["shard", "bucket", "fp", "home"])

    def search(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        fp, home = rows["fp"].to_numpy().view(np.uint64), rows["home"].to_numpy()
        a, b = shard_forest(fp[home], np.unique(fp), int(key[0]) % VIEWS, radius, bits)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = fps.mapInArrow(deal, "shard int, bucket int, fp long, home boolean")
    return dealt.groupBy("shard", "bucket").applyInPandas(search, "a long, b long")


def classes(fps: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(fp, part) of every distinct long of column ``fp``: the part is a fingerprint
    that all its component's fingerprints share."""
    found = components(links(fps, bits))
    return fps.join(found, fps["fp"] == found["node"], "left").select("fp", F.coalesce("component", "fp").alias("part"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    shared_dir(docs.sparkSession)
    own = with_fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "fp").select("doc_id", "fp").checkpoint()
    firsts = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    parts = classes(firsts.select("fp")).join(firsts, "fp")
    ids = parts.groupBy("part").agg(F.min("first").alias("component_id"))
    named = parts.select("fp", "part").join(ids, "part").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The input rows without all but one document of each component: the one of the
    smallest id (of several rows of that id and fingerprint: any one)."""
    shared_dir(docs.sparkSession)
    fp = ta.free_name(docs, "fp")
    marked = with_fingerprints(docs, fp, text)
    own = marked.select(F.col(doc_id).alias("id"), F.col(fp).alias("fp")).checkpoint()
    rows = own.groupBy("fp", "id").agg(F.count(F.lit(1)).alias("rows"))
    firsts = rows.groupBy("fp").agg(F.min_by(F.struct("id", "rows"), F.struct(F.col("id").isNull(), "id")).alias("r"))
    best = (classes(firsts.select("fp")).join(firsts, "fp")
            .groupBy("part").agg(F.min(F.struct(F.col("r.id").isNull().alias("none"), F.col("r.id").alias("id"), "fp", F.col("r.rows").alias("rows"))).alias("k"))
            .select(F.col("k.id").alias("k_id"), F.col("k.fp").alias("k_fp"), F.col("k.rows").alias("k_rows")).checkpoint())
    keys = bounded_broadcast(best.select("k_id", "k_fp"))
    if rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows")).where("n > 1 OR rows > 1").isEmpty():
        # Every id is one row's: the texts need not be read for their fingerprints again.
        return docs.join(keys, docs[doc_id].eqNullSafe(keys["k_id"]), "left_semi")
    kept = marked.join(keys, (marked[fp] == keys["k_fp"]) & marked[doc_id].eqNullSafe(keys["k_id"]), "left_semi")
    if not best.where("k_rows > 1").isEmpty():  # rows that share even the id
        kept = kept.dropDuplicates([fp])
    return kept.drop(fp)
