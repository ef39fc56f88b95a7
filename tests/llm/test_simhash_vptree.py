import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from concord.llm import components as cc
from concord.llm import simhash_vptree as m
from tests.llm.helpers import DOCS, edge_docs, prose, with_clashes


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def plain_parts(fps):
    fps = np.array(sorted(set(fps)), np.uint64)
    parent = np.arange(len(fps))
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)
    m._merge(parent, i, j)
    return dict(zip(fps.tolist(), m._roots(parent, np.arange(len(fps))).tolist()))


def near(seed, n):
    rng = np.random.default_rng(seed)
    fp = rng.integers(0, 2**63, n, dtype=np.uint64)
    for _ in range(3):  # chains and clusters of 1 to 4 differing bits
        flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (rng.integers(1, 5), n // 3)).astype(np.uint64), axis=0)
        fp = np.concatenate([fp, rng.choice(fp, n // 3) ^ flips])
    return np.unique(np.append(fp, [np.uint64(0), np.uint64(7), np.uint64(2**64 - 1)]))


def forest(fp, capacity):
    parent = np.arange(len(fp))
    for v in range(m.VIEWS):
        tree = m.build(m.half(fp[::2], v), 1, capacity)
        at, shard, home = m.route(tree, m.half(fp, v), 1)
        assert home.sum() == len(fp)  # one home each
        for s in np.unique(shard):
            mine = shard == s
            a, b = m.shard_forest(fp[at[mine & home]], fp[at[mine]], v, 1)
            m._merge(parent, np.searchsorted(fp, a), np.searchsorted(fp, b))
    return m._roots(parent, np.arange(len(fp)))


@settings(max_examples=12, deadline=None)
@given(st.integers(0, 10**6), st.integers(30, 900), st.sampled_from([5, 40, 10**9]))
def test_trees_find_every_link(seed, n, capacity):
    fp = near(seed, n)
    assert forest(fp, capacity).tolist() == list(plain_parts(fp.tolist()).values())


def test_fingerprints_and_components_on_edge_rows(spark):
    base = prose(50, 400)
    docs = edge_docs(spark).union(spark.createDataFrame(
        [(100 + i, base.replace(" ", f" {'x' * i} " if i else " ", 1), "en", "s", 1) for i in range(6)] + [(110, base.upper(), "en", "s", 1)], DOCS))
    rows = docs.collect()
    fps = [plain_fingerprint(r["text"]) for r in rows]
    part = plain_parts(fps)
    least = {}
    for r, f in zip(rows, fps):
        if r["doc_id"] is not None:
            least[part[f]] = min(least.get(part[f], 10**9), r["doc_id"])
    want = sorted(((r["doc_id"], f"{f:016x}", least.get(part[f])) for r, f in zip(rows, fps)), key=repr)
    got = m.near_duplicates(with_clashes(docs))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert m.near_duplicates(docs.limit(0)).count() == 0
    kept = m.keep_one(with_clashes(docs))
    assert kept.columns == with_clashes(docs).columns
    ids = [(r["doc_id"], plain_fingerprint(r["text"])) for r in kept.collect()]
    assert sorted(part[f] for _, f in ids) == sorted(set(part.values()))  # one of each group
    assert all(i == least.get(part[f]) for i, f in ids)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 160)] + [(7, 7), (200, 201), (201, 200), (200, 201)]
    got = dict(tuple(r) for r in cc.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{j: 100 for j in range(100, 160)}, 200: 200, 201: 200}
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0


def dense_fps(seed, n):
    """Fingerprints that share a half, in chains and clusters."""
    rng = np.random.default_rng(seed)
    fp = rng.integers(0, 2**32, n, dtype=np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 32, (3, n // 2)).astype(np.uint64), axis=0)
    return np.unique(np.concatenate([fp, rng.choice(fp, n // 2) ^ flips, fp[: n // 4] ^ np.uint64(1 << 40)]))


def test_a_dense_shard_is_searched_by_parts(monkeypatch):
    for seed, shift in ((1, 0), (2, 32)):
        fp = dense_fps(seed, 3000)
        fp = np.unique((fp << np.uint64(shift)) | (fp >> np.uint64(64 - shift)) if shift else fp)
        monkeypatch.setattr(m, "DENSE", 100)
        assert forest(fp, 40).tolist() == list(plain_parts(fp.tolist()).values())


def test_200_000_that_share_a_half_spread_over_buckets(spark):
    rng = np.random.default_rng(5)
    fp = np.unique(rng.integers(0, 2**32, 200_000, dtype=np.uint64)) | np.uint64(0xABCDEF01 << 32)
    tree = m.build(m.half(fp, 1), 1, 4000)
    assert tree.dense == [0]
    at, bucket, lives = m.dense_buckets(fp[:5000], np.ones(5000, bool), 1)
    assert np.bincount(bucket[lives]).max() < 20 and lives.sum() == 10_000
    small = dense_fps(7, 900) | np.uint64(0xABCDEF01 << 32)
    monkey = m.SHARD, m.LEAF
    try:
        m.SHARD, m.LEAF = 20, 10
        df = spark.createDataFrame([(int(x),) for x in np.unique(small).view(np.int64)], "fp long")
        got = {r["fp"]: r["part"] for r in m.classes(df).collect()}
    finally:
        m.SHARD, m.LEAF = monkey
    want = plain_parts(small.tolist())
    by = lambda d: sorted(sorted(k for k in d if d[k] == p) for p in set(d.values()))
    assert by({int(np.int64(k).view(np.uint64)): v for k, v in got.items()}) == by(want)


def test_keep_one_reads_no_text_twice_where_ids_are_single(spark):
    base = prose(50, 300)
    docs = spark.createDataFrame([(i, base if i % 3 else prose(i, 80), "en", "s", 1) for i in range(30)] + [(None, base, "en", "s", 1)], DOCS)
    kept = m.keep_one(docs)
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 0
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted([1, *range(0, 30, 3)])
