import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from concord.llm import packing as p
from tests.llm.helpers import edge_docs, with_clashes

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def plain_pack(sizes, caps, opens):
    """The same rule with a scan over all bins; ``opens``: the length that a size opens."""
    bins = []
    out = [None] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [b for b in bins if b["room"] >= sizes[i]]
        if fits:
            least = min(b["room"] for b in fits)
            b = max((b for b in fits if b["room"] == least), key=lambda b: b["since"])
        else:
            b = {"room": opens(sizes[i]), "held": 0, "id": len(bins), "since": 0}
            bins.append(b)
        out[i] = (b["id"], b["held"])
        b["room"] -= sizes[i]
        b["held"] += sizes[i]
        b["since"] = len(sizes) + len([x for x in out if x])  # the latest to reach a room is taken first
    return [(b, o, min(c for c in caps if c >= bins[b]["held"])) for b, o in out]


def total(packed):
    return sum(p.cost(c) for c in {b: c for b, _, c in packed}.values())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.sampled_from([(40,), (8, 16, 40), (40, 64, 100)]))
def test_matches_a_plain_best_fit(sizes, caps):
    got = list(zip(*(x.tolist() for x in p.pack(np.array(sizes, np.int64), caps))))
    if sizes:
        plan = p.best_plan(-np.sort(-np.array(sizes)), np.array(caps))
        assert got == plain_pack(sizes, caps, lambda s: plan[min(k for k, c in enumerate(caps) if c >= s)])
        # no plan of one length, and no change of the plan for one class, is cheaper
        others = [tuple(max(c, x) for c in caps) for x in caps] + [(*plan[:k], c, *plan[k + 1:]) for k in range(len(caps)) for c in caps[k:]]
        for other in others:
            assert total(got) <= total(plain_pack(sizes, caps, lambda s: other[min(k for k, c in enumerate(caps) if c >= s)])) + 1e-9


def test_joint_choice_beats_every_single_length_and_the_cheapest_per_token():
    r = np.random.default_rng(1)
    mixes = {
        "even": r.integers(1, 2049, 4000), "short": np.minimum(4096, r.lognormal(5.5, 1, 6000).astype(int) + 1),
        "awkward": r.choice([600, 700, 1030, 1300, 2100, 60], 3000), "long": r.integers(1500, 4097, 2000),
    }
    for name, sizes in mixes.items():
        packed = list(zip(*(x.tolist() for x in p.pack(sizes))))
        one = {c: sum(p.cost(c) for _ in {b for b, _, _ in plain_by(sizes, c)}) for c in p.CAPACITIES if c >= sizes.max()}
        assert all(total(packed) <= x for x in one.values()), name
        assert total(packed) <= total(old_rule(sizes)) + 1e-6, name
    used = {c for _, _, c in zip(*(x.tolist() for x in p.pack(mixes["awkward"])))}
    assert len(used) >= 2
    assert total(list(zip(*(x.tolist() for x in p.pack(mixes["awkward"]))))) < 0.99 * total(old_rule(mixes["awkward"]))


def plain_by(sizes, c):
    order = -np.sort(-sizes)
    return list(zip(*p._fill(order.tolist(), [c] * len(order))[:2], [c] * len(order)))


def old_rule(sizes):
    """Always the length of least cost per token that holds the piece."""
    order = -np.sort(-sizes)
    opens = [min((c for c in p.CAPACITIES if c >= s), key=lambda c: p.cost(c) / c) for s in order.tolist()]
    bins, offset, held = p._fill(order.tolist(), opens)
    final = p._final(held, np.array(p.CAPACITIES))
    return [(b, o, int(final[b])) for b, o in zip(bins, offset)]


def test_pieces_fill_bins_without_overlap(spark):
    rows = [(i, int(n)) for i, n in enumerate(np.random.default_rng(0).integers(0, 9000, 400))] + [(None, 50), (5, 70), (5, 70), (6, None), (7, -1)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    got = p.best_fit(with_clashes(df.withColumnRenamed("n_tokens", "size")), n_tokens="size").collect()
    assert sum(r["n_tokens"] for r in got) == sum(max(0, n or 0) for _, n in rows)
    bins, docs = {}, {}
    for r in got:
        bins.setdefault(r["bin_id"], []).append((r["bin_offset"], r["n_tokens"], r["capacity"]))
        docs.setdefault(r["doc_id"], []).append((r["token_start"], r["n_tokens"]))
    for b in bins.values():
        b.sort()
        end = 0
        for offset, n, _ in b:
            assert offset == end
            end += n
        assert {c for *_, c in b} == {min(c for c in p.CAPACITIES if c >= end)}  # cut down to its contents
    assert sorted(docs[0]) == [(s, min(4096, rows[0][1] - s)) for s in range(0, rows[0][1], 4096)]
    held = sum(n for b in bins.values() for _, n, _ in b)
    assert held / sum(b[0][2] for b in bins.values()) > 0.95


def test_documents_are_packed_whole(spark, monkeypatch):
    docs = edge_docs(spark)
    n = {(r["doc_id"], r["n_tokens"]) for r in p.token_lengths(docs, VOCABULARY).collect()}
    monkeypatch.setattr(p, "RUN", 3)
    got = p.pack_documents(with_clashes(docs), VOCABULARY).collect()
    assert {r["doc_id"] for r in got} == {d for d, _ in n}
    assert sum(r["n_tokens"] for r in got if r["doc_id"] == 6) == dict(n)[6] and dict(n)[3] == dict(n)[4] == 1
    assert p.pack_documents(docs.limit(0), VOCABULARY).count() == 0
