import random
import tracemalloc

import numpy as np

from concord.llm import decontam_lsa as m
from tests.llm.helpers import DOCS, edge_docs, prose, with_clashes


def word(r):
    return "".join(r.choice("bdfgklmnprstv") + r.choice("aeiou") for _ in range(r.randint(2, 4)))


def text(seed, n):
    r = random.Random(seed)
    return " ".join(word(r) if r.random() < 0.6 else r.choice(["the", "of", "and", "to"]) for _ in range(n))


ITEMS = [(i, text(1000 + i, n).capitalize() + ". " + text(2000 + i, 6).capitalize() + ".") for i, n in enumerate([10, 18, 25, 33, 45, 52, 150])]


def brute_lcs(a, b, w):
    t = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1, j + 1] = max(t[i, j + 1], t[i + 1, j], t[i, j] + w[i] * (a[i] == b[j]))
    return t[-1, -1] / w.sum()


def test_weighted_lcs_matches_the_full_table():
    r = np.random.default_rng(0)
    for _ in range(50):
        a, b = r.integers(0, 6, r.integers(1, 12)), r.integers(0, 6, r.integers(0, 20))
        w = r.random(len(a)) + 0.1
        assert abs(m.weighted_lcs(a, b, w) - brute_lcs(a, b, w)) < 1e-9


def planted():
    """300 documents; each item stands in some, once paraphrased."""
    rows, truth = [], set()
    for i in range(300):
        t = text(i, 60 + i)
        if i % 6 == 0:
            item, body = ITEMS[(i // 6) % len(ITEMS)]
            if i % 12:
                body = body.upper().replace(" ", "  \n")
            w = t.split()
            at = random.Random(i).randint(0, len(w))
            t = " ".join([*w[:at], body, *w[at:]])
            truth.add((i, item))
        rows.append((i, t, "en", "s", len(t)))
    r = random.Random(5)
    w = ITEMS[4][1].split()
    paraphrase = " ".join("quux" if k % 9 == 4 and k < len(w) - 7 else x for k, x in enumerate(w))
    rows.append((900, text(77, 50) + " " + paraphrase + " " + text(78, 50), "en", "s", 1))
    truth.add((900, 4))
    r.shuffle(rows)
    return rows, truth


def test_finds_every_planted_passage_and_no_other(spark):
    rows, truth = planted()
    docs = spark.createDataFrame(rows, DOCS)
    bench = spark.createDataFrame([*ITEMS, (50, None), (51, ""), (None, "x y z"), (52, ITEMS[0][1])], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in m.leaks(with_clashes(docs), with_clashes(bench)).collect()}
    truth |= {(d, 52) for d, i in truth if i == 0}
    assert got == truth
    kept = m.drop_leaking(with_clashes(docs), bench)
    assert kept.columns == with_clashes(docs).columns
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - {d for d, _ in truth}


def test_item_in_a_third_of_all_documents(spark):
    """Its leaks make its own words common terms; a neighbour of few leaks is found as before."""
    rows, truth = [], set()
    for i in range(300):
        w = text(i, 60 + i).split()
        at = random.Random(i).randint(0, len(w))
        here = [k for k, share in ((1, 3), (3, 3), (6, 4), (2, 30)) if i % share == 0]
        truth |= {(i, item) for item in here}
        rows.append((i, " ".join([*w[:at], *[ITEMS[item][1] for item in here], *w[at:]]), "en", "s", 1))
    paraphrase = " ".join("quux" if k % 3 == 1 and k < 22 else x for k, x in enumerate(ITEMS[3][1].split()))
    rows.append((900, text(77, 50) + " " + paraphrase + " " + text(78, 50), "en", "s", 1))
    truth.add((900, 3))
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")
    space = m.fit(docs)
    common = [p["item"] for p in m.pieces_of(ITEMS, space) if not p["vector"].any()]
    assert {1, 3} <= set(common)
    assert {(r["doc_id"], r["item_id"]) for r in m.leaks(docs, bench).collect()} == truth
    assert {r["doc_id"] for r in m.drop_leaking(docs, bench).collect()} == {r[0] for r in rows} - {d for d, _ in truth}


def test_short_items_are_found_wherever_they_stand(spark):
    r = random.Random(11)
    pool = [word(r) + word(r) for _ in range(110)]
    items = [(i, " ".join(r.sample(pool, (4, 5, 8)[i % 3]))) for i in range(60)]
    rows, truth = [], set()
    for i in range(240):
        w = [word(r) + word(r) for _ in range(80)]  # rarer than the items' words
        at = r.randint(0, len(w))
        rows.append((i, " ".join([*w[:at], items[i % 60][1], *w[at:]]), "en", "s", 1))
        truth.add((i, i % 60))
    got = m.leaks(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got if x["lcs"] > 0.999} == truth


def test_items_in_blocks_find_the_same(spark, monkeypatch):
    rows, _ = planted()
    docs, bench = spark.createDataFrame(rows[:120], DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")
    whole = sorted((r["doc_id"], r["item_id"]) for r in m.leaks(docs, bench).collect())
    monkeypatch.setattr(m, "ITEMS", 2)
    assert sorted((r["doc_id"], r["item_id"]) for r in m.leaks(docs, bench).collect()) == whole and whole


def test_edge_rows_and_empty_tables(spark):
    docs = edge_docs(spark)
    bench = spark.createDataFrame([(1, prose(2, 120)), (2, "")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in m.leaks(docs, bench).collect())
    assert got == [(1, 1), (2, 1), (2, 1)]
    assert m.leaks(docs.limit(0), bench).count() == 0 and m.leaks(docs, bench.limit(0)).count() == 0
    assert m.drop_leaking(docs, bench.limit(0)).count() == docs.count()


def test_the_latent_search_finds_paraphrases_and_carries_the_result(spark):
    """Against an exhaustive search by key words under the same acceptance rule: recall of
    0.9 or more at every share of replaced words; without the cosine nearly all is lost."""
    sf = "/root/testdata/sf0.01"
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() if r["text"]]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    space = m.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    pieces = m.pieces_of(items, space)
    shown, dim = [[p for p in pieces if m.latent_shows(p, space) == yes] for yes in (True, False)]
    assert len(shown) > 0.8 * len(pieces)
    sides = [x for short in (True, False) if (x := m.side_of(2 if short else 4, [p for p in shown if p["short"] == short], space))]
    exact = lambda ps: [m.exact_of(ps, space)] if ps else []
    r = random.Random(3)
    for share in (0, 0.2, 0.35, 0.45):
        rows = []
        for _ in range(250):
            body = [r.choice(r.choice(texts).split()) if r.random() < share else x for x in r.choice(items)[1].split()]
            d = r.choice(texts).split()
            at = r.randint(0, len(d))
            rows.append(" ".join([*d[:at], *body, *d[at:]]))

        def found(*how):
            return {(lo + d, x[0]) for lo, h, first in m._terms(m.pa.array(rows)) for d, f in m._search(h, first, space, *how).items() for x in f}

        want, got = found([], exact(pieces)), found(sides, exact(dim))
        assert len(got & want) >= 0.9 * len(want) and len(want) > 100
        assert len(found([], exact(dim))) < 0.3 * len(want)


def test_rows_are_added_by_run():
    """Against one row at a time: empty runs, long ones at the end, with weights and without."""
    r = np.random.default_rng(4)
    table = r.normal(size=(30, 5)).astype(np.float32)
    for n, members in ((1, 0), (7, 40), (50, 20), (3, 900), (20, 900)):
        run = np.sort(r.integers(0, n, members))
        row, weight = r.integers(0, 30, members), r.random(members).astype(np.float32)
        for w in (None, weight):
            want = np.zeros((n, 5))
            np.add.at(want, run, table[row].astype(float) * (1 if w is None else w[:, None]))
            assert np.allclose(m._added(run, n, table, row, w), want, atol=1e-3)


def test_sliding_sums():
    x = np.random.default_rng(5).integers(0, 9, (23, 4)).astype(np.float32)
    for width in (1, 2, 5, 8, 16, 23):
        assert (m._sliding(x, width) == [x[i: i + width].sum(0) for i in range(len(x) - width + 1)]).all()


def searched():
    """One block of texts, the pieces that the latent space shows and the space."""
    rows = [t for _, t, *_ in planted()[0]] + ["", "one", ITEMS[3][1]]
    lo, h, first = next(m._terms(m.pa.array(rows), 1 << 30))
    df = np.bincount(m._term(np.unique(h)), minlength=m.TERMS).astype(float)
    idf = np.where(df > 0, 6 - 3 * np.random.default_rng(1).random(m.TERMS), 7).astype(np.float32)
    weight = idf.copy()
    weight[[m._term(m._words_of(w))[0] for w in ("the", "of", "and", "to")]] = 0
    space = m.Space(weight, idf, np.random.default_rng(2).normal(size=(m.COLUMNS, m.RANK)).astype(np.float32))
    return h, first, space


def test_the_sift_loses_no_candidate(spark):
    """Every window at the cosine aligned without a sift gives the same leaks."""
    h, first, space = searched()
    for short in (True, False):
        pieces = [p for p in m.pieces_of(ITEMS, space) if p["short"] == short]
        side = m.side_of(2 if short else 4, pieces, space)
        s = m._starts(first, m.STEP)
        owner = np.searchsorted(first, s, "right") - 1
        want = {}
        for i in range(len(s)):
            d = owner[i]
            end = min(first[d + 1], s[i] + side.n_steps * m.STEP)
            place = m._unit(space.sums(h[s[i]: end], np.array([0]), space.latent))[0]
            for piece, cosine in zip(pieces, side.unit @ place):
                if cosine >= side.cosine:
                    n = len(piece["h"])
                    m._align(want.setdefault(int(d), {}), piece, h[max(first[d], s[i] - n): min(first[d + 1], s[i] + side.n_steps * m.STEP + n)], float(cosine), space)
        got = m._search(h, first, space, [side], [])
        pairs = lambda x: {(d, v[0]): v[2:] for d, vs in x.items() for v in vs}
        assert pairs(got) == pairs({d: list(x.values()) for d, x in want.items()}) and len(pairs(got)) >= 10


def test_the_sift_takes_memory_by_window_not_by_word():
    """The weights of pieces along the words of a block took 34 MB here."""
    h, first, space = searched()
    items = [(i, text(5000 + i, 40)) for i in range(300)] + ITEMS
    side = m.side_of(4, [p for p in m.pieces_of(items, space) if not p["short"]], space)
    m._search(h, first, space, [side], [])
    tracemalloc.start()
    m._search(h, first, space, [side], [])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6
