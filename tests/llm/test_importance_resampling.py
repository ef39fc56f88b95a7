import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from concord.llm import importance_resampling as m
from tests.llm.helpers import DOCS, edge_docs, prose, with_clashes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, n=1):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), [" ".join(w[i:i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(rows, target, n=1, buckets=10_000, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, features(text, n)[1]))
    for text in target:
        t.update(map(bucket, features(text, n)[1]))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for i, text in rows:
        words, f = features(text, n)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0, x[2], x[3]))
    drawn = fit[: percent * len(fit) // 100]
    ranked = [(*x, k + 1) for k, x in enumerate(drawn)] + [(*x, None) for x in fit[len(drawn):]] + [(*x, None) for x in out if x[1] < 20]
    return sorted([(x[0], *x[2:]) for x in ranked], key=repr)


def result(df):
    return sorted([(r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()], key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    more = [(100 + i, prose(i % 37, 15 + i % 30), "en", "a", 1) for i in range(150)]
    odd = [(300, "".join(chr(c) for c in range(1, 0x250)) + " x" * 30, "xx", "b", 1), (301, "İSTANBUL ǅ ß" * 30, "tr", "b", 1), (302, "1a2B " * 40, "xx", "b", 1)]
    return edge_docs(spark).union(spark.createDataFrame(more + odd, DOCS))


@pytest.mark.parametrize("percent,n", [(10, 1), (60, 1), (30, 3)])
def test_matches_brute_force(spark, docs, percent, n):
    aim = spark.createDataFrame([(1, prose(3, 300)), (2, None), (3, "Quick Fox éa"), (3, "Quick Fox éa")], "item_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = m.ranked(m.scores(with_clashes(docs), aim, max_n=n), percent)
    assert result(got) == brute(rows, [r["text"] for r in aim.collect()], n, percent=percent)


def test_pieces_keep_words_and_windows_whole():
    split = m.splitter()
    for text in (prose(1, 400), "one", "", None, "x" * 900, "a b" * 300, " " * 500 + "é b"):
        for size in (1, 7, 64):
            got = list(m.windows(text, split, 3, size))
            words, want = features(text, 3)
            assert sum(n for n, _ in got) == words and Counter(f for _, fs in got for f in fs) == Counter(want)


def test_drawn_rows_keep_their_columns(spark, docs):
    aim = spark.createDataFrame([(1, prose(3, 300))], "item_id long, text string")
    ids = {r["doc_id"] for r in m.ranked(m.scores(docs, aim)).where("rank IS NOT NULL").collect()}
    got = m.resample(with_clashes(docs), aim)
    assert got.columns == with_clashes(docs).columns and {r["doc_id"] for r in got.collect()} == ids - {None} and len(ids) > 10


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert result(m.ranked(m.scores(docs, none))) == brute(rows, [])
    assert m.ranked(m.scores(docs.limit(0), none)).count() == 0
