import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.llm import quality_mil, toxicity_cnn
from tests.llm.helpers import DOCS, edge_docs, fold, labels_of, prose, with_clashes


def corpus(spark, n=360):
    """Every third document has two rude words; every fourth is symbols."""
    rows, labels = [], []
    for i in range(n):
        text = prose(i, 90)
        if i % 3 == 0:
            text += " zounds " + prose(i + 5000, 20) + " Poltroon!"
        if i % 4 == 0:
            text = " ".join(w + "$$$" for w in text.split())
        rows.append((i, text, ["en", "fr", None][i % 5 % 3], "s", 1))
        if i % 7:
            labels.append((i, int(i % 4 != 0), int(i % 3 == 0)))
    return spark.createDataFrame(rows, DOCS), labels_of(spark, labels + [(None, 1, 1), (3, None, None), (10**6, 1, 1)])


def test_toxicity_held_out_accuracy_and_columns(spark):
    docs, labels = corpus(spark)
    got = {r["doc_id"]: r for r in toxicity_cnn.toxicity_scores(with_clashes(docs), labels).collect()}
    assert len(got) == docs.count()
    assert all(r["held_out"] == (fold(i, 3) == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for i, r in got.items())
    held = [r for r in got.values() if r["held_out"]]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 == 0) for r in held]) > 0.95
    kept = toxicity_cnn.drop_toxic(with_clashes(docs), labels)
    assert kept.columns == with_clashes(docs).columns
    assert np.mean([i % 3 != 0 for (i,) in kept.select("doc_id").collect()]) > 0.95


def test_toxicity_learns_from_long_texts_and_every_row(spark):
    # All texts have over 2048 words; before, none of them was learnt from.
    rows = [(i, prose(i, 2100) + (" zounds poltroon" if i % 3 == 0 else ""), "en", "s", 1) for i in range(240)]
    docs, labels = spark.createDataFrame(rows, DOCS), labels_of(spark, [(i, 1, int(i % 3 == 0)) for i in range(240)])
    learnt = toxicity_cnn.labelled_rows(docs.union(docs.limit(9)), labels, 3, 1, "text", "doc_id", "lang").count()
    assert learnt == sum(fold(i, 3) != 1 for i in [*range(240), *(r["doc_id"] for r in docs.limit(9).collect())])
    got = toxicity_cnn.toxicity_scores(docs, labels).collect()
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 == 0) for r in got]) > 0.95


def test_quality_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    got = quality_mil.quality_scores(with_clashes(docs), labels).collect()
    assert all(r["held_out"] == (fold(r["doc_id"], 5) == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 != 0) for r in got if r["held_out"]]) > 0.95


def test_held_out_labels_are_never_learnt(spark):
    docs, labels = corpus(spark, 150)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r["doc_id"], r["score"]) for r in toxicity_cnn.toxicity_scores(docs, x).collect()) for x in (labels, flipped))
    assert a == b


@pytest.mark.parametrize("score", [toxicity_cnn.toxicity_scores, quality_mil.quality_scores])
def test_edge_rows_and_empty_tables(spark, score):
    docs, labels = corpus(spark, 120)
    edges = edge_docs(spark).select(*docs.columns).withColumn("doc_id", F.col("doc_id") + 10_000)
    got = score(docs.union(edges), labels).collect()
    assert len(got) == 120 + edges.count() and all(0 <= r["score"] <= 1 for r in got)
    same = {}
    for r in got:  # repeated rows and equal texts score alike
        same.setdefault(r["doc_id"], set()).add(r["score"])
    assert len(same[10_002]) == 1 and same[10_001] == same[10_002] and len(same[None]) == 1
    assert score(docs.limit(0), labels).count() == 0
    assert score(docs, labels.limit(0)).count() == 120


def test_convolution_matches_a_plain_loop():
    rng = np.random.default_rng(0)
    m = toxicity_cnn._empty_model()
    m.tables[:] = rng.normal(size=m.tables.shape)
    h = rng.integers(1, 2**62, 40, dtype=np.uint64)
    first = np.array([0, 0, 1, 3, 20, 20, 40])
    got = toxicity_cnn.score_words(m, h, first)
    a, b = toxicity_cnn._rows_of(h)
    for d, (lo, hi) in enumerate(zip(first, first[1:])):
        x = np.concatenate([m.tables[0][a[lo:hi]] + m.tables[1][b[lo:hi]], np.zeros((2, toxicity_cnn.DIM))])
        best = [max((sum(x[i + o] @ w[o][:, f] for o in range(len(w))) for i in range(hi - lo)), default=None) for w in m.filters for f in range(toxicity_cnn.FILTERS)]
        hidden = np.array([0 if v is None else max(0, v + c) for v, c in zip(best, m.bias)])
        assert abs(got[d] - 1 / (1 + np.exp(-np.clip(hidden @ m.out + m.out_bias, -30, 30)))) < 1e-4


def test_thresholds_by_language():
    s, y = np.linspace(0, 1, 200), np.array([0] * 120 + [1] * 80)
    cut = toxicity_cnn.calibrate(s, y, ["en"] * 200)["en"]
    assert s[119] < cut < s[120]
    assert toxicity_cnn.calibrate(s[:10], y[:10], ["en"] * 10) == {}


def test_attention_gradients():
    m, rng = quality_mil.start(), np.random.default_rng(1)
    x, first, y = rng.normal(size=(6, quality_mil.DIM + quality_mil.N_SHOWN)), np.array([0, 4, 6]), np.array([1.0, 0.0])

    def loss():
        p = quality_mil.forward(m, x, first)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for k, g in quality_mil.gradients(m, quality_mil.forward(m, x, first), y).items():
        at = tuple(0 for _ in g.shape)
        m[k][at] += 1e-5
        up = loss()
        m[k][at] -= 2e-5
        down = loss()
        m[k][at] += 1e-5
        assert abs((up - down) / 2e-5 - g[at]) < 1e-6, k
