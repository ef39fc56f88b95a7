import math
import re
import zlib
from collections import Counter

import pytest

from concord.llm import quality_llr as q
from tests.llm.helpers import DOCS, edge_docs, labels_of, prose, with_clashes


def brute(rows, trusted):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]

    def grams(w):
        c = [zlib.crc32(x.encode()) for x in w]
        return [x % q.BUCKETS for x in c] + [(31 * x + y) % q.BUCKETS for x, y in zip(c, c[1:])]

    raw, target = Counter(), Counter()
    for (i, _), w in zip(rows, words):
        raw.update(grams(w))
        if i in trusted:
            target.update(grams(w))
    f = sum(target.values()) / max(1, sum(raw.values()))
    weight = {b: round(math.log((target[b] + 16) / (raw[b] * f + 16)) * 1e6) for b in raw}
    out = []
    for (i, t), w in zip(rows, words):
        windows = Counter(zip(w, w[1:], w[2:]))
        covered = {p + k for p, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        g = grams(w)
        total = sum(weight[b] for b in g)
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered), failed,
                    not failed and total >= -80000 * len(g)))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r[:7]) + (r["kept"],) for r in df.collect()), key=repr)


def test_matches_brute_force_on_edge_rows(spark):
    docs = edge_docs(spark).union(spark.createDataFrame([
        (20, "$$$ ### " * 60 + prose(9, 40), "en", "z", 1), (21, "\n".join(["same line here"] * 30), "en", "z", 1),
        (22, "a b c a b c d a b c\na b c\n a b c", "en", "z", 1), (23, prose(8, 100), "en", "z", 1)], DOCS))
    labels = labels_of(spark, [(1, 1, 0), (1, 0, 0), (6, 1, None), (23, 1, 1), (None, 1, 1), (20, 0, 0), (22, None, 0)])
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = q.quality_verdicts(with_clashes(docs), q.trusted_from_labels(labels))
    assert result(got) == brute(rows, {1, 6, 23})


def test_windows_by_text_equal_windows_by_hash(spark, monkeypatch):
    docs = edge_docs(spark)
    labels = q.trusted_from_labels(labels_of(spark, [(1, 1, 0)]))
    want = result(q.quality_verdicts(docs, labels))
    monkeypatch.setattr(q, "PLACE_BITS", 3)  # nearly every text is too long for its hashes
    assert result(q.quality_verdicts(docs, labels)) == want


@pytest.mark.parametrize("labelled", [True, False])
def test_empty_tables(spark, labelled):
    docs = edge_docs(spark)
    none = labels_of(spark, [])
    assert q.quality_verdicts(docs.limit(0), q.trusted_from_labels(none)).count() == 0
    kept = q.keep_likely(docs, q.trusted_from_labels(none))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, None, 6, -5} - {
        r["doc_id"] for r in q.quality_verdicts(docs, q.trusted_from_labels(none)).where("base_failed").collect()}


def test_plan_runs_no_python(spark):
    docs = edge_docs(spark)
    plan = q.quality_verdicts(docs, q.trusted_from_labels(labels_of(spark, [(1, 1, 0)])))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian", plan)


def test_filter_stays_above_the_verdict(spark):
    """Pushed down, the filter would repeat the splitting for every word of a text."""
    docs = edge_docs(spark)
    plan = q.keep_likely(docs, q.trusted_from_labels(labels_of(spark, [(1, 1, 0)])))._jdf.queryExecution().optimizedPlan().toString()
    condition = next(line for line in plan.splitlines() if "Filter" in line and "kept" in line or "Filter" in line and "place" in line)
    assert "split(" not in condition
