"""The pipeline against brute-force rules of its stages on small tables."""

import re

import corpus_pipeline
from concord.llm.common import table
from tests.llm.helpers import edge_docs, labels_of, with_clashes
from tests.llm.test_simhash_vptree import plain_fingerprint, plain_parts

SF = "/root/testdata/sf0.01"


def test_stages_take_effect_in_order(spark):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, [docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        rows = docs.collect()
        assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in seen[-1]}
        docs = spark.createDataFrame(rows, docs.schema)
        seen.append(rows)
    raw, good, clean, single, safe = seen
    assert len(raw) > len(good) > len(clean) > len(single) >= len(safe)
    part = plain_parts([plain_fingerprint(r["text"]) for r in clean])
    assert sorted(part[plain_fingerprint(r["text"])] for r in single) == sorted(set(part.values()))
    items = [" ".join(re.findall(r"\w+", r["text"].lower())) for r in table(spark, SF, "benchmark").collect()]
    flat = lambda r: " ".join(re.findall(r"\w+", r["text"].lower()))
    leaking = {r["doc_id"] for r in single if any(f" {i} " in f" {flat(r)} " for i in items)}
    assert leaking and not leaking & {r["doc_id"] for r in safe}
    assert len(single) - len(safe) <= len(leaking) + 2
    labels = {r["doc_id"]: r for r in table(spark, SF, "labels").collect()}
    judged = [labels[r["doc_id"]]["quality"] for r in raw if r["doc_id"] in labels and r["doc_id"] not in {g["doc_id"] for g in good} and len(r["text"].split()) >= 50]
    assert judged.count(0) >= judged.count(1)


def test_run_packs_what_the_stages_leave(spark):
    packed = corpus_pipeline.run(spark, SF).collect()
    assert packed and {"doc_id", "bin_id", "capacity"} <= set(packed[0].asDict())
    bins = {}
    for r in packed:
        bins.setdefault(r["bin_id"], []).append((r["bin_offset"], r["n_tokens"], r["capacity"]))
    assert all(sum(n for _, n, _ in b) <= b[0][2] for b in bins.values())


def write_tables(spark, folder, docs, labels, items):
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    items.write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_run_on_awkward_rows(spark, tmp_path):
    """Nulls, blanks, repeated and null ids, a very long text and clashing column names: of what the
    quality rules keep, one row of each group of copies is packed, the base failures never."""
    docs = with_clashes(edge_docs(spark))
    labels = labels_of(spark, [(1, 1, 0), (2, 1, 0), (4, 0, 1), (6, 1, 0), (-5, 1, 0), (7, 0, 1), (None, None, None)])
    items = spark.createDataFrame([(1, "what no document says " * 6), (None, None), (2, "")], "item_id long, text string")
    packed = corpus_pipeline.run(spark, write_tables(spark, tmp_path, docs, labels, items)).collect()
    ids = {r["doc_id"] for r in packed}
    assert not ids & {3, 4, 5, 7, 8, 9}  # fewer than 50 words
    assert len(ids & {1, 2}) <= 1  # copies


def test_run_on_empty_tables(spark, tmp_path):
    docs = edge_docs(spark).where("false")
    folder = write_tables(spark, tmp_path, docs, labels_of(spark, []), spark.createDataFrame([], "item_id long, text string"))
    got = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "bin_id", "capacity"} <= set(got.columns) and got.collect() == []
