import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from concord.llm import repair, tokens
from concord.llm import textarrays as ta
from concord.llm.common import run_folder
from tests.llm.helpers import edge_docs, with_clashes

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(texts):
    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), max_size=40), max_size=6), st.sampled_from([5, 49_408, 1 << 17]))
def test_shards_decode_to_what_was_written(docs, base):
    ids = np.array([x for d in docs for x in d] * 9, np.uint32)
    ends = np.cumsum([len(d) for d in docs] * 9).astype(np.int64)
    raw = repair.to_bytes([None if i % 4 == 3 else i for i in range(len(ends))], ids, ends, base)
    s = repair.Shard.open(raw)
    assert (s.all_ids() == ids).all() and s.doc_ids == [None if i % 4 == 3 else i for i in range(len(ends))]
    for d, (a, b) in enumerate(zip([0, *ends], ends)):
        if b > a:
            assert (s.document_ids(d) == ids[a:b]).all()
            assert (s.document_ids(d, 2, 5) == ids[a:b][2:5]).all()


def test_frequent_pairs_become_rules():
    ids = np.array([1, 2, 3, 1, 2, 3, 9] * 200, np.uint32)
    s = repair.Shard.open(repair.to_bytes([0], ids, np.array([len(ids)])))
    assert len(s.rules) and len(s.sym) < len(ids) / 4 and int(s.size[s.sym].sum()) == len(ids)


def test_ids_that_would_pass_for_rules_are_refused():
    for base in (5, 49_408):
        with pytest.raises(ValueError):
            repair.to_bytes([1], np.array([1, base], np.uint32), np.array([2]), base)


def test_words_that_skip_the_splitting_get_the_same_ids():
    e = tokens.WordEncoder(PATH)
    assert e.direct
    r = np.random.default_rng(3)
    letters = [*"abcdefghijklmnopqrstuvwxyz", *map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)])]
    words = ["".join(r.choice(letters, r.integers(1, 14))) for _ in range(3000)] + letters + ["It's", "don't", "A", "É", "ª", "x1", "日本", "ſ", "e\u0301", "ŉ", "<|endoftext|>"]
    assert e._ids(words) == [x.ids for x in e.tokenizer.encode_batch(words, add_special_tokens=False)]
    texts = [r2["text"] for r2 in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()]
    got = [i for _, _, d, o in ta.blocks(pa.array(texts)) for i in e.encode(d, o)[0].tolist()]
    assert got == [i for x in ids_of(texts) for i in x]


def test_rows_of_one_id_are_spread(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    docs = spark.range(4000).selectExpr("if(id % 3 = 0, null, 7) AS doc_id", "concat('word ', id) AS text").repartition(6)
    folder = run_folder(spark, "repair-spread")
    repair.write(docs, folder, PATH, shard_tokens=4000)
    got = repair.read(spark, folder)
    assert got.count() == 4000 and got.select("shard").distinct().count() >= 4
    starts = sorted((r["start"], r["n_tokens"]) for r in got.collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:])) and starts[0][0] == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    nulls = [r["start"] for r in got.where("doc_id IS NULL").collect()]
    assert max(nulls) < min(r["start"] for r in got.where("doc_id = 7").collect())


def test_rounds_go_on_until_no_pair_is_frequent():
    ids = np.zeros(1 << 22, np.uint32)  # halves in each round
    s = repair.Shard.open(repair.to_bytes([0], ids, np.array([len(ids)])))
    assert len(s.sym) <= 2 * repair.MIN_COUNT and (s.all_ids() == ids).all()


def test_word_by_word_encoding_is_the_librarys(monkeypatch):
    texts = ["it's <|endoftext|>x  y", "Ünï É é x́ ́a", "a \x1c b c d", "", None, "日本 語 ΣΑΣ ſ", " \t\n", "a" * 5000]
    e = tokens.WordEncoder(PATH)
    got = [(i.tolist(), n.tolist()) for _, _, d, o in ta.blocks(pa.array(texts)) for i, n in [e.encode(d, o)]]
    want = ids_of(texts)
    assert got == [([i for x in want for i in x], [len(x) for x in want])]
    assert e.counts(pa.array(texts)).tolist() == [len(x) for x in want]
    monkeypatch.setattr(ta.Words, "hashes", lambda self, which=0: np.zeros(len(self.start), np.uint64) if which == 0 else np.arange(len(self.start), dtype=np.uint64))
    e = tokens.WordEncoder(PATH)  # all hashes meet: texts are encoded whole
    assert e.counts(pa.array(texts)).tolist() == [len(x) for x in want]


def test_round_trip_of_edge_rows(spark):
    docs = edge_docs(spark)
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or ""))
    want, start = [], 0
    for r, ids in zip(rows, ids_of([r["text"] for r in rows])):
        ids = [*ids, 1]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    folder = run_folder(spark, "test")
    repair.write(with_clashes(docs), folder, PATH, shard_tokens=1000)
    got = repair.read(spark, folder)
    assert sorted((tuple(r)[:4] for r in got.collect()), key=lambda x: x[1]) == want
    assert got.select("shard").distinct().count() > 1
    assert repair.round_trip(docs.limit(0), PATH).count() == 0
