import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from concord.llm import textarrays as ta
from concord.llm import trie_counts as tc
from tests.llm.helpers import edge_docs, with_clashes

PATH = public_tokenizers.path("piece_bpe_32k.model")
PIECES = tc.Pieces(PATH)


def brute(word):
    """Fewest pieces among all segmentations of the best score."""
    best = None
    for cut in range(1 << len(word) - 1):
        parts, begin = [], 0
        for i in range(1, len(word)):
            if cut >> i - 1 & 1:
                parts.append(word[begin:i])
                begin = i
        parts.append(word[begin:])
        s, n = 0.0, 0
        for p in parts:
            if p in PIECES.score:
                s, n = s + PIECES.score[p], n + 1
            elif len(p) == 1:
                raw = p.encode()
                s, n = s + sum(PIECES.byte[b] for b in raw), n + len(raw)
            else:
                break
        else:
            if best is None or s > best[0] + 1e-9 or abs(s - best[0]) <= 1e-9 and n < best[1]:
                best = (s, n)
    return best[1]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="thereinga日😀é,", max_size=8), max_size=12))
def test_trie_counts_match_all_segmentations(words):
    marked = sorted({tc.MARK + w for w in words})
    assert tc.trie_counts(PIECES, marked) == [brute(w) for w in marked]


def test_shared_prefixes_are_scored_once(monkeypatch):
    seen = []
    step = tc.Pieces.step
    monkeypatch.setattr(tc.Pieces, "step", lambda self, t, at, s, n: (seen.append(t[:at]), step(self, t, at, s, n))[1])
    words = sorted({tc.MARK + w for w in ["the", "then", "theory", "theories", "a"]})
    tc.trie_counts(PIECES, words)
    assert len(seen) == len(set(seen)) == len({w[:k] for w in words for k in range(1, len(w) + 1)})


def test_documents(spark):
    docs = edge_docs(spark)
    got = tc.token_counts(with_clashes(docs), PATH).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got:
        w = (texts[r["doc_id"]] or "").encode().split()
        if r["doc_id"] is not None and len(w) < 100:
            assert (r["n_pretokens"], r["n_tokens"]) == (len(w), sum(tc.trie_counts(PIECES, [tc.MARK + x.decode()])[0] for x in w))
    assert len(got) == docs.count() and tc.token_counts(docs.limit(0), PATH).count() == 0


def test_counts_do_not_depend_on_what_is_remembered(monkeypatch):
    texts = pa.array(["the then theory", "", None, "then the zebra " * 50])
    want = [tc.PieceCounter(PATH).block(d, o)[1].tolist() for _, _, d, o in ta.blocks(texts)]
    monkeypatch.setattr(tc, "REMEMBERED", 1)
    c = tc.PieceCounter(PATH)
    assert [c.block(d, o)[1].tolist() for _, _, d, o in ta.blocks(texts)] == want
    monkeypatch.setattr(ta.Words, "hashes", lambda self, which=0: self.start.astype("u8") * 0 if which == 0 else self.start.astype("u8"))
    assert [tc.PieceCounter(PATH).block(d, o)[1].tolist() for _, _, d, o in ta.blocks(texts)] == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é日\t\n\x0b\x1c", max_size=12)), max_size=8), st.integers(1, 30))
def test_words_of_blocks(texts, size):
    want = [(t or "").encode().split() for t in texts]
    got, seen = [None] * len(texts), {}
    for lo, hi, data, off in ta.blocks(pa.array(texts, pa.string()), size):
        w = ta.find_words(data, off)
        words = [data[a:b].tobytes() for a, b in zip(w.start, w.end)]
        for d in range(hi - lo):
            got[lo + d] = words[w.first[d]: w.first[d + 1]]
        for x, *h in zip(words, w.hashes(0), w.hashes(1)):
            assert seen.setdefault(x, h) == h
    assert got == want and len({tuple(h) for h in seen.values()}) == len(seen)
