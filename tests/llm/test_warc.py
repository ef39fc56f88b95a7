import base64
import gzip
import hashlib
import random
import re
import time

import pytest

from concord.llm import warc
from concord.llm.common import run_folder
from tests.llm.helpers import with_clashes

PAGE = """<!DOCTYPE html><html lang="fr"><head><title>A &amp; B</title><style>p{}</style></head><body>
<!-- hidden --><script>var t="</p>";</script><nav><a href="/x?a=1&amp;b=2">X</a></nav><h1>Head</h1><p>One <b>bold</b>&nbsp;word,<br>two &eacute; &#8364;<p>Three<a href='y'>y</a></body></html>"""


def test_text_of_a_page():
    assert warc.page_text(PAGE) == "X\nHead\nOne bold word,\ntwo é €\nThreey"
    assert warc.page_text("") == "" and warc.page_text("a < b & c") == "a < b & c"
    assert warc.page_text("<p>open<script>never closed") == "open"


def plain_text_and_links(page):
    """Character by character, by the rules of the docstrings."""
    text, links, i, low = [], [], 0, page.lower()
    while i < len(page):
        if low.startswith("<!--", i):
            j = low.find("-->", i + 4)
            text.append(" ")
            i = len(page) if j < 0 else j + 3
        elif page[i] == "<" and i + 1 < len(page) and (page[i + 1] in "!?" or re.match("/?[a-z]", low[i + 1:i + 3])) and ">" in page[i:]:
            j = page.index(">", i)
            name = (re.match(r"/?([a-z]\w*)", low[i + 1:j]) or [None, ""])[1]
            i2 = j + 1
            if not name:
                text.append(" ")
            elif name in warc._HIDDEN and page[i + 1] != "/":
                m = re.search(rf"</{name}\s*>", low[i2:])
                text.append(" ")
                i2 = i2 + m.end() if m else len(page)
            elif name in warc._BLOCKS:
                text.append("\n")
            elif name == "a" and page[i + 1] != "/" and (m := re.match(r"[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", page[i + 2:], re.I)):
                links.append(m[1] or m[2] or m[3] or "")
            i = i2
        else:
            text.append(page[i])
            i += 1
    return "".join(text), links


def test_the_scanner_equals_a_plain_reading():
    r = random.Random(7)
    bits = ["<p>", "</p>", "<a href=x>", "<A HREF='y z'>", "</a>", "<!-- ", "-->", "<script>", "</script >", "<style x", "<", ">", "text ", "&amp;", "<?php ", "<b>", "a<b",
            "<title>t", "</title>", "<head>", "</head>", "\n", "<!DOCTYPE html>", "<pre-x>", "</", "<svg/>", 'href="', "<a\nhref=\"q>r\">"]
    for _ in range(4000):
        page = "".join(r.choice(bits) for _ in range(r.randint(0, 12)))
        assert warc.scan(page) == plain_text_and_links(page), page


@pytest.mark.parametrize("piece", ["<a", "<title>", "<script", "<script>", "<!--", "<html ", "<html lang", "</", "<a href=\"", "<a href='x>", "<p ", "&", "</script ", "<title>x</title "])
def test_broken_markup_takes_time_in_proportion(piece):
    page = piece * (10_000_000 // len(piece) // (1 if piece == "<a" else 4))
    t = time.process_time()
    warc.derive(record(page.encode()))
    assert time.process_time() - t < 8


def test_damaged_files_give_their_whole_records():
    one = lambda i: warc.to_bytes(record(b"block %d" % i, id=f"<urn:{i}>"))
    ids = lambda data: [r["id"] for r in warc.from_bytes(data)]
    assert ids(one(1) + one(2)[:-12]) == ["<urn:1>"]  # cut within its block
    assert ids(one(1) + one(2)[:20]) == ["<urn:1>"]  # cut within its header
    assert ids(one(1).replace(b"Content-Length: 7", b"Content-Length: x") + one(2)) == ["<urn:2>"]
    assert ids(one(1).replace(b"Content-Length: 7", b"X: 7") + one(2)) == ["<urn:2>"]
    zipped = [gzip.compress(one(i)) for i in range(3)]
    assert ids(b"".join(zipped)) == ["<urn:0>", "<urn:1>", "<urn:2>"]
    assert ids(b"".join(zipped)[:-30]) == ["<urn:0>", "<urn:1>"] and ids(zipped[0] + b"junk") == ["<urn:0>"]
    assert ids(b"") == ids(b"no records") == []


def record(block, **more):
    return {"type": "response", "id": "<urn:uuid:1>", "target": "http://a/", "date": "2024-01-01T00:00:00Z", "headers": [], "block": block, **more}


def test_links_headers_and_digests():
    body = PAGE.encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Long: a\r\n b\r\n\r\n" + body
    claimed = "sha256:" + base64.b32encode(hashlib.sha256(body).digest()).decode().rstrip("=")
    meta, conv = warc.derive(record(block, headers=[{"name": "WARC-Payload-Digest", "value": claimed}]))
    named = {h["name"]: h["value"] for h in conv["headers"]}
    assert conv["type"] == "conversion" and conv["block"].decode() == warc.page_text(PAGE)
    assert named["WARC-Refers-To"] == "<urn:uuid:1>" and named["WARC-Source-Payload-Digest"] == claimed
    assert named["WARC-Block-Digest"] == named["WARC-Payload-Digest"] == warc.digest(conv["block"])
    fields = [x.split(": ", 1) for x in meta["block"].decode().split("\r\n") if x]
    assert ["http-X-Long", "a b"] in fields and ["payload-digest-valid", "true"] in fields and ["conversion", conv["id"]] in fields
    assert [v for k, v in fields if k == "outlink"] == ["/x?a=1&b=2", "y"] and ["title", "A & B"] in fields and ["language", "fr"] in fields
    assert warc.derive(record(block)) [0]["id"] == meta["id"] != conv["id"]


def test_awkward_records():
    assert warc.derive(record(b"x", type="request")) == [] and warc.derive(record(b"x", type=None)) == []
    for block in (None, b"", b"HTTP/1.1 404 Not\r\n\r\n", b"<p>no http</p>", b"\xff\xfe\x00"):
        meta, conv = warc.derive(record(block, id=None, target=None, date=None, headers=None))
        assert meta["id"] != conv["id"] and all(h["value"] for h in conv["headers"])
    assert warc.derive(record(b"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=latin-1\r\n\r\n<p>\xe9"))[1]["block"].decode() == "é"


def pages(spark):
    rows = [(1, "http://a/", PAGE), (2, None, "<p>x" * 20_000), (3, "http://b/", None), (None, "http://c/", ""), (1, "http://a/", PAGE)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_pages(spark):
    got = warc.page_derivatives(with_clashes(pages(spark))).collect()
    assert len(got) == 10
    conv = [r for r in got if r["record_type"] == "conversion"]
    assert sorted(len(r["content"].encode()) for r in conv) == sorted(r["content_length"] for r in conv)
    source = {r["page_id"]: r for r in warc.responses(pages(spark)).collect()}
    assert all(r["refers_to"] == source[r["page_id"]]["id"] for r in got)
    body = (PAGE).encode()
    assert {r["source_payload_digest"] for r in got if r["page_id"] == 1} == {warc.digest(body)}
    assert warc.page_derivatives(pages(spark).limit(0)).count() == 0


def test_files_round_trip(spark):
    derived = warc.derivatives(warc.responses(pages(spark)))
    folder = run_folder(spark, "warc")
    files = warc.write_files(derived, folder, file_bytes=500).collect()
    assert sum(f["n_records"] for f in files) == 10
    key = lambda r: (r["type"], r["id"], r["target"], r["date"], bytes(r["block"]), [(h["name"], h["value"]) for h in r["headers"]])
    assert sorted(map(key, warc.read_files(spark, folder).collect()), key=repr) == sorted(map(key, derived.collect()), key=repr)
    plain = b"".join(warc.to_bytes(r.asDict(recursive=True)) for r in derived.collect())
    assert len(warc.from_bytes(plain)) == 10
