import hashlib

import numpy as np

from echofind.llm import html_blocks, warc_store

SCHEMA = "page_id long, url string, html string, sha256 string, text string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><div class="logo">Site</div></header><nav><ul><li><a href=/>Home</a></li><li><a href=/x>More</a></ul></nav>
<div class="cookie-notice">We use cookies.</div><div class="ad">Buy this thing now.</div>
<article><h1>Head &amp; title</h1><p>First <b>para</b> with a <a href=y>link</a>,\n  and&nbsp;space.<p>Second<br>line &lt;x&gt; &#233;
<div class="comments"><p>Nice one, I like it a lot and said so at length.</p></div><form><label>Name</label></form></article>
<aside>Side text of some length</aside><!-- gone --><footer>&copy; Site</footer></body></html>"""


def test_extraction(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<p>only</p>"), (4, "u", "<article><p>cut of"), (4, "u", "<article><p>cut of"), (5, "u", "no markup at all, just words in a row"), (6, "u", "<article>" + "<p>many words here</p>" * 30_000)]
    out = html_blocks.extracted(pages(spark, rows))
    assert out.count() == len(rows)
    got = {r.page_id: r for r in out.collect()}
    assert got[1].text == "Head & title\nFirst para with a link, and space.\nSecond\nline <x> é"
    assert got[2].text == got[3].text == "" and got[2].url is None and got[4].text == "cut of"
    assert got[6].text.count("\n") == 29_999 and all(r.n_chars == len(r.text) for r in got.values())
    assert html_blocks.extracted(pages(spark, [])).count() == 0


def test_odd_markup():
    tree = html_blocks.default_tree()
    for source in ("<", "<p", "<p a='", "</", "<!--", "<!", "&", "&#x110000;", "<script>x", "<a><a><b></p></p>", "<p>" * 5000, "<div>" * 3000 + "x", "\x00<p>\x00"):
        html_blocks.main_text(source, tree)
    assert html_blocks.main_text("<main><p>a<script>b</script>c</p></main>", tree) == "a\nc"


def test_tree_on_held_out_blocks():
    x, y = html_blocks.labelled(80, 99)
    assert (html_blocks.default_tree()(x) == y).mean() > 0.9
    flat = html_blocks.Tree(np.zeros((5, 3)), np.array([True, True, False, True, True]))
    assert flat(np.zeros((2, 3))).all()


def test_archive(spark, tmp_path):
    long = "x" * 1000
    rows = [(1, "http://a", long), (2, "http://b\r\nX: y", long), (3, None, long), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", "é" * 600), (None, "u", long), (8, "u", "é" * 600), (8, "u", "é" * 600)]
    for name, given in (("a", rows), ("b", rows[:7])):
        path = f"file://{tmp_path}/{name}"
        warc_store.write_archive(pages(spark, given), path)
        got = warc_store.read_archive(spark, path).collect()
        assert len(got) == len(given)
        texts = {}
        for d, _, h in given:
            texts.setdefault(h or "", []).append(d)
        for r in got:
            text = r.payload.decode()
            holder = max(d for d in texts[text] if d is not None)
            first = len(text.encode()) < 1000 or r.page_id == holder
            assert (r.record_type, r.refers_to) == (("response", None) if first else ("revisit", holder))
            assert r.payload_digest == hashlib.sha1(r.payload).hexdigest() and r.payload_bytes == len(r.payload)
        assert spark.read.parquet(f"{path}/payloads").count() == len(texts)
    warc_store.export_warc(warc_store.read_archive(spark, path), f"file://{tmp_path}/warc")
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "warc").glob("part-*")))
    seen = 0
    while raw:
        head, raw = raw.split(b"\r\n\r\n", 1)
        size = int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"])
        assert head.startswith(b"WARC/1.1\r\n") and raw[size : size + 4] == b"\r\n\r\n"
        raw, seen = raw[size + 4 :], seen + 1
    assert seen == 7
    warc_store.write_archive(pages(spark, []), f"file://{tmp_path}/none")
    assert warc_store.read_archive(spark, f"file://{tmp_path}/none").count() == 0


def test_unclosed_elements_and_class_names():
    tree = html_blocks.default_tree()
    para = " ".join(f"word{k}" for k in range(60))
    text = lambda source: html_blocks.main_text(source, tree)
    for name in ("svg", "object", "iframe", "canvas", "math", "template", "noscript", "audio", "video"):
        assert text(f"<article><p>one<{name}><p>{para}<p>two</article>") == f"one\n{para}\ntwo", name
        assert text(f"<article><p>one<{name}>gone</{name}><p>two</article>") == "one\ntwo", name
        assert text(f"<article><p>one<{name}>a</article><p>{para}</p><{name}>gone</{name}>") == f"one\na\n{para}", name
    assert text(f"<article><p>one</p><script>x<p>{para}") == "one"
    for names in ("text-widget story-social", "widget", "legal", "related", "tags share"):
        assert text(f'<div class="{names}"><p>{para}</p></div>') == para, names
    assert text(f'<article><p>{para}</p><div class="comments"><p>{para} too</p></div></article>') == para


def test_string_ids(spark, tmp_path):
    rows = [("a b", "u", "x" * 1000), ("c", "u", "x" * 1000), ("c\nd", "u", "y")]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    warc_store.write_archive(df, f"file://{tmp_path}/s")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc_store.read_archive(spark, f"file://{tmp_path}/s", "string").collect()}
    assert got["a b"] == ("revisit", "c") and got["c"] == ("response", None) and len(got) == 3
