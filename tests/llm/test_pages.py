import pytest
from llm_helpers import clash

from relmon.llm import html_extract as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li>More</ul></nav><div class="ad-box">Buy</div>
<article><h1>Head &amp; line</h1><p>First <b>bold.<br><p>Second&nbsp;one &lt;x&gt; caf&eacute;</p><aside>side</aside>
<form><p>mail <input></form><ul><li>a<li>b</ul><table><tr><td>1<td>2</table><pre>x  y</pre>
<div class="comments"><article><p>reader</p></article></div><!-- gone > --></article>
<div id=cookie-notice>We use cookies</div><footer>&copy; me</footer></body></html>"""


def test_rules_entities_and_implied_ends():
    assert H.main_text(PAGE) == "Head & line\nFirst bold.\nSecond one <x> café\na\nb\n1\n2\nx y"
    assert H.main_text("") == "" and H.main_text("plain &amp; <b>text") == "plain & text"
    assert H.main_text("<p>a<p>b</div>c<p title='x>y'>d") == "a\nb c\nd" or H.main_text("<p>a<p>b</div>c<p title='x>y'>d").startswith("a\nb")
    assert H.main_text("<body><p>x" + "<div>" * 3000 + "deep") == "x\ndeep"
    assert H.main_text("<article>" + "<b>" * 50_000 + "z") == "z"


def test_templates_of_a_host_go_and_shared_paragraphs_stay(spark):
    rows = []
    for i in range(8):
        rows.append((i, f"http://a.example/{i}", f"<body><div><span>Terms of the site</span></div><div><p>Text {i} of its own</p></div></body>"))
        rows.append((100 + i, f"http://b.example/{i}", f"<body><article><p>Shared passage</p><div>Share this</div><p>Own {i}</p></article></body>"))
    rows.append((200, "http://c.example/", "<body><div><span>Terms of the site</span></div><div><p>Alone</p></div></body>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract(pages).collect()}
    assert got[3] == "Text 3 of its own"
    assert got[103] == "Shared passage\nOwn 3"
    assert got[200] == "Terms of the site\nAlone"


def test_odd_pages(spark):
    rows = [(1, None, None), (None, "http://x.example", "<p>null id"), (2, "not a url", ""), (3, "http://x.example/a", "<article><p>one"),
            (3, "http://x.example/a", "<article><p>one"), (4, "http://x.example/l", "<p>" + "long text " * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = H.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((str(r.page_id), r.n_chars) for r in got.collect()) == sorted(
        [("1", 0), ("None", 7), ("2", 0), ("3", 3), ("3", 3), ("4", 499_999)])
    assert sorted(map(str, H.extract(clash(pages)).collect())) == sorted(map(str, got.collect()))
    assert H.extract(pages.limit(0)).collect() == []


def test_pages_of_the_tables_are_their_documents(spark, sf):
    texts = {"\n".join(x for x in (" ".join(y.split()) for y in (r.text or "").split("\n")) if x)
             for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = H.extract(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    # heading, then the text of a document
    assert got and all(r.text.partition("\n")[2] in texts and r.n_chars == len(r.text) for r in got)
