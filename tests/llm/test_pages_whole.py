"""Article text that must not go with the templates."""
import collections
import random

from relmon.llm import html_extract as H


def run(spark, bodies):
    pages = spark.createDataFrame([(i, f"http://h.example/{i}", b) for i, b in enumerate(bodies)], "page_id long, url string, html string")
    return [r.text for r in H.extract(pages).orderBy("page_id").collect()]


def test_copies_and_shared_passages_keep_their_text(spark):
    own = ["".join("abcdefghij"[int(c)] for c in f"{i:02d}") for i in range(12)]
    menu = "<div><ul><li>Home<li>News</ul></div>"
    passage = "<p>A passage that several pages share, and rather long.</p>"
    got = run(spark, 4 * ["<article><div><p>Same article</p></div></article>"] + 4 * ["<article><div>bare copy</div></article>"]
              + [f"<article><div><p>{o}</p></div><section>{passage}</section><div>Share this</div></article>" for o in own])
    assert got[:8] == 4 * ["Same article"] + 4 * ["bare copy"]
    assert got[8] == f"{own[0]}\nA passage that several pages share, and rather long."
    got = run(spark, [f"{menu}<div><p>Copied text of one page</p></div><div>{o}</div>" for o in own[:4]]
              + [f"{menu}<div><p>Own {o}</p>{passage}</div>" for o in own])
    assert got[0] == f"Copied text of one page\n{own[0]}"
    assert got[5] == f"Own {own[1]}\nA passage that several pages share, and rather long."


def test_names_of_pages_articles_and_parts_of_tokens_drop_nothing():
    text = "<p>All of the text of this page.</p>"
    want = "All of the text of this page."
    assert H.main_text(f"<body class='has-sidebar sidebar'>{text}</body>") == want
    assert H.main_text(f"<article class='post comments-open'>{text}</article>") == want
    assert H.main_text(f"<article class='social'>{text}</article><div>x</div>") == want
    assert H.main_text(f"<main class='sidebar with-sidebar'>{text}</main>") == want
    assert H.main_text(f"<article>{text}<section class='social-policy'><p>Policy</p></section></article>") == f"{want}\nPolicy"
    assert H.main_text(f"<div class=menu>{text}</div><div>x</div>") == f"{want}\nx"
    assert H.main_text(f"<article>{text}<div class='x social-share'>go</div></article><article class=comment>me</article>") == want


def test_templates_of_a_part_of_a_large_host_go(spark):
    own = ["".join("abcdefghij"[int(c)] for c in f"{i:03d}") for i in range(500)]
    got = run(spark, [f"<article>{'<div>Section notice</div>' if i < 40 else ''}{'<div>A few</div>' if i > 490 else ''}<p>{o}</p></article>"
                      for i, o in enumerate(own)])
    assert got[0] == own[0] and got[39] == own[39] and got[495] == f"A few\n{own[495]}"


def test_blocks_with_text_of_their_own_go_by_recurring_structure(spark):
    """Comments, sidebars, adverts and notices whatever their names' spelling, and however long; one of a kind stays."""
    own = ["".join("abcdefghij"[int(c)] for c in f"{i:02d}") for i in range(12)]
    extra = ["<div class='comment-list'><p>{0} says {1}</p><p>and {2}</p></div>", "<section id='comments-section'><p>{1} {2} {0}</p></section>",
             "<div class='site-sidebar'><p>See {2}</p></div>", "<div class='ad-banner'>Buy {1}</div>", "<div id='cookie-banner-7'>We use {2}</div>",
             "<ul class='related-posts'><li>{0}</li></ul>", "<section class='comments'>" + "<p>Readers talk much more than {0} writes, {1}, {2}.</p>" * 9 + "</section>"]
    pages = [f"<main><article><p>Text of {o}</p></article>" + "".join(e.format(o, o * 2, o * 3) for e in extra) + "</main>" for o in own]
    lone = "<article><p>Alone</p><section class='social-policy'><p>A policy</p></section></article>"
    got = run(spark, [*pages, lone])
    assert got[:12] == [f"Text of {o}" for o in own]
    assert got[12] == "Alone\nA policy"
    # without the counts of the host the result is another
    assert all(H.main_text(p) != f"Text of {o}" for p, o in zip(pages, own))


def test_names_on_wrappers_of_the_article_drop_nothing(spark):
    own = ["".join("abcdefghij"[int(c)] for c in f"{i:02d}") for i in range(8)]
    got = run(spark, [f"<body class='with-sidebar'><div class='no-ads-layout'><article class='post-comments-open'><p>Text {o}</p></article></div></body>" for o in own])
    assert got == [f"Text {o}" for o in own]


def test_template_counts_against_brute_force(spark):
    """Hashes that recur on enough different pages of a host, counted in plain Python."""
    rnd = random.Random(3)
    blocks = ["<div class='x'>notice {a}</div>", "<ul><li>Home</li></ul>", "<div class='comment-{b}'>said {c}</div>", "<section><p>{c}</p></section>", "<div>{c}</div>"]
    rows = []
    for i in range(90):
        body = "".join(rnd.choice(blocks).format(a=rnd.randrange(3), b="ab"[i % 2], c=rnd.randrange(10 ** 6)) for _ in range(4))
        rows.append((i, f"http://h{i % 4 if i < 60 else 4}.example/{i}", f"<article><p>own {i % 70}</p>{body}</article>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {i: H.candidates(h) for i, _, h in rows}
    host = {i: u.split("/")[2] for i, u, _ in rows}
    support, mains = collections.defaultdict(set), collections.defaultdict(set)
    first = {}
    for i, _, _ in rows:
        key, hs = found[i]
        mains[host[i]].add(key)
        first[host[i], key] = min(first.get((host[i], key), hs), hs)
    for (h, key), hs in first.items():
        for x in hs:
            support[h, x].add(key)
    often = {(h, x) for (h, x), k in support.items() if len(k) >= 3 and len(k) >= min(0.1 * len(mains[h]), 30)}
    want = {i: {x for x in found[i][1] if (host[i], x) in often} for i in found}
    got = {r.page_id: set(r.gone) for r in H.template_hashes(pages).collect()}
    assert got == {i: g for i, g in want.items() if g} and got
    texts = {r.page_id: r.text for r in H.extract(pages).collect()}
    assert texts == {i: H.main_text(h, want[i]) for i, _, h in rows}
