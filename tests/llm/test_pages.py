"""Junk of pages: what a host's votes take out and leave, against a plain vote."""

from collections import defaultdict

import pytest

from tessera.llm import html

BODY = "<p>The article of page {i} says quite a lot, so that it is by far the longest text of its page, whatever else stands there.</p>"


def read(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in html.extract(pages).collect()}


def article(i, more):
    return f"<body><article>{BODY.format(i=i)}{more}</article></body>"


def expected(i, *more):
    return "\n\n".join((BODY.format(i=i)[3:-4], *more))


@pytest.mark.parametrize("name", ["comment-body", "comment-thread", "user-comments-list", "discussion", "adsbygoogle", "promo-story", "sponsored", "replies"])
def test_comments_and_adverts_go(spark, name):
    rows = [(i, f"http://{name}.x/{i}" if i else None, article(i, f"<div class='{name}'><div>Said number {i} here</div></div>")) for i in range(4)]
    assert read(spark, rows) == {i: expected(i) for i in range(4)}


@pytest.mark.parametrize("name", ["notice", "legal", "share", "related-work", "ad-free", "no-comments"])
def test_text_of_an_article_stays_whatever_its_class(spark, name):
    rows = [(i, f"http://{name}.x/{i}" if i else None, article(i, f"<section class={name}><p>Part {i} of it</p></section>")) for i in range(4)]
    assert read(spark, rows) == {i: expected(i, f"Part {i} of it") for i in range(4)}


def test_what_repeats_or_only_links_goes(spark):
    same = [(i, f"http://same.x/{i}", article(i, "<p class=notice>We use cookies on this site</p>")) for i in range(4)]
    links = [(10 + i, f"http://links.x/{i}", article(i, f"<div class=share><a href=x>Send number {i}</a></div>")) for i in range(4)]
    outside = [(20 + i, f"http://outside.x/{i}", f"<body><div>{BODY.format(i=i)}<div class=notice>Closed on day {i}</div></div></body>") for i in range(4)]
    got = read(spark, same + links + outside)
    assert got == {r + i: expected(i) for r in (0, 10, 20) for i in range(4)}


def test_a_page_of_comments_keeps_them(spark):
    rows = [(i, f"http://talk.x/{i}", f"<body><div class=discussion><p>What number {i} had to say fills the page</p></div><p>Short {i}</p></body>") for i in range(3)]
    assert all(f"What number {i} had to say fills the page" in t for i, t in read(spark, rows).items())


def test_controls_inside_a_line_are_text_and_alone_are_none(spark):
    more = "<p>Press <button>now</button> or <label>later</label>.</p><div><button>Send</button> <label>Name</label></div><pre>x <span class=comment># not junk</span></pre><p>Read <span class=advert>buy</span>on.</p>"
    assert read(spark, [(1, None, article(1, more))]) == {1: expected(1, "Press now or later.", "x # not junk", "Read on.")}


def test_votes_equal_a_plain_vote(spark):
    words = ["share", "comments", "legal", "promo", "box", "notice"]
    rows = []
    for i in range(60):
        parts = [f"<div class='{words[(i * k + k) % 6]}'><p>{'Same' if k == 2 else f'Text {i} {k} ' * (1 + i % 7)}</p></div>" for k in range(1, 5)]
        shape = ("<article>{}</article>", "<div class=c{1}>{0}</div>", "<main><section>{}</section></main>")[i % 3]
        rows.append((i, (None, "http://a.x/", "http://b.x/", "http://b.x/")[i % 4], f"<body>{shape.format(''.join(parts) + BODY.format(i=i) * (i % 2), i)}</body>"))
    pages = {i: html.Page(h) for i, _, h in rows}
    boxes, suspects = defaultdict(lambda: defaultdict(int)), defaultdict(lambda: defaultdict(list))
    for i, url, _ in rows:
        scores = pages[i].scores()
        top = max(scores.values(), default=0)
        for number, s in scores.items():
            if s >= 0.1 * top:
                boxes[url][pages[i].path(number)] += round(1000 * s / top)
        for key, told in pages[i].suspects().items():
            suspects[url][key].append((*told, pages[i].whole()))
    for (i, text) in read(spark, rows).items():
        url = rows[i][1]
        if url is None:
            path, junk = None, {k for k, (c, l, _) in pages[i].suspects().items() if html.is_junk(k, 1, 1, c, l, pages[i].whole())}
        else:
            path = min(boxes[url], key=lambda p: (-boxes[url][p], p))
            junk = {k for k, v in suspects[url].items() if html.is_junk(k, len(v), len({x[2] for x in v}), *(sum(x[c] for x in v) for c in (0, 1, 3)))}
        assert text == pages[i].text(path, junk)
