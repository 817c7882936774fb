"""Pages on which marks, density, links and neighbours disagree."""

import time

import numpy as np

from verdictflow.llm import html_extract

SF_DIR = "/root/testdata/sf0.01"

BODY = [f"Paragraph {i} of the body tells at some length what happened there, and why nobody in the town had seen it coming." for i in range(4)]
TEASERS = [f'<article><h3><a href="/{i}">Another story {i}</a></h3><p>In short. <a href="/{i}">Read more</a></p></article>' for i in range(5)]


def paragraphs(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def test_body_in_a_div_beside_teaser_articles():
    page = f"<body><nav><ul><li><a href=/>Home</a></ul></nav><div><h1>What happened</h1>{paragraphs(BODY)}</div>{''.join(TEASERS)}<footer>&copy; x</footer></body>"
    assert html_extract.extract(page).split("\n") == ["What happened", *BODY]


def test_unmarked_links_in_an_article():
    links = "".join(f'<li><a href="/{i}">More of this {i}</a></li>' for i in range(5))
    page = f"<article><h1>What happened</h1>{paragraphs(BODY[:2])}<div><ul>{links}</ul></div>{paragraphs(BODY[2:])}</article>"
    assert html_extract.extract(page).split("\n") == ["What happened", *BODY]


def test_neighbours_decide():
    """The same linked line stays between paragraphs and goes where it stands between links, both inside an article."""
    line = '<p>See <a href="/x">the whole report of it</a></p>'
    alone = html_extract.blocks_of(f"<article>{paragraphs(BODY[:1])}{line}{paragraphs(BODY[1:])}</article>")
    s, edges = html_extract.scores(alone), html_extract.smoothness(alone)
    assert abs(s[1]) < sum(c for e, c in edges.items() if 1 in e)  # not settled by its own score
    assert html_extract.minimum_cut(s, edges)[1]
    links = "".join(f'<p><a href="/{i}">Link {i}</a></p>' for i in range(2))
    assert "whole report" not in html_extract.extract(f"<article>{paragraphs(BODY)}<div>{links}{line}{links}</div></article>")


def test_plain_articles_and_marks_keep_their_sides():
    page = f'<nav><a href=/>Home</a></nav><div class="ad">{BODY[0]}</div><article><h1>Title</h1><p>In.<p>{BODY[1]}<ul><li>a<li>b</ul><aside><p>{BODY[2]}</p></aside></article><footer>{BODY[3]}</footer>'
    assert html_extract.extract(page).split("\n") == ["Title", "In.", BODY[1], "a", "b"]


def brute_cut(score, edges):
    """The labels of least cost of all 2 ** n, the fewest blocks dropped among equals."""
    n = len(score)
    kept = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
    s = np.array(score)
    cost = np.where(kept == 1, np.maximum(-s, 0), np.maximum(s, 0)).sum(1)
    for (i, j), c in edges.items():
        cost += c * (kept[:, i] != kept[:, j])
    least = np.flatnonzero(cost < cost.min() + 1e-9)
    return kept[least[np.argmax(kept[least].sum(1))]].astype(bool).tolist()


def test_query_agrees_with_brute_force_on_real_pages(spark, monkeypatch):
    """Texts of op8 against a cut found by trying all labels; and how often the flow and the edges mattered."""
    got = {r.page_id: r.text for r in html_extract.op8_html(spark, SF_DIR).collect()}
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()
    assert set(got) == {r.page_id for r in pages}
    flows, cut = [], html_extract.Flow.cut
    monkeypatch.setattr(html_extract.Flow, "cut", lambda self: flows.append(1) or cut(self))
    tried = differ = 0
    for r in pages:
        blocks = html_extract.blocks_of(r.html or "")
        score, edges = html_extract.scores(blocks), html_extract.smoothness(blocks)
        label = html_extract.minimum_cut(score, edges)
        differ += sum(k != (s > 0) for k, s in zip(label, score, strict=True))
        if 0 < len(blocks) <= 15 and tried < 60:
            tried += 1
            assert got[r.page_id] == "\n".join(b.text for b, k in zip(blocks, brute_cut(score, edges), strict=True) if k)
    assert tried > 10 and len(flows) > 0.7 * len(pages) and differ > 0


def test_edges_decide_for_short_lines_and_not_for_adverts():
    long = "A sentence of the article that has quite a few words in it, so that it stands by itself."
    line = "<div>Why</div><p>"
    advert = f'<div class="ad">{long}</div>'
    page = f"<body><nav><a href=/>Home</a></nav><article><h1>Title of it</h1><p>{long}<p>{long}{line}{long}{advert}<p>{long}</article><div class=comments><p>{long}<p>{long}</div></body>"
    blocks = html_extract.blocks_of(page)
    score = html_extract.scores(blocks)
    why = next(i for i, b in enumerate(blocks) if b.text == "Why")
    assert score[why] < 0
    assert html_extract.extract(page) == "\n".join(["Title of it", long, long, "Why", long, long])


def test_hostile_nesting_takes_linear_time():
    for kind in ("</b>", "<i><p>", "<li><ul>", "</p><p>x."):
        started = time.perf_counter()
        html_extract.extract("<div><b>" * 20_000 + kind * 20_000)
        assert time.perf_counter() - started < 5, kind
