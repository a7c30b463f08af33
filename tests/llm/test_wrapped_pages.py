"""Main text does not depend on how long its longest part is."""

import time

import pytest

from rayframe.llm import html_text


@pytest.mark.parametrize("n", [1, 5, 40, 400])
def test_wrapped_bodies(n):
    prose = [f"Paragraph {i} of the story, long enough, with commas, and with words that go on." for i in range(n)]
    long = "<div>" + "".join(f"<p>{p}</p>" for p in prose) + "</div>"
    rest = "<div><p>A short section, of its own.</p></div><ul><li>one item</li></ul><p>Short end, with few words.</p>"
    tail = ["A short section, of its own.", "one item", "Short end, with few words."]
    around = "<nav><a href=x>Home</a></nav>{}<footer>Imprint</footer>"
    for open_, close in (("<article>", "</article>"), ("<main>", "</main>"), ("<div class=content>", "</div>"), ("<div>", "</div>")):
        page = around.format(f"{open_}<h1>Title</h1>{long}{rest}<div class=sidebar><p>Elsewhere, a long text, with commas, too.</p></div>{close}")
        assert html_text.main_text(page) == "\n".join(["Title", *prose, *tail])


PROSE = ["The council met on Tuesday, as planned, and agreed on the new bridge, after a long debate.", "Work begins in spring, said the mayor, and will take two years, if the money lasts.", "Some neighbours, who fear the noise, want a tunnel instead."]
ARTICLE = "<h1>A bridge</h1>" + "".join(f"<p>{p}</p>" for p in PROSE)
SIDE = "<div class='sidebar'><p>Elsewhere, a long text, in a side bar, which is no part of it.</p></div><div class='comments'>" + "<p>I think, as a reader, that this is wrong, and I say so at length, again and again.</p>" * 30 + "</div>"


@pytest.mark.parametrize("label", ["layout sidebar-right", "page nav-fixed", "wrap header-sticky", "site header-dark", "col-main related-open", "comments-open", "nav-fixed"])
def test_wrappers_by_misleading_names(label):
    """A whole page is not lost to the name of the element around it."""
    want = "\n".join(["A bridge", *PROSE])
    for inner in (ARTICLE, ARTICLE + SIDE, f"<article>{ARTICLE}</article>{SIDE}", f"<div class=content>{ARTICLE}</div>"):
        page = f"<body><nav><a href=/>Home</a></nav><div class='{label}'>{inner}</div><footer>Imprint</footer></body>"
        assert html_text.main_text(page) == want
    assert html_text.main_text(f"<form id=all>{ARTICLE}<form><input><label>Name</label></form></form>") == want


def test_parts_by_name_go():
    page = f"<div class=page><article>{ARTICLE}<form><p>Your address, please, and your name, for the newsletter.</p></form></article>{SIDE}<div class='related'><p>More of this kind, elsewhere, for you.</p></div><div id='cookie-notice'>We use cookies, as all do.</div></div>"
    assert html_text.main_text(page) == "\n".join(["A bridge", *PROSE])


def test_deep_pages_take_time_by_length():
    import time

    for n, tag in ((4000, "div"), (4000, "span"), (4000, "li"), (2000, "p><b")):
        start = time.perf_counter()
        text = html_text.main_text(f"<{tag}>" * n + "Some prose, long enough to count, at the bottom." + "</i></em>" * n)
        assert time.perf_counter() - start < 0.25 and text == "Some prose, long enough to count, at the bottom."


def plain_score(html_page):
    """The containers' scores by walking up from every block, as the method is worded."""
    nodes = html_text.tree(html_page)
    gone = html_text.left_out(nodes)
    score = dict.fromkeys(range(len(nodes)), 0.0)
    for owner, t, _ in html_text.blocks(nodes, gone):
        if len(t) >= 25:
            up, share = owner.parent if owner.name in html_text.PARAGRAPH and owner.parent else owner, 1.0
            while up is not None:
                score[up.at] += share * (1 + t.count(",") + min(len(t) / 100, 3))
                up, share = up.parent, share / 2
    return nodes, score


def test_best_container_by_hand(spark):
    """Of every page, what is kept holds the container with the highest score that is not discounted for links."""
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(60).collect():
        nodes, score = plain_score(r.html)
        best = max((n for n in nodes if score[n.at] and n.name in ("article", "main", "div", "section")), key=lambda n: score[n.at] * 1.25 + 25 if html_text.likely(n) else score[n.at], default=None)
        text = html_text.main_text(r.html)
        if best is not None:
            own = [" ".join("".join(c for c in p.children if isinstance(c, str)).split()) for p in nodes if p.parent is best and p.name == "p" and all(isinstance(c, str) for c in p.children)]
            assert all(x in text for x in own)


STORY = "".join(f"<p>The {w} of the valley kept their ledgers, their lamps and their silence, and wrote down every load of coal.</p>" for w in ("miners", "drivers", "keepers", "clerks"))
TEXT = "\n".join(f"The {w} of the valley kept their ledgers, their lamps and their silence, and wrote down every load of coal." for w in ("miners", "drivers", "keepers", "clerks"))


@pytest.mark.parametrize(
    "wrap",
    [
        '<article aria-label="The hidden cost of coal">{}</article>', '<div data-title="a hidden gem">{}</div>', "<div title='display : none'>{}</div>", '<div class="page-comments-template">{}</div>',
        '<div class="wp-respond">{}</div>', '<div class="comments"><div id="respond">{}</div></div>', '<div data-hidden="hidden" aria-hidden="false">{}</div>', "<div data-x=hidden>{}</div>",
    ],
)
def test_no_article_is_lost(wrap):
    page = "<html><body><nav><a href=/>home</a></nav>" + wrap.format("<h1>Coal</h1>" + STORY) + "<footer>imprint</footer></body></html>"
    assert html_text.main_text(page) == "Coal\n" + TEXT


@pytest.mark.parametrize("off", ["hidden", "hidden=''", "HIDDEN", "aria-hidden=true", 'aria-hidden = "TRUE"', 'style="color:red; display : none"', "style='visibility:hidden'"])
def test_hidden_goes(off):
    assert html_text.main_text(f"<body><h1>Coal</h1>{STORY}<div {off}><p>{'unseen words, ' * 30}</p></div></body>") == "Coal\n" + TEXT


@pytest.mark.parametrize("title", ["<h2>12 comments</h2>", "<h3>Leave a reply</h3>", "<p>Readers</p>"])
def test_comments_go(title):
    """However long they are, and whether or not the article has a heading."""
    remarks = f"<section class=comments>{title}" + "<p>I was there, and I saw it, and it was not so at all, whatever they say.</p>" * 60 + "</section>"
    assert html_text.main_text(f"<body><article><h1>Coal</h1>{STORY}</article>{remarks}</body>") == "Coal\n" + TEXT
    assert html_text.main_text(f"<body><article>{STORY}</article>{remarks}</body>") == TEXT


@pytest.mark.parametrize(
    "page",
    [
        "<ul>" + "<div>" * 8000 + "<li>x" * 8000, "<p><td>" + "<b>" * 8000 + "<div>y" * 8000, "<script>" + "</script" * 32000, "<dl>" + "<b>" * 8000 + "<dt>t<dd>d" * 8000, "<table>" + "<tr><td><b>" * 8000,
        "<div class=comments>" * 8000 + "z", "<a " + "b " * 8000 + ">", "<a" + " " * 30000 + "x>", "<i " * 8000, "</b" * 8000, "<select>" + "<i>" * 8000 + "<option>" * 8000,
    ],
    ids=range(11),
)
def test_hostile_pages(page):
    """Time grows with the length: sixteen times in a row takes no more than some sixty times as long."""
    began = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - began < 1.5


def test_tags_that_end_others():
    """Open elements by name end as a walk up the tree would end them."""
    cases = {
        "<ul><li>a<ul><li>b<li>c</ul><li>d</ul>": "a\nb\nc\nd",
        "<table><tr><td>a<table><tr><td>b<td>c</table><td>d<tr><td>e</table>": "a\nb\nc\nd\ne",
        "<dl><dt>a<dd>b<dl><dt>c</dl><dt>d</dl>": "a\nb\nc\nd",
    }
    for html, want in cases.items():
        nodes = html_text.tree(html)
        assert "\n".join(t for _, t, _ in html_text.blocks(nodes, [False] * len(nodes))) == want
    top = html_text.tree("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>")
    assert [n.depth for n in top if n.name == "li"] == [2, 4, 4, 2]
    rows = html_text.tree("<table><tr><td>a<td>b<tr><td>c</table>")
    assert [(n.name, n.depth) for n in rows if n.name in ("tr", "td")] == [("tr", 2), ("td", 3), ("td", 3), ("tr", 2), ("td", 3)]
