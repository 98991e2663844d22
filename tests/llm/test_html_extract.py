"""HTML extraction: parsing rules, site templates, defined cases."""

import random
import time
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest

from sphaera.llm import html_extract as m

SCHEMA = "page_id bigint, url string, html string, host string, text string, n string"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("plain  text\n&amp; more", "plain text & more"),
        ("<article><h1>A</h1><p>b<b>o</b>ld <i>x</i><p>c</article><footer>f</footer>", "A bold x c"),
        ("<p>one<br>two</p><script>var t='</p>';</script><style>p{}</style>three", "one two three"),
        ("<nav>menu</nav><main>in &lt;b&gt; &#233;</main>out", "in <b> é"),
        ("<article>a<!-- hidden --><div class='ad'>buy</div><div id=comments>c</div>b</article>", "a b"),
        ("<article><header><h1>T</h1></header>x<footer>f</footer></article>", "T x"),
        ("<div role=\"navigation\">n</div><p title=\"a > b\">t</p>", "t"),
        ("a<!-- never closed <p>b", "a"),
        ("a<script>never closed", "a"),
        ("</p></div>a</b><ul><li>1<li>2</ul>", "a 1 2"),
        ("a &amp b &am c &copy; &bogus; <", "a & b &am c © &bogus; <"),
        ("<p>" * 3000 + "deep" + "</p>" * 3000, "deep"),
        ("<div>" * 3000 + "deep", "deep"),
        ("<article>one</article><div>between</div><article>two</article>", "one two"),
    ],
)
def test_main_text(html, text):
    assert m.main_text(html) == text


def result(spark, rows):
    pages = spark.createDataFrame(rows, SCHEMA)
    return sorted(((r.page_id, r.url, r.text) for r in m.extract(pages).collect()), key=str)


def test_templates_go_per_host(spark):
    def page(i, host, promo):
        return (i, f"http://{host}/p{i}", f"<body><div>{promo}</div><p>Story {i}</p><div>Own words {i}</div></body>", "h", "t", "n")

    rows = [page(i, "a.example", "Join us today") for i in range(20)] + [page(100 + i, "b.example", f"Part {i}") for i in range(20)] + [page(200, "c.example", "Join us today")]
    found = {i: t for i, _, t in result(spark, rows)}
    assert found[3] == "Story 3 Own words 3"
    assert found[104] == "Part 4 Story 104 Own words 104"
    assert found[200] == "Join us today Story 200 Own words 200"


def test_copied_articles_stay(spark):
    """Copies of one page tell nothing apart; other articles of the host show what the box in them is."""
    page = "<div>Shared box</div><article><h1>{0}</h1><p>{1}</p><div>Follow the site</div></article>"
    rows = [(i, "http://x.example/" + str(i), page.format("Same", "Copied story."), "", "", "") for i in range(30)]
    assert {t for _, _, t in result(spark, rows)} == {"Same Copied story. Follow the site"}
    rows += [(100 + i, "http://x.example/o" + str(i), page.format("Other", f"Story {i}."), "", "", "") for i in range(8)]
    assert {t for _, _, t in result(spark, rows)} == {"Same Copied story."} | {f"Other Story {i}." for i in range(8)}


def test_copies_on_a_hot_host_and_rotating_boxes(spark):
    """No page marks its article: copies stay whole beside changing boxes, a box on 60 of 600 pages goes."""
    words = "A long story that many pages of this host repeat word for word, over and over again. " * 3
    rows = [(i, "http://hot.example/", f"<div><div>Box {i % 10}</div><div><p>{words}</p></div></div>", "", "", "") for i in range(200)]
    rows += [(200 + i, "http://hot.example/", f"<div><div>Box {i % 10}</div><div><p>Own story number {i}.</p></div></div>", "", "", "") for i in range(600)]
    found = {i: t for i, _, t in result(spark, rows)}
    assert {found[i] for i in range(200)} == {words.strip()}
    assert [found[200 + i] for i in range(600)] == [f"Own story number {i}." for i in range(600)]


def test_menus_are_one_template_whatever_they_link_to(spark):
    menu = lambda i: f"<div><ul><li><a href=/{i}>Page {i}</a></li><li><a href=/x{i}>More {i}</a></li></ul></div>"
    rows = [(i, "http://m.example/", f"<body>{menu(i)}<div><p>Story {i} <a href=/>with link {i}</a>.</p></div></body>", "", "", "") for i in range(30)]
    assert {i: t for i, _, t in result(spark, rows)} == {i: f"Story {i} with link {i}." for i in range(30)}


def test_headings_of_an_article_stay(spark):
    assert m.main_text('<article><div class="article-header"><h1>Title</h1></div><p class="search-results">Body</p><div class="reader-comments">c</div><div class="share">s</div></article>') == "Title Body"
    assert m.main_text('<div class="page-header">Site</div><p>Body</p>') == "Body"


@pytest.mark.parametrize("part", ["<a ", '<a "', "<a href='", "<div>", "</p>", "<b>", "<ul><li>", "<p><b>", "<!", "<!--", "<script>", "&amp", "<b></i>"])
def test_broken_pages_take_time_in_proportion(part):
    began = time.process_time()
    m.main_text(part * (1_000_000 // len(part)))
    m.subtrees("<div>x" + part * (200_000 // len(part)))
    assert time.process_time() - began < 20


ARTICLE = "<article><h1>Title</h1><p>Body text.</p></article>"
AROUND = "content with-sidebar,has-comments,no-ads,with-sidebar,entry social,search-results,nav-tabs-wrapper,header-fixed page,cookie-consent-enabled,has-ads,with-menu,banner-top-page,page has-sidebar,social,menu"


@pytest.mark.parametrize("name", AROUND.split(","))
@pytest.mark.parametrize("attribute", ["class", "id", "role"])
def test_no_name_deletes_the_article(name, attribute):
    page = f'<body><div class="cookie-bar"><p>We use cookies.</p></div><div {attribute}="{name}">{{}}</div><div class="site-footer">Imprint</div></body>'
    assert m.main_text(page.format(ARTICLE)) == "Title Body text."
    assert m.main_text(page.format("<h1>Title</h1><p>Body text, long enough to be most of what this page says.</p>")) == "Title Body text, long enough to be most of what this page says."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<article><h2 id="social-impact">A</h2><p>x</p><h2 id="search">B</h2><p>y</p><h2 id="comments">C</h2><p>z</p></article>', "A x B y C z"),
        ('<article><p>a</p><section id="menu-design"><p>b</p></section><div class="informed-consent"><p>c</p></div></article>', "a b c"),
        ('<main><h1>Title</h1><p>Body, some sentences long, of this page. And one more.</p><article class="teaser">Other</article></main>', "Title Body, some sentences long, of this page. And one more."),
        ('<div><h1>Title</h1><p>Body, some sentences long, of this page. And one more.</p></div><article>Card</article><article>Card 2</article>', "Title Body, some sentences long, of this page. And one more."),
        ('<div class="adslot">b</div><div class="usercomments">c</div><div class="reader_responses">d</div><p>Text</p>', "Text"),
        ('<div hidden>b</div><div style="display: none">c</div><p>Text that is shown.</p>', "Text that is shown."),
        ('<article><p>Short.</p><section class="comments"><p>A comment that is much longer than the article.</p></section></article>', "Short."),
        ('<article><p>Short.</p><section id="comments"><article><p>A comment, longer than the article.</p></article></section></article>', "Short."),
        ('<form action="/"><div><h1>T</h1><p>A whole page in a form.</p></div></form>', "T A whole page in a form."),
        ('<div class="sidebar"><article>Teaser in a sidebar</article></div><div><p>Main text.</p></div>', "Main text."),
        ('<body class="menu"><p>Text</p></body>', "Text"),
        ('<div class="mainNav">menu</div><div class="postHeader">Title</div><p>Text</p>', "Title Text"),
    ],
)
def test_names_and_main_text(html, text):
    assert m.main_text(html) == text


def layouts(i):
    """Ten usual page layouts around one story; the story's title, paragraphs and what else is main text."""
    title, body = f"Story number {i}", [f"Paragraph {j} of story {i} tells something of its own, in a sentence." for j in range(2 + i % 4)]
    h, p = f"<h1>{title}</h1>", "".join(f"<p>{x}</p>" for x in body)
    menu = "".join(f"<li><a href='/{k}'>Part {k}</a></li>" for k in range(5))
    comments = "".join(f"<div class='item'><p>Reader {k} thinks of {i}: well said, and so on and so on.</p></div>" for k in range(3))
    card = f"<article class='card'><h3>See {i + 1}</h3><p>Short</p></article>"
    pages = [
        f"<body><nav><ul>{menu}</ul></nav><main><article>{h}{p}</article></main><footer>Imprint</footer></body>",
        f"<body class='has-sidebar'><div id='page' class='site with-sidebar'><div class='site-header'>Site</div><div id='content'><article class='post entry'><header class='entry-header'>{h}</header>{p}</article></div><div class='right-sidebar'>{card}</div></div></body>",
        f"<body><div class='navbar'><ul>{menu}</ul></div><div class='wrapper no-ads'>{h}{p}</div><div class='comments-area'>{comments}</div></body>",
        f"<body><form id='aspnetForm'><div class='top-menu'><ul>{menu}</ul></div><div class='content'>{h}{p}</div><div class='page-footer'>Imprint</div></form></body>",
        f"<body><main>{h}{p}<section class='related'>{card}{card}</section></main></body>",
        f"<body><div class='header-fixed page'><div class='cookie-consent'>We use cookies</div><article>{h}{p}<div class='share-buttons'>Tell others</div><section id='comments'>{comments}</section></article></div></body>",
        f"<body><table><tr><td class='left-nav'>{menu}</td><td>{h}{p}</td></tr></table></body>",
        f"<body><div hidden>Print view</div><div class='entry social'>{h}{p}</div><div class='adslot'>Buy now</div></body>",
        f"<body><div>{h}{p}</div><div class='grid'>{card}{card}{card}</div></body>",
        f"<body><header><div class='banner'>Welcome</div></header><div role='main' class='cookie-consent-enabled'><article>{h}{p}</article></div><div class='newsletter'><p>Subscribe to our letter</p></div></body>",
    ]
    return pages, " ".join([title, *body])


def test_ten_layouts_are_recovered_whole(spark):
    rows, want = [], {}
    for k in range(10):
        for i in range(12):
            pages, text = layouts(i)
            rows.append((100 * k + i, f"http://l{k}.example/{i}", pages[k], "", "", ""))
            want[100 * k + i] = text
    assert {i: t for i, _, t in result(spark, rows)} == want


def test_headings_recur_and_stay(spark):
    """Headings and paragraphs that all pages share are content; a block that they share is none."""
    page = "<body><div>Site name<p>Always here</p></div><div><h2>Introduction</h2><p>Own words {0}.</p><h2>References</h2><p>Book {0}, and so on.</p></div></body>"
    rows = [(i, "http://wiki.example/", page.format(i), "", "", "") for i in range(60)]
    assert {i: t for i, _, t in result(spark, rows)} == {i: f"Introduction Own words {i}. References Book {i}, and so on." for i in range(60)}


class Tree(HTMLParser):
    """Brute force: well-formed pages as nested lists."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.top = ["", {}]
        self.stack = [self.top]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs)]
        self.stack[-1].append(node)
        self.stack.append(node)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        self.stack[-1].append(data)


def flat(node, skip=()):
    """Texts of a tree without skipped elements, tidied."""
    if isinstance(node, str):
        return [" ".join(node.split())] if node.split() else []
    return [] if any(node is x for x in skip) else [t for child in node[2:] for t in flat(child, skip)]


def shape(node, loose, link=False):
    if isinstance(node, str):
        return "" if loose and link else " ".join(node.split())
    return (node[0], tuple(shape(c, loose, link or node[0] == "a") for c in node[2:] if not isinstance(c, str) or c.split()))


def walk(node, inside=False, above=()):
    for child in node[2:]:
        if not isinstance(child, str):
            within = inside or child[0] == "article"
            yield child, within, above
            yield from walk(child, within, (*above, child))


def brute(rows):
    trees = {i: Tree(html).top for i, _, html, *_ in rows}
    host = {i: url.split("/")[2] for i, url, *_ in rows}
    kind = {"nav", "footer"}
    dropped = {i: [n for n, _, _ in walk(t) if n[0] in kind] for i, t in trees.items()}
    content = {i: flat(t, dropped[i]) for i, t in trees.items()}
    seen, pages = defaultdict(set), defaultdict(set)
    options = {}
    for i, t in trees.items():
        pages[host[i]].add(tuple(sorted(content[i])))
        options[i] = []
        for n, inside, above in walk(t):
            if any(n is d or d in above for d in dropped[i]) or n[0] in ("b", "a", "article", "body", "p", "h1", "li"):
                continue
            key = (host[i], inside, shape(n, not inside))
            options[i].append((n, key))
            own = flat(n, dropped[i])
            rest = Counter(content[i]) - Counter(own)
            if own and m.SMALL * sum(len(x) * c for x, c in rest.items()) >= sum(map(len, own)):
                seen[key].add(tuple(sorted(rest.elements())))
    out = []
    for i, url, *_ in rows:
        limit = max(m.MIN_PAGES, min(m.MANY, m.MIN_SHARE * len(pages[host[i]])))
        gone = dropped[i] + [n for n, key in options[i] if len(seen[key]) >= limit]
        article = [n for n, _, _ in walk(trees[i]) if n[0] == "article" and not any(n is x for x in gone)]
        out.append((i, url, " ".join(x for n in article or [trees[i]] for x in flat(n, gone))))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    r = random.Random(11)
    boxes = [f"<div><h1>Box {k}</h1><ul><li>see {k}</li><li>and <b>more</b></li></ul></div>" for k in range(6)]
    stories = ["".join(f"<p>Story {k} says {j} <b>things</b></p>" for j in range(r.randint(1, 4))) + f"<div>Part {k}<ul><li>a{k}</li></ul></div>" for k in range(12)]

    def page(i):
        menu = "<div>" + "".join(f"<a>{r.randint(0, 99)}</a>" for _ in range(2)) + "</div>"
        body = r.choice(stories) if r.random() < 0.6 else f"<p>Own {i}</p><div>Words {i}</div>"
        body = r.choice(boxes[:2]) * (r.random() < 0.6) + body + r.choice(boxes[:2]) * (r.random() < 0.6)
        body = f"<article>{body}</article>" if i % 2 else f"<div>{body}</div>"
        return (i, f"http://h{i % 3}.example/{i}", f"<body><nav><a>n{i}</a></nav>{menu}{r.choice(boxes)}{body}{r.choice(boxes)}<footer>f{i % 2}</footer></body>", "", "", "")

    rows = [page(i) for i in range(240)]
    found = result(spark, rows)
    assert found == brute(rows)
    changed = [t != m.main_text(rows[i][2]) for i, _, t in found]  # by templates: all pages without an article, most with one
    assert sum(changed) > 200


def test_both_ways_to_join_agree(spark, monkeypatch):
    rows = [(i, f"http://h{i % 3}.example/", f"<div>Box {i % 3}</div><p>{i}</p>", "", "", "") for i in range(60)]
    one = result(spark, rows)
    monkeypatch.setattr(m, "MAX_BROADCAST_BYTES", -1)
    assert result(spark, rows) == one
    assert {t for _, _, t in one} == {str(i) for i in range(60)}


def test_defined_cases(spark):
    rows = [(1, None, None, "", "", ""), (1, "u", "", "", "", ""), (None, "http://a/", "<p>x", "", "", ""), (3, "not a url", "<p>" + "long " * 100_000, "", "", "")]
    assert result(spark, rows) == sorted([(1, None, ""), (1, "u", ""), (None, "http://a/", "x"), (3, "not a url", ("long " * 100_000).strip())], key=str)
    assert result(spark, []) == []
