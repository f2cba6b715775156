import math
import random
import time

from lakeframe.llm import html_extract
from lakeframe.llm.html_extract import extract_main_text, extract_text


def page(article, extra=""):
    return (
        '<!DOCTYPE html><html><head><title>T</title><script>var t="</p><p>no";</script></head><body>'
        '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News of the day</a></li></ul></nav><!-- <p>x</p> -->'
        '<div class="ad">Buy this now, it is very cheap and very good.</div>'
        f"{article}{extra}<footer>&copy; Site &middot; all rights</footer></body></html>"
    )


def test_articles():
    assert extract_text(page("<article><h1>Head &amp; line</h1><p>One  two\n three.</p><p><b>Four<br><p>five &eacute; &#233; &am</article>")) == "Head & line\nOne two three.\nFour\nfive é é &am"
    assert extract_text(page("<article><h1>A</h1><p>b</p></article>")) == "A\nb"
    assert extract_text(page("<article><p>only <a href=x>a link</a> here</p></article>")) == "only a link here"
    assert extract_text(page("<main><div><h2>Long title of it</h2><p>" + "words and more " * 30 + "</p><p>tail</p></div></main>", '<div id="comments"><p>' + "I disagree " * 60 + "</p></div>")).endswith("\ntail")
    assert "disagree" not in extract_text(page("<article><p>text</p></article>", '<section class="comment-list"><p>I disagree</p></section>'))
    assert extract_text(page("<article><h1>T</h1><form><p>Name</p><input></form><p>para</p><aside>see also</aside></article>")) == "T\npara"
    assert extract_text(page("<article><ul><li>one<li>two <i>it</i></ul><table><tr><td>a<td>b</table></article>")) == "one\ntwo it\na\nb"


def test_marks():
    body = '<div class="page has-sidebar"><div id="content"><h1>T</h1><p>One two three.</p><p>Four five.</p></div>{}</div>'
    for extra in ('<div class="sidebar-left"><p>Other stories</p></div>', '<div id="cookie-notice"><p>We use cookies</p></div>', '<ul class="Share-Links"><li>Share</li></ul>', '<div role="navigation"><p>Go</p></div>', "<section id=comments><p>First!</p></section>", '<div hidden><p>x</p></div>'):
        assert extract_text(page(body.format(extra))) == "T\nOne two three.\nFour five.", extra


def test_marks_within_the_article():
    text = "<p>One two three, and more of the same.</p><p>Four five.</p>"
    want = "\nOne two three, and more of the same.\nFour five."
    for wrapper in ("layout sidebar-right", "page-wrapper header", "widget", "main-nav content"):
        assert extract_text(page(f'<div class="{wrapper}"><h1>T</h1>{text}</div>')) == "T" + want, wrapper
        assert extract_text(page(f'<div class="{wrapper}"><div class="ad">Buy</div><div><h1>T</h1>{text}</div></div>')) == "T" + want, wrapper
    for heading in ('h2 id="search-results-explained"', 'h2 id="navigation"', 'h2 class="header"'):
        assert extract_text(page(f"<article><{heading}>Slug</h2>{text}</article>")) == "Slug" + want, heading
    for part in ('section id="related-work"', 'section id="cookies-in-browsers"', 'div class="notice"', 'div id="social-contract"', "figcaption"):
        assert extract_text(page(f"<article><h1>T</h1>{text}<{part}>Six seven.</{part.split()[0]}></article>")) == f"T{want}\nSix seven.", part
    assert extract_text(page(f'<article><h1>T</h1>{text}<p class="notice">Six.</p></article>')) == f"T{want}\nSix."
    assert extract_text(page("<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p></article>")) == "So x=2 holds."
    assert extract_text(page(f'<article><h1>T</h1>{text}</article>', '<div class="related-links"><p>Go on</p></div><div id="search-box"><p>Find</p></div>')) == "T" + want
    assert extract_text('<body><div class="widget"><p>One</p></div><div class="sidebar"><p>Two</p></div></body>')


BODY = "<h1>T</h1>" + "".join(f"<p>Sentence number {i} of the article is about a subject of interest, and goes on for a while.</p>" for i in range(6))
LINES = "\n".join(["T", *(f"Sentence number {i} of the article is about a subject of interest, and goes on for a while." for i in range(6))])
STORIES = "".join(f'<li><a href="/{i}">Another story of the day, number {i}</a></li>' for i in range(5))
READERS = "".join(f'<div><div><a href="/u{i}">user{i}</a> <span>2 h</span></div><div>I agree {i}</div><div><a href="/r">Reply</a></div></div>' for i in range(8))
#: Pages that no kind, class or id helps with.
UNMARKED = {
    f"<div>{BODY}</div><div><ul>{STORIES}</ul></div>": LINES,
    f"<div>{BODY}<ul>{STORIES}</ul></div>": LINES,
    f'<div class="c1">{BODY}</div><div class="c2">{READERS}</div>': LINES,
    f'<div>{BODY}</div><div class="x"><a href="/1">Sign in</a> or <a href="/2">register</a></div>': LINES,
}


def test_wrappers_and_words_in_attributes():
    for tag in ('div class="legal notice"', 'div class="col side-main"', 'div class="share-price-report"', 'div data-x="a hidden b"', "form id=aspnet", "aside", 'div class="comments"'):
        assert extract_text(page(f"<{tag}>{BODY}</{tag.split()[0]}>")) == LINES, tag
    assert extract_text(page(f'<div>{BODY}<p title="a hidden gem">A gem.</p></div>')) == LINES + "\nA gem."
    tail = "<p>The second part of the article goes on at some length after the advert.</p><p>Another sentence of some length at the end.</p>"
    found = extract_text(page(f'<div>{BODY}</div><div class="promo">Buy it now and here.</div><div>{tail}</div>'))
    assert found == LINES + "\nThe second part of the article goes on at some length after the advert.\nAnother sentence of some length at the end."


def test_density_decides(monkeypatch):
    """Pages without marks come out right, and do not once all densities are equal."""
    for article, wanted in UNMARKED.items():
        assert extract_text(page(article)) == wanted, article
    monkeypatch.setattr(html_extract, "densities", lambda tree, weight: ([1.0] * len(tree.tag), [1.0] * len(tree.tag)))
    for article, wanted in UNMARKED.items():
        assert extract_text(page(article)) != wanted, article
    assert extract_text(page(f"<article>{BODY}</article>")) != LINES


def test_densities_against_the_formula():
    """Counts by recursion over each node's own subtree, and the formula as it is published."""
    rng = random.Random(9)
    for _ in range(50):
        tree = html_extract.parse("<body>" + "".join(rng.choices(["<div>", "</div>", "<p>some text ", "<a href=u>link</a>", "<ul><li>one", "<nav>way ", "</nav>", "</ul>"], k=60)))
        weight = html_extract.weights(tree)
        n = len(tree.tag)
        below = [[j for j in range(n) if tree.parent[j] == i] for i in range(n)]

        def count(values, i, each=0):
            return values[i] + sum(count(values, j, each) + each for j in below[i])

        share = count(tree.link_chars, tree.body) / max(1, count(tree.chars, tree.body))
        wanted = []
        for i in range(n):
            c, lc, lt = count(tree.chars, i), count(tree.link_chars, i), count(tree.link_tags, i)
            t = max(1, count(tree.tags, i, 1) + lt)
            unlinked, lc, lt = max(1, c - lc), max(1, lc), max(1, lt)
            ratio = max(1.0001, c / lc * t / lt)
            wanted.append(weight[i] * c / t * math.log(ratio, math.log(c / unlinked * lc + share * c + math.e)) if c else 0.0)
        density, total = html_extract.densities(tree, weight)
        assert all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12) for x, y in zip(density, wanted, strict=True))
        assert all(math.isclose(total[i], sum(wanted[j] for j in below[i]), rel_tol=1e-9, abs_tol=1e-9) for i in range(n))


def test_deep_and_long_pages():
    for text in ("<div>" * 20_000 + "<p>deep text", "<p>deep text" + "<span>" * 20_000 + "</span>" * 20_000, "<ul><li>deep text" + "<div>" * 20_000, "<table><tr><td>deep text" + "<td>" * 20_000):
        began = time.time()
        assert extract_text(f"<body><article><h1>T</h1>{text}</article></body>") == "T\ndeep text"
        assert time.time() - began < 1.5
    assert len(extract_text(page(f"<article>{'<p>' + 'long text ' * 20_000 + '</p>'}{'<p>more</p>' * 20_000}</article>"))) == 199_999 + 5 * 20_000


def test_odd_input():
    for x in (None, "", " ", "<", "<p", "<!--", "<script>", '<a href="x', "</div></p>", "<html><body></body></html>"):
        assert extract_text(x).strip("<") == ""
    assert extract_text("plain text") == "plain text"
    assert extract_text("<p>a</p>" * 5000).count("a") == 5000
    rng = random.Random(3)
    bits = ["<p>", "</p>", "<div class='x'>", "</div>", "text ", "&lt;", "<a href='u'>", "</a>", "<br>", "<td>", "<li>", "</ul>", "<ul>", '"', "<!-- c -->", "<b", ">"]
    for _ in range(500):
        extract_text("".join(rng.choices(bits, k=40)))


def test_query(spark):
    rows = [(1, "u", page("<article><h1>A</h1><p>b c</p></article>"), "clash"), (2, None, None, "clash"), (None, "v", "", "clash")]
    found = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [tuple(r) for r in found] == [(1, "u", "A\nb c", 5), (2, None, "", 0), (None, "v", "", 0)]


def test_template_pages(spark):
    """On the test pages everything in <article> is the text; compare with a plain cut of that element."""
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = {r.page_id: r.text for r in extract_main_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert found[r.page_id] == "\n".join(x for x in blocks if x), r.page_id


LONG = "A paragraph of some length that goes on and on, for quite a few words of plain text, until it ends."
MENU = "<div><ul>" + "".join(f"<li><a href=x>Menu item {i}</a></li>" for i in range(6)) + "</ul></div>"


def test_prose_around_the_core_stays():
    """Without any mark: headlines, intros, short ends and second articles stay, loose lines and rights go."""
    paragraphs = f"<p>{LONG}</p>" * 6
    lines = "\n".join([LONG] * 6)
    for article, wanted in {
        f"<div><h1>Head</h1><p>Intro here.</p></div><div>{paragraphs}</div>": f"Head\nIntro here.\n{lines}",
        f'<div class="head"><h1>Head</h1></div><div>{paragraphs}</div>': f"Head\n{lines}",
        f"<div>{paragraphs}</div><div><p>Short end.</p></div>": f"{lines}\nShort end.",
        f"<div>{paragraphs}</div><div><p>{LONG}</p><p>Short end.</p></div>": f"{lines}\n{LONG}\nShort end.",
        f"<article>{paragraphs}</article><article><h1>Two</h1><p>Second one.</p></article>": f"{lines}\nTwo\nSecond one.",
        f"<div>{paragraphs}</div><div>&copy; 2024 Site</div><p>Copyright by us</p>": lines,
        f'<div>{paragraphs}</div><div id="search-box"><p>Find</p></div>': lines,
    }.items():
        assert extract_text(f"<html><body>{MENU}{article}<div>A line of the site</div></body></html>") == wanted, article


def plain_choice(tree, weight, density, total):
    """The rules of content_blocks by recursion over children, node by node."""
    nodes = range(len(tree.tag))
    below = [[j for j in nodes if tree.parent[j] == i] for i in nodes]

    def within(i):
        return [i] + [x for j in below[i] for x in within(j)]

    def path(i):  # the node and all that holds it, within the body
        return [i] if i == tree.body else [i, *path(tree.parent[i])]

    def best(i):
        return max(within(i), key=lambda j: (total[j], -j))

    bodies = [i for i in within(tree.body)]
    core = best(tree.body)
    threshold = min(density[i] for i in path(core))
    chosen = {core}
    for i in bodies[1:]:
        if all(density[j] >= threshold - 1e-9 for j in path(i)[:-1]) and total[best(i)] > 0 and (weight[i] == 1 or weight[core] < 1):
            chosen.add(best(i))
    holders = {j for i in chosen if i != tree.body for j in path(i)[1:]}
    texts = {i: [t for b, _, t in tree.pieces if b == i] for i in nodes}

    def is_prose(i):
        every = within(i)
        if any(tree.mark[j] == "doubtful" or tree.chars[j] and tree.tag[j] not in html_extract.PROSE for j in every):
            return False
        if any(t.lower().lstrip().startswith(("©", "(c)", "copyright")) for j in every for t in texts[j]):
            return False
        chars = sum(tree.chars[j] for j in every)
        return chars > 0 and 2 * sum(tree.link_chars[j] for j in every) < chars and weight[i] == 1

    chosen |= {i for i in bodies[1:] if tree.parent[i] in holders and is_prose(i)}
    kept = [False] * len(tree.tag)
    for i in nodes:
        p = tree.parent[i]
        up = i > 0 and kept[p]
        every = within(i)
        chars, links = sum(tree.chars[j] for j in every), sum(tree.link_chars[j] for j in every)
        menu = 0 < chars == links and sum(tree.link_tags[j] for j in every) >= html_extract.MENU_LINKS
        kept[i] = (up or i in chosen) and not (up and density[i] < threshold and (menu or weight[i] < weight[p]))
    return kept


def test_choice_by_recursion():
    rng = random.Random(4)
    bits = ["<div>", "</div>", "</div>", "<p>some text of an article, longer than others ", "<h2>head</h2>", "loose ", "<a href=u>link text</a>", "<ul><li>one<li>two</ul>", "<nav><a href=u>way</a></nav>", "<p>Copyright us</p>", '<div class="ad">buy ', '<div id="notice"><p>see ', "<article>", "</article>", '<section class="comments">', "</section>"]
    kinds = set()
    for _ in range(400):
        tree = html_extract.parse("<body>" + "".join(rng.choices(bits, k=rng.choice((5, 20, 50)))))
        weight = html_extract.weights(tree)
        density, total = html_extract.densities(tree, html_extract.chosen_weights(tree, weight))
        found = html_extract.content_blocks(tree, weight, density, total)
        assert found == plain_choice(tree, weight, density, total)
        kinds.add(2 * sum(found) > len(found))
    assert kinds == {True, False}


def test_given_pages_without_their_marks(spark):
    """Stripped of classes, ids and kinds, pages lose no line of the article and gain next to nothing; equal densities
    change results of many pages as they are."""
    import re

    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    foreign = whole = changed = 0
    for page_html in pages:
        wanted = extract_text(page_html).split("\n")
        bare = re.sub(r"<(/?)(nav|header|footer|aside|article|main)\b", r"<\1div", re.sub(r'\s(class|id|role)="[^"]*"', "", page_html))
        found = extract_text(bare).split("\n")
        assert not set(wanted) - set(found)
        foreign += sum(len(x) for x in found if x not in wanted)
        whole += sum(map(len, found))
        tree = html_extract.parse(page_html)
        weight = html_extract.weights(tree)
        equal = html_extract.chosen_weights(tree, weight)
        density, total = html_extract.densities(tree, equal)
        sums = [0.0] * len(equal)
        for i in range(1, len(equal)):
            sums[tree.parent[i]] += equal[i]
        changed += html_extract.content_blocks(tree, weight, density, total) != html_extract.content_blocks(tree, weight, equal, sums)
    assert foreign < 0.005 * whole
    assert 3 * changed > len(pages)
