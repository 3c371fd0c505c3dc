import functools
import random
import resource

from tests.llm.conftest import order
from veilwright.llm import html_extract
from veilwright.llm.html_extract import ASKED, CELLS, Tree, blocks, simple_tree_matching, skeleton

SCHEMA = "page_id long, url string, html string, host string, text string, keys string, skeleton string"


def text_of(page: str) -> str:
    return " ".join(t for _, t in blocks(page))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "h", "t", "k", "s") for r in rows], SCHEMA).repartition(2)


def test_article_without_furniture():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
    <article><h1>Big &amp; bold</h1><p>First   para<b>graph</b>&nbsp;with <a href=x>link</a>.<p>Second<br>line &lt;tag&gt; &#x41;&#66;
    <aside>Also read</aside><div class="ad">Buy!</div><form><input value=x>Sign up</form><!-- <p>no</p> --><ul><li>one<li>two</ul>
    <section id="comments"><p>Great post</p></section></article>
    <div class="sidebar">Side</div><footer>&copy; 2024</footer></body></html>"""
    assert text_of(page) == "Big & bold First paragraph with link . Second line <tag> AB one two".replace("link .", "link.")


def test_no_article():
    assert text_of("<body><nav>m</nav><main><p>a</p><div>b</div></main><p>outside</p></body>") == "a b"
    assert text_of("<p>only <i>text</i></p>tail") == "only text tail"
    assert text_of("") == "" and text_of("plain & simple") == "plain & simple"


def test_broken_markup():
    assert text_of("<article><p>a<p>b</p></p><b>c</article><p>later</p>") == "a b c"
    assert text_of("<article><table><tr><td>1<td>2<tr><td>3</table>") == "1 2 3"
    assert text_of("<article><p>x<script>if (a</script>y</p>") == "xy"
    assert text_of("<article><p>a < b and <3") == "a < b and <3"


def test_text_that_looks_like_markup():
    assert text_of("<p title=it's>hello") == "hello"
    assert text_of("<p title=a\"b class='x>y'>hello</p>") == "hello"
    assert text_of("<p>a<b a<b a<b</p>") == "a<b a<b a<b"
    assert text_of("<main><p>Intro to the matter</p><article class='teaser'>Other</article><p>Body of the text</p></main>") == "Intro to the matter Other Body of the text"
    for name in ("class='side-effects'", "class='social-science'", "id='comments-on-law'"):
        assert text_of(f"<article><div {name}><p>A real paragraph</p></div></article>") == "A real paragraph"


def best_match(a, b, left, right):
    """Simple tree matching as it is defined: all alignments of children, by recursion on prefixes."""

    def weight(x, y):
        if left.tag[x] != right.tag[y]:
            return 0.0
        if left.hash[x] == right.hash[y]:
            return 1.5 * left.count[x]
        below_x, below_y = left.below[x], right.below[y]

        def prefix(i, j):
            if not i or not j:
                return 0.0
            return max(prefix(i - 1, j), prefix(i, j - 1), prefix(i - 1, j - 1) + weight(below_x[i - 1], below_y[j - 1]))

        return 1.0 + prefix(len(below_x), len(below_y))

    return weight(a, b)


def random_page(r, depth=3):
    if not depth or r.random() < 0.25:
        return r.choice(["<p>one</p>", "<p>two</p>", "<h2>three</h2>", "<p>four <a href=x>five</a></p>"])
    inner = "".join(random_page(r, depth - 1) for _ in range(r.randint(1, 4)))
    return f"<div>{inner}</div>" if r.random() < 0.7 else f"<section>{inner}</section>"


def test_tree_matching_equals_brute_force():
    r = random.Random(9)
    for _ in range(300):
        left, right = (Tree(skeleton("<body>" + "".join(random_page(r) for _ in range(r.randint(1, 3))) + "</body>")[0]) for _ in range(2))
        score, pairs = simple_tree_matching(left, right)
        assert score == best_match(0, 0, left, right)
        of = dict(pairs)
        assert len(of) == len(pairs) == len(set(of.values()))
        for x, y in pairs:
            assert left.tag[x] == right.tag[y] and (not x or of[left.up[x]] == right.up[y])


def test_long_lists_are_aligned_by_equal_parts():
    many = int(CELLS**0.5) + 500
    left = Tree(skeleton("<body>" + "".join(f"<p>line {k}</p>" for k in range(many)) + "</body>")[0])
    right = Tree(skeleton("<body>" + "".join(f"<p>line {k}</p><h2>extra</h2>" if k % 7 == 0 else f"<p>line {k}</p>" for k in range(5, many + 5)) + "</body>")[0])
    same = sum(left.key[x] == right.key[y] for x, y in simple_tree_matching(left, right)[1] if left.key[x])
    assert same == many - 5


def table_match(left, right):
    """The weight by plain tables of all pairs of children, however many."""

    @functools.cache
    def weight(x, y):
        if left.tag[x] != right.tag[y]:
            return 0.0
        if left.hash[x] == right.hash[y]:
            return 1.5 * left.count[x]
        row = [0.0] * (len(right.below[y]) + 1)
        for c in left.below[x]:
            above, row = row, [0.0]
            for j, d in enumerate(right.below[y]):
                row.append(max(row[j], above[j + 1], above[j] + weight(c, d)))
        return 1.0 + row[-1]

    return weight(0, 0)


def test_many_children_are_aligned_as_few_are():
    """Past a limit, lists of children were aligned in order, with less than the best weight."""
    r = random.Random(4)
    entry = lambda: f"<div><p>{r.choice('abcdef')}</p><p>{r.choice('abcdef')} {r.choice('xyz')}</p></div>"
    line = lambda: f"<p>{r.choice('abcdefgh')}</p>"
    for n, part in ((int(ASKED**0.5) + 2, entry), (int(CELLS**0.5) + 80, line)):
        left, right = (Tree(skeleton("<body>" + "".join(part() for _ in range(n)) + "</body>")[0]) for _ in range(2))
        assert simple_tree_matching(left, right)[0] == table_match(left, right)


def test_limits_do_not_change_the_mapping(monkeypatch):
    """Random trees, and long lists of which one is an edited copy of the other."""
    r = random.Random(10)
    for k in range(100):
        if k % 2:
            pages = [[random_page(r, 4) for _ in range(r.randint(1, 6))] for _ in range(2)]
        else:
            parts = [random_page(r, 2).replace("one", str(r.randint(0, 40))) for _ in range(r.randint(20, 60))]
            pages = [parts, [r.choice(parts) if r.random() < 0.1 else x for x in parts if r.random() < 0.9] + parts[: k % 9]]
        left, right = (Tree(skeleton("<body>" + "".join(x) + "</body>")[0]) for x in pages)
        got = []
        for limits in ((CELLS, ASKED, html_extract.HELD, html_extract.BAND), (0, 0, html_extract.HELD, 32), (0, 0, 40, 1), (0, 0, 0, 2), (CELLS, 8, 0, 1)):
            for name, value in zip(("CELLS", "ASKED", "HELD", "BAND"), limits, strict=True):
                monkeypatch.setattr(html_extract, name, value)
            got.append(simple_tree_matching(left, right))
            monkeypatch.undo()
        assert got[0][0] == table_match(left, right) and all(x == got[0] for x in got)


def test_template_between_many_stories_goes(spark):
    def wide(k):
        third = lambda t: "".join(f"<div><p>Story {k}.{t}.{j}</p><p>told by writer {k}/{t}/{j}</p></div>" for j in range(47 + k))
        return "<body><div>" + "".join(third(t) + "<div><p>Follow us</p><p>on all channels</p></div>" for t in range(3)) + f"<div><p>The end</p><p>of page {k}</p></div></div></body>"

    rows = [(k, f"https://wide.org/{k}", wide(k)) for k in range(12)]
    got = {r.page_id: r.text for r in html_extract.extract(frame(spark, rows)).collect()}
    for k in range(12):
        assert got[k].startswith(f"Story {k}.0.0 told by writer {k}/0/0") and f"Story {k}.2.{46 + k} told" in got[k] and got[k].endswith(f"of page {k}")
        assert "Follow us" not in got[k] and "on all channels" not in got[k]


def page(k: int, extra: str = "") -> str:
    return f"<body><div>Welcome to us</div><div>Story number {k} is about {k * 7} things</div>{extra}<div>All rights held</div></body>"


def test_template_of_a_host_goes(spark):
    rows = [(k, f"https://one.org/{k}", page(k, f"<div>More on {k}</div>" if k % 3 == 0 else "")) for k in range(9)]
    rows += [(100, "https://two.org/1", page(1)), (101, None, page(2)), (102, "https://one.org/null", None)]
    got = {r.page_id: r.text for r in html_extract.extract(frame(spark, rows)).collect()}
    assert got[3] == "Story number 3 is about 21 things More on 3" and got[4] == "Story number 4 is about 28 things"
    assert got[100] == "Welcome to us Story number 1 is about 7 things All rights held"
    assert got[101].startswith("Welcome") and got[102] == ""


def varied(k: int) -> str:
    """A page without telling tags or names, with menus and adverts that differ from page to page."""
    r = random.Random(k)
    words = lambda n: " ".join(r.choice("north south bread river stone cloud paper light water glass".split()) for _ in range(n))
    menu = "".join(f"<div><a href=/{x}>{words(2)}</a></div>" for x in range(8))
    story = "".join(f"<p>{words(30)}</p>" for _ in range(3 + k % 4))
    return f"<body><div class=a>{menu}</div><div class=b>{words(6)}</div><div class=c><h1>{words(4)}</h1>{story}<p>Read on tomorrow</p></div><div class=d>{words(5)}</div></body>"


def test_the_slot_of_varying_text_is_the_content(spark):
    """Two pages are enough to tell the slot; constant text in it takes more to be told from chance."""
    for n in (2, 12):
        rows = [(k, f"https://one.org/{k}", varied(k)) for k in range(n)]
        got = {r.page_id: r.text for r in html_extract.extract(frame(spark, rows)).collect()}
        for k, _, html in rows:
            tree = html.split("<div class=c>")[1].split("</div>")[0]
            want = text_of(f"<article>{tree}</article>").removesuffix(" Read on tomorrow" if n > 4 else "")
            assert got[k] == want and text_of(html) != want


def test_deep_pages_of_one_host(spark):
    rows = [(k, f"https://deep.org/{k}", "<div>" * 1500 + f"<p>text number {k}</p>" + "</div>" * (1500 - k)) for k in range(9)]
    got = {r.page_id: r.text for r in html_extract.extract(frame(spark, rows)).collect()}
    assert got == {k: f"text number {k}" for k in range(9)}


def test_wide_pages_of_one_host_take_bounded_memory():
    left, right = (Tree(skeleton("<body>" + "".join(f"<p>{own} {k}</p>" for k in range(50_000)) + "</body>")[0]) for own in "ab")
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert len(simple_tree_matching(left, right)[1]) == 2 + 2 * 50_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000  # kB


def test_copies_of_one_page_are_no_template(spark):
    rows = [(k, "https://one.org/x", page(1)) for k in range(20)]
    assert all("Story number 1" in r.text for r in html_extract.extract(frame(spark, rows)).collect())


def test_near_copies_of_one_article_keep_it(spark):
    same = "<p>" + "A long story that all pages share, word for word. " * 5 + "</p>"
    rows = [(k, f"https://one.org/{k}", f"<body><div>{same}</div><p>Edition {k}</p></body>") for k in range(12)]
    assert all(r.text.startswith("A long story") for r in html_extract.extract(frame(spark, rows)).collect())


def test_edge_rows(spark):
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    rows = [(1, None, None), (1, "", ""), (1, "http://a.b/", "<article>" + "<p>word word</p>" * 20_000), (None, "http://a.b/", "<p>t</p>"), (2, "x", deep)]
    got = html_extract.extract(frame(spark, rows)).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert order(r.text[:9] for r in got) == order(["", "", "word word", "t", "x"])
    assert html_extract.extract(frame(spark, [])).collect() == []


def test_an_empty_first_page_leaves_the_template(spark):
    rows = [(0, "https://one.org/null", None), (1, "https://one.org/e", ""), (2, "https://one.org/gone", "<body><p>Error</p></body>")]
    rows += [(k, f"https://one.org/{k}", page(k)) for k in range(10, 30)]
    got = {r.page_id: r.text for r in html_extract.extract(frame(spark, rows)).collect()}
    assert got[10] == "Story number 10 is about 70 things" and got[29] == "Story number 29 is about 203 things"
    assert got[0] == "" and got[2] == "Error"


def test_a_short_first_article_leaves_the_template(spark):
    rows = [(0, "https://one.org/0", "<body><div>Welcome to us</div><div>Hi</div><div>All rights held</div></body>")]
    rows += [(k, f"https://one.org/{k}", page(k, f"<div>More than enough on number {k}</div>")) for k in range(1, 12)]
    got = {r.page_id: r.text for r in html_extract.extract(frame(spark, rows)).collect()}
    assert got[0] == "Hi" and got[3] == "Story number 3 is about 21 things More than enough on number 3"


def test_each_of_two_layouts_has_its_template(spark):
    rows = [(k, f"https://one.org/{k}", page(k)) for k in range(12)]
    shop = "<body><section><p>Fine goods</p><h2>Item {0}</h2><p>Item {0} has {1} parts and comes in a box</p>{2}</section></body>"
    rows += [(k, f"https://one.org/{k}", shop.format(k, 3 * k, f"<ul><li>Part {k}</li></ul>" if k % 2 else "")) for k in range(20, 32)]
    got = {r.page_id: r.text for r in html_extract.extract(frame(spark, rows)).collect()}
    assert got[4] == "Story number 4 is about 28 things"
    assert got[20] == "Item 20 Item 20 has 60 parts and comes in a box" and got[21].endswith("in a box Part 21")


def test_names_of_layouts_keep_the_article():
    story = "<p>The whole story of the day</p>"
    for name in ("content has-sidebar", "with-sidebar", "no-sidebar", "page-no-sidebar", "social-science", "ad-free", "main-form", "sidebar-right", "sidebar"):
        for kind in ("class", "id"):
            assert text_of(f'<body><div {kind}="{name}"><article>{story}</article></div></body>') == "The whole story of the day", name
            if name != "sidebar":
                assert text_of(f'<body><div {kind}="{name}">{story}</div><p>Foot</p></body>').startswith("The whole story"), name


def test_names_of_other_parts_go():
    for name in ("sidebar", "left-sidebar", "sidebar-1", "cookie-notice", "main-menu", "ad-300x250", "ad_box", "share-buttons", "related-posts", "comments", "site-footer", "newsletter-signup"):
        assert text_of(f'<body><article><p>Story of the day</p></article><div class="{name}"><article>Other</article></div></body>') == "Story of the day", name
        assert text_of(f'<body><p>A story of the day</p><div id="{name}">Other</div></body>') == "A story of the day", name
    assert text_of('<body><p>A story</p><div class="related-posts"><article>Other</article></div></body>') == "A story"
