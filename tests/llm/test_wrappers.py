import random
import time
from functools import lru_cache

import pytest

from palaver.llm import wrappers

from .helpers import pages


def site(i, paragraphs, extra=""):
    body = "".join(f"<p>Story {i} part {n} says &amp; more&nbsp;here<br>line" for n in range(paragraphs))
    return (f"<html><head><title>t{i}</title><script>var a='</p>';</script></head><body><div class='top-menu'><a href=/>Home {i}</a></div>"
            f"<div id=wrap><div class='cookie-notice'>We use cookies {i}</div><div class='content'><h2>Head {i}</h2>{body}{extra}</div>"
            f"<div class='sidebar'><p>{'Other stories ' * 30}{i}</div></div><footer>(c) {i}</footer></body></html>")


def text(i, paragraphs):
    return "\n\n".join([f"Head {i}"] + [f"Story {i} part {n} says & more here line" for n in range(paragraphs)])


def extract(spark, rows):
    return {r.page_id: (r.text, r.n_chars) for r in wrappers.main_text(pages(spark, rows), "page_id").collect()}


def test_host_without_article_tag(spark):
    rows = [(i, f"http://a.org/{i}", site(i, 1 + i % 4, "<form>ask</form><div class='comments'><p>nice</div>")) for i in range(12)]
    rows += [(50, "http://b.org/", "<body><article><header><h1>T</h1></header><p>One<p>Two <i>it</i>alic<!-- x --><aside>no</aside></article><p>out</body>"),
             (51, None, None), (52, "no url", ""), (53, "http://c.org", "just text < 3 &lt;b&gt;"), (54, "http://a.org/x", "<article>alone</article>"),
             (55, "http://b.org/", "<div>" * 3000 + "deep" + "</p></div>")]
    rows += rows[:1]
    got = extract(spark, rows)
    for i in range(12):
        assert got[i] == (text(i, 1 + i % 4), len(text(i, 1 + i % 4)))
    assert got[50][0] == "T\n\nOne\n\nTwo italic"
    assert got[51] == ("", 0) and got[52] == ("", 0) and got[53][0] == "just text < 3 <b>"
    assert got[54][0] == "alone" and got[55][0] == "deep"


def test_alignment_makes_optional_and_repeated_groups():
    a = wrappers.page_wrapper("<div><h1>A</h1><p>x<p>y</div>")
    b = wrappers.page_wrapper("<div><h1>B</h1><ul><li>1<li>2</ul><p>x</div>")
    node = wrappers.merge(a, b)[wrappers.CHILDREN][0]
    parts = {c[wrappers.LABEL]: c for c in node[wrappers.CHILDREN]}
    assert list(parts) == ["h1", "ul", "p"]
    assert parts["ul"][wrappers.OPTIONAL] and not parts["p"][wrappers.OPTIONAL] and parts["p"][wrappers.REPEATED]
    assert parts["h1"][wrappers.TEXT] == -1


def test_empty_table(spark):
    assert extract(spark, []) == {}


def test_name_words_in_other_attributes_and_in_compounds_cut_nothing(spark):
    def page(i):
        return (f"<article><div class='entry-header'><h1>Title {i}</h1></div><div class='elementor-widget elementor-widget-text-editor'><p>Lead {i} with "
                f"<a href='/hidden-gems'>gems</a>, <a href=/view?id=share data-id='comments'>views</a> and <b hidden>none</b> more</div>"
                f"<p class='hidden-xs'>Small {i}</p><section class='related-work'>Work {i}</section><div class=share>Share this</div><div hidden>not {i}</div></article>")

    want = "Title {0}\n\nLead {0} with gems, views and more\n\nSmall {0}\n\nWork {0}"
    got = extract(spark, [(i, f"http://a.org/{i}", page(i)) for i in range(6)] + [(9, "http://one.org/", page(9))])
    assert {i: t for i, (t, _) in got.items()} == {i: want.format(i) for i in (*range(6), 9)}


def test_fixed_texts_of_a_host_are_left_out_and_do_not_choose_the_place(spark):
    def page(i, tag):
        return (f"<body><div class=c1><div class=x><p>{'The same on every page. ' * 40}</p><p>twice</p></div></div><{tag} class=c2><h1>Head {i}</h1>"
                f"<p>Story {i}</p><p>Read more at our place</p><p>End {i}</p></{tag}></body>")

    rows = [(i, f"http://a.org/{i}", page(i, "div")) for i in range(12)] + [(20 + i, f"http://b.org/{i}", page(i, "article")) for i in range(12)]
    copy = "<article><h1>News</h1><p>" + "</p><p>".join(f"Part {n} of a text" for n in range(8)) + "</p><p>{}</p></article>"
    rows += [(50, "http://c.org/1", copy.format("x")), (51, "http://c.org/2", copy.format("y")), (52, "http://c.org/1", copy.format("x"))]
    got = {i: t for i, (t, _) in extract(spark, rows).items()}
    assert all(got[i] == f"Head {i % 20}\n\nStory {i % 20}\n\nEnd {i % 20}" for i in (*range(12), *range(20, 32)))
    assert got[50] == got[52] and got[50].startswith("News\n\nPart 0 of") and got[51].endswith("Part 7 of a text\n\ny")


def test_descent_keeps_title_lead_and_further_sections(spark):
    forms = {
        "a": "<body><div class=content><h1>T{0}</h1><p>lead {0}</p><section class=body><p>" + "long {0} " * 40 + "</p><p>x{0}</p></section><section class=more><p>rest {0}</p></section></div></body>",
        "b": "<main><header><h1>T{0}</h1></header><p>lead {0}</p><article><p>" + "long {0} " * 40 + "</p></article></main><div class=ad>buy {0}</div>",
        "c": "<div role=main><header><h1>T{0}</h1></header><p>lead {0}</p><div><p>one {0}<p>two {0}</div></div><nav>n {0}</nav>",
        "d": "<body><article class=x><p>first {0}</article><article class=y><p>second {0}<p>third {0}</article><div class=box>y {0}</div></body>",
    }
    rows = [(10 * n + i, f"http://{host}.org/{i}", form.format(i)) for n, (host, form) in enumerate(forms.items()) for i in range(5)]
    rows += [(100 + n, f"http://single-{host}.org/", form.format(9)) for n, (host, form) in enumerate(forms.items())]
    got = {i: t for i, (t, _) in extract(spark, rows).items()}
    want = ["T{0}|lead {0}|" + " ".join(["long {0}"] * 40) + "|x{0}|rest {0}", "T{0}|lead {0}|" + " ".join(["long {0}"] * 40),
            "T{0}|lead {0}|one {0}|two {0}", "first {0}|second {0}|third {0}"]
    for n, w in enumerate(want):
        assert [got[10 * n + i] for i in range(5)] + [got[100 + n]] == [w.format(i).replace("|", "\n\n") for i in (*range(5), 9)]


def test_names_of_single_pages_do_not_enlarge_the_wrapper(spark):
    def page(i):
        name = "".join(chr(97 + (i * 7 + j * j * i) % 26) for j in range(9)) + "abcdefghijklmnopqrstuvwxyz"[i % 26] * (1 + i // 26)
        return (f"<body class=post{name}><div id={name} class='box css{name}'><h1>T{i}</h1></div><div class='content x{name}'><p>Text {i}<p>more {i}</div></body>")

    sizes = []
    for n in (8, 80):
        df = pages(spark, [(i, f"http://a.org/{i}", page(i)) for i in range(n)])
        (row,) = wrappers.host_wrappers(df.join(wrappers.host_facts(df), "host", "left")).collect()
        sizes.append(len(row.wrapper))
    assert sizes[1] < 1.3 * sizes[0]
    got = extract(spark, [(i, f"http://a.org/{i}", page(i)) for i in range(20)])
    assert all(got[i][0] == f"T{i}\n\nText {i}\n\nmore {i}" for i in range(20))


@pytest.mark.parametrize("box", ["section class=comments", "div class=replies", "ol id=discussion", "div class=x1"])
def test_lists_of_reader_comments_are_left_out(spark, box):
    def page(i, form):
        notes = "".join(f"<div class=item><b>user{i}{j}</b><p>I think {i} {j}</p></div>" for j in range(i % 4))
        return form.format(f"<h1>H{i}</h1>" + "".join(f"<p>Para {i} {k}</p>" for k in range(2 + i % 3)) + f"<{box}>{notes}</{box.split()[0]}>")

    rows = []
    for n, form in enumerate(("<body><nav>n</nav><article>{}</article></body>", "<body><nav>n</nav><div class=content>{}</div></body>", "<main>{}</main>")):
        rows += [(100 * n + i, f"http://h{n}.org/{i}", page(i, form)) for i in range(12)]
    for i, (got, _) in extract(spark, rows).items():
        assert got == "\n\n".join([f"H{i % 100}"] + [f"Para {i % 100} {k}" for k in range(2 + i % 100 % 3)])


def test_repeated_and_optional_parts_of_the_article_stay(spark):
    forms = {
        "a": lambda i: f"<article><h1>T{i}</h1><p>lead {i}</p>" + "".join(f"<section><h2>part {i} {k}</h2><p>text {i} {k}</p><p>more {i} {k}</p></section>" for k in range(i % 4)) + "</article>",
        "b": lambda i: f"<main class=x><h1>T{i}</h1><div class='layout has-sidebar'><p>one {i}</p><p>two {i}</p></div></main>",
        "c": lambda i: f"<article><h1>T{i}</h1><p>lead {i}</p><ul>" + "".join(f"<li>point {i} {k}<p>why {i} {k}</p></li>" for k in range(i % 3)) + f"</ul><p>end {i}</p></article>",
    }
    rows = [(100 * n + i, f"http://{host}.org/{i}", form(i)) for n, (host, form) in enumerate(forms.items()) for i in range(12)]
    got = extract(spark, rows)
    for i in range(12):
        assert got[i][0].split("\n\n") == [f"T{i}", f"lead {i}"] + [f"{w} {i} {k}" for k in range(i % 4) for w in ("part", "text", "more")]
        assert got[100 + i][0] == f"T{i}\n\none {i}\n\ntwo {i}"
        assert got[200 + i][0].split("\n\n") == [f"T{i}", f"lead {i}"] + [f"{w} {i} {k}" for k in range(i % 3) for w in ("point", "why")] + [f"end {i}"]


def test_alignment_equals_plain_recursion_and_long_lists_take_linear_time():
    def longest(a, b):
        @lru_cache(None)
        def most(i, j):
            if i == len(a) or j == len(b):
                return 0
            return max(most(i + 1, j), most(i, j + 1), (a[i] == b[j]) + most(i + 1, j + 1) if a[i] == b[j] else 0)

        return most(0, 0)

    dice = random.Random(1)
    for _ in range(60):
        a, b = ([dice.choice("pqrst") for _ in range(dice.randrange(12))] for _ in "ab")
        for small in (1 << 12, 6):
            pairs = wrappers._pairs(a, b, small)
            assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
            assert len(pairs) == longest(a, b) if small > 6 else len(pairs) <= longest(a, b)
    a = [dice.choice(["p", "div.a", "div.b", "h2", "ul", f"x{k}"]) for k in range(20000)]
    b = [label for label in a if dice.random() < 0.9]
    start = time.time()
    assert len(wrappers._pairs(a, b)) > 3000 and len(wrappers._pairs(a, a)) == 20000
    page = "<article>" + "".join(f"<{t}>w{k}</{t}>" for k, t in enumerate(dice.choices(["p", "h2", "pre", "div", "ul"], k=20000))) + "</article>"
    one, two = wrappers.page_wrapper(page), wrappers.page_wrapper(page.replace("<pre>", "<table>", 500))
    merged = wrappers.merge(one, two)
    assert time.time() - start < 30 and merged[wrappers.PAGES] == 2
    assert wrappers.extract(page, wrappers.article_paths(one)).count("\n\n") == 19999
