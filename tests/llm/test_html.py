"""Page furniture, suffix arrays and repeated runs against plain versions."""

import random
from collections import defaultdict

import numpy as np
import pytest

from sparkloom.llm import html_text

TEXT = "<p>one two three.</p><p>four five six seven eight nine</p>"
BLOCKS = ["one two three.", "four five six seven eight nine"]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<article class="has-sidebar">{TEXT}</article>', BLOCKS),
        (f'<div class="no-sidebar">{TEXT}</div>', BLOCKS),
        (f'<div class="header-wrap content">{TEXT}</div>', BLOCKS),
        (f'<div class="menu"><nav>a</nav>{TEXT}</div>', BLOCKS),  # it holds the page
        (f'<main class="post with-comments">{TEXT}</main>', BLOCKS),
        (f'<form action="x"><nav>menu</nav><article>{TEXT}</article></form>', BLOCKS),
        (f"<body><form>{TEXT}<input><label>Name</label></form>", BLOCKS),
        (f'<div class="sidebar"><main>{TEXT}</main></div>', BLOCKS),
        (f'<article>{TEXT}<p class="notice">A notice.</p></article>', [*BLOCKS, "A notice."]),
        (f'<article>{TEXT}<section id="related-work"><h2>Related work</h2></section></article>', [*BLOCKS, "Related work"]),
        (f"<article><header><h1>T</h1><p>Lead</p></header>{TEXT}<p><math><mi>a</mi><mo>=</mo></math></p></article>", ["T", "Lead", *BLOCKS, "a="]),
        (f'<article>{TEXT}<div class="comments"><p>{"nice " * 99}</p></div><div class="cookie-notice">Ok?</div><div class="ad">Buy</div></article>', BLOCKS),
        (f'<header>Site</header><div class="site-header">x</div>{TEXT}<section class="comments"><article class="comment-body">{"nice " * 99}</article></section>', BLOCKS),
        (f'<div id="mainNav">a</div><div role="navigation">b</div><aside>c</aside><footer>d</footer>{TEXT}<p class="cookie-notice">e</p><p hidden>f</p><p style="display: none">g</p>', BLOCKS),
        (f'{TEXT}<p title="the hidden gem" class="a">seen</p>', [*BLOCKS, "seen"]),
        (f'<article class="related">Teaser</article><article>{TEXT}</article>', BLOCKS),
        ('<article class="comment">only this</article>', ["only this"]),
        (f"<article> </article><div>{TEXT}</div>", BLOCKS),
        (f'<div class="post-body"><h1>T</h1>{TEXT}</div><article class="card"><a href="a">Read this</a></article><article class="card"><a href="b">And this one too</a></article>', ["T", *BLOCKS]),
        (f'<div>{TEXT}</div><article class="card"><a href="a">Next</a> a summary</article>', [*BLOCKS, "Next a summary"]),
        (f'<div>{TEXT}</div><article><a href="next">Read next</a></article>', BLOCKS),
        ('<article><a href="x">only a link</a></article>', ["only a link"]),
        (f'<article>{TEXT}<div class="discussion"><p>{"no " * 50}</p></div><div id="responses">x</div><div class="adv-box">buy</div></article>', BLOCKS),
        (f"<article>{TEXT}<p>Use <label>this word</label> and that.</p></article>", [*BLOCKS, "Use this word and that."]),
        (f'<div class="ad">{"buy " * 40}</div><article>{TEXT}</article>', BLOCKS),
        ("", []),
        ("<article><nav>no text", []),
    ],
)
def test_blocks(page, want):
    assert html_text.blocks(page)[0] == want


def test_suffix_array():
    rng = random.Random(4)
    for n in (0, 1, 2, 50, 300):
        flat = [rng.randint(0, 2) for _ in range(n)] + [-1]
        array, common = html_text.suffixes(np.array(flat), 16)
        cut = [flat[i : i + 16] for i in array]
        assert sorted(array.tolist()) == list(range(n + 1)) and cut == sorted(cut)
        for k in range(1, n + 1):
            a, b = flat[array[k - 1] :], flat[array[k] :]
            same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert common[k] == min(same, common[k]) and (common[k] == same or common[k] >= 16)


def test_shared_runs():
    a, b = "x y z one two three four".split(), "one two three four five".split()
    got = [html_text._cover(s, len(s), 4).tolist() for s in html_text.shared([1, 2], [a, b], 4)]
    assert got == [[1, 1, 1, 2, 2, 2, 2], [2, 2, 2, 2, 1]]
    assert html_text.shared([1, 1], [a, a], 4)[0].max() == 1  # one page twice is one page
    assert html_text.shared([], [], 8) == []
    rng = random.Random(2)
    streams = [[rng.choice("abc") for _ in range(rng.randint(0, 40))] for _ in range(30)]
    got = html_text.shared(list(range(30)), streams, 5)
    pages = defaultdict(set)
    for p, s in enumerate(streams):
        for i in range(len(s)):
            pages[tuple(s[i : i + 5]), len(s) - i < 5 and p].add(p)
    for p, s in enumerate(streams):
        assert [len(pages[tuple(s[i : i + 5]), False]) for i in range(len(s) - 4)] == got[p].tolist()[: max(0, len(s) - 4)]


def plain(texts, length=8, few=3):
    """The texts of one host without the blocks at their edges whose every run of tokens many distinct texts have."""
    on, distinct = defaultdict(set), set(texts)
    for t in distinct:
        w = t.split()
        for i in range(len(w) - length + 1):
            on[tuple(w[i : i + length])].add(t)
    least = max(few, -(-len(distinct) * 2 // 100))
    out = []
    for t in texts:
        w = t.split()
        many = [any(len(on[tuple(w[i : i + length])]) >= least for i in range(max(0, j - length + 1), min(j, len(w) - length) + 1)) for j in range(len(w))]
        blocks, whole, at = t.split("\n\n"), [], 0
        for b in blocks:
            n = len(b.split())
            whole.append(all(many[at : at + n]))
            at += n
        gone = {i for i in range(len(blocks)) if all(whole[: i + 1]) or all(whole[i:])}
        if 2 * sum(len(blocks[i].split()) for i in gone) > len(w):
            gone = set()
        out.append("\n\n".join(b for i, b in enumerate(blocks) if i not in gone))
    return out


def test_a_host_of_many_pages_equals_a_plain_count(spark):
    rng = random.Random(9)
    lines = [" ".join(f"s{k}w{i}" for i in range(11)) for k in range(6)]
    texts = []
    for i in range(1024):
        own = " ".join(rng.choice(["red", "blue", "green", f"own{i}"]) for _ in range(rng.choice([5, 30, 60])))
        some = [s for k, s in enumerate(lines) if i % (k + 2) == 0]
        texts.append("\n\n".join([*some[:2], own, *some[2:3], f"the middle of page {i}", *some[3:]]))
    rows = [(i, f"http://hot.example/{i}", "".join(f"<p>{b}</p>" for b in t.split("\n\n"))) for i, t in enumerate(texts)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = dict(enumerate(plain(texts)))
    assert sum(want[i] != t for i, t in enumerate(texts)) > 200
    for group in (20_000, 600_000):
        assert {r.page_id: r.text for r in html_text.extract(pages, group_chars=group).collect()} == want


@pytest.mark.parametrize("words", [60, 97, 101, 300])
def test_near_copies_without_article_stay(spark, words):
    body = " ".join(f"w{i}" for i in range(words))
    rows = [(i, f"http://m.example/{i}", f"<p>Copy {i}</p><p>{body}</p>") for i in range(5)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"Copy {i}\n\n{body}" for i in range(5)}


def test_quotations_stay_and_edges_go(spark):
    quote = " ".join(f"q{i}" for i in range(30))
    own = lambda i, n: " ".join(f"p{i}w{k}" for k in range(n))
    top, end = "All of these words stand at the top of each page here", "And these words are what every page of the host ends with"
    pages = [f"<div>{top}</div><p>{own(i, 50)}</p><blockquote>{quote}</blockquote><p>{own(i + 100, 50)} {quote}</p><div>{end}</div>" for i in range(4)]
    rows = [(i, f"http://q.example/{i}", p) for i, p in enumerate(pages)] + [(9, "http://other.example/", pages[0])]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: got[i] for i in range(4)} == {i: f"{own(i, 50)}\n\n{quote}\n\n{own(i + 100, 50)} {quote}" for i in range(4)}
    assert got[9].startswith(top) and got[9].endswith(end)


def test_parts_hold_all_that_a_reader_sees():
    page = f'<head><title>T</title></head><nav>Menu</nav><p hidden>no</p><div>beside</div><article>{TEXT}{TEXT}<aside>See <b>too</b></aside></article><script>x</script><footer>&copy; F</footer>'
    assert html_text.parts(page) == (BLOCKS * 2, ["Menu", "beside", "See too", "\u00a9 F"], True)
    assert html_text.parts(f"<nav>Menu</nav><div>{TEXT}<button>Go</button> on</div>") == ([*BLOCKS, "on"], ["Menu", "Go"], False)


def test_what_pages_with_articles_repeat_goes_from_a_page_without_one(spark):
    menu, seldom = "Home and news and sport and weather and all the rest of this site", "Read too what stands below these words on some few of the pages"
    own = lambda i, n: " ".join(f"p{i}w{k}" for k in range(n))
    quoted = f"<p>{own(99, 12)}</p>"  # every article has it
    pages = [f"<div>{menu}</div><article><h1>{own(i, 9)}</h1>{quoted}<p>{own(i + 100, 40)} {menu}</p></article>" + f"<aside>{seldom}</aside>" * (i < 4) for i in range(10)]
    bare = f"<div>{menu}</div>{quoted}<p>{own(50, 60)}</p><p>{seldom}</p>"
    rows = [(i, f"http://h.example/{i}", p) for i, p in enumerate([*pages, bare, bare])] + [(20, "http://other.example/", bare)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    for group in (1, 300, 600_000):
        got = {r.page_id: r.text for r in html_text.extract(table, group_chars=group).collect()}
        assert {i: got[i] for i in range(10)} == {i: f"{own(i, 9)}\n\n{own(99, 12)}\n\n{own(i + 100, 40)} {menu}" for i in range(10)}
        assert got[10] == got[11] == f"{own(99, 12)}\n\n{own(50, 60)}\n\n{seldom}"  # 4 of 11 texts are no half
        assert got[20] == f"{menu}\n\n{got[10]}"


def test_unclosed_elements_take_linear_time():
    import time

    start = time.time()
    html_text.blocks("<div>" + "<b>x" * 60_000 + "</i>" * 60_000 + "<p>y" * 60_000)
    assert time.time() - start < 20
