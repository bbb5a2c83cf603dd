"""Main text and licences: brute force, recall, whole licences, and long or broken texts in a time that grows with their length."""

import random
import re
import time
from collections import Counter

import pyarrow.parquet as pq
import pytest

from tesserae.llm import html_text as H
from tesserae.llm import license_scan as L


def test_region_is_the_maximum_of_all():
    rng = random.Random(8)
    for _ in range(300):
        worth = [rng.choice([-1.5, -0.5, -0.25, 0.0, 0.5, 1.0, 3.0]) for _ in range(rng.randint(0, 30))]
        a, b = H.best_region(worth)
        sums = [sum(worth[i:j]) for i in range(len(worth)) for j in range(i + 1, len(worth) + 1)]
        assert sum(worth[a:b]) == max([0.0, *sums])
    assert H.best_region([]) == H.best_region([-1.0, 0.0]) == (0, 0)
    assert H.best_region([1.0, -1.0, 1.0]) == (0, 1)  # the first of equal ones


def test_page_without_markers_keeps_its_article(sf_dir):
    pages = [x for x in pq.read_table(f"{sf_dir}/pages.parquet")["html"].to_pylist() if x and "<article" in x]
    half = len(pages) // 2
    counts = Counter()
    for x in pages[:half]:
        counts.update(H.count_types(x))
    weights = H.weights_from(counts)
    found = wanted = kept = 0
    for x in pages[half:]:
        gold = Counter(re.sub(r"<[^>]*>", " ", re.search(r"(?s)<article>(.*)</article>", x)[1]).replace("&amp;", "&").split())
        got = Counter(H.main_text(re.sub("</?article>", "", x), weights).split())
        found, wanted, kept = found + (gold & got).total(), wanted + gold.total(), kept + got.total()
    assert found / wanted >= 0.95 and found / kept >= 0.9


def test_quotes_only_begin_values():
    page = "<article><p title=it's>one</p><p>two</p><p data-x='a>b' title=\"c>d\" e=f'g>three</p><p it's>four</p></article>"
    assert H.main_text(page, H.DEFAULT) == "one two three four"
    assert [m[2:4] for m in H.markup('<a href="x>y"></a><B CLASS=z/><br/>')] == [("a", False), ("a", True), ("b", False), ("br/", False)][:3] + [("br", False)]
    assert H.main_text('<article><p title="never closed>one two three</p><p>four</p></article>', H.DEFAULT) == "one two three four"


NAMED = {
    "no-sidebar share-enabled ad-free has-comments related-work market-share content-sidebar-wrap sidebar-main sidebar-layout menu-planning search-results menu-open post entry-content": False,
    "ad ad-1 adBox google-ads site-header content-header cookie-notice post-comments comment-12 share-buttons related-posts header-ad-slot main_menu user-comments sidebar-left widget-area": True,
}


@pytest.mark.parametrize("name,out", [(x, out) for names, out in NAMED.items() for x in names.split()])
def test_names_that_are_left_out(name, out):
    assert H._named_out(name) == out
    page = f'<body><div class="x {name}"><p>Some words stand here.</p></div></body>'
    assert H.main_text(page, H.DEFAULT) == ("" if out else "Some words stand here.")


LAYOUTS = {
    '<div class="layout no-sidebar"><article><p>one two three</p></article></div>': "one two three",
    '<div class="sidebar"><article><p>one two three</p></article></div>': "one two three",
    '<form id="page"><div><main><p>one two three</p></main></div></form>': "one two three",
    '<article class="post share-enabled"><p>one two</p></article>': "one two",
    '<article><p>one</p><p aria-label="share price">two</p><section id="related-work"><h2 id="search">three</h2><p>four</p></section></article>': "one two three four",
    "<article><p>one</p>" + "<p><a href=x>link</a></p>" * 30 + "<p>last</p></article>": "one" + " link" * 30 + " last",
    '<article><p>one two</p><ol class="comment-list"><li><article class="comment">bad words</article></li></ol><p>three</p></article>': "one two three",
    '<article><p>one two three</p></article><aside><article><p>teaser</p></article></aside>': "one two three",
    '<article><pre><code>x = 1 <span class="comment"># why</span></code></pre></article>': "x = 1 # why",
    '<article><p hidden>no</p><p style="DISPLAY: none">no</p><p>one</p><div role="navigation">no</div><p>two</p></article>': "one two",
    '<div class="menu"><a href=x>one</a></div><div class="cookie-notice">two</div>': "",
}


@pytest.mark.parametrize("page", LAYOUTS)
def test_layouts_that_hold_an_article(page):
    for weights in (H.DEFAULT, H.DEFAULT | {"t:p": -1.5, "t:a": -1.5, "w:link": -1.0}):
        assert H.main_text(page, weights) == LAYOUTS[page]


def test_recall_within_layouts(sf_dir):
    """Given pages inside wrappers that layouts use, with insets around and after the article: no page loses its text."""
    found = wanted = kept = 0
    wrappers = ["layout no-sidebar", "content-sidebar-wrap", "header-fixed menu-open", "sidebar-layout", "site has-comments"]
    for k, x in enumerate(x for x in pq.read_table(f"{sf_dir}/pages.parquet")["html"].to_pylist() if x and "<article" in x):
        inner = re.search(r"(?s)<article>(.*)</article>", x)[1]
        gold = Counter(re.sub(r"<[^>]*>", " ", re.sub(r'(?s)<div class="ad">.*?</div>', " ", inner)).replace("&amp;", "&").split())
        page = f"<body class='{wrappers[k % 5]}'><div class='site-header'>Zzz zzz</div><div class='{wrappers[k % 5]}'><article class='post share-enabled'>{inner}</article>"
        page += "<div class='related-posts'>Qqq qqq</div><div id='comments'>" + "<p>Www www www</p>" * 20 + "</div></div><div class='cookie-notice'>Vvv vvv</div></body>"
        got = Counter(H.main_text(page, H.DEFAULT).split())
        assert got and not {"Zzz", "Qqq", "Www", "Vvv"} & set(got)
        found, wanted, kept = found + (gold & got).total(), wanted + gold.total(), kept + got.total()
    assert found / wanted >= 0.95 and found / kept >= 0.95


HOSTILE = {
    "quotes": '<p a="x' * 140_000, "deep": "<div>" * 200_000, "mixed": "<b><div></b>" * 90_000, "angles": "<" * 1_000_000, "comments": "<!--" * 250_000,
    "scripts": "<script>" * 125_000, "closings": "</x>" * 250_000, "equals": "<p " + "=" * 1_000_000, "blanks": "<p =" + " " * 1_000_000, "entities": "&amp" * 250_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_broken_page_takes_linear_time(name):
    began = time.process_time()
    assert isinstance(H.main_text(HOSTILE[name], H.DEFAULT), str)
    assert time.process_time() - began < 10


def test_pages_repeated_empty_and_clashing(spark):
    page = "<article><p>Some words here.</p></article>"
    rows = [(1, page, "x", 1), (1, page, "x", 1), (2, "", "x", 2), (None, None, None, 3), (3, "<nav>a</nav>", "x", 4)]
    df = spark.createDataFrame(rows, "page_id bigint, html string, main_text string, inside int")
    got = H.extract(df).collect()
    assert sorted((r.page_id or 0, r.main_text, r.inside) for r in got) == [(0, "", 3), (1, "Some words here.", 1), (1, "Some words here.", 1), (2, "", 2), (3, "", 4)]


MIT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the
software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and
to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be
included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not
limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for
any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other
dealings in the software"""


def test_whole_licences_as_templates(spark):
    template = ("expat", " ".join(MIT.split()), "fitness for a particular purpose and noninfringement")
    words = MIT.split()
    changed = " ".join(w if i % 9 else "other" for i, w in enumerate(words))
    rows = [(1, "Copyright X. " + MIT.upper() + " The end."), (2, " ".join(words[:40])), (3, "fitness for a particular purpose and noninfringement"), (4, changed), (5, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in L.scan(df, templates=[*L.TEMPLATES, template]).collect()}
    assert "expat" in got[1].lic_labels and got[1].lic_score == pytest.approx(1.0)
    assert "expat" not in got[2].lic_labels and got[3].lic_labels == "" and got[5].lic_labels == ""
    whole = L.scan(spark.createDataFrame([(1, MIT.replace("the rights", "some rights"))], "doc_id bigint, text string"), templates=[template]).first()
    assert whole.lic_labels == "expat" and 0.9 < whole.lic_score < 1
    with pytest.raises(ValueError):
        L.scan(df, templates=[("x", "a b", "c")])


def test_long_licence_text_takes_linear_time(spark):
    text = "gnu general public license " * 40_000  # about 1 MB
    df = spark.createDataFrame([(1, text, "kept", "old"), (1, text, "kept", "old")], "doc_id bigint, text string, w string, lic_labels string")
    L.scan(df.limit(0)).collect()
    began = time.time()
    got = L.scan(df).select("lic_n_words", "lic_n_base", "lic_first_word", "lic_last_word", "lic_labels", "w").collect()
    assert time.time() - began < 30
    assert got == [(160_000, 40_000, 1, 159_997, "gpl", "kept")] * 2


def test_licence_places_against_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [*"mit license apache general public gnu lesser the x".split(), "MIT", "İ", "1"]
    texts = [rng.choice([" ", "\n", "/"]).join(rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(200)]
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t))
        places = sorted(p for phrase in L.PHRASES for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split())
        labels = {label for phrase, label in L.PHRASES.items() if any(w[p : p + len(phrase.split())] == phrase.split() for p in range(len(w)))}
        assert (got[i].lic_n_words, got[i].lic_n_base, got[i].lic_base_labels) == (len(w), len(places), ",".join(sorted(labels)))
        assert (got[i].lic_first_word, got[i].lic_last_word) == ((places[0], places[-1]) if places else (None, None))
