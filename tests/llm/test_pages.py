"""Page extraction: scores against the article elements of the test pages, odd pages, and the host suffix array by brute force."""

import collections
import html
import os
import random
import re

import pytest

PAGES = "/root/testdata/sf0.01/pages.parquet"


def article_blocks(page):
    """The blocks of a page's article element, taken by regular expressions: an account of its own."""
    inner = re.search(r"<article[^>]*>(.*?)</article>", page, re.DOTALL)
    if not inner:
        return []
    inner = re.sub(r"<(script|style|nav|form|aside|footer)\b.*?</\1>|<!--.*?-->", "", inner[1], flags=re.DOTALL)
    parts = re.split(r"</?(?:p|div|h[1-6]|ul|ol|li|section|blockquote|pre|table|tr|td|article)\b[^>]*>", inner)
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br\s*/?>", " ", x))).split()) for x in parts]
    return [x for x in texts if x]


def score(got, want):
    """(precision, recall) of words, as multisets."""
    a, b = collections.Counter(got.split()), collections.Counter(" ".join(want).split())
    both = sum((a & b).values())
    return both / max(1, sum(a.values())), both / max(1, sum(b.values()))


@pytest.mark.skipif(not os.path.exists(PAGES), reason="test tables are not there")
def test_scores_on_the_test_pages(spark):
    from orfloom.llm.html_text import extract_main_text

    pages = spark.read.parquet(PAGES)
    html_of = {x.page_id: x.html for x in pages.collect()}
    got = extract_main_text(pages).collect()
    assert len(got) == pages.count()
    scores = [score(x.text, article_blocks(html_of[x.page_id])) for x in got if "<article" in (html_of[x.page_id] or "")]
    assert len(scores) > 200 and min(p for p, _ in scores) > 0.9 and sum(p for p, _ in scores) / len(scores) > 0.99 and sum(r for _, r in scores) / len(scores) > 0.99
    assert all(x.n_chars == len(x.text) for x in got)


@pytest.mark.skipif(not os.path.exists(PAGES), reason="test tables are not there")
@pytest.mark.parametrize("change", ["article to div", "class names", "ids and wrappers"])
def test_scores_on_changed_pages(spark, change):
    """The test pages without their article element, with other class names, and with wrappers: precision and recall of words."""
    from orfloom.llm.html_text import main_text

    changes = {
        "article to div": lambda h: h.replace("<article", "<div").replace("</article", "</div"),
        "class names": lambda h: h.replace('class="ad"', 'class="box sponsored-2"').replace("class='ad'", "class='advert'"),
        "ids and wrappers": lambda h: h.replace("<p>", '<div class="share-price"><p id="related-1">').replace("</p>", "</p></div>"),
    }
    scores = []
    for x in spark.read.parquet(PAGES).collect():
        if "<article" in (x.html or ""):
            scores.append(score(main_text(changes[change](x.html)), article_blocks(x.html)))
    precision, recall = (sum(s[k] for s in scores) / len(scores) for k in (0, 1))
    assert len(scores) > 200 and precision > 0.99 and recall > 0.99, (precision, recall)


def test_odd_pages(spark):
    from orfloom.llm.html_text import extract_main_text, main_text

    deep = "<div>" * 6000 + "<nav>menu</nav><p>story</p>" + "</div>" * 6000
    assert main_text(deep) == "story"
    inside = "<article><div class='alert-level section-header'>kept</div><p id='header-note'>kept too</p><div class=ad>Buy</div><div class='top-ad box'>Buy</div><p>end</p></article>"
    assert main_text(inside) == "kept\nkept too\nend"
    assert main_text("<body><article>teaser</article><div><p>" + "main story " * 30 + "</p></div><div class='page-header'>top</div></body>") == "teaser\n" + ("main story " * 30).strip()
    # The marked part counts however short it is, and names inside it that only look like an advert's are text.
    assert main_text("<article><p>a short piece of six words</p></article><div>" + "loose text " * 45 + "</div>") == "a short piece of six words"
    assert main_text("<article>a bare piece</article><div>" + "loose text " * 45 + "</div>") == "a bare piece"
    for name in ("share-price", "related", "reply", "promo-box-a", "social", "widget-maker"):
        assert main_text(f"<article><p>one</p><div class='{name}'>two</div></article>") == "one\ntwo"
        assert name == "widget-maker" or main_text(f"<main><p>one</p></main><div class='{name}'>two</div>") == "one"
    for name in ("ad", "top-ad", "comments", "cookie", "newsletter", "promo"):
        assert main_text(f"<article><p>one</p><div class='{name}'>two</div></article>") == "one"
    long = "<p>" + "word " * 300_000 + "</p>"
    schema = "page_id long, url string, html string, text int, n_chars string, id int"
    rows = [(None, None, "<p>a</p>", 1, "x", 2), (1, "u", None, 1, "x", 2), (2, "u", long, 1, "x", 2), (2, "u", long, 1, "x", 2), (3, "u", "</div></p><b>x<i>y", 1, "x", 2)]
    got = extract_main_text(spark.createDataFrame(rows, schema))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((x.page_id or 0, x.n_chars) for x in got.collect()) == [(0, 1), (1, 0), (2, 1_499_999), (2, 1_499_999), (3, 2)]
    assert extract_main_text(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("window", [1, 3, 8])
def test_host_suffix_array(spark, window):
    from orfloom.llm.host_repeats import unique_text

    r = random.Random(window)
    menu = " ".join(f"m{i}" for i in range(12))
    rows = []
    for i in range(24):
        own = " ".join(f"w{r.randrange(40)}" for _ in range(30))
        rows.append((i, f"http://{'ab'[i % 2]}.example/{i}", f"<body><nav>{menu if i % 3 else 'x ' * 9}</nav><p>{own}</p><p>{own[:40]}</p><script>no</script></body>"))
    rows += [(50, None, None), (51, "http://a.example:80/", ""), (3, rows[3][1], rows[3][2])]
    from orfloom.llm.html_text import page_blocks

    words = {row: " ".join(t for _, t in page_blocks(row[2] or "")).split(" ") for row in set(rows)}
    host = lambda row: (row[1] or "").split("//")[-1].split("/")[0].split(":")[0]
    seen = collections.defaultdict(set)
    for row, w in words.items():
        for k in range(len(w) - window + 1):
            seen[host(row), tuple(w[k : k + window])].add(row)
    want = []
    for row in rows:
        w = words[row]
        gone = {k + j for k in range(len(w) - window + 1) if len(seen[host(row), tuple(w[k : k + window])]) > 1 for j in range(window)}
        want.append((row[0], [x for k, x in enumerate(w) if k not in gone and x]))
    got = [(x.page_id, x.text.split()) for x in unique_text(spark.createDataFrame(rows, "page_id long, url string, html string"), window).collect()]
    assert sorted(got) == sorted(want)
