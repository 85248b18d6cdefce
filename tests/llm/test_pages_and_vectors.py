"""HTML extraction on written pages; vector links against brute force."""

import numpy as np
import pytest

from tracemill.llm import html_extract, near_vectors


def page(host, i, body):
    return (i, f"https://{host}/{i}", body)


ARTICLE = "<h1>Title &amp; more</h1><p>First <b>bo</b>ld line.<p>Second<br>line &eacute;&#33;<ul><li>one<li>two</ul>"
PAGES = [
    page("a.example", 1, f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href=x>Home</a></nav><div class='ad'>Buy</div><article>{ARTICLE}</article><footer>f</footer></body></html>"),
    page("A.example", 2, f"<body><div id='cookie-notice'>We use</div><div class='menu'>m</div><div class='post post-17 body'>{ARTICLE}<aside>side</aside><form><input>send</form><div class='comments'><p>nice!<p>no</div></div><script>var x='<p>'</script>"),
    page("b.example", 3, f"<body><div class='post-3'><section class='content'>{ARTICLE}</section></div><div class='sidebar widget'>w <p>{'more text here ' * 40}</div>"),
    page("b.example", 4, "<body><div class='post-9'><section class='content'><p>x</p></section></div><div class='links'><p>" + "long other text " * 60 + "</div>"),
    page("b.example", 5, f"<body><div class='post-8'><section class='content'>{ARTICLE} tail</section></div>"),
    page("b.example", 6, f"<body><div class='post-8'><section class='content'>{ARTICLE} tail again</section></div>"),
]
TEXT = "Title & more First bold line. Second line é! one two"


def test_pages(spark):
    odd = [(7, None, None), (8, "no url", ""), (None, "https://b.example/x", "plain words &lt;"), (9, "https://c.example", "<div>" * 3000 + "deep"), (9, "https://c.example", "<!-- open"), (10, "::", "<p>a<p>b</i>c<")]
    rows = [(*r, "x", 1) for r in PAGES + odd]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, path int").repartition(3)
    got = html_extract.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = [(r.page_id, r.text) for r in got.collect()]
    by_id = dict(found)
    assert len(found) == len(rows) and by_id[1] == TEXT and by_id[2] == TEXT and by_id[3] == TEXT
    assert by_id[4] == " ".join(("long other text " * 60).split())  # the host's container holds next to nothing here
    assert by_id[5] == TEXT + " tail" and by_id[7] == "" and by_id[8] == "" and by_id[None] == "plain words <"
    assert sorted(t for i, t in found if i == 9) == ["", "deep"] and by_id[10] == "a bc<"
    assert all(r.n_chars == len(r.text) for r in got.collect()) and html_extract.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["content with-sidebar", "no-sidebar", "main-content has-sidebar", "post legal", "lead alert", "share-your-story", "sidebar", "comments-open"])
def test_a_wrapper_of_the_text_is_not_noise(name):
    text = "plain words of the text " * 20
    for body in (f"<article>{text}</article>", text) if name != "comments-open" else (f"<article>{text}</article>",):
        page = html_extract.Page(f"<body><div class='menu'>m</div><div id=page class='{name}'>{body}</div><div class='ad'>Buy</div>")
        assert page.text(None) == text.strip()


def test_headers_of_the_text_stay_and_texts_beside_it_go():
    long = "many words of readers " * 40
    for name in ("entry-header", "article-header"):
        assert html_extract.Page(f"<article><div class='{name}'><h1>Title</h1></div><p>first line</article>").text(None) == "Title first line"
    beside = f"<div id=comments><article class=comment>{long}</article></div><div class='related posts'><article>teaser</article></div>"
    assert html_extract.Page(f"<body><main><article><p>the first line of the text{beside}</article></main>").text(None) == "the first line of the text"
    assert html_extract.Page(f"<body><p>the first line<div class=comments>{long}</div>").text(None) == "the first line"
    assert html_extract.Page(f"<body><p>the first line<div class=sidebar hidden>{long}</div>").text(None) == "the first line"


def test_a_page_of_a_second_template_keeps_its_text(spark):
    long = "words of the second template " * 20
    first = [page("t.example", i, f"<body><div class=story><p>{long} {i}</div>") for i in range(5)]
    second = [page("t.example", i, f"<body><div class=story>box</div><section class=text><p>{long} {i}</section>") for i in range(10, 13)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(first + second, "page_id long, url string, html string")).collect()}
    assert got == {i: " ".join(f"{long} {i}".split()) for i, _, _ in first + second}


SHAPES = {
    "article": "<article>{}</article>",
    "main": "<main>{}</main>",
    "main article": "<main id=main><article class=post>{}</article></main>",
    "div": "<div class=content>{}</div>",
    "nested": "<div id=page class=has-sidebar><div class='wrap'><section class='entry-content'>{}</section></div></div>",
    "cell": "<table><tr><td class=left><a href=x>l</a></td><td class=text>{}</td></tr></table>",
    "body": "{}",
}
BESIDE = [
    "post-comments", "article-comments", "user-comments", "comment-list", "entry-share", "site-footer", "article-footer", "post-nav", "main-nav",
    "left-sidebar", "inline-ad", "google-ads", "site-header", "related-posts", "newsletter-box", "cookie-notice", "share_buttons", "post-pagination",
]


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("name", BESIDE)
def test_noise_inside_and_beside_the_container_goes(shape, name):
    lines = [f"Line {i} of the article with some words in it." for i in range(8)]
    noise = f"<div class='{name}'><p>text that is no part of it</p><ul><li><a href=y>more</a></ul></div>"
    inner = "<h1>The title</h1>" + "".join(f"<p>{x}</p>" + (noise if i in (2, 7) else "") for i, x in enumerate(lines))
    source = f"<html><body><nav>n</nav>{noise}{SHAPES[shape].format(inner)}{noise}<footer>f</footer></body></html>"
    got = html_extract.Page(source).text(None)
    assert got == " ".join(["The title", *lines])


def test_titles_leads_and_halves_beside_the_container_stay():
    text = "words of the text in its container " * 10
    for body in (f"<h1>Title</h1><p>A lead.</p><div class=content><p>{text}</p></div>", f"<div class=page><h1>Title</h1><p>A lead.</p><article><p>{text}</p></article></div>"):
        assert html_extract.Page(f"<body><p>above</p>{body}<div class=menu>m</div></body>").text(None) == f"Title A lead. {text.strip()}"
    for open_, close in (("<body>", "</body>"), ("", ""), ("<body><div class=page>", "</div>")):
        halves = f"<div class=start><p>{text}</p></div><div class=rest><p>{text[:-70]}</p></div>"
        assert html_extract.Page(f"{open_}{halves}{close}").text(None) == f"{text.strip()} {text[:-70].strip()}"
    two = f"<h1>Site</h1><h1>Other</h1><div class=content><p>{text}</p></div>"
    assert html_extract.Page(f"<body>{two}</body>").text(None) == text.strip()
    assert html_extract.Page(f"<body class=no-comments><div class='no-comments post'><p>{text}</div></body>").text(None) == text.strip()


def test_a_page_alone_with_its_template_keeps_its_text(spark):
    long = "words of the template " * 20
    rows = [page("t.example", i, f"<body><div class=story><p>{long} {i}</div>") for i in range(5)]
    rows.append(page("t.example", 9, f"<body><div class=story>box</div><section class=text><p>{long} nine</section>"))
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: " ".join(f"{long} {'nine' if i == 9 else i}".split()) for i, _, _ in rows}


def test_given_pages_keep_their_article(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    for row in pages.collect():
        inner = re.sub(r"<!--.*?-->", "", re.search(r"<article>(.*?)(?:</article>|$)", row.html, re.S)[1], flags=re.S)
        assert got[row.page_id] == " ".join(html.unescape(re.sub(r"<(?:/?b)>", "", re.sub(r"</?(?:p|br|h1)>", " ", inner))).split())


def brute(rows, threshold):
    good = [(i, x, np.array(v)) for i, v, x in rows if i is not None and x is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links, root = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}
    for k, (i, x, v) in enumerate(good):
        for j, y, w in good[:k]:
            if x == y and len(v) == len(w) and v @ w / (np.sqrt(v @ v) * np.sqrt(w @ w)) >= threshold:
                links[i] += 1
                links[j] += 1
                low, high = sorted((root[i], root[j]))
                root = {n: low if r == high else r for n, r in root.items()}
    return {i: (links[i], root[i], root[i] == i if i is not None else True) for i, _, _ in rows}


@pytest.mark.parametrize("shard", [1000, 40])
def test_vector_links(spark, monkeypatch, shard):
    monkeypatch.setattr(near_vectors, "SHARD", shard)
    rng = np.random.default_rng(4)
    rows, i = [], 100
    for label in (0, 1, -3):
        for center in rng.normal(size=(60, 12)):
            for _ in range(int(rng.integers(1, 6))):
                rows.append((i, (center + rng.normal(size=12) * rng.choice([0.01, 0.08, 0.2])).tolist(), label))
                i += 1
        middle = rng.normal(size=12)  # a star: copies are near its middle, hardly near each other
        rows += [(i + k, (middle + (0 if k == 0 else rng.normal(size=12) * 0.13)).tolist(), label) for k in range(90)]
        i += 90
    same = rows[5][1]
    rows += [(i + k, same, 0) for k in range(40)]
    rows += [(1, None, 0), (2, [], 0), (3, [0.0] * 12, 0), (4, [float("nan"), *same[1:]], 0), (5, [None, *same[1:]], 0), (6, same, None), (7, same[:5], 0), (8, [2 * x for x in same], 0), (9, [float("inf"), *same[1:]], 0)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, node int, home string").repartition(3)
    found, audit = near_vectors.link(table)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found.collect()}
    want = brute(rows, near_vectors.THRESHOLD)
    assert audit.first().recall >= near_vectors.RECALL and len(got) == len(rows)
    assert sum(g[0] for g in got.values()) >= 0.97 * sum(w[0] for w in want.values()) and all(got[k][0] <= want[k][0] for k in want)
    if shard == 1000:
        assert got == want
    assert near_vectors.link(table.limit(0))[0].count() == 0


def test_the_driver_gets_no_vectors_of_labels_of_one_shard_and_few_of_others(spark, monkeypatch):
    seen, fitted = [], near_vectors.centroids
    monkeypatch.setattr(near_vectors, "SHARD", 200)
    monkeypatch.setattr(near_vectors, "centroids", lambda vectors, *rest: seen.append(len(vectors)) or fitted(vectors, *rest))
    vectors = np.random.default_rng(3).normal(size=(1000, 8)).tolist()
    rows = [(i, v, label) for i, (v, label) in enumerate(zip(vectors + vectors[:100] * 2, [0] * 1000 + [1] * 100 + [2] * 100, strict=True))]
    found, audit = near_vectors.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert audit.first().recall >= near_vectors.RECALL and found.count() == 1200
    assert len(seen) == 1 and 5 <= seen[0] < 500


def test_thousands_of_labels_and_labels_of_text(spark):
    vectors = np.random.default_rng(6).normal(size=(2000, 6))
    rows = [(2 * i + k, (v * (k + 1)).tolist(), f"label {i}") for i, v in enumerate(vectors) for k in (0, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    found, audit = near_vectors.link(table)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found.collect()}
    assert got == {i: (1, i - i % 2, i % 2 == 0) for i in range(4000)} and audit.first().recall == 1.0


def test_pruned_lists_keep_no_neighbour_behind_a_closer_one():
    vectors = near_vectors.unit(np.random.default_rng(1).normal(size=(300, 8)))
    lists = near_vectors.pruned_lists(vectors)
    assert all(i in lists[j] for i, near in enumerate(lists) for j in near) and all(len(x) for x in lists)
    assert near_vectors.pruned_lists(vectors[:1])[0].size == 0
