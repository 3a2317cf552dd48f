import html
import random
import re
import time

import pytest

from amperflow.llm import webtext as W

SAMPLE = "/root/testdata/sf0.001"


def page(k, body, menu="home"):
    return f'<!DOCTYPE html><html lang="en"><head><title>T {k}</title><style>p{{margin:0}}</style><script>var t="</p><p>no</p>";</script></head><body><nav><ul><li><a href="/{k}">{menu} {k}</a></li></ul></nav><!-- ad <p>x</p> --><div class="ad">buy {k}</div><article><h1>Head {k}</h1>{body}</article><footer>&copy; {k}</footer></body></html>'


def test_parts_and_references():
    texts = W.main_texts([page(1, "<p><b>One &amp; <i>two</i>\n three.<br><p>Next&nbsp;&#233; <a href='x>y'>link</a>.</p>"), None, "", page(2, "<p>Other</p><ul><li>a<li>b</ul><div class='comments'><p>reader</p></div><form><p>f</p></form><aside>s</aside>")])
    assert texts == ["Head 1\n\nOne & two three.\n\nNext é link.", "", "", "Head 2\n\nOther\n\na\n\nb"]


def test_constant_block_is_template_but_copies_are_not():
    pages = [page(k, f"<p>Text number {k} with words {k * 7}.</p><p>Read our terms.</p>") for k in range(9)]
    assert W.main_texts(pages)[3] == "Head 3\n\nText number 3 with words 21."
    copies = [page(1, "<p>The same story.</p>") for _ in range(9)]
    assert W.main_texts(copies) == ["Head 1\n\nThe same story."] * 9
    near = [page(1, f"<p>The same long story, told again and again and again.</p><p>{k}</p>") for k in range(9)]
    assert all("The same long story" in t for t in W.main_texts(near))


def test_pages_without_article():
    pages = [f'<html><body><div id="top">Site name</div><div class="x"><div><p>Story {k} begins here and goes on.</p><p>More of story {k}.</p></div></div><div class="sidebar">n{k}</div></body></html>' for k in range(6)]
    assert W.main_texts(pages)[2] == "Story 2 begins here and goes on.\n\nMore of story 2."


def test_names_that_only_hint_keep_their_text():
    inner = '<div class="related-work"><p>Others found {k} before.</p></div><section class="search-methods"><p>We searched {k} times.</p></section><div class="share-price"><p>It cost {k}.</p></div>'
    links = '<div class="related-reading"><a href="/x{k}">One more {k}</a> <a href="/y">another</a></div><div class="comment-list"><p>Nice {k}</p></div><div class="cookie-banner">We use cookies {k}</div><div id="sidebar-left">n{k}</div>'
    texts = W.main_texts([page(k, f"<p>Text {k}.</p>" + inner.format(k=k) + links.format(k=k)) for k in range(7)])
    assert texts[3] == "Head 3\n\nText 3.\n\nOthers found 3 before.\n\nWe searched 3 times.\n\nIt cost 3."
    assert W.named_outside("page with-sidebar") is False and W.named_outside("site-footer") is True and W.named_outside("share-price") is None


def best_match(a, b):
    """The size of the largest order-preserving match of two ordered trees whose roots are equal, by trying all."""
    if a[0] != b[0]:
        return 0

    def rows(x, y):
        if not x or not y:
            return 0
        w = best_match(x[0], y[0])
        return max(rows(x[1:], y), rows(x, y[1:]), w + rows(x[1:], y[1:]) if w else 0)

    return 1 + rows(a[1], b[1])


def test_simple_tree_matching_against_all_matches():
    rng = random.Random(12)

    def some(depth):
        kids = [some(depth - 1) for _ in range(rng.randint(0, 3))] if depth else []
        # Neighbours of one label would be one repeated child.
        return rng.choice("abc"), [k for i, k in enumerate(kids) if not i or kids[i - 1][0] != k[0]]

    def tree(t):
        out = W.Tree((t[0], ()), False, False)
        out.children = [tree(c) for c in t[1]]
        return out

    def slot(t):
        out = W.Slot(tree(t))
        out.children = [slot(c) for c in t[1]]
        return out

    below = 0
    for _ in range(300):
        a, b = some(3), some(3)
        b = (a[0], b[1])
        got, want = W.size_matched(slot(a), tree(b), 3), best_match(a, b)
        assert got <= want
        below += got < want
    assert below <= 30  # equal labels at the ends are matched as they stand


@pytest.mark.parametrize("piece", ["<a ", '<a ">" ', "<div>", "</x>", "<b><div>", "</b>", "<li>", "<p><i>", "<td><tr>", "&amp;", "<!-- "])
def test_long_pages_of_one_piece(piece):
    start = time.time()
    for end in ("", "</b>" * 20_000, ">"):
        W.main_texts([piece * (600_000 // len(piece)) + end])
    assert time.time() - start < 30


@pytest.mark.parametrize("bad", ["<", "<p", "a < b", "<p title=\"x>y", "</p></b>", "<b>" * 3000 + "x", "<div>" * 3000 + "deep", "<script>never ends", "<p>" * 2000, "&#xZZ; &bogus;"])
def test_broken_pages(bad):
    assert isinstance(W.main_texts([bad, page(1, "<p>x</p>")])[1], str)


def test_whole_table(spark):
    pages = spark.read.parquet(f"{SAMPLE}/pages.parquet")
    out = {r.page_id: r for r in W.op1_wrapper_main_text(spark, SAMPLE).collect()}
    assert len(out) == pages.count()
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|<footer>)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert out[r.page_id].text == "\n\n".join(b for b in blocks if b), r.page_id
        assert out[r.page_id].n_chars == len(out[r.page_id].text)


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, None, None, "c"), (1, None, "", "c"), (2, "http://h/x", page(1, "<p>x</p>"), "c"), (2, "http://h/x", page(1, "<p>x</p>"), "c")], "page_id long, url string, html string, host string")
    got = sorted(((r.page_id, r.text) for r in W.extract(df).collect()), key=str)
    assert got == [(1, ""), (2, "Head 1\n\nx"), (2, "Head 1\n\nx"), (None, "")]
    assert W.extract(df.limit(0)).count() == 0


def test_every_run_of_a_host_has_its_template(spark):
    sizes = {"five": 5, "over": 65, "two": 129, "many": 300}
    body = "<html><body><div>Site name</div><div><p>Story {k} begins here and goes on.</p></div><div>Read our terms.</div></body></html>"
    rows = [(1000 * i + k, f"http://{h}/{k}", body.format(k=k)) for i, (h, n) in enumerate(sizes.items()) for k in range(n)]
    rows += [(9000 + k, f"http://over/blank{k}", " ") for k in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {i: "" if i >= 9000 else f"Story {i % 1000} begins here and goes on." for i, _, _ in rows}
    try:
        for partitions, batch in (("1", "10000"), ("3", "67")):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            assert {r.page_id: r.text for r in W.extract(df).collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


TOLD = ["job-search", "market-share", "web-search", "fire-alert", "breaking-alert", "lunch-menu", "house-notice", "search"]


@pytest.mark.parametrize("name", TOLD)
def test_names_alone_drop_nothing(name):
    """A name with other words in it keeps its text; it goes where links make up half of it."""
    plain = [f'<article><p>opening number {k} of the story</p><section class="{name}"><p>own paragraph {k} about it {k * 7}</p></section></article>' for k in range(8)]
    assert all(f"own paragraph {k} about" in t for k, t in enumerate(W.main_texts(plain)))
    linked = [p.replace("own paragraph", '<a href="x">own paragraph</a> of').replace("</section>", f'<a href="{name}">and another link to page {len(p)}</a></section>') for p in plain]
    assert all("own paragraph" not in t and "opening number" in t for t in W.main_texts(linked))


@pytest.mark.parametrize("name", ["ad", "ad-box-3", "comment-list", "reader-comments", "user-comments", "site-footer", "cookie-notice", "page-sidebar", "notice", "main-menu"])
def test_names_that_tell(name):
    pages = [f'<article><p>opening number {k} of the story</p><div class="{name}"><p>varying text {k} of a part {k * 3}</p></div></article>' for k in range(8)]
    assert W.main_texts(pages) == [f"opening number {k} of the story" for k in range(8)]


def test_headings_that_recur():
    pages = [f"<article><h1>Title {k}</h1><h2>Abstract</h2><p>what {k} is about</p><h2>Conclusion</h2><p>the end of {k}</p></article>" for k in range(8)]
    assert W.main_texts(pages) == [f"Title {k}\n\nAbstract\n\nwhat {k} is about\n\nConclusion\n\nthe end of {k}" for k in range(8)]


def test_wide_pages_take_no_square_time():
    import time

    pages = ["<article>" + "".join(f'<p class="{"ab"[k % 2]}">{k + j}</p>' for k in range(100_000 + j)) + "</article>" for j in range(2)]
    start = time.perf_counter()
    texts = W.main_texts(pages)
    assert [t.count("\n\n") + 1 for t in texts] == [100_000, 100_001] and time.perf_counter() - start < 30
