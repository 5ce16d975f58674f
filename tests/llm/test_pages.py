from __future__ import annotations

import html
import random

from tracewell.llm import pages

ARTICLE = "<article><h1>Title here</h1><p><b>One two &amp; three<br><p>Four\n\n five</p></article>"


def page(body: str) -> str:
    return (
        '<!DOCTYPE html><html lang="en"><head><title>No title words</title><style>p{margin:0}</style>'
        '<script>var t="</p>";track(0);</script></head><body><nav><ul><li><a href="/x">Menu</a></li></ul></nav>'
        f'<!-- ad 0 --><div class="ad">Buy now cheap things today.</div>{body}<footer>&copy; all rights reserved by us</footer>'
    )


def test_article_only(spark):
    df = spark.createDataFrame([(1, "u", page(ARTICLE)), (2, None, None), (3, "v", ""), (4, "w", page(""))], "page_id long, url string, html string")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in pages.extract(df, pages.fit(df), also=("page_id", "url")).collect()}
    want = "Title here One two & three Four five"
    assert got == {1: ("u", want, len(want)), 2: (None, "", 0), 3: ("v", "", 0), 4: ("w", "", 0)}


def test_noise_inside_an_article_is_left_out_and_does_not_cut_it(spark):
    noise = '<aside>Side words here</aside><div class="ad-box">buy this</div><form>Your mail<input><button>Go</button></form>'
    notice = '<div class="cookie-notice">' + "we use cookies " * 40 + "</div>"
    comments = '<section id="comments"><p>' + "nice post " * 60 + "</p></section>"
    body = f"<article><h1>Head</h1><p>First part.</p>{noise}{notice}<p>Tail &lt;b&gt; end&#33;</p>{comments}</article>"
    df = spark.createDataFrame([(page(body),)], "html string")
    assert [r.text for r in pages.extract(df, pages.fit(df)).collect()] == ["Head First part. Tail <b> end!"]


def test_pages_without_a_marked_article_use_the_fixed_weights():
    body = '<div id="content"><h2>Head</h2><p>' + "many good words " * 30 + '</p><p>and <i>some</i>more</p></div>'
    want = " ".join(("Head " + "many good words " * 30 + "and somemore").split())
    assert pages.main_text(page(body), {}) == want


def test_odd_markup_and_long_pages():
    assert pages.main_text("a < b <", {}) == "a < b <"
    assert pages.main_text("<p>x<!-- open", {}) == "x"
    assert pages.main_text("<article>&amp &am; &#x41;&nbsp;z</article>", {}) == "& &am; A z"
    words = " ".join(["word"] * 200_000)
    assert pages.main_text(f"<article>{words}</article>", {}) == words


def test_best_stretch_matches_brute_force():
    rng = random.Random(0)
    for _ in range(200):
        x = [rng.choice([-2, -1, 1, 3]) for _ in range(rng.randrange(12))]
        low, high = pages.best_stretch(x)
        assert sum(x[low:high]) == max([0, *(sum(x[i:j]) for i in range(len(x)) for j in range(i, len(x) + 1))])


def test_generated_pages_match_what_they_were_made_of(spark):
    rng = random.Random(3)
    rows = []
    for k in range(60):
        blocks = [" ".join(rng.choices(["alpha", "beta&", "g<d", "é"], k=rng.randrange(1, 30))) for _ in range(rng.randrange(1, 6))]
        body = "".join(f"<p>{html.escape(b)}</p>" for b in blocks)
        rows.append((k, page(f"<article>{body}</article>"), " ".join(blocks)))
    df = spark.createDataFrame(rows, "page_id long, html string, want string").repartition(4)
    got = pages.extract(df, pages.fit(df), also=("want",)).collect()
    assert all(r.text == r.want for r in got)


def test_classes_of_paragraphs_items_headings_and_inline_elements_count():
    body = (
        '<article><h1 class="entry-header">Head</h1><p>First <b class="lead">bold</b> part.</p><p class="advert">Buy now cheap.</p><ul><li>One'
        '<li class="share">Share this<li>Two</ul><h3 class="related">See also</h3><p>Last <span class="ad">ad words</span>words<p class="notice">Note'
        "<p>End.</p></article>"
    )
    assert pages.main_text(page(body), {}) == "Head First bold part. One Two Last words End."


def test_weights_tell_regions_apart_where_no_word_of_the_markup_does(spark):
    rng = random.Random(7)
    words = lambda n: " ".join(rng.choices("ka lo mi ne tu".split(), k=n))
    box = lambda: f'<div class="qx"><p>{words(30)}</p></div>'
    marked = [f'<div class="qx">{words(40)}</div><article><div class="zy"><p>{words(30)}</p></div></article>{box()}' for _ in range(30)]
    model = pages.fit(spark.createDataFrame([(m,) for m in marked], "html string"))
    text = words(20)
    plain = f'{box()}<div class="zy"><p>{text}</p></div>{box()}'
    assert pages.main_text(plain, model) == text
    assert pages.main_text(plain, {}) != text


def test_repeats_clashing_names_and_no_rows(spark):
    df = spark.createDataFrame([(1, page(ARTICLE), "x", 5)] * 2 + [(None, None, None, None)], "page_id long, html string, text string, n_chars int")
    model = pages.fit(df)
    got = pages.extract(df, model, also=("page_id", "text", "n_chars"))
    assert got.columns == ["page_id", "text", "n_chars"]
    want = "Title here One two & three Four five"
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got.collect()) == [("1", want, len(want))] * 2 + [("None", "", 0)]
    assert pages.fit(df.limit(0)) == {} and pages.extract(df.limit(0), {}).count() == 0


def test_malformed_pages_take_one_pass():
    import time

    for unit in ("<script ", "<svg ", '<script "', "<script '\"", "<title>", "<!--", "<a ", '<a "', "<a '\"", "</x>", "<div><p>", "<p><div><span>", "</p><div><span></p>", "<li><div></li>", "<", "<b", '<a "<a "', "<h2>Comments", "<article>"):
        source = "<p>first words</p>" + unit * ((1 << 20) // len(unit))
        began = time.process_time()
        list(pages.tokens(source))
        assert time.process_time() - began < 3, unit
        began = time.process_time()
        pages.main_text(source[: 1 << 18], {})
        assert time.process_time() - began < 6, unit


def test_tokens_of_raw_elements_and_unclosed_tags():
    source = "a<b>x</b><script a='>'><p></SCRIPT ><!-- <p> --><p title=\"a>b\">5 < 6 <i<u>"
    found = [(kind, name, source[a:b]) for a, b, kind, name, _ in pages.tokens(source)]
    assert found == [("tag", "b", "<b>"), ("end", "b", "</b>"), ("raw", "script", "<script a='>'><p></SCRIPT >"), ("", "", "<!-- <p> -->"), ("tag", "p", '<p title="a>b">'), ("", "i", "<i"), ("tag", "u", "<u>")]


def test_classes_match_whole_names():
    body = (
        '<article><h1>Head</h1><div class="share-price">The price rose.</div><p class="public-notice">Read this.</p><p class="share-buttons">Tweet it.</p>'
        '<div class="cookie-notice wide">We use them.</div><p class="x related">More.</p><p>End.</p></article>'
    )
    assert pages.main_text(page(body), {}) == "Head The price rose. Read this. End."


def test_comments_without_a_class_are_left_out():
    post = "<p>" + "good words " * 30 + "</p>"
    said = "<p>" + "nice post " * 60 + "</p>"
    want = ("good words " * 30).strip()
    for body in (
        f"<article>{post}</article><section><h3>Comments</h3>{said}</section>",
        f"<article>{post}</article><h3>2 Comments</h3>{said}{said}",
        f"<article>{post}<h2>Leave a reply</h2>{said}</article>",
        f"<div>{post}</div><div><h3>Comments (3)</h3>{said}</div>",
        f"<article>{post}<article>{said}</article></article>",
    ):
        assert pages.main_text(page(body), {}) == want, body
    kept = f"<article>{post}<h2>Comments on the price of bread</h2><p>Bread.</p><h2>Share</h2><p>It.</p><h2>Rest</h2><p>End.</p></article>"
    assert pages.main_text(page(kept), {}) == f"{want} Comments on the price of bread Bread. Rest End."


def test_cards_marked_as_articles_behind_the_text_are_left_out():
    text = "many good words " * 40
    cards = "".join(f"<article><h3>Card {k}</h3><p>Some teaser words.</p></article>" for k in range(2))
    assert pages.main_text(page(f'<div id="content"><p>{text}</p></div>{cards}'), {}) == text.strip()
    assert pages.main_text(page(f"<article><p>{text}</p></article>{cards}"), {}) == text.strip()


def test_an_articles_own_header_is_a_header():
    assert pages.main_text(page("<article><header><h1>Title</h1><p>By me</p></header><p>Text of it.</p></article>"), {}) == "Text of it."


def test_classes_outside_of_articles_are_learned(spark):
    rng = random.Random(2)
    words = lambda n: " ".join(rng.choices("ka lo mi ne tu".split(), k=n))
    marked = [f'<article><div class="zy"><p>{words(30)}</p></div></article><div class="qx"><p>{words(20)}</p></div>' for _ in range(30)]
    model = pages.fit(spark.createDataFrame([(m,) for m in marked], "html string"))
    body = '<article><div class="zy"><p>one two three</p></div><div class="qx"><p>four</p></div><p>five</p></article>'
    assert pages.main_text(body, model) == "one two three five" and pages.main_text(body, {}) == "one two three four five"
