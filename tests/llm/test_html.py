import html as escapes
import re
import time

from waferlog.llm import html

ARTICLE = ["A headline of some length", "First paragraph with words & signs, long enough to look like text in any page at all.",
           "Second paragraph says much the same again and again, so that its ratio of text to tags is high.", "Short end."]


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


def test_pages_of_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r["page_id"]: r["text"] for r in html.extract_text(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()}
    for r in rows:
        article = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        blocks = [re.sub(r"\s+", " ", escapes.unescape(re.sub("<[^>]*>", "", x))).strip() for x in re.split("</?(?:h1|p|br)>", article)]
        assert got[r["page_id"]] == "\n".join(x for x in blocks if x)


def test_clutter_goes_and_the_article_stays():
    inner = "".join(f"<p>{escapes.escape(x)}</p>" for x in ARTICLE)
    clutter = [
        "<nav><ul><li><a href='/'>Home</a></li><li><a href='/x'>About us</a></li></ul></nav>", "<header><h1>The Site</h1></header>", "<div class='cookie-notice'>We use cookies, a lot of them, every single day.</div>",
        "<aside>Side words that go on for quite a while to look like text.</aside>", "<form><label>Mail</label><input><button>Go</button></form>", "<div id='comments'><p>Reader: what a long and thoughtful comment this is, indeed.</p></div>",
        "<div role='banner'>Banner text</div>", "<div class='ad'>Buy now, this long advert text wants to be read by all.</div>", "<footer>&copy; me</footer>", "<div style='display:none'>hidden words</div>", "<div hidden>more</div>"]
    want = "\n".join(ARTICLE)
    for wrap in ("<article>{}</article>", "<main>{}</main>", "<div>{}</div>", "<div class='post'><section>{}</section></div>"):
        assert html.main_text(page("".join(clutter) + wrap.format(inner) + "".join(clutter)))[0] == want


def test_plain_menus_are_told_by_their_ratio():
    menu = "<div>" + "".join(f"<span><a href='/{i}'>Item {i}</a></span><br>" for i in range(12)) + "</div>"
    inner = "".join(f"<p>{escapes.escape(x)}</p>" for x in ARTICLE)
    assert html.main_text(page(f"{menu}<div>{inner}</div>{menu}"))[0] == "\n".join(ARTICLE)


def test_regions_are_chosen_by_ratio_on_article_pages_too():
    headline, first, second, end = ARTICLE
    share = "<div><span>Share</span> <span>Tweet</span> <span>Print</span></div>"
    links = "<div><ul><li><a href='/1'>More on this topic</a></li><li><a href='/2'>Another page to read</a></li></ul></div>"
    text = f"<h1><a href='/x'>{headline}</a></h1><p>{escapes.escape(first)}</p>{{}}<p>{second}</p><ul><li>red</li><li><a href='/g'>green</a></li><li>blue paint</li></ul>{{}}<p>{end}</p>"
    want = "\n".join([headline, first, second, "red", "green", "blue paint", end])
    assert html.main_text(page(f"<article>{text.format(share, links)}</article>"))[0] == want
    for teaser in ("<article><p>A few words of another page.</p></article>", "<main><span>1</span> <span>2</span></main>", "<article><a href='/w'>Widget</a></article>"):
        assert want in html.main_text(page(f"{teaser}<div>{text.format(share, links)}</div>"))[0]
        assert "Share" not in html.main_text(page(f"<div>{text.format(share, links)}</div>{teaser}"))[0]


def test_flagged_wrappers_are_judged_by_what_they_hold():
    inner = "".join(f"<p>{escapes.escape(x)}</p>" for x in ARTICLE)
    around = "<nav><a href='/'>Home</a></nav>{}<div class='ad'>Buy now, this long advert text wants to be read by all.</div><footer>&copy; me</footer>"
    want = "\n".join(ARTICLE)
    for wrap in (
            "<div class='content has-sidebar'>{}</div>", "<article class='post no-comments'>{}</article>", "<main id='main-share'>{}</main>", "<form>{}</form>", "<form class='search'><article>{}</article></form>",
            "<div class='sidebar'>{}</div>", "<div class='right-sidebar'><div>{}</div><div class='sidebar'><p>Side words that go on for quite a while to look like text.</p></div></div>", "<div class='banner'><form><article>{}</article></form></div>",
            "<nav><ul><li><a href='/x'>X</a><article>{}</article>"):
        assert html.main_text(page(around.format(wrap.format(inner))))[0] == want, wrap
    assert html.main_text(f"<html><body><form>{around.format(inner)}</form></body></html>")[0] == want
    parts = "".join(f"<div class='tabs'><p>{escapes.escape(x)}</p></div>" for x in ARTICLE[1:3] * 3)
    assert html.main_text(page(parts))[0] == "\n".join(ARTICLE[1:3] * 3)
    comments = "<div id='comments'>" + "".join(f"<p>Reader {i}: what a long and thoughtful comment this is, indeed.</p>" for i in range(9)) + "</div>"
    for wrap in ("<article>{}</article>" + comments, "<article>{}" + comments + "</article>", "<aside><article><p>A teaser of some other page.</p></article></aside><div>{}</div>"):
        assert html.main_text(page(wrap.format(inner)))[0] == want, wrap


def test_comments_consent_and_adverts_never_return_beside_text():
    _, first, second, _ = ARTICLE
    inner = f"<p>{escapes.escape(first)}</p><p>{second}</p>"
    want = f"{first}\n{second}"
    for count in (1, 12, 100):
        said = "".join(f"<p>Reader {i}: what a long and thoughtful comment this is, indeed, and I have more to say.</p>" for i in range(count))
        for area in (f"<div class='comments'>{said}</div>", f"<section id='comments'>{said}</section>", f"<div id='respond'><article>{said}</article></div>",
                     f"<div class='comment-list'>{said}</div>", f"<aside class='comments'>{said}</aside>"):
            for wrap in ("<div>{}</div>{}", "<main><article>{}</article>{}</main>", "<article>{}</article>{}", "<article>{}{}</article>", "<div class='sidebar'>{}</div>{}"):
                if "sidebar" in wrap and "<article" in area:
                    continue  # an article among comments against a text whose name speaks against it: not decided here
                assert html.main_text(page(wrap.format(inner, area)))[0] == want, (count, area[:40], wrap)
    consent = "<div class='cookie-consent'><p>" + "We and our partners store things on your machine. " * 60 + "</p></div>"
    assert html.main_text(page(f"{consent}<div><p>A short post of six words.</p></div>"))[0] == "A short post of six words."
    # alone on its page, such text is all there is
    assert html.main_text(page(f"<div class='comments'><p>{second}</p></div>"))[0] == second


def test_unmatched_end_tags_cost_no_more_than_others():
    start = time.perf_counter()
    assert html.main_text("<div>" * 50_000 + "</section>" * 50_000 + "<p>text of some words here")[0] == "text of some words here"
    assert time.perf_counter() - start < 10


def test_parts_of_an_article_stay_with_it():
    _, first, second, end = ARTICLE
    inner = f"<header><h1><a href='/x'>Headline</a></h1></header><p>{escapes.escape(first)}</p><table><tr><td>1</td><td>2</td></tr></table><p>{second}</p><pre><b>x</b> <i>=</i> <b>1</b></pre><div><p>{end}</p></div>"
    assert html.main_text(page(f"<div><a href='/'>Home</a></div><article>{inner}</article>"))[0] == "\n".join(["Headline", first, "1", "2", second, "x = 1", end])


def test_broken_and_empty_markup():
    assert html.main_text(None)[0] == html.main_text("")[0] == html.main_text("<html><body><nav>x</nav>")[0] == ""
    assert html.main_text("no markup  at\nall")[0] == "no markup at all"
    assert html.main_text("<article><p>One &amp; two &lt;3 &#233;&nbsp;x<p><b>bold<br>next</article><footer>f")[0] == "One & two <3 é x\nbold\nnext"
    assert html.main_text("<article><p>cut off in a ta<b")[0].startswith("cut off in a ta")
    long = "<article>" + "<p>word word word</p>" * 20_000
    assert html.main_text(long)[0].count("\n") == 19_999


def test_edges(spark):
    kind = "page_id long, url string, html string, text string"
    df = spark.createDataFrame([(1, None, None, "x"), (1, None, None, "x"), (None, "u", "<p>hello", None)], kind)
    got = html.extract_text(df)
    assert sorted(r["text"] for r in got.collect()) == ["", "", "hello"] and got.columns.count("text") == 1
    assert html.extract_text(df.where("false")).count() == 0
