import numpy as np
import pytest
from pyspark.sql import functions as F

from keytide.llm import html_text
from keytide.llm.html_text import main_text

LONG = "The words of this block are many and it is about the news that was in the paper with all of its readers at home. "
PAGE = """<!doctype html><html><head><title>T</title><style>p{{a:b}}</style><script>var x = "</p><p>{0}";</script></head><body class="has-sidebar">
<header><div class="logo">{0}</div></header><nav><ul><li><a href="/a>b">Home</a><li><a href=/b>News</a></ul></nav>
<div class="cookie-banner">{0}</div><form><label>Your mail</label><input value="x>y"><textarea>{0}</textarea></form>
{1}
<aside>{0}</aside><div id=comments><article class="comment"><p>{0}</article><article><p>{0}</article></div><footer>&copy; 2020 {0}</footer></body></html>"""


def test_only_the_article_stays():
    article = f"<article><header><h1>A &amp; B</h1></header><p>{LONG}<p>Short.<div>Line one<br>goes&nbsp;on</div><p>x<br> <br>y<ul><li>one<li>two</ul><!-- <p>no -->" + f"<div class='share'>{LONG}</div><pre>a\n b</pre></article>"
    want = ["A & B", LONG.strip(), "Short.", "Line one goes on", "x", "y", "one", "two", "a b"]
    assert main_text(PAGE.format(LONG, article)) == "\n\n".join(want)


def test_without_marks_density_and_neighbours_decide():
    menu = "".join(f"<div><a href=x>Section {k} of the menu and more of it in the list of links</a></div>" for k in range(4))
    page = f"<html><body>{menu}<div>Menu end</div><h2>Title</h2><div>{LONG * 2}</div><div>Short one.</div><div>{LONG}</div><div>Last</div>{menu}<div>Imprint</div></body></html>"
    assert main_text(page).split("\n\n") == ["Title", (LONG * 2).strip(), "Short one.", LONG.strip()]
    unknown = "лорем ипсум долор сит амет " * 6
    assert main_text(f"<div>{unknown}</div><div><a>{unknown}</a></div>") == unknown.strip()


@pytest.mark.parametrize("seed", range(3))
def test_second_pass_equals_a_search_from_each_block(seed):
    rng = np.random.default_rng(seed)
    label, heading, main = rng.integers(-1, 2, 200), rng.random(200) < 0.2, rng.random(200) < 0.3
    label[50:120] = -1
    got = html_text.second_pass(label, heading, main)
    for k, x in enumerate(label):
        decided = [(abs(j - k), label[j] == 1, j > k) for j in range(200) if label[j] >= 0]
        near = [d for d in decided if d[0] == min(decided)[0]]
        want = x == 1 if x >= 0 else near[0][1] if len({d[1] for d in near}) == 1 else main[k] or heading[k] and any(d[1] and d[2] for d in near)
        assert got[k] == want


def test_odd_pages():
    assert [main_text(x) for x in ("", "   ", "<", "<p", "<!-- x", "<script>x", "</p></div>", "&lt;")] == ["", "", "", "", "", "", "", ""]
    assert main_text("<article>a < b &amp;amp; &#x41;&eacute; c</article>") == "a < b &amp; Aé c"
    assert main_text("<main><div hidden>x</div><div style='display: none'>y</div><p>kept</main>") == "kept"
    assert main_text("<div class='layout sidebar'><article>text</article><div>other</div></div>") == "text"
    assert main_text("<article><a href='x'>" + LONG + "</a></article>") == ""
    for name in ("commentlist", "advertising", "siteSidebar", "cookie-notice", "post-comments", "subscription_box"):
        assert main_text(f"<div><p>{LONG}</p><div class='{name}'><p>{LONG} x</p></div></div>") == LONG.strip()
        assert main_text(f"<article><p>{LONG}</p><ul id={name}><li>{LONG} x</ul></article>") == LONG.strip()
    assert main_text(f"<article class='commentary has-sidebar'><p>{LONG}</p></article>") == LONG.strip()
    for piece in ("<div>", "<a <", "<b ='", "</x>", "<p><a>", '<i a="', "<li>x", "<!", "&am"):  # linear in the page's length
        main_text("<article>" + piece * 100_000)


def test_rows_of_a_table(spark):
    rows = [(1, "u", f"<article>{LONG}", "x"), (1, "u", f"<article>{LONG}", "y"), (None, None, None, "z"), (2, "v", "", None)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string, text string")
    got = html_text.extract(pages)
    assert got.dtypes == [("page_id", "int"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    t = LONG.strip()
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "u", t, len(t)), (1, "u", t, len(t)), (None, None, "", 0), (2, "v", "", 0)], key=str)
    assert html_text.extract(pages.where(F.lit(False))).count() == 0
