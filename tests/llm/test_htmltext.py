import pytest

from semaspark.llm import htmltext

PAGES = "page_id long, url string, html string, host string, template string"
PLAIN = "<html><head><title>T</title><style>a{}</style></head><body>%s</body></html>"


@pytest.mark.parametrize("body,text", [
    ("<nav>n</nav><article><h1>A &amp; B</h1><p>one\n two<br>three<p>four</article><footer>f</footer>", "A & B\none two three\nfour"),
    ("<p>x<div class='ad-box ad'>buy</div><p>y <!-- no <p>c</p> --> z", "x\ny z"),
    ("<main><ul><li>a<li>b</ul><form><p>q</form><section id=comments><p>c</section></main><p>out", "a\nb"),
    ("<article><p>a</p><script>var t=\"</p><p>s\";</script><p hidden>h</p><p style='display:none'>h</p><p>b</article>", "a\nb"),
    ("<article>a<article class=comment>no</article></article>", "a"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
    ("<p>a < b &lt; c &#233;&nbsp;&eacute; <b>d<i>e</b>f", "a < b < c é é def"),
    ("<p>unclosed <a href=\"x>y", "unclosed y"), ("", ""), ("<p>", ""), ("text only", "text only"),
])
def test_main_text(body, text):
    assert htmltext.main_text(htmltext.parse(PLAIN % body)) == text


def test_deep_and_long_pages():
    deep = "<div>" * 50_000 + "x" + "</div>" * 50_000
    assert htmltext.main_text(htmltext.parse(deep)) == "x"
    assert htmltext.hashed(htmltext.parse(deep))
    long = PLAIN % ("<p>" + "word " * 200_000)
    assert len(htmltext.main_text(htmltext.parse(long))) == 5 * 200_000 - 1
    for bad in ("<" * 50_000, "<a href='" * 5_000, "<!--" * 5_000, "&" * 50_000):
        htmltext.main_text(htmltext.parse(bad))


def test_site_template_goes(spark):
    site = "<div><div>Our site, all rights</div><div><p>Story %d has its own words</p></div><div>Follow us</div></div>"
    rows = [(i, f"https://a.example/{i}", PLAIN % (site % i), "x", "y") for i in range(20)]
    rows += [(100 + i, f"https://b.example/{i}", PLAIN % (site % i), "x", "y") for i in range(2)]
    rows += [(200 + i, "http://c.example/", PLAIN % "<article><p>same article</p></article>", "x", "y") for i in range(20)]
    rows += [(300, None, PLAIN % "<p>no host", "x", "y"), (301, "https://a.example/n", None, "x", "y"), (302, "https://a.example/e", "", "x", "y"), (302, "https://a.example/e", "", "x", "y")]
    got = {r["page_id"]: r for r in htmltext.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[3]["text"] == "Story 3 has its own words" and got[3]["n_chars"] == 25
    assert got[100]["text"].split("\n") == ["Our site, all rights", "Story 0 has its own words", "Follow us"]
    assert got[200]["text"] == "same article" and got[300]["text"] == "no host"
    assert got[301]["text"] == "" and got[302]["n_chars"] == 0
    assert htmltext.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_sections_of_a_large_host(spark):
    page = "<div><div>Links of section %d</div><div><p>Story %d has its own words</p></div>%s</div>"
    rows = [(i, f"https://big.example/s{i % 8}/{i}", PLAIN % (page % (i % 8, i, "<div>Sale now</div>" if i // 8 % 4 == 0 else "")), "x", "y") for i in range(240)]
    rows += [(1000 + i, f"https://small.example/s{i % 8}/{i}", PLAIN % (page % (i % 8, i, "")), "x", "y") for i in range(48)]
    got = {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(got[i] == f"Story {i} has its own words" for i in range(240)) and got[1009] == "Story 9 has its own words"


def test_pages_of_the_test_data(spark, sf):
    import html
    import re

    for r in htmltext.extract(spark.read.parquet(f"{sf}/pages.parquet")).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inside = re.search(r"<article>(.*?)(</article>|<footer|$)", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        assert r["text"] == "\n".join(b for b in blocks if b)
