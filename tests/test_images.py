"""The figure of a release that may be shown: what qualifies, what does not, and long pages."""

import time

import pytest

from pressline.functions.images import MAX_PAGE, release_image, release_image_of

PAGE = "https://www.ecb.europa.eu/press/pr/date/2026/html/ecb.pr260807~58eb5109ce.en.html"
IMAGE = "pr260807/ecb.pr260807.en_img0.png?" + "a64c0aa2880652cf4481b4f129a362f6"
BASE = "https://www.ecb.europa.eu/press/pr/date/2026/html/"


def frame(body):
    return f'<main><div class="section">{body}</div></main>'


def figure(src=IMAGE, credit="Source: ECB", title="Total assets"):
    return f'<div class="figure wide"><h4>Chart 1</h4><p class="title">{title}</p><figure><img alt="" src="{src}" id="x"><figcaption><p>{credit}<br>Note: Data relate to 27 countries.</p></figcaption></figure></div>'


def test_a_credited_figure():
    assert release_image_of("ecb", frame(figure()), PAGE) == (BASE + IMAGE, "Total assets — Source: ECB")


def test_images_in_nested_tables():
    rows = f'<div class="figure"><p class="title">Wages</p><figure><div class="table"><div><table><tr><td><img src="{IMAGE}"></td><td><img src="{IMAGE.replace("img0", "img1")}"/></td></tr></table></div></div><figcaption><p>Sources: ECB calculations based on data of Eurostat.</p><p>Notes: Dashed.</p></figcaption></figure></div>'
    assert release_image_of("ecb", frame(rows), PAGE) == (BASE + IMAGE, "Wages — Sources: ECB calculations based on data of Eurostat.")


def test_only_figures_of_the_section():
    assert release_image_of("ecb", f'<meta property="og:image" content="{BASE}{IMAGE}"><main>{figure()}<div class="section"><img src="{IMAGE}"></div></main>', PAGE) is None
    assert release_image_of("ecb", frame(figure("/press/shared/img/social-default.jpg")), PAGE) is None


@pytest.mark.parametrize("src", ["https://example.com/ecb.pr260807.en_img0.png", "https://www.ecb.europa.eu.evil.example/press/pr/date/2026/html/pr260807/ecb.pr260807.en_img0.png", "https://u:p@www.ecb.europa.eu/press/pr/date/2026/html/pr260807/ecb.pr260807.en_img0.png", "https://www.ecb.europa.eu:444/press/pr/date/2026/html/pr260807/ecb.pr260807.en_img0.png", "http://www.ecb.europa.eu/press/pr/date/2026/html/pr260807/ecb.pr260807.en_img0.png", "pr260729/ecb.pr260729.en_img0.png", "pr260807/ecb.pr260729.en_img0.png", "pr260807/ecb.pr260807.en_img0.png?redirect=https://example.com", "pr260807/ecb.pr260807.en_img0.svg", "data:image/png;base64,AAAA", "pr260807/ecb.pr260807.en_img0.png#fragment", "pr260807/ecb.pr260807.en_img0.png\n", "pr260807/../pr260807x/ecb.pr260807.en_img0.png"])
def test_links_of_other_places(src):
    assert release_image_of("ecb", frame(figure(src)), PAGE) is None


@pytest.mark.parametrize("credit", ["Source: Reuters", "Source: ECB and AFP", "Source: ECB / external photographer", "Source: ECB. Photo by Reuters", "Source: ECB. © Third Party", "", "Source: independent photographer", "Source: ECB. © ECB © Third Party", "Source: ECB<br>© ECB<br>© Third Party", "Source: ECB. © ECB / Third Party", "Source: ECB<br>Copyright ECB<br>Copyright Third Party", "Source: ECB<br>© ECB<br>Notes: illustration © Third Party"])
def test_other_credits(credit):
    assert release_image_of("ecb", frame(figure(credit=credit)), PAGE) is None
    # a later figure that qualifies is taken
    assert release_image_of("ecb", frame(figure(credit=credit) + figure()), PAGE)[0] == BASE + IMAGE


def test_attribution_keeps_sources_and_drops_notes():
    _, said = release_image_of("ecb", frame(figure(credit="Source: ECB calculations based on bank data.<br>© European Central Bank, 2026<br>Notes: Method.<br>More.")), PAGE)
    assert said == "Total assets — Source: ECB calculations based on bank data.\n\n© European Central Bank, 2026\n\nMore."


def test_what_is_no_figure():
    for html in (frame(figure().replace('src="', 'data-src="')), frame(f"<!--{figure()}--><script>{figure()}</script>"), frame(figure().replace("<figcaption>", "<b>").replace("</figcaption>", "</b>")), frame(figure()).replace("</main>", ""), "<main><div class='section'><div class='figure'>", frame(figure(title="")), frame(figure(title="t" * 501)), "x" * (MAX_PAGE + 1), "", None):
        assert release_image_of("ecb", html, PAGE) is None
    for address in (PAGE.replace("/2026/", "/2025/"), PAGE + "?other=1", PAGE + "#x", PAGE.replace("www.ecb.europa.eu", "example.com"), "invalid", None, "https://[", PAGE.replace("https", "http")):
        assert release_image_of("ecb", frame(figure()), address) is None
    assert release_image_of("fed", frame(figure()), PAGE) is None and release_image_of(None, frame(figure()), PAGE) is None


def test_long_pages_are_linear():
    began = time.time()
    for html in (frame("<div>" * 19_000), frame("<p>x" * 19_000), frame(figure(credit="Source: Reuters") * 400), "<main " * 200_000, frame('<img src="' * 100_000), frame("<svg>" * 50_000)):
        release_image_of("ecb", html[:MAX_PAGE], PAGE)
    assert time.time() - began < 20


def test_column(spark):
    df = spark.createDataFrame([("ecb", frame(figure()), PAGE), ("ecb", None, PAGE), (None, "x", None)], "p string, h string, u string")
    assert [r[0] for r in df.select(release_image("p", "h", "u").alias("i")).select("i.link").collect()] == [BASE + IMAGE, None, None]
