"""Text, date, URL and asset functions on literal cases."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from boardlark.functions import assets, dates, text, urls


@pytest.fixture(scope="module")
def at(spark):
    def run(expression, *values):
        """The expression of column x over the values."""
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
        return [r["y"] for r in rows.select("i", expression.alias("y")).orderBy("i").collect()]

    return run


def test_white_space(at):
    assert at(text.collapse("x"), " a 　b\n", None, "\x1ca\x1f") == ["a b", None, "a"]
    assert at(text.blank_to_null("x"), " 　", " a ") == [None, "a"]
    assert at(text.compact("x"), "a b c") == ["abc"]


def test_facet_and_filter_values(at):
    assert at(text.facet_value("x"), " N/A ", "-", "미분류", "학사", "") == [None, None, None, "학사", None]
    assert at(text.filter_value("x"), "All", "__ALL_SOURCES__", "전체  출처", "학사") == [None, None, None, "학사"]
    assert at(text.filter_values("x"), "a, all ,b,a,-") == [["a", "b"]]


def test_slug(at):
    assert at(text.slug("x"), "Hello, 세계!", "---", "a" * 60, "a-" * 30) == ["hello-세계", "notice", "a" * 48, "a-" * 24]


def test_html_and_lengths(at):
    assert at(text.strip_html("x"), "<script>x</script><p>a&amp;<b>b</b></p><STYLE>q</STYLE>") == ["a&amp; b"]
    assert at(text.visible_length("x"), "![a](b) [text](http://x) https://y.z/ab 글", None) == [5, 0]
    assert at(text.truncate("x", 3), "abcd", "abc") == ["abc...", "abc"]
    assert at(text.excerpt("x", 4), "a  bcde") == ["a b…"]
    assert at(text.clean_lines("x"), " a  b\n\n\tc \r\n") == ["a b\nc"]
    assert at(text.board_label("x"), "학사 공지사항", "공지사항") == ["학사", "공지사항"]
    assert at(text.source_label("x"), "한국항공대학교 생활관", "한국항공대학교") == ["생활관", "한국항공대학교"]
    assert at(text.safe_log_value("x"), "data:image/png;base64,AAAA", "u" * 201) == ["data:image/png;base64,<omitted>", "u" * 200 + "...<truncated:201 chars>"]


def test_dates(at):
    assert at(dates.normalize_date("x"), "2026-04-20T03:00:00+09:00", "20260420", "2026-02-30", "no", None, "20261340") == ["2026-04-20", "2026-04-20", "2026-02-30", None, None, None]
    assert at(dates.parse_date("x"), "2026.4.7", "x 2026/04/07 10:00", "2026-02-30", None) == [date(2026, 4, 7), date(2026, 4, 7), None, None]
    assert at(dates.recency("x", "2026-05-15"), "2026-05-10", "2026-04-20", "2026-03-01", "2025-12-01", "2025-01-01", "2026-06-01", "2026-02-30") == [5, 3, 1, 0, -2, 0, 0]


def test_canonical_urls():
    same = {
        "https://www.kau.ac.kr/kaulife/notice.php?page=2&searchkey=&code=s1101&mode=read&seq=77#x": "https://www.kau.ac.kr/kaulife/notice.php?code=s1101&mode=read&seq=77",
        "https://career.kau.ac.kr/ko/community/notice/view/12/?p=1": "https://career.kau.ac.kr/ko/community/notice/view/12",
        "https://college.kau.ac.kr/web/pages/gc1.do?nttId=5&x=1&bbsId=0123": "https://college.kau.ac.kr/web/pages/gc1.do?bbsId=0123&nttId=5",
        "https://lms.kau.ac.kr/mod/ubboard/article.php?bwid=2&id=1&z=3": "https://lms.kau.ac.kr/mod/ubboard/article.php?id=1&bwid=2",
        "https://asbt.kau.ac.kr/customer/notice.php?page=1&idx=9&ptype=view&code=n": "https://asbt.kau.ac.kr/customer/notice.php?ptype=view&idx=9&code=n",
        "https://asbt.kau.ac.kr/customer/notice.php?idx=9&ptype=list": "https://asbt.kau.ac.kr/customer/notice.php?idx=9&ptype=list",
        "https://ai.kau.ac.kr:8100/a.php?seq=1&mode=read": "https://ai.kau.ac.kr:8100/a.php?mode=read&seq=1",
        "//e.test/p;v=1?b=&a=2&a=1#f": "https://e.test/p?a=1&a=2&b=",
        "": "https://",
    }
    for given, want in same.items():
        assert urls.canonical_url(given) == want
        assert urls.canonical_url(want) == want


def test_urls_as_columns(at):
    given = ["https://e.test/a?b=2&a=1#x", "https://e.test/a#y", "https://e.test/a?x="]
    assert at(urls.canonical("x"), *given) == at(urls.canonical_plain("x"), *given)
    assert at(urls.suffix(urls.path_of("x")), "https://e.test/a%20b.JPG?x=.png", "https://e.test/dir.d/", "https://e.test/") == [".jpg", ".d", ""]
    assert at(urls.asset_name("x", F.lit("f")), "https://e.test/a/b%20c.png?x", "https://e.test/", "data:image/png,AA") == ["b c.png", "f", "f"]
    assert at(urls.escaped("x"), "a (1).png") == ["a%20%281%29.png"]
    assert at(urls.joined(F.lit("https://e.test/a/b"), "x"), "../c", "https://o.test/") == ["https://e.test/c", "https://o.test/"]
    assert at(urls.cleaned("x"), " \"https://e.test\\\\/a' ") == ["https://e.test/a"]


def test_assets(at):
    assert at(assets.attachment_type("x", F.lit("https://e.test/v.do")), "a.PNG", "b.hwpx", "c.pdf") == ["image_attachment", "hwp_attachment", None]
    assert at(assets.is_image("x", F.lit(""), F.lit("Image/PNG; q=1")), "n") == [True]
    assert at(assets.is_fallback("x"), "", "**[이미지 본문]** x", "본문 정보가 비어 있습니다.", "글", None) == [True, True, True, False, True]
    assert not assets.safe_url("ftp://e.test/") and not assets.safe_url("http://localhost/") and not assets.safe_url("http://10.0.0.1/") and not assets.safe_url("https://o.test/", ("e.test",))
    assert assets.safe_url("https://a.e.test/", ("e.test",)) and not assets.safe_url("https://a.e.test/", resolve=lambda h: ["127.0.0.1"])
