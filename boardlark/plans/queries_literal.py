"""Registered queries over literal inputs, for operators whose cases the corpus doesn't hold: board pages, Markdown repairs, files, replies, replays.

Each query makes its few input rows itself and its SQL states the rows that must come out, as VALUES.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Iterator
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boardlark.functions import assets as A
from boardlark.functions import text as T
from boardlark.functions import urls as U
from boardlark.operators import audit, crawl, dedup, enrich, evaluate, normalize, rag
from boardlark.operators import markdown as M
from boardlark.plans.registry import query
from boardlark.schemas import POSTS
from boardlark.sources import boards, files, parsers

_SQL_TYPES = {"int": "INTEGER", "long": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


def _literal(v) -> str:
    if v is None:
        return "NULL"
    return str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def expected(columns: str, *rows: tuple) -> Callable:
    """Registers a query whose result is these rows (columns: name and type, comma-separated)."""
    parts = [c.split() for c in columns.split(",")]
    values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    casts = ", ".join(f"CAST({n} AS {_SQL_TYPES[t]}) AS {n}" for n, t in parts)
    return query(f"SELECT {casts} FROM (VALUES {values}) v({', '.join(n for n, _ in parts)})")


def _texts(spark: SparkSession, *values: str | None) -> DataFrame:
    return spark.createDataFrame(list(enumerate(values)), "i int, x string")


def _mapped(df: DataFrame, function: Callable[[str | None], str | None]) -> DataFrame:
    """(i, value): a text function over the rows, in one Arrow pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"i": b["i"], "value": [function(x) for x in b["x"]]})

    return df.mapInPandas(run, "i int, value string")


def _columns(name: str, expression: Callable[[str], Column], cases: list[tuple[str | None, str | None]]) -> None:
    """Registers a query of a column function over literal values."""

    def run(spark, d):
        return _texts(spark, *[x for x, _ in cases]).select("i", expression("x").cast("string").alias("value"))

    run.__name__ = name
    expected("i int, value string", *[(i, y) for i, (_, y) in enumerate(cases)])(run)


def _functions(name: str, function: Callable, cases: list[tuple[str | None, str | None]]) -> None:
    """Registers a query of a text function over literal values."""

    def run(spark, d):
        return _mapped(_texts(spark, *[x for x, _ in cases]), function)

    run.__name__ = name
    expected("i int, value string", *[(i, y) for i, (_, y) in enumerate(cases)])(run)


_columns("text_source_label", T.source_label, [("한국항공대학교 생활관", "생활관"), ("한국항공대학교", "한국항공대학교"), (" 도서관 ", "도서관")])
_columns("text_log_value", T.safe_log_value, [("data:image/png;base64,AAAA", "data:image/png;base64,<omitted>"), ("u" * 201, "u" * 200 + "...<truncated:201 chars>"), (" a ", "a"), (None, "")])
_columns("text_excerpt", lambda x: T.excerpt(x, 4), [("a  bcde", "a b…"), ("ab", "ab"), (None, None)])
_columns("text_inline_space", T.inline_space, [(" a \t b\n c ", "a b\n c"), ("", "")])
_columns("text_clean_lines", T.clean_lines, [(" a  b\n\n\tc \r\n", "a b\nc"), ("\n \n", "")])
_columns("text_board_label", T.board_label, [("학사 공지사항", "학사"), ("공지사항", "공지사항")])
_columns("text_blank_lines", T.collapse_blank_lines, [("a\r\n\r\n\r\n\nb", "a\n\nb"), ("a\n\nb", "a\n\nb")])
_columns("text_filter_values", lambda x: F.array_join(T.filter_values(x), "|"), [("a, all ,b,a,-", "a|b"), ("", "")])
_columns("url_joined", lambda x: U.joined(F.lit("https://e.test/a/b"), x), [("../c", "https://e.test/c"), ("https://o.test/", "https://o.test/"), ("?q=1", "https://e.test/a/b?q=1")])
_columns("url_escaped", U.escaped, [("a (1).png", "a%20%281%29.png")])
_columns("url_cleaned", U.cleaned, [(" \"https://e.test\\\\/a' ", "https://e.test/a")])
_columns("url_asset_name", lambda x: U.asset_name(x, F.lit("f")), [("https://e.test/a/b%20c.png?x", "b c.png"), ("https://e.test/", "f"), ("data:image/png,AA", "f")])
_columns("asset_image_by_type", lambda x: A.is_image(x, F.lit(""), F.lit("Image/PNG; q=1")), [("n", "true")])
_columns("content_fallback", A.is_fallback, [("", "true"), ("**[이미지 본문]** x", "true"), ("본문 정보가 비어 있습니다.", "true"), ("글", "false"), (None, "true")])
#: One address for each host rule; each result stands for itself under the rule again.
_columns("url_every_host_rule", U.canonical, [
    ("https://www.kau.ac.kr/kaulife/notice.php?page=2&searchkey=&code=s1101&mode=read&seq=77#x", "https://www.kau.ac.kr/kaulife/notice.php?code=s1101&mode=read&seq=77"),
    ("https://career.kau.ac.kr/ko/community/notice/view/12/?p=1", "https://career.kau.ac.kr/ko/community/notice/view/12"),
    ("https://college.kau.ac.kr/web/pages/gc1.do?nttId=5&x=1&bbsId=0123", "https://college.kau.ac.kr/web/pages/gc1.do?bbsId=0123&nttId=5"),
    ("https://lms.kau.ac.kr/mod/ubboard/article.php?bwid=2&id=1&z=3", "https://lms.kau.ac.kr/mod/ubboard/article.php?id=1&bwid=2"),
    ("https://asbt.kau.ac.kr/customer/notice.php?page=1&idx=9&ptype=view&code=n", "https://asbt.kau.ac.kr/customer/notice.php?ptype=view&idx=9&code=n"),
    ("https://asbt.kau.ac.kr/customer/notice.php?idx=9&ptype=list", "https://asbt.kau.ac.kr/customer/notice.php?idx=9&ptype=list"),
    ("https://ai.kau.ac.kr:8100/a.php?seq=1&mode=read", "https://ai.kau.ac.kr:8100/a.php?mode=read&seq=1"),
    ("//e.test/p;v=1?b=&a=2&a=1#f", "https://e.test/p?a=1&a=2&b="),
])

_functions("markdown_from_html", M.from_html, [
    ("<div><h2>제목</h2><p>본문 단락.</p><ul><li>가</li><li>나</li></ul></div>", "## 제목\n\n본문 단락.\n\n- 가\n- 나"),
    ("<p>본문</p><script>alert(1)</script><style>p{}</style>", "본문"), (None, ""), ("<div> </div>", ""), ('<p><img src="data:image/png;base64,AAAA" alt="x"></p>', ""),
    ("<table><thead><tr><th>구분</th><th>일정</th></tr></thead><tbody><tr><td>신청</td><td>5/30</td></tr></tbody></table>", "| 구분 | 일정 |\n| --- | --- |\n| 신청 | 5/30 |"),
    ("<ol><li>a</li><li>b</li></ol><blockquote>q</blockquote><hr>", "1. a\n2. b\n\n> q\n\n---"),
])
_functions("markdown_urls", lambda x: M.from_html(x, "https://e.test/board/list"), [
    ('<a href="/n/1">상세</a> <img src="img.png" alt="포스터">', "[상세](https://e.test/n/1) ![포스터](https://e.test/board/img.png)"),
    ('<img src="data:image/png;base64,A" data-src="/p (1).png" alt="a\n b">', "![a b](https://e.test/p%20%281%29.png)"),
])
_functions("markdown_image_only", lambda x: M.image_only(x, "https://e.test/"), [('<img src="a.png" alt="A"><img src="a.png" alt="B"><img src="data:x">', "![A](https://e.test/a.png)"), ("<p>x</p>", "")])
_functions("markdown_emphasis", M.emphasis, [("**-** 제출", "- 제출"), ("a **: ** b", "a :  b"), ("****", ""), ("한글**굵게**한글", "한글굵게한글")])
_functions("markdown_bullets", M.split_bullets, [("자격 • 나이 • 경력", "자격\n• 나이\n• 경력"), ("(예정)- 모집 부분", "(예정)\n- 모집 부분"), ("오늘 - 내일", "오늘 - 내일")])
_functions("markdown_strong", M.even_strong, [("a **b", "a b"), ("| **a | b** |", "| a| b|")])
_functions("markdown_ticks", M.even_ticks, [("(`25)", "(\\`25)"), ("`a`", "`a`")])
_functions("markdown_repair", M.repair, [("x <!-- c --> [a](javascript:x) [b]() [c](/d", "x    [c](/d)")])
_functions("markdown_structure", M.structured, [("많은 신청 바랍니다.1. 장학개요", "많은 신청 바랍니다.\n1. 장학개요"), ("2026. 08. 예정", "2026. 08. 예정"), ("안내 ※ 주의 ▪항목", "안내\n※ 주의\n▪ 항목"), ("[a@b.co](mailto:zz)", "[a@b.co](mailto:a@b.co)")])
_functions("markdown_tables", M.tables, [("| | | |\n|---|---|---|\n| h | i | j |\n| 1 | 2 | 3 |", "| h | i | j |\n|---|---|---|\n| 1 | 2 | 3 |"), ("| | |\n|---|---|\n| a | → |\n| b | c |", "a →\nb c"), ("| a | b |\nx", "a b\nx")])


@expected("i int, severity string, code string, line int",
    (0, "P0", "empty_content", None), (1, "P1", "raw_html", 2), (1, "P1", "unbalanced_strong", 2), (1, "P1", "table_column_mismatch", 5), (1, "P1", "unclosed_link_destination", 6),
    (2, "P2", "inline_bullet", 1), (2, "P2", "accidental_code_indent", 3), (2, "P1", "html_comment", 5), (3, "P0", "dangerous_raw_html", 1), (3, "P0", "unclosed_fence", 2),
    (3, "P0", "data_uri", 3), (3, "P0", "unsafe_link", 3), (3, "P1", "empty_link_destination", 3), (4, "P1", "unbalanced_inline_code", 1), (4, "P1", "unclosed_link_text", 2), (4, "P2", "html_entity", 3),
    (4, "P2", "link_destination_space", 3), (4, "P2", "repeated_blank_lines", 6), (4, "P2", "inline_dash_label", 7), (4, "P2", "inline_ordered_marker", 8), (4, "P2", "table_row_without_separator", 10), (6, "P1", "empty_table_header", 1))
def audit_every_code(spark, d):
    rows = _texts(
        spark, " \n", "ok\n<p>x</p> **a\n| a | b |\n| --- | --- |\n| 1 |\n[x](https://e.test", "자격 • 나이\n\n    코드처럼\n```\n자격 • 나이 <!--\n```", "<script>\n~~~\n![x](data:image/png;base64,AA) [y]( )\n",
        "a `b\n[x\n&nbsp; [c](d e)\n\n\n\n인턴- 인턴십 기간:\n가)1) 나\n\n|---|", "# 제목\n\n본문 [링크](https://e.test/) **강조**\n\n| a | b |\n| --- | --- |\n| 1 | 2 |", "| |\n|---|",
    )
    return audit.audit(rows.select(F.col("i").alias("id"), F.col("x").alias("content"))).select(F.col("id").cast("int").alias("i"), "severity", "code", "line")


_TR = '<tr class="{c}"><td>{n}</td><td class="title"><a href="{u}">t</a></td></tr>'


def _rows(*rows: tuple[str, str, str]) -> str:
    return "<tbody>" + "".join(_TR.format(c=c, n=n, u=u) for c, n, u in rows) + "</tbody>"


_READ = (("emp point _important", "공지", "?mode=read&seq=1"), ("", "12", "?mode=read&seq=2"))
#: A list page of each kind, and what its two rows give: the address and whether it is permanent.
_LISTS = {
    "official": (f'<table class="table_board">{_rows(*_READ)}</table>', [("?mode=read&seq=1", True), ("?mode=read&seq=2", False)]),
    "card": ('<ul class="list_01"><li class="notice"><a href="?mode=read&seq=1">a</a></li><li><a href="?mode=read&seq=2">b</a></li></ul>', [("?mode=read&seq=1", True), ("?mode=read&seq=2", False)]),
    "career": ('<ul data-role="table"><li class="tbody"><span class="loopnum">공지</span><a href="/n/view/1">a</a></li><li class="tbody"><span class="loopnum">3</span><a href="/n/view/2">b</a></li></ul>', [("view/1", True), ("view/2", False)]),
    "admission": ("""<table><tbody><tr class="_important"><td>1</td><td><a onclick="viewBoardProcess('11')">a</a></td></tr><tr><td>3</td><td><a href="#" onclick="viewBoardProcess('12')">b</a></td></tr></tbody></table>""", [("noticeView.asp?p_board_idx=11", True), ("noticeView.asp?p_board_idx=12", False)]),
    "amtc": ('<ul><li class="board-list-body bo_notice"><a href="?wr_id=1">a</a></li><li class="board-list-body"><a href="?wr_id=2">b</a></li></ul>', [("?wr_id=1", True), ("?wr_id=2", False)]),
    "asbt": (f'<table>{_rows(("point", "1", "?idx=1&ptype=view"), ("", "2", "?idx=2&ptype=view"))}</table>', [("?idx=1&ptype=view", True), ("?idx=2&ptype=view", False)]),
    "ctl": (f'<table class="table_01">{_rows(*_READ)}</table>', [("?mode=read&seq=1", True), ("?mode=read&seq=2", False)]),
    "research": (f'<table class="table_01">{_rows(*_READ)}</table>', [("?mode=read&seq=1", True), ("?mode=read&seq=2", False)]),
    "ftc": (f'<table class="table_board">{_rows(*_READ)}</table>', [("?mode=read&seq=1", True), ("?mode=read&seq=2", False)]),
    "library": ("""<table><tr class="info" onclick="go_view('7')"><td>1</td></tr><tr onclick="go_view('8')"><td>2</td></tr></table>""", [("default_notice_view.mir?sb_no=7", True), ("default_notice_view.mir?sb_no=8", False)]),
    "lms": (f'<table class="ubboard_table">{_rows(("", "", "article.php?bwid=1&id=5"), ("", "4", "article.php?bwid=2&id=5"))}</table>', [("article.php?bwid=1&id=5", True), ("article.php?bwid=2&id=5", False)]),
}


def _register_lists() -> None:
    for kind, (html, items) in _LISTS.items():

        def run(spark, d, kind=kind, html=html):
            pages = spark.createDataFrame([(1, "https://e.test/n/list", html), (2, "https://e.test/n/list", "<p>x</p>")], "page_id bigint, url string, html string")
            return parsers.parsed_lists(pages, parsers.BOARDS[kind]).select("pos", "url", "is_permanent_notice")

        run.__name__ = f"board_list_{kind}"
        expected("pos int, url string, is_permanent_notice boolean", *[(k, f"https://e.test/n/{'list' if u.startswith('?') else ''}{u}", flag) for k, (u, flag) in enumerate(items)])(run)


_register_lists()
_POST = """<div class="location_wrap"><ul class="location"><li>홈</li><li>학사</li></ul></div>
<div class="view_header"><h4> 제 목 </h4><ul><li class="date">작성일2026.4.7</li><li class="attatch"><a href="/f.hwp" download="f 1.hwp">x</a><a href="/f.hwp">y</a></li></ul></div>
<div class="view_conts"><p>글 <img src="/i.png" alt=""></p><iframe src="/v" title="영상"></iframe></div>"""


def _pages(spark: SparkSession, *html: str) -> DataFrame:
    return spark.createDataFrame([(k, f"https://e.test/n?seq={k}", x) for k, x in enumerate(html)], "page_id bigint, url string, html string")


@expected("title string, content string, published_at string, category string, files string", ("제 목", "글 ![](https://e.test/i.png)", "2026-04-07", "학사", "f 1.hwp https://e.test/f.hwp"))
def board_post_official(spark, d):
    out = parsers.parsed_posts(_pages(spark, _POST), parsers.BOARDS["official"])
    return out.select("title", "content", "published_at", "category", F.array_join(F.transform("attachments", lambda a: F.concat_ws(" ", a["name"], a["url"])), "|").alias("files"))


@expected("published_at string, category string, file string", ("2026-04-07", "공지", "a.pdf"))
def board_post_amtc(spark, d):
    html = '<title>공지 | 원</title><h1 id="bo_v_title">t</h1><div id="bo_v_info">작성일 26-04-07 10:00</div><div id="bo_v_con">x</div><div id="bo_v_file"><a href="/a">a.pdf (1.2M)</a></div>'
    return parsers.parsed_posts(_pages(spark, html), parsers.BOARDS["amtc"]).select("published_at", "category", F.col("attachments")[0]["name"].alias("file"))


@expected("name string, url string", ("a.hwp", "https://lib.test/sb/filedownload.mir?sb_no=7&file=x"))
def board_files_library(spark, d):
    html = """<p class="title">T</p><div class="view_content">x</div><div class="view_file"><a href="#" onclick="download_file('7','x')">a.hwp</a></div>"""
    pages = spark.createDataFrame([(1, "https://lib.test/sb/list.mir", html)], "page_id bigint, url string, html string")
    return parsers.parsed_posts(pages, parsers.BOARDS["library"]).select(F.inline("attachments"))


@expected("i int, value string", (0, "u?n=5&b=01 True|u?n=6&b= False"), (1, ""))
def board_list_json(spark, d):
    text = json.dumps({"resultList": [{"nttId": 5, "bbsId": "01", "ntcYn": "Y"}, {"nttId": 6, "ntcNo": "0"}, {"x": 1}]})
    return _mapped(_texts(spark, text, "x"), lambda x: "|".join(f"{u} {flag}" for u, flag in parsers.json_items(x, "u?n={nttId}&b={bbsId}")))


@expected("url string, reason string", ("https://e.test/n?seq=0", "required_field_empty:content"), ("https://e.test/n?seq=1", "required_field_empty:title,content"))
def dead_letters(spark, d):
    return parsers.failed_items(parsers.parsed_posts(_pages(spark, "<h4>t</h4>", "", _POST), parsers.BOARDS["ctl"]))


@expected("page_id long, pos int, type string, name string, url string", (0, 0, "inline_image", "i.png", "https://e.test/i.png"), (0, 0, "inline_embed", "영상", "https://e.test/v"))
def body_assets(spark, d):
    pages = _pages(spark, _POST)
    return parsers.parsed_assets(pages).unionByName(parsers.parsed_assets(pages, "iframe"))


@expected("page_id long, pos int, href string, text string", (0, 0, "/f.hwp", "x"), (0, 1, "/f.hwp", "y"))
def page_links(spark, d):
    return parsers.links(_pages(spark, _POST, "<p>none</p>"))


def _sites(spark: SparkSession) -> DataFrame:
    return boards.table(spark, [boards.Site("a", "A", "official", "t1", "https://e.test/a?page={page}"), boards.Site("b", "B", "json", "t2", "https://e.test/b/{page}", 3)])


@expected("key string, url string", ("a", "https://e.test/a?page=1"), ("a", "https://e.test/a?page=2"), ("b", "https://e.test/b/1"), ("b", "https://e.test/b/2"), ("b", "https://e.test/b/3"))
def site_list_pages(spark, d):
    return boards.list_pages(_sites(spark), 2).select("key", "url")


@expected("ord long, key string", (1, "a"))
def post_boards(spark, d):
    posts = spark.createDataFrame([(1, ["t2", "t1"]), (2, ["t9"])], "_ord bigint, source_type array<string>")
    return boards.of_posts(posts, _sites(spark)).select(F.col("_ord").alias("ord"), "key")


@expected("ntt string, bbs string", ("5", "01"))
def detail_ids(spark, d):
    return _texts(spark, "https://e.test/x.do?nttId=5&bbsId=01").select(boards.detail_ids("x").alias("d")).select(F.col("d.nttId").alias("ntt"), F.col("d.bbsId").alias("bbs"))


@expected("i int, size long, error string", (0, 3, None), (1, None, "asset_download_failed"), (2, None, "asset_download_failed"))
def data_urls(spark, d):
    rows = _texts(spark, "data:,abc", None, "data:image/png;base64,@").withColumnRenamed("x", "url")
    return files.decoded_data_urls(rows).select("i", F.col("size").cast("long").alias("size"), "error")


@expected("path string, text string, error string", ("a.hwpx", "첫째 " + "글" * 40 + "\n둘째", None), ("b.hwpx", None, "unsupported_hwp_format"))
def hwpx_text(spark, d):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("Contents/section1.xml", "<a><b>둘째</b></a>")
        z.writestr("Contents/section0.xml", "<a><b>첫째 " + "글" * 40 + "</b>\n<c> </c></a>")
        z.writestr("other.xml", "<a>no</a>")
    rows = spark.createDataFrame([("a.hwpx", buffer.getvalue()), ("b.hwpx", b"no zip")], "path string, content binary")
    return files.hwpx_documents(rows).select("path", "text", "error")


_ROBOTS = "User-agent: *\nDisallow: /\n\nUser-agent: mybot\nUser-agent: other\nAllow: /a # c\nDisallow: /a/b\nDisallow:\n"


@expected("host string, path string, allowed boolean", ("h", "/a/b/c", False), ("h", "/a/c", True), ("h", "/z", True), ("o", "/a/b", True))
def robots_allowed(spark, d):
    rules = spark.createDataFrame([("h", a, p) for a, p in crawl.robots_rules(_ROBOTS, "MyBot/1.0")], "host string, action string, prefix string")
    return crawl.allowed(spark.createDataFrame([("h", "/a/b/c"), ("h", "/a/c"), ("h", "/z"), ("o", "/a/b")], "host string, path string"), rules).select("host", "path", "allowed")


@expected("i int, value string", (0, "allow /a|disallow /a/b"), (1, "disallow /"))
def robots_rules(spark, d):
    return _mapped(_texts(spark, "MyBot/1.0", "x"), lambda agent: "|".join(map(" ".join, crawl.robots_rules(_ROBOTS, agent))))


@expected("i int, title string, content string, source string, sources string, tags string, published_at string, files string",
    (0, "수강신청 안내", "수강신청 기간을 확인하세요.", "공식", "공식", "학사|공식", "2026-04-20", "첨부파일 https://e.test/f.pdf|n u"), (1, "복수", "본문", "가", "가|나", "t|가|나", "2026-04-21", ""),
    (2, "제목 없음 공지 3", "본문 정보가 비어 있습니다.", None, "", "", None, ""))
def raw_notices(spark, d):
    raw = (
        {"title": "수강신청 안내", "content": "<p>수강신청 기간을 확인하세요.</p>", "source_name": "공식", "category_raw": "학사", "published_at": "2026-04-20T10:00:00+09:00", "attachments": ["https://e.test/f.pdf", {"href": "u", "filename": "n"}, {"name": "x"}, 3]},
        {"subject": "복수", "body": "본문", "source_name": ["가", " ", "나"], "date": "2026-04-21", "tags": ["t", 1]}, {},
    )
    rows = spark.createDataFrame([(k, json.dumps(o)) for k, o in enumerate(raw)], "_ord bigint, raw string")
    listed = F.array_join(F.transform("attachments", lambda a: F.concat_ws(" ", a["name"], a["url"])), "|")
    return normalize.notices(rows).select(F.col("_ord").cast("int").alias("i"), "title", "content", "source", F.array_join("sources", "|").alias("sources"), F.array_join("tags", "|").alias("tags"), "published_at", listed.alias("files"))


def _posts(spark: SparkSession, *rows: dict) -> DataFrame:
    base = {"source_name": [], "source_type": [], "category_raw": [], "attachments": [], "is_permanent_notice": False}
    return spark.createDataFrame([base | {"_ord": k, "original_url": f"https://e.test/{k}", "title": f"t{k}"} | r for k, r in enumerate(rows)], POSTS)


def _merged(spark: SparkSession) -> tuple[DataFrame, dict]:
    old = _posts(spark, {"title": "Same  Title", "source_name": ["a"], "attachments": [{"name": "f", "url": "u1"}]}, {"title": ""}, {"title": ""})
    return dedup.merge(old, _posts(spark, {"original_url": "https://e.test/0#x", "title": "other", "is_permanent_notice": True}, {"original_url": "https://e.test/9", "title": "same title", "source_name": ["b", "a"], "attachments": [{"name": "g", "url": "u1"}, {"name": "h", "url": "u2"}]}))


@expected("url string, sources string, permanent boolean, files string", ("https://e.test/0", "a|b", True, "u1|u2"), ("https://e.test/1", "", False, ""), ("https://e.test/2", "", False, ""))
def merge_old_new(spark, d):
    out = _merged(spark)[0]
    return out.select(F.col("original_url").alias("url"), F.array_join("source_name", "|").alias("sources"), F.col("is_permanent_notice").alias("permanent"), F.array_join(F.transform("attachments", lambda a: a["url"]), "|").alias("files"))


@expected("url_removed int, title_removed int", (1, 1))
def merge_counters(spark, d):
    counts = _merged(spark)[1]
    return spark.createDataFrame([(counts["url_removed"], counts["title_removed"])], "url_removed int, title_removed int")


@expected("ord long, survivor long", (0, 0), (1, 0), (2, 2), (3, 3))
def merge_provenance(spark, d):
    return dedup.provenance(_posts(spark, {"title": "A"}, {"title": " a "}, {"title": ""}, {"title": ""})).select(F.col("_ord").alias("ord"), "survivor")


@expected("url string, ord long", ("https://e.test/0", 0), ("https://e.test/z", 1))
def known_urls(spark, d):
    meta = {"source_name": [], "source_type": [], "category_raw": [], "original_url": "https://e.test/z#a", "published_at": None, "crawled_at": None, "is_permanent_notice": False}
    return dedup.known_urls(_posts(spark, {"source_meta": [meta]}, {"original_url": "https://e.test/z"})).select("url", F.col("_ord").alias("ord"))


def _asset(name: str) -> dict:
    return {"type": "inline_image", "name": name, "url": f"https://e.test/{name}", "source": "body"}


def _thin(spark: SparkSession) -> DataFrame:
    return _posts(
        spark, {"content": "", "content_assets": [_asset("a.png"), _asset("a.png")]}, {"content": "충분히 긴 본문입니다. " * 5, "content_assets": [_asset("b.png")]},
        {"content": "[이미지 본문]", "content_assets": [_asset("c.png")], "attachments": [{"name": "d.hwp", "url": "https://e.test/d.hwp"}]}, {"content": "", "attachments": [{"name": "e.zip", "url": "https://e.test/e.zip"}]}, {"content": "짧음", "content_assets": [_asset("f.png")]},
    )


@expected("ord long, status string", (0, "success"), (2, "success"), (4, "skipped"))
def enrich_statuses(spark, d):
    return enrich.enrich(_thin(spark), lambda a: a["name"], lambda p, t: "글" * 40, most=4).select(F.col("_ord").alias("ord"), "status")


@expected("target_count long, attempted long, succeeded long, failed long, skipped long", (3, 2, 2, 0, 3))
def enrich_counters(spark, d):
    return enrich.run_counts(enrich.enrich(_thin(spark), lambda a: a["name"], lambda p, t: "글" * 40, most=4), 5)


@expected("ord long, content string", (0, "**[이미지 본문]** 텍스트 본문 없음 (이미지 2개)\n\n- a.png"), (3, "**[첨부파일 공지]**\n\n- e.zip"))
def filled_content(spark, d):
    none = F.array().cast("array<struct<name:string,url:string>>")
    return _thin(spark).where("_ord IN (0, 3)").select(F.col("_ord").alias("ord"), enrich.filled_content("content", "content_assets", none, "attachments").alias("content"))


@expected("case_id string, recall_at_5 double, recall_at_10 double, reciprocal_rank double", ("a", 0.5, 1.0, 0.5), ("b", 1.0, 1.0, 0.0), ("c", 0.0, 0.0, 0.0))
def scored_cases(spark, d):
    cases = spark.createDataFrame([("a", ["x", "y"]), ("b", []), ("c", ["z"])], "case_id string, must array<string>")
    got = spark.createDataFrame([("a", 1, "q"), ("a", 7, "has y"), ("a", 2, "has x"), ("c", 1, "n")], "case_id string, rank int, title string")
    return evaluate.scored(cases, got).select("case_id", "recall_at_5", "recall_at_10", "reciprocal_rank")


@expected("case_id string, s double", ("a", None), ("b", 0.5))
def clean_scores(spark, d):
    cases = spark.createDataFrame([("a",), ("b",)], "case_id string")
    scores = spark.createDataFrame([("a", 1, 0.25), ("a", 2, float("nan")), ("b", 1, 0.5)], "case_id string, _ord int, s double")
    return evaluate.clean_scores(evaluate.with_scores(cases, scores), ["s"]).select("case_id", "s")


_ITEM = lambda url, day="2026-05-01", fixed=False: {"url": url, "is_permanent_notice": fixed, "published_at": day}


@expected("i int, value string", (0, "p|a: repeated_page"), (1, "p|a: empty_page"), (2, "p: no_new_general"), (3, "a: old_notice"))
def crawl_stops(spark, d):
    boards_ = (
        ([[_ITEM("p", fixed=True), _ITEM("a")], [_ITEM("p", fixed=True), _ITEM("a")]], ()), ([[_ITEM("p", fixed=True)], [_ITEM("a")], []], ()),
        ([[_ITEM("a"), _ITEM("p", fixed=True)], [_ITEM("b")]], ("a",)), ([[_ITEM("a"), _ITEM("old", "2025-05-15"), _ITEM("b")]], ()),
    )

    def run(x: str) -> str:
        pages, known = boards_[int(x)]
        taken, stop = crawl.replay_board(pages, set(known), {}, date(2026, 5, 15))
        return "|".join(t["url"] for t in taken) + f": {stop}"

    return _mapped(_texts(spark, *map(str, range(4))), run)


@expected("i int, value string", (0, "None"), (1, "3"), (2, "5"))
def crawl_page_limits(spark, d):
    return _mapped(_texts(spark, "0 3", "1 3", "5 3"), lambda x: str(crawl.page_limit(*map(int, x.split()))))


@expected("i int, value string", (0, "10.0.0.1"), (1, "10.0.0.2"), (2, "peer"))
def client_keys(spark, d):
    rows = spark.createDataFrame([(0, True, "10.0.0.1, 10.0.0.9", ""), (1, False, "10.0.0.1", " 10.0.0.2 "), (2, True, " ", None)], "i int, t boolean, c string, r string")
    return rows.select("i", crawl.client_key(F.col("t"), F.col("c"), F.col("r"), F.lit("peer")).alias("value"))


_functions("reply_lists", lambda x: repr(rag.parse_list(x)), [('```json\n["a", 2, null]\n```', "['a', '2']"), ("[]", "[]"), ("no", "None")])
_functions("reply_triage", lambda x: (lambda t: None if t is None else f"{t.mode} {'|'.join(t.keywords)}")(rag.parse_triage(x, False)), [('{"mode":"HISTORY","keywords":["x"]}', "search x"), ("[]", "out_of_domain "), ("?", None)])
_functions("reply_text", lambda x: rag.output_text(json.loads(x)), [('{"output": [{"content": [{"text": "a"}, {"text": "b"}]}]}', "a\nb")])
_functions("asset_url_safe", lambda x: str(A.safe_url(x)), [("ftp://e.test/", "False"), ("http://localhost/", "False"), ("http://10.0.0.1/", "False"), ("https://o.test/", "True")])


def _refreshed(spark: SparkSession) -> DataFrame:
    posts = [(0, "u0", "old", "old", None, "b"), (1, "u1", "written", "old", "success", "b"), (2, "u2", "old", "old", None, None), (3, "u3", "old", "old", None, "b"), (4, "u4", "old", "old", None, "b"), (5, "u5", "old", "old", None, "b")]
    pages = [("u0", True, "new"), ("u1", True, "new"), ("u2", True, "new"), ("u3", False, None), ("u4", True, " ")]
    return enrich.refreshed_posts(spark.createDataFrame(posts, "_ord long, original_url string, content string, content_original string, status string, board string"), spark.createDataFrame(pages, "original_url string, html_found boolean, fresh string"))


@expected("ord long, content string, original string, outcome string", (0, "new", "new", "succeeded"), (1, "written", "new", "preserved_enriched"), (2, "old", "old", "skipped_no_board"), (3, "old", "old", "failed_fetch"), (4, "old", "old", "failed_parse"), (5, "old", "old", "failed_fetch"))
def refresh_posts(spark, d):
    return _refreshed(spark).select(F.col("_ord").alias("ord"), "content", F.col("content_original").alias("original"), "outcome")


@expected("total long, succeeded long, preserved_enriched long, failed_fetch long, failed_parse long, skipped_no_board long", (6, 2, 1, 2, 1, 1))
def refresh_counters(spark, d):
    return enrich.refresh_counts(_refreshed(spark))


@expected("i int, object string, error string", (0, '{"a":1}', None), (1, None, "llm_json_parse_failed"), (2, None, "llm_json_parse_failed"), (3, None, "llm_json_parse_failed"))
def reply_objects(spark, d):
    return _texts(spark, ' {"a": 1}', "[1]", "{a", None).select("i", enrich.reply_object("x").alias("r")).select("i", "r.object", "r.error")
