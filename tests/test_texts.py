"""Markdown, audit, page parsing, files and streams on literal cases."""

import io
import json
import zipfile

import pytest

from boardlark.operators import audit, crawl
from boardlark.operators import markdown as m
from boardlark.sources import files, parsers, snapshot
from boardlark.operators.store import StoreError
from boardlark.sources.dom import parse
from boardlark.streaming import feeds


def test_blocks_and_urls():
    assert m.from_html("<div><h2>제목</h2><p>본문 단락.</p><ul><li>가</li><li>나</li></ul></div>").splitlines() == ["## 제목", "", "본문 단락.", "", "- 가", "- 나"]
    md = m.from_html('<a href="/n/1">상세</a> <img src="img.png" alt="포스터">', "https://e.test/board/list")
    assert md == "[상세](https://e.test/n/1) ![포스터](https://e.test/board/img.png)"
    assert m.from_html("<p>본문</p><script>alert(1)</script><style>p{}</style>") == "본문" and m.from_html(None) == m.from_html("<div> </div>") == ""
    assert m.from_html('<p><img src="data:image/png;base64,AAAA" alt="x"></p>') == ""
    assert m.from_html('<img src="data:image/png;base64,A" data-src="/p (1).png" alt="a\n b">', "https://e.test/n") == "![a b](https://e.test/p%20%281%29.png)"
    table = m.from_html("<table><thead><tr><th>구분</th><th>일정</th></tr></thead><tbody><tr><td>신청</td><td>5/30</td></tr></tbody></table>")
    assert table == "| 구분 | 일정 |\n| --- | --- |\n| 신청 | 5/30 |"
    assert m.from_html("<ol><li>a</li><li>b</li></ol><blockquote>q</blockquote><hr>") == "1. a\n2. b\n\n> q\n\n---"
    assert m.from_html("<pre>x\ny</pre>") == "\\`\\`\\`\nx\ny\n\\`\\`\\`"  # a lone fence line has an odd number of backticks


def test_image_only():
    html = "".join(f'<img src="/img/{k}.png" alt="p{k}">' for k in range(12))
    lines = m.image_only(html, "https://e.test/page").split("\n\n")
    assert lines[0] == "![p0](https://e.test/img/0.png)" and len(lines) == 11 and lines[-1] == "_… 외 이미지 2장_"
    assert m.image_only('<img src="a.png" alt="A"><img src="a.png" alt="B"><img src="data:x">', "https://e.test/") == "![A](https://e.test/a.png)" and m.image_only("<p>x</p>") == ""


@pytest.mark.parametrize("text", ["<p>본문 <b>강조</b></p><br><br>", "표\t|\tA\t|\tB", "- a\n- b\n\n\n\n", "http://x.com  공지   2026. 08. 예정", "###제목\n본문<div>중첩<span>태그</span></div>", '<p><img src="data:image/png;base64,AAAA" alt="본문"></p>', "1) 항목\n2) 항목\n\n\n끝", "본문 정보가 비어 있습니다.", "| | |\n|---|---|\n| a | b |", "[a](x y) `b [c"])
def test_normalising_again_changes_nothing(text):
    once = m.normalize(text)
    assert m.normalize(once) == once


def test_repairs():
    assert m.emphasis("**-** 제출") == "- 제출" and m.emphasis("a **: ** b") == "a :  b" and m.emphasis("****") == ""
    assert m.emphasis("한글**굵게**한글") == "한글굵게한글"
    assert m.split_bullets("자격 • 나이 • 경력") == "자격\n• 나이\n• 경력" and m.split_bullets("(예정)- 모집 부분") == "(예정)\n- 모집 부분" and m.split_bullets("오늘 - 내일") == "오늘 - 내일"
    assert m.even_strong("a **b") == "a b" and m.even_strong("| **a | b** |") == "| a| b|" and m.even_ticks("(`25)") == "(\\`25)" and m.ticks("\\` `a`") == 2
    assert m.repair("x <!-- c --> [a](javascript:x) [b]() [c](/d") == "x    [c](/d)"
    assert m.structured("많은 신청 바랍니다.1. 장학개요") == "많은 신청 바랍니다.\n1. 장학개요" and m.structured("2026. 08. 예정") == "2026. 08. 예정"
    assert m.structured("안내 ※ 주의 ▪항목") == "안내\n※ 주의\n▪ 항목" and m.structured("[a@b.co](mailto:zz)") == "[a@b.co](mailto:a@b.co)"
    assert m.structured("- 다 음 -\n본문").startswith("다음")


def test_tables():
    assert m.tables("| | | |\n|---|---|---|\n| h | i | j |\n| 1 | 2 | 3 |") == "| h | i | j |\n|---|---|---|\n| 1 | 2 | 3 |"
    assert m.tables("| | |\n|---|---|\n| a | → |\n| b | c |") == "a →\nb c" and m.tables("| a | b |\nx") == "a b\nx"


def audited(spark, content):
    rows = spark.createDataFrame([("r", content)], "id string, content string")
    return {(r["severity"], r["code"]): (r["line"], r["excerpt"]) for r in audit.audit(rows).collect()}


def test_audit(spark):
    assert audited(spark, "# 제목\n\n본문 [링크](https://e.test/) **강조**\n\n| a | b |\n| --- | --- |\n| 1 | 2 |") == {}
    assert audited(spark, " \n") == {("P0", "empty_content"): (None, "")} == audited(spark, None)
    found = audited(spark, "ok\n<p>x</p> **a\n| a | b |\n| --- | --- |\n| 1 |\n[x](https://e.test")
    assert {c for _, c in found} == {"raw_html", "unbalanced_strong", "table_column_mismatch", "unclosed_link_destination"} and found["P1", "raw_html"][0] == 2 and found["P1", "table_column_mismatch"][0] == 5
    found = audited(spark, "자격 • 나이\n\n    코드처럼\n```\n자격 • 나이 <!--\n```")
    assert set(found) == {("P2", "inline_bullet"), ("P2", "accidental_code_indent"), ("P1", "html_comment")} and found["P2", "accidental_code_indent"][0] == 3
    found = audited(spark, "<script>\n~~~\n![x](data:image/png;base64,AA) [y]( )\n")
    assert {("P0", "dangerous_raw_html"), ("P0", "unclosed_fence"), ("P0", "data_uri"), ("P0", "unsafe_link"), ("P1", "empty_link_destination")} <= set(found)
    found = audited(spark, "a `b\n[x\n&nbsp; [c](d e)\n\n\n\n인턴- 인턴십 기간:\n가)1) 나\n| - |\n|---|")
    assert {"unbalanced_inline_code", "unclosed_link_text", "html_entity", "link_destination_space", "repeated_blank_lines", "inline_dash_label", "inline_ordered_marker"} <= {c for _, c in found}
    assert set(audit.table_scan("|---|")) == {"table_row_without_separator"} and set(audit.table_scan("| |\n|---|")) == {"empty_table_header"}


def test_audit_gate(spark):
    issues = audit.audit(spark.createDataFrame([("a", "자격 • 나이"), ("b", "<p>")], "id string, content string"))
    assert audit.fails(issues, "P0").first()["failed"] is False and audit.fails(issues, "P1").first()["failing"] == 1 and audit.fails(issues, "P2").first()["failing"] == 2
    assert audit.examples(issues, 1).count() == 2 and audit.summary(issues).count() == 2


def test_audit_reports_over_every_code(spark):
    """The registered reports over all codes beside plain counts of each record's issues; equal and null ids are judged each."""
    from boardlark.catalogue import QUERIES

    sf = "/root/testdata/sf0.001"
    issues = [(str(r["doc_id"]), *i) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for i in audit.issues_of(r["text"])]
    counts = {}
    for _, severity, code, *_ in issues:
        counts[severity, code] = counts.get((severity, code), 0) + 1
    assert {(r["severity"], r["code"]): r["n"] for r in QUERIES["audit_summary_all"](spark, sf).collect()} == counts
    gate = QUERIES["audit_gate_all"](spark, sf).first()
    assert (gate["total"], gate["failing"]) == (len(issues), sum(i[1] <= "P1" for i in issues))
    first = {}
    for i, severity, code, line, _ in sorted(issues, key=lambda x: (x[0], x[3] or 0)):
        first.setdefault((severity, code), []).append(i)
    got = {}
    for r in QUERIES["audit_examples_all"](spark, sf).orderBy("severity", "code", "k").collect():
        got.setdefault((r["severity"], r["code"]), []).append(r["id"])
    assert got == {k: v[:3] for k, v in first.items()}
    twice = spark.createDataFrame([("a", "<p>"), ("a", "```"), (None, "&amp;")], "id string, content string")
    assert sorted((r["id"] or "", r["code"]) for r in audit.audit(twice).collect()) == [("", "html_entity"), ("a", "raw_html"), ("a", "unclosed_fence")]


def test_selectors():
    top = parse("<ul class='a b'><li id=x><a href='/q?m=1'>t</a><li><b>u</b></ul><p>v<div>w</div>")
    assert [n.text() for n in top.select("ul.a > li")] == ["t", "u"] and top.first("#x a[href*='m=1']").text() == "t" and top.select("ul > a") == [] and len(top.select("b, a")) == 2
    assert [n.tag for n in top.children if not isinstance(n, str)] == ["ul", "p", "div"]


OFFICIAL = """<div class="location_wrap"><ul class="location"><li>홈</li><li>학사</li></ul></div><table class="table_board"><tbody>
<tr class="emp"><td>공지</td><td class="title"><a href="?mode=read&seq=1">a</a></td></tr><tr><td>12</td><td class="title"><a href="?mode=read&seq=2">b</a></td></tr>
<tr><td>12</td><td class="title"><a href="?mode=read&seq=2">b</a></td></tr><tr><td>새</td><td class="tit"><a href="?mode=read&seq=3">c</a></td></tr></tbody></table>
<div class="view_header"><h4> 제 목 </h4><ul><li class="date">작성일2026.4.7</li><li class="attatch"><a href="/f.hwp" download="f 1.hwp">x</a><a href="/f.hwp">y</a></li></ul></div>
<div class="view_conts"><p>글 <img src="/i.png" alt=""></p><iframe src="/v" title="영상"></iframe></div>"""


def test_official_board(spark):
    u = "https://e.test/kaulife/notice.php?page=1"
    assert parsers.list_items(OFFICIAL, u, parsers.BOARDS["official"]) == [("https://e.test/kaulife/notice.php?mode=read&seq=1", True), ("https://e.test/kaulife/notice.php?mode=read&seq=2", False), ("https://e.test/kaulife/notice.php?mode=read&seq=3", True)]
    p = parsers.post(OFFICIAL, u, parsers.BOARDS["official"])
    assert p == {"title": "제 목", "content": "글 ![](https://e.test/i.png)", "published_at": "2026-04-07", "category": "학사", "attachments": [{"name": "f 1.hwp", "url": "https://e.test/f.hwp"}]}
    pages = spark.createDataFrame([(1, u, OFFICIAL)], "page_id bigint, url string, html string")
    assert parsers.parsed_posts(pages, parsers.BOARDS["official"]).first()["title"] == "제 목" and parsers.parsed_lists(pages, parsers.BOARDS["official"]).count() == 3
    assert [(r["type"], r["name"], r["url"]) for r in parsers.parsed_assets(pages).collect()] == [("inline_image", "i.png", "https://e.test/i.png")]
    assert parsers.parsed_assets(pages, "iframe").first()["name"] == "영상" and parsers.links(pages).count() == 6


def test_other_boards():
    u = "https://lib.test/sb/list.mir"
    html = """<table><tr onclick="go_view('7')"><td>1</td></tr><tr class="info" onclick="go_view('7')"><td>2</td></tr></table><p class="title">T</p><div class="view_file"><a href="#" onclick="download_file('7','x')">a.hwp</a></div>"""
    assert parsers.list_items(html, u, parsers.BOARDS["library"]) == [("https://lib.test/sb/default_notice_view.mir?sb_no=7", True)]
    assert parsers.post(html, u, parsers.BOARDS["library"])["attachments"] == [{"name": "a.hwp", "url": "https://lib.test/sb/filedownload.mir?sb_no=7&file=x"}]
    amtc = """<title>공지 | 원</title><h1 id="bo_v_title">t</h1><div id="bo_v_info">작성일 26-04-07 10:00</div><div id="bo_v_file"><a href="/a">a.pdf (1.2M)</a></div>"""
    p = parsers.post(amtc, "https://e.test/", parsers.BOARDS["amtc"])
    assert (p["published_at"], p["category"], p["attachments"][0]["name"]) == ("2026-04-07", "공지", "a.pdf")
    text = json.dumps({"resultList": [{"nttId": 5, "bbsId": "01", "ntcYn": "Y"}, {"nttId": 6, "ntcNo": "0"}, {"x": 1}]})
    assert parsers.json_items(text, "u?n={nttId}&b={bbsId}") == [("u?n=5&b=01", True), ("u?n=6&b=", False)] and parsers.json_items("x", "") == []
    assert parsers.iso_date("작성 2026/4/7") == "2026-04-07" and parsers.iso_date("26.4.7") is None


def test_snapshot(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps([{"a": 1}, 3, {"b": "é"}]), encoding="utf-8")
    assert [(r["_ord"], json.loads(r["raw"])) for r in snapshot.array(spark, str(path)).orderBy("_ord").collect()] == [(0, {"a": 1}), (2, {"b": "é"})]
    watched = snapshot.Watched(spark, str(path))
    assert watched.read().count() == 2
    path.write_text('{"not": "array"}')
    with pytest.raises(StoreError):
        snapshot.array(spark, str(path))
    assert watched.read().count() == 2
    (tmp_path / "c.json").write_text(json.dumps([{"id": "q1", "question": "?", "must_include_titles": ["x"], "filters": {"source": "s"}}]))
    assert snapshot.cases(spark, str(tmp_path / "c.json")).first()["filters"] == {"source": "s"}
    assert snapshot.previous_posts(spark, str(tmp_path / "none"), "original_url string").count() == 0
    (tmp_path / "l.jsonl").write_text('{"id": "1", "content": "x"}\n\n{"id": "2"}\n')
    assert [r["content"] for r in snapshot.records(snapshot.lines(spark, str(tmp_path / "l.jsonl"))).orderBy("id").collect()] == ["x", ""]


def test_files(spark, tmp_path):
    assert files.data_url("data:image/png;base64,QUJD") == ("image/png", b"ABC") and files.data_url("data:,a%20b") == ("text/plain", b"a b")
    for url, code in (("data:image/png;base64,@", "asset_download_failed"), ("x", "asset_download_failed"), ("data:;base64," + "A" * 40, "asset_too_large")):
        with pytest.raises(files.AssetError) as e:
            files.data_url(url, 20)
        assert e.value.code == code
    rows = spark.createDataFrame([("data:,abc",), (None,)], "url string")
    assert [(r["size"], r["error"]) for r in files.decoded_data_urls(rows).collect()] == [(3, None), (None, "asset_download_failed")]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("Contents/section1.xml", "<a><b>둘째</b></a>")
        z.writestr("Contents/section0.xml", "<a><b>첫째 " + "글" * 40 + "</b>\n<c> </c></a>")
        z.writestr("Contents/bad.xml", "<a>")
        z.writestr("other.xml", "<a>no</a>")
    (tmp_path / "a.hwpx").write_bytes(buffer.getvalue())
    (tmp_path / "b.hwpx").write_bytes(b"no zip")
    out = {r["path"][-6:]: r for r in files.hwpx_documents(files.binary_files(spark, str(tmp_path))).collect()}
    assert out["a.hwpx"]["text"].splitlines()[1] == "둘째" and out["b.hwpx"]["error"] == "unsupported_hwp_format"


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    (tmp_path / "in").mkdir()
    events.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "in" / "p"))
    stream = feeds.rate_windows(feeds.file_stream(spark, str(tmp_path / "in" / "p"), events.schema), "user_id", 1, width="1 day", late="60 days")
    query = stream.writeStream.format("memory").queryName("over").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = crawl.violations(events, "user_id", 1, width="1 day")
    key = lambda df: sorted((r["key"], r["start"], r["n"], r["over"]) for r in df.collect())
    assert key(spark.table("over")) == key(batch)
    done = feeds.write_once(feeds.sessions(feeds.file_stream(spark, str(tmp_path / "in" / "p"), events.schema), "user_id"), str(tmp_path / "out"), str(tmp_path / "cp"))
    done.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0


def test_boards_and_failures(spark):
    from boardlark.sources import boards

    sites = boards.table(spark, [boards.Site("a", "A", "official", "t1", "https://e.test/a?page={page}"), boards.Site("b", "B", "json", "t2", "https://e.test/b/{page}", 3)])
    assert {(r["key"], r["url"]) for r in boards.list_pages(sites, 2).collect()} == {("a", "https://e.test/a?page=1"), ("a", "https://e.test/a?page=2"), ("b", "https://e.test/b/1"), ("b", "https://e.test/b/2"), ("b", "https://e.test/b/3")}
    posts = spark.createDataFrame([(1, ["t2", "t1"]), (2, ["t9"])], "_ord bigint, source_type array<string>")
    assert [(r["_ord"], r["key"]) for r in boards.of_posts(posts, sites).collect()] == [(1, "a")]
    ids = spark.createDataFrame([("https://e.test/x.do?nttId=5&bbsId=01",)], "u string").select(boards.detail_ids("u").alias("d")).first()["d"]
    assert (ids["nttId"], ids["bbsId"]) == ("5", "01")
    pages = spark.createDataFrame([(1, "https://e.test/1", "<h4>t</h4>"), (2, "https://e.test/2", "")], "page_id bigint, url string, html string")
    bad = parsers.failed_items(parsers.parsed_posts(pages, parsers.BOARDS["ctl"]))
    assert {r["reason"] for r in bad.collect()} == {"required_field_empty:content", "required_field_empty:title,content"}


def test_lock(spark, tmp_path):
    from boardlark.operators.store import Lock

    a, b = (Lock(spark, f"file://{tmp_path}/lock") for _ in range(2))
    assert a.acquire() and not b.acquire()
    a.release()
    assert b.acquire()
    b.release()


def test_schedule(spark, tmp_path):
    from boardlark.operators.store import Lock

    seen, waits = [], []

    def cycle():
        seen.append(1)
        if len(seen) == 2:
            raise ValueError

    lock = Lock(spark, f"file://{tmp_path}/schedule")
    assert feeds.scheduled(cycle, 0, lock, rounds=2, sleep=waits.append) == ["published", "failed:ValueError", "published"] and waits == [1, 1]
    assert feeds.scheduled(cycle, 5, lock, run_on_startup=False, rounds=0) == [] and lock.acquire()
    assert feeds.scheduled(cycle, 5, Lock(spark, f"file://{tmp_path}/schedule"), rounds=1) == ["locked"]


def test_merge_cycle_keeps_the_last_state_if_refused(spark):
    from boardlark.schemas import POSTS

    base = {"source_name": [], "source_type": [], "category_raw": [], "attachments": [], "is_permanent_notice": False, "published_at": "2026-05-01"}
    make = lambda *urls: spark.createDataFrame([base | {"_ord": k, "original_url": f"https://e.test/{u}", "title": u} for k, u in enumerate(urls)], POSTS)
    state = [make("a")]
    run = feeds.merge_cycle(lambda: state[-1], state.append, "2026-05-15")
    run(make("a", "b"), 0)
    assert sorted(r["title"] for r in state[-1].collect()) == ["a", "b"] and len(state) == 2
    feeds.merge_cycle(lambda: state[-1], state.append, "2026-05-15", min_records=9)(make("c"), 1)
    assert len(state) == 2


def test_sequence_and_permanent_first(spark):
    items = spark.createDataFrame([("b", 1, 0, False), ("b", 1, 1, True), ("a", 1, 0, False)], "board string, page int, pos int, is_permanent_notice boolean")
    assert [(r["board"], r["pos"]) for r in crawl.permanent_first(items).collect()] == [("a", 0), ("b", 1), ("b", 0)]


def test_titles_equal_their_sql_on_odd_pages(spark):
    duckdb = pytest.importorskip("duckdb")
    from boardlark.catalogue import ORACLE_SQL

    titles = ("a &amp;&amp; b&amp", "token = &quot;0b96", "&lt;b&gt; &amp;amp; c", "\n a\tb\x0bc \u3000\xa0", "\xa0x\u2003y", "", "$1 \\1")
    pages = [None, "", "<p>x", "<title>open", "<TITLE lang=x>a</TitlE><title>z</title>", "<!-- <title>c</title> --><title>d</title>", *(f"<head><title>{t}</title></head>" for t in titles)]
    rows = list(enumerate(pages))
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    assert sorted(tuple(r) for r in parsers.titles(spark.createDataFrame(rows, "page_id bigint, html string").selectExpr("*", "'' AS url")).collect()) == sorted(con.execute(ORACLE_SQL["html_title"]).fetchall())


def test_texts_are_converted_in_steps_of_bounded_bytes(spark):
    import pyarrow as pa

    texts = [None, "", "a" * 3_000_000, *["b" * 300_000] * 20, None]
    steps = [step.to_pylist() for step in m._steps(pa.array(texts))]
    assert sum(steps, []) == texts and all(sum(len(t or "") for t in s[1:]) <= m.STEP_BYTES for s in steps) and list(m._steps(pa.array([], pa.string()))) == []
    rows = spark.createDataFrame(list(enumerate([None, " ", "<p>a</p>", "x" * 2_000_000, *["b • c"] * 50])), "k int, t string").coalesce(1)
    got = [r["t"] for r in rows.select("k", m.normalized_content("t").alias("t")).orderBy("k").collect()]
    assert got == [None, "", "a", "x" * 2_000_000, *["b\n• c"] * 50] and rows.where("k < 0").select(m.markdown("t")).count() == 0
