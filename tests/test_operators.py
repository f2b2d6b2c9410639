"""Search, classification, normalisation, merging, retention, store, answers, enrichment and crawls on literal cases."""

import json
import time
from datetime import date

import pytest
from pyspark.sql import functions as F

from boardlark.operators import crawl, dedup, enrich, evaluate, facets, normalize, rag, search
from boardlark.operators.classify import classified
from boardlark.operators.search import Filters
from boardlark.operators.store import ChatLog, Store, StoreError, aligned, guard, trimmed_sessions
from boardlark.rules import UNIVERSITY
from boardlark.schemas import CHAT_MESSAGES, NOTICES, POSTS
from boardlark.sources.providers import Scripted

TODAY = "2026-05-15"


def notice(id_, title, source, category, day, content="본문", tags=()):
    return {"id": id_, "title": title, "content": content, "source": source, "sources": [source], "category": category, "published_at": day, "tags": list(tags), "attachments": []}


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [
        notice("common-academic", "수강신청 안내", "한국항공대학교 공식 홈페이지", "학사", "2026-04-20"),
        notice("common-general", "식당 안내", "한국항공대학교 공식 홈페이지", "일반공지", "2026-04-22"),
        notice("cs", "AI 경진대회", "한국항공대학교 컴퓨터공학과", "행사", "2026-04-23", "기말시험 뒤 대회"),
        notice("material-job", "채용", "신소재공학과 취업공지", "취업", "2026-04-21"),
        notice("graduate", "대학원 공지", "일반대학원", "학사", "2026-04-24", "장학금 신청"),
    ]
    df = spark.createDataFrame(rows, NOTICES.split(", searchable_text")[0].replace("\n", " ").replace("audience_group string, source_group string,", "").replace("source_groups array<string>, ", ""))
    return search.searchable(classified(df)).cache()


def ids(df):
    return [r["id"] for r in df.collect()]


def test_terms_and_synonyms():
    assert search.terms("공모전 정보 알려줘") == ["공모전"] and search.terms("최신 공지") == ["최신", "공지"] and search.terms("a 7 b") == ["7"]
    assert search.expanded(["ai융합대"]) == ["ai융합대", "AI융합대학", "AI융합"]
    assert search.expanded(["기말시험"]) == ["기말시험", "기말고사"] and search.term_groups("장학 장학금") == [["장학", "장학금", "장학생"]]
    assert search.clamp(-10, 999, 5) == (1, 100, 1) and search.clamp(9, None, 45) == (3, 20, 3)


def test_classification(corpus):
    got = {r["id"]: (r["audience_group"], r["source_groups"]) for r in corpus.collect()}
    assert got["common-academic"] == ("전 구성원 공통", ["학사"]) and got["common-general"] == ("전 구성원 공통", ["일반"])
    assert got["cs"] == ("학부 재학생(학과/전공별)", ["AI융합대"]) and got["graduate"] == ("대학원생", []) and got["material-job"][1] == ["학과 취업공지"]


def test_classification_of_several_sources(spark):
    rows = spark.createDataFrame([("t", ["한국항공대학교 컴퓨터공학과", "항공우주공학전공"], None), ("t", ["어디"], None), ("t", [], None), ("t", ["국제교류처", "교수학습센터"], None)], "title string, sources array<string>, category string").withColumn("source", F.lit(None).cast("string"))
    got = [(r["audience_group"], r["source_groups"], r["source_group"]) for r in classified(rows).collect()]
    assert got == [("학부 재학생(학과/전공별)", ["공과대", "AI융합대"], "공과대"), ("그 외", [], None), ("그 외", [], None), ("재학생 비교과·글로벌 프로그램", ["국제교류", "교수학습센터"], "국제교류")]


def test_search_modes(corpus):
    found = search.search(corpus, "대회", today=TODAY)
    assert ids(found.items) == ["cs"] and found.total == 1
    assert ids(search.search(corpus, "기말고사", today=TODAY).items) == ["cs"]  # by synonym
    assert search.search(corpus, "기말고사", today=TODAY, mode="fallback").total == 0
    assert ids(search.search(corpus, "  ").items) == ["graduate", "cs", "common-general", "material-job", "common-academic"]
    assert search.search(corpus, "경_대회").total == 1 and ids(search.search(corpus, "경_대회").items) == []  # wildcards count, items need the text
    assert ids(search.search(corpus, "수강 신청", today=TODAY).items)[0] == "common-academic"
    assert ids(search.relevant(corpus, "없는말", 2, TODAY)) == ["graduate", "cs"] and ids(search.relevant(corpus, "없는말", 2, TODAY, or_latest=False)) == []


def test_title_beats_newer_body(spark, corpus):
    rows = corpus.withColumn("content", F.when(F.col("id") == "graduate", "수강신청").otherwise(F.col("content")))
    assert ids(search.search(search.searchable(rows), "수강신청", today=TODAY).items)[:2] == ["common-academic", "graduate"]


def test_filters(corpus):
    assert ids(search.filtered(corpus, Filters(audience="대학원생", source="일반대학원"))) == ["graduate"]
    assert len(ids(search.filtered(corpus, Filters(audience="전 구성원 공통", source="다른 곳")))) == 2  # the source doesn't count here
    assert len(ids(search.filtered(corpus, Filters(source_group="없음"), known_groups=["학사"]))) == 5


def test_cube_equals_single_facets(corpus):
    cells = {(r["audience"], r["source_group"]): r for r in facets.cube(corpus).collect()}
    whole = cells["", ""]
    assert whole["audience_groups"] == [r["value"] for r in facets.audiences(corpus).orderBy("ordinal").collect()]
    assert whole["source_groups"] == [r["value"] for r in facets.source_groups(corpus).orderBy("ordinal").collect()] and whole["sources"] == []
    own = cells["대학원생", ""]
    assert own["sources"] == ["일반대학원"] and own["source_groups"] == []
    assert set(cells) >= {("전 구성원 공통", "학사"), ("", "학사"), ("학부 재학생(학과/전공별)", "AI융합대")}


def test_categories_rules(spark):
    def of(values):
        return [r["value"] for r in facets.categories(spark.createDataFrame([(v,) for v in values], "category string")).orderBy("value").collect()]

    assert of(["bb"] * 2 + ["aa"] * 3 + ["x"]) == ["aa", "bb"] and of(["bb"] * 2 + ["a1", "a2"]) == [] and of([f"c{k}" for k in range(19)] * 2) == []
    assert of(["<b>"] * 2 + ["ok"] * 2) == ["ok"] and len(of([f"c{k:02}" for k in range(15)] * 2)) == 12


def raw(*objects):
    return [(k, json.dumps(o)) for k, o in enumerate(objects)]


def test_normalize(spark):
    rows = spark.createDataFrame(raw(
        {"title": "수강신청 안내", "content": "<p>수강신청 기간을 확인하세요.</p>", "source_name": "공식", "category_raw": "학사", "published_at": "2026-04-20T10:00:00+09:00", "attachments": ["https://e.test/f.pdf", {"href": "u", "filename": "n"}, {"name": "x"}, 3]},
        {"subject": "복수", "body": "본문", "source_name": ["가", " ", "나"], "date": "2026-04-21", "tags": ["t", 1]},
        {},
        {"date": "bad", "published_at": "2026-01-01", "id": " "},
    ), "_ord bigint, raw string")
    a, b, c, d = normalize.notices(rows).orderBy("_ord").collect()
    assert (a["content"], a["source"], a["published_at"], a["tags"]) == ("수강신청 기간을 확인하세요.", "공식", "2026-04-20", ["학사", "공식"])
    assert [(x["name"], x["url"]) for x in a["attachments"]] == [("첨부파일", "https://e.test/f.pdf"), ("n", "u")]
    assert (b["source"], b["sources"], b["tags"]) == ("가", ["가", "나"], ["t", "가", "나"])
    assert (c["title"], c["content"]) == ("제목 없음 공지 3", "본문 정보가 비어 있습니다.") and c["id"].startswith("제목-없음-공지-3")
    assert d["published_at"] is None  # a bad date hides the later field


def test_suffixed_ids(spark):
    rows = spark.createDataFrame([(0, "same"), (1, "x"), (2, "same"), (3, "same")], "_ord bigint, id string")
    assert [r["id"] for r in normalize.suffixed_ids(rows).orderBy("_ord").collect()] == ["same", "x", "same-2", "same-3"]


def posts(spark, *rows):
    base = {"source_name": [], "source_type": [], "category_raw": [], "attachments": [], "is_permanent_notice": False}
    return spark.createDataFrame([base | {"_ord": k, "original_url": f"https://e.test/{k}", "title": f"t{k}"} | r for k, r in enumerate(rows)], POSTS)


def test_merge_by_url_and_title(spark):
    old = posts(spark, {"title": "Same  Title", "source_name": ["a"], "attachments": [{"name": "f", "url": "u1"}]}, {"title": ""}, {"title": ""})
    new = posts(spark, {"original_url": "https://e.test/0#x", "title": "other", "is_permanent_notice": True}, {"original_url": "https://e.test/9", "title": "same title", "source_name": ["b", "a"], "attachments": [{"name": "g", "url": "u1"}, {"name": "h", "url": "u2"}]})
    out, counts = dedup.merge(old, new)
    rows = {r["original_url"]: r for r in out.collect()}
    assert counts == {"url_removed": 1, "title_removed": 1} and len(rows) == 3
    first = rows["https://e.test/0"]
    assert first["source_name"] == ["a", "b"] and first["is_permanent_notice"] and [x["url"] for x in first["attachments"]] == ["u1", "u2"]
    assert [m["original_url"] for m in first["source_meta"]] == ["https://e.test/0", "https://e.test/9"] and rows["https://e.test/1"]["source_meta"] is None
    again, counts = dedup.merge(out.withColumn("_ord", F.monotonically_increasing_id()), posts(spark))
    assert counts == {"url_removed": 0, "title_removed": 0} and again.count() == 3


def test_blank_urls_are_one(spark):
    rows = posts(spark, {"original_url": None}, {"original_url": ""}, {})
    assert dedup.by_url(rows).count() == 2 and dedup.by_url(rows, keep_blank=False).count() == 1


def test_retention(spark):
    m = lambda d, p=False: {"source_name": [], "source_type": [], "category_raw": [], "original_url": "", "published_at": d, "crawled_at": None, "is_permanent_notice": p}
    rows = posts(
        spark, {"published_at": "2025-04-30"}, {"published_at": "2025-05-01"}, {"published_at": "2024-04-30", "is_permanent_notice": True}, {"published_at": None},
        {"published_at": "2024-04-30", "source_meta": [m("2024-04-30"), m("2026-04-01")]}, {"published_at": "2024-04-30", "is_permanent_notice": True, "source_meta": [m("2024-01-01")]}, {"published_at": "2024-04-30", "source_meta": [m("2024-01-01", True)]},
    )
    assert [r["_ord"] for r in dedup.prune(rows, "2026-04-30").orderBy("_ord").collect()] == [1, 2, 3, 4, 6]


def test_known_urls(spark):
    rows = posts(spark, {"source_meta": [{"source_name": [], "source_type": [], "category_raw": [], "original_url": "https://e.test/z#a", "published_at": None, "crawled_at": None, "is_permanent_notice": False}]}, {"original_url": "https://e.test/z"})
    assert {r["url"]: r["_ord"] for r in dedup.known_urls(rows).collect()} == {"https://e.test/0": 0, "https://e.test/z": 1}


def test_store(spark, tmp_path, corpus):
    store = Store(spark, f"file://{tmp_path}/store")
    with pytest.raises(StoreError):
        store.notices()
    rows = corpus.withColumn("_ord", F.monotonically_increasing_id())
    assert store.publish(rows) == 5 and ids(store.ordered())[0] == "graduate" and ids(store.by_id("cs")) == ["cs"]
    with pytest.raises(StoreError):
        store.publish(rows.limit(1))
    assert store.notices().count() == 5
    with pytest.raises(StoreError):
        store.publish(rows.withColumn("id", F.when(F.col("id") == "cs", "graduate").when(F.col("id") == "common-general", "graduate-2").otherwise(F.col("id"))))
    for k in range(4):  # generations besides the current one stay for their readers, older ones go
        opened = store.notices()
        store.publish(rows)
        assert opened.count() == 5
    assert len([p for p in (tmp_path / "store").iterdir() if p.name.startswith("gen-")]) == 3
    cells, group = store.facets("전 구성원 공통", "학사")
    assert group == "학사" and cells["source_groups"] == ["일반", "학사"] and store.facets("전 구성원 공통", "공과대")[1] is None
    with pytest.raises(StoreError):
        guard(4, 10)


def test_chat_log(spark, tmp_path):
    log = ChatLog(spark, f"file://{tmp_path}/log")
    assert log.read().count() == 0
    rows = spark.createDataFrame([{"id": k, "session_id": "s", "role": "user", "content": "x" * 600} for k in range(12)], CHAT_MESSAGES)
    assert log.append(rows) and [r["id"] for r in log.session("s").collect()] == list(range(12))
    kept = trimmed_sessions(log.read()).collect()
    assert len(kept) == 10 and all(len(r["content"]) == 503 for r in kept)
    assert aligned(spark.range(1).select("id"), spark.range(1).withColumn("b", F.lit(2))).count() == 2


def test_answers(corpus):
    plain = rag.ask(corpus, "장학금", today=date(2026, 5, 15))
    assert plain.used_fallback and plain.references[0]["id"] == "graduate" and "1. 대학원 공지" in plain.answer
    model = Scripted(['{"mode": "search", "keywords": ["장학금"]}', "답"])
    out = rag.ask(corpus, "알려줘", model=model, today=date(2026, 5, 15), filters=Filters(audience="대학원생"))
    assert (out.answer, out.used_fallback, [r["id"] for r in out.references]) == ("답", False, ["graduate"])
    assert rag.ask(corpus, "비트코인", model=Scripted(['{"mode": "out_of_domain", "keywords": []}'])).answer == rag.OUT_OF_DOMAIN
    kinds = [k for k, _ in rag.stream(corpus, "더 짧게", history=[{"role": "user", "content": "a"}], model=Scripted(['{"mode":"history"}', "짧게"]))]
    assert kinds == ["search_started", "search_completed", "answer_delta", "answer_completed"]
    with pytest.raises(ValueError):
        rag.ask(corpus, " ")


def test_reply_parsing():
    assert rag.parse_list('```json\n["a", 2, null]\n```') == ["a", "2"] and rag.parse_list("[]") == [] and rag.parse_list("no") is None
    assert rag.parse_triage('{"mode":"HISTORY","keywords":["x"]}', False) == rag.Triage("search", ["x"])
    assert rag.parse_triage("[]", True) == rag.Triage("search", []) and rag.parse_triage("[]", False) == rag.Triage("out_of_domain", []) and rag.parse_triage("?", False) is None
    assert rag.output_text({"output": [{"content": [{"text": "a"}, {"text": "b"}]}]}) == "a\nb"


def test_rerank(corpus):
    pool = rag.positions(corpus, F.desc("published_at"))
    assert ids(rag.chosen(["cs", "?", "common-general"], pool).orderBy("pos")) == ["cs", "common-general"]
    assert ids(rag.chosen([], pool)) == [] and len(ids(rag.chosen(["?"], pool))) == 5 and len(ids(rag.chosen(None, pool, 2))) == 2


def test_enrichment(spark):
    asset = lambda n, t="inline_image": {"type": t, "name": n, "url": f"https://e.test/{n}", "source": "body"}
    rows = posts(
        spark, {"content": "", "content_assets": [asset("a.png"), asset("a.png")]}, {"content": "충분히 긴 본문입니다. " * 5, "content_assets": [asset("b.png")]},
        {"content": "[이미지 본문]", "content_assets": [asset("c.png")], "attachments": [{"name": "d.hwp", "url": "https://e.test/d.hwp"}]}, {"content": "", "attachments": [{"name": "e.zip", "url": "https://e.test/e.zip"}]}, {"content": "짧음", "content_assets": [asset("f.png")]},
    )
    assert [r["n"] for r in rows.orderBy("_ord").select(F.size(enrich.assets()).alias("n")).collect()] == [1, 1, 2, 0, 1]
    assert [r["t"] for r in rows.orderBy("_ord").select(enrich.trigger().alias("t")).collect()] == ["inline_image", "inline_image", "inline_image_and_hwp_attachment", "unknown", "inline_image"]
    out = enrich.enrich(rows, lambda a: a["name"], lambda p, t: "글" * 40, most=4)
    assert [(r["_ord"], r["status"]) for r in out.orderBy("_ord").collect()] == [(0, "success"), (2, "success"), (4, "skipped")]
    assert enrich.run_counts(out, 5).first().asDict() == {"target_count": 3, "attempted": 2, "succeeded": 2, "failed": 0, "skipped": 3}
    filled = rows.select("_ord", enrich.filled_content("content", "content_assets", F.array().cast("array<struct<name:string,url:string>>"), "attachments").alias("c")).orderBy("_ord").collect()
    assert filled[0]["c"] == "**[이미지 본문]** 텍스트 본문 없음 (이미지 2개)\n\n- a.png" and filled[3]["c"] == "**[첨부파일 공지]**\n\n- e.zip"


def test_evaluation(spark):
    cases = spark.createDataFrame([("a", ["x", "y"]), ("b", []), ("c", ["z"])], "case_id string, must array<string>")
    got = spark.createDataFrame([("a", 1, "q"), ("a", 7, "has y"), ("a", 2, "has x"), ("c", 1, "n")], "case_id string, rank int, title string")
    rows = {r["case_id"]: r for r in evaluate.scored(cases, got).collect()}
    assert (rows["a"]["recall_at_5"], rows["a"]["recall_at_10"], rows["a"]["reciprocal_rank"]) == (0.5, 1.0, 0.5)
    assert (rows["b"]["recall_at_5"], rows["b"]["reciprocal_rank"], rows["c"]["recall_at_10"]) == (1.0, 0.0, 0.0)
    scores = spark.createDataFrame([("a", 1, 0.1), ("a", 2, float("nan"))], "case_id string, _ord int, s double")
    assert evaluate.clean_scores(evaluate.with_scores(cases, scores), ["s"]).where("case_id = 'a' AND s IS NULL").count() == 1


def item(url, day="2026-05-01", fixed=False):
    return {"url": url, "is_permanent_notice": fixed, "published_at": day}


def test_crawl_replay():
    run = lambda pages, known=(), dates=None: crawl.replay_board(pages, set(known), dict(dates or {}), date(2026, 5, 15))
    taken, stop = run([[item("p", fixed=True), item("a")], [item("p", fixed=True), item("a")]])
    assert [t["url"] for t in taken] == ["p", "a"] and stop == "repeated_page"
    assert run([[item("p", fixed=True)], [item("a")], []])[1] == "empty_page"
    taken, stop = run([[item("a"), item("p", fixed=True)], [item("b")]], known=["a"])
    assert [t["url"] for t in taken] == ["p"] and stop == "no_new_general"
    taken, stop = run([[item("a"), item("old", "2025-05-15"), item("b")]])
    assert [t["url"] for t in taken] == ["a"] and stop == "old_notice"
    assert run([[item("a"), item("n")]], known=["a"], dates={"a": "2020-01-01"})[1] == "old_notice"


def test_parallel_and_sequential_replay_agree_without_shared_urls(spark):
    rows = [(b, p, k, f"{b}{p}{k}", k == 0, "2026-05-01" if p < 3 else "2020-01-01") for b in "xy" for p in (1, 2, 3) for k in range(3)]
    items = spark.createDataFrame(rows, "board string, page long, pos long, url string, is_permanent_notice boolean, published_at string")
    known = spark.createDataFrame([("x11", "2026-05-01")], "url string, published_at string")
    a, b = (sorted(map(tuple, f(items, known, "2026-05-15").collect())) for f in (crawl.replay, crawl.replay_in_order))
    assert a == b and {r[3] for r in a} == {"old_notice"}


def test_robots(spark):
    text = "User-agent: *\nDisallow: /\n\nUser-agent: mybot\nUser-agent: other\nAllow: /a # c\nDisallow: /a/b\nDisallow:\n"
    assert crawl.robots_rules(text, "MyBot/1.0") == [("allow", "/a"), ("disallow", "/a/b")] and crawl.robots_rules(text, "x") == [("disallow", "/")]
    rules = spark.createDataFrame([("h", a, p) for a, p in [*crawl.robots_rules(text, "mybot"), ("allow", "/a/b")]], "host string, action string, prefix string")
    urls = spark.createDataFrame([("h", "/a/b/c"), ("h", "/z"), ("o", "/a/b")], "host string, path string")
    assert {(r["host"], r["path"]): r["allowed"] for r in crawl.allowed(urls, rules).collect()} == {("h", "/a/b/c"): True, ("h", "/z"): True, ("o", "/a/b"): True}
    assert not crawl.allowed(urls, rules.where("action = 'disallow'")).where("path = '/a/b/c'").first()["allowed"]


def test_taxonomy_orders():
    assert len(UNIVERSITY.audience_order) == 8 and len(UNIVERSITY.group_order) == 25


def test_api_and_command_line(spark, tmp_path, corpus, capsys):
    from boardlark.__main__ import main
    from boardlark.api import Notices, number

    assert number("x", 3) == 3 and number(" 7 ", 1) == 7
    store = Store(spark, f"file://{tmp_path}/api")
    store.publish(corpus.withColumn("_ord", F.monotonically_increasing_id()))
    api = Notices(store)
    first = api.page("대회", page="x", page_size="999", today=date(2026, 5, 15))
    assert (first.total, first.page, first.page_size, first.items[0]["id"]) == (1, 1, 100, "cs") and first.facets["sources"] == []
    assert api.page(filters=Filters(audience="대학원생", source_group="없음")).effective_source_group is None
    assert api.one("cs")["title"] == "AI 경진대회" and api.one("none") is None and api.ask("장학금").references[0]["id"] == "graduate"
    path = tmp_path / "in.json"
    path.write_text(json.dumps([{"title": "a", "content": "<p>본문</p>", "id": "1"}, {"title": "b", "content": "자격 • 나이"}]), encoding="utf-8")
    assert main(["publish", "--input", str(path), "--store", f"file://{tmp_path}/cli"]) == 0
    assert main(["audit", "--json", str(path)]) == 1 and "raw_html" in capsys.readouterr().out
    assert main(["audit", "--store", f"file://{tmp_path}/cli", "--fail-on", "P0", "--format", "json"]) == 0


def test_provenance(spark):
    rows = posts(spark, {"title": "A"}, {"title": " a "}, {"title": ""}, {"title": ""})
    assert [(r["_ord"], r["survivor"]) for r in dedup.provenance(rows).orderBy("_ord").collect()] == [(0, 0), (1, 0), (2, 2), (3, 3)]


def one_title(spark, n):
    """n posts of one title in 4 splits: every third has the URL of the one before, every file is its own but for the URL of the first."""
    names = [F.array(F.lit("a")).alias(c) for c in ("source_name", "source_type", "category_raw")]
    nothing = [F.lit(None).cast("string").alias(c) for c in ("published_at", "crawled_at")]
    k = F.when(F.col("id") % 3 == 2, F.col("id") - 1).otherwise(F.col("id")).cast("string")
    files = F.array(*[F.struct(F.lit("f").alias("name"), F.concat(F.lit("f"), x).alias("url")) for x in (F.col("id").cast("string"), F.lit("0"))])
    return spark.range(0, n, 1, 4).select(F.col("id").alias("_ord"), F.lit("T").alias("title"), k.alias("original_url"), files.alias("attachments"), F.lit(False).alias("is_permanent_notice"), *names, *nothing)


def test_a_large_group_of_one_title_merges_its_metas(spark):
    start = time.monotonic()
    (row,) = dedup.by_title(one_title(spark, 15_000)).select("_ord", F.transform("source_meta", lambda m: m["original_url"]).alias("urls")).collect()
    assert row["_ord"] == 0 and row["urls"] == [str(k) for k in range(15_000) if k % 3 != 2]
    assert time.monotonic() - start < 20  # every post against every other took minutes


def test_a_large_group_of_one_title_merges_its_files(spark):
    start = time.monotonic()
    (row,) = dedup.by_title(one_title(spark, 15_000)).select(F.transform("attachments", lambda a: a["url"]).alias("urls")).collect()
    assert row["urls"] == ["f0", "f0", *(f"f{k}" for k in range(1, 15_000))]  # the survivor's own files all stay
    assert time.monotonic() - start < 20


def published(spark, name):
    """The tables that a query of the catalogue publishes when it is the first of its application."""
    from boardlark.catalogue import QUERIES
    from boardlark.plans import view

    view._PUBLISHED.clear()
    QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    return [spark.read.parquet(where) for where in view._PUBLISHED.values()]


@pytest.mark.parametrize("name", ["rank_all", "search_like_wildcard_total"])
def test_texts_are_published_without_sorting_them(spark, name):
    (table,) = published(spark, name)
    assert table.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    placed = table.select(F.input_file_name().alias("f"), F.struct("audience_group", "published_at").alias("v"), F.monotonically_increasing_id().alias("k"))
    files = placed.groupBy("f").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("rows")).select(F.transform("rows", lambda r: r["v"]).alias("v"))
    assert files.where(F.col("v") != F.sort_array("v")).count() > 0


@pytest.mark.parametrize("name", ["classify_source", "facet_cube"])
def test_queries_of_narrow_columns_publish_no_texts(spark, name):
    (table,) = published(spark, name)
    assert table.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert not {"content", "searchable_text", "searchable_compact"} & set(table.columns)
