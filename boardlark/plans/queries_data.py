"""Registered queries: identifiers, merging, retention, URLs, HTML, scalar functions, audit, evaluation, sessions, crawls, answers, assets."""

from __future__ import annotations

from pyspark.sql import functions as F

from boardlark.functions import assets as A
from boardlark.functions import dates as D
from boardlark.functions import text as T
from boardlark.functions import urls as U
from boardlark.operators import audit, crawl, dedup, enrich, evaluate, markdown, rag, search
from boardlark.operators.normalize import notices as normalized
from boardlark.operators.normalize import suffixed_ids
from boardlark.operators.store import retained, trimmed_sessions
from boardlark.plans.queries_search import score_sql
from boardlark.plans.registry import query
from boardlark.plans.view import SQL, TODAY, notices, plain, read
from boardlark.sources import parsers

EMPTY_META = "array<struct<source_name:array<string>,source_type:array<string>,category_raw:array<string>,original_url:string,published_at:string,crawled_at:string,is_permanent_notice:boolean>>"


def posts(spark, d):
    """Crawled posts: notices with the page whose number is their id modulo the pages' number, so URLs and titles both repeat."""
    n = read(spark, d, "pages").count()
    docs = plain(spark, d)
    pages = read(spark, d, "pages").select(F.col("page_id").alias("_page"), F.col("url").alias("original_url"))
    rows = docs.withColumn("_page", F.col("_ord") % n).join(pages, "_page")
    return rows.select(
        "_ord", "title", "content", "original_url", F.array("source").alias("source_name"), F.array("category").alias("source_type"), F.array("category").alias("category_raw"),
        "published_at", F.lit(None).cast("string").alias("crawled_at"), F.array(F.struct(F.col("source").alias("name"), F.concat(F.lit("https://files.test/"), "source").alias("url"))).alias("attachments"),
        F.col("permanent").alias("is_permanent_notice"),
    )


POSTS = rf"""WITH {SQL}, pages_n AS (SELECT count(*) AS k FROM pages),
posts AS (SELECT ord, title, p.url AS original_url, source, category, published_at, permanent, lower(trim(regexp_replace(title, '\s+', ' ', 'g'))) AS tkey
  FROM notice, pages_n JOIN pages p ON p.page_id = ord % k)"""
#: The generic rule for URLs: no fragment, pairs in order.
_URL = "CASE WHEN contains(u, '?') THEN split_part(u, '?', 1) || '?' || array_to_string(list_sort(string_split(split_part(u, '?', 2), '&')), '&') ELSE u END"


@query(f"WITH {SQL}, k AS (SELECT ord, title, row_number() OVER (PARTITION BY title ORDER BY ord) AS k FROM notice) SELECT ord, CASE WHEN k > 1 THEN title || '-' || k ELSE title END AS id FROM k")
def dup_id_suffix(spark, d):
    return suffixed_ids(plain(spark, d).withColumn("id", F.col("title"))).select(F.col("_ord").alias("ord"), "id")


@query(f"{POSTS}, u AS (SELECT *, regexp_replace(original_url, '#.*$', '') AS u FROM posts), c AS (SELECT *, {_URL} AS url FROM u) SELECT url, min(ord) AS ord, bool_or(permanent) AS permanent FROM c GROUP BY url")
def url_first_wins(spark, d):
    return dedup.by_url(posts(spark, d)).select(F.col("original_url").alias("url"), F.col("_ord").alias("ord"), F.col("is_permanent_notice").alias("permanent"))


@query(f"{POSTS} SELECT min(ord) AS ord, count(DISTINCT (source, category, original_url)) AS n, bool_or(permanent) AS permanent FROM posts GROUP BY CASE WHEN tkey = '' THEN 'o' || ord ELSE 't' || tkey END")
def title_merge_counts(spark, d):
    out = dedup.by_title(posts(spark, d).drop("content"))  # bodies play no part, and needn't travel with the survivors
    return out.select(F.col("_ord").alias("ord"), F.coalesce(F.size("source_meta"), F.lit(1)).cast("long").alias("n"), F.col("is_permanent_notice").alias("permanent"))


@query(f"""{POSTS}, g AS (SELECT *, CASE WHEN tkey = '' THEN 'o' || ord ELSE 't' || tkey END AS k FROM posts), s AS (SELECT k, source, min(ord) AS o FROM g GROUP BY ALL),
c AS (SELECT k, category, min(ord) AS o FROM g GROUP BY ALL), s1 AS (SELECT k, string_agg(source, '|' ORDER BY o) AS sources, string_agg('https://files.test/' || source, '|' ORDER BY o) AS files FROM s GROUP BY k),
c1 AS (SELECT k, string_agg(category, '|' ORDER BY o) AS categories FROM c GROUP BY k), o1 AS (SELECT k, min(ord) AS ord FROM g GROUP BY k) SELECT ord, sources, categories, files FROM o1 JOIN s1 USING (k) JOIN c1 USING (k)""")
def title_merge_sources(spark, d):
    out = dedup.by_title(posts(spark, d).drop("content"))
    return out.select(F.col("_ord").alias("ord"), F.array_join("source_name", "|").alias("sources"), F.array_join("category_raw", "|").alias("categories"), F.array_join(F.transform("attachments", lambda a: a["url"]), "|").alias("files"))


@query(f"WITH {SQL} SELECT id, published_at FROM notice WHERE permanent OR CAST(published_at AS DATE) > DATE '{TODAY}' - 365")
def retention_prune(spark, d):
    rows = plain(spark, d).withColumn("is_permanent_notice", F.col("permanent"))
    return dedup.prune(rows, TODAY).select("id", "published_at")


@query(f"WITH {SQL}, k AS (SELECT count(*) AS n, count(*) FILTER (permanent OR CAST(published_at AS DATE) > DATE '{TODAY}' - 365) AS base FROM notice) SELECT n AS new_count, base AS old_count, n >= 1 AND n >= base * 0.5 AS publish FROM k")
def publish_guard(spark, d):
    from boardlark.operators.store import StoreError, guard

    rows = plain(spark, d).withColumn("is_permanent_notice", F.col("permanent"))
    new, old = rows.count(), retained(rows, TODAY)
    try:
        guard(new, old)
        ok = True
    except StoreError:
        ok = False
    return spark.createDataFrame([(new, old, ok)], "new_count bigint, old_count bigint, publish boolean")


@query(f"SELECT page_id, {_URL} AS url FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages)")
def url_canonical_generic(spark, d):
    return read(spark, d, "pages").select("page_id", U.canonical("url").alias("url"))


@query(f"SELECT page_id, {_URL} AS url FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages)")
def url_canonical_plain(spark, d):
    return read(spark, d, "pages").select("page_id", U.canonical_plain("url").alias("url"))


@query("SELECT page_id, 'https://x.kau.ac.kr/kaulife/a.php?code=s' || (page_id % 7) || '&mode=read&seq=' || page_id AS url FROM pages")
def url_host_rules(spark, d):
    rows = read(spark, d, "pages").select("page_id", F.format_string("https://x.kau.ac.kr/kaulife/a.php?page=%d&seq=%d&code=s%d&mode=read#top", F.col("page_id") % 3, F.col("page_id"), F.col("page_id") % 7).alias("u"))
    return rows.select("page_id", U.canonical("u").alias("url"))


@query(r"SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query FROM pages")
def url_parts(spark, d):
    rows = read(spark, d, "pages")
    part = lambda p: F.coalesce(F.try_parse_url("url", F.lit(p)), F.lit(""))
    return rows.select("page_id", part("HOST").alias("host"), U.path_of("url").alias("path"), part("QUERY").alias("query"))


@query(r"SELECT page_id, replace(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), '&amp;', '&') AS title FROM pages")
def html_title(spark, d):
    return parsers.titles(read(spark, d, "pages"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def html_strip(spark, d):
    return read(spark, d, "pages").select("page_id", T.strip_html("html").alias("text"))


@query()
def html_links(spark, d):
    return parsers.links(read(spark, d, "pages"))


@query()
def html_images(spark, d):
    return parsers.parsed_assets(read(spark, d, "pages"))


@query()
def html_to_markdown(spark, d):
    return read(spark, d, "pages").select("page_id", markdown.normalized_content("html").alias("markdown"))


@query()
def markdown_normalized(spark, d):
    return read(spark, d, "documents").select("doc_id", markdown.normalized_content("text").alias("markdown"))


@query()
def board_pages(spark, d):
    """List pages read as an official board's: none of the corpus's pages is one, so links that fit its detail pages are taken."""
    return parsers.parsed_lists(read(spark, d, "pages"), parsers.BOARDS["official"])


@query(f"WITH {SQL} SELECT id, coalesce(nullif(left(regexp_replace(regexp_replace(lower(title), '[^a-z0-9가-힣]+', '-', 'g'), '^-+|-+$', '', 'g'), 48), ''), 'notice') AS slug FROM notice")
def slug(spark, d):
    return plain(spark, d).select("id", T.slug("title").alias("slug"))


@query(r"SELECT doc_id, length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), 'https?://\S+', ' ', 'g'), '\s+', '', 'g')) AS n FROM documents")
def visible_len(spark, d):
    return read(spark, d, "documents").select("doc_id", T.visible_length("text").cast("long").alias("n"))


@query("SELECT o_orderkey, CASE WHEN lower(trim(x)) IN ('', '-', 'null', 'n/a', 'undefined') THEN NULL ELSE trim(x) END AS value FROM (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN ' N/A ' WHEN 1 THEN '-' WHEN 2 THEN 'Null' WHEN 3 THEN '  ' WHEN 4 THEN 'undefined' ELSE ' ' || o_orderpriority || ' ' END AS x FROM orders)")
def facet_value_null(spark, d):
    k = F.col("o_orderkey") % 6
    x = F.when(k == 0, " N/A ").when(k == 1, "-").when(k == 2, "Null").when(k == 3, "  ").when(k == 4, "undefined").otherwise(F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")))
    return read(spark, d, "orders").select("o_orderkey", T.facet_value(x).alias("value"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def date_normalise(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    x = F.when(F.col("o_orderkey") % 3 == 0, F.concat(day, F.lit("T23:30:00+09:00"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("posted "), day)).otherwise(F.lit("yesterday"))
    return read(spark, d, "orders").select("o_orderkey", D.normalize_date(x).alias("day"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def date_parse_flexible(spark, d):
    k = F.col("o_orderkey") % 4
    x = F.when(k == 0, F.date_format("o_orderdate", "yyyy.M.d")).when(k == 1, F.date_format("o_orderdate", "yyyy/MM/dd HH:mm")).when(k == 2, F.date_format("o_orderdate", "yyyy-M-dd")).otherwise(F.lit("2026-02-30"))
    return read(spark, d, "orders").select("o_orderkey", D.parse_date(x).cast("string").alias("day"))


@query("SELECT doc_id, CASE WHEN length(text) > 120 THEN left(text, 120) || '...' ELSE text END AS preview FROM documents")
def truncate_preview(spark, d):
    return read(spark, d, "documents").select("doc_id", T.truncate("text", 120).alias("preview"))


@query("SELECT p_partkey, left(regexp_replace(p_name, '\\s+', '', 'g'), 0) || CAST(coalesce(TRY_CAST(CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE CAST(p_size AS VARCHAR) END AS INTEGER), 20) AS VARCHAR) AS n FROM part")
def number_default(spark, d):
    rows = read(spark, d, "part").withColumn("v", F.when(F.col("p_partkey") % 2 == 0, F.lit("x")).otherwise(F.col("p_size").cast("string")))
    return rows.select("p_partkey", T.number_or("v", 20).cast("string").alias("n"))


# RE2 has no look-behind; the corpus holds no backslashes before brackets and no links, so the codes below are the ones it can show.
_AUDIT = r"""l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
l1 AS (SELECT *, regexp_replace(text, '`[^`\n]*`', '', 'g') AS bare, CAST(starts_with(ltrim(text), '```') OR starts_with(ltrim(text), '~~~') AS INTEGER) AS mark FROM l0),
l AS (SELECT *, (sum(mark) OVER (PARTITION BY doc_id ORDER BY line) - mark) % 2 + mark > 0 AS fenced FROM l1),
entity AS (SELECT doc_id, 'html_entity' AS code, 'P2' AS severity, min(line) AS line FROM l WHERE NOT fenced AND regexp_matches(bare, '(?i)&(?:nbsp|amp|lt|gt|quot|apos|#[0-9]+|#x[0-9a-f]+);') GROUP BY ALL),
html AS (SELECT doc_id, 'raw_html' AS code, 'P1' AS severity, min(line) AS line FROM l WHERE regexp_matches(text, '(?i)</?(?:p|div|section|article|table|thead|tbody|tr|td|th|ul|ol|li|h[1-6]|img|a|br|span|strong|em|b|i)\b') GROUP BY ALL),
strong AS (SELECT doc_id, 'unbalanced_strong' AS code, 'P1' AS severity, min(line) FILTER (contains(text, '**')) AS line FROM (SELECT *, sum((length(bare) - length(replace(bare, '**', ''))) / 2) OVER (PARTITION BY doc_id) AS k FROM l) WHERE CAST(k AS BIGINT) % 2 = 1 GROUP BY ALL),
blank AS (SELECT doc_id, 'repeated_blank_lines' AS code, 'P2' AS severity, min(line) FILTER (b AND b1 AND b2) AS line FROM (SELECT l.*, trim(l.text) = '' AS b, coalesce(lag(trim(l.text) = '') OVER w, FALSE) AS b1, coalesce(lag(trim(l.text) = '', 2) OVER w, FALSE) AS b2, contains(d.text, chr(10) || chr(10) || chr(10)) AS triple FROM l JOIN documents d USING (doc_id) WINDOW w AS (PARTITION BY l.doc_id ORDER BY l.line)) WHERE triple GROUP BY ALL),
none_ AS (SELECT doc_id, 'empty_content' AS code, 'P0' AS severity, CAST(NULL AS BIGINT) AS line FROM documents WHERE trim(text, chr(10) || chr(9) || chr(13) || ' ') = ''),
issue AS (SELECT * FROM entity UNION ALL SELECT * FROM html UNION ALL SELECT * FROM strong UNION ALL SELECT * FROM blank UNION ALL SELECT * FROM none_)"""
_CODES = ("html_entity", "raw_html", "unbalanced_strong", "repeated_blank_lines", "empty_content")


def _issues(spark, d):
    return audit.audit(read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content")))


@query(f"WITH {_AUDIT} SELECT CAST(doc_id AS VARCHAR) AS id, severity, code, line FROM issue")
def audit_codes(spark, d):
    """The codes that RE2 can find; audit_all has every code."""
    return _issues(spark, d).where(F.col("code").isin(*_CODES)).select("id", "severity", "code", F.col("line").cast("long").alias("line"))


@query(f"WITH {_AUDIT} SELECT severity, code, count(*) AS n FROM issue GROUP BY ALL")
def audit_summary(spark, d):
    return audit.summary(_issues(spark, d).where(F.col("code").isin(*_CODES)))


@query(f"WITH {_AUDIT}, k AS (SELECT *, row_number() OVER (PARTITION BY severity, code ORDER BY CAST(doc_id AS VARCHAR), line) AS k FROM issue) SELECT severity, code, k, CAST(doc_id AS VARCHAR) AS id FROM k WHERE k <= 3")
def audit_examples(spark, d):
    return audit.examples(_issues(spark, d).where(F.col("code").isin(*_CODES)), 3).select("severity", "code", F.col("k").cast("long").alias("k"), "id")


@query(f"WITH {_AUDIT} SELECT count(*) AS total, count(*) FILTER (severity <= 'P1') AS failing, count(*) FILTER (severity <= 'P1') > 0 AS failed FROM issue")
def audit_gate(spark, d):
    return audit.fails(_issues(spark, d).where(F.col("code").isin(*_CODES)), "P1")


@query()
def audit_all(spark, d):
    return _issues(spark, d)


@query()
def audit_summary_all(spark, d):
    """Over every code; the queries above keep those that SQL can repeat."""
    return audit.summary(_issues(spark, d))


@query()
def audit_examples_all(spark, d):
    return audit.examples(_issues(spark, d), 3)


@query()
def audit_gate_all(spark, d):
    return audit.fails(_issues(spark, d), "P1")


def _eval(spark, d):
    """Each benchmark passage's longer words as a question over all documents; a document that holds the whole passage answers it.  Words are matched by an
    equal join, so no pair of a question and a document without a common word arises, and texts join only what was found."""
    cases = read(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), F.array("text").alias("must"), F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) >= 6)).alias("words"))
    asked = cases.select("case_id", F.explode("words").alias("word"))
    docs = plain(spark, d)
    words = docs.select("id", "published_at", F.explode(F.array_distinct(F.split(F.lower("content"), "[^a-z]+"))).alias("word")).where(F.length("word") >= 6)
    met = words.join(asked, "word").groupBy("case_id", "id", "published_at").agg(F.count("*").alias("n"))
    top = evaluate.top_titles(met.withColumn("title", F.col("id")), [F.desc("n"), F.desc("published_at"), F.asc("id")], 10).withColumnRenamed("title", "id")
    return cases, top.join(docs.select("id", F.col("content").alias("title")), "id").select("case_id", "rank", "title")


_EVAL = rf"""WITH {SQL}, cases AS (SELECT item_id AS case_id, text AS must, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: length(w) >= 6)) AS words FROM benchmark),
asked AS (SELECT case_id, unnest(words) AS word FROM cases), docs AS (SELECT id, published_at, unnest(list_distinct(regexp_split_to_array(lower(content), '[^a-z]+'))) AS word FROM notice),
met AS (SELECT case_id, id, published_at, count(*) AS n FROM docs JOIN asked USING (word) GROUP BY ALL),
ranks AS (SELECT case_id, id, row_number() OVER (PARTITION BY case_id ORDER BY n DESC, published_at DESC, id) AS rank FROM met QUALIFY rank <= 10), top AS (SELECT case_id, rank, content AS title FROM ranks JOIN notice USING (id)),
hit AS (SELECT case_id, trim(must) AS must, min(CASE WHEN contains(title, trim(must)) THEN rank END) AS rank FROM cases LEFT JOIN top USING (case_id) GROUP BY ALL),
res AS (SELECT case_id, CAST(coalesce(rank <= 5, FALSE) AS DOUBLE) AS recall_at_5, CAST(coalesce(rank <= 10, FALSE) AS DOUBLE) AS recall_at_10, coalesce(1.0 / rank, 0.0) AS rr, rank FROM hit)"""


@query(f"{_EVAL} SELECT case_id, recall_at_5, recall_at_10, CAST(rank AS INTEGER) AS first_hit_rank FROM res")
def recall_at_k(spark, d):
    return evaluate.scored(*_eval(spark, d)).select("case_id", "recall_at_5", "recall_at_10", F.col("first_hit_rank").cast("int").alias("first_hit_rank"))


@query(f"{_EVAL} SELECT round(avg(recall_at_5), 9) AS recall_at_5, round(avg(recall_at_10), 9) AS recall_at_10, round(avg(rr), 9) AS mrr, count(*) AS n FROM res")
def mrr(spark, d):
    out = evaluate.means(evaluate.scored(*_eval(spark, d)))
    return out.select(F.round("recall_at_5", 9).alias("recall_at_5"), F.round("recall_at_10", 9).alias("recall_at_10"), F.round("mrr", 9).alias("mrr"), "n")


@query(f"{_EVAL} SELECT case_id, must, CAST(rank AS INTEGER) AS rank FROM hit")
def theta_title_match(spark, d):
    return evaluate.hits(*_eval(spark, d)).select("case_id", "must", F.col("rank").cast("int").alias("rank"))


@query("SELECT event_type, round(avg(value) FILTER (event_id % 5 <> 0), 6) AS mean FROM events GROUP BY event_type")
def nan_mean(spark, d):
    x = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return read(spark, d, "events").groupBy("event_type").agg(F.round(evaluate.mean_of_numbers(x), 6).alias("mean"))


@query("SELECT conv_id, turn, role, text FROM conversations")
def session_messages(spark, d):
    return read(spark, d, "conversations").orderBy("conv_id", "turn")


@query("SELECT conv_id, turn, CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 4")
def history_trim(spark, d):
    return trimmed_sessions(read(spark, d, "conversations"), "conv_id", "turn", "text", 4, 500).select("conv_id", "turn", "text")


@query("SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'user') AS asked FROM conversations GROUP BY conv_id")
def session_turn_counts(spark, d):
    return read(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "user").alias("asked"))


@query("SELECT user_id, strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n, count(*) - 1 AS over FROM events GROUP BY ALL HAVING count(*) > 1")
def rate_window_violations(spark, d):
    out = crawl.violations(read(spark, d, "events"), "user_id", 1, "ts", "1 hour")
    return out.select(F.col("key").alias("user_id"), F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n", "over")


def _board_items(spark, d):
    """Pages as list items: boards by host, list pages of 20, dates and permanent flags from the number."""
    p = read(spark, d, "pages")
    host = F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit(""))
    return p.select(
        host.alias("board"), F.floor(F.col("page_id") / 20).alias("page"), (F.col("page_id") % 20).alias("pos"), U.canonical_plain("url").alias("url"), (F.col("page_id") % 17 == 0).alias("is_permanent_notice"),
        F.date_sub(F.lit(TODAY).cast("date"), (F.col("page_id") * 7 % 500).cast("int")).cast("string").alias("published_at"),
    )


_ITEMS = f"""items AS (SELECT regexp_extract(url, '^https?://([^/?#:]+)', 1) AS board, page_id // 20 AS page, page_id % 20 AS pos, u AS raw, {_URL} AS url, page_id % 17 = 0 AS permanent, page_id
FROM (SELECT *, regexp_replace(url, '#.*$', '') AS u FROM pages))"""


@query(f"WITH {_ITEMS}, p AS (SELECT board, page, string_agg(url, chr(10) ORDER BY pos, url) AS s FROM items GROUP BY ALL), r AS (SELECT board, page, row_number() OVER (PARTITION BY board, s ORDER BY page) > 1 AS repeated FROM p) SELECT * FROM r")
def page_signature_repeat(spark, d):
    return crawl.signatures(_board_items(spark, d)).select("board", "page", "repeated")


@query(f"WITH {_ITEMS}, s AS (SELECT *, coalesce(max(CAST(page_id % 11 = 10 AS INTEGER)) OVER (PARTITION BY board ORDER BY page, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM items) SELECT board, page, pos, url FROM s WHERE stopped = 0")
def crawl_prefix_stop(spark, d):
    items = _board_items(spark, d).withColumn("_n", F.col("page") * 20 + F.col("pos"))
    return crawl.before_stop(items, F.col("_n") % 11 == 10).select("board", "page", "pos", "url")


@query()
def crawl_stop_replay(spark, d):
    items = _board_items(spark, d)
    return crawl.replay(items, items.where("pos % 5 = 1").select("url", "published_at"), TODAY)


@query()
def crawl_stop_sequence(spark, d):
    items = _board_items(spark, d)
    return crawl.replay_in_order(items, items.where("pos % 5 = 1").select("url", "published_at"), TODAY)


@query("SELECT page_id, NOT old AS include, old AS stop FROM (SELECT page_id, page_id % 17 <> 0 AND page_id * 7 % 500 >= 365 AS old FROM pages)")
def recent_policy(spark, d):
    items = _board_items(spark, d).withColumn("page_id", F.col("page") * 20 + F.col("pos"))
    return items.select("page_id", crawl.recent_policy("published_at", "is_permanent_notice", TODAY).alias("p")).select("page_id", "p.include", "p.stop")


_POOL = f"""pool AS (SELECT *, row_number() OVER (ORDER BY score DESC, published_at DESC, title, id) AS pos FROM (SELECT *, {score_sql([["license"], ["version"]])} AS score FROM notice
WHERE contains(st, 'license version') OR contains(st, 'license') OR contains(st, 'version') OR contains(sc, 'license') OR contains(sc, 'version') ORDER BY published_at DESC, title, id LIMIT 500) QUALIFY pos <= 15)"""
_FLAT = r"trim(regexp_replace(content, '\s+', ' ', 'g'))"


def _cut(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) > {n} THEN left({x}, {n}) || '...' ELSE {x} END"


def _pool(spark, d):
    best = search.relevant(notices(spark, d), "license version", 15, TODAY)
    return rag.positions(best, F.desc("score"), F.desc("published_at"), F.asc("title"), F.asc("id"))


@query(f"""WITH {SQL}, {_POOL} SELECT string_agg('공지 ' || pos || chr(10) || 'id: ' || id || chr(10) || 'title: ' || title || chr(10) || 'date: ' || published_at || chr(10) || 'audience: ' || audience || chr(10) || 'source_group: ' || coalesce(groups[1], '중분류 없음') || chr(10) || 'sources: ' || source || chr(10) || 'category: ' || category || chr(10) || 'url: 링크 없음' || chr(10) || 'content: ' || {_cut("content", 1400)}, chr(10) || chr(10) ORDER BY pos) AS text FROM pool WHERE pos <= 6""")
def rag_context(spark, d):
    return rag.context(_pool(spark, d).where("pos <= 6"))


@query(f"""WITH {SQL}, {_POOL}, b AS (SELECT string_agg(pos || '. ' || title || chr(10) || published_at || ' | ' || source || chr(10) || {_cut(_FLAT, 120)}, chr(10) ORDER BY pos) AS t FROM pool WHERE pos <= 3)
SELECT '질문: license version' || chr(10) || chr(10) || '{rag.FALLBACK_HEAD}' || chr(10) || chr(10) || t || chr(10) || chr(10) || '{rag.FALLBACK_TAIL}' AS text FROM b""")
def rag_fallback_answer(spark, d):
    return rag.fallback_answer("license version", _pool(spark, d))


@query(f"""WITH {SQL}, {_POOL} SELECT string_agg('id=' || id || ' | 제목: ' || title || ' | 게시일: ' || published_at || chr(10) || '  발췌: ' || {_cut(_FLAT, 700)}, chr(10) ORDER BY pos) AS text FROM pool""")
def rag_rerank_list(spark, d):
    return rag.rerank_list(_pool(spark, d))


@query(f"WITH {SQL}, {_POOL}, ids AS (SELECT id, 16 - pos AS k FROM pool WHERE pos % 2 = 1) SELECT id, CAST(k AS INTEGER) AS pos FROM (SELECT id, row_number() OVER (ORDER BY k) AS k FROM ids) WHERE k <= 6")
def rerank_order(spark, d):
    """A reply that names every second candidate, last first, beside an unknown id."""
    pool = _pool(spark, d)
    ids = [r["id"] for r in pool.where("pos % 2 = 1").orderBy(F.desc("pos")).select("id").collect()]
    return rag.chosen(["unknown", *ids], pool).select("id", "pos")


@query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'image_attachment' WHEN 1 THEN 'hwp_attachment' WHEN 2 THEN 'image_attachment' WHEN 3 THEN NULL ELSE 'hwp_attachment' END AS type FROM pages")
def asset_type(spark, d):
    k = F.col("page_id") % 5
    name = F.when(k == 0, "poster.PNG").when(k == 1, "form.hwp").otherwise(F.lit("file"))
    url = F.when(k == 2, "https://f.test/a%20b.jpeg?x=1").when(k == 4, "https://f.test/form.hwpx#p").otherwise(F.lit("https://f.test/view.do?name=a.zip"))
    return read(spark, d, "pages").select("page_id", A.attachment_type(name, url).alias("type"))


def _asset_posts(spark, d):
    p = read(spark, d, "pages").withColumn("k", F.col("page_id") % 6)
    item = lambda kind, name, url: F.struct(F.lit(kind).alias("type"), F.lit(name).alias("name"), F.concat(F.lit(url), F.col("page_id").cast("string"), F.lit(name)).alias("url"), F.lit("").alias("source"))
    none = F.array().cast("array<struct<type:string,name:string,url:string,source:string>>")
    images = F.when(F.col("k").isin(0, 1, 2), F.array(item("inline_image", "a.png", "https://f.test/"))).otherwise(none)
    files = F.when(F.col("k").isin(1, 3), F.array(item("", "b.hwp", "https://f.test/"))).when(F.col("k") == 4, F.array(item("", "c.jpg", "https://f.test/"), item("", "d.hwpx", "https://f.test/"))).otherwise(none)
    content = F.when(F.col("k") == 2, "[이미지 본문] x").when(F.col("k") == 5, F.lit("")).when(F.col("k") == 4, F.lit("https://f.test/a ")).otherwise(T.strip_html("html"))
    return p.select(F.col("page_id").alias("_ord"), F.lit("t").alias("title"), content.alias("content"), images.alias("content_assets"), F.transform(files, lambda a: F.struct(a["name"].alias("name"), a["url"].alias("url"))).alias("attachments"))


@query("SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'inline_image' WHEN 1 THEN 'inline_image_and_hwp_attachment' WHEN 2 THEN 'image_only_body' WHEN 3 THEN 'hwp_attachment_only' WHEN 4 THEN 'mixed_attachments' ELSE 'unknown' END AS trigger FROM pages")
def enrich_trigger(spark, d):
    return _asset_posts(spark, d).select(F.col("_ord").alias("page_id"), enrich.trigger().alias("trigger"))


@query(r"""WITH p AS (SELECT page_id, page_id % 6 AS k, CASE page_id % 6 WHEN 2 THEN '[이미지 본문] x' WHEN 5 THEN '' WHEN 4 THEN 'https://f.test/a ' ELSE trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) END AS content FROM pages),
w AS (SELECT page_id, CASE WHEN k <> 5 AND (k = 2 OR content = '' OR length(regexp_replace(regexp_replace(content, 'https?://\S+', ' ', 'g'), '\s+', '', 'g')) < 30) THEN CASE k WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 2 END ELSE 0 END AS calls FROM p),
r AS (SELECT page_id, CAST(calls AS BIGINT) AS calls, CAST(sum(calls) OVER (ORDER BY page_id) - calls AS BIGINT) AS calls_before FROM w) SELECT *, calls > 0 AND calls_before < 50 AS within_budget FROM r""")
def enrich_budget(spark, d):
    return enrich.planned_calls(_asset_posts(spark, d)).select(F.col("_ord").alias("page_id"), "calls", "calls_before", "within_budget")


@query()
def enrich_run(spark, d):
    """The exact sequential run, with stand-ins for reader and writer."""
    return enrich.enrich(_asset_posts(spark, d), lambda a: f"text of {a['name']}", lambda post, texts: " ".join(texts * 5))


@query()
def normalize_raw(spark, d):
    """Documents written as raw objects of mixed shapes, normalised again."""
    k = F.col("doc_id") % 3
    raw = F.when(k == 0, F.to_json(F.struct(F.col("text").alias("content"), F.array("source", "lang").alias("source_name"), F.lit("2024-05-01T10:00:00+09:00").alias("published_at")))).when(k == 1, F.to_json(F.struct(F.left("text", F.lit(40)).alias("subject"), F.col("text").alias("body"), F.col("source").alias("board"), F.lit("20240501").alias("date")))).otherwise(F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.lit(" ").alias("title"), F.array(F.lit("https://f.test/a.pdf")).alias("attachments"))))
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("_ord"), raw.alias("raw"))
    return normalized(rows, render=False).select("_ord", "id", "title", "source", "published_at", F.array_join("tags", "|").alias("tags"), F.size("attachments").alias("files"))


@query("SELECT doc_id, CASE WHEN trim(text, chr(10) || chr(9) || chr(13) || ' ') = '' THEN 'required_field_empty:content' END AS reason FROM documents")
def required_fields(spark, d):
    from boardlark.operators.normalize import required_failure

    return read(spark, d, "documents").select("doc_id", required_failure(F.lit("t"), "text").alias("reason"))


