"""Registered queries of URL, text and HTML functions, scores, plug-ins and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as aw
from ..functions import classifiers as cl
from ..functions import html as H
from ..functions import scores as sc
from ..functions import states as st
from ..functions import text as tx
from ..functions import urls as u
from ..streaming import leases as ls
from . import adapters as ad

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, fn, sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql:
        SQL[name] = sql


P = lambda s, d: ad.read(s, d, "pages")
D = lambda s, d: ad.read(s, d, "documents")

_HOST = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1))"
_BARE = f"regexp_replace({_HOST}, '^www\\.', '')"
_PATH = "regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)"
_QUERY = "regexp_extract(url, '\\?([^#]*)', 1)"
_FRAG = "regexp_extract(url, '#(.*)$', 1)"
_TRACK = "[" + ", ".join(f"'{t}'" for t in u.TRACKING) + "]"
add("F01_normalised_url", lambda s, d: P(s, d).select("page_id", u.normalised(F.col("url")).alias("url")), f"""
WITH p AS (SELECT page_id, {_BARE} AS h, {_PATH} AS p, {_FRAG} AS f, list_filter(string_split({_QUERY}, '&'), lambda x: x <> '' AND NOT list_contains({_TRACK}, lower(string_split(x, '=')[1]))) AS q FROM pages)
SELECT page_id, 'https://' || h || CASE WHEN p <> '/' THEN regexp_replace(p, '/$', '') ELSE p END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END || CASE WHEN f <> '' THEN '#' || f ELSE '' END AS url FROM p""")
_MAIN = f"lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1) || '/'"
for _n, _c in (("F02_main_domain", lambda: u.main_domain(F.col("url"))), ("F03_result_main", lambda: u.result_main(F.col("url")))):
    add(_n, lambda s, d, c=_c: P(s, d).select("page_id", c().alias("main")), f"SELECT page_id, {_MAIN} AS main FROM pages")
add("P05_filter_host", lambda s, d: P(s, d).select("page_id", u.filter_host(F.regexp_replace("url", "^https?://", "")).alias("host")), f"SELECT page_id, {_BARE} AS host FROM pages")
add("F05_wildcards", lambda s, d: P(s, d).select("page_id", *[tx.matches_wildcard(F.col("html"), w).alias(f"m{i}") for i, w in enumerate(("*<article>*", "<!doctype*", "*track(?)*", "*100%_*"))]), "SELECT page_id, lower(html) LIKE '%<article>%' AS m0, lower(html) LIKE '<!doctype%' AS m1, lower(html) LIKE '%track(_)%' AS m2, lower(html) LIKE '%100\\%\\_%' ESCAPE '\\' AS m3 FROM pages")
add("F06_valid_urls", lambda s, d: P(s, d).select("page_id", u.is_valid(F.col("url")).alias("valid"), u.is_valid(F.concat(F.lit("//"), F.col("url"))).alias("odd")), "SELECT page_id, true AS valid, false AS odd FROM pages")
add("F07_scheme_and_host", lambda s, d: P(s, d).select("page_id", u.scheme(F.col("url")).alias("scheme"), u.host(F.col("url")).alias("host")), f"SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS scheme, {_HOST} AS host FROM pages")
add("F08_url_length", lambda s, d: P(s, d).select("page_id", u.url_length(F.col("url")).alias("length")), "SELECT page_id, CAST(length(regexp_replace(replace(url, 'www.', ''), '^[a-zA-Z]+://', '')) AS VARCHAR) AS length FROM pages")
add("F09_https", lambda s, d: P(s, d).select("page_id", u.is_https(F.col("url")).alias("https")), "SELECT page_id, lower(url) LIKE 'https://%' AS https FROM pages")
add("F10_terms_in_url", lambda s, d: P(s, d).select("page_id", tx.terms_in(tx.terms(F.lit("en example com page")), F.col("url")).alias("n")), "SELECT page_id, CAST(contains(lower(url), 'en') AS INT) + CAST(contains(lower(url), 'example') AS INT) + CAST(contains(lower(url), 'com') AS INT) + CAST(contains(lower(url), 'page') AS INT) AS n FROM pages")
add("F11_terms_at_delimiters", lambda s, d: P(s, d).select("page_id", u.terms_at_delimiters(tx.terms(F.lit("en m page")), F.col("url")).alias("n")), "WITH p AS (SELECT page_id, regexp_split_to_array(lower(url), '[^\\p{L}\\p{N}]+') AS a FROM pages) SELECT page_id, CAST(list_contains(a, 'en') AS INT) + CAST(list_contains(a, 'm') AS INT) + CAST(list_contains(a, 'page') AS INT) AS n FROM p")
add("F12_stop_words", lambda s, d: D(s, d).select("doc_id", F.size(tx.without_stop_words(tx.terms(F.col("text")), ["the", "of", "and"])).alias("n")), "WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS a FROM documents), k AS (SELECT doc_id, a, list_filter(a, lambda x: x NOT IN ('the', 'of', 'and')) AS b FROM w) SELECT doc_id, CAST(CASE WHEN len(b) > 0 THEN len(b) ELSE len(a) END AS INT) AS n FROM k")
_WORDS = "list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')"
add("F13_wildcard_density", lambda s, d: D(s, d).select("doc_id", tx.wildcard_density(F.col("text"), F.lit("tion")).alias("density")), f"WITH w AS (SELECT doc_id, {_WORDS} AS a FROM documents) SELECT doc_id, CASE WHEN len(a) > 0 THEN floor(100.0 * len(list_filter(a, lambda x: contains(x, 'tion'))) / len(a)) ELSE 0.0 END AS density FROM w")
add("F14_phrase_density", lambda s, d: D(s, d).select("doc_id", tx.phrase_density(F.col("text"), F.lit("of the")).alias("density")), f"WITH w AS (SELECT doc_id, len({_WORDS}) AS n, (length(lower(text)) - length(replace(lower(text), 'of the', ''))) / 6 AS k FROM documents) SELECT doc_id, CASE WHEN n > 0 THEN floor(k * 2 / n * 10000) / 100 ELSE 0.0 END AS density FROM w")
add("F15_term_density", lambda s, d: D(s, d).select("doc_id", F.array_max(F.transform(F.array(F.lit("the"), F.lit("de")), lambda t: F.size(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), lambda w: w == t)))).alias("n")), "WITH w AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+') AS a FROM documents) SELECT doc_id, CAST(greatest(len(list_filter(a, lambda x: x = 'the')), len(list_filter(a, lambda x: x = 'de'))) AS INT) AS n FROM w")
add("F16_clean_text", lambda s, d: ad.read(s, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.sha2(tx.answer_as_text(F.col("text")), 256).alias("sha")), "SELECT conv_id, turn, sha256(trim(regexp_replace(replace(text, '*', ''), '\\n+', '. ', 'g'))) AS sha FROM conversations WHERE role = 'assistant'")
add("F17_percentages", lambda s, d: P(s, d).select("page_id", tx.distinct_percentages(F.col("html")).alias("n")), "SELECT page_id, CAST(len(list_distinct(regexp_extract_all(html, '\\d+(?:[.,]\\d+)?\\s*%'))) AS INT) AS n FROM pages")
add("F18_years", lambda s, d: P(s, d).select("page_id", tx.distinct_years(F.col("html")).alias("n")), "SELECT page_id, CAST(len(list_distinct(regexp_extract_all(html, '\\b(19[5-9]\\d|20[0-3]\\d)\\b', 1))) AS INT) AS n FROM pages")
add("F19_quotation_marks", lambda s, d: P(s, d).select("page_id", tx.quotation_marks(F.col("html")).alias("n")), "SELECT page_id, CAST(len(regexp_extract_all(html, '[\"“”„«»]')) AS INT) AS n FROM pages")
add("F20_chunks", lambda s, d: D(s, d).select("doc_id", F.posexplode(tx.chunks(F.col("text"))).alias("chunk", "t")).select("doc_id", "chunk", F.length("t").alias("n_chars")), "WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS a FROM documents), c AS (SELECT doc_id, a, unnest(range(0, (len(a) + 149) // 150)) AS chunk FROM w WHERE len(a) > 0) SELECT doc_id, CAST(chunk AS INT) AS chunk, CAST(length(array_to_string(a[chunk * 150 + 1 : chunk * 150 + 150], ' ')) AS INT) AS n_chars FROM c")


def _similar(s, d):
    e = ad.read(s, d, "embeddings")
    q = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q"))  # one vector for each label
    return e.join(q, "label").select("vec_id", F.round(tx.cosine_percent(F.col("embedding"), F.col("q")), 1).alias("percent")).groupBy("percent").agg(F.count(F.lit(1)).alias("n")).where("percent = 100").select("n")


add("F21_similarity", _similar, "SELECT count(*) AS n FROM (SELECT DISTINCT label FROM embeddings WHERE label IS NOT NULL)")
add("F22_percentage_text", lambda s, d: ad.read(s, d, "part").select("p_partkey", st.percentage_text(F.col("p_size"), F.col("p_partkey") % 60).alias("text")), "SELECT p_partkey, CASE WHEN p_partkey % 60 > 0 THEN CAST(CAST(round_even(100.0 * p_size / (p_partkey % 60), 0) AS BIGINT) AS VARCHAR) || ' %' ELSE '-' END AS text FROM part")
add("F23_truncated", lambda s, d: D(s, d).select("doc_id", F.length(tx.truncated(F.col("text"), 500, 450)).alias("n")), "SELECT doc_id, CASE WHEN length(text) > 500 THEN 494 ELSE length(text) END AS n FROM documents")
add("F24_salvaged_json", lambda s, d: ad.indicator(s, d).select("id", F.get_json_object(tx.salvaged_json(F.when(F.col("id") % 3 == 0, F.concat(F.lit("```json\n"), F.col("value"), F.lit("\n```"))).when(F.col("id") % 3 == 1, F.concat(F.lit("Answer: "), F.col("value"), F.lit(" end"))).otherwise("none")), "$.k").alias("k")), ad.with_views("indicator", "SELECT id, CASE WHEN id % 3 < 2 THEN json_extract_string(value, '$.k') END AS k FROM indicator"))
QUERIES["F29_llm_answer"], SQL["F29_llm_answer"] = QUERIES["F24_salvaged_json"], SQL["F24_salvaged_json"]
add("F27_prompt_keys", lambda s, d: ad.study(s, d).select("id", F.array_join(tx.prompt_keys(F.concat(F.lit("Return {\"score\": 1, 'reason' : \"x\", \"k"), F.col("id").cast("string"), F.lit("\": 0} not {\"z\": 1}"))), ",").alias("keys")), ad.with_views("study", "SELECT id, 'score,reason,k' || id AS keys FROM study"))
add("F30_redirects", lambda s, d: P(s, d).select("page_id", u.decoded_redirect(F.concat(F.lit("https://e.example/ck?x=1&u=a1"), F.regexp_replace(F.translate(F.base64(F.col("url").cast("binary")), "+/", "-_"), "[=\r\n]", ""), F.lit("&y=2"))).alias("url")), "SELECT page_id, url FROM pages")
add("F31_sources", lambda s, d: P(s, d).select("page_id", u.is_source(F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise("https://www.google.com/x")).alias("ok")), "SELECT page_id, page_id % 2 = 0 AS ok FROM pages")
add("F32_clean_key", lambda s, d: P(s, d).select("page_id", u.clean_key(F.col("url")).alias("key")), f"SELECT page_id, {_BARE} || regexp_replace({_PATH}, '/$', '') AS key FROM pages")
add("F35_unwrapped_ads", lambda s, d: P(s, d).select("page_id", u.unwrapped_ad(F.concat(F.lit("https://ad.example/aclk?a=1&adurl="), F.url_encode("url"))).alias("url")), "SELECT page_id, url FROM pages")
add("F36_image_targets", lambda s, d: P(s, d).select("page_id", u.image_target(F.concat(F.lit("https://i.example/?imgurl="), F.url_encode("url"), F.lit("&imgrefurl=x"))).alias("url")), "SELECT page_id, url FROM pages")
add("F37_best_title", lambda s, d: P(s, d).groupBy(u.bare_host(F.col("url")).alias("host")).agg(F.max(F.struct((~F.contains("url", F.lit("?"))).alias("plain"), F.length("url").alias("n"), F.col("url").alias("u"))).alias("m")).select("host", F.col("m.u").alias("title")), f"SELECT host, url AS title FROM (SELECT {_BARE} AS host, url, row_number() OVER (PARTITION BY {_BARE} ORDER BY NOT contains(url, '?') DESC, length(url) DESC, url DESC) AS rn FROM pages) WHERE rn = 1")
add("F38_post_filters", lambda s, d: P(s, d).where(~F.col("url").rlike("/shorts/|#top$")).select("page_id"), "SELECT page_id FROM pages WHERE NOT regexp_matches(url, '/shorts/|#top$')")
add("F39_search_urls", lambda s, d: ad.query(s, d).select("id", u.search_url("https://e.example/search", F.col("query"), F.lit("DE"), F.lit("de"), F.col("id") % 3 + 1).alias("url")), ad.with_views("query", "SELECT id, 'https://e.example/search?q=' || replace(query, ' ', '+') || '&gl=de&hl=de&start=' || CAST((id % 3) * 10 AS VARCHAR) AS url FROM query"))
add("F40_back_off", lambda s, d: ad.answer(s, d).select("id", st.backoff_minutes(F.col("status")).alias("wait")), ad.with_views("answer", "SELECT id, CASE status WHEN 0 THEN 5 WHEN 1 THEN 15 ELSE 30 END AS wait FROM answer"))
add("F41_age_in_hours", lambda s, d: ad.answer(s, d).select("id", tx.hours_between(F.col("created_at"), F.to_timestamp(F.lit("2030-01-01 00:00:00"))).alias("hours")), ad.with_views("answer", "SELECT id, date_sub('second', created_at, TIMESTAMP '2030-01-01') / 3600.0 AS hours FROM answer"))
add("F42_cut_offs", lambda s, d: ad.result(s, d).where(F.col("created_at") < F.to_timestamp(F.lit("1997-01-01 00:00:00")) - F.expr("interval 30 minutes")).agg(F.count(F.lit(1)).alias("n")), ad.with_views("result", "SELECT count(*) AS n FROM result WHERE created_at < TIMESTAMP '1997-01-01' - INTERVAL 30 MINUTE"))
add("F43_dates", lambda s, d: ad.answer(s, d).select("id", F.date_format("created_at", "dd.MM.yyyy HH:mm").alias("t")), ad.with_views("answer", "SELECT id, strftime(created_at, '%d.%m.%Y %H:%M') AS t FROM answer"))
add("F45_plain_numbers", lambda s, d: ad.classifier_result(s, d).select("item", tx.plain_number(F.regexp_replace("value", "score: ", "")).alias("x")), ad.with_views("classifier_result", "SELECT item, TRY_CAST(replace(value, 'score: ', '') AS DOUBLE) AS x FROM classifier_result"))
add("F46_last_numbers", lambda s, d: ad.classifier_result(s, d).select("item", tx.last_number(F.col("value")).alias("x")), ad.with_views("classifier_result", "SELECT item, TRY_CAST(trim(string_split(value, ':')[-1]) AS DOUBLE) AS x FROM classifier_result"))
add("F47_list_values", lambda s, d: P(s, d).select("page_id", F.array_join(H.tools(F.col("html"), "analytics"), ",").alias("value")), "SELECT page_id, CASE WHEN lower(html) LIKE '%track(%' THEN 'track(' ELSE '' END AS value FROM pages")
add("F48_active_tasks", lambda s, d: ad.study(s, d).select("id", tx.active_tasks(F.lit('[{"name":"a","active":true},{"name":"b","active":false},{"name":"c","target_type":"result"}]'), "result").alias("n")), "SELECT r_regionkey AS id, 2 AS n FROM region")

# HTML
_B = "lower(html) LIKE '{0}'"
add("H01_microdata", lambda s, d: P(s, d).select("page_id", F.size(H.microdata(F.col("html"))).alias("n")), "SELECT page_id, " + " + ".join(f"CAST(contains(lower(html), '{w.strip('*')}') AS INT)" for w in H.MICRODATA if w != "*typeof=*") + " + CAST(contains(lower(html), 'typeof=') AS INT) AS n FROM pages")
add("H02_open_graph", lambda s, d: P(s, d).select("page_id", H.has_og(F.col("html")).alias("x")), f"SELECT page_id, {_B.format('<%meta%og:%>')} AS x FROM pages")
add("H03_viewport", lambda s, d: P(s, d).select("page_id", H.has_viewport(F.col("html")).alias("x")), f"SELECT page_id, {_B.format('%meta%name%viewport%')} AS x FROM pages")
add("H04_sitemap", lambda s, d: P(s, d).select("page_id", H.has_sitemap(F.col("html")).alias("x")), f"SELECT page_id, {_B.format('%a%href%sitemap%')} AS x FROM pages")
add("H16_tools", lambda s, d: P(s, d).select("page_id", *[F.size(H.tools(F.col("html"), g)).alias(g) for g in H.TOOLS]), "SELECT page_id, " + ", ".join("CAST(" + " + ".join(f"CAST(contains(lower(html), '{w.strip('*')}') AS INT)" for w in ws) + f" AS INT) AS {g}" for g, ws in H.TOOLS.items()) + " FROM pages")
QUERIES["J19_tool_patterns"], SQL["J19_tool_patterns"] = QUERIES["H16_tools"], SQL["H16_tools"]
add("H20_structured_data", lambda s, d: P(s, d).select("page_id", H.structured_data_score(F.col("html")).alias("score")), "SELECT page_id, CASE WHEN contains(html, 'application/ld+json') THEN 100 WHEN contains(html, 'schema.org') THEN 50 ELSE 0 END AS score FROM pages")
add("P22_html_gate", lambda s, d: P(s, d).where(u.is_page(F.col("url"), F.when(F.col("page_id") % 4 > 0, "text/html; charset=utf-8").otherwise("application/pdf"))).select("page_id"), "SELECT page_id FROM pages WHERE page_id % 4 > 0")
add("P23_geo_gate", lambda s, d: P(s, d).select("page_id", F.when(F.col("page_id") % 4 == 0, "type").when(F.col("page_id") % 4 == 1, "status").alias("reason")), "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'type' WHEN 1 THEN 'status' END AS reason FROM pages")
add("P24_content_quality", lambda s, d: P(s, d).select("page_id", H.content_quality(F.lit("error"), F.col("html"), F.col("url"), F.lit("html"))["valid"].alias("valid")), "SELECT page_id, CASE WHEN length(html) < 100 THEN -1 WHEN contains(lower(html), '<body') AND regexp_matches(lower(html), '<div|<table|<article|<section|<main|<p>') AND (length(html) > 5000 OR (length(html) > 1000 AND contains(lower(html), '<html') AND contains(lower(html), '</html>'))) THEN 1 ELSE -1 END AS valid FROM pages")


#: Markup that the test pages lack, added by the page's number so that answers vary: (before what, SQL that both sides run).
_ADDED = (
    ("</head>", """concat(CASE WHEN page_id % 3 = 0 THEN concat('<meta name="description" content="', repeat('of a', CAST(page_id % 50 AS INT)), '">') ELSE '' END,
        CASE WHEN page_id % 4 = 0 THEN '<link rel="canonical" href="/c">' ELSE '' END, CASE WHEN page_id % 5 = 0 THEN concat('<meta name="generator" content="Tool ', page_id % 7, '">') ELSE '' END,
        CASE WHEN page_id % 6 = 0 THEN '<meta property="og:title" content="x">' ELSE '' END, CASE WHEN page_id % 7 = 0 THEN '<meta name="twitter:card" content="x">' ELSE '' END,
        CASE WHEN page_id % 9 = 4 THEN '<script type="application/ld+json">{"@type": "FAQPage"}</script>' ELSE '' END)"""),
    ("<article>", """concat(repeat('<img src="a" alt="x">', CAST(page_id % 3 AS INT)), repeat('<img src="b">', CAST(page_id % 4 AS INT)), CASE WHEN page_id % 5 = 1 THEN '<blockquote>It was 45% in 1999, or 7,5 % in 2004</blockquote>' ELSE '' END,
        CASE WHEN page_id % 5 = 2 THEN '<h2>Why of the?</h2><p>Because.</p>' ELSE '' END, CASE WHEN page_id % 7 = 3 THEN '<span class="author">One</span>' ELSE '' END,
        repeat('<a href="https://other.example/x">the one</a>', CAST(page_id % 6 AS INT)), CASE WHEN page_id % 4 = 2 THEN '<footer>Contact us</footer>' ELSE '' END)"""),
)
_HTML = "html"
for _at, _sql in _ADDED:
    _HTML = f"replace({_HTML}, '{_at}', concat({_sql}, '{_at}'))"
#: The pages with that markup, for SQL: t is the visible text, b what of it is in the body but not in navigation or footers, k the title.
_RICH = f"""WITH r0 AS (SELECT page_id, url, {_HTML} AS html FROM pages),
r1 AS (SELECT *, regexp_replace(html, '(?s)<style.*?</style>|<script.*?</script>|<!--.*?-->', ' ', 'g') AS seen FROM r0),
r AS (SELECT page_id, url, html, {_MAIN} AS main, regexp_replace(seen, '<[^>]*>', ' ', 'g') AS t,
  regexp_replace(regexp_replace(regexp_extract(seen, '(?s)<body>(.*)', 1), '(?s)<nav>.*?</nav>|<footer>.*?(</footer>|$)', ' ', 'g'), '<[^>]*>', ' ', 'g') AS b,
  trim(replace(replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')) AS k,
  regexp_extract(html, '<meta name="description" content="([^"]*)"', 1) AS d FROM r1)
"""


def _pages(s, d):
    """Parsed pages, with markup that the test pages lack and the inputs that need a network as constants or made from the id."""
    p = P(s, d).withColumn("html", F.expr(_HTML)).withColumn("p", H.page("html"))
    return p.withColumns({"main": u.main_domain(F.col("url")), "loading_time": (F.col("page_id") % 12).cast("double"), "query": F.when(F.col("page_id") % 2 == 0, "the").otherwise("")})


def _field(*names: str):
    return lambda s, d: _pages(s, d).select("page_id", *[F.col(f"p.{n}") for n in names])


_COUNT = "CAST(len(regexp_extract_all(html, '<{0}[ >]')) AS INT)"
_N_WORDS = "CAST(len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda x: x <> '')) AS INT)"
_IN, _OUT = "len(regexp_extract_all(html, '<a [^>]*href=\"/'))", "len(regexp_extract_all(html, '<a [^>]*href=\"https://other'))"
_IMG, _ALT = "len(regexp_extract_all(html, '<img '))", "len(regexp_extract_all(html, '<img [^>]*alt='))"


def _steps(v: str, *bands: tuple[int, int, int], other: int = 0) -> str:
    """The points of the first band that holds a value."""
    return "CASE " + " ".join(f"WHEN {v} BETWEEN {a} AND {b} THEN {n}.0::DOUBLE" for a, b, n in bands) + f" ELSE {other}.0::DOUBLE END"
add("H05_generator", _field("generator"), _RICH + "SELECT page_id, regexp_extract(html, '<meta name=\"generator\" content=\"([^\"]*)\"', 1) AS generator FROM r")
add("H06_canonical", _field("canonical"), _RICH + "SELECT page_id, CAST(len(regexp_extract_all(html, 'rel=\"canonical\"')) AS INT) AS canonical FROM r")
add("H07_nofollow", _field("nofollow"), _RICH + "SELECT page_id, CAST(len(regexp_extract_all(html, '<a [^>]*rel=\"nofollow\"')) AS INT) AS nofollow FROM r")
add("H08_h1", _field("h1"), _RICH + f"SELECT page_id, {_COUNT.format('h1')} AS h1 FROM r")
add("H09_h2", _field("h2"), _RICH + f"SELECT page_id, {_COUNT.format('h2')} AS h2 FROM r")
add("H10_keyword_hits", lambda s, d: _pages(s, d).select("page_id", sc.query_terms_found(F.col("p"), F.lit("the of")).alias("n")), _RICH + "SELECT page_id, CAST(list_sum(list_transform(list_concat([k, d], list_concat(regexp_extract_all(html, '<h[1-6]>(.*?)</h[1-6]>', 1), regexp_extract_all(html, '<a [^>]*>(.*?)</a>', 1))), lambda x: CAST(contains(lower(x), 'the') AS INT) + CAST(contains(lower(x), 'of') AS INT))) AS INT) AS n FROM r")
add("H11_description", lambda s, d: _pages(s, d).select("page_id", (F.col("p.description") != "").alias("x")), _RICH + "SELECT page_id, d <> '' AS x FROM r")
add("H12_title", lambda s, d: _pages(s, d).select("page_id", (F.col("p.title") != "").alias("x")), "SELECT page_id, trim(regexp_extract(html, '<title>(.*?)</title>', 1)) <> '' AS x FROM pages")
add("H13_links", lambda s, d: _pages(s, d).select("page_id", F.size("p.links").alias("n")), _RICH + f"SELECT page_id, {_COUNT.format('a')} AS n FROM r")
add("H14_link_counts", lambda s, d: _pages(s, d).select("page_id", H.links_of(F.col("p"), F.col("main"))["internal"].alias("internal"), H.links_of(F.col("p"), F.col("main"))["external"].alias("external")), _RICH + f"SELECT page_id, CAST({_IN} AS INT) AS internal, CAST({_OUT} AS INT) AS external FROM r")
add("H15_trusted_links", lambda s, d: _pages(s, d).select("page_id", F.size(F.filter("p.links", lambda x: x["href"].rlike(r"\.gov|\.edu|wikipedia\.org"))).alias("n")), _RICH + "SELECT page_id, CAST(len(regexp_extract_all(html, 'href=\"[^\"]*(\\.gov|\\.edu|wikipedia\\.org)')) AS INT) AS n FROM r")
add("H17_source_lists", lambda s, d: P(s, d).select("page_id", F.contains(u.bare_host(F.col("url")), F.lit("example.org")).alias("listed")), f"SELECT page_id, contains({_BARE}, 'example.org') AS listed FROM pages")
add("H18_robots", lambda s, d: P(s, d).select("page_id", (F.col("page_id") % 2 == 0).alias("robots_txt")), "SELECT page_id, page_id % 2 = 0 AS robots_txt FROM pages")
add("H19_loading_time", lambda s, d: _pages(s, d).select("page_id", "loading_time"), "SELECT page_id, CAST(page_id % 12 AS DOUBLE) AS loading_time FROM pages")
add("H21_tables_and_lists", _field("tables", "ul", "ol", "li"), _RICH + f"SELECT page_id, {_COUNT.format('table')} AS tables, {_COUNT.format('ul')} AS ul, {_COUNT.format('ol')} AS ol, {_COUNT.format('li')} AS li FROM r")
add("H22_questions", _field("faq_page", "qa_pairs"), _RICH + "SELECT page_id, CAST(len(regexp_extract_all(html, 'FAQPage')) AS INT) AS faq_page, CAST(len(regexp_extract_all(html, '<h[1-6]>[^<]*\\?</h[1-6]>')) AS INT) AS qa_pairs FROM r")
add("H23_paragraphs", lambda s, d: _pages(s, d).select("page_id", F.size("p.paragraphs").alias("n")), _RICH + f"SELECT page_id, {_COUNT.format('p')} AS n FROM r")
add("H24_authority", _field("blockquotes", "author_tags"), _RICH + f"SELECT page_id, {_COUNT.format('blockquote')} AS blockquotes, CAST(len(regexp_extract_all(html, 'class=\"author\"')) AS INT) AS author_tags FROM r")
add("H25_organisation", lambda s, d: _pages(s, d).select("page_id", F.lower("p.footer").rlike("imprint|contact|privacy").alias("x")), _RICH + "SELECT page_id, regexp_matches(lower(array_to_string(regexp_extract_all(html, '(?s)<footer>(.*?)(</footer>|$)', 1), ' ')), 'imprint|contact|privacy') AS x FROM r")
add("H26_entities", lambda s, d: _pages(s, d).select("page_id", tx.distinct_percentages(F.col("p.body")).alias("n_percent"), tx.distinct_years(F.col("p.body")).alias("n_years")), _RICH + "SELECT page_id, CAST(len(list_distinct(regexp_extract_all(b, '\\d+(?:[.,]\\d+)?\\s*%'))) AS INT) AS n_percent, CAST(len(list_distinct(regexp_extract_all(b, '\\b(19[5-9]\\d|20[0-3]\\d)\\b', 1))) AS INT) AS n_years FROM r")
add("H27_clean_body", lambda s, d: _pages(s, d).select("page_id", H.word_count(F.col("p.body")).alias("n_words")), _RICH + f"SELECT page_id, {_N_WORDS.format('b')} AS n_words FROM r")
add("H28_language", _field("lang"), "SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM pages")
add("H29_reading_ease", lambda s, d: _pages(s, d).select("page_id", sc.reading_ease(F.col("p.text"), F.col("p.lang")).alias("score")))
add("H30_content_length", lambda s, d: _pages(s, d).select("page_id", sc.content_length(H.word_count(F.col("p.text"))).alias("score")), _RICH + f"SELECT page_id, CASE WHEN n >= 1500 THEN 100.0::DOUBLE WHEN n >= 1000 THEN 80 WHEN n >= 500 THEN 60 WHEN n >= 300 THEN 40 ELSE n / 300 * 40 END AS score FROM (SELECT page_id, {_N_WORDS.format('t')} AS n FROM r)")
add("H31_headings", lambda s, d: _pages(s, d).select("page_id", sc.headings(F.col("p.h1"), F.col("p.h2") + F.col("p.h3"), F.col("p.h456")).alias("score")), _RICH + f"SELECT page_id, CASE WHEN {_COUNT.format('h1')} = 1 THEN 40.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN {_COUNT.format('h[23]')} > 0 THEN 30.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN {_COUNT.format('h[456]')} > 0 THEN 30.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM r")
_LQ = lambda f: lambda s, d: _pages(s, d).withColumn("k", H.links_of(F.col("p"), F.col("main"))).select("page_id", f().alias("score"))
add("H32_link_quality", _LQ(lambda: sc.link_quality(F.col("k.internal"), F.col("k.external"))), _RICH + f"SELECT page_id, CASE WHEN q BETWEEN 0.6 AND 0.8 THEN 50.0::DOUBLE WHEN q BETWEEN 0.4 AND 0.9 THEN 30.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN n >= 10 THEN 50.0::DOUBLE WHEN n >= 5 THEN 25.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM (SELECT page_id, {_IN} + {_OUT} AS n, CASE WHEN {_IN} + {_OUT} > 0 THEN {_IN}::DOUBLE / ({_IN} + {_OUT}) ELSE -1 END AS q FROM r)")
add("H33_images", lambda s, d: _pages(s, d).select("page_id", sc.images(F.col("p.images"), F.col("p.images_alt")).alias("score")), _RICH + f"SELECT page_id, CASE WHEN {_IMG} > 0 THEN round_even(100.0::DOUBLE * {_ALT} / {_IMG}, 0) ELSE 0.0::DOUBLE END AS score FROM r")
add("H34_navigation", lambda s, d: _pages(s, d).select("page_id", sc.navigation(F.col("p.has_nav"), F.col("p.has_footer"), F.col("p.has_form")).alias("score")), _RICH + "SELECT page_id, CASE WHEN regexp_matches(html, '<(nav|menu)[ >]') THEN 40.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN regexp_matches(html, '<footer[ >]') THEN 30.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN regexp_matches(html, '<form[ >]') THEN 30.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM r")
add("H35_title_score", lambda s, d: _pages(s, d).select("page_id", sc.title_score(F.col("p.title")).alias("score"), sc.geo_title_score(F.col("p.title")).alias("geo")), _RICH + f"SELECT page_id, CASE WHEN length(k) = 0 THEN 0.0::DOUBLE ELSE {_steps('length(k)', (50, 60, 100), (40, 70, 80), (30, 80, 60), other=40)} END AS score, CASE WHEN length(k) = 0 THEN 0.0::DOUBLE WHEN length(k) >= 15 THEN 40.0::DOUBLE ELSE 20.0::DOUBLE END AS geo FROM r")
add("H36_description_score", lambda s, d: _pages(s, d).select("page_id", sc.description_score(F.col("p.description")).alias("score"), sc.geo_description_score(F.col("p.description")).alias("geo")), _RICH + f"SELECT page_id, CASE WHEN length(d) = 0 THEN 0.0::DOUBLE ELSE {_steps('length(d)', (150, 160, 100), (130, 170, 80), (110, 190, 60), other=40)} END AS score, CASE WHEN length(d) = 0 THEN 0.0::DOUBLE WHEN length(d) >= 40 THEN 40.0::DOUBLE ELSE 20.0::DOUBLE END AS geo FROM r")
add("H37_social_tags", lambda s, d: _pages(s, d).select("page_id", sc.social_tags(F.col("p.og_tags"), F.col("p.twitter_tags")).alias("score")), _RICH + "SELECT page_id, CASE WHEN contains(html, 'og:title') THEN 50.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN contains(html, 'twitter:card') THEN 50.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM r")
add("H38_keyword_score", lambda s, d: _pages(s, d).select("page_id", sc.keyword_optimisation(F.col("p"), F.col("url"), F.lit("of the")).alias("score")), _RICH + "SELECT page_id, CASE WHEN contains(lower(url), 'of the') THEN 25.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN contains(lower(k), 'of the') THEN 25.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN contains(lower(d), 'of the') THEN 25.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN regexp_matches(lower(html), '<h[1-6]>[^<]*of the') THEN 25.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM r")
add("H39_general_score", lambda s, d: _pages(s, d).select("page_id", sc.keyword_optimisation(F.col("p"), F.col("url"), F.lit("")).alias("score")), _RICH + f"SELECT page_id, CASE WHEN length(k) BETWEEN 20 AND 70 THEN 25.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN length(d) BETWEEN 120 AND 160 THEN 25.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN {_COUNT.format('h1')} = 1 THEN 25.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN {_COUNT.format('h[123]')} >= 3 THEN 25.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM r")


def _seo(s, d):
    p = _pages(s, d)
    i = sc.seo_indicators(F.col("p"), F.col("html"), F.col("url"), F.col("main"), F.col("query"), F.col("loading_time"), F.col("page_id") % 2 == 0)
    return sc.once(p, i, "i").withColumn("s", sc.seo_score(F.col("i"), F.col("page_id") % 9 > 0))


def _geo(s, d):
    i = sc.geo_indicators(F.col("p"), F.col("html"), F.col("url"), F.col("main"), F.col("p.lang"), F.col("loading_time"), F.lit("N/A"))
    return sc.once(_pages(s, d), i, "i").withColumn("s", sc.geo_score(F.col("i")))


def _rules(s, d):
    host = u.bare_host(F.col("url"))
    on = {k: F.contains(host, F.lit(v)) for k, v in {"customers": "a.example.com", "news": "news", "ads": "ads.", "shop": "shop", "company": "example.org", "not_optimised": "th.example.net"}.items()}
    return _seo(s, d).select("page_id", sc.rule_class(F.col("i"), on, F.col("p")).alias("class"))


add("C01_rule_class", _rules)
add("C02_seo_score", lambda s, d: _seo(s, d).select("page_id", "s.total_score", "s.classification", "s.explanation"))
for _n, _f in (("C02a_technical", "technical_seo"), ("C02b_content", "content_quality"), ("C02c_user_experience", "user_experience"), ("C02d_meta", "meta_elements"), ("C02e_explanation", "explanation")):
    add(_n, lambda s, d, f=_f: _seo(s, d).select("page_id", F.col(f"s.{f}")))
add("C03_geo_score", lambda s, d: _geo(s, d).select("page_id", "s.total_score", "s.classification", "s.explanation"))
for _n, _f in (("C03a_semantics", "semantics_readability"), ("C03b_structure", "structure_formatting"), ("C03c_authority", "authority_trust"), ("C03d_technical", "technical_baseline"), ("C03e_explanation", "explanation")):
    add(_n, lambda s, d, f=_f: _geo(s, d).select("page_id", F.col(f"s.{f}")))
add("C04_excluded", lambda s, d: _seo(s, d).where("s.classification = 'excluded'").select("page_id", "s.total_score"), "SELECT page_id, 0.0::DOUBLE AS total_score FROM pages WHERE page_id % 9 = 0")
add("C05_readability", lambda s, d: D(s, d).select("doc_id", sc.reading_ease(F.col("text"), F.col("lang")).alias("score")))
add("C06_readability_status", lambda s, d: D(s, d).select("doc_id", F.regexp_replace(sc.readability_status(F.col("text"), F.col("lang"), sc.reading_ease(F.col("text"), F.col("lang"))), r"^-?\d+\.\d+$", "scored").alias("status")))
add("C07_llm_tasks", lambda s, d: cl.llm_tasks(D(s, d).select(F.col("doc_id").alias("item"), F.col("lang").alias("kind"), "text"), s.createDataFrame([("t1", "all", "Rate {\"n\": 0}"), ("t2", "de", "x")], "task string, target string, prompt string"), D(s, d).where("doc_id % 2 = 0").select(F.lit("t1").alias("task"), F.col("doc_id").alias("item")), _stub), "SELECT 't1' AS task, doc_id AS item, '{\"n\": ' || length(left(coalesce(text, ''), 3000)) || '}' AS value FROM documents WHERE doc_id % 2 = 1 UNION ALL SELECT 't2', doc_id, '{\"n\": ' || length(left(coalesce(text, ''), 3000)) || '}' FROM documents WHERE lang = 'de'")
add("C13_plug_in", lambda s, d: cl.classify(D(s, d).select("doc_id", "text"), "length").select("doc_id", "n_words", "value"), "WITH w AS (SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')) AS INT) AS n_words FROM documents) SELECT doc_id, n_words, CASE WHEN n_words >= 100 THEN 'long' ELSE 'short' END AS value FROM w")
QUERIES["X01_plug_in"], SQL["X01_plug_in"] = QUERIES["C13_plug_in"], SQL["C13_plug_in"]


def _stub(prompt: str, text: str) -> str:
    """Stands in for a service: the same answer for the same text."""
    return f'Sure: {{"n": {len(text)}}}'


# time: batch forms of leases and windows over events (an extension)
_Q = lambda s, d: ad.result(s, d).select(F.concat_ws("-", "item", "position", "normalized_url").alias("id"), "study", "progress", "counter", F.lit("me").alias("job_server"), "created_at")
_T = lambda: F.to_timestamp(F.lit("1998-01-01 00:00:00"))
add("T05_recovered_leases", lambda s, d: ls.recover(_Q(s, d), _T(), "me").groupBy("study", "progress", "counter").agg(F.count(F.lit(1)).alias("n")), ad.with_views("result", "WITH x AS (SELECT *, progress IN (2, -1) AND counter < 3 AND created_at < TIMESTAMP '1998-01-01' - INTERVAL 10 MINUTE AS back, counter >= 3 AND (progress = -1 OR (progress IN (0, 2) AND created_at < TIMESTAMP '1998-01-01' - INTERVAL 10 MINUTE)) AS lost FROM result) SELECT study, CASE WHEN lost THEN -1 WHEN back THEN 0 ELSE progress END AS progress, CASE WHEN back THEN counter + 1 ELSE counter END AS counter, count(*) AS n FROM x GROUP BY ALL"))
QUERIES["T06_classifier_leases"], SQL["T06_classifier_leases"] = QUERIES["T05_recovered_leases"], SQL["T05_recovered_leases"]
add("T07_stuck_reset", lambda s, d: ls.reset_stuck(ad.answer(s, d)).groupBy("status").agg(F.count(F.lit(1)).alias("n")), ad.with_views("answer", "SELECT CASE status WHEN 2 THEN 0 ELSE status END AS status, count(*) AS n FROM answer GROUP BY 1"))
add("T08_claims", lambda s, d: ls.claim(ad.answer(s, d).select("id", "study", F.col("status").alias("progress"), "created_at"), "me", _T()).select("id", "study", "progress"), ad.with_views("answer", "WITH r AS (SELECT id, study, row_number() OVER (PARTITION BY study ORDER BY id) AS turn FROM answer WHERE status = 0) SELECT id, study, 2 AS progress FROM r ORDER BY turn, study DESC, id LIMIT 20"))
add("T11_progress_payload", lambda s, d: ad.answer(s, d).groupBy("study").agg(F.count_if(F.col("status") == 1).alias("done"), F.count(F.lit(1)).alias("total")), ad.with_views("answer", "SELECT study, count(*) FILTER (status = 1) AS done, count(*) AS total FROM answer GROUP BY study"))
add("T20_event_windows", lambda s, d: ls.event_windows(ad.read(s, d, "events")), "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY ALL")
add("T21_sessions", lambda s, d: ls.sessions(ad.read(s, d, "events")), "WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM g GROUP BY user_id, k")

# answers, sessions and registries
C = lambda s, d: ad.read(s, d, "conversations").where("role = 'assistant'")
add("F04_text_to_html", lambda s, d: C(s, d).select("conv_id", "turn", F.length(aw.text_to_html(F.col("text"))).alias("n")), "SELECT conv_id, turn, length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) + 3 * (length(text) - length(replace(text, chr(10), ''))) AS n FROM conversations WHERE role = 'assistant'")
add("F33_html_to_text", lambda s, d: P(s, d).select("page_id", F.length(aw.plain_text(F.col("html"))).alias("n")))
add("F34_answer_segments", lambda s, d: C(s, d).select("conv_id", "turn", F.size(aw.answer_segments(F.regexp_replace("text", r"\. ", ". [1] "))).alias("n")))
add("U08_distinct_links", lambda s, d: _pages(s, d).select("page_id", F.size(F.array_distinct(F.transform("p.links", lambda x: x["href"]))).alias("n")), _RICH + "SELECT page_id, CAST(len(list_distinct(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1))) AS INT) AS n FROM r")
add("S31_rule_lists", lambda s, d: P(s, d).crossJoin(F.broadcast(s.createDataFrame([(g, tx.like_pattern(w)) for g, ws in H.TOOLS.items() for w in ws], "tool string, pattern string"))).where(F.expr("lower(html) like pattern")).groupBy("tool").agg(F.countDistinct("page_id").alias("n")), " UNION ALL ".join(f"SELECT '{g}' AS tool, count(*) AS n FROM pages WHERE " + " OR ".join(f"contains(lower(html), '{w.strip('*')}')" for w in ws) + " HAVING count(*) > 0" for g, ws in H.TOOLS.items() if all("?" not in w for w in ws)))
add("S35_session_export", lambda s, d: ad.answer(s, d).groupBy("participant").agg(F.collect_list(F.struct("id", "kind", "value")).alias("rows")).select("participant", F.explode("rows").alias("r")).select("participant", "r.id", "r.kind", "r.value"), ad.with_views("answer", "SELECT participant, id, kind, value FROM answer"))
add("S37_orphan_files", lambda s, d: P(s, d).select(F.lower("url").alias("path")).join(P(s, d).where("page_id % 2 = 0").select(F.lower("url").alias("path")), "path", "left_anti"), "SELECT lower(url) AS path FROM pages WHERE lower(url) NOT IN (SELECT lower(url) FROM pages WHERE page_id % 2 = 0)")
add("S38_engine_registry", lambda s, d: ad.result(s, d).select("engine_text").distinct().join(s.createDataFrame([("a_xx_f",), ("other",)], "engine_text string"), "engine_text", "left_anti"), ad.with_views("result", "SELECT DISTINCT engine_text FROM result WHERE engine_text NOT IN ('a_xx_f', 'other')"))
QUERIES["X04_configured_task"], SQL["X04_configured_task"] = QUERIES["C07_llm_tasks"], SQL["C07_llm_tasks"]
