"""Scores of documents: search optimisation, generative engines, readability and the rule-based class.

Sub-scores are column expressions over indicators; all weights and bands are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import html as H
from .text import distinct_percentages, distinct_years, terms

CLASSES = ("most_probably_optimized", "probably_optimized", "probably_not_optimized", "most_probably_not_optimized")


def _add(flag: Column, points: float) -> Column:
    return F.when(flag, F.lit(float(points))).otherwise(0.0)


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))


def bands(v: Column, *steps: tuple[float, float, float], other: float = 0.0) -> Column:
    """Points of the first band (low, high, points) that holds the value."""
    out = None
    for lo, hi, points in steps:
        out = (F if out is None else out).when(v.between(lo, hi), float(points))
    return out.otherwise(float(other))


def content_length(words: Column) -> Column:
    return F.when(words >= 1500, 100.0).when(words >= 1000, 80.0).when(words >= 500, 60.0).when(words >= 300, 40.0).otherwise(words / 300 * 40)


def headings(h1: Column, h23: Column, h456: Column) -> Column:
    return _add(h1 == 1, 40) + _add(h23 > 0, 30) + _add(h456 > 0, 30)


def link_quality(internal: Column, external: Column) -> Column:
    total = internal + external
    ratio = F.coalesce(F.try_divide(internal, total), F.lit(-1.0))
    return bands(ratio, (0.6, 0.8, 50), (0.4, 0.9, 30)) + F.when(total >= 10, 50.0).when(total >= 5, 25.0).otherwise(0.0)


def geo_link_quality(internal: Column, external: Column, trusted: Column) -> Column:
    total = internal + external
    ratio = F.coalesce(F.try_divide(internal, total), F.lit(-1.0))
    return F.least(F.lit(100.0), bands(ratio, (0.6, 0.8, 30), (0.4, 0.9, 20)) + F.when(total >= 10, 30.0).when(total >= 5, 15.0).otherwise(0.0) + F.when(trusted >= 3, 40.0).when(trusted > 0, 20.0).otherwise(0.0))


def images(n: Column, with_alt: Column) -> Column:
    return F.when(n > 0, F.bround(100.0 * with_alt / n)).otherwise(0.0)


def navigation(nav: Column, footer: Column, form: Column) -> Column:
    return _add(nav, 40) + _add(footer, 30) + _add(form, 30)


def title_score(title: Column) -> Column:
    n = F.length(title)
    s = bands(n, (50, 60, 100), (40, 70, 80), (30, 80, 60), other=40)
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), s - _add(F.lower(title).isin("untitled", "home", "page"), 30)))


def description_score(text: Column) -> Column:
    n = F.length(text)
    s = bands(n, (150, 160, 100), (130, 170, 80), (110, 190, 60), other=40)
    return F.when(F.length(F.trim(text)) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), s - _add(F.lower(text).isin("description", "website description"), 30)))


def geo_title_score(title: Column, entities: Column | None = None) -> Column:
    s = F.when(F.lower(title).isin("untitled", "home", "page", "startseite"), 0.0).when(F.length(title) >= 15, 40.0).otherwise(20.0)
    more = _add(entities > 0, 60) if entities is not None else F.lit(0.0)
    return F.when(F.length(title) == 0, 0.0).when(s == 0, 0.0).otherwise(F.least(F.lit(100.0), s + more))


def geo_description_score(text: Column, entities: Column | None = None) -> Column:
    s = F.when(F.lower(text).isin("description", "website description", "meta description"), 0.0).when(F.length(text) >= 40, 40.0).otherwise(20.0)
    more = F.when(entities >= 2, 60.0).when(entities == 1, 30.0).otherwise(0.0) if entities is not None else F.lit(0.0)
    return F.when(F.length(F.trim(text)) == 0, 0.0).when(s == 0, 0.0).otherwise(F.least(F.lit(100.0), s + more))


def social_tags(og: Column, twitter: Column) -> Column:
    return _add(F.size(og) > 0, 50) + _add(F.size(twitter) > 0, 50)


def keyword_optimisation(p: Column, url: Column, query: Column) -> Column:
    """With a query: 25 each for address, title, description and headings.  Without: 25 each for the
    lengths of title and description, one h1, and three headings of the first three levels."""
    q = F.lower(query)
    given = _add(F.contains(F.lower(url), q), 25) + _add(F.contains(F.lower(p["title"]), q), 25) + _add(F.contains(F.lower(p["description"]), q), 25) + _add(F.exists(p["headings"], lambda h: F.contains(F.lower(h), q)), 25)
    heads = p["h1"] + p["h2"] + p["h3"]
    general = _add(F.length(p["title"]).between(20, 70), 25) + _add(F.length(p["description"]).between(120, 160), 25) + _add((heads > 0) & (p["h1"] == 1), 25) + _add(heads >= 3, 25)
    return F.when(F.coalesce(F.length(F.trim(query)), F.lit(0)) > 0, given).otherwise(general)


def technical(i: Column) -> Column:
    return _clamp(
        F.when(i["https"], 20.0).otherwise(-20.0) + F.when(i["robots_txt"], 20.0).otherwise(-20.0) + _add(i["sitemap"], 20) + _add(i["canonical"] > 0, 20) + _add(i["schema"], 20) + _add(F.size(i["tools_caching"]) > 0, 10) + _add(F.size(i["tools_micro"]) > 0, 5)
    )


def content(i: Column) -> Column:
    s = i["content_length_score"] * 0.3 + i["heading_structure_score"] * 0.2 + i["link_quality_score"] * 0.2 + i["keyword_optimization_score"] * 0.3 + i["image_optimization_score"] * 0.2
    s = F.when((i["title_score"] == 0) | (i["description_score"] == 0), F.greatest(F.lit(0.0), s - 20)).otherwise(s)  # before the bonuses
    return _clamp(s + _add(F.size(i["tools_content"]) > 0, 10) + _add(F.size(i["tools_social"]) > 0, 5))


def user_experience(i: Column) -> Column:
    t = i["loading_time"]
    speed = F.when((t > 0) & (t < 2), 40.0).when((t >= 2) & (t < 3), 30.0).when((t >= 3) & (t < 4), 20.0).otherwise(0.0)
    return _clamp(speed + _add(i["viewport"], 20) + i["navigation_score"] * 0.2 + _add(i["https"], 20) + _add(F.size(i["tools_micro"]) > 0, 5))


def meta(i: Column) -> Column:
    part = lambda c, w, lost: F.when(c == 0, -float(lost)).otherwise(c * w)
    s = part(i["title_score"], 0.3, 30) + part(i["description_score"], 0.3, 30) + part(i["social_tags_score"], 0.4, 20) + F.when(i["viewport"], 10.0).otherwise(-10.0) + F.when(i["h1"] > 0, 10.0).otherwise(-10.0)
    return _clamp(s)


def class_of(total: Column, names: tuple[str, ...] = CLASSES) -> Column:
    return F.when(total >= 75, names[0]).when(total >= 45, names[1]).when(total >= 20, names[2]).otherwise(names[3])


def once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``df`` with a column that is computed once for each row, however often it is read.

    A projection would be folded into its readers, and its expressions repeated for each field they
    name; a generator is not."""
    return df.withColumn(name, F.explode(F.array(value)))


def seo_indicators(p: Column, html: Column, url: Column, main: Column, query: Column, loading_time: Column, robots_txt: Column) -> Column:
    """The struct that the sub-scores read; ``p`` is ``html.page(html)``."""
    links = H.links_of(p, main)
    return F.struct(
        F.lower(url).startswith("https").alias("https"), robots_txt.alias("robots_txt"), H.has_sitemap(html).alias("sitemap"), p["canonical"].alias("canonical"), html.rlike("application/ld\\+json|schema\\.org").alias("schema"),
        *[H.tools(html, g).alias(f"tools_{g}") for g in H.TOOLS], H.microdata(html).alias("tools_micro"),
        content_length(H.word_count(p["text"])).alias("content_length_score"), headings(p["h1"], p["h2"] + p["h3"], p["h456"]).alias("heading_structure_score"),
        link_quality(links["internal"], links["external"]).alias("link_quality_score"), keyword_optimisation(p, url, query).alias("keyword_optimization_score"), images(p["images"], p["images_alt"]).alias("image_optimization_score"),
        title_score(p["title"]).alias("title_score"), description_score(p["description"]).alias("description_score"), social_tags(p["og_tags"], p["twitter_tags"]).alias("social_tags_score"),
        navigation(p["has_nav"], p["has_footer"], p["has_form"]).alias("navigation_score"), loading_time.alias("loading_time"), H.has_viewport(html).alias("viewport"), H.has_og(html).alias("og"), p["h1"].alias("h1"), p["nofollow"].alias("nofollow"),
    )


def seo_score(i: Column, is_html: Column) -> Column:
    """struct of the four sub-scores, the total, the class and the reasons.  Other documents are
    excluded with 0; a plug-in for search optimisation gives 100 throughout."""
    plug = F.size(i["tools_seo"]) > 0
    sub = {"technical_seo": technical(i), "content_quality": content(i), "user_experience": user_experience(i), "meta_elements": meta(i)}
    sub = {k: F.when(plug, 100.0).otherwise(v) for k, v in sub.items()}
    raw = sub["technical_seo"] * 0.35 + sub["content_quality"] * 0.3 + sub["user_experience"] * 0.2 + sub["meta_elements"] * 0.15
    total = F.when(plug, 100.0).otherwise(F.bround(F.when(F.size(i["tools_analytics"]) > 0, F.least(F.lit(100.0), raw + 5)).otherwise(raw), 2))
    total = F.when(is_html, total).otherwise(0.0)
    why = F.concat_ws(". ", F.array_compact(F.array(F.when(~i["https"], "No https"), F.when(~i["sitemap"], "No sitemap"), F.when(i["title_score"] == 0, "No title"), F.when(i["description_score"] == 0, "No description"), F.when(i["social_tags_score"] == 0, "No social tags"), F.when(~i["viewport"], "Not made for small screens"))))
    return F.struct(*[v.alias(k) for k, v in sub.items()], total.alias("total_score"), F.when(is_html, class_of(total)).otherwise("excluded").alias("classification"), why.alias("explanation"))


def rule_class(i: Column, on_list: dict[str, Column], p: Column) -> Column:
    """The class by rules; later rules win.  ``on_list`` says whether the host is on a list."""
    strong = (F.size(i["tools_seo"]) > 0) | on_list["customers"] | on_list["news"] | on_list["ads"] | (F.size(i["tools_micro"]) > 0)
    weak = (F.size(i["tools_analytics"]) > 0) | on_list["shop"] | on_list["company"] | i["viewport"] | i["robots_txt"] | i["sitemap"] | (i["nofollow"] > 0) | (i["canonical"] > 0) | ((i["loading_time"] < 3) & (i["loading_time"] > 0))
    bare = ((p["title"] == "") | (p["description"] == "") | (i["loading_time"] > 30)) & ~i["og"]
    return F.when(on_list["not_optimised"], CLASSES[3]).when(bare, CLASSES[2]).when(strong, CLASSES[0]).when(weak, CLASSES[1]).otherwise("uncertain")


def syllables(word: Column) -> Column:
    """Groups of vowels, a silent e at the end not counted, one at least."""
    n = F.regexp_count(F.lower(word), F.lit("[aeiouyäöüéèêáíóú]+")) - F.when(F.lower(word).rlike("[^aeiouyäöü]e$"), 1).otherwise(0)
    return F.greatest(n, F.lit(1))


def reading_ease(text: Column, lang: Column) -> Column:
    """Flesch reading ease by its public formulas for English and German; other languages are null,
    and so are texts of fewer than 100 words.  Syllables are an estimate."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w.rlike(r"\p{L}"))
    n = F.size(words)
    sentences = F.greatest(F.size(F.filter(F.split(text, r"[.!?]+(?:\s|$)"), lambda s: s.rlike(r"\p{L}"))), F.lit(1))
    per_word = F.aggregate(words, F.lit(0), lambda s, w: s + syllables(w)) / n
    length = n / sentences
    score = F.when(lang == "en", 206.835 - 1.015 * length - 84.6 * per_word).when(lang == "de", 180 - length - 58.5 * per_word)
    return F.when(n >= 100, F.round(score, 2))


def readability_status(text: Column, lang: Column, score: Column) -> Column:
    return F.when(text.isNull() | (F.trim(text) == ""), "source_failed").when(H.word_count(text) < 100, "text_too_short_or_unspaced").when(~lang.isin("en", "de"), F.concat(F.lit("Language '"), lang, F.lit("' not supported"))).when(score.isNull(), "error").otherwise(F.format_string("%.2f", score))


def geo_indicators(p: Column, html: Column, url: Column, main: Column, lang: Column, loading_time: Column, similarity: Column, trusted: tuple[str, ...] = (".gov", ".edu", "wikipedia.org", "doi.org")) -> Column:
    links = H.links_of(p, main)
    paras = F.filter(p["paragraphs"], lambda x: H.word_count(x) > 5)
    high = F.size(F.filter(F.array_distinct(F.transform(p["links"], lambda x: x["href"])), lambda h: F.exists(F.array(*[F.lit(t) for t in trusted]), lambda t: F.contains(h, t))))
    return F.struct(
        F.lower(url).startswith("https").alias("https"), loading_time.alias("loading_time"), H.microdata(html).alias("micros"), H.structured_data_score(html).alias("microdata_advanced_score"),
        content_length(H.word_count(p["body"])).alias("content_length_score"), headings(p["h1"], p["h2"] + p["h3"], p["h456"]).alias("heading_structure_score"),
        geo_link_quality(links["distinct_internal"], links["distinct_external"], high).alias("link_quality_score"), geo_title_score(p["title"]).alias("title_score"), geo_description_score(p["description"]).alias("description_score"),
        p["tables"].alias("tables"), p["ul"].alias("ul_lists"), p["ol"].alias("ol_lists"), p["author_tags"].alias("author_tags"), p["blockquotes"].alias("blockquotes"), p["faq_page"].alias("schema_faq_present"), p["qa_pairs"].alias("semantic_qa_count"),
        F.size(paras).alias("paragraphs"), F.coalesce(F.try_divide(F.aggregate(paras, F.lit(0), lambda s, x: s + H.word_count(x)), F.size(paras)), F.lit(0.0)).alias("avg_words_per_p"),
        F.coalesce(reading_ease(p["body"], lang), F.lit(50.0)).alias("readability_score"), (F.lower(p["footer"]).rlike("imprint|impressum|contact|about us|privacy") | F.exists(p["json_ld"], lambda j: F.contains(j, F.lit("Organization")))).alias("company_signals"),
        distinct_percentages(p["body"]).alias("percentage_count"), distinct_years(p["body"]).alias("year_count"), F.lit(0).alias("organizations_count"), F.lit(0.0).alias("keyword_density"), similarity.alias("similarity"),
    )


def geo_semantics(i: Column) -> Column:
    r = i["readability_score"]
    return _clamp(bands(i["avg_words_per_p"], (30, 70, 40), (15, 90, 20), other=5) + F.when(r.between(60, 75), 40.0).when(r.between(40, 90), 25.0).when(r >= 0, 15.0).otherwise(0.0) + _add(i["schema_faq_present"] + i["semantic_qa_count"] > 0, 20) - _add(i["keyword_density"] > 3, 20))


def geo_structure(i: Column) -> Column:
    return _clamp(i["heading_structure_score"] * 0.3 + i["content_length_score"] * 0.3 + i["title_score"] * 0.1 + i["description_score"] * 0.1 + _add(i["tables"] > 0, 10) + _add((i["ul_lists"] > 0) | (i["ol_lists"] > 0), 10))


def geo_authority(i: Column) -> Column:
    s = F.coalesce(i["similarity"].try_cast("double"), F.lit(0.0))
    return _clamp(i["link_quality_score"] * 0.4 + F.when(s >= 70, 25.0).when(s >= 40, 15.0).when(s >= 15, 5.0).otherwise(0.0) + _add(i["company_signals"], 10) + _add(i["author_tags"] > 0, 5) + _add(i["percentage_count"] > 0, 5) + _add(i["year_count"] > 0, 5) + _add(i["organizations_count"] > 0, 10))


def geo_technical(i: Column) -> Column:
    t = i["loading_time"]
    return F.least(F.lit(100.0), _add(i["https"], 30) + F.when((t > 0) & (t < 2), 40.0).when((t >= 2) & (t < 3), 20.0).otherwise(0.0) + _add((F.size(i["micros"]) > 0) | (i["microdata_advanced_score"] > 0), 30))


GEO_CLASSES = ("highly_geo_optimized", "probably_geo_optimized", "probably_not_geo_optimized", "poorly_geo_optimized")


def geo_score(i: Column, excluded: Column | None = None) -> Column:
    """As ``seo_score``; a page that is excluded or loads in over 10 seconds has 0."""
    sub = {"structure_formatting": geo_structure(i), "authority_trust": geo_authority(i), "semantics_readability": geo_semantics(i), "technical_baseline": geo_technical(i)}
    total = F.bround(sub["structure_formatting"] * 0.2 + sub["authority_trust"] * 0.4 + sub["semantics_readability"] * 0.3 + sub["technical_baseline"] * 0.1, 2)
    stop = (i["loading_time"] > 10) | (excluded if excluded is not None else F.lit(False))
    why = F.concat_ws(". ", F.array_compact(F.array(F.when(stop, "Notice: excluded or too slow"), F.when(i["tables"] == 0, "No tables"), F.when(i["ul_lists"] + i["ol_lists"] == 0, "No lists"), F.when(i["schema_faq_present"] + i["semantic_qa_count"] == 0, "No questions and answers"), F.when(i["author_tags"] == 0, "No author"))))
    return F.struct(*[v.alias(k) for k, v in sub.items()], F.when(stop, 0.0).otherwise(total).alias("total_score"), F.when(stop, GEO_CLASSES[3]).otherwise(class_of(total, GEO_CLASSES)).alias("classification"), why.alias("explanation"))


def query_terms_found(p: Column, query: Column) -> Column:
    return H.keyword_hits(p, terms(query))
