"""URL functions: pure column expressions that never fail on odd input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that only track a visit (fixed values).
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "dclid", "fbclid", "_hsenc", "_hsmi", "mkt_tok", "msclkid", "mc_cid", "mc_eid", "trk", "onwewe", "srsltid")

#: scheme, authority, path, query, fragment
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, _PARTS, i)


def host(url: Column) -> Column:
    """Authority in lower case, port included; empty if there is none."""
    return F.lower(_part(url, 2))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def is_valid(url: Column) -> Column:
    return F.coalesce((scheme(url) != "") & (host(url) != ""), F.lit(False))


def normalised(url: Column, tracking: tuple[str, ...] = TRACKING) -> Column:
    """https, lower-case host without ``www.``, no tracking keys, no single slash at the end; the
    fragment stays.  Values of one key stand together at its first place, encoded anew; blank ones
    stay.  Null and blank text is empty."""
    plain = lambda x: F.coalesce(F.try_url_decode(x), x)
    coded = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    parts = F.transform(F.filter(F.split(_part(url, 4), "&"), lambda p: p != ""), lambda p: F.struct(plain(F.split_part(p, F.lit("="), F.lit(1))).alias("k"), plain(F.regexp_replace(p, "^[^=]*=?", "")).alias("v")))
    kept = F.filter(parts, lambda p: ~F.lower(p["k"]).isin(*tracking))
    keys = F.transform(kept, lambda p: p["k"])
    placed = F.array_sort(F.transform(kept, lambda p, i: F.struct(F.array_position(keys, p["k"]).alias("first"), i.alias("i"), F.concat(coded(p["k"]), F.lit("="), coded(p["v"])).alias("text"))))
    query = F.array_join(F.transform(placed, lambda p: p["text"]), "&")
    path = _part(url, 3)
    path = F.when((path != "/") & path.endswith("/"), F.regexp_replace(path, "/$", "")).otherwise(path)
    frag = _part(url, 5)
    out = F.concat(F.lit("https://"), bare_host(url), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), F.when(frag != "", F.concat(F.lit("#"), frag)).otherwise(""))
    return F.when(F.trim(url) != "", out).otherwise("")


def main_domain(url: Column) -> Column:
    """``scheme://host/`` or empty."""
    return F.when(is_valid(url), F.concat(scheme(url), F.lit("://"), _part(url, 2), F.lit("/"))).otherwise("")


def result_main(url: Column) -> Column:
    """As ``main_domain``, else the URL itself."""
    m = main_domain(url)
    return F.when(m != "", m).otherwise(url)


def filter_host(text: Column) -> Column:
    """What a URL filter means: the lower-case host of a URL that may lack its scheme."""
    t = F.trim(text)
    return bare_host(F.when(t.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), t).otherwise(F.concat(F.lit("http://"), t)))


def url_length(url: Column) -> Column:
    """Characters without ``www.`` and scheme, as text."""
    return F.length(F.regexp_replace(F.replace(url, F.lit("www."), F.lit("")), r"^[a-zA-Z]+://", "")).cast("string")


def is_https(url: Column) -> Column:
    return F.lower(url).startswith("https://")


def is_page(url: Column, content_type: Column) -> Column:
    """HTML by its type, and no PDF by its name."""
    return F.contains(F.lower(content_type), F.lit("html")) & ~F.lower(url).rlike(r"\.pdf|\?pdf")


def terms_at_delimiters(words: Column, url: Column) -> Column:
    """How many words stand in the URL between delimiters."""
    parts = F.split(F.lower(url), r"[^\p{L}\p{N}]+")
    return F.size(F.filter(words, lambda w: F.array_contains(parts, w)))


def clean_key(url: Column) -> Column:
    """Bare host and path without a slash at the end; a video keeps its id."""
    video = F.regexp_extract(url, r"[?&]v=([^&#]+)", 1)
    key = F.concat(bare_host(url), F.regexp_replace(_part(url, 3), "/$", ""))
    return F.when(F.contains(bare_host(url), F.lit("youtube.")) & (video != ""), F.concat(key, F.lit("?v="), video)).otherwise(key)


def decoded_redirect(url: Column) -> Column:
    """The target of a redirect whose ``u`` parameter is ``a1`` and URL-safe base64, else the URL."""
    raw = F.translate(F.regexp_extract(url, r"[?&]u=a1([A-Za-z0-9_-]+)", 1), "-_", "+/")
    padded = F.rpad(raw, F.length(raw) + F.pmod(-F.length(raw), F.lit(4)), "=")
    return F.when(raw != "", F.coalesce(F.try_to_binary(padded, F.lit("base64")).cast("string"), url)).otherwise(url)


def unwrapped_ad(url: Column) -> Column:
    """The target inside an advertisement's address."""
    target = F.regexp_extract(url, r"[?&]adurl=([^&#]+)", 1)
    return F.when(target != "", F.try_url_decode(target)).otherwise(url)


def image_target(url: Column) -> Column:
    """The image or page inside an image result's address."""
    one = F.regexp_extract(url, r"[?&]imgurl=([^&#]+)", 1)
    two = F.regexp_extract(url, r"[?&]imgrefurl=([^&#]+)", 1)
    return F.coalesce(F.try_url_decode(F.nullif(one, F.lit(""))), F.try_url_decode(F.nullif(two, F.lit(""))), url)


def is_source(url: Column, blocked: tuple[str, ...] = ("google.", "gstatic.", "googleusercontent.", "bing.com", "microsoft.com")) -> Column:
    """A web address that isn't an engine's own."""
    return F.coalesce(url.rlike("^https?://") & ~bare_host(url).rlike("|".join(b.replace(".", r"\.") for b in blocked)), F.lit(False))


def search_url(base: str, query: Column, country: Column, lang: Column, page: Column) -> Column:
    """The address of a result page with its locale."""
    return F.concat(F.lit(f"{base}?q="), F.url_encode(query), F.lit("&gl="), F.lower(country), F.lit("&hl="), F.lower(lang), F.lit("&start="), ((page - 1) * 10).cast("string"))
