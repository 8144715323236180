"""URL functions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import _c

# Query parameters that never identify a product.
TRACKING_PARAMS = [
    "gad_source", "gad_campaignid", "gbraid", "gclid", "fbclid", "utm_source", "utm_medium",
    "utm_campaign", "utm_term", "utm_content", "_ga", "_gl", "yclid", "msclkid", "mc_cid", "mc_eid",
]
# Parameters of listing and filter pages.
LISTING_PARAMS = [
    "prefn1", "prefv1", "prefn2", "prefv2", "prefn3", "prefv3", "start", "sz", "insertMode",
    "page", "p", "sort",
]
_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def url_origin(col: Column | str) -> Column:
    c = _c(col)
    host = F.regexp_extract(c, _PARTS, 2)
    return F.when(host != "", F.concat(F.lower(F.regexp_extract(c, _PARTS, 1)), F.lit("://"), host))


def url_host(col: Column | str) -> Column:
    """Lower-case host without user and port."""
    netloc = F.regexp_extract(_c(col), _PARTS, 2)
    return F.lower(F.regexp_replace(F.regexp_replace(netloc, r"^.*@", ""), r":\d+$", ""))


def has_url(col: Column | str) -> Column:
    return F.coalesce(F.regexp_extract(F.trim(_c(col)), _PARTS, 2) != "", F.lit(False))


def host_allowed(col: Column | str, domains: list[str] | Column) -> Column:
    """The host equals one of the domains or sits below it."""
    allowed = F.array(*[F.lit(d) for d in domains]) if isinstance(domains, list) else domains
    host = url_host(col)
    return F.exists(allowed, lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d)))


def canonical_url(col: Column | str) -> Column:
    """Drop the fragment, tracking and listing parameters and blank ones; null without scheme or host.

    Variant parameters stay: they name separate stock units.
    """
    c = _c(col)
    netloc = F.regexp_extract(c, _PARTS, 2)
    drop = F.array(*[F.lit(p) for p in TRACKING_PARAMS + LISTING_PARAMS])
    pairs = F.filter(
        F.split(F.regexp_extract(c, _PARTS, 4), "&"),
        lambda kv: kv.rlike("^[^=]*=.+") & ~F.array_contains(drop, F.substring_index(kv, "=", 1)),
    )
    recoded = F.transform(
        pairs,
        lambda kv: F.concat(
            F.url_encode(F.try_url_decode(F.substring_index(kv, "=", 1))), F.lit("="),
            F.url_encode(F.try_url_decode(F.regexp_replace(kv, "^[^=]*=", ""))),
        ),
    )
    base = F.concat(
        F.lower(F.regexp_extract(c, _PARTS, 1)), F.lit("://"), netloc, F.regexp_extract(c, _PARTS, 3)
    )
    query = F.array_join(recoded, "&")
    return F.when(netloc != "", F.concat(base, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def fold_dots(path: Column) -> Column:
    """Path without ``.`` and ``..`` segments."""
    parts = F.split(path, "/", -1)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == ".", acc).when(
        x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.array_append(acc, x)))
    closed = F.when(F.element_at(parts, -1).isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.array_join(closed, "/")).otherwise(path)


def resolve_url(base: Column | str, reference: Column | str) -> Column:
    """A reference resolved against a page's address by RFC 3986, section 5.2; null where the base has no host."""
    b, r = _c(base), F.trim(_c(reference))
    origin, path, query = url_origin(b), F.regexp_extract(b, _PARTS, 3), F.regexp_extract(b, r"(\?[^#]*)", 1)
    own = F.regexp_extract(r, r"^([^?#]*)", 1)
    rest = F.substring(r, F.length(own) + 1, F.length(r))
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, "[^/]*$", ""))
    return (
        F.when(r.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), r)
        .when(F.startswith(r, F.lit("//")), F.concat(F.regexp_extract(b, _PARTS, 1), F.lit(":"), r))
        .when(own == "", F.concat(origin, path, F.when(F.startswith(rest, F.lit("?")), rest).otherwise(F.concat(query, rest))))
        .when(F.startswith(own, F.lit("/")), F.concat(origin, fold_dots(own), rest))
        .otherwise(F.concat(origin, fold_dots(F.concat(folder, own)), rest)))


def url_path(col: Column | str) -> Column:
    return F.regexp_extract(_c(col), _PARTS, 3)


def norm_root(col: Column | str) -> Column:
    """Key of a brand's root URL: no scheme, no ``www.``, no closing slash."""
    s = F.regexp_replace(F.lower(F.trim(_c(col))), r"^https?://", "")
    return F.regexp_replace(F.regexp_replace(s, r"^www\.", ""), r"/+$", "")
