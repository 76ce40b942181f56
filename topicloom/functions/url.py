"""URL functions as Column expressions. Parts are taken by the generic-syntax pattern, so ports and user names stay.

Nulls give nulls unless a function says otherwise; nothing raises on a malformed URL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from topicloom import dims

#: Scheme, authority, path, query of a URL (the fragment is left out).
PATTERN = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(url: Column, group: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query; empty where there is none."""
    return F.regexp_extract(url, PATTERN, group)


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def authority(url: Column) -> Column:
    return F.lower(part(F.coalesce(url, F.lit("")), 2))


def domain(url: Column) -> Column:
    """Authority in lower case without a leading www.; empty for null."""
    return F.regexp_replace(authority(url), r"^www\.", "")


def domain_without_any_www(url: Column) -> Column:
    """Every ``www.`` goes, and before the case is folded, so ``WWW.`` stays."""
    return F.lower(F.replace(part(F.coalesce(url, F.lit("")), 2), F.lit("www."), F.lit("")))


def host_and_path(url: Column) -> Column:
    """For comparing sets of URLs: domain and path without trailing slashes."""
    whole = F.coalesce(url, F.lit(""))
    return F.regexp_replace(F.concat(domain(whole), part(whole, 3)), r"/+$", "")


def normalise(url: Column) -> Column:
    """Lower-case host without ``m.``, tracking keys dropped, query re-encoded in order, no fragment, no trailing slash.

    An empty URL stays empty. A pair whose escapes can't be decoded stays as it is.
    """
    whole = stripped(url)
    host = F.regexp_replace(F.lower(part(whole, 2)), r"^m\.", "")
    path = F.regexp_replace(part(whole, 3), r"/+$", "")
    path = F.when(path == "", "/").otherwise(path)
    scheme = F.lower(part(whole, 1))
    scheme = F.when(scheme == "", "https").otherwise(scheme)
    plain = lambda x: F.coalesce(F.try_url_decode(x), x)
    coded = lambda x: F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A"))
    split = lambda kv: F.struct(plain(F.substring_index(kv, "=", 1)).alias("k"), F.when(F.contains(kv, F.lit("=")), plain(F.regexp_replace(kv, "^[^=]*=", ""))).otherwise("").alias("v"))
    pairs = F.transform(F.filter(F.split(part(whole, 4), "&"), lambda kv: kv != ""), split)
    kept = F.filter(pairs, lambda p: ~p["k"].isin(dims.NORMALISE_DROPS))
    query = F.array_join(F.transform(kept, lambda p: F.concat(coded(p["k"]), F.lit("="), coded(p["v"]))), "&")
    built = F.concat(scheme, F.when(host != "", F.concat(F.lit("://"), host)).otherwise(F.lit(":")), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(url == "", url).otherwise(F.replace(built, F.lit("%7E"), F.lit("~")))


def canonical(url: Column) -> Column:
    """Comparable form: domain, path, kept query pairs in sorted order; no scheme. Empty for null."""
    whole = F.coalesce(url, F.lit(""))
    pairs = F.filter(F.split(part(whole, 4), "&"), lambda kv: (kv != "") & ~F.lower(F.substring_index(kv, "=", 1)).isin(dims.CANONICAL_DROPS))
    query = F.array_join(F.array_sort(pairs), "&")
    base = F.concat(domain(whole), F.regexp_replace(part(whole, 3), r"/+$", ""))
    return F.when(query != "", F.concat(base, F.lit("?"), query)).otherwise(base)


def merge_key(url_normalized: Column, url: Column, title: Column, source: Column) -> Column:
    """Key of an article when clusters are united: URL without query, else title and source; null where all are empty."""
    some = lambda c: F.nullif(c, F.lit(""))
    found = F.coalesce(some(url_normalized), some(url), F.lit(""))
    found = F.regexp_replace(F.substring_index(found, "?", 1), r"/+$", "")
    return F.coalesce(some(found), some(F.lower(F.concat(F.coalesce(title, F.lit("")), F.coalesce(source, F.lit(""))))))
