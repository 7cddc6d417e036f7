"""URLs and hashes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Parameters that track visitors or sessions.
TRACKING = r"(?i)^(?:utm_.*|fbclid|gclid|mc_.*|sessionid|jsessionid|phpsessid|aspxauth)$"


def canonical_url(url: Column) -> Column:
    """https, host without www, no tracking parameters or fragment, sorted parameters, no single trailing slash."""
    u = F.trim(url)
    host = F.regexp_replace(F.lower(F.regexp_extract(u, r"^(?i:https?)://([^/?#]+)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(u, r"^[^?#]*?://[^/?#]+([^?#]*)", 1), r"(?<=.)/$", "")
    path = F.when(path == "/", "").otherwise(path)
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).rlike(TRACKING))
    query = F.array_join(F.array_sort(kept), "&")
    whole = F.concat(F.lit("https://"), host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(host == "", F.lower(u)).otherwise(whole)


def storage_url(url: Column) -> Column:
    """Without fragment and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "/+$", "")


def url_key(source: Column, url: Column) -> Column:
    return F.concat_ws(":", source, F.sha2(canonical_url(url), 256))


def page_key(url: Column, page: Column) -> Column:
    return F.concat(url, F.when(url.contains("?"), "&").otherwise("?"), F.lit("_pagina="), page.cast("string"))


def resolve(base: Column, href: Column) -> Column:
    """An absolute url for a link, or null where it leads nowhere or to another host."""
    origin = F.regexp_extract(base, r"^([a-zA-Z]+://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"^([a-zA-Z]+://[^?#]*/)", 1)
    folder = F.when(folder.rlike(r"^[a-zA-Z]+://$"), F.concat(origin, F.lit("/"))).otherwise(folder)
    absolute = F.when(href.rlike(r"^(?i)https?://"), href).when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/"), F.concat(origin, href)).otherwise(F.concat(folder, href))
    name = lambda u: F.regexp_replace(F.lower(F.regexp_extract(u, r"^[a-zA-Z]+://([^/?#:]+)", 1)), r"^www\.", "")
    useless = href.isNull() | href.rlike(r"(?i)^\s*(?:javascript|mailto|tel):") | href.rlike(r"^\s*(?:#.*)?$")
    return F.when(~useless & (name(absolute) == name(base)), absolute)


def classify(content_type: Column, url: Column) -> Column:
    """pdf, folha, zip, csv, json or html, by the content type and else the path's ending."""
    kind, path = F.lower(F.coalesce(content_type, F.lit(""))), F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^([^?#]*)", 1))
    return (
        F.when(kind.contains("pdf") | path.endswith(".pdf"), "pdf")
        .when(kind.contains("spreadsheet") | kind.contains("ms-excel") | path.rlike(r"\.xlsx?$"), "folha")
        .when(kind.contains("zip") | path.endswith(".zip"), "zip")
        .when(kind.contains("csv") | path.endswith(".csv"), "csv")
        .when(kind.contains("json") | path.endswith(".json"), "json")
        .otherwise("html")
    )


def host_name(host: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(host)), r":\d+$", "")


def fingerprint(fund: Column, kind: Column, definer: Column) -> Column:
    """The idempotency key of an event: one canonical form, fields joined by single spaces."""
    return F.sha2(F.concat_ws(" ", fund.cast("string"), kind, definer), 256)


def cassette_key(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def canonical_json(s: Column) -> Column:
    """JSON with the keys of every object sorted and no spaces; null where the text is no JSON."""
    return F.to_json(F.try_parse_json(s))


def capture_name(url: Column, ending: Column) -> Column:
    """A file name for a captured page: the last part of its path, at most 48 safe characters, and 10 of the url's hash."""
    part = F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+(?:[^?#]*/)?([^/?#]*)", 1), r"\.[^.]*$", "")
    safe = F.substring(F.regexp_replace(part, "[^a-zA-Z0-9-]", "-"), 1, 48)
    return F.concat(F.when(safe == "", "pagina").otherwise(safe), F.lit("-"), F.substring(F.sha2(url, 256), 1, 10), ending)
