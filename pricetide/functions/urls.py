"""URLs, hosts and content hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricetide.functions.text import Text, _col


def host(url: Text) -> Column:
    return F.lower(F.try_parse_url(_col(url), F.lit("HOST")))


def host_label(url: Text) -> Column:
    """Host without a leading www."""
    return F.regexp_replace(host(url), r"^www\.", "")


def web_ref(kind: Text, ref: Text) -> Column:
    """The reference of a web signal if it is an http(s) URL."""
    protocol = F.lower(F.try_parse_url(_col(ref), F.lit("PROTOCOL")))
    return F.when((_col(kind) == "web") & protocol.isin("http", "https"), _col(ref))


def normalize_host(value: Text) -> Column:
    """Lower-case host of a URL or of a bare host, without scheme, www., path or port."""
    bare = F.regexp_replace(F.lower(F.trim(_col(value))), r"^[a-z]+://", "")
    return F.regexp_replace(F.regexp_extract(bare, r"^([^/:?#]*)", 1), r"^www\.", "")


def suffixes(host_name: Text) -> Column:
    """A host and its parent domains, so that membership in a list of domains is an equality."""
    parts = F.split(_col(host_name), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def allowed(url: Text, domains: Column) -> Column:
    """Whether a URL's host is one of the domains or below one; an empty list allows all."""
    return (F.size(domains) == 0) | F.coalesce(F.arrays_overlap(suffixes(host(url)), domains), F.lit(False))


def canonical_url(url: Text) -> Column:
    """Without fragment, host in lower case, query parameters sorted, trailing slashes of the path dropped."""
    u = _col(url)
    scheme, rest = F.lower(F.regexp_extract(u, r"^([A-Za-z]+)://", 1)), F.regexp_extract(u, r"^[A-Za-z]+://([^#]*)", 1)
    authority, path, query = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), F.regexp_extract(rest, r"\?(.*)$", 1)
    ordered = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: p != "")), "&")
    short = F.regexp_replace(path, "/+$", "")
    full = F.concat(scheme, F.lit("://"), authority, F.when(short == "", "/").otherwise(short), F.when(ordered != "", F.concat(F.lit("?"), ordered)).otherwise(""))
    return F.when(u.rlike(r"^[A-Za-z]+://"), F.when(short == "", F.regexp_replace(full, r"/($|\?)", "$1")).otherwise(full))


def sha256(text: Text) -> Column:
    return F.sha2(_col(text), 256)


def content_hash(text: Text, attachments: Column | None = None) -> Column:
    """Hash of the trimmed text and a key:url line for each attachment."""
    lines = F.transform(attachments, lambda a: F.concat(a["key"], F.lit(":"), a["url"])) if attachments is not None else F.array().cast("array<string>")
    return F.sha2(F.array_join(F.concat(F.array(F.trim(_col(text))), lines), "\n"), 256)


def signal_ref(kind: Text, ref: Text, page_url: Text, content: Text) -> Column:
    """A web signal's own URL, else the page's with part of the content hash; others keep their reference."""
    made = F.concat(_col(page_url), F.lit("#item="), F.substring(sha256(content), 1, 12))
    return F.when(_col(kind) != "web", _col(ref)).when(_col(ref).rlike("(?i)^https?://"), _col(ref)).otherwise(F.coalesce(made, _col(ref)))
