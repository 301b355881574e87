"""Addresses taken apart by patterns: Spark's own parser refuses raw CJK and spaces."""

from __future__ import annotations

from collections.abc import Iterable
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import clean_title, looks_opaque, percent_decoded

# File endings that are downloads or never are, tracking keys, and path words that name no file.
DOWNLOADS = ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "zip", "rar", "7z", "rtf", "csv")
NO_DOWNLOADS = ("jpg", "jpeg", "png", "gif", "webp", "svg", "bmp", "mp4", "mp3", "mov", "avi", "webm")
TRACKING = ("v", "t", "ver", "timestamp", "authuser", "usp", "fbclid", "_", "nocache", "rand", "random")
NO_FILE = ("view", "preview", "edit", "open", "share", "download", "viewform", "file", "d", "uc", "index", "default", "detail", "details", "document", "documents", "spreadsheets", "presentation", "forms", "drive", "folder", "folders", "e", "u", "a", "usp", "sharing", "copy", "template")
DRIVE = "drive.google.com"

WHOLE = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, n: int) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), WHOLE, n)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def netloc(url: Column) -> Column:
    return part(url, 2)


def host(url: Column) -> Column:
    """Lower-case host without user or port."""
    return F.lower(F.regexp_replace(F.regexp_replace(netloc(url), "^.*@", ""), r":\d+$", ""))


def path(url: Column) -> Column:
    return part(url, 3)


def query(url: Column) -> Column:
    return part(url, 4)


def parameter(url: Column, name: str) -> Column:
    """The first value of a query key; null if it isn't there."""
    pairs = F.filter(F.split(query(url), "&"), lambda p: F.substring_index(p, "=", 1) == name)
    return F.regexp_replace(F.get(pairs, F.lit(0)), "^[^=]*=?", "")


def extension(url: Column) -> Column:
    """What follows the path's last dot, with the dot and in lower case; '' without a dot."""
    p = F.lower(path(url))
    return F.when(p.contains("."), F.concat(F.lit("."), F.substring_index(p, ".", -1))).otherwise("")


def is_download(url: Column) -> Column:
    low = F.lower(F.coalesce(url, F.lit("")))
    ext, h, p = extension(low), netloc(low), path(low)
    drive = h.contains(DRIVE) & (p.contains("/file/d/") | p.contains("/uc") | low.contains("export=download"))
    box = h.contains("dropbox.com") & low.contains("dl=1")
    hint = low.contains("download=") | low.contains("/download/") | low.contains("attachment_id=")
    return F.when(low == "", False).when(ext.isin(*[f".{e}" for e in DOWNLOADS]), True).when(ext.isin(*[f".{e}" for e in NO_DOWNLOADS]), False).otherwise(drive | box | hint)


def collapse_double_pdf(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"(?i)(\.pdf){2,}(?=[?#]|$)", ".pdf")


def known_double_pdf(url: Column, hosts: Iterable[str], prefix: str = "/circular/") -> Column:
    """Collapsed only at hosts where the doubled ending is known to be a slip."""
    return F.when(host(url).isin(*hosts) & F.lower(path(url)).startswith(prefix), collapse_double_pdf(url)).otherwise(F.coalesce(url, F.lit("")))


def drive_id(url: Column) -> Column:
    """The id of a file in the cloud drive, or null."""
    in_path = F.regexp_extract(path(url), r"/(?:file/)?d/([\w-]+)", 1)
    found = F.when(in_path != "", in_path).otherwise(parameter(url, "id"))
    return F.when(host(url).isin(DRIVE, "docs.google.com") & (found != ""), found)


def drive_direct(url: Column) -> Column:
    """The download address of a drive file; other addresses stay."""
    return F.coalesce(F.concat(F.lit(f"https://{DRIVE}/uc?export=download&id="), drive_id(url)), url)


def sanitize(url: Column, more: Iterable[str] = ()) -> Column:
    """Without fragment, tracking keys and ``utm_`` keys; a drive 'open' link in its standard form."""
    keys = [*TRACKING, *[k.removeprefix("?").split("=")[0] for k in more]]
    opened = (host(url) == DRIVE) & F.lower(path(url)).rlike("(^|/)open/?$") & parameter(url, "id").isNotNull()
    u = F.when(opened, F.concat(F.lit(f"https://{DRIVE}/file/d/"), parameter(url, "id"), F.lit("/view"))).otherwise(F.coalesce(url, F.lit("")))
    pairs = F.filter(F.split(query(u), "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*keys) & ~p.startswith("utm_"))
    kept = F.array_join(pairs, "&")
    start = F.regexp_extract(u, r"^([^?#]*)", 1)
    return F.regexp_replace(F.when(kept != "", F.concat(start, F.lit("?"), kept)).otherwise(start), "[?&]+$", "")


def canonical(url: Column) -> Column:
    """Host without www., path and query: mirrors of a document share it."""
    q = query(url)
    return F.concat(F.regexp_replace(host(url), r"^www\.", ""), path(url), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def without_slash(url: Column) -> Column:
    return F.rtrim(F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "/+$", ""))


@F.pandas_udf(T.StringType())
def joined(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([None if h is None else urljoin(b or "", h) for b, h in zip(base, href, strict=True)], dtype="object")


def resolve(base: Column, href: Column) -> Column:
    """An absolute address, or null for empty links, page marks and other schemes."""
    h = F.trim(href)
    skip = (h == "") | h.rlike("^(javascript:|mailto:|tel:|#)")
    return F.when(h.isNull() | skip, None).when(h.rlike("^https?://"), h).when(h.startswith("//"), F.concat(F.lit("https:"), h)).otherwise(joined(base, h))


def tail_title(url: Column) -> Column:
    """The last path piece that reads like a file name, as a title; null if none does."""
    pieces = F.filter(F.split(percent_decoded(path(url)), "/"), lambda s: (s != "") & ~F.lower(s).isin(*NO_FILE) & ~looks_opaque(s))
    name = F.regexp_replace(F.regexp_replace(F.try_element_at(pieces, F.lit(-1)), r"(?i)\.(pdf|docx?|xlsx?|pptx?|zip|rar|7z|rtf|csv)$", ""), "[_-]", " ")
    return F.when(name.isNotNull(), clean_title(name))


def is_placeholder(url: Column, template: Column) -> Column:
    """No download, and exactly the source's detail-page template with digits for ``{id}``."""
    quoted = F.regexp_replace(template, r"([.?+*()\[\]^$|\\])", r"\\$1")
    pattern = F.concat(F.lit("^"), F.regexp_replace(quoted, r"\{id\}", r"\\d+"), F.lit("$"))
    q = query(url)
    local = F.concat(path(url), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    candidate = F.when(F.lower(template).rlike("^https?://"), url).otherwise(local)
    return F.coalesce(template.contains("{id}") & ~is_download(url) & F.call_function("rlike", candidate, pattern), F.lit(False))


def is_article(url: Column, root: Column, text: Column, navigation: Iterable[str] = ("home", "login", "contact", "sitemap", "facebook")) -> Column:
    """A page of the same host that is no download, no picture, no navigation and not the root."""
    low = F.lower(F.coalesce(text, F.lit("")))
    nav = F.lit(False)
    for word in navigation:
        nav = nav | low.contains(word)
    same = F.lower(netloc(url)) == F.lower(netloc(root))
    return scheme(url).isin("http", "https") & same & ~is_download(url) & ~extension(url).isin(*[f".{e}" for e in NO_DOWNLOADS]) & ~nav & ~F.trim(path(url)).isin("", "/")


def is_enrichable(url: Column, hosts: Iterable[str] = ()) -> Column:
    p = F.lower(path(url))
    return p.endswith(".pdf") | query(url).rlike(r"(^|&)wpdmdl=\d+") | host(url).isin(*hosts) | (drive_id(url).isNotNull() & (host(url) == DRIVE))


def skip_reason(url: Column) -> Column:
    """Why an address is not read: its ending of at most five letters or digits, or a fixed label."""
    ext = F.regexp_extract(extension(url), r"^(\.[a-z0-9]{1,5})$", 1)
    return F.when(ext != "", ext).otherwise("no file ending")


def story_key(url: Column) -> Column:
    """Identity of an attachment: the drive id, or host, lower-case path and query."""
    q = query(url)
    plain = F.concat(F.regexp_replace(host(url), r"^www\.", ""), F.lower(path(url)), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    return F.coalesce(F.concat(F.lit("drive:"), drive_id(url)), plain)


def results_url(site: Column, ids: Column) -> Column:
    """The site's address with ``n`` replaced by a comma-joined list of ids."""
    kept = F.filter(F.split(query(site), "&"), lambda p: (p != "") & (F.substring_index(p, "=", 1) != "n"))
    start = F.regexp_extract(site, r"^([^?#]*)", 1)
    start = F.when(path(site) == "", F.concat(start, F.lit("/"))).otherwise(start)
    frag = part(site, 5)
    return F.concat(start, F.lit("?"), F.array_join(F.concat(kept, F.array(F.concat(F.lit("n="), F.array_join(ids, ",")))), "&"), F.when(frag != "", F.concat(F.lit("#"), frag)).otherwise(""))
