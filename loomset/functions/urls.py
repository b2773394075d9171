"""Addresses as column expressions: host, path, extension, media kind, labels and filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What stands in an address for each label, and extensions of each media kind.
URL_WORDS = {
    "news": ["/news/", "/article/", "/post/", "/blog/"],
    "product": ["/product/", "/item/", "/shop/", "/buy/"],
    "video": ["/video/", "/watch/", "youtube.com", "vimeo.com"],
    "image": ["/image/", "/photo/", "/gallery/", "imgur.com", "flickr.com"],
    "social": ["twitter.com", "facebook.com", "instagram.com", "linkedin.com"],
    "forum": ["/forum/", "/discussion/", "reddit.com", "/thread/"],
    "documentation": ["/docs/", "/documentation/", "/api/", "/reference/"],
}
EXTENSIONS = {
    "image": ["jpg", "jpeg", "png", "gif", "webp", "bmp", "svg"],
    "audio": ["mp3", "wav", "ogg", "flac", "m4a", "aac"],
    "video": ["mp4", "webm", "avi", "mov", "mkv"],
}


def host(url: Column) -> Column:
    """What stands between the scheme and the path, port and user included; the whole where there is no scheme."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.when(found != "", found).otherwise(url)


def path(url: Column) -> Column:
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(found == "", "/").otherwise(found)


def extension(url: Column) -> Column:
    return F.lower(F.regexp_extract(path(url), r"\.([A-Za-z0-9]+)$", 1))


def media_kind(ext: Column) -> Column:
    out = F.when(ext == "", "file")
    for kind, known in EXTENSIONS.items():
        out = out.when(ext.isin(known), kind)
    return out.otherwise("file")


def labels(url: Column) -> Column:
    """Names of the classes one of whose words stands in the address, in the order of URL_WORDS."""
    low = F.lower(url)
    found = []
    for name, terms in URL_WORDS.items():
        holds = low.contains(terms[0])
        for t in terms[1:]:
            holds = holds | low.contains(t)
        found.append(F.when(holds, F.lit(name)))
    return F.array_compact(F.array(*found))


def wanted(url: Column, include: list[str], exclude: list[str]) -> Column:
    """Any of the patterns to include (if there are any), and none of those to exclude."""
    keep = F.lit(not include)
    for p in include:
        keep = keep | url.rlike(p)
    for p in exclude:
        keep = keep & ~url.rlike(p)
    return F.coalesce(keep, F.lit(False))


def _undotted(place: Column) -> Column:
    """A path without its . and .. segments; query and fragment stay."""
    found = F.regexp_extract(place, r"^([^?#]*)", 1)
    parts = F.slice(F.split(found, "/"), 2, F.greatest(F.size(F.split(found, "/")) - 1, F.lit(1)))
    up = lambda done: F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda done, x: F.when(x == "..", up(done)).when(x == ".", done).otherwise(F.concat(done, F.array(x))))
    ends = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    plain = F.concat(F.lit("/"), F.array_join(ends, "/"))
    return F.when(found.rlike(r"/\.\.?(/|$)"), F.concat(plain, F.substring(place, F.length(found) + 1, F.length(place)))).otherwise(place)


def resolved(link: Column, base: Column) -> Column:
    """A link of a page as a whole address, as urljoin gives it: relative to the folder, dot segments taken out."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)//", 1)
    folder = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/(?:[^?#]*/)?)", 1)
    whole = F.regexp_extract(base, r"^([^?#]*)", 1)
    joined = F.concat(F.when(folder == "", "/").otherwise(folder), link)
    return (
        F.when(link.startswith("//"), F.concat(scheme, link))
        .when((root == "") | link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("?"), F.concat(whole, link))
        .otherwise(F.concat(root, _undotted(F.when(link.startswith("/"), link).otherwise(joined))))
    )
