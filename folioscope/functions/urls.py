"""URL identity as column expressions: normal forms, publishers' canonical forms, slugs and short ids.

As the URL standard reads them: schemes and hosts in lower case, default ports and fragments gone, dot segments
resolved, backslashes as slashes, what a component can't hold percent-encoded. Then tracking parameters go; where one
was removed, the rest is written as form data. International host names stay as they were written.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameters that tell how a reader came, not what was read; and all that begin with utm_.
TRACKING = ("fbclid", "gclid", "ref", "source", "from", "si", "spm", "scm", "igshid", "mc_cid", "mc_eid", "wfr", "isappinstalled")
#: Hosts of one archive of papers, and the first path segments that address a paper there.
ARXIV_HOSTS = ("arxiv.org", "www.arxiv.org", "export.arxiv.org", "browse.arxiv.org", "ar5iv.org", "www.ar5iv.org", "ar5iv.labs.arxiv.org")
ARXIV_ROUTES = ("abs", "pdf", "html", "format", "ps", "src", "e-print")
#: Endings of Markdown files.
MARKDOWN_ENDINGS = (".md", ".markdown", ".mdown", ".mkd")
SLUG_LENGTH, HASH_LENGTH = 60, 8


def let(value: Column, then) -> Column:
    """then(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _either(words: tuple[str, ...]) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


_SCHEME = r"^\s*([A-Za-z][A-Za-z0-9+.-]*:)[/\\]{2,}"
_AUTHORITY = _SCHEME + r"([^/?#\\]*)"
#: What a path and a query can't hold as it is, beside what isn't ASCII.
PATH_SET, QUERY_SET = r"[\x00-\x20\"#<>?`{}\x7F]|[^\x00-\x7F]", r"[\x00-\x20\"#<>'\x7F]|[^\x00-\x7F]"
_HERE, _UP = r"(?i)^(?:\.|%2e)$", r"(?i)^(?:\.|%2e){2}$"


def encoded(text: Column, held_out: str) -> Column:
    """The text with each character of a set as the bytes of its UTF-8, %XX."""
    one = lambda c: F.when(c.rlike(held_out), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")).otherwise(c)
    return F.when(text.rlike(held_out), F.array_join(F.transform(F.split(text, ""), one), "")).otherwise(text)


def without_dots(path: Column) -> Column:
    """The path with its segments folded: . stays in place, .. takes the segment before it, if any."""
    segments = F.slice(F.split(path, "/"), F.lit(2), F.lit(1 << 20))

    def add(kept: Column, segment: Column) -> Column:
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(segment.rlike(_UP), up).when(segment.rlike(_HERE), kept).otherwise(F.concat(kept, F.array(segment)))

    # A dot segment at the end leaves a slash there.
    last = F.element_at(segments, -1)
    walked = F.aggregate(segments, F.array().cast("array<string>"), add)
    folded = F.concat(F.lit("/"), F.array_join(F.when(last.rlike(_UP) | last.rlike(_HERE), F.concat(walked, F.array(F.lit("")))).otherwise(walked), "/"))
    return F.when(path.rlike(r"(?i)/(?:\.|%2e){1,2}(?:/|$)"), folded).otherwise(path)


def origin(url: Column) -> Column:
    """Scheme and host in lower case, who signs in as written, without a default port."""
    scheme, authority = F.lower(F.regexp_extract(url, _SCHEME, 1)), F.regexp_extract(url, _AUTHORITY, 2)
    user, host = F.regexp_extract(authority, "^(.*@)?", 1), F.lower(F.regexp_replace(authority, "^.*@", ""))
    bare = F.when(scheme == "https:", F.regexp_replace(host, ":(?:443)?$", "")).when(scheme == "http:", F.regexp_replace(host, ":(?:80)?$", "")).otherwise(host)
    return F.when((scheme == "") | (host == ""), "").otherwise(F.concat(scheme, F.lit("//"), user, bare))


def path(url: Column) -> Column:
    """The path as it is read, without slashes at its end, '/' at least."""
    written = F.regexp_replace(F.regexp_extract(url, _AUTHORITY + r"([^?#]*)", 3), r"\\", "/")
    found = F.regexp_replace(without_dots(encoded(written, PATH_SET)), "/+$", "")
    return F.when(found == "", F.lit("/")).otherwise(found)


def _query(url: Column) -> Column:
    whole = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    written = F.filter(F.split(whole, "&"), lambda p: p != "")
    decoded = lambda t: F.coalesce(F.try_url_decode(t), t)
    kept = F.filter(written, lambda p: ~decoded(F.regexp_extract(p, "^([^=]*)", 1)).rlike(rf"^(?:utm_.*|{_either(TRACKING)})$"))
    form = F.array_join(F.transform(kept, lambda p: F.concat(F.url_encode(decoded(F.regexp_extract(p, "^([^=]*)", 1))), F.lit("="), F.url_encode(decoded(F.regexp_replace(p, "^[^=]*=?", ""))))), "&")
    text = F.when(F.size(kept) == F.size(written), encoded(whole, QUERY_SET)).otherwise(form)
    return F.when(text == "", F.lit("")).otherwise(F.concat(F.lit("?"), text))


def arxiv(url: Column) -> Column:
    """struct<id, version> of a paper's URL, else null; ids before 2007 lose their subject class."""
    new = rf"(?i)^https?://(?:{_either(ARXIV_HOSTS)})(?::\d+)?/+(?:{_either(ARXIV_ROUTES)})/+(\d{{4}}\.\d{{4,5}})(?:v(\d+))?(?:\.pdf)?/*(?:[?#].*)?$"
    old = rf"(?i)^https?://(?:{_either(ARXIV_HOSTS)})(?::\d+)?/+(?:{_either(ARXIV_ROUTES)})/+([a-z][a-z-]*)(?:\.[a-z][a-z-]*)?/+(\d{{7}})(?:v(\d+))?(?:\.pdf)?/*(?:[?#].*)?$"
    part = lambda pattern, n: F.nullif(F.regexp_extract(url, pattern, n), F.lit(""))
    id = F.coalesce(part(new, 1), F.concat(F.lower(part(old, 1)), F.lit("/"), part(old, 2)))
    return F.when(id.isNotNull(), F.struct(id.alias("id"), F.coalesce(part(new, 2), part(old, 3)).cast("int").alias("version")))


def github_document(url: Column) -> Column:
    """struct<owner, repo, tail> of a Markdown file's URL on the page or raw host, else null."""
    name, rest = r"((?!\.{1,2}/)[A-Za-z0-9._-]+)", r"(?:refs/+(?:heads|tags)/+)?([^/?#]+/+[^?#]*)"
    end = rf"(?i:{_either(MARKDOWN_ENDINGS)})"
    page = rf"^(?i:https?://(?:www\.)?github\.com)/+{name}/+{name}/+(?i:blob|raw)/+(?i:refs/+(?:heads|tags)/+)?([^/?#]+/+[^?#]*{end})/*(?:[?#].*)?$"
    raw = rf"^(?i:https?://raw\.githubusercontent\.com)/+{name}/+{name}/+(?i:refs/+(?:heads|tags)/+)?([^/?#]+/+[^?#]*{end})/*(?:[?#].*)?$"
    part = lambda n: F.coalesce(*[F.nullif(F.regexp_extract(url, p, n), F.lit("")) for p in (page, raw)])
    tail = F.regexp_replace(part(3), "/+", "/")
    return F.when(tail.isNotNull(), F.struct(F.lower(part(1)).alias("owner"), F.lower(part(2)).alias("repo"), tail.alias("tail")))


def canonical(url: Column) -> Column:
    paper = F.concat(F.lit("https://arxiv.org/abs/"), arxiv(url)["id"])
    blob = let(github_document(url), lambda d: F.concat(F.lit("https://github.com/"), d["owner"], F.lit("/"), d["repo"], F.lit("/blob/"), d["tail"]))
    return F.coalesce(paper, blob, url)


def normalize(url: Column) -> Column:
    """One text for all URLs of a page; null for what is no URL with a host."""
    plain = F.concat(F.nullif(origin(url), F.lit("")), path(url), _query(url))
    return let(plain, canonical)


def source_of(url: Column) -> Column:
    """Where a body was read, without query and fragment, if a publisher's rule files it elsewhere; else null."""
    bare = F.regexp_extract(url, _AUTHORITY + r"([^?#]*)", 3)
    plain = F.concat(F.nullif(origin(url), F.lit("")), F.coalesce(F.nullif(without_dots(encoded(bare, PATH_SET)), F.lit("")), F.lit("/")))
    return let(plain, lambda u: F.when(canonical(u) != u, u))


def site_href(*candidates: Column) -> Column:
    """The first of some addresses that is an http(s) URL with a host; only such may be linked."""
    return F.coalesce(*[F.when(c.rlike(r"(?i)^\s*https?:[/\\]*[^/\\?#\s]"), F.trim(c)) for c in candidates])


def slug(url: Column) -> Column:
    """Host and path in ASCII, at most 60 long, and 8 hex digits of the normal form's SHA-256."""
    return let(normalize(url), _slug_of)


def _slug_of(normal: Column) -> Column:
    readable = F.concat(F.regexp_replace(F.regexp_extract(normal, "^[a-z][a-z0-9+.-]*://([^/?#:]*)", 1), r"^www\.", ""), F.coalesce(F.try_url_decode(F.regexp_replace(path(normal), r"\+", "%2B")), path(normal)))
    folded = F.regexp_replace(F.regexp_replace(F.lower(readable), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    base = F.coalesce(F.nullif(F.regexp_replace(F.substring(folded, 1, SLUG_LENGTH), "-+$", ""), F.lit("")), F.lit("article"))
    return F.concat(base, F.lit("-"), F.substring(F.sha2(normal, 256), 1, HASH_LENGTH))


def short_id(slug: Column) -> Column:
    return F.nullif(F.regexp_extract(slug, "-([0-9a-f]{8})$", 1), F.lit(""))


def source_label(url: Column, domain: Column) -> Column:
    """A local document's file name, else the domain."""
    return F.when(url.startswith("local:"), F.coalesce(F.try_url_decode(F.substring(url, 7, 1 << 20)), F.substring(url, 7, 1 << 20))).otherwise(domain)


def private_ipv4(host: Column) -> Column:
    """Whether a dotted address is in a range that isn't public."""
    ranges = r"^(?:0|10|127)\.|^169\.254\.|^172\.(?:1[6-9]|2[0-9]|3[01])\.|^192\.168\.|^192\.0\.[02]\.|^100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|^198\.(?:1[89]|51\.100)\.|^203\.0\.113\.|^(?:22[4-9]|2[34][0-9]|25[0-5])\."
    return host.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$") & host.rlike(ranges)


def private_ipv6(host: Column) -> Column:
    """Whether an IPv6 address, with or without brackets, isn't public: loopback, local, multicast, documentation, or a
    private IPv4 address inside it."""
    bare = F.lower(F.regexp_replace(host, r"^\[|\]$|%.*$", ""))
    inner = F.regexp_extract(bare, r"^(?:::ffff:|64:ff9b::)(\d{1,3}(?:\.\d{1,3}){3})$", 1)
    ranges = r"^(?:::1?$|(?:0{1,4}:){7}0{0,3}[01]$|f[cd][0-9a-f]{2}:|fe[89abcdef][0-9a-f]:|ff[0-9a-f]{2}:|2001:0?db8:|100::)"
    return bare.contains(":") & (bare.rlike(ranges) | private_ipv4(inner))


def same_page(a: Column, b: Column) -> Column:
    """Whether two URLs have one normal form."""
    return F.coalesce(normalize(a) == normalize(b), F.lit(False))


def file_stem(url: Column) -> Column:
    """The last segment of a path without its extension; '' where there is none."""
    last = F.regexp_extract(F.regexp_replace(url, "[?#].*$", ""), "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*/(?:.*/)?([^/]+)/*$", 1)
    plain = F.coalesce(F.try_url_decode(F.regexp_replace(last, r"\+", "%2B")), last)
    return F.regexp_replace(plain, r"(?<=.)\.[A-Za-z0-9]{1,8}$", "")


def placeholder_title(title: Column, url: Column) -> Column:
    """Whether a title is none of its own: empty, the host, or the file's name."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1)), r"^www\.", "")
    own = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    return (own == "") | (F.regexp_replace(own, r"^www\.", "") == host) | ((own == F.lower(file_stem(url))) & (own != ""))
