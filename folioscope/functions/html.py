"""What a page's HTML claims and says, by regular expressions in the JVM (no tree is built)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named entities that text has.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def unescape(text: Column) -> Column:
    for entity, character in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f]+", " "))


def title(html: Column) -> Column:
    return squeezed(unescape(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def text(html: Column) -> Column:
    """Visible text: scripts, styles, navigation and comments gone, tags as spaces."""
    out = html
    for pattern in (r"(?is)<!--.*?-->", r"(?is)<(?:script|style|nav|head|footer)\b[^>]*>.*?</(?:script|style|nav|head|footer)>", r"(?s)<[^>]*>"):
        out = F.regexp_replace(out, pattern, " ")
    return squeezed(unescape(out))


def links(html: Column) -> Column:
    """href values of anchors, in order."""
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\b[^>]*\bhref="([^"]*)"'), F.lit(1))


def headings(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1)), lambda h: squeezed(unescape(F.regexp_replace(h, "<[^>]*>", ""))))


def paragraphs(html: Column) -> Column:
    found = F.regexp_extract_all(html, F.lit(r"(?is)<p\b[^>]*>(.*?)(?=</p>|<p\b|</div>|</article>|</body>)"), F.lit(1))
    return F.filter(F.transform(found, lambda p: squeezed(unescape(F.regexp_replace(p, "<[^>]*>", "")))), lambda p: p != "")


def meta(html: Column, name: str) -> Column:
    """The content that a page's meta element of a name or property has, else null."""
    before = F.regexp_extract(html, rf'(?is)<meta\b[^>]*\b(?:name|property)="{name}"[^>]*\bcontent="([^"]*)"', 1)
    after = F.regexp_extract(html, rf'(?is)<meta\b[^>]*\bcontent="([^"]*)"[^>]*\b(?:name|property)="{name}"', 1)
    return F.nullif(squeezed(unescape(F.when(before != "", before).otherwise(after))), F.lit(""))


def claims(html: Column) -> Column:
    """What a page says of itself: its title, description, author, date and picture, each from its first source."""
    linked = F.regexp_extract(html, r'(?is)<script\b[^>]*type="application/ld\+json"[^>]*>(.*?)</script>', 1)
    said = F.from_json(linked, "headline string, description string, datePublished string, image string, author struct<name:string>")
    return F.struct(
        F.coalesce(meta(html, "og:title"), meta(html, "twitter:title"), said["headline"], F.nullif(title(html), F.lit(""))).alias("title"),
        F.coalesce(meta(html, "og:description"), meta(html, "description"), meta(html, "twitter:description"), said["description"]).alias("description"),
        F.coalesce(meta(html, "author"), said["author"]["name"]).alias("author"),
        F.coalesce(meta(html, "article:published_time"), said["datePublished"]).alias("published_at"),
        F.coalesce(meta(html, "og:image"), said["image"]).alias("image"),
    )


def shown_title(html: Column) -> Column:
    """The first h1 if the page's claims or title have its words, else what it claims."""
    key = lambda t: F.lower(F.regexp_replace(F.coalesce(t, F.lit("")), r"[^\p{L}\p{N}]+", ""))
    h1 = squeezed(unescape(F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]*>", "")))
    claim = claims(html)["title"]
    return F.when((h1 != "") & ((F.instr(key(claim), key(h1)) > 0) | (F.instr(key(title(html)), key(h1)) > 0) | claim.isNull()), h1).otherwise(F.coalesce(claim, h1))


def absolute(url: Column, base: Column) -> Column:
    """A reference as an absolute http(s) URL, or null if it leads elsewhere; dot segments at its start are resolved."""
    site = F.regexp_extract(base, r"^(https?://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_extract(base, r"^https?://[^/?#]*([^?#]*)", 1), r"[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    up = F.regexp_count(F.regexp_extract(url, r"^((?:\.\./)*)", 1), F.lit(r"\.\./"))
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    kept = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - up, F.lit(0)))
    rest = F.regexp_replace(url, r"^(?:\./|\.\./)*", "")
    relative = F.concat(site, F.lit("/"), F.when(F.size(kept) > 0, F.concat(F.array_join(kept, "/"), F.lit("/"))).otherwise(""), rest)
    return (
        F.when(url.rlike("(?i)^https?://"), url)
        .when(url.startswith("//"), F.concat(F.regexp_extract(base, "^(https?:)", 1), url))
        .when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(url.startswith("/"), F.concat(site, url))
        .when(url.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), url))
        .when(url.startswith("?"), F.concat(F.regexp_replace(base, "[?#].*$", ""), url))
        .otherwise(relative)
    )


#: What a content system puts between a picture's name and its ending.
SIZES = r"(?:-\d+x\d+|-scaled|-e\d{10,})+(?=\.[a-z0-9]+$)"
#: Proxies within proxies that are unwrapped.
PROXIES = 8


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.regexp_replace(text, r"\+", "%2B")), text)


def _unwrapped(url: Column) -> Column:
    """The address that an image proxy carries as its parameter url or in its path; the same address, if it is none."""
    asked = _decoded(F.regexp_replace(F.regexp_extract(url, r"^[^?#]*\?(?:[^#]*&)?url=([^&#]*)", 1), r"\+", " "))
    segments = F.split(F.regexp_extract(url, r"^https?://[^/?#]*([^?#]*)", 1), "/")
    encoded = F.get(F.filter(F.transform(segments, _decoded), lambda p: p.rlike("(?i)^https?://")), F.lit(0))
    plain = F.regexp_extract(url, r"(?i)^https?://[^/?#]*/(?:[^?#]*?/)?(https?:/{1,2}[^?#]+)", 1)
    return F.when(asked != "", F.coalesce(absolute(asked, url), url)).otherwise(F.coalesce(encoded, F.nullif(F.regexp_replace(plain, r"^(?i)(https?:)/+", "$1//"), F.lit("")), url))


def picture_key(url: Column) -> Column:
    """One text for the sizes, crops and proxies that a picture is served under: the last two segments of its path.

    They are decoded and in lower case; a size that a content system put behind the name goes, the ending stays. Null
    for what is no http(s) address or has no path.
    """
    own = F.aggregate(F.sequence(F.lit(1), F.lit(PROXIES)), url, lambda at, _: F.when(at.rlike("[?&]url=|(?i).https?(?::|%3a)"), _unwrapped(at)).otherwise(at))
    segments = F.filter(F.split(F.regexp_extract(own, r"^https?://[^/?#]+([^?#]*)", 1), "/"), lambda p: p != "")
    named = F.transform(F.slice(segments, F.greatest(F.size(segments) - 1, F.lit(1)), F.lit(2)), lambda p: F.lower(_decoded(p)))
    return F.when(F.size(segments) > 0, F.regexp_replace(F.array_join(named, "/"), SIZES, ""))


def main_part(html: Column) -> Column:
    """The article's markup: of article, main and body, the one with the most text that isn't linked, the innermost of equals."""
    found = F.array(*[F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*)</{tag}>", 1) for tag in ("article", "main", "body")])

    def score(part: Column) -> Column:
        unlinked = F.regexp_replace(part, r"(?is)<a\b[^>]*>.*?</a>", " ")
        return F.length(text(unlinked)) - 2 * (F.length(text(part)) - F.length(text(unlinked)))

    scored = F.transform(F.filter(found, lambda p: p != ""), lambda p, i: F.struct(score(p).alias("n"), (-i).alias("i"), p.alias("part")))
    return F.coalesce(F.array_max(scored)["part"], html)


def is_sign_in(url: Column) -> Column:
    """Whether an address is a page to sign in at."""
    return url.rlike(r"(?i)^https?://(?:login|signin|auth|accounts|sso)\.") | F.exists(F.split(F.regexp_extract(url, r"^https?://[^/?#]*([^?#]*)", 1), "/"), lambda p: F.lower(p).isin("login", "signin", "sign-in", "log-in", "auth", "sso"))


def sent_to_sign_in(asked: Column, landed: Column) -> Column:
    return is_sign_in(landed) & ~is_sign_in(asked)
