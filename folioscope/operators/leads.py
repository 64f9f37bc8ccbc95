"""The lead that a page shows above its article's body: the sentence under the headline, and the picture.

A page says what its lead is (its description, its picture); the tree says where it may stand: between the headline and
the body's first paragraph. Elements have intervals of document order, so that before, inside and between are
comparisons. Where evidence and place disagree, nothing is taken, and the row says why.
"""

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from urllib.parse import parse_qs, unquote, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.clip import BLOCKS, Node, Tree, join_bodies, main_part, squeezed
from folioscope.operators.offsets import candidates

#: Letters that a body and its first paragraph have at least, a header at most; of a sentence, words at
#: least, the share that may be linked, and the share that must agree with what the page says; a picture's least sizes.
BODY_LETTERS, START_LETTERS, HEADER_LETTERS = 500, 30, 5000
LEAST_WORDS, MOST_LINKED, AGREEMENT, LEAST_SIZE = 4, 0.5, 0.8, {"width": 150, "height": 100}
SITE_NAME_WORDS, KEY = 5, 60
FURNITURE = re.compile("-ad-|ad-break|ad-slot|ad-unit|adsbygoogle|advert|breadcrumb|comment|disqus|footer|menu|newsletter|outbrain|popup|promo|related|share|sharing|shoutbox|sidebar|skyscraper|social|sponsor|subscribe|byline|author", re.I)
NO_LEAD = frozenset("nav aside footer form button dialog time svg iframe figcaption address script style template noscript".split())
NO_PICTURE = re.compile("avatar|logo|icon|headshot|profile", re.I)
_CJK = r"\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uac00-\ud7af"
_TOKEN = re.compile(rf"[{_CJK}]+|[^\W_{_CJK}]+")


def tokens(text: str) -> frozenset[str]:
    """Words in lower case; of scripts without spaces, pairs of neighbours."""
    out = set()
    for run in _TOKEN.findall(unicodedata.normalize("NFKC", text).lower()):
        out |= {run[i : i + 2] for i in range(max(1, len(run) - 1))} if re.match(rf"[{_CJK}]", run) else {run}
    return frozenset(out)


def key(text: str) -> str:
    return " ".join(re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", text).lower()))


def letters(text: str) -> int:
    return sum(c.isalpha() for c in text)


def picture_name(address: str, depth: int = 8) -> str | None:
    """The last two segments of a picture's path, behind proxies, without a size."""
    try:
        parts = urlsplit(address)
    except ValueError:
        return None
    if parts.scheme not in ("http", "https") or not parts.netloc:
        return None
    asked = parse_qs(parts.query).get("url", [""])[0]
    inner = urljoin(address, asked) if asked else next((unquote(p) for p in parts.path.split("/") if re.match("https?:/+", unquote(p), re.I)), "")
    if not inner and (plain := re.search(r"/(https?:)/+(.+)", parts.path, re.I)):
        inner = f"{plain[1]}//{plain[2]}"
    if inner and depth:
        return picture_name(inner, depth - 1)
    tail = [unquote(p).lower() for p in parts.path.split("/") if p][-2:]
    return re.sub(r"(?:-\d+x\d+|-scaled|-e\d{10,})+(?=\.[a-z0-9]+$)", "", "/".join(tail)) or None


class Page:
    """A page's tree with the interval of document order that each element takes, and what the page says of itself."""

    def __init__(self, html: str, url: str):
        self.root = Tree(html).root
        join_bodies(self.root)
        self.base, self.span, self.order = url, {}, []
        todo: list[tuple[Node, bool]] = [(self.root, True)]
        n = 0
        while todo:
            node, enters = todo.pop()
            n += 1
            if enters:
                self.span[id(node)] = [n, n]
                self.order.append(node)
                todo.append((node, False))
                todo += [(c, True) for c in reversed(node.children) if isinstance(c, Node)]
            else:
                self.span[id(node)][1] = n

    def contains(self, outer: Node, inner: Node) -> bool:
        a, b = self.span[id(outer)], self.span[id(inner)]
        return a[0] <= b[0] and b[1] <= a[1]

    def before(self, one: Node, other: Node) -> bool:
        return self.span[id(one)][1] < self.span[id(other)][0]

    def says(self) -> dict[str, list[str]]:
        """Titles, descriptions and pictures by the page's head and linked data."""
        out: dict[str, list[str]] = {"title": [], "description": [], "image": []}
        for node in self.order:
            if node.tag == "title":
                out["title"].append(node.text())
            elif node.tag == "meta" and (m := re.fullmatch("(?:og:|twitter:)?(title|description|image)(?::src|:url)?", (node.attrs.get("property") or node.attrs.get("name") or "").lower())):
                out[m[1]].append(node.attrs.get("content", ""))
            elif node.tag == "script" and "ld+json" in node.attrs.get("type", ""):
                try:
                    said = json.loads("".join(c for c in node.children if isinstance(c, str)))
                except ValueError:
                    continue
                for one in said if isinstance(said, list) else [said]:
                    if isinstance(one, dict):
                        out["title"] += [one["headline"]] if isinstance(one.get("headline"), str) else []
                        out["description"] += [one["description"]] if isinstance(one.get("description"), str) else []
                        out["image"] += [one["image"]] if isinstance(one.get("image"), str) else []
        return {k: [squeezed(v) for v in vs if v.strip()] for k, vs in out.items()}

    def headline(self, titles: list[str], start: Node) -> Node | None:
        """The last h1 before the body that the page's title confirms, its site's name aside."""
        forms = set()
        for title in titles:
            parts = [p for p in re.split(r"\s+[|\-–—·•:»]\s+", title) if p.strip()]
            longest = max(parts, key=len, default="")
            rest = " ".join(p for p in parts if p != longest).split()
            forms |= {key(title)} | ({key(longest)} if len(parts) > 1 and len(rest) <= SITE_NAME_WORDS else set())
        found = [n for n in self.order if n.tag == "h1" and self.before(n, start) and key(n.text()) in forms - {""}]
        return found[-1] if found else None

    def header(self, headline: Node, start: Node) -> tuple[Node, list[Node]] | None:
        """The box that holds headline and body, and its children from the headline's to the one before the body's."""
        box = headline.parent
        while box is not None and not self.contains(box, start):
            box = box.parent
        if box is None:
            return None
        children = [c for c in box.children if isinstance(c, Node)]
        first = next((i for i, c in enumerate(children) if self.contains(c, headline)), None)
        last = next((i for i, c in enumerate(children) if self.contains(c, start)), None)
        return (box, children[first:last]) if first is not None and last is not None and last > first else None

    def is_furniture(self, node: Node, box: Node) -> bool:
        while node is not None and node is not box:
            if node.tag in NO_LEAD or FURNITURE.search(f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}") or "author" in f"{node.attrs.get('rel', '')} {node.attrs.get('itemprop', '')}".lower():
                return True
            node = node.parent
        return False

    def sources(self, image: Node) -> list[str]:
        said = [image.attrs.get(k, "") for k in ("src", "data-src", "data-original")]
        for name in ("srcset", "data-srcset"):
            value = image.attrs.get(name, "")
            said += [value[a:b] for a, b in candidates(value)]
        return [urljoin(self.base, s) for s in said if s and not s.startswith("data:")]


def _sentence(page: Page, box: Node, zone: list[Node], headline: Node, claimed: list[frozenset[str]]) -> Node | None:
    for node in (n for block in zone for n in block.walk()):
        if node.tag not in ("p", "div", "h2", "h3", "h4", "h5", "h6") or not page.before(headline, node) or page.is_furniture(node, box):
            continue
        said = node.text()
        own = tokens(said)
        linked = sum(len(a.text()) for a in node.walk() if a.tag == "a")
        if any(isinstance(c, Node) and c.tag in BLOCKS for c in node.children) or len(own) < LEAST_WORDS or linked > MOST_LINKED * len(said):
            continue
        if any(len(own & c) >= AGREEMENT * max(len(own), len(c)) for c in claimed):
            return node
    return None


def _picture(page: Page, box: Node, zone: list[Node], claimed: set[str | None]) -> tuple[Node, str, set[str | None]] | None:
    for image in (n for block in zone for n in block.walk() if n.tag == "img"):
        sizes = {k: int(m[0]) if (m := re.match(r"\d+", image.attrs.get(k, ""))) else least for k, least in LEAST_SIZE.items()}
        names = " ".join(image.attrs.get(k, "") for k in ("class", "id", "alt"))
        if page.is_furniture(image, box) or any(sizes[k] < LEAST_SIZE[k] for k in sizes) or NO_PICTURE.search(names):
            continue
        sources = page.sources(image)
        keys = {picture_name(s) for s in sources} - {None}
        above, in_figure = image.parent, False
        while above is not None and above is not box:
            in_figure, above = in_figure or above.tag == "figure", above.parent
        if sources and (keys & claimed or in_figure):
            return image, sources[0], keys
    return None


def lead(html: str | None, url: str | None) -> tuple[str, str | None, str | None, str | None]:
    """merged, unchanged or refused; the sentence, the picture's address, and why it was refused.

    unchanged: the page has no lead apart from its body, or the body has it already. refused: the evidence doesn't fit
    the place (the header is too long, or half of the lead stands in the body).
    """
    page = Page(html or "", url or "")
    says = page.says()
    main = main_part(page.root)
    start = next((n for n in main.walk() if n.tag == "p" and letters(n.text()) >= START_LETTERS), None)
    if start is None or letters(main.text()) < BODY_LETTERS:
        return "unchanged", None, None, None
    headline = page.headline(says["title"], start)
    if headline is None:
        return "unchanged", None, None, None
    # What stands inside the main part is in the clip as it is.
    header = None if page.contains(main, headline) else page.header(headline, start)
    if header is None:
        return "unchanged", None, None, None
    box, zone = header
    sentence = _sentence(page, box, zone, headline, [t for t in map(tokens, says["description"]) if t])
    picture = _picture(page, box, zone, {picture_name(urljoin(page.base, s)) for s in says["image"]} - {None})
    if sentence is None and picture is None:
        return "unchanged", None, None, None
    if sum(letters(b.text()) for b in zone) - letters(headline.text()) > HEADER_LETTERS:
        return "refused", None, None, "header"
    if sentence is not None and key(sentence.text())[:KEY] in key(main.text()):
        return "refused", None, None, "sentence"
    if picture is not None and picture[2] & {picture_name(s) for n in main.walk() if n.tag == "img" for s in page.sources(n)}:
        return "refused", None, None, "picture"
    return "merged", squeezed(sentence.text()) if sentence is not None else None, picture[1] if picture else None, None


def leads(pages: DataFrame) -> DataFrame:
    """page_id, kind, sentence, picture and reason: what each page shows above its body. Null and empty pages are unchanged."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [lead(h, u) for h, u in zip(batch["html"].to_pylist(), batch["url"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["page_id"], *[pa.array([r[i] for r in rows], pa.string()) for i in range(4)]], ["page_id", "kind", "sentence", "picture", "reason"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, kind string, sentence string, picture string, reason string")
