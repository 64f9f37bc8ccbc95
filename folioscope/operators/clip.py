"""Web pages as Markdown blocks, by a tree of each page: main part, then one row for each block.

Trees are built and walked in tasks, an Arrow batch at a time; everything after that (joining blocks, counting them,
comparing versions) is done on rows. Memory is a page's tree; nothing is shuffled. A tree is at most DEEPEST elements
deep, as in browsers: what a page nests deeper is laid side by side at that depth, and loses only its nesting.
"""

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
DROPPED = frozenset("aside button dialog footer form head iframe input nav noscript script select style svg template textarea".split())
#: An opening tag of the key closes open ones of the value, up to a container.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
BLOCKS = frozenset("address article blockquote center dd details div dl dt fieldset figure h1 h2 h3 h4 h5 h6 header hr main ol p pre section summary table ul body html figcaption".split())
CONTAINERS = frozenset("ul ol dl table tbody thead div section article main body td th blockquote".split())
#: Marks within a paragraph; one that is left open ends with its paragraph.
MARKS = frozenset("a abbr b big cite code del em font i ins kbd mark q s samp small span strike strong sub sup tt u var".split())


#: Elements that may be open within each other.
DEEPEST = 120


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "holds_block")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children, self.parent, self.holds_block = tag, attrs, [], None, False

    def walk(self) -> Iterator["Node"]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag not in ("script", "style"):
                todo += reversed(node.children)
        return "".join(out)

    def first(self, *tags: str) -> "Node | None":
        return next((n for n in self.walk() if n.tag in tags and n is not self), None)

    def named(self, pattern: str) -> bool:
        return bool(re.search(pattern, f"{self.attrs.get('class', '')} {self.attrs.get('id', '')}", re.I))


class Tree(HTMLParser):
    """A page's nodes; end tags that are left out are supplied."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]
        self.flat: dict[str, int] = {}
        self.lapsed: dict[str, int] = {}
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        shut = CLOSES.get(tag) or ({"p"} if tag in BLOCKS else ())
        if "p" in shut:
            self.end_paragraph()
        while len(self.open) > 1 and self.open[-1].tag in shut and self.open[-1].tag not in CONTAINERS - shut:
            self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        node.parent = self.open[-1]
        node.parent.children.append(node)
        if tag in BLOCKS:
            above = node.parent
            while above is not None and not above.holds_block:
                above.holds_block, above = True, above.parent
        if tag not in VOID:
            if len(self.open) < DEEPEST:
                self.open.append(node)
            else:
                self.flat[tag] = self.flat.get(tag, 0) + 1

    def end_paragraph(self):
        """Marks left open end with their paragraph, however many a page has: else each would nest all that follows. As they ran on over a block, they mark nothing."""
        k = len(self.open) - 1
        while k > 0 and self.open[k].tag in MARKS:
            k -= 1
        if self.open[k].tag == "p":
            for node in self.open[k + 1 :]:
                node.holds_block = True
                self.lapsed[node.tag] = self.lapsed.get(node.tag, 0) + 1
            del self.open[k + 1 :]

    def handle_endtag(self, tag):
        if self.flat.get(tag):
            self.flat[tag] -= 1
            return
        if self.lapsed.get(tag):
            k = len(self.open) - 1
            while k > 0 and self.open[k].tag in MARKS and self.open[k].tag != tag:
                k -= 1
            if self.open[k].tag != tag:
                self.lapsed[tag] -= 1
                return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return
            if self.open[k].tag in ("td", "table") and tag not in ("table", "tr", "tbody", "div", "article", "body"):
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def hidden(node: Node) -> bool:
    style = re.sub(r"\s", "", node.attrs.get("style", "").lower())
    return node.tag in DROPPED or "hidden" in node.attrs or node.attrs.get("aria-hidden") == "true" and node.tag != "span" or "display:none" in style or "visibility:hidden" in style


def squeezed(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def main_part(root: Node) -> Node:
    """The one article or main element, else the element whose own paragraphs say most outside of links."""
    marked = [n for n in root.walk() if n.tag in ("article", "main") or n.attrs.get("role") == "main" or n.attrs.get("itemprop") == "articleBody"]
    whole = [n for n in marked if n.tag != "article" or sum(m.tag == "article" for m in marked) == 1]
    if whole:
        return min(whole, key=lambda n: (n.tag != "article", -len(n.text())))
    scores: dict[int, list] = {}
    todo = [root]
    while todo:
        node = todo.pop()
        for child in node.children:
            if isinstance(child, Node) and not hidden(child):
                if child.tag in ("p", "pre", "blockquote"):
                    words = squeezed(child.text())
                    linked = sum(len(squeezed(n.text())) for n in child.walk() if n.tag == "a")
                    worth = (len(words) - linked) / 50 + words.count(",") if len(words) > 25 else 0
                    for depth, holder in enumerate((node, node.parent) if node.parent else (node,)):
                        scores.setdefault(id(holder), [0.0, holder])[0] += worth / (1 + depth)
                todo.append(child)

    body = root.first("body") or root
    best = max(scores.values(), key=lambda s: s[0], default=[0, body])
    return best[1] if best[0] > 0 else body


#: Class names by which readers take an element for the body, or for none.
BODY = re.compile("article|body|content|entry|hentry|h-entry|main|page|post|text|blog|story", re.I)
NO_BODY = re.compile("-ad-|hidden|banner|combx|comment|com-|contact|footer|gdpr|masthead|media|meta|outbrain|promo|related|scroll|share|shoutbox|sidebar|skyscraper|sponsor|shopping|tags|widget", re.I)
#: What a reader would miss between two parts of a body; and how many characters of a label he wouldn't.
MISSED = frozenset("h1 h2 h3 h4 h5 h6 figure img picture video audio iframe table pre blockquote ul ol hr".split())
LABEL, OWN_PARAGRAPHS = 100, 2


def join_bodies(root: Node) -> int:
    """Parts of one article's body that the page set apart are put into the first; how many were moved.

    Parts are elements of one article with the same classes, which are a body's, and two paragraphs of their own at
    least. They are joined only if none of the gaps between them holds anything but a label.
    """
    moved = 0
    for article in [n for n in root.walk() if n.tag == "article"]:
        groups: dict[tuple, list[Node]] = {}
        todo = [c for c in article.children if isinstance(c, Node)][::-1]
        while todo:
            node = todo.pop()
            names = node.attrs.get("class", "").strip()
            is_part = names and BODY.search(names) and not NO_BODY.search(names) and sum(isinstance(c, Node) and c.tag == "p" for c in node.children) >= OWN_PARAGRAPHS
            if is_part:
                groups.setdefault(tuple(sorted(names.split())), []).append(node)
            # A part's own parts belong to it, a nested article's to that.
            elif node.tag != "article":
                todo += [c for c in reversed(node.children) if isinstance(c, Node)]
        for parts in groups.values():
            if len(parts) > 1 and _only_labels_between(article, parts):
                for part in parts[1:]:
                    for child in part.children:
                        if isinstance(child, Node):
                            child.parent = parts[0]
                    parts[0].children += part.children
                    part.parent.children.remove(part)
                    moved += 1
    return moved


def _only_labels_between(article: Node, parts: list[Node]) -> bool:
    """Whether what stands after the first part and before the last, outside of all, is labels."""
    ids, seen, label, todo = {id(p) for p in parts}, 0, 0, [article]
    while todo and seen < len(parts):
        node = todo.pop()
        if isinstance(node, str):
            label += len(node.strip()) if seen else 0
        elif id(node) in ids:
            if label > LABEL:
                return False
            seen, label = seen + 1, 0
        elif seen and node.tag in MISSED and not hidden(node):
            return False
        elif node.tag not in ("script", "style"):
            todo += reversed(node.children)
    return True


class Writer:
    """Markdown blocks of a node, as (type, text)."""

    def __init__(self, base: str):
        self.base, self.blocks = base, []

    def link(self, target: str) -> str:
        try:
            found = urljoin(self.base, target.strip())
        except ValueError:
            return ""
        return found.replace(" ", "%20").replace("(", "%28").replace(")", "%29") if re.match(r"https?:|mailto:|#", found) else ""

    def picture(self, node: Node) -> str:
        source = next((node.attrs[k] for k in ("data-src", "data-original", "data-lazy-src", "src") if node.attrs.get(k) and not node.attrs[k].startswith("data:")), "")
        if not source and node.attrs.get("srcset"):
            source = node.attrs["srcset"].split(",")[-1].split()[0]
        target = self.link(source) if source else ""
        return f"![{squeezed(node.attrs.get('alt', '')).replace(']', '')}]({target})" if target else ""

    @staticmethod
    def tex(node: Node) -> tuple[str, bool] | None:
        """The TeX that a math element carries, and whether it stands on its own."""
        kind = node.attrs.get("type", "")
        if node.tag == "script" and kind.startswith("math/tex"):
            return node.text() or "".join(c for c in node.children if isinstance(c, str)), "mode=display" in kind
        if node.tag == "math" or node.named(r"(?:^|\s)(?:katex|mwe-math-element)(?:\s|$)"):
            said = next((n.text() for n in node.walk() if n.tag == "annotation" and "tex" in n.attrs.get("encoding", "")), "") or next((n.attrs["alttext"] for n in node.walk() if n.attrs.get("alttext")), "")
            if said:
                return said.strip(), node.attrs.get("display") == "block" or any(n.attrs.get("display") == "block" for n in node.walk()) or node.named("katex-display")
        return None

    def inline(self, node: Node) -> str:
        out = []
        for child in node.children:
            if isinstance(child, str):
                out.append(re.sub(r"\s+", " ", re.sub(r"([\\$*_`\[\]])", r"\\\1", child) if node.tag != "code" else child))
            elif math := self.tex(child):
                out.append(f"${math[0].strip()}$")
            elif not hidden(child):
                out.append(self.marked(child))
        return "".join(out)

    def marked(self, node: Node) -> str:
        if node.tag == "br":
            return "\n"
        if node.tag == "img":
            return self.picture(node)
        if node.tag in ("code", "kbd", "samp", "tt"):
            said = squeezed(node.text())
            fence = "`" * (1 + max(map(len, re.findall("`+", said)), default=0))
            return f"{fence}{said}{fence}" if said else ""
        inner = self.inline(node)
        mark = {"strong": "**", "b": "**", "em": "*", "i": "*", "del": "~~", "s": "~~"}.get(node.tag)
        if mark and inner.strip():
            start, end = len(inner) - len(inner.lstrip()), len(inner.rstrip())
            return f"{inner[:start]}{mark}{inner[start:end]}{mark}{inner[end:]}"
        if node.tag == "a" and inner.strip():
            target = self.link(node.attrs.get("href", ""))
            return f"[{inner.strip()}]({target})" if target and "](" not in re.sub(r"!\[[^\]]*\]\([^)]*\)", "", inner) else inner
        return inner

    def put(self, kind: str, text: str) -> None:
        text = "\n".join(line.strip(" ") for line in text.split("\n")).strip() if kind == "paragraph" else text
        if text:
            self.blocks.append((kind, text))

    def block(self, node: Node) -> None:
        """Blocks inside a container; text between them is a paragraph."""
        run = Node("p", {})
        for child in node.children:
            math = self.tex(child) if isinstance(child, Node) else None
            if isinstance(child, Node) and not math and not hidden(child) and (child.tag in BLOCKS or child.holds_block):
                self.flush(run)
                self.one(child)
            elif math and math[1]:
                self.flush(run)
                self.put("math", f"$$\n{math[0].strip()}\n$$")
            elif isinstance(child, str) or math or not hidden(child):
                run.children.append(child)
        self.flush(run)

    def flush(self, run: Node) -> None:
        self.put("paragraph", self.inline(run))
        run.children = []

    def one(self, node: Node) -> None:
        tag = node.tag
        if re.fullmatch("h[1-6]", tag):
            said = squeezed(self.inline(Node("p", {}) if hidden(node) else node))
            self.put("heading", f"{'#' * int(tag[1])} {said}" if said else "")
        elif tag == "pre" or (tag in ("table", "div") and node.named(r"(?:^|\s)(?:highlight|codehilite|code-block|rouge-table|lntable)") and node.first("pre")):
            self.code(node)
        elif tag in ("ul", "ol"):
            self.put("list", "\n".join(self.items(node)))
        elif tag == "blockquote":
            inner = self.nested(node)
            self.put("blockquote", "\n".join(f"> {line}".rstrip() for line in inner.split("\n")) if inner else "")
        elif tag == "table":
            self.table(node)
        elif tag == "hr":
            self.put("thematicBreak", "---")
        elif tag == "figure":
            self.figure(node)
        elif tag == "dl":
            for n in node.walk():
                if n.tag in ("dt", "dd"):
                    said = squeezed(self.inline(n))
                    self.put("paragraph", (f"**{said}**" if n.tag == "dt" else said) if said else "")
        else:
            self.block(node)

    def nested(self, node: Node) -> str:
        inner = Writer(self.base)
        inner.block(node)
        return "\n\n".join(text for _, text in inner.blocks)

    def items(self, node: Node) -> list[str]:
        out, number = [], int(node.attrs.get("start", "1")) if node.attrs.get("start", "1").isdigit() else 1
        for child in node.children:
            if isinstance(child, Node) and child.tag != "li" and not hidden(child) or isinstance(child, str) and child.strip():
                # What stands in a list outside of its items is an item.
                stray, child = child, Node("li", {})
                child.children = [stray]
            if isinstance(child, Node) and child.tag == "li":
                mark = f"{number}. " if node.tag == "ol" else "- "
                number += 1
                own = Node("li", child.attrs)
                own.children = [c for c in child.children if not (isinstance(c, Node) and c.tag in ("ul", "ol"))]
                lines = self.nested(own).split("\n")
                below = [line for c in child.children if isinstance(c, Node) and c.tag in ("ul", "ol") for line in self.items(c)]
                pad = " " * len(mark)
                out += [mark + lines[0], *((pad + line).rstrip() for line in lines[1:] + below)]
        return out

    def code(self, node: Node) -> None:
        gutters = re.compile(r"(?:^|\s)(?:gutter|lineno|linenos|line-numbers?|lnt)(?:\s|$)")

        def said(n: Node | str) -> str:
            out, todo = [], [n]
            while todo:
                at = todo.pop()
                if isinstance(at, str):
                    out.append(at)
                elif not (gutters.search(at.attrs.get("class", "")) and "pre" != at.tag or at.tag == "button"):
                    out += ["\n"] * (at.tag == "br")
                    todo += reversed(at.children)
            return "".join(out)

        pres = [n for n in node.walk() if n.tag == "pre"] or [node]
        pre = max(pres, key=lambda n: len(re.sub(r"[\d\s]", "", said(n))))
        names = (re.search(r"(?:^|\s)(?:language-|lang-|highlight-source-|brush:\s*)([\w+#-]+)", n.attrs.get("class", "")) for n in (*node.walk(), pre))
        told = next((m[1] for m in names if m), "") or next((n.attrs[k] for n in node.walk() for k in ("data-lang", "data-language") if n.attrs.get(k)), "")
        body = said(pre).strip("\n").rstrip()
        fence = "`" * max(3, 1 + max(map(len, re.findall("`+", body)), default=0))
        self.put("code", f"{fence}{told}\n{body}\n{fence}" if body else "")

    def table(self, node: Node) -> None:
        rows = [[squeezed(self.inline(c)).replace("|", "\\|") for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")] for r in node.walk() if r.tag == "tr"]
        rows = [r for r in rows if any(r)]
        if rows and max(map(len, rows)) == 1 or node.attrs.get("role") == "presentation":
            for cell in (n for n in node.walk() if n.tag in ("td", "th")):
                self.block(cell)
        elif rows:
            wide = max(map(len, rows))
            lines = [f"| {' | '.join(r + [''] * (wide - len(r)))} |" for r in rows]
            self.put("table", "\n".join([lines[0], f"| {' | '.join(['---'] * wide)} |", *lines[1:]]))

    def figure(self, node: Node) -> None:
        caption = node.first("figcaption")
        for n in node.walk():
            if n.tag == "img" and (said := self.picture(n)):
                self.put("paragraph", said)
            elif n.tag in ("pre", "table", "blockquote"):
                self.one(n)
                break
        if caption:
            said = squeezed(self.inline(caption))
            self.put("paragraph", f"*{said}*" if said else "")


def clipped(html: str | None, url: str | None) -> list[tuple[str, str]]:
    """A page's main part as blocks. Null or empty pages have none."""
    root = Tree(html or "").root
    join_bodies(root)
    base = next((n.attrs["href"] for n in root.walk() if n.tag == "base" and n.attrs.get("href")), "")
    writer = Writer(urljoin(url or "", base))
    writer.block(main_part(root))
    return writer.blocks


def blocks(pages: DataFrame) -> DataFrame:
    """page_id, pos, type and text: a row for each block of each page's main part, in its order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[{"type": t, "text": x} for t, x in clipped(h, u)] for h, u in zip(batch["html"].to_pylist(), batch["url"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["page_id"], pa.array(rows, pa.list_(pa.struct([("type", pa.string()), ("text", pa.string())])))], ["page_id", "blocks"])

    found = pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, blocks array<struct<type:string,text:string>>")
    return found.select("page_id", F.posexplode("blocks").alias("pos", "b")).select("page_id", "pos", "b.type", "b.text")
