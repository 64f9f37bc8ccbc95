from folioscope.operators import clip

BASE = "https://site.example/posts/one"


def blocks(html):
    return clip.clipped(html, BASE)


def test_main_part_and_inline_marks():
    page = """<html><body><nav><p>menu, menu, menu and more of the menu here</p></nav><div id=x><h2>Title <i>one</i></h2>
      <p>First, some <b>bold </b>text with <a href="../a b(1)">a link</a>, <code>co`de</code> and 5$ for $x$.<br>Second line, too.
      <p>Unclosed paragraph, with enough words to count as prose.<script>bad()</script></div><footer>foot</footer></body></html>"""
    assert blocks(page) == [
        ("heading", "## Title *one*"),
        ("paragraph", "First, some **bold** text with [a link](https://site.example/a%20b%281%29), ``co`de`` and 5\\$ for \\$x\\$.\nSecond line, too."),
        ("paragraph", "Unclosed paragraph, with enough words to count as prose."),
    ]


def test_nested_lists_quotes_and_tables():
    page = """<article><ol start=3><li>three<ul><li>a<li>b <b>c</b></ul><li><p>four</p><p>more</p></ol>
      <blockquote><p>said</p><p>again</p></blockquote>
      <table><tr><th>k<th>v<tr><td>a|b<td>1</table><table role=presentation><tr><td><p>layout</p></td></tr></table><hr></article>"""
    assert blocks(page) == [
        ("list", "3. three\n   - a\n   - b **c**\n4. four\n\n   more"),
        ("blockquote", "> said\n>\n> again"),
        ("table", "| k | v |\n| --- | --- |\n| a\\|b | 1 |"),
        ("paragraph", "layout"),
        ("thematicBreak", "---"),
    ]


def test_code_with_gutters_and_languages():
    page = """<main><pre class="brush: js">let a = 1;\nlet b;</pre><table class="highlight"><tr><td class="gutter"><pre>1\n2</pre></td><td class="code"><pre><code class="language-go">x := 1
<span class="lineno">9</span>y</code></pre></td></tr></table><div class="highlight" data-lang="sh"><pre>a ``` b</pre></div></main>"""
    assert blocks(page) == [("code", "```js\nlet a = 1;\nlet b;\n```"), ("code", "```go\nx := 1\ny\n```"), ("code", "````sh\na ``` b\n````")]


def test_figures_math_and_hidden_parts():
    page = """<article><figure><img data-src="/p.png" src="data:x" alt="A [pic]"><figcaption>Cap, <em>here</em></figcaption></figure>
      <p>Let <span class="katex"><math><annotation encoding="application/x-tex">x^2</annotation></math><span aria-hidden="true">x2</span></span> be.</p>
      <math display="block" alttext="\\sum_i i"></math><p style="display: none">no</p><p hidden>no</p><dl><dt>t<dd>d</dl><img srcset="/s.png 1x, /l.png 2x"></article>"""
    assert blocks(page) == [
        ("paragraph", "![A [pic](https://site.example/p.png)"),
        ("paragraph", "*Cap, *here**"),
        ("paragraph", "Let $x^2$ be."),
        ("math", "$$\n\\sum_i i\n$$"),
        ("paragraph", "**t**"),
        ("paragraph", "d"),
        ("paragraph", "![](https://site.example/l.png)"),
    ]


def test_awkward_pages(spark):
    assert clip.clipped(None, None) == [] and clip.clipped("", "x") == [] and clip.clipped("plain", None) == [("paragraph", "plain")]
    assert clip.clipped("<p>" + "<div>" * 300 + "deep", BASE) == [("paragraph", "deep")]
    rows = [(1, BASE, "<p>a</p><p>b</p>", "x"), (2, None, None, "x"), (1, BASE, "<p>a</p><p>b</p>", "x")]
    got = clip.blocks(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, 0, "paragraph", "a"), (1, 0, "paragraph", "a"), (1, 1, "paragraph", "b"), (1, 1, "paragraph", "b")]


def test_deeply_nested_pages_give_rows():
    for tag in ("div", "b", "span", "blockquote", "ul><li"):
        assert [t.strip("> *-") for _, t in clip.clipped(f"<p>x</p>{f'<{tag}>' * 50000}deep", BASE)][-1].endswith("deep")
    page = "".join(f"<div><p>{i} words of a paragraph</p>" for i in range(400)) + "</div>" * 400 + "<p>after</p>"
    got = [t for _, t in clip.clipped(f"<article>{page}</article>", BASE)]
    assert got == [f"{i} words of a paragraph" for i in range(400)] + ["after"]


def test_split_bodies_are_joined():
    part = lambda k, n=2: f'<div class="post-content x">{"".join(f"<p>Part {k} paragraph {i}, with words.</p>" for i in range(n))}</div>'
    gap = '<div class="ad-wrap">Advertisement</div>'
    row = lambda k: f'<div class="row">{part(k)}</div>'
    root = clip.Tree(f"<article>{row(1)}{gap}{row(2)}{gap}{row(3)}<footer>foot</footer></article>").root
    assert clip.join_bodies(root) == 2 and clip.join_bodies(root) == 0
    body = next(n for n in root.walk() if "post-content" in n.attrs.get("class", ""))
    assert [squeezed_text for squeezed_text in (p.text() for p in body.walk() if p.tag == "p")] == [f"Part {k} paragraph {i}, with words." for k in (1, 2, 3) for i in (0, 1)]
    for apart in (f"<article>{row(1)}<h2>Next</h2>{row(2)}</article>", f"<article>{row(1)}{'long ' * 30}{row(2)}</article>", f"<article>{row(1)}</article><article>{row(2)}</article>",
                  f"<article>{part(1, 1)}{part(2, 1)}</article>", f'<article>{row(1).replace("post-content", "comment-content")}{row(2).replace("post-content", "comment-content")}</article>'):
        assert clip.join_bodies(clip.Tree(apart).root) == 0
