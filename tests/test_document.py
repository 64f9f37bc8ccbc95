from folioscope.operators import document

TEXT = """# One
Setext
title
---
para *one*
lazy line
## Two ##
- a

  more of a
  ```
  - not an item
  ```
- b
lazy b

1) other list
2) goes on

> quote
lazy
> > deeper

````js
```
inner
````
~~~
open ``` fence

    code by indent

| a | b |
| - | :-: |
| 1 | 2 |
***
$$
x
$$
$$y$$
<div>
html

[ref]: https://x.org "t"
[Other Ref]: </y>
see [it][ref], [Ref][] and [other][OTHER  ref] or [none][no]
~~~
never closed [a][ref]
"""


def test_blocks_of_every_kind():
    text = TEXT.replace("~~~\nopen ``` fence\n\n", "")
    got = document.split_blocks(text)
    assert [k for k, _ in got] == ["heading", "heading", "paragraph", "heading", "list", "list", "blockquote", "code", "code", "table", "thematicBreak", "math", "math", "html", "definition", "definition", "paragraph", "code"]
    by_place = [t for _, t in got]
    assert by_place[1] == "Setext\ntitle\n---" and by_place[4].startswith("- a\n\n  more") and by_place[4].endswith("- b\nlazy b") and by_place[5] == "1) other list\n2) goes on"
    assert by_place[6] == "> quote\nlazy\n> > deeper" and by_place[7] == "````js\n```\ninner\n````" and by_place[8] == "    code by indent" and by_place[17] == "~~~\nnever closed [a][ref]"
    assert document.split_blocks(None) == document.split_blocks(" \n\n") == []


def test_a_fence_takes_all_up_to_its_end_and_nothing_is_lost():
    assert [k for k, _ in document.split_blocks(TEXT)][8:] == ["code", "paragraph"]
    for text in (TEXT, "- a\n\n\nb", "- a\n\n    c\n\nd", "a\n===\nb", "-\n-\n", "* * *\n* a\n+ b", "a | b\n- | -\nc", "1. a\n\n   > q\n2. b\n\n3) c"):
        assert "".join("".join(t.split()) for _, t in document.split_blocks(text)) == "".join(text.split())
    kinds = lambda t: [k for k, _ in document.split_blocks(t)]
    assert kinds("- a\n\n\nb") == ["list", "paragraph"] and kinds("- a\n\n    c\n\nd") == ["list", "paragraph"] and kinds("* * *\n* a\n+ b") == ["thematicBreak", "list", "list"]
    assert kinds("a | b\n- | -\nc") == ["table"] and kinds("1. a\n\n   > q\n2. b\n\n3) c") == ["list", "list"]


def test_reference_links(spark):
    docs = spark.createDataFrame([(1, TEXT.replace("~~~\nopen ``` fence\n\n", "")), (2, "no [a][b]"), (3, None)], "doc_id long, text string")
    rows = {(r.doc_id, r.type, r.pos): r.text for r in document.with_links_inlined(document.blocks(docs)).collect()}
    assert [t for (d, k, p), t in rows.items() if d == 1 and p == 16] == ["see [it](https://x.org), [Ref](https://x.org) and [other](/y) or [none][no]"]
    assert [t for (d, k, p), t in rows.items() if d == 1 and p == 17] == ["~~~\nnever closed [a][ref]"] and not [k for k in rows if k[1] == "definition"]
    assert [t for (d, _, _), t in rows.items() if d == 2] == ["no [a][b]"]
