"""Registered queries against their SQL on small tables with what the driver's smallest ones lack."""

import pytest

from folioscope.plans.catalog import ORACLES, QUERIES
from tests.compare import database, rows_by_sql, rows_of


def same_as_sql(spark, path, name, **tables):
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path / "parts" / table))
        (part,) = (path / "parts" / table).glob("*.parquet")
        part.rename(path / f"{table}.parquet")
    assert rows_of(QUERIES[name](spark, str(path))) == rows_by_sql(database(str(path)), ORACLES[name])


@pytest.mark.parametrize("text", ["    indented words", "12  ...   x", None, ""])
def test_text_ranges_of_texts_that_begin_with_spaces(spark, tmp_path, text):
    same_as_sql(spark, tmp_path, "text_ranges", documents=([(3, text), (14, "plain")], "doc_id long, text string"))


def test_clip_blocks_of_headings_cut_within_an_entity(spark, tmp_path):
    page = "<html><body><article><h1>{}</h1><p>Some words of a paragraph, and more of them &amp; so on.</article></body></html>"
    rows = [(i, "https://x.org/a", page.format(head)) for i, head in enumerate(("you &amp; me&amp", "said &quot", "a &am", "a &", "a &#3", "a &#38", "R&ampD", "whole &amp; &quot;b&quot;"))]
    same_as_sql(spark, tmp_path, "clip_blocks", pages=(rows, "page_id long, url string, html string"))


def test_clip_blocks_of_many_marks_left_open(spark, tmp_path):
    page = "<html><body><article><h1>Head</h1>" + "".join(f"<p>Words {i}.</p><p><b>More {i}<br>" for i in range(130)) + "</article></body></html>"
    same_as_sql(spark, tmp_path, "clip_blocks", pages=([(1, "https://x.org/a", page), (2, "https://x.org/b", "<article><h1>H</h1><p><b>One<br></article>")], "page_id long, url string, html string"))


def test_redirect_lines_of_an_id_that_two_names_claim(spark, tmp_path):
    same_as_sql(spark, tmp_path, "redirect_lines", pages=([(122369,), (458350,), (1,)], "page_id long"))


def test_article_pages_with_gaps_and_an_id_that_two_names_claim(spark, tmp_path):
    rows = [(n, "en", f"src{n % 3}") for n in (508355, 305120, 0, 7, 40, 41)]
    same_as_sql(spark, tmp_path, "article_pages", documents=(rows, "doc_id long, lang string, source string"))
