import pyarrow as pa
import pytest

from folioscope.operators.emphasis import emphasised, pieces, repaired, spans_of, with_cjk_emphasis


@pytest.mark.parametrize("text, spans", [
    ("*a*", [(0, 2, 1)]), ("**a**", [(0, 3, 2)]), ("***a***", [(0, 6, 1), (1, 4, 2)]), ("a_b_c", []), ("_a_ b", [(0, 2, 1)]), ("* a *", []), ("a*b*c", [(1, 3, 1)]),
    ("*a _b* c_", [(0, 5, 1)]), ("**a*b**", [(0, 5, 2)]), ("*foo**bar*", [(0, 9, 1)]), ("**foo*bar*baz**", [(0, 13, 2), (5, 9, 1)]), ("`*a*` *b*", [(6, 8, 1)]), (r"\*a*", []), ("*[a*](u) b*", [(0, 10, 1)]),
    ("[*a](u)*", []), ("*a\n\nb*", []), ("- *a\n- b*", []), ("```\n*a*\n```", []), ("> *a*\n> b", [(2, 4, 1)]), ("| *a | b* |\n|---|---|\n| *c* | d |", [(24, 26, 1)]), ("", []), (None, []),
])
def test_spans(text, spans):
    assert spans_of(text) == spans


@pytest.mark.parametrize("text, new", [
    ("细节_真的_很重要", "细节*真的*很重要"), ("中文__强调__文字", "中文**强调**文字"), ("中文___强调___文字", "中文***强调***文字"), ("一个_tick_（时刻）", "一个*tick*（时刻）"), ("不会_少于_8个月", "不会*少于*8个月"),
    ("细节_真的_很重要_确实_如此", "细节*真的*很重要*确实*如此"), ("文_见[报纸](https://x.org/a_b_c)好_的", "文*见[报纸](https://x.org/a_b_c)好*的"), ("𠮷_强调_8", "𠮷*强调*8"),
    ("| 细节_真的_很 | b |\n|---|---|\n| 一_二 | 三_四 |", "| 细节*真的*很 | b |\n|---|---|\n| 一_二 | 三_四 |"),
])
def test_beside_cjk(text, new):
    assert repaired(text) == new and repaired(new) == new


@pytest.mark.parametrize("text", ["my_报告_draft", "中文_file_name", "snake_case_name", "中文_ 真的 _文", "`细节_真的_很`", "```\n细节_真的_很\n```", "$细_真_x$", r"细节\_真的\_很", "细节_真的\n很_重", "中文_二__三", "中文____四____五", "见_[报纸](u)_的", "", None, "中" * 5000])
def test_left_alone(text):
    assert repaired(text) == text


def test_stray_asterisk_keeps_its_partner():
    """A swap that would pair with an asterisk of the prose is left out, others are done."""
    text = "文*星 细节_真的_很*重 和_这个_也"
    new = repaired(text)
    assert repaired(new) == new and set(spans_of(text)) <= set(spans_of(new))


def test_many_runs_take_time_in_proportion():
    assert repaired("细_真_很 " * 4000).count("*") == 8000
    assert spans_of("*a " * 20000) == [] and len(spans_of("**a* " * 5000)) > 0


def test_rows(spark):
    docs = spark.createDataFrame([(1, "细节_真的_很"), (1, "细节_真的_很"), (None, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, with_cjk_emphasis(docs).collect()), key=str) == [(1, "细节*真的*很"), (1, "细节*真的*很"), (2, ""), (None, None)]
    assert [tuple(r) for r in emphasised(with_cjk_emphasis(docs)).collect()] == [(1, 2, 5, 1)] * 2
    assert with_cjk_emphasis(docs.limit(0)).count() == 0


def test_batches_come_in_pieces_of_bounded_bytes():
    texts = ["a" * 4, None, "b" * 4, "c" * 30, "", "d"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts, pa.string())], ["doc_id", "text"])
    got = [p["text"].to_pylist() for p in pieces([batch, batch.slice(0, 0)], 8)]
    assert got == [["a" * 4, None, "b" * 4], ["c" * 30], ["", "d"], []]
