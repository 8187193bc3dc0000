import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioframe.functions import text as tx
from folioframe.functions.tokens import estimate_tokens
from folioframe.plans import packing

TEXTS = ["", " ", "abc中文 12345", "中文abc", "e.g. 3.14 Hello!  \n\nNext。」 x", "a_b__c", "①² ½ é", "١٢", "áb", "线\n\n\n行", "x" * 50, "Ends?\tYes.\n \nblank", "「。」", "…", "한국어 テスト", "\x1c\x85　 a"]


def column(spark, texts, f):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", f(F.col("t")).alias("v")).collect()
    return [r.v for r in sorted(rows, key=lambda r: r.k)]


def test_tokens_agree_with_the_loop(spark):
    assert column(spark, [*TEXTS, None], estimate_tokens) == [*map(packing.tokens, TEXTS), 0]


def test_tokens_by_hand():
    assert packing.tokens("abc中文") == 2 and packing.tokens("中文abc") == 3 and packing.tokens("12345") == 2 and packing.tokens("a, b!") == 4 and packing.tokens("\n\n\n") == 1


def test_sentences(spark):
    got = column(spark, TEXTS, tx.sentences)
    assert got == [packing.sentences(t) for t in TEXTS]
    assert all("".join(g) == t for g, t in zip(got, TEXTS, strict=True))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab中。！.?! \n\t\"')1_", max_size=60))
def test_sentences_lose_nothing(text):
    assert "".join(packing.sentences(text)) == text


def test_paragraphs(spark):
    assert column(spark, ["a\n b \n\nc\n  \n \nd", "", "x"], tx.paragraphs) == [["a b", "c", "d"], [], ["x"]]


def test_names(spark):
    names = ["a<b>.txt", "  con.txt ", "COM1", "x" * 120, "...", None, "a b. ", "报告?.docx"]
    assert column(spark, names, tx.safe_filename) == ["a_b_.txt", "_con.txt", "_COM1", "x" * 100, "未命名", "未命名", "a b", "报告_.docx"]


def test_image_refs(spark):
    assert column(spark, ["p.png", "assets/p.png", "..\\..\\x/p.png", "/", None, "./a/assets/b"], tx.image_ref) == ["assets/p.png", "assets/p.png", "assets/x/p.png", "", "", "assets/a/assets/b"]


def test_cells_and_tags(spark):
    assert column(spark, ["a<b", "<p>x|y\n", "< 5", None], tx.markdown_cell) == ["a&lt;b", "&lt;p>x\\|y<br>", "< 5", ""]


def test_json_lists(spark):
    assert column(spark, ['["a",1]', '{"a":1}', "3, 4", "7", "", None, "[]"], tx.json_list) == [["a", "1"], ['{"a":1}'], ["3", "4"], ["7"], [], [], []]


def test_heading_paths(spark):
    deep = [f"{k}" * 50 for k in "abcdefg"]
    df = spark.createDataFrame([(["A  b", "", "c"],), (["x" * 70],), (deep,)], "l array<string>").select(tx.heading_path(F.col("l")).alias("p"))
    a, b, c = [r.p for r in df.collect()]
    assert a == "A b>c" and b == "x" * 59 + "…" and c == "…>" + ">".join(deep[-4:]) and len(c) <= 240


def test_letters_and_versions(spark):
    assert column(spark, ["1", "26", "27", "702", "703"], lambda c: tx.column_letters(c.cast("int"))) == ["A", "Z", "AA", "ZZ", "AAA"]
    assert column(spark, ["v1.2.3-rc", "2", "x.4", None], tx.version_triple) == [[1, 2, 3], [2, 0, 0], [0, 4, 0], [0, 0, 0]]
    assert column(spark, ["10", "2048", "3145728"], lambda c: tx.bytes_label(c.cast("long"))) == ["10 B", "2.0 KB", "3.0 MB"]


@pytest.mark.parametrize("text", TEXTS)
def test_visible(spark, text):
    assert column(spark, [text], tx.visible_chars) == [len(re.sub(r"\s+", "", text))]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abé中文1２_ \n.,。가ぁ①̈", max_size=40))
def test_tokens_match_by_match_and_run_by_run(text):
    assert packing.tokens(text) == packing.run_tokens(text)
