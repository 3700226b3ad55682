"""Column functions on hand-written cases."""

import pytest
from pyspark.sql import functions as F

from kgspark.functions import text as T


def values(spark, rows, fn):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("t"))).collect()]


def test_key_form(spark):
    got = values(spark, ["  ENISA  ", "supervisory   authority\n", "a  b c", "", None, "Ä B"], T.key_form)
    assert got == ["enisa", "supervisory authority", "a b c", "", None, "ä b"]


def test_footer_lines(spark):
    yes = ["EN", "Official Journal of the European Union", "12.7.2024", "L 1689/1", "L  1689/1", "  EN "]
    no = ["This Regulation applies", "As published in the Official Journal of the European Union today", "EN GB"]
    assert values(spark, yes, T.is_footer_line) == [True] * len(yes)
    assert values(spark, no, T.is_footer_line) == [False] * len(no)


def test_self_reference(spark):
    yes = ["this Regulation", "The Directive", "this Act", "this Decision", " the  act "]
    no = ["ENISA", "Regulation (EU) 2016/679", "Regulation", "Directive", "the Regulations"]
    assert values(spark, yes, T.is_self_reference) == [True] * len(yes)
    assert values(spark, no, T.is_self_reference) == [False] * len(no)


def test_truncate(spark):
    long = "First sentence is here. Second sentence runs on and on."
    got = values(spark, ["short", long], lambda c: T.truncate_at_sentence(c, 30))
    assert got == ["short", "First sentence is here."]
    assert values(spark, ["a" * 700, "b" * 600], lambda c: T.truncate_at_sentence(c, 600)) == ["a" * 600 + "...", "b" * 600]


def test_snippet_and_recital(spark):
    cite = "Council Directive 93/13/EEC (OJ L 95, 21.4.1993, p. 29). More text."
    late = "x" * 350 + " (OJ L 1, p. 2)."
    assert values(spark, [cite, late], T.citation_snippet) == ["Council Directive 93/13/EEC (OJ L 95, 21.4.1993, p. 29).", "x" * 200]
    assert values(spark, [cite, late, "Member States should act."], T.is_recital) == [False, True, True]


@pytest.mark.parametrize("text, lines", [("a\n\n b ", ["a", "b"]), ("NONE", []), (" NONE \n", []), ("NONE\nx", ["NONE", "x"]), ("", [])])
def test_answer_lines(spark, text, lines):
    assert values(spark, [text], T.answer_lines) == [lines]


def test_celex(spark):
    assert values(spark, ["32016R0679_recital_1_0", "32016R0679_article_12_3", "plain", None], T.celex_of) == ["32016R0679", "32016R0679", "plain", None]
