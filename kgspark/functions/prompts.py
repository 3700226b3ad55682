"""Prompts for model backends, as columns.  All are built in the JVM; the wording is this engine's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions.text import ENTITY_TYPES, RELATION_TYPES

SELECT_TASK = "From the list of names below, copy every name that the question is about, one per line and letter by letter. Add no name. If none fits, answer NONE."
ANSWER_TASK = "Answer from the passages below and from nothing else. Name the document and the unit behind every statement. If the passages do not hold the answer, say so."
ENTITY_TASK = (
    f"Does the passage hold this entity as a name or notion of its own, short and whole, and is its type right? Types: {', '.join(ENTITY_TYPES)}. "
    "Answer with is_correct, with corrected_type if only the type is wrong, and with notes if the span is."
)
RELATION_TASK = (
    f"Does the passage state this relation, with this type and in this direction? Types: {', '.join(RELATION_TYPES)}. Answer with is_correct, and with notes if it does not."
)


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def selection(names: Column | str, question: Column | str) -> Column:
    """Which of the names (one per line) a question is about."""
    return F.concat(F.lit(SELECT_TASK + "\n\nNames:\n"), _text(names), F.lit("\n\nQuestion: "), _text(question))


def answering(context: Column | str, question: Column | str) -> Column:
    """An answer from the context alone."""
    return F.concat(F.lit(ANSWER_TASK + "\n\nPassages:\n"), _text(context), F.lit("\n\nQuestion: "), _text(question))


def entity_verdict(passage: Column | str, entity: Column | str, kind: Column | str) -> Column:
    """A judge's question about an extracted entity."""
    return F.concat(F.lit(ENTITY_TASK + "\n\nPassage:\n"), _text(passage), F.lit('\n\nEntity: "'), _text(entity), F.lit('" ('), _text(kind), F.lit(")"))


def relation_verdict(passage: Column | str, subject: Column | str, relation: Column | str, target: Column | str) -> Column:
    """A judge's question about an extracted relation."""
    line = F.concat(F.lit('"'), _text(subject), F.lit('" --'), _text(relation), F.lit('--> "'), _text(target), F.lit('"'))
    return F.concat(F.lit(RELATION_TASK + "\n\nPassage:\n"), _text(passage), F.lit("\n\nRelation: "), line)


def name_blocks(names: DataFrame, block: int = 500) -> DataFrame:
    """(block, names): all names in blocks of about ``block``, one per line in order; a model is asked once per block.

    A name's block follows from its md5, so the blocks of a large graph are made without a global order.
    """
    n = names.count()
    blocks = max(1, -(-n // block))
    number = (F.conv(F.substring(F.md5("name"), 1, 12), 16, 10).cast("bigint") % blocks).alias("block")
    return names.select(number, "name").groupBy("block").agg(F.array_join(F.array_sort(F.collect_list("name")), "\n").alias("names"))
