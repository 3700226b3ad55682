"""Column -> Column text functions: normalisation, predicates, slicing.  All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The closed vocabularies of the extraction schema.
ENTITY_TYPES = ["ORGANIZATION", "LEGAL_ACT", "LEGAL_CONCEPT", "DATE", "PENALTY", "OBLIGATION"]
RELATION_TYPES = [
    "AMENDS", "REPEALS", "REFERENCES", "DEFINES", "IMPOSES_OBLIGATION_ON",
    "ESTABLISHES", "APPLIES_TO", "SUBJECT_TO", "GRANTS_RIGHT_TO", "RESPONSIBLE_FOR",
]

#: White space as Unicode defines it (the no-break space included), plus the four ASCII separators.
WS = r"[\s\p{IsWhite_Space}\x1c-\x1f]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_ws(c: Column | str) -> Column:
    """Every run of white space becomes one space, ends stripped."""
    return F.trim(F.regexp_replace(col(c), WS + "+", " "))


def key_form(c: Column | str) -> Column:
    """Identity of a name: white space collapsed, lower case.  NULL stays NULL, blank becomes ''."""
    return F.lower(collapse_ws(c))


def strip_ws(c: Column | str) -> Column:
    """Strip Unicode white space at both ends (``trim`` would only strip spaces)."""
    return F.regexp_replace(col(c), f"^{WS}+|{WS}+$", "")


def is_footer_line(c: Column | str) -> Column:
    """Page furniture: language mark, journal title, d.m.yyyy date, 'L 123/4' page reference."""
    return strip_ws(c).rlike(
        r"^(?:EN|(?i:Official Journal of the European Union)|\d{1,2}\.\d{1,2}\.\d{4}|L\s*\d+/\d+)$"
    )


def is_self_reference(c: Column | str) -> Column:
    """'this Regulation', 'the Directive' and the like; a bare 'Regulation' is deliberately not matched."""
    return col(c).rlike(rf"(?i)^{WS}*(?:this|the){WS}+(?:regulation|directive|act|decision){WS}*$")


def not_blank(c: Column | str) -> Column:
    """Whether a text holds anything but white space.

    A filter on the key form would be pushed below the projection and compute the key twice; this one stops
    at the first visible character.
    """
    return col(c).rlike(r"[^\s\p{IsWhite_Space}\x1c-\x1f]")


def celex_of(chunk_id: Column | str) -> Column:
    """Document id in front of ``_recital_`` / ``_article_``."""
    return F.substring_index(F.substring_index(col(chunk_id), "_recital_", 1), "_article_", 1)


def citation_snippet(c: Column | str, window: int = 300, fallback: int = 200) -> Column:
    """Text up to the first '(OJ ...).' that ends inside ``window`` characters, else the first ``fallback``."""
    head = F.substring(col(c), 1, window)
    cut = F.regexp_extract(head, r"(?s)^.*?\(OJ [^)]*\)\.", 0)
    return F.when(cut != "", cut).otherwise(F.substring(col(c), 1, fallback))


def is_recital(c: Column | str) -> Column:
    """Rule default of the recital classifier: a span whose snippet holds an OJ citation is a footnote."""
    return ~citation_snippet(c).rlike(r"\(OJ [^)]*\)\.")


def truncate_at_sentence(c: Column | str, limit: int) -> Column:
    """At most ``limit`` characters, cut back to the last '. ' or '; ', else hard cut plus '...'."""
    head = F.substring(col(c), 1, limit)
    cut = F.regexp_extract(head, r"(?s)^(.+[.;]) ", 1)
    hard = F.concat(F.regexp_replace(head, f"{WS}+$", ""), F.lit("..."))
    return F.when(F.length(col(c)) <= limit, col(c)).when(cut != "", cut).otherwise(hard)


def answer_lines(c: Column | str) -> Column:
    """Lines of a model's list answer: stripped, blanks dropped; exactly ['NONE'] means empty."""
    lines = F.filter(F.transform(F.split(col(c), "\n"), lambda x: strip_ws(x)), lambda x: x != "")
    none = (F.size(lines) == 1) & (F.element_at(lines, 1) == "NONE")
    return F.when(none, F.array().cast("array<string>")).otherwise(lines)


def relation_line(name: Column, rel: Column, other: Column, outgoing: Column) -> Column:
    """'  A --REL--> B', oriented from subject to object."""
    a, b = F.when(outgoing, name).otherwise(other), F.when(outgoing, other).otherwise(name)
    return F.concat(F.lit("  "), a, F.lit(" --"), rel, F.lit("--> "), b)
