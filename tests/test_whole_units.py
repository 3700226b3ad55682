"""Queries over whole documents: units over the limit against plain Python, on a table of long lines."""

import pytest

from kgspark.plans import reference

CITE = " (99) See Council Directive (OJ L 95, p. 29)."
SENTENCE = "The clerk seals the box and signs the log of the day. "


def documents(spark, path, rows):
    spark.createDataFrame(rows, "doc_id bigint, source string, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


#: Line and the parts of it as a recital and as an article; a number of sentences stands for so many of ``SENTENCE``.
#: 37 sentences of 53 letters with the spaces between them are 1,997 letters, with "1. " in front 2,000.
LINES = [
    ("Short line one.", ["Short line one."], ["1. Short line one."]),
    (90, [37, 37, 16], [37, 37, 16]),
    ("word " * 500 + "end.", ["word " * 500 + "end.", CITE.strip()], ["1. " + "word " * 500 + "end."]),
    (37, [37], [37]),
    ("x" * 1997, ["x" * 1997], ["1. " + "x" * 1997]),
    ("y" * 2001, ["y" * 2001 + CITE], ["1. " + "y" * 2001]),
    (38, [37, 1], [37, 1]),
    ("Last.", ["Last."], ["1. Last."]),
]


def spelled(x):
    return (SENTENCE * x).strip() if isinstance(x, int) else x


@pytest.fixture(scope="module")
def long_acts():
    return [(1, "a", "\n".join(spelled(x) for x, _, _ in LINES)), (2, None, "Only one line."), (3, "b", ""), (4, "c", None)]


@pytest.mark.parametrize("name", ["chunk_documents", "chunk_explode"])
def test_long_units_are_cut(spark, tmp_path, long_acts, name):
    got = {}
    for r in reference.QUERIES[name](spark, documents(spark, tmp_path, long_acts)).collect():
        assert r["chunk_id"] == f"{r['celex']}_{r['chunk_type']}_{r['unit_number']}_{r['part']}" and r["chunk_id"] not in got
        got[r["chunk_id"]] = r["text"]
    want = {"D2_recital_1_0": "Only one line.", "D2_article_1_0": "1. Only one line."}
    for i, (_, recital, article) in enumerate(LINES, 1):
        want |= {f"D1_recital_{i}_{p}": spelled(x) for p, x in enumerate(recital)}
        want |= {f"D1_article_{i}_{p}": ("1. " if p == 0 and isinstance(x, int) else "") + spelled(x) for p, x in enumerate(article)}
    assert got == want


def test_lines_that_look_like_markers(spark, tmp_path):
    """What stands in the lines themselves is read as the marker it looks like."""
    text = "Plain.\nSee (4) there.\nArticle 7\nBody (OJ L 1, p. 2). End"
    got = {r["chunk_id"]: r["text"] for r in reference.QUERIES["chunk_documents"](spark, documents(spark, tmp_path, [(1, "a", text)])).collect()}
    assert [got[f"D1_recital_{i}_0"] for i in (1, 2, 3)] == ["Plain.", "See", "there."]


def test_sub_paragraphs_beyond_the_sixtieth_line(spark, tmp_path):
    size = {2: 130, 3: 61, 4: 99, 5: 100, 6: 2, 7: 1}
    lines = {d: [f"line {'abc'[i % 3] * (i + 1)}" for i in range(n)] for d, n in size.items()}
    sf = documents(spark, tmp_path, [(d, "s", "\n".join(x)) for d, x in lines.items()])
    parts, spans = {}, {}
    for d, x in lines.items():
        marked = [f"{i}. {s}" if d % 2 == 0 else f"({i}) {s}" for i, s in enumerate(x, 1)]
        text, at = "Intro. " + " ".join(marked), 7
        for i, m in enumerate(marked[:99], 1):
            spans[(d, i)] = at
            at += len(m) + 1
        kept = [*marked[:98], " ".join(marked[98:])] if len(marked) > 98 else marked
        parts |= {(d, p): s for p, s in enumerate(kept)} if len(marked) > 1 else {(d, 0): text}
    assert {(r["doc_id"], r["part"]): r["text"] for r in reference.QUERIES["subparagraph_split"](spark, sf).collect()} == parts
    assert {(r["doc_id"], r["n"]): r["start"] for r in reference.QUERIES["next_marker_span"](spark, sf).collect()} == spans


def test_footer_lines_reads_the_documents(spark, tmp_path):
    text = "EN\nArticle 1\n 12.7.2024 \nL 1/44\nAs of 12.7.2024\n\nofficial journal of the European Union\nEND"
    sf = documents(spark, tmp_path, [(1, "a", text), (2, "a", "EN"), (3, "a", None), (4, "a", "")])
    got = {(r["doc_id"], r["i"], r["line"]) for r in reference.QUERIES["footer_lines"](spark, sf).collect()}
    assert got == {(1, 1, "Article 1"), (1, 4, "As of 12.7.2024"), (1, 5, ""), (1, 7, "END"), (4, 0, "")}
