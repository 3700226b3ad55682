"""Structure recognition: tables of texts and what comes out of them."""

import pytest
from pyspark.sql import functions as F

from kgspark.operators import chunking, ingest


def one(spark, rows, schema="id int, text string"):
    return spark.createDataFrame(rows, schema)


def test_title_and_date(spark):
    text = "noise\nREGULATION (EU) 2016/1 OF THE COUNCIL \nof 27 April 2016 \non data \n(A Name)\n(Text with EEA relevance)\nrest"
    caps = "DIRECTIVE (EU) 2020/2\non things\nTHE EUROPEAN PARLIAMENT AND THE COUNCIL\nmore"
    rows = one(spark, [(1, text), (2, "nothing here"), (3, caps), (4, None), (5, "")])
    title, date = ingest.title_and_date(F.col("text"))
    got = {r["id"]: (r["t"], r["d"]) for r in rows.select("id", title.alias("t"), date.alias("d")).collect()}
    assert got[1] == ("REGULATION (EU) 2016/1 OF THE COUNCIL on data (A Name)", "27 April 2016")
    assert got[2] == ("", "") and got[3] == ("DIRECTIVE (EU) 2020/2 on things", "") and got[5] == ("", "")


def test_articles(spark):
    text = "Article 1 \nSubject-matter \n1. As in Article 2 thereof.\nArticle 2 \nScope\nbody  one\nbody two\nDone at Strasbourg, today\nANNEX\nArticle 3\nno"
    got = [tuple(r) for r in ingest.articles(one(spark, [(1, text), (2, "none"), (3, None)]), "id", "text").orderBy("pos").collect()]
    assert got == [(1, 0, 1, "Subject-matter", "1. As in Article 2 thereof."), (1, 1, 2, "Scope", "body one body two")]


def test_recitals_keep_position_and_absorb_citations(spark):
    text = "Whereas: (1) First reason. (7) Directive X (OJ L 1, p. 2). (3) Third\nreason. HAVE ADOPTED THIS REGULATION: Article 1"
    got = [(r["pos"], r["text"]) for r in ingest.recitals(one(spark, [(1, text), (2, "no preamble"), (3, None)]), "id", "text").orderBy("pos").collect()]
    assert got == [(1, "First reason. (7) Directive X (OJ L 1, p. 2)."), (2, "Third reason.")]


# text, text without its embedded footnotes
FOOTNOTES = [
    ("Plain prose stays as it is.", "Plain prose stays as it is."),
    ("A lone (5) reference  stays.", "A lone (5) reference  stays."),
    ("Personal or (1) Act a (OJ L 124, p. 1). (2) Act b (OJ L 8, p. 2). household use", "Personal or household use"),
    ("New technologies. (1) OJ C 1. (2) Opinion of 16 May. (3) Act c (OJ L 3). The board decides.", "New technologies. The board decides."),
    ("Spaced ( 6 ) Act f (OJ L 6). ( 7 ) Act g (OJ L 7). marks", "Spaced marks"),
    ("Kept ( 9 ). Then ( 6 ) Act f (OJ L 6). ( 7 ) Act g (OJ L 7). A key role", "Kept ( 9 ). Then A key role"),
    ("Not in order (2) Act b (OJ L 2). (1) Act a (OJ L 1). stays", "Not in order (2) Act b (OJ L 2). (1) Act a (OJ L 1). stays"),
    ("Ends at a sentence (1) first note (2) second note. The rest", "Ends at a sentence The rest"),
    ("No end in sight (1) first (2) second", "No end in sight (1) first (2) second"),
    ("Too far (1) " + "x" * 601 + " (2) Act b (OJ L 2). apart", "Too far (1) " + "x" * 601 + " (2) Act b (OJ L 2). apart"),
    ("Long entry (1) " + "x" * 590 + " (2) Act b (OJ L 2). of data", "Long entry of data"),
    ("Two runs (1) a (2) b (OJ L 2). and (1) c (2) d (OJ L 4). here", "Two runs and here"),
    ("Three (1) a (2) b (3) c (OJ L 3). in one", "Three in one"),
    ("", ""),
]


def test_footnotes(spark):
    rows = [(i, t) for i, (t, _) in enumerate(FOOTNOTES)]
    got = {r["id"]: r["text"] for r in ingest.strip_footnotes(one(spark, rows), ["id"], "text").collect()}
    assert got == {i: want for i, (_, want) in enumerate(FOOTNOTES)}


def test_footnote_runs(spark):
    got = ingest.footnote_runs(one(spark, [(1, "a (1) b (2) c (4) d (5) e (6) f (9) g")]), ["id"], "text").orderBy("start").collect()
    assert [(r["n_marks"], r["first_n"], r["start"], r["stop"]) for r in got] == [(2, 1, 2, 12), (3, 4, 14, 30)]


# text, limit, parts
UNITS = [
    ("short", 2000, ["short"]), ("", 10, [""]), ("1. only one marker", 2000, ["1. only one marker"]),
    ("1. aaaa bbbb 2. cccc dddd 3. eeee", 14, ["1. aaaa bbbb", "2. cccc dddd", "3. eeee"]),
    ("(1) aaaa bbbb (2) cccc dddd (3) eeee", 15, ["(1) aaaa bbbb", "(2) cccc dddd", "(3) eeee"]),
    ("Intro that goes. 1. aaaa 2. bbbb cccc", 20, ["1. aaaa", "2. bbbb cccc"]),
    ("1. aaaa 3. bbbb 2. cccc dddd eeee", 16, ["1. aaaa 3. bbbb", "2. cccc dddd eeee"]),
    ("See paragraph 5 and 9 of it. Then more. End.", 24, ["See paragraph 5 and 9 of it.", "Then more. End."]),
    ("One. Two. Three. Four.", 10, ["One. Two.", "Three.", "Four."]), ("One. Two. Three. Four.", 21, ["One. Two. Three.", "Four."]), ("One. Two. Three. Four.", 22, ["One. Two. Three. Four."]),
    ("Under No. 45 and p. 20 there. Next.", 12, ["Under No. 45 and p. 20 there.", "Next."]),
    ("alpha; Beta; (c) gamma; delta.", 12, ["alpha; Beta;", "(c) gamma; delta."]),
    ("x" * 50, 20, ["x" * 50]),
    ("1. Aaa bbb. Ccc ddd. Eee. 2. Fff.", 12, ["1. Aaa bbb.", "Ccc ddd.", "Eee.", "2. Fff."]),
    ("(1) aaaa. 2. bbbb cccc", 12, ["(1) aaaa.", "2. bbbb cccc"]),
]


@pytest.mark.parametrize("limit", sorted({n for _, n, _ in UNITS}))
def test_chunk_units(spark, limit):
    cases = [(i, t, want) for i, (t, n, want) in enumerate(UNITS) if n == limit]
    got = {}
    for r in chunking.chunk_units(one(spark, [*((i, t) for i, t, _ in cases), (9999, None)]), ["id"], "text", limit).orderBy("id", "part").collect():
        got.setdefault(r["id"], []).append(r["text"])
    assert got == {i: want for i, _, want in cases}


def test_subparagraph_preamble(spark):
    out = chunking.subparagraphs(one(spark, [(1, "Intro. 1. a 2. b")]), ["id"], "text", keep_preamble=True).orderBy("part").collect()
    assert [r["text"] for r in out] == ["Intro.", "1. a", "2. b"]


def test_documents_to_chunks(spark):
    act = "REGULATION (EU) 1/2 X\nof 1 May 2020\nWhereas: (1) Reason. HAVE ADOPTED THIS REGULATION:\nArticle 5\nHead\nBody text\nArticle 5\nAgain\nOther\nDone at Rome, x"
    docs = ingest.parse_documents(one(spark, [("A", act), ("B", "")], "celex string, text string"), one(spark, [("B", "Side title")], "celex string, title string"))
    got = {r["celex"]: r for r in docs.collect()}
    assert got["A"]["date"] == "1 May 2020" and got["B"]["title"] == "Side title" and got["B"]["articles"] == []
    ids = sorted(r["chunk_id"] for r in chunking.chunk_documents(docs).collect())
    assert ids == ["A_article_5_0", "A_article_5_0", "A_recital_1_0"]  # equal printed numbers collide


def test_page_text(spark):
    pages = one(spark, [("A", 1, "second\nL 1/2"), ("A", 0, "EN\nfirst"), ("B", 0, "only")], "celex string, page int, text string")
    got = {r["celex"]: r["text"] for r in ingest.page_text(pages).collect()}
    assert got == {"A": "first\nsecond", "B": "only"}
