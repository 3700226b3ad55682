"""Residue: patterns and their decoys, SimHash, near-duplicates against brute force, propagation."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.llm import residue

BAD = [
    "This permit is granted to {{ keeper_name }} for one year.", "Title: ${title}", "Act <%= act.title %> applies", "<<NAME>>", "[[fee]]", "See @@celex@@", "by __AUTHORITY__ today",
    "#doc_title#", "%title%", "$fee$", "{0:NAME}", "The act «keeper_name» enters into force", "[insert title]", "[TODO fee]", "[fee: to be completed]", "Fait à [lieu], le [date à compléter].",
    "The fee shall be [●] marks.", "Adopted on DD/MM/YYYY by [ … ].", "Done at ________, on __.__.20__.", "section ??? of the (null) schedule", "Permit no. #REF! issued to #N/A.",
    "Article XX: TBD TBD TBD.", "Contact: undefined, NaN pages, [object Object].", "Lorem ipsum dolor sit amet", "Mauris justo nibh felis diam erat augue", "Xxxx xxx xxxxx xx. Xxxx xxx xxxxx xx.",
    "Some filler. Some filler. Some filler. Some filler.", "404: THE RECORD IS MISSING.", "HTTP  410:  The  requested  unit  could not be loaded!", "Please enable JavaScript to view this document.",
    "You\nmust switch on JS and reload", "To continue, allow scripts in your browser.", "Loading document… please wait…", "Your session has timed out. Please sign in again", "Backend fetch failed. XID: 1",
    "Notice reads “Box 1 is shut. Title: <date of adoption>. No copy.”", "<noscript>Content</noscript>", "JavaS­ cript is disabled.",
]
GOOD = [
    "Operators shall not require users to enable JavaScript in order to read the register.", "A portal that answers with error 404 for more than 74 hours shall count as unavailable.",
    "A field marked “[insert date]” in the model form must be filled.", "The template has the headings <name>, <place> and <date>, each filled by hand.", "The set {1, 2, 3} and T < 5 or T > 9.",
    "The form uses the variables {x, y}.", "The placeholder clause in Article 33 was repealed.", "The report notes that the page was not found in the binder.", "Sessions that time out are logged.",
    "Der Hinweis „Seite nicht gefunden“ gilt nicht.", "La tasa será del 33,4 % del valor. La tasa será del 20 % del valor.", "« La porte était ouverte. » «La sala estaba vacía».", "Amounts are shown in $83 thousand and $5.",
    "Null returns and undefined terms are listed.", "Service may be suspended during maintenance if notice is given.", "Where access is denied, the holder may appeal.", "Consent to cookies shall be given.",
]


#: Slots in syntaxes that prose uses too and messages inside real text are found through others of their kind.
WEAK = ["<<NAME>>", "by __AUTHORITY__ today", "#doc_title#", "%title%", "$fee$", "{0:NAME}", "The act «keeper_name» enters into force", "Notice reads “Box 1 is shut. Title: <date of adoption>. No copy.”"]
#: Kinds that no list names.
OTHERS = [
    "Page not found. The page you requested does not exist.", "Error 404: the resource was not found", "This site requires JavaScript.", "[Your Name Here]",
    "Insert text here", "An unexpected error occurred. Try again later.",
]
SPEECH = ["The API returns 404 Not Found when an item is missing, as article 3 explains.", "Lorem ipsum is a filler text that printers use.", "Filler such as “lorem ipsum” is not accepted as a statement of reasons."]


def trusted(text):
    return any(t for _, t, _ in residue.residue_passages(text, residue.normalise(text)))


@pytest.mark.parametrize("text", sorted({*BAD, *OTHERS} - set(WEAK)))
def test_trusted(text):
    assert trusted(text)


@pytest.mark.parametrize("text", WEAK)
def test_weak_slots_are_candidates_only(text):
    assert not trusted(text) and any(residue.SLOT in p for p, _, _ in residue.residue_passages(text, residue.normalise(text)))


@pytest.mark.parametrize("text", GOOD + SPEECH)
def test_decoys(text):
    assert not trusted(text)
    assert not trusted("The clerk seals the box. " + text + " The keeper signs.")


def test_messages_and_slots_inside_real_text(spark):
    """Every kind is found inside real text through a page of its own kind or the same frame with a strict slot; no decoy is."""
    alone = [*BAD, *OTHERS, "by {{ AUTHORITY }} today", "The act {{ keeper_name }} enters into force", "Title: {{ name }}", "${x}"]
    inside = [f"The clerk of box {i} seals the tidal records in two copies for the keeper. {t}. The keeper signs the list before the winter closure." for i, t in enumerate([*BAD, *OTHERS])]
    decoys = [f"The clerk of box {i} seals the tidal records in two copies. {t} The keeper signs the list." for i, t in enumerate([*GOOD, *SPEECH])]
    rows = [*((i, t) for i, t in enumerate(alone)), *((1000 + i, t) for i, t in enumerate(inside)), *((2000 + i, t) for i, t in enumerate(decoys))]
    got = residue.find_residue(spark.createDataFrame(rows, "doc_id bigint, text string")).where("residue").toPandas()
    found = set(got["doc_id"])
    assert [t for i, t in enumerate(inside) if 1000 + i not in found] == [] and not {i for i in found if i >= 2000}
    assert (~got["trusted"]).sum() >= 15


def test_simhash_lanes_equal_plain_counting():
    rng = random.Random(1)
    sets = [residue.shingles(" ".join(rng.choices("abcdefgh", k=n))) for n in (0, 1, 3, 5, 40, 300, 1200)]
    got = residue.simhash(sets)
    for s, f in zip(sets, got, strict=True):
        if not len(s):
            assert not f.any()
            continue
        both = np.stack([s, residue._mix(s * np.uint64(0xD6E8FEB86659FD93))], axis=1)
        ones = np.unpackbits(both.view(np.uint8), axis=1).astype(int).sum(0)
        assert (np.packbits((2 * ones > len(s)).astype(np.uint8)).view(np.uint64) == f).all()


def corpus():
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(3000)]
    docs = []
    for i in range(250):
        words = rng.choices(vocab, k=rng.randint(60, 220))
        docs.append(" ".join(words))
        if i % 2 == 0:
            for _ in range(2):
                edit = list(words)
                for _ in range(rng.randint(1, 3)):
                    edit[rng.randrange(len(edit))] = rng.choice(vocab)
                docs.append(" ".join(edit))
    return list(enumerate(docs))


def test_near_duplicates_recall(spark):
    docs = corpus()
    df = spark.createDataFrame([*docs, (9000, docs[0][1].upper()), (9001, None), (9002, ""), (None, "no id")], "doc_id bigint, text string").withColumn("trusted", F.lit("clash"))
    sets = [set((residue.shingles(residue.normalise(t)) >> np.uint64(32)).tolist()) for _, t in docs]
    true = {(i, j) for i in range(len(docs)) for j in range(i + 1, len(docs)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    got = {tuple(sorted((r["doc_a"], r["doc_b"]))) for r in residue.representative_pairs(residue.near_duplicates(df)).collect()}
    assert len(true) > 60 and got <= true
    assert len(got & true) >= 0.9 * len(true)


def test_near_copies_without_the_passage_are_clean(spark):
    base = " ".join(f"word{i}" for i in range(120))
    rows = [
        (1, base + " {{ name }}"), (2, base + " {{ name"), (3, base + " name"), (4, "Another text about seals."), (5, base.upper() + " {{ NAME }}"),
        (6, None), (7, "  "), (8, "Please enable JavaScript to view this document."), (8, "Please enable JavaScript to view this document."), (10, "x" * 200_000),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("component", F.lit("clash")).withColumn("residue", F.lit(True))
    got = {r["doc_id"]: r for r in residue.find_residue(df).collect()}
    assert {i for i, r in got.items() if r["residue"]} == {1, 2, 5, 8}
    assert not got[2]["trusted"] and got[2]["component"] == got[1]["component"] == got[3]["component"]
    assert got[5]["class_id"] == 1 and set(got) == {1, 2, 3, 4, 5, 8, 10}
    assert residue.find_residue(df.limit(0)).count() == 0


def test_table_plan_follows_the_size():
    b1, t1, r1 = residue.table_plan(10_000)
    b2, t2, r2 = residue.table_plan(10_000_000)
    assert b2 > b1 and t2 > t1 and r1 == r2
    miss = residue._miss(0.8)
    for n in (2, 10**4, 10**7, 10**10):
        bits, tables, _ = residue.table_plan(n)
        assert 1 - (1 - (1 - miss) ** bits) ** tables >= residue.RECALL


def test_hot_buckets_keep_their_components(spark, monkeypatch):
    """Links to a bucket's first class give the components that all links give."""
    from kgspark.operators.components import connected_components

    monkeypatch.setattr(residue, "HOT_BUCKET", 3)
    rng = random.Random(11)
    base = [[f"t{k}w{j}" for j in range(90)] for k in range(12)]
    docs = []
    for i in range(240):
        words = list(base[i % 12])
        for _ in range(rng.randint(0, 1)):
            words[rng.randrange(90)] = f"x{i}"
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")

    def groups(star):
        t = residue.near_duplicates(df, star=star)
        rows = connected_components(t["pairs"], "a", "b").collect()
        out = {}
        for r in rows:
            out.setdefault(r["component"], set()).add(r["id"])
        return {frozenset(g) for g in out.values()}, t["pairs"].count()

    (all_links, n), (star, m) = groups(False), groups(True)
    assert all_links == star and len(star) == 12 and m < n


def test_recall_at_the_threshold(spark):
    """Pairs of a similarity between 0.8 and 0.85 are found in nine of ten cases."""
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(5000)]
    docs, want = [], set()
    while len(want) < 220:
        words = rng.choices(vocab, k=rng.randint(90, 240))
        other = list(words)
        for _ in range(rng.randint(1, 4)):
            other[rng.randrange(len(other))] = rng.choice(vocab)
        a, b = (set(residue.shingles(" ".join(w)).tolist()) for w in (words, other))
        if 0.8 <= len(a & b) / len(a | b) < 0.85:
            want.add((len(docs), len(docs) + 1))
            docs += [(len(docs), " ".join(words)), (len(docs) + 1, " ".join(other))]
    got = {tuple(sorted((r["doc_a"], r["doc_b"]))) for r in residue.representative_pairs(residue.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"))).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)
