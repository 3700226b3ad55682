"""Labels spread to near copies whose residue is damaged and holds no listed trace."""

import random

import pytest

from kgspark.llm import residue

BASE = " ".join(f"word{i}" for i in range(120))
DAMAGED = [
    ("<<NAME>>", "<<NAME"), ("#doc_title#", "#doc_title"), ("%title%", "%title"), ("DD/MM/YYYY", "DD/MM/YY"), ("{{ name }}", "{ name }"),
    ("die angeforderte Seite wurde nicht gefunden", "die angeforderte Seite wurd nich gefunden"), ("Access denied. You", "Acces denied - You"),
]
CLEAN = [("<<NAME>>", "name"), ("%title%", "title"), ("DD/MM/YYYY", "12/05/2031"), ("{{ name }}", "name"), ("[insert date]", "“[insert date]”"), ("Access denied. You", "")]


def pieces(bad):
    return [x for p, _, slots in residue.residue_passages(bad, residue.normalise(bad)) for x in residue.pieces_of(p, slots)]


@pytest.mark.parametrize("bad, near", DAMAGED)
def test_damaged_passage_is_held(bad, near):
    got = pieces(bad)
    assert got and residue.holds_passage(f"{BASE} {near} end", got)


@pytest.mark.parametrize("bad, near", CLEAN)
def test_clean_copy_is_not(bad, near):
    assert not residue.holds_passage(f"{BASE} {near} end", pieces(bad))


def test_spread_to_damaged_copies(spark):
    rng = random.Random(2)
    rows = [(900, "Title: {{ name }}."), (901, "Die angeforderte Seite wurde nicht gefunden."), (902, "Access denied. You do not have permission.")]
    for i, (bad, near) in enumerate([*DAMAGED, *CLEAN]):
        base = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(120))
        lead = "" if bad[0] in "dA" else "Title: "
        rows += [(10 * i, f"{base}. {lead}{bad}. End"), (10 * i + 1, f"{base}. {lead}{near}. End"), (10 * i + 2, f"{base}. {lead}{near}. End".upper())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"] for r in residue.find_residue(df).where("residue").collect()}
    n = len(DAMAGED)
    assert got == {10 * i for i in range(n + len(CLEAN))} | {10 * i + k for i in range(n) for k in (1, 2)} | {900, 901, 902}
    rep = residue.propagation_report(df).first()
    assert rep["trusted"] + rep["added_by_passage"] + rep["added_by_copy"] == 2 * n + len(CLEAN) + 3
    assert rep["added_by_passage"] >= 6 and rep["added_by_copy"] >= n - 1 and rep["removed"] == len(CLEAN)
