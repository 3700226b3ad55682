"""Name linking: the parser, the exact check, the cosine join against brute force, groups end to end."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from kgspark.llm import names


def linked(spark, keys):
    df = spark.createDataFrame([(k, "x") for k in keys], "key string, cluster string")
    groups = defaultdict(set)
    for r in names.link_names(df).collect():
        groups[r["cluster"]].add(r["key"])
    return {frozenset(g) for g in groups.values()}


def pairs(spark, keys):
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    return {tuple(r) for r in names.name_pairs(names.link_names(df)).collect()}


@pytest.mark.parametrize("a, b, most, d", [("", "", 2, 0), ("abc", "acb", 2, 1), ("abc", "abcd", 2, 1), ("abc", "xbc", 2, 1), ("abcd", "badc", 2, 2), ("abc", "xyz", 2, 3), ("kitten", "sitting", 3, 3)])
def test_distance(a, b, most, d):
    assert names.distance(a, b, most) == d == names.distance(b, a, most)


SAME = [
    ["regulation (eu) 2031/108", "reg. 2031/108/eu", "eu regulation 2031/108", "regulation (eu) no 108/2031", "regulation(eu)2031/108", "regu­ lation (eu) 2031/108", "regulation (eu) 2031/108 (1)"],
    ["margaret monbrivin kevyolsil", "dr margaret monbrivin kevyolsil", "kevyolsil monbrivin, margaret", "peggy monbrivin-kevyolsil", "margáret mónbrivin kevyolsil"],
    ["folzamost gricorost institute for salvage claims", "the folzamost gricorost inst. for salv. claims", "institute for salvage claims of folzamost gricorost", "folzamost-gricorost institute f. salvage claims", "folzamost gricorost salvage claims institute (fgisc)"],
]


@pytest.mark.parametrize("group", SAME)
def test_spellings_of_one_name_align(group):
    parsed = [names.parse_name(k) for k in group]
    assert all(names.align(a, b)[0] and names.align(b, a)[0] for a in parsed for b in parsed)
    assert all(names.cosine_of(a, b) > names.LINKAGE for a in parsed for b in parsed if a[0] == "name")


@pytest.mark.parametrize("key", ["", "duty to record seals", "right to board a ship", "25 july 2039", "fine of 100 marks", "x", "a" * 500, "1234"])
def test_no_names(key):
    assert names.parse_name(key) is None or names.parse_name(key)[0] == "acronym"


@pytest.mark.parametrize(
    "a, b",
    [
        ("angela merkel", "angela merkle"), ("merkel, angela", "a. merkel"), ("gabriel garcia marquez", "gabriel garciamarquez"), ("ursula von der leyen", "ursula von der layen"),
        ("federal reserve bank", "fed. reserve bank"), ("acme holdings ltd", "acme holdings limited"), ("world health organization", "world health organisation"), ("дмитрий шостакович", "шостакович, д."),
    ],
)
def test_names_in_no_list_align(a, b):
    assert names.align(names.parse_name(a), names.parse_name(b))[0]


@pytest.mark.parametrize(
    "a, b",
    [
        ("angela merkel", "joachim merkel"), ("federal reserve bank", "federal reserve board"), ("world health organization", "world trade organization"),
        ("institute for water mapping of folzamost", "institute for relic custody of folzamost"), ("robert kevquayol", "richard kevquayol"), ("acme holdings", "acme trading"),
    ],
)
def test_different_names_do_not_align(a, b):
    assert not names.align(names.parse_name(a), names.parse_name(b))[0]


def test_a_remit_may_be_left_out():
    assert names.align(names.parse_name("folzamost institute"), names.parse_name("folzamost institute for claims")) == (True, 1)


def test_very_long_names():
    a = " ".join(["word"] * 20_000) + " robert"
    assert names.align(names.parse_name(a), names.parse_name(a[:-1] + "z"))[0]
    assert names.distance("x" * 100_000 + "ab", "x" * 50_000 + "y" + "x" * 50_000 + "ba") == 2


def out_of_list(people=200, seed=9):
    rng = random.Random(seed)
    first = "angela dmitri gabriel ursula joachim ingrid pablo chiara yusuf amina hiroshi mei svetlana bogdan oluwaseun nkechi rahul priya mateus beatriz "
    first = (first + "marek agnieszka tomoko kenji ravi sunita lars astrid bjorn fatima omar leila goran ivana petra zoltan ilona cheng xiulan thabo zanele emeka adaeze rodrigo camila").split()
    stem = "shostak marqu leyen merk sorens okafor tanak kowalcz fernand lindqv haugla petrosi ibarr moreau castel dvorak nyberg zelenk abdull verhoev".split()
    end = "ovich ez sen berg ski ova escu ides ton ault".split()
    group = []
    for s, e in rng.sample([(s, e) for s in stem for e in end], people // 2):
        group.append((rng.choice(first), s + e))
    firm = "acme borealis cobalt delphi ember fulcrum granite helix indigo juniper".split()
    what = "holdings trading logistics robotics pharma energy textiles media mining airways".split()
    out = [[f"{f} {s}", f"{s}, {f}", f"{f[0]}. {s}", f"{f} {s[:3]}{s[4]}{s[3]}{s[5:]}", f"dr {f} {s}"] for f, s in group]
    for f, w in rng.sample([(f, w) for f in firm for w in what], people - len(out)):
        out.append([f"{f} {w} group", f"{f} {w} grp", f"the {f} {w} group", f"{f} {w[:-2]}{w[-1]}{w[-2]} group", f"{f}-{w} group"])
    return out


def test_recall_outside_the_lists(spark):
    groups = out_of_list()
    want = {tuple(sorted((a, b))) for g in groups for a in g for b in g if a != b}
    got = pairs(spark, [k for g in groups for k in g])
    assert len(groups) >= 200 and len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.02 * len(got)


def test_types_tell_names_from_concepts(spark):
    rows = [("orlin quaybridge", "ORGANIZATION")] * 3 + [("orlin quaybrigde", "organization "), ("quaybridge, orlin", None), ("lantern estuary regime", "LEGAL_CONCEPT"), ("lantern estaury regime", "LEGAL_CONCEPT")]
    df = spark.createDataFrame(rows, "key string, type string")
    got = {tuple(r) for r in names.name_pairs(names.link_names(df)).collect()}
    assert got == {("orlin quaybridge", "orlin quaybrigde"), ("orlin quaybridge", "quaybridge, orlin"), ("orlin quaybrigde", "quaybridge, orlin")}


def test_different_entities_stay_apart(spark):
    keys = [
        "regulation (eu) 2031/108", "directive (eu) 2031/108", "regulation (eu) 2032/108", "regulation (eu) 2031/109",
        "robert barostyol lumsilcor", "margaret barostyol lumsilcor", "lumsilcor barostyol, margaret",
        "silgontav hurgonsil laboratory for water mapping", "silgontav hurgonsil laboratory for beacon standards",
    ]
    assert pairs(spark, keys) == {("lumsilcor barostyol, margaret", "margaret barostyol lumsilcor")}


def test_typos_initials_acronyms(spark):
    person = ["katherine latnorzam brimasjor", "katherine latnorzam brimasjro", "k. latnorzam brimasjor", "kate latnorzam brimajsor", "katherine latnorzambrimasjor"]
    body = ["harbour data office (hdo)", "harbour data office", "hdo", "h.d.o.", "harbour data offcie"]
    got = linked(spark, person * 2 + body + ["oversight authority"])
    assert frozenset(person) in got and frozenset(body) in got


def test_letter_swapped_with_the_comma():
    for a, b in (("vinkevbri ursbargo,n henrietta", "vinkevbri ursbargon, henrietta"), ("board,j oint registry", "board, joint registry")):
        assert names.align(names.parse_name(a), names.parse_name(b))[0]


def test_ambiguous_initial_is_left_alone(spark):
    got = linked(spark, ["robert kevquayol brifolwex", "richard kevquayol brifolwex", "r. kevquayol brifolwex"])
    assert frozenset(["r. kevquayol brifolwex"]) in got and len(got) == 3


def test_empty_null_and_blank(spark):
    df = spark.createDataFrame([(None,), ("",)], "key string")
    assert names.link_names(df).count() == 0
    assert names.link_names(df.limit(0)).count() == 0


def test_ngram_join_against_brute_force(spark):
    rng = random.Random(4)
    syl = ["bar", "fil", "gon", "hur", "kip", "lat", "mas"]
    word = lambda: "".join(rng.choices(syl, k=rng.randint(1, 3)))
    forms = [(i, "name", [word(), word(), rng.choice(["office", "agency", "robert", word()])]) for i in range(160)]
    grams = {f[0]: names.grams_of(*f[1:]) for f in forms}
    df = Counter(g for v in grams.values() for g in v)
    idf = {g: math.log((len(forms) + names.PRIOR_FORMS) / n) for g, n in df.items()}
    vec = {}
    for i, v in grams.items():
        w = {g: idf[g] * math.sqrt(s) for g, s in v.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        vec[i] = {g: x / norm for g, x in w.items()}
    want = {}
    for i in range(len(forms)):
        for j in range(i + 1, len(forms)):
            c = sum(x * vec[j].get(g, 0.0) for g, x in vec[i].items())
            if c >= 0.3 + 1e-6:
                want[(i, j)] = c
    got = {(r["a"], r["b"]): r["cosine"] for r in names.ngram_pairs(spark.createDataFrame(forms, "id bigint, kind string, words array<string>")).collect()}
    assert set(want) <= set(got)
    assert all(abs(got[k] - c) < 1e-9 for k, c in want.items()) and all(c >= 0.3 - 1e-6 for c in got.values())


def test_average_linkage():
    s = np.array([[1, 0.9, 0.1, 0], [0.9, 1, 0.2, 0], [0.1, 0.2, 1, 0.8], [0, 0, 0.8, 1.0]])
    label = names.average_linkage(s, 0.5)
    assert label[0] == label[1] != label[2] == label[3]
    chain = np.array([[1, 0.9, 0.0], [0.9, 1, 0.9], [0.0, 0.9, 1.0]])
    assert len(set(names.average_linkage(chain, 0.5))) == 2  # single linkage would give one
    assert names.average_linkage(np.zeros((1, 1)), 0.5) == [0]
