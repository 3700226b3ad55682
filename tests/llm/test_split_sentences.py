"""Sentences and splitting: rules per language, halos and stitching, round trips."""

import random

import pytest
from pyspark.sql import functions as F

from kgspark.llm import sentences, split
from kgspark.llm.sentences import sentence_starts

CASES = [
    ("en", "The fee is 3.5 marks, i.e. low. Dr. M. Tavfol of the office signed on p. 5. No entry may be erased! Why?", ["The", "Dr.", "No", "Why"]),
    ("en", "He said: “Box 7 was open. No one came.” The clerk left. “Seal it,” states the record, “and go.” End.", ["He", "The", "“Seal", "End."]),
    ("en", "The room closes at 7 p.m. The office opened at 6 a.m. on 2 May. e-permits expire. 20 depots reported. See Annex V. As before.", ["The room", "The office", "e-permits", "20", "See", "As"]),
    ("en", "1. First one. 2. Second one.(3) Third one.§ 4 Fourth: (a) one; (b) two.", ["1.", "2.", "(3)", "§"]),
    ("en", "Seals, keys, logs, etc. The rest, etc. before noon. Reg. (EU) 2031/5 applies. By Folcorsil Peldenhal, M. The end.", ["Seals", "The rest", "Reg.", "By", "The end"]),
    ("en", "no stop here\n\nsecond paragraph\n\n  third", ["no", "second", "third"]),
    ("de", "Die Stelle kann das Buch, z. B. bei Gefahr, sperren. Bis zum 2. Dezember sind Art. 5 Abs. 2 zu prüfen. Im Protokoll heißt es: „Die Lampe war aus. Niemand kam.“ Wer zahlt?", ["Die", "Bis", "Im", "Wer"]),
    ("fr", "M. l’examinateur vérifie l’art. 5, par. 2. Toute copie est interdite ! L’inspecteur a écrit : « La porte était ouverte. Rien ne manque. » Le greffe le note.", ["M.", "Toute", "L’inspecteur", "Le greffe"]),
    ("es", "El Sr. secretario anotó la pág. 20. ¿Quién responde? El acta dice: «La sala estaba vacía. Faltaba una llave». ¡Queda prohibida!", ["El Sr.", "¿Quién", "El acta", "¡Queda"]),
    ("bg", "Таксата е 4,8 на сто, т.е. малко. Службата работи до 1 май 2041 г. включително. Кой отговаря?", ["Таксата", "Службата", "Кой"]),
    ("el", "Ποιος ευθύνεται για τις μετρήσεις; Η αρχή εξετάζει, π.χ. σε ζημία. Το τέλος.", ["Ποιος", "Η", "Το"]),
    ("hi", "शुल्क 12.5 प्रतिशत होगा। अनु. 70 के अनुसार जाँच। कौन उत्तरदायी है? अंत।", ["शुल्क", "अनु.", "कौन", "अंत"]),
    ("ar", "تبلغ الرسوم 27.9 في المائة. من المسؤول؟ يختم المكتب السجل.", ["تبلغ", "من", "يختم"]),
    ("zh", "费用为8.9%，不多。记录写道：“仓门已开。无人值守。”并附照片。谁负责？禁止！", ["费用", "记录", "谁", "禁止"]),
    ("ja", "手数料は36.5％。係員は「鍵は無かった。扉は開いていた。」と述べた。誰が負うのか？", ["手数料", "係員", "誰"]),
    ("th", "สำนักงานตรวจสอบตามมาตรา 51 โดยเร็ว ผู้ดูแลต้องเก็บรักษา 97 วัน ห้ามทำสำเนา", ["สำนักงาน", "ผู้ดูแล", "ห้าม"]),
]


@pytest.mark.parametrize("lang, text, heads", CASES)
def test_rules(lang, text, heads):
    assert sentences.detect_language(text) == lang
    got = [text[s:] for s in sentence_starts(text)]
    assert len(got) == len(heads) and all(g.startswith(h) for g, h in zip(got, heads, strict=True)), got


@pytest.mark.parametrize("text", [None, "", "   ", "\n\n", "no end mark", "...", "“", "a" * 100_000, ". " * 5000])
def test_odd_texts(text):
    starts = sentence_starts(text)
    assert starts == sorted(set(starts)) and all(not text[s].isspace() for s in starts)
    assert bool(starts) == bool(text and text.strip())


def test_units(spark):
    rows = [(1, "One. Two here.  "), (1, "One. Two here.  "), (2, None), (3, ""), (None, " x ")]
    df = spark.createDataFrame(rows, "seq bigint, text string").withColumn("lang", F.lit("clash")).withColumn("starts", F.lit(0))
    got = sorted((r["seq"] or 0, r["sentence_no"], r["start_pos"], r["end_pos"], r["sentence"]) for r in sentences.sentence_units(df, "seq", "text").collect())
    assert got == [(0, 0, 2, 2, "x")] + sorted([(1, 0, 1, 4, "One."), (1, 1, 6, 14, "Two here.")] * 2)
    assert sentences.sentence_units(df.limit(0), "seq", "text").count() == 0


LIST = (
    "1. The keeper shall notify the following: (a) the log; (b) points (a) and (c) of paragraph 5; and (c) the seal under Article 3(2). "
    "2. As provided in paragraph 1. The data steward acts on 2. Dezember.\n(3) Third one: — first; — second.\n\nSet off by a blank line. § 4 Fourth. § 5 Fifth."
)


def test_boundaries_of_a_text():
    got = {LIST[b.pos :][:3].strip() for b in split.candidates(LIST) if b.kind != split.SENTENCE}
    assert got == {"1.", "(a)", "(b)", "(c)", "2.", "(3)", "— f", "— s", "Set", "§ 4", "§ 5"}
    assert sum(b.kind != split.SENTENCE for b in split.candidates(LIST)) == 11


def texts():
    rng = random.Random(9)
    parts = ["The clerk seals the box. ", "It is 3.5 m long. ", "The following: (a) one; (b) two; and (c) three. ", "\n\nNew paragraph here. ", "“Quoted. Twice.” he said. ", "x" * 90 + " ", "保管人登记。", "word " * 40]
    out = []
    for i in range(12):
        n, t = 1, ""
        while len(t) < 2500 + 700 * i:
            if rng.random() < 0.2:
                t += f"{n}. "
                n += 1
            t += rng.choice(parts)
        out.append((i, t))
    return out


def rebuild(pieces):
    out, at = "", 0
    for p in sorted(pieces, key=lambda r: r["piece_no"]):
        assert p["new_pos"] == at + 1
        out += p["piece"][p["new_pos"] - p["start_pos"] :]
        at = p["end_pos"]
    return out


@pytest.mark.parametrize("range_chars", [1500, 4096, 32_768])
def test_pieces_round_trip_and_halos(spark, range_chars):
    rows = texts() + [(100, "y" * 7000), (101, "short"), (102, None), (103, ""), (104, "z" * 2000), (105, "w" * 2001), (None, "v " * 1500), (0, texts()[0][1])]
    df = spark.createDataFrame(rows, "seq bigint, text string").withColumn("id", F.lit("clash")).withColumn("r", F.lit(1)).withColumn("n", F.lit(1))
    out = split.split_rows(df, "seq", "text", range_chars=range_chars)
    per = {}
    for r in out["pieces"].collect():
        per.setdefault(r["seq"], []).append(r)
    want = {i: t for i, t in rows if t and len(t) > 2000}
    assert set(per) == set(want)
    for i, ps in per.items():
        assert sorted(p["piece_no"] for p in ps) == list(range(len(ps)))
        assert all(len(p["piece"]) <= 2000 and p["new_pos"] - p["start_pos"] <= 200 for p in ps)
        assert rebuild(ps) == want[i]
    marks = {(r["seq"], r["pos"], r["kind"]) for r in out["boundaries"].collect()}
    whole = {(r["seq"], r["pos"], r["kind"]) for r in split.split_rows(df, "seq", "text", range_chars=10**6)["boundaries"].collect()}
    assert {(s, p) for s, p, k in marks if k != split.SENTENCE} == {(s, p) for s, p, k in whole if k != split.SENTENCE}


def test_empty_table(spark):
    out = split.split_rows(spark.createDataFrame([], "seq bigint, text string"), "seq", "text")
    assert out["pieces"].count() == 0 and out["boundaries"].count() == 0


def test_files_by_byte_ranges(spark, tmp_path):
    body = "".join(f"{i}. Der Hüter prüft die Kaikarten täglich. " for i in range(1, 400))
    path = tmp_path / "big.txt"
    path.write_bytes(body.encode())
    got = split.split_files(spark, [(str(path), path.stat().st_size)], range_bytes=3000, halo_bytes=2000)
    rows = got.where("byte_pos is not null and kind = 'paragraph'").collect()
    raw = body.encode()
    assert len(rows) == 399 and sorted(r["number"] for r in rows) == list(range(1, 400))
    assert all(raw[r["byte_pos"] :].startswith(f"{r['number']}. ".encode()) for r in rows)
    assert got.agg(F.sum("chars")).first()[0] == len(body)


def test_long_quotations_and_whole_context():
    """A quotation of any length protects its inside; words of no language's abbreviations end sentences."""
    long = "He said “" + "one thing. Another thing. " * 40 + "done” and left. Then silence."
    assert [long[s:][:4] for s in sentence_starts(long)] == ["He s", "Then"]
    unbalanced = "He said “one thing. Then he “said another.” Then silence."
    assert len(sentence_starts(unbalanced)) == 3
    for text in ("He sailed to the North. The ship returned in spring.", "The harbour closed in Mar. The quay stayed open."):
        assert len(sentence_starts(text)) == 2
    for text in ("The Jt. Registry Board met.", "The findings of Reg. 2031/108 stand.", "The Institute f. Maritime Archives met.", "The Dept. for Salv. Claims met."):
        assert len(sentence_starts(text)) == 1


def test_ranges_without_boundaries_are_not_cut_inside_words(spark):
    text = "word " * 8000
    got = split.split_rows(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text")["pieces"].orderBy("piece_no").collect()
    assert rebuild(got) == text and all(r["new_pos"] == 1 or text[r["new_pos"] - 2] == " " for r in got) and len(got) > 20
