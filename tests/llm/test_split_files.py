"""Pieces of files by byte ranges: rebuilt texts, numbering across ranges, edges of code points."""

import random

import pytest

from kgspark.llm import split


def bodies():
    rng = random.Random(5)
    parts = ["Der Hüter prüft die Kaikarten täglich. ", "The following: (a) one; (b) two; and (c) three. ", "\n\nNew paragraph here. ", "保管人登记。", "😀 seals. ", "A. Stray letter stays. ", "word " * 30]
    numbered = "".join(f"{i}. {''.join(rng.choices(parts, k=3))}" for i in range(1, 200))
    return {"numbered": numbered, "spaces": "wört " * 9000, "solid": "é" * 20_001, "short": "ü" * 2000, "empty": "", "over": "ab " * 667 + "x", "wide": "😀" * 9000}


@pytest.mark.parametrize("range_bytes", [4099, 20_000, 1 << 20])
def test_pieces_of_files(spark, tmp_path, range_bytes):
    paths, texts = [], {}
    for name, body in bodies().items():
        p = tmp_path / name
        p.write_bytes(body.encode())
        paths.append((str(p), p.stat().st_size))
        texts[str(p)] = body
    out = split.split_file_pieces(spark, paths, range_bytes=range_bytes)
    per = {}
    for r in out["pieces"].collect():
        per.setdefault(r["path"], []).append(r)
    assert set(per) == {p for p, t in texts.items() if len(t) > 2000}
    for path, rows in per.items():
        text, at = texts[path], 0
        rows.sort(key=lambda r: r["piece_no"])
        assert [r["piece_no"] for r in rows] == list(range(len(rows)))
        for r in rows:
            assert r["new_pos"] == at + 1 and 0 <= r["new_pos"] - r["start_pos"] <= 200 and len(r["piece"]) <= 2000
            assert r["piece"] == text[r["start_pos"] - 1 : r["end_pos"]]
            assert at == 0 or not path.endswith("spaces") or text[at - 1].isspace()
            at = r["end_pos"]
        assert at == len(text)
    df = spark.createDataFrame([(p, t) for p, t in texts.items()], "path string, text string")
    whole = split.split_rows(df, "path", "text", range_chars=10**7)["boundaries"].where("kind <> 'sentence'").collect()
    got = out["boundaries"].where("kind <> 'sentence'").collect()
    assert {(r["path"], r["pos"], r["kind"]) for r in got} == {(r["path"], r["pos"], r["kind"]) for r in whole}
    assert all(texts[r["path"]].encode()[: r["byte_pos"]].decode() == texts[r["path"]][: r["pos"] - 1] for r in got)
