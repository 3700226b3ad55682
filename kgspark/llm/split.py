"""Splitting oversized texts at natural boundaries, by ranges with halos.

A text (or a file) is cut into ranges.  A worker sees one range plus a halo on either side, finds the
boundary candidates that lie inside the range and emits them as a table of offsets.  The tables of the
ranges are stitched: numbered markers are confirmed against their neighbours across ranges, every range is
given the first boundary of the range that follows it, pieces are planned per range between those anchors,
and a prefix sum over the ranges numbers them.  Pieces are emitted by offset.  No worker holds a whole
file: ``split_files`` scans byte ranges and ``split_file_pieces`` carries its table through to the pieces;
``split_rows`` works on texts that already sit in a table.

Defined results: texts at or under the limit, NULL and empty texts give no piece (they need no cut).
Rows are told apart by id and text: equal rows are split once, an id with two
texts gives the pieces of both, a NULL id is an id like any other.  A stretch without
any boundary is cut at white space, and without white space at the limit.  Dropping the overlap of every
piece and concatenating gives the text back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.llm.sentences import sentence_starts
from kgspark.session import materialize

MAX_CHARS, OVERLAP = 2000, 200
#: Texts of two ranges and more are cut by several tasks; the longer ones of ordinary texts are among them.
RANGE_CHARS = 4096
#: Context on either side of a range.  A quotation that is longer, and only such a one, may be split inside at a range's edge.
HALO = 4000

BLANK, PARAGRAPH, ITEM, SENTENCE = "blank", "paragraph", "item", "sentence"

_BLANK = re.compile(r"\n[^\S\n]*\n\s*")
_CJK_NUM = "一二三四五六七八九十百"
# a marked paragraph: must stand where a sentence starts
_PARAGRAPH = regex.compile(
    rf"(?:(?P<dot>\d{{1,3}})\.(?=\s)|\((?P<par>\d{{1,3}})\)|(?P<sec>§)\s?(?P<secn>\d{{1,4}})|(?P<letter>[A-Z])\.(?=\s)"
    rf"|(?P<multi>\d{{1,3}}(?:\.\d{{1,3}})+)\.?(?=\s)|[（(](?P<cjk>[{_CJK_NUM}]+|\d{{1,3}})[）)]|(?P<cjkn>[{_CJK_NUM}]+)、"
    rf"|(?P<art>Article|Artikel|Artículo|Section|Abschnitt|Член|Άρθρο)\s+(?P<artn>\d{{1,4}})(?=\s*\n))"
)
# a list item: after a colon, a semicolon (perhaps with and/or), a line break or where a sentence starts
_ITEM = regex.compile(r"(?:\(\p{L}{1,5}\)|\p{L}{1,5}\)|\(?\d{1,3}\)|[•‣▪◦●·*–—‒-])(?=\s)")
_LEADS = regex.compile(r"[:;：；;](?:\s*(?:and|or|und|oder|et|ou|y|o|e|и|или|και|ή)(?=\s))?\s+|\n\s*")


@dataclass(frozen=True)
class Boundary:
    """A place where a piece may start; ``style`` and ``number`` are set for numbered markers."""

    pos: int
    kind: str
    style: str = ""
    number: int = 0


def _cjk_number(s: str) -> int:
    if s.isdigit():
        return int(s)
    digits = {c: i + 1 for i, c in enumerate("一二三四五六七八九")}
    if "十" in s:
        a, _, b = s.partition("十")
        return (digits.get(a, 1) if a else 1) * 10 + digits.get(b, 0)
    return digits.get(s, 0)


def _numbered(m: regex.Match) -> tuple[str, int]:
    g = m.groupdict()
    if g["dot"]:
        return "dot", int(g["dot"])
    if g["par"]:
        return "par", int(g["par"])
    if g["sec"]:
        return "sec", int(g["secn"])
    if g["letter"]:
        return "letter", ord(g["letter"]) - 64
    if g["art"]:
        return "art", int(g["artn"])
    if g["cjk"] or g["cjkn"]:
        return ("cjk" if g["cjk"] else "cjkn"), _cjk_number(g["cjk"] or g["cjkn"])
    return "multi", 0


def candidates(text: str, lang: str | None = None) -> list[Boundary]:
    """All places of ``text`` where a piece may start, strongest kind first at equal places."""
    found: dict[int, Boundary] = {}
    starts = sentence_starts(text, lang)
    for s in starts:
        m = _PARAGRAPH.match(text, s)
        if m:
            found[s] = Boundary(s, PARAGRAPH, *_numbered(m))
        elif _ITEM.match(text, s):
            found[s] = Boundary(s, ITEM)
        else:
            found[s] = Boundary(s, SENTENCE)
    for m in _LEADS.finditer(text):
        p = m.end()
        if p in found and found[p].kind == PARAGRAPH:
            continue
        if p < len(text) and _ITEM.match(text, p) and (m.group().strip() or p in found):
            found[p] = Boundary(p, ITEM)
        elif p < len(text) and not m.group().strip() and _ITEM.match(text, p):
            # a line break alone: only where the line before ends a clause
            if text[: m.start()].rstrip()[-1:] in (":", ";", ",", ".", "") or regex.search(r"\b(?:and|or|und|oder|et|ou|y|o)$", text[: m.start()][-8:]):
                found[p] = Boundary(p, ITEM)
    for m in _BLANK.finditer(text):
        p = m.end()
        if p < len(text):
            b = found.get(p)
            if b is None or b.kind == SENTENCE or (b.kind == PARAGRAPH and b.style == "letter"):
                found[p] = Boundary(p, BLANK)
    return sorted(found.values(), key=lambda b: b.pos)


_CAND = T.ArrayType(
    T.StructType([T.StructField("pos", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("style", T.StringType()), T.StructField("number", T.IntegerType())])
)


@F.pandas_udf(_CAND)
def _range_candidates(windows: pd.Series, first: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
    """Candidates of each window that lie in [lo, hi), as offsets of the whole text."""
    out = []
    for text, at, a, b in zip(windows, first, lo, hi, strict=True):
        got = candidates(text) if text else []
        out.append([(at + c.pos, c.kind, c.style, c.number) for c in got if a <= at + c.pos < b])
    return pd.Series(out)


def text_ranges(rows: DataFrame, range_chars: int = RANGE_CHARS, halo: int = HALO) -> DataFrame:
    """(id, r, n, lo, hi, first, window) for rows of (id, text): each range with its halos; lo/hi are 0-based."""
    n = F.length("text").cast("long")

    def window(r: Column) -> Column:
        lo = r.cast("long") * range_chars
        first, hi = F.greatest(lo - halo, F.lit(0)), F.least(lo + range_chars, n)
        return F.struct(r.alias("r"), lo.alias("lo"), hi.alias("hi"), first.alias("first"), F.substring("text", (first + 1).cast("int"), (hi + halo - first).cast("int")).alias("window"))

    # the windows are cut before the explode: exploding first would copy the whole text once per range
    cut = rows.select("id", n.alias("n"), F.transform(F.sequence(F.lit(0), ((n - 1) / range_chars).cast("int")), window).alias("w"))
    return cut.select("id", "n", F.explode("w").alias("w")).select("id", "n", "w.*").select("id", "r", "n", "lo", "hi", "first", "window")


def range_boundaries(ranges: DataFrame) -> DataFrame:
    """The boundary table: one row per confirmed boundary (id, r, pos, kind), stitched over the ranges."""
    found = ranges.select("id", "r", F.explode(_range_candidates("window", "first", "lo", "hi")).alias("c")).select("id", "r", "c.*")
    return confirmed_boundaries(found).select("id", "r", "pos", "kind")


def confirmed_boundaries(found: DataFrame) -> DataFrame:
    """Candidates (id, r, pos, kind, style, number, ...) of all ranges; a marker without its neighbours becomes a sentence."""
    by_style = W.partitionBy("id", "style").orderBy("pos")
    near = lambda d: F.coalesce((F.lag("number").over(by_style) == F.col("number") - d) | (F.lead("number").over(by_style) == F.col("number") + d), F.lit(False))
    alone = F.lag("number").over(by_style).isNull() & F.lead("number").over(by_style).isNull()
    marked = found.where("kind = 'paragraph'")
    confirmed = (F.col("style") == "multi") | near(1) | near(2) | (alone & (F.col("style") != "letter"))
    marked = marked.withColumn("ok", confirmed).withColumn("kind", F.when(F.col("ok"), F.col("kind")).otherwise(F.lit(SENTENCE))).drop("ok")
    return found.where("kind <> 'paragraph'").unionByName(marked)


_RANK = {BLANK: 0, PARAGRAPH: 0, ITEM: 0, SENTENCE: 1}


def plan_pieces(lo: int, hi: int, marks: list[tuple[int, int]], text: str, base: int, max_chars: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, core, end) of the pieces of [lo, hi): ``core`` is where the new text starts, before it lies overlap.

    ``marks`` are (offset, rank), rank 0 before 1; ``text`` is the window that starts at offset ``base``.
    A cut is the last mark of the best rank in the second half of the room, else white space, else the limit.
    """
    pieces, core = [], lo
    while core < hi:
        start = core
        if core > 0 and overlap > 0:
            floor = max(core - overlap, base)
            inside = [p for p, _ in marks if floor <= p < core]
            if inside:
                start = inside[0]
            else:
                m = re.search(r"\s(?=\S)", text[floor - base : core - base])
                start = floor + m.end() if m else core
        room = start + max_chars
        if room >= hi:
            end = hi
        else:
            least = core + max(1, (room - core) // 2)
            best = [[p for p, k in marks if k == rank and least <= p <= room] for rank in (0, 1)]
            early = [p for p, k in marks if core < p < least]
            if best[0] or best[1]:
                end = (best[0] or best[1])[-1]
            elif early:
                end = early[-1]
            else:
                gap = [m.end() for m in re.finditer(r"\s+(?=\S)", text[core - base : room - base])]
                end = core + gap[-1] if gap else room
        pieces.append((start, core, end))
        core = end
    return pieces


_PIECE = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "core", "end")]))


def _plan_udf(max_chars: int, overlap: int):
    @F.pandas_udf(_PIECE)
    def plan(lo: pd.Series, hi: pd.Series, pos: pd.Series, kind: pd.Series, window: pd.Series, first: pd.Series) -> pd.Series:
        out = []
        for a, b, ps, ks, text, base in zip(lo, hi, pos, kind, window, first, strict=True):
            marks = sorted((int(p), _RANK[k]) for p, k in zip(ps, ks, strict=True))
            out.append(plan_pieces(int(a), int(b), marks, text, int(base), max_chars, overlap))
        return pd.Series(out)

    return plan


def split_rows(
    rows: DataFrame, id_col: str, text_col: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP,
    range_chars: int = RANGE_CHARS, halo: int = HALO,
) -> dict[str, DataFrame]:
    """``boundaries`` (id, pos from 1, kind) and ``pieces`` (id, piece_no from 0, start_pos, new_pos, end_pos, piece).

    Only texts longer than ``max_chars`` are treated.  ``start_pos`` counts from 1 and includes the overlap,
    ``new_pos`` is the first character the piece does not share with the one before it.
    """
    if not 0 <= overlap < max_chars or halo < max_chars:
        raise ValueError("overlap must be under the limit and the halo at least the limit")
    big = rows.select(F.col(id_col).alias("_own"), F.col(text_col).alias("text")).where(F.length("text") > max_chars)
    big = big.withColumn("id", F.xxhash64("_own", "text")).dropDuplicates(["id"])
    owner = big.select("id", "_own")
    ranges = text_ranges(big, range_chars, halo)  # the drop of duplicates has spread the rows
    marks = range_boundaries(ranges)
    per = marks.groupBy("id", "r").agg(F.sort_array(F.collect_list(F.struct("pos", "kind"))).alias("m"))
    seg = ranges.join(per, ["id", "r"], "left").withColumn("m", F.coalesce("m", F.array().cast("array<struct<pos:bigint,kind:string>>")))
    # stitch: a range is planned from its own first boundary to that of the next range
    near_lo = F.filter("m", lambda x: x["pos"] < F.col("lo") + halo // 2)
    # a range without a boundary at its head is entered behind white space, if there is any
    gap = F.regexp_instr(F.substring("window", (F.col("lo") - F.col("first")).cast("int"), halo // 2), F.lit(r"\s\S"))
    entry = F.col("lo") + F.when(gap > 0, gap - 1).otherwise(0)
    head = F.coalesce(F.try_element_at(F.transform(near_lo, lambda x: x["pos"]), F.lit(1)), entry)
    by_id = W.partitionBy("id").orderBy("r")
    seg = seg.withColumn("a", F.when(F.col("r") == 0, F.lit(0).cast("long")).otherwise(head))
    seg = seg.withColumn("b", F.coalesce(F.lead("a").over(by_id), F.col("n")))
    # the marks a range needs past its own end are those of the next range's head, which is its end point
    planned = seg.withColumn("p", _plan_udf(max_chars, overlap)("a", "b", F.transform("m", lambda x: x["pos"]), F.transform("m", lambda x: x["kind"]), "window", "first"))
    before = F.coalesce(F.sum(F.size("p")).over(by_id.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = planned.withColumn("k0", before).select("id", "first", "window", "k0", F.posexplode("p").alias("k", "q"))
    pieces = out.select(
        "id", (F.col("k0") + F.col("k")).cast("int").alias("piece_no"),
        (F.col("q.start") + 1).alias("start_pos"), (F.col("q.core") + 1).alias("new_pos"), F.col("q.end").alias("end_pos"),
        F.substring("window", (F.col("q.start") - F.col("first") + 1).cast("int"), (F.col("q.end") - F.col("q.start")).cast("int")).alias("piece"),
    )
    named = lambda df: df.join(owner, "id").select(F.col("_own").alias(id_col), *[c for c in df.columns if c != "id"])
    return {"boundaries": named(marks.select("id", (F.col("pos") + 1).alias("pos"), "kind")), "pieces": named(pieces)}


def file_ranges(spark: SparkSession, paths: list[tuple[str, int]], range_bytes: int) -> DataFrame:
    """(path, size, r) for files of known size: the work list of ``split_files``; it holds no content."""
    rows = spark.createDataFrame(paths, "path string, size bigint")
    return rows.select("path", "size", F.explode(F.sequence(F.lit(0), F.greatest(((F.col("size") - 1) / range_bytes).cast("int"), F.lit(0)))).alias("r"))


def _read_window(path: str, lo: int, hi: int, halo: int) -> tuple[int, str]:
    """(byte offset, text) of the whole code points between lo - halo and hi + halo."""
    at = max(0, lo - halo)
    with open(path, "rb") as f:
        f.seek(at)
        raw = f.read(hi + halo - at)
    skip = next((i for i in range(min(4, len(raw))) if raw[i] & 0xC0 != 0x80), 0)
    return at + skip, raw[skip:].decode("utf-8", errors="ignore")


def split_files(
    spark: SparkSession, paths: list[tuple[str, int]], range_bytes: int = 1 << 20, halo_bytes: int = 8192
) -> DataFrame:
    """Candidate table (path, r, chars, byte_pos, char_at, kind, style, number) of UTF-8 files on a file system all workers mount.

    A worker opens the file, seeks to its range minus the halo and reads range plus halos; it never holds
    more.  Cut code points at the edges are skipped.  ``chars`` (code points of the range) prefix-sums to
    character offsets without a second read; ``char_at`` counts from the first code point of the range.  The
    row with ``chars`` tells where the range may be entered if it has no boundary: behind white space.
    """
    schema = "path string, r int, chars bigint, byte_pos bigint, char_at bigint, kind string, style string, number int, entry_byte bigint, entry_at bigint"

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, size, r in zip(pdf["path"], pdf["size"], pdf["r"], strict=True):
                lo, hi = r * range_bytes, min((r + 1) * range_bytes, size)
                n, text = _read_window(path, lo, hi, halo_bytes)
                wanted = {c.pos: c for c in candidates(text)}
                found, chars, first, entry, before = [], 0, None, None, ""
                for i, ch in enumerate(text):
                    if lo <= n < hi:
                        first = n if first is None else first
                        if entry is None and n < lo + halo_bytes // 2 and before.isspace() and not ch.isspace():
                            entry = (n, chars)
                        if c := wanted.get(i):
                            found.append((path, r, None, n, chars, c.kind, c.style, c.number, None, None))
                        chars += 1
                    before = ch
                    n += len(ch.encode())
                entry = entry or (hi if first is None else first, 0)
                rows += [(path, r, chars, None, None, None, None, None, *entry), *found]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    return file_ranges(spark, paths, range_bytes).mapInPandas(scan, schema)


_PLANNED = "path string, r int, k int, start_pos bigint, new_pos bigint, end_pos bigint, start_byte bigint, end_byte bigint"


def _plan_files(range_bytes: int, halo_bytes: int, max_chars: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for x in pdf.itertuples(index=False):
                lo, hi = x.r * range_bytes, min((x.r + 1) * range_bytes, x.size)
                at, text = _read_window(x.path, lo, hi, halo_bytes)
                sizes = np.fromiter((len(ch.encode()) for ch in text), dtype=np.int64, count=len(text))
                byte = at + np.concatenate(([0], np.cumsum(sizes)))
                base = int(x.c0) - int(np.searchsorted(byte, lo))
                marks = sorted((int(m["pos"]), _RANK[m["kind"]]) for m in x.m)
                for k, (start, core, end) in enumerate(plan_pieces(int(x.a), int(x.b), marks, text, base, max_chars, overlap)):
                    rows.append((x.path, x.r, k, start + 1, core + 1, end, int(byte[start - base]), int(byte[end - base])))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _PLANNED.split(", ")])

    return run


@F.pandas_udf(T.StringType())
def _read_piece(path: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
    out = []
    for p, a, b in zip(path, start, end, strict=True):
        with open(p, "rb") as f:
            f.seek(a)
            out.append(f.read(b - a).decode("utf-8"))
    return pd.Series(out)


def split_file_pieces(
    spark: SparkSession, paths: list[tuple[str, int]], range_bytes: int = 1 << 20, halo_bytes: int = 4 * HALO,
    max_chars: int = MAX_CHARS, overlap: int = OVERLAP,
) -> dict[str, DataFrame]:
    """``boundaries`` (path, pos from 1, byte_pos, kind) and ``pieces`` (path, piece_no, start_pos, new_pos, end_pos, piece).

    The same as ``split_rows`` for valid UTF-8 files: candidates of the ranges are confirmed across ranges, their
    code points prefix-summed, pieces planned per range and read by byte offset.  Files of up to ``max_chars``
    characters give no piece.  A range without a boundary at its head is entered behind white space.
    """
    if not 0 <= overlap < max_chars or halo_bytes < 4 * max_chars or range_bytes < 4:
        raise ValueError("overlap must be under the limit, the halo hold the limit in bytes and a range a code point")
    scanned = materialize(split_files(spark, paths, range_bytes, halo_bytes), "file-candidates")
    by_file = W.partitionBy("path").orderBy("r")
    base = scanned.where("chars is not null").select("path", "r", "chars", "entry_byte", "entry_at")
    base = base.withColumn("c0", F.coalesce(F.sum("chars").over(by_file.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    base = base.withColumn("n", F.sum("chars").over(W.partitionBy("path"))).where(F.col("n") > max_chars)
    found = scanned.where("chars is null").select(F.col("path").alias("id"), "r", F.col("byte_pos").alias("pos"), "char_at", "kind", "style", "number")
    marks = confirmed_boundaries(found).select(F.col("id").alias("path"), "r", F.col("pos").alias("byte_pos"), "char_at", "kind")
    marks = marks.join(base.select("path", "r", "c0"), ["path", "r"]).select("path", "r", "byte_pos", (F.col("c0") + F.col("char_at")).alias("pos"), "kind")
    marks = materialize(marks, "file-boundaries")
    per = marks.groupBy("path", "r").agg(F.sort_array(F.collect_list(F.struct("pos", "byte_pos", "kind"))).alias("m"))
    seg = base.join(per, ["path", "r"], "left").withColumn("m", F.coalesce("m", F.array().cast("array<struct<pos:bigint,byte_pos:bigint,kind:string>>")))
    # stitch: a range is planned from its own first boundary to that of the next range
    near_lo = F.filter("m", lambda x: x["byte_pos"] < F.col("r").cast("long") * range_bytes + halo_bytes // 2)
    head = F.coalesce(F.try_element_at(F.transform(near_lo, lambda x: x["pos"]), F.lit(1)), F.col("c0") + F.col("entry_at"))
    seg = seg.withColumn("a", F.when(F.col("r") == 0, F.lit(0).cast("long")).otherwise(head))
    seg = seg.withColumn("b", F.coalesce(F.lead("a").over(by_file), F.col("n")))
    sizes = spark.createDataFrame(paths, "path string, size bigint").distinct()
    todo = seg.join(sizes, "path").select("path", "size", "r", "c0", "a", "b", "m")
    planned = materialize(todo.mapInPandas(_plan_files(range_bytes, halo_bytes, max_chars, overlap), _PLANNED), "file-plan")
    counts = planned.groupBy("path", "r").agg(F.count(F.lit(1)).alias("k1"))
    first = counts.select("path", "r", F.coalesce(F.sum("k1").over(by_file.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("k0"))
    pieces = planned.join(first, ["path", "r"]).select(
        "path", (F.col("k0") + F.col("k")).cast("int").alias("piece_no"), "start_pos", "new_pos", "end_pos",
        _read_piece("path", "start_byte", "end_byte").alias("piece"),
    )
    return {"boundaries": marks.select("path", (F.col("pos") + 1).alias("pos"), "byte_pos", "kind"), "pieces": pieces}
