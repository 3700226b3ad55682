"""Structure-aware chunking: numbered sub-paragraphs first, then sentences packed up to a limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions.text import WS, strip_ws
from kgspark.operators.ingest import marks

MAX_CHARS = 2000
# A sub-paragraph marker and the place between two sentences.
SUBPARAGRAPH = r"(?:(?<=\s)|^)(?:(?=\d{1,2}\.\s)|\((?=\d{1,2}\)\s))(\d{1,2})[.)]\s+"
SENTENCE = rf"(?<=[.;]){WS}+(?=[A-Z(])"


def split_sentences(c: Column) -> Column:
    """Pieces between a full stop or semicolon and a capital or bracket."""
    return F.split(c, SENTENCE, -1)


def pack_sentences(c: Column, limit: int = MAX_CHARS) -> Column:
    """Sentences joined by single spaces while they fit into ``limit``; a longer sentence stays whole."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

    def step(acc: Column, x: Column) -> Column:
        full = (F.length(acc["cur"]) > 0) & (F.length(acc["cur"]) + F.length(x) + 1 > limit)
        return F.struct(
            F.when(full, F.concat(acc["out"], F.array(strip_ws(acc["cur"])))).otherwise(acc["out"]).alias("out"),
            F.when(full, x).otherwise(strip_ws(F.concat(acc["cur"], F.lit(" "), x))).alias("cur"),
        )

    done = lambda acc: F.when(F.length(acc["cur"]) > 0, F.concat(acc["out"], F.array(strip_ws(acc["cur"])))).otherwise(acc["out"])
    return F.aggregate(split_sentences(c), start, step, done)


def subparagraphs(rows: DataFrame, id_cols: list[str], text_col: str, keep_preamble: bool = False) -> DataFrame:
    """(ids, part, text): cut where markers count 1, 2, 3 ...; fewer than two leave the text whole.

    Text before the first marker is dropped unless ``keep_preamble``.
    """
    m = marks(rows.select(*id_cols, text_col), id_cols, text_col, SUBPARAGRAPH)
    per = m.groupBy(*id_cols).agg(F.array_sort(F.collect_list(F.struct("k", "n", "start"))).alias("m"))
    accepted = F.expr("""aggregate(m, named_struct('e', 1, 'a', cast(array() as array<bigint>)),
        (acc, x) -> if(x.n = acc.e, named_struct('e', acc.e + 1, 'a', concat(acc.a, array(cast(x.start as bigint)))), acc), acc -> acc.a)""")
    per = per.select(*id_cols, accepted.alias("at")).where("size(at) >= 2")
    both = rows.select(*id_cols, text_col).join(per, id_cols, "left")
    t = F.col(text_col)
    cuts = F.expr(f"transform(at, (x, i) -> substring({text_col}, int(x + 1), int(coalesce(try_element_at(at, i + 2), cast(length({text_col}) as bigint)) - x)))")
    parts = F.transform(cuts, lambda x: strip_ws(x))
    if keep_preamble:
        head = strip_ws(F.expr(f"substring({text_col}, 1, int(at[0]))"))
        parts = F.when(head != "", F.concat(F.array(head), parts)).otherwise(parts)
    out = F.when(F.col("at").isNull(), F.array(t)).otherwise(parts)
    return both.select(*id_cols, F.posexplode(out).alias("part", text_col))


def chunk_units(rows: DataFrame, id_cols: list[str], text_col: str, limit: int = MAX_CHARS) -> DataFrame:
    """(ids, part, text): short texts whole, else sub-paragraphs, of which the oversized ones are packed by sentence.

    NULL texts give no chunk, '' gives one empty chunk.
    """
    rows = rows.select(*id_cols, text_col).where(F.col(text_col).isNotNull())
    short = rows.where(F.length(text_col) <= limit).select(*id_cols, F.lit(0).alias("part"), text_col)
    long = subparagraphs(rows.where(F.length(text_col) > limit), id_cols, text_col)
    packed = long.select(*id_cols, F.col("part").alias("_p"), F.posexplode(F.when(F.length(text_col) > limit, pack_sentences(F.col(text_col), limit)).otherwise(F.array(text_col))).alias("_q", text_col))
    per = packed.groupBy(*id_cols).agg(F.array_sort(F.collect_list(F.struct("_p", "_q", text_col))).alias("_c"))
    flat = per.select(*id_cols, F.posexplode(F.transform("_c", lambda x: x[text_col])).alias("part", text_col))
    return short.unionByName(flat)


def chunk_documents(docs: DataFrame, limit: int = MAX_CHARS, with_order: bool = False) -> DataFrame:
    """Chunk rows of parsed documents: recitals by position, articles by printed number.

    ``with_order`` adds ``ord``, the place of the unit in its document (printed numbers may repeat).
    """
    rec = docs.select("celex", "title", F.posexplode("recitals").alias("p", "text")).select(
        "celex", "title", F.lit("recital").alias("chunk_type"), F.col("p").alias("ord"), (F.col("p") + 1).alias("unit_number"), F.lit(None).cast("string").alias("heading"), "text"
    )
    art = docs.select("celex", "title", F.posexplode("articles").alias("p", "a")).select(
        "celex", "title", F.lit("article").alias("chunk_type"), F.col("p").alias("ord"), F.col("a.number").alias("unit_number"), F.col("a.heading").alias("heading"), F.col("a.text").alias("text")
    )
    return chunk_rows(rec.unionByName(art), limit, with_order)


def chunk_rows(units: DataFrame, limit: int = MAX_CHARS, with_order: bool = False) -> DataFrame:
    """Chunk rows of units (celex, title, chunk_type, ord, unit_number, heading, text); only oversized units are shuffled."""
    units = units.where("text is not null")
    short = units.where(F.length("text") <= limit).withColumn("part", F.lit(0))
    key, big = ["celex", "chunk_type", "ord"], units.where(F.length("text") > limit)
    parts = chunk_units(big, key, "text", limit).join(big.drop("text"), key)
    parts = short.unionByName(parts.select(short.columns))
    cid = F.concat_ws("_", "celex", "chunk_type", F.col("unit_number").cast("string"), F.col("part").cast("string"))
    cols = [cid.alias("chunk_id"), "celex", F.col("title").alias("doc_title"), "chunk_type", "unit_number", "part", "heading", "text"]
    return parts.select(*cols, *(["ord"] if with_order else []))
