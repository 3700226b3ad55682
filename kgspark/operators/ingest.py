"""Raw act text to structure: title and date, recitals, articles, embedded footnotes.

Matches with their offsets come from ``split`` and ``regexp_extract_all`` of the same pattern: the start of
match k is the length of the pieces up to k plus the matches before it.  Everything runs in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.functions.text import WS, collapse_ws, is_footer_line, is_recital, strip_ws
from kgspark.session import materialize

# The patterns of the source documents.
TITLE_ANCHOR = r"(?m)^(REGULATION|DIRECTIVE|DECISION)[ \t]*\(E[UC]\)[^\n]*$"
ARTICLE_MARK = r"(?m)^Article\s+(\d+)\s*$"
RECITAL_MARK = r"(?<=\s)\((\d+)\)\s+"
ADOPTED = r"(?i)HA(?:S|VE) ADOPTED THIS (?:REGULATION|DIRECTIVE|DECISION)"
SIGNATURE = r"Done at \w+,"
FOOTNOTE_MARK = r"(?<=\s)\(\s*(\d{1,2})\s*\)\s+"
OJ_END = r"\(OJ [^)]*\)\."
SENTENCE_BREAK = r"(?<=[.;])\s+(?=[A-Z(])"
FOOTNOTE_GAP = 600


def text_lines(c: Column) -> Column:
    """Stripped non-empty lines."""
    return F.filter(F.transform(F.split(c, "\n"), lambda x: strip_ws(x)), lambda x: x != "")


def page_text(pages: DataFrame) -> DataFrame:
    """(celex, text) from (celex, page, text): pages in order, furniture lines dropped."""
    one = pages.groupBy("celex").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    joined = F.array_join(F.transform("p", lambda x: x["text"]), "\n")
    return one.select("celex", F.array_join(F.filter(F.split(joined, "\n"), lambda x: ~is_footer_line(x)), "\n").alias("text"))


def title_and_date(text: Column) -> tuple[Column, Column]:
    """(title, date): header line and what follows it up to '(Text with' or an all-capitals line; '' if absent."""
    at = F.regexp_instr(text, F.lit(TITLE_ANCHOR))
    window = F.substring(text, at, 2000)
    lines = F.transform(F.split(window, "\n"), lambda x: strip_ws(x))
    rest = F.filter(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: x != "")
    stop = lambda x: x.startswith("(Text with") | ((F.upper(x) == x) & (F.lower(x) != x) & (F.length(x) > 15))
    at_stop = F.array_position(F.transform(rest, stop), True)
    body = F.when(at_stop > 0, F.slice(rest, F.lit(1), (at_stop - 1).cast("int"))).otherwise(rest)
    day = lambda x: F.when(x.startswith("of "), F.regexp_extract(x, r"\d{1,2}\s+\w+\s+\d{4}", 0)).otherwise(F.lit(""))
    dated = F.array_position(F.transform(body, lambda x: day(x) != ""), True)
    date = F.when(dated > 0, day(F.element_at(body, F.greatest(dated, F.lit(1)).cast("int")))).otherwise(F.lit(""))
    kept = F.filter(body, lambda x, i: (i + 1) != dated)
    title = F.array_join(F.concat(F.array(F.element_at(lines, 1)), kept), " ")
    none = F.lit("")
    return F.when(at > 0, title).otherwise(none), F.when(at > 0, date).otherwise(none)


def articles(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, number, heading, text) of the enacting terms, cut at the signature formula."""
    cut = F.element_at(F.split(F.col(text_col), SIGNATURE, 2), 1)
    rows = docs.select(id_col, cut.alias("_t"))
    rows = rows.select(id_col, F.split("_t", ARTICLE_MARK, -1).alias("p"), F.expr(f"regexp_extract_all(_t, r'{ARTICLE_MARK}', 1)").alias("n"))
    each = rows.select(id_col, F.posexplode(F.arrays_zip("n", F.slice("p", F.lit(2), F.size("p")).alias("b"))).alias("pos", "x"))
    body = text_lines(F.col("x.b"))
    each = each.where("x.n is not null").select(id_col, "pos", F.col("x.n").cast("int").alias("number"), body.alias("l"))
    rest = F.when(F.size("l") > 1, F.slice("l", F.lit(2), F.greatest(F.size("l") - 1, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    return each.select(id_col, "pos", "number", F.coalesce(F.try_element_at("l", F.lit(1)), F.lit("")).alias("heading"), collapse_ws(F.array_join(rest, " ")).alias("text"))


def marks(rows: DataFrame, id_cols: list[str], text_col: str, pattern: str) -> DataFrame:
    """(ids, k, n, start, stop): matches of a pattern with one number group; offsets count from 0.

    Only lengths leave the text's row: carrying the text along would copy it once per match.
    """
    # the number is read from the short match, so the text is scanned twice and not three times
    pre = rows.select(*id_cols, F.split(text_col, pattern, -1).alias("_p"), F.expr(f"regexp_extract_all({text_col}, r'{pattern}', 0)").alias("_f")).where("size(_f) > 0")
    number = lambda f: F.regexp_extract(f, r"\d+", 0).cast("int")
    sizes = F.arrays_zip(F.transform("_f", F.length).alias("f"), F.transform("_f", number).alias("n"), F.transform("_p", F.length).alias("p"))
    each = pre.select(*id_cols, F.posexplode(sizes).alias("k", "x")).where("x.f is not null")
    stop = F.sum(F.col("x.p") + F.col("x.f")).over(W.partitionBy(*id_cols).orderBy("k"))
    return each.select(*id_cols, "k", "x.n", (stop - F.col("x.f")).alias("start"), stop.alias("stop"))


def recitals(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos from 1, text): accepted markers define the spans, printed numbers are ignored, footnotes removed.

    The pieces between markers are exploded, never the whole text; the piece of a rejected marker is put
    back behind the recital it interrupts.
    """
    t = F.col(text_col)
    a, b = F.regexp_instr(t, F.lit("Whereas:")), F.regexp_instr(t, F.lit(ADOPTED))
    inside = F.when((a > 0) & (b >= a + 8), F.substring(t, a + 8, b - a - 8))
    pre = docs.select(id_col, F.regexp_replace(inside, WS + "+", " ").alias("_t")).where("_t is not null")
    cut = pre.select(id_col, F.split("_t", RECITAL_MARK, -1).alias("p"), F.expr(f"regexp_extract_all(_t, r'{RECITAL_MARK}', 0)").alias("f"))
    zipped = F.arrays_zip("f", F.slice("p", F.lit(2), F.size("p")).alias("b"))
    each = cut.select(id_col, F.posexplode(zipped).alias("k", "x")).where("x.f is not null").select(id_col, "k", F.col("x.f").alias("f"), F.col("x.b").alias("b"))
    each = each.withColumn("ok", is_recital(F.substring("b", 1, 300)))
    w = W.partitionBy(id_col).orderBy("k")
    each = each.withColumn("pos", F.sum(F.col("ok").cast("int")).over(w)).where("pos > 0")
    piece = F.when(F.col("ok"), F.col("b")).otherwise(F.concat("f", "b"))
    spans = each.groupBy(id_col, "pos").agg(F.array_sort(F.collect_list(F.struct("k", piece.alias("s")))).alias("l"))
    spans = spans.select(id_col, "pos", strip_ws(F.array_join(F.transform("l", lambda x: x["s"]), "")).alias("text"))
    # read twice, for the runs of footnotes and for the texts: stored, so that the recitals are cut once
    return strip_footnotes(materialize(spans, "recitals"), [id_col, "pos"], "text")


def footnote_runs(rows: DataFrame, id_cols: list[str], text_col: str) -> DataFrame:
    """(ids, run, n_marks, first_n, start, stop): runs of two or more consecutive close markers."""
    w = W.partitionBy(*id_cols).orderBy("k")
    m = marks(rows, id_cols, text_col, FOOTNOTE_MARK)
    goes_on = (F.col("n") == F.lag("n").over(w) + 1) & (F.col("start") - F.lag("stop").over(w) <= FOOTNOTE_GAP)
    m = m.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("run", F.sum("_new").over(w))
    runs = m.groupBy(*id_cols, "run").agg(F.count(F.lit(1)).alias("n_marks"), F.min("n").alias("first_n"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    return runs.where("n_marks >= 2")


def strip_footnotes(rows: DataFrame, id_cols: list[str], text_col: str) -> DataFrame:
    """``rows`` with embedded footnote blocks removed; texts without a removable block stay as they are."""
    likely = rows.where(F.size(F.split(text_col, r"\(\s*\d{1,2}\s*\)", -1)) > 2)  # a run has two markers at least
    runs = footnote_runs(likely.select(*id_cols, text_col), id_cols, text_col).groupBy(*id_cols).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("_runs"))
    both = rows.join(runs, id_cols, "left")
    oj, brk = f"r'{OJ_END}'", f"r'{SENTENCE_BREAK}'"
    ends = F.expr(f"""transform(_runs, x -> named_struct('a', x.start, 'b', x.stop, 't', substring({text_col}, int(x.stop + 1), {FOOTNOTE_GAP})))""")
    both = both.withColumn("_ends", ends)
    cuts = F.expr(f"""filter(transform(_ends, x -> named_struct('a', x.a, 'b', x.b + case
        when regexp_instr(x.t, {oj}) > 0 then regexp_instr(x.t, {oj}) + length(regexp_extract(x.t, {oj}, 0)) - 1
        when regexp_instr(x.t, {brk}) > 0 then regexp_instr(x.t, {brk}) + length(regexp_extract(x.t, {brk}, 0)) - 1 end)), x -> x.b is not null)""")
    both = both.withColumn("_cuts", cuts)
    fold = F.expr(f"""aggregate(_cuts, named_struct('s', '', 'e', cast(0 as bigint)),
        (acc, x) -> named_struct('s', concat(acc.s, if(x.a > acc.e, substring({text_col}, int(acc.e + 1), int(x.a - acc.e)), '')), 'e', greatest(acc.e, cast(x.b as bigint))),
        acc -> concat(acc.s, substring({text_col}, int(acc.e + 1), length({text_col}))))""")
    clean = F.when(F.col("_cuts").isNull() | (F.size("_cuts") == 0), F.col(text_col)).otherwise(collapse_ws(fold))
    return both.select(*[clean.alias(c) if c == text_col else F.col(c) for c in rows.columns])


def parse_documents(raw: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """(celex, title, date, recitals, articles, full_text) from (celex, text); a missing title falls back to ``meta``."""
    title, date = title_and_date(F.col("text"))
    base = raw.select("celex", title.alias("title"), date.alias("date"), F.col("text").alias("full_text"))
    if meta is not None:
        m = meta.select("celex", F.col("title").alias("_m")).dropDuplicates(["celex"])
        base = base.join(m, "celex", "left").withColumn("title", F.coalesce(F.nullif("title", F.lit("")), "_m", F.lit(""))).drop("_m")
    rec = recitals(raw, "celex", "text").groupBy("celex").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("recitals"))
    art = articles(raw, "celex", "text").groupBy("celex").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "number", "heading", "text"))), lambda x: F.struct(x["number"].alias("number"), x["heading"].alias("heading"), x["text"].alias("text"))).alias("articles"))
    out = base.join(rec, "celex", "left").join(art, "celex", "left")
    none = F.array()
    return out.select(
        "celex", "title", "date", F.coalesce("recitals", none.cast("array<string>")).alias("recitals"),
        F.coalesce("articles", none.cast("array<struct<number:int,heading:string,text:string>>")).alias("articles"), "full_text",
    )
