"""Precision, deterministic samples, verdict overlay and the evaluation report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.functions.text import celex_of
from kgspark.operators.skew import spread_rank


def hash_order(*cols: Column | str, seed: int) -> Column:
    """Deterministic pseudo-random order that any engine can repeat: md5 of the joined values and the seed."""
    return F.md5(F.concat_ws("|", *cols, F.lit(str(seed))))


def precision(rows: DataFrame) -> DataFrame:
    """One row (correct, total, precision); precision of an empty sample is NULL."""
    return rows.agg(
        F.count_if(F.col("is_correct") == "Y").alias("correct"), F.count(F.lit(1)).alias("total"),
        F.try_divide(F.count_if(F.col("is_correct") == "Y").cast("double"), F.count(F.lit(1)).cast("double")).alias("precision"),
    )


def precision_by_type(rows: DataFrame) -> DataFrame:
    """(entity_type, correct, total, precision); a missing type counts as ''."""
    return (
        rows.groupBy(F.coalesce("entity_type", F.lit("")).alias("entity_type"))
        .agg(F.count_if(F.col("is_correct") == "Y").alias("correct"), F.count(F.lit(1)).alias("total"))
        .withColumn("precision", F.col("correct").cast("double") / F.col("total"))
    )


def metrics(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Long form (metric, value): overall and per type."""
    e = precision(entities).select(F.expr("stack(2, 'entity_precision', precision, 'entity_sample_size', double(total)) as (metric, value)"))
    r = precision(relations).select(F.expr("stack(2, 'relation_precision', precision, 'relation_sample_size', double(total)) as (metric, value)"))
    t = precision_by_type(entities).withColumn("t", F.lower("entity_type")).groupBy("t").agg(F.sum("correct").alias("c"), F.sum("total").alias("n"))
    t = t.select(F.expr("stack(2, concat('entity_precision_', t), double(c) / n, concat('entity_count_', t), double(n)) as (metric, value)"))
    return e.unionByName(r).unionByName(t)


def relation_gap(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """One row: squared entity precision against the relation precision found, with the small-sample caveat."""
    p = precision(entities).select(F.col("precision").alias("entity_precision")).scalar()
    r = precision(relations)
    r = r.select(p.alias("entity_precision"), F.col("precision").alias("actual"), F.col("total").alias("n"))
    r = r.withColumn("predicted", F.col("entity_precision") * F.col("entity_precision")).withColumn("gap", F.abs(F.col("predicted") - F.col("actual")))
    word = F.when(F.col("gap") < 0.15, "close to").otherwise("notably different from")
    return r.select("predicted", "actual", "gap", word.alias("closeness"), (F.col("n") < 20).alias("small_sample"))


def sample_per_group(rows: DataFrame, group: str, id_col: str, k: int = 10, seed: int = 42) -> DataFrame:
    """``k`` rows of every group in hash order; the ranking is cut on the map side before the shuffle."""
    w = W.partitionBy(group).orderBy(hash_order(F.col(id_col).cast("string"), seed=seed), id_col)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def labelling_sample(ex: DataFrame, per_document: int = 5, seed: int = 42) -> DataFrame:
    """(seq, chunk_id, celex, stratum, rank): per document half recitals, the rest articles, of records with 2 to 6 entities."""
    half = per_document // 2
    band = ex.where(F.size("entities").between(2, 6)).select("seq", "chunk_id", celex_of("chunk_id").alias("celex"))
    kind = F.when(F.col("chunk_id").contains("_recital_"), "recital").when(F.col("chunk_id").contains("_article_"), "article")
    w = W.partitionBy("celex", "stratum").orderBy(hash_order(F.col("seq").cast("string"), seed=seed), "seq")
    ranked = band.withColumn("stratum", kind).where("stratum is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_document)
    return ranked.where(F.when(F.col("stratum") == "recital", F.col("rank") <= half).otherwise(F.col("rank") <= per_document - half))


def review_rows(sample: DataFrame, ex: DataFrame, texts: DataFrame) -> dict[str, DataFrame]:
    """Review tables of the sampled records with blank label columns; an unknown chunk has text ''."""
    one = texts.groupBy("chunk_id").agg(F.max_by("text", "seq").alias("chunk_text"))
    picked = ex.join(sample.select("seq"), "seq", "left_semi").join(one, "chunk_id", "left").withColumn("chunk_text", F.coalesce("chunk_text", F.lit("")))
    blank = F.lit("")
    ent = picked.select("seq", "chunk_id", "chunk_text", F.posexplode("entities").alias("pos", "e")).where("e is not null")
    rel = picked.select("seq", "chunk_id", "chunk_text", F.posexplode("relations").alias("pos", "r")).where("r is not null")
    return {
        "entities": ent.select("seq", "pos", "chunk_id", "chunk_text", F.col("e.text").alias("entity_text"), F.col("e.type").alias("entity_type"), blank.alias("is_correct"), blank.alias("corrected_type"), blank.alias("notes")),
        "relations": rel.select("seq", "pos", "chunk_id", "chunk_text", "r.subject", "r.relation", "r.object", blank.alias("is_correct"), blank.alias("notes")),
    }


def spot_check(rows: DataFrame, id_cols: list[str], share: float = 0.2, seed: int = 7) -> DataFrame:
    """All rows marked N plus a hash-ordered share of those marked Y (at least one if there is any).

    ``rows`` must hold each combination of ``id_cols`` once.  The rank of the Y rows is taken without a
    global window.
    """
    wrong = rows.where("is_correct = 'N'").select(*id_cols, "is_correct")
    right = rows.where("is_correct = 'Y'").select(*id_cols, "is_correct")
    n = right.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    if not n:
        return wrong
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in id_cols]
    h = F.conv(F.substring(hash_order(*text, seed=seed), 1, 15), 16, 10).cast("bigint")
    ranked = spread_rank(right.withColumn("h", F.shiftleft(h, 3)).withColumn("g", F.lit(0)), ["g"], ["h", *id_cols], n)
    return wrong.unionByName(ranked.where(F.col("rank") <= max(1, int(n * share))).select(*id_cols, "is_correct"))


def overlay_verdicts(rows: DataFrame, verdicts: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """``rows`` with the verdict's fields where one exists for the composite key (unique in ``verdicts``; NULL equals '')."""
    v = verdicts.select(*[F.coalesce(k, F.lit("")).alias(f"_k_{k}") for k in keys], *[F.col(f).alias(f"_v_{f}") for f in fields], F.lit(True).alias("_hit"))
    cond = [F.coalesce(rows[k], F.lit("")) == v[f"_k_{k}"] for k in keys]
    both = rows.join(v, cond, "left")
    cols = [F.when(F.col("_hit"), F.col(f"_v_{c}")).otherwise(rows[c]).alias(c) if c in fields else rows[c] for c in rows.columns]
    return both.select(*cols, F.coalesce("_hit", F.lit(False)).alias("applied"))


def percent(x: float | None, digits: int) -> str:
    """Percent text, rounded half to even on the binary value."""
    return "n/a" if x is None else f"{x:.{digits}%}"


METHOD_NOTE = "Labels were proposed by a reviewing backend and adjudicated; they are no independent ground truth."
RELATION_NOTE = (
    "A relation can only be right if both of its ends are and if the claim between them is.  Beyond the ends, relations fail by a wrong type, "
    "by a reversed direction and by claims that the passage does not make."
)
KNOWN_PATTERNS = [
    "Types mixed up at their borders: an instrument or a scheme taken for an act, an act for a body.",
    "Spans that run several things together.",
    "Citations that lost their first word.",
    "A bare kind of act without number; the graph load only removes such words behind 'this' or 'the'.",
]


def report(entities: DataFrame, relations: DataFrame) -> str:
    """Markdown report; besides two rows of totals only one row per entity type reaches the driver."""
    e, r = precision(entities).first(), precision(relations).first()
    lines = ["# Extraction quality", "", METHOD_NOTE, "", "## Overall", f"- Entity precision: {percent(e['precision'], 1)} ({e['total']} sampled)", f"- Relation precision: {percent(r['precision'], 1)} ({r['total']} sampled)", "", "## Entity precision by type"]
    types = precision_by_type(entities).orderBy("precision", "entity_type").collect()
    lines += [f"- {t['entity_type']}: {t['correct']}/{t['total']} = {percent(t['precision'], 0)}" for t in types]
    lines += ["", "## Relations against entities"]
    g = relation_gap(entities, relations).first()
    if g["predicted"] is not None and g["actual"] is not None:
        note = " (small sample, not reliable)" if g["small_sample"] else ""
        lines += [f"Both ends right by chance: {percent(g['predicted'], 0)}; found {percent(g['actual'], 0)}, {g['closeness']} the estimate{note}."]
    lines += [RELATION_NOTE, "", "## Known kinds of entity errors", *(f"- {x}" for x in KNOWN_PATTERNS)]
    return "\n".join(lines)
