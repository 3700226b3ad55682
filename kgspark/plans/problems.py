"""Queries of the general problems 3 (hot keys) and 4 (nested records)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.functions.text import key_form, not_blank
from kgspark.operators import nested, skew
from kgspark.session import read_table

HOT_SHARE_PERCENT = 1


def p3_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Per entity key and per chunk_id: mentions, records, types, mode type, record sizes, first and last time (microseconds)."""
    ex = read_table(spark, sf, "extractions").select("seq", "chunk_id", "entities", "extracted_at")
    keys = ["key_kind", "key_value"]
    items = ex.select("seq", "chunk_id", "extracted_at", F.explode("entities").alias("e"))
    items = items.select("seq", "chunk_id", "extracted_at", F.col("e.text").alias("text"), F.nullif(key_form("e.type"), F.lit("")).alias("type"))
    ent = items.where(not_blank("text")).select(F.lit("entity").alias("key_kind"), key_form("text").alias("key_value"), "seq", "type", "extracted_at")
    chunk_types = items.where("chunk_id is not null").select(F.lit("chunk").alias("key_kind"), F.col("chunk_id").alias("key_value"), "type")
    # (key, record): the value of a hot key is spread over its records; then (key, mentions in the record)
    chunk_rec = ex.where("chunk_id is not null").select(
        F.lit("chunk").alias("key_kind"), F.col("chunk_id").alias("key_value"), "seq",
        F.size(F.coalesce("entities", F.array())).cast("bigint").alias("w"), F.col("extracted_at").alias("lo"), F.col("extracted_at").alias("hi"),
    )
    ent_rec = skew.compress(ent, keys, "seq", lo=F.min("extracted_at"), hi=F.max("extracted_at"))
    rec = ent_rec.unionByName(chunk_rec).withColumnRenamed("w", "mentions")
    sizes = skew.compress(rec, keys, "mentions", lo=F.min("lo"), hi=F.max("hi"))
    per_record = sizes.groupBy(*keys).agg(
        F.sum(F.col("w") * F.col("mentions")).alias("mentions"), F.sum("w").alias("records"),
        F.percentile("mentions", F.lit(0.5), F.col("w")).alias("median_per_record"),
        F.max("mentions").alias("max_per_record"), F.min("lo").alias("first_at"), F.max("hi").alias("last_at"),
    )
    types = skew.weighted_profile(ent.select(*keys, "type").unionByName(chunk_types), keys, "type")
    types = types.select(*keys, F.col("distinct_values").alias("types"), F.col("mode_value").alias("top_type"))
    out = per_record.join(types, keys, "left")
    times = {c: F.unix_micros(c) for c in ("first_at", "last_at")}
    return out.withColumns(times | {"types": F.coalesce("types", F.lit(0).cast("bigint"))})


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that hold at least one per cent of all entity elements, or of all records."""
    ex = read_table(spark, sf, "extractions")
    totals = ex.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size(F.coalesce("entities", F.array()))), F.lit(0)).alias("m"))
    held = F.when(F.col("key_kind") == "entity", F.col("mentions")).otherwise(F.col("records"))
    total = F.when(F.col("key_kind") == "entity", totals.select("m").scalar()).otherwise(totals.select("n").scalar())
    return p3_keys(spark, sf).where(held * 100 >= total * HOT_SHARE_PERCENT).select("key_kind", "key_value")


def _tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return nested.merkle_tables(read_table(spark, sf, "extraction_runs"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every entity, relation and span object of every readable line."""
    return nested.found_items(_tables(spark, sf))


def _flat(name: str):
    """A flat table with the places that lead to its parents; the identities are left to ``p4_objects`` and ``p4_bridge``."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = nested.flat_tables(_tables(spark, sf), [name])[name]
        return df.select(*[c for c in df.columns if not c.endswith("_hash")])

    return run


def _merkle(name: str):
    return lambda spark, sf: _tables(spark, sf)[name]


QUERIES = {
    "p3_found": p3_found,
    "p3_keys": p3_keys,
    "p4_found": p4_found,
    "p4_attempts": _flat("attempts"),
    "p4_entities": _flat("entities"),
    "p4_relations": _flat("relations"),
    "p4_spans": _flat("spans"),
    "p4_objects": _merkle("objects"),
    "p4_bridge": _merkle("bridge"),
}

# DuckDB's \s is ASCII only; the key form also collapses Unicode spaces.
_KEY = r"lower(trim(regexp_replace({0}, '[\s\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{1C}}-\x{{1F}}]+', ' ', 'g')))"


def sql_key(expr: str) -> str:
    """The key form as DuckDB SQL."""
    return _KEY.format(expr)


_P3 = f"""
WITH items AS (SELECT seq, chunk_id, extracted_at, unnest(entities) AS e FROM extractions),
m AS (SELECT seq, chunk_id, extracted_at, {sql_key("e.text")} AS ek, nullif({sql_key("e.type")}, '') AS type FROM items),
ent AS (SELECT 'entity' AS key_kind, ek AS key_value, seq, type, extracted_at FROM m WHERE ek <> ''),
rec AS (SELECT key_kind, key_value, seq, count(*) AS mentions, min(extracted_at) AS lo, max(extracted_at) AS hi FROM ent GROUP BY ALL
  UNION ALL SELECT 'chunk', chunk_id, seq, coalesce(len(entities), 0), extracted_at, extracted_at FROM extractions WHERE chunk_id IS NOT NULL),
a AS (SELECT key_kind, key_value, sum(mentions)::BIGINT AS mentions, count(*) AS records, median(mentions) AS median_per_record,
  max(mentions) AS max_per_record, epoch_us(min(lo)) AS first_at, epoch_us(max(hi)) AS last_at FROM rec GROUP BY ALL),
tc AS (SELECT key_kind, key_value, type, count(*) AS n FROM (SELECT key_kind, key_value, type FROM ent UNION ALL
  SELECT 'chunk', chunk_id, type FROM m WHERE chunk_id IS NOT NULL) WHERE type IS NOT NULL GROUP BY ALL),
t AS (SELECT key_kind, key_value, count(*) AS types, arg_min(type, (-n, type)) AS top_type FROM tc GROUP BY ALL)
"""

_SPACE = "'\ufeff \t' || chr(13) || chr(10) || chr(11) || chr(12) || chr(160)"
_SEATS = "CASE json_type({0}) WHEN 'ARRAY' THEN range(json_array_length({0})::BIGINT) WHEN 'OBJECT' THEN [0] ELSE [] END"
_AT = "CASE WHEN json_type({0}) = 'ARRAY' THEN json_extract({0}, '$[' || {1} || ']') ELSE {0} END"


def _object(x: str) -> str:
    """A JSON value as an object: text is parsed, anything else that is no object is an empty one."""
    parsed = f"({x} ->> '$')"
    return f"CASE WHEN json_type({x}) = 'OBJECT' THEN {x} WHEN json_type({x}) = 'VARCHAR' AND json_valid({parsed}) AND json_type({parsed}) = 'OBJECT' THEN json({parsed}) ELSE json('{{}}') END"


def _result(of: str) -> str:
    """The object that holds the items of ``of``, a table with JSON columns result, entities and relations; NULL if it holds nothing."""
    own = "CASE WHEN {0}_r IS NOT NULL AND json_type({0}_r) <> 'NULL' THEN {1} WHEN {0}_e IS NOT NULL OR {0}_l IS NOT NULL THEN json_object('entities', {0}_e, 'relations', {0}_l) ELSE json('{{}}') END"
    return own.format(of, _object(f"{of}_r"))


_P4 = f"""
WITH l AS (SELECT line_no, rtrim(ltrim(raw, {_SPACE}), chr(0) || {_SPACE}) AS s FROM extraction_runs WHERE raw IS NOT NULL AND line_no IS NOT NULL),
j AS (SELECT line_no, json(s) AS j FROM l WHERE json_valid(s) AND json_type(s) = 'OBJECT'),
w AS (SELECT line_no, j, CASE WHEN json_type(j, '$.record') = 'OBJECT' THEN j -> '$.record' END AS i FROM j),
o AS (SELECT line_no, {", ".join(f"coalesce(i -> '$.{c}', j -> '$.{c}') AS own_{k}" for c, k in (("chunk_id", "c"), ("run", "u"), ("attempts", "a"), ("result", "r"), ("entities", "e"), ("relations", "l")))} FROM w),
p AS (SELECT *, CASE WHEN json_type(own_u) = 'OBJECT' THEN own_u ELSE json('{{}}') END AS u FROM o),
q AS (SELECT *, u -> '$.result' AS run_r, u -> '$.entities' AS run_e, u -> '$.relations' AS run_l, coalesce(u -> '$.attempts', own_a) AS a, CASE WHEN json_type(own_c) = 'VARCHAR' THEN own_c ->> '$' END AS chunk_id FROM p),
b AS (SELECT line_no, chunk_id, a, unnest({_SEATS.format("a")}) AS attempt_pos FROM q WHERE a IS NOT NULL AND json_type(a) <> 'NULL'),
c AS (SELECT line_no, chunk_id, attempt_pos, {_AT.format("a", "attempt_pos")} AS x FROM b),
d AS (SELECT line_no, chunk_id, attempt_pos, x, x -> '$.result' AS at_r, x -> '$.entities' AS at_e, x -> '$.relations' AS at_l FROM c WHERE json_type(x) = 'OBJECT'),
t AS (SELECT line_no, chunk_id, attempt_pos, x, {_result("at")} AS res FROM d
UNION ALL SELECT line_no, chunk_id, 0, u, CASE WHEN ({_result("own")})::VARCHAR <> '{{}}' THEN {_result("own")} ELSE {_result("run")} END FROM q WHERE a IS NULL OR json_type(a) = 'NULL'),
e0 AS (SELECT line_no, chunk_id, attempt_pos, res -> '$.entities' AS a FROM t), e1 AS (SELECT *, unnest({_SEATS.format("a")}) AS item_pos FROM e0),
e AS (SELECT line_no, chunk_id, attempt_pos, item_pos, x FROM (SELECT *, {_AT.format("a", "item_pos")} AS x FROM e1) WHERE json_type(x) = 'OBJECT'),
r0 AS (SELECT line_no, chunk_id, attempt_pos, res -> '$.relations' AS a FROM t), r1 AS (SELECT *, unnest({_SEATS.format("a")}) AS item_pos FROM r0),
r AS (SELECT line_no, chunk_id, attempt_pos, item_pos, x FROM (SELECT *, {_AT.format("a", "item_pos")} AS x FROM r1) WHERE json_type(x) = 'OBJECT'),
s0 AS (SELECT line_no, chunk_id, attempt_pos, item_pos, x -> '$.spans' AS a FROM e), s1 AS (SELECT *, unnest({_SEATS.format("a")}) AS sub_pos FROM s0),
s AS (SELECT line_no, chunk_id, attempt_pos, item_pos, sub_pos, x FROM (SELECT *, {_AT.format("a", "sub_pos")} AS x FROM s1) WHERE json_type(x) = 'OBJECT')
"""

ORACLES = {
    "p3_keys": _P3
    + """SELECT a.key_kind, a.key_value, mentions, records, median_per_record, max_per_record, first_at, last_at,
coalesce(types, 0) AS types, top_type FROM a LEFT JOIN t ON a.key_kind = t.key_kind AND a.key_value = t.key_value""",
    "p3_found": _P3
    + """SELECT key_kind, key_value FROM a WHERE
CASE WHEN key_kind = 'entity' THEN mentions ELSE records END * 100 >=
CASE WHEN key_kind = 'entity' THEN (SELECT sum(coalesce(len(entities), 0)) FROM extractions) ELSE (SELECT count(*) FROM extractions) END""",
    "p4_attempts": _P4 + "SELECT line_no, chunk_id, attempt_pos::INT AS attempt_pos, x ->> '$.n' AS n, x ->> '$.status' AS status, x ->> '$.seconds' AS seconds FROM t",
    "p4_entities": _P4 + "SELECT line_no, chunk_id, attempt_pos::INT AS attempt_pos, item_pos::INT AS item_pos, x ->> '$.text' AS text, x ->> '$.type' AS type FROM e",
    "p4_relations": _P4 + "SELECT line_no, chunk_id, attempt_pos::INT AS attempt_pos, item_pos::INT AS item_pos, x ->> '$.subject' AS subject, x ->> '$.relation' AS relation, x ->> '$.object' AS object FROM r",
    "p4_spans": _P4 + """SELECT line_no, chunk_id, attempt_pos::INT AS attempt_pos, item_pos::INT AS item_pos, sub_pos::INT AS sub_pos, x ->> '$.surface' AS surface, x ->> '$.start' AS start, x ->> '$.end' AS "end" FROM s""",
    "p4_found": _P4
    + """SELECT DISTINCT line_no, attempt_pos::INT AS attempt_pos, 'entity' AS item_kind, item_pos::INT AS item_pos, -1 AS sub_pos, coalesce(x ->> '$.text', '') AS item_text FROM e
UNION ALL SELECT DISTINCT line_no, attempt_pos::INT, 'relation', item_pos::INT, -1, coalesce(x ->> '$.subject', '') FROM r
UNION ALL SELECT DISTINCT line_no, attempt_pos::INT, 'span', item_pos::INT, sub_pos::INT, coalesce(x ->> '$.surface', '') FROM s""",
}
