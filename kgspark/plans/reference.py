"""Queries of the pipeline's own operators over the project's tables, with DuckDB oracles.

Structure operators (title, recitals, articles, footnotes, sub-paragraphs) run on act texts that both engines
build from the lines of ``documents``; the oracle then selects the expected parts straight from the lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.functions import prompts
from kgspark.functions import text as T
from kgspark.operators import analytics, chunking, evaluate, extract, graph, ingest, rag
from kgspark.plans.problems import sql_key
from kgspark.session import materialize, read_table, spread
from kgspark.sources import files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_TYPES = ", ".join(f"'{t}'" for t in T.ENTITY_TYPES)
_RELS = ", ".join(f"'{t}'" for t in T.RELATION_TYPES)
_WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}]"


def _self(x: str) -> str:
    return rf"regexp_full_match({_strip(x)}, '(?i)(this|the)\s+(regulation|directive|act|decision)')"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _celex(x: str) -> str:
    return f"split_part(split_part({x}, '_recital_', 1), '_article_', 1)"


def query(sql: str | None = None):
    """Registers a query under its function's name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, *names: str):
    got = [read_table(spark, sf, n) for n in names]
    return got[0] if len(got) == 1 else got


_M = f"""WITH m AS (SELECT seq, chunk_id, pos, e.text AS text, e.type AS type, {sql_key("e.text")} AS key, {_celex("chunk_id")} AS celex
FROM (SELECT seq, chunk_id, unnest(range(len(entities))) AS pos, unnest(entities) AS e FROM extractions) WHERE e IS NOT NULL),
u AS (SELECT * FROM m WHERE type IN ({_TYPES}) AND key <> '' AND NOT {_self("text")}),
r AS (SELECT seq, chunk_id, pos, r.subject AS subject, r.relation AS relation, r.object AS object, {_celex("chunk_id")} AS celex
FROM (SELECT seq, chunk_id, unnest(range(len(relations))) AS pos, unnest(relations) AS r FROM extractions) WHERE r IS NOT NULL),
votes AS (SELECT key, type, count(*) AS n, min((seq, pos)) AS first FROM u GROUP BY ALL),
canon AS (SELECT key, arg_min(type, (-n, first)) AS type, max(n) AS votes FROM votes GROUP BY key),
nodes AS (SELECT u.key, arg_min(u.text, (u.seq, u.pos)) AS name, any_value(c.type) AS type FROM u JOIN canon c ON u.key = c.key GROUP BY u.key),
docs AS (SELECT coalesce(l.celex, g.celex) AS celex, coalesce(nullif(g.title, ''), nullif(l.loaded, ''), '') AS title
FROM (SELECT celex, arg_max(doc_title, seq) AS loaded FROM chunks WHERE celex IS NOT NULL GROUP BY celex) l FULL JOIN registry g ON l.celex = g.celex),
cn AS (SELECT chunk_id, max_by(struct_pack(celex := celex, chunk_type := chunk_type, unit_number := unit_number, part := part, heading := heading, text := text), seq) AS c
FROM chunks WHERE chunk_id IN (SELECT chunk_id FROM extractions) GROUP BY chunk_id),
me AS (SELECT DISTINCT chunk_id, key FROM u WHERE chunk_id IN (SELECT chunk_id FROM chunks)),
ee AS (SELECT DISTINCT {sql_key("r.subject")} AS src, r.relation AS rel, {sql_key("r.object")} AS dst FROM r
JOIN u a ON a.seq = r.seq AND a.key = {sql_key("r.subject")} JOIN u b ON b.seq = r.seq AND b.key = {sql_key("r.object")} WHERE r.relation IN ({_RELS})),
nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rel, other, outgoing DESC) AS rank FROM (
SELECT src AS key, rel, dst AS other, true AS outgoing FROM ee UNION ALL SELECT dst, rel, src, false FROM ee WHERE src <> dst)) WHERE rank <= 15)
"""


# --- flagship
@query(_M + """SELECT row_number() OVER (ORDER BY mentions DESC, key) AS rank, key, name, type, mentions, documents FROM (
SELECT u.key, any_value(n.name) AS name, any_value(n.type) AS type, count(*) AS mentions, count(DISTINCT celex) AS documents
FROM u JOIN nodes n ON u.key = n.key GROUP BY u.key ORDER BY mentions DESC, u.key LIMIT 20)""")
def entity_overview(spark: SparkSession, sf: str) -> DataFrame:
    """The entities mentioned most, with canonical type and number of documents."""
    return rag.entity_overview(_t(spark, sf, "extractions"))


# --- scans
@query(f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS i, line FROM (SELECT doc_id, p, {_strip("l")} AS line FROM (
SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS p FROM documents)) WHERE line <> ''""")
def scan_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Non-empty stripped lines of every document."""
    d = _t(spark, sf, "documents").select("doc_id", F.posexplode(ingest.text_lines(F.col("text"))).alias("i", "line"))
    return d.select("doc_id", F.col("i").cast("bigint").alias("i"), "line")


@query("SELECT celex, celex IN (SELECT celex FROM chunks) AS downloaded FROM (SELECT DISTINCT celex FROM registry)")
def registry_status(spark: SparkSession, sf: str) -> DataFrame:
    """Which registered acts have arrived."""
    reg, chunks = _t(spark, sf, "registry", "chunks")
    return files.registry_status(reg, chunks)


@query("""SELECT c.celex, coalesce(nullif(max(doc_title), ''), max(g.title), '') AS title FROM chunks c LEFT JOIN registry g ON c.celex = g.celex GROUP BY c.celex""")
def title_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Title of a document, else that of its sidecar."""
    chunks, reg = _t(spark, sf, "chunks", "registry")
    own = chunks.groupBy("celex").agg(F.max("doc_title").alias("own"))
    return own.join(reg.select("celex", "title").dropDuplicates(["celex"]), "celex", "left").select("celex", F.coalesce(F.nullif("own", F.lit("")), "title", F.lit("")).alias("title"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def json_props_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A JSON column parsed by schema."""
    return _t(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query(_M + "SELECT DISTINCT name FROM nodes")
def entity_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of all entities, in order."""
    return rag.entity_names(graph.entity_nodes(_t(spark, sf, "extractions")))


# --- filters and projections
_FOOT = "['EN', ' EN ', 'L 1/' || doc_id, 'L  1689/1', '12.7.2024', 'official journal of the european union', 'As of 12.7.2024', coalesce(lang, 'EN')]"


@query(rf"""SELECT doc_id, i, line FROM (SELECT doc_id, unnest(range(8)) AS i, unnest({_FOOT}) AS line FROM documents)
WHERE NOT regexp_full_match(trim(line), 'EN|(?i:Official Journal of the European Union)|\d{{1,2}}\.\d{{1,2}}\.\d{{4}}|L\s*\d+/\d+')""")
def footer_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Furniture told from near misses on eight fixed lines; ``footer_lines`` filters the documents' own lines."""
    d = _t(spark, sf, "documents")
    lines = F.array(F.lit("EN"), F.lit(" EN "), F.concat(F.lit("L 1/"), F.col("doc_id").cast("string")), F.lit("L  1689/1"), F.lit("12.7.2024"), F.lit("official journal of the european union"), F.lit("As of 12.7.2024"), F.coalesce("lang", F.lit("EN")))
    out = d.select("doc_id", F.posexplode(lines).alias("i", "line")).where(~T.is_footer_line("line"))
    return out.select("doc_id", F.col("i").cast("bigint").alias("i"), "line")


@query(rf"""SELECT doc_id, p AS i, l AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS p FROM documents)
WHERE NOT regexp_full_match({_strip("l")}, 'EN|(?i:Official Journal of the European Union)|\d{{1,2}}\.\d{{1,2}}\.\d{{4}}|L\s*\d+/\d+')""")
def footer_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of every document without page furniture."""
    d = spread(_t(spark, sf, "documents").select("doc_id", "text"))
    out = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).where(~T.is_footer_line("line"))
    return out.select("doc_id", F.col("i").cast("bigint").alias("i"), "line")


@query(f"""WITH n AS (SELECT chunk_id, entity_text AS text FROM entities_review UNION ALL SELECT chunk_id, 'this ' || split_part(chunk_type, 'x', 1) || 'act' FROM chunks
UNION ALL SELECT chunk_id, CASE seq % 5 WHEN 0 THEN ' The  Regulation ' WHEN 1 THEN 'this Act' WHEN 2 THEN 'Regulation' WHEN 3 THEN 'the decision' ELSE 'the directives' END FROM chunks)
SELECT text, count(*) AS n, {_self("text")} AS self_reference FROM n WHERE text IS NOT NULL GROUP BY text""")
def self_reference_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Which names only point at the act itself."""
    rev, chunks = _t(spark, sf, "entities_review", "chunks")
    m = F.col("seq") % 5
    form = F.when(m == 0, " The  Regulation ").when(m == 1, "this Act").when(m == 2, "Regulation").when(m == 3, "the decision").otherwise("the directives")
    n = rev.select("chunk_id", F.col("entity_text").alias("text")).unionByName(chunks.select("chunk_id", F.concat(F.lit("this "), F.element_at(F.split("chunk_type", "x"), 1), F.lit("act")).alias("text"))).unionByName(chunks.select("chunk_id", form.alias("text")))
    return n.where("text is not null").groupBy("text").agg(F.count(F.lit(1)).alias("n")).withColumn("self_reference", T.is_self_reference("text"))


@query(_M + f"SELECT seq, pos, text, type FROM m WHERE type IN ({_TYPES})")
def type_whitelist(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions of a known type."""
    return graph.mentions(_t(spark, sf, "extractions")).where(F.col("type").isin(T.ENTITY_TYPES)).select("seq", "pos", "text", "type")


@query("SELECT seq, chunk_id FROM chunks WHERE chunk_id IN (SELECT chunk_id FROM extractions)")
def chunks_with_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks that were extracted."""
    chunks, ex = _t(spark, sf, "chunks", "extractions")
    return chunks.select("seq", "chunk_id").join(ex.select("chunk_id"), "chunk_id", "left_semi")


@query("SELECT seq, length(text) AS n FROM chunks WHERE length(text) > 150")
def long_text_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks long enough to extract from."""
    return _t(spark, sf, "chunks").where(F.length("text") > 150).select("seq", F.length("text").alias("n"))


@query("SELECT seq, len(entities) AS n FROM extractions WHERE len(entities) BETWEEN 2 AND 6")
def entity_count_band(spark: SparkSession, sf: str) -> DataFrame:
    """Records with two to six entities."""
    return _t(spark, sf, "extractions").where(F.size("entities").between(2, 6)).select("seq", F.size("entities").alias("n"))


@query(f"SELECT chunk_id, entity_text, entity_type FROM entities_review WHERE {_strip('coalesce(is_correct, chr(32))')} = ''")
def pending_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Review rows without a label."""
    return _t(spark, sf, "entities_review").where(T.strip_ws(F.coalesce("is_correct", F.lit(""))) == "").select("chunk_id", "entity_text", "entity_type")


@query("SELECT is_correct, count(*) AS n FROM entities_review WHERE is_correct IN ('Y', 'N') GROUP BY 1")
def correct_split(spark: SparkSession, sf: str) -> DataFrame:
    """Rows marked Y and N."""
    return _t(spark, sf, "entities_review").where(F.col("is_correct").isin("Y", "N")).groupBy("is_correct").agg(F.count(F.lit(1)).alias("n"))


_CITED = "'Council Directive ' || seq || ' of 5 April 1993 (OJ L 95, p. 29). ' || text"


@query(rf"""WITH t AS (SELECT seq, CASE WHEN seq % 3 = 0 THEN {_CITED} ELSE text END AS t FROM chunks WHERE text IS NOT NULL),
s AS (SELECT seq, CASE WHEN regexp_matches(substr(t, 1, 300), '\(OJ [^)]*\)\.') THEN regexp_extract(substr(t, 1, 300), '(?s)^.*?\(OJ [^)]*\)\.') ELSE substr(t, 1, 200) END AS s FROM t)
SELECT seq, s AS snippet, NOT regexp_matches(s, '\(OJ [^)]*\)\.') AS recital FROM s""")
def recital_predicate(spark: SparkSession, sf: str) -> DataFrame:
    """Recital or citation, with the snippet the decision rests on."""
    c = _t(spark, sf, "chunks").where("text is not null")
    cited = F.concat(F.lit("Council Directive "), F.col("seq").cast("string"), F.lit(" of 5 April 1993 (OJ L 95, p. 29). "), "text")
    c = c.select("seq", F.when(F.col("seq") % 3 == 0, cited).otherwise(F.col("text")).alias("t"))
    return c.select("seq", T.citation_snippet("t").alias("snippet"), T.is_recital("t").alias("recital"))


QUERIES["citation_snippet"] = lambda spark, sf: recital_predicate(spark, sf).select("seq", "snippet")
ORACLES["citation_snippet"] = ORACLES["recital_predicate"].replace("SELECT seq, s AS snippet, NOT regexp_matches(s, '\\(OJ [^)]*\\)\\.') AS recital FROM s", "SELECT seq, s AS snippet FROM s")


@query(_M + "SELECT seq, pos, chunk_id, celex, text, type, key FROM m")
def flatten_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """One row per mention."""
    return graph.mentions(_t(spark, sf, "extractions"))


@query(_M + "SELECT seq, pos, chunk_id, celex, subject, relation, object FROM r")
def flatten_relations(spark: SparkSession, sf: str) -> DataFrame:
    """One row per relation."""
    return graph.relations(_t(spark, sf, "extractions"))


@query(f"SELECT {_celex('chunk_id')} AS celex, count(*) AS n FROM extractions GROUP BY 1")
def id_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """Records per document id read from the chunk id."""
    return _t(spark, sf, "extractions").groupBy(T.celex_of("chunk_id").alias("celex")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT celex, 'https://example.org/legal-content/' || celex || '/PDF' AS pdf_url FROM registry")
def url_template(spark: SparkSession, sf: str) -> DataFrame:
    """Document addresses."""
    return _t(spark, sf, "registry").select("celex", files.document_url().alias("pdf_url"))


_S = f"""WITH b AS (SELECT seq, chunk_id, {_celex("chunk_id")} AS celex, CASE WHEN contains(chunk_id, '_recital_') THEN 'recital' WHEN contains(chunk_id, '_article_') THEN 'article' END AS stratum
FROM extractions WHERE len(entities) BETWEEN 2 AND 6),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY celex, stratum ORDER BY md5(seq || '|42'), seq) AS rank FROM b WHERE stratum IS NOT NULL)
WHERE rank <= CASE WHEN stratum = 'recital' THEN 2 ELSE 3 END)
"""


@query(_S + "SELECT seq, chunk_id, celex, stratum, rank FROM s")
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Labelling sample: per document two recitals and three articles."""
    return evaluate.labelling_sample(_t(spark, sf, "extractions"))


@query(_S + """, t AS (SELECT chunk_id, arg_max(text, seq) AS text FROM chunks GROUP BY 1), p AS (SELECT e.seq, e.chunk_id, coalesce(t.text, '') AS chunk_text, entities FROM extractions e JOIN s ON e.seq = s.seq LEFT JOIN t ON e.chunk_id = t.chunk_id)
SELECT seq, pos, chunk_id, chunk_text, e.text AS entity_text, e.type AS entity_type, '' AS is_correct, '' AS corrected_type, '' AS notes
FROM (SELECT seq, chunk_id, chunk_text, unnest(range(len(entities))) AS pos, unnest(entities) AS e FROM p) WHERE e IS NOT NULL""")
def review_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Review rows of the labelling sample."""
    ex, chunks = _t(spark, sf, "extractions", "chunks")
    return evaluate.review_rows(evaluate.labelling_sample(ex), ex, chunks)["entities"]


# --- joins
@query(_M + "SELECT seq, pos, m.celex, substr(g.title, 1, 60) AS document FROM m LEFT JOIN registry g ON m.celex = g.celex")
def title_map_join(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions with the short title of their act."""
    ex, reg = _t(spark, sf, "extractions", "registry")
    return analytics.with_titles(graph.mentions(ex), reg).select("seq", "pos", "celex", "document")


@query("SELECT seq, chunk_id FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM extractions WHERE chunk_id IS NOT NULL)")
def resume_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks still to extract."""
    chunks, ex = _t(spark, sf, "chunks", "extractions")
    return extract.pending(chunks.select("seq", "chunk_id"), ex)


def _failed(ex: DataFrame) -> DataFrame:
    """Ids of which some record came back empty."""
    return ex.where(F.coalesce(F.size("entities"), F.lit(0)) <= 0).select("chunk_id").distinct()


_F = "WITH f AS (SELECT DISTINCT chunk_id FROM extractions WHERE coalesce(len(entities), 0) = 0)"


@query(_F + " SELECT c.seq, c.chunk_id, c.chunk_type FROM chunks c JOIN f ON c.chunk_id = f.chunk_id")
def retry_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of the failed records."""
    chunks, ex = _t(spark, sf, "chunks", "extractions")
    return chunks.select("seq", "chunk_id", "chunk_type").join(_failed(ex), "chunk_id")


@query("SELECT DISTINCT chunk_id FROM extractions WHERE chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE chunk_id IS NOT NULL)")
def missing_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded ids without a chunk."""
    chunks, ex = _t(spark, sf, "chunks", "extractions")
    return ex.select("chunk_id").where("chunk_id is not null").distinct().join(chunks.select("chunk_id"), "chunk_id", "left_anti")


class _ActsOnly(extract.RuleBackend):
    """A second backend that only knows acts."""

    name = "second"

    def load(self) -> None:
        super().load()
        self.patterns = self.patterns[:1]


@query(_F + r""", t AS (SELECT c.chunk_id, arg_max(text, seq) AS text FROM chunks c JOIN f ON c.chunk_id = f.chunk_id GROUP BY 1)
SELECT chunk_id, len(entities) AS n, 'first' AS backend FROM extractions WHERE len(entities) > 0
UNION ALL SELECT chunk_id, len(regexp_extract_all(coalesce(text, ''), '\b(?:Regulation|Directive|Decision) ?\((?:EU|EC)\) ?(?:No )?\d{1,4}/\d{1,4}')), 'second' FROM t""")
def retry_union(spark: SparkSession, sf: str) -> DataFrame:
    """Results of the first pass, and those of a second backend for the chunks it failed on."""
    chunks, ex = _t(spark, sf, "chunks", "extractions")
    one = ex.where(F.size("entities") > 0).select("chunk_id", F.size("entities").alias("n"), F.lit("first").alias("backend"))
    again = chunks.join(_failed(ex), "chunk_id", "left_semi").groupBy("chunk_id").agg(F.max_by("text", "seq").alias("text"))
    two = extract.run(again, _ActsOnly()).select("chunk_id", F.size("entities").alias("n"), "backend")
    return one.unionByName(two)


_V = """WITH v AS (SELECT coalesce(chunk_id, '') AS a, coalesce(entity_text, '') AS b, coalesce(entity_type, '') AS c, 'N' AS vc, max(corrected_type) AS vt FROM entities_review WHERE corrected_type <> '' GROUP BY ALL)"""


@query(_V + """ SELECT chunk_id, entity_text, entity_type, CASE WHEN vc IS NOT NULL THEN vc ELSE is_correct END AS is_correct, CASE WHEN vc IS NOT NULL THEN vt ELSE corrected_type END AS corrected_type, vc IS NOT NULL AS applied
FROM entities_review LEFT JOIN v ON coalesce(chunk_id, '') = a AND coalesce(entity_text, '') = b AND coalesce(entity_type, '') = c""")
def verdict_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """Review rows overlaid by adjudicated verdicts on a composite key."""
    rows = _t(spark, sf, "entities_review").select("chunk_id", "entity_text", "entity_type", "is_correct", "corrected_type")
    key = ["chunk_id", "entity_text", "entity_type"]
    v = rows.where("corrected_type <> ''").groupBy(*[F.coalesce(k, F.lit("")).alias(k) for k in key]).agg(F.lit("N").alias("is_correct"), F.max("corrected_type").alias("corrected_type"))
    return evaluate.overlay_verdicts(rows, v, key, ["is_correct", "corrected_type"])


@query(_M + f"""SELECT r.seq, r.pos, subject, relation, object FROM r JOIN (SELECT seq, list_transform(entities, lambda e: {sql_key("e.text")}) AS k FROM extractions) x ON r.seq = x.seq
WHERE list_contains(k, {sql_key("subject")}) AND list_contains(k, {sql_key("object")})""")
def relation_grounding(spark: SparkSession, sf: str) -> DataFrame:
    """Relations whose ends are among the record's entities."""
    return graph.grounded_relations(_t(spark, sf, "extractions"))


@query(_M + "SELECT src, rel, dst FROM ee")
def rel_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Relation edges of the graph."""
    return graph.relation_edges(_t(spark, sf, "extractions"))


@query(_M + f""", c AS (SELECT seq, {sql_key("subject")} AS key, min(pos) AS pos FROM r GROUP BY ALL)
SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY pos) AS rank, name FROM c JOIN nodes n ON c.key = n.key""")
def known_name_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate names grounded in the graph: known spelling, candidate order, no repeats."""
    ex = _t(spark, sf, "extractions")
    return graph.known_names(graph.relations(ex).select("seq", "pos", F.col("subject").alias("name")), graph.entity_nodes(ex), "seq")


@query(_M + "SELECT key, name, type FROM nodes WHERE name IN (SELECT subject FROM relations_review)")
def resolve_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Entities by exact name."""
    ex, rev = _t(spark, sf, "extractions", "relations_review")
    return graph.entity_nodes(ex).join(rev.select(F.col("subject").alias("name")).distinct(), "name", "left_semi").select("key", "name", "type")


# --- graph
@query(_M + "SELECT celex, title FROM docs")
def doc_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Document nodes."""
    return graph.document_nodes(*_t(spark, sf, "chunks", "registry"))


@query(_M + "SELECT chunk_id, c.celex AS celex, c.chunk_type AS chunk_type, c.unit_number AS unit_number, c.part AS part, c.heading AS heading, c.text AS text FROM cn")
def chunk_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk nodes, last write wins."""
    return graph.chunk_nodes(*_t(spark, sf, "chunks", "extractions"))


@query("SELECT DISTINCT celex, chunk_id FROM chunks WHERE celex IS NOT NULL AND chunk_id IN (SELECT chunk_id FROM extractions)")
def has_chunk_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Document to chunk edges."""
    return graph.has_chunk_edges(*_t(spark, sf, "chunks", "extractions"))


@query(_M + "SELECT key, name, type FROM nodes")
def entity_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Entity nodes: first spelling, canonical type."""
    return graph.entity_nodes(_t(spark, sf, "extractions"))


@query(_M + "SELECT chunk_id, key FROM me")
def mention_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk to entity edges."""
    return graph.mention_edges(*_t(spark, sf, "extractions", "chunks"))


@query("""SELECT 'chunk' AS node, chunk_id AS id, count(*) AS n FROM chunks GROUP BY chunk_id HAVING count(*) > 1
UNION ALL SELECT 'document', celex, count(*) FROM registry GROUP BY celex HAVING count(*) > 1""")
def pk_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that are not unique in the tables as loaded."""
    chunks, reg = _t(spark, sf, "chunks", "registry")
    return graph.pk_violations({"chunk": (chunks, "chunk_id"), "document": (reg, "celex")})


@query(_M + "SELECT key, rank, rel, other, outgoing FROM nb")
def neighborhood_top15(spark: SparkSession, sf: str) -> DataFrame:
    """Up to fifteen edges of every entity."""
    return graph.neighborhood(graph.relation_edges(_t(spark, sf, "extractions"))).select("key", "rank", "rel", "other", "outgoing")


_TRUNC = r"""CASE WHEN length(x) <= 600 THEN x WHEN regexp_matches(substr(x, 1, 600), '(?s)^.+[.;] ') THEN regexp_extract(substr(x, 1, 600), '(?s)^(.+[.;]) ', 1) ELSE regexp_replace(substr(x, 1, 600), '""" + _WS + r"""+$', '') || '...' END"""
_C5 = _M + f""", t5 AS (SELECT key, rank, chunk_id, celex FROM (SELECT me.key, me.chunk_id, cn.c.celex AS celex, row_number() OVER (PARTITION BY key ORDER BY cn.c.celex, me.chunk_id) AS rank FROM me JOIN cn ON me.chunk_id = cn.chunk_id WHERE cn.c.celex IS NOT NULL) WHERE rank <= 5),
c5 AS (SELECT key, rank, t5.chunk_id, '[' || substr(docs.title, 1, 50) || ' -- ' || cn.c.chunk_type || ' ' || cn.c.unit_number || ']' AS citation, coalesce(cn.c.text, '') AS x FROM t5 JOIN cn ON t5.chunk_id = cn.chunk_id JOIN docs ON docs.celex = t5.celex)
"""


@query(_C5 + f"SELECT key, rank, chunk_id, citation, {_TRUNC} AS excerpt FROM c5")
def context_chunks_top5(spark: SparkSession, sf: str) -> DataFrame:
    """Up to five passages of every entity."""
    ex, chunks, reg = _t(spark, sf, "extractions", "chunks", "registry")
    return graph.context_chunks(graph.mention_edges(ex, chunks), chunks, graph.document_nodes(chunks, reg))


@query(_M + """SELECT nb.key, rank, '  ' || CASE WHEN outgoing THEN a.name ELSE b.name END || ' --' || rel || '--> ' || CASE WHEN outgoing THEN b.name ELSE a.name END AS line
FROM nb JOIN nodes a ON a.key = nb.key JOIN nodes b ON b.key = nb.other""")
def relation_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Edges as text."""
    ex = _t(spark, sf, "extractions")
    return graph.relation_lines(graph.neighborhood(graph.relation_edges(ex)), graph.entity_nodes(ex))


@query(_C5 + f""", ln AS (SELECT nb.key, string_agg('  ' || CASE WHEN outgoing THEN a.name ELSE b.name END || ' --' || rel || '--> ' || CASE WHEN outgoing THEN b.name ELSE a.name END, chr(10) ORDER BY rank) AS rel
FROM nb JOIN nodes a ON a.key = nb.key JOIN nodes b ON b.key = nb.other GROUP BY nb.key),
cl AS (SELECT key, string_agg('  ' || citation || chr(10) || '  ' || ({_TRUNC}), chr(10) || chr(10) ORDER BY rank) AS cite FROM c5 GROUP BY key)
SELECT n.key, '### ' || name || ' (' || type || ')' || chr(10) || 'Relations:' || chr(10) || coalesce(rel, '  (none found)') || chr(10) || 'Mentioned in:' || chr(10) || coalesce(cite, '  (no chunks found)') AS section
FROM nodes n LEFT JOIN ln ON ln.key = n.key LEFT JOIN cl ON cl.key = n.key""")
def context_sections(spark: SparkSession, sf: str) -> DataFrame:
    """The context text of every entity."""
    ex = _t(spark, sf, "extractions")
    nodes = materialize(graph.entity_nodes(ex), "nodes")  # for both ends of the edges and for the sections
    lines = graph.relation_lines(graph.neighborhood(graph.relation_edges(ex)), nodes)
    return graph.context_sections(nodes, lines, context_chunks_top5(spark, sf))


# --- aggregations
@query(_M + "SELECT key, type, votes FROM canon")
def canonical_type_vote(spark: SparkSession, sf: str) -> DataFrame:
    """Majority type of every key, ties to the first seen."""
    return graph.canonical_types(_t(spark, sf, "extractions"))


@query(_M + "SELECT type, count(*) AS n FROM m GROUP BY type")
def mentions_by_type(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions per type."""
    return analytics.count_by(graph.mentions(_t(spark, sf, "extractions")), "type")


@query(_M + "SELECT relation, count(*) AS n FROM r GROUP BY relation")
def relations_by_type(spark: SparkSession, sf: str) -> DataFrame:
    """Relations per type."""
    return analytics.count_by(graph.relations(_t(spark, sf, "extractions")), "relation")


@query(_M + "SELECT key, type, count(*) AS n FROM m GROUP BY ALL ORDER BY n DESC, key, type NULLS FIRST LIMIT 20")
def top20_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty most frequent mentions."""
    return analytics.top_mentions(graph.mentions(_t(spark, sf, "extractions")))


_D = _M + ", d AS (SELECT m.key, substr(g.title, 1, 60) AS document FROM m JOIN registry g ON m.celex = g.celex WHERE g.title IS NOT NULL)"


def _titled(spark: SparkSession, sf: str) -> DataFrame:
    ex, reg = _t(spark, sf, "extractions", "registry")
    return analytics.with_titles(graph.mentions(ex), reg)


@query(_D + " SELECT key, count(DISTINCT document) AS documents FROM d WHERE key IS NOT NULL GROUP BY key HAVING count(DISTINCT document) > 1 UNION ALL SELECT NULL, count(DISTINCT document) FROM d WHERE key IS NULL HAVING count(DISTINCT document) > 1")
def cross_doc_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that occur in several documents."""
    return analytics.documents_per_key(_titled(spark, sf))


@query(_D + " SELECT key, count(DISTINCT document) AS documents, string_agg(DISTINCT document, ' | ' ORDER BY document) AS list FROM d GROUP BY key HAVING count(DISTINCT document) > 1")
def cross_doc_detail(spark: SparkSession, sf: str) -> DataFrame:
    """Those keys with their documents."""
    return analytics.document_lists(_titled(spark, sf))


@query(_D + """, e AS (SELECT document, count(*) AS entities FROM d GROUP BY 1), f AS (SELECT substr(g.title, 1, 60) AS document, count(*) AS relations FROM r JOIN registry g ON r.celex = g.celex WHERE g.title IS NOT NULL GROUP BY 1)
SELECT coalesce(e.document, f.document) AS document, entities, relations FROM e FULL JOIN f ON e.document = f.document""")
def volume_per_document(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions and relations per document."""
    ex, reg = _t(spark, sf, "extractions", "registry")
    return analytics.volume_per_document(_titled(spark, sf), analytics.with_titles(graph.relations(ex), reg))


@query("""SELECT 'entity' AS kind, count(*) FILTER (is_correct = 'Y') AS correct, count(*) AS total, count(*) FILTER (is_correct = 'Y')::DOUBLE / count(*) AS precision FROM entities_review
UNION ALL SELECT 'relation', count(*) FILTER (is_correct = 'Y'), count(*), count(*) FILTER (is_correct = 'Y')::DOUBLE / count(*) FROM relations_review""")
def overall_precision(spark: SparkSession, sf: str) -> DataFrame:
    """Precision of entities and relations."""
    e, r = _t(spark, sf, "entities_review", "relations_review")
    return evaluate.precision(e).select(F.lit("entity").alias("kind"), "*").unionByName(evaluate.precision(r).select(F.lit("relation").alias("kind"), "*"))


_BT = "WITH b AS (SELECT coalesce(entity_type, '') AS entity_type, count(*) FILTER (is_correct = 'Y') AS correct, count(*) AS total FROM entities_review GROUP BY 1)"


@query(_BT + " SELECT entity_type, correct, total, correct::DOUBLE / total AS precision FROM b")
def precision_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """Types by ascending precision."""
    return evaluate.precision_by_type(_t(spark, sf, "entities_review")).orderBy("precision", "entity_type")


@query(_BT + """, l AS (SELECT lower(entity_type) AS t, sum(correct)::DOUBLE AS c, sum(total)::DOUBLE AS n FROM b GROUP BY 1)
SELECT 'entity_precision_' || t AS metric, c / n AS value FROM l UNION ALL SELECT 'entity_count_' || t, n FROM l
UNION ALL SELECT 'entity_precision', count(*) FILTER (is_correct = 'Y')::DOUBLE / count(*) FROM entities_review UNION ALL SELECT 'entity_sample_size', count(*) FROM entities_review
UNION ALL SELECT 'relation_precision', count(*) FILTER (is_correct = 'Y')::DOUBLE / count(*) FROM relations_review UNION ALL SELECT 'relation_sample_size', count(*) FROM relations_review""")
def precision_by_type(spark: SparkSession, sf: str) -> DataFrame:
    """All metrics in long form."""
    return evaluate.metrics(*_t(spark, sf, "entities_review", "relations_review"))


@query("""WITH p AS (SELECT (SELECT count(*) FILTER (is_correct = 'Y')::DOUBLE / count(*) FROM entities_review) AS e, (SELECT count(*) FILTER (is_correct = 'Y')::DOUBLE / count(*) FROM relations_review) AS r, (SELECT count(*) FROM relations_review) AS n)
SELECT e * e AS predicted, r AS actual, abs(e * e - r) AS gap, CASE WHEN abs(e * e - r) < 0.15 THEN 'close to' ELSE 'notably different from' END AS closeness, n < 20 AS small_sample FROM p""")
def relation_gap(spark: SparkSession, sf: str) -> DataFrame:
    """Relation precision against the naive estimate."""
    return evaluate.relation_gap(*_t(spark, sf, "entities_review", "relations_review"))


@query(f"SELECT count(*) AS records, sum(len(entities))::BIGINT AS mentions, sum(len(relations))::BIGINT AS relations, count(DISTINCT {_celex('chunk_id')}) AS documents FROM extractions")
def corpus_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of the extraction output."""
    return analytics.corpus_counts(_t(spark, sf, "extractions"))


@query("SELECT celex, count(*) AS chunks, count(*) FILTER (chunk_type = 'recital') AS recitals, count(*) FILTER (chunk_type = 'article') AS articles FROM chunks GROUP BY celex")
def chunks_per_doc(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks per document."""
    return analytics.chunks_per_document(_t(spark, sf, "chunks"))


@query("""SELECT event_id, user_id, sum(CAST(round(value * 100) AS BIGINT)) OVER w::DOUBLE / count(*) OVER w / 100 AS running_avg FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def running_avg(spark: SparkSession, sf: str) -> DataFrame:
    """Running mean per user, as in the progress line of a long run; summed in hundredths, so any engine gets the same bits."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return _t(spark, sf, "events").select("event_id", "user_id", (F.sum(F.round(F.col("value") * 100).cast("bigint")).over(w).cast("double") / F.count(F.lit(1)).over(w) / 100).alias("running_avg"))


# --- sampling, order, sets
@query("SELECT seq, celex, rank FROM (SELECT seq, celex, row_number() OVER (PARTITION BY celex ORDER BY md5(seq || '|42'), seq) AS rank FROM chunks WHERE length(text) > 150) WHERE rank <= 10")
def sample_per_group(spark: SparkSession, sf: str) -> DataFrame:
    """Ten long chunks per document."""
    return evaluate.sample_per_group(_t(spark, sf, "chunks").where(F.length("text") > 150).select("seq", "celex"), "celex", "seq")


_SC = "WITH d AS (SELECT DISTINCT coalesce(chunk_id, '') AS chunk_id, coalesce(entity_text, '') AS entity_text, coalesce(entity_type, '') AS entity_type, is_correct FROM entities_review WHERE is_correct IN ('Y', 'N'))"


@query(_SC + """, y AS (SELECT *, row_number() OVER (ORDER BY ('0x' || substr(md5(chunk_id || '|' || entity_text || '|' || entity_type || '|7'), 1, 15))::BIGINT, chunk_id, entity_text, entity_type) AS rank FROM d WHERE is_correct = 'Y')
SELECT chunk_id, entity_text, entity_type, is_correct FROM d WHERE is_correct = 'N'
UNION ALL SELECT chunk_id, entity_text, entity_type, is_correct FROM y WHERE rank <= greatest(1, floor(0.2 * (SELECT count(*) FROM y)))""")
def spot_check_sample(spark: SparkSession, sf: str) -> DataFrame:
    """All wrong rows and a fifth of the right ones."""
    key = ["chunk_id", "entity_text", "entity_type"]
    rows = _t(spark, sf, "entities_review").where(F.col("is_correct").isin("Y", "N")).select(*[F.coalesce(k, F.lit("")).alias(k) for k in key], "is_correct").distinct()
    return evaluate.spot_check(rows, key)


@query("SELECT event_id, event_type, row_number() OVER (ORDER BY ts DESC, event_id) AS rank FROM events")
def history_desc(spark: SparkSession, sf: str) -> DataFrame:
    """A history, newest first."""
    return rag.history(_t(spark, sf, "events").select("ts", "event_id", "event_type"), "event_id").select("event_id", "event_type", "rank")


@query("SELECT chunk_type, count(*) AS n FROM (SELECT chunk_type FROM chunks WHERE chunk_type = 'recital' UNION ALL SELECT chunk_type FROM chunks WHERE chunk_type = 'article') GROUP BY 1")
def chunk_union(spark: SparkSession, sf: str) -> DataFrame:
    """Recital and article chunks put together."""
    c = _t(spark, sf, "chunks").select("chunk_type")
    return c.where("chunk_type = 'recital'").unionByName(c.where("chunk_type = 'article'")).groupBy("chunk_type").agg(F.count(F.lit(1)).alias("n"))


# --- text functions
@query(_M + "SELECT text, key FROM m GROUP BY ALL")
def normalize_key(spark: SparkSession, sf: str) -> DataFrame:
    """Spellings and their keys."""
    return graph.mentions(_t(spark, sf, "extractions")).select("text", "key").distinct()


@query(f"SELECT seq, trim(regexp_replace(text, '{_WS}+', ' ', 'g')) AS text FROM chunks")
def ws_collapse(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with white space collapsed."""
    return _t(spark, sf, "chunks").select("seq", T.collapse_ws("text").alias("text"))


@query(f"SELECT seq, {_TRUNC} AS text FROM (SELECT seq, text AS x FROM chunks WHERE text IS NOT NULL)")
def truncate_sentence(spark: SparkSession, sf: str) -> DataFrame:
    """Texts cut back to a sentence end within 600 characters."""
    return _t(spark, sf, "chunks").where("text is not null").select("seq", T.truncate_at_sentence("text", 600).alias("text"))


_SENT = rf"string_split(regexp_replace(text, '([.;]){_WS}+([A-Z(])', '\1' || chr(1) || '\2', 'g'), chr(1))"


@query(f"SELECT seq, unnest(range(len({_SENT}))) AS pos, unnest({_SENT}) AS sentence FROM chunks WHERE text IS NOT NULL")
def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    """Texts split between sentences."""
    c = _t(spark, sf, "chunks").where("text is not null").select("seq", F.posexplode(chunking.split_sentences(F.col("text"))).alias("pos", "sentence"))
    return c.select("seq", F.col("pos").cast("bigint").alias("pos"), "sentence")


@query(f"""WITH s AS (SELECT seq, list_transform({_SENT}, lambda x: struct_pack(o := CAST([] AS VARCHAR[]), c := {_strip("x")}, r := x)) AS l FROM chunks WHERE length(text) > 0),
p AS (SELECT seq, list_reduce(l, lambda a, x: CASE WHEN length(a.c) > 0 AND length(a.c) + length(x.r) + 1 > 1000 THEN struct_pack(o := list_append(a.o, {_strip("a.c")}), c := x.r, r := '') ELSE struct_pack(o := a.o, c := {_strip("a.c || ' ' || x.r")}, r := '') END) AS f FROM s),
o AS (SELECT seq, CASE WHEN length(f.c) > 0 THEN list_append(f.o, {_strip("f.c")}) ELSE f.o END AS parts FROM p)
SELECT seq, unnest(range(len(parts))) AS pos, unnest(parts) AS part FROM o""")
def sentence_pack(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences packed into parts of at most 1,000 characters."""
    c = spread(_t(spark, sf, "chunks").where(F.length("text") > 0).select("seq", "text"))
    c = c.select("seq", F.posexplode(chunking.pack_sentences(F.col("text"), 1000)).alias("pos", "part"))
    return c.select("seq", F.col("pos").cast("bigint").alias("pos"), "part")


@query()
def chunk_unit(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks re-cut: sub-paragraphs, then packed sentences."""
    c = spread(_t(spark, sf, "chunks").where("text is not null").select("seq", "text"))
    return chunking.chunk_units(c, ["seq"], "text")


# --- structure: act texts built from document lines, brackets, digits and underscores made harmless
_L = f"""WITH l AS (SELECT doc_id, source, list_filter(list_transform(string_split(translate(text, '()_0123456789', '[]-abcdefghij'), chr(10)), lambda x: trim(regexp_replace(x, '{_WS}+', ' ', 'g'))), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM l)
"""


def _lines(spark: SparkSession, sf: str, clean: bool = True) -> DataFrame:
    text = F.translate("text", "()_0123456789", "[]-abcdefghij") if clean else F.col("text")
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: T.collapse_ws(x)), lambda x: x != "")
    return spread(_t(spark, sf, "documents").where("text is not null").select("doc_id", "source", "text")).select("doc_id", "source", lines.alias("l"))


def _acts(spark: SparkSession, sf: str, clean: bool = True) -> DataFrame:
    """(doc_id, text): header, recitals with a citation after every third, articles, signature and annex."""
    num = lambda i: (i + 1).cast("string")
    cite = lambda i: F.when((i + 1) % 3 == 0, F.lit(" (99) See Council Directive (OJ L 95, p. 29).")).otherwise(F.lit(""))
    rec = F.array_join(F.transform("l", lambda x, i: F.concat(F.lit("("), num(i), F.lit(") "), x, cite(i))), "\n")
    art = F.array_join(F.transform("l", lambda x, i: F.concat(F.lit("Article "), num(i), F.lit(" \nHeading "), num(i), F.lit("\n  1. "), x, F.lit("\n"))), "")
    head = F.concat(F.lit("REGULATION (EU) 2016/"), F.col("doc_id").cast("string"), F.lit(" OF THE COUNCIL\nof 27 April 2016 \non "), F.coalesce("source", F.lit("none")), F.lit("\n(Text with EEA relevance)\nWhereas: "))
    return _lines(spark, sf, clean).select("doc_id", F.concat(F.lit("12.7.2024\n"), head, rec, F.lit("\nHAVE ADOPTED THIS REGULATION:\n"), art, F.lit("Done at Brussels, 27 April 2016.\nANNEX\nArticle 9\nnot part of it")).alias("text"))


@query("SELECT doc_id, 'REGULATION (EU) 2016/' || doc_id || ' OF THE COUNCIL on ' || coalesce(source, 'none') AS title, '27 April 2016' AS date FROM documents WHERE text IS NOT NULL")
def title_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Title and date of an act."""
    title, date = ingest.title_and_date(F.col("text"))
    return _acts(spark, sf).select("doc_id", title.alias("title"), date.alias("date"))


@query(_L + "SELECT doc_id, i AS number, 'Heading ' || i AS heading, '1. ' || line AS text FROM n")
def article_split(spark: SparkSession, sf: str) -> DataFrame:
    """Articles of an act."""
    return ingest.articles(_acts(spark, sf), "doc_id", "text").select("doc_id", "number", "heading", "text")


@query(_L + "SELECT doc_id, i AS pos, line || CASE WHEN i % 3 = 0 THEN ' (99) See Council Directive (OJ L 95, p. 29).' ELSE '' END AS text FROM n")
def recital_split(spark: SparkSession, sf: str) -> DataFrame:
    """Recitals of an act; citations between them stay with the recital before."""
    return ingest.recitals(_acts(spark, sf), "doc_id", "text")


def _footnoted(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, i, text): a run of footnotes inside every even line, a lone marker in the others."""
    each = _lines(spark, sf).select("doc_id", F.posexplode("l").alias("p", "line")).select("doc_id", (F.col("p") + 1).alias("i"), "line")
    run = F.concat("line", F.lit(" (1) Directive a (OJ L 124, p. 1). ( 2 ) Directive b (OJ L 8, p. 2). household"))
    return each.select("doc_id", "i", F.when(F.col("i") % 2 == 0, run).otherwise(F.concat("line", F.lit(" (5) of them"))).alias("text"))


@query(_L + "SELECT doc_id, i, line || CASE WHEN i % 2 = 0 THEN ' household' ELSE ' (5) of them' END AS text FROM n")
def footnote_strip(spark: SparkSession, sf: str) -> DataFrame:
    """Texts without embedded footnote blocks."""
    return ingest.strip_footnotes(_footnoted(spark, sf), ["doc_id", "i"], "text")


@query(_L + "SELECT doc_id, i, 2 AS n_marks, 1 AS first_n, length(line) + 1 AS start FROM n WHERE i % 2 = 0")
def footnote_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of consecutive footnote markers."""
    return ingest.footnote_runs(_footnoted(spark, sf), ["doc_id", "i"], "text").select("doc_id", "i", "n_marks", "first_n", "start")


def _numbered(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, text): all lines as 'Intro. 1. a 2. b ...' or '(1) a (2) b ...'."""
    mark = lambda i: F.when(F.col("doc_id") % 2 == 0, F.concat((i + 1).cast("string"), F.lit(". "))).otherwise(F.concat(F.lit("("), (i + 1).cast("string"), F.lit(") ")))
    parts = F.transform("l", lambda x, i: F.concat(mark(i), x))
    return _lines(spark, sf).select("doc_id", F.concat(F.lit("Intro. "), F.array_join(parts, " ")).alias("text"))


@query(_L + """, m AS (SELECT doc_id, least(i, 99) - 1 AS part, string_agg(CASE WHEN doc_id % 2 = 0 THEN i || '. ' || line ELSE '(' || i || ') ' || line END, ' ' ORDER BY i) AS text FROM n GROUP BY ALL)
SELECT m.doc_id, part, text FROM m JOIN l ON m.doc_id = l.doc_id WHERE len(l) >= 2
UNION ALL SELECT doc_id, 0, rtrim('Intro. ' || CASE WHEN len(l) = 0 THEN '' WHEN doc_id % 2 = 0 THEN '1. ' || l[1] ELSE '(1) ' || l[1] END) FROM l WHERE len(l) < 2""")
def subparagraph_split(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered sub-paragraphs of whole documents; markers have two digits, so what follows 99 stays in the last part."""
    out = chunking.subparagraphs(_numbered(spark, sf), ["doc_id"], "text")
    return out.select("doc_id", "part", F.rtrim("text").alias("text"))


@query(_L + """, k AS (SELECT doc_id, i, CASE WHEN doc_id % 2 = 0 THEN i || '. ' || line ELSE '(' || i || ') ' || line END AS p FROM n)
SELECT doc_id, n, start FROM (SELECT doc_id, i AS n, (7 + sum(length(p) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(p) - 1)::BIGINT AS start FROM k) WHERE n <= 99""")
def next_marker_span(spark: SparkSession, sf: str) -> DataFrame:
    """Offsets of all markers of whole documents; a number of three digits is no marker."""
    return ingest.marks(_numbered(spark, sf), ["doc_id"], "text", chunking.SUBPARAGRAPH).select("doc_id", "n", "start")


def _units(spark: SparkSession, sf: str, clean: bool) -> DataFrame:
    """Recitals and articles of the acts as units to be chunked."""
    acts = materialize(_acts(spark, sf, clean).select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("celex"), "text"), "acts")
    rec = ingest.recitals(acts, "celex", "text").select("celex", F.lit("recital").alias("chunk_type"), F.col("pos").alias("ord"), F.col("pos").cast("int").alias("unit_number"), F.lit(None).cast("string").alias("heading"), "text")
    art = ingest.articles(acts, "celex", "text").select("celex", F.lit("article").alias("chunk_type"), F.col("pos").cast("bigint").alias("ord"), F.col("number").alias("unit_number"), "heading", "text")
    return rec.unionByName(art).withColumn("title", F.lit(""))


@query(_L + f""", u AS (SELECT doc_id, 'recital' AS chunk_type, i AS unit_number, NULL AS heading, line || CASE WHEN i % 3 = 0 THEN ' (99) See Council Directive (OJ L 95, p. 29).' ELSE '' END AS text FROM n
UNION ALL SELECT doc_id, 'article', i, 'Heading ' || i, '1. ' || line FROM n),
s AS (SELECT *, list_transform({_SENT}, lambda x: struct_pack(o := CAST([] AS VARCHAR[]), c := {_strip("x")}, r := x)) AS l FROM u WHERE length(text) > 2000),
p AS (SELECT doc_id, chunk_type, unit_number, heading, list_reduce(l, lambda a, x: CASE WHEN length(a.c) > 0 AND length(a.c) + length(x.r) + 1 > 2000 THEN struct_pack(o := list_append(a.o, {_strip("a.c")}), c := x.r, r := '') ELSE struct_pack(o := a.o, c := {_strip("a.c || ' ' || x.r")}, r := '') END) AS f FROM s),
c AS (SELECT doc_id, chunk_type, unit_number, heading, list_append(f.o, {_strip("f.c")}) AS parts FROM p UNION ALL SELECT doc_id, chunk_type, unit_number, heading, [text] FROM u WHERE length(text) <= 2000),
e AS (SELECT doc_id, chunk_type, unit_number, heading, unnest(range(len(parts))) AS part, unnest(parts) AS text FROM c)
SELECT 'D' || doc_id || '_' || chunk_type || '_' || unit_number || '_' || part AS chunk_id, 'D' || doc_id AS celex, chunk_type, unit_number, part, heading, text FROM e""")
def chunk_explode(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of acts, units over the limit with all their parts."""
    return chunking.chunk_rows(_units(spark, sf, True)).select("chunk_id", "celex", "chunk_type", "unit_number", F.col("part").cast("bigint").alias("part"), "heading", "text")


@query()
def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of acts whose lines are left as they are, with whatever looks like a marker in them; its test has a brute-force version."""
    return chunking.chunk_rows(_units(spark, sf, False))


# --- model-side helpers
@query(f"""SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS line FROM (SELECT doc_id, CASE WHEN len(a) = 1 AND a[1] = 'NONE' THEN [] ELSE a END AS a FROM (
SELECT doc_id, list_filter(list_transform(string_split(CASE WHEN doc_id % 7 = 0 THEN ' NONE ' || chr(10) ELSE text END, chr(10)), lambda x: {_strip("x")}), lambda x: x <> '') AS a FROM documents))""")
def answer_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a list answer, 'NONE' understood."""
    t = F.when(F.col("doc_id") % 7 == 0, F.lit(" NONE \n")).otherwise(F.col("text"))
    out = _t(spark, sf, "documents").select("doc_id", F.posexplode(T.answer_lines(t)).alias("i", "line"))
    return out.select("doc_id", F.col("i").cast("bigint").alias("i"), "line")


@query(_M + f"SELECT coalesce(type, '') AS type, count(*) AS n, count(*) FILTER (type IN ({_TYPES}) AND text IS NOT NULL) AS valid FROM m GROUP BY 1")
def schema_validate(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions that satisfy the decoding schema, by type."""
    m = graph.mentions(_t(spark, sf, "extractions")).withColumn("type", F.coalesce("type", F.lit("")))
    return m.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("type").isin(T.ENTITY_TYPES) & F.col("text").isNotNull()).alias("valid"))


@query(r"""WITH e AS (SELECT seq, chunk_id, list_filter(entities, lambda e: e.text IS NOT NULL AND e.type IS NOT NULL) AS e FROM extractions), t AS (SELECT chunk_id, arg_max(text, seq) AS text FROM chunks GROUP BY 1)
SELECT seq, md5('Text:' || chr(10) || coalesce(t.text, '') || chr(10) || chr(10) || 'Confirmed entities:' || chr(10) || array_to_string(list_transform(e, lambda x: '- "' || x.text || '" (' || x.type || ')'), chr(10))) AS prompt
FROM e LEFT JOIN t ON e.chunk_id = t.chunk_id WHERE len(e) >= 2""")
def prompt_template(spark: SparkSession, sf: str) -> DataFrame:
    """Relation prompts (their md5)."""
    ex, chunks = _t(spark, sf, "extractions", "chunks")
    e = F.filter("entities", lambda x: x["text"].isNotNull() & x["type"].isNotNull())
    rows = ex.select("seq", "chunk_id", e.alias("e")).where("size(e) >= 2")
    t = chunks.groupBy("chunk_id").agg(F.max_by("text", "seq").alias("text"))
    lines = F.array_join(F.transform("e", lambda x: F.concat(F.lit('- "'), x["text"], F.lit('" ('), x["type"], F.lit(")"))), "\n")
    both = rows.join(t, "chunk_id", "left")
    return both.select("seq", F.md5(F.concat(F.lit("Text:\n"), F.coalesce("text", F.lit("")), F.lit("\n\nConfirmed entities:\n"), lines)).alias("prompt"))


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_Q = "Which duties does the Harbour Data Office have?"


@query(_M + f"""SELECT block, md5({_sql_text(prompts.SELECT_TASK + chr(10) * 2 + "Names:" + chr(10))} || string_agg(name, chr(10) ORDER BY name) || {_sql_text(chr(10) * 2 + "Question: " + _Q)}) AS prompt
FROM (SELECT DISTINCT name, ('0x' || substr(md5(name), 1, 12))::BIGINT % (SELECT ceil(count(DISTINCT name) / 500.0)::BIGINT FROM nodes) AS block FROM nodes) GROUP BY block""")
def selection_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts that ask which entities a question is about, one per block of names (their md5)."""
    names = materialize(rag.entity_names(graph.entity_nodes(_t(spark, sf, "extractions"))), "names")
    return prompts.name_blocks(names).select("block", F.md5(prompts.selection("names", F.lit(_Q))).alias("prompt"))


@query(f"""SELECT 'entity' AS kind, md5({_sql_text(prompts.ENTITY_TASK + chr(10) * 2 + "Passage:" + chr(10))} || coalesce(chunk_text, '') || {_sql_text(chr(10) * 2 + 'Entity: "')} || coalesce(entity_text, '') || '" (' || coalesce(entity_type, '') || ')') AS prompt FROM entities_review
UNION ALL SELECT 'relation', md5({_sql_text(prompts.RELATION_TASK + chr(10) * 2 + "Passage:" + chr(10))} || coalesce(chunk_text, '') || {_sql_text(chr(10) * 2 + 'Relation: "')} || coalesce(subject, '') || '" --' || coalesce(relation, '') || '--> "' || coalesce(object, '') || '"') FROM relations_review""")
def judge_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts that put every review row to a judge (their md5)."""
    ent, rel = _t(spark, sf, "entities_review", "relations_review")
    e = ent.select(F.lit("entity").alias("kind"), F.md5(prompts.entity_verdict("chunk_text", "entity_text", "entity_type")).alias("prompt"))
    return e.unionByName(rel.select(F.lit("relation").alias("kind"), F.md5(prompts.relation_verdict("chunk_text", "subject", "relation", "object")).alias("prompt")))


@query(_C5 + f""", ln AS (SELECT nb.key, string_agg('  ' || CASE WHEN outgoing THEN a.name ELSE b.name END || ' --' || rel || '--> ' || CASE WHEN outgoing THEN b.name ELSE a.name END, chr(10) ORDER BY rank) AS rel
FROM nb JOIN nodes a ON a.key = nb.key JOIN nodes b ON b.key = nb.other GROUP BY nb.key),
cl AS (SELECT key, string_agg('  ' || citation || chr(10) || '  ' || ({_TRUNC}), chr(10) || chr(10) ORDER BY rank) AS cite FROM c5 GROUP BY key)
SELECT n.key, md5({_sql_text(prompts.ANSWER_TASK + chr(10) * 2 + "Passages:" + chr(10))} || '### ' || name || ' (' || type || ')' || chr(10) || 'Relations:' || chr(10) || coalesce(rel, '  (none found)') || chr(10) || 'Mentioned in:' || chr(10) || coalesce(cite, '  (no chunks found)')
|| {_sql_text(chr(10) * 2 + "Question: What holds for ")} || name || '?') AS prompt FROM nodes n LEFT JOIN ln ON ln.key = n.key LEFT JOIN cl ON cl.key = n.key""")
def answer_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """A prompt for every entity that asks for an answer from its context (their md5)."""
    nodes = materialize(graph.entity_nodes(_t(spark, sf, "extractions")), "nodes")
    both = context_sections(spark, sf).join(nodes.select("key", "name"), "key")
    return both.select("key", F.md5(prompts.answering("section", F.concat(F.lit("What holds for "), "name", F.lit("?")))).alias("prompt"))


@query(f"""WITH e AS (SELECT seq, list_filter(entities, lambda e: e IS NOT NULL AND {sql_key("e.text")} <> '') AS e FROM extractions),
p AS (SELECT seq, unnest(range(len(e) - 1)) AS pos, unnest(e[1:len(e) - 1]) AS a, unnest(e[2:len(e)]) AS b FROM e WHERE len(e) >= 2)
SELECT seq, pos, a.text AS subject, 'REFERENCES' AS relation, b.text AS object FROM p WHERE {sql_key("a.text")} <> {sql_key("b.text")}""")
def cooccur_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Rule default of relation extraction."""
    return graph.cooccurring_relations(_t(spark, sf, "extractions"))


@query()
def extract_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rule backend over every distinct chunk."""
    c = _t(spark, sf, "chunks").groupBy("chunk_id").agg(F.max_by("text", "seq").alias("text"))
    return extract.run(c, extract.RuleBackend())


@query()
def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers to a few questions from the graph."""
    q = spark.createDataFrame([(1, "Which duties does the Harbour Data Office have?"), (2, "Who keeps the sealed register, and what is archive data?"), (3, "What is the weather?")], "question_id int, question string")
    return rag.answer_questions(q, *_t(spark, sf, "extractions", "chunks", "registry"))


@query()
def report_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The evaluation report, line by line."""
    text = evaluate.report(*_t(spark, sf, "entities_review", "relations_review"))
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "i int, line string")
