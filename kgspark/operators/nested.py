"""Deeply nested records to flat tables, with Merkle identities.

A record line is read once in an Arrow batch.  Objects are canonicalised and hashed bottom-up: the hash of
an object covers its own scalar fields and the ordered hashes of its children, so two equal subtrees have
one identity wherever they occur.  ``objects`` stores each identity once, ``bridge`` holds the rows
(parent, kind, ordinal, child), ``lines`` the root of each input line.  Every occurrence is recovered by
walking the bridge; the flat tables do exactly that.

Defined results: lines without a number, NULL, blank and cut-off lines, and lines that hold anything but one JSON object, give no
rows.  A leading byte-order mark is not part of the record.  A lone object where an array is expected has
ordinal 0; NULL or non-object elements keep their place and give no row; a result kept as text is parsed,
and if it cannot be parsed it has no children.  Missing or NULL text is ''.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.operators.skew import hot_split_join, hot_values
from kgspark.session import materialize, spread

NODES = "line_no bigint, kind string, parent string, ordinal int, hash string, chunk_id string, payload string"


def _digest(kind: str, own: dict, children: list[tuple[str, int, str]]) -> tuple[str, str]:
    payload = json.dumps(own, sort_keys=True, ensure_ascii=True, separators=(",", ":"))
    text = "\x1f".join([kind, payload, *(f"{k}:{i}:{h}" for k, i, h in children)])
    return hashlib.blake2b(text.encode(), digest_size=16).hexdigest(), payload


def _seats(x: object) -> list[tuple[int, dict]]:
    """(place, object) of an array's objects; a lone object sits at 0."""
    if isinstance(x, dict):
        return [(0, x)]
    return [(i, v) for i, v in enumerate(x) if isinstance(v, dict)] if isinstance(x, list) else []


def _as_object(x: object) -> dict:
    if isinstance(x, str):
        try:
            x = json.loads(x)
        except ValueError:
            return {}
    return x if isinstance(x, dict) else {}


def _without(x: dict, *names: str) -> dict:
    return {k: v for k, v in x.items() if k not in names}


class _Walker:
    """Collects the node rows of one line; children are hashed before their parent."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, str, int, str, str]] = []  # kind, parent, ordinal, hash, payload

    def emit(self, kind: str, own: dict, seated: list[tuple[str, int, str, str]]) -> tuple[str, str]:
        h, payload = _digest(kind, own, [(k, i, c) for k, i, c, _ in seated])
        self.rows += [(k, h, i, c, p) for k, i, c, p in seated]
        return h, payload

    def entity(self, x: dict) -> tuple[str, str]:
        spans = [("span", i, *self.emit("span", s, [])) for i, s in _seats(x.get("spans"))]
        return self.emit("entity", _without(x, "spans"), spans)

    def attempt(self, x: dict, result: dict) -> tuple[str, str]:
        kids = [("entity", i, *self.entity(e)) for i, e in _seats(result.get("entities"))]
        kids += [("relation", i, *self.emit("relation", r, [])) for i, r in _seats(result.get("relations"))]
        # what the result holds beside its items stays apart: a field of the same name is not the attempt's
        rest = _without(result, "entities", "relations")
        return self.emit("attempt", x | ({"result": rest} if rest else {}), kids)

    def record(self, x: dict) -> tuple[str, str, str | None]:
        own = x
        if isinstance(x.get("record"), dict):
            own = _without(x, "record") | x["record"]
        run = own.get("run") if isinstance(own.get("run"), dict) else {}
        attempts = run.get("attempts") if "attempts" in run else own.get("attempts")
        kids = []
        if attempts is not None:
            kids = [("attempt", i, *self.attempt(_without(a, "result", "entities", "relations"), _result_of(a))) for i, a in _seats(attempts)]
        else:
            kids = [("attempt", 0, *self.attempt(_without(run, "result", "entities", "relations"), _result_of(own) or _result_of(run)))]
        rest = _without(own, "run", "attempts", "result", "entities", "relations") | {"run": _without(run, "attempts", "result", "entities", "relations")}
        h, payload = self.emit("record", rest, kids)
        cid = own.get("chunk_id")
        return h, payload, cid if isinstance(cid, str) else None


def _result_of(x: dict) -> dict:
    """The object that holds entities and relations: ``result`` (perhaps as text), else the object itself."""
    if x.get("result") is not None:
        return _as_object(x["result"])
    return {k: x[k] for k in ("entities", "relations") if k in x}


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in NODES.split(", ")]
    for pdf in batches:
        out = []
        for line_no, raw in zip(pdf["line_no"], pdf["raw"], strict=True):
            if not isinstance(raw, str):
                continue
            try:
                x = json.loads(raw.lstrip("﻿ \t\r\n\x0b\x0c\xa0").rstrip("\x00﻿ \t\r\n\x0b\x0c\xa0"))
            except (ValueError, RecursionError):
                continue
            if not isinstance(x, dict):
                continue
            w = _Walker()
            root, payload, cid = w.record(x)
            out.append((line_no, "record", None, 0, root, cid, payload))
            out += [(line_no, k, p, i, h, cid, pay) for k, p, i, h, pay in w.rows]
        yield pd.DataFrame(out, columns=names)


def merkle_tables(runs: DataFrame) -> dict[str, DataFrame]:
    """``lines``, ``bridge`` and ``objects`` of a table with columns line_no and raw (others are ignored)."""
    nodes = materialize(spread(runs.select("line_no", "raw").where("line_no is not null and raw is not null")).mapInPandas(_parse, NODES), "nested")
    lines = nodes.where("kind = 'record'").select("line_no", "chunk_id", F.col("hash").alias("record_hash"))
    # equal subtrees arrive once per occurrence; both groupings combine on the map side, so a record that
    # makes up a third of all lines costs one row per task
    bridge = nodes.where("kind <> 'record'").groupBy("parent", "kind", "ordinal", "hash").agg(F.count(F.lit(1)).alias("occurrences"))
    objects = nodes.groupBy("hash").agg(F.first("kind").alias("kind"), F.first("payload").alias("payload"), F.count(F.lit(1)).alias("occurrences"))
    return {"lines": lines, "bridge": bridge, "objects": objects}


def _children(t: dict[str, DataFrame], parents: DataFrame, parent_col: str, kind: str, pos: str, hash_col: str) -> DataFrame:
    step = t["bridge"].where(F.col("kind") == kind).select(F.col("parent").alias(parent_col), F.col("ordinal").alias(pos), F.col("hash").alias(hash_col))
    return parents.join(step, parent_col)


def _payload(t: dict[str, DataFrame], rows: DataFrame, hash_col: str, kind: str, **fields: str) -> DataFrame:
    """``rows`` with fields of their objects.  One object may be carried by a tenth of all rows, so hot objects are split off."""
    objects = t["objects"].where(F.col("kind") == kind).select(F.col("hash").alias(hash_col), *[F.get_json_object("payload", f"$.{path}").alias(n) for n, path in fields.items()])
    return hot_split_join(rows, objects, hash_col)


FLAT = {
    "attempts": ("attempt_hash", "attempt", ["record_hash", "attempt_pos", "attempt_hash"], {"n": "n", "status": "status", "seconds": "seconds"}),
    "entities": ("entity_hash", "entity", ["attempt_pos", "attempt_hash", "item_pos", "entity_hash"], {"text": "text", "type": "type"}),
    "relations": ("relation_hash", "relation", ["attempt_pos", "attempt_hash", "item_pos", "relation_hash"], {"subject": "subject", "relation": "relation", "object": "object"}),
    "spans": ("span_hash", "span", ["attempt_pos", "item_pos", "entity_hash", "sub_pos", "span_hash"], {"surface": "surface", "start": "start", "end": "end"}),
}


def flat_tables(t: dict[str, DataFrame], names: list[str] | None = None) -> dict[str, DataFrame]:
    """attempts, entities, relations and spans, or those named: every occurrence, each with the way to its parents.

    The bridge is walked once for every distinct record.  The last step goes from records to the lines that hold them;
    a record that makes up a third of all lines is split off there.
    """
    names = list(FLAT) if names is None else names
    records = t["lines"].select("record_hash").distinct()
    walked = {"attempts": materialize(_children(t, records, "record_hash", "attempt", "attempt_pos", "attempt_hash"), "nested-attempts")}
    if {"entities", "spans"} & set(names):
        walked["entities"] = materialize(_children(t, walked["attempts"], "attempt_hash", "entity", "item_pos", "entity_hash"), "nested-entities")
    if "relations" in names:
        walked["relations"] = materialize(_children(t, walked["attempts"], "attempt_hash", "relation", "item_pos", "relation_hash"), "nested-relations")
    if "spans" in names:
        walked["spans"] = materialize(_children(t, walked["entities"], "entity_hash", "span", "sub_pos", "span_hash"), "nested-spans")
    lines = materialize(t["lines"], "nested-lines")
    hot = hot_values(lines, "record_hash")
    out = {}
    for name in names:
        own, kind, places, fields = FLAT[name]
        rows = _payload(t, walked[name], own, kind, **fields)
        out[name] = hot_split_join(lines, rows, "record_hash", hot=hot).select("line_no", "chunk_id", *places, *fields)
    return out


def found_items(t: dict[str, DataFrame]) -> DataFrame:
    """One row per entity, relation and span object of every readable line."""
    flat = flat_tables(t, ["entities", "relations", "spans"])
    part = lambda df, kind, sub, text: df.select(
        "line_no", "attempt_pos", F.lit(kind).alias("item_kind"), "item_pos", sub.cast("int").alias("sub_pos"), F.coalesce(text, F.lit("")).alias("item_text")
    )
    none = F.lit(-1)
    return (
        part(flat["entities"], "entity", none, F.col("text"))
        .unionByName(part(flat["relations"], "relation", none, F.col("subject")))
        .unionByName(part(flat["spans"], "span", F.col("sub_pos"), F.col("surface")))
        .distinct()
    )
