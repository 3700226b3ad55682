"""Entity and relation extraction with pluggable backends, timeouts, resume and fallback.

A backend is a picklable object with ``load()``, called once per worker process, and ``extract(text)``.
``run`` calls it in ``mapInPandas`` and turns failures into rows: status 'ok', 'error' (the backend raised;
not tried again) or 'timeout' (given up after two calls).  With ``timeout=None`` the backend runs inside the worker;
with a timeout it runs on a leash: in a child process that can be ended.
"""

from __future__ import annotations

import multiprocessing as mp
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from multiprocessing.connection import Connection
from typing import Protocol

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions.text import ENTITY_TYPES
from kgspark.session import materialize, spread

RESULT = "chunk_id string, entities array<struct<text:string,type:string>>, relations array<struct<subject:string,relation:string,object:string>>, status string, attempts int, error string, backend string"


class Backend(Protocol):
    """What ``run`` needs of a model."""

    name: str

    def load(self) -> None: ...

    def extract(self, text: str) -> dict: ...


class RuleBackend:
    """Deterministic default: patterns for acts, dates, penalties, duties and capitalised bodies; trigger verbs for relations."""

    name = "rules"
    # Trigger words of the relation types.
    TRIGGERS = [
        ("AMENDS", r"\bamend"), ("REPEALS", r"\brepeal"), ("DEFINES", r"\bmeans\b|\bdefine"), ("ESTABLISHES", r"\bestablish"),
        ("IMPOSES_OBLIGATION_ON", r"\bshall\b|\bmust\b"), ("GRANTS_RIGHT_TO", r"\bmay\b|\bright to\b|\bentitled\b"), ("RESPONSIBLE_FOR", r"\bresponsible\b"),
        ("SUBJECT_TO", r"\bsubject to\b"), ("APPLIES_TO", r"\bappl(?:y|ies)\b"), ("REFERENCES", r"\breferred to\b|\bpursuant to\b|\bunder\b"),
    ]

    def load(self) -> None:
        months = "January|February|March|April|May|June|July|August|September|October|November|December"
        self.patterns = [
            ("LEGAL_ACT", re.compile(r"\b(?:Regulation|Directive|Decision) ?\((?:EU|EC)\) ?(?:No )?\d{1,4}/\d{1,4}")),
            ("DATE", re.compile(rf"\b\d{{1,2}} (?:{months}) \d{{4}}\b")),
            ("PENALTY", re.compile(r"\b(?:fine|penalty) of [\d  ]+ ?\w+", re.I)),
            ("OBLIGATION", re.compile(r"\b(?:obligation|duty|requirement) to \w+(?: \w+){0,3}", re.I)),
            ("ORGANIZATION", re.compile(r"\b(?:[A-Z][a-zà-ÿ]+ ){1,4}(?:Authority|Agency|Office|Board|Council|Committee|Commission|Institute|Department|Foundation|Association|Laboratory)(?: (?:for|of) [A-Z][a-z]+(?: [A-Z][a-z]+)?)?")),
        ]
        self.triggers = [(t, re.compile(p, re.I)) for t, p in self.TRIGGERS]

    def extract(self, text: str) -> dict:
        if not hasattr(self, "patterns"):
            self.load()
        found = sorted(((m.start(), m.end(), m.group(), t) for t, p in self.patterns for m in p.finditer(text)), key=lambda x: (x[0], -x[1]))
        spans, end = [], -1
        for s in found:
            if s[0] >= end:
                spans.append(s)
                end = s[1]
        relations = []
        for a, b in zip(spans, spans[1:], strict=False):
            between = text[a[1] : b[0]]
            if "." in between or a[2] == b[2]:
                continue
            kind = next((t for t, p in self.triggers if p.search(between)), None)
            if kind:
                relations.append({"subject": a[2], "relation": kind, "object": b[2]})
        return {"entities": [{"text": s[2], "type": s[3]} for s in spans], "relations": relations}


_ready: dict[str, Backend] = {}


def loaded(backend: Backend) -> Backend:
    """The backend of this name, loaded once in this process and kept for later tasks."""
    if type(_ready.get(backend.name)) is not type(backend):
        backend.load()
        _ready[backend.name] = backend
    return _ready[backend.name]


def _answer(pipe: Connection, pickled: bytes) -> None:
    model = cloudpickle.loads(pickled)
    model.load()
    pipe.send(None)
    for text in iter(pipe.recv, None):
        try:
            pipe.send((True, model.extract(text)))
        except Exception as e:  # noqa: BLE001
            pipe.send((False, str(e)))


@dataclass
class Leash:
    """A backend in a child process of its own; a call that takes longer than ``limit`` seconds costs the child its life.

    The child starts with the first call after it was lost, so a model is only loaded where it is needed, and lives on
    for the next tasks of the worker.
    """

    backend: Backend
    limit: float
    tries: int = 2
    startup: float = 60.0

    def __post_init__(self) -> None:
        self._pipe, self._child = None, None

    def _open(self) -> Connection:
        if self._pipe is None:
            context = mp.get_context("spawn")
            self._pipe, far = context.Pipe()
            self._child = context.Process(target=_answer, args=(far, cloudpickle.dumps(self.backend)), daemon=True)
            self._child.start()
            far.close()
            if not self._pipe.poll(self.startup):
                self.drop()
                raise RuntimeError(f"backend {self.backend.name} did not load in {self.startup} s")
            self._pipe.recv()
        return self._pipe

    def drop(self) -> None:
        """End the child, whatever it does."""
        if self._child is not None:
            self._child.kill()
            self._child.join()
            self._pipe.close()
        self._pipe = self._child = None

    def ask(self, text: str) -> tuple[str, dict | str, int]:
        """(status, result or error, calls made)."""
        why = ""
        for n in range(1, self.tries + 1):
            try:
                pipe = self._open()
                pipe.send(text)
                if pipe.poll(self.limit):
                    ok, got = pipe.recv()
                    return "ok" if ok else "error", got, n
                why = f"no answer within {self.limit} s"
            except (EOFError, BrokenPipeError, ConnectionResetError):
                why = "the process ended"
            self.drop()
        return "timeout", f"{why}, {self.tries} times", self.tries


_leashes: dict[tuple[str, float], Leash] = {}


def _ask_plain(backend: Backend, text: str) -> tuple[str, dict | str, int]:
    try:
        return "ok", backend.extract(text), 1
    except Exception as e:  # noqa: BLE001
        return "error", str(e), 1


def run(chunks: DataFrame, backend: Backend, timeout: float | None = None) -> DataFrame:
    """One row per chunk (chunk_id, text) with entities, grounded relations and the status; NULL texts give 'ok' and nothing."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if timeout:
            key = (backend.name, timeout)
            if key not in _leashes or type(_leashes[key].backend) is not type(backend):
                _leashes[key] = Leash(backend, timeout)
            ask = _leashes[key].ask
        else:
            ask = partial(_ask_plain, loaded(backend))
        for pdf in batches:
            rows = []
            for cid, text in zip(pdf["chunk_id"], pdf["text"], strict=True):
                status, out, n = ask(text) if text else ("ok", {}, 1)
                got = out if status == "ok" and isinstance(out, dict) else {}
                ents = [e for e in got.get("entities", []) if e.get("type") in ENTITY_TYPES and e.get("text")]
                keys = {" ".join(e["text"].split()).lower() for e in ents}
                rels = [r for r in got.get("relations", []) if all(" ".join(str(r.get(k, "")).split()).lower() in keys for k in ("subject", "object"))] if len(ents) >= 2 else []
                rows.append((cid, ents, rels, status, n, None if status == "ok" else str(out), backend.name))
            yield pd.DataFrame(rows, columns=["chunk_id", "entities", "relations", "status", "attempts", "error", "backend"])

    return spread(chunks.select("chunk_id", "text")).mapInPandas(work, RESULT)


def pending(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """Chunks whose id has no result yet."""
    return chunks.join(done.select("chunk_id").distinct(), "chunk_id", "left_anti")


def run_with_fallback(chunks: DataFrame, first: Backend, second: Backend, timeout: float | None = None) -> dict[str, DataFrame]:
    """``results`` of the first backend plus those of the second for its failures, and the ``failures`` left over.

    The first pass is materialised, because a model is never called twice for one chunk.
    """
    one = materialize(run(chunks, first, timeout), "extract")
    bad = one.where("status <> 'ok'")
    two = materialize(run(chunks.join(bad.select("chunk_id").distinct(), "chunk_id", "left_semi"), second), "extract-again")
    both = one.where("status = 'ok'").unionByName(two.where("status = 'ok'"))
    return {"results": both, "failures": two.where("status <> 'ok'").withColumn("pass", F.lit(2))}
