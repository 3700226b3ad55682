"""Filling fixed-capacity containers by lexical retrieval.

Documents are routed to shards of bounded size by what they are about: a bounded sample of documents serves as anchors,
every document goes to the cell of the two anchors that BM25 ranks first for it, and cells are put together to shards, or
cut into several, by their counts.  Each shard is an inverted BM25 index over token ids, weighted by the frequencies and
mean length of all documents' items, so a score does not depend on the shard: the largest unused document seeds a
container, the index returns its unused neighbours by score, and they fill the window greedily; what no neighbour can fill
goes to the largest unused item that fits.  A text above the capacity is cut into full pieces and its rest is packed like
any item.

Defined results: NULL and empty texts take no room and get one row without container; ties of the score go
to the smaller position in the shard (order of id); repeated rows are packed each, and many copies of one text are
spread over as many shards as they fill.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.tokens import DEFAULT_VOCABULARY, encode
from kgspark.session import materialize, spread

CAPACITY = 4096
SHARD_DOCS = 4096
#: The routing is fitted on a sample of about so many rows, those of the smallest row hash among texts of up to so many
#: characters; the first of them are the anchors, and there are at most as many cells as the square of their number.
SAMPLE, SAMPLE_CHARS, ANCHORS = 512, 100_000, 128
#: A term in more than one of so many items of a shard has a row of its own instead of postings.
DENSE_SHARE = 8
_OUT = "container_id bigint, position int, id string, piece_no int, n_pieces int, token_start bigint, n_tokens bigint, score double"
_CONTAINERS_PER_SHARD = 100_000_000


class Bm25Index:
    """Postings of a shard with precomputed weights; terms in at least half of all items weigh nothing.

    ``stats`` (items, mean length, sorted terms, their item counts) describes all items; by default those given.
    """

    def __init__(self, items: list[np.ndarray], k1: float = 1.2, b: float = 0.75, stats: tuple | None = None) -> None:
        n = len(items)
        self.n, size = n, np.array([len(x) for x in items], dtype=np.float64)
        span = 1 + max((int(x.max()) for x in items if len(x)), default=0)
        keys = np.concatenate([x + i * span for i, x in enumerate(items)]) if n else np.empty(0, np.int64)
        keys, tf = np.unique(keys, return_counts=True)
        item, term = np.divmod(keys, span)
        terms, term, df = np.unique(term, return_inverse=True, return_counts=True)
        total, mean = n, size.mean() if n else 1.0
        if stats is not None:
            total, mean, df = stats[0], stats[1], stats[3][np.searchsorted(stats[2], terms)]
        idf = np.maximum(0.0, np.log((total - df + 0.5) / (df + 0.5)))
        keep = idf[term] > 0
        item, term, tf = item[keep], term[keep], tf[keep]
        norm = k1 * (1 - b + b * size[item] / max(mean, 1e-9))
        weight = idf[term] * tf * (k1 + 1) / (tf + norm)
        self.query_at = np.searchsorted(item, np.arange(n + 1))
        self.query_terms = term
        order = np.argsort(term, kind="stable")
        self.post_item, self.post_weight = item[order], weight[order]
        self.post_at = np.searchsorted(term[order], np.arange(len(terms) + 1))
        # terms of many items are added as whole rows, which is cheaper than their postings; there are few of them
        length = np.diff(self.post_at)
        often = np.flatnonzero(length > max(16, n // DENSE_SHARE))
        self.dense_row = dict(zip(often.tolist(), range(len(often)), strict=True))
        self.dense = np.zeros((len(often), n))
        for t, r in self.dense_row.items():
            at = slice(self.post_at[t], self.post_at[t + 1])
            self.dense[r, self.post_item[at]] = self.post_weight[at]

    def scores(self, q: int) -> np.ndarray:
        """BM25 score of every item for item ``q`` as the query; of items that have been dropped the score is too low."""
        at, items, weights, rows = self.post_at, [], [], []
        for t in self.query_terms[self.query_at[q] : self.query_at[q + 1]].tolist():
            if (r := self.dense_row.get(t)) is not None:
                rows.append(r)
            else:
                items.append(self.post_item[at[t] : at[t + 1]])
                weights.append(self.post_weight[at[t] : at[t + 1]])
        out = np.bincount(np.concatenate(items), weights=np.concatenate(weights), minlength=self.n) if items else np.zeros(self.n)
        for r in rows:
            out += self.dense[r]
        return out

    def drop(self, keep: np.ndarray) -> None:
        """Take the items that ``keep`` (one truth value per item) says no to out of the postings."""
        left = keep[self.post_item]
        self.post_at = np.concatenate(([0], np.cumsum(left)))[self.post_at]
        self.post_item, self.post_weight = self.post_item[left], self.post_weight[left]


def pack(items: list[np.ndarray], capacity: int, stats: tuple | None = None) -> list[list[tuple[int, float]]]:
    """Containers of (item, score against the seed); every non-empty item occurs exactly once."""
    size = np.array([len(x) for x in items], dtype=np.int64)
    index = Bm25Index(items, stats=stats)
    unused = size > 0
    by_size = sorted((int(s), -i) for i, s in enumerate(size) if s > 0)

    def use(i: int) -> None:
        unused[i] = False
        by_size.pop(bisect_right(by_size, (int(size[i]), -i)) - 1)

    out, posted = [], len(by_size)
    while by_size:
        if 4 * len(by_size) < 3 * posted:  # a quarter of the postings is of items already used
            index.drop(unused)
            posted = len(by_size)
        seed = -by_size[-1][1]
        use(seed)
        room, members = capacity - int(size[seed]), [(seed, 0.0)]
        if by_size and room >= by_size[0][0]:
            score = index.scores(seed)
            near = np.flatnonzero(unused & (size <= room) & (score > 0))
            near = near[np.argsort(-score[near], kind="stable")]
            while near.size:
                i = int(near[0])
                use(i)
                members.append((i, float(score[i])))
                room -= int(size[i])
                near = near[1:]
                near = near[size[near] <= room]
            while by_size and room >= by_size[0][0]:
                _, i = by_size[bisect_right(by_size, (room, 1)) - 1]
                i = -i
                use(i)
                members.append((i, float(score[i])))
                room -= int(size[i])
        out.append(members)
    return out


def _rest(raw: bytes, capacity: int) -> np.ndarray:
    """What is left of a text's tokens when its full pieces are cut off."""
    tok = np.frombuffer(raw, dtype=np.int32)
    return tok[len(tok) // capacity * capacity :]


def anchor_weights(anchors: list[np.ndarray], stats: tuple, k1: float = 1.2, b: float = 0.75) -> tuple[np.ndarray, np.ndarray]:
    """(sorted terms, weight of each in each anchor): BM25 weights by the statistics of the items the routing is fitted on."""
    n, mean, terms, count = stats
    idf = np.maximum(0.0, np.log((n - count + 0.5) / (count + 0.5)))
    rows: dict[int, np.ndarray] = {}
    for a, item in enumerate(anchors):
        own, tf = np.unique(item, return_counts=True)
        w = idf[np.searchsorted(terms, own)] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(item) / max(mean, 1e-9)))
        for t, x in zip(own[w > 0].tolist(), w[w > 0], strict=True):
            rows.setdefault(t, np.zeros(len(anchors), dtype=np.float32))[a] = x
    known = np.array(sorted(rows), dtype=np.int32)
    return known, np.stack([rows[t] for t in known.tolist()]) if len(known) else np.zeros((0, max(1, len(anchors))), dtype=np.float32)


def cells_of(items: list[np.ndarray], known: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """First anchor * number of anchors + second anchor of every item; 0 where nothing is shared with any."""
    out = np.zeros(len(items), dtype=np.int64)
    k = weights.shape[1]
    row = np.full(1 + max([int(known[-1]) if len(known) else 0, *(int(x.max()) for x in items if len(x))]), -1, dtype=np.int32)
    row[known] = np.arange(len(known), dtype=np.int32)
    for i, x in enumerate(items):
        at = row[x]
        at = at[at >= 0]
        if len(at):
            score = weights[at].sum(axis=0)
            first = int(score.argmax())
            if score[first] > 0:
                score[first] = -1.0
                out[i] = first * k + (int(score.argmax()) if k > 1 else 0)
    return out


def anchor_order(anchors: list[np.ndarray], known: np.ndarray, weights: np.ndarray) -> list[int]:
    """The anchors in a chain from each to the one most like it, so that neighbouring cells are alike."""
    if not len(known):
        return list(range(len(anchors)))
    rows = []
    for x in anchors:
        t = np.unique(x)
        at = np.minimum(np.searchsorted(known, t), len(known) - 1)
        rows.append(weights[at[known[at] == t]].sum(axis=0))
    alike = np.stack(rows)
    alike = alike + alike.T
    chain, left = [0], set(range(1, len(anchors)))
    while left:
        chain.append(max(left, key=lambda j: (alike[chain[-1], j], -j)))
        left.discard(chain[-1])
    return chain


def statistics(items: list[np.ndarray]) -> tuple:
    """(items, mean length, sorted terms, their item counts), as ``Bm25Index`` takes them."""
    items = [x for x in items if len(x)]
    term, n = np.unique(np.concatenate([np.unique(x) for x in items]), return_counts=True) if items else (np.empty(0, np.int32), np.empty(0, np.int64))
    return len(items), sum(map(len, items)) / max(1, len(items)), term, n


def fit_routing(sample: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(terms, weights) of the anchors among a sample of items, in a chain of likeness."""
    anchors = [x for x in sample if len(x)][:ANCHORS]
    known, weights = anchor_weights(anchors, statistics(sample))
    return known, np.ascontiguousarray(weights[:, anchor_order(anchors, known, weights)]) if anchors else weights


def _tokenise(vocabulary: str, capacity: int, known: np.ndarray, weights: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tok = [encode(t, vocabulary).astype(np.int32).tobytes() for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "salt": pdf["salt"], "cell": cells_of([_rest(x, capacity) for x in tok], known, weights), "tok": tok})

    return run


def shard_table(cells: list[tuple[int, int]], shard_docs: int) -> list[tuple[int, int, int]]:
    """(cell, first shard, shards) from (cell, documents): small cells share a shard with the next ones, large ones get several."""
    out, shard, room = [], 0, shard_docs
    for cell, n in sorted(cells):
        if n > room and room < shard_docs:
            shard, room = shard + 1, shard_docs
        many = max(1, -(-n // shard_docs))
        out.append((cell, shard, many))
        if many > 1:
            shard, room = shard + many, shard_docs
        else:
            room -= n
    return out


def _rest_terms(capacity: int):
    """(term, n): items each term occurs in; -1 stands for all items, -2 for their tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            items = [x for x in (_rest(b, capacity) for b in pdf["tok"]) if len(x)]
            if items:
                term, n = np.unique(np.concatenate([np.unique(x) for x in items]), return_counts=True)
                yield pd.DataFrame({"term": np.concatenate((term, [-1, -2])), "n": np.concatenate((n, [len(items), sum(map(len, items))]))})

    return run


def item_stats(tokens: DataFrame, capacity: int) -> tuple | None:
    """Statistics of all items for ``Bm25Index``; as many rows as the vocabulary has tokens reach the driver."""
    got = tokens.select("tok").mapInPandas(_rest_terms(capacity), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).orderBy("term").toPandas()
    if not len(got):
        return None
    n, term = got["n"].to_numpy(np.int64), got["term"].to_numpy(np.int64)
    return int(n[1]), float(n[0]) / float(n[1]), term[2:].astype(np.int32), n[2:]


def _pack_shard(capacity: int, stats: tuple | None):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        base = int(key[0]) * _CONTAINERS_PER_SHARD
        rows, items, origin = [], [], []
        pdf = pdf.sort_values(["id", "tok"], kind="stable")  # ids travel as text: whole numbers with NULLs would become floats
        box = 0
        for id_, raw in zip(pdf["id"], pdf["tok"], strict=True):
            tok = np.frombuffer(raw, dtype=np.int32).astype(np.int64)
            n = len(tok)
            pieces = max(1, math.ceil(n / capacity))
            if n == 0:
                rows.append((None, 0, id_, 0, 1, 0, 0, None))
                continue
            full = n // capacity
            for p in range(full):
                rows.append((base + box, 0, id_, p, pieces, p * capacity, capacity, None))
                box += 1
            if n % capacity:
                items.append(tok[full * capacity :])
                origin.append((id_, full, pieces))
        for members in pack(items, capacity, stats):
            for pos, (i, score) in enumerate(members):
                id_, piece, pieces = origin[i]
                rows.append((base + box, pos, id_, piece, pieces, piece * capacity, len(items[i]), score))
            box += 1
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _OUT.split(", ")])

    return run


def pack_containers(
    docs: DataFrame, id_col: str, text_col: str, capacity: int = CAPACITY,
    vocabulary: str = DEFAULT_VOCABULARY, shard_docs: int = SHARD_DOCS,
) -> DataFrame:
    """One row per packed piece: container_id, position, id, piece_no, n_pieces, token_start, n_tokens, score."""
    spark = docs.sparkSession
    rows = spread(docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")))
    # a number of the row, whatever its id and text, decides where copies go; it is stored with the tokens, so it is one
    rows = rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    # the row hashes below a threshold: about SAMPLE rows of the whole table, without an order
    least = -(2**63) + min(2**64 - 1, 2**64 * SAMPLE // max(1, docs.count()))
    sample = rows.where((F.col("salt") <= least) & F.length("text").between(1, SAMPLE_CHARS)).select("salt", "text").collect()
    known, weights = fit_routing([_rest(encode(r["text"], vocabulary).astype(np.int32).tobytes(), capacity) for r in sorted(sample, key=lambda r: r["salt"])])
    tokens = materialize(rows.mapInPandas(_tokenise(vocabulary, capacity, known, weights), "id string, salt bigint, cell bigint, tok binary"), "pack-tokens")
    stats = item_stats(tokens, capacity)
    cells = [(r["cell"], r["n"]) for r in tokens.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()]  # at most ANCHORS squared rows
    table = shard_table(cells, shard_docs)
    shards = max((first + many for _, first, many in table), default=1)
    plan = spark.createDataFrame(table, "cell bigint, first int, many int")
    shard = (F.col("first") + F.pmod("salt", F.col("many"))).cast("int")
    # one task per shard: its input stays a few megabytes whatever the size of the corpus
    placed = tokens.join(F.broadcast(plan), "cell").select("id", "tok", shard.alias("shard"))
    packed = placed.repartition(shards, "shard").groupBy("shard").applyInPandas(_pack_shard(capacity, stats), _OUT)
    return packed.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)


def neighbour_share(items: list[np.ndarray], shard: list[int], k: int = 10) -> float:
    """Share of the ``k`` best BM25 neighbours of every item, among all items, that lie in its shard."""
    index, at = Bm25Index(items), np.array(shard)
    found = wanted = 0
    for i in range(len(items)):
        score = index.scores(i)
        score[i] = 0.0
        best = np.argsort(-score, kind="stable")[:k]
        best = best[score[best] > 0]
        wanted += len(best)
        found += int((at[best] == at[i]).sum())
    return found / max(1, wanted)


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, share of the room that is used, pieces, cut documents."""
    per = packed.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("pieces"), F.max((F.col("n_pieces") > 1).cast("int")).alias("cut"))
    return per.agg(
        F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.sum("pieces").alias("pieces"),
        (F.sum("used") / (F.count(F.lit(1)) * F.lit(capacity))).alias("fill"), F.max("used").alias("largest"), F.sum("cut").alias("with_cut_texts"),
    )
