"""Filling fixed-capacity containers with documents by lexical retrieval.

The corpus is cut into shards of equal size along an order in which documents alike stand together:
first by the leaf of a tree of lexical clusters, fitted on a bounded sample, then by a lexical key,
so that a cluster or a group of copies of any size fills several shards.  Each shard holds an
inverted index with BM25 weights over token ids, whose document frequencies are counted over the
whole corpus.  The longest unused document seeds a container and its unused neighbours are taken
in order of their score while they fit; the last gap goes to the longest neighbours that fit it, and
only what no neighbour fills to other documents.  The contents of containers that stay too empty
are packed once more together with those of other shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.encoding import encode_documents
from millrace.operators.ordered import range_prefix_sums
from millrace.session import cut

CAPACITY = 2048
SHARD_ITEMS = 4000
#: Bound of the documents on which the tree of clusters is fitted, and the least that one of its leaves has of them.
FIT_ITEMS = 20_000
LEAF_ITEMS = 20
#: Numbers that stand for a document's weighted terms in the tree.
SKETCH = 512
#: Terms of a lexical key.
KEY_TERMS = 4
K1, B = 1.2, 0.75
#: Containers filled less than this are packed again across shards.
FULL = 0.97
_OUT = "doc_id {key}, piece int, start int, n_tokens int, container_id bigint, position int, filled int"


def bm25_rows(docs: list[np.ndarray], idf: np.ndarray, mean_length: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, weight) of every distinct term of every document."""
    lengths = np.array([len(d) for d in docs], dtype=np.int64)
    flat = np.concatenate(docs).astype(np.int64) if len(docs) else np.empty(0, dtype=np.int64)
    vocabulary = len(idf)
    codes, tf = np.unique(np.repeat(np.arange(len(docs)), lengths) * vocabulary + flat, return_counts=True)
    doc, term = codes // vocabulary, codes % vocabulary
    weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / max(mean_length, 1.0)))
    return doc, term, weight


def lexical_keys(docs: list[np.ndarray], idf: np.ndarray) -> list[str]:
    """A key per document, to sort by.

    Each of its terms is the document's least under a random order of the vocabulary in which a
    rare term tends to come first, so two documents share it as often as they share weight of terms.
    """
    chance = np.random.default_rng(5).exponential(size=(KEY_TERMS, len(idf))) / np.maximum(idf, 1e-9)
    return ["".join(f"{d[k]:08x}" for k in chance[:, d].argmin(axis=1)) if len(d) else "" for d in docs]


def sketches(docs: list[np.ndarray], idf: np.ndarray, mean_length: float) -> np.ndarray:
    """BM25 weights of each document's terms, added up in ``SKETCH`` signed cells and brought to length 1."""
    doc, term, weight = bm25_rows(docs, idf, mean_length)
    mixed = term.astype(np.uint32) * np.uint32(2654435761)
    mixed ^= mixed >> np.uint32(15)
    signed = np.where(mixed & np.uint32(1 << 12), weight, -weight)
    flat = np.bincount(doc * SKETCH + mixed % np.uint32(SKETCH), weights=signed, minlength=len(docs) * SKETCH)
    out = flat.reshape(len(docs), SKETCH).astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


@dataclass(frozen=True)
class ClusterTree:
    """Halves of halves of a sample: per inner node a direction and the value that parts it; ``below`` are the nodes of its sides (-1: a leaf)."""

    direction: np.ndarray
    cut: np.ndarray
    below: np.ndarray

    def leaves(self, points: np.ndarray) -> list[str]:
        """The way of each point from the root, as a text of 0 and 1; ways that part late are alike and sort together."""
        at, way = np.zeros(len(points), dtype=np.int64) - (len(self.cut) == 0), [[] for _ in range(len(points))]
        while (open_ := np.nonzero(at >= 0)[0]).size:
            side = (points[open_] * self.direction[at[open_]]).sum(axis=1) > self.cut[at[open_]]
            for k, s in zip(open_.tolist(), side.tolist()):
                way[k].append("1" if s else "0")
            at[open_] = self.below[at[open_], side.astype(int)]
        return ["".join(w) for w in way]


def fit_tree(points: np.ndarray, least: int = LEAF_ITEMS, rounds: int = 12, seed: int = 3) -> ClusterTree:
    """Part ``points`` in two halves about two centres, each half again, down to leaves of under 2 * ``least``."""
    rng = np.random.default_rng(seed)
    direction, cuts, below, waiting = [], [], [], [(np.arange(len(points)), -1, 0)]
    while waiting:
        rows, above, side = waiting.pop()
        if len(rows) < 2 * least:
            continue
        x = points[rows]
        centres = x[rng.choice(len(rows), 2, replace=False)]
        for _ in range(rounds):
            lean = x @ (centres[0] - centres[1])
            middle = np.median(lean)
            over = lean > middle
            if over.all() or not over.any():
                break
            means = np.stack([x[over].mean(axis=0), x[~over].mean(axis=0)])
            centres = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)
        if over.all() or not over.any():  # all alike
            continue
        lean = x @ (centres[0] - centres[1])
        middle = np.median(lean)
        over = lean > middle
        if over.all() or not over.any():
            continue
        direction.append(centres[0] - centres[1])
        cuts.append(middle)
        below.append([-1, -1])
        if above >= 0:
            below[above][side] = len(cuts) - 1
        waiting += [(rows[over], len(cuts) - 1, 1), (rows[~over], len(cuts) - 1, 0)]
    return ClusterTree(np.array(direction, dtype=np.float32).reshape(len(cuts), points.shape[1]), np.array(cuts, dtype=np.float32), np.array(below, dtype=np.int64).reshape(len(cuts), 2))


def gap_filler(items: np.ndarray, sizes: np.ndarray, room: int) -> list[int]:
    """Items for a gap: again and again the longest that fits, in the order given among equals."""
    out: list[int] = []
    fitting = items[sizes[items] <= room]
    fitting = fitting[np.argsort(-sizes[fitting], kind="stable")]
    for i in fitting[sizes[fitting] > 0]:
        if sizes[i] <= room:
            out.append(int(i))
            room -= int(sizes[i])
        if not room:
            break
    return out


def fill(sizes: np.ndarray, docs: list[np.ndarray], capacity: int, idf: np.ndarray, mean_length: float) -> list[list[int]]:
    """Containers as lists of item numbers, the seed first; every item fits by itself.  Ties go to the lower number.

    Items without tokens go into the first container.
    """
    n = len(sizes)
    doc, term, weight = bm25_rows(docs, idf, mean_length)
    own = np.searchsorted(doc, np.arange(n + 1))
    by_term = np.argsort(term, kind="stable")
    holders, holder_weight, sorted_terms = doc[by_term], weight[by_term], term[by_term]
    unused = sizes > 0
    by_size = np.lexsort((np.arange(n), -sizes))
    out = []
    for seed in by_size:
        if not unused[seed]:
            continue
        unused[seed] = False
        box, room = [int(seed)], capacity - int(sizes[seed])
        terms = term[own[seed] : own[seed + 1]]
        lo, hi = np.searchsorted(sorted_terms, terms), np.searchsorted(sorted_terms, terms, side="right")
        count = hi - lo
        near = ranked = np.empty(0, dtype=np.int64)
        if room and count.sum():
            at = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())
            score = np.bincount(holders[at], weights=holder_weight[at], minlength=n)
            near = np.nonzero(unused & (score > 0) & (sizes <= room))[0]
            ranked = near[np.lexsort((near, -score[near]))]
        typical = np.median(sizes[near]) if len(near) else 0
        taken = 0
        while taken < len(ranked) and room >= 2 * typical:  # then the neighbours that are left compete for the gap
            i = int(ranked[taken])
            taken += 1
            if sizes[i] <= room:
                box.append(i)
                unused[i] = False
                room -= int(sizes[i])
        for items in (ranked[taken:], by_size):
            added = gap_filler(items[unused[items]], sizes, room) if room else []
            box += added
            unused[added] = False
            room -= int(sizes[added].sum())
        out.append(box)
    empty = np.nonzero(sizes == 0)[0].tolist()
    return [out[0] + empty, *out[1:]] if out else [empty] if empty else []


def _pack(key: str, capacity: int, idf: np.ndarray, mean_length: float, again: bool):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "piece", "start"], na_position="first", kind="stable").reset_index(drop=True)
        shard = int(part["shard"].iloc[0])
        sizes = part["n_tokens"].to_numpy().astype(np.int64)
        docs = [np.asarray(x) for x in part["terms"]]
        boxes = fill(sizes, docs, capacity, idf, mean_length)
        base = (shard * 2 + again) << 31
        container, position, filled = np.zeros(len(part), dtype=np.int64), np.zeros(len(part), dtype=np.int64), np.zeros(len(part), dtype=np.int64)
        for k, box in enumerate(boxes):
            container[box], filled[box] = base + k, sizes[box].sum()
            position[box] = np.concatenate([[0], np.cumsum(sizes[box])[:-1]])
        out = part[["doc_id", "piece", "start", "n_tokens"]].copy()
        out["container_id"], out["position"], out["filled"] = container, position, filled
        if not again:
            out["terms"] = part["terms"]
        return out

    return run


def _sketched(idf: np.ndarray, mean_length: float):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = sketches([np.asarray(x, dtype=np.int64) for x in part["ids"]], idf, mean_length)
            yield pd.DataFrame({"sketch": [r.tobytes() for r in rows]})

    return run


def _keyed(idf: np.ndarray, mean_length: float, tree: ClusterTree):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            docs = [np.asarray(x, dtype=np.int64) for x in part["terms"]]
            yield pd.DataFrame({"row": part["row"], "piece": part["piece"], "leaf": tree.leaves(sketches(docs, idf, mean_length)), "key": lexical_keys(docs, idf)})

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, vocabulary: int = 50_257, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``n_tokens``, ``container_id``, ``position`` of every document.

    ``items`` has doc_id and ids.  A document longer than ``capacity`` is cut into pieces of
    exactly ``capacity``, each alone in a container, and a last piece that is packed like a
    document; all others stay whole.  Documents without tokens take no room but are placed
    too.  Repeated documents are items of their own; an empty table gives no rows.
    """
    spark = items.sparkSession
    key = items.schema["doc_id"].dataType.simpleString()
    sized = cut(items.select("doc_id", "ids", F.size("ids").alias("n"), F.monotonically_increasing_id().alias("row")))
    totals = sized.agg(F.count("*").alias("docs"), F.avg("n").alias("mean")).first()
    if not totals["docs"]:
        return spark.createDataFrame([], f"doc_id {key}, piece int, start int, n_tokens int, container_id bigint, position int")
    # at most a row per token id of the vocabulary
    seen = sized.select(F.explode(F.array_distinct("ids")).alias("term")).groupBy("term").agg(F.count("*").alias("df")).toPandas()
    frequency = np.zeros(max(vocabulary, int(seen["term"].max() or 0) + 1) if len(seen) else vocabulary)
    if len(seen):
        frequency[seen["term"].to_numpy()] = seen["df"].to_numpy()
    idf = np.log1p((totals["docs"] - frequency + 0.5) / (frequency + 0.5)).astype(np.float32)
    mean = float(totals["mean"] or 0)
    n, cap = F.col("n"), F.lit(capacity)
    pieces = F.sequence(F.lit(0), F.when(n <= cap, 0).otherwise(F.ceil(n / cap).cast("int") - 1))
    cutup = sized.withColumn("piece", F.explode(pieces)).withColumn("start", F.col("piece") * cap)
    cutup = cutup.withColumn("n_tokens", F.least(n - F.col("start"), cap).cast("int"))
    alone = cutup.where(F.col("n_tokens") == cap)
    lone_id = F.lit(1 << 62) + F.monotonically_increasing_id()  # row numbers of a stored table, unlike any shard's
    full = alone.select("doc_id", "piece", "start", "n_tokens", lone_id.alias("container_id"), F.lit(0).alias("position"))
    rest = cutup.where(F.col("n_tokens") < cap)
    rest = rest.select("row", "doc_id", "piece", "start", "n_tokens", F.slice("ids", F.col("start") + 1, F.col("n_tokens")).alias("terms"))
    sample = sized.where(n > 0).orderBy(F.xxhash64("row"), "row").limit(FIT_ITEMS).select("ids").mapInPandas(_sketched(idf, mean), "sketch binary").toPandas()["sketch"]
    tree = fit_tree(np.frombuffer(b"".join(sample), dtype=np.float32).reshape(-1, SKETCH))
    keyed = rest.select("row", "piece", "terms").mapInPandas(_keyed(idf, mean, tree), "row bigint, piece int, leaf string, key string")
    ranked = range_prefix_sums(keyed.withColumns({"_all": F.lit(0), "_one": F.lit(1)}), ["_all"], ["leaf", "key", "row", "piece"], {"_rank": "_one"})
    rest = rest.join(ranked.select("row", "piece", F.floor((F.col("_rank") - 1) / shard_items).cast("bigint").alias("shard")), ["row", "piece"]).drop("row")
    shape = _OUT.format(key=key)
    first = cut(rest.groupBy("shard").applyInPandas(_pack(key, capacity, idf, mean, False), shape + ", terms array<int>"))
    good = F.col("filled") >= FULL * capacity
    loose = first.where(~good)
    coarse = max(1, -(-int(loose.count()) // (shard_items * 2)))
    again = loose.select("doc_id", "piece", "start", "n_tokens", "terms", F.pmod(F.xxhash64("container_id"), F.lit(coarse)).alias("shard"))
    second = again.groupBy("shard").applyInPandas(_pack(key, capacity, idf, mean, True), shape)
    columns = ["doc_id", "piece", "start", "n_tokens", "container_id", "position"]
    return full.select(columns).unionByName(first.where(good).select(columns)).unionByName(second.select(columns))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """Documents sized in tokens of a public tokenizer and packed, see ``pack``."""
    return pack(encode_documents(docs, vocabulary=vocabulary, pattern=pattern), capacity)


def usage(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens and the share of room that is used."""
    boxes = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("filled"))
    return boxes.agg(F.count("*").alias("n_containers"), F.sum("filled").alias("n_tokens"), (F.sum("filled") / (F.count("*") * capacity)).alias("used"))
