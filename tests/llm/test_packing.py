import math
import random

import numpy as np
import pytest

from millrace.llm import packing


def check(rows, docs, capacity):
    boxes, pieces = {}, {}
    for r in rows:
        boxes.setdefault(r.container_id, []).append(r)
        pieces.setdefault(r.doc_id, []).append(r)
    for box in boxes.values():
        assert sum(r.n_tokens for r in box) <= capacity
        at = 0
        for r in sorted((r for r in box if r.n_tokens), key=lambda r: r.position):
            assert r.position == at
            at += r.n_tokens
    for key, n in docs.items():
        own = sorted(pieces[key], key=lambda r: r.piece)
        assert sum(r.n_tokens for r in own) == n and len(own) == max(1, math.ceil(n / capacity))
        assert [r.start for r in own] == [k * capacity for k in range(len(own))]
    assert set(pieces) == set(docs)
    return len(boxes)


@pytest.mark.parametrize("shard", [50, 2000])
def test_every_item_has_room(spark, shard):
    r = random.Random(2)
    ids = {k: [r.randint(0, 400) for _ in range(r.choice([0, 3, 20, 60, 99, 100, 101, 350]))] for k in range(400)}
    df = spark.createDataFrame(list(ids.items()), "doc_id long, ids array<int>").repartition(5)
    rows = packing.pack(df, capacity=100, shard_items=shard).collect()
    total = sum(map(len, ids.values()))
    used = check(rows, {k: len(v) for k, v in ids.items()}, 100)
    assert used <= math.ceil(total / 100 / 0.93) + 1


def test_neighbours_share_words():
    sizes = np.full(40, 25)
    docs = [np.arange(25) + (1000 if k % 2 else 0) for k in range(40)]
    boxes = packing.fill(sizes, docs, 200, np.ones(2000, dtype=np.float32), 25.0)
    assert all(len({i % 2 for i in box[:6]}) == 1 for box in boxes[:4])


def test_neighbours_meet_in_one_shard(spark):
    r = random.Random(4)
    ids = {k: [r.randrange(40) + 50 * (k % 60) for _ in range(25)] for k in range(1200)}  # 60 subjects
    df = spark.createDataFrame(list(ids.items()), "doc_id long, ids array<int>").repartition(5)
    boxes = {}
    for row in packing.pack(df, capacity=100, shard_items=60).collect():
        boxes.setdefault(row.container_id, []).append(row.doc_id % 60)
    alike = sum(len(b) - len(set(b)) for b in boxes.values())
    assert alike >= 0.6 * sum(len(b) - 1 for b in boxes.values())


def test_repeats_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, [1, 2]), (1, [1, 2]), (None, [3]), (2, [])], "doc_id long, ids array<int>")
    rows = packing.pack(df, capacity=10).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in rows) == [(False, 1, 2), (False, 1, 2), (False, 2, 0), (True, 0, 1)]
    assert packing.pack(df.limit(0)).count() == 0


def test_documents_fill_their_containers(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = packing.pack_documents(docs, 512)
    assert packing.usage(packed, 512).first().used > 0.95
    assert packed.select("doc_id").distinct().count() == docs.count()


def relatedness(rows, docs, idf):
    """Mean share of term weight that a container's members have in common with its seed."""
    boxes = {}
    for r in rows:
        if r.n_tokens and r.n_tokens < packing.CAPACITY:
            boxes.setdefault(r.container_id, []).append((r.position, r.doc_id, r.start, r.n_tokens))
    terms = lambda x: np.unique(docs[x[1]][x[2] : x[2] + x[3]])
    out = []
    for box in boxes.values():
        seed, *others = map(terms, sorted(box))
        for other in others:
            both = idf[np.intersect1d(seed, other)].sum()
            out.append(both / (idf[seed].sum() + idf[other].sum() - both))
    return np.mean(out)


@pytest.mark.parametrize(("size", "shard"), [("sf0.01", 300), ("sf0.1", 2000)])
def test_members_are_as_near_to_their_seed_as_without_shards(spark, size, shard):
    encoded = packing.encode_documents(spark.read.parquet(f"/root/testdata/{size}/documents.parquet")).cache()
    docs = {r.doc_id: np.array(r.ids, dtype=np.int64) for r in encoded.collect()}
    counts = np.zeros(50_257)
    for d in docs.values():
        counts[np.unique(d)] += 1
    idf = np.log1p((len(docs) - counts + 0.5) / (counts + 0.5))
    whole, cut = (packing.pack(encoded, shard_items=n) for n in (10**9, shard))
    near, used = relatedness(cut.collect(), docs, idf), packing.usage(cut).first().used
    assert near >= 0.9 * relatedness(whole.collect(), docs, idf) and used >= 0.97 + 0.02 * (size == "sf0.1")


def test_tree_of_equal_and_few_points():
    alike = np.ones((200, packing.SKETCH), dtype=np.float32) / np.sqrt(packing.SKETCH)
    for points in (alike, alike[:3], alike[:0]):
        assert packing.fit_tree(points).leaves(alike) == [""] * 200
    apart = np.eye(packing.SKETCH, dtype=np.float32)[np.arange(300) % 4]
    ways = packing.fit_tree(apart, 20).leaves(apart)
    assert len(set(ways)) >= 2 and all(ways[k] == ways[k % 4] for k in range(300))
