"""Pairs of items that appear together, by a blocked Gram matrix.

Baskets become rows of a sparse binary matrix whose columns are cut into item blocks.  For a
block of baskets and a pair of item blocks, the product of the transposed rows of one with
the rows of the other counts the pairs of that tile; the tiles are summed over all basket
blocks, and the counts are put against what the items' own counts lead one to expect.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import cut

#: Columns of a tile's side and entries of a basket block; they bound what one task holds.
BLOCK_ITEMS = 2048
BLOCK_ENTRIES = 400_000
#: Different pairs that a task holds before it passes their counts on.
BLOCK_CODES = 4_000_000
_TILE = "ia int, ib int, la int, lb int, n bigint"


def clean_item(column: str) -> Column:
    """An item's id without outer blanks and in upper case; null where nothing is left."""
    return F.nullif(F.upper(F.regexp_replace(F.col(column), r"(?U)^[\s\p{Z}]+|[\s\p{Z}]+$", "")), F.lit(""))


def memberships(rows: DataFrame, basket: str, item: Column) -> DataFrame:
    """Distinct (``basket``, ``item``); rows without either are left out."""
    pairs = rows.select(F.col(basket).cast("string").alias("basket"), item.alias("item"))
    return pairs.where(F.col("basket").isNotNull() & F.col("item").isNotNull()).distinct()


def dictionary(members: DataFrame, least: int, block_items: int) -> DataFrame:
    """``item``, ``n_with``, ``block`` and ``slot`` of the items in at least ``least`` baskets.

    Blocks come from a hash, slots from a count inside the block, so no global order is made.
    """
    counted = cut(members.groupBy("item").agg(F.count("*").alias("n_with")).where(F.col("n_with") >= least))
    blocks = max(1, -(-counted.count() * 5 // (block_items * 4)))  # blocks a fifth below their limit on average
    placed = counted.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))
    return placed.withColumn("slot", (F.row_number().over(Window.partitionBy("block").orderBy("item")) - 1).cast("int"))


def _products(a: list[np.ndarray], b: list[np.ndarray], same: bool) -> Iterator[np.ndarray]:
    """Codes ``left << 31 | right`` of the entries of transposed rows of block a times rows of block b, some baskets at a time."""
    work = np.cumsum([len(x) * len(y) for x, y in zip(a, b)])
    for rows in np.split(np.arange(len(a)), np.searchsorted(work, np.arange(BLOCK_ENTRIES, work[-1] if len(work) else 0, BLOCK_ENTRIES))):
        if not len(rows):
            continue
        na, nb = np.array([len(a[k]) for k in rows]), np.array([len(b[k]) for k in rows])
        fa, fb = np.concatenate([a[k] for k in rows]).astype(np.int64), np.concatenate([b[k] for k in rows]).astype(np.int64)
        # CSR product row by row: each entry of a's row meets all entries of b's row
        per_entry = np.repeat(nb, na)
        first = np.repeat(np.repeat(np.cumsum(nb) - nb, na), per_entry)
        inner = np.arange(per_entry.sum()) - np.repeat(np.cumsum(per_entry) - per_entry, per_entry)
        left, right = np.repeat(fa, per_entry), fb[first + inner]
        yield (left << 31 | right)[left < right] if same else left << 31 | right


class _Sums:
    """Counts of codes, added up as they come; held until there are ``BLOCK_CODES`` different ones."""

    def __init__(self):
        self.codes, self.counts, self.waiting, self.held = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), [], 0

    def add(self, codes: np.ndarray) -> None:
        self.waiting.append(codes)
        self.held += len(codes)
        if self.held > 4 * BLOCK_ENTRIES:
            self.settle()

    def settle(self) -> None:
        if self.waiting:
            new, n = np.unique(np.concatenate(self.waiting), return_counts=True)
            codes, at = np.unique(np.concatenate([self.codes, new]), return_inverse=True)
            self.counts = np.bincount(at, weights=np.concatenate([self.counts, n]), minlength=len(codes)).astype(np.int64)
            self.codes, self.waiting, self.held = codes, [], 0

    def take(self, ia: int, ib: int) -> pd.DataFrame:
        self.settle()
        out = pd.DataFrame({"ia": ia, "ib": ib, "la": self.codes >> 31, "lb": self.codes & ((1 << 31) - 1), "n": self.counts})
        self.__init__()
        return out


def _tile(part: pd.DataFrame) -> pd.DataFrame:
    """Counts of one tile over one block of baskets: ``side`` is 0 for rows of block a, 1 for b, 2 where both are the same block."""
    ia, ib = int(part["ia"].iloc[0]), int(part["ib"].iloc[0])
    sums = _Sums()
    if ia == ib:
        a = b = part["slots"].tolist()
    else:
        other = dict(zip(part["basket"][part["side"] == 1], part["slots"][part["side"] == 1]))
        mine = part[part["side"] == 0]
        a, b = mine["slots"].tolist(), [other[x] for x in mine["basket"]]
    for codes in _products(a, b, ia == ib):
        sums.add(codes)
    return sums.take(ia, ib)


def _one_block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of the only tile over the baskets of a partition; no basket has to move."""
    sums = _Sums()
    for batch in batches:
        for codes in _products(batch["slots"].tolist(), batch["slots"].tolist(), True):
            sums.add(codes)
            if len(sums.codes) > BLOCK_CODES:
                yield sums.take(0, 0)
    yield sums.take(0, 0)


def tile_counts(vectors: DataFrame) -> DataFrame:
    """Counts per tile and basket block of ``vectors`` (basket, block, slots), combined before they are moved on.

    Each row goes to the tiles of its block with each block that its basket has, so a large
    basket is spread over as many tasks as it has tiles; a tile's baskets are cut into blocks of
    about ``BLOCK_ENTRIES`` entries.
    """
    lists = vectors.groupBy("basket").agg(F.sort_array(F.collect_list("block")).alias("blocks"))  # at most the number of blocks
    dealt = vectors.join(lists, "basket").withColumn("_other", F.explode("blocks"))
    low, high = F.least("block", "_other"), F.greatest("block", "_other")
    side = F.when(F.col("block") == F.col("_other"), 2).when(F.col("block") < F.col("_other"), 0).otherwise(1)
    dealt = dealt.select("basket", "slots", low.alias("ia"), high.alias("ib"), side.alias("side"))
    sizes = dealt.groupBy("ia", "ib").agg(F.ceil(F.sum(F.size("slots")) / BLOCK_ENTRIES).alias("_parts"))
    parted = dealt.join(sizes, ["ia", "ib"]).withColumn("part", F.pmod(F.xxhash64("basket"), F.col("_parts")))
    return parted.groupBy("ia", "ib", "part").applyInPandas(_tile, _TILE)


def pair_counts(
    rows: DataFrame, basket: str, item: Column, least_pair: int = 1, least_share: int | None = None, block_items: int = BLOCK_ITEMS
) -> DataFrame:
    """``item_a`` < ``item_b``, ``n_together``, ``n_a``, ``n_b``, ``n_baskets``, ``expected`` and ``lift`` of each pair.

    An item counts once per basket, whatever rows repeat it; rows with a null basket or item
    are left out of pairs, baskets of one item count among all baskets.  Pairs on fewer than
    ``least_pair`` baskets, or than 1/``least_share`` of all, are not returned; items that
    cannot reach that number are left out before the product, which loses no pair.  ``lift``
    is n_together * n_baskets / (n_a * n_b).  An empty table gives no rows.
    """
    members = cut(memberships(rows, basket, item))
    n_baskets = rows.where(F.col(basket).isNotNull()).select(F.count_distinct(F.col(basket))).first()[0]
    least = max(least_pair, -(-n_baskets // least_share) if least_share else 1)
    items = cut(dictionary(members, least, block_items))
    placed = members.join(items.select("item", "block", "slot"), "item")
    vectors = placed.groupBy("basket", "block").agg(F.sort_array(F.collect_list("slot")).alias("slots"))  # at most a block's items
    if items.select(F.max("block")).first()[0]:
        counted = tile_counts(cut(vectors))
    else:
        counted = vectors.select("slots").mapInPandas(_one_block, _TILE)
    summed = counted.groupBy("ia", "ib", "la", "lb").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    name = lambda side: items.select(
        F.col("block").alias(f"i{side}"), F.col("slot").alias(f"l{side}"), F.col("item").alias(f"name_{side}"), F.col("n_with").alias(f"with_{side}")
    )
    named = summed.join(name("a"), ["ia", "la"]).join(name("b"), ["ib", "lb"])
    ordered = F.col("name_a") < F.col("name_b")
    pick = lambda x, y: F.when(ordered, F.col(x)).otherwise(F.col(y))
    out = named.select(
        pick("name_a", "name_b").alias("item_a"), pick("name_b", "name_a").alias("item_b"), F.col("n").alias("n_together"),
        pick("with_a", "with_b").alias("n_a"), pick("with_b", "with_a").alias("n_b"), F.lit(n_baskets).cast("bigint").alias("n_baskets"),
    )
    expected = F.col("n_a").cast("double") * F.col("n_b") / F.col("n_baskets")
    return out.withColumns({"expected": expected, "lift": F.col("n_together") / expected})


def strong_pairs(pairs: DataFrame, least_pair: int = 5, share: int = 500, times: int = 3) -> DataFrame:
    """Pairs on enough baskets and at least ``times`` as often as chance, decided on whole numbers."""
    big = lambda c: F.col(c).cast("decimal(19,0)")
    often = big("n_together") * big("n_baskets") >= big("n_a") * big("n_b") * times
    return pairs.where((F.col("n_together") >= least_pair) & (F.col("n_together") * share >= F.col("n_baskets")) & often)
