"""Token ids of a byte-level BPE for texts of any length, by a tree of joins.

A text is cut into leaves, each leaf is encoded alone, and neighbours are joined up the
tree.  A join encodes a window over the seam again and widens it until the pieces on both
sides provably stay as they are.

Why that is enough: the tokenizer first cuts a text into pieces from left to right with a
pattern that looks only forward, and merges bytes inside a piece only.  A piece that starts
at ``s`` depends on the text from ``s`` to at most ``AHEAD`` characters past its end (a
contraction such as 'll needs two letters after the apostrophe, a run of blanks needs the
character after it).  So in the left text all pieces that end ``AHEAD`` or more before its
end stay, and once the scan of the joined text starts a piece at a place where the right
text's own scan starts one, everything after is the right text's encoding.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import spread

AHEAD = 3
LEAF_CHARS = 4096
WINDOW_CHARS = 256


@functools.lru_cache(maxsize=2)
def _tools(vocabulary: str, pattern: str):
    """The encoder of a .tiktoken file and the compiled pattern of its pieces."""
    import regex
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding(vocabulary, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), regex.compile(pattern)


def default_vocabulary() -> tuple[str, str]:
    """Path of byte_bpe_50k among the installed public tokenizers, and its pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@dataclass
class Node:
    """An encoded stretch of text: the starts of its pieces and where their ids begin."""

    text: str
    starts: np.ndarray  # starts of pieces, then len(text)
    places: np.ndarray  # per start, the number of ids before it
    ids: np.ndarray

    def until(self, k: int) -> np.ndarray:
        return self.ids[: self.places[k]]


class TreeEncoder:
    def __init__(self, vocabulary: str, pattern: str, leaf_chars: int = LEAF_CHARS, window_chars: int = WINDOW_CHARS):
        self.encoding, self.pieces = _tools(vocabulary, pattern)
        self.leaf_chars, self.window_chars = max(1, leaf_chars), max(1, window_chars)

    def _plain(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def leaf(self, text: str) -> Node:
        spans = [m.span() for m in self.pieces.finditer(text)]
        ids = [self._plain(text[a:b]) for a, b in spans]
        starts = np.array([a for a, _ in spans] + [len(text)])
        places = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]) if ids else np.zeros(1, dtype=np.int64)
        return Node(text, starts, places, np.array([t for x in ids for t in x], dtype=np.int32))

    def join(self, left: Node, right: Node) -> Node:
        if not left.text or not right.text:
            return right if not left.text else left
        text = left.text + right.text
        # the last start that surely stays: the piece before it ends AHEAD before the end of the left text
        keep = max(int(np.searchsorted(left.starts, len(left.text) - AHEAD, side="right")) - 1, 0)
        seam = int(left.starts[keep])
        reach = self.window_chars
        while True:
            whole = reach >= len(right.text)
            window = self.leaf(text[seam : len(left.text) + min(reach, len(right.text))])
            stable = window.starts if whole else window.starts[window.starts <= len(window.text) - AHEAD]
            own = stable[1:] + seam - len(left.text)  # places in the right text
            inside = own[(own >= 0) & np.isin(own, right.starts)]
            if whole and not len(inside):
                inside = np.array([len(right.text)])
            if len(inside):
                meet = int(inside[0])
                w = int(np.searchsorted(window.starts, meet + len(left.text) - seam))
                r = int(np.searchsorted(right.starts, meet))
                break
            reach *= 2
        head, middle = left.until(keep), window.until(w)
        tail = right.ids[right.places[r] :]
        shift = len(head) + len(middle) - right.places[r]
        return Node(
            text,
            np.concatenate([left.starts[:keep], window.starts[:w] + seam, right.starts[r:] + len(left.text)]),
            np.concatenate([left.places[:keep], window.places[:w] + len(head), right.places[r:] + shift]),
            np.concatenate([head, middle, tail]),
        )

    def tree(self, text: str) -> Node:
        if len(text) <= self.leaf_chars:
            return self.leaf(text)
        middle = len(text) // 2
        return self.join(self.tree(text[:middle]), self.tree(text[middle:]))

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text; an empty and a null text both have none."""
        if not text:
            return np.empty(0, dtype=np.int32)
        if len(text) <= self.leaf_chars:  # a tree of one leaf
            return np.array(self._plain(text), dtype=np.int32)
        return self.tree(text).ids

    def decode(self, ids: list[int] | np.ndarray | None) -> str:
        """The text of ids: bytes are concatenated before they are read as text."""
        return self.encoding.decode_bytes([int(i) for i in ids]).decode("utf-8", errors="replace") if ids is not None and len(ids) else ""


def encoder(vocabulary: str | None = None, pattern: str | None = None, leaf_chars: int = LEAF_CHARS) -> TreeEncoder:
    """The encoder of a vocabulary.  ``AHEAD`` is proven for the installed tokenizers' pattern only, so any other is refused."""
    path, proven = default_vocabulary()
    if pattern not in (None, proven):
        raise ValueError("joins are not proven to be stable for this pattern")
    return TreeEncoder(vocabulary or path, proven, leaf_chars)


def encode_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, pattern: str | None = None, leaf_chars: int = LEAF_CHARS
) -> DataFrame:
    """``key`` and ``ids`` of each row, whole texts, without special tokens.

    A null and an empty text give an empty array; a text that looks like a special token is
    ordinary text.  Repeated rows stay repeated, a null key stays null, an empty table stays
    empty; other columns are not read.  ``vocabulary`` is the path of a .tiktoken file,
    ``pattern`` the pattern of its pieces.
    """
    small = spread(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = encoder(vocabulary, pattern, leaf_chars)
        for batch in batches:
            ids = [tree.encode(t) for t in batch.column(1).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            values = np.concatenate(ids) if ids else np.empty(0, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values, type=pa.int32()))], names=[key, "ids"])

    return small.mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, key: str = "doc_id", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """``key`` and ``text`` from ids; no ids give an empty text."""
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = encoder(vocabulary, pattern)
        for batch in batches:
            yield pd.DataFrame({key: batch["key"], "text": [tree.decode(x) for x in batch["ids"]]})

    return encoded.select(F.col(key).alias("key"), "ids").mapInPandas(run, f"`{key}` {kind}, text string")
