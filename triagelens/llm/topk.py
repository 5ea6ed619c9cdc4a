"""Exact top-k inner products over a bit-sliced index.

Vectors are dealt into blocks. For each block and attribute the index keeps the binary
digits of the quantised values as bitmaps over the block's rows: slice j has a bit for
every row whose value has digit j. A query is answered on bitmaps alone: each
attribute's slices are multiplied by the query's value by shifts and bitmap additions,
the products of all attributes are added up to slices of the score, and the best k rows
are found from the most significant slice downward, keeping the rows that have the
digit as long as there are k of them. Rows still tied at the boundary have equal scores
and are taken by smallest id. Negative query values use the slices of the complement
(largest value of the attribute minus value), so only additions are needed; what that
shifts is the same for all rows of a block and is added back to the scores.

Blocks of vectors meet blocks of queries pair by pair, each pair is one group of
bounded size, and a query's best rows per block are merged at the end.

Defined results: vectors that are null or hold null or non-finite components take no
part; shorter vectors count as padded with zeros; equal rows of one id count once, and
a row is no candidate for a query of its own id; null ids take no part; fewer
candidates than k give all of them; an empty table gives an empty result. A score that
does not fit a long is an error.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelens.llm.common import written

SCALE = 64
TOP = 20
QUERY_EVERY = 20
BLOCK = 8192  # vectors, about
QUERIES = 1024  # queries that meet a block at once, about
BATCH = 32  # queries whose bitmaps are worked on together


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: usable vectors with floor(scale * component)."""
    x = F.col(vector_col)
    usable = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf))
    values = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return vectors.where(usable & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), values.alias("v")).distinct()


# ----------------------------------------------------------------------------- bitmaps


def packed(bits: np.ndarray, words: int) -> np.ndarray:
    """Rows of booleans as bitmaps of 64-bit words."""
    padded = np.zeros((*bits.shape[:-1], words * 64), dtype=np.uint8)
    padded[..., : bits.shape[-1]] = bits
    return np.packbits(padded, axis=-1, bitorder="little").view(np.uint64)


def sliced(values: np.ndarray) -> np.ndarray:
    """Non-negative values of one attribute as slices, least significant first."""
    digits = max(1, int(values.max()).bit_length())
    words = -(-len(values) // 64)
    return packed(np.stack([(values >> j) & 1 for j in range(digits)]), words)


def add_into(total: list[np.ndarray], term: list[np.ndarray], shift: int = 0) -> None:
    """Adds the number in slices ``term``, shifted, to the slices ``total`` in place."""
    carry = None
    j = shift
    while j < shift + len(term) or carry is not None:
        other = term[j - shift] if j < shift + len(term) else None
        if j >= len(total):
            first = other if other is not None else carry
            total.extend(np.zeros_like(first) for _ in range(j + 1 - len(total)))
        mine = total[j]
        if other is None:
            total[j], carry = mine ^ carry, mine & carry
        elif carry is None:
            total[j], carry = mine ^ other, mine & other
        else:
            half = mine ^ other
            total[j], carry = half ^ carry, (mine & other) | (half & carry)
        if other is None and not carry.any():
            break
        j += 1


def products(slices: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Slices of factor * value for each factor: (digits, factors, words)."""
    total: list[np.ndarray] = []
    for bit in range(int(factors.max()).bit_length()):
        mask = np.where((factors >> bit) & 1, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))[:, None]
        add_into(total, [s[None, :] & mask for s in slices], bit)
    if not total:
        total = [np.zeros((len(factors), slices.shape[1]), np.uint64)]
    while len(total) > 1 and not total[-1].any():
        total.pop()
    return np.stack(total)


def best_rows(score: list[np.ndarray], valid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the rows surely among its best k, and the rows tied for the rest."""
    sure, tied = np.zeros_like(valid), valid.copy()
    for digit in reversed(score):
        high = tied & digit
        count = np.bitwise_count(sure | high).sum(axis=1, dtype=np.int64)
        enough = (count >= k)[:, None]
        # With k or more the best are among the high ones; otherwise all high ones are.
        sure = np.where(enough, sure, sure | high)
        tied = np.where(enough, high, tied & ~digit)
    return sure, tied


class Index:
    """Bit-sliced index of one block of vectors, ordered by id."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, values = ids[order], values[order]
        self.low, self.high = values.min(axis=0), values.max(axis=0)
        self.up = [sliced(values[:, d] - self.low[d]) for d in range(values.shape[1])]
        self.down = [sliced(self.high[d] - values[:, d]) for d in range(values.shape[1])]
        self.words = self.up[0].shape[1]
        self.rows = packed(np.ones((1, len(ids)), np.uint8), self.words)[0]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple]:
        """``query_id, vec_id, score`` of the best ``k`` rows of the block for every query."""
        tables, picks = [], []
        for d in range(queries.shape[1]):
            column = queries[:, d]
            for slices, factors in ((self.up[d], np.maximum(column, 0)), (self.down[d], np.maximum(-column, 0))):
                distinct, pick = np.unique(factors, return_inverse=True)
                if distinct[-1] and slices.any():
                    tables.append(products(slices, distinct))
                    picks.append(pick)
        shift = np.where(queries >= 0, queries * self.low, queries * self.high).sum(axis=1)
        out: list[tuple] = []
        for begin in range(0, len(queries), BATCH):
            stop = min(begin + BATCH, len(queries))
            total: list[np.ndarray] = [np.zeros((stop - begin, self.words), np.uint64)]
            for table, pick in zip(tables, picks, strict=True):
                add_into(total, list(table[:, pick[begin:stop]]))
            out += self.pick(query_ids[begin:stop], shift[begin:stop], total, k)
        return out

    def pick(self, query_ids, shift, score, k) -> list[tuple]:
        valid = np.repeat(self.rows[None, :], len(query_ids), axis=0)
        own = np.searchsorted(self.ids, query_ids)
        for i, at in enumerate(own):
            while at < len(self.ids) and self.ids[at] == query_ids[i]:
                valid[i, at >> 6] &= ~(np.uint64(1) << np.uint64(at & 63))
                at += 1
        sure, tied = best_rows(score, valid, k)
        digits = np.stack(score)
        out = []
        for i, query_id in enumerate(query_ids):
            first = np.flatnonzero(np.unpackbits(sure[i].view(np.uint8), bitorder="little"))
            rest = np.flatnonzero(np.unpackbits(tied[i].view(np.uint8), bitorder="little"))
            at = np.concatenate([first, rest[: k - len(first)]])
            bits = (digits[:, i, at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            for row, column in zip(at, bits.T, strict=True):
                value = sum(int(b) << j for j, b in enumerate(column)) + int(shift[i])
                out.append((int(query_id), int(self.ids[row]), value))
        return out


# -------------------------------------------------------------------------------- jobs


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = TOP,
    block: int = BLOCK,
    group: int = QUERIES,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = SCALE,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest inner products of each query.

    ``is_query`` is a condition on ``vec_id``.
    """
    rows = written(quantised(vectors, id_col, vector_col, scale), "vectors")
    sizes = rows.agg(F.count("*"), F.count(F.when(is_query, 1)), F.max(F.size("v"))).first()
    width = sizes[2] or 1
    blocks, groups = max(1, -(-sizes[0] // block)), max(1, -(-sizes[1] // group))
    place = F.xxhash64("vec_id")
    blocked = rows.select("vec_id", "v", F.pmod(place, F.lit(blocks)).cast("int").alias("block"))
    candidates = blocked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    # Another hash than for blocks, so that a group's queries come from all blocks.
    queries = rows.where(is_query).select("vec_id", "v", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).cast("int").alias("part"))
    queries = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def matrix(frame: pd.DataFrame) -> np.ndarray:
        out = np.zeros((len(frame), width), np.int64)
        for i, v in enumerate(frame["v"]):
            out[i, : len(v)] = v
        return out

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            index = Index(left["vec_id"].to_numpy(), matrix(left))
            found = index.search(right["vec_id"].to_numpy(), matrix(right), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    best = (
        candidates.groupBy("block", "part")
        .cogroup(queries.groupBy("block", "part"))
        .applyInPandas(search, "query_id long, vec_id long, score long")
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
