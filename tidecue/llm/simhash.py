"""SimHash near-duplicates, linked by a self-join of binary tries.

A fingerprint is one number for a whole text; texts with equal fingerprints are one leaf from the start. Two that
differ in at most ``budget`` bits agree on at least one of ``budget + 1`` bands of bits. So for each band the trie is read
with that band first, and only pairs of nodes below one and the same band node are traversed: both nodes
of a pair step down together, a step to different sides spends one bit of the budget, and a pair that has
spent more is pruned. Every link is found, and no row is sent to more than ``budget + 1`` places. Below
a band the sorted fingerprints are the trie: a node is a range of them. The traversal keeps pairs of nodes on a stack
of bounded slabs, and what it finds is reduced to a spanning forest at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecue.llm.common import materialize, table, text_or_empty
from tidecue.llm.components import components

SHINGLE = 3
BUDGET = 2
SEED = 42
BITS = 64
_BLOCK = 1 << 16
#: Pairs of nodes that are stepped down at once, and pairs of leaves below which a pair of nodes is compared directly.
_SLAB = 1 << 16
_DIRECT = 16


def bits_of(hashes: np.ndarray) -> int:
    """64 bits, each set if it is set in over half of the hashes; 0 without one."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), _BLOCK):
        ones += np.unpackbits(hashes[i : i + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << np.arange(BITS, dtype=np.uint64))[2 * ones > len(hashes)].sum(dtype=np.uint64))


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """``bits_of`` the shingles' hashes, repeats included; of all words if they are fewer, and 0 without a word."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words) - shingle + 1
    if not words:
        return 0
    if n < 2:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    grams = map(b" ".join, zip(*(words[k : n + k] for k in range(shingle)), strict=True))
    return bits_of(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, n))


def with_fingerprints(docs: DataFrame, *, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["doc_id", "fp"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def trie_links(keys: np.ndarray, depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of ``keys`` (sorted, distinct, equal above bit ``depth``) at ``budget`` or fewer differing bits."""
    stack = [(np.array([[0, len(keys), 0, len(keys)]], np.int64), np.zeros(1, np.int64), depth)]
    while stack:
        node, spent, bit = stack.pop()
        if len(node) > _SLAB:
            half = len(node) // 2
            stack += [(node[:half], spent[:half], bit), (node[half:], spent[half:], bit)]
            continue
        size = node[:, 1::2] - node[:, ::2]
        direct = (size[:, 0] * size[:, 1] <= _DIRECT) | (bit == 0)
        if direct.any():
            a, counts = node[direct], size[direct]
            total = counts[:, 0] * counts[:, 1]
            of = np.repeat(np.arange(len(a)), total)
            k = np.arange(len(of)) - np.repeat(np.cumsum(total) - total, total)
            i, j = a[of, 0] + k // counts[of, 1], a[of, 2] + k % counts[of, 1]
            near = (i < j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
            if near.any():
                yield i[near], j[near]
            node, spent = node[~direct], spent[~direct]
        if not len(node):
            continue
        bit -= 1
        one = np.uint64(1) << np.uint64(bit)
        high = ~((one << np.uint64(1)) - np.uint64(1)) if bit < BITS - 1 else np.uint64(0)
        cut = lambda lo, hi: np.clip(np.searchsorted(keys, (keys[lo] & high) | one), lo, hi)
        a0, a2, b0, b2 = node.T
        a1, b1 = cut(a0, a2), cut(b0, b2)
        apart = a0 != b0
        sides = [(a0, a1, b0, b1, spent, None), (a1, a2, b1, b2, spent, None), (a0, a1, b1, b2, spent + 1, None), (a1, a2, b0, b1, spent + 1, apart)]
        kept, costs = [], []
        for lo, hi, lo2, hi2, cost, test in sides:
            held = (lo < hi) & (lo2 < hi2) & (cost <= budget) & ((lo != lo2) | (hi - lo > 1))
            if test is not None:
                held &= test
            kept.append(np.stack([lo[held], hi[held], lo2[held], hi2[held]], axis=1))
            costs.append(cost[held])
        if sum(map(len, kept)):
            stack.append((np.concatenate(kept), np.concatenate(costs), bit))


class _Forest:
    """Least index of each class, as links come in."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        while True:
            a, b = root[i], root[j]
            open_links = a != b
            if not open_links.any():
                return
            i, j, a, b = i[open_links], j[open_links], a[open_links], b[open_links]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (hop := root[root]).tobytes() != root.tobytes():
                root[:] = hop

    def links(self) -> np.ndarray:
        return np.flatnonzero(self.root != np.arange(len(self.root)))


def bands(budget: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(lowest bit, bits) of each of budget + 1 bands that together are all bits."""
    edges = [bits * k // (budget + 1) for k in range(budget + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def near_links(prints: DataFrame, *, budget: int = BUDGET) -> DataFrame:
    """``fp`` (distinct) -> ``u, v``: a spanning forest of the links below each band node."""
    cut = bands(budget)
    banded = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("band"), F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << n) - 1)).alias("value")) for k, (low, n) in enumerate(cut)])).alias("at"))
    banded = banded.select("fp", "at.*").repartition("band", "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not got:
            return
        prints, band = (np.concatenate(x) for x in zip(*got, strict=True))
        for k, (low, n) in enumerate(cut):
            fp = np.unique(prints[band == k]).view(np.uint64)
            up = np.uint64((BITS - low - n) % BITS)  # turn the band to the top
            keys = np.sort((fp << up) | (fp >> np.uint64(BITS - int(up)))) if up else np.sort(fp)
            values = keys >> np.uint64(BITS - n)
            starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(keys) else np.zeros(0, np.int64)
            for lo, hi in zip(starts, np.r_[starts[1:], len(keys)], strict=True):
                if hi - lo < 2:
                    continue
                own, forest = keys[lo:hi], _Forest(hi - lo)
                for i, j in trie_links(own, BITS - n, budget):
                    forest.add(i, j)
                if len(i := forest.links()):
                    back = (own >> up) | (own << np.uint64(BITS - int(up))) if up else own
                    signed = back.view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(signed[i]), pa.array(signed[forest.root[i]])], names=["u", "v"])

    return banded.select("fp", "band").mapInArrow(run, "u long, v long")


def near_groups(docs: DataFrame, *, shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of ``docs``.

    component_id is the least doc_id that can be reached over links, the row's own included. A null or empty text
    has fingerprint zero and is linked like any other; repeated rows are rows of one group; a null doc_id is never a
    component_id unless a group has no other. Texts are read whole. An empty table gives no rows.
    """
    rows = materialize(with_fingerprints(docs, shingle=shingle), "fingerprints")
    leaves = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "leaves")
    roots = components(near_links(leaves.select("fp"), budget=budget))
    placed = leaves.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(placed.join(ids, "root").select("fp", "component_id"), "named")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
