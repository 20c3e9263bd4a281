"""Benchmark decontamination by latent semantic retrieval.

1. Passages of the corpus (every text, whole, in runs of ``STEP`` words) are counted for document frequencies.
2. The benchmark's passages become TF-IDF rows; a randomised SVD of them, whose products with the rows are computed
   where the rows are and summed, gives a latent space (its width is a parameter) that tells items apart.
3. Every window of two neighbouring runs of a text is projected and compared with all benchmark passages by cosine. A window
   whose words can't reach any item, by bounds on both thresholds that are sums over its words, is not projected.
4. Around a candidate window the longest common subsequence with the whole item is measured. Near-verbatim
   passages count at once; looser ones, paraphrases, only if the item's answer (its last sentence) is there too.

Items are handled in blocks of a fixed number, so what is sent to the tasks is bounded by a parameter: the words of
a block and one latent row for each of its words. Texts are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecue.llm.common import table, text_or_empty

#: Words in a run; a window is two runs, so any STEP + 1 words in a row lie in some window.
STEP = 16
RANK = 192
OVERSAMPLE = 16
COSINE = 0.4
#: A candidate window also holds this share of the passage, as its projection on the passage's latent row.
CONTAINS = 0.35
#: Share of an item's words in the common subsequence: verbatim, or a paraphrase if the answer is there.
VERBATIM = 0.8
PARAPHRASE = 0.55
ANSWER = 0.5
#: Share of a passage's words, for passages of items that are longer.
WHOLE = 0.95
ITEMS_IN_BLOCK = 4096
_EDGE = ".,;:!?\"'()[]{}«»“”„¿¡…*_#$%&|"
_CACHE = 100_000
#: Texts whose words, and windows whose projections, are held at once.
SLICE = 512
WINDOWS = 1024


#: White space beyond ASCII, and letters of scripts that are written without it, each of which is a word.
_WIDE = "[\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_SINGLE = "([\\x{3041}-\\x{30ff}\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{ac00}-\\x{d7a3}])"


def spaced(texts: pa.Array) -> pa.Array:
    """The texts with one kind of white space between words; the only place that decides what a word is, for items and documents alike."""
    if pc.any(pc.match_substring_regex(texts, _WIDE)).as_py():
        texts = pc.replace_substring_regex(texts, _WIDE, " ")
    if pc.any(pc.match_substring_regex(texts, _SINGLE)).as_py():
        texts = pc.replace_substring_regex(texts, _SINGLE, r" \1 ")
    return texts


def terms(text: str) -> list[str]:
    """Lower-case words without marks at their edges; words of marks only are none."""
    words = pc.ascii_split_whitespace(spaced(pa.array([text], pa.string())))[0].as_py()
    return [w for w in (x.lower().strip(_EDGE) for x in words) if w]


@dataclass
class Item:
    item_id: object
    words: np.ndarray
    answer: np.ndarray


@dataclass
class Block:
    """A block of items over its own vocabulary. ``passages``: (item, term ids); the rest is set by ``fit``."""

    vocabulary: dict[str, int]
    items: list[Item]
    passages: list[tuple[int, np.ndarray]]
    idf: np.ndarray = field(default_factory=lambda: np.zeros(0))
    basis: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    queries: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    norms: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    floor: float = 0.0
    weighted: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    reach: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))


def block_of(rows: list[tuple[object, str]]) -> Block:
    """The items that have words; long ones become several passages of two runs each, stepping by one run."""
    vocabulary: dict[str, int] = {}
    items, passages = [], []
    for item_id, text in rows:
        ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in terms(text or "")], np.int32)
        if not len(ids):
            continue
        sentences = [s for s in (terms(x) for x in re.split(r"(?<=[.!?])\s+|\n", text or "")) if s]
        items.append(Item(item_id, ids, np.array([vocabulary[w] for w in sentences[-1]], np.int32)))
        for at in range(0, max(1, len(ids) - STEP), 2 * STEP):
            passages.append((len(items) - 1, ids[at : at + 4 * STEP]))
    return Block(vocabulary, items, passages)


class _Ids(dict):
    """Term ids of words as they stand in a text; -1 for words that no item has. Words of marks only are -2."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        if len(self) > _CACHE:
            self.clear()
        w = word.lower().strip(_EDGE)
        self[word] = n = self.vocabulary.get(w, -1) if w else -2
        return n


_IDS: dict[int, tuple[dict, _Ids]] = {}


def _ids_of(texts: pa.Array, vocabulary: dict[str, int]) -> Iterator[np.ndarray]:
    """The term ids of each text; a word that stands in many of them is looked up once."""
    kept = _IDS.get(id(vocabulary))
    if kept is None or kept[0] is not vocabulary:
        _IDS.clear()
        kept = _IDS[id(vocabulary)] = (vocabulary, _Ids(vocabulary))
    for first in range(0, len(texts), SLICE):
        words = pc.ascii_split_whitespace(spaced(texts.slice(first, SLICE)))
        coded = words.flatten().dictionary_encode()
        ids = np.fromiter(map(kept[1].__getitem__, coded.dictionary.to_numpy(zero_copy_only=False)), np.int32, len(coded.dictionary))[coded.indices.to_numpy()]
        at = words.offsets.to_numpy()
        for lo, hi in zip(at[:-1] - at[0], at[1:] - at[0], strict=True):
            own = ids[lo:hi]
            yield own[own != -2]


def _terms_by_run(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Run and term of each known term, once for each run that holds it, in order; and the number of runs."""
    runs = -(-len(ids) // STEP)
    grid = np.full(runs * STEP, -1, np.int32)
    grid[: len(ids)] = ids
    grid = np.sort(grid.reshape(runs, STEP), axis=1)
    keep = grid >= 0
    keep[:, 1:] &= grid[:, 1:] != grid[:, :-1]
    return np.nonzero(keep)[0], grid[keep], runs


def passage_counts(docs: DataFrame, block: Block) -> tuple[np.ndarray, int]:
    """For each term the runs of the corpus that hold it, and the number of runs. All texts count, whole."""
    sent = docs.sparkSession.sparkContext.broadcast(block.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        held, total = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            for ids in _ids_of(batch.column(0), vocabulary):
                _, term, runs = _terms_by_run(ids)
                total += runs
                held += np.bincount(term, minlength=len(vocabulary))
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[some, -1]), pa.array(np.r_[held[some], total])], names=["term", "n"])

    counts, total = np.zeros(len(block.vocabulary), np.int64), 0
    for r in docs.select(text_or_empty().alias("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        if r.term < 0:
            total = r.n
        else:
            counts[r.term] = r.n
    return counts, total


def _row(ids: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    where, tf = np.unique(ids, return_counts=True)
    return where, tf * idf[where]


def fit(spark: SparkSession, block: Block, counts: np.ndarray, total: int, *, rank: int = RANK, seed: int = 1) -> Block:
    """The latent space: a randomised SVD of the passages' TF-IDF rows.

    Tasks hold the rows; each multiplies its own rows with the sketch and the products (terms x sketch) are summed
    down a tree, twice (range, then the projected Gram matrix); only matrices of the block's size reach the driver.
    """
    block.idf = np.log((total + 1) / (counts + 0.5)).clip(0.1)
    d, width = len(block.vocabulary), min(rank + OVERSAMPLE, len(block.passages), len(block.vocabulary))
    rows = spark.sparkContext.parallelize([_row(ids, block.idf) for _, ids in block.passages], max(1, min(8, len(block.passages) // 512)))

    def gram(sketch: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(sketch)

        def part(own: Iterator) -> Iterator[np.ndarray]:
            out = np.zeros((d, sketch.shape[1]))
            for where, x in own:
                out[where] += np.outer(x, x @ sent.value[where])
            yield out

        return rows.mapPartitions(part).treeReduce(np.add)

    q = np.linalg.qr(gram(np.linalg.qr(gram(np.random.default_rng(seed).standard_normal((d, width))))[0]))[0]
    values, vectors = np.linalg.eigh(q.T @ gram(q))
    block.basis = np.ascontiguousarray((q @ vectors[:, ::-1])[:, : min(rank, width)].astype(np.float32))
    rows_of = [_row(ids, block.idf) for _, ids in block.passages]
    latent = np.stack([x.astype(np.float32) @ block.basis[where] for where, x in rows_of])
    block.norms = np.linalg.norm(latent, axis=1).clip(1e-9)
    block.queries = np.ascontiguousarray((latent / block.norms[:, None]).T)
    block.floor = float(min((x**2).sum() for _, x in rows_of))
    block.weighted = block.basis * block.idf.astype(np.float32)[:, None]
    block.reach = reach(block)
    return block


def reach(block: Block) -> np.ndarray:
    """For each term the most that one unit of it adds to a projection on any passage's row, as a share of that row's length.

    Summed over a window's terms it is at least the share that ``CONTAINS`` asks for, so a smaller sum rules the window out.
    """
    rows = block.queries / block.norms
    parts = [(block.basis[i : i + 1024] @ rows).max(axis=1) for i in range(0, len(block.basis), 1024)]
    return np.concatenate(parts).clip(0)


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, one machine operation on len(a) bits for each element of b."""
    masks: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b.tolist():
        if m := masks.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def search(text: str, block: Block, *, cosine: float = COSINE) -> list[tuple[int, float, float, float]]:
    """(item, cosine, share of the item's words, share of its answer) for each item that the text leaks."""
    return search_ids(next(_ids_of(pa.array([text]), block.vocabulary)), block, cosine=cosine)


def search_ids(ids: np.ndarray, block: Block, *, cosine: float = COSINE) -> list[tuple[int, float, float, float]]:
    """``search`` of a text whose term ids are known."""
    # a term counts once in each run, so repeated words don't make a window look like an item
    run, term, runs = _terms_by_run(ids)
    if not len(run):
        return []
    w = block.idf[term].astype(np.float32)
    energy = np.bincount(run, w.astype(np.float64) ** 2, minlength=runs + 1)
    most = np.bincount(run, w * block.reach[term], minlength=runs + 1)
    # a little below the thresholds, so that rounding rules nothing out
    open_windows = np.flatnonzero((2 * (energy[:-1] + energy[1:]) >= cosine**2 * block.floor) & (most[:-1] + most[1:] >= 0.999 * CONTAINS))
    if not len(open_windows):
        return []
    found: dict[int, list[tuple[int, float, int]]] = {}
    for first in range(0, len(open_windows), WINDOWS):
        own = open_windows[first : first + WINDOWS]
        used = np.unique(np.r_[own, own + 1])
        begins, ends = np.searchsorted(run, used), np.searchsorted(run, used, side="right")
        sizes = ends - begins
        rows = np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        latent = np.zeros((len(used), block.basis.shape[1]), np.float32)
        held = sizes > 0
        latent[held] = np.add.reduceat(block.weighted.take(term[rows], axis=0), (np.cumsum(sizes) - sizes)[held], axis=0)
        rows_of = latent[np.searchsorted(used, own)] + latent[np.searchsorted(used, own + 1)]
        along = rows_of @ block.queries
        lengths = np.linalg.norm(rows_of, axis=1).clip(1e-6)
        for i, j in zip(*np.nonzero(along >= CONTAINS * block.norms), strict=True):
            if (score := float(along[i, j] / lengths[i])) >= cosine:
                found.setdefault(block.passages[j][0], []).append((int(own[i]), score, int(j)))
    out = []
    for k, windows in sorted(found.items()):
        item = block.items[k]
        best, seen, quoted = (0.0, 0.0), -1, False
        for r, _, j in sorted(windows):
            passage = block.passages[j][1]
            if len(passage) < len(item.words):  # a passage of a long item counts as well, word for word
                region = ids[max(0, r * STEP - len(passage)) : (r + 2) * STEP + len(passage)]
                if lcs(passage, region) >= WHOLE * len(passage):
                    quoted = True
                    break
            lo, hi = r * STEP - len(item.words), (r + 2) * STEP + len(item.words)
            if r <= seen:
                continue
            seen = r
            region = ids[max(0, lo) : hi]
            inside = set(region.tolist())
            if sum(w in inside for w in item.words.tolist()) < PARAPHRASE * len(item.words):
                continue  # no common subsequence can be long enough
            best = max(best, (lcs(item.words, region) / len(item.words), lcs(item.answer, region) / len(item.answer)))
            if best[0] == 1.0:
                break
        if quoted or best[0] >= VERBATIM or (best[0] >= PARAPHRASE and best[1] >= ANSWER):
            out.append((k, max(s for _, s, _ in windows), *best))
    return out


def blocks(docs: DataFrame, benchmark: DataFrame, *, size: int = ITEMS_IN_BLOCK) -> Iterator[Block]:
    """The benchmark's items in blocks that are fitted to the corpus; null and empty items are left out."""
    named = benchmark.filter("text is not null").select("item_id", "text")
    n = -(-named.count() // size)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, n)))
    for k in range(n):
        rows = sorted(((r.item_id, r.text) for r in named.filter(part == k).collect()), key=str)
        block = block_of(rows)
        if block.items:
            yield fit(docs.sparkSession, block, *passage_counts(docs, block))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share, answer_share: a row for each item that a row of ``docs`` leaks.

    Rows without a leak don't appear. A null or empty text leaks nothing, repeated rows each give their own
    rows, an empty benchmark or corpus gives none. Long texts are searched whole.
    """
    spark = docs.sparkSession
    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, cosine double, lcs_share double, answer_share double"
    out = spark.createDataFrame([], schema)
    for block in blocks(docs, benchmark):
        sent = spark.sparkContext.broadcast(block)
        out = out.union(docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(_searcher(sent, kinds, schema), schema))
    return out


def _searcher(sent, kinds: tuple[str, str], schema: str) -> Callable:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    types = [to_arrow_type(f.dataType) for f in _parse_datatype_string(schema)]
    names = ["doc_id", "item_id", "cosine", "lcs_share", "answer_share"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        for batch in batches:
            rows = [(d, block.items[k].item_id, round(c, 4), x, y) for d, ids in zip(batch.column(0).to_pylist(), _ids_of(batch.column(1), block.vocabulary), strict=True) for k, c, x, y in search_ids(ids, block)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return run


def leaking(text: Column, block) -> Column:
    """Whether a text leaks an item of a block that is sent to the tasks."""

    def run(texts: pd.Series) -> pd.Series:
        ids = _ids_of(pa.array(texts, pa.string()), block.value.vocabulary)
        return pd.Series([bool(search_ids(x, block.value)) for x in ids], dtype=bool)

    return F.pandas_udf(run, "boolean")(text)


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that leak no item, all columns as they were; nothing is shuffled."""
    out = docs
    for block in blocks(docs, benchmark):
        out = out.filter(~leaking(text_or_empty(), docs.sparkSession.sparkContext.broadcast(block)))
    return out


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
