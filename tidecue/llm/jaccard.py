"""The near-dedup stage: one row stays of each group of texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from two searches. Texts whose SimHash fingerprints (``simhash``, here of five-word shingles) are linked by the
trie self-join are one; but at a similarity of 0.8 two fingerprints differ in about 10 of 64 bits, up to 18, and a trie that
spends 18 bits compares nearly all pairs. So texts that agree on a band of a MinHash are the other: at 0.8, 36 bands of 6
miss one pair in 50,000. Every link is confirmed on the sets of shingles themselves.

Texts with one set are one vertex from the start. A shingle that no other candidate holds can't be shared, so what a set has of
others bounds its similarity with any of them: a candidate with over a fifth of its own alone has no link, and no pair is
looked at whose bound is below the threshold. Each member of a bucket is compared with the bucket's center first, the one with the
least of its own; of the other pairs only those whose ends are not yet in one group are compared, and found by what either has to
share beyond the center (``open_pairs``). So a large group of near copies costs a row for each member and band, and for each of the
rarest shingles that a member has beside its center; no pair that could join two groups is left out. Hot buckets and vertices are salted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecue.llm.common import materialize, text_or_empty
from tidecue.llm.components import components
from tidecue.llm.simhash import SEED, bits_of, near_links

SHINGLE = 5
#: Linked from a similarity of 4 / 5 on, in whole numbers so that the edge itself counts.
OVER, UNDER = 4, 5
BANDS, DEPTH = 36, 6
#: Bits that linked fingerprints may differ by.
BUDGET = 3
#: Texts that are read into sets together.
SLICE = 512
SALTS = 16
#: Sizes of one class differ by this factor at most, about.
STEP = 1.03
#: Pairs of one vertex that are compared in one place.
_PAIRS = 64
_BLOCK = 2048
_DRAW = np.random.default_rng(SEED).integers(0, 1 << 32, (2, BANDS * DEPTH), np.uint32)
_XOR, _ODD = _DRAW[0], _DRAW[1] | np.uint32(1)


def all_shingles(text: str) -> np.ndarray:
    """The 64-bit hash of each of the text's shingles; of all words if they are fewer, and none without a word."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    grams = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False))
    return np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, len(words) - SHINGLE + 1)


def shingles(text: str) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    return np.unique(all_shingles(text))


def vertex(hashes: np.ndarray) -> int:
    """The set as one number."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def buckets(hashes: np.ndarray) -> np.ndarray:
    """A number for each band of the set's MinHash."""
    least = np.full(BANDS * DEPTH, np.iinfo(np.uint32).max, np.uint32)
    low = hashes.astype(np.uint32)
    for i in range(0, len(low), _BLOCK):
        x = low[i : i + _BLOCK, None] ^ _XOR
        x *= _ODD
        np.minimum(least, x.min(axis=0), out=least)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(least.reshape(BANDS, DEPTH))], np.uint64).view(np.int64)


def row_keys(docs: DataFrame) -> list[Column]:
    """Two 64-bit hashes of the whole row, which name it: rows with one name are one and the same."""
    columns = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if f.dataType.typeName() in ("map", "variant") else F.col(f"`{f.name}`") for f in docs.schema]
    return [F.xxhash64(F.lit(k), *columns).alias(f"k{k}") for k in (1, 2)]


def _named(docs: DataFrame, *columns: Column | str) -> DataFrame:
    """k1, k2 and ``columns``; other columns of ``docs`` can't clash with them."""
    return docs.select(*row_keys(docs), *columns)


def _with_buckets(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), SLICE):
                batch = whole.slice(at, SLICE)
                every = [all_shingles(x.as_py()) for x in batch.column(3)]
                prints = pa.array(np.array([bits_of(x) for x in every], np.uint64).view(np.int64))
                sets = [np.unique(x) for x in every]
                columns = [pa.array([vertex(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), prints, pa.array([buckets(s) for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["doc_id", "k1", "k2", "v", "n", "fp", "keys"])

    return docs.select("doc_id", *row_keys(docs), text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, k1 long, k2 long, v long, n long, fp long, keys array<long>")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """v and the packed shingles of each of ``wanted`` (v, k1, k2), read from the text of the row of that name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for v, text in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([v.as_py()], pa.int64()), pa.array([shingles(text.as_py()).tobytes()], pa.binary())], names=["v", "hashes"])

    # a row that is repeated often lies in many partitions of the input, and is spread by them
    texts = _named(docs, text_or_empty().alias("text"), F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"))
    found = texts.join(wanted.select("*", _salts()).hint("merge"), ["k1", "k2", "salt"]).groupBy("v").agg(F.min("text").alias("text"))
    return found.select("v", "text").mapInArrow(run, "v long, hashes binary")


def _salt(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int").alias("salt")


def _salts() -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")


def _attached(pairs: DataFrame, side: str, sets: DataFrame) -> DataFrame:
    """``pairs`` with the shingles of the vertex in column ``side``, in several places where it has many pairs."""
    parts = pairs.groupBy(F.col(side).alias("v")).agg(F.ceil(F.count("*") / _PAIRS).cast("int").alias("parts"))
    dealt = pairs.withColumn("salt", _salt("a", "b")).join(parts.select(F.col("v").alias(side), "parts", _salts()).hint("merge"), [side, "salt"])
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("b", "a"), F.col("parts")).cast("int")).drop("salt", "parts")
    placed = sets.join(parts.hint("merge"), "v").select(F.col("v").alias(side), F.col("hashes").alias(f"of_{side}"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return dealt.join(placed.hint("merge"), [side, "part"]).drop("part")


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The distinct ``pairs`` (a, b) with the sizes of their sets (n, m) and of what they share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            sizes = [[len(x) for x, _ in held], [len(y) for _, y in held], [len(np.intersect1d(x, y, assume_unique=True)) for x, y in held]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, pa.int64()) for c in sizes)], names=["a", "b", "n", "m", "both"])

    sided = _attached(_attached(pairs, "a", sets), "b", sets).select("a", "b", "of_a", "of_b")
    return materialize(sided.mapInArrow(run, "a long, b long, n long, m long, both long"), "overlaps")


def _links(overlaps: DataFrame) -> DataFrame:
    similar = UNDER * F.col("both") >= OVER * (F.col("n") + F.col("m") - F.col("both"))
    return overlaps.filter(similar).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _outside(around: DataFrame, sets: DataFrame) -> DataFrame:
    """center, v, n, both, root, size, h: the ``size`` shingles of each row of ``around`` that the center lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["center", "v", "n", "both", "root"]
        for batch in batches:
            for *row, x, y in zip(*(batch.column(i).to_pylist() for i in range(5)), batch.column(5), batch.column(6), strict=True):
                own = np.setdiff1d(np.frombuffer(x.as_py(), np.int64), np.frombuffer(y.as_py(), np.int64), assume_unique=True)
                if len(own):
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(own), x)) for x in (*row, len(own))), pa.array(own)], names=[*names, "size", "h"])

    pairs = around.select(F.col("v").alias("a"), F.col("center").alias("b"), "n", "both", "root")
    sided = _attached(_attached(pairs, "a", sets), "b", sets).select("b", "a", "n", "both", "root", "of_a", "of_b")
    return materialize(sided.mapInArrow(run, "center long, v long, n long, both long, root long, size long, h long"), "outside")


def _around(to_centers: DataFrame, roots: DataFrame) -> DataFrame:
    """center, v, n, both, root, apart: the members of centers whose members are not all in one group; ``apart`` from the center's."""
    of = lambda side, name: roots.select(F.col("v").alias(side), F.col("root").alias(name))
    named = to_centers.select(F.col("a").alias("v"), F.col("b").alias("center"), "n", "both").join(of("v", "root").hint("merge"), "v", "left")
    own = F.coalesce("root", "v")
    named = named.select("center", "v", "n", "both", own.alias("root")).join(of("center", "of_center").hint("merge"), "center", "left")
    named = named.withColumn("apart", F.col("root") != F.coalesce("of_center", "center")).drop("of_center")
    mixed = named.groupBy("center").agg(F.count("*").alias("times"), F.min("root").alias("least"), F.max("root").alias("most")).filter("times > 1 and least <> most").select("center")
    return materialize(named.join(mixed.hint("merge"), "center", "left_semi"), "around")


def _class(n: Column) -> Column:
    return F.floor(F.log(n) / float(np.log(STEP))).cast("int")


def _least_of(k: Column) -> Column:
    """No size of class ``k`` is below this."""
    return F.floor(F.pow(F.lit(STEP), k) * (1 - 1e-9))


def _classes(n: Column, most: Column) -> Column:
    """The classes of sizes from the least that can be similar to ``n`` up to ``most``, one row for each."""
    return F.explode(F.sequence(_class(_small(n)), _class(most)))


def _small(n: Column) -> Column:
    return F.ceil(n * OVER / UNDER)


def _needed(n: Column, m: Column) -> Column:
    """What sets of ``n`` and ``m`` shingles share at least if they are similar."""
    return F.ceil((n + m) * OVER / (OVER + UNDER))


def open_pairs(around: DataFrame, sets: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) around one center (``_around``) of different groups that may be similar.

    A pair shares at most the lesser of what both share with the center, and what both hold outside of it. Where the first is enough,
    both are smaller than the center or nearly so, and sizes find the pair. Else it needs a number of shingles outside. With
    those of every member in one order, the rarest around the center first, the first that a pair shares leaves that number in both
    (a prefix filter). Sizes are dealt into classes, so that what a pair needs is known before it is formed: the smaller is in its own
    class and the larger in each class that it can meet, either with its prefix only.
    """
    n, m, both, d, k = (F.col(x) for x in ("n", "m", "both", "d", "k"))
    other = [F.col(x).alias(y) for x, y in (("v", "w"), ("n", "m"), ("both", "d"), ("root", "other"))]
    lowest = lambda k, n: F.greatest(_least_of(k), _small(n))
    far = F.expr("root <> other") & (UNDER * F.least(n, m) >= OVER * F.greatest(n, m))
    pair = [F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b")]

    largest = F.floor(n * UNDER / OVER)
    one = around.filter("apart and n > 0").select("center", "v", "n", "both", "root", _class(n).alias("k"), _classes(n, largest).alias("l"))
    two = around.filter("n > 0").select("center", "v", "n", "both", "root", _class(n).alias("l"), _classes(n, largest).alias("k"))
    one, two = one.filter(both >= _needed(n, lowest(F.col("l"), n))), two.filter(both >= _needed(n, lowest(k, n)))
    inner = one.join(two.select("center", "k", "l", *other).hint("merge"), ["center", "k", "l"]).filter(far & (F.least(both, d) >= _needed(n, m)))

    outside = _outside(around, sets)
    holders = outside.groupBy("center", "h").agg(F.count("*").alias("times"), (F.min("root") != F.max("root")).alias("several"))
    order = Window.partitionBy("center", "v").orderBy("times", "h")
    ranked = outside.join(holders.hint("merge"), ["center", "h"]).withColumn("left", F.col("size") - F.row_number().over(order) + 1)
    ranked = materialize(ranked.filter("several").select("center", "h", "v", "n", "both", "root", "left"), "ranked")
    within = lambda n, m, both: F.greatest(_needed(n, m) - both, F.lit(1))
    less = ranked.withColumn("k", _class(n)).filter(F.col("left") >= within(n, n, both))
    more = ranked.withColumn("k", _classes(n, n)).filter(F.col("left") >= within(n, lowest(k, n), both))
    met = less.join(more.select("center", "h", "k", *other, F.col("left").alias("too")).hint("merge"), ["center", "h", "k"])
    outer = met.filter(far & F.expr("n < m or (n = m and v < w)") & (F.least("left", "too") >= within(n, m, F.least(both, d))))
    return inner.select(*pair).union(outer.select(*pair)).distinct()


def shared_counts(sets: DataFrame) -> DataFrame:
    """v and c: how many of its shingles another of ``sets`` holds as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for v, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(x.as_py(), np.int64)
                for i in range(0, len(own), 1 << 16):
                    part = own[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), v)), pa.array(part)], names=["v", "h"])

    held = sets.select("v", "hashes").mapInArrow(run, "v long, h long").groupBy("h").agg(F.min("v").alias("v"), F.count("*").alias("times"))
    alone = held.filter("times = 1").groupBy("v").agg(F.count("*").alias("alone"))
    return sets.select("v", (F.octet_length("hashes") / 8).cast("long").alias("n")).join(alone.hint("merge"), "v", "left").select("v", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("c"))


def _allowed(n: Column, c: Column, m: Column, d: Column) -> Column:
    """Whether sets of ``n`` and ``m`` shingles, ``c`` and ``d`` of them shared with any other, can be similar."""
    return (UNDER * F.least(n, m) >= OVER * F.greatest(n, m)) & ((OVER + UNDER) * F.least(c, d) >= OVER * (n + m))


def _by_prints(vertices: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of the trie self-join: vertices of one fingerprint, and the least ones of linked fingerprints."""
    leaves = vertices.groupBy("fp").agg(F.min("v").alias("first"), F.count("*").alias("size"))
    own = vertices.select("v", "fp").join(leaves.filter("size > 1").select("fp", "first").hint("merge"), "fp").filter("v <> first").select(F.col("v").alias("a"), F.col("first").alias("b"))
    found = near_links(leaves.select("fp"), budget=BUDGET)
    of = lambda side, name: leaves.select(F.col("fp").alias(side), F.col("first").alias(name))
    return own.union(found.join(of("u", "a").hint("merge"), "u").join(of("v", "b").hint("merge"), "v").select("a", "b"))


def kept_rows(docs: DataFrame) -> DataFrame:
    """k1, k2: the name of one row of each group, the least doc_id's (null is last, then the least name).

    Texts without a word are equal sets and so one group. Texts are read whole. An empty table gives no rows.
    """
    rows = materialize(_with_buckets(docs), "sets")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "k1", "k2")).alias("least")
    vertices = materialize(rows.groupBy("v").agg(least, F.any_value("n").alias("n"), F.any_value("fp").alias("fp"), F.any_value("keys").alias("keys")), "vertices")
    entries = vertices.select("v", F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").select("key", _salts())
    found = materialize(entries.withColumn("salt", _salt("v")).join(shared.hint("merge"), ["key", "salt"]).select("key", "v"), "buckets")
    by_prints = materialize(_by_prints(vertices), "print-pairs")  # used three times
    used = found.select("v").union(by_prints.select("a")).union(by_prints.select("b")).distinct()
    sets = materialize(_sets(docs, vertices.select("v", "least.k1", "least.k2").join(used.hint("merge"), "v", "left_semi")), "shingles")
    alive = materialize(shared_counts(sets).filter(F.col("c") * UNDER >= F.col("n") * OVER), "candidates")
    sets = sets.join(alive.select("v").hint("merge"), "v", "left_semi")
    members = found.join(alive.hint("merge"), "v").select("key", "v", "n", "c")
    center = F.max_by(F.struct("v", "n", "c"), F.struct(F.col("c") / F.col("n"), -F.col("v"))).alias("first")
    centers = members.groupBy("key").agg(center, F.count("*").alias("size")).filter("size > 1").select("key", "first", _salts())
    members = members.withColumn("salt", _salt("v")).join(centers.hint("merge"), ["key", "salt"]).select("v", "first")
    stars = materialize(members.filter("v <> first.v").select(F.col("v").alias("a"), F.col("first.v").alias("b")).distinct(), "stars-of-buckets")
    to_centers = _overlaps(stars, sets)
    of = lambda side, n, c: alive.withColumnsRenamed({"v": side, "n": n, "c": c})
    checked = by_prints.join(of("a", "n", "c").hint("merge"), "a").join(of("b", "m", "d").hint("merge"), "b").filter(_allowed(*map(F.col, "ncmd"))).select("a", "b").distinct()
    links = _links(to_centers).union(_links(_overlaps(checked, sets)))
    # What can still join two groups: pairs around one center that the links so far leave in different groups.
    roots = materialize(components(links).withColumnRenamed("u", "v"), "roots")
    around = _around(to_centers, roots)
    met = _links(_overlaps(materialize(open_pairs(around, sets), "pairs"), sets))
    of = lambda side: roots.select(F.col("v").alias(side), F.col("root").alias(f"root_{side}"))
    joined = met.join(of("u").hint("merge"), "u", "left").join(of("v").hint("merge"), "v", "left")
    again = components(joined.select(F.coalesce("root_u", "u").alias("u"), F.coalesce("root_v", "v").alias("v"))).select(F.col("u").alias("root"), F.col("root").alias("top"))
    placed = vertices.select("v", "least").join(roots.hint("merge"), "v", "left").withColumn("root", F.coalesce("root", "v")).join(again.hint("merge"), "root", "left")
    return placed.groupBy(F.coalesce("top", "root").alias("root")).agg(F.min("least").alias("least")).select("least.k1", "least.k2")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, all columns as they were.

    A group is a group of rows, not of doc_ids: rows that share a doc_id but not their text are looked at one by one, rows
    without a doc_id too; of rows that are the same in all columns one stays. A null text is an empty one.
    """
    kept = materialize(kept_rows(docs), "kept")
    apart = _named(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    # repeated rows are taken together before they are sent anywhere
    return apart.groupBy("k1", "k2").agg(F.first("row").alias("row")).join(kept.hint("merge"), ["k1", "k2"], "left_semi").select("row.*")
