"""Sharding by a K-d tree over numbers that describe a document.

The box of all documents is split again and again at a weighted median of bytes, along the dimension that is
widest in that box, until every leaf holds its share of the bytes. A median is found exactly by a radix search:
one aggregation over the next 13 bits of the ordering key for all boxes of a level at once; only the cuts
(one row for each box) ever reach the driver. The tree is then one conditional expression over the columns of
a document, so that no row is moved to learn its shard.

The dimensions are taken from the text alone, and ties along a dimension are ordered by the text's CRC, so equal
texts have equal keys and stay together. A group of equal texts is split (by a hash of doc_id) only if
leaving it whole would put a cut further off its median than ``slack`` shards' bytes: law ``bytes`` comes first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecue.llm.common import materialize, table, text_or_empty, tidy

N_SHARDS = 16
#: How far a cut may be off its median, as a share of one shard's bytes, to keep equal texts together.
SLACK = 0.005
#: Dimensions are whole numbers of so many bits.
DIM_BITS = 20
DIGIT_BITS = 13
RANGE_ROWS = 2000
DIMS = ("d_bytes", "d_wide", "d_lines", "d_words")


@dataclass(frozen=True)
class Cut:
    node: int
    dim: str
    key: int
    place: int
    left: int
    right: int


def _unit(x: Column) -> Column:
    return F.least(F.lit(float((1 << DIM_BITS) - 1)), F.greatest(F.lit(0.0), x * float(1 << DIM_BITS))).cast("long")


def described(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the dimensions: bytes (log scale), share of multi-byte text, lines and words by length."""
    text, size = text_or_empty(), F.octet_length(text_or_empty()).cast("long")
    chars = F.greatest(F.lit(1), F.char_length(text)).cast("double")
    return docs.select(
        "doc_id",
        (size + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        _unit(F.log2(size + 1.0) / 32).alias("d_bytes"),
        _unit((size - F.char_length(text)) / chars).alias("d_wide"),
        _unit((F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))) / chars * 8).alias("d_lines"),
        _unit((F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit("")))) / chars * 2).alias("d_words"),
        (F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 52) - 1))).alias("place"),
    )


def _node(cuts: list[Cut], at: int = 1) -> Column:
    """The box of a row after the cuts so far: one comparison for each level on a row's way down."""
    c = next((c for c in cuts if c.node == at), None)
    if c is None:
        return F.lit(at)
    key = _key(c.dim)
    beyond = (key > c.key) | ((key == c.key) & (F.col("place") > c.place))
    return F.when(beyond, _node(cuts, 2 * at + 1)).otherwise(_node(cuts, 2 * at))


def _by_node(values: dict[int, Column], default: Column) -> Column:
    """The value for the box in column node: a look-up in a short array, which names the column once."""
    top = max(values)
    return F.try_element_at(F.array(*(values.get(n, default) for n in range(1, top + 1))), F.col("node"))


def _key(dim: str) -> Column:
    return F.shiftleft(F.col(dim), 32) + F.col("text_crc32")


def _search(rows: DataFrame, column: str, bits: int, aims: dict[int, float]) -> dict[int, tuple[int, float, float]]:
    """For each box the least value whose running bytes reach the aim: (value, bytes before it, its bytes)."""
    found = {n: (0, 0.0, 0.0) for n in aims}
    shift = bits
    while shift > 0:
        shift = max(0, shift - DIGIT_BITS)
        prefix = _by_node({n: F.lit(value).cast("long") for n, (value, _, _) in found.items()}, F.lit(0).cast("long"))
        aim = _by_node({n: F.lit(float(aims[n] - before)) for n, (_, before, _) in found.items()}, F.lit(0.0))
        above = min(bits, shift + DIGIT_BITS)
        held = F.shiftright(F.col(column), above) == F.shiftright(prefix, above)
        by_digit = rows.filter(held).groupBy("node", F.shiftright(F.col(column), shift).alias("digit")).agg(F.sum("size").alias("bytes"))
        upto = F.sum("bytes").over(Window.partitionBy("node").orderBy("digit"))
        last = F.max("digit").over(Window.partitionBy("node"))
        reached = by_digit.withColumn("upto", upto).withColumn("last", last).filter((F.col("upto") >= aim) | (F.col("digit") == F.col("last")))
        for r in reached.groupBy("node").agg(F.min(F.struct("digit", "upto", "bytes")).alias("x")).collect():
            value, before, _ = found[r.node]
            found[r.node] = (r.x.digit << shift, before + r.x.upto - r.x.bytes, float(r.x.bytes))
    return found


def kd_tree(base: DataFrame, *, n_shards: int = N_SHARDS, slack: float = SLACK) -> tuple[list[Cut], dict[int, int]]:
    """The cuts, and the shard of each leaf."""
    total = base.agg(F.sum("size")).first()[0] or 0
    leaves, cuts, shards = {1: n_shards}, [], {}
    while any(k > 1 for k in leaves.values()):
        open_nodes = [n for n, k in leaves.items() if k > 1]
        placed = base.withColumn("node", _node(cuts)).filter(F.col("node").isin(open_nodes))
        seen = {r.node: r for r in placed.groupBy("node").agg(F.sum("size").alias("bytes"), *[(F.max(d) - F.min(d)).alias(d) for d in DIMS]).collect()}
        dim = {n: max(DIMS, key=lambda d: (seen[n][d], d == "d_bytes")) if n in seen else DIMS[0] for n in open_nodes}
        aims = {n: seen[n].bytes * (leaves[n] // 2) / leaves[n] for n in seen}
        if aims:
            widest = F.element_at(F.array(*map(_key, DIMS)), _by_node({n: F.lit(DIMS.index(dim[n]) + 1) for n in aims}, F.lit(1)))
            rows = placed.select("node", widest.alias("key"), "place", "size")
            at, within, ends = _search(rows, "key", DIM_BITS + 32, aims), {}, {}
            for n, (value, before, held) in at.items():
                if min(aims[n] - before, before + held - aims[n]) <= slack * total / n_shards:
                    ends[n] = (value, -1 if aims[n] - before <= before + held - aims[n] else 1 << 52)
                else:
                    within[n] = aims[n] - before
            if within:
                same = F.col("key") == _by_node({n: F.lit(at[n][0]).cast("long") for n in within}, F.lit(-1).cast("long"))
                for n, (place, before, held) in _search(rows.filter(same), "place", 52, within).items():
                    ends[n] = (at[n][0], place - (within[n] - before <= before + held - within[n]))
        for n in open_nodes:
            value, place = ends[n] if n in seen else (0, 0)
            cuts.append(Cut(n, dim[n], value, place, leaves[n] // 2, leaves[n] - leaves[n] // 2))
            leaves |= {2 * n: leaves[n] // 2, 2 * n + 1: leaves[n] - leaves[n] // 2}
            del leaves[n]
        tidy(base.sparkSession)  # a level is a dozen plans and writes no table
    for k, n in enumerate(sorted(leaves, key=lambda n: bin(n))):
        shards[n] = k
    return cuts, shards


def shard(docs: DataFrame, *, n_shards: int = N_SHARDS, slack: float = SLACK, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    A null text counts as empty (size 1). Repeated rows each get a slot of their own. An empty table gives no
    rows; with fewer rows than shards some shards stay empty. One row larger than a shard's share fills
    its shard alone as far as a cut can do that. Other columns of ``docs`` are not looked at.
    """
    base = materialize(described(docs), "shard-rows")
    cuts, shards = kd_tree(base, n_shards=n_shards, slack=slack)
    n_ranges = max(16, base.count() // (n_shards * range_rows))
    name = _by_node({n: F.lit(k) for n, k in shards.items()}, F.lit(0))
    placed = base.withColumn("node", _node(cuts)).select("doc_id", "size", "text_crc32", name.cast("int").alias("shard"), "place", F.pmod("place", F.lit(n_ranges)).cast("int").alias("range"))
    counts = placed.groupBy("shard", "range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("shard", "range").orderBy("place", "doc_id"))
    return (
        placed.withColumn("inside", inside)
        .join(counts.withColumn("before", before).select("shard", "range", "before"), ["shard", "range"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("inside") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def op5_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
