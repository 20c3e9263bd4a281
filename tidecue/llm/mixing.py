"""Mixing sources to target weights by Sainte-Laguë apportionment.

Every source is a stream of words: its documents in the order of a seeded hash. The stream is cut into
blocks of equally many words, the same number for all sources. The mix has a fixed number of block seats;
they go to the sources one by one by the highest quotient target / (2 j - 1), so each source gets a whole
number of blocks, and the order of the seats gives whole quotas for each output shard. A source with q
seats and b blocks takes its whole stream q div b times and then its first q mod b blocks; as the order of
the stream is seeded, that is a seeded selection. What a document gives is the overlap of its interval of
the stream with the selected blocks, so no block table is joined and nothing is ever exploded by word.

All of it is DataFrame operations. Prefix sums run inside small hash ranges of each source, with the sums of
the ranges before added, so one source with a third of all rows is spread over as many tasks as it has ranges.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecue.llm.common import materialize, table, text_or_empty, word_count

#: Weights repeat over the sources in code-point order, null last.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
N_BLOCKS = 65536
N_SHARDS = 16
SEED = "mix-1"
#: Documents in one hash range of a source, about; ranges are the unit of the prefix sums.
RANGE_ROWS = 2000


@dataclass(frozen=True)
class Mix:
    """documents: one row for each input row; sources: one for each source; quotas: blocks by shard and source."""

    documents: DataFrame
    sources: DataFrame
    quotas: DataFrame


def targets(sizes: DataFrame, *, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``source, source_size`` -> with weight and target words.

    Shares ``share`` times all words by weight; a target stops at ``cap`` times its source's words and the
    excess is shared by weight among the rest until none is above. That fixed point is found in one pass:
    in the order of cap / weight a source is capped if an equal level over it and all later ones reaches its cap.
    The number of sources is small against the documents (one row for each source here).
    """
    every = Window.partitionBy(F.lit(0))
    ordered = every.orderBy("ratio", "position")
    before, after = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(0, Window.unboundedFollowing)
    listed = sizes.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())))
    weighed = (
        listed.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("position") - 1) % len(weights) + 1).cast("int")).cast("double"))
        .withColumn("limit", F.col("source_size") * float(cap))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("all_words", F.sum("source_size").over(every) * float(share))
        .withColumn("spent", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(after))
        .withColumn("capped", (F.col("all_words") - F.col("spent")) * F.col("weight") >= F.col("limit") * F.col("left_weight"))
        .withColumn("rest", F.col("all_words") - F.sum(F.when(F.col("capped"), F.col("limit")).otherwise(0.0)).over(every))
        .withColumn("rest_weight", F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(every))
    )
    return weighed.select("source", "position", "source_size", "weight", F.when(F.col("capped"), F.col("limit")).otherwise(F.col("weight") * F.col("rest") / F.col("rest_weight")).alias("target"), "all_words")


def seats(aimed: DataFrame, *, n_blocks: int = N_BLOCKS, n_shards: int = N_SHARDS) -> DataFrame:
    """A row for each seat that a source gets, with the shard that it falls to.

    At most about 1.5 ``n_blocks`` rows and two for each source, whatever the size of the corpus.
    """
    total = F.col("all_words") / F.lit(float(SHARE))
    candidates = (
        aimed.withColumn("block", F.greatest(F.lit(1), F.ceil(total / n_blocks)).cast("long"))
        .withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
        .withColumn("n_seats", F.floor(F.col("all_words") / F.col("block") + 0.5).cast("long"))
        .withColumn("most", F.least(CAP * F.col("blocks"), F.floor(F.col("target") / F.col("block")).cast("long") + 2))
        .filter("most > 0")
        .withColumn("seat", F.explode(F.sequence(F.lit(1), F.col("most"))))
        .withColumn("quotient", F.col("target") / (2 * F.col("seat") - 1))
    )
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("quotient").desc(), "position", "seat"))
    return candidates.withColumn("rank", rank.cast("long")).filter("rank <= n_seats").withColumn("shard", F.expr(f"cast((rank - 1) * {n_shards} div n_seats as int)"))


def _hashed(name: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(name).cast("string"), F.lit(""))))


def mix(docs: DataFrame, *, seed: str = SEED, n_blocks: int = N_BLOCKS, n_shards: int = N_SHARDS, range_rows: int = RANGE_ROWS) -> Mix:
    """Which words of which documents the mix takes.

    ``docs`` has doc_id, text and source; other columns are left alone. documents: doc_id, source, size,
    source_size, target, taken, copies. ``taken`` counts words, repeats included. ``copies`` is how often the
    block with the document's first word is taken, for callers who want whole documents.

    A null or empty text has size 0 and gives nothing; null is a source of its own, the last one. Rows that
    are repeated count and are taken one by one; which of them gives the words of a cut block does not show.
    An empty table gives an empty mix. Texts are never cut by length.
    """
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(text_or_empty()).alias("size"), _hashed("doc_id", seed).alias("place"))
    base = materialize(sized, "mix-sizes")
    n_rows = base.count()
    digits = max(1, min(8, math.ceil(math.log(max(n_rows, 1) / range_rows, 16)) if n_rows > range_rows else 1))
    base = base.withColumn("range", F.substring("place", 1, digits))
    ranges = materialize(base.groupBy("source", "range").agg(F.sum("size").alias("words")), "mix-ranges")
    aimed = targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")))
    given = seats(aimed, n_blocks=n_blocks, n_shards=n_shards)
    quotas = given.groupBy("shard", "source").agg(F.count("*").alias("blocks"))
    won = given.groupBy("position").agg(F.count("*").alias("quota"), F.max("block").alias("block"), F.max("blocks").alias("blocks"))
    by_source = (
        aimed.join(won, "position", "left")
        .withColumn("quota", F.coalesce("quota", F.lit(0)))
        .withColumn("rounds", F.coalesce(F.expr("quota div blocks"), F.lit(0)))
        .withColumn("reach", F.coalesce(F.expr("(quota % blocks) * block"), F.lit(0)))
        .select("source", "source_size", "weight", "target", "quota", "rounds", "reach")
    )
    by_source = materialize(by_source, "mix-sources")
    offset = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranges.withColumn("offset", offset).alias("o").join(by_source.alias("s"), F.col("o.source").eqNullSafe(F.col("s.source"))).select(F.col("o.source").alias("r_source"), F.col("o.range").alias("r_range"), "offset", "source_size", "target", "rounds", "reach")
    inside = Window.partitionBy("source", "range").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    documents = (
        base.withColumn("upto", F.sum("size").over(inside))
        .join(offsets, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("range") == F.col("r_range")))
        .withColumn("start", F.col("offset") + F.col("upto") - F.col("size"))
        .withColumn("part", F.greatest(F.lit(0), F.least(F.col("start") + F.col("size"), F.col("reach")) - F.col("start")))
        .select(
            "doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target",
            (F.col("rounds") * F.col("size") + F.col("part")).cast("long").alias("taken"),
            (F.col("rounds") + F.when((F.col("size") > 0) & (F.col("start") < F.col("reach")), 1).otherwise(0)).cast("int").alias("copies"),
        )
    )
    return Mix(documents, by_source, quotas)


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """Whole documents of the mix: each row of ``docs`` as often (0, 1 or 2 times) as the block of its first word is taken.

    Rows without words have no block and are left out. Columns are as they were. Rows that share a doc_id, as
    repeated rows do, each find their own count: they are numbered by text within their doc_id.
    """
    order = Window.partitionBy("doc_id")
    taken = mix(docs, **options).documents.select("doc_id", "source", "size", "copies")
    taken = taken.withColumn("nth", F.row_number().over(order.orderBy("source", "size", "copies")))
    apart = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.col("source").cast("string").alias("source"), word_count(text_or_empty()).alias("size"))
    apart = apart.withColumn("nth", F.row_number().over(order.orderBy("source", "size", F.xxhash64("row.text"))))
    joined = apart.alias("a").join(taken.alias("t"), (F.col("a.doc_id").eqNullSafe(F.col("t.doc_id"))) & (F.col("a.nth") == F.col("t.nth")))
    return joined.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).documents.select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS place FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS position FROM s0),
s2 AS (SELECT *, [3.0, 1.0, 2.0][(position - 1) % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS lim,
    (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS all_words FROM s1),
s3 AS (SELECT *, coalesce(sum(lim) OVER (ORDER BY lim / weight, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
    sum(weight) OVER (ORDER BY lim / weight, position ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight FROM s2),
s4 AS (SELECT *, (all_words - spent) * weight >= lim * left_weight AS capped FROM s3),
s5 AS (SELECT *, all_words - sum(CASE WHEN capped THEN lim ELSE 0 END) OVER () AS rest,
    sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () AS rest_weight FROM s4),
aimed AS (SELECT source, position, source_size, CASE WHEN capped THEN lim ELSE weight * rest / rest_weight END AS target, all_words,
    greatest(1, ceil(all_words / 1.5 / {N_BLOCKS}))::BIGINT AS block FROM s5),
b AS (SELECT *, ceil(source_size::DOUBLE / block)::BIGINT AS blocks, floor(all_words / block + 0.5)::BIGINT AS n_seats FROM aimed),
c AS (SELECT *, unnest(range(1, least(2 * blocks, floor(target / block)::BIGINT + 2) + 1)) AS seat FROM b),
r AS (SELECT *, row_number() OVER (ORDER BY target / (2 * seat - 1) DESC, position, seat) AS rank FROM c),
won AS (SELECT position, count(*) AS quota FROM r WHERE rank <= n_seats GROUP BY position),
src AS (SELECT b.source, b.source_size, b.target, CASE WHEN blocks > 0 THEN coalesce(quota, 0) // blocks ELSE 0 END AS rounds,
    CASE WHEN blocks > 0 THEN (coalesce(quota, 0) % blocks) * block ELSE 0 END AS reach FROM b LEFT JOIN won USING (position)),
p AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start FROM d)
SELECT p.doc_id, p.size, src.source_size, src.target,
    (rounds * p.size + greatest(0, least(start + p.size, reach) - start))::BIGINT AS taken
FROM p JOIN src ON p.source IS NOT DISTINCT FROM src.source
"""
