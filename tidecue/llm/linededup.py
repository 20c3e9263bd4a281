"""Line dedup of whole repeated runs of lines.

Chunks that a rolling hash cuts (``chunks``) miss a repeated passage that doesn't hold two of their boundaries and leave the head
and tail of others. So an anchor stands at every line: each pair of neighbouring lines. A run of two lines or more that
occurs more than once is nothing but pairs that do, so removing the lines of every repeated pair but the first removes
whole runs wherever they begin and end. Pairs are found by a 128-bit hash; the bytes of all pairs of one hash are compared, and
each but the first (least doc_id, then line) is removed. A line that is removed always stays in an earlier place.

What is counted and joined is hashes, salted where one is frequent. The bytes are compared by grouping them, so a pair
with a million copies leaves a map task once; no list of a pair's occurrences is ever gathered. Whole texts are dealt
by doc_id once, and read from there for the comparison and for the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecue.llm.common import materialize, table, text_or_empty

#: A boundary follows a line if the rolling hash over the last WINDOW lines is a multiple of DIVISOR.
WINDOW = 2
DIVISOR = 2
MIN_LINES = 2
MAX_LINES = 32
#: Parts that the occurrences of each repeated hash are dealt into.
SALTS = 16
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def chunks(text: str) -> list[tuple[int, int, str]]:
    """(first line, lines, text) of each chunk; together they are the text's \\n-split lines in order."""
    lines = text.split("\n")
    hashes = [xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in lines]
    drop = pow(_BASE, WINDOW, 1 << 64)
    out, start, rolling = [], 0, 0
    for i, h in enumerate(hashes):
        rolling = (rolling * _BASE + h - (hashes[i - WINDOW] * drop if i >= WINDOW else 0)) & _MASK
        n = i + 1 - start
        if i + 1 == len(lines) or n >= MAX_LINES or (n >= MIN_LINES and (rolling >> 32) % DIVISOR == 0):
            out.append((start, n, "\n".join(lines[start : i + 1])))
            start = i + 1
    return out


def digest(chunk: str) -> bytes:
    return xxhash.xxh3_128_digest(chunk.encode("utf-8", "surrogatepass"))


def _salts() -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")


def pair(lines: list[str], i: int) -> str:
    """The text of line ``i`` and the next."""
    return f"{lines[i]}\n{lines[i + 1]}"


def pair_hashes(docs: DataFrame) -> DataFrame:
    """doc_id, line and hash of the pairs of lines that aren't blank."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, rows = batch.column(0), []
            for k, x in enumerate(batch.column(1)):
                lines = x.as_py().split("\n")
                rows += [(k, i, digest(c)) for i in range(len(lines) - 1) if not (c := pair(lines, i)).isspace()]
            yield pa.RecordBatch.from_arrays(
                [own.take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())],
                names=["doc_id", "line", "hash"],
            )

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, line long, hash binary")


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, line, hash, salt, is_first of every pair whose hash occurs more than once; pairs that overlap the first count as it."""
    rows = materialize(pair_hashes(docs.filter("doc_id is not null")), "pairs")
    first = rows.groupBy("hash").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = first.select("hash", "first", _salts())
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "line"), F.lit(SALTS)).cast("int"))
    is_first = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("line") < F.col("first.line") + MIN_LINES)
    return salted.join(first, ["hash", "salt"]).select("doc_id", "line", "hash", "salt", is_first.alias("is_first"))


def unequal(marked: DataFrame) -> DataFrame:
    """The hashes of ``marked`` (text, marks) whose pairs aren't all the same bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, marks in zip(batch.column(0), batch.column(1), strict=True):
                if marks.is_valid:
                    lines = text.as_py().split("\n")
                    out += [(m["hash"], c) for m in marks.as_py() if m["line"] + 1 < len(lines) and digest(c := pair(lines, m["line"])) == m["hash"]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.string())], names=["hash", "pair"])

    return marked.select("text", "marks").mapInArrow(run, "hash binary, pair string").distinct().groupBy("hash").count().filter("count > 1").select("hash")


def without(text: str, gone: set[tuple[int, bytes]]) -> tuple[int, int, str]:
    """Lines, lines removed and what stays of ``text`` without the pairs ``gone`` and the blank lines between them."""
    lines = text.split("\n")
    out = {k for i, h in gone if i + 1 < len(lines) and digest(pair(lines, i)) == h for k in (i, i + 1)}
    last = None
    for i, x in enumerate(lines):
        if i in out:
            if last is not None:
                out.update(range(last, i))
            last = i
        elif x and not x.isspace():
            last = None
    return len(lines), len(out), "\n".join(x for i, x in enumerate(lines) if i not in out)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the text that stays, for every row of ``docs``.

    A null text is an empty one (one blank line); a text whose lines all repeat in runs becomes empty. Blank pairs and single
    lines are never removed. Rows with one doc_id are taken for one document, so a repeated row changes nothing;
    rows without a doc_id are left alone. An empty table gives no rows. Should different pairs share a 128-bit hash,
    the comparison tells, and no pair of that hash is removed.
    """
    texts = docs.filter("doc_id is not null").select("doc_id", text_or_empty().alias("text"))
    found = materialize(repeats(docs), "repeats")
    marks = found.groupBy("doc_id").agg(F.collect_set(F.struct("line", "hash")).alias("marks"))
    others = found.filter("not is_first").join(unequal(texts.join(marks, "doc_id", "left")).select("hash", _salts()), ["hash", "salt"], "left_anti")
    gone = others.groupBy("doc_id").agg(F.collect_set(F.struct("line", "hash")).alias("gone"))

    def rebuild(texts: pd.Series, marks: pd.Series) -> pd.DataFrame:
        out = [without(text, {(int(g["line"]), bytes(g["hash"])) for g in gone} if gone is not None else set()) for text, gone in zip(texts, marks, strict=True)]
        return pd.DataFrame(out, columns=["n_lines", "n_removed", "text"])

    joined = texts.join(gone, "doc_id", "left")
    out = joined.select("doc_id", F.pandas_udf(rebuild, "n_lines long, n_removed long, text string")("text", "gone").alias("r")).select("doc_id", "r.*")
    # rows without a doc_id are sent nowhere
    lines = F.size(F.split(text_or_empty(), "\n")).cast("long").alias("n_lines")
    return out.union(docs.filter("doc_id is null").select("doc_id", lines, F.lit(0).cast("long").alias("n_removed"), text_or_empty().alias("text")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))
