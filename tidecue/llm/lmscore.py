"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

P(word | context) = P(class | context) P(subclass | class, context) P(word | subclass). Classes are bands of frequency by shape
(letters beyond ASCII, a mark at the end, length); a frequent word is a subclass of its own, others share one with words
of their class and ending. Both softmaxes are trained on the same hashed indicator features: the last word, its
subclass, and skips to the subclasses of the second and third last; those of the second hold the class as well. P(word | subclass)
is the smoothed share of the word, with one more slot for words that training never saw.

What is gathered grows with the corpus: every word is counted, and the weights have a row for each of about the square
root of the training tokens' number (``MAX_BITS`` bounds what is sent to the tasks).

Text is read once and kept as numbered chunks: whole documents as local word ids, and the local words' 64-bit hashes, kinds
and counts. A word is its hash from there on (two words that share one would count together; five million words have
one such pair with a chance of about 1 in a million). Counts of all words are summed where the hashes meet, a row for each word of
a chunk, not for each token, and go back to their chunks packed, so no vocabulary is ever sent around whole.

Weights are trained by rounds of distributed gradient updates. Each round takes its own share of the training documents, by a hash
of their text; every task sums the gradient over its documents of that share, the sums are added in slices, and one step, scaled by
each weight's expected count, follows. So all training documents are seen once, and neither the order of rows nor
their partitions change the result beyond the rounding of sums.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecue.llm.common import delete, discard, materialize, table, text_or_empty, tidy

FOLDS, HELD_OUT = 5, 1
CHUNK_CHARS = 8_000_000
#: Words that are subclasses of their own.
HEADS = 256
SHAPES = 8
#: Words seen in fewer than one of so many training tokens fall into the next band; heads are a band before these.
BANDS = (1 << 13, 1 << 18)
CLASSES = SHAPES * (len(BANDS) + 2)
SUBCLASSES = 32
MIN_BITS, MAX_BITS = 6, 18
ROUNDS = 6
#: Step length, prior count and the most that a weight moves at once.
RATE, PRIOR, MOST = 0.3, 8.0, 1.5
BATCH = 1 << 14
SLICES = 16
#: Word rows that are counted in one task, about.
ROWS_IN_PART = 2_000_000
#: Chunks meet the counts of their words in so many turns; what a turn has read and sent is removed before the next.
TURNS = 4
#: The end of a text as a word; no word holds white space.
END = b"\n"
_MARKS = b".,;:!?"
#: A word's place: its chunk, its number there.
_I_BITS, _SEQ_BITS = 31, 14
#: Odd multipliers for the features and for classes; fixed.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def kind(word: bytes) -> int:
    """One of 256: the shape (letters beyond ASCII, a mark at the end, over six bytes), and 32 for the last byte before marks."""
    shape = 4 * (not word.isascii()) + 2 * (word[-1] in _MARKS) + (len(word) > 6)
    return shape * SUBCLASSES + zlib.crc32(word.rstrip(_MARKS)[-1:]) % SUBCLASSES


def _packed_ids(ids: np.ndarray) -> bytes:
    """Compressed by planes, lowest bytes first: the high bytes of most ids are zeros."""
    return zstandard.compress(ids.view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _unpacked_ids(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.int32).ravel()


def encoded(docs: DataFrame, *, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Chunks of whole documents: ids of rows, fold and share of each, tokens, local word ids; hash, kind and training count of each word."""
    of_id = docs.schema["doc_id"].dataType.simpleString()
    schema = f"chunk long, doc_ids array<{of_id}>, held array<boolean>, shares array<int>, lengths array<int>, ids binary, hashes binary, kinds binary, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        doc_ids, held, shares, lengths, ids, chars, number, doc_type = [], [], [], [], [], 0, {}, None

        def done() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            counts = np.bincount(flat[np.repeat(~np.array(held), lengths)], minlength=len(number)).astype(np.int32)
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
            kinds = np.fromiter(map(kind, number), np.uint8, len(number))
            row = [[(part << _SEQ_BITS) + seq], [pa.array(doc_ids, doc_type)], [held], [shares], [lengths], [_packed_ids(flat)], *([x.tobytes()] for x in (hashes, kinds, counts))]
            types = [pa.int64(), pa.list_(doc_type), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(row, types, strict=True)], names=["chunk", "doc_ids", "held", "shares", "lengths", "ids", "hashes", "kinds", "counts"]
            )

        for batch in batches:
            doc_type = batch.schema.field(0).type
            for doc_id, name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = text.as_py()
                raw = text.encode("utf-8", "surrogatepass").lower()
                words = raw.split()
                words.append(END)
                ids.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
                doc_ids.append(doc_id)
                held.append(zlib.crc32((name or "").encode()) % FOLDS == HELD_OUT)
                shares.append(xxhash.xxh3_64_intdigest(raw) & 0x7FFFFFFF)
                lengths.append(len(words))
                chars += len(text)
                if chars >= chunk_chars:
                    yield done()
                    seq += 1
                    if seq >> _SEQ_BITS:
                        raise ValueError("too many chunks in one partition: read the input in more partitions")
                    doc_ids, held, shares, lengths, ids, chars, number = [], [], [], [], [], 0, {}
        if doc_ids:
            yield done()

    return docs.select("doc_id", F.col("doc_id").cast("string").alias("name"), text_or_empty().alias("text")).mapInArrow(run, schema)


def word_rows(chunks: DataFrame) -> DataFrame:
    """hash, place, kind and training count of each word of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, hashes, kinds, counts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                h, k, n = np.frombuffer(hashes, np.int64), np.frombuffer(kinds, np.uint8).astype(np.int16), np.frombuffer(counts, np.int32)
                at = (chunk << _I_BITS) + np.arange(len(h), dtype=np.int64)
                for i in range(0, len(h), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)]) for x in (h, at, k, n)], names=["h", "at", "k", "n"])

    return chunks.select("chunk", "hashes", "kinds", "counts").mapInArrow(run, "h long, at long, k short, n int")


def packed(counted: DataFrame) -> DataFrame:
    """The counts of all training rows, for each chunk in the order of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, parts = None, []

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([np.concatenate(parts).tobytes()], pa.binary())], names=["chunk", "c"])

        for batch in batches:
            of, c = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else []
            for lo, hi in zip(starts, [*starts[1:], len(of)], strict=True):
                if parts and of[lo] != chunk:
                    yield done()
                    parts = []
                chunk = int(of[lo])
                parts.append(c[lo:hi])
        if parts:
            yield done()

    placed = counted.select(F.shiftright("at", _I_BITS).alias("chunk"), "at", "c")
    return placed.repartition("chunk").sortWithinPartitions("chunk", "at").mapInArrow(run, "chunk long, c binary")


@dataclass
class Model:
    """Weights of both softmaxes (buckets x outcomes), their start values, and the words' shares.

    ``heads``: hashes of the frequent words in order of their hash, with class and subclass of each; ``n``, ``v``: training tokens
    and distinct training words of each subclass of each class.
    """

    total: int
    distinct: int
    heads: np.ndarray
    head_cells: np.ndarray
    n: np.ndarray
    v: np.ndarray
    bits: int
    first: np.ndarray
    second: np.ndarray

    def cells(self, hashes: np.ndarray, kinds: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """class * SUBCLASSES + subclass of each word."""
        band = 1 + sum((counts * b < self.total).astype(np.int64) for b in BANDS)
        out = band * SHAPES * SUBCLASSES + kinds.astype(np.int64)
        if len(self.heads):
            at = np.searchsorted(self.heads, hashes).clip(max=len(self.heads) - 1)
            hit = self.heads[at] == hashes
            out[hit] = self.head_cells[at[hit]]
        return out

    def biases(self) -> tuple[np.ndarray, np.ndarray]:
        """Log shares of the classes, and of the subclasses of each class, as training has them."""
        n = self.n.reshape(CLASSES, SUBCLASSES) + 0.5
        return np.log(n.sum(1) / n.sum()).astype(np.float32), np.log(n / n.sum(1, keepdims=True)).astype(np.float32)

    def word_logs(self, cells: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 P(word | subclass)."""
        return np.log10((counts + 0.5) / (self.n + 0.5 * (self.v + 1))[cells])


def head_cells(heads: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The frequent words of a shape are dealt to its subclasses by rank, so that each has one to itself or nearly so."""
    out, used = np.zeros(len(heads), np.int64), np.zeros(SHAPES, np.int64)
    for i, k in enumerate(kinds // SUBCLASSES):
        out[i] = k * SUBCLASSES + used[k] % SUBCLASSES
        used[k] += 1
    return out


def features(words: np.ndarray, cells: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The four features of each token as 64-bit numbers (tokens x 4); contexts end at the start of a document."""
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(words)) - np.repeat(starts, lengths)
    before = lambda x, k: np.where(place >= k, np.roll(x, k), np.uint64(k))
    own = cells.astype(np.uint64) + np.uint64(8)
    return np.stack([before(words, 1) * _MIX[0], before(own, 1) * _MIX[1], before(own, 2) * _MIX[2], before(own, 3) * _MIX[3]], axis=1)


def buckets(mixed: np.ndarray, bits: int, classes: np.ndarray | None = None) -> np.ndarray:
    """The row of the weights for each feature; with ``classes`` that of the second softmax."""
    if classes is not None:
        mixed = (mixed ^ (classes.astype(np.uint64) * _MIX[4])[:, None]) * _MIX[5]
    return (mixed >> np.uint64(64 - bits)).astype(np.int32)


#: Exponentials up to this, and sums of them, are ordinary 32-bit numbers.
_SAFE = 60.0


def _raised(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The sum of each row's weights over the outcomes, moved where an exponential could leave the range of 32 bits."""
    z = weights.take(rows[:, 0], axis=0)
    for k in range(1, rows.shape[1]):
        z += weights.take(rows[:, k], axis=0)
    z += bias
    if len(z) and max(z.max(), -z.min()) > _SAFE:
        z -= z.max(axis=1, keepdims=True)
    return z


def probs(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The softmax over the outcomes for each row of features."""
    z = _raised(weights, bias, rows)
    np.exp(z, out=z)
    z /= (z @ np.ones(z.shape[1], np.float32))[:, None]
    return z


def log_prob(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, outcomes: np.ndarray) -> np.ndarray:
    """Natural log of one outcome's share for each row of features."""
    z = _raised(weights, bias, rows)
    own = z[np.arange(len(z)), outcomes]
    np.exp(z, out=z)
    return own - np.log(z @ np.ones(z.shape[1], np.float32))


def add_gradient(seen: np.ndarray, expected: np.ndarray, shares: np.ndarray, rows: np.ndarray, outcomes: np.ndarray) -> None:
    """Adds what happened and what the model expected (``shares``), by bucket and outcome; their difference is the gradient."""
    size, width = expected.shape[1], len(expected)
    flat = rows.ravel(order="F").astype(np.int64)
    by_feature = flat.reshape(rows.shape[1], -1)
    for k, own in enumerate(np.ascontiguousarray(shares.T, np.float64)):
        for at in by_feature:
            expected[k] += np.bincount(at, own, size)
    np.add.at(seen.reshape(-1), np.tile(outcomes, rows.shape[1]) * size + flat, 1.0)


_READY = ("doc_ids", "held", "shares", "lengths", "ids", "hashes", "kinds", "c")


def _opened(batch: pa.RecordBatch, model: Model) -> Iterator[tuple]:
    """doc_ids, held, share, lengths, counts by word, hash by word, cell by word, word of each token."""
    for doc_ids, held, shares, lengths, ids, hashes, kinds, c in zip(*(batch.column(i) for i in range(8)), strict=True):
        h, n = np.frombuffer(hashes.as_py(), np.int64), lengths.values.to_numpy()
        counts = np.frombuffer(c.as_py(), np.int64)
        cells = model.cells(h, np.frombuffer(kinds.as_py(), np.uint8), counts)
        yield doc_ids.values, np.array(held.as_py(), bool), shares.values.to_numpy(), n, counts, h.view(np.uint64), cells, _unpacked_ids(ids.as_py())


def _parts(n: np.ndarray, size: int) -> Iterator[slice]:
    """Ranges of documents of about ``size`` tokens; a long document is one of its own."""
    ends, lo = np.cumsum(n), 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, side="right")))
        yield slice(lo, hi)
        lo = hi


def _round(chunks: DataFrame, model: Model, turn: int, rounds: int) -> None:
    """One step on the gradient over all training documents of this round."""
    sent = chunks.sparkSession.sparkContext.broadcast(model)
    size = 1 << model.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        bias = own.biases()
        sums = [np.zeros((2, width, size)) for width in (CLASSES, SUBCLASSES)]
        any_seen = False
        for batch in batches:
            for _, held, shares, n, _, words, cells, flat in _opened(batch, own):
                used = ~held & (shares % rounds == turn)
                mine, n = flat[np.repeat(used, n)], n[used]
                ends = np.cumsum(n)
                for docs in _parts(n, BATCH << 2):
                    lengths = n[docs]
                    ids = mine[ends[docs.start] - n[docs.start] : ends[docs.stop - 1]]
                    mixed, target = features(words[ids], cells[ids], lengths), cells[ids]
                    for at in range(0, len(ids), BATCH):
                        x, y = mixed[at : at + BATCH], target[at : at + BATCH]
                        k, j = y // SUBCLASSES, y % SUBCLASSES
                        rows = buckets(x, own.bits)
                        add_gradient(*sums[0], probs(own.first, bias[0], rows), rows, k)
                        rows = buckets(x, own.bits, k)
                        add_gradient(*sums[1], probs(own.second, bias[1][k], rows), rows, j)
                        any_seen = True
        if any_seen:
            parts = [np.concatenate([np.array_split(s, SLICES, axis=2)[i].ravel() for s in sums]).astype(np.float32) for i in range(SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["slice", "g"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, g in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(g.as_py(), np.float32).astype(np.float64)
                total[k] = total[k] + own if k in total else own
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([g.astype(np.float32).tobytes() for g in total.values()], pa.binary())], names=["slice", "g"])

    # each task sends one gradient whatever it has read, so there are as many as run at once
    dealt = chunks.select(*_READY).coalesce(chunks.sparkSession.sparkContext.defaultParallelism)
    done = dealt.mapInArrow(run, "slice int, g binary").repartition(SLICES, "slice").mapInArrow(added, "slice int, g binary")
    cuts = [len(x) for x in np.array_split(np.zeros(size), SLICES)]
    # two numbers for each weight, a size that MAX_BITS bounds
    for r in done.collect():
        g, lo, n = np.frombuffer(bytes(r.g), np.float32), sum(cuts[: r.slice]), cuts[r.slice]
        for weights, width in ((model.first, CLASSES), (model.second, SUBCLASSES)):
            part, g = g[: 2 * width * n].reshape(2, width, n), g[2 * width * n :]
            step = RATE * (part[0] - part[1]) / (part[1] + PRIOR)
            weights[lo : lo + n] += np.clip(step, -MOST, MOST).T.astype(np.float32)
    sent.unpersist()


def fitted(counted: DataFrame, ready: DataFrame, *, rounds: int = ROUNDS) -> Model:
    """The model of the training rows; what the driver holds is the heads, a row for each subclass and the weights."""
    words = counted.filter("word is not null")
    heads = words.select("word", "k", "c").orderBy(F.col("c").desc(), "word").limit(HEADS).collect()
    hashes, kinds = np.array([r.word for r in heads], np.int64), np.array([r.k for r in heads], np.int64)
    total = words.agg(F.sum("c")).first()[0] or 0
    order = np.argsort(hashes)
    cells = head_cells(hashes, kinds)[order] if len(heads) else np.zeros(0, np.int64)
    size = CLASSES * SUBCLASSES
    bits = int(np.clip(np.ceil(np.log2(max(total, 1)) / 2), MIN_BITS, MAX_BITS))
    zeros = [np.zeros((1 << bits, width), np.float32) for width in (CLASSES, SUBCLASSES)]
    model = Model(int(total), 0, hashes[order], cells, np.zeros(size), np.zeros(size), bits, *zeros)

    def masses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            h, k, c = (batch.column(i).to_numpy() for i in range(3))
            own = model.cells(h, k, c)
            np.add.at(n, own, c)
            v += np.bincount(own, minlength=size)
        some = np.flatnonzero(v)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some, n[some], v[some])], names=["cell", "n", "v"])

    for r in words.select("word", "k", "c").mapInArrow(masses, "cell long, n long, v long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        model.n[r.cell], model.v[r.cell] = r.n, r.v
    model.distinct = int(model.v.sum())
    for turn in range(rounds if total else 0):
        _round(ready, model, turn, rounds)
    return model


def score(docs: DataFrame, *, rounds: int = ROUNDS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    A null or empty text is the end token alone; a null doc_id counts as an empty name, which is training. Repeated rows
    each train and are each scored. Without any training row nothing is known and the scores are those of
    unknown words alone. An empty table gives no rows. Texts are scored whole.
    """
    ready, model = prepared(docs, rounds=rounds, chunk_chars=chunk_chars)
    of_id = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)
    base = float(np.log10(model.total + 0.5 * (model.distinct + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for doc_ids, held, _, n, c, words, cells, flat in _opened(batch, own):
                by_token = np.concatenate([token_logs(own, words, cells, c, flat[lo:hi], n[docs]) for docs, lo, hi in _ranges(n)])
                starts = np.cumsum(n) - n
                total = lambda x: np.add.reduceat(x, starts)  # noqa: B023, E731
                columns = [doc_ids, pa.array(held), pa.array(n.astype(np.int64)), pa.array(total((c > 0)[flat].astype(np.int64))), pa.array(np.full(len(n), own.total, np.int64))]
                columns += [pa.array(total(np.log10(c + 0.5)[flat]) - n * base), pa.array(total(by_token))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return ready.select(*_READY).mapInArrow(run, f"doc_id {of_id}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _ranges(n: np.ndarray) -> Iterator[tuple[slice, int, int]]:
    ends = np.cumsum(n)
    for docs in _parts(n, BATCH << 2):
        yield docs, int(ends[docs.start] - n[docs.start]), int(ends[docs.stop - 1])


def token_logs(model: Model, words: np.ndarray, cells: np.ndarray, counts: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 P(token | its context) for the tokens of whole documents."""
    bias = model.biases()
    mixed, target, out = features(words[flat], cells[flat], lengths), cells[flat], model.word_logs(cells, counts)[flat]
    for at in range(0, len(flat), BATCH):
        x, y = mixed[at : at + BATCH], target[at : at + BATCH]
        k, j = y // SUBCLASSES, y % SUBCLASSES
        logs = log_prob(model.first, bias[0], buckets(x, model.bits), k) + log_prob(model.second, bias[1][k], buckets(x, model.bits, k), j)
        out[at : at + BATCH] += logs / np.log(10)
    return out


def _lots(chunks: DataFrame) -> list[tuple[list[str], list[int]]]:
    """The files of ``chunks`` in at most TURNS lots, and the chunks that each lot holds (the driver has a number for each chunk)."""
    held = defaultdict(list)
    for r in chunks.select("chunk", F.input_file_name().alias("file")).collect():
        held[unquote(r.file)].append(r.chunk)
    files = sorted(held)
    return [(lot, [c for f in lot for c in held[f]]) for k in range(TURNS) if (lot := files[k::TURNS])]


def _with_counts(chunks: DataFrame, counted: DataFrame) -> DataFrame:
    """``chunks`` with the counts of their words, written in turns: a lot's files are deleted once it is written anew."""
    spark, done = chunks.sparkSession, []
    for files, names in _lots(chunks):
        own = counted.filter(F.shiftright("at", _I_BITS).isin(names))
        lot = spark.read.schema(chunks.schema).parquet(*files).drop("counts")
        done.append(materialize(lot.join(packed(own), "chunk"), "lm-ready"))
        delete(spark, files)
        tidy(spark)
    if not done:
        return materialize(chunks.drop("counts").join(packed(counted), "chunk"), "lm-ready")
    return spark.read.schema(done[0].schema).parquet(*(d._written_to for d in done))


def prepared(docs: DataFrame, *, rounds: int = ROUNDS, chunk_chars: int = CHUNK_CHARS) -> tuple[DataFrame, Model]:
    """The chunks with the counts of their words, and the fitted model."""
    spark = docs.sparkSession
    chunks = materialize(encoded(docs, chunk_chars=chunk_chars), "lm-chunks")
    rows = chunks.agg(F.sum(F.length("kinds").cast("long"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_IN_PART))
    word = Window.partitionBy("h")
    counted = word_rows(chunks).repartition(parts, "h").withColumn("c", F.sum("n").over(word)).withColumn("nth", F.row_number().over(word.orderBy("at")))
    counted = materialize(counted.select("at", "k", F.col("c").cast("long").alias("c"), F.when((F.col("nth") == 1) & (F.col("c") > 0), F.col("h")).alias("word")), "lm-counts")
    tidy(spark)  # words are sent once more for ready, which need not lie beside this shuffle
    ready = _with_counts(chunks, counted)
    discard(chunks)  # all of it is in ready
    tidy(spark)
    model = fitted(counted, ready, rounds=rounds)
    discard(counted)
    return ready, model


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
