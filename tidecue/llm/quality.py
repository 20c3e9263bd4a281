"""Quality rules: a learned decision list over statistics of a text.

``learn`` covers the rejected labelled rows one rule at a time: a rule grows by the threshold that gains most
(FOIL gain) on two thirds of what is left, is pruned from its end on the other third, and joins the list if it is
precise enough on both; rows that it covers are then taken away. The list becomes one ordered Spark conditional
expression, so the verdict on a row is built-in operations only.

Only the labelled rows reach the driver, at most ``max_labels`` of them (those with the least seeded hash, a
documented bound for fitting); the statistics of all rows stay distributed, and every text is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecue.llm.common import table, text_or_empty

#: Labelled rows that fitting uses at most.
MAX_LABELS = 20_000
MIN_PRECISION = 0.95
MIN_COVER = 3
MAX_CONDITIONS = 3
MAX_RULES = 16
SYMBOLS = "#*$%&|<>"
#: Fixed: the six white-space characters that end a word.
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_marks", "n_same_next", "n_distinct")
FEATURES = ("words", "mean_word", "symbols", "dup_lines", "repeats", "upper", "digits", "marks", "same_next", "distinct")


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more in the text, the first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    k = len(number)
    if k < 2_000_000:
        windows = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    else:  # the product would not fit into 64 bits
        pair = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)[1]
        windows = pair[:-1] * k + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    held = np.zeros(n, bool)
    held[:-2] |= twice
    held[1:-1] |= twice
    held[2:] |= twice
    return int(held.sum())


def letters(text: str) -> tuple[int, int]:
    """Letters that have case, and those in upper case: what lower() and upper() change, by code point."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    low, up = text.lower(), text.upper()
    if len(low) != len(text) or len(up) != len(text):  # a letter with a longer form: character by character
        return sum(c.isupper() or c.islower() for c in text), sum(map(str.isupper, text))
    n_upper = int((a != np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4")).sum())
    return n_upper + int((a != np.frombuffer(up.encode("utf-32-le", "surrogatepass"), "<u4")).sum()), n_upper


def counts_of(text: str) -> tuple[int, ...]:
    """The counts of ``COUNTS`` for one whole text."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    if not n:
        return (0,) * 5 + (text.count("\n") + 1,) + (0,) * 6
    n_letters, n_upper = letters(text)
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return (
        n,
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        text.count("\n") + 1,
        n_upper,
        n_letters,
        sum(map(text.count, "0123456789")),
        sum(map(text.count, "!?")),
        sum(map(bytes.__eq__, words, words[1:])),
        len(set(words)),
    )


def with_counts(docs: DataFrame, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and the counts of every row; a null text counts as empty."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + "".join(f", {c} long" for c in COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [counts_of(x.as_py() or "") for x in batch.column(len(keep))]
            columns = [batch.column(i) for i in range(len(keep))] + [pa.array([g[i] for g in got], pa.int64()) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *COUNTS])

    return docs.select(*keep, text_or_empty().alias("__text")).mapInArrow(run, schema)


def features() -> dict[str, Column]:
    """The features by name, as expressions over the counts."""
    of = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return {
        "words": F.col("n_words").cast("double"),
        "mean_word": of("word_chars", "n_words"),
        "symbols": of("n_symbols", "word_chars"),
        "dup_lines": of("n_dup_lines", "n_lines"),
        "repeats": of("n_repeat_words", "n_words"),
        "upper": of("n_upper", "n_letters"),
        "digits": of("n_digits", "word_chars"),
        "marks": of("n_marks", "word_chars"),
        "same_next": of("n_same_next", "n_words"),
        "distinct": of("n_distinct", "n_words"),
    }


@dataclass(frozen=True)
class Rule:
    """All conditions (feature, is_at_least, threshold) must hold."""

    conditions: tuple[tuple[str, bool, float], ...]
    covered: int
    precision: float


def _holds(x: np.ndarray, conditions) -> np.ndarray:
    held = np.ones(len(x), bool)
    for name, least, value in conditions:
        column = x[:, FEATURES.index(name)]
        held &= column >= value if least else column < value
    return held


def _best_condition(x: np.ndarray, bad: np.ndarray) -> tuple[float, tuple[str, bool, float] | None]:
    """The threshold with the highest FOIL gain over the rows given, found by one sort for each feature."""
    p, n = int(bad.sum()), len(bad)
    base = np.log2(p / n)
    best: tuple[float, tuple[str, bool, float] | None] = (1e-9, None)
    for j, name in enumerate(FEATURES):
        order = np.argsort(x[:, j], kind="stable")
        v, b = x[order, j], bad[order]
        cut = np.flatnonzero(v[1:] > v[:-1]) + 1
        if not len(cut):
            continue
        below = np.cumsum(b)[cut - 1]
        for least, pos, size in ((True, p - below, n - cut), (False, below, cut)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pos > 0, pos * (np.log2(pos / size) - base), -1.0)
            k = int(np.argmax(gain))
            if gain[k] > best[0] + 1e-12:
                best = (float(gain[k]), (name, least, float((v[cut[k] - 1] + v[cut[k]]) / 2)))
    return best


def learn(x: np.ndarray, bad: np.ndarray, order: np.ndarray, *, min_precision: float = MIN_PRECISION, min_cover: int = MIN_COVER) -> list[Rule]:
    """The rules that reject, in order; what no rule covers is kept.

    ``order`` decides which third prunes (its values modulo 3), so that the fit does not hang on row order.
    No rejected row, or nothing but rejected rows without a threshold between them: no rules.
    """
    left, rules = np.ones(len(x), bool), []
    while len(rules) < MAX_RULES and (bad & left).sum() >= min_cover:
        grow, prune = left & (order % 3 != 0), left & (order % 3 == 0)
        conditions: list[tuple[str, bool, float]] = []
        while len(conditions) < MAX_CONDITIONS:
            held = grow & _holds(x, conditions)
            if not bad[held].any() or bad[held].all():
                break
            _, condition = _best_condition(x[held], bad[held])
            if condition is None:
                break
            conditions.append(condition)

        def worth(k: int) -> float:
            held = prune & _holds(x, conditions[:k])  # noqa: B023
            p, n = int((bad & held).sum()), int(held.sum())
            return (2 * p - n) / n if n else -1.0

        if not conditions:
            break
        k = max(range(1, len(conditions) + 1), key=lambda k: (worth(k), -k))
        held = left & _holds(x, conditions[:k])
        if (p := int((bad & held).sum())) < min_cover or p < min_precision * held.sum():
            k = len(conditions)
            held = left & _holds(x, conditions)
            if (p := int((bad & held).sum())) < min_cover or p < min_precision * held.sum():
                break
        rules.append(Rule(tuple(conditions[:k]), int(held.sum()), p / int(held.sum())))
        left &= ~held
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True: kept. The rules as one ordered conditional expression over the counts."""
    have = features()
    out: Column | None = None
    for rule in rules:
        test: Column | None = None
        for name, least, value in rule.conditions:
            one = have[name] >= F.lit(value) if least else have[name] < F.lit(value)
            test = one if test is None else test & one
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, *, max_labels: int = MAX_LABELS, seed: int = 7) -> list[Rule]:
    """Learns from the rows of ``docs`` that ``labels`` (doc_id, quality 0/1) covers.

    Of more than ``max_labels`` labelled documents those with the least seeded hash are used. Null labels
    are left out; a document with several labels counts as rejected if most of them are 0. No labels: no rules.
    """
    chosen = (
        labels.filter("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.avg("quality").alias("q"))
        .select("doc_id", (F.col("q") < 0.5).alias("bad"), F.xxhash64("doc_id", F.lit(seed)).alias("h"))
        .orderBy("h", "doc_id")
        .limit(max_labels)
    )
    # the chosen labels are at most max_labels short rows, whatever the size of the corpus
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = with_counts(found, keep=("doc_id", "bad", "h")).select("bad", "h", "doc_id", *[c.alias(f"f_{n}") for n, c in features().items()]).dropDuplicates(["doc_id"]).toPandas()
    if not len(rows):
        return []
    rows = rows.sort_values(["h", "doc_id"])
    return learn(rows[[f"f_{n}" for n in FEATURES]].to_numpy(float), rows["bad"].to_numpy(bool), np.arange(len(rows)))


def base_failed() -> Column:
    """Fixed rule: under 50 words, or over half of the words in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, *, max_labels: int = MAX_LABELS) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every row of ``docs``.

    A null text is an empty one and fails; repeated rows are judged one by one; an empty table gives no rows,
    without labels only the fixed rule rejects. Columns besides doc_id, text (and quality) are not looked at.
    """
    rules = fit(docs, labels, max_labels=max_labels)
    return with_counts(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, *, max_labels: int = MAX_LABELS) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, all columns as they were; one pass, nothing is shuffled."""
    test = ~base_failed() & verdict(fit(docs, labels, max_labels=max_labels))
    counts = F.pandas_udf(_count_frame, ", ".join(f"{c} long" for c in COUNTS))(text_or_empty())
    # the row is kept apart as a struct, so the names of the counts can't clash with its columns
    apart = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), counts.alias("counts"))
    return apart.select("row", "counts.*").filter(test).select("row.*")


def _count_frame(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([counts_of(x) for x in texts], columns=list(COUNTS))
