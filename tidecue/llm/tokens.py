"""Token counts by a tokenizer compiled to a finite-state transducer.

The tokenizer is byte-pair encoding over pieces with scores: the best-scored neighbours whose concatenation is a
piece merge first, leftmost on ties, and characters outside the vocabulary become bytes. A sequence of pieces is
the encoding of its text exactly if each piece encodes to itself and each neighbouring pair encodes to that pair.
So the last piece of the encoding of every prefix of a text follows from the last pieces of shorter prefixes, and only
those that a later piece can still reach back to matter. That finite knowledge is the state of a deterministic transducer:

* a state holds the longest suffix that a piece can begin with, and for each position in it the last piece there
  and the count there, relative to the count now;
* a transition reads a character and carries the number of tokens that it adds (merging takes some back).

States and transitions are compiled when first needed and kept; beyond a fixed number they are dropped and
compiled anew, within a word too, so memory is bounded. No piece holds a space after another character, so a word (spaces,
then others) starts from the initial state: its map is a constant, which is kept, and the scan over the words of a text is
a sum. The words of an Arrow batch are split and numbered there, so each distinct one is looked up once.

A word longer than a chunk, such as a text without spaces, is cut into chunks. What a chunk does to any state is its
map (``StateMap``). Maps compose associatively (``Composed``); the levels of a balanced scan compose neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecue.llm.common import table, text_or_empty

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
CHUNK = 1 << 15
MAX_STATES = 300_000
#: Words of over so many characters go through the transducer one by one.
SHORT = 64
#: Rows whose words are numbered together.
SLICE = 1024
SPACE = "▁"
#: The state before a word.
START = ("", ("",), (0,))
#: A move is packed as the next state and, in the low bits, the tokens added plus a constant, as it may take some back.
_ADDED_BITS, _ADDED_ZERO, _ADDED_MASK = 8, 128, 255
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Transducer:
    """Counts tokens as the model does, without begin or end tokens."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(sp.get_piece_size())
        self.rank = {sp.id_to_piece(i): -sp.get_score(i) for i in ids if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))}
        chars = {c for p in self.rank for c in p}
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("a piece holds a space after another character; words can't start afresh")
        if sp.normalize(" aéＡ  b ") != f"{SPACE * 2}aéＡ{SPACE * 2}b{SPACE}":
            raise ValueError("only models that leave text as it is and put a space before it are compiled")
        self.chars = chars & set(self.rank)
        self.starts = {p[:k] for p in self.rank for k in range(1, len(p))}
        self.longest = max(map(len, self.rank), default=1)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.symbols = sorted(self.chars)
        self.wide = len(self.symbols) + 4  # characters outside the vocabulary differ by their bytes only
        self.of_point = np.select([np.arange(0x110000) < x for x in (0x80, 0x800, 0x10000)], [self.wide - 4, self.wide - 3, self.wide - 2], self.wide - 1).astype(np.int32)
        self.of_point[[ord(c) for c in self.symbols]] = np.arange(len(self.symbols))
        self._reset()

    def _reset(self) -> None:
        self.states: list[tuple[str, tuple[str | None, ...], tuple[int, ...]]] = []
        self.numbers: dict[tuple, int] = {}
        self.moves: dict[int, int] = {}
        self.table = _Table(1 << 12)
        self._number(START)

    def _number(self, state: tuple) -> int:
        n = self.numbers.get(state)
        if n is None:
            n = self.numbers[state] = len(self.states)
            self.states.append(state)
        return n

    def merged(self, parts: list[str]) -> list[str]:
        """Byte-pair encoding as it is defined; only run while compiling, on two pieces at most."""
        rank, never = self.rank, float("inf")
        costs = [rank.get(a + b, never) for a, b in zip(parts, parts[1:], strict=False)]
        while costs and (least := min(costs)) < never:
            i = costs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i:
                costs[i - 1] = rank.get(parts[i - 1] + parts[i], never)
            if i < len(costs):
                costs[i] = rank.get(parts[i] + parts[i + 1], never)
        return parts

    def fits(self, before: str, piece: str) -> bool:
        """Whether ``before`` and ``piece`` side by side stay these two; before is empty at the start of a word."""
        key = (before, piece)
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) > 4 * MAX_STATES:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(list(before + piece)) == ([before, piece] if before else [piece])
        return known

    def compile(self, move: int) -> int:
        """Compiles and keeps what state ``move`` // wide does on symbol ``move`` % wide: next state and tokens added, packed."""
        state, symbol = divmod(move, self.wide)
        seen, last, counts = self.states[state]
        if symbol >= len(self.symbols):  # becomes bytes, merges with nothing
            after, added = ("", ("\0",), (0,)), symbol - len(self.symbols) + 1
        else:
            text = seen + self.symbols[symbol]
            ends = [text[-k:] for k in range(1, min(len(text), self.longest) + 1)]
            for k in range(len(ends), 0, -1):
                piece = ends[k - 1]
                if piece in self.rank and self.fits("" if last[k - 1] == "\0" else last[k - 1], piece):
                    break
            else:
                raise AssertionError("every character of the vocabulary is a piece")
            added = counts[k - 1] + 1
            # a position that no piece can begin at is forgotten, so that states which behave alike are one
            open_at = [x in self.starts for x in ends[: self.longest - 1]]
            while open_at and not open_at[-1]:
                open_at.pop()
            depth = len(open_at)
            pieces = [p if o else None for p, o in zip(last, open_at, strict=False)]
            relative = [c - added if o else 0 for c, o in zip(counts, open_at, strict=False)]
            after = (text[len(text) - depth :], (piece, *pieces), (0, *relative))
        found = self.moves[move] = self._number(after) << _ADDED_BITS | (added + _ADDED_ZERO)
        return found

    def _symbols(self, text: str) -> np.ndarray:
        return self.of_point[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]

    def count_word(self, word: str) -> int:
        """Tokens of one word from the start state; a long word is cut into chunks whose maps are composed."""
        maps = [StateMap(self, word[i : i + CHUNK]) for i in range(0, len(word), CHUNK)]
        return scanned(maps)(START)[1]

    def steps(self, state: tuple, text: str) -> Iterator[tuple[tuple, int]]:
        """The state after each character and the tokens added, whatever number the state has now."""
        number, get, wide = self._number(state), self.moves.get, self.wide
        for c in self._symbols(text).tolist():
            if len(self.states) > MAX_STATES:
                state = self.states[number]
                self._reset()
                number, get = self._number(state), self.moves.get
            move = number * wide + c
            if (found := get(move)) is None:
                found = self.compile(move)
            number = found >> _ADDED_BITS
            yield self.states[number], (found & _ADDED_MASK) - _ADDED_ZERO

    def count_words(self, words: pa.Array) -> np.ndarray:
        """The tokens of each word, with a space before it; all short words take a step at a time together."""
        sizes = pc.utf8_length(words).to_numpy().astype(np.int64)
        symbols, begins = self._symbols("".join(words.to_pylist())), np.cumsum(sizes) - sizes
        if len(self.states) > MAX_STATES:
            self._reset()
        first = self.moves.get(int(self.of_point[ord(SPACE)]))
        if first is None:
            first = self.compile(int(self.of_point[ord(SPACE)]))
        state = np.full(len(sizes), first >> _ADDED_BITS, np.int64)
        total = np.full(len(sizes), (first & _ADDED_MASK) - _ADDED_ZERO, np.int64)
        order = np.argsort(-np.minimum(sizes, SHORT + 1), kind="stable")
        longer = np.searchsorted(-np.minimum(sizes, SHORT + 1)[order], -np.arange(SHORT + 2), side="left")  # words of over k characters
        skip = int(longer[SHORT])
        for k in range(SHORT):
            own = order[skip : longer[k]]
            if not len(own):
                break
            found = self.table.get(moves := state[own] * self.wide + symbols[begins[own] + k])
            if len(lacking := np.flatnonzero(found < 0)):
                new = np.unique(moves[lacking])
                values = [self.moves.get(m) for m in new.tolist()]
                values = np.array([self.compile(m) if v is None else v for m, v in zip(new.tolist(), values, strict=True)], np.int64)
                self.table.put(new, values)
                found[lacking] = values[np.searchsorted(new, moves[lacking])]
            state[own] = found >> _ADDED_BITS
            total[own] += (found & _ADDED_MASK) - _ADDED_ZERO
        for i in order[:skip].tolist():
            total[i] = self.count_word(SPACE + words[i].as_py())
        total[sizes == 0] = 0
        return total

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The tokens of each text of an Arrow array; a word that stands in many places is counted once.

        A word begins at a space that follows another character, and the state there is the same whatever came
        before, so the map of a word is a constant and the scan over a text's words is a sum.
        """
        parts = pc.split_pattern(pc.replace_substring(texts, SPACE, " "), " ")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = parts.flatten().dictionary_encode()
        names, codes = coded.dictionary, coded.indices.to_numpy()
        of_part = self.count_words(names)[codes]
        blank = (pc.binary_length(names).to_numpy() == 0)[codes]
        if blank.any():
            self._blanks(of_part, blank, offsets, names, codes)
        total = np.r_[0, np.cumsum(of_part)]
        found = total[offsets[1:]] - total[offsets[:-1]]
        found[pc.binary_length(texts).to_numpy() == 0] = 0
        return found

    def _blanks(self, of_part: np.ndarray, blank: np.ndarray, offsets: np.ndarray, names: pa.Array, codes: np.ndarray) -> None:
        """Several spaces in a row belong to the word after them, and at the end of a text are one word."""
        first = np.zeros(len(blank) + 1, bool)
        first[offsets[:-1]] = True
        at = np.flatnonzero(blank)
        starts = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | first[at[1:]]])
        known: dict[str, int] = {}
        for lo, hi in zip(at[starts].tolist(), (np.r_[at[starts[1:] - 1], at[-1:]] + 1).tolist(), strict=True):
            inside = hi < len(blank) and not first[hi]
            word = SPACE * (hi - lo + inside) + (names[int(codes[hi])].as_py() if inside else "")
            if word not in known:
                known[word] = self.count_word(word)
            of_part[hi if inside else lo] = known[word]

    def count(self, text: str) -> int:
        return int(self.counts(pa.array([text], pa.string()))[0])


class StateMap:
    """What a chunk does to any state: (state after it, tokens added).

    The chunk is read once from the start state. Another state is followed until it meets that path, from where
    on both are the same; if it never does, it is followed to the end.
    """

    def __init__(self, own: Transducer, text: str):
        self.own, self.text = own, text
        self.path: list[tuple] = []
        self.sums: list[int] = []
        for state, added in own.steps(START, text):
            self.path.append(state)
            self.sums.append(added + (self.sums[-1] if self.sums else 0))

    def __call__(self, state: tuple) -> tuple[tuple, int]:
        total, now = 0, state
        for i, (now, added) in enumerate(self.own.steps(state, self.text)):
            total += added
            if now == self.path[i]:
                return self.path[-1], total + self.sums[-1] - self.sums[i]
        return now, total


class Composed:
    """First ``a``, then ``b``; what it does to a state is kept."""

    def __init__(self, a: StateMap | Composed, b: StateMap | Composed):
        self.a, self.b = a, b
        self.known: dict[tuple, tuple[tuple, int]] = {}

    def __call__(self, state: tuple) -> tuple[tuple, int]:
        if state not in self.known:
            middle, n = self.a(state)
            end, m = self.b(middle)
            self.known[state] = (end, n + m)
        return self.known[state]


def scanned(maps: list[StateMap | Composed]) -> StateMap | Composed:
    """One level of the scan after another: neighbouring maps compose until one is left."""
    while len(maps) > 1:
        maps = [Composed(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


class _Table:
    """Numbers by number, looked up for whole arrays: open addressing, at most half full."""

    def __init__(self, size: int):
        self.keys, self.values, self.held = np.full(size, -1, np.int64), np.full(size, -1, np.int64), 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is, or the free place where it would be."""
        mask = len(self.keys) - 1
        at = ((keys.view(np.uint64) * _ODD) >> np.uint64(64 - mask.bit_length())).astype(np.int64)
        open_rows = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        while len(open_rows):
            at[open_rows] = (at[open_rows] + 1) & mask
            there = self.keys[at[open_rows]]
            open_rows = open_rows[(there != keys[open_rows]) & (there >= 0)]
        return at

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key; -1 without one."""
        return self.values[self._slots(keys)]

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that aren't held yet."""
        self.held += len(keys)
        if 2 * self.held > len(self.keys):
            old = self.keys >= 0
            keys, values = np.r_[self.keys[old], keys], np.r_[self.values[old], values]
            size = 1 << int(4 * self.held - 1).bit_length()
            self.keys, self.values = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        while len(keys):
            at = self._slots(keys)
            self.keys[at] = keys  # of several that meet in one place the last one stays
            won = self.keys[at] == keys
            self.values[at[won]] = values[won]
            keys, values = keys[~won], values[~won]


_COMPILED: dict[bytes, Transducer] = {}


def model_bytes(name: str = MODEL) -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def count_tokens(docs: DataFrame, model: bytes, *, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``.

    ``model`` is the model file's content (half a megabyte, which every task gets). A null or empty text has
    0 tokens; texts are never cut off; repeated rows are counted one by one; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _COMPILED:
            _COMPILED.clear()
            _COMPILED[model] = Transducer(model)
        counts = _COMPILED[model].counts
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.slice(at, SLICE)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts(part.column(2)))], names=["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select("doc_id", F.octet_length(text_or_empty()).cast("long").alias("n_bytes"), text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), model_bytes())
