"""Token counts of a sentencepiece BPE vocabulary by a compiled finite-state transducer.

The tokens of a prefix determine the tokens of the prefix with one more character: the last token of the
longer prefix is the one piece that ends there and stands beside the last token of the rest (a pair stands
if it encodes to itself; for one text exactly one such piece exists). So a state needs, for each suffix
that some piece may still begin with, the last token before it and the count there against the count here:
finitely many. The transducer is deterministic; each transition says how many tokens the text has more than
before. States and transitions are made when they are first met and kept.

A chunk's *state map* leads from the state before it to the state after it and the tokens in between. Maps
compose: first one, then the other, counts added; that is associative, so the chunks of a text can be cut
anywhere and their maps combined in a tree of any shape, or scanned. A map is compiled for the start state
first; from any other state the chunk is walked only until it meets that path, as states soon do, and the rest
follows.

No piece goes across the start of a run of blanks, nor across a character that is in no piece. There the
transducer is in its start state whatever came before, so the state map of a chunk between such places is
constant, and composing maps adds their counts: the prefix scan over all such chunks of a batch is one
cumulative sum, whose differences at the rows' ends are the rows' counts. Where a stretch has no such place for
long it is cut every ``PIECE`` characters, and its map is the composition of the pieces' maps.

One map over the rows, no shuffle. A worker keeps at most ``STATES`` states and ``CACHE`` chunk maps, and
makes them again when they are full.

Defined results: null or empty text: no bytes, no tokens, within the limit. Strings of special tokens in
a text are ordinary text. Rows that repeat give equal rows; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

#: Bounds of what a worker keeps.
STATES, CACHE, CHUNK = 300_000, 300_000, 48
#: Characters of a piece of a long chunk.
PIECE = 1024
BLANK = "▁"


class Transducer:
    """Counts tokens; ``pieces`` maps each piece that merges may make to its score."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.prefixes = {p[:i] for p in pieces for i in range(1, len(p) + 1)}
        self.inside = {c for p in pieces if len(p) > 1 for c in p}
        if any(BLANK in p.lstrip(BLANK) for p in pieces):
            raise ValueError("a piece goes across the start of a run of blanks")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.clear()

    def clear(self) -> None:
        #: (longest open suffix, for each open suffix: its length, the token before it, the count there less the count here)
        self.states: list[tuple] = [("", ((0, "", 0),))]
        self.number = {self.states[0]: 0}
        self.moves: list[dict[str, tuple[int, int]]] = [{}]
        self.maps = _Maps(self)

    def tokens(self, text: str) -> list[str]:
        """By definition: merge the neighbours of the best score, the leftmost first."""
        parts = list(text)
        while True:
            found = [(-s, i) for i in range(len(parts) - 1) if (s := self.pieces.get(parts[i] + parts[i + 1])) is not None]
            if not found:
                return parts
            at = min(found)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stands(self, a: str, b: str) -> bool:
        if not a or a[-1] not in self.inside or b[0] not in self.inside:
            return True
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) >= 4 * CACHE:
                self.pairs.clear()
            ok = self.pairs[a, b] = self.tokens(a + b) == [a, b]
        return ok

    def weight(self, token: str) -> int:
        """A character that is no piece becomes its bytes."""
        return 1 if token in self.pieces else len(token.encode())

    def move(self, at: int, char: str) -> tuple[int, int]:
        """Compile one transition: the next state, and how many tokens more."""
        suffix, open_ = self.states[at]
        text = suffix + char
        for length, before, count in open_:  # the longest first
            token = text[len(suffix) - length :]
            if (token in self.pieces or not length) and self.stands(before, token):
                break
        more = count + self.weight(token)
        after = [(length + 1, before, count - more) for length, before, count in open_ if text[len(suffix) - length :] in self.prefixes]
        after.append((0, token, 0))
        state = (text[len(text) - after[0][0] :], tuple(after))
        to = self.number.get(state)
        if to is None:
            to = self.number[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
        self.moves[at][char] = to, more
        return to, more

    def run(self, text: str, at: int = 0) -> tuple[int, int]:
        """The state map of ``text`` at a state: the state after it, and the tokens."""
        total, moves = 0, self.moves
        for char in text:
            step = moves[at].get(char) or self.move(at, char)
            at = step[0]
            total += step[1]
        return at, total


class StateMap:
    """The state map of one chunk: called with a state, it gives the state after the chunk and the tokens."""

    def __init__(self, transducer: Transducer, chunk: str):
        self.transducer, self.chunk = transducer, chunk
        #: the path from the start state: the states after each character, and the tokens up to there
        self.path, self.sums, at, total = [0], [0], 0, 0
        for char in chunk:
            at, more = transducer.moves[at].get(char) or transducer.move(at, char)
            total += more
            self.path.append(at)
            self.sums.append(total)
        self.known: dict[int, tuple[int, int]] = {0: (at, total)}

    def __call__(self, at: int) -> tuple[int, int]:
        out = self.known.get(at)
        if out is None:
            state, total, moves = at, 0, self.transducer.moves
            for i, char in enumerate(self.chunk):
                if state == self.path[i]:
                    state, total = self.path[-1], total + self.sums[-1] - self.sums[i]
                    break
                state, more = moves[state].get(char) or self.transducer.move(state, char)
                total += more
            out = self.known[at] = state, total
        return out


class Composed:
    """One state map after another."""

    def __init__(self, first, then):
        self.first, self.then = first, then

    def __call__(self, at: int) -> tuple[int, int]:
        middle, a = self.first(at)
        end, b = self.then(middle)
        return end, a + b


def compose(maps: list):
    """The composition of one or more neighbouring maps, as a balanced tree."""
    while len(maps) > 1:
        maps = [Composed(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


class _Maps(dict):
    """The counts of the constant state maps of chunks met before."""

    def __init__(self, transducer: Transducer):
        self.transducer = transducer

    def __missing__(self, chunk: str) -> int:
        t = self.transducer
        if len(t.states) >= STATES:
            t.clear()
        if len(chunk) > CHUNK:
            return compose([StateMap(t, chunk[i : i + PIECE]) for i in range(0, len(chunk), PIECE)])(0)[1]
        count = t.run(chunk)[1]
        if len(t.maps) >= CACHE:
            t.maps.clear()
        t.maps[chunk] = count
        return count


class Counter:
    """A transducer with the vocabulary's own rules: a blank before the text, blanks as marks."""

    def __init__(self, transducer: Transducer):
        self.transducer = transducer
        loose = "".join(c for c in "\n\t" if c not in transducer.inside)
        self.chunks = re.compile(f"{BLANK}*[^{BLANK}{loose}]+|{BLANK}+" + f"|[{loose}]" * bool(loose)).findall

    @classmethod
    def load(cls, path: str) -> Counter:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        ordinary = (i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i)))
        return cls(Transducer({p.id_to_piece(i): p.get_score(i) for i in ordinary}))

    def split(self, text: str) -> list[str]:
        return self.chunks(BLANK + text.replace(" ", BLANK)) if text else []

    def count(self, texts: list[str]) -> np.ndarray:
        """The tokens of each text, by a prefix scan over the counts of all their chunks."""
        ends, found = np.zeros(len(texts) + 1, np.int64), []
        for i, text in enumerate(texts):
            found += self.split(text)
            ends[i + 1] = len(found)
        scan = np.zeros(len(found) + 1, np.int64)
        np.cumsum(np.fromiter((self.transducer.maps[c] for c in found), np.int64, len(found)), out=scan[1:])
        return np.diff(scan[ends])


@lru_cache(2)
def counter(path: str) -> Counter:
    """A worker compiles a vocabulary once."""
    return Counter.load(path)


def count_tokens(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", limit: int = 4096) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for each row's whole text."""

    def run(batches):
        c = counter(path)
        for b in chunks(batches):
            n = c.count([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n)], [key, "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    out = docs.select(key, text, size.alias("n_bytes")).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
