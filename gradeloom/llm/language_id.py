"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of labelled text is
built. A text is then parsed greedily from left to right into longest matches
with the sample; the language that needs the fewest phrases, normalised as
phrases * log2(n) / n over the n characters, wins. The whole text is parsed.

The automaton is laid out as one table of (state, character) -> next state,
in which a missing transition already leads to where the next phrase starts
and is marked as a phrase end. Many texts step through it side by side; when
few long ones are left, they go on one by one. Only the most frequent
characters have columns in the table; the transitions by all others are kept
as sorted (state, character) keys, so every character of a sample can match.

Learning: at most `SAMPLE_ROWS` different texts of each language in seeded order, and
from each a piece of `PIECE_CHARACTERS` characters, together at most
`SAMPLE_CHARACTERS` per language (less where there are more than
`FULL_LANGUAGES` languages, so that the tables stay bounded). Classification
reads the text alone.

Defined cases: a text that is null or has no letter is `und` with score 0; on
a tie the first language in code-point order wins; with nothing to learn
from, every text is `und`; with one language its score is 1; columns with the
outputs' names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from gradeloom.llm.common import slices

UNKNOWN = "und"
SAMPLE_ROWS = 80
PIECE_CHARACTERS = 400
SAMPLE_CHARACTERS = 16_000
SALTS = 64
FULL_LANGUAGES = 8
MAX_LANGUAGES = 500
#: the most frequent characters have columns in the table; transitions by other characters are sorted keys
ALPHABET = 127
#: with fewer texts left than this, stepping side by side costs more than one by one
FEWEST_LANES = 12

Sample = tuple[tuple[str, str], ...]


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", order: Column | None = None) -> Sample:
    """(language, sample text) of rows whose label is known."""
    start = F.pmod(F.xxhash64(F.col(text)), F.greatest(F.length(text) - PIECE_CHARACTERS, F.lit(0)) + 1).cast("int")
    rows = (labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
            .select(F.col(lang).alias("lang"), F.xxhash64(F.col(text)).alias("text_hash"), (F.xxhash64(F.col(text)) if order is None else order).alias("order"),
                    F.substring(F.col(text), start + 1, F.lit(PIECE_CHARACTERS)).alias("piece")))
    # equal texts count once, or copies of one text would fill a sample
    different = rows.groupBy("lang", "text_hash").agg(F.min("order").alias("order"), F.min("piece").alias("piece"))
    # in two levels, so that a large language's tasks don't all send their first rows to one
    in_salt = Window.partitionBy("lang", "salt").orderBy("order", "piece")
    some = (different.withColumn("salt", F.pmod("text_hash", F.lit(SALTS))).withColumn("rank", F.row_number().over(in_salt))
            .where(F.col("rank") <= SAMPLE_ROWS).drop("salt"))
    first = Window.partitionBy("lang").orderBy("order", "piece")
    taken = some.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= SAMPLE_ROWS)
    pieces: dict[str, list[tuple[int, str]]] = {}
    for r in taken.select("lang", "rank", "piece").collect():
        pieces.setdefault(r["lang"], []).append((r["rank"], r["piece"]))
    if len(pieces) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    most = SAMPLE_CHARACTERS * FULL_LANGUAGES // max(FULL_LANGUAGES, len(pieces))
    return tuple((k, "".join(p for _, p in sorted(pieces[k]))[:most]) for k in sorted(pieces))


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings; state 0 is the start."""
    moves, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        new = len(moves)
        moves.append({}), link.append(0), length.append(length[last] + 1)
        p = last
        while p != -1 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p != -1:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q])), link.append(link[q]), length.append(length[p] + 1)
                while p != -1 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


class Parser:
    """Phrase counts of texts against every language of a sample."""

    def __init__(self, sample: Sample):
        self.names = [name for name, _ in sample]
        points = np.concatenate([self._points(t) for _, t in sample]) if sample else np.zeros(0, np.uint32)
        kinds, counts = np.unique(points, return_counts=True)
        kinds = kinds[np.argsort(-counts, kind="stable")]
        self.width = min(len(kinds), ALPHABET) + 1  # class 0: a character of no sample
        self.rare = len(kinds) + 1 - self.width  # classes from width on have no column
        kinds = np.concatenate([np.sort(kinds[:ALPHABET]), np.sort(kinds[ALPHABET:])])
        self.classes = np.zeros(0x110000, np.int32)
        self.classes[kinds] = np.arange(1, len(kinds) + 1)
        tables, self.starts, base = [], [], 0
        keys, values = [], []
        for _, text in sample:
            moves = suffix_automaton(self.classes[self._points(text)].tolist())
            own = np.zeros((len(moves), self.width), np.uint32)
            for state, go in enumerate(moves):
                for c, target in go.items():
                    if c < self.width:
                        own[state, c] = target
                    else:
                        keys.append((base // self.width + state) * self.rare + c - self.width)
                        values.append(target * self.width + base << 2)
            first = own[0].copy()  # where a new phrase goes that begins with the character that did not match
            target = np.where(own > 0, own, first[None, :])
            ends = own == 0
            ends[0] = False  # at the start no phrase is open; an unknown character is a phrase of its own
            ends[0, first == 0] = True
            # an unknown character elsewhere ends the open phrase and is another one
            twice = ends & (first == 0)[None, :]
            twice[0] = False
            # positions in the joint table, shifted to leave room for the number of phrases that end (ends + twice)
            tables.append((target * np.uint32(self.width) + np.uint32(base)) << np.uint32(2) | ends | twice.astype(np.uint32) << np.uint32(1))
            self.starts.append(base)
            base += own.size
        self.table = np.concatenate([t.ravel() for t in tables]) if tables else np.zeros(0, np.uint32)
        self.starts = np.array(self.starts, np.int64)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.values = np.array(keys, np.int64)[order], np.array(values, np.uint32)[order]

    @staticmethod
    def _points(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)

    def _found(self, state: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether the state has a transition by the character, its table value)"""
        wanted = state // self.width * self.rare + rare
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return self.keys[at] == wanted, self.values[at]

    def _rare_step(self, state: np.ndarray, rare: np.ndarray) -> np.ndarray:
        """Table values of (text, language) states by characters that have no column."""
        starts = np.broadcast_to(self.starts, state.shape)
        found, value = self._found(state, rare[:, None])
        anew, first = self._found(starts, rare[:, None])
        alone = (starts << 2) | 1 | (state != starts) << 1
        return np.where(found, value, np.where(anew, first | 1, alone)).astype(np.uint32)

    def counts(self, texts: list[str]) -> np.ndarray:
        """phrases[text, language]"""
        points = [self.classes[self._points(t)] for t in texts]
        length = np.array([len(p) for p in points], np.int64)
        order = np.argsort(-length, kind="stable")
        n, k = len(texts), len(self.names)
        out = np.zeros((n, k), np.int64)
        if not n or not k:
            return out
        flat = np.concatenate([points[i] for i in order]) if length.sum() else np.zeros(0, np.int32)
        at = np.concatenate([[0], np.cumsum(length[order])[:-1]])
        by_length = length[order]
        longest = int(by_length[0])
        lanes = np.searchsorted(-by_length, -np.arange(longest), side="left") if longest else np.zeros(0, np.int64)  # texts longer than each step
        state = np.repeat(self.starts[None, :], n, axis=0)
        ended = np.zeros((n, k), np.int64)
        step, table = 0, self.table
        some = bool(self.rare) and bool((flat >= self.width).any())
        while step < longest and lanes[step] >= (1 if some else FEWEST_LANES):
            m = lanes[step]
            c = flat[at[:m] + step]
            rare = np.flatnonzero(c >= self.width) if some else ()
            if len(rare):
                now = table[state[:m] + np.where(c < self.width, c, 0)[:, None]]
                now[rare] = self._rare_step(state[rare], c[rare] - self.width)
            else:
                now = table[state[:m] + c[:, None]]
            ended[:m] += (now & 1) + (now >> 1 & 1)
            state[:m] = now >> 2
            step += 1
        for i in range(int(lanes[step]) if step < longest else 0):
            rest = flat[at[i] + step:at[i] + by_length[i]].tolist()
            for j in range(k):
                s, e = int(state[i, j]), 0
                for c in rest:
                    v = int(table[s + c])
                    e += (v & 1) + (v >> 1 & 1)
                    s = v >> 2
                ended[i, j] += e
                state[i, j] = s
        open_phrase = state != self.starts[None, :]
        out[order] = ended + open_phrase
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        good = [i for i, t in enumerate(texts) if t and self.names and any(map(str.isalpha, t))]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not good:
            return names, scores
        phrases = self.counts([texts[i] for i in good])
        size = np.array([len(texts[i]) for i in good])
        rate = phrases * np.log2(size + 1)[:, None] / size[:, None]
        best = rate.argmin(axis=1)
        for row, i in enumerate(good):
            others = np.delete(rate[row], best[row])
            names[i] = self.names[best[row]]
            scores[i] = float(1 - rate[row, best[row]] / others.min()) if len(others) else 1.0
        return names, scores


def identify(df: DataFrame, sample: Sample, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """All rows of `df` with the predicted language and its score: 1 - best rate / second rate."""
    df = df.drop(lang_out, score_out)
    # at most FULL_LANGUAGES * SAMPLE_CHARACTERS characters
    shipped = df.sparkSession.sparkContext.broadcast(sample)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(shipped.value)  # made by each task, so that a worker doesn't hold it through later stages
        for batch in slices(batches, text):
            names, scores = parser.predict(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             [*batch.schema.names, lang_out, score_out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())]))


def fold_number(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Null for a null id: such a row is neither learned from nor held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds
