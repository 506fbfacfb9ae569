"""Token counts by dynamic programming over the matches of a vocabulary, without making the tokens."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docveil.llm.words import slices

#: What stands for a space, and begins each word.
MARK = "▁"
#: By so much an unknown character scores below the lowest piece.
UNKNOWN_PENALTY = 10.0
#: Characters of the words whose counts a worker remembers before it starts anew, and pairs of pieces likewise.
REMEMBERED, PAIRS = 1 << 25, 1 << 20

#: A vocabulary file's path; a parameter of the query.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with scores; merges: scores rank the merges of a byte-pair vocabulary, else they are logarithms of unigram probabilities.

    bytes: unknown characters count as their UTF-8 bytes, else a run of them as one.
    """

    pieces: list[tuple[str, float]]
    merges: bool = False
    bytes: bool = False


def load_pieces(path: str = PIECES) -> Vocabulary:
    """The vocabulary of a sentencepiece file, without control pieces and bytes, which no text matches."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as model_pb2

    model, spec = sentencepiece.SentencePieceProcessor(model_file=path), model_pb2.ModelProto()
    with open(path, "rb") as f:
        spec.ParseFromString(f.read())
    special = lambda k: model.is_byte(k) or model.is_control(k) or model.is_unknown(k)
    pieces = [(model.id_to_piece(k), model.get_score(k)) for k in range(model.get_piece_size()) if not special(k)]
    return Vocabulary(pieces, spec.trainer_spec.model_type == spec.trainer_spec.BPE, spec.trainer_spec.byte_fallback)


def merged(word: str, rank: dict[str, float]) -> list[str]:
    """The pieces that merging leaves: always the neighbours of the best-ranked joint piece, of equal ones the leftmost."""
    parts, after, before = list(word), list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    heap: list[tuple[float, int, int, str]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < len(parts) and (s := rank.get(parts[i] + parts[j])) is not None:
            heapq.heappush(heap, (-s, i, j, parts[i] + parts[j]))

    for i in range(len(parts) - 1):
        offer(i)
    while heap:
        _, i, j, joint = heapq.heappop(heap)
        if not parts[i] or not parts[j] or after[i] != j or parts[i] + parts[j] != joint:
            continue
        parts[i], parts[j] = joint, ""
        after[i] = after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [p for p in parts if p]


class _Counts(dict):
    """Counts of words, by what follows their first mark; each is worked out when it is first asked for."""

    def __init__(self, counter: Counter):
        self.counter, self.held = counter, 0

    def __missing__(self, word: str) -> int:
        if self.held > REMEMBERED:
            self.clear()
            self.held = 0
        n = self[word] = self.counter.pieces_of(MARK + word)
        self.held += len(word) + 64
        return n


class Counter:
    """Counts the pieces of a word's segmentation; only scores and counts are carried along, never the pieces.

    The automaton names all pieces that end at a position, the longest first. For a unigram
    vocabulary best[e] is the highest sum of scores up to e; of equal sums the one whose last piece
    is longer is kept, and an unknown character, possible only where no piece is just that
    character, comes last. For a byte-pair vocabulary sums of scores say nothing: there the segmentation up to e ends in the one piece that
    merging leaves apart from the piece before it, which is a property of these two pieces alone.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.rank, self.merges, self.bytes = dict(vocabulary.pieces), vocabulary.merges, vocabulary.bytes
        self.automaton = ahocorasick.Automaton()
        # A piece that merging never makes is none.
        self.pieces = [p for p in self.rank if not self.merges or merged(p, self.rank) == [p]]
        for k, piece in enumerate(self.pieces):
            self.automaton.add_word(piece, (k, len(piece)) if self.merges else (piece, float(self.rank[piece])))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()
        self.unknown = min(self.rank.values(), default=0.0) - UNKNOWN_PENALTY
        self.seen = _Counts(self)
        #: For each piece, by number, which pieces stay apart from it behind it.
        self.apart: list[dict[int, bool] | None] = [None] * len(self.pieces)
        self.pairs = 0

    def _matches(self, word: str) -> list[list[tuple[str, float]]]:
        ends: list[list[tuple[str, float]]] = [[] for _ in word]
        if not self.empty:
            for end, hit in self.automaton.iter(word):
                ends[end].append(hit)
        return ends

    def _unknown_size(self, c: str, follows: bool) -> int:
        return len(c.encode("utf-8", "surrogatepass")) if self.bytes else int(not follows)

    def _best_sum(self, word: str) -> int:
        ends, size = self._matches(word), len(word)
        best, count, unknown = [0.0] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        for e in range(1, size + 1):
            top, n, odd, single = None, 0, False, False
            for piece, score in ends[e - 1]:
                made = best[e - len(piece)] + score
                if top is None or made > top:
                    top, n = made, count[e - len(piece)] + 1
                single = single or len(piece) == 1
            if not single:
                made = best[e - 1] + self.unknown
                if top is None or made > top:
                    top, n, odd = made, count[e - 1] + self._unknown_size(word[e - 1], unknown[e - 1]), True
            best[e], count[e], unknown[e] = top, n, odd
        return count[size]

    def _stay_apart(self, left: int, right: int) -> bool:
        if self.pairs > PAIRS:
            for row in self.apart:
                if row is not None:
                    row.clear()
            self.pairs = 0
        one, two = self.pieces[left], self.pieces[right]
        known = self.apart[left][right] = merged(one + two, self.rank) == [one, two]
        self.pairs += 1
        return known

    def _by_merges(self, word: str) -> int:
        size, apart = len(word), self.apart
        last = [-1] * (size + 1)  # -1: the start, or an unknown character
        rows: list[dict[int, bool] | None] = [None] * (size + 1)
        count, done = [0] * (size + 1), 0

        def skip(to: int) -> None:
            for e in range(done + 1, to + 1):
                count[e] = count[e - 1] + self._unknown_size(word[e - 1], e > 1 and last[e - 1] < 0)

        for end, (piece, long) in () if self.empty else self.automaton.iter(word):
            if end < done:
                continue
            if end > done:
                skip(end)
                done = end
            at = end + 1 - long
            row = rows[at]
            if row is not None:
                fits = row.get(piece)
                if fits is None:
                    fits = self._stay_apart(last[at], piece)
                if not fits:
                    continue
            done = end + 1
            row = apart[piece]
            if row is None:
                row = apart[piece] = {}
            last[done], rows[done], count[done] = piece, row, count[at] + 1
        skip(size)
        return count[size]

    def pieces_of(self, word: str) -> int:
        return self._by_merges(word) if self.merges else self._best_sum(word)

    def tokens(self, text: str | None) -> int:
        """Pieces of a whole text: spaces become marks, one is put in front, words begin at marks."""
        if not text:
            return 0
        seen, lead = self.seen, text[:1]
        if lead != " " and lead != MARK and "" not in (plain := text.replace(MARK, " ").split(" ")):
            return sum(map(seen.__getitem__, plain))
        return sum(seen[word[1:]] for word in split_marks(text, runs=self.merges))


#: The vocabulary that a worker's tasks were last given, and its counter.
_HELD: list[tuple[Vocabulary, Counter]] = []


def counter_of(vocabulary: Vocabulary) -> Counter:
    """The vocabulary's counter: one task of a worker after the other takes it over with what it remembers."""
    if not _HELD or _HELD[0][0] is not vocabulary:
        _HELD[:] = [(vocabulary, Counter(vocabulary))]
    return _HELD[0][1]


def split_marks(text: str, runs: bool) -> Iterator[str]:
    """Words of a text, each with the mark it begins with; with runs, marks that follow each other belong to the next word.

    Runs stay whole for byte-pair vocabularies, which have pieces of several marks. Without runs, a text
    that begins with a mark gets no other.
    """
    whole = text.replace(" ", MARK)
    if runs or not whole.startswith(MARK):
        whole = MARK + whole
    first, *rest = whole.split(MARK)
    if first:
        yield first
    marks = MARK
    for k, word in enumerate(rest):
        if runs and not word and k < len(rest) - 1:
            marks += MARK
            continue
        yield marks + word
        marks = MARK


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, n_chars) for every row; null and empty texts have no tokens.

    The vocabulary comes from a file of fixed size and is sent to the workers
    once. A word's count depends on the word alone, so each is worked out once while a worker remembers it; what it
    remembers is bounded by characters, and a text without any space is one word, which takes memory in proportion to its length. Repeated rows come back as often;
    other columns are not read; an empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(sent.value)
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array([counter.tokens(t) for t in texts], pa.int64()), pa.array([len(t or "") for t in texts], pa.int64())], [key, "n_tokens", "n_chars"])

    return docs.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text")).mapInArrow(run, f"{key} long, n_tokens long, n_chars long")
