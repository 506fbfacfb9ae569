"""Names of persons, places and organisations: a structured perceptron over words, trained on what rules are sure of.

Rules label words next to titles, company forms and postal codes. Sentences in which they leave no capital
unexplained train a first-order model; its weights are averaged over parts of the training set after each round, and decoded by
Viterbi over whole texts in batches. The model lives in one array of fixed size, which is what is sent.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docveil.functions import entities as E
from docveil.functions.text import TITLES
from docveil.operators.resolve import PARTIES, PROFESSIONAL

KINDS = (E.PERSON, E.LOCATION, E.ORGANIZATION)
#: 0 is outside; 1, 3, 5 begin a name of a kind, 2, 4, 6 go on with it.
TAGS = 1 + 2 * len(KINDS)
#: Rows of the weights' table that features are hashed into.
BUCKETS = 1 << 18
#: Parts of the training set, rounds over it, and texts that it takes at most (those of least hash).
PARTS, ROUNDS, MOST_TEXTS = 8, 6, 1 << 14
#: Sentences that are decoded together, and that are learnt from together: the fewer, the less a round goes too far.
BATCH, LEARNT = 64, 4
#: Characters of the texts whose sentences are decoded together; sentences and words that a task remembers, and the most words of such a sentence.
TOGETHER, KNOWN, LONGEST = 1 << 16, 1 << 15, 64
#: By so much a right tag must be ahead of a wrong one before a sentence counts as learnt.
MARGIN = 4.0
#: Score of a name that the model finds (own choice).
NAME_SCORE = 0.85
#: Company forms that follow a name (own choice).
FORMS = frozenset("a/s aps i/s k/s p/s amba smba ivs ltd ltd. inc inc. gmbh plc llc ag".split())
_TITLES = frozenset(t.lower() for t in (*PROFESSIONAL, *PARTIES, *"hr. fru frk. frøken dr. prof. mr. mrs. ms. advokatfuldmægtig".split())) | {"advokat", "adv."}
_TOKEN = regex.compile(r"(?i)(?:" + TITLES + r"|[ai]/s|k/s|p/s|mr\.|mrs\.|ms\.|ltd\.|inc\.)(?![\w])|\p{L}[\p{L}\p{M}'’-]*|\p{N}+|[^\s\w]|_")
_END = frozenset(".!?")


@dataclass
class Sentence:
    """Tokens of a sentence with their places in the text."""

    words: list[str]
    starts: list[int]
    ends: list[int]


def sentences(text: str) -> Iterator[Sentence]:
    """Runs of tokens up to a line's end, or a stop before a capital."""
    words, starts, ends = [], [], []
    for m in _TOKEN.finditer(text):
        if words and ("\n" in text[ends[-1] : m.start()] or (words[-1] in _END and m[0][:1].isupper())):
            yield Sentence(words, starts, ends)
            words, starts, ends = [], [], []
        words.append(m[0])
        starts.append(m.start())
        ends.append(m.end())
    if words:
        yield Sentence(words, starts, ends)


def _shape(word: str) -> str:
    if word.isdigit():
        return f"9{min(len(word), 5)}"
    if not word[:1].isalpha():
        return word[:1]
    return "A" if len(word) == 1 and word.isupper() else "AA" if word.isupper() else "Aa" if word[0].isupper() else "a"


#: So many features of a token, the first ones, are of itself alone.
OWN = 6


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode()) % BUCKETS


@lru_cache(KNOWN)
def _own(word: str, shape: str, first: bool) -> list[int]:
    return [_bucket(x) for x in (f"w{word}", f"f{first}|{shape}", f"b{word[:3]}", *(f"e{word[-n:]}|{shape}" for n in (2, 3, 4)))]


def features(s: Sentence) -> np.ndarray:
    """Buckets of the features of each token: its letters, its ends, and its neighbours."""
    low, shape = ["^", "^", *(w.lower() for w in s.words), "$", "$"], ["^", *(_shape(w) for w in s.words), "$"]
    rows = []
    for k in range(len(s.words)):
        before, own, after = shape[k : k + 3]
        left, right = f"{low[k + 1]}|{own}", f"{own}|{low[k + 3]}"
        around = _bucket(f"l{left}"), _bucket(f"r{right}"), _bucket(f"c{before}|{own}|{after}"), _bucket(f"L{low[k]}|{left}"), _bucket(f"R{right}|{low[k + 4]}")
        rows.append([*_own(low[k + 2], own, k == 0), *around])
    return np.array(rows, np.int32)


def weak_tags(s: Sentence) -> list[int] | None:
    """Tags that rules are sure of; null if a capital inside the sentence is left over."""
    n, tags = len(s.words), [0] * len(s.words)
    low, capital = [w.lower() for w in s.words], [w[:1].isupper() and w.lower() not in _TITLES | FORMS for w in s.words]

    def put(a: int, b: int, kind: int) -> None:
        tags[a:b] = [1 + 2 * kind] + [2 + 2 * kind] * (b - a - 1)

    k = 0
    while k < n:
        end = k
        while end < n and capital[end]:
            end += 1
        if end == k:
            k += 1
            continue
        if k and low[k - 1] in _TITLES:
            put(k, end, 0)
        elif end < n and low[end] in FORMS:
            put(k, end, 2)
        elif k and s.words[k - 1].isdigit() and len(s.words[k - 1]) == 4:
            put(k, end, 1)
        elif k or end - k > 1:
            return None
        k = end
    return tags


def without_cues(s: Sentence, tags: list[int]) -> tuple[Sentence, list[int]] | None:
    """The sentence as it would be without the titles, company forms and numbers that told its names; null if there are none.

    A model that saw only sentences with them would learn them and nothing of the names.
    """
    cue = [False] * len(tags)
    for k, t in enumerate(tags):
        if t and t % 2 and k and (s.words[k - 1].lower() in _TITLES or s.words[k - 1].isdigit()):
            cue[k - 1] = True
        if not t and k and tags[k - 1] and s.words[k].lower() in FORMS:
            cue[k] = True
    if not any(cue):
        return None
    left = [k for k in range(len(tags)) if not cue[k]]
    return Sentence(*([x[k] for k in left] for x in (s.words, s.starts, s.ends))), [tags[k] for k in left]


def shortened(s: Sentence, tags: list[int], last: bool) -> tuple[Sentence, list[int]]:
    """The sentence with only the first, or the last, word of each person's name: people are called by one of them too."""
    left = [k for k, t in enumerate(tags) if t not in (1, 2) or (k + 1 == len(tags) or tags[k + 1] != 2 if last else t == 1)]
    return Sentence(*([x[k] for k in left] for x in (s.words, s.starts, s.ends))), [1 if tags[k] == 2 else tags[k] for k in left]


class Model:
    """Weights of features and of pairs of neighbouring tags; the last row of steps is the beginning."""

    def __init__(self, table: np.ndarray | None = None, steps: np.ndarray | None = None):
        self.table = np.zeros((BUCKETS, TAGS), np.float64) if table is None else table
        self.steps = np.zeros((TAGS + 1, TAGS), np.float64) if steps is None else steps

    def decode(self, found: list[np.ndarray], wanted: list[np.ndarray] | None = None) -> list[np.ndarray]:
        """Best tags of sentences, given by their features: Viterbi, many sentences at a time, equal sums to the lower tag. With wanted, other tags than these get MARGIN more."""
        banned = np.zeros((TAGS + 1, TAGS))
        for k in range(len(KINDS)):
            inner = 2 + 2 * k
            banned[:, inner] = -1e9
            banned[[inner - 1, inner], inner] = 0
        steps, out = self.steps + banned, [None] * len(found)
        order = sorted(range(len(found)), key=lambda k: len(found[k]))
        for low in range(0, len(order), BATCH):
            part = order[low : low + BATCH]
            sizes = np.array([len(found[k]) for k in part])
            longest = sizes.max(initial=0)
            gain = np.zeros((len(part), longest, TAGS))
            for row, k in enumerate(part):
                gain[row, : sizes[row]] = self.table[found[k]].sum(1)
                if wanted is not None:
                    gain[row, : sizes[row]] += MARGIN
                    gain[row, np.arange(sizes[row]), wanted[k]] -= MARGIN
            best, back = steps[-1] + gain[:, 0], np.zeros((len(part), longest, TAGS), np.int8)
            for t in range(1, longest):
                each = best[:, :, None] + steps[:-1]
                back[:, t] = each.argmax(1)
                best = np.where((t < sizes)[:, None], each.max(1) + gain[:, t], best)
            tag = best.argmax(1)
            for row, k in enumerate(part):
                tags, now = np.zeros(sizes[row], np.int64), tag[row]
                for t in range(sizes[row] - 1, -1, -1):
                    tags[t] = now
                    now = back[row, t, now] if t else now
                out[k] = tags
        return out

    def learn(self, found: list[np.ndarray], wanted: list[np.ndarray]) -> int:
        """One round over sentences in batches: what was wrong loses weight, what was right gains it. Returns how many sentences were wrong."""
        wrong = 0
        for low in range(0, len(found), LEARNT):
            part, tags_of = found[low : low + LEARNT], wanted[low : low + LEARNT]
            for x, got, want in zip(part, self.decode(part, tags_of), tags_of, strict=True):
                if not np.array_equal(got, want):
                    wrong += 1
                    for tags, sign in ((want, 1.0), (got, -1.0)):
                        np.add.at(self.table, (x, tags[:, None]), sign)
                        np.add.at(self.steps, (np.concatenate(([TAGS], tags[:-1])), tags), sign)
        return wrong


_TRAINED = "row int, tag int, weight double"


def _turn(sent):
    """What a part of the training set adds to the weights that were sent."""

    def turn(group: pa.Table) -> pa.Table:
        own, found, wanted = Model(*(x.copy() for x in sent.value)), [], []
        for _, text in sorted(zip(group.column("h").to_pylist(), group.column("text").to_pylist(), strict=True)):
            for s in sentences(text):
                if tags := weak_tags(s):
                    bare = without_cues(s, tags)
                    whole = [x for x in ((s, tags), bare) if x]
                    parts = [shortened(*x, last) for x in whole for last in (False, True)] if 2 in tags else []
                    for x, y in (*parts, *whole):
                        found.append(features(x))
                        wanted.append(np.array(y))
                    if bare:  # the words by themselves, so that names count for more than what surrounds them here
                        found.append(found[-1][:, :OWN])
                        wanted.append(wanted[-1])
        own.learn(found, wanted)
        moved = np.concatenate((own.table - sent.value[0], own.steps - sent.value[1]))
        at = np.nonzero(moved)
        return pa.table({"row": pa.array(at[0], pa.int32()), "tag": pa.array(at[1], pa.int32()), "weight": pa.array(moved[at], pa.float64())})

    return turn


def train(pages: DataFrame, parts: int = PARTS, rounds: int = ROUNDS, most: int = MOST_TEXTS) -> Model:
    """A model of the sentences of pages(text) that weak_tags() settles, from at most so many texts, those whose hash is least.

    Each round starts from the mean of what the parts have learnt so far and gives each part a turn; the result is the mean of all
    rounds. Parts and their order depend on the texts alone. At most BUCKETS times TAGS numbers come to the driver in a round.
    """
    chosen = pages.select("text").where("text IS NOT NULL").distinct().withColumn("h", F.xxhash64("text")).orderBy("h", "text").limit(most)
    dealt = chosen.withColumn("part", F.pmod("h", F.lit(parts))).persist()
    spark, model, sums = pages.sparkSession, Model(), Model()
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((model.table, model.steps))
        moves = dealt.groupBy("part").applyInArrow(_turn(sent), _TRAINED).groupBy("row", "tag").agg(F.sum("weight").alias("weight")).toArrow()
        sent.destroy()
        rows, tags, weights = (moves.column(c).to_numpy() for c in ("row", "tag", "weight"))
        inner = rows < BUCKETS
        np.add.at(model.table, (rows[inner], tags[inner]), weights[inner] / parts)
        np.add.at(model.steps, (rows[~inner] - BUCKETS, tags[~inner]), weights[~inner] / parts)
        sums.table += model.table
        sums.steps += model.steps
    dealt.unpersist()
    return Model(sums.table / rounds, sums.steps / rounds)


def _together(texts: pa.Array) -> Iterator[list[str]]:
    """The texts, null ones empty, so many at a time that what is made of them stays small."""
    held, size = [], 0
    for x in texts:
        held.append(x.as_py() or "")
        size += len(held[-1]) + 1
        if size > TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def _tagger(sent):
    kind = pa.struct([("entity", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())])

    known: dict[tuple[str, ...], list[int]] = {}

    def tag(texts: pa.Array) -> pa.Array:
        model, out = Model(*sent.value), []
        for whole in _together(texts):
            held = [[(s, tuple(s.words)) for s in sentences(text)] for text in whole]
            if len(known) > KNOWN:
                known.clear()
            # Tags depend on a sentence's words alone, so each is decoded once while it is remembered.
            new = {words: s for found in held for s, words in found if words not in known}
            now = dict(zip(new, (tags.tolist() for tags in model.decode([features(s) for s in new.values()])), strict=True))
            known.update((words, tags) for words, tags in now.items() if len(words) <= LONGEST)
            for text, found in zip(whole, held, strict=True):
                names = []
                for s, words in found:
                    for k, t in enumerate(known[words] if words in known else now[words]):
                        if t and t % 2:
                            names.append([KINDS[t // 2], s.starts[k], s.ends[k]])
                        elif t:
                            names[-1][2] = s.ends[k]
                out.append([{"entity": e, "start": a, "end": b, "value": text[a:b]} for e, a, b in names])
        return pa.array(out, pa.list_(kind))

    return tag


def tag_names(pages: DataFrame, model: Model) -> DataFrame:
    """Spans of names in pages(page_uid, text): (page_uid, entity, start, end, value, score). Whole texts are read once and not moved; null texts have none."""
    sent = pages.sparkSession.sparkContext.broadcast((model.table, model.steps))
    tag = F.arrow_udf(_tagger(sent), "array<struct<entity:string,start:int,end:int,value:string>>")
    found = pages.select("page_uid", F.explode(tag("text")).alias("s"))
    return found.select("page_uid", "s.*", F.lit(NAME_SCORE).alias("score"))
