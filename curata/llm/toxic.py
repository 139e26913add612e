"""Problem 9: abusive, hateful or sexual content, by a linear model of character n-grams.

Sentences are scored, not whole texts, since one sentence suffices. Features are character 1- to 5-grams scaled by
naive Bayes log-count ratios of each kind against the rest; a logistic model over them gives each kind's score.
Labelled text is (1) written sentences of each kind and harmless look-alikes, (2) the corpus' sentences that
neither reviews nor the model speak against, and (3) those that look both like (1) and like what sets
marked documents apart (reviewers mark documents, not sentences, and err). All documents and all reviews take part:
the sentences of the corpus are tallied, equal but for names, and tasks learn from parts of them.

Disguises are undone first: signs between single letters, digits for letters, stretched letters, invisible signs.

Cases: NULL and empty texts have score 0 and no kind; duplicate and disagreeing reviews count as their majority.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm.common import map_batches, source_key
from curata.llm.ngrams import grams, linear
from curata.llm.toxic_seeds import sentences
from curata.plans.lineage import cut

KINDS = ("abuse", "hate", "sexual")
#: Power of the ratio of harmless to other weight by which the others weigh more.
BALANCE = 0.7
#: Weight of a written sentence; one of the corpus has the root of its documents' number, of this number at most.
SEED_WEIGHT, HEAVIEST = 2.0, 50
#: Frames (sentences but for names) that one task learns from, about.
PART_FRAMES = 16_000
#: A frame has so many words besides names.
FRAME_WORDS = 4
#: A task keeps the keys of so many sentences.
KEPT = 200_000
#: Of reviewed documents with an abusive sentence, about so many are marked. What a sentence's own reviews say counts by itself from so much.
HIT, TOLD = 0.9, 4.0
#: Harmless rows that no model so far gives this probability are taken in turns: so many a step at least, in so many slices at most.
UNSURE, SLICE_ROWS, SLICES = 0.02, 1500, 10
ORDERS, BITS = (1, 2, 3, 4, 5), 18
#: Steps of the fit, smoothing of the ratios, penalty.
STEPS, SMOOTH, PENALTY = 30, 0.5, 2e-4
#: Least absolute log-count ratio of an n-gram that counts.
LEAST_RATIO = 0.3
#: A sentence is of a kind from this probability.
THRESHOLD = 0.2
#: Fits, each with the examples of the one before.
ROUNDS = 4
#: The fit gathers about so many values at a time.
RUN = 1 << 15

_INVISIBLE = re.compile("[​-‏⁠﻿­]")
#: Single letters set off by one sign each: s-p-a-c-e-d, s p a c e d.
_SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:([ \-._·])[^\W\d_])(?:\1[^\W\d_])+(?![^\W_])")
_LEET_WORD = re.compile(r"(?<![^\W_])(?=[^\s]*[^\W\d_][^\s]*[^\W\d_])[a-zß-ɏ0-9@$!|]*(?:[a-zß-ɏ][0134578@$!|]|[0134578@$!|][a-zß-ɏ])[a-zß-ɏ0-9@$!|]*[a-zß-ɏ0-9@$]")
_LEET = str.maketrans("0134578@$!|", "oieastbasil")
_MASK = re.compile(r"[.*_#·•](?<=[^\W\d_][.*_#·•])(?=[^\W\d_])")
#: What every match of ``_SPACED`` and of ``_LEET_WORD`` holds; patterns that begin with few signs are found fast.
_SET_OFF = re.compile(r"[ \-._·](?<=[^\W\d_].)[^\W\d_][ \-._·][^\W\d_]")
_LEET_SIGN = re.compile(r"[0134578@$!|](?:[a-zß-ɏ]|(?<=[a-zß-ɏ].))")
#: Words that mix Latin letters with Cyrillic look-alikes.
_MIXED = re.compile(r"(?<![^\W_])(?=[а-яіѕј]*[a-z])(?=[a-z]*[а-яіѕј])[a-zа-яіѕј]+")
_LOOKALIKE = str.maketrans("аеорсухкмтвніѕј", "aeopcyxkmtbhisj")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
_SPLIT = re.compile(
    r"[!?。！？;；\n\r.\[`<](?:(?<=[!?。！？;；\n\r])[!?。！？;；\n\r]*|(?<=\.)(?:(?<![^\W\d_]\.)\.*|\.*(?![^\W\d_]))"
    r"|(?<=\[)/?[A-Za-z]+[^\]\n]*\]|(?<=`)``|(?<=<)/?[A-Za-z]+[^<>\n]*>)"
)
#: Numbers by themselves or before a single letter; any number.
_NUMBER = re.compile(r"\d(?<![^\W_]\d)\d*(?:[.,]\d+)*(?=[^\W\d_]?(?![^\W_]))")
#: The same for ASCII.
_PLAIN_NUMBER = re.compile(r"[0-9](?<![^\W_][0-9])[0-9]*(?:[.,][0-9]+)*(?=[^\W\d_]?(?![^\W_]))")
_TITLE = re.compile(r"(?<![^\W_])[A-ZÀ-ÞА-Я][a-zß-ÿа-я]+(?![^\W_])")
_WORD = re.compile(r"[^\W\d_]{2,}")
_DIGITS = re.compile(r"\d+(?:[.,]\d+)*")
_SPACE = re.compile(r"[^\S\x1c-\x1f\n]+")


def rough(joined: str) -> str:
    """Lower case without invisible signs; numbers that aren't part of a word as 0."""
    if joined.isascii():
        return _PLAIN_NUMBER.sub("0", joined.lower())
    return _NUMBER.sub("0", unicodedata.normalize("NFKC", _INVISIBLE.sub("", joined)).lower())


def undisguised(sentence: str) -> str:
    """A sentence, roughened first, with all disguises undone."""
    return cleared_up(rough(sentence))


def cleared_up(t: str, stretched: bool = True) -> str:
    """A rough sentence with look-alikes, spacing inside words, digits for letters and stretched letters undone.

    ``stretched``: whether ``t`` may hold a sign thrice in a row.
    """
    given = t
    if not t.isascii():
        t = _MIXED.sub(lambda m: m.group().translate(_LOOKALIKE), t)
    if _SET_OFF.search(t):
        t = _SPACED.sub(lambda m: m.group().replace(m.group(1), ""), t)
    if _LEET_SIGN.search(t):
        t = _LEET_WORD.sub(lambda m: m.group().translate(_LEET), t)
    stretched = stretched or t != given
    t = _MASK.sub("*", t)
    if stretched:
        t = _STRETCHED.sub(r"\1", t)
    t = _DIGITS.sub("0", t)
    if " ".join(t.split()) != t:
        t = _SPACE.sub(" ", t)
    return t.strip(" -*#>:,'\"()")


def all_cleared_up(rough_: list[str]) -> list[str]:
    """``cleared_up`` of each, equal ones once."""
    each = dict.fromkeys(rough_)
    if not each:
        return []
    codes = np.frombuffer("\x1d".join(each).encode("utf-32-le", "surrogatepass"), np.uint32)
    thrice = np.flatnonzero((codes[2:] == codes[1:-1]) & (codes[1:-1] == codes[:-2]))
    ends = np.cumsum(np.fromiter(map(len, each), np.int64, len(each)) + 1)
    stretched = np.zeros(len(each), bool)
    stretched[np.searchsorted(ends, thrice, "right")] = True
    for t, x in zip(each, stretched.tolist()):
        each[t] = cleared_up(t, x)
    return [each[t] for t in rough_]


def rough_units(texts: list[str | None]) -> list[list[str]]:
    """The rough sentences of each text. A full stop inside a word is a hidden letter, not an end."""
    joined = rough("\x1d".join((t or "").replace("\x1d", " ") for t in texts))
    return [_SPLIT.split(t) for t in joined.split("\x1d")]


def units(texts: list[str | None]) -> list[list[str]]:
    """The undisguised sentences of each text."""
    return [[x for u in us if len(x := cleared_up(u)) > 1] for us in rough_units(texts)]


def cased_units(texts: list[str | None]) -> list[list[str]]:
    """The sentences of each text as written but for invisible signs and numbers."""
    out = []
    for t in texts:
        t = (t or "").replace("\x1d", " ")
        if t.isascii():
            t = _PLAIN_NUMBER.sub("0", t)
        else:
            t = _NUMBER.sub("0", unicodedata.normalize("NFKC", _INVISIBLE.sub("", t)))
        out.append([x for u in _SPLIT.split(t) if len(x := u.strip()) > 1])
    return out


def framed(sentences_: list[str]) -> list[tuple[str, str]]:
    """Cased sentences undisguised, each with its frame: without capitalised words (names), if enough other words are left to know it by."""
    texts = all_cleared_up([rough(s) for s in sentences_])
    bare = [_TITLE.sub("§", s) for s in sentences_]
    frames_ = all_cleared_up([rough(s) for s in bare])
    known = {f: len(_WORD.findall(f)) >= FRAME_WORDS for f in set(frames_)}
    return [(t, f if known[f] else t) for t, f in zip(texts, frames_)]


def word_counts(sentences_: list[str]) -> dict[str, int]:
    """Words without hidden letters, as often as they occur."""
    count: dict[str, int] = {}
    for s in sentences_:
        for w in s.split(" "):
            w = w.strip(",:;'\"()")
            if len(w) >= 3 and "*" not in w:
                count[w] = count.get(w, 0) + 1
    return count


def masks_of(count: dict[str, float]) -> dict[str, str]:
    """From a word with a hidden letter to the word; the more frequent one where several fit."""
    out: dict[str, str] = {}
    for w in sorted(count, key=lambda w: (count[w], w)):
        for k in range(len(w)):
            out[w[:k] + "*" + w[k + 1 :]] = w
    return out


def masks(sentences_: list[str]) -> dict[str, str]:
    return masks_of(word_counts(sentences_))


@dataclass
class Model:
    table: np.ndarray
    bias: np.ndarray
    hidden: dict[str, str] | None = None

    def unmasked(self, s: str) -> str:
        if "*" not in s or not self.hidden:
            return s
        return " ".join(w if "*" not in w else w.replace(x, self.hidden.get(x, x)) if (x := w.strip(",:;'\"()")) else w for w in s.split(" "))

    def probabilities(self, sentences_: list[str]) -> np.ndarray:
        total, n = linear([f" {self.unmasked(s)} " for s in sentences_], self.table, ORDERS, False)
        z = total / np.sqrt(np.maximum(n, 1))[:, None] + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Features:
    """The n-grams of many texts, each once a text."""

    start: np.ndarray
    feature: np.ndarray

    @staticmethod
    def of(texts: list[str]) -> Features:
        row, feature = grams([f" {t} " for t in texts], ORDERS, BITS, True)
        return Features(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))]), feature.astype(np.int32))

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``rows`` (ascending) and n-grams of these texts."""
        size = self.start[rows + 1] - self.start[rows]
        at = np.repeat(np.arange(len(rows)), size)
        return at, self.feature[np.arange(len(at)) + np.repeat(self.start[rows] - (np.cumsum(size) - size), size)]


class Sums:
    """Sums over groups of neighbouring entries of the values that the entries point to."""

    def __init__(self, index: np.ndarray, size: np.ndarray):
        self.index, self.size = index, size
        self.filled = np.flatnonzero(size)
        self.start = np.cumsum(size[self.filled]) - size[self.filled]
        # a run of groups at a time, so that what is gathered stays in the processor's cache
        first = np.flatnonzero(np.diff(self.start // RUN, prepend=-1))
        self.runs = list(zip(first.tolist(), [*first[1:].tolist(), len(self.start)]))

    def __call__(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.filled))
        for i, j in self.runs:
            a, b = self.start[i], self.start[j] if j < len(self.start) else len(self.index)
            out[i:j] = np.add.reduceat(values.take(self.index[a:b]), self.start[i:j] - a)
        if len(out) == len(self.size):
            return out
        whole = np.zeros(len(self.size))
        whole[self.filled] = out
        return whole


def both_ways(row: np.ndarray, column: np.ndarray, rows: int, columns: int) -> tuple[Sums, Sums]:
    """Of a matrix of zeros and ones (``row`` ascending) the sums over rows and the sums over columns."""
    key = np.sort((column.astype(np.int64) << 32) | row)
    return Sums(column, np.bincount(row, minlength=rows)), Sums(key & 0xFFFFFFFF, np.bincount(column, minlength=columns))


def alike(row: np.ndarray, feature: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams that occur, the group of each, and one n-gram of each group: those of a group occur in the same rows."""
    rng, bits = np.random.default_rng(1), 52 - int(rows).bit_length()
    # sums of whole numbers below 2^53 are exact in any order; equal ones twice are equal sets of rows
    a, b = (np.bincount(feature, rng.integers(1, 1 << bits, rows).astype(float)[row], 1 << BITS) for _ in range(2))
    used = np.flatnonzero(a)
    order = np.lexsort((b[used], a[used]))
    a, b = a[used][order], b[used][order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(used)]
    group = np.empty(len(used), np.int64)
    group[order] = np.cumsum(new) - 1
    return used, group, used[order[new]]


def fit(texts: Features, rows: np.ndarray, kind: np.ndarray, weight: np.ndarray, easy: np.ndarray | None = None) -> tuple[Model, np.ndarray]:
    """A model and each n-gram's weight in the rows; ``kind``: number of the kind, -1 for none; ``weight`` of each row.

    The ratios count all rows. A step of the fit takes all rows but ``easy`` ones, of which the steps take a slice in turns.
    N-grams of the same rows have the same ratio and the same weight after each step, so they are fitted as one that counts for all.
    """
    row, feature = texts.take(rows)
    count = np.maximum(np.bincount(row, minlength=len(rows)), 1)
    often = np.bincount(feature, minlength=1 << BITS) > 1  # an n-gram of one text says nothing about others
    row, feature = row[often[feature]], feature[often[feature]]
    mass = np.bincount(feature, weight[row], 1 << BITS)
    used, group, first = alike(row, feature, len(rows))
    many = np.bincount(group, minlength=len(first))
    place_of = np.full(1 << BITS, -1)
    place_of[first] = np.arange(len(first))
    local = place_of[feature]
    row, local = row[local >= 0], local[local >= 0]
    root = np.sqrt(count)
    whole = both_ways(row, local, len(rows), len(first))
    table, bias = np.zeros((1 << BITS, len(KINDS)), np.float32), np.zeros(len(KINDS))
    for k in range(len(KINDS)):
        y = (kind == k).astype(float)
        if not y.any():
            bias[k] = -10.0
            continue
        pos, neg = whole[1](y * weight) + SMOOTH, whole[1]((1 - y) * weight) + SMOOTH
        # log-count ratio of shares
        ratio = np.log((pos / ((y * weight).sum() + 2 * SMOOTH)) / (neg / (((1 - y) * weight).sum() + 2 * SMOOTH)))
        # n-grams about as frequent in both say nothing
        tells = np.where(np.abs(ratio) >= LEAST_RATIO, ratio, 0)
        turns = np.zeros(len(rows), bool) if easy is None else easy & (y == 0)
        slices = int(np.clip(turns.sum() // SLICE_ROWS, 1, SLICES))
        part = np.where(turns, (np.cumsum(turns) - 1) % slices, -1)
        balance = weight * np.where(y > 0, ((1 - y) * weight).sum() / max((y * weight).sum(), 1e-9), 1.0) ** BALANCE
        balance = balance / balance.sum() * np.where(turns, slices, 1)
        batches = [(whole, root, balance, y)]
        if slices > 1:
            batches = []
            for n in range(slices):
                mine = np.flatnonzero((part < 0) | (part == n))
                place = np.full(len(rows), -1)
                place[mine] = np.arange(len(mine))
                at = place[row] >= 0
                batches.append((both_ways(place[row[at]], local[at], len(mine), len(first)), root[mine], balance[mine], y[mine]))
        w, b = np.full(len(first), 0.3), -1.0
        g2, gb2 = np.full(len(first), 1e-8), 1e-8
        for step in range(STEPS):
            (by_row, by_column), size, share, true = batches[step % slices]
            z = by_row(many * tells * w) / size + b
            d = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - true)
            g = tells * by_column(d / size) + PENALTY * (w - 0.3) / len(used) ** 0.5
            g2 += g * g
            gb2 += d.sum() ** 2
            w -= 0.15 * g / np.sqrt(g2)
            b -= 0.5 * d.sum() / np.sqrt(gb2)
        table[used, k] = (w * tells)[group]
        bias[k] = b
    return Model(table, bias), mass


@dataclass
class Tallied:
    """Sentences of the corpus, one of each frame, with the documents that hold the frame: all, and reviewed ones by half and verdict."""

    texts: list[str]
    places: np.ndarray
    #: (sentence, half, verdict)
    reviews: np.ndarray


def _logit(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, 1e-4, 1 - 1e-4)
    return np.log(x / (1 - x))


def _weight(base: float) -> tuple[float, float]:
    """By how much a marked document, and an unmarked one, moves the log odds that a sentence in it is abusive."""
    base = min(max(base, 0.02), 0.5)
    return float(np.log(HIT / base)), float(np.log((1 - HIT) / (1 - base)))


def learn(pool: Tallied, base: float) -> tuple[Model, np.ndarray, list[str]]:
    """A model, its n-grams' weights and its examples, from sentences and their reviews; the written sentences start it off.

    ``kinds`` knows the written sentences alone and tells the kinds apart. ``evidence`` tells sentences of marked
    documents from those of unmarked ones, each half of the documents judged by the other half; ``said`` is what a
    sentence's own reviews say. A sentence is harmless if neither speaks against it, an example if they and the model do,
    and else left out. ``base`` is the share of marked documents.
    """
    seeds = [(undisguised(s), KINDS.index(k) if k else -1) for s, k in sentences()]
    n, m = len(seeds), len(pool.texts)
    texts = Features.of([s for s, _ in seeds] + pool.texts)
    seed_rows, seed_kind = np.arange(n), np.array([k for _, k in seeds])
    kinds, mass = fit(texts, seed_rows, seed_kind, np.ones(n))
    abusive = [s for s, k in seeds if k >= 0]
    hidden, examples, model = masks(abusive), [], kinds
    if not m:
        model.hidden = hidden
        return model, mass, abusive
    marks = pool.reviews.astype(float)
    judged = np.zeros((2, m))
    ready = [False, False]
    for half in (0, 1):
        good, bad = (np.flatnonzero(marks[:, half, v]) for v in (0, 1))
        if len(bad):
            rows, kind = np.concatenate([good, bad]), np.concatenate([np.full(len(good), -1), np.zeros(len(bad), int)])
            order = np.argsort(rows, kind="stable")
            weight = np.concatenate([marks[good, half, 0], marks[bad, half, 1]])
            judged[half] = fit(texts, rows[order] + n, kind[order], weight[order])[0].probabilities(pool.texts)[:, 0]
            ready[half] = True
    # a sentence is judged by the half that doesn't hold it, one of both or none by both
    holds = marks.sum(2) > 0
    by = np.array([holds[:, 1] | ~holds[:, 0], holds[:, 0] | ~holds[:, 1]]) & np.array(ready)[:, None]
    against = (judged * by).sum(0) / np.maximum(by.sum(0), 1)
    good, bad = marks[:, :, 0].sum(1), marks[:, :, 1].sum(1)
    odds = base / max(1 - base, 1e-9)
    # cleared by review: in several unmarked documents, and in marked ones not much more often than any sentence
    cleared = (good >= 2) & ((bad + 0.5) / (good + 0.5) < 4 * odds)
    neutral = max(base, float(np.quantile(against, 0.8)))  # few sentences are abusive
    against = np.where(cleared, np.minimum(against, neutral / 3), against)
    said = bad * _weight(base)[0] + good * _weight(base)[1]
    by_seeds = kinds.probabilities(pool.texts)
    unsure, weight = np.zeros(m), np.clip(pool.places, 1, HEAVIEST) ** 0.5
    for step in range(ROUNDS):
        p = model.probabilities(pool.texts) if step else by_seeds
        top = p.max(1)
        unsure = np.maximum(unsure, top)
        if step:
            likely = ~cleared & ((top > 0.1) | (said > TOLD) | ((said > 0) & (against > neutral))) & (_logit(top) + np.clip(_logit(against) - _logit(np.array(neutral)), -2.0, 2.0) + np.maximum(said, 0) > 0)
            # what looks abusive is harmless only if reviews say so
            calm = ~likely & (cleared | (said <= 0) & (((against < neutral) & (top < 0.1)) | (top < 0.02)))
        else:
            likely, calm = np.zeros(m, bool), cleared | ((said <= 0) & (against < neutral) & (top < 0.1))
        kind = np.where(likely, (by_seeds + p).argmax(1), -1)
        examples = [pool.texts[i] for i in np.flatnonzero(likely)]
        chosen = np.flatnonzero(likely | calm)
        of = np.where(likely, np.maximum(weight, 2.0), weight)[chosen]
        model, mass = fit(texts, np.concatenate([seed_rows, chosen + n]), np.concatenate([seed_kind, kind[chosen]]), np.concatenate([np.full(n, SEED_WEIGHT), of]), np.concatenate([np.zeros(n, bool), unsure[chosen] < UNSURE]))
        model.hidden = masks(abusive + examples) if step else hidden
    return model, mass, abusive + examples


def read(docs: DataFrame) -> DataFrame:
    """(row, doc_id, source, units, keys, texts): each document's sentences by key; a task states the text of a key when it first meets it."""

    def make():
        known: dict[str, int] = {}

        def work(part, texts):
            units_, keys, new = [], [], []
            for us in cased_units(texts):
                own, first = set(), []
                for u in us:
                    k = known.get(u)
                    if k is None:
                        if len(known) >= KEPT:
                            known.clear()
                        k = known[u] = int.from_bytes(hashlib.blake2b(u.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)
                        first.append((k, u))
                    own.add(k)
                units_.append(list(own))
                keys.append([k for k, _ in first])
                new.append([u for _, u in first])
            return {"doc_id": part.column("doc_id"), "source": part.column("source"), "units": units_, "keys": keys, "texts": new}

        return work

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), source_key(F.col("source")).alias("source"), "text")
    return cut(map_batches(rows, "doc_id bigint, source string, units array<bigint>, keys array<bigint>, texts array<string>", ("text",), make)).withColumn("row", F.monotonically_increasing_id())


def _sentences(seen: DataFrame) -> DataFrame:
    """(key, text): each sentence of the corpus once."""
    return seen.select(F.explode(F.arrays_zip("keys", "texts")).alias("x")).groupBy(F.col("x.keys").alias("key")).agg(F.min("x.texts").alias("text"))


def tallied(seen: DataFrame, verdict: DataFrame) -> DataFrame:
    """(key, frame, text, places, r00, r01, r10, r11): each sentence with its frame and the documents that hold it, reviewed ones by half and verdict."""
    half, bad = F.xxhash64("doc_id").bitwiseAND(1), F.col("bad").cast("int")
    marks = [F.sum(((half == h) & (bad == v)).cast("bigint")) for h in (0, 1) for v in (0, 1)]
    places = seen.select("doc_id", "units").join(verdict, "doc_id", "left").select("doc_id", "bad", F.explode("units").alias("key"))
    counted = places.groupBy("key").agg(F.count("*").alias("places"), *(F.coalesce(x, F.lit(0)).alias(c) for x, c in zip(marks, _MARKS)))

    def make():
        def work(part, texts):
            rows = framed(texts)
            return {"key": part.column("key"), "frame": [f for _, f in rows], "text": [t for t, _ in rows]} | {c: part.column(c) for c in ("places", *_MARKS)}

        return work

    rows = _sentences(seen).join(counted, "key")
    return cut(map_batches(rows, "key bigint, frame string, text string, places bigint, r00 bigint, r01 bigint, r10 bigint, r11 bigint", ("text",), make).where(F.length("text") > 1))


def frames(tallies: DataFrame) -> DataFrame:
    """(frame, text, places, r00, r01, r10, r11): each frame of the corpus with one wording and the sums of its sentences."""
    return tallies.groupBy("frame").agg(F.min("text").alias("text"), *(F.sum(c).alias(c) for c in ("places", *_MARKS)))


_MARKS = ("r00", "r01", "r10", "r11")


def verdicts(labels: DataFrame) -> DataFrame:
    """(doc_id, bad): what most reviews of a document say; ties say nothing."""
    return labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").distinct().groupBy("doc_id").agg(F.avg("toxic").alias("m")).where("m <> 0.5").select("doc_id", (F.col("m") > 0.5).alias("bad"))


def shares(verdict: DataFrame) -> float:
    """The share of marked documents among reviewed ones."""
    counts = {r.bad: r["count"] for r in verdict.groupBy("bad").count().collect()}
    return max(counts.get(True, 0), 1) / max(sum(counts.values()), 1)


def train(docs: DataFrame, labels: DataFrame, tallies: DataFrame | None = None) -> Model:
    """Fit on all sentences of the corpus and all reviews.

    The frames are dealt to parts of about ``PART_FRAMES``, each with the tallies of the whole corpus; a task learns from a part, and the
    parts' models are mixed, each n-gram by its weight in the parts. What reaches the driver is one table of 2^``BITS`` rows and a list of words.
    """
    verdict = verdicts(labels)
    base = shares(verdict)
    rows = cut(frames(tallied(read(docs), verdict) if tallies is None else tallies))
    parts = -(-rows.count() // PART_FRAMES)
    if not parts:
        model, _, _ = learn(Tallied([], np.zeros(0), np.zeros((0, 2, 2))), base)
        return model

    def part_model(x):
        import pandas as pd

        x = x.assign(h=[hashlib.md5(f.encode("utf-8", "replace")).digest() for f in x["frame"]]).sort_values("h")
        pool = Tallied(x["text"].tolist(), x["places"].to_numpy(), x[list(_MARKS)].to_numpy().reshape(-1, 2, 2))
        model, mass, texts = learn(pool, base)
        used, words = np.flatnonzero(mass), word_counts(texts)
        numbers = np.concatenate([np.column_stack([mass[used], model.table[used]]), [[1.0, *model.bias]], [[n, 0, 0, 0] for n in words.values()]])
        return pd.DataFrame({"feature": [*used.tolist(), *[-1] * (1 + len(words))], "word": [*[None] * (len(used) + 1), *words], "mass": numbers[:, 0]} | {k: numbers[:, i + 1] for i, k in enumerate(KINDS)})

    dealt = rows.withColumn("part", F.pmod(F.xxhash64("frame"), F.lit(parts))).repartition(parts, "part")
    mixed = dealt.groupBy("part").applyInPandas(part_model, "feature int, word string, mass double, abuse double, hate double, sexual double")
    mixed = mixed.groupBy("feature", "word").agg(F.sum("mass").alias("mass"), *((F.sum(F.col("mass") * F.col(k)) / F.sum("mass")).alias(k) for k in KINDS))
    table, bias, words = np.zeros((1 << BITS, len(KINDS)), np.float32), np.zeros(len(KINDS)), {}
    got = mixed.toArrow().to_pydict()
    values = np.column_stack([got[k] for k in KINDS])
    for i, (f, w) in enumerate(zip(got["feature"], got["word"])):
        if w is not None:
            words[w] = got["mass"][i]
        elif f < 0:
            bias = values[i]
        else:
            table[f] = values[i]
    return Model(table, bias, masks_of(words))


class Scorer:
    """Scores texts sentence by sentence; sentences seen before aren't scored again."""

    def __init__(self, model: Model, keep: int = 100_000):
        self.model, self.keep, self.known = model, keep, {}

    def texts(self, texts: list[str | None]) -> list[tuple[float, ...]]:
        split = rough_units(texts)
        new = {u for us in split for u in us} - self.known.keys()
        if len(self.known) + len(new) > self.keep:
            self.known.clear()
            new = {u for us in split for u in us}
        new = list(new)
        clear = [cleared_up(u) for u in new]
        at = {u: k for k, u in enumerate(dict.fromkeys(clear))}
        p = self.model.probabilities(list(at))
        zero = (0.0,) * len(KINDS)
        each = [tuple(x) for x in p.tolist()]
        self.known.update((u, each[at[c]] if len(c) > 1 else None) for u, c in zip(new, clear))
        out = []
        for us in split:
            found = [x for x in map(self.known.__getitem__, us) if x is not None]
            out.append(tuple(map(max, zip(*found))) if found else zero)
        return out


def said(tallies: DataFrame, base: float) -> DataFrame:
    """(key, said): sentences whose frame's reviews speak by themselves, with the log odds beyond ``TOLD`` that they add."""
    up, down = _weight(base)
    x = (F.col("r01") + F.col("r11")) * F.lit(up) + (F.col("r00") + F.col("r10")) * F.lit(down)
    loud = frames(tallies).select("frame", x.alias("x")).where(F.abs("x") > TOLD)
    return tallies.select("key", "frame").join(loud, "frame").select("key", (F.col("x") - F.signum("x") * TOLD).alias("said"))


def scores(docs: DataFrame, model: Model, seen: DataFrame | None = None, reviews: DataFrame | None = None, tallies: DataFrame | None = None) -> DataFrame:
    """(doc_id, source, abuse, hate, sexual): the probabilities of each document's worst sentence; each sentence of the corpus is scored once.

    ``reviews`` (``said``) clear a sentence of all kinds, or speak for its likeliest one. ``tallies`` (``tallied``) have the sentences
    undisguised already, all but those of one sign, which are of no kind.
    """
    seen, raw = read(docs) if seen is None else seen, tallies is None

    def make():
        def work(part, texts):
            clear = all_cleared_up([rough(t) for t in texts]) if raw else texts
            at = {t: i for i, t in enumerate(dict.fromkeys(clear))}
            p = model.probabilities(list(at))[[at[t] for t in clear]]
            x = np.array([v or 0.0 for v in part.column("said").to_pylist()])[:, None]
            x = np.where((x < 0) | (p == p.max(1, keepdims=True)), x, 0.0)
            p = np.where(x == 0, p, 1 / (1 + np.exp(-np.clip(_logit(p) + x, -30, 30)))) * np.array([[len(t) > 1] for t in clear])
            return {"key": part.column("key")} | {k: p[:, i] for i, k in enumerate(KINDS)}

        return work

    texts = _sentences(seen) if raw else tallies.select("key", "text")
    texts = texts.withColumn("said", F.lit(0.0)) if reviews is None else texts.join(reviews, "key", "left")
    each = map_batches(texts, "key bigint, abuse double, hate double, sexual double", ("text",), make)
    worst = seen.select("row", F.explode("units").alias("key")).join(each, "key").groupBy("row").agg(*(F.max(k).alias(k) for k in KINDS))
    return seen.select("row", "doc_id", "source").join(worst, "row", "left").select("doc_id", "source", *(F.coalesce(k, F.lit(0.0)).alias(k) for k in KINDS))


def found(scored: DataFrame) -> DataFrame:
    """(doc_id, category): a row for each kind a document has."""
    kinds = F.array(*(F.when(F.col(k) >= THRESHOLD, F.lit(k)) for k in KINDS))
    return scored.select("doc_id", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("category"))


def rates(scored: DataFrame) -> DataFrame:
    """(source, n_docs, and the share of each kind and of any): a NULL source is a row of its own."""
    any_ = F.greatest(*KINDS) >= THRESHOLD
    return scored.groupBy("source").agg(F.count("*").alias("n_docs"), *(F.avg((F.col(k) >= THRESHOLD).cast("double")).alias(f"{k}_rate") for k in KINDS), F.avg(any_.cast("double")).alias("any_rate"))
