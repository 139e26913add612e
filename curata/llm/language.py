"""Problem 3: the languages of texts and of their segments, by string kernels.

Units of text (clauses cut at signs) are compared by the blended-spectrum presence kernel: the shared character
1- to 4-grams over the root of the product of the numbers of n-grams. Nyström landmarks carry the kernel to a
small feature space, and one-versus-rest kernel ridge regression gives a score for each language. Since the
kernel is a product of presence vectors, the chain (units x landmarks) (landmarks x languages) is one product of
the sparse presence matrix with a table of 2^BITS x languages, and whole batches of units are scored by it.

The model is fitted on a bounded sample of labelled rows (``ROWS_PER_LANG``); everything else reads all rows.
Labels are partly wrong: a second fit leaves out the units whose label the first one contradicts.

Cases: NULL, empty and wordless texts have no language; text in no known language has none either.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm.common import LANGS, NOT_PROSE, lang_label, map_batches, sample_limits, sampled
from curata.llm.ngrams import grams, linear

#: The bound of the labelled sample, by language, and of the units of one language taken from it.
ROWS_PER_LANG, UNITS_PER_LANG = 1000, 4000
#: Landmarks of a language, n-gram lengths, width of the table, ridge.
LANDMARKS, ORDERS, BITS, RIDGE = 72, (1, 2, 3, 4), 17, 0.5
#: A language is present in a clause of so many words, or Chinese characters.
CLAUSE_WORDS, CLAUSE_CHARS = 6, 10
#: Units of fewer words or characters are no evidence.
UNIT_WORDS, UNIT_CHARS = 3, 4

#: A unit is sure from this confidence; scores this close are as likely, and an unsure unit may differ by FAR from its context.
SURE, CLOSE, FAR, LEAST_SCORE = 0.93, 0.3, 0.8, -0.6

_NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
#: Patterns that begin with a set of signs are found fast; a single blank need not be replaced.
_SENTENCE = re.compile(r"[.!?。！？;；:：|()（）\[\]\"“”«»„「」『』>\n](?:(?<!\n)[.!?。！？;；:：|()（）\[\]\"“”«»„「」『』>]*|(?<=\n)(?:[^\S\x1c-\x1f]*\n)+)")
_UNIT = re.compile(r"[,，、—–]+")
_SPACE = re.compile(r"[^\S\x1c-\x1f](?:(?<! )[^\S\x1c-\x1f]*|[^\S\x1c-\x1f]+)")
_LETTERS = re.compile(r"(?<![\w])[^\W\d_]{2,}(?:['’][^\W\d_]+)*|[^\W\d_](?=['’])|[àéyeoаи](?= )|[㐀-鿿]+")
_WORD = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_぀-ヿ㐀-鿿]+(?:['’][^\W\d_]+)*")


def prepared(texts: list[str | None]) -> str:
    """The texts' prose, lower-cased, numbers as 0; 29 between texts, 30 between sentences, 31 between units."""
    joined = "\x1d".join((t or "").replace("\x1d", " ").replace("\x1e", " ").replace("\x1f", " ") for t in texts)
    return _SPACE.sub(" ", _UNIT.sub("\x1f", _SENTENCE.sub("\x1e", _NUMBER.sub("0", NOT_PROSE.sub(" ", joined))))).lower()


def letters(unit: str) -> str:
    """A unit's words alone: what the kernel sees."""
    return f" {' '.join(_LETTERS.findall(unit))} "


def sizes(unit: str) -> tuple[int, int]:
    """Words and Chinese characters of a unit; numbers count beside words, but aren't words by themselves."""
    found = _WORD.findall(unit)
    chars = sum(len(x) == 1 and "㐀" <= x <= "鿿" for x in found)
    words = len(found) - chars
    if words and not chars and sum(len(x) > 1 and x[0] != "0" for x in found) < UNIT_WORDS - 1:
        return 0, 0
    return words, chars


@dataclass
class Model:
    """``table``: of each hashed n-gram its share in the score of each language of ``langs``."""

    table: np.ndarray
    langs: tuple[str, ...] = LANGS

    def scores(self, units: list[str]) -> np.ndarray:
        total, n = linear([letters(u) for u in units], self.table, ORDERS, True)
        return total / np.sqrt(np.maximum(n, 1))[:, None]


def fit(units: list[str], labels: np.ndarray, langs: tuple[str, ...] = LANGS, rounds: int = 2) -> Model:
    """Nyström kernel ridge regression; units are distinct, labels are numbers of languages."""
    width = 1 << BITS
    row, feature = grams([letters(u) for u in units], ORDERS, BITS, True)
    norm = np.sqrt(np.maximum(np.bincount(row, minlength=len(units)), 1))
    keep = np.ones(len(units), bool)
    table = np.zeros((width, len(langs)))
    for _ in range(rounds):
        marks = np.concatenate([np.flatnonzero(keep & (labels == k))[:LANDMARKS] for k in range(len(langs))])
        kernel = np.zeros((len(units), len(marks)), np.float32)
        start = np.searchsorted(row, np.arange(len(units) + 1))
        for j, m in enumerate(marks):
            own = np.zeros(width)
            own[feature[start[m] : start[m + 1]]] = 1
            kernel[:, j] = np.bincount(row, own[feature], len(units)) / (norm * norm[m])
        value, vector = np.linalg.eigh(kernel[marks].astype(float))
        root = vector / np.sqrt(np.maximum(value, 1e-6))  # columns of K_mm^(-1/2), rotated
        gram, right = RIDGE * np.eye(len(marks)), np.zeros((len(marks), len(langs)))
        for part in np.array_split(np.flatnonzero(keep), 1 + len(units) // 4000):  # the feature space a part at a time
            phi = kernel[part] @ root
            gram += phi.T @ phi
            right += phi.T @ np.where(labels[part][:, None] == np.arange(len(langs)), 1.0, -1.0)
        weight = np.linalg.solve(gram, right)
        alpha = root @ weight
        table = np.zeros((width, len(langs)))
        for j, m in enumerate(marks):
            table[feature[start[m] : start[m + 1]]] += alpha[j] / norm[m]
        keep = (kernel @ alpha).argmax(1) == labels
        if not all((keep & (labels == k)).any() for k in range(len(langs)) if (labels == k).any()):
            break
    return Model(table.astype(np.float32), langs)


def train(df: DataFrame, id_col: str, text_col: str, label_col: str, langs: tuple[str, ...] = LANGS) -> Model:
    """Fit on at most about ``ROWS_PER_LANG`` labelled rows of each language, chosen by a hash of the key.

    ``langs`` are the languages told apart; rows with other labels aren't samples.
    """
    label, text = lang_label(F.col(label_col), langs), F.col(text_col)
    share = sample_limits(df, label, text, ROWS_PER_LANG)
    if not share:
        return Model(np.zeros((1 << BITS, len(langs)), np.float32), langs)
    own = F.coalesce(*(F.when(label == k, F.lit(v)) for k, v in share.items()))
    rows = df.where(F.col(id_col).isNotNull() & sampled(F.col(id_col), text, own)).select(F.col(id_col).alias("i"), text.alias("t"), label.alias("l"))
    votes: dict[str, list[int]] = {}
    for r in sorted(rows.collect(), key=lambda r: (r.i, r.t)):
        k = langs.index(r.l)
        for u in dict.fromkeys(re.split("[\x1d\x1e\x1f]", prepared([r.t]))):
            w, c = sizes(u)
            if w >= UNIT_WORDS or c >= UNIT_CHARS:
                votes.setdefault(letters(u), [0] * len(langs))[k] += 1
    taken, units, labels = [0] * len(langs), [], []
    for u, v in votes.items():  # a unit has the label of most of its rows
        k = max(range(len(langs)), key=v.__getitem__)
        if 2 * v[k] > sum(v) and taken[k] < UNITS_PER_LANG:
            taken[k] += 1
            units.append(u)
            labels.append(k)
    return fit(units, np.array(labels), langs)


class Reader:
    """Reads texts unit by unit with a model; units seen before aren't scored again."""

    def __init__(self, model: Model, keep: int = 100_000):
        self.model, self.keep, self.known, self.langs = model, keep, {}, model.langs

    def learn(self, joined: str) -> None:
        new = list({u for u in re.split("[\x1d\x1e\x1f]", joined)} - self.known.keys())
        if len(self.known) + len(new) > self.keep:
            self.known.clear()
            new = list({u for u in re.split("[\x1d\x1e\x1f]", joined)})
        todo = []
        for u in new:
            w, c = sizes(u)
            if w >= UNIT_WORDS or c >= UNIT_CHARS:
                todo.append((u, w, c))
            else:
                self.known[u] = None
        if todo:
            s = self.model.scores([u for u, _, _ in todo])
            e = np.exp(4 * (s - s.max(1, keepdims=True)))
            sure = e.max(1) / e.sum(1)
            for (u, w, c), row, k, p in zip(todo, s.tolist(), s.argmax(1).tolist(), sure.tolist()):
                self.known[u] = (k, p, w, c, row) if row[k] > LEAST_SCORE else None

    def segments(self, texts: list[str | None], labels: list[str | None]) -> list[list[tuple[str, int, int, float, int, bool]]]:
        """Of each text its segments: language, words, characters, confidence, first sentence, whether it holds a clause.

        An unsure unit goes with the sure ones of its sentence, else with the text's main language if that is
        as likely; the delivered label only breaks ties between languages that are as likely for a whole text.
        """
        joined = prepared(texts)
        self.learn(joined)
        known, langs, out = self.known, self.langs, []
        for text, label in zip(joined.split("\x1d"), labels):
            found, total = [], [0.0] * len(langs)
            for at, sentence in enumerate(text.split("\x1e")):
                for u in sentence.split("\x1f"):
                    if (x := known[u]) is not None:
                        found.append((at, x))
                        total[x[0]] += x[1] * (x[2] + x[3])
            if not found:
                out.append([])
                continue
            main = max(range(len(langs)), key=total.__getitem__)
            if label in langs and (k := langs.index(label)) != main and all(x[1] < SURE and x[4][k] >= x[4][x[0]] - CLOSE for _, x in found):
                main = k
            runs: list[list] = []
            for at, g in groupby(found, key=lambda f: f[0]):
                units = [x for _, x in g]
                sure = [x[0] if x[1] >= SURE else -1 for x in units]
                last = next((k for k in sure if k >= 0), -1)
                first = True
                for k, (own, p, w, c, row) in zip(sure, units):
                    if k < 0:
                        k = last if last >= 0 and row[last] >= row[own] - FAR else main if row[main] >= row[own] - FAR else own
                    else:
                        last = k
                    if first or runs[-1][0] != k:
                        runs.append([k, w, c, p * (w + c), at])
                        first = False
                    else:
                        r = runs[-1]
                        r[1] += w
                        r[2] += c
                        r[3] += p * (w + c)
            merged = []
            for k, g in groupby(runs, key=lambda r: r[0]):
                g = list(g)
                w, c = sum(r[1] for r in g), sum(r[2] for r in g)
                clause = any(r[2] >= CLAUSE_CHARS if langs[k] == "zh" else r[1] >= CLAUSE_WORDS for r in g)
                merged.append((langs[k], w, c, sum(r[3] for r in g) / max(w + c, 1), g[0][4], clause))
            out.append(merged)
        return out


def segments(df: DataFrame, model: Model, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(``id_col``, segment, lang, first_sentence, n_words, n_chars, confidence): the segments of each text in order.

    As in :func:`present`, the delivered label breaks ties of a whole text only.
    """
    names = (id_col, "segment", "lang", "first_sentence", "n_words", "n_chars", "confidence")

    def make():
        reader = Reader(model)

        def work(part, texts):
            ids, labels = part.column(id_col).to_pylist(), part.column("label").to_pylist()
            rows = [(ids[t], k, lang, at, w, c, p) for t, segs in enumerate(reader.segments(texts, labels)) for k, (lang, w, c, p, at, _) in enumerate(segs)]
            return dict(zip(names, zip(*rows))) if rows else dict.fromkeys(names, ())

        return work

    rows = df.select(F.col(id_col).cast("bigint").alias(id_col), text_col, lang_label(F.col(label_col), model.langs).alias("label"))
    return map_batches(rows, f"{id_col} bigint, segment int, lang string, first_sentence int, n_words int, n_chars int, confidence double", (text_col,), make)


def present(df: DataFrame, model: Model, id_col: str, text_col: str, label_col: str, only_cases: bool) -> DataFrame:
    """(``id_col``, lang, label, confidence, share): a row for each language with a clause in the text.

    ``only_cases`` leaves the texts whose label is absent or not their language, or that are in several.
    """
    names = (id_col, "lang", "label", "confidence", "share")

    def make():
        reader = Reader(model)

        def work(part, texts):
            ids, labels, rows = part.column(id_col).to_pylist(), part.column("label").to_pylist(), []
            for t, segs in enumerate(reader.segments(texts, labels)):
                by: dict[str, list[float]] = {}
                total, clear = 0, set()
                for lang, w, c, p, _, clause in segs:
                    n = w + c
                    x = by.setdefault(lang, [0, 0.0])
                    x[0] += n
                    x[1] += p * n
                    total += n
                    if clause:
                        clear.add(lang)
                if clear and not (only_cases and clear == {labels[t]}):
                    rows += [(ids[t], k, labels[t], by[k][1] / by[k][0], by[k][0] / total) for k in sorted(clear)]
            return dict(zip(names, zip(*rows))) if rows else dict.fromkeys(names, ())

        return work

    rows = df.select(F.col(id_col).cast("bigint").alias(id_col), text_col, lang_label(F.col(label_col), model.langs).alias("label"))
    return map_batches(rows, f"{id_col} bigint, lang string, label string, confidence double, share double", (text_col,), make)
