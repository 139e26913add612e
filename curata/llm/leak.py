"""Problem 1: passages of held-out items inside a corpus, by suffix arrays.

Each task builds suffix arrays over shards of its texts' words, searches every suffix of every test item in
them by binary search and extends the hits to the longest verbatim matches with their places. ``passages`` gives
every maximal match of at least ``MIN_RUN`` words, however small its part of the item; ``matches`` gives the rows that
leak an item: whose matches, taken in the item's order, hold at least ``min_share`` of the item's words. Words are
runs of letters and digits of any script, and single Chinese and Japanese characters; with ``ascii_only`` they are runs of a-z
and 0-9. The corpus is read once, map-only; only more items than ``PASS_ITEMS`` (or ``PASS_CHARS`` of their text, the
bound on what is sent to the tasks at once) take another pass.

Cases: NULL or empty texts and items never match; items of fewer than ``MIN_RUN`` words can't be held by
passages of that length and never match; a repeated corpus row is reported as often as it occurs.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm.common import map_batches

#: Words of the shortest passage, and the share of an item's words that must be held.
MIN_RUN, MIN_SHARE = 8, 0.5
#: Test items, and characters of their texts, that are sent to the tasks at once.
PASS_ITEMS, PASS_CHARS = 100_000, 64_000_000
#: Hits of a shard that are laid out at once; a passage that stands in very many items and places is taken in parts.
MOST_HITS = 2_000_000

_KEEP = bytes(c if 97 <= c <= 122 or 48 <= c <= 57 or c == 29 else 32 for c in range(256))
_WORD = re.compile(r"\x1d|[぀-ヿ㐀-鿿豈-﫿]|[^\W_぀-ヿ㐀-鿿豈-﫿]+")


def words(texts: list[str | None], ascii_only: bool = False) -> list:
    """The words of lower-cased texts, with the sign 29 after each text."""
    joined = " \x1d ".join((t or "").replace("\x1d", " ") for t in texts).lower() + " \x1d"
    if ascii_only:
        return joined.encode("latin-1", "replace").translate(_KEEP).split()
    return _WORD.findall(joined if joined.isascii() else unicodedata.normalize("NFC", joined))


class Items:
    """Test items as word numbers, and the keys of their suffixes."""

    def __init__(self, ids: list[int], texts: list[str | None], ascii_only: bool = False):
        self.ids, self.vocabulary, self.words, self.ascii_only = ids, {}, [], ascii_only
        for t in texts:
            w = words([t], ascii_only)[:-1]
            self.words.append(np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w], np.int64))
        at = [(k, j) for k, w in enumerate(self.words) for j in range(len(w) - MIN_RUN + 1)]
        self.item = np.array([k for k, _ in at], np.int64)
        self.place = np.array([j for _, j in at], np.int64)
        flat = np.concatenate([*self.words, np.zeros(1, np.int64)])
        base = np.cumsum([0, *map(len, self.words)])[:-1]
        self.keys = suffix_keys(flat, base[self.item] + self.place if at else np.zeros(0, np.int64))
        self.length = np.array([len(w) for w in self.words], np.int64)


def suffix_keys(ids: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """The first ``MIN_RUN`` words of suffixes as four sortable columns."""
    return [(ids[starts + k] << 32) | ids[starts + k + 1] for k in range(0, MIN_RUN, 2)]


def bound(keys: list[np.ndarray], wanted: list[np.ndarray], upper: bool) -> np.ndarray:
    """Binary search of all wanted keys at once: the first place not below (or above) each."""
    lo, hi = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), len(keys[0]), np.int64)
    while (open_ := lo < hi).any():
        mid = np.minimum((lo + hi) // 2, len(keys[0]) - 1)
        less, equal = np.zeros(len(lo), bool), np.ones(len(lo), bool)
        for k, w in zip(keys, wanted):
            x = k[mid]
            less |= equal & (x < w)
            equal &= x == w
        right = open_ & (less | (equal if upper else False))
        lo = np.where(right, mid + 1, lo)
        hi = np.where(open_ & ~right, mid, hi)
    return lo


def chained(parts: list[tuple[int, int, int]]) -> int:
    """Most words of an item in matches (place in text, place in item, words) that follow each other in both."""
    if not parts:
        return 0
    p, j, n = (np.array(x, np.int64) for x in zip(*sorted(parts)))
    best = n.copy()
    for k in range(1, len(p)):
        over = np.maximum(np.maximum(p[:k] + n[:k] - p[k], j[:k] + n[:k] - j[k]), 0)
        after = (p[:k] < p[k]) & (j[:k] < j[k]) & ((over == 0) | (n[k] - over >= MIN_RUN) | (n[:k] - over >= MIN_RUN))
        if after.any():
            best[k] = max(best[k], (best[:k] + n[k] - over)[after].max())
    return int(best.max())


def windows(items: Items, hits: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """Parts of the work of at most about ``MOST_HITS`` hits: a range of item suffixes and a range of diagonals.

    A run of hits lies on one diagonal (place in the text less place in the item) of one item, so no part cuts a run.
    """
    first = np.concatenate([[0], np.flatnonzero(np.diff(items.item)) + 1, [len(items.item)]])
    total = np.concatenate([[0], np.cumsum(hits)])
    a = 0
    while a < len(first) - 1:
        b = max(int(np.searchsorted(total[first], total[first[a]] + MOST_HITS, "right")) - 1, a + 1)
        size = int(total[first[b]] - total[first[a]])
        if size:
            low, parts = -int(items.place[first[a] : first[b]].max()), -(-size // MOST_HITS)
            edges = np.linspace(low, length + 1, parts + 1).astype(np.int64)
            for d, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
                yield int(first[a]), int(first[b]), d, e
        a = b


def shard_matches(items: Items, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
    """Longest matches of a shard: text number, item number, first word in the text and in the item, words."""
    tokens = words(texts, items.ascii_only)
    get = items.vocabulary.get
    ids = np.fromiter(map(get, tokens, repeat(0)), np.int64, len(tokens))
    # a suffix can only match if its first words are all words of the items
    stop = np.flatnonzero(np.concatenate([ids, [0]]) == 0)
    place = np.arange(len(ids))
    starts = np.flatnonzero(stop[np.searchsorted(stop, place)] - place >= MIN_RUN)
    if not len(starts) or not len(items.item):
        return []
    keys = suffix_keys(ids, starts)
    order = np.lexsort(keys[::-1])
    keys, starts = [k[order] for k in keys], starts[order]  # the shard's suffix array; equal keys in the order of places
    lo, hi = bound(keys, items.keys, False), bound(keys, items.keys, True)
    if not (hi - lo).sum():
        return []
    wide = np.int64(len(ids) + len(items.place) + int(items.length.max()) + 2)
    group = np.concatenate([[0], np.cumsum(np.any([np.diff(k) != 0 for k in keys], 0))])  # of equal keys
    ladder = group * 4 * wide + starts
    own = group[np.minimum(lo, len(group) - 1)] * 4 * wide
    sign = b"\x1d" if items.ascii_only else "\x1d"
    ends = np.flatnonzero(np.fromiter((t == sign for t in tokens), bool, len(tokens)))
    begin = np.concatenate([[0], ends + 1])
    found: list[tuple[int, int, int, int, int]] = []
    for s, e, d, top in windows(items, hi - lo, len(ids)):
        j = items.place[s:e]
        some = hi[s:e] > lo[s:e]
        # places p of a suffix with d <= p - j < top
        low = np.where(some, np.searchsorted(ladder, own[s:e] + np.maximum(d + j, 0)), 0)
        n = np.where(some, np.searchsorted(ladder, own[s:e] + np.maximum(top + j, 0)), 0) - low
        if not n.sum():
            continue
        suffix = np.repeat(np.arange(s, e), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        p, item, j = starts[at], items.item[suffix], items.place[suffix]
        text = np.searchsorted(ends, p)
        order = np.lexsort((p, p - j, item, text))
        p, j, item, text = p[order], j[order], item[order], text[order]
        new = np.ones(len(p), bool)
        new[1:] = (np.diff(text) != 0) | (np.diff(item) != 0) | (np.diff(p - j) != 0) | (np.diff(p) != 1)
        first = np.flatnonzero(new)
        run = np.diff(np.concatenate([first, [len(p)]])) + MIN_RUN - 1
        found += zip(text[first].tolist(), item[first].tolist(), (p[first] - begin[text[first]]).tolist(), j[first].tolist(), run.tolist())
    return found


_INDEX: dict[str, Items] = {}  # of the worker: an index is built once, not once a task


def _each_pass(corpus: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str, ascii_only: bool, names: tuple[str, ...], rows_of: Callable) -> DataFrame:
    clean = items.select(F.col(item_id).alias("id"), F.col(item_text).alias("t")).where("id IS NOT NULL AND t IS NOT NULL")
    size = clean.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("c")).first()
    passes = max(1, -(-size.n // PASS_ITEMS), -(-size.c // PASS_CHARS))
    found = []
    for b in range(passes):
        rows = clean.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == b).collect()  # bounded by PASS_ITEMS and PASS_CHARS

        def make(ids=[r.id for r in rows], texts=[r.t for r in rows], key=uuid.uuid4().hex):  # noqa: B006
            if key not in _INDEX:
                _INDEX.clear()
                _INDEX[key] = Items(ids, texts, ascii_only)
            own = _INDEX[key]

            def work(part, texts):
                keys = part.column(id_col).to_pylist()
                out = [(keys[t], *x) for t, *x in rows_of(own, shard_matches(own, texts))]
                return dict(zip(names, zip(*out))) if out else dict.fromkeys(names, ())

            return work

        found.append(map_batches(corpus.select(F.col(id_col).cast("bigint").alias(id_col), text_col), ", ".join(f"{n} bigint" for n in names), (text_col,), make))
    return reduce(DataFrame.unionByName, found)


def passages(corpus: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str, ascii_only: bool = False) -> DataFrame:
    """(``id_col``, item_id, at_word, item_word, n_words, item_words): every maximal verbatim match with its places."""

    def rows_of(own: Items, found: list) -> Iterator[tuple]:
        return ((text, own.ids[item], p, j, n, int(own.length[item])) for text, item, p, j, n in found)

    return _each_pass(corpus, items, id_col, text_col, item_id, item_text, ascii_only, (id_col, "item_id", "at_word", "item_word", "n_words", "item_words"), rows_of)


def matches(corpus: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str, min_share: float = MIN_SHARE, ascii_only: bool = False) -> DataFrame:
    """(``id_col``, item_id, n_words, held, longest, at_word): each row that holds an item, with its longest match."""

    def rows_of(own: Items, found: list) -> Iterator[tuple]:
        by: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for text, item, p, j, n in found:
            by.setdefault((text, item), []).append((p, j, n))
        for (text, item), parts in by.items():
            total = int(own.length[item])
            if sum(n for _, _, n in parts) >= min_share * total and (held := chained(parts)) >= min_share * total:
                p, _, n = max(parts, key=lambda x: x[2])
                yield text, own.ids[item], total, held, n, p

    return _each_pass(corpus, items, id_col, text_col, item_id, item_text, ascii_only, (id_col, "item_id", "n_words", "held", "longest", "at_word"), rows_of)


def without_leaks(corpus: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """The corpus without the rows that hold an item; rows with a NULL id are kept."""
    return corpus.join(found.select(id_col).distinct(), id_col, "left_anti")
