"""Problem 5: token budget by source, language and domain, by linear longest-match counting.

A public vocabulary is read as a longest-match one: from the left, the longest piece that fits. Its trie has a
failure link at each node (where to go on when no child fits) and, precomputed, how many tokens that emits, so a
text is counted in one pass without going back. White space counts as it stands: runs of blanks have pieces of
their own, tabs and line breaks are bytes. Counts are exact for longest match over the whole text; against the
vocabulary's own merge order they are an estimate, whose error the tests and the README give.

Cases: NULL and empty texts have no tokens; characters outside the vocabulary count their bytes; a missing
label is ``und``, a NULL source or domain stays a group of its own.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm.common import TOKENIZERS, lang_label, map_batches, source_key

#: The vocabulary, and how many words' counts a task keeps.
VOCABULARY, KEEP = "piece_bpe_32k.model", 300_000
_SHIFT = 21  # bits of a code point


class LongestMatch(dict):
    """Counts of stretches of text, counted by the trie at first sight.

    A text is cut only where no piece can reach across: before a run of blanks (if no piece has a blank after another
    sign), and around white space that no longer piece contains.
    """

    def __init__(self, tokens: set[str], keep: int = KEEP):
        super().__init__()
        self.keep = keep
        long = "".join(t for t in tokens if len(t) > 1)
        alone = "".join(c for c in "\n\t" if c not in long)
        inside = any("▁" in t.lstrip("▁") for t in tokens)
        self.find = re.compile(f"[^{alone}]+|[{alone}]" if inside and alone else f" *[^ {alone}]+| +" + (f"|[{alone}]" if alone else "") if not inside else r"(?s:.+)").findall
        cost = {c: 1 if c in tokens else len(c.encode()) for t in tokens for c in t}  # each character can stand alone
        child: dict[int, int] = {}
        parent, letter, depth, price = [0], [0], [0], [0]
        for t in [*cost, *tokens]:
            v = 0
            for c in t:
                key = v << _SHIFT | ord(c)
                if key not in child:
                    child[key] = len(parent)
                    parent.append(v)
                    letter.append(ord(c))
                    depth.append(depth[v] + 1)
                    price.append(0)
                v = child[key]
            price[v] = cost[t] if t in cost else 1
        self.child = child
        n = len(parent)
        self.link, self.emits = [-1] * n, [0] * n
        for v in sorted(range(1, n), key=depth.__getitem__):
            if price[v]:
                self.link[v], self.emits[v] = 0, price[v]
                continue
            z, emitted = self.link[parent[v]], self.emits[parent[v]]
            while z >= 0 and (z << _SHIFT | letter[v]) not in child:
                emitted += self.emits[z]
                z = self.link[z]
            self.link[v], self.emits[v] = child[z << _SHIFT | letter[v]], emitted

    def __missing__(self, stretch: str) -> int:
        n = self.word(stretch.replace(" ", "▁"))
        if len(self) < self.keep and len(stretch) < 48:
            self[stretch] = n
        return n

    def word(self, word: str) -> int:
        child, link, emits, v, n = self.child, self.link, self.emits, 0, 0
        for c in word:
            key = ord(c)
            while (w := child.get(v << _SHIFT | key)) is None:
                if v == 0:
                    n += len(c.encode("utf-8", "replace"))
                    w = 0
                    break
                n += emits[v]
                v = link[v]
            v = w
        while v:
            n += emits[v]
            v = link[v]
        return n

    def count(self, text: str | None) -> int:
        """Tokens of a text, before which the vocabulary sets a blank."""
        return sum(map(self.__getitem__, self.find(" " + text))) if text else 0


@lru_cache(2)
def vocabulary(name: str = VOCABULARY, folder: str | None = None) -> LongestMatch:
    """The pieces of a public sentencepiece model, without its special and byte pieces; kept by the worker."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder or TOKENIZERS, name))
    return LongestMatch({model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))})


def counted(df: DataFrame, id_col: str, columns: tuple[str, str], name: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """(``id_col``, source, lang, domain, prompt_tokens, resp_tokens) of each row; map-only."""
    keys = (id_col, "source", "lang", "domain")

    def make():
        count = vocabulary(name, folder).count

        def work(part, prompts, texts):
            return {k: part.column(k) for k in keys} | {"prompt_tokens": [count(t) for t in prompts], "resp_tokens": [count(t) for t in texts]}

        return work

    rows = df.select(F.col(id_col).cast("bigint").alias(id_col), source_key(F.col("source")).alias("source"), F.coalesce(lang_label(F.col("lang")), F.lit("und")).alias("lang"), F.lower(F.trim("domain")).alias("domain"), *columns)
    return map_batches(rows, f"{id_col} bigint, source string, lang string, domain string, prompt_tokens bigint, resp_tokens bigint", columns, make)


def totals(rows: DataFrame) -> DataFrame:
    """(source, lang, domain, n_rows, prompt_tokens, resp_tokens, total_tokens), added up before the shuffle."""
    sums = rows.groupBy("source", "lang", "domain").agg(F.count("*").alias("n_rows"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("resp_tokens").alias("resp_tokens"))
    return sums.withColumn("total_tokens", F.col("prompt_tokens") + F.col("resp_tokens"))
