"""Problem 6: defective prompt and response pairs, with the kind of defect.

``copy``: a response compressed with its prompt as zstandard dictionary shrinks to almost nothing, and so does the prompt
with the response as dictionary: nothing is new in the one, nothing is left out of the other. ``language``: dictionaries of words that belong to one language, taken
from a bounded labelled sample, vote on each sentence. ``refusal``: a dictionary of refusing phrases in seven
languages. ``truncated``: structure that is never closed, announcements with nothing after them, and a
terminal-context model that knows after which words sentences end. ``empty``: no word or number is left.

Cases: a NULL response is empty; a NULL prompt is nobody's copy and has no language; texts are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.llm.common import CHUNK_CHARS, chunks, lang_label, map_batches, sample_limits, sampled
from curata.llm.language import prepared
from curata.plans.lineage import cut
from curata.plans.spread import spread

#: Bound of the labelled sample: rows of a language for the word dictionary.
ROWS_PER_LANG = 500
#: Contexts of this share of all words are known whether a text asks for them or not.
FREQUENT = 1e-5
#: Of a copy's words, compressed with the prompt as dictionary, at most this share of their bytes is left; the like for the prompt's words by the copy.
MOST_NEW, MOST_MISSING = 0.3, 0.35
#: Bytes of an empty zstandard frame. Responses more than so many times longer than their prompt aren't the prompt alone.
FRAME_BYTES, COPY_LENGTH = 10, 4
#: A task keeps the languages of so many sentences of so many characters at most.
KEPT, KEPT_CHARS = 100_000, 300
#: Of a dictionary word's rate over the languages, its own language's share.
SHARE_OF_WORD = 0.75
#: A sentence may end after a context that is followed by an end in at least this share of its places.
END_SHARE = 0.05

_TAG = re.compile(r"</?[a-zA-Z][^<>\n]*>")
_EMPTY_BOX = re.compile(r"\\boxed\s*\{[\s~\\,;]*\}")
_CONTENT = re.compile(r"[^\W_]")
_BOX = re.compile(r"\\boxed\s*\{\s*[^\s{}]|\\boxed\s*\{\s*[{\\(]")
_TOKEN = re.compile(r"[㐀-鿿]|[^\W_㐀-鿿]+")
_SENTENCE_END = ".!?。！？…"

# Phrases by which a final part declines, as patterns over lower-cased text with plain apostrophes.
REFUSALS = {
    "en": (
        r"\b(?:can't|cannot|can not|won't|will not|could not|couldn't|unable to|not able to|not going to|not be able to|not allowed to|not permitted to|rather not|don't want to|do not wish to)\b[^.!?\n]{0,40}\b(?:help|assist|answer|respond|comply|complete|provide|solve|discuss|engage|continue|fulfil|fulfill|work on|support)",
        r"\b(?:must|have to|need to|will|shall|should|i)\s+(?:\w+\s+)?(?:decline|refuse|pass on)\b",
        r"\b(?:do not|don't) have the ability to (?:respond|answer|help)",
        r"\b(?:would not|wouldn't|is not|isn't|not) be appropriate for me|\bnot appropriate for me\b|\bnot something i (?:can|could|am able|may)",
        r"\b(?:prevent|prohibit|forbid|stop|keep)s? me from\b",
        r"\b(?:don't|do not) feel (?:comfortable|able)|\bnot comfortable\b[^.!?\n]{0,30}\b(?:answering|going|helping|with this)",
        r"\b(?:falls|lies|is) (?:outside|beyond) (?:of )?(?:what i|my)\b",
        r"\bno (?:solution|answer|help|response) (?:will|can) (?:be given|be provided|follow)",
        r"^\W*(?:sorry|apologies)\W+no\b",
        r"\bagainst my (?:guidelines|policy|policies|rules|principles)",
        r"\b(?:restricted|off limits) for me\b",
    ),
    "zh": (r"(?:无法|不能|不便|没法|不可以|拒绝|不会|不想|不愿)[^。！？\n]{0,12}(?:回答|协助|帮助|提供|解答|完成|作答|满足|处理|讨论|回应)", r"超出了?我的(?:能力|权限|范围)"),
    "fr": (
        r"\b(?:ne peux|ne puis|ne pourrai|ne suis pas en mesure|n'ai pas le droit)\b[^.!?\n]{0,40}\b(?:répondre|aider|traiter|résoudre|fournir|donner|continuer)",
        r"\b(?:impossible)\b[^.!?\n]{0,20}\b(?:de vous aider|de répondre|d'aider|d'y répondre)",
        r"\b(?:préfère ne pas|refuse de|dois refuser|dois décliner|suis obligée? de refuser|décline)\b",
    ),
    "de": (
        r"\b(?:kann|darf|möchte|werde|könnte)\b[^.!?\n]{0,40}\b(?:nicht|keine|kein)\b[^.!?\n]{0,40}\b(?:helfen|beantworten|antwort|lösen|lösung|unterstützen|weiterhelfen|geben|antworten)",
        r"\b(?:muss|möchte)\b[^.!?\n]{0,40}\b(?:ablehnen|verweigern)\b",
        r"\bnicht in der lage\b[^.!?\n]{0,40}\b(?:helfen|beantworten|antworten)",
        r"\blehne\b[^.!?\n]{0,40}\bab\b",
    ),
    "es": (
        r"\bno (?:puedo|podré|voy a|quiero|debo|estoy en condiciones de|me es posible|es posible)\b[^.!?\n]{0,30}\b(?:ayudar|responder|resolver|contestar|proporcionar|dar|atender)",
        r"\b(?:debo|tengo que|he de|prefiero) (?:negarme|rechazar|declinar|no responder|no contestar|rehusar)",
    ),
    "pt": (
        r"\bnão (?:posso|poderei|vou|quero|devo|consigo|estou em condições de|me é possível|é possível)\b[^.!?\n]{0,30}\b(?:ajudar|responder|resolver|fornecer|dar|atender)",
        r"\b(?:preciso|devo|tenho que|tenho de|prefiro) (?:recusar|rejeitar|declinar|me negar|não responder)",
    ),
    "ru": (
        r"\bне (?:могу|буду|смогу|в состоянии|имею права|вправе|хочу)\b[^.!?\n]{0,40}(?:помочь|ответить|отвечать|решить|решать|предоставить|дать)",
        r"\b(?:вынужден\w*|должен|должна|приходится)\b[^.!?\n]{0,20}(?:отказ\w+|отклонить)",
        r"\bотказываюсь\b",
    ),
}
# Names of the languages in these languages, in the order of LANGS, and words that ask for an answer.
LANGUAGE_NAMES = {
    "en": "english|anglais|englisch|inglés|inglês|английск|英语|英文",
    "zh": "chinese|mandarin|chinois|chinesisch|chino|chinês|китайск|中文|汉语|普通话",
    "fr": "french|français|französisch|francés|francês|французск|法语|法文",
    "de": "german|allemand|deutsch|alemán|alemão|немецк|德语|德文",
    "es": "spanish|espagnol|spanisch|español|castellano|espanhol|испанск|西班牙语|西班牙文",
    "pt": "portuguese|portugais|portugiesisch|portugués|português|португальск|葡萄牙语|葡萄牙文",
    "ru": "russian|russe|russisch|ruso|russo|русск|俄语|俄文",
}
_ASKS = re.compile(r"answer|repl[yi]|respon|writ|output|solution|antwort|schreib|répon|répond|rédig|écri|contest|escrib|escrev|redact|ответ|напиш|пиши|回答|作答|答案|回复|写|用")
_NAMES = [(k, re.compile(v)) for k, v in LANGUAGE_NAMES.items()]
_REFUSAL = re.compile("|".join(f"(?:{p})" for group in REFUSALS.values() for p in group), re.M)
#: An equation or a number that closes a sentence: an answer, if not a boxed one.
_EQUATION = re.compile(r"=\s*[\d$\\-]|\d\s*[.。]?\s*$")
_ANY_NAME = re.compile("|".join(LANGUAGE_NAMES.values()))


def plain(text: str) -> str:
    """Lower case, plain apostrophes, single spaces."""
    return re.sub(r"[^\S\n]+", " ", text.replace("’", "'").replace("\u200b", "")).lower()


def is_empty(text: str | None) -> bool:
    return not text or not _CONTENT.search(_EMPTY_BOX.sub(" ", _TAG.sub(" ", text)))


def rest_beside(text: bytes, dictionary: bytes) -> float:
    """The share of a text's bytes that compression with a dictionary can't take from it; 1 for an empty dictionary."""
    if not dictionary or not text:
        return float(bool(text))
    shared = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packed = zstandard.ZstdCompressor(level=3, dict_data=shared, write_content_size=False, write_dict_id=False, write_checksum=False).compress(text)
    return max(len(packed) - FRAME_BYTES, 0) / len(text)


def is_copy(prompt: str | None, text: str) -> bool:
    """Whether a response is its prompt and no more, in any format: judged by compression alone, both ways."""
    if not prompt or len(text) > COPY_LENGTH * len(prompt) + 200:
        return False
    x, y = (" ".join(_TOKEN.findall(t)).encode() for t in (prompt.lower(), _TAG.sub(" ", text).lower()))
    return rest_beside(y, x) <= MOST_NEW and rest_beside(x, y) <= MOST_MISSING


def final_part(text: str) -> str:
    return text.rpartition("</think>")[2] if "</think>" in text else text


def is_refusal(text: str) -> bool:
    """A paragraph of the final part declines, and the final part gives no answer: neither box, code nor equation.

    Where no think tag sets the final part off, its last paragraph counts alone.
    """
    final = final_part(text).strip()
    if not final or "```" in final or _BOX.search(final) or ("<think>" in final):
        return False
    paragraphs = re.split(r"\n\s*\n", plain(final))
    if "</think>" not in text:
        return declines(paragraphs[-1])
    said = [declines(p) for p in paragraphs]
    return any(said) and not any(_EQUATION.search(p) for p, d in zip(paragraphs, said) if not d)


def declines(last: str) -> bool:
    """Whether sentences that decline hold at least half of a paragraph's words."""
    if not _REFUSAL.search(last):
        return False
    # quoted phrases are mentioned, not meant
    last = re.sub(r"\"[^\"\n]*\"|“[^”\n]*”|«[^»\n]*»|「[^」\n]*」", " ", last)
    parts = [s for s in re.split(r"(?<=[.!?。！？])\s*", last) if s.strip()]
    words = [len(_TOKEN.findall(s)) for s in parts]
    declined = [bool(_REFUSAL.search(s)) for s in parts]
    return any(declined) and 2 * sum(w for w, d in zip(words, declined) if d) >= sum(words)


@dataclass
class Contexts:
    """After which words (in Chinese: characters) sentences end: counts of (places, ends) for 1 to 3 of them."""

    seen: dict[str, tuple[int, int]]

    def may_end(self, tokens: list[str]) -> bool:
        for n in (3, 2, 1):
            c = self.seen.get(" ".join(tokens[-n:])) if len(tokens) >= n else None
            if c and c[0] >= (1 if n == 1 else 3):
                return c[1] >= END_SHARE * c[0] and c[1] > 0
        return False


_PIECE = re.compile(r"\d+(?:[.,/]\d+)*|[㐀-鿿]|[^\W\d_㐀-鿿]+(?:['’-][^\W\d_]+)*|[.!?。！？…;；:：,，、]+|\n+|[^\s\w]")
#: A number of a text, and a sentence with the signs that end it: after these no context goes on.
_NUMERAL = re.compile(r"\d+(?:[.,/]\d+)*")
_STRETCH = re.compile(r"(?:[^.!?。！？;；:：\n…，,、]+|[…，,、][.!?。！？…;；:：，,、]*)*+(?:[.!?。！？;；:：][.!?。！？…;；:：，,、]*|\n+|\Z)")
_FORMULA = re.compile(r"\$\$.*?\$\$|\$[^$\n]*\$|\\\[.*?\\\]|\\\(.*?\\\)", re.S)
_CODE = re.compile(r"```.*?(?:```|\Z)", re.S)


def pieces(text: str) -> list[str]:
    """Words, numbers as 0, closed formulas as §, signs."""
    return _pieces(_cleared(text))


def _cleared(text: str) -> str:
    return _FORMULA.sub(" § ", _CODE.sub("\n\n", _TAG.sub("\n\n", text))).lower()


def _pieces(cleared: str) -> list[str]:
    return ["0" if x[0].isdigit() else x for x in _PIECE.findall(cleared)]


def _word(x: str) -> bool:
    return x[0].isalnum() or x == "§"


class Sentences:
    """Sentences of texts, numbers aside, as often as they occur. No context reaches over the end of one, so equal ones are taken apart once."""

    def __init__(self):
        self.often: Counter[str] = Counter()
        self.lasts: Counter[tuple[str, bool]] = Counter()

    def add(self, texts: list[str]) -> Sentences:
        for t in texts:
            *own, _ = _STRETCH.findall(_NUMERAL.sub("0", _cleared(t)))  # the last one is the empty end
            if own:
                self.lasts[own.pop(), bool(_BOX.search(t))] += 1
            self.often.update(own)
        return self

    def chars(self) -> int:
        return sum(map(len, self.often)) + sum(len(x) for x, _ in self.lasts)

    def contexts(self) -> dict[str, list[int]]:
        """(places, ends) of 1 to 3 words; the end of a text counts as one only if it has a box or its own full stop."""
        seen: dict[str, list[int]] = {}
        for (sentence, done), times in chain((((x, True), n) for x, n in self.often.items()), self.lasts.items()):
            p = _pieces(sentence)
            last = len(p) - 1
            two = one = ""
            for k, x in enumerate(p):
                if not _word(x):
                    continue
                if k == last and not done:
                    break
                ends = times if k == last or p[k + 1][0] in ".!?。！？;；\n" else 0
                pair = f"{one} {x}" if one else ""
                for w in (x, pair, f"{two} {x}" if two else ""):
                    if w:
                        if (c := seen.get(w)) is None:
                            seen[w] = [times, ends]
                        else:
                            c[0] += times
                            c[1] += ends
                two, one = pair, x
        return seen


def context_counts(texts: list[str]) -> dict[str, list[int]]:
    """(places, ends) of 1 to 3 words in these texts."""
    return Sentences().add(texts).contexts()


def contexts(df: DataFrame, text_col: str, whole: Column) -> Contexts:
    """Counted over all texts that are whole; of the counts those come here that some text's last words ask for, and frequent ones for other texts."""

    def count(batches):
        def stated(sentences):
            seen = sentences.contexts()
            return pa.RecordBatch.from_pydict({"context": pa.array(seen, pa.string()), "places": pa.array([a for a, _ in seen.values()], pa.int64()), "ends": pa.array([b for _, b in seen.values()], pa.int64())})

        sentences = Sentences()
        for batch in batches:
            for _, (texts,) in chunks(batch, text_col):
                if sentences.add([t for t in texts if t]).chars() >= CHUNK_CHARS:
                    yield stated(sentences)
                    sentences = Sentences()
        yield stated(sentences)

    def ask():
        def work(part, texts):
            runs = [open_end(t) for t in texts if t]
            return {"context": sorted({" ".join(r[-n:]) for r in runs if isinstance(r, list) for n in (1, 2, 3) if len(r) >= n})}

        return work

    asked = map_batches(df.select(text_col), "context string", (text_col,), ask).distinct()
    counts = spread(df.where(whole).select(text_col)).mapInArrow(count, "context string, places bigint, ends bigint").groupBy("context").agg(F.sum("places").alias("places"), F.sum("ends").alias("ends"))
    counts = cut(counts.where((F.col("places") > 1) | ~F.col("context").contains(" ")))
    total = counts.where(~F.col("context").contains(" ")).agg(F.sum("places")).first()[0] or 0
    rows = counts.join(asked.withColumn("asked", F.lit(True)), "context", "left").where(F.col("asked") | (F.col("places") >= FREQUENT * total)).collect()
    return Contexts({r.context: (r.places, r.ends) for r in rows})


# Words after which a sentence never ends, whatever a sample says.
OPEN_WORDS = frozenset("the a an of to that which and or if we with by as from than into le la les un une des du que et ou si der die das ein eine und oder dass el los las un una y o que os as um uma e ou что и или если".split())


#: A text that ends in a command of TeX with all its arguments.
_CLOSED = re.compile(r"\\(?:[td]?frac\{[^{}]*\}\{[^{}]*\}|(?![td]?frac)[a-zA-Z]+\{[^{}]*\})\Z")


def is_truncated(text: str, model: Contexts) -> bool:
    end = open_end(text)
    return not model.may_end(end) if isinstance(end, list) else end


def open_end(text: str) -> bool | list[str]:
    """Whether a text is cut off, or its last words where only the contexts can tell."""
    tags = text.count("<think>") - text.count("</think>")
    if tags > 0:
        return True
    if text.count("```") % 2:
        return True
    body = _CODE.sub("\n\n", text).rstrip()
    if not body:
        return False
    last = re.split(r"\n\s*\n", body)[-1]
    if body.count("\\[") > body.count("\\]") or body.count("\\(") > body.count("\\)"):
        return True
    depth = 0
    for x in re.sub(r"\\[{}]", "", last):
        depth += (x == "{") - (x == "}")
        depth = max(depth, 0)
    if depth or last.replace("\\$", "").count("$") % 2:
        return True
    if re.search(r"(?:```|</?[a-zA-Z]+>)\s*\Z", text):
        return False
    end = last.rstrip("*_~` \t\"'”»」)）]")
    if not end or _CLOSED.search(end):
        return False
    if end[-1] in ":：,，、;；=+-*/\\(（[<^&|–—":
        return True
    p = pieces(last)
    while p and not _word(p[-1]):
        if p[-1][0] in _SENTENCE_END:
            return False
        p.pop()
    if not p:
        return False
    run: list[str] = []
    for x in p:
        run = run + [x] if _word(x) else [] if x[0] in ".!?。！？\n:：;；" else run
    if not run or run[-1] == "§":
        return False
    if run[-1] in OPEN_WORDS:
        return True
    if run == ["0"]:
        return False
    return run


@dataclass
class Dictionary:
    """Words that belong to one language."""

    words: dict[str, str]
    #: Languages of sentences met before.
    known: dict[str, str | None] = field(default_factory=dict, compare=False, repr=False)

    def language(self, sentence: str) -> str | None:
        """The language of most of a sentence's known words; None if they are too few or tie. A Chinese character is a word."""
        if sentence in self.known:
            return self.known[sentence]
        language = self._voted(sentence)
        if len(sentence) <= KEPT_CHARS:
            if len(self.known) >= KEPT:
                self.known.clear()
            self.known[sentence] = language
        return language

    def _voted(self, sentence: str) -> str | None:
        found = _TOKEN.findall(sentence)
        if sum((len(w) > 1 or w >= "㐀") and not w[0].isdigit() for w in found) < 2:
            return None
        votes = Counter(filter(None, map(self.words.get, found)))
        top = votes.most_common(2)
        if not top or top[0][1] < 2 or (len(top) > 1 and top[0][1] == top[1][1]):
            return None
        return top[0][0]


def word_dictionary(rows: list[tuple[str, str]]) -> Dictionary:
    """From (text, label): words of which at least ``SHARE_OF_WORD`` of the rate over languages is one language's.

    Labels are partly wrong, and wrong ones weigh most in the rare languages. So the first words only relabel the
    sentences, by the votes of their words, and the next round's words come from these; three rounds settle it.
    """
    sentences = [(frozenset(w for w in _TOKEN.findall(s) if not w[0].isdigit() and (len(w) > 1 or w >= "㐀" or w in "àéyeoаии")), label) for text, label in rows for s in set(prepared([text]).split("\x1e"))]
    sentences = [(w, label) for w, label in sentences if len(w) >= 4]
    out: dict[str, str] = {}
    for share in (0.4, 0.6, SHARE_OF_WORD):
        total = Counter(label for _, label in sentences)
        by: dict[str, Counter] = {}
        for words, label in sentences:
            for w in words:
                by.setdefault(w, Counter())[label] += 1
        out = {}
        for w, c in by.items():
            rate = {k: v / total[k] for k, v in c.items()}
            k = max(rate, key=rate.get)
            if c[k] >= 2 and rate[k] >= share * sum(rate.values()):
                out[w] = k
        again = []
        for words, _ in sentences:
            votes = Counter(filter(None, map(out.get, words))).most_common(2)
            if votes and votes[0][1] >= 2 and (len(votes) < 2 or votes[0][1] > votes[1][1]):
                again.append((words, votes[0][0]))
        sentences = again
    return Dictionary(out)


def asked_languages(prompt: str) -> set[str]:
    """Languages in which the prompt asks for the answer."""
    p = re.sub(r"\s+", " ", prompt.lower())
    if not _ANY_NAME.search(p) or not _ASKS.search(p):
        return set()
    return {k for k, r in _NAMES if r.search(p)}


def wrong_language(prompt: str | None, text: str, words: Dictionary) -> bool:
    if not prompt:
        return False
    own = Counter(filter(None, (words.language(s) for s in prepared([prompt]).split("\x1e")))).most_common(1)
    whole = own[0][0] if own else words.language(prepared([prompt]).replace("\x1e", " ").replace("\x1f", " "))
    if not whole:
        return False
    allowed = {whole} | asked_languages(prompt)
    any_ = False
    for s in prepared([text]).split("\x1e"):
        k = words.language(s)
        if k in allowed:
            return False
        any_ |= k is not None
    return any_


def train(df: DataFrame, id_col: str, text_col: str, label_col: str, truncated_col: str) -> tuple[Dictionary, Contexts]:
    """The dictionary from a bounded labelled sample chosen by a hash of the key, the contexts from all rows."""
    label, text = lang_label(F.col(label_col)), F.col(text_col)
    share = sample_limits(df, label, text, ROWS_PER_LANG)
    # contexts come from delivered rows of any label that aren't marked as cut off
    whole = F.when(~F.coalesce(F.col(truncated_col), F.lit(False)), F.lit(True))
    by_lang = F.coalesce(*(F.when(label == k, F.lit(v)) for k, v in share.items()), F.lit(0.0))
    rows = df.where(sampled(F.col(id_col), text, by_lang)).select(F.col(id_col).alias("i"), text.alias("t"), label.alias("l")).collect()
    rows.sort(key=lambda r: (r.i is None, r.i, r.t))
    return word_dictionary([(r.t, r.l) for r in rows]), contexts(df, text_col, F.coalesce(whole, F.lit(False)))


def defects(prompt: str | None, text: str | None, words: Dictionary, model: Contexts) -> list[str]:
    if is_empty(text):
        return ["empty"]
    kinds = {"copy": is_copy(prompt, text), "refusal": is_refusal(text), "language": wrong_language(prompt, text, words)}
    out = [k for k, v in kinds.items() if v]
    return out or (["truncated"] if is_truncated(text, model) else [])


def defective(df: DataFrame, models: tuple[Dictionary, Contexts], id_col: str, prompt_col: str, text_col: str) -> DataFrame:
    """(``id_col``, defect): a row for each defect; map-only."""
    words, model = models

    def make():
        def work(part, prompts, texts):
            ids = part.column(id_col).to_pylist()
            rows = [(i, d) for i, p, t in zip(ids, prompts, texts) for d in defects(p, t, words, model)]
            return {id_col: [i for i, _ in rows], "defect": [d for _, d in rows]}

        return work

    return map_batches(df.select(F.col(id_col).cast("bigint").alias(id_col), prompt_col, text_col), f"{id_col} bigint, defect string", (prompt_col, text_col), make)
