"""Functions no built-in expression covers, as Arrow-batched functions: normal forms, compression, similarity, grading."""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curata.functions import algebra


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility normal form; NULL stays NULL."""
    return s.map(lambda t: None if t is None else t if t.isascii() else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def normal_prompt(s: pd.Series) -> pd.Series:
    """Compatibility normal form, lower case, white space of all kinds collapsed, ends trimmed; NULL stays NULL."""
    return s.map(lambda t: None if t is None else re.sub(r"\s+", " ", (t if t.isascii() else unicodedata.normalize("NFKC", t)).lower()).strip())


@F.pandas_udf(T.DoubleType())
def tail_ratio(s: pd.Series) -> pd.Series:
    """Compressed over plain size of the last 4000 UTF-8 bytes, to four places; 1 for an empty text, NULL for NULL."""

    def one(t):
        if t is None:
            return None
        b = t.encode("utf-8", "replace")[-4000:]
        return round(len(zlib.compress(b)) / len(b), 4) if b else 1.0

    return s.map(one)


@F.pandas_udf(T.StructType([T.StructField("tail_zlib_ratio", T.DoubleType()), T.StructField("max_line_repeat", T.IntegerType()), T.StructField("looping", T.BooleanType())]))
def repetition(s: pd.Series) -> pd.DataFrame:
    """The tail's ratio to four places, the count of the most frequent line of 30 characters, and whether the tail alone shows a loop.

    A tail of at least 2000 bytes loops below a ratio of 0.10, before rounding. Lines are trimmed of all white space. NULL gives NULL.
    """

    def one(t):
        if t is None:
            return None, None, None
        b = t.encode("utf-8", "ignore")[-4000:]
        ratio = len(zlib.compress(b)) / max(1, len(b))
        lines = Counter(x for line in t.split("\n") if len(x := line.strip()) >= 30)
        return round(ratio, 4), max(lines.values(), default=0), len(b) >= 2000 and ratio < 0.10

    d = pd.DataFrame([one(t) for t in s], columns=["tail_zlib_ratio", "max_line_repeat", "looping"])
    return d.astype({"max_line_repeat": "Int32", "looping": "boolean"})


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def code_points(s: pd.Series) -> pd.Series:
    """The code point of each character, as ``sequences.words_as_ids``; NULL stays NULL."""
    return s.map(lambda t: None if t is None else np.frombuffer(t.encode("utf-32-le"), "<i4"))


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bit vectors: one big integer operation for each element of b."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    v = (1 << len(a)) - 1
    full = v
    for y in b:
        u = v & where.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def f1(hit: int, n: int, m: int) -> float:
    return 0.0 if not hit else 2 * (hit / n) * (hit / m) / (hit / n + hit / m)


def bleu4(pred: list, ref: list) -> float:
    """BLEU up to four-grams; a missing order counts 1 / (2^k n) as smoothing, with a brevity penalty."""
    if not pred or not ref:
        return 0.0
    total, k = 0.0, 0
    for n in range(1, 5):
        p, r = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (pred, ref))
        size, hit = max(sum(p.values()), 1), sum((p & r).values())
        if n == 1 and not hit:
            return 0.0
        if not hit:
            k += 1
        total += math.log(hit / size if hit else 1 / (2**k * size)) / 4
    return math.exp(total) * (1 if len(pred) > len(ref) else math.exp(1 - len(ref) / len(pred)))


@F.pandas_udf(T.StructType([T.StructField(k, T.DoubleType()) for k in ("bleu4", "rouge1", "rouge2", "rougel")]))
def similarity(pred: pd.Series, ref: pd.Series) -> pd.DataFrame:
    """Character BLEU-4 and word ROUGE F scores in per cent; an empty or NULL side scores 0."""
    rows = []
    for p, r in zip(pred, ref):
        p, r = p or "", r or ""
        a, b = p.split(), r.split()
        if not a or not b:
            rows.append((0.0, 0.0, 0.0, 0.0))
            continue
        grams = [tuple(Counter(zip(*(x[i:] for i in range(n)))) for x in (a, b)) for n in (1, 2)]
        hits = [(sum((x & y).values()), max(sum(x.values()), 1), max(sum(y.values()), 1)) for x, y in grams]
        rows.append(tuple(round(100 * v, 4) for v in (bleu4(list(p), list(r)), f1(*hits[0]), f1(*hits[1]), f1(lcs(a, b), len(a), len(b)))))
    return pd.DataFrame(rows, columns=["bleu4", "rouge1", "rouge2", "rougel"])


# Words that only style an answer, and signs with an equal spelling.
DROPPED = ("\\left", "\\right", "\\!", "\\,", "\\;", "\\ ", "^\\circ", "^{\\circ}", "\\$", "$", "\\%", "%", "\\mathrm", "\\displaystyle")
EQUAL_SIGNS = {"\\tfrac": "\\frac", "\\dfrac": "\\frac", "\\neq": "\\ne", "\\leq": "\\le", "\\geq": "\\ge", "\\pi": "pi", "\\infty": "inf", "∞": "inf", "π": "pi", "−": "-"}
UNITS = "degrees? cm mm km meters? metres? inches feet ft miles hours? minutes? seconds? days? weeks? years? dollars? cents? units? points? square cubic".split()
# Number words and their values, and months by number.
ONES = {w: k for k, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
TENS = {w: 10 * k for k, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
SCALES = {"hundred": 100, "thousand": 1000, "million": 10**6, "billion": 10**9}
MONTHS = {w: k for k, w in enumerate("january february march april may june july august september october november december".split(), 1)}
_TEXT = re.compile(r"\\(?:text|mbox|mathrm|textbf)\s*\{([^{}]*)\}")
_UNIT = re.compile(r"(?<=[\d}\s])\s*(?:%s)(?:\^\{?\d\}?)?\b\.?" % "|".join(UNITS))


def worded_number(text: str) -> str:
    """The digits of a number in words ("minus twenty-one", "two hundred and five"), or the text as it is."""
    words = [w for w in re.split(r"[\s-]+", text.strip().lower()) if w and w != "and"]
    sign = bool(words) and words[0] in ("minus", "negative")
    words = words[sign:]
    if not words or any(w not in ONES and w not in TENS and w not in SCALES for w in words) or words[0] in SCALES:
        return text
    whole = part = 0
    for w in words:
        if w == "hundred":
            part *= 100
        elif w in SCALES:
            whole, part = whole + part * SCALES[w], 0
        else:
            part += ONES.get(w, TENS.get(w, 0))
    return f"{'-' if sign else ''}{whole + part}"


def canonical(answer: str | None) -> str:
    """One spelling of a mathematical answer: no styling, units, spaces or trailing zeros; numbers and months in words as digits; NULL is empty.

    Idempotent and independent of machine load; the order of the steps is part of the definition.
    """
    s = (answer or "").strip().rstrip(".").replace("\n", "")
    s = worded_number(s)
    s = re.sub(r"\\begin\{array\}(?:\{[^{}]*\})?", r"\\begin{pmatrix}", s).replace("\\end{array}", "\\end{pmatrix}").replace("bmatrix", "pmatrix")
    s = str(MONTHS.get(s.lower(), s))
    for old, new in EQUAL_SIGNS.items():
        s = s.replace(old, new)
    for part in DROPPED:
        s = s.replace(part, "")
    s = _TEXT.sub(lambda m: f" {m[1]}", s)
    s = _UNIT.sub("", s.strip())
    s = re.sub(r"^\\?[a-zA-Z](?:_\{?\w\}?)?\s*(?:=|\\in(?![a-z]))\s*(?=[^=]*$)", "", s.strip())
    s = re.sub(r"\s+(?:and|or)\s+(?=[\d\\-])", ",", s)
    s = re.sub(r"\\frac\s*(\d)\s*(\d)(?!\d)", r"\\frac{\1}{\2}", s)
    s = re.sub(r"\\frac\s*(\d)\s*\{", r"\\frac{\1}{", s)
    s = re.sub(r"\\sqrt\s*(\w)", r"\\sqrt{\1}", s)
    s = re.sub(r"^(-?\d+)\s*/\s*(\d+)$", r"\\frac{\1}{\2}", s.strip())
    s = re.sub(r"(?<=\d),(?=\d{3}(?!\d))", "", s)
    s = re.sub(r"\s+", "", s)
    s = re.sub(r"(\d)\.0+(?!\d)", r"\1", s)
    s = re.sub(r"(\.\d*?[1-9])0+(?!\d)", r"\1", s)
    s = re.sub(r"(?<!\d)\.(?=\d)", "0.", s)
    return s


def value(text: str) -> float | None:
    """The value of an answer without names, or None if it isn't a real number."""
    tree = algebra.read(text)
    if tree is None or algebra.names(tree):
        return None
    x = algebra.value(tree, {})
    return None if x is None or abs(complex(x).imag) > 1e-9 else float(complex(x).real)


def near(x: float, y: float, absolute: float = 1e-4) -> bool:
    return x == y or abs(x - y) <= max(1e-9 * max(abs(x), abs(y)), absolute)


def same_answer(pred: str | None, gold: str | None) -> bool:
    """Whether two answers are the same: spelling, letters, numbers (a per cent off by 100 passes), matrices, tuples and intervals,
    lists in any order, equations, expressions as functions of their names.

    NULL and empty answers equal nothing. Deterministic: no time limits.
    """
    if not pred or not gold:
        return False
    a, b = canonical(pred), canonical(gold)
    if not a or not b:
        return False
    if a.lower() == b.lower():
        return True
    if re.fullmatch(r"\(?[A-E]\)?", b):
        return re.sub(r"[^A-E]", "", a.upper())[-1:] == b.strip("()")
    x, y = value(a), value(b)
    if x is not None and y is not None:
        return any(near(x, r) for r in (y, y / 100, y * 100))
    m, n = algebra.matrix(a), algebra.matrix(b)
    if m is not None or n is not None:
        return m is not None and n is not None and [len(r) for r in m] == [len(r) for r in n] and all(same_answer(u, v) for r, s in zip(m, n) for u, v in zip(r, s))
    inner_a, inner_b = (re.fullmatch(r"([(\[]|\\\{)(.+)([)\]]|\\\})", t) for t in (a, b))
    if inner_a and inner_b:
        p, q = algebra.members(inner_a[2]), algebra.members(inner_b[2])
        if len(p) > 1 or len(q) > 1:
            if inner_a[1] == inner_b[1] == "\\{":  # sets
                return algebra.matching(p, q, same_answer)
            return inner_a[1] + inner_a[3] == inner_b[1] + inner_b[3] and len(p) == len(q) and all(same_answer(u, v) for u, v in zip(p, q))
    p, q = algebra.members(a), algebra.members(b)
    if len(p) > 1 and len(q) > 1:
        return algebra.matching(p, q, same_answer)
    if a.count("=") == 1 and b.count("=") == 1:
        return algebra.same_equation(a, b) or any(same_answer(p, r) and same_answer(q, s) for (p, q), (r, s) in ((a.split("="), b.split("=")), (a.split("="), b.split("=")[::-1])))
    return algebra.equal(a, b)


def _buckets(name: str, x: float, tolerance: float) -> Iterator[str]:
    """Names of overlapping buckets: two numbers that differ by at most the tolerance (of either) share one."""
    if not math.isfinite(x):
        yield f"{name}{x}"
        return
    level = math.ceil(math.log2(2 * tolerance))
    for k in (level, level + 1):  # numbers near each other may be on neighbouring levels
        for half in (0.0, 0.5):
            yield f"{name}{k}:{half}:{math.floor(math.ldexp(x, -k) + half)}"


def answer_keys(answer: str | None) -> set[str]:
    """Keys by which equal answers meet: any two that ``same_answer`` holds equal, either way, share at least one."""
    a = canonical(answer)
    if not a:
        return set()
    out = {"s" + a.lower()}
    if letters := re.sub(r"[^A-E]", "", a.upper()):
        out.add("l" + letters[-1])
    if (v := value(a)) is not None:
        for x in (v, v / 100, v * 100):
            out |= set(_buckets("n", x, max(2e-9 * abs(x), 1e-4)))
        return out
    if (m := algebra.matrix(a)) is not None:
        return out | {f"m{len(m)}:{k}" for k in answer_keys(m[0][0])} if m and m[0] else out
    inner = re.fullmatch(r"([(\[]|\\\{)(.+)([)\]]|\\\})", a)
    for kind, parts in (("i", algebra.members(inner[2]) if inner else []), ("o", algebra.members(a))):
        if len(parts) > 1:
            out |= {f"{kind}{len(parts)}:{k}" for x in parts for k in answer_keys(x)}
    if a.count("=") == 1:
        out.add("e")
    if (tree := algebra.read(a)) is not None:
        for k, at in enumerate(algebra.points(algebra.names(tree))):
            if (x := algebra.value(tree, at)) is not None:
                out |= set(_buckets(f"p{k}:", abs(x), 2 * algebra.ROUNDING * max(abs(x), 1.0)))
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def meeting_keys(s: pd.Series) -> pd.Series:
    return s.map(lambda t: sorted(answer_keys(t)))


def same_simple(pred: str | None, gold: str | None) -> bool:
    """Numbers within 1e-5, else the same spelling; NULL equals nothing."""
    if pred is None or gold is None:
        return False
    try:
        return abs(float(pred.replace(",", "")) - float(gold.replace(",", ""))) <= 1e-5
    except ValueError:
        return pred.strip() == gold.strip()


def same_latex(a: str | None, b: str | None) -> bool:
    """Whether two LaTeX strings are the same expression or equation, or spelled alike without spaces."""
    if a is None or b is None:
        return False
    return re.sub(r"\s+", "", a) == re.sub(r"\s+", "", b) or algebra.equal(a, b) or algebra.same_equation(a, b)


def theorem_answer(text: str | None) -> str | None:
    """The answer of a theorem question: True or False, an option in brackets, a number (also computed, without units and pi's sign), else the last number.

    NULL stays NULL; a text with none of these is returned trimmed.
    """
    if text is None:
        return None
    t = re.sub(r"(?i)^.*\b(?:answer|therefore|so)\b\s*(?:is|:)?\s*", "", text.strip().replace("\n", " ")).strip().rstrip(".")
    if m := re.search(r"(?i)\b(true|false|yes|no|correct|incorrect|wrong)\b", t):
        return "True" if m[1].lower() in ("true", "yes", "correct") else "False"
    if m := re.search(r"\(([a-fA-F])\)", t):
        return f"({m[1].lower()})"
    bare = re.sub(r"^[a-zA-Z]\s*=\s*|[$~]|\\approx", "", _UNIT.sub("", t)).strip()
    if (v := value(canonical(bare))) is not None:
        return f"{v:.12g}"
    found = re.findall(r"[-+]?\d+(?:,\d{3})*(?:\.\d+)?(?:[eE][-+]?\d+)?", t)
    return found[-1].replace(",", "") if found else t


@F.pandas_udf(T.StringType())
def canonical_answer(s: pd.Series) -> pd.Series:
    return s.map(canonical)




def _judged(same):
    @F.pandas_udf(T.BooleanType())
    def judge(pred: pd.Series, gold: pd.Series) -> pd.Series:
        memo: dict = {}
        return pd.Series([memo[k] if (k := (p, g)) in memo else memo.setdefault(k, same(p, g)) for p, g in zip(pred, gold)], dtype=bool)

    return judge


answers_equal, simply_equal, latex_equal = _judged(same_answer), _judged(same_simple), _judged(same_latex)


@F.pandas_udf(T.StringType())
def theorem_answers(s: pd.Series) -> pd.Series:
    return s.map(theorem_answer)


def token_lengths(load=None):
    """A column function that counts tokens with a tokenizer: ``load`` makes, once a worker, a function from texts to counts.

    Without one, runs of letters and digits and single other signs are tokens. NULL and empty texts have none.
    """
    word = re.compile(r"\w+|[^\w\s]")
    made: list = []

    @F.pandas_udf(T.LongType())
    def count(s: pd.Series) -> pd.Series:
        if not made:
            made.append(load() if load else lambda texts: [len(word.findall(t)) for t in texts])
        return pd.Series(made[0]([t or "" for t in s]), dtype="int64")

    return count
