"""Text functions as Spark columns: prompts, answers, audit flags. All stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of all kinds, Chinese characters, a token, words that open a proof.
SPACES = "[\\s\\x0B\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"
CJK = "[\\x{4E00}-\\x{9FFF}]"
TOKEN = "[a-z0-9]+|[\\x{4E00}-\\x{9FFF}]"
PROOF = "(?i)^\\s*(\\(\\w\\)\\s*)?(prove|show that|demonstrate|verify that|证明)"


def user_prompt(instruction: Column, extra: Column) -> Column:
    """The instruction, with the input on the next line if there is one. NULL parts are empty."""
    head, tail = F.coalesce(instruction, F.lit("")), F.coalesce(extra, F.lit(""))
    return F.when(tail == "", head).otherwise(F.concat(head, F.lit("\n"), tail))


def normal_prompt(text: Column) -> Column:
    """Lower case, white space of all kinds collapsed, ends trimmed. NULL stays NULL. Without NFKC, which ``udfs.normal_prompt`` applies."""
    return F.trim(F.regexp_replace(F.lower(text), SPACES, " "))


def prompt_hash(text: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the normal prompt."""
    return F.substring(F.sha1(normal_prompt(text)), 1, 16)


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 and single Chinese characters of the lower-cased text; NULL gives an empty array."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def shingles(words: Column, n: int) -> Column:
    """Runs of n words joined by a space, in order; a shorter array gives its one short run, an empty one none."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0)))
    grams = F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, n), " "))
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(grams)


def hashed_shingles(words: Column, n: int) -> Column:
    """The 64-bit hashes of the runs of ``shingles``: no strings are built, and a join by them moves eight bytes a run."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0)))
    return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(starts, lambda i: F.xxhash64(F.slice(words, i + 1, n))))


def final_section(text: Column) -> Column:
    """What follows the last ``</think>``; empty without one."""
    return F.when(F.contains(text, F.lit("</think>")), F.substring_index(text, "</think>", -1)).otherwise(F.lit(""))


def occurrences(text: Column, part: str) -> Column:
    """How often a literal part occurs without overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _scan(tail: Column) -> Column:
    """Scan a text that begins with a brace: (depth, taken, closed) up to the brace that closes the first."""
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(acc: Column, c: Column) -> Column:
        d = acc["d"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        return F.when(acc["done"], acc).otherwise(F.struct(d.alias("d"), (acc["n"] + 1).alias("n"), (d == 0).alias("done")))

    return F.aggregate(F.split(tail, ""), start, step)


def last_boxed_balanced(text: Column) -> Column:
    """Whether the last ``\\boxed{`` is closed; false without one, NULL for NULL."""
    tail = F.substring_index(text, "\\boxed{", -1)
    return F.when(~F.contains(text, F.lit("\\boxed{")), F.lit(False)).otherwise(_scan(F.concat(F.lit("{"), tail))["done"])


def boxed_answer(text: Column) -> Column:
    """The content of the last box: inside its braces (to the end if they never close), or up to a dollar sign.

    Line breaks with indent, a leading colon, one trailing full stop and one trailing stroke go. Without the word
    ``boxed`` the answer is empty; NULL gives NULL.
    """
    tail = F.substring_index(text, "boxed", -1)
    scan = _scan(tail)
    inner = F.when(scan["done"], F.substring(tail, F.lit(2), scan["n"] - 2)).otherwise(F.substring(tail, F.lit(2), F.length(tail)))
    raw = F.when(F.substring(tail, 1, 1) == "{", inner).otherwise(F.trim(F.substring_index(tail, "$", 1)))
    a = F.regexp_replace(raw, "\\n\\s*", "")
    for pattern in ("^:", "\\.$", "/$"):
        a = F.regexp_replace(a, pattern, "")
    return F.when(F.contains(text, F.lit("boxed")), a).otherwise(F.when(text.isNotNull(), F.lit("")))


def answer_kind(answer: Column) -> Column:
    """none, mc (a letter A-E), numeric, text (three words of three letters outside commands), or expression."""
    a = F.trim(F.coalesce(answer, F.lit("")))
    plain = F.regexp_replace(a, "[\\s,$%]|\\\\!", "")
    words = F.regexp_count(F.regexp_replace(a, "\\\\[a-zA-Z]+", " "), F.lit("[A-Za-z]{3,}"))
    return (
        F.when(a == "", "none")
        .when(a.rlike("^\\(?[A-E]\\)?\\.?$"), "mc")
        .when(plain.rlike("^[-+]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)$"), "numeric")
        .when(words >= 3, "text")
        .otherwise("expression")
    )


def proof_like(prompt: Column, kind: Column) -> Column:
    """The prompt's first 300 characters open a proof, or the answer is a text."""
    return F.coalesce(F.substring(prompt, 1, 300).rlike(PROOF), F.lit(False)) | (kind == "text")


def max_line_repeat(text: Column, least: int = 30) -> Column:
    """How often the most frequent of the trimmed lines of at least ``least`` characters occurs; 0 without one."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: F.length(x) >= least)
    counts = F.transform(F.array_distinct(lines), lambda x: F.size(F.filter(lines, lambda y: y == x)))
    return F.coalesce(F.array_max(counts), F.lit(0))


def quality_flags(prompt: Column, text: Column, repeats: Column, looping: Column | None = None) -> dict[str, Column]:
    """Upstream's flags: repeated lines or (where given) a looping tail, Chinese in answers to prompts without, malformed think tags, any of them."""
    opens, closes = occurrences(text, "<think>"), occurrences(text, "</think>")
    repetition = F.coalesce(repeats >= 25, F.lit(False))
    if looping is not None:
        repetition = repetition | F.coalesce(looping, F.lit(False))
    mix = F.coalesce((count_matches(prompt, CJK) == 0) & (count_matches(text, CJK) >= 20), F.lit(False))
    malformed = F.coalesce((opens != 1) | (closes > 1), F.lit(True))
    return {"flag_repetition": repetition, "flag_lang_mix": mix, "flag_malformed": malformed, "flagged": repetition | mix | malformed}


def without_thought(text: Column) -> Column:
    """The text without its think part and the line breaks that follow it."""
    return F.regexp_replace(F.regexp_replace(text, "(?s)<think>\\n?.*?</think>\\s*", ""), "^\\n+", "")


def choice_letter(text: Column, last: bool = True) -> Column:
    """The last (or first) letter A-E that stands alone in the upper-cased text; the trimmed text without one."""
    found = F.regexp_extract_all(F.upper(text), F.lit("\\b(A|B|C|D|E)\\b"), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1 if last else 1)), F.regexp_replace(F.trim(text), "\\.$", ""))


def number(text: Column) -> Column:
    """The number a text states: commas go, a per cent sign divides by 100; NULL if it states none."""
    t = F.trim(F.regexp_replace(text, ",", ""))
    per = t.endswith("%")
    return F.when(per, F.regexp_replace(t, "\\\\?%$", "").try_cast("double") / 100).otherwise(t.try_cast("double"))


def numbers_equal(a: Column, b: Column, absolute: float = 1e-4, relative: float = 1e-9) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(relative) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def keys_lowered(names: list[str]) -> list[str]:
    return [n.lower() for n in names]
