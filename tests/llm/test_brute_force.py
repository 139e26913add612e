"""The training-data operators against plain versions of themselves on small tables."""

import json
import random
import re
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from curata.llm import budget, common, copies, leak, mixture, ngrams, packing, repeats

WORDS = "the a river stone seven blue under table counts of every second tall runs green 12 34 left right near".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# 1 ------------------------------------------------------------------------------------------------------------------
def held_plain(doc, item):
    """Most words of the item in passages of eight or more running words, in order: exhaustive chain."""
    a, b = re.findall("[a-z0-9]+", doc.lower()), re.findall("[a-z0-9]+", item.lower())
    parts = []
    for i in range(len(a)):
        for j in range(len(b)):
            if a[i] == b[j] and (i == 0 or j == 0 or a[i - 1] != b[j - 1]):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                if n >= 8:
                    parts.append((i, j, n))
    return leak.chained(parts), len(b)


def test_leaks_match_brute_force(spark):
    rng = random.Random(1)
    items = [(k, text(rng, rng.randint(5, 60))) for k in range(12)] + [(90, None), (91, ""), (92, "too short")]
    docs = []
    for k in range(60):
        item = rng.choice(items[:12])[1].split()
        cut = rng.randint(0, len(item))
        body = " ".join(item[:cut]) + " " + text(rng, rng.randint(0, 30)) + " " + " ".join(item[cut:] if k % 2 else item[cut + 3 :])
        docs.append((k, body.upper() if k % 3 == 0 else re.sub(" ", "  ,\n$", body)))
    docs += [(100, None), (101, ""), (102, " ".join(items[0][1] for _ in range(400)))]
    want = set()
    for i, d in docs:
        for j, t in items:
            if d and t:
                held, n = held_plain(d, t) if len(d) < 9000 else held_plain(items[0][1], t)
                if n >= 8 and held >= n / 2:
                    want.add((i, j))
    got = leak.matches(spark.createDataFrame(docs, "pool_idx bigint, output string"), spark.createDataFrame(items, "id bigint, problem string"), "pool_idx", "output", "id", "problem")
    assert {(r.pool_idx, r.item_id) for r in got.collect()} == want
    assert leak.without_leaks(spark.createDataFrame(docs, "pool_idx bigint, output string"), got, "pool_idx").count() == len(docs) - len({i for i, _ in want})


def test_every_maximal_match_in_any_script(spark, monkeypatch):
    """Chinese, Russian and French items; a small part of a long item; passages that many items and places share."""
    rng = random.Random(11)
    zh, ru, fr = "求所有满足方程的正整数的个数并说明理由", "найдите все целые числа для которых выполнено это равенство и сумма равна нулю", "été après été où l'élève étudie déjà la même équation générale très compliquée"
    long_item = " ".join(f"w{k}" for k in range(500))
    items = [(1, zh), (2, ru), (3, fr), (4, long_item), *((10 + k, f"{text(random.Random(5), 12)} tail{k} of this item") for k in range(6)), (30, "aa " * 40)]
    docs = [(1, f"前言：{zh}。后记"), (2, f"... {ru.upper()}!"), (3, f"Voici: {fr} fin"), (4, f"intro {' '.join(long_item.split()[100:340])} outro"), (5, f"{text(random.Random(5), 12)} x " * 7), (6, "aa " * 60), (7, None), (8, "")]
    d, i = spark.createDataFrame(docs, "pool_idx bigint, output string"), spark.createDataFrame(items, "id bigint, problem string")

    def plain():
        out = set()
        for k, t in docs:
            a = leak.words([t])[:-1]
            for j, u in items:
                b = leak.words([u])[:-1]
                for x in range(len(a)):
                    for y in range(len(b)):
                        if a[x] == b[y] and (x == 0 or y == 0 or a[x - 1] != b[y - 1]):
                            n = 0
                            while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                                n += 1
                            if n >= 8:
                                out.add((k, j, x, y, n))
        return out

    want = plain()
    for most in (leak.MOST_HITS, 50):  # also in small parts of the hits
        monkeypatch.setattr(leak, "MOST_HITS", most)
        assert {tuple(r)[:5] for r in leak.passages(d, i, "pool_idx", "output", "id", "problem").collect()} == want
        own = leak.Items([k for k, _ in items], [t for _, t in items])  # here, not in a worker: the parts of the hits
        assert {(docs[t][0], own.ids[k], p, j, n) for t, k, p, j, n in leak.shard_matches(own, [t for _, t in docs])} == want
    leaked = {(r.pool_idx, r.item_id) for r in leak.matches(d, i, "pool_idx", "output", "id", "problem").collect()}
    assert {(1, 1), (2, 2), (3, 3)} <= leaked and (4, 4) not in leaked and (4, 4, 1, 100, 240) in want
    assert (4, 4) in {(r.pool_idx, r.item_id) for r in leak.matches(d, i, "pool_idx", "output", "id", "problem", min_share=0.3).collect()}


def test_leaks_in_blocks_and_empty(spark, monkeypatch):
    rng = random.Random(2)
    items = spark.createDataFrame([(k, text(rng, 40)) for k in range(9)], "id bigint, problem string")
    docs = items.select(F.col("id").alias("pool_idx"), F.col("problem").alias("output"))
    monkeypatch.setattr(leak, "PASS_ITEMS", 2)
    assert leak.matches(docs, items, "pool_idx", "output", "id", "problem").count() >= 9
    assert leak.matches(docs.limit(0), items, "pool_idx", "output", "id", "problem").count() == 0
    assert leak.matches(docs, items.limit(0), "pool_idx", "output", "id", "problem").count() == 0


def test_binary_search():
    rng = np.random.default_rng(0)
    keys = [rng.integers(0, 3, 500) for _ in range(4)]
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    rows = list(zip(*(k.tolist() for k in keys)))
    wanted = [rng.integers(0, 3, 50) for _ in range(4)]
    lo, hi = leak.bound(keys, wanted, False), leak.bound(keys, wanted, True)
    for q, a, b in zip(zip(*(w.tolist() for w in wanted)), lo, hi):
        assert rows.count(q) == b - a and all(r == q for r in rows[a:b])


# 2 ------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    "a,b,same",
    [
        ("Find  x, if y = 3.", "“find x if Y = 3”", True), ("rows of 12 34", "rows of 1 234", False), ("x = 3.5", "x = 35", False), ("x - 3", "x + 3", False), ("x * 3", "x - 3", False),
        ("1,234 ok", "1234 ok", False), ("读取24行，每行3个", "读取24行　每行3个", True), ("a well-known fact", "a well known fact", True), ("tracewell_math", "Tracewell-Math", True), (None, "", True), ("...", "", True), ("１２ cats", "12 cats", True), ("5x", "5 x", True), ("größte Reihe", "GRÖSSTE REIHE", True), ("x^2", "x2", False), ("a\u200bb", "ab", True),
    ],
)
def test_canonical(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a string, b string").fillna("")
    r = df.select(copies.canonical(F.col("a")).alias("a"), copies.canonical(F.col("b")).alias("b")).first()
    assert (r.a == r.b) is same


def test_copies_match_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for k in range(200):
        base = rng.choice([f"Add {n} and {n + 1}" for n in range(12)])
        form = rng.choice([str, str.upper, lambda s: f' "{s}"  ', lambda s: s.replace(" ", "\t\n")])
        rec = {"instruction": form(base), "input": rng.choice(["", None, " "]), "system": "s", "extra_info": {"category": "math", "source": rng.choice(["a_b", "A B"]), "index": k}}
        if k % 3 == 0:
            rec.pop("input")
        if k % 2:
            rec = dict(reversed(rec.items()))
        rows.append((k, json.dumps(rec, ensure_ascii=k % 5 == 0, indent=1 if k % 4 == 0 else None)))
    rows += [(300, "not json"), (301, "Not JSON!"), (302, None), (303, None), (304, "[1]"), (None, "{}")]
    raw = spark.createDataFrame(rows, "pool_idx bigint, record string")
    groups = {}
    for k, r in rows:
        if k is not None:
            key = re.findall(r"\d+", json.loads(r)["instruction"])[0] if k < 300 else re.sub(r"\W", "", r.lower()) if k < 302 else r
            groups.setdefault(key, []).append(k)
    want = {(min(g), k) for g in groups.values() for k in g if k != min(g)}
    five = ("instruction", "input", "system", "extra_info.category", "extra_info.source")
    assert {(r["keep"], r["copy"]) for r in copies.copies(raw, "pool_idx", "record", five).collect()} == want
    assert {(r["keep"], r["copy"]) for r in copies.copies(raw, "pool_idx", "record", ignored=("extra_info.index",)).collect()} == want
    _, kept = copies.groups(raw, "pool_idx", "record", five)
    assert sum(r.n for r in kept.collect()) == 205


def test_all_fields_count(spark):
    """A sixth field, nested ones and lists are content; their order and the records' formatting aren't."""
    rows = [
        '{"a": "x", "b": {"c": "Y", "d": {"e": 1}}, "f": [1, 2]}', '{"f": [1,2], "b": {"d": {"e": 1}, "c": " y. "}, "a": "X"}', '{"a": "x", "b": {"c": "y", "d": {"e": 2}}, "f": [1, 2]}',
        '{"a": "x", "b": {"c": "y", "d": {"e": 1}}, "f": [2, 1]}', '{"a": "x", "b": {"c": "y", "d": {"e": 1}}, "f": [1, 2], "g": "more"}', '{"a": "x", "b": {"c": "y", "d": {"e": 1}}, "f": [1, 2], "g": null, "h": ""}', "{}", '{"z": null}', '{"b": "x"}', '{"a": "x"}', '{"a": ',
    ]
    raw = spark.createDataFrame(list(enumerate(rows)), "k bigint, r string")
    assert {(r["keep"], r["copy"]) for r in copies.copies(raw, "k", "r").collect()} == {(0, 1), (0, 5), (6, 7)}
    assert {(r["keep"], r["copy"]) for r in copies.copies(raw, "k", "r", ignored=("g", "b.d.e")).collect()} >= {(0, 1), (0, 2), (0, 4), (0, 5), (6, 7)}


def test_forms_of_one_value(spark):
    """A third of the distinct raw values are forms of one canonical value."""
    raw = spark.range(6000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, F.concat(F.lit('{"a": "same'), F.repeat(F.lit("."), F.col("id").cast("int")), F.lit('"}'))).otherwise(F.concat(F.lit('{"a": "n'), "id", F.lit('"}'))).alias("r"))
    got = copies.copies(raw, "k", "r")
    assert got.count() == 1999 and got.where("keep <> 0").count() == 0


def test_copies_of_a_hot_group(spark):
    raw = spark.range(9000).select(F.col("id").alias("pool_idx"), F.when(F.col("id") % 3 == 0, F.lit('{"instruction": "same"}')).otherwise(F.concat(F.lit('{"instruction": "n'), "id", F.lit('"}'))).alias("record"))
    got = copies.copies(raw, "pool_idx", "record")
    assert got.count() == 2999 and got.where("keep <> 0").count() == 0
    assert copies.copies(raw.limit(0), "pool_idx", "record").count() == 0


# 4 ------------------------------------------------------------------------------------------------------------------
def share_plain(t):
    words = re.findall(r"\w+", t.lower())
    seen, marked = set(), set()
    for i in range(len(words) - 5):
        g = tuple(words[i : i + 6])
        if g in seen:
            marked.update(range(i, i + 6))
        seen.add(g)
    return len(words), len(marked)


def test_repeats_match_brute_force():
    rng = random.Random(4)
    texts = [None, "", "...", "one"]
    for k in range(80):
        t = text(rng, rng.randint(0, 40)).replace("12", "twelve").replace("34", "x")
        texts.append(" ".join([t] * (k % 4)) + " " + text(rng, 10).replace("12", "q").replace("34", "x"))
    n, r = repeats.repeated_shares(texts)
    assert [(int(a), int(b)) for a, b in zip(n, r)] == [share_plain(t or "") for t in texts]


def test_running_numbers_and_chinese():
    line = "Sorting the pages by weight costs nothing"
    for form in ("{}. {}", "({}) {}", "#{} {}", "{}: {}"):
        n, r = repeats.repeated_shares(["\n".join(form.format(k, line) for k in range(1, 6))])
        assert r[0] >= 0.7 * n[0]
    n, r = repeats.repeated_shares(["这条直线的斜率等于五。" * 3, "这条直线的斜率。这条直线的斜率。"])
    assert r[0] >= n[0] / 3 and r[1] == 0


def test_hosts_are_shrunk(spark):
    bad = "the same six words come again. " * 5
    rows = [(k, bad if k % 2 else "plain words", "loud") for k in range(40)] + [(100 + k, "plain words", "calm") for k in range(400)] + [(900, bad, "tiny"), (901, None, None)]
    got = {r.host: r for r in repeats.host_rates(repeats.text_rule(spark.createDataFrame(rows, "i bigint, t string, h string"), "i", "t", "h").cache()).collect()}
    assert got["loud"].bad_host and not got["calm"].bad_host
    assert got["tiny"].rate == 1 and 0.05 < got["tiny"].shrunk_rate < 0.9
    out = repeats.verdicts(spark.createDataFrame(rows, "i bigint, t string, h string"), "i", "t", "h")
    assert out.count() == len(rows) and out.where("fails").count() == 21
    assert repeats.verdicts(spark.createDataFrame([], "i bigint, t string, h string"), "i", "t", "h").count() == 0


def test_host_rates_decide(spark, monkeypatch):
    """A text just under the third fails in a host of repetitive texts and passes in a calm one; without hosts it never fails."""
    rng = random.Random(44)
    bad, near = "the same six words come again. " * 5, ""
    words = iter(f"w{k}" for k in range(100_000))
    block = [next(words) for _ in range(31)]
    near = " ".join([*block, *(next(words) for _ in range(37)), *block])  # 31 of 99 words repeat: 0.313
    rows = [(k, bad if k % 4 else near, "loud") for k in range(200)] + [(1000 + k, near if k % 50 == 0 else text(rng, 30), "calm") for k in range(2000)]
    df = spark.createDataFrame(rows, "i bigint, t string, h string")
    own = {i for i, t, _ in rows if t == bad}
    border = {i for i, t, h in rows if t == near and h == "loud"}
    out = repeats.verdicts(df, "i", "t", "h").cache()
    assert {r.i for r in out.where("rule_fails").collect()} == own
    assert {r.i for r in out.where("fails").collect()} == own | border
    monkeypatch.setattr(repeats, "MOST_DOUBLINGS", 0)
    assert {r.i for r in repeats.verdicts(df, "i", "t", "h").where("fails").collect()} == own


# 5 ------------------------------------------------------------------------------------------------------------------
def test_longest_match_is_linear_and_exact():
    rng = random.Random(5)
    vocabulary = {"▁", "▁a", "ab", "abc", "▁abcab", "b", "c", "cab", "bca", "▁ca", "x"}
    m = budget.LongestMatch(vocabulary)
    for _ in range(3000):
        w = "".join(rng.choice("abcx日") for _ in range(rng.randint(0, 14)))
        s, n, i = "▁" + w, 0, 0
        while i < len(s):
            k = next((k for k in range(len(s), i, -1) if s[i:k] in vocabulary), 0)
            n += 1 if k else len(s[i].encode())
            i = k or i + 1
        assert m.word("▁" + w) == n, w
    assert m.count(None) == 0 and m.count("") == 0


@pytest.mark.parametrize("extra", [set(), {"a▁b"}, {"\n\n", "c\n"}])
def test_whole_texts_with_white_space_are_exact(extra):
    """Tabs, indentation, runs of blanks and line breaks count as a plain longest match over the whole text counts them."""
    rng = random.Random(55)
    vocabulary = {"▁", "▁▁", "▁▁▁▁", "▁a", "ab", "abc", "b", "c", "▁▁b", "}\r"} | extra
    m = budget.LongestMatch(vocabulary)
    for _ in range(2000):
        t = "".join(rng.choice(["a", "b", "c", " ", " ", "    ", "\t", "\n", "}", "\r", "日"]) for _ in range(rng.randint(0, 20)))
        s, n, i = "▁" + t.replace(" ", "▁") if t else "", 0, 0
        while i < len(s):
            k = next((k for k in range(min(len(s), i + 6), i, -1) if s[i:k] in vocabulary), 0)
            n += 1 if k else 1 if any(s[i] in p for p in vocabulary) and s[i] in vocabulary else len(s[i].encode())
            i = k or i + 1
        assert m.count(t) == n, repr(t)


def test_budget_is_close_to_the_tokenizer():
    spm = pytest.importorskip("sentencepiece")
    import os

    if not os.path.exists(os.path.join(common.TOKENIZERS, budget.VOCABULARY)):
        pytest.skip("no vocabulary here")
    sp = spm.SentencePieceProcessor(model_file=os.path.join(common.TOKENIZERS, budget.VOCABULARY))
    lines = ["The slope between the marked points equals 12/35.", "Die Steigung der Geraden beträgt 4/7, also bleibt ein Rest.", "Hay que tener cuidado, porque 45 se cuenta dos veces.", "Угловой коэффициент прямой равен 3.", "def f(x):\n    for k in range(x):\n        print(k,\t\tx)\n"] * 5
    exact, ours = sum(len(sp.encode(t)) for t in lines), sum(budget.vocabulary().count(t) for t in lines)
    assert abs(ours / exact - 1) < 0.05


def test_piece_counts_equal_the_encoder():
    import os

    if not os.path.exists(os.path.join(common.TOKENIZERS, "byte_bpe_50k.tiktoken")):
        pytest.skip("no vocabulary here")
    c = common.PieceCounter()
    for t in ("", " ", "Hello  world's\n\n  end ", "高线把底边分成 12 段", "x" * 5000, "a​b\x00c", "don't I'll we've"):
        assert c.count(t) == len(c.encoding.encode_ordinary(t))
    assert c.count(None) == 0


def test_totals(spark):
    rows = [(1, "A b", "en-US", "Math", "one two", None), (2, "a_b", "EN", "math", "", "three"), (3, None, "xx", None, None, None)]
    df = spark.createDataFrame(rows, "pool_idx bigint, source string, lang string, domain string, prompt string, output string")
    got = budget.totals(budget.counted(df, "pool_idx", ("prompt", "output"))).collect()
    assert {(r.source, r.lang, r.domain, r.n_rows) for r in got} == {("a_b", "en", "math", 2), (None, "und", None, 1)}


# 7 ------------------------------------------------------------------------------------------------------------------
def test_hilbert_curve_is_a_bijection_of_neighbours():
    bits = 3
    points = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    place = packing.hilbert(points, bits)
    assert sorted(place) == list(range(512))
    along = points[np.argsort(place)]
    assert all(abs(a - b).sum() == 1 for a, b in pairwise(along.astype(int)))


def test_packing_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANGE_DOCS", 60)
    rng = random.Random(6)
    rows = [(k, text(rng, rng.choice([0, 3, 30, 300, 2000]))) for k in range(80)] + [(200 + k, "copy of one text") for k in range(60)] + [(400, None), (401, "")]
    docs, plans = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(1, 64), (2, 512)], "plan_id int, capacity_tokens bigint")
    got = packing.packed(docs, plans).collect()
    c = common.PieceCounter()
    for plan, cap in ((1, 64), (2, 512)):
        mine = [r for r in got if r.plan_id == plan]
        by, size = {}, {}
        for r in mine:
            by.setdefault(r.doc_id, []).append(r.tokens)
            size[r.container] = size.get(r.container, 0) + r.tokens
        assert max(size.values()) <= cap
        for k, t in rows:
            n = c.count(t)
            assert sum(by[k]) == n and len(by[k]) == max(1, -(-n // cap))
    assert packing.packed(docs.limit(0), plans).count() == 0
    assert all(r.fill_share > 0.7 for r in packing.fill(packing.packed(docs, plans)).collect())


def test_containers_hold_neighbours_of_the_curve(spark, monkeypatch):
    """The walk follows the Hilbert key: without it the same documents lie in other containers, farther apart."""
    monkeypatch.setattr(packing, "NEIGHBOURS", 8)
    monkeypatch.setattr(packing, "OPEN", 4)
    rng = random.Random(61)
    rows = [(k, rng.randint(5, 60), rng.randrange(1 << 30)) for k in range(600)]
    items = spark.createDataFrame(rows, "doc_id bigint, tokens bigint, place bigint")
    place = {k: p for k, _, p in rows}

    def spread_of(ranges):
        got = packing.walked(ranges, [(1, 128)]).collect()
        by = {}
        for r in got:
            by.setdefault(r.container, set()).add(r.doc_id)
        return {frozenset(v) for v in by.values()}, np.mean([max(map(place.get, v)) - min(map(place.get, v)) for v in by.values()])

    monkeypatch.setattr(packing, "RANGE_DOCS", 300)
    ranges = packing.along_the_curve(items)
    assert "rangepartitioning(place" in ranges._jdf.queryExecution().toString()
    with_key, near = spread_of(ranges)
    without, far = spread_of(items.coalesce(1))
    assert with_key != without and near < far / 10
    monkeypatch.setattr(packing, "RANGE_DOCS", 100)  # a third in one place: divided by document
    crowd = packing.along_the_curve(items.withColumn("place", F.when(F.col("doc_id") % 3 == 0, 7).otherwise(F.col("place"))))
    assert max(r.n for r in crowd.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()) < 200


# 8 ------------------------------------------------------------------------------------------------------------------
def test_sainte_lague_by_brute_force():
    rng = random.Random(7)
    for _ in range(300):
        w = [rng.choice([0, 1, 2.5, 3, 7, 20, 41]) for _ in range(rng.randint(1, 6))]
        seats = rng.randint(0, 60)
        got = [0] * len(w)
        if sum(w):
            for _ in range(seats):
                k = max(range(len(w)), key=lambda k: (w[k] / (2 * got[k] + 1), -k))
                got[k] += 1
        assert mixture.sainte_lague(w, seats) == got


def test_mixture_keeps_shares_and_caps(spark):
    rng = random.Random(8)
    rows = [(k, text(rng, 60), rng.choice(["Big", "big", " BIG "])) for k in range(900)] + [(1000 + k, text(rng, 60), "small") for k in range(300)] + [(2000, None, "big"), (2001, "x y", None), (2002, "x", "other")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    goals = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 2), ("absent", 0.1, 3)], "source string, target_share double, max_repeats int")
    mix = mixture.mixed(docs, goals)
    assert mix.where("source = 'small' AND copies > 2 OR source = 'big' AND copies > 1").count() == 0
    got = {r.source: r for r in mixture.shares(mix, goals).collect()}
    assert abs(got["big"].actual_share - 5 / 9) < 0.02 and got["absent"].tokens == 0
    assert sorted(map(str, mix.collect())) == sorted(map(str, mixture.mixed(docs.repartition(7), goals).collect()))
    assert mixture.mixed(docs.limit(0), goals).count() == 0


def test_targets_of_one_source_are_one(spark):
    rng = random.Random(81)
    docs = spark.createDataFrame([(k, text(rng, 40), "Big" if k % 2 else "b i g") for k in range(100)], "doc_id bigint, text string, source string").withColumn("source", F.lit("Big"))
    goals = spark.createDataFrame([("big", 0.5, 1), ("BIG", 0.5, 2)], "source string, target_share double, max_repeats int")
    mix = mixture.mixed(docs, goals)
    assert mix.where("copies > 1").count() == 0 and mix.count() == mix.select("doc_id").distinct().count()
    assert [(r.source, r.target_share) for r in mixture.shares(mix, goals).collect()] == [("big", 1.0)]


def test_many_shards_and_no_preference_for_short_documents(spark, monkeypatch):
    """More shards than groups; long and short documents are taken as often."""
    monkeypatch.setattr(mixture, "SHARD_DOCS", 150)
    monkeypatch.setattr(mixture, "GROUPS", 3)
    monkeypatch.setattr(mixture, "BLOCK", 32)
    rng = random.Random(82)
    rows = [(k, text(rng, 80 if k % 2 else 8), "a") for k in range(1200)] + [(5000 + k, text(rng, 60), "b") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    mix = mixture.mixed(docs, spark.createDataFrame([("a", 0.6, 1), ("b", 0.4, 1)], "source string, target_share double, max_repeats int"))
    got = {r.source: r for r in mixture.shares(mix, spark.createDataFrame([("a", 0.6), ("b", 0.4)], "source string, target_share double")).collect()}
    assert abs(got["a"].actual_share - 0.6) < 0.02
    n = [sum(r.source == "a" and r.doc_id % 2 == odd for r in mix.collect()) for odd in (0, 1)]
    assert abs(n[0] - n[1]) < 0.25 * max(n), n


def test_quotas_of_many_shards():
    rng = random.Random(83)
    shards = [float(rng.randint(1, 10**6)) for _ in range(100_000)]
    got, seat = mixture.sainte_lague(shards, 3_000_000), 3_000_000 / sum(shards)
    assert sum(got) == 3_000_000 and max(abs(q - w * seat) for q, w in zip(got, shards)) < 1


# n-grams ------------------------------------------------------------------------------------------------------------
def test_hashed_sums_match_plain_ones():
    rng = np.random.default_rng(9)
    texts = ["", "ab", "héllo wörld", "日本", "aaaa", "x"]
    table = rng.normal(size=(1 << 10, 2))
    for presence in (True, False):
        got, n = ngrams.linear(texts, table, (1, 2, 3), presence)
        for k, t in enumerate(texts):
            g = [t[i : i + m] for m in (1, 2, 3) for i in range(len(t) - m + 1)]
            row = [ngrams.grams([x], (len(x),), 10, True)[1][0] for x in (dict.fromkeys(g) if presence else g)]
            row = sorted(set(row)) if presence else row
            assert n[k] == len(row)
            assert np.allclose(got[k], table[row].sum(0) if row else 0)
