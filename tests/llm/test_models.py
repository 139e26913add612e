"""Accuracy on held-out rows, and awkward inputs, of the operators with models."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from curata.llm import language, pairs, queries, toxic

ROOT = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def pool(spark):
    if not os.path.isdir(ROOT):
        pytest.skip("no test tables here")
    return spark.read.parquet(f"{ROOT}/audit_pool.parquet").select("pool_idx", "prompt", "output", "lang", "truncated")


@pytest.fixture(scope="module")
def model(pool):
    return language.train(pool, "pool_idx", "output", "lang")


def test_languages_agree_with_good_labels(pool, model):
    rows = pool.where("lang IN ('en', 'zh', 'fr', 'de', 'es', 'pt', 'ru') AND length(output) > 200").collect()
    got = language.Reader(model).segments([r.output for r in rows], [None] * len(rows))
    hit = sum(any(s[0] == r.lang for s in g) for r, g in zip(rows, got))
    assert hit / len(rows) > 0.93  # some labels are wrong


SENTENCES = {
    "en": "We should look at the second part of this question before we go on.", "de": "Wir sollten uns zuerst den zweiten Teil der Frage ansehen, weil er leichter ist.",
    "fr": "Nous devons d'abord regarder la deuxième partie de la question avant de continuer.", "es": "Primero debemos mirar la segunda parte de la pregunta porque es más fácil.",
    "pt": "Primeiro devemos olhar para a segunda parte da pergunta, porque é mais fácil.", "ru": "Сначала нужно посмотреть на вторую часть вопроса, потому что она проще.", "zh": "我们应该先看这个问题的第二部分然后再继续。",
}


def test_sentences_from_elsewhere(model):
    for k, s in SENTENCES.items():
        got = language.Reader(model).segments([s], [None])[0]
        assert [x[0] for x in got if x[5]] == [k], (k, got)


def test_the_kernel_knows_scripts_and_other_languages(spark):
    """Chinese and Russian come from the kernel as all do, and the languages are a parameter: Italian and Ukrainian are learned like the rest."""
    it = ["Dobbiamo guardare prima la seconda parte della domanda.", "Questa regola vale anche per gli altri casi, come si vede subito.", "Il risultato della somma è quindi più grande del primo numero.", "Se leggiamo di nuovo il testo, il limite non cambia."]
    uk = ["Спочатку треба подивитися на другу частину питання.", "Це правило діє також для інших випадків, як одразу видно.", "Результат суми отже більший за перше число.", "Якщо ще раз прочитати умову, межа не змінюється."]
    ru = ["Сначала нужно посмотреть на вторую часть вопроса.", "Это правило действует и для других случаев, как сразу видно.", "Результат суммы поэтому больше первого числа.", "Если ещё раз прочитать условие, предел не меняется."]
    rows = [(100 * k + n, t * 2, lang) for k, (lang, ts) in enumerate({"it": it, "uk": uk, "ru": ru}.items()) for n, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "pool_idx bigint, output string, lang string")
    model = language.train(df, "pool_idx", "output", "lang", ("it", "uk", "ru"))
    tests = {"it": "Questa parte della regola non vale per il secondo numero.", "uk": "Ця частина правила не діє для другого числа, якщо умову прочитати ще раз.", "ru": "Эта часть правила не действует для второго числа, если условие прочитать ещё раз."}
    for k, t in tests.items():
        assert language.Reader(model).segments([t], [None])[0][0][0] == k
    zeroed = language.Model(model.table * 0, model.langs)  # nothing beside the kernel decides
    assert {language.Reader(zeroed).segments([t], [None])[0][0][0] for t in tests.values()} == {"it"}


def test_mixed_and_awkward_texts(spark, model):
    rows = [
        (1, f"{SENTENCES['en']} {SENTENCES['zh']}", "en"), (2, SENTENCES["de"], None), (3, SENTENCES["fr"], "FR-ca"), (4, SENTENCES["es"], "de"), (5, None, "en"), (6, "", None), (7, "42 = x + y", "en"),
        (8, f"{SENTENCES['en']} (vis-à-vis)", "en"), (9, f"{SENTENCES['ru']} ```python\nprint('hello this is code for you')\n```", "ru"), (10, f"{SENTENCES['en']} " * 3000, "en"),
    ]
    df = spark.createDataFrame(rows, "pool_idx bigint, output string, lang string")
    got = sorted((r.pool_idx, r.lang) for r in language.present(df, model, "pool_idx", "output", "lang", True).collect())
    assert got == [(1, "en"), (1, "zh"), (2, "de"), (4, "es")]
    assert language.segments(df.limit(0), model, "pool_idx", "output", "lang").count() == 0
    assert language.train(df.where("lang = 'xx'"), "pool_idx", "output", "lang").table.sum() == 0


# 6 ------------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def defect_models(pool):
    return pairs.train(pool, "pool_idx", "output", "lang", "truncated")


PROMPT = "Let 31x - 3.5 = y be the rule written down by Norora. Determine y for x = 105, then add 1593."


@pytest.mark.parametrize(
    "text,want",
    [
        (None, ["empty"]), ("", ["empty"]), ("<think>\n\n</think>\n\\boxed{ }", ["empty"]), ("...", ["empty"]), ("42", []), ("**42**", []), ("$\\boxed{42}$", []),
        (f"Answer: {PROMPT.upper()}", ["copy"]), (f"> {PROMPT}", ["copy"]), (PROMPT.replace(" ", "\n"), ["copy"]), (f"{PROMPT} So we compute the value and find that it is 42.", []),
        ("I'm sorry, but I can’t help with that.", ["refusal"]), ("<think>Let us see.</think>\n\nI must decline to answer this question.", ["refusal"]), ('The program prints "Sorry, I can\'t help with that." when the list is empty.\n\n$\\boxed{3}$', []),
        ("I cannot factor this over the integers, so I switch to the quadratic formula.\n\nThe value is $\\boxed{4}$.", []),
        ("<think>First we look at the rule", ["truncated"]), ("The value is $\\boxed{4", ["truncated"]), ("```python\nprint(1)", ["truncated"]), ("We see that the rule holds for the", ["truncated"]), ("The remaining cases are as follows:", ["truncated"]), ("The rule gives the value 3.", []),
        ("So the rule gives the value as above.\n\nAnswer: \\frac{5}{38}", []), ("So the rule gives the value as above, that is \\frac{5}", ["truncated"]),
        ("Hier muss man aufpassen, weil die Regel zweimal gezählt wird. Das Ergebnis der Aufgabe ist also gleich 5.", ["language"]),
    ],
)
def test_defects(defect_models, text, want):
    assert pairs.defects(PROMPT, text, *defect_models) == want


def test_compression_decides_copies(defect_models, monkeypatch):
    """Copies are told by compression: with a dictionary that isn't the prompt none is found."""
    rows = [f"Q: {PROMPT}", PROMPT.upper(), f"{PROMPT} The answer is that y equals the sum of both, which we get by the rule.", PROMPT[: len(PROMPT) // 2], "42", PROMPT.replace(",", " ; ")]
    assert [pairs.is_copy(PROMPT, t) for t in rows] == [True, True, False, False, False, True]
    assert not pairs.is_copy("", PROMPT) and not pairs.is_copy(None, PROMPT) and pairs.rest_beside(b"", b"x") == 0
    plain = pairs.zstandard.ZstdCompressionDict
    monkeypatch.setattr(pairs.zstandard, "ZstdCompressionDict", lambda data, dict_type: plain(b"other words of another kind", dict_type=dict_type))
    assert not any(pairs.is_copy(PROMPT, t) for t in rows)


def test_refusal_before_advice(defect_models):
    text = "<think>Hm.</think>\n\nI'm sorry, but I can't help with that.\n\nYou might ask a teacher or look into a textbook."
    assert "refusal" in pairs.defects(PROMPT, text, *defect_models)
    assert "refusal" not in pairs.defects(PROMPT, "<think>Hm.</think>\n\nI cannot answer this in general.\n\nFor x = 105 the value is y = 3251.5.", *defect_models)


def test_asked_language_is_no_defect(defect_models):
    assert pairs.defects(PROMPT + " Please write the whole answer in German.", "Hier muss man aufpassen, weil die Regel zweimal gezählt wird. Das Ergebnis der Aufgabe ist also gleich 5.", *defect_models) == []
    assert pairs.defects(None, "The rule gives the value 3.", *defect_models) == []


def test_defects_of_odd_tables(spark, defect_models):
    df = spark.createDataFrame([(1, None, None), (2, "", "x" * 50_000), (2, "", "x" * 50_000)], "pool_idx bigint, prompt string, output string").withColumn("defect", F.lit("clash"))
    got = pairs.defective(df, defect_models, "pool_idx", "prompt", "output")
    assert ("empty" in {r.defect for r in got.collect()}) and got.columns == ["pool_idx", "defect"]
    assert pairs.defective(df.limit(0), defect_models, "pool_idx", "prompt", "output").count() == 0


def test_contexts_count_all_rows(spark):
    """Every whole text counts, however many there are."""
    rows = [(i, "We add the tables.", "en", i >= 7000) for i in range(8000)] + [(8000, "First we add the tables", "en", False)]
    df = spark.createDataFrame(rows, "pool_idx bigint, output string, lang string, truncated boolean")
    _, model = pairs.train(df, "pool_idx", "output", "lang", "truncated")
    assert model.seen["tables"] == (7000, 7000) and model.seen["add the tables"] == (7000, 7000)


# 9 ------------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def content(spark):
    if not os.path.isdir(ROOT):
        pytest.skip("no test tables here")
    return toxic.train(spark.read.parquet(f"{ROOT}/documents.parquet"), spark.read.parquet(f"{ROOT}/doc_labels.parquet"))


@pytest.mark.parametrize("plain,disguised", [("idiot", "i d i o t"), ("idiot", "i-d-i-o-t"), ("moron", "m0r0n"), ("moron", "moronnnnn"), ("idiot", "id​iot"), ("scumbag", "scum​bag"), ("imbecile", "1mb3c1l3"), ("pathetic", "раthеtiс")])
def test_disguises(plain, disguised):
    assert toxic.undisguised(f"you {disguised} there") == f"you {plain} there"


@pytest.mark.parametrize("text,kind", [("You worthless piece of garbage, go and kill yourself.", "abuse"), ("All immigrants are vermin and should be exterminated.", "hate"), ("Free porn, naked girls and xxx movies online.", "sexual"), ("Du bist ein Arschloch, verpiss dich.", "abuse"), ("You w0rthless m0r0n, drop dead", "abuse")])
def test_kinds(content, text, kind):
    p = dict(zip(toxic.KINDS, toxic.Scorer(content).texts([f"A loop over 5 indices touches each cell once. {text} The answer should be near 3."])[0]))
    assert p[kind] >= toxic.THRESHOLD and p[kind] == max(p.values()), p


@pytest.mark.parametrize("text", ["Kill the parent process if it hangs.", "The breast cancer data set has 12 rows.", "The column sex has two values.", "Reading the statement once more, the limit is 5.", "", None, "```python\nprint(1)\n```"])
def test_harmless(content, text):
    assert max(toxic.Scorer(content).texts([text])[0]) < toxic.THRESHOLD


def test_marked_documents_score_higher(spark, content):
    d = spark.read.parquet(f"{ROOT}/documents.parquet")
    s = toxic.scores(d, content)
    assert s.count() == d.count()
    top = s.withColumn("p", F.greatest(*toxic.KINDS)).join(spark.read.parquet(f"{ROOT}/doc_labels.parquet").where("toxic = 1").select("doc_id").distinct(), "doc_id").agg(F.avg("p")).first()[0]
    assert top > 3 * s.agg(F.avg(F.greatest(*toxic.KINDS))).first()[0]
    assert toxic.rates(s).where("any_rate < 0 OR any_rate > 1").count() == 0
    assert toxic.found(toxic.scores(d.limit(0), content)).count() == 0


def test_all_documents_and_reviews_are_tallied(spark):
    """No document and no review is left out of the tallies, and a wording that only reviews know is found."""
    told = "crawl back into your hole and stay there"
    rows = [(i, f"The sum over row {i} is even. {'Case ' + 'abcdefghij'[i % 10] * 2 + ' holds by the rule of signs'}. {told if i % 50 == 0 else 'We go on'}.", "s") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([(i, "a", int(i % 50 == 0)) for i in range(2500)], "doc_id bigint, rater string, toxic int")
    seen, verdict = toxic.read(docs), toxic.verdicts(labels)
    tallies = toxic.tallied(seen, verdict)
    by = {r.text: r for r in toxic.frames(tallies).collect()}
    assert by["the sum over row 0 is even"].places == 3000 and by[told].places == 60
    assert (by[told].r01 + by[told].r11, by[told].r00 + by[told].r10) == (50, 0)
    assert sum(by["the sum over row 0 is even"][c] for c in toxic._MARKS) == 2500
    model = toxic.train(docs, labels, tallies)
    got = {r.doc_id for r in toxic.found(toxic.scores(docs, model, seen, toxic.said(tallies, toxic.shares(verdict)))).collect()}
    assert got == {i for i in range(3000) if i % 50 == 0}


def test_all_queries_run(spark):
    small = "/root/testdata/sf0.001"
    if not os.path.isdir(small):
        pytest.skip("no test tables here")
    columns = {"p1_found": ["pool_idx", "item_id"], "p2_found": ["keep_pool_idx", "copy_pool_idx"], "p3_found": ["pool_idx", "lang"], "p4_found": ["pool_idx"], "p6_found": ["pool_idx", "defect"], "p9_found": ["doc_id", "category"]}
    for name, q in queries.QUERIES.items():
        df = q(spark, small)
        df.count()
        assert df.columns == columns.get(name, df.columns)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, name):
    """Each query that SQL can state, on the smallest tables."""
    import glob

    duckdb = pytest.importorskip("duckdb")
    small = "/root/testdata/sf0.001"
    if not os.path.isdir(small):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = con.execute(queries.ORACLE[name])
    columns = sorted(c[0] for c in want.description)
    rows = sorted(str([r[[c[0] for c in want.description].index(k)] for k in columns]) for r in want.fetchall())
    got = queries.QUERIES[name](spark, small)
    assert sorted(got.columns) == columns
    assert sorted(str([r[k] for k in columns]) for r in got.collect()) == rows and rows


def test_content_fit_counts_ngrams_of_the_same_rows_once(monkeypatch):
    """The fit gathers groups of n-grams, not each n-gram, and gives what single n-grams give, over slices too."""
    rng = np.random.default_rng(4)
    words = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel", "9x", "ß"]
    rows = [" ".join(rng.choice(words, rng.integers(1, 7))) for _ in range(300)] + [""]
    texts = toxic.Features.of(rows)
    kind, weight, easy = rng.integers(-1, 2, 301), rng.uniform(0.5, 3, 301), rng.random(301) < 0.7
    monkeypatch.setattr(toxic, "SLICE_ROWS", 40)
    sizes, make = [], toxic.both_ways
    monkeypatch.setattr(toxic, "both_ways", lambda row, column, *n: sizes.append(len(row)) or make(row, column, *n))
    for of in (easy, None):
        sizes.clear()
        model, mass = toxic.fit(texts, np.arange(301), kind, weight, of)
        at, feature = texts.take(np.arange(301))
        assert max(sizes) < 0.7 * len(feature)
        x = np.zeros((301, 1 << toxic.BITS), bool)
        x[at, feature] = True
        used = np.flatnonzero(x.sum(0) > 1)
        x = x[:, used].astype(float)
        root = np.sqrt(np.maximum(np.bincount(at, minlength=301), 1))
        assert np.allclose(mass[used], weight @ x) and mass.sum() == pytest.approx((weight @ x).sum())
        for k in (0, 1):
            y = (kind == k).astype(float)
            p, q = (y * weight) @ x + toxic.SMOOTH, ((1 - y) * weight) @ x + toxic.SMOOTH
            ratio = np.log(p / ((y * weight).sum() + 2 * toxic.SMOOTH) / (q / (((1 - y) * weight).sum() + 2 * toxic.SMOOTH)))
            ratio[np.abs(ratio) < toxic.LEAST_RATIO] = 0
            turns = np.zeros(301, bool) if of is None else of & (y == 0)
            slices = min(max(turns.sum() // 40, 1), toxic.SLICES)
            part = np.where(turns, (np.cumsum(turns) - 1) % slices, -1)
            share = weight * np.where(y > 0, ((1 - y) * weight).sum() / (y * weight).sum(), 1.0) ** toxic.BALANCE
            share = share / share.sum() * np.where(turns, slices, 1)
            w, b, g2, gb2 = np.full(len(used), 0.3), -1.0, 1e-8, 1e-8
            for step in range(toxic.STEPS):
                d = share * (1 / (1 + np.exp(-(x @ (w * ratio) / root + b))) - y) * ((part < 0) | (part == step % slices))
                g = ratio * (d / root @ x) + toxic.PENALTY * (w - 0.3) / len(used) ** 0.5
                g2, gb2 = g2 + g * g, gb2 + d.sum() ** 2
                w, b = w - 0.15 * g / np.sqrt(g2), b - 0.5 * d.sum() / np.sqrt(gb2)
            assert np.allclose(model.table[used, k], w * ratio, atol=1e-5) and model.bias[k] == pytest.approx(b)
            assert of is None or slices > 1


def test_content_clears_equal_sentences_up_once(spark, content, monkeypatch):
    """Equal sentences are undisguised once, and those of the tallies not again for their scores."""
    seen, one = [], toxic.cleared_up
    monkeypatch.setattr(toxic, "cleared_up", lambda t, *a: seen.append(t) or one(t, *a))
    rows = ["y o u soooo b4d", "You SOOOO b4d.", "y o u soooo b4d", "aa4 bb", "plain  words", ""]
    want = [toxic.undisguised(t) for t in rows]
    seen.clear()
    assert toxic.all_cleared_up([toxic.rough(t) for t in rows]) == want and len(seen) == 5
    docs = spark.createDataFrame([(1, "The s-u-m is 12.5 here. Y0u are an idiot!", "a"), (2, "x. The s-u-m is 7 here.", None), (3, None, "a")], "doc_id bigint, text string, source string")
    units = toxic.read(docs)
    tallies = toxic.tallied(units, spark.createDataFrame([], "doc_id bigint, bad boolean"))
    got, want = (sorted(map(tuple, toxic.scores(docs, content, units, None, t).collect()), key=str) for t in (tallies, None))
    assert np.allclose([r[2:] for r in got], [r[2:] for r in want]) and [r[:2] for r in got] == [r[:2] for r in want] and len(got) == 3


def counted_plainly(texts):
    """Contexts counted word by word over whole texts."""
    seen = {}
    for t in texts:
        p, run = pairs.pieces(t), []
        for k, x in enumerate(p):
            follow = p[k + 1] if k + 1 < len(p) else ""
            if not pairs._word(x):
                run = [] if x[0] in ".!?。！？\n:：;；" else run
                continue
            run.append(x)
            if follow or pairs._BOX.search(t):
                for n in range(1, min(len(run), 3) + 1):
                    c = seen.setdefault(" ".join(run[-n:]), [0, 0])
                    c[0] += 1
                    c[1] += not follow or follow[0] in ".!?。！？;；\n"
    return seen


def test_contexts_take_equal_sentences_apart_once(spark, monkeypatch):
    """Sentences equal but for numbers are taken apart once, over all slices of a task, and the counts are those of every word."""
    rng, words = np.random.default_rng(6), ["the", "sum", "3.5", "1,000", "²", "٣", "don't", "co-op", "文", "a_b", "$x$", "$", "```", "\\boxed{5}", ".5", "x2", ""]
    ends = [" ", " ", ". ", ", ", "…,.", ",.", ";", "：", "。", "\n", "\n\n", "?!", "，。", ""]
    odd = ["".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.integers(0, 14))) for _ in range(2000)] + ["word " * 100_000]
    assert pairs.context_counts(odd) == counted_plainly(odd)
    taken, take = [], pairs._pieces
    monkeypatch.setattr(pairs, "_pieces", lambda t: taken.append(t) or take(t))
    texts = [f"The value is {k}.5 here. So it goes" for k in range(500)] + [None, ""]
    got = pairs.context_counts([t for t in texts if t])
    assert len(taken) == 2 and got["value is 0"] == [500, 0] and got["here"] == [500, 500] and "goes" not in got
    monkeypatch.setattr(pairs, "CHUNK_CHARS", 60)
    model = pairs.contexts(spark.createDataFrame([(t,) for t in texts], "output string"), "output", F.lit(True))
    assert model.seen["is 0 here"] == (500, 500) and model.seen["so it"] == (500, 0)


def test_languages_of_equal_sentences_are_found_once(monkeypatch):
    words = pairs.Dictionary({"und": "de", "der": "de", "the": "en", "of": "en"})
    asked, voted = [], pairs.Dictionary._voted
    monkeypatch.setattr(pairs.Dictionary, "_voted", lambda self, s: asked.append(s) or voted(self, s))
    monkeypatch.setattr(pairs, "KEPT", 2)
    rows = ["und der rest", "the rest of it", "nothing known", "und der rest", "und der rest", "the und"]
    assert [words.language(s) for s in rows] == ["de", "en", None, "de", "de", None]
    assert asked == ["und der rest", "the rest of it", "nothing known", "und der rest", "the und"] and len(words.known) <= 2


def test_prepared_as_by_plain_patterns():
    plain_sentence = language.re.compile(r"[.!?。！？;；:：|()（）\[\]\"“”«»„「」『』>]+|\n(?:[^\S\x1c-\x1f]*\n)+")
    plain_space, rng = language.re.compile(r"[^\S\x1c-\x1f]+"), np.random.default_rng(8)
    for _ in range(2000):
        t = "".join(rng.choice(list("ab é.!?;|(]\"“>\n\n\n \t\r\x0b\x1c\x85\xa0　12,—"), 25))
        want = plain_space.sub(" ", language._UNIT.sub("\x1f", plain_sentence.sub("\x1e", language._NUMBER.sub("0", language.NOT_PROSE.sub(" ", t))))).lower()
        assert language.prepared([t]) == want
