"""Jobs that SQL doesn't state, as queries on small tables against brute force."""

import hashlib
import math
import random
import re
import unicodedata
import zlib

import numpy as np

from curata.functions import udfs as U
from curata.plans import catalog


def rows(spark, tmp_path, name, tables):
    """The query's rows over tables given as name: (rows, schema)."""
    for k, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{k}.parquet")
    return catalog.QUERIES[name](spark, str(tmp_path)).collect()


def test_normal_prompts(spark, tmp_path):
    texts = ["Ｓｏｌｖｅ　ｘ² ", "solve x2", "Find ﬁve ①\x1f\x85 End", "find five 1 end", "证明 Ａ１", "", None]
    got = rows(spark, tmp_path, "normal_prompts", {"audit_pool": (list(enumerate(texts)), "pool_idx bigint, prompt string")})
    for r in got:
        t = texts[r.pool_idx]
        norm = None if t is None else re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t).lower()).strip()
        assert r.norm == norm and r.n_tokens == len(re.findall("[a-z0-9]+|[一-鿿]", norm or ""))
        assert r.hash16 == (None if t is None else hashlib.sha1(norm.encode()).hexdigest()[:16])
    by = {r.pool_idx: r.hash16 for r in got}
    assert by[0] == by[1] and by[2] == by[3]


def test_audit_flags(spark, tmp_path):
    """Loops in one long line and in short lines count; short tails, varied texts and 24 equal lines don't."""
    varied = "".join(chr(97 + int(c, 16)) for k in range(60) for c in hashlib.sha1(str(k).encode()).hexdigest())
    line = "this line has more than thirty characters"
    spread = "\n".join(f"{line}\t\n{varied[k * 60 : k * 60 + 100]}" for k in range(26))
    texts = ["<think>" + "go on " * 500 + "</think>", "<think>" + "again\n" * 500, "<think>" + "go on " * 300, "<think>" + varied, "<think>" + f"{line}\n" * 24, "<think>" + spread, "", None]
    table = [(k, "p", t) for k, t in enumerate(texts)]
    got = {r.pool_idx: r for r in rows(spark, tmp_path, "audit_flags", {"audit_pool": (table, "pool_idx bigint, prompt string, output string")})}
    assert [got[k].flag_repetition for k in range(8)] == [True, True, False, False, False, True, False, False]
    for k, t in enumerate(texts[:-1]):
        b = t.encode()[-4000:]
        lines = [x.strip() for x in t.split("\n") if len(x.strip()) >= 30]
        ratio, most = len(zlib.compress(b)) / max(1, len(b)), max(map(lines.count, lines), default=0)
        assert got[k].tail_zlib_ratio == round(ratio, 4) and got[k].max_line_repeat == most
        assert got[k].flag_repetition == (len(b) >= 2000 and ratio < 0.10 or most >= 25)
        assert got[k].flagged == (got[k].flag_repetition or got[k].flag_malformed)
    assert got[7].tail_zlib_ratio is None and got[7].flagged


def agreement(answers):
    """(agreement, in_majority) of answers in the order of their keys, pair by pair."""
    parent = list(range(len(answers)))

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for i, a in enumerate(answers):
        for j in range(i + 1, len(answers)):
            b = answers[j]
            if find(i) != find(j) and a and b and (U.canonical(a) == U.canonical(b) or U.same_answer(a, b)):
                parent[find(i)] = find(j)
    roots = [find(i) for i in range(len(answers))]
    return [(round(max(map(roots.count, roots)) / len(roots), 6), bool(a) and 2 * roots.count(r) > len(roots)) for a, r in zip(answers, roots)]


def test_prompt_agreement(spark, tmp_path):
    """Other spellings, chains of near numbers, one-way equality, empty and NULL answers, and a hash made from the prompt."""
    groups = [
        ["2/4", "20/40", "0.5", "3"], ["", None, ""], ["7", "8"], ["7"], ["\\frac{1}{2}", "", "0.50", None, "1/2"],
        ["0", "0.00008", "0.00016", "5"], ["ab", "B", "C"], ["B", "ab", "C"], ["$", "%", "1"], ["(1, 2)", "(1,2)", "(2,1)"], ["50\\%", "0.5"],
    ]
    table = [(100 * g + k, f"Prompt　{g}", None if k % 2 else hashlib.sha1(f"prompt {g}".encode()).hexdigest()[:16], a) for g, answers in enumerate(groups) for k, a in enumerate(answers)]
    got = rows(spark, tmp_path, "prompt_agreement", {"audit_pool": (table, "pool_idx bigint, prompt string, prompt_hash string, r1_answer string")})
    want = {100 * g + k: x for g, answers in enumerate(groups) if len(answers) > 1 for k, x in enumerate(agreement(answers))}
    assert {r.pool_idx: (r.agreement, r.in_majority) for r in got} == want and len(got) == len(want)
    assert want[0] == (0.75, True) and want[100] == (0.333333, False) and want[500] == (0.75, True) and want[600] != want[700]


def test_paired_bootstrap(spark, tmp_path):
    """Every supplier both runs have in a nation is a question, in each of 2000 rounds."""
    rng = random.Random(5)
    nations, runs = ["FRANCE", "PERU"], ["BUILDING", "MACHINERY", "AUTOMOBILE"]
    customers = [(k, k % 2, runs[k % 3]) for k in range(12)]
    orders = [(k, rng.randrange(12)) for k in range(200)]
    lines = [(o, 500 * rng.randrange(7) + n, rng.choice("RAN")) for o, _ in orders for n in range(2)]
    tables = {
        "nation": (list(enumerate(nations)), "n_nationkey bigint, n_name string"), "customer": (customers, "c_custkey bigint, c_nationkey bigint, c_mktsegment string"),
        "orders": (orders, "o_orderkey bigint, o_custkey bigint"), "lineitem": (lines, "l_orderkey bigint, l_suppkey bigint, l_returnflag string"),
    }
    (got,) = rows(spark, tmp_path, "paired_bootstrap", tables)
    cells = {}
    for o, supplier, flag in lines:
        _, nation, run = customers[orders[o][1]]
        cells.setdefault((nations[nation], supplier), {}).setdefault(run, []).append(flag == "R")
    gaps = {b: [np.mean(x["BUILDING"]) - np.mean(x["MACHINERY"]) for (n, _), x in sorted(cells.items()) if n == b and {"BUILDING", "MACHINERY"} <= set(x)] for b in nations}
    assert all(len(g) > 7 for g in gaps.values())  # more than the suppliers' remainders by 500
    prime, means = 2**31 - 1, []
    named = {b: [(s, np.mean(x["BUILDING"]) - np.mean(x["MACHINERY"])) for (n, s), x in cells.items() if n == b and {"BUILDING", "MACHINERY"} <= set(x)] for b in nations}

    def weight(r, b, s):
        h = hashlib.md5(f"7|{b}|{s}".encode()).hexdigest()
        v, p, k, total = (int(h[:8], 16) % prime + r * (int(h[8:16], 16) % prime)) % prime, math.exp(-1), 0, 0.0
        while k < 9:
            total += p / math.factorial(k)
            if v < int(total * prime):
                break
            k += 1
        return k

    for r in range(2000):
        by = [[(weight(r, b, s), g) for s, g in named[b]] for b in nations]
        means.append(np.mean([sum(w * g for w, g in rows) / n for rows in by if (n := sum(w for w, _ in rows))]))
    assert np.allclose([got.lo, got.hi, got["mean"]], [*np.percentile(means, [2.5, 97.5]), np.mean(means)], atol=2e-6)


def test_document_blocks(spark, tmp_path):
    """Several batches, a text of many blocks, a batch too short for one, characters outside the basic plane."""
    table = [(k, None if k % 11 == 5 else "aé证😀"[: k % 5] * (k % 40)) for k in (*range(0, 3000, 7), 5000)] + [(1501, "long 文😀 " * 3000)]
    got = {(r.batch_id, r.block_id): r.ids for r in rows(spark, tmp_path, "document_blocks", {"documents": (table, "doc_id bigint, text string")})}
    want = {}
    for b in range(6):
        flat = [c for k, t in sorted(table) if k // 1000 == b and t is not None for c in [*map(ord, t), 1]]
        want |= {(b, i): flat[2048 * i : 2048 * (i + 1)] for i in range(len(flat) // 2048)}
    assert got == want and len({b for b, _ in want}) == 3


def test_packed_pairs(spark, tmp_path):
    """Every pair is in one pack, cut to the budget, with labels on the output only; long pairs aren't dropped."""
    table = [(k, "p😀" * (k % 90), "答o" * (37 * k % 700)) for k in range(900, 1100)] + [(1200, "q" * 5000, "r" * 3000), (1201, "q", "r" * 9000), (1202, None, "x"), (1203, "x", None)]
    got = rows(spark, tmp_path, "packed_pairs", {"audit_pool": (table, "pool_idx bigint, prompt string, output string")})
    texts, seen = {k: (p, o) for k, p, o in table}, []
    for r in got:
        ids, labels, places, segments = [], [], [], []
        for j, k in enumerate(r["keys"]):
            assert k // 1000 == r.batch_id
            p, o = texts[k]
            t = 4096 if 2 * len(o) < 4096 else 4096 - len(p) if 2 * len(p) < 4096 else int(4096 * len(o) / (len(p) + len(o)))
            o = o[:t]
            p = p[: max(4096 - len(o), 0)]
            ids += map(ord, p + o)
            labels += [-100] * len(p) + [*map(ord, o)]
            places += range(len(p + o))
            segments += [j + 1] * len(p + o)
            seen.append(k)
        pad = 4096 - len(ids)
        assert pad >= 0 and r.tokens == len(ids) and r.n_sequences == len(r["keys"])
        assert (r.input_ids, r.labels, r.position_ids, r.segment_ids) == (ids + [0] * pad, labels + [-100] * pad, places + [0] * pad, segments + [0] * pad)
    assert sorted(seen) == [k for k, p, o in table if p is not None and o is not None]
