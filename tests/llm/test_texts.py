"""Token counts, packing, mixing and shared spans against brute force."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tropelake.llm")
from tropelake.llm.mix import Mixture, plan
from tropelake.llm.pack import Bins, pack, pack_report
from tropelake.llm.spans import Hasher, chain, edit_distance, fuzzy_passages, minimizer_runs, shared_lengths, shared_spans, sliding_min
from tropelake.llm.tokens import token_counts

TEXTS = ["It's 3.5% – naïve!", None, "", "  \t", "¿Qué? x_1 ١٢", "a" * 100_000 + " !!"]


def test_token_counts_are_those_of_the_pattern(spark):
    df = spark.createDataFrame([(k, t, "s") for k, t in enumerate(TEXTS)], "doc_id INT, text STRING, n_tokens STRING")
    got = {r[0]: r[1] for r in token_counts(df, "doc_id", "text").select("doc_id", F.col("n_tokens")).collect()}
    assert got == {k: len(re.findall(r"\w+|[^\w\s]+", t or "")) for k, t in enumerate(TEXTS)}


def test_token_counts_of_a_public_vocabulary(spark):
    P = pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([(1, "the cat sat on the mat"), (2, None)], "d INT, t STRING")
    got = {r["d"]: r["n_tokens"] for r in token_counts(df, "d", "t", tokenizer=str(P.path("byte_bpe_50k.json"))).collect()}
    assert got[1] == 6 and got[2] == 0


def packed(spark, sizes, **more):
    df = spark.createDataFrame([(k, n, "x") for k, n in enumerate(sizes)], "doc INT, n INT, bin STRING")
    return pack(df, "doc", "n", **more).collect()


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_keeps_every_limit_and_every_token(spark, rule):
    rng = random.Random(1)
    sizes = [rng.randrange(1, 130) for _ in range(900)] + [100, 101, 250, 1000, 0, -3, None]
    rows = packed(spark, sizes, capacity=100, max_items=6, rule=rule, shard_items=300)
    bins, docs = {}, {}
    for r in rows:
        bins.setdefault(r["bin"], []).append(r["n_tokens"])
        docs.setdefault(r["doc"], []).append((r["piece_no"], r["start_token"], r["n_tokens"]))
    assert all(sum(b) <= 100 and len(b) <= 6 for b in bins.values())
    for k, n in enumerate(sizes):
        if not n or n < 1:
            assert k not in docs
            continue
        pieces = sorted(docs[k])
        assert [p[0] for p in pieces] == list(range(1, -(-n // 100) + 1)) and sum(p[2] for p in pieces) == n
        assert all(p[1] == sum(q[2] for q in pieces[:i]) for i, p in enumerate(pieces))
    assert sum(map(sum, bins.values())) / (100 * len(bins)) > 0.95


def test_packing_under_attention_cost_and_empty(spark):
    rows = packed(spark, [50] * 10 + [100, 71, 30, 30], capacity=100, attention=0.5)
    load = {}
    for r in rows:
        load[r["bin"]] = load.get(r["bin"], 0) + r["n_tokens"] ** 2
    assert max(load.values()) <= 5000 and max(r["n_tokens"] for r in rows) == 70 and sum(r["n_tokens"] for r in rows) == 731
    assert packed(spark, []) == []
    df = spark.createDataFrame([(1, 512)], "doc INT, n INT")
    assert tuple(pack_report(pack(df, "doc", "n"), 512).first()) == (1, 1, 512, 512, 100.0)
    with pytest.raises(ValueError):
        packed(spark, [1], weights=(1.0, -1.0, 1.0))


def one_by_one(capacity, items, rule, weights):
    """Every piece by itself into the best of all open bins: residuals of the bins."""
    bins = []
    for item in items:
        room = [b for b in bins if (b >= item).all()]
        if room:
            if rule == "norm":
                bin_ = min(room, key=lambda b: (((b - item) / capacity) ** 2 * weights).sum())
            else:
                bin_ = max(room, key=lambda b: (b * item / capacity**2 * weights).sum() / ((b / capacity) ** 2 * weights).sum())
        else:
            bin_ = capacity.astype(float).copy()
            bins.append(bin_)
        bin_ -= item
    return bins


@pytest.mark.parametrize("rule, weights", [("norm", (1.0, 0.0)), ("norm", (1.0, 0.3)), ("dot", (1.0, 0.5))])
def test_classes_of_bins_do_what_single_bins_do(rule, weights):
    rng = np.random.default_rng(6)
    capacity, weights = np.array([100, 7]), np.array(weights)
    sizes = np.sort(rng.integers(1, 60, 700))[::-1]
    bins = Bins(capacity, rule, weights)
    names = np.concatenate([bins.put(np.array([n, 1]), int((sizes == n).sum())) for n in dict.fromkeys(sizes.tolist())])
    load = np.bincount(names, weights=sizes)
    assert load.max() <= 100 and np.bincount(names).max() <= 7 and load.sum() == sizes.sum()
    single = one_by_one(capacity, [np.array([n, 1.0]) for n in sizes], rule, weights)
    assert abs(len(load) - len(single)) <= max(1, 0.02 * len(single))


def test_best_fit_fills_the_tightest_bin():
    bins = Bins(np.array([10, 5]), "norm", np.ones(2))
    (a,), (b,) = bins.put(np.array([7, 1]), 1), bins.put(np.array([5, 1]), 1)
    assert bins.put(np.array([3, 1]), 1) == [a] and bins.put(np.array([5, 1]), 1) == [b]
    assert bins.put(np.array([2, 1]), 11).tolist() == [2] * 5 + [3] * 5 + [4]


def cheapest(n, edges, source, sink):
    """Amount and cost of the cheapest largest flow over edges (from, to, capacity, cost), by successive shortest paths."""
    arcs = [[b, c, w] for a, b, c, w in edges for b, c, w in ((b, c, w), (a, 0, -w))]
    out = [[] for _ in range(n)]
    for i, (a, b, _, _) in enumerate(edges):
        out[a].append(2 * i)
        out[b].append(2 * i + 1)
    amount = cost = 0
    while True:
        far, via = {source: 0}, {}
        for _ in range(n):
            for u in list(far):
                for e in out[u]:
                    v, c, w = arcs[e]
                    if c > 0 and far[u] + w < far.get(v, 1 << 60):
                        far[v], via[v] = far[u] + w, e
        if sink not in far:
            return amount, cost
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = arcs[via[v] ^ 1][0]
        push = min(arcs[e][1] for e in path)
        for e in path:
            arcs[e][1] -= push
            arcs[e ^ 1][1] += push
        amount, cost = amount + push, cost + push * far[sink]


def test_plan_is_the_cheapest_largest_flow():
    rng = random.Random(3)
    for _ in range(60):
        names = "abcd"[: rng.randrange(1, 5)]
        targets = [(s, rng.randrange(0, 60), rng.randrange(0, 4)) for s in names]
        patterns = {tuple(sorted(rng.sample(names, rng.randrange(1, len(names) + 1)))): rng.randrange(1, 30) for _ in range(rng.randrange(1, 6))}
        total = sum(patterns.values())
        got = plan(patterns, targets, total)
        used, given = {}, {}
        for p, s, f in got:
            assert 0 < f <= 100 * patterns[p] * dict((t, n) for t, _, n in targets)[s] and s in p
            used[p], given[s] = used.get(p, 0) + f, given.get(s, 0) + f
        cost = sum(sum(max(0, min(100 * patterns[p], u - 100 * patterns[p] * k)) * (k + 1) for k in range(20)) for p, u in used.items())
        keys = list(patterns)
        edges = []
        for k, p in enumerate(keys):
            edges += [(0, 2 + k, 100 * patterns[p], turn) for turn in range(1, 14)]
            edges += [(2 + k, 2 + len(keys) + i, 100 * patterns[p] * n, 0) for i, (s, _, n) in enumerate(targets) if s in p]
        edges += [(2 + len(keys) + i, 1, w * total, 0) for i, (s, w, _) in enumerate(targets)]
        assert (sum(used.values()), cost) == cheapest(2 + len(keys) + len(targets), edges, 0, 1)
        assert all(given.get(s, 0) <= w * total for s, w, _ in targets)


def test_plan_shares_overlapping_patterns_and_takes_many():
    got = plan({("a",): 100, ("a", "b"): 100}, [("a", 50, 1), ("b", 50, 1)], 200)
    by = {}
    for _, s, f in got:
        by[s] = by.get(s, 0) + f
    assert by == {"a": 10_000, "b": 10_000}
    rng = random.Random(1)
    names = [f"s{k}" for k in range(14)]
    patterns = {}
    while len(patterns) < 16_000:
        patterns[tuple(sorted(rng.sample(names, rng.randrange(1, 14))))] = rng.randrange(1, 1000)
    targets = [(s, 100 / 14, 2) for s in names]
    began = time.perf_counter()
    flow = plan(patterns, targets, sum(patterns.values()))
    assert time.perf_counter() - began < 30 and abs(sum(f for _, _, f in flow) - 100 * sum(patterns.values())) < 100


def test_overlapping_sources_repeat_documents_evenly(spark):
    """Two sources take 1.5 passes each of the same documents: every document comes three times."""
    docs = [(k, 10, ["a", "b"]) for k in range(200)] + [(1000 + k, 10, ["c"]) for k in range(400)]
    m = Mixture(spark.createDataFrame(docs, "d INT, n_tokens INT, sources ARRAY<STRING>"), "d", [("a", 50, 2), ("b", 50, 2)])
    rows = m.selection().collect()
    uses = {}
    for r in rows:
        uses[r["d"]] = uses.get(r["d"], 0) + r["n_copies"]
    assert m.total == 2000 and set(uses) == set(range(200)) and set(uses.values()) == {1}
    both = Mixture(spark.createDataFrame(docs[:200], "d INT, n_tokens INT, sources ARRAY<STRING>"), "d", [("a", 150, 2), ("b", 150, 2)]).selection().collect()
    uses = {}
    for r in both:
        uses[r["d"]] = uses.get(r["d"], 0) + r["n_copies"]
    assert set(uses.values()) == {3} and len(uses) == 200 and max(r["n_copies"] for r in both) == 2


DOCS = [(k, 10 + k % 7, "big" if k % 3 else "small") for k in range(600)]


def mixture(spark, docs, targets, **more):
    df = spark.createDataFrame(docs, "d INT, n_tokens INT, s STRING").select("d", "n_tokens", F.array("s").alias("sources"))
    return Mixture(df, "d", targets, **more)


def test_mixture_passes_follow_the_weights(spark):
    total = {s: sum(n for _, n, x in DOCS if x == s) for s in ("big", "small")}
    T = sum(total.values())
    m = mixture(spark, DOCS, [("big", 20, 3), ("small", 80, 2), ("none", 0, 4)])
    shares = {s: (n, r) for s, n, r, _ in m.shares()}
    assert shares["none"] == (0, 1) and shares["big"] == (1, 1)
    assert shares["small"] == (2, int(2 * total["small"] >= 0.8 * T))
    chosen = m.selection().collect()
    got = {s: sum(r["n_tokens"] * r["n_copies"] for r in chosen if r["source"] == s) for s in total}
    assert 0.2 * T <= got["big"] < 0.2 * T + 17 and got["small"] == 2 * total["small"]
    assert max(r["n_copies"] for r in chosen) == 2 and len({(r["source"], r["d"]) for r in chosen}) == len(chosen)
    again = mixture(spark, DOCS, [("big", 20, 3), ("small", 80, 2), ("none", 0, 4)]).selection().collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, chosen))


def test_mixture_takes_empty_and_useless_rows(spark):
    m = mixture(spark, [(None, 5, "a"), (1, 0, "a"), (2, None, "a"), (3, 5, None), (4, 5, "other")], [("a", 50, 2), ("b", 50, 2)])
    assert m.shares() == [("a", 0, 1, 0), ("b", 0, 1, 0)] and m.selection().count() == 0
    with pytest.raises(ValueError):
        mixture(spark, DOCS, [("a", 50, 2), ("a", 50, 2)])


def brute_shared(docs, span):
    where = {}
    for d, t in docs:
        for i in range(len(t or "") - span + 1):
            where.setdefault(t[i : i + span], set()).add(d)
    out = {}
    for d, t in docs:
        hit = set()
        for i in range(len(t or "") - span + 1):
            if len(where[t[i : i + span]]) > 1:
                hit |= set(range(i, i + span))
        if hit:
            out[d] = len(hit)
    return out


def test_shared_lengths_match_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdé😀") for _ in range(rng.randrange(2, 7)))
    fresh = lambda n: " ".join(word() for _ in range(n))
    common = [fresh(n) for n in (8, 12, 30, 60)]
    docs = []
    for d in range(120):
        parts = [fresh(rng.randrange(0, 12))]
        for _ in range(rng.randrange(0, 4)):
            c = rng.choice(common)
            a = rng.randrange(0, len(c) // 2)
            parts += [c[a : rng.randrange(a + 5, len(c) + 1)], fresh(rng.randrange(0, 5))]
        docs.append((d, " ".join(parts)))
    docs += [(500, docs[7][1]), (501, docs[7][1]), (502, common[3] * 2), (503, common[3] + "!" + common[3]), (504, None), (505, ""), (506, "short"), (507, "xy" * 200), (508, "xy" * 90)]
    df = spark.createDataFrame([(d, t, "c") for d, t in docs], "doc_id INT, text STRING, doc STRING")
    got = {r["doc_id"]: r["shared_chars"] for r in shared_lengths(shared_spans(df, "doc_id", "text", 40, 24), "doc_id").collect()}
    assert got == brute_shared(docs, 40)


def test_spans_are_verbatim_and_passages_are_aligned(spark):
    a, b = "the long passage that both of them carry onwards ", "and here it goes on after a small change in it "
    docs = [(1, "first start " + a + "XX " + b), (2, "other one " + a + "YYY " + b + "end"), (3, "nothing in common here at all, not a single bit of it")]
    df = spark.createDataFrame(docs, "doc_id INT, text STRING")
    spans = shared_spans(df, "doc_id", "text", 30, 20)
    text = dict(docs)
    rows = spans.collect()
    assert {r["doc"] for r in rows} == {1, 2} and all(text[r["doc"]][r["x"] : r["x"] + r["size"]] == text[r["other"]][r["y"] : r["y"] + r["size"]] for r in rows)
    passages = {(r["doc"], r["other"]): r for r in fuzzy_passages(df, "doc_id", "text", 30, 20).collect()}
    p = passages[1, 2]
    assert p["start"] == 11 and p["end"] == len(text[1]) and p["edits"] == 3 and 0.96 < p["identity"] < 1


def test_no_texts_no_spans(spark):
    assert shared_lengths(shared_spans(spark.createDataFrame([], "doc_id INT, text STRING"), "doc_id", "text"), "doc_id").count() == 0
    one = spark.createDataFrame([(1, "z" * 1000)], "doc_id INT, text STRING")
    assert shared_lengths(shared_spans(one, "doc_id", "text"), "doc_id").count() == 0  # repeats within one record are not shared


def test_seeds_cover_every_window():
    rng = random.Random(9)
    text = "".join(rng.choice("ab cdé😀") for _ in range(800)) + "q" * 200
    texts = [text, "x" * 50, text[300:500], text]
    hasher = Hasher()
    which, seed, run, first, last = minimizer_runs(hasher, texts, 50, 20)
    for k, t in enumerate(texts):
        f, e = first[which == k], last[which == k]
        assert f[0] == 0 and e[-1] == len(t) - 50 and (f[1:] == e[:-1] + 1).all()
    same = lambda k: list(zip(seed[which == k], run[which == k], first[which == k], last[which == k]))
    assert same(0) == same(3) and set(seed[which == 2]) <= set(seed[which == 0])
    hasher.read(text)
    known = set(hasher.all(20).tolist())
    assert set(seed[which == 0].tolist()) <= known and len(known) > 700
    x = np.array([rng.randrange(99) for _ in range(57)], np.uint64)
    assert all(sliding_min(x, w).tolist() == [min(x[i : i + w]) for i in range(58 - w)] for w in (1, 2, 7, 8, 9))


def test_long_texts_are_hashed_in_pieces(spark):
    rng = random.Random(12)
    fresh = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    common = fresh(70_000)
    docs = [(1, fresh(30_000) + "1" + common + "2" + fresh(9)), (2, fresh(66_000) + "3" + common), (3, fresh(100) + "4" + common[65_000:65_400] + "5" + fresh(50))]
    got = {r["doc_id"]: r["shared_chars"] for r in shared_lengths(shared_spans(spark.createDataFrame(docs, "doc_id INT, text STRING"), "doc_id", "text"), "doc_id").collect()}
    assert got == {1: 70_000, 2: 70_000, 3: 400}


def test_edit_distance_is_that_of_the_table():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc😀") for _ in range(rng.randrange(0, 12))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            left, row = row, [i + 1]
            for j, y in enumerate(b):
                row.append(min(left[j] + (x != y), left[j + 1] + 1, row[j] + 1))
        assert edit_distance(a, b) == row[-1], (a, b)


def test_planted_passages_come_out_though_each_part_has_an_older_record(spark):
    """Records 5 and 6 share two spans with a gap between; record 1 has the first span, record 2 the second."""
    rng = random.Random(8)
    fresh = lambda n: "".join(rng.choice("abcdefghijk ") for _ in range(n))
    one, two = "1" + fresh(88) + "2", "3" + fresh(118) + "4"
    docs = [(1, fresh(50) + one + fresh(80)), (2, fresh(10) + two + fresh(30)), (5, fresh(60) + one + "XX" + two + fresh(40)), (6, fresh(20) + one + "YYYY" + two), (7, fresh(400)), (8, None)]
    rows = {(r["doc"], r["other"]): r for r in fuzzy_passages(spark.createDataFrame(docs, "doc_id INT, text STRING"), "doc_id", "text", 40, 24, max_gap=60).collect()}
    for pair, start, other in (((5, 6), 60, 20), ((6, 5), 20, 60)):
        r = rows[pair]
        assert (r["start"], r["other_start"], r["exact_chars"], r["edits"]) == (start, other, 210, 4)
    assert rows[1, 6]["exact_chars"] >= 90 and rows[2, 6]["exact_chars"] >= 120 and all(7 not in p for p in rows)


def test_chain_is_the_best_collinear_one():
    rng = np.random.default_rng(3)
    for _ in range(40):
        n = 9
        x, y, size = np.sort(rng.integers(0, 120, n)), rng.integers(0, 120, n), rng.integers(4, 12, n)
        best = np.zeros(n)
        for i in range(n):
            best[i] = size[i]
            for j in range(i):
                gx, gy = x[i] - x[j] - size[j], y[i] - y[j] - size[j]
                if gx >= 0 and gy >= 0:
                    best[i] = max(best[i], best[j] + size[i] - 0.1 * (gx + gy))
        paths = chain(x, y, size, 0.1, 10_000)
        value = lambda p: sum(size[k] for k in p) - 0.1 * sum(x[b] - x[a] - size[a] + y[b] - y[a] - size[a] for a, b in zip(p, p[1:]))
        assert abs(value(paths[0]) - best.max()) < 1e-9 and sorted(k for p in paths for k in p) == list(range(n))


def test_chain_takes_the_best_predecessor_within_the_gap():
    x, size = np.array([0, 2450 - 160, 2470]), np.array([1890, 160, 300])  # the first ends 400 before the second, 580 before the third
    assert chain(x, x, size, 0.5, 399) == [[0], [1, 2]]
    x, size = np.array([0, 2450, 2630]), np.array([2000, 160, 300])
    assert sorted(map(tuple, chain(x, x, size, 0.5, 400))) == [(0,), (1, 2)]
