import random

import pytest

from sunloom.llm import mixing

pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, source string, n_tokens string, uses int, h string"


def best_sum(counts, budget):
    reach = 1
    for size, n in counts.items():
        for _ in range(n):
            reach |= reach << size
    return (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1


def test_fit_reaches_what_brute_force_reaches():
    rng = random.Random(1)
    for k in range(300):
        top = rng.choice((12, 300, 3000))
        counts = {rng.randrange(1, top): rng.randrange(1, 6) for _ in range(rng.randrange(1, 9))}
        budget = rng.randrange(0, sum(a * b for a, b in counts.items()) + 3)
        got, exact = mixing.fit_sum(counts, budget, k)
        assert exact and all(0 <= n <= counts[a] for a, n in got.items())
        assert sum(a * n for a, n in got.items()) == best_sum(counts, budget)


def test_fit_of_large_tables():
    def rest(counts, budget, seed=0):
        got, exact = mixing.fit_sum(counts, budget, seed)
        assert all(0 <= n <= counts[a] for a, n in got.items())
        return budget - sum(a * n for a, n in got.items()), exact

    assert mixing.fit_sum({}, 5) == ({}, True) and mixing.fit_sum({3: 1}, 0) == ({}, True) and mixing.fit_sum({3: 2}, 100) == ({3: 2}, True)
    big = {n: 5 for n in range(20, 900)}
    assert all(rest(big, budget) == (0, True) for budget in (12_345, 999_999, 77))
    # Ten equal long documents of which five are wanted, whatever the seed.
    assert all(rest({40_000: 10}, 200_000, seed) == (0, True) for seed in range(50))
    # Only very many of two neighbouring lengths meet the budget.
    assert rest({40_000: 10**6, 40_001: 10**6}, 2 * 10**10 + 17) == (0, True)
    assert rest({n: 10**6 for n in range(100, 20_100)}, 99_999_999_999_999) == (0, True)
    assert rest({3_000_000: 1, 40_000_001: 2, 7: 5}, 43_000_015) == (0, True)
    assert rest({6: 3, 10: 3}, 21) == (1, True)


def test_what_is_not_certain_says_so(monkeypatch):
    monkeypatch.setattr(mixing, "CELLS", 64)
    monkeypatch.setattr(mixing, "SUMS", 4)
    got, exact = mixing.fit_sum({1009: 3, 1013: 3, 1019: 2, 2027: 4}, 7001)
    assert sum(a * n for a, n in got.items()) < 7001 and not exact


def test_a_whole_use_is_given_back_where_one_more_does_not_fit():
    # One whole use of both leaves 3 of 15, which neither fits; without it two uses of 7, or three of 5, which are more, do.
    plans = mixing.plan_mix({"a": {7: 1, 5: 1}, "b": {15: 1}}, [("a", 0.5, 3), ("b", 0.5, 1)])
    a, b = plans
    assert (b.reached, b.whole) == (15, 1) and a.budget == 15
    assert a.exact and a.reached == 15 and (a.whole, a.more) == (0, {5: 3})


def frames(spark, docs, targets):
    d = spark.createDataFrame([(i, t, s, "clash", 9, "h") for i, t, s in docs], DOCS)
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    return d, t


def test_shares_caps_and_report(spark):
    rng = random.Random(2)
    docs = [(i, " word" * rng.randrange(5, 60), "big" if i % 10 else "small") for i in range(600)]
    docs += [(9_000, None, "big"), (9_001, "", "small"), (9_002, " word" * 50, None), (9_003, " word" * 50, "unlisted")]
    d, t = frames(spark, docs, [("big", 0.6, 1), ("small", 0.3, 3), ("absent", 0.1, 5), ("off", 0.0, 5), (None, 0.2, 1)])
    m, plans = mixing.mix_with_plans(d, t)
    m = m.cache()
    rows = m.collect()
    assert {r.source for r in rows} == {"big", "small"}
    assert max(r.uses for r in rows if r.source == "big") == 1 and max(r.uses for r in rows if r.source == "small") == 3
    rep = {r.source: r for r in mixing.report(m, t, plans).collect()}
    assert rep["absent"].actual_share == 0 and rep["absent"].tokens == 0
    assert rep["big"].actual_share / rep["small"].actual_share == pytest.approx(2, abs=0.01)
    assert sum(r.n_tokens * r.uses for r in rows) == rep["big"].tokens + rep["small"].tokens
    assert sorted((r.doc_id, r.uses) for r in rows) == sorted((r.doc_id, r.uses) for r in mixing.mix(d.repartition(7), t).collect())


def test_whole_uses_and_long_documents(spark):
    docs = [(i, " word" * (20 + i % 50), "a") for i in range(300)] + [(1000 + i, " word" * 30, "b") for i in range(20)]
    d, t = frames(spark, docs, [("a", 0.5, 1), ("b", 0.5, 40)])
    m, plans = mixing.mix_with_plans(d, t)
    rep = {r.source: r for r in mixing.report(m, t, plans).collect()}
    assert rep["a"].documents == 300 and rep["a"].most_uses == 1
    assert rep["b"].actual_share == pytest.approx(0.5, abs=0.02)
    assert all(r.exact and r.shortfall == r.budget - r.tokens < 30 for r in rep.values())


def test_few_long_documents_meet_the_budget(spark):
    # Half of a's tokens are wanted: the one that reaches it is 300 with the two short ones, or 200 and 100 of them.
    docs = [(i, " word" * n, "a") for i, n in enumerate((300, 200, 90, 10))] + [(9, " word" * 300, "b")]
    d, t = frames(spark, docs, [("a", 0.5, 1), ("b", 0.5, 1)])
    for seed in range(4):
        m = mixing.mix(d, t, seed).collect()
        assert sum(r.n_tokens * r.uses for r in m if r.source == "a") == sum(r.n_tokens for r in m if r.source == "b")
    long = [(i, " word" * 40_000, "a") for i in range(10)] + [(100 + i, " word" * 2_000, "b") for i in range(100)]
    d, t = frames(spark, long, [("a", 0.5, 1), ("b", 0.5, 1)])
    for seed in range(3):
        m = mixing.mix(d, t, seed).collect()
        assert sum(r.n_tokens * r.uses for r in m if r.source == "a") == sum(r.n_tokens * r.uses for r in m if r.source == "b") == 200_000


def test_further_uses_of_a_length_are_spread_over_its_documents(spark):
    docs = [(i, " word" * 7, "a") for i in range(3)] + [(9, " word" * 15, "a"), (10, " word" * 85, "b")]
    d, t = frames(spark, docs, [("a", 0.5, 4), ("b", 0.5, 1)])
    m, plans = mixing.mix_with_plans(d, t)
    uses = sorted(r.uses for r in m.filter("source = 'a' AND n_tokens = 7").collect())
    assert max(r.uses for r in m.collect()) <= 4 and uses[-1] - uses[0] <= 1
    assert {r.source: r.shortfall for r in mixing.report(m, t, plans).collect()} == {"a": 0, "b": 0}


def test_repeated_rows_ties_and_empty_tables(spark):
    d, t = frames(spark, [(1, " same", "a")] * 6 + [(2, " other", "b")] * 2, [("a", 0.5, 1), ("b", 0.5, 2), ("b", 0.0, 9)])
    rows = mixing.mix(d, t).collect()
    assert sum(r.uses for r in rows if r.source == "a") == sum(r.uses for r in rows if r.source == "b") == 4
    assert mixing.mix(d.limit(0), t).count() == 0
    assert mixing.mix(d, t.limit(0)).count() == 0
