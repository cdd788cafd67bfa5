"""The seating of the language model against exact enumeration."""

import itertools
import zlib
from collections import Counter

import numpy as np
import pytest


def _stirling(c, d):
    """Generalised Stirling numbers S(c, 1 .. c) by their recurrence."""
    row = [1.0]
    for n in range(1, c):
        row = [(n - d * (k + 1)) * (row[k] if k < len(row) else 0.0) + (row[k - 1] if k else 0.0) for k in range(n + 1)]
    return row


@pytest.mark.parametrize(("count", "rate"), [(2, 0.3), (7, 0.05), (7, 2.0), (40, 9.0)])
def test_table_numbers_are_drawn_from_their_distribution(count, rate):
    from tessera.llm.pitman_yor import sample_tables, stirling_rows

    d, n = 0.4, 40_000
    weight = np.array(_stirling(count, d)) * rate ** np.arange(1, count + 1)
    drawn = sample_tables(np.full(n, count), np.full(n, np.log(rate)), *stirling_rows(d, 64, 64), np.random.default_rng(3), discount=d)
    share = np.bincount(drawn, minlength=count + 1)[1:] / n
    assert np.abs(share - weight / weight.sum()).max() < 0.015


@pytest.mark.parametrize("d", [0.2, 0.43, 0.8])
def test_large_counts_follow_the_exact_rows(d):
    from tessera.llm.pitman_yor import large_seating, sample_tables, stirling_rows

    most = 4096
    grid, rows = stirling_rows(d, most, most)
    t = np.arange(1, most + 1)
    for rate in (0.5, 5.0, 60.0, 400.0):
        logs = rows[-1] + np.log(rate) * t
        p = np.exp(logs - logs.max())
        p /= p.sum()
        mean = p @ t
        spread = np.sqrt(p @ (t - mean) ** 2)
        near, variance = large_seating(np.array([float(grid[-1])]), np.array([np.log(rate)]), d)
        if mean > 50:
            assert near[0] == pytest.approx(mean, rel=0.02, abs=1) and np.sqrt(variance[0]) == pytest.approx(spread, rel=0.05)
        # with a table that ends below, the same count is drawn from the limit law: mean and spread agree
        few = sample_tables(np.full(20_000, int(grid[-1])), np.full(20_000, np.log(rate)), grid[grid <= 512], rows[: (grid <= 512).sum(), :512], np.random.default_rng(1), discount=d)
        assert few.mean() == pytest.approx(mean, rel=0.03, abs=0.6) and few.std() == pytest.approx(spread, rel=0.1, abs=0.3)


def _exact(pairs, words, d, theta=1.0, d0=0.5, theta0=1.0):
    """Averaged predictive probabilities over all table numbers of all restaurants, weighted by their joint probability.

    pairs: (context, word) -> customers. The base is uniform over the words and one event more.
    """
    base = 1 / (len(words) + 1)
    keys, total, mass = sorted(pairs), Counter(), 0.0
    contexts = sorted({u for u, _ in keys})
    for (u, _), c in pairs.items():
        total[u] += c
    seen, missing = Counter(), Counter()
    front = lambda t, a, b: np.prod([a + b * k for k in range(1, t)])
    for tables in itertools.product(*[range(1, pairs[k] + 1) for k in keys]):
        of = Counter()
        customers = Counter()
        lower = 1.0
        for (u, w), t in zip(keys, tables, strict=True):
            of[u] += t
            customers[w] += t
            lower *= _stirling(pairs[u, w], d)[t - 1]
        for u in contexts:
            lower *= front(of[u], theta, d)
        names = sorted(customers)
        for upper in itertools.product(*[range(1, customers[w] + 1) for w in names]):
            weight = lower * front(sum(upper), theta0, d0) / np.prod([theta0 + k for k in range(1, sum(customers.values()))])
            for w, t in zip(names, upper, strict=True):
                weight *= _stirling(customers[w], d0)[t - 1] * base**t
            mass += weight
            n, t0 = sum(customers.values()), dict(zip(names, upper, strict=True))
            parent = {w: (customers[w] - d0 * t0.get(w, 0) + (theta0 + d0 * sum(upper)) * base) / (theta0 + n) for w in [*words, None]}
            for u in contexts:
                back = (theta + d * of[u]) / (theta + total[u])
                for w in [*words, None]:
                    own = pairs.get((u, w), 0)
                    t = tables[keys.index((u, w))] if own else 0
                    seen[u, w] += weight * ((own - d * t) / (theta + total[u]) + back * parent[w])
            missing.update({w: weight * p for w, p in parent.items()})
    return {k: v / mass for k, v in seen.items()}, {k: v / mass for k, v in missing.items()}


def test_scores_are_near_the_exact_predictive_probabilities(spark):
    from tessera.llm.pitman_yor import discount_of, score_texts

    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    learnt, kept = [i for i in range(90) if not held(i)], [i for i in range(90) if held(i)]
    texts = ["a b", "a b", "a c", "b"]
    tests = ["a b", "a c", "b a", "c b", "a z", "z", "b b"]
    pairs = Counter()
    for t in texts:
        words = [*t.split(), "</s>"]
        pairs.update(zip(["</s>", *words], words, strict=False))
    d = discount_of(np.array([1, 2]), np.array([sum(c == 1 for c in pairs.values()), sum(c == 2 for c in pairs.values())]))
    known = sorted({w for _, w in pairs})
    exact, parent = _exact(dict(pairs), known, d)
    rows = [*zip(learnt, texts, strict=False), *zip(kept, tests, strict=False)]
    found = {r.doc_id: r.score for r in score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in zip(kept, tests, strict=False):
        words = [w if w in known else None for w in t.split()] + ["</s>"]
        want = sum(np.log10(exact[u, w] if (u, w) in exact else parent[w]) for u, w in zip(["</s>", *words], words, strict=False))
        assert found[i] == pytest.approx(want, abs=0.1 * len(words)), t  # the last parent is one draw
    every = [exact["a", w] for w in [*known, None]]
    assert sum(every) == pytest.approx(1)


def test_sampler_averages_to_the_exact_probabilities():
    from tessera.llm.pitman_yor import discount_of, gibbs

    pairs = {(0, 0): 3, (0, 1): 1, (1, 1): 2, (2, 0): 1}
    c = np.array(list(pairs.values()))
    got = gibbs(np.array([u for u, _ in pairs]), np.array([w for _, w in pairs]), c, 3, burn_in=200, samples=6000)
    # the sampler's base is uniform over the classes alone: the same model with the event of a new word left out
    words = [0, 1]
    exact, _ = _exact(pairs, words, discount_of(c))
    for (u, w), p in exact.items():
        if w is not None:
            assert got[u, w] == pytest.approx(p, abs=0.02)
