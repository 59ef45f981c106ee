"""The field's beliefs against sums over all labellings, its tie groups, and the classifier's sizes recomputed."""

import itertools

import numpy as np
import pytest
import zstandard

from millrace.llm import pii, quality
from millrace.llm.common import table

SF = "/root/testdata/sf0.001"


def exact(field, g):
    """Marginals by going through every labelling."""
    n, k = len(g.start), pii.LABELS
    local = g.features @ field.node
    total = np.zeros((n, k))
    for labels in itertools.product(range(k), repeat=n):
        if any(b and b != x for b, x in zip(g.base, labels, strict=True)):
            continue
        score = sum(local[i, x] for i, x in enumerate(labels) if not g.base[i])
        score += sum(field.chain[labels[a], labels[b]] for a, b in g.chain) + sum(field.skip[labels[a], labels[b]] for a, b in g.skip)
        for i, x in enumerate(labels):
            total[i, x] += np.exp(score)
    return total / total.sum(1, keepdims=True)


def made(n, chain, skip, base, seed):
    rng = np.random.default_rng(seed)
    pairs = lambda x: np.array(x, np.int64).reshape(-1, 2)
    g = pii.Graph(list(range(n)), list(range(1, n + 1)), rng.normal(size=(n, pii.N_FEATURES)), pairs(chain), pairs(skip), np.array(base))
    far = rng.normal(size=(pii.LABELS, pii.LABELS))
    return g, pii.Field(rng.normal(size=(pii.N_FEATURES, pii.LABELS)) * 0.3, rng.normal(size=(pii.LABELS, pii.LABELS)) * 0.5, (far + far.T) / 4)


@pytest.mark.parametrize("seed", range(4))
def test_beliefs_are_exact_on_trees(seed):
    for chain, skip, base in (([(0, 1), (1, 2), (2, 3)], [], [0, 0, 0, 0]), ([(0, 1)], [(1, 2), (1, 3), (3, 4)], [0, 2, 0, 0, 0]), ([], [(0, 3), (1, 3)], [1, 0, 0, 0])):
        g, field = made(len(base), chain, skip, base, seed)
        assert np.allclose(field.beliefs(g, rounds=200, damping=0.0), exact(field, g), atol=1e-3)


@pytest.mark.parametrize("seed", range(4))
def test_beliefs_are_near_on_loops(seed):
    g, field = made(5, [(0, 1), (1, 2), (3, 4)], [(0, 2), (1, 4), (2, 4)], [0, 0, 3, 0, 0], seed)
    assert np.abs(field.beliefs(g) - exact(field, g)).max() < 0.12


def test_tie_groups_are_whole():
    assert pii.tied_together(4, np.array([(0, 2), (1, 2), (1, 3)])) == [0, 0, 0, 0]
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 12))
        edges = rng.integers(0, n, (int(rng.integers(0, 10)), 2))
        reach = np.eye(n, dtype=bool)
        for a, b in edges:
            reach[a, b] = reach[b, a] = True
        for _ in range(n):
            reach = (reach.astype(int) @ reach.astype(int)) > 0
        assert pii.tied_together(n, edges) == reach.argmax(1).tolist()


def test_scores_follow_from_sizes_under_the_two_dictionaries(spark):
    docs = table(spark, SF, "documents")
    model = quality.fit(docs, table(spark, SF, "labels"))
    made = [zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (model.good, model.bad)]
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        good, bad = (sum(len(c.compress(raw[i : i + quality.BLOCK])) for i in range(0, len(raw), quality.BLOCK)) for c in made)
        d, share = ((bad - good) / (bad + good), np.log((good + bad) / (2 * len(raw)))) if raw else (0.0, model.usual_share)
        x = (np.array([d, d * abs(d), share, share * share]) - model.centre) / model.scale
        one = got[r["doc_id"]]
        assert one["difference"] == pytest.approx(d, abs=1e-12)
        assert one["score"] == pytest.approx(1 / (1 + np.exp(-(model.offset + x @ np.array(model.weights)))), abs=1e-9)
