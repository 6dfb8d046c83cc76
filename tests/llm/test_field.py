"""The line field against enumeration of all labelings, and its fit against the likelihood."""

from itertools import product

import numpy as np

from statewise.llm import quality_crf


def _enumerated(emission, transition):
    scores = {y: sum(e for e, v in zip(emission, y) if v) + sum(transition[a, b] for a, b in zip(y, y[1:])) for y in product((0, 1), repeat=len(emission))}
    top = max(scores.values())
    weight = {y: np.exp(s - top) for y, s in scores.items()}
    total = sum(weight.values())
    good = [sum(w for y, w in weight.items() if y[t]) / total for t in range(len(emission))]
    moves = np.zeros((2, 2))
    for y, w in weight.items():
        for a, b in zip(y, y[1:]):
            moves[a, b] += w / total
    return good, moves, top + np.log(total)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    lengths = [1, 4, 2, 7, 3]
    row = np.repeat(np.arange(len(lengths)), lengths)
    emission, transition = rng.normal(0, 2, len(row)), rng.normal(0, 1.5, (2, 2))
    good, moves = quality_crf.marginals(row, emission, transition)
    want = [_enumerated(emission[row == k], transition) for k in range(len(lengths))]
    assert np.allclose(good, np.concatenate([w[0] for w in want])) and np.allclose(moves, sum(w[1] for w in want))


def test_fit_stands_at_the_penalised_maximum():
    """Lines whose labels change within a document: the slope of the likelihood, by enumeration, is near 0 at the fit."""
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 6, 40)
    row = np.repeat(np.arange(len(lengths)), lengths)
    label = rng.integers(0, 2, len(row))
    x = rng.normal(0, 1, (len(row), quality_crf.N_FEATURES))
    x[:, 0] += label
    ridge = 0.05
    field = quality_crf.fit(row, x, label, 0.5, rounds=2000, rate=0.03, ridge=ridge)
    wide = quality_crf.with_neighbours(row, (x - field.mean) / field.scale)

    def value(weights, transition):
        out = 0.0
        for k in range(len(lengths)):
            own, y = wide[row == k] @ weights, label[row == k]
            out += own[y == 1].sum() + sum(transition[a, b] for a, b in zip(y, y[1:])) - _enumerated(own, transition)[2]
        return out / len(row) - ridge / 2 * ((weights**2).sum() + (transition**2).sum())

    best = value(field.weights, field.transition)
    for i in range(0, len(field.weights), 5):
        step = np.zeros(len(field.weights))
        step[i] = 1e-3
        assert abs(value(field.weights + step, field.transition) - value(field.weights - step, field.transition)) / 2e-3 < 2e-3
    for a, b in product((0, 1), repeat=2):
        step = np.zeros((2, 2))
        step[a, b] = 1e-3
        assert abs(value(field.weights, field.transition + step) - value(field.weights, field.transition - step)) / 2e-3 < 2e-3
    assert best > value(np.zeros_like(field.weights), np.zeros((2, 2)))


def test_score_weighs_lines_by_length():
    field = quality_crf.Field(np.zeros(3 * quality_crf.N_FEATURES + 1), np.zeros((2, 2)), np.zeros(quality_crf.N_FEATURES), np.ones(quality_crf.N_FEATURES), 0.3)
    field.weights[0] = 2.0
    row, chars, x = np.array([0, 0, 2]), np.array([10.0, 30.0, 5.0]), np.zeros((3, quality_crf.N_FEATURES))
    x[:, 0] = [1.0, -1.0, 0.5]
    good = 1 / (1 + np.exp(-2 * x[:, 0]))
    assert np.allclose(field.scores(row, chars, x, 4), [(10 * good[0] + 30 * good[1]) / 40, 0.3, good[2], 0.3])
