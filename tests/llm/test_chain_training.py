"""Training of the chain against its likelihood, summed over all taggings."""

import itertools

import numpy as np

from walkframe.llm import toxicity

HAS = np.array([[0, 0], [1, 0], [0, 1], [1, 1]], float)  # words (rows) and their features
SEQUENCES = np.array([[1, 0, 2, 0, 0], [0, 3, 0, 1, 2], [2, 2, 0, 0, 0], [0, 0, 0, 0, 0], [1, 1, 3, 0, 0], [3, 0, 0, 2, 0]])
LABELS = np.array([[1, 0, 0, 0, 0], [0, 1, 1, 1, 0], [0, 1, 0, 0, 0], [0, 0, 1, 0, 0], [0, 1, 1, 0, 0], [1, 0, 0, 0, 1]])
LENGTHS = np.array([4, 5, 2, 5, 3, 1])


def score(theta, words, tags):
    each = sum(y * (theta[1] + HAS[w] @ theta[6:]) for w, y in zip(words, tags))
    return theta[0] * tags[0] + each + sum(theta[2 + 2 * a + b] for a, b in zip(tags, tags[1:]))


def loss(theta):
    """Negative log likelihood on the scale that training uses, with its penalty."""
    total = 0.0
    for words, tags, n in zip(SEQUENCES, LABELS, LENGTHS):
        every = [score(theta, words[:n], y) for y in itertools.product((0, 1), repeat=int(n))]
        total += np.logaddexp.reduce(every) - score(theta, words[:n], tuple(tags[:n]))
    return total / LENGTHS.sum() * 100 + 0.001 * theta @ theta


def slope(theta, h=1e-5):
    return np.array([(loss(theta + h * e) - loss(theta - h * e)) / (2 * h) for e in np.eye(len(theta))])


def trained(steps):
    return toxicity.train_chain(SEQUENCES, LABELS, LENGTHS, HAS, steps)


def test_training_ends_near_the_least_loss():
    # steps of one length circle around the optimum, so that the slope isn't zero where they end; the loss says how near
    best = trained(500)
    for _ in range(30):
        bend = np.array([(slope(best + 1e-3 * e) - slope(best - 1e-3 * e)) / 2e-3 for e in np.eye(8)])
        best = best - np.linalg.solve((bend + bend.T) / 2 + 1e-3 * np.eye(8), slope(best))
    assert np.abs(slope(best)).max() < 1e-3
    start, end, least = loss(np.zeros(8)), loss(trained(500)), loss(best)
    assert least <= end < least + 0.01 * (start - least)


def test_first_step_goes_down_every_slope():
    # the first step of Adam is as long in each direction, against the sign of the gradient
    down = slope(np.zeros(8))
    assert (np.abs(down) > 1e-3).sum() >= 6
    assert all(np.sign(t) == -np.sign(d) for t, d in zip(trained(1), down) if abs(d) > 1e-3)


def test_gradient_of_any_point():
    # two steps differ from one by what the gradient at the first step's end says
    one, two, g0 = trained(1), trained(2), slope(np.zeros(8))
    g1 = slope(one)
    m, v = (0.9 * 0.1 * g0 + 0.1 * g1) / (1 - 0.9**2), (0.99 * 0.01 * g0**2 + 0.01 * g1**2) / (1 - 0.99**2)
    assert np.allclose(two - one, -0.25 * m / (np.sqrt(v) + 1e-8), atol=1e-4)
