"""The quality ranking written a second time, plainly: features by regular expressions, the fit by its conditions."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest

from stationwise.llm import quality_rank
from tests.llm.test_operators import ODD
from tests.oracle import DATA, duck

CLASSES = ["[A-Z]", "[a-z]", "[0-9]", " ", "\n", r"\.", ",", "[!?]", r"\|", "[#$%&*]", "[@/:;=_+~^]", r"[()\[\]{}<>]", "[\"'`-]"]


def plain_features(text):
    raw = text.encode()
    n = len(raw)
    if not n:
        return [0.0] * 22 + [1.0]
    as_bytes = raw.decode("latin-1")
    shares = [len(re.findall(c, as_bytes)) / n for c in CLASSES]
    shares.append(1 - sum(shares))
    words, lines = re.split("[ \t\n\v\f\r]+", text), text.split("\n")
    share = lambda flag: sum(map(flag, words)) / len(words)
    return shares + [
        math.log1p(n),
        n / len(words) / 10,
        math.log1p(n / len(lines)),
        share(lambda w: bool(re.fullmatch("[^a-z]*[A-Z]{2,}[^a-z]*", w))),
        share(lambda w: bool(w) and not re.match("[0-9A-Za-z.,;:'\")\x80-\U0010ffff]", w[-1])),
        share(lambda w: bool(re.fullmatch("[^0-9A-Za-z\x80-\U0010ffff]+", w))),
        len(set(words)) / len(words),
        1 - len(set(lines)) / len(lines),
        0.0,
    ]


@pytest.fixture(scope="module")
def labelled():
    rows = duck(f"{DATA}/sf0.01").execute("SELECT coalesce(d.text, ''), l.quality FROM documents d JOIN labels l USING (doc_id) ORDER BY doc_id").fetchall()
    return [t for t, _ in rows], np.array([q for _, q in rows])


def test_features_equal_the_plain_ones(labelled, monkeypatch):
    texts = [t or "" for t in ODD] + labelled[0]
    want = np.array([plain_features(t) for t in texts])
    for size in (quality_rank.BLOCK_BYTES, 700):
        monkeypatch.setattr(quality_rank, "BLOCK_BYTES", size)
        assert np.allclose(quality_rank.features(pa.array(texts)), want, atol=1e-12)


def test_fit_meets_the_conditions_of_its_optimum(labelled):
    """Pairs enumerated by hand; the gradient of the ridged Bradley-Terry loss is zero, and moving any weight raises the loss."""
    x, y = np.array([plain_features(t) for t in labelled[0]]), labelled[1]
    model = quality_rank.fit_pairs(x, y, 0.3)
    spread = x.std(0)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, np.where(spread > 1e-9, spread, 1))
    z = np.clip((x - model.mean) / model.scale, -8, 8)
    good, bad = [i for i, q in enumerate(y) if q == 1], [i for i, q in enumerate(y) if q == 0]
    pairs = [(good[k % len(good)], bad[(k * 7919 + k // len(good)) % len(bad)]) for k in range(4 * max(len(good), len(bad)))]
    d = np.array([z[a] - z[b] for a, b in pairs])

    def loss(w):
        return np.mean([math.log1p(math.exp(-t)) if t > -500 else -t for t in d @ w]) + 1e-3 / 2 * w @ w

    grad = -(d / (1 + np.exp(d @ model.weights))[:, None]).mean(0) + 1e-3 * model.weights
    assert np.abs(grad).max() < 1e-8
    best = loss(model.weights)
    for j in range(x.shape[1]):
        step = np.zeros(x.shape[1])
        step[j] = 1e-3
        assert loss(model.weights + step) >= best and loss(model.weights - step) >= best


def test_cut_agrees_with_most_labels_and_scores_are_its_sides(labelled):
    x, y = quality_rank.features(pa.array(labelled[0])), labelled[1]
    model = quality_rank.fit_pairs(x, y, 0.3)
    raw = ((x - model.mean) / model.scale) @ model.weights

    def agreement(cut):
        return ((raw >= cut) & (y == 1)).sum() / (y == 1).sum() + ((raw < cut) & (y == 0)).sum() / (y == 0).sum()

    assert agreement(model.cut) == pytest.approx(max(agreement(c) for c in np.sort(raw)))
    score = model.score(x)
    assert ((score >= 0.3) == (raw >= model.cut)).all()
    free = 1 / (1 + np.exp(-(8 / max(np.quantile(raw, 0.9) - np.quantile(raw, 0.1), 1e-6) * (raw - model.cut) + math.log(0.3 / 0.7))))
    assert np.allclose(score, free, atol=1e-9)
