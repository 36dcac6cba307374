"""The toxicity model remembers words: each is looked at closely once, and scores don't depend on what was seen before."""

import pytest

from folioflow.llm import toxicity


def model():
    texts = [f"A plain text about tree{i % 7}. Nothing more." for i in range(40)] + [f"You are a zorgling number{i % 5}. Nice day." for i in range(20)]
    return toxicity.NoisyOr().fit(texts, [0] * 40 + [1] * 20, steps=100)


def test_each_word_once(monkeypatch):
    m, looked = model(), []
    assert m.weights
    plain = toxicity.features
    monkeypatch.setattr(toxicity, "features", lambda w: (looked.extend(w), plain(w))[1])
    text = "A zorgling zorglings. The zorgling said no.\n" * 50
    first = m.score(text)
    assert len(looked) == len(set(looked)) and m.score(text) == first and len(looked) == len(set(looked))


def test_scores_don_t_depend_on_memory(monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_SEEN", 3)
    texts = ["A zorgling. Two words here", "", None, "tree1 nothing", "You are zorglingish! zorg", "!!"]
    m = model()
    forth = [m.score(t) for t in texts]
    assert [m.score(t) for t in reversed(texts)] == forth[::-1] and len(m.seen) < 12
    assert forth == pytest.approx([model().score(t) for t in texts], abs=1e-15) and forth[0] > forth[3]
