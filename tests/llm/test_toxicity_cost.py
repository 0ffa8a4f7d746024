"""What the toxicity search shares: new words of several texts, lists of terms with equal postings, narrow error bounds."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import xxhash

from panelwell.llm import toxicity
from panelwell.llm.common import words_of
from panelwell.llm.toxicity import BlockMaxIndex, Terms, same_postings, terms_of

TEXTS = ["Straße straßen, FOO_bar foobar", "", None, "naïveté naïve 12345678 foobars \U0001F600\U0001F600\U0001F600\U0001F600x", "foo " * 50 + "Zebras zebra", "unheard0"]


def places(vocabulary, text):
    at = {h: i for i, h in enumerate(vocabulary.tolist())}
    hashes = (xxhash.xxh64_intdigest(t) for w in words_of(text) for t in terms_of(w))
    return Counter(at[h] for h in np.array(list(hashes), np.uint64).view(np.int64).tolist() if h in at)


def test_new_words_of_several_texts_are_learnt_at_once(monkeypatch):
    vocabulary = np.unique(np.concatenate([Terms().counts(t)[0] for t in TEXTS[:5]]))
    calls = []
    learn = Terms.learn
    monkeypatch.setattr(Terms, "learn", lambda self, words: (calls.append(len(words)), learn(self, words))[1])
    terms = Terms(vocabulary)
    for (ids, tf), text in zip(terms.each(TEXTS, Terms.counted), TEXTS, strict=True):
        assert dict(zip(ids.tolist(), tf.tolist())) == places(vocabulary, text) and (np.diff(ids) > 0).all()
    assert len(calls) == 1
    for ids, text in zip(terms.each(TEXTS, Terms.distinct), TEXTS, strict=True):
        assert sorted(ids.tolist()) == sorted(places(vocabulary, text))


def test_words_are_the_same_however_few_are_remembered(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("abcdé", k=rng.randint(1, 8))) for _ in range(30)) for _ in range(40)]
    vocabulary = np.unique(np.concatenate([Terms().counts(t)[0] for t in texts[:20]]))
    monkeypatch.setattr(toxicity, "MEMO", 35)
    monkeypatch.setattr(toxicity, "TOGETHER", 400)
    for (ids, tf), text in zip(Terms(vocabulary).each(texts, Terms.counted), texts, strict=True):
        assert dict(zip(ids.tolist(), tf.tolist())) == places(vocabulary, text)


def test_terms_of_equal_postings_are_one_list():
    rng = np.random.default_rng(1)
    # terms 0 and 1, and 4 and 5, stand in the same examples; 2 and 3 do, too, but not equally often
    rows = [({0, 1, 2, 3}, 2), ({2, 3, 4, 5}, 1), ({0, 1, 6}, 1)]
    term = np.array([t for some, _ in rows for t in sorted(some)])
    example = np.array([i for i, (some, _) in enumerate(rows) for _ in some])
    tf = np.array([7 if t == 3 else n for some, n in rows for t in sorted(some)])
    assert same_postings(term, example, tf, 8).tolist() == [0, 0, 2, 3, 4, 4, 6, 7]
    texts = [(np.unique(rng.integers(0, 40, 9)), None) for _ in range(70)]
    texts = [(np.concatenate([ids, ids + 40]), rng.integers(1, 4, len(ids)).repeat(1)) for ids, _ in texts]
    texts = [(ids, np.concatenate([tf, tf])) for ids, tf in texts]
    idf = rng.uniform(0.1, 3, 80)
    index = BlockMaxIndex(texts, np.arange(70) % 2, idf, 16)
    x = np.zeros((70, 80))
    for row, i in enumerate(index.order):
        ids, tf = texts[i]
        x[row, ids] = (1 + np.log(tf)) * idf[ids]
    x /= np.linalg.norm(x, axis=1)[:, None]
    for i, (members, cosines) in zip(index.order, index.nearest([texts[i] for i in index.order], 5), strict=True):
        best = np.sort(x @ x[np.flatnonzero(index.order == i)[0]])[::-1][:5]
        assert np.allclose(cosines, best, atol=1e-12)
    assert len(index.start) - 1 == 40
