import math
import random
from collections import Counter

import numpy as np
import pytest

from panelwell.llm.quality import JUDGED, SHAPES, TOKEN, KneserNey, QualitySettings, discounts, quality, shape


def documents(spark, texts):
    return spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")


def ids(spark, numbers):
    return spark.createDataFrame([(i,) for i in numbers], "doc_id long")


def steps(text):
    """(what went before, token) of a text; a repetition is one token, whatever its word."""
    tokens = TOKEN.findall(text)
    return [(a, "<again>" if a == b else b) for a, b in zip(["<s>", *tokens], tokens)]


def off(d, n):
    return d[min(n, 3) - 1] if n else 0.0


def plain_losses(texts, trusted):
    """Kneser-Ney with all its counts in dictionaries, made anew without each trusted text."""
    kind = lambda t: "again" if t == "<again>" else shape(t)
    whole = Counter(p for i in trusted for p in steps(texts[i]))
    discount = discounts([sum(n == k for n in whole.values()) for k in (1, 2, 3, 4)])
    k_whole = Counter(t for _, t in whole)
    lower = discounts([sum(n == k for n in k_whole.values()) for k in (1, 2, 3, 4)])
    known, once = Counter(map(kind, k_whole)), Counter(kind(t) for t, n in k_whole.items() if n == 1)
    share = {s: (once[s] + 1) / (sum(once.values()) + len(SHAPES)) for s in SHAPES}
    result = []
    for i, text in enumerate(texts):
        counts = whole - Counter(steps(text)) if i in trusted else whole
        k, total, freed = Counter(t for _, t in counts), Counter(), Counter()
        for (a, _), n in counts.items():
            total[a] += n
            freed[a] += off(discount, n)
        loss = 0.0
        for a, t in steps(text):
            word = share[kind(t)] / (known[kind(t)] + once[kind(t)] + 1)
            p1 = max(0, k[t] - off(lower, k[t])) / len(counts) + sum(off(lower, n) for n in k.values()) / len(counts) * word
            p = max(0, counts[a, t] - off(discount, counts[a, t])) / total[a] + freed[a] / total[a] * p1 if total[a] else p1
            loss -= math.log(p)
        result.append(loss)
    return result


@pytest.mark.parametrize("chunk_tokens", [40, 1 << 21])
def test_perplexities_equal_a_plain_model(spark, chunk_tokens):
    draw = random.Random(4)
    words = [a + b for a in ("ka", "Lo", "mi") for b in ("ra", "se", "no", "X", "7")] + ["!", "..."]
    texts = [" ".join(draw.choices(words, weights=range(len(words), 0, -1), k=draw.randint(1, 30))) for _ in range(60)] + ["unseen Words 42 42 42 only ?"]
    trusted = set(range(0, 40))
    rows = {r["doc_id"]: r for r in quality(documents(spark, texts), ids(spark, trusted), QualitySettings(chunk_tokens=chunk_tokens)).collect()}
    assert len(rows) == len(texts)
    for i, (text, loss) in enumerate(zip(texts, plain_losses(texts, trusted))):
        n = len(TOKEN.findall(text))
        assert rows[i]["n_tokens"] == n and math.log(rows[i]["perplexity"]) == pytest.approx(loss / n, rel=1e-9)


def test_a_rare_word_of_trusted_text_is_no_shape(spark):
    """A word below a ten-thousandth of all tokens is known if trusted text has it; an invented one of its shape is not."""
    filler = " ".join(["plain", "text"] * 20_000)
    texts = [filler, "ambre soleil violet", "rouge soleil ambre", "violet rouge soleil", "ambre soleil violet rouge", "xqzvy soqqzz viqqzz xqzvy"]
    rows = {r["doc_id"]: r for r in quality(documents(spark, texts), ids(spark, [1, 2, 3])).collect()}
    assert rows[4]["perplexity"] < 0.5 * rows[5]["perplexity"]


def test_chances_add_up_to_one():
    words, once = np.zeros(len(SHAPES), np.int64), np.zeros(len(SHAPES), np.int64)
    words[:3], once[:3] = (3, 2, 1), (2, 1, 0)
    k, shapes = np.array([1, 1, 5, 1, 2, 9]), np.array([0, 0, 0, 1, 1, 2])
    model = KneserNey.fitted(np.array([9, 4, 2, 1]), np.r_[words, once, k.sum(), 3, 1, 0, 0, 2])
    unseen = (model.lower(np.zeros(len(SHAPES), np.int64), np.arange(len(SHAPES))) * (once + 1)).sum()
    assert model.lower(k, shapes).sum() + unseen == pytest.approx(1.0)


def test_repetitions_are_judged(spark):
    draw = random.Random(5)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]
    clean = [" ".join(draw.choices(words, k=60)) for _ in range(80)]
    rows = quality(documents(spark, [*clean, " ".join(["bal"] * 30 + ["cem"] * 30)]), ids(spark, range(60))).collect()
    assert sorted(r["doc_id"] for r in rows if not r["keep"]) == [80]
    assert all(r[t] is not None for r in rows for t in JUDGED.values())
