"""Phrase collocations against a plain count."""

import random
import re
from collections import Counter

import pytest

from panelwell.llm.collocations import CollocationSettings, CountTransducer, Level, collocations, grams, pruned, ranged, united

DOC = "doc_id long, text string, lang string, rank int, phrase string"


def brute(rows, settings):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for n in range(1, settings.words + 1):
                f.update((lang, tuple(words[i:i + n])) for i in range(len(words) - n + 1))
    scored, dropped = {}, set()
    for (lang, p), a in f.items():
        if len(p) < 2 or a < settings.least:
            continue
        scored[lang, p] = min((settings.scale * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        for i in range(len(p)):
            for j in range(i + 2, len(p) + 1):
                if j - i < len(p) and 100 * a >= settings.inside * f[lang, p[i:j]]:
                    dropped.add((lang, p[i:j]))
    out = set()
    for lang in total:
        left = [(-s[0], -f[lang, p], " ".join(p).encode(), s) for (g, p), s in scored.items() if g == lang and (g, p) not in dropped]
        for rank, (_, a, p, s) in enumerate(sorted(left)[:settings.top], 1):
            out.add((lang, rank, p.decode(), -a, s[2], s[3], total[lang], s[0]))
    return out


def texts(n, seed=1):
    draw = random.Random(seed)
    words = ["a", "B", "cÉ", "d", "É", "zz", "x y", "\U0001F600"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\r\n", ";", " ! "]
    rows = []
    for i in range(n):
        text = "".join(draw.choice(words[:draw.choice((2, 4, 8))]) + draw.choice(ends) for _ in range(draw.randint(0, 60)))
        rows.append((draw.choice(["en", "en", "en", None, "und", "fr"]), text + draw.choice(["", "set phrase of four", "Set phrase of five"])))
    return rows + [("en", None), (None, ""), ("en", "  \t . "), ("long", "one two three four five " * 3000)]


def answer(spark, rows, settings):
    docs = spark.createDataFrame([(i, t, g, 1, "x") for i, (g, t) in enumerate(rows)], DOC)
    found = [tuple(r) for r in collocations(docs, settings).collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("settings", [
    CollocationSettings(),
    # many shards that end inside pieces, many ranges, a filter too small to hold back anything, several shares of requests
    CollocationSettings(shard_words=97, range_words=300, filter_most=512, requests=20, top=25),
    CollocationSettings(words=3, least=5, shard_words=200, range_words=1000),
    CollocationSettings(words=2, least=40, inside=50),
])
def test_collocations_equal_a_plain_count(spark, settings):
    rows = texts(160)
    expected = brute(rows, settings)
    assert len(expected) > 10
    assert answer(spark, rows, settings) == expected


def test_collocations_of_repeated_rows_and_none(spark):
    rows = texts(20) * 4
    assert answer(spark, rows, CollocationSettings()) == brute(rows, CollocationSettings())
    assert answer(spark, [], CollocationSettings()) == set()
    assert answer(spark, [(None, None)], CollocationSettings()) == set()


def test_transducers_of_ranges_unite_to_the_whole():
    import numpy as np

    draw = np.random.default_rng(3)
    words = [b"a", b"b", b"c", b"d", b"e"]
    whole = Counter()
    parts = {}
    borders = [(b"a", b"c"), (b"b",), (b"b", b"b", b"a"), (b"bb", b"x"), (b"d", b"e", b"e", b"e")]
    for _ in range(4):
        text = draw.integers(0, 6, 400)
        levels = grams(text, len(text), 4, 1)
        for i, t in ranged(words, levels, borders):
            parts.setdefault(i, []).append(CountTransducer.unpack(*t.pack()))
        for i in range(400):
            for n in range(1, 5):
                if i + n <= 400 and (text[i:i + n] > 0).all():
                    whole[tuple(words[w - 1] for w in text[i:i + n])] += 1
    found = {}
    for i, some in parts.items():
        names, levels = united(some)
        t = CountTransducer.build(names, levels)
        here = dict(t.phrases())
        assert not here.keys() & found.keys()
        assert all((i == 0 or borders[i - 1] <= p) and (i == len(borders) or p < borders[i]) for p in here)
        asked = [*here, (b"a", b"nothing"), (b"nothing",), *(p + (b"e",) for p in here)]
        assert t.compose(asked).tolist() == [here.get(p, 0) for p in asked]
        found |= here
        few = CountTransducer.build(names, pruned(levels, 20))
        assert dict(few.phrases()) == {p: n for p, n in here.items() if n >= 20}
    assert found == whole


def test_equal_states_are_merged():
    import numpy as np

    one = np.ones(3, np.int64)
    levels = [Level(np.arange(3), one, np.zeros(3, np.int64)), Level(np.full(3, 3), one, np.arange(3))]
    t = CountTransducer.build([b"a", b"b", b"c", b"z"], levels)
    assert len(t.starts) - 1 == 3 and len(t.label) == 4
