"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from panelwell.llm.spelling_variants import VariantSettings, edits, roots, spelling_variants

DOC = "doc_id long, text string, lang string, word string, n long"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, settings):
    counts = Counter()
    for doc_id, text in rows:
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % settings.every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= settings.letters and n >= settings.least}
    forms, out = {}, {}
    for w, n in words.items():
        others = [v for v in words if near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= settings.ratio * n else None
        out[w] = [forms[w], None, n, len(others), words.get(forms[w])]
    for w in words:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out[w][1] = root
    return {(w, *rest) for w, rest in out.items()}


def answer(spark, rows, settings):
    found = [tuple(r) for r in spelling_variants(spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], DOC), settings).collect()]
    assert len(found) == len(set(found))
    return set(found)


def texts(n, seed=5):
    draw = random.Random(seed)
    base = ["letter", "LATTER", "batter", "ÉCOLE", "école", "naïve", "naive", "aaaaaa", "×÷×÷×", "straße", "people", "zebras"]
    rows = []
    for i in range(n):
        words = []
        for _ in range(draw.randint(0, 40)):
            w = draw.choice(base)
            kind = draw.random()
            at = draw.randrange(len(w))
            if kind < 0.15:
                w = w[:at] + w[at + 1:]
            elif kind < 0.3:
                w = w[:at] + draw.choice("abzÿÀé") + w[at:]
            elif kind < 0.45:
                w = w[:at] + draw.choice("aeÿÀé") + w[at + 1:]
            words.append(w)
        rows.append((draw.choice([i, i, i, None, 7]), draw.choice([" ", "-", "1", "\n"]).join(words)))
    return rows + [(1, None), (2, ""), (3, "12 34 !"), (4, "q" * 20_000), (5, "q" * 19_999 + "z"), (6, "q" * 20_000), (6, "q" * 20_000)]


@pytest.mark.parametrize("settings", [
    VariantSettings(),
    # filters too small to hold back anything, few edits at a time, many partial counts
    VariantSettings(most=1, held=50, probes=3000, least=2, every=5),
    VariantSettings(letters=3, least=1, ratio=3),
])
def test_variants_equal_all_pairs(spark, settings):
    rows = texts(150)
    expected = brute(rows, settings)
    assert len(expected) > 100 and any(r[1] for r in expected)
    assert answer(spark, rows, settings) == expected


def test_variants_of_repeated_rows_and_none(spark):
    rows = texts(30) * 3
    assert answer(spark, rows, VariantSettings()) == brute(rows, VariantSettings())
    assert answer(spark, [], VariantSettings()) == set()
    with pytest.raises(ValueError):
        spelling_variants(spark.createDataFrame([], DOC), VariantSettings(ratio=1))


def test_edits_are_all_and_once():
    class Every:
        def holds(self, keys):
            import numpy as np

            return np.ones(len(keys), bool)

    found = list(edits(["aab", "xyz"], {2: Every(), 3: Every()}, 100))
    assert len(found) == len(set(found))
    assert {e for w, e in found if w == "aab" and len(e) == 2} == {"ab", "aa"}
    assert ("xyz", "xyÿ") in found and ("xyz", "xya") not in found


def test_long_chains_of_forms(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(40)], "word string, form string")
    assert {tuple(r) for r in roots(forms).collect()} == {(f"w{i}", "w40") for i in range(40)}
