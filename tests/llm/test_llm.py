"""The training-data operators against brute force, their libraries, or planted cases."""

import hashlib
import os
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from panelwell.llm import queries as q
from panelwell.llm.chat_format import MARKED, Template, conversation_digests, escape, render_turns, unescape
from panelwell.llm.common import table, words_of
from panelwell.llm.decontamination import PositionalIndex, contamination
from panelwell.llm.html_text import extract_text, main_blocks
from panelwell.llm.jaccard_join import JoinSettings, similarity_join
from panelwell.llm.nearest_neighbours import CentroidGraph, Centroids, IndexSettings, search
from panelwell.llm.quality import quality
from panelwell.llm.source_mixture import Margin, mixture
from panelwell.llm.token_counts import count_tokens
from panelwell.llm.toxicity import BlockMaxIndex, Terms, ToxicitySettings, fit_toxicity, score_toxicity
from panelwell.llm.url_filters import filter_urls

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, node string"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
LONG = " ".join(f"w{i}" for i in range(30_000))


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en" if k % 3 else None, None if k % 2 else "s", 1, 0.5, "x") for k, (i, t) in enumerate(zip(ids, texts))], DOC)


def awkward(spark):
    return documents(spark, [None, "", "   ", "one two", "one two", LONG, "one two", "É \U0001F600 <|endoftext|>"], [None, 1, 2, 3, 3, 5, None, 7])


# --- 1 ---


def test_mixture_meets_margins_and_budget(spark):
    rows = [(i, "word " * 10, "en" if i % 4 else "fr", f"s{i % 3}", 1, 0.0, "") for i in range(3000)]
    docs = spark.createDataFrame(rows, DOC)
    margins = [Margin("source", shares={"s0": 0.5, "s1": 0.25, "s2": 0.25}), Margin("lang", shares={"en": 0.5, "fr": 0.5})]
    out = mixture(docs, F.lit(10), F.lit("t"), margins, keep=0.3, rounds=30)
    got = out.agg(F.sum("mix_probability"), F.sum(F.when(F.col("source") == "s0", F.col("mix_probability"))), F.sum(F.when(F.col("lang") == "fr", F.col("mix_probability"))), F.sum(F.col("mix_sampled").cast("int"))).first()
    assert got[0] == pytest.approx(900, rel=1e-6) and got[1] == pytest.approx(450, rel=1e-3) and got[2] == pytest.approx(450, rel=1e-6)
    assert abs(got[3] - 900) < 100 and out.columns[:7] == docs.columns


def test_mixture_of_awkward_rows(spark):
    rows = q.mixed(awkward(spark)).collect()
    assert len(rows) == 8 and all(r["mix_probability"] == 0 for r in rows if not (r["text"] or "").strip())
    twice = q.mixed(awkward(spark).unionByName(awkward(spark)))
    assert all(r["count"] % 2 == 0 for r in twice.groupBy("doc_id", "text", "lang", "source", "mix_sampled").count().collect())
    assert q.mixed(awkward(spark).limit(0)).count() == 0


# --- 2 ---


def test_url_lists_hold_from_day_to_day(spark):
    entries = spark.createDataFrame(
        [("bad.com", "spam", "block", date(2024, 1, 10)), ("bad.com", "spam", "remove", date(2024, 3, 5)), ("ok.bad.com", "spam", "allow", date(2024, 1, 20)),
         ("site.org/x", "adult", "block", date(2024, 2, 1)), ("bad.com", "spam", "block", date(2024, 1, 10)), (None, "spam", "block", date(2024, 1, 1))],
        "pattern string, category string, action string, day date",
    )
    asked = [
        ("http://bad.com/a", date(2024, 1, 9), False), ("http://bad.com/a", date(2024, 1, 10), True), ("https://u:p@WWW.bad.com:80/", date(2024, 3, 4), True),
        ("http://bad.com", date(2024, 3, 5), False), ("http://ok.bad.com", date(2024, 1, 19), True), ("http://ok.bad.com", date(2024, 1, 20), False),
        ("http://site.org/x?y", date(2024, 5, 1), True), ("http://site.org/y", date(2024, 5, 1), False), (None, date(2024, 2, 1), False), ("http://bad.com", None, False),
        ("nonsense", date(2024, 2, 1), False), ("http://bad.com/a", date(2024, 1, 10), True),
    ]
    captures = spark.createDataFrame(asked, "url string, fetched date, wanted boolean")
    rows = filter_urls(captures, entries).collect()
    assert len(rows) == len(asked) and all(r["url_blocked"] == r["wanted"] for r in rows)
    assert filter_urls(captures, entries.limit(0)).where("url_blocked").count() == 0
    assert filter_urls(captures.limit(0), entries).count() == 0


# --- 3 ---


def test_block_max_search_is_exact():
    import numpy as np

    draw = np.random.default_rng(3)
    idf = 0.01 + draw.random(60) ** 4 * 5
    texts = [np.unique(draw.integers(0, 60, draw.integers(1, 25)), return_counts=True) for _ in range(300)]
    texts[200:205] = texts[:5]  # repeats tie
    labels = draw.integers(0, 2, 300)
    example = np.repeat(np.arange(300), [len(i) for i, _ in texts])
    term, tf = (np.concatenate([t[part] for t in texts]) for part in (0, 1))
    index = BlockMaxIndex(texts, labels, idf, 16)
    dense = np.zeros((300, 60))
    dense[example, term] = (1 + np.log(tf)) * idf[term]
    dense /= np.linalg.norm(dense, axis=1)[:, None]
    dense = dense[index.order]
    for at, i in enumerate(index.order[:150]):
        for without in (-1, at):
            scores = np.round(dense @ dense[at], 12)
            scores[[without] if without >= 0 else []] = -1
            want = np.lexsort((np.arange(300), -scores))[:7]
            members, cosines = index.nearest([texts[i]], 7, [without] if without >= 0 else None)[0]
            assert members.tolist() == want[scores[want] > 0].tolist()
            assert np.allclose(cosines, scores[members], atol=1e-11)
    together = index.nearest([texts[i] for i in index.order], 7)
    assert all(np.array_equal(a, index.nearest([texts[i]], 7)[0][0]) for (a, _), i in zip(together, index.order))
    assert len(index.nearest([texts[0]], 1000)[0][0]) == (dense @ dense[np.flatnonzero(index.order == 0)[0]] > 0).sum()


def test_toxicity_scores_equal_dense_cosines(spark):
    import math
    import numpy as np

    from panelwell.llm.toxicity import fit_logistic, likelihood_ratio, logit, terms_of

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeo") for _ in range(rng.randint(2, 9))) for _ in range(200)]
    texts = [" ".join(rng.choices(words[:40] if i % 3 else words, k=rng.randint(1, 60)) + ["Vilest"] * (i % 4 == 0 and rng.random() < 0.9)) for i in range(260)]
    labels = [(i, int(i % 4 == 0)) for i in range(180)]
    settings = ToxicitySettings(examples=1000)
    model = fit_toxicity(documents(spark, texts), spark.createDataFrame(labels, "doc_id long, label int"), settings)
    got = {r["doc_id"]: r for r in score_toxicity(documents(spark, texts), model).collect()}

    bags = [{} for _ in texts]
    for bag, text in zip(bags, texts):
        for t in (t for w in words_of(text) for t in terms_of(w)):
            bag[t] = bag.get(t, 0) + 1
    names = sorted({t for bag in bags[:180] for t in bag})
    y = np.array([v for _, v in labels])
    held = np.array([[t in bag for t in names] for bag in bags], int)
    toxic = held[:180][y == 1].sum(axis=0)
    factor = likelihood_ratio(toxic, held[:180].sum(axis=0) - toxic, int(y.sum()), int((1 - y).sum()))
    idf = (np.log((len(texts) + 1) / (held.sum(axis=0) + 1)) + 1) * np.maximum(settings.least, factor)
    x = np.array([[(1 + math.log(bag[t])) * i if t in bag else 0.0 for t, i in zip(names, idf)] for bag in bags])
    x /= np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    prior = y.mean()

    def vote(cosine):
        best = np.sort(cosine)[::-1][settings.neighbours - 1]
        near = np.flatnonzero((cosine > 0) & (cosine >= best - 1e-12))
        w = cosine[near] ** 2
        mass = settings.pseudo_weight * prior
        return (w @ y[near] + mass * prior) / (w.sum() + mass), near

    loo = [vote(np.where(np.arange(180) == i, -1, x[:180] @ x[i]))[0] for i in range(180)]
    slope, offset = fit_logistic(np.array([logit(v) for v in loo]), y.astype(float), np.ones(180))
    close = 0
    for i in range(180, 260):
        v, near = vote(x[:180] @ x[i])
        assert set(got[i]["nearest_examples"]) <= set(near.tolist())
        close += abs(got[i]["score"] - 1 / (1 + math.exp(-offset - slope * logit(v)))) < 1e-6
    assert close >= 78  # ties at the last neighbour are cut by place


def test_toxicity_learns_words_and_takes_awkward_rows(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdeo") for _ in range(6))
    texts = [" ".join([word() for _ in range(30)] + (["vilestem" + word()[:2]] * 2 if i % 5 == 0 else [])) for i in range(400)]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)] + [(None, 1), (1, None)], "doc_id long, label int")
    model = fit_toxicity(docs, labels, ToxicitySettings(examples=100))
    rows = {r["doc_id"]: r for r in score_toxicity(docs, model).collect()}
    assert sum(rows[i]["predicted"] == int(i % 5 == 0) for i in range(300, 400)) >= 98
    odd = score_toxicity(awkward(spark), model).collect()
    assert len(odd) == 8 and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in odd)
    assert fit_toxicity(docs, labels.where("label = 1")) is None
    assert [r["score"] for r in score_toxicity(awkward(spark), None).collect()] == [0.0] * 8
    assert score_toxicity(docs.limit(0), model).count() == 0


def test_toxicity_indexes_all_terms_of_the_examples(spark):
    texts = [f"calm plain words number{i}" + (f" rare{i // 8}" if i % 4 == 0 else f" kind{i % 7}") for i in range(200)]
    docs = documents(spark, texts + ["calm plain words rare3 unseen", "calm plain words kind2 unseen"])
    model = fit_toxicity(docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, label int"))
    assert len(Terms(model.vocabulary).counts("calm rare3 kind2 number7")[0]) >= 4 and not len(Terms(model.vocabulary).counts("unheard")[0])
    rows = {r["doc_id"]: r for r in score_toxicity(docs, model).where("doc_id >= 200").collect()}
    assert (rows[200]["predicted"], rows[201]["predicted"]) == (1, 0) and rows[201]["n_neighbours"] == 15


# --- 4 ---


def test_token_counts_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = q.tokenizer_path()
    library = tokenizers.Tokenizer.from_file(path)
    texts = ["", None, "aaaaaaaaa", "it's 12 o'clock\n\n  now", "<|endoftext|>x<|endoftext|>", "日本語 Été\x85\x1c", "\U0001F600\U0001F600 ok", "a" * 5000, LONG]
    rows = count_tokens(documents(spark, texts), path).collect()
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert [r["n_tokens"] for r in sorted(rows, key=lambda r: r["doc_id"])] == want
    assert {r["doc_id"]: r["n_bytes"] for r in rows} == {i: len((t or "").encode()) for i, t in enumerate(texts)}
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in rows)
    assert count_tokens(awkward(spark), path).count() == 8 and count_tokens(awkward(spark).limit(0), path).count() == 0


# --- 5 ---


def brute_links(texts, size=5, least=0.8):
    sets = []
    for t in texts:
        w = words_of(t)
        sets.append({tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    near = {i: [j for j in range(len(sets)) if i != j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])] for i in range(len(sets))}
    label = list(range(len(sets)))
    for _ in sets:
        label = [min([label[i], *(label[j] for j in near[i])]) for i in range(len(sets))]
    return [len(near[i]) for i in range(len(sets))], label


@pytest.mark.parametrize("settings", [JoinSettings(), JoinSettings(bucket=4, block=8), JoinSettings(bucket=4, block=8, dense=2.0)])
def test_join_equals_brute_force(spark, settings):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(900)}" for _ in range(120)] for _ in range(4)]
    texts = []
    for i in range(90):
        w = list(base[i % 4])
        for _ in range(rng.choice([0, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        texts.append(" ".join(w))
    texts += ["tiny text", "tiny text", "", None, "other"]
    links, label = brute_links(texts)
    rows = {r["doc_id"]: r for r in similarity_join(documents(spark, texts), settings).collect()}
    assert [rows[i]["n_links"] for i in range(len(texts))] == links
    assert [rows[i]["class_id"] for i in range(len(texts))] == label
    assert all(rows[i]["representative"] == (label[i] == i) for i in range(len(texts)))


def test_join_of_awkward_rows(spark):
    rows = similarity_join(awkward(spark)).collect()
    assert len(rows) == 8
    same = [r for r in rows if r["class_id"] == 3]
    assert len(same) == 3 and all(r["n_links"] == 2 and r["n_copies"] == 2 for r in same)
    assert similarity_join(awkward(spark).limit(0)).count() == 0


# --- 6 ---


def test_search_finds_the_nearest(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 8)).astype(np.float32)
    x[100:140] = x[7]
    rows = [(i, v.tolist(), "x", 0) for i, v in enumerate(x)]
    odd = [(9000, None), (9001, [0.0] * 8), (9002, [float("nan")] * 8), (9003, [None] * 8), (9004, [1.0]), (None, [1.0] * 8), (9005, [])]
    df = spark.createDataFrame(rows + rows[:3] + [(i, v, "x", 0) for i, v in odd], "vec_id long, embedding array<float>, rank string, list int")
    found = {}
    for r in search(df, F.col("vec_id") % 20 == 0, 20, IndexSettings(list_rows=32, beam=24, block=50)).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hits = 0
    for query in range(0, 1500, 20):
        scores = x.astype(float) @ x[query].astype(float)
        order = [i for i in np.lexsort((np.arange(1500), -np.round(scores, 9))) if i != query][:20]
        assert sorted(found[query]) == list(range(1, 21)) and query not in [v for v, _ in found[query].values()]
        assert all(abs(scores[v] - s) < 1e-9 for v, s in found[query].values())
        hits += len({v for v, _ in found[query].values()} & set(order))
    assert hits / (75 * 20) >= 0.9 and set(found) == set(range(0, 1500, 20))
    assert search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_a_query_reads_all_lists_within_the_ratio():
    import numpy as np

    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(size=(400, 16)), np.zeros(400)])
    fitted = Centroids(CentroidGraph(x, 24), 40.0, IndexSettings(probe_ratio=1.6))
    asked = rng.normal(size=(30, 16))
    row, lists, place = fitted.lists_of(asked, False)
    gap = np.linalg.norm(np.column_stack([asked, np.zeros(30)])[:, None] - x, axis=2)
    want = gap <= gap.min(axis=1, keepdims=True) * 1.6
    assert want.sum(axis=1).max() > 64 and want[row, lists].all() and len(set(zip(row, lists))) == len(row) >= 0.99 * want.sum()
    assert all(sorted(place[row == i]) == list(range((row == i).sum())) for i in range(30))


# --- 7 ---


def brute_contamination(text, items):
    words, hit, names = words_of(text), set(), set()
    for name, item in items:
        w = words_of(item)
        n = min(13, len(w))
        for s in range(len(w) - n + 1) if n else ():
            for p in range(len(words) - n + 1):
                if words[p:p + n] == w[s:s + n]:
                    hit.update(range(p, p + n))
                    names.add(str(name))
    digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return len(words), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(words)


def test_contamination_equals_brute_force(spark):
    rng = random.Random(8)
    words = [rng.choice("the of a in cat dog Été runs".split()) for _ in range(400)]
    items = [(1, " ".join(words[20:60])), (2, "Cat dog"), (3, ""), (4, None), (10, " ".join(words[100:113])), (2, " ".join(words[200:230])), (None, "the of"), (1, " ".join(words[20:60]))]
    texts = [" ".join(words), " ".join(words[:40]), " ".join(words[30:50]).upper().replace("ÉTÉ", "Été"), "cat, DOG!", None, "", "nothing here", "x " * 500 + "cat dog", " ".join(words[100:113])]
    docs = documents(spark, texts + texts[:2], [*range(len(texts)), 0, None])
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    rows = contamination(docs, bench).collect()
    want = sorted(brute_contamination(t, [i for i in items if i[0] is not None]) for t in texts + texts[:2])
    assert sorted((r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows) == want
    assert contamination(docs.limit(0), bench).count() == 0
    assert contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert PositionalIndex(docs, bench).proximity_matches(13).where("doc_id = 1 AND item_id = 1").count() == 1


# --- 8 ---


def test_escapes_are_reversible():
    rng = random.Random(4)
    parts = ["<|turn|>", "<|end|>\n", "\\", "\\-", "<", "</s>", "[INST]", "x", "<|<|end|>", "<</SYS>>"]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(8))
        assert unescape(escape(text)) == text and "<|end|>" not in escape(text) and "</s>" not in escape(text)


def test_chat_digests_are_read_back(spark):
    rows = [(1, 1, "assistant", "b<|end|>\n\\"), (1, 0, "user", "a"), (2, 0, None, None), (2, 0, "assistant", "é"), (None, None, "user", "x"), (1, 1, "assistant", "b<|end|>\n\\")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, piece int")
    got = {r["conv_id"]: r for r in conversation_digests(render_turns(df, MARKED)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    turn = "assistant\nb<|end|>\n\\\n"
    assert got[1]["turns_sha256"] == sha("user\na\n" + turn + turn) and got[1]["loss_sha256"] == sha("b<|end|>\n\\" * 2) and got[1]["n_turns"] == 3
    assert got[2]["turns_sha256"] == sha("\n\nassistant\né\n") and got[2]["loss_chars"] == 1 and got[None]["loss_chars"] == 0
    assert conversation_digests(render_turns(df.limit(0), MARKED)).count() == 0


def test_rewriting_templates_are_found(spark):
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate([("user", "a"), ("assistant", "b"), ("user", "c")])], "conv_id long, turn long, role string, text string")
    last_only = Template(lambda ms: "".join(f"[{r}]{t if i == len(ms) - 1 else '...'}|" for i, (r, t) in enumerate(ms)))
    assert [r["rewrites"] for r in render_turns(df, last_only).orderBy("turn").collect()] == [False, True, True]
    plain = Template(lambda ms: "<s>" + "".join(f"[{r}] {t.strip()} |" for r, t in ms))
    rows = render_turns(df, plain).orderBy("turn").collect()
    whole = "".join(r["piece"] for r in rows)
    assert [whole[r["content_begin"]:r["content_end"]] for r in rows] == ["a", "b", "c"] and whole.startswith("<s>[user] a |")


# --- 9 ---


def test_quality_keeps_clean_and_rejects_junk(spark):
    rng = random.Random(9)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu") for b in ("ra", "se", "no")]
    clean = [" ".join(rng.choice(vocabulary) for _ in range(80)).capitalize() + "." for _ in range(200)]
    junk = ["QX!! " * 40, "".join(rng.choice("0189%$#") for _ in range(400)), "again " * 60]
    docs = documents(spark, clean + junk + [None, "", "x"])
    trusted = spark.createDataFrame([(i,) for i in range(100)] + [(None,)], "doc_id long")
    rows = {r["doc_id"]: r for r in quality(docs, trusted).collect()}
    assert all(rows[i]["keep"] for i in range(200)) and not any(rows[200 + i]["keep"] for i in range(3))
    assert rows[203]["keep"] and rows[203]["perplexity"] == 1.0 and len(rows) == 206
    assert all(r["keep"] and r["threshold"] is None for r in quality(awkward(spark), trusted.limit(0)).collect())
    assert quality(docs.limit(0), trusted).count() == 0


# --- 10 ---


def test_article_text_is_found(spark):
    page = (
        "<html><head><title>T</title><script>var a='<p>x</p>'</script></head><body><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies " + "a " * 90 + "</div>"
        "<article><h1>Head &amp; shoulders</h1><p>" + "long text " * 40 + "<br>end<p>Short.<aside>see also</aside><form><input></form></article>"
        "<section id=comments><p>" + "great post " * 50 + "</section><footer>&copy; me</footer>"
    )
    want = ["Head & shoulders", ("long text " * 40 + "end"), "Short."]
    assert main_blocks(page) == want and main_blocks("") == [] and main_blocks(None) == [] and main_blocks("<nav>x</nav>") == []
    assert main_blocks("plain words only") == ["plain words only"]
    assert main_blocks("<body><div><p>" + "words here " * 30 + "</p><p>tail</p></div><ul class=menu><li>a</ul>") == [("words here " * 30).strip(), "tail"]
    df = spark.createDataFrame([(1, "u", page, "old"), (1, "u", page, "old"), (None, None, None, None)], "page_id long, url string, html string, text string")
    rows = extract_text(df).collect()
    assert [r["text"] for r in rows] == ["\n\n".join(want)] * 2 + [""] and rows[0]["n_chars"] == len("\n\n".join(want)) and extract_text(df.limit(0)).count() == 0


def test_content_lines_outside_the_region_are_kept():
    lead, story = ("lead words " * 20).strip(), ("story words " * 60).strip()
    assert main_blocks(f"<body><div><p>{lead}</p></div><div><p>{story}</p><p>end</p></div></body>") == [lead, story, "end"]


def test_marked_wrappers_and_headings_stay():
    story = ("story words " * 60).strip()
    body = f"<h2 id='related-work'>Related work</h2><p>{story}</p><div class='sidebar'>see also</div>"
    want = ["Related work", story]
    for start, end in (("<div class='layout with-sidebar'>", "</div>"), ("<div class='no-sidebar has-ads'>", "</div>"), ("<form>", "</form>"), ("<div class='widget'>", "</div>"), ("<form><div id='page-search'><article>", "</article></div></form>")):
        assert main_blocks(f"<body><nav>menu</nav>{start}{body}{end}<div class='ads'>buy</div></body>") == want
    assert main_blocks(f"<body><article><p>{story[:200]}</p></article><div class='comments'><p>{story}</p></div></body>") == [story[:200].strip()]
    assert main_blocks(f"<body><div hidden><p>{story}</p></div><p>shown</p></body>") == ["shown"]


# --- queries and pipeline ---


@needs_data
@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for file in os.listdir(SF):
        db.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    df = q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted(str(tuple(r)) for r in df.select(*columns).collect())
    assert mine == sorted(str(r) for r in db.execute(f"SELECT {', '.join(columns)} FROM ({q.ORACLES[name]})").fetchall()) and mine


@needs_data
def test_pipeline_takes_out_what_it_should(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    labels = {r["doc_id"]: r for r in table(spark, SF, "labels").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["quality"](spark, docs, SF)
    kept = {r["doc_id"] for r in clean.collect()}
    assert clean.columns == docs.columns
    wrong = [i for i, r in labels.items() if i in texts and (r["quality"] == 1) != (i in kept)]
    assert len(wrong) <= 0.05 * len(labels)
    single = {r["doc_id"] for r in stages["near_duplicates"](spark, docs, SF).collect()}
    ids = sorted(texts)
    assert single == {ids[i] for i in set(brute_links([texts[i] for i in ids])[1])}
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    free = {r["doc_id"] for r in stages["decontamination"](spark, docs, SF).collect()}
    assert free == {i for i in ids if not brute_contamination(texts[i], items)[4]}
    last = corpus_pipeline.run(spark, SF)
    assert 0 < last.count() < len(texts) and set(docs.columns) <= set(last.columns)


def test_html_of_bodies_without_a_wrapper():
    long = "A long paragraph that tells what the article is about, with many words and hardly any tags in it at all. " * 3
    page = f"<body><nav><a>Home</a> <a>About</a></nav><h1>Title</h1><p>{long}</p><h2>Sub</h2><p>Short one.</p><p>{long}</p><footer>imprint</footer></body>"
    assert main_blocks(page) == ["Title", long.strip(), "Sub", "Short one.", long.strip()]
    half = f"<h2>Head</h2><p>{long}</p><p>{long}</p><p>Last.</p>"
    assert main_blocks(f"<body><div>{half}</div><div>{half}</div></body>") == ["Head", long.strip(), long.strip(), "Last."] * 2


def test_html_tag_soup_never_fails():
    assert main_blocks("<![foo[ text ]]><p>b</p>") == ["b"]
    assert main_blocks("<p>a</p><![if x") == ["a"]
    draw = random.Random(8)
    parts = ["<![CDATA[", "]]>", "<!", "<!--", "-->", "<![if !IE]>", "<![endif]>", "<?php", "?>", "<!DOCTYPE", "<p", "<p>", "</p>", "</", "<div class=\"x", ">", "&#xD800;", "&#99999999;",
             "&amp", "<script>", "</script>", "<td><tr><li>", "text ", "\x00", "\u2028", "[", "]", "<![", "<![a[", "<a href='", "'", "\"", "<svg/>", "</body></html>", "=", "/"]
    for _ in range(3000):
        blocks = main_blocks("".join(draw.choices(parts, k=draw.randint(1, 30))))
        assert all(b and b == " ".join(b.split()) for b in blocks)
