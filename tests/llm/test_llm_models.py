"""Language identification, the compression classifier and the field for main text."""

from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pytest
from llm_cases import DOCS, odd_documents, sentence

from reviewatlas.llm import compression, extract, langid, queries

SF = "/root/testdata/sf0.01"


def test_languages_of_documents_never_learned_from(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op8_language(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


@pytest.fixture(scope="module")
def small_model(spark):
    rows = [("the cat and the dog", "en", 1), ("le chat et le chien", "fr", 2), ("the house", "en", 3), (None, "en", 4), ("x", None, 5)]
    return langid.fit(spark.createDataFrame(rows, "text string, lang string, key long"))


def test_known_words_count_by_their_frequency(small_model):
    m = small_model
    assert m.languages == ["en", "fr"] and m.words["the"] in range(len(m.scores))
    n, v = 7, len(m.words)
    want = np.log((np.array([3, 0]) + langid.SMOOTHING) / (np.array([n, 5]) + langid.SMOOTHING * v))
    assert np.allclose(m.scores[m.words["the"]], want)
    assert langid.Scorer(m).predict("The THE cat!")[0] == "en" and langid.Scorer(m).predict("le chien 42")[0] == "fr"


def test_unseen_words_fall_back_to_shorter_grams(small_model):
    s = langid.Scorer(small_model)
    grams = {r: g for g, r in small_model.grams.items()}
    assert {grams[r] for r in s.backoff("chiens")} == {"_chi", "chie", "hien"}
    assert {grams[r] for r in s.backoff("zzle")} == {"le_"}
    assert {grams[r] for r in s.backoff("zzt")} == {"t_"}
    assert {grams[r] for r in s.backoff("qk")} == {"_"} and s.backoff("") != ()
    assert s.predict("chiens")[0] == "fr"


def test_language_of_odd_texts(spark, frame, small_model):
    got = [(r.doc_id, r.lang_pred) for r in langid.predict(frame([*odd_documents(random.Random(1)), (20, "123 ... 🙂", None, None, 1)], DOCS), small_model).collect()]
    assert {d: p for d, p in got if d in (1, 2, 3, 20)} == {1: "und", 2: "und", 3: "und", 20: "und"}
    assert len(got) == 11 and all(p in ("en", "fr", "und") for _, p in got)
    nothing = langid.fit(frame([], "text string, lang string, key long"))
    assert [(r.lang_pred, r.score) for r in langid.predict(frame([(1, "word", 5)], "doc_id long, text string, score long"), nothing).collect()] == [("und", 0.0)]
    assert langid.predict(frame([], DOCS), small_model).count() == 0


def test_quality_of_documents_never_learned_from(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality is not None}
    got = queries.op10_quality_classifier(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    good = [r.predicted for r in held if truth[r.doc_id] == 1]
    assert sum(good) >= 0.93 * len(good)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.9 * len(held)


def test_compression_feature_and_odd_texts(spark, frame):
    rng = random.Random(1)
    text = lambda q: " ".join(rng.choice(("good fine word here" if q else "bad!! ### junk $$$").split()) for _ in range(200))
    docs = frame([(i, text(i % 2)) for i in range(60)] + [(99, None), (98, "x"), (97, "y"), (None, "z")], "doc_id long, text string")
    labels = frame([(i, i % 2) for i in range(60)] + [(99, 1), (98, None), (97, 7), (500, 1), (None, 0)], "doc_id long, quality int")
    model = compression.fit(docs, labels)
    feature = model.feature()
    assert feature(b"") == 0 and feature(text(1).encode()) > 0 > feature(text(0).encode())
    rows = [*odd_documents(rng), (50, text(1), "", "", 0), (51, text(0), "", "", 0)]
    got = {r.doc_id: r.score for r in compression.score(frame(rows, DOCS), model).collect()}
    assert got[50] > 0.5 > got[51] and got[1] == got[2] and all(0 <= s <= 1 for s in got.values())
    empty = compression.fit(docs, frame([], "doc_id long, quality int"))
    assert [r.score for r in compression.score(frame([(1, "word", 5)], "doc_id long, text string, score long"), empty).collect()] == [0.5]
    assert compression.score(frame([], DOCS), model).count() == 0


def test_logistic_separates():
    x = np.array([-2.0, -1, -0.5, 0.5, 1, 2])
    slope, offset = compression.logistic(x, (x > 0).astype(int))
    assert slope > 0 and abs(offset) < 1e-6
    assert compression.logistic(x, np.ones(6)) == (0.0, 0.0)


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(1)
    for n in range(1, 8):
        model, unary = extract.Field({}, rng.normal(size=(2, 2)), rng.normal(size=2)), rng.normal(size=n).tolist()
        weight = lambda p: model.first[p[0]] + sum(u for u, y in zip(unary, p) if y) + sum(model.steps[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        assert extract.viterbi(unary, model) == list(max(itertools.product((0, 1), repeat=n), key=weight))
    assert extract.viterbi([], extract.Field()) == []


def test_blocks_of_broken_markup():
    page = """<!doctype html><title>no</title><script>var x = "</p>";</script><body><!-- <p>no --><nav><ul><li>a<li>b</ul></nav>
      <article class="Post main"><p>one &amp; <b>two<br>three</b>&nbsp;four<p>five <a href='>'>six</a></article><p>se&eacute;ven"""
    found = extract.blocks(page)
    assert [b.text for b in found] == ["a", "b", "one & two three four", "five six", "seéven"]
    assert {"in:article", "is:post", "is:main"} <= found[2].above.all() and found[3].linked == 3 and "in:article" not in found[4].above.all()
    assert extract.blocks(None) == [] and extract.blocks("<p") != None and extract.blocks("<" * 1000 + "a") != None  # noqa: E711
    assert len(extract.blocks("<div>" * 5000 + "x" + "</div>" * 5000)) == 1


ARTICLE = ["A headline of it", "The first paragraph has some words, and ends here.", "Another one follows it, with more to say about that."]
LAYOUT = """<html><head><title>t</title><style>p{}</style></head><body><header><ul class="menu"><li><a href="/">Home</a></li><li><a href="/b">News of it</a></li></ul></header>
<div class="cookie-notice"><p>We use cookies here. Accept them.</p></div><article><h1>%s</h1><p>%s</p><div class="advert">Buy this now</div><p>%s</p></article>
<aside class="sidebar"><p>More stories for you</p></aside><form><p>Subscribe to the letter</p><input></form>
<section class="comments"><div class="comment"><p>I think that this is right.</p></div></section><footer>&copy; 2024 some one</footer></body></html>"""


@pytest.fixture(scope="module")
def model(spark):
    return extract.fit(spark.read.parquet(f"{SF}/pages.parquet"))


def test_an_unseen_layout(model):
    assert extract.Extractor(model).text(LAYOUT % tuple(ARTICLE)) == "\n\n".join(ARTICLE)


def test_pages_give_their_article_blocks(spark, model):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in extract.main_text(spark.read.parquet(f"{SF}/pages.parquet"), model).collect()}
    want = {r.page_id: "\n\n".join(b.text for b in extract.own_labels(extract.blocks(r.html)) if b.label) for r in rows}
    same = sum(got[i].text == t for i, t in want.items())
    assert same >= 0.99 * len(want) and all(r.n_chars == len(r.text) for r in got.values())


def test_odd_pages_and_an_empty_table(spark, frame, model):
    rows = [(1, "u", None, 3), (2, None, "", 3), (None, "u", "<p>", 3), (4, "u", LAYOUT % tuple(ARTICLE), 3), (4, "u", LAYOUT % tuple(ARTICLE), 3), (5, "u", "<article>" + "<p>word and word again.</p>" * 20_000, 3)]
    got = extract.main_text(frame(rows, "page_id int, url string, html string, text long"), model).collect()
    assert {(r.page_id, r.n_chars) for r in got if r.page_id in (1, 2, None)} == {(1, 0), (2, 0), (None, 0)}
    assert len(got) == 6 and next(r.n_chars for r in got if r.page_id == 5) >= 20_000 * 20
    assert extract.main_text(frame([], "page_id long, url string, html string"), model).count() == 0
    assert extract.Extractor(extract.fit(frame([], "page_id long, html string"))).text("<p>x") == ""


def test_words_with_combining_marks_are_looked_up(spark):
    texts = [("नमस्ते दुनिया नमस्ते", "hi", 1), ("สวัสดี ชาวโลก", "th", 2), ("café déjà", "fr", 3)]
    model = langid.fit(spark.createDataFrame(texts, "text string, lang string, key long"))
    assert {"नमस्ते", "สวัสดี", "café"} <= set(model.words)
    scorer = langid.Scorer(model)
    for text, lang, _ in texts:
        assert all(w in model.words for w in langid.LETTERS.findall(text.lower())) and scorer.predict(text)[0] == lang
    assert scorer.predict("́̀ 123") == ("und", 0.0)


def plain_chances(train: list[tuple[str, int]], test: list[str]) -> list[float]:
    """The share of label 1 and the model, with compressors made anew for every piece."""
    import zstandard

    model = compression.Model(*(compression.dictionary([t.encode() for t, q in train if q == k][: int(sum(q == k for _, q in train) * 2 / 3)]) for k in (1, 0)), 0.0, 0.0)

    def feature(text: str) -> float:
        data = text.encode()
        sizes = [sum(len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d)).compress(data[i : i + 1024])) for i in range(0, len(data), 1024)) for d in (model.bad, model.good)]
        return (sizes[0] - sizes[1]) / len(data)

    return [feature(t) for t in test]


def test_the_difference_against_two_plain_compressors():
    rng = random.Random(12)
    good, bad = [sentence(rng, 60, 300) for _ in range(60)], [" ".join(f"z{rng.randrange(200)}!" for _ in range(60)) for _ in range(60)]
    train = [(t, 1) for t in good] + [(t, 0) for t in bad]
    test = [sentence(rng, n, 300) for n in (1, 40, 700)] + [bad[0][:300]]
    model = compression.Model(compression.dictionary([t.encode() for t in good[:40]]), compression.dictionary([t.encode() for t in bad[:40]]), 0.0, 0.0)
    assert [model.feature()(t.encode()) for t in test] == plain_chances(train, test)
    assert model.feature()(b"") == 0.0


def test_scores_are_chances(spark):
    """Held-out rows, by tenths of the score: the share of label 1 is near the mean score."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    from reviewatlas.llm import queries

    got = queries.op10_quality_classifier(spark, "/root/testdata/sf0.1").where("held_out").join(labels, "doc_id").select("score", "quality").collect()
    bins = {}
    for r in got:
        bins.setdefault(min(9, int(r["score"] * 10)), []).append(r)
    for rows in bins.values():
        if len(rows) >= 50:
            assert abs(sum(r["quality"] for r in rows) / len(rows) - sum(r["score"] for r in rows) / len(rows)) <= 0.1
    assert docs.count() == 10_000


def test_repeated_ids_are_learned_once(spark, frame):
    rng = random.Random(13)
    docs = [(i, sentence(rng, 50)) for i in range(40)] * 3 + [(i, "other " * 30) for i in range(40)]
    labels = [(i, i % 2) for i in range(40)] + [(None, 1)]
    model = compression.fit(frame(docs, "doc_id long, text string").repartition(5), frame(labels, "doc_id long, quality int"))
    again = compression.fit(frame(docs[::-1], "doc_id long, text string").repartition(2), frame(labels, "doc_id long, quality int"))
    assert model == again


def grown(rng: random.Random, depth: int = 0) -> tuple:
    """A random element: (name, attribute words, children); text leaves are strings."""
    name = rng.choice(["div", "section", "article", "b", "a", "span", "ul", "p"] if depth < 5 else ["b", "a", "span"])
    words = rng.sample(["post", "ad", "menu", "main", "x"], rng.randrange(3))
    inline = name in ("b", "a", "span", "p")
    children = [rng.choice(["one two", " three ", "four &amp; five", ""]) if depth > 4 or rng.random() < 0.4 else grown(rng, max(depth + 1, 5 if inline else 0)) for _ in range(rng.randrange(5))]
    return name, words, children


def written_out(node) -> str:
    if isinstance(node, str):
        return node
    name, words, children = node
    names = f" class='{' '.join(words)}'" if words else ""
    return f"<{name}{names} title=\"a > b\">" + "".join(map(written_out, children)) + f"</{name}>"


def walked(node, around=(), linked=False, out=None) -> list[list]:
    """A plain walk over the tree: pieces of text between the edges of block elements, with all ancestors' names."""
    out = [] if out is None else out
    if isinstance(node, str):
        out.append([node, set().union(*around) if around else set(), linked])
        return out
    name, words, children = node
    block = name in extract.BLOCK
    own = {f"is:{w}" for w in words} | ({f"in:{name}"} if block else set())
    if block:
        out.append(None)
    for child in children:
        walked(child, (*around, own), linked or name == "a", out)
    if block:
        out.append(("end", around))
    return out


def plain_blocks(tree) -> list[tuple]:
    blocks, run = [], []
    for piece in [*walked(tree), None]:
        if isinstance(piece, list):
            run.append(piece)
            continue
        text = " ".join("".join(p[0] for p in run).replace("&amp;", "&").split())
        if text:
            blocks.append((text, sum(len(p[0]) for p in run if p[2])))
        run = []
    return blocks


def test_blocks_against_a_plain_tree_walk():
    rng = random.Random(15)
    seen = 0
    for _ in range(400):
        tree = ("div", [], [grown(rng) for _ in range(4)])
        got = extract.blocks(written_out(tree))
        assert [(b.text, b.linked) for b in got] == plain_blocks(tree)
        seen += len(got)
    assert seen > 1000
    # the ancestors of a block that stands alone in its element
    page = "<div class='a1 post'><section id=main><div class=post><p>text</p></div></section><b>x</b></div>"
    found = extract.blocks(page)
    assert found[0].above.all() == {"in:div", "in:section", "in:p", "is:a", "is:post", "is:main"} and found[1].above.all() == {"in:div", "is:a", "is:post"}


def test_hostile_pages_end_in_time(model):
    import time

    reader = extract.Extractor(model)
    deep = "".join(f"<div class='n{chr(97 + i % 26) * (1 + i // 26 % 30)}'>t" for i in range(50_000))
    pages = ["<a " * 350_000, "<a '" * 250_000, '<a ">" ' * 170_000, "<svg>" * 200_000, "<a href='" + "x>" * 500_000, "<" * 1_000_000, "<!" * 500_000, deep, "<p>" * 300_000, "</div>" * 170_000, "<b>" * 300_000 + "</b>" * 300_000]
    for page in pages:
        start = time.time()
        reader.text(page)
        assert time.time() - start < 20, page[:20]


def test_end_tags_close_at_any_depth_and_slashes_are_values():
    found = extract.blocks("<article>" + "<div>" * 70 + "in</article><p>after</p><div><a href=http://x.org/>link</a> no</div>")
    assert [("in:article" in b.above.all(), b.linked) for b in found] == [(True, 0), (False, 0), (False, 4)]
    late = "word " * 30 + "©"
    assert "mark:©" in extract.features([extract.Block("x" * 500 + late, extract.Above(), "p", 0)])[0]
