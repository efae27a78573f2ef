"""Line labels, language pieces and page regions against brute force, with odd rows."""

import itertools
import re
import time

import numpy as np
import pytest

from tallyforge.llm import html, langid, quality
from tallyforge.llm.queries import vocabulary

RANKS, PATTERN = vocabulary("byte_bpe_multi_50k.tiktoken")


def slow_counts(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(found[i : i + 3]) for i in range(len(found) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(found),
        "word_chars": sum(map(len, found)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)),
        "n_repeat_words": len(covered),
    }


TEXTS = [None, "", " \n\t", "a", "a b c a b c a b c", "x\nx\n x\nx", "é# *$\x0b|<a>\x1c b\x85c", "a b c d a b c", "日本 語\n" * 3,
         "one two three four\n" * 30, "word " * 3000]


@pytest.mark.parametrize("text", TEXTS)
def test_base_counts(text):
    assert quality.measure(text)[0] == slow_counts(text)


def test_viterbi_finds_the_best_of_all_paths():
    random = np.random.default_rng(0)
    for n in range(1, 8):
        shape = 2, len(quality.FEATURES)
        model = quality.LineModel(random.normal(size=shape), random.normal(size=(2, 2)), random.normal(size=2))
        x = random.normal(size=(n, shape[1]))
        emit = x @ model.emit.T

        def score(path):
            total = model.start[path[0]] + sum(emit[i, s] for i, s in enumerate(path))
            return total + sum(model.step[a, b] for a, b in itertools.pairwise(path))

        best = max(itertools.product((0, 1), repeat=n), key=score)
        assert tuple(model.decode(x)) == best


def test_fit_separates_labelled_lines():
    random = np.random.default_rng(1)
    label = (random.random((200, 6)) < 0.5).astype(int)
    chains = [np.column_stack([np.ones(6), 1.0 - y, *random.random((7, 6))]) for y in label]
    model = quality.fit(chains, list(label))
    assert np.mean([model.decode(c) == y for c, y in zip(chains, label)]) > 0.99


def test_verdicts_of_labelled_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = quality.quality_rules(docs, quality.train(docs, labels)).join(labels, "doc_id").toPandas()
    fair = found[~found.base_failed]
    assert (fair.kept == (fair.quality == 1)).mean() > 0.98
    assert fair[fair.quality == 1].kept.mean() > 0.99
    assert not found[found.base_failed].kept.any()


def test_quality_of_odd_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    model = quality.train(docs([(1, "a")]), none)
    frame = docs([(1, None), (1, ""), (None, "w%d " * 60), (2, " ".join(map(str, range(80))))])
    clash = frame.withColumnsRenamed({"lang": "verdict", "source": "kept"})
    assert sorted((r["n_words"], r["kept"]) for r in quality.quality_rules(clash, model).collect()) == [
        (0, False), (0, False), (60, False), (80, True)
    ]
    kept = quality.keep_good(clash, model)
    assert kept.columns == clash.columns and [r["doc_id"] for r in kept.collect()] == [2]
    assert quality.quality_rules(docs([]), model).collect() == []


def all_segmentations(word, chance):
    if not word:
        return 1.0
    return sum(chance.get(word[:i], 0.0) * all_segmentations(word[i:], chance) for i in range(1, len(word) + 1))


def small_model():
    import base64

    vocabulary = [bytes([i]) for i in range(256)] + [b" a", b"ab", b"abc", b"bc", b" ab", b"ca"]
    ranks = b"\n".join(base64.b64encode(p) + b" %d" % i for i, p in enumerate(vocabulary))
    pieces = langid.Pieces(ranks)
    chance = np.random.default_rng(2).dirichlet(np.ones(pieces.size), size=3).T
    return vocabulary, pieces, langid.Model(["x", "y", "z"], np.ones(3) / 3, chance)


def test_forward_sums_over_all_segmentations():
    vocabulary, pieces, model = small_model()
    for word in ("a", "abc", "abcabca", "cab", "zab", "é"):
        for lang in range(3):
            chance = dict(zip(vocabulary, model.chance[:, lang]))
            expected = np.log(all_segmentations(b" " + word.encode(), chance))
            assert np.isclose(model.log_likelihood(pieces, [word])[0, lang], expected)


def test_expected_pieces_match_enumeration():
    vocabulary, pieces, model = small_model()
    expected = langid.expected_pieces(pieces, model.chance, ["abc"], np.array([1]), np.array([2.0]))[:, 1]
    chance = dict(zip(vocabulary, model.chance[:, 1]))
    total, counts = 0.0, np.zeros(pieces.size)

    def walk(rest, used, p):
        nonlocal total
        if not rest:
            total += p
            for piece in used:
                counts[vocabulary.index(piece)] += p
        for i in range(1, len(rest) + 1):
            if rest[:i] in chance:
                walk(rest[i:], [*used, rest[:i]], p * chance[rest[:i]])

    walk(b" abc", [], 1.0)
    assert np.allclose(expected, 2 * counts / total)


def slow_log_chance(text, chance):
    """log of the sum over all segmentations, position by position in logarithms."""
    alpha = [0.0]
    for end in range(1, len(text) + 1):
        ways = [alpha[start] + np.log(chance[text[start:end]]) for start in range(max(0, end - 4), end) if chance.get(text[start:end])]
        alpha.append(np.logaddexp.reduce(ways))
    return alpha[-1]


def test_long_and_rare_words_keep_their_likelihood():
    """Runs of any length, and chances so small that a plain product of a few of them would vanish."""
    vocabulary, pieces, model = small_model()
    rare = langid.Model(model.languages, model.prior, model.chance * 1e-30)
    for word in ("a" * 200, "abcab" * 300, "é" * 100, "日" * 40, "zq" * 5_000):
        for own in (model, rare):
            found = own.log_likelihood(pieces, [word])[0]
            expected = [slow_log_chance(b" " + word.encode(), dict(zip(vocabulary, c))) for c in own.chance.T]
            assert np.allclose(found, expected, rtol=1e-9) and np.isfinite(found).all()
    counts = langid.expected_pieces(pieces, rare.chance, ["ab" * 400, "a"], np.array([0, 1]), np.array([3.0, 1.0]))
    lengths = np.array([len(p) for p in vocabulary])
    assert np.isfinite(counts).all() and np.allclose((counts * lengths[:, None]).sum(axis=0), [3 * 801, 2, 0])


def test_scores_of_unseen_scripts_are_chances():
    _, pieces, model = small_model()
    tiny = langid.Model(model.languages, model.prior, np.full_like(model.chance, 1e-12))
    scorer = langid.Scorer.__new__(langid.Scorer)
    scorer.model, scorer.pieces = tiny, pieces
    scorer._forget()
    (lang, score), = scorer(["ⴰⵣⵓⵍ" * 500])
    assert lang == "x" and score == pytest.approx(1 / 3)


def test_languages_held_out(spark):
    from tallyforge.llm.queries import language_id

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang", "text")
    found = language_id(spark, "/root/testdata/sf0.001").join(docs, "doc_id").where("held_out").toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.95
    assert found.score.between(0, 1).all()


def test_language_of_odd_rows(docs):
    train = docs([(i, "the cat and the dog") for i in range(5)]).union(
        docs([(9, "le chat et le chien")]).selectExpr("doc_id", "text", "'fr'", "source", "n_chars")
    )
    model = langid.train(train, RANKS)
    frame = docs([(1, None), (1, ""), (None, "12 !?"), (3, "le chat"), (4, "the " * 50_000), (5, "é" * 5000)])
    frame = frame.withColumnRenamed("source", "found_language").withColumnRenamed("lang", "lang_pred_")
    found = langid.identify(frame, model, RANKS, ["doc_id"]).collect()
    assert [(r["doc_id"], r["lang_pred"]) for r in found][:5] == [
        (1, "und"), (1, "und"), (None, "und"), (3, "fr"), (4, "en")
    ]
    assert found[0]["score"] == 0.0
    unlearned = langid.train(docs([]), RANKS)
    assert [r["lang_pred"] for r in langid.identify(docs([(1, "text")]), unlearned, RANKS, ["doc_id"]).collect()] == ["und"]


def slow_region(scores):
    spans = [(sum(scores[i:j]), -i, -j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
    best = max(spans, default=(0, 0, 0))
    return best[0] if best[0] > 0 else 0


def test_best_region_has_the_largest_sum():
    random = np.random.default_rng(4)
    for n in range(12):
        scores = random.integers(-5, 6, n).tolist()
        start, end = html.best_region(scores)
        assert sum(scores[start:end]) == slow_region(scores)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a>Home page of ours</a></li></ul></nav><!-- gone -->
<div class="ad">Buy this thing now, it is very good and cheap</div>
<article><h1>Title &amp; more</h1><p><b>First  part
of it.<br><p>Second &lt;b&gt; p&eacute;r &copy</p><aside>Not this one</aside><p>Third one ends here.
<form>Your name <input value="<p>x"></form><div class="comments"><p>I like it</p></div></article>
<footer>&copy; nobody, all rights</footer></body></html>"""


def test_main_text_without_boilerplate():
    expected = "Title & more\nFirst part of it.\nSecond <b> pér ©\nThird one ends here."
    assert html.main_text(PAGE, html.Weights()) == expected
    assert html.main_text(PAGE.replace("article>", "div>"), html.Weights()) == expected
    assert html.main_text(PAGE.replace("<nav>", "<div>Our slogan</div><nav>"), html.Weights()) == expected


def test_pages_of_the_table_give_their_articles(spark):
    import html as entities

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = html.extract(pages, html.train(pages), ["page_id", "url", "html"]).collect()
    for row in found:
        body = re.search(r"<article>(.*?)</article>", row["html"], re.S)[1]
        blocks = [re.sub(r"<[^>]*>", "", b) for b in re.split(r"</?(?:p|h1|br)\b[^>]*>", body)]
        expected = "\n".join(t for b in blocks if (t := " ".join(entities.unescape(b).split())))
        assert (row["text"], row["n_chars"]) == (expected, len(expected))


def test_odd_pages(spark):
    pages = [None, "", "plain words only", "<p", "<!-- open", "<script>x", "<p>a<p>b</i></b>", "<article></article>",
             "<article>" + "<p>word</p>" * 20_000 + "</article>", "<div " + "a='" * 2000]
    frame = spark.createDataFrame([(1, h) for h in pages], "page_id bigint, html string").selectExpr(
        "page_id", "html", "1 AS text", "2 AS main_text", "3 AS n_chars_"
    )
    weights = html.train(frame)
    texts = [r["text"] for r in html.extract(frame, weights, ["page_id"]).collect()]
    assert texts[:3] == ["", "", "plain words only"] and texts[6] == "a\nb" and texts[7] == ""
    assert texts[8] == "\n".join(["word"] * 20_000)
    assert html.extract(frame.where("false"), weights, ["page_id"]).collect() == []


DROPPED_KINDS = [
    '<div class="ad">Buy</div>', "<aside>Not this</aside>", "<form>Name</form>", '<p class="notice">We use cookies</p>', "<nav>Go</nav>"
]


@pytest.mark.parametrize("gone", DROPPED_KINDS)
@pytest.mark.parametrize("around", ["article", "main", "div"])
def test_short_text_beside_dropped_elements_stays(gone, around):
    long = "word " * 30
    page = f"<body><{around}><h1>Title</h1>{gone}<p>{long}</p>{gone}<p>End.</p></{around}></body>"
    assert html.main_text(page, html.Weights()) == f"Title\n{long.strip()}\nEnd."


def test_weights_leave_dropped_elements_out(spark):
    page = "<body><nav>" + "<p>one two</p>" * 9 + "</nav><article><p>one two</p></article></body>"
    weights = html.train(spark.createDataFrame([(1, page)], "page_id bigint, html string"))
    assert weights.seen["word:p"] > 0.8 and weights.seen["p"] > 0.7


@pytest.mark.parametrize(
    "opened, closed",
    [
        ('<div class="has-sidebar"><main>', "</main></div>"),
        ('<div id="content-sidebar-wrap"><article>', "</article></div>"),
        ('<div class="page header-fixed">', "</div>"),
        ('<form id="whole">', "</form>"),
    ],
)
def test_wrappers_named_in_part_keep_the_page(opened, closed):
    page = f'<body>{opened}<h1>Title</h1><p>Some words of the page are here.</p><div class="ad">Buy</div>{closed}</body>'
    assert html.main_text(page, html.Weights()) == "Title\nSome words of the page are here."


def test_header_of_an_entry_keeps_its_heading():
    page = '<article><header class="entry-header"><h1>Title</h1></header><p>Words of the text.</p></article>'
    assert html.main_text(page, html.Weights()) == "Title\nWords of the text."


def test_rare_languages_are_learnt(docs, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 1)
    train = docs([(i, "the cat and the dog") for i in range(40)]).union(
        docs([(99, "le chat et le chien")]).selectExpr("doc_id", "text", "'fr'", "source", "n_chars")
    )
    model = langid.train(train, RANKS)
    assert model.languages == ["en", "fr"] and np.allclose(model.prior, [40 / 41, 1 / 41])
    found = langid.identify(docs([(1, "le chat et le chien")]), model, RANKS, ["doc_id"]).first()
    assert found["lang_pred"] == "fr"


def test_sample_of_a_hot_copy_is_bounded(docs, monkeypatch):
    """Rows that repeat one document do not fill the sample, nor does a rare language lose its place."""
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 20)
    monkeypatch.setattr(langid, "LEAST_DOCS", 5)
    rows = [(7, "the same text again")] * 400 + [(i, f"plain words number {i}") for i in range(100, 160)] + [(1, "les mots")]
    frame = docs(rows).selectExpr("doc_id", "text", "IF(doc_id = 1, 'fr', IF(doc_id IS NULL, NULL, 'en')) AS lang")
    model = langid.train(frame, vocabulary("byte_bpe_multi_50k.tiktoken")[0])
    assert model.languages == ["en", "fr"] and model.prior[1] == pytest.approx(1 / len(rows))
    found = langid.identify(frame, model, vocabulary("byte_bpe_multi_50k.tiktoken")[0], ["doc_id"]).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)


def test_chains_come_from_the_whole_text():
    """A footer at the end of a long document is chosen as often as its start."""
    hits = 0
    for n in range(200):
        text = "\n".join([f"line {n} of the text"] * 640 + ["### footer ###"] * 64)
        rows = quality._chosen_chains(text)
        whole = quality.measure(text)[1]
        assert len(rows) == 64
        hits += any(np.array_equal(rows[k : k + 32], whole[-32:]) for k in (0, 32))
    assert 5 < hits < 60
    assert len(quality._chosen_chains("")) == 0 and len(quality._chosen_chains("one\ntwo")) == len(quality.measure("one\ntwo")[1])


@pytest.mark.parametrize("page", ["<div>" * 90_000 + "</b>" * 90_000, "<b>" * 100_000 + "</i>x" * 100_000, "<p><li>" * 100_000])
def test_open_elements_cost_linear_time(page):
    started = time.perf_counter()
    html.main_text(page, html.Weights())
    assert time.perf_counter() - started < 30
