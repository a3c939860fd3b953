"""Extraction, decontamination, toxicity, chat windows, licenses and pseudonyms: accuracy, round trips, awkward rows."""

import hashlib
import html
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import chat_format, decontaminate, html_extract, license_scan, pii, toxicity
from quern.llm._common import table

SF = "/root/testdata/sf0.01"


# --- html


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<html><body></body></html>", ""), ("<p>just text", "just text"),
        ("<nav><a href=/>Home</a></nav><article><h1>T &amp; U</h1><p>One\n two&nbsp;three.<br>four<p>Five <b>six</b>.</article><footer>&copy; 2020</footer>", "T & U\nOne two three. four\nFive six."),
        ("<div class='sidebar'>Links and more links to read</div><div id=content><p>Real words stand here in a row.</p><aside>No</aside><p>And here too.</p></div><div class=comments><p>I liked it a lot, thanks for it.</p></div>", "Real words stand here in a row.\nAnd here too."),
        ("<article><p>Before.</p><div class=\"ad\">Buy now</div><form><input><label>Mail</label></form><script>var p='<p>x</p>'</script><style>p{}</style><!-- <p>no</p> --><p>After all of it.</p></article>", "Before.\nAfter all of it."),
        ("<main><ul><li>One item<li>Two items</ul><table><tr><td>a cell<td>b cell</table></main>", "One item\nTwo items\na cell\nb cell"),
        ("<article><header><h1>Title</h1></header><p>Body text of it.</p></article>", "Title\nBody text of it."),
        ('<article><p class="a"">He said "hello there friend" and then left.</p><p><a href=/it\'s>link words</a> and it\'s gone now.</p></article>', 'He said "hello there friend" and then left.\nlink words and it\'s gone now.'),
        ('<article><p class="related-work">Related work of others.</p><p id="share-prices">Share prices rose.</p><div class="content comment-free">Free of them.</div><fieldset>A set.</fieldset><noscript>No script.</noscript></article>', "Related work of others.\nShare prices rose.\nFree of them.\nA set.\nNo script."),
        ("<article><!--><p>One of them.</p><!-- no --><p>Two of them.</p><!--- x --!><p>Three.</p></article>", "One of them.\nTwo of them.\nThree."),
        ('<div class="content has-sidebar"><article><p>Words of it stand here.</p></article></div><div id="post-with-comments"><p>not in it</p></div>', "Words of it stand here."),
        ("<h1>A title of five words</h1><p>The first part of this page goes on for some words and ends.</p><ul>" + "<li><a href=/x>Menu item</a></li>" * 12 + "</ul><p>The second part of this page also goes on for some words and ends.</p>", "A title of five words\nThe first part of this page goes on for some words and ends.\nThe second part of this page also goes on for some words and ends."),
        ("<article><h1>Short</h1><div class='ad-box'>Buy this very good thing now and get one more of it.</div><p>Then the text goes on.</p><section class=commentList><p>I think that it is all wrong and I say so.</p></section></article>", "Short\nThen the text goes on."),
        ("<article title='a > b'><p data-x=\"<p>no</p>\">a &lt;b&gt; &amp; c&#233;</p></article><article class='comment-body'><p>Not mine.</p></article>", "a <b> & c\u00e9"),
        ("<div role=navigation><p>Go to other pages of this site</p></div><div><p>\u4eca\u65e5\u306f\u5929\u6c17\u304c\u3044\u3044\u304b\u3089\u6563\u6b69\u3057\u307e\u3057\u3087\u3046\u3002</p></div><div hidden>Secret words of it</div>", "\u4eca\u65e5\u306f\u5929\u6c17\u304c\u3044\u3044\u304b\u3089\u6563\u6b69\u3057\u307e\u3057\u3087\u3046\u3002"),
    ],
)
def test_main_text(page, text):
    assert html_extract.main_text(page) == text


def test_pages_with_articles(spark):
    """Brute force: the blocks of the one <article>, where a page has no other content."""
    got = {r["page_id"]: r for r in html_extract.op1_html_extract(spark, SF).collect()}
    for r in table(spark, SF, "pages").collect():
        inner = re.search(r"(?s)<article>(.*?)</article>", r["html"])[1]
        blocks = html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1)>", "\0", inner))).split("\0")
        want = "\n".join(" ".join(b.split()) for b in blocks if b.strip())
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"], got[r["page_id"]]["url"]) == (want, len(want), r["url"])


def test_region_is_the_best_run():
    rng = random.Random(5)
    for n in range(40):
        x = [rng.choice([-3.0, -1.0, 0.0, 1.0, 2.0]) for _ in range(n)]
        lo, hi = html_extract.best_run(x)
        sums = [sum(x[i:j]) for i in range(n) for j in range(i + 1, n + 1)]
        assert sum(x[lo:hi]) == max([0.0, *sums])


def test_labelled_pages_by_layouts_that_were_held_out(monkeypatch):
    """Weights from the other layouts; words of the content found, and words found that are content."""
    want = lambda c: "\n".join(t for b in html_extract.Page(f"<article>{c}</article>").blocks if (t := b.text()))
    layouts, hit, of, got_n = html_extract.LAYOUTS, 0, 0, 0
    for k, held in enumerate(layouts):
        monkeypatch.setattr(html_extract, "LAYOUTS", layouts[:k] + layouts[k + 1 :])
        html_extract.weights.cache_clear()
        html_extract.weights()
        monkeypatch.setattr(html_extract, "LAYOUTS", (held,))
        for before, content, after in html_extract.labelled_pages():
            a, b = html_extract.main_text(before + content + after).split(), want(content).split()
            hit, of, got_n = hit + sum((Counter(a) & Counter(b)).values()), of + len(b), got_n + len(a)
    html_extract.weights.cache_clear()
    assert hit / of >= 0.9 and hit / got_n >= 0.9


def test_time_is_linear_in_depth():
    import time

    def seconds(n):
        page = "<article><b><li>" + "<div><i>" * n + "word " * 10 + "</b></u>" * n
        began = time.process_time()
        html_extract.main_text(page)
        return time.process_time() - began

    seconds(1000)
    assert seconds(40_000) < 40 * max(seconds(4_000), 0.01)


def test_pages_awkward(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<p>" + "word " * 200000, "x"), (1, None, None, "x"), (4, "u", "<" * 5000 + "a href='" * 500, "x")], "page_id long, url string, html string, text string")
    out = html_extract.extract_main_text(df).collect()
    assert sorted(r["n_chars"] for r in out)[:2] == [0, 0] and max(r["n_chars"] for r in out) >= 5 * 200000 - 1 and len(out) == 4
    assert html_extract.extract_main_text(df.filter("false")).count() == 0


# --- decontamination


def benchmark_words(seed, n):
    rng = random.Random(seed)
    return [rng.choice([f"w{k}" for k in range(500)]) for _ in range(n)]


def plain_alignment(item, words):
    """Smith-Waterman cell by cell: the best score."""
    h = [[0] * (len(words) + 1) for _ in range(len(item) + 1)]
    for i, x in enumerate(item, 1):
        for j, y in enumerate(words, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_is_smith_waterman():
    rng = random.Random(7)
    for _ in range(150):
        item, words = (np.array([rng.randrange(6) for _ in range(rng.randint(1, 14))]) for _ in range(2))
        score, matched, columns, lo, hi = decontaminate.align(item, words)
        assert score == plain_alignment(item.tolist(), words.tolist()) and score <= 2 * matched - (columns - matched) and 0 <= lo <= hi <= len(words)
        if score:
            assert plain_alignment(item.tolist(), words[lo:hi].tolist()) == score
            assert decontaminate.banded(item, words, -len(item), len(words)) == (score, matched, columns, lo, hi)
            assert decontaminate.banded(item, words, -2, 3)[0] <= score


def brute_contaminated(doc, item):
    """The best Smith-Waterman alignment over the whole document."""
    w, d = decontaminate.word_numbers(item), decontaminate.word_numbers(doc)
    if not len(w) or not len(d):
        return False
    _, matched, columns, _, _ = decontaminate.align(w, d)
    return matched >= max(0.6 * len(w), min(4, len(w))) and matched >= 0.6 * columns


def seeded(doc, item):
    """Whether they share a seed, which the method needs to look at a pair at all."""
    w, d = decontaminate.words_of(item), decontaminate.words_of(doc)
    n = min(decontaminate.SEED, max(len(w), 1))
    runs = lambda x: {tuple(x[k : k + n]) for k in range(len(x) - n + 1)}
    return bool(runs(w) & runs(d))


def test_recall_against_alignment_without_seeds(spark):
    """Copies with up to three words in ten edited, against Smith-Waterman over whole documents."""
    rng = random.Random(21)
    items = [(k, " ".join(benchmark_words(50 + k, rng.randint(6, 40)))) for k in range(40)]
    docs = []
    for k in range(200):
        copy = decontaminate.words_of(items[k % 40][1])
        for at in range(len(copy)):
            if rng.random() < rng.choice([0.1, 0.2, 0.3]):
                copy[at] = rng.choice(["", "new", "two words", copy[at - 1]])
        docs.append((k, " ".join(benchmark_words(900 + k, 30) + copy + benchmark_words(5000 + k, 30))))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(i, j) for i, t in docs for j, u in items if brute_contaminated(t, u)}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 150


def test_every_copy_has_a_row(monkeypatch, spark):
    item = "alpha beta gamma delta epsilon zeta"
    docs = [(1, " ".join([item] * 5)), (2, f"{item} x y {item} {item.replace('gamma', 'other')}"), (3, f"alpha beta gamma {'z ' * 30} {item}")]
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    spans = {}
    for r in decontaminate.contaminated(df, bench).collect():
        spans.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    want = {1: [(6 * k, 6 * k + 6) for k in range(5)], 2: [(0, 6), (8, 14), (14, 20)], 3: [(33, 39)]}
    assert {k: sorted(v) for k, v in spans.items()} == want
    long = " ".join(f"w{k}" for k in range(3000))  # aligned in bands
    monkeypatch.setattr(decontaminate, "BROADCAST_IDS", 0)
    got = decontaminate.contaminated(spark.createDataFrame([(1, "x " * 900 + long.replace("w77 ", "") + " y" * 900)], "doc_id long, text string"), spark.createDataFrame([(1, long), (2, item)], "item_id long, text string")).collect()
    assert [(r["item_id"], r["matched"], r["start"], r["end"]) for r in got] == [(1, 2999, 900, 3899)]


def test_contaminated_is_brute_force(spark):
    rng = random.Random(4)
    items = [(k, " ".join(benchmark_words(k, rng.randint(2, 40)))) for k in range(12)] + [(12, None), (13, ""), (14, "Un deux")]
    docs = []
    for k in range(60):
        words = benchmark_words(1000 + k, rng.randint(0, 300))
        if k % 2:
            copy = decontaminate.words_of(items[k % 12][1])
            for _ in range(rng.randint(0, max(1, len(copy) // 6))):  # edits
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[], ["new"], ["new", "words"], [copy[at]]])
            at = rng.randint(0, len(words))
            words[at:at] = copy
        docs.append((k, " ".join(words).title() if k % 3 == 0 else "; ".join(words), "x", 1))
    docs += [(None, items[0][1], "x", 1), (None, items[0][1], "x", 1), (70, None, "x", 1), (71, "", "x", 1), (72, "un, DEUX", "x", 1)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string, item string, seeds int"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench).collect()}
    want = {(i, j) for i, t, _, _ in docs for j, u in items if seeded(t, u) and brute_contaminated(t or "", u or "")}
    more = {(i, j) for i, t, _, _ in docs for j, u in items if brute_contaminated(t or "", u or "")}  # also a copy beside a better alignment
    assert want <= got and (72, 14) in got and len(got - more) <= 2
    kept = {r["doc_id"] for r in decontaminate.drop_contaminated(df, bench).collect()}
    assert kept == {None} | {i for i, *_ in docs if i is not None} - {i for i, _ in got}
    assert decontaminate.contaminated(df, bench.filter("false")).count() == 0 and decontaminate.contaminated(df.filter("false"), bench).count() == 0


def test_seed_in_very_many_documents(spark):
    """A passage that all documents copy is found although all its seeds are common."""
    item = " ".join(benchmark_words(9, 20))
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("start "), F.lit(item), F.lit(" end")).alias("text"))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert decontaminate.contaminated(df, bench).count() == 3000


def test_edited_copy_of_a_common_item(spark):
    """A copy with one unedited run of four words is found whatever other documents hold."""
    words = "a b c d e f g h i j".split()
    edited = [*words[:4], "x", *words[5:8], "y", words[9]]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "k l m n o")], "item_id long, text string")
    edits = [(0, " ".join(edited)), (1, "k l m n z"), (2, "a b c d and nothing more")]
    copies = [(k, " ".join(words) + " k l m n o") for k in range(10, 40)]
    for docs in (edits, edits + copies):
        df = spark.createDataFrame(docs, "doc_id long, text string")
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench).filter("doc_id < 10").collect()}
        assert got == {(0, 1), (1, 2)}


# --- toxicity


def test_toxicity_on_held_out_labels(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    half = labels.filter("pmod(hash(doc_id), 2) = 0")
    got = toxicity.classify(docs, toxicity.train(docs, half)).join(labels.filter("pmod(hash(doc_id), 2) = 1"), "doc_id").cache()
    n = {(r["toxic"], r["rejected"]): r["count"] for r in got.groupBy("toxic", "rejected").count().collect()}
    caught, missed, wrong, right = (n.get(k, 0) for k in ((1, True), (1, False), (0, True), (0, False)))
    assert caught / (caught + missed) >= 0.9 and wrong / (wrong + right) < 0.01
    low = {(r["quality"], r["low"]): r["count"] for r in got.groupBy("quality", F.expr("p_low_quality >= 0.5").alias("low")).count().collect()}
    assert low[0, True] / (low[0, True] + low[0, False]) >= 0.9 and low[1, True] / (low[1, True] + low[1, False]) < 0.02


def test_chain_learns_families_of_words():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts, y = [], []
    for k in range(600):
        ws = [word() for _ in range(30)]
        if k % 6 == 0:
            ws += ["zzquux" + word()[:3], "zzquux" + word()[:2], "Zzquux" + word()[:4] + "!!"]
        else:
            ws += [word(), word(), "Zq" + word() + "!!"]
        texts.append(" ".join(ws))
        y.append(int(k % 6 == 0))
    low = np.arange(600) % 4 == 0
    chain = toxicity.fit_chain(rows_of([sorted(toxicity.features(t)) for t in texts]), np.stack([low, y], axis=1), np.arange(600) % 3)
    assert chain.score("so zzquuxhg and zzquuxfa it is")[-1] > 0.5 > chain.score("abcdef is fine")[-1]
    assert len(chain.score("")) == len(toxicity.CATEGORIES) == len(chain.models) and len(chain.models[1].earlier) == 1


def rows_of(words):
    names = sorted({w for ws in words for w in ws})
    return toxicity.Rows(names, np.array([names.index(w) for ws in words for w in ws]), np.array([len(ws) for ws in words]))


def labelled_rows(seed, n=400):
    rng = random.Random(seed)
    words, y = [], []
    for _ in range(n):
        bad, low = rng.random() < 0.3, rng.random() < 0.4
        words.append(sorted({f"w{rng.randrange(60)}" for _ in range(12)} | ({f"t{rng.randrange(6)}"} if bad and rng.random() < 0.9 else set()) | ({f"#q{rng.randrange(4)}"} if low else set())))
        y.append((int(low), int(bad or low and rng.random() < 0.3)))
    return words, np.array(y)


def test_linear_model_is_the_dense_solution():
    """Brute force: the same penalised likelihood by Newton steps with dense matrices."""
    words, y = labelled_rows(1)
    rows, use = rows_of(words), np.arange(len(words)) % 5 > 0
    earlier = np.random.default_rng(0).random((len(words), 1))
    model, p = toxicity.fit_linear(rows, y[:, 1].astype(float), earlier, use)
    names = list(model.words)
    assert all(n[0] != "#" for n in names)
    x = np.column_stack([np.array([[w in set(ws) for w in names] for ws in words], float), earlier, np.ones(len(words))])
    ridge, w = np.append(np.full(x.shape[1] - 1, toxicity.PENALTY), 1e-6), np.zeros(x.shape[1])
    for _ in range(100):
        q = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve((x[use] * (q * (1 - q))[use, None]).T @ x[use] + np.diag(ridge), x[use].T @ (y[:, 1] - q)[use] - ridge * w)
    assert len(names) >= 5 and np.allclose([*model.words.values(), *model.earlier, model.bias], w, atol=1e-3) and np.allclose(p, 1 / (1 + np.exp(-x @ w)), atol=1e-4)


def test_chain_learns_out_of_fold(monkeypatch):
    words, y = labelled_rows(2)
    rows, fold, none = rows_of(words), np.arange(len(words)) % 3, np.zeros((len(words), 0))
    held = toxicity.out_of_fold(rows, y[:, 0].astype(float), none, fold, True)
    for f in range(3):
        turned = np.where(fold == f, 1 - y[:, 0], y[:, 0]).astype(float)  # the fold's own labels don't matter to it
        assert np.array_equal(toxicity.out_of_fold(rows, turned, none, fold, True)[fold == f], held[fold == f])
    chain = toxicity.fit_chain(rows, y, fold)
    brute = toxicity.fit_linear(rows, y[:, 1].astype(float), held[:, None], np.ones(len(words), bool))[0]
    assert chain.models[1] == brute and brute.earlier[0] > 0.5
    for ws in words[:50]:
        first = chain.models[0].probability(set(ws), [])
        z = brute.bias + sum(v for w, v in brute.words.items() if w in ws) + brute.earlier[0] * first
        assert chain.models[1].probability(set(ws), [first]) == pytest.approx(1 / (1 + np.exp(-z)))


def test_toxicity_awkward(spark):
    docs = spark.createDataFrame([(1, "a", 5), (None, None, 5), (2, "", 5), (2, "b " * 100000, 5)], "doc_id long, text string, toxic int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, none)
    assert toxicity.classify(docs, chain).filter("rejected").count() == 0 and toxicity.keep_clean(docs, chain).columns == docs.columns
    nulls = spark.createDataFrame([(1, 0, None), (None, 0, 1), (1, 0, 1), (1, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.classify(docs, toxicity.train(docs, nulls)).count() == 4 and toxicity.classify(docs.filter("false"), chain).count() == 0


# --- chat


def conversation(rng, k):
    roles = (["system"] if k % 3 == 0 else []) + [rng.choice(["user", "assistant"]) for _ in range(rng.randint(0, 12))]
    bits = ["<|im_end|>", "\\", "<|", "\n", "<\\|im_start|>", "word " * 50, "é", "", "<|im_sep|>x", "w " * 3000]
    return [(k, t, r, "".join(rng.choice(bits) for _ in range(rng.randint(0, 4))) if rng.random() > 0.1 else None) for t, r in enumerate(roles)]


def test_chat_round_trip(spark):
    rng = random.Random(3)
    rows = [r for k in range(80) for r in conversation(rng, k)] + [(900, 1, None, "x"), (900, 1, "assistant", "x"), (900, None, "user", "first"), (None, 0, "assistant", "n")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    windows = chat_format.chat_windows(df)
    w = windows.collect()
    turns = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        turns.setdefault(c, []).append((r or "", x or ""))
    got = {r["conv_id"]: r for r in chat_format.digests(windows).collect()}
    assert set(got) == set(turns)
    for c, ts in turns.items():
        said = "".join(x for r, x in ts if r == "assistant")
        assert got[c]["n_turns"] == len(ts) and got[c]["loss_chars"] == len(said)
        assert got[c]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in ts).encode()).hexdigest()
        assert got[c]["formatted_chars"] == sum(len(r["formatted"]) for r in w if r["conv_id"] == c)
    for r in w:
        assert r["formatted"].count(chat_format.START) == r["n_turns"] + r["n_repeated"] == r["formatted"].count("<|im_end|>\n")
        single = r["n_turns"] == 1
        assert single or r["tokens"] <= chat_format.BUDGET
        if r["window"] > 0 and turns[r["conv_id"]][0][0] == "system":
            assert r["formatted"].startswith(chat_format.START + "system")
    assert chat_format.chat_windows(df.filter("false")).count() == 0


# --- licenses


def test_license_spans(spark):
    mit = license_scan.TEMPLATES["MIT"]
    edited = mit.replace("free of charge", "at no charge").replace("NONINFRINGEMENT", "NON INFRINGEMENT")
    texts = ["words before. " + mit + " and after", "x " + edited, "Licensed under CC BY-NC 4.0. Licensed under CC BY 4.0.", "permission is granted", None, "", "İ " + license_scan.TEMPLATES["ISC"]]
    df = spark.createDataFrame([(k, t, "c") for k, t in enumerate(texts)] + [(None, texts[2], "c")], "doc_id long, text string, license string")
    rows = license_scan.scan_licenses(df).collect()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r)
    assert [r["license"] for r in got[0]] == ["MIT"] and texts[0][got[0][0]["start"] : got[0][0]["end"]] == mit.rstrip(".")
    assert got[0][0]["coverage"] == 1 and [r["license"] for r in got[1]] == ["MIT"] and 0.9 < got[1][0]["coverage"] < 1
    assert [r["license"] for r in got[2]] == ["CC-BY-NC-4.0-notice", "CC-BY-4.0-notice"] and len(got[None]) == 2
    assert set(got) == {0, 1, 2, 6, None} and texts[6][got[6][0]["start"] :].startswith("Permission")
    assert license_scan.scan_licenses(df.filter("false")).count() == 0


def test_edited_notices_are_found():
    """Recall against alignment with each whole template: as many words as coverage allows left out or replaced, anywhere."""
    rng, missed, of = random.Random(9), 0, 0
    index = license_scan.Templates(license_scan.TEMPLATES, 0.8)
    for _ in range(40):
        for name, text in license_scan.TEMPLATES.items():
            words = text.split()
            n = len(license_scan.words_of(text))
            spots = rng.sample(range(len(words)), min(len(words), rng.randint(0, n // 5)))
            out = [w if k not in spots else rng.choice(["", "zzz"]) for k, w in enumerate(words)]
            edited = " ".join(["some", "words", *out, "after", "it"])
            w = np.array([index.number.get(x, 0) for x in license_scan.words_of(edited)])
            item = index.coded[index.names.index(name)].astype(np.int64)
            _, matched, _, lo, hi = decontaminate.align(item, w)
            if matched >= 0.8 * n:
                of += 1
                missed += not any(m >= 0.8 * n for _, m, *_ in index.spans(edited))
    assert of > 500 and missed == 0
    assert [r[0] for r in index.spans("Distributed under the MIT License.")] == ["MIT-notice"]
    assert [r[0] for r in index.spans("Licensed under CC BZ 4.0, licensed under the Orange License, Version 2.0")] == ["CC-BY-4.0-notice", "Apache-2.0-notice"]
    for seed in range(5):  # brute force of winnowing
        h = np.random.default_rng(seed).integers(0, 9, 30).astype(np.uint64)
        want = {k + max(i for i, x in enumerate(h[k : k + 4]) if x == min(h[k : k + 4])) for k in range(27)}
        assert set(license_scan.winnow(h, 4).tolist()) == want


# --- pseudonyms


def luhn(d):
    s = 0
    for k, c in enumerate(reversed(d)):
        v = int(c) * (1 + k % 2)
        s += v - 9 * (v > 9)
    return s % 10 == 0


def card(rng):
    d = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(d + c for c in "0123456789" if luhn(d + c))


def test_pseudonyms(spark):
    rng = random.Random(6)
    values = [card(rng) for _ in range(20)] + [f"{rng.randint(1, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}" for _ in range(20)]
    values += [f"+1 ({rng.randint(0, 999):03d}) {rng.randint(0, 999):03d}-{rng.randint(0, 9999):04d}" for _ in range(20)] + [f"a.{k}b@mail{k}.example.com" for k in range(10)]
    values += ["1999-12-31", "2000-02-29", "31.12.1999", "01/02/2003", "123-45-6789", "4111-1111-1111-1111", "4111 1111 1111 1111"]
    decoys = ["1234567812345678", "2001-02-30", "999.1.1.1", "000-12-3456", "plain words", "", None, "12345"]
    rows = [(k, f"See {v}, and {v}!", "keep") for k, v in enumerate(values)] + [(100 + k, d, "keep") for k, d in enumerate(decoys)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _m string")
    out = pii.pseudonymize(df)
    got = {r["doc_id"]: r for r in out.collect()}
    for k, v in enumerate(values):
        found = [f["value"] for f in got[k]["found"]]
        assert len(found) == 2 and found[0] == found[1], v
        new = found[0]
        assert got[k]["text"] == f"See {new}, and {new}!" and got[k]["_m"] == "keep"
        assert re.sub(r"\d", "9", new) == re.sub(r"\d", "9", v) or "@" in v or v.count(".") == 3, (v, new)
        if got[k]["found"][0]["kind"] == "card":
            assert luhn(re.sub(r"\D", "", new)) and new[0] == v[0]
    news = [got[k]["found"][0]["value"] for k in range(len(values) - 2)]
    assert len(set(news)) == len(news) and sum(a == b for a, b in zip(news, values)) <= 1
    assert re.sub(r"\D", "", got[len(values) - 2]["found"][0]["value"]) == re.sub(r"\D", "", got[len(values) - 1]["found"][0]["value"])
    for k, d in enumerate(decoys):
        assert got[100 + k]["text"] == d and got[100 + k]["found"] == []
    back = {r["doc_id"]: r["text"] for r in pii.pseudonymize(out.drop("found"), back=True).collect()}
    assert back == {i: t for i, t, _ in rows}
    assert pii.pseudonymize(df.filter("false")).count() == 0
    assert pii.pseudonymize(df, key="other").filter("doc_id = 0").head()["text"] != got[0]["text"]


def iban_ok(s):
    n = "".join(str(int(c, 36)) for c in s[4:] + s[:4])
    return int(n) % 97 == 1


def test_accounts_phones_abroad_and_letters_of_mail(spark):
    accounts = ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "NO9386011117947", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"]
    phones = ["+44 20 7946 0958", "+4930901820", "+49 (30) 901820-11", "+420 601 123 456"]
    mails = ["Bob.Lee7@Mail.example.com", "bob.lee7@mail.example.com", "BOB.LEE7@mail.example.com"]
    bad = ["DE88370400440532013000", "+44 20", "DE8937040044053201300", "xDE89370400440532013000"]
    rows = list(enumerate(f"pay {v} BANK, {v}" for v in accounts + phones + mails + bad))
    out = pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in out.collect()}
    new = {}
    for k, v in enumerate(accounts + phones + mails):
        kinds = {f["kind"] for f in got[k]["found"]}
        values = [f["value"] for f in got[k]["found"]]
        assert kinds == {"iban" if v in accounts else "abroad" if v in phones else "email"} and len(values) == 2 and values[0] == values[1] != v
        new[v] = values[0]
        shape = lambda x: re.sub(r"\d", "9", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", x)))
        assert shape(new[v]) == shape(v) and got[k]["text"] == f"pay {new[v]} BANK, {new[v]}"
    assert all(iban_ok(new[v].replace(" ", "")) and new[v][:2] == v[:2] for v in accounts) and new[accounts[0]] == new[accounts[1]].replace(" ", "")
    assert new[phones[0]].startswith("+44 ") and new[phones[3]].startswith("+420 ")
    assert new[mails[0]].lower() == new[mails[1]] == new[mails[2]].lower()
    for k, v in enumerate(bad):
        assert got[len(new) + k]["found"] == [] and v in got[len(new) + k]["text"]
    back = {r["doc_id"]: r["text"] for r in pii.pseudonymize(out.drop("found"), back=True).collect()}
    assert back == dict(rows)


def brute_findings(text):
    """Every valid value of a text, by character loops and arithmetic instead of the operator's patterns."""
    import datetime

    out = []
    for word in re.split(r"[^0-9A-Za-z.@_%+/-]+", text):
        w = word.strip(".%+-_/")
        if w.count("@") == 1:
            name, domain = w.split("@")
            labels = domain.split(".")
            if name and len(labels) > 1 and all(labels) and labels[-1].isalpha() and len(labels[-1]) > 1:
                out.append(("email", w))
            continue
        bits = w.split(".")
        if len(bits) == 4 and all(b.isdigit() and str(int(b)) == b and int(b) < 256 for b in bits):
            out.append(("ip", w))
        elif w.isdigit() and 13 <= len(w) <= 19 and w[0] in "23456" and luhn(w) and word[:1] not in "+-":
            out.append(("card", w))
        elif len(w) == 11 and [len(b) for b in w.split("-")] == [3, 2, 4] and w.replace("-", "").isdigit():
            a, b, c = w.split("-")
            if a not in ("000", "666") and a[0] != "9" and b != "00" and c != "0000":
                out.append(("ssn", w))
        elif len(w) == 10:
            for form in ("%Y-%m-%d", "%d.%m.%Y", "%d/%m/%Y"):
                try:
                    if 1900 <= datetime.datetime.strptime(w, form).year <= 2099:
                        out.append(("date", w))
                except ValueError:
                    pass
    for at in range(len(text)):
        if text.startswith("+1 (", at) and len(t := text[at : at + 17]) == 17 and t[4:7].isdigit() and t[7:9] == ") " and t[9:12].isdigit() and t[12] == "-" and t[13:].isdigit() and not text[at + 17 : at + 18].isdigit():
            out.append(("phone", t))
    return sorted(out)


def test_findings_are_those_of_brute_force(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    extra = [(10**9 + k, t) for k, t in enumerate(["ask 8.8.8.8, 1.1.1.1. or 256.1.1.1", "on 2001-02-28; 29.02.2001? 28/02/1999", "123-45-6789 000-45-6789", "a@b.co a.b+c@d-e.org @x.org y@", "4111111111111111 4111111111111112 378282246310005"])]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    back = pii.pseudonymize(docs).select("doc_id", F.transform("found", lambda x: F.array(x["kind"], pii.pseudonym(x["value"], F.lit(pii.DEMO_KEY), True)["value"])).alias("f"))
    got = {r["doc_id"]: sorted(map(tuple, r["f"])) for r in back.collect()}
    assert sum(map(len, got.values())) > 90
    assert got == {i: brute_findings(t) for i, t in text.items()}


def test_key_stands_in_no_plan(spark):
    df = spark.createDataFrame([(1, "ask 8.8.8.8")], "doc_id long, text string")
    out = pii.pseudonymize(df, key="very-secret-words")
    assert "very-secret-words" not in out._jdf.queryExecution().toString()
    spark.conf.set(pii.KEY_CONF, "very-secret-words")
    try:
        assert pii.pseudonymize(df).head()["text"] == out.head()["text"] != pii.pseudonymize(df, key="other").head()["text"]
    finally:
        spark.conf.unset(pii.KEY_CONF)


def test_address_of_single_digits(spark):
    df = spark.createDataFrame([(1, "ask 8.8.8.8"), (2, "ask 8.8.8.8 or a@b.org, 2001-02-03"), (3, "no 8.8 here")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.pseudonymize(df).collect()}
    new = got[1]["found"]
    assert len(new) == 1 and new[0]["kind"] == "ip" and new[0]["value"] == got[2]["found"][0]["value"]
    assert got[1]["text"] == f"ask {new[0]['value']}" and got[3]["text"] == "no 8.8 here" and got[3]["found"] == []


def test_feistel_is_a_permutation(spark):
    df = spark.range(7 * 9).select(pii.feistel(F.col("id"), 7, 9, F.lit("k"), False).alias("y"))
    assert sorted(r["y"] for r in df.collect()) == list(range(63))
