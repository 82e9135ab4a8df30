"""Toxicity, language identification, HTML extraction, perspectives and mixing."""

import itertools
import os
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import budget_mix, bytecnn_langid, perspectives, toxicity, tree_extract

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def maximal(scores, at=0):
    """All maximal segments by their definition: the best one, then those beside it."""
    best = None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 1e-9 and (best is None or total > best[2] + 1e-9):
                best = (i, j, total)
    if best is None:
        return []
    i, j, total = best
    return [*maximal(scores[:i], at), (i + at, j + at, round(total, 6)), *maximal(scores[j + 1 :], at + j + 1)]


def test_segments_are_all_maximal_ones():
    rng = random.Random(3)
    for _ in range(300):
        scores = [rng.choice([-1.0] * 5 + [2.3137, 3.7411, 1.1093]) for _ in range(rng.randint(1, 24))]
        got = toxicity.segments([(i, s) for i, s in enumerate(scores) if s > 0], 1.0)
        assert [(a, b, round(t, 6)) for a, b, t in got] == maximal(scores)


def test_segments_take_linear_time():
    """Ten times the hits take about ten times as long, however far apart they are."""
    for gap in (2, 100):
        took = []
        for n in (20_000, 200_000):
            hits = [(gap * i, 2.0) for i in range(n)]
            began = time.process_time()
            toxicity.segments(hits)
            took.append(time.process_time() - began)
        assert took[1] < 40 * took[0]


def test_unrelated_texts_stay_in_the_sample(spark):
    """Only copies go: common words, and even a shared passage, make none."""
    rng = random.Random(15)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(3000)]
    weights = [1 / (i + 1) for i in range(3000)]
    passage = rng.choices(words, weights, k=40)
    texts = [rng.choices(words, weights, k=200) for _ in range(300)]
    rows = [(" ".join(t), 0) for t in texts] + [(" ".join(passage + t[:160]), 0) for t in (rng.choices(words, weights, k=160) for _ in range(100))]
    copies = [(" ".join([w if rng.random() > 0.02 else "changed" for w in t]), 1) for t in texts[:100]] + [(" ".join(texts[0]), 1)]
    kept = {r.text: r.toxic for r in toxicity.without_copies(spark.createDataFrame(rows + copies, "text string, toxic int")).collect()}
    assert 400 <= len(kept) <= 402 and sum(t in kept for t, _ in rows[300:]) == 100
    assert kept.get(" ".join(texts[0]), 1) == 1


def test_extreme_values():
    scores, shares = np.array([-0.25, 5.0]), np.array([0.999, 0.001])
    lam, k = toxicity.extreme_values(scores, shares)
    assert (shares * np.exp(lam * scores)).sum() == pytest.approx(1, abs=1e-6) and k > 0


@pytest.fixture(scope="module")
def rude(spark):
    rng = random.Random(5)
    words = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    words = ["".join(chr(97 + (ord(c) - 48) % 26) if c.isdigit() else c for c in w) for w in words]
    docs, labels = [], []
    for i in range(600):
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        toxic = i % 4 == 0
        if toxic:
            at = rng.randrange(len(text))
            text[at:at] = [rng.choice(["grumblefoo", "Snarlbar", "hissbaz"]) for _ in range(3)]
        docs.append((i, " ".join(text), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, DOCUMENTS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, rude, odd_documents, no_documents):
    docs, labels = rude
    got = {r.doc_id: r for r in toxicity.toxicity_table(docs, labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [d for d in got if got[d].held_out]
    assert 60 < len(held) < 200 and all(got[d].predicted == truth[d] for d in held)
    text = next(r.text for r in docs.collect() if r.doc_id == 0)
    p = got[0].passages[0]
    assert set(re.findall(r"[a-z]+", text[p.start : p.end].lower())) & {"grumblefoo", "snarlbar", "hissbaz"}
    odd = toxicity.toxicity_table(docs.unionByName(odd_documents.select(docs.columns)), labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, 1, None), (0, 1, 1)], labels.schema)))
    assert odd.count() == 610 and odd.where("score IS NULL OR score < 0 OR score > 1").isEmpty()
    assert {r.predicted for r in odd.where("doc_id = 1 OR doc_id IS NULL").collect()} <= {0, truth[1]}
    none = toxicity.toxicity_table(odd_documents, labels.limit(0)).collect()
    assert len(none) == 10 and all(r.score == 0 and r.passages == [] for r in none)
    assert toxicity.toxicity_table(no_documents, labels).count() == 0


@pytest.fixture(scope="module")
def tongues(spark):
    rng, rows = random.Random(7), []
    parts = {"aa": ["kro", "zak", "tru"], "bb": ["lio", "mea", "nui"], "cc": ["ßüx", "öpf", "äch"]}
    for i in range(450):
        lang = ["aa", "bb", "cc"][i % 3]
        text = " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 150)))
        rows.append((i, text.upper() if i % 10 == 0 else text, lang, "s", 1))
    return spark.createDataFrame(rows, DOCUMENTS)


def test_language(spark, tongues, odd_documents, no_documents):
    truth = {r.doc_id: r.lang for r in tongues.collect()}
    got = bytecnn_langid.language_table(tongues).collect()
    held = [r for r in got if r.held_out]
    assert held and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    both = bytecnn_langid.language_table(tongues.where("doc_id >= 10").unionByName(odd_documents.select(tongues.columns)))
    odd = {r.doc_id: r for r in both.where("doc_id < 10 OR doc_id > 1000 OR doc_id IS NULL").where("doc_id IS NOT NULL").collect()}
    assert odd[1].lang_pred == odd[2].lang_pred == odd[-9].lang_pred == "und" and odd[1].score == 0
    assert odd[9_000_000_000].lang_pred in {"aa", "bb", "cc", "en", "fr"} and both.where("score IS NULL OR score < 0 OR score > 1").isEmpty()
    assert {r.lang_pred for r in bytecnn_langid.language_table(tongues.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert bytecnn_langid.language_table(no_documents).count() == 0


def test_gradients_are_those_of_differences():
    """Each parameter's gradient against the loss's change when it is moved a little."""
    rng = np.random.default_rng(4)
    x, y = rng.integers(1, 200, (12, 20)).astype(np.uint8), rng.integers(0, 3, 12)
    model = bytecnn_langid.train(x, y, ["a", "b", "c"], steps=3, batch=8)
    for name in ("embedding", "out", "out_bias"):
        setattr(model, name, getattr(model, name).astype(np.float64))
    model.taps, model.bias = [t.astype(np.float64) for t in model.taps], [b.astype(np.float64) for b in model.bias]

    def loss():
        hidden = []
        for w, taps, bias in zip(bytecnn_langid.WIDTHS, model.tables(), model.bias, strict=True):
            n = x.shape[1] - w + 1
            hidden.append(np.maximum(sum(taps[k][x[:, k : k + n]] for k in range(w)).max(axis=1) + bias, 0))
        p = bytecnn_langid.softmax(np.concatenate(hidden, axis=1) @ model.out + model.out_bias)
        return -np.log(p[np.arange(len(x)), y]).mean()

    params = [model.embedding, *model.taps, *model.bias, model.out, model.out_bias]
    for p, g in zip(params, bytecnn_langid.gradients(model, x, y), strict=True):
        for at in rng.choice(p.size, min(12, p.size), replace=False):
            place = np.unravel_index(at, p.shape)
            old, change = p[place], []
            for d in (1e-6, -1e-6):
                p[place] = old + d
                change.append(loss())
            p[place] = old
            assert g[place] == pytest.approx((change[0] - change[1]) / 2e-6, abs=1e-6)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_held_out_accuracy(spark):
    """What the queries predict of the documents that they did not learn from."""
    from weftline.llm import queries

    sf = "/root/testdata/sf0.01"
    known = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.toxic is not None}
    rude = [(r.predicted, known[r.doc_id]) for r in queries.op1_toxic_segments(spark, sf).where("held_out").collect() if r.doc_id in known]
    assert sum(p == t for p, t in rude) >= 0.95 * len(rude) and sum(t for p, t in rude if p) >= 0.9 * sum(p for p, _ in rude)
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect() if r.lang is not None}
    said = [(r.lang_pred, lang[r.doc_id]) for r in queries.op5_bytecnn(spark, sf).where("held_out AND lang_pred <> 'und'").collect() if r.doc_id in lang]
    assert sum(p == t for p, t in said) >= 0.97 * len(said) and len(said) > 100


def test_windows_hold_every_byte():
    data = [b"", b"abc", b"x" * 256, b"y" * 257]
    windows, counts = bytecnn_langid.windows_of(data)
    assert counts.tolist() == [1, 1, 1, 2] and windows[windows != 0].tobytes() == b"".join(data)


def test_scorer_equals_plain_convolution(tongues):
    model = bytecnn_langid.fit(tongues)
    windows = bytecnn_langid.windows_of([b"some text to score", b"other"])[0]
    tables = model.tables()
    hidden = []
    for w, taps, bias in zip(bytecnn_langid.WIDTHS, tables, model.bias, strict=True):
        n = windows.shape[1] - w + 1
        hidden.append(np.maximum((sum(taps[k][windows[:, k : k + n]] for k in range(w))).max(axis=1) + bias, 0))
    want = np.concatenate(hidden, axis=1) @ model.out + model.out_bias
    assert np.allclose(bytecnn_langid.Scorer(model).logits(windows), want, atol=1e-4)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site, of, many, commas</h1></header><nav><ul><li><a href="/x">Menu, a</a></li></ul></nav><div class="ad">Buy, now, and, here.</div>
<div id="page"><div class="side-bar sidebar"><p>Side, side, side.</p></div><article><h1>Title &amp; more</h1><p><b>First,   one
<br>line<br><p>Second &lt;x&gt; with <a href="y">a link</a>.<ul><li>one<li>two</ul><table><tr><td>a<td>b</table>
<div class="comments"><p>Nice, article, you, wrote.</p></div></article></div><form><p>Join, us</p></form><div role="alert">We use cookies</div><footer>&copy; x</footer></body></html>"""


def test_main_text():
    assert tree_extract.main_text(PAGE) == "Title & more\nFirst, one line\nSecond <x> with a link.\none\ntwo\na\nb"
    plain = "<body><div class='menu'>a, b, c</div><div><p>Long enough, with commas, to be text.</p><p>More.</p></div><div><a href='x'>link</a></div></body>"
    assert tree_extract.main_text(plain) == "Long enough, with commas, to be text.\nMore."


def random_tree(rng, depth=0):
    """A nested page part without the elements that are left out, and its plain form (tag, parts)."""
    tag = rng.choice(["div", "section", "p", "a", "span", "article", "td", "li", "h2"] if depth else ["div"])
    parts = []
    for _ in range(rng.randint(0, 4 if depth < 5 else 1)):
        if rng.random() < 0.45 or depth > 5 or tag in ("p", "h2", "a"):
            parts.append(" ".join(rng.choice(["word", "and,", "more"]) for _ in range(rng.randint(0, 30))))
        else:
            parts.append(random_tree(rng, depth + 1))
    return tag, parts


def built(tree, parent):
    node = tree_extract.Node(tree[0], parent)
    node.children = [t if isinstance(t, str) else built(t, node) for t in tree[1]]
    return node


def text_of(tree):
    return sum(len(t.strip()) if isinstance(t, str) else text_of(t)[0] for t in tree[1]), sum(t.count(",") if isinstance(t, str) else text_of(t)[1] for t in tree[1])


def links_of(tree):
    return text_of(tree)[0] if tree[0] == "a" else sum(0 if isinstance(t, str) else links_of(t) for t in tree[1])


def plain_points(tree, root):
    """Points of every element by the rule itself: look at each block below, and how far down it is."""
    found = []

    def blocks_below(t, level):
        chars, commas = text_of(t)
        own = "".join(x for x in t[1] if isinstance(x, str)).strip()
        paragraph = t[0] in tree_extract.PARAGRAPHS
        if not paragraph:
            chars, commas = (len(own), own.count(",")) if t[0] in tree_extract.BLOCK else (0, 0)
        if chars:
            density = links_of(t) / text_of(t)[0] if text_of(t)[0] else 0
            points = (1 + commas + min(chars / 100, 3)) * (1 - density)
            if level == 0 and not paragraph:
                yield points
            elif 1 <= level <= 5:
                yield points * [1, 1 / 2, 1 / 4, 1 / 6, 1 / 8][level - 1]
        for x in t[1]:
            if not isinstance(x, str):
                yield from blocks_below(x, level + 1)

    def visit(t):
        found.append(sum(blocks_below(t, 0)))
        for x in t[1]:
            if not isinstance(x, str):
                visit(x)

    visit(tree)
    return found


def test_scores_against_a_recursive_scorer():
    rng = random.Random(12)
    for _ in range(200):
        tree = random_tree(rng)
        root = tree_extract.Node("#root", None)
        root.children = [built(tree, root)]
        got = [n.points for n in tree_extract.score(root)[1:]]
        assert got == pytest.approx(plain_points(tree, tree))


def generated_page(rng):
    """A page without article elements, and its text."""
    words = lambda n: " ".join(rng.choice(["the", "river", "ran,", "past", "old", "mills"]) for _ in range(n))
    wrap = rng.choice([("<div class='main-content'>", "</div>"), ("<form action='/post'>", "</form>"), ("<div class='page with-sidebar'>", "</div>"), ("<div class='paywall'>", "</div>"), ("", "")])
    parts = [f"{words(rng.randint(20, 60))}." for _ in range(rng.randint(3, 8))]
    menu = "".join(f"<li><a href='/{i}'>{words(2)}</a></li>" for i in range(8))
    body = f"<nav><ul>{menu}</ul></nav><div class='ad'>{words(8)}</div>{wrap[0]}<div id='text'>" + "".join(f"<p>{t}</p>" for t in parts) + f"</div><input name='q'>{wrap[1]}"
    body += f"<div class='comments'>{'<p>' + words(40) + '</p>'}</div><div><ul>{menu}</ul></div><div class='cookie-notice'>{words(9)}</div><footer>{words(6)}</footer>"
    return f"<html><head><title>{words(3)}</title></head><body>{body}</body></html>", "\n".join(parts)


def test_pages_without_articles():
    rng = random.Random(13)
    for _ in range(150):
        html, text = generated_page(rng)
        assert tree_extract.main_text(html) == text


def test_wrappers_and_nested_articles():
    text = "Long enough, with commas, to be text."
    for html in (
        f"<body class='sidebar-left'><form><article><h1>T</h1><p>{text}</p></article><p>Join, us</p></form></body>",
        f"<div class='has-comments'><article><div class='header'><h1>T</h1></div><p>{text}</p></article></div>",
        f"<main><article><h1>T</h1><p>{text}</p></article><article class='comment'><p>{text * 9}</p></article></main>",
    ):
        assert tree_extract.main_text(html).removesuffix("\nJoin, us") == f"T\n{text}"
    outer = f"<article><h1>Home</h1><p>Short, intro.</p><article><h2>T</h2><p>{text}</p><p>{text}</p></article></article>"
    assert tree_extract.main_text(outer).endswith(f"T\n{text}\n{text}")


@pytest.mark.parametrize("html, text", [(None, ""), ("", ""), ("just words", "just words"), ("<p>a<p>b", "a\nb"), ("<div>" * 3000 + "deep, text", "deep, text"), ("<p>x &amp", "x &"), ("<article></article>", ""), ("<nav>a</nav>", ""), ("</p></div>x", "x")])
def test_odd_pages(html, text):
    assert tree_extract.main_text(html) == text


def test_short_blocks_of_an_article_stay():
    long = "Long enough, with commas, to be text of an article, as it is read by people."
    divs = "".join(f"<div>{'<p>' + t + '</p>'}</div>" for t in (long, "Second.", long, "Last."))
    assert tree_extract.main_text(f"<body><nav>a</nav>{divs}<footer>f</footer></body>") == f"{long}\nSecond.\n{long}\nLast."
    menu = "".join(f"<li><a href='/{i}'>one more</a></li>" for i in range(6))
    many = lambda n: f"<p>{long}</p>" * n
    mixed = f"<div class='t'>{many(6)}</div><div><ul>{menu}</ul></div><div class='u'>short</div><div class='t'>{many(3)}</div><div class='t'>last</div><div class='z'>after</div>"
    assert tree_extract.main_text(f"<body>{mixed}</body>") == "\n".join([*[long] * 6, "short", *[long] * 3, "last"])


def test_deep_markup_takes_linear_time():
    text = "deep, text that is read"
    for html in ("<i>" * 100_000 + text, "<i>" * 50_000 + "<h1>x</h1>" * 20_000 + text, "<p>" + "<b><i>" * 30_000 + "</b>" * 30_000 + text, "<table><tr><td>" * 20_000 + text):
        began = time.process_time()
        assert text in tree_extract.main_text(html)
        assert time.process_time() - began < 8  # a machine three times as slow as usual


class WalkingBuilder(tree_extract.TreeBuilder):
    """The same tags, each found by walking up from the current element."""

    def imply_end(self, tag, ends):
        depth = 0
        for node in reversed(self.open[1:]):
            if node.tag in ends:
                depth = node.depth
            elif node.tag in tree_extract.SCOPE and not (tag in ("td", "th", "tr") and node.tag != "table"):
                break
        if depth:
            self.end_from(depth)

    def handle_endtag(self, tag):
        for node in reversed(self.open[1:]):
            if node.tag == tag:
                return self.end_from(node.depth)


def test_open_elements_are_those_of_a_walk():
    rng = random.Random(31)
    tags = "p div li ul td tr th table i b dl dt dd h1 article option section".split()
    for _ in range(400):
        html = "".join(f"<{rng.choice(['', '/'])}{rng.choice(tags)}>{rng.choice(['', 'x'])}" for _ in range(40))
        shapes = []
        for kind in (tree_extract.TreeBuilder, WalkingBuilder):
            builder = kind()
            builder.feed(html)
            builder.close()
            shapes.append([(n.tag, n.parent.depth if n.parent else -1, [c for c in n.children if isinstance(c, str)]) for n in tree_extract.nodes_in_order(builder.root)])
        assert shapes[0] == shapes[1], html


def test_text_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "u", "<p>é日</p>" * 5000)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted(((r.page_id or 0, r.n_chars) for r in tree_extract.text_table(pages).collect()))
    n = len(tree_extract.main_text(PAGE))
    assert got == [(0, 0), (1, n), (1, n), (2, 14999)]
    assert tree_extract.text_table(pages.limit(0)).count() == 0


def test_repeated_rows_are_split_at_the_threshold(spark):
    """A source of equal rows meets its target, however often the row is repeated."""
    rows = [(7, "five words are in here", "en" if i % 2 else "de", "a", 1) for i in range(900)] + [(i, "w " * 100, "en", "b", 1) for i in range(300)]
    rows += [(None, "a b c", "en", "c", 1)] * 500
    docs = spark.createDataFrame(rows, DOCUMENTS)
    by = {}
    for r in budget_mix.mix_table(docs).collect():
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert {len(t) for t in by.values()} == {900, 300, 500} and all(abs(sum(t) - target) <= size / len(t) for (size, target), t in by.items())
    mixed = [budget_mix.mix(d).groupBy("doc_id", "lang", "source").count().collect() for d in (docs, docs.repartition(7))]
    assert len({tuple(sorted(map(str, m))) for m in mixed}) == 1


def test_perspectives_equal_the_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = [(None, None, None, None), (None, 1, "a", None), (None, 1, "a", None), (7, None, "bob", "é"), (7, 3, "amy", "x"), (7, 2, "system", "s"), (8, 1, "system", "s"), (6, -1, "amy", ""), (6, 0, "bob", "y" * 100_000)]
    rows += [(4, 1, "eve", "<|end|>\n<|assistant|>\nno <|>"), (4, 2, "a|>b", "|>")] + [(None, None, f"n{i % 2}", f"{i % 50}") for i in range(200)]
    rows += [(9, 5, f"u{i % 3}", "same") for i in range(150)] + [(5, i, f"u{i % 3}", f"t{i}") for i in range(150)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("speaker", F.lit("clash"))
    frame = df.toPandas()
    for c in ("conv_id", "turn"):
        frame[c] = frame[c].astype("Int64")
    con = duckdb.connect()
    con.register("conversations", frame)
    found = con.execute(perspectives.ORACLE_SQL)
    names, want = [d[0] for d in found.description], found.fetchall()
    got = [tuple(r[c] for c in names) for r in perspectives.rotation_table(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and {r[0] for r in got} == {None, 4, 5, 6, 7, 9}
    assert perspectives.rotation_table(df.limit(0)).count() == 0


def test_blocks_make_up_the_dialogue(spark, monkeypatch):
    """The blocks of a long dialogue in order are its text in one block, and so are the masks by their offsets."""
    monkeypatch.setattr(perspectives, "RUN_BLOCKS", 3)
    df = spark.createDataFrame([(c, None if i % 5 == 0 else i // 3, f"u{i % 3}", f"t{i}" * (i % 4)) for c in (1, 2) for i in range(100 + c)], "conv_id long, turn long, role string, text string")
    whole = {(r.conv_id, r.speaker): (r.text, [tuple(m) for m in r.mask]) for r in perspectives.rotate(df, 500).collect()}
    parts = {}
    for r in sorted(perspectives.rotate(df, 4).collect(), key=lambda r: r.block):
        text, mask = parts.get((r.conv_id, r.speaker), ("", []))
        assert r.offset == len(text)
        parts[r.conv_id, r.speaker] = text + r.text, mask + [(a + r.offset, b + r.offset) for a, b in map(tuple, r.mask)]
    assert parts == whole and len(whole) == 6


def test_masks_cover_the_speaker(spark):
    df = spark.createDataFrame([(1, 0, "amy", "hello"), (1, 1, "bob", "hi"), (1, 2, "cid", "yo")], "conv_id long, turn long, role string, text string")
    for r in perspectives.rotate(df).collect():
        said = {"amy": "hello", "bob": "hi", "cid": "yo"}[r.speaker]
        assert [r.text[m.start : m.end] for m in r.mask] == [said + "<|end|>"]
        assert r.text.count("<|assistant|>") == 1 and r.text.count("<|user name=") == 2


def test_no_python_in_perspectives(spark):
    df = spark.createDataFrame([(1, 0, "amy", "hello")], "conv_id long, turn long, role string, text string")
    plan = perspectives.rotation_table(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_targets():
    got = budget_mix.targets({"b": 100, "a": 10, None: 50, "c": 0})
    assert got["a"] == 20 and got["c"] == 0 and sum(got.values()) == pytest.approx(1.5 * 160)
    assert got["b"] == pytest.approx(2 * (240 - 20) / 7 if 2 * 220 / 7 <= 200 else 200) or got[None] == 100
    assert all(got[s] <= 2 * n + 1e-9 for s, n in {"b": 100, "a": 10, None: 50, "c": 0}.items())


def test_knapsack_is_best():
    rng = random.Random(3)
    for _ in range(200):
        sizes = np.array(sorted(rng.sample(range(1, 15), rng.randint(1, 5))))
        left, budget = np.array([rng.randint(0, 3) for _ in sizes]), rng.randint(0, 40)
        best = max(t for c in itertools.product(*(range(n + 1) for n in left)) if (t := int((sizes * c).sum())) <= budget)
        taken = budget_mix.knapsack(sizes, left, budget)
        assert (taken <= left).all() and (taken * sizes).sum() == best
    sizes, counts = np.arange(1, 3000), np.full(2999, 500)
    for share in (0.001, 0.37, 0.99):
        budget = int(share * (sizes * counts).sum())
        taken = budget_mix.fill(sizes, counts, budget)
        assert (taken <= counts).all() and (taken * sizes).sum() == budget


def test_mix(spark, odd_documents, no_documents):
    rng = random.Random(9)
    rows = [(100 + i, " ".join(["w"] * rng.choice([1, 3, 7, 7, 7, 20])), "en", rng.choice(["s", "t", "u", None]), 1) for i in range(4000)]
    docs = odd_documents.drop("score", "size").unionByName(spark.createDataFrame(rows, DOCUMENTS)).withColumn("size", F.lit("clash"))
    got = budget_mix.mix_table(docs).collect()
    sizes = {}
    for r in docs.collect():
        sizes.setdefault(r.source, []).append(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")))
    want = budget_mix.targets({s: sum(n) for s, n in sizes.items()})
    by = {}
    for r in got:
        by.setdefault((r.source_size, round(r.target, 6)), []).append(r.taken)
        assert r.taken <= 2 * r.size
    assert set(by) == {(sum(n), round(want[s], 6)) for s, n in sizes.items()}
    # The source with one text of 120,000 words can come no nearer than half of it.
    assert all(abs(sum(t) - target) <= (60_000 if max(t) > 1000 or size > 100_000 else 14) for (size, target), t in by.items())
    again = budget_mix.mix_table(docs.repartition(5)).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)
    mixed = budget_mix.mix(docs)
    assert mixed.columns == docs.columns
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in mixed.collect())
    assert words == sum(r.taken for r in got)
    assert budget_mix.mix_table(no_documents).count() == 0 and budget_mix.mix(no_documents).count() == 0
