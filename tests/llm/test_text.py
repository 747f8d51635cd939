"""Tokenising, mixing, chats, pages, licences, toxicity, search and the pipeline."""

import collections
import html
import random
import re
import zlib

import numpy as np
import pytest
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm.bpe import bpe_decode, bpe_encode, bpe_round_trip
from graphloom.llm.chat_format import Formatter, Parser, Template, chat_segments, chat_texts, read_back
from graphloom.llm.common import table
from graphloom.llm.html_text import common_lines, extract_text, line_hash, main_text, partners, shared_lines
from graphloom.llm.licenses import TEMPLATES, bigrams, license_scan, license_spans
from graphloom.llm.mixing import mix
from graphloom.llm.queries import ORACLE_SQL, QUERIES
from graphloom.llm.queries_corpus import vocabulary
from graphloom.llm.topk import exact_top_k, whole_vectors
from graphloom.llm.toxicity import Channel, language_model, toxicity
from tests.compare import connection, rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, matches string, tokens int, epochs long, score double"


def frame(spark, texts, lang="en", source="src1"):
    return spark.createDataFrame([(i, t, lang, source, None, "x", 1, 2, 3.0) for i, t in texts], SCHEMA)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert rows(QUERIES[name](spark, sf_dir).toPandas()) == rows(connection(sf_dir).sql(ORACLE_SQL[name]).df())


# tokenising


def odd_texts():
    rnd = random.Random(3)
    texts = [None, "", " ", "a<|endoftext|>b<|endoftext|>", "  x \n\n y\t\t", "don't I'll '90s ½² 日本語 😀😀", "a" * 5000, "é" * 3000, "\x00\x1c\x85　a", "=-" * 500]
    return texts + ["".join(chr(rnd.choice([rnd.randrange(32, 0x250), rnd.randrange(0x250, 0xD7FF)])) for _ in range(80)) for _ in range(60)]


def test_bpe_equals_the_library_and_goes_back(spark):
    library = tokenizers.Tokenizer.from_file(vocabulary())
    texts = list(enumerate(odd_texts())) + [(None, "x"), (1, "")]
    encoded = bpe_encode(frame(spark, texts), vocabulary())
    got = encoded.collect()
    assert len(got) == len(texts)
    for r in got:
        if r.doc_id is not None:
            text = dict(texts[:-1])[r.doc_id] or ""
            assert r.ids == library.encode(text, add_special_tokens=False).ids and r.n_tokens == len(r.ids)
    back = {r.doc_id: r.text for r in bpe_decode(encoded.filter("doc_id > 1"), vocabulary()).collect()}
    assert all(back[i] == t for i, t in texts[2:-2])
    assert bpe_round_trip(frame(spark, []), vocabulary()).count() == 0


def test_op10_digests(spark, sf_dir):
    import hashlib

    library = tokenizers.Tokenizer.from_file(vocabulary())
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    for r in QUERIES["op10_bpe_round_trip"](spark, sf_dir).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# mixing


def test_mix_keeps_to_budgets_and_gives_shortages_to_siblings_first(spark):
    docs = None
    for lang, source, n in (("en", "src0", 100), ("en", "src4", 10), ("de", "src0", 50)):
        one = frame(spark, [(i + (0 if lang == "en" else 1000) + 10_000 * (source == "src4"), "w " * 10) for i in range(n)], lang, source)
        docs = one if docs is None else docs.unionByName(one)
    out = mix(docs, share=(1, 2), max_epochs=1)
    got = {(r.mix_lang, r.mix_source): r.tokens for r in out.groupBy("mix_lang", "mix_source").agg(F.sum("mix_tokens").alias("tokens")).collect()}
    # 800 of 1,600 tokens; 400 a language; src4 has 100 only, and its sibling takes the other 100
    assert got == {("de", "src0"): 400, ("en", "src0"): 300, ("en", "src4"): 100}
    assert set(docs.columns) <= set(out.columns)


def test_mix_of_odd_rows(spark):
    assert mix(frame(spark, [])).count() == 0
    texts = [(1, None), (2, ""), (3, " "), (None, "a b"), (4, "a " * 100_000), (5, "b"), (5, "b")]
    out = mix(frame(spark, texts, lang=None, source=None), share=(3, 1), max_epochs=3).collect()
    assert {(r.doc_id, r.copies) for r in out} == {(4, 3), (5, 3)} and len(out) == 3


# chats


def test_texts_cannot_pose_as_marks():
    f, t = Formatter(Template()), Template()
    rnd = random.Random(1)
    pieces = [*t.controls, "\\", "<", "[", "/", "INST]", " ", "x", "\n", "|>"]
    for _ in range(3000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randrange(8)))
        assert f.unescape(f.escape(text)) == text
        assert not f.control.search(f.escape(text))


def test_turns_are_parsed_from_the_joined_text():
    f, t = Formatter(Template()), Template()
    rnd = random.Random(2)
    pieces = [*t.controls, *t.close.values(), *t.open.values(), "\\", "<", "[", " ", "|", "x", "\n", "|>"]
    for _ in range(2000):
        turns = [(rnd.choice(["user", "assistant", "system", "tool", "", "a|", "<|role:"]), "".join(rnd.choice(pieces) for _ in range(rnd.randrange(6)))) for _ in range(rnd.randrange(5))]
        joined = "".join(segment for turn in turns for segment, _ in f.turn(*turn))
        parser, got, step = Parser(f), [], rnd.randrange(1, 12)
        for at in range(0, len(joined), step):
            got += parser.feed(joined[at : at + step])
        parser.end()
        assert got == turns, joined
    parser = Parser(f)
    assert list(parser.feed("[INST] a")) == []
    with pytest.raises(ValueError):
        parser.end()
    with pytest.raises(ValueError):
        list(Parser(f).feed("no mark"))


def test_chat_of_odd_rows(spark):
    data = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (3, 0, None, "x"), (4, None, "tool|>", "</s>"), (None, 0, "user", "x"), (5, 0, "system", ""), (5, 1, "user", "é" * 50_000), (5, 2, "assistant", "b")]
    chats = spark.createDataFrame([(*r, "extra") for r in data], "conv_id long, turn long, role string, text string, part string")
    got = {r.conv_id: r for r in read_back(chat_segments(chats)).collect()}
    assert {c: (r.n_turns, r.valid, r.loss_chars) for c, r in got.items()} == {1: (2, True, 0), 2: (2, False, 2), 3: (1, False, 0), 4: (1, False, 0), 5: (3, True, 1)}
    import hashlib

    assert got[4].turns_sha256 == hashlib.sha256(b"tool|>\n</s>\n").hexdigest()
    whole = {r.conv_id: r for r in chat_texts(chats).collect()}
    assert [whole[5].text[s.start : s.start + s.length] for s in whole[5].spans] == ["b"] and len(whole[5].text) == got[5].formatted_chars
    wrong = chat_segments(chats).withColumn("loss", F.when((F.col("part") == 1) & (F.length("segment") > 0), ~F.col("loss")).otherwise(F.col("loss")))
    with pytest.raises(Exception, match="loss mask"):
        read_back(wrong).collect()
    assert read_back(chat_segments(chats.limit(0))).count() == 0


# pages


def expected(page):
    article = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
    text = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)>", " \n ", article))
    return " ".join(html.unescape(text).split())


def test_op8_gives_the_articles(spark, sf_dir):
    pages = {r.page_id: r.html for r in table(spark, sf_dir, "pages").collect()}
    got = {r.page_id: r.text for r in QUERIES["op8_html_text"](spark, sf_dir).collect()}
    assert got == {i: expected(h) for i, h in pages.items()}


PAGE = """<!doctype html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header>Top</header><nav><ul><li>Menu</ul></nav>
<div class="cookie-notice">We use cookies</div><main><header><h1>A &amp; B</h1></header><p>One <b>bold</b>
 word<br>more<p>Two<div class="advert"><p>Buy</p></div><form><p>Mail</p></form><aside>Side</aside><table><tr><td>c1<td>c2</table></main>
<section id="comments"><p>First!</p></section><footer>End</footer></body></html>"""


def test_main_text_without_what_stands_around_it():
    assert main_text(PAGE, None) == "A & B One bold word more Two c1 c2"
    assert main_text(None, None) == "" and main_text("just text", None) == "just text" and main_text("<p>cut &am", None) == "cut &am"


def test_shared_lines_go_where_there_is_no_article():
    a, b = ("<div>Shop of things</div><p>{}</p><div>Call us</div>".format(x) for x in ("Own words", "Other words"))
    assert main_text(a, b) == "Own words" and main_text(a, None) == "Shop of things Own words Call us"
    assert common_lines(list("abcde"), list("xbydce")) in ({1, 2, 4}, {1, 3, 4})


def test_articles_that_stand_aside_are_not_the_text():
    post = "<div><p>The post.</p></div>"
    assert main_text(f"{post}<section class='comments'><article>First!</article></section>", None) == "The post."
    assert main_text(f"{post}<aside><article>A card</article></aside>", None) == "The post."
    assert main_text(f"<main>{post}<aside><article>A card</article></aside></main><p>Other</p>", None) == "The post."


def test_lines_that_different_articles_share_go_and_shared_articles_stay(spark):
    page = lambda *own: "<body><article>" + "".join(f"<p>{x}</p>" for x in own) + "</article></body>"
    note = "Subscribe to read on"
    rows = [(i, f"http://h.x/news/{i}", page(f"Story number {i} about matters", note, f"It ends like {i} and then some")) for i in range(6)]
    # in one folder of a large host only
    rows += [(10 + i, f"http://g.x/a/{i}", page(f"Piece number {i} about things", "Only in a", f"It closes like {i} and so on")) for i in range(4)]
    rows += [(20 + i, f"http://g.x/b/{i}", page(f"Other number {i} without any", f"Nothing like {i}")) for i in range(9)]
    # near copies of one article, and two articles with a line in common
    rows += [(40 + i, f"http://c.x/{i}", page("One long story that all of them carry", "with a second line as well", f"v{i}")) for i in range(5)]
    rows += [(50 + i, f"http://two.x/{i}", page(f"Text number {i} of two pages", "A quoted line", f"The end of {i} is here")) for i in range(2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract_text(pages).collect()}
    for i, _, h in rows:
        kept = [x for x in re.findall("<p>(.*?)</p>", h) if x not in (note, "Only in a")]
        assert got[i] == " ".join(kept)
    assert main_text(rows[0][2], rows[1][2], {note}) == "Story number 0 about matters It ends like 0 and then some"


def lcs_length(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_lines_are_a_longest_common_subsequence():
    rnd = random.Random(1)
    for _ in range(500):
        a, b = ([rnd.randrange(6) for _ in range(rnd.randrange(25))] for _ in range(2))
        found, left = sorted(common_lines(a, b)), iter(b)
        assert len(found) == lcs_length(a, b) and all(any(a[i] == x for x in left) for i in found)
    assert len(common_lines(["x"] * 20_000, ["x"] * 19_000)) == 19_000


def test_differencing_of_a_table_against_brute_force(spark, sf_dir):
    """Pages without an article, whose boilerplate no tag or class tells: only shared lines do. And what is shared on the given pages."""
    rnd = random.Random(2)
    lines = [f"Line {i} of the shop" for i in range(12)]
    rows, own = [], {}
    for i in range(40):
        own[i] = [f"Own words {i} {k}" for k in range(rnd.randrange(1, 4))]
        body = [x for x in lines if rnd.random() < 0.8]
        for x in own[i]:
            body.insert(rnd.randrange(len(body) + 1), x)
        rows.append((i, f"http://h.x/p/{i:03d}", "".join(f"<div>{x}</div>" for x in body)))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    near = dict(partners(pages).collect())
    texts = {i: re.findall("<div>(.*?)</div>", h) for i, _, h in rows}
    gone = {r.page_id: (set(r.gone), r.in_text) for r in shared_lines(pages).collect()}
    for r in extract_text(pages).collect():
        a, b = texts[r.page_id], texts[near[r.page_id]]
        left = [x for x in a if line_hash(x) not in gone[r.page_id][0]]
        assert r.text == " ".join(left) and set(own[r.page_id]) <= set(left) and gone[r.page_id][1]
        assert len(a) - len(left) == lcs_length(a, b)
    given = shared_lines(table(spark, sf_dir, "pages")).agg(F.count("*"), F.sum(F.size("gone"))).first()
    assert given[0] > 0 and given[1] >= given[0]


def test_broken_pages_take_no_longer_than_whole_ones():
    for unit in ("<a ", "<a \"b'", '<a "><b "', "<script ", "</b", "<div></p>", '<a class="', "<!-- "):
        main_text(unit * 30_000, None)
    assert main_text('<p title="a > b">x</p><p>1 < 2 & 3</p>', None) == "x 1 < 2 & 3"


def test_partners_are_the_nearest_paths(spark):
    data = [(1, "http://h/a/1"), (2, "http://h/a/12"), (3, "http://h/b"), (4, "http://other/"), (5, None), (6, "odd"), (None, "http://h/a/1"), (2, "http://h/a/12")]
    pages = spark.createDataFrame([(i, u, "<p>x</p>", "h") for i, u in data], "page_id long, url string, html string, host string")
    assert dict(partners(pages).collect()) == {1: 2, 2: 1, 3: 2, 5: 6, 6: 5}
    assert extract_text(pages).count() == len(data) and extract_text(pages.limit(0)).count() == 0


# licences


def test_licences_equal_brute_force(spark, sf_dir):
    texts = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    extra = [(-1, "\n\n".join(TEMPLATES.values())), (-2, TEMPLATES["MIT text"].replace(", ", ",\n")), (-3, None), (-4, ""), (-5, "mit"), (-6, "Released under the MIT License now.\n" * 3), (-7, "Released UNDER the, MIT license " + "x" * 100_000)]
    got = {r.doc_id: r.matches for r in license_spans(frame(spark, texts + extra)).collect()}
    parts = {name: bigrams(t) for name, t in TEMPLATES.items()}
    for i, text in texts + extra:
        want, text = collections.Counter(), text or ""
        spans, at = {(0, len(text))}, 0
        for line in text.split("\n"):
            spans.add((at, at + len(line)))
            at += len(line) + 1
        for s, e in spans:
            own = bigrams(text[s:e])
            scores = sorted((-2 * len(own & b) / (len(own) + len(b)), name) for name, b in parts.items()) if own else []
            if scores and scores[0][0] <= -0.8:
                want[(scores[0][1], s, e)] += 1
        assert not want - collections.Counter((m.license, m.start, m.end) for m in got[i]), i
    assert len(got[-6]) >= 3
    summary = license_scan(frame(spark, extra)).filter("doc_id = -2").first()
    assert summary.best_license == "MIT text" and license_scan(frame(spark, [])).count() == 0


def test_licences_among_other_words_equal_brute_force(spark):
    rnd = random.Random(3)
    texts = [(1, "This project is released under the MIT License."), (2, "Copyright 2020 X.\nReleased under\nthe MIT License, see below"), (3, "the of license under " * 300), (4, "Released under the MIT License. " * 5), (5, "İ released under the mit license İ"), (6, None), (7, "x")]
    for i in range(8, 40):
        own = []
        for _ in range(rnd.randrange(1, 4)):
            words = rnd.choice(list(TEMPLATES.values())).split()
            for _ in range(rnd.randrange(4)):
                words[rnd.randrange(len(words))] = rnd.choice(["x", "the", words[0]])
            own += [rnd.choice(["the", "of", "license", "y"]) for _ in range(rnd.randrange(30))] + words
        texts.append((i, " ".join(own)))
    got = {r.doc_id: r.passages for r in license_spans(frame(spark, texts)).collect()}
    parts = {name: bigrams(t) for name, t in TEMPLATES.items()}
    for i, text in texts:
        words = re.findall(r"[^\W_]+", (text or "").lower())
        pairs, want = list(zip(words, words[1:], strict=False)), collections.Counter()
        for name, b in parts.items():
            spans = set()
            for low in range(len(pairs)):
                for high in range(low, min(len(pairs), low + int(len(b) * 1.5 + 1e-9))):
                    own = set(pairs[low : high + 1])
                    if pairs[low] in b and pairs[high] in b and 2 * len(own & b) / (len(own) + len(b)) >= 0.8:
                        spans.add((low, high))
            upto = None
            for low, high in sorted(spans):
                want[name] += upto is None or low > upto + 1
                upto = max(high, upto or 0)
        assert +want == collections.Counter(p.license for p in got[i]), i
    assert [(p.license, texts[0][1][p.start : p.end]) for p in got[1]] == [("MIT", "released under the MIT License")]
    assert len(got[2]) == 1 and not got[3] and not got[6] and not got[7]
    summary = license_scan(frame(spark, texts[:1])).first()
    assert (summary.n_matches, summary.n_passages, summary.licenses, summary.best_dice) == (0, 1, "MIT", 1.0)


# toxicity


def test_restoring_words():
    text = "the idiot and the loser said that a moron is pathetic trash worthless scum stupid clown disgusting "
    counts = np.zeros(28**3)
    codes = [ord(c) - 96 if c != " " else 0 for c in f"  {text * 50}"]
    for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
        counts[(a * 28 + b) * 28 + c] += 1
    channel = Channel(language_model(counts))
    for odd, word in (("1d10t", "idiot"), ("l0ser!!", "loser"), ("m0r0n,", "moron"), ("p@thet1c", "pathetic"), ("i.d.i.o.t", "idiot"), ("scuuuum", "scum"), ("tr4sh", "trash"), ("$tup1d", "stupid"), ("c-l-o-w-n", "clown")):
        assert channel.words(odd) == [word], odd
    assert "moron" in channel.restore_text("such m o r 0 n !") and "idiot" in channel.restore_text("an i d i o t here")


def test_toxicity_learns_words_it_was_shown(spark):
    rnd = random.Random(2)
    plain = [f"w{chr(97 + a)}{chr(97 + b)}rd" for a in range(20) for b in range(20)]
    texts, labels = [], []
    for i in range(600):
        own = [rnd.choice(plain) for _ in range(60)]
        bad = i % 6 == 0
        if bad:
            own[rnd.randrange(60)] = rnd.choice(["grotzkopf", "blarnidiot"])
            if i % 12 == 0:
                own = [x.replace("o", "0").replace("i", "1") if x in ("grotzkopf", "blarnidiot") else x for x in own]
        texts.append((i, " ".join(own)))
        labels.append((i, 1, int(bad), "x"))
    texts += [(700, None), (701, ""), (702, "gr0tzk0pf"), (None, "grotzkopf"), (703, "b l a r n i d i o t"), (704, "wabrd " * 50_000), (1, texts[1][1])]
    docs, given = frame(spark, texts), spark.createDataFrame(labels + [(None, 1, 1, "x"), (5, None, None, "x")], "doc_id long, quality int, toxic int, score string")
    got = {r.doc_id: r for r in toxicity(docs, given).collect()}
    for i, _, t, _ in labels:
        assert got[i].predicted == t and got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert [got[i].predicted for i in (700, 701, 702, 703, 704)] == [0, 0, 1, 1, 0] and None not in got
    assert toxicity(docs.limit(0), given).count() == 0
    assert {r.predicted for r in toxicity(docs.limit(20), given.limit(0)).collect()} == {0}


def test_copies_of_one_toxic_text_teach_only_what_independent_texts_bear_out(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(7))
    plain = [word() for _ in range(400)]
    base = [word() for _ in range(30)]
    texts, labels = [], []
    for i in range(400):
        own = [rnd.choice(plain) for _ in range(40)]
        if i % 8 == 0:
            own[rnd.randrange(40)] = "grotzkopf"
        texts.append((i, " ".join(own)))
        labels.append((i, int(i % 8 == 0)))
    for i in range(400, 440):
        texts.append((i, " ".join(["grotzkopf", *base])))
        labels.append((i, 1))
    texts += [(900, " ".join(base)), (901, "such a grotzkopf"), (902, "gr0tzk0pf"), (903, "ordinary (words) here!")]
    got = {r.doc_id: r.predicted for r in toxicity(frame(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert [got[i] for i in (900, 901, 902, 903)] == [0, 1, 1, 0]


def test_long_tokens_take_linear_time():
    import time

    channel, took = Channel(language_model(np.ones(28**3))), []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        assert channel.restore("a1" * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0]


def test_op9_recall_and_precision_on_held_out_rows(spark, sf_dir):
    larger = sf_dir.replace("sf0.001", "sf0.01")
    truth = {r.doc_id: r.toxic for r in table(spark, larger, "labels").collect()}
    held = [(truth[r.doc_id], r.predicted) for r in QUERIES["op9_toxicity"](spark, larger).collect() if r.held_out and r.doc_id in truth]
    hits = sum(t == p == 1 for t, p in held)
    # 277 labels to learn from: the ten words of this size are seen two or three times each
    assert hits >= 0.6 * sum(t for t, _ in held) and hits >= 0.9 * sum(p for _, p in held)


def test_op9_on_held_out_rows(spark, sf_dir):
    """The bound rises with the number of labels; at the smallest size only a few toxic texts are learned from."""
    truth = {r.doc_id: r.toxic for r in table(spark, sf_dir, "labels").collect()}
    got = [(truth[r.doc_id], r.predicted) for r in QUERIES["op9_toxicity"](spark, sf_dir).collect() if r.doc_id in truth]
    clean = [p for t, p in got if t == 0]
    assert sum(clean) <= 0.05 * len(clean)


# search


def test_top_k_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.5]), (50, [0.25, -1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (1, [1.0, 1.0]), (9, [-1.0, -1.0])]
    t = spark.createDataFrame([(i, v, 1, 2) for i, v in data], "vec_id long, embedding array<float>, node int, block int")
    got = [tuple(r) for r in exact_top_k(whole_vectors(t), F.col("vec_id") % 50 == 0, k=3, nodes=2).orderBy("query_id", "rank").collect()]
    v = lambda x: [int(np.floor(256 * y)) for y in x]
    dot = lambda a, b: sum(x * y for x, y in zip(v(a), v(b), strict=True))
    rows_ = {0: [1.0, 0.5], 50: [0.25, -1.0], 1: [1.0, 1.0], 2: [1.0, 1.0], 9: [-1.0, -1.0]}
    want = []
    for q in (0, 50):
        scores = sorted((-dot(rows_[q], x), i) for i, x in rows_.items() if i != q)[:3]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert got == want
    assert exact_top_k(whole_vectors(t.limit(0)), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_of_large_components(spark):
    """Scores above 2**53 are exact; vectors whose scores may not fit into a long take no part."""
    data = [(0, [3.0e6, 1.0]), (1, [3.0e6, 2.0]), (2, [3.0e6, 1.0 + 2**-8]), (3, [1.0e9, 1.0e9]), (4, [1.0e300, 0.0]), (5, [-3.0e6, 5.0])]
    t = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in exact_top_k(whole_vectors(t), F.col("vec_id") == 0, k=5).orderBy("rank").collect()]
    whole = {i: [int(256 * x) for x in v] for i, v in data if i not in (3, 4)}
    want = sorted((-sum(x * y for x, y in zip(whole[0], v, strict=True)), i) for i, v in whole.items() if i)
    assert got == [(0, n + 1, i, -s) for n, (s, i) in enumerate(want)]


def test_top_k_among_equal_vectors(spark):
    t = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(120)], "vec_id long, embedding array<double>")
    got = [tuple(r)[:3] for r in exact_top_k(whole_vectors(t), F.col("vec_id") % 50 == 0, k=3).orderBy("query_id", "rank").collect()]
    assert got == [(q, n + 1, i) for q, ids in ((0, (1, 2, 3)), (50, (0, 1, 2)), (100, (0, 1, 2))) for n, i in enumerate(ids)]


def test_top_k_in_many_blocks(spark, monkeypatch):
    from graphloom.llm import topk

    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(400, 12))
    t = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    whole = np.floor(vectors * 256).astype(np.int64)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in exact_top_k(whole_vectors(t), F.col("vec_id") % 50 == 0, k=5, nodes=3).collect()}
    for q in range(0, 400, 50):
        order = sorted((-int(whole[q] @ whole[i]), i) for i in range(400) if i != q)[:5]
        assert [got[q, n + 1] for n in range(5)] == [(i, -s) for s, i in order]


# the pipeline


def test_pipeline_is_its_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sizes, seen = [], docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, seen, sf_dir)
        assert after.columns == docs.columns
        seen = spark.createDataFrame(after.collect(), docs.schema)
        sizes.append(seen.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    held = QUERIES["op5_exact_dedup"](spark, sf_dir)
    ids = sorted(r.doc_id for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").collect())
    assert ids == sorted(r.doc_id for r in seen.collect()) and len(set(ids)) == len(ids)
    assert held.count() == table(spark, sf_dir, "documents").count()  # a run deletes what it stored itself
    assert corpus_pipeline.ORACLE_SQL is None
