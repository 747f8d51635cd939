"""Exact, near and substring deduplication: brute force on real rows, and odd inputs."""

import collections
import hashlib
import random

import numpy as np
import pytest

from graphloom.llm.common import table
from graphloom.llm.components import connected_components
from graphloom.llm.exact_dedup import drop_exact_copies, exact_dedup, rice_decode, rice_encode
from graphloom.llm.ngram_join import drop_near_copies, ngram_join
from graphloom.llm.queries_dedup import ORACLE_SQL, QUERIES
from graphloom.llm.substring_dedup import paragraph_links, repeated_passages, without_repeats
from tests.compare import connection, rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, list string, owner int, key long, n int, component long"


def frame(spark, texts):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, None, None, None, "x", 1, 2, 3, 4) for i, t in texts], SCHEMA)


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, k=4):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def linked(x, y):
    both = len(x & y)
    return bool(x) and bool(y) and 100 * both >= 85 * (len(x) + len(y) - both)


def link_counts(texts):
    sets = [(i, shingles(t)) for i, t in texts]
    return {i: sum(linked(own, other) for j, other in sets if i != j) for i, own in sets}


def components_of(texts):
    sets = {i: shingles(t) for i, t in texts}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_op5_equals_sql(spark, sf_dir):
    con = connection(sf_dir)
    assert rows(QUERIES["op5_exact_dedup"](spark, sf_dir).toPandas()) == rows(con.sql(ORACLE_SQL["op5_exact_dedup"]).df())


def test_rice_codes_go_back():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        values = np.unique(rng.integers(0, 1 << 40, size=n, dtype=np.uint64))
        assert (rice_decode(rice_encode(values)) == values).all()


def test_exact_dedup_of_odd_rows(spark):
    texts = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "ab"), (6, "a  b"), (7, "x" * 300_000), (8, "x " * 300_000), (9, "é"), (9, "é"), (None, "ab")]
    got = {(r.doc_id, r.n_chars): r for r in exact_dedup(frame(spark, texts)).collect()}
    assert {i: (r.keep_id, r.group_size) for (i, _), r in got.items()} == {1: (3, 3), 2: (3, 3), 3: (3, 3), 4: (6, 3), 5: (6, 3), 6: (6, 3), 7: (8, 2), 8: (8, 2), 9: (9, 2)}
    assert got[4, 3].text_sha256 == hashlib.sha256(b"ab").hexdigest()
    assert exact_dedup(frame(spark, texts)).filter("doc_id = 9 and kept").count() == 1
    assert sorted((r.doc_id or 0) for r in drop_exact_copies(frame(spark, texts)).collect()) == [0, 3, 6, 8, 9]
    assert exact_dedup(frame(spark, [])).count() == 0




def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (3, 2)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 150)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_op2_equals_brute_force(spark, sf_dir):
    texts = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    want = components_of(texts)
    found = QUERIES["op2_ngram_join"](spark, sf_dir).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    assert {r.doc_id: r.n_links for r in found} == link_counts(texts)


def test_op2_of_a_large_group_of_near_copies(spark):
    """A group whose lists are long: some pairs are linked, others aren't, and leaders alone don't connect it."""
    rnd = random.Random(4)
    base = [f"w{rnd.randrange(10_000)}" for _ in range(80)]
    texts = []
    for i in range(300):
        own = list(base)
        for _ in range(rnd.randrange(0, 6)):
            own[rnd.randrange(80)] = f"v{rnd.randrange(10_000)}"
        texts.append((i, " ".join(own)))
    texts += [(1000, texts[5][1]), (1001, texts[5][1])]
    found = ngram_join(frame(spark, texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == components_of(texts)
    assert {r.doc_id: r.n_links for r in found} == link_counts(texts)


def test_op2_of_a_large_group_in_many_blocks(spark, monkeypatch):
    from graphloom.llm import ngram_join as join

    monkeypatch.setattr(join, "BLOCK", 2000)
    monkeypatch.setattr(join, "SHORT_LIST", 8)
    monkeypatch.setattr(join, "LEADERS", 1)
    rnd = random.Random(5)
    texts = []
    for group in range(3):
        base = [f"g{group}w{rnd.randrange(10_000)}" for _ in range(60)]
        for i in range(60):
            own = base[: 60 - rnd.randrange(12)]
            for _ in range(rnd.randrange(0, 3)):
                own[rnd.randrange(len(own))] = f"v{rnd.randrange(10_000)}"
            texts.append((group * 100 + i, " ".join(own)))
    found = ngram_join(frame(spark, texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == components_of(texts)
    assert {r.doc_id: r.n_links for r in found} == link_counts(texts)


def test_rows_that_share_a_doc_id_are_not_lost(spark):
    texts = [(1, "a b c d e"), (1, "f g h i j"), (2, "a b c d e"), (3, "k l m n o"), (3, "k l m n o"), (4, "f g h i j")]
    found = ngram_join(frame(spark, texts)).collect()
    assert sorted(r.doc_id for r in found) == [1, 1, 2, 3, 3, 4] and sum(r.component_id == 1 for r in found) == 3
    left = sorted((r.doc_id, r.text) for r in drop_near_copies(frame(spark, texts)).collect())
    assert {(1, "a b c d e"), (1, "f g h i j")} <= set(left) and len(left) == 5
    texts = [(1, "a"), (1, "b"), (2, "a"), (2, " a"), (3, "c"), (3, "c")]
    assert sorted((r.doc_id, r.text) for r in drop_exact_copies(frame(spark, texts)).collect()) == [(1, "b"), (2, " a"), (3, "c")]
    assert sum(r.kept for r in exact_dedup(frame(spark, texts)).collect()) == 3


def test_op2_of_odd_rows(spark):
    texts = [(5, None), (6, ""), (1, "one two"), (2, "ONE  two"), (3, "one two three"), (8, "a b c d"), (7, "A b\tc d"), (9, "z " * 100_000), (10, "z " * 90_000), (4, "é É x y"), (4, "é É x y"), (None, "a b c d")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(frame(spark, texts)).collect()}
    assert got == {5: (0, 5), 6: (0, 6), 1: (1, 1), 2: (1, 1), 3: (1, 3), 8: (1, 7), 7: (1, 7), 9: (1, 9), 10: (1, 9), 4: (1, 4)}
    assert sorted((r.doc_id or 0) for r in drop_near_copies(frame(spark, texts)).collect()) == [0, 1, 3, 4, 4, 5, 6, 7, 9]
    assert ngram_join(frame(spark, [])).count() == 0


@pytest.fixture(scope="module")
def prose():
    rnd = random.Random(9)
    return lambda n: [f"w{rnd.randrange(5_000)}" for _ in range(n)]


def test_op1_finds_every_long_repeat_and_nothing_else(spark, sf_dir):
    texts = {r.doc_id: words(r.text) for r in table(spark, sf_dir, "documents").collect()}

    def repeated(n):
        found = collections.defaultdict(set)
        for i, w in texts.items():
            for k in range(len(w) - n + 1):
                found[tuple(w[k : k + n])].add(i)
        return {i for s in found.values() if len(s) > 1 for i in s}

    got = {r.doc_id for r in QUERIES["op1_substring_dedup"](spark, sf_dir).collect()}
    assert repeated(51) <= got <= repeated(32)


def test_op1_of_a_passage_inside_lines(spark, prose):
    passage, texts = prose(55), []
    for i in range(6):
        texts.append((i, " ".join(prose(40) + passage + prose(30))))
    texts += [(i, " ".join(prose(120))) for i in range(6, 12)] + [(20, None), (21, ""), (22, "short"), (None, " ".join(passage))]
    found = repeated_passages(frame(spark, texts)).collect()
    assert {r.doc_id for r in found} == set(range(6)) and {r.doc_id for r in found if r.kept} == {0}
    assert len({r.cluster_id for r in found}) == 1 and all(32 <= r.n_words <= 55 for r in found)
    left = {r.doc_id: r.text for r in without_repeats(frame(spark, texts)).collect()}
    assert left[0] == texts[0][1] and len(words(left[1])) <= 125 - 32 and left[20] is None
    assert repeated_passages(frame(spark, [])).count() == 0


def test_op1_of_near_copies_of_a_paragraph(spark, prose):
    # any two differ in two words of 130: 10 of 126 shingles each way, a similarity of 0.85
    base = prose(130)
    texts = []
    for i in range(4):
        own = list(base)
        own[10 + 12 * i] = f"changed{i}"
        texts.append((i, " ".join(prose(20)) + "\n" + " ".join(own) + "\n" + " ".join(prose(20))))
    found = repeated_passages(frame(spark, texts)).collect()
    assert {r.doc_id for r in found} == {0, 1, 2, 3}


def test_op1_of_hard_wrapped_paragraphs(spark, prose):
    # 60 words over lines of 10; one word near the middle differs, so no 32 words in a row are equal
    base = prose(60)
    texts = []
    for i in range(3):
        own = list(base)
        own[30] = f"changed{i}"
        wrapped = "\n".join(" ".join(own[k : k + 10]) for k in range(0, 60, 10))
        texts.append((i, " ".join(prose(40)) + "\n \n" + wrapped + "\n\n" + " ".join(prose(40))))
    found = repeated_passages(frame(spark, texts)).collect()
    assert {(r.doc_id, r.start_word, r.end_word, r.kept) for r in found} == {(i, 40, 100, i == 0) for i in range(3)}


def test_op1_links_what_meets_in_a_large_group(spark, prose):
    """Lines with one template meet in large groups of the bands; only the two with one ending are similar, and mostly no leaders."""
    template, texts = prose(200), []
    for i in range(120):
        ending = prose(30)
        other = list(template)
        for k in range(4):
            other[20 + 40 * k + i % 20] = f"changed{i}x{k}"
        texts += [(2 * i, " ".join(template + ending)), (2 * i + 1, " ".join(other + ending))]
    lines, links = paragraph_links(frame(spark, texts).select("doc_id", "text"))
    owner = {r.digest: r.doc_id for r in lines.collect()}
    assert {tuple(sorted((owner[r.a], owner[r.b]))) for r in links.collect()} == {(2 * i, 2 * i + 1) for i in range(120)}


def test_op1_ignores_repeats_within_one_document(spark, prose):
    line = " ".join(prose(50))
    assert repeated_passages(frame(spark, [(1, f"{line}\n{line}"), (2, " ".join(prose(60)))])).count() == 0
