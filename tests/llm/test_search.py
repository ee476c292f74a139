"""Ranked search against SQL and against scoring of every document."""

import math
import re

import numpy as np

from brontide.llm import search
from tests.llm.util import both, docs_of, equal

WORDS = "the of and a river stone light über naïve 漢字 x1 42 blue green deep cold old new".split()


def texts(n: int, seed: int, long: int = 60) -> list:
    rng = np.random.default_rng(seed)
    odd = [None, "", " \n", "...", "THE The the", "the\x00of", "a" * 50_000, "river " * 30_000]
    return odd + [" ".join(rng.choice(WORDS, int(rng.integers(1, long)), p=rng.dirichlet(np.ones(len(WORDS))))) for _ in range(n)]


def ranked(docs: list, items: list, top: int) -> list:
    """Every document scored by the formula."""
    terms = lambda t: [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    all_ = [terms(t) for t in docs]
    n_docs, length = sum(map(bool, all_)), sum(map(len, all_))
    out = []
    for i, item in enumerate(items):
        own = []
        for d, words in enumerate(all_):
            score = 0
            for t in set(terms(item)):
                df, tf = sum(t in w for w in all_), words.count(t)
                if tf:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                    score += w * ((10**9 * tf) // (1000 * tf + 20 * (50 + (50 * len(words) * n_docs) // length)))
            if score > 0:
                own.append((-score, d))
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(own)[:top])]
    return out


def test_same_as_sql(spark, tmp_path):
    docs = texts(300, 1) + ["cold river stone"] * 120
    items = spark.createDataFrame([(k, t) for k, t in enumerate(texts(12, 2))] + [(3, "old"), (3, "old"), (90, "unheard words")], "item_id long, text string").dropDuplicates()
    got, want = both(spark, tmp_path, "op11_wand_search", documents=docs_of(spark, docs).repartition(5), benchmark=items)
    assert len(got) > 300 and equal(got, want)


def test_same_as_every_document_scored_whatever_the_sizes(spark):
    docs, items = texts(200, 3, 25), texts(9, 4, 12)
    want = ranked(docs, items, 7)
    table, asked = docs_of(spark, docs).repartition(3), spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    for sizes in ({}, {"postings": 150}, {"block_terms": 20_000}, {"seed": 1}):
        got = search.search(table, asked, top=7, **sizes).collect()
        assert sorted(tuple(r) for r in got) == want


def test_odd_rows(spark):
    rows = spark.createDataFrame([(None, "river", 1), (None, "river", 1), (5, "river", 2), (4, "river", 3), (4, "stone", 4)], "doc_id long, text string, rank int")
    got = search.search(rows, spark.createDataFrame([(None, "RIVER", "x"), (1, None, "y")], "item_id long, text string, doc_id string")).orderBy("rank").collect()
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in got] == [(None, 1, None), (None, 2, None), (None, 3, 4), (None, 4, 5)]
    none = spark.createDataFrame([], "doc_id string, text string")
    assert search.search(none, none.withColumnRenamed("doc_id", "item_id")).collect() == []
    assert search.search(none, spark.createDataFrame([(1, "a")], "item_id long, text string")).collect() == []


def test_pivots_skip_documents():
    """With a demand that only rare terms reach, documents of common terms alone are not scored."""
    rng = np.random.default_rng(5)
    doc, term = np.nonzero(rng.random((4000, 3)) < [0.9, 0.9, 0.01])
    shard = search.Shard(np.full(4000, 10), doc, term, np.ones(len(doc), dtype=np.int64), np.array([5, 5, 4000]), 4000, 40_000)
    rare = set(doc[term == 2].tolist())
    found = shard.search([np.arange(3)], [np.full(5, 5_000_000)], 5)
    assert set(found[0][0].tolist()) <= rare and len(rare) < 80
