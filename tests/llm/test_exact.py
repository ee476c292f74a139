"""Operators that SQL can express, on small tables full of the cases that go wrong."""

import random

import pytest

from tests.llm.util import both, docs_of, equal

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n))


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        k = rng.randrange(len(words))
        how = rng.randrange(3)
        words[k : k + 1] = [] if how == 0 else [f"new{rng.randrange(99)}"] if how == 1 else [words[k], f"new{rng.randrange(99)}"]
    return " ".join(words)


ODD = [None, "", " ", "\n\n", "word", "two words", "\t tab\x0bvertical\x0cfeed ", "é ü ñ 漢字 words", "A" * 5000, "na " * 120, "na " * 34, "na " * 36, "ab cd " * 60]


def corpus(seed):
    rng = random.Random(seed)
    many = [f"w{k}" for k in range(400)]
    base = [prose(rng, rng.choice((8, 20, 45, 90)), rng.choice((WORDS, many))) for _ in range(12)]
    texts = list(ODD) + base
    for b in base:
        texts += [b] * rng.choice((0, 1, 3)) + [edited(rng, b, rng.choice((1, 2, 5))) for _ in range(3)]
    passage = prose(rng, 40, many)
    texts += [prose(rng, 10, many) + " " + passage + " " + prose(rng, 10, many) for _ in range(4)]
    texts += ["\n".join(rng.choice(base) for _ in range(4)) for _ in range(6)]
    texts.append(prose(rng, 3000, many) + " " + passage)
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("name", ["op5_minhash_dedup", "op7_substring_dedup", "op8_license_scan", "op10_line_dedup"])
@pytest.mark.parametrize("seed", [1, 2])
def test_matches_sql(spark, tmp_path, name, seed):
    texts = corpus(seed)
    if name == "op8_license_scan":
        notices = ["Released under the MIT License.", "licensed under  the Apache LICENSE version 2.0", "Licensed under CC BY-NC 4.0. Released under the MIT license!", "This work is licensed under the GNU General Public License, version", "Released, under"]
        texts = [f"{t or ''} {n} {t or ''}" for t, n in zip(texts, notices * 9, strict=False)] + texts[:9]
    got, want = both(spark, tmp_path, name, documents=docs_of(spark, texts))
    assert equal(got, want), (got[(got != want).any(axis=1)], want[(got != want).any(axis=1)])


def test_decontamination_matches_sql(spark, tmp_path):
    rng = random.Random(4)
    items = [prose(rng, n) for n in (3, 9, 10, 11, 30)] + ["", None, "One-word", prose(rng, 30)]
    texts = [*ODD, *(f"{prose(rng, 5)} {i} {prose(rng, 5)}" for i in items if i), items[4].upper(), " ".join(items[4].split()[3:14]), prose(rng, 2000)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got, want = both(spark, tmp_path, "op2_decontamination", documents=docs_of(spark, texts), benchmark=bench)
    assert equal(got, want)


@pytest.mark.parametrize("name", ["op5_minhash_dedup", "op7_substring_dedup", "op8_license_scan", "op10_line_dedup"])
def test_empty_table(spark, tmp_path, name):
    got, want = both(spark, tmp_path, name, documents=docs_of(spark, []))
    assert len(got) == 0 and len(want) == 0


@pytest.mark.parametrize("strays", [0, 5, 1000])
def test_a_large_group_of_near_copies_is_linked_exactly(spark, strays):
    """Strays by pairs and by blocks, checked by brute force."""
    from brontide.llm import minhash

    rng = random.Random(8)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for _ in range(120):
        own = list(base)
        for _ in range(rng.choice((0, 1, 1, 2, 3, 4))):
            own[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    small = minhash.BLOCK, minhash.STRAYS
    minhash.BLOCK, minhash.STRAYS = 16, strays
    try:
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs_of(spark, texts)).collect()}
    finally:
        minhash.BLOCK, minhash.STRAYS = small
    sets = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in texts]
    parent = list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    assert got == {k: root(k) for k in range(len(texts))}


def test_benchmark_in_several_blocks(spark):
    from brontide.llm import decontam

    rng = random.Random(5)
    items = [prose(rng, 30, [f"w{k}" for k in range(900)]) for _ in range(12)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = docs_of(spark, [f"{a} filler {b}" for a, b in zip(items, items[1:], strict=False)] + ["clean text", None])
    docs = docs.unionAll(docs.limit(2))
    one = decontam.decontaminate(docs, bench).toPandas().sort_values("doc_id", ignore_index=True)
    more = decontam.decontaminate(docs, bench, block_words=60).toPandas().sort_values("doc_id", ignore_index=True)
    assert one.equals(more) and len(one) == 15 and one["contaminated"].sum() == 13
