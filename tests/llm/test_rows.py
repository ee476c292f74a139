"""Tables whose doc_ids are null or repeat with other texts, against brute force."""

import hashlib
import random
from collections import Counter

import pytest

from brontide.llm import linededup, minhash, substrings

SCHEMA = "doc_id long, text string"


def line(rng, n, words=60):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def test_a_line_that_occurs_once_stays_whatever_its_row(spark):
    rows = [(1, "first line with some plain words"), (2, "first line with some plain words"), (2, "wholly different line of unique content here")]
    got = sorted((r["doc_id"], r["n_removed"], r["text"]) for r in linededup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 0, rows[0][1]), (2, 0, rows[2][1]), (2, 1, "")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lines_of_repeated_and_null_ids(spark, seed):
    """Every line, and only such, goes that has an earlier copy or near copy in another row or before it in its own."""
    rng = random.Random(seed)
    base = [line(rng, n) for n in (2, 4, 5, 5, 6, 7, 8, 9, 10, 11, 15, 16, 17, 40)] + ["漢字" * 15, "短い", "averyveryverylongword"]

    def edit(t):
        words = t.split()
        k, how = rng.randrange(len(words)), rng.randrange(3)
        words[k : k + 1] = [] if how == 0 else ["new"] if how == 1 else ["new", words[k]]
        return " ".join(words)

    rows = []
    for _ in range(60):
        own = [rng.choice(base) for _ in range(rng.choice((1, 2, 3)))]
        own = [edit(t) if rng.random() < 0.5 else t for t in own]
        rows.append((rng.choice((None, 1, 2, 3, *range(4, 60))), "\n".join(own)))
    rows += [rows[0], rows[1], (None, None), (7, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    named = {(r["doc_id"], r["text"]): r["t"] for r in df.selectExpr("*", "xxhash64(text) t").collect()}
    rank = {key: k for k, key in enumerate(sorted(named, key=lambda x: (x[0] is not None, x[0] or 0, named[x])))}
    places = []
    for (d, t), r in rank.items():
        for k, x in enumerate((t or "").split("\n")):
            words = x.split()
            if len(words) >= 5 or len("".join(words)) >= 20:
                places.append((r, k, words))
    gone = {(r, k) for r, k, w in places if any((a, b) < (r, k) and (w == v or max(len(w), len(v)) >= 5 and one_edit(v, w)) for a, b, v in places)}
    want = Counter((d, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (rank[d, t], k) not in gone)) for d, t in rows)
    assert Counter((r["doc_id"], r["text"]) for r in linededup.dedup_lines(df).collect()) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_of_repeated_and_null_ids(spark, seed):
    """A row each; documents hang together by the links of all their texts."""
    rng = random.Random(seed)
    base = [line(rng, 60, 500) for _ in range(8)]
    rows = [(2, "a b c d"), (1, "a b c d"), (2, "e f g h"), (3, "e f g h"), (2, "")]
    for _ in range(50):
        words = rng.choice(base).split()
        for _ in range(rng.choice((0, 1, 2, 3))):
            words[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((rng.choice((None, *range(10, 50))), " ".join(words)))
    rows.append(rows[-1])
    sets = [{tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for _, t in rows]
    comp = {d: d for d, _ in rows if d is not None}
    for _ in rows:
        for (a, _), x in zip(rows, sets, strict=True):
            for (b, _), y in zip(rows, sets, strict=True):
                if a is not None and b is not None and x and y and 100 * len(x & y) >= 85 * len(x | y):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = Counter(tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == Counter((d, len(s), comp.get(d), d is None or comp[d] == d) for (d, _), s in zip(rows, sets, strict=True))


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_of_repeated_and_null_ids(spark, seed):
    rng = random.Random(seed)
    base = [line(rng, n, 3000) for n in (36, 40, 50, 80)] + ["na " * 60, "ab cd " * 40, "a b c " * 30]
    rows = [(None, line(rng, 60, 3000)), (None, line(rng, 60, 3000)), (None, line(rng, 37, 3000)), (-1, line(rng, 37, 3000)), (-1, base[0])]
    for _ in range(40):
        parts = [rng.choice(base) if rng.random() < 0.3 else line(rng, rng.choice((3, 20, 60)), 3000) for _ in range(3)]
        rows.append((rng.choice((None, -1, 1, 2, 3)), " ".join(parts)))
    rows += [rows[0], rows[7], (None, None), (5, "")]
    windows = Counter()
    for _, t in rows:
        w = (t or "").split()
        windows.update(tuple(w[k : k + 35]) for k in range(len(w) - 34))
    want = Counter()
    for d, t in rows:
        w = (t or "").split()
        gone = {j for k in range(len(w) - 34) if windows[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        want[d, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in substrings.dedup_substrings(spark.createDataFrame(rows, SCHEMA)).collect()) == want
