"""Piecewise hashes against a loop over bytes, likeness against a table of edit distances."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from brontide.llm import fuzzyhash as fz
from tests.llm.util import docs_of

M = (1 << 64) - 1


def mixed(x: int) -> int:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ (x >> shift)) * factor) & M
    return x ^ (x >> 31)


def by_loop(text: str) -> str:
    data = text.encode()
    code = [int(fz._BYTE[b]) for b in data]
    size = 3
    while size * fz.USUAL < len(data):
        size *= 2
    out = [str(size)]
    for j in range(fz.LEVELS):
        chunks, start = [], 0
        for i in range(len(data)):
            rolled = sum(code[i - k] * pow(int(fz._ROLL), k, 1 << 64) for k in range(min(fz.ROLL, i + 1))) & M
            if (((mixed(rolled) >> 32) + 1) % (size << j) == 0 and len(chunks) < fz.MOST - 1) or i == len(data) - 1:
                h = sum(code[p] * pow(int(fz._STEP), p - start, 1 << 64) for p in range(start, i + 1)) + i - start
                chunks.append(chr(fz._LETTERS[mixed(h & M) >> 58]))
                start = i + 1
        out.append("".join(chunks))
    return ":".join(out)


def distance(a: str, b: str) -> int:
    """Edits that insert or delete; a replacement is both."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] if x == y else M))
        row = new
    return row[-1]


def like(one: str, other: str) -> float:
    (p, *a), (q, *b) = one.split(":"), other.split(":")
    if not a[0] and not b[0]:
        return 1.0
    best = 0.0
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            run = min(fz.RUN, len(x), len(y))
            if int(p) << i == int(q) << j and run and any(x[k : k + run] in y for k in range(len(x) - run + 1)):
                best = max(best, 1 - distance(x, y) / (len(x) + len(y)))
    return best


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdeéß漢"), int(rng.integers(1, 9)))) for _ in range(300)]
    return ["", "a", "ab", "x" * 900, "line of words\n" * 60] + [" ".join(rng.choice(words, int(rng.integers(1, 400)))) for _ in range(25)]


def test_same_as_a_loop_over_bytes(texts):
    got = fz.written_out(*fz.of_texts(pa.array(texts)))
    assert got == [by_loop(t) for t in texts]
    again = fz.read(got)
    assert fz.written_out(*again) == got


def test_likeness_is_the_edit_distance(texts):
    halves = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, texts[1:] + texts[:1], strict=True)]
    one, other = (fz.written_out(*fz.of_texts(pa.array(x))) for x in (texts, halves))
    for a, b in ((one, other), (one, one[::-1]), (one, one)):
        assert np.allclose(fz.likeness(fz.read(a), fz.read(b)), [like(x, y) for x, y in zip(a, b, strict=True)])
    assert (fz.likeness(fz.read(one), fz.read(one)) == 1).all()


def test_edited_texts_stay_near(texts):
    prose = texts[5:]
    halves = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(prose, prose[1:] + prose[:1], strict=True)]
    one, other = (fz.of_texts(pa.array(x)) for x in (prose, halves))
    after = tuple(np.roll(x, -1, axis=0) for x in one)
    assert (fz.likeness(one, other) > fz.likeness(one, after)).mean() > 0.9


def test_documents_follow_each_other(spark, texts):
    rows = spark.createDataFrame([(k * 3 % 31, t, "x") for k, t in enumerate(texts)] + [(None, "first of all", "y"), (7, "twin", None), (7, "twin", None), (8, None, None)], "doc_id long, text string, part string")
    got = fz.edited(rows.repartition(6)).collect()
    order = sorted(((r["doc_id"], r["text"]) for r in rows.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = []
    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        t, u = t or "", u or ""
        e = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        a, b, c = (by_loop(x) for x in (t, e, u))
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, round(like(a, b), 9), round(like(a, c), 9)))
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9))) for r in got)


def test_few_rows(spark):
    assert fz.edited(docs_of(spark, [])).collect() == []
    (only,) = fz.edited(docs_of(spark, ["alone as it is"])).collect()
    assert only["n_chars"] == 14 and only["near_next"] == 1.0
    pairs = fz.compare(fz.fingerprints(docs_of(spark, ["same text", None])).withColumn("other", fz.F.lit("3::::").substr(1, 4)), "fingerprint", "other").orderBy("doc_id").collect()
    assert [r["likeness"] for r in pairs] == [0.0, 1.0] and pairs[1]["n_bytes"] == 0


def test_long_text(spark):
    rng = np.random.default_rng(3)
    long = " ".join(str(x) for x in rng.integers(0, 10**6, 400_000))
    got = {r["doc_id"]: r for r in fz.edited(docs_of(spark, [long, long + " end"])).collect()}
    assert got[0]["near_next"] > 0.9 and got[0]["n_chars"] == len(long)
