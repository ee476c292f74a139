import math
import random

import corpus_pipeline
from brontide.llm import linededup, minhash
from tests.llm.util import docs_of, put


def tables(spark, folder, texts):
    from tests.llm.util import DOCS

    rng = random.Random(1)
    docs = spark.createDataFrame([(k, t, "en" if k % 2 else "xx", "s") for k, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(k, k % 2, int(rng.random() < 0.2)) for k in range(len(texts))], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve")], "item_id long, text string")
    return put(spark, folder, documents=docs, labels=labels, benchmark=bench)


def test_stages(spark, tmp_path):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(("the", "an", "or", "ing", "wh")) for _ in range(3))
    clean = ["\n".join(" ".join(word() for _ in range(12)) for _ in range(4)) for _ in range(30)]
    clean[2] += "\nShort. End."
    clean[3] = "Too short."
    texts = [*clean, clean[0], clean[0], clean[2], clean[2], None, "", "123", clean[1] + "\n" + "One two three four five six seven, eight nine ten eleven twelve."]
    out = corpus_pipeline.run(spark, tables(spark, tmp_path, texts))
    kept = {r["doc_id"]: r["text"] for r in out.collect()}
    assert set(range(30)) <= set(kept) and set(kept) <= set(range(30))
    assert {"doc_id", "text", "lang", "source", "rate"} <= set(out.columns)
    assert all(kept[k] == clean[k] for k in range(30))


def test_lines_keep_other_columns_whatever_their_names(spark):
    line = "a line of some ten words that two documents here share"
    df = spark.createDataFrame([(1, line, "r", 5), (2, line + "\nmore", "c", 6), (2, line + "\nmore", "c", 6), (None, line, "x", 7), (4, None, "y", 8)], "doc_id long, text string, gone_lines string, n_lines int")
    got = sorted(linededup.dedup_lines(df).collect(), key=str)
    assert [c for c in linededup.dedup_lines(df).columns] == ["doc_id", "text", "gone_lines", "n_lines", "_n_lines", "n_removed"]
    by = {r["doc_id"]: (r["text"], r["n_removed"]) for r in got}
    assert len(got) == 5 and by[None] == (line, 0) and by[1] == ("", 1) and by[2] == ("more", 1) and by[4] == (None, 0)


def test_whole_run_on_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, [])).count() == 0


def test_docs_helper(spark):
    assert docs_of(spark, ["a"]).count() == 1


def test_near_stage_drops_copies_with_a_passage_added_cut_or_replaced(spark):
    words = [f"w{k}" for k in range(200)]
    added, cut, other = words + [f"x{k}" for k in range(44)], words[:100] + words[130:], words[:90] + [f"y{k}" for k in range(16)] + words[106:]
    far = words + [f"z{k}" for k in range(52)]
    docs = docs_of(spark, [" ".join(w) for w in (words, added, cut, other, far)])
    assert {r["doc_id"] for r in corpus_pipeline.near_stage(spark, docs, "").collect()} == {0, 4}


def test_the_match_threshold_follows_the_least_similarity():
    assert minhash.least_matches(85, 100) == 39 and minhash.least_matches(80, 100) == 35
    for over in range(30, 100, 5):
        s, m = over / 100, minhash.least_matches(over, 100)
        assert sum(math.comb(minhash.COORDS, k) * s**k * (1 - s) ** (minhash.COORDS - k) for k in range(m)) <= minhash.MISS


def test_line_stage_keeps_what_is_left_of_short_lines(spark):
    foot = "a footer of seven words or so"
    page = "\n".join(f"clean {k}" for k in range(200))
    verse = "\n".join("漢字" * 20 + str(k) for k in range(5))
    texts = [foot, f"{page}\n{foot}", f"{foot}\n{verse}", foot, f" \n{foot}\n", f"{page}\n{foot}", None, ""]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_stage(spark, docs_of(spark, texts), "").collect()}
    assert got == {0: foot, 1: page, 2: verse, 6: None, 7: ""}


def test_each_stage_against_brute_force(spark, tmp_path):
    """What the stages between language and mixing keep, each judged on its own input, on documents full of copies, near copies and passages."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(700)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    bench = [line(14), line(30), "seven words make one window of themselves"]
    shared = [line(n) for n in (5, 6, 9, 12, 30)]
    base = ["\n".join(line(rng.choice((4, 8, 20))) for _ in range(rng.choice((1, 3, 8)))) for _ in range(25)]

    def edited(text):
        own = text.split(" ")
        for _ in range(rng.choice((0, 1, 2, 6))):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        return " ".join(own)

    texts = [*base, *(edited(t) for t in base), *(edited(t) for t in base[:9]), *(f"{rng.choice(base)}\n{rng.choice(shared)}" for _ in range(12)), *shared]
    texts += [f"{line(6)} {' '.join(b.split()[k : k + 11])} {line(6)}" for b in bench for k in (0, 2)] + [base[0], base[1], None, "", "\n\n", "End."]
    where = tables(spark, tmp_path, texts)
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.mode("overwrite").parquet(f"{where}/benchmark.parquet")

    def edit_apart(a, b):
        a, b = sorted((a, b), key=len)
        return len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1 or len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    def lines_left(rows):
        seen, whole, out = [], set(), {}
        for d, t in sorted(rows.items()):
            kept, lost = [], False
            for x in (t or "").split("\n"):
                w = x.split()
                told = len(w) >= 5 or len("".join(w)) >= 20
                gone = told and any(w == v or max(len(w), len(v)) >= 5 and edit_apart(v, w) for v in seen)
                lost |= gone
                kept += [] if gone else [x]
                seen += [w] if told else []
            if (t or "").split() and t in whole:
                kept, lost = [], True
            whole.add(t)
            left = t if not lost else "\n".join(kept)
            if not lost or left.split():
                out[d] = left
        return out

    def near_left(rows):
        sets = {}
        for d, t in rows.items():
            w = (t or "").split()
            sets[d] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
        comp = {d: d for d in rows}
        for _ in rows:
            for a in rows:
                for b in rows:
                    if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                        comp[a] = comp[b] = min(comp[a], comp[b])
        return {d: t for d, t in rows.items() if comp[d] == d}

    def clean_left(rows):
        wanted = {tuple(w[k : k + 10]) for w in (b.split() for b in bench) for k in range(max(1, len(w) - 9))}
        hit = lambda w: any(tuple(w[k : k + n]) in wanted for n in (7, 10) for k in range(len(w) - n + 1))
        return {d: t for d, t in rows.items() if not hit((t or "").split())}

    docs = spark.read.parquet(f"{where}/documents.parquet")
    for (name, stage), brute in zip(corpus_pipeline.STAGES[1:4], (lines_left, near_left, clean_left), strict=True):
        rows = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = corpus_pipeline.written(stage(spark, docs, where))
        got = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert got == brute(rows) and 0 < len(got) < len(rows), name
    rated = corpus_pipeline.mixing_stage(spark, docs, where)
    assert {r["doc_id"]: r["text"] for r in rated.collect()} == got
