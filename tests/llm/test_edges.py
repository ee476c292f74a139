"""Every operator on a table of odd rows: nulls in every column, empty and long texts, repeated rows, columns named as the operators' own."""

import pytest

import corpus_pipeline
from brontide.llm import decontam, dialogs, fuzzyhash, langid, licenses, linededup, minhash, mixing, mpeg, pii, search, substrings, toxicity

NAMES = ("row", "name", "key", "r", "c", "rep", "n", "marks", "node", "comp", "t", "id", "domain", "posteriors", "rate", "w", "rest", "gone_id", "lines", "items", "score", "base", "line_no", "h1", "media", "n_tokens")
TEXTS = [None, "", " \n\n ", "word", "the same line of words in two texts that repeat it here", "the same line of words in two texts that repeat it here\nand one more line", "mail a.b@c.org or 4111 1111 1111 1111", "you stupid clown", "x" * 200_000, "many words " * 20_000, "Released under the MIT License."]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "en" if k % 2 else None, *([None] * len(NAMES))) for k, t in enumerate(TEXTS)]
    rows += [(None, TEXTS[4], "en", *(["v"] * len(NAMES))), (None, None, None, *([None] * len(NAMES))), rows[4], rows[4]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"`{n}` string" for n in NAMES)).cache()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(k, k % 2, int(k == 7)) for k in range(len(TEXTS))] + [(None, 1, 1), (3, None, None)]
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, quality int, toxic int, text string")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "one more line"), (None, "word"), (2, None), (2, "")], "item_id long, text string")


def run(name, docs, labels, bench):
    return {
        "language": lambda: langid.identify(docs, langid.fit(docs)),
        "decontamination": lambda: decontam.decontaminate(docs, bench),
        "audio": lambda: mpeg.audio_columns(mpeg.to_media(docs)),
        "toxicity": lambda: toxicity.score(docs, toxicity.fit(docs, labels)),
        "near": lambda: minhash.near_duplicates(docs),
        "mixing": lambda: mixing.mix(docs, labels),
        "substrings": lambda: substrings.dedup_substrings(docs),
        "licenses": lambda: licenses.scan_licenses(docs),
        "pii": lambda: pii.find_pii(docs, pii.train([], steps=3, made=60)),
        "lines": lambda: linededup.dedup_lines(docs),
        "hashes": lambda: fuzzyhash.edited(docs),
    }[name]()


ALL = ("language", "decontamination", "audio", "toxicity", "near", "mixing", "substrings", "licenses", "pii", "lines", "hashes")


@pytest.mark.parametrize("name", ALL)
def test_odd_rows_get_a_row_each(odd, labels, bench, name):
    assert len(run(name, odd, labels, bench).collect()) == odd.count()


@pytest.mark.parametrize("name", ALL)
def test_empty_tables(odd, labels, bench, name):
    assert run(name, odd.limit(0), labels.limit(0), bench.limit(0)).collect() == []


@pytest.mark.parametrize("step", range(5))
def test_stages_on_odd_rows(spark, odd, labels, bench, tmp_path, step):
    name, stage = corpus_pipeline.STAGES[step]
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    bench.write.parquet(f"file://{tmp_path}/benchmark.parquet")
    out = stage(spark, odd, f"file://{tmp_path}")
    assert out.columns[: len(odd.columns)] == odd.columns and (step == 4 or out.columns == odd.columns)
    assert 0 < len(out.collect()) <= odd.count()


def test_verdicts(odd, labels, bench):
    near = {r["doc_id"]: r for r in minhash.near_duplicates(odd).collect()}
    assert near[None]["kept"] and near[None]["component_id"] is None and near[4]["n_shingles"] == 10
    hit = {r["doc_id"]: r["contaminated"] for r in decontam.decontaminate(odd, bench).collect()}
    assert hit[5] and not hit[3]
    gone = sorted((r["doc_id"] or -1, r["n_removed"]) for r in linededup.dedup_lines(odd).where("doc_id in (4, 5) or doc_id is null").collect())
    assert gone == [(-1, 0), (-1, 0), (4, 1), (4, 1), (4, 1), (5, 1)]
    found = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(odd).collect()}
    assert found[10] == "mit" and found[0] == ""


def test_search_of_odd_rows(odd, bench):
    """Words of an item are found in every row that has them, repeated ones each; null and empty items find nothing."""
    found = search.search(odd, bench.withColumn("rank", bench["text"])).collect()
    assert {r["item_id"] for r in found} == {1, None}
    assert sorted(r["doc_id"] or -1 for r in found if r["item_id"] == 1) == [-1, 4, 4, 4, 5] and {r["doc_id"] for r in found if r["item_id"] is None} == {3}


def test_conversations_of_odd_rows(spark):
    """Columns named as the operator's own are ignored; a row for each conv_id, null too."""
    names = ("piece", "kind", "place", "told", "edit", "symbol", "n", "first", "costs", "audit", "sha")
    rows = [(c, t, r, x, *([None] * len(names))) for c, t, r, x in ((1, 1, "user", "a" * 2_000_000), (1, None, None, None), (None, 2, "assistant", "Yes."), (None, 2, "assistant", "Yes."), (2, 5, "", ""))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = {r["conv_id"]: r for r in dialogs.repair(df).collect()}
    assert set(got) == {1, 2, None} and got[None]["duplicate"] == 1 and got[1]["blank"] == 1 and got[1]["truncated"] == 1 and got[2]["audit"] == "D"
    assert len(dialogs.repair(df, dialogs.damage(df)).collect()) == 3
