"""Operator 2 - benchmark decontamination by winnowing.

Both sides keep the minimum k-gram hash of every sliding run of ``window - k + 1`` k-grams, so two
texts that share ``window`` consecutive words always share a fingerprint. Document fingerprints are
joined with the benchmark's inside the scan of the documents: the benchmark goes to the tasks in
blocks of about ``BLOCK_WORDS`` words (an item of more is in one block whole), one pass for each block, and the
passes' hit spans are merged per document. Each hit is extended over all windows around the fingerprint and confirmed
word by word. Items of fewer words than a window are matched whole, by fingerprints of their own length.

Edge cases: a null or empty text, or one without words, has no words, no hits and no items. An empty
benchmark leaves every document clean. Repeated rows of documents get a row each; repeated or equal
items count by distinct item_id; items with a null id or text are left out. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brontide.llm import wordhash as wh
from brontide.llm.shared import keyed

WINDOW, GRAM = 10, 5
#: Words of the benchmark that one pass over the documents holds: about 60 MB a task.
BLOCK_WORDS = 1_000_000
_SPANS = "n_words long, starts array<int>, ends array<int>, items array<string>"


def winnow(grams: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the minimum (the rightmost of equal ones) of some run of ``width`` hashes."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    best = np.arange(n) + width - 1
    low = grams[width - 1 :].copy()
    for j in range(width - 2, -1, -1):
        other = grams[j : j + n]
        less = other < low
        low = np.where(less, other, low)
        best = np.where(less, np.arange(n) + j, best)
    return np.unique(best)


def _tokens(column: pa.Array):
    for first, flat, offs in wh.slices(column):
        flat = wh.LOWER[flat]
        starts, ends, woffs = wh.word_spans(flat, offs, wh.ALNUM_WORDS)
        yield first, wh.word_hashes(flat, starts, ends), woffs


class _Index:
    """Windows of a block of the benchmark, by their length: hash, item and words; and the fingerprints of full windows."""

    def __init__(self, items: list[tuple[str, str]], window: int, gram: int):
        self.window, self.gram = window, gram
        names = [i for i, _ in items]
        rows: dict[int, list] = {}
        prints = []
        for first, words, offs in _tokens(pa.array([t for _, t in items], type=pa.string())):
            for k in range(len(offs) - 1):
                own = words[offs[k] : offs[k + 1]]
                if not len(own):
                    continue
                size = min(window, len(own))
                seqs = np.lib.stride_tricks.sliding_window_view(own, size)
                rows.setdefault(size, []).append((wh.window_hashes(own, size), seqs, np.full(len(seqs), first + k)))
                if size == window:
                    grams = wh.window_hashes(own, gram)
                    prints.append(grams[winnow(grams, window - gram + 1)])
        self.names = np.array(names, dtype=object)
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, dtype=np.uint64)
        self.by_size = {}
        for size, parts in rows.items():
            h = np.concatenate([p[0] for p in parts])
            order = np.argsort(h, kind="stable")
            self.by_size[size] = (h[order], np.concatenate([p[1] for p in parts])[order], np.concatenate([p[2] for p in parts])[order])

    def found(self, words: np.ndarray, offs: np.ndarray):
        """(start, size, item) of each occurrence of a benchmark window."""
        for size, (hashes, seqs, owner) in self.by_size.items():
            ok = wh.window_starts(offs, size)
            if not len(ok):
                continue
            if size == self.window:
                grams = wh.window_hashes(words, self.gram)
                width = size - self.gram + 1
                inside = wh.window_starts(offs, self.gram)
                grams = np.where(inside, grams, np.uint64(0xFFFFFFFFFFFFFFFF))
                picked = winnow(grams, width)
                hits = picked[_member(grams[picked], self.prints)]
                at = np.unique((hits[:, None] - np.arange(width)[None, :]).ravel())
                at = at[(at >= 0) & (at < len(ok))]
            else:
                at = np.arange(len(ok))
            at = at[ok[at]]
            if not len(at):
                continue
            own = wh.window_hashes(words, size)[at]
            lo, hi = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
            at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
            for a, x, y in zip(at, lo, hi, strict=True):
                same = (seqs[x:y] == words[a : a + size]).all(axis=1)
                for item in owner[x:y][same]:
                    yield int(a), size, int(item)


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(table, values)
    return table[np.minimum(at, len(table) - 1)] == values


def _spans_of(index):
    def run(batches):
        index_here = index.value
        for batch in batches:
            n_words, starts, ends, items = [], [], [], []
            for first, words, offs in _tokens(batch.column(1)):
                count = len(offs) - 1
                own: list[dict] = [{} for _ in range(count)]
                names: list[set] = [set() for _ in range(count)]
                for a, size, item in index_here.found(words, offs):
                    d = int(np.searchsorted(offs, a, "right")) - 1
                    own[d][a - int(offs[d])] = max(size, own[d].get(a - int(offs[d]), 0))
                    names[d].add(index_here.names[item])
                n_words += np.diff(offs).tolist()
                for d in range(count):
                    starts.append(sorted(own[d]))
                    ends.append([s + own[d][s] for s in sorted(own[d])])
                    items.append(sorted(names[d]))
            arrays = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "starts", "ends", "items"])

    return run


def contamination_spans(docs: DataFrame, bench: DataFrame, window: int = WINDOW, gram: int = GRAM, block_words: int = BLOCK_WORDS, digest: bool = False) -> DataFrame:
    """doc_id, n_words, hit spans (word starts and ends, sorted by start) and the items that occur, one row per document.

    docs: doc_id, text; bench: item_id, text. With more than one block, the passes over a row are merged by its id and text.
    """
    spark = docs.sparkSession
    items = bench.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")
    sizes = items.select("item_id", "text", (F.length("text") / 2 + 1).alias("w"))
    total = sizes.agg(F.sum("w")).first()[0] or 0
    blocks = max(1, int(-(-total // block_words)))
    docs = docs.select("doc_id", "text") if blocks == 1 else docs.select(F.struct("doc_id", F.xxhash64("text").alias("t")).alias("doc_id"), "text")
    told = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    schema = keyed(docs, told if digest and blocks == 1 else _SPANS)
    parts = []
    for k in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        rows = sorted({(r[0], r[1]) for r in own.select("item_id", "text").collect()})
        index = spark.sparkContext.broadcast(_Index(rows, window, gram))
        spans = _spans_of(index)
        # with one block, spans and digests come from one pass through a worker
        parts.append(docs.mapInArrow((lambda batches, spans=spans: _digest(spans(batches))) if digest and blocks == 1 else spans, schema))
    if blocks == 1:
        return parts[0]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    span = F.arrays_zip("starts", "ends")
    merged = out.groupBy("doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(span)))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        (F.count("*") / blocks).cast("int").alias("copies"),
    )
    # equal rows were merged: each gets its row again
    merged = merged.select("doc_id.doc_id", "n_words", F.col("spans.starts").alias("starts"), F.col("spans.ends").alias("ends"), "items", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")
    return merged.mapInArrow(_digest, keyed(merged, told)) if digest else merged


def _digest(batches):
    for batch in batches:
        hits, shas = [], []
        for starts, ends, items in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
            hit, upto = 0, 0
            for s, e in zip(starts, ends, strict=True):
                hit += max(0, e - max(s, upto))
                upto = max(upto, e)
            hits.append(hit)
            shas.append(hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
        n_items = [len(x) for x in batch.column(4).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hits, pa.int64()), pa.array(n_items, pa.int64()), pa.array(shas, pa.string()), pa.array([h > 0 for h in hits], pa.bool_())], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def decontaminate(docs: DataFrame, bench: DataFrame, **params) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return contamination_spans(docs, bench, digest=True, **params)


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: A window is ten item words, or a shorter item whole; occurrences are equi-joined on the joined words.
OP2_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select cast(item_id as varchar) item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark where item_id is not null and text is not null),
bw as (select item_id, least(10, len(w)) size, unnest(range(1, len(w) - least(10, len(w)) + 2)) i, w from b where len(w) > 0),
bk as (select distinct item_id, size, array_to_string(list_slice(w, i, i + size - 1), ' ') k from bw),
dw as (select doc_id, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') k from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) i from d, (select distinct size from bk) s where len(w) >= size)),
h as (select doc_id, i, dw.size, item_id from dw join bk on dw.k = bk.k and dw.size = bk.size),
n as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + size)) p from h) group by 1),
t as (select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) ids from (select distinct doc_id, item_id from h) group by 1)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join n using (doc_id) left join t using (doc_id)
"""
