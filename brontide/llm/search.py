"""Operator 11 - ranked lexical search: WAND on shards of documents.

One pass over the texts counts the terms that some item asks for and leaves a table of document, length, terms and
counts; document frequencies come from that table, and so does the search. A shard is a run of its rows with postings
by term. Each item goes through a shard in ranges of documents, all ranges of all items in step: the lists of the
item's terms are sorted by the document they stand at, the greatest impacts of their terms are summed up in that order,
and the first document where the sum reaches what the item's heap demands is the pivot. Lists before it are moved up to
it, what they stand at between is skipped, and the pivot is scored where the terms found there can still reach the heap.
A shard starts with the demands that a first search of one document in ``SEED`` has left, which are bounds from below
whatever that search saw; heaps of shards are merged by score and document.

Items go to the tasks in blocks of about ``BLOCK_TERMS`` terms, with a pass over the texts for each block; an item of
more terms is in a block with what shares its hash. Terms are compared by 64-bit hashes.

Edge cases: a null text, or one without terms, is never found and does not count. An item that is null or has no terms,
or none that a document holds, has no rows. Repeated rows of items are ranked each, repeated documents are found each;
of equal scores the least doc_id (null first) comes first. A term that stands in (nearly) all documents may weigh 0.
Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from brontide.llm import wordhash as wh
from brontide.llm.shared import keyed, written

TOP = 50
#: About so many terms of items in a block, postings in a shard, and entries (item, range, term) that go in step.
BLOCK_TERMS, SHARD_POSTINGS, STEP_ENTRIES = 500_000, 2_000_000, 1 << 19
#: One document in so many is searched first, for the demands of heaps.
SEED = 16
#: Fixed values of the score: saturation and share of length, in thousandths and hundredths.
SCALE, SATURATION, SHARE = 1_000_000_000, 20, 50


def term_hashes(column: pa.Array):
    """(first row, term hashes, offsets by text) of slices of a column of texts."""
    for first, flat, offs in wh.slices(column):
        flat = wh.LOWER[flat]
        starts, ends, woffs = wh.word_spans(flat, offs, wh.ALNUM_WORDS)
        yield first, wh.word_hashes(flat, starts, ends), woffs


class Queries:
    """A block of items: the hashes of all their terms, sorted, and each item's terms as places among them."""

    def __init__(self, texts: list):
        own = [np.unique(h[a:b]) for _, h, offs in term_hashes(pa.array(texts, pa.string())) for a, b in zip(offs[:-1], offs[1:], strict=True)]
        self.known = np.unique(np.concatenate(own)) if own else np.zeros(0, dtype=np.uint64)
        self.terms = [np.searchsorted(self.known, x) for x in own]


def weights(df: np.ndarray, n: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()], dtype=np.int64)


def _counted(known):
    """doc_id, n and the counts of the block's terms in each text."""

    def run(batches):
        asked = known.value
        for batch in batches:
            n, sizes, terms, tfs = [], [], [], []
            for _, words, offs in term_hashes(batch.column(1)):
                at = np.minimum(np.searchsorted(asked, words), len(asked) - 1)
                hit = asked[at] == words
                found, tf = np.unique(wh.doc_of(offs)[hit] * len(asked) + at[hit], return_counts=True)
                n.append(np.diff(offs))
                sizes.append(np.bincount(found // len(asked), minlength=len(offs) - 1))
                terms.append(found % len(asked))
                tfs.append(tf)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else [0], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x) if x else [], pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n) if n else [], pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    return run


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and sizes of a column of lists."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(column.offsets.to_numpy())


def _frequencies(size: int):
    """term, k: documents with each term; under -1 and -2 documents with any word and all words."""

    def run(batches):
        df, docs, length = np.zeros(size, dtype=np.int64), 0, 0
        for batch in batches:
            n = batch.column(0).to_numpy(zero_copy_only=False)
            df += np.bincount(_flat(batch.column(1))[0], minlength=size)
            docs, length = docs + int((n > 0).sum()), length + int(n.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2]), pa.int32()), pa.array(np.append(df[some], [docs, length]), pa.int64())], names=["term", "k"])

    return run


class Shard:
    """Postings of documents numbered in order of doc_id, sorted by term and document."""

    def __init__(self, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, docs: int, length: int):
        self.docs = len(n)
        key = term * self.docs + doc
        order = np.argsort(key)
        self.keys, term, doc, tf = key[order], term[order], doc[order], tf[order]
        m = 100 - SHARE + (SHARE * n * docs) // length
        self.impact = weight[term] * ((SCALE * tf) // (1000 * tf + SATURATION * m[doc]))
        self.most = np.zeros(len(weight) + 1, dtype=np.int64)
        np.maximum.at(self.most, term, self.impact)

    def search(self, items: list[np.ndarray], heaps: list, top: int, entries: int = STEP_ENTRIES) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By item, the documents and scores that its demand (heaps: sorted scores, the least first) did not rule out."""
        items = [x[self.most[x] > 0] for x in items]
        live = [k for k, x in enumerate(items) if len(x)]
        found: dict[int, list] = {}
        if not live:
            return {}
        widest, ranges = max(len(items[k]) for k in live), 1
        while ranges * 2 * len(live) * widest <= entries and ranges * 64 < self.docs:
            ranges *= 2
        step = max(1, entries // widest // ranges)
        for first in range(0, len(live), step):
            self._in_step(live[first : first + step], items, heaps, top, ranges, found)
        return {k: (np.concatenate([d for d, _ in x]), np.concatenate([s for _, s in x])) for k, x in found.items()}

    def _in_step(self, live: list[int], items: list[np.ndarray], heaps: list, top: int, ranges: int, found: dict) -> None:
        none, widest = len(self.most) - 1, max(len(items[k]) for k in live)
        table = np.full((len(live), widest), none)
        for r, k in enumerate(live):
            table[r, : len(items[k])] = items[k]
        bounds = np.arange(ranges + 1) * self.docs // ranges
        item, low, high = np.repeat(np.arange(len(live)), ranges), np.tile(bounds[:-1], len(live)), np.tile(bounds[1:], len(live))
        base, most = table[item] * self.docs, self.most[table][item]
        need = np.array([max(1, int(heaps[k][0]) if len(heaps[k]) == top else 1) for k in live], dtype=np.int64)
        at = np.searchsorted(self.keys, base + low[:, None])
        keys = np.append(self.keys, np.iinfo(np.int64).max)
        impact = np.append(self.impact, 0)
        far = np.iinfo(np.int64).max
        end = base + high[:, None]
        stand = np.where(keys[at] < end, keys[at] - base, far)
        while len(item):
            rows = np.arange(len(item))
            order = np.argsort(stand, axis=1)
            reach = np.cumsum(np.take_along_axis(most, order, 1), axis=1) >= need[item][:, None]
            first = reach.argmax(axis=1)
            pivot = np.where(reach[rows, first], stand[rows, order[rows, first]], far)
            on = pivot < far
            if not on.all():
                item, base, most, at, end, stand, pivot = item[on], base[on], most[on], at[on], end[on], stand[on], pivot[on]
                if not len(item):
                    break
            r, t = np.nonzero(stand < pivot[:, None])
            at[r, t] = to = np.searchsorted(self.keys, base[r, t] + pivot[r])
            stand[r, t] = np.where(keys[to] < end[r, t], keys[to] - base[r, t], far)
            here = stand == pivot[:, None]
            own = np.flatnonzero((most * here).sum(axis=1) >= need[item])
            score = (impact[at[own]] * here[own]).sum(axis=1)
            good = score >= need[item[own]]
            own, score = own[good], score[good]
            if len(own):
                by = np.argsort(item[own], kind="stable")
                cut = np.flatnonzero(np.diff(item[own][by], prepend=-1))
                for a, b in zip(cut, np.append(cut[1:], len(by)), strict=True):
                    i, which = int(item[own[by[a]]]), by[a:b]
                    k = live[i]
                    found.setdefault(k, []).append((pivot[own[which]], score[which]))
                    heaps[k] = np.sort(np.append(heaps[k], score[which]))[-top:]
                    if len(heaps[k]) == top:
                        need[i] = max(1, int(heaps[k][0]))
            r, t = np.nonzero(here)
            at[r, t] = to = at[r, t] + 1
            stand[r, t] = np.where(keys[to] < end[r, t], keys[to] - base[r, t], far)


def _searched(shared, top: int, kind: pa.DataType, postings: int):
    """item, doc_id, score: what the heaps of a task's shards hold at the end."""

    def run(batches):
        items, weight, docs, length, seeds = shared.value
        # a demand from elsewhere stands in for a full heap until this task's own scores exceed it
        heaps = [np.full(top, s) if s else np.zeros(0, dtype=np.int64) for s in seeds]
        kept: dict[int, list] = {}

        def close(ids: list, n: list, sizes: list, terms: list, tfs: list) -> None:
            id_ = pa.concat_arrays(ids)
            by = pc.sort_indices(id_, null_placement="at_start").to_numpy()
            place = np.empty(len(by), dtype=np.int64)
            place[by] = np.arange(len(by))
            shard = Shard(np.concatenate(n)[by], np.repeat(place, np.concatenate(sizes)), np.concatenate(terms), np.concatenate(tfs), weight, docs, length)
            for k, (doc, score) in shard.search(items, heaps, top).items():
                best = np.lexsort((doc, -score))[:top]
                own = list(zip((-score[best]).tolist(), id_.take(pa.array(by[doc[best]])).to_pylist(), strict=True))
                kept[k] = sorted(kept.get(k, []) + own, key=lambda x: (x[0], x[1] is not None, x[1]))[:top]

        open_: tuple = ([], [], [], [], [])
        held = 0
        for batch in batches:
            terms, sizes = _flat(batch.column(2))
            for into, x in zip(open_, (batch.column(0), batch.column(1).to_numpy(zero_copy_only=False), sizes, terms, _flat(batch.column(3))[0]), strict=True):
                into.append(x)
            held += len(terms)
            if held >= postings:
                close(*open_)
                open_, held = ([], [], [], [], []), 0
        if held:
            close(*open_)
        for k, rows in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(rows), pa.int32()), pa.array([d for _, d in rows], kind), pa.array([-s for s, _ in rows], pa.int64())], names=["item", "doc_id", "score"])

    return run


def _best(found: DataFrame, top: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS, postings: int = SHARD_POSTINGS, seed: int = SEED) -> DataFrame:
    """item_id, rank, doc_id, score of the ``top`` best documents (doc_id, text) for each row of items (item_id, text)."""
    spark = docs.sparkSession
    items = items.select("item_id", "text")
    total = items.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    blocks = max(1, int(-(-total // block_terms)))
    out = None
    for k in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        part = _block(spark, docs.select("doc_id", "text"), own.collect(), items.schema["item_id"], top, postings, seed)
        if part is not None:
            out = part if out is None else out.unionByName(part)
    if out is None:
        fields = [StructField("item_id", items.schema["item_id"].dataType), StructField("rank", IntegerType()), StructField("doc_id", docs.schema["doc_id"].dataType), StructField("score", LongType())]
        out = spark.createDataFrame([], StructType(fields))
    return out


def _block(spark, docs: DataFrame, rows: list, id_field: StructField, top: int, postings: int, seed: int) -> DataFrame | None:
    asked = Queries([r["text"] for r in rows])
    if not len(asked.known):
        return None
    table = written(docs.mapInArrow(_counted(spark.sparkContext.broadcast(asked.known)), keyed(docs, "n long, terms array<int>, tfs array<int>")).where("n > 0"))
    counts = dict(table.select("n", "terms").mapInArrow(_frequencies(len(asked.known)), "term int, k long").groupBy("term").agg(F.sum("k")).collect())
    n, length = counts.pop(-1, 0), counts.pop(-2, 0)
    if not counts:
        return None
    df = np.zeros(len(asked.known), dtype=np.int64)
    df[list(counts)] = list(counts.values())
    weight = weights(df, n)
    schema = keyed(docs, "score long")
    kind = to_arrow_type(docs.schema["doc_id"].dataType)

    def found(table: DataFrame, seeds: list[int]) -> DataFrame:
        shared = spark.sparkContext.broadcast((asked.terms, weight, n, length, seeds))
        return table.mapInArrow(_searched(shared, top, kind, postings), StructType([StructField("item", IntegerType()), *schema.fields]))

    none = [0] * len(rows)
    some = _best(found(table.where(F.pmod(F.xxhash64("doc_id"), F.lit(seed)) == 0), none), top).where(F.col("rank") == top)
    seeds = dict(some.select("item", "score").collect())
    best = _best(found(table, [seeds.get(k, 0) for k in range(len(rows))]), top)
    names = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(rows)], StructType([StructField("item", IntegerType()), StructField("item_id", id_field.dataType)]))
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def op11_wand_search(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
with d as (select doc_id, row_number() over () r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') w from documents),
s as (select count(*) n_docs, sum(len(w))::bigint n_terms from d where len(w) > 0),
q as (select distinct item_id, i, t from (select item_id, i, unnest(w) t from (select item_id, row_number() over () i, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') w from benchmark))),
p as (select r, t, count(*) tf from (select r, unnest(w) t from d) where t in (select t from q) group by all),
x as (select t, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) as bigint) w from (select t, count(*) df from p group by 1), s),
m as (select d.doc_id, d.r, 100 - 50 + (50 * len(w) * n_docs) // n_terms m from d, s where len(w) > 0),
f as (select q.item_id, q.i, m.doc_id, m.r, sum(x.w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint score from q join p using (t) join x using (t) join m using (r) group by all)
select item_id, cast(rank as integer) as rank, doc_id, score from (select *, row_number() over (partition by i order by score desc, doc_id nulls first, r) as rank from f where score > 0) where rank <= 50
"""
