"""Operator 5 - MinHash near-dedup by a signature-coordinate inverted join.

A document's set is its distinct shingles; equal sets form one class. A signature has ``COORDS``
coordinates, the least value of the set under as many hash functions. Every class is posted under each
coordinate with its value. Two classes collide as often as their coordinates agree; a pair is retained from
a number of collisions on that a share of ``MISS`` of the links at the least similarity, or fewer, stays below
(39 of 64 at 0.85, 35 at 0.80), and retained pairs are compared on whole sets.

* Skip: a posting list of one member makes no collision. A class with fewer lists of two or more than the
  match threshold asks for can't reach it, and takes no further part.
* Prefix: the lists of a class are ordered from the shortest on. Pairs that reach the threshold t meet in the
  first (lists - t + 1) of both classes, so only these are merged: long lists, as of a passage that many
  documents hold, are mostly left to the end and never opened. Collisions in the prefixes are counted per
  pair, those behind them from the two signatures.
* Merging: every member of a list meets the list's first and last member, which makes 2 n pairs for n
  members. Links give first components. Lists whose members are all in one component need no more work; in the
  others the members outside the list's largest component are its strays, and what remains are pairs of a
  stray and a member of another component. Up to ``STRAYS`` strays of a list meet all its members as pairs.
  Where there are more, strays and members are dealt in blocks, and a task compares a block of each
  by one product of their shingle incidence matrices and returns a spanning forest of their links, so
  nothing is emitted for each pair however many strays there are.

Components are the smallest doc_id reachable, by repeated minimum over links with pointer jumping.

Edge cases: a null or empty text, or one without words, has an empty set and is linked with nothing.
Fewer words than a shingle make one shingle of the whole sequence. Every row gets a row; rows of one
doc_id are one document, linked with what any of its texts is linked with. A null doc_id takes no part: it
gets a null component and is kept. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brontide.llm import wordhash as wh
from brontide.llm.shared import written

COORDS, MISS = 64, 2e-6
STRAYS, BLOCK, BLOCK_SHINGLES = 24, 512, 1 << 21
SHINGLE, OVER, UNDER = 3, 85, 100
_FACTORS = np.random.default_rng(20240501).integers(1, 1 << 63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.arange(COORDS, dtype=np.uint64) << np.uint64(32)


def least_matches(over: int, under: int) -> int:
    """The number of agreeing coordinates that all but a share of MISS of the pairs at the least similarity reach."""
    s = over / under
    tail, matches = 0.0, 0
    while matches < COORDS and (tail := tail + math.comb(COORDS, matches) * s**matches * (1 - s) ** (COORDS - matches)) <= MISS:
        matches += 1
    if matches < 1 or s > 1:
        raise ValueError(f"{COORDS} coordinates don't find pairs of a similarity of {s}")
    return matches


def shingle_sets(column: pa.Array, size: int):
    """The sorted distinct shingle hashes of each text; a null is an empty text."""
    for _, flat, offs in wh.slices(column):
        flat = wh.LOWER[flat]
        starts, ends, woffs = wh.word_spans(flat, offs, wh.SPACE_WORDS)
        words = wh.word_hashes(flat, starts, ends)
        grams, whole = wh.window_hashes(words, size), wh.whole_hashes(words, woffs)
        for k in range(len(woffs) - 1):
            n = woffs[k + 1] - woffs[k]
            yield np.unique(grams[woffs[k] : woffs[k + 1] - size + 1]) if n >= size else whole[k : k + 1] if n else whole[:0]


def signature(own: np.ndarray) -> np.ndarray:
    """A key for each coordinate: its number, then the upper half of the least hash under its function."""
    least = np.full(COORDS, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for a in range(0, len(own), 512):
        np.minimum(least, (own[a : a + 512, None] * _FACTORS).min(axis=0), out=least)
    return (least >> np.uint64(32) | _PLACE).view(np.int64)


def _digests(own: np.ndarray) -> tuple[int, int]:
    if not len(own):
        return 0, 0
    return int(own.sum(dtype=np.uint64).view(np.int64)), int(wh.mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64))


def _scan(size: int):
    def run(batches):
        for batch in batches:
            ns, digests, keys = [], [], []
            for own in shingle_sets(batch.column(1), size):
                ns.append(len(own))
                digests.append(_digests(own))
                keys.append(signature(own))
            flat = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ns) + 1) * COORDS, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), *(pa.array([d[k] for d in digests], pa.int64()) for k in (0, 1)), lists], names=["doc_id", "n", "d1", "d2", "keys"])

    return run


def _sets(size: int):
    def run(batches):
        for batch in batches:
            sets, digests = [], []
            for own in shingle_sets(batch.column(1), size):
                sets.append(own)
                digests.append(_digests(own))
            ends = np.cumsum([0, *map(len, sets)])
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([d[k] for d in digests], pa.int64()) for k in (0, 1)), lists], names=["id", "d1", "d2", "own"])

    return run


def _both() -> Column:
    """The size of the intersection of the sets x and y."""
    return F.size(F.array_intersect("x", "y"))


def overlaps(sets: list[np.ndarray], half: int) -> np.ndarray:
    """Intersection sizes of sets[:half] with sets[half:], by products of incidence matrices over the shared shingles."""
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    names, at = np.unique(np.concatenate(sets), return_inverse=True)
    left = np.bincount(at[rows < half], minlength=len(names)) > 0
    both = left & (np.bincount(at[rows >= half], minlength=len(names)) > 0)
    place = np.cumsum(both) - 1
    use = both[at]
    rows, at = rows[use], place[at[use]]
    order = np.argsort(at, kind="stable")
    rows, at = rows[order], at[order]
    out = np.zeros((half, len(sets) - half), dtype=np.float32)
    for first in range(0, int(both.sum()), 4096):
        lo, hi = np.searchsorted(at, [first, first + 4096])
        m = np.zeros((len(sets), 4096), dtype=np.float32)
        m[rows[lo:hi], at[lo:hi] - first] = 1
        out += m[:half] @ m[half:].T
    return out.astype(np.int64)


def _forest(over: int, under: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """Links that join components between a block of strays and one of members."""
        reps, comps = table["rep"].to_pylist(), table["comp"].to_pylist()
        sets = [x.values.to_numpy() for x in table["own"]]
        stray = np.array(table["stray"].to_pylist(), dtype=bool)
        x, y = np.flatnonzero(stray), np.flatnonzero(~stray)
        parent = {c: c for c in comps}

        def root(c):
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        found = []
        if len(x) and len(y):
            n = np.array([len(s) for s in sets])
            both = overlaps([sets[k] for k in x] + [sets[k] for k in y], len(x))
            ok = under * both >= over * (n[x][:, None] + n[y][None, :] - both)
            for i, j in zip(*np.nonzero(ok), strict=True):
                a, b = root(comps[x[i]]), root(comps[y[j]])
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    found.append((reps[x[i]], reps[y[j]]))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """node and the least node it reaches, for every end of the links (a, b); both in the links' type."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    for _ in range(most):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # each end of an edge hangs on the least neighbour of the other: large star and small star in one
        ends = edges.join(least.withColumnRenamed("m", "mu"), "u").join(least.select(F.col("u").alias("v"), F.col("m").alias("mv")), "v")
        low = F.least("mu", "mv")
        pairs = ends.select(F.explode(F.array(F.struct(F.col("u").alias("u"), low.alias("v")), F.struct(F.col("v").alias("u"), low.alias("v")), F.struct(F.col("mu").alias("u"), low.alias("v")), F.struct(F.col("mv").alias("u"), low.alias("v")))).alias("p"))
        new = written(pairs.select("p.*").where("u <> v").distinct())
        # done if every node hangs on one that hangs on none
        deep = new.join(new.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        edges = new
        if deep.isEmpty() and edges.groupBy("u").count().where("count > 1").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def prefix_lists(reps: DataFrame, matches: int) -> DataFrame:
    """key, rep, n for the posting lists that are merged: for each class (rep, n, keys) that can reach ``matches`` the shortest of its lists."""
    posted = reps.select("rep", F.explode("keys").alias("key"))
    lengths = posted.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    lists = posted.join(lengths, "key").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("c", "key"))).alias("lists")).where(F.size("lists") >= matches)
    lists = lists.select("rep", F.explode(F.slice("lists", F.lit(1), F.size("lists") - (matches - 1))).alias("l")).select("rep", "l.key")
    return lists.join(reps.select("rep", "n"), "rep")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, over: int = OVER, under: int = UNDER) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each of docs (doc_id, text); links have under * both >= over * either."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    matches = least_matches(over, under)
    scanned = written(docs.mapInArrow(_scan(size), f"doc_id {kind}, n long, d1 long, d2 long, keys array<long>"))
    named = scanned.where("n > 0 and doc_id is not null")
    classes = named.groupBy("n", "d1", "d2").agg(F.min(F.struct("doc_id", "keys")).alias("x"))
    reps = written(classes.select(F.monotonically_increasing_id().alias("rep"), F.col("x.doc_id").alias("id"), "n", "d1", "d2", F.col("x.keys").alias("keys")))
    lists = written(prefix_lists(reps, matches))
    ends = lists.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    met = lists.join(ends, "key").select("rep", F.explode(F.array("lo", "hi")).alias("end")).where("rep <> end")
    pairs = met.select(F.least("rep", "end").alias("a"), F.greatest("rep", "end").alias("b")).distinct()
    members = lists.join(ends.select("key"), "key", "left_semi").select("rep").distinct()
    wanted = written(reps.join(members, "rep", "left_semi").select("rep", "id", "d1", "d2", "keys"))
    texts = docs.join(wanted.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = written(texts.mapInArrow(_sets(size), f"id {kind}, d1 long, d2 long, own array<long>").join(wanted.select("rep", "id", "d1", "d2"), ["id", "d1", "d2"]).select("rep", "own").dropDuplicates(["rep"]))

    def with_both(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
        side = lambda column, name: table.select(F.col("rep").alias(column), F.col(value).alias(name))
        return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y")

    def linked(pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, b): those with collisions enough that are links."""
        # a key holds its coordinate, so equal keys are agreeing coordinates
        retained = with_both(pairs, wanted, "keys").where(_both() >= matches).select("a", "b")
        # under * both >= over * either, with both said once
        return with_both(retained, sets, "own").where((under + over) * _both() >= over * (F.size("x") + F.size("y"))).select("a", "b")

    first = written(linked(pairs))
    comps = components(first)
    labelled = written(lists.join(ends.select("key"), "key", "left_semi").join(comps, F.col("rep") == F.col("node"), "left").select("key", "rep", "n", F.coalesce("comp", "rep").alias("comp")))
    parts = labelled.groupBy("key", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    opened = parts.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("main"), F.sum("c").alias("c"), F.sum("w").alias("w")).where(F.col("main.c") < F.col("c"))
    opened = opened.select("key", F.col("main.comp").alias("main"), "c", "w", (F.col("c") - F.col("main.c")).alias("s"))
    rest = written(labelled.join(opened, "key").withColumn("stray", F.col("comp") != F.col("main")))
    few = rest.where(F.col("s") <= STRAYS)
    x, y = few.where("stray").alias("x"), few.alias("y")
    apart = (F.col("x.comp") != F.col("y.comp")) & (~F.col("y.stray") | (F.col("x.rep") < F.col("y.rep")))
    alike = under * F.least("x.n", "y.n") >= over * F.greatest("x.n", "y.n")
    cross = x.join(y, (F.col("x.key") == F.col("y.key")) & apart & alike).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()
    second = linked(cross)
    most = lambda rows: F.greatest(F.ceil(F.col(rows) / BLOCK), F.ceil(F.col("w") * F.col(rows) / F.col("c") / BLOCK_SHINGLES)).cast("int")
    many = rest.where(F.col("s") > STRAYS).select("key", "rep", "comp", "stray", most("s").alias("ps"), most("c").alias("qs"))
    spot = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = (
        many.where("stray").select("key", spot("ps").alias("p"), every("qs").alias("q"), "rep", "comp", "stray")
        .unionByName(many.select("key", every("ps").alias("p"), spot("qs").alias("q"), "rep", "comp", F.lit(False).alias("stray")))
        .join(sets, "rep")
    )
    third = dealt.groupBy("key", "p", "q").applyInArrow(_forest(over, under), "a long, b long")
    # rows of one doc_id are one document, so the classes of its texts hang together
    classed = written(named.select("doc_id", "n", "d1", "d2").join(reps.select("n", "d1", "d2", "rep"), ["n", "d1", "d2"]).select("doc_id", "rep"))
    several = classed.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("doc_id", "a")
    fourth = classed.join(several, "doc_id").where("rep > a").select("a", F.col("rep").alias("b"))
    joined = components(first.unionByName(second).unionByName(third).unionByName(fourth))
    placed = reps.select("rep", "id").join(joined, F.col("rep") == F.col("node"), "left").select("rep", "id", F.coalesce("comp", "rep").alias("comp"))
    least = placed.groupBy("comp").agg(F.min("id").alias("component_id"))
    placed = classed.join(placed.join(least, "comp").select("rep", "component_id"), "rep").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return (
        scanned.select("doc_id", F.col("n").alias("n_shingles"))
        .join(placed, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def op5_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The sets and their sizes by an equi-join on shingles, the components by a recursive minimum.
OP5_SQL = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end)) k from w),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.k = b.k and a.doc_id < b.doc_id group by 1, 2),
l as materialized (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where {UNDER} * c >= {OVER} * (x.n + y.n - c)),
e as materialized (select a u, b v from l union all select b, a from l),
r(u, c) as (select doc_id, doc_id from n union select e.v, r.c from r join e on e.u = r.u where r.c < e.v),
m as (select u, min(c) c from r group by 1)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) n_shingles, coalesce(m.c, d.doc_id) component_id, coalesce(m.c, d.doc_id) = d.doc_id kept
from documents d left join n on n.doc_id = d.doc_id left join m on m.u = d.doc_id
"""
