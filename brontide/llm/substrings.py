"""Operator 7 - substring dedup by recompression.

A text's words are recompressed in rounds: runs of one symbol get one name, then each pair of a left and
a right symbol gets one, where a hash of name and round says which side a symbol is on. A name is a hash
of what it stands for, so the rounds agree over the whole corpus without a dictionary, and equal
substrings get equal symbols in their interior. Each symbol keeps the words its parse depended on: if
these lie inside a window, every copy of that window holds the symbol at the same place.

* Reveal: every window chooses, among the symbols whose whole parse and neighbours of ``MARGIN`` words it
  determines, the one of least hash; equal windows choose alike. Spark counts the places chosen, by name: a
  window whose symbol occurs once can't repeat, the others are candidates. A window without such a symbol
  is counted by a hash of 128 bits of itself.
* Verify: neighbouring windows that chose one place make a run. Runs with the same symbol and the same
  words prove all their windows repeated at once. Where a symbol's runs differ, as at the ends of a
  repeated passage, windows are posted under two independent 64-bit hashes and counted: each window of a
  run that occurs once, and those of a repeated run from its first place alone, as two. So the interior of
  copies costs one row for each run and a large group of copies little more than its ends.

Counting is by aggregation and equi-joins, never by pairs. Texts are dealt by row once; the passes that
post windows and that remove words read that exchange.

A row goes by 128 bits of a hash of its doc_id and text, and whatever is taken for equal is so in 128 bits:
a symbol's name and its run's hash, or a window's two hashes. Among 2^40 windows that errs once in 10^14.

Edge cases: a null or empty text, or one of fewer words than a window, loses nothing; the SHA-256 is that
of the words left, joined by one space. Rows with equal doc_id and text are copies of each other like
any other rows, and give equal rows; rows of one doc_id with other texts are rows of their own. A null
doc_id is like any other. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brontide.llm import wordhash as wh
from brontide.llm.shared import keyed, written

WINDOW, ROUNDS, MARGIN = 35, 3, 3
_PAIR, _RUN = np.uint64(0xB5AD4ECEDA1CE2A9), np.uint64(0x2545F4914F6CDD1D)
_SECOND = np.uint64(0x8EBC6AF09C88C6E3)


class Parse:
    """The symbols of all texts of a slice after some rounds; they tile the words without gaps.

    name; a: the first word of each; lo, hi: the words from lo to hi - 1 that its parse depended on,
    beyond the text where its end played a part; last: whether its text ends with it.
    """

    def __init__(self, words: np.ndarray, offs: np.ndarray):
        n = len(words)
        self.name, self.total = words, n
        self.a = np.arange(n, dtype=np.int32)
        self.lo, self.hi = self.a, self.a + 1
        self.last = np.zeros(n, dtype=bool)
        self.last[offs[1:][np.diff(offs) > 0] - 1] = True
        self.round = 0

    def step(self) -> None:
        """One round. Runs are named in the first and then in every fourth one: a symbol is known to be a run of one
        only by its neighbours, so this widens what each symbol depends on."""
        if len(self.name):
            if self.round % 4 == 0:
                self._runs()
            self._pairs()
        self.round += 1

    def widen(self, woffs: np.ndarray, sums: np.ndarray, shift: np.ndarray, margin: int) -> None:
        """Take ``margin`` words on both sides into each name: longer names repeat less by chance, while there are as many to choose from."""
        doc = np.searchsorted(woffs, self.a, "right") - 1
        a, b = self.a - margin, np.append(self.a[1:], self.total) + margin
        self.lo = np.minimum(self.lo, np.where(a < woffs[doc], woffs[doc] - 1, a))
        self.hi = np.maximum(self.hi, np.where(b > woffs[doc + 1], woffs[doc + 1] + 1, b))
        a, b = np.maximum(a, woffs[doc]), np.minimum(b, woffs[doc + 1])
        self.name = wh.mix(self.name + (sums[b] - sums[a]) * shift[a])

    def _runs(self) -> None:
        same = (self.name[1:] == self.name[:-1]) & ~self.last[:-1]
        start = np.flatnonzero(np.append(True, ~same))
        stop = np.append(start[1:], len(self.name)) - 1
        count = (stop - start + 1).astype(np.uint64)
        # beyond a text's ends: one word further than it goes, which keeps lo and hi in order
        after = np.where(self.last[stop], np.append(self.a[1:], self.total)[stop] + 1, np.append(self.hi[1:], 0)[stop])
        before = np.where(np.append(True, self.last[:-1])[start], self.a[start] - 1, np.append(0, self.lo[:-1])[start])
        name = self.name[start]
        self.name = np.where(count > 1, wh.mix(name * _RUN + count), name)
        self.lo = np.minimum(np.minimum.reduceat(self.lo, start), before).astype(np.int32)
        self.hi = np.maximum(np.maximum.reduceat(self.hi, start), after).astype(np.int32)
        self.a, self.last = self.a[start], self.last[stop]

    def _pairs(self) -> None:
        """A hash of name and round puts each symbol on the left or the right side; a left one and the right one after it are one symbol."""
        salt = np.uint64((self.round + 1) * int(_PAIR) % (1 << 64))
        right = wh.mix(self.name + salt) >> np.uint64(63) == 1
        joins = np.zeros(len(right), dtype=bool)
        joins[:-1] = ~right[:-1] & right[1:] & ~self.last[:-1]
        joined = np.append(False, joins[:-1])
        lo, hi = self.lo.copy(), self.hi.copy()
        # a left symbol stays single because of what follows, a right one because of what precedes
        k = np.flatnonzero(~right & ~joins)
        hi[k] = np.maximum(hi[k], np.where(self.last[k], np.append(self.a[1:], self.total)[k] + 1, self.hi[np.minimum(k + 1, len(hi) - 1)]))
        k = np.flatnonzero(right & ~joined)
        first = (k == 0) | self.last[k - 1]
        lo[k] = np.minimum(lo[k], np.where(first, self.a[k] - 1, self.lo[k - 1]))
        k = np.flatnonzero(joins)
        name = self.name.copy()
        name[k] = wh.mix(name[k] * wh._SEQ + name[k + 1] + _PAIR)
        lo[k], hi[k] = np.minimum(lo[k], self.lo[k + 1]), np.maximum(hi[k], self.hi[k + 1])
        last = self.last.copy()
        last[k] = self.last[k + 1]
        keep = np.flatnonzero(~joined)
        self.name, self.a, self.lo, self.hi, self.last = name[keep], self.a[keep], lo[keep], hi[keep], last[keep]


def _least(order: np.ndarray, first: np.ndarray, stop: np.ndarray, most: int) -> np.ndarray:
    """The least of order[first:stop] for each pair, the largest value for an empty one; no range is longer than ``most``."""
    count, width, table = stop - first, 1, order
    out = np.full(len(first), 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    while width <= most and len(table):
        k = np.flatnonzero((count >= width) & (count < 2 * width))
        out[k] = np.minimum(table[first[k]], table[stop[k] - width])
        table, width = np.minimum(table[:-width], table[width:]), 2 * width
    return out


def chosen(at: Parse, starts: np.ndarray, window: int) -> np.ndarray:
    """For the window at each start: the symbol of least hash among those that it determines, -1 if there is none.

    Equal windows hold the same such symbols at the same places, so they choose alike.
    """
    first, stop = np.searchsorted(at.lo, starts, "left"), np.searchsorted(at.hi, starts + window, "right")
    low = np.uint64(0xFFFFFFFF)
    order = (wh.mix(at.name ^ _SECOND) & ~low) | np.arange(len(at.name), dtype=np.uint64)
    best = _least(order, first, stop, window)
    return np.where(stop > first, (best & low).astype(np.int64), -1)


def _tokens(column: pa.Array):
    for first, flat, offs in wh.slices(column):
        starts, ends, woffs = wh.word_spans(flat, offs, wh.SPACE_WORDS)
        yield first, wh.word_hashes(flat, starts, ends), woffs


def groups(words: np.ndarray, woffs: np.ndarray, window: int, rounds: int, margin: int):
    """Runs of windows that chose one place: the symbol's name, a hash of all words of the run and where the symbol
    stands in it, the first window, the number of windows and for how many places it counts. Windows without a symbol
    make a run while they are equal, as in one word said over and over, and count for each."""
    at = Parse(words, woffs)
    for _ in range(rounds):
        at.step()
    starts = np.flatnonzero(wh.window_starts(woffs, window))
    if not len(starts):
        return (np.zeros(0, np.uint64),) * 2 + (starts,) * 3
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * wh.powers(wh._SEQ, len(words)), out=sums[1:])
    shift = wh.powers(wh._SEQ_INV, len(words) + 1)
    at.widen(woffs, sums, shift, margin)
    pick = chosen(at, starts, window)
    own = np.where(pick < 0, wh.mix((sums[starts + window] - sums[starts]) * shift[starts] ^ _RUN), np.uint64(0))
    head = np.flatnonzero(np.append(True, (pick[1:] != pick[:-1]) | (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)))
    count = np.diff(np.append(head, len(starts)))
    first, symbol, own = starts[head], pick[head], own[head]
    whole = wh.mix((sums[first + count + window - 1] - sums[first]) * shift[first] + count.astype(np.uint64) * _RUN)
    k = np.maximum(symbol, 0)
    name = np.where(symbol < 0, own, at.name[k])
    span = np.where(symbol < 0, np.uint64(0), wh.mix(whole + (at.a[k] - first).astype(np.uint64) * _PAIR))
    bare = np.flatnonzero(symbol < 0)
    if len(bare):
        sums[1:] = np.cumsum(wh.mix(words ^ _SECOND) * wh.powers(wh._SEQ, len(words)))
        span[bare] = wh.mix((sums[first[bare] + window] - sums[first[bare]]) * shift[first[bare]])
    times = np.where(symbol < 0, count, 1)
    # a text that repeats itself period after period makes equal runs in a row: they are one, of so many places
    same = (name[1:] == name[:-1]) & (span[1:] == span[:-1]) & (count[1:] == count[:-1]) & (first[1:] == first[:-1] + count[:-1])
    head = np.flatnonzero(np.append(True, ~same))
    return name[head], span[head], first[head], np.add.reduceat(count, head), np.add.reduceat(times, head)


def _places(window, rounds, margin):
    def run(batches):
        for batch in batches:
            for first, words, woffs in _tokens(batch.column(2)):
                name, span, at, count, times = groups(words, woffs, window, rounds, margin)
                doc = np.searchsorted(woffs, at, "right") - 1
                rows = pa.array(doc + first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name.view(np.int64)), pa.array(span.view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at - woffs[doc], pa.int32()), pa.array(count, pa.int32()), pa.array(times, pa.int32())],
                    names=["name", "span", "r", "c", "at", "n", "times"],
                )

    return run


def _post(window):
    """The windows of runs that are not proved, each counted once, and those of a proved run's first place, counted twice."""

    def run(batches):
        for batch in batches:
            marks = batch.column(4).to_pylist()
            for first, words, woffs in _tokens(batch.column(3)):
                spans = [(woffs[d] + m["at"], m["post"], m["kind"]) for d in range(len(woffs) - 1) for m in marks[first + d] if m["kind"]]
                use = np.concatenate([np.arange(a, a + n) for a, n, _ in spans]) if spans else np.zeros(0, np.int64)
                times = np.repeat([k for _, _, k in spans], [n for _, n, _ in spans]) if spans else use
                doc = np.searchsorted(woffs, use, "right") - 1
                rows = pa.array(doc + first)
                h1, h2 = (wh.window_hashes(w, window)[use] if len(use) else np.zeros(0, np.uint64) for w in (words, wh.mix(words ^ _SECOND)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(times, pa.int32()), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(use - woffs[doc], pa.int32())],
                    names=["h1", "h2", "times", "r", "c", "at"],
                )

    return run


def _kept(window):
    def run(batches):
        for batch in batches:
            n_words, n_removed, digests = [], [], []
            for text, marks, found in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                words = (text or "").encode().split()
                n = len(words)
                proved = [(m["at"], m["at"] + m["n"] - 1) for m in marks or () if m["kind"] != 1]
                if proved or found:
                    edge = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(edge, [a for a, _ in proved] + (found or []), 1)
                    np.add.at(edge, [b + window for _, b in proved] + [x + window for x in found or ()], -1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(edge[:n]) == 0).tolist()]
                n_words.append(n)
                n_removed.append(n - len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, margin: int = MARGIN) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: a row for each of docs (doc_id, text)."""
    # a row goes by two hashes of its id and text: rows equal in both share all marks, as they must
    rows = docs.select(F.xxhash64("doc_id", "text").alias("r"), F.xxhash64(F.lit(1), F.col("doc_id").isNull(), "doc_id", "text").alias("c"), "doc_id", "text")
    places = rows.select("r", "c", "text").mapInArrow(_places(window, rounds, margin), "name long, span long, r long, c long, at int, n int, times int")
    shared = places.groupBy("name").agg(F.sum("times").alias("k")).where("k > 1").drop("k")
    candidates = written(places.join(shared, "name"))
    place = F.struct("r", "c", "at")
    alike = candidates.groupBy("name").agg((F.min("span") == F.max("span")).alias("alike"))
    candidates = candidates.join(alike, "name")
    mixed = candidates.where("not alike")
    spans = mixed.groupBy("name", "span").agg(F.sum("times").alias("k"), F.min(place).alias("head"))
    kind = F.when(F.col("k") == 1, 1).when(F.col("head") == place, 2).otherwise(0)
    known = mixed.join(spans, ["name", "span"]).select("r", "c", "at", "n", (F.col("n") / F.col("times")).cast("int").alias("post"), kind.alias("kind")).unionByName(candidates.where("alike").select("r", "c", "at", "n", F.lit(0).alias("post"), F.lit(0).alias("kind")))
    marks = written(known.groupBy("r", "c").agg(F.collect_set(F.struct("at", "n", "post", "kind")).alias("marks")))
    dealt = rows.repartition("r", "c").join(marks, ["r", "c"], "left").select("r", "c", "doc_id", "text", "marks")
    posts = dealt.where(F.exists("marks", lambda m: m["kind"] > 0)).mapInArrow(_post(window), "h1 long, h2 long, times int, r long, c long, at int")
    twice = posts.groupBy("h1", "h2").agg(F.sum("times").alias("total")).where("total > 1").drop("total")
    found = posts.join(twice, ["h1", "h2"]).groupBy("r", "c").agg(F.collect_set("at").alias("found"))
    return dealt.join(found, ["r", "c"], "left").select("r", "c", "doc_id", "text", "marks", "found").mapInArrow(_kept(window), keyed(docs, "n_words long, n_removed long, kept_sha256 string"))


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = rf"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
p as (select doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') k from (select *, unnest(range(1, len(w) - {WINDOW - 2})) i from w where len(w) >= {WINDOW})),
r as (select k from p group by k having count(*) > 1),
c as (select distinct doc_id, unnest(range(i, i + {WINDOW})) j from p where k in (select k from r)),
x as (select w.doc_id, t.j, w.w[t.j] s from w, unnest(range(1, len(w.w) + 1)) t(j)),
l as (select x.doc_id, count(*) n, string_agg(s, ' ' order by x.j) s from x left join c on c.doc_id = x.doc_id and c.j = x.j where c.doc_id is null group by 1)
select w.doc_id, cast(len(w) as bigint) n_words, cast(len(w) - coalesce(l.n, 0) as bigint) n_removed, sha256(coalesce(l.s, '')) kept_sha256 from w left join l on l.doc_id = w.doc_id
"""
