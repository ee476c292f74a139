"""Operator 10 - line dedup by a deletion-neighbourhood join.

Two lines are near copies if one word inserted, deleted or replaced turns one into the other. A line
goes if an earlier one (by doc_id, then text, then line number) has the same words or, where the longer
of the two has ``near_words`` words or more, is a near copy. Lines of fewer than ``min_words`` words stay
if they have fewer than ``min_chars`` characters too: they are too short to tell a copy from chance. So a
line of Chinese, one word by its spaces, is looked at like others.

Every line's variants are the line without one of its words, each with the position it lacks. Lines
that share a variant and a position differ there alone; a variant that equals a whole line is one
insertion away. The earliest line of each key of 128 bits comes from an aggregation, so no pairs are made
inside a group, however large it is; each line that has an earlier one is then compared with it, word by
word, and goes only if their edit distance is one.

A line first posts the keys of its start and its end, each at most half of it: one edit leaves one
of them whole. Only lines that share such a part with another distinct line emit variants, and those
only at positions outside it. Exact copies are merged before. Texts are dealt by row once; the same
exchange serves the variants and the final removal.

Edge cases: a null text stays null, an empty one empty, and an empty table gives an empty one. A row goes
by its doc_id and a 64-bit hash of its text: rows equal in both are never earlier than each other and
keep the same lines; rows of one doc_id with other texts are documents of their own, in the order of the
hashes (a million rows of one doc_id hold a clash once in thirty million tables). A null doc_id is like
any other, the first in order. Extra columns pass through, whatever their
names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brontide.llm import wordhash as wh
from brontide.llm.shared import written

MIN_WORDS, MIN_CHARS, NEAR_WORDS = 5, 20, 5
#: A text of which some word is left.
WORD = r"[^\x20\x09-\x0D]"
_C = np.uint64(0xA0761D6478BD642F)
_SECOND = np.uint64(0x8EBC6AF09C88C6E3)


class _Lines:
    """The lines with words of a slice of texts: document, number, words, and polynomial sums for hashes of any part."""

    def __init__(self, flat: np.ndarray, offs: np.ndarray):
        starts, ends, woffs = wh.word_spans(flat, offs, wh.SPACE_WORDS)
        self.words = wh.word_hashes(flat, starts, ends)
        breaks = np.flatnonzero(flat == 10)
        doc = wh.doc_of(woffs)
        number = np.searchsorted(breaks, starts) - np.searchsorted(breaks, offs[:-1])[doc]
        fresh = np.ones(len(starts), dtype=bool)
        fresh[1:] = (doc[1:] != doc[:-1]) | (number[1:] != number[:-1])
        first = np.flatnonzero(fresh)
        self.offs = np.append(first, len(starts))
        self.n = np.diff(self.offs)
        self.doc, self.number = doc[first], number[first]
        seen = np.append(0, np.cumsum(wh.SPACE_WORDS[flat] & (flat & 0xC0 != 0x80)))
        self.chars = seen[ends[self.offs[1:] - 1]] - seen[starts[first]] if len(first) else first
        self.sums = []
        for words in (self.words, wh.mix(self.words ^ _SECOND)):
            s = np.zeros(len(words) + 1, dtype=np.uint64)
            np.cumsum(words * wh.powers(wh._SEQ, len(words)), out=s[1:])
            self.sums.append(s)
        self.shift = wh.powers(wh._SEQ_INV, len(self.words) + 2)

    def keep(self, rows: np.ndarray) -> None:
        self.first, self.n = self.offs[:-1][rows], self.n[rows]
        self.doc, self.number = self.doc[rows], self.number[rows]

    def hashes(self, which: int, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of the ``size`` words from ``start`` on."""
        s = self.sums[which]
        return wh.mix((s[start + size] - s[start]) * self.shift[start] + size.astype(np.uint64) * wh._MULT)

    def without(self, which: int, line: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the lines ``line`` without their word ``at``."""
        s, a, n = self.sums[which], self.first[line], self.n[line]
        rest = (s[a + at] - s[a]) + (s[a + n] - s[a + at + 1]) * wh._SEQ_INV
        return wh.mix(rest * self.shift[a] + (n - 1).astype(np.uint64) * wh._MULT)


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64), pa.int64())


def _part(n: np.ndarray) -> np.ndarray:
    """Words in the shared part of a line whose shorter partner has ``n``: at most half of them, and mostly the same for n + 1."""
    return np.where(n < 16, n // 4 * 2, n // 8 * 4)


def _scan(min_words: int, min_chars: int, near_words: int):
    def run(batches):
        for batch in batches:
            for first, flat, offs in wh.slices(batch.column(1)):
                lines = _Lines(flat, offs)
                lines.keep(np.flatnonzero((lines.n >= min_words) | (lines.chars >= min_chars)))
                keys = []
                for less in (0, 1):  # as the shorter line or one as long as the other; as the longer one
                    p = _part(lines.n - less)
                    none = (lines.n + 1 - less < near_words) | ((p == _part(lines.n)) if less else False)
                    for kind, start in ((1, lines.first), (2, lines.first + lines.n - p)):
                        key = wh.mix(lines.hashes(0, start, p) + p.astype(np.uint64) * _C + np.uint64(kind))
                        keys.append(pa.array(key.view(np.int64), pa.int64(), mask=none))
                own = [_i64(lines.hashes(k, lines.first, lines.n)) for k in (0, 1)]
                ids = batch.column(0).take(pa.array(lines.doc + first))
                yield pa.RecordBatch.from_arrays([ids, pa.array(lines.number, pa.int32()), *own, *keys], names=["row", "line_no", "h1", "h2", "k0", "k1", "k2", "k3"])

    return run


def _pick(batches):
    """The wanted lines of each document."""
    for batch in batches:
        numbers, masks, texts, rows = [], [], [], []
        for row, (text, wanted) in enumerate(zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            lines = text.split("\n")
            for w in wanted:
                rows.append(row)
                numbers.append(w["line_no"])
                masks.append(w["mask"])
                texts.append(lines[w["line_no"]])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(masks, pa.int32()), pa.array(texts, pa.string())], names=["row", "line_no", "mask", "line"])


def _variants(near_words: int):
    def run(batches):
        for batch in batches:
            masks = np.array(batch.column(2), dtype=np.int64)
            for first, flat, offs in wh.slices(batch.column(3)):
                lines = _Lines(flat, offs)
                lines.keep(np.arange(len(lines.n)))
                mask, n = masks[lines.doc + first], lines.n
                line = np.repeat(np.arange(len(n)), n)
                at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                use = np.zeros(len(at), dtype=bool)
                for less in (0, 1):  # the edit lies outside the shared part
                    p = _part(n - less)[line]
                    use |= ((mask[line] >> (2 * less)) & 1 > 0) & (at >= p)
                    use |= ((mask[line] >> (2 * less + 1)) & 1 > 0) & (at < n[line] - p)
                use &= n[line] >= near_words
                line, at = line[use], at[use]
                keys = [np.concatenate([lines.without(k, line, at), lines.hashes(k, lines.first, n)]) for k in (0, 1)]
                rows = pa.array(lines.doc[np.concatenate([line, np.arange(len(n))])] + first)
                at = np.concatenate([at, np.full(len(n), -1)])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *[_i64(k) for k in keys], pa.array(at, pa.int32())], names=["row", "line_no", "v1", "v2", "pos"])

    return run


def _one_edit(x: str, y: str) -> bool:
    """Whether one word inserted, deleted or replaced turns one line into the other."""
    a, b = sorted((x.encode().split(), y.encode().split()), key=len)
    if len(b) - len(a) > 1:
        return False
    start = 0
    while start < len(a) and a[start] == b[start]:
        start += 1
    end = 0
    while end < len(a) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    return start + end >= len(b) - 1


def _verified(batches):
    """row, line_no where the lines x and y are one edit apart."""
    for batch in batches:
        ok = [_one_edit(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["row", "line_no"]).filter(pa.array(ok, pa.bool_()))


def _whole_copies(docs: DataFrame) -> DataFrame:
    """The rows whose text has words and stands in an earlier row too."""
    texts = docs.where(F.col("text").rlike(WORD)).select("row", F.md5("text").alias("hash"))
    first = texts.groupBy("hash").agg(F.min("row").alias("o"), F.count("*").alias("c")).where("c > 1")
    return texts.join(first, "hash").where(F.col("o") < F.col("row")).select("row")


def _dropped(docs: DataFrame, dealt: DataFrame, limits: tuple[int, int, int], whole_copies: bool) -> DataFrame:
    """row, the sorted numbers (from 0) of its lines that go, and whether it goes whole, for each row that loses some.

    docs: row, text; dealt: the same rows with one more column, dealt by row.
    """
    kind = docs.schema["row"].dataType.simpleString()
    lines = docs.mapInArrow(_scan(*limits), f"row {kind}, line_no int, h1 long, h2 long, k0 long, k1 long, k2 long, k3 long")
    distinct = written(lines.groupBy("h1", "h2").agg(F.min(F.struct("row", "line_no")).alias("o"), F.count("*").alias("c"), *[F.min(f"k{k}").alias(f"k{k}") for k in range(4)]))
    keys = distinct.select("o.*", F.posexplode(F.array("k0", "k1", "k2", "k3")).alias("which", "key")).where("key is not null")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    near = written(
        keys.join(shared, "key")
        .groupBy("row", "line_no")
        .agg(F.bit_or(F.expr("shiftleft(1, which)")).alias("mask"))
        .groupBy("row")
        .agg(F.collect_list(F.struct("line_no", "mask")).alias("wanted"))
    )
    # the join reads all of dealt, so that its exchange is the one that the final join reads; the few lines it leaves are dealt again and read three times
    chosen = dealt.join(near, "row").select("row", "text", "rest", "wanted")
    picked = chosen.mapInArrow(_pick, f"row {kind}, line_no int, mask int, line string").dropDuplicates(["row", "line_no"])
    variants = picked.mapInArrow(_variants(limits[2]), f"row {kind}, line_no int, v1 long, v2 long, pos int")
    # said once for all the joins below, so that they read one exchange
    variants = variants.where("v1 is not null and v2 is not null and pos is not null")
    # most variants are those of one line alone
    met = variants.groupBy("v1").agg(F.count("*").alias("n")).where("n > 1").select("v1")
    variants = variants.join(met, "v1", "left_semi")
    order = F.struct("row", "line_no")
    by_place = variants.groupBy("v1", "v2", "pos").agg(F.min(order).alias("m"))
    by_key = by_place.groupBy("v1", "v2").agg(F.min(F.when(F.col("pos") < 0, F.col("m"))).alias("whole"), F.min(F.when(F.col("pos") >= 0, F.col("m"))).alias("part"))
    best = by_place.join(by_key, ["v1", "v2"]).select("v1", "v2", "pos", F.when(F.col("pos") < 0, F.col("part")).otherwise(_earlier(F.col("m"), F.col("whole"))).alias("best"))
    # a near copy's first place goes here, its other places go as copies of the first
    pairs = variants.join(best, ["v1", "v2", "pos"]).where(F.col("best") < order).groupBy("row", "line_no").agg(F.min("best").alias("best"))
    # both joins by the columns that picked is dealt by
    pairs = pairs.join(picked.select("row", "line_no", F.col("line").alias("x")), ["row", "line_no"]).select(F.struct("row", "line_no").alias("late"), "best.*", "x")
    late = pairs.join(picked.select("row", "line_no", F.col("line").alias("y")), ["row", "line_no"]).select("late.*", "x", "y").mapInArrow(_verified, f"row {kind}, line_no int")
    again = distinct.where("c > 1").select("h1", "h2", "o")
    copies = lines.select("row", "line_no", "h1", "h2").join(again, ["h1", "h2"]).where(F.col("o") < order).select("row", "line_no")
    gone = copies.unionByName(late)
    if not whole_copies:
        return gone.groupBy("row").agg(F.array_sort(F.collect_set("line_no")).alias("lines"))
    gone = gone.withColumn("whole", F.lit(False)).unionByName(_whole_copies(docs).withColumn("whole", F.lit(True)), allowMissingColumns=True)
    return gone.groupBy("row").agg(F.array_sort(F.collect_set("line_no")).alias("lines"), F.max("whole").alias("whole"))


def _earlier(a: Column, b: Column) -> Column:
    return F.when(b.isNull() | (a <= b), a).otherwise(b)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS, near_words: int = NEAR_WORDS, whole_copies: bool = False) -> DataFrame:
    """docs with the dropped lines taken out of text; two more columns, n_lines and n_removed, at the end.

    With ``whole_copies`` a text that an earlier row has too loses all its lines, the short ones as well.

    A table that has columns of these names already keeps its own: the new ones then get a leading underscore.
    """
    if near_words < 5:
        raise ValueError("near_words must be 5 or more: shorter lines have no shared part to go by")
    names = {c.lower() for c in docs.columns}
    fresh = lambda c: c if c not in names else fresh("_" + c)
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    # of the type that a written table has, so that joins need no cast, which would deal the texts twice
    row = F.struct("doc_id", F.xxhash64("text").alias("t")).cast(f"struct<doc_id:{docs.schema['doc_id'].dataType.simpleString()},t:bigint>").alias("row")
    dealt = docs.select(row, "text", (F.struct(*others) if others else F.lit(0)).alias("rest")).repartition("row")
    gone = _dropped(docs.select(row, "text"), dealt, (min_words, min_chars, near_words), whole_copies)
    gone = gone.select("row", F.col("lines").alias("gone_lines"), (F.col("whole") if whole_copies else F.lit(False)).alias("gone_whole"))
    lines, drop = F.split("text", "\n", -1), F.col("gone_lines")
    whole = F.coalesce("gone_whole", F.lit(False))
    left = F.when(whole, F.lit("")).otherwise(F.concat_ws("\n", F.filter(lines, lambda x, k: ~F.array_contains(drop, k))))
    removed = F.when(whole, F.size(lines)).otherwise(F.coalesce(F.size(drop), F.lit(0)))
    made = {"doc_id": F.col("row.doc_id"), "text": F.when(drop.isNull(), F.col("text")).otherwise(left)}
    return dealt.join(gone, "row", "left").select(
        *[made.get(c, F.col("rest").getField(c)).alias(c) for c in docs.columns],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias(fresh("n_lines")),
        removed.cast("long").alias(fresh("n_removed")),
    )


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the SHA-256 of the text that is left (null: of the empty text)."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP10_SQL = rf"""
with l as (select doc_id, k - 1 line_no, t from (select doc_id, unnest(string_split(text, chr(10))) t, unnest(range(1, len(string_split(text, chr(10))) + 1)) k from documents where text is not null)),
w as (select *, len(w) n, array_to_string(w, ' ') s from (select doc_id, line_no, regexp_extract_all(t, '[^\x20\x09-\x0D]+') w from l) where len(w) >= {MIN_WORDS} or length(array_to_string(w, '')) >= {MIN_CHARS}),
f as (select s, min(struct_pack(d := doc_id, l := line_no)) o, any_value(w) w, any_value(n) n from w group by s),
v as (select s, o, i - 1 pos, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') v from (select *, unnest(range(1, n + 1)) i from f where n >= {NEAR_WORDS})),
m as (select v, pos, min(o) m from v group by 1, 2),
near as (select v.s from v join m on v.v = m.v and v.pos = m.pos where m.m < v.o
  union select v.s from v join f on v.v = f.s where f.o < v.o
  union select f.s from f join v on v.v = f.s where v.o < f.o),
gone as (select w.doc_id, w.line_no from w join f on w.s = f.s where f.o < struct_pack(d := w.doc_id, l := w.line_no) or w.s in (select s from near)),
kept as (select l.doc_id, string_agg(t, chr(10) order by l.line_no) t from l left join gone g on l.doc_id = g.doc_id and l.line_no = g.line_no where g.doc_id is null group by 1)
select d.doc_id, cast(coalesce(len(string_split(text, chr(10))), 0) as bigint) n_lines, coalesce(g.c, 0) n_removed, sha256(coalesce(t, '')) kept_sha256
from documents d left join kept k on d.doc_id = k.doc_id left join (select doc_id, count(*) c from gone group by 1) g on d.doc_id = g.doc_id
"""
