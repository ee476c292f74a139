"""Operator 13 - repair of conversations by a lazily determinised weighted automaton.

Each row of a conversation may be kept, given another role or deleted, and empty rows may be inserted, each at a
cost, so that the roles' initials read ``(s?(ua)+)?``. From the last row to the first, the least cost of what is still to
come is a vector over the grammar's four states. Without its minimum such a vector is one of few, however long the conversation:
these are the states of a deterministic automaton, whose transitions (the next vector, and what the minimum grew by) are
computed when first met and looked up from then on. The scan over a conversation is one look-up for each row; a trace from
the first row on takes, of the edits that lose nothing, the one with the least letter.

Rows are dealt by ranges of conversation, turn, role and text's digest, without texts, so a long conversation is several
pieces. A piece is scanned once for each state it may end in, which gives its costs as a matrix; matrices are multiplied along
a conversation (costs added, least taken), and each piece is then traced by itself. Texts are dealt once, by conversation
and in order, and read through as a stream: the repaired rows go into a digest that needs no more than one batch.
A digest is of all rows in a row, so the rows of a conversation pass through one task, whose memory does not grow with them.

Edge cases: a null role or text is one space, a null conv_id or turn one space within the key that decides on damage; rows without
conv_id are one conversation. Rows of one turn (null first) are in order of role and then of the text's SHA-256, so that repeated
rows are neighbours. A conversation without rows after damage has zeros, no edits and the digest of nothing. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from brontide.llm.shared import written

#: Costs of edits, and of leaving a truncated row in.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: The grammar: 0 nothing yet, 1 after s, 2 after u, 3 after a; where an initial leads, and the states that may be the last.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
LAST = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
NONE = 1 << 40
#: Symbols of rows: a blank one, a duplicate one, or its initial (x: another one), upper case if it is truncated.
BLANK, DUPLICATE = "b", "d"
#: Rows in a piece of a conversation, about.
PIECE_ROWS = 200_000
NO_SPACE = r"[^\x20\x09-\x0D]"


class Automaton:
    """Normalised vectors of costs as states, made when first met."""

    def __init__(self):
        self.vectors: list[tuple] = []
        self.known: dict[tuple, int] = {}
        self.table: dict[tuple[int, str], tuple[int, int]] = {}

    def state(self, vector) -> tuple[int, int]:
        """The state of a vector and what it lies above it."""
        low = min(vector)
        key = tuple(v - low if v < NONE else NONE for v in vector)
        if key not in self.known:
            self.known[key] = len(self.vectors)
            self.vectors.append(key)
        return self.known[key], low

    def step(self, state: int, symbol: str) -> tuple[int, int]:
        """The state before a row with this symbol, from the one after it."""
        found = self.table.get((state, symbol))
        if found is None:
            found = self.table[state, symbol] = self.state(with_inserts([min(c for c, _, _ in edits(self.vectors[state], q, symbol)) for q in range(4)]))
        return found

    def scan(self, symbols: str, vector) -> tuple[list[int], int]:
        """The states after each row and before the first, and what the first one's costs lie above it."""
        state, total = self.state(vector)
        out = [state]
        table = self.table
        for symbol in reversed(symbols):
            state, more = table.get((state, symbol)) or self.step(state, symbol)
            total += more
            out.append(state)
        out.reverse()
        return out, total

    def trace(self, symbols: str, vector, entry: int, last: bool) -> tuple[str, int]:
        """The least letters of the cheapest edits from a state on, and the state they end in; rows are inserted after the last one only at the end of all."""
        states, _ = self.scan(symbols, vector)
        out, q, k = [], entry, 0
        while k < len(symbols):
            before, after = self.vectors[states[k]], self.vectors[states[k + 1]]
            # vectors lack their minima: the row's own edits say by how much they differ
            lift = self.table[states[k + 1], symbols[k]][1]
            tight = [(letter, to, 1) for c, letter, to in edits(after, q, symbols[k]) if c - lift == before[q]]
            into = STEPS.get((q, "u"), STEPS.get((q, "a")))
            if INSERT + before[into] == before[q]:
                tight.append(("I", into, 0))
            letter, q, used = min(tight)
            out.append(letter)
            k += used
        while last and q not in LAST:
            out.append("I")
            q = STEPS.get((q, "u"), STEPS.get((q, "a")))
        return "".join(out), q


def edits(after, q: int, symbol: str) -> list[tuple[int, str, int]]:
    """(cost with what comes after, letter, state) of each edit of a row in state q."""
    out = [(DELETE + after[q], "D", q)]
    if symbol not in (BLANK, DUPLICATE):
        rest = TRUNCATED if symbol.isupper() else 0
        to = STEPS.get((q, symbol.lower()))
        if to is not None:
            out.append((rest + after[to], "K", to))
        out += [(REROLE + rest + after[STEPS[q, x]], "R", STEPS[q, x]) for x in ROLES if (q, x) in STEPS]
    return out


def with_inserts(costs: list[int]) -> tuple:
    for _ in range(3):
        costs = [min(c, INSERT + min(costs[STEPS[q, x]] for x in ROLES if (q, x) in STEPS)) for q, c in enumerate(costs)]
    return tuple(min(c, NONE) for c in costs)


#: The costs after the last row: rows may still be inserted.
END = with_inserts([0 if q in LAST else NONE for q in range(4)])


def damage(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) after damage; a row's fate hangs on its conversation and turn."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    x = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fate.alias("fate")).where("fate <> 0")
    x = x.withColumn("text", F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    x = x.withColumn("role", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")))
    return x.withColumn("again", F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("fate", "again")


def _symbol(text: Column, role: Column) -> Column:
    initial = F.when(F.substring(role, 1, 1).isin("s", "u", "a"), F.substring(role, 1, 1)).otherwise("x")
    return F.when(~text.rlike(NO_SPACE), BLANK).when(text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), initial).otherwise(F.upper(initial))


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, sha, symbol, n, first: rows without their texts, equal ones as one with their number n; first: none before has its role and text.

    symbol: b for a blank row, else the role's initial, upper case if the text is truncated.
    """
    told = rows.select("conv_id", "turn", "role", F.sha2("text", 256).alias("sha"), _symbol(F.col("text"), F.col("role")).alias("symbol"))
    one = told.groupBy("conv_id", "turn", "role", "sha").agg(F.first("symbol").alias("symbol"), F.count("*").alias("n"))
    least = one.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("sha").alias("s")).agg(F.min(F.struct("turn")).alias("least"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("sha") == F.col("s"))
    return one.join(least, same).select("conv_id", "turn", "role", "sha", "symbol", "n", F.col("turn").eqNullSafe(F.col("least.turn")).alias("first"))


def pieces(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Pieces of conversations as a written table: conv_id, piece (in order), symbols, initials, counts and turns."""
    spark = rows.sparkSession
    flat = written(faults(rows))
    parts = max(1, -(-flat.count() // piece_rows))
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "sha")]
    x = flat.repartitionByRange(max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))), *order).withColumn("piece", F.spark_partition_id())
    # a row that repeats itself, or an earlier one, is a duplicate; of a blank one all are blank
    own = F.when(F.col("symbol") == BLANK, F.expr(f"repeat('{BLANK}', cast(n as int))")).otherwise(F.concat(F.when(F.col("first"), F.col("symbol")).otherwise(DUPLICATE), F.expr(f"repeat('{DUPLICATE}', cast(n as int) - 1)")))
    x = x.withColumn("row", F.struct("turn", "role", "sha", own.alias("symbols"), F.expr("repeat(substring(if(role = '', ' ', role), 1, 1), cast(n as int))").alias("initials")))
    # nulls come first in the order of structs
    g = x.groupBy("conv_id", "piece").agg(F.sort_array(F.collect_list("row")).alias("rows"), F.min("turn").alias("low"), F.max("turn").alias("high"), F.count_distinct("turn").alias("turns"))
    return written(g.select("conv_id", "piece", F.array_join("rows.symbols", "").alias("symbols"), F.array_join("rows.initials", "").alias("initials"), "low", "high", "turns"))


def _matrices(batches):
    """conv_id, piece, costs from each state to each, and what else joins up along a conversation."""
    automaton = Automaton()
    unit = [tuple(0 if a == b else NONE for a in range(4)) for b in range(4)]
    for batch in batches:
        symbols, initials = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        costs = []
        for s in symbols:
            own = np.empty((4, 4), dtype=np.int64)
            for b in range(4):
                states, total = automaton.scan(s, unit[b])
                own[:, b] = np.minimum(np.array(automaton.vectors[states[0]]) + total, NONE)
            costs.append(own.ravel().tolist())
        counts = [pa.array([s.count(BLANK) for s in symbols], pa.int64()), pa.array([s.count(DUPLICATE) for s in symbols], pa.int64()), pa.array([sum(map(str.isupper, s)) for s in symbols], pa.int64())]
        illegal = pa.array([sum(a + b not in ("su", "ua", "au") for a, b in zip(s, s[1:], strict=False)) for s in initials], pa.int64())
        ends = [pa.array([s[k] for s in initials], pa.string()) for k in (0, -1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(costs, pa.list_(pa.int64())), *counts, illegal, *ends, *(batch.column(k) for k in (4, 5, 6))], names=[c.split()[0] for c in ("conv_id", *_PART.split(", "))])


_PART = "piece int, costs array<bigint>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, head string, tail string, low bigint, high bigint, turns bigint"
_WHOLE = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"


def _joined(batches):
    """One row for each conversation: its counts and cost, and for each piece the costs after it and the state it starts in."""
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "parts")}
        for parts in batch.column(1).to_pylist():
            after = [END]
            for p in reversed(parts[1:]):
                m = np.array(p["costs"]).reshape(4, 4)
                after.append(tuple(np.minimum((m + np.array(after[-1])).min(axis=1), NONE).tolist()))
            after.reverse()
            told = [{"piece": p["piece"], "after": list(v), "last": p is parts[-1]} for p, v in zip(parts, after, strict=True)]
            first = (np.array(parts[0]["costs"]).reshape(4, 4) + np.array(after[0])).min(axis=1)
            seam = list(zip(parts, parts[1:], strict=False))
            turns = sum(p["turns"] for p in parts) - sum(a["high"] is not None and a["high"] == b["low"] for a, b in seam)
            known = [p for p in parts if p["low"] is not None]
            out["gaps"].append(max(p["high"] for p in known) - min(p["low"] for p in known) + 1 - turns if known else 0)
            for c in ("blank", "duplicate", "truncated"):
                out[c].append(sum(p[c] for p in parts))
            out["illegal"].append(sum(p["illegal"] for p in parts) + sum(a["tail"] + b["head"] not in ("su", "ua", "au") for a, b in seam))
            out["cost"].append(int(first[0]))
            out["parts"].append(told)
        kinds = [pa.int64()] * 6 + [pa.list_(pa.struct([("piece", pa.int32()), ("after", pa.list_(pa.int64())), ("last", pa.bool_())]))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], names=["conv_id", *out])


def _traced(batches):
    """For each piece the edits from each of the four states, and the states they end in."""
    automaton = Automaton()
    for batch in batches:
        letters, ends = [], []
        for symbols, after, last in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
            own = [automaton.trace(symbols, tuple(after), q, last) for q in range(4)]
            letters.append([a for a, _ in own])
            ends.append([q for _, q in own])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(letters, pa.list_(pa.string())), pa.array(ends, pa.list_(pa.int32()))], names=["conv_id", "piece", "letters", "ends"])


class _Repair:
    """A conversation's rows, one after the other, by its edits."""

    def __init__(self):
        self.audit, self.at, self.q, self.digest, self.any = "", 0, 0, hashlib.sha256(), False

    def put(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True

    def insert(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            initial = "u" if (self.q, "u") in STEPS else "a"
            self.put(ROLES[initial], "")
            self.q = STEPS[self.q, initial]
            self.at += 1

    def row(self, role: str, text: str, n: int) -> None:
        for _ in range(n):
            self.insert()
            letter = self.audit[self.at]
            self.at += 1
            if letter == "D":
                continue
            initial = role[:1] if letter == "K" else "u" if (self.q, "u") in STEPS else "a"
            self.put(role if letter == "K" else ROLES[initial], text)
            self.q = STEPS[self.q, initial]

    def end(self) -> str:
        self.insert()
        return self.digest.hexdigest()


def _streamed(batches):
    """Rows sorted by conversation: its head, its pieces' edits in order, its rows in order -> conv_id, audit, repaired_sha256."""
    own, repair, state = None, None, 0
    done: tuple[list, list, list] = ([], [], [])
    names = ["conv_id", "told", "audit", "repaired_sha256"]

    def closed() -> None:
        if repair is not None:
            for into, x in zip(done, (own, repair.audit, repair.end()), strict=True):
                into.append(x)

    for batch in batches:
        ids, kinds = batch.column(0), batch.column(1).to_pylist()
        columns = [batch.column(k).to_pylist() for k in range(2, 7)]
        for k, kind in enumerate(kinds):
            if kind == 0:
                closed()
                own, repair, state = (ids.slice(k, 1), columns[4][k]), _Repair(), 0
            elif kind == 1:
                letters, ends = columns[3][k]["letters"], columns[3][k]["ends"]
                repair.audit += letters[state]
                state = ends[state]
            else:
                repair.row(columns[0][k], columns[1][k], columns[2][k])
        if done[0]:
            yield _closed(done, names)
            done = ([], [], [])
    closed()
    if done[0]:
        yield _closed(done, names)


_TOLD = pa.struct([(c.split()[0], pa.int64()) for c in _WHOLE.split(", ")])


def _closed(done: tuple, names: list[str]) -> pa.RecordBatch:
    ids = pa.concat_arrays([i for i, _ in done[0]])
    return pa.RecordBatch.from_arrays([ids, pa.array([t for _, t in done[0]], _TOLD), pa.array(done[1], pa.string()), pa.array(done[2], pa.string())], names=names)


def repair(conversations: DataFrame, damaged: DataFrame | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """One row for each conv_id of ``conversations``: the faults, cost, edits and digest of repair of its rows in ``damaged`` (default: the same rows)."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")) if damaged is None else damaged
    rows = rows.withColumn("turn", F.col("turn").cast("long"))
    id_ = StructField("conv_id", conversations.schema["conv_id"].dataType)
    ddl = lambda text: StructType([id_, *StructType.fromDDL(text).fields])
    table = pieces(rows, piece_rows)
    parts = table.mapInArrow(_matrices, ddl(_PART))
    part = F.struct(*[c.split()[0] for c in _PART.split(", ")])
    whole = written(parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("parts")).mapInArrow(_joined, ddl(_WHOLE + ", parts array<struct<piece:int,after:array<bigint>,last:boolean>>")))
    each = whole.select(F.col("conv_id").alias("c"), F.explode("parts").alias("p")).select("c", F.col("p.piece").alias("k"), "p.after", "p.last")
    traced = table.join(each, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("piece") == F.col("k"))).select("conv_id", "piece", "symbols", "after", "last").mapInArrow(_traced, ddl("piece int, letters array<string>, ends array<int>"))

    told = F.struct(*[c.split()[0] for c in _WHOLE.split(", ")])
    none = {"role": "string", "text": "string", "n": "bigint", "edit": "struct<letters:array<string>,ends:array<int>>", "told": "struct<" + ",".join(":".join(c.split()) for c in _WHOLE.split(", ")) + ">", "place": "struct<piece:int,turn:bigint,role:string,sha:string>"}

    def lines(df: DataFrame, kind: int, **has) -> DataFrame:
        return df.select("conv_id", F.lit(kind).alias("kind"), *[has.get(c, F.lit(None)).cast(t).alias(c) for c, t in none.items()])

    null = F.lit(None)
    heads = conversations.select("conv_id").distinct()
    heads = heads.join(whole.select(F.col("conv_id").alias("c"), told.alias("told")), F.col("conv_id").eqNullSafe(F.col("c")), "left")
    texts = rows.withColumn("sha", F.sha2("text", 256))
    stream = (
        lines(heads, 0, told=F.col("told"))
        .unionByName(lines(traced, 1, edit=F.struct("letters", "ends"), place=F.struct("piece", null.alias("turn"), null.alias("role"), null.alias("sha"))))
        .unionByName(lines(texts, 2, role=F.col("role"), text=F.col("text"), n=F.lit(1), place=F.struct(null.alias("piece"), "turn", "role", "sha")))
    )
    order = [F.asc_nulls_first(c) for c in ("conv_id", "kind", "place")]
    out = stream.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "kind", "role", "text", "n", "edit", "told").mapInArrow(_streamed, ddl(f"told struct<{','.join(':'.join(c.split()) for c in _WHOLE.split(', '))}>, audit string, repaired_sha256 string"))
    return out.select("conv_id", *[F.coalesce(f"told.{c.split()[0]}", F.lit(0)).cast("long").alias(c.split()[0]) for c in _WHOLE.split(", ")], "audit", "repaired_sha256")


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair(rows, damage(rows))


OP13_SQL = r"""
with recursive tab as (select list(v order by i) t from (select i, list_reduce([i::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) v from range(256) r(i))),
c0 as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ord(x)::bigint) codes, t from conversations, tab),
c as (select conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::bigint, codes), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) % 20 fate from c0),
d as (select conv_id, turn, case when fate = 4 then 'user' else role end as role, case fate when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case when fate = 3 then [0, 1] else [0] end) again from c where fate <> 0),
g as (select conv_id, row_number() over (order by conv_id nulls first) g from (select distinct conv_id from conversations)),
f as (select g.g, d.turn, d.role, d.text, d.role[1] ini, row_number() over (partition by g.g order by d.turn nulls first, d.role, sha256(d.text), again) i,
  not regexp_matches(d.text, '[^\x20\x09-\x0D]') blank, row_number() over (partition by g.g, d.role, d.text order by d.turn nulls first, again) > 1 seen, not regexp_matches(d.text, '[.!?][\x20\x09-\x0D]*$') cut from d join g on g.conv_id is not distinct from d.conv_id),
r as (select *, blank or seen gone, case when cut and not blank and not seen then 1 else 0 end t, case when i > 1 then lag(ini) over (partition by g order by i) || ini end pair, count(*) over (partition by g) n from f),
s as (select g, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint gaps, count(*) filter (blank) blank, count(*) filter (seen and not blank) duplicate, sum(t)::bigint truncated, count(*) filter (pair not in ('su', 'ua', 'au')) illegal from r group by 1),
h as (select g, n + 1 i, 0 h0, 4 h1, 2 h2, 0 h3 from (select distinct g, n from r)
  union all select g, i, least(e0, 2 + e2, 4 + e3), least(e1, 2 + e2, 4 + e3), least(e2, 2 + e3), least(e3, 2 + e2) from (select r.g, r.i,
    least(3 + h0, case when gone then 99999999 when ini = 's' then t + h1 when ini = 'u' then t + h2 else 99999999 end, case when gone then 99999999 else 2 + t + h2 end) e0,
    least(3 + h1, case when gone then 99999999 when ini = 'u' then t + h2 else 2 + t + h2 end) e1,
    least(3 + h2, case when gone then 99999999 when ini = 'a' then t + h3 else 2 + t + h3 end) e2,
    least(3 + h3, case when gone then 99999999 when ini = 'u' then t + h2 else 2 + t + h2 end) e3 from h join r on r.g = h.g and r.i = h.i - 1)),
hs as (select g, i, [h0, h1, h2, h3] v from h),
tr as (select g, 1::bigint i, 0 q, ''::varchar audit, []::varchar[] lines from (select distinct g from r)
  union all select g, case letter when 'I' then i else i + 1 end, case letter when 'D' then q when 'K' then kept else into_ end, audit || letter, case letter when 'D' then lines when 'I' then list_append(lines, who || ':') when 'K' then list_append(lines, role || ':' || text) else list_append(lines, who || ':' || text) end
  from (select *, case when i <= n and 3 + w[1 + q] = v[1 + q] then 'D' when 2 + v[1 + into_] = v[1 + q] then 'I' when i <= n and not gone and kept >= 0 and t + w[1 + kept] = v[1 + q] then 'K' when i <= n and not gone and 2 + t + w[1 + into_] = v[1 + q] then 'R' end letter
    from (select tr.*, a.v, b.v w, m.n, r.role, r.text, r.gone, r.t, case when q = 2 then 3 else 2 end into_, case when q = 2 then 'assistant' else 'user' end who, case when q = 0 and r.ini = 's' then 1 when q <> 2 and r.ini = 'u' then 2 when q = 2 and r.ini = 'a' then 3 else -1 end kept
      from tr join (select distinct g, n from r) m on m.g = tr.g join hs a on a.g = tr.g and a.i = tr.i left join hs b on b.g = tr.g and b.i = tr.i + 1 left join r on r.g = tr.g and r.i = tr.i where not (tr.i > m.n and q in (0, 3)))))
select g.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal, coalesce(hs.v[1], 0)::bigint as cost, coalesce(audit, '') audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) repaired_sha256
from g left join s using (g) left join hs on hs.g = g.g and hs.i = 1 left join (select tr.* from tr join (select distinct g, n from r) m on m.g = tr.g where tr.i > m.n and q in (0, 3)) z on z.g = g.g
"""
