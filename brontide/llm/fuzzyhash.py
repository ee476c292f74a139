"""Operator 12 - document fingerprints by context-triggered piecewise hashing.

A hash of the last ``ROLL`` bytes is rolled over a text's UTF-8 bytes. Where it is one less than a multiple of the block
size (three times a power of two), a chunk ends; ends at one block size are ends at all smaller ones. A chunk's hash
gives one of 64 letters, and the letters of a text's chunks are its signature. The block size is the least of which
``USUAL`` are as long as the text, so that texts of half the length or double have the next one; the fingerprint
``block size:signature:signature:signature`` has the signatures of the next two sizes as well. All chunks from the last of ``MOST`` on
are one, so every byte counts however long a text is. Fingerprints are compared at each
block size that both have: by the edit distance of the signatures (a replacement counts two), as a share of their
letters, where they share a run of ``RUN`` letters or one is shorter than that and all in the other.

Edge cases: a null text is empty; the fingerprint of an empty text has empty signatures, is like that of another
empty text by 1 and like all others by 0. Equal texts have equal fingerprints. Texts of one repeated character have a letter or a
few. In ``edited`` documents follow each other by doc_id (null first) and text; repeated rows get a row each, one document
alone follows itself, and an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from brontide.llm import wordhash as wh
from brontide.llm.shared import keyed, written

ROLL, USUAL, MOST, RUN, LEVELS = 7, 48, 64, 4, 3
_LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8)
_RNG = np.random.default_rng(20240612)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROLL = np.uint64(0xC2B2AE3D27D4EB4F)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def chunk_levels(flat: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each byte the greatest k so that a chunk of block size 3 * 2**k ends there, or -1; the bytes before a text's first count as none."""
    sizes = np.diff(offs)
    place = np.arange(len(flat)) - np.repeat(offs[:-1], sizes)
    codes = _BYTE[flat]
    rolled, factor = codes.copy(), np.uint64(1)
    for j in range(1, ROLL):
        factor = np.uint64(int(factor) * int(_ROLL) & 0xFFFFFFFFFFFFFFFF)
        rolled[j:] += np.where(place[j:] >= j, codes[:-j] * factor, np.uint64(0))
    x = (wh.mix(rolled) >> np.uint64(32)) + np.uint64(1)
    level = np.full(len(flat), -1, dtype=np.int64)
    third = np.flatnonzero(x % np.uint64(3) == 0)
    y = x[third] // np.uint64(3)
    level[third] = np.log2((y & (~y + np.uint64(1))).astype(np.float64)).astype(np.int64)
    return level


def signatures(flat: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The level of each text's block size, and its signatures as letters, filled up with zeros: (n,), (n, LEVELS, MOST)."""
    n, sizes = len(offs) - 1, np.diff(offs)
    out, chosen = np.zeros((n, LEVELS, MOST), dtype=np.uint8), np.zeros(n, dtype=np.int64)
    if not len(flat):
        return chosen, out
    doc, level = np.repeat(np.arange(n), sizes), chunk_levels(flat, offs)
    last = offs[1:][sizes > 0] - 1
    ends = np.flatnonzero(level >= 0)
    chosen = np.ceil(np.log2(np.maximum(sizes / (3 * USUAL), 1))).astype(np.int64)
    sums = np.zeros(len(flat) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[flat] * wh.powers(_STEP, len(flat)), out=sums[1:])
    back = wh.powers(_BACK, len(flat) + 1)
    for j in range(LEVELS):
        end = np.union1d(ends[level[ends] >= chosen[doc[ends]] + j], last)
        rank = np.arange(len(end)) - np.searchsorted(doc[end], doc[end])
        end = end[(rank < MOST - 1) | (end == offs[doc[end] + 1] - 1)]
        of = doc[end]
        first = np.searchsorted(of, np.arange(n))
        start = np.append(0, end[:-1] + 1)
        start = np.maximum(start, offs[of])
        code = wh.mix((sums[end + 1] - sums[start]) * back[start] + (end - start).astype(np.uint64))
        out[of, j, np.arange(len(end)) - first[of]] = _LETTERS[(code >> np.uint64(58)).astype(np.int64)]
    return chosen, out


def of_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    parts = [signatures(flat, offs) for _, flat, offs in wh.slices(texts)]
    return (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else (np.zeros(0, dtype=np.int64), np.zeros((0, LEVELS, MOST), dtype=np.uint8))


def written_out(chosen: np.ndarray, letters: np.ndarray) -> list[str]:
    return [":".join([str(3 << int(k)), *(row.tobytes().rstrip(b"\0").decode() for row in rows)]) for k, rows in zip(chosen, letters, strict=True)]


def read(fingerprints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """What ``written_out`` wrote."""
    chosen, letters = np.zeros(len(fingerprints), dtype=np.int64), np.zeros((len(fingerprints), LEVELS, MOST), dtype=np.uint8)
    for i, text in enumerate(fingerprints):
        size, *rows = text.split(":")
        chosen[i] = (int(size) // 3).bit_length() - 1
        for j, row in enumerate(rows):
            letters[i, j, : len(row)] = np.frombuffer(row.encode(), dtype=np.uint8)
    return chosen, letters


def common_letters(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The length of the longest common subsequence of each pair of rows of letters, a bit for each letter of a."""
    bit = np.uint64(1) << np.arange(MOST, dtype=np.uint64)
    v = np.full(len(a), ~np.uint64(0))
    for j in range(MOST):
        if not b[:, j].any():
            break
        same = (((a == b[:, j : j + 1]) & (b[:, j : j + 1] > 0)) * bit).sum(axis=1, dtype=np.uint64)
        u = v & same
        v = (v + u) | (v - u)
    return np.bitwise_count(~v).astype(np.int64)


def share_run(a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether each pair of rows has a run of RUN letters in common, or of ``length`` where that is less."""
    out = np.zeros(len(a), dtype=bool)
    for size in range(1, RUN + 1):
        own = np.flatnonzero(np.minimum(length, RUN) == size)
        if not len(own):
            continue
        grams = []
        for x in (a[own], b[own]):
            g = np.zeros((len(own), MOST - size + 1), dtype=np.int64)
            for k in range(size):
                g = g * 256 + x[:, k : MOST - size + 1 + k]
            g[x[:, size - 1 :] == 0] = 0
            grams.append(g)
        both = np.sort(np.concatenate([_once(grams[0]), _once(grams[1])], axis=1), axis=1)
        out[own] = ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] > 0)).any(axis=1)
    return out


def _once(g: np.ndarray) -> np.ndarray:
    """Each row sorted, with zeros for repeated values."""
    g = np.sort(g, axis=1)
    g[:, 1:][g[:, 1:] == g[:, :-1]] = 0
    return g


def likeness(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints."""
    (ka, a), (kb, b) = one, other
    best = np.zeros(len(ka))
    for i in range(LEVELS):
        for j in range(LEVELS):
            own = np.flatnonzero(ka + i == kb + j)
            x, y = a[own, i], b[own, j]
            lx, ly = (x > 0).sum(axis=1), (y > 0).sum(axis=1)
            some = np.flatnonzero(share_run(x, y, np.minimum(lx, ly)))
            best[own[some]] = np.maximum(best[own[some]], 2 * common_letters(x[some], y[some]) / (lx + ly)[some])
    best[((a[:, 0, 0] == 0) & (b[:, 0, 0] == 0))] = 1.0
    return best


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and fingerprint of each text."""

    def run(batches):
        for batch in batches:
            offs = wh.text_bytes(batch.column(1))[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offs), pa.int64()), pa.array(written_out(*of_texts(batch.column(1))), pa.string())], names=["doc_id", "n_bytes", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, keyed(docs, "n_bytes long, fingerprint string"))


def compare(pairs: DataFrame, one: str, other: str) -> DataFrame:
    """pairs with likeness of the fingerprints in two of its columns; null where one is null."""

    def run(batches):
        for batch in batches:
            a, b = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (one, other))
            told = likeness(read([x or "3" for x in a]), read([x or "3" for x in b]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if x is None or y is None else float(v) for x, y, v in zip(a, b, told, strict=True)], pa.float64())], names=[*batch.schema.names, "likeness"])

    return pairs.mapInArrow(run, StructType([*pairs.schema.fields, StructField("likeness", DoubleType())]))


_TOLD = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _told(texts: list[str], following: list[str]) -> list[pa.Array]:
    """The columns of _TOLD for texts and those that follow them."""
    edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, following, strict=True)]
    # most texts follow another one here, so what follows is mostly known
    own, changed = of_texts(pa.array(texts, pa.large_string())), of_texts(pa.array(edited, pa.large_string()))
    last = of_texts(pa.array(following[-1:], pa.large_string()))
    after = tuple(np.concatenate([x[1:], y]) for x, y in zip(own, last, strict=True))
    lengths = pa.array([len(t) for t in texts], pa.int64())
    shas = pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string())
    return [lengths, shas, pa.array(written_out(*own), pa.string()), pa.array(written_out(*changed), pa.string()), pa.array(likeness(own, changed)), pa.array(likeness(own, after))]


def _in_order(batches):
    """Rows of one partition, sorted: what is told of all but the last, and its first and last row as they are (side 0 and 1)."""
    names = ["doc_id", *(c.split()[0] for c in _TOLD.split(", ")), "side", "part", "text"]
    part, carried, ids = TaskContext.get().partitionId(), None, None

    def border(id_: pa.Array, text: str, side: int) -> pa.RecordBatch:
        none = [pa.nulls(1, pa.int64()), *[pa.nulls(1, pa.string())] * 3, *[pa.nulls(1, pa.float64())] * 2]
        return pa.RecordBatch.from_arrays([id_, *none, pa.array([side], pa.int32()), pa.array([part], pa.int32()), pa.array([text], pa.string())], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        texts, own = [t or "" for t in batch.column(1).to_pylist()], batch.column(0)
        if carried is None:
            yield border(own.slice(0, 1), texts[0], 0)
        else:
            texts, own = [carried, *texts], pa.concat_arrays([ids, own])
        carried, ids = texts[-1], own.slice(len(own) - 1, 1)
        n = len(texts) - 1
        if n:
            told = _told(texts[:-1], texts[1:])
            yield pa.RecordBatch.from_arrays([own.slice(0, n), *told, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], names=names)
    if carried is not None:
        yield border(ids, carried, 1)


def _pairs(batches):
    names = ["doc_id", *(c.split()[0] for c in _TOLD.split(", "))]
    for batch in batches:
        for k in range(batch.num_rows):
            told = _told([batch.column(1)[k].as_py()], [batch.column(2)[k].as_py()])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), *told], names=names)


def edited(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of its edited text - the last half of its characters replaced by as many of the next document's - and the next document's.

    Documents are dealt by ranges of doc_id and sorted; a task reads through its range and holds one batch. Only the last of a
    range needs a row of another range: first and last rows of ranges are written with the results and paired there.
    """
    schema = keyed(docs, f"{_TOLD}, side int, part int, text string")
    dealt = docs.select("doc_id", "text").repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    table = written(dealt.mapInArrow(_in_order, schema))
    parts = sorted(r[0] for r in table.where("side = 0").select("part").collect())
    follow = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next int")
    first = table.where("side = 0").select(F.col("part").alias("next"), F.col("text").alias("following"))
    last = table.where("side = 1").select("doc_id", "part", "text").join(follow, "part").join(first, "next").select("doc_id", "text", "following")
    out = keyed(docs, _TOLD)
    return table.where("side is null").select(*out.names).unionByName(last.mapInArrow(_pairs, out))


def op12_piecewise_hash(spark, sf_dir: str) -> DataFrame:
    return edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
