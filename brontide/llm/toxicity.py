"""Operator 4 - toxicity by a weighted finite-state pattern grammar.

A text's words are marked as insult, threat, target, negation or reported speech; all others are
plain. Per clause - between marks of punctuation or line ends - the marks go through the composition of
five weighted transducers, which read a mark and write one on every arc:

* negation: an insult or threat shortly after a negation becomes a denied one;
* reported speech: what follows a verb of saying becomes quoted;
* target: an insult near an address becomes aimed, before or after it, and a threat counts only with one. The
  address may come later, so the machine guesses and a path whose guess fails ends without a score;
* insult: an arc with a weight for each kind of insult, another for those that follow a first one;
* threat: likewise for threats that are aimed, denied or quoted.

An arc's weight is that of its feature. A clause's score is the weight of its best path, and the features on
that path are its matched patterns. A logistic model over the patterns of all clauses gives the text's score;
its weights are those of the arcs, so they are fitted in turns: best paths under the weights so far, then
weights for the patterns found (``TURNS``).

The insult lexicon starts from a short list and learns words and stems (beginnings of 4 to 8 letters) from a
bounded sample of labelled rows (``SAMPLE``): those in a share of toxic texts, hardly in others, and in
many different contexts, so that the words of one much-copied text don't pass. The weights are fitted on the
same sample.

Edge cases: a null or empty text, or one without marks, gets the model's base rate. Labels with a null
id or mark are left out; with no labels the built-in lists and weights stand. Repeated rows get equal
scores; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brontide.llm import wordhash as wh
from brontide.llm.shared import keyed

#: Words and, with a star, stems.
INSULT = "idiot* moron* stupid* dumb dumbass* fool fools foolish loser losers scum* trash pathetic* worthless* disgusting* clown clowns coward* filth* vermin ugly bastard* creep creeps jerk jerks imbecile* cretin* dimwit* halfwit* nitwit* scumbag* lowlife* degenerate* retard* freak freaks pig pigs rat rats braindead brainless dolt* buffoon* bimbo* slob* sleazebag* shithead* asshole* arsehole* dickhead* bitch* slut* whore* wanker* twat*"
THREAT = "kill* hurt hurting destroy* beat beating punish* shoot* stab* crush* murder* burn burning hang hanging attack* strangle* choke choking slaughter* smash* maim* behead* rape* lynch* drown* bomb bombing execute"
TARGET = "you your yours yourself yourselves u ya he she they them him her his their theirs people those these everyone everybody all"
NEGATION = "not no never isn't aren't wasn't weren't don't doesn't didn't won't wouldn't can't cannot without neither nor hardly"
REPORT = "said says say saying told tells wrote writes called calls calling claims claimed reported reports quoted quotes according alleged allegedly"
PLAIN, INS, THR, TGT, NEG, REP = range(6)
SAMPLE, TURNS = 8000, 2
LEAST_SHARE, LEAST_LIFT, LEAST_CONTEXTS = 0.02, 20.0, 8
STEMS = range(4, 9)
SPAN = 4
FEATURES = ("insult", "aimed", "denied", "quoted", "more", "threat", "threat_denied", "threat_quoted")
_OPEN = [FEATURES.index(f) for f in ("insult", "aimed", "threat")]
PRIOR = np.array([2.0, 2.5, 0.3, 0.3, 1.0, 2.5, 0.2, 0.3, 2.0])


class Transducer:
    """A transducer over marks: ``arcs(state, mark)`` yields (next state, mark written, features of the arc); ``final`` says where a path may end."""

    def __init__(self, start, arcs, final=lambda state: True):
        self.start, self.arcs, self.final = start, arcs, final

    def then(self, other: Transducer) -> Transducer:
        """The composition: the other one reads what this one writes."""

        def arcs(state, mark):
            for mine, out, found in self.arcs(state[0], mark):
                for theirs, last, more in other.arcs(state[1], out):
                    yield (mine, theirs), last, found + more

        return Transducer((self.start, other.start), arcs, lambda state: self.final(state[0]) and other.final(state[1]))


def _negation(left: int, mark: str):
    """left: how many plain words the last negation still reaches."""
    if mark == "N":
        yield SPAN, mark, ()
    elif mark == "o":
        yield max(0, left - 1), mark, ()
    else:
        yield left, {"I": "i", "T": "t"}.get(mark, mark) if left else mark, ()


def _report(on: bool, mark: str):
    yield on or mark == "R", {"I": "q", "T": "s"}.get(mark, mark) if on else mark, ()


def _target(state: tuple[int, bool, int], mark: str):
    """state: how many plain words the last address reaches, whether there was any, and in how many marks one has to come (0: need not)."""
    near, seen, due = state
    if mark == "Y":
        yield (SPAN, True, 0), mark, ()
        return
    if due == 1:
        return
    due = max(0, due - 1)
    later = (near, seen, due or SPAN + 1)
    if mark == "I":
        yield (near, seen, due), "A" if near else "I", ()
        if not near:
            yield later, "A", ()
    elif mark == "T":
        yield (near, seen, due), "X" if seen else "T", ()
        if not seen:
            yield later, "X", ()
    else:
        yield (max(0, near - 1) if mark == "o" else near, seen, due), mark, ()


def _insult(any_yet: bool, mark: str):
    found = {"I": ("insult",), "A": ("aimed",), "i": ("denied",), "q": ("quoted",)}.get(mark, ())
    yield any_yet or mark in "IA", mark, found + (("more",) if any_yet and mark in "IA" else ())


def _threat(state: None, mark: str):
    yield state, mark, {"X": ("threat",), "t": ("threat_denied",), "s": ("threat_quoted",)}.get(mark, ())


def grammar() -> Transducer:
    """Written marks: i, t denied; q, s quoted; A aimed insult, X aimed threat."""
    machine = Transducer(0, _negation)
    for part in (Transducer(False, _report), Transducer((0, False, 0), _target, lambda state: state[2] == 0), Transducer(False, _insult), Transducer(None, _threat)):
        machine = machine.then(part)
    return machine


_SYMBOL = "oITYNR"
_STRETCH = re.compile("o{%d,}" % (SPAN + 2))


class Scorer:
    """Finds the best paths of clauses under the arcs' weights; equal clauses are looked up, and so are the machine's arcs."""

    def __init__(self, weights: np.ndarray = PRIOR):
        self.machine, self.weight = grammar(), dict(zip(FEATURES, weights.tolist(), strict=False))
        self.arcs: dict = {}
        self.known: dict = {}

    def step(self, state, mark):
        found = self.arcs.get((state, mark))
        if found is None:
            found = self.arcs[state, mark] = [(to, sum(self.weight[f] for f in names), names) for to, _, names in self.machine.arcs(state, mark)]
        return found

    def best(self, marks: str) -> tuple[float, tuple]:
        """The best path's weight, and how often it passes each feature. Of equal paths the first one counts."""
        paths = {self.machine.start: (0.0, (None, ()))}
        for mark in marks:
            after: dict = {}
            for state, (weight, trail) in paths.items():
                for to, gain, names in self.step(state, mark):
                    if to not in after or weight + gain > after[to][0]:
                        after[to] = weight + gain, (trail, names) if names else trail
            paths = after
        weight, trail = max((p for state, p in paths.items() if self.machine.final(state)), key=lambda p: p[0])
        n = dict.fromkeys(FEATURES, 0)
        while trail is not None:
            trail, names = trail
            for f in names:
                n[f] += 1
        return weight, tuple(n.values())

    def clause(self, marks: str) -> tuple[float, tuple]:
        """The same of marks as they count: no pattern looks further than SPAN + 1 plain words in a row, nor further behind its last insult or threat."""
        tail = max(marks.rfind("I"), marks.rfind("T"))
        marks = _STRETCH.sub("o" * (SPAN + 1), marks[: tail + 2 + SPAN])
        found = self.known.get(marks)
        if found is None:
            found = self.best(marks)
            if len(self.known) < 100_000 and len(marks) < 1000:
                self.known[marks] = found
        return found


def _words(column: pa.Array):
    """(first row, lower-cased bytes, word starts and ends, word offsets) of each slice."""
    for first, flat, offs in wh.slices(column):
        flat = wh.LOWER[flat]
        yield first, flat, *wh.word_spans(flat, offs, _WORD)


_WORD = wh.ALNUM_WORDS.copy()
_WORD[39] = True
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[10, 33, 44, 46, 58, 59, 63]] = True


def _hash_of(text: str) -> int:
    flat = np.frombuffer(text.encode(), dtype=np.uint8)
    return int(wh.word_hashes(flat, np.array([0]), np.array([len(flat)]))[0])


class Lexicon:
    """The marks of word hashes, and those of stems by their length in bytes; words go before stems, longer stems before shorter ones."""

    def __init__(self, learned: list[str]):
        tables: dict[int, dict[int, int]] = defaultdict(dict)
        for words, mark in ((REPORT.split(), REP), (NEGATION.split(), NEG), (TARGET.split(), TGT), (THREAT.split(), THR), (INSULT.split(), INS), (learned, INS)):
            for w in words:
                stem = w.rstrip("*")
                tables[len(stem.encode()) if w.endswith("*") else 0].setdefault(_hash_of(stem), mark)
        self.tables = [(n, np.array(sorted(t), dtype=np.uint64), np.array([t[k] for k in sorted(t)], dtype=np.int8)) for n, t in sorted(tables.items(), reverse=True)]

    def of(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.full(len(starts), PLAIN, dtype=np.int8)
        for n, keys, marks in self.tables:  # the whole words, of length 0 here, come last and stand
            rows = np.flatnonzero((ends - starts >= n) & ((out == PLAIN) | (n == 0)))
            if not len(rows):
                continue
            names = wh.word_hashes(flat, starts[rows], starts[rows] + n if n else ends[rows])
            at = np.minimum(np.searchsorted(keys, names), len(keys) - 1)
            hit = keys[at] == names
            out[rows[hit]] = marks[at[hit]]
        return out


def count_patterns(column: pa.Array, lexicon: Lexicon, scorer: Scorer) -> tuple[np.ndarray, np.ndarray]:
    """(texts, FEATURES) numbers of matched patterns, and the weight of each text's heaviest clause."""
    out, top = np.zeros((len(column), len(FEATURES))), np.zeros(len(column))
    for first, flat, starts, ends, woffs in _words(column):
        marks = lexicon.of(flat, starts, ends)
        hot = np.flatnonzero((marks == INS) | (marks == THR))
        if not len(hot):
            continue
        breaks = np.cumsum(_BREAK[flat])
        clause = breaks[starts]
        for d in np.unique(np.searchsorted(woffs, hot, "right") - 1):
            own = marks[woffs[d] : woffs[d + 1]]
            parts = clause[woffs[d] : woffs[d + 1]]
            for c in np.unique(parts[(own == INS) | (own == THR)]):
                a, b = np.searchsorted(parts, [c, c + 1])
                weight, found = scorer.clause("".join(_SYMBOL[m] for m in own[a:b]))
                out[first + d] += found
                top[first + d] = max(top[first + d], weight)
    return out, top


def _shape(counts: np.ndarray) -> np.ndarray:
    """The counts, damped, and whether any insult or threat stands as it is."""
    return np.hstack([np.log1p(counts), (counts[:, _OPEN].sum(axis=1, keepdims=True) > 0).astype(float)])


def probability(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(_shape(counts) @ weights[:-1] + weights[-1])))


def fit_weights(counts: np.ndarray, y: np.ndarray, times: np.ndarray, pull: float = 1.0, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method over rows that count ``times`` each; the weights are pulled to PRIOR, the constant is free."""
    prior = np.append(PRIOR, -3.0)
    if not len(y):
        return prior
    x = np.hstack([_shape(counts), np.ones((len(y), 1))])
    ridge = np.append(np.full(len(PRIOR), pull), 1e-3)
    w = prior.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w)))
        step = np.linalg.solve((x * (times * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (times * (p - y)) + ridge * (w - prior))
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def held_out(column: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(5)) == 0, F.lit(False))


def _keys(text: str) -> dict[str, int]:
    """The distinct words of a text and, starred, their stems, each with a hash of one of its contexts: the words on its two sides."""
    words = _PLAIN_WORD.findall(text.translate(_LOWER))
    out: dict[str, int] = {}
    for k, w in enumerate(words):
        if w not in out:
            context = zlib.crc32(f"{words[k - 1] if k else ''} {words[k + 1] if k + 1 < len(words) else ''}".encode())
            out[w] = context
            for n in STEMS:
                if n <= len(w):
                    out.setdefault(w[:n] + "*", context)
    return out


_PLAIN_WORD = re.compile(r"[^\x00-\x26\x28-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _key_rows(batches):
    for batch in batches:
        for text in batch.column(0).to_pylist():
            found = _keys(text)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(found.values(), pa.int64())], names=["key", "context"])


def learn_words(rows: DataFrame, bad: int, good: int) -> list[str]:
    """Words and stems that tell the toxic rows (toxic, text) of a sample from the others. The candidates are those of a share
    of the toxic texts, so there are at most 1 / LEAST_SHARE times as many as a text has words and stems."""
    toxic = rows.where("toxic = 1 and text is not null").select("text")
    keys = toxic.mapInArrow(_key_rows, "key string, context long").groupBy("key").agg(F.count("*").alias("a"), F.countDistinct("context").alias("contexts"))
    seen = {r["key"]: r["a"] for r in keys.where((F.col("a") >= LEAST_SHARE * bad) & (F.col("contexts") >= LEAST_CONTEXTS)).collect()}

    def elsewhere(batches):
        for batch in batches:
            n = dict.fromkeys(seen, 0)
            for text in batch.column(0).to_pylist():
                for key in seen.keys() & _keys(text).keys():
                    n[key] += 1
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.string()), pa.array(n.values(), pa.int64())], names=["key", "b"])

    clean = rows.where("toxic = 0 and text is not null").select("text").mapInArrow(elsewhere, "key string, b long").groupBy("key").agg(F.sum("b").alias("b"))
    rare = {r["key"]: r["b"] for r in clean.collect()}
    found = {k for k, a in seen.items() if (a + 0.5) / bad >= LEAST_LIFT * (rare.get(k, 0) + 0.5) / good}
    # of stems of like reach the longest stands, and what a shorter one covers goes
    stems = sorted((k for k in found if k.endswith("*")), key=len)
    stems = [k for k in stems if not any(x != k and x.startswith(k[:-1]) and seen[x] >= 0.9 * seen[k] for x in stems)]
    covered = lambda k: any(k != x and k.startswith(x[:-1]) for x in stems)
    return sorted(k for k in [*stems, *(k for k in found if not k.endswith("*"))] if not covered(k))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Lexicon, np.ndarray]:
    """The lexicon and the weights, from about ``sample`` labelled rows outside the held-out fifth."""
    marked = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)").where(~held_out("id"))
    share = min(1.0, sample / max(1, marked.count()))
    picked = marked.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.xxhash64("id"), "id", "toxic").limit(2 * sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("id")).select("toxic", "text")
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    weights = np.append(PRIOR, -3.0)
    if not bad or not good:
        return Lexicon([]), weights
    lexicon = Lexicon(learn_words(rows, bad, good))
    for _ in range(TURNS):
        shared = docs.sparkSession.sparkContext.broadcast((lexicon, weights))

        def counted(batches):
            scorer = Scorer(shared.value[1])  # noqa: B023
            for batch in batches:
                counts, _ = count_patterns(batch.column(1), shared.value[0], scorer)  # noqa: B023
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(counts), pa.list_(pa.float64()))], names=["toxic", "counts"])

        seen = rows.mapInArrow(counted, "toxic int, counts array<double>").groupBy("toxic", "counts").count().collect()
        weights = fit_weights(np.array([r["counts"] for r in seen]), np.array([r["toxic"] for r in seen], dtype=float), np.array([r["count"] for r in seen], dtype=float))
    return lexicon, weights


def score(docs: DataFrame, model: tuple[Lexicon, np.ndarray]) -> DataFrame:
    """doc_id, the numbers of matched patterns, the heaviest clause's weight, score and predicted, for each of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        lexicon, weights = shared.value
        scorer = Scorer(weights)
        for batch in batches:
            counts, top = count_patterns(batch.column(1), lexicon, scorer)
            p = probability(counts, weights)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[:, k].astype(np.int64)) for k in range(len(FEATURES))), pa.array(top), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", *FEATURES, "clause_weight", "score", "predicted"])

    return docs.mapInArrow(run, keyed(docs, ", ".join(f"{f} long" for f in FEATURES) + ", clause_weight double, score double, predicted int"))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted", "clause_weight", *FEATURES)
