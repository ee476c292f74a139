"""Operator 9 - personal data by a character-level bidirectional LSTM with CRF transitions.

Base spans come from fixed patterns (email, ip, card, phone). The network, trained in numpy on labelled
spans, adds what no pattern of these finds: addresses that are written out (``jo at home dot org``), numbers
of phones without a plus sign, cards and hosts with odd separators, spans that stray digits hide. Its labels are the
base spans of a bounded sample of texts (``SAMPLE``) and made-up lines (``MADE``) with spans of all these
forms and with digits that are none: dates, versions, amounts, hexadecimal tokens.

Every character near a hint is read - a digit, an ``@``, a written-out ``at`` in brackets or a ``dot``: no form
can do without one, so a window without them has no span. Windows of ``WINDOW`` characters overlap by half; the
scores of a character in its windows are averaged, the nearer to a window's middle the heavier. The scores are
computed in blocks, but one Viterbi pass decodes each connected stretch of windows, whatever its length, so a
span across windows comes out once. A decoded span is added if the CRF's own probability of exactly this span,
by the forward and backward sums over the stretch, is ``SURE`` or more, it holds what its kind must hold (``plausible``),
and it touches no base span.

Edge cases: a null or empty text has no spans. With no labelled span in the sample the made-up lines
alone train the network. Repeated rows get equal spans; extra columns are ignored. Positions are code
points, ends exclusive.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brontide.llm.shared import keyed

KINDS = ("email", "ip", "card", "phone")
WINDOW, UNITS = 64, 16
SAMPLE, MADE, SURE = 1500, 4000, 0.5
TAGS = 1 + 2 * len(KINDS)
STEPS, BATCH, RATE = 900, 64, 0.02
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# possessive, and never begun inside a run of digits: the same matches without trying each digit of a long run
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: What every span that ``plausible`` lets through has in it: a digit, an ``@``, or a written at with a written or plain dot in reach.
_HINT = re.compile(r"[0-9@]|\b(?i:at)\b(?=\W*\w[^@]{0,64}?\W*(?:\.|\b(?i:dot)\b)\W*\w)")
_DIGIT = re.compile("[0-9]")
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def valid(kind: str, found: str) -> bool:
    """Whether a match of the kind's pattern passes the kind's test."""
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in found.split(".")))
    digits = _DIGITS.sub("", found)
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 10 <= len(digits) <= 15


def plausible(kind: str, found: str) -> bool:
    """Whether a span that the network found holds what its kind must hold, however it is written."""
    if kind == "email":
        return _WRITTEN.fullmatch(found) is not None
    numbers = _DIGIT_RUNS.findall(found)
    digits = "".join(numbers)
    if kind == "ip":
        return len(numbers) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in numbers)
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


_DIGIT_RUNS = re.compile("[0-9]+")
#: Some letters, a written or plain at, and a written or plain dot no more than a window after it.
_WRITTEN = re.compile(r"[^\s@]+\W*(?:@|\b(?i:at)\b)\W*\w[^@]{0,64}?\W*(?:\.|\b(?i:dot)\b)\W*\w+", re.DOTALL)


def _emails(text: str):
    """Leftmost non-overlapping matches, found from each ``@`` backwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(kind, m.group())]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def codes_of(text: str) -> np.ndarray:
    """ASCII as it is, 1 for any other character."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(points < 128, points, 1).astype(np.uint8)


class Tagger:
    """Two LSTM layers, one for each direction, tag scores at each position and transitions between tags."""

    def __init__(self, units: int = UNITS, tags: int = TAGS, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.units, self.tags = units, tags
        self.E = [draw(4 * units, 128, scale=0.4) for _ in range(2)]
        self.U = [draw(4 * units, units, scale=units**-0.5) for _ in range(2)]
        self.V = draw(tags, 2 * units, scale=0.3)
        self.b = np.zeros((tags, 1), dtype=np.float32)
        self.A = np.zeros((tags, tags), dtype=np.float32)

    def params(self) -> list[np.ndarray]:
        return [*self.E, *self.U, self.V, self.b, self.A]

    def layer(self, codes: np.ndarray, way: int, keep: bool = False):
        """codes (T, B) -> states (T, H, B), and what backpropagation needs. Gates: input, forget, output, candidate."""
        steps, wide = codes.shape
        h, E, U = self.units, self.E[way], self.U[way]
        out = np.zeros((steps, h, wide), dtype=E.dtype)
        gates, cells = [None] * steps, [None] * steps
        state = cell = np.zeros((h, wide), dtype=E.dtype)
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            x = np.take(E, codes[t], axis=1)
            x += U @ state
            x[h : 2 * h] += 1
            x[: 3 * h] *= 0.5
            np.tanh(x, out=x)
            x[: 3 * h] *= 0.5
            x[: 3 * h] += 0.5
            cell = x[h : 2 * h] * cell + x[:h] * x[3 * h :]
            state = out[t]
            np.multiply(x[2 * h : 3 * h], np.tanh(cell), out=state)
            if keep:
                gates[t], cells[t] = x, cell
        return (out, gates, cells) if keep else out

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        """(T, K, B)"""
        h = self.units
        return np.matmul(self.V[:, :h], self.layer(codes, 0)) + np.matmul(self.V[:, h:], self.layer(codes, 1)) + self.b

    def gradients(self, codes: np.ndarray, gold: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean negative log likelihood of the tag sequences gold (T, B), and its gradients."""
        steps, wide = codes.shape
        h, kinds = self.units, self.tags
        kept = [self.layer(codes, way, keep=True) for way in (0, 1)]
        z = np.matmul(self.V[:, :h], kept[0][0]) + np.matmul(self.V[:, h:], kept[1][0]) + self.b
        z64, A = z.astype(np.float64), self.A.astype(np.float64)
        alpha, beta = np.empty_like(z64), np.zeros_like(z64)

        def log_sum(x, axis):
            top = x.max(axis=axis, keepdims=True)
            return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))

        alpha[0] = z64[0]
        for t in range(1, steps):
            alpha[t] = z64[t] + log_sum(alpha[t - 1][:, None, :] + A[:, :, None], 0)
        for t in range(steps - 2, -1, -1):
            beta[t] = log_sum(A[:, :, None] + (z64[t + 1] + beta[t + 1])[None, :, :], 1)
        norm = log_sum(alpha[-1], 0)
        cols = np.arange(wide)
        path = sum(z64[t, gold[t], cols] for t in range(steps)) + sum(A[gold[t - 1], gold[t]] for t in range(1, steps))
        dz = np.exp(alpha + beta - norm)
        for t in range(steps):
            dz[t, gold[t], cols] -= 1
        dA = np.zeros_like(A)
        for t in range(1, steps):
            dA += np.exp(alpha[t - 1][:, None, :] + A[:, :, None] + (z64[t] + beta[t])[None, :, :] - norm).sum(axis=2)
            np.add.at(dA, (gold[t - 1], gold[t]), -1)
        dz = (dz / wide).astype(z.dtype)
        grads = [np.zeros_like(p) for p in self.params()]
        grads[6][:] = dA / wide
        grads[5][:] = dz.sum(axis=(0, 2))[:, None]
        for way in (0, 1):
            U, (s, gates, cells) = self.U[way], kept[way]
            part = slice(way * h, way * h + h)
            grads[4][:, part] = np.tensordot(dz, s, axes=((0, 2), (0, 2)))
            carry, dcell = np.zeros((h, wide), dtype=z.dtype), np.zeros((h, wide), dtype=z.dtype)
            rows = np.empty((steps, 4 * h, wide), dtype=z.dtype)
            for t in range(steps - 1, -1, -1) if way == 0 else range(steps):
                p = t - 1 if way == 0 else t + 1
                inside = 0 <= p < steps
                x, c = gates[t], np.tanh(cells[t])
                i, f, o, g = x[:h], x[h : 2 * h], x[2 * h : 3 * h], x[3 * h :]
                d = self.V[:, part].T @ dz[t] + carry
                dc = dcell + d * o * (1 - c * c)
                before = cells[p] if inside else np.zeros_like(c)
                back = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), d * c * o * (1 - o), dc * i * (1 - g * g)])
                if inside:
                    grads[2 + way] += back @ s[p].T
                carry, dcell = U.T @ back, dc * f
                rows[t] = back
            flat = codes.ravel()
            for k in range(4 * h):
                grads[way][k] = np.bincount(flat, weights=rows[:, k].ravel(), minlength=128)
        return float((norm - path).mean()), grads

    def decode(self, z: np.ndarray) -> np.ndarray:
        """The best tags of stretches of one length, z (B, T, K) -> (B, T)."""
        wide, steps, _ = z.shape
        back = np.zeros((steps, wide, self.tags), dtype=np.int8)
        best = z[:, 0]
        for t in range(1, steps):
            ways = best[:, :, None] + self.A
            back[t] = ways.argmax(axis=1)
            best = ways.max(axis=1) + z[:, t]
        tags = np.empty((wide, steps), dtype=np.int64)
        tags[:, -1] = best.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = back[t, np.arange(wide), tags[:, t]]
        return tags

    def certainty(self, z: np.ndarray, spans: list[tuple[int, int, int]]) -> list[float]:
        """The probability of each span (kind, start, end) of one stretch, z (T, K): of all tag sequences that hold exactly it."""
        z, A = z.astype(np.float64), self.A.astype(np.float64)
        steps = len(z)
        fore, rear = np.empty_like(z), np.zeros_like(z)
        fore[0] = z[0]
        for t in range(1, steps):
            top = fore[t - 1].max()
            fore[t] = z[t] + top + np.log(np.exp(fore[t - 1] - top) @ np.exp(A))
        for t in range(steps - 2, -1, -1):
            x = z[t + 1] + rear[t + 1]
            top = x.max()
            rear[t] = top + np.log(np.exp(A) @ np.exp(x - top))
        top = fore[-1].max()
        norm = top + np.log(np.exp(fore[-1] - top).sum())
        out = []
        for kind, a, b in spans:
            first, rest = 1 + 2 * kind, 2 + 2 * kind
            path = fore[a, first]
            if b - a > 1:
                path += A[first, rest] + A[rest, rest] * (b - a - 2) + z[a + 1 : b, rest].sum()
            if b < steps:
                last = rest if b - a > 1 else first
                x = np.delete(A[last] + z[b] + rear[b], rest)
                path += x.max() + np.log(np.exp(x - x.max()).sum())
            out.append(float(np.exp(path - norm)))
        return out


def tag_row(size: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    """0 outside; 1 + 2 k at the start of a span of kind k, 2 + 2 k inside it. A later span in an earlier one is left out."""
    out = np.zeros(size, dtype=np.int64)
    for kind, a, b in spans:
        if not out[a:b].any():
            k = KINDS.index(kind)
            out[a:b] = 2 + 2 * k
            out[a] = 1 + 2 * k
    return out


def made_up(n: int, seed: int = 9) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Lines with a true span each, half of them in forms that the patterns don't know, among digits and words that mislead, and lines with none."""
    rng = np.random.default_rng(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    pick = lambda s, k: "".join(s[j] for j in rng.integers(0, len(s), k))
    one = lambda *s: s[int(rng.integers(len(s)))]
    digits = lambda k: pick("0123456789", k)
    small = ("at", "the", "of", "and", "dot", "on", "in", "is", "to", "for")
    word = lambda: one(*small) if rng.random() < 0.3 else pick(letters, int(rng.integers(2, 10)))
    words = lambda k: " ".join(word().capitalize() if rng.random() < 0.2 else word() for _ in range(k))

    def card(loose):
        d = digits(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = one(".", "/", "  ", "_", " - ") if loose else one("", " ", "-")
        return sep.join((d[:4], d[4:8], d[8:12], d[12:]))

    def email(loose):
        name, host, end = one(pick(letters, int(rng.integers(3, 9))), f"{pick(letters, 4)}.{pick(letters, 5)}", f"{pick(letters, 4)}{digits(2)}"), pick(letters, int(rng.integers(3, 9))), one("com", "org", "net", "de", "fr", "edu", "io")
        if not loose:
            return f"{name}@{host}.{end}"
        at, dot = one((" at ", " dot "), (" AT ", " DOT "), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", " dot "), (" @ ", " . "), ("(at)", "."), (" at ", " dot "))
        return f"{name.replace('.', dot) if rng.random() < 0.5 else name}{at}{host}{dot}{end}"

    def phone(loose):
        a, b, c = digits(3), digits(3), digits(4)
        if not loose:
            return one(f"+{digits(1)} ({a}) {b}-{c}", f"+{digits(2)} {a} {b}{c}", f"+{digits(2)}-{digits(2)}-{b}-{c}", f"+{digits(11)}")
        return one(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}) {b} {c}", f"{a} {b} {c}", f"00{digits(2)} {digits(2)} {b} {c}", f"0{digits(2)}/{b}{c}", f"0{digits(3)}-{b}{c}")

    def ip(loose):
        parts = [str(x) for x in rng.integers(0, 256, 4)]
        return one("[.]", "(.)", " . ", "[dot]", " dot ").join(parts) if loose else ".".join(parts)

    def noise():
        y, m, d = f"{rng.integers(1900, 2100)}", f"{rng.integers(1, 13):02d}", f"{rng.integers(1, 29):02d}"
        return one(
            f"{y}-{m}-{d}", f"{d}.{m}.{y}", f"{d}/{m}/{y}", f"{digits(2)}:{digits(2)}:{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(1)}", f"v{digits(1)}.{digits(2)}", f"{digits(2)},{digits(3)}.{digits(2)}", f"{digits(3)} {digits(3)}",
            f'token = "{pick("0123456789abcdef", 40)}"', pick("0123456789ABCDEF", 32), digits(int(rng.integers(1, 9))), digits(int(rng.integers(17, 30))), f"{digits(5)}-{digits(4)}", f"{digits(1)}-{digits(5)}-{digits(3)}-{digits(1)}",
            f"CC BY {digits(1)}.0", f"{digits(3)}-{digits(3)}", f"{word()} at {word()} {word()}", f"{word()} dot {word()}", f"{word()} @ {word()}", f"{digits(4)} {digits(4)}", f"{digits(1)}, {digits(1)}, {digits(1)}, {digits(1)}", f"{digits(3)}.{digits(3)}.{digits(3)}.{digits(3)}.{digits(3)}",
        )

    make = {"email": email, "ip": ip, "card": card, "phone": phone}
    out = []
    for _ in range(n):
        kind, text = one(*KINDS), words(int(rng.integers(0, 5)))
        if rng.random() < 0.35:
            text = " ".join((text, noise(), words(2), noise(), words(1)))
            out.append((text, []))
            continue
        lead = one("", " ", " ", " ", f" {noise()} ", "No. ", "(", "=", ": ", "\n")
        a = len(text) + len(lead)
        body = make[kind](rng.random() < 0.5)
        out.append((text + lead + body + one(" ", " ", ", ", ". ", f" {noise()} ", ") ", "\n") + words(2), [(kind, a, a + len(body))]))
    return out


def _windows(codes: np.ndarray, tags: np.ndarray, centre: int) -> tuple[np.ndarray, np.ndarray]:
    a = max(0, min(centre - WINDOW // 2, len(codes) - WINDOW))
    x, y = np.zeros(WINDOW, np.uint8), np.zeros(WINDOW, np.int64)
    x[: len(codes[a : a + WINDOW])], y[: len(tags[a : a + WINDOW])] = codes[a : a + WINDOW], tags[a : a + WINDOW]
    return x, y


def _picked(text: str, spans: list[tuple[str, int, int]], most: int = 4) -> list[tuple[np.ndarray, np.ndarray]]:
    """Up to ``most`` windows of a text and their tags, at its spans or, without any, at its hints."""
    codes, tags = codes_of(text), tag_row(len(text), spans)
    if not len(codes):
        return []
    rng = np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    hints = [(a + b) // 2 for _, a, b in spans] or [m.start() for m in _HINT.finditer(text)] or [0]
    return [_windows(codes, tags, int(centre + rng.integers(-20, 21))) for centre in rng.permutation(hints)[:most]]


def _labelled(batches):
    for batch in batches:
        found = [w for text in batch.column(0).to_pylist() for w in _picked(text, base_spans(text))]
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x, _ in found], pa.binary()), pa.array([y.astype(np.uint8).tobytes() for _, y in found], pa.binary())], names=["x", "y"])


def fit(docs: DataFrame, sample: int = SAMPLE) -> Tagger:
    """Trained on windows at hints in about ``sample`` texts that have some, and on made-up lines. The sample stays on the executors; four windows of each text come here."""
    hinted = docs.select("doc_id", "text").where(F.col("text").rlike("[0-9@]"))
    n = hinted.count()
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    rows = hinted.where(draw < int(min(1.0, sample / max(1, n)) * (1 << 30))).select("text").mapInArrow(_labelled, "x binary, y binary").orderBy("x", "y").limit(8 * sample).collect()
    return train([(np.frombuffer(r["x"], np.uint8), np.frombuffer(r["y"], np.uint8).astype(np.int64)) for r in rows])


def train(windows: list[tuple[np.ndarray, np.ndarray]], steps: int = STEPS, made: int = MADE) -> Tagger:
    """By Adam on windows (codes, tags), a quarter of the given ones beside made-up ones."""
    rng = np.random.default_rng(17)
    lines = [w for text, spans in made_up(made) for w in _picked(text, spans, 2)]
    share = len(windows) and BATCH // 4
    pools = [(np.array([x for x, _ in pool]), np.array([y for _, y in pool]), size) for pool, size in ((windows, share), (lines, BATCH - share)) if size]
    net = Tagger()
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.params()]
    for k in range(1, steps + 1):
        own = [(x[k], y[k]) for x, y, size in pools for k in (rng.integers(0, len(x), size),)]
        x, y = (np.ascontiguousarray(np.concatenate([part[j] for part in own]).T) for j in (0, 1))
        _, grads = net.gradients(x, y)
        rate = RATE * min(1, k / 10) * (1 - 0.9 * k / steps)
        for p, g, (m, v) in zip(net.params(), grads, moments, strict=True):
            g = np.clip(g, -5, 5)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)).astype(p.dtype)
    return net


_HALF = WINDOW // 2
_WEIGHT = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)[:, None]
#: Windows that are read at once.
BLOCK = 4096


def stretches(text: str) -> list[tuple[int, int]]:
    """(first, end) in half windows: connected runs of half-overlapping windows around every hint."""
    out: list[tuple[int, int]] = []
    last = -1
    for m in _HINT.finditer(text):
        cell = m.start() // _HALF
        if cell == last:
            continue
        last = cell
        a, b = max(0, cell - 1), cell + 2
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _averaged(z: np.ndarray) -> np.ndarray:
    """The weighted means over windows that overlap by half: z (windows, WINDOW, K) -> (windows + 1) half windows."""
    out, weight = np.zeros((len(z) + 1, _HALF, z.shape[2]), np.float32), np.zeros((len(z) + 1, _HALF, 1), np.float32)
    for part, cells in ((slice(0, _HALF), slice(0, len(z))), (slice(_HALF, WINDOW), slice(1, len(z) + 1))):
        out[cells] += z[:, part] * _WEIGHT[part]
        weight[cells] += _WEIGHT[part]
    return (out / weight).reshape(-1, z.shape[2])


def scored(net: Tagger, work: list, most: int = BLOCK):
    """The work, (text, codes, first, end in half windows), of each bundle of stretches of at most ``most`` windows, or of one longer stretch,
    with the tag scores of its positions. Beyond its text a stretch is outside of all spans."""
    first = 0
    while first < len(work):
        last, count = first, 0
        while last < len(work) and (last == first or count + work[last][3] - work[last][2] - 1 <= most):
            count += work[last][3] - work[last][2] - 1
            last += 1
        x = np.zeros((count, WINDOW), dtype=np.uint8)
        k = 0
        for _, codes, a, b in work[first:last]:
            part = np.zeros((b - a) * _HALF, dtype=np.uint8)
            own = codes[a * _HALF : b * _HALF]
            part[: len(own)] = own
            x[k : k + b - a - 1] = np.lib.stride_tricks.sliding_window_view(part, WINDOW)[::_HALF]
            k += b - a - 1
        z = np.concatenate([net.emissions(np.ascontiguousarray(x[k : k + most].T)).transpose(2, 0, 1) for k in range(0, count, most)])
        k, done = 0, []
        for item in work[first:last]:
            _, codes, a, b = item
            whole = _averaged(z[k : k + b - a - 1])
            size = len(codes) - a * _HALF
            whole[size:] = -1e4
            whole[size:, 0] = 0
            k += b - a - 1
            done.append((item, whole))
        yield done
        first = last


def tagged_spans(net: Tagger, texts: list[str], known: list[list] | None = None, most: int = BLOCK) -> list[list[tuple[str, int, int, float]]]:
    """The spans that the network finds in each text beside the known ones, with their probabilities."""
    out: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
    work = []
    for d, text in enumerate(texts):
        pieces = stretches(text)
        if pieces:
            codes = codes_of(text)
            work += [(d, codes, a, b) for a, b in pieces]
    for done in scored(net, work, most):
        by_length: dict[int, list] = {}
        for item, whole in done:
            by_length.setdefault(len(whole), []).append((item, whole))
        for group in by_length.values():
            tags = net.decode(np.stack([whole for _, whole in group]))
            for ((d, _, a, _), whole), row in zip(group, tags, strict=True):
                kinds = (row + 1) // 2
                found = []
                for e in np.flatnonzero((row % 2 == 1) | (np.diff(kinds, prepend=0) != 0) & (row > 0)).tolist():
                    kind = (int(row[e]) - 1) // 2
                    stop = e + 1
                    while stop < len(row) and row[stop] == 2 + 2 * kind:
                        stop += 1
                    if known is None or not any(a * _HALF + e < y and x < a * _HALF + stop for _, x, y in known[d]):
                        found.append((kind, e, stop))
                if found:
                    out[d] += [(KINDS[k], a * _HALF + e, a * _HALF + stop, p) for (k, e, stop), p in zip(found, net.certainty(whole, found), strict=True)]
    return [sorted(x, key=lambda s: s[1]) for x in out]


def all_spans(net: Tagger, texts: list[str | None], sure: float = SURE, most: int = BLOCK) -> list[tuple[list, list]]:
    """Base spans and all spans of each text."""
    texts = [t or "" for t in texts]
    base = [base_spans(t) for t in texts]
    out = []
    for text, own, more in zip(texts, base, tagged_spans(net, texts, base, most), strict=True):
        added = [(kind, a, b) for kind, a, b, p in more if p >= sure and plausible(kind, text[a:b])]
        out.append((own, sorted(own + added, key=lambda s: (s[1], KINDS.index(s[0])))))
    return out


def _join(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, net: Tagger) -> DataFrame:
    """doc_id, base and spans, both arrays of (kind, start, end), for each of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(net)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                found = all_spans(shared.value, part.column(1).to_pylist())
                as_rows = lambda k: pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in f[k]] for f in found], span)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([part.column(0), as_rows(0), as_rows(1)], names=["doc_id", "base", "spans"])

    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.mapInArrow(run, keyed(docs, f"base {kind}, spans {kind}"))


def op9_pii(spark, sf_dir: str) -> DataFrame:
    """Counts are of base spans, as base_sha256; n_added counts what the network adds to spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_pii(docs, fit(docs))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[number(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(text("base"), 256).alias("base_sha256"),
        text("spans").alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
    )
