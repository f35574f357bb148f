"""Personal data: fixed patterns, and a character-level bidirectional LSTM with a CRF on top.

`base_spans` finds e-mail addresses, IPv4 addresses, card and phone numbers by the fixed
patterns in time linear in the text. The tagger adds spans that the patterns miss (a phone
number without its plus sign, a card number with other separators, an address spelled with `at`
and `dot`). It is trained in numpy by backpropagation through the CRF's exact likelihood, on
labelled windows: texts of `SAMPLE_ROWS` documents with the spans that the patterns find in
them, and spans made from templates put into such texts, with look-alikes left unlabelled.
Training is deterministic and part of each call; nothing is kept between calls.

Tagging covers whole texts: every character is computed, in windows of `WINDOW` characters that
overlap by `WINDOW - STEP`. Each window is decoded with the CRF (a bound tells where no label
can beat none); spans cut by an inner edge are left to the neighbour that sees them whole; the
rest of a document are reconciled by weighted interval scheduling, so that the spans kept have
the greatest sum of scores. Base spans always stay; an added span overlaps none of them, has a
mean label probability of `CONFIDENCE` at least and isn't absurd for its kind (`plausible`).

Defined results: null and empty texts have no spans, and redaction leaves null as null. Rows are judged one by one, so repeated rows
and repeated or null keys are kept. Extra columns pass through. Empty tables stay empty.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualigraph.llm.common import slices, text_or_empty

KINDS = ("email", "ip", "card", "phone")
SAMPLE_ROWS = 200
WINDOW = 240
STEP = 192
HIDDEN = 12
EMBED = 12
#: Training windows, their length, and how often each is seen.
WINDOWS = 2400
LENGTH = 96
EPOCHS = 7
CONFIDENCE = 0.8
SEED = 7

Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        tail = _DOMAIN.match(text, at) if start < at else None
        # characters before a sign that failed can't start another match across it
        free = tail.end() if tail else at + 1
        if tail:
            found.append(("email", start, tail.end()))
        at = text.find("@", free)
    return found


def addresses(text: str) -> list[Span]:
    found = []
    for run in _DOTTED.finditer(text):
        parts = [m.span() for m in _NUMBER.finditer(text, *run.span())]
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            if all(len(p := text[a:b].lstrip("0")) <= 3 and int(p or 0) <= 255 for a, b in four):
                found.append(("ip", four[0][0], four[3][1]))
    return found


def base_spans(text: str) -> list[Span]:
    """All spans of the fixed patterns, by start and then kind."""
    found = emails(text) + addresses(text)
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


# ---- tagger

LABELS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
CHARS = 130


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, points, 128).astype(np.uint8)


def labels_of(length: int, spans: Iterable[Span]) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for kind, a, b in spans:
        k = 1 + 2 * KINDS.index(kind)
        out[a:b] = k + 1
        out[a] = k
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Tagger:
    """Parameters and both passes; arrays are (time, window, unit)."""

    def __init__(self, seed: int = SEED, hidden: int = HIDDEN, embed: int = EMBED):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"embed": draw(CHARS, embed)}
        for d in "fb":
            self.p |= {f"x{d}": draw(embed, 4 * hidden), f"h{d}": draw(hidden, 4 * hidden), f"b{d}": np.zeros(4 * hidden, np.float32)}
            self.p[f"b{d}"][hidden : 2 * hidden] = 1
        self.p |= {"out": draw(2 * hidden, LABELS), "bias": np.zeros(LABELS, np.float32), "step": np.zeros((LABELS, LABELS), np.float32)}
        self.hidden = hidden

    def _run(self, x: np.ndarray, keep: bool):
        """States (time, direction, window, unit) of both directions at once; the second reads from the end."""
        n = self.hidden
        tables = np.stack([self.p["embed"] @ self.p[f"x{d}"] + self.p[f"b{d}"] for d in "fb"])
        inner, way = np.stack([self.p["hf"], self.p["hb"]]), np.arange(2)[:, None]
        h = np.zeros((2, x.shape[1], n), tables.dtype)
        c = np.zeros_like(h)
        hs, tape = np.empty((len(x), *h.shape), tables.dtype), []
        for t in range(len(x)):
            z = tables[way, np.stack([x[t], x[-1 - t]])] + h @ inner
            gate = _sigmoid(z[..., : 3 * n])
            i, f, o, g = gate[..., :n], gate[..., n : 2 * n], gate[..., 2 * n :], np.tanh(z[..., 3 * n :])
            before, last = c, h
            c = f * c + i * g
            squashed = np.tanh(c)
            h = o * squashed
            hs[t] = h
            if keep:
                tape.append((i, f, o, g, before, squashed, last))
        return hs, tape

    def scores(self, x: np.ndarray, keep: bool = False):
        hs, tape = self._run(x, keep)
        both = np.concatenate([hs[:, 0], hs[::-1, 1]], 2)
        return both @ self.p["out"] + self.p["bias"], both, tape

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """`scores` without a tape, in one tanh a step for all gates: a sigmoid is half of one plus a tanh of half its input.

        The halves of the output gates stand in the weights that read them.
        """
        n, b, out = self.hidden, x.shape[1], np.empty((*x.shape, LABELS), np.float32)
        halved = np.concatenate([np.full(3 * n, 0.5, np.float32), np.ones(n, np.float32)])
        z, product = np.empty((b, 4 * n), np.float32), np.empty((b, n), np.float32)
        seen, back = np.empty((b, 4 * n), np.float32), np.empty((b, LABELS), np.float32)
        for d, weights in (("f", self.p["out"][:n] / 2), ("b", self.p["out"][n:] / 2)):
            table = (self.p["embed"] @ self.p[f"x{d}"] + self.p[f"b{d}"]) * halved
            inner = np.ascontiguousarray(self.p[f"h{d}"] * halved / 2)
            h, c = np.zeros((b, n), np.float32), np.zeros((b, n), np.float32)
            for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
                np.matmul(h, inner, out=z)
                z += np.take(table, x[t], axis=0, out=seen, mode="clip")
                np.tanh(z, out=z)
                z[:, : 3 * n] += 1
                c *= z[:, n : 2 * n]
                c += np.multiply(z[:, :n], z[:, 3 * n :], out=product)
                c *= 0.5
                np.tanh(c, out=h)
                h *= z[:, 2 * n : 3 * n]
                if d == "f":
                    np.matmul(h, weights, out=out[t])
                else:
                    out[t] += np.matmul(h, weights, out=back)
        out += self.p["bias"]
        return out

    def may_have_labels(self, e: np.ndarray) -> np.ndarray:
        """False for windows whose best path surely has no label.

        A run of labels gains its emissions' lead over none and the steps into, along and out of
        it, against the steps without labels. With the dearest step of each sort, the run of the
        greatest gain is found in one pass; where that isn't positive, no set of runs pays.
        """
        step = self.p["step"]
        enter, along, leave = (float(x.max() - step[0, 0]) for x in (step[0, 1:], step[1:, 1:], step[1:, 0]))
        gain = e[..., 1]
        for k in range(2, LABELS):
            gain = np.maximum(gain, e[..., k])
        gain = gain - e[..., 0]
        now, best = gain[0], gain[0] + (leave if len(gain) > 1 else 0)
        for t in range(1, len(gain)):
            now = np.maximum(now + along, enter) + gain[t]
            best = np.maximum(best, now + (leave if t + 1 < len(gain) else 0))
        return best > -1e-3

    def marginals(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Label marginals, expected transitions and log partition, by scaled sums."""
        steps, top = np.exp(self.p["step"].astype(np.float64)), e.max(2, keepdims=True)
        w = np.exp((e - top).astype(np.float64))
        a, scale = np.empty_like(w), np.empty(w.shape[:2])
        for t in range(len(w)):
            now = w[t] * (a[t - 1] @ steps if t else 1)
            scale[t] = now.sum(1)
            a[t] = now / scale[t][:, None]
        b = np.ones_like(w)
        pairs = np.zeros_like(steps)
        for t in range(len(w) - 2, -1, -1):
            ahead = w[t + 1] * b[t + 1] / scale[t + 1][:, None]
            b[t] = ahead @ steps.T
            pairs += steps * (a[t].T @ ahead)
        return a * b, pairs, np.log(scale).sum(0) + top[..., 0].sum(0)

    def decode(self, e: np.ndarray) -> np.ndarray:
        best, back = e[0], np.empty(e.shape, np.int8)
        for t in range(1, len(e)):
            reach = best[:, :, None] + self.p["step"]
            back[t] = reach.argmax(1)
            best = reach.max(1) + e[t]
        path = np.empty(e.shape[:2], np.int64)
        path[-1] = best.argmax(1)
        for t in range(len(e) - 1, 0, -1):
            path[t - 1] = back[t][np.arange(e.shape[1]), path[t]]
        return path

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the windows and its gradient."""
        e, both, tape = self.scores(x, True)
        p, pairs, log_z = self.marginals(e)
        n = x.shape[1]
        gold = np.take_along_axis(e, y[..., None], 2)[..., 0].sum(0) + self.p["step"][y[:-1], y[1:]].sum(0)
        de = p.astype(np.float32)
        np.put_along_axis(de, y[..., None], np.take_along_axis(de, y[..., None], 2) - 1, 2)
        de /= n
        seen = np.zeros_like(pairs)
        np.add.at(seen, (y[:-1].ravel(), y[1:].ravel()), 1)
        flat = de.reshape(-1, LABELS)
        grads = {"out": both.reshape(len(flat), -1).T @ flat, "bias": flat.sum(0), "step": ((pairs - seen) / n).astype(np.float32)}
        dboth = de @ self.p["out"].T
        dh_out = np.stack([dboth[..., : self.hidden], dboth[::-1, :, self.hidden :]], 1)
        inner = np.stack([self.p["hf"], self.p["hb"]])
        dwh, dzs = np.zeros_like(inner), np.empty((*dh_out.shape[:3], 4 * self.hidden), de.dtype)
        dh, dc = np.zeros_like(dh_out[0]), np.zeros_like(dh_out[0])
        for t in range(len(tape) - 1, -1, -1):
            i, f, o, g, before, squashed, last = tape[t]
            dh = dh + dh_out[t]
            dc = dc + dh * o * (1 - squashed**2)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g**2)], 2)
            dwh += last.transpose(0, 2, 1) @ dz
            dzs[t] = dz
            dh, dc = dz @ inner.transpose(0, 2, 1), dc * f
        one_hot, embed = (x.reshape(1, -1) == np.arange(CHARS)[:, None]).astype(de.dtype), np.zeros_like(self.p["embed"])
        for k, (d, dz) in enumerate((("f", dzs[:, 0]), ("b", dzs[::-1, 1]))):
            dtable = one_hot @ dz.reshape(-1, 4 * self.hidden)
            grads |= {f"h{d}": dwh[k], f"b{d}": dtable.sum(0), f"x{d}": self.p["embed"].T @ dtable}
            embed += dtable @ self.p[f"x{d}"].T
        grads["embed"] = embed
        return float((log_z - gold).mean()), grads

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 32, rate: float = 0.012, seed: int = SEED) -> list[float]:
        rng, losses, n = np.random.default_rng(seed), [], 0
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            order, total = rng.permutation(x.shape[1]), 0.0
            now = rate * (1 - 0.9 * epoch / epochs)
            for a in range(0, len(order), batch):
                pick = order[a : a + batch]
                loss, grads = self.gradient(x[:, pick], y[:, pick])
                total, n = total + loss * len(pick), n + 1
                norm = math.sqrt(sum(float((g**2).sum()) for g in grads.values()))  # a plain number leaves the arrays as narrow as they are
                for k, g in grads.items():
                    g = g * min(1.0, 5 / (norm + 1e-9))
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - now * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.999**n)) + 1e-8)
            losses.append(total / len(order))
        return losses


def _digits(rng: np.random.Generator, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def made_span(rng: np.random.Generator) -> tuple[str, str]:
    """(kind, text) from templates; more forms than the fixed patterns have."""
    letters = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    kind = KINDS[rng.integers(len(KINDS))]
    if kind == "email":
        at, dot = [("@", "."), ("@", "."), (" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "."), ("[at]", "[dot]")][rng.integers(6)]
        user = f"{letters(rng.integers(2, 9))}{rng.choice(['.', '_', '', '-'])}{rng.choice([letters(4), _digits(rng, 2)])}"
        return kind, f"{user}{at}{letters(rng.integers(3, 8))}{rng.choice(['', str(rng.integers(10))])}{dot}{rng.choice(['com', 'example.com', 'org', 'net', 'co.uk', 'de'])}"
    if kind == "ip":
        return kind, str(rng.choice([".", ".", "[.]", " . "])).join(str(rng.integers(0, 256)) for _ in range(4))
    if kind == "card":
        body = str(rng.choice(["4", "51", "37", "6011"]))
        body += _digits(rng, 15 - len(body))
        body += next(str(d) for d in range(10) if luhn(body + str(d)))
        return kind, str(rng.choice(["", "", " ", "-", ".", "/", "  "])).join([body[i : i + 4] for i in range(0, 16, 4)])
    area, middle, last = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    country = rng.integers(1, 99)
    forms = [f"+1 ({area}) {middle}-{last}", f"+{country} {area} {middle} {last}", f"({area}) {middle}-{last}", f"{area}-{middle}-{last}", f"({area}) {middle} {last}", f"{area}.{middle}.{last}", f"00{country} {area} {middle} {last}"]
    return kind, str(rng.choice(forms))


def look_alike(rng: np.random.Generator) -> str:
    forms = [
        lambda: _digits(rng, rng.integers(1, 12)),
        lambda: f"{rng.integers(1900, 2100)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}",
        lambda: f"{rng.integers(24):02d}:{rng.integers(60):02d}:{rng.integers(60):02d}",
        lambda: f"{rng.integers(10)}.{rng.integers(100)}.{rng.integers(10)}",
        lambda: f"${rng.integers(1, 1000)},{_digits(rng, 3)}.{_digits(rng, 2)}",
        lambda: f"{rng.integers(1900, 2030)}-{rng.integers(1900, 2030)}",
        lambda: f"978-{rng.integers(10)}-{_digits(rng, 2)}-{_digits(rng, 6)}-{rng.integers(10)}",
        lambda: f"@{rng.choice(['home', 'user', 'the'])}",
        lambda: f"({rng.integers(1, 100)})",
        lambda: f"{_digits(rng, 3)}-{_digits(rng, 4)}",
        lambda: " ".join(_digits(rng, rng.integers(1, 5)) for _ in range(rng.integers(2, 6))),
        lambda: ", ".join(_digits(rng, rng.integers(2, 5)) for _ in range(rng.integers(2, 6))),
        lambda: f"look at {rng.choice(['the', 'a', 'this'])} {rng.choice(['dot', 'point'])} {rng.choice(['on', 'of', 'and'])}",
        lambda: "".join(rng.choice(list("0123456789abcdef"), rng.integers(8, 33))),
        lambda: f"{_digits(rng, 2)}.{_digits(rng, 4)}, {_digits(rng, 2)}.{_digits(rng, 4)}",
        lambda: f"{_digits(rng, 5)}-{_digits(rng, 4)}",
    ]
    return str(forms[rng.integers(len(forms))]())


_PLAIN = "the quick brown fox jumps over a lazy dog and runs from der und la que sur les wald on the hill . , was in"


def training_windows(texts: list[str], count: int = WINDOWS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(LENGTH, count) character codes and labels."""
    rng = np.random.default_rng(seed)
    texts = [t for t in texts if len(t) > 20] or [" ".join(rng.permutation(_PLAIN.split())) for _ in range(50)]
    spans = [base_spans(t) for t in texts]
    with_spans = [i for i, s in enumerate(spans) if s]
    xs, ys = [], []
    while len(xs) < count:
        if rng.random() < 0.25 and with_spans:  # as the patterns label it
            i = with_spans[rng.integers(len(with_spans))]
            span = spans[i][rng.integers(len(spans[i]))]
            at = max(0, span[1] - int(rng.integers(0, LENGTH - 20)))
            text, own = texts[i][at : at + LENGTH], [(k, a - at, b - at) for k, a, b in spans[i] if a >= at and b <= at + LENGTH]
        else:  # stretches of plain text with made spans and look-alikes between them
            text, own = "", []
            while len(text) < LENGTH:
                t = texts[rng.integers(len(texts))]
                at = int(rng.integers(0, max(1, len(t) - 60)))
                words = re.sub(r"[0-9@+]", "", t[at : at + 60]).split(" ")[1:]
                text += " ".join(words[: int(rng.integers(1, 12))]) + str(rng.choice([" ", " ", ": "]))
                if rng.random() < 0.55:
                    name, item = made_span(rng)
                    own.append((name, len(text), len(text) + len(item)))
                else:
                    item = look_alike(rng)
                text += item + str(rng.choice([" ", ". ", ", "]))
            text, own = text[:LENGTH], [s for s in own if s[2] <= LENGTH]
        x, y = np.full(LENGTH, 129, np.uint8), np.zeros(LENGTH, np.int64)
        x[: len(text)], y[: len(text)] = codes(text), labels_of(len(text), own)
        xs.append(x)
        ys.append(y)
    return np.stack(xs, 1), np.stack(ys, 1)


def train(texts: Iterable[str]) -> Tagger:
    tagger = Tagger()
    tagger.fit(*training_windows(list(texts)))
    return tagger


def plausible(kind: str, text: str) -> bool:
    """Whether a text can be of its kind at all: digits enough, numbers in range, a card's checksum."""
    digits = re.sub(r"\D", "", text, flags=re.ASCII)
    if kind == "email":
        return re.fullmatch(r"[^\s@]+(?:@|\W*\bat\b\W*|[(\[]at[)\]])[^\s@]+.*[A-Za-z0-9]", text) is not None
    if kind == "ip":
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in parts)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15 and not any(c.isalpha() for c in text)


def reconcile(candidates: list[tuple[float, Span]], fixed: list[Span]) -> list[Span]:
    """The compatible candidates with the greatest sum of scores that touch no fixed span."""
    best: dict[Span, float] = {}
    for score, span in candidates:
        best[span] = max(score, best.get(span, 0.0))
    starts = sorted((a, b) for _, a, b in fixed)
    reach, most = [], 0
    for _, b in starts:
        most = max(most, b)
        reach.append(most)

    def clear(span: Span) -> bool:
        i = bisect.bisect_left(starts, (span[2],))
        return not i or reach[i - 1] <= span[1]

    rows = sorted((s for s in best if clear(s)), key=lambda s: (s[2], s[1], s[0]))
    ends = [s[2] for s in rows]
    total, taken = [0.0], []
    for i, s in enumerate(rows):
        before = bisect.bisect_right(ends, s[1], 0, i)
        gain = total[before] + best[s]
        taken.append(before if gain > total[i] else -1)
        total.append(max(gain, total[i]))
    out, i = [], len(rows)
    while i:
        if taken[i - 1] >= 0:
            out.append(rows[i - 1])
            i = taken[i - 1]
        else:
            i -= 1
    return out[::-1]


def tag(tagger: Tagger, texts: list[str], batch: int = 1024) -> list[list[Span]]:
    """Base and added spans of each whole text, by start and then kind."""
    base = [base_spans(t) for t in texts]
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    data = np.concatenate([codes("".join(texts)), np.full(WINDOW, 129, np.uint8)])
    counts = np.where(lengths > 0, np.maximum(1, -(-(lengths - (WINDOW - STEP)) // STEP)), 0)
    owner = np.repeat(np.arange(len(texts)), counts)
    place = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * STEP  # in its text
    candidates: list[list[tuple[float, Span]]] = [[] for _ in texts]
    for at in range(0, len(owner), batch):
        who, first = owner[at : at + batch], place[at : at + batch]
        begin = ends[who] - lengths[who] + first
        index = begin + np.arange(WINDOW)[:, None]
        x = np.where(index < ends[who], data[np.minimum(index, len(data) - 1)], np.uint8(129))
        e = tagger.emissions(x)
        open_ = np.flatnonzero(tagger.may_have_labels(e))
        path = tagger.decode(e[:, open_]) if len(open_) else np.zeros((WINDOW, 0), np.int64)
        labelled = np.flatnonzero(path.any(0))
        if not len(labelled):
            continue
        sure = tagger.marginals(e[:, open_[labelled]])[0]
        for column, j in enumerate(labelled.tolist()):
            n, a = int(who[open_[j]]), int(first[open_[j]])
            y, text, t = path[:, j], texts[n], 0
            while t < WINDOW:
                if not y[t] % 2:
                    t += 1
                    continue
                end = t + 1
                while end < WINDOW and y[end] == y[t] + 1:
                    end += 1
                kind, span = KINDS[(y[t] - 1) // 2], (a + t, a + end)
                inner = (t > 0 or a == 0) and (end < WINDOW or span[1] >= len(text))
                score = float(np.take_along_axis(sure[t:end, column], y[t:end, None], 1).mean())
                if inner and span[1] <= len(text) and score >= CONFIDENCE and plausible(kind, text[slice(*span)]):
                    candidates[n].append((score * (end - t), (kind, *span)))
                t = end
    return [sorted(b + reconcile(c, b), key=lambda s: (s[1], KINDS.index(s[0]), s[2])) if c else b for b, c in zip(base, candidates, strict=True)]


def sample_texts(df: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> tuple[str, ...]:
    """The different texts to train on: those with the least hashes, `rows` at most, whole."""
    live = df.select(text_or_empty(text).alias("t")).where(F.col("t").rlike("[0-9@]")).withColumn("h", F.xxhash64("t"))
    # hashes first, so that no task sends more than `rows` numbers to the driver
    least = [r["h"] for r in live.select("h").distinct().orderBy("h").limit(rows).collect()]
    if not least:
        return ()
    found = live.where(F.col("h") <= least[-1]).groupBy("h").agg(F.min("t").alias("t"))
    return tuple(r["t"] for r in found.orderBy("h").collect())


def _add(df: DataFrame, text: str, name: str, kind: T.DataType, make) -> DataFrame:
    """`df` with a column made from each text and its spans; `name` may be the text column itself."""
    tagger, names = train(sample_texts(df, text)), df.columns
    at = names.index(text)

    def each(batches):
        for batch in slices(batches, at, 8 << 20):
            texts = batch.column(at).to_pylist()
            found = tag(tagger, [t or "" for t in texts])
            made = pa.array([make(t, s) for t, s in zip(texts, found, strict=True)], arrow)
            columns = [made if n == name else batch.column(i) for i, n in enumerate(names)]
            yield pa.record_batch(columns if name in names else [*columns, made], names if name in names else [*names, name])

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)
    shape = df.schema if name in names else T.StructType([*df.schema.fields, T.StructField(name, kind)])
    return df.mapInArrow(each, shape)


SPANS = T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("end", "integer").add("base", "boolean"))


def find(df: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """Add `out`: the spans of each text in code points, with a mark on those of the patterns."""
    if out in df.columns:
        raise ValueError(f"the input has a column {out}")

    def make(t, spans):
        base = set(base_spans(t or ""))
        return [{"kind": k, "start": a, "end": b, "base": (k, a, b) in base} for k, a, b in spans]

    return _add(df, text, out, SPANS, make)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or each run of overlapping spans, replaced by its first kind in brackets."""
    parts, done = [], 0
    for kind, a, b in spans:
        if a >= done:
            parts += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*parts, text[done:]])


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with the personal data in its texts replaced."""
    return _add(df, text, text, df.schema[text].dataType, lambda t, s: t if t is None or not s else redacted(t, s))
