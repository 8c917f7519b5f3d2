"""Operator 2: personal data by fixed patterns and a semi-Markov conditional random field.

The patterns find the base spans, which always stay. The field may add spans beside them. A candidate segment is a bounded run of tokens
with an address sign or at least seven digits that touches no base span. It is scored by features of the whole span (digit count, check sum,
separators, context words) and by the entity before it, if only separators lie between; base spans count as such entities.
Dynamic programming over all segmentations chooses boundaries and types jointly, every other token being outside at score zero.

Candidates lie only near address signs and where seven digits stand close together. Texts are decoded there; what lies between such regions
holds no candidate and resets the history, so this is the decoding of the whole text. The field is trained here, on windows that a fixed generator writes
and labels.
"""

from __future__ import annotations

import functools
import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# A match can only start at the start of a run of digits; saying so keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, leftmost and non-overlapping for each kind; positions in code points."""
    found: list[Span] = []
    if "@" in text:
        end = 0
        for m in _DOMAIN.finditer(text):
            start = at = m.start()
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                end = m.end()
                found.append(("email", start, end))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(part.lstrip("0")) <= 3 and int(part[-3:]) <= 255 for part in m[0].split(".")):
                found.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append(("phone", m.start(), m.end()))
    return ordered(found)


def ordered(spans: list[Span]) -> list[Span]:
    """By start, then kind as listed, then end."""
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# The field.

#: Longest segment in characters and in tokens, digits that a segment without an address sign needs and may have, and context before it.
MAX_CHARS, MAX_TOKENS, LEAST_DIGITS, MOST_DIGITS, CONTEXT = 64, 24, 7, 19, 24
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s+|.", re.S)
_SIGN = re.compile(r"@|[\[(]at[\])]", re.I)
_AT = re.compile(r"@|[\[(]at[\])]")
_DOT = re.compile(r"\.|[\[(]dot[\])]")
_WORDS = {"phone": ("tel", "phone", "call", "fax", "mobile"), "card": ("card", "visa", "credit", "iban"), "ip": ("ip", "host", "server"), "email": ("mail", "contact")}
_DATE = re.compile(r"(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)[0-9]{2}")

_PHONE_SHAPE = re.compile(r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3}[ .-][0-9]{3,4}|\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){3,5}")

FEATURES = (
    "bias", "at", "one_at", "domain", "letters", "no_letters", "digits<7", "digits7-9", "digits10-11", "digits12-13", "digits14-19", "digits>19", "luhn",
    "quad", "octets", "plus", "paren", "slash", "dots", "even_separators", "groups_of_four", "date", "cut_left", "cut_right", "edge_sign", "long", "late_paren", "split_paren", "end_paren", "ten_local", "phone_shape", "context_own", "context_other",
)


def span_features(text: str, start: int, end: int) -> np.ndarray:
    """Features of a whole candidate span, for each kind: (kinds x features)."""
    span, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + 1]
    digits = re.sub("[^0-9]", "", span)
    n, letters = len(digits), bool(re.search("[A-Za-z]", span))
    parts = [p.strip() for p in _AT.split(span)]
    labels = [p.strip() for p in _DOT.split(parts[-1])] if len(parts) == 2 else []
    quad = span.split(".")
    marks = re.findall("[^0-9A-Za-z]+", span.lstrip("+("))
    shape = {
        "bias": 1, "at": len(parts) > 1, "one_at": len(parts) == 2 and bool(parts[0]) and not re.search(r"\s", parts[0]),
        "domain": len(labels) > 1 and all(re.fullmatch("[A-Za-z0-9-]+", x) for x in labels) and labels[-1].isalpha(),
        "letters": letters, "no_letters": not letters, "digits<7": n < 7, "digits7-9": 7 <= n <= 9, "digits10-11": 10 <= n <= 11, "digits12-13": 12 <= n <= 13,
        "digits14-19": 14 <= n <= 19, "digits>19": n > 19, "luhn": 14 <= n <= 19 and luhn(digits), "quad": len(quad) == 4 and all(q.isdigit() for q in quad),
        "octets": len(quad) == 4 and all(q.isdigit() and len(q) <= 3 and int(q) <= 255 for q in quad), "plus": span.startswith("+"), "paren": span.count("(") == 1 == span.count(")"),
        "slash": "/" in span, "dots": "." in span, "even_separators": bool(marks) and len(set(marks)) == 1, "groups_of_four": bool(re.fullmatch(r"[0-9]{4}(?:[ ./-][0-9]{4}){3}", span)),
        "date": bool(_DATE.search(span)), "cut_left": bool(before[-1:].isalnum() or before[-1:] in ("+", "_")), "cut_right": after.isalnum(),
        "edge_sign": not (span[0].isalnum() or span[0] in "+(") or not (span[-1].isalnum() or span[-1] in ")]"), "long": end - start > 24,
        "late_paren": span.find("(") > 4, "split_paren": span.count("(") != span.count(")"), "end_paren": span.endswith(")"), "ten_local": n == 10 and bool(marks) and not letters,
        "phone_shape": bool(_PHONE_SHAPE.fullmatch(span)),
    }
    row, low = [float(shape[f]) for f in FEATURES[:-2]], before.lower()
    named = {k: any(w in low for w in words) for k, words in _WORDS.items()}
    return np.array([[*row, float(named[k]), float(any(named[o] for o in KINDS if o != k))] for k in KINDS])


class Lattice:
    """A region's tokens, its candidate segments and its fixed segments as (first, end[, kind]) token positions."""

    def __init__(self, text: str, base: list[Span] = ()):
        self.text, self.tokens = text, [m.span() for m in _TOKEN.finditer(text)]
        starts, covered = [a for a, _ in self.tokens], [False] * len(self.tokens)
        self.fixed: list[tuple[int, int, int]] = []
        for kind, a, b in base:  # base spans overlap only across kinds; one run of them is one fixed segment
            i, j = bisect_right(starts, a) - 1, bisect_left(starts, b)
            if self.fixed and i < self.fixed[-1][1]:
                i, j, kind = self.fixed[-1][0], max(j, self.fixed[-1][1]), KINDS[self.fixed.pop()[2]]
            self.fixed.append((i, j, KINDS.index(kind)))
            covered[i:j] = [True] * (j - i)
        #: Whether a token outside an entity keeps the history: separators do, words and numbers don't.
        self.keeps = [not any(c.isalnum() for c in text[a : min(b, a + 1)]) for a, b in self.tokens]
        self.segments: list[tuple[int, int]] = []
        for i, (a, b) in enumerate(self.tokens):
            if text[a].isspace() or covered[i]:
                continue
            digits, at = 0, 0
            for j in range(i, min(i + MAX_TOKENS, len(self.tokens))):
                c, d = self.tokens[j]
                if d - a > MAX_CHARS or covered[j]:
                    break
                piece = text[c:d]
                digits += (d - c) * piece.isdigit()
                at += piece == "@" or (piece.lower() == "at" and text[c - 1 : c] in ("[", "("))
                if at > 1 or (digits > MOST_DIGITS and not at):
                    break
                if not piece.isspace() and (at or digits >= LEAST_DIGITS):
                    self.segments.append((i, j + 1))

    def features(self) -> np.ndarray:
        """Features of each segment and kind."""
        x = [span_features(self.text, self.tokens[i][0], self.tokens[j - 1][1]) for i, j in self.segments]
        return np.array(x).reshape(len(self.segments), len(KINDS), len(FEATURES))

    @functools.cached_property
    def steps(self) -> list[list[tuple[int, int, int | None]]]:
        """For each position the moves that end there: (from, segment or -1 for a token outside or -2 for a fixed segment, fixed kind)."""
        ends: list[list[tuple[int, int, int | None]]] = [[] for _ in range(len(self.tokens) + 1)]
        inside = {t for i, j, _ in self.fixed for t in range(i, j)}
        for t in range(len(self.tokens)):
            if t not in inside:
                ends[t + 1].append((t, -1, None))
        for i, j, kind in self.fixed:
            ends[j].append((i, -2, kind))
        for s, (i, j) in enumerate(self.segments):
            ends[j].append((i, s, None))
        return ends


#: Histories: no entity, or the kind of the one before with only separators between.
_NONE = len(KINDS)


def _sum(values: np.ndarray) -> np.ndarray:
    """log of the sum of exponentials over the first axis, -inf where all are."""
    top = values.max(axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.isneginf(top), top, top + np.log(np.exp(values - np.where(np.isneginf(top), 0.0, top)).sum(axis=0)))


class Batch:
    """Several lattices side by side: the moves that end at each position, in all of them at once."""

    def __init__(self, lattices: list[Lattice]):
        sizes = [len(x.tokens) + 1 for x in lattices]
        self.first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        self.last, self.nodes, segment = self.first + np.array(sizes) - 1, sum(sizes), 0
        #: For each position: moves outside that keep the history, that reset it, fixed segments, candidates; rows (from, to, segment or kind, lattice).
        self.moves: list[list[np.ndarray]] = []
        rows: list[list[list[tuple[int, int, int, int]]]] = [[[], [], [], []] for _ in range(max(sizes, default=1) - 1)]
        for w, lattice in enumerate(lattices):
            base = int(self.first[w])
            for at in range(1, len(lattice.tokens) + 1):
                for i, s, kind in lattice.steps[at]:
                    which = 3 if s >= 0 else 2 if s == -2 else 0 if lattice.keeps[i] else 1
                    rows[at - 1][which].append((base + i, base + at, segment + s if s >= 0 else kind or 0, w))
            segment += len(lattice.segments)
        self.moves = [[np.array(part, dtype=np.int64).reshape(-1, 4).T for part in parts] for parts in rows]


def expected(batch: Batch, scores: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each lattice's log normaliser, each (segment, kind)'s marginal and the expected count of each (history, kind), by forward-backward."""
    forward, backward = np.full((batch.nodes, _NONE + 1), -np.inf), np.full((batch.nodes, _NONE + 1), -np.inf)
    forward[batch.first, _NONE] = 0.0
    backward[batch.last] = 0.0
    kinds = np.arange(_NONE)
    for keep, reset, fixed, own in batch.moves:
        forward[keep[1]] = np.logaddexp(forward[keep[1]], forward[keep[0]])
        forward[reset[1], _NONE] = np.logaddexp(forward[reset[1], _NONE], _sum(forward[reset[0]].T))
        forward[fixed[1], fixed[2]] = np.logaddexp(forward[fixed[1], fixed[2]], _sum(forward[fixed[0]].T))
        ahead = scores[own[2]] + _sum((forward[own[0]][:, :, None] + turn).swapaxes(0, 1))
        np.logaddexp.at(forward, (own[1][:, None], kinds), ahead)
    totals = _sum(forward[batch.last].T)
    marginal, moves = np.zeros_like(scores), np.zeros_like(turn)
    for keep, reset, fixed, own in reversed(batch.moves):
        ahead = turn[None] + (scores[own[2]] + backward[own[1], :_NONE])[:, None, :]
        p = np.exp(forward[own[0]][:, :, None] + ahead - totals[own[3]][:, None, None])
        marginal[own[2]] = p.sum(axis=1)
        moves += p.sum(axis=0)
        np.logaddexp.at(backward, own[0], _sum(ahead.transpose(2, 0, 1)))
        backward[keep[0]] = np.logaddexp(backward[keep[0]], backward[keep[1]])
        for part, to in ((reset, np.full(reset.shape[1], _NONE)), (fixed, fixed[2])):
            backward[part[0]] = np.logaddexp(backward[part[0]], backward[part[1], to][:, None])
    return totals, marginal, moves


def decoded(lattice: Lattice, scores: np.ndarray, turn: np.ndarray) -> list[tuple[int, int, int]]:
    """The best segmentation's added entities as (first, end, kind); equal sums keep the one with fewer."""
    n, ends = len(lattice.tokens), lattice.steps
    none, width = float("-inf"), _NONE + 1
    value, back = [[none] * width for _ in range(n + 1)], [[None] * width for _ in range(n + 1)]
    value[0][_NONE] = 0.0
    own, turns = scores.tolist(), turn.tolist()
    for at in range(1, n + 1):
        here, from_ = value[at], back[at]
        for i, s, kind in ends[at]:
            before = value[i]
            if s >= 0:
                for k in range(_NONE):
                    best = max(range(width), key=lambda h: before[h] + turns[h][k])
                    total = before[best] + turns[best][k] + own[s][k]
                    if total > here[k]:
                        here[k], from_[k] = total, (i, best, s)
            elif s == -1 and lattice.keeps[i]:
                for h in range(width):
                    if before[h] > here[h]:
                        here[h], from_[h] = before[h], (i, h, s)
            else:
                to, best = (_NONE if kind is None else kind), max(range(width), key=before.__getitem__)
                if before[best] > here[to]:
                    here[to], from_[to] = before[best], (i, best, s)
    found, at, h = [], n, max(range(width - 1, -1, -1), key=value[n].__getitem__)
    while at > 0:
        i, before, s = back[at][h]
        if s >= 0:
            found.append((i, at, h))
        at, h = i, before
    return found[::-1]


def training_windows(count: int = 360, seed: int = 7) -> list[tuple[str, list[Span]]]:
    """Windows with their entities, from a fixed generator: plain and disguised entities, and numbers that are none."""
    rng = np.random.default_rng(seed)
    pick = lambda options: options[int(rng.integers(len(options)))]
    number = lambda n: "".join(str(int(d)) for d in rng.integers(0, 10, n))
    word = lambda: "".join(pick("abcdefghilmnoprstu") for _ in range(int(rng.integers(3, 8))))

    def card() -> str:
        body = str(int(rng.integers(3, 7))) + number(14)
        return next(body + str(c) for c in range(10) if luhn(body + str(c)))

    def entity() -> tuple[str | None, str, str]:
        choice = int(rng.integers(12))
        if choice < 2:
            return "email", f"{word()}{pick(['.', '_', ''])}{word()}@{word()}.{pick(['com', 'org', 'net', 'example.com'])}", "mail"
        if choice == 2:
            return "email", f"{word()} {pick(['[at]', '(at)'])} {word()} {pick(['[dot]', '(dot)'])} {pick(['com', 'org', 'net'])}", "mail"
        if choice == 3:
            return "ip", ".".join(str(int(x)) for x in rng.integers(0, 256, 4)), "ip"
        if choice < 6:
            digits, mark = card(), pick(["", " ", "-", ".", "/"])
            return "card", mark.join(digits[i : i + 4] for i in range(0, 16, 4)), "card"
        if choice < 8:
            mark = pick([" ", "-", "."])
            body = f"({number(3)}) {number(3)}{mark}{number(4)}" if rng.random() < 0.5 else f"{number(3)}{mark}{number(3)}{mark}{number(4)}"
            return "phone", f"+{int(rng.integers(1, 99))}{mark}{body}", "phone"
        if choice == 8:
            return "phone", f"({number(3)}) {number(3)}-{number(4)}", "phone"
        other = [
            lambda: number(int(rng.integers(7, 13))), lambda: f"{int(rng.integers(1900, 2030))}-{int(rng.integers(1, 13)):02d}-{int(rng.integers(1, 29)):02d} {number(2)}",
            lambda: f"{number(4)} {number(4)} {number(4)} {number(3)}1", lambda: f"{number(3)},{number(3)}.{number(3)}", lambda: ".".join(number(3) for _ in range(5)),
            lambda: f"{word()}@{word()}", lambda: f"{int(rng.integers(1, 13))}/{int(rng.integers(1, 29))}/{int(rng.integers(1900, 2030))}", lambda: f"{number(3)} {number(3)} {number(4)}",
            lambda: number(16), lambda: f"{number(2)}.{number(3)}.{number(3)}", lambda: f"{number(4)}-{number(4)}",
        ]
        return None, pick(other)(), ""

    made = []
    for _ in range(count):
        text, spans = " ".join(word() for _ in range(int(rng.integers(1, 4)))) + " ", []
        for _ in range(int(rng.integers(1, 4))):
            kind, body, hint = entity()
            if hint and rng.random() < 0.3:
                text += hint + ": "
            if kind:
                spans.append((kind, len(text), len(text) + len(body)))
            text += body + (pick([" ", ". ", ", "]) + word() + " " if rng.random() < 0.7 else pick([" ", ", ", "; "]))
        made.append((text + word(), spans))
    return made


@functools.lru_cache(maxsize=2)
def trained(count: int = 600, epochs: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Weights (kinds x features) and history weights (history x kind), by Adam on the conditional log-likelihood of the generated windows."""
    lattices, features, real, moves = [], [], [], np.zeros((_NONE + 1, len(KINDS)))
    for text, spans in training_windows(count):
        lattice = Lattice(text)
        at = {(lattice.tokens[i][0], lattice.tokens[j - 1][1]): s for s, (i, j) in enumerate(lattice.segments)}
        own, end, history = np.zeros((len(lattice.segments), len(KINDS))), 0, _NONE
        for kind, a, b in spans:
            if (a, b) in at:
                if _ALNUM.search(text, end, a):
                    history = _NONE
                own[at[a, b], KINDS.index(kind)] = 1.0
                moves[history, KINDS.index(kind)] += 1.0
                end, history = b, KINDS.index(kind)
        lattices.append(lattice)
        features.append(lattice.features())
        real.append(own)
    batch, x, y = Batch(lattices), np.concatenate(features), np.concatenate(real)
    w, turn = np.zeros((len(KINDS), len(FEATURES))), np.zeros_like(moves)
    first, second = (np.zeros(w.size + turn.size) for _ in range(2))
    for epoch in range(1, epochs + 1):
        _, p, seen = expected(batch, np.einsum("skf,kf->sk", x, w), turn)
        turns = moves - seen - 0.2 * turn
        turns[_NONE] = 0.0  # no entity before: weight zero
        slope = np.concatenate([(np.einsum("sk,skf->kf", y - p, x) - 0.02 * w).ravel(), turns.ravel()])
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        step = 0.3 * (first / (1 - 0.9**epoch)) / (np.sqrt(second / (1 - 0.99**epoch)) + 1e-8)
        w, turn = w + step[: w.size].reshape(w.shape), turn + step[w.size :].reshape(turn.shape)
    return w, turn


#: A decoded segment is taken if it outscores the same text left outside by this much.
MARGIN = 2.0


def regions(text: str) -> list[tuple[int, int]]:
    """Parts of the text, token by token whole, outside of which no candidate lies and between which a word or number resets the history."""
    near = [(m.start() - MAX_CHARS, m.end() + MAX_CHARS) for m in _SIGN.finditer(text)]
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    at = np.flatnonzero((codes >= 48) & (codes <= 57))
    if len(at) >= LEAST_DIGITS:
        first, last = at[: len(at) - LEAST_DIGITS + 1], at[LEAST_DIGITS - 1 :]
        close = last - first < MAX_CHARS
        near += zip((last[close] + 1 - MAX_CHARS).tolist(), (first[close] + MAX_CHARS).tolist(), strict=True)
    found: list[list[int]] = []
    for a, b in sorted(near):
        a, b = max(0, a), min(len(text), b)
        if found and (a <= found[-1][1] or not _ALNUM.search(text, found[-1][1], a)):
            found[-1][1] = max(found[-1][1], b)
        else:
            found.append([a, b])
    whole: list[tuple[int, int]] = []
    for a, b in found:
        # A token that reaches further than the longest segment is in none, so it may be cut beyond that.
        while a > 0 and _joined(text[a - 1], text[a]) and not _joined_run(text, a):
            a -= 1
        while b < len(text) and _joined(text[b - 1], text[b]) and not _joined_run(text, b):
            b += 1
        if whole and a <= whole[-1][1]:
            whole[-1] = (whole[-1][0], max(b, whole[-1][1]))
        else:
            whole.append((a, b))
    return whole


_ALNUM = re.compile(r"[^\W_]")
_RUN = re.compile(r"[A-Za-z]{65}|[0-9]{65}|\s{65}")


def _joined(left: str, right: str) -> bool:
    """Whether two neighbouring characters are of one token."""
    return _TOKEN.match(left + right).end() == 2


def _joined_run(text: str, at: int) -> bool:
    """Whether more characters than a segment may have are of one token on either side of a place."""
    return bool(_RUN.match(text, at) or (at > MAX_CHARS and _RUN.match(text, at - MAX_CHARS - 1)))


Field = tuple[np.ndarray, np.ndarray]


def added_spans(text: str, base: list[Span], field: Field) -> list[Span]:
    """Entities that the field finds beside the base spans."""
    found, (weights, turn) = [], field
    for a, b in regions(text):
        own = [(k, max(c, a) - a, min(d, b) - a) for k, c, d in base if c < b and d > a]
        lattice = Lattice(text[a:b], own)
        if lattice.segments:
            scores = np.einsum("skf,kf->sk", lattice.features(), weights) - MARGIN
            found += [(KINDS[k], a + lattice.tokens[i][0], a + lattice.tokens[j - 1][1]) for i, j, k in decoded(lattice, scores, turn)]
    return found


def _found(text: str | None, field: Field) -> tuple[list[Span], list[Span]]:
    text = text or ""
    base = base_spans(text)
    extra = added_spans(text, base, field) if _DIGIT.search(text) or _SIGN.search(text) else []
    return base, ordered([*base, *extra])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row of ``docs``.

    Counts and the digest are of base spans, ``spans`` lists all spans. Null texts count as empty: no spans, the digest of the empty string.
    Repeated rows get equal results. An empty table gives an empty one. Only the two named columns are read; nothing is shuffled.
    """
    spark = docs.sparkSession
    shared.ship(spark)
    sent = spark.sparkContext.broadcast(trained())
    picked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    schema = T.StructType(
        [
            T.StructField(id_col, picked.schema["id"].dataType),
            *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS),
            T.StructField("base_sha256", T.StringType()),
            T.StructField("spans", T.StringType()),
        ]
    )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        for batch in batches:
            counts, digests, spans = {k: [] for k in KINDS}, [], []
            for text in batch.column(1).to_pylist():
                base, every = _found(text, field)
                for k in KINDS:
                    counts[k].append(sum(s[0] == k for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=schema.names
            )

    return picked.mapInArrow(shared.lean(find), schema)


def redacted_text(text: str | None, spans: list[Span]) -> str | None:
    """The text with each run of overlapping spans replaced by the upper-case kind of its first span, in brackets."""
    if text is None or not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, start, end = spans[i]
        while i + 1 < len(spans) and spans[i + 1][1] < end:
            i += 1
            end = max(end, spans[i][2])
        out += [text[at:start], f"[{kind.upper()}]"]
        at, i = end, i + 1
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data in the text replaced, all columns and rows kept; ``length_col``, if present, is counted anew.

    Null texts stay null and keep their length, empty ones stay empty. Repeated rows get equal texts, an empty table gives an empty one.
    """
    spark = docs.sparkSession
    shared.ship(spark)
    sent = spark.sparkContext.broadcast(trained())
    place = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        for batch in batches:
            texts = [redacted_text(t, _found(t, field)[1]) for t in batch.column(place).to_pylist()]
            columns = list(batch.columns)
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    cleaned = docs.mapInArrow(shared.lean(clean), docs.schema)
    if length_col in docs.columns:
        changed = F.coalesce(F.length(text_col).cast(docs.schema[length_col].dataType), F.col(length_col))
        cleaned = cleaned.withColumn(length_col, changed)
    return cleaned
