"""Personal data: fixed patterns, and a semi-Markov conditional random field.

The patterns find e-mail addresses, IP addresses, payment cards and telephone
numbers exactly as `base_spans` states.  The field then looks at the islands of a
text, maximal runs of space-separated chunks that hold a digit or ``@``, and finds
spans that the patterns miss (a telephone number without ``+``, say).  Its
features describe whole candidate segments: shape, digit count, checksum, number
of parts, what stands around, which cue word comes before.  Dynamic programming over
segments of at most ``MAX_TOKENS`` tokens chooses boundaries and kinds together.  Spans
of the patterns are given segments of every path: what lies between two of them is
decoded with their kinds on both sides, and they stay as they are.

Outside the islands no candidate has a digit or ``@`` and every path is "other",
so leaving that text out changes nothing.  Islands are decoded whole.

The field is trained here, by likelihood, on sentences that `examples` writes from
a seed; the number of sentences is a parameter.

Defined cases: a null or empty text has no spans; positions are code points, end
exclusive; repeated rows get equal results; any number of zeros may stand before a part
of an address; long texts are read whole, in time linear in their length and with some
100 bytes a token of their longest island.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, map_texts

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 16
#: What a span must win over "other" in log-probability.
LEAD = 0.0

# The patterns as the contract gives them, anchored so that they take linear time.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d)
        if k % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _octet(digits: str) -> bool:
    """Whether a run of digits, with any number of zeros before, is at most 255."""
    bare = digits.lstrip("0")
    return len(bare) <= 3 and int(bare or "0") <= 255


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str):
    """As the leftmost matches of local-part, @, dotted name: a match starts at the
    run of local characters before an @, but not before the last match's end."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_SET:
            start -= 1
        # without a name behind it no match can hold this @
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = at + 1  # a local part never holds an @
        at = text.find("@", max(done, at + 1))


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind as in KINDS, then start."""
    text = text or ""
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    if "." in text:
        for m in _IP.finditer(text):
            if all(_octet(p) for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = _digits(m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# --- islands and candidate segments ---------------------------------------------------

_SEED = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|.", re.S)
_SPACE = " \t\n\r\x0b\x0c"
_STARTS = frozenset("+(")
_BEFORE = re.compile(r"([^\W\d_]+)\.?[^\w]{0,3}$")

# Words that announce a kind of datum, or a number that is none.
CUES = {
    "email": "mail email e-mail contact correo courriel",
    "ip": "ip host server address client peer gateway",
    "card": "card visa mastercard amex credit debit karte tarjeta carte",
    "phone": "phone tel telephone call fax mobile cell ring dial whatsapp sms text hotline telefon handy telefono teléfono tél téléphone móvil llame appelez",
    "other": "order invoice isbn issn id ref reference account number no nr version section page lot serial batch total pid ticket case code sku part item model patent doi year population",
}
_CUE_OF = {word: kind for kind, words in CUES.items() for word in words.split()}


def islands(text: str) -> list[tuple[int, int]]:
    """Maximal runs of chunks with a digit or ``@``, one space apart."""
    out: list[tuple[int, int]] = []
    at = 0
    while m := _SEED.search(text, at):
        start = m.start()
        low = out[-1][1] if out else 0
        while start > low and text[start - 1] not in _SPACE:
            start -= 1
        end = m.end()
        while end < len(text) and text[end] not in _SPACE:
            end += 1
        if out and start - out[-1][1] == 1 and text[start - 1] == " ":
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
        at = end
    return out


def _bucket(n: int) -> str:
    return str(n) if n < 20 else "many"


def _features(text: str, s: int, e: int) -> list[str]:
    """Of the whole span text[s:e] and of what stands on both sides."""
    span = text[s:e]
    digits = _digits(span)
    shape = re.sub(r"[0-9]+", lambda m: f"d{min(len(m[0]), 9)}", re.sub(r"[A-Za-z]+", "a", span))
    out = [f"shape={shape[:40]}", f"digits={_bucket(len(digits))}", f"parts={_bucket(len(re.findall('[0-9]+', span)))}", f"first={shape[:1]}"]
    if "@" in span:
        name, _, host = span.partition("@")
        out.append(f"at={bool(name)}{host.count('.') > 0}{'@' in host}{bool(re.fullmatch('[A-Za-z0-9.-]*[A-Za-z0-9]', host))}")
    elif any(c.isalpha() for c in span):
        out.append("letters")
    if span.count(".") == 3 and re.fullmatch(r"[0-9]+(\.[0-9]+){3}", span):
        out.append(f"octets={all(_octet(p) for p in span.split('.'))}")
    if 13 <= len(digits) <= 19 and re.fullmatch(r"[0-9 -]+", span):
        out.append(f"luhn={luhn(digits)}")
    seps = "".join(sorted({c for c in span if not c.isalnum()}))
    out.append(f"seps={seps[:8]}")
    out.append(f"{'+' if span[:1] == '+' else '-'}digits={_bucket(len(digits))}|{seps[:6]}")
    left, right = text[s - 1 : s], text[e : e + 1]
    kind = lambda c: "end" if not c or c in _SPACE else "d" if c.isdigit() else "a" if c.isalpha() else c
    out += [f"left={kind(left)}", f"right={kind(right)}"]
    m = _BEFORE.search(text, max(0, s - 24), s)
    cue = _CUE_OF.get(m[1].lower(), "word") if m else "none"
    form = f"{'+' if span[:1] == '+' else '(' if span[:1] == '(' else '0' if span[:1] == '0' else '-'}{seps[:4]}"
    out += [f"cue={cue}", f"cue={cue}|digits={_bucket(len(digits))}", f"cue={cue}|form={form}"]
    return out


def _candidates(text: str, tokens: list[tuple[int, int]], i: int):
    """The segments that may start at a token: (end border, features)."""
    s = tokens[i][0]
    if not (text[s].isalnum() or text[s] in _STARTS) or (text[s].isalnum() and s and text[s - 1].isalnum()):
        return
    count, at, inner = 0, False, False
    for j in range(i + 1, min(len(tokens), i + MAX_TOKENS) + 1):
        b, e = tokens[j - 1]
        piece = text[b:e]
        if piece in ("\n", "\t"):
            return
        at |= piece == "@"
        digits = piece.isdigit()
        if digits:
            count += len(piece)
        inner |= piece.isalpha()
        if count > 24 or (inner and not at and count):
            return
        # digits of at least seven places, or something with an @ inside
        if text[e - 1].isalnum() and ((at and text[s] != "@") or (count >= 7 and not inner) or (count >= 4 and digits and not inner and "." in text[s:e])):
            yield j, _features(text, s, e)


def _lattice(text: str, start: int, end: int) -> tuple[list[int], list[list[tuple[int, list[str]]]]]:
    """Token borders of an island, and per end border its candidates (start border, features)."""
    tokens = [m.span() for m in _TOKEN.finditer(text, start, end)]
    borders = [tokens[0][0], *[e for _, e in tokens]]
    by_end: list[list[tuple[int, list[str]]]] = [[] for _ in borders]
    for i in range(len(tokens)):
        for j, features in _candidates(text, tokens, i):
            by_end[j].append((i, features))
    return borders, by_end


class SemiMarkovField:
    """Weights of whole-segment features by kind, and of kind after kind (0 is "other")."""

    def __init__(self) -> None:
        self.weights: dict[str, np.ndarray] = {}
        self.follow = np.zeros((len(KINDS) + 1, len(KINDS) + 1))

    def _score(self, features: list[str]) -> np.ndarray:
        zero = np.zeros(len(KINDS))
        return sum((self.weights[f] for f in features if f in self.weights), zero)

    def decode(self, text: str, start: int, end: int, lead: float = 0.0, before: int = 0, after: int = 0) -> list[tuple[str, int, int]]:
        """The best segmentation's spans; ``lead`` is what a span must win over "other".

        ``before`` and ``after`` are the labels that stand on both sides (0 "other").
        Candidates are made start by start and dropped when they are scored, and what
        remains of a place is a row of small numbers, so memory is some 100 bytes a token.
        """
        tokens = [m.span() for m in _TOKEN.finditer(text, start, end)]
        n, k = len(tokens) + 1, len(KINDS) + 1
        best = np.full((n, k), -np.inf)
        best[0, before] = 0.0
        came = np.zeros((n, k), np.int32)
        label = np.zeros((n, k), np.int8)
        found = False
        for i in range(n - 1):
            here = best[i]
            x = here + self.follow[:, 0]
            p = int(x.argmax())
            if x[p] > best[i + 1, 0]:
                best[i + 1, 0], came[i + 1, 0], label[i + 1, 0] = x[p], i, p
            ahead = None
            for j, features in _candidates(text, tokens, i):
                if ahead is None:
                    x = here[:, None] + self.follow[:, 1:]
                    ahead = x.argmax(axis=0)
                    top = x[ahead, range(k - 1)] - lead
                    found = True
                y = top + self._score(features)
                better = np.flatnonzero(y > best[j, 1:])
                best[j, better + 1], came[j, better + 1], label[j, better + 1] = y[better], i, ahead[better]
        if not found:
            return []
        out, j, y = [], n - 1, int((best[n - 1] + self.follow[:, after]).argmax())
        while j > 0:
            i = int(came[j, y])
            if y:
                out.append((KINDS[y - 1], tokens[i][0], tokens[j - 1][1]))
            j, y = i, int(label[j, y])
        return out[::-1]

    def step(self, text: str, start: int, end: int, gold: list[tuple[str, int, int]], rate: float, decay: float) -> None:
        """One stochastic gradient step on the log-likelihood of an island."""
        borders, by_end = _lattice(text, start, end)
        n, k = len(borders), len(KINDS) + 1
        scored = [[(i, f, self._score(f)) for i, f in c] for c in by_end]
        ahead = np.full((n, k), -np.inf)
        ahead[0, 0] = 0.0
        lse = np.logaddexp.reduce
        for j in range(1, n):
            terms = [(lse(ahead[j - 1] + self.follow[:, 0]), 0)]
            ahead[j, 0] = terms[0][0]
            for i, _, s in scored[j]:
                ahead[j, 1:] = np.logaddexp(ahead[j, 1:], lse(ahead[i][:, None] + self.follow[:, 1:], axis=0) + s)
        behind = np.full((n, k), -np.inf)
        behind[n - 1] = 0.0
        whole = lse(ahead[n - 1])
        starts: list[list[tuple[int, list[str], np.ndarray]]] = [[] for _ in range(n)]
        for j in range(n):
            for i, f, s in scored[j]:
                starts[i].append((j, f, s))
        follow = np.zeros_like(self.follow)
        change: dict[str, np.ndarray] = {}
        for i in range(n - 2, -1, -1):
            x = self.follow[:, 0] + behind[i + 1, 0]
            follow[:, 0] -= np.exp(ahead[i] + x - whole)
            for j, f, s in starts[i]:
                y = self.follow[:, 1:] + (s + behind[j, 1:])
                p = np.exp(ahead[i][:, None] + y - whole)
                follow[:, 1:] -= p
                x = np.logaddexp(x, lse(y, axis=1))
                for name in f:
                    change[name] = change.get(name, 0) - p.sum(axis=0)
            behind[i] = x
        at = {b: i for i, b in enumerate(borders)}
        j = last = 0
        truth = {at[s]: (at[e], KINDS.index(kind)) for kind, s, e in gold if s in at and e in at}
        while j < n - 1:
            if j in truth and any(i == j for i, _ in by_end[truth[j][0]]):
                e, kind = truth[j]
                follow[last, kind + 1] += 1
                for name in next(f for i, f in by_end[e] if i == j):
                    change.setdefault(name, np.zeros(len(KINDS)))
                    change[name] = change[name] + np.eye(len(KINDS))[kind]
                j, last = e, kind + 1
            else:
                follow[last, 0] += 1
                j, last = j + 1, 0
        self.follow += rate * (follow - decay * self.follow)
        for name, g in change.items():
            self.weights[name] = (1 - rate * decay) * self.weights.get(name, 0.0) + rate * g


def examples(count: int, seed: int = 7) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Sentences with labelled spans, written from templates."""
    draw = random.Random(seed)
    num = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    word = lambda: "".join(draw.choice("aeioulnrstmdcpbvhg") for _ in range(draw.randint(2, 9)))

    def card() -> str:
        body = draw.choice("3456") + num(14)
        full = body + next(x for x in "0123456789" if luhn(body + x))
        sep = draw.choice(["", " ", "-"])
        return sep.join(full[i : i + 4] for i in range(0, 16, 4))

    def wrong_card() -> str:
        while luhn(d := num(16)):
            pass
        sep = draw.choice(["", "", " ", "-"])
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def groups(total: int) -> list[str]:
        out = []
        while total:
            n = total if total <= 4 else draw.choice([2, 3, 3, 4, 4])
            n = min(n, total)
            out.append(num(n))
            total -= n
        return out

    def phone() -> tuple[str, bool]:
        """A number, and whether its form alone tells."""
        kind = draw.random()
        if kind < 0.2:
            return draw.choice([f"+{draw.randint(1, 99)} ({num(3)}) {num(3)}-{num(4)}", f"+{draw.randint(1, 99)} {num(2)} {num(4)} {num(4)}", f"+{num(11)}"]), True
        if kind < 0.45:
            return draw.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"({num(3)}) {num(3)} {num(4)}", f"1-{num(3)}-{num(3)}-{num(4)}"]), True
        if kind < 0.65:
            return draw.choice([f"(0{num(draw.randint(2, 4))}) {' '.join(groups(draw.randint(6, 8)))}", f"0{num(draw.randint(2, 4))}/{num(draw.randint(6, 8))}", f"0{num(draw.randint(2, 4))}-{num(draw.randint(6, 8))}"]), True
        if kind < 0.75:
            return f"00{draw.choice(['', ' '])}{draw.randint(1, 99)} {' '.join(groups(draw.randint(8, 10)))}", True
        if kind < 0.9:
            return f"0{num(draw.randint(2, 4))} {' '.join(groups(draw.randint(6, 8)))}", False
        return draw.choice([num(10), f"0{num(draw.randint(9, 10))}", " ".join(groups(draw.randint(9, 10)))]), False

    ip = lambda: ".".join(str(draw.randint(0, 255)) for _ in range(4))
    email = lambda: f"{word()}{draw.choice(['', '.', '_'])}{draw.choice(['', num(2)])}x@{word()}.{draw.choice(['example.com', 'org', 'net', 'co'])}"
    other = [
        lambda: f"{draw.randint(1900, 2030)}-{draw.randint(10, 12)}-{draw.randint(10, 28)}",
        lambda: f"{draw.randint(1, 28)}/{draw.randint(1, 12)}/{draw.randint(1900, 2030)}",
        lambda: f"{draw.randint(10, 23)}:{draw.randint(10, 59)}:{draw.randint(10, 59)}",
        lambda: f"${draw.randint(1, 9999)}.{num(2)}",
        lambda: f"{draw.randint(0, 9)}.{draw.randint(0, 30)}.{draw.randint(0, 30)}",
        lambda: f"{draw.randint(256, 999)}.{draw.randint(256, 999)}.{draw.randint(0, 255)}.{draw.randint(0, 255)}",
        lambda: num(draw.randint(1, 12)),
        lambda: " ".join(num(draw.randint(1, 6)) for _ in range(draw.randint(2, 5))),
        lambda: f"{num(1)},{num(3)},{num(3)}",
        lambda: f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}",
        lambda: f"{num(4)}-{num(4)}",
        lambda: f"{num(5)}-{num(4)}",
        lambda: f"{draw.randint(1990, 2030)}-{draw.randint(1990, 2030)}",
        lambda: f"{word().upper()}{num(2)}-{num(4)}",
        lambda: f"@{word()}",
        lambda: f"{word()}@{word()}",
        lambda: f"{num(3)}.{num(7)}",
        lambda: f"{num(3)}-{num(2)}-{num(4)}",
        wrong_card,
        wrong_card,
        lambda: num(draw.randint(7, 12)),
        lambda: f"{num(draw.randint(4, 6))}/{num(draw.randint(3, 6))}",
        lambda: " ".join(groups(draw.randint(7, 14))),
        lambda: f"{num(3)},{num(3)},{num(3)},{num(3)}",
        lambda: f"{num(1)}.{num(2)}.{num(3)}.{num(4)}",
        lambda: f"97{draw.choice('89')}{num(10)}",
        lambda: f"{draw.randint(1900, 2030)}{draw.randint(10, 12)}{draw.randint(10, 28)}",
        lambda: f"({draw.randint(1900, 2030)}) {num(3)}-{num(3)}",
    ]
    cues = {kind: words.split() for kind, words in CUES.items()}
    make = {"email": email, "ip": ip, "card": card}
    out = []
    for _ in range(count):
        text, spans = word(), []
        for _ in range(draw.randint(1, 3)):
            text += " " + " ".join(word() for _ in range(draw.randint(0, 3)))
            text = text.rstrip() + " "
            colon = lambda kind: draw.choice(cues[kind]) + draw.choice([" ", ": ", ". "])  # noqa: E731, B023
            if draw.random() < 0.5:
                kind = draw.choice([*KINDS, "phone"])
                body, clear = (make[kind](), True) if kind != "phone" else phone()
                if not clear or draw.random() < 0.35:
                    text += colon(kind)
                spans.append((kind, len(text), len(text) + len(body)))
            else:
                body = draw.choice(other)()
                if draw.random() < 0.3:
                    text += colon("other")
            text += body + draw.choice(["", "", ".", ",", " " + word()])
        out.append((text, spans))
    return out


@functools.cache
def trained_field(sentences: int = 1500, rounds: int = 4) -> SemiMarkovField:
    field = SemiMarkovField()
    rows = examples(sentences)
    for r in range(rounds):
        for text, spans in rows:
            for start, end in islands(text):
                field.step(text, start, end, [s for s in spans if start <= s[1] and s[2] <= end], 0.25 / (1 + r), 0.002)
    return field


def field_spans(text: str, field: SemiMarkovField, base: list[tuple[str, int, int]], lead: float = LEAD) -> list[tuple[str, int, int]]:
    """What the field finds beside the spans of the patterns.

    Those are given: they are segments of every path, so what lies between two of them
    is decoded with their kinds as its neighbours.
    """
    taken: list[list] = []  # runs of pattern spans that overlap: start, end, first and last kind
    for kind, s, e in sorted(base, key=lambda x: (x[1], x[2])):
        if taken and s < taken[-1][1]:
            if e > taken[-1][1]:
                taken[-1][1], taken[-1][3] = e, kind
        else:
            taken.append([s, e, kind, kind])
    out, k = [], 0
    for start, end in islands(text):
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        at, before = start, 0
        while at < end:
            inside = k < len(taken) and taken[k][0] < end
            stop = taken[k][0] if inside else end
            if at < stop and ("@" in text[at:stop] or len(_digits(text[at:stop])) >= 4):
                out += field.decode(text, at, stop, lead, before, KINDS.index(taken[k][2]) + 1 if inside else 0)
            if not inside:
                break
            at, before = taken[k][1], KINDS.index(taken[k][3]) + 1
            k += 1
    return out


def all_spans(text: str | None, field: SemiMarkovField) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(spans of the patterns, all spans), each by kind and start."""
    base = base_spans(text)
    if not text or not _SEED.search(text):
        return base, base
    more = field_spans(text, field, base)
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted([*base, *more], key=lambda x: (order[x[0]], x[1], x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by ``[KIND]``."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s < at:
            at = max(at, e) if e > at else at
            continue
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``base`` and ``spans``, arrays of (kind, start, end)."""
    field = trained_field()

    def work():
        def step(columns):
            ids, texts = columns
            found = [all_spans(t, field) for t in texts]
            pack = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in spans]
            return {id_col: ids, "base": [pack(b) for b, _ in found], "spans": [pack(a) for _, a in found]}

        return step

    rows = df.select(F.col(id_col), F.col(text_col).cast("string"))
    kind = rows.schema[0].dataType.simpleString()
    span = "array<struct<kind:string,start:int,end:int>>"
    return map_rows(rows, work, f"`{id_col}` {kind}, base {span}, spans {span}")


def mask(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns; spans in the text give way to ``[EMAIL]`` and so on. Nulls stay."""
    field = trained_field()

    def work():
        return lambda texts: [t if t is None else masked(t, all_spans(t, field)[1]) for t in texts]

    return map_texts(df, text_col, work)


def sha256_of(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()

