"""Personal data: fixed patterns, and a semi-Markov conditional random field for what they miss.

The patterns give the base spans. The field looks at lines that hold a digit,
`@` or `=`; their tokens, of any length, are joined into segments of at most
SEGMENT tokens, and each segment is scored as a whole for each type: its
shape, digits, checksum, prefix, variety of characters and the words before it.
One dynamic program over a line chooses boundaries and types together. The
weights are learnt here, by the gradient of the log-likelihood, from lines
that a seeded generator writes: entities of each type among invented words,
dates, amounts and versions. Entities found where no base span lies, or that hold
such a span whole (digits of a key may pass as a card), are added; `secret`
(keys, tokens, passwords) is a type of the field alone.

Defined cases: null and empty texts have no spans; base patterns run in time
linear in the text, whatever it holds; positions are code points; base spans of
different kinds may overlap, an added one overlaps only what it holds.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import bound_batches, private

KINDS = ("email", "ip", "card", "phone", "secret")
SEGMENT, NEAR, CACHED = 6, 3, 128
EPOCHS, LINES, RATE = 4, 400, 0.3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a start inside a run of digits fails where the run's start does
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@=]")
_TOKEN = re.compile(r"\S+")
_EDGE = "\"'`()[]{}<>,;:!?."


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by kind and start."""
    out = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x := part.lstrip("0")) <= 3 and int(x or "0") <= 255 for part in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def _shape(s: str) -> str:
    out = re.sub(r"[0-9]+", "9", re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", s)))
    return out[:24]


@lru_cache(maxsize=20_000)
def _features(text: str, before: str) -> tuple[str, ...]:
    """Features of a whole segment (without the marks at its edges) and of the words before it."""
    digits = re.sub(r"[^0-9]", "", text)
    letters = sum(map(str.isalpha, text))
    value = text.rpartition("=")[2].strip(_EDGE) if "=" in text else text
    dense = re.sub(r"[^A-Za-z0-9]", "", value)
    kinds = (any(map(str.isdigit, dense)) + any(map(str.islower, dense)) + any(map(str.isupper, dense)))
    out = [
        "shape=" + _shape(text),
        f"digits={min(len(digits), 20)}",
        f"letters={min(letters, 12) // 3}",
        f"words={text.count(' ') + 1}",
        f"long={min(len(dense), 40) // 8}",
        f"long={min(len(dense), 40) // 8},kinds={kinds},only={dense == value}",
        f"variety={len(set(dense)) // 4}",
        f"first={_shape(text[:1])}",
    ]
    if "@" in text:
        out.append("at" if _DOMAIN.fullmatch(text.rpartition("@")[2]) else "at-odd")
    if (quads := text.split(".")) and len(quads) == 4 and all(q.isdigit() and len(q) < 4 and int(q) < 256 for q in quads):
        out.append("quad")
    if 13 <= len(digits) <= 19 and not letters:
        out.append(f"luhn={luhn(digits)}")
    if text.startswith("+"):
        out.append(f"plus,{9 <= len(digits) <= 15}")
    if re.fullmatch(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", text):
        out.append("ten")
    if re.fullmatch(r"[0-9a-f]{16,}|[0-9A-F]{16,}", value):
        out.append(f"hex,{any(map(str.isalpha, value))}")
    key = re.sub(r"[^a-z]", "", (text.rpartition("=")[0] or before).lower())
    for w in ("password", "passwd", "token", "secret", "apikey", "accesskey", "auth"):
        if key.endswith(w):
            out.append("key")
            break
    if re.match(r"(?:AKIA|ASIA|ghp_|sk-|xox[bp]-)", value):
        out.append("prefix")
    out.append("card-word" if re.search(r"(?i)card|visa", before) else "phone-word" if re.search(r"(?i)phone|tel|call", before) else "no-word")
    return tuple(out)


class Line:
    """Tokens of a line and its candidate segments; entities begin and end at a trigger's token."""

    def __init__(self, text: str):
        self.text = text
        self.tokens = [m.span() for m in _TOKEN.finditer(text)]
        trigger = [bool(_TRIGGER.search(text, a, b)) for a, b in self.tokens]
        self.by_end: dict[int, list[tuple[int, int, int, tuple[str, ...]]]] = {}
        for i, (a, _) in enumerate(self.tokens):
            if not trigger[i] or text[a:a + 1] == "=":
                continue
            before = text[self.tokens[max(0, i - 2)][0] : a]
            for j in range(i, min(i + SEGMENT, len(self.tokens))):
                b = self.tokens[j][1]
                if not trigger[j]:
                    continue
                raw = text[a:b]
                inner = raw.strip(_EDGE) if not raw.startswith("(") else raw.rstrip(_EDGE)
                if not inner:
                    continue
                start = a + raw.index(inner)
                features = _features if len(inner) <= CACHED else _features.__wrapped__  # long texts would fill the cache
                self.by_end.setdefault(j + 1, []).append((i, start, start + len(inner), features(inner, before[-32:])))


class SemiMarkov:
    """Weights of (type, feature) and of neighbouring entities."""

    def __init__(self, weights: dict[tuple[str, str], float] | None = None):
        self.w = weights or {}

    def score(self, kind: str, features: tuple[str, ...]) -> float:
        w = self.w
        return w.get((kind, "bias"), 0.0) + sum(w.get((kind, f), 0.0) for f in features)

    def best(self, line: Line) -> list[tuple[str, int, int]]:
        """The best joint choice of segments and types; tokens outside entities score 0."""
        n = len(line.tokens)
        value, back = [0.0] * (n + 1), [None] * (n + 1)
        for end in range(1, n + 1):
            value[end] = value[end - 1]
            for i, a, b, f in line.by_end.get(end, ()):
                for kind in KINDS:
                    v = value[i] + self.score(kind, f)
                    if v > value[end]:
                        value[end], back[end] = v, (i, kind, a, b)
        out, at = [], n
        while at > 0:
            if back[at] is None:
                at -= 1
            else:
                i, kind, a, b = back[at]
                out.append((kind, a, b))
                at = i
        return out[::-1]

    def _gradient(self, line: Line, gold: set[tuple[str, int, int]], rate: float) -> None:
        """One step up the log-likelihood, by forward and backward sums over segments."""
        n = len(line.tokens)
        scored = {end: [(i, a, b, f, [(k, self.score(k, f)) for k in KINDS]) for i, a, b, f in segs] for end, segs in line.by_end.items()}
        log = lambda xs: (m := max(xs)) + math.log(sum(math.exp(x - m) for x in xs))
        ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
        starts: dict[int, list] = {}
        for end in range(1, n + 1):
            ahead[end] = log([ahead[end - 1], *(ahead[i] + s for i, _, _, _, ks in scored.get(end, ()) for _, s in ks)])
            for i, _, _, _, ks in scored.get(end, ()):
                starts.setdefault(i, []).append((end, ks))
        for i in range(n - 1, -1, -1):
            behind[i] = log([behind[i + 1], *(behind[end] + s for end, ks in starts.get(i, ()) for _, s in ks)])
        for end, segs in scored.items():
            for i, a, b, f, ks in segs:
                for k, s in ks:
                    g = ((k, a, b) in gold) - math.exp(ahead[i] + s + behind[end] - ahead[n])
                    if abs(g) > 1e-3:
                        for x in ("bias", *f):
                            self.w[k, x] = self.w.get((k, x), 0.0) * (1 - 1e-4) + rate * g

    def fit(self, lines: list[tuple[str, set[tuple[str, int, int]]]]) -> SemiMarkov:
        parsed = [(Line(t), g) for t, g in lines]
        for epoch in range(EPOCHS):
            for line, gold in parsed:
                self._gradient(line, gold, RATE / (1 + epoch))
        return self


def training_lines(count: int = LINES, seed: int = 7) -> list[tuple[str, set[tuple[str, int, int]]]]:
    """Lines with entities among invented words and numbers that are none."""
    r = random.Random(seed)
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    low, hexa, digit = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "0123456789"
    word = lambda: pick(low, r.randint(2, 9))

    def card() -> str:
        body = r.choice("3456") + pick(digit, r.choice([12, 13, 14, 14, 14, 15]))
        body += next(c for c in digit if luhn(body + c))
        sep = r.choice(["", "", " ", "-"])
        return sep.join(body[i : i + 4] for i in range(0, len(body), 4))

    def phone() -> str:
        area, mid, last = pick("23456789", 3), pick(digit, 3), pick(digit, 4)
        return r.choice([f"+1 ({area}) {mid}-{last}", f"({area}) {mid}-{last}", f"{area}-{mid}-{last}", f"+{r.randint(20, 99)} {area} {mid} {last}", f"+1 {area}.{mid}.{last}"])

    def secret() -> str:
        value = pick(hexa, r.choice([16, 18, 20, 32, 40, 64]))
        mixed = pick(low + low.upper() + digit, r.randint(20, 40))
        aws = "AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16)
        key = r.choice(["password", "token", "secret", "api_key"])
        return r.choice([f"{key}={value}", f"\x00{key} = \"\x01{value}\"", f"\x00{key}: \x01{mixed}7", f"{key}={mixed}3", aws, aws])

    def email() -> str:
        return f"{word()}{r.choice(['', '.' + word()])}{r.choice(['', '.' + pick(digit, 2), pick(digit, 3)])}@{word()}{r.choice(['', pick(digit, 1)])}.{r.choice(['com', 'org', 'example.com', 'co.uk'])}"

    def plain() -> str:
        return r.choice([pick(digit, r.randint(1, 8)), f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{r.randint(1, 23)}:{r.randint(0, 59):02}", f"{r.randint(0, 9)}.{r.randint(0, 30)}.{r.randint(0, 9)}", f"{pick(digit, 3)},{pick(digit, 3)}", f"{word()}{pick(digit, 2)}", f"x={r.randint(0, 99)}", f"{pick('6789', 3)}.{r.randint(300, 999)}.{r.randint(0, 255)}.1", pick("123456789", 13), f"{word()}@{word()}", "§ " + pick(digit, 2)])

    ways = {"email": email, "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), "card": card, "phone": phone, "secret": secret}
    out = []
    for _ in range(count):
        text, gold = "", set()
        for _ in range(r.randint(1, 4)):
            text += " ".join(word() for _ in range(r.randint(0, 4))) + " "
            if r.random() < 0.4:
                text += plain() + " "
                continue
            kind = r.choice(KINDS)
            lead, mark, entity = ways[kind]().rpartition("\x01")
            text += lead.replace("\x00", "") if mark else ""
            inner = entity.rstrip('"')
            gold.add((kind, len(text), len(text) + len(inner)))
            text += entity + r.choice(["", "", ".", ","]) + " "
        out.append((text, gold))
    return out


_field: list[SemiMarkov] = []


def trained() -> SemiMarkov:
    """The field, learnt once per process; generator and training are deterministic."""
    if not _field:
        _field.append(SemiMarkov().fit(training_lines()))
    return _field[0]


def find_spans(text: str, field: SemiMarkov) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans by kind and start."""
    if not _TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    more, at = [], 0
    while m := _TRIGGER.search(text, at):  # line by line, skipping those without a trigger
        begin = text.rfind("\n", 0, m.start()) + 1
        end = text.find("\n", m.start())
        end = len(text) if end < 0 else end
        at = end
        for a, b in _islands(text, begin, end):
            for kind, s, e in field.best(Line(text[a:b])):
                over = [t for t in taken if t[0] < a + e and a + s < t[1]]
                if all(a + s <= x and y <= a + e and (x, y) != (a + s, a + e) for x, y in over):
                    more.append((kind, a + s, a + e))
    every = sorted(base + more, key=lambda x: (KINDS.index(x[0]), x[1]))
    return base, every


def _islands(text: str, begin: int, end: int) -> Iterator[tuple[int, int]]:
    """Parts of a line around its triggers, from whole tokens, with NEAR words before; no segment can join two of them."""
    start = stop = -1
    at = begin
    while (m := _TRIGGER.search(text, at, end)) is not None:
        b = _space(text, m.end(), end)
        first = text.rfind(" ", at, m.start()) + 1 or at
        if start >= 0 and len(text[stop:first].split(None, SEGMENT)) < SEGMENT - 1:
            stop = b
        else:
            if start >= 0:
                yield start, stop
            start, stop = first, b
            for _ in range(NEAR):
                start = text.rfind(" ", at, max(at, start - 1)) + 1 or at
        at = b
    if start >= 0:
        yield start, stop


def _space(text: str, at: int, end: int) -> int:
    found = text.find(" ", at, end)
    return end if found < 0 else found


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None, with_text: bool = True) -> DataFrame:
    """The kept columns of every row (default: all but the text), n_email, n_ip, n_card, n_phone, base_sha256, spans and, with with_text, the redacted text.

    Clashing names are replaced; a null text stays null.
    """
    bound_batches(docs.sparkSession)
    counts = ["n_email", "n_ip", "n_card", "n_phone"]
    added = [*counts, "base_sha256", "spans", *([text] if with_text else [])]
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in [x.lower() for x in (*added, text)]]
    p = private(docs, *added)
    names = [f"{p}{i}" for i in range(len(keep))]
    field = docs.sparkSession.sparkContext.broadcast(trained().w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = SemiMarkov(field.value)
        for batch in batches:
            found, texts = [], batch.column(0).to_pylist()
            for t in texts:
                found.append(find_spans(t, model) if t else ([], []))
            columns = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS[:4]]
            columns += [pa.array([hashlib.sha256(digest(base).encode()).hexdigest() for base, _ in found], pa.string()), pa.array([digest(every) for _, every in found], pa.string())]
            if with_text:
                columns.append(pa.array([t if t is None else redact(t, every) for t, (_, every) in zip(texts, found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], names=[*names, *counts, "base_sha256", "spans", *([f"{p}text"] if with_text else [])])

    fields = "".join(f"`{n}` {docs.schema[c].dataType.simpleString()}, " for n, c in zip(names, keep, strict=True))
    source = docs.select(F.col(text).cast("string").alias(f"{p}t"), *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)])
    out = source.mapInArrow(run, f"{fields}n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string{f', `{p}text` string' if with_text else ''}")
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], *counts, "base_sha256", "spans", *([F.col(f"{p}text").alias(text)] if with_text else []))
