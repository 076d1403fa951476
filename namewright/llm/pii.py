"""Personal data in texts: fixed patterns, and a semi-Markov conditional random field that adds spans.

The field segments the tokens around digits, @ and quotation marks: whole-span features (shape, digit counts, check
digits, separators, context word) score each candidate segment of at most MAX_TOKENS tokens for each type, and dynamic
programming over (position, type) picks boundaries and types jointly. It is trained here, by stochastic gradient of the
log-likelihood over generated sentences, with fixed seed; weights are a few hundred numbers. Tokens without digit, @ or
quotation mark can only be outside, so that windows between them score as the whole text would.

Defined results: a null text is empty and has no spans; every row gives one row, repeated ones too; texts are scanned
whole whatever their length.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ready

#: An address is LOCAL, @, DOMAIN; the local part is the run of its characters before the @.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(x: str) -> str:
    return "".join(c for c in x if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses in one pass, as no character of a local part is an @."""
    end, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in LOCAL:
            a -= 1
        if a < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield a, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by kind, then start: leftmost, non-overlapping per kind; failing matches are dropped."""
    out: list[Span] = []
    out += [("email", a, b) for a, b in emails(text)]
    if not _ANY_DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p := q.lstrip("0")) <= 3 and int(p or 0) <= 255 for q in m[0].split("."))]
    for m in CARD.finditer(text):
        d = _digits(m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


_ANY_DIGIT = re.compile("[0-9]")
_TOKEN = re.compile(r"[^\s]+")
_TRIGGER = re.compile(r'[0-9@"]')

#: The field's types; a segment of type "o" has one token.
TYPES = ("o", "email", "ip", "card", "phone", "secret")
MAX_TOKENS = 6
_EDGE = "\"'()[]{}<>,;:!?*#$%&|"


def trimmed(text: str, a: int, b: int, kind: str) -> tuple[int, int]:
    """The span without punctuation at its edges."""
    keep = "+(" if kind == "phone" else ""
    while a < b and text[a] in _EDGE and text[a] not in keep:
        a += 1
    while b > a and (text[b - 1] in _EDGE or text[b - 1] == "."):
        b -= 1
    return a, b


def features(tokens: list[str], i: int, j: int, kind: str) -> list[str]:
    """Of tokens[i:j] as one segment of a type."""
    s = " ".join(tokens[i:j]).strip(_EDGE.replace("(", "") + ".")
    d = _digits(s)
    letters = sum(c.isalpha() for c in s)
    hexes = sum(c in "0123456789abcdefABCDEF" for c in s)
    before = tokens[i - 1].strip(_EDGE + ".").lower() if i else "^"
    seps = "".join(sorted({c for c in s if not c.isalnum()}))[:6]
    out = [
        "bias", f"tokens={j - i}", f"digits={min(len(d), 20)}", f"letters={'none' if not letters else 'few' if letters < len(d) else 'many'}", f"seps={seps}", f"plus={s[:1] == '+'}",
        f"at={s.count('@')}", f"dots={min(s.count('.'), 4)}", f"hexlong={hexes == len(s) and len(s) >= 24}", f"long={s.isalnum() and len(s) >= 16}",
        f"before={before if before in {'token', 'key', 'secret', 'password', 'tel', 'phone', 'mail', 'email', 'ip', 'card', '=', 'version', 'call'} else '-'}",
    ]
    if 16 <= len(d) <= 19 and not letters:
        out.append(f"luhn={luhn(d)}")
    if s.count(".") == 3 and not letters:
        parts = s.split(".")
        out.append(f"octets={all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)}")
    if re.fullmatch(r"\(?[0-9]{3}\)?[ -][0-9]{3}-[0-9]{4}", s):
        out.append("national")
    if j - i > 1 and any(not _TRIGGER.search(t) for t in tokens[i:j]):
        out.append("plain inside")
    return [f"{kind}|{x}" for x in out]


def segments(tokens: list[str], lead: int = 0) -> Iterator[list[tuple[int, list[tuple[str, list[str]]]]]]:
    """For each end j: (i, [(type, features)]). The first lead tokens are outside; one row is held at a time."""
    hot = [k >= lead and bool(_TRIGGER.search(t)) for k, t in enumerate(tokens)]
    for j in range(1, len(tokens) + 1):
        row = [(j - 1, [("o", features(tokens, j - 1, j, "o"))])]
        for i in range(max(0, j - MAX_TOKENS), j):
            if hot[j - 1] and hot[i]:
                row.append((i, [(k, features(tokens, i, j, k)) for k in TYPES[1:]]))
        yield row


def _score(w: dict[str, float], f: list[str]) -> float:
    return sum(w.get(x, 0.0) for x in f)


def best(w: dict[str, float], tokens: list[str], lead: int = 0) -> list[tuple[int, int, str]]:
    """Bounded-entity dynamic programming: the segmentation of the highest score, its entities only."""
    top, back = [0.0], []
    for j, row in enumerate(segments(tokens, lead), 1):
        found = max(((top[i] + _score(w, f), i, k) for i, kinds in row for k, f in kinds), key=lambda x: (x[0], x[2] == "o", x[1]))
        top.append(found[0])
        back.append((found[1], j, found[2]))
    out, j = [], len(tokens)
    while j:
        i, _, k = back[j - 1]
        if k != "o":
            out.append((i, j, k))
        j = i
    return out[::-1]


def _gradient(w: dict[str, float], tokens: list[str], gold: set[tuple[int, int, str]]) -> dict[str, float]:
    """Of the log-likelihood, by the forward and backward sums over segmentations."""
    table, n = list(segments(tokens)), len(tokens)
    lse = lambda xs: (m := max(xs)) + math.log(sum(math.exp(x - m) for x in xs))
    scored = [[(i, k, f, _score(w, f)) for i, kinds in row for k, f in kinds] for row in table]
    ahead = [0.0]
    for row in scored:
        ahead.append(lse([ahead[i] + s for i, _, _, s in row]))
    behind = [-math.inf] * n + [0.0]
    for j in range(n, 0, -1):
        for i, _, _, s in scored[j - 1]:
            x = behind[j] + s
            behind[i] = x if behind[i] == -math.inf else lse([behind[i], x])
    grad: dict[str, float] = {}
    covered = {t for a, b, _ in gold for t in range(a, b)}
    for j, row in enumerate(scored, 1):
        for i, k, f, s in row:
            p = math.exp(ahead[i] + s + behind[j] - ahead[n])
            is_gold = (i, j, k) in gold or (k == "o" and i not in covered)
            if p > 1e-4 or is_gold:
                for x in f:
                    grad[x] = grad.get(x, 0.0) + is_gold - p
    return grad


def _sentence(r: random.Random) -> tuple[list[str], set[tuple[int, int, str]]]:
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvwz") for _ in range(r.randint(2, 9)))

    def card(ok: bool) -> str:
        x = r.choice("3456") + num(15)
        good = next(x[:-1] + c for c in "0123456789" if luhn(x[:-1] + c))
        x = good if ok else good[:-1] + str((int(good[-1]) + r.randint(1, 9)) % 10)
        return r.choice([x, " ".join(x[k : k + 4] for k in range(0, 16, 4)), "-".join(x[k : k + 4] for k in range(0, 16, 4))])

    tail = lambda x: x + r.choice(["", "", "", ".", ",", "***", "%%%", "!!"])
    tokens: list[str] = []
    gold: set[tuple[int, int, str]] = set()
    for _ in range(r.randint(1, 4)):
        tokens += [word() for _ in range(r.randint(0, 3))]
        kind, text = r.choice(
            [
                ("email", f"{word()}.{r.randint(1, 99)}@{word()}{r.randint(1, 9)}.{r.choice(['com', 'org', 'net'])}"), ("email", f"{word()}@{word()}.{r.choice(['com', 'org', 'net'])}"),
                ("ip", ".".join(str(r.randint(0, 255)) for _ in range(4))), ("o", ".".join(str(r.randint(256, 999)) for _ in range(4))),
                ("card", card(True)), ("o", card(False)), ("phone", f"+{r.randint(1, 99)} ({num(3)}) {num(3)}-{num(4)}"), ("phone", f"({num(3)}) {num(3)}-{num(4)}"), ("phone", f"+{num(11)}"),
                ("secret", '"' + "".join(r.choice("0123456789abcdef") for _ in range(r.choice([32, 40, 64]))) + '"'), ("o", num(r.randint(1, 15))), ("o", f"{r.randint(0, 20)}.{r.randint(0, 20)}"),
                ("o", f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}"), ("o", f"@{word()}"), ("o", f"{num(3)}-{num(2)}"), ("o", word() + num(2)), ("o", f"{num(2)} {num(3)} {num(2)}"),
                ("secret", '"' + "".join(r.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(r.randint(16, 40))) + '"'), ("o", f'"{word()}"'), ("o", f'"{word()} {word()}"'), ("o", f'"https://{word()}.org/{word()}/{word()}"'), ("o", f'"{word()}-{word()}-{word()}"'), ("o", f'{word()}="{word()}"'),
            ]
        )
        if kind == "secret" and r.random() < 0.7:
            tokens += [r.choice(["token", "key", "secret", "password"]), "="]
        if kind == "o" and r.random() < 0.3:
            tokens.append(r.choice(["version", "token", "call", "card"]))
        at = len(tokens)
        tokens += tail(text).split(" ")
        if kind != "o":
            gold.add((at, len(tokens), kind))
    return tokens, gold


def train(sentences: int = 700, seed: int = 7, rate: float = 0.3) -> dict[str, float]:
    """Weights by AdaGrad over generated sentences; takes a few seconds."""
    r = random.Random(seed)
    w: dict[str, float] = {}
    seen: dict[str, float] = {}
    for _ in range(sentences):
        tokens, gold = _sentence(r)
        for x, g in _gradient(w, tokens, gold).items():
            seen[x] = seen.get(x, 1e-2) + g * g
            w[x] = w.get(x, 0.0) + rate * g / math.sqrt(seen[x])
    return {k: round(v, 4) for k, v in w.items()}


def field_spans(w: dict[str, float], text: str) -> list[Span]:
    """Entities of the field in a whole text. Runs of tokens with a digit, @ or quotation mark are segmented; all others are outside."""
    spots = [m.start() for m in _TRIGGER.finditer(text)]
    if not spots:
        return []
    # a window: the tokens with a trigger, next to each other, and one token before them
    hot: list[tuple[int, int]] = []
    last = -1
    for s in spots:
        if s < last:
            continue
        a = s
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        b = s
        while b < len(text) and not text[b].isspace():
            b += 1
        hot.append((a, b))
        last = b
    out: list[Span] = []
    run: list[tuple[int, int]] = []

    def flush() -> None:
        a = run[0][0]
        before = text[max(0, a - 80) : a].split()
        lead = before[-1:]
        if lead == ["="] and len(before) > 1:
            lead = before[-2:-1]  # the name that a value is given to
        tokens = lead + [text[x:y] for x, y in run]
        for i, j, k in best(w, tokens, len(lead)):
            x, y = trimmed(text, run[i - len(lead)][0], run[j - 1 - len(lead)][1], k)
            if y > x:
                out.append((k, x, y))

    for a, b in hot:
        # a token without trigger ends a run; runs are scored whole, however long
        if run and text[run[-1][1] : a].strip():
            flush()
            run = []
        run.append((a, b))
    flush()
    return out


def all_spans(w: dict[str, float], text: str | None) -> tuple[list[Span], list[Span]]:
    """The fixed patterns' spans, and those with the field's that overlap none of them."""
    text = text or ""
    base = base_spans(text)
    order = {k: n for n, k in enumerate((*KINDS, "secret"))}
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    more = []
    for k, a, b in field_spans(w, text):
        at = int(np.searchsorted(starts, b))  # those that start before b
        if not any(y > a for _, y in taken[max(0, at - 8) : at]):
            more.append((k, a, b))
    return base, sorted(base + more, key=lambda s: (order[s[0]], s[1], s[2]))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _found(w: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [[] for _ in KINDS], [], []
            for text in batch.column("text").to_pylist():
                base, every = all_spans(w, text)
                for k, n in zip(KINDS, counts, strict=True):
                    n.append(sum(k == x for x, _, _ in base))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(every))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(n, pa.int64()) for n in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=NAMES)

    return run


NAMES = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the fixed patterns, their digest, and all spans, for docs (doc_id, text)."""
    ready(docs.sparkSession)
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return d.mapInArrow(_found(train()), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(w: dict[str, float], text: str | None) -> str | None:
    """text with each span replaced by <KIND>; overlapping spans are merged under the first one's kind."""
    if text is None:
        return None
    out, at = [], 0
    for k, a, b in sorted(all_spans(w, text)[1], key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame) -> DataFrame:
    """docs with the spans in text masked; other columns and rows stay."""
    ready(docs.sparkSession)
    w = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array([masked(w, t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
