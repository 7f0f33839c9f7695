"""Personal data by a semi-Markov conditional random field.

Base patterns give spans of four kinds; they always stay. Besides, a semi-Markov model reads the
surroundings of every place that could belong to an entity. Candidate segments of tokens are scored
whole, by features of the complete span (its shape, check digits, length, neighbours, cue words),
and dynamic programming over segments of bounded length, and whole key-like runs of any length,
chooses boundaries and kinds jointly. The
weights are trained here by conditional likelihood, on sentences that a seeded generator writes.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from heapq import merge
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, table

#: Kinds in their order; the base knows the first four.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
#: No entity has more tokens or characters, but for one that is a whole RUN.
MAX_TOKENS = 24
MAX_CHARS = 80
#: Candidate segments scored at once.
BLOCK = 4_096
#: Training: sentences written, passes, step size, strength of the prior.
SENTENCES = 400
PASSES = 6
STEP = 0.5
PRIOR = 1e-3
SEED = 5

AT = re.compile("@")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
# Nothing follows the repeated group, so it need never give back; possessive, it keeps no trail of a long match.
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


NOT_DIGITS = re.compile("[^0-9]+")


def digits_of(s: str) -> str:
    return NOT_DIGITS.sub("", s)


def at_most_255(digits: str) -> bool:
    """Whether the number is; it may have any count of leading zeros."""
    value = digits.lstrip("0")
    return len(value) <= 3 and int(value or "0") <= 255


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the e-mail pattern, in one step per @ sign."""
    found, last = [], 0
    for m in AT.finditer(text):
        a = at = m.start()
        while a > last and LOCAL.match(text, a - 1):
            a -= 1
        if a < at and (d := DOMAIN.match(text, at + 1)):
            found.append((a, d.end()))
            last = d.end()
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start, then kind in order."""
    found = []
    if "@" in text:
        found += [(a, b, "email") for a, b in emails(text)]
    if DIGIT.search(text):
        found += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(at_most_255(x) for x in m[0].split("."))]
        for m in CARD.finditer(text):
            d = digits_of(m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


# The model.

TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s|[^A-Za-z0-9\s]")
#: What an entity must hold; everything else is outside.
ANCHOR = re.compile(r"[0-9@]|[(\[]at[)\]]")
OPENS = re.compile(r"[A-Za-z0-9+(]")
CLOSES = re.compile(r"[A-Za-z0-9]")
EMAIL_FULL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_HIDDEN = re.compile(r"[A-Za-z0-9._%+-]+ ?[(\[]at[)\]] ?[A-Za-z0-9-]+(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]+)+")
IP_FULL = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")
NATIONAL = re.compile(r"\(?[0-9]{2,5}\)?[ ./-][0-9]{3,4}[ .-]?[0-9]{3,4}")
INTERNATIONAL = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Card numbers as they are printed: one separator throughout, groups of four, or of four, six and five.
CARD_FULL = re.compile(r"[0-9]{4}(?:([ .-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}(?:\1[0-9]{1,3})?|([ .-])[0-9]{6}\2[0-9]{5})|[0-9]{12,19}")
TOKENLIKE = re.compile(r"[A-Za-z0-9_-]{20,}")
#: The shapes of bounded entities; a key is a whole RUN.
SHAPES = (EMAIL_FULL, EMAIL_HIDDEN, IP_FULL, NATIONAL, INTERNATIONAL, CARD_FULL)
#: Digits beside a span, at once or behind a separator: it is a part of a row of numbers, or of one number.
DIGITS_BEFORE = re.compile(r"[0-9][ .,/-]?\Z")
DIGITS_AFTER = re.compile(r"[ .,/-]?[0-9]")
DOT_AFTER = re.compile(r" ?[(\[]dot[)\]]")
#: A whole run that is shaped like a key; it is a candidate at any length.
RUN = re.compile(r"[A-Za-z0-9][A-Za-z0-9_-]{18,}[A-Za-z0-9]")
DATE = re.compile(r"[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4}")
#: Words before a span that speak for a kind.
CUES = {
    "email": {"mail", "email", "write", "contact"},
    "ip": {"ip", "host", "server", "address", "from"},
    "card": {"card", "visa", "mastercard", "credit", "pay"},
    "phone": {"phone", "tel", "telephone", "call", "fax", "mobile", "cell"},
    "secret": {"token", "key", "secret", "password", "apikey"},
}
FEATURES = (
    "bias", "email", "email_hidden", "ip", "ip_range", "card", "card_luhn", "card_sixteen", "national", "international", "nine_to_fifteen", "date",
    "token", "token_mixed", "joined_left", "joined_right", "digits_left", "digits_right", "few_digits", "many_digits", "letters", "spaces", "long", "unbalanced",
    *(f"cue_{k}" for k in KINDS),
)


def span_features(text: str, a: int, b: int, cue: frozenset[str]) -> list[float]:
    """Features of the whole span text[a:b] in its surroundings."""
    s = text[a:b]
    d = digits_of(s)
    left, right = bool(DIGITS_BEFORE.search(text[max(0, a - 2) : a])), bool(DIGITS_AFTER.match(text, b))
    card = not left and not right and bool(CARD_FULL.fullmatch(s)) and 12 <= len(d) <= 19
    ip = bool(IP_FULL.fullmatch(s))
    token = bool(TOKENLIKE.fullmatch(s))
    before, after = text[a - 1 : a], text[b : b + 1]
    return [
        1.0,
        bool(EMAIL_FULL.fullmatch(s)),
        bool(EMAIL_HIDDEN.fullmatch(s)),
        ip,
        ip and all(int(x) <= 255 for x in s.split(".")),
        card,
        card and luhn(d),
        len(d) == 16 and card,
        bool(NATIONAL.fullmatch(s)),
        bool(INTERNATIONAL.fullmatch(s)),
        9 <= len(d) <= 15,
        bool(DATE.fullmatch(s)),
        token,
        token and bool(DIGIT.search(s)) and any(c.isalpha() for c in s),
        bool(before) and (before.isalnum() or before in "@+_%") or before in ".-" and a > 1 and text[a - 2].isalnum(),
        bool(after) and (after.isalnum() or after in "@_") or after in ".-" and text[b + 1 : b + 2].isalnum() or bool(DOT_AFTER.match(text, b)),
        left,
        right,
        len(d) < 7,
        len(d) > 15,
        sum(c.isalpha() for c in s) / len(s),
        s.count(" ") / 4,
        min(len(s) / MAX_CHARS, 1.0),
        s.count("(") != s.count(")") or s.count("[") != s.count("]"),
        *(float(k in cue) for k in KINDS),
    ]


@dataclass
class Lattice:
    """The candidate segments of one stretch of tokens: token bounds, features."""

    tokens: list[tuple[int, int]]
    first: list[int]
    last: list[int]
    features: np.ndarray


def reach(text: str, s: int, stop: int) -> int:
    """How far an entity that opens at s can reach by its shape, before ``stop``; s if none can open there."""
    return max((m.end() for shape in SHAPES if (m := shape.match(text, s, stop))), default=s)


def candidates(text: str, a: int, b: int) -> Iterator[tuple[int, int, list[float]]]:
    """Start, end and features, by start and then end, of all segments within text[a:b] that could be an entity.

    A segment has one of SHAPES, a bounded length, an anchor and letters or digits at both ends, on one line; or it is a whole RUN. All others are
    outside by definition. Only the tokens around the current one are held: six before it for cue words, MAX_TOKENS from it on.
    """
    tokens = ((m.start(), m.end()) for m in TOKEN.finditer(text, a, b))
    anchors = (m.start() for m in ANCHOR.finditer(text, a, b))
    runs = ((m.start(), m.end()) for m in RUN.finditer(text, a, b))
    anchor, run = next(anchors, None), next(runs, None)
    before: deque[tuple[int, int]] = deque(maxlen=6)
    ahead = deque(islice(tokens, MAX_TOKENS))
    while ahead:
        s, first_end = ahead[0]
        while anchor is not None and anchor < s:
            anchor = next(anchors, None)
        if anchor is None:
            return
        while run is not None and run[0] < s:
            run = next(runs, None)
        run_end = run[1] if run is not None and run[0] == s else s
        if OPENS.match(text, s) and (anchor - s <= MAX_CHARS or run_end > anchor):
            ends, far = [], reach(text, s, min(b, s + MAX_CHARS))
            for t, e in ahead:
                if e > far or text[t] == "\n":
                    break
                if e > anchor and e != run_end and CLOSES.match(text, e - 1) and any(shape.fullmatch(text, s, e) for shape in SHAPES):
                    ends.append(e)
            if run_end > anchor:
                ends.append(run_end)
            if ends:
                cue = frozenset(kind for t0, t1 in before if t1 - t0 <= MAX_CHARS and (word := text[t0:t1].lower()) for kind, words in CUES.items() if word in words)
                for e in sorted(ends):
                    yield s, e, span_features(text, s, e, cue)
        before.append(ahead.popleft())
        ahead.extend(islice(tokens, 1))


def lattice(text: str, a: int, b: int) -> Lattice:
    """All candidates within text[a:b] at once, as training needs them."""
    tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text, a, b)]
    opening, ending = {s: i for i, (s, _) in enumerate(tokens)}, {e: j for j, (_, e) in enumerate(tokens)}
    found = list(candidates(text, a, b))
    return Lattice(tokens, [opening[s] for s, _, _ in found], [ending[e] for _, e, _ in found], np.array([f for *_, f in found], float).reshape(-1, len(FEATURES)))


def decode(text: str, a: int, b: int, weights: np.ndarray) -> list[tuple[int, int, str]]:
    """The best segmentation of text[a:b]: a token outside scores 0, an entity what its features weigh.

    Candidates are scored in blocks. The program goes forward over their starts: it holds the best score of all that ends
    at or before the start, and those of ends still ahead, each with the chain of spans behind it. So the memory is that of a block,
    of the ends within an entity's reach and of the spans found, whatever the length of the text.
    """
    best: tuple[float, tuple | None] = (0.0, None)
    ahead: dict[int, tuple[float, tuple]] = {}

    def settle(start: int | None) -> None:
        nonlocal best
        for e in sorted(e for e in ahead if start is None or e <= start):
            if (reached := ahead.pop(e))[0] > best[0]:
                best = reached

    found = candidates(text, a, b)
    at = -1
    while block := list(islice(found, BLOCK)):
        scores = np.array([f for *_, f in block], float) @ weights
        kind, gain = scores.argmax(axis=1), scores.max(axis=1)
        for x in np.flatnonzero(gain > 0).tolist():
            s, e, _ = block[x]
            if s != at:
                at = s
                settle(s)
            value = best[0] + float(gain[x])
            if e not in ahead or value > ahead[e][0]:
                ahead[e] = (value, (best[1], s, e, KINDS[kind[x]]))
    settle(None)
    out, node = [], best[1]
    while node:
        node, s, e, k = node
        out.append((s, e, k))
    return out[::-1]


def gradient(lat: Lattice, gold: set[tuple[int, int, str]], weights: np.ndarray) -> np.ndarray:
    """Of the log-likelihood of the gold segmentation: its features less their expectation (forward-backward over segments)."""
    n, scores = len(lat.tokens), lat.features @ weights
    segs: dict[int, list[int]] = {}
    opens: dict[int, list[int]] = {}
    for x, (i, j) in enumerate(zip(lat.first, lat.last, strict=True)):
        segs.setdefault(j, []).append(x)
        opens.setdefault(i, []).append(x)
    mass = np.logaddexp.reduce(scores, axis=1)
    alpha, beta = np.zeros(n + 1), np.zeros(n + 1)
    for j in range(n):
        alpha[j + 1] = np.logaddexp.reduce([alpha[j], *(alpha[lat.first[x]] + mass[x] for x in segs.get(j, ()))])
    for i in range(n - 1, -1, -1):
        beta[i] = np.logaddexp.reduce([beta[i + 1], *(beta[lat.last[x] + 1] + mass[x] for x in opens.get(i, ()))])
    first, last = np.array(lat.first), np.array(lat.last)
    expected = np.exp(alpha[first][:, None] + scores + beta[last + 1][:, None] - alpha[n])
    observed = np.zeros_like(expected)
    for x in range(len(lat.first)):
        for k, kind in enumerate(KINDS):
            observed[x, k] = (lat.tokens[lat.first[x]][0], lat.tokens[lat.last[x]][1], kind) in gold
    return lat.features.T @ (observed - expected)


# What the model is trained on.


def _valid_card(rng: random.Random, n: int, valid: bool) -> str:
    body = "".join(str(rng.randint(0, 9)) for _ in range(n - 1))
    check = next(c for c in "0123456789" if luhn(body + c))
    return body + (check if valid else str((int(check) + rng.randint(1, 9)) % 10))


def _word(rng: random.Random) -> str:
    return "".join(rng.choice(("ba", "re", "ti", "on", "st", "le", "and", "er", "ou", "in")) for _ in range(rng.randint(1, 4)))


def _digits(rng: random.Random, n: int) -> str:
    return "".join(str(rng.randint(0, 9)) for _ in range(n))


def _hex(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789abcdef") for _ in range(n))


def _entity(rng: random.Random) -> tuple[str, str, str]:
    """Words before, the entity, its kind."""
    kind = rng.choice(KINDS)
    octet = lambda: str(rng.randint(0, 255))
    name, host = f"{_word(rng)}{rng.choice(('', '.', '_'))}{rng.choice((_word(rng), _digits(rng, 2)))}", f"{_word(rng)}{rng.choice(('', '7'))}.{rng.choice(('com', 'org', 'example.net'))}"
    if kind == "email":
        return rng.choice(("", "mail ", "contact: ")), rng.choice((f"{name}@{host}", f"{name}@{host}", f"{name} (at) {host}", f"{name} [at] {host.replace('.', ' [dot] ')}", f"{name}(at){host}")), kind
    if kind == "ip":
        return rng.choice(("", "host ", "from ")), ".".join(octet() for _ in range(4)), kind
    if kind == "card":
        c = _valid_card(rng, 16, True)
        sep = rng.choice(("", "", " ", "-", "."))
        return rng.choice(("", "card ", "paid by card: ", "visa ")), sep.join(c[i : i + 4] for i in range(0, 16, 4)), kind
    if kind == "phone":
        a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
        if rng.random() < 0.5:
            return rng.choice(("", "call ", "tel. ")), rng.choice((f"+1 ({a}) {b}-{c}", f"+49 {a} {b}{c}", f"+{_digits(rng, 2)} {a} {b} {c}")), kind
        return rng.choice(("call ", "phone: ", "tel. ", "fax ", "mobile ")), rng.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"{a}.{b}.{c}", f"0{a}/{b}{c}")), kind
    return rng.choice(('token = "', "key: ", "secret ", 'api key = "')), rng.choice((_hex(rng, 40), _hex(rng, 32), f"sk_live_{_hex(rng, 24)}")), kind


def _decoy(rng: random.Random) -> str:
    a, b = _digits(rng, 3), _digits(rng, 4)
    return rng.choice(
        (
            f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", f"{rng.randint(0, 23)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}", f"v{rng.randint(0, 9)}.{rng.randint(0, 30)}.{rng.randint(0, 9)}",
            f"{a}.{b}", f"${a},{_digits(rng, 3)}.00", f"page {a}", f"INV-{b}-{_digits(rng, 6)}", _valid_card(rng, 16, False), _valid_card(rng, 16, False), _digits(rng, 7), _digits(rng, 10), f"{rng.randint(256, 999)}.{a}.{rng.randint(300, 999)}.{a}",
            f"@{_word(rng)}", f"{_word(rng)}@{_word(rng)}", f"ISBN 978-3-{_digits(rng, 2)}-{_digits(rng, 6)}-{rng.randint(0, 9)}", f"{a}-{b}", f"({a})", f"{rng.randint(1, 99)}%", f"sha {_hex(rng, 40)}", f"{a} {a} {a}", f"{a} {b} {a} {b}", f"{_digits(rng, 2)}.{_digits(rng, 2)}.{rng.randint(1990, 2030)}",
        )
    )


def _table(rng: random.Random) -> str:
    """A row of plain numbers, as tables and lists have them."""
    kind, sep = rng.randint(0, 3), rng.choice((" ", " ", ", ", "  ", ";", "/", "-"))
    made = {
        0: lambda: f"{rng.choice(('', '-'))}{rng.randint(0, 9)}.{_digits(rng, rng.randint(1, 6))}",
        1: lambda: str(rng.randint(0, 99999)),
        2: lambda: _digits(rng, 4),
        3: lambda: f"{rng.randint(10, 999)}.{_digits(rng, rng.choice((2, 4)))}",
    }[kind]
    return sep.join(made() for _ in range(rng.randint(4, 12)))


def written_sentences(n: int = SENTENCES, seed: int = SEED) -> list[tuple[str, set[tuple[int, int, str]]]]:
    """Sentences with entities and look-alikes, and the spans in them."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        text, gold = "", set()
        for _part in range(rng.randint(1, 2)):
            text += " ".join(_word(rng) for _ in range(rng.randint(1, 4))) + rng.choice((" ", " ", ", ", ".", ": "))
            if rng.random() < 0.55:
                lead, entity, kind = _entity(rng)
                if kind == "email" and text.endswith("."):
                    text += " "
                text += lead
                gold.add((len(text), len(text) + len(entity), kind))
                text += entity + ('"' if lead.endswith('"') else "")
            else:
                text += _table(rng) if rng.random() < 0.3 else _decoy(rng)
            text += rng.choice((" ", ". ", ", "))
        out.append((text + _word(rng) + ".", gold))
    return out


@lru_cache(maxsize=2)
def trained_weights(sentences: int = SENTENCES, passes: int = PASSES) -> np.ndarray:
    """Weights (feature, kind) by stochastic ascent of the conditional likelihood with adaptive steps; the same on every run."""
    rng = np.random.default_rng(SEED)
    data = [(lat, gold) for text, gold in written_sentences(sentences) if (lat := lattice(text, 0, len(text))).first]
    weights = np.zeros((len(FEATURES), len(KINDS)))
    weights[0] = -2.0
    square = np.full_like(weights, 1e-2)
    for _ in range(passes):
        for k in rng.permutation(len(data)):
            g = gradient(*data[k], weights) - PRIOR * weights
            square += g * g
            weights += STEP * g / np.sqrt(square)
    return weights


# The operator.


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """The parts of the text within MAX_CHARS of an anchor or of a RUN with a digit; no entity reaches outside them."""
    start = stop = None
    runs = (m for m in RUN.finditer(text) if DIGIT.search(m[0]))
    for m in merge(ANCHOR.finditer(text), runs, key=re.Match.start):
        a, b = max(0, m.start() - MAX_CHARS), min(len(text), m.end() + MAX_CHARS)
        if start is not None and a <= stop:
            stop = max(stop, b)
            continue
        if start is not None:
            yield start, stop
        start, stop = a, b
    if start is not None:
        yield start, stop


def all_spans(text: str, weights: np.ndarray) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans: the base and what the model adds where no base span is, or around those that lie in a secret."""
    base = base_spans(text)
    added = []
    for a, b in stretches(text):
        added += decode(text, a, b, weights)
    taken = sorted((a, b) for a, b, _ in base)
    ends = np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []
    starts = [a for a, _ in taken]

    def free(a: int, b: int, kind: str) -> bool:
        k = bisect_left(starts, b)
        if k == 0 or ends[k - 1] <= a:
            return True
        before = bisect_left(starts, a)
        return kind == "secret" and ends[k - 1] <= b and (before == 0 or ends[before - 1] <= a)

    return base, sorted(base + [s for s in added if free(*s)], key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span, overlapping ones as one, replaced by its kind in brackets."""
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


RESULT = T.StructType([T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])


def find_documents(df: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Personal data of every whole text, in one narrow pass: counts of base kinds, base_sha256, spans (code points, end exclusive).

    Null and empty texts have none. Equal texts get equal spans. Other columns go; kept ones named as a result give way.
    """
    weights = trained_weights()

    def make():
        def run(texts):
            rows = []
            for t in texts:
                base, spans = all_spans(t, weights)
                kinds = [k for _, _, k in base]
                rows.append((*(kinds.count(k) for k in BASE_KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
            return [list(c) for c in zip(*rows, strict=True)]

        return run

    return map_text(df, make, RESULT, text_col, keep)


def redact_documents(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``df`` with personal data in ``text_col`` replaced by its kind; a null text stays null."""
    weights = trained_weights()
    out = T.StructType([T.StructField("__redacted", T.StringType())])

    def make():
        return lambda texts: [[redacted(t, all_spans(t, weights)[1]) for t in texts]]

    done = map_text(df, make, out, text_col, df.columns)
    return done.select(*[F.when(F.col(c).isNotNull(), F.col("__redacted")).alias(c) if c == text_col else F.col(c) for c in df.columns])


def op5_semi_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all ``documents``; nulls, empty and long texts as in find_documents."""
    return find_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op5_semi_markov": op5_semi_markov}
ORACLES: dict[str, str] = {}
