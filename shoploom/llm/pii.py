"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans.

The patterns give the base spans. The random field then looks at islands: the
runs of words with a digit or an at sign, and the marks of addresses written out
("[at]", "(dot)", " at ... dot ", " @ ") with the plain words on both sides that
a segment could reach. It scores candidate segments of an island, each by
features of the whole segment (digits, groups, checksum, what stands beside it),
and dynamic programming chooses boundaries and types jointly, with segments of a
bounded number of tokens. A candidate has a digit, an at sign or a mark and lies
in one island, so working island by island is exact. Beside a number or an at
sign without a mark, plain words are in no candidate. Segments that touch no
base span are added.

The field is trained here by its likelihood, on generated examples: written
addresses and numbers in usual and unusual forms, among numbers that are neither.
The examples come from a seeded generator, so the weights never depend on the
corpus.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections import deque
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import with_fields

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Possessive repeats and the guard before ip change no match, only the cost of none.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Tokens and characters of the longest segment that the field considers.
MOST_TOKENS, MOST_CHARS = 16, 72
#: Tokens after which the ways of the dynamic programme are looked at for a part that they share.
SETTLE = 64
EXAMPLES, EPOCHS, SEED = 700, 6, 7
BATCH_ROWS = 512

_TRIGGER = re.compile(r"[0-9@]")
#: Marks of an address written out; a lone "at" or "dot" is too common to be one.
_MARK = re.compile(r"[\[({<] ?(?:at|dot) ?[\])}>]|(?:[ \t]at[ \t]+|@[ \t]*)[^\s@]+[ \t]+dot[ \t]|[ \t]@[ \t]", re.IGNORECASE)
_LINE = re.compile(r"[^\S \t]")
_NEXT = re.compile(r"\S*(?:[ \t]\S*[0-9@(]\S*)*")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\w\s]|_|[^\W_]")


# --- base spans ------------------------------------------------------------


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])) % 10 == 0


def _emails(text: str):
    free, at = 0, text.find("@")
    while at >= 0:
        start, right = at, DOMAIN.match(text, at + 1)
        if right:
            while start > free and text[start - 1] in LOCAL:
                start -= 1
        if right and start < at:
            free = right.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every base span, by kind, then start."""
    found = [("email", *span) for span in _emails(text)] if "@" in text else []
    if re.search("[0-9]", text) is None:
        return found
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append(("phone", *m.span()))
    return found


# --- islands, segments, features -------------------------------------------


def _runs(text: str):
    """(start, end) of each run of words with a digit or an at sign; white space parts words."""
    end = 0
    for m in _TRIGGER.finditer(text):
        if m.start() < end:
            continue
        start = m.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        end = _NEXT.match(text, start).end()
        yield start, end


def _reach(text: str, start: int, end: int) -> tuple[int, int]:
    """How far segments with the mark from start to end can go within its line."""
    low, high = max(0, start - MOST_CHARS), min(len(text), end + MOST_CHARS)
    low = max([low, *(m.end() for m in _LINE.finditer(text, low, start))])
    stop = _LINE.search(text, end, high)
    before = [m.start() for m in _TOKEN.finditer(text, low, start)][-MOST_TOKENS:]
    after = [m.end() for m in _TOKEN.finditer(text, end, stop.start() if stop else high)][:MOST_TOKENS]
    return (before or [start])[0], (after or [end])[-1]


def islands(text: str):
    """(start, end) of each stretch of text in which segments can lie, in order."""
    marks = [_reach(text, *m.span()) for m in _MARK.finditer(text)]
    if not marks:
        yield from _runs(text)
        return
    start, end = -1, -1
    for a, b in sorted([*_runs(text), *marks]):
        if a >= end:
            if end > 0:
                yield start, end
            start = a
        end = max(end, b)
    yield start, end


_NAME, _WORDS = re.compile(r"[\w.%+-]+"), re.compile(r"[\w-]+")
_AT, _DOT = (re.compile(rf" ?[\[({{<]? ?(?i:{mark}) ?[\])}}>]? ?") for mark in ("at|@", r"dot|\."))
_BOTH = re.compile(r"(?i)(?:at|@).*(?:dot|\.)")


def spoken(s: str) -> bool:
    """Whether all of s is a name, an at mark, and words with dot marks between them; marks may be written out.

    A mark's letters may also be a word's, so s is read from left to right with all
    places at which a name or word can end: one look for a mark from each.
    """
    if _BOTH.search(s) is None:
        return False
    name = _NAME.match(s)
    if name is None:
        return False

    def behind(mark, places):
        found = set()
        for i in places:
            m = mark.match(s, i)
            word = m and _WORDS.match(s, m.end())
            if word:
                found.update(range(word.start() + 1, word.end() + 1))
        return found

    first = behind(_AT, range(1, name.end() + 1))
    seen, new = set(), behind(_DOT, first)
    while new:
        seen |= new
        new = behind(_DOT, new) - seen
    return len(s) in seen


_SHAPES = [
    re.compile(p)
    for p in (
        r"[\w.%+-]+@[\w-]+(\.[\w-]+)+",
        r"\S+ ?[\[({<]? ?(?i:at|@) ?[\])}>]? ?\S.*([\])}>.]|(?i:dot)) ?(?i:com|org|net|edu|gov|info|io|de|fr|uk|eu|ca|ch|nl|jp)",
        r"\d{1,3}(\.\d{1,3}){3}",
        r"\d{4}([ .-]?)\d{4}\1\d{4}\1\d{4}",
        r"\d{4}([ .-]?)\d{6}\1\d{5}",
        r"(\+|00)\d{1,3}[ .()-]*\d+([ .()/-]+\d+)*",
        r"\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}",
        r"\d{3}[.-]\d{3}[.-]\d{4}",
        r"\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{2,4}",
        r"\d{1,2}(:\d{2})+",
        r"\d+(\.\d+){0,2}",
    )
]
_PLAIN = (
    lambda s: "@" in s,
    lambda s: s.count("@") > 1,
    lambda s: s[0] == "+",
    lambda s: s[0] == "(",
    lambda s: s[0].isdigit(),
    lambda s: s[0].isalpha(),
    lambda s: s[-1].isdigit(),
    lambda s: s[-1].isalpha(),
    lambda s: not s[-1].isalnum(),
    lambda s: any(c.isspace() for c in s),
    lambda s: "-" in s,
    lambda s: "(" in s,
    lambda s: any(c.isalpha() for c in s),
    lambda s: s.isdigit(),
)
_EDGES = 6
WIDTH = 1 + len(_SHAPES) + 1 + len(_PLAIN) + 8 + 5 + 2 + 2 * _EDGES + 3


def _edge(c: str) -> int:
    if not c or c.isspace():
        return 0
    return 1 if c.isdigit() else 2 if c.isalpha() else 3 if c in ".,;:!?" else 4 if c in "\"'()[]<>" else 5


def segment_features(text: str, start: int, end: int, tokens: int) -> np.ndarray:
    s = text[start:end]
    digits = "".join(c for c in s if "0" <= c <= "9")
    n = len(digits)
    x = [1.0]
    x += [_SHAPES[0].fullmatch(s) is not None, spoken(s), *(p.fullmatch(s) is not None for p in _SHAPES[1:])]
    x += [f(s) for f in _PLAIN]
    x += [lo <= n <= hi for lo, hi in ((0, 0), (1, 3), (4, 6), (7, 8), (9, 12), (13, 16), (17, 19), (20, 10**9))]
    x += [s.count(".") == k for k in range(4)] + [s.count(".") > 3]
    x += [13 <= n <= 19 and luhn(digits), all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in s.split("."))]
    for c in (text[start - 1 : start], text[end : end + 1]):
        x += [_edge(c) == k for k in range(_EDGES)]
    x += [tokens == 1, tokens > 4, tokens > 9]
    return np.array(x, np.float64)


def _candidates(text: str, start: int, end: int):
    """Of each token of an island in turn: its span, and (tokens, end in the text) of the candidate segments that begin with it.

    Tokens and marks are read ahead no further than a segment can reach.
    """
    tokens, marks = _TOKEN.finditer(text, start, end), _MARK.finditer(text, start, end)
    ahead: deque[tuple[int, int]] = deque(m.span() for m in islice(tokens, MOST_TOKENS))
    near: deque[tuple[int, int]] = deque()
    next_mark = next(marks, None)
    while ahead:
        a, _ = ahead[0]
        found = []
        if text[a].isalnum() or text[a] in "+(":
            while next_mark and next_mark.start() < a + MOST_CHARS:
                near.append(next_mark.span())
                next_mark = next(marks, None)
            while near and near[0][1] <= a:
                near.popleft()
            first = _TRIGGER.search(text, a, min(end, a + MOST_CHARS))
            trigger = first.start() if first else end
            for n, (_, b) in enumerate(ahead, 1):
                if b - a > MOST_CHARS:
                    break
                if text[b - 1].isalnum() and (trigger < b or any(a < x and y < b for x, y in near)):
                    found.append((n, b))
        yield ahead.popleft(), found
        ahead.extend(m.span() for m in islice(tokens, 1))


def _plain(text: str, a: int) -> tuple[float, float, float]:
    return 1.0, float(text[a].isdigit()), float(text[a] == "@")


class Island:
    """The tokens of an island, its candidate segments and their features; for training."""

    def __init__(self, text: str, start: int, end: int) -> None:
        self.text, self.start, self.end = text, start, end
        self.spans: list[tuple[int, int]] = []
        self.segments: list[tuple[int, int]] = []
        features = []
        for i, (span, found) in enumerate(_candidates(text, start, end)):
            self.spans.append(span)
            for n, b in found:
                self.segments.append((i, i + n))
                features.append(segment_features(text, span[0], b, n))
        self.features = np.array(features).reshape(len(self.segments), WIDTH)
        self.plain = np.array([_plain(text, a) for a, _ in self.spans]).reshape(-1, 3)


# --- the field -------------------------------------------------------------

#: Labels: 0 is no entity, the kinds follow.
LABELS = 1 + len(KINDS)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = np.maximum(x.max(axis=axis, keepdims=True), -1e300)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


class Field:
    def __init__(self) -> None:
        self.entity = np.zeros((WIDTH, len(KINDS)))
        self.none = np.zeros(3)
        self.step = np.zeros((LABELS, LABELS))

    def best(self, text: str, start: int, end: int):
        """Yields the best segmentation's entities of an island, as (start, end, kind) in order.

        The programme goes from token to token. It keeps the scores of the segments
        that have begun and not ended, MOST_TOKENS ends ahead at most, and the ways
        that still may become the best one; where all of these share their past, that
        part is settled, given out and forgotten, so a long island needs no more memory
        than a short one as long as its ways meet again.
        """
        fresh = lambda: ([-np.inf] * LABELS, [None] * LABELS)  # noqa: E731  by label: score, and way (entity, way before it)
        ends: deque = deque([fresh() for _ in range(MOST_TOKENS + 1)])
        ends[0][0][0] = 0.0
        step, none, given = self.step.T.tolist(), self.none.tolist(), None
        for number, ((a, _), found) in enumerate(_candidates(text, start, end), 1):
            came, ways = ends.popleft()
            ends.append(fresh())
            best = []
            for label in range(LABELS):
                p = max(range(LABELS), key=lambda q, label=label: came[q] + step[label][q])
                best.append((came[p] + step[label][p], ways[p]))
            options = [(1, 0, sum(x * w for x, w in zip(_plain(text, a), none, strict=True)), None)]
            if found:
                scores = np.array([segment_features(text, a, b, n) for n, b in found]) @ self.entity
                options += [(n, label, s, (a, b, KINDS[label - 1])) for (n, b), row in zip(found, scores.tolist(), strict=True) for label, s in enumerate(row, 1)]
            for n, label, s, entity in options:
                score, way = best[label]
                scores_there, ways_there = ends[n - 1]
                if score + s > scores_there[label]:
                    scores_there[label], ways_there[label] = score + s, way if entity is None else [entity, way]
            if number % SETTLE == 0:
                live = [w for scores_there, ways_there in ends for s, w in zip(scores_there, ways_there, strict=True) if s > -np.inf]
                settled = _shared(live, given)
                if settled is not given:
                    yield from _unwound(settled, given)
                    given, settled[1] = settled, None  # forget what came before
        scores_there, ways_there = ends[0]
        yield from _unwound(ways_there[max(range(LABELS), key=scores_there.__getitem__)], given)

    def gradient(self, island: Island, gold: dict[tuple[int, int], int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Of the log-likelihood of the segmentation that has the gold segments and plain tokens elsewhere."""
        n, edge = len(island.spans), np.array(island.segments, np.int64).reshape(-1, 2)
        scores, plain = island.features @ self.entity, island.plain @ self.none
        by_end, by_start = ([np.flatnonzero(edge[:, k] == t) for t in range(n + 1)] for k in (1, 0))
        kinds = self.step[:, 1:]
        alpha, beta = np.full((n + 1, LABELS), -np.inf), np.full((n + 1, LABELS), -np.inf)
        alpha[0, 0], beta[n] = 0, 0
        for t in range(1, n + 1):
            alpha[t, 0] = _log_sum(alpha[t - 1] + self.step[:, 0], 0) + plain[t - 1]
            k = by_end[t]
            if len(k):
                came = _log_sum(alpha[edge[k, 0]][:, :, None] + kinds, 1)
                alpha[t, 1:] = _log_sum(came + scores[k], 0)
        for t in range(n - 1, -1, -1):
            beta[t] = self.step[:, 0] + plain[t] + beta[t + 1, 0]
            k = by_start[t]
            if len(k):
                ahead = (scores[k] + beta[edge[k, 1], 1:]).reshape(-1)
                beta[t] = np.logaddexp(beta[t], _log_sum(np.tile(kinds, len(k)) + ahead, 1))
        whole = _log_sum(alpha[n], 0)
        alone = np.exp(alpha[:-1] + self.step[:, 0] + (plain + beta[1:, 0] - whole)[:, None])
        held = np.exp(alpha[edge[:, 0]][:, :, None] + kinds + (scores + beta[edge[:, 1], 1:] - whole)[:, None, :])
        entity, none = -(island.features.T @ held.sum(1)), -(island.plain.T @ alone.sum(1))
        step = -np.concatenate([alone.sum(0)[:, None], held.sum(0)], axis=1)
        at = {seg: k for k, seg in enumerate(island.segments)}
        t, before, score = 0, 0, 0.0
        ends = {i: (j, label) for (i, j), label in gold.items()}
        while t < n:
            end, label = ends.get(t, (t + 1, 0))
            step[before, label] += 1
            score += self.step[before, label]
            if label:
                x = island.features[at[t, end]]
                entity[:, label - 1] += x
                score += x @ self.entity[:, label - 1]
            else:
                none += island.plain[t]
                score += island.plain[t] @ self.none
            t, before = end, label
        return entity, none, step, float(score - whole)


def _since(way, given) -> list:
    """The steps of a way after those that were given out."""
    out = []
    while way is not None and way is not given:
        out.append(way)
        way = way[1]
    return out[::-1]


def _shared(ways: list, given):
    """The longest way that all of the ways begin with."""
    paths = [_since(w, given) for w in {id(w): w for w in ways}.values()]
    last = given
    for level in zip(*paths, strict=False):
        if any(w is not level[0] for w in level):
            break
        last = level[0]
    return last


def _unwound(way, given):
    for step in _since(way, given):
        yield step[0]


# --- training --------------------------------------------------------------


def _example(r: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A line with its entities as (start, end, label)."""
    word = lambda: "".join(r.choice("abcdefghilmnoprstuvé") for _ in range(r.randint(2, 9)))
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card() -> str:
        body = r.choice("3456") + num(r.choice([14, 14, 13, 11]))
        body += next(d for d in "0123456789" if luhn(body + d))
        sep = r.choice(["", "", " ", "-", "."])
        return sep.join(body[i : i + 4] for i in range(0, len(body), 4))

    def phone() -> str:
        first = r.choice(["+" + str(r.randint(1, 99)) + r.choice(" -."), "+" + str(r.randint(1, 99)) + " ", "00" + str(r.randint(1, 99)) + " ", ""])
        area = r.choice(["({})", "({}) ", "{}-", "{}.", "{} "]) if first else r.choice(["({}) ", "{}-", "({})-"])
        return first + area.format(num(3)) + num(3) + r.choice("-. " if first else "-") + num(4)

    def email() -> str:
        at, dot = r.choice([("@", ".")] * 4 + [(" @ ", "."), ("[at]", "."), ("(at)", "(dot)"), (" at ", " dot ")])
        name = r.choice([word(), word() + "." + num(2), word() + "_" + word(), word() + num(3)])
        host = r.choice([word() + num(1), word(), word() + "-" + word()])
        digit = r.choice(["", num(1)]) if at == " at " else ""
        return name + digit + at + host + dot + r.choice(["com", "org", "net", "example.com".replace(".", dot), "fr"])

    ip = lambda: ".".join(str(r.randint(0, 255)) for _ in range(4))
    makes = [email, ip, card, phone]
    junk = [
        lambda: num(r.randint(1, 8)),
        lambda: f"{r.randint(1900, 2099)}-{r.randint(10, 12)}-{r.randint(10, 28)}",
        lambda: f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1990, 2030)}",
        lambda: f"{r.randint(0, 23)}:{num(2)}" + r.choice(["", ":" + num(2)]),
        lambda: f"{r.randint(0, 20)}.{r.randint(0, 20)}" + r.choice(["", f".{r.randint(0, 300)}"]),
        lambda: "v" + ".".join(num(1) for _ in range(r.randint(2, 5))),
        lambda: r.choice(["$", "€", ""]) + num(3) + "," + num(3) + r.choice(["", ".00"]),
        lambda: f"{word()} = \"{''.join(r.choice('0123456789abcdef') for _ in range(r.choice([16, 32, 40])))}\"",
        lambda: f"http://{word()}.example.com/{num(4)}?page={num(1)}",
        lambda: "-".join("".join(r.choice("0123456789abcdef") for _ in range(k)) for k in (8, 4, 4, 4, 12)),
        lambda: f"{num(3)}-{num(1)}-{num(2)}-{num(6)}-{num(1)}",
        lambda: "AKIA" + "".join(r.choice("ABCDEFGHIJ234567") for _ in range(16)),
        lambda: f"{num(2)} % {num(1)}/{num(1)}",
        lambda: f"@{word()}",
        lambda: " ".join(num(r.randint(1, 5)) for _ in range(r.randint(3, 9))),
        lambda: num(r.randint(20, 40)),
        lambda: r.choice([f"{word()} @ {word()}", f"{word()} (at) {word()}", f"{word()} [dot] {word()}", f"{word()} at {word()} dot {word()} {word()}", f"{word()} (at) {word()}. {word()}"]),
    ]
    text, gold = word() + " ", []
    for _ in range(r.randint(1, 2)):
        if r.random() < 0.55:
            label = r.randrange(len(makes))
            s = makes[label]()
            gold.append((len(text), len(text) + len(s), label + 1))
        else:
            s = r.choice(junk)()
        text += s + r.choice(["", ".", ",", ")", ""]) + " " + r.choice([word() + " ", ""]) + word() + " "
    return text, gold


def examples(n: int, seed: int) -> list[tuple[Island, dict[tuple[int, int], int]]]:
    r, out = random.Random(seed), []
    while len(out) < n:
        text, spans = _example(r)
        if any(len(_TOKEN.findall(text, a, b)) > MOST_TOKENS for a, b, _ in spans):
            continue  # beyond the longest segment
        found = 0
        for start, end in islands(text):
            island = Island(text, start, end)
            first = {a: i for i, (a, _) in enumerate(island.spans)}
            last = {b: i + 1 for i, (_, b) in enumerate(island.spans)}
            gold = {(first[a], last[b]): label for a, b, label in spans if a in first and b in last}
            found += sum(g in island.segments for g in gold)
            if len(island.spans) < 60:
                out.append((island, gold))
        assert found == len(spans), text  # every one is a candidate
    return out[:n]


@cache
def trained() -> Field:
    """The field after a fixed number of AdaGrad steps; the same on every machine."""
    field, data = Field(), examples(EXAMPLES, SEED)
    seen = [np.full_like(w, 1e-2) for w in (field.entity, field.none, field.step)]
    for epoch in range(EPOCHS):
        for island, gold in data:
            *grads, _ = field.gradient(island, gold)
            for w, g, h in zip((field.entity, field.none, field.step), grads, seen, strict=True):
                g = g - 1e-4 * w
                h += g * g
                w += 0.3 / (1 + 0.3 * epoch) * g / np.sqrt(h)
    return field


# --- columns ---------------------------------------------------------------


def _union(found: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint stretches that the spans cover."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(found):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def spans(text: str, field: Field) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, whether a base span), by kind as listed, then start."""
    base = base_spans(text)
    found = [(*s, True) for s in base]
    starts, ends = _union([(a, b) for _, a, b in base])

    def touched(a: int, b: int) -> bool:
        k = bisect_left(starts, b)
        return k > 0 and ends[k - 1] > a

    for start, end in islands(text):
        if touched(start, end) and all(touched(*m.span()) for p in (_TRIGGER, _MARK) for m in p.finditer(text, start, end)):
            continue
        found += [(kind, a, b, False) for a, b, kind in field.best(text, start, end) if not touched(a, b)]
    return sorted(found, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def masked(text: str, found: list[tuple[str, int, int, bool]]) -> str:
    """The text with each span as <KIND>; of overlapping spans the first stands for all."""
    out, free = [], 0
    for kind, start, end, _ in sorted(found, key=lambda s: (s[1], -s[2])):
        if start >= free:
            out += [text[free:start], f"<{kind.upper()}>"]
        free = max(free, end)
    return "".join([*out, text[free:]])


def find(docs: DataFrame, text: str = "text", mask: str | None = None) -> DataFrame:
    """Adds spans, an array of (kind, start, end, base), and drops the text; or keeps it masked.

    start and end count code points, the end is exclusive. A null text counts as
    empty. mask names the column for the text with <EMAIL> and so on in place of
    the spans; it may be the text column itself, and stays null for a null text.
    Repeated rows stay; a column named spans is replaced. An empty table gives an
    empty result.
    """
    weights = trained()
    added = {"spans": "array<struct<kind:string,start:int,end:int,base:boolean>>"}
    kept = [c for c in docs.columns if c not in (text, "spans", mask)]
    if mask:
        added[mask] = "string"
    slim = docs.select(text, *kept)
    schema = with_fields(slim.drop(text), added)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                texts = part.column(text).to_pylist()
                found = [spans(t or "", weights) for t in texts]
                rows = [[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in f] for f in found]
                new = [pa.array(rows, kind)]
                if mask:
                    new.append(pa.array([t and masked(t, f) for t, f in zip(texts, found, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *new], names=schema.names)

    return slim.mapInArrow(run, schema)


def span_text(spans) -> object:
    """kind:start:end of each span, comma-joined, as a column."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
