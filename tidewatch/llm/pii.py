"""Personal data: exact base patterns and a semi-Markov conditional random field.

Base spans follow fixed patterns per kind, leftmost and non-overlapping. The
model adds spans of forms the patterns miss, such as written-out mail addresses
and telephone numbers without a plus sign.

The model scores whole candidate segments by features of the span (shape, digit
groups, separators, checks) and its neighbours (cue words before it). A
bounded-entity dynamic programme chooses borders and types jointly; the score of
a segmentation is the sum of its segments' scores. Weights are trained here by
gradient ascent on the conditional log-likelihood, with the semi-Markov
forward-backward recursion, on sentences generated from rules below; labels and
sources of a corpus play no part.

Candidates: a number of at most 19 digits (the longest card) from the border of
one run of digits and ().-+ to that of another, with at most GAP such marks, / or
: between two runs; and a written-out address, one local part, at, and name dot
name, up to each of its names, of which a domain name's 253 characters are the
limit. Where names and local parts end is found in one pass over all tokens. A
number takes part in at most 19 candidates, an at in 126, so there are linearly many;
tokens outside of them score 0 and the programme visits borders only.

Defined cases: null texts count as empty and have no spans; very long texts are
read whole, in time linear in their length but for a logarithm; repeated rows have
equal spans.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can begin only where a run of digits begins: a later start in the run has the same continuation
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d *= 2
            d -= 9 * (d > 9)
        total += d
    return total % 10 == 0


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and (c := text[begin - 1]) < "\x7f" and (c.isalnum() or c in "._%+-"):
            begin -= 1
        m = DOMAIN.match(text, at) if begin < at else None
        if m:
            end = m.end()
            yield begin, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) in code points, sorted."""
    found = [(b, e, 0) for b, e in _emails(text)]
    if HAS_DIGIT(text):
        for m in IP.finditer(text):
            first = text[m.start() : m.start(1) - 1]
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in (first, *m.groups())):
                found.append((m.start(), m.end(), 1))
        for m in CARD.finditer(text):
            if m.end() - m.start() <= 37:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    found.append((m.start(), m.end(), 3))
    return sorted(found, key=lambda s: (s[0], s[2], s[1]))


HAS_DIGIT = re.compile("[0-9]").search
TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")
# every candidate holds four digits with nothing but these marks between, or a written-out dot
ANCHOR = re.compile(r"[0-9](?:[\s().\-+/:]*[0-9]){3}|\b(?:dot|punkt|punto|point)\b", re.I)
HAS_ANCHOR = re.compile(r"[0-9]|dot|punkt|punto|point", re.I).search
DIGITS, GAP, BEFORE = 19, 3, 4
DOMAIN_LENGTH = 253  # fixed value: a domain name has no more characters
RUN_MARKS, MARKS, OPEN, CLOSED, LOCAL_MARKS = set("().-+"), set("().-+/:"), set("([{<"), set(")]}>"), set("._%+-")
AT_WORDS, DOT_WORDS = {"at", "arroba"}, {"dot", "punkt", "punto", "point"}
CUES = {
    "email": {"email", "mail", "contact", "write", "correo", "courriel", "reach"},
    "ip": {"ip", "host", "address", "server", "login", "adresse", "from"},
    "card": {"card", "visa", "mastercard", "tarjeta", "carte", "karte", "credit"},
    "phone": {"phone", "tel", "call", "telefon", "telefono", "mobile", "fax", "dial", "whatsapp"},
}
TOPS = {"com", "org", "net", "edu", "de", "fr", "es", "io", "info"}
FEATURES = ("bias", "length", "written with brackets", "ends in a known domain", "three digit groups", "four octets", "octets in range", "card length", "luhn", "phone length", "telephone grouping", "brackets", "grouped by one separator", "cue before", "goes on beyond", "letters among digits", "only digits")


class Stretch:
    """Tokens of a text and its candidate segments with their feature vectors."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.tokens = [m.span() for m in TOKEN.finditer(text)]
        self.words = [text[b:e].lower() for b, e in self.tokens]
        self.digit = [w[0].isdigit() and w.isascii() for w in self.words]
        #: (first token, one past the last, kind, features), by end
        self.arcs = sorted([*self._numbers(), *self._addresses()], key=lambda a: (a[1], a[0], a[2]))

    def _joined(self, k: int) -> bool:
        """Whether token k begins where the one before ends."""
        return 0 < k < len(self.tokens) and self.tokens[k][0] == self.tokens[k - 1][1]

    def _runs(self):
        """(first, last + 1, digits) of runs of digits and marks without white space, marks at their ends left out but for ( and + before a digit."""
        words, digit, k, n = self.words, self.digit, 0, len(self.words)
        while k < n:
            if not digit[k] and words[k] not in RUN_MARKS:
                k += 1
                continue
            begin, k = k, k + 1
            while k < n and (digit[k] or words[k] in RUN_MARKS) and self._joined(k):
                k += 1
            inside = [x for x in range(begin, k) if digit[x]]
            if inside:
                first = inside[0]
                while first > begin and words[first - 1] in "(+":
                    first -= 1
                yield first, inside[-1] + 1, sum(len(words[x]) for x in inside)

    def _numbers(self):
        runs = list(self._runs())
        # whether nothing but a few marks stands between a run and the next
        linked = [b - a <= GAP and all(w in MARKS for w in self.words[a:b]) for (_, a, _), (b, _, _) in pairwise(runs)]
        for r, (i, _, _) in enumerate(runs):
            n = 0
            for x in range(r, len(runs)):
                n += runs[x][2]
                if n > DIGITS:
                    break
                j = runs[x][1]
                if n >= 4:
                    if 9 <= n <= 15:
                        yield i, j, "phone", self._features(i, j, "phone")
                    if n >= 13:
                        yield i, j, "card", self._features(i, j, "card")
                    if n <= 12 and sum(self.digit[i:j]) == 4:
                        yield i, j, "ip", self._features(i, j, "ip")
                if x < len(linked) and not linked[x]:
                    break

    def _spelled(self, k: int, names: set[str]) -> tuple[int, int] | None:
        """First and last token of one of names around token k, brackets included."""
        if k >= len(self.words) or self.words[k] not in names:
            return None
        if 0 < k < len(self.words) - 1 and self.words[k - 1] in OPEN and self.words[k + 1] in CLOSED:
            return k - 1, k + 1
        return k, k

    def _names(self) -> None:
        """For each token where a name that begins at it ends, and where the local part that ends with it begins; each a pass over the tokens."""
        words, n = self.words, len(self.words)
        plain = [w.isalpha() or d for w, d in zip(words, self.digit, strict=True)]
        kept = 0  # one past the last token that is no dash
        last = []
        for k in range(n):
            kept = kept if words[k] == "-" else k + 1
            last.append(kept)
        reach = [0] * n
        for k in range(n - 1, -1, -1):
            goes_on = k + 1 < n and self._joined(k + 1) and (plain[k + 1] or words[k + 1] == "-")
            reach[k] = reach[k + 1] if goes_on else k + 1
        self.name_end = [last[reach[k] - 1] if plain[k] else k for k in range(n)]
        self.local_begin = []
        for k in range(n):
            local = plain[k] or words[k] in LOCAL_MARKS
            before = k and self._joined(k) and self.local_begin[k - 1] <= k - 1
            self.local_begin.append(self.local_begin[k - 1] if local and before else k if local else k + 1)

    def _name(self, k: int) -> int:
        """One past the last token of a name that begins at token k, or k."""
        return self.name_end[k] if k < len(self.words) else k

    def _addresses(self):
        words = self.words
        if not AT_WORDS.isdisjoint(words):
            self._names()
        for k, w in enumerate(words):
            if w not in AT_WORDS:
                continue
            first, last = self._spelled(k, AT_WORDS)
            i = self.local_begin[first - 1] if first else first
            j, dots, brackets = self._name(last + 1), 0, first < k
            if i == first or j == last + 1 or words[i] in ".-":
                continue
            size = self.tokens[j - 1][1] - self.tokens[last + 1][0]
            while True:
                dot = self._spelled(j, DOT_WORDS) or (j + 1 < len(words) and words[j] in OPEN and self._spelled(j + 1, DOT_WORDS)) or None
                end = self._name(dot[1] + 1) if dot else j
                if dots:
                    yield i, j, "email", self._features(i, j, "email", brackets, bool(dot) and end > dot[1] + 1)
                if not dot or end == dot[1] + 1:
                    break
                size += 1 + self.tokens[end - 1][1] - self.tokens[dot[1] + 1][0]
                if size > DOMAIN_LENGTH:
                    break
                j, dots, brackets = end, dots + 1, brackets or dot[0] < dot[1]

    def _features(self, i: int, j: int, kind: str, brackets: bool = False, beyond: bool = False) -> np.ndarray:
        words, digit = self.words, self.digit
        email = kind == "email"
        groups, marks = ([], set()) if email else ([w for w, d in zip(words[i:j], digit[i:j], strict=True) if d], {w for w, d in zip(words[i:j], digit[i:j], strict=True) if not d})
        digits = "".join(groups)
        near = lambda k: 0 <= k < len(words) and (digit[k] or words[k] in ".,:-/+" and 0 <= k + (1 if k >= j else -1) < len(words) and digit[k + (1 if k >= j else -1)])
        glued = self._joined(i) and words[i - 1].isalpha() or self._joined(j) and words[j].isalpha()
        values = (
            1, min(j - i, 12) / 12, brackets, email and words[j - 1] in TOPS, len(groups) in (3, 4), len(groups) == 4 and marks == {"."},
            len(groups) == 4 and all(int(g) <= 255 for g in groups), 14 <= len(digits) <= 19, bool(digits) and luhn(digits), 9 <= len(digits) <= 12,
            [len(g) for g in groups][-2:] == [3, 4], bool(marks & {"(", ")"}), len(marks - {"(", ")", "+"}) <= 1 and len(groups) > 1,
            any(w in CUES[kind] for w in words[max(0, i - BEFORE) : i]), beyond or bool(digits) and (near(i - 1) or near(j)), bool(glued), len(groups) == 1 and not marks,
        )
        return np.array(values, float)


class SemiMarkov:
    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.weights = weights

    def best(self, s: Stretch) -> list[tuple[int, int, str]]:
        """Segments of the highest-scoring segmentation; tokens outside entities score 0."""
        # borders at which the best score rises, that score, the segment that ends there and the border it goes on from
        at, score, how = [0], [0.0], [None]
        for i, j, kind, x in s.arcs:
            k = bisect_right(at, i) - 1
            v = score[k] + float(self.weights[kind] @ x)
            if v > score[-1]:
                if at[-1] == j:
                    score[-1], how[-1] = v, (i, j, kind, k)
                else:
                    at.append(j)
                    score.append(v)
                    how.append((i, j, kind, k))
        out, k = [], len(at) - 1
        while how[k]:
            i, j, kind, k = how[k]
            out.append((s.tokens[i][0], s.tokens[j - 1][1], kind))
        return out[::-1]

    def gradient(self, s: Stretch, truth: set[tuple[int, int, str]]) -> tuple[float, dict[str, np.ndarray]]:
        """Log-likelihood of a segmentation and its gradient, by forward-backward over segments."""
        n = len(s.tokens)
        arcs = [(*a, float(self.weights[a[2]] @ a[3])) for a in s.arcs]
        into, outof = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
        for a in arcs:
            into[a[1]].append(a)
            outof[a[0]].append(a)
        ahead = np.zeros(n + 1)
        for j in range(1, n + 1):
            ahead[j] = np.logaddexp.reduce([ahead[j - 1], *(ahead[a[0]] + a[4] for a in into[j])])
        behind = np.zeros(n + 1)
        for i in range(n - 1, -1, -1):
            behind[i] = np.logaddexp.reduce([behind[i + 1], *(behind[a[1]] + a[4] for a in outof[i])])
        grad = {k: np.zeros(len(FEATURES)) for k in KINDS}
        value = -ahead[n]
        for i, j, kind, x, v in arcs:
            grad[kind] -= np.exp(ahead[i] + v + behind[j] - ahead[n]) * x
            if (s.tokens[i][0], s.tokens[j - 1][1], kind) in truth:
                grad[kind] += x
                value += v
        return value, grad


def generated_sentences(n: int = 160, seed: int = 7):
    """Sentences with known spans, and look-alikes without: dates, prices, versions, order numbers, prose with "at"."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("ta", "re", "mo", "lin", "es", "den", "qui", "or", "ba")) for _ in range(r.randrange(1, 4)))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card():
        body = digits(15)
        return next(body + d for d in "0123456789" if luhn(body + d))

    def entity():
        kind = r.choice(KINDS)
        if kind == "email":
            at, dot = r.choice(((" at ", " dot "), (" [at] ", " [dot] "), (" (at) ", " (dot) "), (" arroba ", " punto "), ("(at)", "(dot)")))
            local = word() + r.choice(("", "", "." + word(), "_" + digits(2)))
            return kind, f"{local}{at}{''.join(word() + dot for _ in range(r.choice((1, 1, 2, 3))))}{r.choice(sorted(TOPS))}"
        if kind == "ip":
            return kind, r.choice((".", " . ")).join(str(r.randrange(256)) for _ in range(4))
        if kind == "card":
            c = card()
            return kind, c if r.random() < 0.5 else r.choice(" -.").join(c[k : k + 4] for k in range(0, 16, 4))
        a, b, c = digits(3), digits(3), digits(4)
        pairs = lambda k: " ".join(digits(2) for _ in range(k))
        return kind, r.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 ({a}) {b}-{c}", f"{a} {b} {c}", f"0{a} / {pairs(2)} {digits(3)} {digits(2)}", f"0{digits(1)} {pairs(4)}", f"0{digits(2)} / {digits(3)} {digits(4)}"))

    def lookalike():
        return r.choice((
            lambda: f"{r.randrange(1900, 2100)}-{r.randrange(1, 13):02d}-{r.randrange(1, 29):02d}", lambda: f"{r.randrange(1, 29)}.{r.randrange(1, 13)}.{r.randrange(1990, 2030)}", lambda: f"version {r.randrange(9)}.{r.randrange(20)}.{r.randrange(20)}",
            lambda: f"{digits(2)}:{digits(2)}:{digits(2)}", lambda: digits(r.randrange(4, 9)), lambda: digits(r.choice((10, 12, 13, 20, 24))), lambda: f"{digits(3)},{digits(3)}.{digits(2)}", lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", lambda: f"{word()} at {word()}", lambda: f"{word()} at {word()} {word()}",
            lambda: f"{word()} at the {word()} com", lambda: f"{word()} at the dot of {word()}", lambda: f"{word()} at {word()} {r.choice(sorted(DOT_WORDS))} {word()}", lambda: hashlib.md5(digits(5).encode()).hexdigest(), lambda: f"{digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(4)}", lambda: f"order {digits(16)}" if not luhn(x := digits(16)) else f"page {x[:3]}",
        ))()

    for _ in range(n):
        text, spans = word(), set()
        for _ in range(r.randrange(1, 4)):
            if r.random() < 0.5:
                kind, form = entity()
                if r.random() < 0.4:
                    text += " " + r.choice(sorted(CUES[kind])) + r.choice((":", ""))
                text += " "
                if kind == "phone" and form[0] == "(" and r.random() < 0.2:
                    text += "call "
                spans.add((len(text), len(text) + len(form), kind))
                text += form
            else:
                text += " " + lookalike()
            text += f" {word()} {word()}" + r.choice((",", ".", ""))
        yield text, spans


@lru_cache(maxsize=1)
def trained(rounds: int = 40, rate: float = 0.5) -> SemiMarkov:
    """Adagrad over all generated sentences; the same weights on every run."""
    model = SemiMarkov({k: np.zeros(len(FEATURES)) for k in KINDS})
    for k in KINDS:
        model.weights[k][0] = -2.0
    seen = {k: np.full(len(FEATURES), 1e-6) for k in KINDS}
    data = [(Stretch(t), spans) for t, spans in generated_sentences()]
    for _ in range(rounds):
        total = {k: -0.02 * model.weights[k] for k in KINDS}
        for s, spans in data:
            for k, g in model.gradient(s, spans)[1].items():
                total[k] += g
        for k in KINDS:
            seen[k] += total[k] ** 2
            model.weights[k] += rate * total[k] / np.sqrt(seen[k])
    return model


def all_spans(text: str, base: list[tuple[int, int, int]], model: SemiMarkov) -> list[tuple[int, int, int]]:
    """Base spans and the model's spans that overlap none of them."""
    if not (HAS_ANCHOR(text) and ANCHOR.search(text)):
        return base
    found, starts, ends = list(base), [], []
    for b, e, _ in base:
        if ends and b <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(b)
            ends.append(e)
    for b, e, kind in model.best(Stretch(text)):
        k = bisect_right(starts, e - 1) - 1
        if k < 0 or ends[k] <= b:
            found.append((b, e, KINDS.index(kind)))
    return sorted(set(found), key=lambda s: (s[0], s[2], s[1]))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{b}:{e}" for b, e, k in spans)


COLUMNS = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]


def _finder(weights: dict[str, np.ndarray], key: str, text: str):
    def run(batches):
        model = SemiMarkov(weights)
        for pdf in batches:
            rows = []
            for k, t in zip(pdf[key], pdf[text], strict=True):
                t = t if isinstance(t, str) else ""
                base = base_spans(t)
                counts = [sum(s[2] == n for s in base) for n in range(4)]
                rows.append((k, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(all_spans(t, base, model))))
            yield pd.DataFrame(rows, columns=[key, *COLUMNS])

    return run


def find_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: key, counts of base spans by kind, their digest, and all spans."""
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInPandas(_finder(trained().weights, key, text), f"`{key}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
