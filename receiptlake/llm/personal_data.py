"""Personal data in texts: fixed patterns, and a linear-chain conditional random field that adds what they miss.

Patterns (email, ip, card, phone) are read in time linear in a text, whatever it
holds. The field labels tokens: stretches without white space and without the
marks of SEPARATES, less the marks at their ends. A token is known by its shape
alone (lengths, digits, letters, marks, checksum, what parts it from the token
before, and whether it is one of a few words that stand near labelled spans), as
one number; a label's score is a sum of learned weights of the shapes of the
token and of its two neighbours, and of transitions. Labels are O, and for each
kind B and I.

Training takes a small labelled table (text, spans), at most MOST_LABELLED rows,
those with the least hashes, and maximises its likelihood less a quadratic
penalty by L-BFGS; gradients come from forward and backward sums over all
sentences at once. ``examples`` makes such a table by rule; give another for
other kinds or languages.

Decoding is exact. A token whose O is ahead of each other label by more than all
transitions could ever give back is O on the best path, so it parts the text;
the stretches between such tokens are decoded by Viterbi, many at a time, step by
step in numpy.

Defined results: null and empty texts have no spans; whole texts of any length
are read; null and repeated ids are rows like others; other columns are ignored.
Spans of the field that overlap one of the patterns are left out, so patterns'
spans always stay. Spans are ordered by start, then kind.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkernel import buffers, pieces, words

BASE = ["email", "ip", "card", "phone"]
MOST_LABELLED, MOST_CUES, CUE_ROWS, PENALTY, STEPS, SLICE = 4000, 63, 8, 0.02, 80, 2 << 20
LABELLED_SCHEMA = "text string, spans array<struct<kind:string,start:int,end:int>>"

# patterns

_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9]+(?:[ -][0-9]+)*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _emails(text: str):
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        else:
            free = max(free, at + 1)  # what stands before an @ reaches no further back
        at = text.find("@", max(at + 1, free))


def _addresses(text: str):
    for m in _DOTTED.finditer(text):
        at, parts = m.start(), m.group().split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:] if len(p) > 3 else p) <= 255 for p in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in BASE, end) of all that the patterns find, in order."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    out += [(s, 1, e) for s, e in _addresses(text)]
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 12:
            digits = re.sub("[ -]", "", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# tokens and their shapes

SEPARATES = np.zeros(256, bool)
SEPARATES[[9, 10, 11, 12, 13, 32, *b"\"'`;,!?{}[]<>|=*#$&\\:"]] = True
_EDGE = np.zeros(256, bool)
_EDGE[[*b".%-_/()@^~"]] = True  # marks that no span begins or ends with; a bracket may open or close around digits
_MARKS = b"@.-+()/_%"
_KIND = np.full(256, 255, np.uint8)
_KIND[48:58] = 0
for _i, _m in enumerate(_MARKS):
    _KIND[_m] = 1 + _i
_KIND[65:91] = 10
_KIND[128:] = 11
_KIND[[*b"ghijklmnopqrstuvwxyz"]] = 12
_SPARSE = _KIND != 255
_SPARSE[97:123] = False
#: Fields of a shape: name and number of values. A shape is these values, packed.
FIELDS = [("length", 12), ("digits", 14), ("letters", 5), ("at", 3), ("dots", 5), ("hyphens", 4), ("plus", 2), ("brackets", 4), ("slash", 2), ("under", 2), ("percent", 2), ("foreign", 2), ("hex", 2), ("quad", 2), ("sum", 2), ("gap", 6), ("cue", MOST_CUES + 1)]
_BASES = np.cumsum([0, *[n for _, n in FIELDS]])
#: Pairs of fields that are features of the token itself, too.
PAIRS = [("length", "digits"), ("letters", "digits"), ("dots", "digits"), ("gap", "letters"), ("hyphens", "digits"), ("hex", "length")]
_PLACE = {name: i for i, (name, _) in enumerate(FIELDS)}
_STRIDES = np.cumprod([1, *[n for _, n in FIELDS[:-1]]])
_LENGTHS = np.array([2, 3, 4, 5, 7, 10, 15, 20, 32, 40, 65])
_DIGIT_COUNTS = np.array([1, 2, 3, 4, 5, 7, 8, 10, 12, 16, 17, 20, 32])


def _ends(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens less the marks at their ends. '(' stays before a digit, ')' stays in a token that '(' opens, '+' always stays."""
    start, end = start.copy(), end.copy()
    digit = lambda at: (data[at] >= 48) & (data[at] < 58)
    for side in (0, 1):
        left = np.arange(len(start))
        while len(left):
            s, e = start[left], end[left]
            at = s if side == 0 else e - 1
            go = _EDGE[data[np.minimum(at, len(data) - 1)]] & (e > s)
            inner = np.minimum(s + 1, len(data) - 1)
            go &= ~((data[at * go] == 40) & (e - s > 1) & digit(inner)) if side == 0 else ~((data[at * go] == 41) & (data[np.minimum(s, len(data) - 1)] == 40))
            left = left[go]
            if side == 0:
                start[left] += 1
            else:
                end[left] -= 1
    return start, end


def _gaps(data: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """What parts a token from the one before: 0 one space, 1 other white space or marks, 2 a line's end, 3 '=' or ':', 4 a quote after one of these, 5 a text's start."""
    out = np.ones(len(start), np.int64)
    first = np.ones(len(start), bool)
    first[1:] = doc[1:] != doc[:-1]
    before = np.zeros(len(start), np.int64)
    before[1:] = end[:-1]
    size = start - before
    out[(size == 1) & (data[np.maximum(start - 1, 0)] == 32)] = 0
    for k in range(1, 5):  # gaps are looked at for four marks back
        c = data[np.maximum(start - k, 0)]
        ok = (size >= k) & (size > 1 if k == 1 else True)
        quote = (c == 34) | (c == 39) | (c == 96)
        sign = (c == 61) | (c == 58)
        out[ok & (c == 10) & (out < 3)] = 2
        out[ok & sign] = np.where(out[ok & sign] == 6, 4, 3)
        out[ok & quote & (out < 3)] = 6
    out[out == 6] = 1
    sign_only = (size == 1) & np.isin(data[np.maximum(start - 1, 0)], [61, 58])
    out[sign_only] = 3
    out[first] = 5
    return out


def shapes(data: np.ndarray, offs: np.ndarray, cues: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shape, text number, first byte, byte after, hash) of every token; cues are sorted hashes of known words."""
    h, doc, start, end = words(data, offs, SEPARATES)
    if not len(h):
        z = np.zeros(0, np.int64)
        return z, z, z, z, h
    s, e = _ends(data, start, end)
    kept = e > s
    h, doc, s, e, whole_start, whole_end = h[kept], doc[kept], s[kept], e[kept], start[kept], end[kept]
    n = len(h)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, z, h
    at = np.flatnonzero(_SPARSE[data])
    tok = np.searchsorted(s, at, "right") - 1
    inside = (tok >= 0) & (at < e[np.maximum(tok, 0)])
    at, tok = at[inside], tok[inside]
    kind = _KIND[data[at]]
    counts = np.bincount(tok.astype(np.int64) * 12 + kind, minlength=12 * n).reshape(n, 12)
    size = e - s
    digits, marks, upper, foreign = counts[:, 0], counts[:, 1:10], counts[:, 10], counts[:, 11]
    letters = size - digits - marks.sum(1)
    first_upper = (data[s] >= 65) & (data[s] < 91)
    v = {name: np.zeros(n, np.int64) for name, _ in FIELDS}
    v["length"] = np.searchsorted(_LENGTHS, size, "right")
    v["digits"] = np.searchsorted(_DIGIT_COUNTS, digits, "right")
    v["letters"] = np.where(letters == 0, 0, np.where(upper == 0, 1, np.where(first_upper & (upper == 1), 2, np.where(upper == letters, 3, 4))))
    for name, mark, most in (("at", b"@", 2), ("dots", b".", 4), ("hyphens", b"-", 3), ("slash", b"/", 1), ("under", b"_", 1), ("percent", b"%", 1)):
        v[name] = np.minimum(marks[:, _MARKS.index(mark)], most)
    v["plus"] = (data[s] == 43).astype(np.int64)
    v["brackets"] = (marks[:, _MARKS.index(b"(")] > 0) + 2 * (marks[:, _MARKS.index(b")")] > 0)
    v["foreign"] = (foreign > 0).astype(np.int64)
    odd = np.flatnonzero((digits > 0) & (size >= 7))
    for i in odd[(size[odd] <= 128) & ((letters[odd] > 0) | (digits[odd] == size[odd]) | (marks[odd, 1] == 3))]:
        t = data[s[i] : e[i]].tobytes()
        if letters[i] and not marks[i].any():
            v["hex"][i] = not t.strip(b"0123456789abcdef") or not t.strip(b"0123456789ABCDEF")
        elif digits[i] == size[i]:
            v["sum"][i] = 12 <= size[i] <= 19 and luhn(t.decode())
        elif marks[i, 1] == 3 and digits[i] + 3 == size[i]:
            v["quad"][i] = all(0 < len(p) <= 3 and int(p) <= 255 for p in t.split(b"."))
    v["gap"] = _gaps(data, doc, whole_start, whole_end)
    if len(cues):
        near = np.minimum(np.searchsorted(cues, h), len(cues) - 1)
        v["cue"] = np.where(cues[near] == h, near + 1, 0)
    shape = sum(v[name] * stride for (name, _), stride in zip(FIELDS, _STRIDES, strict=True))
    return shape, doc, s, e, h


def features(shape: np.ndarray) -> np.ndarray:
    """(shapes, features) of 0 and 1: each field's value, then each pair's."""
    values = [(shape // stride) % n for (_, n), stride in zip(FIELDS, _STRIDES, strict=True)]
    columns = [b + v for b, v in zip(_BASES, values, strict=False)]
    at = int(_BASES[-1])
    for x, y in PAIRS:
        x, y = _PLACE[x], _PLACE[y]
        columns.append(at + values[x] * FIELDS[y][1] + values[y])
        at += FIELDS[x][1] * FIELDS[y][1]
    out = np.zeros((len(shape), at), np.float32)
    for c in columns:
        out[np.arange(len(shape)), c] = 1
    return out


# the field

class Field:
    """Labels, weights (three positions, features, labels), transitions, and the hashes of known words."""

    def __init__(self, kinds: list[str], cues: np.ndarray):
        self.kinds, self.cues = kinds, cues
        self.labels = 1 + 2 * len(kinds)  # O, then B and I of each kind
        self.weights = np.zeros((3, features(np.zeros(1, np.int64)).shape[1], self.labels))
        self.transitions = np.zeros((self.labels, self.labels))

    def scores(self, shape: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """(tokens, labels): what shapes say, without transitions."""
        distinct, index = np.unique(shape, return_inverse=True)
        f = features(distinct)
        before, own, after = ((f @ w.astype(np.float32)).astype(np.float64) for w in self.weights)
        out = own[index]
        same = doc[1:] == doc[:-1]
        out[1:] += before[index[:-1]] * same[:, None]
        out[:-1] += after[index[1:]] * same[:, None]
        return out

    def decode(self, scores: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The best labels of every text: whole Viterbi paths, parted where O is sure."""
        t = self.transitions
        back = np.maximum(0, (t - t[:, :1]).max(0)) + np.maximum(0, (t - t[:1]).max(1))
        sure = (scores[:, :1] - scores - back)[:, 1:].min(1) > 1e-9
        labels = np.zeros(len(scores), np.int64)
        rest = np.flatnonzero(~sure)
        if not len(rest):
            return labels
        new = np.ones(len(rest), bool)
        new[1:] = (rest[1:] != rest[:-1] + 1) | (doc[rest[1:]] != doc[rest[:-1]])
        first = rest[new]
        length = np.diff(np.append(np.flatnonzero(new), len(rest)))
        order = np.argsort(-length, kind="stable")
        first, length = first[order], length[order]
        last = first + length - 1
        follows = (first > 0) & (doc[np.maximum(first - 1, 0)] == doc[first])  # a sure O stands before, or nothing
        goes_on = (last + 1 < len(doc)) & (doc[np.minimum(last + 1, len(doc) - 1)] == doc[last])
        best = scores[first] + np.where(follows[:, None], t[0], 0)
        came = []
        ended = np.zeros((len(first), self.labels))
        active = len(first)
        for k in range(int(length[0])):
            if k:
                active = int(np.searchsorted(-length, -k, "left"))  # those longer than k
                step = best[:active, :, None] + t
                came.append(step.argmax(1).astype(np.uint8))
                best = step.max(1) + scores[first[:active] + k]
            done = length[:active] == k + 1
            ended[:active][done] = best[done]
        path = (ended + np.where(goes_on[:, None], t[:, 0], 0)).argmax(1)
        at = np.zeros(len(first), np.int64)
        for k in range(int(length[0]) - 1, -1, -1):
            active = int(np.searchsorted(-length, -k, "left")) if k else len(first)
            here = np.flatnonzero(length[:active] == k + 1)
            at[here] = path[here]
            labels[first[:active] + k] = at[:active]
            if k:
                at[:active] = came[k - 1][np.arange(active), at[:active]]
        return labels

    def spans(self, labels: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, first byte, byte after, kind) of the labelled runs."""
        out, on = [], np.flatnonzero(labels)
        before = -2
        for i in on:
            kind, inner = divmod(int(labels[i]) - 1, 2)
            if inner and before == i - 1 and out[-1][0] == doc[i] and out[-1][3] == kind:
                out[-1] = (out[-1][0], out[-1][1], int(end[i]), kind)
            else:
                out.append((int(doc[i]), int(start[i]), int(end[i]), kind))
            before = i
        return out


def likelihood(weights: np.ndarray, transitions: np.ndarray, f: np.ndarray, place: np.ndarray, gold: np.ndarray, starts: np.ndarray, length: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(log likelihood, its gradients) of labelled sentences. f: features of distinct shapes; place: the shape of each
    token, -1 before and after each sentence; sentences are sorted by falling length and start at starts."""
    n_shapes, labels = len(f), len(transitions)
    e = [f @ w for w in weights]
    inner = place >= 0
    pick = lambda m, p: np.where((p >= 0)[:, None], m[np.maximum(p, 0)], 0)
    before, after = np.append(-1, place[:-1]), np.append(place[1:], -1)
    score = pick(e[0], before) + pick(e[1], place) + pick(e[2], after)
    top = score.max(1, keepdims=True)
    x, t_top = np.exp(score - top), transitions.max()
    t = np.exp(transitions - t_top)
    longest = int(length[0])
    alpha, beta, scale = np.zeros_like(x), np.zeros_like(x), np.ones(len(x))
    actives = [int(np.searchsorted(-length, -k, "left")) if k else len(length) for k in range(longest)]
    for k in range(longest):
        at = starts[: actives[k]] + k
        a = x[at] * (alpha[at - 1] @ t if k else 1)
        scale[at] = a.sum(1)
        alpha[at] = a / scale[at, None]
    for k in range(longest - 1, -1, -1):
        n, more = actives[k], actives[k + 1] if k + 1 < longest else 0
        at = starts[:n] + k
        beta[at] = 1
        if more:
            nxt = at[:more] + 1
            beta[at[:more]] = (x[nxt] * beta[nxt]) @ t.T / scale[nxt, None]
    expected = alpha * beta
    expected[~inner] = 0
    follows = inner & (before >= 0)
    pair = np.einsum("ni,nj->ij", alpha[np.flatnonzero(follows) - 1], (x * beta / scale[:, None])[follows]) * t
    log_z = np.log(scale[inner]).sum() + top[inner].sum() + t_top * follows.sum()
    right = np.zeros_like(expected)
    right[np.flatnonzero(inner), gold[inner]] = 1
    chosen = (score * right).sum() + transitions[gold[np.flatnonzero(follows) - 1], gold[follows]].sum()
    d = right - expected
    grads = []
    for p in (before, place, after):
        ok = inner & (p >= 0)
        by_shape = np.stack([np.bincount(p[ok], d[ok, y], n_shapes) for y in range(labels)], 1)
        grads.append(f.T @ by_shape)
    g_t = np.bincount(gold[np.flatnonzero(follows) - 1] * labels + gold[follows], minlength=labels * labels).reshape(labels, labels) - pair
    return float(chosen - log_z), np.stack(grads), g_t


def _maximise(value, start: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with halved steps; value(x) gives (value, gradient)."""
    x = start
    v, g = value(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, factors = g.copy(), []
        for s, y in reversed(past):
            a = (s @ q) / (s @ y)
            factors.append(a)
            q -= a * y
        if past:
            s, y = past[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, np.linalg.norm(g))
        for (s, y), a in zip(past, reversed(factors), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        step = 1.0
        while step > 1e-8:
            v_new, g_new = value(x + step * q)
            if v_new >= v + 1e-4 * step * (g @ q):
                break
            step /= 2
        else:
            break
        s, y = step * q, g - g_new
        x = x + s
        if s @ y > 1e-10:
            past = [*past, (s, y)][-memory:]
        done = abs(v_new - v) <= 1e-6 * abs(v)
        v, g = v_new, g_new
        if done:
            break
    return x


def train(rows: list[tuple[str, list[tuple[str, int, int]]]], penalty: float = PENALTY, steps: int = STEPS) -> Field:
    """A field from labelled texts; spans are (kind, start, end) in code points."""
    kinds = [*BASE, *sorted({k for _, spans in rows for k, *_ in spans} - {*BASE})]
    texts = [t or "" for t, _ in rows]
    data, offs = buffers(pa.array(texts, pa.string()))
    gold_of = lambda doc, start, end: _gold(texts, rows, kinds, offs, doc, start, end)
    shape, doc, start, end, h = shapes(data, offs, np.zeros(0, np.uint64))
    gold = gold_of(doc, start, end)
    near: dict[int, set[int]] = {}
    for i in np.flatnonzero(gold):
        for j in range(max(0, i - 2), min(len(doc), i + 3)):
            if doc[j] == doc[i] and not any(48 <= c < 58 or c in _MARKS for c in data[start[j] : end[j]].tolist()):
                near.setdefault(int(h[j]), set()).add(int(doc[i]))
    often = sorted((k for k in near if len(near[k]) >= CUE_ROWS), key=lambda k: (-len(near[k]), k))[:MOST_CUES]
    field = Field(kinds, np.array(sorted(often), np.uint64))
    shape, doc, start, end, _ = shapes(data, offs, field.cues)
    if not len(shape):
        return field
    distinct, index = np.unique(shape, return_inverse=True)
    f = features(distinct).astype(np.float64)
    per = np.bincount(doc, minlength=len(rows))
    order = [r for r in np.argsort(-per, kind="stable") if per[r]]
    first = np.cumsum(per) - per
    place, golds, starts = [np.array([-1])], [np.array([0])], []
    at = 1
    for r in order:
        own = slice(first[r], first[r] + per[r])
        starts.append(at)
        place += [index[own], [-1]]
        golds += [gold[own], [0]]
        at += per[r] + 1
    place, golds, starts, length = np.concatenate(place), np.concatenate(golds), np.array(starts), per[order]
    cut, sizes = field.weights.size, (field.weights.shape, field.transitions.shape)

    def value(x):
        w, t = x[:cut].reshape(sizes[0]), x[cut:].reshape(sizes[1])
        v, g_w, g_t = likelihood(w, t, f, place, golds, starts, length)
        return v - penalty * (x @ x) / 2, np.concatenate([g_w.ravel(), g_t.ravel()]) - penalty * x

    x = _maximise(value, np.zeros(cut + field.transitions.size), steps)
    field.weights, field.transitions = x[:cut].reshape(sizes[0]), x[cut:].reshape(sizes[1])
    return field


def _gold(texts, rows, kinds, offs, doc, start, end) -> np.ndarray:
    """Labels of tokens from labelled spans: a token belongs to a span that it overlaps."""
    out = np.zeros(len(doc), np.int64)
    for r in range(len(rows)):
        spans = rows[r][1]
        if not spans:
            continue
        raw = lambda c, r=r: int(offs[r]) + len(texts[r][:c].encode())
        lo, hi = np.searchsorted(doc, [r, r + 1])
        for kind, a, b in spans:
            a, b = raw(a), raw(b)
            inside = lo + np.flatnonzero((start[lo:hi] < b) & (end[lo:hi] > a))
            k = 1 + 2 * kinds.index(kind)
            out[inside] = k + 1
            out[inside[:1]] = k
    return out


# a labelled table made by rule

# Words that stand before personal data.
LEADS = {
    "email": ["mail", "email", "write to", "contact", "reach me at"], "phone": ["tel", "phone", "call", "mobile", "fax"], "card": ["card", "visa", "pay with", "card number"],
    "ip": ["ip", "host", "from", "server"], "secret": ["token", "api_key", "password", "secret", "key"],
}
SYLLABLES = ["an", "the", "er", "in", "ou", "st", "re", "le", "ein", "sch", "ge", "de", "la", "é", "ü", "tion", "ment", "ing", "o", "a", "ich", "ra", "mo", "ção"]


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _card(rng: random.Random, passes: bool = True) -> str:
    head = rng.choice("3456") + _digits(rng, 14)
    return next(head + d for d in rng.sample("0123456789", 10) if luhn(head + d) == passes)


def _fours(digits: str, between: str) -> str:
    return between.join(digits[i : i + 4] for i in range(0, len(digits), 4))


def _made(rng: random.Random, kind: str) -> str:
    word = lambda n=3: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, n + 5)))
    host, end = f"{word()}{rng.choice(['', str(rng.randint(0, 9))])}", rng.choice(["com", "org", "net", "example.com", "de", "fr"])
    area, six = str(rng.randint(200, 999)), f"{rng.randint(200, 999)}-{_digits(rng, 4)}"
    if kind == "email":
        name = rng.choice([word(), f"{word()}.{word()}", f"{word()}.{_digits(rng, 2)}", f"{word()}_{_digits(rng, 3)}"])
        return rng.choice([f"{name}@{host}.{end}"] * 8 + [f"{name}(at){host}.{end}", f"{name}@{host}"])
    if kind == "ip":
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        c = _card(rng)
        return rng.choice([c] * 5 + [_fours(c, " "), _fours(c, "-"), _fours(c, ".")])
    if kind == "phone":
        return rng.choice([f"+1 ({area}) {six}"] * 3 + [f"+1 ({rng.randint(0, 199):03d}) {six}", f"({area}) {six}", f"({area}) {six}", f"{area}-{six}", f"{area}.{six.replace('-', '.')}", f"+{rng.randint(20, 99)} {_digits(rng, 2)} {_digits(rng, 7)}", f"00{rng.randint(20, 99)} {_digits(rng, 3)} {_digits(rng, 6)}"])
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    mixed = lambda n: "".join(rng.choice(letters) for _ in range(n))
    return rng.choice(["".join(rng.choice("0123456789abcdef") for _ in range(40))] * 5 + ["".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([32, 64]))), f"sk_live_{mixed(24)}", f"AKIA{mixed(16).upper()}", f"{mixed(12)}9{mixed(8)}"])


def _plain(rng: random.Random) -> str:
    """A word or number that is nobody's data."""
    word = "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))
    if rng.random() < 0.82:
        return rng.choice([word] * 7 + [word.capitalize(), word + ".", word + ",", word + rng.choice(["###", "***", "%%%", "$$$", "&&&", "?!"]), word.upper(), rng.choice(["at", "dot", "is", "for", "from", "card", "call", "key", "token"])])
    n = rng.randint
    return rng.choice([
        str(n(0, 99)), str(n(1900, 2030)), f"{n(1, 999)}.{n(10, 99)}", f"{n(1, 31)}/{n(1, 12)}/{n(1990, 2030)}", f"{n(1990, 2030)}-{n(10, 12)}-{n(10, 28)}", f"{n(10, 23)}:{n(10, 59)}", f"{n(0, 9)}.{n(0, 20)}.{n(0, 9)}", f"v{n(1, 9)}.{n(0, 9)}",
        f"{n(1, 99)}%", f"{n(10, 99)}-{n(10, 99)}", str(n(10_000, 99_999_999)), _card(rng, passes=False), f"978-{n(0, 9)}-{n(10, 99)}-{_digits(rng, 6)}-{n(0, 9)}", f"{n(300, 999)}.{n(0, 999)}.{n(0, 999)}.{n(0, 999)}",
        f"www.{word}.example", f"{word}.py", f"@{word}", f"{word}/{word}", f"{word}_{word}", f"A-{n(100, 9999)}", f"({word})", f"{word}-{word}", _digits(rng, n(20, 30)), f"{n(1, 9)},{_digits(rng, 3)},{_digits(rng, 3)}", f"x = {n(0, 99)}", f'{word} = "{word}"', f"{word}: {word}",
    ])


def examples(n: int = 1500, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """A labelled table by rule: sentences in which some stretches are personal data or credentials."""
    rng, out = random.Random(seed), []
    for i in range(n):
        parts: list[tuple[str, str | None]] = []
        if i % 8 == 0:  # ordinary text, often of few words that repeat, and nothing else
            some = [_plain(rng) for _ in range(rng.randint(1, 20))]
            out.append((" ".join(rng.choice(some) for _ in range(rng.randint(3, 40))), []))
            continue
        for _ in range(rng.randint(1, 3)):
            parts += [(_plain(rng), None) for _ in range(rng.randint(2, 7))]
            if rng.random() < 0.75:
                kind = rng.choice([*LEADS])
                lead, sign = rng.choice(LEADS[kind]), rng.choice([":", "", " =", " ="] if kind == "secret" else [":", "", ""])
                if kind == "secret" or rng.random() < 0.4:
                    parts.append((lead + sign, None))
                quoted = kind == "secret" and rng.random() < 0.7
                for _ in range(2 if kind == "card" and rng.random() < 0.1 else 1):
                    made = _made(rng, kind)
                    parts.append((f'"{made}"' if quoted else made + rng.choice(["", "", "", ".", ",", "###", "%%%"]), f"{kind}|{made}"))
        parts += [(_plain(rng), None) for _ in range(rng.randint(1, 5))]
        text, spans = "", []
        for piece, label in parts:
            text += rng.choice([" "] * 9 + ["\n"]) if text else ""
            if label:
                kind, _, made = label.partition("|")
                at = len(text) + piece.index(made)
                spans.append((kind, at, at + len(made)))
            text += piece
        out.append((text, spans))
    return out


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(examples(), LABELLED_SCHEMA)


# the job

def found(field: Field, texts: pa.Array) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text the patterns' spans and those that the field adds: (start, kind's number, end) in code points."""
    n = len(texts)
    data, offs = buffers(texts)
    suspect = np.zeros(256, bool)
    suspect[[*range(48, 58), 64]] = True
    at = np.flatnonzero(suspect[data])
    base: list[list] = [[] for _ in range(n)]
    for i in np.unique(np.searchsorted(offs, at, "right") - 1):
        base[i] = base_spans(texts[int(i)].as_py())
    added: list[list] = [[] for _ in range(n)]
    shape, doc, start, end, _ = shapes(data, offs, field.cues)
    if len(shape):
        labels = field.decode(field.scores(shape, doc), doc)
        for i, lo, hi, kind in field.spans(labels, doc, start, end):
            head = data[offs[i] : lo].tobytes().decode() if (data[offs[i] : lo] > 127).any() else None
            a = len(head) if head is not None else lo - int(offs[i])
            b = a + len(data[lo:hi].tobytes().decode())
            if not any(s < b and a < e for s, _, e in base[i]):
                added[i].append((a, kind, b))
    return list(zip(base, added, strict=True))


def personal_data(docs: DataFrame, labelled: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every document."""
    rows = labelled.select("text", "spans").orderBy(F.xxhash64("text"), "text").limit(MOST_LABELLED).collect()
    field = train([(r["text"], [tuple(s) for s in r["spans"] or []]) for r in rows])
    names = field.kinds
    told = lambda spans: ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(spans))

    def run(it):
        for batch in it:
            for lo, hi in pieces(batch.column(1), SLICE):
                out: dict[str, list] = {c: [] for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")}
                for base, more in found(field, batch.column(1).slice(lo, hi - lo)):
                    for k, c in enumerate(("n_email", "n_ip", "n_card", "n_phone")):
                        out[c].append(sum(s[1] == k for s in base))
                    out["base_sha256"].append(hashlib.sha256(told(base).encode()).hexdigest())
                    out["spans"].append(told([*base, *more]))
                    out["n_added"].append(len(more))
                kinds = [pa.string() if c in ("base_sha256", "spans") else pa.int64() for c in out]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *[pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)]], ["doc_id", *out])

    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"), labelled_table(spark))
