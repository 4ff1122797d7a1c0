"""Patterns against regular expressions, the field against plain sums over all paths, spans on held-out sentences."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from receiptlake.llm import personal_data as pd_

WHOLE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(WHOLE.items()):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and pd_.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_patterns():
    rng = random.Random(1)
    cards = [pd_._card(rng) for _ in range(5)]
    parts = ["a", "b.c", "@", "@x.y", "1", "22", ".", "-", " ", "+", "+1", "(", ")", "255", "256", "0", "0004", "é", "a@b.c", "1.2.3.4", *cards, "x%y_z@h-1.org", "+1 (499) 555-6503", "\n", "++3 4"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 9)))
        assert pd_.base_spans(text) == plain_spans(text), text


@pytest.mark.parametrize("text", ["a" * 400_000 + " @", "1" * 400_000, "1." * 200_000, "@" * 300_000, "+1" * 200_000, "a@b" * 100_000, "a" * 200_000 + "@" + "b" * 200_000, "+1 " + "(" * 300_000])
def test_long_texts_take_linear_time(text):
    began = time.time()
    pd_.base_spans(text)
    assert time.time() - began < 3


@pytest.fixture(scope="module")
def field():
    return pd_.train(pd_.examples())


def random_field(rng, labels=5):
    f = pd_.Field(["email", "ip"], np.zeros(0, np.uint64))
    f.labels, f.transitions = labels, rng.standard_normal((labels, labels)) * 2
    return f


def test_decoding_finds_the_best_path():
    rng = np.random.default_rng(2)
    for case in range(200):
        f = random_field(rng)
        doc = np.sort(rng.integers(0, 4, 14))
        scores = rng.standard_normal((14, 5)) * 3
        scores[rng.random(14) < 0.4, 0] += 40  # sure ones
        got = f.decode(scores, doc)
        for d in np.unique(doc):
            own = scores[doc == d]
            value = lambda path, own=own: sum(own[i, y] for i, y in enumerate(path)) + sum(f.transitions[a, b] for a, b in itertools.pairwise(path))
            if len(own) <= 6:
                best = max(itertools.product(range(5), repeat=len(own)), key=value)
                assert np.isclose(value(best), value(got[doc == d])), case


def test_likelihood_and_its_gradient():
    rng = np.random.default_rng(4)
    f = rng.standard_normal((3, 4))
    w, t = rng.standard_normal((3, 4, 3)), rng.standard_normal((3, 3))
    place, gold, starts, length = np.array([-1, 0, 2, 1, -1, 1, -1]), np.array([0, 1, 2, 0, 0, 2, 0]), np.array([1, 5]), np.array([3, 1])

    def score(path, s):
        p = place[s : s + len(path)]
        e = sum(f[p[i]] @ w[1][:, y] + (f[p[i - 1]] @ w[0][:, y] if i else 0) + (f[p[i + 1]] @ w[2][:, y] if i + 1 < len(p) else 0) for i, y in enumerate(path))
        return e + sum(t[a, b] for a, b in itertools.pairwise(path))

    want = 0
    for s, n in ((1, 3), (5, 1)):
        every = [score(p, s) for p in itertools.product(range(3), repeat=n)]
        want += score(gold[s : s + n], s) - np.log(np.exp(every).sum())
    v, g_w, g_t = pd_.likelihood(w, t, f, place, gold, starts, length)
    assert np.isclose(v, want)
    for target, grad in ((w, g_w), (t, g_t)):
        for i in np.ndindex(target.shape):
            keep = target[i]
            target[i] = keep + 1e-6
            up = pd_.likelihood(w, t, f, place, gold, starts, length)[0]
            target[i] = keep
            assert abs((up - v) / 1e-6 - grad[i]) < 1e-4


def test_held_out_sentences(field):
    held = pd_.examples(500, seed=99)
    both = pd_.found(field, pa.array([t for t, _ in held]))
    right = wrong = missed = 0
    for (text, spans), (base, added) in zip(held, both, strict=True):
        got = {(s, e) for s, _, e in [*base, *added]}
        want = {(s, e) for _, s, e in spans}
        right, wrong, missed = right + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.95


def test_what_patterns_miss(field):
    cards = " ".join(pd_._card(random.Random(k)) for k in range(2))
    text = f'Call (499) 555-6503 or 499-555-6503 now. é token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"### {cards}'
    base, added = pd_.found(field, pa.array([text]))[0]
    named = {(field.kinds[k], text[s:e]) for s, k, e in added}
    assert ("phone", "(499) 555-6503") in named and ("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962") in named
    assert any(k == "card" for k, _ in named) and base == []
    clean = "The meeting is at ten. At at at, dot and the end at the 3rd of May 1998, 12.50 or 7 %.\n" * 20
    assert pd_.found(field, pa.array([clean])) == [([], [])]


def test_table(spark):
    labelled = pd_.labelled_table(spark)
    texts = [None, "", "mail an.01@mail3.example.com now", "x" * 70_000 + " 10.0.0.1", "é ü +1 (499) 555-6503", "plain words only"]
    rows = [(None if i == 4 else i, t, "n", 3) for i, t in enumerate([*texts, texts[2]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_ip long").repartition(3)
    got = {r["doc_id"]: r for r in pd_.personal_data(docs, labelled).collect()}
    assert len(got) == 7
    none = hashlib.sha256(b"").hexdigest()
    assert all(got[i]["base_sha256"] == none and got[i]["spans"] == "" for i in (0, 1, 5))
    assert got[2]["spans"] == got[6]["spans"] == "email:5:28" and got[2]["n_email"] == 1 and got[2]["base_sha256"] == hashlib.sha256(b"email:5:28").hexdigest()
    assert got[3]["spans"] == "ip:70001:70009" and got[None]["spans"] == "phone:4:21" and got[None]["n_phone"] == 1
    assert pd_.personal_data(docs.limit(0), labelled).count() == 0
    nothing_learned = pd_.personal_data(docs, labelled.limit(0)).filter("n_added > 0").count()
    assert nothing_learned == 0


def test_slices_do_not_change_spans(field, monkeypatch):
    texts = pa.array([t for t, _ in pd_.examples(60, seed=5)] + [None, ""])
    whole = pd_.found(field, texts)
    assert [x for i in range(len(texts)) for x in pd_.found(field, texts.slice(i, 1))] == whole
