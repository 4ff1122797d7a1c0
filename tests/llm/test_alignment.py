"""Alignment against a plain version that encodes each text as a whole and compares all token ends."""

import collections
import hashlib
import itertools
import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from test_operators import some_texts  # noqa: E402

from receiptlake.llm import alignment  # noqa: E402

SCHEMA = "doc_id long, text string, n_a string, pairs long"
ODD = [" leading", "two  spaces", "end ", "a\n\nb\t c", "<|endoftext|> and <s> </s> <0x41> <unk>", "a▁b", "été naïve ÷ × « x » …", "no break space", "日本語 テキスト", "emoji 👩‍👩‍👧 ok", "é İ ı ﬁ",
       "\x00\x1c\x1d", "it's we'll I'D", "1234567 +1 (499) 555-6503", "﻿bom", "x" * 3000, "ab " * 900, "   ", "\n", "a  \n b", "ÀÃ Ã Âé", "Ã b"]


def plain(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(alignment._file(alignment.A_FILE)), SentencePieceProcessor(model_file=alignment._file(alignment.B_FILE))
    a_model.encode_special_tokens = True
    chars = {}
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    for k, b in enumerate([*printable, *sorted({*range(256)} - {*printable})]):
        chars[chr(b if k < len(printable) else 256 + k - len(printable))] = b
    names = {i: s for s, i in a_model.get_vocab().items()}

    def b_bytes(i):
        p = b_model.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode()

    count, docs = collections.Counter(), []
    for t in texts:
        doc = None
        if t:
            a, b = a_model.encode(" " + t, add_special_tokens=False).ids, b_model.encode(t)
            ab, bb = [bytes(chars[c] for c in names[i]) for i in a], [b_bytes(i) for i in b]
            if b"".join(ab) == b"".join(bb) == (" " + t).encode():
                ends = lambda parts: list(itertools.accumulate(map(len, parts)))
                ea, eb = ends(ab), ends(bb)
                at = dict(zip(eb, b, strict=True))
                links = [(x, at[e]) for x, e in zip(a, ea, strict=True) if e in at]
                cuts = sorted({*ea} & {*eb})
                low, groups = 0, []
                for c in cuts:
                    groups.append(",".join(str(x) for x, e in zip(a, ea, strict=True) if low < e <= c) + "|" + ",".join(str(x) for x, e in zip(b, eb, strict=True) if low < e <= c))
                    low = c
                doc = (len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())
                count.update(links)
        docs.append(doc)
    most = collections.Counter()
    for (_, y), c in count.items():
        most[y] = max(most[y], c)
    return [(0, 0, 0, 0, 0, 0, "") if d is None else (*d[:3], len(d[3]), sum(count[p] == most[p[1]] for p in d[3]), sum(count[p] for p in d[3]), d[4]) for d in docs]


@pytest.mark.parametrize("slice_", [1 << 21, 300])
def test_alignment(spark, monkeypatch, slice_):
    monkeypatch.setattr(alignment, "SLICE", slice_)
    rng = random.Random(2)
    letters = "abcdeéñß ÀÃ.,'  \n\t<>#日▁1"
    texts = [*[t for t in some_texts() if len(t or "") < 6000], *ODD, *["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(300)], "one two three", "one two three"]
    rows = [(None if i == 9 else i, t, "x", 1) for i, t in enumerate(texts)]
    got = alignment.scored(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    seen = {r["doc_id"]: tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in got}
    want = plain(texts)
    assert sum(w[0] > 0 for w in want) > 200 and sum(w[0] == 0 for w in want) > 5
    for i, w in enumerate(want):
        assert seen[None if i == 9 else i] == w, texts[i]


def test_cached_units_are_dropped_without_changing_results(monkeypatch):
    import pyarrow as pa

    both = alignment.loaded(alignment.A_FILE, alignment.B_FILE)
    texts = pa.array(["alpha beta gamma " * 30 + str(k) for k in range(40)])
    want = alignment.aligned(both, pa.array(range(40), pa.int64()), texts)
    monkeypatch.setattr(alignment, "CACHED", 3)
    monkeypatch.setattr(alignment, "JOINED", 10)
    both.known.clear()
    assert alignment.aligned(both, pa.array(range(40), pa.int64()), texts).equals(want)
    assert alignment.aligned(both, pa.array(range(40), pa.int64()), texts).equals(want)


def test_no_documents(spark):
    assert alignment.scored(spark.createDataFrame([], SCHEMA)).count() == 0
    none = alignment.scored(spark.createDataFrame([(1, None, "", 0), (2, "", "", 0)], SCHEMA)).collect()
    assert [tuple(r)[1:] for r in none] == [(0, 0, 0, 0, 0, 0, "")] * 2
