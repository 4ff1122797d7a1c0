"""The pipeline, stage by stage, against plain versions of what each stage must keep."""

import collections
import math
import os
import random
import re
import sys

import numpy as np

sys.path.insert(0, os.path.dirname(__file__))
from test_operators import LOWER, brute_components, some_texts  # noqa: E402

import corpus_pipeline as pipeline  # noqa: E402
from receiptlake.llm import packing, quality_lm  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    texts = some_texts()
    sf_dir = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "a" if i % 3 else "b", len(t or "")) for i, t in enumerate(texts)], SCHEMA).write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(9, 60)], "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{sf_dir}/{k}")
        docs = spark.read.parquet(f"{sf_dir}/{k}")
        seen[k] = docs.collect()

    first = {r["doc_id"]: r["text"] for r in seen[0]}
    assert len(first) > 60 and all(WORD.search(t) for t in first.values())

    keys = {i: [line.strip(" \t\n\x0b\x0c\r").translate(LOWER) for line in t.split("\n")] for i, t in first.items()}
    n = collections.Counter(k for ks in keys.values() for k in {*ks} if k)
    holder = {k: min(i for i, ks in keys.items() if k in ks) for k in n}
    kept = {i: "\n".join(line for line, k in zip(first[i].split("\n"), ks, strict=True) if not (k and n[k] >= 10) or holder[k] == i) for i, ks in keys.items()}
    kept = {i: t for i, t in kept.items() if WORD.search(t)}
    assert {r["doc_id"]: r["text"] for r in seen[1]} == kept and all(r["n_chars"] == len(r["text"]) for r in seen[1])

    ids = sorted(kept)
    groups = brute_components([kept[i] for i in ids])
    want = {i for k, i in enumerate(ids) if groups[k][1] == k}
    assert {r["doc_id"] for r in seen[2]} == want and len(want) < len(ids)

    size = {r["doc_id"]: len(WORD.findall(r["text"])) for r in seen[2]}
    copies = collections.Counter(r["doc_id"] for r in seen[3])
    assert max(copies.values()) <= 2 and copies.keys() <= size.keys()
    taken = sum(size[i] * c for i, c in copies.items())
    assert abs(taken - 1.5 * sum(size.values())) <= max(size.values())

    encoder = packing.Encoder(packing.tokenizer_file())
    tokens = {r["doc_id"]: len(np.frombuffer(encoder.ids(r["text"]), "<u4")) + 1 for r in seen[3]}
    packed = collections.Counter()
    for r in seen[4]:
        packed[r["doc_id"]] += r["length"]
    assert packed == {i: tokens[i] * c for i, c in copies.items()}

    whole = collections.Counter()
    for r in pipeline.run(spark, sf_dir).collect():
        whole[r["doc_id"]] += r["length"]
    assert whole == packed


def test_rows_without_ids_and_repeated_ids_stay(spark):
    """Stages 2 to 5 lose no text for want of a distinct id: nulls, two texts under one id, equal rows."""
    word = lambda k: " ".join(f"t{k}_{i}" for i in range(30))
    rows = [(None, word(1)), (None, word(2)), (3, word(3)), (3, word(4)), (5, word(5)), (5, word(5)), (None, word(5)), (6, "ab"), (6, "ab")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], SCHEMA)
    lines = pipeline.drop_lines(spark, docs, "")
    assert lines.count() == len(rows)
    one = pipeline.one_of_each_group(spark, lines, "").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in one) == sorted([(0, word(1)), (0, word(2)), (3, word(3)), (3, word(4)), (5, word(5)), (6, "ab")])
    mixed = pipeline.mix_sources(spark, docs, "").collect()
    assert {r["text"] for r in mixed} <= {t for _, t in rows} and abs(len(mixed) - 1.5 * len(rows)) <= 2
    assert pipeline.pack_sequences(spark, docs, "").agg({"doc_tokens": "count"}).first()[0] >= len(rows)


def test_columns_of_any_name_pass_through_each_stage(spark, tmp_path):
    names = ["_text", "_kept", "_high", "_n_words", "_blang", "_id", "row", "doc", "copies", "c0", "c1", "_n_lines"]
    rows = [(i, " ".join(f"w{(i * 7 + k * k) % 91}" for k in range(40 + i)), "en", "a", 1, *[f"{n}{i}" for n in names]) for i in range(80)]
    docs = spark.createDataFrame(rows, SCHEMA + ", " + ", ".join(f"{n} string" for n in names))
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for k, (name, stage) in enumerate(pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all(r[n] == f"{n}{r['doc_id']}" for r in got for n in names), name
    assert pipeline.pack_sequences(spark, docs, "").count() >= 80


def test_near_copies_without_ids_stay_once(spark):
    words = [f"w{k}" for k in range(100)]
    other = " ".join(["x", *words[1:]])
    rows = [(1, " ".join(words)), (None, other), (None, " ".join([*words[:-1], "y"])), (None, other), (None, "quite another text of some words here"), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], SCHEMA)
    got = pipeline.one_of_each_group(spark, docs, "").collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == [(0, rows[4][1]), (1, rows[0][1]), (7, "")]


def test_quality_counts_all_trusted_documents_each_without_itself(spark, tmp_path, monkeypatch):
    """Against a plain Kneser-Ney model of all trusted documents but the scored one; every trusted document sets the bounds."""
    monkeypatch.setattr(quality_lm, "OWN_WORDS", 50)
    rng = random.Random(8)
    texts = [" ".join(rng.choices(["a", "b", "c", "d", "e", "f", f"own{i}", f"two{i // 2}"], weights=[9, 7, 5, 3, 2, 2, 1, 1], k=rng.randint(0, 30))) for i in range(70)]
    texts += ["a b c own3", "zz", "", None, texts[5], "x"]
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)] + [(9, texts[9], "en", "a", 1), (None, texts[5], "en", "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    words = lambda t: (t or "").split()
    count = lambda ts: collections.Counter(tuple(p[i - 2 : i + 1]) for p in (["<", "<", *words(t)] for t in ts) for i in range(2, len(p)))
    whole = count([t for i, t, *_ in rows if i is not None and i < 60])
    levels = lambda tri: (collections.Counter(w for _, w in {g[1:] for g in tri}), collections.Counter(g[1:] for g in tri), tri)

    def discounts(counts):
        n = [sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        return [0, *[min(k, max(0.05, k - (k + 1) * y * n[k] / n[k - 1])) for k in (1, 2, 3)]]

    ds = [discounts(c) for c in levels(whole)]

    def score(t, tri):
        uni, bi, tri = levels(+tri)
        total, out = sum(uni.values()), 0
        floor = sum(ds[0][min(c, 3)] for c in uni.values()) / total / (len(uni) + 1)
        p = ["<", "<", *words(t)]
        for i in range(2, len(p)):
            q = (uni[p[i]] - ds[0][min(uni[p[i]], 3)]) / total + floor
            for counts, d, context in ((bi, ds[1], (p[i - 1],)), (tri, ds[2], (p[i - 2], p[i - 1]))):
                followers = [c for g, c in counts.items() if g[:-1] == context]
                if followers:
                    c = counts[(*context, p[i])]
                    q = (c - d[min(c, 3)] + sum(d[min(f, 3)] for f in followers) * q) / sum(followers)
            out += math.log10(q)
        return -out / len(words(t))

    x = {i: score(t, whole - count([t]) if i is not None and i < 60 else whole) for i, t, *_ in rows if words(t)}
    got = quality_lm.judge(docs, labels, whole=True).collect()
    monkeypatch.setattr(quality_lm, "BROADCAST_TRUSTED", 0)
    shuffled = quality_lm.judge(docs, labels, whole=True).collect()
    assert len(got) == len(shuffled) == len(rows)
    for r in got + shuffled:
        assert r["_n_words"] == len(words(r["text"])) and (r["_perplexity"] is None) == (not words(r["text"]))
        assert not words(r["text"]) or abs(math.log10(r["_perplexity"]) - x[r["doc_id"]]) < 1e-9
    own = [(x[i], len(words(t))) for i, t, *_ in rows if i is not None and i < 60 and words(t)]
    middle = np.median([v for v, _ in own])
    drawn = lambda v, n: (n * v + quality_lm.PRIOR_WORDS * middle) / (n + quality_lm.PRIOR_WORDS)
    high = np.quantile([drawn(*o) for o in own], quality_lm.HIGH_QUANTILE) + quality_lm.MARGIN
    assert all(abs(r["_high"] - high) < 1e-9 for r in got)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    want = sorted([(i, t) for i, t, *_ in rows if words(t) and drawn(x[i], len(words(t))) <= high], key=key)
    assert sorted([(r["doc_id"], r["text"]) for r in pipeline.keep_quality(spark, docs, str(tmp_path)).collect()], key=key) == want


def test_no_documents(spark, tmp_path):
    sf_dir = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    assert pipeline.run(spark, sf_dir).count() == 0
