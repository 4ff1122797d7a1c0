"""Every operator against a plain version, over one messy table: nulls, empty and long texts, ties, repeated rows, other columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from receiptlake.llm import ann, html_text, jaccard_join, line_dedup, line_quality, lm_score, mixing, packing, quality_lm, textkernel, toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, score double, size string"


def some_texts():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + "."
    base = [line(40) + "\n" + line(30) for _ in range(6)]
    texts = [None, "", " \t\n", "Ein", "one two three", "one  TWO\x0bthree", "a b İx", "x" * 5000, " ".join(["again"] * 300)]
    texts += [line(rng.randint(1, 60)) for _ in range(30)]
    common = "A common line that many of these documents hold."
    for b in base:
        words = b.split(" ")
        texts += [b, b, b.upper()]
        for _ in range(6):
            w = list(words)
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    texts += [f"{line(5)}\n  {common.upper() if k % 2 else common} \n{line(4)}" for k in range(14)]
    texts.append("\n".join(line(20) for _ in range(400)))
    return texts


@pytest.fixture(scope="module")
def texts():
    return some_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "de", None][i % 3], [None, "src0", "src0", "b", "a"][i % 5], len(t or ""), 7, None, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(t):
    return WORD.findall((t or "").translate(LOWER))


def test_words_agree_with_a_regular_expression(texts, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(textkernel, "SEGMENT", 64)
    data, offs = textkernel.buffers(pa.array(texts))
    h, doc, starts, ends = textkernel.words(data, offs)
    got = [(int(d), bytes(data[a:b]).decode()) for d, a, b in zip(doc, starts, ends, strict=True)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in WORD.findall(t or "")]
    by_word = {}
    for (_, w), x in zip(got, h.tolist(), strict=True):
        assert by_word.setdefault(w.translate(LOWER), x) == x
    assert len(set(by_word.values())) == len(by_word)


def shingle_sets(texts):
    out = []
    for t in texts:
        w = lowered(t)
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute_components(texts):
    sets = shingle_sets(texts)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("short_run", "block", "hot_from", "shared_from"), [(8, 512, 100_000, 6), (3, 4, 100_000, 6), (2, 2, 3, 2)])
def test_jaccard_join(docs, texts, monkeypatch, short_run, block, hot_from, shared_from):
    """With the production limits, and with small ones that send runs to blocks and shingles to all tiles."""
    for name, value in (("SHORT_RUN", short_run), ("BLOCK", block), ("HOT_FROM", hot_from), ("SHARED_FROM", shared_from)):
        monkeypatch.setattr(jaccard_join, name, value)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicate_groups(docs).collect()}
    assert got == brute_components(texts)


def test_jaccard_join_of_nothing_and_of_repeated_rows(spark, none):
    assert jaccard_join.near_duplicate_groups(none).count() == 0
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (9, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicate_groups(table).na.fill(-1, ["doc_id"]).collect())
    assert got == [(-1, 2, 5), (5, 2, 5), (5, 2, 5), (9, 0, 9)]


def test_near_copies_of_one_text_cost_no_pairs_within_a_group(spark, monkeypatch):
    """Copies that each differ from the original, and from each other too much to link: stars find the original; near misses stay apart."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    rng = random.Random(6)
    original = [f"w{i}" for i in range(200)]
    texts = [" ".join(original)]
    for k in range(60):
        w = list(original)
        for i in rng.sample(range(200), 5 if k % 6 else 14):
            w[i] = f"x{k}_{i}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicate_groups(docs).collect()}
    want = brute_components(texts)
    assert got == want and len({c for _, c in want.values()}) > 1


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_labels_of_classes_with_many_rows(spark, docs, texts, monkeypatch, broadcast):
    """Broadcast or dealt out by class and salt: the same groups, with rows that have no id."""
    monkeypatch.setattr(jaccard_join, "BROADCAST_LABELS", broadcast)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicate_groups(docs).collect()}
    assert got == brute_components(texts)
    words = [f"w{k}" for k in range(100)]
    rows = [(None, " ".join(words))] * 40 + [(4, " ".join([*words[1:], "y"])), (None, " ".join(["z", *words[1:]])), (None, "on its own"), (9, "")]
    got = jaccard_join.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in got) == sorted([*[(0, 96, 4)] * 41, (4, 96, 4), (0, 1, 0), (9, 0, 9)])


def test_components_of_paths_and_hubs(spark):
    from receiptlake.llm.linkage import components

    rng = random.Random(8)
    path = [(i, i + 1) for i in range(300)]
    hub = [(1000, 1001 + i) for i in range(300)]
    edges = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in path + hub + [(7, 7), (5000, 4000)]]
    rng.shuffle(edges)
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1301)} | {4000: 4000, 5000: 4000}


def test_line_dedup(docs, texts, none):
    keys = [[line.strip(" \t\n\x0b\x0c\r").translate(LOWER) for line in (t or "").split("\n")] for t in texts]
    seen = collections.Counter(k for ks in keys for k in {*ks} if k)
    want = {}
    for i, (t, ks) in enumerate(zip(texts, keys, strict=True)):
        kept = [line for line, k in zip((t or "").split("\n"), ks, strict=True) if not (k and seen[k] >= 10)]
        want[i] = (len(ks), len(ks) - len(kept), "\n".join(kept))
    out = line_dedup.drop_common_lines(docs)
    assert out.columns[:8] == docs.columns
    got = {r["doc_id"]: (r["_n_lines"], r["_n_dropped"], r["_kept"]) for r in out.collect()}
    assert got == want and sum(w[1] for w in want.values()) >= 14
    assert line_dedup.drop_common_lines(none).count() == 0


def test_line_dedup_counts_documents_not_rows(spark):
    """Rows of one id are one document; ids that are null are documents by their texts; clashing names pass or are replaced."""
    rows = [(1, "x\ny", 1, 2, 3)] * 3 + [(2, "x", 1, 2, 3), (None, "x", 1, 2, 3), (None, "x", 1, 2, 3), (None, "x\nz", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id int, _common int, _kept int")
    out = line_dedup.drop_common_lines(docs, min_documents=4)
    assert out.columns == ["doc_id", "text", "_id", "_common", "_kept", "_n_lines", "_n_dropped"]
    assert sorted(r["_kept"] for r in out.collect()) == ["", "", "", "y", "y", "y", "z"]
    assert all(r["_n_dropped"] == 0 for r in line_dedup.drop_common_lines(docs, min_documents=5).collect())
    first = line_dedup.drop_common_lines(docs, min_documents=4, keep_first=True)
    assert sorted(r["_kept"] for r in first.collect()) == ["", "", "", "x\ny", "x\ny", "x\ny", "z"]


def test_line_runs_keep_counts_through_compaction(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    for k in range(5):
        runs.add(spark.createDataFrame([(k, 1, 1), (k, 10 + k, 1), (k, 10 + k, 1)], "doc long, h1 long, h2 int"))
    assert [len(level) for level in runs.levels] == [1, 0, 1] and sum(r.count() for r in runs.runs()) == 6
    assert {r["h1"]: r["n_docs"] for r in runs.counts().collect()} == {1: 5} | {10 + k: 1 for k in range(5)}
    assert runs.unseen(spark.createDataFrame([(0, 1, 1), (0, 99, 1)], "doc long, h1 long, h2 int")).count() == 1
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_runs")]


def test_quality_rules(docs, texts, none):
    rows = {r["doc_id"]: r for r in line_quality.quality_rules(docs).collect()}
    for i, t in enumerate(texts):
        words = WORD.findall(t or "")
        windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(k, k + 3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (r["kept"] and r["base_failed"])
    assert line_quality.quality_rules(none).count() == 0


def test_quality_rules_reject_what_frequent_lines_leave_empty(spark):
    """Rows of one id count as one document of a host; every row loses its own lines, however often it occurs."""
    line = "word " * 30 + "end"
    rows = [(i, "h", f"{line} {chr(97 + i)}\n{line}\n{line}") for i in range(15)] + [(50, "h", " ".join(f"w{k}" for k in range(80)))]
    rows += [rows[0]] * 3 + [(None, "h", rows[1][2]), (60, None, rows[1][2])] + [(70 + k % 2, "g", f"{line}\n{' '.join(f'v{k}_{j}' for j in range(60))}") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("_id", F.lit(1)).withColumn("host", F.lit("x")).repartition(4)
    got = sorted((r["doc_id"] is None, r["doc_id"], r["n_words_left"], r["kept"]) for r in line_quality.quality_rules(docs).collect())
    want = [(i, 32, False) for i in range(15)] + [(0, 32, False)] * 3 + [(50, 80, True), (60, 94, False)] + [(70 + k % 2, 91, True) for k in range(12)]
    assert got == [(False, *w) for w in sorted(want)] + [(True, None, 32, False)]


def test_mixing(docs, texts, none):
    rows = mixing.mixed(docs).collect()
    again = mixing.mixed(docs.repartition(2)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    size = {i: len(WORD.findall(t or "")) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["size"] for r in rows} == size
    per = collections.defaultdict(list)
    for r in rows:
        assert 0 <= r["copies"] <= 2
        per[r["source"]].append(r)
    order = sorted(per, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(r["size"] for r in per[s]) for s in order}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    bound, want, free = {s: 2 * total[s] for s in order}, {}, list(order)
    while True:
        level = (1.5 * sum(total.values()) - sum(want.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > bound[s]]
        if not over:
            break
        want |= {s: bound[s] for s in over}
        free = [s for s in free if s not in over]
    want |= {s: level * weight[s] for s in free}
    for s, rs in per.items():
        assert rs[0]["target"] == pytest.approx(want[s])
        assert abs(sum(r["size"] * r["copies"] for r in rs) - want[s]) <= max(r["size"] for r in rs) / 2 + 1e-6
    assert mixing.mixed(none).count() == 0


def test_mixing_of_repeated_rows_and_null_ids(spark):
    rows = [(None, f"w {k}", "a", 1, 2) for k in range(40)] + [(7, "one two three", "a", 1, 2)] * 30 + [(8, "x", None, 1, 2)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _id int, size int").repartition(3)
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows) and all(0 <= r["copies"] <= 2 for r in got)
    for s, most in (("a", 3), (None, 1)):
        rs = [r for r in got if r["source"] == s]
        assert abs(sum(r["size"] * r["copies"] for r in rs) - rs[0]["target"]) <= most / 2
    out = mixing.repeated(docs)
    assert out.columns == docs.columns
    taken = collections.Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert sum(taken.values()) == sum(r["copies"] for r in got) and taken[7, "one two three"] == sum(r["copies"] for r in got if r["doc_id"] == 7)


def test_mixing_combines_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    monkeypatch.setattr(mixing, "FAN", 3)
    docs = spark.createDataFrame([(i, "hot" if i % 3 else f"s{i % 4}", " ".join(["w"] * (i % 7))) for i in range(600)], "doc_id long, source string, text string")
    rows = mixing.mixed(docs).collect()
    assert len(rows) == 600
    for s in {r["source"] for r in rows}:
        rs = [r for r in rows if r["source"] == s]
        assert abs(sum(r["size"] * r["copies"] for r in rs) - rs[0]["target"]) <= 3


def test_packing(docs, texts, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_file())
    rows = packing.pack(docs, packing.tokenizer_file).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert zlib.crc32(ids[at : at + r["length"]].tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)
    for rs in by_sequence.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert packing.pack(none, packing.tokenizer_file).count() == 0


def test_tokenizer_markers_and_separators():
    from tokenizers import Tokenizer

    file = packing.tokenizer_file()
    t, e = Tokenizer.from_file(file), packing.Encoder(file)
    for text in ["It's <|endoftext|> here", "a\x1cb", "ÉCOLE, naïve. don't!!", "x y z", "ΣΑΣ İstanbul", "1,000.50 €"]:
        assert e.ids(text) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_column_generation_nears_the_bound():
    rng = np.random.default_rng(2)
    sizes = np.arange(1, 65)
    demand = rng.integers(0, 60, 64)
    plan = packing.solve(sizes, demand, 128)
    placed = sum(p * times for p, times in plan)
    assert (placed == demand).all() and all((p * sizes).sum() <= 128 for p, _ in plan)
    assert sum(times for _, times in plan) <= math.ceil((sizes * demand).sum() / 128) * 1.02 + 1


@pytest.mark.parametrize("equal", [1000, 3000])
def test_more_equal_vectors_than_candidates_go_by_id(spark, equal):
    rng = np.random.default_rng(equal)
    vectors = rng.standard_normal((equal + 500, 16)).astype(np.float32)
    order = rng.permutation(len(vectors))
    vectors[order[:equal]] = vectors[order[0]]
    table = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(5)
    same = sorted(int(i) for i in order[:equal])
    got = [(r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(table, table.filter(F.col("vec_id") == same[3])).orderBy("rank").collect()]
    assert got == [(k + 1, i, 0.0) for k, i in enumerate([x for x in same if x != same[3]][:10])]


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 32)).astype("f4")
    x[700:720] = x[0]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(2000, None, 0), (2001, [0.0] * 32, 0), (2002, [None] * 32, 0), (2003, [float("nan")] * 32, 0), (None, x[1].tolist(), 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = collections.defaultdict(list)
    for r in ann.nearest(table, table.filter("vec_id % 50 = 0")).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hit = 0
    wide = x.astype(float)
    for q in range(0, 1500, 50):
        d = np.sqrt(((wide - wide[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(1500), d))[:10].tolist()
        rs = sorted(got[q])
        assert [r[0] for r in rs] == list(range(1, 11)) and all(d[v] == s for _, v, s in rs)
        hit += len({*best} & {v for _, v, _ in rs})
    assert [v for _, v, _ in sorted(got[0])] == list(range(700, 710))
    assert hit / 300 >= 0.9 and 2000 not in got and 2001 not in got


def test_few_vectors_are_all_found(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.1]), (2, [0.0, 3.0])], "vec_id long, embedding array<double>")
    got = [(r["rank"], r["vec_id"]) for r in ann.nearest(table, table.filter("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2)]
    assert ann.nearest(table.limit(0), table.limit(0)).count() == 0


def test_vectors_of_two_lengths_and_blocks(spark, monkeypatch):
    """Vectors meet those of their length only; small blocks and parties give the same as one; a column that clashes is ignored."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6 if i % 2 else 9).tolist(), 1, 1.0) for i in range(200)] + [(500, [1e100] * 6, 1, 1.0), (501, [1e-200] * 6, 1, 1.0), (None, [1.0] * 6, 1, 1.0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, bucket int, near double")
    ask = lambda: sorted(map(tuple, ann.nearest(table, table.filter("vec_id % 20 = 0")).collect()))
    want = ask()
    kind = {r[0]: len(r[1]) for r in rows}
    assert all(kind[q] == kind[v] for q, _, v, _ in want) and {q for q, *_ in want} == {*range(0, 200, 20), 500}
    monkeypatch.setattr(ann, "BLOCK", 7)
    monkeypatch.setattr(ann, "PARTY", 1)
    assert ask() == want


def test_repeated_ids_do_not_hide_other_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8))
    x[1] = x[0] + 1e-3
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1, (x[1] + 1e-6 * k).tolist()) for k in range(80)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r["vec_id"]) for r in ann.nearest(table, table.filter("vec_id = 0")).collect())
    want = sorted(range(1, 60), key=lambda i: ((x[i] - x[0]) ** 2).sum())[:10]
    assert got[0] == (1, 1) and [i for _, i in got] == want


def test_lm_score(docs, texts, none):
    rows = {r["doc_id"]: r for r in lm_score.score(docs).collect()}
    tokens = [[*lowered(t), None] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    c = collections.Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    total, v = sum(c.values()), len(c)
    for i, t in enumerate(tokens):
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(t), sum(c[w] > 0 for w in t), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (total + 0.5 * (v + 1))) for w in t))
        assert r["score"] < 0
    out = [i for i, h in enumerate(held) if h]
    assert sum(rows[i]["score"] for i in out) > sum(rows[i]["base_score"] for i in out)
    assert lm_score.score(none).count() == 0
    twice = lm_score.score(docs.sparkSession.createDataFrame([(3, "a b a"), (3, "a b a"), (None, "a b"), (None, None)], "doc_id long, text string")).collect()
    assert len(twice) == 4 and len({(r["doc_id"], r["n_tokens"], r["score"]) for r in twice}) == 3 and {r["train_tokens"] for r in twice} == {12 if not twice[0]["held_out"] else 4}


def test_a_word_that_is_half_of_all_words_is_dealt_out(spark, monkeypatch):
    """The same scores with and without a second family of shards, which splits what would be one shard's pairs."""
    rng = random.Random(12)
    texts = [" ".join(f"the w{rng.randrange(4000)}" if rng.random() < 0.9 else f"v{rng.randrange(50)}" for _ in range(rng.randint(1, 120))) for _ in range(150)] + [None, "", "the the the the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(lm_score, "RUN_WORDS", 3000)
    seen = {}
    for share in (2.0, 1 / 256):
        monkeypatch.setattr(lm_score, "HOT_SHARE", share)
        rows = docs.select("doc_id", lm_score.held_out().alias("held_out"), "text")
        runs = lm_score.cut(rows.mapInArrow(lm_score._runs, "ids array<long>, held array<boolean>, words binary, places binary, lengths binary, often binary, times binary, tokens long").withColumn("run", F.monotonically_increasing_id()), "runs")
        hot = lm_score._hot_words(runs)
        assert (textkernel.word_hash("the") in hot) == (share < 1) and len(hot) <= 256
        load = runs.mapInArrow(lm_score._asking(8, hot), lm_score._ASKED).groupBy("shard").agg(F.sum(F.octet_length("next")).alias("n")).toPandas()["n"]
        seen[share] = ({r["doc_id"]: (r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in lm_score.score(docs).collect()}, load.max(), load[load > 0].median())
    (plain, most, _), (got, least, middle) = seen.values()
    assert got.keys() == plain.keys() and all(got[k] == pytest.approx(plain[k]) for k in plain)
    assert least < most / 3 and least < 2 * middle


def test_lm_score_counts_rare_pairs(spark, monkeypatch):
    """Every pair is an arc, if it is seen once only; runs of a few words give the same as one run."""
    texts = [(i, " ".join(f"w{(i * 7 + k * k) % 50}" for k in range(20)) + f" rare{i} pair{i}" + " rare1 pair1" * (i == 5)) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    tokens = {i: [*t.split(), None] for i, t in texts}
    train = [t for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    c = collections.Counter(w for t in train for w in t)
    pairs = collections.Counter(p for t in train for p in zip(t, t[1:], strict=False))
    followers = collections.Counter(a for a, _ in pairs)
    total = sum(c.values())
    unseen = sum(n == 1 for n in c.values()) / total

    def want(t):
        p1 = [(1 - unseen) * c[w] / total if c[w] else unseen for w in t]
        out = math.log10(p1[0])
        for a, b, p in zip(t, t[1:], p1[1:], strict=False):
            n = pairs[a, b]
            out += math.log10((n - 0.75 if n else 0) / c[a] + 0.75 * followers[a] / c[a] * p) if c[a] else math.log10(p)
        return out

    assert min(pairs.values()) == 1
    for words, part in ((1_500_000, 1024), (50, 7)):
        monkeypatch.setattr(lm_score, "RUN_WORDS", words)
        monkeypatch.setattr(lm_score, "PART_WORDS", part)
        got = {r["doc_id"]: r["score"] for r in lm_score.score(docs).collect()}
        assert got == {i: pytest.approx(want(t), rel=1e-5) for i, t in tokens.items()}


def test_counts_are_narrow_and_what_was_asked_leaves_the_disk(spark, monkeypatch):
    """Counts of one byte take one byte each, larger ones what they need; shards' answers are the same sums."""
    word, after, n = np.array([3, 9], "<u8").tobytes(), np.array([9, 3, 9], "<u8").tobytes(), textkernel.narrow
    ask = lambda run, n_words, c: (0, run, word, n(np.array(n_words)), n(np.array([2, 1])), after, n(np.array(c)))
    asked = [ask(1, [200, 0], [1, 200, 0]), ask(2, [3, 1], [0, 3, 0]), ask(3, [70_000, 1], [1, 1, 1])]
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
    table = pa.table([pa.array(c, k) for c, k in zip(zip(*asked, strict=True), kinds, strict=True)], ["shard", "run", "words", "n", "followers", "next", "c"])
    answers = lm_score._answer(table).to_pylist()
    for r in answers[:3]:
        assert textkernel.wide([r["n"]], np.array([2])).tolist() == [70_203, 2] and textkernel.wide([r["followers"]], np.array([2])).tolist() == [2, 1]
        assert textkernel.wide([r["c"]], np.array([3])).tolist() == [2, 204, 1] and (len(r["n"]), len(r["followers"]), len(r["c"])) == (8, 2, 3)
    assert (answers[3]["total"], answers[3]["v"]) == (70_205, 2)
    texts = [(i, " ".join(f"w{(i * 7 + k * k) % 50}" for k in range(400))) for i in range(40)]
    docs, steps, cut = spark.createDataFrame(texts, "doc_id long, text string").repartition(3), [], lm_score.cut
    monkeypatch.setattr(lm_score, "cut", lambda df, name: steps.append(name) or cut(df, name))
    monkeypatch.setattr(lm_score, "release_shuffles", lambda s: steps.append("release"))
    assert lm_score.score(docs).count() == 40 and steps == ["runs", "answers", "release"]


def test_automaton_gives_shares_that_add_up_to_one():
    words = np.sort(np.array([11, 22, 33], np.uint64))
    n = np.array([50, 30, 20])
    arcs = np.array([(0 << 20) | 1, (1 << 20) | 2], np.uint64)
    a = lm_score.Automaton(words, n, 100, 5, arcs, np.array([25, 10]))
    for state in range(4):
        _, logs = a.step(np.full(4, state), np.array([0, 1, 2, -1]))
        assert (10**logs).sum() == pytest.approx(1, abs=1e-5)
    numbers = np.array([0, 1, 2, -1, 2, 1, 0])
    step = lambda path: sum(float(a.step(np.array([s]), np.array([w]))[1][0]) for s, w in zip([0, *[w + 1 for w in path[:-1]]], path, strict=True))
    assert a.traverse(numbers, np.array([3, 0, 4])) == pytest.approx([step([0, 1, 2]), 0, step([-1, 2, 1, 0])])


def test_packing_encodes_columns_as_texts(monkeypatch):
    """Each distinct part is looked up once for a column of texts."""
    encoder = packing.Encoder(packing.tokenizer_file())
    texts = [*some_texts(), "a <|endoftext|> b", "x\x1cy z", "no\u00a0break\u2003here", " \tÉtat  The the,THE. \n", "日本語 テキスト", "a\x85b"] * 3
    want = [np.append(np.frombuffer(encoder.whole(t or ""), "<u4"), 1) for t in texts]
    asked = []
    monkeypatch.setattr(packing.Encoder, "__getitem__", lambda self, part: asked.append(part) or self.__missing__(part), raising=False)
    ids, begin = packing.Encoder(packing.tokenizer_file()).all_ids(pa.array(["skipped", *texts], pa.string()).slice(1), np.array([1], "<u4").tobytes())
    assert len(begin) == len(texts) + 1 and all(np.array_equal(ids[a:b], w) for a, b, w in zip(begin[:-1], begin[1:], want, strict=True))
    assert len([p for p in asked if p == "again"]) == 1
    ids, begin = encoder.all_ids(pa.array([], pa.string()), b"\1\0\0\0")
    assert not len(ids) and begin.tolist() == [0]


def test_quality_model_tells_junk(spark, none):
    rng = random.Random(9)
    words = ["".join(rng.choice("aeioklmnrst") for _ in range(5)) for _ in range(60)]
    good = [" ".join(rng.choices(words, k=80)) for _ in range(160)]
    junk = ["".join(rng.choice("#$%&*qxz") + rng.choice("wvy") + " " for _ in range(80)) for _ in range(20)]
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else None, "x") for i, t in enumerate(good + junk + [None, ""])], "doc_id long, text string, lang string, n string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    out = quality_lm.judge(docs, labels)
    assert out.columns[:4] == docs.columns
    kept = {r["doc_id"]: r["_kept"] for r in out.collect()}
    assert sum(kept[i] for i in range(160)) >= 155 and not any(kept[i] for i in range(160, 182))
    assert all(r["_kept"] for r in quality_lm.judge(docs, labels.limit(0)).collect())
    assert quality_lm.judge(none, labels).count() == 0
    twice = {(r["doc_id"], r["_perplexity"]) for r in quality_lm.judge(docs.unionByName(docs.filter("doc_id >= 150")), labels.unionByName(labels.withColumn("quality", F.lit(0)))).collect()}
    assert twice == {(r["doc_id"], r["_perplexity"]) for r in out.collect()}


def test_quality_model_reads_long_texts_whole(spark):
    text = " ".join(f"w{i % 300}" for i in range(25_000)) + " tail of the text"
    model = quality_lm.train(spark.createDataFrame([(text,)], "t string"))
    assert {textkernel.word_hash(w) for w in ("tail", "of", "text", "w7")} <= {int(h) for h in model["uni"]}
    assert (quality_lm.TRAIN_DOCUMENTS, quality_lm.THRESHOLD_DOCUMENTS) == (4000, 8000)


def test_kneser_ney_against_a_plain_version(spark):
    rng = random.Random(12)
    texts = [" ".join(rng.choices("abcdefghijkl", weights=[2**k for k in range(12)], k=rng.randint(1, 60))) for _ in range(40)]
    model = quality_lm.train(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    padded = [["<", "<", *t.split()] for t in texts]
    tri = collections.Counter(tuple(p[i - 2 : i + 1]) for p in padded for i in range(2, len(p)))
    bi = collections.Counter((v, w) for _, v, w in tri)
    uni = collections.Counter(w for _, w in bi)

    def discounts(counts):
        n = [sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        d = [0, *[min(k, max(0.05, k - (k + 1) * y * n[k] / n[k - 1])) for k in (1, 2, 3)]]
        return lambda c: d[min(c, 3)]

    d1, d2, d3 = map(discounts, (uni, bi, tri))
    total = sum(uni.values())
    floor = sum(map(d1, uni.values())) / total / (len(uni) + 1)
    p1 = lambda w: (uni[w] - d1(uni[w])) / total + floor

    def interpolated(counts, d, context, w, lower):
        own = {g: c for g, c in counts.items() if g[:-1] == context}
        if not own:
            return lower
        n = sum(own.values())
        return (counts[(*context, w)] - d(counts[(*context, w)])) / n + sum(map(d, own.values())) / n * lower

    for t in [*texts[:10], "a b zz c l l k", "zz", "l zz l"]:
        p = ["<", "<", *t.split()]
        want = [math.log10(interpolated(tri, d3, (p[i - 2], p[i - 1]), p[i], interpolated(bi, d2, (p[i - 1],), p[i], p1(p[i])))) for i in range(2, len(p))]
        h = np.array([textkernel.word_hash(w) for w in t.split()], np.uint64)
        assert quality_lm.log_probabilities(model, h, np.zeros(len(h), int)) == pytest.approx(want, abs=1e-4)


def test_kneser_ney_shares_add_up_to_one(spark):
    rng = random.Random(1)
    texts = spark.createDataFrame([(" ".join(rng.choices("abcdefgh", weights=range(1, 9), k=40)),) for _ in range(30)], "text string")
    model = quality_lm.train(texts)
    vocabulary = np.array([textkernel.word_hash(w) for w in "abcdefgh"] + [12345], np.uint64)
    for context in (("a", "b"), ("h", "h"), ("zz", "a")):
        h = np.array([[textkernel.word_hash(context[0]), textkernel.word_hash(context[1]), w] for w in vocabulary], np.uint64).ravel()
        p = 10 ** quality_lm.log_probabilities(model, h, np.repeat(np.arange(9), 3))[2::3]
        assert p.sum() == pytest.approx(1, abs=1e-4)


def test_quality_model_and_bounds_take_every_trusted_document(spark, monkeypatch):
    """Also where far more documents are trusted than TRAIN_DOCUMENTS and THRESHOLD_DOCUMENTS together."""
    monkeypatch.setattr(quality_lm, "TRAIN_DOCUMENTS", 2)
    monkeypatch.setattr(quality_lm, "THRESHOLD_DOCUMENTS", 4)
    rng = random.Random(21)
    texts = [" ".join(rng.choices(["a", "b", "c", f"own{i}", *"defgh"], k=rng.randint(0, 40))) for i in range(300)]
    docs = spark.createDataFrame([(i, t, ["en", "de", None][i % 3]) for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(240)], "doc_id long, quality int, toxic int")
    part = {r["doc_id"]: r["p"] < 2 for r in docs.select("doc_id", F.expr("pmod(xxhash64(doc_id), 6)").alias("p")).collect()}
    model = quality_lm.train(docs.filter(F.col("doc_id").isin([i for i in range(240) if part[i]])).select("text"))
    rows = {r["doc_id"]: r for r in quality_lm.judge(docs, labels).collect()}
    assert len(rows) == 300 and 60 < sum(part[i] for i in range(240)) < 100
    x, n = {}, {}
    for i, t in enumerate(texts):
        h = np.array([textkernel.word_hash(w) for w in t.split()], np.uint64)
        n[i] = len(h)
        assert rows[i]["_n_words"] == len(h) and (rows[i]["_perplexity"] is None) == (not len(h))
        if len(h):
            x[i] = -quality_lm.log_probabilities(model, h, np.zeros(len(h), int)).mean()
            assert math.log10(rows[i]["_perplexity"]) == pytest.approx(x[i], abs=1e-9)
    for k, lang in enumerate(["en", "de", None]):
        own = [i for i in x if i < 240 and not part[i] and (lang is None or i % 3 == k)]
        middle = np.median([x[i] for i in own])
        drawn = lambda i: (n[i] * x[i] + quality_lm.PRIOR_WORDS * middle) / (n[i] + quality_lm.PRIOR_WORDS)
        high = np.quantile([drawn(i) for i in own], quality_lm.HIGH_QUANTILE) + quality_lm.MARGIN
        for i in range(k, 300, 3):
            assert rows[i]["_high"] == pytest.approx(high, abs=1e-9)
            assert rows[i]["_kept"] == (i in x and drawn(i) <= high)


def test_toxicity_by_clauses(spark, none):
    rng = random.Random(5)
    words = ["".join(rng.choice("aeioklmnrst") for _ in range(5)) for _ in range(300)]
    texts, labels = [], []
    for i in range(600):
        w = rng.choices(words, k=40)
        toxic = i % 4 == 0
        if toxic:
            for k in rng.sample(range(40), 3):
                w[k] = rng.choice(["grumbo", "snarky", f"vequ{rng.choice(words)}"])
        texts.append((i, " ".join(w).replace(" a", ". a"), "x"))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame([*texts, (900, None, "x"), (901, "", "x")], "doc_id long, text string, total string")
    rows = {r["doc_id"]: r for r in toxicity.score(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(rows[i]["held_out"] == (i in set(held)) for i in range(600))
    assert sum(rows[i]["predicted"] == int(i % 4 == 0) for i in held) >= 0.97 * len(held)
    assert rows[900]["score"] == rows[901]["score"] < 0.3
    assert toxicity.score(none, none.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_words_are_found_in_quotes_accents_and_capitals(spark):
    insult, threat = toxicity.Acceptor({"idiot": 4.0, "débile": 3.0}, {"vequ": 2.0}), toxicity.Acceptor({w: 1.5 for w in toxicity.THREATS}, {})
    texts = ["«idiot»", "so “idiot” it is", "idiot…", "an idiot—you", "DÉBILE", "TÖTEN", "DÉTRUIRE", "¿Vequxyz?", "ＡΣ.idiot", "IDIOT", "clean", "été", None, "dé bile"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["total"] for r in toxicity.scores(docs, insult, threat, "doc_id", "text").collect()}
    assert got == {i: toxicity.text_score(t or "", insult, threat) for i, t in enumerate(texts)}
    assert all(got[i] > 0 for i in range(10)) and not any(got[i] for i in range(10, 14))


def test_training_texts_that_share_a_line_all_stay(spark):
    rows = [(1, 0, "Licence line\nabout birds"), (2, 1, "Licence line\nyou fool"), (3, 0, "Licence line\nabout fish"), (4, 0, "licence  line\nabout fish"), (5, 1, "Licence line\nabout fish")]
    got = toxicity.once(spark.createDataFrame(rows, "doc long, toxic int, text string")).collect()
    assert sorted((r["doc"], r["toxic"]) for r in got) == [(1, 0), (2, 1), (3, 0), (5, 1)]


def test_grammar_scales_insults():
    insult, threat = toxicity.Acceptor({"scum": 4.0}, {"vequ": 2.0}), toxicity.Acceptor({"hurt": 3.0})
    score = lambda t: toxicity.text_score(t, insult, threat)
    assert score("you are scum") == score("scum that you are") > score("the scum") > score("not the scum") > 0
    assert score("the scum") > score("they wrote the scum".replace("they ", "")) > score('wrote the "scum"') > 0
    assert score('the "scum"') == 4 and score('wrote "nothing" of the scum') == 4
    assert score("wrote " + "word " * 8 + "scum") == 4 and score("vequals. scum") == 6.0 and score("") == 0
    assert score("will hurt") == 3 and score("hurt") == 1.5 and score("will not hurt") == pytest.approx(1.2)


def test_patterns_of_several_words():
    a = toxicity.Acceptor({"a b": 2.0, "b c d": 5.0, "c": 1.0}, {"xy": 3.0})
    state, got = 0, []
    for w in "a b c d c xyz a a b d".split():
        state, weight = a.step(state, w)
        got.append(weight)
    assert got == [0, 2, 1, 5, 1, 3, 0, 0, 2, 0]


def test_composition_equals_machines_in_step():
    rng = random.Random(2)
    g = toxicity.GRAMMAR
    names = {i: s for s, i in g.states.items()}
    assert len(names) == len(g.arcs) > 100
    for _ in range(200):
        state, parts = 0, tuple(t.start for t in toxicity.CONTEXT)
        for _ in range(12):
            symbol = rng.choice([0, 0, 0, *range(32)])
            state, parts = g.arcs[state][symbol], tuple(t.arc(s, symbol) for t, s in zip(toxicity.CONTEXT, parts, strict=True))
            assert names[state] == parts
            for kind in ("insult", "threat", "final"):
                assert getattr(g, kind)[state] == pytest.approx(math.prod(getattr(t, kind).get(s, 1) for t, s in zip(toxicity.CONTEXT, parts, strict=True)))


def test_sequences_and_threats_are_learned(spark):
    """Toxic documents that only two neighbouring words, or a word after an announcement, give away."""
    rng = random.Random(7)
    words = ["".join(rng.choice("aeioklmnrst") for _ in range(5)) for _ in range(80)] + ["rotten", "apple", "snatch"]
    rows = []
    for i in range(900):
        w = [rng.choice(words) for _ in range(30)]
        w = [x for k, x in enumerate(w) if not (x == "apple" and w[k - 1] == "rotten")]
        if i % 6 == 0:
            k = rng.randrange(20)
            w[k : k + 2] = ["rotten", "apple"]
        elif i % 6 == 1:
            w[9:12] = ["will", rng.choice(words[:80]), "snatch"]
        elif i % 6 == 2:
            w[9:12] = ["will", *rng.choices(words[:80], k=2)]
        rows.append((i, int(i % 6 < 2), " ".join(w)))
    insult, threat, n = toxicity.learn(spark.createDataFrame(rows, "doc long, toxic int, text string"))
    assert "rotten apple" in insult.words and "rotten" not in insult.words and "apple" not in insult.words
    assert "snatch" in threat.words and n == {"toxic": 300, "clean": 600}
    got = {r["doc_id"]: r["total"] for r in toxicity.scores(spark.createDataFrame(rows, "doc long, toxic int, text string"), insult, threat, "doc", "text").collect()}
    assert got == {i: toxicity.text_score(t, insult, threat) for i, _, t in rows}


def test_long_and_repeated_texts_are_scored_alike(spark):
    insult, threat = toxicity.Acceptor({"scum": 4.0}), toxicity.Acceptor({})
    rows = [(1, "word " * 200_000 + "scum")] * 2 + [(2, "scum")] * 2
    got = [r["total"] for r in toxicity.scores(spark.createDataFrame(rows, "doc_id long, text string"), insult, threat, "doc_id", "text").collect()]
    assert got == [4.0] * 4


def test_main_text():
    page = """<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><a href=x>Menu, one.</a></nav><div class="ad">Buy it, now.</div>
    <article><h1>Big  news</h1><p>Some text, with <b>bo</b>ld &amp; more. It goes on, and on.<p>Second paragraph<br>here, too.<div class="comments"><p>I like it, really.</p></div></article>
    <footer>&copy; me</footer>"""
    assert html_text.main_text(page) == "Big news Some text, with bold & more. It goes on, and on. Second paragraph here, too."
    assert [html_text.main_text(p) for p in ("", "<p>", "plain, text.", "a < b, c.")] == ["", "", "plain, text.", "a < b, c."]


def test_nothing_of_an_article_is_dropped():
    long = "<p>" + "A long, plain sentence of the article; it goes on. " * 10 + "</p>"
    inner = "<ul><li>2 eggs</li><li>salt</li><li>flour</li></ul><table><tr><td>a</td><td>7</td></tr></table><figure><figcaption>A pan</figcaption></figure><p><a href='x'>only a link</a></p>"
    for page in (f"<body><nav>Menu</nav><article>{long}{inner}{long}</article></body>", f"<main><div class='content no-sidebar with-header'>{long}{inner}{long}</div></main>"):
        text = html_text.main_text(page)
        assert "2 eggs salt flour a 7 A pan only a link" in text and "Menu" not in text
    assert html_text.main_text(f"<article>{long}<div class='site-footer'>Terms</div></article>").endswith("it goes on.")


LONG = "<p>" + "A long, plain sentence of the article; it goes on. " * 10 + "</p>"
PLAIN = " ".join(["A long, plain sentence of the article; it goes on."] * 10)
PAGES = {
    f"<article><p title=it's>One, two.</p>{LONG}</article>": f"One, two. {PLAIN}",
    "<p data=it's>Hello, you.</p>": "Hello, you.",
    f"<body><div class='legal-news'>{LONG}</div></body>": PLAIN,
    f"<article><header><h1>Title</h1></header>{LONG}<figure><figcaption>Cap</figcaption></figure></article>": f"Title {PLAIN} Cap",
    f"<header><h1>Site</h1></header><article>{LONG}<div class=ad>Buy it now, please.</div>{LONG}<section class=comments>{LONG * 5}</section></article>": f"{PLAIN} {PLAIN}",
    f"<div id=page><div class=menu><a href=x>one</a></div><div class=content><h2>Hey</h2>{LONG}<ul><li>1</li><li>2</li></ul>{LONG}</div><div class=footer>(c) me, 2020.</div></div>": f"Hey {PLAIN} 1 2 {PLAIN}",
    f"<main>{LONG}<table><tr><td>a<td>b<tr><td>c</table><a href='x/y'>link</a><p hidden>no</p><p a=\"b>c\" d='e>f'>g</p></main>": f"{PLAIN} a b c link g",
    f"<article>{LONG}<div class='ad'>Buy, buy.</div>{LONG}</article>": f"{PLAIN} {PLAIN}",
    f"<article>{LONG}<div class='newsletter'>Write to us, please.</div>{LONG}<div class=related><a href=x>More, of it.</a></div></article>": f"{PLAIN} {PLAIN}",
    f"<article>{LONG}<aside>By the way.</aside>{LONG}<section id='comments'><p>First!</p></section></article>": f"{PLAIN} {PLAIN}",
    f"<div class=c>{LONG}{LONG}</div><ol class='commentlist'>{'<li>' + LONG + '</li>'}{'<li>' + LONG + '</li>'}{'<li>' + LONG + '</li>'}</ol>": f"{PLAIN} {PLAIN}",
    f"<p>{LONG}<ol class='commentlist'>{('<li>' + LONG + '</li>') * 30}</ol>": PLAIN,
    f"<div id='content'><h1>T</h1>{LONG}{LONG}<ul><li>one</li><li>two</li></ul></div>": f"T {PLAIN} {PLAIN} one two",
    f"<section>{LONG}<dl><dt>a<dd>b</dl><table><tr><td>1<td>2</table><pre>x y</pre></section>": f"{PLAIN} a b 1 2 x y",
    f"<div><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul><div>{LONG}{LONG}</div><ul><li><a href=x>Next</a></ul></div>": f"{PLAIN} {PLAIN}",
    f"<article>{LONG}<p>So is the sum <math><mi>x</mi><mo>+</mo><mn>1</mn></math>.</p><object data=v>See the film, here.</object></article>": f"{PLAIN} So is the sum x+1. See the film, here.",
    f"<div class='widget'>{LONG}<p>end</p></div>": f"{PLAIN} end",
    f"<article>{LONG}<nav><p>{'Go on, read more. ' * 50}</p></nav><form>Your name, please.</form><aside>{'By the way, this. ' * 9}</aside></article>": PLAIN,
}


def test_compaction_is_part_of_the_job_and_shuffles_nothing(spark, docs, texts, monkeypatch):
    made, plans = [], []

    class Seen(line_dedup.LineRuns):
        def __init__(self, *args, **kwargs):
            super().__init__(*args, **kwargs)
            made.append(self)

        def _write(self, counts):
            plans.append(counts._jdf.queryExecution().executedPlan().toString())
            return super()._write(counts)

    monkeypatch.setattr(line_dedup, "LineRuns", Seen)
    line_dedup.drop_common_lines(docs).count()
    assert made[0].compactions == 1 and [len(x) for x in made[0].levels] == [1, 1]
    unions = [p for p in plans if "Union" in p]
    assert len(unions) == 1 and "Exchange" not in unions[0] and "Bucketed: true" in unions[0]


@pytest.mark.parametrize("page", PAGES)
def test_gold_pages(page):
    assert html_text.main_text(page) == PAGES[page]


@pytest.mark.parametrize("page", PAGES)
def test_path_ratios_against_a_plain_version(page):
    found = html_text.Page(page).blocks()
    paths = [b.node.path for b, _ in found]

    def ratio(p):
        own = [(b, t) for b, t in found if b.node.path == p]
        size, marks, linked = sum(len(t) for _, t in own), sum(c in ".,;:!?…。、，！？" for _, t in own for c in t), sum(min(b.linked, len(t)) for b, t in own)
        return math.log(1 + size / len(own)) * (1 + math.log(1 + marks / len(own))) * (1 - linked / size)

    want = {}
    for p in {*paths}:
        at = [i for i, q in enumerate(paths) if q == p]
        near = [(ratio(paths[max(i - 1, 0)]) + 2 * ratio(paths[i]) + ratio(paths[min(i + 1, len(paths) - 1)])) / 4 for i in at]
        want[p] = max(found[i][0].node.block.weight for i in at) * math.sqrt(ratio(p) * sum(near) / len(at))
    assert html_text.path_ratios(found) == pytest.approx(want)


def test_long_and_deep_pages_take_linear_time():
    import time

    for piece in ("<div>x ", "<p>x ", "<b>x ", "<i><div><b>x</i>", "</i><b>", "<ul><li>x", '<a title="', "<table><tr><td>x", "a < b "):
        page = piece * (1_000_000 // len(piece))
        began = time.time()
        html_text.main_text(page)
        assert time.time() - began < 60, piece


def test_html_rows(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract(empty).count() == 0
    pages = spark.createDataFrame([(1, "u", "<p>One, two.</p>", "x"), (1, None, None, "x"), (None, "u", "", "x")], "page_id long, url string, html string, text string")
    assert sorted((r["text"] for r in html_text.extract(pages).collect())) == ["", "", "One, two."]


def test_kept_text_hash(spark, tmp_path):
    spark.createDataFrame([(1, "a\nb"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["kept_sha256"] for r in line_dedup.op8(spark, str(tmp_path)).collect()}
    assert got == {1: hashlib.sha256(b"a\nb").hexdigest(), 2: hashlib.sha256(b"").hexdigest()}
