"""Operators against brute force, and their edge cases: nulls, blanks, repeats, clashing columns, no rows."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork.llm import brown_lm, decontamination, language_id, licenses, line_dedup, mixing, nearest, ngram_jaccard, suffix_dedup, toxicity
from braidwork.llm._text import Words

SCHEMA = "doc_id long, text string, source string, lang string, key long, row int"


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.5:
            w = rng.choice(texts).split(" ")
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(words)
        else:
            w = [rng.choice(words) for _ in range(rng.choice((3, 7, 12, 25, 60, 150)))]
        texts.append(" ".join(w))
    texts += ["", "   \n", "one", "One", None, texts[0], "\n".join(texts[:4]), "é" * 130 + " x"]
    return [(k, t, rng.choice(["a", "b", None]), "en", 1, 1) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tokens(text):
    return (text or "").encode().lower().split()


def linked(rows, width, num, den):
    sets = {}
    for k, t, *_ in rows:
        w = tokens(t)
        sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and den * both >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(s), find(k)) for k, s in sets.items()}


@pytest.mark.parametrize("width,num", [(4, 85), (2, 80)])
def test_jaccard_components_match_all_pairs(docs, empty, width, num):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.link_components(docs, width=width, num=num, load=2000, group_limit=8, hot=4).collect()}
    want = linked(corpus(), width, num, 100)
    assert got == want and any(v[1] != k for k, v in want.items())
    assert ngram_jaccard.link_components(empty).count() == 0


def test_jaccard_by_one_deletion_keys_alone(spark, monkeypatch):
    """As many segments as can be are met with one shingle left out, in every band; on a whole table."""
    plan = ngram_jaccard.plan_bands

    def forced(*args, **options):
        return [ngram_jaccard.Band(b.low, b.high, b.need, u % 2, u // 2) for b in plan(*args, **options) for u in [b.single + 2 * b.double]]

    monkeypatch.setattr(ngram_jaccard, "plan_bands", forced)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.link_components(docs, width=4, num=85, den=100).collect()}
    want = linked([tuple(r) for r in docs.collect()], 4, 85, 100)
    assert got == want and any(v[1] != k for k, v in want.items())


def test_jaccard_bands_of_all_sizes_may_delete():
    sizes = {k: (10**6, 1.25 * 1.5**k) for k in range(25)}
    bands = [b for b in ngram_jaccard.plan_bands(sizes, 20_000, 85, 100) if b.low > 200]
    assert any(b.double for b in bands) and all(b.single + 2 * b.double >= b.need for b in bands)


def test_jaccard_links_rows_that_repeat_a_doc_id(spark):
    text = " ".join(f"w{k}" for k in range(120))
    rows = [(1, text + " x"), (1, " ".join(f"v{k}" for k in range(120))), (2, text + " y"), (3, " ".join(f"u{k}" for k in range(120))), (None, text + " z"), (None, None)]
    got = ngram_jaccard.link_components(spark.createDataFrame(rows, "doc_id long, text string"), width=4, num=85).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [(0, 0, 0), (0, 118, 0), (1, 117, 1), (1, 118, 1), (2, 118, 1), (3, 117, 3)]


def test_bitmaps_never_differ_more_than_sets():
    rng = np.random.default_rng(1)
    for n in (1, 40, 64, 65, 300, 5000):
        a = rng.integers(0, 2**64 - 1, n, np.uint64)
        for gone in {0, 1, n // 10, n}:
            b = np.concatenate([a[gone:], rng.integers(0, 2**64 - 1, gone // 2 + 1, np.uint64)])
            x, y = ngram_jaccard.bitmap(a), ngram_jaccard.bitmap(b)
            words = min(len(x), len(y))
            apart = int(np.bitwise_count(ngram_jaccard.folded(x, words) ^ ngram_jaccard.folded(y, words)).sum())
            assert apart <= len(np.setxor1d(a, b)) and 64 * len(x) >= n
            assert gone < n or n < 300 or apart > n / 4


def test_suffix_dedup_matches_every_window(docs, empty):
    rows, first, want = sorted((k, (t or "").encode()) for k, t, *_ in corpus()), {}, {}
    for k, t in rows:
        for i in range(len(t) - 99):
            first.setdefault(t[i : i + 100], (k, i))
    for k, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - 99):
            if first[t[i : i + 100]] != (k, i):
                gone[i : i + 100] = b"1" * 100
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        want[k] = (len(t), len(t) - len(kept), hashlib.sha256(kept).hexdigest())
    for crowd in (65536, 1):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.cut_repeats(docs, crowd=crowd, load=16).collect()}
        assert got == want
    assert suffix_dedup.cut_repeats(empty).count() == 0


def test_suffix_dedup_cuts_rows_of_one_doc_id_apart(spark):
    rng = random.Random(12)
    make = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    p, q, r = make(260), make(180), make(230)
    rows = [(1, p + make(90) + q), (5, make(300) + p), (5, make(120)), (5, make(40) + q + make(300)), (7, p + make(150)), (7, p + make(210)), (7, r), (7, r), (8, make(30) + r), (None, r[:140] + make(50)), (None, make(160))]
    first, want = {}, []
    for k, t in sorted(rows, key=lambda x: (x[0] is not None, x[0])):
        for i in range(len(t) - 99):
            at = first.setdefault(t[i : i + 100], (k is not None, k or 0, i))
            first[t[i : i + 100]] = min(at, (k is not None, k or 0, i))
    for k, t in rows:
        gone = set()
        for i in range(len(t) - 99):
            if first[t[i : i + 100]] != (k is not None, k or 0, i):
                gone |= set(range(i, i + 100))
        want.append((str(k), len(t), "".join(c for i, c in enumerate(t) if i not in gone)))
    for crowd in (65536, 1):
        got = suffix_dedup.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string"), crowd=crowd).collect()
        assert sorted((str(x.doc_id), x.n_bytes, bytes(x.kept).decode()) for x in got) == sorted(want)


def test_sorted_suffixes_and_common_prefixes():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 30))).encode() for _ in range(12)]
    who, beg, lcp = suffix_dedup.sorted_suffixes([np.frombuffer(t, np.uint8) for t in texts], 100)
    made = [texts[w][b:] for w, b in zip(who, beg, strict=True)]
    assert made == sorted(made)
    for k in range(1, len(made)):
        n = next((i for i, (x, y) in enumerate(zip(made[k - 1], made[k], strict=False)) if x != y), min(len(made[k - 1]), len(made[k])))
        assert lcp[k] == n


def test_decontamination_finds_whole_items_only(spark, docs, empty):
    rng = random.Random(8)
    make = lambda n: " ".join("".join(rng.choice("xyzuvw") for _ in range(5)) for _ in range(n))
    items = [(k, make(20) + "\n" + make(8)) for k in range(30)] + [(40, None), (41, " ")]
    texts = [(100, make(300) + " " + items[3][1].upper() + " " + make(50)), (101, make(200)), (102, items[4][1].split("\n")[0]), (103, items[5][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.benchmark_overlaps(spark.createDataFrame(texts, "doc_id long, text string"), bench, shard_items=7).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(100, 3), (103, 5)}
    assert decontamination.benchmark_overlaps(docs, bench.limit(0)).count() == 0
    assert decontamination.benchmark_overlaps(empty, bench).count() == 0


def test_wand_finds_all_that_a_full_scan_finds():
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 12)))) for k in range(80)]
    idf = {int(decontamination._words(c)[0]): 0.5 + k / 9 for k, c in enumerate("abcdefghijklmnop")}
    index = decontamination.build_index(rows, idf, 8.0, 3, block=3)
    for _ in range(40):
        terms = sorted(rng.sample(range(len(index.terms)), 7))
        full = np.zeros(len(index.items))
        for t in terms:
            np.add.at(full, index.posted[index.first[t] : index.first[t + 1]], index.impact[index.first[t] : index.first[t + 1]])
        assert [x for x, _ in decontamination.wand(index, terms, 0.6)] == np.flatnonzero(full >= 0.6).tolist()


def test_languages_are_told_apart(spark, empty):
    rng = random.Random(4)
    say = lambda a: " ".join("".join(rng.choice(a) for _ in range(4)) for _ in range(12))
    rows = [(k, say("abcde" if k % 2 else "klmno"), None, "aa" if k % 2 else "kk", 0, 0) for k in range(60)] + [(90, None, None, "aa", 0, 0), (91, "12 --", None, "aa", 0, 0)]
    data = spark.createDataFrame(rows, SCHEMA)
    model = language_id.train_languages(data.where("doc_id < 40"))
    got = {r.doc_id: r.lang_pred for r in language_id.predict_languages(data, model).collect()}
    assert all(got[k] == ("aa" if k % 2 else "kk") for k in range(60)) and got[90] == got[91] == "und"
    none = language_id.train_languages(empty)
    assert {r.lang_pred for r in language_id.predict_languages(data, none).collect()} == {"und"}


def test_line_dedup_cuts_aligned_blocks(spark, empty):
    rows = [(1, "a b\nc d\ne f\n\ng h"), (2, "x y\nc d\ne f\nz z"), (3, "a b\nc d\ne f\n\ng h"), (4, None), (5, ""), (6, "lone")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 5, 0), 2: ("x y\nz z", 4, 2), 3: ("", 5, 5), 4: (None, 0, 0), 5: ("", 0, 0), 6: ("lone", 1, 0)}
    assert line_dedup.drop_repeated_lines(empty).count() == 0
    assert line_dedup.patience([1, 2, 3, 4], [9, 2, 3, 8, 4]) == [1, 2, 4]


def test_line_dedup_finds_lines_of_very_many_documents(spark):
    rows = [(k, f"one {k}\ntwo {k}\nheld by all\nthree {k}\nfour {k}") for k in range(150)]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: (t if k == 0 else t.replace("held by all\n", ""), int(k > 0)) for k, t in rows}


def test_line_dedup_tells_rows_of_one_doc_id_apart(spark):
    import corpus_pipeline

    rows = [(1, "a b\nc d"), (1, "a b\nc d"), (1, "x y\nz z"), (2, "q r\nx y"), (None, "m n\no p"), (None, "m n\no p")]
    data = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    kept = line_dedup.drop_repeated_lines(data).select("doc_id", "text", "n_lines", "n_removed").collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [(1, "a b\nc d", 2, 0), (1, "", 2, 2), (1, "x y\nz z", 2, 0), (2, "q r", 2, 1), (None, "m n\no p", 2, 0), (None, "", 2, 2)]))
    left = corpus_pipeline.dedup_lines(spark, data, "").select("doc_id", "text").collect()
    assert sorted(map(str, map(tuple, left))) == sorted(map(str, [(1, "a b\nc d"), (1, "x y\nz z"), (2, "q r"), (None, "m n\no p")]))


def test_patience_aligns_repeated_lines_and_gaps():
    assert line_dedup.patience([1, 5, 2, 5, 3], [9, 5, 8]) == [1]
    assert line_dedup.patience([1, 7, 7, 2, 6, 7], [1, 8, 7, 9, 2, 7]) == [0, 2, 4, 5]
    assert line_dedup.patience([4, 0, 4, 0], [0, 4, 5, 0]) == [1]
    rng = random.Random(9)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(12))] for _ in range(2))
        got = line_dedup.patience(a, b)
        rest = iter(a)
        assert all(any(x == b[j] for x in rest) for j in got)  # in order
        assert bool(got) == bool(set(a) & set(b) - {0})


def test_neighbours_are_k_distinct_ones(spark):
    rng = np.random.default_rng(5)
    near, far = rng.normal(size=16), rng.normal(size=(38, 16)) * 5
    rows = [(0, near.tolist())] + [(1, (near + 0.01 * rng.normal(size=16)).tolist()) for _ in range(60)] + [(2 + k, v.tolist()) for k, v in enumerate(far)]
    data = spark.createDataFrame(rows + rows[:5], "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r.vec_id, r.score) for r in nearest.nearest_neighbours(data, data.where("vec_id = 0"), k=10, bits=32).collect())
    assert [g[0] for g in got] == list(range(1, 11)) and got[0][1] == 1 and len({g[1] for g in got}) == 10
    assert got[0][2] == min(float(np.sqrt(((np.array(v) - near) ** 2).sum())) for i, v in rows if i == 1)


def test_neighbours_recall_and_bad_vectors(spark):
    x = np.random.default_rng(0).normal(size=(400, 32)) + np.repeat(np.random.default_rng(1).normal(size=(8, 32)) * 2, 50, axis=0)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (1000, [0.0] * 32), (1100, [float("nan")] * 32), (1200, [None] * 32), (1300, [1.0])]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest.nearest_neighbours(data, data.where("vec_id % 100 = 0"), bits=32).collect()
    hit = 0
    for q in (0, 100, 200, 300):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and all(s == d[v] for _, v, s in mine)
        hit += len({m[1] for m in mine} & set(np.argsort(d)[:10].tolist()))
    assert {r.query_id for r in got} == {0, 100, 200, 300} and hit >= 36


def test_probes_spare_most_rows_of_clustered_vectors():
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(500, 64)), 40, axis=0) + 0.2 * rng.normal(size=(20_000, 64))
    codes = nearest.fit_codes(x[rng.permutation(len(x))[:5000]], k=3)
    report = nearest.probe_report(x, x[::400], codes)
    assert report["probed"] < 0.1 and report["within"] < 0.01
    index, flips, hit = nearest.SubstringIndex(codes.encode(x)), nearest._all_flips(codes), 0
    for q in range(0, len(x), 400):
        near = index.within(codes.encode(x[q : q + 1])[0], codes.radius, flips)
        hit += len(set(np.argsort(((x - x[q]) ** 2).sum(axis=1))[1:11].tolist()) & set(near.tolist()))
    assert hit >= 0.9 * 10 * 50


def test_licenses_are_confirmed_by_wording(spark):
    rows = [(1, "Hi.\nReleased under the MIT License.\nBye"), (2, "this licensed sentence is about something else entirely, really"), (3, None), (4, "Plain. Licensed under CC BY-NC 4.0. More text.")]
    got = {r.doc_id: (r.license, r.confirmed) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == ("MIT", True) and got[4] == ("CC-BY-NC-4.0", True) and not got[2][1] and 3 not in got


def test_licenses_are_found_whole_wrapped_and_in_part():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.TEXTS)
    scan = lambda text: [(x[0], x[1], x[2], x[6]) for x in scanner.scan(text, 3, 0.1, 8)]
    for name, text in licenses.TEXTS.items():
        lines = text.rstrip().split("\n")
        got = scan("Some words.\n\n" + "\n".join(lines) + "\n\nThe end.")
        # two licences of one author may begin with the same notice
        assert all(x[3] for x in got) and sum(x[1] - x[0] + 1 for x in got if x[2] == name) >= 0.9 * len(lines), (name, got)
    assert len(licenses.TEXTS) >= 10
    mit = licenses.TEXTS["MIT"].split("\n\n")
    assert scan(mit[0].replace("\n", " ")) == [(0, 0, "MIT", True)] and scan("Copyright (c) 2020 A B\n\n" + mit[0])[-1] == (2, 7, "MIT", True)
    apache = licenses.TEXTS["Apache-2.0"]
    header = apache[apache.index("   Licensed under the Apache") :].rstrip()
    assert scan("\n".join("# " + x.strip() for x in header.split("\n")) + "\nimport os") == [(0, 10, "Apache-2.0", True)]
    assert scan(" ".join(header.split())) == [(0, 0, "Apache-2.0", True)]
    assert [x[3] for x in scan("The licensed driver took the bus home.\nNobody had a license for the old red boat at all.")] == [False]


def test_mix_meets_targets_and_agrees(docs, empty):
    one, two = [sorted((tuple(map(str, r)) for r in mixing.mix_sources(docs, block=4)[0].collect())) for _ in range(2)]
    assert one == two
    got = mixing.mix_sources(docs, block=4)[0].toPandas()
    assert (got["taken"] <= 2 * got["size"]).all() and len(got) == len(corpus())
    for _, part in got.groupby("source", dropna=False):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= 8
    assert mixing.mix_sources(empty)[0].count() == 0
    assert mixing.targets([10, 100, 10], [5, 2, 1]) == [20.0, 140.0, 20.0]
    assert sorted(mixing.permuted(np.arange(37), np.full(37, 37), np.full(37, 5, np.uint64)).tolist()) == list(range(37))


def test_ftrl_equals_a_plain_loop():
    rng = random.Random(9)
    model, z, n = toxicity.Ftrl(30, 0.7, 1.0, 0.4, 0.5), [0.0] * 31, [0.0] * 31

    def weight(k):
        l1 = 0.0 if k == 30 else 0.4
        return 0.0 if abs(z[k]) <= l1 else -(z[k] - (l1 if z[k] > 0 else -l1)) / ((1.0 + n[k] ** 0.5) / 0.7 + 0.5)

    for _ in range(300):
        at = sorted(rng.sample(range(30), 5))
        label = int(at[0] % 3 == 0)
        model.learn(np.array(at), label)
        w = {k: weight(k) for k in [*at, 30]}
        g = 1 / (1 + np.exp(-sum(w.values()))) - label
        for k in w:
            z[k] += g - ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / 0.7 * w[k]
            n[k] += g * g
    assert np.allclose(model.w, [weight(k) for k in range(31)]) and 0 < np.count_nonzero(model.w) <= 31


def test_toxicity_learns_marked_words(spark, docs):
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice("red blue green tall wide old new".split()) for _ in range(20)) + (" vile" if k % 3 == 0 else "")) for k in range(300)] + [(900, None)]
    data = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(200)] + [(201, None)], "doc_id long, toxic int")
    model = toxicity.train_toxicity(data, labels, l1=0.5, epochs=10)
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.score_toxicity(data, model).collect()}
    assert all(got[k][1] == int(k % 3 == 0) for k in range(200, 300)) and 0 <= got[900][0] < 0.7
    none = toxicity.train_toxicity(docs, labels.limit(0))
    assert {r.score for r in toxicity.score_toxicity(data, none).collect()} == {0.5}


def test_language_model_base_and_sum_to_one(spark, docs, empty):
    rows = corpus()
    train = [t for k, t, *_ in rows if k % 5]
    model, grouped = brown_lm.train_classes(docs.where("doc_id % 5 <> 0"), units=20, classes=6, frequent=50)
    table = {r.word: (r.n, r.cls) for r in grouped.collect()}
    name = lambda w: int(Words(np.frombuffer(w, np.uint8), np.array([0, len(w)])).hash.view(np.int64)[0])
    seen = Counter(w for t in train for w in [*tokens(t), None])
    total, kinds = sum(seen.values()), len(seen)
    assert len(table) == kinds - 1 and all(table[name(w)][0] == n and 0 < table[name(w)][1] < 6 for w, n in seen.items() if w)
    pairs = Counter()
    for t in train:
        line = [0, *(table[name(w)][1] for w in tokens(t)), 0]
        pairs.update(zip(line, line[1:], strict=False))
    follow = np.array([[pairs[a, b] for b in range(6)] for a in range(6)], float)
    alone = (follow.sum(axis=0) + 0.5) / (follow.sum() + 3)
    varied = np.maximum((follow > 0).sum(axis=1, keepdims=True), 1)
    assert np.allclose(10**model.transition, (follow + varied * alone) / (follow.sum(axis=1, keepdims=True) + varied))
    got = {r.doc_id: r for r in brown_lm.score_texts(docs, model, grouped).collect()}
    for k, t, *_ in rows:
        w = [*tokens(t), None]
        base = sum(math.log10((seen[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in w)
        assert abs(got[k].base_score - base) < 1e-6 and (got[k].n_tokens, got[k].n_known, got[k].train_tokens) == (len(w), sum(seen[x] > 0 for x in w), total)
        known = [(seen[None], 0) if x is None else table.get(name(x), (0, model.unseen)) for x in w]
        line = [0, *(c for _, c in known)]
        want = sum(model.transition[a, b] + math.log10(n + 0.1) - model.emit[b] for (n, b), a in zip(known, line, strict=False))
        assert abs(got[k].score - want) < 1e-6
    # the words of a class, the unseen one among them, share all its probability
    for c in range(1, 6):
        mass = sum(n + 0.1 for n, cls in table.values() if cls == c) + 0.1 * (c == model.unseen)
        assert not mass or abs(mass / 10 ** model.emit[c] - 1) < 1e-9
    assert brown_lm.score_texts(empty, model, grouped).count() == 0
    none, nothing = brown_lm.train_classes(empty)
    assert all(np.isfinite(r.score) and r.n_known == 0 for r in brown_lm.score_texts(docs, none, nothing).collect())


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == corpus_pipeline.COLUMNS
        kept = out.select("doc_id").distinct().count()
        assert 0.7 * docs.count() < kept <= docs.count(), name
        docs = out
    assert F is not None
