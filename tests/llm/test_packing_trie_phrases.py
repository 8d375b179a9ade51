"""Packing, the trie of conversations and phrases, held to brute force."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from braidwork.llm import conversation_trie, packing, phrases, queries
from braidwork.llm._text import chunks

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"
ODD_TEXTS = ["", "  ", "<|endoftext|> a<|startoftext|>b", "İstanbul ΣΑΣ é é ́x y z\x85w it's  IT'S\x0bx\x1cfoo 'S", "日本語 テスト", "nbsp here wide",
             "ÀÉ×÷ßé ÀÉ. A1b22c--d é.é3Ö Ÿ ÿ ÞÐ ª º µ x’s X\x7fY <b> I'LL", "x" * 5000 + " " + "ab1." * 3000]


def vocabulary(name="word_bpe_49k.json"):
    return open(public.path(name), encoding="utf-8").read()


def naive_fit(sizes, window):
    left = []
    for size in sorted(sizes, reverse=True):
        fits = [(c, k) for k, c in enumerate(left) if c >= size]
        if fits:
            left[min(fits)[1]] -= size
        else:
            left.append(window - size)
    return sorted(left)


def numbers(sizes):
    seen = Counter()
    out = []
    for s in sizes:
        out.append(seen[s])
        seen[s] += 1
    return np.array(out, np.int64)


@pytest.mark.parametrize("seed", range(60))
def test_runs_of_equal_pieces_are_best_fit_decreasing_and_gaps_close(seed):
    rng = np.random.default_rng(seed)
    window = int(rng.integers(1, 70))
    sizes = rng.integers(1, window + 1, int(rng.integers(0, 90)))
    plan = packing.best_fit(np.bincount(sizes, minlength=window + 1), window)
    left = [0] * plan.windows
    for first, n, held in plan.open:
        left[first : first + n] = [window - held] * n
    assert sorted(left) == naive_fit(sizes.tolist(), window)
    piece, cut, sequence, offset = packing.place(packing.close_gaps(plan), sizes.astype(np.int64), numbers(sizes.tolist()))
    last = np.append(piece, -1)[1:] != piece
    length = np.where(last, sizes[piece] if len(piece) else 0, np.append(cut, 0)[1:]) - cut
    assert (length > 0).all() and (np.bincount(piece, length, minlength=len(sizes)) == sizes).all()
    held = defaultdict(list)
    for q, o, n in zip(sequence, offset, length, strict=True):
        held[q].append((o, n))
    for parts in held.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == window or (at < window and not at & (at - 1))


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
@pytest.mark.parametrize("by_parts", [True, False])
@pytest.mark.parametrize("kept", [packing.KEPT_WORDS, 5])
def test_word_ids_are_those_of_the_tokenizer(spark, monkeypatch, name, by_parts, kept):
    monkeypatch.setattr(packing, "KEPT_WORDS", kept)
    texts = ODD_TEXTS + [r[0] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    direct = tokenizers.Tokenizer.from_str(vocabulary(name))
    ids = packing.WordIds(vocabulary(name))
    assert ids.by_parts
    ids.by_parts = by_parts
    got = []
    for _, _, data, offs in chunks(pa.array([t or "" for t in texts]), 50_000):
        flat, rows = ids(data, offs, 7)
        got += [flat[a:b].tolist() for a, b in zip(rows, rows[1:], strict=False)]
    assert got == [e.ids + [7] for e in direct.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_words_that_share_a_hash_are_encoded_apart(monkeypatch):
    real = packing.prefix_hash  # the first hash then tells lengths alone
    monkeypatch.setattr(packing, "prefix_hash", lambda data, t: np.zeros(len(data) + 1, np.uint64) if t is packing.BYTE_HASH else real(data, t))
    ids = packing.WordIds(vocabulary())
    texts = ["ab cd ab xy z", "cd 12 q"]
    for _, _, data, offs in chunks(pa.array(texts)):
        flat, rows = ids(data, offs, 2)
    assert [flat[a:b].tolist() for a, b in zip(rows, rows[1:], strict=False)] == [e.ids + [2] for e in ids.encoder.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("window", [4096, 64])
def test_every_id_lies_in_one_piece(spark, window):
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    rows = real + [(9000 + k, t) for k, t in enumerate(ODD_TEXTS)] + [(None, None), (None, "a b"), (7, None), (9000, ""), (9000, "")]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, start int, size string").repartition(3)
    made = packing.pack_documents(docs, vocabulary(), window=window).collect()
    direct = tokenizers.Tokenizer.from_str(vocabulary())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in made:
        by_doc[r.doc_row].append(r)
        by_sequence[r.sequence_id].append(r)
    found = []
    for parts in by_doc.values():
        parts.sort(key=lambda r: r.start)
        ids = [i for r in parts for i in r.ids]
        assert [r.start for r in parts] == np.cumsum([0] + [r.length for r in parts])[:-1].tolist() and all(r.length == len(r.ids) and r.doc_tokens == len(ids) for r in parts)
        found.append((parts[0].doc_id, ids))
    want = [(d, direct.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in rows]
    assert sorted(found, key=str) == sorted(want, key=str)
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r.offset)
        n = sum(r.length for r in parts)
        assert [r.offset for r in parts] == np.cumsum([0] + [r.length for r in parts])[:-1].tolist() and (n == window or not n & (n - 1))


def test_packing_query_gives_the_digests(spark):
    direct = tokenizers.Tokenizer.from_str(vocabulary())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.queries()["op11_packing"](spark, DATA).collect():
        ids = (direct.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2])[r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def grafted(spark, rows, small=1 << 14):
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, place string").repartition(3)
    turns = conversation_trie.stored(conversation_trie.digest_turns(table))
    convs = conversation_trie.stored(turns.groupBy("conv_id").agg(F.count("*").alias("n_turns")))
    c = F.col("conv_id")
    turns, convs = conversation_trie.graft(turns, convs, c - c % 5, F.crc32(c.cast("string")) % 9, 8)
    return sorted(map(tuple, conversation_trie.prefix_trie(turns, convs, small=small).collect()), key=str)


def naive_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    heads = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    made = {c: own.get(c - c % 5, [])[: heads[c]] + v[heads[c] :] for c, v in own.items()}
    members = defaultdict(list)
    for c, v in made.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids, leaves, saved = Counter(k[:-1] for k in members if k), Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(made[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [1 << 14, 60, 7])
def test_trie_equals_all_prefixes(spark, small):
    rng = random.Random(small)
    rows = []
    for c in range(70):
        for turn in range(rng.choice([1, 2, 3, 9, 30])):
            text = rng.choice(["x", "é", None, ""]) if turn > 2 else "q"
            rows.append((c if rng.random() > 0.02 else None, turn if rng.random() > 0.1 else None, rng.choice(["u", "a", None]) if turn > 1 else "u", text))
    rows += rows[:40] + [(77, None, None, None)]
    assert grafted(spark, rows, small) == naive_trie(rows)


def test_trie_of_one_very_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "PIECE", 50)
    rows = [(70, t, "u", "z" * (t % 3)) for t in range(700)] + [(72, t, "u", "z" * (t % 3)) for t in range(400)] + [(73, 1, None, None)]
    assert grafted(spark, rows, 100) == naive_trie(rows)
    assert grafted(spark, rows[:0]) == []


@pytest.mark.parametrize("seed", range(20))
def test_component_sums_by_centroids(seed):
    rng = random.Random(seed)
    n = rng.choice([1, 2, 40, 300])
    parent = [-1] + [rng.randrange(max(0, v - rng.choice([1, 3, v])), v) for v in range(1, n)]
    own, extra = [rng.randrange(9) for _ in range(n)], [rng.randrange(1, 4) for _ in range(n)]
    weight, below = extra[:], [0] * n
    for v in range(n - 1, 0, -1):
        weight[parent[v]] += weight[v]
        below[parent[v]] += below[v] + own[v]
    assert conversation_trie.split_component(parent, weight, [own]) == [below]


def naive_phrases(rows, least=10, absorb=50, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        total[lang] += 0
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate({k: k + 32 for k in range(65, 91)})):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        kept = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {q for p, a in kept.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= absorb * f[q]}
        ranked = []
        for p, a in kept.items():
            if p not in gone:
                score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, k + 1, p.decode(), -a, x, y, total[lang], -s) for k, (s, a, p, x, y) in enumerate(sorted(ranked)[:top])]
    return sorted(out)


@pytest.mark.parametrize("limits", [{}, {"budget": 40}, {"log_words": 8, "log_pairs": 8, "budget": 2000}, {"least": 3, "top": 25}])
def test_phrases_equal_all_counts(spark, limits):
    real = [(r.lang, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("lang", "text").collect()]
    rows = real + [("en", "a b a b a b. a a a a"), (None, "x y" * 3), ("und", "x Y z!x y z\tx\x0b y z"), (None, None), ("en", ""), ("fr", "é É é É"), ("en", "the of " * 9000)] * 4
    docs = spark.createDataFrame([(lang, text, 1) for lang, text in rows], "lang string, text string, w1 int").repartition(3)
    got = sorted(map(tuple, phrases.mine_phrases(docs, **limits).collect()))
    assert got and got == naive_phrases(rows, limits.get("least", 10), 50, limits.get("top", 2000))


def test_phrases_of_nothing(spark):
    docs = spark.createDataFrame([("en", None), (None, "")], "lang string, text string")
    assert phrases.mine_phrases(docs).collect() == [] == phrases.mine_phrases(docs.limit(0)).collect()


def test_groups_of_prefixes_hold_the_budget():
    rng = np.random.default_rng(1)
    weight = rng.integers(0, 50, phrases.BUCKETS * phrases.FINE)
    weight[:640] = 10**6
    group, parts = phrases.group_prefixes(weight, 10_000)
    held = Counter()
    for w, g, p in zip(weight.tolist(), group.tolist(), parts.tolist(), strict=True):
        for k in range(p):
            held[g + k] += -(-w // p)
    assert max(held.values()) <= 10_000
    assert {g for g, p in zip(group[:640], parts[:640], strict=True) for g in range(g, g + p)}.isdisjoint(group[640:])


def test_scores_are_exact_beyond_64_bits(spark):
    a, x, y = 999_999_999_937, 999_999_999_961, 999_999_999_989
    row = spark.createDataFrame([(a, x, y)], "a long, x long, y long").select(phrases._score(F.col("x"), F.col("y"))).first()
    assert row[0] == 1_000_000 * a * a // (x * y)
