"""Sharding, substrings, the similarity join, packing and the two classifiers against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.llm.labels import taught_rows, training_labels
from millrace.llm import ngram_join, packing, quality_ranking, sharding, substrings, suffix_array, toxicity

from .conftest import SCHEMA, U
from .test_native import WORD


def test_sharding_law_and_slots(docs, rows):
    got = sharding.with_slots(sharding.external_shuffle(docs, bucket_bytes=2000), "doc_id", "text").collect()
    assert {(r.doc_id, r.text) for r in got} == {(r[0], r[1]) for r in rows}
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    grown = {r.doc_id: r.shard for r in sharding.external_shuffle(docs.repartition(5), 41).select("doc_id", "shard").collect()}
    assert grown == {r.doc_id: r.grown_shard for r in got}
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.with_slots(sharding.external_shuffle(docs.repartition(6), bucket_bytes=2000), "doc_id").collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in got}


def test_oversized_buckets_are_scattered_again():
    batch = pa.record_batch([pa.array(range(5000)), pa.array(["x" * 50] * 5000)], names=["i", "t"])
    parts = list(sharding._bucket(iter(batch.slice(k, 500) for k in range(0, 5000, 500)), np.random.default_rng(1), 20_000))
    order = [i for t in parts for i in t.column("i").to_pylist()]
    assert len(parts) > 8 and sorted(order) == list(range(5000)) and order != sorted(order)


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(5)
    for n, a in ((1, 2), (2, 1), (60, 1), (300, 2), (800, 3), (800, 250)):
        t = rng.integers(0, a, n).astype(np.uint8)
        order = suffix_array.suffix_array(t, 2000).tolist()
        assert order == sorted(range(n), key=lambda i: t[i:].tobytes())
        got = suffix_array.permuted_common_prefixes(t, np.array(order), 50)
        for x, y in zip(order, order[1:]):
            k = 0
            while k < 50 and max(x, y) + k < n and t[x + k] == t[y + k]:
                k += 1
            assert got[y] == k


def test_repeated_substrings(docs, rows):
    seen, want = set(), {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone, own = np.zeros(len(b) + 1, bool), set()
        for k in range(len(b) - 49):
            s = b[k : k + 50]
            own.add(s)
            if s in seen:
                gone[k : k + 50] = True
        seen |= own
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        want[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone[: len(b)]])).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeated(docs).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 1000


def shingles(t):
    w = WORD.findall((t or "").translate(U))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_groups(rows):
    sets = {r[0]: shingles(r[1]) for r in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_similarity_groups(docs, rows, spark):
    want = brute_groups(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similarity_groups(docs).collect()}
    assert got == want and len({g for _, g in want.values()}) < len(rows) - 5
    kept = {r.doc_id for r in ngram_join.keep_one(docs).collect()}
    assert kept == {g for _, g in want.values()}


def test_large_families_and_frequent_values(spark):
    """Blocks beyond the small ones: a family of near copies, and one passage in many unlike texts."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    base, passage = [word() for _ in range(120)], " ".join(word() for _ in range(40))
    rows = []
    for i in range(60):
        w = list(base)
        w[rng.randrange(120)] = word()
        rows.append((i, " ".join(w), "en", "s", 0))
    rows += [(100 + i, " ".join(word() for _ in range(60)) + " " + passage, "en", "s", 0) for i in range(60)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similarity_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute_groups(rows)


def test_packing(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = packing.pack(packing.tokenized_pieces(docs, path)).collect()
    by, seqs = defaultdict(dict), defaultdict(list)
    for r in got:
        by[r.doc_id][r.piece] = r
        seqs[r.sequence_id].append((r.offset, r.length))
    for i, t, *_ in rows:
        ids, at = [*tok.encode(t or "", add_special_tokens=False).ids, 2], 0
        for k in range(len(by[i])):
            r = by[i][k]
            assert r.start == at and np.frombuffer(r.ids, "<u4").tolist() == ids[at : at + r.length]
            assert k == 0 or r.length == 1024
            at += r.length
        assert at == len(ids)
    for places in seqs.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 1024
    assert zlib.crc32(b"") == 0


def test_encoder_equals_tokenizers_on_odd_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, enc = Tokenizer.from_file(path), packing._Encoder(path)
    for t in ["a", " a", "a ", "a  b", "a \n b", "a\tb c", "I'll don't 12 3a", "é ñ ß", "日本 語 x", "x y z", "<|endoftext|> a", "a <|x|> b", "́ a b c", "a\n\nb c.\nD e"]:
        assert np.frombuffer(enc.ids(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_plan_uses_every_piece_and_fills_exactly():
    rng = random.Random(4)
    for draw in (lambda: rng.randint(1, 1024), lambda: min(1024, 1 + int(rng.expovariate(1 / 300))), lambda: rng.choice((300, 400, 500, 700))):
        counts = Counter(draw() for _ in range(5000))
        plan, used = packing.plan_packing(counts), Counter()
        for p, m in plan:
            assert sum(p) <= 1024
            for n in p:
                used[n] += m
        assert used == counts
        gaps, bins = [], 0  # first-fit decreasing, one piece at a time
        for n in sorted(counts.elements(), reverse=True):
            k = next((k for k, g in enumerate(gaps) if g >= n), None)
            if k is None:
                gaps.append(1024)
                bins, k = bins + 1, len(gaps) - 1
            gaps[k] -= n
        assert sum(m for _, m in plan) <= 1.01 * bins


def test_exact_complements_by_sums():
    """The index holds every combination; gaps that one, two or three short lengths fill exactly are filled by them."""
    n = np.array([3, 5, 9, 20])
    for many in (1, 2, 3):
        want = defaultdict(set)
        for c in combinations_with_replacement(sorted(n.tolist(), reverse=True), many):
            if sum(c) <= 40:
                want[sum(c)].add(c)
        assert {k: set(map(tuple, v.tolist())) for k, v in packing.sum_index(n, many, 40).items()} == want
    for shorts in ([100], [60, 40], [47, 31, 22]):
        plan = packing.plan_packing(Counter([924] * 3 + shorts * 3))
        assert [(tuple(sorted(p, reverse=True)), m) for p, m in plan] == [((924, *shorts), 3)]
    plan = packing.plan_packing(Counter({924: 5, 60: 2, 40: 9, 50: 1}))  # availability ends after two
    assert ((924, 60, 40), 2) in plan and sum(m for _, m in plan) == 6  # 5150 in all, which five cannot hold


def test_plan_without_pieces_and_with_ties():
    assert packing.plan_packing({}) == [] and packing.plan_packing({1024: 4}) == [((1024,), 4)]
    plan = packing.plan_packing({512: 5, 1: 1024})
    assert sum(m for _, m in plan) == 4 and sum(sum(p) * m for p, m in plan) == 5 * 512 + 1024


def labelled(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    rows, labels = [], []
    for i in range(600):
        toxic, good = i % 4 == 0, i % 3 != 0
        w = [word() for _ in range(60)]
        if toxic:
            for _ in range(4):
                w[rng.randrange(60)] = rng.choice(["vileword", "badperson"])
        if not good:
            w = [x + "###" for x in w]
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, int(good), int(toxic)))
    rows += [(700, None, "en", "s", 0), (701, "", "en", "s", 0)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int"), labels


def test_classifiers_on_held_out_rows(spark):
    docs, labels, known = labelled(spark)
    for f, k in ((quality_ranking.bradley_terry, 1), (toxicity.factorization_machine, 2)):
        got = {r.doc_id: r for r in f(docs, labels).collect()}
        assert len(got) == 602 and all(0 <= r.score <= 1 for r in got.values())
        held = [x for x in known if zlib.crc32(str(x[0]).encode()) % 5 == 0]
        assert {i for i, r in got.items() if r.held_out and i < 600} == {x[0] for x in held}
        assert sum(got[x[0]].predicted == x[k] for x in held) / len(held) > 0.95


def test_pairwise_interactions_are_learned():
    """Neither term alone is telling, both together are."""
    rng = random.Random(6)
    sets = [np.array(sorted({k for k in (1, 2) if rng.random() < 0.5} | {10 + rng.randrange(3)}), np.int32) for _ in range(2000)]
    label = np.array([int({1, 2} <= set(s.tolist())) for s in sets])
    fm = toxicity.FactorizationMachine.fit(sets, [np.ones(len(s)) for s in sets], label, label.mean())
    k = fm.index[[1, 2]]
    assert (k >= 0).all()
    z = lambda q: fm.bias + fm.weights[q].sum() + 0.5 * ((fm.factors[q].sum(0) ** 2).sum() - (fm.factors[q] ** 2).sum())
    assert z(k) > 0 > max(z(k[:1]), z(k[1:]))


def test_no_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for f in (quality_ranking.bradley_terry, toxicity.factorization_machine):
        assert f(docs, none).count() == docs.count()


def test_empty_and_clashing(spark, empty, clashing):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    for f in (
        sharding.external_shuffle,
        substrings.remove_repeated,
        ngram_join.similarity_groups,
        lambda d: packing.pack(packing.tokenized_pieces(d, path)),
        lambda d: quality_ranking.bradley_terry(d, labels),
        lambda d: toxicity.factorization_machine(d, labels),
    ):
        assert f(empty).count() == 0
        assert f(clashing).count() >= 15


def test_repeated_ids_teach_once(spark):
    docs, labels, known = labelled(spark)
    many = docs.unionByName(docs).unionByName(docs.where("doc_id < 50"))
    taught = taught_rows(many, training_labels(labels, "toxic"), "text")
    assert taught.count() == sum(zlib.crc32(str(x[0]).encode()) % 5 != 0 for x in known)


def test_clashing_columns_pass_through_shards(clashing):
    got = sharding.external_shuffle(clashing)
    assert len(got.columns) == len(set(got.columns)) and {r["_h"] for r in got.collect()} == {1}


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f " * 10, "en", "s", 0)] * 3 + [(None, "x y z", "en", "s", 0)], SCHEMA)
    assert substrings.remove_repeated(df).where("n_removed = 0").count() == 4
    assert [r.component_id for r in ngram_join.similarity_groups(df).where("doc_id = 1").collect()] == [1] * 3
    assert sharding.external_shuffle(df).agg(F.countDistinct("shard")).first()[0] <= 2
