"""The steps of the substring operator over whole arrays: against brute force, and their cost."""

import hashlib
import time

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import substrings, suffix_array


def steps(texts, ids, batch=40):
    """The operator's steps without Spark, on texts that are all their own heads: spans by row, and the digests."""
    ids = pa.array(ids, pa.int64())
    marks = pa.array(range(len(texts)), pa.int64())
    heads = pa.table([ids, marks, pa.array(texts, pa.string())], names=["doc_id", "mark", "text"])
    keyed = list(substrings._keys(8)(iter(heads.to_batches(max_chunksize=batch))))
    lists = [[] for _ in texts]
    for q in range(8):
        for b in substrings._shared(iter([x for x in keyed if x.column(0)[0].as_py() == q])):
            for m, k in zip(b.column("mark").to_pylist(), b.column("keys").to_pylist()):
                lists[m].append(k)
    wanted = heads.append_column("keys", pa.array(lists, pa.list_(pa.binary()))).combine_chunks()
    kinds = {"bucket": pa.int32(), "key": pa.int64(), "doc_id": pa.int64(), "mark": pa.int64(), "start": pa.int32(), "bytes": pa.binary()}
    found = pa.Table.from_batches(substrings._segments(8)(iter(wanted.to_batches(max_chunksize=batch))), pa.schema(kinds))
    found = found.sort_by([("bucket", "ascending"), ("key", "ascending")]).combine_chunks()
    spans = [[] for _ in texts]
    for b in substrings._shards(iter(found.to_batches(max_chunksize=batch))):
        for _, m, start, end in zip(*[c.to_pylist() for c in b.columns]):
            spans[m].append({"start": start, "end": end})
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    cut = pa.table(
        [ids, heads.column("text"), pa.array([False] * len(texts)), pa.array([s or None for s in spans], kind)],
        names=["doc_id", "text", "copied", "spans"],
    )
    done = pa.Table.from_batches(substrings._cut(iter(cut.combine_chunks().to_batches(max_chunksize=batch))))
    return [tuple(r.values()) for r in done.to_pylist()]


def brute(texts, ids):
    first = {}
    for d, t in zip(ids, texts):
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(d, first.get(b[k : k + 50], d))
    out = []
    for d, t in zip(ids, texts):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < d:
                gone[k : k + 50] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = np.frombuffer(b, np.uint8)[~gone[: len(b)]].tobytes()
        out.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    word = ["".join(rng.choice(list("abcdeé "), 30)) for _ in range(60)]
    texts = []
    for k in range(n):
        parts = list(rng.choice(word, rng.integers(0, 14)))
        if texts and k % 3 == 0:
            old = texts[rng.integers(len(texts))] or ""
            a = rng.integers(0, len(old) + 1)
            parts[:1] = [old[a : a + int(rng.integers(40, 400))]]
        texts.append("".join(parts) if k % 17 else [None, "", "a" * 700, "ab " * 300, "x" * 49, "x" * 50][k // 17 % 6])
    return texts, rng.permutation(n).tolist()


@pytest.mark.parametrize("shard, piece, portion", [(1 << 20, 1 << 14, 1 << 18), (700, 64, 300), (1, 1, 1)])
def test_steps_match_brute_force(monkeypatch, shard, piece, portion):
    """Also where keys, texts and segments go on across batches, pieces and portions."""
    for name, x in (("SHARD_BYTES", shard), ("PIECE", piece), ("PORTION", portion)):
        monkeypatch.setattr(substrings, name, x, raising=False)
    for seed in range(3 if piece > 1 else 1):
        texts, ids = corpus(seed, 150 if piece > 1 else 60)
        if piece > 1:
            texts[5], texts[9] = "".join(t or "" for t in texts) * 2, "".join(t or "" for t in texts[50:])
        want = brute(texts, ids)
        assert sum(w[2] for w in want) > 1000
        assert steps(texts, ids) == want
        assert steps(texts, ids, 7) == want


def test_rows_with_equal_ids_keep_their_bytes():
    t = "".join(np.random.default_rng(1).choice(list("abcd"), 400))
    assert [r[2] for r in steps([t, t[:300], "-" + t], [4, 4, 4])] == [0, 0, 0]
    assert [r[2] for r in steps([t, t[:300], "-" + t], [4, 3, 4])] == [300, 0, 300]


def test_segments_and_shards_cost_a_few_sorts():
    """Near copies, so that most runs are shared and few segments are equal."""
    rng = np.random.default_rng(3)
    base = rng.integers(97, 123, (40, 4000)).astype(np.uint8)
    texts = []
    for k in range(400):
        t = base[k % 40].copy()
        t[rng.integers(0, 4000, 15)] = 32
        texts.append(t.tobytes().decode())
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    keys = data.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C17) + np.arange(len(data), dtype=np.uint64)[::-1]

    def least(f):
        took = []
        for _ in range(3):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    a, b = least(lambda: steps(texts, range(400), 10_000)), least(lambda: np.argsort(keys, kind="stable"))
    print(f"{a:.2f} s, a sort of as many numbers as there are bytes {b:.3f} s, ratio {a / b:.1f}")
    assert a < 16 * b


def test_ties_are_sorted_alike_in_large_arrays():
    """Beyond two million positions, first, after and position don't fit in one number."""
    rng = np.random.default_rng(4)
    first, after, i = np.sort(rng.integers(0, 30, 900)), rng.permutation(900).astype(np.int32), rng.permutation(900)
    (a, x), (b, y) = (suffix_array._ordered(first, after, i, n) for n in (900, 1 << 21))
    assert a.tolist() == b.tolist() == i[np.lexsort((after, first))].tolist()
    assert (np.diff(x) > 0).all() and (np.diff(y) > 0).all()


def test_wanted_suffixes_keep_their_order():
    rng = np.random.default_rng(6)
    for n, depth in ((1, 50), (5, 50), (300, 50), (3000, 50), (3000, 5), (300, 7), (300, 2000)):
        t, wanted = rng.integers(0, 2, n).astype(np.uint8), rng.random(n) < 0.4
        raw, got = t.tobytes(), suffix_array.suffix_array(t, depth, wanted).tolist()
        depth = max(depth, 7)
        assert sorted(got) == np.flatnonzero(wanted).tolist()
        assert [raw[i : i + depth] for i in got] == sorted(raw[i : i + depth] for i in got)
