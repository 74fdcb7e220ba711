"""Exact dedup, quality rules, mixing and personal data against plain Python."""

import hashlib
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, mixing, pii, quality_rules

from .conftest import SCHEMA, U

WORD = re.compile("[^\x20\x09-\x0d]+")


def test_exact_dedup(docs, rows):
    norm = {i: (t or "").translate(U) for i, t, *_ in rows}
    keep, size = {}, Counter(norm.values())
    for i, t in norm.items():
        keep[t] = max(i, keep.get(t, -1))
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        t = norm[r.doc_id]
        assert (r.keep_id, r.group_size, r.kept) == (keep[t], size[t], keep[t] == r.doc_id)
        assert r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert sorted(r.doc_id for r in exact_dedup.keep_largest(docs).collect()) == sorted(keep.values())


def test_exact_dedup_of_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "A"), (None, "b")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df).collect())
    assert got == [(-1, -1, 1, True), (-1, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True)]
    assert sorted((r.doc_id or -1, r.text) for r in exact_dedup.keep_largest(df).collect()) == [(-1, "b"), (1, "a")]


def counts(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(docs, rows):
    got = {r.doc_id: r for r in quality_rules.document_metrics(docs).collect()}
    for i, t, *_ in rows:
        n = counts(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n, i
        assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0])
    assert {r.doc_id for r in quality_rules.passing(docs).collect()} == {i for i, r in got.items() if not r.base_failed}


def test_bad_hosts_are_rejected_and_small_ones_are_not(spark):
    good, bad = " ".join(f"w{i}" for i in range(30)), "few words"
    rows = [(i, bad if i % 20 else good, "en", "bad", 0) for i in range(400)]
    rows += [(1000 + i, good, "en", f"h{i % 20}", 0) for i in range(400)] + [(2000, bad, "en", "small", 0), (2001, good, "en", "small", 0)]
    kept = {r.doc_id for r in quality_rules.passing(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept == set(range(1000, 1400)) | {2001}


def test_mixing(docs, rows):
    got = mixing.mix(docs).collect()
    again = {r.doc_id: r.copies for r in mixing.mix(docs.repartition(7)).collect()}
    assert {r.doc_id: r.copies for r in got} == again and len(got) == len(rows)
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in rows}
    total, per, taken, target = sum(size.values()), Counter(), Counter(), {}
    for i, _, _, s, _ in rows:
        per[s] += size[i]
    order = sorted((s for s in per if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    free, left, want = set(order), 1.5 * total, {}
    while True:
        w = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w > 2 * per[s]}
        if not over:
            break
        for s in over:
            want[s] = 2.0 * per[s]
            left -= want[s]
        free -= over
    want |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    for r in got:
        assert r.size == size[r.doc_id] and r.copies in (0, 1, 2)
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
    for s in order:
        assert target[s] == pytest.approx(want[s])
        most = max(size[i] for i, _, _, x, _ in rows if x == s)
        assert abs(taken[s] - want[s]) <= most / 2 + 1e-6
    assert mixing.mixed_rows(docs).count() == sum(r.copies for r in got)


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    v = [int(c) for c in d[::-1]]
    return (sum(v[::2]) + sum(x * 2 - 9 * (x > 4) for x in v[1::2])) % 10 == 0


def base(t):
    out = []
    for k, p in BASE.items():
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if k == "ip" else True,
                "card": 13 <= len(d) <= 19 and luhn(d),
                "phone": 9 <= len(d) <= 15,
            }[k]
            if ok:
                out.append(f"{k}:{m.start()}:{m.end()}")
    return out


PERSONAL = [
    "mail é a.b@c-d.example.com, a@b, x@y.z@w.v.", "ip 1.2.3.4 and 999.1.1.1 and 1.2.3.4.5.6.7.8 001.002.003.255",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111234567890123", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
    "call +1 (555) 123-4567 or +12 or + 1 or +1234567890123456", "😀 +44 20 7946 0958 a@b.co", None, "", "no data at all",
]


def test_personal_data_base(spark):
    df = spark.createDataFrame(list(enumerate(PERSONAL)), "doc_id long, text string")
    for r in pii.personal_data(df).collect():
        want = base(PERSONAL[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), r
        assert set(want) <= set(r.spans.split(",")) | {""}
        assert r.n_email == sum(x.startswith("email") for x in want)


def test_boosting_adds_confirmed_formats_and_redacts(spark):
    rows = [(i, f"x{i} phone: +1 555 {200 + i % 700} {1000 + i} end") for i in range(300)]
    rows += [(1000 + i, f"order 555 {200 + i % 700} {1000 + i} parts") for i in range(300)]
    rows += [(2000, "phone: 555 123 4567 end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.personal_data(df)
    got = {r.doc_id: r.spans for r in found.collect()}
    assert all(got[1000 + i] == "" for i in range(300))
    text = {r.doc_id: r.text for r in pii.redacted(df, found).collect()}
    assert text[7] == "x7 phone: [phone] end" and text[1007] == rows[307][1]


ADDED = {
    "reach john.smith [at] mail [dot] example [dot] com today": "email",
    "write jane (at) site7 (dot) org": "email",
    "or k.lee at corp dot net thanks": "email",
    "call 555-234-5678 now": "phone",
    "the desk (843) 555-7672 is open": "phone",
    "phone: 555 234 5678 end": "phone",
    "ère. Des +1 (826) 555-4081 190.137.223.204 du": "phone",
    "un. +1 (843) 555-7672 170.106.47.218 Et": "phone",
    "server 10[.]1[.]2[.]3 down": "ip",
    "card 4111.1111.1111.1111 paid": "card",
}
NOT_ADDED = [
    "we arrived at home.Then we slept", "order 555 234 5678 parts", "part no. 555-234-5678 in stock", "table 123 456 7890 sums",
    "card 4111.1111.1111.1112 paid", "years 1998 / 1999 / 2000 / 2001 were", "version 1 . 2 . 3 . 4 is", "host 999[.]1[.]2[.]3",
]


def test_spans_beside_the_base_ones_depend_on_the_text_alone(spark):
    texts = [*ADDED, *NOT_ADDED]
    many = [(i, t) for i, t in enumerate(texts)] + [(100 + i, f"call 555-{234 + i}-5678, order 555 {300 + i} 1234") for i in range(400)]
    whole, few = (
        {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        for rows in (many, many[: len(texts)])
    )
    for i, t in enumerate(texts):
        kinds = [x.split(":")[0] for x in whole[i].split(",") if x]
        extra = Counter(kinds) - Counter(x.split(":")[0] for x in base(t))
        assert extra == Counter([ADDED[t]] if t in ADDED else []), (t, whole[i])
        assert few[i] == whole[i]
    swallowed = next(t for t in ADDED if "4081" in t)
    a = swallowed.index("+1")
    assert f"phone:{a}:{a + 17}" in whole[texts.index(swallowed)].split(",")


def test_long_runs_take_linear_time(spark):
    """Texts of a megabyte that made patterns go back, start again at each character, or recurse."""
    m = 1_000_000
    made = [
        ("mail a@b" + ".cc" * 300_000, ["email:5:900008"]),
        ("x" * m + "@example.com", [f"email:0:{m + 12}"]),
        ("x" * m + " @", []),
        ("7" * m, []),
        ("1." * 400_000, [f"ip:{k}:{k + 7}" for k in range(0, 800_000, 8)]),
        ("4 " * 500_000, []),
        ("+1" + "(" * m, []),
        ("+1 " * 300_000, []),
        ("a@b.co " * 20_000, [f"email:{7 * k}:{7 * k + 6}" for k in range(20_000)]),
        ("a at b dot cc " * 20_000, []),
    ]
    texts, want = zip(*made)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    pii.personal_data(spark.createDataFrame([(1, "a")], "doc_id long, text string")).collect()
    began = time.time()
    for r in pii.personal_data(df).collect():
        assert r.base_sha256 == hashlib.sha256(",".join(want[r.doc_id]).encode()).hexdigest(), r.doc_id
    assert time.time() - began < 60


def test_base_patterns_on_random_texts(spark):
    rng = random.Random(5)
    pools = ["ab.@-%c", "0129.", "0 1-23 ", "+1 ().-23", "a@b.c%d+1 .9", "4 11-.+@x[]"]
    texts = ["".join(rng.choice(p) for _ in range(rng.randint(0, 80))) for p in pools for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.personal_data(df).collect():
        assert r.base_sha256 == hashlib.sha256(",".join(base(texts[r.doc_id])).encode()).hexdigest(), texts[r.doc_id]


def test_empty_and_clashing(empty, clashing):
    for f in (exact_dedup.exact_dedup, exact_dedup.keep_largest, quality_rules.document_metrics, quality_rules.passing, mixing.mix, mixing.mixed_rows, pii.personal_data):
        assert f(empty).count() == 0
        f(clashing).collect()
    assert exact_dedup.exact_dedup(clashing.select(F.col("doc_id"), "text")).count() == 15
