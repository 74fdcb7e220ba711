"""The pipeline's stages against plain Python, each on what its predecessor kept."""

from collections import Counter

import corpus_pipeline
from millrace.llm import mixing

from .conftest import SCHEMA, U
from .test_free import brute_groups
from .test_native import counts


def test_stages(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    read = lambda k: spark.read.parquet(str(tmp_path / str(k)))
    now, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        now = read(k)
        kept.append(now.collect())
    text = {r[0]: r[1] for r in rows}
    good = {i for i, t in text.items() if (n := counts(t))[0] >= 20 and 100 * n[4] <= 30 * n[0]}
    assert {r.doc_id for r in kept[0]} == good
    last = {}
    for i in sorted(good):
        last[text[i].translate(U)] = i
    assert sorted(r.doc_id for r in kept[1]) == sorted(last.values())
    groups = brute_groups([r for r in rows if r[0] in set(last.values())])
    assert {r.doc_id for r in kept[2]} == {g for _, g in groups.values()}
    copies = {r.doc_id: r.copies for r in mixing.mix(read(2)).collect()}
    assert Counter(r.doc_id for r in kept[3]) == Counter({i: c for i, c in copies.items() if c})
    assert Counter((r.doc_id, r.piece) for r in kept[4] if r.piece == 0) == Counter({(i, 0): c for i, c in copies.items() if c})
    fill = Counter()
    for r in kept[4]:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept[4])
