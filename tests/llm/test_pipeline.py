from collections import Counter

import corpus_pipeline
from tessera.llm import decontam, langid
from tests.llm import test_decontam_brute, test_line_dedup, test_near_dedup, test_packing


def test_stages_against_brute_force(spark, docs, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    rows = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, sf_dir)
        assert out.columns == docs.columns
        before, after = rows(now), rows(out)
        pairs = list(before.elements())
        if name == "language_id":
            model = langid.train(now.where(~langid.train_held_out(now["doc_id"])))
            assert after == Counter((d, t) for d, t in pairs if not model.predict(t)[2])
            assert len(after) >= 0.97 * len(before)
        elif name == "line_dedup":
            assert after == Counter((d, t) for d, _, _, t in test_line_dedup.expected(pairs).elements())
        elif name == "near_dedup":
            assert {d for d, _ in after} == test_near_dedup.kept(pairs) and after <= before
        else:
            texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            found = {d for d, t in pairs for x in texts if (b := test_decontam_brute.brute(t or "", x)) and b[1] >= decontam.CONTAINMENT and b[2] >= decontam.CONSISTENCY}
            assert after == Counter((d, t) for d, t in pairs if d not in found) and all(d in found for d, t in pairs if any(x in t for x in texts))
        now = spark.createDataFrame(out.collect(), out.schema)
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir)
    test_packing.check([(r["doc_id"], r["text"]) for r in now.collect()], pieces.collect())
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
    assert Counter(map(tuple, corpus_pipeline.run(spark, sf_dir).select(*columns).collect())) == Counter(map(tuple, pieces.select(*columns).collect()))
