"""The pipeline against its stages' brute-force versions on a small table."""

import random

import corpus_pipeline
from galley.llm import tokens
from galley.llm.common import pick
from tests.llm.test_near_dup import brute as near
from tests.llm.test_operators import brute_hits
from tests.llm.test_substrings import brute_words


def corpus(seed):
    rng = random.Random(seed)
    common = ["the", "and", "of", "that", "with", "is", "from"] + [f"ation{i}" for i in range(200)]
    passage = rng.choices(common, k=60)
    texts = []
    for i in range(120):
        w = rng.choices(common, k=rng.randint(20, 120))
        if i % 9 == 0:
            w += passage
        texts.append(" ".join(w))
    texts += [texts[3], texts[4] + " more", "", None, "123 456", " ".join(passage)]
    items = [(1, " ".join(texts[7].split()[:12])), (2, "zz yy")]
    return [(i, t, "en" if i % 2 else None, "s") for i, t in enumerate(texts)], items


def test_stages_equal_brute_force(spark, frame, tmp_path):
    rows, items = corpus(1)
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    pick(frame(rows), *corpus_pipeline.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs)
    assert all(tuple(d.columns) == corpus_pipeline.COLUMNS for d in seen[:-1])
    texts = [{r.doc_id: r.text for r in d.collect()} for d in seen[:-1]]
    assert set(texts[0]) == {d for d, t, *_ in rows if t and t != "123 456"}
    want = {d for d, (_, root) in near(sorted(texts[0].items())).items() if d == root}
    assert set(texts[1]) == want and len(want) < len(texts[0])
    cut = {int(d): (n, gone) for d, n, gone, _ in brute_words(sorted(texts[1].items()))}
    assert {d for d, (n, gone) in cut.items() if gone < n} == set(texts[2])
    assert all(len(texts[2][d].split()) == n - gone for d, (n, gone) in cut.items() if d in texts[2])
    assert all(texts[2][d] == texts[1][d] for d in texts[2] if not cut[d][1])
    assert set(texts[3]) == {d for d, t in texts[2].items() if not brute_hits(t, items)[4]} and len(texts[3]) < len(texts[2])
    ids = {}
    for r in seen[4].orderBy("doc_id", "start").collect():
        ids[r.doc_id] = ids.get(r.doc_id, b"") + bytes(r.ids)
    order = sorted(texts[3])
    assert ids == {d: x + bytes(4) for d, x in zip(order, tokens.encoder(tokens.vocabulary()).encode([texts[3][d] for d in order]))}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[4].count()
