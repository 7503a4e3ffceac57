"""The pipeline's stages keep the columns and do what they say; the packing at its end is whole."""

from collections import defaultdict

import public_tokenizers
import tokenizers

import corpus_pipeline
from cairn.llm import shared

from tests.llm.test_operators import plain_components, plain_dedup, plain_quality, plain_sets


def test_stages(spark, sf):
    docs = shared.documents(spark, sf)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = shared.stored(stage(spark, out, sf), "stage")
        assert out.columns == docs.columns, name
        seen.append({r["doc_id"]: r["text"] for r in out.collect()})
        assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
    good = [(i, t) for i, t in rows if plain_quality(t)[-1]]
    assert seen[0] == dict(good)
    classes = plain_components(plain_sets(good, 5), 80)
    single = [(i, t) for i, t in good if classes[i] == i]
    assert seen[1] == dict(single)
    cut = plain_dedup(single)
    assert seen[2] == {i: t if not cut[i][1] else cut[i][2] for i, t in single}
    assert {*seen[3]} == {*seen[2]} and seen[3] != seen[2]
    tok = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = corpus_pipeline.STAGES[-1][1](spark, out, sf).collect()
    lengths = defaultdict(int)
    for r in packed:
        lengths[r["doc_id"]] += r["length"]
    assert lengths == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in seen[3].items()}


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 100
