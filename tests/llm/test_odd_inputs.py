"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from stationcast.llm import bpe, chat, chunks, language, packing, pages, quality, scoring, simhash, toxicity

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LANGUAGE = language.train(["the and of that", "der und die das"], ["en", "de"])
TOXIC = toxicity.Model(share=0.25)
BY_ROW = {
    "language": lambda d: language.identify(d, LANGUAGE),
    "toxicity": lambda d: toxicity.toxicity(d, TOXIC),
    "quality": quality.quality,
    "pages": lambda d: pages.extract(d, "doc_id", "text"),
    "bpe": lambda d: bpe.encode(d, VOCABULARY, ("n_tokens", "ids", "decoded")),
    "fingerprints": chunks.fingerprints,
    "edits": chunks.with_edits,
    "simhash": simhash.simhash,
    "model": lambda d: scoring.score_documents(d, scoring.in_training()),
}


@pytest.mark.parametrize("name", BY_ROW)
def test_a_row_for_each_document(odd, name):
    out = BY_ROW[name](odd).collect()
    assert sorted((r[0] is None, r[0] or 0) for r in out) == sorted((r.doc_id is None, r.doc_id or 0) for r in odd.collect())


@pytest.mark.parametrize("name", BY_ROW)
def test_empty_table(odd, name):
    assert BY_ROW[name](odd.limit(0)).count() == 0


def test_keepers_leave_columns_alone(odd):
    assert quality.keep_good(odd).schema == odd.schema
    assert toxicity.keep_clean(odd, TOXIC).count() == odd.count()
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    rows = {(r.doc_id, r.text) for r in kept.collect()}
    assert kept.count() == len(rows)
    assert (1, None) in rows and (2, "") not in rows  # no words: fingerprint zero, one group, smallest id stays


def test_equal_rows_get_equal_results(odd):
    same = [tuple(r)[1:] for r in scoring.score_documents(odd, scoring.in_training()).filter("doc_id = 5").collect()]
    assert len(same) == 3 and len(set(same)) <= 2
    marks = simhash.simhash(odd).filter("doc_id = 5").collect()
    assert len(marks) == 3 and len({r.fingerprint for r in marks}) == 2


def test_untrained_models(odd):
    nothing = language.fit(odd.withColumn("lang", F.lit(None).cast("string")), language.in_training())
    found = language.identify(odd, nothing).collect()
    assert {(r.lang_pred, r.score) for r in found} == {("und", 0.0)}
    labels = odd.sparkSession.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels, toxicity.in_training())
    assert {r.score for r in toxicity.toxicity(odd, model).collect()} == {0.0}
    scores = scoring.score_documents(odd, F.lit(False)).collect()
    assert all(abs(r.score) < 1e-6 and abs(r.base_score) < 1e-6 and r.n_known == 0 for r in scores)


def test_packing(odd):
    out = packing.pack_documents(odd, VOCABULARY, with_ids=True).collect()
    assert sum(r.start == 0 for r in out) == odd.count()
    assert all(len(r.ids) == r.length for r in out)
    places = {}
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.SIZE
    assert packing.pack_documents(odd.limit(0), VOCABULARY).count() == 0


def test_chat(spark):
    rows = [
        (1, 1, "u", "a"), (1, 2, "b", "c"), (2, 1, "u", "a"), (None, 1, "u", "a"), (3, 1, "u", "a"), (3, 1, "u", "a"),
        (3, 2, "b", "c"), (3, 3, "u", None), (4, None, None, None), (5, 1, "u", "z"), (6, 1, "u", "z"), (None, 2, "q", "q"),
    ]
    turns = spark.createDataFrame([(*r, 0, "p") for r in rows], "conv_id long, turn long, role string, text string, position int, part string")
    out = {(r.conv_id, r.part): r for r in chat.render(turns, 2).collect()}
    assert set(out) == {(None, 0), (3, 0), (3, 1), (4, 0), (5, 0)}
    assert out[3, 1].text == "<|im_start|>u\n<|im_end|>\n" and out[3, 0].n_turns == 3
    assert out[5, 0].n_copies == 2
    assert chat.render(turns.limit(0)).count() == 0
