"""Ids do not depend on how much text is encoded at once, or on how many units are kept."""

import public_tokenizers

import corpus_pipeline
from talentgrid.llm import encode
from talentgrid.llm import op04_packing as P


def test_small_chunks_and_few_units_give_the_same_pieces(spark):
    rows = [(i, f"word{i % 7} text, number {i} " * (i % 40)) for i in range(60)] + [(90, None), (91, "  odd   spaces ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    path = public_tokenizers.path("byte_bpe_50k.json")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    want = sorted(map(tuple, P.pieces(docs, path).select(columns).collect()))
    assert sorted(map(tuple, P.pieces(docs, path, chunk=64, units=5).select(columns).collect())) == want


def test_an_encoder_keeps_no_more_units_than_told():
    enc = encode.encoder(public_tokenizers.path("byte_bpe_50k.json"), True, most=10)
    import numpy as np

    for i in range(50):
        raw = f"alpha{i} beta{i} gamma".encode()
        enc.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert len(enc.units) <= 10


def test_the_pipeline_packs_in_small_chunks():
    assert corpus_pipeline.CHUNK < encode.CHUNK_BYTES and corpus_pipeline.UNITS < encode.CACHE_UNITS
