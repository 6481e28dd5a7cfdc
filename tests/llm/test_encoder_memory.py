from __future__ import annotations

import corpus_pipeline
import pyarrow as pa
from perigee.llm import piece_lattice, shared


def test_a_batch_is_cut_by_its_texts():
    texts = ["a" * 5, None, "b" * 30, "", "c", "d" * 4, "é" * 4]
    batch = pa.RecordBatch.from_pydict({"text": texts, "n": range(7)})
    parts = list(shared.sliced(batch, "text", 10))
    assert [x for p in parts for x in p.column(0).to_pylist()] == texts and len(parts) > 2
    assert all(sum(len((t or "").encode()) for t in p.column(0).to_pylist()) <= 10 + 30 for p in parts)
    assert list(shared.sliced(batch.slice(0, 0), "text", 10)) == []


def test_the_encoder_gets_slices_and_remembers_bytes(spark, monkeypatch):
    words = [" ".join(f"word{(k * n) % 97}" for k in range(200)) for n in range(1, 40)]
    frame = spark.createDataFrame(list(enumerate(words)), "doc_id bigint, text string").coalesce(1)
    whole = piece_lattice.encode(frame, corpus_pipeline.MODEL).collect()
    monkeypatch.setattr(piece_lattice, "SLICE", 1000)
    assert piece_lattice.encode(frame, corpus_pipeline.MODEL).collect() == whole
    encoder = piece_lattice.Encoder(piece_lattice.Pieces.load(corpus_pipeline.MODEL))
    once = encoder.encode_all(words)
    assert encoder.chunks and all(type(x) is bytes for x in encoder.chunks.values())
    again = encoder.encode_all(words)
    assert once[0] == again[0] and once[2].tolist() == again[2].tolist() and once[3] == again[3]
