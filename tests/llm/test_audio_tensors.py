"""The query stores the tensors of every document and reads its features from them."""

import glob

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from quorumcast import staging
from quorumcast.llm import audio, queries


def test_query_stores_tensors_of_every_document(spark, tmp_path, docs, rows):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op4_audio(spark, str(tmp_path)).collect()
    folders = glob.glob(f"{staging.staging_root(spark).removeprefix('file:')}/{spark.sparkContext.applicationId}/op4-tensors-*")
    assert len(folders) == 1
    stored = pq.read_table(folders[0]).to_pylist()
    assert len(stored) == len(got) == len(rows)
    want = {r["id"]: audio.summary(r["tensors"], r["rate"] / 2) for r in stored}
    assert {r.doc_id: r.feature for r in got} == want


def test_tensors_of_a_long_recording_are_written_by_block(monkeypatch):
    samples = np.random.default_rng(2).integers(0, 256, 100_000).astype(np.uint8).tobytes()
    whole = pa.ipc.open_stream(audio.tensor_stream(samples, audio.RATE)).read_all()
    monkeypatch.setattr(audio, "BLOCK_FRAMES", 128)
    parts = pa.ipc.open_stream(audio.tensor_stream(samples, audio.RATE)).read_all()
    assert parts["log_mel"].num_chunks > 2
    for c in ("start_s", "end_s", "n_frames"):
        assert np.allclose(whole[c].to_numpy(), parts[c].to_numpy())
    tensors = [np.concatenate([x.to_numpy_ndarray() for x in t["log_mel"].chunks]) for t in (whole, parts)]
    assert np.allclose(*tensors, atol=1e-4)
