"""Runs of a window share one lattice: it is made once, and no row changes."""

import pyarrow as pa
import public_tokenizers

from driftwalk.llm import sentencepieces


def test_a_window_has_one_lattice(spark, monkeypatch):
    texts = [f"river stone {k} walks over the old bridge" for k in range(40)] + [None, "", "東京 tower", "x" * 900]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    path = public_tokenizers.path("piece_bpe_32k.model")
    taken, made = [], []

    class Batch:
        def mapInArrow(self, f, schema):
            taken.append(f)
            return self

        def select(self, *columns):
            return self

        def drop(self, *columns):
            return self

    build = sentencepieces.Lattice.__init__
    monkeypatch.setattr(sentencepieces, "RUN_BYTES", 100)
    monkeypatch.setattr(sentencepieces.Lattice, "__init__", lambda self, *a: made.append(1) or build(self, *a))
    sentencepieces.sample_segmentations(Batch(), path)
    table = pa.RecordBatch.from_pylist([r.asDict() for r in docs.collect()], pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))
    got = pa.Table.from_batches(list(taken[0]([table]))).to_pylist()
    assert len(made) == 1
    model = sentencepieces.worker_model(path)
    alone = [r for k, t in enumerate(texts) for x in sentencepieces.sample_batches(model, [k], [t], 2, 7, False) for r in x.to_pylist()]
    order = lambda rows: sorted(({**r, "text": None} for r in rows), key=lambda r: (r["doc_id"], r["sample"]))
    assert len(got) > 80 and order(got) == order(alone)
