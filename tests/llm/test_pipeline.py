"""Each stage of the pipeline against a plain version, on its own input."""

from __future__ import annotations

import hashlib
import math

import pytest
import zstandard

from tests.conftest import DATA
from tests.llm.helpers import clashing, corpus
from tests.llm.test_shingles import names
from tests.llm.test_substrings import kept_texts

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from waymark.llm import labelled, mixing, quality, sentencepieces  # noqa: E402
from waymark.llm.queries import default_model  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of each stage, written and read again as the driver does."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(folder / name))
        found = spark.read.parquet(str(folder / name))
        out[name] = (docs, found, folder / name)
        docs = found
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "substrings", "mixture", "tokens"]
    assert all(stages[n][1].columns == COLUMNS for n in list(stages)[:-1])
    assert [f.dataType for f in stages["mixture"][1].schema] == [f.dataType for f in stages["quality"][0].schema]


def test_quality(spark, stages):
    before, after, _ = stages["quality"]
    model = quality.fit(before, spark.read.parquet(f"{DATA}/labels.parquet"))
    size = lambda raw, text: sum(
        len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=False, write_dict_id=False).compress(text[i : i + quality.BLOCK]))
        for i in range(0, len(text), quality.BLOCK)
    )
    import numpy as np

    rows = sorted(texts(before).items())
    raw = [(t or "").encode() for _, t in rows]
    x = quality.features(*(np.array(v, float) for v in ([size(model.good, t) for t in raw], [size(model.bad, t) for t in raw], [len(t) for t in raw])))
    keep = labelled.predict(model.calibration, x) >= 0.3
    assert sorted(texts(after)) == [i for (i, _), k in zip(rows, keep) if k]
    assert 0 < len(texts(after)) < len(rows)


def test_near_duplicates(stages):
    """Five words and a similarity of 0.8, by all pairs."""
    before, after, _ = stages["near_duplicates"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert sorted(texts(after)) == sorted({low for _, low in names(rows)})
    assert all(texts(before)[i] == t for i, t in texts(after).items())


def test_substrings(stages):
    before, after, _ = stages["substrings"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    want, got = dict(kept_texts(rows)), texts(after)
    assert {i: " ".join(t.split()) for i, t in got.items()} == want
    was = dict(rows)
    assert all(got[i] == was[i] for i in got if len(want[i].split()) == len(was[i].split()))
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_mixture(spark, stages):
    before, after, folder = stages["mixture"]
    rows = [(r.doc_id, r.source) for r in before.collect()]
    sizes: dict = {}
    for _, s in rows:
        sizes[s] = sizes.get(s, 0) + 1
    total = sum(math.sqrt(n) for n in sizes.values())
    weights = {s: max(1, math.floor(mixing.QUANTUM * math.sqrt(n) / total + 0.5)) for s, n in sizes.items()}
    queues = {s: sorted((i for i, x in rows if x == s), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()) for s in sizes}  # noqa: S324
    whole, sent, want, t = sum(weights.values()), dict.fromkeys(sizes, 0), [], 0
    while len(want) < len(rows):
        open_ = [s for s in sorted(sizes) if sent[s] * whole // weights[s] <= t]
        s = min(open_, key=lambda s: (-(-(sent[s] + 1) * whole // weights[s]), s))
        want += queues[s][sent[s] * mixing.BLOCK_ROWS : (sent[s] + 1) * mixing.BLOCK_ROWS]
        sent[s] += 1
        t += 1
    files = sorted(folder.glob("part-*"))
    assert [r.doc_id for f in files for r in spark.read.parquet(str(f)).collect()] == want
    assert texts(after) == texts(before)


def test_tokens(stages):
    sentencepiece = pytest.importorskip("sentencepiece")
    before, after, _ = stages["tokens"]
    library = sentencepiece.SentencePieceProcessor(model_proto=sentencepieces.model_bytes(default_model()))
    was = texts(before)
    rows = after.collect()
    assert sorted(r.doc_id for r in rows) == sorted(was)
    assert all(r.ids == library.encode(was[r.doc_id]) and r.same and r.n_tokens == len(r.ids) for r in rows)


def test_run(spark, stages):
    found = corpus_pipeline.run(spark, DATA)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, stages["tokens"][1].collect()))


def test_run_is_in_order_of_the_mixture(spark, stages, monkeypatch):
    """Also when a scan reads the mixture's files in another order, the largest first."""
    before, _, _ = stages["mixture"]
    want = [(r.doc_id, r.mix.slot, r.mix.place) for r in mixing.mix(before).orderBy("mix.slot", "mix.place").collect()]

    def shuffled(spark, docs, sf_dir):
        return corpus_pipeline.mix_sources(spark, docs, sf_dir).repartition(7, "doc_id")

    found = stages["tokens"][1]
    assert sorted((r.doc_id, r.slot, r.place) for r in found.collect()) == sorted(want)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, shuffled if n == "mixture" else f) for n, f in corpus_pipeline.STAGES])
    assert [(r.doc_id, r.slot, r.place) for r in corpus_pipeline.run(spark, DATA).collect()] == want


@pytest.mark.parametrize("number", range(5))
def test_odd_tables(spark, number):
    """Nulls, empty and long texts, repeated rows, no rows, and clashing columns, in each stage."""
    name, stage = corpus_pipeline.STAGES[number]
    rows = corpus(12, 20)
    rows += [rows[4], rows[4], (None, None), (950, " ".join(f"u{i}" for i in range(60_000)))]
    docs = clashing(spark, rows)
    out = stage(spark, docs, DATA)
    found = out.collect()
    assert stage(spark, docs.limit(0), DATA).collect() == []
    if name == "tokens":
        assert len(found) == len(rows) and all(r.same and r.n_tokens == len(r.ids) for r in found)
        return
    assert out.columns == docs.columns and all(r.id == 7 and r.row == "r" and r._row == "x" for r in found)
    ids = [r.doc_id for r in found]
    if name in ("substrings", "mixture"):
        assert sorted(map(repr, ids)) == sorted(repr(i) for i, _ in rows)
    if name == "near_duplicates":
        assert {i for i in ids if i is not None} == {low for _, low in names(rows) if low is not None}
        assert ids.count(None) == sum(i is None for i, _ in rows)
    if name == "quality":
        kept = {(r.doc_id, r.text) for r in found}
        assert len(found) == sum((i, t) in kept for i, t in rows)


def test_run_leaves_the_last_input_alone(spark):
    """Of the folders between stages, only the one that the result reads is left."""
    from pathlib import Path

    from waymark.session import checkpoint_dir

    top = Path(checkpoint_dir(spark).removeprefix("file:"))
    before = set(top.glob("pipeline-*"))
    corpus_pipeline.run(spark, DATA)
    (new,) = set(top.glob("pipeline-*")) - before
    assert [x.name for x in new.iterdir()] == ["mixture"]
