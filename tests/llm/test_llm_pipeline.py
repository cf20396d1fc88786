"""The pipeline's stages on small tables, against plain versions of what they keep."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer as Library

NAMES = ["quality", "lines", "near_duplicates", "packing"]
FIELDS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    rng = random.Random(12)
    words = [f"{a}{b}" for a in ("an", "be", "or", "tion", "ing") for b in ("the", "of", "her", "es", "ti", "re", "on")]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    passage = prose(60)
    docs = {i: "\n".join([prose(40), prose(30), prose(45)]) for i in range(30)}
    docs |= {40 + i: "\n".join([prose(70), passage, prose(50)]) for i in range(4)}
    docs[50] = docs[3]
    near = docs[5].split(" ")
    near[7], near[60] = "changed", "changed"
    docs[51] = " ".join(near).replace("\n", " ")
    docs |= {60 + i: " ".join(w.upper() + "!!" for w in prose(120).split()) for i in range(12)}
    docs |= {80: None, 81: "", 82: "too short"}
    return docs


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = corpus()
    rows = [(i, t, "en", None if i % 7 == 0 else "src0", None if t is None else len(t)) for i, t in docs.items()]
    spark.createDataFrame(rows, FIELDS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in docs if i < 60] + [(60 + i, 0, 0) for i in range(8)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_in_order(spark, sf_dir):
    assert [name for name, _ in corpus_pipeline.STAGES] == NAMES
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = corpus()
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        path = f"{sf_dir}/{name}"
        docs.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
    good = {i for i in texts if i < 60}
    assert set(kept["quality"]) == good
    # The exact copy has nothing left; the passage stays in its first document only.
    assert set(kept["lines"]) == good - {50}
    for i, r in kept["lines"].items():
        want = texts[i] if not 40 < i < 50 else "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k != 1)
        assert (r["text"], r["n_chars"]) == (want, len(want))
    assert set(kept["near_duplicates"]) == good - {50, 51}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    library = Library.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces: dict = {}
    for r in sorted(packed, key=lambda r: (r["doc_id"], r["start"])):
        pieces[r["doc_id"]] = pieces.get(r["doc_id"], b"") + r["ids"]
    for i, r in kept["near_duplicates"].items():
        assert pieces.pop(i) == np.array([*library.encode(r["text"], add_special_tokens=False).ids, 1], "<u4").tobytes()
    assert not pieces
    assert Counter(r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()) == Counter(r["doc_id"] for r in packed)


def test_stages_of_nothing(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id = -1")
    docs.write.parquet(str(tmp_path / "none"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.parquet(str(tmp_path / "none")), sf_dir).count() == 0


def test_stages_keep_columns_of_made_names(spark, sf_dir, tmp_path):
    """A table's own columns come out as they were, whatever names the operators use inside."""
    clash = ["score", "KEPT", "n_words", "n_lines", "n_deleted", "n_shingles", "component_id", "first_of_group", "own_0"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").drop("n_chars")
    for name in clash:
        docs = docs.selectExpr("*", f"concat('{name}', doc_id) as `{name}`")
    docs.write.parquet(str(tmp_path / "docs"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, spark.read.parquet(str(tmp_path / "docs")), sf_dir)
        assert kept.schema == spark.read.parquet(str(tmp_path / "docs")).schema
        rows = kept.collect()
        assert rows and all(r[name] == f"{name}{r['doc_id']}" for r in rows for name in clash)
