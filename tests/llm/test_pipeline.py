"""The pipeline's decisions against plain ones, stage by stage."""

import re

import corpus_pipeline
import pytest
from test_similar import plain_kept

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.durable(stage(spark, docs, SF), name)
        out.append({r["doc_id"]: r for r in docs.collect()})
    return out


def test_stages_keep_the_columns_of_documents(spark, kept):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(list(r.asDict()) == columns for stage in kept for r in stage.values())


def test_each_stage_keeps_and_drops_what_it_should(spark, kept):
    source = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(kept[0]) == {i for i, r in source.items() if any(c.isalpha() for c in r["text"])}
    first = {}
    for i in sorted(kept[0]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", kept[0][i]["text"]), i)
    assert set(kept[1]) == set(first.values()) and len(kept[1]) < len(kept[0])
    assert set(kept[2]) == plain_kept({i: r["text"] for i, r in kept[1].items()}) and len(kept[2]) < len(kept[1])
    assert set(kept[3]) == set(kept[2])
    for i, r in kept[3].items():
        before = kept[2][i]["text"]
        assert r["text"] == before if not secrets(before) else "[SECRET]" in r["text"] and not secrets(r["text"])
    assert any("[SECRET]" in r["text"] for r in kept[3].values())


def secrets(text):
    """Whether a text holds one of the plain kinds of secrets."""
    assigned = re.findall(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.IGNORECASE | re.ASCII)
    return any(len(v) >= 12 for v in assigned) or any(len(v) >= 18 for v in re.findall("AKIA[A-Z0-9]+", text)) or any(len(v) >= 16 for v in re.findall("[0-9a-f]+", text))


def test_run(spark, kept):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(kept[3])


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
