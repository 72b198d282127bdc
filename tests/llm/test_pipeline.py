"""The pipeline and each of its stages on awkward rows, and the registration."""
import random
from pathlib import Path
from urllib.parse import urlparse

import corpus_pipeline as C
import pytest

import __spark_entry__ as E
from llm.helpers import empty_documents, odd_documents
from tabsight.llm import queries
from tabsight.session import ensure_checkpoint_dir


@pytest.mark.parametrize("name,stage", C.STAGES)
def test_stage_on_odd_and_empty_rows(spark, name, stage):
    docs = odd_documents(spark)
    out = stage(spark, docs, "")
    rows = out.collect()
    assert rows
    if name != C.STAGES[-1][0]:
        assert out.columns == docs.columns
    assert stage(spark, empty_documents(spark), "").collect() == []


@pytest.mark.parametrize("name,stage", C.STAGES[1:4])
def test_stage_leaves_no_texts_on_disk(spark, tmp_path, name, stage):
    """What a stage writes to the scratch folder stays there while later stages shuffle."""
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(4000)) for _ in range(60)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)

    def held() -> int:
        top = Path(urlparse(ensure_checkpoint_dir(spark)).path)
        return sum(p.stat().st_size for p in top.rglob("*") if p.is_file())

    before, size = held(), sum(p.stat().st_size for p in Path(path).rglob("*.parquet"))
    assert len(stage(spark, spark.read.parquet(path), "").collect()) >= len(rows)
    assert size > 500_000 and held() - before < 0.2 * size


def test_near_duplicates_keeps_one_of_equal_rows(spark):
    """Equal rows, rows that share an id and rows without one: one of each group stays, whole."""
    one, two = "the quick brown fox jumps over the lazy dog again and again", "nothing like the other text at all, not a single run"
    rows = [(1, one, "en", "a"), (1, one, "en", "a"), (1, one, "fr", "b"), (None, one, "en", "a"), (2, one, "en", "a"),
            (None, two, "en", "a"), (None, two, "en", "a"), (1, "a third text under the first id, with words of its own", "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    out = [tuple(r) for r in C.near_duplicates(spark, docs, "").collect()]
    assert sorted(map(repr, ((r[0], r[1]) for r in out))) == sorted(map(repr, [(1, one), (None, two), (1, rows[-1][1])]))
    assert set(out) <= set(rows)


def test_pipeline_runs_in_order(spark, tmp_path):
    odd_documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    rows = C.run(spark, str(tmp_path)).collect()
    assert rows and all(len(r["ids"]) == r["n_tokens"] > 0 for r in rows)
    ids = {r["doc_id"] for r in rows}
    assert 5 not in ids and 21 not in ids          # too short, repeated words
    assert not {6, 7} <= ids                       # exact copies
    assert [n for n, _ in C.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "source_mix", "token_ids"]


def test_queries_are_registered():
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in queries.QUERIES) == 1
    assert set(queries.QUERIES) | {"pipeline"} <= set(E.queries())
    assert set(queries.SQL) <= set(queries.QUERIES)
