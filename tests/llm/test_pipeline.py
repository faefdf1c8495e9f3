"""The pipeline stage by stage against plain versions, and the SQL twins."""

import os
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from gapseries.llm import decontaminate, quality
from gapseries.llm import queries as q
from gapseries.llm.common import materialize
from tests.conftest import SF001
from tests.llm.helpers import WORDS, clashing, odd_docs
from tests.llm.test_mixing import by_rank, plain_taken, plain_targets
from tests.llm.test_simhash import plain_components, plain_fingerprint

TABLES = ["documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def staged(spark):
    """The rows after each stage."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    out = [docs.collect()]
    for name, stage in cp.STAGES:
        docs = materialize(stage(spark, docs, SF001), "test-stage")
        out.append(docs.collect())
    return out


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_quality_stage(spark, staged):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF001}/labels.parquet").collect()}
    before, after = staged[0], staged[1]
    learned = sorted((r for r in before if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 5),
                     key=lambda r: r.doc_id)
    x = np.array([quality.statistics(r.text.encode()) for r in learned])
    forest = quality.fit(x, np.array([labels[r.doc_id] for r in learned], dtype=float))
    score = forest.score(np.array([quality.statistics(r.text.encode()) for r in before]))
    assert ids(after) == sorted(r.doc_id for r, s in zip(before, score) if s >= 0.3)


def test_dedup_stage(staged):
    before, after = staged[1], staged[2]
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in before]
    assert ids(after) == sorted(set(plain_components(rows)))


def test_decontamination_stage(spark, staged):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    bench = decontaminate.Benchmark(items)
    assert ids(staged[3]) == sorted(r.doc_id for r in staged[2] if not list(bench.leaks(r.text)))
    assert len(staged[3]) < len(staged[2])


def test_mixing_stage(staged):
    rows = [(r.doc_id, len(WORDS.findall(r.text)), r.source) for r in staged[3]]
    sizes = {}
    for _, n, s in rows:
        sizes[s] = sizes.get(s, 0) + n
    want = sorted(d for d, n, taken in plain_taken(rows, plain_targets(sizes, by_rank(sizes)))
                  for _ in range(taken // n if n else 0))
    sized = {d for d, n, _ in rows if n}
    assert [d for d in ids(staged[4]) if d in sized] == want
    assert staged[4][0].asDict().keys() == staged[0][0].asDict().keys()


def test_token_stage(staged):
    tokenizer = Tokenizer.from_file(q.tokenizer_path())
    want = []
    for r in staged[4]:
        found = [*tokenizer.encode(r.text, add_special_tokens=False).ids, q.END_ID]
        want.append((r.doc_id, len(found), zlib.crc32(np.array(found, "<u4").tobytes())))
    got = sorted(staged[5], key=lambda r: r.start)
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert [r.doc_id for r in got] == ids(got)


def test_run_is_the_stages(spark, staged):
    assert sorted(cp.run(spark, SF001).collect()) == sorted(staged[5])


def test_stages_take_odd_rows(spark):
    docs = materialize(clashing(odd_docs(spark)), "test-odd")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF001)
        assert out.columns == docs.columns, name
        out.collect()
        assert stage(spark, docs.where("false"), SF001).count() == 0
    assert cp.STAGES[-1][1](spark, docs, SF001).count() == docs.count()


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF001}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    con.execute(f"CREATE VIEW twin AS {q.SQL[name]}")
    got, want = q.QUERIES[name](spark, SF001).toPandas(), con.execute("SELECT * FROM twin").df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    # A whole-number column that holds a null comes as doubles from one side, as Int64 from the other.
    nullable = {c: "float64" for c in cols if str(want[c].dtype) == "Int64" and got[c].isna().any()}
    got, want = (d[cols].astype(nullable).sort_values(cols).reset_index(drop=True) for d in (got, want))
    pd.testing.assert_frame_equal(got, want)
