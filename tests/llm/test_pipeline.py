import importlib.util
import os
import subprocess
import sys
from collections import Counter

import pytest

import corpus_pipeline
from auditframe.llm import decontaminate, gam, raking, sharding
from auditframe.llm._table import fold
from test_simhash import brute_groups, reference_fingerprint

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage returned, read again, after the documents themselves."""
    folder = tmp_path_factory.mktemp("stages")
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(str(folder / str(i)))
        out.append(spark.read.parquet(str(folder / str(i))))
    return out


def rows(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_all_but_the_last_return_documents(stages):
    assert all(s.columns == stages[0].columns and s.dtypes == stages[0].dtypes for s in stages[1:-1])
    assert set(stages[0].columns) < set(stages[-1].columns)
    sizes = [s.count() for s in stages]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2] > 20
    before = rows(stages[0])
    assert all(r.text == before[i].text and r.lang == before[i].lang for s in stages[1:] for i, r in rows(s).items())


def test_quality_keeps_what_the_model_accepts(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = gam.learn(stages[0], labels.filter(fold(labels.doc_id, 5) != 0))
    want = {r.doc_id for r in gam.score(stages[0], model).collect() if r.score >= 0.3}
    assert set(rows(stages[1])) == want
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    assert len(good & want) >= 0.97 * len(good)


def test_one_of_each_group_stays(stages):
    before = sorted(rows(stages[1]).values())
    groups = brute_groups([reference_fingerprint(r.text) for r in before], [r.doc_id for r in before])
    assert set(rows(stages[2])) == set(groups)


def test_leaking_documents_go(spark, stages):
    items = [decontaminate.plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = rows(stages[2]), rows(stages[3])
    for i, r in before.items():
        exact = any(x in decontaminate.plain(r.text) for x in items)
        near = exact or any(decontaminate.best_match(x, decontaminate.plain(r.text), len(x) // 10) for x in items) if i not in after else exact
        assert (i in after) != near


def test_the_mix_is_the_draw_and_shards_hold_it(stages):
    drawn = {r.doc_id for r in raking.mix(stages[3], corpus_pipeline.MIX).collect() if r.sampled}
    assert set(rows(stages[4])) == drawn
    last = stages[5].collect()
    assert {(r.doc_id, r.shard, r.slot) for r in last} == {(r.doc_id, r.shard, r.slot) for r in sharding.deal(stages[4]).collect()}
    sizes = Counter(r.shard for r in last)
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(corpus_pipeline.run(spark, SF).collect()) == sorted(stages[5].collect())


@pytest.mark.parametrize("step", range(5))
def test_stages_take_odd_and_empty_tables(spark, docs_of, step):
    odd = docs_of([None, "", " ", "12 34", "word " * 9000, "same text here", "same text here", (None, None, None, None, None), (5, "same text here", "en", "s", 1)])
    stage = corpus_pipeline.STAGES[step][1]
    extra = odd.selectExpr("*", "'a' AS score", "1 AS shard", "'b' AS _row", "'c' AS topic", "2 AS _key")
    got = stage(spark, extra, SF)
    assert got.count() <= 9
    if step < 4:
        assert got.columns == extra.columns
    assert stage(spark, odd.limit(0), SF).count() == 0


def test_the_library_works_without_this_subpackage(tmp_path):
    """Entry points still import, and their other queries remain, where the files of this subpackage are gone."""
    for name in os.listdir(ROOT):
        if name not in (".git", "corpus_pipeline.py", "auditframe", "tests"):
            os.symlink(f"{ROOT}/{name}", tmp_path / name) if name != "__spark_entry__.py" else (tmp_path / name).write_text(open(f"{ROOT}/{name}").read())
    os.mkdir(tmp_path / "auditframe")
    for name in os.listdir(f"{ROOT}/auditframe"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{ROOT}/auditframe/{name}", tmp_path / "auditframe" / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 160 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert importlib.util.find_spec("auditframe.llm")


def test_oracles_of_this_subpackage(spark):
    import duckdb

    from auditframe.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    for key, sql in ORACLES.items():
        got = QUERIES[key](spark, SF).toPandas()
        want = con.execute(sql).df()
        assert set(got.columns) == set(want.columns)
        got, want = (x[sorted(x.columns)].sort_values("doc_id").reset_index(drop=True) for x in (got, want))
        for c in got.columns:
            assert all(a == b or (a != a and b != b) or abs(a - b) < 2e-6 for a, b in zip(got[c], want[c], strict=True)), (key, c)
