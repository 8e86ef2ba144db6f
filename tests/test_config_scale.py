"""Configuration drift: only digests of the documents meet."""

import json

from test_similarity_scale import moved

from auditframe.operators import catalog


def test_documents_stay_where_they_are(spark):
    doc = lambda k, x: json.dumps({"config": {"k": k, "x": x, "text": f"{k} " * 2000}})
    stored = spark.createDataFrame([(k, doc(k, 1)) for k in range(60)] + [(60, "{"), (61, doc(1, 1)), (None, doc(1, 1))], "doc_id INT, document STRING")
    live = spark.createDataFrame([(k, doc(k, k % 2)) for k in range(60)] + [(60, doc(1, 1)), (None, doc(1, 1))], "doc_id INT, document STRING")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = catalog.config_drift(stored, live)
        got = [tuple(r) for r in df.collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = [(k, k % 2 == 0, False) for k in range(60)] + [(60, None, None), (61, None, None), (None, None, None), (None, None, None)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert moved(df) < 63 * 2 * 300


def test_lone_surrogates_are_no_pair(spark):
    text = lambda inside: '{"config": {"content": "' + inside + '"}}'
    pairs = [(r"\ud83d'\ude00", r"😀"), (r"😀", "😀"), ("a'", "a")]
    frames = [spark.createDataFrame([(k, text(p[side])) for k, p in enumerate(pairs)], "doc_id INT, document STRING") for side in (0, 1)]
    assert {r.doc_id: r.config_drifted for r in catalog.config_drift(*frames).collect()} == {0: True, 1: False, 2: False}
