"""Scorecard over large tables: columns are counted a batch at a time, tables are written as texts."""

import json
import random

from auditframe.operators import catalog

TEXTS = ["", None, "[]", '["Sales by", "region"]', "[bad", "number  field", "A useful text", "short", ["A list", "of fragments"], " Id field "]
NAMES = ["region", " Region ", "", None, "raw_x", "x_key\n", "etl_\nb", "Status", "status", "col_1", "id\r\n", "İd"]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def counted(tables):
    """(shown columns, told columns, told tables) by plain loops."""
    def told(text):
        text = " ".join(text) if isinstance(text, list) else "Sales by region" if text == TEXTS[3] else "" if text in (None, "[]") else text
        return text.strip(" ") in ("A useful text", "A list of fragments", "Sales by region")

    n = n_told = 0
    for t in tables:
        names = {}
        for k, c in enumerate(c for c in t.get("columns", []) + t.get("column_configs", []) if not c.get("exclude")):
            name = (c.get("column_name") or "").strip(" ") if c.get("column_name") is not None else ""
            names.setdefault(name.lower() or k, []).append(c.get("description"))
        n += len(names)
        n_told += sum(told(next((x for x in texts if x not in ("", None)), None)) for texts in names.values())
    return n, n_told, sum(told(t.get("description")) for t in tables)


def test_columns_are_counted_in_batches(spark):
    rng = random.Random(3)
    col = lambda: {"column_name": rng.choice(NAMES), "description": rng.choice(TEXTS), "exclude": rng.random() < 0.2}
    table = lambda: {"description": rng.choice(TEXTS), "columns": [col() for _ in range(rng.randrange(5))], "column_configs": [col()]}
    docs = [[table() for _ in range(rng.randrange(1, 4))] for _ in range(400)]
    rows = [(k, json.dumps({"data_sources": {"tables": t}}), None) for k, t in enumerate(docs)]
    df = catalog.scorecard(spark.createDataFrame(rows, "doc_id INT, document STRING, accuracy DOUBLE"))
    got = {(r.doc_id, r.check_no): r.severity for r in df.collect()}
    grade = lambda share, ok, full: "fail" if share < ok else "warning" if share < full else "pass"
    for k, tables in enumerate(docs):
        n, n_told, told_tables = counted(tables)
        assert got[k, 2] == grade(told_tables / len(tables), 0.8, 1.0), tables
        assert got[k, 3] == grade(n_told / n if n else 0.0, 0.5, 0.8), tables
    # Of the interpreted passes over columns that were, none is left.
    assert "array_sort" not in plan(df) and "rlike" not in plan(df).lower().split("explode")[0].split("described")[0]


def test_tables_are_written_as_texts(spark):
    from types import SimpleNamespace

    from auditframe.plans.catalog import _documents

    base = "doc_id BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_orderpriority STRING, l_linenumber INT, l_partkey BIGINT, l_quantity DOUBLE, l_discount DOUBLE, l_returnflag STRING, l_linestatus STRING"
    rows = [(1, 2, "O", "2-HIGH", 2, 7, 49.0, None, 'q"\\}', "O"), (1, 2, "O", "2-HIGH", 1, 7, 1.0, 0.05, "N", None), (1, 2, "O", "2-HIGH", 1, 7, None, 0.05, "A", "F")]
    inputs = SimpleNamespace(config_base=spark.createDataFrame(rows, base))
    stored, live = (_documents(inputs, live=x) for x in (False, True))
    flags = lambda exclude, match: {"exclude": exclude, "enable_entity_matching": match}

    def table(name, told, total, exclude, match, status):
        columns = [
            {"column_name": "order_total", "description": total} | flags(False, False), {"column_name": "etl_batch"} | flags(False, False),
            {"column_name": "load_key"} | flags(exclude, False), {"column_name": "region", "description": "Sales region name"} | flags(False, match),
            {"column_name": "Status"} | flags(False, False),
        ]
        config = {"column_name": "status"} | ({"description": status} if status else {}) | flags(False, False)
        return {"id": name, "name": name} | ({"description": told} if told else {}) | {"columns": columns, "column_configs": [config]}

    want = [
        table("tbl_7_1_0.05_A_F", "table", "number", True, False, "Status of the shipped line"),
        table("tbl_7_1_1.0_0.05_N", "Sales of part 7 by day", "number", True, False, "Status of the shipped line"),
        table('tbl_7_2_49.0_q"\\}_O', None, "Total value of the order", False, True, None),
    ]
    a, b = (json.loads(df.collect()[0].document) for df in (stored, live))
    assert a["data_sources"]["tables"] == want and list(a) == list(b)[::-1] == ["description", "data_sources", "instructions", "benchmarks"]
    assert b["data_sources"]["tables"] == [want[2], want[0], want[1]] and list(b["data_sources"]["tables"][0]) == ["column_configs", "columns", "name", "id"]
    assert a["benchmarks"] == b["benchmarks"] == {"questions": [{"id": "q001", "question": ["How much?"]}, {"id": "q002", "question": ["How much?"]}]}
    assert "named_struct(column_name" not in plan(stored) and "struct(column_name" not in plan(stored)
