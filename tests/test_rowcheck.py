import csv
import io

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sunloom.operators import rowcheck

RAW = "file_id string, line_no int, line string, cells string, reason int"


def bad(spark, files):
    data = [(f, i, line, "c", 0) for f, lines in files.items() for i, line in enumerate(lines, 1)]
    return {(r.file_id, r.line_no): r.reason for r in rowcheck.bad_lines(spark.createDataFrame(data, RAW)).collect()}


def test_reasons_in_order(spark):
    lines = [
        "﻿\"ts\",\"p\",status,note\r", "2022-01-01 00:00,1.5,3,\"a, \"\"b\"\"\nc\"\r", "2022-01-01T00:00:59, -1e3 ,,x", "2022-01-01 00:00,1,2,\"open", "2022-01-01 00:00,\"1\"7,2,x",
        "2022-01-01 00:00,1\"7,2,x", "2022-01-01 00:00,1,2", "", None, "2022-02-30 00:00,1,2,x", "2022-02-28 24:00,1,2,x", ",1,2,x", "2022-01-01 00:00,1_0,2,x", "2022-01-01 00:00,1,2.0,x",
        "2022-01-01 00:00,NaN,NA,", "2024-02-29 23:59,.5,+7,\"\"", "2022-01-01 00:00,\"1\" ,2,x", "2022-01-01 00:00,1,5,2,\"x", "1" * 200_000,
    ]
    got = bad(spark, {"f": lines})
    assert got == {("f", n): r for n, r in {4: "quoting", 5: "quoting", 6: "quoting", 7: "columns", 8: "columns", 9: "columns", 10: "value", 11: "value", 12: "value", 13: "value", 14: "value", 18: "quoting", 19: "columns"}.items()}


def test_delimiters_and_decimal_marks(spark):
    got = bad(spark, {"s": ["ts;a;b", "2022-01-01 00:00;1,5;2.5", "2022-01-01 00:00;1,5,2;2"], "t": ["ts\ta", "2022-01-01 00:00\t1.5", "2022-01-01 00:00\t1,5"], "c": ["ts,a", "2022-01-01 00:00,1.5"]})
    assert got == {("s", 3): "value", ("t", 3): "value"}


def test_file_without_header_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([("x", 2, "1,2", "", 0), ("y", 1, "ts,a", "", 0), ("y", 2, "no,1", "", 0), ("y", 2, "no,1", "", 0)], RAW)
    assert sorted((r.file_id, r.line_no, r.reason) for r in rowcheck.bad_lines(df).collect()) == [("x", 2, "columns"), ("y", 2, "value")]
    assert rowcheck.bad_lines(df.limit(0)).count() == 0


def test_clean_rows_are_the_rest(spark):
    df = spark.createDataFrame([("f", 1, "ts,a,note", "", 0), ("f", 2, '2022-01-01 00:00,NA,"x, ""y"""', "", 0), ("f", 3, "bad", "", 0)], RAW)
    got = rowcheck.clean_lines(df).collect()
    assert [(r.line_no, [tuple(v) for v in r["values"]]) for r in got] == [(2, [("ts", "2022-01-01 00:00"), ("a", None), ("note", 'x, "y"')])]
    cells = sorted(tuple(r) for r in rowcheck.loaded_cells(df).collect())
    assert cells == [("f", 2, 1, "ts", "2022-01-01 00:00"), ("f", 2, 2, "a", None), ("f", 2, 3, "note", 'x, "y"')]


def test_a_header_that_repeats_a_name_and_one_large_file(spark):
    df = spark.createDataFrame([("f", 1, "ts,a,a", "", 0), ("f", 2, "2022-01-01 00:00,1,2", "", 0), ("f", 3, "2022-01-31 00:00,1,x", "", 0)], RAW)
    assert [[tuple(v) for v in r["values"]] for r in rowcheck.clean_lines(df).collect()] == [[("ts", "2022-01-01 00:00"), ("a", "1"), ("a", "2")]]
    many = spark.range(2, 5002).selectExpr("'g' AS file_id", "CAST(id AS INT) AS line_no", "concat('2022-01-01 00:00,', if(id % 50 = 0, 'x', '1')) AS line", "'' AS cells", "0 AS reason")
    big = df.unionByName(spark.createDataFrame([("g", 1, "ts,a", "", 0)], RAW)).unionByName(many)
    assert rowcheck.bad_lines(big).groupBy("file_id").count().sort("file_id").collect() == [("f", 1), ("g", 100)]
    assert rowcheck.clean_lines(big).count() == 1 + 4900


def test_cells_as_the_csv_module_reads_them(spark):
    cell = st.text(st.sampled_from('ab",; \n'), max_size=6)
    batch = st.lists(st.lists(cell, min_size=1, max_size=4), min_size=20, max_size=40)

    @settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
    @given(batch)
    def run(table):
        out = []
        for row in table:
            f = io.StringIO()
            csv.writer(f, quoting=csv.QUOTE_ALL, lineterminator="").writerow(row)
            out.append((f.getvalue(), ",", row))
        df = spark.createDataFrame([(t, d, i) for i, (t, d, _) in enumerate(out)], "text string, delimiter string, i int")
        for r in rowcheck.parse_cells(df).collect():
            assert r.quoting_ok and list(r.cells) == out[r.i][2], out[r.i]

    run()


def test_quoting_as_a_state_machine_tells(spark):
    def well(line):
        state = "start"
        for c in line:
            if state == "start":
                state = "in" if c == '"' else "start" if c in ", " else "bare"
                if c == " ":
                    state = "blank"
            elif state == "blank":
                state = "in" if c == '"' else "start" if c == "," else "blank" if c == " " else "bare"
            elif state == "bare":
                if c == '"':
                    return False
                state = "start" if c == "," else "bare"
            elif state == "in":
                state = "quote" if c == '"' else "in"
            elif state == "quote":
                if c == '"':
                    state = "in"
                elif c in ", ":
                    state = "start" if c == "," else "after"
                else:
                    return False
            elif state == "after":
                if c not in ", ":
                    return False
                state = "start" if c == "," else "after"
        return state != "in"

    import itertools

    lines = ["".join(p) for n in range(7) for p in itertools.product('a", ', repeat=n)]
    df = spark.createDataFrame([(x, ",") for x in lines], "text string, delimiter string")
    for r in rowcheck.parse_cells(df).select("text", "quoting_ok").collect():
        assert r.quoting_ok == well(r.text), r.text


def test_clean_rows_without_file_or_number(spark):
    lines = [("f", 1, "ts,a"), ("f", None, "2022-01-01 00:00,1"), ("f", None, "2022-01-01 00:00,x"), ("f", 2, "2022-01-01 00:00,2"), (None, 1, "ts,a"), (None, 2, "2022-01-01 00:00,3")]
    df = spark.createDataFrame([(*r, "", 0) for r in lines], RAW)
    assert sorted((str(r.line_no), r["values"][1].value) for r in rowcheck.clean_lines(df).collect()) == [("2", "2"), ("None", "1")]
    assert {(r.file_id, r.line_no, r.reason) for r in rowcheck.bad_lines(df).collect()} == {("f", None, "value"), (None, 2, "columns")}
