from __future__ import annotations

import pandas as pd
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerlane import schemas as S
from ledgerlane.functions import exprs as X
from ledgerlane.sources import readers, timeforms
from ledgerlane.sources.sinks import RunContext, Warehouse, stamp, write_csv, write_files


def test_missing_value_texts_match_those_of_a_pandas_reader(spark, tmp_path):
    cells = [*S.MISSING_TOKENS, " NA", "na", "O1", "none", "Null"]
    path = tmp_path / "orders.csv"
    lines = [f'"{c}",C,2024-01-01 00:00:00,1.5,EUR,completed' for c in cells]
    header = ",".join(S.RAW_ORDERS.fieldNames())
    path.write_text("\n".join([header, *lines]) + "\n")
    ours = readers.read_csv(spark, str(path), S.RAW_ORDERS).toPandas()["order_id"]
    theirs = pd.read_csv(path)["order_id"]
    assert ours.isna().tolist() == theirs.isna().tolist()
    assert ours.dropna().tolist() == theirs.dropna().tolist()


def test_columns_are_matched_by_name_and_numbers_typed(spark, tmp_path):
    path = tmp_path / "orders.csv"
    path.write_text(
        "currency,order_status,order_amount,order_id,customer_id,order_created_at\n"
        'EUR,completed,12.50,O1,"a ""b"", c",2024-01-01 00:00:00\n'
        "EUR,completed,nan,O2,,\n"
    )
    df = readers.read_csv(spark, str(path), S.RAW_ORDERS)
    assert df.schema.simpleString() == S.RAW_ORDERS.simpleString()
    first, second = df.orderBy("order_id").collect()
    assert (first.order_amount, first.customer_id) == (12.5, 'a "b", c')
    assert (second.order_amount, second.customer_id, second.order_created_at) == (
        None,
        None,
        None,
    )


def test_bad_input_fails_loudly(spark, tmp_path):
    with pytest.raises(PySparkException, match="PATH_NOT_FOUND"):
        readers.read_csv(spark, str(tmp_path / "none.csv"), S.RAW_ORDERS)
    lacking = tmp_path / "lacking.csv"
    lacking.write_text("order_id\nO1\n")
    with pytest.raises(PySparkException, match="customer_id"):
        readers.read_csv(spark, str(lacking), S.RAW_ORDERS)
    wrong = tmp_path / "wrong.csv"
    wrong.write_text(",".join(S.RAW_ORDERS.fieldNames()) + "\nO1,C1,t,many,EUR,completed\n")
    with pytest.raises(PySparkException, match="CAST_INVALID_INPUT"):
        readers.read_csv(spark, str(wrong), S.RAW_ORDERS).collect()


def test_parquet_nan_becomes_null_and_timestamps_stay(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.sql(
        "SELECT 'O1' order_id, 'C' customer_id, TIMESTAMP_NTZ '2024-01-01 00:00:00'"
        " order_created_at, double('NaN') order_amount, 'EUR' currency,"
        " 'completed' order_status, 1 extra"
    ).write.parquet(path)
    df = readers.read_parquet(spark, path, S.RAW_ORDERS)
    assert df.columns == S.RAW_ORDERS.fieldNames()
    assert dict(df.dtypes)["order_created_at"] == "timestamp_ntz"
    assert df.first()["order_amount"] is None


def test_unparseable_timestamps_become_null(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("soon",), (None,)], "t string")
    typed = readers.typed_timestamps(df, "t")
    assert dict(typed.dtypes)["t"] == "timestamp"
    assert typed.filter(F.col("t").isNull()).count() == 2


def test_replace_keep_and_append(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS sinks")
    warehouse = Warehouse(spark, "sinks")
    one, two = spark.range(1), spark.range(2)
    warehouse.write("t", one)
    warehouse.write("t", two, overwrite=False)
    assert warehouse.table("t").count() == 1
    warehouse.write("t", two)
    assert warehouse.table("t").count() == 2
    warehouse.append("t", one)
    assert warehouse.table("t").count() == 3
    assert warehouse.exists("t") and not warehouse.exists("u")
    with pytest.raises(LookupError, match="sinks.u"):
        warehouse.require("t", "u")

    path = str(tmp_path / "files")
    write_files(one, path)
    write_files(two, path, overwrite=False)
    assert spark.read.parquet(path).count() == 1


def test_csv_round_trip_keeps_missing_cells_and_quotes(spark, tmp_path):
    rows = [("O1", None, 'say "hi", you', -10.0, "EUR", None), (None, "C", None, None, "EUR", "x")]
    df = spark.createDataFrame(rows, S.RAW_ORDERS)
    write_csv(df, str(tmp_path / "out"), files=1)
    back = readers.read_csv(spark, str(tmp_path / "out"), S.RAW_ORDERS)
    assert sorted(back.collect(), key=str) == sorted(df.collect(), key=str)


def test_stamp_adds_the_run_context(spark):
    context = RunContext("messy", 5000, 42, "dev")
    row = stamp(spark.range(1), context).first()
    assert (row.dq_profile, row.n, row.seed, row.mode) == ("messy", 5000, 42, "dev")
    assert row.run_id == context.run_id and row.generated_at is not None


def csv(tmp_path, name, *lines):
    path = tmp_path / name
    path.parent.mkdir(exist_ok=True)
    path.write_text("\n".join(lines) + "\n")
    return str(path)


HEADER = ",".join(S.RAW_ORDER_EVENTS.fieldNames())


def test_files_of_one_path_must_share_their_header(spark, tmp_path):
    turned = "order_id,event_id,event_type,event_timestamp,source_system"
    one = csv(tmp_path, "one/a.csv", HEADER, "E1,O1,order_created,t,web")
    two = csv(tmp_path, "two/b.csv", turned, "O2,E2,order_created,t,web")
    both = tmp_path / "both"
    both.mkdir()
    for p in (one, two):
        (both / p.rsplit("/", 1)[1]).write_text(open(p).read())
    with pytest.raises((PySparkException, Py4JJavaError)):
        readers.read_csv(spark, str(both), S.RAW_ORDER_EVENTS).collect()
    united = readers.read_csv(spark, [one, two], S.RAW_ORDER_EVENTS)
    assert sorted((r.event_id, r.order_id) for r in united.collect()) == [("E1", "O1"), ("E2", "O2")]


@pytest.mark.parametrize("row", ["E1,O1,order_created,t", "E1,O1,order_created,t,web,more", '"a\nb",O1,order_created,t,web'])
def test_rows_with_another_number_of_cells_fail(spark, tmp_path, row):
    path = csv(tmp_path, "x.csv", HEADER, row)
    with pytest.raises((PySparkException, Py4JJavaError)):
        readers.read_csv(spark, path, S.RAW_ORDER_EVENTS).select("event_id").collect()


def test_line_breaks_inside_quotes(spark, tmp_path):
    path = csv(tmp_path, "x.csv", HEADER, '"a\nb",O1,order_created,t,web')
    rows = readers.read_csv(spark, path, S.RAW_ORDER_EVENTS, multi_line=True).collect()
    assert [r.event_id for r in rows] == ["a\nb"]


ROWS = [
    "E1,O1,order_created,t,web",
    "E2,O2,order_created",
    "E3,O3,order_created,t,web,",
    "E4,O4,order_created,t,web,x,y",
    'E5,"O5,order_created,t,web',
    '"E,6",O6,order_created,t,',
    "E7",
]


@pytest.mark.parametrize("pad", [False, True])
def test_rows_that_do_not_fit_are_set_aside(spark, tmp_path, pad):
    path = csv(tmp_path, "x.csv", HEADER, *ROWS)
    found = readers.read_csv_checked(spark, path, S.RAW_ORDER_EVENTS, pad_short=pad)
    short = {ROWS[1]: "too few cells", ROWS[6]: "too few cells"}
    expected = {ROWS[2]: "too many cells", ROWS[3]: "too many cells", ROWS[4]: "open quote"} | ({} if pad else short)
    rejected = found.rejected.collect()
    assert {r["line"]: r["reason"] for r in rejected} == expected and len(rejected) == len(expected)
    assert {r["source_file"].rsplit("/", 1)[1] for r in rejected} == {"x.csv"}
    rows = {r.event_id: tuple(r)[1:] for r in found.rows.collect()}
    whole = {"E1": ("O1", "order_created", "t", "web"), "E,6": ("O6", "order_created", "t", None)}
    padded = {"E2": ("O2", "order_created", None, None), "E7": (None, None, None, None)}
    assert rows == whole | (padded if pad else {})


def test_numbers_that_are_none_are_set_aside(spark, tmp_path):
    lines = ["O1,C,t,1.5,EUR,completed", "O2,C,t,much,EUR,completed", "O3,C,t,NA,EUR,completed"]
    path = csv(tmp_path, "x.csv", ",".join(S.RAW_ORDERS.fieldNames()), *lines)
    found = readers.read_csv_checked(spark, [path, path], S.RAW_ORDERS)
    assert sorted((r.order_id, r.order_amount) for r in found.rows.collect()) == [("O1", 1.5)] * 2 + [("O3", None)] * 2
    assert [(r.line, r.reason) for r in found.rejected.collect()] == [(lines[1], "no number")] * 2


FORM_TEXTS = {
    "iso": ["2024-01-02 03:04:05", "2024-01-02T03:04:05Z", "2024-13-02 03:04:05"],
    "month_first": ["01/02/2024 03:04:05", "12/31/2024", "13/2/2024"],
    "day_first": ["2/1/2024 03:04:05", "31/12/2024 23:59", "32/1/2024"],
    "day_first_dots": ["2.1.2024 03:04:05", "31.12.2024", "1.13.2024"],
    "day_first_dashes": ["2-1-2024 3:04:05", "31-12-2024 00:00:00.5", "1-13-2024"],
    "year_first_slashes": ["2024/1/2 03:04:05", "2024/12/31", "2024/13/1"],
    "compact": ["20240102 030405", "20241231", "20241301"],
    "month_name": ["Jan 2, 2024 03:04:05", "Dec 31, 2024", "Foo 1, 2024"],
}


@pytest.mark.parametrize("form", list(FORM_TEXTS))
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_the_form_that_most_values_fit_is_found(spark, form, zone):
    good, other, bad = FORM_TEXTS[form]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = timeforms.infer_times(spark.createDataFrame([(good,), (other,), (bad,), (None,), ("soon",)], "t string"), "t")
        assert df.schema["t"].metadata == {X.TIME_FORM: form}
        rows = df.select("t", X.lenient_wall_time(df, "t").cast("string").alias("w"), X.lenient_instant(df, "t").isNull().alias("none")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [r["w"] for r in rows][0] == "2024-01-02 03:04:05"
    assert [r["none"] for r in rows] == [False, False, True, True, True]


def test_forms_in_doubt_and_unknown_forms(spark):
    df = spark.createDataFrame([("01/02/2024", 1), ("3/4/2024", 2)], "t string, n int")
    assert timeforms.infer_forms(df, ["t", "n"]) == {"t": "month_first"}
    assert timeforms.infer_forms(df.limit(0), ["t"]) == {"t": "iso"}
    declared = timeforms.declare_times(df, {"t": "day_first"})
    typed = readers.wall_times(declared.filter("n > 0").select("t"), "t")
    assert [str(r.t) for r in typed.collect()] == ["2024-02-01 00:00:00", "2024-04-03 00:00:00"]
    with pytest.raises(ValueError, match="unknown time form"):
        timeforms.declare_times(df, {"t": "roman"})


def test_partitions_are_replaced_one_by_one(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS parts")
    warehouse = Warehouse(spark, "parts")
    warehouse.write_parts("t", spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "p string, n int"), "p")
    warehouse.write_parts("t", spark.createDataFrame([(5, "b"), (6, "b"), (7, "c")], "n int, p string"), "p")
    assert sorted(map(tuple, warehouse.table("t").select("p", "n").collect()), key=str) == [("a", 1), ("b", 5), ("b", 6), ("c", 7), (None, 3)]
    warehouse.drop_parts("t", "p", ["b", "z"])
    assert warehouse.table("t").count() == 3
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"
