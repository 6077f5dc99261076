"""Files, payloads, published tables and streams."""

import csv
import datetime as dt
import os
from pathlib import Path

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from larder.operators import people
from larder.plans import season
from larder.registry import inputs, queries
from larder.sources import published, sales
from larder.streaming import sales as sales_stream
from larder.streaming import signups as signup_stream
from larder.tables import Policy
from tests.conftest import SF, rows_of


def write(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write(text)


def test_csv_columns_are_bound_by_name(spark, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    write(one, "a.csv", "date,qty_sold,apples_start\n2023-01-01,25,100\n2023-01-02,x,75\n")
    write(one, "notes.txt", "not,a,sales,file\n")
    write(two, "b.CSV", "qty_sold,date\n30,2023-01-03\n31,someday\n")
    checked = sales.validate(sales.read_csv(spark, one, two))
    good = rows_of(sales.good_rows(checked).select("date", "qty_sold"), "date")
    assert good == [(dt.date(2023, 1, 1), 25.0), (dt.date(2023, 1, 3), 30.0)]
    bad = rows_of(sales.rejected_rows(checked).select("raw_date", "raw_qty", "error"), "raw_date")
    assert bad == [("2023-01-02", "x", "bad qty_sold"), ("someday", "31", "bad date")]


def test_mixed_layouts_below_one_path(spark, tmp_path):
    write(str(tmp_path / "mixed"), "a.csv", "date,qty_sold\n2023-01-01,25\n\n2023-01-02,\"2,6\"\n")
    write(str(tmp_path / "mixed"), "b.csv", "qty_sold, date ,note\r\n27,2023-01-03,\"say \"\"hi\"\"\"\r\n")
    write(str(tmp_path / "mixed"), "c.csv", "item,quantity\npie,3\n")
    found = sales.read_csv(spark, str(tmp_path / "mixed"))
    assert set(found.columns) == {"date", "qty_sold", "note", "item", "quantity"}
    assert sorted(map(str, found.select("date", "qty_sold", "note", "item").collect())) == sorted(map(str, [
        Row(date="2023-01-01", qty_sold="25", note=None, item=None), Row(date="2023-01-02", qty_sold="2,6", note=None, item=None),
        Row(date="2023-01-03", qty_sold="27", note='say "hi"', item=None), Row(date=None, qty_sold=None, note=None, item="pie"),
    ]))


def test_impossible_quantities_and_days_are_rejected(spark):
    rows = [("2024-01-01", "NaN"), ("2024-01-01", "Infinity"), ("2024-01-01", "-inf"), ("0001-01-01", "1"), ("9999-01-01", "1"), ("2024-01-01", "1")]
    checked = sales.validate(spark.createDataFrame(rows, "date string, qty_sold string"))
    assert [r["error"] for r in checked.collect()] == ["bad qty_sold"] * 3 + ["bad date"] * 2 + [None]


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="qty_sold.*item"):
        sales.validate(spark.createDataFrame([("2024-01-01", "pie", "1")], "date string, item string, quantity string"))


def test_payloads(spark):
    rows = [
        ("u1", "date,qty_sold\r\n2024-01-01,5\r\n\r\n2024-01-02,\"6\"\r\n"),
        ("u2", " qty_sold , date,extra\n7,2024-01-03,x\n"),
        ("u3", "date,item,quantity\n2024-01-04,pie,8\n"),
    ]
    payloads = spark.createDataFrame(rows, "upload string, csv_content string")
    checked = sales.validate(sales.payload_rows(payloads))
    good = rows_of(sales.good_rows(checked).select("upload", "date", "qty_sold"), "upload", "date")
    assert good == [
        ("u1", dt.date(2024, 1, 1), 5.0), ("u1", dt.date(2024, 1, 2), 6.0), ("u2", dt.date(2024, 1, 3), 7.0),
    ]
    assert [r["upload"] for r in sales.rejected_rows(checked).collect()] == ["u3"]


def test_wide_payloads_and_quoted_line_breaks(spark):
    header = [f"c{i}" for i in range(40)] + ["date", "qty_sold"]
    wide = ",".join(header) + "\n" + ",".join(["x"] * 40 + ["2024-01-01", "5"])
    quoted = 'note,date,qty_sold\n"two\nlines, ""one"" note",2024-01-02,6\n"",2024-01-03,7'
    payloads = spark.createDataFrame([("w", wide), ("q", quoted)], "upload string, csv_content string")
    good = sales.good_rows(sales.validate(sales.payload_rows(payloads)))
    assert rows_of(good.select("upload", "qty_sold"), "upload", "qty_sold") == [("q", 6.0), ("q", 7.0), ("w", 5.0)]
    fields = spark.createDataFrame([(quoted,)], "t string").select(sales.records(F.col("t"))).first()[0]
    assert fields[1][0] == 'two\nlines, "one" note' and fields[2][0] == ""


def daily(spark, rows):
    return spark.createDataFrame(
        [(s, dt.date(2024, 1, d), float(q)) for s, d, q in rows], "series string, date date, qty_sold double"
    )


def test_upsert_replaces_whole_series(spark, tmp_path):
    path = str(tmp_path / "sales")
    assert published.read_series(spark, path) is None
    published.upsert_series(daily(spark, [("a", 1, 1), ("a", 2, 2), ("b", 1, 3)]), path, published.BASE_ID, 4)
    for _ in range(2):  # the second run stands for a retried job
        published.upsert_series(daily(spark, [("a", 5, 9), ("c", 1, 4)]), path, "1", 4)
    found = published.read_series(spark, path).select("series", "qty_sold")
    assert rows_of(found, "series") == [("a", 9.0), ("b", 3.0), ("c", 4.0)]
    with pytest.raises(ValueError, match="4 buckets"):
        published.upsert_series(daily(spark, [("a", 5, 9)]), path, "2", 8)


def test_latest_snapshot(spark, tmp_path):
    path = str(tmp_path / "plan")
    assert published.read_latest(spark, path) is None
    assert published.read_latest(spark, path, "series string").count() == 0
    published.publish(daily(spark, [("a", 1, 1)]), path, "2024-01-01")
    published.publish(daily(spark, [("a", 1, 2)]), path, "2024-01-02")
    daily(spark, [("a", 1, 3)]).write.parquet(f"{path}/snapshot=2024-01-03")  # never logged
    assert published.read_latest(spark, path).first()["qty_sold"] == 2.0


def test_runs_publish_their_tables(spark, tmp_path, history):
    first = dt.date(2023, 10, 2)
    table = history({"a": (first, [20 + (i * 7) % 11 for i in range(120)]), "b": (first, [3, 4, 5])})
    out = str(tmp_path / "season")
    season.run_season(table, Policy(horizon_days=14), out, "r1")
    plan = published.read_latest(spark, f"{out}/plan")
    assert plan.groupBy("series").count().where("count = 14").count() == 2
    assert plan.where("apples_need <> qty_total * 3").count() == 0
    assert published.read_latest(spark, f"{out}/advisories").where("type LIKE 'BUY%'").count() > 0

    out = str(tmp_path / "weekly")
    season.run_weekly(table, Policy(horizon_days=14), "2023-12-20", out, "r1")
    plan = published.read_latest(spark, f"{out}/plan")
    assert {"signal_apples", "signal_dough", "dough_need", "window_start"} <= set(plan.columns)
    assert plan.count() == 28 and plan.select("window_end").distinct().count() == 2  # b's history ends earlier
    assert {r[0] for r in plan.select("series").distinct().collect()} == {"a", "b"}


def test_advisories_from_a_stored_plan(spark, tmp_path):
    days = [f"s,2026-01-{d:02d},{10 + d},{int(d == 7)},{-int(d == 11)}" for d in range(5, 12)]
    write(str(tmp_path / "plan_2026.csv"), "part.csv", "\n".join(["series,date,qty_sold,signal_apples,signal_dough", *days]))
    out = str(tmp_path / "out")
    season.run_advisories_from_plan(spark, str(tmp_path / "plan_2026.csv"), out, "r1", Policy())
    found = published.read_latest(spark, out).select("type", "date", "source")
    assert rows_of(found, "type") == [
        ("BUY_APPLES", "2026-01-05", "plan_2026"), ("SPECIAL_DOUGH", "2026-01-11", "plan_2026"),
    ]


def test_csv_export(spark, tmp_path, history):
    from larder.operators.exports import with_window, write_export

    table = history({"a": (dt.date(2024, 1, 1), [1, 2])})
    write_export(with_window(table), str(tmp_path / "out"), "window_start", "window_end")
    assert os.path.isdir(tmp_path / "out" / "window_start=2024-01-01" / "window_end=2024-01-02")


def test_streamed_drops_equal_one_batch(spark, tmp_path):
    drops, table = str(tmp_path / "in"), str(tmp_path / "sales")
    args = (table, str(tmp_path / "bad"), str(tmp_path / "state"))
    published.upsert_series(daily(spark, [("old", 1, 1), ("a", 9, 9)]), table, published.BASE_ID)
    write(drops, "1.csv", "series,date,qty_sold\na,2024-01-01,1\na,2024-01-01,2\na,oops,5\n")
    sales_stream.ingest(sales_stream.read_drops(spark, drops), *args).awaitTermination()
    write(drops, "2.csv", "series,date,qty_sold\nb,2024-01-02,4\n")
    write(drops, "3.csv", "series,date,qty_sold\nc,2024-01-02,x\n")
    sales_stream.ingest(sales_stream.read_drops(spark, drops), *args).awaitTermination()
    found = published.read_series(spark, table).select("series", "qty_sold")
    assert rows_of(found, "series") == [("a", 3.0), ("b", 4.0), ("old", 1.0)]
    rejected = spark.read.parquet(str(tmp_path / "bad"))
    assert rows_of(rejected.select("series", "error"), "series") == [("a", "bad date"), ("c", "bad qty_sold")]


def test_the_newest_upload_takes_one_exchange_by_day_and_one_by_series(spark):
    rows = [("a", "2024-01-01", 1.0, "u1"), ("a", "2024-01-02", 2.0, "u2"), ("a", "2024-01-02", 3.0, "u2"),
            ("b", "2024-01-01", 4.0, None), (None, "2024-01-01", 5.0, "u3")]
    newest = published.newest_upload(spark.createDataFrame(rows, "series string, date string, qty_sold double, upload string"))
    assert rows_of(newest, "series") == [("a", "2024-01-02", 5.0, "u2"), ("b", "2024-01-01", 4.0, "")]
    plan = newest._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan
    assert newest._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2


def test_iso_days_are_not_taken_apart(spark):
    texts = ["2024-01-02", "2024/1/2", "02.01.2024", None]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(sales.day_parts(F.col("t"))).collect()
    assert [r[0] for r in found] == [None, ["2024", "1", "2"], ["02", "01", "2024"], None]


def totals_of(spark, table):
    found = published.read_series(spark, table).groupBy("series").agg(F.sum("qty_sold").alias("qty"))
    return rows_of(found, "series")


@pytest.mark.parametrize("files_at_once", [1, 10])
def test_the_newest_upload_wins_whatever_the_batches(spark, tmp_path, files_at_once):
    drops, table = str(tmp_path / "in"), str(tmp_path / "sales")
    for k, (name, qty) in enumerate([("1.csv", 5), ("2.csv", 7)]):
        write(drops, name, f"series,date,qty_sold\na,2024-01-01,{qty}\nb{k},2024-01-01,1\n")
        os.utime(f"{drops}/{name}", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = sales_stream.read_drops(spark, drops, files_at_once)
    sales_stream.ingest(stream, table, str(tmp_path / "bad"), str(tmp_path / "state")).awaitTermination()
    assert totals_of(spark, table) == [("a", 7.0), ("b0", 1.0), ("b1", 1.0)]


def test_another_checkpoint_keeps_what_landed(spark, tmp_path):
    drops, table = str(tmp_path / "in"), str(tmp_path / "sales")
    for k in (1, 2):
        write(f"{drops}{k}", "x.csv", f"series,date,qty_sold\ns{k},2024-01-01,{k}\n")
        stream = sales_stream.read_drops(spark, f"{drops}{k}")
        sales_stream.ingest(stream, table, str(tmp_path / "bad"), str(tmp_path / f"state{k}")).awaitTermination()
    assert totals_of(spark, table) == [("s1", 1.0), ("s2", 2.0)]


def test_a_file_with_another_header_is_put_aside(spark, tmp_path):
    drops, table = str(tmp_path / "in"), str(tmp_path / "sales")
    write(drops, "1.csv", "qty_sold,series,date\n3,a,2024-01-01\n")
    write(drops, "2.csv", "item,date\npie,2024-01-01\n")
    stream = sales_stream.read_drops(spark, drops)
    sales_stream.ingest(stream, table, str(tmp_path / "bad"), str(tmp_path / "state")).awaitTermination()
    assert totals_of(spark, table) == [("a", 3.0)]
    bad = spark.read.parquet(str(tmp_path / "bad")).collect()
    assert [r["error"] for r in bad] == ["no series"] and bad[0]["file"].endswith("2.csv")


def signups(spark, rows):
    return spark.createDataFrame([(e, dt.datetime(2024, 1, d)) for e, d in rows], "email string, ts timestamp_ntz")


def test_signup_rules(spark):
    rows = signups(spark, [
        ("A@x.com", 2), ("a@X.com", 1), (" b@x.org\n", 3), ("c@x", 1), ("", 1), (None, 1), ("old@x.com", 1),
    ])
    known = spark.createDataFrame([("OLD@x.com",)], "email string")
    found = people.new_signups(rows, known).select("email_lc", "email")
    assert rows_of(found, "email_lc") == [("a@x.com", "a@X.com"), ("b@x.org", "b@x.org")]


def test_streamed_signups(spark, tmp_path):
    folder = str(tmp_path / "in")
    schema = signups(spark, []).schema

    def run():
        stream = spark.readStream.schema(schema).parquet(folder)
        signup_stream.register(stream, str(tmp_path / "t"), str(tmp_path / "state")).awaitTermination()

    signups(spark, [("A@x.com", 1), ("a@x.com", 1), ("bad", 1)]).write.parquet(folder)
    run()
    signups(spark, [("a@X.com", 9), ("n@x.com", 9)]).write.mode("append").parquet(folder)
    run()
    found = spark.read.parquet(str(tmp_path / "t")).select(F.lower("email"))
    assert sorted(r[0] for r in found.collect()) == ["a@x.com", "n@x.com"]
    late = str(tmp_path / "late")  # more than a day late, by a new checkpoint
    signups(spark, [("late@x.com", 1), ("n@X.com", 1)]).write.parquet(late)
    stream = spark.readStream.schema(schema).parquet(late)
    signup_stream.register(stream, str(tmp_path / "t"), str(tmp_path / "state2")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "t")).select(F.lower("email"))
    assert sorted(r[0] for r in found.collect()) == ["a@x.com", "late@x.com", "n@x.com"]


def test_contact_rules(spark):
    ts = dt.datetime(2024, 3, 5, 7, 8, 9)
    rows = [("", "", "", ts), (" n ", "", "m", ts), ("n", "x@y", " ", ts), ("n", "x@y", "m", ts), ("n", "x@y.z", " m ", ts)]
    checked = people.check_contacts(spark.createDataFrame(rows, "name string, email string, message string, ts timestamp_ntz"))
    assert [r["error"] for r in checked.collect()] == [
        "Name is required", "Email is required", "Message is required", "Please enter a valid email address", None,
    ]
    good = people.newest_first(checked.where("error IS NULL")).first()
    assert (good["id"], good["name"], good["message"]) == ("contact_20240305_070809", "n", "m")
    published_ids = checked.select("id").distinct().count()
    assert published_ids == 1


def test_appended_contacts_are_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("n", "x@y.z", "m", dt.datetime(2024, 1, 1))], "name string, email string, message string, ts timestamp_ntz")
    for _ in range(2):
        published.append_rows(people.accepted_contacts(rows), str(tmp_path / "contacts"))
    assert spark.read.parquet(str(tmp_path / "contacts")).count() == 2


# --- records across lines and splits -------------------------------------------------------------

MESSY = [
    ["2024-01-01", "plain", "1", "s1"], ["2024-01-02", "two\nlines", "2", "s1"], ["2024-01-03", 'a "quoted" word, and\n\n\nfour lines', "3", "s1"],
    ["2024-01-04", "\n", "4", "s2"], ["2024-01-05", '"', "5", "s2"], ["2024-01-06", "", "6", "s2"], ["2024-01-07", "x" * 300 + "\n" + "y" * 300, "7", "s2"],
]


def write_messy(folder, blank_lines="\n  \n\n"):
    folder.mkdir()
    wanted = []
    for number in range(3):
        with open(folder / f"f{number}.csv", "w", newline="") as out:
            out.write(blank_lines * (number != 1))
            writer = csv.writer(out, lineterminator="\n" if number else "\r\n")
            writer.writerow(["date", "note", "qty_sold", "series"])
            for k in range(40):
                row = [*MESSY[(k * (number + 1)) % len(MESSY)]]
                row[3] += f"-{number}-{k}"
                writer.writerow(row)
                wanted.append(tuple(row))
    return sorted(wanted)


@pytest.mark.parametrize("split", ["150", "1000", "128m"])
def test_records_are_the_same_at_any_split(spark, tmp_path, split):
    wanted = write_messy(tmp_path / "in")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0" if split != "128m" else "4m")
    try:
        found = sales.read_csv(spark, str(tmp_path / "in")).select("date", "note", "qty_sold", "series")
        assert sorted(map(tuple, found.collect())) == wanted
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_quote_without_its_pair_tears_no_other_record(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text('date,qty_sold,note\n2024-01-01,1,5" nails\n2024-01-02,2,ok\n2024-01-03,3,ok\n')
    (tmp_path / "in" / "b.csv").write_text("\n \n")
    checked = sales.validate(sales.read_csv(spark, str(tmp_path / "in")))
    assert sorted((str(r.date), r.qty_sold) for r in sales.good_rows(checked).collect()) == [
        ("2024-01-01", 1.0), ("2024-01-02", 2.0), ("2024-01-03", 3.0)]


def test_the_stream_reads_the_same_records(spark, tmp_path):
    wanted = write_messy(tmp_path / "drops")
    table, quarantine = str(tmp_path / "table"), str(tmp_path / "quarantine")
    sales_stream.ingest(sales_stream.read_drops(spark, str(tmp_path / "drops")), table, quarantine, str(tmp_path / "check")).awaitTermination()
    found = published.read_series(spark, table).select("date", "qty_sold", "series").collect()
    assert sorted((str(r.date), r.qty_sold, r.series) for r in found) == sorted((d, float(q), s) for d, _, q, s in wanted)
    assert spark.read.parquet(quarantine).count() == 0


# --- dates ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("given, day_first, wanted", [
    ("2024-01-02", None, "2024-01-02"), ("2024/1/2", None, "2024-01-02"), ("2024-01-02T10:00:00", None, "2024-01-02"), ("20240102", None, "2024-01-02"),
    ("13/02/2024", True, "2024-02-13"), ("02/13/2024", False, "2024-02-13"), ("1.2.2024", True, "2024-02-01"), ("1-2-2024 08:30", False, "2024-01-02"),
    ("03/03/2024", None, "2024-03-03"), ("01/02/2024", None, None), ("31/02/2024", True, None), ("2024-02-30", None, None), ("2024-13-01", None, None),
    ("2 Jan 2024", None, "2024-01-02"), ("02-January-2024", None, "2024-01-02"), ("Jan. 2, 2024", None, "2024-01-02"), ("Foo 2, 2024", None, None),
    ("2024", None, None), ("2024-01", None, None), ("1/2/24", True, None), ("1/2/24", False, None), ("", None, None), (None, None, None), ("12024-01-02", None, None),
])
def test_spellings(spark, given, day_first, wanted):
    row = spark.createDataFrame([(given, day_first)], "t string, f boolean").select(sales.parsed_day(F.col("t"), F.col("f")).alias("d")).first()
    assert (row.d and str(row.d)) == wanted


def test_styles_by_file(spark):
    files = {
        "uk": ["01/02/2024", "13/02/2024", "2024-05-06"], "us": ["01/02/2024", "02/13/2024"], "open": ["01/02/2024", "04/04/2024", "3 Mar 2024"],
        "both": ["13/02/2024", "02/13/2024", "01/02/2024"], None: ["25.12.2023", "01.02.2024"], "iso": ["2024-01-02", "2024", "32/01/2024"],
    }
    rows = [(f, text, "1") for f, texts in files.items() for text in texts]
    checked = sales.validate(spark.createDataFrame(rows, "file string, date string, qty_sold string"), by="file").collect()
    found = {(r.file, r.raw_date): (str(r.date) if r.date else None, r.error) for r in checked}
    assert len(checked) == len(rows)
    assert found["uk", "01/02/2024"] == ("2024-02-01", None) and found["us", "01/02/2024"] == ("2024-01-02", None)
    assert found[None, "01.02.2024"] == ("2024-02-01", None) and found["uk", "2024-05-06"] == ("2024-05-06", None)
    assert found["open", "01/02/2024"] == (None, "ambiguous date") and found["open", "04/04/2024"] == ("2024-04-04", None)
    assert found["both", "13/02/2024"] == found["both", "02/13/2024"] == ("2024-02-13", None)
    assert found["both", "01/02/2024"] == (None, "mixed date styles") and found["iso", "2024"] == (None, "bad date")
    assert found["iso", "32/01/2024"] == (None, "bad date")


def test_only_files_with_open_quotes_are_put_together(spark, tmp_path):
    """Files whose lines are records are read by the scan alone; one that spans lines doesn't change them."""
    (tmp_path / "a.csv").write_text('\n date ,note,qty_sold\n2024-01-01,"a, ""b""",1\n\n"  "\n2024-01-02,,2\n')
    plain = sales.read_csv(spark, str(tmp_path))
    assert "MapInArrow" not in plain._jdf.queryExecution().executedPlan().toString()
    wanted = [("2024-01-01", 'a, "b"', "1"), ("2024-01-02", "", "2")]
    assert [tuple(r) for r in plain.orderBy("date").collect()] == wanted
    (tmp_path / "b.csv").write_text('"date",qty_sold,note\n2024-01-03,3,"x\ny"\n')
    both = sales.read_csv(spark, str(tmp_path)).select("date", "note", "qty_sold")
    assert [tuple(r) for r in both.orderBy("date").collect()] == [*wanted, ("2024-01-03", "x\ny", "3")]


def test_files_do_not_grow_with_the_series(spark):
    """The quoted sales are written by task, each file opening with blank lines, and read back whole."""
    root = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(root.glob("quoted-*"))
    rows = queries.QUERIES["quoted_csv"](spark, SF)
    (folder,) = set(root.glob("quoted-*")) - before
    files = list(folder.rglob("part-*"))
    assert 1 <= len(files) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert all(file.read_text().startswith("\n\n  \ndate,note,qty_sold,series\n") for file in files)
    assert rows.count() == inputs.daily_sales(spark, SF).count()


def test_dated_files_follow_the_rows(spark, monkeypatch):
    """More rows give more files of every style, written by tasks of their own, and the same dates."""
    root = Path(spark.conf.get("spark.checkpoint.dir"))
    one = sorted(map(tuple, queries.QUERIES["dated_csv"](spark, SF).collect()), key=str)
    monkeypatch.setattr(queries, "ROWS_PER_DATED_FILE", 400)
    before = set(root.glob("dated-*"))
    more = sorted(map(tuple, queries.QUERIES["dated_csv"](spark, SF).collect()), key=str)
    (folder,) = set(root.glob("dated-*")) - before
    assert len(list(folder.rglob("part-*"))) > len(queries.DATE_STYLES)
    assert more == one
