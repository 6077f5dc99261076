"""Sales input: CSV folders, CSV text inside records, and row validation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.session import settle
from larder.tables import REQUIRED_SALES_COLUMNS

CSV_FILES = "*.[cC][sS][vV]"
FIRST_DAY, LAST_DAY = "1900-01-01", "2199-12-31"


# Stand for line and field ends while quoted text is set apart; noncharacters, in no valid text.
LINE_END, FIELD_END = "\ufdd0", "\ufdd1"


def records(text: Column) -> Column:
    """CSV text -> array of records, each an array of fields of any number.

    Between quotes line ends and commas are text, and two quotes are one. Cut at the quotes,
    every second part is quoted; an empty part between two quoted ones is a doubled quote.
    """
    parts = F.split(text, '"')
    plain = F.transform(parts, lambda part, i: F.when(i % 2 == 1, part).when(
        (part == "") & (i > 0) & (i < F.size(parts) - 1), '"'
    ).otherwise(F.replace(F.regexp_replace(part, r"\r\n|\r|\n", LINE_END), F.lit(","), F.lit(FIELD_END))))
    return F.transform(F.split(F.array_join(plain, ""), LINE_END), lambda line: F.split(line, FIELD_END))


def one_record(text: Column) -> Column:
    """The fields of a single record. Most have no quotes: their commas are all there is to it."""
    quoted = text.contains('"') | text.contains("\n") | text.contains("\r")
    return F.when(quoted, records(text)[0]).otherwise(F.split(text, ","))


def is_blank(record: Column) -> Column:
    return (F.size(record) == 1) & (F.btrim(record[0]) == "")


def names_of(record: Column) -> Column:
    """A header record's names."""
    return F.transform(record, lambda c: F.btrim(c))


def field(header: Column, record: Column, name: str) -> Column:
    """The record's field below one of the header's names; null where it lacks this name."""
    at = F.array_position(header, name)
    return F.when(at > 0, F.get(record, (at - 1).cast("int")))


def scanned(lines: DataFrame) -> DataFrame:
    """Adds each line's place in its block, its quotes' parity, that of the quotes ahead of it, and
    how many lines so far have an even (odd) number of quotes ahead. Blocks are read in order,
    so this is one pass over the rows where they are."""
    schema = T.StructType([*lines.schema, *T.StructType.fromDDL("at bigint, own int, ahead int, evens bigint, odds bigint")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, state = None, (0, 0, 0, 0)
        for batch in batches:
            if not len(batch):
                continue
            quotes = pc.fill_null(pc.count_substring(batch.column("value"), '"'), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            file, start = batch.column("file"), batch.column("block_start")
            same = pc.and_(pc.equal(file[1:], file[:-1]), pc.equal(start[1:], start[:-1])).to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero(~same) + 1)]
            out = np.zeros((5, len(batch)), np.int64)
            for begin, end in zip(starts, [*starts[1:], len(batch)], strict=True):
                key = (file[int(begin)].as_py(), start[int(begin)].as_py())
                if key != block:
                    block, state = key, (0, 0, 0, 0)
                at, before, evens, odds = state
                own = quotes[begin:end]
                ahead = (before + np.cumsum(own) - own) % 2
                even, odd = evens + np.cumsum(ahead == 0), odds + np.cumsum(ahead == 1)
                out[:, begin:end] = at + np.arange(end - begin), own % 2, ahead, even, odd
                state = (at + end - begin, before + int(own.sum()), int(even[-1]), int(odd[-1]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(x, kind) for x, kind in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True))],
                names=schema.names)

    return lines.mapInArrow(run, schema)


def whole_records(lines: DataFrame, files: DataFrame) -> DataFrame:
    """lines(value, file, block_start) -> the same columns and `at`, a row per record of the given files.

    A record ends at a line end with an even number of quotes before it in its file. The parity at a
    block's start is that of all quotes in the file's blocks before, so however files are
    split, records are the same. Lines that are records by themselves stay where they are;
    only those of longer records are gathered. Should a file's quotes not pair up, no record of it
    can be told to span lines: each line is one then.
    """
    others = [c for c in lines.columns if c not in ("value", "file", "block_start")]
    # only then, as a join may change the order
    rows = scanned(lines).join(files.select("file"), "file", "left_semi")
    here = rows.groupBy("file", "block_start").agg(
        F.sum("own").alias("quotes"), F.max("evens").alias("evens"), F.max("odds").alias("odds"))
    before = Window.partitionBy("file").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    odd = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2
    sized = here.withColumn("unpaired", F.sum("quotes").over(Window.partitionBy("file")) % 2 == 1).withColumn(
        "odd", F.when(F.col("unpaired"), 0).otherwise(odd)).withColumn("records", F.when(F.col("odd") == 1, F.col("odds")).otherwise(F.col("evens")))
    open_at = F.last(F.when(F.col("records") > 0, F.struct("block_start", "records")), ignorenulls=True).over(before)
    blocks = settle(sized.withColumn("open_at", open_at).select(
        F.col("file").alias("b_file"), F.col("block_start").alias("b_start"), "odd", "unpaired", "open_at"), "blocks")
    same = (F.col("file") == F.col("b_file")) & (F.col("block_start") == F.col("b_start"))
    # few blocks are out of the ordinary: all others start between records
    known = rows.join(blocks.where("odd = 1 OR unpaired").select("b_file", "b_start", "odd", "unpaired"), same, "left")
    starts = (F.col("ahead") + F.coalesce("odd", F.lit(0))) % 2 == 0
    alone = F.coalesce("unpaired", F.lit(False)) | (starts & (F.col("own") == 0))
    columns = ["file", "block_start", "at", "value", *others]
    single = known.where(alone).select(*columns)
    number = F.when(F.coalesce("odd", F.lit(0)) == 1, F.col("odds")).otherwise(F.col("evens"))
    parts = known.where(~alone).withColumn("number", number).drop("b_file", "b_start", "odd", "unpaired").join(
        blocks.select("b_file", "b_start", "open_at"), same)
    record = F.when(F.col("number") > 0, F.struct("block_start", F.col("number").alias("records"))).otherwise(F.col("open_at"))
    gathered = parts.withColumn("record", record).groupBy("file", "record").agg(
        F.sort_array(F.collect_list(F.struct("block_start", "at", "value"))).alias("l"), *[F.any_value(c).alias(c) for c in others])
    joined = gathered.select(
        "file", F.col("l")[0]["block_start"].alias("block_start"), F.col("l")[0]["at"].alias("at"), F.array_join("l.value", "\n").alias("value"), *others)
    return single.unionByName(joined)


def first_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines with their place `at` in reading order, and files(file, spans, head): whether a line
    holds an odd number of quotes, so that records may span lines, and the first line that isn't blank.

    One row per file, settled, so that its size is known wherever it is joined.
    """
    placed = lines.withColumn("at", F.monotonically_increasing_id())
    value = F.col("value")
    odd = value.contains('"') & ((F.length(value) - F.length(F.translate(value, '"', ""))) % 2 == 1)
    blocks = placed.groupBy("file", "block_start").agg(
        F.max(odd.cast("int")).alias("odd"), F.min(F.when(F.btrim(value) != "", F.col("at"))).alias("at"))
    place = F.when(F.col("at").isNotNull(), F.struct("block_start", "at"))
    files = blocks.groupBy("file").agg((F.max("odd") == 1).alias("spans"), F.min(place).alias("head"))
    return placed, settle(files, "files")


def with_heads(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lines(value, file, block_start) -> (records, heads): the records in `value` with their place in
    the file, and heads(file, head, header), the names in each file's first record that isn't blank, parsed once.

    Only files whose records may span lines are put together; in all others a line is a record.
    """
    rows, files = first_lines(lines)
    long = files.where("spans")
    if not long.isEmpty():
        plain = rows.join(files.where("NOT spans").select("file"), "file", "left_semi")
        columns = ["file", "block_start", "at", *(c for c in lines.columns if c not in ("file", "block_start"))]
        # headers, rows and every later reader take the records from here: gathering them is the costly part
        joined = settle(whole_records(lines, long).where(F.btrim("value") != "").select(*columns), "records")
        place = F.struct("block_start", "at")
        # the first record of a block is the only one that can be the file's first
        first = joined.groupBy("file", "block_start").agg(F.min("at").alias("at")).groupBy("file").agg(F.min(place).alias("head"))
        files = settle(files.where("NOT spans").select("file", "head").unionByName(first), "files")
        rows = plain.select(*columns).unionByName(joined)
    at_head = F.struct("block_start", "at") == F.col("head")
    heads = rows.join(files.select("file", "head"), "file").where(at_head).select("file", "head", names_of(one_record(F.col("value"))).alias("header"))
    return rows, settle(heads, "heads")


def with_own_header(lines: DataFrame, found: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """lines(value, file, block_start) -> (file, header, record), the header records left out.

    A file's header is its first record that isn't blank. `found` is what `with_heads` gives for the lines.
    """
    rows, heads = found or with_heads(lines)
    body = rows.where(F.btrim("value") != "").join(heads, "file").where(F.struct("block_start", "at") != F.col("head"))
    # exploded, as filters and columns would else each parse the record anew
    parsed = body.select(*(c for c in lines.columns if c != "value"), "header", F.explode(F.array(one_record(F.col("value")))).alias("record"))
    return parsed.where(~is_blank(F.col("record")))


def file_lines(reader, *paths: str, glob: str = CSV_FILES) -> DataFrame:
    """Lines of CSV files with their file, its time and the place of their block."""
    text = reader.option("pathGlobFilter", glob).text(list(paths) if len(paths) > 1 else paths[0])
    return text.select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block_start"),
        F.col("_metadata.file_modification_time").alias("written"))


def read_csv(spark: SparkSession, *paths: str, file: str | None = None, glob: str = CSV_FILES) -> DataFrame:
    """CSV files as strings, columns bound by each file's own header.

    Layouts may differ from file to file; the result has the columns of all of them, null
    where a file lacks one, and the file's path under the name `file`, if given. The headers
    that occur are few and are looked at first.
    """
    lines = file_lines(spark.read, *paths, glob=glob)
    found = with_heads(lines)
    rows = with_own_header(lines, found)
    layouts = found[1].select("header").distinct().collect()
    names = dict.fromkeys(name for row in sorted(layouts, key=lambda r: r["header"]) for name in row["header"])
    of_file = [F.col("file").alias(file)] if file else []
    return rows.select(*[field(F.col("header"), F.col("record"), name).alias(name) for name in names], *of_file)


def check_columns(columns: list[str], required=REQUIRED_SALES_COLUMNS) -> None:
    missing = [c for c in required if c not in columns]
    if missing:
        raise ValueError(f"the sales table lacks {', '.join(missing)}; it has {', '.join(columns)}")


def payload_rows(payloads: DataFrame, content: str = "csv_content") -> DataFrame:
    """CSV text in a column -> one row per record, (*other columns, line, date, qty_sold).

    Every payload's own header binds its columns by name. A payload without a required
    column yields rows whose value is null there, for `validate` to reject.
    """
    others = [c for c in payloads.columns if c != content]
    parsed = payloads.select(*others, records(F.col(content)).alias("_records"))
    body = parsed.select(
        *others, names_of(F.col("_records")[0]).alias("_header"),
        F.posexplode(F.slice("_records", 2, F.size("_records"))).alias("line", "_record"),
    ).where(~is_blank(F.col("_record")))
    values = [field(F.col("_header"), F.col("_record"), c).alias(c) for c in REQUIRED_SALES_COLUMNS]
    return body.select(*others, "line", *values)


ISO_DAY = r"^\d{4}-\d{2}-\d{2}$"
# Day, month and year in every order, with the parts of a time behind them.
PARTED = r"^\s*(\d{1,4})[-/.](\d{1,2})[-/.](\d{1,4})(?:[T ].*)?$"
PACKED = r"^\s*(\d{4})(\d{2})(\d{2})\s*$"
DAY_MONTH = r"^\s*(\d{1,2})[ -]([A-Za-z]{3})[A-Za-z]*\.?[ ,-]+(\d{4})\s*$"
MONTH_DAY = r"^\s*([A-Za-z]{3})[A-Za-z]*\.? (\d{1,2}),? +(\d{4})\s*$"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def day_parts(text: Column) -> Column:
    """The three numbers of a PARTED text in their order; null for other texts, and for ISO days, which need none."""
    return F.when(~text.rlike(ISO_DAY) & text.rlike(PARTED), F.slice(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)), 1, 3))


def numeric_parts(parts: Column) -> tuple[Column, Column, Column]:
    """The two parts of a day/month pair before a year of four digits; null for others."""
    fits = (F.length(parts[2]) == 4) & (F.length(parts[0]) <= 2)
    return tuple(F.when(fits, parts[i].try_cast("int")) for i in range(3))


def parsed_day(text: Column, day_first: Column, parts: Column | None = None) -> Column:
    """A date with year, month and day in a usual spelling.

    Of two numbers before a year one above 12 is the day. Where both could be, `day_first` tells, and
    null leaves the date open. A text without all three parts is no date. `parts` are the text's
    `day_parts`, if they are at hand. No text has two of these forms; each row goes into one branch that brings
    its parts in order, and the date is made once behind them.
    """
    parts = day_parts(text) if parts is None else parts
    first, second, _ = numeric_parts(parts)
    by_year = (F.length(parts[0]) == 4) & (F.length(parts[2]) <= 2)
    day_ahead = (first == second) | (first > 12) | (day_first & (second <= 12))
    numbers = F.when(by_year, parts).when(day_ahead, F.reverse(parts)).when(
        first.isNotNull() & ((second > 12) | ~day_first), F.array(parts[2], parts[0], parts[1]))

    def named(pattern: str, day: int, month: int) -> Column:
        number = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(text, pattern, month)))
        return F.array(F.regexp_extract(text, pattern, 3), number.cast("string"), F.regexp_extract(text, pattern, day))

    ordered = F.when(text.rlike(ISO_DAY), F.split(text, "-")).when(parts.isNotNull(), numbers).when(
        text.rlike(PACKED), F.array(*(F.regexp_extract(text, PACKED, i) for i in (1, 2, 3)))).when(
        text.rlike(DAY_MONTH), named(DAY_MONTH, 1, 2)).when(text.rlike(MONTH_DAY), named(MONTH_DAY, 2, 1))
    # a part that is missing leaves too short a text, which is no date
    return F.concat_ws("-", *(F.lpad(ordered[i], 4 if i == 0 else 2, "0") for i in range(3))).try_cast("date")


def date_styles(raw: DataFrame, by: str, column: str = "date") -> DataFrame:
    """(by, day_first, mixed): how each file writes day and month, by all its rows.

    A first number above 12 says day first, a second one above 12 month first. Rows are counted where
    they are; one row per file is left. `day_first` is null without a vote or with votes for
    both, which is `mixed`.
    """
    first, second, _ = numeric_parts(F.col("_parts"))
    days = F.count_if((first > 12) & (first <= 31) & (second <= 12))
    months = F.count_if((second > 12) & (second <= 31) & (first <= 12))
    votes = raw.select(by, day_parts(F.col(column)).alias("_parts")).groupBy(by).agg(days.alias("_days"), months.alias("_months"))
    mixed = (F.col("_days") > 0) & (F.col("_months") > 0)
    style = F.when(~mixed & (F.col("_days") + F.col("_months") > 0), F.col("_days") > 0)
    return votes.select(by, style.alias("day_first"), mixed.alias("mixed"))


def validate(raw: DataFrame, first_day: str = FIRST_DAY, last_day: str = LAST_DAY, by: str | None = None) -> DataFrame:
    """Type the required columns and add `error`, null for good rows.

    Dates need year, month and day. Which of two numbers before a year is the day is told per value
    of the column `by` (a file's name); where its rows don't tell, or without `by`, such dates are
    ambiguous. Days outside the range are bad dates: gap filling would stretch a series to them.
    Quantities have to be finite. The raw strings stay in `raw_date` and `raw_qty` for
    the quarantine table.
    """
    check_columns(raw.columns)
    named = raw.withColumnsRenamed({"date": "raw_date", "qty_sold": "raw_qty"})
    if by is None:
        styled = named.withColumns({"day_first": F.lit(None).cast("boolean"), "mixed": F.lit(False)})
    else:
        # one row per file, settled: of known size, so that no row moves to its file's task
        styles = settle(date_styles(raw, by).withColumnRenamed(by, "_by"), "styles")
        styled = named.join(styles, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")
    typed = styled.withColumn("_parts", day_parts(F.col("raw_date"))).withColumns({
        "date": parsed_day(F.col("raw_date"), F.col("day_first"), F.col("_parts")),
        "qty_sold": F.col("raw_qty").try_cast("double"),
    })
    first, second, _ = numeric_parts(F.col("_parts"))
    swapped = F.col("date").isNull() & (first <= 12) & (second <= 12)
    in_range = F.col("date").between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date"))
    finite = ~F.isnan("qty_sold") & (F.abs("qty_sold") != float("inf"))
    error = F.when(swapped & F.col("mixed"), "mixed date styles").when(swapped, "ambiguous date").when(
        ~F.coalesce(in_range, F.lit(False)), "bad date").when(
        ~F.coalesce(finite, F.lit(False)), "bad qty_sold")
    return typed.withColumn("error", error).drop("day_first", "mixed", "_parts")


def good_rows(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("error").isNull()).drop("raw_date", "raw_qty", "error")


def rejected_rows(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("error").isNotNull()).drop("date", "qty_sold")


def profile(table: DataFrame, *keys: str) -> DataFrame:
    """Row count and date range, with the table's column names as text."""
    return table.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.min("date").alias("first_day"), F.max("date").alias("last_day"),
    ).withColumn("columns", F.lit(",".join(table.columns)))


def first_rows(table: DataFrame, n: int, *order: str) -> DataFrame:
    """The n first rows in a stable order: the sample shown next to a profile."""
    return table.orderBy(*order).limit(n)
