"""Rosters: CSV or Parquet folders, one sub-folder ``event_id=...`` per event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventdocs.schemas import FEE_COLUMNS, ROSTER_COLUMNS, ROSTER_FILE
from eventdocs.sources.files import LENIENT, listed_files, torn_files, unread_files

_AMOUNTS = (*FEE_COLUMNS, "total")
#: Rows of a file are numbered below this; the next file of the event goes on from its multiple.
_FILE_ROWS = 1 << 40
# Quoted cells may hold line breaks, separators and doubled quotes.
_CSV = {"quote": '"', "escape": '"'}
_BROKEN = "_broken"
_TEXTS = ", ".join(f"{name} STRING" for name in (*ROSTER_COLUMNS, _BROKEN))
_WHOLE = r"[+-]?(\d+|\d{1,3}(,\d{3})+)(\.0*)?"
_QUOTED = '"(?:[^"]|"")*"'
_LINE_BREAK = "\r\n|\r|\n"
# A line within a cell that holds as many separators as a row.
_ROW_INSIDE = "[\r\n](?:[^,\r\n]*,){%d}" % (len(ROSTER_COLUMNS) - 1)
#: A cell is no longer than this, in characters; a longer one is reported.
LONGEST_CELL = 4096
# The encodings that Spark reads without a setting.
_ENCODINGS = ("utf-8", "utf-16", "utf-16be", "utf-16le", "utf-32", "us-ascii", "iso-8859-1")


def amount(text: Column) -> Column:
    """A whole number, also with thousands separators or zeros after the point; null where the text is none."""
    shown = F.trim(text)
    digits = F.regexp_replace(F.regexp_replace(shown, r"\.0*$", ""), ",", "")
    return F.when(shown.rlike(f"^{_WHOLE}$"), digits.try_cast("bigint"))


def _cells(record: Column) -> Column:
    """Number of cells of a record as written; a quote that is not closed takes what follows into its cell."""
    plain = F.regexp_replace(F.regexp_replace(record, _QUOTED, ""), '(?s)".*', "")
    return F.regexp_count(plain, F.lit(",")) + 1


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """All records of all files as texts by position, headers too, with ``_file``, the number of ``_cells``, the record as
    written where it has not as many cells as a roster, whether its quote stayed ``_open``, and a ``_row`` that rises in a file.

    A quote that is never closed takes all lines behind it into its cell. Those lines are read again one by one, so that only
    the damaged line is lost.
    """
    if encoding.lower() not in _ENCODINGS:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # Spark reads further encodings only then
    reader = spark.read.schema(f"{_TEXTS}, event_id BIGINT").options(
        **_CSV, **LENIENT, header="false", multiLine="true", encoding=encoding, columnNameOfCorruptRecord=_BROKEN
    )
    rows = reader.csv(path).withColumn("_file", F.col("_metadata.file_path"))
    # Lines of a broken record; of one that a later quote has completed, so that a cell holds rows; or of a last cell: that
    # one should hold an amount, so its quote was not meant to go on.
    last = F.regexp_replace(ROSTER_COLUMNS[-1], "[\\r\\n]+$", "")
    intact = F.col(_BROKEN).isNull()
    cells = F.array(*ROSTER_COLUMNS)
    swallowed = intact & F.exists(cells, lambda c: F.coalesce(c.rlike(_ROW_INSIDE), F.lit(False)))
    runs_on = intact & ~swallowed & F.coalesce(last.rlike("[\\r\\n]"), F.lit(False))
    quoted = F.transform(
        cells,
        lambda c: F.when(c.rlike(_ROW_INSIDE), c)
        .when(c.rlike('[",]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')))
        .otherwise(F.coalesce(c, F.lit(""))),
    )
    lines = (
        F.when(swallowed, F.split(F.array_join(quoted, ","), _LINE_BREAK))
        .when(runs_on, F.split(last, _LINE_BREAK))
        .when(F.col(_BROKEN).rlike("[\\r\\n]"), F.split(_BROKEN, _LINE_BREAK))
    )
    # A record that is read again stays behind: with each of its lines it would take the rest of the file along once more.
    again = lines.isNotNull()

    def short(name: str) -> Column:
        return F.when(~again | (runs_on & F.lit(name != ROSTER_COLUMNS[-1])), F.col(name)).alias(name)

    rows = rows.select(
        "event_id", "_file", runs_on.alias("_runs_on"), *map(short, ROSTER_COLUMNS), short(_BROKEN), lines.alias("_lines")
    )
    listed = F.coalesce("_lines", F.array(F.lit(None).cast("string")))
    rows = rows.select("*", F.posexplode(listed).alias("_at", "_line")).drop("_lines")
    rows = rows.where(F.coalesce("_line", _BROKEN, F.lit("-")).rlike("\\S"))
    options = {**_CSV, "columnNameOfCorruptRecord": _BROKEN}
    rows = rows.withColumn("_again", F.from_csv("_line", F.lit(_TEXTS), options))
    first = F.col("_runs_on") & (F.col("_at") == 0)
    kept = F.col("_line").isNull() | first

    def cell(name: str) -> Column:
        own = F.when(first, F.col("_line")).otherwise(last) if name == ROSTER_COLUMNS[-1] else F.col(name)
        return F.when(kept, own).otherwise(F.col("_again").getField(name)).alias(name)

    broken = F.when(kept, F.col(_BROKEN)).otherwise(F.col("_again").getField(_BROKEN))
    return rows.select(
        "event_id",
        *[cell(name) for name in ROSTER_COLUMNS],
        "_file",
        broken.alias(_BROKEN),
        F.when(broken.isNull(), len(ROSTER_COLUMNS)).otherwise(_cells(broken)).alias("_cells"),
        (F.length(F.regexp_replace(broken, '[^"]', "")) % 2 == 1).alias("_open"),
        F.monotonically_increasing_id().alias("_row"),
    )


def _placed(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """All records with their ``_line`` in the file, 0 for the header, the file's ``_place`` among the event's, by name, and
    whether they are ``_whole``: as many cells as the header, at least those of a roster, and no quote left open.

    A file is read by one task in order, since a quoted line break may be anywhere. What is known per file is one narrow
    row, so the rows themselves are not shuffled unless there are very many files.
    """
    lines = _lines(spark, path, encoding)
    files = lines.groupBy("event_id", "_file").agg(
        F.min("_row").alias("_first"), F.min_by("_cells", "_row").alias("_wanted")
    )
    by_name = Window.partitionBy("event_id").orderBy("_file")
    files = files.withColumn("_place", F.row_number().over(by_name) - 1)
    whole = (F.col("_cells") == F.greatest("_wanted", F.lit(len(ROSTER_COLUMNS)))) & ~F.coalesce("_open", F.lit(False))
    return lines.join(files, ["event_id", "_file"]).withColumns(
        {"_line": F.col("_row") - F.col("_first"), "_whole": whole}
    )


def _entry_no() -> Column:
    return (F.col("_place") * F.lit(_FILE_ROWS) + F.col("_line") - 1).alias("entry_no")


def read_roster_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Roster rows of all events; columns are taken by position, and the first row of every file is its header.

    ``entry_no`` follows the rows of a file and the files of an event by name, without being dense over several files.
    Fees may be written as 4000, 4000.0 or "4,000"; an empty one is no fee. A fee that is no whole number leaves the
    attendee in, without that fee. A file may have further columns, as many in each row as in its header; a row with
    another number of cells is left out, as nobody knows which cell is which, and so is a line with a quote that is never
    closed, but not the lines behind it. All this is listed by ``read_roster_rejects``. Every character set of the JVM may
    be named as ``encoding``, such as windows-31j; one beyond Spark's own switches spark.sql.legacy.javaCharsets on.
    """
    rows = _placed(spark, path, encoding).where("_line > 0 AND _whole")
    cells = [amount(F.col(c)).alias(c) if c in _AMOUNTS else F.col(c) for c in ROSTER_COLUMNS]
    return rows.select("event_id", _entry_no(), *cells)


def read_roster_rejects(
    spark: SparkSession, path: str, encoding: str = "UTF-8", longest: int = LONGEST_CELL
) -> DataFrame:
    """What is wrong in the files, with its text: (event_id, entry_no, name, column, text, reason).

    Rows with another number of cells than their header or less than a roster has, headers too, and lines whose quote
    is never closed are whole rows without a ``column``. Cells that should hold an amount and do not, and cells of more than
    ``longest`` characters, name theirs.
    """
    rows = _placed(spark, path, encoding)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("text")) for c in ROSTER_COLUMNS])
    wrong = (F.trim(F.col("cell.text")) != "") & amount(F.col("cell.text")).isNull() & F.col("cell.column").isin(*_AMOUNTS)
    reason = F.when(F.length("cell.text") > longest, "too long").when(wrong, "not an amount")
    found = rows.where("_line > 0 AND _whole").select("event_id", _entry_no(), "name", F.explode(cells).alias("cell"))
    found = found.select("event_id", "entry_no", "name", "cell.*", reason.alias("reason")).where("reason IS NOT NULL")
    written = F.coalesce(_BROKEN, F.array_join(F.array(*ROSTER_COLUMNS), ",", ""))
    lost = rows.where("NOT _whole").select(
        "event_id",
        _entry_no(),
        "name",
        F.lit(None).cast("string").alias("column"),
        written.alias("text"),
        F.when(F.col("_open"), "quote not closed").otherwise("wrong number of cells").alias("reason"),
    )
    return found.unionByName(lost)


def read_roster_file_rejects(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """CSV files that gave no record, or are packed and break off: (event_id, file, reason, rows), rows the records before
    the damage, header included. Those are read; the job goes on without the rest."""
    given = _lines(spark, path, encoding).groupBy(F.col("_file").alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    listed = listed_files(spark, path, ["event_id"])
    torn = torn_files(spark, path).withColumn("_torn", F.lit(True))
    read = given.join(torn, "file", "left").where("_torn IS NULL").select("file", "rows")
    broken = listed.join(torn, "file").join(given, "file", "left")
    broken = broken.select(
        "file", "event_id", F.lit("breaks off").alias("reason"), F.coalesce("rows", F.lit(0).cast("bigint")).alias("rows")
    )
    silent = unread_files(listed.join(torn, "file", "left_anti"), read).unionByName(broken)
    return silent.select(F.col("event_id").cast("bigint").alias("event_id"), "file", "reason", "rows")


def _parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"entry_no BIGINT, {ROSTER_FILE}, event_id BIGINT").options(**LENIENT).parquet(path)


def read_roster_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Roster tables carry their own ``entry_no``. A damaged file does not stop the others, see
    ``read_roster_parquet_rejects``."""
    return _parquet(spark, path).select("event_id", "entry_no", *ROSTER_COLUMNS)


def read_roster_parquet_rejects(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files that cannot be read or break off: (event_id, file, reason, rows), rows those that were read.

    A file's footer says how many rows it promises; reading all columns shows how many it gives. A file without rows is in
    order.
    """
    table = _parquet(spark, path).withColumn("file", F.col("_metadata.file_path"))
    promised = table.groupBy("file").agg(F.count(F.lit(1)).alias("rows"))
    # The hash is there so that every column is read.
    given = table.select("file", F.xxhash64("entry_no", *ROSTER_COLUMNS).alias("h")).groupBy("file")
    given = given.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor("h").alias("h")).where("h IS NOT NULL").drop("h")
    found = unread_files(listed_files(spark, path, ["event_id"]), given, promised)
    return found.select(F.col("event_id").cast("bigint").alias("event_id"), "file", "reason", "rows")


def _fee_headers(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    headers = _placed(spark, path, encoding).where("_line = 0").select("event_id", F.array(*FEE_COLUMNS).alias("fee_labels"))
    return headers.groupBy("event_id").agg(F.collect_set("fee_labels").alias("all"))


def read_fee_labels(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Each event's own headers of the three fee columns, as ``fee_labels``, where all files of the event agree."""
    return _fee_headers(spark, path, encoding).where(F.size("all") == 1).select("event_id", F.col("all")[0].alias("fee_labels"))


def read_fee_label_rejects(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Events whose files have different fee headers, with all of them; receipts use the default headers."""
    found = _fee_headers(spark, path, encoding).where(F.size("all") > 1)
    return found.select("event_id", F.array_sort("all").alias("fee_labels"))
