"""Raw log lines derived from the driver tables (mapping: FIXTURES.md section 4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import from_millis
from ..operators.detect import SECS_NAME
from ..operators.ordered import running_offset
from ..schema import MMI, SECS, entry_key
from ..staging import stage

ROWS_PER_BLOCK = 4096


def number_pieces(rows: DataFrame, order: str) -> DataFrame:
    """(source_file, <order>, pieces array) to numbered raw lines.

    Line numbers are a running count per file: totals per block of `order`, summed over earlier blocks, plus the
    running count inside the block.
    """
    rows = rows.withColumns(
        {
            "source_path": F.concat(F.lit("synth/"), F.col("source_file")),
            "block_no": F.floor(F.col(order) / ROWS_PER_BLOCK),
            "_n": F.size("pieces").cast("long"),
        }
    )
    totals = rows.groupBy("source_path", "block_no").agg(F.sum("_n").alias("_total"))
    starts = running_offset(totals, ["source_path"], "block_no", "_total", "_start").drop("_total")
    inside = Window.partitionBy("source_path", "block_no").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(inside), F.lit(0))
    return (
        rows.withColumn("_before", before)
        .join(starts, ["source_path", "block_no"])
        .select(
            "source_path",
            "source_file",
            "block_no",
            (F.col("_start") + F.col("_before")).alias("_first"),
            F.posexplode("pieces").alias("_pos", "value"),
        )
        .select(
            "source_path",
            "source_file",
            "block_no",
            (F.col("_first") + F.col("_pos") + 1).alias("line_no"),
            "value",
        )
    )


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as MMI and SECS log lines."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("long")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id",
        F.col("user_id").alias("u"),
        "event_type",
        k.alias("k"),
        F.round(F.col("value") * 100).cast("long").alias("cents"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.date_format("ts", "HH:mm:ss:SSS").alias("clock"),
    )
    k, u, cents = F.col("k"), F.col("u"), F.col("cents")
    port = u % 4 + 1
    yes_no = [F.when(bit == 0, "NO").otherwise("YES") for bit in (k % 3, k % 4)]
    body = (
        F.when(
            F.col("event_type") == "error",
            F.concat(
                _text("[ALARM] Alarm Code [", k + 3000, "] unit ", u, " value ", cents),
                F.when(k % 2 == 0, _text(" -->[Count:", k % 4 + 1, "]")).otherwise(""),
            ),
        )
        .when(
            F.col("event_type") == "click",
            _text(
                "CarrierObject::StateChange model=M", k % 3, ", GetString()=Carrier idx: ", k, ", CARRIER_ID: LOT", u,
                ", CARRIERID_READ: ", yes_no[0], ", SLOTMAP_READ: ", yes_no[1],
            ),
        )
        .when(
            F.col("event_type") == "view",
            _text("LoadPortObject::StateChange model=M", k % 3, ", GetString()=PorNo: ", port, ", LocID: LP", port),
        )
        .when(
            F.col("event_id") % 2 == 0,
            _text(
                "CarrierObject::ClearCarrierInfo Before Clear, this->CarrierID : LOT", u, ", SEQPortNo : ", port,
                ", MMIPortNo : ", port,
            ),
        )
        .otherwise(
            _text("SubstrateObject::Initialize substrateno=", k, ", SubstrateID=W", u, ", AcquiredID=A", k)
        )
    )
    secs = F.col("event_type") == "purchase"
    color = F.when(F.col("event_type") == "error", "31").otherwise("21")
    lot = _text("LOT", u)
    secs_pieces = F.array(
        _text(F.col("clock"), ": [1] SEND S6F11W"),
        F.lit("  <L [3]>"),
        F.lit("    <U4 [1] 0>"),
        _text("    <U4 [1] ", k + 1000, ">"),
        F.lit("    <L [1]>"),
        F.lit("      <L [2]>"),
        _text("        <U4 [1] ", u % 10 + 10, ">"),
        F.lit("        <L [2]>"),
        _text("          <A [", F.length(lot), "] ", lot, ">"),
        _text("          <U4 [1] ", cents, ">"),
    )
    mmi_pieces = F.array(_text(F.col("day"), " ", F.col("clock"), "|", color, "|", F.col("event_id"), "|", body))
    note = F.when(k % 5 == 0, F.array(F.when(secs, _text("  note ", k)).otherwise(_text("note ", k, " for unit ", u))))
    pieces = F.concat(
        F.when(secs, secs_pieces).otherwise(mmi_pieces), F.coalesce(note, F.array().cast("array<string>"))
    )
    name = F.when(
        secs, F.concat("day", F.lit(" "), F.substring("clock", 1, 2), F.lit(".log"))
    ).otherwise(F.concat(F.replace(F.col("day"), F.lit("-"), F.lit("_")), F.lit(".log")))
    return number_pieces(events.select("event_id", name.alias("source_file"), pieces.alias("pieces")), "event_id")


def setup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as MMI lines with setup dumps: markers in headers and in continuation lines, colours 1 and 21."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("long")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", "event_type", k.alias("k"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss:SSS").alias("at")
    )
    k = F.col("k")
    text = (
        F.when((F.col("event_type") == "error") & (k % 10 == 0), "[Setup.ini] LOGGING")
        .when((F.col("event_type") == "click") & (k % 10 == 0), "[setup.INI] finish")
        .otherwise(_text("step ", k))
    )
    color = F.when(k % 3 == 0, "21").otherwise("1")
    tail = (
        F.when(k % 20 == 3, F.array(F.lit("  [Other.ini] LOGGING")))
        .when(k % 20 == 7, F.array(F.lit("[Other.ini] FINISH"), F.lit("")))
        .when(k % 20 == 10, F.array(F.lit("[Other.ini] LOGGING"), F.lit("[Other.ini] FINISH")))
        .otherwise(F.array().cast("array<string>"))
    )
    name = F.concat(F.replace(F.substring("at", 1, 10), F.lit("-"), F.lit("_")), F.lit(".log"))
    head = _text(F.col("at"), "|", color, "|", F.col("event_id"), "|", text)
    return number_pieces(
        events.select("event_id", name.alias("source_file"), F.concat(F.array(head), tail).alias("pieces")), "event_id"
    )


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as one file each, (source_path, source_file, content): names and headers of both dialects."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kind = F.col("doc_id") % 4
    name = (
        F.when(kind == 0, "2024_03_05.log").when(kind == 1, "2024-03-05 7.tslog").when(kind == 2, "notes.TXT")
        .otherwise("2024-03-05.log")
    )
    head = (
        F.when(F.col("doc_id") % 3 == 0, "2024-03-05 07:00:00:001|1|1|").when(F.col("doc_id") % 3 == 1, "07:00:00:001: [2] ")
        .otherwise("")
    )
    return docs.select(
        _text("doc", F.col("doc_id"), "/", name).alias("source_path"),
        name.alias("source_file"),
        F.concat(head, F.col("text")).alias("content"),
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as MMI entries: first line is the message, other lines continue it; one file per language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    day = (
        F.when(F.col("lang") == "en", "01").when(F.col("lang") == "fr", "02").when(F.col("lang") == "de", "03")
        .otherwise("04")
    )
    clock = F.date_format(from_millis(F.col("doc_id") % 86_400_000), "HH:mm:ss:SSS")
    head = _text("2024-02-", day, " ", clock, "|1|", F.col("doc_id"), "|")
    lines = F.split("text", "\n")
    pieces = F.transform(lines, lambda line, i: F.when(i == 0, F.concat(head, line)).otherwise(line))
    return number_pieces(
        docs.select("doc_id", _text("2024_02_", day, ".log").alias("source_file"), pieces.alias("pieces")), "doc_id"
    )


def conversation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`conversations` as SECS entries: one turn per message, its lines indented; one file per conversation hour."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    clock = F.date_format(from_millis(F.col("conv_id") * 1000 % 3_600_000 + F.col("turn")), "HH:mm:ss:SSS")
    hour = F.floor(F.col("conv_id") / 3600) % 24
    name = F.format_string("2024-03-01 %02d.log", hour)
    lines = F.transform(F.split("text", "\n"), lambda line: F.concat(F.lit("  "), line))
    head = _text(clock, ": [", F.col("turn") % 9 + 1, "] ", F.col("role"))
    return number_pieces(
        rows.select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"),
            name.alias("source_file"),
            F.concat(F.array(head), lines).alias("pieces"),
        ),
        "turn_id",
    )


def staged_lines(lines: DataFrame) -> DataFrame:
    """Synthesised lines written once, with the dialect that their file names settle."""
    by_name = F.when(F.col("source_file").rlike(SECS_NAME), SECS).otherwise(MMI)
    return stage(lines.withColumn("dialect", by_name), "lines")


def mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as a log of the rarer forms: job and CMS events, several message types, event ids in headers."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("long")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", F.col("user_id").alias("u"), (F.col("event_type") == "purchase").alias("secs"), k.alias("k"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "HH:mm:ss:SSS").alias("clock"))
    k, u = F.col("k"), F.col("u")
    body = F.when(k % 3 == 0, _text("[CMS] job J", k, " for unit ", u)).when(k % 3 == 1, _text("DeletejobList count=", k)).otherwise(_text("plain ", k))
    head = (
        F.when(k % 4 == 0, _text("SEND S1F3W CEID = ", k + 1000)).when(k % 4 == 1, _text("RECV S2F41 ceid=", k + 5))
        .when(k % 4 == 2, F.lit("SEND S6F11W")).otherwise(F.lit("RECV S6F12"))
    )
    report = F.array(F.lit("  <U4 [1] 1>"), _text("  <U4 [1] ", k + 1000, ">"))
    pieces = F.when(
        F.col("secs"), F.concat(F.array(_text(F.col("clock"), ": [2] ", head)), F.when(k % 4 == 2, report).otherwise(F.array().cast("array<string>")))
    ).otherwise(F.array(_text(F.col("day"), " ", F.col("clock"), "|1|", F.col("event_id"), "|", body)))
    name = F.when(F.col("secs"), F.concat(F.col("day"), F.lit(" "), F.substring("clock", 1, 2))).otherwise(F.replace(F.col("day"), F.lit("-"), F.lit("_")))
    return number_pieces(rows.select("event_id", F.concat(F.lit("mixed "), name, F.lit(".log")).alias("source_file"), pieces.alias("pieces")), "event_id")


def write_named_files(lines: DataFrame, folder: str) -> None:
    """Raw lines as text files `block <n>/<source file>`, so that names tell the dialect and the day; a block ends with a whole entry."""
    spark = lines.sparkSession
    write_log_files(lines, f"{folder}-parts")
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}-parts")
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    path = spark._jvm.org.apache.hadoop.fs.Path
    for r in lines.select("source_file", "block_no").distinct().collect():
        part = path(f"{folder}-parts/source_file={r['source_file']}/block_no={r['block_no']}")
        file = next(f.getPath() for f in system.listStatus(part) if f.getPath().getName().startswith("part-"))
        system.mkdirs(path(f"{folder}/block {r['block_no']}"))
        system.rename(file, path(f"{folder}/block {r['block_no']}/{r['source_file']}"))


def write_log_files(lines: DataFrame, folder: str) -> None:
    """Raw lines as text files, one per block of each log; a block ends with a whole entry."""
    (
        lines.repartition("source_file", "block_no")
        .sortWithinPartitions("source_file", "block_no", "line_no")
        .select("source_file", "block_no", "value")
        .write.partitionBy("source_file", "block_no")
        .text(folder)
    )


# ---------------------------------------------------------------- reference dimensions and bookmarks


def event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`part` as Events(CEId, Name): every tenth name is missing, the others are padded."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    name = F.when(F.col("p_partkey") % 10 != 0, F.concat(F.lit(" "), F.col("p_name"), F.lit("  ")))
    return part.select((F.col("p_partkey") + 1000).alias("CEId"), name.alias("Name"))


def report_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`supplier` as ReportVariables(RepId, Index_No, VId)."""
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return supplier.select(
        (F.col("s_suppkey") % 12 + 10).alias("RepId"),
        F.col("s_suppkey").alias("Index_No"),
        (F.col("s_nationkey") + 2000).alias("VId"),
    )


def variable_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`nation` as Variables(VId, Name); the last five have no name."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return nation.select((F.col("n_nationkey") + 2000).alias("VId"), F.when(F.col("n_nationkey") < 20, F.col("n_name")).alias("Name"))


def bookmark_table(spark: SparkSession, sf_dir: str, document_entries: DataFrame) -> DataFrame:
    """`labels` of good quality as bookmarks(entry_key, memo) of the document entries."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1")
    memo = F.when(F.col("toxic") == 1, "check\nagain").otherwise("ok")
    keyed = document_entries.select(F.col("seq_index").alias("doc_id"), entry_key().alias("entry_key"))
    return keyed.join(labels, "doc_id").select("entry_key", memo.alias("memo"))
