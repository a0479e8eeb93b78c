"""WARC archives: written by Spark, read back by boundary-chain verification.

*Writing.* One record per page. Of pages with equal payloads of at least ``least`` bytes, the one with the smallest id is a
response; the others are revisits that name it and hold no payload. Each task writes files of whole records.

*Reading.* The magic line may also stand inside a payload, so no task can tell from its part of a file where records begin.
1. Files are split at every magic line, wherever Spark cuts them; each piece is a *candidate* record. Its header gives the
   offset of its *successor*, if it is a record at all.
2. Candidates that lead to their neighbour form runs; a run also begins where a candidate further back leads to. Runs are
   few: one per file, and some more for each false magic line.
3. Pointer jumping over the runs, from the start of each file: with each round the pointers reach twice as far, and what is
   reached is kept. Candidates in runs never reached are text inside a payload.
4. A record whose payload holds magic lines is put together from its pieces; all others are whole already.

Defined cases: a null html is an empty payload; a null url has no target line, and control characters in one are written as
%XX; a null page_id can be a revisit, and is a response where no other page has its payload; rows that repeat an id and payload
are responses alike; empty tables give no records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, run_folder, setup

MAGIC = "WARC/1.0\r\n"
GAP = "\r\n\r\n"
PER_FILE = 20_000
FEW = 200_000  # about 30 MB in memory
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-31T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
ID = "urn:x-page:"


def base32(digest: Column) -> Column:
    """Base32 of a SHA-1 given in hexadecimal: every five digits are four signs."""
    numbers = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.conv(F.substring(digest, k * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    sign = lambda n, by: F.substring(F.lit(ALPHABET), F.shiftright(n, by).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    return F.array_join(F.transform(numbers, lambda n: F.concat(*[sign(n, by) for by in (15, 10, 5, 0)])), "")


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, refers_to, record): the text of each page's record."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    ).withColumn("sha", F.sha1(F.encode("html", "UTF-8"))).withColumn("size", F.octet_length("html").cast("long"))
    copies = rows.filter(F.col("size") >= least).groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = cut_lineage(copies.select("sha", "size", "first"))
    # one narrow row per payload that repeats: sent to all tasks if they are few, so no page is shuffled; else joined by digest
    rows = rows.join(F.broadcast(copies) if copies.count() <= FEW else copies, ["sha", "size"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    target = F.regexp_replace("url", "[\\x00-\\x1f\\x7f]", "%0A")
    block = F.when(revisit, "").otherwise(F.concat(F.lit(HTTP), "html"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit(f"<{ID}"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))),
        line("WARC-Date", F.lit(DATE)), F.coalesce(line("WARC-Target-URI", target), F.lit("")),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
            line("WARC-Refers-To", F.concat(F.lit(f"<{ID}"), F.col("first").cast("string"), F.lit(">"))),
        )).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha")))),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"),
    )
    return rows.select("page_id", F.when(revisit, F.col("first")).alias("refers_to"), F.concat(head, block).alias("record"))


def write_warc(pages: DataFrame, folder: str, least: int = 0) -> None:
    """Write the archive files of all pages; a record ends with two empty lines, as the format has it."""
    setup(pages.sparkSession)
    writer = records(pages, least).select(F.col("record").alias("value")).write.option("lineSep", GAP).option("maxRecordsPerFile", PER_FILE)
    writer.option("compression", "none").text(folder)


def header(head: Column, name: str, pattern: str) -> Column:
    """A header line's value, or null."""
    return F.nullif(F.regexp_extract(head, f"(?im)^{name}: *{pattern}", 1), F.lit(""))


def candidates(spark: SparkSession, folder: str, payloads: bool) -> DataFrame:
    """Every piece of every file that begins with a magic line, with its offset, its header and its successor's offset.

    ``body`` is the payload of pieces that are one whole record; ``raw`` is the text of all others.
    """
    pieces = spark.read.option("lineSep", MAGIC).text(folder).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("cut"), F.monotonically_increasing_id().alias("at"), "value"
    )
    head = F.substring_index("value", GAP, 1)
    head_size = F.octet_length(head) + len(GAP)
    block = F.substring(F.col("value").cast("binary"), (F.col("head_size") + 1).cast("int"), F.col("length").cast("int"))
    http = F.octet_length(F.substring_index("value", GAP, 2)) + len(GAP) - F.col("head_size")
    found = (
        pieces.withColumn("size", F.octet_length("value")).withColumn("head", head).withColumn("head_size", head_size)
        .withColumn("length", header(F.col("head"), "Content-Length", r"(\d{1,15})\s*$").cast("long"))
        .withColumn("kind", header(F.col("head"), "WARC-Type", r"(\w+)"))
    )
    sound = F.col("length").isNotNull() & F.col("kind").isNotNull() & (F.col("head_size") <= F.col("size"))
    found = found.withColumn("span", F.when(sound, len(MAGIC) + F.col("head_size") + F.col("length") + len(GAP)))
    whole = F.coalesce(F.col("span") == len(MAGIC) + F.col("size"), F.lit(False))
    body = F.when(F.col("length") == 0, F.lit("").cast("binary")).otherwise(F.expr("substring(block, cast(http + 1 as int), cast(length - http as int))"))
    found = found.withColumn("whole", whole).withColumn("http", http.cast("long")).withColumn("block", F.when(F.col("whole"), block)).withColumn("body", body)
    return found.select(
        "path", "cut", "at", "size", "span", "kind", "whole", header(F.col("head"), "WARC-Record-ID", f"<{ID}(-?\\d+)>").cast("long").alias("page_id"),
        header(F.col("head"), "WARC-Refers-To", f"<{ID}(-?\\d+)>").cast("long").alias("refers_to"), header(F.col("head"), "WARC-Target-URI", r"([^\r\n]*)").alias("url"),
        header(F.col("head"), "WARC-Payload-Digest", r"sha1:(\w+)").alias("said"),
        F.when(F.col("whole"), F.octet_length("body")).cast("long").alias("payload_bytes"), F.when(F.col("whole"), base32(F.sha1("body"))).alias("digest"),
        (F.col("body") if payloads else F.lit(None).cast("binary")).alias("body"), F.when(~F.col("whole"), F.col("value")).alias("raw"),
    )


def chained(found: DataFrame) -> DataFrame:
    """The candidates with their offset, run and whether the chain from the file's start reaches them."""
    # a piece is followed by the magic line that begins the next one; the first piece of a file is what stands before any
    order = Window.partitionBy("path").orderBy("cut", "at")
    end = F.sum(F.col("size") + len(MAGIC)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = found.withColumn("offset", end - F.col("size") - 2 * len(MAGIC)).filter("offset >= 0")
    placed = placed.withColumn("next", F.col("offset") + F.col("span"))
    line = Window.partitionBy("path").orderBy("offset")
    placed = placed.withColumn("follows", F.coalesce(F.lag("next").over(line) == F.col("offset"), F.lit(False)))
    placed = cut_lineage(placed.withColumn("leaps", F.coalesce(F.lead("offset").over(line) != F.col("next"), F.lit(False))))
    landings = placed.filter("leaps").select("path", F.col("next").alias("offset"), F.lit(True).alias("landed")).distinct()
    headed = placed.join(landings, ["path", "offset"], "left")
    begins = (~F.col("follows") | F.col("landed").isNotNull()).cast("long")
    headed = cut_lineage(headed.withColumn("run", F.sum(begins).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    runs = headed.groupBy("path", "run").agg(F.min("offset").alias("first"), F.max("offset").alias("last"))
    exits = runs.join(headed.select("path", F.col("offset").alias("last"), "next"), ["path", "last"])
    into = headed.select("path", F.col("offset").alias("next"), F.col("run").alias("to"))
    pointers = cut_lineage(exits.join(into, ["path", "next"], "left").select("path", "run", "first", "to"))
    reached = pointers.filter("first = 0").select("path", "run")
    known = reached.count()
    jump = pointers.filter("to is not null").select("path", "run", "to")
    while True:
        more = reached.join(jump, ["path", "run"]).select("path", F.col("to").alias("run"))
        reached = cut_lineage(reached.union(more).distinct())
        if (now := reached.count()) == known:
            break
        known = now
        second = jump.select("path", F.col("run").alias("to"), F.col("to").alias("far"))
        jump = cut_lineage(jump.join(second, ["path", "to"]).select("path", "run", F.col("far").alias("to")))
    return headed.join(reached.withColumn("real", F.lit(True)), ["path", "run"], "left").withColumn("real", F.coalesce("real", F.lit(False)))


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload, sound) of every record.

    Length and digest are those of the payload as read; a revisit has those of the response that it names. ``sound`` says
    that the digest is the one in the header. ``payload`` is null unless asked for.
    """
    setup(spark)
    links = cut_lineage(chained(cut_lineage(candidates(spark, folder, payloads))))
    fields = ["page_id", "url", F.col("kind").alias("record_type"), "refers_to", "said"]
    whole = links.filter("real and whole").select(*fields, "payload_bytes", F.col("digest").alias("payload_digest"), F.col("body").alias("payload"))

    # records that hold magic lines: their own piece and those up to their successor, in order
    broken = links.filter("real and not whole").select("path", F.col("offset").alias("start"), "next", *fields)
    owner = Window.partitionBy("path").orderBy("offset").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    texts = F.when(F.col("whole"), F.lit(None)).otherwise(F.col("raw"))
    parts = links.withColumn("start", F.max(F.when(F.col("real"), F.col("offset"))).over(owner)).filter("not (real and whole)")
    # a false piece may look like a whole record: its text is then header and body again, so it is read as it stands
    parts = parts.select("path", "start", "offset", texts.alias("raw"), "size")
    again = parts.filter("raw is null").select("path", "start", "offset", "size")
    if not again.isEmpty():
        scanned = spark.read.option("lineSep", MAGIC).text(folder).select(
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("cut"), F.monotonically_increasing_id().alias("at"), "value"
        ).join(F.broadcast(again.select("path").distinct()), "path", "left_semi")
        order = Window.partitionBy("path").orderBy("cut", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        scanned = scanned.withColumn("offset", F.sum(F.octet_length("value") + len(MAGIC)).over(order) - F.octet_length("value") - 2 * len(MAGIC))
        filled = again.join(scanned.select("path", "offset", "value"), ["path", "offset"]).select("path", "start", "offset", F.col("value").alias("raw"), "size")
        parts = parts.filter("raw is not null").union(filled)
    text = parts.groupBy("path", "start").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("offset", "raw"))), lambda p: p["raw"]), MAGIC).alias("value"))
    head_size = F.octet_length(F.substring_index("value", GAP, 1)) + len(GAP)
    http = F.octet_length(F.substring_index("value", GAP, 2)) + len(GAP)
    size = F.col("next") - F.col("start") - len(MAGIC) - len(GAP)
    joined = broken.join(text, ["path", "start"]).withColumn("http", http).withColumn("ends", size).withColumn("head_size", head_size)
    body = F.when(F.col("ends") == F.col("head_size"), F.lit("").cast("binary")).otherwise(F.expr("substring(cast(value as binary), cast(http + 1 as int), cast(ends - http as int))"))
    mended = joined.withColumn("body", body).select(
        "page_id", "url", "record_type", "refers_to", "said", F.octet_length("body").cast("long").alias("payload_bytes"), base32(F.sha1("body")).alias("payload_digest"),
        (F.col("body") if payloads else F.lit(None).cast("binary")).alias("payload"),
    )
    found = cut_lineage(whole.union(mended))
    answers = found.filter("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("said")).agg(
        F.max("payload_bytes").alias("size")
    )
    own = found.filter("record_type <> 'revisit'").withColumn("sound", F.col("said") == F.col("payload_digest"))
    revisits = found.filter("record_type = 'revisit'").join(answers, ["refers_to", "said"], "left")
    revisits = revisits.select(
        "page_id", "url", "record_type", "refers_to", F.col("size").alias("payload_bytes"), F.col("said").alias("payload_digest"), F.lit(None).cast("binary").alias("payload"),
        F.col("size").isNotNull().alias("sound"),
    )
    return own.select(revisits.columns).union(revisits)


def archived(pages: DataFrame, least: int = 0, payloads: bool = False) -> DataFrame:
    """Write all pages as an archive in the shared folder, and read it back."""
    folder = run_folder(pages.sparkSession, "warc")
    write_warc(pages, folder, least)
    return read_warc(pages.sparkSession, folder, payloads)
