"""Inputs of the registered queries, derived by Spark from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scribemill.functions import answers as fa
from scribemill.session import STATE_STORE, STATE_STORE_KEY, new_path

TITLE_CHARS = 40
PAGE_ENTRIES = 100
SITE = "https://site.example"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def title(text: str = "text") -> Column:
    return F.substring(text, 1, TITLE_CHARS)


def titled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as corpus records: the first characters stand in for a title."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), title().alias("title"), "source", "lang", "text")


def noted_text(doc: str = "seq") -> Column:
    """Document text with stage notes and loose whitespace put in, by document id."""
    kind = F.col(doc) % 4
    return (
        F.when(kind == 0, F.concat(F.lit(" [Applause]  \t"), F.col("text"), F.lit("\n\n\n\n[LAUGHTER]\n")))
        .when(kind == 1, F.concat(F.lit("[laugh[applause]ter] "), F.col("text"), F.lit("\n \n\n\n[CrossTalk]")))
        .when(kind == 2, F.concat(F.lit("[app[laughter]lause]\t\t"), F.col("text"), F.lit("\u001c")))
        .otherwise(F.col("text"))
    )


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn and the assistant turn right after it: conv_id, turn, instruction, output."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("instruction"))
    answered = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output")
    )
    return asked.join(answered, ["conv_id", "turn"])


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One generation response per exchange; the kind of answer depends on ``conv_id % 6``."""
    full = F.struct("instruction", "output")
    partial = F.struct("instruction", F.lit(None).cast("string").alias("output"))  # key left out by to_json
    array = F.to_json(F.array(full, partial))
    kind = F.col("conv_id") % 6
    response = (
        F.when(kind == 0, array)
        .when(kind == 1, F.concat(F.lit("\n```json\n"), array, F.lit("\n```  ")))
        .when(kind == 2, F.concat(array, F.lit(" tail")))
        .when(kind == 3, F.to_json(full))
        .when(kind == 4, F.lit(None))
        .otherwise(F.concat(F.lit("[5, "), F.substring(array, 2, 2**31 - 1)))
    )
    return exchanges(spark, sf_dir).select(
        "conv_id",
        "turn",
        response.alias("response"),
        F.length("instruction").cast("long").alias("input_tokens"),
        F.length("output").cast("long").alias("output_tokens"),
        F.when(kind == 4, "ThrottlingException").alias("error"),
    )


def escape(c: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def _listing(docs: DataFrame, entry: Column, before: str, after: str) -> DataFrame:
    """Listing pages of at most PAGE_ENTRIES entries each, in document order."""
    page = F.call_function("div", F.col("doc_id"), F.lit(PAGE_ENTRIES))
    return (
        docs.groupBy(page.alias("page_no"))
        .agg(F.array_sort(F.collect_list(F.struct("doc_id", entry.alias("e")))).alias("entries"))
        .select("page_no", F.concat(F.lit(before), F.array_join("entries.e", "\n"), F.lit(after)).alias("html"))
    )


def table_listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents as listing pages with one table row per document."""
    docs = table(spark, sf_dir, "documents").where(F.col("lang") == "en")
    entry = F.concat(
        F.lit("<tr><td> "), "source", F.lit(" </td><td>x</td><td><b><a href='/d/"), F.col("doc_id").cast("string"),
        F.lit("'>"), escape(title()), F.lit("</a></b></td></tr>"),
    )
    return _listing(docs, entry, "<table class='views-table cols'><thead><tr><td>a</td></tr></thead><tbody>", "</tbody></table>")


def card_listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other documents as listing pages with one block per document."""
    docs = table(spark, sf_dir, "documents").where(F.col("lang") != "en")
    entry = F.concat(
        F.lit("<div class='views-row'><h3><a href='d/"), F.col("doc_id").cast("string"), F.lit("'>"), escape(title()),
        F.lit("</a></h3><time>"), "source", F.lit("</time></div>"),
    )
    return _listing(docs, entry, "<body>", "</body>")


def article_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One article page per document."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("page_id"),
        F.concat(F.lit(f"{SITE}/d/"), F.col("doc_id").cast("string")).alias("url"),
        F.concat(
            F.lit("<html><style>p{}</style><div class='text'><p>"), escape(F.col("text")), F.lit("<br></p></div><footer>f</footer>")
        ).alias("html"),
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as requests, with every kind of rejection in it, ten requests a second."""
    d = F.col("doc_id")
    question = (
        F.when(d % 11 == 0, F.lit(" [INST] </s> [/inst]"))
        .when(d % 13 == 0, F.lit(""))
        .when(d % 7 == 0, F.concat(F.lit("<S>[INST] "), F.col("text"), F.lit(" [/INST]</s>")))
        .otherwise(F.col("text"))
    )
    return table(spark, sf_dir, "documents").select(
        d.alias("request_id"),
        F.timestamp_micros(F.lit(1_704_067_200_000_000) + d * 100_000).alias("ts"),
        F.when(d % 9 == 0, "").otherwise(F.col("source")).alias("user_id"),
        F.concat(F.lit("10.0.0."), (d % 5).cast("string")).alias("client_addr"),
        (d % 17 != 0).alias("authorized"),
        question.alias("question"),
        F.when(d % 5 == 0, F.lit(None)).when(d % 19 == 0, 5000).otherwise(100).cast("int").alias("max_tokens"),
        F.when(d % 3 == 0, F.lit(None)).when(d % 23 == 0, 3.0).otherwise(1.5).cast("double").alias("temperature"),
        F.when(d % 29 == 0, "ModelNotReadyException")
        .when(d % 31 == 0, "ThrottlingException")
        .when(d % 37 == 0, "ValidationException")
        .alias("error"),
    )


def answer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as answer events; system turns are events without text."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("request_id"), F.col("turn").alias("seq"), F.when(F.col("role") != "system", F.col("text")).alias("text")
    )


def line_chunks(lines: DataFrame) -> DataFrame:
    """Stream lines as network chunks that end in the middle of lines."""
    data = F.concat(F.col("line"), F.lit("\n\n"))
    cut = F.call_function("div", F.length(data), F.lit(2)).cast("int")
    halves = F.array(data.substr(F.lit(1), cut), data.substr(cut + 1, F.length(data)))
    return lines.select("request_id", "seq", F.posexplode(halves).alias("half", "data")).select(
        "request_id", (F.col("seq") * 2 + F.col("half")).alias("chunk"), "data"
    )


def run_stream(out: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there now into a table in the shared folder and return that table."""
    path, checkpoint = new_path(out.sparkSession, name), new_path(out.sparkSession, f"{name}-state")
    _run_once(out, path, checkpoint)
    return out.sparkSession.read.schema(out.schema).parquet(path)


# Settings of a run: the store that timers need, and no triggers without data, as all rows come with data.
STREAM_SETTINGS = {STATE_STORE_KEY: STATE_STORE, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


def _run_once(out: DataFrame, path: str, checkpoint: str) -> None:
    conf = out.sparkSession.conf
    before = {key: conf.get(key, None) for key in STREAM_SETTINGS}
    for key, value in STREAM_SETTINGS.items():
        conf.set(key, value)
    try:
        query = (
            out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)


def run_stream_in_parts(rows: DataFrame, part: Column, parts: int, build: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Let the rows arrive as files, part by part, in as many runs of one stream that takes its state on from run to run."""
    spark = rows.sparkSession
    source, path, checkpoint = (new_path(spark, f"{name}{kind}") for kind in ("-in", "", "-state"))
    for number in range(parts):
        rows.where(part == number).write.mode("append").parquet(source)
        out = build(spark.readStream.schema(rows.schema).parquet(source))
        _run_once(out, path, checkpoint)
    return spark.read.schema(out.schema).parquet(path)


def time_part(df: DataFrame, ts: str, parts: int) -> Column:
    """Number of the part of equal rows, about, that a time falls into; no time comes first."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    cuts = df.agg(F.percentile_approx(micros, [i / parts for i in range(1, parts)])).first()[0] or []
    return F.coalesce(sum([F.when(micros > cut, 1).otherwise(0) for cut in cuts], F.lit(0)), F.lit(0))


def noisy_answer_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as network chunks of bytes: cut in the middle, also inside characters, among other lines.

    Broken and foreign lines stand before some tokens, an end mark with a lost
    token behind others, and every third answer ends in the middle of a line.
    """
    turn, done = F.col("turn"), fa.done_line()
    line = F.concat(F.lit('data: {"token": '), F.to_json(F.array("text")).substr(F.lit(2), F.length(F.to_json(F.array("text"))) - 2), F.lit("}\n\n"))
    said = F.when((F.col("role") != "system") & (F.length("text") > 0), line).otherwise(F.lit("event: other\n"))
    before = F.when(turn % 3 == 0, ": ping\r\n").when(turn % 3 == 1, 'data: {"token": \n').otherwise("")
    behind = F.when(turn % 4 == 2, F.concat(done, F.lit('\ndata: {"token": "lost"}\n'))).otherwise("")
    turns = table(spark, sf_dir, "conversations")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("turn")).where("conv_id % 3 = 0")
    tails = last.select("conv_id", (F.col("turn") + 1).alias("turn"), F.encode(F.lit('data: {"token": "néver'), "UTF-8").alias("data"))
    data = turns.select("conv_id", "turn", F.encode(F.concat(before, said, behind), "UTF-8").alias("data")).unionByName(tails)
    middle = F.call_function("div", F.octet_length("data"), F.lit(2)).cast("int")
    halves = F.array(F.substring("data", F.lit(1), middle), F.substring("data", middle + 1, F.octet_length("data")))
    return data.select("conv_id", "turn", F.posexplode(halves).alias("half", "data")).select(
        F.col("conv_id").alias("request_id"), (F.col("turn") * 2 + F.col("half")).cast("long").alias("chunk"), "data"
    )
