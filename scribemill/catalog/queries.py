"""Registered queries: every operator over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribemill.catalog import inputs as i
from scribemill.functions import answers as fa
from scribemill.functions import text as ft
from scribemill.operators import answers, corpus, extract, jobs, pairs, requests, trainset
from scribemill.operators.prefix import dense_index, dense_index_by, order_rows
from scribemill.plans import corpus as corpus_plan
from scribemill.plans import serving, training
from scribemill.session import new_path
from scribemill.sources import readers, writers
from scribemill.streaming import stateful

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TEMPLATE = "Title: {title}\nDate: {date}\n\n{text}\n\nAnswer with a JSON array.\n"
PHRASES = {"contains": ("the ", "de la", "und "), "starts_with": ("in ", "que ")}
SAMPLE = 150
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
ENDS = ("error", "purchase", "signup")
DAY = 86_400


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# Corpus


@query
def corpus_clean(spark, sf):
    docs = i.titled_documents(spark, sf)
    unique = corpus.first_per_title(extract.long_enough(docs))
    cleaned = unique.withColumn("text", ft.clean_text(i.noted_text()))
    return cleaned.select(F.col("seq").alias("doc_id"), "source", ft.truncate(F.col("text")).alias("text"))


@query
def title_dedup(spark, sf):
    return corpus.first_per_title(i.titled_documents(spark, sf)).select(
        F.col("seq").alias("doc_id"), ft.title_key(F.col("title")).alias("title_key")
    )


def _two_sources(spark, sf):
    docs = i.titled_documents(spark, sf).drop("source", "text")
    both = corpus.union_sources(("primary", docs.where("lang = 'en'")), ("archive", docs.where("lang <> 'en'")))
    accepted = (F.col("source") == "primary") | ft.title_matches(F.col("title"), **PHRASES)
    return both, accepted


@query
def source_counts(spark, sf):
    both, accepted = _two_sources(spark, sf)
    return corpus.source_counts(both, accepted)


@query
def corpus_totals(spark, sf):
    both, accepted = _two_sources(spark, sf)
    return corpus.corpus_totals(both.where(accepted))


@query
def union_order(spark, sf):
    both, accepted = _two_sources(spark, sf)
    rows = both.where(accepted).select("source", "source_rank", F.col("seq").alias("doc_id"))
    ordered = order_rows(rows, ["source_rank", "doc_id"], "key").drop("source_rank")
    return dense_index(ordered, "key", key_bits=corpus.SEQ_BITS).drop("key")


@query
def exact_sample(spark, sf):
    docs = i.table(spark, sf, "documents")
    return corpus.exact_sample(docs, SAMPLE, 42, "doc_id").select("doc_id", "lang")


@query
def exact_sample_by_bound(spark, sf):
    docs = i.table(spark, sf, "documents")
    return corpus.exact_sample(docs, SAMPLE, 7, "doc_id", top_rows=0).select("doc_id", "lang")


@query
def dense_positions(spark, sf):
    docs = extract.long_enough(i.table(spark, sf, "documents")).select("doc_id", "source")
    return dense_index(docs, "doc_id")


@query
def dense_positions_by_columns(spark, sf):
    docs = i.table(spark, sf, "documents").select("lang", "source", "doc_id")
    return dense_index_by(docs, ["lang", "source", "doc_id"])


@query
def document_report(spark, sf):
    docs = i.titled_documents(spark, sf)
    longs = F.filter(F.split("text", "\n"), lambda line: F.length(line) > 200)
    found = docs.select("seq", F.substring("text", 1, 100).alias("title"), longs.alias("pairs"))
    total = docs.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return corpus.document_report(dense_index(found, "seq").withColumn("total", total))


# Pages


@query
def page_links(spark, sf):
    pages = i.table(spark, sf, "pages")
    form = extract.CardListing(i.SITE, "nav li", "a")
    return extract.listing_rows(extract.parse_listings(pages, form, ["page_id"]), ["page_id"])


@query
def page_body(spark, sf):
    return extract.body_text(i.table(spark, sf, "pages"), "article")


@query
def page_cutoff(spark, sf):
    docs = i.table(spark, sf, "documents")
    pages = docs.select((F.col("doc_id") % 20).alias("source"), F.expr("doc_id div 20").alias("page_no"), "doc_id", "text")
    return extract.until_first_gap(pages, F.length("text") >= 200).drop("text")


@query
def listing_table(spark, sf):
    form = extract.TableListing(i.SITE, "table.views-table tbody tr")
    return extract.listing_rows(
        extract.parse_listings(i.table_listing_pages(spark, sf), form, ["page_no"]), ["page_no"]
    )


@query
def listing_cards(spark, sf):
    form = extract.CardListing(i.SITE, "div.views-row", "h3 a, .field-title a", ".date-display-single, time")
    return extract.listing_rows(
        extract.parse_listings(i.card_listing_pages(spark, sf), form, ["page_no"]), ["page_no"]
    )


@query
def lookup_join(spark, sf):
    index = i.table(spark, sf, "events").select("event_id", F.concat(F.lit("/d/"), F.col("user_id").cast("string")).alias("url"))
    texts = extract.long_enough(i.table(spark, sf, "documents")).select(
        F.concat(F.lit("/d/"), F.col("doc_id").cast("string")).alias("url"), "text"
    )
    joined = corpus.attach_text(index, texts, spread_by="event_id")
    return joined.select("event_id", "url", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def _corpus(spark, sf):
    sources = [
        corpus_plan.Source(
            "primary", i.table_listing_pages(spark, sf), extract.TableListing(i.SITE, "table.views-table tbody tr"), "div.text"
        ),
        corpus_plan.Source(
            "archive",
            i.card_listing_pages(spark, sf),
            extract.CardListing(i.SITE, "div.views-row", "h3 a", "time"),
            "div.none, div.text",
            lambda title: ft.title_matches(title, **PHRASES),
        ),
    ]
    return corpus_plan.build_corpus(sources, i.article_pages(spark, sf))


@query
def corpus_build(spark, sf):
    numbered = corpus_plan.numbered(_corpus(spark, sf))
    return numbered.select("position", "title", "date", "source", "url", F.md5("text").alias("text_md5"))


# Files


@query
def jsonl_scan(spark, sf):
    path = new_path(spark, "jsonl")
    docs = i.titled_documents(spark, sf).select("title", F.lit(None).cast("string").alias("date"), "source", F.col("seq").cast("string").alias("url"), "text")
    writers.write_jsonl(docs, path)
    return readers.read_jsonl(spark, path, readers.SPEECH_SCHEMA, "*.json")


@query
def jsonl_ordered(spark, sf):
    path = new_path(spark, "jsonl")
    docs = i.table(spark, sf, "documents").select("doc_id", "lang", "text").orderBy("doc_id")
    writers.write_jsonl(docs, path)
    lines = readers.read_jsonl_numbered(spark, path, "doc_id long, lang string", "*.json")
    return lines.select("doc_id", "lang", "position")


@query
def numbered_files(spark, sf):
    path = new_path(spark, "numbered")
    writers.write_numbered(corpus.numbered_first_per_title(i.titled_documents(spark, sf), key_bits=45), path)
    return spark.read.schema("seq long, source string, file_id string").json(path).select(F.col("seq").alias("doc_id"), "source", "file_id")


def _turn_key():
    """One long per turn of a conversation."""
    return F.shiftleft(F.col("conv_id"), 32) + F.col("turn")


@query
def training_set(spark, sf):
    path = new_path(spark, "pairs")
    parsed = _parsed(spark, sf).withColumn("seq", _turn_key())
    writers.write_numbered(writers.numbered_pairs(dense_index(parsed, "seq")), path, per_bucket=16)
    return training.ordered_training_set(spark, path)


@query
def sampled_files(spark, sf):
    path = new_path(spark, "folder")
    suppliers = i.table(spark, sf, "supplier")
    columns = ["s_suppkey", "s_name"]
    lines = suppliers.select(F.col("s_suppkey").alias("position"), writers.record_lines(columns).alias("content"))
    writers.put_files(lines, path)
    return readers.read_sampled_files(spark, path, "s_suppkey long, s_name string", 40)


@query
def pair_files(spark, sf):
    path = new_path(spark, "pairs")
    parsed = _parsed(spark, sf).withColumn("seq", _turn_key())
    writers.write_numbered(writers.numbered_pairs(dense_index(parsed, "seq")), path)
    read = spark.read.schema(f"{readers.PAIR_SCHEMA}, pair_no int, file_id string").json(path)
    return read.select("file_id", "pair_no", "instruction", "input", "output")


@query
def record_table(spark, sf):
    base = new_path(spark, "records")
    events = i.table(spark, sf, "events")
    writers.put_records(_puts(events.where("event_type = 'view'"), "view_value"), base)
    return writers.put_records(_puts(events.where("event_type <> 'view'"), "other_value"), base)


# Pairs


@query
def prompts(spark, sf):
    docs = i.titled_documents(spark, sf).withColumn("date", F.when(F.col("seq") % 2 == 0, F.col("lang")))
    docs = docs.withColumn("title", F.when(F.col("seq") % 3 != 0, F.col("title")))
    return pairs.prompts(docs, TEMPLATE).select(F.col("seq").alias("doc_id"), "prompt")


def _parsed(spark, sf):
    return pairs.parse_pairs(i.responses(spark, sf), ["conv_id", "turn"])


@query
def qa_pairs(spark, sf):
    return pairs.pair_rows(_parsed(spark, sf), ["conv_id", "turn"])


@query
def pair_status(spark, sf):
    return _parsed(spark, sf).groupBy("status").agg(
        F.count(F.lit(1)).alias("responses"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    )


@query
def token_cost(spark, sf):
    return pairs.token_totals(_parsed(spark, sf))


@query
def token_progress(spark, sf):
    usage = i.table(spark, sf, "documents").select(
        "doc_id",
        F.length("text").cast("long").alias("input_tokens"),
        F.expr("cast(length(text) div 4 as long)").alias("output_tokens"),
    )
    return pairs.token_progress(usage, "doc_id")


def digest_generator(prompts):
    """Stand-in for the generation service: one pair made of the whole prompt's digest and length."""
    import hashlib
    import json

    return [
        {
            "response": json.dumps([{"instruction": hashlib.md5(p.encode()).hexdigest(), "output": str(len(p))}]),
            "input_tokens": len(p),
            "output_tokens": 60,
        }
        for p in prompts
    ]


@query
def generated_pairs(spark, sf):
    run = training.generate_pairs(
        i.titled_documents(spark, sf).withColumn("date", F.col("lang")), digest_generator, TEMPLATE, parallelism=8
    )
    return pairs.pair_rows(run.parsed, ["position"])


@query
def resumed_pairs(spark, sf):
    """The same by a run that stops after some parts and is taken up again."""
    docs = i.titled_documents(spark, sf).withColumn("date", F.col("lang"))
    asked = pairs.prompts(docs.withColumn("text", ft.clean_text(F.col("text"))), TEMPLATE)
    folder = new_path(spark, "run")
    pairs.generate_in_parts(asked, digest_generator, ["seq"], folder, parts=3, parallelism=8, max_parts=1)
    answered = pairs.generate_in_parts(asked, digest_generator, ["seq"], folder, parallelism=8)
    return pairs.pair_rows(dense_index(pairs.parse_pairs(answered, ["seq"]), "seq", key_bits=45), ["position"])


@query
def stored_responses(spark, sf):
    stored = i.responses(spark, sf).where(F.col("response").isNotNull()).withColumn("doc_id", _turn_key())
    docs = i.exchanges(spark, sf).select(_turn_key().alias("doc_id"))
    parsed = pairs.parse_pairs(pairs.stored_responses(docs, stored), ["doc_id"])
    return parsed.select("doc_id", "status", F.size("pairs").alias("n_pairs"))


# Training set


@query
def chat_text(spark, sf):
    return i.exchanges(spark, sf).select(
        "conv_id", "turn", ft.chat_text(F.col("instruction"), F.col("output")).alias("text")
    )


@query
def packed_slices(spark, sf):
    return trainset.packed_slices(i.table(spark, sf, "documents"), "doc_id")


@query
def packed_blocks(spark, sf):
    docs = i.table(spark, sf, "documents")
    blocks = trainset.packed_blocks(docs, "doc_id", count_tokens=trainset.count_whitespace_tokens)
    return blocks.select("block", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("content_md5"))


@query
def readiness(spark, sf):
    return trainset.readiness(i.exchanges(spark, sf))


# Jobs


@query
def metric_columns(spark, sf):
    events = i.table(spark, sf, "events").select(
        F.col("user_id").alias("job_id"), F.concat(F.lit("train:"), "event_type").alias("name"), "value", F.col("event_id").alias("seq")
    )
    return jobs.metric_columns(events, [f"train_{t}" for t in EVENT_TYPES])


def _descriptions(events, *extra):
    metric = lambda name, value: F.struct(name.alias("MetricName"), value.cast("double").alias("Value"))
    bought = F.col("event_type") == "purchase"
    k = F.get_json_object("props", "$.k").cast("double")
    return events.select(
        F.concat(F.lit("job-"), F.col("event_id").cast("string")).alias("job_id"),
        F.col("ts").alias("written_at"),
        F.when(bought, "Completed").when(F.col("event_type") == "error", "Failed").alias("TrainingJobStatus"),
        F.struct(F.when(bought, F.col("props")).alias("S3ModelArtifacts")).alias("ModelArtifacts"),
        F.array(
            metric(F.lit("train:loss"), F.col("value")),
            metric(F.lit("eval/k"), k),
            metric(F.lit("train/loss"), F.when(bought, k + 1)),
            metric(F.lit(""), F.lit(1)),
            metric(F.lit("status"), F.lit(2)),
        ).alias("FinalMetricDataList"),
        *extra,
    )


@query
def job_records(spark, sf):
    return jobs.job_records(_descriptions(i.table(spark, sf, "events"))).select(
        "job_id", "timestamp", "status", "model_artifact",
        F.col("metrics")["train_loss"].alias("train_loss"),
        F.col("metrics")["eval_k"].alias("eval_k"),
        F.size("metrics").alias("n_metrics"),
        F.array_join("rejected_metrics", ",").alias("rejected"),
    )


def _puts(events, value_name):
    return events.select(
        F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("timestamp"),
        F.col("event_type").alias("status"),
        F.col("value").alias(value_name),
        F.col("event_id").alias("put_no"),
    )


@query
def record_upsert(spark, sf):
    events = i.table(spark, sf, "events")
    table = jobs.upsert(None, _puts(events.where("event_type = 'view'"), "view_value"))
    return jobs.upsert(table, _puts(events.where("event_type <> 'view'"), "other_value"))


@query
def registry_records(spark, sf):
    models = i.table(spark, sf, "events").where("event_type = 'purchase'").select(
        F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("model_name"),
        F.col("props").alias("model_arn"),
        F.col("ts").alias("written_at"),
        F.col("event_id").alias("put_no"),
    )
    return jobs.registry_records(models)


@query
def job_registry(spark, sf):
    """Job records, imported models and later job records put into one table."""
    events, base = i.table(spark, sf, "events"), new_path(spark, "registry")
    day, number = F.date_trunc("day", "ts").alias("written_at"), F.col("event_id").alias("put_no")
    described = _descriptions(events, "event_type", "user_id", day.alias("day"), number)
    described = described.withColumns({"job_id": F.concat(F.lit("job-"), F.col("user_id").cast("string")), "written_at": F.col("day")})
    models = events.where("event_type = 'purchase'").select(
        F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("model_name"), F.col("props").alias("model_arn"), day, number
    )
    serving.record_jobs(described.where("event_type = 'view'"), base)
    serving.record_models(models, base)
    table = serving.record_jobs(described.where("event_type <> 'view'"), base)
    return table.select(
        "job_id", "timestamp", "status", "model_artifact", "bedrock_model_arn", "model_name", F.col("metrics")["train_loss"].alias("train_loss")
    )


def _polls(events):
    return events.select(
        F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("poll_id"), F.col("event_type").alias("status"),
        F.when(F.col("value") > 20, F.col("props")).alias("reason"),
    )


@query
def first_terminal(spark, sf):
    return jobs.first_terminal(_polls(i.table(spark, sf, "events")), ENDS, "error")


@query
def first_import_end(spark, sf):
    status = F.when(F.col("event_type") == "purchase", "Completed").when(F.col("event_type") == "error", "Failed").otherwise("InProgress")
    events = i.table(spark, sf, "events")
    return jobs.first_terminal(_polls(events.withColumn("event_type", status)), jobs.IMPORT_TERMINAL)


@query
def latest_completed(spark, sf):
    records = i.table(spark, sf, "events").select(
        F.col("user_id").alias("model_name"),
        F.when(F.col("event_type") == "purchase", "Completed").otherwise("Failed").alias("status"),
        F.concat_ws("-", F.col("event_id").cast("string"), "props").alias("model_artifact"),
        F.col("ts").alias("timestamp"),
    )
    return jobs.latest_completed(records, "model_name", "model_artifact")


# Requests and answers


@query
def request_verdicts(spark, sf):
    return requests.verdicts(i.request_log(spark, sf)).select(
        "request_id", "caller", F.length("clean_question").alias("clean_chars"), "reason", "status"
    )


@query
def outcome_report(spark, sf):
    return requests.outcome_report(requests.verdicts(i.request_log(spark, sf)))


@query
def request_payload(spark, sf):
    log = i.request_log(spark, sf)
    body = log.select("request_id", fa.payload(F.col("question"), F.col("max_tokens"), F.col("temperature")).alias("body"))
    read = F.from_json("body", "question string, max_tokens int, temperature double")
    return body.select("request_id", read.alias("b")).select(
        "request_id", F.md5("b.question").alias("question_md5"), "b.max_tokens", "b.temperature"
    )


def _calls(events):
    return events.select(F.col("user_id").alias("caller"), "ts", F.col("event_id").alias("request_id"))


@query
def rate_limit(spark, sf):
    return requests.rate_limit(_calls(i.table(spark, sf, "events")), 2, "1 day").drop("ts")


@query
def rate_limit_anchored(spark, sf):
    return requests.rate_limit_anchored(_calls(i.table(spark, sf, "events")), 2, DAY).drop("ts")


def _chunks(spark, sf):
    return i.line_chunks(answers.encode_answers(i.answer_events(spark, sf)))


@query
def answer_lines(spark, sf):
    lines = answers.encode_answers(i.answer_events(spark, sf))
    return lines.select("request_id", "seq", fa.decode_line(F.col("line")).alias("token"))


@query
def answer_tokens(spark, sf):
    return answers.answer_tokens(_chunks(spark, sf)).select("request_id", "chunk", "token")


@query
def answer_texts(spark, sf):
    return answers.answer_texts(_chunks(spark, sf))


# Streams


# Runs of one stream, so that state goes on from run to run.
PARTS = 2


@query
def rate_limit_stream(spark, sf):
    calls = _calls(i.table(spark, sf, "events"))
    build = lambda stream: stateful.rate_limit_stream(stream, 2, DAY)
    return i.run_stream_in_parts(calls, i.time_part(calls, "ts", PARTS), PARTS, build, "rate-limit")


@query
def first_terminal_stream(spark, sf):
    polls = _polls(i.table(spark, sf, "events"))
    build = lambda stream: stateful.first_terminal_stream(stream, ENDS, "error", idle_seconds=3650 * DAY)
    return i.run_stream_in_parts(polls, i.time_part(polls, "ts", PARTS), PARTS, build, "first-terminal")


@query
def answer_tokens_stream(spark, sf):
    chunks = _chunks(spark, sf)
    part = F.least(F.call_function("div", F.col("chunk"), F.lit(3)), F.lit(PARTS - 1))
    tokens = i.run_stream_in_parts(chunks, part, PARTS, stateful.answer_tokens_stream, "answers")
    return tokens.select("request_id", "chunk", "token")


@query
def answer_bytes(spark, sf):
    return answers.answer_texts(i.noisy_answer_bytes(spark, sf))


@query
def answer_bytes_stream(spark, sf):
    chunks = i.noisy_answer_bytes(spark, sf)
    part = F.least(F.call_function("div", F.col("chunk"), F.lit(3)), F.lit(PARTS - 1))
    return i.run_stream_in_parts(chunks, part, PARTS, stateful.answer_tokens_stream, "answer-bytes").select("request_id", "token")
