"""Secret scans: candidates by shape, false positives removed by a random forest.

A candidate is a run of 16 or more characters of keys and encodings that holds a
letter and a digit. Its features are its length, the kinds of characters and the
transitions between them, the share that dictionary words cover, its path and
the words beside it. The forest is trained from labelled findings: a table of
values with their neighbours, path and label. Without one, findings are made
from templates of keys and of things that look like keys, at most
``LABELLED_ROWS`` of them.

All of it is column expressions and the DataFrame-based learner. Texts are read
once for the candidates; only the few candidates move. Redaction is a second
read of the texts, joined with the findings by id.

Defined results: a null or empty text has no candidates. A value is judged
at each of its places in a document, and the highest score counts. Rows with equal ids (null included) share
their findings. Without any candidate nothing is trained.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribemill.llm.common import fresh
from scribemill.session import stage

LABELLED_ROWS = 6_000
TREES, DEPTH, SEED = 24, 7, 17
THRESHOLD = 0.5
CONTEXT = 32
MASK = "<SECRET>"
BODY = r"[A-Za-z0-9+/_.\-]"
# An equals sign only pads the end of a run, so that the value of NAME=value starts behind it.
END = r"(?![A-Za-z0-9+/_=.\-])"
CANDIDATE = (
    rf"(?<!{BODY})(?=[A-Za-z+/_.\-]{{0,200}}[0-9])(?=[0-9+/_.\-]{{0,200}}[A-Za-z])"
    rf"(?:{BODY}{{16,}}(?:={{1,2}}{END})?|{BODY}{{15}}={{1,2}}{END}|{BODY}{{14}}=={END})"
)

# Names that announce a secret, names that announce something else, and common words in identifiers.
SECRET_NAMES = ("token", "secret", "passw", "pwd", "api_key", "apikey", "api-key", "access_key", "private_key", "credential", "auth", "bearer", "key")
OTHER_NAMES = ("sha1", "sha256", "md5", "checksum", "commit", "digest", "etag", "uuid", "isbn", "version", "revision", "request", "trace", "build", "http", "www", "file", "image")
DICTIONARY = (
    "account", "admin", "api", "application", "archive", "auth", "build", "cache", "client", "code", "com", "config", "content",
    "data", "default", "dev", "document", "download", "dummy", "example", "file", "get", "group", "here", "home", "html",
    "http", "https", "image", "index", "item", "key", "list", "local", "log", "main", "model", "name", "net", "news",
    "number", "org", "page", "password", "path", "photo", "placeholder", "post", "prod", "project", "query", "release",
    "report", "request", "response", "sample", "secret", "server", "service", "set", "size", "source", "static", "string",
    "table", "tar", "test", "the", "token", "type", "update", "upload", "url", "user", "value", "version", "view", "www", "your", "zip",
)
FEATURES = (
    "length", "digits", "upper", "lower", "marks", "vowels", "transitions", "distinct", "hexadecimal", "dictionary",
    "repeats", "secret_name", "other_name", "assigned", "quoted", "dated", "path_depth", "path_tests",
)


def _share(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)).cast("double") / F.length(value)


def _names(text: Column, names) -> Column:
    low = F.lower(text)
    return reduce(operator.or_, [F.contains(low, F.lit(n)) for n in names]).cast("double")


def features(findings: DataFrame) -> DataFrame:
    """Add the columns of ``FEATURES`` to rows with value, left, right and path."""
    v, left, right, path = (F.coalesce(F.col(c), F.lit("")) for c in ("value", "left", "right", "path"))
    low = F.lower(v)
    words = "|".join(sorted((w for w in DICTIONARY if len(w) > 2), key=lambda w: (-len(w), w)))
    covered = F.length(v) - F.length(F.regexp_replace(low, words, ""))
    border = r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[+/_=.\-])(?=[A-Za-z0-9])"
    return findings.withColumns(
        {
            "length": F.least(F.length(v), F.lit(200)).cast("double"),
            "digits": _share(v, "[0-9]"),
            "upper": _share(v, "[A-Z]"),
            "lower": _share(v, "[a-z]"),
            "marks": _share(v, r"[+/_=.\-]"),
            "vowels": _share(low, "[aeiou]"),
            "transitions": _share(v, border),
            "distinct": F.size(F.array_distinct(F.split(v, ""))).cast("double"),
            "hexadecimal": v.rlike(r"^(?:[0-9a-f\-]+|[0-9A-F\-]+)$").cast("double"),
            "dictionary": covered.cast("double") / F.length(v),
            "repeats": _share(v, r"(.)(?=\1)"),
            "secret_name": _names(left, SECRET_NAMES),
            "other_name": _names(F.concat(left, v), OTHER_NAMES),
            "assigned": left.rlike(r"(?:[=:]|\b(?i:is|bearer))\s*[\"'`]?$").cast("double"),
            "quoted": (left.rlike("[\"'`]$") & right.rlike("^[\"'`]")).cast("double"),
            "dated": v.rlike(r"(?:19|20)\d\d[-_.]?[01]\d[-_.]?[0-3]\d").cast("double"),
            "path_depth": F.size(F.split(path, "[/.]")).cast("double"),
            "path_tests": path.rlike("(?i)test|example|sample|docs?/|readme").cast("double"),
        }
    )


def candidates(docs: DataFrame, id_column: str, text: str, path: str | None) -> DataFrame:
    """Columns id, row, value, left, right and path, one row per candidate of a document and place. ``row`` tells rows of equal ids apart.

    The text is cut at the candidates. Two candidates have ``CONTEXT`` characters at least, so the neighbours of one lie
    in the two candidates and the pieces before and behind it.
    """
    rows = docs.select(
        F.col(id_column).alias("id"),
        F.monotonically_increasing_id().alias("row"),
        F.col(text).alias("text"),
        (F.col(path).cast("string") if path else F.lit("")).alias("path"),
    ).where(F.col("text").rlike(CANDIDATE))
    cut = rows.select("id", "row", "path", F.regexp_extract_all("text", F.lit(CANDIDATE), 0).alias("values"), F.split("text", CANDIDATE, -1).alias("pieces"))
    part = lambda parts, i: F.coalesce(F.get(F.col(parts), i), F.lit(""))

    def placed(v: Column, i: Column) -> Column:
        before = F.concat(part("values", i - 2), part("pieces", i - 1), part("values", i - 1), part("pieces", i))
        behind = F.concat(part("pieces", i + 1), part("values", i + 1), part("pieces", i + 2), part("values", i + 2))
        return F.struct(v.alias("value"), F.right(before, F.lit(CONTEXT)).alias("left"), F.left(behind, F.lit(CONTEXT)).alias("right"))

    return cut.select("id", "row", "path", F.explode(F.transform("values", placed)).alias("f")).select("id", "row", "path", "f.*")


def labelled_findings(spark, rows: int = LABELLED_ROWS) -> DataFrame:
    """Findings from templates, half of them secrets: value, left, right, path and label."""
    n = F.col("id")
    pick = lambda salt, size: F.pmod(F.xxhash64(n, F.lit(salt)), F.lit(size)).cast("int")
    one_of = lambda salt, *options: F.element_at(F.array(*[o if isinstance(o, Column) else F.lit(o) for o in options]), pick(salt, len(options)) + 1)
    raw = lambda salt: F.sha2(F.concat(F.lit(salt), n.cast("string")), 256)
    word = lambda salt: one_of(salt, *DICTIONARY[::2], "theon", "eraling", "montar", "gehen", "vivre", "landes", "ciones")
    base64 = lambda salt, length: F.substring(F.regexp_replace(F.base64(F.unhex(raw(salt))), "=", "A"), 1, length)
    plain = lambda salt, length: F.substring(F.regexp_replace(F.base64(F.unhex(raw(salt))), "[+/=]", "x"), 1, length)
    year = (F.lit(1990) + pick("y", 40)).cast("string")
    number = lambda salt, size: pick(salt, size).cast("string")
    secret = one_of(
        "kind",
        F.substring(raw("a"), 1, 40),
        F.substring(raw("b"), 1, 40),
        F.substring(raw("c"), 1, 32),
        raw("d"),
        F.upper(F.substring(raw("e"), 1, 40)),
        base64("f", 40),
        base64("g", 24),
        plain("h", 32),
        F.concat(F.lit("AKIA"), F.upper(plain("i", 16))),
        F.concat(F.lit("ghp_"), plain("j", 36)),
        F.concat(F.lit("sk_live_"), plain("k", 24)),
        F.concat(plain("l", 20), F.lit("."), plain("m", 40)),
    )
    benign = one_of(
        "kind",
        F.concat(F.lit("https."), word("a"), F.lit(".com/"), word("b"), F.lit("/"), word("c"), number("d", 3000)),
        F.concat(word("e"), F.lit("_"), word("f"), F.lit("_"), year, F.lit("-0"), number("g", 9), F.lit("-1"), number("h", 9), F.lit(".tar.gz")),
        F.concat(year, F.lit("-1"), number("i", 2), F.lit("-1"), number("j", 9), F.lit("T10.1"), number("k", 9), F.lit("Z")),
        F.concat(word("l"), F.initcap(word("m")), F.initcap(word("n")), F.initcap(word("o")), number("p", 100)),
        F.concat(F.lit("your_"), word("q"), F.lit("_token_here_"), number("r", 1000)),
        F.concat(F.lit("xxxxxxxxxxxxxxxx"), number("s", 10)),
        F.concat(word("t"), F.lit("."), word("u"), number("v", 10_000), F.lit("-"), word("w"), F.lit(".org")),
        F.substring(raw("x"), 1, 40),
        raw("y"),
        F.regexp_replace(F.substring(raw("z"), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"),
        F.concat(word("aa"), F.lit("-"), word("bb"), F.lit("-"), word("cc"), F.lit("-"), number("dd", 100_000)),
        F.concat(F.lit("ISBN978-"), number("ee", 10), F.lit("-"), number("ff", 10_000), F.lit("-"), number("gg", 10_000)),
    )
    announced = one_of("left", 'token = "', "api_key: ", "password=", "secret_key = '", "Authorization: Bearer ", 'TOKEN = "', "auth_token:", 'access_key="', "SECRET ", 'apiKey: "')
    close = F.when(F.substring(F.col("left"), -1, 1).isin('"', "'"), F.substring(F.col("left"), -1, 1)).otherwise(" ")
    innocent = one_of("left", "the ", "see ", "commit ", "sha256: ", "request id ", "download ", "file=", "version ", 'etag: "', "md5 = ", "and ", "image ")
    is_secret = (n % 2) == 0
    # Placeholders also stand behind names of secrets; digests and identifiers do not.
    placeholder = pick("kind", 12).isin(3, 4, 5, 10)
    left = F.when(is_secret | (placeholder & (pick("swap", 2) == 0)), announced).otherwise(innocent)
    return (
        spark.range(0, rows, 1, 1)
        .select("id", is_secret.cast("double").alias("label"), F.when(is_secret, secret).otherwise(benign).alias("value"), F.concat(word("before"), F.lit(" "), left).alias("left"),
                one_of("path", "src1", "src7", "app/settings.py", "config/prod.env", "docs/readme.md", "web/index.html", "").alias("path"))
        .withColumn("right", F.concat(close, F.lit(" "), word("after")))
    )


def train_forest(labelled: DataFrame, rows: int = LABELLED_ROWS) -> RandomForestClassificationModel:
    """A forest from at most ``rows`` labelled findings, the ones with the smallest hashes if there are more."""
    used = features(labelled.orderBy(F.xxhash64("value", "left", "right", "label")).limit(rows)).coalesce(1)
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(used)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label").fit(assembled)


def score(findings: DataFrame, model: RandomForestClassificationModel) -> DataFrame:
    """Add ``score``, the forest's vote that the finding is a secret."""
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features(findings))
    scored = model.transform(assembled)
    return scored.select(*findings.columns, vector_to_array("probability")[1].alias("score"))


def scan_secrets(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    path: str | None = "source",
    labelled: DataFrame | None = None,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per id that has candidates: the id, n_candidates, n_secrets, max_score and secrets, the values in order."""
    spark = docs.sparkSession
    found = stage(candidates(docs, id_column, text, path), "candidates")
    if found.isEmpty():
        scored = found.withColumn("score", F.lit(0.0))
    else:
        scored = score(found, train_forest(labelled if labelled is not None else labelled_findings(spark)))
    scored = scored.groupBy("id", "row", "value").agg(F.max("score").alias("score"))
    # Longest first, so that redacting one value never cuts into another.
    secret = F.when(F.col("score") >= threshold, F.struct((-F.length("value")).alias("n"), F.col("value").alias("value")))
    return scored.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.count(secret).alias("n_secrets"),
        F.max("score").alias("max_score"),
        F.transform(F.array_sort(F.collect_set(secret)), lambda s: s["value"]).alias("secrets"),
    ).withColumnRenamed("id", id_column)


def redacted(text: Column, secrets: Column, mask: str = MASK) -> Column:
    """The text with every secret replaced."""
    none = F.array().cast("array<string>")
    return F.aggregate(F.coalesce(secrets, none), text, lambda t, s: F.replace(t, s, F.lit(mask)))


def redact_documents(docs: DataFrame, id_column: str = "doc_id", text: str = "text", path: str | None = "source", **options) -> DataFrame:
    """The rows with secrets masked in their texts; all other columns stay."""
    key, values = fresh("id"), fresh("secrets")
    found = scan_secrets(docs, id_column, text, path, **options).where("n_secrets > 0")
    found = stage(found.select(F.col(id_column).alias(key), F.col("secrets").alias(values)), "secrets")
    joined = docs.join(found, docs[id_column].eqNullSafe(found[key]), "left")
    return joined.select(*[redacted(docs[c], F.col(values)).alias(c) if c == text else docs[c] for c in docs.columns])
