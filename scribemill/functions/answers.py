"""Columns for requests and answer-stream lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DONE = "[DONE]"
DATA_PREFIX = "data:"
# The encoding in which every byte is one character.
BYTE_CHARS = "ISO-8859-1"
# Request limits and defaults.
MAX_QUESTION_CHARS = 4000
MAX_TOKENS_LIMIT = 4096
MAX_TEMPERATURE = 2.0
DEFAULT_MAX_TOKENS = 512
DEFAULT_TEMPERATURE = 0.7

# The characters that a browser's String.trim removes.
_JS_SPACE_CHARS = (
    "\t\n\v\f\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
_STRICT_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def js_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(_JS_SPACE_CHARS))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def utf8_text(data: Column) -> Column:
    """Bytes as text; what is not UTF-8 becomes U+FFFD, one for each longest broken piece, as a browser's TextDecoder does."""
    return F.make_valid_utf8(data.cast("string"))


def encode_line(text: Column) -> Column:
    """One answer piece as a stream line."""
    return F.concat(F.lit("data: "), F.to_json(F.struct(text.alias("token"))))


def done_line() -> Column:
    return F.lit(f"data: {DONE}")


def _json_token(data: Column) -> Column:
    """``token`` of a JSON object, null for anything that is not exactly one JSON value.

    ``from_json`` ignores text after the first value. Reading the payload once
    as the only array element and once as the only object member leaves no
    trailing text that both readings accept.
    """
    in_array = F.from_json(F.concat(F.lit("["), data, F.lit("]")), "array<struct<token:string>>", _STRICT_JSON)
    in_object = F.from_json(
        F.concat(F.lit('{"v":'), data, F.lit("}")), "struct<v:struct<token:string>>", _STRICT_JSON
    )
    both = F.struct(in_array.alias("a"), in_object["v"]["token"].alias("t"))
    return let(
        both, lambda b: F.when((F.size(b["a"]) == 1) & F.get(b["a"], F.lit(0))["token"].eqNullSafe(b["t"]), b["t"])
    )


def decode_line(line: Column) -> Column:
    """Token of a stream line, ``[DONE]`` for the end mark, null for any other line."""

    def token(data: Column) -> Column:
        return F.when(data == DONE, F.lit(DONE)).when(data.startswith("{"), _json_token(data))

    def content(trimmed: Column) -> Column:
        data = js_trim(F.substring(trimmed, len(DATA_PREFIX) + 1, 2**31 - 1))
        return F.when(trimmed.startswith(DATA_PREFIX), let(data, token))

    return let(js_trim(line), content)


def payload(question: Column, max_tokens: Column | None = None, temperature: Column | None = None) -> Column:
    """JSON request body with the defaults filled in."""
    tokens = F.lit(DEFAULT_MAX_TOKENS) if max_tokens is None else F.coalesce(max_tokens, F.lit(DEFAULT_MAX_TOKENS))
    temp = F.lit(DEFAULT_TEMPERATURE) if temperature is None else F.coalesce(temperature, F.lit(DEFAULT_TEMPERATURE))
    return F.to_json(F.struct(question.alias("question"), tokens.alias("max_tokens"), temp.alias("temperature")))


def caller(user_id: Column, address: Column) -> Column:
    """The user id when there is a non-empty one, else the client address."""
    return F.coalesce(F.nullif(user_id.cast("string"), F.lit("")), address.cast("string"))


def invalid_reason(
    question: Column,
    max_tokens: Column,
    temperature: Column,
    question_chars: int = MAX_QUESTION_CHARS,
    tokens_limit: int = MAX_TOKENS_LIMIT,
    temperature_limit: float = MAX_TEMPERATURE,
) -> Column:
    """Why a request is rejected before it is read any further; null when it is valid."""
    tokens = F.coalesce(max_tokens, F.lit(DEFAULT_MAX_TOKENS))
    temp = F.coalesce(temperature, F.lit(DEFAULT_TEMPERATURE))
    return (
        F.when(question.isNull(), "question missing")
        .when(F.length(question) < 1, "question empty")
        .when(F.length(question) > question_chars, "question too long")
        .when((tokens < 1) | (tokens > tokens_limit), "max_tokens out of range")
        .when(F.isnan(temp) | (temp < 0.0) | (temp > temperature_limit), "temperature out of range")
    )


def service_status(error: Column, not_ready: str = "ModelNotReadyException", throttled: str = "ThrottlingException") -> Column:
    """HTTP status for the error name a service call ended with; null error means 200."""
    return (
        F.when(error.isNull(), 200).when(error == not_ready, 503).when(error == throttled, 429).otherwise(500)
    )


def client_view(status: Column) -> Column:
    """What the browser does with a status."""
    return (
        F.when(status == 401, "sign_in")
        .when(status == 503, "warming")
        .when((status < 200) | (status > 299), "error")
        .otherwise("answer")
    )
