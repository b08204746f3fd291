"""Tri-state fields as columns: struct(state, value, confidence, source), and extractors that make them.

State is known, unknown (value is a guess, confidence the guess's) or absent. All extractors take a token column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The analytic fields and their Spark types.
TYPES = {"timestamp": "timestamp", "ip": "string", "method": "string", "path": "string", "status": "int", "latency_ms": "double", "level": "string", "message": "string"}
STANDARD = [f for f in TYPES if f != "message"]

# Words that stand for levels, and how sure they are.
LEVELS = {
    "ERROR": "ERROR", "SEVERE": "ERROR", "ERR": "ERROR", "WARN": "WARN", "WARNING": "WARN", "INFO": "INFO", "INF": "INFO",
    "DEBUG": "DEBUG", "DBG": "DEBUG", "TRACE": "TRACE", "TRC": "TRACE", "FATAL": "FATAL", "FTL": "FATAL",
    "CRITICAL": "CRITICAL", "CRIT": "CRITICAL", "CRT": "CRITICAL",
}
HINTS = {"FAILURE": "ERROR", "FAIL": "ERROR", "FAILED": "ERROR", "TIMEOUT": "ERROR", "EXCEPTION": "ERROR", "REFUSED": "ERROR", "DENIED": "WARN", "UNAUTHORIZED": "WARN", "PANIC": "FATAL"}
LETTERS = {"E": "ERROR", "W": "WARN", "I": "INFO", "D": "DEBUG", "T": "TRACE", "F": "FATAL", "C": "CRITICAL"}
METHODS = ["GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS", "CONNECT", "TRACE"]
MAX_MS = 120_000.0


def schema(kind: str) -> str:
    return f"struct<state:string,value:{kind},confidence:double,source:string>"


def _field(state: str, value, confidence, kind: str, source=None) -> Column:
    return F.struct(F.lit(state).alias("state"), value.cast(kind).alias("value"), F.lit(confidence).cast("double").alias("confidence"), (F.lit(source) if source is None or isinstance(source, str) else source).cast("string").alias("source"))


def known(value: Column, confidence, kind: str = "string", source=None) -> Column:
    return _field("known", value, confidence, kind, source)


def unknown(value: Column, confidence, kind: str = "string") -> Column:
    return _field("unknown", value, confidence, kind)


def absent(kind: str = "string") -> Column:
    return _field("absent", F.lit(None), 0.0, kind)


def or_absent(field: Column, kind: str) -> Column:
    return F.coalesce(field, absent(kind))


def rank(field: Column) -> Column:
    return F.when(field["state"] == "known", 3).when(field["state"] == "unknown", 2).otherwise(1)


def better(current: Column, candidate: Column) -> Column:
    """The candidate only where it is strictly better by state, then by confidence."""
    wins = (rank(candidate) > rank(current)) | ((rank(candidate) == rank(current)) & (candidate["confidence"] > current["confidence"]))
    return F.when(wins, candidate).otherwise(current)


def value_or(field: Column, default: Column) -> Column:
    return F.when(field["state"].isin("known", "unknown"), F.coalesce(field["value"], default)).otherwise(default)


def known_value(field: Column) -> Column:
    return F.when(field["state"] == "known", field["value"])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def clean(token: Column) -> Column:
    return F.btrim(token, F.lit(" []\"'(),;"))


def _map(words: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in words.items() for x in pair])


def _six(t: Column) -> Column:
    """An IPv6 address in its canonical spelling: no leading zeros, the first longest run of zero groups as '::'."""
    sides = F.split(F.lower(t), "::")
    parts = lambda i: F.filter(F.split(F.coalesce(F.get(sides, F.lit(i)), F.lit("")), ":"), lambda x: x != "")
    groups = F.flatten(F.array(parts(0), F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(parts(0)) - F.size(parts(1)))), parts(1)))
    full = F.array_join(F.transform(groups, lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":")

    def shortened(x: Column) -> Column:
        out = F.when(F.lit(False), x)
        for n in range(8, 1, -1):
            run = f"^(.*?)(?:^|:)0(?::0){{{n - 1}}}(?::|$)"
            out = out.when(x.rlike(run), F.regexp_replace(x, run, "$1::"))
        return out.otherwise(x)

    return let(full, shortened)


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_GROUP = "[0-9A-Fa-f]{1,4}"


def ip(token: Column) -> Column:
    """IPv4 without leading zeros, or IPv6, in canonical text."""

    def of(t: Column) -> Column:
        six = t.rlike(f"^(?:{_GROUP}:){{7}}{_GROUP}$") | (t.rlike(f"^(?:(?:{_GROUP}:)*{_GROUP})?::(?:(?:{_GROUP}:)*{_GROUP})?$") & (F.regexp_count(t, F.lit(_GROUP)) <= 7))
        dots = F.length(t) - F.length(F.replace(t, F.lit("."), F.lit("")))
        return F.when((dots == 3) & t.rlike(f"^(?:{_OCTET}\\.){{3}}{_OCTET}$"), known(t, 0.95)).when(dots == 3, unknown(t, 0.2)).when(t.contains(":") & six, known(_six(t), 0.95)).otherwise(absent())

    return let(clean(token), of)


def method(token: Column) -> Column:
    return let(F.upper(clean(token)), lambda t: F.when(t.isin(METHODS), known(t, 0.99)).when(t.rlike("^\\p{L}{3,10}$"), unknown(t, 0.3)).otherwise(absent()))


def path(token: Column) -> Column:
    bare = lambda c: F.regexp_extract(c, "^([^?#]*)", 1)
    of_url = lambda t: let(F.regexp_extract(t, "^[a-zA-Z]+://[^/?#]+([^?#]*)", 1), lambda p: F.when(p != "", known(p, 0.9)).otherwise(known(F.lit("/"), 0.8)))
    return let(clean(token), lambda t: F.when(t.startswith("/") & ~t.contains(" "), known(bare(t), 0.95)).when(t.rlike("^(?i:https?)://[^/?#]+"), of_url(t)).otherwise(absent()))


def status(token: Column) -> Column:
    number = let(clean(token), lambda t: F.when(t.rlike("^[0-9]{1,9}$"), t.try_cast("int")))
    return let(number, lambda n: F.when(n.between(100, 599), known(n, 0.9, "int")).when(n.between(600, 999), unknown(n, 0.4, "int")).otherwise(absent("int")))


# Units of time and how many milliseconds each is.
UNITS = {"ms": 1.0, "milliseconds": 1.0, "s": 1000.0, "sec": 1000.0, "seconds": 1000.0, "us": 1e-3, "ns": 1e-6}
_DURATION = f"^([0-9]+(?:[.][0-9]+)?)[ \\t]*({'|'.join(sorted(UNITS, key=len, reverse=True))}|)$"


def _scale(unit: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair]), unit)


def latency(token: Column, bare_is_ms: Column | None = None) -> Column:
    """Milliseconds; a bare number is a guess unless `bare_is_ms` says that its key means milliseconds."""

    def of(t: Column) -> Column:
        v, unit = F.regexp_extract(t, _DURATION, 1).cast("double"), F.regexp_extract(t, _DURATION, 2)
        bare = F.when(F.lit(False) if bare_is_ms is None else bare_is_ms, known(v, 0.95, "double")).otherwise(unknown(v, 0.5, "double"))
        in_ms = lambda ms: F.when(~unit.isin("us", "ns") & (ms > MAX_MS), unknown(ms, 0.3, "double")).otherwise(known(ms, 0.95, "double"))
        return F.when(~t.rlike(_DURATION), absent("double")).when(unit == "", bare).otherwise(let(v * _scale(unit), in_ms))

    return let(F.lower(F.regexp_replace(clean(token), "\u00c2?[\u00b5\u03bc]", "u")), of)


def level(token: Column) -> Column:
    def of(t: Column) -> Column:
        exact, hint, letter = (F.try_element_at(_map(m), t) for m in (LEVELS, HINTS, LETTERS))
        return F.when(exact.isNotNull(), known(exact, 0.98)).when(hint.isNotNull(), known(hint, 0.85)).when(letter.isNotNull(), known(letter, 0.6)).when(F.btrim(token).rlike("^\\[\\p{L}+\\]$"), unknown(t, 0.4)).otherwise(absent())

    return let(F.upper(clean(token)), of)


# Patterns over a whole line: a key of a few, its sign, and a value.


def _keyed(keys: list[str], value: str) -> str:
    return f"(?i)(?<![\\w])({'|'.join(keys)})[:=]\\s*{value}(?![\\w])"


_STATUS = _keyed(["status", "status_code", "sc-status", "http_status"], "([0-9]{3})")
_LEVEL = _keyed(["level", "lvl", "severity", "log_level"], "([a-z]+)")
_BOXED = f"(?i)\\[({'|'.join(w for w in ['ERROR', 'WARNING', 'WARN', 'INFO', 'DEBUG', 'TRACE', 'FATAL', 'CRITICAL'])})\\]"
_TOOK = _keyed(["time", "duration_ms", "latency_ms", "response_time", "elapsed"], "([0-9]+(?:[.][0-9]+)?)\\s*(ms|milliseconds|s|sec|seconds|)")
_REQUEST = f'(?i)"\\s*({"|".join(METHODS[:7])})\\s+([^\\s"]+)\\s+HTTP/[0-9.]+"'


def line_status(raw: Column) -> Column:
    return let(F.regexp_extract(raw, _STATUS, 2), lambda n: F.when(n != "", status(n)).otherwise(absent("int")))


def line_level(raw: Column) -> Column:
    boxed = lambda: let(F.regexp_extract(raw, _BOXED, 1), lambda b: F.when(b != "", level(b)).otherwise(absent()))
    return let(level(F.regexp_extract(raw, _LEVEL, 2)), lambda f: F.when(f["state"] == "known", f).otherwise(boxed()))


def line_latency(raw: Column) -> Column:
    """An explicit unit holds; else a number from 1000 on or under a key of milliseconds is one of those, others are seconds up to 120."""
    key, unit = F.lower(F.regexp_extract(raw, _TOOK, 1)), F.lower(F.regexp_extract(raw, _TOOK, 3))

    def of(v: Column) -> Column:
        seconds = F.when((v > 0) & (v <= 120), v * 1000)
        ms = F.when(unit.isin("ms", "milliseconds"), v).when(unit != "", seconds).when((v >= 1000) | key.isin("duration_ms", "latency_ms", "response_time"), v).otherwise(seconds)
        return let(ms, lambda x: F.when(x <= MAX_MS, known(x, 0.88, "double")).otherwise(absent("double")))

    return F.when(raw.rlike(_TOOK), let(F.regexp_extract(raw, _TOOK, 2).cast("double"), of)).otherwise(absent("double"))


def line_method(raw: Column) -> Column:
    return let(F.regexp_extract(raw, _REQUEST, 1), lambda m: F.when(m != "", method(m)).otherwise(absent()))


def line_path(raw: Column) -> Column:
    return let(F.regexp_extract(raw, _REQUEST, 2), lambda p: F.when(p != "", path(p)).otherwise(absent()))
