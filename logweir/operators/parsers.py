"""Parsers: a record's fields as struct columns, by format, with a token scan where the format's parser falls short.

All are column expressions. Each record becomes texts to extract from: named values (JSON, key=value), parts of a line
(CLF, syslog) or cells (delimited). The same extractors then serve all formats. One generator node holds the whole, so
that a filter or a projection above it never works it out a second time.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.config import Config
from logweir.functions import fields as X
from logweir.functions.fields import absent, better, known, let
from logweir.functions.probe import delimiter, probe
from logweir.functions.timestamps import SCALES, timestamp

# The keys under which a record may carry each field, in order of precedence.
ALIASES = {
    "timestamp": ["timestamp", "time", "ts", "@timestamp", "datetime"],
    "ip": ["ip", "ipAddress", "clientIp", "client_ip", "host"],
    "method": ["method", "httpMethod", "http_method", "verb"],
    "path": ["path", "urlPath", "url_path", "uri", "url", "request"],
    "status": ["status", "statusCode", "status_code", "code"],
    "latency_ms": ["responseTime", "responseTimeMs", "response_time", "duration", "duration_ms", "latency", "latency_ms", "timeMs", "time_ms"],
    "level": ["level", "logLevel", "log_level", "severity"],
    "message": ["message", "msg", "log", "text"],
}
# Those whose bare numbers are milliseconds.
MILLISECONDS = ["responseTimeMs", "response_time_ms", "duration_ms", "latency_ms", "time_ms", "elapsed_ms"]
# Levels of syslog's severities, from 0 on.
SEVERITIES = ["FATAL", "CRITICAL", "CRITICAL", "ERROR", "WARN", "INFO", "INFO", "DEBUG"]
#: Aliases that key=value lines do not know.
_NOT_KV = {"@timestamp", "request"}
#: Warnings of parsers.
NOT_JSON, PREFIXED, OVERRIDDEN = "no JSON object", "text before the JSON object", "the message's level overrides the priority's"

_CLF = r'^([^ ]+) +[^ ]+ +[^ ]+ +\[([^\]]*)\] +"([^"]*)" +([0-9]{3}) +[^ ]+(?: +"[^"]*" +"[^"]*")?$'
_RFC5424 = r"^<([0-9]+)>1 +([^ ]+) +([^ ]+) +[^ ]+ +[^ ]+ +[^ ]+ +(?:-|\[[^\]]+\]) +(.*)$"
_RFC3164 = r"^<([0-9]+)>([A-Za-z]{3} +[0-9]{1,2} +[0-9]{2}:[0-9]{2}:[0-9]{2}) +([^ ]+) +(.*)$"
_PAIR = r'([\w.@-]+)=(?:"([^"]*)"|([^\s]+))'
EXTRACT = {"ip": X.ip, "method": X.method, "path": X.path, "status": X.status, "latency_ms": X.latency, "level": X.level}


def _of_one(make):
    """A function of one column alone: higher-order functions pass places to others."""
    return lambda c: make(c)


def _like(shape: str):
    return lambda c: c.rlike(shape)


def _strings(*items: str | None) -> Column:
    return F.array(*[F.lit(i).cast("string") for i in items])


def _groups(text: Column, shape: str, n: int) -> Column:
    """The groups of a match, null where there is none."""
    return F.when(text.rlike(shape), F.array(*[F.regexp_extract(text, shape, i) for i in range(1, n + 1)]))


def _entries(raw: Column, hint: Column) -> Column:
    """struct(keys, values) of JSON objects and key=value lines, later entries first; null where there is none."""
    both = lambda keys, values: F.struct(F.reverse(keys).alias("keys"), F.reverse(values).alias("values"))
    of_json = let(F.from_json(F.substring(raw, F.greatest(F.instr(raw, "{"), F.lit(1)), F.length(raw)), "map<string,string>"), lambda m: F.when(F.map_keys(m).isNotNull(), both(F.map_keys(m), F.map_values(m))))
    pairs = lambda i: F.regexp_extract_all(raw, F.lit(_PAIR), F.lit(i))
    plain = lambda keys: both(keys, F.zip_with(pairs(2), pairs(3), lambda a, b: F.when(a != "", a).otherwise(b)))
    cells = F.filter(F.split(raw, "\t"), lambda c: c.rlike("[=:]"))
    side = lambda n: F.transform(cells, lambda c: F.btrim(F.regexp_extract(c, "^([^=:]*)[=:]((?s:.*))$", n)))
    of_kv = let(pairs(1), lambda keys: F.when(F.size(keys) >= 2, plain(keys)).when(raw.contains("\t") & (F.size(cells) >= 2), both(side(1), side(2))))
    return F.when(hint == "json", of_json).when(hint == "kv", of_kv)


def _lookup(entries: Column, name: str, hint: Column) -> Column:
    """struct(key, value) of the first alias among the keys; null where none is."""
    known_to_kv = [a for a in ALIASES[name] if a not in _NOT_KV]
    aliases = _strings(*ALIASES[name]) if known_to_kv == ALIASES[name] else F.when(hint == "kv", _strings(*known_to_kv)).otherwise(_strings(*ALIASES[name]))
    first = F.get(F.filter(aliases, lambda a: F.array_contains(entries["keys"], a)), F.lit(0))
    value = lambda k: F.get(entries["values"], F.array_position(entries["keys"], k).cast("int") - 1)
    # A null of JSON is the text None to extractors, and no value at all as message or latency.
    return let(first, lambda k: F.when(k.isNotNull(), F.struct(k.alias("key"), (value(k) if name in ("message", "latency_ms") else F.coalesce(value(k), F.lit("None"))).alias("value"))))


def _texts(raw: Column, hint: Column, sep: Column) -> Column:
    """What each field of a record is extracted from: struct(cells, bare_ms, pri, and a text for each field)."""
    trimmed = F.btrim(raw, F.lit(" \t\n\x0b\x0c\r"))
    cells = F.when(hint == "delimited", let(F.transform(F.split(raw, F.concat(F.lit("["), F.coalesce(sep, F.lit("|")), F.lit("]"))), lambda c: F.btrim(c, F.lit(" \t\n\x0b\x0c\r"))), lambda c: F.when(F.size(c) >= 3, c)))
    parts = F.when(hint == "clf", _groups(trimmed, _CLF, 4)).when(hint == "syslog", F.coalesce(_groups(trimmed, _RFC5424, 4), _groups(trimmed, _RFC3164, 4)))

    def of(x: Column) -> Column:
        entries, cells, parts = x["entries"], x["cells"], x["parts"]
        word = lambda i: F.get(F.split(F.btrim(F.get(parts, F.lit(2))), "\\s+"), F.lit(i))
        of_clf = {"ip": F.get(parts, F.lit(0)), "timestamp": F.get(parts, F.lit(1)), "method": F.nullif(word(0), F.lit("")), "path": word(1), "status": F.get(parts, F.lit(3)), "message": F.get(parts, F.lit(2))}
        of_syslog = {"timestamp": F.get(parts, F.lit(1)), "ip": F.get(parts, F.lit(2)), "level": F.get(F.split(F.btrim(F.get(parts, F.lit(3))), "\\s+"), F.lit(0)), "message": F.get(parts, F.lit(3))}
        texts = []
        for f in X.TYPES:
            found = _lookup(entries, f, hint)
            if f == "latency_ms":
                texts.append(let(found, lambda e: F.struct(e["value"].alias("text"), F.coalesce(e["key"].isin(MILLISECONDS), F.lit(False)).alias("bare"))).alias(f))
                continue
            text = F.when(entries.isNotNull(), found["value"])
            for name, of_format in (("clf", of_clf), ("syslog", of_syslog)):
                if f in of_format:
                    text = text.when(hint == name, of_format[f])
            texts.append(text.alias(f))
        return F.struct(cells.alias("cells"), F.when(hint == "syslog", F.get(parts, F.lit(0)).try_cast("int")).alias("pri"), *texts)

    return let(F.struct(_entries(raw, hint).alias("entries"), cells.alias("cells"), parts.alias("parts")), of)


def _primary(raw: Column, t: Column, hint: Column, config: Config, year: Column) -> Column:
    """struct of all fields as the format's own parser finds them."""
    header = [(c.lower().replace("-", "_"), n) for n, keys in ALIASES.items() for c in keys]
    names = F.create_map(*[F.lit(x) for pair in dict(header).items() for x in pair])
    named = F.size(F.array_distinct(F.filter(F.transform(t["cells"], lambda c: F.try_element_at(names, F.replace(F.lower(c), F.lit("-"), F.lit("_")))), lambda n: n.isNotNull())))
    # A row of names: its cells hold no values.
    is_header = F.coalesce(named >= 2, F.lit(False))
    of_cells = lambda make: F.when(is_header, F.transform(t["cells"], lambda c: make(F.lit("")))).otherwise(F.transform(t["cells"], _of_one(make)))
    each = {"timestamp": lambda c: timestamp(c, config, year), **EXTRACT}

    def candidates(f: str) -> Column:
        """A field of each cell, or the one of the field's own text."""
        if f == "latency_ms":
            texts = F.when(t["cells"].isNotNull(), F.transform(t["cells"], lambda c: F.struct(c.alias("text"), F.lit(False).alias("bare")))).when(t[f]["text"].isNotNull(), F.array(t[f]))
            return F.transform(texts, lambda c: X.latency(c["text"], c["bare"]))
        return F.transform(F.when(t["cells"].isNotNull(), t["cells"]).when(t[f].isNotNull(), F.array(t[f])), _of_one(each[f]))

    def fits(f: str, x: Column) -> Column:
        least = 0.7 if f == "timestamp" else 0.8
        sure = x["confidence"] / F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for pair in SCALES.items() for v in pair]), x["source"]), F.lit(1.0)) if f == "timestamp" else x["confidence"]
        return (x["state"] == "known") & (sure > least)

    def chosen(all_: Column) -> Column:
        """The last fitting cell of each field; cells that fit none make the message."""
        cells = t["cells"]
        picked = {f: F.coalesce(F.when(cells.isNotNull() & ~is_header, F.try_element_at(F.filter(all_[f], partial(fits, f)), F.lit(-1))).when(cells.isNull(), F.get(all_[f], F.lit(0))), absent(X.TYPES[f])) for f in X.STANDARD}
        unfit = lambda i: ~F.coalesce(F.array_max(F.array(*[fits(f, F.get(all_[f], i)) for f in X.STANDARD])), F.lit(False))
        rest = F.when(is_header, cells).otherwise(F.filter(cells, lambda c, i: unfit(i)))
        # CLF times that are well-formed: a little surer, labelled as set by configuration.
        picked["timestamp"] = let(picked["timestamp"], lambda ts: F.when((hint == "clf") & (ts["source"] == "explicit_offset"), known(ts["value"], 0.93, "timestamp", "configured_local")).otherwise(ts))
        by_pri = known(F.get(_strings(*SEVERITIES), F.pmod(t["pri"], F.lit(8))), 0.95)
        picked["level"] = let(picked["level"], lambda level: F.when(t["pri"].isNull() | ((level["state"] == "known") & (level["confidence"] >= 0.95)), level).otherwise(by_pri))
        message = F.when(cells.isNotNull(), F.when(F.size(rest) > 0, known(F.array_join(rest, " | "), 1.0))).when(t["message"].isNotNull(), known(t["message"], 1.0))
        return F.struct(*[c.alias(f) for f, c in picked.items()], F.coalesce(message, absent()).alias("message"))

    def enough(found: Column) -> Column:
        """Cells make a record only where two fields or more come out of them, or names."""
        n = sum((F.when(found[f]["state"] == "absent", 0).otherwise(1) for f in X.STANDARD), F.lit(0))
        n = n + F.when(F.size(F.filter(t["cells"], lambda c: F.lit(True))) > 0, F.when(found["message"]["state"] == "known", 1).otherwise(0)).otherwise(0)
        return F.when(t["cells"].isNull() | is_header | (n >= 2), found).otherwise(F.struct(*[absent(k).alias(f) for f, k in X.TYPES.items()]))

    return let(F.struct(*[candidates(f).alias(f) for f in X.STANDARD]), lambda a: let(chosen(a), enough))


def _scanned(raw: Column, mine: Column, hunted: Column) -> Column:
    """Fields merged with those of the text's tokens and of patterns over the whole line."""
    line = {"status": X.line_status, "level": X.line_level, "latency_ms": X.line_latency, "method": X.line_method, "path": X.line_path}
    # Only tokens that can hold a field are looked at: others would come out absent.
    may = {"ip": "[.:]", "method": "\\p{L}{3}", "path": "/", "status": "[0-9]", "latency_ms": "[0-9]", "level": "\\p{L}"}

    def of(tokens: Column) -> Column:
        out = []
        for f, kind in X.TYPES.items():
            if f not in EXTRACT:
                out.append(better(mine[f], hunted if f == "timestamp" else known(raw, 1.0)).alias(f))
                continue
            found = F.filter(F.transform(F.filter(tokens, _like(may[f])), _of_one(EXTRACT[f])), lambda x: x["state"] != "absent")
            best = F.aggregate(found, absent(kind), better)
            if f in line:
                best = let(best, lambda x, f=f: F.when(x["state"] == "known", x).otherwise(let(line[f](raw), lambda y: better(x, y))))
            out.append(let(best, lambda x, f=f: better(mine[f], x)).alias(f))
        return F.struct(*out)

    return let(F.filter(F.split(raw, "\\s+"), lambda x: x != ""), of)


def _quality(found: Column) -> Column:
    """Mean confidence of the standard fields that are known."""
    sure = F.filter(F.array(*[F.when(found[f]["state"] == "known", found[f]["confidence"]) for f in X.STANDARD]), lambda c: c.isNotNull())
    return let(sure, lambda s: F.when(F.size(s) > 0, F.aggregate(s, F.lit(0.0), lambda a, c: a + c) / F.size(s)).otherwise(0.0))


def record(raw: Column, config: Config, year: Column | None = None) -> Column:
    """struct(parser, quality, warnings, and a struct for each field) of a record's text."""
    year = F.lit(None).cast("int") if year is None else year

    def of(r: Column) -> Column:
        raw, hint, year = r["raw"], r["hint"], r["year"]
        tried = (r["confidence"] >= 0.6) & (hint != "unknown")

        def done(x: Column) -> Column:
            mine, quality = x["mine"], x["quality"]
            any_known = F.array_contains(F.array(*[mine[f]["state"] for f in X.TYPES]), "known")
            good = tried & any_known & (quality >= config.threshold)
            dated = F.struct(*[(better(mine[f], x["hunted"]) if f == "timestamp" else mine[f]).alias(f) for f in X.TYPES])
            best = F.when(good, dated).otherwise(_scanned(raw, mine, x["hunted"]))
            parser = F.when(good, hint).when(tried, F.concat(hint, F.lit("+tokenExtractor"))).otherwise("tokenExtractor")
            odd = F.filter(F.array(F.when((hint == "json") & tried & ~any_known, F.lit(NOT_JSON)), F.when((hint == "json") & (r["confidence"] < 0.9) & any_known, F.lit(PREFIXED)), F.when((hint == "syslog") & any_known & (x["pri_level"] != mine["level"]["value"]), F.lit(OVERRIDDEN))), lambda w: w.isNotNull())
            return let(best, lambda b: F.struct(parser.alias("parser"), F.when(good, quality).otherwise(_quality(b)).alias("quality"), odd.alias("warnings"), *[b[f].alias(f) for f in X.TYPES]))

        def judged(t: Column) -> Column:
            def with_quality(mine: Column) -> Column:
                hunted = F.when(mine["timestamp"]["state"] == "known", absent("timestamp")).otherwise(timestamp(raw, config, year))
                level = F.get(_strings(*SEVERITIES), F.pmod(t["pri"], F.lit(8)))
                return let(F.struct(mine.alias("mine"), _quality(mine).alias("quality"), hunted.alias("hunted"), level.alias("pri_level")), done)

            return let(_primary(raw, t, hint, config, year), with_quality)

        return let(_texts(raw, hint, r["sep"]), judged)

    return let(F.struct(F.coalesce(raw, F.lit("")).alias("raw"), year.alias("year"), probe(F.coalesce(raw, F.lit(""))).alias("p"), delimiter(F.coalesce(raw, F.lit(""))).alias("sep")), lambda x: let(F.struct(x["raw"].alias("raw"), x["year"].alias("year"), x["p"]["hint"].alias("hint"), x["p"]["confidence"].alias("confidence"), x["sep"].alias("sep")), of))


_made: dict = {}


def parse(records: DataFrame, config: Config) -> DataFrame:
    """Adds parser, quality, warnings and a struct for each field to records (file, line_no, raw, n_lines, and ref_year if any)."""
    dated = "ref_year" in records.columns
    # Thousands of nodes: built once for a session and configuration.
    key = (id(records.sparkSession.sparkContext), config, dated)
    if key not in _made:
        _made[key] = F.inline(F.array(record(F.col("raw"), config, F.col("ref_year") if dated else None)))
    kept = [F.col("file"), F.col("line_no").cast("long").alias("line_no"), F.col("raw"), F.col("n_lines").cast("int").alias("n_lines")]
    return records.select(*kept, *([F.col("ref_year")] if dated else []), _made[key])
