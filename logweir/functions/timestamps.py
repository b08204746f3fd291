"""Timestamp families as column expressions: shapes of times in a text, the surest first.

A family's first match in a text is taken apart into its runs of digits, and these make a time in the family's order.
Families are tried by how far they and their time zone are trusted; the first that gives a time in the years 2000 to
2050 is it, and only where none does is a time outside them a guess.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweir.config import Config
from logweir.functions.fields import absent, known, let, unknown

# How far each source of a zone is trusted.
SCALES = {"explicit_offset": 1.0, "configured_local": 0.85, "configured_utc": 0.80, "syslog_assumption": 0.75}
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_CLOCK = "[0-9]{2}:[0-9]{2}:[0-9]{2}"
_DATE = "[0-9]{4}-[0-9]{2}-[0-9]{2}"
_OFFSET = "(?:Z|[+-][0-9]{2}:?[0-9]{2})"
_NAME = "[A-Za-z]{3}"
# Base confidences. (base, kind, shape, source; None: as the configuration says).
FAMILIES = [
    (0.95, "iso", f"{_DATE}T{_CLOCK}(?:[.][0-9]+)?{_OFFSET}", "explicit_offset"),
    (0.95, "iso", f"{_DATE}T{_CLOCK}(?:[.][0-9]+)?(?!{_OFFSET})", None),
    (0.92, "named", f"\\[{_NAME}\\s+{_NAME}\\s+[0-9]{{1,2}}\\s+{_CLOCK}\\s+[0-9]{{4}}\\]", None),
    (0.90, "access", f"[0-9]{{2}}/{_NAME}/[0-9]{{4}}:{_CLOCK}\\s+[+-][0-9]{{4}}", "explicit_offset"),
    (0.88, "iso", f"\\[{_DATE}\\s+{_CLOCK}(?:[,.][0-9]{{1,6}})?\\]", None),
    (0.85, "iso", f"{_DATE}\\s+{_CLOCK}(?:[.][0-9]+)?", None),
    (0.84, "packed", f"\\b[0-9]{{8}}-{_CLOCK}:[0-9]{{3}}\\b", None),
    (0.82, "sixes", "\\b[0-9]{6}\\s+[0-9]{6}\\b", None),
    (0.80, "epoch", "\\b[0-9]{13}\\b", "explicit_offset"),
    (0.78, "iso", f"\\b[0-9]{{2}}/[0-9]{{2}}/[0-9]{{2}}\\s+{_CLOCK}\\b", None),
    (0.78, "epoch", "\\b[0-9]{10}[.][0-9]{1,6}\\b", "explicit_offset"),
    (0.75, "bsd", f"\\b{_NAME}\\s+[0-9]{{1,2}}\\s+{_CLOCK}\\b", "syslog_assumption"),
    (0.75, "epoch", "\\b[0-9]{10}\\b", "explicit_offset"),
    (0.72, "wall", f"\\[[0-9]{{1,2}}[.][0-9]{{1,2}}\\s+{_CLOCK}\\]", None),
    # Loosely written dates, only where nothing else is found: year and month by - or /, or a month's name between slashes.
    (0.68, "loose", "\\b[0-9]{4}[-/][0-9]{2}(?:[-/][0-9]{1,2})?(?:[ T]+[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)?(?![0-9])", None),
    (0.68, "loose_named", f"\\b[0-9]{{2}}/{_NAME}/[0-9]{{4}}(?:[: ][0-9]{{2}}:[0-9]{{2}}(?::[0-9]{{2}})?)?(?![0-9])", None),
]


def sane(t: Column) -> Column:
    """Whether a time lies in the years 2000 to 2050 (UTC)."""
    return F.unix_seconds(t).between(946_684_800, 2_556_143_999)


def _made(m: Column, config: Config, given: Column) -> Column:
    """The time (UTC) that a match stands for, null where there is none. m: struct(kind, text, ...)."""
    kind, text = m["kind"], m["text"]
    zone, now = F.lit(config.zone), datetime.fromisoformat(config.run_ts).replace(tzinfo=timezone.utc)
    name = F.lower(F.regexp_extract(text, f"({_NAME})[\\s/]+[0-9]", 1))
    month = F.format_string("%02d", F.array_position(F.array(*map(F.lit, _MONTHS)), name))

    def parts(r: Column) -> Column:
        """Year, month, day, hour, minute, second and fraction as texts, and the offset in minutes."""
        of = lambda *places: F.array(*[p if isinstance(p, Column) else F.coalesce(F.get(r, F.lit(p)), F.lit("")) if p is not None else F.lit("") for p in places])
        cut = lambda run, *widths: [F.substring(F.get(r, F.lit(run)), 1 + sum(widths[:k]), w) for k, w in enumerate(widths)]
        or_ = lambda place, default: F.coalesce(F.get(r, F.lit(place)), F.lit(default))
        year = F.coalesce(given, F.lit(now.year)).cast("string")
        return (
            F.when(kind == "named", of(4, month, 0, 1, 2, 3, None))
            .when(kind == "access", of(1, month, 0, 2, 3, 4, None))
            .when(kind == "packed", of(*cut(0, 4, 2, 2), 1, 2, 3, 4))
            .when(kind == "sixes", of(*cut(0, 2, 2, 2), *cut(1, 2, 2, 2), None))
            .when(kind == "bsd", of(year, month, 0, 1, 2, 3, None))
            .when(kind == "wall", of(year, 0, 1, 2, 3, 4, None))
            .when(kind == "loose", of(0, 1, or_(2, "1"), or_(3, "0"), or_(4, "0"), or_(5, "0"), None))
            .when(kind == "loose_named", of(1, month, 0, or_(2, "0"), or_(3, "0"), or_(4, "0"), None))
            # Of a time with an offset and no fraction, the seventh run is the offset.
            .otherwise(of(0, 1, 2, 3, 4, 5, F.when(text.rlike("[.,]"), F.coalesce(F.get(r, F.lit(6)), F.lit(""))).otherwise("")))
        )

    def built(p: Column) -> Column:
        n = lambda i: F.get(p, F.lit(i)).try_cast("int")
        y = F.when(F.length(F.get(p, F.lit(0))) == 2, n(0) + F.when(n(0) >= 70, 1900).otherwise(2000)).otherwise(n(0))
        second = F.concat(F.get(p, F.lit(5)), F.lit("."), F.rpad(F.substring(F.get(p, F.lit(6)), 1, 6), 6, "0")).try_cast("decimal(16,6)")
        make = lambda y: F.try_make_timestamp(y, n(1), n(2), n(3), n(4), second, F.when(m["offset"], F.lit("UTC")).otherwise(zone))
        # Without a year to go by: this year's, or last year's where that lies more than 30 days ahead.
        ahead = kind.isin("bsd", "wall") & given.isNull() & (F.unix_seconds(make(y)) > int(now.timestamp()) + 30 * 86_400)
        return F.when(ahead, make(y - 1)).otherwise(make(y))

    def shifted(t: Column) -> Column:
        digits = F.regexp_replace(F.regexp_extract(text, "([+-][0-9]{2}:?[0-9]{2})$", 1), ":", "")
        east = F.when(text.endswith("Z"), 0).otherwise((F.substring(digits, 2, 2).try_cast("int") * 60 + F.substring(digits, 4, 2).try_cast("int")) * F.when(digits.startswith("-"), -1).otherwise(1))
        return F.when(m["offset"], F.timestamp_micros(F.unix_micros(t) - east.cast("long") * 60_000_000)).otherwise(t)

    runs = F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0))
    epoch = F.rpad(F.replace(text, F.lit("."), F.lit("")), 16, "0").try_cast("long")
    return F.when(kind == "epoch", F.timestamp_micros(epoch)).otherwise(let(let(let(runs, parts), built), shifted))


def hunt(text: Column, config: Config, year: Column | None = None) -> Column:
    """The surest time of a text as struct(ts, base, source), null where there is none. year: of times without one, where
    the configuration names none; else it goes by `run_ts`."""
    year = F.lit(config.reference_year).cast("int") if config.reference_year or year is None else year
    naive = "configured_utc" if config.naive_policy == "utc" else "configured_local"
    tried = []
    for base, kind, shape, source in FAMILIES:
        source = source or naive
        m = F.struct(F.lit(kind).alias("kind"), F.lit(base).alias("base"), F.lit(source).alias("source"), F.lit(source == "explicit_offset").alias("offset"), F.regexp_extract(text, shape, 0).alias("text"))
        tried.append((kind.startswith("loose"), -base * SCALES[source], len(tried), m))
    found = F.filter(F.array(*[x[-1] for x in sorted(tried, key=lambda x: x[:3])]), lambda m: m["text"] != "")
    # No loose dates in lines that begin with a priority.
    found = F.when(text.rlike("^<[0-9]"), F.filter(found, lambda m: ~m["kind"].startswith("loose"))).otherwise(found)
    made = F.transform(found, lambda m: F.struct(_made(m, config, year).alias("ts"), m["base"].alias("base"), m["source"].alias("source")))
    pick = lambda a: F.coalesce(F.get(F.filter(a, lambda x: sane(x["ts"])), F.lit(0)), F.get(F.filter(a, lambda x: x["ts"].isNotNull()), F.lit(0)))
    return F.when(text.rlike("[0-9][0-9]"), let(made, pick))


def as_field(found: Column) -> Column:
    """A hunted time as a field: confidence scaled by its source; years out of 2000 to 2050 are unknown."""

    def of(x: Column) -> Column:
        scale = F.try_element_at(F.create_map(*[F.lit(v) for pair in SCALES.items() for v in pair]), x["source"])
        confidence = F.round(x["base"] * scale, 6)
        return F.when(sane(x["ts"]), known(x["ts"], confidence, "timestamp", x["source"])).when(x["ts"].isNotNull(), unknown(x["ts"], F.least(confidence, F.lit(0.4)), "timestamp")).otherwise(absent("timestamp"))

    return let(found, of)


def timestamp(text: Column, config: Config, year: Column | None = None) -> Column:
    return as_field(hunt(text, config, year))

