"""Scalar column helpers.

Every helper returns a ``Column`` built from JVM-side functions so it stays
inside whole-stage code generation. Where the warehouse semantics of the
original SQL differ from Spark's defaults the helper spells the intended
behaviour out (see the notes next to each one).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "TOKYO", "ntz", "col_of", "trim_ws", "normalise_name", "num_to_string", "concat_label",
    "round_n", "rpe_in_range", "safe_divide", "null_strict_greatest", "week_start",
    "week_end", "month_start", "month_end", "days_between", "today_in_zone",
    "zone_truncated_timestamp", "rank_change_label", "rank_diff", "reminder_flags",
    "recency_flag", "reps_rule", "document_key", "slug", "valid_identifier",
    "percent_difference", "format_volume", "format_period", "icon_lookup",
    "iso_timestamp", "row_uuid", "as_of_date", "RANK_ICONS", "CHANGE_ICONS",
    "BODY_PARTS",
]

TOKYO = "Asia/Tokyo"

# ---------------------------------------------------------------------------
# Fixed values (must equal the original application's for identical output)
# ---------------------------------------------------------------------------
# Body-part dimension: id, display name, training day, sort order.
BODY_PARTS = [
    ("chest", "胸", "Monday", 1),
    ("back", "背中", "Tuesday", 2),
    ("shoulder", "肩", "Wednesday", 3),
    ("leg", "脚", "Thursday", 4),
    ("arm", "腕", "Friday", 5),
    ("other", "その他", None, 6),
]
# Ranking message icons: rank -> medal, rank change -> arrow.
RANK_ICONS = {1: "🥇", 2: "🥈", 3: "🥉"}
CHANGE_ICONS = {"UP": "↑", "DOWN": "↓", "SAME": "→", "NEW": "NEW"}
# ---------------------------------------------------------------------------


def ntz(value: _dt.datetime) -> Column:
    """A TIMESTAMP_NTZ literal of a naive datetime, from its ISO text: a plain
    literal would pass through the driver's local time zone."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Characters with the Unicode White_Space property (Unicode standard, PropList).
UNICODE_WHITE_SPACE = "".join(chr(c) for c in (
    list(range(0x09, 0x0E)) + [0x20, 0x85, 0xA0, 0x1680] + list(range(0x2000, 0x200B))
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def trim_ws(c) -> Column:
    """TRIM that strips every Unicode white-space character at both ends
    (Spark's one-argument ``trim`` only strips U+0020, so U+3000 padding would
    survive). A character-set trim, much cheaper than a regular expression."""
    return F.trim(col_of(c), F.lit(UNICODE_WHITE_SPACE))


def normalise_name(c) -> Column:
    """LOWER(TRIM(x)) with Unicode-aware trimming."""
    return F.lower(trim_ws(c))


def num_to_string(c) -> Column:
    """Render a 1-digit-rounded double like the warehouse does: ``80`` for
    80.0, ``87.5`` for 87.5, never exponent notation."""
    v = col_of(c)
    return (F.when(v == F.floor(v), v.cast("decimal(38,0)").cast("string"))
            .otherwise(v.cast("decimal(38,1)").cast("string")))


def concat_label(name, value, unit: str = "kg") -> Column:
    """``name: <value>kg``; NULL if any piece is NULL (CONCAT semantics)."""
    return F.concat(col_of(name), F.lit(": "), num_to_string(value), F.lit(unit))


def round_n(c, n: int = 1) -> Column:
    return F.round(col_of(c), n)


def rpe_in_range(c, lo: float = 6.0, hi: float = 10.0) -> Column:
    """Rounded RPE when it lies in [lo, hi], else NULL (NULL stays NULL)."""
    v = col_of(c)
    return F.when(v.between(lo, hi), F.round(v, 1))


def safe_divide(a, b) -> Column:
    """SAFE_DIVIDE: NULL instead of an error (ANSI) or infinity on zero."""
    return F.try_divide(col_of(a), col_of(b))


def null_strict_greatest(a, b) -> Column:
    """GREATEST that returns NULL as soon as one input is NULL (Spark's and
    most engines' ``greatest`` skip NULLs)."""
    a, b = col_of(a), col_of(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def week_start(d) -> Column:
    """Monday of the week, as DATE."""
    return F.trunc(col_of(d), "week")


def week_end(d) -> Column:
    return F.date_add(week_start(d), 6)


def month_start(d) -> Column:
    return F.trunc(col_of(d), "month")


def month_end(d) -> Column:
    return F.last_day(col_of(d))


def days_between(later, earlier) -> Column:
    """DATE_DIFF(later, earlier, DAY) as BIGINT."""
    return F.datediff(col_of(later), col_of(earlier)).cast("bigint")


def today_in_zone(zone: str = TOKYO) -> Column:
    return F.to_date(F.from_utc_timestamp(F.current_timestamp(), zone))


def as_of_date(as_of) -> Column:
    """Literal DATE for an ``as_of`` argument (date, ISO string or None=today in Tokyo)."""
    if as_of is None:
        return today_in_zone()
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, str):
        as_of = _dt.date.fromisoformat(as_of)
    return F.lit(as_of)


def zone_truncated_timestamp(ts, unit: str, zone: str = TOKYO) -> Column:
    """Start of the ``unit`` (day / month) containing ``ts`` on the wall clock
    of ``zone``, returned as a UTC instant."""
    local = F.from_utc_timestamp(col_of(ts), zone)
    return F.to_utc_timestamp(F.date_trunc(unit, local), zone)


def rank_change_label(rank, prev_rank) -> Column:
    r, p = col_of(rank), col_of(prev_rank)
    return (F.when(p.isNull(), "NEW").when(r < p, "UP").when(r > p, "DOWN").otherwise("SAME"))


def rank_diff(rank, prev_rank) -> Column:
    """prev_rank - rank; NULL without a previous rank."""
    return (col_of(prev_rank) - col_of(rank)).cast("bigint")


def reminder_flags(days_any, days_part, part, any_days: int = 3, part_days: int = 7,
                   excluded_part: str = "other"):
    """(needs_3day, needs_7day). The per-part flag is always FALSE for the
    excluded part; a NULL part falls through to the comparison."""
    three = col_of(days_any) >= any_days
    seven = F.when(col_of(part) == excluded_part, F.lit(False)).otherwise(col_of(days_part) >= part_days)
    return three, seven


def recency_flag(as_of, d, days: int = 7) -> Column:
    """age <= days (future dates count as recent)."""
    return F.datediff(as_of_date(as_of), col_of(d)) <= days


def reps_rule(rpe, reps) -> Column:
    """Next reps: RPE >= 9.5 keep, RPE <= 7.0 add two, otherwise keep."""
    rpe, reps = col_of(rpe), col_of(reps)
    return (F.when(rpe >= 9.5, reps).when(rpe <= 7.0, reps + 2).otherwise(reps)).cast("bigint")


def document_key(user_id, training_date, exercise_id) -> Column:
    return F.concat_ws("_", col_of(user_id), col_of(training_date).cast("string"), col_of(exercise_id))


def slug(name) -> Column:
    """Exercise id proposal: lower-case, spaces to underscores."""
    return F.regexp_replace(F.lower(col_of(name)), " ", "_")


def valid_identifier(c, min_len: int = 3, max_len: int = 30) -> Column:
    v = col_of(c)
    return v.rlike(r"^[A-Za-z0-9_]+$") & F.length(v).between(min_len, max_len)


def percent_difference(now, previous):
    """(diff, pct): pct = diff / previous * 100, or 0 when previous <= 0."""
    now, previous = col_of(now), col_of(previous)
    diff = now - previous
    pct = F.when(previous > 0, diff / previous * 100).otherwise(F.lit(0.0))
    return diff, pct


def format_volume(c, digits: int = 0, signed: bool = False) -> Column:
    """Thousands separator, optional sign: ``1,234`` / ``+1,234``."""
    spec = "%" + ("+" if signed else "") + f",.{digits}f"
    # round half to even first, as Python's float formatting does
    return F.format_string(spec, F.bround(col_of(c).cast("double"), digits))


def format_period(d, pattern: str = "yyyy年MM月") -> Column:
    return F.date_format(col_of(d), pattern)


def icon_lookup(key, mapping: dict, default=None) -> Column:
    """Map a key through a fixed dict with a default (Column or literal)."""
    if not mapping:
        return col_of(default) if isinstance(default, Column) else F.lit(default)
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    # try_element_at: NULL for a missing key even under ANSI mode
    looked = F.try_element_at(F.create_map(*pairs), col_of(key))
    if default is None:
        return looked
    return F.coalesce(looked, default if isinstance(default, Column) else F.lit(default))


def iso_timestamp(c) -> Column:
    """ISO-8601 document time string -> TIMESTAMP; NULL if it is not one. An
    offset in the text counts, text without one is session (UTC) time."""
    return F.try_to_timestamp(col_of(c))


def row_uuid() -> Column:
    return F.expr("uuid()")
