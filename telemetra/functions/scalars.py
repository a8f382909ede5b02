"""Column expressions: cleaning, clamps, ladders, ids, time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8
# Ladders (low, medium, high, critical) of the evidence types and of risk.
LADDERS = {
    "anomaly": (2.5, 3.0, 4.0, 5.0),
    "residual": (1.0, 1.5, 2.5, 4.0),
    "trend": (0.8, 1.2, 2.0, 3.0),
    "failure": (0.02, 0.05, 0.1, 0.2),
    "history": (3.0, 5.0, 8.0, 12.0),
    "risk": (0.15, 0.35, 0.6, 0.8),
    "log": (0.25, 0.5, 0.75, 0.9),
}
# Log levels that count as anomalous.
ANOMALOUS_LEVELS = ("WARN", "WARNING", "ERROR", "FATAL", "SEVERE", "CRITICAL")


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def parse_double(x: Column) -> Column:
    """A finite number, else null."""
    v = F.trim(x).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def parse_flag(x: Column) -> Column:
    return F.when(F.trim(x).isin("0", "1"), F.trim(x).cast("int"))


def request_id(*fields: Column) -> Column:
    found = [F.nullif(F.regexp_extract(f, r"\breq-[0-9a-fA-F-]{8,}\b", 0), F.lit("")) for f in fields]
    return F.coalesce(*found)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def rounded_as_sql(x: Column, digits: int) -> Column:
    """x to so many digits as SQL engines round doubles: the scaled double to the nearest whole number, halves away from zero.
    F.round goes by the shortest decimal that names the double, and so takes 0.1234565 up even if the scaled double is under the half."""
    scale = F.lit(10.0**digits)
    return F.round(x * scale) / scale


def normalized(x: Column, critical: float) -> Column:
    return clamp(x / max(critical, EPS))


def severity(x: Column, ladder: tuple[float, float, float, float]) -> Column:
    low, medium, high, critical = ladder
    return F.when(x >= critical, "CRITICAL").when(x >= high, "HIGH").when(x >= medium, "MEDIUM").when(x >= low, "LOW").otherwise("INFO")


def log_score(n: Column, cap: float) -> Column:
    return clamp(F.log1p(n) / F.log1p(F.lit(float(cap))))


def safe_divide(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def stable_id(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16)


def micros(ts: Column) -> Column:
    """Microseconds since the epoch; time zones play no part for timestamp_ntz in a UTC session."""
    return F.unix_micros(ts.cast("timestamp"))


def bucket(ts: Column, seconds: int) -> Column:
    """Start of the bucket, counted from the epoch."""
    us = micros(ts)
    return F.timestamp_micros(us - F.pmod(us, F.lit(seconds * 1_000_000))).cast("timestamp_ntz")


def filled(x: Column, default: str) -> Column:
    """The text, or the default for null, empty, "nan" and "None"."""
    return F.when(x.isNull() | x.isin("", "nan", "None"), F.lit(default)).otherwise(x)


def split_ids(x: Column) -> Column:
    """The parts between bars that are not empty."""
    return F.filter(F.split(x, r"\|"), lambda p: p != "")


def log_entity(dataset: Column, component: Column) -> Column:
    return F.concat_ws(":", dataset, F.replace(F.coalesce(F.nullif(component, F.lit("")), F.lit("logs")), F.lit(" "), F.lit("_")))


def metric_name(x: Column) -> Column:
    """Lower case; " [" , spaces and slashes become underscores, "]" goes."""
    out = F.replace(F.replace(F.lower(x), F.lit(" ["), F.lit("_")), F.lit("]"), F.lit(""))
    return F.translate(out, " /", "__")


def normalized_text(x: Column) -> Column:
    """One kind of line end, single spaces, at most one blank line in a row, no white space at the ends."""
    out = F.regexp_replace(F.regexp_replace(x, r"\r\n?", "\n"), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def document_id(stem: Column, path: Column, title: Column) -> Column:
    """The file's stem as a slug, and eight digits of a digest of path and title."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(stem), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.concat_ws("_", slug, F.substring(F.sha1(F.concat_ws("|", path, title)), 1, 8))


def chunk_id(document: Column, section: Column, position: Column, text: Column) -> Column:
    digest = F.substring(F.sha1(F.concat_ws("|", document, section, position.cast("string"), text)), 1, 8)
    return F.concat(document, F.lit("_chunk_"), F.when(position < 10_000, F.lpad(position.cast("string"), 4, "0")).otherwise(position.cast("string")), F.lit("_"), digest)


def byte_size(n: Column) -> Column:
    """Bytes as B, KiB, MiB, GiB or TiB with a decimal."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(n >= 1024**k, F.format_string(f"%.1f {unit}", F.bround(n / float(1024**k), 1))).otherwise(out)
    return out


# Seconds of the units of a frequency.
_UNITS = {"s": 1, "sec": 1, "min": 60, "t": 60, "h": 3600, "d": 86400, "w": 604800}


def frequency_seconds(frequency: str) -> int:
    """Seconds of a frequency such as 5min or 1h."""
    digits = "".join(c for c in frequency if c.isdigit())
    unit = frequency[len(digits) :].strip().lower()
    if unit not in _UNITS or not frequency.startswith(digits) or digits == "0":
        raise ValueError(f"not a frequency: {frequency}")
    return int(digits or 1) * _UNITS[unit]


def horizon_steps(minutes: int, step_seconds: int) -> int:
    """Whole steps of a horizon; a horizon that is none is an error."""
    steps, rest = divmod(minutes * 60, step_seconds)
    if rest or steps < 1:
        raise ValueError("the horizon has to be a whole number of steps")
    return steps
