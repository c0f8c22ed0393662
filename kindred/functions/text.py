"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The letter codes of Soundex, and the patterns of numbers and years.
SOUNDEX_LETTERS = "BFPVCGJKQSXZDTLMNR"
SOUNDEX_CODES = "111122222222334556"
NUMBER = r"[-+]?\d*\.?\d+"
YEAR = r"(1[7-9]\d{2}|20\d{2})"


def clean(x: Column) -> Column:
    """Trimmed, blank as null: missing values give no evidence anywhere."""
    return F.nullif(F.trim(x), F.lit(""))


def normalize_text(x: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one space."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def tokens(x: Column, least: int = 2) -> Column:
    """Distinct white-space tokens of at least so many characters, lower-cased."""
    return F.array_distinct(F.filter(F.split(F.lower(x), r"\s+"), lambda t: F.length(t) >= least))


def normal_tokens(x: Column) -> Column:
    """Distinct tokens of the normalised text with two characters or a digit."""
    return F.array_distinct(F.filter(F.split(normalize_text(x), " "), lambda t: (F.length(t) >= 2) | t.rlike("[0-9]")))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Jaccard similarity of two arrays; ``empty`` where either has no elements."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def overlap(a: Column, b: Column) -> Column:
    """Shared elements over the larger array's size."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / most)


def parse_number(x: Column) -> Column:
    """The first decimal number of a text, thousands commas ignored; null if there is none."""
    return F.nullif(F.regexp_extract(F.replace(x, F.lit(","), F.lit("")), NUMBER, 0), F.lit("")).try_cast("double")


def parse_year(x: Column) -> Column:
    """The first year from 1700 to 2099."""
    return F.nullif(F.regexp_extract(x, YEAR, 1), F.lit("")).try_cast("int")


def parse_seconds(x: Column) -> Column:
    """Seconds of h:mm:ss, m:ss or a plain number; null where a part is no number or there are others."""
    parts = F.transform(F.split(F.trim(x), ":"), lambda p: F.trim(p).try_cast("double").try_cast("long"))
    at = lambda i: F.get(parts, F.lit(i))
    plain = parse_number(x).try_cast("long")
    return F.when(F.size(parts) == 1, plain).when(F.size(parts) == 2, at(0) * 60 + at(1)).when(F.size(parts) == 3, at(0) * 3600 + at(1) * 60 + at(2))


def digits_only(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def phone_last7(x: Column) -> Column:
    """The last seven digits; null for fewer."""
    d = digits_only(x)
    return F.when(F.length(d) >= 7, F.right(d, F.lit(7)))


def block_soundex(word: Column) -> Column:
    """Letter and three digits; the code before last is remembered across vowels, H and W.

    Only letters count; a word without any gives the empty string.
    """
    letters = F.regexp_replace(F.upper(word), r"[^\p{L}]", "")
    code = F.create_map(*[F.lit(v) for kv in zip(SOUNDEX_LETTERS, SOUNDEX_CODES, strict=True) for v in kv])
    zero = F.struct(F.lit("").alias("out"), F.coalesce(F.element_at(code, letters.substr(1, 1)), F.lit("0")).alias("last"))

    def step(acc: Column, ch: Column) -> Column:
        c = F.coalesce(F.element_at(code, ch), F.lit("0"))
        return F.when(c == "0", acc).otherwise(F.struct(F.when(c != acc["last"], F.concat(acc["out"], c)).otherwise(acc["out"]).alias("out"), c.alias("last")))

    rest = F.filter(F.split(letters.substr(F.lit(2), F.length(letters)), ""), lambda ch: ch != "")
    tail = F.aggregate(rest, zero, step, lambda acc: acc["out"])
    return F.when(letters == "", F.lit("")).otherwise(F.rpad(F.concat(letters.substr(1, 1), tail).substr(1, 4), 4, "0"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def fixed(x: Column, digits: int) -> Column:
    """A small number that isn't negative, rounded by plain arithmetic; ``round`` of a double goes through its decimal text."""
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson score interval of k successes in n; null for n = 0."""
    p, zz = k / F.nullif(n, F.lit(0)), z * z
    mid = (p + zz / (2 * n)) / (1 + zz / n)
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return mid - half, mid + half


def logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def numeric_gap(a: Column, b: Column) -> tuple[Column, Column]:
    """Absolute difference, and relative to the larger magnitude (1 at least)."""
    gap = F.abs(a - b)
    return gap, gap / F.greatest(F.abs(a), F.abs(b), F.lit(1.0))


def similarity_band(x: Column) -> Column:
    """high from 0.9, med from 0.75, low from 0.5, else vlow."""
    return F.when(x >= 0.9, "high").when(x >= 0.75, "med").when(x >= 0.5, "low").otherwise("vlow")


def edge_key(a: Column, b: Column) -> Column:
    """Smaller and larger id joined by an underscore."""
    return F.concat_ws("_", F.least(a, b).cast("string"), F.greatest(a, b).cast("string"))


#: Names of metrics in logs and what they are called here.
LOG_ALIASES = {
    "trainacc": "train_acc",
    "valacc": "val_acc",
    "accuracy": "acc",
    "trainaccuracy": "train_acc",
    "valaccuracy": "val_acc",
    "precision": "prec",
    "precision_labeled": "prec_labeled",
}
_PAIR = r"([a-zA-Z0-9_]+)\s*=\s*([-+]?\d*\.?\d+(?:[eE][-+]?\d+)?)(%)?"


def log_values(line: Column) -> Column:
    """Map of the key=value pairs of a log line: lower-cased names and their aliases, numbers, percents as shares; the last of a name counts."""
    part = lambda i: F.regexp_extract_all(line, F.lit(_PAIR), F.lit(i))
    found = F.arrays_zip(F.transform(part(1), F.lower).alias("k"), part(2).alias("v"), part(3).alias("p"))
    number = lambda x: F.when(x["p"] == "%", x["v"].try_cast("double") / 100).otherwise(x["v"].try_cast("double"))
    own = F.transform(found, lambda x: F.struct(x["k"].alias("k"), number(x).alias("v")))
    alias = F.create_map(*[F.lit(v) for kv in LOG_ALIASES.items() for v in kv])
    # An array of one binds the pairs, so that the line is read once, not once a pair.
    placed = lambda every: F.transform(every, lambda x, i: F.struct(x["k"].alias("k"), x["v"].alias("v"), i.alias("i")))
    last = lambda every: F.filter(placed(every), lambda x: ~F.exists(F.slice(every, x["i"] + 2, F.size(every)), lambda y: y["k"] == x["k"]))
    more = lambda own: F.transform(F.filter(own, lambda x: F.element_at(alias, x["k"]).isNotNull()), lambda x: F.struct(F.element_at(alias, x["k"]).alias("k"), x["v"].alias("v")))
    every = F.transform(F.array(own), lambda o: F.concat(o, more(o)))
    kept = F.transform(every, last)[0]
    return F.map_from_entries(F.transform(kept, lambda x: F.struct(x["k"], x["v"])))


def human_bytes(n: Column, largest: str = "PB") -> Column:
    """A number of bytes with one decimal, in steps of 1024 up to ``largest``."""
    units = ["B", "KB", "MB", "GB", "TB", "PB"]
    units = units[: units.index(largest) + 1]
    of = lambda k: F.format_string(f"%.1f {units[k]}", (n / 1024.0**k).cast("double"))
    out = of(len(units) - 1)
    for k in reversed(range(len(units) - 1)):
        out = F.when(n < 1024.0 ** (k + 1), of(k)).otherwise(out)
    return out


def percent(x: Column) -> Column:
    """One decimal and a percent sign; a dash for null."""
    return F.when(x.isNull(), "—").otherwise(F.format_string("%.1f%%", 100.0 * x))


def person_label(first: Column, patronym: Column, surname: Column, birthyear: Column, id_: Column) -> Column:
    """first (patronym or surname), then birth year and id on a second line."""
    last = F.trim(F.coalesce(F.nullif(patronym, F.lit("")), surname, F.lit("")))
    year = F.coalesce(birthyear.cast("int").cast("string"), F.lit(""))
    return F.concat(F.coalesce(first, F.lit("")), F.lit(" "), last, F.lit("\n("), year, F.lit(") [#"), id_.cast("string"), F.lit("]"))


def term(x: Column) -> Column:
    """Lower case, runs of anything but a-z, 0-9 and underscore as one underscore, 30 characters; "unknown" if empty."""
    clean_ = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9_]", "_"), "_+", "_"), "^_|_$", "")
    return F.coalesce(F.nullif(F.substring(clean_, 1, 30), F.lit("")), F.lit("unknown"))
