"""Judgment sets: symbolic outcomes of comparing the two records of a pair.

Pairs carry the fields of their records with suffix 1 and 2 (``pairs.attach``). A missing value, blank or
null, gives no judgment anywhere. Labels such as ``person`` are never compared (``hide_labels``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.similarity import sequence_ratio
from kindred.functions.text import clean, digits_only, jaccard, normal_tokens, normalize_text, numeric_gap, overlap, parse_number, parse_seconds, parse_year, similarity_band

# Names of fields and judgments, bands and limits.
NAMES = ("nafn_norm", "first_name", "patronym", "surname")
PLACES = ("farm", "parish", "district", "county")
LABELS = ("person", "bi_einstaklingur")
PRICE = {"close_abs": 1.0, "close_rel": 0.05, "far_rel": 0.2}
#: Per two-table dataset: (kind, judgment, column, limits).
DATASETS = {
    "abt_buy": [("text", "name", "name", {}), ("text", "description", "description", {}), ("number", "price", "price", PRICE)],
    "amazon_google": [("text", "title", "title", {}), ("text", "manufacturer", "manufacturer", {}), ("number", "price", "price", PRICE)],
    "dblp_acm": [("text", "title", "title", {}), ("text", "authors", "authors", {}), ("text", "venue", "venue", {}), ("year", "year", "year", {"close": 1})],
    "dblp_scholar": [("text", "title", "title", {}), ("text", "authors", "authors", {}), ("text", "venue", "venue", {}), ("year", "year", "year", {"close": 1})],
    "itunes_amazon": [
        ("text", "song", "Song_Name", {}),
        ("text", "artist", "Artist_Name", {}),
        ("text", "album", "Album_Name", {}),
        ("text", "genre", "Genre", {}),
        ("number", "price", "Price", {"close_abs": 0.5, "close_rel": 0.05, "far_rel": 0.2}),
        ("time", "time", "Time", {"close": 5}),
        ("year", "released", "Released", {"close": 1}),
        ("year", "copyright", "CopyRight", {"close": 1}),
    ],
    "walmart_amazon": [("text", "title", "title", {}), ("text", "category", "category", {}), ("text", "brand", "brand", {}), ("text", "modelno", "modelno", {}), ("number", "price", "price", PRICE)],
    "beer": [
        ("text", "beer_name", "Beer_Name", {}),
        ("text", "brew_factory", "Brew_Factory_Name", {}),
        ("text", "style", "Style", {}),
        ("number", "abv", "ABV", {"close_abs": 0.3, "close_rel": 0.05, "far_rel": 0.2}),
    ],
    "fodors_zagats": [
        ("text", "name", "name", {}),
        ("text", "addr", "addr", {}),
        ("text", "city", "city", {}),
        ("text", "type", "type", {}),
        ("text", "class", "class", {}),
        ("phone", "phone", "phone", {}),
        ("address", "addr_num", "addr", {}),
    ],
}


def _both(field: str) -> tuple[Column, Column]:
    return F.col(f"{field}1"), F.col(f"{field}2")


def _lower(field: str) -> tuple[Column, Column]:
    a, b = _both(field)
    return clean(F.lower(a.cast("string"))), clean(F.lower(b.cast("string")))


def as_set(parts: list[Column]) -> Column:
    """The judgments that hold, as an array without repeats."""
    return F.array_distinct(F.array_compact(F.array(*parts)))


def gap_judgment(gap: Column, steps: list[tuple[float, str]], beyond: str) -> Column:
    """The first name whose limit the gap keeps to, else ``beyond``; null for no gap."""
    out = F.when(gap.isNull(), None)
    for most, name in steps:
        out = out.when(gap <= most, name)
    return out.otherwise(beyond)


def text_judgments(name: str, a: Column, b: Column) -> list[Column]:
    """<name>_exact, and the band of the better of token Jaccard and sequence ratio of the normalised texts."""
    x, y = clean(normalize_text(a)), clean(normalize_text(b))
    known = x.isNotNull() & y.isNotNull()
    alike = F.greatest(jaccard(normal_tokens(a), normal_tokens(b)), sequence_ratio(x, y))
    return [F.when(x == y, f"{name}_exact"), F.when(known, F.concat(F.lit(f"{name}_sim_"), similarity_band(alike)))]


def number_judgments(name: str, a: Column, b: Column, close_abs: float | None = None, close_rel: float | None = None, far_rel: float | None = None, exact: float = 0.01) -> list[Column]:
    """<name>_exact, and <name>_close or <name>_far by the absolute and the relative difference."""
    return parsed_number_judgments(name, parse_number(a.cast("string")), parse_number(b.cast("string")), close_abs, close_rel, far_rel, exact)


def parsed_number_judgments(name: str, a: Column, b: Column, close_abs: float | None = None, close_rel: float | None = None, far_rel: float | None = None, exact: float = 0.01) -> list[Column]:
    """``number_judgments`` of numbers."""
    gap, rel = numeric_gap(a, b)
    none = F.lit(False)
    close = (gap <= close_abs if close_abs is not None else none) | (rel <= close_rel if close_rel is not None else none)
    far = rel >= far_rel if far_rel is not None else none
    return [F.when(gap <= exact, f"{name}_exact"), F.when(close, f"{name}_close").when(far, f"{name}_far")]


def year_judgments(name: str, a: Column, b: Column, close: int = 1) -> list[Column]:
    return [gap_judgment(F.abs(parse_year(a.cast("string")) - parse_year(b.cast("string"))), [(0, f"{name}_same"), (close, f"{name}_close")], f"{name}_far")]


def time_judgments(name: str, a: Column, b: Column, close: int = 5) -> list[Column]:
    return [gap_judgment(F.abs(parse_seconds(a) - parse_seconds(b)), [(0, f"{name}_same"), (close, f"{name}_close")], f"{name}_far")]


def phone_judgments(name: str, a: Column, b: Column) -> list[Column]:
    x, y = digits_only(a), digits_only(b)
    known = (F.length(x) >= 7) & (F.length(y) >= 7)
    return [F.when(~known, None).when(x == y, f"{name}_exact").when(F.right(x, F.lit(7)) == F.right(y, F.lit(7)), f"{name}_last7").when(known, f"{name}_mismatch")]


def address_judgments(name: str, a: Column, b: Column) -> list[Column]:
    x, y = parse_number(a).try_cast("long"), parse_number(b).try_cast("long")
    return [F.when(x == y, f"{name}_match").when(x != y, f"{name}_diff")]


_KINDS = {"text": text_judgments, "number": number_judgments, "year": year_judgments, "time": time_judgments, "phone": phone_judgments, "address": address_judgments}


def dataset_judgments(dataset: str, exclude: tuple[str, ...] = ()) -> Column:
    """The judgment set of a known two-table dataset; others are compared by ``overlap_judgments``."""
    parts: list[Column] = []
    for kind, name, column, limits in DATASETS[dataset.lower().replace("-", "_")]:
        if not any(x in name for x in exclude):
            parts += _KINDS[kind](name, *_both(column), **limits)
    return as_set(parts)


def sorted_text(parts: list[Column]) -> Column:
    """Judgments as one text, in order and without repeats, as of ``as_set``."""
    return F.array_join(F.sort_array(as_set(parts)), ",")


def census_texts() -> dict:
    """{field: its judgment of two values}: ``census_judgments`` field by field, for values compared once."""
    def number(x, y):
        a, b = (F.when(c.try_cast("double") > 0, c.try_cast("double").cast("long")) for c in (x, y))
        return F.abs(a - b)

    def same(f):
        low = lambda c: clean(F.lower(c.cast("string")))
        return lambda x, y: F.when(low(x) == low(y), f"same_{f}").when(low(x) != low(y), f"different_{f}")

    out = {
        "heimild": lambda x, y: gap_judgment(number(x, y), [(0, "same_census"), (10, "adjacent_census")], "distant_census"),
        "birthyear": lambda x, y: gap_judgment(number(x, y), [(0, "same_birthyear"), (2, "birthyear_very_close"), (5, "birthyear_close")], "different_birthyear"),
    }
    return out | {f: same(f) for f in (*NAMES, "sex", *PLACES)}


def census_judgments(exclude: tuple[str, ...] = ()) -> Column:
    """Census records: distance of the waves, names, birth years, sex and places."""
    keep = lambda name: not any(x in name for x in exclude)
    number = lambda field: tuple(F.when(c.try_cast("double") > 0, c.try_cast("double").cast("long")) for c in _both(field))
    same = lambda f: F.when(_lower(f)[0] == _lower(f)[1], f"same_{f}").when(_lower(f)[0] != _lower(f)[1], f"different_{f}")
    parts = []
    if keep("heimild"):
        a, b = number("heimild")
        parts.append(gap_judgment(F.abs(a - b), [(0, "same_census"), (10, "adjacent_census")], "distant_census"))
    if keep("birthyear"):
        a, b = number("birthyear")
        parts.append(gap_judgment(F.abs(a - b), [(0, "same_birthyear"), (2, "birthyear_very_close"), (5, "birthyear_close")], "different_birthyear"))
    return as_set(parts + [same(f) for f in (*NAMES, "sex", *PLACES) if keep(f)])


def pattern_judgments(short: bool = False, age: int = 76) -> Column:
    """The judgments of the pattern models, in their long or short names: exact distance of the waves, birth
    years within ``age``, and the statuses of both records."""
    word = (lambda long, brief: brief if short else long)
    same = lambda f, name, lower=True: F.when(_sides(f, lower)[0] == _sides(f, lower)[1], f"same_{name}").when(_sides(f, lower)[0] != _sides(f, lower)[1], word(f"different_{name}", f"diff_{name}"))
    h1, h2 = (c.try_cast("long") for c in _both("heimild"))
    gap = F.abs(h1 - h2).cast("string")
    years = F.concat(F.lit("diff_years_"), gap) if short else F.concat(F.lit("differ_in_"), gap, F.lit("_years"))
    b1, b2 = (F.when(c.try_cast("long") > 0, c.try_cast("long")) for c in _both("birthyear"))
    birth = gap_judgment(F.abs(b1 - b2), [(0, "same_birthyear"), (age, word("birthyear_compatible_within_threshold", "birthyear_compat"))], word("different_birthyear", "diff_birthyear"))
    status = [F.concat(F.lit(word("status_is_", "status_")), clean(c.cast("string"))) for c in _both("status")]
    marriage = same("marriagestatus", word("marriagestatus", "marriage"))
    return as_set([years, *(same(f, f) for f in NAMES), birth, same("sex", "sex"), *status, marriage, *(same(f, f, False) for f in PLACES)])


def _sides(field: str, lower: bool) -> tuple[Column, Column]:
    return _lower(field) if lower else tuple(clean(c.cast("string")) for c in _both(field))


def overlap_judgments(a: Column, b: Column, shared: int = 5) -> Column:
    """The band of shared tokens over the larger set, and shared_<token> for those of four letters or more
    among the first ``shared`` in order, cut to twelve letters. ``a`` and ``b`` are arrays of distinct tokens."""
    share, either = overlap(a, b), F.greatest(F.size(a), F.size(b)) > 0
    band = F.when(~either, None).when(share > 0.7, "very_high_overlap").when(share > 0.5, "high_overlap").when(share > 0.3, "medium_overlap").when(share > 0.1, "low_overlap").otherwise("very_low_overlap")
    some = F.filter(F.slice(F.sort_array(F.array_intersect(a, b)), 1, shared), lambda t: F.length(t) >= 4)
    return F.array_compact(F.concat(F.array(band), F.transform(some, lambda t: F.concat(F.lit("shared_"), F.substring(t, 1, 12)))))


def field_judgments(fields: list[str]) -> Column:
    """missing, exact, or the band of shared tokens (high from 0.8, mid from 0.5, low, no) of each field."""
    return F.array(*(field_judgment(f, *_both(f)) for f in fields))


def field_judgment(f: str, a: Column, b: Column) -> Column:
    """The judgment of ``field_judgments`` on one field's two values."""
    x, y = (clean(F.lower(c.cast("string"))) for c in (a, b))
    s, t = (F.array_distinct(F.split(c, r"\s+")) for c in (x, y))
    share = overlap(s, t)
    band = F.when(share >= 0.8, f"high_overlap_{f}").when(share >= 0.5, f"mid_overlap_{f}").when(share > 0, f"low_overlap_{f}").otherwise(f"no_overlap_{f}")
    return F.when(x.isNull() | y.isNull(), f"missing_{f}").when(x == y, f"exact_{f}").otherwise(band)


def hide_labels(records: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """Records without the columns that give the answer away."""
    return records.drop(*labels)
