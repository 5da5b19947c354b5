"""Name clean-up and small parsers, all as Column expressions."""

from pyspark.sql import Column, functions as F


def header_key(name: str) -> str:
    """Header text reduced to letters and digits, for comparing column names."""
    return "".join(ch for ch in str(name).lower() if ch.isalnum())


def header_key_col(col: Column) -> Column:
    return F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}]", "")


def words(col: Column) -> Column:
    """Lower-case alphanumeric tokens; null → empty array."""
    cleaned = F.trim(F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), "[^a-z0-9]+", " "))
    return F.filter(F.split(cleaned, " "), lambda w: w != "")


def _without(tokens: Column, stop) -> Column:
    stop = list(stop)
    return F.filter(tokens, lambda w: ~w.isin(stop)) if stop else tokens


def name_tokens(col: Column, stopwords, roman: dict) -> Column:
    """Tokens without stopwords, Roman numerals read as digits."""
    def numeral(w):
        out = w
        for r, d in roman.items():
            out = F.when(w == r, F.lit(d)).otherwise(out)
        return out
    return F.transform(_without(words(col), stopwords), numeral)


def norm_name(col: Column, c: dict) -> Column:
    return F.array_join(name_tokens(col, c["stopwords"], c["roman"]), " ")


def phase_digits(col: Column, c: dict) -> Column:
    """The all-digit tokens of a normalised name, distinct."""
    return F.array_distinct(F.filter(name_tokens(col, c["stopwords"], c["roman"]), lambda w: w.rlike("^[0-9]+$")))


def norm_county(col: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(F.coalesce(col, F.lit("")))), r"\s+county$", ""))


def norm_owner(col: Column, stopwords) -> Column:
    """Owner name with L.L.C. folded to llc, punctuation and company words dropped; missing → ''."""
    folded = F.regexp_replace(F.coalesce(col, F.lit("")), r"(?i)\bL\.?L\.?C\.?(?=$|[^A-Za-z0-9_])", "llc")
    return F.array_join(_without(words(folded), stopwords), " ")


def interstate_ref(col: Column, pattern: str) -> Column:
    """First interstate of a ref list as I-nn; anything else null. The pattern's second group is the number."""
    num = F.regexp_extract(col, pattern, 2)
    return F.when(num != "", F.concat(F.lit("I-"), num))


def _numbers(part: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(part, " ", ""), r"\d+(?:\.\d+)?", 0).try_cast("double")


def parse_kv(col: Column) -> Column:
    """Highest voltage of a tag in kV: parts split on ; , /, values of 1000 and more are volts."""
    volts = F.filter(F.transform(F.split(col, "[;,/]"), _numbers), lambda v: (v > 0) & (v <= 1_500_000))
    return F.array_max(F.transform(volts, lambda v: F.when(v >= 1000, v / 1000.0).otherwise(v)))


def class_kv(voltage: Column, volt_class: Column) -> Column:
    """Utility line file voltage: the number when positive, else the top of the class text, class tops mapped."""
    v = voltage.cast("string").try_cast("double")
    top = F.array_max(F.transform(F.regexp_extract_all(F.coalesce(volt_class, F.lit("")), F.lit(r"(\d+(?:\.\d+)?)"), 1),
                                  lambda x: x.try_cast("double")))
    mapped = F.when(top == 287, 230.0).when(top == 161, 138.0).otherwise(top)
    return F.when(v > 0, v).otherwise(mapped)


def year_of(col: Column) -> Column:
    y = F.regexp_extract(col.cast("string"), r"(19|20)\d\d", 0)
    return F.when(y != "", y.cast("int"))


def month_from_name(col: Column) -> Column:
    """'august_generator2026.xlsx' → '2026-08'; a name without a leading month or four digits → 'unknown'."""
    stem = F.lower(col)
    digits = F.substring(F.regexp_replace(stem, "[^0-9]", ""), 1, 4)
    out = F.lit("unknown")
    months = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
              "november", "december"]
    for i, m in enumerate(months, 1):
        out = F.when(stem.startswith(m) & (F.length(digits) == 4), F.concat(digits, F.lit(f"-{i:02d}"))).otherwise(out)
    return out


def release_from_name(col: Column) -> Column:
    """'..._J25_30jun2026.csv' → 'J25 30jun2026', else null."""
    pat = r"_([A-Z]\d{2})_(\d{1,2}[a-z]{3}\d{4})"
    code = F.regexp_extract(col, pat, 1)
    return F.when(code != "", F.concat_ws(" ", code, F.regexp_extract(col, pat, 2)))


def month_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def label_map(col: Column, labels: dict, default: Column | None = None) -> Column:
    """Code → text; unknown codes take the default (null when none)."""
    out = default if default is not None else F.lit(None).cast("string")
    for k, v in labels.items():
        out = F.when(col == k, F.lit(v)).otherwise(out)
    return out


def percent_text(col: Column) -> Column:
    """0.583 → '58%', half to even as in printf-style formatting."""
    return F.concat(F.bround(col * 100.0, 0).cast("long").cast("string"), F.lit("%"))


DASH = "—"


def number_text(col: Column, digits: int = 1) -> Column:
    """Thousands separators and a fixed number of decimals; null → em dash, never 0."""
    return F.coalesce(F.format_number(col, digits), F.lit(DASH))
