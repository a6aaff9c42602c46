"""Cell-level functions (F1–F19) as native Column expressions.

Every function takes and returns a ``Column`` so it stays inside whole-stage
codegen; nothing here is a Python UDF.  Regexes start with ``(?U)`` where the
Unicode meaning of ``\\s``/``\\d`` matters (Java defaults to ASCII).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.functions import fixed_values as FV

ColumnOrName = Column | str

# A strict decimal / scientific literal.  ``try_cast`` alone accepts "1d" and
# "inf", which a plain float parser would reject.
NUMERIC_LITERAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

# FIXED VALUES — English month names (3-letter prefixes, in calendar order).
MONTH_PREFIXES = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

# Date shapes recognised by ``parse_timestamp`` (whole cell, case-insensitive):
#   ISO      2024-01-15, 2024/01/15, 2024-01-15 10:30[:00[.123]], 2024-01-15T10:30:00
#   D/M/Y    15/01/2024, 15-01-2024, 15.01.2024 [10:30[:00]] (day-first unless told otherwise)
#   Y-M      2024-01 (first day of the month)
#   year     2024 (1900–2100, first of January)
#   named    15 Jan 2024, 15-January-2024, Jan 15, 2024, January 15 2024
_ISO = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:[ T](\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?)?$"
_DMY = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})(?:[ T](\d{1,2}):(\d{2})(?::(\d{2}))?)?$"
_YM = r"^(\d{4})-(\d{1,2})$"
_YEAR = r"^(19\d\d|20\d\d|2100)$"
_D_MON_Y = r"(?i)^(\d{1,2})[ -]([a-z]{3,9})\.?[ -](\d{4})$"
_MON_D_Y = r"(?i)^([a-z]{3,9})\.? (\d{1,2}),? (\d{4})$"

def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# --------------------------------------------------------------------- F1, F2
def utrim(c: ColumnOrName) -> Column:
    """strip Unicode whitespace at both ends (Spark ``trim`` only strips U+0020)."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def normalise_missing(c: ColumnOrName) -> Column:
    """trimmed text, or null for the missing markers ("", "n/a", "-", ...)."""
    t = utrim(_col(c).cast("string"))
    return F.when(F.lower(t).isin(*FV.MISSING_MARKERS), F.lit(None).cast("string")).otherwise(t)


def nan_to_null(c: ColumnOrName) -> Column:
    """NaN → null for floating columns (``sum``/``max`` propagate NaN)."""
    c = _col(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


# --------------------------------------------------------------------- F3, F4
def _finish_number(text: Column, negative: Column) -> Column:
    signed = F.when(negative & ~text.startswith("-"), F.concat(F.lit("-"), text)).otherwise(text)
    return F.when(signed.rlike(NUMERIC_LITERAL), signed.cast("double"))


def _strip_parens(t: Column) -> Column:
    return F.regexp_replace(t, r"^[()]+|[()]+$", "")


def _text(c: ColumnOrName, clean: bool) -> Column:
    return normalise_missing(c) if clean else _col(c)


def parse_number(c: ColumnOrName, clean: bool = True) -> Column:
    """simple parser — drop currency, spaces, commas and ``%``; ``(x)`` is negative.

    ``clean=False`` when ``c`` is already normalised (see ``normalise_missing``);
    project it once in its own ``select`` so the regexes run once per cell.
    """
    t = _text(c, clean)
    negative = t.startswith("(") & t.endswith(")")
    t = _strip_parens(t)
    t = F.regexp_replace(t, "[" + FV.CURRENCY_SYMBOLS + "]", "")
    t = F.regexp_replace(t, r"(?i)\b(" + "|".join(FV.CURRENCY_CODES) + r")\b", "")
    t = F.regexp_replace(t, "[ ,%]", "")
    return _finish_number(t, negative)


def locale_number_text(c: ColumnOrName, clean: bool = True) -> Column:
    """F4 step 1: the cell with parentheses, currency, ``%`` and spaces removed (one regex).

    Negative parentheses are kept as a leading ``(`` marker so step 2 can sign
    the value; project this once (``select``) before ``locale_number_finish``.
    """
    t = _text(c, clean)
    negative = t.startswith("(") & t.endswith(")")
    stripped = F.regexp_replace(
        t,
        r"(?U)^[()\s]+|[()\s]+$|[" + FV.CURRENCY_SYMBOLS + r"]|(?i)\b(" + "|".join(FV.CURRENCY_CODES) + r")\b|%|[ \u00a0\u202f]",
        "",
    )
    return F.when(negative, F.concat(F.lit("("), stripped)).otherwise(stripped)


def locale_number_finish(t: ColumnOrName) -> Column:
    """F4 step 2: decide the decimal mark and cast.

    Both separators: the last one is the decimal mark.  Commas only: one comma
    followed by exactly three digits, or several three-digit groups, are
    thousands; any other comma is the decimal mark.
    """
    t = _col(t)
    negative = t.startswith("(")
    body = F.when(negative, F.substring(t, 2, 1 << 30)).otherwise(t)
    has_dot, has_comma = F.instr(body, ".") > 0, F.instr(body, ",") > 0
    number = (
        F.when(has_comma & has_dot,
               F.when(body.rlike(r",[^.]*$"), F.translate(body, ",.", ".")).otherwise(F.translate(body, ",", "")))
        .when(has_comma,
              F.when(body.rlike(r"^[^,]*(,\d{3})+$"), F.translate(body, ",", "")).otherwise(F.translate(body, ",", ".")))
        .otherwise(body)
    )
    return F.when(body != "", _finish_number(number, negative))


def parse_number_locale(c: ColumnOrName, clean: bool = True) -> Column:
    """locale-aware parser ("3 200,00", "5,500.00", "$3,800", "(1 234,56)", "1.234,56")."""
    return locale_number_finish(locale_number_text(c, clean))


def looks_numeric(c: ColumnOrName) -> Column:
    """True when a (non-null) cell has the shape of a number."""
    return _col(c).rlike("(?U)" + FV.LOOKS_NUMERIC_PATTERN)


# ----------------------------------------------------------------- F5, F6, F10
def _ts(y, m, d, hh=None, mm=None, ss=None) -> Column:
    z = F.lit(0)
    i = lambda x: x.try_cast("int")
    return F.try_make_timestamp_ntz(
        i(y), i(m), i(d),
        F.coalesce(i(hh), z) if hh is not None else z,
        F.coalesce(i(mm), z) if mm is not None else z,
        F.coalesce(i(ss), z) if ss is not None else z,
    )


def _month_number(name: Column) -> Column:
    prefix = F.lower(F.substring(name, 1, 3))
    table = F.create_map(*[x for i, m in enumerate(MONTH_PREFIXES) for x in (F.lit(m), F.lit(i + 1))])
    return table[prefix]


def parse_timestamp(c: ColumnOrName, day_first: bool = True, clean: bool = True, strict: bool = False) -> Column:
    """timestamp from text of a recognised date shape, else null.

    ISO shapes go through Spark's own string→timestamp cast (no regex); D/M/Y
    is rearranged to ISO by one ``regexp_replace`` and cast, ``day_first``
    order first and the other order when the first is impossible; ``strict``
    tries the given order only, for columns whose order is chosen as a whole
    (``date_orders``).  Named
    months are rebuilt with ``try_make_timestamp_ntz``.  An impossible date
    (31/02/2024) is null and nothing throws.  Bare numbers are never dates,
    except a 4-digit year 1900–2100.
    """
    t = _text(c, clean)
    cast = lambda x: x.try_cast("timestamp_ntz")
    g = lambda pat, i: F.regexp_extract(t, pat, i)
    orders = ["$3-$2-$1", "$3-$1-$2"] if day_first else ["$3-$1-$2", "$3-$2-$1"]
    dmy_head = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})(?=$|[ T])"
    return (
        F.when(t.rlike(r"^\d+$"), F.when(t.rlike(_YEAR), cast(t)))
        .when(t.rlike(r"^\d{4}[-/]\d{1,2}([-/]\d{1,2})?([ T]\d|$)"), cast(F.translate(t, "/", "-")))
        .when(t.rlike(dmy_head), F.coalesce(*[cast(F.regexp_replace(t, dmy_head, iso)) for iso in orders[: 1 if strict else 2]]))
        .when(t.rlike(_D_MON_Y), _ts(g(_D_MON_Y, 3), _month_number(g(_D_MON_Y, 2)), g(_D_MON_Y, 1)))
        .when(t.rlike(_MON_D_Y), _ts(g(_MON_D_Y, 3), _month_number(g(_MON_D_Y, 1)), g(_MON_D_Y, 2)))
    )


def date_orders(df: DataFrame, columns: list[str], clean: bool = True) -> dict[str, bool]:
    """Whether day-first reads at least as many values as month-first, per text column (one aggregate over all)."""
    if not columns:
        return {}
    order = [F.count(parse_timestamp(c, first, clean, strict=True)).alias(f"{i}_{first}") for i, c in enumerate(columns) for first in (True, False)]
    found = df.agg(*order).first()
    return {c: found[f"{i}_True"] >= found[f"{i}_False"] for i, c in enumerate(columns)}


def parse_date(c: ColumnOrName, day_first: bool = True, clean: bool = True, strict: bool = False) -> Column:
    """F5 + F6: parsed value truncated to the day (``DateType``)."""
    return F.to_date(parse_timestamp(c, day_first, clean, strict))


def to_timestamp_any(c: ColumnOrName, data_type: str, day_first: bool = True) -> Column:
    """Timestamp from a column of any type (typed dates pass through)."""
    if data_type in ("timestamp", "timestamp_ntz", "date"):
        return _col(c).cast("timestamp_ntz")
    return parse_timestamp(c, day_first).cast("timestamp_ntz")


def date_parts(c: ColumnOrName) -> list[Column]:
    """year, month and day of a date."""
    d = _col(c)
    return [F.year(d).alias("year"), F.month(d).alias("month"), F.dayofmonth(d).alias("day")]


def looks_like_date_value(c: ColumnOrName) -> Column:
    return _col(c).rlike(FV.DATE_LIKE_VALUE_PATTERN)


# --------------------------------------------------------------------- F7, F8
def parse_boolean(c: ColumnOrName, clean: bool = True) -> Column:
    """yes/no words in English and French → boolean, anything else null."""
    t = F.lower(_text(c, clean))
    return F.when(t.isin(*FV.TRUE_WORDS), F.lit(True)).when(t.isin(*FV.FALSE_WORDS), F.lit(False))


def yes_no(c: ColumnOrName) -> Column:
    """Boolean as the text "Yes"/"No" (mapped-output boundary)."""
    b = _col(c)
    return F.when(b, F.lit("Yes")).when(~b, F.lit("No"))


def title_case(c: ColumnOrName) -> Column:
    """Title-case where every run of letters starts upper-case (``o'neil`` → ``O'Neil``).

    ``initcap`` only capitalises after spaces, so runs are split explicitly.
    """
    runs = F.regexp_extract_all(_col(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(
        F.transform(
            runs,
            lambda r: F.when(
                r.rlike(r"^\p{L}"), F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30)))
            ).otherwise(r),
        ),
        "",
    )


def normalize_category(c: ColumnOrName, clean: bool = True) -> Column:
    """F8: gender synonyms → Male/Female; otherwise collapse spaces and title-case."""
    t = _text(c, clean)
    low = F.lower(t)
    collapsed = utrim(F.regexp_replace(t, r"(?U)\s+", " "))
    return (
        F.when(t.isNull(), F.lit(None).cast("string"))
        .when(low.isin(*FV.MALE_WORDS), F.lit("Male"))
        .when(low.isin(*FV.FEMALE_WORDS), F.lit("Female"))
        .otherwise(title_case(collapsed))
    )


# ------------------------------------------------------------ F9, F11–F16, F18
def fill_missing(c: ColumnOrName, value) -> Column:
    """F9."""
    return F.coalesce(_col(c), F.lit(value))


def month_label(c: ColumnOrName) -> Column:
    """``yyyy-MM``."""
    return F.date_format(_col(c), "yyyy-MM")


def day_label(c: ColumnOrName) -> Column:
    return F.date_format(_col(c), "yyyy-MM-dd")


def iso_week_label(c: ColumnOrName) -> Column:
    """ISO week label ``2025-W01``."""
    d = F.to_date(_col(c))
    return F.concat(
        F.date_part(F.lit("YEAROFWEEK"), d).cast("string"),
        F.lit("-W"),
        F.lpad(F.weekofyear(d).cast("string"), 2, "0"),
    )


def period_label(c: ColumnOrName, group_by: str = "day") -> Column:
    """Day / ISO week / month bucket label used by activity series."""
    if group_by == "month":
        return month_label(c)
    if group_by == "week":
        return iso_week_label(c)
    return day_label(c)


def truncate_text(c: ColumnOrName, n: int = FV.DIMENSION_VALUE_MAX_CHARS) -> Column:
    """F13."""
    return F.substring(_col(c), 1, n)


def round_clamp(c: ColumnOrName, lo: float = 0.0, hi: float = 100.0, digits: int = 2) -> Column:
    """F16: clamp to [lo, hi] then round."""
    return F.round(F.least(F.greatest(_col(c), F.lit(lo)), F.lit(hi)), digits)


def plain_number(c: ColumnOrName) -> Column:
    """Double as text without an exponent between 0.0001 and 10^16, the shortest digits that read back as it.

    Outside: ``1e+16``, ``1.5e-07``.  ``1e8`` gives ``100000000.0``.
    """
    text = _col(c).cast("double").cast("string")
    sign = F.regexp_extract(text, "^-", 0)
    digits = F.regexp_replace(F.regexp_extract(text, r"^-?([0-9.]+)E", 1), r"\.0$|\.", "")
    power = F.regexp_extract(text, r"E(-?\d+)$", 1).cast("int")
    whole = F.concat(digits, F.repeat(F.lit("0"), power + 1 - F.length(digits)))
    large = F.concat(F.substring(whole, F.lit(1), power + 1), F.lit("."), F.coalesce(F.nullif(F.substring(whole, power + 2, F.lit(99)), F.lit("")), F.lit("0")))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    mantissa = F.concat(F.substring(digits, 1, 1), F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substring(digits, 2, 99))).otherwise(F.lit("")))
    scientific = F.concat(mantissa, F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(F.abs(power).cast("string"), 2, "0"))
    value = F.when(power.between(0, 15), large).when(power.between(-4, -1), small).otherwise(scientific)
    return F.when(text.contains("E"), F.concat(sign, value)).otherwise(text)


def lenient_number(c: ColumnOrName) -> Column:
    """drop whitespace, first comma → dot, else 0 (chart values)."""
    t = F.regexp_replace(_col(c).cast("string"), r"(?U)\s", "")
    t = F.regexp_replace(t, "^([^,]*),", "$1.")
    return F.coalesce(F.when(t.rlike(NUMERIC_LITERAL), t.cast("double")), F.lit(0.0))


# -------------------------------------------------------------------- F17
#: French names of powers of a thousand in compact numbers, and signs of currencies; fixed values.
COMPACT_UNITS = ["", "k", "M", "Md", "Bn"]
CURRENCY_SIGNS = {"EUR": "€", "USD": "$", "GBP": "£"}
_NARROW, _NO_BREAK = "\u202f", "\u00a0"


def _decimal_text(v: Column, least: int, most: int) -> Column:
    """French digits of a non-negative number: half-up, ``least`` to ``most`` decimals."""
    rounded = F.format_number(F.round(v, most), most)  # "1,234.50"
    whole = F.regexp_replace(F.split(rounded, r"\.").getItem(0), ",", _NARROW)
    if most == 0:
        return whole
    frac = F.split(rounded, r"\.").getItem(1)
    if least < most:
        frac = F.regexp_replace(frac, "0{1,%d}$" % (most - least), "")
    return F.when(frac == "", whole).otherwise(F.concat(whole, F.lit(","), frac))


def _compact_text(v: Column) -> Column:
    """``12,3 k``: at most one decimal; a number that rounds up to the next unit takes that unit."""
    out = _decimal_text(v, 0, 1)
    for k, unit in enumerate(COMPACT_UNITS[1:], 1):
        scaled = v / 1000.0**k
        out = F.when(F.round(v / 1000.0 ** (k - 1), 1) >= 1000, F.concat(_decimal_text(scaled, 0, 1), F.lit(_NO_BREAK + unit))).otherwise(out)
    return out


def format_display(c: ColumnOrName, kind: str = "number", decimals: int | None = None, currency: str = "EUR", compact: bool = False) -> Column:
    """French-locale display text; ``—`` for null or empty.

    number → ``1 234``; currency → ``1 234,50 €``; percentage → ``12,5 %``
    (the value is a fraction); text → the value; date → ``31/12/2024``, or the
    value where it is no date.  A value that is no number stays as it is.
    ``compact`` shortens numbers from 10 000 on, and any amount (``12,3 k``,
    ``1,2 M €``); there null or no number is the empty text.  Thousands are
    parted by U+202F, the decimal mark is a comma.
    """
    raw = _col(c)
    text = raw.cast("string")
    empty = F.lit("") if compact else F.lit("—")
    missing = raw.isNull() | (text == "")
    if kind in ("text", "date"):
        shown = text if kind == "text" else F.coalesce(F.date_format(parse_timestamp(text, clean=False), "dd/MM/yyyy"), text)
        if not compact:
            return F.when(missing, F.lit("—")).otherwise(shown)
        kind = "number"
    v = text.try_cast("double")
    if decimals is None:
        decimals = {"number": 0, "currency": 2, "percentage": 1}[kind]
    size = F.abs(v * 100 if kind == "percentage" else v)
    plain = _decimal_text(size, decimals, decimals)
    if compact and kind == "currency":
        plain = _compact_text(size)
    elif compact and kind == "number":
        plain = F.when(size >= 10_000, _compact_text(size)).otherwise(_decimal_text(size, 0, decimals))
    unit = {"currency": _NO_BREAK + CURRENCY_SIGNS.get(currency, currency), "percentage": _NO_BREAK + "%"}.get(kind, "")
    shown = F.concat(F.when(v < 0, F.lit("-")).otherwise(F.lit("")), plain, F.lit(unit))
    return F.when(missing, empty).when(v.isNull(), empty if compact else text).otherwise(shown)


# -------------------------------------------------------------------- F19
def json_get(c: ColumnOrName, path: str) -> Column:
    """F19 decode: one field of a JSON text (malformed → null)."""
    return F.get_json_object(_col(c), path)


def to_json_record(*cols: ColumnOrName) -> Column:
    """F19 encode / S8: one JSON object per row, nulls kept as ``null``."""
    return F.to_json(F.struct(*[_col(c) for c in cols]), {"ignoreNullFields": "false"})
