"""Functions of legacy expression languages whose semantics differ from Spark's, as Column expressions.

What Spark has under another name with the same meaning is listed in ``SAME`` and needs no function here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | str


def col(x: object) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def lit(x: object) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# Names of functions that mean the same in Spark.
SAME = {
    "ABS": "abs", "ACOS": "acos", "ASCII": "ascii", "ASIN": "asin", "ATAN": "atan", "AVG": "avg", "CEIL": "ceil", "CHR": "chr", "CHRCODE": "ascii", "CONCAT": "concat", "COS": "cos", "COSH": "cosh", "COUNT": "count", "CRC32": "crc32",
    "DEC_BASE64": "unbase64", "ENC_BASE64": "base64", "EXP": "exp", "FLOOR": "floor", "GREATEST": "greatest", "INITCAP": "initcap", "INSTR": "instr", "ISNULL": "isnull", "LAST_DAY": "last_day", "LEAST": "least", "LENGTH": "length", "LN": "ln", "LOG": "log", "LOWER": "lower",
    "LPAD": "lpad", "LTRIM": "ltrim", "MAX": "max", "MD5": "md5", "MEDIAN": "median", "MIN": "min", "MOD": "mod", "NVL": "coalesce", "NVL2": "nvl2", "POWER": "power", "RAND": "rand", "REG_EXTRACT": "regexp_extract", "REG_MATCH": "regexp_like",
    "REG_REPLACE": "regexp_replace", "REVERSE": "reverse", "ROUND": "round", "RPAD": "rpad", "RTRIM": "rtrim", "SIGN": "sign", "SIN": "sin", "SINH": "sinh", "SOUNDEX": "soundex", "SQRT": "sqrt", "STDDEV": "stddev_samp", "SUBSTR": "substr", "SUM": "sum",
    "SYSDATE": "current_timestamp", "SYSTIMESTAMP": "current_timestamp", "GETDATE": "current_timestamp", "TAN": "tan", "TANH": "tanh", "TRIM": "trim", "UPPER": "upper", "VARIANCE": "var_samp", "ZEROIFNULL": "zeroifnull", "NULLIFZERO": "nullifzero",
    "OREPLACE": "replace", "OTRANSLATE": "translate", "CHARINDEX": "locate", "POSITION": "locate", "TRY_CAST": "try_cast", "LISTAGG": "listagg", "STRING_AGG": "listagg", "JSON_VALUE": "get_json_object", "MONTHS_BETWEEN": "months_between",
    "EOMONTH": "last_day", "AES_ENCRYPT": "aes_encrypt", "AES_DECRYPT": "try_aes_decrypt", "CONVERT_BASE": "conv", "EPOCH_TO_TIMESTAMP": "timestamp_seconds", "SPLIT_PART": "split_part", "MAKE_DATE_TIME": "make_timestamp",
}


# Nulls and conditions


def decode(x: Value, *pairs: object, default: object = None, null_safe: bool = True) -> Column:
    """DECODE(x, search, result, ...): a null search matches null if ``null_safe``, else nothing."""
    if len(pairs) % 2:
        raise ValueError("searches and results come in pairs")
    c, chain = col(x), None
    for s, r in zip(pairs[::2], pairs[1::2], strict=True):
        test = c.eqNullSafe(lit(s)) if null_safe else c == lit(s)
        chain = (F if chain is None else chain).when(test, lit(r))
    return lit(default) if chain is None else chain.otherwise(lit(default))


def iif(condition: Column, a: object, b: object = None) -> Column:
    return F.when(condition, lit(a)).otherwise(lit(b))


def greatest_strict(*xs: Value) -> Column:
    """Null if any is null."""
    return F.when(_any_null(xs), None).otherwise(F.greatest(*map(col, xs)))


def least_strict(*xs: Value) -> Column:
    return F.when(_any_null(xs), None).otherwise(F.least(*map(col, xs)))


def _any_null(xs: Sequence[Value]) -> Column:
    test = F.lit(False)
    for x in xs:
        test = test | col(x).isNull()
    return test


def choose(index: Value, *values: object) -> Column:
    """CHOOSE: counted from 1, null outside."""
    chain = F.when(col(index) == 1, lit(values[0]))
    for i, v in enumerate(values[1:], 2):
        chain = chain.when(col(index) == i, lit(v))
    return chain


def index_of(x: Value, *values: object) -> Column:
    """INDEXOF: the place of x in the values from 1, else 0."""
    chain = F.when(col(x) == lit(values[0]), 1)
    for i, v in enumerate(values[1:], 2):
        chain = chain.when(col(x) == lit(v), i)
    return chain.otherwise(0)


def empty_as_null(x: Value) -> Column:
    return F.nullif(col(x), F.lit(""))


# Strings


def concat_empty(*xs: Value) -> Column:
    """Concatenation in which null is empty."""
    return F.concat_ws("", *map(col, xs))


def is_spaces(x: Value) -> Column:
    return (F.length(col(x)) > 0) & (F.trim(col(x)) == "")


def replace_chars(x: Value, chars: str, replacement: str = "", case_sensitive: bool = True) -> Column:
    """REPLACECHR: each of the characters by the replacement, a string of one character or none."""
    chars = chars if case_sensitive else "".join(dict.fromkeys(chars.lower() + chars.upper()))
    return F.translate(col(x), chars, replacement[:1] * len(chars) if replacement else "")


def replace_text(x: Value, searches: Sequence[str], replacement: str = "", case_sensitive: bool = True) -> Column:
    """REPLACESTR: every occurrence of any of the searches, the first one that fits at a place."""
    escaped = "|".join("".join("\\" + c if not c.isalnum() else c for c in s) for s in searches if s)
    safe = replacement.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(col(x), ("" if case_sensitive else "(?i)") + escaped, safe) if escaped else col(x)


def instr_from(x: Value, needle: str, start: int = 1, occurrence: int = 1) -> Column:
    """INSTR with a start and an occurrence; 0 if there are fewer."""
    at = F.locate(needle, col(x), start)
    for _ in range(occurrence - 1):
        # locate takes a literal start only in this API, so later occurrences go through SQL's form of it
        at = F.when(at > 0, F.call_function("locate", F.lit(needle), col(x), at + 1)).otherwise(0)
    return at


def pattern_index(pattern: str, x: Value) -> Column:
    """PATINDEX with a LIKE pattern (%, _, [set], [^set]); the place from 1, else 0."""
    inner = pattern.removeprefix("%")
    anchored_start = not pattern.startswith("%")
    anchored_end = not inner.endswith("%")
    inner = inner.removesuffix("%")
    out, i = [], 0
    while i < len(inner):
        c = inner[i]
        if c == "[" and (end := inner.find("]", i + 1)) > 0:
            out.append("[" + inner[i + 1 : end].replace("\\", "\\\\") + "]")
            i = end
        else:
            out.append({"%": ".*", "_": "."}.get(c, c if c.isalnum() or c == " " else "\\" + c))
        i += 1
    rx = ("^" if anchored_start else "") + "".join(out) + ("$" if anchored_end else "")
    return F.regexp_instr(col(x), F.lit("(?s)" + rx))


def standard_hash(x: Value, method: str = "SHA1") -> Column:
    """STANDARD_HASH / HASHBYTES: upper-case hexadecimal digits."""
    kind = method.upper().replace("_", "").replace("-", "")
    made = {"MD5": F.md5(col(x)), "SHA1": F.sha1(col(x)), "SHA": F.sha1(col(x))} | {f"SHA{n}": F.sha2(col(x), n) for n in (256, 384, 512)} | {f"SHA2{n}": F.sha2(col(x), n) for n in (256, 384, 512)}
    if kind not in made:
        raise ValueError(f"no such method: {method}")
    return F.upper(made[kind])


def mask(x: Value, keep_last: int = 0, fill: str = "X") -> Column:
    """DATA_MASKING: letters and digits but the last few."""
    c = col(x)
    cut = F.greatest(F.length(c) - keep_last, F.lit(0))
    return F.concat(F.regexp_replace(F.substr(c, F.lit(1), cut), r"[\p{L}\p{N}]", fill), F.substr(c, cut + 1))


# Numbers


def truncate(x: Value, places: int = 0) -> Column:
    """TRUNC of a number, towards zero, in decimal arithmetic: 0.29 to two places is 0.29, and decimals keep all digits.

    Whole numbers of doubles are bigints; doubles are taken to ``places`` as decimals of 15 digits on either side of the point.
    """
    c = col(x)
    down, up = (F.floor(c), F.ceil(c)) if places == 0 else (F.floor(c, F.lit(places)), F.ceil(c, F.lit(places)))
    return F.when(c >= 0, down).otherwise(up)


def to_decimal(x: Value, scale: int = 6, strict: bool = False) -> Column:
    kind = f"decimal(38,{scale})"
    return col(x).cast(kind) if strict else col(x).try_cast(kind)


def to_integer(x: Value, truncating: bool = True, kind: str = "int") -> Column:
    """TO_INTEGER, TO_BIGINT: of text or numbers, null if it is none; rounding halves away from zero, or cutting."""
    d = col(x).try_cast("decimal(38,10)")
    return (truncate(d) if truncating else F.round(d, 0)).try_cast(kind)


def is_number(x: Value) -> Column:
    return F.trim(col(x)).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")


def random_between(low: int, high: int) -> Column:
    """RANDOM(low, high): whole numbers, ends included."""
    return (F.floor(F.rand() * (high - low + 1)) + low).cast("long")


# Errors and the session


def error(message: Value) -> Column:
    """ERROR and ABORT: fails the query where it is evaluated; rows that are only to be skipped are rejects."""
    return F.raise_error(message if isinstance(message, Column) else F.lit(message))


def session_start(at: object) -> Column:
    """SESSSTARTTIME: the time that the caller took when the session began, the same for all rows and retries."""
    return F.lit(at).cast("timestamp")


# Dates

# Parts of date masks, longest first, and what Spark calls them.
MASKS = (("YYYY", "yyyy"), ("RRRR", "yyyy"), ("MONTH", "MMMM"), ("HH24", "HH"), ("HH12", "hh"), ("MON", "MMM"), ("DAY", "EEEE"), ("DDD", "DDD"), ("YY", "yy"), ("RR", "yy"), ("MM", "MM"), ("DD", "dd"), ("DY", "EEE"), ("HH", "hh"), ("MI", "mm"), ("SS", "ss"), ("FF", "SSSSSS"), ("MS", "SSS"), ("US", "SSSSSS"), ("AM", "a"), ("PM", "a"), ("Q", "q"))
UNITS = {"Y": "YEAR", "YY": "YEAR", "YYYY": "YEAR", "YEAR": "YEAR", "MM": "MONTH", "MON": "MONTH", "MONTH": "MONTH", "D": "DAY", "DD": "DAY", "DDD": "DAY", "DY": "DAY", "DAY": "DAY", "HH": "HOUR", "HH12": "HOUR", "HH24": "HOUR", "HOUR": "HOUR", "MI": "MINUTE", "MINUTE": "MINUTE", "SS": "SECOND", "SECOND": "SECOND", "MS": "MILLISECOND", "US": "MICROSECOND", "Q": "QUARTER", "QUARTER": "QUARTER", "W": "WEEK", "WEEK": "WEEK"}


def mask_to_pattern(mask_: str) -> str:
    """A date mask such as YYYY-MM-DD HH24:MI:SS as Spark's pattern; text in double quotes is kept."""
    out, i = [], 0
    upper = mask_.upper()
    while i < len(mask_):
        if mask_[i] == '"':
            end = mask_.index('"', i + 1)
            out.append("'" + mask_[i + 1 : end] + "'")
            i = end + 1
            continue
        for m, p in MASKS:
            if upper.startswith(m, i):
                out.append(p)
                i += len(m)
                break
        else:
            c = mask_[i]
            out.append("'" + c + "'" if c.isalpha() else c)
            i += 1
    return "".join(out)


def to_date_time(x: Value, mask_: str = "MM/DD/YYYY HH24:MI:SS") -> Column:
    """TO_DATE, with the time that the mask has; null where the text does not fit."""
    return F.try_to_timestamp(col(x), F.lit(mask_to_pattern(mask_)))


def to_text(x: Value, mask_: str) -> Column:
    """TO_CHAR of a date or time."""
    return F.date_format(col(x), mask_to_pattern(mask_))


def is_date(x: Value, mask_: str) -> Column:
    return to_date_time(x, mask_).isNotNull()


def unit(name: str) -> str:
    found = UNITS.get(name.upper())
    if found is None:
        raise ValueError(f"no such part of a date: {name}")
    return found


def add_to_date(x: Value, part: str, n: Value | int) -> Column:
    return F.timestamp_add(unit(part), lit(n) if isinstance(n, int) else col(n), col(x))


def elapsed(part: str, start: Value, end: Value) -> Column:
    """Whole units from start to end."""
    return F.timestamp_diff(unit(part), col(start), col(end))


def boundaries(part: str, start: Value, end: Value) -> Column:
    """DATEDIFF by boundaries crossed from start to end: of years, quarters, months, weeks (from Monday), days, hours, ..."""
    u = unit(part)
    a, b = (F.date_trunc(u, col(x)) for x in (start, end))
    if u == "YEAR":
        return (F.year(b) - F.year(a)).cast("long")
    if u in ("MONTH", "QUARTER"):
        months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
        return (months / 3 if u == "QUARTER" else months).cast("long")
    if u == "WEEK":
        return (F.datediff(b, a) / 7).cast("long")
    return F.timestamp_diff(u, a, b)


def date_diff(later: Value, earlier: Value, part: str) -> Column:
    """DATE_DIFF(d1, d2, part) = d1 - d2 in whole units."""
    return elapsed(part, earlier, later)


def date_compare(a: Value, b: Value) -> Column:
    """-1, 0 or 1; null if one is null."""
    return F.when(col(a) < col(b), -1).when(col(a) > col(b), 1).when(col(a) == col(b), 0)


def add_months(x: Value, n: int) -> Column:
    """ADD_MONTHS in which the last day of a month stays the last."""
    d = col(x)
    return F.when(F.to_date(d) == F.last_day(d), F.last_day(F.add_months(d, n))).otherwise(F.add_months(d, n))


def truncate_date(x: Value, part: str = "DD") -> Column:
    return F.date_trunc(unit(part), col(x))


def date_part(x: Value, part: str) -> Column:
    return F.date_part(F.lit(unit(part)), col(x))


def set_date_part(x: Value, part: str, value: int) -> Column:
    """SET_DATE_PART: null where there is no such date."""
    names = ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND")
    u = unit(part)
    if u not in names:
        raise ValueError(f"{part} cannot be set")
    return F.call_function("try_make_timestamp", *[F.lit(value) if n == u else F.date_part(F.lit(n), col(x)).cast("decimal(16,6)" if n == "SECOND" else "int") for n in names])


# JSON, arrays


def json_value(x: Value, path: str) -> Column:
    return F.get_json_object(col(x), path)


def json_values(x: Value, paths: dict[str, str]) -> Column:
    """Several values of one text in a struct, read once by a schema where the paths are plain names."""
    if all(p.startswith("$.") and p[2:].isidentifier() for p in paths.values()):
        parsed = F.from_json(col(x), ", ".join(f"{p[2:]} string" for p in dict.fromkeys(paths.values())))
        return F.struct(*[parsed.getField(p[2:]).alias(n) for n, p in paths.items()])
    return F.struct(*[F.get_json_object(col(x), p).alias(n) for n, p in paths.items()])


def array_element(x: Value, index: int) -> Column:
    """Counted from 1; null outside."""
    return F.get(col(x), F.lit(index - 1))


def flatten_rows(x: Value, outer: bool = False) -> Column:
    return F.explode_outer(col(x)) if outer else F.explode(col(x))


# Keys


def hash_key(*xs: Value) -> Column:
    """KEY_GENERATOR: a digest of the values; null and empty differ."""
    parts = [F.coalesce(F.concat(F.lit("="), col(x).cast("string")), F.lit("~")) for x in xs]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)
