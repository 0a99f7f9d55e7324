"""Canonical JSON of typed values as expressions: the same bytes as Python's ``json.dumps(value, sort_keys=True)``.

Four forms are in use (fixed values): compact or with blanks after signs, and with characters outside ASCII as they are or escaped;
some refuse NaN and infinite numbers, which then give a null. Fields of structs and keys of maps are sorted by code points,
nulls are written. Numbers are written as Python does: integers plainly, floats with the fewest digits that read back the same.
Dates and timestamps are texts. All of it stays in the JVM, so a digest of a nested row costs no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Form:
    item: str = ","
    key: str = ":"
    ascii: bool = False
    finite: bool = True


#: The forms of retrieval inputs, of stored inputs, of audits and of releases.
RETRIEVAL, INPUT, AUDIT, RELEASE = Form(finite=False), Form(", ", ": "), Form(), Form(ascii=True, finite=False)

_SHORT = {8: "b", 9: "t", 10: "n", 12: "f", 13: "r"}


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used there."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _fewer(v: Column, n: int) -> Column:
    """digits and point with at most n digits, if they read back as the same number, else null; Java may write more than needed."""
    cut = F.rpad(F.substring(v["digits"], 1, n + 1), n + 1, "0").cast("decimal(20,0)")
    rounded = F.round(cut / F.lit(10).cast("decimal(2,0)")).cast("decimal(20,0)").cast("string")

    def kept(r: Column) -> Column:
        point = v["point"] + F.length(r) - n
        back = F.concat(v["sign"], F.lit("0."), r, F.lit("E"), point.cast("string")).try_cast("double")
        return F.when(back == v["x"], F.struct(v["sign"].alias("sign"), F.regexp_replace(r, "0+$", "").alias("digits"), point.alias("point"), v["x"].alias("x")))

    return _let(rounded, kept)


def _laid_out(v: Column) -> Column:
    d, p = v["digits"], v["point"]
    e = p - 1
    plain = (
        F.when(p <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -p), d))
        .when(p >= F.length(d), F.concat(d, F.repeat(F.lit("0"), p - F.length(d)), F.lit(".0")))
        .otherwise(F.concat(F.substr(d, F.lit(1), p), F.lit("."), F.substr(d, p + 1)))
    )
    tail = F.when(F.length(d) > 1, F.concat(F.lit("."), F.substr(d, F.lit(2)))).otherwise(F.lit(""))
    power = F.abs(e).cast("string")
    scientific = F.concat(F.substr(d, F.lit(1), F.lit(1)), tail, F.when(e < 0, "e-").otherwise("e+"), F.lpad(power, F.greatest(F.lit(2), F.length(power)), F.lit("0")))
    return F.concat(v["sign"], F.when(d == "", "0.0").when((e >= -4) & (e < 16), plain).otherwise(scientific))


def python_float(c: Column) -> Column:
    """The text of a double as Python writes it; null for null."""
    shape = r"^(-?)(\d+)\.(\d+)(?:E(-?\d+))?$"

    def parts(v: Column) -> Column:
        nth = lambda k: F.regexp_extract(v["s"], shape, k)
        return F.struct(nth(1).alias("sign"), F.concat(nth(2), nth(3)).alias("led"), (F.length(nth(2)) + F.coalesce(nth(4).try_cast("int"), F.lit(0))).alias("point"), v["x"].alias("x"))

    def bare(v: Column) -> Column:
        ahead = F.length(v["led"]) - F.length(F.regexp_replace(v["led"], "^0+", ""))
        return F.struct(v["sign"].alias("sign"), F.regexp_replace(v["led"], "^0+|0+$", "").alias("digits"), (v["point"] - ahead).alias("point"), v["x"].alias("x"))

    def shortest(v: Column) -> Column:
        tiny = F.abs(v["x"]) < 1e-307  # few bits are left there
        few = F.coalesce(*[_fewer(v, n) for n in range(1, 15)], v)
        return F.when(tiny, few).when(F.length(v["digits"]) < 16, v).otherwise(F.coalesce(_fewer(v, 15), _fewer(v, 16), _fewer(v, 17), v))

    # whole numbers of up to 63 bits are known exactly
    whole = F.abs(c.cast("double")).between(1e16, 9.2e18)
    exact = F.concat(F.when(whole, c.cast("double")).cast("long").cast("string"), F.lit(".0"))
    given = F.struct(c.cast("double").alias("x"), F.coalesce(exact, c.cast("double").cast("string")).alias("s"))
    text = _let(_let(_let(_let(given, parts), bare), shortest), _laid_out)
    large = F.when(c > 0, "Infinity").otherwise("-Infinity")
    return F.when(c.isNull(), None).when(F.isnan(c.cast("double")), "NaN").when(F.abs(c.cast("double")) == float("inf"), large).otherwise(text)


def quoted(c: Column, ascii: bool = False) -> Column:
    """A text as a JSON string."""
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    full = out
    for k in range(32):
        full = F.replace(full, F.lit(chr(k)), F.lit("\\" + _SHORT[k] if k in _SHORT else f"\\u{k:04x}"))
    out = F.when(F.rlike(c, F.lit(r"[\x00-\x1F]")), full).otherwise(out)
    if ascii:
        units = F.regexp_extract_all(F.hex(F.encode(out, "UTF-16BE")), F.lit(".{4}"), F.lit(0))
        escaped = F.array_join(F.transform(units, lambda u: F.when(u < "007F", F.decode(F.unhex(F.substring(u, 3, 2)), "US-ASCII")).otherwise(F.concat(F.lit("\\u"), F.lower(u)))), "")
        out = F.when(F.rlike(out, F.lit(r"[^\x00-\x7E]")), escaped).otherwise(out)
    return F.concat(F.lit('"'), out, F.lit('"'))


def _written(c: Column, kind: T.DataType, form: Form) -> Column:
    """JSON of a value; a null stands for ``null`` here."""
    if isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(_name(n, form) + form.key), _or_null(c[n], kind[n].dataType, form)) for n in sorted(kind.names)]
        return F.when(c.isNotNull(), F.concat(F.lit("{"), *[x for p in parts for x in (F.lit(form.item), p)][1:], F.lit("}")))
    if isinstance(kind, T.ArrayType):
        return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: _or_null(x, kind.elementType, form)), form.item), F.lit("]"))
    if isinstance(kind, T.MapType):
        entries = F.array_sort(F.transform(F.map_keys(c), lambda k: k.cast("string")))
        keyed = F.transform(entries, lambda k: F.concat(quoted(k, form.ascii), F.lit(form.key), _or_null(F.element_at(c, k.cast(kind.keyType)), kind.valueType, form)))
        return F.concat(F.lit("{"), F.array_join(keyed, form.item), F.lit("}"))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return python_float(c)
    if isinstance(kind, (T.BooleanType, T.IntegralType, T.DecimalType)):
        return c.cast("string")
    return quoted(c.cast("string"), form.ascii)


def _name(name: str, form: Form) -> str:
    import json

    return json.dumps(name, ensure_ascii=form.ascii)


def _or_null(c: Column, kind: T.DataType, form: Form) -> Column:
    return F.coalesce(_written(c, kind, form), F.lit("null"))


def canonical(df: DataFrame, column: str, form: Form = AUDIT) -> Column:
    """The JSON of a column of any type; null where the form refuses a number that isn't finite."""
    kind = df.schema[column].dataType
    out = _or_null(F.col(column), kind, form)
    return F.when(_finite(F.col(column), kind), out) if form.finite else out


def _finite(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        out = F.lit(True)
        for f in kind.fields:
            out = out & _finite(c[f.name], f.dataType)
        return out
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.forall(c, lambda x: _finite(x, kind.elementType)), F.lit(True))
    if isinstance(kind, T.MapType):
        return F.coalesce(F.forall(F.map_values(c), lambda x: _finite(x, kind.valueType)), F.lit(True))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(True))
    return F.lit(True)


def fingerprint(df: DataFrame, column: str, form: Form = AUDIT) -> Column:
    """SHA-256 of the canonical JSON."""
    return F.sha2(canonical(df, column, form), 256)
