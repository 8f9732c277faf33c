"""Numbers as exact decimals with abstention codes; 28-digit half-even quotients where Spark's decimals can't hold them."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Context, Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reasons import first

PRECISION = 28
_STRICT = r"^[+-]?\d+(\.\d+)?([Ee][+-]?\d+)?$"


# Fixed value: what an accounting token looks like. The five codes of ``parse_number`` before the last are fixed too.
TOKEN = r"^\(?-?\$?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?\)?$"


def parse_number(raw: Column) -> Column:
    """An accounting token -> struct(value decimal(38,10), error). Zero, blank, dash and unknown stay apart; a number with more
    than 28 digits before its point or 10 after it is not rounded or lost but an error of its own."""
    token = F.trim(F.regexp_replace(raw, r"^(?U)\s+|(?U)\s+$", ""))
    bare = F.regexp_replace(token, r"[()$,]", "")
    opened, closed = token.startswith("("), token.endswith(")")
    error = first(
        (raw.isNull() | (token == ""), "blank_numeric_cell"),
        (token.isin("-", "—", "–"), "dash_not_zero"),
        (F.lower(token).isin("unknown", "n/a", "null"), "unknown_numeric_value"),
        (~token.rlike(TOKEN), "malformed_numeric_token"),
        ((opened != closed) | (opened & token.contains("-")), "ambiguous_sign"),
        ((F.length(F.regexp_extract(bare, r"^-?0*(\d*)", 1)) > 28) | (F.length(F.regexp_replace(F.regexp_extract(bare, r"\.(\d*)$", 1), "0+$", "")) > 10), "number_beyond_precision"),
    )
    value = F.when(error.isNull(), bare.try_cast("decimal(38,10)"))
    return F.struct(F.when(opened, -value).otherwise(value).alias("value"), error.alias("error"))


def first_number(text: Column) -> Column:
    """The first number in a text; a triangle or parentheses make it negative."""
    token = F.regexp_extract(text, r"[△▲(-]?\s*\d[\d,]*(?:\.\d+)?", 0)
    value = F.regexp_replace(token, r"[^\d.]", "").try_cast("decimal(38,10)")
    return F.when(token.rlike(r"^[△▲(-]"), -value).otherwise(value)


def is_numeric_text(x: Column) -> Column:
    return F.coalesce(x.rlike(_STRICT), F.lit(False))


def decimal_text(x: Column) -> Column:
    """A decimal column as text without an exponent, trailing zeros and a bare point; zero is ``0``."""
    text = x.cast("string")
    text = F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    return F.when(text.isin("-0", ""), F.lit("0")).otherwise(text)


def _exact(op) -> object:
    ctx = Context(prec=PRECISION, rounding=ROUND_HALF_EVEN)

    def f(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            try:
                return None if x is None or y is None else op(ctx, Decimal(x), Decimal(y))
            except (InvalidOperation, ZeroDivisionError):
                return None

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    return f


def _text(x: Decimal | None) -> str | None:
    return None if x is None else format(x, "f")


def exact_difference(new: Column, old: Column) -> Column:
    """new - old of decimal texts in 28 significant digits, half-even, as text."""
    return F.pandas_udf(_exact(lambda c, x, y: _text(c.subtract(x, y))), "string")(new, old)


def exact_relative(new: Column, old: Column) -> Column:
    """(new - old) / |old| of decimal texts, a fraction as text; null if the base is zero."""
    return F.pandas_udf(_exact(lambda c, x, y: _text(c.divide(c.subtract(x, y), abs(y))) if y else None), "string")(new, old)


def exact_quotient(a: Column, b: Column) -> Column:
    return F.pandas_udf(_exact(lambda c, x, y: _text(c.divide(x, y)) if y else None), "string")(a, b)


def exact_product(a: Column, b: Column) -> Column:
    return F.pandas_udf(_exact(lambda c, x, y: _text(c.multiply(x, y))), "string")(a, b)


def change_interpretation(new: Column, old: Column) -> Column:
    return F.when((new < 0) | (old < 0), "negative_base_or_loss_transition").otherwise("arithmetic_change")


def ratio(numerator: Column, denominator: Column) -> Column:
    """struct(value, reason): a ratio over zero is null with a reason, never 0 or 1."""
    return F.struct(F.try_divide(numerator.cast("double"), denominator.cast("double")).alias("value"), F.when(denominator.isNull(), "denominator_unknown").when(denominator == 0, "zero_denominator").alias("reason"))


def within(a: Column, b: Column, tolerance: Column) -> Column:
    """Reconciliation status of two amounts."""
    return F.when(a.isNull() | b.isNull(), "missing_pair").when(F.abs(a - b) <= tolerance, "reconciled").otherwise("difference")


def signed_by_policy(value: Column, policy: Column) -> Column:
    """struct(value, error): an outflow is turned positive; a positive source of one abstains."""
    out = policy == "outflow_to_positive"
    error = F.when(out & (value > 0), F.lit("positive_capex_source_sign_ambiguous"))
    return F.struct(F.when(error.isNull(), F.when(out, -value).otherwise(value)).alias("value"), error.alias("error"))


def scaled(amounts: DataFrame, rules: DataFrame) -> DataFrame:
    """Unit scaling by the one matching rule. amounts: value (text), unit, currency and more; rules: rule_id, input_unit,
    currency_condition, multiplier (text), output_unit. Adds output, output_unit, rule_id, calculation_status, reasons.
    A unit without exactly one rule for the currency is left alone with a reason."""
    a = amounts.withColumn("__row", F.monotonically_increasing_id())
    a = a.withColumn("__known", F.col("unit").isNotNull() & F.col("currency").isNotNull() & ~F.lower("unit").isin("unknown", "ambiguous", "") & ~F.lower("currency").isin("unknown", "ambiguous", ""))
    r = rules.select(F.col("input_unit").alias("__unit"), F.col("currency_condition").alias("__cc"), "rule_id", "multiplier", F.col("output_unit").alias("output_unit"))
    one = r.groupBy("__unit", "__cc").agg(F.count(F.lit(1)).alias("__n"), F.max_by(F.struct("rule_id", "multiplier", "output_unit"), "rule_id").alias("__rule"))
    # a currency's own rules and those for any currency are one set: at most four short keys per amount
    keys = [F.col("currency"), F.concat(F.lit("currency="), F.col("currency")), F.lit("same_currency"), F.lit("any_same_currency")]
    currencies = amounts.select("currency").distinct().where("currency is not null")
    by = currencies.withColumn("__cc", F.explode(F.array(*keys))).join(one, "__cc").groupBy("currency", "__unit").agg(F.sum("__n").alias("__n"), F.max("__rule").alias("__rule"))
    out = a.join(by, (a["unit"] == by["__unit"]) & (a["currency"] == by["currency"]), "left").select(a["*"], "__n", "__rule")
    good = is_numeric_text(F.col("value")) & F.col("__known") & (F.col("__n") == 1)
    reason = first((F.col("value").isNull(), "value_missing"), (~is_numeric_text(F.col("value")), "numeric_value must be a finite Decimal string"), (~F.col("__known"), "currency_or_unit_unknown"), (F.coalesce(F.col("__n"), F.lit(0)) != 1, "no_unambiguous_scale_rule"))
    status = F.when(F.col("value").isNull(), "insufficient_inputs").when(~is_numeric_text(F.col("value")), "invalid_input").when(reason.isNotNull(), "incompatible_inputs").otherwise("computed")
    product = F.col("value").try_cast("decimal(38,10)") * F.col("__rule.multiplier").try_cast("decimal(20,6)")
    return out.withColumn("output", F.when(good, decimal_text(product))).withColumn("output_unit", F.when(good, F.col("__rule.output_unit"))).withColumn("rule_id", F.when(good, F.col("__rule.rule_id"))).withColumn("calculation_status", status).withColumn("reasons", F.array_compact(F.array(reason))).drop("__row", "__known", "__n", "__rule")
