"""Trivial code: why a record is left out, by its first definition, and the central filter by names and special methods.

Null, empty and comment-only code is "empty"; code that doesn't parse is kept, and so is any other first statement.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinnabar.functions import text as X
from cinnabar.functions.parsing import count_statements
from cinnabar.sources.scratch import spread

CONVERTERS = [f"{a}_{b}" for a in ("as", "from", "to") for b in ("str", "string", "json", "dict")] + sorted(["serialize", "deserialize", "encode", "decode"])
#: Special methods that the central filter knows.
SPECIAL = [
    f"__{x}__"
    for x in """bool bytes call complex contains copy deepcopy del delattr delete delitem enter eq exit float format ge get getattr
    getattribute getitem gt hash init int iter le len lt ne new next repr reversed set setattr setitem str""".split()
]
REASONS = ["single_return", "simple_special_method", "simple_property", "short_function", "simple_converter", "trivial_class", "data_model_class", "test_function"]


@dataclass(frozen=True)
class Trivial:
    """Which rules hold; short functions and converters only if asked."""

    single_return: bool = True
    special_method: bool = True
    simple_property: bool = True
    trivial_class: bool = True
    short_function: bool = False
    converter: bool = False
    most_lines: int = 3
    include_tests: bool = False


def single_return(c: Column) -> Column:
    return (c["returns"] == 1) & (c["statements"] <= 1) & c["return_kind"].isin("name", "attribute", "constant")


def special_method(c: Column) -> Column:
    return c["name"].startswith("__") & c["name"].endswith("__") & (c["has_pass"] | ((c["statements"] <= 2) & (c["returns"] == 1)))


def simple_property(c: Column) -> Column:
    return (c["decorated"] | c["name"].rlike("^(get|set|is|has)_")) & single_return(c)


def short_function(c: Column, most: int) -> Column:
    return (c["code_lines"] <= most) & (c["statements"] <= 2)


def converter(c: Column) -> Column:
    return c["name"].isin(CONVERTERS) & single_return(c)


def trivial_class(c: Column) -> Column:
    return c["has_pass"] | ((c["methods"] == 0) & (c["statements"] == 0))


def exclude_reason(c: Column, rules: Trivial = Trivial()) -> Column:  # noqa: B008
    """Why code is left out, or null; c: of count_statements."""
    function, cls = c["kind"] == "function", c["kind"] == "class"
    on = lambda flag, when: when if flag else F.lit(False)
    return (
        F.when(c["kind"] == "empty", "empty")
        .when(function & on(not rules.include_tests, X.is_test_name(c["name"])), "test_function")
        .when(function & on(rules.single_return, single_return(c)), "single_return")
        .when(function & on(rules.special_method, special_method(c)), "simple_special_method")
        .when(function & on(rules.simple_property, simple_property(c)), "simple_property")
        .when(function & on(rules.short_function, short_function(c, rules.most_lines)), "short_function")
        .when(function & on(rules.converter, converter(c)), "simple_converter")
        .when(cls & on(rules.trivial_class, trivial_class(c)), "trivial_class")
        .when(cls & on(rules.trivial_class, c["data_model"]), "data_model_class")
    )


def keep(records: DataFrame, code_col: str = "code_content", rules: Trivial = Trivial()) -> DataFrame:  # noqa: B008
    """Records that aren't trivial."""
    counted = spread(records, code_col).withColumn("__c", count_statements(code_col))
    return counted.where(exclude_reason(F.col("__c"), rules).isNull()).drop("__c")


def exclusion_stats(records: DataFrame, code_col: str = "code_content", rules: Trivial = Trivial()) -> DataFrame:  # noqa: B008
    """total, excluded, included, exclusion_rate, and how many by each reason; what doesn't parse counts as excluded here."""
    c = spread(records.select(code_col), code_col).select(count_statements(code_col).alias("c")).select(F.when(F.col("c.kind") == "error", "parse_error").otherwise(exclude_reason(F.col("c"), rules)).alias("why"))
    sums = c.agg(F.count(F.lit(1)).alias("total"), F.count("why").alias("excluded"), *[F.count_if(F.col("why") == r).alias(r) for r in [*REASONS, "parse_error"]])
    rate = F.when(F.col("total") > 0, F.col("excluded") / F.col("total")).otherwise(0.0)
    return sums.select("total", "excluded", (F.col("total") - F.col("excluded")).alias("included"), F.round(rate, 6).alias("exclusion_rate"), *REASONS, "parse_error")


def centrally_excluded(name: Column, code: Column, body_statements: Column, include_tests: bool = False, include_trivial: bool = False) -> Column:
    """The central filter: no code, a name that sounds like a test ("test" anywhere in it), a special method with little in it."""
    low = F.lower(F.coalesce(name, F.lit("")))
    sounds = low.contains("test") | low.contains("should_") | low.startswith("it_")
    little = F.coalesce(name, F.lit("")).isin(SPECIAL) & (body_statements <= F.when(name == "__init__", 10).otherwise(3))
    return F.coalesce(code == "", F.lit(True)) | (F.lit(not include_tests) & sounds) | (F.lit(not include_trivial) & little)
