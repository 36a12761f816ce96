"""Scalar rules on types and values, as Columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Libraries whose objects only administer the program (fixed values).
_LIBRARIES = r"(typing|copyreg|copy|contextlib|abc|ast)\."
#: Types that no link is followed into; the dot after builtins stands for any character (fixed value).
SKIP_TYPE = rf"^(builtins.(module|type)\z|{_LIBRARIES})"
SKIP_FUNCTION_VALUE = rf"^{_LIBRARIES}"
#: Characters that a stored value keeps (fixed values).
MAX_VALUE = 1000
TRUNCATED = "...<truncated>"


def is_skip(type_: Column, value: Column) -> Column:
    """Whether links into an object are ignored: modules, types and the functions of some libraries.

    ``\\z`` is the very end: a trailing line break does not count as one.  Null values: false.
    """
    function = (type_ == "builtins.function") & value.rlike(SKIP_FUNCTION_VALUE)
    return F.coalesce(type_.rlike(SKIP_TYPE), F.lit(False)) | F.coalesce(function, F.lit(False))


def truncate_value(text: Column) -> Column:
    """Texts of over 1000 characters are cut and marked."""
    return F.when(F.length(text) > MAX_VALUE, F.concat(F.substring(text, 1, MAX_VALUE), F.lit(TRUNCATED))).otherwise(text)


def type_name(module: Column, qualname: Column) -> Column:
    return F.concat_ws(".", module, qualname)


def module_value(name: Column) -> Column:
    return F.concat(F.lit("module "), name)


@F.pandas_udf(T.StringType())
def bytes_value(data: pd.Series) -> pd.Series:
    """Bytes as Python writes them, cut after 1000 of them."""
    return data.map(lambda b: None if b is None else repr(bytes(b[:1000])) + ("...<truncated>" if len(b) > 1000 else ""))
