"""String expression factories: O99-O105."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def id_store(id_col) -> Column:
    """Store part of '<store>_<yyyy-mm-dd>' = everything but the last 11 characters."""
    c = _c(id_col)
    return F.substring(c, F.lit(1), F.length(c) - 11)


def id_date(id_col) -> Column:
    """Last 10 characters as a date."""
    return F.to_date(F.substring(_c(id_col), -10, 10))


def id_build(store, date) -> Column:
    """O100: store + '_' + 'yyyy-MM-dd'."""
    return F.concat_ws("_", _c(store).cast("string"), F.date_format(_c(date), "yyyy-MM-dd"))


def positional_tokens(col, n: int = 10, sep: str = " ", replace: str | None = None) -> list[Column]:
    """O101: token i of the split string, '' when absent (after replacing `replace` by `sep`)."""
    c = _c(col)
    if replace is not None:
        c = F.replace(c, F.lit(replace), F.lit(sep))
    parts = F.split(c, sep)
    return [F.coalesce(F.try_element_at(parts, F.lit(i + 1)), F.lit("")) for i in range(n)]


def first_token(col, sep: str = " ") -> Column:
    """O102."""
    return F.split_part(_c(col), F.lit(sep), F.lit(1))


def location_key(lat, lon) -> Column:
    """O103: 'lat_lon' from the string forms; null when either part is null."""
    a, b = _c(lat), _c(lon)
    return F.when(a.isNull() | b.isNull(), F.lit(None)).otherwise(F.concat_ws("_", a.cast("string"), b.cast("string")))


def newline_to_tab(col) -> Column:
    """O104."""
    return F.replace(_c(col), F.lit("\n"), F.lit("\t"))


def strip_chars(col, chars: str = "\"'\t ") -> Column:
    """O104: strip the given characters from both ends."""
    return F.btrim(_c(col), F.lit(chars))


def base_name(path) -> Column:
    """O105: last path component."""
    return F.substring_index(_c(path), "/", -1)


def stem(path) -> Column:
    """O105: file name without extension (text before the first dot of the base name)."""
    return F.substring_index(base_name(path), ".", 1)
