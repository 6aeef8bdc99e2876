"""String and JSON expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PROMPT = "An image of a %s"


def parse_tsv_coords(packed: Column, lon_field: int = 11, lat_field: int = 12) -> tuple[Column, Column]:
    """(lon, lat) of a TAB-separated column by 0-based field; what is missing or no number is null."""
    fields = F.split(packed, "\t", -1)
    number = lambda k: F.get(fields, F.lit(k)).try_cast("double")
    return number(lon_field), number(lat_field)


def format_prompt(concept: Column, form: str = PROMPT) -> Column:
    return F.format_string(form, concept)


def neuron_label(name: Column) -> Column:
    """``Neuron n`` of the first digits of a name, less one; a name without digits as it is."""
    digits = F.regexp_extract(name, r"(\d+)", 1)
    return F.when(digits == "", name).otherwise(F.concat(F.lit("Neuron "), (digits.cast("bigint") - 1).cast("string")))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def is_tiff(path: Column) -> Column:
    return F.lower(path).rlike(r"\.tiff?$")


def crop_name(rank: Column, area: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.format_string("bbox_%03d_area%d_x%d_y%d_w%d_h%d.png", *(c.cast("int") for c in (rank, area, x, y, w, h)))


def format_metric(mean: Column, std: Column | None = None, decimals: int = 3) -> Column:
    """Fixed decimals, with ± the standard deviation where one is asked for."""
    f = f"%.{decimals}f"
    return F.format_string(f, mean) if std is None else F.format_string(f"{f} ± {f}", mean, std)
