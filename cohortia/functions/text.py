"""Text columns made safe for display and grouping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "Unknown"

# Completion codes and the spellings of "true".
COMPLETION_LABELS = {1: "Continuing", 2: "Completed", 3: "Withdrawn", 6: "Break in learning"}
TRUE_WORDS = ("TRUE", "1", "Y", "YES")

SHORT_LABEL_LIMIT = 25
SHORT_LABEL_KEEP = 22


def filled(text: Column) -> Column:
    """Trimmed text, NULL when blank."""
    return F.nullif(F.trim(text), F.lit(""))


def known(*choices: Column) -> Column:
    """First choice that is not blank, else ``Unknown``."""
    return F.coalesce(*[filled(choice) for choice in choices], F.lit(UNKNOWN))


def course_label(title: Column, programme: Column, reference: Column, aim_reference: Column) -> Column:
    """``title (reference)`` when both are there, else the first part that is."""
    code = F.coalesce(filled(reference), filled(aim_reference))
    named = F.concat(filled(title), F.lit(" ("), code, F.lit(")"))
    return F.coalesce(named, filled(title), filled(programme), code, F.lit(UNKNOWN))


def completion_label(status: Column, code: Column) -> Column:
    decoded = F.lit(UNKNOWN)
    for number, label in COMPLETION_LABELS.items():
        decoded = F.when(code == number, label).otherwise(decoded)
    return F.coalesce(filled(status), decoded)


def infill_flag(flag: Column) -> Column:
    spelled = F.upper(F.coalesce(flag.cast("string"), F.lit("FALSE")))
    return F.when(spelled.isin(*TRUE_WORDS), "Y").otherwise("N")


def site_label(identifier: Column, campus_id: Column) -> Column:
    return F.coalesce(filled(identifier.cast("string")), campus_id.cast("string"), F.lit(UNKNOWN))


def short_label(text: Column) -> Column:
    cut = F.concat(F.substring(text, 1, SHORT_LABEL_KEEP), F.lit("..."))
    return F.when(F.length(text) > SHORT_LABEL_LIMIT, cut).otherwise(text)
