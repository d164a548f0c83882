"""Names, keys and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from petridish.functions.numeric import col, compute_once, finite

# Words read as a positive or negative label.
POSITIVE_WORDS = ("true", "yes", "y", "positive", "pos")
NEGATIVE_WORDS = ("", "false", "no", "n", "negative", "neg")

# Fixed value: passage notation such as "P6", "passage-12" or "p 3".
PASSAGE_PATTERN = r"(?i)\bP(?:assage)?[-_ ]?(\d{1,2})\b"

# Fixed value: study image names, e.g. "IFN-r 25ng_TNF-a 50ng-DAPI-100X-12".
STUDY_IMAGE_PATTERN = (
    r"(?i)^IFN-r\s*(\d+(?:\.\d+)?)\s*ng(?:_TNF-a\s*(\d+(?:\.\d+)?)\s*ng)?"
    r"-(phase|DAPI|IDO)-100X-(\d+)$"
)

# Short names of feature groups in combination labels.
SHORT_GROUP_NAMES = {
    "Intensity distribution": "Intensity",
    "Attachment / spreading": "Attachment",
    "Halo / rounding": "Halo",
    "Local crowding": "Crowding",
    "Mitosis likelihood": "Mitosis",
    "Nuclear morphology": "Nuclear",
    "Debris / culture health": "Debris",
    "Colony / FOV context": "FOV",
}


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def file_stem(path: Column | str) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def file_extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r".(\.[^.]*)$", 1))


def natural_sort_key(text: Column | str) -> Column:
    """Sort key that compares digit runs as numbers."""
    chunks = F.regexp_extract_all(col(text), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(
        F.transform(
            chunks,
            lambda c: F.when(
                c.rlike(r"^\d+$"),
                F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(20) - F.length(c), F.lit(0))), c),
            ).otherwise(c),
        ),
        "",
    )


def last_number(text: Column | str) -> Column:
    """Last run of digits as a number, NULL without one."""
    runs = F.regexp_extract_all(col(text), F.lit(r"(\d+)"), 1)
    return F.when(F.size(runs) > 0, F.element_at(runs, -1).try_cast("bigint"))


def passage_of(text: Column | str) -> Column:
    """``P<n>`` of the last passage mark in a text, ``P_UNKNOWN`` without one."""
    marks = F.regexp_extract_all(col(text), F.lit(PASSAGE_PATTERN), 1)
    return F.when(
        F.size(marks) > 0, F.concat(F.lit("P"), F.element_at(marks, -1).cast("int").cast("string"))
    ).otherwise("P_UNKNOWN")


def image_key(folder: Column | str, image: Column | str) -> Column:
    return F.concat_ws("::", col(folder), col(image))


def dose_text(dose: Column | str) -> Column:
    """Shortest decimal form: 25.0 -> 25, 12.5 -> 12.5."""
    dose = col(dose)
    return F.when(dose == F.floor(dose), F.floor(dose).cast("string")).otherwise(
        dose.cast("string")
    )


def with_study_fields(df: DataFrame, stem: Column) -> DataFrame:
    """Add doses, channel, index, key and condition of a study image name; NULL if no match."""
    packed = F.regexp_replace("_stem", STUDY_IMAGE_PATTERN, "$1|$2|$3|$4")
    fields = F.when(F.col("_stem").rlike(STUDY_IMAGE_PATTERN), F.split(packed, r"\|"))
    df = compute_once(compute_once(df, _stem=stem), _f=fields)
    df = (
        df
        .withColumn("ifn_dose", F.col("_f")[0].cast("double"))
        .withColumn(
            "tnf_dose",
            F.when(F.col("_f").isNotNull(), F.coalesce(F.col("_f")[1].try_cast("double"), F.lit(0.0))),
        )
        .withColumn("channel", F.lower(F.col("_f")[2]))
        .withColumn("image_index", F.col("_f")[3].cast("int"))
        .withColumn(
            "condition",
            F.concat(F.lit("IFN"), dose_text("ifn_dose"), F.lit("_TNF"), dose_text("tnf_dose")),
        )
    )
    zero = F.when(F.col("image_index") < 10, "0").otherwise("")
    key = F.concat("condition", F.lit("_FOV"), zero, F.col("image_index").cast("string"))
    return compute_once(df, image_key=key).drop("_stem", "_f")


def cell_image_stem(cell_id: Column | str) -> Column:
    """``<stem>`` of ``<stem>_<n>``, NULL when the last part is no number."""
    c = F.trim(col(cell_id))
    return F.when(c.rlike(r"^.+_\d+$"), F.regexp_extract(c, r"^(.+)_\d+$", 1))


def cell_index(cell_id: Column | str) -> Column:
    """0-based index of ``<stem>_<n>``, NULL unless n >= 1."""
    n = F.regexp_extract(F.trim(col(cell_id)), r"_([+-]?\d+)$", 1).try_cast("bigint")
    return F.when(n >= 1, n - 1)


def ring_cell_id(label: Column | str) -> Column:
    """``<image>_<n>`` of a ring label ``<image>:NewCell-<n>-and<ring>``."""
    label = col(label)
    image = F.element_at(F.split(label, ":"), 1)
    tail = F.try_element_at(F.split(label, ":"), F.lit(2))
    return F.concat(image, F.lit("_"), F.try_element_at(F.split(tail, "-"), F.lit(2)))


def ring_number(label: Column | str) -> Column:
    return F.regexp_extract(col(label), r"-and(\d+)", 1).try_cast("int")


def is_positive(value: Column | str) -> Column:
    """Words or numbers to a boolean; unreadable text is negative."""
    text = F.lower(F.trim(col(value).cast("string")))
    return (
        F.when(text.isin(*POSITIVE_WORDS), True)
        .when(text.isin(*NEGATIVE_WORDS), False)
        .otherwise(F.coalesce(text.try_cast("double") > 0, F.lit(False)))
    )


def score_name(group: str) -> str:
    """Column name of a feature group's evidence score."""
    text = group.lower().replace(" / ", "_").replace(" + ", "_")
    return text.replace(" ", "_").replace("-", "_") + "_ki67_evidence"


def score_name_expr(group: Column | str) -> Column:
    text = F.regexp_replace(F.lower(col(group)), r" [/+] ", "_")
    return F.concat(F.regexp_replace(text, r"[ -]", "_"), F.lit("_ki67_evidence"))


def combo_label(groups) -> str:
    return " + ".join(SHORT_GROUP_NAMES.get(g, g) for g in groups)


def path_component(value: Column | str) -> Column:
    """A name usable as a folder or file name."""
    text = F.regexp_replace(col(value).cast("string"), r'[<>:"/\\|?*]+', "_")
    text = F.regexp_replace(text, r"^[ .]+|[ .]+$", "")
    return F.when(text == "", "prediction").otherwise(text)


def percent_text(value: Column | str) -> Column:
    return F.when(finite(value).isNull(), "-").otherwise(
        F.format_string("%.2f%%", finite(value) * 100.0)
    )


def points_text(value: Column | str) -> Column:
    return F.when(finite(value).isNull(), "-").otherwise(
        F.format_string("%.2f pp", finite(value) * 100.0)
    )
