"""Layout labels: names, recognition tasks, prompts, gates and the label sets of the steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Label sets, tasks and prompts.
IMAGE_LABELS = ["image", "header_image", "footer_image"]
LARGE_LABELS = ["chart", "formula", "display_formula", "doc_title", "inline_formula", "paragraph_title"]
OVERLAP_EXEMPT = ["image", "table", "seal", "chart"]
MARKDOWN_IGNORED = ["number", "footnote", "header", "header_image", "footer", "footer_image", "aside_text"]
TASKS = {"table": "table", "formula": "formula", "display_formula": "formula", "inline_formula": "formula", "chart": "chart", "seal": "seal"}
PROMPTS = {"ocr": "OCR:", "table": "Table Recognition:", "formula": "Formula Recognition:", "chart": "Chart Recognition:", "seal": "Seal Recognition:", "spotting": "Spotting:"}


def named(df: DataFrame, label_dim: DataFrame, id_col: str = "label_id") -> DataFrame:
    """``df`` with label; ids that the dimension lacks, and null ids, are 'unknown'."""
    dim = label_dim.select(F.col("label_id").alias("__label_id"), "label").dropDuplicates(["__label_id"])
    out = df.join(F.broadcast(dim), F.col(id_col) == F.col("__label_id"), "left").drop("__label_id")  # a closed list of classes
    return out.withColumn("label", F.coalesce("label", F.lit("unknown")))


def parse_id2label(config: Column) -> Column:
    """Array of (label_id, label) of a JSON object; keys that aren't whole numbers and null values are skipped."""
    pairs = F.map_entries(F.from_json(config, "map<string,string>"))
    typed = F.transform(pairs, lambda p: F.struct(p["key"].try_cast("int").alias("label_id"), p["value"].alias("label")))
    return F.filter(typed, lambda p: p["label_id"].isNotNull() & p["label"].isNotNull())


def choice(key: Column, table: dict[str, str], default: str) -> Column:
    out = F
    for k, v in table.items():
        out = out.when(key == k, v)
    return out.otherwise(default)


def task(label: Column) -> Column:
    return choice(label, TASKS, "ocr")


def prompt(label: Column) -> Column:
    return choice(task(label), PROMPTS, PROMPTS["ocr"])


def gate(label: Column, use_chart: bool = False, use_seal: bool = False, use_image: bool = False) -> Column:
    """Whether a block of this label goes to recognition."""
    return F.when(label == "chart", F.lit(use_chart)).when(label == "seal", F.lit(use_seal)).when(label.isin(IMAGE_LABELS), F.lit(use_image)).otherwise(F.lit(True))


def merge_mode(label: Column) -> Column:
    return F.when(label.isin(LARGE_LABELS), "large").otherwise("union")


def non_merge_labels(use_chart: bool = False, use_seal: bool = False, use_image: bool = False) -> list[str]:
    """Labels whose blocks never join a text group."""
    return [*([] if use_image else IMAGE_LABELS), "table", *(["chart"] if use_chart else []), *(["seal"] if use_seal else [])]


def angle(label: Column) -> Column:
    return F.coalesce(label.try_cast("int"), F.lit(0))
