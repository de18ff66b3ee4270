"""Sources and sinks: raw text, the model catalog, prompt files, JSON."""

from __future__ import annotations

import os
import tomllib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row per UTF-8 file, CRLF as line feeds."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return raw.withColumn("text", F.regexp_replace("text", "\r\n", "\n"))


MODEL = {"id": None, "display_name": None, "provider": None, "model": None, "base_url": "", "api_key_env": "", "host": "", "tier": "", "enabled": True, "notes": ""}
MODEL_SCHEMA = "input_pos int, " + ", ".join(f"{k} {'boolean' if k == 'enabled' else 'string'}" for k in MODEL)


def model_rows(text: str) -> list[dict]:
    """Models of a TOML catalog; unknown keys, missing keys and repeated ids are errors."""
    rows, seen = [], set()
    for n, entry in enumerate(tomllib.loads(text).get("model", [])):
        if unknown := set(entry) - set(MODEL):
            raise ValueError(f"unknown keys: {sorted(unknown)}")
        row = {"input_pos": n} | MODEL | entry
        if lacking := [k for k, v in row.items() if v is None]:
            raise ValueError(f"missing keys: {lacking}")
        if row["id"] in seen:
            raise ValueError(f"repeated id: {row['id']}")
        seen.add(row["id"])
        rows.append(row)
    return rows


def read_models(spark: SparkSession, path: str) -> DataFrame:
    with open(path, encoding="utf-8") as f:  # driver-side configuration
        return spark.createDataFrame(model_rows(f.read()), MODEL_SCHEMA)


def available(models: DataFrame, have: list[str]) -> DataFrame:
    """Enabled models that need no key or whose key's name is in ``have``."""
    return models.filter("enabled").filter((F.col("api_key_env") == "") | F.col("api_key_env").isin(have))


def model(models: DataFrame, model_id: str) -> dict:
    """The one model of that id."""
    found = models.filter(F.col("id") == model_id).collect()  # ids are unique
    if not found:
        raise KeyError(f"no model with id {model_id!r}")
    return found[0].asDict()


def model_ids(models: DataFrame) -> DataFrame:
    """Ids in the order of the catalog."""
    return models.orderBy("input_pos").select("id")


PROMPT_NAME = r"([^/]+)\.v(\d+)\.(?:md|txt)$"


def prompt_table(files: DataFrame, root: str = "") -> DataFrame:
    """(id, version, text, checksum, path) of files named <name>.v<N>.md or .txt; id is the path below ``root``."""
    rows = files.filter(F.col("path").rlike(PROMPT_NAME))
    below = F.regexp_replace(F.col("path"), f"^.*?{root.strip('/')}/" if root else "^.*/", "")
    return rows.select(F.regexp_replace(below, r"\.v\d+\.(?:md|txt)$", "").alias("id"), F.regexp_extract("path", PROMPT_NAME, 2).cast("int").alias("version"), "text", F.sha2("text", 256).alias("checksum"), "path")


def read_prompts(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True)
    return prompt_table(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")), os.path.basename(root.rstrip("/")))


def latest(prompts: DataFrame) -> DataFrame:
    """The highest version of each id."""
    order = Window.partitionBy("id").orderBy(F.desc("version"))
    return prompts.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def prompt(prompts: DataFrame, prompt_id: str, version: int | None = None) -> DataFrame:
    """The one row of that id and version, the highest if none is given; an error if there is none."""
    rows = prompts.filter(F.col("id") == prompt_id)
    rows = latest(rows) if version is None else rows.filter(F.col("version") == version)
    if not rows.limit(1).count():
        raise KeyError(f"no prompt {prompt_id!r}" + (f" of version {version}" if version is not None else ""))
    return rows


def prompt_ids(prompts: DataFrame) -> DataFrame:
    return prompts.select("id").distinct().orderBy("id")


def compose(prompts: DataFrame, intensity: str, style: str, discipline: str | None = None) -> tuple[str, list[str]]:
    """The system prompt of a rewrite, and the refs of its parts: base, intensity, style, and an example of the field."""
    ids = ["system/rewrite", f"system/intensity/{intensity}", f"system/style/{style}"] + ([f"fewshot/{discipline}"] if discipline else [])
    rows = latest(prompts.filter(F.col("id").isin(ids))).select("id", "text", prompt_ref().alias("ref")).collect()  # four at most
    part = {r["id"]: r for r in rows}
    if lacking := [i for i in ids if i not in part]:
        raise KeyError(f"no prompt {lacking[0]!r}")
    base, level, look, *example = [part[i]["text"] for i in ids]
    text = base.replace("{{INTENSITY}}", level.strip()).replace("{{STYLE}}", look.strip())
    for e in example:
        text = f"{text.rstrip()}{L.EXAMPLE_HEAD}{e.strip()}\n"
    if "{{" in text or "}}" in text:
        raise ValueError("unfilled slot in prompt")
    return text, [part[i]["ref"] for i in ids]


def prompt_ref() -> Column:
    """id@vN:checksum, its first eight characters."""
    return F.format_string("%s@v%d:%s", "id", "version", F.substring("checksum", 1, 8))


def fill(template: Column, slots: dict[str, Column], examples: Column | None = None) -> Column:
    """A template with its {{SLOT}}s filled and examples after it; an error if a slot is left."""
    out = template
    for name, value in slots.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), value)
    if examples is not None:
        out = F.concat_ws("\n\n", out, examples)
    return F.when(out.rlike(r"\{\{|\}\}"), F.raise_error(F.lit("unfilled slot in prompt"))).otherwise(out)


def load_env(path: str, override: bool = False) -> dict[str, str]:
    """KEY=VALUE lines of a file into the environment; what is set already wins unless ``override``."""
    got = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            key, eq, value = line.strip().partition("=")
            value = value.strip().strip("'\"")
            if not eq or key.startswith("#") or not value:
                continue
            if override or key.strip() not in os.environ:
                os.environ[key.strip()] = got[key.strip()] = value
    return got


def as_json(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys and one JSON string of all other columns."""
    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.to_json(F.struct(*rest)).alias("json"))
