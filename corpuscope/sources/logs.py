"""Reading and writing query logs, features and reports."""

from __future__ import annotations

import datetime
import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope import schemas

#: A longer line ends a scan with an error.
MAX_LINE = 1 << 20

# Slow queries that every log gets, whatever else it has.
_SLOW = ["[]", '[word=".*"]', '[word=".+"]', '[lemma=".*"]', '[lemma=".+"]', '[lc=".*"]', '[lc=".+"]', '[tag="N.*"]', '[tag="N.+"]', '[pos="N"]']
OBLIGATORY = [("syn_v13", 6_400_899_055, 0, 500.0, f"aword,{q}", False, False) for q in _SLOW]


def zeros(log: DataFrame) -> DataFrame:
    """A log without nulls: missing values become the zero value of their type."""
    zero = {"string": F.lit(""), "bigint": F.lit(0).cast("long"), "double": F.lit(0.0), "boolean": F.lit(False)}
    kinds = dict(f.split() for f in schemas.QUERY_LOG.split(", "))
    kinds = {n: {"long": "bigint"}.get(k, k) for n, k in kinds.items()}
    return log.withColumns({n: F.coalesce(F.col(n).cast(k), zero[k]) for n, k in kinds.items()})


def obligatory(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(OBLIGATORY, schemas.QUERY_LOG)


def log_rows(lines: DataFrame) -> DataFrame:
    """Rows of a log from its lines (value), for tables and streams: blank and malformed lines go, too long a line is an error. Other columns stay."""
    keep = [c for c in lines.columns if c != "value"]
    value = F.when(F.octet_length("value") > MAX_LINE, F.raise_error(F.lit("a line of the log is too long")).cast("string")).otherwise(F.col("value"))
    lines = lines.select(*keep, value.alias("value")).where(F.trim("value") != "")
    parsed = F.from_json("value", f"{schemas.QUERY_LOG}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.select(*keep, parsed.alias("r")).where("r IS NOT NULL AND r._bad IS NULL").select(*keep, "r.*").drop("_bad")


def read_query_log(spark: SparkSession, path: str, with_obligatory: bool = True) -> DataFrame:
    """A JSONL log, with line_no in the order of the lines. Blank and malformed lines are passed over; the obligatory examples stand at the end."""
    rows = log_rows(spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id()))
    if with_obligatory:
        last = F.lit(1 << 62) + F.monotonically_increasing_id()
        rows = rows.unionByName(obligatory(spark).withColumn("line_no", last))
    return zeros(rows)


def write_json_lines(log: DataFrame, path: str) -> None:
    """The log's own fields as JSONL; flags that are false are left out."""
    names = [f.split()[0] for f in schemas.QUERY_LOG.split(", ")]
    flags = {n: F.when(F.col(n), F.lit(True)) for n in ("isSynthetic", "flaggedAsSlow")}
    log.select(*names).withColumns(flags).write.option("ignoreNullFields", "true").json(path)


def write_features(rows: DataFrame, stats: DataFrame, path: str) -> None:
    """Feature rows, and beside them the one row of counters."""
    rows.write.parquet(f"{path}/features")
    stats.write.parquet(f"{path}/stats")


def read_features(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/features"), spark.read.parquet(f"{path}/stats")


def write_matrix(labelled: DataFrame, path: str) -> None:
    """features and label, for training elsewhere."""
    labelled.select("features", "label").write.parquet(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("features", "label")


def read_metadata(spark: SparkSession, model_path: str) -> DataFrame | None:
    """Training parameters beside a boosted-tree model file; None if there are none."""
    base = model_path.removesuffix(".gz")
    path = base[: base.rindex(".")] + ".metadata.json" if "." in base.rsplit("/", 1)[-1] else base + ".metadata.json"
    try:
        return spark.read.schema(schemas.METADATA).option("multiLine", "true").json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def write_sweep(sweep: DataFrame, path: str) -> None:
    """threshold sweep as `vote;precision;recall;f-beta`, two digits each."""
    two = lambda c: F.format_string("%.2f", c)
    sweep.orderBy("threshold").select(two("threshold").alias("vote"), two("precision").alias("precision"), two("recall").alias("recall"), two("f_beta").alias("f-beta")).coalesce(1).write.option("header", "true").csv(path, sep=";")


def write_misclassified(report: DataFrame, path: str) -> None:
    line = F.format_string("%.0f\t%.2f\t%.2f\t%s(%d)\t%s", F.exp("corpusSize"), "procTime", "ml_output", "type", "num_repeat", "q")
    report.select(line.alias("value")).write.text(path)


def save_params(params: list[float], path: str) -> None:
    from corpuscope.functions.columns import PARAM_NAMES

    Path(path).write_text(json.dumps(dict(zip(PARAM_NAMES, params, strict=True)), indent=2))


def load_params(path: str) -> list[float]:
    from corpuscope.functions.columns import PARAM_NAMES

    held = json.loads(Path(path).read_text())
    return [float(held.get(n, 0.0)) for n in PARAM_NAMES]


@dataclass
class Config:
    """Settings from a JSON file, with defaults."""

    listen_address: str = "127.0.0.1"
    listen_port: int = 8080
    time_zone: str = ""
    synthetic_time_correction: float = 1.0
    models: list = field(default_factory=list)
    corpora: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Config:
        held = json.loads(Path(path).read_text())
        out = cls(held.get("listenAddress") or "127.0.0.1", held.get("listenPort") or 8080, held.get("timeZone") or "", held.get("syntheticTimeCorrection") or 1.0, held.get("rfEnsemble") or held.get("ensemble") or [], held.get("corporaProps") or {})
        return out

    def corpora_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(name, p.get("size", 0), p.get("lang", ""), p.get("altCorpus", "")) for name, p in sorted(self.corpora.items())]
        return spark.createDataFrame(rows, schemas.CORPORA)


def read_registry(spark: SparkSession, folder: str) -> DataFrame:
    """corpus and attributes of registry files: the names after ATTRIBUTE, in order."""
    files = spark.read.format("binaryFile").load(folder)
    names = F.regexp_extract_all(F.decode("content", "UTF-8"), F.lit(r"(?m)^[ \t]*ATTRIBUTE[ \t]+\"?([A-Za-z0-9@_]+)"), F.lit(1))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("corpus"), names.alias("attributes"))


def list_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """name and time of saved prompt files, newest first."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "modificationTime").orderBy(F.desc("modificationTime"), "name")


def save_prompt(folder: str, content: str, name: str = "", date: str | None = None) -> str:
    """Saves a prompt under its dated name and returns that; an empty one is an error. A folder beside the driver, as prompts are small texts."""
    if not content:
        raise ValueError("a prompt can't be empty")
    held = prompt_name(name, date or datetime.date.today().isoformat())
    (Path(folder) / held).write_text(content)
    return held


def load_prompt(folder: str, name: str = "sysprompt.txt") -> str:
    """A saved prompt, or the default one."""
    return (Path(folder) / name).read_text()


def prompt_name(name: str, date: str) -> str:
    """The file name under which a prompt is saved on a date (yyyy-mm-dd)."""
    return f"{name or 'update'}.{date}.txt"


def read_installed(spark: SparkSession, fetch) -> DataFrame:
    """The corpora that a server has installed. fetch() returns their names."""
    return spark.createDataFrame([(c,) for c in fetch()], "corpus string").distinct()
