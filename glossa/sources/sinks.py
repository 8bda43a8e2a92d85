"""Sinks: tables with an identity, reports and records. Spark's committer makes each write all or nothing."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FORMATS = ("parquet", "json")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", files: int = 0, overwrite: bool = False) -> None:
    """Part files with the columns of df, also if it is empty; an existing result is an error unless told."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}; known are {', '.join(FORMATS)}")
    out = df.coalesce(files) if files else df
    out.write.mode("overwrite" if overwrite else "errorifexists").format(fmt).save(path)


def fingerprint(**identity: object) -> str:
    """A digest of what a run depends on; two runs with the same one may share results."""
    return hashlib.sha256(json.dumps(identity, sort_keys=True, default=str).encode()).hexdigest()


def check_identity(stored: dict, **identity: object) -> None:
    """Refuse to resume a run whose identity differs, naming what does."""
    wrong = sorted(k for k, v in identity.items() if stored.get(k) != v)
    if wrong:
        raise ValueError(f"the stored run differs in {', '.join(wrong)}")


def write_tsv(df: DataFrame, path: str, first: list[str]) -> None:
    """Tab-separated files with a header, the listed columns first."""
    rest = [c for c in df.columns if c not in first]
    df.select(*[c for c in first if c in df.columns], *rest).write.option("sep", "\t").option("header", "true").csv(path)


def report_lines(metrics: DataFrame, section: str, name: str, value: str) -> DataFrame:
    """(section, report): "name: value" lines under a heading, values with two decimals, in the order of names."""
    line = F.concat(F.col(name), F.lit(": "), F.format_string("%.2f", F.col(value)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(name).alias("k"), line.alias("l")))), lambda s: s["l"]), "\n")
    return metrics.groupBy(section).agg(F.concat(F.lit("### "), F.first(section), F.lit("\n"), body).alias("report"))


def parsed_report(lines: DataFrame) -> DataFrame:
    """(section, name, value) from report lines (report, line_no, value): the inverse of report_lines."""
    order = Window.partitionBy("report").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("value").startswith("### "), F.substring("value", 5, 1000))
    rows = lines.withColumn("section", F.last(head, True).over(order)).filter(F.col("value").rlike(r"^[^#].*: -?[0-9.]+$"))
    return rows.select("section", F.regexp_extract("value", r"^(.*): ", 1).alias("name"), F.regexp_extract("value", r": (-?[0-9.]+)$", 1).cast("double").alias("value"))


def flat_record(metrics: DataFrame, name: str, value: str) -> DataFrame:
    """One JSON object of all metrics, names sorted, slashes in names as underscores."""
    entry = F.struct(F.replace(F.col(name), F.lit("/"), F.lit("_")).alias("key"), F.col(value).alias("value"))
    return metrics.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("record"))


def numbered_uid(prefix: str, index: Column) -> Column:
    """prefix_000000 and so on."""
    return F.format_string(f"{prefix}_%06d", index)


def refuse(violations: DataFrame, message: str) -> None:
    """Raise if a table of violations has a row."""
    first = violations.take(1)
    if first:
        raise ValueError(f"{message}: {first[0].asDict()}")


def token_ids(texts: DataFrame, key: str, key_type: str, tokenizer: Callable[[], Callable[[list[str]], list[list[int]]]], text: str = "text") -> DataFrame:
    """(key, ids): sub-word ids of the stripped texts by a plug-in, loaded once per Python worker.

    tokenizer() gives a function from texts to lists of ids. write_table() keeps the result.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer()
        for b in batches:
            ids = encode([(t or "").strip() for t in b[text].to_pylist()])
            yield pa.record_batch([b[key], pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return texts.select(key, text).mapInArrow(run, f"{key} {key_type}, ids array<int>")


def utf8_tokenizer() -> Callable[[list[str]], list[list[int]]]:
    """The tokenizer whose ids are bytes."""
    return lambda texts: [list(t.encode()) for t in texts]
