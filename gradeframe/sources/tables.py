"""Item, result, summary and report tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from gradeframe import fixed_values as fv
from gradeframe.functions.labels import labels_from_wide, wide_label_names
from gradeframe.sources.csv_records import read_records
from gradeframe.spec import EvalSpec, column

_CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_table(
    spark: SparkSession, path: str, fmt: str = "parquet",
    schema: StructType | str | None = None, multi_line: bool = True, types: Mapping[str, str] | None = None,
    split: bool = True,
) -> DataFrame:
    """Read parquet or CSV.

    CSV columns are text unless a schema is given or ``types`` names others
    ({"grp": "int"}; text that is no such value is an error): no inference
    pass over the data, and ids keep the text they have. Every file's header
    must name the columns in the same order, and a row with more fields than
    there are columns is an error; short rows end in NULL. Fields that span lines
    need ``multi_line``. Files are read in as many tasks as they have splits
    all the same (see ``csv_records``), at the price of a first pass that finds where
    records begin; with ``split=False`` there is one pass and one task per
    file. Without ``multi_line`` there is one pass and a task per split.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    if fmt != "csv":
        return reader.format(fmt).load(path)
    options = {**_CSV, "multiLine": multi_line}
    if schema is None:
        schema = spark.read.options(**options).csv(path).schema
    elif isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    # Headers are held against the names by Spark; what is too much ends up in the broken record.
    broken = next(n for n in ("_gf_broken", "_gf_broken_") if n not in schema.names)
    wide = StructType([*schema.fields, StructField(broken, StringType())])
    if multi_line and split:
        rows = _parsed_records(spark, path, schema, wide, broken)
    else:
        rows = spark.read.schema(wide).options(**options, enforceSchema=False, columnNameOfCorruptRecord=broken).csv(path)
    last = column(schema.names[-1])
    # A short row is broken too, but its last column is NULL.
    message = F.concat(F.lit("CSV row with too many fields or a value of another type: "), column(broken))
    checked = F.when(column(broken).isNotNull() & last.isNotNull(), F.raise_error(message)).otherwise(last)
    rows = rows.withColumn(schema.names[-1], checked.cast(schema.fields[-1].dataType)).drop(broken)
    return rows.withColumns({name: column(name).cast(kind) for name, kind in (types or {}).items()})


def _parsed_records(spark: SparkSession, path: str, schema: StructType, wide: StructType, broken: str) -> DataFrame:
    """The rows of CSV files out of their records, headers checked and left out."""
    options = {k: str(v).lower() if isinstance(v, bool) else v for k, v in _CSV.items() if k != "header"}
    options["columnNameOfCorruptRecord"] = broken
    records = read_records(spark, path)
    texts = ", ".join(f"`{name.replace('`', '``')}` string" for name in wide.names)
    header = F.from_csv(F.regexp_replace("record", "^\ufeff", ""), texts, options)
    exact = spark.conf.get("spark.sql.caseSensitive") == "true"
    given, named = header, [name if exact else name.lower() for name in schema.names]
    same = F.lit(True)
    for name, want in zip(schema.names, named):
        found = given.getField(name)
        same = same & F.coalesce((found if exact else F.lower(found)) == want, F.lit(False))
    is_header = (F.col("block") == 0) & (F.col("n") == 0)
    message = F.concat(F.lit("CSV header of "), F.col("file"), F.lit(" does not name the columns in their order: "), F.col("record"))
    as_it_should = same & header.getField(broken).isNull()
    rows = records.where(F.when(is_header, F.when(as_it_should, False).otherwise(F.raise_error(message).cast("boolean"))).otherwise(True))
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in wide.fields)
    return rows.select(F.from_csv("record", ddl, options).alias("row")).select("row.*")


def normalize_missing(
    df: DataFrame, cols: Sequence[str] | None = None, markers: Sequence[str] = fv.MISSING_MARKERS
) -> DataFrame:
    """Turn missing-value markers into NULL, by default in all text columns."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    chosen = text if cols is None else [c for c in cols if c in text]
    return df.withColumns({c: F.when(~column(c).isin(*markers), column(c)) for c in chosen})


def read_items(
    spark: SparkSession, path: str, fmt: str = "parquet",
    schema: StructType | str | None = None, multi_line: bool = True, types: Mapping[str, str] | None = None,
    split: bool = True,
) -> DataFrame:
    """The items to score. CSV missing markers become NULL."""
    if fmt != "csv":
        return read_table(spark, path, fmt, schema, multi_line)
    items = normalize_missing(read_table(spark, path, fmt, schema, multi_line, split=split))
    return items.withColumns({name: column(name).cast(kind) for name, kind in (types or {}).items()})


def read_results(
    spark: SparkSession, path: str, fmt: str = "parquet", max_sentences: int | None = None,
    schema: StructType | str | None = None, multi_line: bool = True, types: Mapping[str, str] | None = None,
) -> DataFrame:
    """Scored rows; wide label columns become one array."""
    return with_label_array(read_items(spark, path, fmt, schema, multi_line, types), max_sentences)


def with_label_array(results: DataFrame, max_sentences: int | None = None) -> DataFrame:
    """Wide label columns as one array, where there are some and no array."""
    if fv.LABELS not in results.columns and wide_label_names(results, max_sentences):
        results = labels_from_wide(results, max_sentences)
    return results


def existing_results(spark: SparkSession, path: str) -> DataFrame | None:
    """The results table at a path, or None when there is none yet."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return None
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        # The folder is there but no file has been committed.
        if error.getCondition() == "UNABLE_TO_INFER_SCHEMA":
            return None
        raise


def check_columns(df: DataFrame, path: str) -> DataFrame:
    """The rows with their columns in the order of the results at a path; a different set of columns is an error."""
    there = existing_results(df.sparkSession, path)
    if there is None:
        return df
    old = {f.name: f.dataType.simpleString() for f in there.schema.fields}
    new = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if old != new:
        changed = sorted(set(old.items()) ^ set(new.items()))
        raise ValueError(f"results at {path} have other columns: {changed}")
    return df.select(*[column(n) for n in there.columns])


def append_results(df: DataFrame, path: str) -> None:
    """Append rows by column name. ``parts.append_part`` is an append that can be retried."""
    check_columns(df, path).write.mode("append").parquet(path)


def preview(df: DataFrame, k: int, order_by: str | None = None) -> DataFrame:
    """The first k rows, by a column if given (a top-k, not a full sort)."""
    return (df.orderBy(column(order_by)) if order_by else df).limit(k)


def bind_roles(df: DataFrame, spec: EvalSpec) -> DataFrame:
    """Only the columns that have a role, under the names of their roles."""
    roles = {
        "id": spec.id_col, "sentences": spec.sentences_col, "options": spec.options_col,
        "group": spec.group_col, "gold": spec.gold_col,
    }
    return df.select(*[column(n).alias(role) for role, n in roles.items() if n])


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write parquet, or CSV with a header that ``read_table`` reads back."""
    if fmt == "csv":
        flags = [f.name for f in df.schema.fields if isinstance(f.dataType, BooleanType)]
        df = df.withColumns({n: F.initcap(column(n).cast("string")) for n in flags})
        df.write.mode(mode).options(**_CSV).csv(path)
    else:
        df.write.mode(mode).format(fmt).save(path)


def write_summary(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write the per-row summary in place of an earlier one."""
    write_table(df, path, fmt)


def write_report(lines: DataFrame, path: str) -> None:
    """Write report lines as text files that read in order.

    The sort is distributed and part files follow its order, so a report over
    very many groups is not funnelled through one task; a small one comes out
    as one file.
    """
    lines.orderBy(*[n for n in lines.columns if n != "text"]).select("text").write.mode("overwrite").text(path)


def scratch_root(spark: SparkSession) -> str:
    """The folder the cluster shares for checkpoints; where none is set, one below the warehouse, which is shared as well."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return (shared or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch").rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared scratch folder.

    It is removed when the driver ends, or before that by a job that knows it
    is done with it.
    """
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a folder that scratch_path named."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def staged(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    What is read has a known size, so Spark's broadcast decision rests on it,
    and a join with it shuffles straight from the scan, which is the form in
    which adaptive execution can split a hot key of the other side. A caller
    that stages again and again gives a ``path``, which is written over.
    """
    path = path or scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
