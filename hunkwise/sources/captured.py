"""Captured answers and files: explicit schemas, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE = "struct<old_path:string,new_path:string,diff:string>"
USER = "struct<id:bigint,username:string,name:string,web_url:string>"
MERGE_REQUEST = f"id bigint, iid bigint, title string, description string, author {USER}, created_at string, source_branch string, target_branch string, web_url string, diffs array<{FILE}>"
VERSION = "base_commit_sha string, start_commit_sha string, head_commit_sha string"
REVIEWER = "struct<accountId:string,displayName:string,emailAddress:string,active:boolean>"
TASK = f"key string, fields struct<summary:string,description:string,status:struct<name:string>,customfield_10040:string,customfield_10039:array<{REVIEWER}>,customfield_10041:struct<value:string>>"
DISCUSSION = "id string, individual_note boolean, notes array<struct<id:bigint,body:string,web_url:string,noteable_iid:bigint>>"
REQUEST = "jira_issue_key string, mr_iid int"


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def parsed(df: DataFrame, column: str, schema: str) -> DataFrame:
    """JSON texts as columns of a schema. A missing and a null field are both null."""
    return df.select(*[c for c in df.columns if c != column], F.from_json(column, schema).alias("__v")).select("*", "__v.*").drop("__v")


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of text files, each a row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(name, length) of the files of one folder, empty ones too, on any file system; none is read. The driver lists, as for any read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    return spark.createDataFrame([(f.getPath().getName(), f.getLen()) for f in found if f.isFile()], "name string, length bigint")
