"""Artifacts: reports rendered from retrieved documents, their files, and the jobs that make them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LISTED = 20
PROFILES = 100


def document_list(hits: DataFrame, most: int = LISTED) -> DataFrame:
    """hits (query_id, rank, source_path, page_title): (query_id, content), a line for each distinct path among the first ``most`` hits, in order, by its title, else its file name."""
    first = hits.where(F.col("rank") <= most).groupBy("query_id", "source_path").agg(F.min("rank").alias("rank"), F.min_by("page_title", "rank").alias("title"))
    name = F.coalesce(F.nullif("title", F.lit("")), F.regexp_extract("source_path", r"([^/]*)$", 1))
    line = F.concat(F.lit("- "), name, F.lit(" ("), F.col("source_path"), F.lit(")"))
    rows = first.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("s"))
    return rows.select("query_id", F.array_join(F.transform("s", lambda x: x["line"]), "\n").alias("content"))


def markdown(title: Column, content: Column) -> Column:
    return F.concat(F.lit("# "), F.coalesce(title, F.lit("Artifact")), F.lit("\n\n"), F.coalesce(content, F.lit("No content available.")), F.lit("\n"))


class Artifacts:
    """Files of artifacts by id below a folder of any file system that Spark reaches."""

    def __init__(self, spark, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def store(self, artifact_id: str, text: DataFrame) -> str:
        """text: one row with the column content, written as a text file of the artifact, in place of what there was."""
        folder = f"{self.path}/{artifact_id}"
        text.select(F.regexp_replace("content", r"\n\z", "").alias("content")).coalesce(1).write.mode("overwrite").text(folder)  # the writer ends a row by a line end
        return folder

    def get(self, artifact_id: str) -> str | None:
        fs, path = self._fs()
        if not fs.exists(path(f"{self.path}/{artifact_id}")):
            return None
        return "".join(r.value for r in self.spark.read.text(f"{self.path}/{artifact_id}", wholetext=True).collect())  # one artifact

    def delete(self, artifact_id: str) -> bool:
        fs, path = self._fs()
        return fs.delete(path(f"{self.path}/{artifact_id}"), True)


def artifact_jobs(artifacts: DataFrame, jobs: DataFrame) -> DataFrame:
    """artifacts (artifact_id) with the status of the first job whose source is artifact:<id>; null without one."""
    made = jobs.where(F.startswith("source", F.lit("artifact:"))).select(F.substring("source", 10, 1 << 30).alias("artifact_id"), "job_id", "status")
    first = made.groupBy("artifact_id").agg(F.min(F.struct("job_id", "status")).alias("j")).select("artifact_id", "j.job_id", "j.status")
    return artifacts.join(first, "artifact_id", "left")


def latest_profiles(profiles: DataFrame, most: int = PROFILES) -> DataFrame:
    """The last ``most`` requests, newest first."""
    return profiles.orderBy(F.desc("timestamp"), F.desc("request_id")).limit(most)


def cancel_points(rows: DataFrame, jobs: DataFrame) -> DataFrame:
    """Rows of jobs (job_id) that go on: those of cancelled or cancelling jobs are left out at the next checkpoint of a pipeline."""
    return rows.join(jobs.where(F.col("status").isin("CANCELLING", "CANCELLED")).select("job_id"), "job_id", "left_anti")


def newest(profiles: DataFrame, key: str) -> DataFrame:
    """The newest profile of each value of a key."""
    order = Window.partitionBy(key).orderBy(F.desc("timestamp"), F.desc("request_id"))
    return profiles.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
