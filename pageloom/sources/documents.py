"""S5-S9 as files: a batch writer that commits whole documents or nothing.

``lines.write.format("job_documents").option("path", folder).mode("append").save()`` writes rows (job_id,
line_no, line) as text: a folder per job, its files in the order of their names. Each task writes the lines of its own part
to a staging folder and reports file names; only when all tasks have succeeded are the files moved into
their jobs' folders, where their names tell the first line. A job of any size is many files and no task or driver
holds a document.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "job_documents"
NO_JOB = "__HIVE_DEFAULT_PARTITION__"  # fixed value: the folder that Spark's own writers give a null key


@dataclass
class _Written(WriterCommitMessage):
    #: (staged file, job's folder, first line) of each job in a task's part
    files: list[tuple[str, str, int]] = field(default_factory=list)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, suffix: str, overwrite: bool):
        self.path, self.suffix, self.overwrite = path.rstrip("/"), suffix, overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[Row]) -> _Written:
        """Called in each task, for rows in order; a file for each job that has lines in the part."""
        files, root = self._open()
        done, out, job = _Written(), None, None
        attempt = uuid.uuid4().hex  # a task that is tried again writes files of its own
        try:
            for row in iterator:
                if out is None or row.job_id != job:
                    if out is not None:
                        out.close()
                    job = row.job_id
                    folder = "job_id=" + (NO_JOB if job is None else quote(str(job), safe=""))
                    staged = f"{root}/{self.staging}/{attempt}-{len(done.files)}"
                    files.create_dir(f"{root}/{self.staging}", recursive=True)
                    out = files.open_output_stream(staged)
                    done.files.append((staged, folder, row.line_no))
                out.write(((row.line or "") + "\n").encode())
        finally:
            if out is not None:
                out.close()
        return done

    def commit(self, messages: list[_Written | None]) -> None:
        """Called once all tasks have succeeded: moves files, reads none."""
        files, root = self._open()
        if self.overwrite:
            for old in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if old.type == fs.FileType.Directory and old.base_name.startswith("job_id="):
                    files.delete_dir(old.path)
        for folder in {folder for m in messages if m for _, folder, _ in m.files}:
            files.create_dir(f"{root}/{folder}", recursive=True)
        for staged, folder, first in (f for m in messages if m for f in m.files):
            files.move(staged, f"{root}/{folder}/part-{first:020d}{self.suffix}")
        self._clear(files, root)
        files.create_dir(root, recursive=True)
        files.open_output_stream(f"{root}/_SUCCESS").close()

    def abort(self, messages: list[_Written | None]) -> None:
        """Called if a task failed for good: what was staged goes, also by tasks that sent no message."""
        self._clear(*self._open())

    def _clear(self, files: fs.FileSystem, root: str) -> None:
        if files.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{self.staging}")


class JobDocuments(DataSource):
    """Options: path (a folder that driver and executors reach: file, s3, hdfs, gs) and suffix of the files."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "job_id string, line_no bigint, line string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options.get("suffix", ".txt"), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JobDocuments)


def write_documents(lines: DataFrame, path: str, suffix: str = ".txt", overwrite: bool = False) -> None:
    """Write lines(job_id, line_no, line), see above. Without ``overwrite`` jobs are added to those in the folder;
    a job that is there already gets further files. Null jobs have a folder of their own, null lines are empty."""
    register(lines.sparkSession)
    ordered = lines.selectExpr("cast(job_id as string) as job_id", "cast(line_no as bigint) as line_no", "line") \
        .repartitionByRange("job_id", "line_no").sortWithinPartitions("job_id", "line_no")
    ordered.write.format(FORMAT).option("path", path).option("suffix", suffix) \
        .mode("overwrite" if overwrite else "append").save()
