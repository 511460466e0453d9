"""Run logs as a stream of lines. Logs land in chunks, ``<log>.<number>``, cut anywhere, also within a line or a character; what a chunk
leaves unfinished is carried, in state, to the log's next chunk."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Fixed value: how a line's time stands at its beginning.
TIME = r"^\[(\d{2}:\d{2}:\d{2})\] "
LINES = "log string, line_no bigint, at string, text string, replaces boolean"


def read_chunks(spark: SparkSession, path: str, chunks_a_batch: int = 1000) -> DataFrame:
    """``log, chunk, content`` of the chunks that land below a path."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", chunks_a_batch).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.regexp_replace(name, r"\.\d+$", "").alias("log"), F.regexp_extract(name, r"\.(\d+)$", 1).try_cast("bigint").alias("chunk"), "content")


class _Lines(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rest = handle.getValueState("rest", "rest binary, line_no bigint, ready bigint")
        self.early = handle.getMapState("early", "chunk bigint", "content binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Chunks are joined by number, from 0; one that comes before its turn waits."""
        rest, no, ready = self.rest.get() if self.rest.exists() else (b"", 0, 0)
        for batch in rows:
            for chunk, content in zip(batch["chunk"], batch["content"], strict=True):
                self.early.updateValue((int(chunk),), (bytes(content),))
        out = []
        while self.early.containsKey((ready,)):
            *done, rest = (bytes(rest) + bytes(self.early.getValue((ready,))[0])).split(b"\n")
            self.early.removeKey((ready,))
            ready += 1
            for line in done:
                # a carriage return inside a line is progress that was written over: its last state stands
                text = line.decode("utf-8", errors="replace").rstrip("\r")
                out.append((key[0], no, text.rsplit("\r", 1)[-1], "\r" in text))
                no += 1
        self.rest.update((rest, no, ready))
        if out:
            d = pd.DataFrame(out, columns=["log", "line_no", "text", "replaces"])
            d.insert(2, "at", d["text"].str.extract(TIME, expand=False).astype(object).where(lambda s: s.notna(), None))
            d["text"] = d["text"].str.replace(TIME, "", regex=True)
            yield d

    def close(self) -> None:
        pass


def log_lines(chunks: DataFrame) -> DataFrame:
    """Append-mode stream of finished lines: ``log, line_no, at, text, replaces``, with the time that a line begins with taken out of its text."""
    return chunks.groupBy("log").transformWithStateInPandas(_Lines(), LINES, "Append", "None")


def last_lines(lines: DataFrame, most: int = 30_000) -> DataFrame:
    """The last lines of each log of a table of lines."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("log").orderBy(F.desc("line_no")))
    return lines.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")
