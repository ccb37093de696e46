"""Writers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from termweave.operators.graph import ntriples_lines
from termweave.operators.reports import BEST_HEADER, ONTOLOGY_HEADER, TAG_HEADER

TAGS_PER_LINE = 10_000
ROWS_PER_FILE = 4_000_000  # of a compressed file, which one task reads
OPEN_FILES = 64  # that a task holds open while it writes by graph
UNSORTED = {"spark.sql.optimizer.plannedWrite.enabled": "false", "spark.sql.maxConcurrentOutputFileWriters": str(OPEN_FILES)}


def write_abstracts(abstracts: DataFrame, path: str, per_file: int = 100, mode: str = "overwrite") -> None:
    """JSON lines with at most ``per_file`` abstracts per file."""
    abstracts.write.mode(mode).option("maxRecordsPerFile", per_file).json(path)


def write_embeddings(vectors: DataFrame, path: str, encoder: str, by: list[str] | None = None) -> None:
    """Parquet partitioned by encoder (and ``by``); a rerun replaces only the partitions it writes."""
    keyed = vectors.withColumn("encoder", F.lit(encoder))
    writer = keyed.write.mode("overwrite").options(partitionOverwriteMode="dynamic", compression="zstd")
    writer.partitionBy("encoder", *(by or [])).parquet(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def _together(tags_per_line: int, layout: pa.Schema):
    """A row ``doi, entries`` for every run of rows of one document, several for more than ``tags_per_line`` rows."""

    def rows(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        table = table.combine_chunks()
        pairs = pa.StructArray.from_arrays([table[n].combine_chunks().cast(f.type) for n, f in zip(("tag", "similarity"), layout.field("entries").type.value_type)], ["tag", "similarity"])
        entries = pa.ListArray.from_arrays(pa.array(np.append(starts, table.num_rows), pa.int32()), pairs)
        doi = table["doi"].combine_chunks().take(pa.array(starts))
        return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip((doi, entries), layout)], schema=layout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last line so far
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*(held.to_batches() if held else []), batch])
            doc = table["doi"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            lines = -(-np.diff(np.append(starts, len(doc))) // tags_per_line)
            number = np.arange(lines.sum()) - np.repeat(np.cumsum(lines) - lines, lines)
            at = np.repeat(starts, lines) + number * tags_per_line
            if len(at) > 1:
                yield rows(table.slice(0, at[-1]), at[:-1])
            held = table.slice(at[-1])
        if held:
            yield rows(held, np.zeros(1, np.int64))

    return run


def scores_json(scores: DataFrame, tags_per_line: int = TAGS_PER_LINE, together: bool = False) -> DataFrame:
    """One column ``value``: ``{doi: {tag: similarity}}``; a document with very many tags takes several lines.

    ``together`` is for scores whose rows of a document stand one after another, as ``score_tags`` gives them: they are not shuffled. A document
    whose rows do not takes more lines.
    """
    line = F.to_json(F.create_map("doi", F.map_from_entries(F.sort_array("entries")))).alias("value")
    entry = F.struct("tag", "similarity")
    if together:
        shape = scores.select("doi", F.array(entry).alias("entries")).schema
        return scores.select("doi", "tag", "similarity").mapInArrow(_together(tags_per_line, to_arrow_schema(shape)), shape).select(line)
    sizes = scores.groupBy("doi").agg(F.ceil(F.count("*") / F.lit(tags_per_line)).alias("lines"))
    several = sizes.where("lines > 1")
    number = F.pmod(F.xxhash64("tag"), F.coalesce("lines", F.lit(1))).alias("line")
    placed = scores.join(several, "doi", "left").select("doi", "tag", "similarity", number)
    return placed.groupBy("doi", "line").agg(F.collect_list(entry).alias("entries")).select(line)


def write_scores_json(scores: DataFrame, path: str, together: bool = False, compression: str = "none", per_file: int = 0) -> None:
    """``compression`` (say ``gzip``) is for very many scores; such a file is read by one task, so ``per_file`` bounds its lines."""
    lines = scores_json(scores, together=together)
    lines.write.mode("overwrite").options(compression=compression, maxRecordsPerFile=per_file).text(path)


def _csv(df: DataFrame, path: str, header: tuple[str, ...] | None = None, **options) -> None:
    named = df.toDF(*header) if header else df
    named.write.mode("overwrite").options(header=True, **options).csv(path)


def write_annotations(rows: DataFrame, path: str, compression: str = "none", per_file: int = 0) -> None:
    """``compression`` (say ``gzip``) is for very many rows, which repeat their documents and tags; such a file is read by one task, so ``per_file``
    bounds its rows."""
    _csv(rows, path, compression=compression, maxRecordsPerFile=per_file)


def write_best_similarities(df: DataFrame, path: str, compression: str = "none", per_file: int = 0) -> None:
    _csv(df, path, BEST_HEADER, compression=compression, maxRecordsPerFile=per_file)


def write_summary_tags(df: DataFrame, path: str) -> None:
    _csv(df, path, TAG_HEADER)


def write_summary_ontologies(df: DataFrame, path: str) -> None:
    _csv(df, path, ONTOLOGY_HEADER)


def write_tags(tags: DataFrame, path: str, per_file: int = 0) -> None:
    """One CSV folder per ontology: ``term, rdfs_label, description``."""
    chosen = tags.select("ontology", "term", "rdfs_label", "description")
    writer = chosen.write.mode("overwrite").partitionBy("ontology").option("header", True)
    writer.option("maxRecordsPerFile", per_file).option("escape", '"').csv(path)


def write_compiled_ncbi(compiled: DataFrame, path: str) -> None:
    compiled.select("tax_id", "name", "parent_tax", "rank", "division").write.mode("overwrite").option(
        "sep", "\t"
    ).csv(path)


def write_ntriples(triples: DataFrame, path: str, compression: str = "none", per_file: int = 0) -> None:
    ntriples_lines(triples).write.mode("overwrite").options(compression=compression, maxRecordsPerFile=per_file).text(path)


def write_graphs(triples: DataFrame, path: str, compression: str = "none", per_file: int = 0) -> None:
    """A folder ``graph=<name>`` of N-Triples per value of the column ``graph``; ``compression`` and ``per_file`` as for ``write_scores_json``.

    Rows are not gathered per graph, so one that holds most triples is written by many tasks. A task holds a file open for each of its graphs, up
    to ``OPEN_FILES``, and sorts only what lies beyond these: sorting all rows by their graph would write every one of them to disk once more.
    """
    writer = ntriples_lines(triples, ["graph"]).write.mode("overwrite").partitionBy("graph")
    with _settings(triples.sparkSession, UNSORTED):
        writer.options(compression=compression, maxRecordsPerFile=per_file).text(path)


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings of the session that hold for one write."""
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def union_frames(frames: list[DataFrame]) -> DataFrame:
    """All rows under the union of all columns, nulls where a frame lacks one."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_records(frames: list[DataFrame], path: str, format: str = "csv") -> None:
    """Records of several shapes as one table."""
    union = union_frames(frames)
    if format == "csv":
        _csv(union, path)
    else:
        union.write.mode("overwrite").format(format).save(path)
