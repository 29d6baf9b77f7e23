"""Concatenated JSON: objects that follow each other with or without line breaks.

The JSON reader returns only the first object of such a line, so a file is cut
into object strings first; ``from_json`` does the parsing.  A file of any size is
read by many tasks: the text source splits it at every ``{``, wherever a byte
range begins.  What a piece does to the reader's state - inside a string or not,
how deep in brackets - does not depend on the pieces before it but for the
string state, so running sums over the pieces tell which of them begin an object.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.operators import ordered
from corpusloom.session import cut_lineage
from corpusloom.sources.day_files import day_of_file

_SPLIT = "path string, fname string, no bigint, sub bigint, value string, rest string"
# Largest value that is put together.
MAX_CHARS = 64 << 20


def split_objects(text: str) -> tuple[list[str], str]:
    """Object strings of the text, and what is left after a malformed part."""
    decoder, found, at = json.JSONDecoder(), [], 0
    end = len(text)
    while True:
        while at < end and text[at].isspace():
            at += 1
        if at >= end:
            return found, ""
        try:
            _, stop = decoder.raw_decode(text, at)
        except json.JSONDecodeError:
            return found, text[at:]
        found.append(text[at:stop])
        at = stop


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Values of each candidate; ``rest`` has what follows a malformed one."""
    for pdf in batches:
        out = []
        for path, fname, no, text in zip(pdf["path"], pdf["fname"], pdf["no"], pdf["text"]):
            found, rest = split_objects(text)
            out += [(path, fname, no, i, v, None) for i, v in enumerate(found)]
            if rest:
                out.append((path, fname, no, len(found), None, rest))
        yield pd.DataFrame(out, columns=["path", "fname", "no", "sub", "value", "rest"])


def pieces(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """The files of a folder, cut before every ``{`` (which is left out): input of ``split_pieces``."""
    reader = spark.read.option("lineSep", "{")
    return _located((reader.option("pathGlobFilter", glob) if glob else reader).text(path))


def piece_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """New files as a stream of pieces; a micro-batch has whole files."""
    reader = spark.readStream.format("text").option("lineSep", "{")
    return _located((reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path))


def _located(files: DataFrame) -> DataFrame:
    return files.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("fname"),
                        F.col("_metadata.file_block_start").alias("block"))


def _depth(outside: Column) -> Column:
    """Opening less closing brackets of a text without strings."""
    count = lambda c: F.length(outside) - F.length(F.replace(outside, F.lit(c), F.lit("")))
    return count("[") - count("]") - count("}")


def _numbered(rows: DataFrame) -> DataFrame:
    """Pieces in file order with the number ``no`` of the candidate they belong to."""
    placed = ordered.arrange(rows.withColumn("at", F.monotonically_increasing_id()), "path", "block", "at")
    plain = F.regexp_replace("value", r"(?s)\\.", "")  # without escapes
    from_text = F.regexp_replace(plain, '"[^"]*("|$)', "")
    from_string = F.regexp_replace(F.regexp_replace(plain, '^[^"]*("|$)', ""), '"[^"]*("|$)', "")
    quotes = F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit("")))
    narrow = placed.select("path", "_chunk", "_row", quotes.alias("quotes"), _depth(from_text).alias("d0"), _depth(from_string).alias("d1"))
    narrow = narrow.join(placed.groupBy("path").agg(F.min("_row").alias("_first")), "path")
    first = F.col("_row") == F.col("_first")
    narrow = ordered.running(narrow, ["path"], sums={"q": F.col("quotes")})
    inside = (F.col("q") - F.col("quotes")) % 2 == 1
    narrow = narrow.withColumn("inside", inside).withColumn("step", F.when(inside, F.col("d1")).otherwise(F.col("d0") + F.when(first, 0).otherwise(1)))
    narrow = ordered.running(cut_lineage(narrow), ["path"], sums={"depth": F.col("step")})
    begins = first | (~F.col("inside") & (F.col("depth") - F.col("step") == 0))
    narrow = narrow.withColumn("begins", begins.cast("int"))
    narrow = ordered.running(narrow, ["path"], sums={"no": F.col("begins")})
    return placed.join(narrow.select("_row", "no", (~first).alias("brace")), "_row")


def split_pieces(rows: DataFrame, max_chars: int = MAX_CHARS) -> tuple[DataFrame, DataFrame]:
    """Values ``path, fname, obj_no, value`` in file order, and the rest of each file after its first malformed part.

    The rest comes as ordered parts ``path, fname, part, rest``.  A value of more
    than ``max_chars`` characters counts as malformed: no such text is put
    together.
    """
    numbered = cut_lineage(_numbered(rows))
    text = F.concat(F.when(F.col("brace"), F.lit("{")).otherwise(F.lit("")), F.col("value"))
    size = numbered.groupBy("path", "no").agg(F.sum(F.length("value") + 1).alias("chars"))
    large = cut_lineage(size.where(F.col("chars") > max_chars).select("path", "no"))
    whole = numbered.join(large, ["path", "no"], "left_anti").groupBy("path", "fname", "no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_row", text.alias("t")))), lambda s: s["t"]), "").alias("text"))
    parsed = cut_lineage(whole.mapInPandas(_split, _SPLIT))
    # Nothing after the first malformed part of a file is a value.
    bad = parsed.where("rest is not null").select("path", "no", "sub").unionByName(large.select("path", "no", F.lit(0).cast("bigint").alias("sub")))
    bad = bad.groupBy("path").agg(F.min(F.struct("no", "sub")).alias("bad"))
    good = parsed.where("value is not null").join(bad, "path", "left").where(F.col("bad").isNull() | (F.struct("no", "sub") < F.col("bad")))
    values = ordered.number_rows(ordered.arrange(good, "path", "no", "sub"), ["path"], "obj_no")
    values = values.select("path", "fname", (F.col("obj_no") - 1).alias("obj_no"), "value")
    own = parsed.where("rest is not null").join(bad, "path").where((F.col("no") == F.col("bad.no")) & (F.col("sub") == F.col("bad.sub")))
    own = own.select("path", "fname", F.lit(-1).cast("bigint").alias("_row"), F.col("rest"))
    begun = large.join(bad, "path").where(F.col("no") == F.col("bad.no")).select("path", F.col("no").alias("from"))
    later = bad.join(begun, "path", "left").select("path", F.coalesce("from", F.col("bad.no") + 1).alias("from"))
    after = numbered.join(later, "path").where(F.col("no") >= F.col("from")).select("path", "fname", "_row", text.alias("rest"))
    parts = ordered.number_rows(ordered.arrange(own.unionByName(after), "path", "_row"), ["path"], "part")
    return values, parts.select("path", "fname", "part", "rest")


def records_of(values: DataFrame) -> DataFrame:
    """Records ``fname, day, obj_no, ...`` of the values."""
    rows = values.withColumn("r", F.from_json("value", schemas.RECORD))
    return rows.select("fname", day_of_file(F.col("fname")).alias("day"), "obj_no", "r.*")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of all files, in file order by ``obj_no``."""
    return records_of(split_pieces(pieces(spark, path))[0])


def quarantine(spark: SparkSession, path: str) -> DataFrame:
    """``fname, part, rest``: what follows the first malformed part of each file, in order."""
    return split_pieces(pieces(spark, path))[1].select("fname", "part", "rest")
