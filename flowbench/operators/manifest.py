"""Integrity of fetched artifacts, and the splits of raw snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowbench.functions.text import file_stem
from flowbench.sources.files import hash_files


def verify_manifest(expected: DataFrame, artifacts: DataFrame) -> DataFrame:
    """``dataset, url, status``: ok, missing or sha_mismatch (without an expected digest any will do)."""
    have = artifacts.select("dataset", "url", F.col("sha256").alias("have"), F.lit(True).alias("there"))
    status = F.when(F.col("there").isNull(), "missing").when(F.col("sha256").isNotNull() & ~F.col("sha256").eqNullSafe(F.col("have")), "sha_mismatch").otherwise("ok")
    return expected.join(have, ["dataset", "url"], "left").select("dataset", "url", status.alias("status"))


def verify_manifest_deep(artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """``dataset, local_path, status`` after hashing the files again: ok, missing or sha_mismatch.

    files has ``dataset, path`` (as the artifact's local_path) and the file's ``content``, or its ``location``: it is then
    read as a stream by one task, and may be of any size. A location without a file counts as missing.
    """
    if "content" in files.columns:
        have = files.select("dataset", F.col("path").alias("local_path"), F.sha2("content", 256).alias("have"), F.lit(True).alias("there"))
    else:
        digests = hash_files(files.select(F.col("location").alias("path"))).select(F.col("path").alias("location"), F.col("sha256").alias("have"))
        have = files.join(digests, "location").where(F.col("have").isNotNull()).select("dataset", F.col("path").alias("local_path"), "have", F.lit(True).alias("there"))
    status = F.when(F.col("there").isNull(), "missing").when(~F.col("sha256").eqNullSafe(F.col("have")), "sha_mismatch").otherwise("ok")
    return artifacts.join(have, ["dataset", "local_path"], "left").select("dataset", "local_path", status.alias("status"))


def snapshot_totals(files: DataFrame) -> DataFrame:
    """Files of each snapshot and their known bytes; null where none is known."""
    return files.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("bytes"))


def strings_in(value: Column) -> Column:
    """All string values of a JSON text, decoded; names of fields are none. A text that is no JSON has none."""
    token = F.lit(r'"((?:[^"\\]|\\.)*)"(\s*:)?')
    found = F.zip_with(F.regexp_extract_all(value, token, F.lit(1)), F.regexp_extract_all(value, token, F.lit(2)), lambda s, colon: F.when(colon == "", s))
    sound = F.when(F.try_parse_json(value).isNotNull(), F.array_compact(found))
    return F.from_json(F.concat(F.lit('["'), F.array_join(sound, '","'), F.lit('"]')), "array<string>")


def assign_snapshot_splits(images: DataFrame, splits: DataFrame) -> DataFrame:
    """``dataset, subset, sample_id, split``: membership of a raw snapshot's images by the strings in its split documents.

    images has ``dataset, subset, path``; splits ``dataset, subset, split, value`` (JSON). A string that ends in .png, or is
    the stem of an image, names the images with that stem, whatever their subset. Where a snapshot's documents name
    nothing all is test; where no image is in test, what train leaves is. An image may be in both splits, or in none.
    """
    own = images.select("dataset", "subset", file_stem(F.col("path")).alias("stem")).distinct()
    stems = own.select("dataset", "stem").distinct()
    named = splits.where(F.col("split").isin("train", "test")).select("dataset", "split", F.explode(strings_in(F.col("value"))).alias("s"))
    file = F.lower("s").endswith(".png")
    files = named.where(file).select("dataset", "split", file_stem(F.col("s")).alias("stem"))
    bare = named.where(~file).select("dataset", "split", F.col("s").alias("stem")).join(stems, ["dataset", "stem"], "left_semi")
    flags = files.unionByName(bare).groupBy("dataset", "stem").agg(F.bool_or(F.col("split") == "train").alias("train"), F.bool_or(F.col("split") == "test").alias("test"))
    rows = own.join(flags, ["dataset", "stem"], "left").select("dataset", "subset", "stem", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("train", "test")])
    whole = rows.groupBy("dataset").agg(F.bool_or("test").alias("any_test"))
    rows = rows.join(whole, "dataset")
    in_test = F.when(F.col("any_test"), F.col("test")).otherwise(~F.col("train"))
    names = F.array_compact(F.array(F.when(F.col("train"), "train"), F.when(in_test, "test")))
    return rows.select("dataset", "subset", F.concat_ws(":", "subset", "stem").alias("sample_id"), F.explode(names).alias("split"))
