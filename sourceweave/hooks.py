"""What the engine leaves to its caller, with defaults that need no model."""

from __future__ import annotations

import re
import ssl
import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text to vector as an expression.
Embedder = Callable[[Column], Column]


# White space by Unicode, as a word border.
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def hash_words(size: int = 512) -> Embedder:
    """Bags of words: lower-case words without marks at their ends, counted by crc32 modulo ``size``, at length one.

    Texts come in Arrow batches and are counted slot by slot in one pass over their words; a null text has the zero vector.
    """

    @F.arrow_udf("array<double>")
    def count(texts: pa.Array) -> pa.Array:
        found = np.zeros((len(texts), size))
        for row, value in zip(found, texts.to_pylist()):
            bare = (w.strip(""".,;:!?()"'""") for w in _BLANKS.split((value or "").lower()))
            slots = np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) % size for w in bare if w), dtype=np.int64)
            row += np.bincount(slots, minlength=size)
        length = np.linalg.norm(found, axis=1, keepdims=True)
        found /= np.where(length > 0, length, 1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * size, pa.int32()), pa.array(found.ravel()))

    return count


def encode_once(docs: DataFrame, text: str, embed: Embedder, vector: str = "embedding") -> DataFrame:
    """``docs`` with the vector of their text; each distinct text is encoded once. Texts meet by their SHA-256, not by themselves."""
    keyed = docs.withColumn("_sha", F.unhex(F.sha2(F.col(text).cast("binary"), 256)))
    known = keyed.where("_sha is not null").groupBy("_sha").agg(F.any_value(text).alias("_text")).select("_sha", embed(F.col("_text")).alias(vector))
    return keyed.join(known, "_sha", "left").drop("_sha")


def decoded(url: Column, decoder: Callable[[str], dict | None]) -> Column:
    """A URL by a decoder that answers {status, decoded_url}; the URL itself where it fails."""

    def one(value: str | None) -> str | None:
        if value is None or "/articles/" not in value:
            return value
        told = decoder(value) or {}
        fine = str(told.get("status")).lower() in ("true", "success") and str(told.get("decoded_url") or "").startswith("http")
        return str(told["decoded_url"]) if fine else value

    @F.arrow_udf("string")
    def decode(values: pa.Array) -> pa.Array:
        return pa.array([one(v) for v in values.to_pylist()], pa.string())

    return decode(url)


class Refused(Exception):
    """Raised by a getter for an answer that is worth another try."""


def is_worth_another_try(status: int) -> bool:
    """A server that is busy or broken; every other refusal is final."""
    return status == 429 or status >= 500


def standard_get(timeout: float = 15.0, agent: str = "Mozilla/5.0") -> Callable[[str], str | None]:
    """A getter over the standard library, for :func:`patiently`: Refused for answers worth another try, None for final ones.

    A certificate that can't be proven is passed over once, as feeds' addresses often have such; bodies are read as UTF-8.
    """

    def get(url: str) -> str | None:
        request = urllib.request.Request(url, headers={"User-Agent": agent})
        for context in (None, ssl._create_unverified_context()):
            try:
                with urllib.request.urlopen(request, timeout=timeout, context=context) as answer:
                    return answer.read().decode("utf-8", "replace")
            except urllib.error.HTTPError as refusal:
                if is_worth_another_try(refusal.code):
                    raise Refused(url) from refusal
                return None
            except urllib.error.URLError as fault:
                if context is not None or not isinstance(fault.reason, ssl.SSLError):
                    raise OSError(str(fault.reason)) from fault
        return None

    return get


def patiently(get: Callable[[str], str], tries: int = 3, wait: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str | None]:
    """``get`` with further tries after 2, 4, 8 seconds when it refuses; None if it still does."""

    def patient(url: str) -> str | None:
        for attempt in range(tries + 1):
            try:
                return get(url)
            except (Refused, OSError):
                if attempt < tries:
                    sleep(wait * 2**attempt)
        return None

    return patient


def fetched(urls: DataFrame, get: Callable[[str], str | None], url: str = "url", threads: int = 6) -> DataFrame:
    """``urls`` with ``html``: each partition fetches with a few threads; rows keep their order and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                bodies = list(pool.map(lambda u: get(u) if u else None, batch.column(url).to_pylist()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bodies, pa.string())], names=[*batch.schema.names, "html"])

    schema = T.StructType([*urls.schema.fields, T.StructField("html", T.StringType())])
    return urls.mapInArrow(run, schema)


def through_cache(urls: DataFrame, path: str, get: Callable[[str], str | None], url: str = "url") -> DataFrame:
    """(url, html) of all distinct ``urls``: those that the table at ``path`` lacks are fetched and added to it."""
    spark = urls.sparkSession
    wanted = urls.select(url).where(F.col(url).isNotNull()).distinct()
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    missing = wanted.join(spark.read.parquet(path), url, "left_anti") if there else wanted
    fetched(missing, get, url).where("html is not null").write.mode("append").parquet(path)
    return wanted.join(spark.read.parquet(path), url, "left")
