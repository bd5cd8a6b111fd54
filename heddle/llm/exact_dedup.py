"""Operator 5: exact duplicates by composable polynomial fingerprints.

A text is a polynomial in its bytes, taken at four bases modulo the prime 2^31-1. Chunks are
hashed apart and combine by length-shifted arithmetic, H(ab) = H(a) * B^len(b) + H(b), so the
chunks of a huge document are hashed by many tasks and summed in any order. Texts of equal length
and fingerprint are then compared byte by byte, chunk against chunk, each chunk reduced to its
least and greatest value before anything is exchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

PRIME = (1 << 31) - 1
#: Fixed bases of the four polynomials.
BASES = (1_000_003, 715_827_883, 1_431_655_751, 2_046_820_351)
#: Bytes that one vector product covers, of a piece of a huge document, and of a huge document.
CHUNK, PIECE, HUGE = 1 << 16, 1 << 20, 8 << 20


def powers(bases: tuple[int, ...] = BASES, prime: int = PRIME, n: int = CHUNK) -> np.ndarray:
    """B^(n-1) ... B^0 for each base."""
    out = np.ones((len(bases), n), dtype=np.uint64)
    for i, b in enumerate(bases):
        done, step = 1, b % prime
        while done < n:  # the known run, shifted by its own length
            more = min(done, n - done)
            out[i, done : done + more] = out[i, :more] * np.uint64(step) % np.uint64(prime)
            done, step = done + more, step * step % prime
    return np.ascontiguousarray(out[:, ::-1])


def fingerprint(raw: bytes | memoryview, table: np.ndarray, bases: tuple[int, ...] = BASES, prime: int = PRIME, chunk: int = CHUNK) -> list[int]:
    """Values of the polynomial of ``raw`` at each base."""
    data, total = np.frombuffer(raw, dtype=np.uint8), [0] * len(bases)
    for at in range(0, len(data), chunk):
        part = data[at : at + chunk].astype(np.uint64)
        values = (table[:, -len(part) :] @ part) % np.uint64(prime)
        total = [(t * pow(b, len(part), prime) + int(v)) % prime for t, b, v in zip(total, bases, values, strict=True)]
    return total


def hashed(raw: Column, after: Column, bases: tuple[int, ...] = BASES, prime: int = PRIME) -> Column:
    """The fingerprint of each binary, shifted by the number of bytes that follow it in its document."""

    @F.arrow_udf("array<long>")
    def values(raw: pa.Array, after: pa.Array) -> pa.Array:
        table, out = powers(bases, prime), []
        for x, n in zip(raw, after.to_pylist(), strict=True):
            found = fingerprint(x.as_buffer(), table, bases, prime)
            out.append(found if not n else [v * pow(b, n, prime) % prime for v, b in zip(found, bases, strict=True)])
        return pa.array(out, pa.list_(pa.int64()))

    return values(raw, after)


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), shared.SPACE + "+", " ")


def packed(values: Column, n: int) -> Column:
    """Two residues of 31 bits to a long."""
    return F.array(*[values[i] * F.lit(1 << 31) + (values[i + 1] if i + 1 < n else F.lit(0)) for i in range(0, n, 2)])


def fingerprints(docs: DataFrame, text: str, bases: tuple[int, ...], prime: int, piece: int, huge: int) -> DataFrame:
    """All rows, stored, with ``_uid``, ``_bytes``, ``_fp`` and ``_sha`` of the normalised text."""
    norm = normalised(F.col(text))
    base = docs.withColumn("_norm", norm).withColumns({"_uid": F.monotonically_increasing_id(), "_bytes": F.octet_length("_norm").cast("long"), "_sha": F.sha2(F.col("_norm").cast("binary"), 256)})
    usual = F.when(F.col("_bytes") <= huge, F.col("_norm")).otherwise(F.lit("")).cast("binary")
    values = hashed(usual, F.lit(0).cast("long"), bases, prime)
    rows = shared.stored(base.withColumn("_v", values).withColumn("_fp", F.when(F.col("_bytes") <= huge, packed(F.col("_v"), len(bases)))).drop("_norm", "_v"), "fingerprints")
    big = rows.filter(F.col("_bytes") > huge)
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_bytes") - 1, F.lit(piece).cast("long")))
    pieces = (
        big.select("_uid", "_bytes", norm.cast("binary").alias("_raw"), start.alias("_at"))
        .select("_uid", "_at", F.substring("_raw", (F.col("_at") + 1).cast("int"), F.lit(piece)).alias("_piece"), F.greatest(F.col("_bytes") - F.col("_at") - piece, F.lit(0)).alias("_after"))
        .repartition("_uid", "_at")
        .select("_uid", hashed(F.col("_piece"), F.col("_after"), bases, prime).alias("_v"))
    )
    summed = pieces.groupBy("_uid").agg(*[F.sum(F.col("_v")[i]).alias(f"_v{i}") for i in range(len(bases))])
    combined = summed.select("_uid", packed(F.array(*[F.col(f"_v{i}") % prime for i in range(len(bases))]), len(bases)).alias("_fp"))
    return rows.filter(F.col("_bytes") <= huge).unionByName(big.drop("_fp").join(combined, "_uid"))


def collided(rows: DataFrame, text: str, keys: DataFrame, piece: int = CHUNK) -> DataFrame:
    """Of ``keys`` (_bytes, _fp), those whose texts aren't all the same, by comparing chunk with chunk."""
    key = F.xxhash64("_bytes", "_fp")
    some = shared.narrowed(rows.select("_bytes", "_fp", text), key, keys.select(key))
    chunks = some.select("_bytes", "_fp", normalised(F.col(text)).cast("binary").alias("_raw"), F.explode(F.sequence(F.lit(0), F.greatest(F.col("_bytes") - 1, F.lit(0)).cast("int"), F.lit(piece))).alias("_at"))
    chunks = chunks.select("_bytes", "_fp", "_at", F.substring("_raw", F.col("_at") + 1, F.lit(piece)).alias("_chunk"))
    same = chunks.groupBy("_bytes", "_fp", "_at").agg((F.min("_chunk") == F.max("_chunk")).alias("_same"))
    return same.filter(~F.col("_same")).select("_bytes", "_fp").distinct()


def decided(keyed: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Classes of equal key, and each row with its class's decision."""
    order = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("id"), F.col("_uid").alias("uid"))
    classes = shared.stored(keyed.groupBy(*key).agg(F.min(order).alias("_first"), F.count("*").alias("group_size")), "classes")
    return classes, keyed.join(classes, key).select("_uid", F.col("_id").alias("doc_id"), F.col("_first.id").alias("keep_id"), "group_size", (F.col("_first.uid") == F.col("_uid")).alias("kept"), F.col("_sha").alias("text_sha256"))


def decisions(rows: DataFrame, doc_id: str, text: str) -> DataFrame:
    """For each row of fingerprints(): _uid, doc_id, keep_id, group_size, kept, text_sha256."""
    keyed = rows.select("_uid", F.col(doc_id).alias("_id"), "_bytes", "_fp", "_sha")
    classes, named = decided(keyed, ["_bytes", "_fp"])
    broken = shared.stored(collided(rows, text, classes.filter("group_size > 1").select("_bytes", "_fp")), "collided")
    if broken.isEmpty():
        return named
    # Fingerprints of different texts met: there the digest parts them too.
    parted = keyed.join(broken.withColumn("_broken", F.lit(True)), ["_bytes", "_fp"], "left").withColumn("_sub", F.when(F.col("_broken"), F.col("_sha")).otherwise(F.lit("")))
    return decided(parted, ["_bytes", "_fp", "_sub"])[1]


RESERVED = {"keep_id", "group_size", "kept", "text_sha256", "_norm", "_uid", "_bytes", "_sha", "_fp", "_v", "_id"}


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bases: tuple[int, ...] = BASES, prime: int = PRIME, piece: int = PIECE, huge: int = HUGE, whole_rows: bool = True) -> DataFrame:
    """All rows with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``; without whole_rows
    only their ids with these.

    Texts are equal when identical after each run of white space became one space; null counts as
    empty. Of equal texts the row with the smallest id stays (null ids count as largest), and of
    rows that repeat both id and text exactly one. An empty table gives an empty result. Input
    columns named like the result's or like working ones are kept with ``in_`` before the name (as often
    as it takes to be free).
    """
    docs, _ = shared.set_aside(docs, RESERVED, (doc_id, text))
    rows = fingerprints(docs, text, bases, prime, piece, huge)
    named = decisions(rows, doc_id, text)
    if not whole_rows:
        return named.drop("_uid")
    return rows.select(*docs.columns, "_uid").join(named.drop("doc_id"), "_uid").drop("_uid")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with the columns they came with."""
    renamed, back = shared.set_aside(docs, RESERVED, (doc_id, text))
    rows = fingerprints(renamed, text, BASES, PRIME, PIECE, HUGE)
    stay = decisions(rows, doc_id, text).filter("kept").select("_uid")
    out = rows.join(stay, "_uid", "left_semi").drop("_uid", "_bytes", "_sha", "_fp")
    return out.withColumnsRenamed(back).select(*docs.columns)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs, whole_rows=False)


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
     r AS (SELECT doc_id, t, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) AS k,
                  first_value(doc_id) OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) AS keep_id,
                  count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, k = 1 AS kept, sha256(t) AS text_sha256 FROM r
"""
