"""Operator 12: vectors compressed to codes by product quantisation in exact integers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagoon.llm.vectors import finite, integers, safe_component, usual_length
from lagoon.storage import discard, materialize


def nearest(vectors: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the first of the nearest entries of ``book`` and the squared distance to it, in int64.

    |v - e|^2 is |v|^2 - 2 v.e + |e|^2; the part that is the same for all entries is added last.
    """
    rest = (book * book).sum(axis=1) - 2 * (vectors @ book.T)
    at = rest.argmin(axis=1)
    return at, rest[np.arange(len(at)), at] + (vectors * vectors).sum(axis=1)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(-1, dim)


def train_codebooks(rows: DataFrame, dim: int, parts: int, entries: int, rounds: int) -> np.ndarray:
    """``parts`` x entries x components: the codebooks after ``rounds`` over the ``q`` of all ``rows``.

    The driver holds the codebooks only (``entries * dim`` integers, a parameter's bound). Each round they are broadcast; a task adds up its rows for each part and
    entry before the shuffle, so that at most ``parts * entries`` sums leave it however its rows are spread.
    """
    width = dim // parts
    first = rows.orderBy(F.col("id").asc_nulls_last(), "q").limit(entries).select("q").collect()
    if not first:
        return np.zeros((parts, 0, width), np.int64)
    books = np.array([r["q"] for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    context = rows.sparkSession.sparkContext
    sums = [f"s{i}" for i in range(width)]
    for _ in range(rounds):
        sent = context.broadcast(books)

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = sent.value
            count = np.zeros(held.shape[:2], np.int64)
            total = np.zeros_like(held)
            for batch in batches:
                q = _matrix(batch.column(0), dim)
                for p in range(parts):
                    mine = q[:, p * width : (p + 1) * width]
                    at, _ = nearest(mine, held[p])
                    count[p] += np.bincount(at, minlength=len(held[p]))
                    np.add.at(total[p], at, mine)
            part, entry = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part, entry, count[part, entry], *total[part, entry].T)], names=["part", "entry", "n", *sums])

        made = rows.select("q").mapInArrow(add_up, "part long, entry long, n long, " + ", ".join(f"{s} long" for s in sums))
        for r in made.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in sums]).collect():
            books[r["part"], r["entry"]] = [r[s] // r["n"] for s in sums]
        sent.unpersist()
    return books


def fingerprint(books: np.ndarray) -> str:
    """SHA-256 of all integers of the codebooks by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(
    embeddings: DataFrame,
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    scale: int = 1024,
    most: int = 100_000,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> tuple[DataFrame, np.ndarray]:
    """``id_col, label_col, code, error, label_error, codebooks_sha256`` for each row with a finite vector, and the codebooks.

    ``code`` is a binary of one byte for each part (``entries`` is 256 at most), ``error`` the squared distance between the integer vector and what its code stands
    for, ``label_error`` the sum of errors over rows of equal label (null labels together). Rows whose vector is null or
    holds null or non-finite components are dropped. Codebooks begin as the rows of the smallest ids (ties by vector, null ids last; with fewer rows there are fewer entries).
    Vectors that aren't of the commonest length which ``parts`` divides, and those with components so large that squared distances may leave int64,
    stay in the result with null ``code`` and ``error`` and train nothing. Sums by label are broadcast up to ``most`` labels; beyond that each label meets its rows in a shuffle, labels of many rows in several tasks.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256")
    kept = embeddings.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).filter(finite(F.col("v")))
    dim = usual_length(kept, "v", parts)
    bound = safe_component(dim)
    fits = (F.size("v") == dim) & F.lit(dim > 0) & F.forall("v", lambda x: F.abs(x) * scale < bound - 1)
    rows = materialize(kept.select("id", "label", F.when(fits, integers(F.col("v"), scale)).alias("q")))
    sound = rows.filter("q IS NOT NULL")
    books = train_codebooks(sound, dim, parts, entries, rounds)
    width = dim // parts
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for batch in batches:
            q = _matrix(batch.column(2), dim)
            code = np.empty((len(q), parts), np.uint8)
            error = np.zeros(len(q), np.int64)
            for p in range(parts):
                code[:, p], off = nearest(q[:, p * width : (p + 1) * width], held[p])
                error += off
            codes = pa.array([c.tobytes() for c in code], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), codes, pa.array(error)], names=["id", "label", "code", "error"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    coded = sound.mapInArrow(assign, f"id {types['id']}, label {types['label']}, code binary, error long")
    other = rows.filter("q IS NULL").select("id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = materialize(coded.unionByName(other))
    discard(rows)
    sums = coded.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    if sums.count() <= most:
        joined = coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("l")))
    else:
        salts = F.ceil(F.col("n") / 100_000).cast("int")
        spread = sums.select("l", "label_error", salts.alias("salts"))
        dealt = coded.join(spread.select("l", "salts").filter("salts > 1"), F.col("label").eqNullSafe(F.col("l")), "left").drop("l")
        dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.coalesce("salts", F.lit(1)))).drop("salts")
        each = spread.select("l", "label_error", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1)).alias("s"))
        joined = dealt.join(each, F.col("label").eqNullSafe(F.col("l")) & (F.col("salt") == F.col("s")))
    out = joined.select(
        F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256")
    )
    return out, books
