"""Codes of vectors by product quantisation in whole numbers, nearest entries by bounds.

A vector's parts are compared with a codebook each. Before any distance is worked out,
entries are ruled out by the means of segments: over a block of s components with means
x and c and residual norms r and q, the squared distance is at least s (x - c)^2 +
(r - q)^2, which holds as the means' part and the residuals' part are at right angles.
One block comes first, then two, then four, as far as they divide a part. The exact
distance to the entry with the least coarse bound is what the others must stay within,
with room for rounding; those that do get exact distances of whole numbers.

A round is one pass over the vectors: tasks add up parts by their nearest entry, and
only these sums, one row for each part and entry of a task, are shuffled. A codebook is
8 x 16 entries, whatever the table, and goes to the tasks with the code.

Defined results: rows whose vector is null, empty or holds a null or non-finite component
are dropped; repeated rows count each and null ids come last among the first 16; with
fewer than 16 vectors there are fewer entries; null labels are one label; an empty table
gives an empty one. Other columns are left out. Vectors of unequal lengths, lengths that
eight doesn't divide, and components beyond what 64-bit distances can hold raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm import common
from corpusforge.llm.neardup import spread_join

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096


def kept(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has components, all of them finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return df.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad)


def whole(vectors: pa.Array, width: int) -> np.ndarray:
    """Components times 4096, rounded down: (rows, parts, width of a part)."""
    sizes = np.diff(np.asarray(vectors.offsets))
    if len(sizes) and (sizes != PARTS * width).any():
        raise ValueError(f"vectors of {sorted(set(sizes.tolist()))[:5]} components beside others of {PARTS * width}")
    x = np.floor(SCALE * np.asarray(vectors.flatten(), np.float64)).reshape(-1, PARTS, width)
    # 8 parts of squared differences must fit a signed 64-bit number
    if x.size and np.abs(x).max() >= 2**30 / width**0.5:
        raise ValueError("components too large for distances of 64 bits")
    return x.astype(np.int64)


class Segments:
    """Block means and residual norms of whole-number vectors, coarse to fine."""

    def __init__(self, x: np.ndarray):
        self.x = x
        width = x.shape[1]
        self.levels = []
        for blocks in (1, 2, 4):
            if width % blocks == 0 and (blocks == 1 or width > blocks):
                cut = x.reshape(len(x), blocks, width // blocks).astype(np.float64)
                mean = cut.mean(axis=2)
                self.levels.append((mean, np.sqrt(((cut - mean[:, :, None]) ** 2).sum(axis=2)), width // blocks))
        self.size = (x.astype(np.float64) ** 2).sum(axis=1)


def _bound(x: tuple, c: tuple, i, j) -> np.ndarray:
    """Lower bounds of the squared distances of vectors i to entries j at one level."""
    (xm, xr, s), (cm, cr, _) = x, c
    return (s * (xm[i] - cm[j]) ** 2 + (xr[i] - cr[j]) ** 2).sum(axis=-1)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, the lower index of equals, and the exact squared distance."""
    n, k = len(x), len(entries)
    a, b = Segments(x), Segments(entries)
    coarse = _bound(a.levels[0], b.levels[0], np.arange(n)[:, None], np.arange(k)[None, :])
    guess = coarse.argmin(axis=1)
    within = ((x - entries[guess]) ** 2).sum(axis=1) + 1 + 1e-9 * (a.size + b.size.max())
    i, j = np.nonzero(coarse <= within[:, None])
    for one, two in zip(a.levels[1:], b.levels[1:], strict=True):
        left = _bound(one, two, i, j) <= within[i]
        i, j = i[left], j[left]
    exact = ((x[i] - entries[j]) ** 2).sum(axis=1)
    starts = np.searchsorted(i, np.arange(n))
    least = np.minimum.reduceat(exact, starts) if n else exact
    best = np.flatnonzero(exact == least[i])
    return j[best[np.searchsorted(i[best], np.arange(n))]], least


def _assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each row and part."""
    found = [nearest(x[:, p], books[p]) for p in range(PARTS)]
    return np.stack([e for e, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def first_books(rows: DataFrame, key: str, vector: str) -> np.ndarray | None:
    """The parts of the least 16 ids: (parts, entries, width), or none of an empty table."""
    head = rows.orderBy(F.asc_nulls_last(key), vector).select(F.col(vector).cast("array<double>").alias("v")).limit(ENTRIES).collect()
    if not head:
        return None
    if len(head[0]["v"]) % PARTS:
        raise ValueError(f"vectors of {len(head[0]['v'])} components have no {PARTS} equal parts")
    return whole(pa.array([r["v"] for r in head], pa.list_(pa.float64())), len(head[0]["v"]) // PARTS).swapaxes(0, 1)


def next_books(rows: DataFrame, vector: str, books: np.ndarray) -> np.ndarray:
    """One round: each entry becomes the mean of its parts, rounded down; unused ones stay."""
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            x = whole(batch.column(0), width)
            found, _ = _assign(x, books)
            for p in range(PARTS):
                np.add.at(sums[p], found[:, p], x[:, p])
                counts[p] += np.bincount(found[:, p], minlength=counts.shape[1])
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), *(pa.array(sums[p, e, i]) for i in range(width))], names=["part", "entry", "n", *(f"s{i}" for i in range(width))])

    sums = [f"s{i}" for i in range(width)]
    each = common.map_arrow(rows.select(vector), run, "part int, entry int, n long, " + ", ".join(f"{s} long" for s in sums))
    out = books.copy()
    for r in each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in sums]).collect():  # 128 rows at most
        out[r["part"], r["entry"]] = [r[s] // r["n"] for s in sums]
    return out


def train(rows: DataFrame, key: str, vector: str, rounds: int = ROUNDS) -> np.ndarray | None:
    books = first_books(rows, key, vector)
    for _ in range(rounds if books is not None else 0):
        books = next_books(rows, vector, books)
    return books


def encode(rows: DataFrame, vector: str, books: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep``, ``code`` (two hex digits for each part) and ``error``."""
    width = books.shape[2]
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, error = _assign(whole(batch.column(0), width), books)
            codes = [r.tobytes().hex() for r in found.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(codes, pa.string()), pa.array(error.sum(axis=1), pa.int64())], names=[*keep, "code", "error"])

    return common.map_arrow(rows.select(vector, *keep), run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", code string, error long")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every kept row."""
    spark = df.sparkSession
    rows = kept(df.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.col(label).alias("label")), "v")
    books = train(rows, "id", "v")
    if books is None:
        return rows.select(F.col("id").alias(key), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    folder = common.fresh_path(spark, "vector_codes")
    named = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("label")  # null is a label too
    coded = common.materialise(encode(rows.select("id", "v", named), "v", books, ["id", "label"]), "codes", folder)
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    joined = spread_join(coded, "label", "id", sums, folder)
    return joined.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def vector_codes_sql() -> str:
    """DuckDB SQL for the same rows, its rounds written out."""
    d = f"(SELECT max(len(v)) // {PARTS} FROM kept)"
    near = "SELECT r, p, x, min({{'d': list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT, 'e': e}}) AS best FROM parts JOIN book{k} USING (p) GROUP BY ALL"
    sql = [f"""kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""", f"parts AS MATERIALIZED (SELECT r, p, v[p * {d} + 1:(p + 1) * {d}] AS x FROM kept, range({PARTS}) t(p))", f"book0 AS (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= {ENTRIES})"]
    for k in range(ROUNDS):
        sql.append(f"near{k} AS MATERIALIZED ({near.format(k=k)})")
        sql.append(f"""mean{k} AS (
  SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (
    SELECT p, best.e AS e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM near{k}, (SELECT unnest(range(1, {d} + 1)) AS i) GROUP BY ALL) GROUP BY ALL
), book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m USING (p, e))""")
    sql.append(f"coded AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM ({near.format(k=ROUNDS)}) GROUP BY r)")
    sql.append(f"books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM book{ROUNDS})")
    return "WITH " + ", ".join(sql) + " SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM kept JOIN coded USING (r), books"
