"""Hard negatives by product quantisation with stored residual norms.

A vector is cut into short pieces, and each piece is replaced by the nearest entry of a codebook.  The row keeps its codes and
the norm of what they leave out.  For an anchor q a table holds the products of its pieces with all entries, so
the product with a row's codes is a sum of table entries, and the true score lies within |q| times the row's residual norm of it.
These bounds decide which rows are scored at all:

* positives: of the rows with the anchor's label, those whose upper bound reaches the k-th best lower bound;
* negatives of a positive: of the rows with another label, those whose bounds meet the window of scores, and reach
  the k-th best lower bound among the rows that lie in the window for certain.

What is left is scored with whole numbers, so results are exact whatever the codebooks are; these are made from a bounded
sample, and every row is coded.  Rows are dealt into shards, anchors (a stated query set) into blocks, and each block meets each
shard in a task; what leaves it is k rows for each anchor or positive.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dispensary.llm._spark import checkpointed
from dispensary.llm.vector_topk import matrix, products, whole_vectors

#: Rows of the sample that codebooks are made from, components in a piece, entries of a codebook (256 at most), rounds of their making.
SAMPLE, PIECE, ENTRIES, ROUNDS = 4096, 4, 256, 8
#: Rows in a shard, anchors in a block, anchors whose bounds are held at a time.
SHARD, BLOCK, HELD = 8192, 16384, 64


def codebooks(sample: np.ndarray, piece: int = PIECE, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """(pieces, entries, piece) by Lloyd's rounds, from entries drawn evenly out of the sample."""
    n, width = sample.shape
    pieces = max(1, math.ceil(width / piece))
    x = np.zeros((n, pieces * piece))
    x[:, :width] = sample
    books = np.empty((pieces, min(entries, n), piece))
    for k in range(pieces):
        own = x[:, k * piece : (k + 1) * piece]
        book = own[np.linspace(0, n - 1, books.shape[1]).astype(np.int64)].copy()
        for _ in range(rounds):
            code = nearest(own, book)
            count = np.bincount(code, minlength=len(book))
            total = np.stack([np.bincount(code, own[:, j], len(book)) for j in range(piece)], axis=1)
            book[count > 0] = total[count > 0] / count[count > 0, None]
        books[k] = book
    return books


def nearest(own: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (((book**2).sum(axis=1) / 2) - own @ book.T).argmin(axis=1)


def _fit(x: np.ndarray, width: int) -> np.ndarray:
    """The first `width` components, filled up with zeros."""
    return np.pad(x[:, :width], ((0, 0), (0, max(0, width - x.shape[1]))))


def coded(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and residual norms of vectors of any width; what lies beyond the codebooks is residual."""
    pieces, _, piece = books.shape
    own = _fit(x, pieces * piece)
    codes = np.empty((len(x), pieces), np.uint8)
    left = (x[:, pieces * piece :] ** 2).sum(axis=1)
    for k in range(pieces):
        part = own[:, k * piece : (k + 1) * piece]
        codes[:, k] = nearest(part, books[k])
        left += ((part - books[k][codes[:, k]]) ** 2).sum(axis=1)
    return codes, np.sqrt(left)


def bounds(q: np.ndarray, codes: np.ndarray, residual: np.ndarray, books: np.ndarray, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of anchors (rows) with vectors (columns); `longest` is the largest norm of these."""
    pieces, _, piece = books.shape
    own = _fit(q, pieces * piece)
    about = np.zeros((len(q), len(codes)))
    for k in range(pieces):
        about += (own[:, k * piece : (k + 1) * piece] @ books[k].T)[:, codes[:, k]]
    norm = np.sqrt((q**2).sum(axis=1))[:, None]
    off = norm * residual + 1e-9 * norm * longest + 1e-6  # and what floating point may round
    return about - off, about + off


def _kth(x: np.ndarray, k: int) -> float:
    """The k-th largest, or nothing to reach if there are fewer."""
    return np.partition(x, len(x) - k)[len(x) - k] if len(x) >= k else -math.inf


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, ~scores))[:k]  # ~ sorts in falling order


class _Shard:
    """The rows of a shard, in a task."""

    def __init__(self, rows: pa.Table, books: np.ndarray, width: int):
        self.ids, self.labels = np.asarray(rows.column("id")), np.asarray(rows.column("label"))
        self.vectors = matrix(rows.column("vec"), width)
        self.codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(len(self.ids), books.shape[0])
        self.residual = np.asarray(rows.column("residual"))
        exact = self.vectors.astype(np.float64)
        self.longest, self.books = float(np.sqrt((exact**2).sum(axis=1).max())), books

    def bounds(self, q: np.ndarray, at: np.ndarray):
        return bounds(q.astype(np.float64), self.codes[at], self.residual[at], self.books, self.longest)

    def scores(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        return products(q[None], self.vectors[at])[0]

    def positives(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, k: int):
        """(anchor, id, score) of the k best rows with the anchor's label."""
        for label in np.unique(labels).tolist():
            at = np.flatnonzero(self.labels == label)
            some = np.flatnonzero(labels == label)
            for first in range(0, len(some) if len(at) else 0, HELD):
                held = some[first : first + HELD]
                low, high = self.bounds(q[held], at)
                for i, a in enumerate(held.tolist()):
                    other = self.ids[at] != ids[a]
                    near = at[other & (high[i] >= _kth(low[i][other], k))]
                    scores = self.scores(q[a], near)
                    for j in _best(self.ids[near], scores, k).tolist():
                        yield int(ids[a]), int(self.ids[near[j]]), int(scores[j])

    def negatives(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, windows: list, k: int):
        """(anchor, place of the positive, id, score) of the k best rows of other labels in each window (place, least, most)."""
        everyone = np.arange(len(self.ids))
        for first in range(0, len(ids), HELD):
            low, high = self.bounds(q[first : first + HELD], everyone)
            for i in range(len(low)):
                a = first + i
                other = self.labels != labels[a]
                asked = []
                for place, least, most in windows[a]:
                    meets = other & (high[i] >= least) & (low[i] <= most)
                    inside = meets & (low[i] >= least) & (high[i] <= most)
                    asked.append((place, least, most, meets & (high[i] >= _kth(low[i][inside], k))))
                some = np.flatnonzero(np.logical_or.reduce([x[3] for x in asked])) if asked else everyone[:0]
                scores = self.scores(q[a], some)
                for place, least, most, _ in asked:
                    fits = np.flatnonzero((scores >= least) & (scores <= most))
                    for j in fits[_best(self.ids[some[fits]], scores[fits], k)].tolist():
                        yield int(ids[a]), place, int(self.ids[some[j]]), int(scores[j])


def sound_rows(df: DataFrame, label: Column | str, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec, label) of the rows that take part."""
    label = F.col(label) if isinstance(label, str) else label
    rows = df.select(F.col(id_col).alias("id"), label.cast("long").alias("label"), F.col(vec_col).alias("x"))
    return whole_vectors(rows.filter("label is not null"), "id", "x", scale, "label")


def hard_negatives(df: DataFrame, is_anchor, label: Column | str = "label", positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE, piece: int = PIECE, entries: int = ENTRIES, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), for each row that is_anchor(id column) holds for.

    Components become floor(scale * x); a score is the integer inner product with the anchor, higher ones come first,
    ties by the smaller id.  An anchor's positives are its first `positives` other rows of the same label; for each, the first
    `negatives` rows of other labels whose score is from `least` to `most` percent of the positive's are returned, all if there
    are fewer, and none for a negative positive score, whose window is empty.  Rows with a null id, label or vector, or with a null or
    non-finite component, take no part; shorter vectors, empty ones included, count as filled up with zeros.  Rows that share an id
    are separate candidates, but one anchor, that with the smallest label and vector; an anchor never meets rows of its own id.  An
    empty table gives an empty result; other columns, whatever their names, are ignored."""
    spark = df.sparkSession
    rows = sound_rows(df, label, scale, id_col, vec_col)
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("vec").toArrow()  # `sample` rows at most
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not drawn.num_rows:
        return spark.createDataFrame([], schema)
    books = codebooks(matrix(drawn.column("vec")).astype(np.float64), piece, min(entries, 256))
    width = books.shape[0] * books.shape[2]

    def code(batches):
        for b in batches:
            if b.num_rows:
                codes, residual = coded(matrix(b.column("vec"), width).astype(np.float64), books)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(residual)], names=[*b.schema.names, "codes", "residual"])

    index = checkpointed(rows.mapInArrow(code, "id long, vec array<long>, label long, codes binary, residual double"))
    shards = max(1, math.ceil(index.count() / shard))
    anchors = index.filter(is_anchor(F.col("id"))).groupBy("id").agg(F.min(F.struct("label", "vec")).alias("a")).select("id", "a.*")
    blocks = max(1, math.ceil(anchors.count() / block))
    dealt = index.withColumn("shard", F.pmod(F.xxhash64("id", "label", "codes", "residual"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(asked: DataFrame, find, found: str) -> DataFrame:
        """find(shard, ids, labels, vectors, table of anchors) gives rows of `found`."""
        asked = asked.select([F.col(c).alias(c) for c in asked.columns])  # columns of its own, told from those of the index
        sent = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        names = [x.split()[0] for x in found.split(", ")]

        def each(left: pa.Table, right: pa.Table) -> pa.Table:
            out = []
            if left.num_rows and right.num_rows:
                wide = max(matrix(right.column("vec"), width).shape[1], matrix(left.column("vec"), width).shape[1])
                own = _Shard(left, books, wide)
                out = list(find(own, np.asarray(right.column("id")), np.asarray(right.column("label")), matrix(right.column("vec"), wide), right))
            return pa.table({c: pa.array([r[k] for r in out], pa.int64()) for k, c in enumerate(names)})

        return dealt.groupBy("shard", "block").cogroup(sent.groupBy("shard", "block")).applyInArrow(each, found)

    same = meet(anchors, lambda own, ids, labels, q, _: own.positives(ids, labels, q, positives), "id long, positive_id long, positive_score long")
    order = Window.partitionBy("id").orderBy(F.desc("positive_score"), "positive_id")
    best = checkpointed(same.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives))
    # 100 n >= least p and 100 n <= most p for whole n
    score = F.col("positive_score")
    scaled = best.select("id", F.col("place").cast("long").alias("place"), (-score * least).alias("a"), (score * most).alias("b"))
    floors = [(F.col(c) - F.pmod(F.col(c), F.lit(100))) for c in "ab"]  # multiples of 100
    scaled = scaled.select("id", "place", floors[0].alias("a"), floors[1].alias("b")).selectExpr("id", "struct(place, -(a div 100) AS least, b div 100 AS most) AS window")
    windows = scaled.groupBy("id").agg(F.collect_list("window").alias("windows"))  # `positives` a row

    def others(own: _Shard, ids, labels, q, table):
        spans = [[(w["place"], w["least"], w["most"]) for w in ws] for ws in table.column("windows").to_pylist()]
        return own.negatives(ids, labels, q, spans, negatives)

    found = meet(anchors.join(windows, "id"), others, "id long, place long, negative_id long, negative_score long")
    order = Window.partitionBy("id", "place").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return found.join(best, ["id", "place"]).select(F.col("id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
