"""Quality by co-training: a text-content and a page-metadata classifier teach each other.

The content view sees what is written: hashed pairs of adjacent bytes, and how much the text repeats itself.  The metadata view sees what
describes a page beside its words: source, language, size, and the layout of its lines (how many, how long and how even, how many words and cells).
No feature is in both.  Both are logistic regressions.  In each round each scores all unlabelled documents of the part that may be learnt
from, and hands its most confident ones, with its own verdict as label, to the other; equal documents are handed over once.  Each
view is then calibrated on labelled documents set aside, a last logistic function joins the two, and every document is scored.

Fitting uses a bounded sample of labelled documents (``LABELLED``) and ``HANDED`` pseudo-labels a round; these are chosen from all unlabelled documents,
whose features (half-precision, a short row a document) are written once.  Scoring reads every whole text.

Cases: null and empty texts, null sources, languages and sizes have features of their own; without both labels every document
gets the share of good ones; null labels are ignored, and of several labels of an id the greatest counts; repeated rows are scored alike;
a table without the column ``n_chars`` takes the text's length; columns beyond those named are not read, and all are returned by ``accepted``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panemill.llm.common import crc_mod, discard, least_hashes, written

#: Labelled documents to fit on at most.
LABELLED = 6000
ROUNDS = 4
#: Documents that a view hands over in a round at most, of each class, and how sure it must be.
HANDED, SURE = 150, 0.97
#: Parts in which the surest documents are looked for first.
PARTS = 32
#: A document is rejected when its chance of being good is below this.
THRESHOLD = 0.4
CONTENT, SOURCES = 256, 16
#: Features of the content view.
SPLIT_AT = CONTENT + 2
_pair = ((np.arange(65536, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.int64).reshape(256, 256)


def content_view(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    pairs = np.bincount(_pair[raw[:-1], raw[1:]], minlength=CONTENT) if len(raw) > 1 else np.zeros(CONTENT)
    words = (text or "").split()
    n = max(1, len(words))
    shares = np.sqrt(pairs / max(1, len(raw) - 1))
    return np.concatenate([shares * 4, [len(set(words)) / n, sum(map(str.__eq__, words, words[1:])) / n * 4]])


def metadata_view(text: str | None, source: str | None, lang: str | None, size: int | None) -> np.ndarray:
    lines = (text or "").split("\n")
    lengths = np.array([len(line) for line in lines], float)
    size = len(text or "") if size is None else size
    words = max(1, (text or "").count(" ") + len(lines))
    cells = (text or "").count("|") + (text or "").count("\t")
    hashed = np.zeros(2 * SOURCES)
    hashed[zlib.crc32((source or "").encode()) % SOURCES] = 0.3
    hashed[SOURCES + zlib.crc32((lang or "").encode()) % SOURCES] = 0.3
    layout = [
        np.log1p(max(0, size)) / 5, np.log1p(len(lines)) / 3, np.log1p(lengths.mean()) / 5, np.log1p(lengths.std()) / 5, np.log1p(lengths.max()) / 5,
        min(len(text or "") / words, 40) / 10, min(1.0, cells / words) * 3, float((lengths == 0).mean()), float(not text), float(source is None), float(lang is None),
    ]
    return np.concatenate([layout, hashed])


def _fitted(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the offset."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-5:
            break
    return w


def _logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -20, 20)


def combined(weights: list[np.ndarray], views: list[np.ndarray], y: np.ndarray) -> dict:
    """Calibrations of both views' weights, and of the joint score, from labelled documents set aside."""
    calibrated = [_fitted(_logits(v, w)[:, None], y, 0.05) for v, w in zip(views, weights, strict=True)]
    both = np.stack([_logits(_logits(v, w)[:, None], c) for v, w, c in zip(views, weights, calibrated, strict=True)], axis=1)
    return {"views": weights, "calibrated": calibrated, "joint": _fitted(both, y, 0.05)}


def score(model: dict, views: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chances of being good: by content, by metadata, by both."""
    if "views" not in model:
        return tuple(np.full(len(views[0]), model["share"]) for _ in range(3))
    each = [_logits(_logits(v, w)[:, None], c) for v, w, c in zip(views, model["views"], model["calibrated"], strict=True)]
    joint = _logits(np.stack(each, axis=1), model["joint"])
    return tuple(1 / (1 + np.exp(-x)) for x in (*each, joint))


COLUMNS = ("text", "source", "lang", "size")


def _views(texts: list, sources: list, langs: list, sizes: list) -> list[np.ndarray]:
    content = np.array([content_view(t) for t in texts]).reshape(len(texts), -1)
    metadata = np.array([metadata_view(*row) for row in zip(texts, sources, langs, sizes, strict=True)]).reshape(len(texts), -1)
    return [content, metadata]


def _read(docs: DataFrame, text_col: str) -> list:
    size = docs["n_chars"] if "n_chars" in docs.columns else F.length(docs[text_col])
    return [docs[text_col].alias("text"), docs["source"].alias("source"), docs["lang"].alias("lang"), size.cast("long").alias("size")]


def _unpacked(packed: list[bytes]) -> list[np.ndarray]:
    x = np.frombuffer(b"".join(packed), np.float16).reshape(len(packed), -1).astype(float)
    return [x[:, :SPLIT_AT], x[:, SPLIT_AT:]]


def featured(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """id, views (both views' features), label (or null), key (equal for equal features), of the documents that may be learnt from; written."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                own = batch.slice(at, 500)
                views = _views(*(own.column(c).to_pylist() for c in COLUMNS))
                packed = [v.astype(np.float16).tobytes() for v in np.hstack(views)]
                yield pa.RecordBatch.from_arrays([own.column("id"), pa.array(packed, pa.binary())], names=["id", "views"])

    rows = docs.select(docs[id_col].alias("id"), *_read(docs, text_col)).where(F.coalesce(crc_mod(F.col("id"), 3) != 1, F.lit(True)))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    return written(rows.mapInArrow(run, f"id {kind}, views binary").join(known, "id", "left").withColumn("key", F.xxhash64("views")), "features")


def _handed(features: DataFrame, weights: list[np.ndarray], taken: set[int], quotas: dict[int, int]) -> list[tuple[int, int, int, list[np.ndarray]]]:
    """(view, label, key, features) of the unlabelled documents that each view is surest of: best first of all of them, not of a sample."""
    model = features.sparkSession.sparkContext.broadcast((weights, taken))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, taken = model.value
        for batch in batches:
            if len(batch):
                views, key = _unpacked(batch.column(1).to_pylist()), np.array(batch.column(0).to_pylist(), np.int64)
                free = ~np.isin(key, np.array(sorted(taken), np.int64))
                for k in (0, 1):
                    p = 1 / (1 + np.exp(-_logits(views[k], weights[k])))
                    for label, sure in ((1, p), (0, 1 - p)):
                        own = free & (sure >= SURE)
                        n = int(own.sum())
                        yield pa.RecordBatch.from_arrays([pa.array([2 * k + label] * n, pa.int32()), pa.array(key[own]), pa.array(sure[own])], names=["kind", "key", "sure"])

    scored = features.where("label is null").select("key", "views").mapInArrow(run, "kind int, key long, sure double")
    best = scored.groupBy("kind", "key").agg(F.max("sure").alias("sure"))
    # The best of each part, then the best of those: no task reads the best of all other tasks.
    most, order = max(quotas.values()), [F.desc("sure"), "key"]
    best = best.withColumn("part", F.pmod("key", F.lit(PARTS)))
    for keys in (["kind", "part"], ["kind"]):
        best = best.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= most)
    chosen = best.orderBy("kind", "place").collect()  # four times HANDED rows at most
    chosen = [(r["kind"] // 2, r["kind"] % 2, r["key"]) for r in chosen if r["place"] <= quotas[r["kind"] % 2]]
    wanted = sorted({key for _, _, key in chosen})
    if not wanted:
        return []
    views = {r["key"]: r["views"] for r in features.where(F.col("key").isin(wanted)).groupBy("key").agg(F.first("views").alias("views")).collect()}
    return [(k, label, key, _unpacked([views[key]])) for k, label, key in chosen]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> dict:
    """The model: weights of both views, of their calibrations, and of the joint score."""
    features = featured(docs, labels, id_col, text_col, label_col)
    model = _fit(features)
    discard(features)
    return model


def _fit(features: DataFrame) -> dict:
    known = features.where("label is not null").select("id", "label", "views", "key")
    sample = least_hashes(known, F.xxhash64("id", "key"), LABELLED, known.count(), "id", "label", "key").toArrow().to_pylist()
    y = np.array([r["label"] for r in sample], float)
    share = float(y.mean()) if len(y) else 1.0
    turn = np.random.Generator(np.random.PCG64(3)).permutation(len(y)) % 4  # whatever order the ids bring
    learn, aside = turn > 0, turn == 0
    if any(len(set(y[part].tolist())) < 2 for part in (learn, aside)):
        return {"share": share}
    views = _unpacked([r["views"] for r in sample])
    rows, marks = [[v[learn]] for v in views], [[y[learn]], [y[learn]]]
    quotas = {label: max(1, round(HANDED * (share if label else 1 - share))) for label in (0, 1)}
    taken: set[int] = set()
    for round_ in range(ROUNDS + 1):
        weights = [_fitted(np.vstack(rows[k]), np.concatenate(marks[k])) for k in (0, 1)]
        if round_ == ROUNDS:
            break
        handed = _handed(features, weights, taken, quotas)
        for k, label, key, own in handed:
            if key not in taken:  # a document that both are sure of goes to one of them only
                rows[1 - k].append(own[1 - k])
                marks[1 - k].append(np.array([float(label)]))
                taken.add(key)
        if not handed:
            break
    return {"share": share} | combined(weights, [v[aside] for v in views], y[aside])


def _batch_scores(model: dict, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [score(model, _views(*(batch.column(c).slice(at, 500).to_pylist() for c in COLUMNS))) for at in range(0, len(batch), 500)]
    return tuple(np.concatenate([p[k] for p in parts] or [np.zeros(0)]) for k in range(3))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """id, held_out (never learnt from), content_score, metadata_score, score (chances of being good), kept."""
    kind = docs.schema[id_col].dataType.simpleString()
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _batch_scores(model.value, batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(s, pa.float64()) for s in scores)], names=["id", "content_score", "metadata_score", "score"])

    rows = docs.select(docs[id_col].alias("id"), *_read(docs, text_col))
    scored = rows.mapInArrow(run, f"id {kind}, content_score double, metadata_score double, score double")
    held_out = F.coalesce(crc_mod(F.col("id"), 3) == 1, F.lit(False)).alias("held_out")
    return scored.select(F.col("id").alias(id_col), held_out, "content_score", "metadata_score", "score", (F.col("score") >= THRESHOLD).alias("kept"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The documents that are not rejected, all columns, without a shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(text_col), batch.column("source"), batch.column("lang")]
            own.append(batch.column("n_chars").cast(pa.int64()) if "n_chars" in batch.schema.names else pc.utf8_length(own[0]).cast(pa.int64()))
            scores = _batch_scores(model.value, pa.RecordBatch.from_arrays(own, names=list(COLUMNS)))
            yield batch.filter(pa.array(scores[2] >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
