"""Subject areas of documents by complement naive Bayes and expectation-maximization.

Sentences are the units: each is a bag of hashed words and word pairs. A
complement naive Bayes model is trained on the sentences of labelled documents,
with a further class for sentences without subject (clerical remarks, headings,
figures of speech). Expectation-maximization over all documents refines it until
its counts settle: sentences of unlabelled documents count by their posteriors. A
document's share of sentences per subject is turned into a posterior by one
logistic curve per subject, fitted to the labelled documents, each of them scored
by the model without its own counts; subjects are independent of each other.

Counts are summed per partition and merged by feature, so that what meets at the
driver, and what is broadcast, is the fixed table of FEATURES x (subjects + 1).
"""

from __future__ import annotations

import html
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.session import shared_folder, sized, staged
from tidepanel.sources.files import remove

#: Hashed features; bounds the model whatever the vocabulary.
FEATURES = 1 << 17
#: Most labelled documents used in training (smallest hashes first); all documents enter the EM.
LABELLED_BOUND = 100_000
#: Weight of an unlabelled sentence in the EM, smoothing, and log prior of a subject that a labelled document lacks.
UNLABELLED, ALPHA, ABSENT = 0.5, 0.1, -4.0
#: The EM ends when a pass moves less than SETTLED of the counts, or after PASSES; posteriors below NOTHING count as 0.
SETTLED, PASSES, NOTHING = 0.005, 8, 1e-9
#: A feature is specific if the subjects it occurs in diverge from the usual mix by more than DIVERGENCE of what
#: a feature of its main subject alone would; a sentence with a lower share of specific features than SPECIFIC seeds the class without subject.
DIVERGENCE, SPECIFIC = 0.2, 0.34
#: Prior of the calibration: slope, and share of sentences at which a subject is as likely as not.
SLOPE, HALF = 40.0, 0.18

#: Repeated phrases give repeated runs of hashes, which a dictionary's bit packing would hide from the compression.
PACKED = {"compression": "zstd", "parquet.enable.dictionary": "false"}

#: Markup; a "<" that isn't followed by a name is none, and no markup reaches past the next angle bracket.
_TAG = re.compile(r"</?[A-Za-z!?|][^<>]*>")
#: Words, and the breaks between sentences, which hold no word.
_TOKEN = re.compile(r"[^\W\d_]{2,}|(?<=[.!?;])\s+|[\n\r]+|\s--\s")


def text_features(texts: Sequence[str | None], words: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document of each sentence, features of each sentence, all features one after another).

    Markup, digits, case and punctuation are dropped; sentences without words are
    left out, so a null, empty or numeric text has none. A sentence's features are
    distinct and in order. ``words`` remembers hashes; a break has none (-1).
    """
    tokens: list[str] = []
    ends = []
    for text in texts:
        tokens += _TOKEN.findall(unicodedata.normalize("NFKC", html.unescape(_TAG.sub("\n", text or ""))).lower())
        ends.append(len(tokens))
    if len(words) > 500_000:
        words.clear()
    for w in {w for w in tokens if w not in words}:
        words[w] = zlib.crc32(w.encode("utf-8")) if not w[0].isspace() else -1
    codes = np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens))
    doc = np.repeat(np.arange(len(ends)), np.diff([0, *ends]))
    fresh = codes < 0
    fresh[1:] |= doc[1:] != doc[:-1]
    sentence = np.cumsum(fresh)
    is_word = codes >= 0
    codes, doc, sentence = codes[is_word].astype(np.uint64), doc[is_word], sentence[is_word]
    if not len(codes):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)
    starts = np.concatenate([[True], sentence[1:] != sentence[:-1]])
    sentence = np.cumsum(starts) - 1
    together = ~starts[1:]
    two = ((codes[:-1] * np.uint64(1_000_003) + codes[1:] * np.uint64(40_503)) % np.uint64(4_294_967_291))[together]
    feature = (np.concatenate([codes, two]) % np.uint64(FEATURES)).astype(np.int64)
    key = np.unique(np.concatenate([sentence, sentence[1:][together]]) * FEATURES + feature)
    return doc[starts], np.bincount(key // FEATURES), (key % FEATURES).astype(np.int32)


def sentence_features(text: str | None, words: dict[str, int]) -> tuple[list[int], np.ndarray]:
    """Feature counts per sentence of one text, and its features one after another."""
    _, lengths, features = text_features([text], words)
    return lengths.tolist(), features


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array whose row i holds the int32 values up to ``ends[i]``."""
    offsets = np.concatenate([[0], ends]).astype(np.int32) * 4
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values, np.int32))])


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a packed array, and how many each row has."""
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(np.int32) if data is not None and offsets[-1] > offsets[0] else np.empty(0, np.int32)
    return values, np.diff(offsets) // 4


def parse_documents(documents: DataFrame, *, key: Column, text: Column, mask: Column) -> DataFrame:
    """(key, mask, lengths, features) of every document; the last two are packed int32 values.

    They are binary so that they pass between the table and numpy as blocks.
    """
    rows = documents.select(key.cast("long").alias("key"), F.coalesce(mask, F.lit(0)).cast("long").alias("mask"), text.cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                doc, lengths, features = text_features(part.column(2).to_pylist(), words)
                upto = np.cumsum(np.bincount(doc, minlength=part.num_rows))
                sums = np.concatenate([[0], np.cumsum(lengths)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _packed(lengths, upto), _packed(features, sums[upto])], names=["key", "mask", "lengths", "features"])

    return rows.mapInArrow(run, "key long, mask long, lengths binary, features binary")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Masks per document, document of each sentence, sentence lengths, and features."""
    lengths, each = _unpacked(batch.column("lengths"))
    return batch.column("mask").to_numpy(zero_copy_only=False), np.repeat(np.arange(batch.num_rows), each), lengths, _unpacked(batch.column("features"))[0]


def sentence_posteriors(weights: np.ndarray, prior: np.ndarray, lengths: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Posterior of each class for each sentence; ``weights`` is (FEATURES, classes), ``prior`` (sentences, classes)."""
    if not len(lengths):
        return np.empty((0, weights.shape[1]))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    score = np.add.reduceat(weights[features], starts, axis=0).astype(float) + prior
    score -= score.max(axis=1, keepdims=True)
    out = np.exp(score)
    return out / out.sum(axis=1, keepdims=True)


def label_bits(masks: np.ndarray, subjects: int) -> np.ndarray:
    """(documents, subjects) of 0 and 1."""
    return (masks[:, None] >> np.arange(subjects)[None]) & 1


def complement_weights(counts: np.ndarray) -> np.ndarray:
    """Complement naive Bayes weights (FEATURES, classes) of ``counts`` in that shape."""
    rest = counts.sum(axis=1, keepdims=True) - counts
    return -np.log((rest + ALPHA) / (rest.sum(axis=0, keepdims=True) + ALPHA * FEATURES)).astype(np.float32)


def class_counts(lengths: np.ndarray, features: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature * classes + class of each, weight of each) where sentences have the class weights ``weight``.

    Only what isn't next to 0 is spread over a sentence's features: a sentence has few likely classes.
    """
    sentence, k = np.nonzero(weight > NOTHING)
    size = lengths[sentence]
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])[sentence]
    at = np.arange(size.sum()) + np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    return features[at].astype(np.int64) * weight.shape[1] + np.repeat(k, size), np.repeat(weight[sentence, k], size)


def _counted(parsed: DataFrame, subjects: int, assign) -> np.ndarray:
    """Class counts per feature, where ``assign(masks, doc, lengths, features)`` gives each sentence's class weights."""
    classes = subjects + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FEATURES * classes)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                masks, doc, lengths, features = _flat(batch.slice(at, 1000))
                if len(lengths):
                    cell, weight = class_counts(lengths, features, assign(masks, doc, lengths, features))
                    total += np.bincount(cell, weight, len(total))
        table = total.reshape(FEATURES, classes)
        there = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), *(pa.array(table[there, k]) for k in range(classes))], names=["feature", *(f"c{k}" for k in range(classes))])

    columns = [f"c{k}" for k in range(classes)]
    summed = parsed.select("mask", "lengths", "features").mapInArrow(run, "feature int, " + ", ".join(f"{c} double" for c in columns)).groupBy("feature").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()
    out = np.zeros((FEATURES, classes))
    at = summed.column("feature").to_numpy()
    for k, c in enumerate(columns):
        out[at, k] = summed.column(c).to_numpy()
    return out


def _even(masks: np.ndarray, doc: np.ndarray, subjects: int) -> np.ndarray:
    bits = label_bits(masks, subjects).astype(float)
    return np.concatenate([bits / np.maximum(bits.sum(axis=1, keepdims=True), 1), np.zeros((len(masks), 1))], axis=1)[doc]


def _prior(masks: np.ndarray, doc: np.ndarray, subjects: int) -> np.ndarray:
    """Log prior per sentence: flat where nothing is known, low for subjects a labelled document lacks."""
    lacks = (label_bits(masks, subjects) == 0) & (masks > 0)[:, None]
    return np.concatenate([np.where(lacks, ABSENT, 0.0), np.zeros((len(masks), 1))], axis=1)[doc]


def train(parsed: DataFrame, labelled: DataFrame, subjects: int) -> tuple[np.ndarray, np.ndarray]:
    """(class counts of the refined model, weights by which they were counted); without labels all are flat."""
    counts = _counted(labelled, subjects, lambda m, d, n, f: _even(m, d, subjects))[:, :subjects]
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1e-12)
    usual = counts.sum(axis=0) / max(counts.sum(), 1e-12)
    diverged = (share * np.log(np.maximum(share, 1e-12) / np.maximum(usual, 1e-12))).sum(axis=1)
    specific = diverged > DIVERGENCE * -np.log(np.maximum(usual[share.argmax(axis=1)], 1e-12))
    context = labelled.sparkSession.sparkContext
    held = context.broadcast(specific)

    def seeded(masks: np.ndarray, doc: np.ndarray, lengths: np.ndarray, features: np.ndarray) -> np.ndarray:
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        vague = np.add.reduceat(held.value[features].astype(float), starts) / lengths < SPECIFIC
        out = _even(masks, doc, subjects)
        out[vague] = 0.0
        out[vague, subjects] = 1.0
        return out

    counts = _counted(labelled, subjects, seeded)
    held.unpersist()
    for n in range(PASSES):
        before, weights = counts, complement_weights(counts)
        sent = context.broadcast(weights)

        def refined(masks: np.ndarray, doc: np.ndarray, lengths: np.ndarray, features: np.ndarray, sent=sent) -> np.ndarray:
            return _labelled_posteriors(sent.value, masks, doc, lengths, features, subjects) * np.where(masks > 0, 1.0, UNLABELLED)[doc][:, None]

        counts = _counted(parsed, subjects, refined)
        sent.unpersist()
        # the first pass brings the unlabelled documents in, so only later ones can show that the counts have settled
        if n and np.abs(counts - before).sum() <= SETTLED * max(counts.sum(), 1e-12):
            break
    return counts, weights


def _labelled_posteriors(weights: np.ndarray, masks: np.ndarray, doc: np.ndarray, lengths: np.ndarray, features: np.ndarray, subjects: int) -> np.ndarray:
    return sentence_posteriors(weights, _prior(masks, doc, subjects), lengths, features)


def _shares(found: np.ndarray, doc: np.ndarray, documents: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents that have sentences, and the share of their sentences per subject."""
    n = np.bincount(doc, minlength=documents)
    keep = np.flatnonzero(n)
    sums = np.stack([np.bincount(doc, found[:, k], documents) for k in range(found.shape[1] - 1)], axis=1)
    return keep, sums[keep] / n[keep, None]


def _share_batch(part: pa.RecordBatch, keep: np.ndarray, shares: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(np.arange(len(keep) + 1, dtype=np.int32) * shares.shape[1], pa.array(shares.ravel()))
    return pa.RecordBatch.from_arrays([part.column("key").take(pa.array(keep)), part.column("mask").take(pa.array(keep)), lists], names=["key", "mask", "shares"])


def subject_shares(parsed: DataFrame, weights: np.ndarray) -> DataFrame:
    """(key, mask, shares): the share of a document's sentences per subject; none for documents without words."""
    sent = parsed.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                masks, doc, lengths, features = _flat(part)
                found = sentence_posteriors(sent.value, np.zeros((1, sent.value.shape[1])), lengths, features)
                yield _share_batch(part, *_shares(found, doc, len(masks)))

    return parsed.select("key", "mask", "lengths", "features").mapInArrow(run, "key long, mask long, shares array<double>")


def held_out_shares(labelled: DataFrame, counts: np.ndarray, weights: np.ndarray, subjects: int) -> DataFrame:
    """(key, mask, shares) of labelled documents, each scored by the model without that document's own counts.

    ``weights`` are those by which the last pass counted the document, ``counts`` its result.
    """
    sent = labelled.sparkSession.sparkContext.broadcast((counts, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, weights = sent.value
        classes, totals = counts.shape[1], counts.sum(axis=0)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                masks, doc, lengths, features = _flat(part)
                own = _labelled_posteriors(weights, masks, doc, lengths, features, subjects)
                # one row per (document, feature): the document's own counts there
                of = np.repeat(doc, lengths).astype(np.int64) * FEATURES + features
                pairs, row = np.unique(of, return_inverse=True)
                cell, weight = class_counts(lengths, np.arange(len(features)), own)
                there = row[cell // classes] * classes + cell % classes
                mine = np.bincount(there, weight, len(pairs) * classes).reshape(-1, classes)
                spent = np.stack([np.bincount(pairs // FEATURES, mine[:, k], len(masks)) for k in range(classes)], axis=1) if len(pairs) else np.zeros((len(masks), classes))
                left = np.maximum(counts[pairs % FEATURES] - mine, 0.0)
                rest = left.sum(axis=1, keepdims=True) - left
                total = np.maximum(totals - spent, 0.0)[pairs // FEATURES]
                without = -np.log((rest + ALPHA) / (total.sum(axis=1, keepdims=True) - total + ALPHA * FEATURES))
                found = sentence_posteriors(without, np.zeros((1, classes)), lengths, row)
                yield _share_batch(part, *_shares(found, doc, len(masks)))

    return labelled.select("key", "mask", "lengths", "features").mapInArrow(run, "key long, mask long, shares array<double>")


def calibrate(shares: np.ndarray, bits: np.ndarray) -> list[tuple[float, float]]:
    """(slope, share at one half) of each subject's logistic curve, by maximum a posteriori."""
    out = []
    for k in range(bits.shape[1]):
        x, y = (shares[:, k], bits[:, k]) if len(shares) else (np.empty(0), np.empty(0))
        centre = np.array([SLOPE, -SLOPE * HALF])
        beta, spread = centre.copy(), np.diag([1 / 10.0**2, 1 / 2.0**2])
        design = np.stack([x, np.ones(len(x))], axis=1)
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
            gradient = design.T @ (y - p) - spread @ (beta - centre)
            hessian = design.T @ (design * (p * (1 - p))[:, None]) + spread
            step = np.linalg.solve(hessian, gradient)
            beta += np.clip(step, -5, 5)
            beta[0] = max(beta[0], 5.0)
        out.append((float(beta[0]), float(-beta[1] / beta[0])))
    return out


def assign_subjects(documents: DataFrame, labels: DataFrame, names: list[str], *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, subject, share, posterior) for every document with words and every subject of ``names``.

    ``labels`` (key, subject) holds all subjects of some documents; unknown
    subjects, nulls and repeats in it are ignored. Documents that are null, empty
    or without words get no rows. Texts are read whole; every document enters the
    counts, however often it repeats. Empty tables give no rows.
    """
    names = sorted(set(names))
    if len(names) > 62:
        raise ValueError("at most 62 subjects fit into the label mask")
    codes = F.create_map(*[x for k, n in enumerate(names) for x in (F.lit(n), F.lit(1 << k))])
    marked = labels.filter(F.col(key).isNotNull() & F.col("subject").isin(names)).select(F.col(key).alias("_key"), "subject").distinct().groupBy("_key").agg(F.sum(codes[F.col("subject")]).cast("long").alias("_mask"))
    # a bounded sample of the labelled documents, by hash
    marked = marked.orderBy(F.xxhash64("_key"), "_key").limit(LABELLED_BOUND)
    joined = documents.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(sized(marked), F.col("_id") == F.col("_key"), "left")
    spark = documents.sparkSession
    folder = f"{shared_folder(spark)}/subjects-{uuid.uuid4().hex}"
    # labelled documents in a folder of their own, so that a pass over them reads nothing else
    parse_documents(joined, key=F.col("_id"), text=F.col("_text"), mask=F.col("_mask")).withColumn("labelled", F.col("mask") > 0).write.options(**PACKED).partitionBy("labelled").parquet(f"{folder}/parsed")
    parsed = spark.read.schema("key long, mask long, lengths binary, features binary, labelled boolean").parquet(f"{folder}/parsed")
    labelled = parsed.filter("labelled")
    counts, weights = train(parsed, labelled, len(names))
    known = held_out_shares(labelled, counts, weights, len(names)).toArrow()
    shares = np.array(known.column("shares").to_pylist(), float).reshape(-1, len(names))
    curves = calibrate(shares, label_bits(known.column("mask").to_numpy(), len(names)))
    weights = complement_weights(counts)
    curve = F.array(*[F.struct(F.lit(n).alias("subject"), F.lit(a).alias("slope"), F.lit(b).alias("half")) for n, (a, b) in zip(names, curves, strict=True)])
    # the shares are staged, so that the parsed texts needn't outlive the call
    shares_of_all = staged(subject_shares(parsed, weights))
    remove(spark, folder)
    each = shares_of_all.select("key", F.explode(F.arrays_zip(curve.alias("curve"), F.col("shares"))).alias("x"))
    posterior = 1 / (1 + F.exp(-F.col("x.curve.slope") * (F.col("x.shares") - F.col("x.curve.half"))))
    return each.select(F.col("key").alias(key), F.col("x.curve.subject").alias("subject"), F.col("x.shares").alias("share"), posterior.alias("posterior"))
