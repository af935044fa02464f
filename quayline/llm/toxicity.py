"""Toxicity: a counterfactual-regularised classifier.

A logistic model over the words of a document and the beginnings of longer words.  Sentences of
the labelled documents that name a group of people are repeated with another group's name, and the
difference of the two scores is penalised: what the model may not learn is that naming a group is
toxic, so that neutral mentions are not reported.

The model is fitted in one task on a bounded sample of the labelled rows (``Settings.per_class``
of each class, ``Settings.chars`` characters each); scoring covers all documents.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from quayline.llm.common import arrow_function, map_batches, plain_strings, slices

THRESHOLD = 0.3
HELD_OUT = 2
FOLDS = 4
NOT_A_WORD = r"[^\p{L}\p{N}]+"
SENTENCE_END = re.compile(r"[.!?\n]+")
# a feature is a whole word (0) or the first so many letters of a longer one
PREFIXES = (3, 4, 5, 6, 7, 8)

# names of groups that may stand for one another in a sentence: fixed values
IDENTITY_GROUPS = [
    "women men girls boys people".split(),
    "woman man girl boy person".split(),
    "female male".split(),
    "muslim christian jewish hindu buddhist catholic atheist".split(),
    "muslims christians jews hindus buddhists catholics atheists".split(),
    "gay straight lesbian bisexual transgender heterosexual".split(),
    "black white asian latino african european american arab".split(),
    "immigrant refugee foreigner native citizen".split(),
    "immigrants refugees foreigners natives citizens".split(),
    "disabled blind deaf old young elderly".split(),
    "german french spanish english italian polish turkish chinese mexican indian russian".split(),
    "frauen männer mädchen jungen".split(),
    "muslime christen juden buddhisten".split(),
    "ausländer flüchtlinge deutsche türken franzosen polen".split(),
    "femmes hommes filles garçons".split(),
    "musulmans chrétiens juifs bouddhistes".split(),
    "immigrés réfugiés étrangers français allemands arabes".split(),
    "mujeres hombres chicas chicos".split(),
    "musulmanes cristianos judíos budistas".split(),
    "inmigrantes refugiados extranjeros españoles alemanes gitanos".split(),
]


@dataclass(frozen=True)
class Settings:
    """``per_class``: labelled documents of each class in the sample, lowest hashes first, of at most
    ``chars`` characters; ``features``: the most that the model has; ``sentences``: sentences of the
    sample that are repeated with other names, at most."""

    per_class: int = 3000
    chars: int = 50_000
    features: int = 4000
    documents: int = 3
    sparsity: float = 2e-4
    counterfactual: float = 1.0
    sentences: int = 3000
    rounds: int = 400


class Model(NamedTuple):
    """Features by kind (0 or prefix length), each with its weight, and the bias."""

    features: dict[int, list[str]]
    weights: np.ndarray
    bias: float


def word_table(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-case words, the word of each occurrence, and each text's first occurrence."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts), NOT_A_WORD)
    coded = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), offsets - offsets[0]


def prefixes(words: pa.Array, length: int) -> pa.Array:
    """The beginning of longer words, null for others."""
    longer = pc.greater(pc.utf8_length(words), length)
    return pc.if_else(longer, pc.utf8_slice_codeunits(words, 0, length), pa.scalar(None, words.type))


def features_of(words: pa.Array, model: Model) -> np.ndarray:
    """A row for each word: its features' numbers, -1 where it has none of a kind."""
    columns, first = [], 0
    for kind in (0, *PREFIXES):
        known = model.features.get(kind, [])
        keys = words if kind == 0 else prefixes(words, kind)
        found = pc.index_in(keys, value_set=pa.array(known, words.type), skip_nulls=True)
        columns.append(pc.fill_null(pc.add(found.cast(pa.int64()), first), -1).to_numpy(zero_copy_only=False))
        first += len(known)
    return np.stack(columns, axis=1)


def present(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (text, feature) of the features that occur in each text, once each."""
    words, occurrences, offsets = word_table(texts)
    table = features_of(words, model)
    hit = (table >= 0).any(axis=1)
    at = np.flatnonzero(hit[occurrences])
    text = np.searchsorted(offsets, at, side="right") - 1
    found = table[occurrences[at]]
    width = max(1, len(model.weights))
    keys = np.unique((text[:, None] * width + found)[found >= 0])
    return keys // width, keys % width


def logits(texts: pa.Array, model: Model) -> np.ndarray:
    text, feature = present(texts, model)
    return model.bias + np.bincount(text, weights=model.weights[feature], minlength=len(texts))


def scores(texts: pa.Array, model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logits(texts, model), -40, 40)))


def candidates(texts: pa.Array, toxic: np.ndarray, settings: Settings) -> dict[int, list[str]]:
    """The features that tell the classes apart best, by the difference of their shares of
    documents in units of its standard error."""
    words, occurrences, offsets = word_table(texts)
    # each word of a text once
    once = np.unique(np.repeat(np.arange(len(texts)) * len(words), np.diff(offsets)) + occurrences)
    text, occurrences = once // max(1, len(words)), once % max(1, len(words))
    del once, offsets
    sizes = np.array([max(1, (~toxic).sum()), max(1, toxic.sum())])
    found = []
    for kind in (0, *PREFIXES):
        coded = (words if kind == 0 else prefixes(words, kind)).dictionary_encode()
        names = coded.dictionary.to_pylist()
        numbers = pc.fill_null(coded.indices.cast(pa.int64()), -1).to_numpy(zero_copy_only=False)[occurrences]
        pairs = np.unique((text * (len(names) + 1) + numbers)[numbers >= 0])
        owner, feature = pairs // (len(names) + 1), pairs % (len(names) + 1)
        counts = np.stack([np.bincount(feature[toxic[owner] == c], minlength=len(names)) for c in (False, True)])
        shares = (counts + 0.5) / (sizes[:, None] + 1)
        error = np.sqrt((shares * (1 - shares) / sizes[:, None]).sum(axis=0))
        z = np.abs(shares[1] - shares[0]) / error
        enough = np.flatnonzero(counts.sum(axis=0) >= settings.documents)
        best = enough[np.argsort(-z[enough], kind="stable")][: settings.features]
        found += [(z[i], kind, names[i]) for i in best if names[i]]
    best = sorted(found, key=lambda f: (-f[0], f[1], f[2]))[: settings.features]
    return {kind: sorted(name for _, k, name in best if k == kind) for kind in (0, *PREFIXES)}


def swapped_sentences(texts: list[str], groups: list[list[str]], most: int) -> list[tuple[str, str, float]]:
    """Sentences that name a group, each beside the same sentence with every other name of its list, one name
    replaced at a time: ``(sentence, other, weight)``, the weights of a sentence adding up to 1.

    At most ``most`` sentences, spread over names and documents: in rounds every name gives the one
    of its sentences that is next by hash, so that no name and no document fills the bound."""
    list_of = {term: group for group in groups for term in group}
    named = re.compile(r"\b(" + "|".join(sorted(list_of, key=len, reverse=True)) + r")\b", re.IGNORECASE)
    by_name: dict[str, dict[str, int]] = {}
    for text in texts:
        for sentence in SENTENCE_END.split(text):
            for match in named.finditer(sentence):
                by_name.setdefault(match[0].lower(), {})[sentence] = zlib.crc32(sentence.encode())
    queues = [sorted(own, key=lambda s, own=own: (own[s], s)) for _, own in sorted(by_name.items())]
    chosen: dict[str, None] = {}
    for turn in range(max(map(len, queues), default=0)):
        for queue in queues:
            if turn < len(queue) and len(chosen) < most:
                chosen[queue[turn]] = None
    pairs = []
    for sentence in chosen:
        found = [(m, other) for m in named.finditer(sentence) for other in list_of[m[0].lower()] if other != m[0].lower()]
        pairs += [(sentence, sentence[: m.start()] + other + sentence[m.end() :], 1 / len(found)) for m, other in found]
    return pairs


def fit(texts: list[str], toxic: list[bool], share: float, settings: Settings = Settings(), groups=IDENTITY_GROUPS) -> Model:
    """A model of texts of which, in all, ``share`` are toxic; rows are weighted to that share.

    Without rows of both classes the model has no features, and its score is the share."""
    share = min(max(share, 1e-3), 1 - 1e-3)
    prior = float(np.log(share / (1 - share)))
    label = np.array(toxic, bool)
    if not label.any() or label.all():
        return Model({}, np.empty(0), prior)
    column = pa.array(texts, pa.large_string())
    model = Model(candidates(column, label, settings), np.empty(0), prior)
    width = sum(map(len, model.features.values()))
    model = model._replace(weights=np.zeros(width))
    row, feature = present(column, model)
    own = np.where(label, share / label.sum(), (1 - share) / (~label).sum())
    pairs = swapped_sentences(texts, groups, settings.sentences)
    weight = np.array([w for _, _, w in pairs])
    # +1 for a feature of the sentence, -1 for one of the swapped sentence: only these differ
    one, other = (present(pa.array([p[side] for p in pairs], pa.large_string()), model) if pairs else (np.empty(0, np.int64),) * 2 for side in (0, 1))
    pair = np.concatenate([one[0], other[0]])
    changed = np.concatenate([one[1], other[1]])
    sign = np.concatenate([np.ones(len(one[0])), -np.ones(len(other[0]))])

    def gradient(w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        z = b + np.bincount(row, weights=w[feature], minlength=len(label))
        residual = own * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label)
        g = np.bincount(feature, weights=residual[row], minlength=width)
        if pairs:
            difference = np.bincount(pair, weights=sign * w[changed], minlength=len(pairs))
            penalty = np.bincount(changed, weights=sign * (weight * difference)[pair], minlength=width)
            g += settings.counterfactual * penalty / weight.sum()
        return g, float(residual.sum())

    # a step that the curvature allows: rows have so many features at most, weights sum to 1
    squares = np.bincount(row, minlength=len(label)) + 1
    step = 1 / (0.25 * float((own * squares).sum()) + settings.counterfactual * (float(np.bincount(pair).max()) if len(pair) else 0))
    w, b, ahead_w, ahead_b, t = np.zeros(width), prior, np.zeros(width), prior, 1.0
    for _ in range(settings.rounds):
        g, gb = gradient(ahead_w, ahead_b)
        new_w = ahead_w - step * g
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * settings.sparsity, 0)
        new_b = ahead_b - step * gb
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead_w, ahead_b = new_w + (t - 1) / t_next * (new_w - w), new_b + (t - 1) / t_next * (new_b - b)
        w, b, t = new_w, new_b, t_next
    names = [(kind, name) for kind in (0, *PREFIXES) for name in model.features[kind]]
    kept = np.flatnonzero(w)
    features = {kind: [names[i][1] for i in kept if names[i][0] == kind] for kind in (0, *PREFIXES)}
    return Model(features, w[kept], float(b))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows whose labels the model never sees."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, float]:
    """At most ``per_class`` documents of each class (``text, toxic``) among the rows that are not
    held out nor too long, and the share of toxic ones among all labelled rows that are not held out.  An id with both labels is toxic;
    of documents with one id any one is taken."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    # of documents that are not too long for one task
    short = docs.where(F.length(F.coalesce("text", F.lit(""))) <= settings.chars).select("doc_id")
    known = known.join(short, "doc_id", "left_semi")
    order = F.xxhash64("doc_id")
    picked = [known.where(F.col("toxic") == c).orderBy(order, "doc_id").limit(settings.per_class) for c in (False, True)]
    picked = picked[0].unionByName(picked[1])
    # at most twice per_class ids
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= settings.chars)
    sample = sample.join(F.broadcast(picked), "doc_id")
    share = counts.get(True, 0) / max(1, sum(counts.values()))
    return sample.dropDuplicates(["doc_id"]).select("doc_id", "text", "toxic"), share


def trained(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """The model of the labelled documents, fitted in one task on the bounded sample; it comes to
    the driver as at most ``features`` rows."""
    sample, share = labelled_sample(docs, labels, settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))]
        rows.sort()
        model = fit([text for _, text, _ in rows], [label for _, _, label in rows], share, settings)
        names = [(kind, name) for kind, own in model.features.items() for name in own] + [(-1, "")]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([kind for kind, _ in names], pa.int32()),
                pa.array([name for _, name in names], pa.string()),
                pa.array([*model.weights.tolist(), model.bias], pa.float64()),
            ],
            names=["kind", "name", "weight"],
        )

    rows = map_batches(sample.repartition(1), run, "kind int, name string, weight double").collect()
    rows.sort(key=lambda r: (r.kind, r.name))
    bias = rows[0].weight if rows else 0.0
    features = {kind: [r.name for r in rows if r.kind == kind] for kind in (0, *PREFIXES)}
    return Model(features, np.array([r.weight for r in rows[1:]]), bias)


def score(docs: DataFrame, model: Model, text: str | Column = "text") -> Column:
    """The score of each text, 0 to 1; null and empty texts have the bias's."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_function("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [scores(part, shipped.value) for part in slices(plain_strings(batch))]
            yield pa.array(np.concatenate(parts) if parts else np.empty(0))

    return run(text)


def scored(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    Null ids are not held out and have no labels; repeated rows score alike; without labels the
    score is the same for all; an empty table gives no rows."""
    model = trained(docs, labels, settings)
    rows = docs.select("doc_id", held_out().alias("held_out"), score(docs, model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def clean(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), threshold: float = THRESHOLD) -> DataFrame:
    """The rows below the threshold, with all their columns."""
    model = trained(docs, labels, settings)
    return docs.where(score(docs, model) < threshold)
