"""Toxicity: a gap-weighted subsequence string kernel with Nystrom landmarks and a linear support vector machine.

The instances are words in their sentence (letters of a white-space-delimited string; single letters in a row are one
word), for an insult is a word that may be stretched, split or stuffed with signs. The kernel counts common
subsequences of three and four letters, each weighted by DECAY to the length it spans, so inserted characters and
gaps cost weight and do not hide a word.
"""

from __future__ import annotations

import re
import unicodedata
from functools import partial
from itertools import combinations
from sys import intern

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import Recent, arrow_batches, fresh, stored

DECAY, SPAN, BITS, SURE = 0.6, 6, 16, 0.4
#: What a word can say at most for its document: one that is learnt by heart says no more than one beyond the margin.
MOST = 1.0
#: Letters that are put into insults to learn from.
STUFFING = "xeaqsihmtzruklpodgwncbfvyj"
#: Words whose values a task holds, half of them those in use of late.
MEMORY = 150_000
#: Words scored at a time: bounds the arrays of their subsequences.
SCORED = 5000
SPACED = re.compile(r"(?<!\S)\S(?: \S){3,}(?!\S)")
#: Offsets of the later letters of each subsequence that starts at a letter, within SPAN letters.
_GAPS = [c for k in (2, 3) for c in combinations(range(1, SPAN), k)]
_WEIGHT = np.array([DECAY ** (c[-1] + 1) for c in _GAPS])


def plain(token: str) -> str:
    """The letters of a string, in lower case: punctuation, digits and signs between them go."""
    token = token.lower()
    return token if token.isalpha() else "".join([c for c in unicodedata.normalize("NFC", token) if c.isalpha()])


def tokens(text: str | None) -> list[str]:
    """White-space-delimited strings; four or more single signs in a row, one blank apart, are one string as well."""
    found = (text or "").split()
    if found and " " in text:
        found += [m.group().replace(" ", "") for m in SPACED.finditer(text)]
    return found


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, weight) of the kernel's explicit features of each word, bounded by signs of start and end."""
    lengths = np.array([len(w) + 2 for w in words], dtype=np.int64)
    codes = np.frombuffer("".join([f"\x02{w}\x03" for w in words]).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    row = np.repeat(np.arange(len(words)), lengths)
    end = np.repeat(np.cumsum(lengths), lengths)
    at = np.arange(len(codes))
    rows, names, weights = [], [], []
    for gaps, weight in zip(_GAPS, _WEIGHT, strict=True):
        ok = at + gaps[-1] < end
        start = at[ok]
        name = codes[start] + 17
        for g in gaps:
            name = (name * 1000003) ^ codes[start + g]
        name = (name ^ (name >> 29)) * 0x5851F42D4C957F2D
        rows.append(row[ok])
        names.append((name >> 33) & ((1 << BITS) - 1))
        weights.append(np.full(len(start), weight))
    return np.concatenate(rows), np.concatenate(names), np.concatenate(weights)


def kernel_features(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each word its features, each once, and their weights at Euclidean norm 1: a dot product is the normalised kernel."""
    row, name, weight = subsequences(words)
    key = row * (1 << BITS) + name
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    weight = np.add.reduceat(weight, first) if len(first) else weight
    row, name = key[first] >> BITS, key[first] & ((1 << BITS) - 1)
    norm = np.sqrt(np.bincount(row, weight * weight, len(words)))
    weight = weight / np.maximum(norm[row], 1e-300)
    cuts = np.searchsorted(row, np.arange(len(words) + 1))
    return [(name[a:b], weight[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def dense(words: list[str]) -> np.ndarray:
    out = np.zeros((len(words), 1 << BITS), dtype=np.float32)
    for k, (name, weight) in enumerate(kernel_features(words)):
        out[k, name] = weight
    return out


def landmark_map(landmarks: list[str], floor: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Dense features L of the landmarks and the Nystrom map W^(-1/2) of their kernel matrix."""
    base = dense(landmarks)
    values, vectors = np.linalg.eigh((base @ base.T).astype(np.float64))
    keep = values > floor
    return base, vectors[:, keep] / np.sqrt(values[keep])


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Linear support vector machine (squared hinge), solved in the primal by Newton steps on the active set."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-3
    active = None
    for _ in range(rounds):
        now = y * (x1 @ w) < 1
        if active is not None and (now == active).all():
            break
        active = now
        a = x1[active] * (c * weight[active])[:, None]
        w = np.linalg.solve(ridge + a.T @ x1[active], a.T @ y[active])
    return w[:-1], float(w[-1])


def score_words(words: list[str], v: np.ndarray, bias: float) -> np.ndarray:
    """Decision values: the landmark expansion collapses to one weight for each feature."""
    out = np.full(len(words), -2.0)
    some = [k for k, w in enumerate(words) if w]
    if some:
        row, name, weight = subsequences([words[k] for k in some])
        key = row * (1 << BITS) + name
        order = np.argsort(key, kind="stable")
        key, weight = key[order], weight[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        weight = np.add.reduceat(weight, first) if len(first) else weight
        row, name = key[first] >> BITS, key[first] & ((1 << BITS) - 1)
        norm = np.sqrt(np.bincount(row, weight * weight, len(some)))
        out[some] = np.bincount(row, weight * v[name], len(some)) / np.maximum(norm, 1e-300) + bias
    return out


def _document_values(texts, v, bias, memory: Recent):
    """Of each text the highest decision value and the number of words above SURE; words met of late are looked up."""
    split = [tokens(t) for t in texts]
    new = memory.unknown({w for ws in split for w in ws})
    bare = {w: plain(w) for w in new}
    words, value = list(dict.fromkeys(bare.values())), {}
    for i in range(0, len(words), SCORED):
        part = words[i : i + SCORED]
        value.update(zip(part, score_words(part, v, bias).tolist(), strict=True))
    known = memory.now
    known.update([(w, value[p]) for w, p in bare.items()])
    out = []
    for ws in split:
        values = [known[w] for w in ws]
        out.append((max(values, default=-2.0), sum([x > SURE for x in values])))
    return out


def _score(batches, model):
    m, memory = model.value, Recent(MEMORY)
    for batch in batches:
        found = _document_values(batch.column(1).to_pylist(), m["v"], m["bias"], memory)
        x = np.array(found, dtype=np.float64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["doc_id", "top", "hits"])


def _with_values(batches, model, at, names):
    m, memory = model.value, Recent(MEMORY)
    for batch in batches:
        found = _document_values(batch.column(at).to_pylist(), m["v"], m["bias"], memory)
        x = np.array(found, dtype=np.float64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x[:, 0]), pa.array(x[:, 1])], names=[*batch.schema.names, *names])


def _squash(x, coef):
    z = coef[0] + coef[1] * np.minimum(x[:, 0], MOST) + coef[2] * np.log1p(x[:, 1])
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Coefficients of 1, the top value and log(1 + hits); both must speak for toxicity, else the top value stands alone."""
    for used in ([0, 1, 2], [0, 1]):
        z = np.column_stack([np.ones(len(x)), np.minimum(x[:, 0], MOST), np.log1p(x[:, 1])])[:, used]
        w = np.zeros(len(used))
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
            h = z.T @ (z * np.maximum(p * (1 - p), 1e-6)[:, None]) + 0.05 * np.eye(len(used))
            step = np.linalg.solve(h, z.T @ (y - p) - 0.05 * w)
            w = w + step
            if np.abs(step).max() < 1e-9:
                break
        if w[1] > 0 and w[-1] > 0:
            break
    return np.concatenate([w, np.zeros(3 - len(w))])


def cover(toxic_docs: list[set[str]], clean_docs: list[set[str]], least: int = 3, clean_share: float = 0.1) -> list[set[str]]:
    """Witness words of each toxic document, by greedy covering.

    A toxic document must hold an insult and a clean one none, so the marks sought (words, and starts of four to eight letters
    that inflected forms share) are those that explain the most toxic documents not yet explained and stand in next to
    no clean ones. Marks of fewer than `least` such documents are taken for chance.
    """
    def marks(d):
        return d | {w[:n] + "*" for w in d for n in (4, 5, 6, 7, 8) if len(w) > n}

    seen: dict[str, int] = {}
    for d in toxic_docs:
        for m in marks(d):
            seen[m] = seen.get(m, 0) + 1
    inside, clean = {m: set() for m, n in seen.items() if n >= least}, {}
    del seen
    for k, d in enumerate(toxic_docs):
        for m in marks(d) & inside.keys():
            inside[m].add(k)
    for d in clean_docs:
        for m in marks(d) & inside.keys():
            clean[m] = clean.get(m, 0) + 1
    scale = max(len(toxic_docs), 1) / max(len(clean_docs), 1)
    inside = {m: ks for m, ks in inside.items() if clean.get(m, 0) * scale <= clean_share * len(ks)}
    chosen, open_docs = [], set(range(len(toxic_docs)))
    while inside:
        best = max(sorted(inside), key=lambda m: (len(inside[m] & open_docs) - 3 * scale * clean.get(m, 0), -m.endswith("*"), len(m)))
        if len(inside[best] & open_docs) < least:
            break
        chosen.append(best)
        open_docs -= inside.pop(best)
    often = max(least + 2, 0.02 * len(toxic_docs))  # plain words that say it alone, whether or not others explain the same documents
    chosen += [m for m in inside if m[-1] != "*" and len(inside[m]) >= often and clean.get(m, 0) * scale <= clean_share / 5 * len(inside[m])]
    words, starts = {m for m in chosen if m[-1] != "*"}, tuple(m[:-1] for m in chosen if m[-1] == "*")
    return [{w for w in d if w in words or (starts and w.startswith(starts))} for d in toxic_docs]


def stuffed(word: str) -> list[str]:
    """A word with one letter put in at each inner place, STUFFING letters in turn: what a hidden insult looks like."""
    return [word[:i] + STUFFING[(i + j * len(word)) % len(STUFFING)] + word[i:] for i in range(1, len(word)) for j in (0, 1)] if len(word) > 3 else []


def learn_words(toxic_docs: list[set[str]], clean_docs: list[set[str]], landmarks: int = 160, negatives: int = 6000, seed: int = 7):
    """Fit on the witnesses of toxic documents against words of clean ones; words of clean documents that score high
    are added as negatives twice. Witnesses of many documents are learnt with single letters put into them as well, sharing a
    witness's weight, so that the margin leaves room for what the kernel calls alike. Returns the weights of all features and the bias, or None without a witness."""
    rng = np.random.default_rng(seed)
    good: dict[str, int] = {}
    for d in clean_docs:
        for w in d:
            good[w] = good.get(w, 0) + 1
    least = 3 if len(toxic_docs) >= 12 else 2
    count: dict[str, int] = {}
    for s in cover(toxic_docs, clean_docs, least):
        for w in s:
            count[w] = count.get(w, 0) + 1
    positives = sorted((w for w in count if w not in good or good[w] * 20 < count[w]), key=lambda w: (-count[w], w))
    pool = sorted(good)
    if not positives or not pool:
        return None
    often = sorted(good, key=lambda w: (-good[w], w))[: negatives // 3]
    other = [pool[i] for i in rng.permutation(len(pool))[: negatives - len(often)]]
    negative = sorted((set(often) | set(other)) - set(positives))
    ordered = positives[: landmarks * 2]
    base = dense(ordered)
    chosen, gap = [0], None
    while len(chosen) < min(landmarks * 2 // 3, len(ordered)):  # the one least like those already chosen
        near = base @ base[chosen[-1]]
        gap = near if gap is None else np.maximum(gap, near)
        if gap.min() > 0.95:
            break
        chosen.append(int(np.argmin(gap)))
    marks = [ordered[i] for i in chosen]
    marks = list(dict.fromkeys(marks + [negative[i] for i in rng.permutation(len(negative))[: landmarks - len(marks)]]))
    base, root = landmark_map(marks)
    by_feature = np.ascontiguousarray(base.T)

    def mapped(words):
        out = np.zeros((len(words), len(marks)), dtype=np.float32)
        for k, (name, weight) in enumerate(kernel_features(words)):
            out[k] = weight.astype(np.float32) @ by_feature[name]
        return out.astype(np.float64) @ root

    often_said = max(least + 2, 0.02 * len(toxic_docs))
    hidden = {w: [x for x in stuffed(w) if x not in good] for w in positives if count[w] >= often_said}
    weight_of = np.array([min(count[w], 20) for w in positives] + [min(count[w], 20) / len(xs) for w, xs in hidden.items() for _ in xs], dtype=float)
    xp, v, bias = mapped(positives + [x for xs in hidden.values() for x in xs]), None, 0.0
    for turn in range(3):
        xn = mapped(negative)
        x, y = np.vstack([xp, xn]), np.concatenate([np.ones(len(xp)), -np.ones(len(xn))])
        weight = np.concatenate([weight_of * len(xn) / weight_of.sum(), [min(good[w], 20) ** 0.5 for w in negative]])
        w, bias = fit_svm(x, y, weight, c=5.0)
        v = (by_feature @ (root @ w).astype(np.float32)).astype(np.float64)
        if turn < 2:
            scores = np.concatenate([score_words(pool[i : i + SCORED], v, bias) for i in range(0, len(pool), SCORED)])
            hard = [pool[i] for i in np.argsort(-scores, kind="stable")[: negatives // 3]]
            negative = sorted((set(negative) | set(hard)) - set(positives))
    return v, bias


class Model:
    def __init__(self, v, bias, coef):
        self.v, self.bias, self.coef = v, bias, coef


def train(labelled: DataFrame, max_docs: int = 4000, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model | None:
    """Fit on at most max_docs labelled rows (null labels and texts are left out), those of least hash of the key.

    max_docs is the documented bound of the sample: of each chosen row the distinct words of its whole text reach the
    driver. Rows that repeat a key count each; ties in the hash are settled by key, text and label, so the choice is the
    same from run to run. None if a class is missing.
    """
    rows = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).cast("int").alias("y"))
    return fit(rows.orderBy(F.xxhash64("k"), "k", F.xxhash64("t"), "y").limit(max_docs))


def fit(few: DataFrame) -> Model | None:
    """Fit on all rows (t, y) of a bounded sample. The distinct words of each whole text come as Arrow batches, one string a text."""
    words = F.array_join(F.array_distinct(F.split(F.lower("t"), r"\s+")), " ")
    arrow_batches(few.sparkSession, 200)
    batches = few.select("y", words.alias("w")).toArrow().to_batches()
    sides = {0: [], 1: []}
    batches.reverse()
    while batches:  # a word is one object however many documents hold it, and a batch goes once it is read
        batch = batches.pop()
        for y, w in zip(batch.column(0), batch.column(1), strict=True):
            sides[int(y.as_py() > 0)].append({intern(p) for p in map(plain, w.as_py().split(" ")) if p})
    if not sides[0] or not sides[1]:
        return None
    found = learn_words(sides[1], sides[0])
    if found is None:
        return None
    v, bias = found
    model, memory = Model(v, bias, np.array([0.0, 1.0, 0.0])), Recent(MEMORY)
    x = np.array([y for d in sides[0] + sides[1] for y in _document_values([" ".join(sorted(d))], v, bias, memory)])
    model.coef = np.round(fit_logistic(x, np.array([0.0] * len(sides[0]) + [1.0] * len(sides[1]))), 6)  # rows come in any order
    return model


def _probability(model: Model, top: str, hits: str) -> Column:
    a, b, c = (float(x) for x in model.coef)
    z = F.lit(a) + F.lit(b) * F.least(F.col(top), F.lit(MOST)) + F.lit(c) * F.log1p(hits)
    return 1 / (1 + F.exp(-z))


def score(df: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for every row, from the whole text alone.

    Null and empty texts score like a text without insults; without a model (no labels, or one class) every score is
    0; repeated rows and null keys keep a row each; other columns are ignored; no rows give no rows.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast({"v": model.v, "bias": model.bias})
    values = rows.mapInArrow(partial(_score, model=shared), "doc_id long, top double, hits double")
    p = _probability(model, "top", "hits")
    return values.select("doc_id", p.alias("score"), F.when(p >= 0.5, 1).otherwise(0).alias("predicted"))


def held_out(key) -> object:
    """Rows whose crc32 of the key as text leaves 0 modulo 5: never trained on. A null key is held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train_from_tables(documents: DataFrame, labels: DataFrame, max_docs: int = 4000) -> Model | None:
    """Fit on at most max_docs labelled documents whose row is not held out.

    Of the labels that one doc_id has, the greatest counts; of the texts that one doc_id has, that of the least hash; null
    keys, labels and texts are left out. So the sample is the same from run to run and never over max_docs rows.
    """
    labelled = labels.where(~held_out("doc_id") & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    few = stored(labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs), "labelled")
    texts = documents.where("text is not null").select("doc_id", F.col("text").alias("t")).join(few.select("doc_id"), "doc_id", "left_semi")
    texts = texts.groupBy("doc_id").agg(F.min_by("t", F.struct(F.xxhash64("t"), "t")).alias("t"))
    return fit(texts.join(few, "doc_id").select("t", "y"))


def reject_toxic(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows of df not predicted toxic, all columns kept; each row is judged by its own text, whatever its key.

    Null keys and repeated rows are judged like any other; a null or empty text holds no insult; extra columns of any
    name pass through; no rows give no rows; without a model all rows stay.
    """
    if model is None:
        return df
    arrow_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast({"v": model.v, "bias": model.bias})
    top, hits = fresh(df.columns, "top"), fresh(df.columns, "hits")
    kind = StructType([*df.schema.fields, StructField(top, DoubleType()), StructField(hits, DoubleType())])
    values = df.mapInArrow(partial(_with_values, model=shared, at=df.columns.index(text), names=(top, hits)), kind)
    return values.where(_probability(model, top, hits) < 0.5).select(*[F.col(f"`{c}`") for c in df.columns])
