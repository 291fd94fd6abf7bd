"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear SVM.

Two words are compared by the gap-weighted subsequence kernel of order three:
every common subsequence of three letters counts, less the more it is spread
out, so inserted, doubled and dropped letters only weaken a match. The kernel
is normalised and sharpened by a power. A sentence's kernel is the sum over its
words; Nyström features against landmark words turn the SVM into a linear one.
A document is as toxic as its worst sentence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONGEST, STEP, PIECE = 16, 8, 24
SENTENCE = re.compile(r"[.!?|\n\r]+")
LETTERS = re.compile(r"[\W\d_]+")
#: three or more single letters with the same one or two other marks between are read as one word
SPELLED = re.compile(r"(?<![^\W_])[^\W\d_]([\W_]{1,2})[^\W\d_](?:\1[^\W\d_](?![^\W_]))+")
#: tokens of more characters are taken as their fragments
LONG = re.compile(r"\S{65,}")
#: landmark letters that have a code of their own; further ones share codes by remainder
ALPHABET = 254
#: how much the normalised kernel is sharpened
POWER = 4


def fragments(token: str) -> list[str]:
    """The letters of a token in overlapping pieces of at most 16; none below three letters."""
    word = LETTERS.sub("", token.lower())
    if len(word) < 3:
        return []
    if len(word) <= LONGEST:
        return [word]
    return [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST + STEP, STEP)]


def sentences(text: str) -> list[list[str]]:
    """Sentences as lists of lower-case tokens, cut after 24 tokens each.

    Words spelled letter by letter are joined before sentences are cut, so the
    dots of a dotted word end no sentence.
    """
    text = SPELLED.sub(lambda m: LETTERS.sub("", m[0]), text.lower())
    text = LONG.sub(lambda m: " ".join(fragments(m[0])), text)
    found = []
    for part in SENTENCE.split(text):
        words = part.split()
        if len(words) <= PIECE:
            if words:
                found.append(words)
        else:
            found += [words[i : i + PIECE] for i in range(0, len(words), PIECE)]
    return found


def _letters(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length).astype(np.int64)


class SubsequenceKernel:
    """Gap-weighted subsequences of order three against a fixed set of landmark words."""

    def __init__(self, landmarks: list[str], decay: float = 0.75, power: int = POWER) -> None:
        self.power, self.landmarks = power, landmarks
        self.picks = {}
        for m in range(3, LONGEST + 1):
            triples = np.array(list(combinations(range(m), 3)))
            self.picks[m] = triples, decay ** (triples[:, 2] - triples[:, 0] + 1.0)
        letters = sorted(set("".join(landmarks)))
        #: code points to codes; 0 for letters that no landmark has
        self.code = np.zeros(0x110000, np.uint8)
        for i, c in enumerate(letters):
            self.code[ord(c)] = 1 + i % ALPHABET
        self.base = 1 + min(len(letters), ALPHABET)
        #: a subsequence's row in ``table``, 0 for those that no landmark has
        self.slot = np.zeros(self.base**3, np.int32)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for word in landmarks:
            ids, weights = self._ids(self.code[_letters([word], len(word))], len(word))
            keys, place = np.unique(ids[0], return_inverse=True)
            found.append((keys, np.bincount(place, weights)))
        used = np.unique(np.concatenate([k for k, _ in found])) if found else np.zeros(0, np.int64)
        self.slot[used] = np.arange(1, len(used) + 1)
        self.table = np.zeros((len(used) + 1, len(landmarks)), np.float32)
        for j, (keys, sums) in enumerate(found):
            self.table[self.slot[keys], j] = sums / np.linalg.norm(sums)

    def _ids(self, codes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        triples, weights = self.picks[length]
        codes = codes.astype(np.int64)
        ids = (codes[:, triples[:, 0]] * self.base + codes[:, triples[:, 1]]) * self.base + codes[:, triples[:, 2]]
        return ids, weights  # no landmark's subsequence has a 0 in it

    def _norms(self, letters: np.ndarray, length: int) -> np.ndarray:
        """Square roots of the kernels of words with themselves, over all their letters."""
        triples, weights = self.picks[length]
        ids = letters[:, triples[:, 0]] << 42 | letters[:, triples[:, 1]] << 21 | letters[:, triples[:, 2]]
        order = np.argsort(ids, axis=1, kind="stable")
        keys, w = np.take_along_axis(ids, order, 1), weights[order].reshape(-1)
        first = np.ones(keys.shape, bool)
        first[:, 1:] = keys[:, 1:] != keys[:, :-1]
        start = np.flatnonzero(first)
        sums = np.add.reduceat(w, start)
        return np.sqrt(np.bincount(start // keys.shape[1], sums * sums, minlength=len(keys)))

    def against(self, words: list[str]) -> np.ndarray:
        """Sharpened kernels of ``words`` (3 to 16 letters) against the landmarks."""
        out = np.zeros((len(words), len(self.landmarks)))
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for m, where in by_length.items():
            triples, weights = self.picks[m]
            step = max(1, 400_000 // len(triples))
            for a in range(0, len(where), step):
                at = np.array(where[a : a + step])
                letters = _letters([words[i] for i in at], m)
                rows = self.slot[self._ids(self.code[letters], m)[0]]
                active = rows > 0
                raw = np.zeros((len(at), len(self.landmarks)), np.float32)
                for j in np.flatnonzero(active.any(axis=0)):
                    hit = np.flatnonzero(active[:, j])
                    raw[hit] += self.table[rows[hit, j]] * np.float32(weights[j])
                hit = np.flatnonzero(active.any(axis=1))
                if len(hit):
                    out[at[hit]] = (raw[hit] / self._norms(letters[hit], m)[:, None].astype(np.float32)) ** self.power
        return out


def _hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float, rounds: int = 12, block: int = 8192) -> np.ndarray:
    """A linear SVM with squared hinge loss by Newton steps; the last weight is the bias. Rows are summed block by block."""
    n = x.shape[1] + 1
    w, keep = np.zeros(n), np.eye(n)
    keep[-1, -1] = 1e-3
    for _ in range(rounds):
        short = np.flatnonzero(1 - y * (x @ w[:-1] + w[-1]) > 0)
        left, right = keep.copy(), np.zeros(n)
        for i in range(0, len(short), block):
            at = short[i : i + block]
            part = np.hstack([x[at], np.ones((len(at), 1))])
            scaled = part * (cost * weight[at, None])
            left += scaled.T @ part
            right += scaled.T @ y[at]
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w


def _slope(f: np.ndarray, y: np.ndarray, rounds: int = 50) -> float:
    """Slope of the logistic curve from margins to probabilities; margin 0 stays at one half."""
    w = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(f * w, -30, 30)))
        step = ((f * (y - p)).sum() - 1e-3 * w) / ((f * f * p * (1 - p)).sum() + 1e-3)
        w += step
        if abs(step) < 1e-9:
            break
    return float(np.clip(w, 0.1, 30))


class ToxicModel:
    """A fitted model: an integer score a token, summed over a sentence's distinct tokens."""

    UNIT = 1e6

    def __init__(self, landmarks: list[str], beta: np.ndarray, bias: float, platt: tuple[float, float], memo: int = 500_000):
        self.landmarks, self.beta, self.bias, self.platt, self.most = landmarks, beta, bias, platt, memo
        self._prepare()

    def _prepare(self) -> None:
        self.kernel, self.memo = SubsequenceKernel(self.landmarks), {}

    def __getstate__(self) -> tuple:
        return self.landmarks, self.beta, self.bias, self.platt, self.most

    def __setstate__(self, state: tuple) -> None:
        self.landmarks, self.beta, self.bias, self.platt, self.most = state
        self._prepare()

    def learn_tokens(self, tokens: set[str]) -> None:
        """Put the scores of new tokens into the memo; a token scores as the sum of its fragments."""
        if len(self.memo) > self.most:
            self.memo = {}
        new = list(tokens.difference(self.memo))
        parts = [fragments(t) for t in new]
        words = list(dict.fromkeys(w for p in parts for w in p))
        score: dict[str, int] = {}
        for i in range(0, len(words), 20_000):  # kernels against all landmarks are held for so many words
            block = words[i : i + 20_000]
            values = np.round(self.kernel.against(block) @ self.beta * self.UNIT).astype(np.int64)
            score.update(zip(block, values.tolist(), strict=True))
        for token, part in zip(new, parts, strict=True):
            self.memo[token] = sum(score[w] for w in part)

    def margin(self, found: list[list[str]]) -> float:
        """The worst sentence's distance from the boundary; an empty text stands on the bias."""
        get = self.memo.__getitem__
        return max((sum(map(get, set(s))) for s in found), default=0) / self.UNIT + self.bias

    def scores(self, texts: list[str]) -> list[float]:
        found = [sentences(t) for t in texts]
        self.learn_tokens({w for doc in found for s in doc for w in s})
        slope, shift = self.platt
        z = np.clip(np.array([self.margin(doc) for doc in found]) * slope + shift, -30, 30)
        return (1 / (1 + np.exp(-z))).tolist()


def fit(
    texts: list[str], toxic: list[int], marked: int = 64, plain: int = 12, plain_sentences: int = 12, hard: int = 48, cost: float = 30.0,
    surprise: float = 14.0,
) -> ToxicModel:
    """Train on labelled documents, sentence by sentence.

    Repeated texts count once, with the label most of them have. Landmarks are
    the words most tied to the label and a few common words. A word is tied by
    the log-likelihood ratio of its documents' labels; ``surprise`` nats keep
    out what one word in a million would reach by chance, as chance landmarks
    among a large vocabulary fit the noise (3 words stay in any case). Every
    sentence starts with its document's label; then each toxic document keeps
    its worst sentence and those that look toxic by now, which count as one
    together, and the SVM is fitted again; clean documents teach with evenly
    spaced sentences. In the last rounds the loss is a ramp: toxic
    documents far on the wrong side are taken for wrong labels and left out.
    Clean sentences that still come near teach once more, and their words become
    landmarks against the insults. With one class only, every score is that
    class's share.
    """
    votes: dict[str, list[int]] = {}
    for text, label in zip(texts, toxic, strict=True):
        votes.setdefault(text, []).append(label)
    y = np.array([float(2 * sum(v) > len(v)) for v in votes.values()])
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return ToxicModel(["toxic"], np.zeros(1), 0.0, (0.0, 30.0 if share == 1 else -30.0))
    texts = list(votes)
    del votes

    def words_of(text: str) -> set[str]:
        return {w for t in {t for s in sentences(text) for t in s} for w in fragments(t)}

    # words of toxic documents are counted, in them and in the others
    seen = [Counter(), Counter()]
    for i in np.flatnonzero(y == 1):
        seen[1].update(words_of(texts[i]))
    for i in np.flatnonzero(y == 0):
        seen[0].update(words_of(texts[i]) & seen[1].keys())
    n0, n1 = int((y == 0).sum()), int((y == 1).sum())

    rate = n1 / (n0 + n1)

    def tie(w: str) -> float:
        """How surprising it is, in nats, that so many of the documents with a word are toxic; 0 if few are."""
        k, n = seen[1][w], seen[0][w] + seen[1][w]
        if k <= n * rate:
            return 0.0
        return k * np.log(k / (n * rate)) + ((n - k) * np.log((n - k) / (n * (1 - rate))) if k < n else 0.0)

    if not seen[1]:
        return ToxicModel(["toxic"], np.zeros(1), 0.0, (0.0, float(np.log(n1 / n0))))
    ties = sorted(((tie(w), w) for w in seen[1]), key=lambda x: (-x[0], x[1]))[:marked]
    strong = [w for i, (z, w) in enumerate(ties) if z >= surprise or i < 3]
    common = sorted(seen[0], key=lambda w: (-seen[0][w], w))[:plain]
    del seen
    landmarks = list(dict.fromkeys(strong + common))
    model = _learned(texts, y, landmarks, [], plain_sentences, cost)
    margins, worst = _worst(model, texts)
    # clean sentences that come too near teach again, and their words become landmarks against the insults
    near = [(i, worst[i]) for i in np.flatnonzero((y == 0) & (margins > -0.5)).tolist() if worst[i]]
    model.learn_tokens({t for _, s in near for t in s})
    times = Counter(w for _, s in near for t in set(s) if model.memo[t] > 0.2 * model.UNIT for w in fragments(t))
    against = sorted((w for w in times if w not in landmarks), key=lambda w: (-times[w], w))[:hard]
    if against:
        model = _learned(texts, y, landmarks + against, near, plain_sentences, cost)
        margins, _ = _worst(model, texts)
    return ToxicModel(model.landmarks, model.beta, model.bias, (_slope(margins, y), 0.0))


def _worst(model: ToxicModel, texts: list[str]) -> tuple[np.ndarray, list[list[str]]]:
    """Each text's margin and the sentence that has it."""
    margins, worst = [], []
    for i in range(0, len(texts), 50):
        part = [sentences(t) for t in texts[i : i + 50]]
        model.learn_tokens({t for doc in part for s in doc for t in s})
        margins += [model.margin(doc) for doc in part]
        worst += [max(doc, key=lambda s: model.margin([s]), default=[]) for doc in part]
    return np.array(margins), worst


def _learned(
    texts: list[str], y: np.ndarray, landmarks: list[str], more: list[tuple[int, list[str]]], plain_sentences: int, cost: float
) -> ToxicModel:
    """A model over ``landmarks``; ``more`` are further sentences (text, tokens) of clean texts."""
    kernel = SubsequenceKernel(landmarks)
    values, vectors = np.linalg.eigh(kernel.against(landmarks))
    root = vectors @ np.diag(np.maximum(values, 1e-6) ** -0.5) @ vectors.T
    owner, rows = [], []

    def put(part: list[tuple[int, list[str]]]) -> None:
        pieces = {t: fragments(t) for _, s in part for t in s}
        words = list(dict.fromkeys(w for ws in pieces.values() for w in ws))
        place = {w: k for k, w in enumerate(words)}
        mapped = kernel.against(words) @ root
        for i, s in part:
            owner.append(i)
            rows.append(mapped[[place[w] for t in sorted(set(s)) for w in pieces[t]]].sum(0).astype(np.float32))

    for i in range(0, len(texts), 50):
        part = []
        for k, doc in enumerate(map(sentences, texts[i : i + 50]), i):
            if y[k] == 0:  # evenly spaced ones tell enough of a clean document
                doc = doc[:: max(1, len(doc) // plain_sentences)]
            part += [(k, s) for s in doc or [[]]]
        put(part)
    put(more)
    order = np.argsort(owner, kind="stable")
    x = np.empty((len(rows), len(landmarks)), np.float32)
    for i, k in enumerate(order.tolist()):
        x[i] = rows[k]
        rows[k] = None
    owner = np.array(owner)[order]
    label = np.where(y[owner] == 1, 1.0, -1.0)
    size = np.bincount(owner, minlength=len(y))
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    n1 = int((y == 1).sum())
    balance = n1 / max(1, (label < 0).sum())
    w = _hinge(x, label, np.where(label > 0, 1.0 / size[owner], balance), cost)
    for round_ in range(8):
        margins = x @ w[:-1] + w[-1]
        worst = np.zeros(len(x), bool)
        order = np.lexsort((-margins, owner))
        worst[order[begin]] = True
        # a toxic document keeps its worst sentence and all that look toxic by now; together they count as one
        use = (label < 0) | (worst & ((round_ < 3) | (margins > -0.5))) | (margins > 0.5)
        toxic = use & (label > 0)
        if not toxic.any():
            break
        shared = np.bincount(owner[toxic], minlength=len(y))
        balance = n1 / max(1, (label < 0).sum())
        w = _hinge(x[use], label[use], np.where(label > 0, 1.0 / np.maximum(1, shared[owner]), balance)[use], cost)
    return ToxicModel(landmarks, root @ w[:-1], float(w[-1]), (1.0, 0.0), memo=100_000)


def held_out(id_col: str) -> F.Column:
    """Whether a row is kept from training: crc32 of the id as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_rows: int = 3_000,
) -> ToxicModel:
    """Fit on at most ``max_rows`` labelled rows that are not held out.

    The rows with the smallest hash of their id are taken, with their whole
    texts; so what the driver reads is bounded by a number of rows. Null labels
    and null ids teach nothing; of labels that repeat an id the largest counts.
    """
    picked = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("__id"))
        .agg(F.max(label_col).alias("__label"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(max_rows)
    )
    rows = (
        docs.select(F.col(id_col).alias("__doc"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
        .join(F.broadcast(picked), F.col("__doc") == F.col("__id"))
        .groupBy("__doc")
        .agg(F.min("__text").alias("__text"), F.max("__label").alias("__label"))
        .orderBy("__doc")
        .collect()
    )
    return fit([r["__text"] for r in rows], [int(r["__label"]) for r in rows])


def score_toxicity(df: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, score (0 to 1), predicted (1 from 0.5 on).

    A null text counts as empty; an empty text scores what the model gives no
    evidence. Null and repeated ids are passed through. Only the text is
    scored; other columns are not read. An empty table gives no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores, part, size = [], [], 0
            for value in batch.column(2):
                part.append(value.as_py() or "")
                size += len(part[-1])
                if size > 1_500_000:
                    scores += model.scores(part)
                    part, size = [], 0
            scores += model.scores(part)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                names=[id_col, "held_out", "score", "predicted"],
            )

    return df.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col)).mapInArrow(
        run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int"
    )


def keep_clean(df: DataFrame, model: ToxicModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The input rows, with all their columns, whose text scores below ``threshold``."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                scores = model.scores([t or "" for t in part.column(at).to_pylist()])
                yield part.filter(pa.array([s < threshold for s in scores], pa.bool_()))

    return df.mapInArrow(run, df.schema)
