"""Op 10: language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary (lower-cased, letters and word marks
only). Each language has a probability per piece, found by two rounds of expectation
maximisation over the words of its labelled documents; a word's probability is the sum over
all its segmentations into pieces, by the forward algorithm; a text's is the product over
its words. Words are scored once per worker and remembered.

Fitting reads at most ``docs_per_lang`` different labelled texts of each language, those with
the smallest hashes; prediction reads every whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop, read, sole
from .tokens import chunks

MARK = "▁"
MOST_WORDS = 200_000
#: Letters of a word that are scored in one run; longer ones go on in another.
RUN = 32
NOT_LETTERS = re.compile(r"[\W\d_]+")
_SCORERS: dict[str, Scorer] = {}
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Piece numbers of all substrings of many words at once, by rolling hashes and two address tables."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        raw = (sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)))
        self.pieces = sorted({p for p in raw if p.replace(MARK, "").isalpha() or p == MARK})
        self.longest = max(map(len, self.pieces))
        self.none, self.other = len(self.pieces), len(self.pieces) + 1  # no such piece; a letter of no piece
        self.tables = [(np.zeros(1 << 20, np.uint64), np.full(1 << 20, self.none, np.int32)) for _ in range(3)]
        for i, p in enumerate(self.pieces):
            h = np.uint64(0)
            for c in p:
                h = np.uint64((int(h) * int(MULTIPLIER) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF)
            h = np.array([h])
            for k, (hashes, ids) in enumerate(self.tables):
                at = self.slot(h, k)[0]
                if ids[at] == self.none:
                    hashes[at], ids[at] = h[0], i
                    break
            else:
                raise ValueError("the address tables are too small for the vocabulary")

    @staticmethod
    def slot(h, k: int):
        return ((h ^ (h >> np.uint64(29))) * np.uint64((0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)[k])) >> np.uint64(44)

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(h.shape, self.none, np.int32)
        for k, (hashes, ids) in enumerate(self.tables):
            at = self.slot(h, k).astype(np.int64)
            hit = hashes[at] == h
            out[hit] = ids[at[hit]]
            if k == 0 and hit.all():
                break
        return out

    def spans(self, words: list[str]) -> list[list[np.ndarray]]:
        """For words of one length: [l - 1][word, start] piece of ``l`` letters at ``start``."""
        n = len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), n).astype(np.uint64) + np.uint64(1)
        out, h = [], codes
        for length in range(1, min(n, self.longest) + 1):
            if length > 1:
                h = h[:, :-1] * MULTIPLIER + codes[:, length - 1 :]
            ids = self.find(h)
            if length == 1:
                ids = np.where(ids == self.none, self.other, ids)
            out.append(ids)
        return out


def forward(spans: list[np.ndarray], prob: np.ndarray) -> np.ndarray:
    """alpha[word, position, language]: summed probability of all segmentations of the prefix."""
    words, n = spans[0].shape
    alpha = np.zeros((words, n + 1, prob.shape[1]))
    alpha[:, 0] = 1
    for end in range(1, n + 1):
        for length in range(1, min(end, len(spans)) + 1):
            alpha[:, end] += alpha[:, end - length] * prob[spans[length - 1][:, end - length]]
    return alpha


def backward(spans: list[np.ndarray], prob: np.ndarray) -> np.ndarray:
    words, n = spans[0].shape
    beta = np.zeros((words, n + 1, prob.shape[1]))
    beta[:, n] = 1
    for at in range(n - 1, -1, -1):
        for length in range(1, min(n - at, len(spans)) + 1):
            beta[:, at] += beta[:, at + length] * prob[spans[length - 1][:, at]]
    return beta


def runs(word: str) -> list[str]:
    """The word's letters in lower case with a word mark before them, cut to runs; none without letters."""
    letters = word.lower() if word.isalpha() else NOT_LETTERS.sub("", word).lower()
    letters = letters if letters.isalpha() else "".join(filter(str.isalpha, letters))
    return [(MARK + letters)[i : i + RUN] for i in range(0, len(letters) + 1, RUN)] if letters else []


def by_length(words: list[str]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        out.setdefault(len(w), []).append(i)
    return out


class Scorer:
    """Log probabilities of words under every language, remembered."""

    def __init__(self, vocabulary: Vocabulary, prob: np.ndarray):
        self.vocabulary, self.prob = vocabulary, prob
        self.known: dict[str, int] = {}
        self.values = np.zeros((1 << 16, prob.shape[1]), np.float32)
        self.n = 0

    def learn(self, words: set[str]) -> None:
        if self.n + len(words) > MOST_WORDS:
            self.known.clear()
            self.n = 0
        words = list(words)
        parts, owner = [], []
        for i, w in enumerate(words):
            for r in runs(w):
                parts.append(r)
                owner.append(i)
        total = np.zeros((len(words), self.prob.shape[1]))
        owner = np.array(owner, np.int64)
        for same in by_length(parts).values():
            for at in range(0, len(same), 8192):
                some = same[at : at + 8192]
                a = forward(self.vocabulary.spans([parts[i] for i in some]), self.prob)
                np.add.at(total, owner[some], np.log(a[:, -1]))
        while self.n + len(words) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        self.values[self.n : self.n + len(words)] = total
        self.known.update(zip(words, range(self.n, self.n + len(words))))
        self.n += len(words)

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Summed log probabilities [text, language] and words with letters, of whole texts."""
        split = [t.split() for t in texts]
        new = set().union(*split)
        if len(new) > MOST_WORDS // 2 and len(texts) > 1:
            half = len(texts) // 2
            (a, m), (b, n) = self.texts(texts[:half]), self.texts(texts[half:])
            return np.concatenate([a, b]), np.concatenate([m, n])
        if len(missing := new.difference(self.known)) + self.n > MOST_WORDS:
            missing, self.n = new, 0
            self.known.clear()
        if missing:
            self.learn(missing)
        sums, counts = np.zeros((len(texts), self.prob.shape[1])), np.zeros(len(texts), np.int64)
        for i, words in enumerate(split):
            if words:
                got = self.values[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]
                sums[i], counts[i] = got.sum(0, dtype=np.float64), np.count_nonzero(got[:, 0])
        return sums, counts


def scorer(path: str, langs: list[str], prob: np.ndarray) -> Scorer:
    sole("langid", _SCORERS.clear)
    key = f"{path} {langs} {hash(prob.tobytes())}"
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(Vocabulary(path), prob)
    return _SCORERS[key]


def to_prob(counts: np.ndarray, smooth: float = 0.05) -> np.ndarray:
    """Piece probabilities from expected counts [piece, language]; every piece keeps some, 'no such piece' none."""
    out = counts + smooth
    out[-2] = 0
    return out / out.sum(0)


def expected(voc: Vocabulary, parts: list[str], lang: np.ndarray, n: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Expected counts [piece, language] over all segmentations of runs of letters, each met ``n`` times in its language."""
    got = np.zeros_like(prob)
    for same in by_length(parts).values():
        for at in range(0, len(same), 8192):
            some = np.array(same[at : at + 8192])
            spans = voc.spans([parts[i] for i in some])
            a, b = forward(spans, prob), backward(spans, prob)
            here, row = lang[some], np.arange(len(some))
            a, b = a[row, :, here], b[row, :, here]
            weight = n[some] / a[:, -1]
            for k, ids in enumerate(spans):
                post = a[:, : ids.shape[1]] * b[:, k + 1 :] * prob[ids, here[:, None]] * weight[:, None]
                np.add.at(got, (ids.ravel(), np.repeat(here, ids.shape[1])), post.ravel())
    return got


def fit(labelled: DataFrame, path: str, docs_per_lang: int = 1500, rounds: int = 2) -> tuple[list[str], np.ndarray]:
    """Languages in order and piece probabilities from ``labelled`` (doc_id, text, lang); rows
    with a null lang or text are left out; without rows there are no languages. The table of
    probabilities, which every worker gets, has a row a piece and a column a language."""
    known = labelled.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("_h"))
    # texts below a share of the hashes that leaves about twice as many as wanted, so no task ranks a whole language
    many = known.groupBy("lang").agg(F.approx_count_distinct("_h").alias("_n"))
    below = (2 * docs_per_lang + 100) / F.col("_n")
    few = known.join(F.broadcast(many), "lang").where(F.pmod("_h", F.lit(1 << 32)) / float(1 << 32) < below)
    few = few.groupBy("lang", "_h").agg(F.min("text").alias("text"))  # equal texts are one, in each task before the exchange
    order = Window.partitionBy("lang").orderBy(F.pmod("_h", F.lit(1 << 32)), "_h")
    some = few.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= docs_per_lang)
    words = some.select("lang", F.explode(F.split("text", r"\s+")).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    words = cut(words.where("word <> ''").repartition(max(1, int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "lang", "word"), "words")
    langs = sorted(r.lang for r in words.select("lang").distinct().collect())
    vocabulary = Vocabulary(path)
    size = len(vocabulary.pieces) + 2
    # start: every segmentation by its pieces' number only
    prob = to_prob(np.ones((size, max(1, len(langs)))))
    for _ in range(rounds if langs else 0):
        sent = labelled.sparkSession.sparkContext.broadcast(prob)

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            voc, place, got = Vocabulary(path), {x: i for i, x in enumerate(langs)}, np.zeros((size, len(langs)))
            for batch in batches:
                parts, lang, n = [], [], []
                for k, w, c in zip(*(x.to_pylist() for x in batch.columns)):
                    for r in runs(w):
                        parts.append(r)
                        lang.append(place[k])
                        n.append(c)
                got += expected(voc, parts, np.array(lang, np.int64), np.array(n, float), sent.value)
            at = np.nonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(got[at])], ["piece", "lang", "n"])

        counts = np.zeros_like(prob)
        # at most one row for each piece and language
        for r in words.mapInArrow(expect, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toLocalIterator():
            counts[r.piece, r.lang] = r.n
        prob = to_prob(counts)
    drop(words)
    return langs, prob


def predict(docs: DataFrame, langs: list[str], prob: np.ndarray, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with lang_pred and score, from the text alone.

    'und' with score 0 for a null text, one without a letter, or where no language was
    learned. Score: the prediction's posterior if its words were at most eight. Equal
    languages: the first by code point. Every row gives one row.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*[docs.schema[k] for k in keep], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(prob)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(path, langs, sent.value) if langs else None
        for batch in batches:
            pred, best = [], []
            slim = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), batch.column(len(keep))], ["k", "text"])
            for _, texts in chunks(iter([slim])):
                if score is None:
                    pred += ["und"] * len(texts)
                    best += [0.0] * len(texts)
                    continue
                sums, counts = score.texts(texts)
                scaled = sums * (np.minimum(counts, 8) / np.maximum(counts, 1))[:, None]
                top = sums.argmax(1)
                post = 1 / np.exp(scaled - scaled[np.arange(len(top)), top][:, None]).sum(1)
                pred += [langs[t] if c else "und" for t, c in zip(top, counts)]
                best += np.where(counts > 0, post, 0.0).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(pred, pa.string()), pa.array(best, pa.float64())], names=schema.names)

    return docs.select(*keep, "text").mapInArrow(run, schema)


def remainder(n: int) -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def identify(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Fit on the labelled documents outside the held-out third and predict all."""
    langs, prob = fit(docs.where(remainder(3) != 1).select("doc_id", "text", "lang"), path)
    return predict(docs, langs, prob, path, keep)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score")
