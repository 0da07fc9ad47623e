"""Problem 6: the language of each text and of each segment, with a confidence.

A text is the average of hashed subword embeddings (3- to 5-grams of its words with their
edges), followed by a linear softmax; both layers are trained by stochastic gradient descent
in numpy on a bounded sample of labelled rows. For use, the two layers are multiplied out to
one table of ``BUCKETS`` x languages (a fixed size, sent to the executors with the UDF).
A temperature and a rejection threshold are fitted on held-out sentences: below the
threshold the language is ``und``.

Segments: sentences are scored, a best path with a price per change of language smooths them,
and neighbours of one language are joined.

Defined results: null text gives no segments and null language; '' or a text without letters
gives ``und`` with confidence 0.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from lexloom.llm.canon import folded

BUCKETS = 1 << 16
DIM = 16
SAMPLE_ROWS = 3000
REJECTED = "und"

# Usual written forms of the languages (ISO 639-1, 639-2 B and T, names).
FORMS = {
    "es": "es spa esp español espanol castellano spanish",
    "pt": "pt por português portugues portuguese",
    "it": "it ita italiano italian",
    "fr": "fr fra fre français francais french",
    "de": "de deu ger deutsch german",
    "nl": "nl nld dut nederlands dutch",
    "sv": "sv swe svenska swedish",
    "en": "en eng english",
    "bg": "bg bul български bulgarian",
}
LANGS = tuple(FORMS)
LABELS = {form: lang for lang, forms in FORMS.items() for form in forms.split()}

_NOISE = re.compile(r"<[^<>]*>|https?://\S+|\\[A-Za-z]+|&#?\w+;")
_UNIT = re.compile(r"[^\n.!?]*(?:[.!?](?!\s|$)[^\n.!?]*)*[.!?\n]*\s*")
_STOP = re.compile(r"(?<=[^\W\d_])[.!?]+(?=[^\W\d_])|[.!?]+\xb7+")  # a sentence end where spaces are lost or drawn
_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"[^\W\d_]+|[.!?](?=\s|$)|\n")
_MUL = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], dtype=np.uint32)


def label_language(label):
    """Column: the language a label names in any usual written form, else null ('pt-BR', 'FRA', 'nl_be' count)."""
    known = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.try_element_at(known, F.regexp_extract(F.lower(F.trim(label)), r"^([\p{L}]+)(?:[-_][\p{L}\d]+)*$", 1))


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each gram of each word, and where each word's grams begin."""
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le"), dtype=np.uint32)
    lengths = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths)
    word = np.repeat(np.arange(len(words)), lengths)
    left = ends[word] - np.arange(len(codes))  # code points up to the word's end
    grams, owner = [], []
    h = codes * _MUL[0]
    for n in range(2, 6):
        h = h[:-1] ^ ((codes[n - 1 :] + np.uint32(n)) * _MUL[n - 1])
        h = (h << np.uint32(5)) | (h >> np.uint32(27))
        if n < 3 or len(h) == 0:
            continue
        ok = left[: len(h)] >= n
        x = h[ok].copy()
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        grams.append(x & np.uint32(BUCKETS - 1))
        owner.append(word[: len(h)][ok])
    grams, owner = np.concatenate(grams).astype(np.int64), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return grams[order], np.searchsorted(owner[order], np.arange(len(words)))


@dataclass
class Model:
    """The multiplied-out table and the calibration."""

    table: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    temperature: float
    threshold: float
    accuracy: float

    def __post_init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.sums = np.zeros((1, len(LANGS)), dtype=np.float32)
        self.counts = np.zeros(1, dtype=np.float32)

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("table", "bias", "temperature", "threshold", "accuracy")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def learn_words(self, words: set[str]) -> None:
        """Adds the scores of words not seen before to the cache of this process."""
        if len(self.rows) > 400_000:  # bounded cache: begin anew
            self.__post_init__()
        fresh = [w for w in words if w not in self.rows]
        self.rows.update((w, 0) for w in fresh if not w[0].isalpha())
        fresh = [w for w in fresh if w[0].isalpha()]
        if not fresh:
            return
        grams, begins = word_grams(fresh)
        base = len(self.counts)
        self.sums = np.concatenate([self.sums, np.add.reduceat(self.table[grams], begins, axis=0)])
        self.counts = np.concatenate([self.counts, np.diff(np.append(begins, len(grams))).astype(np.float32)])
        self.rows.update(zip(fresh, range(base, base + len(fresh))))

    def log_probabilities(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        logits = (sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def plain(text: str) -> str:
    """The text for scoring: one form, no markup signs. Offsets are kept: what is dropped becomes spaces."""
    if "<" in text or "&" in text or "\\" in text or "://" in text:
        text = _NOISE.sub(lambda m: (html.unescape(m.group()) if m.group()[0] == "&" else "").ljust(len(m.group()))[: len(m.group())], text)
    return text


def units(text: str) -> list[tuple[int, int]]:
    """Sentences as (begin, end); they cover the text.

    Unbroken stretches are cut at stops between letters or before U+00B7, and every 400 code points.
    """
    return _units(text)[0]


def _units(text: str) -> tuple[list[tuple[int, int]], bool]:
    """The units, and whether an unbroken stretch was cut."""
    out, divided = [], False
    for m in _UNIT.finditer(text):
        b, end = m.span()
        long = end - b > 400
        for e in (*(x.end() for x in _STOP.finditer(text, b, end)), end) if long else (end,):
            while e - b > 800:
                out.append((b, b + 400))
                b += 400
                divided = True
            if e > b:
                out.append((b, e))
                divided |= e < end
            b = e
    return out, divided


def pieces(words: list[str]) -> list[str]:
    """Runs of letters longer than 60 as pieces of 60 that share 4 letters, so that no gram is lost."""
    if max(map(len, words), default=0) <= 60:
        return words
    return [p for w in words for p in ([w] if len(w) <= 60 else [w[i : i + 60] for i in range(0, len(w) - 4, 56)])]


def best_path(scores: np.ndarray, price: float) -> np.ndarray:
    """The language of each unit: highest total score, less ``price`` per change."""
    n, k = scores.shape
    back = np.zeros((n, k), dtype=np.int64)
    total = scores[0].copy()
    for i in range(1, n):
        top = int(total.argmax())
        jump = total[top] - price
        stay = total >= jump
        back[i] = np.where(stay, np.arange(k), top)
        total = np.where(stay, total, jump) + scores[i]
    path = np.empty(n, dtype=np.int64)
    path[-1] = total.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


CHANGE_PRICE = 4.0


def _scores(model: Model, texts: list[str], cuts: list[list[tuple[int, int]] | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums and counts per unit, and the first unit of each text.

    The units of a text are the spans in ``cuts``; for None a unit ends at each sentence end.
    Each unit begins with a token of row 0 (no score), so none is empty.
    """
    tokens, heads = [], []
    for k, t in enumerate(texts):
        shown = plain(t)
        heads.append(len(tokens))
        if cuts[k] is None:
            tokens.append("\n")
            tokens.extend(pieces(_TOKEN.findall(folded(shown))))
        else:
            for b, e in cuts[k]:
                tokens.append("\n")
                tokens.extend(pieces(_WORD.findall(folded(shown[b:e]))))
    model.learn_words(set(tokens))
    rows = model.rows
    at = np.array([rows[w] for w in tokens], dtype=np.int64)
    starts = np.flatnonzero(at == 0)
    sums = np.add.reduceat(model.sums[at], starts, axis=0).astype(np.float64)
    counts = np.add.reduceat(model.counts[at], starts).astype(np.float64)
    return sums, counts, np.searchsorted(starts, np.array(heads))


def _weighted(model: Model, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Log probabilities of units; a unit's weight grows with its grams up to a sentence's worth."""
    return model.log_probabilities(sums, counts) * np.minimum(counts / 60.0, 2.0)[:, None]


def _segment(model: Model, begin: int, end: int, lang: int, sums: np.ndarray, n: float) -> tuple[int, int, str, float]:
    p = float(np.exp(model.log_probabilities(sums[None, :], np.array([n])))[0, lang]) if n else 0.0
    return begin, end, LANGS[lang] if n and p >= model.threshold else REJECTED, p


def segment_texts(texts: list[str | None], model: Model) -> list[list[tuple[int, int, str, float]] | None]:
    """Per text its segments (begin, end, language, confidence); None for None."""
    out: list = [None if t is None else [] for t in texts]
    there = [i for i, t in enumerate(texts) if t]
    if not there:
        return out
    # Sentence ends alone give the same units where no unbroken stretch was cut, at less cost.
    whole = [own if divided else None for own, divided in (_units(plain(texts[i])) for i in there)]
    sums, counts, first = _scores(model, [texts[i] for i in there], whole)
    weighted = _weighted(model, sums, counts)
    total = np.add.reduceat(weighted, first, axis=0)
    main = total.argmax(axis=1)
    # What all changes of language together could gain; up to the price of one, the best path has none.
    gain = np.add.reduceat(weighted.max(axis=1), first) - total.max(axis=1)
    all_sums, all_counts = np.add.reduceat(sums, first, axis=0), np.add.reduceat(counts, first)
    mixed = []
    for k, i in enumerate(there):
        if gain[k] <= CHANGE_PRICE:
            out[i] = [_segment(model, 0, len(texts[i]), int(main[k]), all_sums[k], all_counts[k])]
        else:
            mixed.append(i)
    if mixed:
        cuts = [units(plain(texts[i])) for i in mixed]
        sums, counts, first = _scores(model, [texts[i] for i in mixed], cuts)
        weighted = _weighted(model, sums, counts)
        for k, i in enumerate(mixed):
            at, own = int(first[k]), cuts[k]
            path = best_path(weighted[at : at + len(own)], CHANGE_PRICE)
            begin = 0
            for u in range(1, len(own) + 1):
                if u == len(own) or path[u] != path[begin]:
                    part = slice(at + begin, at + u)
                    out[i].append(_segment(model, own[begin][0], own[u - 1][1], int(path[begin]), sums[part].sum(axis=0), counts[part].sum()))
                    begin = u
    return out


def train(texts: list[str], labels: list[str], seed: int = 7, epochs: int = 3, rate: float = 0.1, batch: int = 64) -> Model:
    """Fits the model on texts with (possibly wrong) labels; a fifth of the sentences is held out.

    After the first half of the epochs, training sentences whose label the model contradicts
    are left out: labels in the sample may be wrong.
    """
    rng = np.random.default_rng(seed)
    sentences, targets = [], []
    for t, lab in zip(texts, labels):
        shown = plain(t)
        for b, e in units(shown):
            found = _WORD.findall(folded(shown[b:e]))
            if len(found) >= 4:
                sentences.append(pieces(found))
                targets.append(LANGS.index(lab))
    if not sentences:
        return Model(np.zeros((BUCKETS, len(LANGS)), np.float32), np.zeros(len(LANGS)), 1.0, 1.0, 0.0)
    keep = rng.permutation(len(sentences))[:12_000]
    sentences, y = [sentences[i] for i in keep], np.array([targets[i] for i in keep])
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for s in sentences for w in s))}
    grams, begins = word_grams(list(vocabulary))
    ends = np.append(begins[1:], len(grams))
    examples = [np.concatenate([grams[begins[i] : ends[i]] for i in map(vocabulary.__getitem__, s)]) for s in sentences]
    held = np.arange(len(y)) % 5 == 0
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    weight, bias = rng.normal(0, 0.1, (DIM, len(LANGS))).astype(np.float32), np.zeros(len(LANGS), np.float32)

    def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(examples[i]) for i in ids])
        return np.concatenate([examples[i] for i in ids]), np.append(0, np.cumsum(sizes)[:-1]), sizes

    def logits_of(ids: np.ndarray) -> np.ndarray:
        out = []
        for part in np.array_split(ids, max(1, len(ids) // 512)):
            g, starts, sizes = pack(part)
            out.append(np.add.reduceat(emb[g], starts, axis=0) / sizes[:, None] @ weight + bias)
        return np.concatenate(out)

    train_ids = np.flatnonzero(~held)
    acc_emb, acc_weight, acc_bias = np.zeros(BUCKETS, np.float32), 0.0, 0.0
    steps = 0
    for epoch in range(epochs):
        ids = rng.permutation(train_ids)
        for k in range(0, len(ids), batch):
            part = ids[k : k + batch]
            g, starts, sizes = pack(part)
            vec = np.add.reduceat(emb[g], starts, axis=0) / sizes[:, None]
            z = vec @ weight + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            lr = rate * max(0.1, 1 - steps / (epochs * len(ids) / batch))
            # Adaptive steps (squared gradients summed per row) stay stable on few and on many examples.
            d_weight, d_bias = vec.T @ p / len(part), p.mean(axis=0)
            step = np.repeat((p @ weight.T / sizes[:, None]).astype(np.float32), sizes, axis=0)
            order = np.argsort(g, kind="stable")
            uniq, cut = np.unique(g[order], return_index=True)
            d_emb = np.add.reduceat(step[order], cut, axis=0)
            acc_emb[uniq] += (d_emb**2).mean(axis=1)
            acc_weight += (d_weight**2).mean()
            acc_bias += (d_bias**2).mean()
            emb[uniq] -= lr * d_emb / np.sqrt(acc_emb[uniq] + 1e-12)[:, None]
            weight -= (lr * d_weight / np.sqrt(acc_weight + 1e-12)).astype(np.float32)
            bias -= (lr * d_bias / np.sqrt(acc_bias + 1e-12)).astype(np.float32)
            steps += 1
        if epoch == epochs // 2 - 1:
            train_ids = train_ids[logits_of(train_ids).argmax(axis=1) == y[train_ids]]
    held_ids = np.flatnonzero(held)
    z = logits_of(held_ids)
    right = z.argmax(axis=1) == y[held_ids]

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        lp = s - np.log(np.exp(s).sum(axis=1, keepdims=True))
        return float(-lp[np.arange(len(z)), y[held_ids]].mean())

    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=loss)
    s = z / temperature
    p = np.exp(s - s.max(axis=1, keepdims=True))
    top = (p / p.sum(axis=1, keepdims=True)).max(axis=1)
    # Rejection: the lowest confidence from which held-out sentences are as right as the rest on average.
    threshold = 0.34
    for at in np.arange(0.34, 0.9, 0.04):
        if (top >= at).any() and right[top >= at].mean() >= right.mean():
            threshold = float(at)
            break
    return Model((emb @ weight).astype(np.float32), bias.astype(np.float64), float(temperature), threshold, float(right.mean()))


def fit(df: DataFrame, text: str, label: str, rows: int = SAMPLE_ROWS, longest: int = 20_000) -> Model:
    """Trains on at most ``rows`` labelled texts of at most ``longest`` code points, those with the smallest
    hash of the text: the documented bound of the training sample. Use reads whole texts of any length.
    """
    labelled = df.select(F.col(text).alias("t"), label_language(F.col(label)).alias("l"), F.xxhash64(text).alias("h")).where((F.length("t") <= longest) & F.col("l").isNotNull())
    # First the bound on hashes (8 bytes a row, equal texts once), then only the rows below it come to the driver.
    last = labelled.select("h").distinct().orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    if last is None:
        return train([], [])
    sample = labelled.where(F.col("h") <= last).groupBy("h").agg(F.min("t").alias("t"), F.min("l").alias("l")).orderBy("h").collect()
    return train([r.t for r in sample], [r.l for r in sample])


SEGMENT = StructType([
    StructField("begin", IntegerType(), False), StructField("end", IntegerType(), False),
    StructField("lang", StringType(), False), StructField("confidence", DoubleType(), False),
])


def segments_udf(model: Model):
    @F.pandas_udf(ArrayType(SEGMENT, False))
    def run(texts: pd.Series) -> pd.Series:
        done = segment_texts([None if t is None else t for t in texts], model)
        return pd.Series([None if d is None else [{"begin": b, "end": e, "lang": g, "confidence": c} for b, e, g, c in d] for d in done], dtype=object)

    return run


def with_segments(df: DataFrame, text: str, model: Model, min_chars: int) -> DataFrame:
    """``df`` with columns segments, langs (present languages, sorted) and main_lang, main_confidence.

    A language is present through one segment of ``min_chars`` or more code points (outer white
    space not counted); a text with no such segment has the language of its longest segment.
    """
    out = df.withColumn("segments", segments_udf(model)(F.col(text)))
    size = lambda s: F.length(F.trim(F.regexp_replace(F.substring(F.col(text), s["begin"] + 1, s["end"] - s["begin"]), r"^\s+|\s+$", "")))
    known = F.filter("segments", lambda s: s["lang"] != REJECTED)
    longest = F.try_element_at(F.reverse(F.array_sort(F.transform(known, lambda s: F.struct((s["end"] - s["begin"]).alias("n"), s["confidence"].alias("c"), s["lang"].alias("l"))))), F.lit(1))
    out = out.withColumns({"__long": F.filter(known, lambda s: size(s) >= min_chars), "__top": longest})
    langs = F.when(F.size("__long") > 0, F.array_sort(F.array_distinct(F.transform("__long", lambda s: s["lang"])))).when(F.col("__top").isNotNull(), F.array(F.col("__top.l")))
    return out.withColumns({
        "langs": F.when(F.col(text).isNotNull(), F.coalesce(langs, F.array(F.lit(REJECTED)))),
        "main_lang": F.when(F.col(text).isNotNull(), F.coalesce(F.col("__top.l"), F.lit(REJECTED))),
        "main_confidence": F.when(F.col(text).isNotNull(), F.coalesce(F.col("__top.c"), F.lit(0.0))),
    }).drop("__long", "__top")
