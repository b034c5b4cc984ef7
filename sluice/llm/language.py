"""Language identification: script ranges, per-word scores, Viterbi with a switching penalty.

A word's letters name its script, and only languages seen in that script are candidates.
A word scores, per language, the log likelihood of its hashed character n-grams. Viterbi
over the words of a text, where every change of language costs a penalty, labels spans of
mixed-language text; the language with most letters wins.

The classifier is fitted on a bounded, hash-ordered sample of labelled rows; the counts of
that sample are made by Spark, and the model has a fixed number of buckets per language.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



# Labelled rows the model is fitted on, lowest hash of the key first.
TRAIN_ROWS = 6_000
BUCKETS = 1 << 15
PENALTY = 12.0
UNKNOWN = "und"
# Share of a language's training letters below which a script is not one of its own.
SCRIPT_SHARE = 0.01
# Text gathered before labelling, and words whose scores are remembered: memory bounds only.
GATHER_CHARS = 12_000_000
CACHE_WORDS = 200_000

# First and last code point, script.
SCRIPTS = (
    (0x0041, 0x024F, "Latin"),
    (0x0250, 0x02AF, "Latin"),
    (0x0370, 0x03FF, "Greek"),
    (0x0400, 0x052F, "Cyrillic"),
    (0x0530, 0x058F, "Armenian"),
    (0x0590, 0x05FF, "Hebrew"),
    (0x0600, 0x06FF, "Arabic"),
    (0x0750, 0x077F, "Arabic"),
    (0x0900, 0x097F, "Devanagari"),
    (0x0980, 0x09FF, "Bengali"),
    (0x0B80, 0x0BFF, "Tamil"),
    (0x0E00, 0x0E7F, "Thai"),
    (0x10A0, 0x10FF, "Georgian"),
    (0x1100, 0x11FF, "Hangul"),
    (0x1E00, 0x1EFF, "Latin"),
    (0x1F00, 0x1FFF, "Greek"),
    (0x3040, 0x30FF, "Kana"),
    (0x3400, 0x9FFF, "Han"),
    (0xAC00, 0xD7AF, "Hangul"),
)
_SCRIPT_NAMES = [*sorted({s for _, _, s in SCRIPTS}), "Other"]
_FIRSTS = np.array([a for a, _, _ in SCRIPTS])
_LASTS = np.array([b for _, b, _ in SCRIPTS])
_NUMBERS = np.array([_SCRIPT_NAMES.index(s) for _, _, s in SCRIPTS])
_WORD = re.compile(r"[^\W\d_]+")


def scripts_of(words: list[str]) -> np.ndarray:
    """Number of the script of each word's first letter."""
    codes = np.fromiter((ord(w[0]) for w in words), np.int64, len(words))
    at = np.searchsorted(_FIRSTS, codes, "right") - 1
    inside = (at >= 0) & (codes <= _LASTS[at])
    return np.where(inside, _NUMBERS[at], len(_SCRIPT_NAMES) - 1)


def text_words(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    return _WORD.findall((text or "").lower())


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of one to three of words, and each one's word number.

    Bigrams and trigrams see the ends of a word, marked as ``^`` and ``$``.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    joined = "^" + "$^".join(words) + "$"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    inner = np.ones(len(code), bool)
    inner[np.cumsum(sizes) - sizes] = False
    inner[np.cumsum(sizes) - 1] = False
    with np.errstate(over="ignore"):
        one = (code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        two = one[:-1] * np.uint64(0xBF58476D1CE4E5B9) + one[1:]
        three = two[:-1] * np.uint64(0x94D049BB133111EB) + one[2:]
        parts = [one[inner], two[owner[:-1] == owner[1:]], three[owner[:-2] == owner[2:]]]
        mixed = np.concatenate(parts)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    owners = [owner[inner], owner[:-1][owner[:-1] == owner[1:]], owner[:-2][owner[:-2] == owner[2:]]]
    return (mixed >> np.uint64(40)).astype(np.int64) % BUCKETS, np.concatenate(owners)


def held_out(key: Column) -> Column:
    """Whether a row's key puts it into the held-out third. A null key does not."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _count(batches):
    """(lang, slot, n) of one task: buckets, and below zero the scripts' letters."""
    words: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words.setdefault(lang, Counter()).update(text_words(text))
    for lang, found in words.items():
        if not found:
            continue
        names = list(found)
        times = np.fromiter(found.values(), np.int64, len(names))
        buckets, owner = grams(names)
        counts = np.bincount(buckets, times[owner], BUCKETS)
        letters = times * np.fromiter(map(len, names), np.int64, len(names))
        scripts = np.bincount(scripts_of(names), letters, len(_SCRIPT_NAMES))
        slots = np.concatenate((np.flatnonzero(counts), -1 - np.flatnonzero(scripts)))
        sums = np.concatenate((counts[counts > 0], scripts[scripts > 0]))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * len(slots), pa.string()),
                pa.array(slots, pa.int32()),
                pa.array(sums.astype(np.int64)),
            ],
            names=["lang", "slot", "n"],
        )


class Model:
    """Log likelihoods per language and bucket, and the languages of each script."""

    def __init__(self, counts: list[tuple[str, int, int]]):
        self.langs = sorted({lang for lang, _, _ in counts})
        place = {lang: i for i, lang in enumerate(self.langs)}
        table = np.full((len(self.langs), BUCKETS), 0.5)
        letters = np.zeros((len(self.langs), len(_SCRIPT_NAMES)))
        for lang, slot, n in counts:
            if slot >= 0:
                table[place[lang], slot] += n
            else:
                letters[place[lang], -1 - slot] += n
        self.logs = np.log(table / table.sum(axis=1, keepdims=True)).T.astype(np.float32) if self.langs else None
        own = letters / np.maximum(letters.sum(axis=1, keepdims=True), 1)
        self.open = (own >= SCRIPT_SHARE).T

    def scores(self, words: list[str]) -> np.ndarray:
        """Log likelihood of every word in every language; far below for other scripts."""
        buckets, owner = grams(words)
        total = np.stack(
            [np.bincount(owner, self.logs[buckets, i], len(words)) for i in range(len(self.langs))], axis=1
        )
        allowed = self.open[scripts_of(words)]
        other = ~allowed & allowed.any(axis=1, keepdims=True)
        return np.where(other, total - 1e4, total).astype(np.float32)


def fit(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    rows: int = TRAIN_ROWS,
) -> Model:
    """A model of at most ``rows`` labelled texts outside the held-out third.

    The driver sees one count per (language, bucket) of the sample, never a text.
    """
    usable = docs.where(~held_out(F.col(key)) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    picked = usable.where(F.col(key).isNotNull()).select(F.col(key).alias("_picked")).distinct()
    picked = picked.orderBy(F.xxhash64("_picked"), "_picked").limit(rows)
    sample = usable.join(F.broadcast(picked), F.col(key) == F.col("_picked"), "left_semi")
    counts = sample.select(F.col(lang), F.col(text)).mapInArrow(_count, "lang string, slot int, n bigint")
    totals = counts.groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    return Model([(r.lang, r.slot, r.n) for r in totals.toLocalIterator()])


def viterbi(scores: np.ndarray, starts: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every word; one step labels the same place of all texts at once."""
    n_langs = scores.shape[1]
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), "left")
    labels = np.zeros(len(scores), np.uint8)
    if not longest:
        return labels
    back = np.zeros(scores.shape, np.uint8)
    own = np.arange(n_langs, dtype=np.uint8)
    best = scores[starts[: active[0]]].astype(np.float64)
    for t in range(1, longest):
        k = active[t]
        now = best[:k]
        top = now.argmax(axis=1)
        switch = (now[np.arange(k), top] - penalty)[:, None]
        stay = now >= switch
        at = starts[:k] + t
        back[at] = np.where(stay, own, top[:, None])
        best[:k] = np.where(stay, now, switch) + scores[at]
    state = best.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        k = active[t]
        at = starts[:k] + t
        labels[at] = state[:k]
        state[:k] = back[at, state[:k]]
    return labels


class Labeller:
    """Labels texts with one model; remembers word scores up to a bound."""

    def __init__(self, model: Model, penalty: float):
        self.model, self.penalty = model, penalty
        self._forget()

    def _forget(self) -> None:
        self.places: dict[str, int] = {}
        self.table = np.zeros((0, len(self.model.langs)), np.float32)
        self.letters = np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        at = len(self.places)
        self.places.update(zip(words, range(at, at + len(words))))
        self.table = np.concatenate((self.table, self.model.scores(words)))
        letters = [len(w) if w.isalpha() else sum(map(str.isalpha, w)) for w in words]
        self.letters = np.concatenate((self.letters, np.array(letters, np.int64)))

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[dict]]]:
        """Language, share of letters and spans of every text."""
        if not self.model.langs:
            return [(UNKNOWN, 0.0, []) for _ in texts]
        if len(self.places) > CACHE_WORDS:
            self._forget()
        words = [text_words(t) for t in texts]
        if fresh := list(set().union(*words).difference(self.places)):
            self._learn(sorted(fresh))
        number = self.places.__getitem__
        numbers = [np.fromiter(map(number, w), np.int64, len(w)) for w in words]
        sizes = np.array([len(n) for n in numbers], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        flat = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        letters = self.letters[flat]
        labels = viterbi(self.table[flat], starts, sizes, self.penalty)
        out = []
        for a, n in zip(starts.tolist(), sizes.tolist()):
            weight = np.bincount(labels[a : a + n], letters[a : a + n], len(self.model.langs))
            if not weight.sum():
                out.append((UNKNOWN, 0.0, []))
                continue
            best = int(weight.argmax())
            cuts = np.flatnonzero(np.diff(labels[a : a + n])) + 1
            edges = [0, *cuts.tolist(), n]
            spans = [
                {"first_word": x, "n_words": y - x, "lang": self.model.langs[labels[a + x]]}
                for x, y in zip(edges, edges[1:])
            ]
            out.append((self.model.langs[best], float(weight[best] / weight.sum()), spans))
        return out


RESULT = "struct<lang:string,score:double,spans:array<struct<first_word:int,n_words:int,lang:string>>>"


def identify(docs: DataFrame, model: Model, text: str = "text", penalty: float = PENALTY) -> DataFrame:
    """``row`` (the input columns but the text), ``lang``, ``score`` and ``spans``.

    One output row per input row. A null text, or one without a letter, is ``und`` with
    score 0 and no spans; so is every text if nothing could be learned. Ties go to the
    language that sorts first.
    """
    slim = docs.drop(text)
    rest = F.struct(*[F.col(f"`{c}`") for c in slim.columns]) if slim.columns else F.struct(F.lit(0))
    def run(batches):
        # The model comes with the task's code; Spark broadcasts that once it is large.
        labeller = Labeller(model, penalty)
        held, chars = [], 0

        def flush():
            texts = [t for b in held for t in b.column(1).to_pylist()]
            found = labeller.label(texts)
            at = 0
            for b in held:
                part = found[at : at + b.num_rows]
                at += b.num_rows
                result = pa.array([{"lang": x, "score": s, "spans": p} for x, s, p in part], type=_ARROW)
                yield pa.RecordBatch.from_arrays([b.column(0), result], names=["row", "out"])
            held.clear()

        for batch in batches:
            held.append(batch)
            chars += batch.column(1).nbytes
            if chars >= GATHER_CHARS:
                yield from flush()
                chars = 0
        yield from flush()

    pairs = docs.select(rest.alias("row"), F.col(f"`{text}`").alias("body"))
    schema = pairs.select("row", F.lit(None).cast(RESULT).alias("out")).schema
    return pairs.mapInArrow(run, schema).select("row", "out.lang", "out.score", "out.spans")


_ARROW = pa.struct(
    [
        ("lang", pa.string()),
        ("score", pa.float64()),
        (
            "spans",
            pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32()), ("lang", pa.string())])),
        ),
    ]
)

