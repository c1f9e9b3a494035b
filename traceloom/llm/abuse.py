"""Abusive, hateful or sexual content: class-conditional Kneser-Ney models.

Two trigram models, one of toxic and one of ordinary sentences, share the counts that they
back off to.  A document's score is the highest length-normalised difference of its log-likelihoods
under them, over its sentences and over windows within long sentences, so one abusive line in a long text counts.

Labels are given per document, so training alternates: sentences of toxic documents that the
ordinary model finds new start the toxic model, then each sentence goes to the model that explains it better.  Annotators
are reduced to their majority first.  The threshold is the one with the best F1 on held-out folds.

Spelling is normalised before counting: letter case, accents, look-alike letters, digits and signs
for letters, invisible characters, marks inside words, stretched and spaced-out letters; a masked letter (``*``) matches any.
All texts are read whole; a batch is scored with array operations only, without a Python step per word.

Defined results: null and blank texts score -20 (the lowest) and are not found; with no
toxic or no ordinary label nothing is found; repeated rows give one row per document.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceloom.functions.keys import id_key

MAX_CHARS = 64_000_000  # characters of those documents, at most
MAX_TOXIC, MAX_ORDINARY = 4000, 4000  # labelled documents of each class the models are fitted on, at most
CHUNK = 40_000  # characters per round of array operations, so that the arrays stay in the processor's cache
TOXIC = ("insult", "threat", "hate", "sexual")
DISCOUNT, WINDOW, PRIOR_LENGTH, FOLDS, ROUNDS, LOWEST = 0.75, 8, 4.0, 3, 3, -20.0
UNKNOWN, NUMBER, CODE, START = 0, 1, 2, 3  # ids of the words that are not looked up

# Letters of other scripts that look like Latin ones, and signs used for letters.
LOOK_ALIKE = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ԁ": "d", "ո": "n", "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "ε": "e", "υ": "u", "ı": "i", "ß": "s", "ø": "o", "ł": "l", "đ": "d", "æ": "a", "œ": "o"}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a"}
_JOINERS = "-_.'’`´·•~^|+"
_LETTER, _DIGIT, _SIGN, _STAR, _JOIN, _SPACE, _STOP, _WIDE, _OTHER, _GONE = range(1, 11)
_SIZE = 0x20000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point: its class, its normalised letter, and the letter a sign stands for."""
    kind, letter = np.full(_SIZE, _OTHER, np.uint8), np.arange(_SIZE, dtype=np.uint32)
    for c in range(_SIZE):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        cat = unicodedata.category(ch)
        if cat in ("Cf", "Mn", "Me") or c == 0xAD:
            kind[c] = _GONE
            continue
        base = unicodedata.normalize("NFKD", ch)[:1].lower() or ch
        base = unicodedata.normalize("NFKD", LOOK_ALIKE.get(base, base))[:1]
        letter[c] = min(ord(base), _SIZE - 1)
        cat = unicodedata.category(base)
        if 0x3040 <= ord(base) <= 0x9FFF or 0xAC00 <= ord(base) <= 0xD7AF or ord(base) >= 0x20000:
            kind[c] = _WIDE
        elif cat[0] == "L":
            kind[c] = _LETTER
        elif cat == "Nd":
            kind[c] = _DIGIT
        elif cat[0] == "Z" or ch in "\t\f\v":
            kind[c] = _SPACE
    for c in "\n\r  \u0085.!?;。！？；…\x00":
        kind[ord(c)] = _STOP
    for c in _JOINERS.replace(".", ""):
        kind[ord(c)] = _JOIN
    kind[ord("*")], kind[ord("$")], kind[ord("@")] = _STAR, _SIGN, _SIGN
    stands = np.arange(_SIZE, dtype=np.uint32)
    for a, b in SIGNS.items():
        stands[ord(a)] = ord(b)
    return kind, letter, stands


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hash(word: str) -> int:
    """The hash of a normalised word, as ``words`` computes it."""
    total, power = 0, 1
    for c in word:
        total = (total + (ord(c) + 1) * power) & (1 << 64) - 1
        power = power * int(_BASE) & (1 << 64) - 1
    return total


@dataclass
class Words:
    hashes: np.ndarray  # per word; 0 to 2 for unknown, numbers and codes
    segment: np.ndarray  # per word
    document: np.ndarray  # per word
    spelt: list[str] | None = None


def words(texts: list[str], spell: bool = False) -> Words:
    """The normalised words of texts, with the sentence and the document each belongs to."""
    kind_of, letter_of, stands_for = _tables()
    codes = np.frombuffer("\x00".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.minimum(codes, _SIZE - 1)
    doc = np.cumsum(codes == 0, dtype=np.int32) if len(texts) > 1 else np.zeros(len(codes), np.int32)
    kind = kind_of[codes]
    keep = kind != _GONE
    if not keep.all():
        codes, kind, doc = codes[keep], kind[keep], doc[keep]
    letter = letter_of[codes]

    def drop(out: np.ndarray) -> None:
        nonlocal letter, kind, doc
        if out.any():
            stay = ~out
            letter, kind, doc = letter[stay], kind[stay], doc[stay]

    def inner(mask: np.ndarray) -> np.ndarray:
        """Of the marked characters those between two letters or digits."""
        word = (kind == _LETTER) | (kind == _DIGIT) | (kind == _SIGN) | (kind == _STAR)
        out = np.zeros(len(kind), bool)
        if len(kind) > 2:
            out[1:-1] = mask[1:-1] & word[:-2] & word[2:]
        return out

    drop(inner((kind == _JOIN) | (letter == ord("."))))
    # stretched letters: a run of three or more counts as one
    if len(letter) > 2:
        same = (letter[1:] == letter[:-1]) & (kind[1:] == _LETTER) & (kind[:-1] == _LETTER)
        run = np.zeros(len(letter), bool)
        run[1:-1] = same[:-1] & same[1:]
        wide = run.copy()
        wide[1:] |= run[:-1]
        wide[:-1] |= run[1:]
        out = np.zeros(len(letter), bool)
        out[1:] = wide[1:] & same
        drop(out)
    # letters spaced out: three or more single letters in a row close up
    if len(letter) > 4:
        word = (kind == _LETTER) | (kind == _STAR) | (kind == _SIGN)
        edge = np.ones(len(kind) + 2, bool)
        edge[1:-1] = kind == _SPACE
        near = np.ones(len(kind) + 2, bool)
        near[1:-1] = ~(word | (kind == _DIGIT) | (kind == _WIDE))
        single = word & near[:-2] & near[2:]
        gap = np.zeros(len(kind), bool)
        gap[1:-1] = (kind[1:-1] == _SPACE) & single[:-2] & single[2:]
        at = np.flatnonzero(gap)
        if at.size:
            linked = np.diff(at) == 2
            many = np.zeros(len(at), bool)
            many[1:] |= linked
            many[:-1] |= linked
            out = np.zeros(len(kind), bool)
            out[at[many]] = True
            drop(out)

    word = (kind == _LETTER) | (kind == _DIGIT) | (kind == _SIGN) | (kind == _STAR)
    n = len(word)
    # a word starts after something else; wide characters are words of their own
    begin, end = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    begin[:n] = word
    begin[1:n] &= ~word[:-1]
    end[1:] = word
    end[1:n] &= ~word[1:]
    wide = np.flatnonzero(kind == _WIDE)
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end)
    if wide.size:
        starts, ends = np.concatenate([starts, wide]), np.concatenate([ends, wide + 1])
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]
    if not starts.size:
        none = np.zeros(0, np.int64)
        return Words(none.astype(np.uint64), none, none.astype(np.int32), [] if spell else None)
    # digits and signs for letters, where a letter follows them in the word
    sign = (kind == _DIGIT) | (kind == _SIGN)
    count = lambda mask: np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    letters, signs, digits = count(kind == _LETTER), count(sign), count(kind == _DIGIT)
    led = np.zeros(n, bool)
    led[:-1] = sign[:-1] & (kind[1:] == _LETTER)
    leads = count(led)
    inside = lambda c: c[ends] - c[starts]
    mixed = (inside(leads) > 0) & (inside(letters) > 0) & (letters[np.minimum(starts + 1, n)] - letters[starts] + inside(leads) > 0) & (inside(signs) < ends - starts)
    if mixed.any():
        change = np.zeros(n + 1, np.int32)
        np.add.at(change, starts[mixed], 1)
        np.add.at(change, ends[mixed], -1)
        in_mixed = np.cumsum(change[:n]) > 0
        letter = np.where(in_mixed & sign, stands_for[np.minimum(letter, _SIZE - 1)], letter)
    up, down = _powers(1 << (n + 1).bit_length())
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((letter.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * down[starts]
    hashes[(inside(digits) > 0) & ~mixed & (inside(letters) > 0)] = CODE
    hashes[(inside(letters) == 0) & (inside(signs) > 0)] = NUMBER
    stops = np.cumsum(kind == _STOP, dtype=np.int64)
    segment = stops[starts]
    spelt = ["".join(map(chr, letter[a:b])) for a, b in zip(starts, ends)] if spell else None
    return Words(hashes, segment, doc[starts], spelt)


@dataclass
class Model:
    """Sorted keys and the probabilities of both classes (toxic, ordinary), as log-ready arrays."""

    vocabulary: np.ndarray  # sorted hashes
    ids: np.ndarray
    size: int
    uni: np.ndarray  # [2, size]
    back1: np.ndarray  # [2, size] weight of the unigram after a word
    bi_keys: np.ndarray
    bi: np.ndarray  # [2, n] discounted part
    back2: np.ndarray  # [2, n] weight of the bigram after a pair
    tri_keys: np.ndarray
    tri: np.ndarray  # [2, n]
    threshold: float = 0.0

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, self.ids[at], np.where(hashes < 3, hashes.astype(np.int64), UNKNOWN))

    def ratios(self, ids: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """log P(word | two words before it, toxic) - the same for ordinary, per word."""
        w, v, u = _history(ids, segment)
        at2, has2 = _find(self.bi_keys, v * self.size + w)
        before, has_pair = _find(self.bi_keys, u * self.size + v)
        at3, has3 = _find(self.tri_keys, (u * self.size + v) * self.size + w)
        logs = []
        for c in (0, 1):
            p = self.uni[c][w] * self.back1[c][v] + np.where(has2, self.bi[c][at2], 0)
            p = p * np.where(has_pair, self.back2[c][before], 1) + np.where(has3, self.tri[c][at3], 0)
            logs.append(np.log(p))
        return logs[0] - logs[1]


def _history(ids: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w, v, u = ids, np.full(len(ids), START, np.int64), np.full(len(ids), START, np.int64)
    same = segment[1:] == segment[:-1]
    v[1:] = np.where(same, ids[:-1], START)
    u[2:] = np.where(segment[2:] == segment[:-2], ids[:-2], START)
    return w, v, u


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _grouped(owner: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(owner, weight, size)


def fit_models(ids: np.ndarray, segment: np.ndarray, toxic: np.ndarray, size: int, vocabulary: np.ndarray, vocabulary_ids: np.ndarray) -> Model:
    """Interpolated Kneser-Ney models of both classes; ``toxic`` marks the words of toxic sentences."""
    w, v, u = _history(ids, segment)
    trigram, parts = (u * size + v) * size + w, []
    for c in (toxic, ~toxic):
        keys3, n3 = np.unique(trigram[c], return_counts=True)
        keys2, n2 = np.unique(keys3 % (size * size), return_counts=True)  # how many words precede each pair
        n1 = _grouped(keys2 % size, np.ones(len(keys2)), size)  # how many words precede each word
        parts.append((keys3, n3, keys2, n2, n1))
    # pairs (u, v) that open a trigram belong to the table of pairs too, for their back-off weight
    tri_keys = np.unique(np.concatenate([p[0] for p in parts]))
    bi_keys = np.unique(np.concatenate([*[p[2] for p in parts], tri_keys // size]))
    shared = parts[0][4] + parts[1][4] + 0.5
    shared /= shared.sum()
    uni, back1, bi, back2, tri = [], [], [], [], []
    for keys3, n3, keys2, n2, n1 in parts:
        kept, spare = np.maximum(n1 - DISCOUNT, 0), DISCOUNT * max((n1 > 0).sum(), 1)
        uni.append((kept + spare * shared) / (kept.sum() + spare))
        opener = keys2 // size
        sums, kinds = _grouped(opener, n2, size), _grouped(opener, np.ones(len(keys2)), size)
        back1.append(np.where(sums > 0, DISCOUNT * kinds / np.maximum(sums, 1), 1.0))
        part = np.zeros(len(bi_keys))
        part[np.searchsorted(bi_keys, keys2)] = (n2 - DISCOUNT) / sums[opener]
        bi.append(part)
        opener = np.searchsorted(bi_keys, keys3 // size)
        sums, kinds = _grouped(opener, n3, len(bi_keys)), _grouped(opener, np.ones(len(keys3)), len(bi_keys))
        back2.append(np.where(sums > 0, DISCOUNT * kinds / np.maximum(sums, 1), 1.0))
        part = np.zeros(len(tri_keys))
        part[np.searchsorted(tri_keys, keys3)] = (n3 - DISCOUNT) / sums[opener]
        tri.append(part)
    f = lambda x: np.array(x, np.float32)
    return Model(vocabulary, vocabulary_ids, size, f(uni), f(back1), bi_keys, f(bi), f(back2), tri_keys, f(tri))


def _segment_scores(ratio: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and score of each segment: the highest length-normalised ratio of the whole or of a window in it."""
    first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
    length = np.diff(np.append(first, len(segment)))
    sums = np.concatenate([[0.0], np.cumsum(ratio)])
    whole = (sums[first + length] - sums[first]) / (length + PRIOR_LENGTH)
    best = np.full(len(ratio), -np.inf)
    for size in (WINDOW // 2, WINDOW):
        if len(ratio) >= size:
            inside = segment[size - 1 :] == segment[: len(segment) - size + 1]
            value = (sums[size:] - sums[:-size]) / (size + PRIOR_LENGTH)
            best[: len(value)] = np.maximum(best[: len(value)], np.where(inside, value, -np.inf))
    return first, np.maximum(whole, np.maximum.reduceat(best, first))


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        to, chars = at, 0
        while to < len(texts) and (to == at or chars < CHUNK):
            chars += len(texts[to])
            to += 1
        yield at, to
        at = to


def score_texts(model: Model, texts: list[str]) -> np.ndarray:
    """The score of each text: that of its highest sentence."""
    out = np.full(len(texts), LOWEST)
    for a, b in _chunks(texts):
        found = words(texts[a:b])
        if found.hashes.size:
            first, score = _segment_scores(model.ratios(model.lookup(found.hashes), found.segment), found.segment)
            np.maximum.at(out, found.document[first] + a, score)
    return out


def _vocabulary(found: Words, toxic_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """Words seen twice, or once in a toxic document, with the spellings in which one letter is masked; and each word's id."""
    hashes, at, n = np.unique(found.hashes, return_inverse=True, return_counts=True)
    in_toxic = np.zeros(len(hashes), bool)
    in_toxic[at[toxic_words]] = True
    chosen = np.flatnonzero((hashes > 3) & ((n >= 2) | in_toxic))
    ids = np.zeros(len(hashes), np.int64)
    ids[chosen] = np.arange(len(chosen)) + 4
    ids[hashes < 3] = hashes[hashes < 3]
    table = dict(zip(hashes[chosen].tolist(), ids[chosen].tolist()))
    example = np.zeros(len(hashes), np.int64)
    example[at] = np.arange(len(at))
    masked: dict[int, int] = {}
    for i in chosen[in_toxic[chosen]]:
        word = found.spelt[example[i]]
        if len(word) >= 3 and word.isalpha():
            for k in range(1, len(word)):
                masked.setdefault(word_hash(word[:k] + "*" + word[k + 1 :]), int(ids[i]))
    for h, i in masked.items():
        table.setdefault(h, i)
    keys = np.array(sorted(table), np.uint64)
    return keys, np.array([table[int(k)] for k in keys], np.int64), len(chosen) + 4, ids[at]


@dataclass
class Labelled:
    """The words of labelled documents, looked up once."""

    ids: np.ndarray
    segment: np.ndarray  # numbered from 0 without gaps
    document: np.ndarray
    toxic: np.ndarray  # per document
    vocabulary: np.ndarray
    vocabulary_ids: np.ndarray
    size: int

    def of(self, documents: np.ndarray) -> Labelled:
        """The part that belongs to the marked documents."""
        at = documents[self.document]
        segment = self.segment[at]
        renumbered = np.cumsum(np.concatenate([[0], segment[1:] != segment[:-1]])) if segment.size else segment
        return Labelled(self.ids[at], renumbered, self.document[at], self.toxic, self.vocabulary, self.vocabulary_ids, self.size)


def prepare(texts: list[str], toxic: np.ndarray) -> Labelled:
    parts, segments = [], 0
    for a, b in _chunks(texts):
        found = words(texts[a:b], spell=True)
        if found.hashes.size:
            _, segment = np.unique(found.segment, return_inverse=True)
            parts.append((found.hashes, segment + segments, found.document.astype(np.int64) + a, found.spelt))
            segments += int(segment[-1]) + 1
    hashes, segment, document = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.uint64 if i == 0 else np.int64) for i in range(3))
    found = Words(hashes, segment, document, [w for p in parts for w in p[3]])
    vocabulary, vocabulary_ids, size, ids = _vocabulary(found, toxic[document])
    return Labelled(ids, segment, document, toxic, vocabulary, vocabulary_ids, size)


def train(data: Labelled, rounds: int = ROUNDS) -> Model:
    """Models of labelled documents; sentences of toxic documents are told apart in ``rounds`` rounds."""
    ids, segment = data.ids, data.segment
    first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
    length = np.diff(np.append(first, len(segment)))
    owner, of_toxic = data.document[first], data.toxic[data.document]
    candidate = of_toxic[first]

    def chosen(score: np.ndarray, above: float) -> np.ndarray:
        top = np.full(len(data.toxic), -np.inf)
        np.maximum.at(top, owner[candidate], score[candidate])
        return candidate & ((score >= top[owner]) | (score > above))

    def fitted(toxic_segments: np.ndarray) -> Model:
        return fit_models(ids, segment, toxic_segments[segment], data.size, data.vocabulary, data.vocabulary_ids)

    # at the start: how much of a sentence is unknown to ordinary documents
    w, v, _ = _history(ids, segment)
    pair = v * data.size + w
    known, seen = np.unique(pair[~of_toxic]), np.zeros(data.size, bool)
    seen[w[~of_toxic]] = True
    new = 1.0 * ~_find(known, pair)[1] + 2.0 * ~seen[w]
    model = fitted(chosen(_grouped(segment, new, len(first)) / (length + PRIOR_LENGTH), 0.8))
    for _ in range(rounds):
        model = fitted(chosen(_segment_scores(model.ratios(ids, segment), segment)[1], 0.0))
    return model


def best_threshold(score: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """The threshold with the highest F1, halfway to the next score, and that F1."""
    order = np.argsort(-score, kind="stable")
    hits = np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + toxic.sum())
    at = int(np.argmax(f1))
    below = score[order[min(at + 1, len(order) - 1)]]
    return float((score[order[at]] + below) / 2), float(f1[at])


def fit(texts: list[str], toxic: np.ndarray) -> Model | None:
    """Models fitted on all labelled texts, with a threshold found on held-out folds."""
    toxic = np.asarray(toxic, bool)
    if not toxic.any() or toxic.all():
        return None
    data = prepare(texts, toxic)
    if not data.ids.size:
        return None
    held, fold = np.full(len(texts), LOWEST), np.zeros(len(texts), np.int64)
    for c in (True, False):  # every fold has its share of both classes
        at = np.flatnonzero(toxic == c)
        fold[at] = np.arange(len(at)) % FOLDS
    for k in range(FOLDS):
        rest, out = data.of(fold != k), data.of(fold == k)
        if not out.ids.size or not toxic[fold != k].any() or toxic[fold != k].all():
            continue
        seen = np.zeros(data.size, bool)
        seen[rest.ids] = True
        first, score = _segment_scores(train(rest).ratios(np.where(seen[out.ids], out.ids, UNKNOWN), out.segment), out.segment)
        np.maximum.at(held, out.document[first], score)
    model = train(data)
    model.threshold = best_threshold(held, toxic)[0]
    return model


def majority(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """One label per document by majority of its distinct annotations; ``unsure`` and ties give none."""
    votes = labels.select(key, "annotator", F.lower(F.trim("category")).alias("c")).distinct().filter(F.col("c").isin("none", *TOXIC))
    each = votes.groupBy(key).agg(F.sum(F.when(F.col("c") == "none", -1).otherwise(1)).alias("_sum"))
    return each.filter(F.col("_sum") != 0).select(key, (F.col("_sum") > 0).alias("toxic"))


def fit_on_labels(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", most: tuple[int, int] = (MAX_TOXIC, MAX_ORDINARY), most_chars: int = MAX_CHARS) -> Model | None:
    """Models fitted on at most ``most`` labelled documents of each class, those with the lowest hash of their key.

    They come to the driver, so beside their number their characters are bounded: a document that would pass ``most_chars`` is left out of the sample.
    """
    known = majority(labels, key)
    toxic, ordinary = (known.filter(c).orderBy(F.xxhash64(key), key).limit(n) for c, n in (("toxic", most[0]), ("not toxic", most[1])))
    sample = docs.select(key, text).filter(F.col(text).isNotNull()).join(toxic.unionByName(ordinary), key).dropDuplicates([key])  # bounded by ``most``
    so_far = F.sum(F.length(text).cast("bigint")).over(Window.orderBy(F.xxhash64(key), key))
    rows = sample.withColumn("_chars", so_far).filter(F.col("_chars") <= most_chars).drop("_chars").collect()
    rows.sort(key=lambda r: r[key])
    return fit([r[text] for r in rows], np.array([r["toxic"] for r in rows], bool))


def score_documents(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """Columns: key, ``also``, score, found.  One narrow stage; the models are broadcast, their size is bounded by the labelled sample."""
    rows = docs.select(key, *also, text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    names = [*rows.columns[:-1], "score", "found"]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(len(names) - 2).to_pylist()]
            value = score_texts(sent.value, texts) if sent.value is not None else np.full(len(texts), LOWEST)
            hit = value >= sent.value.threshold if sent.value is not None else np.zeros(len(texts), bool)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.round(value, 6)), pa.array(hit)], names)

    return rows.mapInArrow(score, f"{schema}, score double, found boolean")


def rate_report(scored: DataFrame, source: str = "source") -> DataFrame:
    """Per source (equal but for letter case and outer white space; NULL: unknown) the documents, those found, and their rate."""
    out = scored.groupBy(id_key(F.col(source)).alias("source_name")).agg(F.count(F.lit(1)).alias("n_documents"), F.count_if("found").alias("n_found"))
    return out.withColumn("rate", F.round(F.col("n_found") / F.col("n_documents"), 6))
