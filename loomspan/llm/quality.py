"""Problem 10: text statistics, and a Gaussian mixture that tells prose from the rest.

A document's lines are described by standardised statistics. A mixture of
Gaussians is fitted to the lines of a bounded sample of labelled documents by
expectation-maximization; each component is then mapped to prose or not by the
labels: a component's weight of being no prose is fitted so that documents
more than half of whose characters lie in such components are those labelled
so. All documents are scored with the fitted mixture, line by line.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.runtime import checkpointed
from loomspan.tables import load

#: Bound of the labelled sample that the mixture is fitted on: documents, and characters of them in sum.
FIT_DOCUMENTS = 3_000
FIT_CHARACTERS = 50_000_000
COMPONENTS = 40
#: Characters of prose that every document is taken to have besides its own, as a few words tell little.
PRIOR = 20
ROUNDS = 40
SEED = 7

# Common words of English, German, French and Spanish.
COMMON_WORDS = (
    "the of and to in is it that was for on are as with his they at be this from have or had by not but what all were when we there can an which their if will each about how up out them then she many some so these would into has more her two him see no than been who its now my did get may our i you he a "
    "der die das und in den von zu mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei noch wie einem einen so zum war haben nur oder aber vor zur bis mehr durch wir ich wurde bleibt "
    "le la les de des du et un une est que qui dans pour pas par sur au avec plus ne se ce il elle sont mais nous je a été cette son ses leur à où si aux l d "
    "el los las y del en que es un una por con para no se su al lo como más o pero sus le ya fue este ha sí porque esta entre cuando muy sin sobre también me hay donde yo"
).split()

#: Bits of a character's class.
LETTER, DIGIT, SPACE, UPPER, PUNCTUATION, DELIMITER, SYMBOL, GARBLED, BREAK, MARK = (1 << i for i in range(10))
#: Characters of ordinary punctuation, of delimiters, and those that UTF-8 read as a one-byte code page leaves.
_PUNCTUATION = ".,;:!?'\"’‘“”„«»…¿¡()-–—"
_DELIMITERS = "|\t{}[]=<>_/\\→;,"
_GARBLED = "ÃÂ€™œ¤¢¿¼¶Ÿ¡©"
FEATURES = (
    "length", "words", "word_length", "letters", "digits", "symbols", "spaces", "uppers", "delimiters", "common", "number_words",
    "wide_blanks", "marker", "punctuated", "same_as_last", "odd_joins", "distinct_words", "garbled", "long_words",
)


@functools.cache
def character_classes() -> tuple[np.ndarray, np.ndarray]:
    """Class bits and lower case of each code point below the first astral plane's end."""
    n = 0x20000
    bits, lower = np.zeros(n, np.uint16), np.arange(n, dtype=np.uint32)
    for i in range(n):
        if 0xD800 <= i < 0xE000:
            continue
        c = chr(i)
        kind = unicodedata.category(c)
        b = 0
        if kind[0] == "L":
            b |= LETTER | (UPPER if kind == "Lu" else 0)
        elif kind[0] == "N":
            b |= DIGIT
        elif c.isspace() or kind == "Cc":
            b |= SPACE
        elif kind[0] == "M" or kind == "Cf":
            b |= MARK
        elif c not in _PUNCTUATION:
            b |= SYMBOL
        if c in _PUNCTUATION:
            b |= PUNCTUATION
        if c in _DELIMITERS:
            b |= DELIMITER
        if c in _GARBLED:
            b |= GARBLED
        bits[i] = b
        if len(c.lower()) == 1:
            lower[i] = ord(c.lower())
    bits[10] |= BREAK
    return bits, lower


def _word_keys(code: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A word's length and its first seven characters, packed."""
    key = np.minimum(lengths, 255).astype(np.uint64)
    last = len(code) - 1
    for k in range(7):
        own = np.where(lengths > k, code[np.minimum(starts + k, last)] & 255, 0).astype(np.uint64)
        key |= own << np.uint64(8 * (k + 1))
    return key


@functools.cache
def _common_keys() -> np.ndarray:
    words = sorted({w for w in COMMON_WORDS if len(w) <= 7})
    code = np.concatenate([np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words])
    lengths = np.array([len(w) for w in words])
    return np.unique(_word_keys(code, np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths))


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, characters, number of the text) of each line that isn't blank."""
    if not texts:
        return np.zeros((0, len(FEATURES))), np.zeros(0), np.zeros(0, np.int64)
    classes, lowers = character_classes()
    joined = "\n".join(t.replace("\r\n", "\n").replace("\r", "\n") for t in texts) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    small = np.minimum(code, len(classes) - 1)
    bits = classes[small]
    low = np.where(code < len(classes), lowers[small], code)
    breaks = np.flatnonzero(code == 10)
    begin = np.concatenate([[0], breaks[:-1] + 1])
    per_text = np.array([t.replace("\r\n", "\n").replace("\r", "\n").count("\n") + 1 for t in texts])
    text_of = np.repeat(np.arange(len(texts)), per_text)
    total = lambda mask: np.add.reduceat(mask.astype(np.int32), begin).astype(float)
    has = lambda b: (bits & b) != 0

    letter, digit, space = has(LETTER), has(DIGIT), has(SPACE)
    inside = ~space
    n = total(inside)
    before = lambda m: np.concatenate([[False], m[:-1]])
    word_char = letter | digit | has(MARK)
    begins = word_char & ~before(word_char)
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(before(word_char) & ~word_char) if len(starts) else np.zeros(0, np.int64)
    lengths = ends - starts
    line_of = np.searchsorted(begin, starts, "right") - 1
    keys = _word_keys(low, starts, lengths)
    count = lambda m: np.bincount(line_of[m], minlength=len(begin)).astype(float)
    words = np.bincount(line_of, minlength=len(begin)).astype(float)
    common = count(np.isin(keys, _common_keys()))
    numbers = count(digit[starts]) if len(starts) else words
    long_words = count(lengths > 20)
    mixed = keys ^ (line_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    if len(mixed):
        _, first = np.unique(mixed, return_index=True)
        distinct = np.bincount(line_of[first], minlength=len(begin)).astype(float)
    else:
        distinct = words
    same = inside & (code == np.concatenate([[0], code[:-1]]))
    upper = has(UPPER)
    odd = (upper & before(letter & ~upper)) | (digit & before(letter)) | (letter & before(digit))
    wide = space & before(space) & (code != 10) | (code == 9)

    # the first and the last character of a line that isn't blank
    at = np.where(inside, np.arange(len(code)), len(code) - 1)
    first_at = np.minimum(np.minimum.reduceat(at, begin), len(code) - 1)
    last_at = np.maximum.reduceat(np.where(inside, np.arange(len(code)), 0), begin)
    first, last, second = code[first_at], code[last_at], code[np.minimum(first_at + 1, len(code) - 1)]
    third = code[np.minimum(first_at + 2, len(code) - 1)]
    is_in = lambda c, chars: np.isin(c, [ord(x) for x in chars])
    after = np.where(digit[np.minimum(first_at + 1, len(code) - 1)], third, second)
    marker = (is_in(first, "-*•+·–") & is_in(second, " \t")) | (digit[first_at] & is_in(after, ".)"))
    punctuated = is_in(last, ".!?…»”\"'’:)")

    m, w = np.maximum(n, 1), np.maximum(words, 1)
    raw = np.column_stack([
        np.log1p(n), np.log1p(words), np.minimum(np.bincount(line_of, weights=lengths, minlength=len(begin)) / w, 25), total(letter) / m, total(digit) / m,
        total(has(SYMBOL) & inside) / m, total(space & (code != 10)) / (m + 1), total(upper) / m, total(has(DELIMITER)) / m, common / w, numbers / w,
        np.minimum(total(wide) / m, 1), marker, punctuated, total(same) / m, total(odd) / m, distinct / w, total(has(GARBLED)) / m, long_words / w,
    ])
    keep = n > 0
    return raw[keep], n[keep], text_of[keep]


@dataclass
class Mixture:
    """A fitted mixture: standardisation, Gaussians with diagonal covariance, and what each component is."""

    mean: np.ndarray
    scale: np.ndarray
    log_weight: np.ndarray
    centre: np.ndarray
    variance: np.ndarray
    other: np.ndarray
    kinds: list[str]

    def responsibilities(self, raw: np.ndarray) -> np.ndarray:
        x = (raw - self.mean) / self.scale
        p = _log_density(x, self.log_weight, self.centre, self.variance)
        p = np.exp(p - p.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def _log_density(x: np.ndarray, log_weight: np.ndarray, centre: np.ndarray, variance: np.ndarray) -> np.ndarray:
    inv = 1 / variance
    square = (x**2) @ inv.T - 2 * x @ (centre * inv).T + (centre**2 * inv).sum(1)
    return log_weight - 0.5 * (square + np.log(variance).sum(1))


def fit_mixture(raw: np.ndarray, weight: np.ndarray, components: int = COMPONENTS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """Expectation-maximization on standardised statistics of weighted lines."""
    rng = np.random.default_rng(seed)
    mean = np.average(raw, axis=0, weights=weight)
    scale = np.sqrt(np.average((raw - mean) ** 2, axis=0, weights=weight)) + 1e-6
    x = (raw - mean) / scale
    k = min(components, len(x))
    # centres far from each other: each drawn by its squared distance to those there
    centre = x[[rng.integers(len(x))]]
    gap = ((x - centre[0]) ** 2).sum(1)
    for _ in range(k - 1):
        centre = np.vstack([centre, x[rng.choice(len(x), p=(gap + 1e-12) / (gap + 1e-12).sum())]])
        gap = np.minimum(gap, ((x - centre[-1]) ** 2).sum(1))
    variance, log_weight = np.ones_like(centre), np.full(k, -np.log(k))
    for _ in range(rounds):
        p = _log_density(x, log_weight, centre, variance)
        p = np.exp(p - p.max(1, keepdims=True))
        r = p / p.sum(1, keepdims=True) * weight[:, None]
        mass = r.sum(0) + 1e-9
        centre = r.T @ x / mass[:, None]
        variance = np.maximum(r.T @ x**2 / mass[:, None] - centre**2, 0.02)
        log_weight = np.log(mass / mass.sum())
    return mean, scale, log_weight, centre, variance


def shares(r: np.ndarray, chars: np.ndarray, text_of: np.ndarray, n: int) -> np.ndarray:
    """Share of each text's characters in each component."""
    out = np.zeros((n, r.shape[1]))
    np.add.at(out, text_of, r * chars[:, None])
    return out / (out.sum(1, keepdims=True) + PRIOR)


def map_components(share: np.ndarray, other: np.ndarray, rounds: int = 3000) -> np.ndarray:
    """For each component how far it is no prose, from 0 to 1, fitted on labelled documents.

    A document is no prose if its components' mean weight exceeds one half;
    both kinds of documents count alike in sum.
    """
    weight = np.where(other, 0.5 / max(other.sum(), 1), 0.5 / max((~other).sum(), 1))
    theta = np.zeros(share.shape[1])  # its logistic is the component's weight
    prior = share.T @ np.where(other, weight, -weight)
    theta = np.clip(prior * 20, -2, 2)
    m = v = np.zeros_like(theta)
    for i in range(1, rounds + 1):
        own = 1 / (1 + np.exp(-theta))
        p = 1 / (1 + np.exp(-12 * (share @ own - 0.5)))
        g = share.T @ (weight * (p - other)) * 12 * own * (1 - own) + 1e-5 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - 0.03 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-9)
    return 1 / (1 + np.exp(-theta))


def train(texts: list[str], labels: list[str]) -> Mixture:
    """A mixture from labelled texts; without any, one in which all is prose."""
    raw, chars, text_of = line_features(texts)
    if not len(raw):
        one = np.zeros((1, len(FEATURES)))
        return Mixture(one[0], one[0] + 1, np.zeros(1), one, one + 1, np.zeros(1), ["prose"])
    names = np.array(labels)
    size = {k: max((names == k).sum(), 1) for k in set(labels)}
    weight = np.array([1 / np.sqrt(size[k]) for k in labels])[text_of]
    fitted = fit_mixture(raw, weight * len(raw) / weight.sum())
    mixture = Mixture(*fitted, np.zeros(len(fitted[2])), [])
    share = shares(mixture.responsibilities(raw), chars, text_of, len(texts))
    mixture.other = map_components(share, names != "prose")
    kinds = sorted(set(labels))
    typical = np.array([share[names == k].mean(0) for k in kinds])
    for j, o in enumerate(mixture.other):
        mixture.kinds.append("prose" if o < 0.5 else max((k for k in kinds if k != "prose"), key=lambda k: typical[kinds.index(k), j], default="junk"))
    return mixture


def labelled_sample(documents: DataFrame, labels: DataFrame, most: int = FIT_DOCUMENTS, characters: int = FIT_CHARACTERS) -> list[tuple[str, str]]:
    """(text, label) of at most `most` labelled documents, chosen by a hash of their ids, whole, with `characters` in sum at most.

    At most `most` label rows are broadcast, so the documents aren't shuffled.
    Of rows with one doc_id the least text counts.
    """
    chosen = labels.filter("label is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most).groupBy("doc_id").agg(F.min("label").alias("label"))
    met = documents.filter("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = checkpointed(met.groupBy("doc_id", "label").agg(F.min("text").alias("text")))  # at most `most` rows
    sized = rows.withColumn("sum", F.sum(F.char_length("text").cast("long")).over(W.orderBy(F.xxhash64("doc_id"), "doc_id")))
    taken = sized.filter(F.col("sum") <= characters).select("text", "label", "doc_id").collect()
    return [(r.text, r.label) for r in sorted(taken, key=lambda r: r.doc_id)]


def classify(documents: DataFrame, mixture: Mixture) -> DataFrame:
    """(doc_id, kind, other_share) of each document whose text isn't blank.

    other_share is the share of characters, white space apart, that is no
    natural prose; kind is prose where it is at most one half, else the kind
    with the most characters. Narrow: no shuffle.
    """
    shared = documents.sparkSession.sparkContext.broadcast(mixture)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        kinds = sorted(set(m.kinds) - {"prose"}) or ["junk"]
        member = np.array([[float(k == x) for k in kinds] for x in m.kinds])
        for pdf in batches:
            # a part at a time bounds memory where texts are very long
            for part in _parts(pdf):
                texts = part["text"].tolist()
                raw, chars, text_of = line_features(texts)
                share = shares(m.responsibilities(raw), chars, text_of, len(texts)) if len(raw) else np.zeros((len(texts), len(m.kinds)))
                other = share @ m.other
                kind = np.where(other > 0.5, np.array(kinds)[(share @ member).argmax(1)], "prose")
                seen = share.sum(1) > 0
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[seen], "kind": kind[seen], "other_share": other[seen]})

    return documents.filter("text is not null").select("doc_id", "text").mapInPandas(run, "doc_id long, kind string, other_share double")


def _parts(pdf: pd.DataFrame, most: int = 2_000_000) -> Iterator[pd.DataFrame]:
    size = pdf["text"].str.len().to_numpy().cumsum() // most
    for _, part in pdf.groupby(size, sort=False):
        yield part


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents")
    sample = labelled_sample(documents, load(spark, sf_dir, "doc_labels"))
    return classify(documents, train([t for t, _ in sample], [k for _, k in sample]))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id) of the documents more than half of which is no natural prose."""
    return _classified(spark, sf_dir).filter("other_share > 0.5").select("doc_id")


def p10_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, kind, other_share) of every document that isn't blank."""
    return _classified(spark, sf_dir)


def statistics(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, mean_word_length, symbol_share, punctuated_share, common_share), one row a document.

    Words are runs of letters and digits. symbol_share is of the characters
    other than white space; punctuated_share of the lines that aren't blank.
    Shares of nothing are 0; null texts count as empty. All in the JVM.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    d = documents.select("doc_id", text.alias("t"), words.alias("w"))
    share = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    solid = F.regexp_replace("t", r"\s", "")
    lines = F.filter(F.split("t", r"\r\n|\r|\n"), lambda x: x.rlike(r"\S"))
    ended = F.size(F.filter(lines, lambda x: x.rlike(r"[.!?…:;\"'”»)]\s*$")))
    common = F.array(*[F.lit(x) for x in sorted(set(COMMON_WORDS))])
    return d.select(
        "doc_id",
        F.size("w").alias("n_words"),
        share(F.aggregate("w", F.lit(0), lambda a, x: a + F.char_length(x)), F.size("w")).alias("mean_word_length"),
        share(F.char_length(F.regexp_replace(solid, r"[\p{L}\p{N}]", "")), F.char_length(solid)).alias("symbol_share"),
        share(ended, F.size(lines)).alias("punctuated_share"),
        share(F.size(F.filter("w", lambda x: F.array_contains(common, x))), F.size("w")).alias("common_share"),
    )


def p10_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of every document."""
    return statistics(load(spark, sf_dir, "documents"))


P10_STATS_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
e AS (SELECT *, regexp_replace(t, '\s', '', 'g') AS solid, list_filter(regexp_split_to_array(t, '\r\n|\r|\n'), lambda x: regexp_matches(x, '\S')) AS lines FROM d)
SELECT doc_id, CAST(len(w) AS INTEGER) AS n_words,
  round(CASE WHEN len(w) > 0 THEN length(array_to_string(w, '')) / len(w) ELSE 0.0 END, 6) AS mean_word_length,
  round(CASE WHEN length(solid) > 0 THEN length(regexp_replace(solid, '[\p{L}\p{N}]', '', 'g')) / length(solid) ELSE 0.0 END, 6) AS symbol_share,
  round(CASE WHEN len(lines) > 0 THEN len(list_filter(lines, lambda x: regexp_matches(x, '[.!?…:;"''”»)]\s*$'))) / len(lines) ELSE 0.0 END, 6) AS punctuated_share,
  round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: x IN (""" + ", ".join(f"'{w}'" for w in sorted(set(COMMON_WORDS))) + r"""))) / len(w) ELSE 0.0 END, 6) AS common_share
FROM e
"""  # fmt: skip
