"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded first: lower case, letters of other scripts that look like Latin ones, and digits
and signs that stand for letters inside a word.  The lexicon is learned from a bounded
sample of labelled texts: words and word beginnings, each weighted by the log odds of
its texts, chosen one after the other for what the chosen ones don't explain yet, so
that words which only happen to stand in a toxic text aren't taken.  Phrases in which
an entry stands in texts that aren't toxic become exceptions: matches inside them don't
count.  A text's weights are added, normalised by its length and mapped to a probability by a
logistic curve that is fitted on the part of the sample that the lexicon wasn't learned from.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .shared import prepare, stored

#: Labelled rows that are learned from at most: those with the smallest hashes of their ids.
SAMPLE = 20_000
#: Entries and exceptions of a lexicon at most, and lengths of word beginnings.
ENTRIES, STEMS = 2000, range(4, 9)
#: Texts that an entry must explain, alone or as part of several, and a share of the toxic texts if that is more.
LEAST, SHARE = 3.0, 0.004
#: What a toxic text counts at least.
FLOOR = 0.3
#: How much likelier (natural logarithm) than the chance of all candidates together an entry's texts must be.
SURE = 4.0
#: Texts that are not toxic that a phrase must stand in to be an exception.
EXCEPTION = 3
#: The least share of toxic texts among those with an entry, outside exceptions.
PRECISION = 0.5
#: Words from which on length counts.
WORDS = 100

#: Letters of Greek and Cyrillic that look like Latin ones, and what stands for letters within words.  Fixed values.
LOOKS = dict(zip("αβγεηικνορτυχωабвгезікмнорстухѕјԁһԛԝ", "abyenikvoptuxwabbre3ikmhopctyxsjdhqw", strict=True)) | {"з": "e", "г": "r", "ł": "l", "ı": "i", "ø": "o"}
SIGNS = dict(zip("0134578@$!|+", "oieastbasilt", strict=True))

_ODD = re.compile(r"\S*[" + re.escape("".join(LOOKS) + "".join(SIGNS)) + "­​-‍⁠﻿！-～\U0001d400-\U0001d7ff" + r"]\S*")
_HIDDEN = dict.fromkeys(map(ord, "­​‌‍⁠﻿"))
_LETTERS = str.maketrans(LOOKS)
_CORE = re.compile(r"(?<![^\W_])[" + re.escape("".join(SIGNS)) + r"]*[^\W\d_](?:[^\W_]|[" + re.escape("".join(SIGNS)) + r"](?=[^\W_]))*")
_SIGNS = str.maketrans(SIGNS)
_WORD = re.compile(r"[^\W_]+")


def _fold_word(found: re.Match) -> str:
    word = unicodedata.normalize("NFKC", found[0]).lower().translate(_HIDDEN).translate(_LETTERS)
    return _CORE.sub(lambda m: m[0].translate(_SIGNS), word)


def fold(text: str | None) -> str:
    """Lower case without hidden characters; look-alike letters, and signs within words, as the letters that they stand for.

    Signs at the end of a word (``word!!``) stay, and numbers without a letter do.
    """
    return _ODD.sub(_fold_word, (text or "").lower())


def features(folded: str, known: set[str] | None = None) -> set[str]:
    """Words as `` word `` and beginnings of words as `` begin``; of ``known`` ones alone, if given."""
    words = set(_WORD.findall(folded))
    found = {f" {w} " for w in words} | {" " + b for k in STEMS for b in {w[:k] for w in words if len(w) > k}}
    return found if known is None else found & known


def origin(folded: str) -> int:
    """The smallest hash of the runs of four words: most near copies of a text have the same."""
    words = folded.split()
    return min((xxhash.xxh64_intdigest(" ".join(words[i : i + 4])) for i in range(max(1, len(words) - 3))), default=0)


@dataclass
class Lexicon:
    """Weights of entries, phrases that are exceptions, and the curve ``1 / (1 + exp(-(intercept + slope * evidence)))``."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    intercept: float = -math.inf
    slope: float = 0.0


class Matcher:
    """Aho-Corasick over a lexicon's entries and exceptions; word edges are checked where an entry was found."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.automaton = ahocorasick.Automaton()
        held: dict[str, list[tuple[bool, bool, float | None]]] = defaultdict(list)
        for entry, weight in lexicon.weights.items():
            held[entry.strip()].append((entry[0] == " ", entry[-1] == " ", weight))
        for phrase in lexicon.exceptions:
            held[phrase.strip()].append((True, True, None))
        for key, kinds in held.items():
            self.automaton.add_word(key, (len(key), kinds))
        if held:
            self.automaton.make_automaton()
        self.some = bool(held)

    def matches(self, folded: str) -> list[tuple[int, int, float]]:
        """``start, end, weight`` of matches outside of exceptions; of several at one word the heaviest counts."""
        if not self.some:
            return []
        found, void, n = [], [], len(folded)
        for last, (size, kinds) in self.automaton.iter(folded):
            start, end = last + 1 - size, last + 1
            opens = not start or not folded[start - 1].isalnum()
            closes = end == n or not folded[end].isalnum()
            for at_start, at_end, weight in kinds:
                if (opens or not at_start) and (closes or not at_end):
                    (void.append((start, end)) if weight is None else found.append((start, end, weight)))
        best: dict[int, tuple[int, int, float]] = {}
        for start, end, weight in found:
            if not any(a <= start and end <= b for a, b in void) and (start not in best or weight > best[start][2]):
                best[start] = (start, end, weight)
        return sorted(best.values())

    def evidence(self, folded: str) -> float:
        """Added weights of the different words matched, by length: a word says less in a longer text, by the logarithm of its words."""
        found = self.matches(folded)
        if not found:
            return 0.0
        words: dict[str, float] = {}
        for start, end, weight in found:
            while end < len(folded) and folded[end].isalnum():
                end += 1
            words[folded[start:end]] = max(weight, words.get(folded[start:end], 0.0))
        return sum(words.values()) / (1 + math.log1p(len(folded.split()) / WORDS))

    def score(self, folded: str) -> float:
        x = self.lexicon.intercept + self.lexicon.slope * self.evidence(folded)
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))


def surprise(bad: int, good: int, share: float) -> float:
    """How unlikely (natural logarithm, by Chernoff's bound) so many toxic texts among a word's are if toxic texts have no more of it than others."""
    n = bad + good
    if bad <= share * n:
        return 0.0
    return bad * math.log(bad / (n * share)) + (good * math.log(good / (n * (1 - share))) if good else 0.0)


def choose(texts: list[set[str]], toxic: list[bool], counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Entries and weights, the most explaining first.

    A toxic text counts half as much for each entry that it holds already, down to ``FLOOR``; an
    entry is worth how surprising its texts are, by what its toxic ones still count.
    Of entries alike the longest is taken.  Entries that begin with a chosen one are left out,
    and those whose toxic texts chance may explain.
    """
    positive, negative = sum(toxic), len(toxic) - sum(toxic)
    holding: dict[str, list[int]] = defaultdict(list)
    for k, (own, bad) in enumerate(zip(texts, toxic, strict=True)):
        if bad:
            for x in own:
                holding[x].append(k)
    least = max(LEAST, SHARE * positive)
    holding = {x: own for x, own in holding.items() if len(own) >= least}
    chance, share = math.log(max(1, len(holding))) + SURE, positive / max(1, positive + negative)
    weights, open_entries = {}, {}
    for x, own in holding.items():
        bad, good = counts.get(x, (len(own), 0))
        if bad >= PRECISION * (bad + good) and surprise(bad, good, share) >= chance:
            open_entries[x] = math.log((bad + 0.5) / (positive + 1)) - math.log((good + 0.5) / (negative + 1))
    left = np.array(toxic, float)
    while open_entries and len(weights) < ENTRIES:
        worth = {}
        for x in open_entries:
            bad, good = counts.get(x, (len(holding[x]), 0))
            worth[x] = surprise(bad, good, share) * left[holding[x]].sum() / bad
        best = max(open_entries, key=lambda x: (round(worth[x], 9), len(x), x))
        if worth[best] < chance:
            break
        weights[best] = open_entries[best]
        left[holding[best]] = np.maximum(left[holding[best]] / 2, FLOOR)
        begins = best.rstrip()
        open_entries = {x: o for x, o in open_entries.items() if worth[x] >= chance and not x.startswith(best) and not (x.rstrip() == begins or begins.startswith(x))}
    return weights


def phrases(folded: str, entries: Iterable[str]) -> set[str]:
    """Words with entries together with the word before, the word after, or both."""
    words = _WORD.findall(folded)
    whole, begins = {e.strip() for e in entries if e[-1] == " "}, tuple(e.strip() for e in entries if e[-1] != " ")
    out = set()
    for i, w in enumerate(words):
        if w in whole or (begins and w.startswith(begins)):
            before, after = words[max(0, i - 1) : i], words[i + 1 : i + 2]
            out |= {" ".join([*before, w]), " ".join([w, *after])} - {w}
    return out


def _outside(folded: str, exceptions: tuple[str, ...]) -> str:
    for phrase in exceptions:
        if phrase in folded:
            folded = re.sub(rf"(?<![^\W_]){re.escape(phrase)}(?![^\W_])", " ", folded)
    return folded


def fit_curve(evidence: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a logistic curve by Newton's steps, slightly drawn to 0."""
    design = np.stack([np.ones(len(evidence)), evidence], 1)
    at = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -30, 30)))
        slope = design.T @ (toxic - p) - 0.01 * at
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2), slope)
        at += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(at[0]), float(max(at[1], 0.0))


def _entries(texts: list[str], toxic: list[bool]) -> tuple[dict[str, float], dict[str, tuple[int, int]]]:
    """Chosen entries, and how many toxic and other texts hold each feature that toxic ones have."""
    found = [features(t) if bad else set() for t, bad in zip(texts, toxic, strict=True)]
    bad = Counter(x for own in found for x in own)
    known = {x for x, n in bad.items() if n >= LEAST}
    good = Counter(x for t, b in zip(texts, toxic, strict=True) if not b for x in features(t, known))
    counts = {x: (bad[x], good[x]) for x in known}
    return choose([own & known for own in found], toxic, counts), counts


def learn_sample(sample: list[tuple[int, bool, str]]) -> Lexicon:
    """A lexicon from rows ``(hash of the id, toxic, folded text)``; of texts alike in their smallest hash one counts."""
    rows = list({(bad, origin(text)): (h, bad, text) for h, bad, text in sorted(sample, reverse=True)}.values())
    if not any(bad for _, bad, _ in rows):
        return Lexicon()
    texts, toxic = [x for h, _, x in rows if h % 6], [bad for h, bad, _ in rows if h % 6]
    if not any(toxic):
        return Lexicon(intercept=math.log(0.5 / (len(rows) + 1)))
    weights, counts = _entries(texts, toxic)
    # Phrases are sought around words that they may have kept out, too: those that toxic texts have twice as often as others.
    share = sum(toxic) / len(toxic)
    likely = set(weights) | {x for x, (bad, good) in counts.items() if x[-1] == " " and good >= EXCEPTION and bad >= max(LEAST, SHARE * sum(toxic)) and surprise(bad, good, 2 * share / (1 + share)) > SURE}
    seen: dict[bool, Counter] = {True: Counter(), False: Counter()}
    for text, bad in zip(texts, toxic, strict=True):
        seen[bad].update(phrases(text, likely))
    exceptions = tuple(sorted(p for p, good in seen[False].items() if good >= EXCEPTION and 2 * seen[True][p] <= share * (good + seen[True][p])))
    if exceptions:
        weights, _ = _entries([_outside(t, exceptions) for t in texts], toxic)
    # Only exceptions around entries that were taken, those in the most texts first.
    exceptions = tuple(sorted((p for p in exceptions if phrases(p, weights)), key=lambda p: (-seen[False][p], p))[:ENTRIES])
    lexicon = Lexicon(weights, exceptions)
    matcher = Matcher(lexicon)
    rest = [(matcher.evidence(t), bad) for h, bad, t in rows if not h % 6] or [(matcher.evidence(t), bad) for t, bad in zip(texts, toxic, strict=True)]
    lexicon.intercept, lexicon.slope = fit_curve(np.array([e for e, _ in rest]), np.array([float(b) for _, b in rest]))
    return lexicon


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """A lexicon from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``.

    At most ``sample`` labelled rows, those of the smallest hashes of their ids, are folded in
    Spark and come to the driver, which fits the lexicon on them.  Rows without an id, a text or a label teach nothing, nor do ids
    of contradicting labels; without any toxic text the lexicon is empty and all scores are 0 or near it.
    """
    prepare(docs.sparkSession)
    h = F.xxhash64("doc_id")
    clear = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most")
    known = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"))
    ids = clear.join(known, "doc_id", "left_semi").orderBy(h, "doc_id").limit(sample).select("doc_id", "toxic")
    ids = F.broadcast(stored(ids, "labelled-sample"))  # at most ``sample`` rows of two numbers

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("toxic"), pa.array([fold(t) for t in batch.column("text").to_pylist()], pa.string())], names=["h", "toxic", "text"])

    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id")
    # Repeated ids may stand for more rows than ids; of equal texts one is enough.
    rows = rows.select(F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(1 << 30)).alias("h"), (F.col("toxic") == 1).alias("toxic"), "text").dropDuplicates(["toxic", "text"]).limit(sample)
    return learn_sample([(r["h"], r["toxic"], r["text"]) for r in rows.mapInArrow(folded, "h long, toxic boolean, text string").toLocalIterator()])


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``docs`` with ``toxicity double`` of each text, from 0 to 1; null and empty texts have the score of no evidence.

    All other columns, repeated rows and rows without an id stay; a column
    ``toxicity`` is replaced.  An empty table gives no rows.
    """
    prepare(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd

        matcher = Matcher(lexicon)
        return pd.Series([round(matcher.score(fold(t)), 6) for t in texts], dtype="float64")

    return docs.withColumn("toxicity", scored("text"))
