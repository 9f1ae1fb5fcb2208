"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lower-cases, replaces letters of other scripts that look like Latin ones and digits or signs that stand for
letters, and leaves words between single blanks. Lexicon entries are word stems (" stem") or whole words (" word ").
Their weights are log odds learned from labelled texts; hits inside an exception phrase do not count; the weight
found is set against the length of the text and calibrated to a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import map_texts, per_task
from waymark.llm.learning import fold, labelled_sample, logistic, sigmoid

# Characters that look like a Latin letter, and signs used in place of letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m",
    "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ſ": "s",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}

# English insults that count from the start, with phrases in which they are harmless.
INSULTS = (
    "bastard bitch clown crap dickhead disgusting dumb dumbass filth garbage idiot imbecile jerk loser moron pathetic "
    "pig retard scum shit shithead slut stupid trash vermin whore worthless"
).split()
HARMLESS = ("clown fish", "trash can", "trash bin", "garbage can", "garbage collection", "guinea pig", "pig iron")

STEM_LENGTHS = range(4, 9)
PRIOR_WEIGHT = 2.0

_TABLE = str.maketrans({**LOOKALIKES, **SUBSTITUTES, "​": None, "‌": None, "‍": None, "­": None, "﻿": None})
_FULL_WIDTH = str.maketrans({0xFF01 + i: 0x21 + i for i in range(94)})
_GAPS = re.compile(r"[\W_]+")
_FOLDED = re.compile("[0-9@$­ıɑɡſͰ-ԯ​-‍﻿！-～]")


def folded(text: str) -> str:
    """Lower-cased words between single blanks, look-alikes and substitutes replaced, a blank at both ends."""
    low = text.lower()
    if _FOLDED.search(low):
        low = low.translate(_FULL_WIDTH).translate(_TABLE)
    return f" {_GAPS.sub(' ', low).strip()} "


def entries(words: set[str]) -> set[str]:
    """Whole words and the stems of longer words."""
    out = set()
    for w in words:
        if len(w) >= 3:
            out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in STEM_LENGTHS if n < len(w))
    return out


def _gain(a: int, n: int, b: int, m: int) -> float:
    """Likelihood-ratio statistic of a of n against b of m."""
    both, total = a + b, n + m

    def part(x, k):
        return sum(v * math.log(v / e) for v, e in ((x, both * k / total), (k - x, (total - both) * k / total)) if v)

    return 2 * (part(a, n) + part(b, m))


def without_copies(texts: list[str]) -> list[str]:
    """The texts of a sample, without those that share half of their five-word runs with earlier ones.

    A group of near copies would else make its accidental words look like evidence.
    """
    seen: set[int] = set()
    out = []
    for t in texts:
        words = t.split()
        runs = {hash(tuple(words[i : i + 5])) for i in range(max(1, len(words) - 4))}
        if 2 * len(runs & seen) < len(runs):
            out.append(t)
        seen |= runs
    return out


def learn_lexicon(
    toxic: list[str], clean: list[str], least_gain: float, least_share: float, least_odds: float, size: int
) -> dict[str, float]:
    """Entries far commoner in toxic texts, with their log odds; a stem replaces the longer entries it explains.

    An entry must have a likelihood-ratio gain of ``least_gain``, and of ``least_share`` per toxic text.
    """
    found, other = Counter(), Counter()
    least_gain = max(least_gain, least_share * len(toxic))
    for t in toxic:
        found.update(entries(set(folded(t).split())))
    found = Counter({e: k for e, k in found.items() if k >= 3})
    for t in clean:
        other.update(e for e in entries(set(folded(t).split())) if e in found)
    n, m = len(toxic), len(clean)
    rated = []
    for e, a in found.items():
        b = other[e]
        odds = math.log((a + 0.5) / (n + 1)) - math.log((b + 0.5) / (m + 1))
        if odds >= least_odds and (gain := _gain(a, n, b, m)) >= least_gain:
            rated.append((gain, odds, e))
    rated.sort(key=lambda r: (len(r[2]), -r[0], r[2]))  # short stems first
    lexicon: dict[str, float] = {}
    for gain, odds, e in rated:
        if not any(e.startswith(s) and odds < lexicon[s] + 1 for s in (e[:k] for k in range(2, len(e))) if s in lexicon):
            lexicon[e] = odds
    best = sorted(lexicon, key=lambda e: (-lexicon[e], e))[:size]
    return {e: lexicon[e] for e in best}


def matcher(lexicon: dict[str, float], exceptions: list[str]):
    """A function from folded text to (summed weight, words hit)."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for e, w in lexicon.items():
        machine.add_word(e, (len(e), w))
    for p in exceptions:
        machine.add_word(f" {p} ", (len(p) + 2, None))
    if not len(machine):
        return lambda text: (0.0, [])
    machine.make_automaton()

    def match(text: str) -> tuple[float, list[str]]:
        hits: dict[int, float] = {}  # start of a word -> largest weight
        safe: list[tuple[int, int]] = []
        for end, (size, weight) in machine.iter(text):
            start = end - size + 1
            if weight is None:
                safe.append((start, end))
            else:
                hits[start] = max(weight, hits.get(start, 0.0))
        if safe:
            hits = {s: w for s, w in hits.items() if not any(a <= s and text.index(" ", s + 1) <= b for a, b in safe)}
        return sum(hits.values()), [text[s + 1 : text.index(" ", s + 1)] for s in hits]

    return match


def learn_exceptions(toxic: list[str], clean: list[str], match, least: int = 3) -> list[str]:
    """Word pairs around a hit that several clean texts hold and no toxic one does."""

    def pairs(text):
        words = folded(text).split()
        hit = set(match(folded(text))[1])
        return {f"{a} {b}" for a, b in zip(words, words[1:]) if a in hit or b in hit}

    seen = Counter(p for t in clean for p in pairs(t))
    common = {p for p, k in seen.items() if k >= least}
    return sorted(common - {p for t in toxic if common for p in pairs(t)})


def features(weight: float, words: int) -> tuple[float, float]:
    return math.log1p(weight), math.log1p(100 * weight / max(words, 1))


def measured(texts: list[str], match) -> np.ndarray:
    rows = []
    for t in texts:
        f = folded(t)
        rows.append(features(match(f)[0], f.count(" ") - 1))
    return np.array(rows).reshape(-1, 2)


def train_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = 2000,
    longest: int = 8192,
    least_gain: float = 14.0,
    least_share: float = 0.04,
    least_odds: float = 2.5,
    size: int = 2000,
) -> dict:
    """Lexicon, exceptions and calibration from at most ``per_class`` labelled texts a class (excerpts of ``longest``).

    Two thirds of them give the lexicon, the rest calibrates. Labels of the held-out fold are never read. Without
    labelled texts of both kinds the built-in words alone count, with a fixed calibration.
    """
    texts = labelled_sample(docs, labels, "toxic", per_class, longest)
    texts = {y: without_copies(t) for y, t in texts.items()}
    build = {y: [t for i, t in enumerate(texts[y]) if i % 3] for y in (0, 1)}
    rest = {y: texts[y][::3] for y in (0, 1)}
    lexicon = {f" {w} ": PRIOR_WEIGHT for w in INSULTS}
    lexicon |= learn_lexicon(build[1], build[0], least_gain, least_share, least_odds, size)
    exceptions = sorted({*HARMLESS, *learn_exceptions(build[1], build[0], matcher(lexicon, list(HARMLESS)))})
    weights = np.array([-4.0, 2.0, 1.0])
    if rest[0] and rest[1]:
        x = measured(rest[0] + rest[1], matcher(lexicon, exceptions))
        weights = logistic(x, np.array([0] * len(rest[0]) + [1] * len(rest[1])))
    return {"lexicon": lexicon, "exceptions": exceptions, "weights": weights}


def score_toxicity(docs: DataFrame, model: dict, threshold: float = 0.7, keep_text: bool = False) -> DataFrame:
    """Add ``held_out``, ``score`` (0 to 1, higher: toxic), ``predicted`` (1 from ``threshold``) and ``n_hits``.

    Null and empty texts have no hits and get the score of the calibration there. Repeated rows score alike.
    """
    lexicon, exceptions, w = model["lexicon"], model["exceptions"], model["weights"]

    @per_task
    def scorer():
        match = matcher(lexicon, exceptions)

        def columns(texts):
            scores, hits = [], []
            for t in texts:
                f = folded(t)
                weight, words = match(f)
                a, b = features(weight, f.count(" ") - 1)
                scores.append(float(sigmoid(w[0] + w[1] * a + w[2] * b)))
                hits.append(len(words))
            return {"score": scores, "n_hits": hits}

        return columns

    scored = map_texts(docs, scorer, "score double, n_hits bigint", keep_text=keep_text)
    return scored.withColumns({"held_out": fold() == 1, "predicted": (F.col("score") >= threshold).cast("int")})


def keep_clean(docs: DataFrame, model: dict, threshold: float = 0.7) -> DataFrame:
    """The documents below the threshold, with their columns as they were."""
    names = [f"_c{i}" for i in range(len(docs.columns))]  # a column of docs may be called score
    at = docs.columns.index("text"), docs.columns.index("doc_id")
    plain = docs.toDF(*names).withColumnsRenamed({names[at[0]]: "text", names[at[1]]: "doc_id"})
    kept = score_toxicity(plain, model, threshold, keep_text=True).filter(F.col("predicted") == 0)
    return kept.select(*plain.columns).toDF(*docs.columns)
