"""Ranking of character candidates by letter pairs and by a vocabulary."""

from __future__ import annotations

import math

#: Frequencies of letter pairs, and what smooths them.
PAIRS = (
    ("th", 3.56), ("he", 3.07), ("in", 2.43), ("er", 2.05), ("an", 1.99), ("re", 1.85), ("on", 1.76), ("at", 1.49), ("en", 1.45), ("nd", 1.35), ("ti", 1.34), ("es", 1.34),
    ("or", 1.28), ("te", 1.20), ("of", 1.17), ("ed", 1.17), ("is", 1.13), ("it", 1.12), ("al", 1.09), ("ar", 1.07), ("st", 1.05), ("to", 1.05), ("nt", 1.04), ("ng", 0.95),
    ("se", 0.93), ("ha", 0.93), ("as", 0.87), ("ou", 0.87), ("io", 0.83), ("le", 0.83), ("ve", 0.83), ("co", 0.79), ("me", 0.79), ("de", 0.76), ("hi", 0.76), ("ri", 0.73),
    ("ro", 0.73), ("ic", 0.70), ("ne", 0.69), ("ea", 0.69), ("ra", 0.69), ("ce", 0.65), ("li", 0.62), ("ll", 0.58), ("be", 0.58), ("ma", 0.57), ("si", 0.55), ("om", 0.55),
    ("ur", 0.54), ("ca", 0.54), ("il", 0.52), ("di", 0.50), ("t ", 2.00), (" t", 1.75), (" a", 1.70), ("e ", 1.90), (" s", 1.10), (" o", 0.90), ("d ", 0.95), ("s ", 1.50),
    (" i", 0.88), ("n ", 1.40), ("y ", 0.72), (" c", 0.75),
)
SMOOTH, SYMBOLS, FLOOR = 0.2, 27, -8.0
#: Weights of a pair's logarithm and of the vocabulary; what a word and a beginning of one are worth.
PAIR_WEIGHT, WORD_WEIGHT, WORD, BEGINNING, BEAM = 0.6, 0.8, 1.0, 0.2, 8

_rows: dict[str, float] = {}
for _pair, _n in PAIRS:
    _rows[_pair[0]] = _rows.get(_pair[0], 0.0) + _n
LOGS = {p: math.log((n + SMOOTH) / (_rows[p[0]] + SMOOTH * SYMBOLS)) for p, n in PAIRS}

#: Words of a vocabulary that is sent to every task at most.
WORDS = 1_000_000

Candidates = list[tuple[str, float]]


def pair_log(before: str, after: str) -> float:
    return LOGS.get((before + after).lower(), FLOOR)


def viterbi(glyphs: list[Candidates]) -> str:
    """The characters of the best sum of -distance and weighed pair logarithms; of equal ones the earlier candidates."""
    if not glyphs:
        return ""
    best = [(-d, c) for c, d in glyphs[0]]
    for cands in glyphs[1:]:
        new = []
        for c, d in cands:
            score, text = max(((s + PAIR_WEIGHT * pair_log(t[-1], c), t) for s, t in best), key=lambda x: x[0])
            new.append((score - d, text + c))
        best = new
    return max(best, key=lambda x: x[0])[1]


class Vocabulary:
    """Words and their beginnings."""

    def __init__(self, words):
        self.words = {w.split()[0].lower() for w in words if w.strip() and not w.strip().startswith("#")}
        self.beginnings = {w[:k] for w in self.words for k in range(1, len(w))}

    def bonus(self, text: str) -> float:
        """What the last word of a text is worth."""
        last = "" if not text or text[-1].isspace() else text.split()[-1].lower()
        return 0.0 if not last else WORD if last in self.words else BEGINNING if last in self.beginnings else 0.0


def collected(words) -> Vocabulary:
    """The vocabulary of a table (word) of checked size, as it goes to every task."""
    found = [r.word for r in words.where("word is not null and word <> ''").distinct().limit(WORDS + 1).collect()]
    if len(found) > WORDS:
        raise ValueError(f"more than {WORDS} words: keep the frequent ones")
    return Vocabulary(found)


def beam(glyphs: list[Candidates], vocabulary: Vocabulary, width: int = BEAM) -> str:
    """As viterbi(), with the vocabulary's bonus at every character, over the ``width`` best texts."""
    held = [(0.0, "")]
    for cands in glyphs:
        grown = []
        for s, t in held:
            for c, d in cands:
                u = t + c
                grown.append((s - d + PAIR_WEIGHT * pair_log(t[-1] if t else " ", c) + WORD_WEIGHT * vocabulary.bonus(u), u))
        held = sorted(grown, key=lambda x: -x[0])[: max(1, width)]
    return held[0][1]
