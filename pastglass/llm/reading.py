"""Texts made readable for a classifier: disguises undone, words and letter groups as hashed features."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

#: Letters of other scripts that look like Latin ones. Fixed values.
LOOKALIKES = str.maketrans("аеорсухіјѕӏԁԛԝһтвнкмαοενρτυχκ", "aeopcyxijsldqwhtbhkmaoevptuxk")
#: Accents that Spanish and its neighbours use. Fixed values.
ACCENTS = str.maketrans("áàâäãéèêëíìîïóòôöõúùûüñç", "aaaaaeeeeiiiiooooouuuunc")
#: Digits and signs used for letters. Fixed values.
SIGNS = str.maketrans("01345789@$", "oieastbgas")
HIDDEN = re.compile("[­​-‏‪-‮⁠-⁤︀-️﻿̀-ͯ]")
MASKED = re.compile(r"(?<=\w)[*#@$%&]{2,}(?=\w)|[*#]+")
SPACED = re.compile(r"(?<![\w@$])[a-z0-9@$]([ .\-_*|])[a-z0-9@$](?:\1[a-z0-9@$])+(?![\w@$])")
SPACED_HANGUL = re.compile(r"(?<![가-힣])[가-힣](?: [가-힣](?![가-힣]))+")
SPLIT_HANGUL = re.compile(r"(?<=[가-힣])[0-9*.\-_~^|]+(?=[가-힣])")
#: Only tried where a word begins, so long runs cost linear time.
MIXED = re.compile(r"(?<![a-z0-9@$])[a-z0-9@$]*[0-9@$][a-z0-9@$]*")
LETTER = re.compile("[a-z]")
NUMBER, AGAIN, WORD = re.compile(r"\d+"), re.compile(r"(.)\1{2,}"), re.compile(r"[\w*']+")
GAPS = re.compile(r"[ .\-_*|]+")
#: Lengths in letters of the letter groups, and in words of the windows that are judged.
GROUPS, WINDOWS = (2, 3, 4, 5), (6, 12)
_BASE, _MIX = np.uint64(1_099_511_628_211), np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """The words of a text: one case, no look-alikes, hidden characters, inserted signs, spacing or stretching (three and more of a letter)."""
    t = HIDDEN.sub("", unicodedata.normalize("NFKC", HIDDEN.sub("", text)).casefold()).translate(LOOKALIKES).translate(ACCENTS)
    t = SPACED.sub(lambda m: GAPS.sub("", m[0]), t)
    t = MASKED.sub("*", SPLIT_HANGUL.sub("", t))
    t = SPACED_HANGUL.sub(lambda m: m[0].replace(" ", ""), t)
    t = MIXED.sub(lambda m: m[0].translate(SIGNS) if LETTER.search(m[0]) else m[0], t)
    return WORD.findall(AGAIN.sub(r"\1", NUMBER.sub("0", t)))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE, np.uint64)]), dtype=np.uint64)


def _slot(h: np.ndarray, kind: int) -> np.ndarray:
    """Features as numbers: odd ones are of words, even ones of letter groups."""
    h = (h ^ np.uint64(kind * 7919)) * _MIX
    return ((h ^ (h >> np.uint64(29))) * _MIX >> np.uint64(32)).astype(np.uint32) & np.uint32(0xFFFFFFFE) | np.uint32(kind > max(GROUPS))


def _word_hashes(letters: np.ndarray) -> np.ndarray:
    """A hash of each word of letters, in which a space is before, between and after the words."""
    cuts = np.flatnonzero(letters == 32)
    total = np.concatenate([[np.uint64(0)], np.cumsum(letters * _powers(len(letters) - 1), dtype=np.uint64)])
    back = _powers(len(letters))[::-1]
    return (total[cuts[1:]] - total[cuts[:-1] + 1]) * back[cuts[:-1] + 1] + (np.diff(cuts) - 1).astype(np.uint64)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(slots, starts): the hashed features of a text by the word in which they end; word i has slots[starts[i]:starts[i + 1]].

    Features are groups of letters (over word borders too), words, words without doubled letters, pairs, triples and
    pairs with a gap.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    letters = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    space = letters == 32
    of = np.minimum(np.maximum(np.cumsum(space) - 1 - space, 0), n - 1)
    with np.errstate(over="ignore"):
        slots, ends = [], []
        for g in GROUPS:
            m = len(letters) - g + 1
            if m > 0:
                h = np.zeros(m, np.uint64)
                for k in range(g):
                    h = h * _BASE + letters[k : m + k]
                slots.append(_slot(h, g))
                ends.append(of[g - 1 :])
        w, at = _word_hashes(letters), np.arange(n)
        slots.append(_slot(w, 11))
        ends.append(at)
        again = np.concatenate([[False], (letters[1:] == letters[:-1]) & ~space[1:]])
        slots.append(_slot(_word_hashes(letters[~again]), 15))
        ends.append(at)
        for kind, gap in ((12, 1), (13, 2)):
            if n > gap:
                slots.append(_slot(w[:-gap] * _BASE + w[gap:] * _MIX, kind))
                ends.append(at[gap:])
        if n > 2:
            slots.append(_slot((w[:-2] * _BASE + w[1:-1]) * _BASE + w[2:] * _MIX, 14))
            ends.append(at[2:])
    every, where = np.concatenate(slots), np.concatenate(ends)
    order = np.argsort(where, kind="stable")
    return every[order], np.concatenate([[0], np.cumsum(np.bincount(where, minlength=n))])


def word_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sum of the values of each word: those of word i are values[starts[i]:starts[i + 1]]."""
    return np.add.reduceat(np.append(values, 0.0), starts[:-1]) * (np.diff(starts) > 0)


def window_sums(words: np.ndarray) -> list[tuple[float, int, int]]:
    """(sum, first word, end) of the best window of each length of WINDOWS over the values of words."""
    total, out = np.concatenate([[0.0], np.cumsum(words)]), []
    for size in WINDOWS:
        size = min(size, len(words))
        sums = total[size:] - total[:-size]
        i = int(np.argmax(sums))
        out.append((float(sums[i]), i, i + size))
    return out


#: Features in rising order, their weights, and the bias.
Model = tuple[np.ndarray, np.ndarray, float]


def raw_score(model: Model, text: str | None) -> float:
    """The greatest window sum of a text plus the bias; minus infinity for a text without words."""
    keys, weights, bias = model
    slots, starts = features(words_of(text)) if text else (None, np.zeros(1))
    if len(starts) < 2:
        return float("-inf")
    if not len(keys):
        return bias
    at = np.minimum(np.searchsorted(keys, slots), len(keys) - 1)
    return max(s for s, _, _ in window_sums(word_sums(np.where(keys[at] == slots, weights[at], 0.0), starts))) + bias
