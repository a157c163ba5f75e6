"""Similarity of short texts, for what exact matching leaves."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

#: Texts that are compared with one at a time.
_AT_A_TIME = 1 << 14


def common_length(a: str, b: str) -> int:
    """The length of a longest common subsequence, bit-parallel."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    open_bits = full
    for c in b:
        hit = open_bits & places.get(c, 0)
        open_bits = ((open_bits + hit) | (open_bits - hit)) & full
    return len(a) - open_bits.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """100 times the share of characters of both texts that a longest common subsequence keeps."""
    if not a and not b:
        return 100.0
    return 200.0 * common_length(a, b) / (len(a) + len(b))


def common_lengths(a: str, others: list[str]) -> np.ndarray:
    """``common_length`` of one text and each of the others, by the same steps for all of them at once."""
    if len(a) > 63 or "\0" in a:  # one text's bits must fit in a number, and shorter ones of the others are filled up with \0
        known = {b: common_length(a, b) for b in set(others)}
        return np.array([known[b] for b in others], np.int64)
    full, out = np.uint64((1 << len(a)) - 1), [np.zeros(0, np.int64)]
    for k in range(0, len(others), _AT_A_TIME):
        some = others[k : k + _AT_A_TIME]
        letters = np.array(some, f"U{max(1, *map(len, some))}").view(np.uint32).reshape(len(some), -1).T
        places = np.zeros(letters.shape, np.uint64)
        for c in set(a):
            places[letters == ord(c)] = sum(1 << i for i, x in enumerate(a) if x == c)
        open_bits = np.full(len(some), full)
        for column in places:
            hit = open_bits & column
            open_bits = ((open_bits + hit) | (open_bits - hit)) & full
        out.append(len(a) - np.bitwise_count(open_bits).astype(np.int64))
    return np.concatenate(out)


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the common words, and the common words with each side's rest."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    both, only_a, only_b = (" ".join(sorted(s)) for s in (left & right, left - right, right - left))
    if both and (not only_a or not only_b):
        return 100.0
    whole_a, whole_b = f"{both} {only_a}".strip(), f"{both} {only_b}".strip()
    best = indel_ratio(whole_a, whole_b)
    return max(best, indel_ratio(both, whole_a), indel_ratio(both, whole_b)) if both else best


def too_short(skill: str) -> bool:
    return not skill or (len(skill.split()) < 2 and len(skill) < 4)


def phrase_like(line: str, skill: str, threshold: float = 85) -> bool:
    """Whether a run of as many words as the skill has, or one or two more, is worded like it."""
    skill = skill.strip().lower()
    if too_short(skill):
        return False
    tokens, n = line.split(), len(skill.split())
    return any(token_set_ratio(skill, " ".join(tokens[i : i + size])) >= threshold for size in range(n, n + 3) for i in range(len(tokens) - size + 1))


def all_stems_near(line: str, skill: str, slack: int = 3) -> bool:
    """Whether the stems of all words of the skill occur together within a few words."""
    skill = skill.strip().lower()
    if too_short(skill):
        return False
    want = set(map(stem, re.findall(r"[a-z0-9]+", skill)))
    have = list(map(stem, re.findall(r"[a-z0-9]+", line.lower())))
    if not want or not have:
        return False
    size = len(want) + slack
    return any(want <= set(have[i : i + size]) for i in range(max(1, len(have) - size + 1)))


_VOWELS = "aeiou"


def _consonant(word: str, i: int) -> bool:
    if word[i] == "y":
        return i == 0 or not _consonant(word, i - 1)
    return word[i] not in _VOWELS


def _measure(word: str) -> int:
    """How often a vowel is followed by a consonant."""
    kinds = [_consonant(word, i) for i in range(len(word))]
    return sum(not a and b for a, b in zip(kinds, kinds[1:], strict=False))


def _has_vowel(word: str) -> bool:
    return any(not _consonant(word, i) for i in range(len(word)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _consonant(word, len(word) - 1)


def _short_end(word: str) -> bool:
    n = len(word)
    if n == 2:
        return not _consonant(word, 0) and _consonant(word, 1)
    return n > 2 and _consonant(word, n - 3) and not _consonant(word, n - 2) and _consonant(word, n - 1) and word[-1] not in "wxy"


# The suffixes of the published stemming algorithm (M. F. Porter, 1980), with the "logi" and "bli" additions.
_STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ("fulli", "ful"), ("logi", "log"),
]
_STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP_4 = [
    "ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ion", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou",
]
_IRREGULAR = {
    "sky": ["sky", "skies"], "die": ["dying"], "lie": ["lying"], "tie": ["tying"], "news": ["news"], "inning": ["innings", "inning"],
    "outing": ["outings", "outing"], "canning": ["cannings", "canning"], "howe": ["howe"], "proceed": ["proceed"],
    "exceed": ["exceed"], "succeed": ["succeed"],
}
_KNOWN = {form: base for base, forms in _IRREGULAR.items() for form in forms}


def irregular_forms(root: str) -> list[str]:
    """Words whose stem is looked up, not made by the rules."""
    return _IRREGULAR.get(root, [])


def kept_by_stem(root: str) -> str:
    """What every word but an irregular form of this stem begins with.

    The rules cut ends off, and put at most "e" or "i" in place of what they cut, or "ble" of "bili", whose "e" may go again.
    """
    return root[: -2 if root.endswith("ble") else -1] if len(root) > 2 and root.endswith(("e", "i", "bl")) else root


def _replace(word: str, rules: list[tuple[str, str]]) -> str:
    for suffix, by in rules:
        if word.endswith(suffix):
            base = word[: len(word) - len(suffix)]
            return base + by if _measure(base) > 0 else word
    return word


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-cased word."""
    if word in _KNOWN:
        return _KNOWN[word]
    if len(word) <= 2:
        return word
    # Plurals.
    if word.endswith("ies") and len(word) == 4:
        word = word[:-1]
    elif word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # Past and progressive forms.
    if word.endswith("ied"):
        word = word[:-1] if len(word) == 4 else word[:-2]
    elif word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            base = word[: -len(suffix)]
            if word.endswith(suffix) and _has_vowel(base):
                if base.endswith(("at", "bl", "iz")):
                    word = base + "e"
                elif _double(base) and base[-1] not in "lsz":
                    word = base[:-1]
                elif _measure(base) == 1 and _short_end(base):
                    word = base + "e"
                else:
                    word = base
                break
    if word.endswith("y") and len(word) > 2 and _consonant(word, len(word) - 2):
        word = word[:-1] + "i"
    # "alli" is worked on again once it is "al".
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        word = _replace(word[:-2], _STEP_2)
    else:
        word = _replace(word, _STEP_2)
    word = _replace(word, _STEP_3)
    for suffix in _STEP_4:
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base[-1:] in ("s", "t")):
                word = base
            break
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _short_end(base)):
            word = base
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word
