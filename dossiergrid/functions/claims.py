"""Which skills lines of text claim: as a name, worded alike, or by their stems.

Lines of a whole batch become arrays of word numbers. A window of words is compared
with a skill letter by letter only where its length and the letters it shares leave
the threshold possible; both bounds are sums over words, made for all windows at once.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np

from dossiergrid.functions import lexicon as lx
from dossiergrid.functions.similarity import all_stems_near, common_lengths, irregular_forms, kept_by_stem, stem, token_set_ratio, too_short

THRESHOLD = 85
#: Characters of text that are worked on at a time.
CHUNK = 1 << 21
#: A disclaimer reaches at most 60 characters; its own words are far shorter than this.
LOOK_BACK = 1000
_LETTERS = 64
_PART = re.compile(r"[a-z0-9]+")
_PART_CHARACTERS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_CUE = re.compile(f"{lx.NEGATION}|{lx.ASPIRATION}", re.I)
#: Every disclaimer begins with one of these.
_CUE_WORDS = frozenset(
    "no not without lack lacks lacking unfamiliar interested willing eager hoping seeking would currently planning hope aspire want wants wanting".split()
)
_CUE_WORD = re.compile(f"(?:{'|'.join(sorted(_CUE_WORDS))})(?![a-z0-9])")
#: A line with one of these as a whole word disclaims.
_NEGATIONS = ("no", "not", "without", "lack", "lacks", "lacking")
_DISCLAIMED = re.compile(lx.DISCLAIMED_BEFORE, re.I)


_HEADING = [re.compile(p, re.I) for p in (lx.SKILL_HEADING, lx.INCLUDED_HEADING, lx.EXCLUDED_HEADING)]
_ASPIRES = re.compile(lx.ASPIRATIONAL_HEADING, re.I)
_WORK = re.compile(lx.EXPERIENCE_HEADING, re.I)
_LEAVES = [re.compile(p, re.I) for p in (lx.SKILL_HEADING, lx.EXCLUDED_HEADING)]


def claimed_lines(text: str) -> list[str]:
    """Lines outside sections that only list what someone is learning; such a section ends at the next heading."""
    out, on = [], True
    for raw in text.splitlines():
        line = raw.strip()
        if not line:
            continue
        if _ASPIRES.match(line):
            on = False
        elif not on and len(line) <= 60 and not line.endswith((".", ",", ";")) and (line.isupper() or any(p.match(line) for p in _HEADING)):
            on = True
        if on:
            out.append(line)
    return out


def work_lines(text: str) -> list[str]:
    """Lines below headings of work experience; all lines where none stands below one."""
    return work_section(text) or [x.strip() for x in text.splitlines() if x.strip()]


def work_section(text: str) -> list[str]:
    """Lines below headings of work experience."""
    out, inside = [], False
    for line in (x.strip() for x in text.splitlines() if x.strip()):
        if _WORK.match(line):
            inside = True
        elif inside and any(p.match(line) for p in _LEAVES):
            inside = False
        elif inside:
            out.append(line)
    return out


@lru_cache(1 << 14)
def skill_names(skill: str) -> list[str]:
    """A skill and its aliases, lower-cased, the longest first."""
    plain = skill.strip().lower()
    return sorted({plain, *lx.SKILL_ALIASES.get(plain, [])}, key=lambda n: (-len(n), n))


@lru_cache(1 << 14)
def _mention(name: str) -> re.Pattern:
    """Names with symbols match anywhere, others as whole words."""
    if re.search(r"[^a-z0-9\s]", name):
        return re.compile(re.escape(name))
    return re.compile(r"\b" + r"\s+".join(re.escape(w) for w in name.split()) + r"\b")


def named(lines: list[str], whole: str, skill: str) -> bool:
    """Whether a (lower-cased) line names the skill with no disclaimer before the mention; ``whole`` is the lines' text."""
    for name in skill_names(skill):
        if not name or name.split()[0] not in whole:
            continue
        pattern = _mention(name)
        if not pattern.search(whole):  # a line's mention is one of the whole, too
            continue
        for line in lines:
            for m in pattern.finditer(line):
                if not _DISCLAIMED.search(line, max(0, m.start() - LOOK_BACK), m.start()):
                    return True
    return False


class _Batch:
    """Words of the lines without disclaimers of some texts."""

    def __init__(self, texts: dict[int, list[str]]):
        numbers: dict[str, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        own, counts, row_of_line = [], [], []
        self.lines: list[str] = []
        for row, lines in texts.items():
            for line in lines:
                words = line.split()
                own.extend(map(numbers.__getitem__, words))
                counts.append(len(words))
                row_of_line.append(row)
                self.lines.append(line)
        self.numbers, self.words = dict(numbers), list(numbers)
        self.text = "\n".join(self.words)
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.cumsum(self.length + 1) - self.length - 1
        own_words, line_of = np.array(own, np.int64), np.repeat(np.arange(len(counts)), counts)
        # Only lines with a word of a disclaimer are searched for one.
        denies = np.zeros(len(self.words), bool)
        denies[[self.numbers[w] for w in _NEGATIONS if w in self.numbers]] = True
        keep = np.ones(len(counts), bool)
        keep[line_of[denies[own_words]]] = False
        warns = np.zeros(len(counts), bool)
        warns[line_of[self._having(_CUE_WORD)[own_words]]] = True
        for i in np.flatnonzero(warns & keep).tolist():
            keep[i] = not _CUE.search(self.lines[i])
        open_words = keep[line_of]
        self.own, self.line_of = own_words[open_words], line_of[open_words]
        self.row_of = np.array(row_of_line, np.int64)[self.line_of]
        self.letters = np.frombuffer("".join(self.words).encode("utf-32-le", "surrogatepass"), np.uint32) % _LETTERS
        self.word_of_letter = np.repeat(np.arange(len(self.words)), self.length)
        self.counts: dict[int, np.ndarray] = {}

    def _having(self, pattern: re.Pattern, test: Callable[[str], bool] = bool) -> np.ndarray:
        """Which words have a part (small letters and digits in a row) that the pattern matches whole and that passes the test.

        The pattern must reach the end of a part.
        """
        text, found = self.text, []
        for m in pattern.finditer(text):
            at = m.start()
            if (not at or text[at - 1] not in _PART_CHARACTERS) and test(m.group()):
                found.append(at)
        flags = np.zeros(len(self.words), bool)
        flags[np.searchsorted(self.starts, np.array(found, np.int64), "right") - 1] = True
        return flags

    def _common(self, tokens: list[str]) -> np.ndarray:
        """At least as many letters as each word shares with the tokens."""
        letters, many = np.unique(np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), np.uint32) % _LETTERS, return_counts=True)
        common = np.zeros(len(self.words), np.int32)
        for letter, most in zip(letters.tolist(), many.tolist(), strict=True):
            if letter not in self.counts:
                self.counts[letter] = np.bincount(self.word_of_letter[self.letters == letter], minlength=len(self.words)).astype(np.int32)
            common += np.minimum(self.counts[letter], most)
        return common

    def _places(self, rows: list[int]) -> np.ndarray:
        """The places of the words of some texts; ``row_of`` is sorted."""
        begins, ends = np.searchsorted(self.row_of, rows, "left"), np.searchsorted(self.row_of, rows, "right")
        size = ends - begins
        return np.arange(size.sum()) + np.repeat(begins - (np.cumsum(size) - size), size)

    def worded_alike(self, skill: str, rows: list[int]) -> set[int]:
        """Of the texts ``rows``, those with a run of as many words as the skill has, or one or two more, that is worded like it."""
        skill = skill.strip().lower()
        if too_short(skill):
            return set()
        tokens = skill.split()
        distinct = sorted(set(tokens))
        la = len(" ".join(distinct))
        common = self._common(distinct)
        # A window that shares no word with the skill passes the bound below only if these values of its words,
        # none of them negative, reach ``least`` together; a shared word reaches it alone.
        least = THRESHOLD * la + 200 - THRESHOLD
        value = np.clip(200 * common - THRESHOLD * self.length + 200 - THRESHOLD, 0, least)
        value[[self.numbers[t] for t in distinct if t in self.numbers]] = least
        places = self._places(rows)
        words, longest = self.own[places], len(tokens) + 2
        total = np.zeros(len(words) + longest + 1, np.int64)
        np.cumsum(value[words], out=total[1 : len(words) + 1])
        total[len(words) + 1 :] = total[len(words)]
        begins = np.flatnonzero(total[longest:-1] - total[: len(words)] >= least)
        found: set[int] = set()
        for size in range(len(tokens), longest + 1):
            at = begins[(begins + size <= len(words)) & (total[begins + size] - total[begins] >= least)]
            at = at[self.line_of[places[at]] == self.line_of[places[at + size - 1]]]
            of_row = self.row_of[places[at]]
            if found:
                new = ~np.isin(of_row, list(found))
                at, of_row = at[new], of_row[new]
            w = [words[at + j] for j in range(size)]
            new = [np.ones(len(at), bool)]
            for j in range(1, size):
                new.append(~np.logical_or.reduce([w[j] == w[k] for k in range(j)]))
            kinds = sum(x.astype(np.int64) for x in new)
            lb = sum(self.length[w[j]] * new[j] for j in range(size)) + kinds - 1
            possible = sum(common[w[j]] * new[j] for j in range(size)) + np.minimum(kinds, len(distinct)) - 1
            shared, both = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            for token in distinct:
                k = self.numbers.get(token)
                if k is not None:
                    holds = np.logical_or.reduce([x == k for x in w])
                    shared, both = shared + holds, both + holds * len(token)
            both = both + np.maximum(shared - 1, 0)
            some = shared > 0
            sure = some & ((shared == len(distinct)) | (shared == kinds))
            sure |= some & ((200.0 * both / (both + la) >= THRESHOLD) | (200.0 * both / (both + lb) >= THRESHOLD))
            found |= set(of_row[sure].tolist())
            maybe = np.flatnonzero(~sure & (200.0 * np.minimum(np.minimum(possible, la), lb) / (la + lb) >= THRESHOLD))
            alone, beside = maybe[~some[maybe]], maybe[some[maybe]]
            texts = [" ".join(sorted({self.words[x] for x in window})) for window in zip(*[x[alone].tolist() for x in w], strict=True)]
            kept = common_lengths(" ".join(distinct), texts)
            found |= set(of_row[alone[200.0 * kept / (la + lb[alone]) >= THRESHOLD]].tolist())
            tried: dict[tuple, bool] = {}
            for row, *window in zip(of_row[beside].tolist(), *[x[beside].tolist() for x in w], strict=True):
                if row in found:
                    continue
                window = tuple(window)
                if window not in tried:
                    tried[window] = token_set_ratio(skill, " ".join(self.words[x] for x in window)) >= THRESHOLD
                if tried[window]:
                    found.add(row)
        return found

    def _with_stem(self, root: str) -> np.ndarray | None:
        """Which words have a part with this stem, None if none has; only parts that begin like it are stemmed."""
        begins = [x for x in (kept_by_stem(root), *irregular_forms(root)) if x in self.text]
        flags = self._having(re.compile(f"(?:{'|'.join(begins)})[a-z0-9]*"), lambda part: stem(part) == root) if begins else None
        return flags if begins and flags.any() else None

    def stemmed(self, skill: str, rows: list[int]) -> set[int]:
        """Of the texts ``rows``, those with a line that has the stems of all words of the skill close together."""
        skill = skill.strip().lower()
        if too_short(skill):
            return set()
        wanted = {stem(w) for w in _PART.findall(skill)}
        having = []
        for root in wanted:
            having.append(self._with_stem(root))
            if having[-1] is None:
                return set()
        if not having:
            return set()
        places = self._places(rows)
        words, lines, hold = self.own[places], self.line_of[places], None
        for flags in having:
            here = np.unique(lines[flags[words]])
            hold = here if hold is None else np.intersect1d(hold, here, assume_unique=True)
        row_of_line = self.row_of[np.searchsorted(self.line_of, hold)]
        found: set[int] = set()
        for line, row in zip(hold.tolist(), row_of_line.tolist(), strict=True):
            if row not in found and all_stems_near(self.lines[line], skill):
                found.add(row)
        return found


class _Chunk:
    """Some texts, lower-cased, whose words are numbered at the first comparison that needs them."""

    def __init__(self, texts: list[list[str]]):
        self.low = [[x.lower() for x in lines] for lines in texts]
        self.whole = ["\n".join(lines) for lines in self.low]
        self.batch: _Batch | None = None

    def claimed(self, wanted: list[list[str]]) -> list[set[str]]:
        found: list[set[str]] = [set() for _ in wanted]
        left: dict[str, list[int]] = defaultdict(list)
        for k, skills in enumerate(wanted):
            for skill in dict.fromkeys(skills):
                if named(self.low[k], self.whole[k], skill):
                    found[k].add(skill)
                elif not too_short(skill.strip().lower()):
                    left[skill].append(k)
        if left and self.batch is None:
            self.batch = _Batch(dict(enumerate(self.low)))
        for skill, rows in left.items():
            alike = self.batch.worded_alike(skill, rows)
            for k in alike | self.batch.stemmed(skill, [r for r in rows if r not in alike]):
                found[k].add(skill)
        return found


def _chunks(texts: list[list[str]]) -> Iterator[tuple[int, int]]:
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size < CHUNK):
            size += sum(map(len, texts[end]))
            end += 1
        yield begin, end
        begin = end


def claimed(texts: list[list[str]], wanted: list[list[str]]) -> list[set[str]]:
    """For each text (its lines), which of its wanted skills it claims."""
    return [x for a, b in _chunks(texts) for x in _Chunk(texts[a:b]).claimed(wanted[a:b])]


def with_implied(texts: list[list[str]], wanted: list[list[str]]) -> tuple[list[set[str]], list[dict[str, str]]]:
    """What each text claims, and of what is missing the skills that an entailing one gives, with the first such."""
    have, by = [], []
    for a, b in _chunks(texts):
        chunk = _Chunk(texts[a:b])
        here = chunk.claimed(wanted[a:b])
        by += _implied(chunk, wanted[a:b], here)
        have += here
    return have, by


def _implied(chunk: _Chunk, wanted: list[list[str]], have: list[set[str]]) -> list[dict[str, str]]:
    entailing = lambda s: lx.SKILL_IMPLICATIONS.get(s.strip().lower(), [])
    missing = [[s for s in skills if s not in h] for skills, h in zip(wanted, have, strict=True)]
    by = []
    for known, lacks in zip(chunk.claimed([[i for s in lacks for i in entailing(s)] for lacks in missing]), missing, strict=True):
        firsts = {s: next((i for i in entailing(s) if i in known), None) for s in lacks}
        by.append({s: i for s, i in firsts.items() if i})
    return by


def screened(texts: list[str], needed: list[list[str]], preferred: list[list[str]], titles: list[str]) -> tuple[list[set[str]], list[dict[str, str]], list[set[str]], list[bool]]:
    """For each text ``with_implied`` of what is needed, ``claimed`` of what is preferred, and ``related_work`` of both and the title.

    Words are numbered once for all of them. A text without a work section of its own is related by what it claims.
    """
    lines = [claimed_lines(t) for t in texts]
    every = [[*a, *b] for a, b in zip(needed, preferred, strict=True)]
    have, by, liked = [], [], []
    for a, b in _chunks(lines):
        chunk = _Chunk(lines[a:b])
        here = chunk.claimed(every[a:b])
        have += [h & set(skills) for h, skills in zip(here, needed[a:b], strict=True)]
        liked += [h & set(skills) for h, skills in zip(here, preferred[a:b], strict=True)]
        by += _implied(chunk, needed[a:b], here)
    related, apart = [], {}
    for k, (text, title) in enumerate(zip(texts, titles, strict=True)):
        own = lines[k]
        work = work_section(text)
        if work:
            own = claimed_lines("\n".join(work))
        related.append(_has_word(own, title) or (not work and bool(have[k] or liked[k])))
        if work and not related[k]:
            apart[k] = own
    for k, found in zip(apart, claimed(list(apart.values()), [every[k] for k in apart]), strict=True):
        related[k] = bool(found)
    return have, by, liked, related


def words_of(text: str) -> set[str]:
    """Words of four letters and more."""
    return set(re.findall(r"[a-z]{4,}", text.lower()))


def _has_word(lines: list[str], title: str) -> bool:
    """Whether lines hold a word of a title as a whole word."""
    low = "\n".join(lines).lower()
    wanted = {w for w in words_of(title) - set(lx.TITLE_NOISE) if w in low}
    return bool(wanted and wanted & words_of(low))


def related_work(texts: list[str], skills: list[list[str]], titles: list[str]) -> list[bool]:
    """Whether the work section of each text claims a skill or holds a word of the job's title."""
    lines = [claimed_lines("\n".join(work_lines(t))) for t in texts]
    out = [_has_word(own, title) for own, title in zip(lines, titles, strict=True)]
    left = [k for k, known in enumerate(out) if not known]
    for k, have in zip(left, claimed([lines[k] for k in left], [skills[k] for k in left]), strict=True):
        out[k] = bool(have)
    return out
