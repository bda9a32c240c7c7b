"""Case folding and word search as Spark expressions; no Python runs on the executors."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TERM = 64
#: Characters whose full folding is longer and whose simple folding is one character.
SIMPLE_FOLDS = {"ΐ": "ΐ", "ΰ": "ΰ", "ﬅ": "ﬆ"}
#: Scripts that are searched by pairs of characters, with the two prolonged sound marks.
PAIRED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\x{30FC}\x{FF70}"
WORD = rf"([\p{{IsAlphabetic}}\p{{Nd}}\p{{M}}&&[^{PAIRED}]]+)"
RUN = rf"([{PAIRED}]+)"


@cache
def fold_table() -> tuple[str, str]:
    """Characters and what they fold to, one to one: simple case folding."""
    pairs = []
    for code in range(0x110000):
        if 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        low = c.casefold()
        if len(low) != 1:
            low = c.lower()
        low = SIMPLE_FOLDS.get(c, low)
        if len(low) == 1 and low != c and unicodedata.category(c) != "Cn":
            pairs.append((c, low))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


@cache
def _folding() -> dict[int, str]:
    return str.maketrans(*fold_table())


def folded(text: str) -> str:
    return text.translate(_folding())


def fold(c: Column) -> Column:
    # A text of ASCII alone is folded by lowering it, which is far cheaper.
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, *fold_table()))


def _once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def terms(c: Column) -> Column:
    """All terms of a text: folded words, and the pairs of runs without spaces with each run's last character."""

    def of_folded(low: Column) -> Column:
        words = F.transform(F.regexp_extract_all(low, F.lit(WORD), F.lit(1)), lambda w: F.substring(w, 1, MAX_TERM))
        pairs = F.transform(F.regexp_extract_all(low, F.lit(RUN), F.lit(1)), lambda r: F.transform(F.sequence(F.lit(1), F.char_length(r)), lambda k: F.substr(r, k, F.lit(2))))
        return F.concat(words, F.flatten(pairs))

    return _once(fold(c), of_folded)


def _pattern(word: str, whole: bool) -> str:
    """A word in a folded text: behind it and, if whole, after it stands no other letter of a word."""
    letters = WORD[1:-2]
    behind = rf"(?<!{letters}\Q{word}\E)"
    return rf"\Q{word}\E{behind}" + (rf"(?!{letters})" if whole else "")


@dataclass(frozen=True)
class Words:
    """What a search asks for."""

    exact: frozenset[str]
    prefixes: frozenset[str]

    @classmethod
    def of(cls, search: str) -> Words:
        import regex

        paired = r"\p{Han}\p{Hiragana}\p{Katakana}ーｰ"
        exact, prefixes = set(), set()
        for m in regex.finditer(rf"(?V1)(?P<run>[{paired}]+)|(?P<word>[[\p{{Alphabetic}}\p{{Nd}}\p{{M}}]--[{paired}]]+)(?P<star>\*?)", folded(search)):
            if run := m["run"]:
                prefixes |= {run} if len(run) == 1 else set()
                exact |= {run[k : k + 2] for k in range(len(run) - 1)}
            else:
                (prefixes if m["star"] else exact).add(m["word"][:MAX_TERM])
        return cls(frozenset(exact), frozenset(prefixes))

    def found_in(self, c: Column) -> Column:
        """Whether a text has every word; null for a null text.

        The text is folded once. Words are looked for as strings first, then with what stands around them; pairs of
        characters without spaces are terms wherever they stand together.
        """
        if not self.exact and not self.prefixes:
            return F.lit(False)

        def all_in(low: Column) -> Column:
            wanted = sorted(self.exact | self.prefixes)
            out = low.contains(wanted[0])
            for w in wanted[1:]:
                out = out & low.contains(w)
            for w in sorted(self.exact):
                if not _paired(w):
                    out = out & low.rlike(_pattern(w, len(w) < MAX_TERM))
            for w in sorted(self.prefixes):
                if not _paired(w):
                    out = out & low.rlike(_pattern(w, False))
            return out

        return F.exists(F.array(fold(c)), all_in)


def _paired(word: str) -> bool:
    import regex

    return bool(regex.match(r"[\p{Han}\p{Hiragana}\p{Katakana}ーｰ]", word))
