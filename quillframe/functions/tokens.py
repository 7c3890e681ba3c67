"""Numbers of tokens, and texts cut to a number of tokens, by the ranks of a byte-pair vocabulary.

The vocabulary is a file of lines "base64 rank", given by its path, which executors must have. A text is
split into words by the published pattern of such vocabularies; a word is merged once and held, up to HELD
words, so a batch of texts costs about its different words. Without a vocabulary counts are estimates by
the length of the text.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from importlib.util import find_spec

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from quillframe.functions.numeric import tokens_estimate

#: The pattern that splits texts into words: a fixed value.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
HELD = 200_000


class Vocabulary:
    def __init__(self, path: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        # White space as the pattern means it, without the separators U+001C to U+001F.
        space = r"\p{White_Space}"
        self.split = regex.compile(WORDS.replace(r"[^\s", f"[^{space}").replace(r"\s", space).replace(r"\S", r"\P{White_Space}"))
        self.held: dict[str, list[bytes]] = {}

    def merged(self, word: str) -> list[bytes]:
        """The tokens of a word: the pair of the lowest rank is merged until no pair has one."""
        got = self.held.get(word)
        if got is None:
            raw = word.encode()
            got = [raw] if raw in self.ranks else self._merge(raw)
            if len(self.held) >= HELD:
                self.held.clear()
            self.held[word] = got
        return got

    def _merge(self, raw: bytes) -> list[bytes]:
        """By a heap of pairs, so long words cost n log n: of equal ranks the leftmost pair comes first."""
        from heapq import heapify, heappop, heappush

        parts: list[bytes | None] = [raw[i : i + 1] for i in range(len(raw))]
        after, before = list(range(1, len(raw) + 1)), list(range(-1, len(raw) - 1))
        heap = [(r, i) for i in range(len(raw) - 1) if (r := self.ranks.get(raw[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            if parts[i] is None or j >= len(parts) or self.ranks.get(parts[i] + parts[j]) != rank:
                continue  # one side has been merged since
            parts[i], parts[j], after[i] = parts[i] + parts[j], None, after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < len(parts) and (r := self.ranks.get(parts[a] + parts[after[a]])) is not None:
                    heappush(heap, (r, a))
        return [p for p in parts if p is not None]

    def count(self, text: str) -> int:
        return sum(len(self.merged(w)) for w in self.split.findall(text))

    def cut(self, text: str, most: int) -> str:
        """text, or what its first tokens stand for where it has more, with the bracket closed that opens it."""
        parts: list[bytes] = []
        for m in self.split.finditer(text):
            parts += self.merged(m[0])
            if len(parts) > most:
                break
        else:
            return text
        short = b"".join(parts[:most]).decode("utf-8", errors="replace")
        for begin, end in ("[]", "{}"):
            if short.startswith(begin) and not short.endswith(end):
                short += end
        return short


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def installed(name: str) -> str | None:
    """The path of a vocabulary of the package public_tokenizers, where that is installed."""
    if find_spec("public_tokenizers") is None:
        return None
    import public_tokenizers

    return public_tokenizers.path(name)


def token_count(text: Column, path: str | None = None) -> Column:
    """The number of a text's tokens; an estimate without a vocabulary. Null stays null."""
    if path is None:
        return tokens_estimate(text).cast("long")

    @F.pandas_udf(LongType())
    def count(x: pd.Series) -> pd.Series:
        own = vocabulary(path)
        return x.map(own.count, na_action="ignore").astype("Int64")

    return count(text)


def cut_to_tokens(text: Column, most: int, path: str) -> Column:
    """A text of at most so many tokens, see Vocabulary.cut()."""

    @F.pandas_udf(StringType())
    def cut(x: pd.Series) -> pd.Series:
        own = vocabulary(path)
        return x.map(lambda t: own.cut(t, most), na_action="ignore")

    return cut(text)
