"""Language identification by cross-parsing entropy.

For each language a bounded, documented sample of labelled text is held in a
suffix automaton (lines that read as another language are left out of it).  A text is parsed against it from left to right: a phrase is
the longest piece that occurs in the sample (at least one letter).  Phrases
times log2(sample length), over the text's length, estimates the cross entropy
in bits a letter; the language with the least wins.  The parse restarts at each
word, which stands between spaces, so a word's phrase counts are worked out once
and remembered by the worker; a text's count is the sum over all its words.

Defined cases: null texts and texts without a letter get ``und`` and score 0;
equal languages go to the first in name order; with no labelled text at all every
text is ``und``; repeated rows are treated alike.  Whole texts are parsed.
"""

from __future__ import annotations

import functools
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import letters_present

UNDEFINED = "und"
#: Rows a language is learned from, letters kept of them, letters of all languages, languages.
TRAIN_ROWS, TRAIN_CHARS, TRAIN_CHARS_ALL, LANGUAGES = 80, 45_000, 360_000, 256
#: Words a worker remembers; the table starts anew beyond it.
CACHE_WORDS = 250_000
_WORD = re.compile(r"[^\W\d_]+")
_FIELD = 40  # bits of one language's count in a packed sum


def normal_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class SuffixAutomaton:
    """All substrings of one text; ``next[state]`` maps a character to a state."""

    def __init__(self, text: str):
        following: list[dict[str, int]] = [{}]
        link, length = [-1], [0]
        last = 0
        for c in text:
            new = len(following)
            following.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in following[p]:
                following[p][c] = new
                p = link[p]
            if p >= 0:
                q = following[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    copy = len(following)
                    following.append(dict(following[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and following[p].get(c) == q:
                        following[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        self.next = following

    def phrases(self, text: str) -> int:
        """Longest-match pieces that make up ``text``."""
        following, count, state = self.next, 0, 0
        root = following[0]
        for c in text:
            to = following[state].get(c)
            if to is None:  # the phrase ends before c, which starts the next one
                if state:
                    count += 1
                to = root.get(c, 0)
                if not to:
                    count += 1  # an unknown character is a phrase
            state = to
        return count + (state > 0)


class CrossParser(dict):
    """Packed phrase counts of words, under every language."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        super().__init__()
        self.languages = [name for name, _ in samples]
        self.automata = [SuffixAutomaton(f" {text} ") for _, text in samples]
        self.weights = [math.log2(len(text) + 2) for _, text in samples]

    def __missing__(self, word: str) -> int:
        packed = 0
        spaced = f" {word} "
        for k, automaton in enumerate(self.automata):
            packed |= automaton.phrases(spaced) << (_FIELD * k)
        if len(word) <= 40:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = packed
        return packed

    def predict(self, text: str | None) -> tuple[str, float]:
        words = normal_words(text) if text else []
        if not words or not self.languages:
            return UNDEFINED, 0.0
        packed = sum(map(self.__getitem__, words))
        bits = [((packed >> (_FIELD * k)) & ((1 << _FIELD) - 1)) * w for k, w in enumerate(self.weights)]
        best = min(range(len(bits)), key=bits.__getitem__)
        rest = min((b for k, b in enumerate(bits) if k != best), default=None)
        return self.languages[best], 1.0 if rest is None else rest / (bits[best] + rest)


@functools.lru_cache(maxsize=2)
def _parser(samples: tuple[tuple[str, str], ...]) -> CrossParser:
    return CrossParser(samples)


def held_out(id_col: Column) -> Column:
    """True for the fifth of the documents that nothing is learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[tuple[str, str], ...]:
    """(language, sample) pairs from at most ``TRAIN_ROWS`` labelled rows a language, the same rows each time.

    Only the counts of labels pass over all rows; a hash keeps about four times
    the rows wanted before the ranking, so no task holds all rows of a language.
    """
    named = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"))
    allowed = named.where(F.col("l").isNotNull() & (F.crc32(F.col("i").cast("string").cast("binary")) % 5 != 0))
    counts = allowed.groupBy("l").count().orderBy(F.desc("count"), "l").limit(LANGUAGES).collect()
    if not counts:
        return ()
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["l"], max(1, r["count"] // (4 * TRAIN_ROWS)))])
    picked = allowed.withColumn("s", share[F.col("l")]).where(F.pmod(F.xxhash64("i"), F.col("s")) == 0)
    best = Window.partitionBy("l").orderBy(F.xxhash64("i", F.lit(1)), "t")
    rows = picked.select("l", "i", F.substring("t", 1, TRAIN_CHARS).alias("t")).withColumn("k", F.row_number().over(best)).where(F.col("k") <= TRAIN_ROWS).collect()
    lines: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r["l"], r["k"])):
        lines.setdefault(row["l"], []).extend(filter(None, (" ".join(normal_words(x)) for x in (row["t"] or "").split("\n"))))
    return _samples(_own_lines(lines))


def _samples(lines: dict[str, list[str]]) -> tuple[tuple[str, str], ...]:
    """The first lines of each language, in whole, as far as the letters go."""
    room = min(TRAIN_CHARS, TRAIN_CHARS_ALL // max(1, len(lines)))
    made = {}
    for name, own in lines.items():
        fitting, left = [], room
        for line in own:
            if len(line) < left:
                fitting.append(line)
                left -= len(line) + 1
        made[name] = " ".join(fitting)
    return tuple(sorted((name, text) for name, text in made.items() if text))


def _own_lines(lines: dict[str, list[str]]) -> dict[str, list[str]]:
    """The lines that a parser learned from the other half gives to their own language.

    Labelled documents quote other languages; such lines would let every
    language parse them well.  A language that would lose all lines keeps them.
    """
    kept: dict[str, list[str]] = {name: [] for name in lines}
    for half in (0, 1):
        parser = CrossParser(_samples({name: own[half::2] for name, own in lines.items()}))
        for name, own in lines.items():
            kept[name] += [line for line in own[1 - half::2] if parser.predict(line)[0] == name]
    return {name: kept[name] or own for name, own in lines.items()}


def predicted(text: Column, samples: tuple[tuple[str, str], ...]) -> Column:
    """Struct (lang, score) of each whole text."""

    @F.pandas_udf("lang string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        predict = _parser(samples).predict
        return pd.DataFrame([predict(t) for t in texts], columns=["lang", "score"])

    return run(F.when(letters_present(text), text))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per document: held_out, lang_pred and score."""
    samples = learn(docs, id_col, text_col, lang_col)
    found = docs.select(F.col(id_col), predicted(F.col(text_col), samples).alias("p"))
    return found.select(id_col, held_out(F.col(id_col)).alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents with a recognised language, or with a letter where no language could be learnt; their columns unchanged."""
    samples = learn(docs, id_col, text_col, lang_col)
    if not samples:
        return docs.where(letters_present(F.col(text_col)))
    return docs.withColumn("__p", predicted(F.col(text_col), samples)).where(F.col("__p.lang") != UNDEFINED).select(*docs.columns)
