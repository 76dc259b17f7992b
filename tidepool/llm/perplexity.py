"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

For each language the model is trained on the characters of the words (pieces
between white space, lower case) of trusted documents.  A word is read with a
start and an end mark; n-grams reach back to the start at most, ``ORDER``
characters.  All counts come from Spark: words by language, from them the n-grams
of the highest order, from those the continuation counts of each lower order (how
many different characters stand before an n-gram; n-grams at the word start keep
their own counts).  Three discounts for each order and language follow from the
counts of counts, and joins of the count tables with the order below give the
interpolated probabilities and back-off weights, one row an n-gram.

A document's perplexity is taken over all characters and word ends of its whole
text.  The threshold of a language is a quantile of the perplexities of its
trusted documents; documents above it are not kept.

Insults in clean prose hardly move that mean, so toxicity has a score of its own.
A term is a word without punctuation.  Its weight is the lower bound (``SURE``
standard errors) of the logarithm of how much more often documents labelled toxic
hold it than trusted ones of the same languages do; only weights above 0 count.  A
document's toxicity is the largest sum of weights in ``SPAN`` consecutive terms.
One in ``HELD_OUT`` trusted documents is held out of the counts, and the limit of a
language is the same quantile of their toxicities (of all held-out ones where the
language has none); documents above it are not kept.

The workers score the words of the texts they are given; texts and words are never dealt
between tasks.  The model's table lies in the shared folder (the driver never holds it),
in shards of about ``MODEL_ROWS`` rows: a shard has all rows that a symbol's probability
can need, told by the symbol before it.  A worker keeps shards as sorted arrays as far as
``MODEL_ROWS`` times ``ROW_BYTES`` go, and remembers the scores of words.  Further shards
are read again for each block of texts, one at a time, and a word's score is the sum of
its shards' parts.  All ways give the same numbers.  The terms with a weight are held up to
``TERMS``; of more, each block of texts looks up its own.  Identifiers of judged
documents are broadcast ``TRUSTED_IDS`` at a time.

Defined cases: null, empty and wordless texts have perplexity null and are kept
false; a null language is a language of its own; a language without trusted text
has no model, its documents have perplexity null and are kept; repeated rows are
scored one by one; without labels nothing is trusted and all worded texts stay;
without toxic labels, or with no trusted document held out, toxicity rejects nothing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import open_store, scratch_path, staged

ORDER = 5
START, END = "\x02", "\x03"
#: Quantile of the trusted documents' perplexities that a document may reach.
QUANTILE = 0.99
#: Identifiers of judged documents that are broadcast at once, and model rows of a shard, at most
#: (more only where the grams of one symbol are more).
TRUSTED_IDS, MODEL_ROWS = 1_000_000, 2_000_000
#: A worker's memory for the model, in bytes for each of ``MODEL_ROWS``.  A row takes 16 of them.
ROW_BYTES = 100
#: Symbols scored at once, and characters of text for which shards are read again.
SYMBOLS, BLOCK = 1 << 17, 32 << 20
#: Words a worker remembers for each language; the table starts anew beyond it.
CACHE_WORDS = 400_000
#: Terms whose weights are summed, standard errors taken off a weight, one in so many trusted documents held out.
SPAN, SURE, HELD_OUT = 16, 2.33, 5
#: Terms with a weight that a worker holds, at most.
TERMS = 1_000_000
NO_LANGUAGE = "und"
#: What lies between terms: controls, spaces and punctuation, said so that Java and Python agree.
_BETWEEN = "[\\x00-/:-@\\[-`{-\\xA9\\xAB-\\xB4\\xB6-\\xB9\\xBB-\\xBF\\u2000-\\u206F\\u3000-\\u303F]+"
_BETWEEN_ALL = re.compile(_BETWEEN)
#: The ASCII part of it as a table of bytes.
_SPACED = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def _words(text):
    return F.filter(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def words_of(text: str) -> list[str]:
    """As ``_words``: white space is ASCII white space."""
    return [w.decode() for w in text.lower().encode().split()]


def _terms(text):
    return F.filter(F.split(F.lower(text), _BETWEEN), lambda w: w != "")


def terms_of(text: str) -> list[bytes]:
    """As ``_terms``, in UTF-8."""
    low = text.lower()
    return (low if low.isascii() else _BETWEEN_ALL.sub(" ", low)).encode().translate(_SPACED).split()


def worst_span(weights: dict[bytes, float], text: str) -> float:
    """The largest sum of weights in ``SPAN`` consecutive terms."""
    found = [(i, weights[w]) for i, w in enumerate(terms_of(text)) if w in weights]
    first, worst = 0, 0.0
    for k, (i, _) in enumerate(found):
        while found[first][0] <= i - SPAN:
            first += 1
        worst = max(worst, math.fsum(v for _, v in found[first:k + 1]))
    return round(worst, 9)


def judged_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Identifiers that are labelled good and not toxic (trusted), or toxic, by all their labels."""
    seen = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__judged")).agg(
        F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return seen.select("__judged", F.coalesce((F.col("q") == 1) & (F.col("t") == 0), F.lit(False)).alias("trusted"),
                       (F.col("t") == 1).alias("toxic")).where("trusted or toxic")


def _judged(docs: DataFrame, ids: DataFrame, n: int) -> list[DataFrame]:
    """The judged documents of ``docs`` (id, lang, text) with the flags ``trusted`` and ``toxic``.

    One frame for each ``TRUSTED_IDS`` of the ``n`` identifiers, to be worked on one after another: a
    frame broadcasts its own identifiers, so that no text is dealt, however many they are.
    """
    k = max(1, -(-n // TRUSTED_IDS))
    share = [ids.where(F.pmod(F.xxhash64("__judged"), F.lit(k)) == j) for j in range(k)] if k > 1 else [ids]
    return [docs.join(F.broadcast(own), F.col("id") == F.col("__judged")).drop("__judged") for own in share]


def _summed(parts: list[DataFrame], keys: list[str], make: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """``make`` of all parts, counts by ``keys``, added up; several are staged one after another."""
    made = [staged(make(part), name) for part in parts] if len(parts) > 1 else [make(parts[0])]
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in out.columns if c not in keys]) if made[1:] else out


def _held_out():
    return F.col("trusted") & (F.pmod(F.xxhash64("id"), F.lit(HELD_OUT)) == 0)


def toxic_terms(parts: list[DataFrame]) -> DataFrame:
    """(term, weight) of the terms that toxic documents surely hold more often than trusted ones, language by language."""
    n = [F.sum(F.col(c).cast("double")).alias(c) for c in ("toxic", "trusted")]

    def learnt(part: DataFrame) -> DataFrame:
        return part.where(F.col("toxic") | (F.col("trusted") & ~_held_out())).where(F.length("text") > 0)

    def held(part: DataFrame) -> DataFrame:
        return learnt(part).select("lang", "toxic", "trusted", F.explode(F.array_distinct(_terms(F.col("text")))).alias("term")).groupBy("lang", "term").agg(*n)

    sizes = _summed(parts, ["lang"], lambda part: learnt(part).groupBy("lang").agg(*n), "kn-judged-parts").where("trusted > 0")
    sizes = staged(sizes.select("lang", F.col("toxic").alias("nt"), F.col("trusted").alias("nc")), "kn-judged-sizes")
    counts = (_summed(parts, ["lang", "term"], held, "kn-terms").join(F.broadcast(sizes), "lang")  # a row for each language
              .groupBy("term").agg(F.sum("toxic").alias("o"), F.sum("trusted").alias("c"), F.sum(F.col("trusted") * F.col("nt") / F.col("nc")).alias("e")))
    ratio = sizes.agg(F.try_divide(F.sum("nt"), F.sum("nc"))).first()[0] or 0.0
    weight = F.log((F.col("o") + 0.5) / (F.col("e") + 0.5 * ratio)) - SURE * F.sqrt(1 / (F.col("o") + 0.5) + 1 / (F.col("c") + 0.5))
    return counts.where("o > 0").select("term", weight.alias("weight")).where("weight > 0")


def ngram_counts(words: DataFrame) -> list[DataFrame]:
    """Tables (lang, gram, c) of order 1, 2, ..., ORDER from (lang, word, n)."""
    marked = words.select("lang", F.concat(F.lit(START), "word", F.lit(END)).alias("s"), "n")
    first = F.greatest(F.col("i") - (ORDER - 1), F.lit(1))
    grams = (marked.select("lang", "s", "n", F.explode(F.sequence(F.lit(2), F.length("s"))).alias("i"))
             .select("lang", F.col("s").substr(first, F.col("i") - first + 1).alias("gram"), "n")
             .groupBy("lang", "gram").agg(F.sum("n").alias("c")))
    grams = staged(grams, "kn-grams")
    tables = [grams.where(F.length("gram") == ORDER)]
    for k in range(ORDER - 1, 0, -1):
        above = tables[0]
        continued = above.groupBy("lang", F.expr(f"substring(gram, 2, {k})").alias("gram")).agg(F.count(F.lit(1)).alias("c"))
        own = grams.where((F.length("gram") == k) & F.col("gram").startswith(START))
        tables.insert(0, staged(continued.unionByName(own), f"kn-order-{k}"))
    return tables


def write_model(words: DataFrame, path: str) -> None:
    """Writes rows (lang, kind, gram, v): log probability of a gram (kind p), log back-off of a context (kind b), log uniform (kind u)."""
    tables = ngram_counts(words)
    sizes = staged(tables[0].groupBy("lang").agg((F.count(F.lit(1)) + 1).alias("symbols")), "kn-symbols")
    below = None
    parts = [sizes.select("lang", F.lit("u").alias("kind"), F.lit("").alias("gram"), (-F.log(F.col("symbols").cast("double"))).alias("v"))]
    for k, table in enumerate(tables, 1):
        n = [F.sum((F.col("c") == j).cast("double")).alias(f"n{j}") for j in (1, 2, 3, 4)]
        y = F.coalesce(F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2")), F.lit(0.5))

        def discount(j: int):
            raw = j - (j + 1) * y * F.try_divide(F.col(f"n{j + 1}"), F.col(f"n{j}"))
            return F.least(F.greatest(F.coalesce(raw, F.lit(0.5 * j)), F.lit(0.1)), F.lit(float(j))).alias(f"d{j}")

        discounts = staged(table.groupBy("lang").agg(*n).select("lang", *[discount(j) for j in (1, 2, 3)]), f"kn-discounts-{k}")
        split = table.select("lang", "gram", "c", F.expr(f"substring(gram, 1, {k - 1})").alias("ctx"))
        contexts = split.groupBy("lang", "ctx").agg(
            F.sum("c").alias("total"), F.sum((F.col("c") == 1).cast("int")).alias("k1"), F.sum((F.col("c") == 2).cast("int")).alias("k2"),
            F.sum((F.col("c") >= 3).cast("int")).alias("k3"))
        backoff = staged(contexts.join(F.broadcast(discounts), "lang").select(  # a row for each language
            "lang", "ctx", "total", "d1", "d2", "d3",
            ((F.col("d1") * F.col("k1") + F.col("d2") * F.col("k2") + F.col("d3") * F.col("k3")) / F.col("total")).alias("gamma")), f"kn-backoff-{k}")
        rows = split.join(backoff, ["lang", "ctx"])
        own = (F.col("c") - F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))) / F.col("total")
        if below is None:
            rows = rows.join(F.broadcast(sizes), "lang").withColumn("lower", 1 / F.col("symbols"))
        else:
            rows = rows.withColumn("tail", F.expr(f"substring(gram, 2, {k - 1})")).join(
                below.select("lang", F.col("gram").alias("tail"), F.col("p").alias("lower")), ["lang", "tail"])
        below = staged(rows.select("lang", "gram", (own + F.col("gamma") * F.col("lower")).alias("p")), f"kn-p-{k}")
        parts.append(below.select("lang", F.lit("p").alias("kind"), "gram", F.log("p").alias("v")))
        parts.append(backoff.select("lang", F.lit("b").alias("kind"), F.col("ctx").alias("gram"), F.log("gamma").alias("v")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out.write.parquet(path)


def shard_model(model: DataFrame, path: str, model_rows: int) -> dict[str, dict[str, int]]:
    """Writes the model's rows in folders ``shard=n`` of about ``model_rows`` rows; says the shard of a symbol by language and symbol before it.

    The rows that say something of a symbol after ``c`` are the grams with ``c`` before their last
    symbol and the contexts that end with ``c``.  Single symbols, the empty context and
    the uniform probability serve all shards and are in ``shard=-1``.
    """
    before = F.when((F.col("kind") == "p") & (F.length("gram") > 1), F.substring("gram", -2, 1)).when(F.col("kind") == "b", F.substring("gram", -1, 1)).otherwise("")
    rows = model.withColumn("before", before)
    shards: dict[str, dict[str, int]] = {}
    shard, size = 0, 0
    for lang, c, n in sorted(map(tuple, rows.groupBy("lang", "before").count().collect())):  # a row for each symbol of a language
        if not c:
            continue
        if size and size + n > model_rows:
            shard, size = shard + 1, 0
        size += n
        shards.setdefault(lang, {})[c] = shard
    places = [(lang, c, shard) for lang, of in shards.items() for c, shard in of.items()]
    placed = F.broadcast(model.sparkSession.createDataFrame(places, "lang string, before string, shard int"))
    (rows.join(placed, ["lang", "before"], "left").select("lang", "kind", "gram", "v", F.coalesce("shard", F.lit(-1)).alias("shard"))
     .repartition("shard", F.pmod(F.xxhash64("gram"), F.lit(8))).write.partitionBy("shard").parquet(path))
    return shards


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of ``wanted`` in sorted keys."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted


class Grams:
    """Values of grams.  Level k has those of k symbols, sorted by the place of the last k - 1 symbols in the level below and the first symbol.

    The model holds with a gram, or context, all that remains when symbols at its front go.
    """

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, values: np.ndarray, most: int):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(1, most + 1):
            own = lengths == k
            key = self._down(codes[own], k) << 21 | codes[own, 0]
            order = np.argsort(key)
            self.levels.append((key[order], values[own][order]))

    def _down(self, codes: np.ndarray, k: int) -> np.ndarray:
        at = np.zeros(len(codes), np.int64)
        for j, (keys, _) in enumerate(self.levels, 1):
            at, there = _find(keys, at << 21 | codes[:, k - j])
            if not there.all():
                raise ValueError("the model holds a gram without its end")
        return at

    def walk(self, symbols: np.ndarray, last: np.ndarray, most: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length: which of the grams that end at ``last``, of at most ``most`` symbols, are there, and their values."""
        of, at = np.arange(len(last)), np.zeros(len(last), np.int64)
        for k, (keys, values) in enumerate(self.levels, 1):
            on = most[of] >= k
            of = of[on]
            at, there = _find(keys, at[on] << 21 | symbols[last[of] - k + 1])
            of, at = of[there], at[there]
            yield of, values[at]

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for level in self.levels for a in level)


class Model:
    """One language's model, or a shard of it."""

    def __init__(self, rows):
        import pyarrow.compute as pc

        held = {}
        for kind, most in (("p", ORDER), ("b", ORDER - 1)):
            own = rows.filter(pc.equal(rows["kind"], kind))
            held[kind] = Grams(_codes(own["gram"]), pc.utf8_length(own["gram"]).to_numpy(), own["v"].to_numpy(), most)
        self.p, self.b = held["p"], held["b"]
        short = rows.filter(pc.equal(rows["gram"], ""))
        single = dict(zip(short["kind"].to_pylist(), short["v"].to_pylist()))
        self.uniform, self.empty = single["u"], single.get("b", 0.0)

    @property
    def nbytes(self) -> int:
        return self.p.nbytes + self.b.nbytes

    def log_p(self, symbols: np.ndarray, at: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Log probabilities of the symbols at ``at``, at a distance of ``place`` from their word's start mark."""
        depth = np.minimum(place + 1, ORDER)
        total, longest = np.full(len(at), self.uniform + self.empty), np.zeros(len(at), np.int64)
        for k, (of, values) in enumerate(self.p.walk(symbols, at, depth), 1):
            total[of], longest[of] = values, k
        for k, (of, values) in enumerate(self.b.walk(symbols, at - 1, depth - 1), 1):
            off = k >= longest[of]
            total[of[off]] += values[off]
        return total


def _codes(grams) -> np.ndarray:
    """Code points of at most ``ORDER`` symbols, a row for each gram."""
    parts = [np.array(x.to_pylist(), dtype=f"U{ORDER}").view(np.uint32).reshape(-1, ORDER) for c in grams.chunks for x in (c.slice(i, 65_536) for i in range(0, len(c), 65_536))]
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros((0, ORDER), np.int64)


def _laid_out(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(symbols, places to score, their distance from the start mark, their word), about ``SYMBOLS`` at once."""
    group: list[str] = []
    first = size = 0
    for i, word in enumerate(words + [""]):
        if group and (i == len(words) or size + len(word) > SYMBOLS):
            lengths = np.fromiter(map(len, group), np.int64, len(group)) + 2
            place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            at = np.flatnonzero(place)
            yield _points(START + (END + START).join(group) + END), at, place[at], np.repeat(np.arange(first, i), lengths - 1)
            group, size = [], 0
        if len(word) > SYMBOLS:  # in pieces, each with the symbols before it that its grams reach
            for begin in range(1, len(word) + 2, SYMBOLS):
                back = max(0, begin - ORDER + 1)
                symbols = _points((START + word + END)[back:begin + SYMBOLS])
                at = np.arange(begin - back, len(symbols))
                yield symbols, at, at + back, np.full(len(at), i)
        elif i < len(words):
            first = first if group else i
            group.append(word)
            size += len(word) + 2


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)


class Scorer:
    """Scores texts in a worker: the model's shards and the terms' weights as far as they are held, and the words remembered."""

    def __init__(self, path: str, shards: dict[str, dict[str, int]], model_rows: int, terms_path: str, hold_terms: bool):
        self.path, self.room, self.terms_path = path, model_rows * ROW_BYTES, terms_path
        self.shards = {lang: (np.array(list(map(ord, sorted(of))), np.int64), np.array([of[c] for c in sorted(of)])) for lang, of in shards.items()}
        self.held: dict[int, dict[str, Model]] = {}
        self.known: dict[str, dict[str, float]] = {lang: {} for lang in shards}
        self.weights = self._weights(None) if hold_terms else None
        self.block = 0  # a batch at a time, as long as everything is held
        for shard in sorted({n for of in shards.values() for n in of.values()}):
            models = self._load(shard)
            self.room -= sum(model.nbytes for model in models.values())
            if self.room < 0:
                self.block = BLOCK
                break
            self.held[shard] = models
        if self.weights is None:
            self.block = BLOCK

    def _load(self, shard: int) -> dict[str, Model]:
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyarrow import parquet

        store, folder = open_store(self.path)
        rows = pa.concat_tables([parquet.ParquetDataset(f"{folder}/shard={n}", filesystem=store, partitioning=None).read(["lang", "kind", "gram", "v"]) for n in (-1, shard)])
        return {lang: Model(rows.filter(pc.equal(rows["lang"], lang))) for lang, (_, of) in self.shards.items() if shard in of}

    def _weights(self, only: set[bytes] | None) -> dict[bytes, float]:
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyarrow import dataset

        store, folder = open_store(self.terms_path)
        wanted = None if only is None else pa.array([term.decode() for term in only], pa.string())
        found: dict[bytes, float] = {}
        for batch in dataset.dataset(folder, filesystem=store, format="parquet").to_batches(columns=["term", "weight"]):
            batch = batch if wanted is None else batch.filter(pc.is_in(batch["term"], value_set=wanted))
            found.update(zip((term.encode() for term in batch["term"].to_pylist()), batch["weight"].to_pylist()))
        return found

    def log_p(self, lang: str, words: list[str]) -> np.ndarray:
        """Log probabilities of words."""
        total = np.zeros(len(words))
        before, of = self.shards[lang]
        for shard in np.unique(of).tolist():
            model = (self.held.get(shard) or self._load(shard))[lang]
            for symbols, at, place, word in _laid_out(words):
                if (of != shard).any():  # after a symbol that the model does not know, the first shard's single symbols serve
                    k, there = _find(before, symbols[at - 1])
                    mine = np.where(there, of[k], of.min()) == shard
                    at, place, word = at[mine], place[mine], word[mine]
                if len(at):
                    parts = np.bincount(word - word[0], weights=model.log_p(symbols, at, place))
                    total[word[0]:word[0] + len(parts)] += parts
        return total

    def _known(self, lang: str, words: list[str]) -> np.ndarray:
        """``log_p`` of different words, most of them remembered."""
        known = self.known[lang]
        missing = [word for word in words if word not in known]
        if len(known) + len(missing) > CACHE_WORDS:
            known.clear()
            missing = words
        known.update(zip(missing, self.log_p(lang, missing).tolist()))
        values = np.fromiter(map(known.__getitem__, words), float, len(words))
        for word in missing:
            if len(word) > 40:
                del known[word]
        if len(known) > CACHE_WORDS:
            known.clear()
        return values

    def score(self, langs: list[str], texts: list[str | None]) -> pd.DataFrame:
        """Symbols, log probability and toxicity of each text."""
        import pyarrow as pa
        import pyarrow.compute as pc

        n_symbols, log_p = np.zeros(len(texts), np.int64), np.full(len(texts), np.nan)
        for lang in set(langs):
            rows = np.array([i for i, x in enumerate(langs) if x == lang])
            cut = pc.ascii_split_whitespace(pa.array([(texts[i] or "").lower() for i in rows], pa.large_string()))
            of = np.repeat(np.arange(len(rows)), pc.list_value_length(cut).to_numpy())
            coded = cut.flatten().dictionary_encode()
            at, sizes = coded.indices.to_numpy(), pc.utf8_length(coded.dictionary).to_numpy()
            n_symbols[rows] = np.bincount(of, weights=(sizes + (sizes > 0))[at], minlength=len(rows)).astype(np.int64)
            if lang in self.known:
                values = np.zeros(len(sizes))
                values[sizes > 0] = self._known(lang, [word for word in coded.dictionary.to_pylist() if word])
                log_p[rows] = np.bincount(of, weights=values[at], minlength=len(rows))
        log_p[n_symbols == 0] = np.nan
        weights = self._weights({term for text in texts if text for term in terms_of(text)}) if self.weights is None else self.weights
        return pd.DataFrame({"n_symbols": n_symbols, "log_p": log_p, "toxicity": [worst_span(weights, text) if text and weights else 0.0 for text in texts]})


def _blocks(batches: Iterable[tuple[pd.Series, pd.Series]], block: int) -> Iterator[list[tuple[pd.Series, pd.Series]]]:
    """Batches of together at least ``block`` characters."""
    held, size = [], 0
    for langs, texts in batches:
        held.append((langs, texts))
        size += sum(len(text) for text in texts if text)
        if size >= block:
            yield held
            held, size = [], 0
    if held:
        yield held


_LOADED: dict[str, Scorer] = {}


def _score_in_workers(docs: DataFrame, path: str, shards: dict[str, dict[str, int]], model_rows: int, terms_path: str, hold_terms: bool) -> DataFrame:

    @F.pandas_udf("n_symbols long, log_p double, toxicity double")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        if path not in _LOADED:
            _LOADED.clear()
            _LOADED[path] = Scorer(path, shards, model_rows, terms_path, hold_terms)
        scorer = _LOADED[path]
        for block in _blocks(batches, scorer.block):
            rows = scorer.score([lang for langs, _ in block for lang in langs], [text for _, texts in block for text in texts])
            done = 0
            for langs, _ in block:
                yield rows.iloc[done:done + len(langs)].reset_index(drop=True)
                done += len(langs)

    return docs.select("id", "lang", scored("lang", "text").alias("s")).select("id", "lang", "s.n_symbols", "s.log_p", "s.toxicity")


def perplexities(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                 quantile: float = QUANTILE, model_rows: int = MODEL_ROWS) -> DataFrame:
    """Per document: lang, n_symbols, perplexity, threshold, toxicity, toxicity_limit, kept."""
    named = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col(text_col).alias("text"))
    ids = staged(judged_ids(labels, id_col), "kn-judged")
    n_ids = ids.count()
    parts, spark = _judged(named, ids, n_ids), docs.sparkSession
    words = _summed(parts, ["lang", "word"], lambda part: part.where("trusted").select("lang", F.explode(_words(F.col("text"))).alias("word"))
                    .groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "kn-word-parts")
    made, path, terms_path = (scratch_path(spark, name) for name in ("kn-model", "kn-shards", "kn-toxic-terms"))
    write_model(staged(words, "kn-words"), made)
    shards = shard_model(spark.read.schema("lang string, kind string, gram string, v double").parquet(made), path, model_rows)
    toxic_terms(parts).write.parquet(terms_path)
    hold_terms = spark.read.schema("term string, weight double").parquet(terms_path).count() <= TERMS
    scored = _score_in_workers(named, path, shards, model_rows, terms_path, hold_terms)
    # the texts are done with: only their scores meet the identifiers
    scored = scored.join(F.broadcast(ids) if n_ids <= TRUSTED_IDS else ids, F.col("id") == F.col("__judged"), "left").select(
        "id", "lang", F.coalesce("trusted", F.lit(False)).alias("trusted"), "n_symbols", "log_p", "toxicity")
    scored = staged(scored.withColumn("perplexity", F.exp(F.try_divide(-F.col("log_p"), F.col("n_symbols")))), "kn-scored")
    worst = F.percentile_approx(F.when(_held_out(), F.col("toxicity")), quantile, 10_000)
    limits = staged(scored.where("trusted").groupBy("lang").agg(
        F.percentile_approx("perplexity", quantile, 10_000).alias("threshold"), worst.alias("toxicity_limit")), "kn-limits")
    everywhere = scored.where("trusted").agg(worst).first()[0]
    limit = F.coalesce("toxicity_limit", F.lit(everywhere).cast("double"))
    return scored.join(limits, "lang", "left").select(
        F.col("id").alias(id_col), "lang", "n_symbols", "perplexity", "threshold", "toxicity", limit.alias("toxicity_limit"),
        ((F.col("n_symbols") > 0) & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
         & F.coalesce(F.col("toxicity") <= limit, F.lit(True))).alias("kept"))
