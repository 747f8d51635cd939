"""Toxicity by noisy-channel deobfuscation, then scoring of the restored words.

1. A character language model: trigrams over 28 classes (word border, a-z after
   dropping accents, other letters), counted over the whole texts of all documents.
2. Tokens become lattices: each character stays, is read as a letter it looks like, or
   vanishes as a separator or a repetition, at a cost; Viterbi finds the cheapest reading
   under channel and model.  A token of letters without a repetition has one reading, itself.
   Symbols at a token's ends that may be letters give a second reading with them.  Letters
   spelled out with gaps are one lattice.
3. Restored words, and their first 4 to 6 letters, get the share of toxic texts among
   labelled texts that hold them, as a lower confidence bound; a text's score is
   the noisy-or of its words' bounds.

Labels are learned from MOST_LABELLED labelled documents at most, those with the
smallest hashes; model counts cover everything.  As one text may have many copies, a
word counts once for all its occurrences between the same two neighbours: copies,
near copies and shared passages repeat those, independent texts don't.  A word whose toxic texts
mostly repeat such surroundings belongs to copies and isn't learned from; clean texts
speak against it each, copies too.

Defined cases: null text counts as empty and gets the base score; rows with a
null doc_id take no part; labels that are null are ignored, of several labels
of a document the largest counts; without labels every score is 0; repeated rows
are scored alike; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import bounded_batches, rows_not_in, stored

#: Labelled documents to learn from, at most.
MOST_LABELLED = 20_000
#: Different surroundings that a feature must have, also as a share of its texts (so many are enough), and the normal quantile of its lower bound.
LEAST_TEXTS, LEAST_SHARE, ENOUGH, QUANTILE = 3, 0.5, 100, 2.25
#: The least bound that counts, of a word and of first letters, which more words bear out.
LEAST_BOUND, LEAST_SURE = 0.4, 0.6
THRESHOLD = 0.3
CLASSES = 28
#: Tokens that a task remembers.
KEPT_TOKENS = 100_000

#: The letters that a character may stand for.
LOOKS_LIKE = {
    "0": "o",
    "1": "il",
    "2": "z",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "gb",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "i",
    "|": "il",
    "+": "t",
    "(": "c",
    "€": "e",
    "а": "a",
    "е": "e",
    "о": "o",
    "р": "p",
    "с": "c",
    "у": "y",
    "х": "x",
    "і": "i",
    "ѕ": "s",
    "α": "a",
    "ι": "i",
    "ο": "o",
    "ν": "v",
    "ρ": "p",
    "τ": "t",
    "υ": "u",
}
#: Costs in nats: a character read as a letter, dropped, a repetition dropped (of two, of more), a digit kept, a gap kept.
READ, DROPPED, TWICE, MANY, KEPT, GAP = 1.0, 1.2, 4.0, 0.3, 4.0, 0.5
EDGES = ".,;:!?\"'()[]{}<>*#%&~-_/\\|=`^"
#: What may be a letter, and so is read both ways at a token's ends.
LIKE_LETTERS = "".join(c for c in LOOKS_LIKE if not c.isalnum())
ENDS = "".join(c for c in EDGES if c not in LIKE_LETTERS)
SPELLED = re.compile(r"(?<!\S)(?:\S\s++){2,}\S(?!\S)")
TWICE_OR_MORE = re.compile(r"(.)\1")
LATIN = re.compile(r"[a-z]")
OTHER_LIKE = re.compile("[" + "".join(c for c in LOOKS_LIKE if c.isalpha()) + "]")


def _class_table() -> np.ndarray:
    """Class of each code point below 2**16: 0 no letter, 1-26 a-z, 27 another letter."""
    table = np.zeros(1 << 16, dtype=np.int32)
    for c in range(1 << 16):
        char = chr(c)
        if char.isalpha():
            base = unicodedata.normalize("NFKD", char.lower())[0] if char.lower() else char
            table[c] = ord(base) - 96 if "a" <= base <= "z" else 27
    return table


_tables: dict[str, np.ndarray] = {}


def _classes() -> np.ndarray:
    if "classes" not in _tables:
        _tables["classes"] = _class_table()
    return _tables["classes"]


def char_class(char: str) -> int:
    code = ord(char)
    return int(_classes()[code]) if code < 1 << 16 else 27 if char.isalpha() else 0


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of class trigrams over all texts, each with a border at both ends: CLASSES**3 numbers, whatever the input."""

    def run(batches):
        total = np.zeros(CLASSES**3, dtype=np.int64)
        table = _classes()
        for batch in batches:
            for text in batch.column(0):
                codes = np.frombuffer(f"  {text.as_py() or ''} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                c = table[np.minimum(codes, 0xFFFF)]
                total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])], ["gram", "n"])

    rows = docs.select("text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(CLASSES**3)
    for gram, n in rows:
        counts[gram] = n
    return counts


def language_model(counts: np.ndarray) -> list[float]:
    """Costs (negative log-probabilities) of trigrams, smoothed by the bigram's and the letter's share."""
    c = counts.reshape(CLASSES, CLASSES, CLASSES)
    one = (c.sum(axis=(0, 1)) + 1) / (c.sum() + CLASSES)
    two = (c.sum(axis=0) + 5 * one) / (c.sum(axis=0).sum(axis=1, keepdims=True) + 5)
    three = (c + 5 * two) / (c.sum(axis=2, keepdims=True) + 5)
    return (-np.log(three)).ravel().tolist()


class Channel:
    """Restores tokens under a language model."""

    def __init__(self, costs: list[float]):
        self.costs = costs

    def _options(self, chars: str, at: int, read: bool = False) -> list[tuple[str, float]]:
        """(what a character becomes, cost)."""
        char = chars[at]
        if char == " ":
            return [(" ", GAP), ("", 0.0)]
        out = [(x, READ) for x in LOOKS_LIKE.get(char, "")]
        again = at and chars[at - 1] == char
        if char.isalpha():
            out.append((char, 0.0))
            if again:
                run = at + 1 < len(chars) and chars[at + 1] == char or at > 1 and chars[at - 2] == char
                out.append(("", MANY if run else TWICE))
        elif char.isdigit():
            out.append((char, KEPT))
            if again:
                out.append(("", MANY))
        elif not read or not out:
            out.append(("", DROPPED))
        elif again:
            out.append(("", MANY))
        return out

    def restore(self, chars: str, read: bool = False) -> str:
        """The cheapest reading of a lattice; spaces in the result separate words. read: symbols that look like letters are letters."""
        costs = self.costs
        # a state's best path is a chain of (character, chain before), so that a step costs the same at any length
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for at in range(len(chars)):
            options = [(x, cost, char_class(x) if x else -1) for x, cost in self._options(chars, at, read)]
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, path) in states.items():
                for x, more, c in options:
                    key = (a, b) if c < 0 else (b, c)
                    total = cost + more + (0.0 if c < 0 else costs[(a * CLASSES + b) * CLASSES + c])
                    known = after.get(key)
                    if known is None or total < known[0]:
                        after[key] = (total, (x, path) if x else path)
            states = after
        _, _, path = min((cost + costs[(a * CLASSES + b) * CLASSES], n, path) for n, ((a, b), (cost, path)) in enumerate(states.items()))
        out = []
        while path is not None:
            out.append(path[0])
            path = path[1]
        return "".join(reversed(out))

    def _plain(self, token: str) -> bool:
        """Whether a token is its own cheapest reading, told without walking its lattice.

        A token of letters has other readings only by dropping repetitions; one that stands
        apart from others changes two trigrams into one.
        """
        if not token.isalpha() or not (token.isascii() or not (OTHER_LIKE.search(token) and LATIN.search(token))):
            return False
        last = -2
        for m in TWICE_OR_MORE.finditer(token):
            at = m.start()
            before, x, after = char_class(token[at - 1]) if at else 0, char_class(token[at]), char_class(token[at + 2]) if at + 2 < len(token) else 0
            cost = lambda a, b, c: self.costs[(a * CLASSES + b) * CLASSES + c]
            if at == last or token[at + 2 : at + 3] == token[at] or TWICE + cost(before, x, after) < cost(before, x, x) + cost(x, x, after):
                return False
            last = at + 2
        return True

    def words(self, token: str) -> list[str]:
        """The restored words of one token without white space, read between the symbols at its ends."""
        if self._plain(token):
            return [token]
        inner = self._inner(token)
        if self._plain(inner):
            return [inner]
        return self.restore(inner).split() if any(c.isalpha() or c in LOOKS_LIKE for c in inner) else []

    @staticmethod
    def _inner(token: str) -> str:
        return re.sub(r"^[$@+€]{2,}|[$@+€]{2,}$", "", token.strip(EDGES)).strip(EDGES)

    def readings(self, token: str) -> list[str]:
        """The words of a token, and those of its reading with the symbols at its ends that may be letters."""
        if " " in token:
            return self.restore(token).split()
        found, whole = self.words(token), token.strip(ENDS)
        if whole != token.strip(EDGES + "$@+€") and any(map(str.isalpha, whole)):
            found = found + [w for w in self.restore(whole, read=True).split() if w not in found]
        return found

    def restore_text(self, text: str) -> str:
        """A whole text in lower case with its odd tokens restored."""
        text = SPELLED.sub(lambda m: self.restore(" ".join(m[0].split())), text.lower())
        return re.sub(r"\S+", lambda m: " ".join(self.words(m[0])), text)


def tokens_of(text: str) -> set[str]:
    """Distinct tokens of a whole text, and its runs of spelled-out letters as tokens with spaces."""
    text = text.lower()
    found = set(text.split())
    found.update(" ".join(m[0].split()) for m in SPELLED.finditer(text))
    return found


def features_of(word: str) -> list[str]:
    """A word without accents, and its first letters (marked by a star)."""
    if not word.isascii():
        word = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))
    return [word, *(f"{word[:k]}*" for k in (4, 5, 6) if len(word) > k)]


def places_of(text: str) -> dict[str, int]:
    """Every token of tokens_of with a hash of the words before and after its first occurrence."""
    text = text.lower()
    tokens = text.split()
    around = ["", *tokens, ""]
    found: dict[str, int] = {}
    for i, t in enumerate(tokens):
        if t not in found:
            found[t] = hash_of(f"{around[i]} {around[i + 2]}")
    for m in SPELLED.finditer(text):
        found.setdefault(" ".join(m[0].split()), hash_of(" ".join(text[max(0, m.start() - 40) : m.start()].split()[-1:] + text[m.end() : m.end() + 40].split()[:1])))
    return found


def _feature_rows(sample: DataFrame, costs) -> DataFrame:
    """doc_id, toxic, and the distinct features of each labelled text with their surroundings."""

    def run(batches):
        channel = Channel(costs.value)
        cache: dict[str, list[str]] = {}
        for batch in batches:
            features, places, ends = [], [], [0]
            for text in batch.column(1):
                if len(cache) > KEPT_TOKENS:
                    cache = {}
                own: dict[str, int] = {}
                for t, place in places_of(text.as_py() or "").items():
                    if t not in cache:
                        cache[t] = [f for w in channel.readings(t) for f in features_of(w)]
                    for f in cache[t]:
                        own.setdefault(f, place)
                features += own.keys()
                places += own.values()
                ends.append(len(features))
            pairs = pa.StructArray.from_arrays([pa.array(features, pa.string()), pa.array(places, pa.int64())], ["feature", "place"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], ["doc_id", "toxic", "features"])

    return sample.select("doc_id", "text", "toxic").mapInArrow(run, "doc_id long, toxic int, features array<struct<feature:string,place:long>>")


def hash_of(words: str) -> int:
    """A 63-bit hash that doesn't change between processes."""
    return int.from_bytes(hashlib.blake2b(words.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1


def held_out_ids(column) -> F.Column:
    """The rows never learned from: crc32 of the id's text is 2 modulo 4."""
    return F.crc32(column.cast("string").cast("binary")) % 4 == 2


def learn(docs: DataFrame, labels: DataFrame, costs) -> tuple[dict[str, float], float]:
    """Bounds of features that are high enough, and the share of toxic texts among those without any.

    Everything here comes from MOST_LABELLED texts at most.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.filter(~held_out_ids(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED)
    # MOST_LABELLED rows of two numbers
    rows = stored(_feature_rows(docs.join(F.broadcast(known), "doc_id"), costs))
    seen = rows.select(F.when(F.col("toxic") == 1, 1).otherwise(0).alias("toxic"), F.explode("features").alias("f")).groupBy("toxic", "f.feature", "f.place").agg(F.count("*").alias("texts"))
    one = F.col("toxic") == 1
    counts = seen.groupBy("feature").agg(F.count(F.when(one, 1)).alias("hits"), F.coalesce(F.sum(F.when(~one, F.col("texts"))), F.lit(0)).alias("misses"), F.sum(F.when(one, F.col("texts"))).alias("texts"))
    counts = stored(counts.filter((F.col("hits") >= LEAST_TEXTS) & ((F.col("hits") >= LEAST_SHARE * F.col("texts")) | (F.col("hits") >= ENOUGH))))
    # first letters say something only if several words share them; one word speaks for itself
    starts = counts.filter("feature not like '%*'").select(F.explode(F.array(*(F.concat(F.substring("feature", 1, k), F.lit("*")) for k in (4, 5, 6)))).alias("feature"), "hits").groupBy("feature").agg(F.max("hits").alias("largest"))
    n, z = F.col("hits") + F.col("misses"), QUANTILE
    share = F.col("hits") / n
    bound = (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    telling = counts.withColumn("bound", bound).filter(F.col("bound") >= F.when(F.col("feature").like("%*"), LEAST_SURE).otherwise(LEAST_BOUND)).join(starts, "feature", "left").filter(F.col("hits") >= 2 * F.coalesce("largest", F.lit(0)))
    bounds = {r.feature: r.bound for r in telling.select("feature", "bound").collect()}
    toxic, total = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    return bounds, min(0.1, toxic / total / 4) if total else 0.0


def score(docs: DataFrame, costs, bounds: dict[str, float], base: float) -> DataFrame:
    """doc_id, score, n_hits of whole texts."""
    spark = docs.sparkSession
    given = spark.sparkContext.broadcast(bounds)

    def run(batches):
        channel, bounds = Channel(costs.value), given.value
        neutral: set[str] = set()
        known: dict[str, float] = {}
        for batch in batches:
            scores, hits = [], []
            for text in batch.column(1):
                odds, n = 1 - base, 0
                for t in tokens_of(text.as_py() or "") - neutral:
                    bound = known.get(t)
                    if bound is None:
                        bound = max((bounds.get(f, 0.0) for w in channel.readings(t) for f in features_of(w)), default=0.0)
                        if bound:
                            known[t] = bound
                        else:
                            neutral.add(t)
                            continue
                    odds *= 1 - bound
                    n += 1
                if len(neutral) > KEPT_TOKENS:
                    neutral = set()
                if len(known) > KEPT_TOKENS:
                    known = {}
                scores.append(1 - odds)
                hits.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(hits, pa.int64())], ["doc_id", "score", "n_hits"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, n_hits long")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from THRESHOLD on), n_hits of every document."""
    bounded_batches(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    spark = docs.sparkSession
    costs = spark.sparkContext.broadcast(language_model(trigram_counts(docs)))
    bounds, base = learn(docs, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"), costs)
    scored = score(docs, costs, bounds, base)
    return scored.select("doc_id", held_out_ids(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_hits")


def restored(docs: DataFrame) -> DataFrame:
    """doc_id and restored text of every document."""
    bounded_batches(docs)
    costs = docs.sparkSession.sparkContext.broadcast(language_model(trigram_counts(docs)))

    def run(batches):
        channel = Channel(costs.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([channel.restore_text(t.as_py() or "") for t in batch.column(1)], pa.string())], ["doc_id", "text"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, text string")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't predicted toxic, with all columns; null doc_ids stay."""
    dropped = stored(toxicity(docs, labels).filter("predicted = 1").select("doc_id"))
    return rows_not_in(docs, dropped, "doc_id")
