"""Toxicity scores of text that may be disguised.

Tokens that look disguised (digits or signs among letters, a letter three or more times in a row, letters set apart) are
read as observations of a noisy channel: every position is a set of letters that it may stand for, a run of one letter may
stand for one or two, and Viterbi decoding under a character trigram model of the whole corpus finds the word. Documents
are then scored by logistic regression on character n-grams of the restored words.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltwork.llm.common import id_bucket, near_least

#: What a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "¡": "i", "€": "e", "£": "l", "§": "s",
}
#: Signs that hide a letter or set letters apart.
MASKS, GAPS = "*#_%", ".-_*~'’·"
CLASSES = 28  # 0: no letter; 1 to 26: a to z; 27: any other letter
MEMO_WORDS = 200_000
#: States that decoding carries on, the likeliest ones: a bound for signs that may stand for any letter, of which a few in a row leave hundreds.
BEAM = 64
#: Shorter texts count as this long.
LEAST_TOKENS = 40


@dataclass(frozen=True)
class ToxicityOptions:
    """The classifier is fitted on at most max_toxic and max_clean labelled rows."""

    max_toxic: int = 800
    max_clean: int = 1600
    features: int = 600
    least_documents: int = 3
    ridge: float = 0.005
    threshold: float = 0.7


@functools.cache
def class_table() -> np.ndarray:
    table = np.array([27 if chr(i).isalpha() else 0 for i in range(1 << 16)], np.int64)
    table[97:123] = np.arange(1, 27)
    return table


def count_trigrams(texts: list[str]) -> np.ndarray:
    """How often each triple of classes follows another, a boundary being before and after every text."""
    total = np.zeros(CLASSES**3, np.int64)
    table, at = class_table(), 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < 1_000_000):
            size += len(texts[end])
            end += 1
        codes = np.frombuffer(("  " + "  ".join(texts[at:end]) + "  ").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        c = table[np.minimum(codes, 0xFFFF)]
        total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
        at = end
    return total


def corpus_trigrams(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigram counts over all texts: each task adds up its own, so at most CLASSES ** 3 rows leave it, and as many the sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            total += count_trigrams([t or "" for t in batch.column(0).to_pylist()])
        gram = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int32()), pa.array(total[gram], pa.int64())], ["gram", "n"])

    found = df.select(F.col(text_col).alias("text")).mapInArrow(run, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(CLASSES**3, np.int64)
    for row in found:
        total[row.gram] = row.n
    return total


class Restorer:
    """Viterbi decoding of disguised words under the trigram model."""

    def __init__(self, counts: np.ndarray) -> None:
        c = counts.reshape(CLASSES, CLASSES, CLASSES).astype(float)
        two, one = c.sum(axis=0), c.sum(axis=(0, 1))
        base = (one + 1) / (one.sum() + CLASSES)
        pair = (two + 5 * base) / (two.sum(axis=1, keepdims=True) + 5)
        self.cost = -np.log((c + 5 * pair) / (c.sum(axis=2, keepdims=True) + 5))
        self.cost = self.cost.tolist()

    #: Letters set apart by one blank or sign each, at least four of them.
    APART = re.compile(r"(?<![^\s])(?:[^\W_]|[@$!|+])(?:[ .\-_*~'’·](?:[^\W_]|[@$!|+])){3,}(?![^\s])")
    ANY_LETTER, SIGN_AFTER, SIGN_BEFORE = re.compile(r"[^\W\d_]"), re.compile(r"[0-9@$!|+(<{¡€£§*#_%.\-~'’·]"), re.compile(r"[0-9@$!|+(<{¡€£§]")
    THRICE = re.compile(r"([^\W\d_])\1\1")
    TRIPLE = re.compile(r"(.)\1\1", re.I)
    #: Signs that stand around a token, and those that do where they come twice or more at its end.
    OPENING, CLOSING, REPEATED = frozenset("\"'“”„«»([{.,;:?"), frozenset("\"'“”„«»)]}.,;:?!"), frozenset("#&%*$!")

    def bared(self, token: str) -> str:
        """The token without signs around it, in time linear in it."""
        low, high = 0, len(token)
        while low < high and token[low] in self.OPENING:
            low += 1
        while low < high:
            last = token[high - 1]
            if last in self.CLOSING:
                high -= 1
            elif last in self.REPEATED and high - low > 1 and token[high - 2] == last:
                while high > low and token[high - 1] == last:
                    high -= 1
            else:
                break
        return token[low:high]

    def disguised(self, token: str) -> bool:
        """Whether a sign follows a letter, a letter follows a sign or a letter comes three times in a row; in time linear in the token."""
        letter, sign = self.ANY_LETTER.search(token), self.SIGN_BEFORE.search(token)
        if letter and self.SIGN_AFTER.search(token, letter.end()) or sign and self.ANY_LETTER.search(token, sign.end()):
            return True
        return bool(self.THRICE.search(token))

    def decode(self, token: str) -> str:
        """The likeliest word behind a token of any length, in lower case.

        A run of one character is one position; states point back to the ones before and a beam bounds them, so time and
        memory are linear.
        """
        lattice: list[list[tuple[str, float]]] = []
        for run in re.finditer(r"(.)\1*", token.lower(), re.S):
            ch, n = run[1], len(run[0])
            if ch.isalpha():
                lattice.append([(ch, 0.1)] if n == 1 else [(ch, 1.0), (ch * 2, 0.7)] if n > 2 else [(ch * 2, 0.1), (ch, 2.5)])
            elif ch in LEET:
                read = [(x, 0.7) for x in LEET[ch]]
                lattice.append(read + [(x * 2, 1.2) for x, _ in read] * (n > 1))
            elif ch in MASKS and n < 3:
                lattice.append([("", 3.0)] + [(chr(97 + i) * n, 3.0) for i in range(26)] * (n == 1))
            elif ch in GAPS:
                lattice.append([("", 0.2)])
            else:
                lattice.append([(" ", 0.2)])
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        table, cost = class_table(), self.cost
        for options in [*lattice, [(" ", 0.0)]]:
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (paid, back) in states.items():
                for letters, price in options:
                    x, y, total = a, b, paid + price
                    for ch in letters:
                        k = int(table[min(ord(ch), 0xFFFF)])
                        total += cost[x][y][k]
                        x, y = y, k
                    if (x, y) not in after or total < after[x, y][0]:
                        after[x, y] = (total, (back, letters))
            if len(after) > BEAM:
                after = dict(sorted(after.items(), key=lambda s: s[1][0])[:BEAM])
            states = after
        least = min(paid for paid, _ in states.values())
        return min(self.spell(back) for paid, back in states.values() if paid == least).strip()

    @staticmethod
    def spell(back: tuple | None) -> str:
        out = []
        while back:
            back, letters = back
            out.append(letters)
        return "".join(reversed(out))

    def restore_token(self, token: str) -> str:
        """The token in lower case without signs around it, decoded if it looks disguised."""
        bare = token.strip(".,;:!?")
        if bare.isalpha() and not self.TRIPLE.search(bare):
            return bare.lower()
        bare = self.bared(bare).lower()
        if self.disguised(bare) and "@" not in bare[1:-1].replace("@", "", bare.count("@") - ("." in bare)):
            return self.decode(bare)
        return bare

    def restore(self, text: str) -> str:
        """The whole text with letters that were set apart joined and disguised tokens restored."""
        joined = self.APART.sub(lambda m: "".join(ch for ch in m[0] if not ch.isspace() and ch not in GAPS), text)
        return " ".join(self.restore_token(t) for t in joined.split())


def grams(word: str) -> set[str]:
    """Character n-grams (4 to 6) of the runs of letters in a word, with marks for the ends of a run."""
    out: set[str] = set()
    for run in re.findall(r"[^\W\d_]+", word):
        marked = f"^{run}$"
        for n in (4, 5, 6):
            out.update([marked[i : i + n] for i in range(len(marked) - n + 1)])
    return out


class Scorer:
    def __init__(self, counts: np.ndarray, rows: list[tuple[str, int]], options: ToxicityOptions) -> None:
        self.restorer, self.options = Restorer(counts), options
        self.memo: dict[str, tuple[int, ...]] = {}
        self.feature: dict[str, int] = {}
        self.automaton = None
        self.weights, self.by_size, self.bias = np.zeros(0), 0.0, 0.0
        if rows:
            self.fit(rows)

    def tokens(self, text: str) -> set[str]:
        parts = set(text.split())
        for m in Restorer.APART.finditer(text):
            parts.add("".join(ch for ch in m[0] if not ch.isspace() and ch not in GAPS))
        return parts

    def fit(self, rows: list[tuple[str, int]]) -> None:
        """Chooses n-grams by their log-likelihood ratio with the label, then fits their weights by Newton's method."""
        n = (max(1, sum(1 - y for _, y in rows)), max(1, sum(y for _, y in rows)))
        toxic: Counter[str] = Counter()
        for text, label in rows:
            if label:
                toxic.update(set().union(*[grams(self.restorer.restore_token(t)) for t in self.tokens(text)]))
        least = max(self.options.least_documents, n[1] // 200)
        self.feature = {g: k for k, g in enumerate(sorted(g for g, a in toxic.items() if a >= least))}
        toxic = Counter({g: toxic[g] for g in self.feature})
        names, clean = list(self.feature), Counter()
        for text, label in rows:
            if not label:
                clean.update({names[k] for t in self.tokens(text) for k in self.features_of(self.restorer.restore_token(t))})

        def gain(a: int, b: int) -> float:
            p, q, r = (a + 0.5) / (n[1] + 1), (b + 0.5) / (n[0] + 1), (a + b + 1) / (n[0] + n[1] + 2)
            return a * math.log(p / r) + b * math.log(q / r) + (n[1] - a) * math.log((1 - p) / (1 - r)) + (n[0] - b) * math.log((1 - q) / (1 - r))

        best = sorted((-gain(a, clean[g]), g) for g, a in toxic.items() if a * n[0] > 4 * clean[g] * n[1])
        self.feature, self.automaton = {g: k for k, (_, g) in enumerate(best[: self.options.features])}, None
        x = np.zeros((len(rows), len(self.feature) + 2))
        for i, (text, _) in enumerate(rows):
            tokens = self.tokens(text)
            own = Counter(k for t in tokens for k in self.features_of(self.restorer.restore_token(t)))
            for k, times in own.items():
                x[i, k] = math.log1p(times)
            x[i, -2:] = math.log(max(len(tokens), LEAST_TOKENS)), 1
        y = np.array([label for _, label in rows], float)
        w, decay = np.zeros(x.shape[1]), np.full(x.shape[1], self.options.ridge * math.sqrt(len(rows)))
        decay[-1] = 1e-6
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(decay), x.T @ (p - y) + decay * w)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.weights, self.by_size, self.bias = w[:-2], float(w[-2]), float(w[-1])

    def features_of(self, word: str) -> tuple[int, ...]:
        """The features among a word's n-grams, found in one pass by an automaton of all features."""
        if not self.feature:
            return ()
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for g, k in self.feature.items():
                self.automaton.add_word(g, k)
            self.automaton.make_automaton()
        marked = f"^{word}$" if word.isalpha() else "".join([f"^{run}$" for run in re.findall(r"[^\W\d_]+", word)])
        return tuple({k for _, k in self.automaton.iter(marked)})

    def score(self, text: str) -> float:
        """How likely the label is 1: n-grams count by the number of different tokens that hold them."""
        memo, own, tokens = self.memo, Counter(), self.tokens(text)
        for t in tokens:
            k = memo.get(t)
            if k is None:
                if len(memo) >= MEMO_WORDS:
                    memo.clear()
                k = memo[t] = self.features_of(self.restorer.restore_token(t))
            if k:
                own.update(k)
        z = self.bias + self.by_size * math.log(max(len(tokens), LEAST_TOKENS)) + sum(float(self.weights[k]) * math.log1p(own[k]) for k in sorted(own))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def learn(docs: DataFrame, labels: DataFrame, usable: Column, options: ToxicityOptions = ToxicityOptions(), text_col: str = "text") -> Scorer:
    """A scorer from trigrams of all texts and from labelled documents where usable (on doc_id) holds.

    Of each label the rows with the least hash are taken, up to the documented bound. A document labelled toxic by any of
    repeated label rows counts as toxic; null labels and ids are left out.
    """
    marked = labels.where(usable & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}
    chosen = None
    for label, most in ((1, options.max_toxic), (0, options.max_clean)):
        own = marked.where(F.col("toxic") == label).select("doc_id", "toxic", F.xxhash64("doc_id").alias("h"))
        some = own.where(near_least(F.col("h"), most, F.lit(counts.get(label, 0)))).orderBy(F.shiftrightunsigned("h", 34), "h", "doc_id").limit(most).drop("h")
        chosen = some if chosen is None else chosen.union(some)
    # The chosen ids are at most max_toxic + max_clean rows, so the texts needn't move.
    rows = docs.where(F.col(text_col).isNotNull()).select("doc_id", F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    taken = [(r.text, r.toxic) for r in sorted(rows.select("doc_id", "toxic", "text").collect(), key=lambda r: (-r.toxic, r.doc_id, r.text))]
    return Scorer(corpus_trigrams(docs, text_col), taken, options)


def score_documents(docs: DataFrame, scorer: Scorer, restored: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, score (0 to 1), predicted (1 from the threshold on), and the restored text if asked for.

    Null and empty texts get the score of a document without any feature. Repeated rows stay; other columns are left out,
    so their names can't clash.
    """
    scorer.memo, scorer.automaton = {}, None
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            scores = [scorer.score(t) for t in texts]
            columns = [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= scorer.options.threshold) for s in scores], pa.int32())]
            if restored:
                columns.append(pa.array([scorer.restorer.restore(t) for t in texts], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted", "restored"][: len(columns)])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double, predicted int" + ", restored string" * restored)


def without_toxic(docs: DataFrame, scorer: Scorer, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, whose score is below the threshold."""
    scorer.memo, scorer.automaton = {}, None
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t or "") < scorer.options.threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def score_held_out(docs: DataFrame, labels: DataFrame, options: ToxicityOptions = ToxicityOptions()) -> DataFrame:
    """Scores of all documents, with labels learned from two thirds of them (crc32 of the id modulo 3 isn't 1)."""
    found = score_documents(docs, learn(docs, labels, id_bucket(F.col("doc_id"), 3) != 1, options))
    return found.select("doc_id", (id_bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
