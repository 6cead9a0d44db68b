"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows around what they find.

The lexicon is mined from labelled texts (a bounded sample): words, and word beginnings with many endings, that occur
in toxic texts and hardly elsewhere. Near copies count once, by their smallest 5-word hash. The Levenshtein automata
of all entries run over the trie together; their sets of (node, errors) are made deterministic as words ask for them,
so a word costs one dictionary step a character. A found term weighs its log odds; a misspelling weighs what its own
occurrences in the sample show; in a quotation it weighs a part. A logistic curve over the sums gives the score.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import short_batches

#: Bounds of the labelled sample (smallest hashes of doc_id first) and of the lexicon.
SAMPLE_TOXIC, SAMPLE_CLEAN = 6000, 12000
MOST_TERMS = 3000
LEAST_TEXTS = 3
LEAST_PRECISION = 0.9
#: Entries that may be there by chance, over all words tried.
FALSE_TERMS = 0.02
WINDOW = 6
QUOTED, ADDRESSED = 0.3, 1.25
CACHE = 100_000
STATES = 20_000

# fixed values: cues of reported speech, words of address, quotation marks
REPORTED = frozenset("said says wrote called quote quoted sagte schrieb zitat dijo escribió cita dit écrit citation".split())
ADDRESS = frozenset("you your u youre du dich dein tú tu vous toi ton usted".split())
OPENING, CLOSING = "\"'“„«‘(", "\"'”“»’)"
_PLAIN = str.maketrans("013457@$", "oieastas")
_INNER = re.compile(r"[^\w]|_")
_RUN = re.compile(r"(.)\1{2,}")


def plain(word: str) -> str:
    """A word as the lexicon has it: lower case, common digit spellings read as letters, marks and long runs taken out."""
    word = word.lower()
    if not word.isalpha():
        word = _INNER.sub("", word if word.isdigit() else word.translate(_PLAIN))
    return _RUN.sub(r"\1", word)


def errors_allowed(term: str, stem: bool) -> int:
    return 0 if stem or len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """The trie of the entries (term, weight, stem) and the lazily determinised union of their Levenshtein automata."""

    def __init__(self, entries: list[tuple[str, float, bool]]):
        self.entries = entries
        self.fuzzy: dict[int, float] = {}
        self.children: list[dict[str, int]] = [{}]
        self.budget, self.ends = [0], [[]]
        for k, (term, _, stem) in enumerate(entries):
            node, most = 0, errors_allowed(term, stem)
            self.budget[0] = max(self.budget[0], most)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.budget.append(0)
                    self.ends.append([])
                node = self.children[node][c]
                self.budget[node] = max(self.budget[node], most)
            self.ends[node].append(k)
        self._reset()

    def __getstate__(self):
        return self.entries, self.fuzzy

    def __setstate__(self, state):
        self.__init__(state[0])
        self.fuzzy = state[1]

    def _reset(self):
        self.ids: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.sets: list[frozenset] = []
        self.whole: list[tuple[int, int] | None] = []
        self.begun: list[tuple[int, int] | None] = []
        self.cache: dict[str, tuple[int, int] | None] = {}
        self.start = self._state({(0, 0, "")})

    def _state(self, raw: set) -> int:
        # (node, errors, awaited): awaited is the second letter of two that stand swapped; closed over skipped letters
        todo, best = list(raw), {}
        while todo:
            node, e, awaited = todo.pop()
            if e > self.budget[node] or best.get((node, awaited), 9) <= e:
                continue
            best[node, awaited] = e
            if not awaited:
                todo += [(child, e + 1, "") for child in self.children[node].values()]
        key = frozenset((n, e, a) for (n, a), e in best.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            found = [(e, -self.entries[k][1], k) for n, e, a in key if not a for k in self.ends[n]]
            full = [x for x in found if x[0] <= errors_allowed(self.entries[x[2]][0], self.entries[x[2]][2])]
            stems = [x for x in full if self.entries[x[2]][2]]
            self.whole.append((min(full)[2], min(full)[0]) if full else None)
            self.begun.append((min(stems)[2], 0) if stems else None)
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, e, awaited in self.sets[state]:
            if awaited:
                if c == awaited:
                    out.add((node, e, ""))
                continue
            out.add((node, e + 1, ""))
            for x, child in self.children[node].items():
                out.add((child, e if x == c else e + 1, ""))
                if x != c and c in self.children[child]:  # the two letters may stand swapped
                    out.add((self.children[child][c], e + 1, x))
        return self._state(out)

    def find(self, word: str) -> tuple[int, int] | None:
        """(entry, errors) of the best entry for a word, or None."""
        if word in self.cache:
            return self.cache[word]
        if len(self.cache) > CACHE or len(self.sets) > STATES:
            self._reset()
        state, best = self.start, None
        w = plain(word)
        for c in w if len(w) > 2 else "":
            nxt = self.steps[state].get(c)
            if nxt is None:
                nxt = self.steps[state][c] = self._step(state, c)
            state = nxt
            best = best or self.begun[state]
            if not self.sets[state]:
                break
        if len(w) > 2:
            best = self.whole[state] or best
        self.cache[word] = best
        return best

    def weight(self, hit: tuple[int, int]) -> float:
        k, errors = hit
        return self.entries[k][1] if errors == 0 else self.fuzzy.get(k, 0.0)

    def features(self, text: str) -> list[float]:
        """log-sum of weights in open speech, the greatest, log count, log-sum in quotations, rate."""
        words = text.split()
        hits = {w: h for w in set(words) if (h := self.find(w))}
        if not hits:
            return [0.0] * 5
        open_, quoted, most, n = 0.0, 0.0, 0.0, 0
        for i, w in enumerate(words):
            if w not in hits or (weight := self.weight(hits[w])) <= 0:
                continue
            n += 1
            before, after = words[max(0, i - WINDOW) : i], words[i + 1 : i + 1 + WINDOW]
            opened = w[0] in OPENING or any(x[0] in OPENING for x in before)
            closed = w.rstrip(".,;:!?")[-1:] in CLOSING or any(x.rstrip(".,;:!?")[-1:] in CLOSING for x in after)
            if opened and closed or any(x.strip(".,:;").lower() in REPORTED for x in before):
                quoted += QUOTED * weight
                most = max(most, QUOTED * weight)
            else:
                near = any(x.strip(".,:;!?").lower() in ADDRESS for x in words[max(0, i - 2) : i] + words[i + 1 : i + 2])
                weight *= ADDRESSED if near else 1
                open_ += weight
                most = max(most, weight)
        return [math.log1p(open_), most, math.log1p(n), math.log1p(quoted), n / len(words)]


def odds(toxic: float, clean: float, n_toxic: float, n_clean: float) -> float:
    return math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))


def chance(t: int, c: int, share: float) -> float:
    """Probability that of t + c texts t or more are toxic if a word has nothing to do with it."""
    n = int(t + c)
    if not 0 < share < 1:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log(1 - share) for k in range(int(t), n + 1)]
    return min(1.0, sum(map(math.exp, logs)))


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 5 == 0


def training_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of the bounded sample of labelled rows outside the held-out fold."""
    known = short_batches(labels).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("r", F.xxhash64("doc_id"))
    parts = [known.where(F.col("toxic") == v).orderBy("r", "doc_id").limit(n) for v, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    sample = parts[0].union(parts[1]).select("doc_id", "toxic")  # at most SAMPLE_TOXIC + SAMPLE_CLEAN rows
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").where("text IS NOT NULL").select("text", "toxic")


def _words(batches):
    """Distinct plain words of each text, and its smallest 5-word hash, which near copies share."""
    from .near_dedup import shingle_sets

    for batch in batches:
        texts = batch.column("text").to_pylist()
        least = [int(x[0].astype(np.int64)) if len(x) else 0 for x in shingle_sets([t.encode() for t in texts])]
        words = [sorted({p for w in set(t.split()) if 2 < len(p := plain(w)) < 40}) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(least, pa.int64()), pa.array(words, pa.list_(pa.string()))], names=["toxic", "copy", "words"])


def mine(texts: DataFrame) -> list[tuple[str, float, bool]]:
    """The lexicon of (text, toxic): at most MOST_TERMS entries reach the driver.

    Words of one or two letters, and of 40 or more, are never entries.
    """
    sets = texts.mapInArrow(_words, "toxic int, copy long, words array<string>").dropDuplicates(["toxic", "copy"]).persist()
    try:
        n = {r["toxic"]: r["n"] for r in sets.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        nt, nc = n.get(1, 0), n.get(0, 0)
        per_word = sets.select("toxic", F.explode("words").alias("word")).groupBy("word")
        per_word = per_word.agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
        stems = per_word.withColumn("k", F.explode(F.sequence(F.lit(4), F.lit(7)))).where("length(word) > k")
        stems = stems.groupBy(F.expr("substring(word, 1, k)").alias("word")).agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.count("*").alias("forms"))
        stems = stems.where("forms >= 4 AND t >= 8").drop("forms").withColumn("stem", F.lit(True))
        found = per_word.where(F.col("t") >= LEAST_TEXTS).withColumn("stem", F.lit(False)).union(stems)
        tried = found.count()
        found = found.where(F.col("t") * nc >= LEAST_PRECISION / (1 - LEAST_PRECISION) * (F.col("c") + 0.3) * nt)
        rows = found.orderBy(F.desc("t"), "word", "stem").limit(MOST_TERMS).collect()
    finally:
        sets.unpersist()
    share = nt / max(1, nt + nc)
    rows = [r for r in rows if chance(r["t"], r["c"], share) * tried <= FALSE_TERMS]
    terms = {(r["word"], r["stem"]): odds(r["t"], r["c"], nt, nc) for r in rows}
    whole = {w for w, stem in terms if stem}
    # a stem whose own beginning is an entry too is dropped, as is a word that a stem has
    begun = lambda w, own: any(w[:k] in whole for k in range(4, min(8, len(w) + (0 if own else 1))))
    return [(w, v, stem) for (w, stem), v in terms.items() if not begun(w, stem)]


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Ridge logistic regression; coefficients of toxic evidence stay non-negative.

    Projected Newton steps over the coefficients that may move, each shortened until the loss falls; where none does, the
    plain gradient is tried. The loss therefore never rises, whatever the rows, and a fit that isn't at its minimum fails.
    """
    x = np.column_stack([np.ones(len(x)), x])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    w = np.zeros(x.shape[1])
    w[0] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))

    def loss(v):
        m = x @ v
        return float(np.logaddexp(0, m).sum() - y @ m + 0.5 * (penalty * v * v).sum())

    def bounded(v):
        return np.concatenate([v[:1], np.maximum(v[1:], 0)])

    now = loss(w)
    for _ in range(500):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (p - y) + penalty * w
        free = (w > 0) | (slope < 0)
        free[0] = True
        if np.abs(slope[free]).max() <= 1e-7 * (1 + len(y)):
            return w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        newton = np.zeros(len(w))
        newton[free] = np.linalg.solve(curve[np.ix_(free, free)], slope[free])
        moved = False
        for step in (newton, slope / np.diag(curve), slope / np.trace(curve)):
            for k in range(40):
                new = bounded(w - 0.5**k * step)
                if (then := loss(new)) < now:
                    w, now, moved = new, then, True
                    break
            if moved:
                break
        if not moved:  # no step lowers the loss: it is at its minimum but for rounding
            break
    if not np.isfinite(w).all() or np.abs(slope[free]).max() > 1e-2 * (1 + len(y)):
        raise ArithmeticError(f"the score's curve did not converge: {w}")
    return w


class Model:
    def __init__(self, lexicon: Lexicon, curve: np.ndarray):
        self.lexicon, self.curve = lexicon, curve

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([self.lexicon.features(t or "") for t in texts]).reshape(-1, 5)
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + x @ self.curve[1:], -30, 30)))


def _misspelt(lexicon: Lexicon):
    def scan(batches):
        for batch in batches:
            out = [sorted({h[0] for w in set(t.split()) if (h := lexicon.find(w)) and h[1]}) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(out, pa.list_(pa.int64()))], names=["toxic", "hits"])

    return scan


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Mines the lexicon, weighs misspellings and fits the curve; without labels every score is the same."""
    texts = training_texts(docs, labels).persist()
    try:
        n = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        lexicon = Lexicon(mine(texts))
        seen = texts.mapInArrow(_misspelt(lexicon), "toxic int, hits array<long>").select("toxic", F.explode("hits").alias("k"))
        for r in seen.groupBy("k").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).collect():  # a row for each entry at most
            exact = lexicon.entries[r["k"]][1]
            lexicon.fuzzy[r["k"]] = min(0.8 * exact, odds(r["t"] + 0.5, r["c"], n.get(1, 0), n.get(0, 0)))
        for k, (_, weight, stem) in enumerate(lexicon.entries):
            if not stem:
                lexicon.fuzzy.setdefault(k, 0.6 * weight)

        def features(batches):
            for batch in batches:
                x = [lexicon.features(t) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

        rows = texts.mapInArrow(features, "toxic int, x array<double>").collect()  # bounded as the sample is
    finally:
        texts.unpersist()
    y = np.array([r["toxic"] for r in rows], dtype=float)
    x = np.array([r["x"] for r in rows]).reshape(-1, 5)
    curve = _fit_logistic(x, y) if len(set(y.tolist())) == 2 else np.array([-3.0, 1.0, 0.5, 0.5, 0.2, 0.0])
    return Model(lexicon, curve)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs (doc_id, text; more are ignored).

    Null and empty texts score as texts without a term. A null doc_id is not held out. Repeated rows are scored each.
    An empty table gives an empty result; an empty table of labels leaves an empty lexicon.
    """
    model = train(docs, labels)

    def apply(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(batch.column("text").to_pylist()))], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(apply, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents (all columns) that are not predicted toxic."""
    model = train(docs, labels)

    @F.pandas_udf("boolean")
    def clean(text):
        import pandas as pd

        return pd.Series(model.score(text.tolist()) < 0.5)

    return docs.where(clean(F.col("text")))
