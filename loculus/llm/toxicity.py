"""Toxicity scores from a lexicon matched with spelling errors.

The lexicon's trie is intersected with Levenshtein automata (0 errors up to 3 letters, 1 up to 8, 2 beyond). The product
is determinized lazily: a state is a set of (trie node, errors), states and their successors are kept by the worker, and
a word costs a few dictionary look-ups until its state is dead. Each hit gets a score from a window of words around it:
quotation marks and words of reporting or mention lower it, words of address raise it. A logistic model over the sums of
these scores gives the probability; lexicon, known-clean forms and model are learned from labelled rows.

The one bound of learning: about ``max_rows`` labelled ids (chosen by a hash of the id, so alike in every run). All that is
learned comes from these rows, so it is bounded by them: a term has to be in two per cent of the toxic ones, and a known-clean
form is a misspelling that occurs in them. No list is cut. Scoring covers every row, whole texts and words of any length.

Defined results: null and empty texts have no hits and get the model's score of no hits; rows of labels with a null id or
null label are left out; an id labelled twice is toxic if any of its rows says so; of documents that repeat an id the least
text is learned from and every one is scored; with no labelled rows the model falls back to the seed lexicon and fixed
weights; an empty table gives an empty one; columns of other names, clashing ones too, don't matter.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, map_rows

#: Seed terms of abuse; learning adds to them.
SEED = ("idiot", "moron", "stupid", "scum", "trash", "loser", "pathetic", "worthless", "disgusting", "bastard", "dumbass", "retard", "imbecile", "arschloch", "dummkopf", "schlampe", "connard", "salope", "abruti", "imbécile", "gilipollas", "cabrón", "estúpido", "idiota")
REPORTING = frozenset("said says say quote quoted quotes quoting called calls word words term slur insult meaning cited reported sagte zitat wort nannte dit mot cité appelé dijo palabra cita llamó".split())
ADDRESS = frozenset("you your you're youre u ur du dich dein deine tu toi vous votre tú te usted eres are es".split())
QUOTES = frozenset("\"'“”„«»‘’`")
FEATURES = ("abuse", "quoted", "exact", "fuzzy", "density", "terms", "address")
WINDOW = 5


def allowed(term: str) -> int:
    return 0 if len(term) <= 3 else 1 if len(term) <= 8 else 2


class LexiconAutomaton:
    """The lexicon's trie under Levenshtein automata, as a lazily built DFA."""

    def __init__(self, terms: list[str], limit: int = 20_000):
        self.terms, self.limit = list(terms), limit
        self.next: list[dict[str, int]] = [{}]
        self.end: list[int] = [-1]
        self.room: list[int] = [0]
        for k, term in enumerate(self.terms):
            n = 0
            self.room[0] = max(self.room[0], allowed(term))
            for c in term:
                if c not in self.next[n]:
                    self.next[n][c] = len(self.next)
                    self.next.append({})
                    self.end.append(-1)
                    self.room.append(0)
                n = self.next[n][c]
                self.room[n] = max(self.room[n], allowed(term))
            self.end[n] = k
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.step: list[dict[str, int]] = []
        self.best: list[tuple[int, int] | None] = []
        self.start = self._state({0: 0})

    def _state(self, best: dict[int, int]) -> int:
        """Number of the state of these (node, errors), closed under leaving out letters of the term; -1 if empty."""
        todo = list(best)
        while todo:
            n = todo.pop()
            e = best[n] + 1
            for m in self.next[n].values():
                if e <= self.room[m] and e < best.get(m, 99):
                    best[m] = e
                    todo.append(m)
        if not best:
            return -1
        key = frozenset(best.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.step.append({})
            hits = [(e, self.end[n]) for n, e in key if self.end[n] >= 0 and e <= allowed(self.terms[self.end[n]])]
            self.best.append(min(hits) if hits else None)
        return self.ids[key]

    def _move(self, state: int, c: str) -> int:
        best: dict[int, int] = {}
        for n, e in self.sets[state]:
            for d, m in self.next[n].items():
                f = e + (d != c)
                if f <= self.room[m] and f < best.get(m, 99):
                    best[m] = f
            if e + 1 <= self.room[n] and e + 1 < best.get(n, 99):
                best[n] = e + 1
        s = self._state(best)
        self.step[state][c] = s
        return s

    def match(self, word: str) -> tuple[int, int] | None:
        """(errors, term) of the nearest term within its allowed errors."""
        if len(self.sets) > self.limit:
            self._clear()
        s = self.start
        for c in word:
            t = self.step[s].get(c)
            s = self._move(s, c) if t is None else t
            if s < 0:
                return None
        return self.best[s]


@dataclass
class ToxicityModel:
    terms: list[str]
    weights: list[float]
    clean_forms: list[str] = field(default_factory=list)
    mean: list[float] = field(default_factory=lambda: [0.0] * len(FEATURES))
    scale: list[float] = field(default_factory=lambda: [1.0] * len(FEATURES))
    coef: list[float] = field(default_factory=lambda: [2.0, 0.2, 0.5, 0.2, 0.1, 0.5, 0.1])
    bias: float = -2.0

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, s: str) -> ToxicityModel:
        return cls(**json.loads(s))


class Matcher(dict):
    """token -> (errors, term, form) or None, remembered up to a bound."""

    def __init__(self, model: ToxicityModel, limit: int = 100_000):
        super().__init__()
        self.model, self.limit = model, limit
        self.dfa = LexiconAutomaton(model.terms)
        self.clean = frozenset(model.clean_forms)

    def __missing__(self, token: str):
        parts, part = [], []
        for c in token + " ":
            if c.isalnum():
                part.append(c)
            elif part:
                parts.append("".join(part))
                part = []
        if len(parts) > 1:
            parts.append("".join(parts))
        best = None
        for w in parts:
            m = self.dfa.match(w) if len(w) >= 3 else None
            if m and (m[0] == 0 or w not in self.clean) and (best is None or m[0] < best[0]):
                best = (*m, w)
        if len(self) < self.limit:
            self[token] = best
        return best

    def features(self, text: str | None) -> tuple[list[float], list[tuple[int, int, str]]]:
        """The document's features and its hits."""
        words = (text or "").lower().split()
        found = list(map(self.__getitem__, words))
        out = [0.0] * len(FEATURES)
        hits = [(i, m) for i, m in enumerate(found) if m]
        if not hits:
            return out, []
        abuse = quoted = address = 0.0
        for i, (errors, term, form) in hits:
            near = words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]
            token = words[i]
            at = token.find(form)
            marks = at >= 0 and bool(QUOTES & set(token[:at]) or QUOTES & set(token[at + len(form) :]))
            report = sum(w.strip(".,:;!?\"'“”") in REPORTING for w in near)
            addressed = sum(w.strip(".,:;!?\"'“”") in ADDRESS for w in near)
            strength = self.model.weights[term] * (1 - errors / max(len(self.model.terms[term]), 1))
            share = 1 / (1 + math.exp(-(2.0 * marks + 0.7 * report - 0.5 * addressed - 2.0)))
            abuse += strength * (1 - share)
            quoted += strength * share
            address += addressed
        out[:] = [
            math.log1p(abuse),
            math.log1p(quoted),
            math.log1p(sum(m[0] == 0 for _, m in hits)),
            math.log1p(sum(m[0] > 0 for _, m in hits)),
            math.log1p(100 * len(hits) / len(words)),
            math.log1p(len({m[1] for _, m in hits})),
            math.log1p(address),
        ]
        return out, [m for _, m in hits]

    def score(self, text: str | None) -> float:
        f, _ = self.features(text)
        m = self.model
        z = m.bias + sum(c * (x - a) / s for c, x, a, s in zip(m.coef, f, m.mean, m.scale, strict=True))
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))


def labelled(docs: DataFrame, labels: DataFrame, max_rows: int, key: str = "doc_id") -> DataFrame:
    """(key, text, toxic) of at most about max_rows labelled documents, chosen by a hash of the id; one row an id."""
    known = labels.where(F.col(key).isNotNull() & F.col("toxic").isNotNull()).groupBy(key).agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int(max_rows / n * (1 << 20)))
    texts = docs.select(key, "text").join(known, key)
    return texts.groupBy(key).agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Ridge-penalized logistic regression by Newton steps; the bias is free of the penalty."""
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    pen = np.r_[np.full(x.shape[1], l2), 1e-6]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(pen), a.T @ (p - y) + pen * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit(rows: DataFrame, min_toxic: int = 3, ratio: float = 12.0) -> ToxicityModel:
    """Learn lexicon, known-clean forms and weights from (text, toxic) rows; the caller bounds the rows."""
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)), F.lit(0)).alias("t")).first()
    n, t = total["n"], total["t"]
    if not n or not t or t == n:
        return ToxicityModel(list(SEED), [2.0] * len(SEED))
    words = rows.select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("w")).where(F.length("w") >= 3)
    counts = words.groupBy("w").agg(F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") > 0, 0).otherwise(1)).alias("b"))
    lift = (F.col("a") / F.lit(float(t))) / ((F.col("b") + 0.5) / F.lit(float(n - t)))
    least = max(min_toxic, int(0.02 * t))
    top = counts.where((F.col("a") >= least) & (lift >= ratio)).select("w", lift.alias("lift"), "a").orderBy(F.desc("a"), "w").collect()
    weight = {r["w"]: min(6.0, math.log(r["lift"])) for r in top}
    terms = sorted(weight | {s: 2.0 for s in SEED if s not in weight})
    model = ToxicityModel(terms, [weight.get(w, 2.0) for w in terms])
    first = model.to_json()

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Matcher(ToxicityModel.from_json(first))
        for b in batches:
            out = [(f, int(y > 0)) for x, y in zip(b["text"], b["toxic"], strict=True) for f in {h[2] for h in m.features(x)[1] if h[0]}]
            yield pd.DataFrame(out, columns=["form", "y"])

    forms = rows.mapInPandas(hits, "form string, y int").groupBy("form").agg(F.sum("y").alias("a"), F.count("*").alias("n")).where((F.col("n") - F.col("a")) > F.col("a"))
    model.clean_forms = [r["form"] for r in forms.orderBy(F.desc("n"), "form").collect()]
    second = model.to_json()

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Matcher(ToxicityModel.from_json(second))
        for b in batches:
            yield pd.DataFrame({"f": [m.features(x)[0] for x in b["text"]], "y": (b["toxic"] > 0).astype(int)})

    # Rows of equal features are one weighted row: what reaches the driver is bounded by the labelled rows.
    got = rows.mapInPandas(vectors, "f array<double>, y int").toPandas()
    x, y = np.array(got["f"].tolist(), float), got["y"].to_numpy(float)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1.0
    coef, bias = logistic((x - mean) / scale, y)
    model.mean, model.scale, model.coef, model.bias = mean.tolist(), scale.tolist(), coef.tolist(), bias
    return model


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, **kw) -> ToxicityModel:
    """A model from labelled documents; the sample of at most about max_rows rows is read twice more, so it is kept."""
    rows = labelled(docs, labels, max_rows).select("text", "toxic").persist()
    try:
        return fit(rows, **kw)
    finally:
        rows.unpersist()


def score(docs: DataFrame, model: ToxicityModel, keys: list[str] | None = None, text: str = "text") -> DataFrame:
    """Per row: the key columns and score."""
    said = model.to_json()

    def make():
        m = Matcher(ToxicityModel.from_json(said))
        return lambda texts: ((m.score(t),) for t in texts)

    return map_rows(docs, keys or ["doc_id"], [text], make, "score double")


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows, all columns, whose score is below the threshold."""
    said = model.to_json()

    def make():
        m = Matcher(ToxicityModel.from_json(said))
        return lambda t: m.score(t) < threshold

    return keep_rows(docs, text, make)


def held_out():
    """Rows of labels that are never learned from: crc32 of the id as text, remainder 0 by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
