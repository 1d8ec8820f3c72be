"""Personal data in free text found and replaced by typed placeholders (p10).

Generators propose overlapping spans with high recall; boosted trees score each span by its format and context;
spans above a calibrated threshold are selected, best first, without overlaps. The models are fitted once
on the driver from a bounded sample and sent to the executors (a few hundred kB, whatever the input); the scan
over the documents is one narrow, Arrow-batched pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.gbdt import BoostedTrees, best_threshold
from ledgerloom.llm.name_statistics import NameStatistics
from ledgerloom.llm.pii_spans import KINDS, NameKnowledge, People, candidates
from ledgerloom.llm.pii_training import FAMILIES, GIVEN, NOUNS, THINGS, labelled_sentences, ordinary_words
from ledgerloom.storage import spread

#: Bounds of the labelled sample: sentences built, and directory names and titles they are built with. What the
#: candidates and features know of names and titles comes from all of them, see ``name_statistics``.
TRAINING_ROWS = 8_000
SAMPLE_ROWS = 2_000
#: Texts scored at once: bounds the memory of a Python worker.
CHUNK = 256


@dataclass
class Redactor:
    knowledge: NameKnowledge
    models: dict[str, BoostedTrees]
    thresholds: dict[str, float]
    quality: dict[str, tuple[float, float]]

    def select(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Per text the chosen (start, end, kind), in text order."""
        out: list[list[tuple[int, int, str]]] = []
        for at in range(0, len(texts), CHUNK):
            out += self._select(texts[at : at + CHUNK])
        return out

    def _scored(self, kind: str, x: np.ndarray) -> np.ndarray:
        return self.models[kind].probability(x) if len(x) else np.zeros(0)

    def _select(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        self.knowledge.forget()
        people = People(self.knowledge)
        scored: list[list[tuple[float, int, int, str]]] = [[] for _ in texts]
        others: dict[str, list] = {k: [] for k in KINDS}
        for i, t in enumerate(texts):
            tokens = t.split()
            codes = self.knowledge.codes(tokens)
            people.collect(i, t, codes, tokens)
            for c in candidates(t, codes):
                others[c.kind].append((i, c))
        if people.spans:
            p = self._scored("person", people.features())
            for n in np.flatnonzero(p >= self.thresholds["person"]).tolist():
                i, a, b = people.spans[n]
                scored[i].append((float(p[n]), a, b, "person"))
        for kind, at in others.items():
            if at:
                p = self._scored(kind, np.array([c.x for _, c in at], dtype=np.float32))
                for n in np.flatnonzero(p >= self.thresholds[kind]).tolist():
                    i, c = at[n]
                    scored[i].append((float(p[n]), c.start, c.end, kind))
        out = []
        for spans in scored:
            taken: list[tuple[int, int, str]] = []
            # a span inside a clear longer one of its kind loses to it
            for q, a, b, k in sorted(spans, key=lambda s: (-round(s[0], 1), -(s[2] - s[1]), s[1])):
                if all(b <= x or a >= y for x, y, _ in taken):
                    taken.append((a, b, k))
            out.append(sorted(taken))
        return out


def fit(statistics: NameStatistics | None = None, people: list[str] | None = None, titles: list[str] | None = None, rows: int = TRAINING_ROWS, seed: int = 11) -> Redactor:
    """Models of all kinds; a third of the sentences is held out for calibration, thresholds and quality.

    ``statistics`` know every name and title; ``people`` and ``titles`` are samples of them to build sentences with.
    """
    known = statistics or NameStatistics()
    # two thirds of the built-in names are known, as if a directory held them; ordinary words are known as such
    for k, f in enumerate(FAMILIES):
        if k % 3:
            known.learn_name(f"{GIVEN[k % len(GIVEN)]} {f}")
    for w in NOUNS[::2] + THINGS[::2] + ordinary_words():
        known.learn_title(w)
    knowledge = NameKnowledge(known)
    data = labelled_sentences(rows, seed, people or [], titles or [])
    gold: list[set[tuple[str, int, int]]] = [set(g) for _, g in data]
    xs: dict[str, list] = {k: [] for k in KINDS}
    ys: dict[str, list] = {k: [] for k in KINDS}
    held: dict[str, list] = {k: [] for k in KINDS}
    proposed = People(knowledge)
    for i, (text, _) in enumerate(data):
        tokens = text.split()
        codes = knowledge.codes(tokens)
        proposed.collect(i, text, codes, tokens)
        for c in candidates(text, codes):
            xs[c.kind].append(c.x)
            ys[c.kind].append(float((c.kind, c.start, c.end) in gold[i]))
            held[c.kind].append(i % 3 == 0)
    ys["person"] = [float(("person", a, b) in gold[i]) for i, a, b in proposed.spans]
    held["person"] = [i % 3 == 0 for i, _, _ in proposed.spans]
    models, thresholds, quality = {}, {}, {}
    for k in KINDS:
        x = proposed.features() if k == "person" else np.array(xs[k], dtype=np.float32)
        y, h = np.array(ys[k]), np.array(held[k])
        m = BoostedTrees(trees=110 if k == "person" else 60).fit(x[~h], y[~h]).calibrate(x[h], y[h])
        p = m.probability(x[h])
        # a missed piece is worse than a needless placeholder
        models[k], thresholds[k] = m, best_threshold(p, y[h], 1.3 if k == "person" else 1.0)
        hit = p >= thresholds[k]
        n = sum(g[0] == k for i, (_, gs) in enumerate(data) if i % 3 == 0 for g in gs)
        quality[k] = (float((y[h][hit]).mean()) if hit.any() else 0.0, float(y[h][hit].sum()) / max(1, n))
    return Redactor(knowledge, models, thresholds, quality)


def sample(rows: DataFrame, column: str, most: int = SAMPLE_ROWS) -> list[str]:
    """A bounded, deterministic sample of distinct texts: the ``most`` smallest by hash."""
    distinct = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("n")).distinct()
    return sorted(r["n"] for r in distinct.orderBy(F.xxhash64("n"), "n").limit(most).collect())


_FOUND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("pii_kind", T.StringType()), T.StructField("pii_text", T.StringType())])
_CLEAN = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_pieces", T.IntegerType())])


def find_pii(docs: DataFrame, doc_id: str, text: str, model: Redactor) -> DataFrame:
    """(doc_id, pii_kind, pii_text): each distinct piece of each document; null and empty texts have none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["t"].tolist()
            rows = [(d, k, t[x:y]) for d, t, spans in zip(b["d"].tolist(), texts, shared.value.select(texts)) for x, y, k in spans]
            yield pd.DataFrame(sorted(set(rows)), columns=["doc_id", "pii_kind", "pii_text"])

    source = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).where("d is not null and t is not null and t <> ''")
    return spread(source).mapInPandas(run, _FOUND)


def redact(docs: DataFrame, doc_id: str, text: str, model: Redactor) -> DataFrame:
    """(doc_id, text, n_pieces): texts with every piece replaced by [KIND]; null texts stay null with 0 pieces."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["t"].tolist()
            out = []
            for d, t, spans in zip(b["d"].tolist(), texts, shared.value.select([t or "" for t in texts])):
                s, at = [], 0
                for x, y, k in spans:
                    s += [t[at:x], f"[{k.upper()}]"]
                    at = y
                out.append((d, None if t is None else "".join(s) + t[at:], len(spans)))
            yield pd.DataFrame(out, columns=["doc_id", "text", "n_pieces"])

    return spread(docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).where("d is not null")).mapInPandas(run, _CLEAN)
