"""Evaluation passages inside training text, by a distributed positional inverted index (p9).

``PassageIndex`` stores the postings of every word of the corpus, once, in segments: a segment covers documents of
about ``SEGMENT_WORDS`` words, and holds one row per term with all places of the term in the segment, sorted by
term. It is built by one narrow pass, outlives the session where it is given a path, can be appended to, and serves
any number of queries. Each stretch of ``length`` item words is represented by its rarest terms; their lists, shifted
by their offsets, are intersected, and where all of a stretch's terms stand at one shift the words around are compared
by the places in the index: no text is read again.

The items are a stated, small query set, taken in blocks of at most ``MAX_BLOCK_WORDS`` words: a block's
vocabulary and anchors are the only data sent to every executor. A query shuffles the lists of the block's terms by
segment, so a group is bounded by the segment's size, however frequent a term is.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.words import words
from ledgerloom.storage import Workspace, spread

MAX_BLOCK_WORDS = 200_000
#: Words in a segment, about: a document is never parted, so one of more words is a segment of its own.
SEGMENT_WORDS = 400_000
#: Places in a segment at most (but for one longer document): bounds the memory of a query's task.
MAX_PLACES = 1 << 24
#: Free places between two documents of a segment; no span of a query may be longer.
GAP = 256

_SEGMENT = T.StructType([T.StructField("segment", T.LongType()), T.StructField("term", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("places", T.BinaryType()), T.StructField("docs", T.BinaryType())])
_HIT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("n_words", T.IntegerType())])
_NEAR = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("n_terms", T.IntegerType())])


def item_blocks(items: DataFrame, item_id: str, text: str, most: int = MAX_BLOCK_WORDS) -> Iterator[dict[int, list[str]]]:
    """Items as {id: words}, in blocks of at most ``most`` words (one item alone may be longer)."""
    block: dict[int, list[str]] = {}
    n = 0
    for row in items.select(item_id, text).where(F.col(item_id).isNotNull()).orderBy(item_id).toLocalIterator():
        w = words(row[1])
        if block and n + len(w) > most:
            yield block
            block, n = {}, 0
        block[row[0]] = w
        n += len(w)
    if block:
        yield block


def _pack(places: np.ndarray) -> bytes:
    """Ascending places as differences."""
    return np.diff(places, prepend=0).astype("<i4").tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, dtype="<i4"), dtype=np.int64)


def _segment_rows(segment: int, ids: list[int], starts: list[int], at: np.ndarray, terms: np.ndarray, names: list[str]) -> pd.DataFrame:
    """A segment's rows sorted by term; the row without a term holds its documents and where they start."""
    order = np.argsort(terms, kind="stable")
    counts = np.bincount(terms, minlength=len(names))
    lists = np.split(at[order], np.cumsum(counts)[:-1])
    by_name = sorted(range(len(names)), key=names.__getitem__)
    docs = np.array(ids, dtype="<i8").tobytes()
    return pd.DataFrame({
        "segment": segment, "term": [None, *(names[k] for k in by_name)], "n": np.array([len(ids), *(int(counts[k]) for k in by_name)], dtype=np.int32),
        "places": [_pack(np.array(starts, dtype=np.int64)), *(_pack(lists[k]) for k in by_name)], "docs": [docs] + [None] * len(by_name),
    })


class PassageIndex:
    """All words of a corpus with their places, below ``path``; see ``build`` and ``open``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> PassageIndex:
        return cls(spark, path)

    @classmethod
    def build(cls, docs: DataFrame, doc_id: str, text: str, path: str) -> PassageIndex:
        """A new index at ``path`` (an error if there is one). Null ids and texts are left out, repeated ids are documents of their own."""
        index = cls(docs.sparkSession, path)
        index._write(docs, doc_id, text, 0, "errorifexists")
        return index

    def append(self, docs: DataFrame, doc_id: str, text: str) -> None:
        """Add documents; what is there stays as it is."""
        last = self.table().agg(F.max("segment")).first()[0]
        self._write(docs, doc_id, text, 0 if last is None else (last >> 44) + 1, "append")

    def table(self) -> DataFrame:
        return self.spark.read.schema(_SEGMENT).parquet(self.path)

    def _write(self, docs: DataFrame, doc_id: str, text: str, load: int, mode: str) -> None:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            base, made = (load << 44) + (TaskContext.get().partitionId() << 20), 0
            names: dict[str, int] = {}
            ids: list[int] = []
            starts: list[int] = []
            at: list[np.ndarray] = []
            terms: list[np.ndarray] = []
            end = 0
            for b in batches:
                for d, t in zip(b["d"].tolist(), b["t"].tolist()):
                    w = words(t)
                    if not w:
                        continue
                    got = [names.setdefault(x, len(names)) for x in w]
                    ids.append(d)
                    starts.append(end)
                    terms.append(np.array(got, dtype=np.int32))
                    at.append(np.arange(end, end + len(w), dtype=np.int64))
                    end += len(w) + GAP
                    if end - GAP * len(ids) >= SEGMENT_WORDS or end >= MAX_PLACES:
                        yield _segment_rows(base + made, ids, starts, np.concatenate(at), np.concatenate(terms), list(names))
                        made += 1
                        names, ids, starts, at, terms, end = {}, [], [], [], [], 0
            if ids:
                yield _segment_rows(base + made, ids, starts, np.concatenate(at), np.concatenate(terms), list(names))

        rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).where("d is not null and t is not null")
        spread(rows).mapInPandas(run, _SEGMENT).write.mode(mode).option("compression", "zstd").parquet(self.path)

    def frequencies(self, vocabulary: dict[str, int]) -> dict[int, int]:
        """Occurrences of each term of a block's vocabulary {word: term} in the whole corpus; at most one entry per word of the block."""
        own = self.spark.createDataFrame(list(vocabulary.items()), "term string, k int")
        return {r["k"]: r["n"] for r in self.table().select("term", "n").join(F.broadcast(own), "term").groupBy("k").agg(F.sum("n").alias("n")).collect()}

    def per_segment(self, vocabulary: dict[str, int], leading: list[int], f: Callable[[dict[int, np.ndarray]], list[tuple[int, int, int]]], schema: T.StructType) -> DataFrame:
        """``f`` of {term: places} of each segment, which gives (place, item, figure) rows; places become documents.

        Segments that hold none of the ``leading`` terms are left out before their lists are shuffled.
        """
        own = self.spark.createDataFrame([(w, k) for w, k in vocabulary.items()], "term string, k int")
        rows = self.table()
        lists = rows.join(F.broadcast(own), "term").select("segment", "k", "places", F.lit(None).cast("binary").alias("docs"))
        heads = rows.where("term is null").select("segment", F.lit(-1).alias("k"), "places", "docs")

        def run(group: pd.DataFrame) -> pd.DataFrame:
            found: dict[int, np.ndarray] = {}
            ids = starts = None
            for k, p, d in zip(group["k"].tolist(), group["places"], group["docs"]):
                if k < 0:
                    ids, starts = np.frombuffer(d, dtype="<i8"), _unpack(p)
                else:
                    found[k] = _unpack(p)
            out: dict[tuple[int, int], int] = {}
            for place, item, n in f(found) if any(k in found for k in leading) else []:
                key = (int(ids[np.searchsorted(starts, place, side="right") - 1]), item)
                out[key] = max(out.get(key, 0), n)
            return pd.DataFrame([(d, i, n) for (d, i), n in out.items()], columns=schema.names)

        return lists.unionByName(heads).groupBy("segment").applyInPandas(run, schema)


def anchors(item_words: dict[int, list[str]], vocabulary: dict[str, int], df: dict[int, int], length: int, per_window: int = 3) -> tuple[list[tuple[int, int, int]], dict[int, list[tuple[int, ...]]]]:
    """((item, term, offset) of the rarest terms of every stretch; {item: the offset sets of its stretches})."""
    rows: set[tuple[int, int, int]] = set()
    windows: dict[int, list[tuple[int, ...]]] = {}
    for item, w in item_words.items():
        ids = [vocabulary[x] for x in w]
        sets = set()
        for start in range(len(ids) - length + 1):
            by_rarity = sorted(range(start, start + length), key=lambda k: (df.get(ids[k], 0), k))
            if df.get(ids[by_rarity[0]], 0) == 0:
                continue  # a word that no document holds: this stretch occurs nowhere
            picked: list[int] = []
            for k in by_rarity:
                if ids[k] not in {ids[p] for p in picked}:
                    picked.append(k)
                if len(picked) == per_window:
                    break
            sets.add(tuple(sorted(picked)))
        if sets:
            windows[item] = sorted(sets)
            rows |= {(item, ids[k], k) for s in sets for k in s}
    return sorted(rows), windows


def phrase_hits(found: dict[int, np.ndarray], item_terms: dict[int, list[int]], windows: dict[int, list[tuple[int, ...]]], length: int) -> list[tuple[int, int, int]]:
    """(place, item, words) of the longest runs of at least ``length`` item words in one segment, one per item and shift."""
    end = max(int(p[-1]) for p in found.values()) + 1
    text = np.full(end, -1, dtype=np.int32)
    for k, p in found.items():
        text[p] = k
    out = []
    for item, sets in windows.items():
        w = item_terms[item]
        tried: set[int] = set()
        for s in sets:
            if any(w[k] not in found for k in s):
                continue
            shortest, *others = sorted(s, key=lambda k: len(found[w[k]]))
            shifts = found[w[shortest]] - shortest
            for k in others:
                lists = found[w[k]]
                at = np.minimum(np.searchsorted(lists, shifts + k), len(lists) - 1)
                shifts = shifts[lists[at] == shifts + k]
                if not len(shifts):
                    break
            tried.update(shifts.tolist())
        if not tried:
            continue
        ids = np.array(w, dtype=np.int32)
        for shift in tried:
            lo, hi = max(0, -shift), min(len(w), end - shift)
            same = np.flatnonzero(text[shift + lo : shift + hi] != ids[lo:hi])
            stops = np.concatenate([[-1], same, [hi - lo]])
            runs = np.diff(stops) - 1
            best = int(runs.argmax())
            if runs[best] >= length:
                out.append((shift + lo + int(stops[best]) + 1, item, int(runs[best])))
    return out


def _scratch(docs: DataFrame, doc_id: str, text: str) -> PassageIndex:
    ws = Workspace(docs.sparkSession, "passages")
    return PassageIndex.build(docs, doc_id, text, f"{ws.root}/index")


def _blocks(items: DataFrame, item_id: str, item_text: str) -> Iterator[tuple[dict[int, list[str]], dict[str, int]]]:
    for block in item_blocks(items, item_id, item_text):
        vocabulary = {w: i for i, w in enumerate(sorted({w for ws_ in block.values() for w in ws_}))}
        if vocabulary:
            yield block, vocabulary


def _union(spark: SparkSession, parts: list[DataFrame], schema: T.StructType) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    figure = schema.names[2]
    return out.groupBy("doc_id", "item_id").agg(F.max(figure).alias(figure))


def leaked_passages(docs: DataFrame | PassageIndex, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, length: int = 12) -> DataFrame:
    """(doc_id, item_id, n_words): documents that hold at least ``length`` consecutive words of an item.

    ``docs`` is a table, indexed on the way, or an index. ``n_words`` is the longest such run. Items shorter than
    ``length``, null and empty texts match nothing; repeated documents' ids give one row per id and item. No items
    or documents give an empty result.
    """
    index = docs if isinstance(docs, PassageIndex) else _scratch(docs, doc_id, text)
    spark = index.spark
    parts = []
    for block, vocabulary in _blocks(items, item_id, item_text):
        df = index.frequencies(vocabulary)
        rows, windows = anchors(block, vocabulary, df, length)
        if not rows:
            continue
        needed = {i: [vocabulary[w] for w in block[i]] for i in windows}
        terms = {t for w in needed.values() for t in w}
        shared = spark.sparkContext.broadcast((needed, windows))
        leading = sorted({t for _, t, _ in rows})
        parts.append(index.per_segment({w: k for w, k in vocabulary.items() if k in terms}, leading, lambda found, shared=shared: phrase_hits(found, *shared.value, length), _HIT))
    return _union(spark, parts, _HIT)


def rare_sets(item_words: dict[int, list[str]], vocabulary: dict[str, int], df: dict[int, int], rare: int, least: int, length: int) -> dict[tuple[tuple[int, ...], int, int], list[int]]:
    """{(terms by rarity, how many of them, how many hits) that must stand close: items}.

    The rarest words of the whole item, and those of each of its stretches of ``length`` words. A stretch of fewer
    than ``least`` different words needs all of them and ``length`` hits, as an exact copy has.
    """
    out: dict[tuple[tuple[int, ...], int, int], set[int]] = {}
    for item, w in item_words.items():
        ids = [vocabulary[x] for x in w]
        stretches = [ids] + [ids[k : k + length] for k in range(len(ids) - length + 1)]
        for k, s in enumerate(stretches):
            terms = sorted({t for t in s if t in df}, key=lambda t: (df[t], t))[:rare]
            if len(terms) >= least:
                out.setdefault((tuple(terms), least, least), set()).add(item)
            elif k and terms and len(terms) == len({*s}):
                out.setdefault((tuple(terms), len(terms), length), set()).add(item)
    return {k: sorted(v) for k, v in out.items()}


class Nearness:
    """Which sets of terms stand within ``span`` words in a document, exactly.

    A set of which ``need`` terms must be close has two of its ``len - need + 2`` rarest among them (one, if only one
    is needed), so pairs of these lead to the sets; each is then tried around the pair, in a block with a halo.
    """

    def __init__(self, sets: list[tuple[tuple[int, ...], int, int]], span: int):
        self.span, self.sets = span, [(frozenset(t), need, hits) for t, need, hits in sets]
        self.single: dict[int, list[int]] = {}
        self.pair: dict[tuple[int, int], list[int]] = {}
        self.leading: set[int] = set()
        for k, (t, need, _) in enumerate(sets):
            if need < 2:
                for x in t[: len(t) - need + 1]:
                    self.single.setdefault(x, []).append(k)
                continue
            lead = sorted(t[: len(t) - need + 2])
            self.leading |= {*lead}
            for i, x in enumerate(lead):
                for y in lead[i + 1 :]:
                    self.pair.setdefault((x, y), []).append(k)

    def candidates(self, terms: list[int], places: list[int]) -> dict[int, set[int]]:
        """{block of the text: sets to try there}."""
        out: dict[int, set[int]] = {}
        before: list[tuple[int, int]] = []
        for p, x in zip(places, terms):
            if x in self.single:
                out.setdefault(p // self.span, set()).update(self.single[x])
            if x not in self.leading:
                continue
            before = [b for b in before if p - b[0] < self.span]
            for y in {b[1] for b in before}:
                if got := self.pair.get((x, y) if x < y else (y, x)):
                    out.setdefault(p // self.span, set()).update(got)
            before.append((p, x))
        return out

    def found(self, terms: list[int], places: list[int]) -> dict[int, int]:
        """{set: most of its distinct terms in any ``span`` consecutive words}."""
        best: dict[int, int] = {}
        for block, tries in self.candidates(terms, places).items():
            lo, hi = bisect_left(places, (block - 1) * self.span), bisect_left(places, (block + 2) * self.span)
            near = list(zip(places[lo:hi], terms[lo:hi]))
            here = {t for _, t in near}
            for k in tries:
                members, need, hits = self.sets[k]
                if len(members & here) < max(need, best.get(k, 0) + 1):
                    continue
                window: list[tuple[int, int]] = []
                for p, t in near:
                    if t in members:
                        window = [x for x in window if p - x[0] < self.span] + [(p, t)]
                        n = len({x[1] for x in window}) if len(window) >= hits else 0
                        if n >= need and n > best.get(k, 0):
                            best[k] = n
        return best


def near_passages(docs: DataFrame | PassageIndex, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, rare: int = 6, least: int = 4, span: int = 24, length: int = 12) -> DataFrame:
    """(doc_id, item_id, n_terms): documents that hold ``least`` of the ``rare`` rarest words of an item, or of a stretch of it, close together.

    Close means within some ``span`` consecutive words, wherever they start. A stretch is ``length`` consecutive
    words of the item, so parts of an item are found too, and every passage of ``leaked_passages`` with the same
    length (up to ``span``). ``n_terms`` is the most distinct rare words of one item or stretch found close together.
    ``docs`` is a table, indexed on the way, or an index.
    """
    if span > GAP:
        raise ValueError(f"a span of more than {GAP} words would reach over documents")
    index = docs if isinstance(docs, PassageIndex) else _scratch(docs, doc_id, text)
    spark = index.spark
    parts = []
    for block, vocabulary in _blocks(items, item_id, item_text):
        sets = rare_sets(block, vocabulary, index.frequencies(vocabulary), rare, least, length)
        if not sets:
            continue
        shared = spark.sparkContext.broadcast(list(sets.items()))
        terms = {t for s, _, _ in sets for t in s}

        def run(found: dict[int, np.ndarray], shared=shared) -> list[tuple[int, int, int]]:
            owners = [i for _, i in shared.value]
            near = Nearness([s for s, _ in shared.value], span)
            places = np.concatenate(list(found.values()))
            ids = np.concatenate([np.full(len(p), k, dtype=np.int64) for k, p in found.items()])
            order = np.argsort(places, kind="stable")
            places, ids = places[order], ids[order]
            out = []
            # documents stand at least GAP places apart
            cuts = np.flatnonzero(np.diff(places) >= GAP) + 1
            for p, t in zip(np.split(places, cuts), np.split(ids, cuts)):
                out += [(int(p[0]), item, n) for k, n in near.found(t.tolist(), p.tolist()).items() for item in owners[k]]
            return out

        parts.append(index.per_segment({w: k for w, k in vocabulary.items() if k in terms}, sorted(terms), run, _NEAR))
    return _union(spark, parts, _NEAR)
