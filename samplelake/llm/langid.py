"""Language of a document from the n-grams that occur in it.

The blended-spectrum presence kernel of two texts is the mean, over n-gram lengths 1 to 3, of
the cosine of their sets of n-grams. A bounded sample of labelled documents trains one-versus-rest
kernel ridge regression on Nyström landmarks. The kernel is an inner product, so landmarks and
weights fold into one matrix, and documents are scored in batches by matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samplelake.llm.common import map_batches, packed, unpacked

#: 0 is everything but letters, 1 to OWN are the most frequent letters of the sample, and the
#: rest of the letters share the symbols above by their code point.
OWN, SYMBOLS, ORDERS = 64, 96, (1, 2, 3)
SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double"
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _codes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-case texts, a gap after each, and the text each belongs to."""
    parts = [(t or "").lower() + "\n" for t in texts]
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.repeat(np.arange(len(parts)), [len(p) for p in parts])


@dataclass
class Alphabet:
    """Symbol of each code point."""

    table: np.ndarray

    @staticmethod
    def learn(texts: Sequence[str]) -> Alphabet:
        counts = np.bincount(_codes(texts)[0], minlength=0x110000)
        letters = np.array([i for i in np.flatnonzero(counts) if chr(i).isalpha()], dtype=np.int64)
        first = letters[np.argsort(-counts[letters], kind="stable")][:OWN]
        every = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        points = np.arange(0x110000)
        table = np.where(every, OWN + 1 + points % (SYMBOLS - OWN - 1), 0).astype(np.uint8)
        table[first] = np.arange(1, len(first) + 1)
        return Alphabet(table)

    def grams(self, texts: Sequence[str | None]):
        """For each n-gram length, the text and the code of every n-gram; runs of symbols that
        are no letters count as one."""
        codes, owner = _codes(texts)
        symbols = self.table[codes].astype(np.int32)
        keep = np.ones(len(symbols), bool)
        keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0) | (owner[1:] != owner[:-1])
        symbols, owner = symbols[keep], owner[keep]
        code, at = symbols, owner
        yield at, code
        for n in ORDERS[1:]:
            code = code[:-1] * SYMBOLS + symbols[n - 1 :] if len(code) else code
            at = owner[: len(code)]
            inside = owner[n - 1 :] == at
            yield at[inside], code[inside]


def _presence(alphabet: Alphabet, places: list[np.ndarray], sizes: list[int], texts: Sequence[str | None]):
    """Unit rows of n-gram presence for each length: the feature map of the kernel."""
    for (owner, code), place, size in zip(alphabet.grams(texts), places, sizes, strict=True):
        rows = np.zeros((len(texts), size + 1), np.float32)
        rows[owner, place[code]] = 1
        rows[:, size] = 0
        norm = np.sqrt(rows.sum(1, keepdims=True))
        yield rows / np.maximum(norm, 1)


@dataclass
class LanguageModel:
    """``weights`` has, per n-gram length, one row per n-gram and one column per language."""

    languages: list[str]
    alphabet: Alphabet
    places: list[np.ndarray]
    weights: list[np.ndarray]

    def decide(self, texts: Sequence[str | None], batch: int = 64) -> tuple[list[str], list[float]]:
        sizes = [len(w) for w in self.weights]
        names, scores = [], []
        for start in range(0, len(texts), batch):
            some = texts[start : start + batch]
            value = np.zeros((len(some), len(self.languages)), np.float64)
            for rows, weight in zip(_presence(self.alphabet, self.places, sizes, some), self.weights, strict=True):
                value += rows[:, :-1] @ weight
            best = value.argmax(1)
            for text, b, v in zip(some, best, value, strict=True):
                known = has_letter(text)
                names.append(self.languages[b] if known else UNKNOWN)
                scores.append(float(np.clip(v[b], 0, 1)) if known else 0.0)
        return names, scores


def fit(
    labelled: Sequence[tuple[str, str]], *, landmarks: int = 256, grams: int = 8192, ridge: float = 1e-4
) -> LanguageModel:
    """``labelled`` has (text, language) pairs; equal input gives an equal model."""
    texts, langs = [t for t, _ in labelled], [lang for _, lang in labelled]
    languages = sorted(set(langs))
    alphabet = Alphabet.learn(texts)
    places, sizes = [], []
    for n, (owner, code) in zip(ORDERS, alphabet.grams(texts), strict=True):
        universe = SYMBOLS**n
        counts = np.bincount(np.unique(owner.astype(np.int64) * universe + code) % universe, minlength=universe)
        chosen = np.argsort(-counts, kind="stable")[: min(grams, int((counts > 1).sum()) or 1)]
        place = np.full(universe, len(chosen), np.int32)
        place[chosen] = np.arange(len(chosen))
        places.append(place)
        sizes.append(len(chosen))
    each = max(1, landmarks // len(languages))
    marks, taken = [], dict.fromkeys(languages, 0)
    for i, lang in enumerate(langs):
        if taken[lang] < each:
            taken[lang] += 1
            marks.append(i)
    at_marks = list(_presence(alphabet, places, sizes, [texts[i] for i in marks]))
    kernel = []
    for start in range(0, len(texts), 256):
        rows = _presence(alphabet, places, sizes, texts[start : start + 256])
        kernel.append(sum(a.astype(np.float64) @ m.T for a, m in zip(rows, at_marks, strict=True)) / len(ORDERS))
    every = np.concatenate(kernel)
    goal = np.array([[lang == x for x in languages] for lang in langs], np.float64)
    own = every[marks]
    system = every.T @ every + ridge * len(texts) * own + 1e-9 * len(texts) * np.eye(len(marks))
    dual = np.linalg.solve(system, every.T @ goal)
    weights = [(m[:, :-1].T.astype(np.float64) @ dual / len(ORDERS)).astype(np.float32) for m in at_marks]
    return LanguageModel(languages, alphabet, places, weights)


def learn(
    docs: DataFrame, *, per_language: int = 400, most_rows: int = 4_000, longest: int = 20_000
) -> LanguageModel | None:
    """Fit on a bounded sample: per language the ``per_language`` labelled documents (fewer
    where there are many languages: ``most_rows`` in all) that come first by a hash of their
    id, out of those that are not held out and have 1 to ``longest`` characters. None if no
    document can be learned from."""
    usable = docs.filter(
        ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.length("text").between(1, longest)
    ).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    languages = usable.select("lang").distinct().orderBy("lang").limit(most_rows).count()
    if not languages:
        return None
    each = max(1, min(per_language, most_rows // languages))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = [
        row["doc_id"]
        for row in usable.select("doc_id", "lang").withColumn("at", F.row_number().over(first))
        .filter(F.col("at") <= each).select("doc_id").limit(most_rows).collect()
    ]
    rows = usable.filter(F.col("doc_id").isin(ids)).limit(most_rows).collect()
    ordered = sorted(((r["doc_id"], r["text"], r["lang"]) for r in rows), key=lambda r: (hash_order(r[0]), *r))
    return fit([(text, lang) for _, text, lang in ordered if has_letter(text)] or [(ordered[0][1], ordered[0][2])])


def hash_order(doc_id: int) -> int:
    """An order of ids that has nothing to do with the order of the corpus."""
    return (doc_id * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row.

    The language is ``und`` with score 0 where the text is null or has no letter, and where
    there is no model. Repeated rows give repeated rows; an empty table gives none. Only
    ``doc_id`` and ``text`` are read, and the id takes no part in the prediction.
    """
    held = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text").to_pylist()
        names, scores = shared.value.decide(texts) if shared.value else ([UNKNOWN] * len(texts), [0.0] * len(texts))
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": names, "score": scores}

    return map_batches(held, work, SCHEMA)


def without_unknown(docs: DataFrame, model: LanguageModel | None, least_score: float) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is known with a score of
    ``least_score`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = packed(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            names, scores = shared.value.decide(texts) if shared.value else ([UNKNOWN] * len(texts), [0.0] * len(texts))
            known = [name != UNKNOWN and score >= least_score for name, score in zip(names, scores, strict=True)]
            yield batch.filter(pa.array(known, pa.bool_()))

    return unpacked(rows.mapInArrow(run, rows.schema), docs)
