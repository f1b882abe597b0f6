"""Which languages a text mixes, and in what shares, from n-gram likelihoods.

Training counts the byte n-grams of all labelled texts per language, hashed into
a fixed number of cells, so the model has cells x languages numbers however
large the corpus is.  A text is a bag of words; each word, with the gaps beside
it, has a likelihood under every language, and expectation-maximisation finds the
shares of the languages that make the words likeliest, until no share of the text
moves any more.  Of the sets of the languages with the largest shares, of any
size, the one with the best log-likelihood less a penalty per language is chosen;
sizes that could not beat it even with the likelihood of all languages are left
out.  The text's language is the one with the largest share in the chosen set.
What is found for a text follows from the text and the model alone.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as
is every text when nothing was learned; a null language or text teaches nothing;
equal shares go to the alphabetically first language; repeated rows are counted
and predicted one by one; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import (ArrayType, DoubleType, IntegerType, LongType, StringType, StructField,
                               StructType)

from incident_analytics.llm.rows import carry, map_slices

CELLS = 1 << 15
ORDERS = (2, 3, 4)
SMOOTHING = 0.5
#: Expectation-maximisation ends for a text when no share moves by this much in a round.
TOLERANCE = 1e-4
PENALTY = 12.0
UNKNOWN = "und"
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5],
                    np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def cells_of(raw: np.ndarray, order: int, cells: int = CELLS) -> np.ndarray:
    """Cell of the n-gram that starts at every byte but the last ``order`` - 1."""
    total = np.full(len(raw) - order + 1, order, np.uint64)
    for i in range(order):
        total = (total ^ raw[i:len(raw) - order + 1 + i].astype(np.uint64)) * _FACTORS[i]
        total ^= total >> np.uint64(29)
    return (total % np.uint64(cells)).astype(np.int64)


def word_cells(words: list[bytes], cells: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per n-gram order: the cell that starts at each byte, whether it lies in one word, and where words begin.

    A word reaches from the gap before it to the gap after it.
    """
    raw = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    lengths = np.array([len(w) for w in words], np.int64) + 1
    begins = np.cumsum(lengths) - lengths
    last = np.repeat(begins + lengths, lengths)  # of the word that each byte belongs to
    for order in ORDERS:
        found = np.zeros(len(last), np.int64)
        if len(raw) >= order:
            own = cells_of(raw, order, cells)[:len(last)]
            found[:len(own)] = own
        yield found, np.arange(len(last)) + order - 1 <= last, begins


def count_cells(words: list[bytes], cells: int = CELLS) -> np.ndarray:
    found = np.zeros(cells, np.int64)
    if words:
        for at, inside, _ in word_cells(words, cells):
            found += np.bincount(at[inside], minlength=cells)
    return found


@dataclass(frozen=True)
class Model:
    """Log-probability of every cell under every language; ``languages`` are in order of their names."""
    languages: tuple[str, ...]
    logs: np.ndarray


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang",
          cells: int = CELLS) -> Model:
    """Count the n-grams of all rows with a text and a language.

    Every task adds up its own rows; only cells x languages sums are shuffled per
    task and collected in the end.
    """
    schema = StructType([StructField("lang", StringType()), StructField("cell", IntegerType()),
                         StructField("n", LongType())])
    arrow = to_arrow_schema(schema)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                own = defaultdict(list)
                part = batch.slice(start, 256)
                for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    own[lang] += words_of(text)
                for lang, words in own.items():
                    sums[lang] = sums.get(lang, 0) + count_cells(words, cells)
        for lang, found in sums.items():
            at = np.flatnonzero(found)
            at = at if len(at) else np.zeros(1, np.int64)  # texts without words still name their language
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                 pa.array(found[at])], schema=arrow)

    rows = (labelled.select(text_col, lang_col)
            .where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
            .mapInArrow(counted, schema).groupBy("lang", "cell").agg(F.sum("n").alias("n"))
            .groupBy("lang").agg(F.collect_list("cell").alias("cell"), F.collect_list("n").alias("n"))
            .orderBy("lang").collect())
    logs = np.empty((cells, len(rows)))
    for k, row in enumerate(rows):
        counts = np.zeros(cells)
        counts[row["cell"]] = row["n"]
        logs[:, k] = np.log((counts + SMOOTHING) / (counts.sum() + SMOOTHING * cells))
    return Model(tuple(r["lang"] for r in rows), logs)


def word_likelihoods(model: Model, words: list[bytes]) -> np.ndarray:
    """Log-likelihood of each word (with the gaps around it) under each language."""
    total = np.zeros((len(words), len(model.languages)))
    for at, inside, begins in word_cells(words, len(model.logs)):
        total += np.add.reduceat(np.where(inside[:, None], model.logs[at], 0), begins, axis=0)
    return total


def shares(likelihoods: np.ndarray, weights: np.ndarray, sizes: np.ndarray, allowed: np.ndarray,
           begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares and log-likelihood of documents (runs of ``sizes`` words) over their allowed languages.

    ``likelihoods`` are scaled to a largest value of 1 per word.  Every document
    goes on until its own shares have settled.
    """
    starts = np.cumsum(sizes) - sizes
    total = np.add.reduceat(weights, starts)[:, None]
    now = np.where(allowed, begin, 0)
    now = now / now.sum(axis=1, keepdims=True)
    active, like, w = np.arange(len(sizes)), likelihoods, weights
    while len(active):
        own = sizes[active]
        joint = like * now[np.repeat(active, own)]
        joint *= (w / np.maximum(joint.sum(axis=1), 1e-300))[:, None]
        new = np.add.reduceat(joint, np.cumsum(own) - own, axis=0) / total[active]
        moving = np.abs(new - now[active]).max(axis=1) >= TOLERANCE
        now[active] = new
        if not moving.all():
            kept = np.repeat(moving, own)
            active, like, w = active[moving], like[kept], w[kept]
    seen = np.maximum((likelihoods * now[np.repeat(np.arange(len(sizes)), sizes)]).sum(axis=1), 1e-300)
    return now, np.add.reduceat(np.log(seen) * weights, starts)


def mixtures(model: Model, texts: list[list[bytes]]) -> list[tuple[list[str], list[float]]]:
    """Chosen languages with their shares, largest first, for bags of at least one word each."""
    names: dict[bytes, int] = {}
    ids, weights, sizes = [], [], []
    for words in texts:
        own: dict[int, int] = {}
        for w in words:
            k = names.setdefault(w, len(names))
            own[k] = own.get(k, 0) + 1
        sizes.append(len(own))
        ids += own
        weights += own.values()
    logs = word_likelihoods(model, list(names))
    scaled = np.exp(np.maximum(logs - logs.max(axis=1, keepdims=True), -60))[ids]
    weights, sizes = np.array(weights, float), np.array(sizes)
    n = len(model.languages)
    full, most = shares(scaled, weights, sizes, np.ones((len(texts), n), bool), np.ones((len(texts), n)))
    order = np.argsort(-full, axis=1, kind="stable")
    rank = np.argsort(order, axis=1, kind="stable")
    price = PENALTY * np.log(np.add.reduceat(weights, np.cumsum(sizes) - sizes) + 1)
    best, chosen = np.full(len(texts), -np.inf), np.zeros_like(full)
    for size in range(1, n + 1):
        # All languages together fit best: a set that loses even with their likelihood is not tried.
        open_ = most + 1e-6 * np.abs(most) - price * (size - 1) > best
        if not open_.any():
            break
        rows = np.repeat(open_, sizes)
        now, fit = shares(scaled[rows], weights[rows], sizes[open_], (rank < size)[open_], full[open_] + 1e-6)
        value = fit - price[open_] * (size - 1)
        better = np.flatnonzero(open_)[value > best[open_]]
        chosen[better] = now[value > best[open_]]
        best[better] = value[value > best[open_]]
    found = []
    for row in chosen:
        picked = [k for k in np.argsort(-row, kind="stable") if row[k] > 0]
        found.append(([model.languages[k] for k in picked], [float(row[k]) for k in picked]))
    return found


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
             with_row: bool = False) -> DataFrame:
    """Per row: id, ``lang_pred``, ``score`` (share of that language), and the whole mixture.

    ``with_row`` adds the whole row as the struct ``__row``.
    """
    schema = StructType([docs.select(id_col).schema[0], StructField("lang_pred", StringType()),
                         StructField("score", DoubleType()),
                         StructField("langs", ArrayType(StringType())),
                         StructField("shares", ArrayType(DoubleType()))])

    def predicted(ids: list, texts: list) -> dict:
        out: list[tuple[list[str], list[float]]] = [([], [])] * len(ids)
        known = [i for i, t in enumerate(texts) if model.languages and any(map(str.isalpha, t or ""))]
        if known:
            for i, found in zip(known, mixtures(model, [words_of(texts[i]) for i in known])):
                out[i] = found
        return {id_col: ids, "lang_pred": [a[0] if a else UNKNOWN for a, _ in out],
                "score": [min(1.0, b[0]) if b else 0.0 for _, b in out],
                "langs": [a for a, _ in out], "shares": [b for _, b in out]}

    return map_slices(docs.select(id_col, text_col, *[carry(docs)] * with_row), predicted, schema)
