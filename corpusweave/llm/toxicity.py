"""Toxicity by nearest labelled examples: exact cosine of weighted TF-IDF vectors over a block-max inverted index.

Fit: labelled rows outside the held-out fold are split and ordered by a hash
of their id; the first ``TOXIC`` toxic and ``CLEAN`` other ones of two thirds
become the examples, the first ``CALIBRATION`` of the last third the
calibration rows (bounded by these parameters).
The terms are all words and four-byte word beginnings of the examples; their
document frequencies are counted over all documents. A term in no example adds
to no cosine and takes no part in a text's vector. A term's idf is multiplied
by ``emphasis``, which is 1 for a term that says nothing about the label and
grows with its chi-square in the examples; no term is dropped for it.

Search, for a group of texts at once: examples lie in blocks of ``BLOCK``,
alike ones together. Terms in few examples have short posting lists, which are
read and added up. Terms in at least one of ``LONG`` examples have long lists,
stored block by block, and each block knows its largest weight of such a term:
these, with the largest sum of short lists in the block, bound every cosine in
it. Blocks are read in falling order of their bounds; those whose bound is
below a text's K-th best cosine so far are skipped. What is left at the end is
computed again term by term, so the K nearest examples are exact and do not
depend on the texts beside them. Their votes are weighted by 1 / (0.1 + distance),
and a logistic curve fitted on the calibration rows turns the vote and the
similarities into a probability. The nearest examples and their cosines are the
evidence.

Documents are scored where they are read: no shuffle. What is broadcast (terms
and examples) is bounded by the examples, not by the corpus.

Defined results: a text without any of the terms (also null or empty) has no
neighbours and gets the calibrated base score; null ids belong to fold 0 and
are scored; repeated rows get equal scores; several labels for one id count as
toxic if any is; without labelled rows of both kinds every score is 0. Extra
columns pass through unless named like a result column.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, fold, shared_table

TOXIC, CLEAN, CALIBRATION = 2000, 2500, 4000
K, BLOCK = 7, 64
#: A term in at least 1 / LONG of the examples has a long list. Texts that are searched at once, at most (and their bytes);
#: raw words whose places a worker remembers.
LONG, GROUP, GROUP_BYTES, REMEMBERED = 16, 128, 1 << 20, 300_000
#: How strongly a term's chi-square raises its weight (0: plain TF-IDF). K and POWER have the least log loss, but for 0.1, in a
#: three-fold cross-validation on the labelled rows of sf0.1 outside the held-out fold (K 3 to 15, POWER 0 to 1).
POWER = 0.5
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
RESULT = ("score", "predicted", "evidence")
_MARKS = b".,;:!?\"'()[]{}*#%&$|<>-"


def terms(text: bytes | None) -> Counter:
    """Words and word beginnings with their counts."""
    out: Counter = Counter()
    for w, n in Counter((text or b"").lower().split()).items():
        w = w.strip(_MARKS)
        if w:
            out[w] += n
            if len(w) > 4:
                out[b"^" + w[:4]] += n
    return out


class _Places(dict):
    """Raw lower-case word -> place of the word * (n + 1) + place of its beginning; n stands for none of the n terms."""

    def __init__(self, place: dict[bytes, int]):
        super().__init__()
        self.place, self.n = place, len(place)

    def __missing__(self, raw: bytes) -> int:
        w = raw.strip(_MARKS)
        get = self.place.get
        code = get(w, self.n) * (self.n + 1) + (get(b"^" + w[:4], self.n) if len(w) > 4 else self.n) if w else self.n * (self.n + 2)
        self[raw] = code
        return code

    def occurring(self, texts: list[bytes | None]):
        """(text, place, count) of every known term in every text, by text and place, as ``terms`` counts them."""
        import numpy as np
        codes = []
        for text in texts:
            ws = (text or b"").lower().split()
            codes.append(np.fromiter(map(self.__getitem__, ws), np.int64, len(ws)))
            if len(self) > REMEMBERED:
                self.clear()
        owner = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        word, beginning = np.divmod(np.concatenate(codes) if codes else np.empty(0, np.int64), self.n + 1)
        keys = np.concatenate([(owner * self.n + at)[at < self.n] for at in (word, beginning)])
        keys, count = np.unique(keys, return_counts=True)
        text, at = np.divmod(keys, max(1, self.n))
        return text, at, count


def _groups(texts: list[bytes | None]):
    """Cuts of the texts into groups of at most GROUP rows and about GROUP_BYTES, as (begin, end)."""
    begin = size = 0
    for i, text in enumerate(texts):
        size += len(text or b"")
        if size >= GROUP_BYTES or i + 1 - begin >= GROUP:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _example_terms(examples: DataFrame) -> list[bytes]:
    """All terms of the examples, in order."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            found = set()
            for text in as_bytes(batch.column(0)):
                found.update(terms(text))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary())], names=["term"])
    return sorted(examples.select("text").mapInArrow(run, "term binary").distinct().toArrow().column(0).to_pylist())


def _ranges(begin, end):
    """The numbers of all ranges begin[i] .. end[i] - 1, one after the other."""
    import numpy as np
    size = end - begin
    return np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)


def _document_counts(docs: DataFrame, place: dict[bytes, int]) -> tuple:
    """Number of documents, and of those with each term, over all of ``docs``."""
    import numpy as np
    shared = docs.sparkSession.sparkContext.broadcast(place)

    def run(batches):
        import pyarrow as pa
        known, counts, n = _Places(shared.value), np.zeros(len(shared.value) + 1, np.int64), 0
        for batch in batches:
            texts = as_bytes(batch.column(0))
            for lo, hi in _groups(texts):
                counts += np.bincount(known.occurring(texts[lo:hi])[1], minlength=len(counts))
            n += len(texts)
        counts[-1] = n
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["term", "n"])
    rows = docs.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(place) + 1)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return out[-1], out[:-1]


def emphasis(place: dict[bytes, int], examples: list[tuple]):
    """A factor of at least 1 for each term: it grows with the term's chi-square against the label in the examples."""
    import numpy as np
    by = np.zeros((2, len(place)))
    for _, label, at, _ in examples:
        by[int(label > 0), at] += 1
    toxic = float(sum(y > 0 for _, y, _, _ in examples))
    n, df = len(examples), by.sum(axis=0)
    cross = by[1] * (n - toxic - by[0]) - by[0] * (toxic - by[1])
    chi2 = n * cross * cross / (toxic * (n - toxic) * df * (n - df) + 1e-9)
    return (1 + chi2) ** POWER


class Index:
    """The examples' vectors in blocks, with block-wise largest weights."""

    def __init__(self, place: dict[bytes, int], idf, examples: list[tuple], calibrated=None):
        """``examples``: (id, label, places of the terms in order, their counts)."""
        import numpy as np
        self.place, self.idf, self.curve, self._search = place, idf, calibrated, None
        vectors = [(i, y, at, self._weights(at, n)) for i, y, at, n in examples]
        vectors = [v for v in vectors if len(v[2])]
        # alike ones together: by label and heaviest term
        vectors.sort(key=lambda v: (-v[1], int(v[2][np.argmax(v[3])]), str(v[0])))
        self.ids = [v[0] for v in vectors]
        self.labels = np.array([v[1] for v in vectors], np.float64)
        # postings by term and example; those of one term in one block are an entry, with their largest weight
        size = np.array([len(v[2]) for v in vectors], np.int64)
        example = np.repeat(np.arange(len(vectors)), size)
        term, weight = (np.concatenate([v[i] for v in vectors]) if vectors else np.empty(0, kind) for i, kind in ((2, np.int64), (3, np.float32)))
        order = np.lexsort((example, term))
        term, self.example, self.weight = term[order], example[order], weight[order]
        block = self.example // BLOCK
        begin = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])) if len(term) else np.empty(0, np.int64)
        self.start, self.block = np.append(begin, len(term)), block[begin]
        self.largest = np.maximum.reduceat(self.weight, begin) if len(begin) else self.weight
        self.first = np.searchsorted(term[begin], np.arange(len(place) + 1))

    @property
    def rows(self):
        """For each block, the row of ``blocks`` that holds a term."""
        import numpy as np
        return np.broadcast_to(np.arange(len(self.place)), (-(-len(self.ids) // BLOCK), len(self.place)))

    @property
    def blocks(self) -> list:
        """The blocks as matrices (term, example), made when read."""
        import numpy as np
        term = np.repeat(np.repeat(np.arange(len(self.place)), np.diff(self.first)), np.diff(self.start))
        out = []
        for lo in range(0, len(self.ids), BLOCK):
            own = (self.example >= lo) & (self.example < lo + BLOCK)
            out.append(np.zeros((len(self.place), min(BLOCK, len(self.ids) - lo)), np.float32))
            out[-1][term[own], self.example[own] - lo] = self.weight[own]
        return out

    def _weights(self, at, n):
        """(1 + ln tf) * idf, of length 1."""
        import numpy as np
        w = (1 + np.log(n)) * self.idf[at]
        return (w / max(np.linalg.norm(w), 1e-300)).astype(np.float32)

    def vector(self, counts: Counter):
        """Places and weights of the terms."""
        import numpy as np
        found = sorted((self.place[t], n) for t, n in counts.items() if t in self.place)
        at, n = (np.array(x, np.int64) for x in (zip(*found) if found else ((), ())))
        return at, self._weights(at, n)

    def _prepared(self):
        """What the search needs beside the postings: the long lists by block with their largest weights, and the examples' own vectors."""
        import numpy as np
        if self._search is None:
            n = len(self.ids)
            size = np.diff(self.start[self.first]) if n else np.zeros(len(self.place), np.int64)
            long = np.flatnonzero(size * LONG >= max(1, n))
            row = np.full(len(self.place), -1, np.int64)
            row[long] = np.arange(len(long))
            term = np.repeat(np.arange(len(self.place)), size)
            own = row[term] >= 0
            lists = np.zeros((len(long), n), np.float32)
            lists[row[term[own]], self.example[own]] = self.weight[own]
            cuts = np.arange(0, n, BLOCK)
            largest = np.maximum.reduceat(lists, cuts, axis=1) if n and len(long) else np.zeros((len(long), len(cuts)), np.float32)
            by = np.argsort(self.example, kind="stable")  # terms stay in order
            self._search = (row, [np.ascontiguousarray(lists[:, c:c + BLOCK]) for c in cuts], largest, cuts, term[by], self.weight[by],
                            np.searchsorted(self.example[by], np.arange(n + 1)))
        return self._search

    def __getstate__(self):
        return {**self.__dict__, "_search": None}

    def vectors(self, texts: list[bytes | None], known: _Places):
        """(text, place, weight) of all terms of the texts; each text's weights have length 1."""
        import numpy as np
        text, at, count = known.occurring(texts)
        w = (1 + np.log(count)) * self.idf[at]
        return text, at, (w / np.sqrt(np.bincount(text, w * w, len(texts)))[text]).astype(np.float32)

    def nearest_all(self, text, at, w, n_texts: int, k: int = K) -> list[list[tuple[float, int]]]:
        """For each text the k examples of largest positive cosine, as (cosine, example); equal ones by number."""
        import numpy as np
        n = len(self.ids)
        if not n or not len(text):
            return [[] for _ in range(n_texts)]
        row, lists, largest, cuts, ex_term, ex_weight, ex_first = self._prepared()
        long = row[at] >= 0
        # short lists: read whole
        lo, hi = self.start[self.first[at[~long]]], self.start[self.first[at[~long] + 1]]
        post = _ranges(lo, hi)
        sums = np.bincount(np.repeat(text[~long] * n, hi - lo) + self.example[post], np.repeat(w[~long], hi - lo) * self.weight[post],
                           n_texts * n).astype(np.float32).reshape(n_texts, n)
        # long lists: bounds, then blocks
        query = np.zeros((n_texts, len(largest)), np.float32)
        query[text[long], row[at[long]]] = w[long]
        bounds = np.maximum.reduceat(sums, cuts, axis=1) + query @ largest
        order = np.argsort(-bounds, axis=1, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(len(cuts))[None, :], axis=1)
        scores, best = np.full((n_texts, n), -1, np.float32), np.zeros((n_texts, len(cuts)), np.float32)
        least, slack = np.zeros(n_texts, np.float32), np.float32(1e-5)  # the slack covers rounding of sums taken in another order
        begin, step = 0, k + 1
        while begin < len(cuts):
            # so many blocks are read at once, twice as many each time
            wanted = (rank >= begin) & (rank < begin + step) & (bounds > 0) & (bounds >= least[:, None] - slack)
            if not wanted.any():
                break
            for j in np.flatnonzero(wanted.any(axis=0)).tolist():
                own, part = np.flatnonzero(wanted[:, j]), slice(cuts[j], cuts[j] + BLOCK)
                got = sums[own, part] + query[own] @ lists[j]
                scores[own, part], best[own, j] = got, got.max(axis=1)
            if len(cuts) > k:  # k blocks hold an example of at least this cosine
                least = np.partition(best, len(cuts) - k, axis=1)[:, len(cuts) - k]
            begin, step = begin + step, 2 * step
        if n > k:
            least = np.maximum(0, np.partition(scores, n - k, axis=1)[:, n - k])
        # the best of them again, term by term
        mine, example = np.nonzero((scores > 0) & (scores >= least[:, None] - slack))
        begins, out = np.searchsorted(text, np.arange(n_texts + 1)), []
        values, ends = np.zeros(len(self.place)), np.searchsorted(mine, np.arange(n_texts + 1))
        for i in range(n_texts):
            some, own = example[ends[i]:ends[i + 1]], slice(begins[i], begins[i + 1])
            if not len(some):
                out.append([])
                continue
            values[at[own]] = w[own]
            lo, hi = ex_first[some], ex_first[some + 1]
            post = _ranges(lo, hi)
            exact = np.bincount(np.repeat(np.arange(len(some)), hi - lo), values[ex_term[post]] * ex_weight[post], len(some))
            values[at[own]] = 0
            first = np.lexsort((some, -exact))[:k]
            out.append(list(zip(exact[first].tolist(), some[first].tolist())))
        return out

    def nearest(self, t, w, k: int = K) -> list[tuple[float, int]]:
        """``nearest_all`` for one text's vector."""
        import numpy as np
        return self.nearest_all(np.zeros(len(t), np.int64), t, w, 1, k)[0]

    def evidence(self, near) -> tuple[float, float, float]:
        """Weighted vote, best toxic and best clean cosine."""
        if not near:
            return 0.0, 0.0, 0.0
        total = toxic = best_toxic = best_clean = 0.0
        for cos, i in near:
            weight = 1 / (0.1 + max(0.0, 1 - cos))
            total += weight
            if self.labels[i]:
                toxic += weight
                best_toxic = max(best_toxic, cos)
            else:
                best_clean = max(best_clean, cos)
        return toxic / total, best_toxic, best_clean

    def score(self, near) -> float:
        vote, toxic, clean = self.evidence(near)
        b = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, b[0] + b[1] * vote + b[2] * toxic + b[3] * clean))))

    def calibrate(self, rows: list[tuple]) -> None:
        """Logistic regression (Newton's method, ridge 0.5) of the label on the evidence. ``rows``: (label, vote, best toxic, best clean)."""
        import numpy as np
        x = np.array([[1.0, *evidence] for _, *evidence in rows]).reshape(-1, 4)
        y = np.array([float(y) for y, *_ in rows])
        b, ridge = np.zeros(4), np.diag([1e-3, 0.5, 0.5, 0.5])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ b)
            b = b + step
            if np.abs(step).max() < 1e-8:
                break
        self.curve = b.tolist()


def fit(docs: DataFrame, labels: DataFrame) -> Index | None:
    """``docs``: id, text; ``labels``: id, label (both may hold other rows too)."""
    import numpy as np
    known = labels.where("id IS NOT NULL AND label IS NOT NULL").where(fold("id", FOLDS) != HELD_OUT).groupBy("id").agg(F.max("label").alias("label"))
    known = known.withColumn("order", F.xxhash64("id"))
    # a third of the labelled rows, by hash, may calibrate; the others may be examples
    calibrates = F.pmod(F.col("order"), F.lit(3)) == 0
    pick = lambda pool, n, use: known.where(pool).orderBy("order", "id").limit(n).withColumn("use", F.lit(use))
    chosen = (pick(~calibrates & (F.col("label") == 1), TOXIC, "example").union(pick(~calibrates & (F.col("label") == 0), CLEAN, "example"))
              .union(pick(calibrates, CALIBRATION, "calibration"))).select("id", "label", "use")
    # at most TOXIC + CLEAN + CALIBRATION rows
    sample = shared_table(docs.join(F.broadcast(chosen), "id").select("id", "text", "label", "use"), "toxic-sample")
    examples = sample.where("use = 'example'")
    if examples.select("label").distinct().count() < 2:
        return None
    place = {t: i for i, t in enumerate(_example_terms(examples))}
    n, df = _document_counts(docs.select("text"), place)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(place)

    def packed(batches):
        import pyarrow as pa
        known = _Places(shared.value)
        for batch in batches:
            at, counts = [], []
            for text in as_bytes(batch.column(1)):
                _, a, c = known.occurring([text])
                at.append(a.astype(np.int32).tobytes())
                counts.append(c.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(at, pa.binary()), pa.array(counts, pa.binary())],
                                             names=["id", "label", "at", "counts"])
    id_type = docs.schema["id"].dataType.simpleString()
    label = F.col("label").cast("int").alias("label")
    rows = examples.select("id", "text", label).mapInArrow(packed, f"id {id_type}, label int, at binary, counts binary").collect()
    chosen = [(r.id, r.label, np.frombuffer(r.at, np.int32), np.frombuffer(r.counts, np.int32)) for r in rows]
    index = Index(place, (np.log((1 + n) / (1 + df)) + 1) * emphasis(place, chosen), chosen)

    # the calibration rows are searched by tasks; four numbers a row come back
    fitted = spark.sparkContext.broadcast(index)

    def weighed(batches):
        import pyarrow as pa
        at, known = fitted.value, _Places(fitted.value.place)
        for batch in batches:
            texts, out = as_bytes(batch.column(0)), []
            for lo, hi in _groups(texts):
                out += [at.evidence(near) for near in at.nearest_all(*at.vectors(texts[lo:hi], known), hi - lo)]
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array([x[i] for x in out], pa.float64()) for i in range(3))],
                                             names=["label", "vote", "toxic", "clean"])
    found = sample.where("use = 'calibration'").select("text", label).mapInArrow(weighed, "label int, vote double, toxic double, clean double").collect()
    index.calibrate(sorted(map(tuple, found)))
    return index


def score(docs: DataFrame, index: Index | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``, ``predicted`` and ``evidence`` (the nearest examples: id, label, cosine)."""
    own = [c for c in docs.columns if c.lower() not in RESULT]
    evidence = "array<struct<example:string,label:int,cosine:double>>"
    if index is None:
        return docs.select(*own, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.array().cast(evidence).alias("evidence"))
    shared = docs.sparkSession.sparkContext.broadcast(index)
    empty = docs.select(*own, F.lit(0.0).alias("score"), F.array().cast(evidence).alias("evidence"))
    schema = docs.sparkSession.createDataFrame([], empty.schema).schema

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type
        kind = to_arrow_type(schema["evidence"].dataType)
        at = shared.value
        known = _Places(at.place)
        for batch in batches:
            texts, scores, found = as_bytes(batch.column(text_col)), [], []
            for lo, hi in _groups(texts):
                for near in at.nearest_all(*at.vectors(texts[lo:hi], known), hi - lo):
                    scores.append(at.score(near))
                    found.append([{"example": str(at.ids[i]), "label": int(at.labels[i]), "cosine": c} for c, i in near[:5]])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(scores, pa.float64()), pa.array(found, kind)],
                                             names=[*own, "score", "evidence"])
    return docs.select(*own).mapInArrow(run, schema).select(
        *own, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
